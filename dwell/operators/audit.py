"""Audits and data-quality checks.

Checks return *violation rows* (empty = pass) or small count tables, so they
compose with the rest of the plan and never collect data to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .keyed import ROWS_PER_TASK, keyed_lag
from .pairing import ts_micros


def transitions(df: DataFrame, before: str, after: str) -> DataFrame:
    """Crosstab of (before, after) as long counts."""
    return df.groupBy(F.col(before).alias("before"), F.col(after).alias("after")).agg(
        F.count(F.lit(1)).alias("n"))


def copy_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows where both copies are present; identical after trim + case fold."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    same = both & (F.lower(strip(F.col(a).cast("string"))) == F.lower(strip(F.col(b).cast("string"))))
    return df.agg(F.count_if(both).alias("compared"), F.count_if(same).alias("identical")).withColumns({
        "identical_rate": F.try_divide(F.col("identical"), F.col("compared")),
        "differ": F.col("compared") - F.col("identical")})


def varies_across_visits(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Among keys seen more than once, the share whose value of each column
    changes between visits (null counts as a value)."""
    long = (df.select(key, *[F.col(c).cast("string").alias(c) for c in columns])
            .unpivot([key], list(columns), "column", "value"))
    per_key = long.groupBy(key, "column").agg(
        F.count(F.lit(1)).alias("_visits"),
        (F.count_distinct("value") + F.max(F.col("value").isNull().cast("int"))).alias("_distinct"))
    return (per_key.where(F.col("_visits") > 1).groupBy("column")
            .agg(F.count(F.lit(1)).alias("repeat_keys"),
                 F.avg((F.col("_distinct") > 1).cast("double")).alias("varies_rate")))


def repeat_entities(df: DataFrame, key: str, min_visits: int = 2) -> DataFrame:
    """Keys with at least ``min_visits`` rows (partial aggregation per key)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("visits")).where(F.col("visits") >= min_visits)


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key combinations present more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def timeline(starts: DataFrame, ends: DataFrame, key: str, start_ts: str, end_ts: str,
             start_tag: str = "START", end_tag: str = "END") -> DataFrame:
    """Both event kinds of each key on one time line (sorted; a global sort is
    range partitioned)."""
    s = starts.select(F.col(key).alias("key"), F.col(start_ts).alias("ts"), F.lit(start_tag).alias("event"))
    e = ends.select(F.col(key).alias("key"), F.col(end_ts).alias("ts"), F.lit(end_tag).alias("event"))
    return s.unionByName(e).orderBy("key", "ts", "event")


def overlapping_stays(df: DataFrame, key: str, start_ts: str, end_ts: str, seq: str,
                      rows_per_task: int | None = ROWS_PER_TASK) -> DataFrame:
    """Rows starting before the previous stay of the same key ended."""
    lagged = keyed_lag(df, key, [start_ts, seq], [end_ts], ts_micros(df, start_ts),
                       rows_per_task=rows_per_task)
    return lagged.where(F.col(start_ts) < F.col(f"prev_{end_ts}"))


def non_monotonic_ends(df: DataFrame, key: str, start_ts: str, end_ts: str, seq: str,
                       rows_per_task: int | None = ROWS_PER_TASK) -> DataFrame:
    """Rows whose end is earlier than the previous row's end (starts sorted)."""
    lagged = keyed_lag(df, key, [start_ts, seq], [end_ts], ts_micros(df, start_ts),
                       rows_per_task=rows_per_task)
    return lagged.where(F.col(end_ts) < F.col(f"prev_{end_ts}"))


def duration_out_of_bounds(df: DataFrame, y: str = "duration_days", lo: float = 0.0,
                           hi: float = 365.0) -> DataFrame:
    """Q1: null or outside [lo, hi]."""
    return df.where(F.col(y).isNull() | (F.col(y) < lo) | (F.col(y) > hi))


def end_before_start(df: DataFrame, start_ts: str, end_ts: str) -> DataFrame:
    """Q2."""
    return df.where(F.col(end_ts) < F.col(start_ts))


def split_violations(summary: DataFrame) -> DataFrame:
    """Q7 over :func:`dwell.operators.split.split_summary`: every period populated
    and strictly ordered (each period's first start after the previous period's
    last).  Returns offending periods."""
    from pyspark.sql import Window
    order = F.create_map(F.lit("train"), F.lit(0), F.lit("validation"), F.lit(1), F.lit("test"), F.lit(2))
    w = Window.orderBy(order[F.col("split")])  # three rows
    s = summary.withColumn("_prev_max", F.lag("max_start").over(w))
    return s.where((F.col("rows") == 0) | (F.col("min_start") <= F.col("_prev_max")))


def in_no_period(labelled: DataFrame, split: str = "split") -> DataFrame:
    """Q7: rows that fall in none of the periods (empty if the periods cover everything)."""
    return labelled.where(F.col(split).isNull())


def verify_pairs(pairs: DataFrame, ends: DataFrame, key: str, start_ts: str, end_ts: str,
                 rows_per_task: int | None = ROWS_PER_TASK) -> DataFrame:
    """Q5, independent of the pairing window: each kept pair's end must be the
    first end at or after its start, i.e. the key's previous distinct end time
    (a lag over the ends alone) lies before the start.  One equi-join on
    (key, end time) - never all pairs of a key.  Returns violating pairs."""
    e = ends.select(key, end_ts).distinct()
    prev = keyed_lag(e, key, [end_ts], [end_ts], ts_micros(e, end_ts), rows_per_task=rows_per_task)
    joined = pairs.join(prev, [key, end_ts], "left")
    return joined.where(F.col(f"prev_{end_ts}").isNotNull() & (F.col(f"prev_{end_ts}") >= F.col(start_ts))
                        | (F.col(end_ts) < F.col(start_ts)))
