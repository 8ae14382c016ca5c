"""Descriptive statistics over durations and levels.

Quantiles are exact by default and computed by one distributed sort
(:func:`dwell.operators.ranking.group_quantiles`) - never by a per-group map of
every distinct value, which would put a hot group's values into one task.
Pass ``accuracy`` to use ``percentile_approx`` (bounded sketch) instead.
Shares use a window over the *aggregated* level table (one row per level),
never over raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import age_band, has_offset
from . import ranking

QSpec = tuple  # (value column or name, [q, ...], [output name, ...])


def quantile(col: str | Column, q: float | Sequence[float], accuracy: int) -> Column:
    """Approximate quantile aggregate (bounded memory sketch)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.percentile_approx(c, q if isinstance(q, float) else list(q), accuracy)


def _join_on_groups(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    if not by:  # one row: a scalar subquery, not a join
        s = right.select(F.struct(*right.columns).alias("_s")).scalar()
        return left.withColumns({c: s.getField(c) for c in right.columns})
    r = right.select(*[F.col(b).alias(f"_qb_{i}") for i, b in enumerate(by)],
                     *[c for c in right.columns if c not in by])
    cond = [left[b].eqNullSafe(r[f"_qb_{i}"]) for i, b in enumerate(by)]
    return left.join(r, cond, "left").drop(*[f"_qb_{i}" for i in range(len(by))])


def grouped_with_quantiles(df: DataFrame, by: Sequence[str], aggs: Sequence[Column],
                           specs: Sequence[QSpec], accuracy: int | None = None) -> DataFrame:
    """``df.groupBy(by).agg(aggs)`` plus quantile columns: exact via one sort per
    value column, or ``percentile_approx`` when ``accuracy`` is given."""
    if accuracy:
        extra = [quantile(v, q, accuracy).alias(n) for v, qs, names in specs for q, n in zip(qs, names)]
        return (df.groupBy(*by).agg(*aggs, *extra) if by else df.agg(*aggs, *extra))
    out = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    for v, qs, names in specs:
        out = _join_on_groups(out, ranking.group_quantiles(df, v, qs, names, by), by)
    return out


def duration_stats(df: DataFrame, col: str = "duration_days", accuracy: int | None = None) -> DataFrame:
    """A1: one row - n, mean, median, p90, p99, min, max, sample std."""
    out = grouped_with_quantiles(
        df, [], [F.count(col).alias("n"), F.avg(col).alias("mean_days"), F.min(col).alias("min_days"),
                 F.max(col).alias("max_days"), F.stddev_samp(col).alias("std_days")],
        [(col, [0.5, 0.9, 0.99], ["median_days", "p90_days", "p99_days"])], accuracy)
    return out.select("n", "mean_days", "median_days", "p90_days", "p99_days", "min_days", "max_days", "std_days")


def _with_share(levels: DataFrame, rows: DataFrame, n: str = "n") -> DataFrame:
    """share = n / all rows; the total is a partial-aggregated count of the
    input attached as a scalar subquery (no window over the levels)."""
    total = rows.agg(F.count(F.lit(1)).alias("_total")).select("_total").scalar()
    return levels.withColumn("share", F.col(n) / total)


def level_counts(df: DataFrame, level: str, col: str = "duration_days",
                 accuracy: int | None = None) -> DataFrame:
    """A2: every level including null: n, share, median duration."""
    d = df.withColumn("value", F.col(level))
    lv = grouped_with_quantiles(d, ["value"], [F.count(F.lit(1)).alias("n")],
                                [(col, [0.5], ["median_days"])], accuracy)
    return _with_share(lv, df)


def top_levels(df: DataFrame, level: str, n: int = 30, col: str = "duration_days",
               accuracy: int | None = None) -> DataFrame:
    """A3: the ``n`` most frequent levels (ties by value) with median duration."""
    return level_counts(df, level, col, accuracy).orderBy(F.col("n").desc(), F.col("value")).limit(n)


def missingness(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """A4: (column, nulls, rate) for the columns that have any null; one pass."""
    cols = list(cols or df.columns)
    row = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = row.unpivot("_n", cols, "column", "nulls")
    return (long.where(F.col("nulls") > 0)
            .select("column", "nulls", (F.col("nulls") / F.col("_n")).alias("rate")))


def flag_contrast(df: DataFrame, flag_col: Column, loose_col: Column | None = None,
                  col: str = "duration_days", accuracy: int | None = None) -> DataFrame:
    """A5: n, share, median for flag true vs false (+ the looser count)."""
    d = df.withColumn("flag", F.coalesce(flag_col, F.lit(False)))
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.count_if(loose_col).alias("loose_n")] if loose_col is not None else [])
    out = grouped_with_quantiles(d, ["flag"], aggs, [(col, [0.5], ["median_days"])], accuracy)
    return _with_share(out, df)


def offset_count(df: DataFrame, text_col: str) -> DataFrame:
    """Raw timestamps carrying a zone suffix."""
    return df.agg(F.count_if(has_offset(text_col)).alias("offset_rows"))


def source_profile(df: DataFrame, ts_text: str, parsed: Column) -> DataFrame:
    """S3: rows, min/max parsed time, parseable and offset-bearing counts."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.min(parsed).alias("min_ts"),
                  F.max(parsed).alias("max_ts"), F.count(parsed).alias("parseable"),
                  F.count_if(has_offset(ts_text)).alias("with_offset"),
                  F.lit(len(df.columns)).alias("columns"))


def censoring_horizon(df: DataFrame, end_ts: str = "end_ts") -> DataFrame:
    """The latest end time; starts close to it are right-censored."""
    return df.agg(F.max(end_ts).alias("censoring_horizon"))


def year_span(df: DataFrame, ts: str = "start_ts") -> DataFrame:
    """Whole days between first and last start, in years of 365.25 days."""
    seconds = F.timestamp_diff("SECOND", F.min(ts), F.max(ts))
    return df.agg((F.floor(seconds / F.lit(86400)) / F.lit(365.25)).alias("years_covered"))


def level_range(levels: DataFrame, value: str = "median_days") -> DataFrame:
    """Min / max of a per-level statistic and their ratio."""
    return levels.agg(F.min(value).alias("min_value"), F.max(value).alias("max_value")).withColumn(
        "max_over_min", F.try_divide(F.col("max_value"), F.col("min_value")))


def worst_predictions(df: DataFrame, y: str, y_pred: str, n: int = 50, tie: str | None = None,
                      age_col: str | None = None) -> DataFrame:
    """The ``n`` largest absolute errors (a top-k: ``TakeOrderedAndProject``)."""
    out = df.withColumns({
        "predicted_days": F.col(y_pred).cast("double"),
        "absolute_error_days": F.abs(F.col(y_pred) - F.col(y)),
        "signed_error_days": F.col(y_pred) - F.col(y)})
    if age_col:
        out = out.withColumn("age_bucket", age_band(age_col))
    order = [F.col("absolute_error_days").desc()] + ([F.col(tie)] if tie else [])
    return out.orderBy(*order).limit(n)


def top_bottom(levels: DataFrame, by: str, value: str, part: str | None = None, k: int = 3) -> DataFrame:
    """Rank levels both ways (``top_rank``, ``bottom_rank``) within ``part``; keep
    the k best and k worst.  Ties: value ascending first in the top list."""
    w = Window.partitionBy(part) if part else Window.partitionBy()
    top = w.orderBy(F.col(by).desc(), F.col(value))
    bottom = w.orderBy(F.col(by), F.col(value).desc())
    return (levels.withColumns({"top_rank": F.row_number().over(top),
                                "bottom_rank": F.row_number().over(bottom)})
            .where((F.col("top_rank") <= k) | (F.col("bottom_rank") <= k)))


def sample_rows(df: DataFrame, n: int, seed: int, key: Sequence[str]) -> DataFrame:
    """T5: repeatable sample of ``n`` rows: the first by the MD5 of their key and the seed."""
    return df.orderBy(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key], F.lit(str(seed)))), *key).limit(n)
