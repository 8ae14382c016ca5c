"""Temporal split (P9), its summary (A6) and the union back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _day(s: str) -> dt.date:
    return dt.date.fromisoformat(s)


def split_label(ts: str, train_end: str, val_start: str, val_end: str, test_start: str):
    """Column naming the period of ``ts``; end dates cover their whole day
    (``t < end + 1 day``); test is unbounded above; gaps -> null."""
    te, vs, ve, ts0 = map(_day, (train_end, val_start, val_end, test_start))
    if not (te < vs <= ve < ts0):
        raise ValueError("split dates must satisfy train_end < val_start <= val_end < test_start")
    lit = lambda d: F.lit(dt.datetime.combine(d, dt.time())).cast("timestamp_ntz")
    t = F.col(ts)
    one = dt.timedelta(days=1)
    return (F.when(t < lit(te + one), F.lit("train"))
            .when((t >= lit(vs)) & (t < lit(ve + one)), F.lit("validation"))
            .when(t >= lit(ts0), F.lit("test")))


def temporal_split(df: DataFrame, ts: str, train_end: str, val_start: str, val_end: str,
                   test_start: str, out: str = "split") -> DataFrame:
    """P9 as one labelled frame (one scan); filter on ``out`` for a period.  With
    the frame partitioned by start year on disk the period filters prune files."""
    return df.withColumn(out, split_label(ts, train_end, val_start, val_end, test_start))


def periods(df: DataFrame, ts: str, train_end: str, val_start: str, val_end: str,
            test_start: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    lab = temporal_split(df, ts, train_end, val_start, val_end, test_start, "_split")
    return tuple(lab.where(F.col("_split") == p).drop("_split") for p in ("train", "validation", "test"))


def split_summary(df: DataFrame, ts: str, train_end: str, val_start: str, val_end: str,
                  test_start: str) -> DataFrame:
    """Rows and first / last start per period (periods with no rows show 0)."""
    lab = temporal_split(df, ts, train_end, val_start, val_end, test_start)
    got = lab.where(F.col("split").isNotNull()).groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.min(ts).alias("min_start"), F.max(ts).alias("max_start"))
    names = df.sparkSession.createDataFrame([("train",), ("validation",), ("test",)], "split string")
    return names.join(got, "split", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))


def union_splits(*parts: DataFrame) -> DataFrame:
    """U1."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
