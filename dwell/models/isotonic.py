"""Isotonic calibration (M8): the monotone map from a score to its observed rate, by pooling
adjacent violators over range partitions.

Points are first one weighted row per distinct score.  Pools may be merged in any order: whatever
neighbours violate are pooled, and the end is the same.  So each range pools its own points with a stack,
and what may still violate are neighbours across ranges.  The pools that are left are dealt to new ranges,
shifted by half a range, until a pass merges nothing and no neighbours across ranges violate.  The driver
sees two means a range; scores and pools stay in the partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ranking
from ..session import reliable_checkpoint

#: Pools of a range.
RANGE_POOLS = 1_000_000
_SCHEMA = "part long, low double, high double, total double, weight double"


def pool(low: np.ndarray, high: np.ndarray, total: np.ndarray, weight: np.ndarray) -> list[tuple[float, float, float, float]]:
    """Pooled neighbours in order: a pool joins the one before while its mean is not greater."""
    stack: list[tuple[float, float, float, float]] = []
    for a, b, t, w in zip(low.tolist(), high.tolist(), total.tolist(), weight.tolist()):
        while stack and stack[-1][2] * w >= t * stack[-1][3]:
            a, _, t0, w0 = stack.pop()
            t, w = t + t0, w + w0
        stack.append((a, b, t, w))
    return stack


def _pooled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pools of each part; a part's rows come together and in order, and one part is held at a time."""
    def of(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for part, x in pdf.groupby("part", sort=False):
            rows = pool(*(x[c].to_numpy() for c in ("low", "high", "total", "weight")))
            yield pd.DataFrame([(part, *r) for r in rows], columns=["part", "low", "high", "total", "weight"])

    rest = None
    for pdf in batches:
        if len(pdf):
            pdf = pdf if rest is None else pd.concat([rest, pdf])
            last = pdf["part"].iloc[-1]
            yield from of(pdf[pdf["part"] != last])
            rest = pdf[pdf["part"] == last]
    if rest is not None:
        yield from of(rest)


@dataclass
class Isotonic:
    """Pools as a table (low, high, rate), in order of score."""

    pools: DataFrame

    def calibrate(self, df: DataFrame, score: str, out: str = "calibrated") -> DataFrame:
        """The rate of a score's pool; between two pools on the line between them, outside the first or
        last one's.  Up to RANGE_POOLS pools are shared with all tasks; there is one a merged stretch
        of scores, so more would need that many steps in the rates."""
        if self.pools.limit(RANGE_POOLS + 1).count() > RANGE_POOLS:
            raise ValueError(f"more than {RANGE_POOLS} pools: bin the scores first")
        rows = self.pools.collect()  # at most RANGE_POOLS
        if not rows:
            return df.withColumn(out, F.lit(None).cast("double"))
        x = np.array([v for r in sorted(rows, key=lambda r: r["low"]) for v in (r["low"], r["high"])])
        y = np.array([v for r in sorted(rows, key=lambda r: r["low"]) for v in (r["rate"], r["rate"])])
        shared = df.sparkSession.sparkContext.broadcast((x, y))

        @F.pandas_udf("double")
        def calibrated(s: pd.Series) -> pd.Series:
            v = s.to_numpy(dtype=np.float64, na_value=np.nan)
            return pd.Series(np.where(np.isnan(v), np.nan, np.interp(v, *shared.value)))

        return df.withColumn(out, F.nanvl(calibrated(F.col(score).cast("double")), F.lit(None).cast("double")))


def fit_isotonic(scored: DataFrame, score: str, label: str, range_pools: int = RANGE_POOLS) -> Isotonic:
    """Fitted on the rows whose score and label are known; no rows give no pools."""
    known = scored.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(label).isNotNull())
    points = known.groupBy(F.col(score).cast("double").alias("low")).agg(F.sum(F.col(label).cast("double")).alias("total"), F.count(F.lit(1)).cast("double").alias("weight"))
    shift = 0
    pools = points.select("low", F.col("low").alias("high"), "total", "weight")
    while True:
        # the rank of a pool, dealt to ranges whose bounds move by half a range from pass to pass
        ranked = ranking.global_row_number(pools, ["low"], "_r")
        dealt = ranked.withColumn("part", F.floor((F.col("_r") - 1 + F.lit(shift)) / F.lit(range_pools)))
        dealt = dealt.select("part", "low", "high", "total", "weight").repartition("part").sortWithinPartitions("part", "low")
        pools = reliable_checkpoint(dealt.mapInPandas(_pooled, _SCHEMA))
        ends = pools.groupBy("part").agg(F.min(F.struct("low", (F.col("total") / F.col("weight")).alias("rate"))).alias("first"),
                                         F.max(F.struct("low", (F.col("total") / F.col("weight")).alias("rate"))).alias("last")).orderBy("part").collect()  # a row a range
        if all(a["last"]["rate"] < b["first"]["rate"] for a, b in zip(ends, ends[1:])):
            return Isotonic(pools.select("low", "high", (F.col("total") / F.col("weight")).alias("rate")))
        shift = 0 if shift else range_pools // 2
