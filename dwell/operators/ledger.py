"""Drop ledger (P12): where every removed row went, in one aggregate per side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pairing import STATUS_CLAIMED, STATUS_UNMATCHED

STEPS = [
    ("start unusable", "missing key or unparseable start time"),
    ("end unusable", "missing key or unparseable end time"),
    ("no matching end", "start has no end at or after it"),
    ("end already claimed", "two starts reached one end; the later start kept"),
    ("negative duration", "duration below the lower bound"),
    ("duration over cap", "duration above the upper bound"),
]


def ledger(raw_starts: DataFrame, raw_ends: DataFrame, status: DataFrame, key: str, start_ts: str,
           end_ts: str, duration: str = "duration_days", lo: float = 0.0, hi: float = 365.0) -> DataFrame:
    """(step, dropped, reason, position).

    ``raw_starts`` / ``raw_ends`` are the prepared sides *before* null removal;
    ``status`` is :func:`dwell.operators.pairing.pair_status` with a duration."""
    s = raw_starts.agg(F.count_if(F.col(key).isNull() | F.col(start_ts).isNull()).alias("v"))
    e = raw_ends.agg(F.count_if(F.col(key).isNull() | F.col(end_ts).isNull()).alias("v"))
    d = F.col(duration)
    st = status.agg(
        F.count_if(F.col("pair_status") == STATUS_UNMATCHED).alias("u"),
        F.count_if(F.col("pair_status") == STATUS_CLAIMED).alias("c"),
        F.count_if(d < lo).alias("neg"),
        F.count_if(d > hi).alias("over"))
    parts = [s.select(F.lit(0).alias("position"), F.col("v").alias("dropped")),
             e.select(F.lit(1).alias("position"), F.col("v").alias("dropped")),
             st.selectExpr("stack(4, 2, u, 3, c, 4, neg, 5, over) AS (position, dropped)")]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    names = F.create_map(*[x for i, (n, _) in enumerate(STEPS) for x in (F.lit(i), F.lit(n))])
    reasons = F.create_map(*[x for i, (_, r) in enumerate(STEPS) for x in (F.lit(i), F.lit(r))])
    return out.select(names[F.col("position")].alias("step"), F.col("dropped").cast("long").alias("dropped"),
                      reasons[F.col("position")].alias("reason"), F.col("position").cast("int").alias("position"))
