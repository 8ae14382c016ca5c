"""Risk scoring for batch (R1) and streaming (R2) frames.

The row-wise part - enrichment, the whitelist gate, probability, risk band, day
estimate and band, group reliability - is stateless, so the same function runs
on a streaming DataFrame in append mode.  Ranking (T2) needs a whole batch: it runs,
with the drivers (M11), in :func:`score_batch`, and on a stream through
``foreachBatch`` (:func:`start_scoring`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clip_days, day_estimate_caveat, enrich, reliability_message, risk_band, wall_clock
from ..models.explain import drivers
from ..models.train import QUANTILES, Bundle, in_days, predict_raw
from ..operators.lookup import attach_reliability


def enrich_records(raw: DataFrame, ts_text: str | None = None, name: str | None = None,
                   age_text: str | None = None, breed: str | None = None, color: str | None = None,
                   sex: str | None = None, out_ts: str = "start_ts") -> DataFrame:
    """Raw start records (all text, every field optional) -> the same engineered
    features as training (F20).  A missing or unparseable start time falls back
    to the processing time, as on a live feed.  Works on streaming frames."""
    ts = (F.coalesce(wall_clock(ts_text), F.current_timestamp().cast("timestamp_ntz")) if ts_text
          else F.current_timestamp().cast("timestamp_ntz"))
    return enrich(raw.withColumn(out_ts, ts), out_ts, name=name, age_text=age_text, breed=breed,
                  color=color, sex=sex)


def score_rows(df: DataFrame, bundle: Bundle, id_col: str, passthrough: Sequence[str] = (),
               group_col: str | None = None, reliability: DataFrame | None = None) -> DataFrame:
    """R2 core: per-row columns only (stateless).  The incoming frame passes the gate (P7): every column is
    the id, a feature, the group or named in ``passthrough``.  Beside each day estimate stands its caveat."""
    keep = [id_col, *passthrough, *([group_col] if group_col and group_col not in passthrough else [])]
    names = {"classifier": "probability"} | ({"days": "estimated_days"} if "days" in bundle.models else {})
    quantiles = all(q in bundle.models for q in QUANTILES)
    x = predict_raw(df, bundle, names | ({q: q for q in QUANTILES} if quantiles else {}), keep)
    if "days" in bundle.models:
        x = x.withColumns({"estimated_days": clip_days("estimated_days"), "estimate_caveat": day_estimate_caveat(bundle.r2)})
    if quantiles:
        x = in_days(x)
    x = x.withColumn("risk_band", risk_band("probability"))
    if group_col and reliability is not None:
        x = attach_reliability(x, group_col, reliability)
        x = x.withColumn("reliability_note", reliability_message(
            group_col, "reliable", "lift", "pr_auc", "base_rate", "min_lift"))
    return x


def score_batch(df: DataFrame, bundle: Bundle, id_col: str, passthrough: Sequence[str] = (),
                group_col: str | None = None, reliability: DataFrame | None = None,
                with_drivers: bool = True, top: int | None = None) -> DataFrame:
    """Row-wise scores, per-row drivers, whole batch ranked by risk (T2; a global sort is range
    partitioned; ``top`` keeps a top-k report).  A raw record that rides along in ``passthrough`` (J9)
    stays on its row."""
    rows = score_rows(df, bundle, id_col, passthrough, group_col, reliability)
    if with_drivers:
        rows = drivers(rows, bundle.models["classifier"], bundle.spec.allowed, bundle.reference_row or {})
    ranked = rows.drop(*[c for c in bundle.spec.allowed if c not in passthrough and c != group_col]).orderBy(F.col("probability").desc(), F.col(id_col))
    return ranked.limit(top) if top else ranked


def write_batch(scored: DataFrame, sink_path: str, batch_id: int) -> None:
    """One micro-batch as the partition ``batch_id=N`` of a Parquet table.  A batch that the stream
    replays after a failure overwrites its own folder, so no row is written twice."""
    scored.write.mode("overwrite").parquet(f"{sink_path.rstrip('/')}/batch_id={batch_id}")


def start_scoring(stream: DataFrame, bundle: Bundle, id_col: str, sink_path: str, checkpoint: str,
                  passthrough: Sequence[str] = (), group_col: str | None = None,
                  reliability: DataFrame | None = None, available_now: bool = True):
    """R2 with drivers: each micro-batch is scored as a batch and written under its number
    (:func:`write_batch`), which the stream checkpoint repeats on a replay."""
    def each(batch: DataFrame, batch_id: int) -> None:
        write_batch(score_batch(batch, bundle, id_col, passthrough, group_col, reliability), sink_path, batch_id)

    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()
