"""Start/end event pairing (forward as-of join by key) and its preparation steps.

Semantics (J1 + J2): every start takes the first end of the same key at or after
it (exact time allowed).  An end settles one start only: among the starts that
reach the same end the latest wins (ties: the larger ``seq``, i.e. later in
source order); the others are "already claimed".  Starts with no end at or after
them are "unmatched".

Spark plan.  Both sides are unioned and ordered per key in *merged order*
``(ts, side, seq)`` with starts (side 0) before ends (side 1) at equal times.
Then a start is paired exactly when the event right after it is an end, and the
pair's end time is that event's time.  We evaluate everything with one window in
*reversed* merged order, so the only frames are ``lag(1)`` and a running
``min`` (both O(n); an ``unboundedFollowing`` frame would be re-evaluated per
row).  That is one shuffle, keyed by ``(key, bucket)``.

Skew.  A key may hold a large share of all rows.  A partial aggregation in the
same plan counts rows per key; keys above ``rows_per_task`` are split into about
``ceil(n / rows_per_task)`` time buckets that follow the key's own time
distribution (see :mod:`dwell.operators.keyed`), so the window groups stay
bounded.  The first event (and first end) of the *following* buckets of a hot
key comes from a summary with one row per (hot key, bucket): at most
``4 * rows / rows_per_task`` rows, the proven bound that lets it be broadcast.
So are the hot keys: they are found first, and the events are then shuffled once,
with their buckets, instead of once for each step that reads them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip, wall_clock
from .keyed import ROWS_PER_TASK, split_hot_keys

START, END = 0, 1
STATUS_PAIRED = "paired"
STATUS_CLAIMED = "already claimed"
STATUS_UNMATCHED = "unmatched"

_EPOCH_NTZ = "1970-01-01 00:00:00"


def ts_micros(df: DataFrame, col: str) -> Column:
    """Exact microseconds since the epoch, monotone in the column's own order."""
    dtype = df.schema[col].dataType
    if isinstance(dtype, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit(_EPOCH_NTZ).cast("timestamp_ntz"), F.col(col))
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(F.col(col))
    if isinstance(dtype, T.DateType):
        return F.unix_date(F.col(col)).cast("long") * F.lit(86_400_000_000)
    return F.col(col).cast("long")


# ---------------------------------------------------------------------------
# Preparation, duration, range filter
# ---------------------------------------------------------------------------

def prepare_starts(raw: DataFrame, key: str, ts_text: str, ts_out: str,
                   keep: Sequence[str] = (), optional: Sequence[str] = (),
                   key_out: str | None = None) -> DataFrame:
    """Trim the key, parse the wall-clock timestamp, keep listed columns;
    optional columns missing from ``raw`` become typed nulls.  Rows with a null
    (or blank) key or unparseable time are removed (count them with
    :func:`dwell.operators.ledger.unusable_count`)."""
    key_out = key_out or key
    cols = [F.nullif(strip(F.col(key).cast("string")), F.lit("")).alias(key_out),
            _parse_ts(raw, ts_text).alias(ts_out)]
    cols += [F.col(c) for c in keep]
    cols += [(F.col(c) if c in raw.columns else F.lit(None).cast("string")).alias(c) for c in optional]
    return drop_missing(raw.select(*cols), [key_out, ts_out])


def prepare_ends(raw: DataFrame, key: str, ts_text: str, ts_out: str,
                 key_out: str | None = None) -> DataFrame:
    """Exactly two columns leave this function (structural leakage guard);
    Catalyst prunes every other column out of the scan."""
    key_out = key_out or key
    out = raw.select(F.nullif(strip(F.col(key).cast("string")), F.lit("")).alias(key_out),
                     _parse_ts(raw, ts_text).alias(ts_out))
    return drop_missing(out, [key_out, ts_out])


def _parse_ts(raw: DataFrame, col: str) -> Column:
    dtype = raw.schema[col].dataType
    if isinstance(dtype, T.StringType):
        return wall_clock(F.col(col))
    if isinstance(dtype, T.TimestampType):
        return F.col(col).cast("timestamp_ntz")
    return F.col(col)


def drop_missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Remove rows with a null in any of ``cols``."""
    return df.na.drop(subset=list(cols))


def duration_days(start: str | Column, end: str | Column) -> Column:
    """(end - start) in days as a double, exact to the microsecond."""
    s = F.col(start) if isinstance(start, str) else start
    e = F.col(end) if isinstance(end, str) else end
    return F.timestamp_diff("MICROSECOND", s, e).cast("double") / F.lit(86_400_000_000.0)


def with_duration(df: DataFrame, start: str, end: str, out: str = "duration_days") -> DataFrame:
    return df.withColumn(out, duration_days(start, end))


def filter_duration(df: DataFrame, col: str = "duration_days", lo: float = 0.0,
                    hi: float = 365.0) -> DataFrame:
    """P5: inclusive range on both ends."""
    return df.where(F.col(col).between(F.lit(lo), F.lit(hi)))


# ---------------------------------------------------------------------------
# The pairing itself
# ---------------------------------------------------------------------------

def pair_status(starts: DataFrame, ends: DataFrame, key: str, start_ts: str, end_ts: str,
                seq: str | None = None, end_seq: str | None = None,
                end_payload: Sequence[str] = (), rows_per_task: int | None = ROWS_PER_TASK,
                broadcast: bool = True) -> DataFrame:
    """Every usable start with its pairing outcome.

    Returns the start columns plus ``end_ts`` (the paired end, null unless
    paired), ``next_end_ts`` (first end at or after the start, before the claim
    rule), the ``end_payload`` columns of the paired end, and ``pair_status`` in
    {paired, already claimed, unmatched}.  One plan, one shuffle of the events
    by (key, bucket); see :mod:`dwell.operators.keyed` for the hot-key split.
    """
    start_cols = list(starts.columns)
    s = starts.where(F.col(key).isNotNull() & F.col(start_ts).isNotNull())
    e = ends.where(F.col(key).isNotNull() & F.col(end_ts).isNotNull())

    seq_col = F.col(seq) if seq else F.xxhash64(*[F.col(c) for c in start_cols])
    end_seq_col = F.col(end_seq).cast("long") if end_seq else F.lit(None).cast("long")
    payload_type = T.StructType([e.schema[c] for c in end_payload]) if end_payload else None
    with_payload = bool(end_payload)

    s_u = s.select(F.col(key).alias("_k"), F.col(start_ts).alias("_t"), F.lit(START).alias("_side"),
                   seq_col.cast("long").alias("_seq"), ts_micros(s, start_ts).alias("_m"),
                   F.struct(*[F.col(c) for c in start_cols]).alias("_s"),
                   *([F.lit(None).cast(payload_type).alias("_e")] if with_payload else []))
    e_u = e.select(F.col(key).alias("_k"), F.col(end_ts).alias("_t"), F.lit(END).alias("_side"),
                   end_seq_col.alias("_seq"), ts_micros(e, end_ts).alias("_m"),
                   F.lit(None).cast(s_u.schema["_s"].dataType).alias("_s"),
                   *([F.struct(*[F.col(c) for c in end_payload]).alias("_e")] if with_payload else []))
    u = split_hot_keys(s_u.unionByName(e_u), "_k", F.col("_m"), rows_per_task, broadcast)

    # reversed merged order: the row just *before* a start is the event just *after* it
    rev = Window.partitionBy("_k", "_b").orderBy(F.col("_t").desc(), F.col("_side").desc(),
                                                 F.col("_seq").desc_nulls_last())
    running = rev.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end_t = F.when(F.col("_side") == END, F.col("_t"))
    w = u.select("*",
                 F.lag("_side").over(rev).alias("_nside"),
                 F.lag("_t").over(rev).alias("_nt"),
                 F.min(end_t).over(running).alias("_nend"),
                 *([F.lag("_e").over(rev).alias("_ne")] if with_payload else [])
                 ).where(F.col("_side") == START)

    if rows_per_task:
        # first event and earliest end of each later bucket of a hot key (bounded table)
        first = F.min(F.struct("_t", "_side", F.col("_seq"), *(["_e"] if with_payload else []))).alias("_first")
        summ = u.where("_hot").groupBy("_k", "_b").agg(first, F.min(end_t).alias("_bend"))
        by_bucket = Window.partitionBy("_k").orderBy(F.col("_b").desc())
        summ = summ.select(
            "_k", "_b",
            F.lag("_first").over(by_bucket).alias("_fx"),
            F.min("_bend").over(by_bucket.rowsBetween(Window.unboundedPreceding, -1)).alias("_fend"))
        w = w.join(F.broadcast(summ) if broadcast else summ, ["_k", "_b"], "left")
        gap = F.col("_nside").isNull() & F.col("_hot")
        w = w.withColumns({
            "_nside": F.when(gap, F.col("_fx._side")).otherwise(F.col("_nside")),
            "_nt": F.when(gap, F.col("_fx._t")).otherwise(F.col("_nt")),
            "_nend": F.coalesce("_nend", "_fend"),
            **({"_ne": F.when(gap, F.col("_fx._e")).otherwise(F.col("_ne"))} if with_payload else {})})

    paired = F.col("_nside") == F.lit(END)
    status = (F.when(paired, F.lit(STATUS_PAIRED))
              .when(F.col("_nend").isNotNull(), F.lit(STATUS_CLAIMED))
              .otherwise(F.lit(STATUS_UNMATCHED)))
    out = [F.col(f"_s.{c}").alias(c) for c in start_cols]
    out += [F.when(paired, F.col("_nt")).alias(end_ts),
            F.col("_nend").alias("next_end_ts")]
    out += [F.when(paired, F.col(f"_ne.{c}")).alias(c) for c in end_payload]
    out += [status.alias("pair_status")]
    return w.select(*out)


def pair_next(starts: DataFrame, ends: DataFrame, key: str, start_ts: str, end_ts: str,
              seq: str | None = None, **kw) -> DataFrame:
    """J1 + J2: paired starts only, each with its end time."""
    return (pair_status(starts, ends, key, start_ts, end_ts, seq=seq, **kw)
            .where(F.col("pair_status") == STATUS_PAIRED)
            .drop("pair_status", "next_end_ts"))


def pair_next_with_payload(starts: DataFrame, ends: DataFrame, key: str, start_ts: str,
                           end_ts: str, payload: Sequence[str], seq: str | None = None,
                           end_seq: str | None = None, **kw) -> DataFrame:
    """As :func:`pair_next`, but the end's descriptive columns come along; on
    equal end times the first end in source order (smallest ``end_seq``) wins."""
    return (pair_status(starts, ends, key, start_ts, end_ts, seq=seq, end_seq=end_seq,
                        end_payload=payload, **kw)
            .where(F.col("pair_status") == STATUS_PAIRED)
            .drop("pair_status", "next_end_ts"))
