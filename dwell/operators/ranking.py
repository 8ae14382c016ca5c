"""Global ranks and prefix aggregates without a single-task window.

A ``Window.orderBy`` with no ``partitionBy`` runs in one task.  Instead:

1. range-partition on the total order (``repartitionByRange`` samples its bounds)
   and sort within partitions;
2. cut the lineage with a *reliable* checkpoint, which fixes the sampled bounds
   once (a recomputation after an executor loss cannot move rows between
   partitions) and keeps the range partitioning known to the planner;
3. per-partition totals -> exclusive offsets over at most P rows (broadcast);
4. a partition-local running aggregate plus the partition's offset.

For a global *row number* step 4 needs no window at all:
``monotonically_increasing_id`` is ``(partition << 33) + position`` on the
sorted, checkpointed partitions.

Rank-type statistics over values (PR curves, average ranks, rank preservation)
first aggregate to one row per distinct value, so only distinct values are
range partitioned; a heavy value is a single row there.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable_checkpoint

_POS_MASK = (1 << 33) - 1


def _cols(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


ROWS_PER_RANGE = 1_000_000


def range_sorted(df: DataFrame, order: Sequence[str | Column], partitions: int | None = None) -> DataFrame:
    """Range-partitioned, locally sorted and reliably checkpointed copy of ``df``.

    Without an explicit ``partitions`` the number of ranges follows the data:
    one range per ``ROWS_PER_RANGE`` rows (the input is persisted, counted once
    - a scalar - and then sampled and shuffled from the cache)."""
    from pyspark import StorageLevel
    cols = _cols(order)
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if not partitions:
            n = cached.count()
            partitions = max(1, -(-n // ROWS_PER_RANGE))
        return reliable_checkpoint(cached.repartitionByRange(partitions, *cols).sortWithinPartitions(*cols))
    finally:
        cached.unpersist(blocking=False)


def _offsets(df: DataFrame, aggs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Per-partition totals turned into exclusive offsets plus grand totals
    (a table of at most P rows, broadcast)."""
    parts = df.groupBy("_pid").agg(*[
        (F.sum(c) if how == "sum" else F.max(c)).alias(out) for out, (how, c) in aggs.items()])
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # <= P rows
    whole = Window.partitionBy()  # <= P rows
    cols = []
    for out, (how, _) in aggs.items():
        f = F.sum if how == "sum" else F.max
        off = f(out).over(before)
        cols += [(F.coalesce(off, F.lit(0)) if how == "sum" else off).alias(f"_off_{out}"),
                 f(out).over(whole).alias(f"_tot_{out}")]
    return F.broadcast(parts.select("_pid", *cols))


def global_row_number(df: DataFrame, order: Sequence[str | Column], out: str = "row_number",
                      partitions: int | None = None, total: str | None = None) -> DataFrame:
    """1-based position in the total order ``order`` (include a unique tie-break);
    ``total`` names an optional column carrying the row count."""
    r = range_sorted(df, order, partitions)
    r = r.withColumn("_mid", F.monotonically_increasing_id())
    r = r.withColumns({"_pid": F.shiftright("_mid", 33),
                       "_pos": F.col("_mid").bitwiseAND(F.lit(_POS_MASK))})
    offs = _offsets(r.withColumn("_one", F.lit(1)), {"_n": ("sum", "_one")})
    res = (r.join(offs, "_pid")
           .withColumn(out, F.col("_off__n") + F.col("_pos") + F.lit(1)))
    if total:
        res = res.withColumn(total, F.col("_tot__n"))
    return res.drop("_mid", "_pid", "_pos", "_off__n", "_tot__n")


def prefix_aggregate(df: DataFrame, order: Sequence[str | Column], aggs: Mapping[str, tuple[str, str]],
                     inclusive: bool = True, partitions: int | None = None,
                     totals: bool = False) -> DataFrame:
    """Running ``sum`` / ``max`` of columns along a total order, for every row.

    ``aggs`` maps output name -> ("sum" | "max", input column).  ``order`` must be
    a total order (one row per distinct value is the intended input).  With
    ``totals`` each output also gets ``<out>_total``, the grand total.
    """
    r = range_sorted(df, order, partitions).withColumn("_pid", F.spark_partition_id())
    offs = _offsets(r, aggs)
    frame = (Window.partitionBy("_pid").orderBy(*_cols(order))
             .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    local = r.select("*", *[
        (F.sum(c) if how == "sum" else F.max(c)).over(frame).alias(f"_loc_{out}")
        for out, (how, c) in aggs.items()])
    res = local.join(offs, "_pid")
    cols = {}
    for out, (how, _) in aggs.items():
        loc, off = F.col(f"_loc_{out}"), F.col(f"_off_{out}")
        cols[out] = (F.coalesce(loc, F.lit(0)) + off if how == "sum"
                     else F.greatest(loc, off))  # greatest skips nulls
        if totals:
            cols[f"{out}_total"] = F.col(f"_tot_{out}")
    return res.withColumns(cols).drop("_pid", *[f"_{k}_{o}" for o in aggs for k in ("loc", "off", "tot")])


# ---------------------------------------------------------------------------
# Rank bins (quantile cut of first-appearance ranks)
# ---------------------------------------------------------------------------

def bin_of_rank(rank: Column, n: Column, q: int) -> Column:
    """0-based bin ``max(0, ceil((r-1) q / (n-1)) - 1)`` in exact integer arithmetic;
    a single row is bin 0."""
    num = (rank - 1) * F.lit(q) + n - 2
    return F.when(n <= 1, F.lit(0)).otherwise(
        F.greatest(F.lit(0), F.floor(num / (n - 1)).cast("long") - 1)).cast("int")


def rank_bins(df: DataFrame, value: str, tie: str, q: int = 10, out: str = "bin",
              partitions: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Rank rows by (value, tie) and cut the ranks 1..n into ``q`` equal-count bins
    (0-based ``out``), within each group of ``by`` if given.  Ties in ``value`` are broken by ``tie`` (the
    stand-in for the reference's first-appearance order).

    The rows are not sorted.  Counts of distinct values, summed along the values, tell which value holds
    the first rank of each bin: at most q - 1 cut values a group.  A row beside them gets its bin by
    comparison; only rows that tie with a cut value are ordered, by their tie-break."""
    value_of = df.withColumn("_rb_v", F.col(value))
    keys = list(by)
    counts = value_of.groupBy(*keys, "_rb_v").agg(F.count(F.lit(1)).alias("_rb_c"))
    summed = prefix_aggregate(counts, [*keys, "_rb_v"], {"_rb_end": ("sum", "_rb_c")}, True, partitions)
    summed = summed.withColumn("_rb_from", F.col("_rb_end") - F.col("_rb_c"))
    sizes = summed.groupBy(*keys).agg(F.min("_rb_from").alias("_rb_0"), F.sum("_rb_c").alias("_rb_n"))
    placed = _with_group(summed, sizes, keys)
    # the first rank of bin b is floor(b (n - 1) / q) + 2
    first = lambda b: F.floor(b * (F.col("_rb_n") - 1) / F.lit(q)).cast("long") + 2
    bins = F.filter(F.sequence(F.lit(1), F.lit(max(q - 1, 1))), lambda b: (b < q) & (first(b) > F.col("_rb_from") - F.col("_rb_0")) & (first(b) <= F.col("_rb_end") - F.col("_rb_0")))
    held = placed.select(*keys, F.explode(F.transform(bins, lambda b: F.struct(
        F.col("_rb_v").alias("v"), (F.col("_rb_from") - F.col("_rb_0")).alias("start"), first(b).alias("first")))).alias("_rb_cut"))
    cuts = held.groupBy(*keys).agg(F.collect_list("_rb_cut").alias("_rb_cuts"))  # at most q - 1 a group
    cut = F.coalesce(F.col("_rb_cuts"), F.array().cast(cuts.schema["_rb_cuts"].dataType))
    above = lambda c: F.coalesce(F.col("_rb_v") > c["v"], c["v"].isNull() & F.col("_rb_v").isNotNull())  # noqa: E731  (null first)
    known = _with_group(value_of, cuts, keys).withColumn("_rb_tied", F.filter(cut, lambda c: F.col("_rb_v").eqNullSafe(c["v"])))
    free = known.where(F.size("_rb_tied") == 0).withColumn(out, F.size(F.filter(cut, above)).cast("int"))
    tied = known.where(F.size("_rb_tied") > 0)
    ranked = global_row_number(tied, [*keys, "_rb_v", tie], "_rb_r", partitions)
    starts = ranked.groupBy(*[F.col(k).alias(f"_rb_k{i}") for i, k in enumerate(keys)], F.col("_rb_v").alias("_rb_w")).agg(F.min("_rb_r").alias("_rb_s"))
    same = F.col("_rb_v").eqNullSafe(F.col("_rb_w"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_rb_k{i}"))
    ranked = ranked.join(starts, same)
    rank = F.col("_rb_tied")[0]["start"] + F.col("_rb_r") - F.col("_rb_s") + 1
    bound = ranked.withColumn("_rb_rank", rank).withColumn(out, F.size(F.filter(cut, lambda c: c["first"] <= F.col("_rb_rank"))).cast("int"))
    names = [*[c for c in df.columns if c != out], out]
    return free.select(*names).unionByName(bound.select(*names))


def _with_group(df: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with the columns of ``table``, which has a row a group; without keys, one row."""
    if not keys:
        row = table.select(F.struct(*table.columns).alias("_s")).scalar()
        return df.withColumns({c: row.getField(c) for c in table.columns})
    renamed = table.withColumnsRenamed({k: f"_g_{k}" for k in keys})
    same = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"_g_{k}"))
        same = one if same is None else same & one
    return df.join(renamed, same, "left").drop(*[f"_g_{k}" for k in keys])


# ---------------------------------------------------------------------------
# Precision-recall curve per distinct threshold
# ---------------------------------------------------------------------------

def pr_curve(df: DataFrame, score: str, label: str, partitions: int | None = None) -> DataFrame:
    """One row per distinct score t: flagged = score >= t.  Columns threshold,
    tp, fp, tp_at, fp_at, precision, recall (positives P > 0 assumed for recall)."""
    by = (df.groupBy(F.col(score).alias("threshold"))
          .agg(F.sum(F.col(label).cast("long")).alias("tp_at"),
               F.sum((1 - F.col(label)).cast("long")).alias("fp_at")))
    pre = prefix_aggregate(by, [F.col("threshold").desc()],
                           {"tp": ("sum", "tp_at"), "fp": ("sum", "fp_at")}, True, partitions,
                           totals=True)
    return (pre.withColumns({"precision": F.col("tp") / (F.col("tp") + F.col("fp")),
                             "recall": F.try_divide(F.col("tp"), F.col("tp_total"))})
            .withColumnsRenamed({"tp_total": "positives", "fp_total": "negatives"}))


def threshold_for_recall(curve: DataFrame, target: float) -> DataFrame:
    """Highest threshold whose recall reaches ``target`` (null if none)."""
    return curve.agg(F.max(F.when(F.col("recall") >= F.lit(target), F.col("threshold"))).alias("threshold"))


def threshold_for_precision(curve: DataFrame, target: float) -> DataFrame:
    """Lowest threshold whose precision reaches ``target`` (null if none)."""
    return curve.agg(F.min(F.when(F.col("precision") >= F.lit(target), F.col("threshold"))).alias("threshold"))


# ---------------------------------------------------------------------------
# Average ranks and Spearman correlation
# ---------------------------------------------------------------------------

def average_ranks(df: DataFrame, value: str, out: str = "avg_rank",
                  partitions: int | None = None) -> DataFrame:
    """(value, avg_rank): rank of a tied block = first position + (count - 1) / 2."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_cnt"))
    pre = prefix_aggregate(counts, [value], {"_before": ("sum", "_cnt")}, False, partitions)
    return pre.select(value, (F.col("_before") + (F.col("_cnt") + 1) / 2.0).alias(out))


def spearman(df: DataFrame, a: str, b: str, out: str = "spearman",
             partitions: int | None = None) -> DataFrame:
    """Pearson correlation of the average ranks of ``a`` and ``b``.

    The rows are counted once by (a, b); both columns' ranks follow from sums of these counts, and the
    correlation is that of the counted pairs with their counts as weights.  Rows are neither joined nor sorted."""
    known = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    pair = reliable_checkpoint(known.groupBy(F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count(F.lit(1)).alias("_c")))

    def ranks(col: str, rank: str) -> DataFrame:
        counts = pair.groupBy(col).agg(F.sum("_c").alias("_n"))
        pre = prefix_aggregate(counts, [col], {"_before": ("sum", "_n")}, False, partitions)
        return pre.select(col, (F.col("_before") + (F.col("_n") + 1) / 2.0).alias(rank))

    w, x, y = F.col("_c"), F.col("_ra"), F.col("_rb")
    # ranks of n rows average (n + 1) / 2, so centred sums need no first pass
    mid = (F.col("_all") + 1) / 2.0
    weighted = pair.join(ranks("_a", "_ra"), "_a").join(ranks("_b", "_rb"), "_b")
    weighted = _with_group(weighted, pair.agg(F.sum("_c").alias("_all")), ())
    sums = weighted.agg(F.sum(w * (x - mid) * (y - mid)).alias("xy"), F.sum(w * (x - mid) * (x - mid)).alias("xx"), F.sum(w * (y - mid) * (y - mid)).alias("yy"))
    return sums.select(F.try_divide(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy"))).alias(out))


# ---------------------------------------------------------------------------
# Rank preservation
# ---------------------------------------------------------------------------

def rank_preserving(df: DataFrame, before: str, after: str, out: str = "no_inversions",
                    partitions: int | None = None) -> DataFrame:
    """True iff ``before_i < before_j`` implies ``after_i <= after_j`` up to a
    tolerance of ``1e-9 * max(1, max |after|)``; ties in ``before`` are free."""
    blocks = (df.groupBy(before).agg(F.min(after).alias("_lo"), F.max(after).alias("_hi"))
              .withColumn("_abs", F.greatest(F.abs("_lo"), F.abs("_hi"))))
    pre = prefix_aggregate(blocks, [before], {"_prev_hi": ("max", "_hi"), "_m": ("max", "_abs")},
                           False, partitions, totals=True)
    return (pre.withColumn("_tol", F.lit(1e-9) * F.greatest(F.lit(1.0), F.col("_m_total")))
            .agg(F.coalesce(F.bool_and(F.col("_prev_hi").isNull()
                                       | (F.col("_lo") - F.col("_prev_hi") >= -F.col("_tol"))),
                            F.lit(True)).alias(out)))


# ---------------------------------------------------------------------------
# Exact quantiles from sorted value counts (no per-group value map)
# ---------------------------------------------------------------------------

def group_quantiles(df: DataFrame, value: str | Column, qs: Sequence[float], names: Sequence[str],
                    by: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """Exact, linearly interpolated quantiles of ``value`` per group of ``by``
    (the whole frame when ``by`` is empty) - the same numbers as NumPy's default
    / SQL ``quantile_cont``.

    Spark's exact ``percentile`` keeps every distinct value of a group in one
    map in one task; here rows are first counted per (group, value) with a
    partial aggregation, so a heavy value is one row and no tie-break is needed.
    Only these counts are sorted by range and summed along the order; a value
    holds the ranks from its running sum on, and the values that hold an
    interpolation position are picked in one aggregate.  Output: ``by`` columns
    plus ``names``; nulls/NaN are ignored; a group with no values gets no row."""
    v = F.col(value) if isinstance(value, str) else value
    g = F.struct(*[F.col(b) for b in by]) if by else F.lit(0)
    d = df.select(g.alias("_gq_g"), v.cast("double").alias("_gq_v")).where(F.col("_gq_v").isNotNull() & ~F.isnan("_gq_v"))
    counts = d.groupBy("_gq_g", "_gq_v").agg(F.count(F.lit(1)).alias("_gq_c"))
    ranked = prefix_aggregate(counts, ["_gq_g", "_gq_v"], {"_gq_end": ("sum", "_gq_c")}, True, partitions)
    ranked = ranked.withColumn("_gq_start", F.col("_gq_end") - F.col("_gq_c"))
    groups = ranked.groupBy(F.col("_gq_g").alias("_gq_h")).agg(F.min("_gq_start").alias("_gq_first"), F.sum("_gq_c").alias("_gq_n"))
    held = ranked.join(groups, F.col("_gq_g").eqNullSafe(F.col("_gq_h")))
    cols = []
    for q, name in zip(qs, names):
        h = (F.col("_gq_n") - 1).cast("double") * F.lit(float(q))

        def at(rank: Column) -> Column:
            r = F.col("_gq_first") + rank.cast("long")
            return F.max(F.when((F.col("_gq_start") <= r) & (r < F.col("_gq_end")), F.col("_gq_v")))
        lo_v, hi_v, frac = at(F.floor(h)), at(F.ceil(h)), F.first(h - F.floor(h))
        cols.append((lo_v + frac * (hi_v - lo_v)).alias(name))
    out = held.groupBy("_gq_g").agg(*cols)
    return out.select(*[F.col(f"_gq_g.{b}").alias(b) for b in by], *names) if by else out.select(*names)
