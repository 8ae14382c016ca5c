"""Per-key ordered operations that stay bounded when one key is huge.

``split_hot_keys`` gives every row a bucket: 0 for ordinary keys; for a key with
more than ``rows_per_task`` rows, one of about ``ceil(n / rows_per_task)`` time
buckets that follow the key's own time distribution (approximate quantile
cells, split further when needed).  Windows then partition by (key, bucket), so
no task holds much more than ``rows_per_task`` rows of one key - unless a key
piles its rows onto a single timestamp, which no time split can divide.

Everything stays in one plan: the per-key counts are a partial aggregation of
the same input (its upstream exchanges are reused, not recomputed), and the
two small tables are broadcast on a *structural* bound rather than a count:

* hot keys: each has more than ``rows_per_task`` rows, so there are at most
  ``rows / rows_per_task`` of them;
* per-bucket summaries: at most ``2 * nb`` non-empty buckets per hot key, so
  ``sum 2 * (n_k / rows_per_task + 1) <= 4 * rows / rows_per_task``.

With the default 4M rows per task that is <= 1M summary rows per 10^12 input
rows.  Broadcast, they are known before the rows move: where no key is hot the joins fall away
and the rows are shuffled once, and a hot key's rows go to the tasks of their buckets.  With
``broadcast=False`` the planner chooses the joins from sizes, which it overrates: it then shuffles
the rows for every join, a hot key to one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_TASK = 4_000_000
GRID = 256


def _maybe_broadcast(df: DataFrame, broadcast: bool) -> DataFrame:
    return F.broadcast(df) if broadcast else df


def split_hot_keys(df: DataFrame, key: str, micros: Column, rows_per_task: int | None = ROWS_PER_TASK,
                   broadcast: bool = True, grid: int = GRID) -> DataFrame:
    """Input plus ``_b`` (bucket) and ``_hot`` (key is split).

    A hot key with ``n`` rows gets ``nb = ceil(n / rows_per_task)`` buckets that
    follow its own time distribution: approximate time quantiles on a fixed
    ``grid`` give equal-count cells (bursts do not pile up in one bucket); when
    ``nb`` exceeds the grid each cell is cut into equal-width sub-buckets.  The
    bucket is monotone in time, so buckets are contiguous in time order; a key
    has at most ``2 * nb`` buckets."""
    if not rows_per_task:
        return df.withColumns({"_b": F.lit(0).cast("long"), "_hot": F.lit(False)})
    d = df.withColumn("_m", micros)
    counts = (d.groupBy(key).agg(F.count(F.lit(1)).alias("_c"))
              .where(F.col("_c") > F.lit(rows_per_task)))          # <= rows / rows_per_task keys
    qs = [i / grid for i in range(1, grid)]
    hot = (d.join(_maybe_broadcast(counts, broadcast), key)       # rows of hot keys only
           .groupBy(key)
           .agg(F.first("_c").alias("_c"), F.min("_m").alias("_lo"), F.max("_m").alias("_hi"),
                F.percentile_approx("_m", qs, 20 * grid).alias("_bq"))
           .select(key, "_lo", "_hi", "_bq",
                   F.ceil(F.col("_c") / F.lit(float(rows_per_task))).cast("long").alias("_nb")))
    idx = F.size(F.filter("_bq", lambda b: b <= F.col("_m")))   # cell 0 .. grid-1
    edges = F.concat(F.array("_lo"), F.col("_bq"), F.array(F.col("_hi") + 1))
    left = F.get(edges, idx)
    right = F.get(edges, idx + 1)
    sub = F.ceil(F.col("_nb") / F.lit(float(grid)))
    width = (right - left).cast("double")
    inner = F.when(width > 0, F.least(sub - 1, F.floor((F.col("_m") - left).cast("double") * sub / width)))
    coarse = F.floor(idx * F.col("_nb") / F.lit(grid))           # nb <= grid: merge cells
    fine = idx * sub + F.coalesce(inner, F.lit(0))                # nb > grid: split cells
    bucket = F.when(F.col("_nb") <= grid, coarse).otherwise(fine)
    return (d.join(_maybe_broadcast(hot, broadcast), key, "left")
            .withColumns({"_b": F.coalesce(bucket, F.lit(0)).cast("long"), "_hot": F.col("_nb").isNotNull()})
            .drop("_lo", "_hi", "_nb", "_bq", "_m"))


def keyed_lag(df: DataFrame, key: str, order: Sequence[str], cols: Sequence[str], micros: Column,
              prefix: str = "prev_", rows_per_task: int | None = ROWS_PER_TASK,
              broadcast: bool = True) -> DataFrame:
    """``lag(col, 1)`` over ``partitionBy(key).orderBy(order)`` for each of ``cols``
    (``order`` must start with the time that ``micros`` measures and end in a
    unique tie-break), computed over (key, bucket) windows; the first row of a
    hot key's bucket takes the last row of the key's previous non-empty bucket."""
    b = split_hot_keys(df, key, micros, rows_per_task, broadcast=broadcast)
    w = Window.partitionBy(key, "_b").orderBy(*order)
    out = b.select("*", *[F.lag(c).over(w).alias(f"{prefix}{c}") for c in cols],
                   F.lag(F.lit(1)).over(w).isNull().alias("_first"))
    if not rows_per_task:
        return out.drop("_b", "_hot", "_first")
    last = (b.where("_hot").groupBy(key, "_b")
            .agg(F.max(F.struct(*[F.col(o) for o in order], *[F.col(c).alias(f"_v_{c}") for c in cols]))
                 .alias("_last")))
    last = last.select(key, "_b", F.lag("_last").over(Window.partitionBy(key).orderBy("_b")).alias("_pl"))
    out = out.join(_maybe_broadcast(last, broadcast), [key, "_b"], "left")
    out = out.withColumns({f"{prefix}{c}": F.when(F.col("_first") & F.col("_hot"), F.col(f"_pl._v_{c}"))
                           .otherwise(F.col(f"{prefix}{c}")) for c in cols})
    return out.drop("_b", "_hot", "_first", "_pl")
