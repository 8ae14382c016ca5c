"""Equi-join lookups (J4-J10).  Every lookup table here is an aggregate whose
size is bounded by a parameter (cells, levels, groups, features); the planner
chooses the join from the sizes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clip_days


def group_median_table(df: DataFrame, keys: Sequence[str], y: str) -> DataFrame:
    """Exact median and n per cell of ``keys`` (sort-based, no value map)."""
    from .stats import grouped_with_quantiles
    return grouped_with_quantiles(df, list(keys), [F.count(F.lit(1)).alias("cell_n")],
                                  [(y, [0.5], ["cell_median"])])


def lookup_with_fallback(df: DataFrame, table: DataFrame, keys: Sequence[str], value: str,
                         default: Column, out: str, lo: float = 0.0, hi: float = 365.0) -> DataFrame:
    """Left lookup of a cell value; unseen cell -> ``default``; then clipped."""
    t = table.select(*keys, F.col(value).alias("_v"))
    return df.join(t, list(keys), "left").withColumn(
        out, clip_days(F.coalesce(F.col("_v"), default), lo, hi)).drop("_v")


def unseen_cell_rate(df: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of rows whose cell is absent from ``table``."""
    t = table.select(*keys).distinct().withColumn("_seen", F.lit(True))
    return df.join(t, list(keys), "left").agg(
        F.avg(F.col("_seen").isNull().cast("double")).alias("unseen_cell_rate"))



def counterfactual_expand(df: DataFrame, features: Sequence[str], reference: Mapping[str, object],
                          id_col: str) -> DataFrame:
    """One copy of each row per feature with that feature set to the reference
    value (an ``explode`` of a per-row array - no join); ``feature`` names the
    replaced column."""
    variants = []
    for f in features:
        fields = [F.lit(f).alias("feature")]
        for g in features:
            v = F.lit(reference.get(g)).cast(df.schema[g].dataType) if g == f else F.col(g)
            fields.append(v.alias(g))
        variants.append(F.struct(*fields))
    return df.select(id_col, F.explode(F.array(*variants)).alias("_cf")).select(id_col, "_cf.*")


def attach_reliability(df: DataFrame, group: str, reliability: DataFrame) -> DataFrame:
    """Left lookup of a group's figures (output of ``metrics.group_reliability``); a group
    without figures gets nulls."""
    rel = reliability.select(F.col("group").alias(group), "reliable", "lift", "pr_auc", "base_rate", "min_lift")
    return df.join(rel, group, "left")


def level_value(block: DataFrame, value: str, key: str) -> DataFrame:
    """One statistic of one level of a breakdown (null when absent)."""
    return block.agg(F.max(F.when(F.col("value") == F.lit(str(value)), F.col(key))).alias(key))
