"""The training-data pipeline: five stages over ``documents``, each applying one operator.

Every stage takes (spark, docs, sf_dir) and returns the rows it keeps, in the columns of
``documents``; the last returns packed pieces.  ``run`` writes each stage's result to the shared
folder as Parquet and reads it again for the next stage.

Other columns than doc_id and text pass through as one value, so none can clash with a column of an operator or
of a stage; ``n_chars`` follows the text where it exists.  Null and empty texts are judged like any other by the
classifier and pass the later stages as empty ones.  A table without rows gives none.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dwell.llm import common, jaccard_join, packing, pii, quality_cnn, substring


REST = "_rest_of_the_row"


def _narrow(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns of a row in one."""
    others = [F.col(f"`{c}`").alias(c) for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*others or [F.lit(0).alias("none")]).alias(REST))


def _widen(rows: DataFrame, docs: DataFrame, text: Column | None = None) -> DataFrame:
    """The columns of ``docs`` again; with a new ``text``, ``n_chars`` is counted anew."""
    if text is not None:
        rows = rows.withColumn("text", text)
    def column(c: str) -> Column:
        if c in ("doc_id", "text"):
            return F.col(c)
        if c == "n_chars" and text is not None:
            return F.char_length("text").cast(docs.schema[c].dataType).alias(c)
        return F.col(REST)[c].alias(c)
    return rows.select(*[column(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that the classifier rejects go."""
    judged = quality_cnn.classify(_narrow(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _widen(judged.where("predicted = 1"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of each group of linked texts one row stays, that with the least id.  Rows are
    chosen, not ids: texts under one id are judged each for itself, and of rows that repeat with
    the same id and text one stays.  Rows with a null id take part in no group and all stay."""
    docs_ = _narrow(docs)
    rows = docs_.where("doc_id IS NOT NULL").withColumn("_row", common.row_key("doc_id", "text"))
    groups = jaccard_join.components(rows.select(F.col("_row").alias("doc_id"), "text"))
    groups = groups.select(F.col("doc_id").alias("_row"), "component_id").distinct()
    first = (rows.select("doc_id", "_row").distinct().join(groups, "_row")
             .groupBy("component_id").agg(F.min(F.struct("doc_id", "_row")).alias("first")).select("first.doc_id", "first._row"))
    same = Window.partitionBy("doc_id", "_row").orderBy(*([F.col(REST)[c] for c in docs.columns if c not in ("doc_id", "text")] or ["_row"]))
    kept = rows.join(first, ["doc_id", "_row"]).withColumn("_copy", F.row_number().over(same)).where("_copy = 1")
    return _widen(kept.select("doc_id", "text", REST).unionByName(docs_.where("doc_id IS NULL")), docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: passages that repeat across documents stay in the first document only."""
    left = substring.remove(_narrow(docs))
    return _widen(left, docs, F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: personal values become pseudonyms of the same format, by the session's key."""
    changed = pii.pseudonymise(_narrow(docs), pii.session_key(spark))
    return _widen(changed, docs, F.col("text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: the documents left, as pieces of sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages),
          ("personal_data", personal_data), ("packing", pack)]

#: A network, a keyed hash and a tokenizer have no SQL form; tests/llm hold the result against a
#: plain Python version of every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
