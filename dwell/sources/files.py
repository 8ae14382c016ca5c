"""File sources and sinks.

* raw CSV: every column text, no inference; only the empty field is null;
* landed feed pages: many JSON documents unioned by column name;
* the stays table: Parquet partitioned by start year (period filters prune files);
* report blocks: one JSON directory per block;
* model bundles: trees, cut values and levels as small tables.
"""

from __future__ import annotations

import json
import os
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Report blocks written side by side.
BLOCKS_AT_ONCE = 4


class SourceError(RuntimeError):
    pass


def text_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType(), True) for c in columns])


def read_raw_csv(spark: SparkSession, path: str, columns: Sequence[str], multi_line: bool = False) -> DataFrame:
    """Header CSV, every column a string; "NA" / "NULL" stay text.  Columns are
    read by the header's names, in whatever order the file has them; a column that the
    file lacks is null.  ``multi_line`` allows line breaks in values, and makes each
    file one task.  The files of ``path`` must share one header."""
    reader = (spark.read.option("header", True).option("inferSchema", False).option("nullValue", "").option("emptyValue", "")
              .option("escape", '"').option("multiLine", multi_line).option("mode", "PERMISSIVE").option("enforceSchema", False))
    raw = reader.csv(path)
    return raw.select(*[(F.col(f"`{c}`") if c in raw.columns else F.lit(None).cast("string")).alias(c) for c in columns])


def read_feed_pages(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Landed pages of a JSON feed (each a JSON array of records).  Columns
    missing from a page are null; zero rows is an error."""
    df = spark.read.schema(text_schema(columns)).option("multiLine", True).json(path)
    if df.isEmpty():
        raise SourceError(f"no rows in feed pages at {path}")
    return df


def union_pages(pages: Sequence[DataFrame]) -> DataFrame:
    out = pages[0]
    for p in pages[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def write_stays(df: DataFrame, path: str, ts: str = "start_ts") -> None:
    """S4 sink: Parquet partitioned by start year, clustered by time.  Rows are dealt to ranges of
    (year, time), so a year's rows lie in as many files as they fill ranges, not one a task."""
    dated = df.withColumn("start_year", F.year(ts))
    dated.repartitionByRange("start_year", ts).sortWithinPartitions("start_year", ts).write.mode("overwrite").partitionBy("start_year").parquet(path)


def read_stays(spark: SparkSession, path: str, since: str | datetime | None = None, until: str | datetime | None = None, ts: str = "start_ts") -> DataFrame:
    """S4 source; a missing table is a clear error, not an empty frame.  ``since`` (inclusive) and ``until``
    (exclusive) select by time; the years they span select the partitions to read."""
    try:
        stays = spark.read.parquet(path)
    except Exception as exc:  # AnalysisException: path does not exist
        raise SourceError(f"processed table not found at {path}; run the pairing step first") from exc
    for bound, is_low in ((since, True), (until, False)):
        if bound is not None:
            at = bound if isinstance(bound, datetime) else datetime.fromisoformat(bound)
            limit = F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")
            stays = stays.where((F.col("start_year") >= at.year) & (F.col(ts) >= limit) if is_low else (F.col("start_year") <= at.year) & (F.col(ts) < limit))
    return stays


def write_csv(df: DataFrame, path: str) -> None:
    """S5."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_report_json(blocks: Mapping[str, DataFrame], root: str) -> None:
    """Every block as its own JSON directory (nested columns stay nested).  Blocks are small and do
    not wait for each other, so a few are written at a time."""
    with ThreadPoolExecutor(BLOCKS_AT_ONCE) as pool:
        list(pool.map(lambda b: b[1].write.mode("overwrite").json(os.path.join(root, b[0])), blocks.items()))


def save_bundle(bundle, root: str) -> None:
    """Each model as a row of (name, trees), cut values and levels, spec and reference row as one row."""
    spark = SparkSession.getActiveSession()
    spec, binner = bundle.spec, bundle.binner
    meta = {"spec": {"numeric": list(spec.numeric), "categorical": list(spec.categorical), "boolean": list(spec.boolean), "forbidden": list(spec.forbidden), "cap": spec.cap},
            "edges": binner.edges, "levels": binner.levels, "r2": bundle.r2,
            "reference_row": {k: (v if not hasattr(v, "isoformat") else v.isoformat()) for k, v in (bundle.reference_row or {}).items()}}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(os.path.join(root, "meta"))
    rows = [(name, model.to_json()) for name, model in bundle.models.items()]
    spark.createDataFrame(rows, "name string, model string").write.mode("overwrite").parquet(os.path.join(root, "models"))


def load_bundle(spark: SparkSession, root: str):
    """Fails clearly when the bundle is absent."""
    from ..models.boosting import Binner, Boosted
    from ..models.features import FeatureSpec
    from ..models.train import Bundle
    try:
        meta = json.loads(spark.read.text(os.path.join(root, "meta")).first()[0])
    except Exception as exc:
        raise SourceError(f"no model bundle at {root}; train first") from exc
    spec = FeatureSpec(**meta["spec"])
    binner = Binner(spec, meta["edges"], meta["levels"])
    models = {r["name"]: Boosted.from_json(r["model"], binner) for r in spark.read.parquet(os.path.join(root, "models")).collect()}  # one row a model
    return Bundle(spec, models, meta["reference_row"], meta["r2"])
