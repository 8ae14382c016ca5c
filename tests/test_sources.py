import json
import os
import tempfile

import pytest

from dwell.sources import files


def test_raw_csv_keeps_na_text(spark):
    d = tempfile.mkdtemp(prefix="dwell-csv-")
    p = os.path.join(d, "in.csv")
    with open(p, "w") as fh:
        fh.write('entity_id,name,datetime\nA1,NA,2020-01-01T00:00:00\nA2,,2020-01-02T00:00:00\nA3,"Rex, Jr",\n')
    df = files.read_raw_csv(spark, p, ["entity_id", "name", "datetime"])
    rows = {r.entity_id: r for r in df.collect()}
    assert rows["A1"].name == "NA" and rows["A2"].name is None and rows["A3"].name == "Rex, Jr"
    assert rows["A3"].datetime is None
    assert all(f.dataType.simpleString() == "string" for f in df.schema.fields)


def test_feed_pages_union_and_empty(spark):
    d = tempfile.mkdtemp(prefix="dwell-feed-")
    with open(os.path.join(d, "p1.json"), "w") as fh:
        json.dump([{"entity_id": "A1", "datetime": "2020-01-01T00:00:00"}], fh)
    with open(os.path.join(d, "p2.json"), "w") as fh:
        json.dump([{"entity_id": "A2", "datetime": "2020-01-02T00:00:00", "name": "Rex"}], fh)
    df = files.read_feed_pages(spark, d, ["entity_id", "datetime", "name"])
    assert sorted((r.entity_id, r.name) for r in df.collect()) == [("A1", None), ("A2", "Rex")]
    empty = tempfile.mkdtemp(prefix="dwell-feed-empty-")
    with open(os.path.join(empty, "p.json"), "w") as fh:
        fh.write("[]")
    with pytest.raises(files.SourceError):
        files.read_feed_pages(spark, empty, ["entity_id"])


def test_stays_roundtrip_partitioned(spark):
    import datetime as dt
    df = spark.createDataFrame([("A1", dt.datetime(2020, 1, 1), 3.0), ("A2", dt.datetime(2021, 5, 1), 4.0)],
                               "key string, start_ts timestamp_ntz, duration_days double")
    root = os.path.join(tempfile.mkdtemp(prefix="dwell-stays-"), "stays")
    files.write_stays(df, root)
    back = files.read_stays(spark, root)
    assert sorted(os.listdir(root))[:2] == ["_SUCCESS", "start_year=2020"] or "start_year=2020" in os.listdir(root)
    assert back.where("start_year = 2021").count() == 1
    since = files.read_stays(spark, root, since="2021-01-01", until="2021-05-01 00:00:01")
    assert [r.key for r in since.collect()] == ["A2"]
    plan = since._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(start_year" in plan and "(start_year#" in plan.split("PartitionFilters")[1]
    assert files.read_stays(spark, root, until="2021-05-01").count() == 1
    with pytest.raises(files.SourceError):
        files.read_stays(spark, root + "_missing")


def test_report_json(spark):
    root = tempfile.mkdtemp(prefix="dwell-report-")
    files.write_report_json({"a": spark.createDataFrame([(1, "x")], "n int, s string")}, root)
    assert spark.read.json(os.path.join(root, "a")).first().s == "x"


def test_report_blocks_do_not_wait_for_each_other(spark):
    """Two blocks that need each other's presence: prepared or written one after the other they would time out."""
    import threading

    from dwell.models.report import _side_by_side
    meet = threading.Barrier(2, timeout=30)
    assert _side_by_side({"a": lambda: (meet.wait(), 1)[1], "b": lambda: (meet.wait(), 2)[1]}) == {"a": 1, "b": 2}
    with pytest.raises(ZeroDivisionError):
        _side_by_side({"a": lambda: 1, "b": lambda: 1 // 0})

    class Block:
        write = property(lambda self: self)
        mode = lambda self, m: self
        json = lambda self, path: meet.wait()
    files.write_report_json({"a": Block(), "b": Block()}, "/nowhere")


def test_written_reads_its_columns_and_partitions_alone(spark):
    from dwell.session import written
    df = spark.createDataFrame([(1, 0.5, "x", "train"), (2, None, "y", "test"), (3, 1.5, None, None)], "id long, v double, t string, split string")
    back = written(df, "split")
    assert back.columns == df.columns and sorted(back.collect()) == sorted(df.collect())
    plan = back.where("split = 'test'").select("v")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<v:double>" in plan and "PartitionFilters: [isnotnull(split" in plan
    assert written(df.where("id > 9"), "split").count() == 0
