import datetime as dt

import pytest
from pyspark.sql import functions as F

from dwell.operators import pairing
from dwell.operators.ledger import ledger

D = dt.datetime


def _frames(spark, starts, ends):
    s = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(starts)],
                              "entity_id string, intake_datetime timestamp_ntz, seq long")
    e = spark.createDataFrame(ends, "entity_id string, outcome_datetime timestamp_ntz")
    return s, e


def _pair(spark, starts, ends, rows_per_task):
    s, e = _frames(spark, starts, ends)
    out = pairing.pair_next(s, e, "entity_id", "intake_datetime", "outcome_datetime", seq="seq",
                            rows_per_task=rows_per_task)
    out = pairing.with_duration(out, "intake_datetime", "outcome_datetime")
    return sorted((r.entity_id, r.intake_datetime, r.duration_days) for r in out.collect())


# rows_per_task=1 forces every key with more than one event through the hot-key split
MODES = [None, 1, 2, 4_000_000]


@pytest.mark.parametrize("rpt", MODES)
def test_single(spark, rpt):
    assert _pair(spark, [("A1", D(2020, 1, 1))], [("A1", D(2020, 1, 11))], rpt) == [("A1", D(2020, 1, 1), 10.0)]


@pytest.mark.parametrize("rpt", MODES)
def test_repeat_visits(spark, rpt):
    got = _pair(spark, [("A1", D(2020, 1, 1)), ("A1", D(2020, 6, 1))],
                [("A1", D(2020, 1, 5)), ("A1", D(2020, 6, 3))], rpt)
    assert [g[2] for g in got] == [4.0, 2.0]


@pytest.mark.parametrize("rpt", MODES)
def test_earlier_end_ignored(spark, rpt):
    got = _pair(spark, [("A1", D(2020, 6, 1))], [("A1", D(2020, 1, 5)), ("A1", D(2020, 6, 10))], rpt)
    assert got == [("A1", D(2020, 6, 1), 9.0)]


@pytest.mark.parametrize("rpt", MODES)
def test_three_by_three_no_cross_product(spark, rpt):
    starts = [("A1", D(2020, 1, 1)), ("A1", D(2020, 3, 1)), ("A1", D(2020, 5, 1))]
    ends = [("A1", D(2020, 1, 2)), ("A1", D(2020, 3, 5)), ("A1", D(2020, 5, 10))]
    assert [g[2] for g in _pair(spark, starts, ends, rpt)] == [1.0, 4.0, 9.0]


@pytest.mark.parametrize("rpt", MODES)
def test_no_cross_entity(spark, rpt):
    got = _pair(spark, [("A1", D(2020, 1, 1)), ("A2", D(2020, 1, 1))],
                [("A2", D(2020, 1, 3)), ("A1", D(2020, 1, 8))], rpt)
    assert got == [("A1", D(2020, 1, 1), 7.0), ("A2", D(2020, 1, 1), 2.0)]


@pytest.mark.parametrize("rpt", MODES)
def test_two_starts_one_end_later_wins(spark, rpt):
    starts = [("A1", D(2020, 1, 1)), ("A1", D(2020, 2, 1))]
    ends = [("A1", D(2020, 2, 10))]
    assert _pair(spark, starts, ends, rpt) == [("A1", D(2020, 2, 1), 9.0)]
    s, e = _frames(spark, starts, ends)
    st = pairing.pair_status(s, e, "entity_id", "intake_datetime", "outcome_datetime", seq="seq",
                             rows_per_task=rpt)
    counts = dict(st.groupBy("pair_status").count().collect())
    assert counts == {"paired": 1, "already claimed": 1}


@pytest.mark.parametrize("rpt", MODES)
def test_no_end_is_unmatched(spark, rpt):
    starts = [("A1", D(2020, 1, 1)), ("A2", D(2020, 1, 1))]
    ends = [("A1", D(2020, 1, 4))]
    assert [g[0] for g in _pair(spark, starts, ends, rpt)] == ["A1"]
    s, e = _frames(spark, starts, ends)
    st = pairing.with_duration(pairing.pair_status(s, e, "entity_id", "intake_datetime", "outcome_datetime",
                                                   seq="seq", rows_per_task=rpt),
                               "intake_datetime", "outcome_datetime")
    led = {r.step: r.dropped for r in ledger(s, e, st, "entity_id", "intake_datetime", "outcome_datetime").collect()}
    assert led["no matching end"] == 1 and led["end already claimed"] == 0
    assert led["start unusable"] == 0 and led["end unusable"] == 0


@pytest.mark.parametrize("rpt", MODES)
def test_same_instant_is_zero(spark, rpt):
    t = D(2020, 1, 1, 9, 0)
    assert _pair(spark, [("A1", t)], [("A1", t)], rpt) == [("A1", t, 0.0)]


@pytest.mark.parametrize("rpt", MODES)
def test_orphan_end(spark, rpt):
    got = _pair(spark, [("A1", D(2020, 1, 1))], [("A9", D(2020, 1, 2)), ("A1", D(2020, 1, 4))], rpt)
    assert got == [("A1", D(2020, 1, 1), 3.0)]


def test_input_order_independent(spark):
    starts = [("A1", D(2020, 1, 1)), ("A2", D(2020, 2, 1)), ("A1", D(2020, 6, 1))]
    ends = [("A1", D(2020, 1, 5)), ("A2", D(2020, 2, 9)), ("A1", D(2020, 6, 3))]
    a = _pair(spark, starts, ends, None)
    b = _pair(spark, list(reversed(starts)), list(reversed(ends)), None)
    assert [x[1:] for x in a] == [x[1:] for x in b]


@pytest.mark.parametrize("rpt", MODES)
def test_null_time_dropped(spark, rpt):
    got = _pair(spark, [("A1", D(2020, 1, 1)), ("A2", None)], [("A1", D(2020, 1, 2)), ("A2", D(2020, 1, 2))], rpt)
    assert [g[0] for g in got] == ["A1"]


@pytest.mark.parametrize("rpt", MODES)
def test_chained_instant(spark, rpt):
    t1, t2, t3 = D(2020, 1, 1), D(2020, 1, 2), D(2020, 1, 3)
    got = _pair(spark, [("A1", t1), ("A1", t2)], [("A1", t2), ("A1", t3)], rpt)
    assert got == [("A1", t2, 0.0)]


@pytest.mark.parametrize("rpt", [None, 1])
def test_payload_first_end_wins(spark, rpt):
    s = spark.createDataFrame([("A1", D(2020, 1, 1), 0)], "k string, ts timestamp_ntz, seq long")
    e = spark.createDataFrame([("A1", D(2020, 1, 5), 1, "second"), ("A1", D(2020, 1, 5), 0, "first"),
                               ("A1", D(2020, 1, 9), 2, "later")],
                              "k string, te timestamp_ntz, eseq long, outcome string")
    out = pairing.pair_next_with_payload(s, e, "k", "ts", "te", ["outcome"], seq="seq", end_seq="eseq",
                                         rows_per_task=rpt).collect()
    assert [(r.te, r.outcome) for r in out] == [(D(2020, 1, 5), "first")]


def test_hot_key_split_matches_plain(spark):
    """Many events on one key, forced into many buckets, agree with the plain path."""
    import random
    rnd = random.Random(7)
    starts = [("K", D(2020, 1, 1) + dt.timedelta(hours=rnd.randrange(0, 24 * 300))) for _ in range(400)]
    starts += [("J", D(2020, 1, 1) + dt.timedelta(hours=rnd.randrange(0, 24 * 300))) for _ in range(50)]
    ends = [("K", D(2020, 1, 1) + dt.timedelta(hours=rnd.randrange(0, 24 * 320))) for _ in range(300)]
    ends += [("J", D(2020, 1, 1) + dt.timedelta(hours=rnd.randrange(0, 24 * 320))) for _ in range(20)]
    plain = _pair(spark, starts, ends, None)
    for rpt in (3, 17, 60):
        assert _pair(spark, starts, ends, rpt) == plain
    # brute force: earliest end >= start, then the latest start per end wins
    best = {}
    for i, (k, t) in enumerate(starts):
        cands = [te for kk, te in ends if kk == k and te >= t]
        if cands:
            e = min(cands)
            cur = best.get((k, e))
            if cur is None or (t, i) > cur:
                best[(k, e)] = (t, i)
    brute = sorted((k, t, (e - t).total_seconds() / 86400.0) for (k, e), (t, _) in best.items())
    assert plain == brute


def test_prepare_sides_parse_text(spark):
    raw = spark.createDataFrame([(" A1 ", "2020-01-01T07:51:00.000", "Rex"), (None, "2020-01-01T00:00:00", "x"),
                                 ("A2", "not a date", None), ("A3", "2013-12-02T00:00:00-05:00", None)],
                                "entity_id string, datetime string, name string")
    s = pairing.prepare_starts(raw, "entity_id", "datetime", "intake_datetime", optional=["name", "breed"])
    rows = sorted(s.collect())
    assert [r.entity_id for r in rows] == ["A1", "A3"]
    assert rows[1].intake_datetime == D(2013, 12, 2)
    assert rows[0].breed is None
    e = pairing.prepare_ends(raw, "entity_id", "datetime", "outcome_datetime")
    assert e.columns == ["entity_id", "outcome_datetime"]


@pytest.mark.parametrize("rpt", [1, 4_000_000])
def test_events_are_shuffled_once_however_the_planner_sizes_them(spark, rpt):
    """Hot keys are known before the events move: no join shuffles the events again, and a hot key's go to their buckets."""
    s, e = _frames(spark, [("A1", D(2020, m, 1)) for m in range(1, 13)] + [("B", D(2020, 1, 1))], [("A1", D(2020, m, 5)) for m in range(1, 13)])
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = pairing.pair_next(s, e, "entity_id", "intake_datetime", "outcome_datetime", seq="seq", rows_per_task=rpt)
        assert len(out.collect()) == 12
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
