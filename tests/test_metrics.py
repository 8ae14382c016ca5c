import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dwell.operators import breakdown as B
from dwell.operators import metrics as M
from dwell.operators import ranking


def _yy(spark, y, p):
    return spark.createDataFrame([(float(a), float(b), i) for i, (a, b) in enumerate(zip(y, p))],
                                 "y double, p double, id long")


def test_core_metrics(spark):
    r = M.core_metrics(_yy(spark, [10, 20], [12, 26]), "y", "p").first()
    assert r.mae_days == pytest.approx(4.0) and r.mean_bias_days == pytest.approx(4.0)
    r = M.core_metrics(_yy(spark, [0, 0, 0], [7, 7.01, 14]), "y", "p").first()
    assert r.within_7_days_rate == pytest.approx(1 / 3)
    r = M.core_metrics(_yy(spark, [1, 2, 3], [1, 2, 3]), "y", "p").first()
    assert (r.mae_days, r.r2) == (0.0, 1.0)


def test_interval_calibration(spark):
    df = spark.createDataFrame([(5.0, 1.0, 10.0, 100.0), (50.0, 1.0, 10.0, 100.0), (500.0, 1.0, 10.0, 100.0)],
                               "y double, lo double, mid double, hi double")
    r = M.interval_calibration(df, "y", "lo", "mid", "hi").first()
    assert r.empirical_coverage == pytest.approx(2 / 3) and r.above_interval_rate == pytest.approx(1 / 3)
    assert r.below_interval_rate == 0.0


def test_decile_bias(spark):
    y = [10.0] * 500 + [100.0] * 500
    p = [30.0] * 500 + [80.0] * 500
    df = _yy(spark, y, p)
    assert M.core_metrics(df, "y", "p").first().mean_bias_days == pytest.approx(0.0)
    cmp = M.compare_variants(df, "y", ["p"], "id").first()
    assert cmp.max_abs_decile_bias_days == pytest.approx(20.0)


@pytest.mark.parametrize("n", [1, 2, 9, 10, 11, 37, 100, 403])
def test_rank_bins_match_qcut(spark, n):
    rnd = random.Random(n)
    vals = [float(rnd.randrange(0, 5)) for _ in range(n)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(vals)], "v double, id long")
    got = {r.id: r.bin for r in ranking.rank_bins(df, "v", "id", 10).collect()}
    ranks = pd.Series(vals).rank(method="first")
    if n > 1:
        ref = pd.qcut(ranks, q=10, labels=False, duplicates="drop").astype(int).tolist()
    else:
        ref = [0]
    assert [got[i] for i in range(n)] == ref


def test_global_row_number(spark):
    rnd = random.Random(3)
    df = spark.createDataFrame([(rnd.random(), i) for i in range(2000)], "v double, id long")
    got = {r.id: r.row_number for r in ranking.global_row_number(df, ["v", "id"], partitions=5).collect()}
    rows = sorted(((r.v, r.id) for r in df.collect()))
    assert [got[i] for _, i in rows] == list(range(1, 2001))


def _brute_ap_auc(y, s):
    pairs = sorted(zip(s, y), key=lambda t: -t[0])
    P = sum(y)
    N = len(y) - P
    ap, tp, fp = 0.0, 0, 0
    thresholds = sorted(set(s), reverse=True)
    for t in thresholds:
        tp_at = sum(1 for sc, yy in pairs if sc == t and yy == 1)
        fp_at = sum(1 for sc, yy in pairs if sc == t and yy == 0)
        tp += tp_at
        fp += fp_at
        ap += tp_at / P * (tp / (tp + fp))
    # Mann-Whitney AUC with ties counted half
    pos = [sc for sc, yy in pairs if yy == 1]
    neg = [sc for sc, yy in pairs if yy == 0]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (P * N)
    return ap, auc


def test_classifier_metrics_vs_brute(spark):
    rnd = random.Random(11)
    y = [1] * 10 + [0] * 90
    s = [round(rnd.random() * (0.6 if v else 0.4) + (0.3 if v else 0.0), 2) for v in y]
    df = spark.createDataFrame(list(zip(y, s)), "y int, s double")
    r = M.classifier_metrics(df, "s", "y").first()
    ap, auc = _brute_ap_auc(y, s)
    assert r.pr_auc == pytest.approx(ap) and r.roc_auc == pytest.approx(auc)
    assert r.pr_auc_baseline == pytest.approx(0.1) and r.n == 100
    assert r.brier_score == pytest.approx(np.mean([(a - b) ** 2 for a, b in zip(s, y)]))


def test_thresholds_and_operating_point(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.6), (1, 0.5), (0, 0.1), (0, 0.2), (1, 0.3)],
                               "y int, s double")
    curve = ranking.pr_curve(df, "s", "y")
    assert ranking.threshold_for_recall(curve, 0.5).first()[0] == pytest.approx(0.7)
    assert ranking.threshold_for_precision(curve, 1.0).first()[0] == pytest.approx(0.9)
    assert ranking.threshold_for_precision(curve, 1.01).first()[0] is None
    op = M.operating_points(df, "s", "y", [0.5]).first()
    assert (op.true_positive, op.false_positive, op.flagged) == (3, 2, 5)
    assert op.precision == pytest.approx(0.6) and op.recall == pytest.approx(0.75)
    assert op.f1 == pytest.approx(2 * 0.6 * 0.75 / 1.35)


def test_reliability_and_ece(spark):
    rnd = random.Random(5)
    rows = [(1 if rnd.random() < p else 0, p) for p in (rnd.random() for _ in range(2000))]
    df = spark.createDataFrame([(y, p, i) for i, (y, p) in enumerate(rows)], "y int, s double, id long")
    tab = M.reliability_table(df, "s", "y", "id")
    assert tab.count() == 10 and sum(r.n for r in tab.collect()) == 2000
    ece = M.expected_calibration_error(tab).first().ece
    assert 0 <= ece < 0.08


def test_load_share(spark):
    df = spark.createDataFrame([(d,) for d in [1.0, 1.0, 1.0, 1.0, 100.0]], "duration_days double")
    r = B.load_share(df).first()
    assert r.quick_exit_share_of_entities == pytest.approx(0.8)
    assert r.quick_exit_share_of_entity_days == pytest.approx(4 / 104)
    assert r.long_stay_mean_days == pytest.approx(100.0)


def _effect_frame(spark, effect, confounded, n=1000, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        stratum = "old" if i % 2 else "young"
        p_flag = (0.8 if stratum == "old" else 0.2) if confounded else 0.5
        flag = rnd.random() < p_flag
        base = 0.4 if stratum == "old" else 0.05
        p_long = base + (effect if flag else 0.0)
        rows.append((flag, stratum, 120.0 if rnd.random() < p_long else 5.0))
    return spark.createDataFrame(rows, "flag boolean, stratum string, duration_days double")


def test_controlled_effect_removes_confounding(spark):
    r = B.controlled_effect(_effect_frame(spark, 0.0, True, 4000), "flag", ["stratum"]).first()
    assert r.raw_difference_pp > 10 and abs(r.controlled_difference_pp) < 4
    assert r.usable and r.strata_used == 2
    r = B.controlled_effect(_effect_frame(spark, 0.2, False, 4000), "flag", ["stratum"]).first()
    assert r.controlled_difference_pp == pytest.approx(20, abs=4) and r.significant


def test_controlled_effect_unusable(spark):
    df = spark.createDataFrame([(True, "a", 1.0), (False, "b", 1.0)], "flag boolean, stratum string, duration_days double")
    r = B.controlled_effect(df, "flag", ["stratum"]).first()
    assert r.usable is False and r.reason


def test_rank_preserving(spark):
    def run(b, a):
        df = spark.createDataFrame(list(zip(map(float, b), map(float, a))), "b double, a double")
        return ranking.rank_preserving(df, "b", "a").first()[0]
    assert run([0, 0, 0, 5, 9], [3, 1, 2, 14, 25]) is True
    assert run([0, 0, 5, 9], [1, 2, 30, 10]) is False


def test_spearman_matches_pandas(spark):
    rnd = random.Random(9)
    a = [rnd.randrange(0, 20) for _ in range(300)]
    b = [x + rnd.randrange(-5, 6) for x in a]
    df = spark.createDataFrame(list(zip(map(float, a), map(float, b))), "a double, b double")
    got = ranking.spearman(df, "a", "b").first()[0]
    ra, rb = pd.Series(a).rank(method="average"), pd.Series(b).rank(method="average")
    assert got == pytest.approx(ra.corr(rb))


def test_smearing_closed_form(spark):
    y = [1.0, 5.0, 20.0, 90.0]
    f = [0.5, 1.5, 3.0, 4.0]
    df = spark.createDataFrame(list(zip(y, f)), "y double, f double")
    r = M.fit_smearing(df, "y", "f").first()
    resid = np.log1p(y) - np.array(f)
    assert r.smearing_factor == pytest.approx(float(np.mean(np.exp(resid))))
    assert r.residual_std == pytest.approx(float(np.std(resid)))


def test_breakdown_min_n_and_shares(spark):
    rows = [("a", 10.0)] * 6 + [("a", 100.0)] * 4 + [("b", 10.0)] * 3 + [(None, 95.0)] * 2
    df = spark.createDataFrame(rows, "g string, duration_days double")
    lv = {r.value: r for r in B.breakdown(df, "g", min_n=5).collect()}
    assert set(lv) == {"a"}
    assert lv["a"].share == pytest.approx(10 / 15) and lv["a"].long_stay_rate == pytest.approx(0.4)
    assert lv["a"].lift_over_base == pytest.approx(0.4 / (6 / 15))
    s = B.breakdown_summary(df, "g", min_n=5).first()
    assert (s.n, s.levels_dropped_below_min_n, s.rows_dropped_below_min_n) == (15, 1, 3)
    assert B.breakdown_summary(df, "g", where={"g": "zzz"}).first().n == 0


def test_decile_queries_pair_the_events_once(spark, tmp_path, monkeypatch):
    """The rows of a decile query are read several times, so they are written once, with the columns it reads."""
    from datetime import datetime

    from dwell.plans import catalog
    when = lambda d: datetime(2001, 1, 1 + d)
    orders = [(i, i % 4, "F", 1000.0 * i, when(i), "1-URGENT") for i in range(12)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    lines = [(i, when(i + 2)) for i in range(12)]
    spark.createDataFrame(lines, "l_orderkey long, l_shipdate timestamp").write.parquet(str(tmp_path / "lineitem.parquet"))
    written = []
    keep = catalog.reliable_checkpoint
    monkeypatch.setattr(catalog, "reliable_checkpoint", lambda df: written.append(df.columns) or keep(df))
    for query in (catalog.q_decile_bias, catalog.q_reliability_table, catalog.q_ece, catalog.q_compare_variants, catalog.q_metrics_by_decile):
        written.clear()
        assert query(spark, str(tmp_path)).count() > 0
        assert len(written) == 1 and "seq" in written[0] and "o_orderpriority" not in written[0]
