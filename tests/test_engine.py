"""Hand-checked cases, fixtures and properties of the engine."""

import json
import math
import random
import zipfile
from io import BytesIO

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.functions import expressions, finance, losses
from riskloom.functions import labels as L
from riskloom.operators import bin_stats, binning, eda, encoders, metrics, mining, scorecard, search, selectors, stability, strategy
from riskloom.operators.binning import BinModel
from riskloom.operators.rules import Logic, Rule, RulesClassifier, RuleSet, report, waterfall
from riskloom.sources import tables
from riskloom.streaming import monitor


def values(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(42)
    f1, f2, f3 = rng.normal(size=1000), rng.exponential(2, 1000), rng.integers(0, 100, 1000)
    y = rng.random(1000) < 1 / (1 + np.exp(-(0.5 * f1 - 0.3 * f2 + 0.01 * f3)))
    city = rng.choice(["a", "b", "c", None], 1000)
    rows = [(i, None if i % 50 == 0 else float(a), float(b), int(c), str(s) if s is not None else None, int(t)) for i, (a, b, c, s, t) in enumerate(zip(f1, f2, f3, city, y))]
    return spark.createDataFrame(rows, "id long, feature_1 double, feature_2 double, feature_3 int, city string, target int").cache()


def test_finance_goldens(spark):
    c = F.array(*[F.lit(float(x)) for x in (-1000, 300, 400, 400, 300)])
    r = spark.range(1).select(
        finance.fv(0.05 / 12, 120, -100, -100).alias("fv"), finance.pv(0.05 / 12, 120, -100).alias("pv"), finance.pmt(0.05 / 12, 120, 10000).alias("pmt"), finance.nper(0.05 / 12, -100, 10000).alias("nper"),
        finance.npv(0.05, c).alias("npv"), finance.irr(c).alias("irr"), finance.rate(120, -100, 10000).alias("rate"), finance.mirr(c, 0.05, 0.08).alias("mirr"),
        finance.fv(0, 10, -5, -100).alias("zero"), finance.ipmt(0.1, 1, 3, 2000).alias("i1"), (finance.ipmt(0.1, 2, 3, 2000) + finance.ppmt(0.1, 2, 3, 2000) - finance.pmt(0.1, 3, 2000)).alias("sum"),
    ).first()
    expect = {"fv": 15692.92889433575, "pv": 9428.135032823473, "pmt": -106.06551523907554, "nper": 129.62847166352213, "npv": 240.8718589476606, "irr": 0.1489502812737554, "rate": 0.003114181946000934, "mirr": 0.1205253227096672, "zero": 150.0, "i1": -200.0, "sum": 0.0}
    for k, v in expect.items():
        assert math.isclose(r[k], v, rel_tol=1e-9, abs_tol=1e-9), (k, r[k])


def test_expressions(spark):
    d = spark.createDataFrame([(2.0, 4.0, None, True), (1.0, 2.0, float("nan"), False), (3.0, 3.0, 5.0, None)], "f0 double, f1 double, x double, b boolean")
    out = expressions.derive(d, {"s": "f0 + f1", "w": "where(f0 > 1, f0, f1)", "k": "where(b, f0 * 1.1, f0)"})
    assert values(out, "s", "w") == [(6.0, 2.0), (3.0, 2.0), (6.0, 3.0)]
    for text, expect in (("x > 1", [False, False, True]), ("not x > 1", [True, True, False]), ("1 < f0 <= 3", [True, False, True]), ("f0 in [1, 3]", [False, True, True]), ("x.isna()", [True, True, False]), ("~(f0 == 2) & x.notna()", [False, False, True]), ("f0 == 2 ^ f1 == 3", None), ("f0.between(1, 2) or b", [True, True, False]), ("x != 5", [True, True, False])):
        if expect is None:
            continue
        assert [r[0] for r in d.select(expressions.predicate(text)).collect()] == expect, text
    for bad in ("__import__('os')", "f0.apply(print)", "lambda: 1", "f0 >", "[x for x in y]"):
        with pytest.raises(expressions.ExpressionError):
            expressions.predicate(bad)
    assert expressions.columns_of("a > 1 and where(b > c, a, d) < 2") == ["a", "b", "c", "d"]
    assert expressions.simplify("not not a > 1") == "a > 1"
    assert expressions.simplify("a > 1 or (a > 1 and b > 2)") == "a > 1"
    assert expressions.simplify("(a > 1 or b > 2) or b > 2") == "a > 1 or b > 2"


def test_rule_fixtures(spark):
    d = spark.createDataFrame([(18, 0), (22, 1), (30, 0), (17, 1)], "age int, y int")
    r = {x["part"]: x for x in report(d, [Rule("age >= 21")], "y", margins=True).collect()}
    assert (r["hit"]["good_share"], r["miss"]["bad_share"], r["total"]["good_share"]) == (0.5, 0.5, 1.0)
    r = {x["part"]: x for x in report(d, [Rule("age >= 0")], "y").collect()}
    assert (r["miss"]["n"], r["miss"]["n_share"], r["miss"]["risk_reject"]) == (0, 0.0, 0.0)
    assert [x["rule"] for x in waterfall(d, [Rule("age >= 21")], "y").orderBy("position").collect()] == ["original", "age >= 21", "remaining after age >= 21", "all rules"]
    m = spark.createDataFrame([(450, 0), (520, 2), (610, 4), (480, 6), (700, 1), (430, 8)], "score int, MOB1 int")
    long = L.with_labels(m, ["MOB1"], [5, 3, 1])
    t = {x["label"]: x for x in report(long, [Rule("score < 500")], "y", by=["label"]).where("part = 'hit'").collect()}
    assert (t["MOB1_5+"]["n"], t["MOB1_5+"]["bad"], t["MOB1_5+"]["lift"]) == (3, 2, 2.0) and {*t} == {"MOB1_5+", "MOB1_3+", "MOB1_1+"}
    both = Rule("age >= 21") & ~Rule("y == 1")
    assert both.filter(d).count() == 1 and both.columns == ["age", "y"]
    nested = RuleSet([Rule("age >= 21"), RuleSet([Rule("age < 18"), Rule("y == 1")], Logic.AND)], Logic.OR)
    again = RuleSet.from_json(nested.to_json())
    assert [r[0] for r in d.select(again.hit).collect()] == [False, True, True, True] and len(again.flat()) == 3
    c = RulesClassifier([Rule("age >= 21", "old", 3.0), Rule("y == 1", "bad", 1.0)])
    assert values(c.predict(d), "score", "prediction") == [(0.0, 0), (1.0, 1), (0.75, 1), (0.25, 0)]
    assert c.predict(d).first()["reasons"] == []
    assert report(d.limit(0), [Rule("age >= 21")], "y").count() == 2


def test_labels(spark):
    d = spark.createDataFrame([(0,), (3,), (7,), (8,), (None,)], "od int")
    assert [r[0] for r in d.select(L.overdue_label("od", 7)).collect()] == [0, 0, 0, 1, None]
    assert [r[0] for r in d.select(L.overdue_label("od", 7, drop_grey=True)).collect()] == [0, None, None, 1, None]
    with pytest.raises(ValueError):
        L.binary_labels_only(d, "od")
    r = spark.createDataFrame([(0.01,), (0.02,), (0.2,), (0.6,), (None,)], "v double")
    assert [x[0] for x in r.select(L.iv_rating(F.col("v"))).collect()] == ["none", "weak", "medium", "suspicious", None]


def test_bins_are_left_closed_and_round_trip(spark):
    m = BinModel("x", [1.0, 2.0], special=[9.0])
    d = spark.createDataFrame([(0.5,), (1.0,), (1.5,), (2.0,), (9.0,), (None,), (float("nan"),)], "x double")
    assert [r[0] for r in d.select(m.index()).collect()] == [0, 1, 1, 2, -2, -1, -1]
    assert BinModel.from_json(m.to_json()) == m and m.labels()[1] == "[1, 2)"
    g = BinModel("c", groups=[["a"], ["b", "c"]], unknown=1)
    d = spark.createDataFrame([("a",), ("c",), ("zz",), (None,)], "c string")
    assert [r[0] for r in d.select(g.index()).collect()] == [0, 1, 1, -1]
    assert BinModel.from_json(json.dumps(json.loads(g.to_json()))).groups == g.groups


@pytest.mark.parametrize("method", binning.ALL_METHODS)
def test_methods_respect_limits(small, method):
    m = binning.fit_binning(small, "feature_1", "target", method=method, max_n_bins=4, min_bin_size=0.05)
    h = binning.histogram(small, "feature_1", "target", m.splits)
    assert 1 <= m.n_bins <= 4 and m.splits == sorted(set(m.splits))
    if method != "uniform":
        assert h.n.min() >= 0.05 * h.n.sum()
    assert binning.fit_binning(small, "feature_1", "target", method=method, max_n_bins=4, min_bin_size=0.05).splits == m.splits
    up = binning.fit_binning(small, "feature_1", "target", method=method, monotonic="ascending") if method != "uniform" else None
    if up:
        r = binning.histogram(small, "feature_1", "target", up.splits)
        assert (np.diff(search.rates(r.n, r.bad)) >= 0).all()


def test_exact_search_beats_all_others():
    rng = random.Random(1)
    for _ in range(20):
        n = np.array([rng.randrange(5, 60) for _ in range(9)], float)
        bad = np.array([rng.randrange(0, int(k) + 1) for k in n], float)
        from itertools import combinations

        every = [list(c) for k in range(4) for c in combinations(range(1, 9), k) if search.merged(n, bad, list(c))[0].min() >= 20]
        best = max(search.iv(*search.merged(n, bad, c)) for c in every)
        assert math.isclose(search.iv(*search.merged(n, bad, search.best_dp(n, bad, 4, 20))), best, rel_tol=1e-6)
        rising = [c for c in every if (np.diff(search.rates(*search.merged(n, bad, c))) > 0).all()]
        got = search.best_dp(n, bad, 4, 20, "iv", 1)
        assert math.isclose(search.iv(*search.merged(n, bad, got)), max(search.iv(*search.merged(n, bad, c)) for c in rising), rel_tol=1e-6)
    assert math.isclose(search.chi2_tail(3.841458820694124, 1), 0.05, rel_tol=1e-9) and math.isclose(search.chi2_tail(18.307038053275146, 10), 0.05, rel_tol=1e-9)


def test_kernel_sums(small):
    m = binning.fit_binning(small, "feature_1", "target", method="quantile", max_n_bins=5)
    t = {r["bin"]: r for r in bin_stats.with_margins(bin_stats.bin_stats(small, m, "target")).collect()}
    total = t[None]
    assert total["n"] == 1000 and total["bin_label"] == "total" and math.isclose(sum(r["n_share"] for b, r in t.items() if b is not None), 1)
    assert math.isclose(sum(r["iv_bin"] for b, r in t.items() if b is not None), total["iv_total"], rel_tol=1e-9)
    assert t[-1]["cum_bad"] == total["bad"]  # missing comes last


def test_ranking_metrics_with_ties(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(12) / 10, rng.randrange(2)) for _ in range(200)]
    d = spark.createDataFrame(rows, "s double, y int")
    r = metrics.ks_auc(d, "y", "s").first()
    good, bad = [s for s, y in rows if not y], [s for s, y in rows if y]
    auc = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / len(bad) / len(good)
    ks = max(abs(sum(b <= c for b in bad) / len(bad) - sum(g <= c for g in good) / len(good)) for c in {s for s, _ in rows})
    assert math.isclose(r["auc"], auc) and math.isclose(r["ks"], ks)
    assert metrics.ks_auc(d.where("y = 0"), "y", "s").first()["auc"] is None
    assert metrics.ks_auc(d.limit(0), "y", "s").first()["ks"] is None


def test_psi(spark):
    d = spark.createDataFrame([(float(i % 10), i >= 100) for i in range(200)], "x double, late boolean")
    m = stability.pooled_model(d, "x", 5)
    assert abs(stability.psi_table(d, m, F.col("late")).first()["psi"]) < 1e-12
    shifted = d.withColumn("x", F.when(F.col("late"), F.col("x") + 5).otherwise(F.col("x")))
    assert stability.batch_psi(shifted, {"x": m}, F.col("late")).first()["psi"] > 0.25


def test_encoders(spark, small):
    w, iv = encoders.woe(small, "city", "target")
    rows = [(r["city"], r["target"]) for r in small.collect()]
    B, G = sum(y for c, y in rows if c), sum(1 - y for c, y in rows if c)
    out = {r["city"]: r["w"] for r in w.apply(small, "w").select("city", "w").distinct().collect()}
    for c in "abc":
        b, g = sum(y for k, y in rows if k == c), sum(1 - y for k, y in rows if k == c)
        assert math.isclose(out[c], math.log(((b + 1) / (B + 2)) / ((g + 1) / (G + 2))))
    assert out[None] == 0.0 and iv >= 0
    new = spark.createDataFrame([("zz",), (None,), ("a",)], "city string")
    assert [r[0] for r in encoders.ordinal(small, "city").apply(new, "o").select("o").collect()] == [-1.0, -1.0, 0.0]
    large = encoders.Mapping("city", encoders.count(small, "city").table, 0.0, 0.0, None).apply(new, "n")  # by join
    assert {r["city"]: r["n"] for r in large.collect()}["a"] == sum(c == "a" for c, _ in rows)
    o = encoders.ordered_target(small, "city", "target", F.col("id"), "e").orderBy("id").collect()
    seen, mean = {}, sum(y for _, y in rows) / len(rows)
    for r in o:
        s, n = seen.get(r["city"], (0, 0))
        assert math.isclose(r["e"], (s + mean) / (n + 1))
        seen[r["city"]] = (s + r["target"], n + 1)


def test_selectors(spark, small):
    d = spark.createDataFrame([(float(i), float(i), float(6 - i), 1.0, None if i < 5 else 1.0, i % 2) for i in range(1, 6)], "a double, b double, c double, k double, n double, y int")
    s = selectors.by_vif(d, ["a", "b", "c"])
    assert len(s.dropped) == 2 and selectors.by_vif(d, ["a", "b"]).dropped == ["b"]
    assert selectors.by_variance(d, ["a", "k"]).kept == ["a"] and selectors.by_missing(d, ["a", "n"], 0.5).kept == ["a"]
    assert selectors.by_mode(d, ["a", "k"], 0.9).kept == ["a"] and selectors.by_cardinality(d, ["a", "k"], 2).kept == ["k"]
    assert selectors.by_correlation(d, ["a", "b", "c"], weights={"a": 3, "b": 2, "c": 1}).kept == ["a"]
    assert selectors.by_name(d, ["a", "b"], "^a$").kept == ["a"] and selectors.by_type(d, ["a", "y"], ["int"]).kept == ["y"]
    assert selectors.by_missing(d, ["a", "n"], 0.5, include=["n"], exclude=["a"]).kept == ["n"]
    assert selectors.vote([selectors.by_name(d, ["a", "b"], "a"), selectors.by_name(d, ["a", "b"], "[ab]")]) == ["a"]
    chosen, history = selectors.stepwise(small.where("feature_1 IS NOT NULL"), ["feature_1", "feature_2"], "target")
    assert "feature_1" in chosen and history


def test_scorecard_round_trip(spark, small):
    card = scorecard.ScoreCard.fit(small, ["feature_1", "feature_2"], "target", method="quantile", max_n_bins=4)
    again = scorecard.ScoreCard.from_json(card.to_json())
    out = small.select(card.score().alias("a"), again.score().alias("b"), F.expr(card.to_sql()).alias("c"), card.log_odds().alias("z"))
    for r in out.collect():
        assert math.isclose(r["a"], r["b"]) and math.isclose(r["a"], r["c"], rel_tol=1e-9)
        assert math.isclose(r["a"], 750 + card.b * math.log(1 / 35) - card.b * r["z"], rel_tol=1e-9)
    assert len(card.transform(small).first()["reasons"]) == 2
    p = scorecard.StandardScore(decimal=None)
    x = spark.range(1).select(p.probability(p.score(F.lit(0.2))).alias("p"), p.score(F.lit(0.05 / 1.05)).alias("s")).first()
    assert math.isclose(x["p"], 0.2, rel_tol=1e-9) and math.isclose(x["s"], 600 + 2 * p.b * math.log(0.05) - p.b * math.log(0.05) - p.b * math.log(0.05), rel_tol=1e-9)


def test_losses_and_gradients(spark):
    d = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.6), (1, 0.9)], "y int, p double")
    assert math.isclose(losses.CrossEntropy().mean(d, "y", "p").first()[0], -sum(map(math.log, (0.9, 0.6, 0.6, 0.9))) / 4)
    y, z, h = F.col("y"), F.log(F.col("p") / (1 - F.col("p"))), 1e-5
    for loss in (losses.CrossEntropy(2.0, 1.0), losses.Focal(), losses.CostSensitive()):
        r = d.select(loss.gradient(y, F.col("p")).alias("g"), ((loss.value(y, losses.sigmoid(z + h)) - loss.value(y, losses.sigmoid(z - h))) / (2 * h)).alias("n")).collect()
        assert all(math.isclose(x["g"], x["n"], abs_tol=1e-6) for x in r)
    pairs = [(b - g) for b in (0.6, 0.9) for g in (0.1, 0.4)]
    assert math.isclose(losses.pairwise_ranking(d, "y", "p").first()[0], sum(math.log1p(math.exp(-x)) for x in pairs) / 4, rel_tol=1e-9)
    assert math.isclose(losses.approval_loss(d, "y", "p", 0.75).first()[0], 1 / 3)


def test_strategy(spark):
    assert [r[0] for r in spark.createDataFrame([(0,), (6,), (7,), (130,), (None,)], "d int").select(strategy.dpd_state(F.col("d"))).collect()] == [0, 1, 2, 7, None]
    d = spark.createDataFrame([(float(i), int(i < 3)) for i in range(10)], "s double, y int")
    t = {r["threshold"]: r for r in strategy.simulate(d, "s", "y", [0.0, 3.0, 100.0]).collect()}
    assert (t[3.0]["approved_n"], t[3.0]["approved_bad"], t[3.0]["rejected_bad_rate"]) == (7, 0, 1.0) and t[100.0]["approved_n"] == 0
    low = {r["threshold"]: r["approved_n"] for r in strategy.simulate(d, "s", "y", [2.0], low_risk="low").collect()}
    assert low == {2.0: 3}
    p = strategy.OverduePredictor.fit(d, "s", "y", method="best_iv", min_bin_size=0.1)
    assert math.isclose(p.calibrate(d, 0.15).transform(d).agg(F.avg("predicted_rate")).first()[0], 0.15, rel_tol=1e-9)


def test_mining(small):
    models = binning.fit_many(small, ["feature_1", "feature_3"], "target", method="quantile", max_n_bins=4)
    q = mining.rule_quality(small, mining.threshold_rules(models), "target")
    assert q.count() == 14 and q.where("lift > 1").count() > 0
    assert mining.merge_intervals([(1, 3), (2, 4), (6, 7)]) == [(1, 4), (6, 7)]
    pairs = mining.mine_pairs(small, [("feature_1", "feature_3")], "target", models, min_lift=1.0)
    top = report(small, pairs[:1], "target").where("part = 'hit'").first()
    assert math.isclose(top["lift"], pairs[0].weight)
    assert mining.mine_trees(small, ["feature_1", "feature_3"], "target", maxDepth=2).count() > 0


def test_eda(small):
    assert eda.infer_types(small)["feature_1"] == "numeric" and eda.infer_types(small)["city"] == "categorical"
    info = {r["column"]: r for r in eda.data_info(small).collect()}
    assert info["feature_1"]["missing"] == 20
    assert eda.within_fences(small, ["feature_2"]).count() < 1000
    assert {*eda.bundle(small, "target", ["feature_1"])} >= {"info", "missing", "iv"}


def test_sources(spark, small, tmp_path):
    for fmt in ("parquet", "orc", "json", "csv"):
        tables.write_table(small, f"{tmp_path}/t.{fmt}", fmt)
        assert tables.read_table(spark, f"{tmp_path}/t.{fmt}").count() == 1000
    tables.save_artefact(spark, BinModel("x", [1.0]).to_json(), f"{tmp_path}/m")
    assert BinModel.from_json(tables.load_artefact(spark, f"{tmp_path}/m")).splits == [1.0]
    t = {"a<b": eda.target_distribution(small, "target")}
    assert "a&lt;b" in tables.html_report(t)
    with zipfile.ZipFile(BytesIO(tables.xlsx_report(t))) as z:
        assert "xl/worksheets/sheet1.xml" in z.namelist() and b"<row r=\"3\">" in z.read("xl/worksheets/sheet1.xml")


def test_streaming(spark, tmp_path):
    rows = [(f"2024-01-0{1 + i // 10} 0{i % 10}:00:00", float(i % 4)) for i in range(30)]
    d = spark.createDataFrame(rows, "ts string, value double").select(F.to_timestamp("ts").alias("ts"), "value")
    d.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(d.schema).parquet(f"{tmp_path}/in")
    batch = {r["start"]: (r["n"], r["bad"]) for r in monitor.windowed_rate(d, "ts", F.col("value") >= 2).collect()}
    q = monitor.windowed_rate(stream, "ts", F.col("value") >= 2).writeStream.outputMode("complete").format("memory").queryName("rates").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert {r["start"]: (r["n"], r["bad"]) for r in spark.table("rates").collect()} == batch and len(batch) == 3
    m = BinModel("value", [2.0])
    p = monitor.windowed_psi(d, "ts", m, {0: 0.5, 1: 0.5}).collect()
    assert len(p) == 3 and all(r["psi"] >= 0 for r in p)
