"""Bin searches, order statistics and mended operators against plain definitions."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.functions import finance, losses
from riskloom.operators import bin_stats, binning, eda, encoders, portfolio_losses, ranks, scorecard, search, selectors, stability
from riskloom.operators.binning import BinModel
from riskloom.streaming import monitor


def histograms(count, cells=9):
    rng = np.random.default_rng(11)
    for _ in range(count):
        n = rng.integers(20, 200, cells).astype(float)
        yield n, np.floor(n * rng.uniform(0.05, 0.6, cells))


def sums(v, cuts):
    return [float(sum(v[a:b])) for a, b in zip([0, *cuts], [*cuts, len(v)])]


def entropy(n, b):
    return -sum(p * math.log2(p) for p in (b / n, 1 - b / n) if p > 0)


def gini(n, b):
    return 2 * (b / n) * (1 - b / n)


@pytest.mark.parametrize(("method", "impurity"), [(search.tree, entropy), (search.cart, gini)])
def test_trees_split_best_leaf_first(method, impurity):
    for n, bad in histograms(20):
        cuts = []
        while len(cuts) < 3:  # of all borders the one that lowers the summed impurity most
            def total(c):
                return sum(a * impurity(a, b) for a, b in zip(sums(n, c), sums(bad, c)))

            trials = [sorted([*cuts, k]) for k in range(1, len(n)) if k not in cuts]
            best = min(trials, key=total)
            if not total(best) < total(cuts) - 1e-9:
                break
            cuts = best
        assert list(method(n, bad, 4)) == cuts


def test_chi_merge_by_definition():
    for n, bad in histograms(20):
        cuts = list(range(1, len(n)))
        while len(cuts) > 1:
            a, b = sums(n, cuts), sums(bad, cuts)
            chi = []
            for i in range(len(cuts)):
                table = [[b[i], a[i] - b[i]], [b[i + 1], a[i + 1] - b[i + 1]]]
                rows, cols = [sum(x) for x in table], [sum(x) for x in zip(*table)]
                chi.append(sum((table[x][y] - rows[x] * cols[y] / sum(rows)) ** 2 / (rows[x] * cols[y] / sum(rows)) for x in (0, 1) for y in (0, 1)))
            worst = min(range(len(chi)), key=chi.__getitem__)
            if len(cuts) + 1 <= 4 and math.erfc(math.sqrt(chi[worst] / 2)) < 0.05:
                break
            del cuts[worst]
        assert list(search.chi_merge(n, bad, 4)) == cuts


def test_kmeans_is_the_least_sum_of_squares():
    for n, bad in histograms(10):
        edges = np.cumsum(np.random.default_rng(3).uniform(0.5, 3, len(n) - 1))
        x = search._centres(edges, len(n))

        def cost(cuts):
            out = 0.0
            for a, b in zip([0, *cuts], [*cuts, len(n)]):
                w, v = n[a:b], x[a:b]
                out += (w * (v - (w * v).sum() / w.sum()) ** 2).sum()
            return out

        best = min(itertools.combinations(range(1, len(n)), 3), key=cost)
        assert math.isclose(cost(search.kmeans(n, bad, 4, edges=edges)), cost(best), rel_tol=1e-9)


def test_best_iv_adds_the_best_border():
    for n, bad in histograms(10):
        cuts = []
        measure = lambda c: (-search.violations(np.divide(sums(bad, c), sums(n, c))), search.iv(np.array(sums(n, c)), np.array(sums(bad, c))))
        while len(cuts) < 3:
            best = max((sorted([*cuts, k]) for k in range(1, len(n)) if k not in cuts), key=measure)
            if measure(best) <= measure(cuts):
                break
            cuts = best
        assert list(search.best_iv(n, bad, 4)) == cuts


def test_optimal_and_monotone_against_enumeration():
    for n, bad in histograms(8):
        every = [c for k in range(4) for c in itertools.combinations(range(1, len(n)), k)]
        iv = lambda c: search.iv(np.array(sums(n, c)), np.array(sums(bad, c)))
        assert math.isclose(iv(search.optimal(n, bad, 4)), max(map(iv, every)), rel_tol=1e-9)
        rates = lambda c: np.diff(np.divide(sums(bad, c), sums(n, c)))
        rising = [c for c in every if (rates(c) >= 0).all() or (rates(c) <= 0).all()]
        got = search.optimal(n, bad, 4, monotonic=True)
        assert math.isclose(iv(got), max(map(iv, rising)), rel_tol=1e-9)


def test_lift_refinement_ends_where_no_move_helps():
    for n, bad in histograms(20, 12):
        start = [3, 6, 9]
        least = 0.03 * n.sum()
        cuts = search.refine_lift(n, bad, start, least, max_n_bins=5)
        score = lambda c: search.lift_score(n, bad, c, least)
        assert cuts == sorted(set(cuts)) and 1 <= len(cuts) <= 4 and score(cuts) >= score(start)
        assert len(cuts) == 4 or all(score(sorted([*cuts, k])) <= score(cuts) for k in range(1, 12) if k not in cuts)
        tight = search.refine_lift(n, bad, [6], least, max_n_bins=5, monotone="ascending")
        assert search.is_monotone(search.rates(*search.merged(n, bad, tight)))
    a, b = np.array([100.0, 100, 100]), np.array([30.0, 20, 10])
    lift = b / 20
    tail = 0.65 * 1.0 + 0.2 * 0.5 + 0.15 * 1.0
    want = 3 * tail + 0.2 * 3 * math.log1p(100 / 3) + 0.08 * search.iv(a, b) + 0.25 * math.log1p(2)
    assert lift[0] == 1.5 and math.isclose(search.lift_score(a, b, [1, 2], 1), want, rel_tol=1e-9)


def test_curve_coefficient():
    n = np.full(5, 40.0)
    falling = np.array([16.0, 10, 6, 3, 0])
    assert search.curve_coefficient(n, falling) > 0
    assert search.curve_coefficient(np.full(5, 30.0), np.array([9.0, 4, 2, 5, 10]), "bad_rate", "valley") > 0
    assert search.curve_coefficient(np.full(4, 30.0), np.array([3.0, 12, 6, 15])) < 0
    v = falling / 40 / (35 / 200)
    assert math.isclose(search.curve_coefficient(n, falling), abs(np.polyfit(np.linspace(-1, 1, 5), v, 2)[0]), rel_tol=1e-9)
    assert search.curve_coefficient(n[:2], falling[:2]) == 0 == search.curve_coefficient(n, np.full(5, 4.0))


def test_percentiles_of_groups(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", None]), "f", rng.choice([None, float(rng.randrange(9)), rng.gauss(0, 1)])) for _ in range(3000)] + [("b", "f", None), ("c", "f", 7.0)]
    cells = spark.createDataFrame(rows, "g string, feature string, x double")
    ps = [0.0, 0.013, 0.25, 0.5, 0.99, 1.0]
    got = {r["g"]: (r["n"], r["q"]) for r in ranks.percentiles(cells, ["g", "feature"], ps).collect()}
    assert set(got) == {"a", None, "c"}
    for g, (n, q) in got.items():
        own = [x for k, _, x in rows if k == g and x is not None]
        assert n == len(own) and np.allclose(q, np.quantile(own, ps), rtol=0, atol=1e-12)
    total = {r["x"]: (r["s"], r["s_total"]) for r in ranks.running(ranks.value_counts(cells.where("g = 'a'"), ["feature"]), ["feature"], {"s": F.col("n")}).collect()}
    own = sorted(x for k, _, x in rows if k == "a" and x is not None)
    assert all(total[x] == (sum(y <= x for y in own), len(own)) for x in {*own})


def test_one_fit_of_many_features_equals_many_of_one(spark):
    rng = random.Random(5)
    rows = [(rng.gauss(0, 1), float(rng.randrange(6)), rng.choice("abcdefgh"), int(rng.random() < 0.3)) for _ in range(800)]
    df = spark.createDataFrame(rows, "p double, q double, c string, y int")
    for method in ("quantile", "mdlp", "uniform"):
        many = binning.fit_many(df, ["p", "q", "c"], "y", method=method)
        assert many == {f: binning.fit_binning(df, f, "y", method=method) for f in ("p", "q", "c")}


def test_rare_categories_have_a_place_of_their_own(spark):
    rows = [(v, int(k % 3 == 0)) for v, n in (("a", 40), ("b", 30), ("c", 20), ("d", 6), ("e", 4)) for k in range(n)]
    df = spark.createDataFrame(rows, "v string, y int")
    m = binning.fit_binning(df, "v", method="quantile", max_n_bins=3)
    assert m.groups == [["a"], ["b"], []] and m.unknown == 2 and m.labels()[2] == "other"
    got = {r["bin"]: r["n"] for r in df.groupBy(m.index().alias("bin")).agg(F.count("*").alias("n")).collect()}
    assert got == {0: 40, 1: 30, 2: 30}
    groups, rest = binning.category_groups(df, ["v"], "y", 3, max_categories=2)["v"]
    assert sorted(v for g in groups for v in g) == ["a", "b"] and 0 <= rest < len(groups)


def test_exports_treat_nan_as_missing(spark):
    card = scorecard.ScoreCard({"x": BinModel("x", [1.0]), "c": BinModel("c", groups=[["a"], []], unknown=1)}, {"x": {0: 0.5, 1: -0.5, -1: 0.1}, "c": {0: 0.2, 1: 0.3, -1: -0.4}}, {"x": 1.0, "c": 2.0}, 0.3)
    df = spark.createDataFrame([(0.5, "a"), (2.0, "z"), (float("nan"), None), (None, "a")], "x double, c string")
    own = {}
    exec(card.to_python(), own)  # noqa: S102  our own source
    for r in df.select("x", "c", card.score().alias("s"), F.expr(card.to_sql()).alias("sql")).collect():
        assert math.isclose(r["s"], r["sql"]) and math.isclose(r["s"], own["score"]({"x": r["x"], "c": r["c"]}))


def test_windowed_psi_counts_new_bins(spark):
    rows = [(f"2024-01-01 0{k % 6}:00:00", 5.0 if k < 10 else None) for k in range(30)]
    events = spark.createDataFrame(rows, "ts string, x double").withColumn("ts", F.to_timestamp("ts"))
    model = BinModel("x", [1.0])
    got = monitor.windowed_psi(events, "ts", model, {0: 0.5, 1: 0.5}).first()
    e, a = {0: 0.5, 1: 0.5, -1: 0.0}, {0: 0.0, 1: 1 / 3, -1: 2 / 3}
    want = sum((max(a[b], 1e-10) - max(e[b], 1e-10)) * math.log(max(a[b], 1e-10) / max(e[b], 1e-10)) for b in e)
    assert got["n"] == 30 and math.isclose(got["psi"], want, rel_tol=1e-9)


def test_text_nan_is_a_value(spark):
    df = spark.createDataFrame([("NaN", float("nan")), ("b", 1.0), (None, None)], "s string, x double")
    got = {r["feature"]: r["missing"] for r in eda.missing_table(df).collect()}
    assert got == {"s": 1, "x": 2}
    assert {r["feature"]: round(r["missing_rate"], 6) for r in eda.quality(df, ["s", "x"]).collect()} == {"s": round(1 / 3, 6), "x": round(2 / 3, 6)}


def test_ranking_losses_over_all_pairs(spark):
    rng = random.Random(8)
    rows = [(int(rng.random() < 0.4), rng.choice([rng.random() * 0.98 + 0.01, 0.3])) for _ in range(300)]
    df = spark.createDataFrame(rows, "y int, p double")
    pairs = [(s, t) for y, s in rows if y for z, t in rows if not z]
    bce = sum(-math.log(p if y else 1 - p) for y, p in rows) / len(rows)
    hinge = sum(max(0.0, 0.2 - s + t) ** 2 for s, t in pairs) / len(pairs)
    assert math.isclose(portfolio_losses.ranking_hinge(df, "y", "p").first()[0], bce + hinge, rel_tol=1e-9)
    logistic = sum(math.log1p(math.exp(t - s)) for s, t in pairs) / len(pairs)
    assert abs(losses.pairwise_ranking(df, "y", "p").first()[0] - logistic) < 1 / (8 * 2000**2)
    near, far = (portfolio_losses.bad_debt(df, "y", "p", 0.3, approval_weight=w).first()[0] for w in (0.0, 1.0))
    ps = sorted(p for _, p in rows)
    edge = ps[math.ceil(0.3 * len(ps)) - 1]
    assert math.isclose(far - near, abs(sum(p <= edge for p in ps) / len(ps) - 0.3), abs_tol=1e-9)


def test_rates_of_return_in_batches(spark):
    flows = [[-100.0, 60.0, 60.0], [-100.0, 10.0], [5.0, 5.0], None, [-1000.0] + [100.0] * 15]
    df = spark.createDataFrame([(k, f) for k, f in enumerate(flows)], "k int, f array<double>")
    got = {r["k"]: r["irr"] for r in df.select("k", finance.irr(F.col("f")).alias("irr")).collect()}
    for k, f in enumerate(flows):
        if k in (2, 3):
            assert got[k] is None or math.isnan(got[k])
        else:
            assert abs(sum(v / (1 + got[k]) ** t for t, v in enumerate(f))) < 1e-6
    never = spark.range(1).select(finance.rate(12, F.lit(10.0), F.lit(1000.0)).alias("r")).first()["r"]
    assert never is None or math.isnan(never) or abs(1000 * (1 + never) ** 12 + 10 * ((1 + never) ** 12 - 1) / never) < 1e-3


def test_ordered_encoding_is_total(spark):
    rows = [(2**53 + k // 2, "v", k % 2) for k in range(40)]  # ties, and ids that a double cannot tell apart
    df = spark.createDataFrame(rows, "id long, c string, y int")
    got = encoders.ordered_target(df, "c", "y", F.col("id"), "code", tie_breaker=F.col("y")).collect()
    mean, seen = 0.5, (0, 0)
    for r in sorted(got, key=lambda r: (r["id"], r["y"])):
        assert math.isclose(r["code"], (seen[0] + mean) / (seen[1] + 1), rel_tol=1e-9)
        seen = seen[0] + r["y"], seen[1] + 1
    names = ["", "a", "aaaaaaaab", "aaaaaaaaa", "é", "z", "日本"]
    table = encoders.ordinal(spark.createDataFrame([(n,) for n in names * 2], "c string"), "c").table
    assert [r["value"] for r in table.orderBy("code").collect()] == sorted(names, key=str.encode)


def test_sequence_and_labels(spark):
    rng = random.Random(2)
    rows = [(k, x := rng.gauss(0, 1), rng.gauss(0, 1), int(x + rng.gauss(0, 0.5) > 0), rng.randrange(90)) for k in range(600)]
    df = spark.createDataFrame(rows, "k int, a double, b double, y int, od int")
    assert selectors.by_sequence(df, ["b", "a"], "y", 1, folds=2, key="k").kept == ["a"] == selectors.by_sequence(df, ["b", "a"], "y", 1, direction="backward", folds=2, key="k").kept
    r = eda.label_correlation(df, ["od"], [7, 30]).first()
    x, y = ([int(row[4] > d) for row in rows] for d in (7, 30))
    assert math.isclose(r["correlation"], np.corrcoef(x, y)[0, 1], rel_tol=1e-9)
    assert stability.pooled_models(df, ["a", "b"], 4) == {f: stability.pooled_model(df, f, 4) for f in ("a", "b")}
    assert bin_stats.compare_splits(df, "a", "y", [0.0], [5.0]).first()["better_iv"] == "first"
