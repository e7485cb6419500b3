"""Fitted models, calibration and selections against plain definitions."""

import io
import math
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom import errors
from riskloom.operators import models, scorecard, selectors, stability
from riskloom.sources import tables


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(4)
    rows = []
    for k in range(700):
        a, b = rng.gauss(0, 1), rng.gauss(0, 2)
        p = 1 / (1 + math.exp(-(0.8 * a - 0.3 * b - 0.5)))
        rows.append((k, a, b, p, int(rng.random() < p)))
    return spark.createDataFrame(rows, "k long, a double, b double, p double, y int").persist(), np.array(rows)


def newton(x, y, penalty):
    """Logistic regression with an L2 penalty on all but the intercept."""
    x = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(x.shape[1]), penalty * np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T * (p * (1 - p)) @ x + ridge, x.T @ (p - y) + ridge @ w)
    return w, x, p


def test_logistic_and_platt(data):
    df, rows = data
    w, x, p = newton(rows[:, 1:3], rows[:, 4], 1.0)
    fit = models.logistic(df, ["a", "b"], "y", c=1.0)
    assert np.allclose([fit.intercept, *fit.coefficients], w, atol=1e-4)
    assert np.allclose(fit.std_errors, np.sqrt(np.diag(np.linalg.inv(x.T * (p * (1 - p)) @ x))), rtol=1e-3)
    w, x, p = newton(rows[:, 3:4], rows[:, 4], 1.0)
    got = [r[0] for r in df.orderBy("k").select(models.platt(df, "y", "p")).collect()]
    assert np.allclose(got, p, atol=1e-4)


def test_beta_distribution_function(data):
    for a, b in ((0.5, 0.5), (2.0, 5.0), (40.0, 3.0)):
        x = np.array([0.0, 0.01, 0.2, 0.5, 0.77, 0.999, 1.0])
        u = np.linspace(0, np.pi / 2, 400_001)  # t = sin(u)^2 takes the poles at the ends away
        f = 2 * np.sin(u) ** (2 * a - 1) * np.cos(u) ** (2 * b - 1)
        cum = np.concatenate([[0], np.cumsum((f[1:] + f[:-1]) / 2)])
        assert np.allclose(models.beta_cdf(x, a, b), np.interp(np.arcsin(np.sqrt(x)), u, cum / cum[-1]), atol=1e-6)
    df, _ = data
    got = [r[0] for r in df.orderBy("p").select(models.beta_calibration(df, "y", "p")).collect()]
    assert got == sorted(got) and 0 <= got[0] and got[-1] <= 1


def test_calibrated_models(data):
    df, rows = data
    model = models.RiskModel.fit(df, ["a", "b"], "y", "tree", maxDepth=3)
    for method in ("isotonic", "platt", "histogram", "beta"):
        out = models.CalibratedModel.fit(model, df, method).predict(df, "q")
        assert out.columns == [*df.columns, "q"]
        low, high, mean = out.agg(F.min("q"), F.max("q"), F.avg("q")).first()
        assert 0 <= low <= high <= 1 and (method == "beta" or abs(mean - rows[:, 4].mean()) < 0.02)
    with pytest.raises(ValueError):
        models.CalibratedModel.fit(model, df, "none")


def test_tuning_and_pareto(data):
    df, _ = data
    best, trials = models.tune(df, ["a", "b"], "y", "k", "tree", {"maxDepth": [1, 2, 3]}, ["auc", "lift_head"], folds=2, n_trials=2)
    assert len(trials) == 2 and best["maxDepth"] == max(trials, key=lambda t: t["auc"])["maxDepth"]
    points = [{"m": 1, "n": 3}, {"m": 2, "n": 2}, {"m": 1, "n": 2}, {"m": 3, "n": 1}]
    assert models.pareto(points, ["m", "n"]) == [points[0], points[1], points[3]]


def test_permutation_importance(data):
    df, _ = data
    model = models.RiskModel.fit(df, ["a", "b"], "y", "logistic")
    got = {r["feature"]: r["importance"] for r in models.permutation_importance(model, df, "k", repeats=2).collect()}
    assert got["a"] > 0.02 and got["b"] > 0.0


def test_box_cox_takes_the_likeliest_exponent(data):
    df, rows = data
    own = scorecard.BoxCoxScore().fit(df, "p")
    odds = rows[:, 3] / (1 - rows[:, 3]) + 1e-6
    grid = [i / 20 - 2 for i in range(81)]
    value = lambda g: np.log(odds) if abs(g) < 1e-12 else (odds**g - 1) / g
    like = [-len(odds) / 2 * math.log(value(g).var()) + (g - 1) * np.log(odds).sum() for g in grid]
    assert own.lmbda == grid[int(np.argmax(like))]
    v = value(own.lmbda)
    want = np.round(300 + 700 * (1 - (v - v.min()) / (v.max() - v.min())))
    assert np.allclose([r[0] for r in df.orderBy("k").select(own.score(F.col("p"))).collect()], want, atol=1)


def test_scorecard_is_woe_and_logistic(data):
    df, rows = data
    card = scorecard.ScoreCard.fit(df, ["a", "b"], "y", method="quantile", max_n_bins=4)
    y, coded = rows[:, 4], []
    for j, f in ((1, "a"), (2, "b")):
        bins = np.searchsorted(card.models[f].splits, rows[:, j], side="right")
        woe = {}
        for k in range(4):
            own = y[bins == k]
            woe[k] = math.log((own.sum() / y.sum()) / ((1 - own).sum() / (1 - y).sum()))
        assert np.allclose([card.woe[f][k] for k in range(4)], [woe[k] for k in range(4)], atol=1e-9)
        coded.append([woe[k] for k in bins])
    w, _, p = newton(np.array(coded).T, y, 1.0)
    assert np.allclose([card.intercept, *card.coefficients.values()], w, atol=1e-4)
    assert np.allclose([r[0] for r in df.orderBy("k").select(card.probability()).collect()], p, atol=1e-4)


def test_psi_selection_over_folds(data):
    df, rows = data
    got = selectors.by_psi(df, ["a"], "k", n_splits=3, n_bins=4).scores["a"]
    fold = np.array([r[0] for r in df.orderBy("k").select(F.pmod(F.xxhash64("k"), F.lit(3))).collect()])
    bins = np.searchsorted(np.quantile(rows[:, 1], [0.25, 0.5, 0.75]), rows[:, 1], side="right")
    want = 0.0
    for k in range(3):
        e, a = (np.bincount(bins[m], minlength=4) / m.sum() for m in (fold != k, fold == k))
        want += ((a - e) * np.log(a / e)).sum() / 3
    assert math.isclose(got, want, rel_tol=1e-9)
    steps = selectors.staged(df, ["a", "b", "p"], "y", iv_threshold=0.0, corr_threshold=0.7)
    assert [s.name for s in steps[1]] == ["missing", "mode", "iv", "correlation"] and not {"a", "p"} <= {*steps[0]}
    assert stability.pooled_model(df, "a", 4).n_bins == 4


def test_tree_rules_cover_all_rows_once(data):
    from riskloom.operators.rules import Rule

    df, _ = data
    rules = models.tree_rules(df, ["a", "b"], "y", "tree", maxDepth=3)
    hits = df.select(sum((Rule(x).hit.cast("int") for x in rules), F.lit(0)).alias("n")).groupBy("n").count().collect()
    assert [(r["n"], r["count"]) for r in hits] == [(1, 700)]


def test_reports_say_what_they_leave_out(data):
    df, _ = data
    assert "only the first 5 rows" in tables.html_report({"t": df}, limit=5) and "only the first" not in tables.html_report({"t": df.limit(5)}, limit=5)
    sheet = zipfile.ZipFile(io.BytesIO(tables.xlsx_report({"t": df}, limit=7))).read("xl/worksheets/sheet1.xml").decode()
    assert sheet.count("<row ") == 9 and "only the first 7 rows" in sheet


def test_kinds_of_columns(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "i int, s string, x double").withColumn("d", F.current_date())
    assert errors.split_kinds(df) == {"numeric": ["i", "x"], "text": ["s"], "date": ["d"], "other": []}
    errors.require_numeric(df, ["i", "x"])
    with pytest.raises(errors.InputTypeError):
        errors.require_numeric(df, ["i", "s"])
