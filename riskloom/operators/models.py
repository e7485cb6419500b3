"""Models on ``pyspark.ml``: logistic regression with statistics, trees, calibration, tuning, reports."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics


@dataclass
class LogisticFit:
    """Coefficients with standard errors, z and p values; ``probability`` is a Column."""

    features: list[str]
    coefficients: list[float]
    intercept: float
    std_errors: list[float]
    z: list[float]
    p_values: list[float]

    def log_odds(self) -> Column:
        return F.lit(self.intercept) + sum((F.lit(c) * F.col(f).cast("double") for f, c in zip(self.features, self.coefficients)), F.lit(0.0))

    def probability(self) -> Column:
        return 1 / (1 + F.exp(-self.log_odds()))

    def summary(self, spark) -> DataFrame:
        rows = [(f, float(c), float(s), float(z), float(p)) for f, c, s, z, p in zip(["intercept", *self.features], [self.intercept, *self.coefficients], self.std_errors, self.z, self.p_values)]
        return spark.createDataFrame(rows, "feature string, coefficient double, std_error double, z double, p_value double")


def logistic(df: DataFrame, features: list[str], label: str, c: float | None = 1.0, max_iter: int = 100, with_stats: bool = True, weight: str | None = None) -> LogisticFit:
    """L2 logistic regression with strength ``c`` (penalty 1 / (c * n), none on the intercept); covariance from one Gram aggregate.

    ``weight`` names a column that says how many rows a row stands for.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = df.select(F.col(label).cast("double").alias("_y"), (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("_w"), *[F.col(f).cast("double").alias(f) for f in features]).na.drop().persist()
    try:
        n = rows.agg(F.sum("_w")).first()[0] or 0
        data = VectorAssembler(inputCols=features, outputCol="_x").transform(rows)
        model = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", regParam=0.0 if c is None else 1.0 / (c * max(n, 1)), standardization=False, maxIter=max_iter, tol=1e-9).fit(data)
        coef, b0 = model.coefficients.toArray().tolist(), float(model.intercept)
        fit = LogisticFit(features, coef, b0, [], [], [])
        if with_stats:
            x = [F.lit(1.0), *[F.col(f) for f in features]]
            p = fit.probability()
            k = len(x)
            cells = rows.agg(*[F.sum(F.col("_w") * x[i] * x[j] * p * (1 - p)) for i in range(k) for j in range(i, k)]).first()
            gram, at = np.zeros((k, k)), 0
            for i in range(k):
                for j in range(i, k):
                    gram[i, j] = gram[j, i] = cells[at] or 0.0
                    at += 1
            cov = np.linalg.pinv(gram) if np.linalg.cond(gram) > 1e10 else np.linalg.inv(gram)
            fit.std_errors = np.sqrt(np.maximum(np.diag(cov), 0)).tolist()
            fit.z = [v / s if s else float("nan") for v, s in zip([b0, *coef], fit.std_errors)]
            fit.p_values = [math.erfc(abs(z) / math.sqrt(2)) for z in fit.z]
        return fit
    finally:
        rows.unpersist()


def positive_woe(fit: LogisticFit) -> list[str]:
    """Features whose coefficient on WOE is negative, against the expected direction."""
    return [f for f, c in zip(fit.features, fit.coefficients) if c < 0]


def estimator(kind: str, seed: int = 42, **params):
    """tree, forest, boosting, logistic."""
    from pyspark.ml import classification as c

    known = {
        "tree": (c.DecisionTreeClassifier, {"maxDepth": 5, "seed": seed}), "forest": (c.RandomForestClassifier, {"numTrees": 50, "maxDepth": 6, "seed": seed}),
        "boosting": (c.GBTClassifier, {"maxIter": 30, "maxDepth": 3, "stepSize": 0.1, "seed": seed}), "logistic": (c.LogisticRegression, {}),
    }
    if kind not in known:
        raise ValueError(f"unknown model {kind!r}; one of {sorted(known)}")
    cls, defaults = known[kind]
    return cls(**{**defaults, **params})


def spread(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """``df`` in enough partitions that none holds many more than ``rows``, as tree fits keep a partition as one block of memory.

    Tables of no more than ``rows`` a partition stay as they are.
    """
    parts = -(-df.count() // rows)
    return df.repartition(parts) if parts > df.rdd.getNumPartitions() else df


@dataclass
class RiskModel:
    """A fitted classifier over named features."""

    features: list[str]
    label: str
    model: object
    kind: str

    @classmethod
    def fit(cls, df: DataFrame, features: list[str], label: str, kind: str = "forest", **params) -> RiskModel:
        from pyspark.ml.feature import VectorAssembler

        est = estimator(kind, **params).setFeaturesCol("_x").setLabelCol("_y")
        data = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip").transform(spread(df.select(F.col(label).cast("double").alias("_y"), *features)))
        return cls(features, label, est.fit(data), kind)

    def predict(self, df: DataFrame, out: str = "probability") -> DataFrame:
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.functions import vector_to_array

        data = VectorAssembler(inputCols=self.features, outputCol="_x", handleInvalid="keep").transform(df)
        own = self.model.copy({})
        for setter, name in (("setPredictionCol", "_pred"), ("setRawPredictionCol", "_raw"), ("setProbabilityCol", "_prob")):
            getattr(own, setter)(name)
        return own.transform(data).select(*df.columns, vector_to_array("_prob")[1].alias(out))

    def importances(self) -> dict[str, float]:
        m = self.model
        v = m.featureImportances.toArray() if hasattr(m, "featureImportances") else np.abs(m.coefficients.toArray())
        return dict(zip(self.features, map(float, v)))

    def evaluate(self, df: DataFrame) -> dict[str, float]:
        scored = self.predict(df, "_p")
        row = metrics.ks_auc_row(scored, self.label, "_p")
        return {"ks": row["ks"], "auc": row["auc"], "gini": row["gini"], "n": row["n"], "bad": row["bad"]}

    def report(self, train: DataFrame, test: DataFrame | None = None, n_bins: int = 10) -> dict[str, DataFrame | dict]:
        """Metrics, score tables, PSI, ROC of the training (and test) rows."""
        from .stability import pooled_model, psi_table

        out: dict = {"train": self.evaluate(train), "importance": self.importances(), "train_table": metrics.score_table(self.predict(train, "_p"), self.label, "_p", n_bins), "roc": metrics.roc_points(self.predict(train, "_p"), self.label, "_p")}
        if test is not None:
            out["test"], out["test_table"] = self.evaluate(test), metrics.score_table(self.predict(test, "_p"), self.label, "_p", n_bins)
            both = self.predict(train, "_p").select("_p", F.lit(False).alias("_a")).unionAll(self.predict(test, "_p").select("_p", F.lit(True).alias("_a")))
            out["psi"] = psi_table(both, pooled_model(both, "_p", n_bins), F.col("_a"))
        return out


def compare(models: dict[str, RiskModel], df: DataFrame) -> DataFrame:
    rows = [(name, *(float(m.evaluate(df)[k]) for k in ("ks", "auc", "gini"))) for name, m in models.items()]
    return df.sparkSession.createDataFrame(rows, "model string, ks double, auc double, gini double")


def tune(df: DataFrame, features: list[str], label: str, key: str, kind: str, grid: dict[str, list], metric: str | list[str] = "ks", folds: int = 3, n_trials: int | None = None, seed: int = 42) -> tuple[dict, list[dict]]:
    """Search over folds by a hash of ``key``: (best parameters, trials).

    All points of ``grid``, or ``n_trials`` of them drawn at random.  With
    several metrics (names of ``OBJECTIVES``) every trial has all of them, the
    first decides, and ``pareto`` finds the trials that no other one beats.
    """
    names, trials, wanted = list(grid), [], [metric] if isinstance(metric, str) else list(metric)
    points = [dict(zip(names, values)) for values in product(*grid.values())]
    if n_trials is not None and n_trials < len(points):
        points = [points[i] for i in sorted(np.random.default_rng(seed).choice(len(points), n_trials, replace=False))]
    fold = F.pmod(F.xxhash64(F.col(key)), F.lit(folds))
    for params in points:
        found = []
        for k in range(folds):
            scored = RiskModel.fit(df.where(fold != k), features, label, kind, **params).predict(df.where(fold == k), "_p")
            found.append([float(OBJECTIVES[m](scored, label, "_p") or 0.0) if m in OBJECTIVES else metrics.ks_auc(scored, label, "_p").first()[m] for m in wanted])
        trials.append({**params, **dict(zip(wanted, np.mean(found, axis=0).tolist())), "sd": float(np.std([f[0] for f in found]))})
    return {n: max(trials, key=lambda t: t[wanted[0]])[n] for n in names}, trials


def pareto(trials: list[dict], metric: list[str]) -> list[dict]:
    """Trials that no other trial equals or beats in all metrics and beats in one."""
    beats = lambda a, b: all(a[m] >= b[m] for m in metric) and any(a[m] > b[m] for m in metric)
    return [t for t in trials if not any(beats(o, t) for o in trials)]


OBJECTIVES: dict[str, Callable[[DataFrame, str, str], float]] = {
    "ks": lambda d, y, p: metrics.ks_auc(d, y, p).first()["ks"],
    "auc": lambda d, y, p: metrics.ks_auc(d, y, p).first()["auc"],
    "lift_head": lambda d, y, p: metrics.lift_at(d, y, p, [0.1]).first()["lift"],
    "lift_tail": lambda d, y, p: _tail(d, y, p),
    "head_ks": lambda d, y, p: 0.5 * metrics.ks_auc(d, y, p).first()["ks"] + 0.5 * metrics.lift_at(d, y, p, [0.1]).first()["capture"],
}


def _tail(d: DataFrame, y: str, p: str, ratio: float = 0.1) -> float:
    """Good rate of the lowest scores over the overall good rate."""
    overall = d.agg(F.avg(y)).first()[0]
    rate = metrics.lift_at(d, y, p, [ratio], ascending=True).first()["lift"] * overall
    return (1 - rate) / (1 - overall)


# --- calibration ---

def calibration_table(df: DataFrame, label: str, p: str, n_bins: int = 10) -> DataFrame:
    """(bin, n, mean_p, bad_rate) over equal-width bins of probability."""
    b = F.least(F.floor(F.col(p) * n_bins), F.lit(n_bins - 1)).cast("int")
    return df.where(F.col(label).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(label).cast("double")).alias("bad_rate"))


def calibration_metrics(df: DataFrame, label: str, p: str, n_bins: int = 10) -> DataFrame:
    """One row: brier, ece, mce."""
    t = calibration_table(df, label, p, n_bins)
    gap = F.abs(F.col("mean_p") - F.col("bad_rate"))
    brier = df.where(F.col(label).isNotNull()).agg(F.avg(F.pow(F.col(p) - F.col(label), 2)).alias("brier"))
    return t.agg((F.sum(gap * F.col("n")) / F.sum("n")).alias("ece"), F.max(gap).alias("mce")).join(brier)  # one row each


def platt(df: DataFrame, label: str, p: str, c: float = 1.0) -> Column:
    """Logistic regression on the clipped raw probability."""
    x = F.greatest(F.least(F.col(p), F.lit(1 - 1e-10)), F.lit(1e-10))
    fit = logistic(df.select(F.col(label), x.alias("_p")), ["_p"], label, c, with_stats=False)
    return 1 / (1 + F.exp(-(F.lit(fit.intercept) + F.lit(fit.coefficients[0]) * x)))


def isotonic(df: DataFrame, label: str, p: str) -> Callable[[DataFrame, str], DataFrame]:
    """Isotonic regression; returns a function that adds a calibrated column."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    vec = VectorAssembler(inputCols=[p], outputCol="_v")
    model = IsotonicRegression(featuresCol="_v", labelCol=label, predictionCol="_iso").fit(vec.transform(df.select(F.col(label).cast("double").alias(label), p)))
    return lambda d, out="calibrated": model.transform(vec.transform(d)).withColumnRenamed("_iso", out).drop("_v")


def histogram_calibration(df: DataFrame, label: str, p: str, n_bins: int = 10) -> Column:
    """Observed rate of the quantile bin of a probability."""
    from .binning import fit_binning

    model = fit_binning(df, p, method="quantile", max_n_bins=n_bins)
    rows = df.where(F.col(label).isNotNull()).groupBy(model.index().alias("b")).agg(F.avg(F.col(label).cast("double")).alias("r")).collect()
    overall = df.agg(F.avg(F.col(label).cast("double"))).first()[0]
    return model.value({r["b"]: r["r"] for r in rows}, default=overall or 0.0)


def beta_parameters(df: DataFrame, label: str, p: str) -> tuple[float, float]:
    """Maximum-likelihood Beta(a, b) of p where the label is 1 and of 1 - p where it is 0, from sufficient statistics."""
    x = F.greatest(F.least(F.col(p), F.lit(1 - 1e-6)), F.lit(1e-6))
    x = F.when(F.col(label) == 1, x).otherwise(1 - x)
    la, lb = df.where(F.col(label).isNotNull()).agg(F.avg(F.log(x)), F.avg(F.log(1 - x))).first()

    def digamma(v: float) -> float:
        out = 0.0
        while v < 8:
            out, v = out - 1 / v, v + 1
        f = 1 / (v * v)
        return out + math.log(v) - 0.5 / v - f * (1 / 12 - f * (1 / 120 - f / 252))

    a = b = 1.0
    for _ in range(5000):  # fixed-point steps on the likelihood equations
        s = digamma(a + b)
        na, nb = a * math.exp(0.2 * (la - digamma(a) + s)), b * math.exp(0.2 * (lb - digamma(b) + s))
        if abs(na - a) + abs(nb - b) < 1e-10:
            break
        a, b = na, nb
    return a, b


def beta_cdf(x: np.ndarray, a: float, b: float) -> np.ndarray:
    """Distribution function of Beta(a, b), by Lentz's continued fraction on the side where it converges fast."""
    x = np.clip(np.asarray(x, float), 0.0, 1.0)
    swap = x > (a + 1) / (a + b + 2)
    z, p, q = np.where(swap, 1 - x, x), np.where(swap, b, a), np.where(swap, a, b)
    tiny = 1e-300
    with np.errstate(all="ignore"):
        front = np.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + p * np.log(z) + q * np.log1p(-z)) / p
        c, d = np.ones_like(z), 1 / (1 - (p + q) * z / (p + 1))
        out = d.copy()
        for m in range(1, 300):
            even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
            odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
            for step in (even, odd):
                d, c = 1 + step * d, 1 + step / c
                d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
                out = out * d * c
            if (np.abs(d * c - 1) < 1e-15).all():
                break
        inner = np.where(z > 0, front * out, 0.0)
    return np.where(swap, 1 - inner, inner)


def beta_calibration(df: DataFrame, label: str, p: str) -> Column:
    """Distribution function of the fitted Beta at the probability (Arrow batches)."""
    a, b = beta_parameters(df, label, p)

    @F.pandas_udf("double")
    def place(x: pd.Series) -> pd.Series:
        return pd.Series(np.where(x.isna(), np.nan, beta_cdf(x.fillna(0.5).to_numpy(), a, b)))

    return place(F.col(p).cast("double"))


CALIBRATIONS: dict[str, Callable[[DataFrame, str, str], Column]] = {"platt": platt, "histogram": histogram_calibration, "beta": beta_calibration}


@dataclass
class CalibratedModel:
    """A model and what its probabilities become."""

    model: RiskModel
    adjust: Callable[[DataFrame, str], DataFrame]

    @classmethod
    def fit(cls, model: RiskModel, df: DataFrame, method: str = "platt") -> CalibratedModel:
        """Calibrate on labelled rows that the model has not been fitted to; ``isotonic`` or one of ``CALIBRATIONS``."""
        scored = model.predict(df, "_raw_p")
        if method == "isotonic":
            return cls(model, isotonic(scored, model.label, "_raw_p"))
        if method not in CALIBRATIONS:
            raise ValueError(f"unknown method {method!r}; one of {['isotonic', *CALIBRATIONS]}")
        column = CALIBRATIONS[method](scored, model.label, "_raw_p")
        return cls(model, lambda d, out: d.withColumn(out, column))

    def predict(self, df: DataFrame, out: str = "probability") -> DataFrame:
        return self.adjust(self.model.predict(df, "_raw_p"), out).drop("_raw_p")


def permutation_importance(model: RiskModel, df: DataFrame, key: str, metric: str = "auc", repeats: int = 3) -> DataFrame:
    """(feature, importance, sd): how far the metric falls when the values of one feature are dealt to other rows."""
    from .selectors import _permuted, blocks_of

    df = df.select(*dict.fromkeys([key, model.label, *model.features]))
    whole, rows, blocks = model.evaluate(df)[metric], [], blocks_of(df.count())
    for f in model.features:
        falls = []
        for k in range(repeats):
            dealt = _permuted(df, [f], ["_dealt"], key, 1000 + 2 * k, blocks).withColumn(f, F.col("_dealt")).drop("_dealt")
            falls.append(whole - model.evaluate(dealt)[metric])
        rows.append((f, float(np.mean(falls)), float(np.std(falls))))
    return df.sparkSession.createDataFrame(rows, "feature string, importance double, sd double")


def tree_rules(df: DataFrame, features: list[str], label: str, kind: str = "tree", max_rules: int | None = None, **params) -> list[str]:
    """IF-THEN paths of fitted trees as rule text.

    Trees are fitted to the label as a number: leaves then differ by their bad
    rate and are not merged for predicting the same class.
    """
    from pyspark.ml import regression
    from pyspark.ml.feature import VectorAssembler

    known = {"tree": (regression.DecisionTreeRegressor, {"maxDepth": 5}), "forest": (regression.RandomForestRegressor, {"numTrees": 10, "maxDepth": 5}), "boosting": (regression.GBTRegressor, {"maxIter": 10, "maxDepth": 3})}
    cls, defaults = known[kind]
    est = cls(featuresCol="_x", labelCol="_y", **{"seed": 42, **defaults, **params})
    model = est.fit(VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip").transform(df.select(F.col(label).cast("double").alias("_y"), *features)))
    trees = model.trees if hasattr(model, "trees") else [model]
    out: dict[str, None] = {}
    for t in trees:
        stack, path = [], []
        for line in t.toDebugString.splitlines()[1:]:
            depth = len(line) - len(line.lstrip())
            text = line.strip()
            while stack and stack[-1] >= depth:
                stack.pop()
                path.pop()
            if text.startswith(("If", "Else")):
                body = text[text.index("(") + 1 : text.rindex(")")]
                name, op, value = body.rsplit(" ", 2)
                path.append(f"{features[int(name.split()[1])]} {op} {float(value):.10g}")
                stack.append(depth)
            elif text.startswith("Predict") and path:
                out[" and ".join(path)] = None
    return list(out)[:max_rules]



def blend(df: DataFrame, models: dict[str, RiskModel], weights: dict[str, float] | None = None, out: str = "probability") -> DataFrame:
    """Weighted mean of several models' probabilities."""
    total = sum((weights or {}).get(k, 1.0) for k in models)
    scored = df
    for k, m in models.items():
        scored = m.predict(scored, f"_p_{k}")
    mean = sum((F.lit((weights or {}).get(k, 1.0) / total) * F.col(f"_p_{k}") for k in models), F.lit(0.0))
    return scored.withColumn(out, mean).drop(*[f"_p_{k}" for k in models])


def stack(df: DataFrame, models: dict[str, RiskModel], label: str) -> tuple[LogisticFit, Callable[[DataFrame], DataFrame]]:
    """Logistic regression over several models' probabilities: (fit, function that adds ``probability``)."""
    names = [f"_p_{k}" for k in models]

    def scored(d: DataFrame) -> DataFrame:
        for n, m in zip(names, models.values()):
            d = m.predict(d, n)
        return d

    fit = logistic(scored(df), names, label)
    return fit, lambda d: scored(d).withColumn("probability", fit.probability()).drop(*names)
