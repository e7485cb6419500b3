"""Scorecards and score transformations; every transformation is a Column expression."""

from __future__ import annotations

import json
import math
from contextlib import nullcontext
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bin_stats
from .binning import BinModel, Counts, fit_many, quantile_edges
from .metrics import _bucket

P_MIN = 1e-10


def clip_probability(p: Column) -> Column:
    return F.greatest(F.least(p, F.lit(1 - P_MIN)), F.lit(P_MIN))


def _finish(x: Column, lower: float | None, upper: float | None, decimal: int | None) -> Column:
    if upper is not None:
        x = F.least(x, F.lit(float(upper)))
    if lower is not None:
        x = F.greatest(x, F.lit(float(lower)))
    return x if decimal is None else F.bround(x, decimal)


@dataclass
class StandardScore:
    """A - B ln(odds) with B = pdo / ln(rate) and A = base_score + B ln(base_odds); ``base_odds`` is bad over good."""

    base_odds: float = 0.05
    base_score: float = 600
    pdo: float = 20
    rate: float = 2
    lower: float | None = None
    upper: float | None = None
    decimal: int | None = 0
    descending: bool = True

    @property
    def b(self) -> float:
        return self.pdo / math.log(self.rate)

    @property
    def a(self) -> float:
        return self.base_score + self.b * math.log(self.base_odds)

    def score(self, p: Column) -> Column:
        p = clip_probability(p)
        x = F.lit(self.a) - F.lit(self.b) * F.log(p / (1 - p))
        if not self.descending:
            low_high = (self.lower, self.upper)
            x = F.lit(float(sum(low_high)) if None not in low_high else 2.0 * self.base_score) - x
        return _finish(x, self.lower, self.upper, self.decimal)

    def probability(self, score: Column) -> Column:
        odds = F.exp((F.lit(self.a) - score) / self.b)
        return odds / (1 + odds)

    def reference(self, spark, scores: list[float]) -> DataFrame:
        return spark.createDataFrame([(float(s),) for s in scores], "score double").withColumn("probability", self.probability(F.col("score"))).withColumn("odds", F.col("probability") / (1 - F.col("probability")))


@dataclass
class LinearScore:
    lower: float = 0
    upper: float = 100
    decimal: int | None = 0
    ascending: bool = True

    def score(self, p: Column) -> Column:
        p = clip_probability(p)
        return _finish(self.lower + (self.upper - self.lower) * (p if self.ascending else 1 - p), self.lower, self.upper, self.decimal)


@dataclass
class QuantileScore:
    """Rank among the quantiles of the fitted probabilities, as a linear score."""

    lower: float = 0
    upper: float = 100
    n_quantiles: int = 100
    decimal: int | None = 0
    ascending: bool = True
    edges: list[float] = field(default_factory=list)

    def fit(self, df: DataFrame, p: str) -> QuantileScore:
        self.edges = sorted(set(quantile_edges(df, p, [i / self.n_quantiles for i in range(1, self.n_quantiles)])))
        return self

    def score(self, p: Column) -> Column:
        place = _bucket(p, self.edges) / F.lit(max(len(self.edges), 1))
        return _finish(self.lower + (self.upper - self.lower) * (place if self.ascending else 1 - place), self.lower, self.upper, self.decimal)


@dataclass
class BoxCoxScore:
    """Box-Cox of the odds, with the exponent of largest likelihood on a grid (one pass over Arrow batches), mapped to the range."""

    lower: float = 300
    upper: float = 1000
    decimal: int | None = 0
    ascending: bool = False
    shift: float = 1e-6
    lmbda: float | None = None
    low: float = 0.0
    high: float = 1.0

    def _value(self, p: Column, lmbda: float) -> Column:
        p = clip_probability(p)
        odds = p / (1 - p) + self.shift
        return F.log(odds) if abs(lmbda) < 1e-12 else (F.pow(odds, lmbda) - 1) / lmbda

    def fit(self, df: DataFrame, p: str) -> BoxCoxScore:
        grid = [self.lmbda] if self.lmbda is not None else [i / 20 - 2 for i in range(81)]
        shift = self.shift

        def pooled(a: tuple, b: tuple) -> tuple:
            """(n, means, squared deviations) of two parts together."""
            n, gap = a[0] + b[0], b[1] - a[1]
            return n, a[1] + gap * (b[0] / n), a[2] + b[2] + gap * gap * (a[0] * b[0] / n)

        def moments(batches):
            """(n, sum of log odds, least and largest p, means and squared deviations on the grid) of a partition."""
            g = np.array(grid)[:, None]
            n, s, low, high, mean, dev = 0, 0.0, math.inf, -math.inf, np.zeros(len(grid)), np.zeros(len(grid))
            for batch in batches:
                q = batch.column(0).to_numpy(zero_copy_only=False)
                if not len(q):
                    continue
                x = np.log(q / (1 - q) + shift)
                v = np.where(np.abs(g) < 1e-12, x, np.expm1(g * x) / np.where(np.abs(g) < 1e-12, 1.0, g))
                own = v.mean(1)
                n, mean, dev = pooled((n, mean, dev), (len(q), own, ((v - own[:, None]) ** 2).sum(1)))
                s, low, high = s + float(x.sum()), min(low, float(q.min())), max(high, float(q.max()))
            if n:
                yield pa.RecordBatch.from_pydict({"n": [n], "s": [s], "low": [low], "high": [high], "mean": [mean.tolist()], "dev": [dev.tolist()]})

        rows = df.where(F.col(p).isNotNull()).select(clip_probability(F.col(p).cast("double")).alias("q")).mapInArrow(moments, "n long, s double, low double, high double, mean array<double>, dev array<double>").collect()
        n, mean, dev = 0, np.zeros(len(grid)), np.zeros(len(grid))
        for r in rows:
            n, mean, dev = pooled((n, mean, dev), (r["n"], np.array(r["mean"]), np.array(r["dev"])))
        s = sum(r["s"] for r in rows)
        like = [-n / 2 * math.log(v / n) + (g - 1) * s if v else -math.inf for g, v in zip(grid, dev)]
        self.lmbda = grid[int(np.argmax(like))]
        ends = [min((r["low"] for r in rows), default=None), max((r["high"] for r in rows), default=None)]
        self.low, self.high = df.sparkSession.range(1).select(*[self._value(F.lit(e).cast("double"), self.lmbda) for e in ends]).first()  # the value rises with p
        return self

    def score(self, p: Column) -> Column:
        place = (self._value(p, self.lmbda) - self.low) / ((self.high - self.low) or 1.0)
        return _finish(self.lower + (self.upper - self.lower) * (place if self.ascending else 1 - place), self.lower, self.upper, self.decimal)


@dataclass
class ScoreCard:
    """WOE bins and logistic coefficients as points: A - B * intercept in all, -B * coefficient * WOE per bin."""

    models: dict[str, BinModel]
    woe: dict[str, dict[int, float]]
    coefficients: dict[str, float]
    intercept: float
    base_odds: float = 1 / 35
    base_score: float = 750
    pdo: float = 60
    rate: float = 2
    round_points: bool = False
    baseline: dict[str, float] = field(default_factory=dict)

    @classmethod
    def fit(cls, df: DataFrame, features: list[str], label: str, models: dict[str, BinModel] | None = None, reg: float = 1.0, **options) -> ScoreCard:
        from .models import logistic

        own = {k: options.pop(k) for k in ("base_odds", "base_score", "pdo", "rate", "round_points") if k in options}
        types = dict(df.dtypes)
        text = options.get("cat_cutoff") or any(types[f] in ("string", "boolean") for f in features) or any(m.groups is not None for m in (models or {}).values())
        with nullcontext() if text else Counts(df, features, label) as counted:
            models = models or fit_many(df, features, label, counted=counted, **options)
            if counted is not None:
                counts, sizes = counted.counts(models), counted.binned(models).select("feature", "bin", "rows").collect()
            else:
                counts = bin_stats.batch_counts(df, models, label)
                sizes = bin_stats.batch_counts(df.withColumn("_all", F.lit(0)), models, "_all").withColumnRenamed("n", "rows").collect()
            table = bin_stats.table_from_counts(counts, ["feature"]).select("feature", "bin", "woe").collect()
        woe: dict[str, dict[int, float]] = {f: {} for f in features}
        for r in table:
            woe[r["feature"]][r["bin"]] = r["woe"]
        coded = df.select(F.col(label).cast("double").alias(label), *[models[f].value(woe[f]).alias(f) for f in features])
        fitted = logistic(coded.groupBy(label, *features).agg(F.count("*").alias("_rows")), features, label, c=reg, weight="_rows")  # a row per combination of bins
        card = cls(models, woe, dict(zip(features, fitted.coefficients)), fitted.intercept, **own)
        for f in features:  # lower median of the points of all rows
            points = sorted((card.points_of(f).get(r["bin"], 0.0), r["rows"]) for r in sizes if r["feature"] == f)
            upto = np.cumsum([n for _, n in points])
            card.baseline[f] = float(points[int(np.searchsorted(upto, (upto[-1] + 1) // 2))][0])
        return card

    @property
    def b(self) -> float:
        return self.pdo / math.log(self.rate)

    @property
    def base_points(self) -> float:
        x = self.base_score + self.b * math.log(self.base_odds) - self.b * self.intercept
        return float(round(x)) if self.round_points else x

    def points_of(self, feature: str) -> dict[int, float]:
        out = {b: -self.b * self.coefficients[feature] * w for b, w in self.woe[feature].items()}
        return {b: float(round(v)) for b, v in out.items()} if self.round_points else out

    def points_column(self, feature: str) -> Column:
        return self.models[feature].value(self.points_of(feature))

    def score(self) -> Column:
        return F.lit(self.base_points) + sum((self.points_column(f) for f in self.models), F.lit(0.0))

    def log_odds(self) -> Column:
        return F.lit(self.intercept) + sum((F.lit(self.coefficients[f]) * self.models[f].value(self.woe[f]) for f in self.models), F.lit(0.0))

    def probability(self) -> Column:
        return 1 / (1 + F.exp(-self.log_odds()))

    def reasons(self, keep: int = 3) -> Column:
        """Features whose points differ most from the training median: array of (feature, effect)."""
        effects = F.array(*[F.struct(F.abs(self.points_column(f) - self.baseline.get(f, 0.0)).alias("size"), F.lit(f).alias("feature"), (self.points_column(f) - self.baseline.get(f, 0.0)).alias("effect")) for f in self.models])
        top = F.slice(F.reverse(F.array_sort(effects)), 1, keep)
        return F.transform(top, lambda x: F.struct(x["feature"].alias("feature"), x["effect"].alias("effect")))

    def transform(self, df: DataFrame, keep: int = 3) -> DataFrame:
        return df.withColumns({"score": self.score(), "probability": self.probability(), "reasons": self.reasons(keep)})

    def table(self, spark) -> DataFrame:
        rows = [(f, b, m.labels().get(b), self.woe[f][b], p) for f, m in self.models.items() for b, p in sorted(self.points_of(f).items())]
        return spark.createDataFrame([("base", None, None, None, self.base_points), *rows], "feature string, bin int, bin_label string, woe double, points double")

    def to_sql(self) -> str:
        """One SQL expression of the score, which Spark and most databases can run; all its numbers are doubles."""
        number = lambda v: repr(float(v)) if "e" in repr(float(v)) else f"{float(v)!r}e0"
        quote = lambda v: "'" + v.replace("'", "''") + "'"
        parts = [number(self.base_points)]
        for f, m in self.models.items():
            pts, name = self.points_of(f), f"`{f}`"
            at = lambda b: number(pts.get(b, 0.0))  # noqa: B023, E731
            gone = f"{name} IS NULL" if m.groups is not None else f"{name} IS NULL OR isnan({name})"
            cases = [f"WHEN {gone} THEN {at(-1 if m.missing_separate else 0)}"]
            if m.groups is not None:
                cases += [f"WHEN {name} IN ({', '.join(map(quote, g))}) THEN {at(i)}" for i, g in enumerate(m.groups) if g]
                cases.append(f"ELSE {at(m.unknown)}")
            else:
                cases += [f"WHEN {name} = {number(s)} THEN {at(-2)}" for s in m.special]
                cases += [f"WHEN {name} < {number(s)} THEN {at(i)}" for i, s in enumerate(m.splits)]
                cases.append(f"ELSE {at(len(m.splits))}")
            parts.append(f"(CASE {' '.join(cases)} END)")
        return " + ".join(parts)

    def to_python(self) -> str:
        """Source of a Python function ``score(row)`` of a mapping; missing is None or NaN."""
        lines = ["def score(row):", f"    total = {self.base_points!r}"]
        for f, m in self.models.items():
            pts = self.points_of(f)
            lines += [f"    x = row[{f!r}]", "    if x is None or x != x:", f"        total += {pts.get(-1 if m.missing_separate else 0, 0.0)!r}"]
            if m.groups is not None:
                lines += [line for i, g in enumerate(m.groups) if g for line in (f"    elif x in {tuple(g)!r}:", f"        total += {pts.get(i, 0.0)!r}")]
                last = pts.get(m.unknown, 0.0)
            else:
                lines += [line for s in m.special for line in (f"    elif x == {float(s)!r}:", f"        total += {pts.get(-2, 0.0)!r}")]
                lines += [line for i, s in enumerate(m.splits) for line in (f"    elif x < {float(s)!r}:", f"        total += {pts.get(i, 0.0)!r}")]
                last = pts.get(len(m.splits), 0.0)
            lines += ["    else:", f"        total += {last!r}"]
        return "\n".join([*lines, "    return total", ""])

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> ScoreCard:
        d = json.loads(text)
        d["models"] = {f: BinModel(**m) for f, m in d["models"].items()}
        d["woe"] = {f: {int(b): v for b, v in w.items()} for f, w in d["woe"].items()}
        return cls(**d)


def score_probability_table(df: DataFrame, score: str, label: str, scale: StandardScore, n_bins: int = 10) -> DataFrame:
    """(bin, n, bad, bad_rate, odds, median_score, expected_probability): observed against what the scale says."""
    from .binning import fit_binning

    model = fit_binning(df, score, method="quantile", max_n_bins=n_bins)
    t = df.where(F.col(label).isNotNull()).groupBy(model.index().alias("bin")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("bad"), F.percentile_approx(score, 0.5, 10_000).cast("double").alias("median_score"))
    return t.select("*", (F.col("bad") / F.col("n")).alias("bad_rate"), F.try_divide(F.col("bad").cast("double"), F.col("n") - F.col("bad")).alias("odds"), scale.probability(F.col("median_score")).alias("expected_probability"))


# --- drift calibration ---

def linear_alignment(df: DataFrame, score: str, is_reference: Column, clip: bool = True) -> Column:
    """Scale and shift the current scores to the mean and population deviation of the reference ones."""
    x, ref = F.col(score), F.coalesce(is_reference, F.lit(False))
    on = lambda f, c: f(F.when(c, x))
    m0, s0, m1, s1, lo, hi = df.agg(on(F.avg, ref), on(F.stddev_pop, ref), on(F.avg, ~ref), on(F.stddev_pop, ~ref), on(F.min, ref), on(F.max, ref)).first()
    out = (x - m1) * (s0 / s1 if s1 else 1.0) + m0
    return F.greatest(F.least(out, F.lit(float(hi))), F.lit(float(lo))) if clip else out


def quantile_alignment(df: DataFrame, score: str, is_reference: Column, n_quantiles: int = 100) -> Column:
    """Map quantiles of the current scores to those of the reference, linearly in between."""
    probs = [i / n_quantiles for i in range(n_quantiles + 1)]
    a, b = quantile_edges(df.where(~is_reference), score, probs), quantile_edges(df.where(is_reference), score, probs)
    points = sorted({x: y for x, y in zip(a, b)}.items())
    x = F.col(score)
    out = F.lit(points[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(points, points[1:]))):
        out = F.when(x < x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0))).otherwise(out)
    return F.when(x < points[0][0], points[0][1]).otherwise(out)


def recalibrated_probability(df: DataFrame, p: str, label: str, is_reference: Column, n_bins: int = 10) -> Column:
    """Shift log odds per bin by the difference of reference and current bad rates."""
    from .binning import fit_binning

    model = fit_binning(df.where(is_reference), p, method="quantile", max_n_bins=n_bins)
    rows = df.where(F.col(label).isNotNull()).groupBy(model.index().alias("bin")).agg(F.avg(F.when(is_reference, F.col(label))).alias("r0"), F.avg(F.when(~is_reference, F.col(label))).alias("r1")).collect()
    lo = lambda r: math.log(min(max(r, 1e-6), 1 - 1e-6) / (1 - min(max(r, 1e-6), 1 - 1e-6)))
    shift = {r["bin"]: lo(r["r0"]) - lo(r["r1"]) for r in rows if r["r0"] is not None and r["r1"] is not None}
    q = clip_probability(F.col(p))
    return 1 / (1 + F.exp(-(F.log(q / (1 - q)) + model.value(shift))))


def drift_distance(df: DataFrame, score: str, is_reference: Column) -> DataFrame:
    """KS and Wasserstein distance of two samples of a score."""
    from .metrics import by_score, cumulate

    c = cumulate(by_score(df.withColumn("_s", is_reference.cast("int")), "_s", score), descending=False)
    gap = F.abs(F.try_divide(F.col("cum_bad"), F.col("total_bad")) - F.try_divide(F.col("cum_n") - F.col("cum_bad"), F.col("total_n") - F.col("total_bad")))
    return c.agg(F.max(gap).alias("ks"), F.sum(gap * F.coalesce(F.col("next_score") - F.col("score"), F.lit(0.0))).alias("wasserstein"))


def compare_alignments(df: DataFrame, score: str, is_reference: Column, n_quantiles: int = 100) -> DataFrame:
    """(method, ks, wasserstein) of the current scores against the reference: as they are, and after each alignment."""
    ref, out = F.coalesce(is_reference, F.lit(False)), None
    for name, column in (("none", F.col(score)), ("linear", linear_alignment(df, score, ref)), ("quantile", quantile_alignment(df, score, ref, n_quantiles))):
        moved = df.select(F.when(ref, F.col(score)).otherwise(column).alias("_aligned"), ref.alias("_ref"))
        part = drift_distance(moved, "_aligned", F.col("_ref"))
        part = part.select(F.lit(name).alias("method"), *part.columns)
        out = part if out is None else out.unionAll(part)
    return out


def compare_transforms(df: DataFrame, p: str, transforms: dict[str, object]) -> DataFrame:
    """(transform, mean, std, min, max, correlation with p) of fitted score transforms, from one scan."""
    names = list(transforms)
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("transform"), transforms[n].score(F.col(p)).cast("double").alias("s")) for n in names]))
    rows = df.select(F.col(p).alias("_p"), cells.alias("c")).select("_p", "c.transform", "c.s")
    return rows.groupBy("transform").agg(F.avg("s").alias("mean"), F.stddev_pop("s").alias("std"), F.min("s").alias("min"), F.max("s").alias("max"), F.corr("s", "_p").alias("correlation"))
