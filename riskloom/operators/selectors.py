"""Feature selection: statistics in one or two scans, decisions on the driver."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import clean
from . import bin_stats, metrics, stability
from .binning import Counts, fit_many


@dataclass
class Selection:
    """What one step kept and dropped, with its scores."""

    name: str
    kept: list[str]
    dropped: list[str]
    scores: dict[str, float] = field(default_factory=dict)

    def apply(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.dropped)


def _decide(name: str, scores: dict[str, float], keep: Callable[[float], bool], include: list[str] | None = None, exclude: list[str] | None = None) -> Selection:
    """``include`` is forced back, then ``exclude`` is applied."""
    ok = {f for f, s in scores.items() if s is not None and keep(s)} | {*(include or [])}
    ok -= {*(exclude or [])}
    return Selection(name, [f for f in scores if f in ok], [f for f in scores if f not in ok], scores)


def _one_row(df: DataFrame, features: list[str], what: Callable[[str], Column]) -> dict[str, float]:
    row = df.agg(*[what(f).alias(f"s{i}") for i, f in enumerate(features)]).first()
    return {f: None if row[i] is None else float(row[i]) for i, f in enumerate(features)}


def _missing(df: DataFrame, f: str) -> Column:
    c = F.col(f"`{f}`")
    return c.isNull() | F.isnan(c) if dict(df.dtypes)[f] in ("double", "float") else c.isNull()


def value_counts(df: DataFrame, features: list[str], label: str | None = None) -> DataFrame:
    """(feature, s, x, n, m, bad): all rows, labelled rows and bad rows of every distinct value, missing ones included, from one scan and one exchange.

    ``x`` is the value of a numeric feature as a double, ``s`` the text of one whose values a double may not tell apart.
    """
    types, y = dict(df.dtypes), F.lit(None).cast("long") if label is None else F.col(label).cast("long")

    def cell(i: int, f: str) -> Column:
        c, t = F.col(f"`{f}`"), types[f]
        exact = t in ("double", "float", "tinyint", "smallint", "int")
        number = exact or t == "bigint" or t.startswith("decimal")
        return F.struct(F.lit(i).alias("f"), (F.lit(None) if exact else c).cast("string").alias("s"), (c if number else F.lit(None)).cast("double").alias("x"))

    rows = df.select(y.alias("_y"), F.explode(F.array(*[cell(i, f) for i, f in enumerate(features)])).alias("c"))
    per = rows.groupBy("c.f", "c.s", "c.x").agg(F.count("*").alias("n"), F.count("_y").alias("m"), F.coalesce(F.sum("_y"), F.lit(0)).alias("bad"))
    return per.select(F.array(*[F.lit(f) for f in features])[F.col("f")].alias("feature"), "s", "x", "n", "m", "bad")


def by_missing(df, features, threshold=0.95, values: DataFrame | None = None, **kw) -> Selection:
    if values is not None:
        gone = F.sum(F.when(F.col("s").isNull() & (F.col("x").isNull() | F.isnan("x")), F.col("n")).otherwise(0))
        found = {r["feature"]: r["share"] for r in values.groupBy("feature").agg((gone / F.sum("n")).alias("share")).collect()}
        return _decide("missing", {f: found.get(f) for f in features}, lambda s: s < threshold, **kw)
    return _decide("missing", _one_row(df, features, lambda f: F.avg(_missing(df, f).cast("double"))), lambda s: s < threshold, **kw)


def mode_shares(df: DataFrame, features: list[str], values: DataFrame | None = None) -> DataFrame:
    """(feature, share of the most frequent value among those present), from ``value_counts`` if they are given."""
    counts = (value_counts(df, features) if values is None else values).where("s IS NOT NULL OR x IS NOT NULL")
    return counts.groupBy("feature").agg((F.max("n") / F.sum("n")).alias("share"))


def by_mode(df, features, threshold=0.95, values: DataFrame | None = None, **kw) -> Selection:
    found = {r["feature"]: r["share"] for r in mode_shares(df, features, values).collect()}
    return _decide("mode", {f: found.get(f, 1.0) for f in features}, lambda s: s < threshold, **kw)


def by_cardinality(df, features, threshold=10, **kw) -> Selection:
    return _decide("cardinality", _one_row(df, features, lambda f: F.count_distinct(F.col(f"`{f}`"))), lambda s: s <= threshold, **kw)


def by_variance(df, features, threshold=0.0, **kw) -> Selection:
    return _decide("variance", _one_row(df, features, lambda f: F.least(F.var_pop(clean(f)), F.max(clean(f)) - F.min(clean(f))) if threshold == 0 else F.var_pop(clean(f))), lambda s: s > threshold, **kw)


def by_type(df, features, include_types: list[str] | None = None, exclude_types: list[str] | None = None, **kw) -> Selection:
    types = dict(df.dtypes)
    score = {f: float((include_types is None or types[f] in include_types) and types[f] not in (exclude_types or [])) for f in features}
    return _decide("type", score, lambda s: s > 0, **kw)


def by_name(df, features, pattern: str, **kw) -> Selection:
    return _decide("name", {f: float(bool(re.search(pattern, f))) for f in features}, lambda s: s > 0, **kw)


def raw_iv(df: DataFrame, features: list[str], label: str, regularization: float = 1.0, values: DataFrame | None = None) -> DataFrame:
    """(feature, iv) over raw distinct values: +r per value, values of a single row count nothing."""
    per = (value_counts(df.where(F.col(label).isNotNull()), features, label) if values is None else values).where("(s IS NOT NULL OR x IS NOT NULL) AND m > 0")
    per = per.select("feature", F.col("m").alias("n"), "bad")
    totals = per.groupBy("feature").agg(F.sum("bad").alias("tb"), F.sum(F.col("n") - F.col("bad")).alias("tg"))  # a row per feature
    r = float(regularization)
    pb, pg = (F.col("bad") + r) / (F.col("tb") + r), (F.col("n") - F.col("bad") + r) / (F.col("tg") + r)
    term = F.when(F.col("n") > 1, (pb - pg) * F.log(pb / pg)).otherwise(0.0)
    return per.join(F.broadcast(totals), "feature").groupBy("feature").agg(F.sum(term).alias("iv"))


def by_iv(df, features, label, threshold=0.02, regularization=1.0, values: DataFrame | None = None, **kw) -> Selection:
    found = {r["feature"]: r["iv"] for r in raw_iv(df, features, label, regularization, values).collect()}
    return _decide("iv", {f: found.get(f, 0.0) for f in features}, lambda s: s >= threshold, **kw)


def by_lift(df, features, label, threshold=0.5, ratio=0.1, **kw) -> Selection:
    """Better of the lifts of the highest and the lowest share ``ratio`` of rows."""
    score = {}
    for f in features:
        both = [metrics.lift_at(df.withColumn("_s", clean(f)), label, "_s", [ratio], ascending=a).collect() for a in (False, True)]
        score[f] = max((r[0]["lift"] for r in both if r), default=0.0)
    return _decide("lift", score, lambda s: s >= threshold, **kw)


def by_psi(df, features, key: str, threshold=0.25, n_splits=5, n_bins=10, **kw) -> Selection:
    """Mean PSI of folds against the rest; folds by a hash of ``key``."""
    models = stability.pooled_models(df, features, n_bins)
    fold = F.pmod(F.xxhash64(F.col(key)), F.lit(n_splits))
    sums: dict[str, float] = dict.fromkeys(features, 0.0)
    for k in range(n_splits):
        for r in stability.batch_psi(df, models, fold == k).collect():
            sums[r["feature"]] += r["psi"] / n_splits
    return _decide("psi", sums, lambda s: s < threshold, **kw)


def correlation_matrix(df: DataFrame, features: list[str], method: str = "pearson") -> np.ndarray:
    """Pairwise-complete Pearson (or Spearman, over mean ranks) correlations from one aggregate."""
    if method == "spearman":
        df = with_mean_ranks(df.select(*[F.col(f"`{f}`") for f in features]), features)
    k = len(features)
    pairs = [(i, j) for i in range(k) for j in range(i + 1, k)]
    out = np.eye(k)
    for lo in range(0, len(pairs), 500):
        part = pairs[lo : lo + 500]
        row = df.agg(*[F.corr(clean(features[i]), clean(features[j])).alias(f"c{n}") for n, (i, j) in enumerate(part)]).first()
        for n, (i, j) in enumerate(part):
            out[i, j] = out[j, i] = np.nan if row[n] is None else row[n]
    return out


def with_mean_ranks(df: DataFrame, features: list[str]) -> DataFrame:
    """Values replaced by their mean ranks: distinct values are counted and cumulated by ranges, and joined back."""
    for f in features:
        x = clean(f)
        counts = df.where(x.isNotNull()).groupBy(x.alias("score")).agg(F.count("*").alias("n"), F.lit(0).alias("bad"))
        ranks = metrics.cumulate(counts, descending=False).select(F.col("score").alias("_v"), (F.col("cum_n") - (F.col("n") - 1) / 2).alias("_r"))
        df = df.withColumn("_v", x).join(ranks, "_v", "left").drop("_v", f).withColumnRenamed("_r", f)
    return df


def _mean_rank(c: Column) -> Column:
    """Mean rank over a table of a few rows (bins)."""
    w = Window.partitionBy(F.lit(0)).orderBy(c)
    return F.when(c.isNotNull(), F.rank().over(w) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2)


def by_correlation(df, features, label=None, threshold=0.7, weights: dict[str, float] | None = None, method="pearson", greedy=True, counted: Counts | None = None, **kw) -> Selection:
    """Of each pair above ``threshold`` the feature of lower weight (IV by default) goes; ``greedy`` ignores features already gone."""
    if weights is None:
        table = bin_stats.batch_iv(df, fit_many(df, features, label, method="cart", counted=counted), label, counted).collect() if label else []
        weights = {r["feature"]: r["iv"] for r in table}
    m, gone, worst = np.abs(correlation_matrix(df, features, method)), set(), {}
    order = sorted(range(len(features)), key=lambda i: (-weights.get(features[i], 0.0), i))
    for a, i in enumerate(order):
        for j in order[a + 1 :]:
            if m[i, j] > threshold and not (greedy and (i in gone or j in gone)):
                gone.add(j)
    for i, f in enumerate(features):
        worst[f] = float(np.nanmax(np.delete(m[i], i))) if len(features) > 1 else 0.0
    s = _decide("correlation", {f: float(i not in gone) for i, f in enumerate(features)}, lambda v: v > 0, **kw)
    s.scores = worst
    return s


def vif(df: DataFrame, features: list[str]) -> dict[str, float]:
    """Variance inflation: diagonal of the inverse correlation matrix; infinite where columns depend on each other."""
    m = np.nan_to_num(correlation_matrix(df, features), nan=0.0)
    out = {}
    for i, f in enumerate(features):
        rest = np.delete(np.arange(len(features)), i)
        if not len(rest):
            out[f] = 1.0
            continue
        b, *_ = np.linalg.lstsq(m[np.ix_(rest, rest)], m[rest, i], rcond=1e-10)
        r2 = float(b @ m[rest, i])
        out[f] = float("inf") if r2 > 1 - 1e-10 else 1 / (1 - r2)
    return out


def by_vif(df, features, threshold=4.0, max_iter=100, **kw) -> Selection:
    """Drop the largest VIF over ``threshold``, one at a time; the matrix is aggregated once."""
    m = np.nan_to_num(correlation_matrix(df, features), nan=0.0)
    left, scores = list(range(len(features))), {}
    for _ in range(max_iter):
        values = {}
        for i in left:
            rest = [j for j in left if j != i]
            if rest:
                b, *_ = np.linalg.lstsq(m[np.ix_(rest, rest)], m[rest, i], rcond=1e-10)
                r2 = float(b @ m[rest, i])
                values[i] = float("inf") if r2 > 1 - 1e-10 else 1 / (1 - r2)
            else:
                values[i] = 1.0
        scores |= {features[i]: v for i, v in values.items()}
        worst = max(left, key=lambda i: (values[i], i), default=None)
        if worst is None or values[worst] <= threshold:
            break
        left.remove(worst)
    s = _decide("vif", {f: float(i in left) for i, f in enumerate(features)}, lambda v: v > 0, **kw)
    s.scores = scores
    return s


def _top(name: str, scores: dict[str, float], threshold: float, k: int | str, **kw) -> Selection:
    if k == "all":
        return _decide(name, scores, lambda s: s >= threshold, **kw)
    best = {*sorted(scores, key=lambda f: -scores[f])[: int(k)]}
    s = _decide(name, {f: float(f in best) for f in scores}, lambda v: v > 0, **kw)
    s.scores = scores
    return s


def by_chi2(df, features, label, threshold=0.0, k="all", **kw) -> Selection:
    return _top("chi2", {r["feature"]: r["chi2"] for r in metrics.class_sum_chi2(df, features, label).collect()}, threshold, k, **kw)


def by_f_test(df, features, label, threshold=0.0, k="all", **kw) -> Selection:
    return _top("f_test", {r["feature"]: r["f"] for r in metrics.f_test(df, features, label).collect()}, threshold, k, **kw)


def mutual_information(df: DataFrame, features: list[str], label: str, n_bins: int = 10) -> DataFrame:
    """(feature, mi) in nats over quantile bins."""
    models = stability.pooled_models(df, features, n_bins)
    c = bin_stats.batch_counts(df, models, label, [])
    long = c.select("feature", "bin", F.explode(F.array(F.struct(F.lit(1).alias("y"), F.col("bad").alias("o")), F.struct(F.lit(0).alias("y"), (F.col("n") - F.col("bad")).alias("o")))).alias("e")).select("feature", "bin", "e.y", "e.o").where("o > 0")
    w = Window.partitionBy
    t = long.select("feature", "o", F.sum("o").over(w("feature")).alias("n"), F.sum("o").over(w("feature", "bin")).alias("r"), F.sum("o").over(w("feature", "y")).alias("c"))
    return t.groupBy("feature").agg(F.sum(F.col("o") / F.col("n") * F.log(F.col("o") * F.col("n") / (F.col("r") * F.col("c")))).alias("mi"))


def by_mutual_information(df, features, label, threshold=0.0, k="all", **kw) -> Selection:
    return _top("mutual_information", {r["feature"]: r["mi"] for r in mutual_information(df, features, label).collect()}, threshold, k, **kw)


def importances(df: DataFrame, features: list[str], label: str, estimator=None, seed: int = 42) -> dict[str, float]:
    """Importances of any ``pyspark.ml`` classifier that gives them (a random forest by default)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    est = estimator or RandomForestClassifier(numTrees=20, maxDepth=5, seed=seed)
    est = est.copy().setFeaturesCol("_x").setLabelCol(label)
    data = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip").transform(df.select(label, *features)).select(label, "_x")
    model = est.fit(data)
    values = model.featureImportances.toArray() if hasattr(model, "featureImportances") else np.abs(np.asarray(model.coefficients.toArray()))
    return dict(zip(features, map(float, values)))


def by_importance(df, features, label, threshold=0.0, estimator=None, **kw) -> Selection:
    return _decide("importance", importances(df, features, label, estimator), lambda s: s >= threshold, **kw)


def blocks_of(n: int, rows: int = 500_000) -> int:
    """How many hash blocks ``n`` rows are permuted in: 64, and more where they would hold over ``rows``."""
    return max(64, -(-n // rows))


def _permuted(df: DataFrame, columns: list[str], names: list[str], key: str, seed: int, blocks: int = 64) -> DataFrame:
    """``df`` with shuffled copies of columns: rows are paired with others by rank of two hashes of the key inside hash blocks.

    Rows of one key stand in order of a hash of the row.  One exchange; a block is one Arrow table.
    """
    hashed = {"_b": F.pmod(F.xxhash64(F.col(key), F.lit(0)), F.lit(blocks)), "_to": F.xxhash64(F.col(key), F.lit(seed)), "_from": F.xxhash64(F.col(key), F.lit(seed + 1)), "_row": F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])}
    own = df.columns

    def deal(block: pa.Table) -> pa.Table:
        tie = block["_row"].to_numpy()
        place = np.empty(len(tie), np.int64)
        place[np.lexsort((tie, block["_to"].to_numpy()))] = np.lexsort((tie, block["_from"].to_numpy()))
        out = block.select(own)
        for c, n in zip(columns, names):
            out = out.append_column(n, block[c].take(pa.array(place)))
        return out

    schema = T.StructType([*df.schema.fields, *[T.StructField(n, df.schema[c].dataType) for c, n in zip(columns, names)]])
    return df.withColumns(hashed).groupBy("_b").applyInArrow(deal, schema)


def by_null_importance(df, features, label, key, threshold=1.0, n_runs=3, estimator=None, **kw) -> Selection:
    """Importance against the mean importance under shuffled labels."""
    df = df.select(*dict.fromkeys([key, label, *features]))
    real, blocks = importances(df, features, label, estimator), blocks_of(df.count())
    null = dict.fromkeys(features, 0.0)
    for run in range(n_runs):
        for f, v in importances(_permuted(df, [label], ["_y"], key, 10 + 2 * run, blocks), features, "_y", estimator).items():
            null[f] += v / n_runs
    return _decide("null_importance", {f: real[f] / (null[f] + 1e-12) for f in features}, lambda s: s > threshold, **kw)


def by_shadow(df, features, label, key, rounds=5, **kw) -> Selection:
    """Shadow-feature test: keep what beats the best shuffled copy in more than half the rounds."""
    wins = dict.fromkeys(features, 0)
    names = [f"_shadow{i}" for i in range(len(features))]
    df = df.select(*dict.fromkeys([key, label, *features]))
    blocks = blocks_of(df.count())
    for r in range(rounds):
        found = importances(_permuted(df, features, names, key, 100 + 2 * r, blocks), [*features, *names], label, seed=r)
        best = max(found[n] for n in names)
        for f in features:
            wins[f] += found[f] > best
    return _decide("shadow", {f: w / rounds for f, w in wins.items()}, lambda s: s > 0.5, **kw)


def by_elimination(df, features, label, n_keep=10, step=1, estimator=None, **kw) -> Selection:
    """Drop the ``step`` least important features again and again until ``n_keep`` are left."""
    left, rank = list(features), {}
    while len(left) > n_keep:
        found = importances(df, left, label, estimator)
        for f in sorted(left, key=lambda f: found[f])[: min(step, len(left) - n_keep)]:
            rank[f] = float(len(left))
            left.remove(f)
    s = _decide("elimination", {f: float(f in left) for f in features}, lambda v: v > 0, **kw)
    s.scores = {f: rank.get(f, 1.0) for f in features}
    return s


def stepwise(df: DataFrame, features: list[str], label: str, criterion: str = "aic", direction: str = "both", max_features: int | None = None) -> tuple[list[str], list[dict]]:
    """Stepwise logistic regression by AIC or BIC: (selected, history)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    n = df.count()
    cached = df.select(F.col(label).cast("double").alias(label), *features).na.drop().persist()

    def cost(own: list[str]) -> float:
        if not own:
            p = cached.agg(F.avg(label)).first()[0]
            return -2 * n * (p * np.log(p) + (1 - p) * np.log(1 - p)) + (2 if criterion == "aic" else np.log(n))
        data = VectorAssembler(inputCols=own, outputCol="_x").transform(cached)
        s = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="_x", labelCol=label, maxIter=50).fit(data).summary
        return s.aic if criterion == "aic" else s.aic + (np.log(n) - 2) * (len(own) + 1)

    chosen: list[str] = [] if direction != "backward" else list(features)
    current, history = cost(chosen), []
    try:
        while True:
            trials = []
            if direction in ("both", "forward") and (max_features is None or len(chosen) < max_features):
                trials += [("add", f, [*chosen, f]) for f in features if f not in chosen]
            if direction in ("both", "backward"):
                trials += [("remove", f, [g for g in chosen if g != f]) for f in chosen]
            scored = [(cost(own), what, f, own) for what, f, own in trials]
            if not scored or min(scored)[0] >= current - 1e-9:
                return chosen, history
            current, what, f, chosen = min(scored)
            history.append({"step": len(history) + 1, "action": what, "feature": f, criterion: current})
    finally:
        cached.unpersist()


def by_sequence(df, features, label, n_keep: int | None = None, direction: str = "forward", folds: int = 3, key: str | None = None, metric: str = "auc", tolerance: float | None = None, estimator=None, **kw) -> Selection:
    """Sequential selection: add (or drop) the feature that gives the best mean metric over folds, until ``n_keep`` are left (half by default) or the gain is under ``tolerance``.

    Folds are by a hash of ``key`` (of the whole row without one); the scores are the metric when a feature was added or dropped.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    est = (estimator or LogisticRegression(regParam=1e-4)).copy().setFeaturesCol("_x").setLabelCol(label)
    own = F.xxhash64(F.col(key)) if key else F.xxhash64(*[F.col(f"`{c}`") for c in (label, *features)])
    data = df.select(F.pmod(own, F.lit(folds)).alias("_fold"), F.col(label).cast("double").alias(label), *features).na.drop().persist()
    want = n_keep if n_keep is not None else max(1, len(features) // 2)

    def quality(chosen: list[str]) -> float:
        rows, found = VectorAssembler(inputCols=chosen, outputCol="_x").transform(data), []
        for k in range(folds):
            out = est.fit(rows.where(F.col("_fold") != k)).transform(rows.where(F.col("_fold") == k))
            found.append(metrics.ks_auc_row(out.select(label, vector_to_array("probability")[1].alias("_p")), label, "_p")[metric] or 0.0)
        return float(np.mean(found))

    forward = direction == "forward"
    chosen, scores, current = ([] if forward else list(features)), {}, -np.inf if forward else quality(list(features))
    try:
        while len(chosen) < want if forward else len(chosen) > want:
            trials = [(quality([*chosen, f] if forward else [g for g in chosen if g != f]), f) for f in features if (f not in chosen) == forward]
            best, f = max(trials, key=lambda x: (x[0], -features.index(x[1])))
            if tolerance is not None and best - current < tolerance:
                break
            chosen, current, scores[f] = [*chosen, f] if forward else [g for g in chosen if g != f], best, best
    finally:
        data.unpersist()
    s = _decide("sequence", {f: float(f in chosen) for f in features}, lambda v: v > 0, **kw)
    s.scores = {f: scores.get(f) for f in features}
    return s


def by_stability(df, features, label, is_later: Column, iv_threshold=0.02, psi_threshold=0.25, iv_weight=0.6, psi_weight=0.4, score_threshold=0.0, **kw) -> Selection:
    """iv_weight * IV / largest IV - psi_weight * PSI / largest PSI, among features that pass both thresholds."""
    models = stability.pooled_models(df, features)
    ivs = {r["feature"]: r["iv"] for r in bin_stats.batch_iv(df, models, label).collect()}
    psis = {r["feature"]: r["psi"] for r in stability.batch_psi(df, models, is_later).collect()}
    top_iv, top_psi = max(ivs.values(), default=1) or 1, max(psis.values(), default=1) or 1
    score = {f: iv_weight * ivs[f] / top_iv - psi_weight * psis[f] / top_psi if ivs[f] >= iv_threshold and psis[f] < psi_threshold else None for f in features}
    return _decide("stability", score, lambda s: s > score_threshold, **kw)


def staged(df: DataFrame, features: list[str], label: str, null_threshold=0.95, mode_threshold=0.95, iv_threshold=0.02, corr_threshold=0.7) -> tuple[list[str], list[Selection]]:
    """Missing, mode, IV and correlation screens in turn."""
    left, steps = list(features), []
    values = value_counts(df, features, label).persist()  # what all but the correlations need
    counted = Counts.of(values.select("feature", clean("x").alias("x"), "n", "m", "bad"))
    try:
        for step in (
            lambda f: by_missing(df, f, null_threshold, values), lambda f: by_mode(df, f, mode_threshold, values), lambda f: by_iv(df, f, label, iv_threshold, values=values),
            lambda f: by_correlation(df, f, label, corr_threshold, counted=counted),
        ):
            if left:
                steps.append(step(left))
                left = steps[-1].kept
    finally:
        values.unpersist()
    return left, steps


def vote(selections: list[Selection], least: int | None = None) -> list[str]:
    """Features that at least ``least`` (a majority) of the selections keep."""
    need = least if least is not None else len(selections) // 2 + 1
    every = list(dict.fromkeys(f for s in selections for f in [*s.kept, *s.dropped]))
    return [f for f in every if sum(f in s.kept for s in selections) >= need]


def report(spark, selections: list[Selection]) -> DataFrame:
    rows = [(i, s.name, f, f in s.kept, None if s.scores.get(f) is None else float(s.scores[f])) for i, s in enumerate(selections, 1) for f in [*s.kept, *s.dropped]]
    return spark.createDataFrame(rows, "step int, name string, feature string, kept boolean, score double")
