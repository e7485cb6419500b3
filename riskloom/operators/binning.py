"""Binning: models, assignment Columns, and a facade over all search methods.

A model is a few numbers on the driver; assigning bins is one Column
expression.  Fitting any number of features reads the data twice at most: once
for the candidate edges of all of them (exact percentiles at any size, see
``ranks``) and once for their histograms (feature, bin, rows, bad rows), which
have as many rows as there are candidates.  Searches run on those on the
driver.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from contextlib import nullcontext
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import clean
from . import ranks, search
from .ranks import bucket

MISSING, SPECIAL = -1, -2


@dataclass
class BinModel:
    """Bins of one feature: [a, b) intervals between ``splits``, or groups of categories; missing is -1, special codes -2."""

    feature: str
    splits: list[float] = field(default_factory=list)
    groups: list[list[str]] | None = None
    special: list[float] = field(default_factory=list)
    missing_separate: bool = True
    unknown: int = 0  # bin of categories that no group lists: those too rare to be listed, and those not seen in fitting
    method: str = "user"

    @property
    def n_bins(self) -> int:
        return len(self.groups) if self.groups is not None else len(self.splits) + 1

    def index(self, col: Column | None = None) -> Column:
        """Bin number: how many splits are at or under the value; no Python on the executors."""
        missing = F.lit(MISSING if self.missing_separate else 0)
        if self.groups is not None:
            c = (F.col(f"`{self.feature}`") if col is None else col).cast("string")
            out = F.when(c.isNull(), missing)
            for i, values in enumerate(self.groups):
                out = out.when(c.isin(*values), i) if values else out
            return out.otherwise(self.unknown).cast("int")
        x = clean(F.col(f"`{self.feature}`") if col is None else col)
        out = F.when(x.isNull(), missing)
        if self.special:
            out = out.when(x.isin(*[float(s) for s in self.special]), SPECIAL)
        return out.otherwise(bucket(x, self.splits)).cast("int")

    def labels(self) -> dict[int, str]:
        if self.groups is not None:
            own = {i: ",".join(g) if g else "other" for i, g in enumerate(self.groups)}
        else:
            edges = ["-inf", *[f"{s:.10g}" for s in self.splits], "+inf"]
            own = {i: f"[{a}, {b})" for i, (a, b) in enumerate(zip(edges, edges[1:]))}
        return own | {MISSING: "missing", SPECIAL: "special"}

    def label(self, index: Column) -> Column:
        out = F.when(F.lit(False), "")
        for i, text in self.labels().items():
            out = out.when(index == i, text)
        return out

    def value(self, values: dict[int, float], index: Column | None = None, default: float = 0.0) -> Column:
        """Bin number mapped to a value (such as WOE), keyed by the bin, not by a row position."""
        i = self.index() if index is None else index
        out = F.when(F.lit(False), 0.0)
        for b, v in values.items():
            out = out.when(i == b, float(v))
        return out.otherwise(float(default))

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> BinModel:
        return cls(**json.loads(text))


def order_key(index: Column) -> Column:
    """Normal bins, then missing, then special."""
    return F.when(index >= 0, index).when(index == MISSING, 10_000_000).otherwise(20_000_000)


def cells_of(df: DataFrame, features: list[str], special: list[float] | None = None, keep: list[str] | None = None) -> DataFrame:
    """(keep..., feature, x) rows of all features from one scan; special codes and missing values have no x."""
    x = lambda f: F.when(clean(F.col(f"`{f}`")).isin(*map(float, special)), None).otherwise(clean(F.col(f"`{f}`"))) if special else clean(F.col(f"`{f}`"))
    return df.select(*(keep or []), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), x(f).alias("x")) for f in features])).alias("c")).select(*(keep or []), "c.feature", "c.x")


def all_edges(df: DataFrame, features: list[str], probabilities: list[float], special: list[float] | None = None) -> dict[str, list[float]]:
    """Exact percentiles with linear interpolation of every feature that has values, in one job."""
    return {r["feature"]: list(r["q"]) for r in ranks.percentiles(cells_of(df, features, special), ["feature"], probabilities).collect()}


def quantile_edges(df: DataFrame, feature: str, probabilities: list[float], special: list[float] | None = None) -> list[float]:
    """Exact percentiles with linear interpolation, at any number of distinct values; empty without values."""
    return all_edges(df, [feature], probabilities, special).get(feature, []) if probabilities else []


@dataclass
class Histogram:
    """Rows and bad rows of the cells between candidate edges, and of missing values."""

    edges: np.ndarray
    n: np.ndarray
    bad: np.ndarray

    @property
    def good(self) -> np.ndarray:
        return self.n - self.bad

    def merged(self, edges: list[float]) -> Histogram:
        """The histogram of some of the edges."""
        place = np.searchsorted(np.array(edges, float), [-np.inf, *self.edges], side="right")
        return Histogram(np.array(edges, float), *(np.bincount(place, w, len(edges) + 1) for w in (self.n, self.bad)))


def histogram(df: DataFrame, feature: str, label: str | None, edges: list[float], special: list[float] | None = None) -> Histogram:
    return histograms(df, {feature: edges}, label, special)[feature]


def histograms(df: DataFrame, edges: dict[str, list[float]], label: str | None, special: list[float] | None = None, counted: Counts | None = None) -> dict[str, Histogram]:
    """The histograms of many features from one scan, or from counted values."""
    models = {f: BinModel(f, sorted(set(e)), special=special or []) for f, e in edges.items()}
    out = {f: Histogram(np.array(m.splits), np.zeros(m.n_bins), np.zeros(m.n_bins)) for f, m in models.items()}
    if not models:
        return out
    if counted is not None:
        for r in counted.rows(models):
            if r["bin"] >= 0:
                out[r["feature"]].n[r["bin"]], out[r["feature"]].bad[r["bin"]] = r["n"], r["bad"]
        return out
    y = F.lit(0) if label is None else F.col(label)
    place = {f: i for i, f in enumerate(models)}
    bins = F.array(*[F.struct(F.lit(place[f]).alias("f"), m.index().alias("b")) for f, m in models.items()])
    rows = df.select(F.explode(bins).alias("c"), y.alias("y")).select("c.f", "c.b", "y").where("b >= 0 AND y IS NOT NULL")
    names = list(models)
    for r in rows.groupBy("f", "b").agg(F.count("*").alias("n"), F.sum("y").alias("bad")).collect():
        h = out[names[r["f"]]]
        h.n[r["b"]], h.bad[r["b"]] = r["n"], r["bad"]
    return out


class Counts:
    """Distinct values of numeric features with all rows, labelled rows and bad rows of each, from one scan and one exchange.

    Percentiles, histograms and bin tables of any models then come from the
    counted values, which are kept (on disk where memory is short) inside a
    ``with`` block.
    """

    def __init__(self, df: DataFrame, features: list[str], label: str | None = None):
        y = F.lit(None).cast("long") if label is None else F.col(label).cast("long")
        cells = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), clean(F.col(f"`{f}`")).alias("x")) for i, f in enumerate(features)]))
        rows = df.select(y.alias("_y"), cells.alias("c")).select("_y", "c.f", "c.x")
        per = rows.groupBy("f", "x").agg(F.count("*").alias("n"), F.count("_y").alias("m"), F.coalesce(F.sum("_y"), F.lit(0)).alias("bad"))
        names = F.array(*[F.lit(f) for f in features])
        self.cells, self._edges, self._bins = per.select(names[F.col("f")].alias("feature"), "x", "n", "m", "bad"), {}, {}

    @classmethod
    def of(cls, cells: DataFrame) -> Counts:
        """Of counted values (feature, x, n, m, bad) that are kept already."""
        own = cls.__new__(cls)
        own.cells, own._edges, own._bins = cells, {}, {}
        return own

    def __enter__(self) -> Counts:
        self.cells = self.cells.persist()
        return self

    def __exit__(self, *_) -> None:
        self.cells.unpersist()

    def edges(self, features: list[str], probabilities: list[float], special: list[float] | None = None) -> dict[str, list[float]]:
        """As ``all_edges``; found once for the same question."""
        key = (tuple(features), tuple(probabilities), tuple(special or []))
        if key not in self._edges:
            rows = self.cells.where(F.col("feature").isin(*features))
            if special:
                rows = rows.where(~F.col("x").isin(*map(float, special)))
            self._edges[key] = {r["feature"]: list(r["q"]) for r in ranks.percentiles(rows, ["feature"], probabilities, "n").collect()}
        return self._edges[key]

    def binned(self, models: dict[str, BinModel]) -> DataFrame:
        """(feature, bin, rows, n, bad) of every bin that has rows; ``n`` and ``bad`` of labelled rows."""
        index = F.when(F.lit(False), 0)
        for f, m in models.items():
            index = index.when(F.col("feature") == f, m.index(F.col("x")))
        own = self.cells.where(F.col("feature").isin(*models)).groupBy("feature", index.alias("bin"))
        return own.agg(F.sum("n").alias("rows"), F.sum("m").alias("n"), F.sum("bad").alias("bad"))

    def rows(self, models: dict[str, BinModel]) -> list:
        """Rows of ``counts``; counted once for the same splits."""
        key = tuple((f, tuple(m.splits), tuple(m.special)) for f, m in models.items())
        if key not in self._bins:
            self._bins[key] = self.counts(models).collect()
        return self._bins[key]

    def counts(self, models: dict[str, BinModel]) -> DataFrame:
        """As ``bin_stats.batch_counts``."""
        return self.binned(models).where("n > 0").select("feature", "bin", "n", "bad")


def category_groups(df: DataFrame, features: list[str], label: str | None, max_n_bins: int, max_categories: int = 1000) -> dict[str, tuple[list[list[str]], int]]:
    """(groups, bin of all that no group lists) of text features, from one scan.

    With a label, categories in order of bad rate are cut by the search over
    that order; those beyond the ``max_categories`` most frequent ones count
    as one category of their own, so that no row is left out of the fit.
    Without one, the most frequent categories are bins, and if there are more
    than ``max_n_bins``, the last bin is for all others.
    """
    values = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`").cast("string").alias("v")) for f in features])
    y = F.lit(0) if label is None else F.col(label)
    rows = df.select(F.explode(values).alias("c"), y.alias("y")).select("c.feature", "c.v", "y").where("v IS NOT NULL AND y IS NOT NULL")
    per = rows.groupBy("feature", "v").agg(F.count("*").alias("n"), F.sum("y").alias("bad"))
    totals = {r["feature"]: r for r in per.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias("kinds")).collect()}
    top = max_categories if label is not None else max_n_bins
    order = Window.partitionBy("feature").orderBy(F.desc("n"), "v")  # a bounded number of rows of each feature, chosen before the exchange
    listed = per.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).collect()
    out: dict[str, tuple[list[list[str]], int]] = {f: ([], 0) for f in features}
    for f, total in totals.items():
        found = sorted((r for r in listed if r["feature"] == f), key=lambda r: r["place"])
        if label is None:
            rest = total["kinds"] > max_n_bins
            out[f] = [[r["v"]] for r in found[: max_n_bins - rest]] + [[]] * rest, max_n_bins - 1 if rest else 0
            continue
        cells = [(r["bad"] / r["n"], r["v"], r["n"], r["bad"]) for r in found]
        left = total["n"] - sum(c[2] for c in cells)
        if left:
            cells.append(((total["bad"] - sum(c[3] for c in cells)) / left, None, left, total["bad"] - sum(c[3] for c in cells)))
        cells.sort(key=lambda c: (c[0], c[1] is None, c[1] or ""))
        n, bad = np.array([c[2] for c in cells], float), np.array([c[3] for c in cells], float)
        cuts = search.best_dp(n, bad, max_n_bins, max(1.0, 0.01 * n.sum()))
        groups = [[c[1] for c in cells[a:b]] for a, b in zip([0, *cuts], [*cuts, len(cells)])]
        out[f] = [[v for v in g if v is not None] for g in groups], next((i for i, g in enumerate(groups) if None in g), 0)
    return out


METHODS: dict[str, Callable] = {
    "tree": search.tree, "cart": search.cart, "chi": search.chi_merge, "best_ks": search.best_ks, "best_iv": search.best_iv, "best_lift": search.best_lift, "mdlp": search.mdlp, "or": search.optimal,
    "kmeans": search.kmeans, "monotonic": search.monotonic, "genetic": search.genetic, "smooth": search.smooth, "kernel_density": search.kernel_density, "target_bad_rate": search.target_bad_rate,
}
ALL_METHODS = ["uniform", "quantile", *METHODS]


def fit_binning(
    df: DataFrame, feature: str, label: str | None = None, method: str = "mdlp", max_n_bins: int = 5, min_n_bins: int = 2, min_bin_size: float = 0.01, max_bin_size: float | None = None,
    min_bad_rate: float = 0.0, monotonic: str | bool = False, special: list[float] | None = None, missing_separate: bool = True, user_splits: list | None = None, n_candidates: int = 100,
    quantiles: list[float] | None = None, cat_cutoff: float | None = None, prebinning: list[float] | None = None, lift_refine: dict | None = None, **options,
) -> BinModel:
    """Fit bins by any method; numeric features get splits, text features groups.

    ``min_bin_size``/``max_bin_size`` under 1 are shares.  ``prebinning`` gives
    the candidate splits instead of percentiles.  After the search: size
    limits, monotone merge, size limits, bin limit; then, with ``lift_refine``
    (a dict of options of ``search.refine_lift``), the borders of the outer
    bins move to where head and tail lift are best.
    """
    special = special or []
    kind = dict(df.dtypes).get(feature)
    if kind is None:
        raise ValueError(f"no column {feature!r}")
    if user_splits is not None:
        if _is_text(df, feature, kind, cat_cutoff):
            groups = [[str(v) for v in (g if isinstance(g, (list, tuple, set)) else [g])] for g in user_splits]
            return BinModel(feature, groups=groups, missing_separate=missing_separate, method=method)
        return BinModel(feature, sorted({float(s) for s in user_splits}), special=special, missing_separate=missing_separate, method="user")
    return fit_many(
        df, [feature], label, method=method, max_n_bins=max_n_bins, min_n_bins=min_n_bins, min_bin_size=min_bin_size, max_bin_size=max_bin_size, min_bad_rate=min_bad_rate, monotonic=monotonic, special=special,
        missing_separate=missing_separate, n_candidates=n_candidates, quantiles=quantiles, cat_cutoff=cat_cutoff, prebinning=prebinning, lift_refine=lift_refine, **options,
    )[feature]


def _is_text(df: DataFrame, feature: str, kind: str, cat_cutoff: float | None) -> bool:
    return kind in ("string", "boolean") or bool(cat_cutoff) and df.agg(F.approx_count_distinct(feature)).first()[0] <= cat_cutoff


def fit_many(
    df: DataFrame, features: list[str], label: str | None = None, method: str = "mdlp", max_n_bins: int = 5, min_n_bins: int = 2, min_bin_size: float = 0.01, max_bin_size: float | None = None,
    min_bad_rate: float = 0.0, monotonic: str | bool = False, special: list[float] | None = None, missing_separate: bool = True, n_candidates: int = 100, quantiles: list[float] | None = None,
    cat_cutoff: float | None = None, prebinning: list[float] | None = None, lift_refine: dict | None = None, counted: Counts | None = None, **options,
) -> dict[str, BinModel]:
    """Fit many features as ``fit_binning`` does one, with the same number of scans as for one; none where numeric features have been ``counted`` with this label."""
    special, types, out = special or [], dict(df.dtypes), {}
    if method not in ALL_METHODS:
        raise ValueError(f"unknown method {method!r}; one of {ALL_METHODS}")
    if method in METHODS and label is None and any(types[f] not in ("string", "boolean") for f in features):
        raise ValueError(f"{method} needs a label")
    text = [f for f in features if _is_text(df, f, types[f], cat_cutoff)]
    numeric = [f for f in features if f not in text]
    if text:
        out = {f: BinModel(f, groups=g, unknown=u, missing_separate=missing_separate, method=method) for f, (g, u) in category_groups(df, text, label, max_n_bins).items()}
    own = lambda f, splits: BinModel(f, splits, special=special, missing_separate=missing_separate, method=method)
    if method == "uniform" and numeric:
        ends = {r["feature"]: (r["lo"], r["hi"]) for r in cells_of(df, numeric, special).groupBy("feature").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).collect()}
        n = max(min_n_bins, max_n_bins)
        for f in numeric:
            low, high = ends.get(f, (None, None))
            out[f] = own(f, [] if low is None or low == high else [low + (high - low) * i / n for i in range(1, n)])
    elif numeric:
        inner = (quantiles if quantiles is not None else [i / max_n_bins for i in range(1, max_n_bins)]) if method == "quantile" else [i / n_candidates for i in range(1, n_candidates)]
        if prebinning is not None:
            edges = {f: sorted({float(s) for s in prebinning}) for f in numeric}
        else:
            found = all_edges(df, numeric, [0.0, *inner], special) if counted is None else counted.edges(numeric, [0.0, *inner], special)
            edges = {f: sorted({s for s in found[f][1:] if s > found[f][0]}) if f in found else [] for f in numeric}
        if label is None:
            return {f: out.get(f) or own(f, edges[f]) for f in features}
        for f, h in histograms(df, {f: e for f, e in edges.items() if e}, label, special, counted).items():
            least = search.share(min_bin_size, h.n.sum())
            cuts = list(range(1, len(h.edges) + 1)) if method == "quantile" else METHODS[method](h.n, h.bad, max_n_bins, least, edges=h.edges, min_n_bins=min_n_bins, **options)
            cuts = search.constrain(h.n, h.bad, cuts, max_n_bins, least, None if max_bin_size is None else search.share(max_bin_size, h.n.sum()), monotonic, min_bad_rate)
            if lift_refine is not None:
                cuts = search.refine_lift(h.n, h.bad, cuts, least, min_n_bins=min_n_bins, max_n_bins=max_n_bins, monotone=monotonic, **lift_refine)
            out[f] = own(f, [float(h.edges[c - 1]) for c in cuts])
    return {f: out.get(f) or own(f, []) for f in features}


def auto_select(df: DataFrame, feature: str, label: str, methods: list[str] | None = None, metric: str = "iv", **options) -> tuple[BinModel, list[dict]]:
    """The model with the best IV or KS among ``methods``, and the comparison."""
    rows, best, methods = [], None, methods or ["quantile", "best_iv", "mdlp", "chi", "or"]
    text = feature in dict(df.dtypes) and _is_text(df, feature, dict(df.dtypes)[feature], options.get("cat_cutoff"))
    with nullcontext() if text else Counts(df, [feature], label) as counted:
        models = {m: fit_binning(df, feature, label, method=m, counted=counted, **options) for m in methods}
        wide = histograms(df, {feature: [s for m in models.values() for s in m.splits]}, label, options.get("special"), counted)[feature]
    for m, model in models.items():
        h = wide.merged(model.splits)
        row = {"method": m, "n_bins": model.n_bins, "iv": search.iv(h.n, h.bad), "ks": search.ks(h.n, h.bad), "monotone": search.is_monotone(h.bad / np.maximum(h.n, 1))}
        rows.append(row)
        if best is None or row[metric] > best[0]:
            best = row[metric], model
    return best[1], rows


def transform(df: DataFrame, models: dict[str, BinModel], suffix: str = "_bin", as_label: bool = False) -> DataFrame:
    """Add a bin (or bin label) column per model; no shuffle."""
    return df.withColumns({f"{f}{suffix}": m.label(m.index()) if as_label else m.index() for f, m in models.items()})
