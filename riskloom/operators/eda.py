"""Exploratory tables: quality, distributions, outliers, concentration, profiles over time and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from . import bin_stats, metrics, ranks, selectors, stability
from .binning import BinModel, Counts, fit_binning, fit_many

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in NUMERIC or t.startswith("decimal")]


def _cells(df: DataFrame, features: list[str], by: list[str] | None = None, numeric: bool = True) -> DataFrame:
    """Long rows (by..., feature, x): one scan for many columns."""
    types = dict(df.dtypes)
    number = lambda f: F.nanvl(F.col(f"`{f}`"), F.lit(None)) if types[f] in ("float", "double") else F.col(f"`{f}`")
    x = (lambda f: L.clean(f)) if numeric else (lambda f: number(f).cast("string"))
    return df.select(*(by or []), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), x(f).alias("x")) for f in features])).alias("c")).select(*(by or []), "c.feature", "c.x")


def data_info(df: DataFrame) -> DataFrame:
    """(column, type, n, missing, missing_rate, distinct_approx)."""
    types = dict(df.dtypes)
    row = df.agg(F.count("*"), *[x for c in df.columns for x in (F.count_if(selectors._missing(df, c)), F.approx_count_distinct(F.col(f"`{c}`")))]).first()
    n = row[0]
    return df.sparkSession.createDataFrame([(c, types[c], n, row[1 + 2 * i], row[1 + 2 * i] / n if n else 0.0, row[2 + 2 * i]) for i, c in enumerate(df.columns)], "column string, type string, n long, missing long, missing_rate double, distinct_approx long")


def missing_table(df: DataFrame, features: list[str] | None = None, threshold: float = 0.0) -> DataFrame:
    t = _cells(df, features or df.columns, numeric=False).groupBy("feature").agg(F.count("*").alias("n"), F.count_if(F.col("x").isNull()).alias("missing"))
    return t.withColumn("missing_rate", F.col("missing") / F.col("n")).where(F.col("missing_rate") >= threshold)


def describe(df: DataFrame, features: list[str], percentiles: list[float] | None = None, by: list[str] | None = None) -> DataFrame:
    """(by..., feature, n, missing, distinct, mean, std, min, max, p..): sample deviation, exact percentiles and distinct counts at any size."""
    ps, keys = percentiles or [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99], [*(by or []), "feature"]
    cells = _cells(df, features, by)
    t = cells.groupBy(*keys).agg(F.count("x").alias("n"), F.count_if(F.col("x").isNull()).alias("missing"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    kinds = ranks.value_counts(cells, keys).groupBy(*keys).agg(F.count("*").alias("distinct"))
    t = t.alias("a").join(ranks._few(keys, kinds.alias("b")), ranks._on("a", "b", keys), "left").select("a.*", "distinct")
    j = t.alias("a").join(ranks._few(keys, ranks.percentiles(cells, keys, ps).drop("n").alias("b")), ranks._on("a", "b", keys), "left")
    return j.select(*[F.col(f"a.{k}") for k in keys], "a.n", "missing", F.coalesce("distinct", F.lit(0)).alias("distinct"), "mean", "std", "min", "max", *[F.col("q")[i].alias(f"p{p * 100:g}".replace(".", "_")) for i, p in enumerate(ps)])


def moments(df: DataFrame, features: list[str], by: list[str] | None = None) -> DataFrame:
    """(by..., feature, skew, kurt) with the sample corrections."""
    n, s, k = F.col("n"), F.col("s"), F.col("k")
    t = _cells(df, features, by).groupBy(*(by or []), "feature").agg(F.count("x").alias("n"), F.skewness("x").alias("s"), F.kurtosis("x").alias("k"))
    return t.select(*(by or []), "feature", F.when(n > 2, s * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"), F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * k + 6)).alias("kurt"))


def categories(df: DataFrame, feature: str, top: int | None = None) -> DataFrame:
    """(value, n, share, cum_share), most frequent first."""
    t = df.groupBy(F.col(feature).cast("string").alias("value")).agg(F.count("*").alias("n"))
    total = df.count()
    t = t.withColumn("share", F.col("n") / F.lit(max(total, 1)))
    if top is not None:
        t = t.orderBy(F.desc("n"), "value").limit(top)
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "value").rowsBetween(Window.unboundedPreceding, 0)
    return t.withColumn("cum_share", F.sum("share").over(order))


def quality(df: DataFrame, features: list[str], missing_threshold: float = 0.5, constant_threshold: float = 0.95) -> DataFrame:
    """(feature, missing_rate, mode_share, distinct, flag)."""
    counts = _cells(df, features, numeric=False).groupBy("feature", "x").agg(F.count("*").alias("n"))
    t = counts.groupBy("feature").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("x").isNull(), F.col("n"))), F.lit(0)).alias("missing"), F.max("n").alias("mode"), F.count("x").alias("distinct"))
    rate, mode = F.col("missing") / F.col("n"), F.col("mode") / F.col("n")
    flag = F.when(rate > missing_threshold, "missing").when(F.col("distinct") <= 1, "constant").when(mode >= constant_threshold, "near constant").otherwise("ok")
    return t.select("feature", rate.alias("missing_rate"), mode.alias("mode_share"), "distinct", flag.alias("flag"))


def infer_types(df: DataFrame, categorical_threshold: int = 20) -> dict[str, str]:
    """constant, id (over 95 % distinct), datetime, numeric, categorical."""
    types = dict(df.dtypes)
    row = df.agg(F.count("*"), *[F.approx_count_distinct(F.col(f"`{c}`"), 0.01) for c in df.columns]).first()
    out = {}
    for i, c in enumerate(df.columns):
        d = row[1 + i]
        if d <= 1:
            out[c] = "constant"
        elif types[c].startswith(("timestamp", "date")):
            out[c] = "datetime"
        elif d > 0.95 * row[0] and types[c] not in ("double", "float"):
            out[c] = "id"
        else:
            out[c] = "numeric" if types[c] in NUMERIC and d > categorical_threshold else "categorical"
    return out


def numeric_distribution(df: DataFrame, feature: str, n_bins: int = 20) -> DataFrame:
    """(bin, n, share) of equal-width bins."""
    model = fit_binning(df, feature, method="uniform", max_n_bins=n_bins)
    t = df.where(L.clean(feature).isNotNull()).groupBy(model.index().alias("bin")).agg(F.count("*").alias("n"))
    return t.select("bin", "n", (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).alias("share"))


def outliers(df: DataFrame, features: list[str], method: str = "iqr", threshold: float | None = None) -> DataFrame:
    """(feature, lower, upper, n, outliers, rate) by iqr fences (1.5), z-score (3, sample deviation) or MAD (3.5, factor 0.6745)."""
    cells = _cells(df, features).where("x IS NOT NULL")
    quantiles = lambda rows, ps: ranks.percentiles(rows, ["feature"], ps)
    if method == "iqr":
        t = threshold if threshold is not None else 1.5
        fences = quantiles(cells, [0.25, 0.75]).select("feature", (F.col("q")[0] - t * (F.col("q")[1] - F.col("q")[0])).alias("lower"), (F.col("q")[1] + t * (F.col("q")[1] - F.col("q")[0])).alias("upper"))
    elif method == "zscore":
        t = threshold if threshold is not None else 3.0
        fences = cells.groupBy("feature").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s")).select("feature", (F.col("m") - t * F.col("s")).alias("lower"), (F.col("m") + t * F.col("s")).alias("upper"))
    elif method == "mad":
        t = threshold if threshold is not None else 3.5
        med = quantiles(cells, [0.5]).select("feature", F.col("q")[0].alias("m"))
        away = quantiles(cells.join(F.broadcast(med), "feature").select("feature", F.abs(F.col("x") - F.col("m")).alias("x")), [0.5])
        mad = med.join(away.select("feature", F.col("q")[0].alias("d")), "feature")
        fences = mad.select("feature", (F.col("m") - t / 0.6745 * F.col("d")).alias("lower"), (F.col("m") + t / 0.6745 * F.col("d")).alias("upper"))
    else:
        raise ValueError(f"unknown method {method!r}")
    out = (F.col("x") < F.col("lower")) | (F.col("x") > F.col("upper"))
    j = cells.join(F.broadcast(fences), "feature")  # one row per feature
    return j.groupBy("feature").agg(F.first("lower").alias("lower"), F.first("upper").alias("upper"), F.count("*").alias("n"), F.count_if(out).alias("outliers")).withColumn("rate", F.col("outliers") / F.col("n"))


def within_fences(df: DataFrame, features: list[str], multiplier: float = 1.5) -> DataFrame:
    """Rows inside the iqr fences of all features; missing values stay."""
    for r in outliers(df, features, "iqr", multiplier).collect():
        x = L.clean(r["feature"])
        df = df.where(x.isNull() | x.between(r["lower"], r["upper"]))
    return df


def rare_categories(df: DataFrame, features: list[str], threshold: float = 0.01) -> DataFrame:
    c = _cells(df, features, numeric=False).where("x IS NOT NULL").groupBy("feature", F.col("x").alias("value")).agg(F.count("*").alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("feature"))).where(F.col("share") < threshold)


def concentration(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, n, gini): Gini coefficient of the positive values, from counts of distinct values."""
    n, x = F.col("n"), F.col("x")
    cells = _cells(df, features).where("x > 0")
    c = ranks.running(ranks.value_counts(cells, ["feature"]), ["feature"], {"s": n * x}, cells)
    # sum over equal rows of the running total: n * before + x * n (n + 1) / 2
    part = n * (F.col("s") - n * x) + x * n * (n + 1) / 2
    t = c.groupBy("feature").agg(F.sum("n").alias("n"), F.max("s_total").alias("s"), F.sum(part).alias("cum"))
    return t.select("feature", "n", ((F.col("n") + 1 - 2 * F.col("cum") / F.col("s")) / F.col("n")).alias("gini"))


def stability_over_time(df: DataFrame, features: list[str], period: Column) -> DataFrame:
    """(feature, periods, mean, std, cv) of the period means."""
    t = _cells(df.withColumn("_p", period), features, ["_p"]).groupBy("feature", "_p").agg(F.avg("x").alias("m"))
    return t.groupBy("feature").agg(F.count("*").alias("periods"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("std")).withColumn("cv", F.try_divide(F.col("std"), F.abs("mean")))


def correlation_pairs(df: DataFrame, features: list[str], threshold: float = 0.8, method: str = "pearson") -> DataFrame:
    """(feature_a, feature_b, correlation, rating) of pairs at or above ``threshold``."""
    m = selectors.correlation_matrix(df, features, method)
    rows = [(features[i], features[j], float(m[i, j])) for i in range(len(features)) for j in range(i + 1, len(features)) if abs(m[i, j]) >= threshold]
    t = df.sparkSession.createDataFrame(rows, "feature_a string, feature_b string, correlation double")
    return t.withColumn("rating", L.corr_rating(F.col("correlation")))


def label_correlation(df: DataFrame, overdue: list[str], dpds: list[float]) -> DataFrame:
    """(label_a, label_b, correlation) of the labels that overdue columns and limits of days define; labels are made in the same scan."""
    names = {L.label_name(o, d): L.overdue_label(o, d).cast("double") for o in overdue for d in dpds}
    made = df.select(*[c.alias(n) for n, c in names.items()])
    m = selectors.correlation_matrix(made, list(names))
    rows = [(a, b, float(m[i, j])) for i, a in enumerate(names) for j, b in enumerate(names) if i < j]
    return df.sparkSession.createDataFrame(rows, "label_a string, label_b string, correlation double")


def feature_report(df: DataFrame, features: list[str], label: str, models: dict[str, BinModel] | None = None, **options) -> DataFrame:
    """(feature, iv, iv_rating, auc, ks, missing_rate, distinct, bins, top_lift, least_lift): efficiency of every feature, best IV first to read."""
    with Counts(df, features, label) as counted:
        models = models or fit_many(df, features, label, counted=counted, **options)
        counts = counted.counts(models) if all(m.groups is None for m in models.values()) else bin_stats.batch_counts(df, models, label)
        bins = bin_stats.table_from_counts(counts, ["feature"])
        lifts = bins.groupBy("feature").agg(F.max("iv_total").alias("iv"), F.count("*").alias("bins"), F.max("lift").alias("top_lift"), F.min("lift").alias("least_lift"))
        gone = F.sum(F.when(F.col("x").isNull(), F.col("n")).otherwise(0))
        kinds = counted.cells.groupBy("feature").agg((gone / F.sum("n")).alias("missing_rate"), F.count("x").alias("distinct"))
        out = lifts.join(kinds, "feature").join(_auc(counted).select("feature", "auc", "ks"), "feature")
        return _kept(out.select("feature", "iv", L.iv_rating(F.col("iv")).alias("iv_rating"), "auc", "ks", "missing_rate", "distinct", "bins", "top_lift", "least_lift"))


def _kept(table: DataFrame) -> DataFrame:
    """A table of few rows, found now, while what it comes from is kept."""
    return table.sparkSession.createDataFrame(table.collect(), table.schema)


def multi_label_efficiency(df: DataFrame, features: list[str], overdue: list[str], dpds: list[float], models: dict[str, BinModel]) -> DataFrame:
    """(feature, label, n, bad_rate, iv, ks, top_lift) of fixed bins against every label, from one scan."""
    t = bin_stats.feature_bin_stats(df, features, overdue=overdue, dpds=dpds, models=models)
    return t.groupBy("feature", "label").agg(F.sum("n").alias("n"), (F.sum("bad") / F.sum("n")).alias("bad_rate"), F.max("iv_total").alias("iv"), F.max("ks").alias("ks"), F.max("lift").alias("top_lift"))


def vif_table(df: DataFrame, features: list[str]) -> DataFrame:
    t = df.sparkSession.createDataFrame([(f, float(v)) for f, v in selectors.vif(df, features).items()], "feature string, vif double")
    return t.withColumn("rating", L.vif_rating(F.col("vif")))


def iv_ranking(df: DataFrame, features: list[str], label: str, n_bins: int = 10, method: str = "quantile") -> DataFrame:
    t = bin_stats.batch_iv(df, fit_many(df, features, label, method=method, max_n_bins=n_bins), label)
    return t.withColumn("rating", L.iv_rating(F.col("iv")))


def monotonicity(df: DataFrame, model: BinModel, label: str) -> DataFrame:
    """Spearman correlation of bin number and bad rate; monotone from 0.5 on."""
    t = bin_stats.table_from_counts(bin_stats.counts(df, model.index(), label)).where("bin >= 0")
    r = t.select("bin", selectors._mean_rank(F.col("bad_rate")).alias("r"))
    return r.agg(F.corr(F.col("bin").cast("double"), "r").alias("rho")).withColumn("monotone", F.abs("rho") >= 0.5)


def univariate_auc(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """(feature, auc, ks, direction) of all features from one scan; ties count half."""
    with Counts(df, features, label) as counted:
        return _kept(_auc(counted))


def _auc(counted: Counts) -> DataFrame:
    counts = counted.cells.where("x IS NOT NULL AND m > 0").select("feature", "x", F.col("m").alias("n"), "bad")
    c = ranks.running(counts, ["feature"], {"b": F.col("bad"), "g": F.col("n") - F.col("bad")})
    good = F.col("n") - F.col("bad")
    t = c.groupBy("feature").agg(
        F.try_divide(F.sum(F.col("bad") * (F.col("g") - good / 2)), F.max(F.col("b_total") * F.col("g_total"))).alias("auc"),
        F.max(F.abs(F.try_divide(F.col("b"), F.col("b_total")) - F.try_divide(F.col("g"), F.col("g_total")))).alias("ks"),
    )
    return t.select("feature", F.greatest("auc", 1 - F.col("auc")).alias("auc"), "ks", F.when(F.col("auc") >= 0.5, "higher is riskier").otherwise("lower is riskier").alias("direction"))


def _iv_and_auc(df: DataFrame, features: list[str], label: str, n_bins: int = 10) -> DataFrame:
    """(feature, iv, auc) by quantile bins and distinct values of the same counts."""
    with Counts(df, features, label) as counted:
        models = fit_many(df, features, label, method="quantile", max_n_bins=n_bins, counted=counted)
        counts = counted.counts(models) if all(m.groups is None for m in models.values()) else bin_stats.batch_counts(df, models, label)
        iv = bin_stats.table_from_counts(counts, ["feature"]).groupBy("feature").agg(F.max("iv_total").alias("iv"))
        return _kept(iv.join(_auc(counted).select("feature", "auc"), "feature"))


def importance_ranking(df: DataFrame, features: list[str], label: str, digits: int = 6) -> DataFrame:
    """Mean rank by IV and AUC; IVs that are equal to ``digits`` share a rank."""
    t = _iv_and_auc(df, features, label).withColumn("iv", F.round("iv", digits))
    rank = lambda c: F.rank().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(c)))
    return t.select("feature", "iv", "auc", ((rank("iv") + rank("auc")) / 2).alias("rank"))


def group_profile(df: DataFrame, features: list[str], by: list[str], label: str | None = None) -> DataFrame:
    """(by..., feature, n, missing_rate, mean, std, min, max, p25, p50, p75[, bad_rate]), with an overall row (by NULL, overall true) from grouping sets."""
    keys = [*by, "overall", "feature"]
    cells = _cells(df.withColumn("_y", F.lit(None).cast("double") if label is None else F.col(label).cast("double")), features, [*by, "_y"])
    types = dict(cells.dtypes)
    rows = cells.withColumn("overall", F.lit(False)).unionByName(cells.withColumns({k: F.lit(None).cast(types[k]) for k in by} | {"overall": F.lit(True)}))
    t = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.col("x").isNull().cast("double")).alias("missing_rate"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"), F.avg("_y").alias("bad_rate"))
    q = ranks.percentiles(rows, keys, [0.25, 0.5, 0.75]).drop("n")
    t = t.alias("a").join(q.alias("b"), ranks._on("a", "b", keys), "left")
    t = t.select(*[F.col(f"a.{k}") for k in keys], "n", "missing_rate", "mean", "std", "min", "max", *[F.col("q")[i].alias(f"p{p}") for i, p in enumerate((25, 50, 75))], "bad_rate")
    return t if label else t.drop("bad_rate")


def segment_effectiveness(df: DataFrame, features: list[str], label: str, segment: str, n_bins: int = 10, min_size: int = 50) -> DataFrame:
    """(segment, feature, n, iv, ks) with bins of the whole table, from one scan."""
    models = fit_many(df, features, None, method="quantile", max_n_bins=n_bins)
    t = bin_stats.table_from_counts(bin_stats.batch_counts(df, models, label, [segment]), [segment, "feature"])
    return t.groupBy(segment, "feature").agg(F.sum("n").alias("n"), F.max("iv_total").alias("iv"), F.max("ks").alias("ks")).where(F.col("n") >= min_size)


def leakage(df: DataFrame, features: list[str], label: str, iv_limit: float = 0.5, auc_limit: float = 0.9, least: int = 30) -> DataFrame:
    """Features whose IV or AUC is suspiciously high (strictly above the limits) on enough rows."""
    t = _iv_and_auc(df, features, label)
    enough = df.where(F.col(label).isNotNull()).limit(least).count() >= least
    return t.withColumn("suspicious", F.lit(enough) & ((F.col("iv") > iv_limit) | (F.col("auc") > auc_limit)))


def target_distribution(df: DataFrame, label: str) -> DataFrame:
    t = df.groupBy(F.col(label).alias("value")).agg(F.count("*").alias("n"))
    return t.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def sample_distribution(df: DataFrame, period: Column, label: str | None = None) -> DataFrame:
    t = df.groupBy(period.alias("period")).agg(F.count("*").alias("n"), *([F.avg(F.col(label).cast("double")).alias("bad_rate")] if label else []))
    return t.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def segment_shares(df: DataFrame, segment: Column, is_actual: Column) -> DataFrame:
    """(segment, expected_share, actual_share, change, psi_part)."""
    t = df.groupBy(segment.alias("segment")).agg(F.count_if(~is_actual).alias("e"), F.count_if(is_actual).alias("a"))
    every = Window.partitionBy(F.lit(0))
    e, a = (F.coalesce(F.try_divide(F.col(c), F.sum(c).over(every)), F.lit(0.0)) for c in ("e", "a"))
    return t.select("segment", e.alias("expected_share"), a.alias("actual_share"), (a - e).alias("change"), stability.psi_term(e, a).alias("psi_part"))


def bundle(df: DataFrame, label: str | None = None, features: list[str] | None = None, period: Column | None = None) -> dict[str, DataFrame]:
    """Named tables of a whole exploration."""
    features = features or [c for c in numeric_columns(df) if c != label]
    out = {"info": data_info(df), "missing": missing_table(df), "numeric": describe(df, features), "quality": quality(df, df.columns)}
    if label:
        out |= {"target": target_distribution(df, label), "iv": iv_ranking(df, features, label)}
        if period is not None:
            out["trend"] = metrics.badrate_trend(df, label, period)
    if period is not None:
        out["stability"] = stability_over_time(df, features, period)
    return out
