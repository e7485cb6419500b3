"""The statistics kernel: per-bin counts, WOE, IV, lift, KS and cumulatives.

One partially aggregated ``groupBy`` per call; windows run over its result,
which has one row per (group, bin).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .binning import BinModel, Counts, order_key

EPS = 1e-10
BINARY = [
    "bin", "n", "good", "bad", "n_share", "good_share", "bad_share", "bad_rate", "woe", "iv_bin", "iv_total", "lift", "bad_improve", "risk_reject",
    "cum_lift", "cum_bad_improve", "cum_risk_reject", "cum_good", "cum_bad", "ks",
]


def _windows(by: list[str], key: Column) -> tuple:
    own = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return own, own.orderBy(key).rowsBetween(Window.unboundedPreceding, 0)


def woe_columns(good: Column, bad: Column, all_good: Column, all_bad: Column, total_good: Column, total_bad: Column, clip: float | None = None) -> tuple[Column, Column]:
    """(WOE, IV) with zero counts replaced by a small number before the shares; ``all_*`` are sums of the replaced counts."""
    some = lambda c: F.when(c == 0, F.lit(EPS)).otherwise(c)
    b, g = some(bad) / all_bad, some(good) / all_good
    w = F.log(b / g)
    if clip:
        w = F.greatest(F.least(w, F.lit(float(clip))), F.lit(-float(clip)))
    both = (total_bad > 0) & (total_good > 0)
    return F.when(both, w).otherwise(0.0), F.when(both, (b - g) * w).otherwise(0.0)


def table_from_counts(counts: DataFrame, by: list[str] | None = None, clip: float | None = None, amount: bool = False) -> DataFrame:
    """The bin table from rows (by..., bin, n, bad): counts or, with ``amount``, amounts."""
    by = by or []
    rows = counts.withColumn("good", F.col("n") - F.col("bad"))
    own, upto = _windows(by, order_key(F.col("bin")))
    some = lambda c: F.when(F.col(c) == 0, F.lit(EPS)).otherwise(F.col(c).cast("double"))
    rows = rows.select(
        *by, "bin", "n", "good", "bad",
        *[F.sum(c).over(own).alias(f"t_{c}") for c in ("n", "good", "bad")], *[F.sum(c).over(upto).alias(f"cum_{c}") for c in ("n", "good", "bad")],
        F.sum(some("good")).over(own).alias("a_good"), F.sum(some("bad")).over(own).alias("a_bad"),
    )
    n, bad, tn, tb = (F.col(c) for c in ("n", "bad", "t_n", "t_bad"))
    overall = F.coalesce(F.try_divide(tb, tn), F.lit(0.0))
    rate = F.when(n > 0, bad / n).otherwise(0.0)

    def effects(count: Column, bads: Column, rate_: Column) -> tuple[Column, Column, Column]:
        lift = F.when(overall > 0, rate_ / overall).otherwise(0.0)
        rest = F.when(tn > count, (tb - bads) / (tn - count)).otherwise(0.0)
        improve = F.when(overall > 0, (overall - rest) / overall).otherwise(0.0)
        part = F.coalesce(F.try_divide(count, tn), F.lit(0.0))
        return lift, improve, part if amount else F.when(part > 0, improve / part).otherwise(0.0)

    lift, improve, reject = effects(n, bad, rate)
    c_lift, c_improve, c_reject = effects(F.col("cum_n"), F.col("cum_bad"), F.when(F.col("cum_n") > 0, F.col("cum_bad") / F.col("cum_n")).otherwise(0.0))
    woe, iv = woe_columns(F.col("good"), bad, F.col("a_good"), F.col("a_bad"), F.col("t_good"), tb, clip)
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    rows = rows.withColumns({"woe": woe, "iv_bin": iv, "lift": lift, "bad_improve": improve, "risk_reject": reject, "cum_lift": c_lift, "cum_bad_improve": c_improve, "cum_risk_reject": c_reject})
    return rows.select(
        *by, "bin", "n", "good", "bad", F.coalesce(F.try_divide(n, tn), F.lit(0.0)).alias("n_share"), ratio("good", "t_good").alias("good_share"), ratio("bad", "t_bad").alias("bad_share"), rate.alias("bad_rate"), "woe", "iv_bin",
        F.sum("iv_bin").over(own).alias("iv_total"), "lift", "bad_improve", "risk_reject", "cum_lift", "cum_bad_improve", "cum_risk_reject", "cum_good", "cum_bad",
        F.abs(F.col("cum_bad") / (tb + EPS) - F.col("cum_good") / (F.col("t_good") + EPS)).alias("ks"),
    )


def counts(df: DataFrame, index: Column, label: str, by: list[str] | None = None, amount: str | None = None) -> DataFrame:
    """(by..., bin, n, bad): rows without a label value are left out."""
    y = F.col(label)
    n, bad = (F.count("*"), F.sum(y.cast("long"))) if amount is None else (F.sum(F.col(amount).cast("double")), F.sum(F.when(y == 1, F.col(amount).cast("double")).otherwise(0.0)))
    return df.where(y.isNotNull()).groupBy(*(by or []), index.alias("bin")).agg(n.alias("n"), bad.alias("bad"))


def bin_stats(df: DataFrame, model: BinModel, label: str, by: list[str] | None = None, amount: str | None = None, clip: float | None = None) -> DataFrame:
    """Bin table of one feature, per group of ``by``; counts, or amounts where ``amount`` names a column."""
    table = table_from_counts(counts(df, model.index(), label, by, amount), by, clip, amount is not None)
    return table.withColumn("bin_label", model.label(F.col("bin")))


def bin_stats_continuous(df: DataFrame, model: BinModel, target: str, by: list[str] | None = None) -> DataFrame:
    """Bin table of a continuous target: sum, mean, population deviation, range, shares, lift of the mean, contribution."""
    by, y = by or [], F.col(target).cast("double")
    rows = df.where(y.isNotNull()).groupBy(*by, model.index().alias("bin")).agg(
        F.count("*").alias("n"), F.sum(y).alias("y_sum"), F.avg(y).alias("y_mean"), F.stddev_pop(y).alias("y_std"), F.min(y).alias("y_min"), F.max(y).alias("y_max"))
    own, _ = _windows(by, F.col("bin"))
    tn, ty = F.sum("n").over(own), F.sum("y_sum").over(own)
    share, y_share = F.col("n") / tn, F.when(ty != 0, F.col("y_sum") / ty).otherwise(0.0)
    return rows.select("*", share.alias("n_share"), y_share.alias("y_share"), F.when(ty != 0, F.col("y_mean") / (ty / tn)).otherwise(0.0).alias("mean_lift"), ((y_share - share) / (share + EPS)).alias("contribution"))


def with_margins(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Append a total row (``bin`` NULL, label ``total``) per group: sums, shares and lift 1, WOE 0, IV total, largest KS; "no action" improves nothing."""
    by = by or []
    total = table.groupBy(*by).agg(
        F.lit(None).cast("int").alias("bin"), *[F.sum(c).alias(c) for c in ("n", "good", "bad")], F.max("iv_total").alias("iv_total"), F.max("ks").alias("ks"),
        *[F.max(c).alias(c) for c in ("cum_good", "cum_bad")],
    )
    one, zero = F.lit(1.0), F.lit(0.0)
    total = total.withColumns(
        {"n_share": one, "good_share": one, "bad_share": one, "bad_rate": F.when(F.col("n") > 0, F.col("bad") / F.col("n")).otherwise(0.0), "woe": zero, "iv_bin": zero, "lift": one}
        | {c: zero for c in ("bad_improve", "risk_reject", "cum_bad_improve", "cum_risk_reject")} | {"cum_lift": one}
    )
    if "bin_label" in table.columns:
        total = total.withColumn("bin_label", F.lit("total"))
    return table.unionByName(total.select(*[F.col(c).cast(t).alias(c) for c, t in table.dtypes]))


def batch_counts(df: DataFrame, models: dict[str, BinModel], label: str, by: list[str] | None = None) -> DataFrame:
    """(by..., feature, bin, n, bad) of many features from one scan and one shuffle."""
    by = by or []
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), m.index().alias("bin")) for f, m in models.items()])
    rows = df.where(F.col(label).isNotNull()).select(*by, F.col(label).alias("_y"), F.explode(cells).alias("_c"))
    return rows.groupBy(*by, F.col("_c.feature").alias("feature"), F.col("_c.bin").alias("bin")).agg(F.count("*").alias("n"), F.sum(F.col("_y").cast("long")).alias("bad"))


def batch_iv(df: DataFrame, models: dict[str, BinModel], label: str, counted: Counts | None = None) -> DataFrame:
    """(feature, iv, ks, n_bins), best first; from ``counted`` values where there are some and no bins of categories."""
    known = counted is not None and all(m.groups is None for m in models.values())
    table = table_from_counts(counted.counts(models) if known else batch_counts(df, models, label), ["feature"])
    return table.groupBy("feature").agg(F.max("iv_total").alias("iv"), F.max("ks").alias("ks"), F.count("*").alias("n_bins")).orderBy(F.desc("iv"), "feature")


def closed_right_table(df: DataFrame, feature: str, label: str, splits: list[float]) -> DataFrame:
    """Bin table over (a, b] bins, for parity with right-closed figures."""
    n = F.lit(0)
    for s in sorted(splits):
        n = n + (F.col(feature) > float(s)).cast("int")
    return table_from_counts(counts(df.where(F.col(feature).isNotNull()), n, label))


def iv_for_splits(df: DataFrame, feature: str, label: str, splits: list[float]) -> DataFrame:
    return closed_right_table(df, feature, label, splits).agg(F.sum("iv_bin").alias("iv"))


def ks_for_splits(df: DataFrame, feature: str, label: str, splits: list[float]) -> DataFrame:
    return closed_right_table(df, feature, label, splits).agg(F.max("ks").alias("ks"))


def compare_splits(df: DataFrame, feature: str, label: str, first: list[float], second: list[float]) -> DataFrame:
    """One row: IV and KS of two sets of splits (bins closed on the right), and which is better; ties go to the first."""
    parts = [closed_right_table(df, feature, label, s).agg(F.sum("iv_bin").alias("iv"), F.max("ks").alias("ks")).first() for s in (first, second)]
    a, b = ((float(p["iv"] or 0.0), float(p["ks"] or 0.0)) for p in parts)
    row = (*a, *b, *("first" if x >= y else "second" for x, y in zip(a, b)))
    return df.sparkSession.createDataFrame([row], "iv_first double, ks_first double, iv_second double, ks_second double, better_iv string, better_ks string")


def curve_quality(df: DataFrame, model: BinModel, label: str, metric: str = "lift", trend: str = "descending") -> float:
    """``search.curve_coefficient`` of a fitted feature: missing and special bins take no part."""
    from .search import curve_coefficient

    rows = sorted((r["bin"], r["n"], r["bad"]) for r in counts(df, model.index(), label).collect() if r["bin"] >= 0)
    import numpy as np

    return curve_coefficient(np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float), metric, trend)


def feature_bin_stats(
    df: DataFrame, features: list[str], label: str | None = None, overdue: list[str] | None = None, dpds: list[float] | None = None, models: dict[str, BinModel] | None = None,
    drop_grey: bool = False, margins: bool = False, **binning_options,
) -> DataFrame:
    """Bin tables of many features against one label, or against every overdue column and day limit, from one scan.

    Columns: feature[, label], bin, bin_label and those of ``table_from_counts``.
    Bins come from ``models``, or are fitted on the label (the first of the
    overdue labels) with ``binning_options``.
    """
    from ..functions.labels import overdue_label, with_labels
    from .binning import fit_many

    if (label is None) == (overdue is None):
        raise ValueError("give a label, or overdue columns with day limits")
    by = ["feature"] if label else ["feature", "label"]
    if models is None:
        fit_on = df if label else df.withColumn("_y", overdue_label(overdue[0], dpds[0], drop_grey))
        models = fit_many(fit_on, features, label or "_y", **binning_options)
    rows = df if label else with_labels(df.select(*features, *overdue), overdue, dpds, drop_grey, keep=features)
    counted = batch_counts(rows, models, label or "y", by[1:])
    table = table_from_counts(counted, by)
    if margins:
        table = with_margins(table, by)
    names = F.lit("total")
    for f, m in models.items():
        names = F.when((F.col("feature") == f) & F.col("bin").isNotNull(), m.label(F.col("bin"))).otherwise(names)
    return table.withColumn("bin_label", names)
