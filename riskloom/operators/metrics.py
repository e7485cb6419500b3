"""Classification, lift, regression and association metrics.

Ranking metrics group equal scores first, so that ties do not depend on row
order and the ordered windows run over distinct scores only.  Where a metric
needs a global order, distinct scores are pre-aggregated and the order is
taken over ranges: each range is summed, and the sums are carried forward.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .bin_stats import counts, table_from_counts
from .binning import BinModel, fit_binning
from .binning import bucket as _bucket
from .ranks import ranges_of


def by_score(df: DataFrame, label: str, score: str, weight: str | None = None) -> DataFrame:
    """(score, n, bad) of every distinct score."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    if weight is None:
        return rows.groupBy(F.col(score).cast("double").alias("score")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("bad"))
    return rows.groupBy(F.col(score).cast("double").alias("score")).agg(F.sum(w).alias("n"), F.sum(w * F.col(label)).alias("bad"))


def cumulate(rows: DataFrame, descending: bool = True) -> DataFrame:
    """Add cumulative and total counts, and the next score, in order of score without one global window.

    Scores are cut into ranges by approximate percentiles; range sums (a row
    each) are cumulated and joined back, and the order inside a range is a
    window over that range alone.
    """
    k = ranges_of(rows)
    cuts = sorted(set(rows.agg(F.percentile_approx("score", [i / k for i in range(1, k)], 10_000)).first()[0] or []))
    part = _bucket(F.col("score"), cuts)
    rows = rows.withColumn("_part", part)
    sign = F.desc if descending else F.asc
    first = F.max("score") if descending else F.min("score")
    sums = rows.groupBy("_part").agg(F.sum("n").alias("_n"), F.sum("bad").alias("_bad"), first.alias("_first"))
    order = Window.partitionBy(F.lit(0)).orderBy(sign("_part"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    sums = sums.select("_part", F.lead("_first").over(order).alias("_next"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("_n", "_bad")], *[F.sum(c).over(every).alias(f"{c}t") for c in ("_n", "_bad")])
    at = Window.partitionBy("_part").orderBy(sign("score"))
    inside = at.rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(F.broadcast(sums), "_part")  # a row per range
    return out.select(
        "score", "n", "bad", (F.sum("n").over(inside) + F.col("_n0")).alias("cum_n"), (F.sum("bad").over(inside) + F.col("_bad0")).alias("cum_bad"),
        F.col("_nt").alias("total_n"), F.col("_badt").alias("total_bad"), F.coalesce(F.lead("score").over(at), F.col("_next")).alias("next_score"),
    )


def roc_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """(threshold, tpr, fpr) at every distinct score, highest first."""
    c = cumulate(by_score(df, label, score))
    return c.select(F.col("score").alias("threshold"), F.try_divide("cum_bad", "total_bad").cast("double").alias("tpr"), F.try_divide(F.col("cum_n") - F.col("cum_bad"), F.col("total_n") - F.col("total_bad")).cast("double").alias("fpr"))


def ks_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row: ks, auc, gini, n, bad; ties of scores count half in AUC."""
    return _ks_auc(by_score(df, label, score))


def ks_auc_row(df: DataFrame, label: str, score: str) -> Row:
    """The row of ``ks_auc``; scores are found and counted once."""
    counts = by_score(df, label, score).persist()
    try:
        return _ks_auc(counts).first()
    finally:
        counts.unpersist()


def _ks_auc(counts: DataFrame) -> DataFrame:
    c = cumulate(counts, descending=False)
    good, cum_good = F.col("n") - F.col("bad"), F.col("cum_n") - F.col("cum_bad")
    tg, tb = F.col("total_n") - F.col("total_bad"), F.col("total_bad")
    both = F.max((tg > 0) & (tb > 0))
    out = c.agg(
        both.alias("_both"), F.max(F.abs(F.try_divide(F.col("cum_bad"), tb) - F.try_divide(cum_good, tg))).alias("ks"), F.try_divide(F.sum(F.col("bad") * (cum_good - good / 2)), F.max(tb * tg)).alias("auc"),
        F.max("total_n").alias("n"), F.max("total_bad").alias("bad"),
    )
    valid = lambda c: F.when(F.col("_both"), c)
    return out.select(valid(F.col("ks")).alias("ks"), valid(F.col("auc")).alias("auc"), valid(2 * F.col("auc") - 1).alias("gini"), "n", "bad")


def ks_two_samples(df: DataFrame, value: str, sample: str) -> DataFrame:
    """Largest distance of the distributions of ``value`` where ``sample`` is 0 and 1."""
    return ks_auc(df, sample, value).select("ks")


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(actual, predicted_0, predicted_1)."""
    p = F.col(prediction)
    return df.groupBy(F.col(label).cast("int").alias("actual")).agg(F.count_if(p == 0).alias("predicted_0"), F.count_if(p == 1).alias("predicted_1"))


def classification_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """accuracy, precision, recall, f1 of class 1 in one row."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    c = df.where(F.col(label).isNotNull() & F.col(prediction).isNotNull()).agg(F.count("*").alias("n"), F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, n = (F.col(x) for x in ("tp", "fp", "fn", "n"))
    return c.select(ratio(n - fp - fn, n).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(class, precision, recall, f1, support) per class; one pass, no pairs."""
    rows = df.where(F.col(label).isNotNull() & F.col(prediction).isNotNull())
    each = F.explode(F.array(F.struct(F.col(label).cast("int").alias("class"), F.lit(1).alias("a"), F.lit(0).alias("p"), (F.col(label) == F.col(prediction)).cast("int").alias("t")), F.struct(F.col(prediction).cast("int").alias("class"), F.lit(0).alias("a"), F.lit(1).alias("p"), F.lit(0).alias("t"))))
    c = rows.select(each.alias("e")).groupBy("e.class").agg(F.sum("e.a").alias("a"), F.sum("e.p").alias("p"), F.sum("e.t").alias("t"))
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    return c.select("class", ratio(F.col("t"), F.col("p")).alias("precision"), ratio(F.col("t"), F.col("a")).alias("recall"), ratio(2 * F.col("t"), F.col("a") + F.col("p")).alias("f1"), F.col("a").alias("support"))


def lift(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    y = F.col(label)
    return df.where(y.isNotNull()).agg(F.try_divide(F.avg(F.when(F.col(score) >= threshold, y)), F.avg(y)).alias("lift"))


def lift_at(df: DataFrame, label: str, score: str, ratios: list[float], ascending: bool = False, key: str | None = None) -> DataFrame:
    """(ratio, n, lift, capture) of the first max(1, floor(total * ratio)) rows by score, ties by ``key``.

    Without a key a tie at the border counts with its mean rate, which no row order can change.
    """
    c = cumulate(by_score(df, label, score), descending=not ascending)
    c = c.withColumns({"_first": F.col("cum_n") - F.col("n"), "_bad0": F.col("cum_bad") - F.col("bad")})
    grid = F.explode(F.array(*[F.lit(float(r)) for r in ratios]))
    rows = c.select("*", grid.alias("ratio")).withColumn("take", F.greatest(F.lit(1), F.floor(F.col("total_n") * F.col("ratio"))))
    border = rows.where("_first < take AND cum_n >= take")
    hit = F.col("_bad0") + F.col("bad") * (F.col("take") - F.col("_first")) / F.col("n")
    return border.select("ratio", F.col("take").cast("long").alias("n"), F.try_divide(hit / F.col("take"), F.col("total_bad") / F.col("total_n")).alias("lift"), F.try_divide(hit, F.col("total_bad")).cast("double").alias("capture"))


def lift_monotonicity(df: DataFrame, label: str, score: str, key: str, n_bins: int = 10) -> DataFrame:
    """Equal-count bins by falling score (the last takes the rest): (bin, n, bad_rate, lift, falls).

    Bins need each row's rank; the ranks come from distinct (score, key) ranges, so no task orders all rows.
    """
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).select(F.col(score).cast("double").alias("score"), F.col(key).alias("_k"), F.col(label).alias("y"))
    ranked = _row_rank(rows, "score", "_k")
    total = ranked.agg(F.count("*")).first()[0]
    size = max(total // n_bins, 1)
    b = F.least(F.floor((F.col("rank") - 1) / size), F.lit(n_bins - 1)).cast("int")
    out = ranked.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("y").alias("bad_rate"))
    every, order = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("bin")
    overall = F.sum(F.col("bad_rate") * F.col("n")).over(every) / F.sum("n").over(every)
    out = out.withColumn("lift", F.try_divide(F.col("bad_rate"), overall))
    return out.withColumn("falls", F.coalesce(F.col("lift") <= F.lag("lift").over(order) + 1e-8, F.lit(True)))


def _row_rank(rows: DataFrame, score: str, key: str) -> DataFrame:
    """Rank of every row by falling ``score``, then ``key``: ranges are counted, and ranked inside."""
    k = ranges_of(rows)
    cuts = sorted(set(rows.agg(F.percentile_approx(score, [i / k for i in range(1, k)], 10_000)).first()[0] or []))
    rows = rows.withColumn("_part", _bucket(F.col(score), cuts))
    sums = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    sums = sums.select("_part", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(F.desc(score), key))
    return rows.join(F.broadcast(sums), "_part").withColumn("rank", inside + F.col("_before"))


def score_table(df: DataFrame, label: str, score: str, n_bins: int = 10, method: str = "quantile", model: BinModel | None = None) -> DataFrame:
    """Bucket table of a score: the bin table and the range of scores per bin."""
    model = model or fit_binning(df, score, label, method=method, max_n_bins=n_bins)
    table = table_from_counts(counts(df, model.index(), label))
    spans = df.where(F.col(label).isNotNull()).groupBy(model.index().alias("bin")).agg(F.min(score).alias("min_score"), F.max(score).alias("max_score"))
    return table.join(spans, "bin").withColumn("bin_label", model.label(F.col("bin")))


def badrate_by_group(df: DataFrame, label: str, group: str, weight: str | None = None) -> DataFrame:
    """(group, n, bad, bad_rate, difference from overall)."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = df.where(F.col(label).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("bad"), F.sum(w * F.col(label)).alias("_b"), F.sum(w).alias("_w"))
    every = Window.partitionBy(F.lit(0))
    rate = F.try_divide("_b", "_w")
    return rows.select(group, "n", "bad", rate.alias("bad_rate"), (rate - F.try_divide(F.sum("_b").over(every), F.sum("_w").over(every))).alias("difference"))


def badrate_trend(df: DataFrame, label: str, period: Column, by: list[str] | None = None) -> DataFrame:
    """(by..., period, n, bad, bad_rate, change, cum_bad_rate) in order of period."""
    by = by or []
    rows = df.where(F.col(label).isNotNull()).groupBy(*by, period.alias("period")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("bad"))
    order = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("period")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rate = F.col("bad") / F.col("n")
    return rows.select(*by, "period", "n", "bad", rate.alias("bad_rate"), (rate - F.lag(rate).over(order)).alias("change"), (F.sum("bad").over(upto) / F.sum("n").over(upto)).alias("cum_bad_rate"))


def rule_lift(df: DataFrame, label: str, hit: Column, amount: str | None = None) -> DataFrame:
    """hit_n, hit_bad, hit_rate, base_rate, lift, bad_improve (and amount_lift) in one row."""
    y, h = F.col(label), F.coalesce(hit, F.lit(False))
    a = F.lit(1.0) if amount is None else F.col(amount).cast("double")
    c = df.where(y.isNotNull()).agg(
        F.count("*").alias("n"), F.sum(y.cast("long")).alias("bad"), F.count_if(h).alias("hit_n"), F.count_if(h & (y == 1)).alias("hit_bad"),
        F.sum(a).alias("a"), F.sum(a * y).alias("ab"), F.sum(F.when(h, a)).alias("ha"), F.sum(F.when(h, a * y)).alias("hab"),
    )
    ratio = lambda x, z: F.when(z > 0, x / z).otherwise(0.0)
    n, bad, hn, hb = (F.col(x) for x in ("n", "bad", "hit_n", "hit_bad"))
    base, rate = ratio(bad, n), ratio(hb, hn)
    out = [hn, hb, rate.alias("hit_rate"), base.alias("base_rate"), ratio(rate, base).alias("lift"), ratio(base - ratio(bad - hb, n - hn), base).alias("bad_improve")]
    return c.select(*out, *([ratio(ratio(F.col("hab"), F.col("ha")), ratio(F.col("ab"), F.col("a"))).alias("amount_lift")] if amount else []))


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    rows = df.where(y.isNotNull() & p.isNotNull())
    c = rows.agg(F.avg(F.pow(y - p, 2)).alias("mse"), F.avg(F.abs(y - p)).alias("mae"), F.var_pop(y).alias("v"))
    return c.select("mse", "mae", F.sqrt("mse").alias("rmse"), F.when(F.col("v") > 0, 1 - F.col("mse") / F.col("v")).alias("r2"))


def contingency_chi2(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """chi2, degrees of freedom, n, and Cramer's V of two categorical Columns."""
    cells = df.select(a.alias("a"), b.alias("b")).where("a IS NOT NULL AND b IS NOT NULL").groupBy("a", "b").agg(F.count("*").alias("o"))
    rows, cols, every = Window.partitionBy("a"), Window.partitionBy("b"), Window.partitionBy(F.lit(0))
    cells = cells.select("a", "b", "o", F.sum("o").over(rows).alias("r"), F.sum("o").over(cols).alias("c")).withColumn("n", F.sum("o").over(every))
    out = cells.agg((F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("c"))) * F.max("n") - F.max("n")).alias("chi2"), F.count_distinct("a").alias("k"), F.count_distinct("b").alias("m"), F.max("n").alias("n"))
    small = F.least(F.col("k"), F.col("m")) - 1
    return out.select("chi2", ((F.col("k") - 1) * (F.col("m") - 1)).alias("df"), "n", F.when(small > 0, F.sqrt(F.greatest(F.col("chi2"), F.lit(0.0)) / (F.col("n") * small))).alias("cramers_v"))


def f_test(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """(feature, f): one-way ANOVA from per-class counts, sums and squares; one scan for all features."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features]))
    rows = df.where(F.col(label).isNotNull()).select(F.col(label).alias("y"), cells.alias("c")).where("c.x IS NOT NULL")
    per = rows.groupBy("c.feature", "y").agg(F.count("*").alias("n"), F.sum("c.x").alias("s"), F.sum(F.col("c.x") * F.col("c.x")).alias("q"))
    t = per.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"), F.count("*").alias("k"))
    between = F.col("b") - F.col("s") * F.col("s") / F.col("n")
    within = F.col("q") - F.col("b")
    return t.select("feature", F.coalesce(F.try_divide(between / (F.col("k") - 1), within / (F.col("n") - F.col("k"))), F.lit(0.0)).alias("f"))


def class_sum_chi2(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """(feature, chi2) of non-negative features: class sums against those expected from class shares."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features]))
    rows = df.where(F.col(label).isNotNull()).select(F.col(label).alias("y"), cells.alias("c"))
    per = rows.groupBy("c.feature", "y").agg(F.count("*").alias("n"), F.coalesce(F.sum("c.x"), F.lit(0.0)).alias("o"))
    w = Window.partitionBy("feature")
    per = per.withColumn("e", F.try_divide(F.sum("o").over(w) * F.col("n"), F.sum("n").over(w)))
    return per.groupBy("feature").agg(F.coalesce(F.sum(F.try_divide(F.pow(F.col("o") - F.col("e"), 2), F.col("e"))), F.lit(0.0)).alias("chi2"))


