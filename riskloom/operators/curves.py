"""Tables behind the usual charts; drawing is left to the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import clean
from .binning import BinModel, fit_binning
from .metrics import _bucket, by_score, cumulate, ranges_of


def precision_recall(df: DataFrame, label: str, score: str) -> DataFrame:
    """(threshold, precision, recall) at every distinct score."""
    c = cumulate(by_score(df, label, score))
    return c.select(F.col("score").alias("threshold"), (F.col("cum_bad") / F.col("cum_n")).alias("precision"), F.try_divide("cum_bad", "total_bad").cast("double").alias("recall"))


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    c = cumulate(by_score(df, label, score))
    return c.agg(F.sum(F.col("cum_bad") / F.col("cum_n") * F.try_divide("bad", "total_bad")).alias("average_precision"))


def gain(df: DataFrame, model: BinModel, label: str) -> DataFrame:
    """(bin, n, bad, cum_share, cum_capture, cum_lift) from the highest bin down."""
    t = df.where(F.col(label).isNotNull()).groupBy(model.index().alias("bin")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("bad"))
    down, every = Window.partitionBy(F.lit(0)).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(F.lit(0))
    share, capture = F.sum("n").over(down) / F.sum("n").over(every), F.try_divide(F.sum("bad").over(down), F.sum("bad").over(every))
    return t.select("bin", "n", "bad", share.alias("cum_share"), capture.cast("double").alias("cum_capture"), (capture / share).alias("cum_lift"))


def thresholds(df: DataFrame, label: str, score: str, cuts: list[float]) -> DataFrame:
    """(threshold, precision, recall, f1, rejected) of rejecting scores at or above each threshold; one scan, whatever the number of thresholds."""
    edges = sorted(set(map(float, cuts)))
    cells = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(_bucket(F.col(score), edges).alias("cell")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("bad"))
    grid = df.sparkSession.createDataFrame([(0, None), *[(i, e) for i, e in enumerate(edges, 1)]], "cell int, threshold double")
    down, every = Window.partitionBy(F.lit(0)).orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(F.lit(0))
    s = grid.join(F.broadcast(cells), "cell", "left").na.fill(0, ["n", "bad"])
    s = s.select("threshold", F.sum("n").over(down).alias("cn"), F.sum("bad").over(down).alias("cb"), F.sum("n").over(every).alias("tn"), F.sum("bad").over(every).alias("tb")).where("threshold IS NOT NULL")
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0)).cast("double")
    return s.select("threshold", ratio(F.col("cb"), F.col("cn")).alias("precision"), ratio(F.col("cb"), F.col("tb")).alias("recall"), ratio(2 * F.col("cb"), F.col("cn") + F.col("tb")).alias("f1"), ratio(F.col("cn"), F.col("tn")).alias("rejected"))


def histogram_by_class(df: DataFrame, label: str, score: str, n_bins: int = 30) -> DataFrame:
    """(bin, y, n, share of the class) over equal-width bins."""
    model = fit_binning(df, score, method="uniform", max_n_bins=n_bins)
    t = df.where(F.col(label).isNotNull() & clean(score).isNotNull()).groupBy(model.index().alias("bin"), F.col(label).alias("y")).agg(F.count("*").alias("n"))
    return t.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("y")))


def bin_trend(df: DataFrame, model: BinModel, label: str, period: Column, by: list[str] | None = None) -> DataFrame:
    """(by..., period, bin, n, n_share of the period, bad_rate)."""
    by = by or []
    t = df.where(F.col(label).isNotNull()).groupBy(*by, period.alias("period"), model.index().alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col(label).cast("double")).alias("bad_rate"))
    return t.select(*by, "period", "bin", "n", (F.col("n") / F.sum("n").over(Window.partitionBy(*by, "period"))).alias("n_share"), "bad_rate")


def approval_trend(df: DataFrame, approved: Column, period: Column, label: str | None = None) -> DataFrame:
    """(period, n, approval_rate[, bad_rate of the approved])."""
    ok = F.coalesce(approved, F.lit(False))
    return df.groupBy(period.alias("period")).agg(F.count("*").alias("n"), F.avg(ok.cast("double")).alias("approval_rate"), *([F.avg(F.when(ok, F.col(label)).cast("double")).alias("bad_rate")] if label else []))


def missing_bad_rate(df: DataFrame, features: dict[str, Column], label: str) -> DataFrame:
    """(feature, missing_rate, bad_rate_missing, bad_rate_present)."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), c.isNull().alias("gone")) for f, c in features.items()]))
    t = df.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("y"), cells.alias("c"))
    return t.groupBy("c.feature").agg(F.avg(F.col("c.gone").cast("double")).alias("missing_rate"), F.avg(F.when(F.col("c.gone"), F.col("y"))).alias("bad_rate_missing"), F.avg(F.when(~F.col("c.gone"), F.col("y"))).alias("bad_rate_present"))


def segment_ks_auc(df: DataFrame, label: str, score: str, segment: str) -> DataFrame:
    """(segment, n, bad, ks, auc); the order inside a segment is taken over score ranges, so that a large segment is not one task."""
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(segment).alias("segment"), F.col(score).cast("double").alias("score")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("bad"))
    k = ranges_of(rows)
    cuts = sorted(set(rows.agg(F.percentile_approx("score", [i / k for i in range(1, k)], 10_000)).first()[0] or []))
    rows = rows.withColumn("part", _bucket(F.col("score"), cuts))
    sums = rows.groupBy("segment", "part").agg(F.sum("n").alias("pn"), F.sum("bad").alias("pb"))
    before, own = Window.partitionBy("segment").orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("segment")
    sums = sums.select("segment", "part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("pn", "pb")], F.sum("pn").over(own).alias("tn"), F.sum("pb").over(own).alias("tb"))
    inside = Window.partitionBy("segment", "part").orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    c = rows.join(sums, ["segment", "part"]).select("segment", "n", "bad", "tn", "tb", (F.sum("n").over(inside) + F.col("pn0")).alias("cn"), (F.sum("bad").over(inside) + F.col("pb0")).alias("cb"))
    good, cg, tg = F.col("n") - F.col("bad"), F.col("cn") - F.col("cb"), F.col("tn") - F.col("tb")
    return c.groupBy("segment").agg(F.max("tn").alias("n"), F.max("tb").alias("bad"), F.max(F.abs(F.try_divide(F.col("cb"), F.col("tb")) - F.try_divide(cg, tg))).alias("ks"), F.try_divide(F.sum(F.col("bad") * (cg - good / 2)), F.max(F.col("tb") * tg)).alias("auc"))
