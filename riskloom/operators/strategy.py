"""Approval strategy, vintage, roll rates, swap sets, overdue prediction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import clean
from .bin_stats import counts
from .binning import BinModel, fit_binning, quantile_edges
from .metrics import _bucket
from .rules import Rule

DPD_BOUNDS = [1, 7, 15, 30, 60, 90, 120]


def simulate(df: DataFrame, score: str, label: str, thresholds: list[float], amount: str | None = None, low_risk: str = "high") -> DataFrame:
    """(threshold, approved_n, approval_rate, approved_bad, bad_rate, rejected_n, rejected_bad_rate[, approved_amount]).

    One scan counts rows between neighbouring thresholds; the table of
    thresholds is a cumulative sum of those few cells.
    """
    cuts = sorted(set(map(float, thresholds)))
    x = clean(score) if low_risk == "high" else -clean(score)
    edges = cuts if low_risk == "high" else sorted(-c for c in cuts)
    a = F.lit(0.0) if amount is None else F.coalesce(F.col(amount).cast("double"), F.lit(0.0))
    rows = df.where(F.col(label).isNotNull() & clean(score).isNotNull())
    cells = rows.groupBy(_bucket(x, edges).alias("cell")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("bad"), F.sum(a).alias("a"))
    grid = df.sparkSession.createDataFrame([(i, (e if low_risk == "high" else -e) if i else None) for i, e in enumerate([0.0, *edges])], "cell int, threshold double")
    full = grid.join(F.broadcast(cells), "cell", "left").na.fill(0, ["n", "bad", "a"])
    upto = Window.partitionBy(F.lit(0)).orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(F.lit(0))
    s = full.select("threshold", *[F.sum(c).over(upto).alias(f"p_{c}") for c in ("n", "bad", "a")], F.sum("n").over(every).alias("tn"), F.sum("bad").over(every).alias("tb")).where("threshold IS NOT NULL")
    ratio = lambda p, q: F.when(q > 0, p / q).otherwise(0.0)
    n, bad, tn, tb = (F.col(c) for c in ("p_n", "p_bad", "tn", "tb"))
    out = s.select("threshold", n.alias("approved_n"), ratio(n, tn).alias("approval_rate"), bad.alias("approved_bad"), ratio(bad, n).alias("bad_rate"), (tn - n).alias("rejected_n"), ratio(tb - bad, tn - n).alias("rejected_bad_rate"), F.col("p_a").alias("approved_amount"))
    return out if amount else out.drop("approved_amount")


def tradeoff(df: DataFrame, score: str, label: str, n_points: int = 100, low_risk: str = "high") -> DataFrame:
    """``simulate`` at the interior percentiles of a grid of n_points + 2."""
    cuts = quantile_edges(df.where(F.col(label).isNotNull()), score, [i / (n_points + 1) for i in range(1, n_points + 1)])
    return simulate(df, score, label, cuts, None, low_risk)


def vintage_curve(df: DataFrame, vintage: str, mob: str, label: str, max_mob: int = 12) -> DataFrame:
    """(vintage, mob, n, bad, cum_bad, vintage_n, cum_bad_rate): cumulative bad over all rows of the vintage up to ``max_mob``."""
    per = df.where(F.col(label).isNotNull() & (F.col(mob) <= max_mob)).groupBy(F.col(vintage).alias("vintage"), F.col(mob).alias("mob")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("bad"))
    own = Window.partitionBy("vintage")
    cum = F.sum("bad").over(own.orderBy("mob").rowsBetween(Window.unboundedPreceding, 0))
    return per.select("vintage", "mob", "n", "bad", cum.alias("cum_bad"), F.sum("n").over(own).alias("vintage_n")).withColumn("cum_bad_rate", F.col("cum_bad") / F.col("vintage_n"))


def vintage_performance(df: DataFrame, vintage: str, mob: str, label: str, points: list[int], amount: str | None = None) -> DataFrame:
    """One row per vintage: rows and bad rate (and amount rate) among rows with mob <= point, for each point."""
    a = None if amount is None else F.col(amount).cast("double")
    out = []
    for p in points:
        m = F.col(mob) <= p
        out += [F.count_if(m).alias(f"n_{p}"), F.try_divide(F.sum(F.when(m, F.col(label))), F.count_if(m)).cast("double").alias(f"bad_rate_{p}")]
        if a is not None:
            out.append(F.try_divide(F.sum(F.when(m, a * F.col(label))), F.sum(F.when(m, a))).alias(f"amount_rate_{p}"))
    return df.where(F.col(label).isNotNull()).groupBy(F.col(vintage).alias("vintage")).agg(*out)


def vintage_pivot(df: DataFrame, vintage: str, mob: str, label: str, max_mob: int = 12) -> DataFrame:
    return vintage_curve(df, vintage, mob, label, max_mob).groupBy("vintage").pivot("mob", list(range(max_mob + 1))).agg(F.max("cum_bad_rate"))


def dpd_state(dpd: Column, bounds: list[int] | None = None) -> Column:
    """State number of days past due; bounds are left-closed, so day 7 belongs to the state that starts at 7."""
    out = F.lit(0)
    for b in bounds or DPD_BOUNDS:
        out = out + (dpd >= b).cast("int")
    return F.when(dpd.isNotNull(), out)


def roll_rate(df: DataFrame, dpd_from: Column, dpd_to: Column, bounds: list[int] | None = None, amount: str | None = None) -> DataFrame:
    """(state_from, to_0.., n, better, same, worse): shares of each starting state."""
    k = len(bounds or DPD_BOUNDS) + 1
    w = F.lit(1.0) if amount is None else F.col(amount).cast("double")
    moves = df.select(dpd_state(dpd_from, bounds).alias("s"), dpd_state(dpd_to, bounds).alias("t"), w.alias("w")).where("s IS NOT NULL AND t IS NOT NULL")
    sums = moves.groupBy(F.col("s").alias("state_from")).agg(*[F.sum(F.when(F.col("t") == j, F.col("w")).otherwise(0.0)).alias(f"w{j}") for j in range(k)], F.sum("w").alias("n"))
    share = lambda c: F.when(F.col("n") > 0, c / F.col("n")).otherwise(0.0)
    total = lambda test: sum((F.when(test(F.lit(j)), F.col(f"w{j}")).otherwise(0.0) for j in range(k)), F.lit(0.0))
    s = F.col("state_from")
    return sums.select("state_from", *[share(F.col(f"w{j}")).alias(f"to_{j}") for j in range(k)], "n", share(total(lambda j: j < s)).alias("better"), share(total(lambda j: j == s)).alias("same"), share(total(lambda j: j > s)).alias("worse"))


def overdue_distribution(df: DataFrame, columns: list[str], bounds: list[int] | None = None) -> DataFrame:
    """(column, state, n, share) of several overdue columns from one scan."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), dpd_state(F.col(c), bounds).alias("state")) for c in columns]))
    n = df.select(cells.alias("c")).where("c.state IS NOT NULL").groupBy("c.column", "c.state").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("column")))


# --- swap sets ---

def swap_type(original_reject: Column, new_reject: Column) -> Column:
    """Quadrant by (original decision, new decision)."""
    return F.when(~original_reject & ~new_reject, "in-in").when(~original_reject, "in-out").when(~new_reject, "out-in").otherwise("out-out")


def swap_dataset(df: DataFrame, original: Rule, new: Rule) -> DataFrame:
    return df.withColumn("swap_type", swap_type(original.hit, new.hit))


def reference_rates(df: DataFrame, score: str, label: str, n_bins: int = 10) -> tuple[BinModel, dict[int, float], float]:
    """Score bins of labelled rows with their bad rates, and the overall rate."""
    model = fit_binning(df.where(F.col(label).isNotNull()), score, method="quantile", max_n_bins=n_bins)
    rows = counts(df, model.index(), label).collect()
    n, bad = sum(r["n"] for r in rows), sum(r["bad"] for r in rows)
    return model, {r["bin"]: r["bad"] / r["n"] for r in rows}, bad / n if n else 0.0


def swap_report(df: DataFrame, model: BinModel, rates: dict[int, float], overall: float, uplift: float = 2.0, amount: str | None = None) -> DataFrame:
    """(swap_type, n, share, expected_bad, bad_rate): reference rates by score bin; swapped-in rows carry an uplift, capped at 1."""
    p = model.value(rates, default=overall)
    p = F.when(F.col("swap_type") == "out-in", F.least(p * uplift, F.lit(1.0))).otherwise(p)
    w = F.lit(1.0) if amount is None else F.col(amount).cast("double")
    t = df.groupBy("swap_type").agg(F.count("*").alias("n"), F.sum(w).alias("weight"), F.sum(w * p).alias("expected_bad"))
    return t.select("swap_type", "n", (F.col("weight") / F.sum("weight").over(Window.partitionBy(F.lit(0)))).alias("share"), "expected_bad", F.try_divide("expected_bad", "weight").alias("bad_rate"))


def swap_summary(report: DataFrame) -> DataFrame:
    """One row: pass rates, bad rates of what passes before and after, and the relative reduction per share newly rejected."""
    part = lambda c, *types: F.coalesce(F.sum(F.when(F.col("swap_type").isin(*types), F.col(c))), F.lit(0.0))
    weight = report.withColumn("b", F.col("share") * F.col("bad_rate"))
    x = weight.agg(part("share", "in-in", "in-out").alias("pass_before"), part("share", "in-in", "out-in").alias("pass_after"), part("b", "in-in", "in-out").alias("b0"), part("b", "in-in", "out-in").alias("b1"), part("share", "in-out", "out-out").alias("rejected"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    r0, r1 = ratio(F.col("b0"), F.col("pass_before")), ratio(F.col("b1"), F.col("pass_after"))
    return x.select("pass_before", "pass_after", r0.alias("bad_rate_before"), r1.alias("bad_rate_after"), ratio(r0 - r1, F.col("rejected")).alias("risk_rejection_rate"))


# --- overdue prediction ---

class OverduePredictor:
    """Bin to bad rate, times a calibration coefficient, capped at 1."""

    def __init__(self, model: BinModel, rates: dict[int, float], overall: float, coefficient: float = 1.0):
        self.model, self.rates, self.overall, self.coefficient = model, rates, overall, coefficient

    @classmethod
    def fit(cls, df: DataFrame, feature: str, label: str, method: str = "mdlp", max_n_bins: int = 5, **options) -> OverduePredictor:
        model = fit_binning(df, feature, label, method=method, max_n_bins=max_n_bins, **options)
        rows = counts(df, model.index(), label).collect()
        n, bad = sum(r["n"] for r in rows), sum(r["bad"] for r in rows)
        return cls(model, {r["bin"]: r["bad"] / r["n"] for r in rows}, bad / n if n else 0.0)

    def rate(self) -> Column:
        return F.least(self.model.value(self.rates, default=self.overall) * self.coefficient, F.lit(1.0))

    def calibrate(self, df: DataFrame, target_rate: float) -> OverduePredictor:
        """Scale so that the mean prediction over ``df`` (weighted by rows) meets ``target_rate``."""
        mean = df.agg(F.avg(self.model.value(self.rates, default=self.overall))).first()[0]
        return OverduePredictor(self.model, self.rates, self.overall, target_rate / mean if mean else 1.0)

    def transform(self, df: DataFrame, out: str = "predicted_rate") -> DataFrame:
        return df.withColumn(out, self.rate())
