"""Losses of a whole scored table: one row each, from one or two aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.losses import CrossEntropy, approval_loss, sigmoid
from . import ranks
from .binning import quantile_edges
from .metrics import by_score, cumulate


def clip(p: Column) -> Column:
    return F.greatest(F.least(p, F.lit(1 - 1e-7)), F.lit(1e-7))


def bce(y: Column, p: Column) -> Column:
    return CrossEntropy().value(y, clip(p))


def _rows(df: DataFrame, label: str, p: str) -> tuple[DataFrame, Column, Column]:
    y, x = F.col(label), F.col(p)
    return df.where(y.isNotNull() & x.isNotNull()), y, x


def balanced_focal(df: DataFrame, label: str, p: str, gamma: float = 2.0, beta: float = 0.999) -> DataFrame:
    """Focal loss whose class weights are inverse effective numbers, (1 - beta) / (1 - beta^n), scaled to sum to one."""
    rows, y, x = _rows(df, label, p)
    n, bad = rows.agg(F.count("*"), F.coalesce(F.sum(label), F.lit(0))).first()
    w1, w0 = ((1 - beta) / (1 - beta**k) if k else 0.0 for k in (bad, n - bad))
    alpha = w1 / (w1 + w0) if w1 + w0 else 0.5
    t = F.when(y == 1, clip(x)).otherwise(1 - clip(x))
    return rows.agg(F.avg(-F.when(y == 1, alpha).otherwise(1 - alpha) * F.pow(1 - t, gamma) * F.log(t)).alias("loss"))


def cost_at_threshold(df: DataFrame, label: str, p: str, false_negative: float = 1.0, false_positive: float = 1.0, threshold: float = 0.5) -> DataFrame:
    rows, y, x = _rows(df, label, p)
    return rows.agg(F.avg(F.when((y == 1) & (x < threshold), false_negative).when((y == 0) & (x >= threshold), false_positive).otherwise(0.0)).alias("loss"))


def bad_debt(df: DataFrame, label: str, p: str, approval: float = 0.3, bad_debt_weight: float = 1.0, approval_weight: float = 0.5) -> DataFrame:
    """Cross entropy, the bad rate of the approved rows, and the distance of their share from ``approval``.

    Approved are the rows of lowest probability up to the value at which their
    share reaches ``approval``; rows of one value are approved together.
    """
    rows, y, x = _rows(df, label, p)
    base = rows.agg(F.avg(bce(y, x))).first()[0] or 0.0
    c = cumulate(by_score(df, label, p), descending=False)
    taken = F.col("cum_n") - F.col("n") < F.col("total_n") * approval
    t = c.agg(F.max("total_n").alias("all"), F.sum(F.when(taken, F.col("n"))).alias("n"), F.sum(F.when(taken, F.col("bad"))).alias("bad"))
    return t.select((F.lit(base) + bad_debt_weight * F.coalesce(F.try_divide("bad", "n"), F.lit(0.0)) + approval_weight * F.abs(F.coalesce(F.try_divide("n", "all"), F.lit(0.0)) - approval)).alias("loss"))


def ks_focused(df: DataFrame, label: str, p: str, ks_weight: float = 1.0, bce_weight: float = 1.0, var_weight: float = 0.1) -> DataFrame:
    """Cross entropy less the distance of the class means, plus the class variances."""
    rows, y, x = _rows(df, label, p)
    on = lambda f, k: F.coalesce(f(F.when(y == k, x)), F.lit(0.0))
    return rows.agg((bce_weight * F.avg(bce(y, x)) - ks_weight * (on(F.avg, 1) - on(F.avg, 0)) + var_weight * (on(F.var_pop, 1) + on(F.var_pop, 0))).alias("loss"))


def lift_focused(df: DataFrame, label: str, p: str, ratio: float = 0.1, penalty: float = 3.0, positive_boost: float = 1.5, base_weight: float = 1.0) -> DataFrame:
    """Weighted cross entropy: the top share of rows by probability and the positives weigh more; a tie at the border takes its share of the extra weight."""
    c = cumulate(by_score(df, label, p))
    take = F.greatest(F.lit(1.0), F.ceil(F.col("total_n") * ratio))
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (take - (F.col("cum_n") - F.col("n"))) / F.col("n")))
    w = base_weight * (1 + (penalty - 1) * part)
    x, good, bad = clip(F.col("score")), F.col("n") - F.col("bad"), F.col("bad")
    return c.agg((F.sum(w * (-bad * positive_boost * F.log(x) - good * F.log(1 - x))) / F.sum(w * (bad * positive_boost + good))).alias("loss"))


def ranking_hinge(df: DataFrame, label: str, p: str, margin: float = 0.2, rank_weight: float = 1.0, bce_weight: float = 1.0) -> DataFrame:
    """Cross entropy plus the mean squared hinge over all (bad, good) pairs, exactly and without making pairs.

    For a bad row at s the good rows t above s - margin count, with
    (margin - s + t)^2: sums of 1, t and t^2 over them are running sums over
    the distinct values of good rows and of the borders of bad ones.
    """
    rows, y, x = _rows(df, label, p)
    base = rows.agg(F.avg(bce(y, x))).first()[0] or 0.0
    per = rows.groupBy(x.alias("s")).agg(F.sum(y.cast("double")).alias("b"), F.sum(1 - y.cast("double")).alias("g"))
    s, g = F.col("s"), F.col("g")
    good = per.select(s.alias("x"), F.lit(0.0).alias("b"), g.alias("g0"), (g * s).alias("g1"), (g * s * s).alias("g2"))
    bad = per.select((s - margin).alias("x"), "b", *[F.lit(0.0).alias(c) for c in ("g0", "g1", "g2")])
    both = good.unionAll(bad).groupBy("x").agg(*[F.sum(c).alias(c) for c in ("b", "g0", "g1", "g2")])
    run = ranks.running(both, [], {f"c{k}": F.col(f"g{k}") for k in range(3)})
    n0, n1, n2 = (F.col(f"c{k}_total") - F.col(f"c{k}") for k in range(3))  # of good rows above the border
    edge = F.col("x")  # s - margin
    loss = F.sum(F.col("b") * (n2 - 2 * edge * n1 + edge * edge * n0)) / (F.sum("b") * F.max("c0_total"))
    return run.agg(loss.alias("mean")).select((bce_weight * base + rank_weight * F.coalesce("mean", F.lit(0.0))).alias("loss"))


def top_k_capture(df: DataFrame, label: str, p: str, ratio: float = 0.05, miss: float = 5.0, false_alarm: float = 1.0, temperature: float = 0.05, bce_weight: float = 0.1) -> DataFrame:
    """Soft gate at the (1 - ratio) percentile: bad rows outside cost ``miss``, good rows inside ``false_alarm``."""
    rows, y, x = _rows(df, label, p)
    edge = quantile_edges(rows, p, [1 - ratio])
    gate = sigmoid((x - F.lit(edge[0] if edge else 0.0)) / temperature)
    return rows.agg(F.avg(F.when(y == 1, miss * (1 - gate)).otherwise(false_alarm * gate) + bce_weight * bce(y, x)).alias("loss"))


def expected_profit(df: DataFrame, label: str, p: str, revenue: float = 1.0, default_cost: float = 10.0, cutoff: float = 0.5, temperature: float = 0.1, bce_weight: float = 0.1) -> DataFrame:
    """Less the profit of soft approval under the cutoff, plus some cross entropy."""
    rows, y, x = _rows(df, label, p)
    approve = sigmoid((F.lit(cutoff) - x) / temperature)
    return rows.agg(F.avg(-approve * F.when(y == 1, -default_cost).otherwise(revenue) + bce_weight * bce(y, x)).alias("loss"))


def amount_weighted(df: DataFrame, label: str, p: str, amount: str, floor: float = 0.1) -> DataFrame:
    """Cross entropy weighted by the amount over its mean, at least ``floor``."""
    rows, y, x = _rows(df, label, p)
    mean = rows.agg(F.avg(F.col(amount).cast("double"))).first()[0] or 1.0
    w = F.greatest(F.col(amount).cast("double") / mean, F.lit(floor))
    return rows.agg((F.sum(w * bce(y, x)) / F.sum(w)).alias("loss"))


def expected_value(df: DataFrame, label: str, p: str, exposure: str, lgd: float = 0.5, rate: float = 0.08, cost: float = 0.0, floor: float = 0.1) -> DataFrame:
    """Cross entropy weighted by what is at stake: the loss given default of the bad, the margin of the good."""
    rows, y, x = _rows(df, label, p)
    w = F.greatest(F.when(y == 1, lgd * F.col(exposure)).otherwise(rate * F.col(exposure) - cost), F.lit(floor))
    return rows.agg((F.sum(w * bce(y, x)) / F.sum(w)).alias("loss"))
