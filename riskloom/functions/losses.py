"""Loss functions as Columns: value, gradient and hessian with respect to the margin."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-7


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def clipped(p: Column) -> Column:
    return F.greatest(F.least(p, F.lit(1 - EPS)), F.lit(EPS))


@dataclass(frozen=True)
class Loss:
    """Row-wise loss of (y, p); ``margin`` gradients follow from p = sigmoid(margin)."""

    def value(self, y: Column, p: Column) -> Column:
        raise NotImplementedError

    def gradient(self, y: Column, p: Column) -> Column:
        raise NotImplementedError

    def hessian(self, y: Column, p: Column) -> Column:
        return p * (1 - p)

    def slopes(self, df: DataFrame, label: str, p: str) -> DataFrame:
        """``df`` with ``gradient`` and ``hessian`` with respect to the margin, as boosting takes them."""
        y, x = F.col(label), clipped(F.col(p))
        return df.withColumns({"gradient": self.gradient(y, x), "hessian": self.hessian(y, x)})

    def mean(self, df: DataFrame, label: str, p: str) -> DataFrame:
        return df.where(F.col(label).isNotNull()).agg(F.avg(self.value(F.col(label), F.col(p))).alias("loss"))


@dataclass(frozen=True)
class CrossEntropy(Loss):
    """Class-weighted log loss."""

    positive: float = 1.0
    negative: float = 1.0

    def weight(self, y: Column) -> Column:
        return F.when(y == 1, F.lit(self.positive)).otherwise(F.lit(self.negative))

    def value(self, y, p):
        p = clipped(p)
        return -self.weight(y) * F.when(y == 1, F.log(p)).otherwise(F.log(1 - p))

    def gradient(self, y, p):
        return self.weight(y) * (p - y)

    def hessian(self, y, p):
        return self.weight(y) * p * (1 - p)


@dataclass(frozen=True)
class Focal(Loss):
    """-alpha_t (1 - p_t)^gamma log p_t."""

    alpha: float = 0.25
    gamma: float = 2.0

    def _t(self, y, p) -> tuple[Column, Column]:
        p = clipped(p)
        return F.when(y == 1, p).otherwise(1 - p), F.when(y == 1, F.lit(self.alpha)).otherwise(F.lit(1 - self.alpha))

    def value(self, y, p):
        t, a = self._t(y, p)
        return -a * F.pow(1 - t, self.gamma) * F.log(t)

    def gradient(self, y, p):
        t, a = self._t(y, p)
        return F.when(y == 1, 1).otherwise(-1) * a * F.pow(1 - t, self.gamma) * (self.gamma * t * F.log(t) + t - 1)


@dataclass(frozen=True)
class Asymmetric(Loss):
    """Focal loss with separate exponents for the classes: alpha for the bad, 1 - alpha for the good."""

    alpha: float = 0.25
    gamma_positive: float = 2.0
    gamma_negative: float = 1.0

    def value(self, y, p):
        p = clipped(p)
        return F.when(y == 1, -self.alpha * F.pow(1 - p, self.gamma_positive) * F.log(p)).otherwise(-(1 - self.alpha) * F.pow(p, self.gamma_negative) * F.log(1 - p))

    def gradient(self, y, p):
        p, q = clipped(p), 1 - clipped(p)
        bad = self.alpha * F.pow(q, self.gamma_positive) * (self.gamma_positive * p * F.log(p) - q)
        good = (1 - self.alpha) * F.pow(p, self.gamma_negative) * (p - self.gamma_negative * q * F.log(q))
        return F.when(y == 1, bad).otherwise(good)


@dataclass(frozen=True)
class CostSensitive(Loss):
    """Expected cost of deciding by probability."""

    false_negative: float = 10.0
    false_positive: float = 1.0

    def value(self, y, p):
        return F.when(y == 1, self.false_negative * (1 - p)).otherwise(self.false_positive * p)

    def gradient(self, y, p):
        return F.when(y == 1, -self.false_negative).otherwise(self.false_positive) * p * (1 - p)


@dataclass(frozen=True)
class Smoothed(Loss):
    """Cross entropy against labels drawn towards one half: y (1 - s) + s / 2."""

    smoothing: float = 0.1

    def target(self, y: Column) -> Column:
        return y * (1 - self.smoothing) + self.smoothing / 2

    def value(self, y, p):
        p, y = clipped(p), self.target(y)
        return -y * F.log(p) - (1 - y) * F.log(1 - p)

    def gradient(self, y, p):
        return p - self.target(y)


@dataclass(frozen=True)
class CapturedTop(Loss):
    """Soft gate at ``edge``: bad rows under it cost ``miss``, good rows over it ``false_alarm``; plus some cross entropy."""

    edge: float
    miss: float = 5.0
    false_alarm: float = 1.0
    temperature: float = 0.05
    bce_weight: float = 0.1

    def _gate(self, p: Column) -> Column:
        return sigmoid((p - self.edge) / self.temperature)

    def value(self, y, p):
        gate = self._gate(p)
        return F.when(y == 1, self.miss * (1 - gate)).otherwise(self.false_alarm * gate) + self.bce_weight * CrossEntropy().value(y, p)

    def gradient(self, y, p):
        gate = self._gate(p)
        side = F.when(y == 1, -self.miss).otherwise(self.false_alarm)
        return side * gate * (1 - gate) / self.temperature * p * (1 - p) + self.bce_weight * (p - y)


@dataclass(frozen=True)
class SoftProfit(Loss):
    """Less the profit of approving softly under ``cutoff``; plus some cross entropy."""

    revenue: float = 1.0
    default_cost: float = 10.0
    cutoff: float = 0.5
    temperature: float = 0.1
    bce_weight: float = 0.1

    def value(self, y, p):
        approve = sigmoid((self.cutoff - p) / self.temperature)
        return -approve * F.when(y == 1, -self.default_cost).otherwise(self.revenue) + self.bce_weight * CrossEntropy().value(y, p)

    def gradient(self, y, p):
        approve = sigmoid((self.cutoff - p) / self.temperature)
        return F.when(y == 1, -self.default_cost).otherwise(self.revenue) * approve * (1 - approve) / self.temperature * p * (1 - p) + self.bce_weight * (p - y)


@dataclass(frozen=True)
class Weighted(Loss):
    """Cross entropy times a weight of each row, such as ``at_stake`` or an amount over its mean."""

    weight: Column

    def value(self, y, p):
        return self.weight * CrossEntropy().value(y, p)

    def gradient(self, y, p):
        return self.weight * (p - y)

    def hessian(self, y, p):
        return self.weight * p * (1 - p)


def at_stake(y: Column, exposure: Column, lgd: float = 0.5, rate: float = 0.08, cost: float = 0.0, floor: float = 0.1) -> Column:
    """Loss given default of the bad, margin of the good, ``floor`` at least."""
    return F.greatest(F.when(y == 1, lgd * exposure).otherwise(rate * exposure - cost), F.lit(floor))


def balanced_weights(df: DataFrame, label: str) -> CrossEntropy:
    """Class weights n / (2 n_class) from one aggregate."""
    n, bad = df.where(F.col(label).isNotNull()).agg(F.count("*"), F.sum(label)).first()
    return CrossEntropy(n / (2 * bad) if bad else 1.0, n / (2 * (n - bad)) if n > (bad or 0) else 1.0)


def expected_profit(p: Column, amount: Column, margin: float = 0.1, loss_given_default: float = 0.6) -> Column:
    """Expected profit of approving: margin from the good, loss from the bad."""
    return amount * ((1 - p) * margin - p * loss_given_default)


def approval_loss(df: DataFrame, label: str, p: str, approval: float, amount: str | None = None) -> DataFrame:
    """Bad share (by amount) of the ``approval`` share of rows with the lowest probability; the border tie counts by its mean."""
    from ..operators.metrics import by_score, cumulate

    c = cumulate(by_score(df, label, p, amount), descending=False)
    take = F.col("total_n") * approval
    first = F.col("cum_n") - F.col("n")
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (take - first) / F.col("n")))
    return c.agg((F.sum(F.col("bad") * part) / F.sum(F.col("n") * part)).alias("loss"))


def pairwise_ranking(df: DataFrame, label: str, p: str, cells: int = 2000) -> DataFrame:
    """Mean logistic loss over all (bad, good) pairs of probabilities.

    Pairs are never made of rows.  Scores fall into ``cells`` cells, a fixed
    number whatever the input; in each, the bad and the good rows stand at
    their own mean.  Against pairs of rows the error is of second order: under
    1 / (8 cells^2).
    """
    rows = df.where(F.col(label).isNotNull() & F.col(p).isNotNull()).select(F.col(p).cast("double").alias("s"), F.col(label).cast("double").alias("y"))
    good = F.col("y") == 0
    grid = rows.groupBy(F.floor(F.col("s") * cells).alias("c")).agg(F.sum("y").alias("b"), F.sum(1 - F.col("y")).alias("g"), F.avg(F.when(~good, F.col("s"))).alias("sb"), F.avg(F.when(good, F.col("s"))).alias("sg"))
    listed = grid.agg(F.collect_list(F.struct("b", "g", "sb", F.coalesce("sg", F.lit(0.0)).alias("sg"))).alias("c"))  # cells + 1 entries at most
    pairs = listed.select(F.explode("c").alias("x"), "c").where("x.b > 0")
    loss = F.aggregate("c", F.lit(0.0), lambda a, y: a + y["g"] * F.log1p(F.exp(y["sg"] - F.col("x.sb"))))
    total = F.aggregate("c", F.lit(0.0), lambda a, y: a + y["g"])
    return pairs.select("x", loss.alias("l"), total.alias("gs")).agg((F.sum(F.col("x.b") * F.col("l")) / F.sum(F.col("x.b") * F.col("gs"))).alias("loss"))
