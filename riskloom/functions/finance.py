"""Time value of money as Column expressions.

All take Columns or numbers; ``begin`` is 1 for payments at the start of a
period.  Signs follow the usual convention: money paid out is negative.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Value = Column | float | int


def _c(x: Value) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def _terms(rate: Value, nper: Value, begin: Value) -> tuple[Column, Column]:
    """(growth over all periods, annuity factor for a payment of one)."""
    r, n, w = _c(rate), _c(nper), _c(begin)
    growth = F.pow(1 + r, n)
    return growth, F.when(r == 0, n).otherwise((1 + r * w) * (growth - 1) / F.when(r == 0, F.lit(1.0)).otherwise(r))


def fv(rate: Value, nper: Value, pmt: Value, pv: Value, begin: Value = 0) -> Column:
    growth, annuity = _terms(rate, nper, begin)
    return -(_c(pv) * growth + _c(pmt) * annuity)


def pv(rate: Value, nper: Value, pmt: Value, fv: Value = 0, begin: Value = 0) -> Column:
    growth, annuity = _terms(rate, nper, begin)
    return -(_c(fv) + _c(pmt) * annuity) / growth


def pmt(rate: Value, nper: Value, pv: Value, fv: Value = 0, begin: Value = 0) -> Column:
    growth, annuity = _terms(rate, nper, begin)
    return -(_c(fv) + _c(pv) * growth) / annuity


def nper(rate: Value, pmt: Value, pv: Value, fv: Value = 0, begin: Value = 0) -> Column:
    r, p, v, f, w = map(_c, (rate, pmt, pv, fv, begin))
    z = p * (1 + r * w) / F.when(r == 0, F.lit(1.0)).otherwise(r)
    return F.when(r == 0, -(f + v) / p).otherwise(F.log((z - f) / (z + v)) / F.log(1 + r))


def ipmt(rate: Value, per: Value, nper: Value, pv: Value, fv: Value = 0, begin: Value = 0) -> Column:
    """Interest share of payment ``per`` (1-based)."""
    r, k, w = _c(rate), _c(per), _c(begin)
    level = pmt(rate, nper, pv, fv, begin)
    growth, annuity = _terms(rate, k - 1, begin)
    interest = -(_c(pv) * growth + level * annuity) * r
    return F.when((w == 1) & (k == 1), F.lit(0.0)).when(w == 1, interest / (1 + r)).otherwise(interest)


def ppmt(rate: Value, per: Value, nper: Value, pv: Value, fv: Value = 0, begin: Value = 0) -> Column:
    return pmt(rate, nper, pv, fv, begin) - ipmt(rate, per, nper, pv, fv, begin)


def npv(rate: Value, flows: Column) -> Column:
    """Present value of an array of flows, the first at time 0."""
    r = _c(rate)
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("discount"))
    step = lambda a, x: F.struct((a["sum"] + x * a["discount"]).alias("sum"), (a["discount"] / (1 + r)).alias("discount"))
    return F.aggregate(flows, zero, step)["sum"]


def mirr(flows: Column, finance_rate: Value, reinvest_rate: Value) -> Column:
    n = F.size(flows)
    paid = npv(finance_rate, F.transform(flows, lambda x: F.least(x, F.lit(0.0))))
    earned = npv(reinvest_rate, F.transform(flows, lambda x: F.greatest(x, F.lit(0.0)))) * F.pow(1 + _c(reinvest_rate), n - 1)
    return F.when((paid < 0) & (earned > 0), F.pow(earned / -paid, 1 / (n - 1)) - 1)


def _irr(flows: pd.Series) -> np.ndarray:
    """Roots of the net present values by bisection from -0.99; the upper ends double until the values are negative.  All rows step together."""
    sizes = [0 if f is None else len(f) for f in flows]
    v = np.zeros((len(sizes), max(sizes, default=0) or 1))
    for row, f, n in zip(v, flows, sizes):
        row[:n] = f if n else 0

    def value(r: np.ndarray) -> np.ndarray:
        out, step = np.zeros(len(r)), 1 / (1 + r)
        for column in v.T[::-1]:
            out = out * step + column
        return out

    with np.errstate(all="ignore"):
        low, high = np.full(len(v), -0.99), np.ones(len(v))
        for _ in range(60):
            above = value(high) > 0
            if not above.any():
                break
            high = np.where(above, 2 * high, high)
        found = (value(low) > 0) & (value(high) <= 0)
        for _ in range(200):
            mid = (low + high) / 2
            up = value(mid) > 0
            low, high = np.where(up, mid, low), np.where(up, high, mid)
            if (high - low < 1e-13)[found].all():
                break
    return np.where(found, (low + high) / 2, np.nan)


def irr(flows: Column) -> Column:
    """Internal rate of return of an array of flows: bisection of a whole Arrow batch at once; null where the sign never changes."""

    @F.pandas_udf("double")
    def solve(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(_irr(s))

    return solve(flows)


def rate(nper: Value, pmt: Value, pv: Value, fv: Value = 0, begin: Value = 0, tol: float = 1e-12, max_iter: int = 100) -> Column:
    """Rate per period by vectorised Newton steps (iterative: Arrow batches)."""

    @F.pandas_udf("double")
    def solve(n: pd.Series, p: pd.Series, v: pd.Series, f: pd.Series, w: pd.Series) -> pd.Series:
        n, p, v, f, w = (x.to_numpy(float) for x in (n, p, v, f, w))
        value = lambda r: f + v * (1 + r) ** n + p * (1 + r * w) * ((1 + r) ** n - 1) / r
        r = np.full(len(n), 0.1)
        with np.errstate(all="ignore"):
            for _ in range(max_iter):
                h = 1e-6 * np.maximum(np.abs(r), 1e-3)
                step = value(r) / ((value(r + h) - value(r - h)) / (2 * h))
                new = np.where(np.abs(r - step) < 1e-15, 1e-15, r - step)
                settled = np.abs(new - r) < np.maximum(tol, 1e-9 * np.abs(new))
                r = new
                if (settled | ~np.isfinite(r)).all():
                    break
        return pd.Series(np.where(np.isfinite(r) & settled, r, np.nan))

    return solve(*map(_c, (nper, pmt, pv, fv, begin)))
