"""Label construction from days past due, and ratings of summary figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean(col: Column | str) -> Column:
    """Numeric input with NaN as NULL (Spark orders NaN above every number)."""
    c = F.col(col) if isinstance(col, str) else col
    c = c.cast("double")
    return F.when(~F.isnan(c), c)


def overdue_label(overdue: Column | str, dpd: float, drop_grey: bool = False) -> Column:
    """1 above ``dpd`` days, 0 at or under; with ``drop_grey`` 0 only without any overdue day and NULL between."""
    od = clean(overdue)
    good = od <= 0 if drop_grey else od <= dpd
    return F.when(od > dpd, 1).when(good, 0).cast("int")


def label_name(overdue: str, dpd: float) -> str:
    return f"{overdue}_{dpd:g}+"


def with_labels(df: DataFrame, overdue: list[str], dpds: list[float], drop_grey: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Long format: one row per input row and label, with ``label`` and ``y``; rows without a label value go.  One scan serves all labels."""
    pairs = [F.struct(F.lit(label_name(o, d)).alias("label"), overdue_label(o, d, drop_grey).alias("y")) for o in overdue for d in dpds]
    columns = df.columns if keep is None else keep
    return df.select(*columns, F.explode(F.array(*pairs)).alias("_l")).select(*columns, "_l.label", "_l.y").where("y IS NOT NULL")


def binary_labels_only(df: DataFrame, label: str) -> None:
    """Raise unless every value of ``label`` is 0, 1 or NULL."""
    bad = df.where(F.col(label).isNotNull() & ~F.col(label).isin(0, 1)).select(label).limit(1).collect()
    if bad:
        raise ValueError(f"{label} holds {bad[0][0]!r}; expected 0, 1 or null")


def _rated(x: Column, bounds: list[float], names: list[str]) -> Column:
    out = F.when(x.isNull(), None)
    for bound, name in zip(bounds, names):
        out = out.when(x < bound, name)
    return out.otherwise(names[-1])


def iv_rating(x: Column) -> Column:
    return _rated(x, [0.02, 0.1, 0.3, 0.5], ["none", "weak", "medium", "strong", "suspicious"])


def psi_rating(x: Column) -> Column:
    return _rated(x, [0.1, 0.25], ["stable", "shifting", "unstable"])


def vif_rating(x: Column) -> Column:
    return _rated(x, [5, 10], ["low", "moderate", "high"])


def corr_rating(x: Column) -> Column:
    return _rated(F.abs(x), [0.3, 0.7, 0.9], ["weak", "moderate", "strong", "very strong"])


def safe_divide(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(default))


def period(date: Column | str, freq: str = "M") -> Column:
    """Period text of a date: D, W (Monday/Sunday), M, Q, Y."""
    d = F.to_date(F.col(date) if isinstance(date, str) else date)
    if freq == "W":
        monday = F.trunc(d, "week")
        return F.concat(monday.cast("string"), F.lit("/"), F.date_add(monday, 6).cast("string"))
    return {
        "D": d.cast("string"),
        "M": F.date_format(d, "yyyy-MM"),
        "Q": F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string")),
        "Y": F.year(d).cast("string"),
    }[freq]
