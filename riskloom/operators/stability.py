"""Population stability: PSI tables in one pass, batches, periods, groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .binning import BinModel, all_edges

FLOOR = 1e-10


def pooled_model(df: DataFrame, feature: str, n_bins: int = 10, where: Column | None = None) -> BinModel:
    """Quantile bins of the pooled rows (or of those ``where`` admits, such as a base period)."""
    return pooled_models(df, [feature], n_bins, where)[feature]


def pooled_models(df: DataFrame, features: list[str], n_bins: int = 10, where: Column | None = None) -> dict[str, BinModel]:
    """The bins of many features with the scans of one."""
    found = all_edges(df if where is None else df.where(where), features, [0.0, *[i / n_bins for i in range(1, n_bins)]])
    return {f: BinModel(f, sorted({s for s in found[f][1:] if s > found[f][0]}) if f in found else [], method="quantile") for f in features}


def psi_term(expected: Column, actual: Column, floor: float = FLOOR) -> Column:
    e, a = F.greatest(expected, F.lit(floor)), F.greatest(actual, F.lit(floor))
    return (a - e) * F.log(a / e)


def psi_table(df: DataFrame, model: BinModel, is_actual: Column, floor: float = FLOOR) -> DataFrame:
    """(bin, expected_n, actual_n, expected_share, actual_share, psi_bin, psi): both samples in one conditional aggregate, no join."""
    rows = df.groupBy(model.index().alias("bin")).agg(F.count_if(~is_actual).alias("expected_n"), F.count_if(is_actual).alias("actual_n"))
    every = Window.partitionBy(F.lit(0))
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.sum(c).over(every)), F.lit(0.0))
    rows = rows.select("*", share("expected_n").alias("expected_share"), share("actual_n").alias("actual_share"))
    rows = rows.withColumn("psi_bin", psi_term(F.col("expected_share"), F.col("actual_share"), floor))
    return rows.withColumn("psi", F.sum("psi_bin").over(every))


def batch_psi(df: DataFrame, models: dict[str, BinModel], is_actual: Column, floor: float = FLOOR) -> DataFrame:
    """(feature, psi) of many features from one scan."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), m.index().alias("bin")) for f, m in models.items()]))
    rows = df.select(is_actual.alias("_a"), cells.alias("_c")).groupBy("_c.feature", "_c.bin").agg(F.count_if(~F.col("_a")).alias("e"), F.count_if("_a").alias("a"))
    own = Window.partitionBy("feature")
    rows = rows.withColumn("t", psi_term(*[F.coalesce(F.try_divide(F.col(c), F.sum(c).over(own)), F.lit(0.0)) for c in ("e", "a")], floor))
    return rows.groupBy("feature").agg(F.sum("t").alias("psi"))


def psi_by_period(df: DataFrame, models: dict[str, BinModel], period: Column, base: str | None = None, by: list[str] | None = None) -> DataFrame:
    """(by..., feature, period, n, psi) of every period against ``base`` (or the first period of the group)."""
    by = by or []
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), m.index().alias("bin")) for f, m in models.items()]))
    rows = df.select(*by, period.alias("period"), cells.alias("_c")).where("period IS NOT NULL")
    counts = rows.groupBy(*by, F.col("_c.feature").alias("feature"), "period", F.col("_c.bin").alias("bin")).agg(F.count("*").alias("n"))
    keys = [*by, "feature"]
    first = F.lit(base) if base is not None else F.min("period").over(Window.partitionBy(*keys))
    counts = counts.withColumns({"base": first, "share": F.col("n") / F.sum("n").over(Window.partitionBy(*keys, "period"))})
    reference = counts.where("period = base").select(*keys, "bin", F.col("share").alias("e"))
    periods = counts.groupBy(*keys, "period").agg(F.sum("n").alias("n"))
    # every bin of the base or of the period takes part: a union with negative marks instead of an outer join
    grid = periods.join(reference, keys).unionByName(counts.select(*keys, "period", "bin", F.col("share").alias("a")), allowMissingColumns=True)
    cells_ = grid.groupBy(*keys, "period", "bin").agg(F.coalesce(F.max("e"), F.lit(0.0)).alias("e"), F.coalesce(F.max("a"), F.lit(0.0)).alias("a"))
    out = cells_.groupBy(*keys, "period").agg(F.sum(psi_term(F.col("e"), F.col("a"))).alias("psi"))
    return periods.join(out, [*keys, "period"])


def psi_matrix(df: DataFrame, model: BinModel, group: str) -> DataFrame:
    """(group_a, group_b, psi) of every pair of groups; pairs are of groups, joined on the bin, never of rows."""
    counts = df.groupBy(F.col(group).cast("string").alias("g"), model.index().alias("bin")).agg(F.count("*").alias("n"))
    share = counts.withColumn("s", F.col("n") / F.sum("n").over(Window.partitionBy("g")))
    filled = share.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("bin", "s"))).alias("m"))  # one small map per group
    a, b = filled.toDF("group_a", "ma"), filled.toDF("group_b", "mb")
    pairs = a.join(b, F.col("group_a") < F.col("group_b"))
    bins = F.array_union(F.map_keys("ma"), F.map_keys("mb"))
    total = F.aggregate(bins, F.lit(0.0), lambda s, k: s + psi_term(F.coalesce(F.col("ma")[k], F.lit(0.0)), F.coalesce(F.col("mb")[k], F.lit(0.0))))
    return pairs.select("group_a", "group_b", total.alias("psi"))


def feature_drift(df: DataFrame, models: dict[str, BinModel], is_actual: Column, label: str | None = None) -> DataFrame:
    """(feature, psi, mean and missing rate of both samples and their change[, bad rates])."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in models]))
    y = F.lit(None).cast("double") if label is None else F.col(label).cast("double")
    rows = df.select(is_actual.alias("_a"), y.alias("_y"), cells.alias("_c"))
    on = lambda c, a: F.avg(F.when(F.col("_a") == a, c))
    x, gone = F.col("_c.x"), F.col("_c.x").isNull().cast("double")
    out = rows.groupBy(F.col("_c.feature").alias("feature")).agg(
        on(x, False).alias("mean_base"), on(x, True).alias("mean_actual"), on(gone, False).alias("missing_base"), on(gone, True).alias("missing_actual"),
        *([on(F.col("_y"), False).alias("bad_rate_base"), on(F.col("_y"), True).alias("bad_rate_actual")] if label else []),
    )
    out = out.withColumns({"mean_change": F.col("mean_actual") - F.col("mean_base"), "missing_change": F.col("missing_actual") - F.col("missing_base")})
    return out.join(batch_psi(df, models, is_actual), "feature")
