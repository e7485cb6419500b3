"""Category encoders: fitted by one aggregate per column, applied as a join or a CASE.

A fitted encoder is a mapping table.  Small mappings (``INLINE`` values at
most, checked when fitting) are applied as a literal map; larger ones by a
left join, which Spark broadcasts only under its own size limit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks
from .binning import bucket

INLINE = 2000


@dataclass
class Mapping:
    """Values of one column and what they become; ``unknown`` and ``missing`` are used for what the mapping lacks."""

    column: str
    table: DataFrame  # (value string, code double)
    unknown: float | None
    missing: float | None
    literal: dict[str, float] | None = None

    @classmethod
    def of(cls, column: str, table: DataFrame, unknown: float | None, missing: float | None) -> Mapping:
        rows = table.limit(INLINE + 1).collect()
        literal = {r["value"]: r["code"] for r in rows} if len(rows) <= INLINE else None
        return cls(column, table, unknown, missing, literal)

    def apply(self, df: DataFrame, out: str) -> DataFrame:
        v = F.col(self.column).cast("string")
        lit = lambda x: F.lit(x).cast("double")
        if self.literal is not None:
            pairs = [F.lit(x) for kv in self.literal.items() for x in kv]
            found = F.create_map(*pairs)[v] if pairs else lit(None)
            return df.withColumn(out, F.when(v.isNull(), lit(self.missing)).otherwise(F.coalesce(found, lit(self.unknown))))
        own = self.table.select(F.col("value").alias("_v"), F.col("code").alias("_code"))
        joined = df.withColumn("_v", v).join(own, "_v", "left")
        return joined.withColumn(out, F.when(F.col("_v").isNull(), lit(self.missing)).otherwise(F.coalesce("_code", lit(self.unknown)))).drop("_v", "_code")


def _groups(df: DataFrame, column: str, label: str | None = None) -> DataFrame:
    rows = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value"))
    return rows.agg(F.count("*").alias("n"), *([F.sum(F.col(label).cast("double")).alias("s"), F.count(label).alias("m")] if label else []))


def woe(df: DataFrame, column: str, label: str, regularization: float = 1.0, clip: float | None = 5.0) -> tuple[Mapping, float]:
    """WOE per value, ln(((bad+r)/(B+2r)) / ((good+r)/(G+2r))), and the IV of the column (unclipped); missing and unknown become 0."""
    g, r = _groups(df, column, label), float(regularization)
    bad, rows = (float(x or 0.0) for x in g.agg(F.sum("s"), F.sum("m")).first())
    pb = (F.col("s") + r) / (bad + 2 * r)
    pg = (F.col("m") - F.col("s") + r) / (rows - bad + 2 * r)
    t = g.select("value", F.log(pb / pg).alias("w"), ((pb - pg) * F.log(pb / pg)).alias("iv"))
    code = F.col("w") if clip is None else F.greatest(F.least("w", F.lit(float(clip))), F.lit(-float(clip)))
    total = t.agg(F.sum("iv")).first()[0]
    return Mapping.of(column, t.select("value", code.alias("code")), 0.0, 0.0), float(total or 0.0)


def target(df: DataFrame, column: str, label: str, smoothing: float = 1.0, min_samples_leaf: int = 1) -> Mapping:
    """Smoothed mean of the label: (n * mean + s * overall) / (n + s); overall under ``min_samples_leaf`` rows."""
    overall = float(df.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0)
    t = _groups(df, column, label)
    code = F.when(F.col("m") < min_samples_leaf, F.lit(overall)).otherwise((F.col("s") + smoothing * overall) / (F.col("m") + smoothing))
    return Mapping.of(column, t.select("value", code.alias("code")), overall, overall)


def count(df: DataFrame, column: str, normalize: bool = False, min_group_size: int | None = None) -> Mapping:
    """Frequency of a value; values rarer than ``min_group_size`` share their total."""
    t = _groups(df, column)
    n = F.col("n").cast("double")
    few = F.col("n") < (min_group_size or 0)
    total, rare = (float(x or 0.0) for x in t.agg(F.sum("n"), F.sum(F.when(few, F.col("n")))).first())
    n = F.when(few, rare).otherwise(n)
    if normalize:
        n = n / max(total, 1.0)
    return Mapping.of(column, t.select("value", n.alias("code")), 0.0, 0.0)


def quantile(df: DataFrame, column: str, label: str, q: float = 0.5, m: float = 1.0) -> Mapping:
    """Smoothed quantile of the label per value: (n * q_value + m * q_all) / (n + m)."""
    cells = df.select(F.col(column).cast("string").alias("value"), F.col(label).cast("double").alias("x"))
    one = lambda rows, keys: ranks.percentiles(rows, keys, [q]).select(*keys, "n", F.col("q")[0].alias("p"))
    found = one(cells, []).first()
    overall = float(found["p"]) if found else 0.0
    rows = one(cells.where("value IS NOT NULL"), ["value"])
    return Mapping.of(column, rows.select("value", ((F.col("n") * F.col("p") + m * overall) / (F.col("n") + m)).alias("code")), overall, overall)


def ordinal(df: DataFrame, column: str, mapping: dict[str, int] | None = None) -> Mapping:
    """Integers in order of value (or as given); unknown and missing are -1."""
    if mapping is not None:
        table = df.sparkSession.createDataFrame([(str(k), float(v)) for k, v in mapping.items()], "value string, code double")
    else:
        table = _ranked(df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value")).distinct())
    return Mapping.of(column, table, -1.0, -1.0)


def _ranked(values: DataFrame) -> DataFrame:
    """Distinct values numbered from 0 in order: ranges of their first bytes are counted, and numbered inside."""
    k = ranks.ranges_of(values)
    first = F.conv(F.rpad(F.hex(F.substring(F.encode("value", "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("double")  # in the order of the bytes
    rows = values.withColumn("_first", first)
    cuts = rows.agg(F.percentile_approx("_first", [i / k for i in range(1, k)], 10_000)).first()[0] or []
    rows = rows.select("value", bucket(F.col("_first"), sorted(set(cuts))).alias("_part"))
    sums = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))  # a row per range
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("value")) - 1
    return rows.join(F.broadcast(sums), "_part").select("value", (inside + F.col("_before")).cast("double").alias("code"))


def top_categories(df: DataFrame, column: str, max_categories: int = 10) -> list[str]:
    """The ``max_categories - 1`` most frequent values, ties by value."""
    return [r["value"] for r in _groups(df, column).orderBy(F.desc("n"), "value").limit(max_categories - 1).collect()]


def limit_cardinality(df: DataFrame, column: str, keep: list[str], out: str, other: str = "other", missing: str | None = None) -> DataFrame:
    v = F.col(column).cast("string")
    return df.withColumn(out, F.when(v.isNull(), F.lit(missing)).when(v.isin(*keep), v).otherwise(other))


def one_hot(df: DataFrame, column: str, categories: list[str] | None = None, drop_first: bool = False) -> DataFrame:
    """One 0/1 column per category, named ``column_value``; unknown and missing are all 0."""
    if categories is None:
        categories = [r["value"] for r in _groups(df, column).select("value").orderBy("value").collect()]
    v = F.col(column).cast("string")
    return df.withColumns({f"{column}_{c}": F.coalesce((v == c).cast("int"), F.lit(0)) for c in categories[1 if drop_first else 0 :]})


def ordered_target(df: DataFrame, column: str, label: str, order: Column, out: str, prior_weight: float = 1.0, tie_breaker: Column | None = None) -> DataFrame:
    """Ordered target statistics: (sum of earlier labels of the value + a * overall) / (earlier rows + a).

    Rows of equal ``order`` stand in order of ``tie_breaker`` (by default a
    hash of the whole row, so that no result depends on chance).  A value with
    very many rows is cut into runs of the order, as many as the session has
    shuffle partitions: sums of earlier runs are carried in, so that no window
    holds a third of the table.
    """
    overall = float(df.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0)
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]) if tie_breaker is None else tie_breaker
    rows = df.withColumns({"_v": F.col(column).cast("string"), "_o": order, "_t": tie, "_y": F.col(label).cast("double")})
    k, place = ranks.ranges_of(df), F.col("_o").cast("double")  # the cast only cuts runs; the order itself keeps its type
    cuts = sorted(set(rows.agg(F.percentile_approx(place, [i / k for i in range(1, k)], 10_000)).first()[0] or []))
    rows = rows.withColumn("_run", bucket(place, cuts))
    per = rows.groupBy("_v", "_run").agg(F.sum("_y").alias("_s"), F.count("_y").alias("_n"))
    before = Window.partitionBy("_v").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("_v", "_run", F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_s0"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"))
    inside = Window.partitionBy("_v", "_run").orderBy("_o", "_t").rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(per.withColumnsRenamed({"_v": "_v2", "_run": "_run2"}), F.col("_v").eqNullSafe(F.col("_v2")) & (F.col("_run") == F.col("_run2")))
    s = F.coalesce(F.sum("_y").over(inside), F.lit(0.0)) + F.col("_s0")
    n = F.coalesce(F.count("_y").over(inside), F.lit(0)) + F.col("_n0")
    return joined.withColumn(out, (s + prior_weight * overall) / (n + prior_weight)).drop("_v", "_o", "_t", "_y", "_run", "_v2", "_run2", "_s0", "_n0")


def tree_leaves(df: DataFrame, features: list[str], label: str, n_trees: int = 20, max_depth: int = 4, seed: int = 42, output: str = "leaf"):
    """Gradient-boosted encoder: (model, transformer) giving leaf indices or probabilities; nulls become a value under all others."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    from .models import spread

    filled = [f"_f_{f}" for f in features]
    prepare = lambda d: d.withColumns({g: F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")), F.lit(-1e30)) for f, g in zip(features, filled)})
    gbt = GBTClassifier(featuresCol="_x", labelCol=label, maxIter=n_trees, maxDepth=max_depth, seed=seed, leafCol="leaf", predictionCol="_pred")
    model = Pipeline(stages=[VectorAssembler(inputCols=filled, outputCol="_x"), gbt]).fit(prepare(spread(df.select(label, *features))))

    def transform(d: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        out = model.transform(prepare(d))
        extra = vector_to_array("probability")[1].alias("probability") if output == "probability" else vector_to_array("leaf").alias("leaves")
        return out.select(*d.columns, extra)

    return model, transform


