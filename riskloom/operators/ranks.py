"""Order statistics at any size: exact percentiles and running totals without a window over a whole table.

Approximate percentiles cut the rows of each group into ranges (as many as the
session has shuffle partitions); the sums of ranges, a few rows a group, are
carried forward.  Distinct values are counted, and an ordered window only ever
holds one range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Cuts of all features together that become one expression.
INLINE = 2000


def bucket(x: Column, cuts: list[float]) -> Column:
    """How many cuts are at or under x, by a balanced tree of comparisons."""

    def walk(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x >= float(cuts[mid]), walk(mid + 1, hi)).otherwise(walk(lo, mid))

    return walk(0, len(cuts)).cast("int")


def ranges_of(df: DataFrame) -> int:
    """How many ranges an order is cut into: as many as the session has shuffle partitions, 8 to 1000."""
    return max(8, min(1000, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def value_counts(cells: DataFrame, keys: list[str], value: str = "x") -> DataFrame:
    """(keys..., x, n) of the values that are not null."""
    return cells.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("x")).agg(F.count("*").alias("n"))


def _on(left: str, right: str, names: list[str]) -> Column:
    out = F.lit(True)
    for c in names:
        out = out & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out


def _few(keys: list[str], small: DataFrame) -> DataFrame:
    """A table of a bounded number of rows per group is broadcast where the groups are features; else Spark decides by its size."""
    return F.broadcast(small) if keys in ([], ["feature"]) else small


def placed(rows: DataFrame, keys: list[str], source: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``_range``, the place of x among its group's cuts, which come from ``source`` (by default the rows)."""
    k = ranges_of(rows)
    cuts = (rows if source is None else source).where("x IS NOT NULL").groupBy(*keys).agg(F.percentile_approx(F.col("x").cast("double"), [i / k for i in range(1, k)], 100 * k).alias("_cuts"))
    if keys in ([], ["feature"]):  # ``k`` numbers a feature: kept, so that they are not found again for every use of the rows
        found = cuts.collect()
        if len(found) * k <= INLINE:  # as one expression
            tree = {r["feature"] if keys else None: bucket(F.col("x"), sorted(set(r["_cuts"] or []))) for r in found}
            return rows.withColumn("_range", reduce(lambda e, f: e.when(F.col("feature") == f, tree[f]), tree, F.when(F.lit(False), 0)) if keys else tree.get(None, F.lit(0)))
        cuts = rows.sparkSession.createDataFrame(found, cuts.schema)
    joined = rows.alias("v").join(_few(keys, cuts.alias("c")), _on("v", "c", keys)) if keys else rows.alias("v").join(F.broadcast(cuts.alias("c")))
    return joined.select("v.*", F.size(F.filter("c._cuts", lambda c: c <= F.col("v.x"))).alias("_range"))


def running(counts: DataFrame, keys: list[str], sums: dict[str, Column], source: DataFrame | None = None) -> DataFrame:
    """``counts`` with, for each named sum, ``name`` up to and with the row in order of x, and ``name_total`` of its group."""
    rows = placed(counts.withColumns({f"_{c}": v for c, v in sums.items()}), keys, source)
    per = rows.groupBy(*keys, "_range").agg(*[F.sum(f"_{c}").alias(c) for c in sums])
    group, order = Window.partitionBy(*(keys or [F.lit(0)])), Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*keys, "_range", *[F.coalesce(F.sum(c).over(order), F.lit(0)).alias(f"{c}_before") for c in sums], *[F.sum(c).over(group).alias(f"{c}_total") for c in sums])
    inside = Window.partitionBy(*[F.col(f"r.{c}") for c in [*keys, "_range"]]).orderBy("r.x").rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.alias("r").join(_few(keys, per.alias("p")), _on("r", "p", [*keys, "_range"]))
    return joined.select(*[F.col(f"r.{c}") for c in counts.columns], *[(F.sum(f"r._{c}").over(inside) + F.col(f"p.{c}_before")).alias(c) for c in sums], *[F.col(f"p.{c}_total") for c in sums])


def percentiles(cells: DataFrame, keys: list[str], probabilities: list[float], weight: str | None = None) -> DataFrame:
    """(keys..., n, q) of the rows (keys..., x): exact percentiles with linear interpolation, in the order of ``probabilities``.

    ``weight`` names a column that says how many rows a row stands for (counted values).

    Three scans without a shuffle of rows: cuts, rows per range, and the values
    of those ranges only that hold a wanted rank, counted and ordered.
    """
    size = F.count("*") if weight is None else F.sum("_w")
    rows = cells.where("x IS NOT NULL") if weight is None else cells.where(F.col("x").isNotNull() & (F.col(weight) > 0))
    rows = placed(rows.select(*keys, "x", *([] if weight is None else [F.col(weight).alias("_w")])), keys)
    group = Window.partitionBy(*(keys or [F.lit(0)]))
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    per = rows.groupBy(*keys, "_range").agg(size.alias("own"))
    per = per.select(*keys, "_range", "own", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("before"), F.sum("own").over(group).alias("total"))
    spots = [F.struct(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("total") - 1)).alias("pos")) for i, p in enumerate(probabilities)]
    want = per.select("*", F.explode(F.array(*spots)).alias("w")).select("*", "w.i", (F.col("w.pos") - F.floor("w.pos")).alias("part"), F.explode(F.array(F.floor("w.pos"), F.ceil("w.pos"))).alias("rank")).drop("w")
    want = want.where("rank >= before AND rank < before + own").groupBy(*keys, "_range", "before").agg(F.first("total").alias("total"), F.collect_set(F.struct("i", "part", "rank")).alias("spots"))
    held = rows.alias("r").join(_few(keys, want.alias("p")), _on("r", "p", [*keys, "_range"]), "left_semi").groupBy(*keys, "_range", "x").agg(size.alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*keys, "_range").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    held = held.select(*keys, "_range", "x", "n", upto.alias("upto"))
    met = held.alias("r").join(_few(keys, want.alias("p")), _on("r", "p", [*keys, "_range"])).select(*[F.col(f"r.{c}") for c in keys], "x", "n", (F.col("upto") + F.col("before")).alias("upto"), "total", F.explode("spots").alias("w"))
    found = met.where("w.rank < upto AND w.rank >= upto - n").groupBy(*keys, "w.i").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.first("w.part").alias("part"), F.first("total").alias("n"))
    value = (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")).cast("double")
    out = found.groupBy(*keys).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", value.alias("v")))).alias("q"))
    return out.withColumn("q", F.transform("q", lambda c: c["v"]))
