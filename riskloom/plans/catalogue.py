"""All queries over the bundled tables, each with the same columns as its oracle.

Doubles are rounded to six digits on both sides; counts are long.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expressions, finance, losses
from ..functions import labels as L
from ..operators import bin_stats as B
from ..operators import binning, curves, eda, encoders, metrics, mining, models, portfolio_losses, scorecard, selectors, stability, strategy
from ..operators.binning import BinModel
from ..operators.rules import Rule, RulesClassifier, report, waterfall
from ..streaming import monitor
from .sql import DIGITS, EFFECTS, bin_of, bin_table, psi, r

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Six digits for doubles (and no negative zero), long for integers."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), DIGITS) + 0.0
        out.append(c.alias(f.name))
    return df.select(*out)


def query(oracle: str | None = None):
    """Register a query under its name, rounded, with its oracle."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lineitem(spark, sf) -> DataFrame:
    return t(spark, sf, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))


def orders(spark, sf) -> DataFrame:
    return t(spark, sf, "orders").withColumn("y", (F.col("o_orderstatus") == "F").cast("int"))


def scored(spark, sf) -> DataFrame:
    """Documents with labels: score n_chars, label toxic."""
    return t(spark, sf, "documents").select("doc_id", "n_chars", "source").join(t(spark, sf, "labels"), "doc_id").withColumn("y", F.col("toxic"))


def od():
    return F.pmod(F.col("l_partkey") * 31 + F.col("l_linenumber") * 17, F.lit(150))


OD_SQL = "((l_partkey * 31 + l_linenumber * 17) % 150)"
Y = "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END"
YO = "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END"
SCORED_SQL = "(SELECT d.doc_id, d.n_chars, d.source, l.toxic AS y, l.quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"


def counted(x_bin: str, table: str, y: str, where: str = "") -> str:
    return f"SELECT {x_bin} AS bin, count(*) AS n, sum({y}) AS bad FROM {table} {where} GROUP BY 1"


# --- bin tables ---

EDGES_SQL = "edges AS (SELECT list_distinct(quantile_cont(l_extendedprice, [0.2, 0.4, 0.6, 0.8])) AS e FROM lineitem)"


@query(bin_table(counted(bin_of("l_extendedprice", edges="e"), "lineitem, edges", Y), ctes=EDGES_SQL))
def bin_stats_quantile(spark, sf):
    d = lineitem(spark, sf)
    m = BinModel("l_extendedprice", sorted(set(binning.quantile_edges(d, "l_extendedprice", [0.2, 0.4, 0.6, 0.8]))))
    return B.bin_stats(d, m, "y").drop("bin_label")


@query(bin_table(counted("CAST(CASE WHEN l_quantity >= lo + 4 * w THEN 4 WHEN l_quantity >= lo + 3 * w THEN 3 WHEN l_quantity >= lo + 2 * w THEN 2 WHEN l_quantity >= lo + w THEN 1 ELSE 0 END AS INTEGER)", "lineitem, b", Y), ctes="b AS (SELECT min(l_quantity) AS lo, (max(l_quantity) - min(l_quantity)) / 5 AS w FROM lineitem)"))
def bin_stats_uniform(spark, sf):
    d = lineitem(spark, sf)
    return B.bin_stats(d, binning.fit_binning(d, "l_quantity", method="uniform", max_n_bins=5), "y").drop("bin_label")


@query(bin_table(counted(bin_of("l_extendedprice", [10000, 30000, 60000]), "lineitem", Y)))
def bin_stats_user_splits(spark, sf):
    d = lineitem(spark, sf)
    return B.bin_stats(d, binning.fit_binning(d, "l_extendedprice", user_splits=[10000, 30000, 60000]), "y").drop("bin_label")


@query(bin_table(counted(bin_of("x", [10, 20, 30, 40], special=[1.0]), f"(SELECT CASE WHEN l_linenumber % 7 = 0 THEN NULL ELSE l_quantity END AS x, {Y} AS y FROM lineitem)", "y")))
def bin_stats_missing_special(spark, sf):
    d = lineitem(spark, sf).withColumn("x", F.when(F.col("l_linenumber") % 7 != 0, F.col("l_quantity")))
    return B.bin_stats(d, BinModel("x", [10.0, 20.0, 30.0, 40.0], special=[1.0]), "y").drop("bin_label")


@query(f"""
WITH c AS (SELECT {bin_of('l_quantity', [10, 20, 30, 40])} AS bin, count(*) AS n, sum(l_extendedprice) AS s, avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS sd, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1),
w AS (SELECT *, sum(n) OVER () AS tn, sum(s) OVER () AS ts FROM c)
SELECT bin, n, {r('s', 'y_sum')}, {r('m', 'y_mean')}, {r('sd', 'y_std')}, {r('lo', 'y_min')}, {r('hi', 'y_max')}, {r('n / tn', 'n_share')}, {r('s / ts', 'y_share')},
  {r('m / (ts / tn)', 'mean_lift')}, {r('(s / ts - n / tn) / (n / tn + 1e-10)', 'contribution')} FROM w""")
def bin_stats_continuous(spark, sf):
    d = t(spark, sf, "lineitem")
    return B.bin_stats_continuous(d, BinModel("l_quantity", [10.0, 20.0, 30.0, 40.0]), "l_extendedprice").withColumn("y_sum", F.col("y_sum"))


@query(bin_table(f"SELECT {bin_of('l_quantity', [10, 20, 30, 40])} AS bin, sum(l_discount) AS n, sum(CASE WHEN l_returnflag = 'R' THEN l_discount ELSE 0 END) AS bad FROM lineitem GROUP BY 1", amount=True))
def bin_stats_amount(spark, sf):
    return B.bin_stats(lineitem(spark, sf), BinModel("l_quantity", [10.0, 20.0, 30.0, 40.0]), "y", amount="l_discount").drop("bin_label")


@query(f"""
WITH b AS ({bin_table(counted(bin_of('l_extendedprice', [10000, 30000, 60000]), 'lineitem', Y))})
SELECT bin, n, bad, good, bad_rate, woe, iv_bin, iv_total, lift, ks FROM b UNION ALL
SELECT NULL, CAST(sum(n) AS BIGINT), CAST(sum(bad) AS BIGINT), CAST(sum(good) AS BIGINT), {r('sum(bad) / sum(n)', 'bad_rate')}, 0.0, 0.0, max(iv_total), 1.0, max(ks) FROM b""")
def bin_stats_margins(spark, sf):
    d = lineitem(spark, sf)
    table = B.bin_stats(d, BinModel("l_extendedprice", [10000.0, 30000.0, 60000.0]), "y")
    return B.with_margins(table).select("bin", "n", "bad", "good", "bad_rate", "woe", "iv_bin", "iv_total", "lift", "ks")


@query(bin_table(" UNION ALL ".join(f"SELECT 'od_{d}+' AS label, {bin_of('l_quantity', [10, 20, 30, 40])} AS bin, count(*) AS n, sum(CASE WHEN {OD_SQL} > {d} THEN 1 ELSE 0 END) AS bad FROM lineitem GROUP BY 2" for d in (7, 30, 60)), by=["label"]))
def bin_stats_multi_label(spark, sf):
    d = t(spark, sf, "lineitem").select("l_quantity", od().alias("od"))
    long = L.with_labels(d, ["od"], [7, 30, 60], keep=["l_quantity"])
    return B.bin_stats(long, BinModel("l_quantity", [10.0, 20.0, 30.0, 40.0]), "y", by=["label"]).drop("bin_label")


@query(bin_table(" UNION ALL ".join(f"SELECT 'od_{d}+' AS label, {bin_of('l_quantity', [25])} AS bin, count(*) AS n, sum(CASE WHEN {OD_SQL} > {d} THEN 1 ELSE 0 END) AS bad FROM lineitem WHERE {OD_SQL} > {d} OR {OD_SQL} <= 0 GROUP BY 2" for d in (7, 30)), by=["label"]))
def bin_stats_without_grey(spark, sf):
    d = t(spark, sf, "lineitem").select("l_quantity", od().alias("od"))
    long = L.with_labels(d, ["od"], [7, 30], drop_grey=True, keep=["l_quantity"])
    return B.bin_stats(long, BinModel("l_quantity", [25.0]), "y", by=["label"]).drop("bin_label")


@query(bin_table("SELECT CAST(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 0 WHEN o_orderpriority = '3-MEDIUM' THEN 1 ELSE 2 END AS INTEGER) AS bin, count(*) AS n, sum(" + YO + ") AS bad FROM orders GROUP BY 1"))
def bin_stats_categorical(spark, sf):
    m = BinModel("o_orderpriority", groups=[["1-URGENT", "2-HIGH"], ["3-MEDIUM"]], unknown=2)
    return B.bin_stats(orders(spark, sf), m, "y").drop("bin_label")


@query(bin_table(" UNION ALL ".join(f"SELECT '{f}' AS feature, 'od_{d}+' AS label, {bin_of(f, sp)} AS bin, count(*) AS n, sum(CASE WHEN {OD_SQL} > {d} THEN 1 ELSE 0 END) AS bad FROM lineitem GROUP BY 3" for f, sp in (("l_quantity", [10, 20, 30, 40]), ("l_discount", [0.03, 0.07])) for d in (7, 60)), by=["feature", "label"]))
def feature_bin_stats(spark, sf):
    d = t(spark, sf, "lineitem").withColumn("od", od())
    m = {"l_quantity": BinModel("l_quantity", [10.0, 20.0, 30.0, 40.0]), "l_discount": BinModel("l_discount", [0.03, 0.07])}
    return B.feature_bin_stats(d, list(m), overdue=["od"], dpds=[7, 60], models=m).drop("bin_label")


@query("SELECT l_orderkey, l_linenumber, " + bin_of("l_extendedprice", [10000, 30000, 60000]) + " AS l_extendedprice_bin FROM lineitem")
def bin_transform(spark, sf):
    m = {"l_extendedprice": BinModel("l_extendedprice", [10000.0, 30000.0, 60000.0])}
    return binning.transform(t(spark, sf, "lineitem"), m).select("l_orderkey", "l_linenumber", "l_extendedprice_bin")


#: Edges over the least value, as the searches use them.
METHOD_SQL = {
    "uniform": bin_table(counted("CAST(least(4, greatest(0, CASE WHEN l_extendedprice >= lo + w * 4 / 5 THEN 4 WHEN l_extendedprice >= lo + w * 3 / 5 THEN 3 WHEN l_extendedprice >= lo + w * 2 / 5 THEN 2 WHEN l_extendedprice >= lo + w / 5 THEN 1 ELSE 0 END)) AS INTEGER)", "lineitem, b", Y), ctes="b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) - min(l_extendedprice) AS w FROM lineitem)"),
    "quantile": bin_table(counted(bin_of("l_extendedprice", edges="e"), "lineitem, edges", Y), ctes=EDGES_SQL),
}


def _method_query(method: str):
    def run(spark, sf):
        d = lineitem(spark, sf)
        m = binning.fit_binning(d, "l_extendedprice", "y", method=method, max_n_bins=5)
        return B.bin_stats(d, m, "y").drop("bin_label")

    run.__name__ = f"binning_{method}"
    query(METHOD_SQL.get(method))(run)


for _m in binning.ALL_METHODS:
    _method_query(_m)


@query()
def binning_auto_select(spark, sf):
    _, rows = binning.auto_select(lineitem(spark, sf), "l_extendedprice", "y")
    return spark.createDataFrame(rows, "method string, n_bins int, iv double, ks double, monotone boolean")


# --- encoders ---

@query(f"""
WITH g AS (SELECT o_orderpriority AS v, count(*) AS n, sum({YO}) AS b FROM orders GROUP BY 1), w AS (SELECT *, sum(b) OVER () AS tb, sum(n - b) OVER () AS tg FROM g)
SELECT o_orderkey, {r('greatest(least(ln(((b + 1) / (tb + 2)) / ((n - b + 1) / (tg + 2))), 5), -5)', 'woe')} FROM orders JOIN w ON v = o_orderpriority""")
def woe_encode(spark, sf):
    d = orders(spark, sf)
    return encoders.woe(d, "o_orderpriority", "y")[0].apply(d, "woe").select("o_orderkey", "woe")


@query(f"""
WITH a AS (SELECT avg({YO}) AS m FROM orders), g AS (SELECT o_custkey AS v, count(*) AS n, sum({YO}) AS s FROM orders GROUP BY 1)
SELECT o_orderkey, {r('CASE WHEN n < 3 THEN m ELSE (s + 10 * m) / (n + 10) END', 'code')} FROM orders JOIN g ON v = o_custkey, a""")
def target_encode(spark, sf):
    d = orders(spark, sf)
    return encoders.target(d, "o_custkey", "y", smoothing=10.0, min_samples_leaf=3).apply(d, "code").select("o_orderkey", "code")


@query(f"""
WITH g AS (SELECT o_custkey AS v, count(*) AS n FROM orders GROUP BY 1), h AS (SELECT v, CASE WHEN n < 5 THEN (SELECT sum(n) FROM g WHERE n < 5) ELSE n END AS c FROM g)
SELECT o_orderkey, {r('c', 'code')} FROM orders JOIN h ON v = o_custkey""")
def count_encode(spark, sf):
    d = orders(spark, sf)
    return encoders.count(d, "o_custkey", min_group_size=5).apply(d, "code").select("o_orderkey", "code")


@query("SELECT o_orderkey, " + ", ".join(f"CAST(CASE WHEN o_orderstatus = '{s}' THEN 1 ELSE 0 END AS INTEGER) AS o_orderstatus_{s}" for s in "FOP") + " FROM orders")
def onehot_encode(spark, sf):
    return encoders.one_hot(orders(spark, sf), "o_orderstatus").select("o_orderkey", *[f"o_orderstatus_{s}" for s in "FOP"])


@query(f"WITH v AS (SELECT DISTINCT o_orderpriority AS p FROM orders), k AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS i FROM v) SELECT o_orderkey, {r('i', 'code')} FROM orders JOIN k ON p = o_orderpriority")
def ordinal_encode(spark, sf):
    d = orders(spark, sf)
    return encoders.ordinal(d, "o_orderpriority").apply(d, "code").select("o_orderkey", "code")


@query(f"""
WITH a AS (SELECT quantile_cont(o_totalprice, 0.5) AS q FROM orders), g AS (SELECT o_orderpriority AS v, quantile_cont(o_totalprice, 0.5) AS p, count(*) AS n FROM orders GROUP BY 1)
SELECT o_orderkey, {r('(n * p + 5 * q) / (n + 5)', 'code')} FROM orders JOIN g ON v = o_orderpriority, a""")
def quantile_encode(spark, sf):
    d = orders(spark, sf)
    return encoders.quantile(d, "o_orderpriority", "o_totalprice", 0.5, 5.0).apply(d, "code").select("o_orderkey", "code")


@query("""
WITH g AS (SELECT o_orderpriority AS v, count(*) AS n FROM orders GROUP BY 1), k AS (SELECT v FROM g ORDER BY n DESC, v LIMIT 2)
SELECT o_orderkey, CASE WHEN v IS NULL THEN 'other' ELSE v END AS code FROM orders LEFT JOIN k ON v = o_orderpriority""")
def cardinality_encode(spark, sf):
    d = orders(spark, sf)
    return encoders.limit_cardinality(d, "o_orderpriority", encoders.top_categories(d, "o_orderpriority", 3), "code").select("o_orderkey", "code")


@query(f"""
WITH d AS (SELECT o_orderkey, o_orderpriority AS v, {YO} AS y FROM orders), a AS (SELECT avg(y) AS m FROM d)
SELECT o_orderkey, {r('(coalesce(sum(y) OVER w, 0) + m) / (count(y) OVER w + 1)', 'code')} FROM d, a WINDOW w AS (PARTITION BY v ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def ordered_target_encode(spark, sf):
    return encoders.ordered_target(orders(spark, sf), "o_orderpriority", "y", F.col("o_orderkey"), "code").select("o_orderkey", "code")


@query()
def tree_leaf_encode(spark, sf):
    d = lineitem(spark, sf)
    return encoders.tree_leaves(d, ["l_quantity", "l_extendedprice"], "y", n_trees=3, max_depth=2)[1](d).select("l_orderkey", "l_linenumber", F.array_join(F.col("leaves").cast("array<string>"), ",").alias("leaves"))


# --- selection statistics ---

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _each(sql: Callable[[str], str], features: list[str] = FEATURES) -> str:
    return " UNION ALL ".join(sql(f) for f in features)


@query("WITH b AS (" + bin_table(_each(lambda f: f"SELECT '{f}' AS feature, {bin_of(f, edges='e')} AS bin, count(*) AS n, sum({Y}) AS bad FROM lineitem, e_{f} GROUP BY 1, 2"), ["feature"], ctes=", ".join(f"e_{f} AS (SELECT list_filter(q, lambda v: v > lo) AS e FROM (SELECT list_distinct(quantile_cont({f}, [0.2, 0.4, 0.6, 0.8])) AS q, min({f}) AS lo FROM lineitem))" for f in FEATURES)) + f") SELECT feature, {r('max(iv_total)', 'iv')}, {r('max(ks)', 'ks')}, count(*) AS n_bins FROM b GROUP BY 1")
def iv_batch(spark, sf):
    d = lineitem(spark, sf)
    return B.batch_iv(d, stability.pooled_models(d, FEATURES, 5), "y")


@query(_each(lambda f: f"""SELECT '{f}' AS feature, {r('sum(CASE WHEN n > 1 THEN (pb - pg) * ln(pb / pg) ELSE 0 END)', 'iv')} FROM (
  SELECT n, (b + 1) / (sum(b) OVER () + 1) AS pb, (n - b + 1) / (sum(n - b) OVER () + 1) AS pg FROM (SELECT {f} AS v, count(*) AS n, sum({Y}) AS b FROM lineitem GROUP BY 1))""", ["l_quantity", "l_discount", "l_tax"]))
def iv_raw_values(spark, sf):
    return selectors.raw_iv(lineitem(spark, sf), ["l_quantity", "l_discount", "l_tax"], "y")


@query(f"""
WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS o FROM lineitem GROUP BY 1, 2),
w AS (SELECT *, sum(o) OVER (PARTITION BY a) AS ra, sum(o) OVER (PARTITION BY b) AS cb, sum(o) OVER () AS n FROM c),
s AS (SELECT sum(o * o / (ra * cb)) * max(n) - max(n) AS chi2, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS df, CAST(max(n) AS BIGINT) AS n, least(count(DISTINCT a), count(DISTINCT b)) - 1 AS k FROM w)
SELECT {r('chi2', 'chi2')}, df, n, {r('CASE WHEN k > 0 THEN sqrt(greatest(chi2, 0) / (n * k)) END', 'cramers_v')} FROM s""")
def chi2_cramers_v(spark, sf):
    return metrics.contingency_chi2(t(spark, sf, "lineitem"), F.col("l_returnflag"), F.col("l_linestatus"))


@query(_each(lambda f: f"""SELECT '{f}' AS feature, {r('((sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (count(*) - 1)) / ((sum(q) - sum(s * s / n)) / (sum(n) - count(*)))', 'f')}
  FROM (SELECT {Y} AS y, count(*) AS n, sum({f}) AS s, sum({f} * {f}) AS q FROM lineitem GROUP BY 1)"""))
def f_test(spark, sf):
    return metrics.f_test(lineitem(spark, sf), FEATURES, "y")


@query(_each(lambda f: f"""SELECT '{f}' AS feature, {r('sum((o - e) * (o - e) / e)', 'chi2')} FROM (
  SELECT o, sum(o) OVER () * n / sum(n) OVER () AS e FROM (SELECT {Y} AS y, count(*) AS n, sum({f}) AS o FROM lineitem GROUP BY 1))"""))
def chi2_class_sums(spark, sf):
    return metrics.class_sum_chi2(lineitem(spark, sf), FEATURES, "y")


@query(f"""
WITH e AS (SELECT list_distinct(quantile_cont(l_extendedprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM lineitem),
c AS (SELECT {bin_of('l_extendedprice', edges='e')} AS bin, {Y} AS y, count(*) AS o FROM lineitem, e GROUP BY 1, 2),
w AS (SELECT o, sum(o) OVER () AS n, sum(o) OVER (PARTITION BY bin) AS a, sum(o) OVER (PARTITION BY y) AS b FROM c)
SELECT 'l_extendedprice' AS feature, {r('sum(o / n * ln(o * n / (a * b)))', 'mi')} FROM w""")
def mutual_information(spark, sf):
    return selectors.mutual_information(lineitem(spark, sf), ["l_extendedprice"], "y")


PAIRS = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]]


@query(" UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {r(f'corr({a}, {b})', 'correlation')} FROM lineitem" for a, b in PAIRS))
def correlation_pairs(spark, sf):
    return eda.correlation_pairs(t(spark, sf, "lineitem"), FEATURES, threshold=0.0).drop("rating")


@query(f"WITH q AS (SELECT p_size, p_retailprice, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2 AS b FROM part) SELECT 'p_size' AS feature_a, 'p_retailprice' AS feature_b, {r('corr(a, b)', 'correlation')} FROM q")
def correlation_spearman(spark, sf):
    return eda.correlation_pairs(t(spark, sf, "part"), ["p_size", "p_retailprice"], threshold=0.0, method="spearman").drop("rating")


@query(f"WITH s AS (SELECT l_extendedprice AS x, count(*) FILTER (WHERE l_linenumber <= 3) AS a, count(*) FILTER (WHERE l_linenumber > 3) AS b FROM lineitem GROUP BY 1), c AS (SELECT x, lead(x) OVER (ORDER BY x) - x AS w, abs(sum(a) OVER o / sum(a) OVER () - sum(b) OVER o / sum(b) OVER ()) AS g FROM s WINDOW o AS (ORDER BY x ROWS UNBOUNDED PRECEDING)) SELECT {r('max(g)', 'ks')}, {r('sum(g * coalesce(w, 0))', 'wasserstein')} FROM c")
def drift_distance(spark, sf):
    return scorecard.drift_distance(t(spark, sf, "lineitem"), "l_extendedprice", F.col("l_linenumber") <= 3)


@query(" UNION ALL ".join(f"SELECT '{f}' AS feature, {r('1 / (1 - pow(corr(l_quantity, l_extendedprice), 2))', 'vif')} FROM lineitem" for f in ("l_quantity", "l_extendedprice")))
def vif_pair(spark, sf):
    return eda.vif_table(t(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"]).drop("rating")


@query(_each(lambda f: f"SELECT '{f}' AS feature, {r(f'avg(CASE WHEN {f} IS NULL THEN 1 ELSE 0 END)', 'missing')}, count(DISTINCT {f}) AS distinct_values, {r(f'var_pop({f})', 'variance')}, {r(f'(SELECT max(n) / sum(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY {f}))', 'mode_share')} FROM lineitem"))
def screening_statistics(spark, sf):
    d = t(spark, sf, "lineitem")
    found = [selectors.by_missing(d, FEATURES).scores, selectors.by_cardinality(d, FEATURES).scores, selectors.by_variance(d, FEATURES, threshold=1e-9).scores, selectors.by_mode(d, FEATURES).scores]
    return spark.createDataFrame([(f, found[0][f], int(found[1][f]), found[2][f], found[3][f]) for f in FEATURES], "feature string, missing double, distinct_values long, variance double, mode_share double")


@query()
def staged_selection(spark, sf):
    return selectors.report(spark, selectors.staged(lineitem(spark, sf), FEATURES, "y", iv_threshold=0.0)[1])


@query()
def psi_selection(spark, sf):
    return selectors.report(spark, [selectors.by_psi(lineitem(spark, sf), FEATURES[:2], "l_orderkey", n_splits=3)])


@query()
def vif_selection(spark, sf):
    return selectors.report(spark, [selectors.by_vif(lineitem(spark, sf), FEATURES)])


# --- metrics ---

CURVE = f"""
s AS (SELECT CAST(n_chars AS DOUBLE) AS score, count(*) AS n, sum(y) AS b FROM {SCORED_SQL} GROUP BY 1),
c AS (SELECT *, sum(b) OVER o AS cb, sum(n - b) OVER o AS cg, sum(b) OVER () AS tb, sum(n - b) OVER () AS tg FROM s WINDOW o AS (ORDER BY score ROWS UNBOUNDED PRECEDING)),
d AS (SELECT *, sum(b) OVER o AS db, sum(n - b) OVER o AS dg FROM c WINDOW o AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""


@query(f"WITH {CURVE} SELECT {r('max(abs(cb / tb - cg / tg))', 'ks')}, {r('sum(b * (cg - (n - b) / 2)) / max(tb * tg)', 'auc')}, {r('2 * sum(b * (cg - (n - b) / 2)) / max(tb * tg) - 1', 'gini')}, CAST(max(tb + tg) AS BIGINT) AS n, CAST(max(tb) AS BIGINT) AS bad FROM d")
def ks_auc_gini(spark, sf):
    return metrics.ks_auc(scored(spark, sf), "y", "n_chars")


@query(f"WITH {CURVE} SELECT {r('score', 'threshold')}, {r('db / tb', 'tpr')}, {r('dg / tg', 'fpr')} FROM d")
def roc_points(spark, sf):
    return metrics.roc_points(scored(spark, sf), "y", "n_chars")


@query(f"WITH {CURVE}, k AS (SELECT max(db + dg) OVER () AS tn, * FROM d), q AS (SELECT unnest([0.05, 0.1, 0.25]) AS ratio), x AS (SELECT ratio, greatest(1, floor(tn * ratio)) AS take, * FROM k, q)" + f"SELECT {r('ratio', 'ratio')}, CAST(take AS BIGINT) AS n, {r('((db - b) + b * (take - (db + dg - n)) / n) / take / (tb / tn)', 'lift')}, {r('((db - b) + b * (take - (db + dg - n)) / n) / tb', 'capture')} FROM x WHERE db + dg - n < take AND db + dg >= take")
def lift_at_ratios(spark, sf):
    return metrics.lift_at(scored(spark, sf), "y", "n_chars", [0.05, 0.1, 0.25])


@query(f"""
WITH d AS (SELECT y, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS i, count(*) OVER () AS n FROM {SCORED_SQL}),
b AS (SELECT CAST(least((i - 1) // (n // 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(y) AS rate, sum(y) AS s FROM d GROUP BY 1),
w AS (SELECT *, rate / (sum(s) OVER () / sum(n) OVER ()) AS lift FROM b)
SELECT bin, n, {r('rate', 'bad_rate')}, {r('lift', 'lift')}, coalesce(lift <= lag(lift) OVER (ORDER BY bin) + 1e-8, true) AS falls FROM w""")
def lift_monotonicity(spark, sf):
    return metrics.lift_monotonicity(scored(spark, sf), "y", "n_chars", "doc_id")


PRED = "CASE WHEN n_chars >= 1500 THEN 1 ELSE 0 END"


def predicted(spark, sf) -> DataFrame:
    return scored(spark, sf).withColumn("p", (F.col("n_chars") >= 1500).cast("int"))


@query(f"SELECT y AS actual, count(*) FILTER (WHERE {PRED} = 0) AS predicted_0, count(*) FILTER (WHERE {PRED} = 1) AS predicted_1 FROM {SCORED_SQL} GROUP BY 1")
def confusion_matrix(spark, sf):
    return metrics.confusion(predicted(spark, sf), "y", "p")


@query(f"WITH c AS (SELECT count(*) AS n, sum(CASE WHEN y = 1 AND p = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN y = 0 AND p = 1 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN y = 1 AND p = 0 THEN 1 ELSE 0 END) AS fn FROM (SELECT y, {PRED} AS p FROM {SCORED_SQL})) SELECT {r('(n - fp - fn) / n', 'accuracy')}, {r('tp / (tp + fp)', 'precision')}, {r('tp / (tp + fn)', 'recall')}, {r('2 * tp / (2 * tp + fp + fn)', 'f1')} FROM c")
def classification_metrics(spark, sf):
    return metrics.classification_metrics(predicted(spark, sf), "y", "p")


@query(f"WITH d AS (SELECT y, {PRED} AS p FROM {SCORED_SQL}), k AS (SELECT unnest([0, 1]) AS class), c AS (SELECT class, sum(CASE WHEN y = class AND p = class THEN 1 ELSE 0 END) AS t, sum(CASE WHEN p = class THEN 1 ELSE 0 END) AS q, sum(CASE WHEN y = class THEN 1 ELSE 0 END) AS a FROM d, k GROUP BY 1) SELECT CAST(class AS INTEGER) AS class, {r('CASE WHEN q > 0 THEN t / q ELSE 0 END', 'precision')}, {r('CASE WHEN a > 0 THEN t / a ELSE 0 END', 'recall')}, {r('CASE WHEN a + q > 0 THEN 2 * t / (a + q) ELSE 0 END', 'f1')}, CAST(a AS BIGINT) AS support FROM c")
def classification_report(spark, sf):
    return metrics.classification_report(predicted(spark, sf), "y", "p")


@query(f"SELECT {r('avg(CASE WHEN n_chars >= 2000 THEN y END) / avg(y)', 'lift')} FROM {SCORED_SQL}")
def lift_threshold(spark, sf):
    return metrics.lift(scored(spark, sf), "y", "n_chars", 2000)


PRICE = "(l_quantity * 1000)"


@query(f"WITH d AS (SELECT l_extendedprice AS y, {PRICE} AS p FROM lineitem) SELECT {r('avg(pow(y - p, 2))', 'mse')}, {r('avg(abs(y - p))', 'mae')}, {r('sqrt(avg(pow(y - p, 2)))', 'rmse')}, {r('1 - avg(pow(y - p, 2)) / var_pop(y)', 'r2')} FROM d")
def regression_metrics(spark, sf):
    return metrics.regression_metrics(t(spark, sf, "lineitem").withColumn("p", F.col("l_quantity") * 1000), "l_extendedprice", "p")


# --- bad rates ---

@query(" UNION ALL ".join(f"SELECT 'od_{d}+' AS label, count(*) AS n, CAST(sum(CASE WHEN {OD_SQL} > {d} THEN 1 ELSE 0 END) AS BIGINT) AS bad, {r(f'avg(CASE WHEN {OD_SQL} > {d} THEN 1 ELSE 0 END)', 'bad_rate')} FROM lineitem" for d in (7, 30, 60)))
def badrate_overall_labels(spark, sf):
    long = L.with_labels(t(spark, sf, "lineitem").select(od().alias("od")), ["od"], [7, 30, 60], keep=[])
    return long.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.col("y").cast("long")).alias("bad"), F.avg("y").alias("bad_rate"))


@query(f"WITH g AS (SELECT o_orderpriority, count(*) AS n, sum({YO}) AS bad, sum(o_totalprice * {YO}) AS b, sum(o_totalprice) AS w FROM orders GROUP BY 1) SELECT o_orderpriority, n, CAST(bad AS BIGINT) AS bad, {r('b / w', 'bad_rate')}, {r('b / w - sum(b) OVER () / sum(w) OVER ()', 'difference')} FROM g")
def badrate_by_group(spark, sf):
    return metrics.badrate_by_group(orders(spark, sf), "y", "o_orderpriority", "o_totalprice")


def _trend_sql(period: str) -> str:
    return f"WITH g AS (SELECT {period} AS period, count(*) AS n, sum({YO}) AS bad FROM orders GROUP BY 1) SELECT period, n, CAST(bad AS BIGINT) AS bad, {r('bad / n', 'bad_rate')}, {r('bad / n - lag(bad / n) OVER (ORDER BY period)', 'change')}, {r('sum(bad) OVER o / sum(n) OVER o', 'cum_bad_rate')} FROM g WINDOW o AS (ORDER BY period ROWS UNBOUNDED PRECEDING)"


PERIODS = {
    "M": "strftime(o_orderdate, '%Y-%m')",
    "Q": "concat(year(o_orderdate), 'Q', quarter(o_orderdate))",
    "W": "concat(CAST(date_trunc('week', o_orderdate) AS DATE), '/', CAST(date_trunc('week', o_orderdate) + INTERVAL 6 DAY AS DATE))",
}


@query(_trend_sql(PERIODS["M"]))
def badrate_trend_month(spark, sf):
    return metrics.badrate_trend(orders(spark, sf), "y", L.period("o_orderdate", "M"))


@query(_trend_sql(PERIODS["Q"]))
def badrate_trend_quarter(spark, sf):
    return metrics.badrate_trend(orders(spark, sf), "y", L.period("o_orderdate", "Q"))


@query(_trend_sql(PERIODS["W"]))
def badrate_trend_week(spark, sf):
    return metrics.badrate_trend(orders(spark, sf), "y", L.period("o_orderdate", "W"))


@query(f"""
WITH c AS (SELECT count(*) AS n, sum(y) AS bad, sum(h) AS hn, sum(h * y) AS hb, sum(a) AS ta, sum(a * y) AS ab, sum(a * h) AS ha, sum(a * h * y) AS hab FROM (SELECT {Y} AS y, CASE WHEN l_quantity >= 40 THEN 1 ELSE 0 END AS h, l_extendedprice AS a FROM lineitem))
SELECT CAST(hn AS BIGINT) AS hit_n, CAST(hb AS BIGINT) AS hit_bad, {r('hb / hn', 'hit_rate')}, {r('bad / n', 'base_rate')}, {r('(hb / hn) / (bad / n)', 'lift')}, {r('(bad / n - (bad - hb) / (n - hn)) / (bad / n)', 'bad_improve')}, {r('(hab / ha) / (ab / ta)', 'amount_lift')} FROM c""")
def rule_lift(spark, sf):
    return metrics.rule_lift(lineitem(spark, sf), "y", F.col("l_quantity") >= 40, "l_extendedprice")


# --- stability ---

YEAR98 = "o_orderdate >= TIMESTAMP '1998-01-01'"


def is_late():
    return F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")


PSI_EDGES = "e AS (SELECT list_distinct(quantile_cont(o_totalprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM orders)"


@query(f"""
WITH {PSI_EDGES}, c AS (SELECT {bin_of('o_totalprice', edges='e')} AS bin, count(*) FILTER (WHERE NOT {YEAR98}) AS en, count(*) FILTER (WHERE {YEAR98}) AS an FROM orders, e GROUP BY 1),
s AS (SELECT *, en / sum(en) OVER () AS es, an / sum(an) OVER () AS asr FROM c), p AS (SELECT *, {psi('es', 'asr')} AS pb FROM s)
SELECT bin, en AS expected_n, an AS actual_n, {r('es', 'expected_share')}, {r('asr', 'actual_share')}, {r('pb', 'psi_bin')}, {r('sum(pb) OVER ()', 'psi')} FROM p""")
def psi_table(spark, sf):
    d = t(spark, sf, "orders")
    return stability.psi_table(d, stability.pooled_model(d, "o_totalprice"), is_late())


@query(_each(lambda f: f"""SELECT '{f}' AS feature, {r('sum(' + psi('es', 'asr') + ')', 'psi')} FROM (SELECT en / sum(en) OVER () AS es, an / sum(an) OVER () AS asr FROM (
  SELECT {bin_of(f, edges='e')} AS bin, count(*) FILTER (WHERE l_linenumber <= 3) AS en, count(*) FILTER (WHERE l_linenumber > 3) AS an FROM lineitem, (SELECT list_distinct(quantile_cont({f}, [0.2, 0.4, 0.6, 0.8])) AS e FROM lineitem) GROUP BY 1))""", ["l_quantity", "l_extendedprice"]))
def psi_batch(spark, sf):
    d = t(spark, sf, "lineitem")
    return stability.batch_psi(d, stability.pooled_models(d, ("l_quantity", "l_extendedprice"), 5), F.col("l_linenumber") > 3)


@query(f"""
WITH {PSI_EDGES}, c AS (SELECT year(o_orderdate)::VARCHAR AS period, {bin_of('o_totalprice', edges='e')} AS bin, count(*) AS n FROM orders, e GROUP BY 1, 2),
s AS (SELECT *, n / sum(n) OVER (PARTITION BY period) AS a FROM c), k AS (SELECT DISTINCT period FROM c), b AS (SELECT DISTINCT bin FROM c),
g AS (SELECT k.period, coalesce(x.a, 0) AS a, coalesce(f.a, 0) AS e, coalesce(x.n, 0) AS n FROM k CROSS JOIN b LEFT JOIN s x ON x.period = k.period AND x.bin = b.bin LEFT JOIN s f ON f.period = (SELECT min(period) FROM k) AND f.bin = b.bin)
SELECT 'o_totalprice' AS feature, period, CAST(sum(n) AS BIGINT) AS n, {r('sum(' + psi('e', 'a') + ')', 'psi')} FROM g GROUP BY 2""")
def psi_by_year(spark, sf):
    d = t(spark, sf, "orders")
    return stability.psi_by_period(d, {"o_totalprice": stability.pooled_model(d, "o_totalprice")}, L.period("o_orderdate", "Y"))


@query(f"""
WITH {PSI_EDGES}, c AS (SELECT o_orderpriority AS s, year(o_orderdate)::VARCHAR AS period, {bin_of('o_totalprice', edges='e')} AS bin, count(*) AS n FROM orders, e GROUP BY 1, 2, 3),
s AS (SELECT *, n / sum(n) OVER (PARTITION BY s, period) AS a FROM c), k AS (SELECT DISTINCT s, period FROM c), b AS (SELECT DISTINCT bin FROM c),
g AS (SELECT k.s, k.period, coalesce(x.a, 0) AS a, coalesce(f.a, 0) AS e, coalesce(x.n, 0) AS n FROM k CROSS JOIN b LEFT JOIN s x ON x.s = k.s AND x.period = k.period AND x.bin = b.bin LEFT JOIN s f ON f.s = k.s AND f.period = '1995' AND f.bin = b.bin)
SELECT s AS o_orderpriority, 'o_totalprice' AS feature, period, CAST(sum(n) AS BIGINT) AS n, {r('sum(' + psi('e', 'a') + ')', 'psi')} FROM g GROUP BY 1, 3""")
def psi_by_segment_and_year(spark, sf):
    d = t(spark, sf, "orders")
    return stability.psi_by_period(d, {"o_totalprice": stability.pooled_model(d, "o_totalprice")}, L.period("o_orderdate", "Y"), base="1995", by=["o_orderpriority"])


@query(f"""
WITH {PSI_EDGES}, c AS (SELECT o_orderpriority AS g, {bin_of('o_totalprice', edges='e')} AS bin, count(*) AS n FROM orders, e GROUP BY 1, 2), s AS (SELECT *, n / sum(n) OVER (PARTITION BY g) AS x FROM c)
SELECT a.g AS group_a, b.g AS group_b, {r('sum(' + psi('a.x', 'b.x') + ')', 'psi')} FROM s a JOIN s b ON a.bin = b.bin AND a.g < b.g GROUP BY 1, 2""")
def psi_matrix(spark, sf):
    d = t(spark, sf, "orders")
    return stability.psi_matrix(d, stability.pooled_model(d, "o_totalprice"), "o_orderpriority")


@query(f"""
WITH {PSI_EDGES}, p AS (SELECT sum({psi('es', 'asr')}) AS psi FROM (SELECT en / sum(en) OVER () AS es, an / sum(an) OVER () AS asr FROM (SELECT {bin_of('o_totalprice', edges='e')} AS bin, count(*) FILTER (WHERE NOT {YEAR98}) AS en, count(*) FILTER (WHERE {YEAR98}) AS an FROM orders, e GROUP BY 1))),
m AS (SELECT avg(CASE WHEN NOT {YEAR98} THEN o_totalprice END) AS m0, avg(CASE WHEN {YEAR98} THEN o_totalprice END) AS m1, avg(CASE WHEN NOT {YEAR98} THEN {YO} END) AS b0, avg(CASE WHEN {YEAR98} THEN {YO} END) AS b1 FROM orders)
SELECT 'o_totalprice' AS feature, {r('m0', 'mean_base')}, {r('m1', 'mean_actual')}, 0.0 AS missing_base, 0.0 AS missing_actual, {r('b0', 'bad_rate_base')}, {r('b1', 'bad_rate_actual')}, {r('m1 - m0', 'mean_change')}, 0.0 AS missing_change, {r('psi', 'psi')} FROM m, p""")
def feature_drift(spark, sf):
    d = orders(spark, sf)
    return stability.feature_drift(d, {"o_totalprice": stability.pooled_model(d, "o_totalprice")}, is_late(), "y")


@query(f"WITH c AS (SELECT o_orderpriority AS s, count(*) FILTER (WHERE NOT {YEAR98}) AS e, count(*) FILTER (WHERE {YEAR98}) AS a FROM orders GROUP BY 1), w AS (SELECT s, e / sum(e) OVER () AS e, a / sum(a) OVER () AS a FROM c) SELECT s AS segment, {r('e', 'expected_share')}, {r('a', 'actual_share')}, {r('a - e', 'change')}, {r(psi('e', 'a'), 'psi_part')} FROM w")
def segment_shares(spark, sf):
    return eda.segment_shares(t(spark, sf, "orders"), F.col("o_orderpriority"), is_late())


# --- strategy ---

JOINED = f"(SELECT c_acctbal AS score, o_totalprice, {YO} AS y, c_mktsegment, o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey)"


def applications(spark, sf) -> DataFrame:
    return orders(spark, sf).join(t(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")).withColumn("score", F.col("c_acctbal"))


@query(f"WITH d AS (SELECT * FROM {JOINED}), k AS (SELECT unnest([0.0, 2500.0, 5000.0, 7500.0]) AS threshold), g AS (SELECT threshold, count(*) FILTER (WHERE score >= threshold) AS an, sum(CASE WHEN score >= threshold THEN y ELSE 0 END) AS ab, count(*) AS n, sum(y) AS b, sum(CASE WHEN score >= threshold THEN o_totalprice ELSE 0 END) AS am FROM d, k GROUP BY 1) SELECT {r('threshold', 'threshold')}, an AS approved_n, {r('an / n', 'approval_rate')}, CAST(ab AS BIGINT) AS approved_bad, {r('ab / an', 'bad_rate')}, n - an AS rejected_n, {r('(b - ab) / (n - an)', 'rejected_bad_rate')}, {r('am', 'approved_amount')} FROM g")
def strategy_simulation(spark, sf):
    return strategy.simulate(applications(spark, sf), "score", "y", [0.0, 2500.0, 5000.0, 7500.0], "o_totalprice")


@query(f"WITH d AS (SELECT * FROM {JOINED}), q AS (SELECT quantile_cont(score, [{', '.join(f'{i}/20.0' for i in range(1, 20))}]) AS qs FROM d), k AS (SELECT DISTINCT unnest(qs) AS threshold FROM q), g AS (SELECT threshold, count(*) FILTER (WHERE score >= threshold) AS an, sum(CASE WHEN score >= threshold THEN y ELSE 0 END) AS ab, count(*) AS n, sum(y) AS b FROM d, k GROUP BY 1) SELECT {r('threshold', 'threshold')}, an AS approved_n, {r('an / n', 'approval_rate')}, CAST(ab AS BIGINT) AS approved_bad, {r('ab / an', 'bad_rate')}, n - an AS rejected_n, {r('(b - ab) / (n - an)', 'rejected_bad_rate')} FROM g")
def approval_tradeoff(spark, sf):
    return strategy.tradeoff(applications(spark, sf), "score", "y", n_points=19)


VINTAGE_SQL = f"(SELECT concat(year(o_orderdate), 'Q', quarter(o_orderdate)) AS vintage, CAST(floor(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) / 30) AS INTEGER) AS mob, {Y} AS y, l_extendedprice FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate >= o_orderdate)"


def vintages(spark, sf) -> DataFrame:
    d = lineitem(spark, sf).join(t(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).where("l_shipdate >= o_orderdate")
    return d.select(L.period("o_orderdate", "Q").alias("vintage"), F.floor(F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate")) / 30).cast("int").alias("mob"), "y", "l_extendedprice")


@query(f"WITH g AS (SELECT vintage, mob, count(*) AS n, sum(y) AS bad FROM {VINTAGE_SQL} WHERE mob <= 12 GROUP BY 1, 2), c AS (SELECT *, sum(bad) OVER (PARTITION BY vintage ORDER BY mob ROWS UNBOUNDED PRECEDING) AS cb, sum(n) OVER (PARTITION BY vintage) AS vn FROM g) SELECT vintage, mob, n, CAST(bad AS BIGINT) AS bad, CAST(cb AS BIGINT) AS cum_bad, CAST(vn AS BIGINT) AS vintage_n, {r('cb / vn', 'cum_bad_rate')} FROM c")
def vintage_curve(spark, sf):
    return strategy.vintage_curve(vintages(spark, sf), "vintage", "mob", "y")


@query("SELECT vintage, " + ", ".join(f"count(*) FILTER (WHERE mob <= {p}) AS n_{p}, {r(f'sum(y) FILTER (WHERE mob <= {p}) / count(*) FILTER (WHERE mob <= {p})', f'bad_rate_{p}')}, {r(f'sum(y * l_extendedprice) FILTER (WHERE mob <= {p}) / sum(l_extendedprice) FILTER (WHERE mob <= {p})', f'amount_rate_{p}')}" for p in (3, 6, 12)) + f" FROM {VINTAGE_SQL} GROUP BY 1")
def vintage_performance(spark, sf):
    return strategy.vintage_performance(vintages(spark, sf), "vintage", "mob", "y", [3, 6, 12], "l_extendedprice")


@query(f"WITH g AS (SELECT vintage, mob, count(*) AS n, sum(y) AS bad FROM {VINTAGE_SQL} WHERE mob <= 3 GROUP BY 1, 2), c AS (SELECT vintage, mob, sum(bad) OVER (PARTITION BY vintage ORDER BY mob ROWS UNBOUNDED PRECEDING) / sum(n) OVER (PARTITION BY vintage) AS x FROM g) SELECT vintage, " + ", ".join(f'round(CAST(max(CASE WHEN mob = {m} THEN x END) AS DOUBLE), 6) AS "{m}"' for m in range(4)) + " FROM c GROUP BY 1")
def vintage_pivot(spark, sf):
    return strategy.vintage_pivot(vintages(spark, sf), "vintage", "mob", "y", 3)


OD2_SQL = "((l_suppkey * 13 + l_linenumber * 29 + l_partkey) % 150)"


def od2():
    return F.pmod(F.col("l_suppkey") * 13 + F.col("l_linenumber") * 29 + F.col("l_partkey"), F.lit(150))


STATE = lambda x: "(" + " + ".join(f"CASE WHEN {x} >= {b} THEN 1 ELSE 0 END" for b in strategy.DPD_BOUNDS) + ")"


@query(f"WITH m AS (SELECT {STATE(OD_SQL)} AS s, {STATE(OD2_SQL)} AS e FROM lineitem) SELECT CAST(s AS INTEGER) AS state_from, " + ", ".join(r(f"count(*) FILTER (WHERE e = {j}) / count(*)", f"to_{j}") for j in range(8)) + f", {r('count(*)', 'n')}, {r('count(*) FILTER (WHERE e < s) / count(*)', 'better')}, {r('count(*) FILTER (WHERE e = s) / count(*)', 'same')}, {r('count(*) FILTER (WHERE e > s) / count(*)', 'worse')} FROM m GROUP BY 1")
def roll_rate(spark, sf):
    return strategy.roll_rate(t(spark, sf, "lineitem"), od(), od2())


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({STATE(x)} AS INTEGER) AS state, count(*) AS n, {r('count(*) / sum(count(*)) OVER ()', 'share')} FROM lineitem GROUP BY 2" for c, x in (("od1", OD_SQL), ("od2", OD2_SQL))))
def overdue_distribution(spark, sf):
    return strategy.overdue_distribution(t(spark, sf, "lineitem").select(od().alias("od1"), od2().alias("od2")), ["od1", "od2"])


# --- rules ---

RULES = [Rule("l_quantity >= 40", "large"), Rule("l_discount > 0.05 and l_tax <= 0.02", "cheap"), Rule("l_extendedprice < 5000 or l_linenumber == 7", "tail")]
RULES_SQL = {"large": "l_quantity >= 40", "cheap": "(l_discount > 0.05 AND l_tax <= 0.02)", "tail": "(l_extendedprice < 5000 OR l_linenumber = 7)"}


def _rule_sql(by: str, rows: str, y: str) -> str:
    keys = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    parts = " UNION ALL ".join(
        f"SELECT {keys}'{k}' AS rule, '{p}' AS part, CAST(sum(CASE WHEN {'' if p == 'hit' else 'NOT '}{s} THEN 1 ELSE 0 END) AS DOUBLE) AS n, CAST(sum(CASE WHEN {'' if p == 'hit' else 'NOT '}{s} THEN {y} ELSE 0 END) AS DOUBLE) AS bad, CAST(count(*) AS DOUBLE) AS tn, CAST(sum({y}) AS DOUBLE) AS tb FROM {rows}{group}"
        for k, s in RULES_SQL.items() for p in ("hit", "miss")
    )
    return f"SELECT {keys}rule, part, CAST(n AS BIGINT) AS n, CAST(n - bad AS BIGINT) AS good, CAST(bad AS BIGINT) AS bad, " + ", ".join(r(e, k) for k, e in EFFECTS.items()) + f" FROM ({parts})"


@query(_rule_sql("", "lineitem", Y))
def rule_report(spark, sf):
    return report(lineitem(spark, sf), RULES, "y")


@query(_rule_sql("", "(SELECT * FROM lineitem WHERE NOT (l_linenumber = 1))", Y))
def rule_report_after_prior(spark, sf):
    return report(lineitem(spark, sf), RULES, "y", prior=Rule("l_linenumber == 1"))


@query(_rule_sql("label", "(SELECT lineitem.*, d.label, CASE WHEN " + OD_SQL + " > d.dpd THEN 1 ELSE 0 END AS yy FROM lineitem, (SELECT 'od_7+' AS label, 7 AS dpd UNION ALL SELECT 'od_60+', 60) d)", "yy"))
def rule_report_labels(spark, sf):
    long = L.with_labels(t(spark, sf, "lineitem").withColumn("od", od()), ["od"], [7, 60])
    return report(long, RULES, "y", by=["label"])


def _waterfall_sql() -> str:
    first = "CASE " + " ".join(f"WHEN {s} THEN {i}" for i, s in enumerate(RULES_SQL.values())) + " ELSE 3 END"
    names = list(RULES_SQL)
    row = lambda pos, rule, part, hit, left: f"SELECT {pos} AS position, '{rule}' AS rule, '{part}' AS part, CAST(count(*) FILTER (WHERE {hit}) AS DOUBLE) AS n, CAST(coalesce(sum(y) FILTER (WHERE {hit}), 0) AS DOUBLE) AS bad, CAST(count(*) FILTER (WHERE {left}) AS DOUBLE) AS tn, CAST(sum(y) FILTER (WHERE {left}) AS DOUBLE) AS tb FROM d"
    rows = [row(0, "original", "total", "true", "true")]
    for i, k in enumerate(names):
        rows += [row(2 * i + 1, k, "hit", f"i = {i}", f"i >= {i}"), row(2 * i + 2, f"remaining after {k}", "miss", f"i > {i}", f"i >= {i}")]
    rows.append(row(7, "all rules", "hit", "i < 3", "true"))
    return f"WITH d AS (SELECT {first} AS i, {Y} AS y FROM lineitem) SELECT CAST(position AS INTEGER) AS position, rule, part, CAST(n AS BIGINT) AS n, CAST(bad AS BIGINT) AS bad, {r(EFFECTS['bad_rate'], 'bad_rate')}, {r(EFFECTS['lift'], 'lift')}, {r('CASE WHEN part = ' + repr('total') + ' THEN 0 ELSE ' + EFFECTS['bad_improve'] + ' END', 'bad_improve')} FROM ({' UNION ALL '.join(rows)})"


@query(_waterfall_sql())
def ruleset_waterfall(spark, sf):
    return waterfall(lineitem(spark, sf), RULES, "y")


WEIGHTS = dict(zip(RULES_SQL, (3.0, 2.0, 1.0)))


@query("SELECT l_orderkey, l_linenumber, " + r("(" + " + ".join(f"CASE WHEN {s} THEN {WEIGHTS[k]} ELSE 0 END" for k, s in RULES_SQL.items()) + ") / 6.0", "score") + ", CAST(CASE WHEN (" + " + ".join(f"CASE WHEN {s} THEN {WEIGHTS[k]} ELSE 0 END" for k, s in RULES_SQL.items()) + ") / 6.0 >= 0.5 THEN 1 ELSE 0 END AS INTEGER) AS prediction, concat_ws(',', " + ", ".join(f"CASE WHEN {s} THEN '{k}' END" for k, s in RULES_SQL.items()) + ") AS reasons FROM lineitem")
def rules_weighted_vote(spark, sf):
    c = RulesClassifier([Rule(x.expr, x.name, WEIGHTS[x.name]) for x in RULES])
    return c.predict(t(spark, sf, "lineitem")).select("l_orderkey", "l_linenumber", "score", "prediction", F.array_join("reasons", ",").alias("reasons"))


SWAP = "(SELECT *, CASE WHEN NOT o AND NOT w THEN 'in-in' WHEN NOT o THEN 'in-out' WHEN NOT w THEN 'out-in' ELSE 'out-out' END AS swap_type FROM (SELECT *, score < 1000 AS o, o_totalprice > 200000 AS w FROM " + JOINED + "))"


@query(f"""
WITH d AS (SELECT * FROM {SWAP}), e AS (SELECT list_distinct(quantile_cont(score, [0.2, 0.4, 0.6, 0.8])) AS e FROM d), b AS (SELECT *, {bin_of('score', edges='e')} AS bin FROM d, e),
k AS (SELECT bin, avg(y) AS rate FROM b GROUP BY 1), p AS (SELECT swap_type, CASE WHEN swap_type = 'out-in' THEN least(rate * 2, 1) ELSE rate END AS p FROM b JOIN k USING (bin))
SELECT swap_type, count(*) AS n, {r('count(*) / sum(count(*)) OVER ()', 'share')}, {r('sum(p)', 'expected_bad')}, {r('avg(p)', 'bad_rate')} FROM p GROUP BY 1""")
def swap_quadrants(spark, sf):
    d = strategy.swap_dataset(applications(spark, sf), Rule("score < 1000"), Rule("o_totalprice > 200000"))
    return strategy.swap_report(d, *strategy.reference_rates(d, "score", "y", 5))


@query()
def swap_summary(spark, sf):
    d = strategy.swap_dataset(applications(spark, sf), Rule("score < 1000"), Rule("o_totalprice > 200000"))
    return strategy.swap_summary(strategy.swap_report(d, *strategy.reference_rates(d, "score", "y", 5)))


@query()
def overdue_prediction(spark, sf):
    d = lineitem(spark, sf)
    p = strategy.OverduePredictor.fit(d, "l_extendedprice", "y").calibrate(d, 0.1)
    return p.transform(d).groupBy(p.model.index().alias("bin")).agg(F.count("*").alias("n"), F.avg("predicted_rate").alias("predicted_rate"), F.avg("y").alias("bad_rate"))


# --- mining ---

@query(f"WITH c AS (SELECT {bin_of('l_quantity', [20, 40])} AS bin_a, {bin_of('l_discount', [0.03, 0.07])} AS bin_b, CAST(count(*) AS DOUBLE) AS n, CAST(sum({Y}) AS DOUBLE) AS bad FROM lineitem GROUP BY 1, 2), w AS (SELECT *, sum(n) OVER () AS tn, sum(bad) OVER () AS tb FROM c) SELECT bin_a, bin_b, CAST(n AS BIGINT) AS n, CAST(bad AS BIGINT) AS bad, " + ", ".join(r(EFFECTS[k], k) for k in ("n_share", "bad_rate", "lift", "bad_improve")) + " FROM w")
def cross_cells(spark, sf):
    return mining.cross_cells(lineitem(spark, sf), BinModel("l_quantity", [20.0, 40.0]), BinModel("l_discount", [0.03, 0.07]), "y")


@query(f"WITH c AS (SELECT {bin_of('l_quantity', [20, 40])} AS bin_a, {bin_of('l_discount', [0.03, 0.07])} AS b, avg({Y}) AS x FROM lineitem GROUP BY 1, 2) SELECT bin_a, " + ", ".join(f'round(CAST(max(CASE WHEN b = {j} THEN x END) AS DOUBLE), 6) AS "{j}"' for j in (0, 1, 2, -1, -2)) + " FROM c GROUP BY 1")
def cross_matrix(spark, sf):
    return mining.cross_matrix(lineitem(spark, sf), BinModel("l_quantity", [20.0, 40.0]), BinModel("l_discount", [0.03, 0.07]), "y")


@query(f"SELECT rule, n, bad, n_share AS support, bad_rate AS precision, bad_share AS recall, {r('CASE WHEN bad_rate + bad_share > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END', 'f1')}, lift, {r('abs(rc - gs)', 'ks')} FROM (SELECT *, bad / n AS pr, bad / (SELECT sum({Y}) FROM lineitem) AS rc, good / (SELECT count(*) - sum({Y}) FROM lineitem) AS gs FROM ({_rule_sql('', 'lineitem', Y)}) WHERE part = 'hit')")
def rule_quality(spark, sf):
    return mining.rule_quality(lineitem(spark, sf), RULES, "y")


@query()
def single_feature_rules(spark, sf):
    return mining.mine_single(lineitem(spark, sf), ["l_quantity", "l_extendedprice", "l_discount"], "y", method="quantile", min_lift=1.0)


@query(f"SELECT rule, count(*) AS labels, count(*) FILTER (WHERE l >= 1.0) AS effective, {r('avg(l)', 'mean_lift')}, {r('min(l)', 'least_lift')} FROM (SELECT label, rule, (bad / n) / (tb / tn) AS l FROM (" + " UNION ALL ".join(f"SELECT {d} AS label, '{k}' AS rule, CAST(sum(CASE WHEN {s} THEN 1 ELSE 0 END) AS DOUBLE) AS n, CAST(sum(CASE WHEN {s} AND {OD_SQL} > {d} THEN 1 ELSE 0 END) AS DOUBLE) AS bad, count(*) AS tn, sum(CASE WHEN {OD_SQL} > {d} THEN 1 ELSE 0 END) AS tb FROM lineitem" for k, s in RULES_SQL.items() for d in (7, 60)) + ")) GROUP BY 1")
def rule_effectiveness(spark, sf):
    long = L.with_labels(t(spark, sf, "lineitem").withColumn("od", od()), ["od"], [7, 60])
    return mining.effectiveness(long, RULES, "label", "y", min_lift=1.0)


@query()
def tree_rules(spark, sf):
    return mining.mine_trees(lineitem(spark, sf), ["l_quantity", "l_extendedprice", "l_discount"], "y", "tree", min_lift=0.0, maxDepth=3)


# --- scorecard ---

CARD = scorecard.ScoreCard(
    {"l_quantity": BinModel("l_quantity", [10.0, 25.0, 40.0]), "l_discount": BinModel("l_discount", [0.03, 0.07])}, {"l_quantity": {0: 0.3, 1: 0.1, 2: -0.2, 3: -0.4}, "l_discount": {0: -0.25, 1: 0.05, 2: 0.35}},
    {"l_quantity": 0.8, "l_discount": 1.1}, -0.7, baseline={"l_quantity": 0.0, "l_discount": 0.0},
)
CARD_LOG = "(-0.7 + 0.8 * (CASE WHEN l_quantity < 10 THEN 0.3 WHEN l_quantity < 25 THEN 0.1 WHEN l_quantity < 40 THEN -0.2 ELSE -0.4 END) + 1.1 * (CASE WHEN l_discount < 0.03 THEN -0.25 WHEN l_discount < 0.07 THEN 0.05 ELSE 0.35 END))"


@query(f"SELECT l_orderkey, l_linenumber, {r(f'750 + 60 / ln(2) * ln(1 / 35.0) - 60 / ln(2) * {CARD_LOG}', 'score')}, {r(f'1 / (1 + exp(-{CARD_LOG}))', 'probability')} FROM lineitem")
def scorecard_score(spark, sf):
    return CARD.transform(t(spark, sf, "lineitem")).select("l_orderkey", "l_linenumber", "score", "probability")


@query(f"SELECT l_orderkey, l_linenumber, {r(f'750 + 60 / ln(2) * ln(1 / 35.0) - 60 / ln(2) * {CARD_LOG}', 'score')} FROM lineitem")
def scorecard_sql_export(spark, sf):
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.expr(CARD.to_sql()).alias("score"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{f}', {b}, round(-60 / ln(2) * {CARD.coefficients[f]} * {w}, 6))" for f, ws in CARD.woe.items() for b, w in ws.items()) + ", ('base', NULL, round(750 + 60 / ln(2) * ln(1 / 35.0) + 60 / ln(2) * 0.7, 6))) AS v(feature, bin, points)")
def scorecard_points(spark, sf):
    return CARD.table(spark).select("feature", "bin", "points")


P_SQL = "(1 / (1 + exp(-(l_quantity - 25) / 10)))"


def probabilities(spark, sf) -> DataFrame:
    return lineitem(spark, sf).withColumn("p", 1 / (1 + F.exp(-(F.col("l_quantity") - 25) / 10)))


@query(f"WITH d AS (SELECT l_orderkey, l_linenumber, {P_SQL} AS p FROM lineitem) SELECT l_orderkey, l_linenumber, {r('round_even(greatest(least(600 + 20 / ln(2) * ln(0.05) - 20 / ln(2) * ln(p / (1 - p)), 900), 300), 2)', 'standard')}, {r('round_even(100 * p, 2)', 'linear')} FROM d")
def score_transforms(spark, sf):
    p = F.col("p")
    return probabilities(spark, sf).select("l_orderkey", "l_linenumber", scorecard.StandardScore(lower=300, upper=900, decimal=2).score(p).alias("standard"), scorecard.LinearScore(decimal=2).score(p).alias("linear"))


@query(f"WITH d AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 200000 AS p FROM lineitem), e AS (SELECT list_distinct(quantile_cont(p, [{', '.join(f'{i}/10.0' for i in range(1, 10))}])) AS e FROM d) SELECT l_orderkey, l_linenumber, {r('100 * len(list_filter(e, lambda v: v <= p)) / len(e)', 'score')} FROM d, e")
def score_quantile(spark, sf):
    d = t(spark, sf, "lineitem").withColumn("p", F.col("l_extendedprice") / 200000)
    return d.select("l_orderkey", "l_linenumber", scorecard.QuantileScore(n_quantiles=10, decimal=None).fit(d, "p").score(F.col("p")).alias("score"))


@query()
def score_boxcox(spark, sf):
    d = probabilities(spark, sf)
    return d.select("l_orderkey", "l_linenumber", scorecard.BoxCoxScore().fit(d, "p").score(F.col("p")).alias("score"))


@query()
def scorecard_fit(spark, sf):
    d = lineitem(spark, sf)
    return scorecard.ScoreCard.fit(d, ["l_quantity", "l_extendedprice"], "y", method="quantile").table(spark).select("feature", "bin", "bin_label", "woe", "points")


@query(f"WITH d AS (SELECT l_extendedprice AS x, l_linenumber <= 3 AS ref FROM lineitem), a AS (SELECT avg(x) FILTER (WHERE ref) AS m0, stddev_pop(x) FILTER (WHERE ref) AS s0, avg(x) FILTER (WHERE NOT ref) AS m1, stddev_pop(x) FILTER (WHERE NOT ref) AS s1, min(x) FILTER (WHERE ref) AS lo, max(x) FILTER (WHERE ref) AS hi FROM d) SELECT l_orderkey, l_linenumber, {r('greatest(least((l_extendedprice - m1) * (s0 / s1) + m0, hi), lo)', 'aligned')} FROM lineitem, a WHERE l_linenumber > 3")
def score_drift_linear(spark, sf):
    d = t(spark, sf, "lineitem")
    return d.where("l_linenumber > 3").select("l_orderkey", "l_linenumber", scorecard.linear_alignment(d, "l_extendedprice", F.col("l_linenumber") <= 3).alias("aligned"))


@query()
def score_drift_quantile(spark, sf):
    d = t(spark, sf, "lineitem")
    return d.where("l_linenumber > 3").select("l_orderkey", "l_linenumber", scorecard.quantile_alignment(d, "l_extendedprice", F.col("l_linenumber") <= 3, 20).alias("aligned"))


# --- models and calibration ---

@query()
def logistic_regression(spark, sf):
    return models.logistic(lineitem(spark, sf), ["l_quantity", "l_discount", "l_tax"], "y").summary(spark)


@query()
def model_comparison(spark, sf):
    d, f = lineitem(spark, sf), ["l_quantity", "l_discount", "l_tax"]
    return models.compare({k: models.RiskModel.fit(d, f, "y", k, **p) for k, p in (("tree", {"maxDepth": 3}), ("forest", {"numTrees": 5, "maxDepth": 3}), ("boosting", {"maxIter": 3}))}, d)


@query(f"WITH d AS (SELECT {Y} AS y, {P_SQL} AS p FROM lineitem) SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, {r('avg(p)', 'mean_p')}, {r('avg(y)', 'bad_rate')} FROM d GROUP BY 1")
def calibration_table(spark, sf):
    return models.calibration_table(probabilities(spark, sf), "y", "p")


@query(f"WITH d AS (SELECT {Y} AS y, {P_SQL} AS p FROM lineitem), b AS (SELECT least(floor(p * 10), 9) AS k, count(*) AS n, abs(avg(p) - avg(y)) AS g FROM d GROUP BY 1) SELECT (SELECT {r('avg(pow(p - y, 2))', 'b')} FROM d) AS brier, {r('sum(g * n) / sum(n)', 'ece')}, {r('max(g)', 'mce')} FROM b")
def calibration_metrics(spark, sf):
    return models.calibration_metrics(probabilities(spark, sf), "y", "p")


@query()
def platt_calibration(spark, sf):
    d = probabilities(spark, sf)
    return d.select("l_orderkey", "l_linenumber", models.platt(d, "y", "p").alias("calibrated"))


@query()
def isotonic_calibration(spark, sf):
    d = probabilities(spark, sf)
    return models.isotonic(d, "y", "p")(d).select("l_orderkey", "l_linenumber", "calibrated")


# --- exploration ---

def _describe_sql(f: str, table: str) -> str:
    return f"SELECT '{f}' AS feature, count({f}) AS n, count(*) - count({f}) AS missing, count(DISTINCT {f}) AS \"distinct\", {r(f'avg({f})', 'mean')}, {r(f'stddev_samp({f})', 'std')}, {r(f'min({f})', 'min')}, {r(f'max({f})', 'max')}, {r(f'quantile_cont({f}, 0.25)', 'p25')}, {r(f'quantile_cont({f}, 0.5)', 'p50')}, {r(f'quantile_cont({f}, 0.75)', 'p75')} FROM {table}"


@query(_each(lambda f: _describe_sql(f, "part"), ["p_size", "p_retailprice"]))
def describe(spark, sf):
    return eda.describe(t(spark, sf, "part"), ["p_size", "p_retailprice"], [0.25, 0.5, 0.75])


@query(_each(lambda f: f"SELECT '{f}' AS feature, {r(f'skewness({f})', 'skew')}, {r(f'kurtosis({f})', 'kurt')} FROM customer", ["c_acctbal"]))
def moments(spark, sf):
    return eda.moments(t(spark, sf, "customer"), ["c_acctbal"])


def _outlier_sql(fences: str) -> str:
    return f"WITH f AS ({fences}) SELECT 'p_retailprice' AS feature, {r('lower', 'lower')}, {r('upper', 'upper')}, count(*) AS n, count(*) FILTER (WHERE p_retailprice < lower OR p_retailprice > upper) AS outliers, {r('count(*) FILTER (WHERE p_retailprice < lower OR p_retailprice > upper) / count(*)', 'rate')} FROM part, f GROUP BY lower, upper"


@query(_outlier_sql("SELECT q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM (SELECT quantile_cont(p_retailprice, 0.25) AS q1, quantile_cont(p_retailprice, 0.75) AS q3 FROM part)"))
def outliers_iqr(spark, sf):
    return eda.outliers(t(spark, sf, "part"), ["p_retailprice"], "iqr")


@query(_outlier_sql("SELECT avg(p_retailprice) - 1.5 * stddev_samp(p_retailprice) AS lower, avg(p_retailprice) + 1.5 * stddev_samp(p_retailprice) AS upper FROM part"))
def outliers_zscore(spark, sf):
    return eda.outliers(t(spark, sf, "part"), ["p_retailprice"], "zscore", 1.5)


@query(_outlier_sql("SELECT m - 1.2 / 0.6745 * quantile_cont(abs(p_retailprice - m), 0.5) AS lower, m + 1.2 / 0.6745 * quantile_cont(abs(p_retailprice - m), 0.5) AS upper FROM part, (SELECT quantile_cont(p_retailprice, 0.5) AS m FROM part) GROUP BY m"))
def outliers_mad(spark, sf):
    return eda.outliers(t(spark, sf, "part"), ["p_retailprice"], "mad", 1.2)


@query(f"WITH d AS (SELECT p_retailprice AS x, sum(p_retailprice) OVER (ORDER BY p_retailprice, p_partkey ROWS UNBOUNDED PRECEDING) AS c FROM part WHERE p_retailprice > 0) SELECT 'p_retailprice' AS feature, count(*) AS n, {r('(count(*) + 1 - 2 * sum(c) / sum(x)) / count(*)', 'gini')} FROM d")
def concentration(spark, sf):
    return eda.concentration(t(spark, sf, "part"), ["p_retailprice"])


@query(f"WITH g AS (SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1), s AS (SELECT *, n / (SELECT count(*) FROM part) AS share FROM g) SELECT value, n, {r('share', 'share')}, {r('sum(share) OVER (ORDER BY n DESC, value ROWS UNBOUNDED PRECEDING)', 'cum_share')} FROM s")
def category_summary(spark, sf):
    return eda.categories(t(spark, sf, "part"), "p_brand")


@query(_each(lambda f: f"SELECT '{f}' AS feature, {r('sum(CASE WHEN v IS NULL THEN n ELSE 0 END) / sum(n)', 'missing_rate')}, {r('max(n) / sum(n)', 'mode_share')}, count(v) AS \"distinct\", CASE WHEN sum(CASE WHEN v IS NULL THEN n ELSE 0 END) / sum(n) > 0.5 THEN 'missing' WHEN count(v) <= 1 THEN 'constant' WHEN max(n) / sum(n) >= 0.95 THEN 'near constant' ELSE 'ok' END AS flag FROM (SELECT CAST({f} AS VARCHAR) AS v, count(*) AS n FROM lineitem GROUP BY 1)", ["l_returnflag", "l_linenumber", "l_tax"]))
def data_quality(spark, sf):
    return eda.quality(t(spark, sf, "lineitem"), ["l_returnflag", "l_linenumber", "l_tax"])


@query(f"WITH g AS (SELECT p_type AS value, count(*) AS n FROM part GROUP BY 1), s AS (SELECT *, n / sum(n) OVER () AS share FROM g) SELECT 'p_type' AS feature, value, n, {r('share', 'share')} FROM s WHERE share < 0.2")
def rare_categories(spark, sf):
    return eda.rare_categories(t(spark, sf, "part"), ["p_type"], 0.2)


@query(f"WITH b AS (SELECT min(c_acctbal) AS lo, (max(c_acctbal) - min(c_acctbal)) AS w FROM customer), c AS (SELECT CAST(" + " + ".join(f"CASE WHEN c_acctbal >= lo + w * {i} / 8 THEN 1 ELSE 0 END" for i in range(1, 8)) + f" AS INTEGER) AS bin, count(*) AS n FROM customer, b GROUP BY 1) SELECT bin, n, {r('n / sum(n) OVER ()', 'share')} FROM c")
def numeric_distribution(spark, sf):
    return eda.numeric_distribution(t(spark, sf, "customer"), "c_acctbal", 8)


@query(f"WITH p AS (SELECT {PERIODS['M']} AS k, avg(o_totalprice) AS m FROM orders GROUP BY 1) SELECT 'o_totalprice' AS feature, count(*) AS periods, {r('avg(m)', 'mean')}, {r('stddev_samp(m)', 'std')}, {r('stddev_samp(m) / abs(avg(m))', 'cv')} FROM p")
def stability_over_time(spark, sf):
    return eda.stability_over_time(t(spark, sf, "orders"), ["o_totalprice"], L.period("o_orderdate", "M"))


def _profile(key: str, group: str, overall: str) -> str:
    return f"SELECT {key} AS c_mktsegment, {overall} AS overall, 'c_acctbal' AS feature, count(*) AS n, {r('avg(CASE WHEN c_acctbal IS NULL THEN 1 ELSE 0 END)', 'missing_rate')}, {r('avg(c_acctbal)', 'mean')}, {r('stddev_samp(c_acctbal)', 'std')}, {r('min(c_acctbal)', 'min')}, {r('max(c_acctbal)', 'max')}, {r('quantile_cont(c_acctbal, 0.25)', 'p25')}, {r('quantile_cont(c_acctbal, 0.5)', 'p50')}, {r('quantile_cont(c_acctbal, 0.75)', 'p75')} FROM customer {group}"


@query(_profile("c_mktsegment", "GROUP BY c_mktsegment", "false") + " UNION ALL " + _profile("NULL", "", "true"))
def group_profile(spark, sf):
    return eda.group_profile(t(spark, sf, "customer"), ["c_acctbal"], ["c_mktsegment"])


@query(f"SELECT y AS value, count(*) AS n, {r('count(*) / sum(count(*)) OVER ()', 'share')} FROM {SCORED_SQL} GROUP BY 1")
def target_distribution(spark, sf):
    return eda.target_distribution(scored(spark, sf), "y")


@query(f"SELECT {PERIODS['M']} AS period, count(*) AS n, {r(f'avg({YO})', 'bad_rate')}, {r('count(*) / sum(count(*)) OVER ()', 'share')} FROM orders GROUP BY 1")
def sample_distribution(spark, sf):
    return eda.sample_distribution(orders(spark, sf), L.period("o_orderdate", "M"), "y")


@query(_each(lambda f: f"SELECT '{f}' AS feature, count(*) AS n, count(*) FILTER (WHERE {f} IS NULL) AS missing, {r(f'count(*) FILTER (WHERE {f} IS NULL) / count(*)', 'missing_rate')} FROM documents", ["doc_id", "text", "lang"]))
def missing_table(spark, sf):
    return eda.missing_table(t(spark, sf, "documents"), ["doc_id", "text", "lang"])


@query()
def segment_effectiveness(spark, sf):
    return eda.segment_effectiveness(applications(spark, sf), ["score", "o_totalprice"], "y", "c_mktsegment")


@query()
def univariate_auc(spark, sf):
    return eda.univariate_auc(lineitem(spark, sf), FEATURES, "y")


@query()
def leakage_check(spark, sf):
    return eda.leakage(lineitem(spark, sf), FEATURES, "y")


# --- finance ---

LOAN = "(SELECT p_partkey, p_retailprice AS v, 0.01 + p_size / 1000.0 AS i, 12 + p_size AS n FROM part)"


@query(f"""SELECT p_partkey, {r('-(-v * pow(1 + i, n) + -10 * (pow(1 + i, n) - 1) / i)', 'fv')}, {r('-(0 + -10 * (pow(1 + i, n) - 1) / i) / pow(1 + i, n)', 'pv')}, {r('-(v * pow(1 + i, n)) / ((pow(1 + i, n) - 1) / i)', 'pmt')},
  {r('ln((-1000 / i) / (-1000 / i + v * 0.5)) / ln(1 + i)', 'nper')}, {r('-100 + 40 / (1 + i) + 50 / pow(1 + i, 2) + 60 / pow(1 + i, 3)', 'npv')},
  {r('pow((40 * pow(1.05, 2) + 50 * 1.05 + 60) / 100, 1 / 3.0) - 1', 'mirr')} FROM {LOAN}""")
def finance_values(spark, sf):
    d = t(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("v"), (0.01 + F.col("p_size") / 1000.0).alias("i"), (12 + F.col("p_size")).cast("double").alias("n"))
    i, n, v = F.col("i"), F.col("n"), F.col("v")
    flows = F.array(*[F.lit(x) for x in (-100.0, 40.0, 50.0, 60.0)])
    return d.select("p_partkey", finance.fv(i, n, -10, -v).alias("fv"), finance.pv(i, n, -10).alias("pv"), finance.pmt(i, n, v).alias("pmt"), finance.nper(i, -1000, v * 0.5).alias("nper"), finance.npv(i, flows).alias("npv"), finance.mirr(flows, 0.08, 0.05).alias("mirr"))


@query(f"WITH d AS (SELECT *, -(v * pow(1 + i, n)) / ((pow(1 + i, n) - 1) / i) AS p FROM {LOAN}) SELECT p_partkey, {r('-(v * pow(1 + i, 4) + p * (pow(1 + i, 4) - 1) / i) * i', 'ipmt')}, {r('p + (v * pow(1 + i, 4) + p * (pow(1 + i, 4) - 1) / i) * i', 'ppmt')} FROM d")
def finance_interest(spark, sf):
    d = t(spark, sf, "part")
    i, n, v = 0.01 + F.col("p_size") / 1000.0, (12 + F.col("p_size")).cast("double"), F.col("p_retailprice")
    return d.select("p_partkey", finance.ipmt(i, 5, n, v).alias("ipmt"), finance.ppmt(i, 5, n, v).alias("ppmt"))


@query()
def finance_rates(spark, sf):
    d = t(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("v"))
    flows = F.array(-F.col("v"), *[F.col("v") * x for x in (0.3, 0.4, 0.5)])
    return d.select("p_partkey", finance.irr(flows).alias("irr"), finance.rate(12, -F.col("v") / 10, F.col("v")).alias("rate"))


# --- losses, derivation, streaming ---

@query(f"""WITH d AS (SELECT {Y} AS y, {P_SQL} AS p FROM lineitem) SELECT {r('avg(-CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END)', 'cross_entropy')}, {r('avg(-CASE WHEN y = 1 THEN 3 * ln(p) ELSE ln(1 - p) END)', 'weighted')},
  {r('avg(-CASE WHEN y = 1 THEN 0.25 * pow(1 - p, 2) * ln(p) ELSE 0.75 * pow(p, 2) * ln(1 - p) END)', 'focal')}, {r('avg(CASE WHEN y = 1 THEN 10 * (1 - p) ELSE p END)', 'cost')},
  {r('avg(CASE WHEN y = 1 THEN -0.25 * pow(1 - p, 2) * ln(p) ELSE -0.75 * p * ln(1 - p) END)', 'asymmetric')} FROM d""")
def loss_values(spark, sf):
    d, y, p = probabilities(spark, sf), F.col("y"), F.col("p")
    return d.agg(*[F.avg(x.value(y, p)).alias(n) for n, x in (("cross_entropy", losses.CrossEntropy()), ("weighted", losses.CrossEntropy(positive=3.0)), ("focal", losses.Focal()), ("cost", losses.CostSensitive()), ("asymmetric", losses.Asymmetric()))])


@query()
def loss_ranking(spark, sf):
    d = probabilities(spark, sf)
    return losses.pairwise_ranking(d, "y", "p").select(F.col("loss").alias("pairwise")).join(losses.approval_loss(d, "y", "p", 0.3).select(F.col("loss").alias("approval")))


@query(f"SELECT l_orderkey, l_linenumber, {r('l_extendedprice * (1 - l_discount)', 'net')}, {r('CASE WHEN l_quantity > 25 THEN l_tax ELSE l_discount END', 'picked')}, {r('ln(1 + l_quantity)', 'logged')}, {r('greatest(least(l_quantity, 40), 10)', 'clipped')} FROM lineitem")
def derived_columns(spark, sf):
    d = t(spark, sf, "lineitem")
    return expressions.derive(d, {"net": "l_extendedprice * (1 - l_discount)", "picked": "where(l_quantity > 25, l_tax, l_discount)", "logged": "log1p(l_quantity)", "clipped": "clip(l_quantity, 10, 40)"}).select("l_orderkey", "l_linenumber", "net", "picked", "logged", "clipped")


@query(f"SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS bad, {r('count(*) FILTER (WHERE value > 50) / count(*)', 'bad_rate')} FROM events GROUP BY 1, 2")
def windowed_rate(spark, sf):
    d = t(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return monitor.windowed_rate(d, "ts", F.col("value") > 50, "1 day", by=["event_type"]).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "bad", "bad_rate")


BCE = "(-CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END)"
PD = f"d AS (SELECT {Y} AS y, {P_SQL} AS p, l_extendedprice AS a FROM lineitem)"


@query(f"""WITH {PD}, c AS (SELECT sum(y) AS b, count(*) - sum(y) AS g, avg(a) AS ma, quantile_cont(p, 0.95) AS q FROM d), w AS (SELECT *, (0.001 / (1 - pow(0.999, b))) / (0.001 / (1 - pow(0.999, b)) + 0.001 / (1 - pow(0.999, g))) AS al FROM c)
SELECT {r('avg(-CASE WHEN y = 1 THEN al * pow(1 - p, 2) * ln(p) ELSE (1 - al) * pow(p, 2) * ln(1 - p) END)', 'balanced_focal')}, {r('avg(CASE WHEN y = 1 AND p < 0.5 THEN 10 WHEN y = 0 AND p >= 0.5 THEN 1 ELSE 0 END)', 'cost')},
  {r(f'avg({BCE}) - (avg(p) FILTER (WHERE y = 1) - avg(p) FILTER (WHERE y = 0)) + 0.1 * (var_pop(p) FILTER (WHERE y = 1) + var_pop(p) FILTER (WHERE y = 0))', 'ks_focused')},
  {r(f'avg(CASE WHEN y = 1 THEN 5 * (1 - 1 / (1 + exp(-(p - q) / 0.05))) ELSE 1 / (1 + exp(-(p - q) / 0.05)) END + 0.1 * {BCE})', 'top_k')},
  {r(f'avg(-1 / (1 + exp(-(0.5 - p) / 0.1)) * CASE WHEN y = 1 THEN -10 ELSE 1 END + 0.1 * {BCE})', 'profit')},
  {r(f'sum(greatest(a / ma, 0.1) * {BCE}) / sum(greatest(a / ma, 0.1))', 'amount')},
  {r(f'sum(greatest(CASE WHEN y = 1 THEN 0.5 * a ELSE 0.08 * a END, 0.1) * {BCE}) / sum(greatest(CASE WHEN y = 1 THEN 0.5 * a ELSE 0.08 * a END, 0.1))', 'stake')} FROM d, w""")
def loss_portfolio(spark, sf):
    d, P = probabilities(spark, sf), portfolio_losses
    parts = {
        "balanced_focal": P.balanced_focal(d, "y", "p"), "cost": P.cost_at_threshold(d, "y", "p", 10.0), "ks_focused": P.ks_focused(d, "y", "p"), "top_k": P.top_k_capture(d, "y", "p"), "profit": P.expected_profit(d, "y", "p"),
        "amount": P.amount_weighted(d, "y", "p", "l_extendedprice"), "stake": P.expected_value(d, "y", "p", "l_extendedprice"),
    }
    return spark.createDataFrame([tuple(float(x.first()[0]) for x in parts.values())], ", ".join(f"{k} double" for k in parts))


@query()
def loss_ranked(spark, sf):
    d, P = probabilities(spark, sf), portfolio_losses
    parts = {"lift_focused": P.lift_focused(d, "y", "p"), "ranking_hinge": P.ranking_hinge(d, "y", "p"), "bad_debt": P.bad_debt(d, "y", "p")}
    return spark.createDataFrame([tuple(float(x.first()[0]) for x in parts.values())], ", ".join(f"{k} double" for k in parts))


# --- tables behind charts ---

@query(f"WITH {CURVE} SELECT {r('score', 'threshold')}, {r('db / (db + dg)', 'precision')}, {r('db / tb', 'recall')} FROM d")
def precision_recall_points(spark, sf):
    return curves.precision_recall(scored(spark, sf), "y", "n_chars")


@query(f"WITH {CURVE} SELECT {r('sum(db / (db + dg) * b / tb)', 'average_precision')} FROM d")
def average_precision(spark, sf):
    return curves.average_precision(scored(spark, sf), "y", "n_chars")


@query(f"WITH c AS (SELECT {bin_of('l_extendedprice', [10000, 30000, 60000])} AS bin, count(*) AS n, sum({Y}) AS bad FROM lineitem GROUP BY 1), w AS (SELECT *, sum(n) OVER o / sum(n) OVER () AS s, sum(bad) OVER o / sum(bad) OVER () AS k FROM c WINDOW o AS (ORDER BY bin DESC ROWS UNBOUNDED PRECEDING)) SELECT bin, n, CAST(bad AS BIGINT) AS bad, {r('s', 'cum_share')}, {r('k', 'cum_capture')}, {r('k / s', 'cum_lift')} FROM w")
def gain_table(spark, sf):
    return curves.gain(lineitem(spark, sf), BinModel("l_extendedprice", [10000.0, 30000.0, 60000.0]), "y")


@query(f"WITH {PD}, k AS (SELECT unnest([0.2, 0.5, 0.8]) AS threshold), c AS (SELECT threshold, count(*) FILTER (WHERE p >= threshold) AS cn, sum(CASE WHEN p >= threshold THEN y ELSE 0 END) AS cb, count(*) AS tn, sum(y) AS tb FROM d, k GROUP BY 1) SELECT {r('threshold', 'threshold')}, {r('cb / cn', 'precision')}, {r('cb / tb', 'recall')}, {r('2 * cb / (cn + tb)', 'f1')}, {r('cn / tn', 'rejected')} FROM c")
def threshold_table(spark, sf):
    return curves.thresholds(probabilities(spark, sf), "y", "p", [0.2, 0.5, 0.8])


@query("WITH b AS (SELECT min(l_quantity) AS lo, (max(l_quantity) - min(l_quantity)) AS w FROM lineitem), c AS (SELECT CAST(" + " + ".join(f"CASE WHEN l_quantity >= lo + w * {i} / 6 THEN 1 ELSE 0 END" for i in range(1, 6)) + f" AS INTEGER) AS bin, CAST({Y} AS INTEGER) AS y, count(*) AS n FROM lineitem, b GROUP BY 1, 2) SELECT bin, CAST(y AS INTEGER) AS y, n, {r('n / sum(n) OVER (PARTITION BY y)', 'share')} FROM c")
def histogram_by_class(spark, sf):
    return curves.histogram_by_class(lineitem(spark, sf), "y", "l_quantity", 6)


@query(f"SELECT {PERIODS['Q']} AS period, {bin_of('o_totalprice', [100000, 200000])} AS bin, count(*) AS n, {r('count(*) / sum(count(*)) OVER (PARTITION BY ' + PERIODS['Q'] + ')', 'n_share')}, {r(f'avg({YO})', 'bad_rate')} FROM orders GROUP BY 1, 2")
def bin_trend(spark, sf):
    return curves.bin_trend(orders(spark, sf), BinModel("o_totalprice", [100000.0, 200000.0]), "y", L.period("o_orderdate", "Q"))


@query(f"SELECT {PERIODS['M']} AS period, count(*) AS n, {r('avg(CASE WHEN o_totalprice < 150000 THEN 1 ELSE 0 END)', 'approval_rate')}, {r(f'avg(CASE WHEN o_totalprice < 150000 THEN {YO} END)', 'bad_rate')} FROM orders GROUP BY 1")
def approval_trend(spark, sf):
    return curves.approval_trend(orders(spark, sf), F.col("o_totalprice") < 150000, L.period("o_orderdate", "M"), "y")


@query(f"WITH d AS (SELECT {Y} AS y, l_linenumber % 7 = 0 AS a, l_linenumber % 3 = 0 AS b FROM lineitem) SELECT 'a' AS feature, {r('avg(CASE WHEN a THEN 1 ELSE 0 END)', 'missing_rate')}, {r('avg(y) FILTER (WHERE a)', 'bad_rate_missing')}, {r('avg(y) FILTER (WHERE NOT a)', 'bad_rate_present')} FROM d UNION ALL SELECT 'b', {r('avg(CASE WHEN b THEN 1 ELSE 0 END)', 'missing_rate')}, {r('avg(y) FILTER (WHERE b)', 'bad_rate_missing')}, {r('avg(y) FILTER (WHERE NOT b)', 'bad_rate_present')} FROM d")
def missing_bad_rate(spark, sf):
    n = F.col("l_linenumber")
    return curves.missing_bad_rate(lineitem(spark, sf), {"a": F.when(n % 7 != 0, n), "b": F.when(n % 3 != 0, n)}, "y")


@query(f"WITH s AS (SELECT c_mktsegment AS segment, score, count(*) AS n, sum(y) AS b FROM {JOINED} GROUP BY 1, 2), c AS (SELECT *, sum(b) OVER o AS cb, sum(n - b) OVER o AS cg, sum(b) OVER p AS tb, sum(n - b) OVER p AS tg FROM s WINDOW p AS (PARTITION BY segment), o AS (PARTITION BY segment ORDER BY score ROWS UNBOUNDED PRECEDING)) SELECT segment, CAST(sum(n) AS BIGINT) AS n, CAST(sum(b) AS BIGINT) AS bad, {r('max(abs(cb / tb - cg / tg))', 'ks')}, {r('sum(b * (cg - (n - b) / 2)) / max(tb * tg)', 'auc')} FROM c GROUP BY 1")
def segment_ks_auc(spark, sf):
    return curves.segment_ks_auc(applications(spark, sf), "y", "score", "c_mktsegment")


def entry(spark: SparkSession) -> DataFrame:
    return QUERIES["bin_stats_quantile"](spark, "/root/testdata/sf0.001")


from . import more  # noqa: E402,F401  registers the rest
