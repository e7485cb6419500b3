"""More queries of the catalogue, each with its oracle where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import losses
from ..operators import bin_stats as B
from ..operators import binning, eda, metrics, models, scorecard, selectors, stability, strategy
from ..operators.binning import BinModel
from .catalogue import FEATURES, JOINED, OD_SQL, ORACLES, P_SQL, QUERIES, SCORED_SQL, Y, _each, applications, counted, lineitem, od, probabilities, query, scored, t
from .sql import bin_of, bin_table, r


def oracle_of(name: str, sql: str) -> None:
    """An oracle for a query that is registered without one."""
    assert name in QUERIES and name not in ORACLES, name
    ORACLES[name] = sql


def unrounded(sql: str) -> str:
    return sql.replace("round(CAST(", "((").replace(" AS DOUBLE), 6) + 0.0", "))")


# --- splits and bins ---

def closed_right(splits: list[float]) -> str:
    """Bins (a, b] of l_quantity."""
    return "CAST(" + " + ".join(f"CASE WHEN l_quantity > {s} THEN 1 ELSE 0 END" for s in splits) + " AS INTEGER)"

A_SPLITS, B_SPLITS = [10.0, 20.0, 40.0], [25.0]


def _of_splits(splits: list[float], what: str) -> str:
    return f"(SELECT {what} FROM ({bin_table(counted(closed_right(splits), 'lineitem', Y))}))"


@query(f"SELECT {_of_splits(A_SPLITS, 'max(iv_total)')} AS iv")
def splits_iv(spark, sf):
    return B.iv_for_splits(lineitem(spark, sf), "l_quantity", "y", A_SPLITS)


@query(f"SELECT {_of_splits(A_SPLITS, 'max(ks)')} AS ks")
def splits_ks(spark, sf):
    return B.ks_for_splits(lineitem(spark, sf), "l_quantity", "y", A_SPLITS)


@query(f"""SELECT *, CASE WHEN iv_first >= iv_second THEN 'first' ELSE 'second' END AS better_iv, CASE WHEN ks_first >= ks_second THEN 'first' ELSE 'second' END AS better_ks FROM (
  SELECT {_of_splits(A_SPLITS, 'max(iv_total)')} AS iv_first, {_of_splits(A_SPLITS, 'max(ks)')} AS ks_first, {_of_splits(B_SPLITS, 'max(iv_total)')} AS iv_second, {_of_splits(B_SPLITS, 'max(ks)')} AS ks_second)""")
def splits_compared(spark, sf):
    return B.compare_splits(lineitem(spark, sf), "l_quantity", "y", A_SPLITS, B_SPLITS)


@query(f"""
WITH g AS (SELECT {bin_of('l_quantity', [10, 20, 30, 40])} AS bin, count(*) AS n, sum({Y}) AS b FROM lineitem GROUP BY 1),
v AS (SELECT -1 + 2.0 * bin / 4 AS x, (CAST(b AS DOUBLE) / n) / (sum(b) OVER () / sum(n) OVER ()) AS v, bin FROM g),
w AS (SELECT *, v - lag(v) OVER (ORDER BY bin) AS d FROM v),
c AS (SELECT (count(*) * sum(x * x * v) - sum(x * x) * sum(v)) / (count(*) * sum(pow(x, 4)) - pow(sum(x * x), 2)) AS c, count(*) FILTER (WHERE d > 1e-10) AS wrong FROM w)
SELECT 'descending' AS trend, {r('CASE WHEN wrong > 0 THEN -abs(c) ELSE abs(c) END', 'coefficient')} FROM c""")
def curve_coefficient(spark, sf):
    m = BinModel("l_quantity", [10.0, 20.0, 30.0, 40.0])
    return spark.createDataFrame([("descending", B.curve_quality(lineitem(spark, sf), m, "y"))], "trend string, coefficient double")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 30 THEN '[30, +inf)' WHEN l_quantity >= 12.5 THEN '[12.5, 30)' ELSE '[-inf, 12.5)' END AS l_quantity_bin FROM lineitem")
def bin_labels(spark, sf):
    return binning.transform(t(spark, sf, "lineitem"), {"l_quantity": BinModel("l_quantity", [12.5, 30.0])}, as_label=True).select("l_orderkey", "l_linenumber", "l_quantity_bin")


@query("""
WITH k AS (SELECT o_orderpriority AS v, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) AS place FROM orders GROUP BY 1)
SELECT CAST(least(place, 3) - 1 AS INTEGER) AS bin, count(*) AS n FROM orders JOIN k ON v = o_orderpriority GROUP BY 1""")
def categories_with_rest(spark, sf):
    d = t(spark, sf, "orders")
    m = binning.fit_binning(d, "o_orderpriority", method="quantile", max_n_bins=3)
    return d.groupBy(m.index().alias("bin")).agg(F.count("*").alias("n"))


@query()
def binning_lift_refined(spark, sf):
    d = lineitem(spark, sf)
    return B.bin_stats(d, binning.fit_binning(d, "l_extendedprice", "y", method="quantile", max_n_bins=5, lift_refine={}), "y").drop("bin_label")


@query(bin_table(counted(bin_of("l_quantity", [15, 35]), "lineitem", Y)))
def binning_prebinned(spark, sf):
    d = lineitem(spark, sf)
    return B.bin_stats(d, binning.fit_binning(d, "l_quantity", "y", method="quantile", prebinning=[15, 35]), "y").drop("bin_label")


# --- metrics ---

def curve(x: str, y: str, table: str) -> str:
    """CTEs s, c: cumulative counts of distinct values of x."""
    return f"s AS (SELECT CAST({x} AS DOUBLE) AS x, CAST(count(*) AS DOUBLE) AS n, CAST(sum({y}) AS DOUBLE) AS b FROM {table} GROUP BY 1), c AS (SELECT *, sum(b) OVER o AS cb, sum(n - b) OVER o AS cg, sum(b) OVER () AS tb, sum(n - b) OVER () AS tg FROM s WINDOW o AS (ORDER BY x ROWS UNBOUNDED PRECEDING))"

AUC = "sum(b * (cg - (n - b) / 2)) / max(tb * tg)"


@query(f"WITH {curve('l_extendedprice', 'CASE WHEN l_linenumber > 3 THEN 1 ELSE 0 END', 'lineitem')} SELECT {r('max(abs(cb / tb - cg / tg))', 'ks')} FROM c")
def ks_two_samples(spark, sf):
    d = t(spark, sf, "lineitem").withColumn("sample", (F.col("l_linenumber") > 3).cast("int"))
    return metrics.ks_two_samples(d, "l_extendedprice", "sample")


def _auc_sql(f: str) -> str:
    return f"SELECT '{f}' AS feature, greatest(a, 1 - a) AS auc, ks, CASE WHEN a >= 0.5 THEN 'higher is riskier' ELSE 'lower is riskier' END AS direction FROM (WITH {curve(f, Y, 'lineitem')} SELECT {AUC} AS a, max(abs(cb / tb - cg / tg)) AS ks FROM c)"

oracle_of("univariate_auc", f"SELECT feature, {r('auc', 'auc')}, {r('ks', 'ks')}, direction FROM ({_each(_auc_sql)})")


def _edges(f: str, k: int) -> str:
    """List of the inner k-quantiles over the least value."""
    return f"(SELECT list_filter(q, lambda e: e > m) FROM (SELECT list_distinct(quantile_cont({f}, {[i / k for i in range(1, k)]})) AS q, min({f}) AS m FROM lineitem))"

IV_10 = bin_table(_each(lambda f: f"SELECT '{f}' AS feature, {bin_of(f, edges='e')} AS bin, count(*) AS n, sum({Y}) AS bad FROM lineitem, (SELECT {_edges(f, 10)} AS e) GROUP BY 1, 2"), ["feature"])
oracle_of("leakage_check", f"SELECT feature, iv, {r('auc', 'auc')}, iv > 0.5 OR auc > 0.9 AS suspicious FROM (SELECT feature, max(iv_total) AS iv FROM ({IV_10}) GROUP BY 1) JOIN (SELECT feature, auc FROM ({_each(_auc_sql)})) USING (feature)")


@query(f"SELECT feature, iv, {r('auc', 'auc')}, {r('(rank() OVER (ORDER BY iv DESC) + rank() OVER (ORDER BY auc DESC)) / 2', 'rank')} FROM (SELECT feature, max(iv_total) AS iv FROM ({IV_10}) GROUP BY 1) JOIN (SELECT feature, auc FROM ({_each(_auc_sql)})) USING (feature)")
def importance_ranking(spark, sf):
    return eda.importance_ranking(lineitem(spark, sf), FEATURES, "y")


@query(f"""
SELECT feature, iv, CASE WHEN iv < 0.02 THEN 'none' WHEN iv < 0.1 THEN 'weak' WHEN iv < 0.3 THEN 'medium' WHEN iv < 0.5 THEN 'strong' ELSE 'suspicious' END AS iv_rating, {r('auc', 'auc')}, {r('ks', 'ks')}, {r('0', 'missing_rate')}, kinds AS "distinct", bins, top_lift, least_lift
FROM (SELECT feature, max(iv_total) AS iv, count(*) AS bins, max(lift) AS top_lift, min(lift) AS least_lift FROM ({IV_10}) GROUP BY 1) JOIN ({_each(_auc_sql)}) USING (feature) JOIN ({_each(lambda f: f"SELECT '{f}' AS feature, count(DISTINCT {f}) AS kinds FROM lineitem")}) USING (feature)""")
def feature_efficiency(spark, sf):
    return eda.feature_report(lineitem(spark, sf), FEATURES, "y", method="quantile", max_n_bins=10)


@query(f"""
SELECT feature, label, CAST(sum(n) AS BIGINT) AS n, {r('sum(bad) / sum(n)', 'bad_rate')}, max(iv_total) AS iv, max(ks) AS ks, max(lift) AS top_lift FROM ({bin_table(" UNION ALL ".join(f"SELECT '{f}' AS feature, 'od_{d}+' AS label, {bin_of(f, sp)} AS bin, count(*) AS n, sum(CASE WHEN {OD_SQL} > {d} THEN 1 ELSE 0 END) AS bad FROM lineitem GROUP BY 3" for f, sp in (("l_quantity", [10, 20, 30, 40]), ("l_discount", [0.03, 0.07])) for d in (7, 60)), by=["feature", "label"])}) GROUP BY 1, 2""")
def feature_efficiency_by_label(spark, sf):
    d = t(spark, sf, "lineitem").withColumn("od", od())
    return eda.multi_label_efficiency(d, ["l_quantity", "l_discount"], ["od"], [7, 60], {"l_quantity": BinModel("l_quantity", [10.0, 20.0, 30.0, 40.0]), "l_discount": BinModel("l_discount", [0.03, 0.07])})

SCORE_EDGES = f"(SELECT list_filter(q, lambda e: e > m) FROM (SELECT list_distinct(quantile_cont(n_chars, [0.2, 0.4, 0.6, 0.8])) AS q, min(n_chars) AS m FROM {SCORED_SQL}))"


@query(f"""SELECT a.*, min_score, max_score FROM ({bin_table(f"SELECT {bin_of('n_chars', edges='e')} AS bin, count(*) AS n, sum(y) AS bad FROM {SCORED_SQL}, (SELECT {SCORE_EDGES} AS e) GROUP BY 1")}) a
JOIN (SELECT {bin_of('n_chars', edges='e')} AS bin, min(n_chars) AS min_score, max(n_chars) AS max_score FROM {SCORED_SQL}, (SELECT {SCORE_EDGES} AS e) GROUP BY 1) b USING (bin)""")
def score_bucket_table(spark, sf):
    return metrics.score_table(scored(spark, sf), "y", "n_chars", 5).drop("bin_label")


def _top_lift(f: str, order: str) -> str:
    return f"""SELECT '{f}' AS feature, ((cb - b) + b * (take - (cn - n)) / n) / take / (tb / tn) AS lift FROM (
  SELECT *, greatest(1, floor(tn * 0.1)) AS take FROM (SELECT n, b, sum(n) OVER o AS cn, sum(b) OVER o AS cb, sum(n) OVER () AS tn, sum(b) OVER () AS tb FROM (SELECT {f} AS x, CAST(count(*) AS DOUBLE) AS n, CAST(sum({Y}) AS DOUBLE) AS b FROM lineitem GROUP BY 1) WINDOW o AS (ORDER BY x {order} ROWS UNBOUNDED PRECEDING)))
  WHERE cn - n < take AND cn >= take"""


@query(f"SELECT CAST(1 AS INTEGER) AS step, 'lift' AS name, feature, max(lift) >= 1 AS kept, {r('max(lift)', 'score')} FROM ({' UNION ALL '.join(_top_lift(f, o) for f in FEATURES[:2] for o in ('ASC', 'DESC'))}) GROUP BY feature")
def lift_selection(spark, sf):
    return selectors.report(spark, [selectors.by_lift(lineitem(spark, sf), FEATURES[:2], "y", threshold=1.0)])


@query("SELECT CAST(1 AS INTEGER) AS step, 'name' AS name, column_name AS feature, regexp_matches(column_name, 'price|tax$') AS kept, CAST(regexp_matches(column_name, 'price|tax$') AS DOUBLE) AS score FROM (DESCRIBE lineitem)")
def name_selection(spark, sf):
    d = t(spark, sf, "lineitem")
    return selectors.report(spark, [selectors.by_name(d, d.columns, "price|tax$")])


@query("SELECT CAST(1 AS INTEGER) AS step, 'type' AS name, column_name AS feature, column_type = 'DOUBLE' AS kept, CAST(column_type = 'DOUBLE' AS DOUBLE) AS score FROM (DESCRIBE lineitem)")
def type_selection(spark, sf):
    d = t(spark, sf, "lineitem")
    return selectors.report(spark, [selectors.by_type(d, d.columns, ["double"])])


@query(f"SELECT label_a, label_b, {r('corr', 'correlation')} FROM (" + " UNION ALL ".join(f"SELECT 'od_{a}+' AS label_a, 'od_{b}+' AS label_b, corr(CASE WHEN {OD_SQL} > {a} THEN 1 ELSE 0 END, CASE WHEN {OD_SQL} > {b} THEN 1 ELSE 0 END) AS corr FROM lineitem" for a, b in ((7, 30), (7, 60), (30, 60))) + ")")
def label_correlation(spark, sf):
    return eda.label_correlation(t(spark, sf, "lineitem").withColumn("od", od()), ["od"], [7, 30, 60])

RATED = "l_discount * 10 AS iv, l_tax * 5 AS psi, l_quantity / 4 AS vif, l_discount * l_linenumber - 0.3 AS c"


def _rated(x: str, bounds: list[float], names: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN {x} < {b} THEN '{n}'" for b, n in zip(bounds, names)) + f" ELSE '{names[-1]}' END"


@query(f"""SELECT l_orderkey, l_linenumber, {_rated('iv', [0.02, 0.1, 0.3, 0.5], ['none', 'weak', 'medium', 'strong', 'suspicious'])} AS iv, {_rated('psi', [0.1, 0.25], ['stable', 'shifting', 'unstable'])} AS psi,
  {_rated('vif', [5, 10], ['low', 'moderate', 'high'])} AS vif, {_rated('abs(c)', [0.3, 0.7, 0.9], ['weak', 'moderate', 'strong', 'very strong'])} AS correlation FROM (SELECT l_orderkey, l_linenumber, {RATED} FROM lineitem)""")
def ratings(spark, sf):
    d = t(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", *RATED.split(", "))
    return d.select("l_orderkey", "l_linenumber", L.iv_rating(F.col("iv")).alias("iv"), L.psi_rating(F.col("psi")).alias("psi"), L.vif_rating(F.col("vif")).alias("vif"), L.corr_rating(F.col("c")).alias("correlation"))


@query(f"SELECT l_orderkey, l_linenumber, {r('CASE WHEN l_linenumber = 1 THEN -1 ELSE l_quantity / (l_linenumber - 1) END', 'ratio')} FROM lineitem")
def safe_division(spark, sf):
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", L.safe_divide(F.col("l_quantity"), F.col("l_linenumber") - 1, -1.0).alias("ratio"))


@query("""
WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders), k AS (SELECT quantile_cont(o_custkey, 0.25) AS a, quantile_cont(o_custkey, 0.75) AS b FROM orders)
SELECT o_orderkey FROM orders, q, k WHERE o_totalprice BETWEEN q.a - 0.2 * (q.b - q.a) AND q.b + 0.2 * (q.b - q.a) AND o_custkey BETWEEN k.a - 0.2 * (k.b - k.a) AND k.b + 0.2 * (k.b - k.a)""")
def rows_within_fences(spark, sf):
    return eda.within_fences(t(spark, sf, "orders"), ["o_totalprice", "o_custkey"], 0.2).select("o_orderkey")


@query(f"""
WITH g AS (SELECT {bin_of('l_quantity', [10, 15, 20, 30, 40])} AS bin, avg({Y}) AS rate FROM lineitem GROUP BY 1), k AS (SELECT bin, rank() OVER (ORDER BY rate) + (count(*) OVER (PARTITION BY rate) - 1) / 2 AS place FROM g)
SELECT {r('corr(bin, place)', 'rho')}, abs(corr(bin, place)) >= 0.5 AS monotone FROM k""")
def bin_monotonicity(spark, sf):
    return eda.monotonicity(lineitem(spark, sf), BinModel("l_quantity", [10.0, 15.0, 20.0, 30.0, 40.0]), "y")


# --- segments, rules, swap sets, prediction ---

oracle_of("swap_summary", f"""
WITH q AS ({unrounded(ORACLES['swap_quadrants'])}), p AS (SELECT sum(share) FILTER (WHERE swap_type IN ('in-in', 'in-out')) AS p0, sum(share) FILTER (WHERE swap_type IN ('in-in', 'out-in')) AS p1,
  sum(share * bad_rate) FILTER (WHERE swap_type IN ('in-in', 'in-out')) AS b0, sum(share * bad_rate) FILTER (WHERE swap_type IN ('in-in', 'out-in')) AS b1, sum(share) FILTER (WHERE swap_type IN ('in-out', 'out-out')) AS x FROM q)
SELECT {r('p0', 'pass_before')}, {r('p1', 'pass_after')}, {r('b0 / p0', 'bad_rate_before')}, {r('b1 / p1', 'bad_rate_after')}, {r('(b0 / p0 - b1 / p1) / x', 'risk_rejection_rate')} FROM p""")

SEGMENT_BINS = bin_table(" UNION ALL ".join(f"SELECT c_mktsegment, '{f}' AS feature, {bin_of(f, edges='e')} AS bin, count(*) AS n, sum(y) AS bad FROM {JOINED}, (SELECT list_distinct(quantile_cont({f}, {[i / 10 for i in range(1, 10)]})) AS e FROM {JOINED}) GROUP BY 1, 3" for f in ("score", "o_totalprice")), ["c_mktsegment", "feature"])
oracle_of("segment_effectiveness", f"SELECT c_mktsegment, feature, CAST(sum(n) AS BIGINT) AS n, max(iv_total) AS iv, max(ks) AS ks FROM ({SEGMENT_BINS}) GROUP BY 1, 2 HAVING sum(n) >= 50")


def _rules_sql() -> str:
    rules = " UNION ALL ".join(f"SELECT '{f} {op} ' || format('{{:.10g}}', s) AS rule, count(*) FILTER (WHERE {f} {op} s) AS n, sum({Y}) FILTER (WHERE {f} {op} s) AS b, count(*) AS tn, sum({Y}) AS tb FROM lineitem, (SELECT unnest({_edges(f, 10)}) AS s) GROUP BY s" for f in ("l_quantity", "l_extendedprice", "l_discount") for op in (">=", "<"))
    return f"""WITH q AS (SELECT rule, n, b, CAST(n AS DOUBLE) / tn AS support, CAST(b AS DOUBLE) / n AS p, CAST(b AS DOUBLE) / tb AS q, (CAST(b AS DOUBLE) / n) / (CAST(tb AS DOUBLE) / tn) AS lift, abs(CAST(b AS DOUBLE) / tb - CAST(n - b AS DOUBLE) / (tn - tb)) AS ks FROM ({rules}))
SELECT rule, n, CAST(b AS BIGINT) AS bad, {r('support', 'support')}, {r('p', 'precision')}, {r('q', 'recall')}, {r('2 * p * q / (p + q)', 'f1')}, {r('lift', 'lift')}, {r('ks', 'ks')} FROM q WHERE support >= 0.01 AND lift >= 1.0"""

oracle_of("single_feature_rules", _rules_sql())


@query(f"""
WITH d AS (SELECT {bin_of('l_extendedprice', edges='e')} AS bin, {Y} AS y FROM lineitem, (SELECT {_edges('l_extendedprice', 5)} AS e)), k AS (SELECT bin, avg(y) AS rate, count(*) AS n FROM d GROUP BY 1), m AS (SELECT 0.1 / (sum(rate * n) / sum(n)) AS f FROM k)
SELECT bin, n, {r('least(rate * f, 1)', 'predicted_rate')}, {r('rate', 'bad_rate')} FROM k, m""")
def overdue_prediction_quantile(spark, sf):
    d = lineitem(spark, sf)
    p = strategy.OverduePredictor.fit(d, "l_extendedprice", "y", method="quantile").calibrate(d, 0.1)
    return p.transform(d).groupBy(p.model.index().alias("bin")).agg(F.count("*").alias("n"), F.avg("predicted_rate").alias("predicted_rate"), F.avg("y").alias("bad_rate"))


# --- losses over distinct probabilities ---

PS = f"s AS (SELECT {P_SQL} AS p, CAST(count(*) AS DOUBLE) AS n, CAST(sum({Y}) AS DOUBLE) AS b FROM lineitem GROUP BY 1), z AS (SELECT sum(n) AS tn, sum(b) AS tb, sum(-b * ln(p) - (n - b) * ln(1 - p)) / sum(n) AS bce FROM s)"
oracle_of("loss_ranking", f"""
WITH {PS}, c AS (SELECT *, sum(n) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING) AS cn FROM s), w AS (SELECT *, greatest(0, least(1, (0.3 * tn - (cn - n)) / n)) AS part FROM c, z)
SELECT (SELECT {r('sum(x.b * (y.n - y.b) * ln(1 + exp(y.p - x.p))) / sum(x.b * (y.n - y.b))', 'v')} FROM s x, s y) AS pairwise, (SELECT {r('sum(b * part) / sum(n * part)', 'v')} FROM w) AS approval""")
oracle_of("loss_ranked", f"""
WITH {PS}, c AS (SELECT *, sum(n) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS dn, sum(n) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING) AS cn FROM s),
l AS (SELECT *, 1 + 2 * greatest(0, least(1, (greatest(1, ceil(tn * 0.1)) - (dn - n)) / n)) AS w FROM c, z), k AS (SELECT sum(n) AS n, sum(b) AS b FROM c, z WHERE cn - c.n < 0.3 * tn)
SELECT (SELECT {r('sum(w * (-b * 1.5 * ln(p) - (n - b) * ln(1 - p))) / sum(w * (b * 1.5 + n - b))', 'v')} FROM l) AS lift_focused,
  (SELECT {r('max(bce) + sum(x.b * (y.n - y.b) * pow(greatest(0, 0.2 - x.p + y.p), 2)) / sum(x.b * (y.n - y.b))', 'v')} FROM s x, s y, z) AS ranking_hinge, (SELECT {r('bce + k.b / k.n + 0.5 * abs(k.n / tn - 0.3)', 'v')} FROM k, z) AS bad_debt""")


# --- rates by bisection ---

oracle_of("finance_rates", f"""
WITH RECURSIVE i(k, lo, hi) AS (SELECT 0, CAST(-0.9 AS DOUBLE), CAST(1 AS DOUBLE) UNION ALL SELECT k + 1, CASE WHEN up THEN m ELSE lo END, CASE WHEN up THEN hi ELSE m END FROM (SELECT k, lo, hi, (lo + hi) / 2 AS m, -1 + 0.3 / (1 + m) + 0.4 / pow(1 + m, 2) + 0.5 / pow(1 + m, 3) > 0 AS up FROM i) WHERE k < 60),
j(k, lo, hi) AS (SELECT 0, CAST(1e-6 AS DOUBLE), CAST(1 AS DOUBLE) UNION ALL SELECT k + 1, CASE WHEN up THEN m ELSE lo END, CASE WHEN up THEN hi ELSE m END FROM (SELECT k, lo, hi, (lo + hi) / 2 AS m, pow(1 + m, 12) - 0.1 * (pow(1 + m, 12) - 1) / m < 0 AS up FROM j) WHERE k < 60)
SELECT p_partkey, {r('i.lo', 'irr')}, {r('j.lo', 'rate')} FROM part, (SELECT lo FROM i WHERE k = 60) i, (SELECT lo FROM j WHERE k = 60) j""")


# --- calibration and drift ---

oracle_of("isotonic_calibration", f"""
WITH s AS (SELECT {P_SQL} AS p, CAST(count(*) AS DOUBLE) AS n, CAST(sum({Y}) AS DOUBLE) AS b FROM lineitem GROUP BY 1), c AS (SELECT row_number() OVER o AS i, p, sum(n) OVER o AS cn, sum(b) OVER o AS cb FROM s WINDOW o AS (ORDER BY p ROWS UNBOUNDED PRECEDING)),
a AS (SELECT 0 AS i, 0 AS cn, 0 AS cb UNION ALL SELECT i, cn, cb FROM c), m AS (SELECT lo.i AS j, hi.i AS k, (hi.cb - lo.cb) / (hi.cn - lo.cn) AS mean FROM a lo JOIN a hi ON lo.i < hi.i),
f AS (SELECT c.i, m.j, min(m.mean) AS least FROM c JOIN m ON m.j < c.i AND m.k >= c.i GROUP BY 1, 2), g AS (SELECT p, max(least) AS v FROM f JOIN c USING (i) GROUP BY 1)
SELECT l_orderkey, l_linenumber, {r('v', 'calibrated')} FROM (SELECT l_orderkey, l_linenumber, {P_SQL} AS p FROM lineitem) JOIN g USING (p)""")


@query(f"""
WITH d AS (SELECT l_orderkey, l_linenumber, {P_SQL} AS p, {Y} AS y FROM lineitem), e AS (SELECT list_filter(q, lambda e: e > m) AS e FROM (SELECT list_distinct(quantile_cont(p, {[i / 10 for i in range(1, 10)]})) AS q, min(p) AS m FROM d)), b AS (SELECT d.*, {bin_of('p', edges='e')} AS bin FROM d, e)
SELECT l_orderkey, l_linenumber, {r('avg(y) OVER (PARTITION BY bin)', 'calibrated')} FROM b""")
def histogram_calibration(spark, sf):
    d = probabilities(spark, sf)
    return d.select("l_orderkey", "l_linenumber", models.histogram_calibration(d, "y", "p").alias("calibrated"))


@query(f"""
WITH d AS (SELECT l_orderkey, l_linenumber, l_linenumber <= 3 AS ref, {P_SQL} AS p, {Y} AS y FROM lineitem), e AS (SELECT list_filter(q, lambda e: e > m) AS e FROM (SELECT list_distinct(quantile_cont(p, [0.2, 0.4, 0.6, 0.8])) AS q, min(p) AS m FROM d WHERE ref)),
b AS (SELECT d.*, {bin_of('p', edges='e')} AS bin FROM d, e), k AS (SELECT bin, avg(y) FILTER (WHERE ref) AS a, avg(y) FILTER (WHERE NOT ref) AS c FROM b GROUP BY 1)
SELECT l_orderkey, l_linenumber, {r('1 / (1 + exp(-(ln(p / (1 - p)) + ln(a / (1 - a)) - ln(c / (1 - c)))))', 'recalibrated')} FROM b JOIN k USING (bin) WHERE NOT ref""")
def bin_recalibration(spark, sf):
    d = probabilities(spark, sf)
    ref = F.col("l_linenumber") <= 3
    return d.where(~ref).select("l_orderkey", "l_linenumber", scorecard.recalibrated_probability(d, "p", "y", ref, 5).alias("recalibrated"))

GRID = [i / 20 for i in range(21)]
oracle_of("score_drift_quantile", f"""
WITH q AS (SELECT unnest(quantile_cont(l_extendedprice, {GRID}) FILTER (WHERE l_linenumber > 3)) AS a, unnest(quantile_cont(l_extendedprice, {GRID}) FILTER (WHERE l_linenumber <= 3)) AS b FROM lineitem),
g AS (SELECT a, b, lead(a) OVER (ORDER BY a) AS a1, lead(b) OVER (ORDER BY a) AS b1 FROM q)
SELECT l_orderkey, l_linenumber, {r('CASE WHEN a1 IS NULL THEN b ELSE b + (x - a) * (b1 - b) / (a1 - a) END', 'aligned')} FROM (SELECT l_orderkey, l_linenumber, l_extendedprice AS x FROM lineitem WHERE l_linenumber > 3) ASOF JOIN g ON x >= a""")


# --- selection ---

oracle_of("vif_selection", f"""
WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS a, corr(l_quantity, l_discount) AS b, corr(l_quantity, l_tax) AS c, corr(l_extendedprice, l_discount) AS d, corr(l_extendedprice, l_tax) AS e, corr(l_discount, l_tax) AS f FROM lineitem),
k AS (SELECT *, 1 - d * d - e * e - f * f + 2 * d * e * f AS m1, 1 - b * b - c * c - f * f + 2 * b * c * f AS m2, 1 - a * a - c * c - e * e + 2 * a * c * e AS m3, 1 - a * a - b * b - d * d + 2 * a * b * d AS m4 FROM c),
z AS (SELECT *, m1 - a * (a * (1 - f * f) - d * (b - c * f) + e * (b * f - c)) + b * (a * (d - e * f) - (b - c * f) + e * (b * e - c * d)) - c * (a * (d * f - e) - (b * f - c) + d * (b * e - c * d)) AS det FROM k)
SELECT CAST(1 AS INTEGER) AS step, 'vif' AS name, feature, true AS kept, {r('v', 'score')} FROM (SELECT 'l_quantity' AS feature, m1 / det AS v FROM z UNION ALL SELECT 'l_extendedprice', m2 / det FROM z UNION ALL SELECT 'l_discount', m3 / det FROM z UNION ALL SELECT 'l_tax', m4 / det FROM z)""")


@query()
def sequential_selection(spark, sf):
    return selectors.report(spark, [selectors.by_sequence(lineitem(spark, sf), FEATURES[:3], "y", n_keep=1, folds=2, key="l_orderkey")])


@query(f"""
WITH g AS (SELECT '{FEATURES[0]}' AS f, l_linenumber > 3 AS late, {bin_of('l_quantity', [10, 20, 30, 40])} AS bin FROM lineitem), n AS (SELECT bin, count(*) FILTER (WHERE NOT late) / sum(count(*) FILTER (WHERE NOT late)) OVER () AS e, count(*) FILTER (WHERE late) / sum(count(*) FILTER (WHERE late)) OVER () AS a FROM g GROUP BY 1)
SELECT {r('sum((a - e) * ln(a / e))', 'psi')}, CASE WHEN sum((a - e) * ln(a / e)) < 0.1 THEN 'stable' WHEN sum((a - e) * ln(a / e)) < 0.25 THEN 'shifting' ELSE 'unstable' END AS rating FROM n""")
def score_stability(spark, sf):
    m = BinModel("l_quantity", [10.0, 20.0, 30.0, 40.0])
    p = stability.psi_table(t(spark, sf, "lineitem"), m, F.col("l_linenumber") > 3).agg(F.max("psi").alias("psi"))
    return p.select("psi", L.psi_rating(F.col("psi")).alias("rating"))


# --- gradients, comparisons of transforms and alignments ---

PQ = f"SELECT l_orderkey, l_linenumber, {Y} AS y, {P_SQL} AS p, l_extendedprice AS a FROM lineitem"
GATE = "(1 / (1 + exp(-(p - 0.6) / 0.05)))"
APPROVE = "(1 / (1 + exp(-(0.5 - p) / 0.1)))"


@query(f"""SELECT l_orderkey, l_linenumber, {r('CASE WHEN y = 1 THEN 0.25 * pow(1 - p, 2) * (2 * p * ln(p) - (1 - p)) ELSE 0.75 * p * (p - (1 - p) * ln(1 - p)) END', 'asymmetric')}, {r('p - (y * 0.9 + 0.05)', 'smoothed')},
  {r(f'CASE WHEN y = 1 THEN -5 ELSE 1 END * {GATE} * (1 - {GATE}) / 0.05 * p * (1 - p) + 0.1 * (p - y)', 'captured')}, {r(f'CASE WHEN y = 1 THEN -10 ELSE 1 END * {APPROVE} * (1 - {APPROVE}) / 0.1 * p * (1 - p) + 0.1 * (p - y)', 'profit')},
  {r('greatest(CASE WHEN y = 1 THEN 0.5 * a ELSE 0.08 * a END, 0.1) * (p - y)', 'staked')}, {r('greatest(CASE WHEN y = 1 THEN 0.5 * a ELSE 0.08 * a END, 0.1) * p * (1 - p)', 'staked_hessian')} FROM ({PQ})""")
def loss_gradients(spark, sf):
    d, y, p = probabilities(spark, sf), F.col("y"), F.col("p")
    staked = losses.Weighted(losses.at_stake(y, F.col("l_extendedprice")))
    kinds = {"asymmetric": losses.Asymmetric(0.25, 2.0, 1.0), "smoothed": losses.Smoothed(0.1), "captured": losses.CapturedTop(0.6), "profit": losses.SoftProfit(), "staked": staked}
    return d.select("l_orderkey", "l_linenumber", *[k.gradient(y, p).alias(n) for n, k in kinds.items()], staked.hessian(y, p).alias("staked_hessian"))


SCORES = "round_even(greatest(least(600 + 20 / ln(2) * ln(0.05) - 20 / ln(2) * ln(p / (1 - p)), 900), 300), 2)", "round_even(100 * p, 2)"


@query(" UNION ALL ".join(f"SELECT '{n}' AS transform, {r('avg(s)', 'mean')}, {r('stddev_pop(s)', 'std')}, {r('min(s)', 'min')}, {r('max(s)', 'max')}, {r('corr(s, p)', 'correlation')} FROM (SELECT p, {s} AS s FROM ({PQ}))" for n, s in zip(("standard", "linear"), SCORES)))
def score_transforms_compared(spark, sf):
    return scorecard.compare_transforms(probabilities(spark, sf), "p", {"standard": scorecard.StandardScore(lower=300, upper=900, decimal=2), "linear": scorecard.LinearScore(decimal=2)})


@query()
def alignments_compared(spark, sf):
    return scorecard.compare_alignments(t(spark, sf, "lineitem"), "l_extendedprice", F.col("l_linenumber") <= 3, 20)


@query()
def beta_calibration(spark, sf):
    d = probabilities(spark, sf)
    return d.select("l_orderkey", "l_linenumber", models.beta_calibration(d, "y", "p").alias("calibrated"))


@query()
def permutation_importance(spark, sf):
    d = lineitem(spark, sf)
    return models.permutation_importance(models.RiskModel.fit(d, FEATURES[:2], "y", "tree", maxDepth=3), d, "l_orderkey", repeats=1)
