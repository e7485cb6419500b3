"""Statistics from counted values, against SQL and against the plain scans."""

import duckdb
import pytest
from pyspark.sql import functions as F

from riskloom.operators import binning, eda, metrics, models, ranks, scorecard, search, selectors
from riskloom.plans import catalogue


@pytest.fixture(scope="module")
def noise(spark, tmp_path_factory):
    """A lineitem whose features say almost nothing: IVs that differ, but not in six digits."""
    d = tmp_path_factory.mktemp("noise")
    n = 60_000
    df = spark.range(n).select(
        F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.when(F.col("id") % 3 == 0, "R").otherwise("N").alias("l_returnflag"), F.when(F.col("id").isin(3, 6, 9), 0.0).otherwise(((F.col("id") * 7) % 50).cast("double")).alias("l_quantity"),
        ((F.col("id") * 11) % 1000).cast("double").alias("l_extendedprice"), ((F.col("id") % 10) / 100).alias("l_discount"), F.when(F.col("id") < 600, (F.col("id") % 9) / 100.0).otherwise((F.col("id") % 8) / 100.0).alias("l_tax"),
    )
    df.write.parquet(f"{d}/lineitem.parquet")
    return str(d)


def test_ranks_of_equal_rounded_ivs_are_shared_as_in_sql(spark, noise):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{noise}/lineitem.parquet/*.parquet'")
    want = sorted(c.execute(catalogue.ORACLES["importance_ranking"]).fetchall())
    assert len({r[1] for r in want}) < len(want)  # the case at hand
    assert sorted(map(tuple, catalogue.QUERIES["importance_ranking"](spark, noise).collect())) == want
    exact = eda.importance_ranking(catalogue.lineitem(spark, noise), catalogue.FEATURES, "y", digits=15)
    assert {r["feature"]: r["rank"] for r in exact.collect()} != {r[0]: r[3] for r in want}  # what unrounded IVs give
    for name in ("leakage_check", "feature_efficiency"):
        assert sorted(map(tuple, catalogue.QUERIES[name](spark, noise).collect())) == sorted(c.execute(catalogue.ORACLES[name]).fetchall())


def _odd(spark):
    rows = [(k, None if k % 11 == 0 else float("nan") if k % 13 == 0 else -999.0 if k % 17 == 0 else float((k * k) % 97), k % 40, None if k % 19 == 0 else int(k % 3 == 0)) for k in range(3000)]
    return spark.createDataFrame(rows, "k long, a double, b int, y int")


def test_counted_edges_histograms_and_bins_equal_those_of_rows(spark):
    df, probs = _odd(spark), [0.0, 0.1, 0.25, 0.5, 0.9]
    with binning.Counts(df, ["a", "b"], "y") as counted:
        for special in (None, [-999.0]):
            assert counted.edges(["a", "b"], probs, special) == binning.all_edges(df, ["a", "b"], probs, special)
            for method in ("quantile", "cart"):
                assert binning.fit_many(df, ["a", "b"], "y", method=method, special=special, counted=counted) == binning.fit_many(df, ["a", "b"], "y", method=method, special=special)
    assert ranks.percentiles(df.select(F.col("b").cast("double").alias("x"), F.lit(3).alias("w")), [], [1.0], "w").first()["n"] == 9000


def _watched(spark):
    """A table and a counter of the rows read of it."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def look(x):
        seen.add(1)
        return float(x)

    return _odd(spark).select("k", "y", look.asNondeterministic()("b").alias("b")), seen


def test_features_are_counted_in_one_scan(spark):
    df, seen = _watched(spark)
    eda.leakage(df, ["b"], "y", least=1)
    assert seen.value <= 2 * 3000


def test_methods_share_one_scan(spark):
    df, seen = _watched(spark)
    _, rows = binning.auto_select(df, "b", "y")
    assert seen.value <= 2 * 3000
    plain = _odd(spark).withColumn("b", F.col("b").cast("double"))
    for r in rows:
        m = binning.fit_binning(plain, "b", "y", method=r["method"])
        h = binning.histogram(plain, "b", "y", m.splits)
        assert (r["n_bins"], r["iv"], r["ks"]) == (m.n_bins, search.iv(h.n, h.bad), search.ks(h.n, h.bad))


def test_stages_share_one_scan(spark):
    df, seen = _watched(spark)
    _, steps = selectors.staged(df, ["b"], "y", iv_threshold=0.0)
    assert seen.value <= 2 * 3000
    assert steps[1].scores["b"] == pytest.approx(75 / 3000)
    plain = selectors.by_iv(_odd(spark).withColumn("b", F.col("b").cast("string")), ["b"], "y", 0.0)
    assert steps[2].scores["b"] == pytest.approx(plain.scores["b"])


def test_values_that_doubles_cannot_tell_apart_stay_apart(spark):
    df = spark.createDataFrame([(2**53, "a", 1.5), (2**53 + 1, "a", float("nan")), (2**53 + 1, None, None)], "i long, s string, d double")
    shares = {r["feature"]: r["share"] for r in selectors.mode_shares(df, ["i", "s", "d"]).collect()}
    assert shares == {"i": pytest.approx(2 / 3), "s": 1.0, "d": 0.5}
    values = selectors.value_counts(df, ["i", "s", "d"])
    assert selectors.by_missing(df, ["i", "s", "d"], values=values).scores == selectors.by_missing(df, ["i", "s", "d"]).scores


def test_permuted_values_are_dealt_once_and_repeatably(spark):
    df = spark.range(2000).select((F.col("id") % 700).alias("k"), F.col("id").alias("v"), F.lit("wide").alias("s"))
    once = {r["v"]: r["w"] for r in selectors._permuted(df, ["v"], ["w"], "k", 5).collect()}
    again = {r["v"]: r["w"] for r in selectors._permuted(df.repartition(7), ["v"], ["w"], "k", 5).collect()}
    assert once == again and sorted(once.values()) == list(range(2000)) and sum(a == b for a, b in once.items()) < 300
    assert selectors.blocks_of(1000) == 64 and selectors.blocks_of(216_000_000) == 432


def test_scores_are_found_once_for_an_evaluation(spark):
    df, seen = _watched(spark)
    row = metrics.ks_auc_row(df, "y", "b")
    assert seen.value <= 3000 and row == metrics.ks_auc(_odd(spark), "y", "b").first()


def test_box_cox_reads_once(spark):
    df, seen = _watched(spark)
    scorecard.BoxCoxScore().fit(df.withColumn("p", F.col("b") / 50 + 0.01), "p")
    assert seen.value <= 3000


def test_tree_fits_hold_few_rows_a_partition(spark):
    df = spark.range(1000).repartition(2)
    assert models.spread(df, 100).rdd.getNumPartitions() == 10 and models.spread(df, 600).rdd.getNumPartitions() == 2


def test_scorecard_reads_little_and_keeps_the_median(spark):
    df, seen = _watched(spark)
    card = scorecard.ScoreCard.fit(df, ["b"], "y", method="quantile")
    assert seen.value <= 3 * 3000
    plain = _odd(spark).withColumn("b", F.col("b").cast("double"))
    assert card.baseline["b"] == pytest.approx(plain.agg(F.percentile_approx(card.points_column("b"), 0.5, 10_000)).first()[0])
    coded = plain.select("y", card.models["b"].value(card.woe["b"]).alias("b"))
    fit = models.logistic(coded, ["b"], "y")
    assert (fit.intercept, fit.coefficients[0]) == pytest.approx((card.intercept, card.coefficients["b"]), abs=1e-5)
