import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    return (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )


#: Texts that every operator must take: null, empty, blank, one word, ties, repeats, long words, many scripts.
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "word"), (5, "word"), (6, "x" * 5000), (7, "ab " * 900), (8, "日本語 テキスト 😀 café Ünïcode x"),
    (9, "The quick brown fox jumps over the lazy dog near the river bank at noon, then it sleeps under a tree until the evening comes."),
    (10, "The quick brown fox jumps over the lazy dog near the river bank at noon, then it sleeps under a tree until the evening comes."),
    (11, "PREFIX the quick brown fox jumps over the lazy dog near the river bank at noon, then it sleeps under a tree until the evening ends."),
    (12, "a\x00b\x1fc\x0bd"), (None, "null id the quick brown fox jumps over the lazy dog near the river bank at noon, then it sleeps under a tree"), (9, "second row of id nine"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows with extra columns whose names clash with internal ones."""
    rows = [(i, t, "en" if i else None, None, 0, "p", -1, b"m") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, pack string, ids int, media binary")
