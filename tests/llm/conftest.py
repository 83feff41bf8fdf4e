import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "3g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, an unknown id, and columns with clashing names."""
    rows = [
        (1, "alpha beta gamma delta epsilon zeta", "en", "s", 35),
        (1, "alpha beta gamma delta epsilon zeta", "en", "s", 35),
        (2, None, None, None, None),
        (3, "", "en", "s", 0),
        (4, "  \n\t ", "en", "s", 5),
        (5, "one", "fr", "s", 3),
        (6, "one", "fr", "s", 3),
        (None, "one", "fr", "s", 3),
        (None, None, None, None, None),
        (7, "wörter über Straßen " * 20000, "de", "t", 400000),
        (8, "\U0001f600 é▁x\u0000 \\ </s>", "es", "t", 9),
    ]
    frame = spark.createDataFrame(rows, DOCS)
    clashing = ("signature", "shard", "slot", "matches", "overlaps", "score", "bucket", "key", "_found", "text_score", "kept", "component_id")
    for name in clashing:
        frame = frame.selectExpr("*", f"'clash' AS `{name}`")
    return frame


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
