"""Awkward documents that every operator must take."""

import pytest
from awkward_rows import AWKWARD
from pyspark.sql import functions as F

CLASHING = ["toxicity", "row", "doc", "base", "added", "fp", "cls", "size", "band", "tile", "key", "runs", "_id"]


@pytest.fixture(scope="session")
def awkward(spark):
    df = spark.createDataFrame(AWKWARD, "doc_id long, text string").repartition(3)
    return df.withColumns({c: F.lit("x") for c in [*CLASHING, "lang", "a.b"]})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, n_chars long")
