import os
import sys

import pytest

from cases import ODD_TEXTS

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    os.environ["PYTHONPATH"] = ROOT
    from pyspark.sql import SparkSession

    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Such rows in a table with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", 7, 0.5, "x", 1, 2, 0.1, "h") for i, t in ODD_TEXTS], "doc_id long, text string, lang string, n_words int, score double, spans string, __fp long, __row long, __score double, __hits string")
