import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from threadloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", "tests", spark__sql__shuffle__partitions="4")
    yield session
    session.stop()


@pytest.fixture
def messages(spark):
    """Build a message table from (conv_id, msg_id, role, ts, text[, parent_id]) rows."""
    def build(rows):
        full = [tuple(r) + (None,) * (6 - len(r)) for r in rows]
        table = spark.createDataFrame(
            full, "conv_id string, msg_id string, role string, ts string, text string, parent_id string")
        return table.withColumn("ts", table.ts.cast("timestamp"))

    return build


def column(spark, values, expression, kind="string"):
    """Evaluate a Column function over a list of values, in order."""
    table = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    from pyspark.sql import functions as F
    return [r.out for r in table.select("i", expression(F.col("v")).alias("out")).orderBy("i").collect()]
