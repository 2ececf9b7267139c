import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from gridframe.session import get_spark

    return get_spark("local[4]", 8)


@pytest.fixture()
def sheet_of(spark):
    """Build a Sheet from literal rows (list of tuples) and a DDL schema."""
    from pyspark.sql import functions as F

    from gridframe.sheet import Sheet

    def make(rows, schema):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "__k long, " + schema)
        return Sheet(Sheet.from_df(df, [F.col("__k")]).df.drop("__k"))

    return make


SF = "/root/testdata/sf0.001"
