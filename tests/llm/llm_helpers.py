"""Fixture and helper shared by the tests of this folder."""
import pytest
from pyspark.sql import functions as F

#: Names that operators use inside, as columns of the input.
CLASH = ("rk", "chunk", "name", "part", "kind", "n", "bucket", "_parley_row", "_parley_gone", "_parley_noise", "spans")


@pytest.fixture(scope="session")
def frame(spark):
    def make(rows):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        for c in CLASH:
            df = df.withColumn(c, F.lit("x"))
        return df.select(*CLASH[:3], "text", *CLASH[3:], "doc_id").repartition(3)
    return make


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)
