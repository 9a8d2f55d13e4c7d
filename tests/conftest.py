import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from parley.session import get_session
    scratch = tempfile.mkdtemp(prefix="parley-test-")
    s = get_session(master="local[4]", shuffle_partitions=8, app_name="parley-tests",
                    extra={"spark.checkpoint.dir": os.path.join(scratch, "ckpt"),
                           "spark.sql.warehouse.dir": os.path.join(scratch, "wh")})
    s.sparkContext.setCheckpointDir(os.path.join(scratch, "ckpt"))
    yield s


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="parley-run-")


def eval1(spark, col, **cols):
    """Evaluate a Column expression over one row of string inputs."""
    from pyspark.sql import functions as F
    names = list(cols) or ["t"]
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{n} string" for n in names))
    return df.select(col.alias("out")).first()["out"]


def evalmany(spark, fn, texts):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", fn(F.col("t")).alias("out")).orderBy("i").collect()
    return [r["out"] for r in rows]
