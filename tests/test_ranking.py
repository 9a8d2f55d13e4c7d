"""Dense numbers by ranges."""
import random

from parley.operators.ranking import dense_numbers


def test_numbers_follow_code_points_with_null_last(spark):
    rnd = random.Random(1)
    values = ["b", "B", "é", "日", "", "a", None, "\U0001f600", "ﬁ"] + [f"v{rnd.randrange(10**6)}" for _ in range(500)]
    rows = [(v,) for v in values * 3]
    rnd.shuffle(rows)
    got = {r["v"]: r["number"] for r in dense_numbers(spark.createDataFrame(rows, "v string").repartition(5), "v").collect()}
    want = sorted({v for v in values if v is not None}, key=lambda v: v.encode()) + [None]
    assert got == {v: i for i, v in enumerate(want)}
    assert dense_numbers(spark.createDataFrame([], "v string"), "v").count() == 0
