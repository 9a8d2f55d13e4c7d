"""Dense numbers for ordered values without a global window: values are dealt to ranges, each
range counts its own, and the counts before a range are its offset."""
from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import keep


def dense_numbers(df: DataFrame, column: str, number: str = "number") -> DataFrame:
    """(column, number): the distinct values of ``column`` numbered from 0 in ascending order,
    strings by code point, null last. Only the counts per range reach the driver."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(column).isNull(), F.col(column)]
    ranged = keep(df.select(column).distinct().repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    counts = {r["_range"]: r["count"] for r in ranged.groupBy("_range").count().collect()}
    before = dict(zip(sorted(counts), accumulate([0, *(counts[k] for k in sorted(counts))])))
    offsets = spark.createDataFrame(list(before.items()), "_range int, _before long")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_place", place).join(F.broadcast(offsets), "_range") \
        .select(column, (F.col("_before") + F.col("_place") - 1).cast("long").alias(number))
