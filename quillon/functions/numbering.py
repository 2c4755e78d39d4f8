"""Numbers for rows in a total order, by a distributed sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_folder


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds `name`: the row's number from 0 in the order of the columns.

    Rows are sorted by ranges and written once; a row's number is its place in its range and the sizes of the ranges
    before, of which there is one for each shuffle partition.
    """
    checkpoint_folder(df.sparkSession)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()).checkpoint()
    dealt = place.withColumn("_range", F.shiftright("_place", 33)).withColumn("_own", F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))).drop("_place")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("_range", before.alias("_before")))  # a row for each range
    return dealt.join(starts, "_range").withColumn(name, F.col("_own") + F.col("_before")).drop("_range", "_own", "_before")
