"""Row numbers in a global order without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialise


def numbered(df: DataFrame, order: list[str | Column], name: str, start: int = 0) -> DataFrame:
    """Add `name`: each row's place in `order`, from `start`.

    Rows are dealt out by ranges of the order and written with their part's number; each part is numbered on its own, from the count
    of the parts before it. Only the counts, one row per part, go through one task.
    """
    ranged = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    ranged = materialise(ranged, "numbered")
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    out = ranged.withColumn("__at", inside).join(F.broadcast(before), "__part")
    return out.withColumn(name, (F.col("__before") + F.col("__at") + (start - 1)).cast("long")).drop("__part", "__at", "__before")
