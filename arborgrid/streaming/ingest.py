"""Cell counts and extremes kept up to date from a directory of arriving point files: an extension of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.points import PointFilter
from ..operators.grid import with_cell
from ..schema import GridSpec


def cell_totals(stream: DataFrame, grid: GridSpec, spec: PointFilter | None = None) -> DataFrame:
    """Per cell: returns, first returns, lowest, highest and mean z. The state is one row per cell of the fixed grid."""
    p = with_cell(stream.where((spec or PointFilter()).column()), grid)
    return p.groupBy("row", "col").agg(F.count("*").alias("total_returns"), F.count_if(F.col("return_number") == 1).alias("first_returns"), F.min("z").alias("z_min"), F.max("z").alias("z_max"), F.avg("z").alias("z_mean"))


def follow(spark: SparkSession, folder: str, schema, grid: GridSpec, name: str, checkpoint: str) -> StreamingQuery:
    """Read new Parquet files of a folder once each and keep the totals in a table in memory, until all present are read."""
    stream = spark.readStream.schema(schema).parquet(folder)
    out = cell_totals(stream, grid).writeStream.outputMode("complete").format("memory").queryName(name)
    return out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
