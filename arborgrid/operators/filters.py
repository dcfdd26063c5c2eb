"""Row filters, thinning, unions and catalogues of clouds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.points import PointFilter, floor_cell
from ..schema import GridSpec
from .ground import heights


def keep(points: DataFrame, spec: PointFilter | None = None) -> DataFrame:
    return points.where((spec or PointFilter()).column())


def elevation_band(points: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    cond: Column = F.lit(True)
    cond = cond if low is None else cond & (F.col("z") >= low)
    return points.where(cond if high is None else cond & (F.col("z") <= high))


def clip_box(points: DataFrame, min_x: float = -1e9, min_y: float = -1e9, max_x: float = 1e9, max_y: float = 1e9) -> DataFrame:
    """All sides inclusive; reaches Parquet scans as a pushed filter."""
    return points.where(F.col("x").between(min_x, max_x) & F.col("y").between(min_y, max_y))


def clip_heights(points: DataFrame, raster: DataFrame, grid: GridSpec, low: float, high: float) -> DataFrame:
    """Points by height above ground, inclusive; where there is no ground z itself counts."""
    return heights(points, raster, grid, keep_missing=True).where(F.col("h").between(low, high)).drop("h")


def thin(points: DataFrame, cell: float, order: str = "ord") -> DataFrame:
    """The first point of each cell by `order`; cells are anchored at 0. One combined aggregation, no sort of the cloud."""
    row = F.struct(*points.columns)
    return points.groupBy(floor_cell(F.col("x"), cell).alias("__c"), floor_cell(F.col("y"), cell).alias("__r")).agg(F.min_by(row, F.col(order)).alias("p")).select("p.*")


def union_clouds(clouds: list[DataFrame]) -> DataFrame:
    """UNION ALL with each cloud's place as file_idx, so that (file_idx, ord) is the order of reading."""
    return reduce(DataFrame.unionByName, [c.withColumn("file_idx", F.lit(k)) for k, c in enumerate(clouds)])


def headers(points: DataFrame) -> DataFrame:
    """One row per file: count and bounds, as a file's header holds them."""
    lows = [F.min(c).alias(f"min_{c}") for c in "xyz"]
    return points.groupBy("file_idx").agg(F.count("*").alias("point_count"), *lows, *[F.max(c).alias(f"max_{c}") for c in "xyz"])


def merged_header(files: DataFrame) -> DataFrame:
    return files.agg(F.sum("point_count").alias("point_count"), *[F.min(f"min_{c}").alias(f"min_{c}") for c in "xyz"], *[F.max(f"max_{c}").alias(f"max_{c}") for c in "xyz"])


def reclassify(points: DataFrame, value: int = 2) -> DataFrame:
    return points.withColumn("classification", F.lit(value).cast(points.schema["classification"].dataType))


def catalog(files: DataFrame) -> DataFrame:
    """One row per file: its count and bounds to two decimals, and name, format and compression where the headers have them."""
    known = {"path": F.regexp_extract("path", r"([^/\\]*)$", 1).alias("file_name"), "point_format": F.col("point_format"), "is_compressed": F.col("is_compressed")}
    return files.select("file_idx", "point_count", *[F.round(f"{s}_{c}", 2).alias(f"{s}_{c}") for s in ("min", "max") for c in "xyz"], *[c for n, c in known.items() if n in files.columns])
