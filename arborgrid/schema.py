"""Schemas of the relations and the geometry of grids."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {"int": T.IntegerType, "long": T.LongType, "double": T.DoubleType, "smallint": T.ShortType, "boolean": T.BooleanType, "string": T.StringType}


def _struct(text: str) -> T.StructType:
    """'name type, ...' to a struct, without a session."""
    return T.StructType([T.StructField(n, _KINDS[t]()) for n, t in (x.split() for x in text.split(","))])


POINT = _struct(
    "file_idx int, pt_idx long, x double, y double, z double, intensity int, return_number smallint, number_of_returns smallint, "
    "classification smallint, scan_angle smallint, point_source_id int, gps_time double, red int, green int, blue int, nir int, "
    "withheld boolean, keypoint boolean, synthetic boolean, overlap boolean, scanner_channel smallint"
)
FILES = _struct(
    "file_idx int, path string, point_count long, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double, "
    "version string, point_format smallint, is_compressed boolean, wkt string"
)
_RING = T.StructType([T.StructField("poly", T.IntegerType()), T.StructField("xs", T.ArrayType(T.DoubleType())), T.StructField("ys", T.ArrayType(T.DoubleType()))])
FEATURE = _struct("feature_idx int, label string, min_x double, min_y double, max_x double, max_y double").add("rings", T.ArrayType(_RING))


@dataclass(frozen=True)
class GridSpec:
    """A grid anchored at its upper left corner; rows count down from max_y."""

    min_x: float
    max_y: float
    cell: float
    cols: int
    rows: int

    @staticmethod
    def over(min_x: float, min_y: float, max_x: float, max_y: float, cell: float) -> GridSpec:
        return GridSpec(min_x, max_y, cell, max(1, math.ceil((max_x - min_x) / cell)), max(1, math.ceil((max_y - min_y) / cell)))

    @staticmethod
    def of(points: DataFrame, cell: float) -> GridSpec:
        """The grid over a cloud's extent; one row of minima and maxima comes to the driver."""
        r = points.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
        return GridSpec.over(*(float(v or 0.0) for v in r), cell)

    @property
    def max_x(self) -> float:
        return self.min_x + self.cols * self.cell

    @property
    def min_y(self) -> float:
        return self.max_y - self.rows * self.cell

    def centre_x(self, col: Column) -> Column:
        return self.min_x + (col + 0.5) * self.cell

    def centre_y(self, row: Column) -> Column:
        return self.max_y - (row + 0.5) * self.cell

    def cells(self, spark) -> DataFrame:
        """Every cell, row by row, dealt out over partitions."""
        n = spark.range(0, self.rows * self.cols)
        return n.select(F.expr(f"cast(id div {self.cols} as int)").alias("row"), F.expr(f"cast(id % {self.cols} as int)").alias("col"))
