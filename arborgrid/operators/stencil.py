"""Neighbourhood operators on rasters (row, col, value); a null value or an absent row is nodata."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbering import numbered
from ..schema import GridSpec


def smooth(raster: DataFrame, window: int) -> DataFrame:
    """Mean of the valid cells in a window; even windows grow by one; nodata stays. Two one-dimensional passes."""
    if window < 3:
        return raster
    half = (window + 1 if window % 2 == 0 else window) // 2
    valid = raster.where("value is not null")
    # cells that have no value may still carry sums from their row, which columns need: spread each row first
    spread = valid.select("row", F.explode(F.expr(f"sequence(col - {half}, col + {half})")).alias("col"), "value")
    rows = spread.groupBy("row", "col").agg(F.sum("value").alias("s"), F.count("*").alias("n"))
    # only cells that are valid themselves get a result
    by_col = Window.partitionBy("col").orderBy("row").rangeBetween(-half, half)
    both = rows.join(valid.select("row", "col", F.lit(True).alias("own")), ["row", "col"], "left")
    out = both.withColumn("value", F.sum("s").over(by_col) / F.sum("n").over(by_col)).where("own")
    return out.select("row", "col", "value")


def neighbours(raster: DataFrame) -> DataFrame:
    """Valid cells with z1..z9, row by row from the upper left; null where there is no neighbour.

    Each cell is sent to its 8 neighbours and combined by one aggregation on the cell: no window over whole rows.
    """
    v = raster.where("value is not null").select("row", "col", "value")
    offsets = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), F.lit(k + 1).alias("k")) for k, (dr, dc) in enumerate((r, c) for r in (1, 0, -1) for c in (1, 0, -1))])
    sent = v.withColumn("o", F.explode(offsets)).select((F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col"), F.col("o.k").alias("k"), "value")
    return sent.groupBy("row", "col").agg(*[F.max(F.when(F.col("k") == k, F.col("value"))).alias(f"z{k}") for k in range(1, 10)]).where("z5 is not null")


def _horn(z: list[Column], cell: float) -> tuple[Column, Column]:
    z1, z2, z3, z4, _, z6, z7, z8, z9 = z
    return ((z3 + 2 * z6 + z9) - (z1 + 2 * z4 + z7)) / (8.0 * cell), ((z7 + 2 * z8 + z9) - (z1 + 2 * z2 + z3)) / (8.0 * cell)


def slope_aspect(raster: DataFrame, cell: float) -> DataFrame:
    """Slope and compass aspect in degrees, of cells with all eight neighbours. Flat cells have aspect 270."""
    n = neighbours(raster)
    dx, dy = _horn([F.col(f"z{k}") for k in range(1, 10)], cell)
    n = n.withColumns({"dx": dx, "dy": dy}).where("dx is not null and dy is not null and z1 + z2 + z3 + z4 + z6 + z7 + z8 + z9 is not null")
    turned = (450.0 - F.degrees(F.atan2(F.col("dy"), -F.col("dx")))) % 360.0
    # the fixed value of a flat cell: IEEE atan2(0, -0) is pi, which Spark's normalised zero does not give
    aspect = F.when((F.col("dx") == 0) & (F.col("dy") == 0), 270.0).otherwise(turned)
    return n.select("row", "col", F.degrees(F.atan(F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2))).alias("slope"), aspect.alias("aspect"))


def same_shape(grid: GridSpec, reference: GridSpec) -> None:
    if (grid.cols, grid.rows) != (reference.cols, reference.rows):
        raise ValueError(f"the reference has {reference.cols} x {reference.rows} cells, the surface {grid.cols} x {grid.rows}")


def surface_stats(raster: DataFrame, cell: float, reference: DataFrame | None = None) -> DataFrame:
    """Surface area ratio, roughness and, against a reference raster of the same shape (see same_shape), volume of every
    valid cell; missing neighbours count as the cell itself."""
    n = neighbours(raster)
    z = [F.coalesce(f"z{k}", "z5") for k in range(1, 10)]
    dx, dy = _horn(z, cell)
    mean = sum(z[1:], z[0]) / 9.0
    n = n.withColumns({"dx": dx, "dy": dy, "m": mean})
    spread = sum([(v - F.col("m")) ** 2 for v in z[1:]], (z[0] - F.col("m")) ** 2)
    out = n.select("row", "col", "z5", (1.0 / F.cos(F.atan(F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2)))).alias("area_ratio"), F.sqrt(spread / 9.0).alias("roughness"))
    if reference is None:
        return out.drop("z5")
    ref = reference.select("row", "col", F.col("value").alias("ref"))
    return out.join(ref, ["row", "col"], "left").select("row", "col", "area_ratio", "roughness", ((F.col("z5") - F.col("ref")) * cell**2).alias("volume"))


def surface_summary(stats: DataFrame, cell: float) -> DataFrame:
    area = cell**2
    return stats.agg(
        (F.count("*") * area).alias("planimetric_area"),
        F.sum(F.coalesce("area_ratio", F.lit(1.0)) * area).alias("surface_area_3d"),
        F.coalesce(F.avg("area_ratio"), F.lit(0.0)).alias("area_ratio_mean"),
        F.coalesce(F.avg("roughness"), F.lit(0.0)).alias("roughness_mean"),
        *([F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume_total")] if "volume" in stats.columns else []),
    )


def window_radius(h: Column, a: float, b: float, cell: float) -> Column:
    """Cells to look at on each side of a pixel of this height."""
    return F.greatest(F.lit(1), F.round((a + b * h) / cell).cast("int"))


def highest(chm: DataFrame, cell: float, minht: float, a: float, b: float) -> DataFrame:
    """Pixels of at least minht that are higher than every other in a square window that grows with their height.

    A first pass with 3 x 3 neighbours drops almost all pixels; only those left look farther. Columns row, col, h.
    """
    v = chm.where("value is not null")
    near = neighbours(v)
    ring = F.greatest(*[F.coalesce(f"z{k}", F.lit(-math.inf)) for k in (1, 2, 3, 4, 6, 7, 8, 9)])
    seeds = near.where((F.col("z5") >= minht) & (F.col("z5") > ring)).select("row", "col", F.col("z5").alias("h"))
    seeds = seeds.withColumn("r", window_radius(F.col("h"), a, b, cell))
    far = seeds.where("r > 1").withColumn("nr", F.explode(F.expr("sequence(row - r, row + r)"))).withColumn("nc", F.explode(F.expr("sequence(col - r, col + r)")))
    other = v.select(F.col("row").alias("nr"), F.col("col").alias("nc"), "value")
    beaten = far.join(other, ["nr", "nc"]).where("value >= h and (nr <> row or nc <> col)").select("row", "col").distinct()
    return seeds.join(beaten, ["row", "col"], "left_anti").select("row", "col", "h")


def tree_tops(chm: DataFrame, grid: GridSpec, minht: float, a: float, b: float) -> DataFrame:
    """The pixels that highest() finds, as trees. Ids count in row-major order."""
    tops = numbered(highest(chm, grid.cell, minht, a, b), ["row", "col"], "tree_id", 1)
    crown = (2.0 * (a + b * F.col("h"))).alias("crown_diameter")
    return tops.select(F.col("tree_id").cast("int").alias("tree_id"), "row", "col", grid.centre_x(F.col("col")).alias("x"), grid.centre_y(F.col("row")).alias("y"), F.col("h").alias("height"), crown)


def crop(raster: DataFrame, row0: int, row1: int, col0: int, col1: int) -> DataFrame:
    return raster.where(F.col("row").between(row0, row1) & F.col("col").between(col0, col1))
