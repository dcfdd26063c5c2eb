"""Aggregations of points by grid cell, and of whole clouds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.points import Sentinels, grid_col, grid_row, inside, return_bucket, stratum
from ..functions.stats import FIELDS, bundle_from_counts, profile_area, with_bundle
from ..schema import GridSpec
from . import stencil
from .experimental import NAMES as EXPERIMENTAL
from .experimental import experimental_metrics


def with_cell(points: DataFrame, grid: GridSpec) -> DataFrame:
    """Add row and col; points outside the grid go."""
    return points.withColumn("col", grid_col(grid)).withColumn("row", grid_row(grid)).where(inside(grid))


def dense(cells: DataFrame, grid: GridSpec) -> DataFrame:
    """All cells of the grid; those without a row have nulls."""
    return grid.cells(cells.sparkSession).join(cells, ["row", "col"], "left")


@dataclass(frozen=True)
class Metrics:
    """Options of grid_metrics and cloud_metrics."""

    minht: float = 0.0
    heightcut: float | None = None
    outliers: tuple[float, float] | None = None
    first: bool = False
    intensity: bool = True
    channels: tuple[str, ...] = ()
    strata: tuple[float, ...] = ()
    intensity_strata: tuple[float, ...] = ()
    channel_strata: bool = False
    #: Of which of a cell's elevations ("max" or "mean") the bands surf_area_ratio and surf_roughness are; None: no such bands.
    surface: str | None = None
    #: Whether the experimental metrics follow, with cells and voxels of these sizes.
    experimental: bool = False
    cell: float = 10.0
    voxel: float = 20.0

    @property
    def cut(self) -> float:
        return self.minht if self.heightcut is None else self.heightcut

    def kept(self) -> Column:
        """Points inside the outlier limits. All points count towards the totals, so this is never a filter."""
        return F.lit(True) if self.outliers is None else F.col("h").between(*self.outliers)


def _mean_sd(value: Column, on: Column, name: str) -> list[Column]:
    v = F.when(on, value)
    return [F.avg(v).alias(f"{name}mean"), F.stddev_pop(v).alias(f"{name}stddev"), F.min(v).alias(f"{name}min"), F.max(v).alias(f"{name}max")]


def strata_aggregates(o: Metrics, cell_area: float | None = None) -> list[Column]:
    """Count, share, mean, sd, min and max of each height stratum; of intensity and channels where asked for."""
    out: list[Column] = []
    kept, total = o.kept(), F.count("*")
    for prefix, bounds, values in (("", o.strata, {"": F.col("h")}), ("int_", o.intensity_strata or (o.strata if o.intensity else ()), {"": F.col("intensity").cast("double")})):
        for k in range(len(bounds) + 1 if bounds else 0):
            on = kept & (stratum(F.col("h"), list(bounds)) == k)
            name = f"{prefix}strata{k + 1:02d}_"
            out += [F.count_if(on).alias(f"{name}count"), (F.count_if(on) / total).alias(f"{name}proportion")]
            if not prefix and cell_area:
                out.append((F.count_if(on) / F.lit(cell_area)).alias(f"{name}density"))
            out += _mean_sd(values[""], on, name)
    if o.channel_strata and o.strata:
        for c in o.channels:
            for k in range(len(o.strata) + 1):
                out += _mean_sd(F.col(c).cast("double"), kept & (stratum(F.col("h"), list(o.strata)) == k), f"{c}_strata{k + 1:02d}_")
    return out


def count_aggregates(o: Metrics) -> list[Column]:
    return [
        F.count("*").alias("total_returns"),
        F.count_if(F.col("return_number") == 1).alias("first_returns"),
        F.count_if(o.kept() & (F.col("h") >= o.cut)).alias("above_cut"),
        F.count_if(o.kept() & (F.col("h") >= o.cut) & (F.col("return_number") == 1)).alias("first_above_cut"),
        *[F.count_if(return_bucket(F.col("return_number")) == k).alias(f"r{k + 1}count") for k in range(9)],
    ]


def grid_metrics(points: DataFrame, grid: GridSpec, o: Metrics | None = None) -> DataFrame:
    """Every metric of every non-empty cell, in one shuffle on (row, col). points needs h.

    Values of points at or above minht form the elevation, intensity and channel bundles; strata are not gated by minht;
    totals count outliers too. first: only first returns take part.
    """
    o = o or Metrics()
    p = with_cell(points.where("return_number = 1") if o.first else points, grid)
    high = o.kept() & (F.col("h") >= o.minht)
    gathered = [F.collect_list(F.when(high, F.col("h"))).alias("__elev_")]
    if o.intensity:
        gathered.append(F.collect_list(F.when(high, F.col("intensity").cast("double"))).alias("__int_"))
    gathered += [F.collect_list(F.when(high, F.col(c).cast("double"))).alias(f"__{c}_") for c in o.channels]
    g = p.groupBy("row", "col").agg(*count_aggregates(o), *strata_aggregates(o, grid.cell**2), *gathered)
    g = g.withColumn("__h", F.col("__elev_"))
    for prefix in ["elev_", *(["int_"] if o.intensity else []), *[f"{c}_" for c in o.channels]]:
        g = with_bundle(g, f"__{prefix}", prefix)
    g = g.withColumn("elev_profile_area", profile_area())
    over = lambda a, level: F.size(F.filter(a, lambda x: x > F.col(level)))
    first = F.when(F.col("first_returns") > 0, F.col("first_returns"))
    g = g.withColumns(
        {
            "canopy_cover": 100.0 * F.col("above_cut") / (first if o.first else F.col("total_returns")),
            "point_density": F.col("total_returns") / grid.cell**2,
            "allcover": 100.0 * F.col("above_cut") / F.col("total_returns"),
            "afcover": 100.0 * F.col("above_cut") / first,
            "allabovemean": 100.0 * over("__h", "elev_mean") / F.col("total_returns"),
            "allabovemode": 100.0 * over("__h", "elev_mode") / F.col("total_returns"),
            "afabovemean": 100.0 * over("__h", "elev_mean") / first,
            "afabovemode": 100.0 * over("__h", "elev_mode") / first,
        }
    )
    g = g.drop("__h")
    if o.surface:
        top = g.select("row", "col", F.col(f"elev_{o.surface}").alias("value"))
        surf = stencil.surface_stats(top, grid.cell).select("row", "col", F.col("area_ratio").alias("surf_area_ratio"), F.col("roughness").alias("surf_roughness"))
        g = g.join(surf, ["row", "col"], "left")
    if o.experimental:
        high = p.select("row", "col", "x", "y", F.col("h").alias("z"))
        e = experimental_metrics(high, o.minht, o.cell, o.voxel, ["row", "col"])
        g = g.join(e.select("row", "col", *[F.col(n).alias(f"exp_{n}") for n in EXPERIMENTAL]), ["row", "col"], "left")
    return g


def apply_sentinels(cells: DataFrame, s: Sentinels, skip: tuple[str, ...] = ("row", "col")) -> DataFrame:
    """The two levels of missing values, once, at the end: nodata where a cell has no return at all, noheight where it has
    returns but none that gives a value. Shares of first returns stay nodata in cells without any."""
    empty = F.col("total_returns").isNull() | (F.col("total_returns") == 0)
    nodata, noheight = (F.lit(v).cast("double") for v in (s.nodata, s.noheight))
    out = []
    for c in cells.columns:
        if c in skip:
            out.append(F.col(c))
        elif c in ("afcover", "afabovemean", "afabovemode") or c.startswith("surf_"):
            out.append(F.coalesce(F.col(c).cast("double"), nodata).alias(c))
        else:
            out.append(F.when(empty, nodata).otherwise(F.coalesce(F.col(c).cast("double"), noheight)).alias(c))
    return cells.select(*out)


def density_counts(points: DataFrame, grid: GridSpec, strata: list[float]) -> DataFrame:
    """Points of each stratum, of non-empty cells: what the density tables hold."""
    k = stratum(F.col("h"), strata)
    return with_cell(points, grid).groupBy("row", "col").agg(*[F.count_if(k == i).alias(f"stratum{i + 1:02d}_count") for i in range(len(strata) + 1)])


def density_metrics(points: DataFrame, grid: GridSpec, strata: list[float]) -> DataFrame:
    """Points per area of each stratum, of non-empty cells: what the density rasters hold."""
    n = density_counts(points, grid, strata)
    return n.select("row", "col", *[(F.col(f"stratum{i + 1:02d}_count") / grid.cell**2).alias(f"density{i + 1:02d}") for i in range(len(strata) + 1)])


def return_density(points: DataFrame, grid: GridSpec) -> DataFrame:
    """Returns per area and the share of first returns of every cell; empty cells are 0."""
    g = with_cell(points, grid).groupBy("row", "col").agg((F.count("*") / grid.cell**2).alias("density"), (100.0 * F.count_if(F.col("return_number") == 1) / F.count("*")).alias("first_pct"))
    return dense(g, grid).fillna(0.0, ["density", "first_pct"])


def point_count(points: DataFrame, grid: GridSpec) -> DataFrame:
    """All points of every cell, unfiltered; empty cells are 0."""
    return dense(with_cell(points, grid).groupBy("row", "col").agg(F.count("*").alias("n")), grid).fillna(0, ["n"])


def canopy_model(points: DataFrame, grid: GridSpec) -> DataFrame:
    """The largest height of each non-empty cell, as a raster."""
    return with_cell(points, grid).groupBy("row", "col").agg(F.max("h").alias("value"))


def cloud_metrics(points: DataFrame, keys: list[str] | None = None, o: Metrics | None = None, grid: GridSpec | None = None) -> DataFrame:
    """One row per keys (or one for the cloud) with counts, cover, strata and bundles; groups may be of any size.

    Every part is an aggregation that combines before its shuffle; parts of the bundle meet by key. With a grid and without
    keys, o.surface adds the summary of the top surface on it, of all points.
    """
    o, keys = o or Metrics(), keys or []
    high = o.kept() & (F.col("h") >= o.minht)
    cover = 100.0 * F.count_if(o.kept() & (F.col("h") >= o.cut)) / F.count("*")
    base = points.groupBy(*keys).agg(F.count("*").alias("total_points"), F.count_if(high).alias("canopy_points"), F.when(F.count("*") > 0, cover).alias("canopy_cover_pct"), *strata_aggregates(o))
    for prefix, value in [("elev_", "h"), *([("int_", "intensity")] if o.intensity else []), *[(f"{c}_", c) for c in o.channels]]:
        b = bundle_from_counts(points.where(high), keys, value, prefix)
        base = base.join(b, keys, "left") if keys else base.join(F.broadcast(b), F.lit(True), "left")  # one row
    if o.surface and grid and not keys:
        surf = stencil.surface_summary(stencil.surface_stats(canopy_model(points, grid), grid.cell), grid.cell)
        base = base.join(F.broadcast(surf.select(*[F.col(c).alias(f"surf_{c}") for c in surf.columns])), F.lit(True), "left")  # one row
    if o.experimental:
        e = experimental_metrics(points.drop("z").withColumnRenamed("h", "z"), o.minht, o.cell, o.voxel, keys)
        e = e.select(*keys, *[F.col(n).alias(f"exp_{n}") for n in EXPERIMENTAL])
        base = base.join(e, keys, "left") if keys else base.join(F.broadcast(e), F.lit(True), "left")  # one row
    return base.withColumn("elev_profile_area", profile_area())


__all__ = ["FIELDS", "Metrics", "apply_sentinels", "canopy_model", "cloud_metrics", "dense", "density_counts", "density_metrics", "grid_metrics", "point_count", "return_density", "with_cell"]
