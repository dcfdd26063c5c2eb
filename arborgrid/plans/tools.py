"""The command-line tools as functions: a tool's arguments in, its rasters, tables and points as DataFrames out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.points import KrausPfeifer, PointFilter, Sentinels, channels
from ..operators import crowns, filters, grid, ground, iterate, polygons, stencil
from ..schema import GridSpec
from ..sources import las, rasters, shapefile, sinks
from . import options
from .options import Options


@dataclass
class Result:
    """What a tool gives: `points`, `bands` on `grid` (row, col and one column a band), tables by name."""

    grid: GridSpec | None = None
    points: DataFrame | None = None
    bands: DataFrame | None = None
    tables: dict[str, DataFrame] = field(default_factory=dict)


@dataclass(frozen=True)
class Tool:
    run: Callable[[SparkSession, Options], Result]
    values: frozenset[str]
    flags: frozenset[str]


TOOLS: dict[str, Tool] = {}
#: Every tool that reads points takes these.
_POINTS = "class return"


def tool(name: str, values: str, flags: str = ""):
    def add(f):
        TOOLS[name] = Tool(f, frozenset(f"{values} output output-table outdir outroot output-raster output-points".split()), frozenset(f"{flags} noraster gpu nogpu profile".split()))
        return f

    return add


def run(spark: SparkSession, name: str, arguments: list[str]) -> Result:
    """Parse the arguments and run the tool; nothing is written yet (see save)."""
    if name not in TOOLS:
        raise ValueError(f"unknown tool: {name}")
    t = TOOLS[name]
    o = options.parse(arguments, set(t.values), set(t.flags))
    if "noraster" in o.flags and "output-table" not in o.values:
        raise ValueError("/noraster needs /output-table: a run gives at least one output")
    if not o.positionals:
        raise ValueError(f"{name} needs an input")
    return t.run(spark, o)


def save(r: Result, raster: str | None = None, table: str | None = None, name: str = "grid") -> None:
    """Bands as one TIFF, and the dense table, or the table of that name, as .csv or .sqlite."""
    if raster and r.bands is not None:
        sinks.write_bands(r.bands, r.grid, raster)
    if table:
        df, order = (r.tables[name], []) if name in r.tables else (sinks.grid_table(r.bands, r.grid), ["row", "col"])
        (sinks.write_sqlite if table.endswith(".sqlite") else sinks.write_csv)(df, table, order=order)


def _cloud(spark: SparkSession, o: Options, path: str | None = None) -> DataFrame:
    p = las.read(spark, [path or o.positionals[0]]).withColumn("ord", F.struct("file_idx", "pt_idx"))
    return filters.keep(p, PointFilter(o.values.get("class"), o.values.get("return")))


def _ground(spark: SparkSession, o: Options) -> tuple[DataFrame, GridSpec] | tuple[None, None]:
    path = o.values.get("ground") or (o.positionals[1] if len(o.positionals) > 1 else None)
    return rasters.read(spark, path) if path else (None, None)


def _high(spark: SparkSession, o: Options) -> DataFrame:
    return ground.heights(_cloud(spark, o), *_ground(spark, o))


def _metrics(spark: SparkSession, o: Options, minht: float) -> grid.Metrics:
    asked = o.values.get("rgb")
    chosen: tuple[str, ...] = ()
    if asked:
        formats = [r["point_format"] for r in las.files(spark, [o.positionals[0]]).select("point_format").distinct().collect()]  # a handful
        chosen = tuple(n for n in channels(asked, formats[0]).names if all(n in channels(asked, f).names for f in formats))
    limits = o.numbers("outlier")
    return grid.Metrics(
        minht=o.number("minht", minht), heightcut=o.number("heightcut"), outliers=tuple(limits[:2]) if len(limits) > 1 else None, first="first" in o.flags,
        intensity="nointensity" not in o.flags, channels=chosen, strata=tuple(o.numbers("strata")), intensity_strata=tuple(o.numbers("intstrata")),
        channel_strata="rgbstrata" in o.flags, surface=o.values.get("surfstats-source", "max") if "surfstats" in o.flags else None,
        experimental="exp" in o.flags, cell=o.number("cellsize", 10.0), voxel=o.number("voxelsize", 20.0),
    )


def _sentinels(o: Options, nodata: str = "NA", noheight: str = "0") -> Sentinels:
    return Sentinels(Sentinels.parse(o.values.get("nodata", nodata)), Sentinels.parse(o.values.get("noheight", noheight)))


@tool("gridmetrics", f"{_POINTS} ground cellsize minht heightcut outlier strata intstrata nodata noheight rgb voxelsize surfstats-source", "first all nointensity strataraster rgbstrata exp surfstats")
def _(spark: SparkSession, o: Options) -> Result:
    g = GridSpec.of(_cloud(spark, o), o.number("cellsize", 10.0))
    cells = grid.dense(grid.grid_metrics(_high(spark, o), g, _metrics(spark, o, 2.0)), g)
    return Result(g, bands=grid.apply_sentinels(cells, _sentinels(o)))


@tool("cloudmetrics", f"{_POINTS} ground minht cellsize voxelsize shape field nodata noheight strata intstrata rgb", "exp surfstats rgbstrata")
def _(spark: SparkSession, o: Options) -> Result:
    m, high = _metrics(spark, o, 2.0), _high(spark, o)
    if "shape" not in o.values:
        # points without ground count in the total of a whole cloud
        g = GridSpec.of(_cloud(spark, o), m.cell) if m.surface else None
        total = _cloud(spark, o).agg(F.count("*").alias("total_points"))
        return Result(tables={"cloud": total.crossJoin(grid.cloud_metrics(high, None, m, g).drop("total_points"))})  # one row each
    shapes = shapefile.read(spark, o.values["shape"], o.values.get("field"))
    p = polygons.first_feature(high, shapes).where("feature_idx is not null")
    rows = shapes.select("feature_idx", "label").join(grid.cloud_metrics(p, ["feature_idx"], m), "feature_idx", "left")
    return Result(tables={"cloud": rows.fillna(0, ["total_points", "canopy_points"])})


@tool("canopymodel", f"{_POINTS} cellsize ground smooth", "slope")
def _(spark: SparkSession, o: Options) -> Result:
    p = _cloud(spark, o)
    g = GridSpec.of(p, o.number("cellsize", 1.0))
    dem, spec = _ground(spark, o)
    high = ground.slope_normal_heights(p, dem, spec) if "slope" in o.flags and dem is not None else ground.heights(p, dem, spec)
    return Result(g, bands=stencil.smooth(grid.canopy_model(high, g), int(o.number("smooth", 0))).withColumnRenamed("value", "canopy_height"))


@tool("groundfilter", f"{_POINTS} cellsize filtercell gparam wparam aparam bparam iterations coarsecell coarsecut tolerance")
def _(spark: SparkSession, o: Options) -> Result:
    p = _cloud(spark, o)
    g = GridSpec.of(p, o.number("cellsize", 1.0))
    k = KrausPfeifer(o.number("gparam", -2.0), o.number("wparam", 2.5), o.number("aparam", 1.0), o.number("bparam", 4.0))
    flagged = iterate.classify_ground(p, o.number("filtercell", 10.0), int(o.number("iterations", 5)), k, o.number("coarsecell"), o.number("coarsecut"), o.number("tolerance"))
    kept = filters.reclassify(flagged.where("is_ground").drop("is_ground"))
    return Result(g, points=kept, bands=iterate.ground_model(kept, g).withColumnRenamed("value", "ground"))


@tool("densitymetrics", f"{_POINTS} strata cellsize ground nodata")
def _(spark: SparkSession, o: Options) -> Result:
    g, strata = GridSpec.of(_cloud(spark, o), o.number("cellsize", 10.0)), o.numbers("strata") or [0.5, 2.0, 5.0, 10.0, 20.0]
    high = _high(spark, o)
    return Result(g, bands=grid.density_metrics(high, g, strata), tables={"counts": sinks.grid_table(grid.density_counts(high, g, strata), g)})


@tool("returndensity", f"{_POINTS} cellsize")
def _(spark: SparkSession, o: Options) -> Result:
    p = _cloud(spark, o)
    g = GridSpec.of(p, o.number("cellsize", 5.0))
    return Result(g, bands=grid.return_density(p, g))


@tool("clipdata", f"{_POINTS} extent ground minz maxz shape field", "multifile outside")
def _(spark: SparkSession, o: Options) -> Result:
    p = _cloud(spark, o)
    if box := o.numbers("extent"):
        p = filters.clip_box(p, *box)
    low, high = o.number("minz"), o.number("maxz")
    if low is not None or high is not None:
        dem, spec = _ground(spark, o)
        p = ground.heights(p, dem, spec, keep_missing=True)
        p = p.where(F.col("h").between(-1e9 if low is None else low, 1e9 if high is None else high)).drop("h")
    if "shape" in o.values:
        shapes = shapefile.read(spark, o.values["shape"], o.values.get("field"))
        if "multifile" in o.flags:  # the feature tells the file
            return Result(points=polygons.first_feature(p, shapes).where("feature_idx is not null").join(shapes.select("feature_idx", "label"), "feature_idx"))
        p = polygons.clip_polygons(p, shapes, "outside" in o.flags)
    return Result(points=p)


@tool("filterdata", f"{_POINTS} minz maxz")
def _(spark: SparkSession, o: Options) -> Result:
    return Result(points=filters.elevation_band(_cloud(spark, o), o.number("minz"), o.number("maxz")))


@tool("thindata", f"{_POINTS} cellsize")
def _(spark: SparkSession, o: Options) -> Result:
    return Result(points=filters.thin(_cloud(spark, o), o.number("cellsize", 1.0)))


@tool("catalog", "density")
def _(spark: SparkSession, o: Options) -> Result:
    r = Result(tables={"catalog": filters.catalog(las.files(spark, o.positionals))})
    if "density" in o.values:
        p = las.read(spark, o.positionals)
        r.grid = GridSpec.of(p, o.number("density"))
        r.bands = grid.point_count(p, r.grid)
    return r


@tool("topometrics", "")
def _(spark: SparkSession, o: Options) -> Result:
    surface, g = rasters.read(spark, o.positionals[0])
    return Result(g, bands=stencil.slope_aspect(surface, g.cell))


@tool("gridsurfacestats", "reference")
def _(spark: SparkSession, o: Options) -> Result:
    surface, g = rasters.read(spark, o.positionals[0])
    other = None
    if "reference" in o.values:
        other, shape = rasters.read(spark, o.values["reference"])
        stencil.same_shape(g, shape)
    stats = stencil.surface_stats(surface, g.cell, other)
    return Result(g, bands=stats, tables={"summary": stencil.surface_summary(stats, g.cell)})


@tool("canopymaxima", "minht window-a window-b")
def _(spark: SparkSession, o: Options) -> Result:
    chm, g = rasters.read(spark, o.positionals[0])
    return Result(g, tables={"trees": stencil.tree_tops(chm, g, o.number("minht", 2.0), o.number("window-a", 0.5), o.number("window-b", 0.05))})


@tool("treeseg", "minht")
def _(spark: SparkSession, o: Options) -> Result:
    chm, g = rasters.read(spark, o.positionals[0])
    cells = crowns.segments(chm, g, o.number("minht", 2.0))
    return Result(g, bands=cells.select("row", "col", "tree_id"), tables={"crowns": crowns.crown_summary(cells, g)})
