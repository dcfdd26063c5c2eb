"""The tool layer, chains by tile, global numbering and surfaces with gaps."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_sources import batch, header

from arborgrid.functions.numbering import numbered
from arborgrid.operators import filters, grid, ground, iterate, stencil, tiles
from arborgrid.plans import pipeline, tools
from arborgrid.schema import GridSpec
from arborgrid.sources import las, rasters


@pytest.fixture(scope="module")
def cloud(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("las") / "a.las")
    las.write(iter([batch(2000, 3)]), path, header(3))
    return path


def test_tools_read_their_options(spark, cloud, tmp_path):
    p = filters.keep(las.read(spark, [cloud]))
    r = tools.run(spark, "gridmetrics", [cloud, "/cellsize:25", "/minht:5", "-strata", "10,20", "/nointensity", "/surfstats", "/rgb:R"])
    want = grid.dense(grid.grid_metrics(p.withColumn("h", F.col("z")), r.grid, grid.Metrics(minht=5.0, strata=(10.0, 20.0), intensity=False, channels=("red",), surface="max")), r.grid)
    got = r.bands.orderBy("row", "col").collect()
    assert len(got) == r.grid.rows * r.grid.cols and {"surf_area_ratio", "red_mean", "strata03_count"} <= set(r.bands.columns)
    for a, b in zip(got, want.orderBy("row", "col").collect(), strict=True):
        assert a["elev_p95"] == pytest.approx(b["elev_p95"]) and a["canopy_cover"] == pytest.approx(b["canopy_cover"]) and a["surf_roughness"] == pytest.approx(b["surf_roughness"])
    tif, csv = str(tmp_path / "chm.tif"), str(tmp_path / "chm.csv")
    chm = tools.run(spark, "canopymodel", [cloud, "/cellsize:10", "/smooth:3"])
    tools.save(chm, tif, csv)
    assert rasters.read(spark, tif)[1] == chm.grid and open(csv).readline().strip() == "col,row,x,y,canopy_height"
    trees = tools.run(spark, "canopymaxima", [tif, "/minht:20"]).tables["trees"]
    assert trees.columns[:2] == ["tree_id", "row"]
    assert tools.run(spark, "treeseg", [tif, "/minht:20"]).tables["crowns"].agg(F.sum("pixel_count")).first()[0] == rasters.read(spark, tif)[0].where("value >= 20").count()
    assert tools.run(spark, "topometrics", [tif]).bands.columns == ["row", "col", "slope", "aspect"]
    same = tools.run(spark, "gridsurfacestats", [tif, "/reference:" + tif])
    assert same.tables["summary"].first()["volume_total"] == 0.0
    assert tools.run(spark, "catalog", [cloud, "/density:50"]).tables["catalog"].first()["file_name"] == "a.las"
    assert tools.run(spark, "filterdata", [cloud, "/minz:10", "/class:all"]).points.count() == las.read(spark, [cloud]).where("not withheld and z >= 10").count()
    assert tools.run(spark, "clipdata", [cloud, "/extent:10,10,60,60", "/maxz:15"]).points.count() == p.where("x between 10 and 60 and y between 10 and 60 and z <= 15").count()
    n = tools.run(spark, "densitymetrics", [cloud, "/cellsize:50", "/strata:10"]).tables["counts"].agg(F.sum("stratum01_count"), F.sum("stratum02_count")).first()
    assert tuple(n) == (p.where("z < 10").count(), p.where("z >= 10").count())
    row = tools.run(spark, "cloudmetrics", [cloud, "/minht:10"]).tables["cloud"].first()
    assert row["total_points"] == p.count() and row["canopy_points"] == p.where("z >= 10").count()


def test_tools_refuse(spark, cloud, tmp_path):
    for name, arguments in (("nothing", [cloud]), ("gridmetrics", []), ("gridmetrics", [cloud, "/noraster"])):
        with pytest.raises(ValueError):
            tools.run(spark, name, arguments)
    for k, shape in enumerate(((2, 3), (3, 3))):
        rasters.write_ascii(str(tmp_path / f"{k}.asc"), GridSpec(0.0, 30.0, 10.0, shape[1], shape[0]), np.ones(shape))
    with pytest.raises(ValueError, match="3 x 3"):
        tools.run(spark, "gridsurfacestats", [str(tmp_path / "0.asc"), f"/reference:{tmp_path / '1.asc'}"])


def test_chains_by_tile(spark, tmp_path):
    r = np.random.default_rng(9)
    data = [(k, float(x), float(y), float(z), int(c), 1, 1, bool(w)) for k, (x, y, z, c, w) in enumerate(zip(r.uniform(0, 60, 900), r.uniform(0, 30, 900), r.uniform(0, 30, 900), r.choice([1, 2, 5, 7], 900), r.random(900) < 0.1))]
    p = spark.createDataFrame(data, "ord int, x double, y double, z double, classification int, return_number int, number_of_returns int, withheld boolean").cache()
    project = tiles.Project(0.0, 0.0, 60.0, 30.0, 3.0, 30.0, 6.0)
    chain, o = ["filterdata", "canopymodel", "canopymaxima"], {"canopymaxima": {"minht": 15.0, "a": 1.0, "b": 0.05}}
    folder = f"file://{tmp_path}/run"
    out = pipeline.run_tiles(p, project, chain, o, folder)
    whole = grid.canopy_model(filters.keep(p).withColumn("h", F.col("z")), GridSpec.over(0.0, 0.0, 60.0, 30.0, 3.0))
    key = lambda df: sorted((x["row"], x["col"], x["value"]) for x in df.collect())
    assert key(out["canopymodel"]) == key(whole)  # tiles put together are the whole: noise and withheld points are gone
    tops = {(round(x["x"], 6), round(x["y"], 6)): x["tree_id"] for x in out["canopymaxima"].collect()}
    strip = {(round(x["x"], 6), round(x["y"], 6)): x["tree_id"] for x in tiles.tiled_tops(filters.keep(p).withColumn("h", F.col("z")), project, 3.0, 15.0, 1.0, 0.05).collect()}
    assert tops == strip and len(tops) > 5 and {t.rsplit("_", 1)[0] for t in tops.values()} == {"tile_0000", "tile_0001"}
    # finished stages are read, not run; a tile can be asked for; only failed tiles are run again
    calls = []
    old = pipeline.STAGES["canopymodel"]
    pipeline.STAGES["canopymodel"] = pipeline.Stage(old.name, old.takes, old.gives, lambda c, o: calls.append(1) or old.run(c, o))
    try:
        assert key(pipeline.run_tiles(p, project, chain, o, folder)["canopymodel"]) == key(whole) and not calls
        assert not pipeline.run_tiles(p, project, chain, o, folder, retry_failed=True) and not calls
        pipeline.run_tiles(p, project, chain, o, folder, tiles=["tile_0001"], rebuild=True, cleanup=True)
        assert len(calls) == 1 and not (tmp_path / "run/tile_0001/filterdata").exists() and (tmp_path / "run/tile_0001/canopymodel").exists()

        def fails(c, o):
            raise RuntimeError("no disk")

        pipeline.STAGES["canopymodel"] = pipeline.Stage(old.name, old.takes, old.gives, fails)
        assert not pipeline.run_tiles(p, project, ["canopymodel"], o, folder, tiles=["tile_0000"], rebuild=True)
        pipeline.STAGES["canopymodel"] = old
        state = pipeline.State(pipeline.Store(spark), f"{folder}/state.csv")
        assert state.failed() == {"tile_0000"}
        again = pipeline.run_tiles(p, project, ["canopymodel"], o, folder, retry_failed=True)["canopymodel"]
        assert again.agg(F.max("col")).first()[0] == 9
    finally:
        pipeline.STAGES["canopymodel"] = old


def test_numbers_follow_the_order(spark):
    r = np.random.default_rng(2)
    values = r.integers(0, 500, 3000).tolist()
    got = numbered(spark.createDataFrame(list(enumerate(values)), "k int, v int").repartition(7), [F.desc("v"), "k"], "n", 1).collect()
    want = {k: n for n, (k, _) in enumerate(sorted(enumerate(values), key=lambda x: (-x[1], x[0])), 1)}
    assert {x["k"]: x["n"] for x in got} == want
    assert numbered(spark.createDataFrame([], "k int"), ["k"], "n").count() == 0


def test_lookup_beside_gaps(spark):
    """Bilinear values, and where a corner is missing the rounded cell, a present corner, or the point's own cell."""
    g = GridSpec(0.0, 4.0, 1.0, 4, 4)
    cells = {(r, c): 10.0 * r + c for r in range(4) for c in range(4) if (r, c) not in {(1, 1), (1, 2), (2, 1)}}
    raster = spark.createDataFrame([(r, c, v) for (r, c), v in cells.items()], "row int, col int, value double")
    where = [(x / 4, y / 4) for x in range(-5, 22) for y in range(-5, 22)]
    got = {(p["x"], p["y"]): p["ground"] for p in ground.sample_bilinear(spark.createDataFrame(where, "x double, y double"), raster, g).collect()}
    clamp = lambda v: max(0, min(3, v))
    for x, y in where:
        cd, rd = x, 4.0 - y
        if not (-1 <= cd <= 5 and -1 <= rd <= 5):
            assert got[x, y] is None
            continue
        c0, r0 = math.floor(cd - 0.5), math.floor(rd - 0.5)
        four = [cells.get((clamp(r0 + b), clamp(c0 + a))) for b in (0, 1) for a in (0, 1)]
        if None not in four:
            tx, ty = (max(0.0, min(1.0, v - 0.5 - math.floor(v - 0.5))) for v in (cd, rd))
            want = (1 - ty) * ((1 - tx) * four[0] + tx * four[1]) + ty * ((1 - tx) * four[2] + tx * four[3])
        else:
            half_up = lambda v: int(math.copysign(math.floor(abs(v) + 0.5), v))
            near = cells.get((clamp(half_up(rd)), clamp(half_up(cd))))
            want = next((v for v in (near, *four, cells.get((clamp(math.floor(rd)), clamp(math.floor(cd))))) if v is not None), None)
        assert got[x, y] == (None if want is None else pytest.approx(want)), (x, y)


def test_filling_by_rings(spark):
    r = np.random.default_rng(6)
    grid_values = np.where(r.random((9, 11)) < 0.08, r.uniform(0, 9, (9, 11)), np.nan)
    grid_values[0, 0] = 1.0
    raster = spark.createDataFrame([(int(a), int(b), float(grid_values[a, b])) for a, b in np.argwhere(~np.isnan(grid_values))], "row int, col int, value double")
    while np.isnan(grid_values).any():
        old = np.pad(grid_values, 1, constant_values=np.nan)
        for a, b in np.argwhere(np.isnan(grid_values)):
            around = old[a : a + 3, b : b + 3]
            if not np.isnan(around).all():
                grid_values[a, b] = np.nanmean(around)
    got = np.full((9, 11), np.nan)
    for x in iterate.fill_empty(raster, 11, 9).collect():
        got[x["row"], x["col"]] = x["value"]
    assert np.allclose(got, grid_values)


def test_shapes_must_agree():
    a = GridSpec(0.0, 9.0, 1.0, 3, 9)
    stencil.same_shape(a, GridSpec(5.0, 2.0, 2.0, 3, 9))
    with pytest.raises(ValueError):
        stencil.same_shape(a, GridSpec(0.0, 9.0, 1.0, 9, 3))
