import sqlite3

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arborgrid.operators import polygons, tiles
from arborgrid.schema import POINT, GridSpec
from arborgrid.sources import las, rasters, shapefile, sinks
from arborgrid.streaming import ingest


def header(fmt, version=(1, 2), vlrs=()):
    return las.Header("", version, fmt, 0, 0, 0, (0.01,) * 3, (0.0,) * 3, (0,) * 3, (0,) * 3, 17, vlrs=list(vlrs))


def batch(n=50, seed=0):
    r = np.random.default_rng(seed)
    v = {"x": r.uniform(0, 100, n).round(2), "y": r.uniform(0, 100, n).round(2), "z": r.uniform(0, 40, n).round(2), "gps_time": np.arange(n) * 1.0}
    for f in POINT:
        if f.name not in v:
            v[f.name] = r.random(n) < 0.3 if f.dataType.simpleString() == "boolean" else r.integers(1, 4, n)
    arrow = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "smallint": pa.int16(), "boolean": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array(v[f.name], arrow[f.dataType.simpleString()]) for f in POINT], names=POINT.names)


@pytest.mark.parametrize("fmt, written", [(0, 0), (1, 1), (3, 3), (4, 1), (6, 6), (7, 7), (8, 8), (10, 8)])
def test_las_round_trip(spark, tmp_path, fmt, written):
    b, path = batch(), str(tmp_path / "a.las")
    wkt = (las.WKT_USER, las.WKT_RECORD, b"LOCAL_CS\0")
    assert las.write(iter([b]), path, header(fmt, vlrs=[wkt, (b"other", 7, b"x")])) == 50
    h = las.read_header(path)
    assert (h.point_format, h.count, h.wkt, h.encoding, len(h.vlrs)) == (written, 50, "LOCAL_CS", 17, 1) and (h.version == (1, 4)) == (written >= 6)
    got = las.read(spark, [path]).orderBy("pt_idx").collect()
    for name in ("x", "y", "z", "intensity", "return_number", "classification", "withheld"):
        assert [r[name] for r in got] == pytest.approx(b.column(POINT.names.index(name)).to_pylist(), abs=1e-9)
    assert las.read(spark, [path]).where("x > 1000").count() == 0
    assert las.files(spark, [str(tmp_path)]).first()["point_count"] == 50


def test_compressed_points_are_refused(spark, tmp_path):
    path = tmp_path / "a.laz"
    las.write(iter([batch()]), str(path), header(1))
    with pytest.raises(Exception, match="no decoder"):
        las.read(spark, [str(path)]).count()


def test_rasters(spark, tmp_path):
    g = GridSpec(10.0, 40.0, 2.0, 4, 3)
    a = np.arange(12.0).reshape(3, 4)
    a[1, 1] = np.nan
    rasters.write_ascii(str(tmp_path / "a.asc"), g, a)
    rasters.write_tiff(str(tmp_path / "a.tif"), g, {"one": a, "two": a * 2})
    for name in ("a.asc", "a.tif"):
        df, spec = rasters.read(spark, str(tmp_path / name))
        assert spec == g and df.count() == 11
        np.testing.assert_array_equal(rasters.dense_array(df, g), a)
    two, _ = rasters.read(spark, str(tmp_path / "a.tif"), 2)
    np.testing.assert_array_equal(rasters.dense_array(two, g), a * 2)
    mosaic, spec = rasters.mosaic([(df, g), (df, GridSpec(18.0, 40.0, 2.0, 4, 3))])
    assert spec.cols == 8 and mosaic.count() == 22
    assert rasters.as_points(df, g).agg(F.min("x"), F.max("y")).first() == (11.0, 39.0)


def test_shapefile_and_polygons(spark, tmp_path):
    path = str(tmp_path / "p.shp")
    square, hole = [(0, 0), (0, 10), (10, 10), (10, 0)], [(4, 4), (6, 4), (6, 6), (4, 6)]
    shapefile.write(path, [[square, hole], [[(5, 5), (5, 20), (20, 20), (20, 5)]]], ["a", "b"])
    f = shapefile.read(spark, path, "name")
    assert [r["label"] for r in f.orderBy("feature_idx").collect()] == ["a", "b"]
    pts = [(1, 2.0, 2.0), (2, 5.0, 5.5), (3, 7.0, 7.0), (4, 15.0, 15.0), (5, 30.0, 1.0)]
    got = {r["ord"]: r["feature_idx"] for r in polygons.first_feature(spark.createDataFrame(pts, "ord int, x double, y double"), f).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 1, 5: None}


def test_tables(spark, tmp_path):
    g = GridSpec(0.0, 4.0, 1.0, 5, 4)
    bands = spark.createDataFrame([(0, 0, 1.5), (3, 4, None)], "row int, col int, b double")
    t = sinks.grid_table(bands, g)
    assert sinks.write_csv(t, str(tmp_path / "t.csv"), ["row", "col"]) == 20
    assert (tmp_path / "t.csv").read_text().splitlines()[1:3] == ["0,0,0.5,3.5,1.5", "1,0,1.5,3.5,NA"]
    for k in (1, 2):
        sinks.write_sqlite(t, str(tmp_path / f"{k}.db"), order=["row", "col"])
    sinks.concat_sqlite([str(tmp_path / "1.db"), str(tmp_path / "2.db")], str(tmp_path / "all.db"))
    assert sqlite3.connect(tmp_path / "all.db").execute("select count(*), sum(b), count(b) from grid").fetchone() == (40, 3.0, 2)
    assert sinks.concat_csv([str(tmp_path / "t.csv")] * 2, str(tmp_path / "both.csv")) == 40
    assert len(sinks.write_bands(bands, g, str(tmp_path / "b.tif"), single=True)) == 1


def test_tiles_claim_each_point_once(spark):
    p = tiles.Project.over([(1000.0, 2000.0, 1200.0, 2200.0)], 20.0, 100.0, 50.0)
    v = [1000, 1005, 1095, 1099.999, 1100, 1101, 1150, 1199, 1200, 1000.001]
    pts = spark.createDataFrame([(float(x), float(y) + 1000) for x in v for y in v], "x double, y double")
    t = p.core_tile(pts)
    assert t.count() == 100 and t.select("tile_id").distinct().count() == 4
    assert t.where("tile_row not between 0 and 4 or tile_col not between 0 and 4").count() == 0
    one = {(r["x"], r["y"]): (r["tile_row"], r["tile_col"]) for r in t.collect()}
    assert one[1005.0, 2095.0] == (0, 0) and one[1095.0, 2005.0] == (4, 4)
    assert p.buffered(pts).where("x = 1100 and y = 2100").count() == 4
    assert tiles.Project.over([(-90112, 165888, -89100.5, 166900), (-89100.5, 166900, -88064, 167936)], 20.0, 1000.0).min_x == -90120
    with pytest.raises(ValueError):
        tiles.Project.over([], 20.0, 100.0)


def test_stream(spark, tmp_path):
    rows = [(1.0, 1.0, 5.0, 1, 1, 2, False), (1.5, 1.0, 9.0, 2, 2, 2, False), (8.0, 8.0, 1.0, 1, 1, 7, False)]
    df = spark.createDataFrame(rows, "x double, y double, z double, return_number int, number_of_returns int, classification int, withheld boolean")
    df.write.parquet(str(tmp_path / "in"))
    q = ingest.follow(spark, str(tmp_path / "in"), df.schema, GridSpec(0.0, 10.0, 5.0, 2, 2), "totals", str(tmp_path / "check"))
    q.awaitTermination(120)
    assert [tuple(r) for r in spark.table("totals").collect()] == [(1, 0, 2, 1, 5.0, 9.0, 7.0)]
