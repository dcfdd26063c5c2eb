import numpy as np
import pytest
from pyspark.sql import functions as F

from arborgrid.functions.points import KrausPfeifer, PointFilter, Sentinels, channels, number_set
from arborgrid.functions.stats import FIELDS, bundle_from_counts, with_bundle
from arborgrid.operators import ground, grid, iterate, stencil
from arborgrid.plans import options, pipeline
from arborgrid.schema import GridSpec


def kept(spark, spec, rows):
    df = spark.createDataFrame(rows, "classification int, return_number int, number_of_returns int, withheld boolean")
    return [tuple(r)[:3] for r in df.where(spec.column()).collect()]


def test_class_and_return_filters(spark):
    rows = [(c, 1, 1, False) for c in (1, 2, 5, 6, 7, 9, 18)]
    assert [r[0] for r in kept(spark, PointFilter(), rows)] == [1, 2, 5, 6, 9]
    assert len(kept(spark, PointFilter("all"), rows)) == len(kept(spark, PointFilter("*"), rows)) == 7
    assert [r[0] for r in kept(spark, PointFilter("~7,9,18"), rows)] == [1, 2, 5, 6]
    assert [r[0] for r in kept(spark, PointFilter("5 - 1"), rows)] == [1, 2, 5]
    assert kept(spark, PointFilter("all"), [(2, 1, 1, True)]) == []
    pairs = [(1, 1), (1, 3), (2, 3), (3, 3)]
    got = lambda spec: [r[1:] for r in kept(spark, PointFilter(returns=spec), [(2, a, b, False) for a, b in pairs])]
    assert got("first") == [(1, 1), (1, 3)] and got("last") == [(1, 1), (3, 3)] and got("only") == [(1, 1)] and got("intermediate") == [(2, 3)] and got("1,2") == [(1, 1), (1, 3), (2, 3)]
    assert number_set("1,x,5-3, 300,250-999") == {1, 3, 4, 5, *range(250, 256)}


def bundle(values):
    v, n = np.sort(np.array(values, float)), len(values)
    bins, counts = np.unique(np.floor(v / 0.5), return_counts=True)
    mode = (bins[np.argmax(counts)] + 0.5) * 0.5
    i = np.arange(n)
    b = [v.mean()] + [(v * np.prod([i - k for k in range(p)], axis=0)).sum() / np.prod([n - 1 - k for k in range(p)]) / n if n > p else 0.0 for p in (1, 2, 3)]
    d = v - v.mean()
    out = {"mean": v.mean(), "stddev": v.std(), "variance": v.var(ddof=1) if n > 1 else 0.0, "mode": mode, "median": np.median(v), "p95": np.quantile(v, 0.95), "aad": abs(d).mean(), "mad_mode": abs(v - mode).mean()}
    out["l2"] = 2 * b[1] - b[0] if n >= 2 else 0.0
    out["l4"] = 20 * b[3] - 30 * b[2] + 12 * b[1] - b[0] if n >= 4 else 0.0
    out["kurtosis"] = (d**4).mean() / v.var() ** 2 if v.var() else 0.0
    return out


@pytest.mark.parametrize("values", [[2, 4, 4, 4, 5, 5, 7, 9], [1, 1, 1, 2, 3], [0, 0, 1, 1], [5], [3, 3], list(np.random.default_rng(1).normal(10, 4, 200).round(2))])
def test_bundle_both_ways(spark, values):
    df = spark.createDataFrame([(1, float(v)) for v in values], "k int, v double")
    a = with_bundle(df.groupBy("k").agg(F.collect_list("v").alias("vs")), "vs", "").first().asDict()
    c = bundle_from_counts(df, ["k"], "v", "").first().asDict()
    for name, want in bundle(values).items():
        assert a[name] == pytest.approx(want, abs=1e-9) and c[name] == pytest.approx(want, abs=1e-9), name
    assert all(a[f] == pytest.approx(c[f], abs=1e-9) for f in FIELDS)


def test_bundle_of_nothing_is_null(spark):
    df = spark.createDataFrame([(1, None)], "k int, v double").groupBy("k").agg(F.collect_list("v").alias("vs"))
    assert set(with_bundle(df, "vs", "").drop("k").first()) == {None}


def test_weights_channels_sentinels(spark):
    w = spark.createDataFrame([(-5.0,), (-2.0,), (0.6,), (-1.0,)], "v double").select(KrausPfeifer().weight(F.col("v"))).collect()
    assert [r[0] for r in w] == [1.0, 1.0, 0.0, 0.5]
    assert channels("n,R", 7).names == ["red"] and channels("all", 8).names == ["red", "green", "blue", "nir"]
    assert Sentinels.parse(" na ") is None and Sentinels.parse("-9999") == -9999.0


def test_edges_fold_into_the_last_cell(spark):
    g = GridSpec.over(500000, 4000000, 500100, 4000100, 10)
    pts = [(500000.0, 4000000.0), (500100.0, 4000000.0), (500000.0, 4000100.0), (500100.0, 4000100.0)] + [(500055.0, 4000045.0)] * 3
    n = {(r["row"], r["col"]): r["n"] for r in grid.point_count(spark.createDataFrame(pts, "x double, y double"), g).where("n > 0").collect()}
    assert n == {(9, 0): 1, (9, 9): 1, (0, 0): 1, (0, 9): 1, (5, 5): 3}


def test_sampling(spark):
    g = GridSpec(1000.0, 2030.0, 10.0, 4, 3)
    plane = lambda x, y: 100 + 0.5 * (x - 1000) + 0.2 * (y - 2000)
    full = [(r, c, plane(1000 + (c + 0.5) * 10, 2030 - (r + 0.5) * 10)) for r in range(3) for c in range(4)]
    make = lambda cells: spark.createDataFrame(cells, "row int, col int, value double")
    at = lambda pts, cells, f=ground.sample_bilinear: [r["ground"] for r in f(spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(pts)], "k int, x double, y double"), make(cells), g).orderBy("k").collect()]
    a, b, c, d, e, f = at([(1015, 2025), (1012, 2018), (1001, 2018), (995, 2018), (1043, 1997), (980, 2018)], full)
    assert a == pytest.approx(plane(1015, 2025)) and b == pytest.approx(plane(1012, 2018)) and c == pytest.approx(d) and e == pytest.approx(full[-1][2]) and f is None
    hole = [x for x in full if x[:2] != (1, 2)]
    assert at([(1025, 2015)], hole, ground.sample_nearest) == [None]
    assert at([(1023, 2018)], hole)[0] is not None


def raster(spark, a):
    return spark.createDataFrame([(r, c, float(v)) for (r, c), v in np.ndenumerate(a) if not np.isnan(v)], "row int, col int, value double")


def array(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["row"], r["col"]] = r["value"]
    return out


@pytest.mark.parametrize("window", [3, 4, 11])
def test_smoothing_equals_brute_force(spark, window):
    r = np.random.default_rng(42)
    a = np.where(r.random((13, 9)) < 0.2, np.nan, r.uniform(0, 50, (13, 9)))
    h = (window + (window % 2 == 0)) // 2
    want = np.array([[np.nan if np.isnan(a[i, j]) else np.nanmean(a[max(0, i - h) : i + h + 1, max(0, j - h) : j + h + 1]) for j in range(9)] for i in range(13)])
    np.testing.assert_allclose(array(stencil.smooth(raster(spark, a), window), a.shape), want)


def test_surface_fixtures(spark):
    flat, ref = raster(spark, np.full((3, 3), 10.0)), raster(spark, np.full((3, 3), 4.0))
    s = stencil.surface_summary(stencil.surface_stats(flat, 2.0, ref), 2.0).first()
    assert (s["planimetric_area"], s["volume_total"], s["surface_area_3d"]) == (36.0, 216.0, 36.0)
    ramp = np.tile(0.75 * 2 * np.arange(5.0), (5, 1))
    centre = stencil.surface_stats(raster(spark, ramp), 2.0).where("row = 2 and col = 2").first()
    assert centre["area_ratio"] == pytest.approx(1.25)
    assert stencil.slope_aspect(flat, 2.0).collect()[0]["aspect"] == 270.0


def test_fill(spark):
    one = raster(spark, np.array([[np.nan, np.nan], [7.0, np.nan], [np.nan, np.nan]]))
    assert set(array(iterate.fill_empty(one, 2, 3), (3, 2)).ravel()) == {7.0}
    assert iterate.fill_empty(one.where("false"), 2, 3).count() == 0


def test_ground_under_canopy(spark):
    pts = []
    for i in range(60):
        for j in range(60):
            z = 100 + 0.1 * i + 0.05 * j
            if 15 <= i < 45 and 15 <= j < 45:
                pts.append((i + 0.5, j + 0.5, z + 30 + (7 * i + 13 * j) % 71, False))
                if i % 4 or j % 4:
                    continue
            pts.append((i + 0.5, j + 0.5, z, True))
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pts)], "ord int, x double, y double, z double, truth boolean")
    out = iterate.classify_ground(df, 10.0, iterations=3, coarse=0.0).groupBy("truth").agg(F.avg(F.col("is_ground").cast("double")).alias("s")).collect()
    share = {r["truth"]: r["s"] for r in out}
    assert share[True] > 0.98 and share[False] == 0.0


def test_ground_fills_only_where_points_lie(spark, monkeypatch):
    """Cells 0 to 2 and 299 of a row hold one point each. After the first pass no weight reaches cell 0, which takes the level of
    cell 1; the 296 cells without points cost no sweep."""
    swept = []
    whole = iterate.materialise
    monkeypatch.setattr(iterate, "materialise", lambda df, what: swept.append(what) or whole(df, what))
    df = spark.createDataFrame([(0, 5.0, 5.0, 10.0), (1, 15.0, 5.0, 8.0), (2, 25.0, 5.0, 0.0), (3, 2995.0, 5.0, 0.0)], "ord int, x double, y double, z double")
    out = iterate.classify_ground(df, 10.0, iterations=1, coarse=0.0).orderBy("ord").collect()
    assert [r["is_ground"] for r in out] == [False, False, True, True]
    assert swept.count("fill") == 2  # the seeds and one ring


def test_fill_of_wanted_cells(spark):
    rng = np.random.default_rng(5)
    z = np.where(rng.random((12, 15)) < 0.06, rng.random((12, 15)), np.nan)
    whole = array(iterate.fill_empty(raster(spark, z), 15, 12), (12, 15))
    wanted = spark.createDataFrame([(int(r), int(c)) for r, c in np.argwhere(np.isnan(z))[::7]], "row int, col int")
    some = array(iterate.fill_empty(raster(spark, z), 15, 12, wanted), (12, 15))
    for r, c in wanted.collect():
        assert some[r, c] == pytest.approx(whole[r, c], abs=1e-12)


def test_chains_and_state(spark, tmp_path):
    for good in ("canopymodel,canopymaxima,treeseg", "canopymodel,canopymaxima", "groundfilter,canopymodel,treeseg"):
        pipeline.validate(good.split(","))
    for bad in (["canopymaxima"], ["filterdata", "treeseg"], ["nothing"], []):
        with pytest.raises(ValueError):
            pipeline.validate(bad)
    s = pipeline.State(pipeline.Store(spark), str(tmp_path / "state.csv"))
    for t in ("tile_0010", "tile_0002", "tile_10000", "tile_0001", "tile_9999"):
        s.put(t, "canopymodel", "failed" if t == "tile_0002" else "done", str(tmp_path), 0, 0.0)
    again = pipeline.State(pipeline.Store(spark), str(tmp_path / "state.csv"))
    assert [t for t, _ in again.tiles_in_order()] == ["tile_0001", "tile_0002", "tile_0010", "tile_9999", "tile_10000"]
    assert again.failed() == {"tile_0002"} and again.done("tile_0001", "canopymodel")


def test_options():
    o = options.parse(["in.las", "/minht:2", "--strata=1,5", "-CLASS", "2,5", "/first", "/unknown:3", "-minz:-4"], {"minht", "strata", "class", "minz"}, {"first"})
    assert o.positionals == ["in.las"] and o.number("minht") == 2 and o.numbers("strata") == [1, 5] and o.values["class"] == "2,5" and o.flags == {"first"} and o.number("minz") == -4
