"""Fifty ratios of the canopy to the whole cloud: extents, radial distances, occupied cells and voxels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.points import floor_cell

UNSET = -9999.0
# The metrics' names in order.
NAMES = """zMinRat zMaxRat zSdRat zMeanRat zCvRat zIQRat xMin xMax xSd xRatHt yMin yMax ySd yRatHt
xyMinRt xyMinRtRat xyMaxRt xyMaxRtRat xySdRt xySdRtRat xyMnRt xyMnRtRat xyCvRt xyCvRtRat xyCor xyCorRat
xyzMinRt xyzMinRtRat xyzMaxRt xyzMaxRtRat xyzSdRt xyzSdRtRat xyzMnRt xyzMnRtRat xyzCvRt xyzCvRtRat xyzCor xyzCorRat
gridAreaAll gridArea areaCover areaScl gridVolAll gridVol gridVolRat gridVolScl voxVolAll voxVol voxVolRat voxVolScl""".split()


def _cor(n: str, a: str, b: str, side: str) -> Column:
    """Pearson r from sums; 0 without variance."""
    c = lambda x: F.col(f"{side}_{x}")
    cov = c(f"s_{a}{b}") / c(n) - c(f"m_{a}") * c(f"m_{b}")
    var = lambda x: c(f"v_{x}")
    return F.when((c(n) > 1) & (var(a) > 0) & (var(b) > 0), cov / F.sqrt(var(a) * var(b))).otherwise(0.0)


def experimental_metrics(points: DataFrame, minht: float, cell: float = 10.0, voxel: float = 20.0, keys: list[str] | None = None) -> DataFrame:
    """One row per keys. All points against those with z >= minht; unset fields are -9999.

    Moments are one aggregation; cells and voxels are first reduced to one row each, so distinct counts cost no sets.
    """
    keys = keys or []
    cell, voxel = cell if cell > 0 else 10.0, voxel if voxel > 0 else 20.0
    p = points.select(*keys, "x", "y", "z", F.sqrt(F.expr("x*x+y*y")).alias("r"), F.sqrt(F.expr("x*x+y*y+z*z")).alias("q"), (F.col("z") >= minht).alias("high"))
    agg = []
    for side, on in (("a", F.lit(True)), ("c", F.col("high"))):
        agg.append(F.count_if(on).alias(f"{side}_n"))
        for v in "xyzrq":
            e = F.when(on, F.col(v))
            agg += [F.min(e).alias(f"{side}_lo_{v}"), F.max(e).alias(f"{side}_hi_{v}"), F.avg(e).alias(f"{side}_m_{v}"), F.var_pop(e).alias(f"{side}_v_{v}"), F.coalesce(F.stddev_samp(e), F.lit(0.0)).alias(f"{side}_sd_{v}")]
        agg += [F.sum(F.when(on, F.col("x") * F.col("y"))).alias(f"{side}_s_xy"), F.sum(F.when(on, F.col("r") * F.col("z"))).alias(f"{side}_s_rz")]
    base = p.groupBy(*keys).agg(*agg)
    cx, cy = floor_cell(F.col("x"), cell), floor_cell(F.col("y"), cell)
    per_cell = p.groupBy(*keys, cx.alias("cx"), cy.alias("cy")).agg(F.min("z").alias("lo"), F.max("z").alias("hi"), F.min(F.when(F.col("high"), F.col("z"))).alias("clo"), F.max(F.when(F.col("high"), F.col("z"))).alias("chi"))
    area = per_cell.groupBy(*keys).agg((F.count("*") * cell**2).alias("gridAreaAll"), (F.count("clo") * cell**2).alias("gridArea"), (F.sum(F.col("hi") - F.col("lo")) * cell**2).alias("gridVolAll"), (F.coalesce(F.sum(F.col("chi") - F.col("clo")), F.lit(0.0)) * cell**2).alias("gridVol"))
    vox = p.groupBy(*keys, floor_cell(F.col("x"), voxel).alias("vx"), floor_cell(F.col("y"), voxel).alias("vy"), floor_cell(F.col("z"), voxel).alias("vz")).agg(F.max("high").alias("high"))
    vox = vox.groupBy(*keys).agg((F.count("*") * voxel**3).alias("voxVolAll"), (F.count_if("high") * voxel**3).alias("voxVol"))
    if keys:
        j = base.join(area, keys).join(vox, keys)
    else:  # one row each
        j = base.join(F.broadcast(area), F.lit(True)).join(F.broadcast(vox), F.lit(True))
    c = F.col
    tiny = lambda a: F.abs(a) > 1e-6
    cv = lambda s, v: F.when(c(f"{s}_m_{v}") != 0, c(f"{s}_sd_{v}") / c(f"{s}_m_{v}")).otherwise(0.0)
    rate = lambda a, b, on=None: F.when((b > 0) if on is None else on, 100.0 * a / F.when(b != 0, b))
    out = {
        "zMinRat": F.when(tiny(c("a_lo_z")), F.abs(100.0 * (c("c_lo_z") - c("a_lo_z")) / F.when(c("a_lo_z") != 0, c("a_lo_z")))).otherwise(0.0),
        "zMaxRat": rate(c("c_hi_z"), c("a_hi_z"), tiny(c("a_hi_z"))), "zSdRat": rate(c("c_sd_z"), c("a_sd_z")), "zMeanRat": rate(c("c_m_z"), c("a_m_z"), tiny(c("a_m_z"))),
        "zCvRat": rate(cv("c", "z"), cv("a", "z"), tiny(cv("a", "z"))), "zIQRat": rate(c("c_hi_z") - c("c_lo_z"), c("a_hi_z") - c("a_lo_z")),
    }
    for v in "xy":
        out |= {f"{v}Min": c(f"c_lo_{v}"), f"{v}Max": c(f"c_hi_{v}"), f"{v}Sd": c(f"c_sd_{v}"), f"{v}RatHt": rate(c(f"c_hi_{v}") - c(f"c_lo_{v}"), c(f"a_hi_{v}") - c(f"a_lo_{v}"))}
    for name, v, pair in (("xy", "r", ("x", "y")), ("xyz", "q", ("r", "z"))):
        for label, f in (("Min", "lo"), ("Max", "hi"), ("Sd", "sd"), ("Mn", "m")):
            out |= {f"{name}{label}Rt": c(f"c_{f}_{v}"), f"{name}{label}RtRat": rate(c(f"c_{f}_{v}"), c(f"a_{f}_{v}"))}
        out |= {f"{name}CvRt": cv("c", v), f"{name}CvRtRat": rate(cv("c", v), cv("a", v))}
        mine, all_ = _cor("n", *pair, "c"), _cor("n", *pair, "a")
        out |= {f"{name}Cor": mine, f"{name}CorRat": rate(mine, all_, tiny(all_))}
    none = c("c_n") == 0
    out = {k: F.when(~none, v) for k, v in out.items()}
    out |= {k: c(k) for k in ("gridAreaAll", "gridArea", "gridVolAll", "gridVol", "voxVolAll", "voxVol")}
    out |= {"areaCover": rate(c("gridArea"), c("gridAreaAll")), "areaScl": rate(c("gridArea"), c("gridAreaAll")), "gridVolRat": rate(c("gridVol"), c("gridVolAll")), "gridVolScl": rate(c("gridVol"), c("gridAreaAll")), "voxVolRat": rate(c("voxVol"), c("voxVolAll")), "voxVolScl": rate(c("voxVol"), c("gridAreaAll"))}
    return j.select(*keys, *[F.coalesce(out[n].cast("double"), F.lit(UNSET)).alias(n) for n in NAMES])
