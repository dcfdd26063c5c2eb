"""Points in polygons: a bucketed equi-join, then an even-odd test in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ring vertices, counted once a bucket that lists them, up to which the feature side is broadcast (16 bytes each); more are
#: joined by a shuffle on buckets.
BROADCAST_VERTICES = 1_000_000
#: Buckets over which the mean feature's box is cut at most.
BUCKETS = 64


def _inside() -> str:
    """Odd crossings over all rings of one of the feature's polygons. An edge counts where its ends lie on both sides of y
    (by >) and x is left of the crossing (by <)."""
    hit = "(e.y > y) <> (e.py > y) AND x < (e.px - e.x) * (y - e.y) / nullif(e.py - e.y, 0D) + e.x"
    crossings = f"size(filter(f.edges, e -> e.poly = k AND coalesce({hit}, false)))"
    return f"exists(array_distinct(transform(f.edges, e -> e.poly)), k -> {crossings} % 2 = 1)"


def _bucketed(features: DataFrame, cell: float) -> DataFrame:
    """One row per feature and bucket that its box touches, with the edges that a test in the bucket can cross: those that
    reach into the bucket's band of y, and not wholly to its left. An edge is its two ends; both rings' ends stay in order."""
    f = features.withColumn("__bx", F.explode(F.sequence(F.floor(F.col("min_x") / cell), F.floor(F.col("max_x") / cell))))
    f = f.withColumn("__by", F.explode(F.sequence(F.floor(F.col("min_y") / cell), F.floor(F.col("max_y") / cell))))
    before = "(i + size(r.xs) - 1) % size(r.xs)"
    low, high, left = f"__by * {cell!r}D", f"(__by + 1) * {cell!r}D", f"__bx * {cell!r}D"
    crosses = f"greatest(r.ys[i], r.ys[{before}]) >= {low} AND least(r.ys[i], r.ys[{before}]) <= {high} AND greatest(r.xs[i], r.xs[{before}]) >= {left}"
    kept = f"filter(sequence(0, size(r.xs) - 1), i -> {crosses})"
    edge = f"named_struct('poly', r.poly, 'x', r.xs[i], 'y', r.ys[i], 'px', r.xs[{before}], 'py', r.ys[{before}])"
    return f.withColumn("edges", F.expr(f"flatten(transform(filter(rings, r -> size(r.xs) > 0), r -> transform({kept}, i -> {edge})))"))


def first_feature(points: DataFrame, features: DataFrame, order: str = "ord", cell: float | None = None) -> DataFrame:
    """Add feature_idx: the lowest feature that holds the point, null if none does. `order` identifies a point.

    Features are listed in the buckets that their boxes touch, each with the edges that matter there; points look at one
    bucket. Buckets are sized by the features, unless cell says otherwise. No point is compared with all features.
    """
    wide = features.agg(F.avg(F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")))).first()[0]
    cell = float(cell or max((wide or 1.0) / BUCKETS**0.5, 1e-6))
    f = _bucketed(features.select("feature_idx", "min_x", "min_y", "max_x", "max_y", "rings"), cell)
    boxed = f.select("__bx", "__by", "feature_idx", "min_x", "min_y", "max_x", "max_y", "edges")
    small = (boxed.agg(F.sum(F.size("edges") + 4)).first()[0] or 0) <= BROADCAST_VERTICES // 2  # an edge is two vertices
    listed = boxed.groupBy("__bx", "__by").agg(F.sort_array(F.collect_list(F.struct("feature_idx", "min_x", "min_y", "max_x", "max_y", "edges"))).alias("fs"))
    p = points.withColumns({"__bx": F.floor(F.col("x") / cell), "__by": F.floor(F.col("y") / cell)})
    j = p.join(F.broadcast(listed) if small else listed, ["__bx", "__by"], "left")
    hit = f"get(filter(fs, f -> x BETWEEN f.min_x AND f.max_x AND y BETWEEN f.min_y AND f.max_y AND {_inside()}), 0).feature_idx"
    return j.withColumn("feature_idx", F.expr(hit)).select(*points.columns, "feature_idx")


def clip_polygons(points: DataFrame, features: DataFrame, outside: bool = False) -> DataFrame:
    """Points inside any feature, or outside all."""
    p = first_feature(points, features)
    return p.where(F.col("feature_idx").isNull() if outside else F.col("feature_idx").isNotNull()).drop("feature_idx")
