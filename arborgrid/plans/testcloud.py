"""A deterministic point cloud, surface and polygons over the star-schema tables, in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import GridSpec

#: Point columns as SQL that both engines read alike. Heights have a prime denominator, so that no statistic of them lies half-way
#: between two rounded numbers.
POINT_SQL = """
SELECT CAST(l_partkey AS DOUBLE) / 20 AS x, CAST(l_suppkey AS DOUBLE) AS y, CAST(l_quantity AS DOUBLE) + CAST(l_partkey % 1009 + 1 AS DOUBLE) / 1013 AS z,
 CAST(floor(l_extendedprice / 10) AS INT) AS intensity, CAST(l_linenumber AS INT) AS return_number,
 CAST(max(l_linenumber) OVER (PARTITION BY l_orderkey) AS INT) AS number_of_returns,
 CASE WHEN l_suppkey % 40 = 7 THEN 7 WHEN l_partkey % 97 = 0 THEN 18 WHEN l_returnflag = 'R' THEN 2 WHEN l_returnflag = 'A' THEN 5 ELSE 1 END AS classification,
 CAST(round(l_tax * 100) AS INT) = 8 AS withheld, CAST(l_partkey % 256 AS INT) AS red, CAST(l_suppkey % 256 AS INT) AS green,
 CAST(l_orderkey % 256 AS INT) AS blue, CAST((l_partkey + l_suppkey) % 256 AS INT) AS nir,
 l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3, l_suppkey AS k4, l_quantity AS k5, l_extendedprice AS k6
FROM lineitem"""

#: A second cloud from the events.
EVENT_SQL = """
SELECT CAST(user_id AS DOUBLE) AS x, CAST(hour(ts) AS DOUBLE) AS y, CAST(value AS DOUBLE) AS z, event_type AS label, event_id AS k1 FROM events"""

#: Square, square with a hole, two that overlap (the first one wins), one of two parts, one far from all points.
POLYGONS = [
    ("square", [[(5, 5), (25, 5), (25, 25), (5, 25)]], [0]),
    ("holed", [[(30, 30), (60, 30), (60, 60), (30, 60)], [(40, 40), (50, 40), (50, 50), (40, 50)]], [0, 0]),
    ("left", [[(65, 10), (85, 10), (85, 40), (65, 40)]], [0]),
    ("right", [[(75, 20), (95, 25), (90, 45), (70, 38)]], [0]),
    ("parts", [[(10, 70), (20, 70), (15, 85)], [(30, 75), (38, 75), (38, 90), (30, 90)]], [0, 1]),
    ("empty", [[(-50, -50), (-40, -50), (-40, -40)]], [0]),
]


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cloud; ord is the order of reading and identifies a point."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    sql = POINT_SQL.replace("FROM lineitem", "FROM {t}")
    return spark.sql(sql, t=t).withColumn("ord", F.struct("k1", "k2", "k3", "k4", "k5", "k6"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(EVENT_SQL.replace("FROM events", "FROM {t}"), t=spark.read.parquet(f"{sf_dir}/events.parquet"))


def ground(spark: SparkSession, grid: GridSpec) -> DataFrame:
    """The plane 0.02 x + 0.01 y at cell centres."""
    cells = grid.cells(spark)
    return cells.select("row", "col", (0.02 * grid.centre_x(F.col("col")) + 0.01 * grid.centre_y(F.col("row"))).alias("value"))


def features(spark: SparkSession) -> DataFrame:
    rows = []
    for k, (label, rings, parts) in enumerate(POLYGONS):
        xs, ys = ([float(p[a]) for r in rings for p in r] for a in (0, 1))
        rows.append((k, label, min(xs), min(ys), max(xs), max(ys), [(part, [float(p[0]) for p in r], [float(p[1]) for p in r]) for part, r in zip(parts, rings, strict=True)]))
    from ..schema import FEATURE

    return spark.createDataFrame(rows, FEATURE)
