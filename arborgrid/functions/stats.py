"""The statistic bundle of a group of values, as SQL expressions over one sorted array, or over value counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialise

# Percentile ranks of the bundle, and the width of the mode's bins.
RANKS = (0.01, 0.05, 0.10, 0.20, 0.25, 0.30, 0.40, 0.50, 0.60, 0.70, 0.75, 0.80, 0.90, 0.95, 0.99)
MODE_BIN = 0.5
FIELDS = (
    ["min", "max", "mean", "stddev", "variance", "cv", "skewness", "kurtosis", "crr", "mode", "median", "iqr"]
    + [f"p{round(100 * r):02d}" for r in RANKS]
    + ["aad", "mad_median", "mad_mode", "l1", "l2", "l3", "l4", "l_cv", "l_skewness", "l_kurtosis", "quadratic_mean", "cubic_mean"]
)


def _zero(value: str, guard: str) -> str:
    return f"CASE WHEN {guard} THEN {value} ELSE 0D END"


def _derived(df: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    """From n, s1, d2, d3, d4 (central sums), q (percentiles), b1, b2, b3 (rank-weighted means), aad...: the bundle."""
    e = {
        "min": "lo", "max": "hi", "mean": "mean", "stddev": "sqrt(d2/n)", "variance": _zero("d2/(n-1)", "n>1"), "cv": _zero("sqrt(d2/n)/mean", "mean<>0"),
        "skewness": _zero("(d3/n)/pow(sqrt(d2/n),3)", "d2>0"), "kurtosis": _zero("(d4/n)/pow(d2/n,2)", "d2>0"), "crr": _zero("(mean-lo)/(hi-lo)", "hi>lo"),
        "mode": "mode", "median": f"q[{RANKS.index(0.5)}]", "iqr": f"q[{RANKS.index(0.75)}]-q[{RANKS.index(0.25)}]",
        "aad": "aad", "mad_median": "mad_median", "mad_mode": "mad_mode", "l1": "mean",
        "l2": _zero("2*b1-mean", "n>=2"), "l3": _zero("6*b2-6*b1+mean", "n>=3"), "l4": _zero("20*b3-30*b2+12*b1-mean", "n>=4"),
        "quadratic_mean": "sqrt(s2/n)", "cubic_mean": "cbrt(s3/n)",
    } | {f"p{round(100 * r):02d}": f"q[{k}]" for k, r in enumerate(RANKS)}
    e["l_cv"] = _zero(f"({e['l2']})/mean", "mean<>0")
    e["l_skewness"], e["l_kurtosis"] = (_zero(f"({e[m]})/({e['l2']})", f"({e['l2']})<>0") for m in ("l3", "l4"))
    return df.selectExpr(*keep, *[f"CASE WHEN n > 0 THEN {e[f]} END AS `{prefix}{f}`" for f in FIELDS])


def with_bundle(df: DataFrame, values: str, prefix: str) -> DataFrame:
    """Add the bundle of the array column `values` (any order, nulls absent); null columns for an empty array.

    One sort in place of a second shuffle: percentiles, ranks and deviations all read the same array. For groups of the size
    of a grid cell; large groups take bundle_from_counts.
    """
    keep = [f"`{c}`" for c in df.columns if c != values]
    d = df.withColumn("v", F.coalesce(F.sort_array(F.col(values)), F.array().cast("array<double>"))).withColumn("n", F.size("v").cast("double"))
    d = d.withColumn("s", F.expr("aggregate(v, struct(0D AS a, 0D AS b, 0D AS c), (s, x) -> struct(s.a + x AS a, s.b + x*x AS b, s.c + x*x*x AS c))"))
    d = d.withColumn("mean", F.expr("CASE WHEN n > 0 THEN s.a / n END"))
    ranks = ",".join(f"{r}D" for r in RANKS)
    at = "(r*(n-1))"
    q = f"transform(array({ranks}), r -> v[cast(floor{at} as int)] + ({at} - floor{at}) * (v[cast(ceil{at} as int)] - v[cast(floor{at} as int)]))"
    bins = f"transform(v, x -> floor(x/{MODE_BIN}D))"
    # runs of equal bins in sorted order: the longest, the lowest bin among equals
    run = "named_struct('at', cast(NULL as bigint), 'len', 0, 'best', cast(NULL as bigint), 'most', 0)"
    step = (
        "(s, b) -> named_struct('at', b, 'len', IF(s.at <=> b, s.len + 1, 1),"
        " 'best', IF(IF(s.at <=> b, s.len + 1, 1) > s.most, b, s.best), 'most', greatest(s.most, IF(s.at <=> b, s.len + 1, 1)))"
    )
    d = d.withColumn("q", F.expr(f"CASE WHEN n > 0 THEN {q} END")).withColumn("mode", F.expr(f"(aggregate({bins}, {run}, {step}).best + 0.5D) * {MODE_BIN}D"))
    dev = "aggregate(v, struct(0D AS a, 0D AS b, 0D AS c), (s, x) -> struct(s.a + pow(x-mean,2) AS a, s.b + pow(x-mean,3) AS b, s.c + pow(x-mean,4) AS c))"
    mad = f"aggregate(v, struct(0D AS a, 0D AS b, 0D AS c), (s, x) -> struct(s.a + abs(x-mean) AS a, s.b + abs(x-q[{RANKS.index(0.5)}]) AS b, s.c + abs(x-mode) AS c))"
    # with i the place from 0: sums of x*i, x*i*(i-1), x*i*(i-1)*(i-2)
    pwm = "aggregate(v, struct(0D AS i, 0D AS a, 0D AS b, 0D AS c), (s, x) -> struct(s.i + 1 AS i, s.a + x*s.i AS a, s.b + x*s.i*(s.i-1) AS b, s.c + x*s.i*(s.i-1)*(s.i-2) AS c))"
    d = d.withColumns({"d": F.expr(dev), "m": F.expr(mad), "w": F.expr(pwm)})
    d = d.selectExpr(
        *keep, "n", "get(v, 0) AS lo", "get(v, size(v)-1) AS hi", "mean", "mode", "q", "s.b AS s2", "s.c AS s3", "d.a AS d2", "d.b AS d3", "d.c AS d4",
        "CASE WHEN n > 0 THEN m.a/n END AS aad", "CASE WHEN n > 0 THEN m.b/n END AS mad_median", "CASE WHEN n > 0 THEN m.c/n END AS mad_mode",
        "CASE WHEN n > 1 THEN w.a/(n-1)/n ELSE 0D END AS b1", "CASE WHEN n > 2 THEN w.b/((n-1)*(n-2))/n ELSE 0D END AS b2", "CASE WHEN n > 3 THEN w.c/((n-1)*(n-2)*(n-3))/n ELSE 0D END AS b3",
    )
    return _derived(d, prefix, keep)


def bundle_from_counts(df: DataFrame, keys: list[str], value: str, prefix: str) -> DataFrame:
    """The same bundle of column `value` per keys, for groups of any size: nulls are not values.

    Values are first counted (combined before the shuffle), so a group costs one row per distinct value; ranks, percentiles
    and moments come from running counts. No group is ever gathered in one array.
    """
    given, keys = keys, [f"__key{i}" for i in range(len(keys))]  # names of their own: a caller's keys may be called anything
    df = df.select(*[F.col(g).alias(k) for g, k in zip(given, keys, strict=True)], value)
    c = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("x")).agg(F.count("*").cast("double").alias("k"))
    # ranges of (keys, x), each in one part and counted on its own; what lies before a part is a sum over parts
    c = materialise(c.repartitionByRange(*keys, "x").withColumn("part", F.spark_partition_id()), "counts")
    parts = c.groupBy(*keys, "part").agg(F.sum("k").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    parts = parts.select(*keys, "part", before.alias("lead"))  # one row per part and key: never data-sized
    whole = c.groupBy(*keys).agg(F.sum("k").alias("n"), (F.sum(F.col("k") * F.col("x")) / F.sum("k")).alias("mean"))
    bins = c.groupBy(*keys, F.floor(F.col("x") / MODE_BIN).alias("bin")).agg(F.sum("k").alias("in_bin"))
    bins = bins.groupBy(*keys).agg(((F.max(F.struct("in_bin", (-F.col("bin")).alias("b")))["b"] * -1 + 0.5) * MODE_BIN).alias("mode"))
    # without keys the other side is one row
    beside = lambda a, b: a.join(b, keys) if keys else a.crossJoin(F.broadcast(b))
    c = beside(c.join(parts, [*keys, "part"]), whole)
    c = c.withColumn("upto", F.sum("k").over(Window.partitionBy(*keys, "part").orderBy("x")) + F.col("lead")).withColumn("before", F.col("upto") - F.col("k"))
    at = lambda r, f: F.max(F.when((f(F.lit(r) * (F.col("n") - 1)) >= F.col("before")) & (f(F.lit(r) * (F.col("n") - 1)) < F.col("upto")), F.col("x")))
    first = c.groupBy(*keys).agg(
        F.first("n").alias("n"), F.first("mean").alias("mean"), F.min("x").alias("lo"), F.max("x").alias("hi"),
        *[at(r, F.floor).alias(f"f{k}") for k, r in enumerate(RANKS)], *[at(r, F.ceil).alias(f"c{k}") for k, r in enumerate(RANKS)],
    )
    first = beside(first, bins)
    pos = lambda r: F.lit(r) * (F.col("n") - 1)
    q = F.array(*[F.col(f"f{k}") + (pos(r) - F.floor(pos(r))) * (F.col(f"c{k}") - F.col(f"f{k}")) for k, r in enumerate(RANKS)])
    first = first.withColumn("q", q).select(*keys, "lo", "hi", "mode", "q")
    j = beside(c, first)
    x, k, a, b, d = F.col("x"), F.col("k"), F.col("before"), F.col("upto"), F.col("x") - F.col("mean")
    # sums of i, i(i-1), i(i-1)(i-2) over places a <= i < b are differences of falling powers
    fall = lambda m, p: {2: m * (m - 1), 3: m * (m - 1) * (m - 2), 4: m * (m - 1) * (m - 2) * (m - 3)}[p] / p
    s = lambda e: F.sum(e)
    out = j.groupBy(*keys).agg(
        F.first("n").alias("n"), F.first("mean").alias("mean"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("mode").alias("mode"), F.first("q").alias("q"),
        s(k * x * x).alias("s2"), s(k * x * x * x).alias("s3"), s(k * d * d).alias("d2"), s(k * d * d * d).alias("d3"), s(k * d * d * d * d).alias("d4"),
        s(k * F.abs(d)).alias("aad"), s(k * F.abs(x - F.col("q")[RANKS.index(0.5)])).alias("mad_median"), s(k * F.abs(x - F.col("mode"))).alias("mad_mode"),
        *[s(x * (fall(b, p) - fall(a, p))).alias(f"b{p - 1}") for p in (2, 3, 4)],
    )
    n = F.col("n")
    for name in ("aad", "mad_median", "mad_mode"):
        out = out.withColumn(name, F.col(name) / n)
    under = {"b1": n - 1, "b2": (n - 1) * (n - 2), "b3": (n - 1) * (n - 2) * (n - 3)}
    for name, u in under.items():
        out = out.withColumn(name, F.when(n > int(name[1]), F.col(name) / u / n).otherwise(0.0))
    return _derived(out, prefix, [f"`{k}` AS `{g}`" for g, k in zip(given, keys, strict=True)])


def profile_area(prefix: str = "elev_") -> Column:
    """Area under the percentile curve above the minimum, by trapezoids."""
    p = [F.col(f"{prefix}p{round(100 * r):02d}") for r in RANKS]
    parts = [(RANKS[k + 1] - RANKS[k]) * ((p[k] + p[k + 1]) / 2 - F.col(f"{prefix}min")) for k in range(len(RANKS) - 1)]
    out = parts[0]
    for x in parts[1:]:
        out = out + x
    return out
