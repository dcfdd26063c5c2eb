"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, n_words, packed, table, unpacked

#: Documents that one task orders at most before the key range is split once more.
GROUP_LIMIT = 50_000
#: Ranges that each level of the search splits the sampling keys into.
BUCKETS = 1024
#: Words of a source that the mix takes at most, as a multiple of its size.
MAX_EPOCHS = 3


def quality_weight(text: Column) -> Column:
    """A document's sampling weight, in (0, 1]: the share of its characters that are not symbols, squared; null is 1."""
    n = F.length(text)
    symbols = n - F.length(F.translate(text, "#*$%&|<>!{}[]=", ""))
    return F.coalesce(F.pow(1.0 - symbols / F.greatest(n, F.lit(1)), 2.0) * 0.9 + 0.1, F.lit(1.0))


def source_targets(sizes: DataFrame, total: Column | None = None) -> DataFrame:
    """Columns source, source_size, target from one row per source.

    Weights 1, 2, 3, 1, ... by code point, null last. The words are shared by weight; no target is above MAX_EPOCHS
    times its source's size. With r = MAX_EPOCHS * size / weight, sources are full in the order of r, so one ordered
    pass finds the level at which the rest share: no iteration. One row per source goes through one task.
    """
    by_name, by_fill = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("r", F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    w = sizes.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double"))
    w = w.withColumn("total", (total if total is not None else F.sum("source_size").over(whole)).cast("double"))
    w = w.withColumn("cap", F.col("source_size") * float(MAX_EPOCHS)).withColumn("r", F.col("cap") / F.col("weight"))
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    w = w.withColumn("weight_left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    w = w.withColumn("level", (F.col("total") - F.col("cap_before")) / F.col("weight_left"))
    # the first source that is not full has the level of all that follow
    level = F.coalesce(F.min(F.when(F.col("level") <= F.col("r"), F.struct("r", "level"))).over(whole)["level"], F.lit(float("inf")))
    return w.withColumn("target", F.least("cap", level * F.col("weight"))).select("source", "source_size", "target")


def _boundary(items: DataFrame, need: DataFrame) -> DataFrame:
    """For each source, the key below which documents are taken.

    items: source, key in [0, 1), size. need: source, rest. Returns source, lo, hi, base: documents with key < lo are
    taken whole (base words), those >= hi are not, those between are decided one by one. Each level splits one range of
    each source into BUCKETS and keeps the one that the budget ends in, until no such range holds over GROUP_LIMIT documents.
    """
    state = need.select("source", "rest", F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"), F.lit(0).cast("long").alias("base"))
    while True:
        s = state.select(F.col("source").alias("s"), "rest", "lo", "hi", "base")
        inside = items.join(s, items["source"].eqNullSafe(s["s"])).where((F.col("key") >= F.col("lo")) & (F.col("key") < F.col("hi")))
        at = F.floor((F.col("key") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BUCKETS).cast("int")
        counted = inside.groupBy("source", at.alias("b"), "rest", "lo", "hi", "base").agg(F.sum("size").alias("words"), F.count("*").alias("docs"))
        upto = Window.partitionBy("source").orderBy("b")
        run = counted.withColumn("upto", F.sum("words").over(upto) + F.col("base"))
        # the first range at whose end the budget is reached; none: everything is taken
        first = F.min(F.when(F.col("upto") >= F.col("rest"), F.struct("b", "upto", "words", "docs")))
        found = run.groupBy("source", "rest", "lo", "hi", "base").agg(first.alias("f"), F.max("upto").alias("all"))
        step = (F.col("hi") - F.col("lo")) / BUCKETS
        state = materialise(
            found.select(
                "source",
                "rest",
                F.when(F.col("f").isNull(), F.col("hi")).otherwise(F.col("lo") + F.col("f.b") * step).alias("lo"),
                F.when(F.col("f").isNull(), F.col("hi")).otherwise(F.col("lo") + (F.col("f.b") + 1) * step).alias("hi"),
                F.when(F.col("f").isNull(), F.col("all")).otherwise(F.col("f.upto") - F.col("f.words")).alias("base"),
                F.coalesce(F.col("f.docs"), F.lit(0)).alias("docs"),
            ),
            "mix-range",
        )
        if not state.where((F.col("docs") > GROUP_LIMIT) & (F.col("hi") - F.col("lo") > 1e-12)).limit(1).count():
            return state.select("source", "rest", "lo", "hi", "base")


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weight: Column | None = None, seed: int = 17) -> DataFrame:
    """Decide how many times the mix takes each row of docs.

    Each source fills its target (source_targets) first with complete epochs, floor(target / size), then with a weighted
    sample without replacement: key = -ln(u) / weight with u from a hash of id, text and seed; documents in key order as
    long as they fit, then the one document whose size closes the gap best. Documents are taken whole.

    Returns row (the whole input row as a struct), doc_id, source, size, source_size, target, copies, taken. Null text: 0
    words, so never taken. Null source: a source of its own, last. Rows equal in id
    and text have equal keys and may be taken together. An empty table gives an empty result. Reruns agree.
    """
    t, s, i = docs[text], docs[source], docs[doc_id]
    u = (F.shiftrightunsigned(F.xxhash64(i, t, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    w = weight if weight is not None else quality_weight(t)
    e = -F.log(u) / w
    key = e / (1.0 + e)  # the exponential keys, mapped to [0, 1) in the same order
    keyed = docs.select(i.alias("id"), s.alias("source"), n_words(t).alias("size"), key.alias("key"), packed(docs).alias("row"))
    items = materialise(keyed.select("id", "source", "size", "key"), "mix-items")
    targets = materialise(source_targets(items.groupBy("source").agg(F.sum("size").alias("source_size"))), "mix-targets")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = targets.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    sized = items.where("size > 0")
    edge = _boundary(sized, plan.where("source_size > 0").select("source", "rest"))
    # inside the last range, one by one; few documents of each source
    e = edge.select(F.col("source").alias("s"), "rest", "lo", "hi", "base")
    last = sized.join(e, sized["source"].eqNullSafe(e["s"])).where((F.col("key") >= F.col("lo")) & (F.col("key") < F.col("hi")))
    order = Window.partitionBy("source").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("before", F.col("base") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    fits = last.withColumn("upto", F.col("before") + F.col("size")).where("upto <= rest")
    cut = fits.groupBy("source").agg(F.max(F.struct("key", "id", "size")).alias("last"), F.max("upto").alias("upto"))
    c = cut.select(F.col("source").alias("s2"), "last", "upto")
    p = plan.withColumnRenamed("source", "s")
    p = p.join(e.select(F.col("s").alias("s1"), "lo", "hi", "base"), p["s"].eqNullSafe(F.col("s1")), "left").drop("s1")
    p = p.join(c, p["s"].eqNullSafe(c["s2"]), "left").drop("s2")
    p = materialise(p.withColumn("gap", F.col("rest") - F.coalesce("upto", "base")), "mix-plan")
    # one more document of each source closes the gap: the one whose size comes nearest, if it helps at all
    left = sized.join(p, sized["source"].eqNullSafe(p["s"])).where(~_taken() & (F.abs(F.col("size") - F.col("gap")) < F.col("gap")))
    fill = left.groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "key", "id", "size")).alias("fill"))
    f = fill.select(F.col("source").alias("s3"), "fill")
    p = p.join(f, p["s"].eqNullSafe(f["s3"]), "left")
    p = p.select("s", "source_size", "target", "epochs", "lo", "hi", "last", F.struct("fill.key", "fill.id", "fill.size").alias("fill"))
    p = F.broadcast(p) if _small(p) else p
    out = keyed.join(p, keyed["source"].eqNullSafe(p["s"]), "left")
    extra = _taken() | F.struct("key", "id", "size").eqNullSafe(F.col("fill"))
    copies = F.when(F.col("size") > 0, F.col("epochs") + F.when(extra, 1).otherwise(0)).otherwise(0).cast("long")
    return out.select("row", F.col("id").alias("doc_id"), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def _taken() -> Column:
    """Whether a document lies before the end of its source's budget in key order."""
    inside = (F.col("key") < F.col("hi")) & (F.struct("key", "id", "size") <= F.col("last"))
    return F.coalesce((F.col("key") < F.col("lo")) | inside, F.lit(False))


def _small(plan: DataFrame, most: int = 100_000) -> bool:
    """Whether the per-source plan has at most `most` rows; only then is it broadcast."""
    return plan.limit(most + 1).count() <= most


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of docs as often as mix() takes it, with the columns of docs."""
    taken = mix(docs, **options).where("copies > 0")
    return unpacked(taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")), "row", docs.columns)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")
