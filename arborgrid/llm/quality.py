"""Quality rules: surface counts and a hashed n-gram log-likelihood ratio. DataFrame and SQL functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CHARS, materialise, packed, table, unpacked

#: Cells that n-grams are hashed to; a power of two. The table of ratios is one array of so many doubles.
CELLS = 1 << 14
#: Trusted documents that the target multinomial is fitted on at most: those with the smallest hash of doc_id.
TRUSTED_LIMIT = 20_000
#: Pseudo-count of each cell, in both multinomials.
ALPHA = 1.0
#: A document is kept if its mean log-likelihood ratio per n-gram is at least this.
THRESHOLD = -0.4
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    """The words of a text; an empty array for null."""
    return F.coalesce(F.array_remove(F.split(text, SPACE), ""), F.array().cast("array<string>"))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once a row, not once for each element that a lambda inside visits."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window which the text holds twice or more, the first occurrence included.

    Windows are compared by 64-bit hashes: sorted together with their places, equal ones are neighbours.
    """

    def windows(h: Column) -> Column:
        spots = F.sequence(F.lit(0), F.size(h) - 3)
        made = F.transform(spots, lambda i: F.struct(F.xxhash64(h[i], h[i + 1], h[i + 2]).alias("h"), i.alias("p")))
        return F.when(F.size(h) < 3, F.lit(0)).otherwise(_let(F.sort_array(made), covered))

    def covered(s: Column) -> Column:
        n = F.size(s)
        same = lambda x, j: ((j > 0) & (s[F.greatest(j - 1, F.lit(0))]["h"] == x["h"])) | ((j < n - 1) & (s[F.least(j + 1, n - 1)]["h"] == x["h"]))
        places = F.sort_array(F.transform(F.filter(s, same), lambda x: x["p"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end"))
        step = lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(p, a["end"])).alias("n"), (p + 3).alias("end"))
        return F.aggregate(places, start, step, lambda a: a["n"])

    return _let(F.transform(words, lambda w: F.xxhash64(w)), windows).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACE_CHARS, "")) > 0)
    return F.coalesce(F.size(lines) - F.size(F.array_distinct(lines)), F.lit(0)).cast("long")


def cells_of(words: Column, cells: int = CELLS) -> Column:
    """The hash cells of a text's n-grams: each word, each pair of neighbouring words, each word's last three characters."""
    cell = lambda *x: F.xxhash64(*x).bitwiseAND(F.lit(cells - 1)).cast("int")

    def grams(w: Column) -> Column:
        ends = F.transform(w, lambda x: cell(F.lit(2), F.substring(x, -3, 3)))
        pairs = F.transform(w, lambda x, i: cell(x, F.coalesce(F.get(w, i + 1), F.lit(""))))
        return F.concat(F.transform(w, lambda x: cell(x)), pairs, ends)

    return _let(words, grams)


def fit_ratios(docs: DataFrame, trusted: DataFrame, text: str = "text", doc_id: str = "doc_id", cells: int = CELLS, limit: int = TRUSTED_LIMIT) -> DataFrame:
    """One row with `ratios`, array<double> of `cells` log ratios: trusted target over the raw corpus (all of docs).

    trusted: a frame with the trusted documents' ids; `limit` of them at most are used (smallest hash first), so the
    broadcast of their ids is bounded. The raw counts cover every document. Without trusted documents all ratios are 0.
    """
    ids = trusted.select(trusted[doc_id].alias("id")).where("id is not null").distinct()
    ids = ids.orderBy(F.xxhash64("id"), "id").limit(limit)
    side = docs.select(docs[doc_id].alias("doc"), docs[text].alias("text"))
    marked = side.join(F.broadcast(ids), F.col("doc") == F.col("id"), "left")
    seen = marked.select(F.explode(cells_of(words_of(F.col("text")), cells)).alias("cell"), F.col("id").isNotNull().alias("target"))
    counts = seen.groupBy("cell").agg(F.count("*").alias("raw"), F.count_if("target").alias("target"))
    every = docs.sparkSession.range(0, cells, 1, 1).select(F.col("id").cast("int").alias("cell"))
    full = every.join(counts, "cell", "left").select("cell", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))
    listed = full.agg(F.sort_array(F.collect_list(F.struct("cell", "raw", "target"))).alias("t"), F.sum("raw").alias("n_raw"), F.sum("target").alias("n_target"))
    share = lambda n, total: F.log((n + ALPHA) / (total + ALPHA * cells))
    ratio = F.transform("t", lambda x: share(x["target"], F.col("n_target")) - share(x["raw"], F.col("n_raw")))
    return materialise(listed.select(F.when(F.col("n_target") > 0, ratio).otherwise(F.array_repeat(F.lit(0.0), cells)).alias("ratios")), "quality-ratios")


def judge(docs: DataFrame, ratios: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """Every row of docs with its counts, score and verdict; no row is dropped here.

    Returns row (the input row as a struct), doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score,
    base_failed, kept. Null or empty text: all counts 0, score null, base_failed, not kept. Equal rows get equal verdicts.
    """
    lookup = ratios.select("ratios").scalar()  # one value, evaluated once: no join
    d = docs.select(packed(docs).alias("row"), docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    w = d.withColumn("words", words_of(F.col("text")))
    n = F.size("words").cast("long")
    n_chars = F.length("text")
    scored = F.aggregate(cells_of(F.col("words")), F.lit(0.0), lambda a, c: a + F.col("ratios")[c])
    out = w.withColumn("ratios", lookup).select(
        "row",
        "doc_id",
        n.alias("n_words"),
        F.coalesce(F.length(F.translate("text", SPACE_CHARS, "")), F.lit(0)).cast("long").alias("word_chars"),
        F.coalesce(n_chars - F.length(F.translate("text", SYMBOLS, "")), F.lit(0)).cast("long").alias("n_symbols"),
        duplicate_lines(F.col("text")).alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        (scored / F.when(n > 0, 3 * n)).alias("score"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.round("score", 9) >= F.lit(threshold), F.lit(False)))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The ids of documents labelled good and not toxic."""
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs."""
    return unpacked(judge(docs, fit_ratios(docs, trusted_ids(labels))).where("kept"), "row", docs.columns)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ratios = fit_ratios(docs, trusted_ids(table(spark, sf_dir, "labels")))
    return judge(docs, ratios).drop("row")


assert math.log2(CELLS).is_integer()
