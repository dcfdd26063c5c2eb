"""Benchmark decontamination: a BM25 index of test items, searched with block-max WAND by every training passage."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import packed, table, unpacked

K1, B = 1.2, 0.75
#: A passage retrieves an item if its BM25 score is at least this share of the item's score against itself.
RETRIEVE = 0.6
#: Share of the question's, and of the answer's, word n-grams that a retrieved passage must hold.
OVERLAP = 0.8
WIDTH = 5
#: Blocks of item numbers that an index has at most. The largest impact of each term in each block bounds what it can add.
BLOCKS = 32
#: Characters of items that one index holds at most. More items make several indexes, each searched by every passage.
INDEX_CHARS = 1_000_000
#: Distinct words whose normal form a Python worker remembers at most.
WORDS_KEPT = 500_000
_EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\u00ab\u00bb\u201c\u201d\u2018\u2019\u2026\u2013\u2014\u00bf\u00a1"
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def normal(word: str) -> str:
    """A word without case and without punctuation at its ends; the word itself if nothing else is left."""
    return word.strip(_EDGE).lower() or word


def words(text: str | None) -> list[str]:
    return [normal(w) for w in (text or "").split()]


def parts(text: str | None) -> tuple[list[str], list[str]]:
    """An item's question and answer: its last sentence is the answer; an item of one sentence has no answer."""
    pieces = [p for p in _SENTENCE.split(text or "") if p.strip()]
    return words(" ".join(pieces[:-1]) if len(pieces) > 1 else " ".join(pieces)), words(pieces[-1] if len(pieces) > 1 else "")


def grams(tokens: list, width: int = WIDTH) -> set:
    k = min(width, len(tokens))
    return {tuple(tokens[i : i + k]) for i in range(len(tokens) - k + 1)} if k else set()


class _Terms(dict):
    """From a word as written to the number of its normal form, 0 for a word that no item has; remembers WORDS_KEPT."""

    def __init__(self, numbers: dict[str, int]):
        super().__init__()
        self.numbers = numbers

    def __missing__(self, word: str) -> int:
        got = self.numbers.get(normal(word), 0)
        if len(self) < WORDS_KEPT:
            self[word] = got
        return got

    def __reduce__(self):
        return _Terms, (self.numbers,)


@dataclass
class Index:
    """Impacts are divided by the item's score against itself, so that one threshold holds for all items."""

    terms: _Terms
    items: list[int | None]
    postings: list[list[tuple[int, float]]]  # of each term, by item number
    width: int  # items of a block
    most: np.ndarray  # of each term and block, the largest impact
    best: np.ndarray  # of each term, the largest impact
    questions: list[set]
    answers: list[set]
    longest: int


@dataclass
class Facts:
    """What an item's scores and the passages' length depend on besides the item: of all items, however many indexes they make."""

    n: int
    mean: float
    df: Counter
    longest: int


def facts_of(texts: Iterable[str | None]) -> Facts:
    n = total = 0
    df, longest = Counter(), 1
    for text in texts:
        if here := words(text):
            n, total, longest = n + 1, total + len(here), max(longest, len(here))
            df.update(set(here))
    return Facts(n, total / max(1, n), df, longest)


def build(items: list[tuple[int | None, str | None]], facts: Facts | None = None) -> Index:
    """Items with a null or wordless text are left out: nothing can contain them. facts: of all items, if these are a part."""
    facts = facts or facts_of(t for _, t in items)
    kept = [(i, words(t), *parts(t)) for i, t in items]
    kept = [x for x in kept if x[1]]
    n, mean, df = facts.n, facts.mean, facts.df
    terms = {t: k for k, t in enumerate(sorted({t for x in kept for t in x[1]}), 1)}  # 0: a word that no item has
    postings: list[list[tuple[int, float]]] = [[] for _ in range(len(terms) + 1)]
    for at, x in enumerate(kept):
        tf = Counter(x[1])
        impact = {t: np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(x[1]) / mean)) for t, c in tf.items()}
        total = sum(impact.values())
        for t, v in impact.items():
            postings[terms[t]].append((at, float(v / total)))
    width = max(4, -(-len(kept) // BLOCKS))
    most = np.zeros((len(postings), -(-max(1, len(kept)) // width)), np.float32)
    for t, p in enumerate(postings):
        for at, v in p:
            most[t, at // width] = max(most[t, at // width], v * 1.000001)  # rounded up
    as_ids = lambda x: [terms[t] for t in x]
    return Index(_Terms(terms), [x[0] for x in kept], postings, width, most, most.max(1), [grams(as_ids(x[2])) for x in kept], [grams(as_ids(x[3])) for x in kept], facts.longest)


def search(index: Index, query: np.ndarray, least: float = RETRIEVE) -> list[tuple[int, float]]:
    """All items whose score for the distinct terms of the query is at least `least`, by block-max WAND.

    Cursors move over the postings in item order. The pivot is the first item that the terms' largest impacts could bring
    to the threshold; blocks whose own largest impacts cannot are skipped whole.
    """
    out: list[tuple[int, float]] = []
    low = least - 1e-6  # sums in another order may differ by rounding
    allowed = index.most[query].sum(0) >= low
    if not allowed.any():
        return out
    ends = np.flatnonzero(allowed)

    def ahead(item: int) -> int:
        """The first item from here on in a block that may reach the threshold."""
        block = item // index.width
        if block < len(allowed) and allowed[block]:
            return item
        k = int(np.searchsorted(ends, block))
        return int(ends[k]) * index.width if k < len(ends) else len(index.items)

    cursors = [[0, t] for t in query.tolist()]
    here = lambda c: index.postings[c[1]][c[0]][0]
    floor = ahead(0)
    while True:
        for c in cursors:
            if c[0] < len(index.postings[c[1]]) and here(c) < floor:
                c[0] = bisect_left(index.postings[c[1]], (floor,), c[0])
        cursors = sorted((c for c in cursors if c[0] < len(index.postings[c[1]])), key=here)
        bound, pivot = 0.0, None
        for c in cursors:
            bound += float(index.best[c[1]])
            if bound >= low:
                pivot = here(c)
                break
        if pivot is None:
            return out
        at = ahead(pivot)
        if at == pivot:
            if here(cursors[0]) == pivot:
                score = sum(index.postings[c[1]][c[0]][1] for c in cursors if here(c) == pivot)
                if score >= low:
                    out.append((pivot, score))
                floor = ahead(pivot + 1)
            else:
                floor = pivot
        else:
            floor = at
        if floor >= len(index.items):
            return out


def matches(index: Index, text: str | None) -> dict[int, tuple[float, float, float]]:
    """For each item that a passage of the text holds: best score, question and answer overlap.

    Passages are windows of twice the longest item's words, half of which the next one shares, so that any stretch as
    long as an item lies whole in one. Each passage is searched unless its terms' block maxima, summed over both halves,
    stay below the threshold in every block: the search's own bound, computed for all passages of a text at once.
    """
    words_here = text.split() if text else []
    t = np.fromiter(map(index.terms.__getitem__, words_here), np.int64, len(words_here))
    at = np.flatnonzero(t)
    if not at.size or not index.items:
        return {}
    step = index.longest
    pairs = np.unique(at // step * len(index.postings) + t[at])  # the distinct terms of each half
    half, term = np.divmod(pairs, len(index.postings))
    first = np.flatnonzero(np.r_[True, half[1:] != half[:-1]])
    sums = np.zeros((int(half[-1]) + 2, index.most.shape[1]), np.float32)
    sums[half[first]] = np.add.reduceat(index.most[term], first, axis=0)
    found: dict[int, tuple[float, float, float]] = {}
    for k in np.flatnonzero(((sums[:-1] + sums[1:]) >= RETRIEVE - 1e-6).any(1)).tolist():
        passage = t[k * step : (k + 2) * step]
        query = np.unique(passage)
        got = search(index, query[query > 0])
        if got:
            tokens = passage.tolist()
            sets: dict[int, set] = {}
            for item, score in got:
                share = []
                for want in (index.questions[item], index.answers[item]):
                    n = len(next(iter(want))) if want else 0
                    if n and n not in sets:
                        sets[n] = {tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1)}
                    share.append(len(want & sets[n]) / len(want) if n else 1.0)
                if min(share) >= OVERLAP:
                    found[item] = max(found.get(item, (0.0, 0.0, 0.0)), (round(score, 6), *share))
    return found


def _scan(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            rows = [(doc, index.items[k], *v) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for k, v in sorted(matches(index, text.as_py()).items())]
            c = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds, strict=True)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return run


def indexes(items: DataFrame, text: str = "text", item_id: str = "item_id") -> Iterator[Index]:
    """Indexes of the items, each of INDEX_CHARS characters at most (or of one item), read one after another.

    Document frequencies, mean and longest length are those of all items, so that scores do not depend on the parts.
    """
    side = items.select(items[item_id].cast("long").alias("id"), items[text].alias("text"))
    chars = side.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-2 * chars // INDEX_CHARS))
    facts = None if n == 1 else facts_of(r["text"] for r in side.select("text").toLocalIterator())
    for k in range(n):
        some = side if n == 1 else side.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        yield build([(r["id"], r["text"]) for r in some.orderBy("id", "text").collect()], facts)


def find(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Rows doc_id, item_id, score, question_overlap, answer_overlap: every item that a passage of a document holds.

    The index goes to every executor; its size is bounded by INDEX_CHARS, and more items are searched index by index.
    Null or empty text: no rows. Null doc_id: rows with a null id. Repeated rows repeat. Empty tables: no rows.
    """
    spark = docs.sparkSession
    d = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    out = None
    for index in indexes(items):
        one = d.mapInArrow(_scan(spark.sparkContext.broadcast(index)), "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")
        out = one if out is None else out.unionAll(one)
    return out


def keep_clean(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that hold no item, with the columns of docs. One pass, no shuffle."""
    full = docs.select(packed(docs).alias("row"), docs[text].alias("_text"))
    for index in indexes(items, "text"):
        full = full.select("row", "_text").mapInArrow(_keep(docs.sparkSession.sparkContext.broadcast(index)), full.schema)
    return unpacked(full, "row", docs.columns)


def _keep(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not matches(sent.value, t.as_py()) for t in batch.column(1)], pa.bool_()))

    return run


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
