"""Scoring texts by a self-attention model on subword ids, beside a word-frequency base score."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lm_model as M
from .common import materialise, partition_id, release, table

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
FOLDS, HELD_OUT = 5, 1
#: The most frequent words, whose counts go to every executor: at most so many. All others meet their counts in a join.
HOT = 1 << 17
#: Each round fits the model on another share of the training documents, by hash; together the rounds visit them all.
#: A task of a round trains on about TASK_TOKENS subwords, however the input is split.
ROUNDS, TASK_TOKENS = 4, 2_000_000
#: Subwords that a task trains on at once.
STEP_TOKENS = 1_000_000
#: Subwords that a Python worker scores at once, those whose words it counts at once, and distinct words that it keeps the subwords of.
CHUNK, COUNTED, LEXICON = 300_000, 4_000_000, 250_000


def held_out(doc_id: Column) -> Column:
    """Whether a document is held out: crc32 of its id as text. A null id is a training document's."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


class _Pieces(dict):
    """Words of a worker to their packed subword ids, begun anew when it holds LEXICON of them."""

    def __init__(self, encode, kind: str):
        super().__init__()
        self.encode, self.kind = encode, kind

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= LEXICON:
            self.clear()
        ids = self[word] = array(self.kind, self.encode(word)).tobytes()
        return ids


def _ids(path: str):
    """Rows (doc_id, held_out, spread, ids): a text's subword ids with an end id after them, two bytes each, or four in a large vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = M.encoder(path)
        pieces = _Pieces(encode, _kind(end))
        last = array(_kind(end), [end]).tobytes()
        for batch in batches:
            rows = [b"".join(map(pieces.__getitem__, text.as_py().lower().split())) + last if text.is_valid else last for text in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rows, pa.binary())], names=["doc_id", "held_out", "spread", "ids"])

    return run


def subwords(texts: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, held_out, spread, ids of texts (doc_id, held_out, spread, text)."""
    given = texts.select("doc_id", "held_out", "spread", F.col("text").cast("binary"))
    return given.mapInArrow(_ids(tokenizer), "doc_id long, held_out boolean, spread long, ids binary")


def _kind(end: int) -> str:
    return "H" if end < 1 << 16 else "I"


def _mixed(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of splitmix64."""
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words:
    """Words out of subword ids. A word is encoded with a space before it and has none inside, so a subword that begins with
    a space begins a word; the end is a word of its own. A word's subwords are its bytes, so a hash of them is one of the word."""

    def __init__(self, path: str):
        self.first = M.word_starts(path)
        self.of_id = _mixed(np.arange(1, len(self.first) + 1))
        self.of_place = np.zeros(0, np.uint64)

    def __call__(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words start, and their 64-bit hashes: sums of a number by subword times an odd one by place."""
        starts = np.flatnonzero(self.first.take(ids))
        if not len(starts):
            return starts, np.zeros(0, np.int64)
        lengths = np.diff(starts, append=len(ids))
        if lengths.max() > len(self.of_place):
            self.of_place = _mixed((1 << 32) + np.arange(2 * lengths.max())) | np.uint64(1)
        place = np.arange(len(ids)) - np.repeat(starts, lengths)
        return starts, _mixed(np.add.reduceat(self.of_id.take(ids) * self.of_place.take(place), starts)).view(np.int64)


def _counts(path: str):
    """Hash and count of each word, the end included, combined for COUNTED subwords at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(path)
        kind = _kind(len(words.first) - 1)

        def made(held: list[bytes]) -> pa.RecordBatch:
            hashes, counts = np.unique(words(np.frombuffer(b"".join(held), kind))[1], return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(counts.astype(np.int64))], names=["word", "c"])

        held, size = [], 0
        for batch in batches:
            for ids in batch.column(0).to_pylist():
                held.append(ids)
                size += len(ids)
                if size >= COUNTED * np.dtype(kind).itemsize:
                    yield made(held)
                    held, size = [], 0
        if held:
            yield made(held)

    return run


def word_counts(ids: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """word (64-bit hash), c over all rows of ids (one column), the end included."""
    return ids.mapInArrow(_counts(tokenizer), "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _subword_counts(end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(end + 1, np.int64)
        for batch in batches:
            counts += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), _kind(end)), minlength=end + 1)
        if counts.any():
            yield _blob(counts.sum(), counts.astype("<i8").tobytes())

    return run


def _blob(weight, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([partition_id()], pa.int64()), pa.array([float(weight)], pa.float64()), pa.array([data], pa.binary())], names=["part", "weight", "data"])


_BLOB = "part long, weight double, data binary"


def _summed(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = None, 0.0
        for batch in batches:
            for w, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                x = np.frombuffer(data, kind).astype("<f8")
                total, weight = (x if total is None else total + x), weight + w
        if total is not None:
            yield _blob(weight, total.tobytes())

    return run


def _total(blobs: DataFrame, kind: str) -> tuple[float, np.ndarray | None]:
    """Sum of weights and arrays over all tasks: first in 16 groups, so that the driver gets 16 rows at any input."""
    rows = sorted(blobs.repartition(16, "part").mapInArrow(_summed(kind), _BLOB).collect(), key=lambda r: r["part"])
    if not rows:
        return 0.0, None
    return sum(r["weight"] for r in rows), np.sum([np.frombuffer(r["data"], "<f8") for r in rows], axis=0)


def _fitted(end: int, sent, seed: int):
    """Train on this task's documents from the common weights; return the weights times the tokens seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        M.keep_memory()
        v = M.Vocabulary(sent.value["counts"])
        p, seen, texts, held = M.unpacked_params(sent.value["params"], v), 0, [], 0

        def step() -> None:
            nonlocal p, seen, texts, held
            tokens = np.concatenate(texts).astype(np.int64)
            p, _ = M.train(p, v, tokens, np.array(list(map(len, texts)), np.int64), seed=seed)
            seen, texts, held = seen + len(tokens), [], 0

        for batch in batches:
            for ids in batch.column(0).to_pylist():
                texts.append(np.frombuffer(ids, _kind(end)))
                held += len(texts[-1])
                if held >= STEP_TOKENS:
                    step()
        if texts:
            step()
        if seen:
            yield _blob(seen, (np.frombuffer(M.packed_params(p), "<f4").astype("<f8") * seen).tobytes())

    return run


def fit(train: DataFrame, tokenizer: str = TOKENIZER, rounds: int = ROUNDS, task_tokens: int = TASK_TOKENS) -> dict:
    """The model of texts (columns text, spread: a hash), as fit_ids makes it of their subwords."""
    none = F.lit(None)
    ids = materialise(subwords(train.select(none.cast("long").alias("doc_id"), none.cast("boolean").alias("held_out"), "spread", "text"), tokenizer), "lm-ids")
    model = fit_ids(ids, M.encoder(tokenizer)[1], rounds, task_tokens)
    release(ids)
    return model


def fit_ids(ids: DataFrame, end: int, rounds: int = ROUNDS, task_tokens: int = TASK_TOKENS) -> dict:
    """`params` (the model's weights, packed) and `counts` (of all subwords) from texts as subwords (columns ids, spread: a hash).

    The counts are those of all documents. Each round takes another share of the documents, and each document is in one.
    A round's documents are dealt out by hash to tasks of about task_tokens subwords. Every task trains on its own part
    from the same weights; the mean of theirs, by tokens, starts the next round. A task holds STEP_TOKENS and one text.
    """
    spark = ids.sparkSession
    size, counts = _total(ids.select("ids").mapInArrow(_subword_counts(end), _BLOB), "<i8")
    counts = counts if counts is not None else np.ones(end + 1)
    v = M.Vocabulary(counts)
    p = M.packed_params(M.initial(v))
    tasks = max(1, round(size / rounds / task_tokens))
    for k in range(rounds):
        sent = spark.sparkContext.broadcast({"params": p, "counts": counts})
        part = ids.where(F.pmod("spread", F.lit(rounds)) == k).repartition(tasks, "spread").select("ids")
        seen, total = _total(part.mapInArrow(_fitted(end, sent, k), _BLOB), "<f8")
        if seen:
            p = (total / seen).astype("<f4").tobytes()
    return {"params": p, "counts": counts}


def _score(path: str, sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        M.keep_memory()
        g = sent.value
        vocabulary = M.Vocabulary(g["model"]["counts"])
        p, below, hot = M.unpacked_params(g["model"]["params"], vocabulary), g["n"] + 0.5 * (g["v"] + 1), g["words"]
        words = _Words(path)
        kind = np.dtype(_kind(len(words.first) - 1))
        row = partition_id() << 40
        pending: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal pending, held, row
            tokens = np.frombuffer(b"".join([x[2] for x in pending]), kind)
            per_text = np.array([len(x[2]) // kind.itemsize for x in pending], np.int64)
            text_starts = np.cumsum(per_text) - per_text  # a text has its end at least
            model = np.add.reduceat(M.score(p, vocabulary, tokens.astype(np.int64), per_text), text_starts, dtype=np.float64) / np.log(10)
            word_starts, hashes = words(tokens)
            starts = np.searchsorted(word_starts, text_starts)
            hashes, ids = np.unique(hashes, return_inverse=True)
            at = np.searchsorted(hot, hashes)
            at[at == len(hot)] = 0
            c = np.where(hot[at] == hashes, g["hot"][at], -1) if len(hot) else np.full(len(hashes), -1)  # -1: not a frequent word
            base = np.add.reduceat(np.where(c >= 0, np.log10((np.maximum(c, 0) + 0.5) / below), 0.0)[ids], starts)
            known = np.add.reduceat((c > 0).astype(np.int64)[ids], starts)
            # words whose counts are met in a join: each once a text, with how often
            rare = np.flatnonzero((c < 0)[ids])
            text_of = np.searchsorted(starts, rare, "right") - 1
            pairs, times = np.unique(text_of * len(hashes) + ids[rare], return_counts=True)
            rare_text, rare_word = np.divmod(pairs, len(hashes))
            offsets = pa.array(np.searchsorted(rare_text, np.arange(len(pending) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (hashes[rare_word], times.astype(np.int32))]
            sizes = np.diff(starts, append=len(ids))
            columns = [pa.array(row + np.arange(len(pending))), pa.array([x[0] for x in pending], pa.int64()), pa.array([x[1] for x in pending], pa.bool_()), pa.array(sizes), pa.array(known), pa.array(base), pa.array(model), *lists]
            row += len(pending)
            pending, held = [], 0
            return pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "rare", "times"])

        for batch in batches:
            for x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pending.append(x)
                held += len(x[2])
                if held >= CHUNK * kind.itemsize:
                    yield flush()
        if pending:
            yield flush()

    return run


def score_texts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of docs.

    Word counts cover all training documents, and the attention model is trained on all of them. score is the model's
    log10 probability of the whole text: the sum over its subwords, the end included, in overlapping windows. Null, empty and
    blank texts have the end token only; very long texts are scored whole. Repeated rows repeat. Columns besides the two named ones play
    no part, whatever their names. Without training documents every count is 0 and the model is the untrained one. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    d = docs.select(docs[doc_id].cast("long").alias("doc_id"), held_out(docs[doc_id]).alias("held_out"), docs[text].alias("text"))
    ids = materialise(subwords(d.withColumn("spread", F.xxhash64("doc_id", "text", F.lit(11))), tokenizer), "lm-ids")
    train = ids.where("not held_out").select("spread", "ids")
    counts = materialise(word_counts(train.select("ids"), tokenizer), "lm-counts")
    n_tokens, n_kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    size = F.floor(F.log2("c") * 8).cast("int").alias("size")
    by_size = sorted(counts.groupBy(size).agg(F.count("*").alias("n"), F.min("c").alias("least")).collect(), reverse=True)  # 512 rows at most
    room, least = HOT, None
    for r in by_size:
        if r["n"] > room:
            break
        room, least = room - r["n"], r["least"]
    hot = counts.where(F.col("c") >= (least if least is not None else 1 << 62)).toArrow()  # HOT rows at most
    order = np.argsort(hot.column("word").to_numpy())
    model = fit_ids(train, M.encoder(tokenizer)[1])
    given = {"model": model, "n": int(n_tokens), "v": int(n_kinds), "words": hot.column("word").to_numpy()[order], "hot": hot.column("c").to_numpy()[order]}
    sent = spark.sparkContext.broadcast(given)
    kinds = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, rare array<long>, times array<int>"
    scored = materialise(ids.select("doc_id", "held_out", "ids").mapInArrow(_score(tokenizer, sent), kinds), "lm-scored")
    release(ids)
    below = F.lit(given["n"] + 0.5 * (given["v"] + 1))
    cold = counts.where(F.col("c") < (least if least is not None else 1 << 62))
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    c = F.coalesce("c", F.lit(0))
    sums = [F.sum(F.col("times") * F.log10((c + 0.5) / below)).alias("rest"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more")]
    rest = rare.join(cold, "word", "left").groupBy("row").agg(*sums)
    out = scored.join(rest, "row", "left")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"),
        F.lit(given["n"]).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"),
        "score",
    )


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
