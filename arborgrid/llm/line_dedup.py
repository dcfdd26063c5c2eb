"""Removal of runs of lines that an earlier place of the corpus holds, found by hashes of windows of lines."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, partition_id, table

#: A repeated run is deleted from this many words on; windows are as few lines as hold so many.
MIN_WORDS = 30
_ID = 40  # bits of a row's number within its partition


def lines_of(text: str | None) -> list[str]:
    return text.split("\n") if text else []


def profile(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, words and place of each line with a word. Lines are equal if their words are."""
    lines = [(at, x.encode("utf-8", "surrogatepass").split()) for at, x in enumerate(lines_of(text))]
    lines = [(at, w) for at, w in lines if w]
    h = np.array([xxhash.xxh3_64_intdigest(b" ".join(w)) for _, w in lines], np.uint64).view(np.int64)
    return h, np.array([len(w) for _, w in lines], np.int64), np.array([at for at, _ in lines], np.int64)


def windows(words: np.ndarray, least: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the shortest run of lines from each place on, and up to each place, with `least` words or more.

    Any line of a run of so many words lies in one of these that the run holds whole: in the one that starts at the line,
    or, if less than `least` words follow in the run, in the one that ends at the run's end.
    """
    sums = np.r_[0, np.cumsum(words)]
    ends = np.searchsorted(sums, sums[:-1] + least)  # the window from k on is [k, ends[k])
    starts = np.searchsorted(sums, sums[1:] - least, "right") - 1  # the window up to k is [starts[k], k + 1)
    on, up = np.flatnonzero(ends <= len(words)), np.flatnonzero(starts >= 0)
    both = np.unique(np.r_[np.stack([on, ends[on]], 1), np.stack([starts[up], up + 1], 1)], axis=0)
    return both[:, 0], both[:, 1]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = 0
    for batch in batches:
        places, keys, sizes = [np.zeros((2, 0), np.int32)], array("Q"), np.zeros(batch.num_rows, np.int32)
        for k, text in enumerate(batch.column(1)):
            h, words, _ = profile(text.as_py())
            found = np.stack(windows(words)).astype(np.int32)
            places.append(found)
            keys.extend(xxhash.xxh3_64_intdigest(h[a:b].tobytes()) for a, b in found.T.tolist())
            sizes[k] = found.shape[1]
        starts, ends = np.concatenate(places, axis=1)
        offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (starts, ends, np.array(keys, np.uint64).view(np.int64))]
        rows = (partition_id() << _ID) + n + np.arange(batch.num_rows)
        n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), batch.column(0), *lists], names=["row", "doc_id", "starts", "ends", "keys"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, removed, words_removed = [], [], []
        for text, runs in zip(batch.column(1), batch.column(2), strict=True):
            text, runs = text.as_py(), runs.values
            gone = 0
            words_gone = 0
            if runs and text is not None:
                _, words, places = profile(text)
                drop = np.zeros(len(words), bool)
                for start, end in zip(runs.field("start").to_pylist(), runs.field("end").to_pylist(), strict=True):
                    drop[start:end] = True
                out = set(places[drop].tolist())
                gone, words_gone = len(out), int(words[drop].sum())
                if out:
                    text = "\n".join(x for at, x in enumerate(lines_of(text)) if at not in out)
            texts.append(text)
            removed.append(gone)
            words_removed.append(words_gone)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(removed, pa.int64()), pa.array(words_removed, pa.int64())], names=["doc_id", "text", "lines_removed", "words_removed"])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = 0
    for batch in batches:
        ids = (partition_id() << _ID) + n + np.arange(batch.num_rows)
        n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), batch.column(0), batch.column(1)], names=["row", "doc_id", "text"])


def repeated_runs(found: DataFrame) -> DataFrame:
    """row, start, end of every window that an earlier place holds. found: as _windows gives them.

    Each window's places meet its first place (smallest document, then place): as many pairs as places, whatever the
    group's size. One partner is enough, since equal windows are equal throughout; what a longer run shares only with a
    later place is in other windows, which have first places of their own. The first place is found by an aggregation that
    combines before the shuffle. In one document the first place must not reach into the later one.
    """
    spots = found.select("row", "doc_id", F.explode(F.arrays_zip("keys", "starts", "ends")).alias("p")).select("row", "doc_id", F.col("p.keys").alias("key"), F.col("p.starts").alias("start"), F.col("p.ends").alias("end"))
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row", "start")
    first = spots.groupBy("key").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").select("key", F.col("first.row").alias("row1"), F.col("first.start").alias("start1"))
    pairs = spots.join(first, "key").where("row <> row1 or start - start1 >= end - start").select("row", "start", "end")
    return materialise(pairs, "lines-pairs")


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", stable: bool = False) -> DataFrame:
    """doc_id, text without repeated runs, lines_removed, words_removed; one row per row of docs.

    A run of whole lines with MIN_WORDS words or more goes where an earlier place holds it (by doc_id, nulls last, then by
    row and line); the first place stays. Rows are numbered in the order of the scan, twice: docs is written and read back
    first unless it is `stable`, a plain file scan that gives the same partitions and order whenever it runs. White space and lines without a word do not count in comparing. Null text stays
    null, empty text empty. Repeated rows: the first keeps its text. An empty table gives an empty result.
    """
    d = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    d = d if stable else materialise(d, "lines-input")
    found = materialise(d.mapInArrow(_windows, "row long, doc_id long, starts array<int>, ends array<int>, keys array<long>"), "lines-windows")
    runs = repeated_runs(found).groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("runs"))
    full = d.mapInArrow(_numbered, "row long, doc_id long, text string").join(runs, "row", "left")
    return full.select("doc_id", "text", "runs").mapInArrow(_cut, "doc_id long, text string, lines_removed long, words_removed long")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"), stable=True)
