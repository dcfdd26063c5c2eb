"""Jaccard self-join of documents on word n-grams: blocked sparse products of the document by n-gram incidence."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, materialise, packed, release, table, unpacked
from .graph import components

WIDTH = 4
#: Link when 100 * intersection >= PERCENT * union. These two are op5's; callers can give others.
PERCENT = 85
#: Columns of the incidence matrix are counted in so many cells, to order n-grams from rare to frequent: one byte each, at any input.
COUNT_CELLS, COUNT_PARTS = 1 << 22, 16
#: Distinct words that a Python worker keeps hashes of at most before it starts over.
WORDS_KEPT = 300_000
#: Bits of the table that marks the texts whose sets a product needs: 16 for each text, between these powers of two.
SET_BITS = (20, 28)
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0x2545F4914F6CDD1D, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


@dataclass(frozen=True)
class Limits:
    """Sizes that bound memory. They change the work's layout, never the links."""

    #: Documents of a prefix n-gram that are paired one by one; those of a more frequent one are chained in the order of size.
    whole: int = 64
    #: Set members, and documents, of a block of a product.
    block_grams: int = 1 << 16
    block_nodes: int = 1024
    #: Documents of a large group that all its blocks hold, expected.
    hubs: int = 16


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < WORDS_KEPT:
            self[word] = value
        return value


_HASHES = _Hashes()


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word n-grams; with fewer words the whole sequence is one; none if none."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    if len(_HASHES) >= WORDS_KEPT:
        _HASHES.clear()
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    k = min(width, len(h))
    grams = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        grams += h[i : i + len(grams)] * _FACTORS[i]
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(32)
    return np.unique(grams)


def signature(grams: np.ndarray) -> bytes:
    """A set as bits, 2 to 4 for each member. The bits of one set that another lacks are members that the other lacks, so
    two signatures bound the sets' overlap from above."""
    bits = 1 << max(6, int(2 * len(grams) - 1).bit_length())
    out = np.zeros(bits, np.uint8)
    out[(grams >> np.uint64(20)) & np.uint64(bits - 1)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def may_overlap(percent: int, n: int, a: bytes, m: int, b: bytes) -> bool:
    """Whether sets of n and m members with these signatures can link."""

    def folded(sig: bytes) -> int:
        bits, size = int.from_bytes(sig, "little"), len(sig) * 4
        while size >= 8 * least:
            bits, size = (bits & ((1 << size) - 1)) | (bits >> size), size // 2
        return bits

    least = min(len(a), len(b))
    x, y = folded(a), folded(b)
    most = min(n - (x & ~y).bit_count(), m - (y & ~x).bit_count())
    return (100 + percent) * most >= percent * (n + m)


def _count_cells(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often a task's n-grams fall in each cell, up to 255, in compressed parts."""
    counts, held, size = np.zeros(COUNT_CELLS, np.int32), [], 0
    for batch in batches:
        for text in batch.column(0):
            held.append((shingles(text.as_py(), width) & np.uint64(COUNT_CELLS - 1)).astype(np.int32))
            size += held[-1].size
            if size > 2_000_000:
                counts += np.bincount(np.concatenate(held), minlength=COUNT_CELLS)
                held, size = [], 0
    if held:
        counts += np.bincount(np.concatenate(held), minlength=COUNT_CELLS)
    codec, parts = pa.Codec("zstd", 1), np.minimum(counts, 255).astype(np.uint8).reshape(COUNT_PARTS, -1)
    for part in np.flatnonzero(parts.any(1)):
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([codec.compress(parts[part].tobytes(), asbytes=True)], pa.binary())], names=["part", "counts"])


def _sum_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec, size = pa.Codec("zstd"), COUNT_CELLS // COUNT_PARTS
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            c = np.frombuffer(codec.decompress(blob, size, asbytes=True), np.uint8)
            sums[part] = sums[part] + c if part in sums else c.astype(np.int64)
    for part, c in sums.items():
        rank = np.minimum(8 * np.log2(1 + c), 255).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([rank.tobytes()], pa.binary())], names=["part", "counts"])


def gram_ranks(docs: DataFrame, text: str, width: int = WIDTH) -> np.ndarray:
    """How frequent the n-grams of each hash cell are over all documents, as a logarithm: COUNT_CELLS bytes at any input.

    Every document counts. The order (rank, hash) serves as the global order of n-grams: any order gives the same links;
    rare ones first keeps the n-grams that many documents share out of the prefixes.
    """
    parts = docs.select(docs[text].alias("text")).mapInArrow(partial(_count_cells, width), "part int, counts binary")
    ranks = np.zeros((COUNT_PARTS, COUNT_CELLS // COUNT_PARTS), np.uint8)
    for r in parts.repartition(COUNT_PARTS, "part").mapInArrow(_sum_cells, "part int, counts binary").collect():  # COUNT_PARTS rows, 4 MB
        ranks[r["part"]] = np.frombuffer(r["counts"], np.uint8)
    return ranks.ravel()


def _profile(ranks, width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = ranks.value
        for batch in batches:
            rows: list = []
            for doc, text, h in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                g = shingles(text.as_py(), width)
                n = g.size
                if n:
                    keep = n - -(-percent * n // 100) + 1
                    first = np.lexsort((g, order[(g & np.uint64(COUNT_CELLS - 1)).astype(np.int64)]))[:keep]
                    node = xxhash.xxh3_64_intdigest(g.tobytes(), n) >> 1  # the set's identity: equal sets share it
                    rows.append((doc, n, h, node, signature(g), g[first].view(np.int64)))
                else:
                    rows.append((doc, 0, h, None, None, None))
            kinds = [pa.int64()] * 4 + [pa.binary(), pa.list_(pa.int64())]
            c = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds, strict=True)], names=["doc_id", "n", "h", "node", "sig", "prefix"])

    return run


def _may_link(percent: int, n: np.ndarray, at: np.ndarray, m: np.ndarray, bt: np.ndarray) -> np.ndarray:
    """Whether sets of n and m members whose first common n-gram stands at places at and bt can link: what follows it in
    either order bounds the intersection, and the sizes bound what is needed."""
    return (100 + percent) * np.minimum(n - at, m - bt) >= percent * (n + m)


def _candidates(percent: int, whole: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (gram, n, node, at) in this order: pairs (a, b) of nodes that may link, and whether the pair is `bound`.

    Of an n-gram with `whole` nodes or fewer, all pairs that sizes and places allow. The nodes of a more frequent one, and
    of a task's first and last, which others may share, are chained instead: neighbours in the order of size are bound to
    be looked at together, unless the sizes forbid a link; then they forbid it to all before and after as well. The parts
    of an n-gram in several tasks meet at an invented node. So pairs grow in proportion to the rows, whatever n-grams hold.
    """

    def pairs(g: np.ndarray, n: np.ndarray, node: np.ndarray, at: np.ndarray, first: bool, last: bool, goes_on: bool) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        lengths = np.diff(np.r_[starts, len(g)])
        chained = lengths > whole
        chained[0] |= first or goes_on
        chained[-1] |= last
        of = np.repeat(np.arange(len(starts)), lengths)
        loose = ~chained[of]
        a, b = [], []
        for d in range(1, int(lengths[~chained].max(initial=1))):
            i = np.flatnonzero((of[d:] == of[:-d]) & loose[:-d])
            i = i[_may_link(percent, n[i], at[i], n[i + d], at[i + d])]
            a.append(node[i])
            b.append(node[i + d])
        free = sum(map(len, a))
        i = np.flatnonzero((of[1:] == of[:-1]) & ~loose[1:] & (100 * n[:-1] >= percent * n[1:]))
        a.append(node[i])
        b.append(node[i + 1])
        for k in [0] * first + [len(g) - 1] * last:
            a.append(node[k : k + 1])
            b.append((g[k : k + 1] ^ 0x5DEECE66D) & 0x7FFFFFFFFFFFFFFF)
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.arange(len(a)) >= free)], names=["a", "b", "bound"])

    rest, first, goes_on = [np.zeros(0, np.int64)] * 4, True, False
    for batch in batches:
        rest = [np.concatenate([r, batch.column(k).to_numpy()]) for k, r in enumerate(rest)]
        if not rest[0].size:
            continue
        cut = int(np.searchsorted(rest[0], rest[0][-1]))  # the last n-gram may go on in the next batch
        if cut:
            yield pairs(*(x[:cut] for x in rest), first, False, goes_on)
            rest, first, goes_on = [x[cut:] for x in rest], False, False
        elif len(rest[0]) > 100_000:  # a frequent n-gram: its last row is enough to go on
            yield pairs(*rest, first, False, True)
            rest, first, goes_on = [x[-1:] for x in rest], False, True
    if rest[0].size:
        yield pairs(*rest, first, True, goes_on)


def _pruned(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with sizes and signatures (a, b, n, x, m, y) those that may link."""
    for batch in batches:
        keep = [may_overlap(percent, *v) for v in zip(*[batch.column(k).to_pylist() for k in range(2, 6)], strict=True)]
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def linked(percent: int, cross: bool, label: np.ndarray, side: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join the labels of a block's sets: a spanning forest of them.

    The block's incidence matrix is kept by columns. A product with one row accumulates that row's overlap with all others at once;
    overlaps below the bound that the sizes give are discarded, the others are links. Rows whose labels are
    joined already need no product with each other: rows outside the most common label are multiplied, until all that
    are left have one label. cross: only pairs of side 1 with side 0 are asked for, and all rows of side 1 are multiplied.
    """
    size = np.array([len(s) for s in sets], np.int64)
    column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    column = column.ravel()
    row = np.repeat(np.arange(len(sets)), size)[np.argsort(column, kind="stable")]  # rows of each column, end to end
    begin, ends = np.cumsum(count) - count, np.cumsum(size)
    own = np.unique(label, return_inverse=True)[1].ravel()
    done = np.zeros(len(sets), bool) if not cross else side == 0
    out: list[tuple[int, int]] = []
    while True:
        left = np.flatnonzero(~done)
        if cross:
            if not left.size or (own == own[0]).all():
                return out
            i = int(left[0])
        else:
            held = np.bincount(own[left])
            rare = left[own[left] != held.argmax()]
            if not rare.size:
                return out
            i = int(rare[0])
        c = column[ends[i] - size[i] : ends[i]]
        c = c[count[c] > 1]
        n = count[c]
        spots = np.repeat(begin[c] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        both = np.bincount(row[spots], minlength=len(sets))
        found = ((100 + percent) * both >= percent * (size[i] + size)) & (own != own[i])
        if cross:
            found &= side == 0
        at = np.flatnonzero(found)
        labels, first = np.unique(own[at], return_index=True)
        out += [(i, int(j)) for j in at[first]]
        own[np.isin(own, labels)] = own[i]
        done[i] = True


def _product(percent: int, cross: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, side, node, label, grams) sorted by block: links (a, b), one fewer than a block's nodes at most."""

    def links(side: list, node: list, label: list, grams: list) -> list[tuple[int, int]]:
        found = linked(percent, cross, np.array(label, np.int64), np.array(side, np.int64), [np.frombuffer(b, np.uint64) for b in grams])
        return [(node[i], node[j]) for i, j in found]

    def made(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(2)], names=["a", "b"])

    now, rows = None, ([], [], [], [])
    for batch in batches:
        out = []
        for block, *one in zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True):
            if block != now:
                if len(rows[0]) > 1:
                    out += links(*rows)
                now, rows = block, ([], [], [], [])
            for x, v in zip(rows, one, strict=True):
                x.append(v)
        if out:
            yield made(out)
    if len(rows[0]) > 1:
        yield made(links(*rows))


def _sets(sent, width: int):
    """Rows (h, grams): the sets of texts whose hash h may be wanted, by a bit table; each text once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = sent.value, set()
        for batch in batches:
            h = batch.column(0).to_numpy()
            at = (h & (len(bits) * 8 - 1)).astype(np.int64)
            rows = []
            for r in np.flatnonzero((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).tolist():
                if (key := int(h[r])) not in seen:
                    seen.add(key)
                    rows.append(r)
            texts = batch.column(1)
            yield pa.RecordBatch.from_arrays([pa.array(h[rows], pa.int64()), pa.array([shingles(texts[r].as_py(), width).tobytes() for r in rows], pa.binary())], names=["h", "grams"])

    return run


def _wanted_sets(texts: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """node, grams of the wanted nodes (node, h), from their texts (h, text). Texts do not move: a bit table of the wanted
    hashes picks them where they are read, and only their sets are shuffled, once a task however often a text occurs."""
    spark = texts.sparkSession
    bits = 1 << min(max((16 * wanted.count()).bit_length(), SET_BITS[0]), SET_BITS[1])
    spot = F.col("h").bitwiseAND(F.lit(bits - 1))
    blobs = wanted.select(F.shiftright(spot, 15).alias("p"), spot.bitwiseAND(F.lit(32767)).cast("long").alias("bit")).groupBy("p").agg(F.bitmap_construct_agg("bit").alias("m"))
    marks = np.zeros(bits // 8, np.uint8)
    for r in blobs.collect():  # 4 KB each, 32 MB at most
        marks[r["p"] * 4096 : (r["p"] + 1) * 4096] = np.frombuffer(bytes(r["m"]), np.uint8)
    found = texts.mapInArrow(_sets(spark.sparkContext.broadcast(marks), width), "h long, grams binary")
    return found.groupBy("h").agg(F.first("grams").alias("grams")).join(wanted, "h").select("node", "grams")


def _multiplied(rows: DataFrame, sets: DataFrame, percent: int, cross: bool) -> DataFrame:
    """rows: block, side, node, label. Links a, b."""
    full = rows.join(sets, "node").select("block", "side", "node", "label", "grams")
    return materialise(full.repartition("block").sortWithinPartitions("block", "node").mapInArrow(partial(_product, percent, cross), "a long, b long"), "join-links")


def _links(texts: DataFrame, members: DataFrame, width: int, percent: int, limits: Limits) -> DataFrame:
    """a, b: links that join the nodes of each group as all links do. members: node, n, h, component (the group).

    A group is one block, or if large several, by hash, that share some nodes, its hubs; each block's product is taken. If
    that leaves a large group with several labels, the nodes outside the most common one meet every block of their group
    once more, in blocks of the same size, so that every pair across labels is multiplied.
    """
    sets = materialise(_wanted_sets(texts, members.select("node", "h"), width), "join-sets")
    sizes = members.groupBy("component").agg(F.sum("n").alias("grams"), F.count("*").alias("m")).where("m > 1")
    blocks = F.greatest(F.ceil(F.col("grams") / limits.block_grams), F.ceil(F.col("m") / limits.block_nodes)).cast("int")
    sizes = materialise(sizes.select("component", "m", blocks.alias("s")), "join-sizes")
    salt = F.pmod(F.xxhash64("node"), F.col("s")).cast("int")
    dealt = members.join(sizes, "component").select("component", "node", "n", "m", "s", salt.alias("own"))
    rows = dealt.select("component", "own", "node")
    large = dealt.where("s > 1")
    hubs = large.where(F.pmod(F.xxhash64("node", F.lit(1)), F.col("m")) < limits.hubs).select("component", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("at"), "node", "own")
    rows = rows.unionAll(hubs.where("at <> own").select("component", "at", "node"))
    rows = rows.select(F.xxhash64("component", "own").alias("block"), F.lit(0).alias("side"), "node", F.col("node").alias("label"))
    links = _multiplied(rows, sets, percent, False)
    if not sizes.where("s > 1").isEmpty():
        labels = components(links)
        named = large.join(labels.withColumnRenamed("component", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
        named = materialise(named, "join-named")
        most = named.groupBy("component", "label").agg(F.count("*").alias("c")).groupBy("component").agg(F.max_by("label", F.struct("c", "label")).alias("most"))
        others = named.join(most, "component").where("label <> most")
        chunks = others.groupBy("component").agg(F.sum("n").alias("grams"), F.count("*").alias("m")).select("component", blocks.alias("t"))
        others = others.join(chunks, "component").withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(2)), F.col("t")).cast("int"))
        right = others.select("component", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("at"), "chunk", "node", "label")
        left = named.join(chunks, "component").select("component", F.col("own").alias("at"), F.explode(F.sequence(F.lit(0), F.col("t") - 1)).alias("chunk"), "node", "label")
        rows = left.withColumn("side", F.lit(0)).unionAll(right.withColumn("side", F.lit(1)))
        more = _multiplied(rows.select(F.xxhash64("component", "at", "chunk").alias("block"), "side", "node", "label"), sets, percent, True)
        both = materialise(links.unionAll(more), "join-links")
        release(links, more, named, labels)
        links = both
    release(sets, sizes)
    return links


def _labelled(docs: DataFrame, text: str, doc_id: str, width: int, percent: int, limits: Limits) -> tuple[DataFrame, DataFrame]:
    """The steps of join_components: doc_id, n, h (the text's hash) and node of each row of docs, and component (its
    smallest node) and component_id of each node."""
    spark = docs.sparkSession
    d = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    ranks = spark.sparkContext.broadcast(gram_ranks(d, "text", width))
    made = d.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(_profile(ranks, width, percent), "doc_id long, n long, h long, node long, sig binary, prefix array<long>")
    made = materialise(made, "join-prefixes")
    profile = materialise(made.select("doc_id", "n", "h", "node"), "join-profile")
    named = made.where("node is not null")
    once = named.groupBy("node").agg(F.first("prefix").alias("prefix"), F.first("n").alias("n"))
    shared = once.select("node", "n", F.posexplode("prefix").alias("at", "gram")).select("gram", "n", "node", F.col("at").cast("long").alias("at"))
    pairs = shared.repartitionByRange("gram", "n", "node").sortWithinPartitions("gram", "n", "node").mapInArrow(partial(_candidates, percent, limits.whole), "a long, b long, bound boolean")
    pairs = materialise(pairs.groupBy("a", "b").agg(F.max("bound").alias("bound")), "join-pairs")
    facts = named.groupBy("node").agg(F.first("n").alias("n"), F.min("h").alias("h"), F.first("sig").alias("sig"))
    wanted = pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct()
    facts = materialise(facts.join(wanted, "node", "left_semi"), "join-facts")
    a, b = facts.select(F.col("node").alias("a"), "n", F.col("sig").alias("x")), facts.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("sig").alias("y"))
    loose = pairs.where("not bound").select("a", "b").join(a, "a").join(b, "b").select("a", "b", "n", "x", "m", "y")
    edges = loose.mapInArrow(partial(_pruned, percent), "a long, b long").unionAll(pairs.where("bound").select("a", "b"))
    groups = components(edges)
    members = materialise(groups.join(facts.select("node", "n", "h"), "node").select("node", "n", "h", "component"), "join-members")
    release(made, pairs, facts, groups)
    links = _links(d.select(F.xxhash64("text").alias("h"), "text"), members, width, percent, limits)
    comps = components(links)
    release(members, links)
    labels = profile.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep")).join(comps, "node", "left")
    labels = labels.withColumn("component", F.coalesce("component", "node"))
    least = labels.groupBy("component").agg(F.min("rep").alias("component_id"))
    return profile, labels.join(least, "component").select("node", "component", "component_id")


def join_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH, percent: int = PERCENT, limits: Limits = Limits()) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included).

    Documents link when 100 * intersection >= percent * union of their n-grams of width words (8 at most).

    1. Count n-grams by cell (gram_ranks). 2. Of each document's set its rarest n-grams: a prefix, its length from
    the set's size, that a linked document must share one of. Documents with equal sets become one node. 3. Nodes that share a prefix
    n-gram and can link by their sizes, its places and signatures of the sets form groups (_candidates, may_overlap). 4. Each
    group's sets meet, each set once, in blocks; the block's sparse product gives the overlap of whole sets, and the links that join
    them (linked). No link between different components is lost, and none within one matters.

    Null or wordless text: n_shingles 0 and a component of its own. Very long texts are whole sets like others. Null doc_id: takes
    part; it names no component unless all of the component's ids are null. Repeated rows each get a row. Columns besides
    the two named ones play no part, whatever their names. An empty table gives an empty result.
    """
    profile, labels = _labelled(docs, text, doc_id, width, percent, limits)
    labels = labels.select("node", "component_id")
    out = profile.select("doc_id", "n", "node").join(labels, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of docs without all but one of each component: the one with the smallest doc_id stays, nulls last.

    Rows with one doc_id, or none, are told apart by the hash of the whole row; of wholly equal rows one stays. A row
    without a word is a component of its own, and stays.
    """
    profile, labels = _labelled(docs, text, doc_id, width, percent, Limits())
    node = profile.where("node is not null").groupBy("h").agg(F.max("node").alias("node"))
    full = docs.select(packed(docs).alias("row"), docs[doc_id].cast("long").alias("id"), docs[text].alias("text"))
    full = full.select("row", "id", F.xxhash64("text").alias("h"), F.xxhash64("row").alias("key"), F.coalesce(F.col("text").rlike(WORD), F.lit(False)).alias("words"))
    same = full.where("words").groupBy("h", "id", "key").agg(F.count("*").alias("n"))
    order = F.struct(F.col("id").isNull().alias("nameless"), "id", "key", "h", "n")
    # combined by text before components meet, so that many copies of a text are no large group
    first = same.groupBy("h").agg(F.min(order).alias("first")).join(node, "h").join(labels, "node").groupBy("component").agg(F.min("first").alias("first"))
    stays = materialise(first.select(F.col("first.id").alias("stay"), F.col("first.key").alias("key"), F.col("first.h").alias("h"), (F.col("first.n") > 1).alias("twice")), "join-stays")
    kept = full.where("words").join(stays, ["key", "h"]).where(F.col("id").eqNullSafe(F.col("stay")))
    once = kept.where("not twice").select("row")
    if not stays.where("twice").isEmpty():
        once = once.unionAll(kept.where("twice").groupBy("key", "h", "id").agg(F.min("row").alias("row")).select("row"))
    return unpacked(once.unionAll(full.where("not words").select("row")), "row", docs.columns)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents"))
