"""WARC archives with a two-level capture index: compressed blocks of sorted keys under a sparse directory."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, new_folder, partition_id, release, table

#: Payloads from this many bytes on are stored once; later equal ones are revisit records.
REVISIT_FROM = 1000
#: Bytes after which a task begins another archive; index entries in a block.
ARCHIVE_BYTES, BLOCK_ENTRIES = 64 << 20, 1000
#: Rows of the directory, one a block, that a search sends to the tasks at once; a larger directory takes several passes.
DIRECTORY_ROWS = 200_000
_ENTRY = "key string, page_id long, file string, offset long, length long"
_BLOCK = "first string, last string, file string, offset long, length long, entries long"
_CAPTURE = "key string, url string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def surt(url: str | None) -> str:
    """A key that sorts a host's pages together: reversed host, then path and query; without scheme, user, port, fragment."""
    try:
        parts = urlsplit(url or "")
        host, path = parts.hostname or "", (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    except ValueError:  # not a URL: its own text is the key
        return url or ""
    return f"{','.join(reversed(host.split('.')))}){path}" if host else (url or "")


@F.pandas_udf(T.StringType())
def _keys(urls: pd.Series) -> pd.Series:
    return urls.map(lambda u: surt(None if u is None or u != u else u))


def _header(kind: str, fields: list[tuple[str, str]], body: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member. A revisit keeps the response's HTTP header, with its Content-Length, but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    clean = lambda s: "".join(f"%{b:02X}" if b < 33 or b == 127 else chr(b) for b in s.encode("utf-8", "surrogatepass"))
    fields = [("WARC-Record-ID", f"<urn:page:{'null' if page_id is None else page_id}>"), ("WARC-Date", "2000-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if url is not None:
        fields.insert(0, ("WARC-Target-URI", clean(url).encode("latin-1").decode("utf-8", "surrogateescape")))
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        raw = _header("revisit", fields, http)
    else:
        raw = _header("response", fields, http + payload)
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def parse(member: bytes) -> dict:
    """A record's fields and payload from its gzip member; the digest of a response is made anew and must agree."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda s: None if s in (None, "<urn:page:null>") else int(s[10:-1])
    digest, kind = fields["WARC-Payload-Digest"][5:], fields["WARC-Type"]
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    return {"url": fields.get("WARC-Target-URI"), "page_id": number(fields["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number(fields.get("WARC-Refers-To")), "payload": payload if kind == "response" else None}


def _write(folder: str):
    """Rows page_id, url, html, digest, refers_to, key to archives; each attempt of a task writes files of its own name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for page, url, html, digest, refers, key in zip(*[batch.column(k).to_pylist() for k in range(6)], strict=True):
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"pages-{partition_id():06d}-{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{path}/{name}", compression=None)
                    one = record(page, url, html.encode("utf-8", "surrogatepass"), digest, refers)
                    out.write(one)
                    rows.append((key, page, name, at, len(one)))
                    at += len(one)
                yield _rows(rows, [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()], ["key", "page_id", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return run


def _rows(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    c = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds, strict=True)], names=names)


def _index(folder: str):
    """Sorted entries to compressed blocks of one file per task; returns the directory: one row per block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        name, out, at, held, rows = f"index-{partition_id():06d}-{uuid.uuid4().hex}", None, 0, [], []

        def flush() -> None:
            nonlocal out, at, held
            out = out or store.open_output_stream(f"{path}/{name}", compression=None)
            sink = pa.BufferOutputStream()
            block = _rows(held, [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()], ["key", "page_id", "file", "offset", "length"])
            with pa.ipc.new_stream(sink, block.schema) as w:
                w.write_batch(block)
            packed = zlib.compress(sink.getvalue().to_pybytes(), 4)
            out.write(packed)
            rows.append((held[0][0], held[-1][0], name, at, len(packed), len(held)))
            at, held = at + len(packed), []

        for batch in batches:
            for entry in zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True):
                held.append(entry)
                if len(held) >= BLOCK_ENTRIES:
                    flush()
        if held:
            flush()
        if out is not None:
            out.close()
        yield _rows(rows, [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()], ["first", "last", "file", "offset", "length", "entries"])

    return run


def _entries(store, path: str, file: str, offset: int, length: int) -> list[tuple]:
    """A block's entries, by one range read."""
    with store.open_input_file(f"{path}/{file}") as f:
        raw = zlib.decompress(f.read_at(length, offset))
    block = pa.ipc.open_stream(raw).read_all()
    return list(zip(*[block.column(k).to_pylist() for k in range(5)], strict=True))


def _captures(store, path: str, entries: list[tuple], payload: bool) -> Iterator[pa.RecordBatch]:
    """The records of some entries, each by a range read, archive by archive; a few hundred are in memory."""
    names = ["key", "url", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    f, opened, rows = None, None, []
    for key, _, file, offset, length in sorted(entries, key=lambda e: e[2:]):
        if file != opened:
            if f is not None:
                f.close()
            f, opened = store.open_input_file(f"{path}/{file}"), file
        r = parse(f.read_at(length, offset))
        rows.append((key, *(r[n] for n in names[1:7]), r["payload"] if payload else None))
        if len(rows) >= 200:
            yield _rows(rows, kinds, names)
            rows = []
    if f is not None:
        f.close()
    yield _rows(rows, kinds, names)


def _read(folder: str, payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for file, offset, length in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                yield from _captures(store, path, _entries(store, path, file, offset, length), payload)

    return run


def _bisected(keys: list[str], blocks: dict[str, list]) -> Iterator[tuple]:
    """For each key the directory's blocks that may hold it: the first whose last key is not below, up to the last whose
    first key is not above. blocks: columns of the directory in the order of keys."""
    for key in keys:
        for k in range(bisect_left(blocks["last"], key), bisect_right(blocks["first"], key)):
            yield key, blocks["file"][k], blocks["offset"][k], blocks["length"][k]


def _locate(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _rows(list(_bisected(batch.column(0).to_pylist(), sent.value)), [pa.string(), pa.string(), pa.int64(), pa.int64()], ["key", "file", "offset", "length"])

    return run


def _wanted(entries: list[tuple], keys: list[str]) -> list[tuple]:
    """A block's entries of some keys, each found by a binary search."""
    own = [e[0] for e in entries]
    return [e for key in keys for e in entries[bisect_left(own, key) : bisect_right(own, key)]]


def _fetch(folder: str, payload: bool):
    """Rows (key, file, offset, length) sorted by block: each block is read once, and of it the keys' records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        block, keys = None, []
        for batch in batches:
            for key, *place in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                if place != block:
                    if keys:
                        yield from _captures(store, path, _wanted(_entries(store, path, *block), keys), payload)
                    block, keys = place, []
                keys.append(key)
        if keys:
            yield from _captures(store, path, _wanted(_entries(store, path, *block), keys), payload)

    return run


class Archive:
    """Archives and their index in one folder of a store that all executors reach. keys: those of all captures."""

    def __init__(self, spark: SparkSession, folder: str, directory: DataFrame, keys: DataFrame):
        self.spark, self.folder, self.directory, self.keys = spark, folder, directory, keys

    def scan(self, payload: bool = True) -> DataFrame:
        """Every capture without a search: blocks are dealt out, each read by range, then its records by range."""
        blocks = self.directory.select("file", "offset", "length")
        return blocks.repartition(self._tasks(), F.xxhash64("file", "offset")).mapInArrow(_read(self.folder, payload), _CAPTURE)

    def find(self, keys: DataFrame, payload: bool = True) -> DataFrame:
        """Captures of some keys (one column, repeated or not): a binary search of the sorted directory for the blocks that
        may hold a key, one range read a block, a binary search in it, then a range read a record. A key with many captures
        is spread over its blocks."""
        wanted = keys.toDF("key").distinct()
        out = None
        for part in self._directory():
            sent = self.spark.sparkContext.broadcast(part)
            near = wanted.where(F.col("key").between(part["first"][0], part["last"][-1]))
            places = near.mapInArrow(_locate(sent), "key string, file string, offset long, length long")
            dealt = places.repartition(self._tasks(), F.xxhash64("file", "offset")).sortWithinPartitions("file", "offset", "key")
            one = dealt.mapInArrow(_fetch(self.folder, payload), _CAPTURE)
            out = one if out is None else out.unionAll(one)
        return out if out is not None else self.scan(payload)

    def read(self, payload: bool = True) -> DataFrame:
        """Every capture, each key looked up in the index."""
        return self.find(self.keys, payload)

    def lookup(self, urls: list[str]) -> list[dict]:
        """Captures of some URLs, on the driver."""
        store, path = fs.FileSystem.from_uri(self.folder)
        out = []
        for part in self._directory():
            for key, *place in _bisected(sorted({surt(u) for u in urls}), part):
                out += [r for x in _captures(store, path, _wanted(_entries(store, path, *place), [key]), True) for r in x.to_pylist()]
        return out

    def _tasks(self) -> int:
        return max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))

    def _directory(self) -> Iterator[dict[str, list]]:
        """The directory's columns in the order of keys, DIRECTORY_ROWS at a time."""
        names, held = ["first", "last", "file", "offset", "length"], []
        for r in self.directory.orderBy("first", "last", "file", "offset").select(*names).toLocalIterator():
            held.append(tuple(r))
            if len(held) == DIRECTORY_ROWS:
                yield dict(zip(names, map(list, zip(*held, strict=True)), strict=True))
                held = []
        if held:
            yield dict(zip(names, map(list, zip(*held, strict=True)), strict=True))


def write_archive(pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url", content: str = "html") -> Archive:
    """Write one record per row of pages, in the order of keys, so that a block's records stand together, and index them.

    Null html: an empty payload. Of equal payloads of REVISIT_FROM bytes or more, the one with the largest page_id is a
    response, the others revisit it; with no id at all, all are responses, as are repeated rows with the largest id. Null
    urls have an empty key. Very long pages are one record like others; repeated rows are several. Columns besides the three
    named ones play no part, whatever their names. An empty table gives empty archives.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)
    html = F.coalesce(pages[content].cast("string"), F.lit(""))
    p = pages.select(pages[page_id].cast("long").alias("page_id"), pages[url].cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    large = p.where(F.octet_length("html") >= REVISIT_FROM)
    shared = large.groupBy("digest").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1 and original is not null").select("digest", "original")
    shared = materialise(shared, "warc-shared")
    typed = p.join(shared, "digest", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("original")), F.col("original"))
    keyed = typed.select("page_id", "url", "html", "digest", refers.alias("refers_to"), _keys("url").alias("key"))
    keyed = keyed.repartitionByRange("key", "page_id", "digest").sortWithinPartitions("key", "page_id", "digest")
    entries = materialise(keyed.mapInArrow(_write(folder), _ENTRY), "warc-entries")
    ordered = entries.repartitionByRange("key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id", "file", "offset")
    directory = materialise(ordered.mapInArrow(_index(folder), _BLOCK), "warc-directory")
    release(shared)
    return Archive(spark, folder, directory, entries.select("key"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = write_archive(table(spark, sf_dir, "pages")).read(payload=False)
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
