"""Size-tiered compaction of immutable Parquet shards under an atomically committed, versioned manifest."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import pyarrow.parquet as pq
from py4j.protocol import Py4JJavaError
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbering import numbered
from .common import drop_folder, materialise, new_folder, packed, partition_id, release, table

#: Bytes of text and other values, before compression, of an arriving shard and of a finished one.
SMALL, TARGET = 4 << 20, 64 << 20
#: Shards of one tier that are merged at least; a tier spans sizes that differ by less than this factor.
FAN_IN = 4
#: Finished shards' worth of a tier that one task of the planning orders.
PLANNED = 64


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _append(folder: str, small: int):
    """Write each partition as shards of about `small` bytes. A retried task writes under new names; only names that the
    finished attempt returns enter the manifest, so half-written files are never read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        held, size, made = [], 0, []

        def flush() -> None:
            nonlocal held, size
            name = f"shard-{partition_id():06d}-{uuid.uuid4().hex}.parquet"
            whole = pa.Table.from_batches(held)
            with store.open_output_stream(f"{path}/{name}") as out:
                pq.write_table(whole, out, compression="zstd")
            made.append((name, size, whole.num_rows, 0))
            held, size = [], 0

        for batch in batches:
            # equal slices, each a share of the batch's bytes
            n = max(1, -(-batch.nbytes // small))
            step = max(1, -(-batch.num_rows // n))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                held.append(part)
                size += max(1, batch.nbytes * part.num_rows // max(1, batch.num_rows))
                if size >= small:
                    flush()
        if held:
            flush()
        yield _listed(made)

    return run


def _listed(rows: list[tuple]) -> pa.RecordBatch:
    c = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c[0], pa.string()), *(pa.array(x, pa.int64()) for x in c[1:])], names=["name", "size", "rows", "level"])


#: One immutable file: its name, raw bytes, rows and how often its rows have been rewritten.
_LISTED = "name string, size long, rows long, level long"


def plan(shards: DataFrame, target: int = TARGET, fan_in: int = FAN_IN) -> DataFrame:
    """Groups to merge: names, size, level. shards: name, size, rows, level.

    Of each tier below the target (sizes that differ by less than fan_in) that holds fan_in shards or more, runs in name
    order whose sizes add up to about the target. A tier with fewer waits for more arrivals. A large tier is dealt by hash
    into parts of about PLANNED targets, which are ordered each on its own.
    """
    small = shards.where(F.col("size") * 2 <= target).withColumn("tier", F.floor(F.log(F.greatest("size", F.lit(1))) / F.log(F.lit(float(fan_in))) + 1e-9).cast("int"))
    tiers = small.groupBy("tier").agg(F.count("*").alias("n"), F.sum("size").alias("whole")).where(F.col("n") >= fan_in)
    dealt = small.join(F.broadcast(tiers), "tier").withColumn("part", F.pmod(F.xxhash64("name"), F.ceil(F.col("whole") / (PLANNED * target))))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("tier", "part").orderBy("name").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = dealt.withColumn("run", F.floor(before / target)).groupBy("tier", "part", "run")
    groups = runs.agg(F.sort_array(F.collect_list("name")).alias("names"), F.sum("size").alias("size"), (F.max("level") + 1).alias("level"))
    return groups.where(F.size("names") > 1).select("names", "size", "level")




def _merge(folder: str):
    """Merge each row's files into one, row group by row group: one arriving shard is in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        made = []
        for batch in batches:
            for names, size, level in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                name, rows = f"shard-{names[0].split('-')[1]}-{uuid.uuid4().hex}.parquet", 0
                writer = None
                with store.open_output_stream(f"{path}/{name}") as out:
                    for x in names:
                        with store.open_input_file(f"{path}/{x}") as f:
                            part = pq.ParquetFile(f)
                            writer = writer or pq.ParquetWriter(out, part.schema_arrow, compression="zstd")
                            for k in range(part.num_row_groups):
                                writer.write_table(part.read_row_group(k))
                                rows += part.metadata.row_group(k).num_rows
                    writer.close()
                made.append((name, size, rows, level))
        yield _listed(made)

    return run


def _delete(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    store, path = open_store(folder)
    for batch in batches:
        for name in batch.column(0).to_pylist():
            if store.get_file_info(f"{path}/{name}").type == fs.FileType.File:
                store.delete_file(f"{path}/{name}")
        yield batch


class ShardSet:
    """A folder of shards (data), lists of shards (lists) and versions v00000001, v00000002, ...

    A version is a small file that names its list: a table of all live shards, as large as it needs to be. It is made with one step that fails
    if it exists, so of two writers one wins. Readers take the highest version; files that no list names are garbage and
    harm nobody. Older versions stay readable until expire().
    """

    def __init__(self, spark: SparkSession, folder: str, small: int = SMALL, target: int = TARGET, fan_in: int = FAN_IN):
        self.spark, self.folder, self.small, self.target, self.fan_in = spark, folder, small, target, fan_in
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{folder}/data"))

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())

    def version(self) -> int:
        return max(self.versions(), default=0)

    def _list(self, version: int) -> str:
        return self.spark.read.text(f"{self.folder}/v{version:08d}", wholetext=True).first()[0].strip()

    def shards(self, version: int | None = None) -> DataFrame:
        """name, size, rows, level of a version's live shards; of the newest if none is given."""
        v = self.version() if version is None else version
        if not v:
            return self.spark.createDataFrame([], _LISTED)
        return self.spark.read.schema(_LISTED).parquet(f"{self.folder}/lists/{self._list(v)}")

    def commit(self, base: int, shards: DataFrame) -> int:
        """Write the list, then make version base + 1 in one step; an error if another writer was first."""
        name = uuid.uuid4().hex
        shards.write.parquet(f"{self.folder}/lists/{name}")
        final, temporary = self._path(f"{self.folder}/v{base + 1:08d}"), self._path(f"{self.folder}/.{name}")
        java = self.spark._jvm.java
        try:
            local = self._fs.getUri().getScheme() == "file"
            out = self._fs.create(temporary if local else final, False)
            out.write(bytearray(name.encode()))
            out.close()
            if local:  # whole before it has its name; a link is never made over a file
                at = lambda p: java.io.File(p.toUri().getPath()).toPath()
                java.nio.file.Files.createLink(at(final), at(temporary))
        except Py4JJavaError as e:
            raise RuntimeError(f"version {base + 1} was committed by another writer") from e
        finally:
            self._fs.delete(temporary, False)
        return base + 1

    def append(self, docs: DataFrame) -> int:
        """Add rows as small shards, without a shuffle, and commit them."""
        base = self.version()
        made = docs.mapInArrow(_append(f"{self.folder}/data", self.small), _LISTED)
        return self.commit(base, self.shards(base).unionAll(made))

    def compact(self) -> int:
        """Merge until no tier holds enough similar shards; each round is one job and one commit."""
        while True:
            base = self.version()
            live = self.shards(base)
            groups = materialise(plan(live, self.target, self.fan_in), "shard-groups")
            n = groups.count()
            if not n:
                release(groups)
                return base
            made = groups.repartition(n).mapInArrow(_merge(f"{self.folder}/data"), _LISTED)
            gone = groups.select(F.explode("names").alias("name"))
            self.commit(base, live.join(gone, "name", "left_anti").unionAll(made))
            release(groups)

    def expire(self, keep: int = 1) -> None:
        """Forget all but the newest `keep` versions, and delete the shards that only they name."""
        versions = self.versions()
        old, new = versions[:-keep], versions[-keep:]
        if not old:
            return
        names = lambda vs: self.spark.read.schema(_LISTED).parquet(*[f"{self.folder}/lists/{self._list(v)}" for v in vs]).select("name").distinct()
        dead = materialise(names(old).join(names(new), "name", "left_anti"), "shard-dead")
        lists = [self._list(v) for v in old]
        for v in old:
            self._fs.delete(self._path(f"{self.folder}/v{v:08d}"), False)
        dead.mapInArrow(partial(_delete, f"{self.folder}/data"), "name string").count()
        for name in lists:
            drop_folder(self.spark, f"{self.folder}/lists/{name}")
        release(dead)

    def read(self, schema: T.StructType, version: int | None = None) -> DataFrame:
        """The live rows with their shard's name and their place in it. Spark's scan takes the files' names on the driver, as
        any of its scans lists its files there."""
        names = [f"{self.folder}/data/{r['name']}" for r in self.shards(version).select("name").toLocalIterator()]
        if not names:
            return self.spark.createDataFrame([], T.StructType([*schema, T.StructField("shard", T.StringType()), T.StructField("place", T.LongType())]))
        return self.spark.read.schema(schema).parquet(*names).select("*", F.col("_metadata.file_name").alias("shard"), F.col("_metadata.row_index").alias("place"))


def shard(docs: DataFrame, folder: str | None = None, small: int = SMALL, target: int = TARGET) -> ShardSet:
    """Append docs and compact.

    Every row, null or repeated, empty or very long, is kept as it is, with all its columns; an empty table gives no shards.
    """
    spark = docs.sparkSession
    out = ShardSet(spark, folder or new_folder(spark, "shards"), small, target)
    out.append(docs)
    out.compact()
    return out


def placed(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, shard (an id from 0 in name order), place in it, the shard's rows, raw bytes and level.

    Columns of docs may have any names; doc_id is returned as it is, null or repeated."""
    made = shard(docs.select(packed(docs).alias("row")))
    made.expire()  # a folder of this call's own: nobody reads its older versions
    rows = made.read(docs.select(packed(docs).alias("row")).schema).select(F.col("row.doc_id").alias("doc_id"), "shard", "place")
    facts = numbered(made.shards(), ["name"], "shard_id").select(F.col("name").alias("shard"), "shard_id", F.col("rows").alias("shard_rows"), F.col("size").alias("shard_bytes"), "level")
    return rows.join(facts, "shard").select("doc_id", "shard_id", "place", "shard_rows", "shard_bytes", "level")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(table(spark, sf_dir, "documents"))
