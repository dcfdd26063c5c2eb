"""LAS 1.0-1.4 point files: headers, a Spark data source over record ranges, and a writer. Uncompressed records only."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..schema import FILES, POINT

# The file format's layouts.
_CORE_OLD = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("bits", "u1"), ("cls", "u1"), ("angle", "i1"), ("user", "u1"), ("source", "<u2")]
_CORE_NEW = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("bits", "u1"), ("flags", "u1"), ("cls", "u1"), ("user", "u1"), ("angle", "<i2"), ("source", "<u2"), ("time", "<f8")]
_RGB = [("red", "<u2"), ("green", "<u2"), ("blue", "<u2")]
_WAVE = [("wave", "V29")]
_TIME = [("time", "<f8")]
FORMATS = {
    0: _CORE_OLD, 1: _CORE_OLD + _TIME, 2: _CORE_OLD + _RGB, 3: _CORE_OLD + _TIME + _RGB, 4: _CORE_OLD + _TIME + _WAVE, 5: _CORE_OLD + _TIME + _RGB + _WAVE,
    6: _CORE_NEW, 7: _CORE_NEW + _RGB, 8: _CORE_NEW + _RGB + [("nir", "<u2")], 9: _CORE_NEW + _WAVE, 10: _CORE_NEW + _RGB + [("nir", "<u2")] + _WAVE,
}
#: Formats with waveforms are written without them.
WRITTEN_AS = {4: 1, 5: 3, 9: 6, 10: 8}
ANGLE_STEP = 0.006
WKT_USER, WKT_RECORD, GEOKEYS = b"LASF_Projection", 2112, (34735, 34736, 34737)
#: Records that one task reads.
RECORDS_PER_TASK = 2_000_000


@dataclass
class Header:
    path: str
    version: tuple[int, int]
    point_format: int
    record_length: int
    offset: int
    count: int
    scale: tuple[float, float, float]
    shift: tuple[float, float, float]
    low: tuple[float, float, float]
    high: tuple[float, float, float]
    encoding: int = 0
    compressed: bool = False
    wkt: str | None = None
    vlrs: list[tuple[bytes, int, bytes]] = field(default_factory=list)


def read_header(path: str) -> Header:
    """A file's header and projection records, without its points."""
    with open(path, "rb") as f:
        raw = f.read(375)
        if raw[:4] != b"LASF":
            raise ValueError(f"{path} is not a LAS file")
        encoding, = struct.unpack_from("<H", raw, 6)
        version = (raw[24], raw[25])
        size, offset, n_vlr, kind, length, count = struct.unpack_from("<HIIBHI", raw, 94)
        numbers = struct.unpack_from("<12d", raw, 131)
        if version >= (1, 4) and len(raw) >= 375:
            count = struct.unpack_from("<Q", raw, 247)[0] or count
        vlrs, wkt = [], None
        f.seek(size)
        for _ in range(n_vlr):
            head = f.read(54)
            user, record, n = head[2:18].rstrip(b"\0"), *struct.unpack_from("<HH", head, 18)
            data = f.read(n)
            vlrs.append((user, record, data))
            if user == WKT_USER and record == WKT_RECORD:
                wkt = data.rstrip(b"\0").decode("utf-8", "replace")
    hi, lo = numbers[6::2], numbers[7::2]
    return Header(path, version, kind & 0x3F, length, offset, count, numbers[:3], numbers[3:6], lo, hi, encoding, bool(kind & 0x80) or path.lower().endswith(".laz"), wkt, vlrs)


def resolve(paths: list[str]) -> list[str]:
    """Files, and the .las and .laz files right inside directories in name order; anything else is dropped."""
    out = []
    for p in paths:
        found = sorted(e.path for e in os.scandir(p) if e.is_file()) if os.path.isdir(p) else [p] if os.path.isfile(p) else []
        out += [x for x in found if x.lower().endswith((".las", ".laz"))]
    return out


def files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per file from its header alone."""
    rows = [(k, h.path, h.count, *h.low, *h.high, f"{h.version[0]}.{h.version[1]}", h.point_format, h.compressed, h.wkt) for k, h in enumerate(map(read_header, resolve(paths)))]
    return spark.createDataFrame(rows, FILES)


def decode(raw: bytes, h: Header, file_idx: int, first: int) -> pa.RecordBatch:
    """Records to a batch of the POINT schema; fields that the format lacks are 0 or false."""
    kind = np.dtype(FORMATS[h.point_format])
    extra = h.record_length - kind.itemsize
    kind = np.dtype([*FORMATS[h.point_format], ("extra", f"V{extra}")]) if extra > 0 else kind
    r = np.frombuffer(raw, kind)
    n, new, none = len(r), h.point_format >= 6, np.zeros(len(r), np.int32)
    bits, cls = r["bits"], r["cls"]
    flags = r["flags"] if new else cls >> 5
    get = lambda name: r[name].astype(np.int32) if name in kind.names else none
    flag = lambda k: pa.array(((flags >> k) & 1).astype(bool))
    columns = [
        pa.array(np.full(n, file_idx, np.int32)), pa.array(first + np.arange(n, dtype=np.int64)),
        *(pa.array(r[a] * h.scale[k] + h.shift[k]) for k, a in enumerate("XYZ")), pa.array(get("intensity")),
        pa.array((bits & (15 if new else 7)).astype(np.int16)), pa.array((bits >> 4 if new else (bits >> 3) & 7).astype(np.int16)),
        pa.array((cls if new else cls & 31).astype(np.int16)), pa.array((np.round(r["angle"] * ANGLE_STEP) if new else r["angle"]).astype(np.int16)),
        pa.array(get("source")), pa.array(r["time"].astype(float) if "time" in kind.names else np.zeros(n)), *(pa.array(get(c)) for c in ("red", "green", "blue", "nir")),
        flag(2), flag(1), flag(0), flag(3) if new else pa.array(np.zeros(n, bool)), pa.array(((flags >> 4) & 3).astype(np.int16) if new else none.astype(np.int16)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=POINT.names)


@dataclass
class _Range(InputPartition):
    header: Header
    file_idx: int
    first: int
    count: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = options["path"].split(";")
        self.box = {"x": [-np.inf, np.inf], "y": [-np.inf, np.inf]}

    def pushFilters(self, filters: list) -> Iterator:
        """Bounds on x and y drop whole files by their headers; rows are still filtered by Spark."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) else None
            if name in self.box and isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                self.box[name][0] = max(self.box[name][0], f.value)
            if name in self.box and isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                self.box[name][1] = min(self.box[name][1], f.value)
            yield f

    def partitions(self) -> list[_Range]:
        out = []
        for k, h in enumerate(map(read_header, resolve(self.paths))):
            if h.compressed:
                raise ValueError(f"{h.path} is compressed; this reader has no decoder for it")
            if all(h.high[a] >= self.box[c][0] and h.low[a] <= self.box[c][1] for a, c in enumerate("xy")):
                out += [_Range(h, k, i, min(RECORDS_PER_TASK, h.count - i)) for i in range(0, h.count, RECORDS_PER_TASK)]
        return out or [_Range(None, 0, 0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        if not part.count:
            return
        with open(part.header.path, "rb") as f:
            f.seek(part.header.offset + part.first * part.header.record_length)
            for at in range(0, part.count, 100_000):
                n = min(100_000, part.count - at)
                yield decode(f.read(n * part.header.record_length), part.header, part.file_idx, part.first + at)


class LasSource(DataSource):
    """spark.dataSource.register(LasSource); spark.read.format("las").load("a.las;folder")"""

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self):
        return POINT

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read(spark: SparkSession, paths: list[str]) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LasSource)
    return spark.read.format("las").load(";".join(paths))


def write(batches: Iterator[pa.RecordBatch], path: str, like: Header) -> int:
    """Write points in the given order. Waveform formats lose their waveforms; formats from 6 on make a 1.4 file, as does a
    1.4 header. Projection records and the encoding bits are carried over. Returns the number of points."""
    kind = WRITTEN_AS.get(like.point_format, like.point_format)
    new = kind >= 6
    modern = new or like.version >= (1, 4)
    layout = np.dtype(FORMATS[kind])
    kept = [(u, r, d) for u, r, d in like.vlrs if u == WKT_USER and r in (WKT_RECORD, *GEOKEYS)]
    size = 375 if modern else 227
    offset = size + sum(54 + len(d) for *_, d in kept)
    n, low, high, by_return = 0, np.full(3, np.inf), np.full(3, -np.inf), np.zeros(15, np.int64)
    with open(path, "wb") as f:
        f.write(b"\0" * offset)
        for b in batches:
            c = {name: b.column(k).to_numpy(zero_copy_only=False) for k, name in enumerate(b.schema.names)}
            out = np.zeros(b.num_rows, layout)
            for k, a in enumerate("xyz"):
                v = (c[a] - like.shift[k]) / like.scale[k]
                out[a.upper()] = np.where(v < 0, np.ceil(v - 0.5), np.floor(v + 0.5)).astype(np.int64)
                real = out[a.upper()] * like.scale[k] + like.shift[k]
                if b.num_rows:
                    low[k], high[k] = min(low[k], real.min()), max(high[k], real.max())
            flags = c["synthetic"].astype(np.uint8) | c["keypoint"].astype(np.uint8) << 1 | c["withheld"].astype(np.uint8) << 2
            if new:
                out["bits"] = (c["return_number"] & 15) | (c["number_of_returns"] & 15) << 4
                out["flags"] = flags | c["overlap"].astype(np.uint8) << 3 | (c["scanner_channel"].astype(np.uint8) & 3) << 4
                out["cls"], out["angle"] = c["classification"], np.round(c["scan_angle"] / ANGLE_STEP)
            else:
                out["bits"] = (c["return_number"] & 7) | (c["number_of_returns"] & 7) << 3
                out["cls"], out["angle"] = (c["classification"] & 31) | flags << 5, c["scan_angle"]
            out["intensity"], out["source"] = c["intensity"], c["point_source_id"]
            for name in ("red", "green", "blue", "nir"):
                if name in layout.names:
                    out[name] = c[name]
            if "time" in layout.names:
                out["time"] = c["gps_time"]
            f.write(out.tobytes())
            n += b.num_rows
            by_return += np.bincount(np.clip(c["return_number"].astype(int), 1, 15) - 1, minlength=15)
        head = bytearray(size)
        head[:4] = b"LASF"
        struct.pack_into("<H", head, 6, like.encoding)
        head[24:26] = bytes((1, 4)) if modern else bytes(like.version)
        struct.pack_into("<HIIBHI", head, 94, size, offset, len(kept), kind, layout.itemsize, 0 if new or n >= 1 << 32 else n)
        if not new:
            struct.pack_into("<5I", head, 111, *by_return[:5].tolist())
        low, high = (np.where(np.isfinite(v), v, 0.0) for v in (low, high))
        struct.pack_into("<12d", head, 131, *like.scale, *like.shift, *(v for k in range(3) for v in (high[k], low[k])))
        if modern:
            struct.pack_into("<QQIQ", head, 227, 0, 0, 0, n)
            struct.pack_into("<15Q", head, 255, *by_return.tolist())
        f.seek(0)
        f.write(head)
        for user, record, data in kept:
            f.write(struct.pack("<H16sHH32s", 0, user, record, len(data), b"") + data)
    return n
