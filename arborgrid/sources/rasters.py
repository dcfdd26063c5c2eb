"""Raster files: ESRI ASCII grids and single-file float TIFFs, read to and written from (row, col, value) tables."""

from __future__ import annotations

import os
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import GridSpec

EXTENSIONS = (".tif", ".tiff", ".asc")
_SCHEMA = "row int, col int, value double"
# TIFF field types by number and the tags used here.
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 11: "f", 12: "d", 16: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, BANDS, ROWS, COUNTS, PLANAR, FORMAT = 256, 257, 258, 259, 273, 277, 278, 279, 284, 339
PIXEL_SCALE, TIE_POINT, NODATA = 33550, 33922, 42113


def read_ascii(path: str) -> tuple[GridSpec, np.ndarray, float | None]:
    with open(path) as f:
        head: dict[str, float] = {}
        while True:
            at = f.tell()
            parts = f.readline().split()
            if len(parts) != 2 or not parts[0][0].isalpha():
                f.seek(at)
                break
            head[parts[0].lower()] = float(parts[1])
        data = np.array(f.read().split(), float)
    cols, rows, cell = int(head["ncols"]), int(head["nrows"]), head["cellsize"]
    x0 = head["xllcorner"] if "xllcorner" in head else head["xllcenter"] - cell / 2
    y0 = head["yllcorner"] if "yllcorner" in head else head["yllcenter"] - cell / 2
    return GridSpec(x0, y0 + rows * cell, cell, cols, rows), data.reshape(rows, cols), head.get("nodata_value")


def write_ascii(path: str, grid: GridSpec, values: np.ndarray, nodata: float = -9999.0) -> None:
    with open(path, "w") as f:
        f.write(f"ncols {grid.cols}\nnrows {grid.rows}\nxllcorner {grid.min_x!r}\nyllcorner {grid.min_y!r}\ncellsize {grid.cell!r}\nNODATA_value {nodata:g}\n")
        for line in np.where(np.isnan(values), nodata, values):
            f.write(" ".join(repr(float(v)) for v in line) + "\n")


def write_tiff(path: str, grid: GridSpec, bands: dict[str, np.ndarray], nodata: float = -9999.0) -> None:
    """Float32, one plane per band, one strip per plane, north up. Band names go to the description."""
    planes = [np.where(np.isnan(b), nodata, b).astype("<f4").tobytes() for b in bands.values()]
    n = len(planes)
    tags: list[tuple[int, int, list]] = [
        (WIDTH, 4, [grid.cols]), (HEIGHT, 4, [grid.rows]), (BITS, 3, [32] * n), (COMPRESSION, 3, [1]), (262, 3, [1]), (270, 2, [",".join(bands).encode() + b"\0"]), (OFFSETS, 4, [0] * n), (BANDS, 3, [n]),
        (ROWS, 4, [grid.rows]), (COUNTS, 4, [len(p) for p in planes]), (PLANAR, 3, [2]), (FORMAT, 3, [3] * n), (PIXEL_SCALE, 12, [grid.cell, grid.cell, 0.0]),
        (TIE_POINT, 12, [0.0, 0.0, 0.0, grid.min_x, grid.max_y, 0.0]), (NODATA, 2, [f"{nodata:g}".encode() + b"\0"]),
    ]
    pack = lambda kind, v: v[0] if kind == 2 else struct.pack(f"<{len(v)}{_TYPES[kind]}", *v)
    at = 8 + 2 + 12 * len(tags) + 4
    where = at + sum((len(pack(k, v)) + 1) // 2 * 2 for _, k, v in tags if len(pack(k, v)) > 4)
    tags = [(t, k, [where + sum(map(len, planes[:i])) for i in range(n)] if t == OFFSETS else v) for t, k, v in tags]
    entries, extra = b"", b""
    for t, k, v in tags:
        raw = pack(k, v)
        count = len(raw) if k == 2 else len(v)
        if len(raw) <= 4:
            entries += struct.pack("<HHI", t, k, count) + raw.ljust(4, b"\0")
        else:
            entries += struct.pack("<HHII", t, k, count, at + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
    with open(path, "wb") as f:
        f.write(b"II*\0" + struct.pack("<IH", 8, len(tags)) + entries + struct.pack("<I", 0) + extra + b"".join(planes))


def read_tiff(path: str) -> tuple[GridSpec, dict[str, np.ndarray], float | None]:
    """Uncompressed strips of 8 to 64 bits, chunky or planar; other compressions raise."""
    with open(path, "rb") as f:
        raw = f.read()
    e = "<" if raw[:2] == b"II" else ">"
    at, = struct.unpack_from(f"{e}I", raw, 4)
    tags: dict[int, list] = {}
    for k in range(struct.unpack_from(f"{e}H", raw, at)[0]):
        t, kind, n = struct.unpack_from(f"{e}HHI", raw, at + 2 + 12 * k)
        if kind not in _TYPES:
            continue
        size = struct.calcsize(f"{e}{n}{_TYPES[kind]}")
        spot = at + 10 + 12 * k if size <= 4 else struct.unpack_from(f"{e}I", raw, at + 10 + 12 * k)[0]
        tags[t] = [raw[spot : spot + n]] if kind == 2 else list(struct.unpack_from(f"{e}{n}{_TYPES[kind]}", raw, spot))
    if tags.get(COMPRESSION, [1])[0] != 1:
        raise ValueError(f"{path}: compression {tags[COMPRESSION][0]} has no decoder here")
    w, h, n = tags[WIDTH][0], tags[HEIGHT][0], tags.get(BANDS, [1])[0]
    kind = np.dtype(f"{e}{ {1: 'u', 2: 'i', 3: 'f'}[tags.get(FORMAT, [1])[0]]}{tags[BITS][0] // 8}")
    data = np.frombuffer(b"".join(raw[o : o + c] for o, c in zip(tags[OFFSETS], tags[COUNTS], strict=True)), kind).astype(float)
    cube = data.reshape(n, h, w) if tags.get(PLANAR, [1])[0] == 2 else data.reshape(h, w, n).transpose(2, 0, 1)
    scale, tie = tags[PIXEL_SCALE], tags[TIE_POINT]
    grid = GridSpec(tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1], scale[0], w, h)
    names = tags[270][0].rstrip(b"\0").decode().split(",") if 270 in tags else []
    nodata = float(tags[NODATA][0].rstrip(b"\0 ")) if NODATA in tags else None
    return grid, dict(zip(names if len(names) == n else [f"band{k + 1}" for k in range(n)], cube, strict=True)), nodata


def to_frame(spark: SparkSession, values: np.ndarray, nodata: float | None) -> DataFrame:
    """Cells that hold neither the nodata value nor NaN."""
    good = ~np.isnan(values) if nodata is None else ~np.isnan(values) & (np.abs(values - nodata) >= 1e-5)
    r, c = np.nonzero(good)
    return spark.createDataFrame(pa.table({"row": pa.array(r.astype(np.int32)), "col": pa.array(c.astype(np.int32)), "value": pa.array(values[good].astype(float))}))


def read(spark: SparkSession, path: str, band: int = 1) -> tuple[DataFrame, GridSpec]:
    """One raster, or a directory of rasters of one cell size as a mosaic in which later names win."""
    if os.path.isdir(path):
        parts = [p for p in sorted(os.path.join(path, n) for n in os.listdir(path)) if p.lower().endswith(EXTENSIONS)]
        if not parts:
            raise FileNotFoundError(f"no raster in {path}")
        return mosaic([read(spark, p, band) for p in parts])
    if path.lower().endswith(".asc"):
        grid, values, nodata = read_ascii(path)
    else:
        grid, bands, nodata = read_tiff(path)
        values = list(bands.values())[band - 1]
    return to_frame(spark, values, nodata), grid


def mosaic(parts: list[tuple[DataFrame, GridSpec]]) -> tuple[DataFrame, GridSpec]:
    cell = parts[0][1].cell
    x0, y1 = min(g.min_x for _, g in parts), max(g.max_y for _, g in parts)
    grid = GridSpec.over(x0, min(g.min_y for _, g in parts), max(g.max_x for _, g in parts), y1, cell)
    moved = [d.select((F.col("row") + round((y1 - g.max_y) / cell)).alias("row"), (F.col("col") + round((g.min_x - x0) / cell)).alias("col"), "value", F.lit(k).alias("k")) for k, (d, g) in enumerate(parts)]
    whole = moved[0]
    for m in moved[1:]:
        whole = whole.unionByName(m)
    return whole.groupBy("row", "col").agg(F.max_by("value", "k").alias("value")), grid


def as_points(raster: DataFrame, grid: GridSpec) -> DataFrame:
    """Each cell as a single first return at its centre, without intensity."""
    return raster.where("value is not null and not isnan(value)").select(
        grid.centre_x(F.col("col")).alias("x"), grid.centre_y(F.col("row")).alias("y"), F.col("value").alias("z"), F.lit(0).alias("intensity"),
        F.lit(1).alias("return_number"), F.lit(1).alias("number_of_returns"), F.lit(0).alias("classification"), F.lit(False).alias("withheld"),
    )


def dense_array(raster: DataFrame, grid: GridSpec, column: str = "value") -> np.ndarray:
    """A tile's raster in memory, for writing a file; grids of more than a tile are written tile by tile."""
    out = np.full((grid.rows, grid.cols), np.nan)
    t = raster.where(F.col(column).isNotNull()).select("row", "col", F.col(column).cast("double").alias("v")).toArrow()
    out[t.column("row").to_numpy(), t.column("col").to_numpy()] = t.column("v").to_numpy()
    return out
