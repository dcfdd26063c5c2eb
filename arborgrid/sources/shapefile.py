"""Polygons from a shapefile as the FEATURE relation."""

from __future__ import annotations

import os
import struct

from pyspark.sql import DataFrame, SparkSession

from ..schema import FEATURE

# Shape types that hold polygons.
POLYGON_TYPES = (5, 15, 25)


def _labels(path: str, field: str) -> list[str] | None:
    try:
        raw = open(path, "rb").read()
    except OSError:
        return None
    n, head, length = struct.unpack_from("<IHH", raw, 4)
    at, offset = 32, 1
    while raw[at] != 0x0D:
        name, size = raw[at : at + 11].split(b"\0")[0].decode(), raw[at + 16]
        if name.lower() == field.lower():
            return [raw[head + k * length + offset : head + k * length + offset + size].decode("utf-8", "replace").strip() for k in range(n)]
        at, offset = at + 32, offset + size
    return None


def _rings(xs: list[float], ys: list[float], starts: list[int]) -> list[tuple[int, list[float], list[float]]]:
    """Rings with their polygon's number: a clockwise ring begins one, others are holes of the one before."""
    out, poly = [], -1
    for a, b in zip(starts, [*starts[1:], len(xs)], strict=True):
        x, y = xs[a:b], ys[a:b]
        area = sum(x[i - 1] * y[i] - x[i] * y[i - 1] for i in range(len(x)))
        if area <= 0 or poly < 0:
            poly += 1
        if len(x) > 1 and (x[0], y[0]) == (x[-1], y[-1]):
            x, y = x[:-1], y[:-1]
        out.append((poly, x, y))
    return out


def read(spark: SparkSession, path: str, field: str | None = None) -> DataFrame:
    """(Multi)polygons of a .shp; other shapes are skipped. Labels are a field's values or the feature's number."""
    raw = open(path, "rb").read()
    labels = _labels(os.path.splitext(path)[0] + ".dbf", field) if field else None
    rows, at, record = [], 100, 0
    while at + 8 <= len(raw):
        size = 2 * struct.unpack_from(">I", raw, at + 4)[0]
        kind, = struct.unpack_from("<i", raw, at + 8)
        if kind in POLYGON_TYPES:
            box = struct.unpack_from("<4d", raw, at + 12)
            parts, n = struct.unpack_from("<2i", raw, at + 44)
            starts = list(struct.unpack_from(f"<{parts}i", raw, at + 52))
            flat = struct.unpack_from(f"<{2 * n}d", raw, at + 52 + 4 * parts)
            k = len(rows)
            rows.append((k, labels[record] if labels else f"{k:04d}", *box, _rings(list(flat[::2]), list(flat[1::2]), starts)))
        at, record = at + 8 + size, record + 1
    return spark.createDataFrame(rows, FEATURE)


def write(path: str, polygons: list[list[list[tuple[float, float]]]], labels: list[str] | None = None) -> None:
    """A minimal polygon shapefile: each polygon a list of rings, the first clockwise. With labels, a .dbf beside it."""
    body = b""
    for k, rings in enumerate(polygons):
        closed = [[*r, r[0]] for r in rings]
        points = [p for r in closed for p in r]
        starts = [sum(len(r) for r in closed[:i]) for i in range(len(closed))]
        xs, ys = [p[0] for p in points], [p[1] for p in points]
        one = struct.pack("<i4d2i", 5, min(xs), min(ys), max(xs), max(ys), len(rings), len(points)) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        body += struct.pack(">2I", k + 1, len(one) // 2) + one
    head = struct.pack(">7I", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<2i8d", 1000, 5, *[0.0] * 8)
    with open(path, "wb") as f:
        f.write(head + body)
    if labels is not None:
        rows = b"".join(b" " + x.encode()[:20].ljust(20) for x in labels)
        field = b"NAME".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([20, 0]) + b"\0" * 14
        with open(os.path.splitext(path)[0] + ".dbf", "wb") as f:
            f.write(struct.pack("<4BIHH20x", 3, 100, 1, 1, len(labels), 65, 21) + field + b"\x0d" + rows + b"\x1a")
