"""Octree index of cloud-optimised point files: chunks with bounds, for pruning by extent."""

from __future__ import annotations

import struct
from dataclasses import dataclass

from .las import read_header

# Record ids of the index's info and of its hierarchy pages' entries.
INFO_USER, INFO_RECORD, ENTRY = b"copc", 1, struct.Struct("<4i Q 2i")


@dataclass(frozen=True)
class Chunk:
    level: int
    offset: int
    size: int
    points: int
    first: int
    low: tuple[float, float, float]
    high: tuple[float, float, float]


def chunks(path: str) -> list[Chunk]:
    """All chunks in file order, with the place of each one's first point; empty for a file without an index."""
    h = read_header(path)
    info = next((d for u, r, d in h.vlrs if u == INFO_USER and r == INFO_RECORD), None)
    if info is None:
        return []
    cx, cy, cz, half, _, root, size = struct.unpack_from("<5d2Q", info)
    found, pages = [], [(root, size)]
    with open(path, "rb") as f:
        while pages:
            at, n = pages.pop()
            f.seek(at)
            page = f.read(n)
            for k in range(len(page) // ENTRY.size):
                level, x, y, z, offset, nbytes, count = ENTRY.unpack_from(page, k * ENTRY.size)
                if count < 0:
                    pages.append((offset, nbytes))
                elif count:
                    side = 2 * half / (1 << level)
                    low = (cx - half + x * side, cy - half + y * side, cz - half + z * side)
                    found.append((offset, nbytes, count, level, low, tuple(v + side for v in low)))
    out, first = [], 0
    for offset, nbytes, count, level, low, high in sorted(found):
        out.append(Chunk(level, offset, nbytes, count, first, low, high))
        first += count
    return out


def overlapping(index: list[Chunk], min_x: float, min_y: float, max_x: float, max_y: float) -> list[Chunk]:
    return [c for c in index if c.low[0] <= max_x and c.high[0] >= min_x and c.low[1] <= max_y and c.high[1] >= min_y]
