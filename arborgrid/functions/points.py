"""Column expressions over points: filters, cells, buckets, weights."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import GridSpec

#: Classes that a cloud drops when no class filter is given: low noise and high noise.
DEFAULT_DROPPED = frozenset({7, 18})
RETURN_WORDS = ("first", "last", "only", "intermediate")


def number_set(spec: str) -> set[int]:
    """'1,3-5' to {1, 3, 4, 5}; reversed ranges are turned, values outside 0-255 are cut off, other tokens ignored."""
    out: set[int] = set()
    for token in re.sub(r"\s+", "", spec).split(","):
        if m := re.fullmatch(r"(-?\d+)-(-?\d+)", token):
            a, b = sorted((int(m[1]), int(m[2])))
            out |= set(range(max(0, a), min(255, b) + 1))
        elif re.fullmatch(r"\d+", token) and int(token) <= 255:
            out.add(int(token))
    return out


def class_filter(spec: str | None = None, column: str = "classification") -> Column:
    """None: all but noise. 'all', '*' or '': all. A list keeps, a list after ~ drops."""
    c = F.col(column)
    if spec is None:
        return ~c.isin(sorted(DEFAULT_DROPPED))
    text = re.sub(r"\s+", "", spec).lower()
    if text in ("", "all", "*"):
        return F.lit(True)
    if text.startswith("~"):
        drop = sorted(number_set(text[1:]))
        return ~c.isin(drop) if drop else F.lit(True)
    return c.isin(sorted(number_set(text)))


def return_filter(spec: str | None = None) -> Column:
    """first, last, only, intermediate, or a list of return numbers; None: any."""
    n, of = F.col("return_number"), F.col("number_of_returns")
    text = re.sub(r"\s+", "", spec or "").lower()
    if text in ("", "all", "*", "any"):
        return F.lit(True)
    named = {"first": n == 1, "last": n == of, "only": of == 1, "intermediate": (n > 1) & (n < of)}
    return named[text] if text in named else n.isin(sorted(number_set(text)))


@dataclass(frozen=True)
class PointFilter:
    """What every tool applies first: class, return; withheld points always go."""

    classes: str | None = None
    returns: str | None = None

    def column(self) -> Column:
        return ~F.col("withheld") & class_filter(self.classes) & return_filter(self.returns)


def grid_col(grid: GridSpec, x: Column | None = None) -> Column:
    """Column of a point; only points exactly on the right edge fold into the last column. Outside: out of 0..cols-1."""
    x = F.col("x") if x is None else x
    c = F.floor((x - grid.min_x) / grid.cell).cast("int")
    return F.when((c == grid.cols) & (x == grid.max_x), grid.cols - 1).otherwise(c)


def grid_row(grid: GridSpec, y: Column | None = None) -> Column:
    y = F.col("y") if y is None else y
    r = F.floor((grid.max_y - y) / grid.cell).cast("int")
    return F.when((r == grid.rows) & (y == grid.min_y), grid.rows - 1).otherwise(r)


def inside(grid: GridSpec) -> Column:
    return F.col("col").between(0, grid.cols - 1) & F.col("row").between(0, grid.rows - 1)


def floor_cell(v: Column, cell: float) -> Column:
    """A cell index anchored at 0."""
    return F.floor(v / cell).cast("long")


def stratum(h: Column, thresholds: list[float]) -> Column:
    """How many leading thresholds h reaches; stops at the first that it does not."""
    out = F.lit(len(thresholds))
    for k in range(len(thresholds) - 1, -1, -1):
        out = F.when(h < thresholds[k], k).otherwise(out)
    return out


def return_bucket(n: Column) -> Column:
    """Returns 1 to 8 to 0 to 7, all others to 8."""
    return F.when(n.between(1, 8), n - 1).otherwise(8)


@dataclass(frozen=True)
class KrausPfeifer:
    g: float = -2.0
    w: float = 2.5
    a: float = 1.0
    b: float = 4.0

    def weight(self, v: Column) -> Column:
        inner = 1.0 / (1.0 + F.pow(F.lit(self.a) * (v - self.g), F.lit(self.b)))
        return F.when(v <= self.g, 1.0).when(v > self.g + self.w, 0.0).otherwise(inner)


@dataclass(frozen=True)
class Sentinels:
    """What stands for missing values in outputs: nodata in cells without returns, noheight where no return is high enough."""

    nodata: float | None = None
    noheight: float | None = 0.0

    @staticmethod
    def parse(text: str) -> float | None:
        return None if text.strip().lower() == "na" or math.isnan(float(text)) else float(text)


#: Point formats that carry colours and near infrared.
COLOUR_FORMATS, INFRARED_FORMATS = frozenset({2, 3, 5, 7, 8, 10}), frozenset({8, 10})
CHANNELS = {"r": "red", "g": "green", "b": "blue", "n": "nir"}


@dataclass
class Channels:
    names: list[str] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)


def channels(spec: str, point_format: int) -> Channels:
    """'R,G,B,N' or 'all' to column names in the order asked for; channels that the format lacks are dropped."""
    out = Channels()
    tokens = list("rgbn") if spec.strip().lower() == "all" else [t.strip().lower() for t in spec.split(",")]
    for t in tokens:
        if t in CHANNELS and CHANNELS[t] not in out.names + out.dropped:
            has = point_format in (INFRARED_FORMATS if t == "n" else COLOUR_FORMATS)
            (out.names if has else out.dropped).append(CHANNELS[t])
    return out
