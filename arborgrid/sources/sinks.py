"""Tables and rasters as files."""

from __future__ import annotations

import contextlib
import csv
import os
import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import GridSpec
from .rasters import dense_array, write_tiff


def grid_table(bands: DataFrame, grid: GridSpec) -> DataFrame:
    """col, row, x, y and the bands of every cell, empty ones too; sorted when written."""
    names = [c for c in bands.columns if c not in ("row", "col")]
    full = grid.cells(bands.sparkSession).join(bands, ["row", "col"], "left")
    return full.select("col", "row", grid.centre_x(F.col("col")).alias("x"), grid.centre_y(F.col("row")).alias("y"), *names)


def _rows(df: DataFrame, order: list[str]) -> Iterator:
    """Row by row, one partition in memory at a time, in order."""
    return (df.orderBy(*order) if order else df).toLocalIterator(prefetchPartitions=True)


def write_csv(df: DataFrame, path: str, order: list[str] | None = None) -> int:
    """One file; missing values are NA."""
    n = 0
    with open(path, "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(df.columns)
        for n, r in enumerate(_rows(df, order or []), 1):
            out.writerow(["NA" if v is None or v != v else v for v in r])
    return n


def write_csv_parts(df: DataFrame, path: str) -> None:
    """The same rows as many files, each written by a task: for tables beyond one machine."""
    df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias(c) for c in df.columns]).write.csv(path, header=True)


def write_sqlite(df: DataFrame, path: str, table: str = "grid", order: list[str] | None = None) -> int:
    """One transaction; missing values are NULL."""
    kinds = {"int": "INTEGER", "bigint": "INTEGER", "smallint": "INTEGER", "string": "TEXT", "boolean": "INTEGER"}
    quoted = ['"' + c.replace('"', '""') + '"' for c in df.columns]
    columns = ", ".join(f"{q} {kinds.get(t, 'REAL')}" for q, (_, t) in zip(quoted, df.dtypes, strict=True))
    n = 0
    with contextlib.closing(sqlite3.connect(path)) as db, db:
        db.execute(f'CREATE TABLE "{table}" ({columns})')

        def rows():
            nonlocal n
            for r in _rows(df, order or []):
                n += 1
                yield tuple(None if v is None or v != v else v for v in r)

        db.executemany(f'INSERT INTO "{table}" VALUES ({", ".join("?" * len(quoted))})', rows())
    return n


def concat_csv(parts: list[str], path: str) -> int:
    """Tables of tiles one after the other; the first one's header stays."""
    n = 0
    with open(path, "w", newline="") as out:
        for k, p in enumerate(parts):
            with open(p, newline="") as f:
                for at, line in enumerate(f):
                    if at or not k:
                        out.write(line)
                    n += at > 0
    return n


def concat_sqlite(parts: list[str], path: str, table: str = "grid") -> None:
    with contextlib.closing(sqlite3.connect(path)) as db:
        for k, p in enumerate(parts):
            db.execute("ATTACH ? AS part", (p,))
            with db:
                if not k:
                    db.execute(f'CREATE TABLE "{table}" AS SELECT * FROM part."{table}" WHERE 0')
                db.execute(f'INSERT INTO "{table}" SELECT * FROM part."{table}"')
            db.execute("DETACH part")


def write_bands(bands: DataFrame, grid: GridSpec, path: str, single: bool = False, nodata: float = -9999.0) -> list[str]:
    """All bands in one TIFF, or one file per band."""
    names = [c for c in bands.columns if c not in ("row", "col")]
    arrays = {n: dense_array(bands, grid, n) for n in names}
    if not single:
        write_tiff(path, grid, arrays, nodata)
        return [path]
    stem, ext = os.path.splitext(path)
    for n, a in arrays.items():
        write_tiff(f"{stem}_{n}{ext}", grid, {n: a}, nodata)
    return [f"{stem}_{n}{ext}" for n in names]
