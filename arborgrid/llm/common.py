"""Things that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import drop_folder, materialise, new_folder, release  # noqa: F401  for the operators of this subpackage

#: White space as the contracts define it; a word is a run of anything else.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def cols(df: DataFrame, names: Iterable[str]) -> list[Column]:
    return [df[quote(n)] for n in names]


def packed(df: DataFrame) -> Column:
    """The whole row as one struct, so that helper columns cannot clash with the caller's own."""
    return F.struct(*[df[quote(c)].alias(c) for c in df.columns])


def unpacked(df: DataFrame, row: str, names: list[str]) -> DataFrame:
    return df.select(*[F.col(row)[c].alias(c) for c in names])


def partition_id() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0
