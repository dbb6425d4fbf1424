"""Shared by the operators: text rules, hashing and broadcasting to tasks."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.session import cut_lineage

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: str | None) -> list[bytes]:
    """Words as UTF-8. ``bytes.split`` parts at exactly the six characters."""
    return text.encode().split() if text else []


def lower_words_of(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased and nothing else changed."""
    return text.encode().lower().split() if text else []


def blank(c: Column | str) -> Column:
    """Null texts count as empty."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def id_remainder(c: Column | str, modulus: int) -> Column:
    """crc32 of the id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("")).cast("binary")) % modulus


def in_array(c: str) -> Column:
    """The id in an array of its own, empty for null: pandas would make all the
    integers of a batch floats if one of them is null."""
    return F.array_compact(F.array(c))


def crc_remainder(value, modulus: int) -> int:
    return zlib.crc32(b"" if value is None or value != value else str(value).encode()) % modulus


def stored(df: DataFrame) -> DataFrame:
    """Computed once and kept in the shared checkpoint folder."""
    return cut_lineage(df)


def to_tasks(spark: SparkSession, value):
    """A broadcast of plain arrays whose size is bounded by a parameter."""
    return spark.sparkContext.broadcast(value)


def frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Non-empty batches."""
    for b in batches:
        if len(b):
            yield b


def popcount(a: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a.view(np.uint64))
