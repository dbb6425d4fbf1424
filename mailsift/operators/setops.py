"""Combining mail sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ESSENTIAL = ["subject", "body", "label", "source_file"]
FALLBACKS = {"subject": ["title"], "body": ["content", "text"], "label": ["class"]}


def tag_source(df: DataFrame, name: str, column: str = "source_file") -> DataFrame:
    return df.withColumn(column, F.lit(name))


def admit_sources(sources: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Fill essential columns from fallback names; leave out what still lacks one.

    Only schemas are looked at, no data is read.
    """
    admitted = {}
    for name, df in sources.items():
        for target, others in FALLBACKS.items():
            found = next((c for c in others if c in df.columns), None)
            if target not in df.columns and found:
                df = df.withColumn(target, F.col(found))
        if all(c in df.columns for c in ESSENTIAL[:3]):
            admitted[name] = df
    return admitted


def exclude_sources(df: DataFrame, names: list[str], column: str = "source_file") -> DataFrame:
    return df.where(~F.col(column).isin(names))


def union_outer(frames: list[DataFrame]) -> DataFrame:
    """All columns of all frames, missing ones null, duplicates kept."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_common(frames: list[DataFrame], extra: list[str] | None = None) -> DataFrame:
    """Union on the shared essential columns if at least three are shared.

    Otherwise falls back to the outer union. ``extra`` names columns to carry
    along, such as a row id.
    """
    shared = set.intersection(*[set(f.columns) for f in frames])
    keep = [c for c in ESSENTIAL if c in shared]
    if len(keep) < 3:
        return union_outer(frames)
    keep += [c for c in extra or [] if c in shared]
    return reduce(lambda a, b: a.unionByName(b), [f.select(*keep) for f in frames])
