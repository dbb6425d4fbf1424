"""Word lists and valence lexicons from files."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Most entries a list may have, as every task holds it.
MOST = 100_000


def read_lexicon(spark: SparkSession, path: str, most: int = MOST) -> dict[str, float]:
    """Valences by lower-case word from a tab-separated file: word, mean valence,
    and columns that are not read. Lines without a number are left out; of a word
    that repeats the last line in file order counts. More than ``most`` entries
    raise ValueError."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("n"), F.split("value", "\t").alias("c"))
    rows = rows.select("n", F.lower(F.get("c", F.lit(0))).alias("word"), F.expr("try_cast(get(c, 1) as double)").alias("v"))
    rows = rows.where("word <> '' and v is not null").groupBy("word").agg(F.max_by("v", "n").alias("v"))
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} entries in {path}")
    return {r["word"]: r["v"] for r in sorted(got)}


def read_words(spark: SparkSession, path: str, most: int = MOST) -> list[str]:
    """Distinct lower-case words of a file with one a line, such as a stop list."""
    got = spark.read.text(path).select(F.lower(F.trim("value")).alias("w")).where("w <> ''").distinct().limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} entries in {path}")
    return sorted(r["w"] for r in got)
