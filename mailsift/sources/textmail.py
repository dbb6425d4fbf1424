"""Mail stored as plain text: single messages and dumps of many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.functions.text import strip_ws


def _after_prefix(lines: Column, prefix: str) -> Column:
    """Rest of the last line that starts with ``prefix`` in any case."""
    hits = F.filter(lines, lambda x: F.lower(x).startswith(prefix))
    last = F.get(hits, F.size(hits) - 1)
    return F.coalesce(strip_ws(F.substring(last, len(prefix) + 1, F.length(last))), F.lit(""))


def parse_text_mail(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """First line is the subject, an optional blank line follows, then the body."""
    df = df.select(*keep, F.split(text, "\n").alias("_lines"))
    lines = F.col("_lines")
    first = strip_ws(lines[0])
    subject = F.when(
        F.lower(first).startswith("subject:"), strip_ws(F.substring(first, len("subject:") + 1, F.length(first)))
    ).otherwise(first)
    blank = (F.size(lines) > 1) & (strip_ws(F.get(lines, F.lit(1))) == "")
    start = F.when(blank, 3).otherwise(2)
    body = F.array_join(F.slice(lines, start, F.size(lines)), "\n")
    return df.select(
        *keep,
        subject.alias("subject"),
        body.alias("body"),
        _after_prefix(lines, "from:").alias("from"),
        _after_prefix(lines, "reply-to:").alias("reply_to"),
    )


def read_text_mail(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One message per .txt file."""
    raw = spark.read.option("recursiveFileLookup", True).text(paths, wholetext=True)
    tagged = raw.select(F.col("_metadata.file_path").alias("source_file"), "value")
    return parse_text_mail(tagged, "value", ["source_file"])


def read_lines(spark: SparkSession, paths: list[str], encoding: str = "UTF-8") -> DataFrame:
    """Lines of large dumps with their place: file, split and order in the split.

    A file is read by many tasks; the start of a split orders the splits and the
    increasing id orders the lines inside one.
    """
    raw = spark.read.option("encoding", encoding).text(paths)
    return raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_no"),
        F.col("value").alias("line"),
    )
