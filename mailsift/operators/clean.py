"""Cleaning, label handling and de-duplication of the mail table."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.functions import labels
from mailsift.functions.text import blank, collapse_ws, is_meaningful, or_empty

MAIL_COLUMNS = ["from", "reply_to", "subject", "body", "label"]

# --- fixed values: accepted column names, in the order in which they fill gaps ----
ALIASES = {
    "from": ["sender", "from_address", "from_addr", "sender_email", "email_from"],
    "reply_to": ["reply_to_address", "replyto"],
    "subject": ["email_subject", "mail_subject"],
    "body": ["content", "email_body", "message", "text", "email_content"],
    "label": ["is_phishing", "is_spam", "class", "category", "type"],
}
OPTIONAL_COLUMNS = ["urls", "links", "num_links", "has_attachment", "date", "receiver", "to"]
# -----------------------------------------------------------------------------------


def snake_case(name: str) -> str:
    return re.sub(r"_+", "_", re.sub(r"[^a-z0-9]", "_", name.lower())).strip("_")


def snake_case_values(c: Column) -> Column:
    """The same rule for a column of names."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))


def normalize_headers(df: DataFrame) -> DataFrame:
    """Numeric header names become col_<position>, all others snake_case."""
    named = [f"col_{i}" if c.isdigit() else c for i, c in enumerate(df.columns)]
    return df.toDF(*[snake_case(c) for c in named])


def coalesce_aliases(df: DataFrame) -> DataFrame:
    """Fill the five mail columns from their aliases, in listed order."""
    for target, aliases in ALIASES.items():
        present = [c for c in [target, *aliases] if c in df.columns]
        if present:
            df = df.withColumn(target, F.coalesce(*[F.col(f"`{c}`") for c in present]))
    return df


def require_mail_columns(df: DataFrame, default: str | None = None) -> DataFrame:
    """Add missing mail columns, null unless a default is given."""
    for name in MAIL_COLUMNS:
        if name not in df.columns:
            df = df.withColumn(name, F.lit(default).cast("string"))
    return df


def numeric_labels(df: DataFrame, column: str = "label") -> DataFrame:
    """Map labels that start with 1 / 0 when every label of the table is numeric.

    The guard is one aggregate row; it joins as a scalar, not as a table.
    """
    text = F.lower(F.col(column).cast("string"))
    guard = df.select(
        F.coalesce(F.bool_and(F.coalesce(text.rlike(r"^[01]\.?0*$"), F.lit(False))), F.lit(False)).alias("g")
    ).scalar()
    mapped = F.when(text.startswith("1"), labels.PHISHING).otherwise(labels.LEGITIMATE)
    return df.withColumn(column, F.when(guard, mapped).otherwise(text))


def drop_empty(df: DataFrame) -> DataFrame:
    """Drop rows in which subject and body are both null or ''."""
    return df.where(~(blank(F.col("subject")) & blank(F.col("body"))))


def fill_empty(df: DataFrame) -> DataFrame:
    return df.na.fill("")


def collapse_text(df: DataFrame) -> DataFrame:
    return df.withColumns({c: collapse_ws(F.col(c)) for c in ("subject", "body")})


def content_digest(columns: list[str]) -> Column:
    """SHA-256 over the length-prefixed columns; null differs from ''."""
    parts = []
    for name in columns:
        c = F.col(name)
        parts += [F.coalesce(F.length(c), F.lit(-1)).cast("string"), F.lit(":"), or_empty(c)]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def dedup(df: DataFrame, columns: list[str], order: str = "msg_id") -> DataFrame:
    """Keep the row with the smallest ``order`` among equal ``columns``.

    What is grouped are digests and ``order``, which each map task reduces first,
    so a text that fills a third of the table does not pile up in one reducer; rows
    whose ``order`` was kept are picked by a hash join afterwards. Texts are neither
    sorted nor aggregated. ``order`` names a row: it must be unique and the same
    whenever ``df`` is evaluated.
    """
    kept = df.select(content_digest(columns).alias("_digest"), F.col(order).alias("_o"))
    kept = kept.groupBy("_digest").agg(F.min("_o").alias("_o")).select("_o")
    return df.join(kept.hint("shuffle_hash"), F.col(order).eqNullSafe(F.col("_o")), "left_semi")


def dedup_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows before, after and removed by ``dedup``."""
    return df.agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.countDistinct(content_digest(columns)).alias("rows_after"),
    ).withColumn("removed", F.col("rows_before") - F.col("rows_after"))


def clean_mail(df: DataFrame, order: str = "msg_id") -> DataFrame:
    """The ingest chain. The order of the steps matters."""
    df = require_mail_columns(coalesce_aliases(normalize_headers(df)))
    df = df.withColumn("label", labels.normalize(F.col("label").cast("string")))
    df = df.where(F.col("label").isNotNull())
    df = collapse_text(fill_empty(drop_empty(df)))
    return dedup(df, ["from", "subject", "body"], order)


def relevant_fields(df: DataFrame) -> DataFrame:
    """Mail columns and the optional extras that exist."""
    return df.select(*[c for c in [*MAIL_COLUMNS, *OPTIONAL_COLUMNS] if c in df.columns])


def labelled_only(df: DataFrame) -> DataFrame:
    return df.where(F.col("label").isin(labels.PHISHING, labels.LEGITIMATE))


def placeholders(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "subject": F.coalesce(F.col("subject"), F.lit("[No Subject]")),
            "body": F.coalesce(F.col("body"), F.lit("[No Body]")),
        }
    )


def min_length(df: DataFrame, characters: int = 10) -> DataFrame:
    return df.where(F.length("body") >= characters)


def drop_nan_subject(df: DataFrame) -> DataFrame:
    """Drop subjects containing 'nan' in any case, also inside words."""
    return df.where(~F.lower(F.coalesce("subject", F.lit(""))).contains("nan"))


def meaningful_only(df: DataFrame) -> DataFrame:
    return df.where(is_meaningful(F.col("body")))


def clean_training(df: DataFrame) -> DataFrame:
    """The optional training chain: placeholders, dedup and quality filters.

    The filters depend only on subject and body, which a group of duplicates
    shares, so they run before the dedup shuffle with the same result.
    """
    df = meaningful_only(drop_nan_subject(min_length(placeholders(df))))
    return dedup(df, ["subject", "body"])


def removal_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """Row counts around a filter and the removed share in percent."""
    n = before.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        after.agg(F.count(F.lit(1)).alias("rows_after"))
        .withColumn("rows_before", n)
        .withColumn("removed", F.col("rows_before") - F.col("rows_after"))
        .withColumn("removed_pct", F.round(F.col("removed") * 100.0 / F.col("rows_before"), 2))
        .select("rows_before", "rows_after", "removed", "removed_pct")
    )


def valid_binary(df: DataFrame, target: str = "y") -> DataFrame:
    """Drop null targets, round to integer, keep only 0 and 1."""
    rounded = F.rint(F.col(target).cast("double")).cast("int")
    return df.where(rounded.isin(0, 1)).withColumn(target, rounded)


def longest_text(columns: list[str], minimum: int = 100) -> Column:
    """The longest of several texts if it exceeds ``minimum``, else ''.

    Ties go to the earlier column.
    """
    items = F.array(
        *[
            F.struct((-F.coalesce(F.length(c), F.lit(0))).alias("k"), F.lit(i).alias("i"), F.col(c).alias("v"))
            for i, c in enumerate(columns)
        ]
    )
    best = F.array_min(items)
    return F.when(-best["k"] > minimum, best["v"]).otherwise(F.lit(""))
