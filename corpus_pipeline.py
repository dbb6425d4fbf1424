"""From raw documents to a mixed, encoded training corpus in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mailsift.llm import dropout_bpe, mixing, pii, simhash, toxicity
from mailsift.llm.common import stored
from mailsift.sources.tables import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine, learned from all labels, does
    not reject: those that score below 0.5, a score of 0.5 is rejected.

    Null and empty texts have no terms and get the bias alone; texts of any
    length are scored whole; repeated rows are judged alike. Without labels of
    both classes all rows score alike, by the share of toxic labels. All columns
    come back, whatever their names; an empty table gives no rows.
    """
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, machine)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each SimHash component.

    Texts without words, null ones included, are alike and leave one document.
    Of rows that share the smallest id that of smallest text hash stays, of equal
    rows one; rows without an id stay only where no other has one. All columns come back; an empty table gives no rows.
    """
    return simhash.one_of_each(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars, where the table has it, is the
    new text's length. Null texts stay null, empty ones empty, and every row
    stays. Of spans that overlap the one that begins first is replaced. All
    columns come back; an empty table gives no rows.
    """
    out = pii.masked(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: never, once or twice.

    Texts without words have size 0 and come as often as the whole of their
    source does, at least never; rows of a null source are a source of their own, the last. Equal
    lengths are taken in seeded hash order, repeated rows each for itself. All
    columns come back; an empty table gives no rows.
    """
    mixed = mixing.mix(docs).where("times > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of a varied, lossless segmentation, with what names the document.

    Rows that repeat an id and its text, as the mix makes them, are numbered by
    ``copy`` from 1 and drawn for by id and copy, so that copies vary; which of
    them gets which number makes no difference. Null texts have null ids, empty
    ones none; ``lang`` and ``source`` are returned where the table has them.
    An empty table gives no rows.
    """
    alike = W.partitionBy("doc_id", F.xxhash64("text")).orderBy("doc_id")
    names = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    numbered = docs.select(*names, "text", F.row_number().over(alike).alias("copy"))
    key = F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("copy"))
    out = dropout_bpe.encoded(numbered, key, keep=[*names, "copy"])
    return out.select("row.*", "ids", "n_ids", "lossless")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: No SQL: learned models, hashing and seeded segmentation. Tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is kept in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
