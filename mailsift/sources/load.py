"""Loading mixed folders of mail into one cleaned table.

Files are data here: a manifest has a row for each file with its layout and state,
and the lines of all files meet it by path, so any number of files and layouts is
one plan, and no list of paths comes to the driver.
"""

from __future__ import annotations

import logging
from collections import defaultdict
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.functions import labels
from mailsift.functions.text import constant_strings
from mailsift.operators import clean, lines, setops
from mailsift.sources import csv, eml, textmail

log = logging.getLogger(__name__)

EMPTY = "from string, reply_to string, subject string, body string, label string, source_file string"


def list_files(spark: SparkSession, paths: list[str], pattern: str) -> list[str]:
    """File paths below ``paths``; only names are read. Missing paths warn."""
    found = []
    for path in paths:
        try:
            files = (
                spark.read.format("binaryFile").option("recursiveFileLookup", True)
                .option("pathGlobFilter", pattern).load(path).select("path")
            )
            found += [r["path"] for r in files.collect()]
        except AnalysisException:
            log.warning("skipping missing path %s", path)
    return sorted(set(found))


def _headers(spark: SparkSession, files: list[str]) -> dict[str, list[str]]:
    """Column names of every file from its first line: one job for all files."""
    if not files:
        return {}
    lines = spark.read.option("encoding", "ISO-8859-1").text(files)
    first = lines.where("_metadata.file_block_start = 0").select(
        F.col("_metadata.file_path").alias("path"), "value", F.monotonically_increasing_id().alias("n")
    )
    rows = first.groupBy("path").agg(F.min_by("value", "n").alias("value")).collect()
    return {unquote(r["path"]): csv.header_names(r["value"].split(",")) for r in rows}


def read_csv_files(spark: SparkSession, files: list[str], quoting: bool = False) -> list[DataFrame]:
    """One reader per layout: known names first, then files grouped by header."""
    by_layout: dict[tuple, list[str]] = defaultdict(list)
    headers = _headers(spark, [f for f in files if f.rsplit("/", 1)[-1] not in csv.POSITIONAL])
    for path in files:
        name = path.rsplit("/", 1)[-1]
        if name in csv.POSITIONAL:
            by_layout[("positional", name in csv.ONLY_PHISHING, *csv.POSITIONAL[name])].append(path)
        else:
            kind = "wide" if name == csv.WIDE else "lenient"
            by_layout[(kind, False, *headers.get(unquote(path), []))].append(path)
    frames = []
    for (kind, only_phishing, *names), group in by_layout.items():
        if not names:
            continue
        df = csv.read_lenient(spark, group, names, header=True, quoting=quoting)
        if kind == "positional":
            df = csv.positional(df, only_phishing)
        elif kind == "wide":
            df = clean.numeric_labels(csv.wide(df)) if {"label", "class"} & set(df.columns) else csv.wide(df)
        frames.append(clean.require_mail_columns(clean.coalesce_aliases(clean.normalize_headers(df))))
    return frames


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths that exist; missing ones warn."""
    found = []
    for path in paths:
        try:
            spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
            found.append(path)
        except AnalysisException:
            log.warning("skipping missing path %s", path)
    return found


def csv_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, file, block, n, value): lines of all CSV files below the paths, with
    their place. Files that cannot be read give no lines."""
    reader = spark.read.option("recursiveFileLookup", True).option("ignoreCorruptFiles", True)
    m = F.col("_metadata")
    # the text reader hands over bytes as they are
    value = F.decode(F.col("value").cast("binary"), "ISO-8859-1").alias("value")
    return reader.option("pathGlobFilter", "*.csv").text(paths).select(
        m["file_path"].alias("path"), m["file_name"].alias("file"), m["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("n"), value
    )


def _column_names(header: F.Column) -> F.Column:
    """Names of a header line as ``header_names`` and ``normalize_headers`` give
    them; a name that repeats gets its position added."""
    cells = F.transform(F.split(header, ","), lambda c, i: F.when(F.trim(c).rlike(r"^\d*$"), F.concat(F.lit("column_"), i)).otherwise(clean.snake_case_values(F.trim(c))))
    return F.transform(cells, lambda c, i: F.when(F.array_position(cells, c) != i + 1, F.concat(c, F.lit("_"), i)).otherwise(c))


def manifest(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A row for each CSV file below the paths: path, file, length, first (place of
    its first line), names of its columns, layout and state.

    Layouts: positional (known by file name), wide, csv (a header with a mail
    column), dump (no such header, but lines that look like mail headers) and
    unknown. States: ok, and damaged for a file with NUL characters or one that has
    bytes but gives no lines. Only files that are ok are loaded. Files of no bytes
    have no row, as Spark's readers skip them.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(paths)
    listed = listed.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("length"))
    start = csv_lines(spark, paths).where("block = 0")
    heads = F.col("value").rlike("^(Subject|From|To|Date):")
    facts = start.groupBy("path").agg(F.min("n").alias("first"), F.max(F.col("value").contains("\x00")).alias("nul"), F.max(heads).alias("heads"))
    header = start.join(facts, (start["path"] == facts["path"]) & (start["n"] == facts["first"]), "left_semi").select(F.col("path").alias("_p"), F.col("value").alias("header"))
    m = listed.join(facts, "path", "left").join(header, F.col("path") == F.col("_p"), "left").drop("_p")
    fixed = F.lit(None).cast("array<string>")
    for name, columns in csv.POSITIONAL.items():
        fixed = F.when(F.col("file") == name, constant_strings(columns)).otherwise(fixed)
    names = F.coalesce(fixed, _column_names(F.col("header")))
    known = constant_strings([*clean.MAIL_COLUMNS, *[a for v in clean.ALIASES.values() for a in v]])
    layout = (
        F.when(fixed.isNotNull(), "positional").when(F.col("file") == csv.WIDE, "wide")
        .when(F.arrays_overlap(names, known), "csv").when(F.col("heads"), "dump").otherwise("unknown")
    )
    state = F.when(F.col("first").isNull() | F.col("nul"), "damaged").otherwise("ok")
    return m.select("path", "file", "length", "first", names.alias("names"), layout.alias("layout"), state.alias("state"))


def _fields_of(rows: DataFrame) -> DataFrame:
    """Lines of CSV layouts as mail columns, optional columns and ``extras``, a map
    of what else a file has. Short rows are padded, overlong ones dropped."""
    width = F.size("names")
    rows = rows.where((F.col("n") != F.col("first")) & (F.trim("value") != "")).withColumn("cells", F.split("value", ","))
    rows = rows.where(F.size("cells") <= width)
    filled = F.transform(F.slice(F.concat("cells", F.array_repeat(F.lit(""), width)), F.lit(1), width), lambda c: F.nullif(c, F.lit("")))
    rows = rows.withColumn("cells", filled)

    def cell(name: str):
        return F.get("cells", F.array_position("names", name).cast("int") - 1)

    mail = {c: F.coalesce(*[cell(a) for a in [c, *clean.ALIASES[c]]]) for c in clean.MAIL_COLUMNS}
    # a wide file's text and class stand in only where it has no body or label
    for c in ("body", "label"):
        mail[c] = F.when((F.col("layout") == "wide") & F.array_contains("names", c), cell(c)).otherwise(mail[c])
    benign = F.when((mail["label"] == "0") & ~F.col("file").isin(csv.ONLY_PHISHING), labels.LEGITIMATE)
    mail["label"] = F.when(F.col("layout") == "positional", F.when(mail["label"] == "1", labels.PHISHING).otherwise(benign)).otherwise(mail["label"])
    own = [*clean.MAIL_COLUMNS, *clean.OPTIONAL_COLUMNS]
    extras = F.map_filter(F.map_from_arrays("names", "cells"), lambda k, v: ~k.isin(own) & v.isNotNull())
    return rows.select(
        F.struct("path", "block", "n").alias("msg_id"), F.col("file").alias("source_file"), "layout",
        *[v.alias(c) for c, v in mail.items()], *[cell(c).alias(c) for c in clean.OPTIONAL_COLUMNS], extras.alias("extras"),
    )


def read_csv_mail(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Mail of all CSV files below the paths that are ok, dumps assembled."""
    files = manifest(spark, paths).where("state = 'ok'")
    rows = csv_lines(spark, paths).join(files.select("path", "first", "names", "layout"), "path")
    table = _fields_of(rows.where(F.col("layout") != "dump"))
    wide = clean.numeric_labels(table.where("layout = 'wide' and body is not null"))
    table = table.where(F.col("layout") != "wide").unionByName(wide).drop("layout")
    dumps = rows.where("layout = 'dump'").select(F.col("path").alias("file"), "block", F.col("n").alias("line_no"), F.col("value").alias("line"))
    mail = lines.assemble(dumps)
    name = F.element_at(F.split("file", "/"), -1).alias("source_file")
    mail = mail.select(F.struct(F.col("file").alias("path"), F.lit(0).cast("bigint").alias("block"), F.col("rec").alias("n")).alias("msg_id"), name, "from", "subject", "receiver", "date", "body", "label")
    return table.unionByName(mail, allowMissingColumns=True)


def load_messages(spark: SparkSession, paths: list[str], quoting: bool = False) -> DataFrame:
    """All .eml and .csv mail below the paths, unioned and cleaned.

    ``msg_id`` is the place of a row: path, split and line. ``extras`` holds what a
    file has beyond the mail columns. Damaged files are left out; see
    ``manifest``. With ``quoting`` fields may be quoted and span lines; such files
    are read layout by layout.
    """
    found = existing(spark, paths)
    if not found:
        log.warning("no mail found")
        return spark.createDataFrame([], EMPTY)
    at = lambda path, n: F.struct(path.alias("path"), F.lit(0).cast("bigint").alias("block"), n.cast("bigint").alias("n")).alias("msg_id")
    if quoting:
        keep = [*clean.MAIL_COLUMNS, *clean.OPTIONAL_COLUMNS, "source_file"]
        frames = [f.select(*[c for c in keep if c in f.columns]) for f in read_csv_files(spark, list_files(spark, found, "*.csv"), True)]
        table = [f.select(at(F.col("source_file"), F.monotonically_increasing_id()), "*") for f in frames]
    else:
        table = [read_csv_mail(spark, found)]
    mails = eml.read_eml(spark, found)
    keep = [c for c in [*clean.MAIL_COLUMNS, "source_file"] if c in mails.columns]
    every = setops.union_outer([*table, mails.select(at(F.col("source_file"), F.lit(0)), *keep)])
    order = [*clean.MAIL_COLUMNS, *[c for c in every.columns if c not in clean.MAIL_COLUMNS]]
    return clean.clean_mail(clean.require_mail_columns(every)).select(*order)


def read_mail(spark: SparkSession, path: str, index: int = 0) -> DataFrame:
    """Mail of one file by its suffix; other suffixes are read as text."""
    low = path.lower()
    if low.endswith(".eml"):
        return eml.read_eml(spark, [path], "concat").select(*clean.MAIL_COLUMNS[:4])
    if low.endswith(".csv"):
        names = next(iter(_headers(spark, [path]).values()), [])
        df = csv.read_lenient(spark, [path], names, encoding="UTF-8", quoting=True)
        df = clean.require_mail_columns(df, default="")
        df = df.withColumn("_row", F.monotonically_increasing_id())
        return csv.pick_row(df, "_row", index).select(*clean.MAIL_COLUMNS[:4])
    return textmail.read_text_mail(spark, [path]).select(*clean.MAIL_COLUMNS[:4])
