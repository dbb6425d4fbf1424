"""CSV sources: lenient, positional and wide files, and ragged text rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailsift.functions import labels
from mailsift.functions.text import strip_ws

BAD = "_bad"

# --- fixed values: layouts of files without a usable header, by file name ------------
THREE = ["subject", "body", "label"]
SEVEN = ["sender", "receiver", "date", "subject", "body", "urls", "label"]
POSITIONAL = {"Enron.csv": THREE, "Ling.csv": THREE, "Nazario.csv": SEVEN, "Nigerian_Fraud.csv": SEVEN}
ONLY_PHISHING = ["Nazario.csv", "Nigerian_Fraud.csv"]
WIDE = "phishing_email.csv"
ROLES = {
    "subject": ["subject", "title"],
    "body": ["body", "content", "text", "message"],
    "label": ["label", "class", "type", "spam"],
}
DELIMITERS = [",", ";", "\t", "|"]
# ---------------------------------------------------------------------------------------


def string_schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in [*names, BAD]])


def lenient_options(sep: str = ",", quoting: bool = False) -> dict[str, str]:
    """Quoting off by default; malformed rows are kept aside in ``_bad``."""
    options = {"sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}
    if quoting:
        return {**options, "quote": '"', "escape": '"', "multiLine": "true"}
    return {**options, "quote": ""}


def drop_overlong(df: DataFrame, width: int, sep: str = ",") -> DataFrame:
    """Rows with too many fields go, short rows stay padded with nulls."""
    fields = F.length(BAD) - F.length(F.replace(F.col(BAD), F.lit(sep), F.lit(""))) + 1
    return df.where(F.col(BAD).isNull() | (fields <= width)).drop(BAD)


def read_lenient(
    spark: SparkSession,
    paths: list[str],
    names: list[str],
    header: bool = True,
    sep: str = ",",
    encoding: str = "ISO-8859-1",
    quoting: bool = False,
) -> DataFrame:
    """Read CSV files of one layout with every column as string."""
    reader = spark.read.schema(string_schema(names)).options(**lenient_options(sep, quoting))
    raw = reader.option("encoding", encoding).option("header", header).option("enforceSchema", True).csv(paths)
    tagged = raw.select("*", F.col("_metadata.file_name").alias("source_file"))
    return tagged.drop(BAD) if quoting else drop_overlong(tagged, len(names), sep)


def parse_lenient(df: DataFrame, line: str, names: list[str], keep: list[str], sep: str = ",") -> DataFrame:
    """The same rules for CSV lines that already are a column."""
    ddl = ", ".join(f"`{n}` string" for n in [*names, BAD])
    parsed = F.from_csv(line, ddl, lenient_options(sep))
    rows = df.select(*keep, parsed.alias("_r")).select(*keep, "_r.*")
    return drop_overlong(rows, len(names), sep)


def positional(df: DataFrame, only_phishing: bool = False) -> DataFrame:
    """Rename the sender and map the 0/1 label of a positional source."""
    if "sender" in df.columns:
        df = df.withColumnRenamed("sender", "from")
    mapped = F.when(F.col("label") == "1", labels.PHISHING)
    if not only_phishing:
        mapped = mapped.when(F.col("label") == "0", labels.LEGITIMATE)
    return df.withColumn("label", mapped)


def wide(df: DataFrame) -> DataFrame:
    """Keep all columns; text and class stand in for body and label."""
    if "body" not in df.columns and "text" in df.columns:
        df = df.withColumn("body", F.col("text"))
    if "label" not in df.columns and "class" in df.columns:
        df = df.withColumn("label", F.col("class"))
    if "body" in df.columns:
        df = df.dropna(subset=["body"])
    if "label" in df.columns and dict(df.dtypes)["label"] != "string":
        df = df.withColumn("label", labels.numeric(F.col("label")))
    return df


def header_names(names: list[str]) -> list[str]:
    """Empty or numeric header cells become column_<position>."""
    return [f"column_{i}" if not n.strip() or n.strip().isdigit() else n.strip() for i, n in enumerate(names)]


def infer_roles(names: list[str]) -> dict[str, str]:
    """Which column plays subject, body and label; the last match wins."""
    found = {}
    for name in names:
        role = next((r for r, keys in ROLES.items() if any(k in name.lower() for k in keys)), None)
        if role:
            found[role] = name
    return found


def with_roles(df: DataFrame) -> DataFrame:
    roles = infer_roles(df.columns)
    return df.withColumns({role: F.col(f"`{name}`") for role, name in roles.items()})


def align_fields(parts: Column, width: int) -> Column:
    """Pad with '' or cut to ``width`` fields, each stripped."""
    padded = F.concat(parts, F.array_repeat(F.lit(""), width))
    return F.transform(F.slice(padded, 1, width), strip_ws)


def delimiter_vote(text: Column, lines: int = 20) -> Column:
    """The most frequent delimiter of the first lines, ties to the earlier one."""
    head = F.array_join(F.slice(F.split(text, "\n"), 1, lines), "\n")

    def count(d):
        return F.length(head) - F.length(F.replace(head, F.lit(d), F.lit("")))

    votes = F.array(*[F.struct((-count(d)).alias("n"), F.lit(i).alias("i"), F.lit(d).alias("d")) for i, d in enumerate(DELIMITERS)])
    return F.array_min(votes)["d"]


def looks_like_csv(text: Column, lines: int = 20, commas: int = 20) -> Column:
    head = F.array_join(F.slice(F.split(text, "\n"), 1, lines), "\n")
    return F.length(head) - F.length(F.replace(head, F.lit(","), F.lit(""))) > commas


def split_two(df: DataFrame, text: str, keep: list[str], file: str | None = None) -> DataFrame:
    """Texts that look like CSV: the first two comma parts of every line.

    With ``file``, the column of file names, records get the label it implies.
    """
    if file is not None:
        df = df.withColumn("label", labels.from_dump_name(F.col(file)))
        keep = [*keep, "label"]
    lines = df.where(looks_like_csv(F.col(text))).select(*keep, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    parts = F.split("line", ",")
    return lines.where((strip_ws(F.col("line")) != "") & (F.size(parts) >= 2)).select(
        *keep, "line_no", strip_ws(parts[0]).alias("subject"), strip_ws(parts[1]).alias("body")
    )


def _has_cells(sep: str, n: Column):
    return lambda line: F.size(F.split(line, f"[{sep}]", -1)) == n


def dialect(first: Column, lines: Column) -> Column:
    """The dialect of a file from its first line and its first lines: sep, header,
    columns and even, the share of lines with as many columns.

    All separators are scored with and without header. The earliest separator that
    parts the first line wins; the line is a header if its cells are distinct and
    none is empty or a number. If no separator parts it, ``sep`` is null.
    """
    scored = []
    for order, d in enumerate(DELIMITERS):
        cells = F.split(first, f"[{d}]", -1)
        n = F.size(cells)
        even = F.size(F.filter(lines, _has_cells(d, n))) / F.size(lines)
        named = ~F.exists(cells, lambda c: (strip_ws(c) == "") | strip_ws(c).rlike("^[0-9.]+$")) & (F.size(F.array_distinct(cells)) == n)
        for header in (True, False):
            scored.append(F.struct(
                (n <= 1).alias("whole"), F.lit(order).alias("order"), (named != F.lit(header)).alias("odd"),
                F.when(n > 1, F.lit(d)).alias("sep"), F.lit(header).alias("header"), n.alias("columns"), even.alias("even"),
            ))
    return F.array_min(F.array(*scored))


def preview_files(files: DataFrame, text: str, keep: list[str], rows: int = 5) -> DataFrame:
    """The first ``rows`` rows of each file in its own dialect: ``keep``, sep,
    header, names, row_no from 1 and cells. Blank lines are left out, files
    without any other line have no rows."""
    lines = F.filter(F.split(text, "\r?\n"), lambda x: strip_ws(x) != "")
    f = files.select(*keep, F.slice(lines, 1, rows + 1).alias("_lines")).where(F.size("_lines") > 0)
    f = f.withColumn("_d", dialect(F.get("_lines", F.lit(0)), F.col("_lines"))).select("*", "_d.sep", "_d.header")

    def cells(line: Column) -> Column:
        parted = F.array(line)
        for d in DELIMITERS:
            parted = F.when(F.col("sep") == d, F.split(line, f"[{d}]", -1)).otherwise(parted)
        return parted

    first = cells(F.get("_lines", F.lit(0)))
    names = F.when(F.col("header"), first).otherwise(F.transform(first, lambda c, i: F.concat(F.lit("column_"), i)))
    shown = F.slice("_lines", F.when(F.col("header"), 2).otherwise(1), rows)
    f = f.select(*keep, "sep", "header", names.alias("names"), F.posexplode(shown).alias("_n", "_line"))
    return f.select(*keep, "sep", "header", "names", (F.col("_n") + 1).alias("row_no"), cells(F.col("_line")).alias("cells"))


def pick_row(df: DataFrame, order: str, index: int = 0) -> DataFrame:
    """The index-th row; an index out of range gives the first."""
    if index and df.count() <= index:
        index = 0
    return df.orderBy(order).offset(index).limit(1)
