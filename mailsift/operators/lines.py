"""Assembling mail records from the lines of a dump.

A dump may be one file of any size, so everything that depends on line order is
found in two levels: per block of lines, then over the blocks of a file. Headers
and the beginning and end of a body are partial maxima of line positions; lines
are joined to a body block by block, and a record's blocks last. So a record, or a
dump without any boundary, is never one task's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailsift.functions.labels import from_dump_name
from mailsift.functions.text import strip_ws

HEADERS = {"subject": "Subject:", "from": "From:", "receiver": "To:", "date": "Date:"}


def running_count(df: DataFrame, flag: Column, order: str, name: str) -> DataFrame:
    """Inclusive running count of ``flag`` within a file."""
    df = df.withColumn("_flag", F.coalesce(flag.cast("bigint"), F.lit(0)))
    per_block = df.groupBy("file", "block").agg(F.sum("_flag").alias("_n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.select("file", "block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("file", "block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    counted = df.join(offsets, ["file", "block"])
    return counted.withColumn(name, F.col("_off") + F.sum("_flag").over(inside)).drop("_flag", "_off")


def _kind(line: Column, headers: dict[str, str]) -> Column:
    kind = F.when(line == "", "blank")
    for name, prefix in headers.items():
        kind = kind.when(line.startswith(prefix), name)
    return kind.otherwise("body")


def _position() -> Column:
    return F.struct("block", "line_no")


def _after_header(rows: DataFrame) -> DataFrame:
    """Add ``opens``: a body line whose line before, blanks aside, is a header."""
    body = F.col("kind") == "body"
    ends = rows.groupBy("file", "block").agg(F.max_by(body, "line_no").alias("_ends"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("file", "block", F.last("_ends", ignorenulls=True).over(earlier).alias("_before"))
    inside = Window.partitionBy("file", "block").orderBy("line_no")
    before = F.coalesce(F.lag(body).over(inside), F.col("_before"))
    return rows.join(ends, ["file", "block"]).withColumn("opens", body & ~F.coalesce(before, F.lit(False))).drop("_before")


def _in_order(by: str) -> Column:
    return F.expr(f"listagg(part, ' ') WITHIN GROUP (ORDER BY {by})").alias("part")


def assemble(
    lines: DataFrame, boundary: str = "blank", late_header: str = "reset", with_date: bool = True
) -> DataFrame:
    """Records of a dump given as (file, block, line_no, line) rows.

    ``boundary='blank'`` ends a record at a blank line, ``'subject'`` starts one
    at each Subject line. With ``late_header='reset'`` a header after body lines
    makes the next body line start the body again; ``'append'`` keeps all.
    Parts without subject and body are joined to the following record.
    """
    headers = HEADERS if with_date else {k: v for k, v in HEADERS.items() if k != "date"}
    line = strip_ws(F.col("line"))
    rows = lines.select("file", "block", "line_no", line.alias("line"))
    rows = rows.withColumn("kind", _kind(F.col("line"), headers))
    rows = running_count(rows, F.col("kind") == boundary, "line_no", "seg").where(F.col("kind") != "blank")
    rows = _after_header(rows)

    def field(name: str, prefix: str) -> Column:
        value = strip_ws(F.substring("line", len(prefix) + 1, F.length("line")))
        return F.max(F.when(F.col("kind") == name, F.struct(_position().alias("at"), value.alias("value")))).alias(name)

    # a part between boundaries counts once it has a subject or a body
    body = F.col("kind") == "body"
    segs = rows.groupBy("file", "seg").agg(
        F.min("block").alias("block"), *[field(n, p) for n, p in headers.items()],
        F.max(body).alias("has_body"), F.max(F.when(F.col("opens"), _position())).alias("opened"),
    )
    full = (F.coalesce(F.col("subject.value"), F.lit("")) != "") | F.col("has_body")
    segs = running_count(segs.withColumn("full", full), F.col("full"), "seg", "done")
    segs = segs.withColumn("rec", F.col("done") - F.col("full").cast("bigint"))
    recs = segs.groupBy("file", "rec").agg(
        *[F.max(n).alias(n) for n in headers], F.max("has_body").alias("has_body"), F.max("opened").alias("opened")
    ).where(full)

    # The body is the run of body lines after the last header before its end.
    of = segs.select("file", "seg", "rec").join(recs.select("file", "rec", "opened"), ["file", "rec"])
    kept = rows.where(body).select("file", "seg", "block", "line_no", F.col("line").alias("part")).join(of, ["file", "seg"])
    if late_header == "reset":
        kept = kept.where(F.col("opened").isNull() | (_position() >= F.col("opened")))
    texts = kept.groupBy("file", "rec", "block").agg(_in_order("line_no")).groupBy("file", "rec").agg(_in_order("block"))
    text = F.concat(F.lit(" "), F.col("part")) if late_header == "append" else F.col("part")
    fields = {n: F.col(f"{n}.value") for n in headers}
    fields["subject"] = F.coalesce(fields["subject"], F.lit(""))
    label = from_dump_name(F.col("file")).alias("label")
    done = recs.join(texts, ["file", "rec"], "left")
    return done.select("file", "rec", *[c.alias(n) for n, c in fields.items()], F.coalesce(text, F.lit("")).alias("body"), label)
