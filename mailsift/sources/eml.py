"""EML files. Parsing MIME is the one step that needs a Python worker."""

from __future__ import annotations

import email
import re
from email import policy

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.functions import labels
from mailsift.functions.text import HTML_TAG

#: Messages parsed and handed on at a time; more of them never lie side by side as text.
SLICE = 128
FIELDS = ["from", "reply_to", "subject", "body"]


def _first_body(msg) -> str:
    """First text/plain part; a single html message loses its tags."""
    if msg.is_multipart():
        plain = [p for p in msg.iter_parts() if p.get_content_type() == "text/plain"]
        return plain[0].get_content() if plain else ""
    kind = msg.get_content_type()
    if kind == "text/html":
        return re.sub(HTML_TAG, " ", msg.get_content())
    return msg.get_content() if kind == "text/plain" else ""


def _content(part) -> str:
    """The part's text; if that cannot be decoded, its payload as Python shows it."""
    try:
        return part.get_content()
    except Exception:  # unknown charset or damaged encoding
        return str(part.get_payload(decode=True))


def _all_bodies(msg) -> str:
    """All plain and html parts that are not attachments, one after another."""
    if not msg.is_multipart():
        return msg.get_content()
    texts = [
        _content(p)
        for p in msg.walk()
        if p.get_content_type() in ("text/plain", "text/html")
        and "attachment" not in str(p.get("Content-Disposition"))
    ]
    return "".join(texts)


def parse_eml(df: DataFrame, content: str, keep: dict[str, str], body_policy: str = "first") -> DataFrame:
    """Headers and body of the messages in a binary column.

    ``body_policy='first'`` leaves unreadable messages out, ``'concat'`` returns
    them with empty fields. ``keep`` maps carried columns to their types.
    """
    body_of = {"first": _first_body, "concat": _all_bodies}[body_policy]
    skip_bad = body_policy == "first"

    def one(raw):
        msg = email.message_from_bytes(bytes(raw), policy=policy.default)
        return [str(msg[h] or "") for h in ("From", "Reply-To", "Subject")] + [body_of(msg)]

    def parse(batches):
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                few = batch.slice(at, SLICE)
                use, rows = [], []
                for i, raw in enumerate(few[content]):
                    try:
                        rows.append(one(raw.as_py()))
                    except Exception:  # damaged message
                        if skip_bad:
                            continue
                        rows.append(["", "", "", ""])
                    use.append(i)
                kept = few.select([*keep]).take(pa.array(use, pa.int64()))
                fields = [pa.array([r[k] for r in rows], pa.string()) for k in range(len(FIELDS))]
                yield pa.RecordBatch.from_arrays([*kept.columns, *fields], names=[*keep, *FIELDS])

    schema = ", ".join(f"`{n}` {t}" for n, t in {**keep, **dict.fromkeys(FIELDS, "string")}.items())
    return df.select(*keep, content).mapInArrow(parse, schema)


def read_eml(spark: SparkSession, paths: list[str], body_policy: str = "first") -> DataFrame:
    """All .eml files below the paths, the label taken from the path."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.eml").load(paths)
    )
    parsed = parse_eml(files, "content", {"path": "string"}, body_policy)
    return parsed.withColumn("label", labels.from_path(F.col("path"))).withColumnRenamed("path", "source_file")
