"""Secret scans over an incremental blob ledger.

Every version of every path is named by the SHA-256 of its content. The ledger
holds which blob was scanned under which rule version and what was found. Only
unseen pairs are scanned, once per blob however many paths share it; findings
are joined back to all paths.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.llm.common import blank, frames, stored

LEDGER = "blob string, version string, spans array<struct<start:int,kind:string,stop:int>>"

#: Rules by version: kind -> (pattern, least length, group the length is of).
RULES: dict[str, dict[str, tuple[str, int, int]]] = {
    "base-1": {
        "assign": (r"""(?ia:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
        "access": (r"AKIA[A-Z0-9]+", 18, 0),
        "hex": (r"[0-9a-f]{16,}", 16, 0),
    },
    "added-1": {
        "bearer": (r"(?ia:bearer)\x20+[A-Za-z0-9._~+/-]{20,}=*", 0, 0),
        "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*", 0, 0),
        "key_block": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
        "prefixed": (r"(?:gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})", 0, 0),
    },
}
BASE = ("assign", "access", "hex")
ORDER = [*BASE, *sorted(RULES["added-1"])]
#: A text without any of these cannot match the kind's pattern.
NEEDS = {
    "assign": (b"passw", b"secret", b"token", b"api"), "access": (b"akia",), "bearer": (b"bearer",), "jwt": (b"eyj",), "key_block": (b"-----begin",),
    "prefixed": (b"gh", b"xox", b"sk_live_", b"aiza"),
}


def scan(text: str, kinds: dict[str, tuple[str, int, int]]) -> list[tuple[int, str, int]]:
    """(start, kind, stop) of each finding in code points, in span order."""
    low, out = text.encode().lower(), []
    for kind, (pattern, least, group) in kinds.items():
        if kind in NEEDS and not any(n in low for n in NEEDS[kind]):
            continue
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return sorted(out, key=lambda s: (s[0], ORDER.index(s[1])))


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def blobs(versions: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns in ``row``, ``blob`` and ``content``; a null text is empty."""
    content = blank(F.col(text_col))
    return versions.select(F.struct(*(keep or ["*"])).alias("row"), F.sha2(content, 256).alias("blob"), content.alias("content"))


def new_findings(contents: DataFrame, ledger: DataFrame, versions: list[str] | None = None) -> DataFrame:
    """Ledger rows of the (blob, rule version) pairs that ``ledger`` lacks.

    ``contents`` has blob and content, any number of rows per blob; copies
    collapse before they are shuffled. Append the result to the ledger.
    """
    todo = F.array(*[F.lit(v) for v in versions or RULES])
    one = contents.groupBy("blob").agg(F.first("content").alias("content"))
    seen = ledger.groupBy("blob").agg(F.collect_set("version").alias("seen"))
    due = F.array_except(todo, F.coalesce("seen", F.array().cast("array<string>")))
    open_ = one.join(seen, "blob", "left").select("blob", "content", due.alias("due")).where(F.size("due") > 0)

    def work(batches):
        for b in frames(batches):
            rows = [(k, v, [{"start": s, "kind": kind, "stop": e} for s, kind, e in scan(t, RULES[v])]) for k, t, due in zip(b["blob"], b["content"], b["due"], strict=True) for v in due]
            yield pd.DataFrame(rows, columns=["blob", "version", "spans"])

    return open_.mapInPandas(work, LEDGER)


def findings(versions: DataFrame, ledger: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(row, blob, spans) for every row of ``versions``.

    ``row`` has the columns in ``keep``, all by default; spans are sorted by start, then kind
    as listed. Null texts are empty; texts of any length are scanned whole; repeated
    rows and null paths stay, and extra columns may have any name. Spans that agree
    in place and kind count once. Spans of rule versions no longer listed do not
    count. Empty tables give no rows.
    """
    each = blobs(versions, text_col, keep)
    fresh = new_findings(each.select("blob", "content"), ledger)
    rank = F.array_position(F.array(*[F.lit(k) for k in ORDER]), F.col("s.kind"))
    found = ledger.where(F.col("version").isin(list(RULES))).unionByName(fresh).select("blob", F.explode("spans").alias("s"))
    found = found.select("blob", F.struct("s.start", rank.alias("rank"), "s.kind", "s.stop").alias("s")).groupBy("blob").agg(F.sort_array(F.collect_set("s")).alias("spans"))
    # stored, so that a blob with very many paths can be split in the join
    return each.select("row", "blob").join(stored(found), "blob", "left")


def digest(spans: list[tuple[int, str, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()


def joined(spans: F.Column) -> F.Column:
    """kind:start:end, comma-joined; empty for null."""
    parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"]))
    return F.coalesce(F.array_join(parts, ","), F.lit(""))
