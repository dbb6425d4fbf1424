"""Mail-shaped views over the shared tables, in Spark and in SQL.

The shared tables hold prose, pages and vectors rather than mail, so every
query starts from one of these views. They scan whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.functions.text import tokens
from mailsift.sources.tables import table

RAW_LABELS = [
    "spam", "Phish", "malicious", "BAD", "1", "1.0", "true", "ham", "Legit",
    "benign", "good", "0", "0.0", "false", "maybe", "unknown", None,
]


def _dealt(df: DataFrame, key: str) -> DataFrame:
    """Dealt out to as many partitions as the session asks for, if it does.

    The small test tables are files of one row group, which cannot be split; the
    local session asks for its cores. Nothing depends on the size of the data.
    """
    n = int(df.sparkSession.conf.get("spark.mailsift.deal", "0"))
    return df.repartition(n, key) if n else df


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return _dealt(table(spark, sf, "documents"), "doc_id")


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return _dealt(table(spark, sf, "pages"), "page_id")


def mail(spark: SparkSession, sf: str) -> DataFrame:
    """documents with labels: first line is the subject, the rest the body."""
    d = documents(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left")
    subject = F.substring_index("text", "\n", 1)
    sender = F.concat("lang", F.lit("@"), "source", F.lit(".example.org"))
    return d.select(
        F.col("doc_id").alias("msg_id"),
        sender.alias("from"),
        F.when(F.col("toxic") == 1, F.concat("lang", F.lit("@"), "source", F.lit(".example.net")))
        .when(F.col("quality") == 1, sender)
        .alias("reply_to"),
        subject.alias("subject"),
        F.when(
            F.length(subject) < F.length("text"), F.substring("text", F.length(subject) + 2, F.length("text"))
        ).otherwise(F.lit("")).alias("body"),
        F.when(F.col("toxic") == 1, "phishing").when(F.col("toxic") == 0, "legitimate").alias("label"),
        F.col("source").alias("source_file"),
    )


def plain_mail(spark: SparkSession, sf: str) -> DataFrame:
    """mail whose sender columns don't tell the label, so that a classifier has to
    read the text."""
    return mail(spark, sf).withColumn("reply_to", F.col("from"))


def mail_raw(spark: SparkSession, sf: str) -> DataFrame:
    """mail with raw label spellings and body text spread over alias columns."""
    m = mail(spark, sf)
    spellings = F.array(*[F.lit(x) for x in RAW_LABELS])
    return m.select(
        "msg_id",
        F.col("from").alias("sender"),
        F.when(F.col("msg_id") % 4 != 0, F.col("from")).alias("from"),
        F.col("reply_to").alias("replyto"),
        F.when(F.col("msg_id") % 7 == 0, F.lit(None)).when(F.col("msg_id") % 7 == 1, "").otherwise(F.col("subject")).alias("subject"),
        F.when(F.col("msg_id") % 3 != 0, F.col("body")).alias("body"),
        F.when(F.col("msg_id") % 5 != 0, F.col("body")).alias("content"),
        F.when(F.col("msg_id") % 2 == 0, F.col("body")).alias("text"),
        F.get(spellings, (F.col("msg_id") % 17).cast("int")).alias("raw_label"),
        "source_file",
    )


def _with_addresses(pages: DataFrame, *more: Column) -> DataFrame:
    host = F.regexp_extract("url", r"^https?://([^/?#]*)", 1)
    sender = F.concat(F.lit("bot@"), host)
    return pages.select(
        F.col("page_id").alias("msg_id"),
        F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("X <"), sender, F.lit(">"))).otherwise(sender).alias("from"),
        F.concat(F.lit("bot@"), F.substring_index(host, ".", -2)).alias("reply_to"),
        *more,
    )


def addresses(spark: SparkSession, sf: str) -> DataFrame:
    """Sender and reply addresses built from the host of each page."""
    return _with_addresses(pages(spark, sf))


def url_texts(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).select(
        F.col("page_id").alias("msg_id"), F.concat("url", F.lit(" "), "html").alias("text")
    )


def page_mail(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as mail: the URL as subject, the markup as body."""
    return _with_addresses(pages(spark, sf), F.col("url").alias("subject"), F.col("html").alias("body"))


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and pages together, so that URL features have something to find."""
    m = mail(spark, sf).select("msg_id", "from", "reply_to", "subject", "body", "label")
    p = page_mail(spark, sf).withColumn("msg_id", F.col("msg_id") + 1_000_000_000)
    return m.unionByName(p, allowMissingColumns=True)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents with a score: the share of repeated words, 0 without words.

    The score is made before the join, so that neither texts nor words are moved by it."""
    d = documents(spark, sf).select("doc_id", "source", "lang", tokens(F.col("text")).alias("w"))
    share = F.when(F.size("w") > 0, F.round(1 - F.size(F.array_distinct("w")) / F.size("w"), 4))
    # never null, so filters on the score need no second evaluation of the text
    rows = d.select("doc_id", "source", "lang", F.coalesce(share, F.lit(0.0)).alias("p"))
    return rows.join(table(spark, sf, "labels"), "doc_id").select(
        F.col("doc_id").alias("msg_id"),
        (1 - F.col("quality")).cast("int").alias("y"),
        "p",
        F.col("source").alias("source_file"),
        F.col("lang"),
    )


def scored_pred(spark: SparkSession, sf: str, threshold: float = 0.5) -> DataFrame:
    return scored(spark, sf).withColumn("prediction", (F.col("p") >= threshold).cast("int"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as doubles; label 0 is the minority class."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("msg_id"),
        F.col("embedding").cast("array<double>").alias("x"),
        (F.col("label") == 0).cast("int").alias("y"),
    )


# --- the same views in SQL ---------------------------------------------------------

WS_SET = (
    r"\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
WS = f"[{WS_SET}]"
NWS = f"[^{WS_SET}]"
URL_RE = f"https?://{NWS}+|www\\.{NWS}+"

_LABEL_LIST = ", ".join("NULL" if x is None else f"'{x}'" for x in RAW_LABELS)

CTE: dict[str, tuple[list[str], str]] = {
    "mail": (
        [],
        """SELECT d.doc_id AS msg_id, d.lang || '@' || d.source || '.example.org' AS "from",
             CASE WHEN l.toxic = 1 THEN d.lang || '@' || d.source || '.example.net'
                  WHEN l.quality = 1 THEN d.lang || '@' || d.source || '.example.org' END AS reply_to,
             split_part(d.text, chr(10), 1) AS subject,
             CASE WHEN strpos(d.text, chr(10)) > 0 THEN substr(d.text, strpos(d.text, chr(10)) + 1) ELSE '' END AS body,
             CASE WHEN l.toxic = 1 THEN 'phishing' WHEN l.toxic = 0 THEN 'legitimate' END AS label,
             d.source AS source_file
           FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    ),
    "mail_raw": (
        ["mail"],
        f"""SELECT msg_id, "from" AS sender, CASE WHEN msg_id % 4 <> 0 THEN "from" END AS "from", reply_to AS replyto,
             CASE WHEN msg_id % 7 = 0 THEN NULL WHEN msg_id % 7 = 1 THEN '' ELSE subject END AS subject,
             CASE WHEN msg_id % 3 <> 0 THEN body END AS body,
             CASE WHEN msg_id % 5 <> 0 THEN body END AS content,
             CASE WHEN msg_id % 2 = 0 THEN body END AS text,
             ([{_LABEL_LIST}])[(msg_id % 17) + 1] AS raw_label, source_file FROM mail""",
    ),
    "addr": (
        [],
        r"""SELECT page_id AS msg_id,
             CASE WHEN page_id % 7 = 0 THEN 'X <bot@' || h || '>' ELSE 'bot@' || h END AS "from",
             'bot@' || array_to_string(list_slice(string_split(h, '.'), greatest(len(string_split(h, '.')) - 1, 1), len(string_split(h, '.'))), '.') AS reply_to
           FROM (SELECT page_id, regexp_extract(url, '^https?://([^/?#]*)', 1) AS h FROM pages)""",
    ),
    "url_tbl": ([], "SELECT page_id AS msg_id, url || ' ' || html AS text FROM pages"),
    "page_mail": (
        ["addr"],
        """SELECT a.*, p.url AS subject, p.html AS body FROM addr a JOIN pages p ON a.msg_id = p.page_id""",
    ),
    "corpus": (
        ["mail", "page_mail"],
        """SELECT msg_id, "from", reply_to, subject, body, label FROM mail
           UNION ALL SELECT msg_id + 1000000000, "from", reply_to, subject, body, NULL FROM page_mail""",
    ),
    "scored": (
        [],
        f"""SELECT msg_id, y, coalesce(round(1 - len(list_distinct(w)) / nullif(len(w), 0)::double, 4), 0)::double AS p, source_file, lang FROM (
             SELECT d.doc_id AS msg_id, (1 - l.quality)::int AS y, d.source AS source_file, d.lang,
               list_filter(regexp_split_to_array(d.text, '{WS}+'), lambda x: x <> '') AS w
             FROM documents d JOIN labels l ON d.doc_id = l.doc_id)""",
    ),
    "scored_pred": (["scored"], "SELECT *, (p >= 0.5)::int AS prediction FROM scored"),
    "vectors": (
        [],
        "SELECT vec_id AS msg_id, embedding::double[] AS x, (label = 0)::int AS y FROM embeddings",
    ),
}


def oracle(body: str, *names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``body`` preceded by the named views (and further CTEs) it uses."""
    order: list[str] = []

    def visit(name):
        for dep in CTE[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    parts = [f"{n} AS ({CTE[n][1]})" for n in order] + [f"{n} AS ({q})" for n, q in extra or []]
    return (f"WITH {', '.join(parts)} " if parts else "") + body
