"""Cleaning, label and predicate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsift.functions import labels, text
from mailsift.operators import clean, report
from mailsift.plans import views
from mailsift.plans.book import Book
from mailsift.plans.views import WS, oracle
from mailsift.sources.tables import table

book = Book()
query = book.query

LABEL_SQL = """CASE WHEN lower({0}) IN ('spam','phish','malicious','bad','1','1.0','true','phishing') THEN 'phishing'
  WHEN lower({0}) IN ('ham','legit','benign','good','0','0.0','false','legitimate') THEN 'legitimate' END"""
EMPTY = "(({0} IS NULL OR {0} = ''))"


def collapse_sql(c: str) -> str:
    return f"trim(regexp_replace({c}, '{WS}+', ' ', 'g'), ' ')"



@query(
    "snake_case",
    "SELECT p_partkey, trim(regexp_replace(lower(p_name || ' (' || p_brand || ')--' || p_type), '[^a-z0-9]+', '_', 'g'), '_') AS name FROM part",
)
def snake_case(spark, sf):
    raw = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")--"), "p_type")
    return table(spark, sf, "part").select("p_partkey", clean.snake_case_values(raw).alias("name"))


@query(
    "alias_coalesce",
    oracle(
        """SELECT msg_id, coalesce("from", sender) AS sender, replyto AS reply_to, subject,
          coalesce(body, content, text) AS body FROM mail_raw""",
        "mail_raw",
    ),
)
def alias_coalesce(spark, sf):
    m = clean.coalesce_aliases(views.mail_raw(spark, sf))
    return m.select("msg_id", F.col("from").alias("sender"), "reply_to", "subject", "body")


@query(
    "require_cols",
    """SELECT conv_id * 1000 + turn AS msg_id, text AS body, NULL::varchar AS sender, NULL::varchar AS reply_to,
      NULL::varchar AS subject, NULL::varchar AS label FROM conversations""",
)
def require_cols(spark, sf):
    c = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("msg_id"), F.col("text").alias("body")
    )
    return clean.require_mail_columns(c).withColumnRenamed("from", "sender")


@query("label_normalize", oracle(f"SELECT msg_id, raw_label, {LABEL_SQL.format('raw_label')} AS label FROM mail_raw", "mail_raw"))
def label_normalize(spark, sf):
    return views.mail_raw(spark, sf).select(
        "msg_id", "raw_label", labels.normalize(F.col("raw_label")).alias("label")
    )


@query(
    "label_numeric",
    """SELECT doc_id, CASE WHEN toxic = 1 THEN 'phishing' ELSE 'legitimate' END AS label,
      CASE WHEN n = 0 THEN NULL WHEN n = 1 THEN 'phishing' END AS mapped FROM (
        SELECT doc_id, toxic, CASE WHEN quality = 1 AND toxic = 0 THEN 2 ELSE toxic END AS n FROM labels) t
      WHERE (SELECT bool_and(regexp_matches(toxic::varchar, '^[01]\\.?0*$')) FROM labels)""".replace(
        "CASE WHEN n = 0 THEN NULL WHEN n = 1 THEN 'phishing' END", "CASE n WHEN 1 THEN 'phishing' WHEN 0 THEN 'legitimate' END"
    ).replace("\\\\", "\\"),
)
def label_numeric(spark, sf):
    t = table(spark, sf, "labels").withColumn(
        "n", F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 2).otherwise(F.col("toxic"))
    )
    guarded = clean.numeric_labels(t.withColumn("label", F.col("toxic").cast("string")))
    return guarded.select("doc_id", "label", labels.numeric(F.col("n")).alias("mapped"))


@query(
    "label_passthrough",
    oracle(
        """SELECT msg_id, CASE WHEN raw_label IS NULL THEN 'unknown'
          WHEN lower(raw_label) IN ('1','spam','phish','phishing') THEN 'phishing'
          WHEN lower(raw_label) IN ('0','ham','legitimate','legit') THEN 'legitimate' ELSE raw_label END AS label
        FROM mail_raw""",
        "mail_raw",
    ),
)
def label_passthrough(spark, sf):
    return views.mail_raw(spark, sf).select("msg_id", labels.passthrough(F.col("raw_label")).alias("label"))


@query(
    "label_from_path",
    """SELECT page_id, CASE WHEN contains(path, 'phish') OR contains(name, 'spam') THEN 'phishing'
        WHEN contains(path, 'legit') OR contains(name, 'ham') THEN 'legitimate' END AS label FROM (
      SELECT page_id, lower(url) AS path, string_split(lower(url), '/')[-1] AS name FROM (
        SELECT page_id, CASE page_id % 5 WHEN 0 THEN url || '/Phish-' || page_id || '.eml' WHEN 1 THEN url || '/spam/' || page_id
          WHEN 2 THEN url || '/LEGIT/x' WHEN 3 THEN url || '/graham.eml' ELSE url END AS url FROM pages))""",
)
def label_from_path(spark, sf):
    kind = F.col("page_id") % 5
    tail = (
        F.when(kind == 0, F.concat(F.lit("/Phish-"), "page_id", F.lit(".eml")))
        .when(kind == 1, F.concat(F.lit("/spam/"), "page_id"))
        .when(kind == 2, "/LEGIT/x").when(kind == 3, "/graham.eml").otherwise(F.lit(""))
    )
    p = table(spark, sf, "pages").withColumn("path", F.concat("url", tail))
    return p.select("page_id", labels.from_path(F.col("path")).alias("label"))


@query("drop_unlabelled", oracle(f"SELECT msg_id, label FROM (SELECT msg_id, {LABEL_SQL.format('raw_label')} AS label FROM mail_raw) WHERE label IS NOT NULL", "mail_raw"))
def drop_unlabelled(spark, sf):
    m = views.mail_raw(spark, sf).select("msg_id", labels.normalize(F.col("raw_label")).alias("label"))
    return m.dropna(subset=["label"])


@query(
    "drop_empty",
    oracle(f"SELECT msg_id, subject, body FROM mail_raw WHERE NOT ({EMPTY.format('subject')} AND {EMPTY.format('body')})", "mail_raw"),
)
def drop_empty(spark, sf):
    return clean.drop_empty(views.mail_raw(spark, sf)).select("msg_id", "subject", "body")


@query(
    "fill_empty",
    oracle("SELECT msg_id, coalesce(subject, '') AS subject, coalesce(body, '') AS body, coalesce(raw_label, '') AS raw_label FROM mail_raw", "mail_raw"),
)
def fill_empty(spark, sf):
    return clean.fill_empty(views.mail_raw(spark, sf).select("msg_id", "subject", "body", "raw_label"))


@query(
    "ws_collapse",
    oracle(f"SELECT msg_id, {collapse_sql('subject')} AS subject, {collapse_sql('body')} AS body FROM mail", "mail"),
)
def ws_collapse(spark, sf):
    return clean.collapse_text(views.mail(spark, sf).select("msg_id", "subject", "body"))


def _first_of(columns):
    return f"row_number() OVER (PARTITION BY {columns} ORDER BY msg_id) = 1"


@query("dedup3", oracle(f'SELECT msg_id, "from" AS sender, subject, body FROM mail QUALIFY {_first_of(chr(34) + "from" + chr(34) + ", subject, body")}', "mail"))
def dedup3(spark, sf):
    m = clean.dedup(views.mail(spark, sf), ["from", "subject", "body"])
    return m.select("msg_id", F.col("from").alias("sender"), "subject", "body")


@query("dedup2", oracle(f"SELECT msg_id, label, source_file, subject, body FROM mail QUALIFY {_first_of('subject, body')}", "mail"))
def dedup2(spark, sf):
    return clean.dedup(views.mail(spark, sf), ["subject", "body"]).select(
        "msg_id", "label", "source_file", "subject", "body"
    )


@query(
    "dedup_stats",
    oracle(
        """SELECT count(*) AS rows_before, (SELECT count(*) FROM (SELECT DISTINCT subject, body FROM mail)) AS rows_after,
          count(*) - (SELECT count(*) FROM (SELECT DISTINCT subject, body FROM mail)) AS removed FROM mail""",
        "mail",
    ),
)
def dedup_stats(spark, sf):
    return clean.dedup_stats(views.mail(spark, sf), ["subject", "body"])


@query(
    "clean_mail",
    oracle(
        f"""SELECT msg_id, sender, reply_to, subject, body, label FROM (
          SELECT msg_id, coalesce("from", sender, '') AS sender, coalesce(replyto, '') AS reply_to,
            {collapse_sql("coalesce(subject, '')")} AS subject,
            {collapse_sql("coalesce(body, content, text, '')")} AS body, {LABEL_SQL.format('raw_label')} AS label
          FROM mail_raw WHERE NOT ({EMPTY.format('subject')} AND {EMPTY.format('coalesce(body, content, text)')}))
        WHERE label IS NOT NULL QUALIFY {_first_of('sender, subject, body')}""",
        "mail_raw",
    ),
)
def clean_mail(spark, sf):
    m = views.mail_raw(spark, sf).withColumnRenamed("raw_label", "label")
    return clean.clean_mail(m).select("msg_id", F.col("from").alias("sender"), "reply_to", "subject", "body", "label")


@query(
    "relevant_fields",
    """SELECT page_id::varchar AS sender, url AS subject, html AS body, NULL::varchar AS label, url AS urls, 'x' AS receiver FROM pages""",
)
def relevant_fields(spark, sf):
    p = table(spark, sf, "pages").select(
        F.col("page_id").cast("string").alias("from"), F.col("url").alias("subject"), F.col("html").alias("body"),
        F.lit(None).cast("string").alias("label"), F.col("url").alias("urls"), F.lit("x").alias("receiver"),
        F.length("html").alias("not_relevant"),
    )
    return clean.relevant_fields(p).withColumnRenamed("from", "sender")


@query("labelled_only", oracle("SELECT msg_id, label FROM mail WHERE label IN ('phishing', 'legitimate')", "mail"))
def labelled_only(spark, sf):
    return clean.labelled_only(views.mail(spark, sf)).select("msg_id", "label")


@query("clean_placeholders", oracle("SELECT msg_id, coalesce(subject, '[No Subject]') AS subject, coalesce(body, '[No Body]') AS body FROM mail_raw", "mail_raw"))
def clean_placeholders(spark, sf):
    return clean.placeholders(views.mail_raw(spark, sf)).select("msg_id", "subject", "body")


@query("min_length", oracle("SELECT msg_id, body FROM mail_raw WHERE length(body) >= 10", "mail_raw"))
def min_length(spark, sf):
    return clean.min_length(views.mail_raw(spark, sf)).select("msg_id", "body")


@query("nan_subject", oracle("SELECT msg_id, subject FROM mail WHERE NOT contains(lower(subject), 'nan')", "mail"))
def nan_subject(spark, sf):
    return clean.drop_nan_subject(views.mail(spark, sf)).select("msg_id", "subject")


MEANINGFUL = r"""len(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+')) > 0
  AND list_avg(list_transform(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+'), lambda x: length(x))) BETWEEN 2 AND 15"""


@query("meaningful", oracle(f"SELECT msg_id, body FROM mail WHERE {MEANINGFUL.format('body')}", "mail"))
def meaningful(spark, sf):
    return clean.meaningful_only(views.mail(spark, sf)).select("msg_id", "body")


_CLEANED = (
    "cleaned",
    f"""SELECT * FROM (SELECT msg_id, coalesce(subject, '[No Subject]') AS subject, coalesce(body, '[No Body]') AS body, raw_label
      FROM mail_raw QUALIFY row_number() OVER (PARTITION BY coalesce(subject, '[No Subject]'), coalesce(body, '[No Body]') ORDER BY msg_id) = 1)
    WHERE length(body) >= 10 AND NOT contains(lower(subject), 'nan') AND {MEANINGFUL.format('body')}""",
)


@query("clean_chain", oracle("SELECT msg_id, subject, body, raw_label FROM cleaned", "mail_raw", extra=[_CLEANED]))
def clean_chain(spark, sf):
    return clean.clean_training(views.mail_raw(spark, sf)).select("msg_id", "subject", "body", "raw_label")


@query(
    "clean_stats",
    oracle(
        """SELECT b AS rows_before, a AS rows_after, b - a AS removed, round((b - a) * 100.0 / b, 2)::double AS removed_pct
        FROM (SELECT (SELECT count(*) FROM mail_raw) AS b, (SELECT count(*) FROM cleaned) AS a)""",
        "mail_raw",
        extra=[_CLEANED],
    ),
)
def clean_stats(spark, sf):
    m = views.mail_raw(spark, sf)
    return clean.removal_stats(m, clean.clean_training(m))


@query(
    "binarise",
    oracle(
        """SELECT msg_id, CASE WHEN trim(lower(label)) = 'phishing' THEN 1 ELSE 0 END AS eval_y,
          CASE label WHEN 'phishing' THEN 1 WHEN 'legitimate' THEN 0 END AS train_y FROM mail""",
        "mail",
    ),
)
def binarise(spark, sf):
    return views.mail(spark, sf).select(
        "msg_id",
        labels.evaluation_target(F.col("label")).alias("eval_y"),
        labels.training_target(F.col("label")).alias("train_y"),
    )


@query("valid_binary", "SELECT event_id, round_even(value, 0)::int AS y FROM events WHERE round_even(value, 0) IN (0, 1)")
def valid_binary(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("value").alias("y"))
    return clean.valid_binary(e)


@query(
    "longest_text",
    oracle(
        """SELECT msg_id, CASE WHEN greatest(length(subject), length(body)) <= 100 THEN ''
          WHEN length(subject) >= length(body) THEN subject ELSE body END AS body FROM mail""",
        "mail",
    ),
)
def longest_text(spark, sf):
    return views.mail(spark, sf).select("msg_id", clean.longest_text(["subject", "body"]).alias("body"))


@query("text_concat", oracle("SELECT msg_id, coalesce(subject, '') || ' ' || coalesce(body, '') AS text FROM mail_raw", "mail_raw"))
def text_concat(spark, sf):
    return views.mail_raw(spark, sf).select("msg_id", text.joined_text(F.col("subject"), F.col("body")).alias("text"))


@query(
    "predict_threshold",
    oracle("SELECT msg_id, (p >= 0.35)::int AS prediction, CASE WHEN p >= 0.35 THEN 'phishing' ELSE 'legitimate' END AS prediction_label FROM scored", "scored"),
)
def predict_threshold(spark, sf):
    s = report.add_prediction(views.scored(spark, sf), threshold=0.35)
    return s.select("msg_id", "prediction", "prediction_label")


@query(
    "confidence_band",
    oracle("SELECT msg_id, CASE WHEN abs(p - 0.5::double) > 0.4::double THEN 'high' WHEN abs(p - 0.5::double) > 0.2::double THEN 'medium' ELSE 'low' END AS confidence FROM scored", "scored"),
)
def confidence_band(spark, sf):
    return views.scored(spark, sf).select("msg_id", labels.confidence(F.col("p")).alias("confidence"))


@query("misclassified", oracle("SELECT msg_id, y, prediction, p FROM scored_pred WHERE prediction <> y", "scored_pred"))
def misclassified(spark, sf):
    return report.misclassified(views.scored_pred(spark, sf)).select("msg_id", "y", "prediction", "p")


@query("excerpt", oracle("SELECT msg_id, substr(subject, 1, 50) AS subject, substr(body, 1, 100) AS body FROM mail", "mail"))
def excerpt(spark, sf):
    return views.mail(spark, sf).select(
        "msg_id", F.substring("subject", 1, 50).alias("subject"), F.substring("body", 1, 100).alias("body")
    )
