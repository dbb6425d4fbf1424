"""Unions, counts, distributions and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsift.functions import labels, lexicons
from mailsift.operators import clean, features, metrics, report, setops, stats
from mailsift.plans import views
from mailsift.plans.book import Book, r6, rounded
from mailsift.plans.cleaning import EMPTY, LABEL_SQL, collapse_sql
from mailsift.plans.views import WS, oracle
from mailsift.sources.tables import table

book = Book()
query = book.query


def three_sources(spark, sf):
    """Documents, conversations and pages as mail sources with different columns."""
    docs = views.mail_raw(spark, sf).withColumnRenamed("raw_label", "label")
    conv = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn") + 1_000_000_000).alias("msg_id"),
        F.col("role").alias("subject"), F.col("text").alias("body"),
        F.when(F.col("role") == "user", "Ham").when(F.col("role") == "assistant", "SPAM").alias("label"),
    )
    page = views.pages(spark, sf).select(
        (F.col("page_id") + 2_000_000_000).alias("msg_id"),
        F.concat(F.lit("bot@"), F.regexp_extract("url", r"^https?://([^/?#]*)", 1)).alias("from"),
        F.col("url").alias("subject"), F.col("html").alias("body"), F.col("url").alias("urls"),
        F.when(F.col("url").startswith("https"), "0").otherwise("1").alias("label"),
    )
    return {
        "docs": docs.drop("source_file"), "conv": conv, "pages": page,
    }


_SOURCES = (
    "src",
    """SELECT msg_id, coalesce("from", sender) AS sender, replyto AS reply_to, subject, coalesce(body, content, text) AS body,
        raw_label AS label, NULL::varchar AS urls, 'docs' AS source_file FROM mail_raw
      UNION ALL SELECT conv_id * 1000 + turn + 1000000000, NULL, NULL, role, text,
        CASE role WHEN 'user' THEN 'Ham' WHEN 'assistant' THEN 'SPAM' END, NULL, 'conv' FROM conversations
      UNION ALL SELECT page_id + 2000000000, 'bot@' || regexp_extract(url, '^https?://([^/?#]*)', 1), NULL, url, html,
        CASE WHEN starts_with(url, 'https') THEN '0' ELSE '1' END, url, 'pages' FROM pages""",
)


@query(
    "load_union",
    oracle(
        f"""SELECT msg_id, sender, reply_to, subject, body, label, source_file FROM (
          SELECT msg_id, coalesce(sender, '') AS sender, coalesce(reply_to, '') AS reply_to,
            {collapse_sql("coalesce(subject, '')")} AS subject, {collapse_sql("coalesce(body, '')")} AS body,
            {LABEL_SQL.format('label')} AS label, source_file
          FROM src WHERE NOT ({EMPTY.format('subject')} AND {EMPTY.format('body')}))
        WHERE label IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY sender, subject, body ORDER BY msg_id) = 1""",
        "mail_raw",
        extra=[_SOURCES],
    ),
)
def load_union(spark, sf):
    tagged = [setops.tag_source(df, name) for name, df in three_sources(spark, sf).items()]
    m = clean.clean_mail(setops.union_outer(tagged))
    return m.select("msg_id", F.col("from").alias("sender"), "reply_to", "subject", "body", "label", "source_file")


@query(
    "union_common",
    oracle(
        """SELECT msg_id, subject, body, label, source_file FROM (
          SELECT msg_id, subject, body, raw_label AS label, 'docs' AS source_file FROM mail_raw
          UNION ALL SELECT msg_id, subject, body, label, source_file FROM src WHERE source_file <> 'docs')""",
        "mail_raw",
        extra=[_SOURCES],
    ),
)
def union_common(spark, sf):
    tagged = [setops.tag_source(df, name) for name, df in three_sources(spark, sf).items()]
    return setops.union_common(tagged, extra=["msg_id"])


@query(
    "union_outer",
    oracle(
        """SELECT msg_id, "from" AS sender_from, sender, replyto, subject, body, content, text, raw_label AS label, NULL::varchar AS urls FROM mail_raw
          UNION ALL SELECT msg_id, sender, NULL, NULL, subject, body, NULL, NULL, label, urls FROM src WHERE source_file <> 'docs'""",
        "mail_raw",
        extra=[_SOURCES],
    ),
)
def union_outer(spark, sf):
    return setops.union_outer(list(three_sources(spark, sf).values())).withColumnRenamed("from", "sender_from")


@query(
    "source_admission",
    """SELECT doc_id AS msg_id, lang AS subject, text AS body, source AS label, 'documents' AS source_file FROM documents
      UNION ALL SELECT page_id, url, html, 'x', 'pages' FROM pages""",
)
def source_admission(spark, sf):
    candidates = {
        "documents": table(spark, sf, "documents").select(
            F.col("doc_id").alias("msg_id"), F.col("lang").alias("title"), "text", F.col("source").alias("class")
        ),
        "pages": table(spark, sf, "pages").select(
            F.col("page_id").alias("msg_id"), F.col("url").alias("title"), F.col("html").alias("content"), F.lit("x").alias("label")
        ),
        # has neither subject nor label and is left out
        "benchmark": table(spark, sf, "benchmark").select(F.col("item_id").alias("msg_id"), "text"),
    }
    admitted = setops.admit_sources(candidates)
    tagged = [setops.tag_source(df, name) for name, df in admitted.items()]
    return setops.union_common(tagged, extra=["msg_id"])


@query("source_exclude", oracle("SELECT msg_id, source_file FROM mail WHERE source_file NOT IN ('src3', 'src7', 'all_combined.csv')", "mail"))
def source_exclude(spark, sf):
    return setops.exclude_sources(views.mail(spark, sf), ["src3", "src7", "all_combined.csv"]).select("msg_id", "source_file")


@query("class_counts", oracle("SELECT label, count(*) AS n FROM mail GROUP BY label", "mail"))
def class_counts(spark, sf):
    return stats.counts(views.mail(spark, sf), "label")


@query(
    "label_distribution",
    oracle("SELECT coalesce(label, 'unknown') AS label, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM mail), 1)::double AS percent FROM mail GROUP BY 1", "mail"),
)
def label_distribution(spark, sf):
    return stats.distribution(views.mail(spark, sf), "label", missing="unknown")


@query(
    "source_distribution",
    oracle("SELECT source_file, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM src), 1)::double AS percent FROM src GROUP BY 1 ORDER BY n DESC", "mail_raw", extra=[_SOURCES]),
)
def source_distribution(spark, sf):
    tagged = [setops.tag_source(df, name) for name, df in three_sources(spark, sf).items()]
    return stats.distribution(setops.union_outer(tagged), "source_file").orderBy(F.desc("n"))


@query(
    "length_stats",
    oracle(
        """SELECT field, round(avg(len), 6) AS mean_len, min(len)::bigint AS min_len, max(len)::bigint AS max_len, median(len)::double AS median_len
        FROM (SELECT 'subject' AS field, length(subject) AS len FROM mail UNION ALL SELECT 'body', length(body) FROM mail) GROUP BY field""",
        "mail",
    ),
)
def length_stats(spark, sf):
    return stats.length_stats(views.mail(spark, sf), ["subject", "body"])


@query("top_senders", oracle('SELECT "from" AS sender, count(*) AS n FROM mail GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3', "mail"))
def top_senders(spark, sf):
    return stats.top_values(views.mail(spark, sf), "from").withColumnRenamed("from", "sender")


@query("top_subjects", oracle("SELECT subject, count(*) AS n FROM mail GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3", "mail"))
def top_subjects(spark, sf):
    return stats.top_values(views.mail(spark, sf), "subject")


@query(
    "top_subjects_by_label",
    oracle(
        """SELECT label, subject, n, rank::int AS rank FROM (SELECT label, subject, count(*) AS n,
          row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, subject) AS rank FROM mail WHERE label IS NOT NULL GROUP BY 1, 2) WHERE rank <= 10""",
        "mail",
    ),
)
def top_subjects_by_label(spark, sf):
    return stats.top_values_by(views.mail(spark, sf), "label", "subject")


@query("unknown_labels", oracle(f"SELECT DISTINCT lower(raw_label) AS label FROM mail_raw WHERE raw_label IS NOT NULL AND {LABEL_SQL.format('raw_label')} IS NULL", "mail_raw"))
def unknown_labels(spark, sf):
    m = views.mail_raw(spark, sf)
    unknown = m.where(F.col("raw_label").isNotNull() & labels.normalize(F.col("raw_label")).isNull())
    return unknown.select(F.lower("raw_label").alias("label")).distinct()


URGENCY_SQL = " + ".join(f"contains(lower(t), '{w}')::int" for w in lexicons.URGENCY)
_SIMPLE = (
    "simple",
    f"""SELECT msg_id, label, source_file, len(list_filter(regexp_split_to_array(t, '{WS}+'), lambda x: x <> ''))::int AS word_count,
        len(regexp_extract_all(t, '{views.URL_RE}'))::int AS url_count, ({URGENCY_SQL})::int AS urgency_hits,
        (regexp_extract(lower(coalesce("from", '')), '@([^>@{views.WS_SET}]+)', 1) <> regexp_extract(lower(coalesce(reply_to, '')), '@([^>@{views.WS_SET}]+)', 1)
          AND reply_to IS NOT NULL)::int AS spoof_flag
      FROM (SELECT *, coalesce(subject, '') || ' ' || coalesce(body, '') AS t FROM mail)""",
)
SIMPLE_COLUMNS = ["word_count", "url_count", "urgency_hits", "spoof_flag"]


def simple_features(spark, sf):
    m = views.mail(spark, sf)
    return features.five_features(m, keep=["msg_id", "label"]).select("msg_id", "label", *SIMPLE_COLUMNS)


@query(
    "describe_features",
    oracle(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS feature, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c})::double AS min, max({c})::double AS max,
              quantile_cont({c}, 0.25)::double AS q25, quantile_cont({c}, 0.5)::double AS q50, quantile_cont({c}, 0.75)::double AS q75 FROM simple"""
            for c in SIMPLE_COLUMNS
        ),
        "mail",
        extra=[_SIMPLE],
    ),
)
def describe_features(spark, sf):
    return rounded(stats.describe(simple_features(spark, sf), SIMPLE_COLUMNS))


@query(
    "feature_means",
    oracle(f"SELECT label, {', '.join(f'round(avg({c}), 6) AS {c}' for c in SIMPLE_COLUMNS)} FROM simple WHERE label IS NOT NULL GROUP BY label", "mail", extra=[_SIMPLE]),
)
def feature_means(spark, sf):
    f = clean.labelled_only(simple_features(spark, sf))
    return rounded(stats.group_means(f, "label", SIMPLE_COLUMNS))


@query(
    "confusion_matrix",
    oracle("SELECT y AS true_label, count(*) FILTER (prediction = 0) AS pred_0, count(*) FILTER (prediction = 1) AS pred_1 FROM scored_pred GROUP BY y", "scored_pred"),
)
def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(views.scored_pred(spark, sf))


@query(
    "report_summary",
    oracle(
        """SELECT count(*) AS total, sum(y = 1)::bigint AS phishing, sum(y = 0)::bigint AS legitimate,
          sum(y = prediction)::bigint AS correct, sum(y <> prediction)::bigint AS incorrect,
          round(sum(y = prediction) * 100.0 / count(*), 2)::double AS correct_pct, round(sum(y <> prediction) * 100.0 / count(*), 2)::double AS incorrect_pct FROM scored_pred""",
        "scored_pred",
    ),
)
def report_summary(spark, sf):
    return report.summary(views.scored_pred(spark, sf))


@query(
    "prediction_summary",
    oracle(
        """SELECT count(*) AS total, sum(prediction = 1)::bigint AS phishing, sum(prediction = 0)::bigint AS legitimate,
          round(sum(prediction) * 100.0 / count(*), 2)::double AS phishing_pct FROM scored_pred""",
        "scored_pred",
    ),
)
def prediction_summary(spark, sf):
    return report.prediction_summary(views.scored_pred(spark, sf))


@query(
    "source_stats",
    oracle("SELECT source_file, count(*) AS n_rows, count(label) AS n_labelled, sum(length(body))::bigint AS body_chars, 7::bigint AS n_columns FROM mail GROUP BY 1", "mail"),
)
def source_stats(spark, sf):
    return stats.source_stats(views.mail(spark, sf))


@query(
    "imbalance",
    oracle("SELECT max(n) AS majority, min(n) AS minority, round(max(n) / min(n)::double, 6) AS ratio FROM (SELECT count(*) AS n FROM mail WHERE label IS NOT NULL GROUP BY label)", "mail"),
)
def imbalance(spark, sf):
    return stats.imbalance(views.mail(spark, sf)).withColumn("ratio", r6("ratio"))
