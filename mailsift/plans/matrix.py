"""TF-IDF, scaling and feature matrix queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsift.functions import text
from mailsift.operators import clean, features, matrix, scale, tfidf
from mailsift.plans import views
from mailsift.plans.book import Book, r6, rounded
from mailsift.plans.features import MAIL_TEXT, NUMERIC_CTES, NUMERIC_SQL, _in, mail_text
from mailsift.plans.views import oracle
from mailsift.session import cut_lineage
from mailsift.sources.tables import table

book = Book()
query = book.query

TERMS = 5000
ANALYZED_SQL = "strip_accents(lower(t))"
WORDS_SQL = f"regexp_extract_all({ANALYZED_SQL}, '[\\p{{L}}\\p{{N}}_]{{2,}}')"


def _grams_sql(n):
    return f"list_transform(range(1, greatest(len(w) - {n - 2}, 1)), lambda i: array_to_string(w[i:i + {n - 1}], ' '))"


def vocab_ctes(source: str = "t", terms: int = TERMS):
    """Count everything, prune, cap: the plain definition of the vocabulary."""
    return [
        ("w", f"SELECT msg_id, label, list_filter({WORDS_SQL}, lambda x: x NOT IN {_in(tfidf.STOP_WORDS)}) AS w FROM {source}"),
        ("g", f"SELECT msg_id, label, unnest(list_concat(w, {_grams_sql(2)}, {_grams_sql(3)})) AS term FROM w"),
        ("tf", "SELECT msg_id, label, term, count(*) AS tf FROM g GROUP BY ALL"),
        ("counts", "SELECT term, sum(tf)::bigint AS cf, count(*) AS df FROM tf GROUP BY term"),
        ("docs", f"SELECT count(*) AS n FROM {source}"),
        (
            "vocab",
            f"""SELECT term, cf, df, ln((1 + n) / (1 + df)::double) + 1 AS idf, (row_number() OVER (ORDER BY term) - 1)::int AS term_index
              FROM (SELECT counts.*, n FROM counts, docs WHERE df >= 5 AND df <= 0.8::double * n ORDER BY cf DESC, term LIMIT {terms})""",
        ),
        ("raw", "SELECT msg_id, label, tf.term, term_index, (1 + ln(tf)) * idf AS x FROM tf JOIN vocab USING (term)"),
        ("weights", "SELECT msg_id, label, term, term_index, x / sqrt(sum(x * x) OVER (PARTITION BY msg_id)) AS weight FROM raw"),
    ]


VOCAB = [MAIL_TEXT, *vocab_ctes()]


@query("analyzer", oracle(f"SELECT msg_id, {ANALYZED_SQL} AS analyzed, array_to_string({WORDS_SQL}, ' ') AS tokens FROM t", "mail", extra=[MAIL_TEXT]))
def analyzer(spark, sf):
    a = mail_text(spark, sf).select("msg_id", text.analyzed(F.col("text")).alias("analyzed"))
    return a.select("msg_id", "analyzed", F.array_join(text.terms(F.col("analyzed")), " ").alias("tokens"))


#: Letters of other scripts, with accents or joined, for letters of the texts; and
#: what they are without.
OTHERS = ("aeioubdgk", "άέήίόйёїў")
PLAIN = "αεηιοиеіу"
JOINED_LETTERS = [("st", "ﬆ", "st"), ("ff", "ﬀ", "ff"), ("w", "한", "ᄒ" + "ᅡ" + "ᆫ"), ("x", "½", "1⁄2")]


def _other_scripts_sql() -> str:
    c = f"strip_accents(translate(lower(t), '{OTHERS[0]}', '{PLAIN}'))"
    for old, _, new in JOINED_LETTERS:
        c = f"replace({c}, '{old}', '{new}')"
    return c


@query("analyzer_scripts", oracle(f"SELECT msg_id, {_other_scripts_sql()} AS analyzed FROM t", "mail", extra=[MAIL_TEXT]))
def analyzer_scripts(spark, sf):
    """Accents of Greek and Cyrillic, ligatures, fractions and Hangul syllables."""
    c = F.translate(F.lower("text"), *OTHERS)
    for old, new, _ in JOINED_LETTERS:
        c = F.replace(c, F.lit(old), F.lit(new))
    return mail_text(spark, sf).select("msg_id", text.analyzed(c).alias("analyzed"))


@query("stopwords", oracle("SELECT msg_id, len(w)::int AS n_words, array_to_string(w, ' ') AS tokens FROM w", "mail", extra=VOCAB[:2]))
def stopwords(spark, sf):
    w = tfidf.with_words(mail_text(spark, sf), "text", tfidf.STOP_WORDS)
    return w.select("msg_id", F.size("_words").alias("n_words"), F.array_join("_words", " ").alias("tokens"))


@query(
    "ngrams",
    oracle(
        f"SELECT msg_id, array_to_string({_grams_sql(2)}, '|') AS bigrams, array_to_string({_grams_sql(3)}, '|') AS trigrams, greatest(len(w) - 2, 0)::int AS n_trigrams FROM w",
        "mail",
        extra=VOCAB[:2],
    ),
)
def ngrams(spark, sf):
    w = tfidf.with_words(mail_text(spark, sf), "text", tfidf.STOP_WORDS)
    two, three = (text.word_ngrams(F.col("_words"), n) for n in (2, 3))
    return w.select("msg_id", F.array_join(two, "|").alias("bigrams"), F.array_join(three, "|").alias("trigrams"), F.size(three).alias("n_trigrams"))


@query("doc_freq", oracle("SELECT term, cf, df FROM counts", "mail", extra=VOCAB[:5]))
def doc_freq(spark, sf):
    w = tfidf.with_words(mail_text(spark, sf), "text", tfidf.STOP_WORDS)
    return tfidf.ngram_counts(w, (1, 2, 3))


def fitted(spark, sf):
    return tfidf.fit(mail_text(spark, sf), "text", TERMS)


@query("vocab", oracle("SELECT term_index, term, cf, df, round(idf, 6) AS idf FROM vocab", "mail", extra=VOCAB))
def vocab(spark, sf):
    return rounded(tfidf.vocabulary_table(spark, fitted(spark, sf)))


@query("tfidf", oracle("SELECT msg_id, term, round(weight, 6) AS weight FROM weights", "mail", extra=VOCAB))
def tfidf_weights(spark, sf):
    words = cut_lineage(tfidf.with_words(mail_text(spark, sf).select("msg_id", "text"), "text", tfidf.STOP_WORDS).drop("text"))
    model = tfidf.fit(words, "text", TERMS)
    return rounded(tfidf.long_form(tfidf.transform(words, model), model))


CONV_VOCAB = [
    *VOCAB[:7],
    ("t2", "SELECT conv_id * 1000 + turn AS msg_id, text AS t FROM conversations"),
    ("w2", f"SELECT msg_id, list_filter({WORDS_SQL}, lambda x: x NOT IN {_in(tfidf.STOP_WORDS)}) AS w FROM t2"),
    ("tf2", f"SELECT msg_id, term, count(*) AS tf FROM (SELECT msg_id, unnest(list_concat(w, {_grams_sql(2)}, {_grams_sql(3)})) AS term FROM w2) GROUP BY ALL"),
    ("raw2", "SELECT msg_id, term, (1 + ln(tf)) * idf AS x FROM tf2 JOIN vocab USING (term)"),
    ("nrm", "SELECT msg_id, count(*)::int AS n_terms, sqrt(sum(x * x)) AS nrm, sum(x) AS total FROM raw2 GROUP BY msg_id"),
]


@query(
    "tfidf_transform",
    oracle(
        "SELECT t2.msg_id, coalesce(n_terms, 0)::int AS n_terms, coalesce(round(total / nrm, 6), 0)::double AS weight_sum FROM t2 LEFT JOIN nrm USING (msg_id)",
        "mail",
        extra=CONV_VOCAB,
    ),
)
def tfidf_transform(spark, sf):
    """A vocabulary fitted on documents applied to conversations."""
    conv = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("msg_id"), "text")
    rows = tfidf.transform(conv, fitted(spark, sf))
    total = F.aggregate("tfidf_weight", F.lit(0.0), lambda a, x: a + x)
    return rows.select("msg_id", F.size("tfidf_index").alias("n_terms"), r6(total).alias("weight_sum"))


@query(
    "top_terms_by_class",
    oracle(
        "SELECT term, round(sum(weight) / (SELECT count(*) FROM t WHERE label = 'phishing'), 6) AS mean_weight FROM weights WHERE label = 'phishing' GROUP BY term ORDER BY mean_weight DESC, term LIMIT 20",
        "mail",
        extra=VOCAB,
    ),
)
def top_terms_by_class(spark, sf):
    model = fitted(spark, sf)
    rows = tfidf.transform(mail_text(spark, sf).select("msg_id", "label", "text"), model)
    return tfidf.top_terms(rows, model, "label", "phishing")


NUMERIC = features.NUMERIC_FEATURES
_NUM = ("num", NUMERIC_SQL)
_MOMENTS = ("mom", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, avg({c})::double AS mean, CASE WHEN min({c}) < max({c}) THEN stddev_pop({c}) ELSE 1 END::double AS scale FROM num" for c in NUMERIC
))


@query("scaler_fit", oracle("SELECT feature, round(mean, 6) AS mean, round(scale, 6) AS scale FROM mom", "corpus", extra=[*NUMERIC_CTES, _NUM, _MOMENTS]))
def scaler_fit(spark, sf):
    f = rounded(features.numeric_features(views.corpus(spark, sf)))
    return rounded(scale.moments(f, NUMERIC))


@query(
    "scaler_transform",
    oracle(
        "SELECT msg_id, "
        + ", ".join(f"round((coalesce({c}, 0) - (SELECT mean FROM mom WHERE feature = '{c}')) / (SELECT scale FROM mom WHERE feature = '{c}'), 4) AS {c}" for c in NUMERIC)
        + " FROM num",
        "corpus",
        extra=[*NUMERIC_CTES, ("num", f"SELECT * FROM ({NUMERIC_SQL})"), _MOMENTS],
    ),
)
def scaler_transform(spark, sf):
    f = cut_lineage(rounded(features.numeric_features(views.corpus(spark, sf))))
    out = scale.transform(f, scale.fit(f, NUMERIC))
    return out.select("msg_id", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in NUMERIC])


# the same features with rounding far below the compared digits
EXACT_CTES = [(n, q.replace(", 6)", ", 13)")) for n, q in [*NUMERIC_CTES, _NUM]]


def _cell_sql():
    cells = " UNION ALL ".join(
        f"SELECT msg_id, (SELECT count(*) FROM vocab)::int + {i} AS feature_index, (coalesce({c}, 0) - (SELECT mean FROM mom WHERE feature = '{c}')) / (SELECT scale FROM mom WHERE feature = '{c}') AS value FROM num"
        for i, c in enumerate(NUMERIC)
    )
    return f"SELECT msg_id, feature_index, value FROM ({cells}) WHERE value <> 0 UNION ALL SELECT msg_id, term_index, weight FROM weights"


@query(
    "feature_matrix",
    oracle(
        f"SELECT msg_id, feature_index, round(value, 4) AS value FROM ({_cell_sql()})",
        "corpus",
        extra=[*EXACT_CTES, _MOMENTS, *vocab_ctes()],
    ),
)
def feature_matrix(spark, sf):
    rows = matrix.prepared(views.corpus(spark, sf), ["msg_id"])
    model = matrix.fit(rows, TERMS)
    out = matrix.long_matrix(matrix.transform(rows, model), model)
    return out.withColumn("value", F.round("value", 4) + F.lit(0.0))


@query("align_width", "SELECT vec_id, i::int AS width, round(list_sum(list_slice(list_concat(embedding::double[], list_transform(range(0, i), lambda z: 0.0::double)), 1, i)), 6) AS total, least(i, len(embedding))::int AS kept FROM embeddings, (SELECT unnest([16, 100]) AS i)")
def align_width(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    parts = F.array(*[F.struct(F.lit(n).alias("width"), scale.align_width(F.col("v"), n).alias("a")) for n in (16, 100)])
    x = e.select("vec_id", F.least(F.size("v"), F.lit(100)).alias("len"), F.explode(parts).alias("x"))
    total = F.aggregate("x.a", F.lit(0.0), lambda a, b: a + b)
    return x.select("vec_id", F.size("x.a").alias("width"), r6(total).alias("total"), F.least("len", "x.width").alias("kept"))


@query(
    "feature_names",
    oracle(
        "SELECT term_index AS feature_index, term AS name FROM vocab UNION ALL "
        + " UNION ALL ".join(f"SELECT (SELECT count(*) FROM vocab)::int + {i}, '{c}'" for i, c in enumerate(NUMERIC)),
        "mail",
        extra=VOCAB,
    ),
)
def feature_names(spark, sf):
    return tfidf.feature_names(spark, fitted(spark, sf), NUMERIC)
