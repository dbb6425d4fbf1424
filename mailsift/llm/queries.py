"""The operators on their tables, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.llm import dropout_bpe, itq, licenses, mixing, negatives, pii, quality, ranking, secrets, simhash, suffix_lm, toxicity, urls
from mailsift.plans.book import Book
from mailsift.sources.tables import table

book = Book()

#: The rules of the URL query.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@book.query("op1_quality_rules")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    judged = quality.judge(table(spark, sf, "documents"), keep=["doc_id"])
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("row.doc_id", *base, "base_failed", "kept", "posterior")


def _base_digest(spans: F.Column, kinds: list[str]) -> F.Column:
    base = F.filter(F.coalesce(spans, F.array()), lambda s: s["kind"].isin(kinds))
    return F.sha2(secrets.joined(base), 256)


def _count(spans: F.Column, kind: str) -> F.Column:
    return F.coalesce(F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long"), F.lit(0))


@book.query("op2_secret_scan")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    found = secrets.findings(table(spark, sf, "documents"), secrets.empty_ledger(spark), keep=["doc_id"])
    spans = F.when(F.col("spans").isNotNull(), F.col("spans"))
    counts = [F.when(spans.isNull(), F.lit(0)).otherwise(_count(spans, k)).alias(f"n_{k}") for k in secrets.BASE]
    return found.select("row.doc_id", *counts, _base_digest(spans, list(secrets.BASE)).alias("base_sha256"), secrets.joined(spans).alias("spans"))


@book.query("op3_simhash")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


@book.query("op4_pii")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.find(table(spark, sf, "documents"), keep=["doc_id"])
    counts = [_count(F.col("base"), k).alias(f"n_{k}") for k in pii.BASE]
    return found.select("row.doc_id", *counts, F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


@book.query("op5_suffix_lm")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_lm.score(table(spark, sf, "documents"))


@book.query("op6_dropout_bpe")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return dropout_bpe.encoded(table(spark, sf, "documents"), keep=["doc_id"]).select("row.doc_id", "ids", "n_ids", "lossless")


@book.query("op7_mixing")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents").select("doc_id", "text", "source")).select("row.doc_id", "size", "source_size", "target", "taken")


URL_SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), rules(rh, rp, rv) AS (VALUES %s), fits AS (
  SELECT page_id, rh || rp AS rule, rv, row_number() OVER (PARTITION BY page_id ORDER BY length(rh) + length(rp) DESC, rh, rp) AS n
  FROM split JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
)
SELECT s.page_id, host, path, rule, coalesce(rv, 'allow') AS verdict
FROM split s LEFT JOIN fits f ON f.page_id = s.page_id AND f.n = 1
""" % ", ".join(str(r) for r in URL_RULES)


@book.query("op8_url_filter", URL_SQL)
def op8(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge(table(spark, sf, "pages"), rules)


@book.query("op9_embedding_neardup")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return itq.near_duplicates(table(spark, sf, "embeddings"))


@book.query("op10_toxicity")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


#: Words of texts as the license scan takes them, numbered from 0.
_WORDS = """list_filter(regexp_split_to_array(translate(coalesce(%s, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""

LICENSE_SQL = """
WITH templates(template, label, body, exact) AS (VALUES %(templates)s),
tw AS (SELECT template, label, exact, %(tw)s AS w, CASE WHEN exact THEN %(p)s ELSE %(k)s END AS k FROM templates),
tg AS (SELECT template, label, exact, len(w) AS size, k, unnest(range(len(w) - k + 1)) AS tpos, w FROM tw WHERE len(w) >= k),
tgram AS (SELECT template, label, exact, size, k, tpos, array_to_string(w[tpos + 1 : tpos + k], ' ') AS gram FROM tg),
docs AS (SELECT row_number() OVER () AS id, doc_id, %(dw)s AS w FROM documents),
places AS (SELECT id, w, unnest(range(len(w))) AS pos FROM docs),
grams AS (SELECT id, pos, k, array_to_string(w[pos + 1 : pos + k], ' ') AS gram FROM places, (VALUES (%(p)s), (%(k)s)) AS ks(k) WHERE pos + k <= len(w)),
hits AS (SELECT g.id, t.template, t.label, t.exact, t.size, t.tpos, g.pos, g.pos - t.tpos AS diagonal FROM grams g JOIN tgram t ON g.gram = t.gram AND g.k = t.k),
lines AS (SELECT id, template, label, exact, size, diagonal, count(*) AS votes, min(pos) AS lo, max(pos) AS hi FROM hits GROUP BY ALL),
base AS (SELECT id, label, lo AS start FROM lines WHERE exact AND votes = size - %(p)s + 1),
steps AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY id, template ORDER BY diagonal) <= %(shift)s THEN 0 ELSE 1 END AS first FROM lines WHERE NOT exact),
joined AS (SELECT *, sum(first) OVER (PARTITION BY id, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS run FROM steps),
extent AS (SELECT id, template, label, size, run, min(lo) AS lo, max(hi) + %(k)s AS hi FROM joined GROUP BY ALL),
covered AS (SELECT j.id, j.template, j.run, count(DISTINCT h.tpos + o.o) AS n FROM joined j JOIN hits h ON h.id = j.id AND h.template = j.template AND h.diagonal = j.diagonal, range(%(k)s) AS o(o) GROUP BY ALL),
verified AS (SELECT e.id, e.label, c.n / greatest(e.size, e.hi - e.lo) AS score FROM extent e JOIN covered c ON c.id = e.id AND c.template = e.template AND c.run = e.run WHERE c.n / greatest(e.size, e.hi - e.lo) >= %(least)s),
both_ AS (SELECT id, label, 1.0::DOUBLE AS score FROM base UNION ALL SELECT id, label, score::DOUBLE FROM verified),
b AS (SELECT id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, array_to_string(list_sort(list(DISTINCT label)), ',') AS base_labels FROM base GROUP BY id),
a AS (SELECT id, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(score) AS score FROM both_ GROUP BY id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(b.n_base, 0)::BIGINT AS n_base, b.first_word::BIGINT AS first_word, b.last_word::BIGINT AS last_word,
       coalesce(b.base_labels, '') AS base_labels, coalesce(a.labels, '') AS labels, coalesce(a.score, 0.0)::DOUBLE AS score
FROM docs d LEFT JOIN b ON b.id = d.id LEFT JOIN a ON a.id = d.id
""" % {
    "templates": ", ".join(f"({n}, '{label}', '{text}', {exact})" for n, (label, text, exact) in enumerate([*[(*t, False) for t in licenses.TEMPLATES], *[(*p, True) for p in licenses.PHRASES]])),
    "tw": _WORDS % "body", "dw": _WORDS % "text", "p": licenses.PHRASE_GRAM, "k": licenses.LONG_GRAM, "shift": licenses.SHIFT, "least": licenses.LEAST_COVER,
}


@book.query("op11_license_scan", LICENSE_SQL)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    found = licenses.scan(table(spark, sf, "documents"), keep=["doc_id"])
    base = F.filter("spans", lambda s: s["exact"])
    place = lambda best: best(F.transform(base, lambda s: s["start"])).cast("long")
    return found.select(
        "row.doc_id", "n_words", F.size(base).cast("long").alias("n_base"), place(F.array_min).alias("first_word"), place(F.array_max).alias("last_word"),
        licenses.labels_of(base).alias("base_labels"), licenses.labels_of(F.col("spans")).alias("labels"), F.coalesce(F.array_max(F.col("spans")["score"]), F.lit(0.0)).alias("score"),
    )


_TERMS = """regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

RANK_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS t FROM documents WHERE text IS NOT NULL),
lens AS (SELECT row, doc_id, len(t) AS n, t FROM d WHERE len(t) > 0),
total AS (SELECT count(*) AS texts, sum(n)::BIGINT AS length FROM lens),
tf AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(t) AS term FROM lens) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT row_number() OVER () AS item, item_id, {_TERMS} AS t FROM benchmark WHERE text IS NOT NULL),
qt AS (SELECT item, item_id, term, count(*) AS repeats FROM (SELECT item, item_id, unnest(t) AS term FROM q) GROUP BY ALL),
qw AS (SELECT item, item_id, term, repeats * floor(1000 * ln((2 * texts + 2) / (2 * df + 1)))::BIGINT AS w FROM qt JOIN df USING (term), total),
m AS (SELECT row, doc_id, 100 - 25 + (25 * n * texts) // length AS m FROM lens, total),
s AS (SELECT item, item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM qw JOIN tf USING (term) JOIN m USING (row) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 20
"""


@book.query("op12_ranked_search", RANK_SQL)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


NEGATIVE_SQL = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), a AS (SELECT * FROM v WHERE id % 100 = 0),
s AS (SELECT a.id AS anchor, v.id, a.label = v.label AS same, list_dot_product(a.e::DOUBLE[], v.e::DOUBLE[])::BIGINT AS score FROM a, v WHERE a.id <> v.id),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) AS place FROM s WHERE same),
n AS (
  SELECT p.anchor AS anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score WHERE p.place <= 5
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


@book.query("op13_hard_negatives", NEGATIVE_SQL)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0, moved)
