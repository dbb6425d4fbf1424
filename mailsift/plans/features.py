"""Text, URL, address and sentiment feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsift.functions import address, lexicons, text, urls
from mailsift.functions.sentiment import (
    AFTER_BUT, ALPHA, BEFORE_BUT, BOOST, BOOSTERS_DOWN, BOOSTERS_UP, CAPS, DAMP, DAMPERS,
    EXCLAMATION, IDIOMS, MANY_QUESTIONS, NEGATE, NEGATIONS, NEVER_SO, QUESTION, VALENCE, emoticons_of, with_sentiment,
)
from mailsift.operators import features
from mailsift.plans import views
from mailsift.plans.book import Book, rounded
from mailsift.plans.views import NWS, URL_RE, WS, WS_SET, oracle
from mailsift.sources.tables import table

book = Book()
query = book.query

# Words that do occur in the shared tables, for the parameterised queries.
SEEN_URGENCY = ["the", "with", "tion", "les", "und", "que", "zz"]
SEEN_FINANCIAL = ["from", "ing", "sch", "ment", "the"]
SEEN_PERSONAL = ["was", "is", "est", "der", "ou t"]
SEEN_TERMS = ["the", "and", "les", "der", "que", "zz"]
SEEN_LEXICON = {
    "the": 1.5, "was": -2.1, "with": 0.9, "this": -0.7, "les": 1.1, "des": -1.3,
    "que": 2.2, "der": -0.4, "und": 0.6, "from": -1.9,
}
SEEN_RULES = {
    "boosters_up": ["and", "et"], "boosters_down": ["of", "ou"],
    "negations": ["in", "on", "pas", "ich"], "pivot": "that",
    "idioms": {"of the": 2.5, "the and": -1.0, "de la que": 1.7, "que de": -2.0, "the of in": 0.5},
    "dampers": ["la de", "in the", "the in"], "never": ("to", ("the", "la", "de")), "least": ("la", ("de", "and")),
}


def _in(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


TEXT_CTE = ("t", """SELECT msg_id, "from", reply_to, subject, body, label, coalesce(subject, '') || ' ' || coalesce(body, '') AS t FROM corpus""")
MAIL_TEXT = ("t", """SELECT msg_id, label, coalesce(subject, '') || ' ' || coalesce(body, '') AS t FROM mail""")
URL_ROWS = ("u", f"SELECT msg_id, unnest(a) AS url, unnest(range(0, len(a)))::int AS pos FROM (SELECT msg_id, regexp_extract_all(text, '{URL_RE}') AS a FROM url_tbl)")


def tokens_sql(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '{WS}+'), lambda x: x <> '')"


def urls_frame(spark, sf):
    u = views.url_texts(spark, sf).select("msg_id", urls.extract_urls(F.col("text")).alias("a"))
    return u.select("msg_id", F.posexplode("a").alias("pos", "url"))


def mail_text(spark, sf):
    return features.with_text(views.mail(spark, sf))


@query("html_strip", "SELECT page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') AS text FROM pages")
def html_strip(spark, sf):
    return views.pages(spark, sf).select("page_id", text.strip_tags(F.col("html")).alias("text"))


@query("word_count", oracle(f"SELECT msg_id, len({tokens_sql('t')})::int AS word_count FROM t", "mail", extra=[MAIL_TEXT]))
def word_count(spark, sf):
    return mail_text(spark, sf).select("msg_id", text.word_count(F.col("text")).alias("word_count"))


@query("extract_urls", oracle("SELECT msg_id, pos, url FROM u", "url_tbl", extra=[URL_ROWS]))
def extract_urls(spark, sf):
    return urls_frame(spark, sf)


@query("count_urls", oracle(f"SELECT msg_id, len(regexp_extract_all(text, '{URL_RE}'))::int AS url_count FROM url_tbl", "url_tbl"))
def count_urls(spark, sf):
    return views.url_texts(spark, sf).select("msg_id", urls.count_urls(F.col("text")).alias("url_count"))


def _count_sql(c, ch):
    return f"(length({c}) - length(replace({c}, '{ch}', '')))"


URL_COUNTS_SQL = f"""length(url)::int AS url_length, {_count_sql('url', '.')}::int AS num_dots, {_count_sql('url', '-')}::int AS num_hyphens,
  {_count_sql('url', '@')}::int AS num_at_signs, length(regexp_replace(url, '[^\\p{{Nd}}]', '', 'g'))::int AS num_digits"""
NETLOC_SQL = "CASE WHEN contains(h, '[') = contains(h, ']') THEN h ELSE '' END"
HOST_ROWS = ("hosts", f"SELECT msg_id, pos, url, {NETLOC_SQL} AS host FROM (SELECT *, regexp_extract(url, '^(?:https?://)?([^/?#]*)', 1) AS h FROM u)")
TOP2_SQL = "lower(CASE WHEN contains(host, '.') THEN array_to_string(list_slice(string_split(host, '.'), len(string_split(host, '.')) - 1, len(string_split(host, '.'))), '.') ELSE host END)"
SHORT_SQL = " OR ".join(f"contains(lower(url), '{s}')" for s in urls.SHORTENERS)
URL_FLAGS_SQL = f"""starts_with(url, 'https://')::int AS has_https,
  regexp_matches(host, '^\\p{{Nd}}+\\.\\p{{Nd}}+\\.\\p{{Nd}}+\\.\\p{{Nd}}+')::int AS has_ip_address,
  ({TOP2_SQL} IN {_in(urls.COMMON_DOMAINS)})::int AS is_common_domain,
  (lower(string_split(host, '.')[-1]) IN {_in(urls.SUSPICIOUS_TLDS)})::int AS has_suspicious_tld, ({SHORT_SQL})::int AS is_shortened"""


@query("url_counts", oracle(f"SELECT msg_id, pos, {URL_COUNTS_SQL} FROM u", "url_tbl", extra=[URL_ROWS]))
def url_counts(spark, sf):
    return urls_frame(spark, sf).select("msg_id", "pos", *[c.alias(n) for n, c in urls.url_counts(F.col("url")).items()])


@query("url_flags", oracle(f"SELECT msg_id, pos, {URL_FLAGS_SQL} FROM hosts", "url_tbl", extra=[URL_ROWS, HOST_ROWS]))
def url_flags(spark, sf):
    return urls_frame(spark, sf).select("msg_id", "pos", *[c.alias(n) for n, c in urls.url_flags(F.col("url")).items()])


@query(
    "url_host",
    oracle("SELECT msg_id, pos, host, (len(string_split(host, '.')) - 1)::int AS num_subdomains FROM hosts", "url_tbl", extra=[URL_ROWS, HOST_ROWS]),
)
def url_host(spark, sf):
    host = urls.netloc(F.col("url"))
    return urls_frame(spark, sf).select("msg_id", "pos", host.alias("host"), urls.num_subdomains(host).alias("num_subdomains"))


URL_AGG_SQL = f"""SELECT msg_id, count(*)::int AS url_count, round(avg(url_length), 6) AS avg_url_length, max(url_length) AS max_url_length,
    round(avg(num_dots), 6) AS avg_num_dots, max(num_dots) AS max_num_dots, round(avg(num_hyphens), 6) AS avg_num_hyphens, max(num_hyphens) AS max_num_hyphens,
    max(has_ip_address) AS has_ip_address, max(is_shortened) AS has_shortened_url, max(has_suspicious_tld) AS has_suspicious_tld,
    max(is_common_domain) AS has_common_domain, round(avg(has_https), 6) AS https_ratio
  FROM (SELECT msg_id, {URL_COUNTS_SQL}, {URL_FLAGS_SQL} FROM hosts) GROUP BY msg_id"""
URL_DOUBLES = ["avg_url_length", "avg_num_dots", "avg_num_hyphens", "https_ratio"]
URL_FILLED = ", ".join(
    f"coalesce({c}, 0)::{'double' if c in URL_DOUBLES else 'int'} AS {c}" for c in urls.URL_AGGREGATES
)


@query(
    "url_features",
    oracle(
        f"SELECT b.msg_id, {URL_FILLED} FROM (SELECT msg_id FROM url_tbl UNION ALL SELECT msg_id + 1000000000 FROM mail) b LEFT JOIN agg ON b.msg_id = agg.msg_id",
        "url_tbl",
        "mail",
        extra=[URL_ROWS, HOST_ROWS, ("agg", URL_AGG_SQL)],
    ),
)
def url_features(spark, sf):
    no_urls = mail_text(spark, sf).select((F.col("msg_id") + 1_000_000_000).alias("msg_id"), "text")
    both = views.url_texts(spark, sf).unionByName(no_urls)
    return rounded(features.url_features(both).drop("text"))


def kw_sql(words, c="lower(t)"):
    return "(" + " + ".join(f"contains({c}, '{w}')::int" for w in words) + ")"


def word_re(phrases):
    return f"'(?:^|[^\\p{{L}}\\p{{N}}_])(?:{'|'.join(phrases)})(?:[^\\p{{L}}\\p{{N}}_]|$)'"


def word_sum(words):
    return "(" + " + ".join(f"regexp_matches(lower(t), {word_re([w])})::int" for w in words) + ")"


KW_SQL = f"""{kw_sql(lexicons.URGENCY)} AS urgency_count, {kw_sql(lexicons.FINANCIAL)} AS financial_count, {kw_sql(lexicons.PERSONAL_INFO)} AS personal_info_count"""


@query("lexicon_counts", oracle(f"SELECT msg_id, {KW_SQL} FROM t", "mail", "corpus", extra=[TEXT_CTE]))
def lexicon_counts(spark, sf):
    f = features.keyword_features(features.with_text(views.corpus(spark, sf)))
    return f.select("msg_id", "urgency_count", "financial_count", "personal_info_count")


@query("lexicon_counts_v2", oracle(f"SELECT msg_id, {kw_sql(lexicons.URGENCY_SERVING)} AS urgency_count FROM t", "mail", "corpus", extra=[TEXT_CTE]))
def lexicon_counts_v2(spark, sf):
    f = features.with_text(views.corpus(spark, sf))
    return f.select("msg_id", lexicons.keyword_count(F.lower("text"), lexicons.URGENCY_SERVING).alias("urgency_count"))


@query(
    "lexicon_counts_words",
    oracle(
        f"""SELECT msg_id, {kw_sql(SEEN_URGENCY)} AS urgency_count, {kw_sql(SEEN_FINANCIAL)} AS financial_count, {kw_sql(SEEN_PERSONAL)} AS personal_info_count,
          {word_sum(SEEN_URGENCY)} AS whole_words FROM t""",
        "mail",
        extra=[MAIL_TEXT],
    ),
)
def lexicon_counts_words(spark, sf):
    low = F.lower("text")
    m = mail_text(spark, sf).withColumn("whole_words", lexicons.whole_word_count(low, text.words_of(low), SEEN_URGENCY))
    f = features.keyword_features(m, "text", SEEN_URGENCY, SEEN_FINANCIAL, SEEN_PERSONAL)
    return f.select("msg_id", "urgency_count", "financial_count", "personal_info_count", "whole_words")


def _rules_sql(c: str) -> str:
    for pattern, new in [*text.QUOTES, *text.PUNCTUATION, *text.APOSTROPHES, *text.JOINED_WORDS]:
        pattern, new = (x.replace("'", "''") for x in (pattern.format(ws=WS, set=WS_SET), new.replace("$", "\\")))
        c = f"regexp_replace({c}, '{pattern}', '{new}', 'g')"
    return c


def complex_sql(words: str) -> str:
    alpha = f"list_filter({words}, lambda x: regexp_matches(x, '^\\p{{L}}+$'))"
    return f"""coalesce(round(list_avg(list_transform({alpha}, lambda x: length(x))), 6), 0)::double AS avg_word_length,
  coalesce(round(len(list_distinct({words})) / nullif(len({words}), 0)::double, 6), 0)::double AS unique_words_ratio,
  coalesce(round(length(regexp_replace(t, '[^\\p{{Lu}}]', '', 'g')) / nullif(length(t), 0)::double, 6), 0)::double AS capital_letters_ratio"""


#: Treebank tokens of each text, beside the text.
TREEBANK = ("tb", f"SELECT msg_id, {tokens_sql(_rules_sql('t'))} AS tb FROM t")
COMPLEX_SQL = complex_sql("tb")
COMPLEXITY = ["avg_word_length", "unique_words_ratio", "capital_letters_ratio"]


@query("text_complexity", oracle(f"SELECT msg_id, {COMPLEX_SQL} FROM t JOIN tb USING (msg_id)", "corpus", extra=[TEXT_CTE, TREEBANK]))
def text_complexity(spark, sf):
    f = features.text_complexity(features.with_text(views.corpus(spark, sf)))
    return rounded(f.select("msg_id", *COMPLEXITY))


@query("text_complexity_space", oracle(f"SELECT msg_id, {complex_sql(tokens_sql('t'))} FROM t", "corpus", extra=[TEXT_CTE]))
def text_complexity_space(spark, sf):
    f = features.text_complexity(features.with_text(views.corpus(spark, sf)), tokenizer="space")
    return rounded(f.select("msg_id", *COMPLEXITY))


@query("treebank_tokens", oracle("SELECT msg_id, array_to_string(tb, ' ') AS tokens FROM tb", "corpus", extra=[TEXT_CTE, TREEBANK]))
def treebank_tokens(spark, sf):
    """All tokens of mail and pages; markup is rich in quotes and brackets."""
    f = features.with_text(views.corpus(spark, sf))
    return f.select("msg_id", F.array_join(text.treebank_tokens(F.col("text")), " ").alias("tokens"))


def domain_sql(c):
    return f"regexp_extract(lower(coalesce({c}, '')), '@([^>@{WS_SET}]+)', 1)"


SPOOF_SQL = f"""(({domain_sql('"from"')} <> '' AND {domain_sql('reply_to')} <> '' AND {domain_sql('"from"')} <> {domain_sql('reply_to')})
  OR regexp_matches(lower(coalesce("from", '')), '@[^\\n]*@') OR regexp_matches(lower(coalesce("from", '')), '[^a-zA-Z0-9.@_-]')
  OR regexp_matches(lower(coalesce("from", '')), '\\.(ru|cn|tk|top|xyz)$'))::int"""


@query("spoofing", oracle(f"SELECT msg_id, {SPOOF_SQL} AS spoofing FROM corpus", "corpus"))
def spoofing(spark, sf):
    return views.corpus(spark, sf).select("msg_id", address.spoofing(F.col("from"), F.col("reply_to")).alias("spoofing"))


FLAGS_SQL = f"""regexp_matches(lower(t), {word_re(lexicons.GREETINGS)})::int AS has_greeting, regexp_matches(lower(t), {word_re(lexicons.SIGNATURES)})::int AS has_signature,
  regexp_matches(lower(t), {word_re(lexicons.REQUESTS)})::int AS has_request, contains(t, '?')::int AS has_question"""


@query("context_flags", oracle(f"SELECT msg_id, {FLAGS_SQL} FROM t", "corpus", extra=[TEXT_CTE]))
def context_flags(spark, sf):
    f = features.context_features(features.with_text(views.corpus(spark, sf)))
    return f.select("msg_id", "has_greeting", "has_signature", "has_request", "has_question")


@query("context_counts", oracle(f"SELECT msg_id, {kw_sql(lexicons.BUSINESS)} AS business_term_count, {word_sum(lexicons.PERSONAL_TERMS)} AS personal_term_count FROM t", "corpus", extra=[TEXT_CTE]))
def context_counts(spark, sf):
    f = features.context_features(features.with_text(views.corpus(spark, sf)))
    return f.select("msg_id", "business_term_count", "personal_term_count")


@query("context_counts_words", oracle(f"SELECT msg_id, {kw_sql(SEEN_FINANCIAL)} AS business_term_count, {word_sum(SEEN_TERMS)} AS personal_term_count FROM t", "corpus", extra=[TEXT_CTE]))
def context_counts_words(spark, sf):
    f = features.with_text(views.corpus(spark, sf))
    f = features.context_features(f, "text", SEEN_FINANCIAL, SEEN_TERMS)
    return f.select("msg_id", "business_term_count", "personal_term_count")


DOMAIN_SQL = f"""(d IN {_in(address.PROVIDERS)})::int AS is_common_domain, length(d)::int AS domain_length"""


@query(
    "domain_features",
    oracle(
        f"""SELECT msg_id, {DOMAIN_SQL}, {_count_sql('d', '.')}::int AS subdomain_count, regexp_matches(d, '\\p{{Nd}}')::int AS domain_has_numbers
        FROM (SELECT msg_id, {domain_sql('"from"')} AS d FROM corpus)""",
        "corpus",
    ),
)
def domain_features(spark, sf):
    return views.corpus(spark, sf).select("msg_id", *[c.alias(n) for n, c in address.domain_features(F.col("from")).items()])


@query("text_lengths", oracle("SELECT msg_id, length(coalesce(subject, ''))::int AS subject_length, length(coalesce(body, ''))::int AS body_length FROM mail_raw", "mail_raw"))
def text_lengths(spark, sf):
    return views.mail_raw(spark, sf).select(
        "msg_id",
        F.length(text.or_empty(F.col("subject"))).alias("subject_length"),
        F.length(text.or_empty(F.col("body"))).alias("body_length"),
    )


# --- sentiment in SQL: one row per word, neighbours by lag ---------------------------
_P = "[.!?,;:''\"-]"


def sentiment_ctes(lexicon, up=BOOSTERS_UP, down=BOOSTERS_DOWN, neg=NEGATIONS, pivot="but", idioms=IDIOMS, dampers=DAMPERS, never=("never", ("so", "this")), least=("least", ("at", "very"))):
    lex = ", ".join(f"{_in([w])[:-1]}, {v}::double)" for w, v in lexicon.items())
    scored = [w for w in lexicon if w not in up + down]

    def emph(v, w):
        return f"CASE WHEN caps AND regexp_matches({w}, '\\p{{Lu}}') AND NOT regexp_matches({w}, '\\p{{Ll}}') THEN CASE WHEN {v} > 0 THEN {CAPS} ELSE -{CAPS} END ELSE 0 END"

    def step(i, prev):
        scale = f"CASE WHEN l{i} IN {_in(up)} THEN {BOOST} WHEN l{i} IN {_in(down)} THEN -{BOOST} END"
        boost = f"coalesce(({scale} * CASE WHEN v < 0 THEN -1 ELSE 1 END + {emph('v', f'w{i}')})::double * {DAMP[i - 1]}, 0)"
        strong = ["", f"WHEN l2 = '{never[0]}' AND l1 IN {_in(never[1])} THEN {NEVER_SO[0]}", f"WHEN (l3 = '{never[0]}' AND l2 IN {_in(never[1])}) OR l1 IN {_in(never[1])} THEN {NEVER_SO[1]}"][i - 1]
        turned = f"CASE {strong} WHEN l{i} IN {_in(neg)} OR contains(l{i}, 'n''t') THEN {NEGATE} ELSE 1 END"
        return (
            f"v{i}",
            f"SELECT * EXCLUDE (v), CASE WHEN l{i} IS NULL OR l{i} IN {_in(lexicon)} THEN v ELSE (v + {boost}) * ({turned})::double END AS v FROM {prev}",
        )

    lags = ", ".join(f"lag(l, {i}) OVER o AS l{i}, lag(w, {i}) OVER o AS w{i}" for i in (1, 2, 3)) + ", lead(l, 1) OVER o AS f1, lead(l, 2) OVER o AS f2"
    table = ", ".join(f"('{k}', {v}::double)" for k, v in idioms.items())
    runs = ["l || ' ' || f1 || ' ' || f2", "l || ' ' || f1", "l1 || ' ' || l", "l2 || ' ' || l1 || ' ' || l", "l2 || ' ' || l1", "l3 || ' ' || l2 || ' ' || l1", "l3 || ' ' || l2"]
    idiom = "coalesce(" + ", ".join(f"(SELECT max(x) FROM (VALUES {table}) z(k, x) WHERE k = {r})" for r in runs) + ", v)"
    weak = f"CASE WHEN coalesce(l3 || ' ' || l2 IN {_in(dampers)}, false) OR coalesce(l2 || ' ' || l1 IN {_in(dampers)}, false) THEN {BOOST} ELSE 0 END"
    opens = " OR ".join(f"(l = '{p.split()[0]}' AND coalesce(f1 = '{p.split()[1]}', false))" for p in dampers)
    faces = _in(emoticons_of(lexicon)) if emoticons_of(lexicon) else "('')"
    edge = "'" + ".!?,;:''\"-" + "'"
    return [
        ("lex", f"SELECT * FROM (VALUES {lex}) x(word, base) WHERE word IN {_in(scored)}"),
        ("words", f"""SELECT msg_id, list_filter(list_transform(regexp_split_to_array(t, '{WS}+'), lambda x: CASE WHEN lower(x) IN {faces} THEN x ELSE trim(x, {edge}) END), lambda x: length(x) > 1) AS a FROM t"""),
        ("tok", "SELECT msg_id, unnest(a) AS w, unnest(range(1, len(a) + 1)) AS pos, len(a) AS n FROM words"),
        ("ctx", f"""SELECT *, ups > 0 AND ups < n AS caps FROM (SELECT *, {lags}, min(CASE WHEN l = '{pivot}' THEN pos END) OVER (PARTITION BY msg_id) AS but,
            sum((regexp_matches(w, '\\p{{Lu}}') AND NOT regexp_matches(w, '\\p{{Ll}}'))::int) OVER (PARTITION BY msg_id) AS ups
          FROM (SELECT *, lower(w) AS l FROM tok) WINDOW o AS (PARTITION BY msg_id ORDER BY pos))"""),
        ("v0", f"SELECT ctx.*, base + ({emph('base', 'w')})::double AS v FROM ctx JOIN lex ON l = word WHERE NOT ({opens})"),
        step(1, "v0"), step(2, "v1"), step(3, "v2"),
        ("v4", f"SELECT * EXCLUDE (v), CASE WHEN l3 IS NOT NULL AND l3 NOT IN {_in(lexicon)} THEN {idiom} - ({weak})::double ELSE v END AS v FROM v3"),
        ("v5", f"SELECT * EXCLUDE (v), v * CASE WHEN coalesce(l1 = '{least[0]}' AND l1 NOT IN {_in(lexicon)}, false) AND NOT coalesce(l2 IN {_in(least[1])}, false) THEN {NEGATE} ELSE 1 END::double AS v FROM v4"),
        ("vals", f"SELECT msg_id, v * CASE WHEN but IS NULL OR pos = but THEN 1 WHEN pos < but THEN {BEFORE_BUT} ELSE {AFTER_BUT} END::double AS v FROM v5"),
        ("sums", """SELECT msg_id, sum(v) AS s, sum(CASE WHEN v > 0 THEN v + 1 ELSE 0 END)::double AS p, sum(CASE WHEN v < 0 THEN v - 1 ELSE 0 END)::double AS q,
            count(*) FILTER (v <> 0) AS k FROM vals GROUP BY msg_id"""),
        ("emphasis", f"""SELECT msg_id, least(length(t) - length(replace(t, '!', '')), 4) * {EXCLAMATION}::double
            + CASE WHEN qm <= 1 THEN 0 WHEN qm <= 3 THEN qm * {QUESTION} ELSE {MANY_QUESTIONS} END::double AS e
          FROM (SELECT *, length(t) - length(replace(t, '?', '')) AS qm FROM t)"""),
        ("parts", """SELECT w.msg_id, len(a) AS n, coalesce(s, 0) AS s, coalesce(p, 0) AS p, coalesce(q, 0) AS q, coalesce(k, 0) AS k, e
          FROM words w JOIN emphasis USING (msg_id) LEFT JOIN sums USING (msg_id)"""),
        ("sentiment", f"""SELECT msg_id, round_even(round(st / sqrt(st * st + {ALPHA}), 9), 4)::double + 0 AS sentiment_compound, CASE WHEN ng + n - k + ps > 0 THEN round_even(round(ng / (ng + n - k + ps), 9), 3) ELSE 0 END::double AS sentiment_neg,
            CASE WHEN ng + n - k + ps > 0 THEN round_even(round((n - k) / (ng + n - k + ps), 9), 3) ELSE 0 END::double AS sentiment_neu,
            CASE WHEN ng + n - k + ps > 0 THEN round_even(round(ps / (ng + n - k + ps), 9), 3) ELSE 0 END::double AS sentiment_pos
          FROM (SELECT msg_id, n, k, s + CASE WHEN s > 0 THEN e WHEN s < 0 THEN -e ELSE 0 END AS st,
              p + CASE WHEN p > abs(q) THEN e ELSE 0 END AS ps, abs(q - CASE WHEN p < abs(q) THEN e ELSE 0 END) AS ng FROM parts)"""),
    ]


@query("lexicon_sentiment", oracle("SELECT msg_id, sentiment_compound, sentiment_neg, sentiment_neu, sentiment_pos FROM sentiment", "corpus", extra=[TEXT_CTE, *sentiment_ctes(VALENCE)]))
def lexicon_sentiment(spark, sf):
    s = with_sentiment(features.with_text(views.corpus(spark, sf)), "text")
    return rounded(s.select("msg_id", *features.SENTIMENT))


@query(
    "lexicon_sentiment_words",
    oracle(
        "SELECT msg_id, sentiment_compound, sentiment_neg, sentiment_neu, sentiment_pos FROM sentiment",
        "mail",
        extra=[MAIL_TEXT, *sentiment_ctes(SEEN_LEXICON, *SEEN_RULES.values())],
    ),
)
def lexicon_sentiment_words(spark, sf):
    s = with_sentiment(mail_text(spark, sf), "text", SEEN_LEXICON, **SEEN_RULES)
    return rounded(s.select("msg_id", *features.SENTIMENT))


@query(
    "serving_features",
    oracle(
        f"""SELECT t.msg_id, length(coalesce(subject, ''))::int AS subject_length, length(coalesce(body, ''))::int AS body_length, sentiment_compound,
          sentiment_neg AS sentiment_negative, sentiment_neu AS sentiment_neutral, sentiment_pos AS sentiment_positive,
          len(regexp_extract_all(coalesce(body, ''), '{URL_RE}'))::int AS url_count, {kw_sql(lexicons.URGENCY_SERVING)} AS urgency_count,
          {SPOOF_SQL} AS spoofing_score, ({domain_sql('"from"')} IN {_in(address.PROVIDERS)})::int AS is_common_domain, length({domain_sql('"from"')})::int AS domain_length
        FROM t JOIN sentiment USING (msg_id)""",
        "corpus",
        extra=[TEXT_CTE, *sentiment_ctes(VALENCE)],
    ),
)
def serving_features(spark, sf):
    return rounded(features.serving_features(views.corpus(spark, sf)))


@query(
    "five_features",
    oracle(
        f"""SELECT t.msg_id, len({tokens_sql('t')})::int AS word_count, len(regexp_extract_all(t, '{URL_RE}'))::int AS url_count, sentiment_compound,
          {kw_sql(lexicons.URGENCY)} AS urgency_hits, {SPOOF_SQL} AS spoof_flag FROM t JOIN sentiment USING (msg_id)""",
        "corpus",
        extra=[TEXT_CTE, *sentiment_ctes(VALENCE)],
    ),
)
def five_features(spark, sf):
    return rounded(features.five_features(views.corpus(spark, sf)))


CORPUS_URLS = [
    ("u", f"SELECT msg_id, unnest(a) AS url, unnest(range(0, len(a)))::int AS pos FROM (SELECT msg_id, regexp_extract_all(t, '{URL_RE}') AS a FROM t)"),
    HOST_ROWS,
    ("agg", URL_AGG_SQL),
]
NUMERIC_CTES = [TEXT_CTE, TREEBANK, *sentiment_ctes(VALENCE), *CORPUS_URLS]
NUMERIC_SQL = f"""SELECT t.msg_id, len({tokens_sql('t')})::int AS word_count, {URL_FILLED}, sentiment_compound, sentiment_neg, sentiment_neu, sentiment_pos,
  {KW_SQL}, {COMPLEX_SQL}, {FLAGS_SQL}, {kw_sql(lexicons.BUSINESS)} AS business_term_count, {word_sum(lexicons.PERSONAL_TERMS)} AS personal_term_count, {SPOOF_SQL} AS spoofing
  FROM t JOIN sentiment USING (msg_id) JOIN tb USING (msg_id) LEFT JOIN agg USING (msg_id)"""


@query("numeric_features", oracle(NUMERIC_SQL, "corpus", extra=NUMERIC_CTES))
def numeric_features(spark, sf):
    return rounded(features.numeric_features(views.corpus(spark, sf)))
