"""Small literal cases for the column functions."""

import pytest
from pyspark.sql import functions as F

from mailsift.functions import address, labels, lexicons, text, urls
from mailsift.functions.sentiment import with_sentiment
from mailsift.operators import clean, features


def value(spark, column, **fields):
    row = spark.createDataFrame([tuple(fields.values())], ", ".join(f"`{k}` string" for k in fields))
    return row.select(column.alias("v")).head()["v"]


def test_spoofing(spark):
    def spoof(sender, reply):
        return value(spark, address.spoofing(F.col("s"), F.col("r")), s=sender, r=reply)

    assert spoof("orders@amazon-store.net", "no-reply@amazon-store.net") == 0
    assert spoof("a@x.com", "a@y.com") == 1
    assert spoof("Bob <bob@x.com>", None) == 1
    assert spoof("a@b@c.com", None) == 1
    assert spoof("a@mail.ru", None) == 1
    assert spoof(None, None) == 0


def test_keywords_count_inside_words_and_doubled_entries(spark):
    def urgency(t):
        return value(spark, lexicons.keyword_count(F.lower("t"), lexicons.URGENCY), t=t)

    assert urgency("urgent") == 2
    assert urgency("I know") == 1
    assert urgency("") == 0


def test_whole_words(spark):
    def whole(t, entries):
        low = F.lower("t")
        return value(spark, lexicons.whole_word_count(low, text.words_of(low), entries), t=t)

    assert whole("We bring our tea", lexicons.PERSONAL_TERMS) == 2
    assert whole("urgent!", lexicons.URGENCY) == 2
    assert whole("follow upon", ["follow up"]) == 0
    assert whole("éme me", ["me"]) == 1


def test_context_flags(spark):
    df = spark.createDataFrame([("Good morning, could you reply? Thanks",), ("This is high",)], "text string")
    rows = features.context_features(df).collect()
    assert [rows[0][c] for c in ("has_greeting", "has_signature", "has_request", "has_question")] == [1, 1, 1, 1]
    assert [rows[1][c] for c in ("has_greeting", "has_signature", "has_request", "has_question")] == [0, 0, 0, 0]


@pytest.mark.parametrize(
    "url, expected",
    [
        ("https://microsoft.com/", {"is_shortened": 1, "is_common_domain": 1, "has_https": 1}),
        ("http://10.0.0.1/x", {"has_ip_address": 1, "num_subdomains": 3, "has_https": 0}),
        ("www.docs.google.com/a", {"is_common_domain": 1, "num_subdomains": 3}),
        ("http://user:pw@a.xyz:80/", {"num_at_signs": 1, "has_suspicious_tld": 0}),
        ("http://evil.xyz?q", {"has_suspicious_tld": 1}),
        ("http://[bad/", {"num_subdomains": 0, "has_ip_address": 0}),
    ],
)
def test_url_record(spark, url, expected):
    got = value(spark, urls.url_record(F.col("u")), u=url).asDict()
    assert {k: got[k] for k in expected} == expected


def test_no_url_gives_zeros(spark):
    df = spark.createDataFrame([("nothing here",)], "text string")
    row = features.url_features(df).head()
    assert all(row[c] == 0 for c in urls.URL_AGGREGATES)


def test_three_hand_written_mails(spark):
    mails = [
        (1, "security@bank.com", "reply@scam.net", "Verify", "Click http://bit.ly/x now"),
        (2, "ann@work.org", "ann@work.org", "Notes", "Hello, see you"),
        (3, "orders@shop.net", "orders@shop.net", "Order", "Shipped"),
    ]
    df = spark.createDataFrame(mails, "msg_id long, `from` string, reply_to string, subject string, body string")
    r = {x["msg_id"]: x for x in features.numeric_features(df).collect()}
    assert (r[1]["spoofing"], r[1]["url_count"], r[1]["has_shortened_url"]) == (1, 1, 1)
    assert (r[2]["spoofing"], r[2]["url_count"], r[2]["has_greeting"]) == (0, 0, 1)
    assert (r[3]["spoofing"], r[3]["url_count"]) == (0, 0)


def test_sentiment_rules(spark):
    texts = ["good day", "not good day", "very good day", "GOOD day", "good but bad", "plain text", "", "good day!!!"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    s = {r["i"]: r for r in with_sentiment(df, "text").collect()}
    c = {i: r["sentiment_compound"] for i, r in s.items()}
    assert c[0] == pytest.approx(1.9 / (1.9**2 + 15) ** 0.5, abs=1e-4)
    assert c[1] == pytest.approx(-1.406 / (1.406**2 + 15) ** 0.5, abs=1e-4)
    assert c[2] > c[0] and c[3] > c[0] and c[7] > c[0] and c[4] < 0
    assert (c[5], s[5]["sentiment_neu"], c[6], s[6]["sentiment_neu"]) == (0.0, 1.0, 0.0, 0.0)


def test_labels(spark):
    assert value(spark, labels.normalize(F.col("x")), x="maybe") is None
    assert value(spark, labels.normalize(F.col("x")), x="SPAM") == "phishing"
    assert value(spark, labels.evaluation_target(F.col("x")), x=" Phishing ") == 1
    assert value(spark, labels.evaluation_target(F.col("x")), x=None) == 0
    assert value(spark, labels.from_path(F.col("x")), x="/a/graham.eml") == "legitimate"


def test_unicode_white_space(spark):
    assert value(spark, text.collapse_ws(F.col("x")), x=" a  b\x1c\n") == "a b"
    assert value(spark, text.word_count(F.col("x")), x="a　b c") == 3
    assert value(spark, text.analyzed(F.col("x")), x="ÉÀß é") == "eaß e"


def test_ngrams(spark):
    words = F.split("x", " ")
    assert value(spark, text.word_ngrams(words, 2), x="a b c") == ["a b", "b c"]
    assert value(spark, text.word_ngrams(words, 3), x="a b") == []


def test_cleaning_edges(spark):
    rows = [(1, "hello", "", "spam"), (2, None, "", "spam"), (3, "Finance", "long enough body", "spam"), (4, "x", "123456789", "1")]
    df = spark.createDataFrame(rows, "msg_id long, subject string, body string, label string")
    assert {r["msg_id"] for r in clean.drop_empty(df).collect()} == {1, 3, 4}
    assert {r["msg_id"] for r in clean.drop_nan_subject(df).collect()} == {1, 2, 4}
    assert {r["msg_id"] for r in clean.min_length(df).collect()} == {3}


def test_headers():
    assert clean.snake_case("__Email  Subject!! ") == "email_subject"


def test_numeric_headers(spark):
    df = spark.createDataFrame([("a", "b")], "`0` string, `Mail Body` string")
    assert clean.normalize_headers(df).columns == ["col_0", "mail_body"]


def test_numeric_label_guard(spark):
    mixed = spark.createDataFrame([("1",), ("yes",)], "label string")
    assert {r[0] for r in clean.numeric_labels(mixed).collect()} == {"1", "yes"}
    pure = spark.createDataFrame([("1",), ("0.0",)], "label string")
    assert {r[0] for r in clean.numeric_labels(pure).collect()} == {"phishing", "legitimate"}


def test_dedup_is_idempotent_and_survives_a_hot_group(spark):
    df = spark.range(3000).select(
        F.col("id").alias("msg_id"),
        F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("subject"),
        F.when(F.col("id") % 2 == 0, "b").alias("body"),
    )
    once = clean.dedup(df, ["subject", "body"])
    assert once.count() == 2000 + 2
    assert {r["msg_id"] for r in once.where("subject = 'same'").collect()} == {0, 3}
    assert clean.dedup(once, ["subject", "body"]).count() == once.count()
