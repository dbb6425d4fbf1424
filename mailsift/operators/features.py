"""Numeric feature rows for training and serving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.functions import address, lexicons, text, urls, words
from mailsift.functions.sentiment import with_sentiment

SENTIMENT = ["sentiment_compound", "sentiment_neg", "sentiment_neu", "sentiment_pos"]
# --- fixed values: the 30 training features in matrix order -----------------------
NUMERIC_FEATURES = [
    "word_count",
    "url_count", "avg_url_length", "max_url_length", "avg_num_dots",
    "max_num_dots", "avg_num_hyphens", "max_num_hyphens", "has_ip_address",
    "has_shortened_url", "has_suspicious_tld", "has_common_domain", "https_ratio",
    "sentiment_compound", "sentiment_neg", "sentiment_neu", "sentiment_pos",
    "urgency_count", "financial_count", "personal_info_count",
    "avg_word_length", "unique_words_ratio", "capital_letters_ratio",
    "has_greeting", "has_signature", "business_term_count",
    "has_request", "has_question", "personal_term_count",
    "spoofing",
]
SERVING_FEATURES = [
    "subject_length", "body_length",
    "sentiment_compound", "sentiment_negative", "sentiment_neutral", "sentiment_positive",
    "url_count", "urgency_count", "spoofing_score", "is_common_domain", "domain_length",
]
FIVE_FEATURES = ["word_count", "url_count", "sentiment_compound", "urgency_hits", "spoof_flag"]
# -----------------------------------------------------------------------------------


def with_text(df: DataFrame) -> DataFrame:
    return df.withColumn("text", text.joined_text(F.col("subject"), F.col("body")))


def url_features(df: DataFrame, column: str = "text") -> DataFrame:
    """Append the twelve per-text URL aggregates."""
    keep = df.columns
    df = df.withColumn("_urls", urls.url_records(urls.extract_urls(F.col(column))))
    return df.select(*keep, *[c.alias(n) for n, c in urls.url_aggregates(F.col("_urls")).items()])


def _with_parts(df: DataFrame, column: str) -> DataFrame:
    """Lower-case text, white-space tokens, counts of word tokens and lower-case words, made once."""
    df = df.withColumns({"_low": F.lower(column), "_tokens": text.tokens(F.col(column)), "_treebank": words.treebank_counts(F.col(column))})
    return df.withColumn("_words", text.words_of(F.col("_low")))


def _complexity(column: str, tokenizer: str = "treebank") -> dict[str, Column]:
    if tokenizer == "space":
        tokens = F.col("_tokens")
        length, unique = text.alpha_word_length(tokens), text.unique_ratio(tokens)
    else:
        n = F.col("_treebank")
        length = F.when(n.alpha > 0, n.letters / n.alpha).otherwise(F.lit(0.0))
        unique = F.when(n.tokens > 0, n.distinct / n.tokens).otherwise(F.lit(0.0))
    return {"avg_word_length": length, "unique_words_ratio": unique, "capital_letters_ratio": text.capital_ratio(F.col(column))}


def _keywords(urgency: list[str], financial: list[str], personal: list[str]) -> dict[str, Column]:
    low = F.col("_low")
    return {
        "urgency_count": lexicons.keyword_count(low, urgency),
        "financial_count": lexicons.keyword_count(low, financial),
        "personal_info_count": lexicons.keyword_count(low, personal),
    }


def _context() -> dict[str, Column]:
    low, words = F.col("_low"), F.col("_words")
    return {**lexicons.context_flags(low, words), **lexicons.context_counts(low, words)}


def _named(parts: dict[str, Column]) -> list[Column]:
    return [c.alias(n) for n, c in parts.items()]


def text_complexity(df: DataFrame, column: str = "text", tokenizer: str = "treebank") -> DataFrame:
    """Word length, word variety and capitals. Words are Treebank tokens, or with
    ``tokenizer="space"`` what stands between white space."""
    if tokenizer not in ("treebank", "space"):
        raise KeyError(tokenizer)
    return _with_parts(df, column).select(*df.columns, *_named(_complexity(column, tokenizer)))


def keyword_features(
    df: DataFrame,
    column: str = "text",
    urgency: list[str] = lexicons.URGENCY,
    financial: list[str] = lexicons.FINANCIAL,
    personal: list[str] = lexicons.PERSONAL_INFO,
) -> DataFrame:
    parts = _keywords(urgency, financial, personal)
    return _with_parts(df, column).select(*df.columns, *_named(parts))


def context_features(
    df: DataFrame,
    column: str = "text",
    business: list[str] = lexicons.BUSINESS,
    personal: list[str] = lexicons.PERSONAL_TERMS,
) -> DataFrame:
    low, words = F.col("_low"), F.col("_words")
    parts = {**lexicons.context_flags(low, words), **lexicons.context_counts(low, words, business, personal)}
    return _with_parts(df, column).select(*df.columns, *_named(parts))


def numeric_features(df: DataFrame, lexicon: dict[str, float] | None = None, keep: list[str] | None = None) -> DataFrame:
    """The 30 training features, one narrow plan without a shuffle."""
    keep = ["msg_id"] if keep is None else keep
    rows = with_text(df)
    scored = url_features(with_sentiment(rows, "text", lexicon))
    parts = {
        "word_count": F.size("_tokens"),
        "spoofing": address.spoofing(F.col("from"), F.col("reply_to")),
        **_complexity("text"),
        **_keywords(lexicons.URGENCY, lexicons.FINANCIAL, lexicons.PERSONAL_INFO),
        **_context(),
        **{c: F.col(c) for c in [*SENTIMENT, *urls.URL_AGGREGATES]},
    }
    full = _with_parts(scored, "text")
    return full.select(*keep, *[parts[c].alias(c) for c in NUMERIC_FEATURES])


def serving_features(df: DataFrame, lexicon: dict[str, float] | None = None) -> DataFrame:
    """The 11 unscaled features used when scoring single mails."""
    names = ("sentiment_compound", "sentiment_negative", "sentiment_neutral", "sentiment_positive")
    df = with_sentiment(with_text(df), "text", lexicon, names)
    domain = address.domain_features(F.col("from"))
    low = F.lower("text")
    return df.select(
        "msg_id",
        F.length(text.or_empty(F.col("subject"))).alias("subject_length"),
        F.length(text.or_empty(F.col("body"))).alias("body_length"),
        *names,
        urls.count_urls(text.or_empty(F.col("body"))).alias("url_count"),
        lexicons.keyword_count(low, lexicons.URGENCY_SERVING).alias("urgency_count"),
        address.spoofing(F.col("from"), F.col("reply_to")).alias("spoofing_score"),
        domain["is_common_domain"].alias("is_common_domain"),
        domain["domain_length"].alias("domain_length"),
    )


def five_features(df: DataFrame, lexicon: dict[str, float] | None = None, keep: list[str] | None = None) -> DataFrame:
    """The short feature row of the batch scorer."""
    keep = ["msg_id"] if keep is None else keep
    df = with_sentiment(with_text(df), "text", lexicon)
    return df.select(
        *keep,
        text.word_count(F.col("text")).alias("word_count"),
        urls.count_urls(F.col("text")).alias("url_count"),
        "sentiment_compound",
        lexicons.keyword_count(F.lower("text"), lexicons.URGENCY).alias("urgency_hits"),
        address.spoofing(F.col("from"), F.col("reply_to")).alias("spoof_flag"),
    )
