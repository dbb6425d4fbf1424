"""URL extraction and per-URL risk signals, all as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailsift.functions.text import NOT_WS

URL = f"https?://{NOT_WS}+|www\\.{NOT_WS}+"

# --- fixed values --------------------------------------------------------------
COMMON_DOMAINS = [
    "google.com", "microsoft.com", "apple.com", "amazon.com", "facebook.com",
    "twitter.com", "linkedin.com", "github.com", "dropbox.com", "zoom.us",
    "office.com", "live.com", "outlook.com", "gmail.com", "yahoo.com",
    "instagram.com", "youtube.com", "netflix.com", "spotify.com", "slack.com",
    "teams.microsoft.com", "drive.google.com", "docs.google.com", "sharepoint.com",
]
SUSPICIOUS_TLDS = ["xyz", "top", "tk", "gq", "ml", "ga", "cf", "ru", "cn"]
SHORTENERS = [
    "bit.ly", "tinyurl.com", "goo.gl", "t.co", "ow.ly", "is.gd", "buff.ly",
    "adf.ly", "j.mp",
]
# --------------------------------------------------------------------------------

URL_AGGREGATES = [
    "url_count", "avg_url_length", "max_url_length", "avg_num_dots",
    "max_num_dots", "avg_num_hyphens", "max_num_hyphens", "has_ip_address",
    "has_shortened_url", "has_suspicious_tld", "has_common_domain", "https_ratio",
]


def extract_urls(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(URL), F.lit(0))


def count_urls(c: Column) -> Column:
    return F.regexp_count(c, F.lit(URL)).cast("int")


def _occurrences(c: Column, ch: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))


def netloc(url: Column) -> Column:
    """Authority part, user and port included; empty when a bracket is unpaired."""
    part = F.regexp_extract(url, r"^(?:https?://)?([^/?#]*)", 1)
    paired = part.contains("[") == part.contains("]")
    return F.when(paired, part).otherwise(F.lit(""))


def top_domain(host: Column) -> Column:
    """The last two labels of a host."""
    return F.lower(F.substring_index(host, ".", -2))


def url_counts(url: Column) -> dict[str, Column]:
    return {
        "url_length": F.length(url),
        "num_dots": _occurrences(url, "."),
        "num_hyphens": _occurrences(url, "-"),
        "num_at_signs": _occurrences(url, "@"),
        "num_digits": F.length(F.regexp_replace(url, r"[^\p{Nd}]+", "")),
    }


def url_flags(url: Column, host: Column | None = None) -> dict[str, Column]:
    host = netloc(url) if host is None else host
    lowered = F.lower(url)
    short = lowered.contains(SHORTENERS[0])
    for name in SHORTENERS[1:]:
        short = short | lowered.contains(name)
    flags = {
        "has_https": url.startswith("https://"),
        "has_ip_address": host.rlike(r"^\p{Nd}+\.\p{Nd}+\.\p{Nd}+\.\p{Nd}+"),
        "is_common_domain": top_domain(host).isin(COMMON_DOMAINS),
        "has_suspicious_tld": F.lower(F.substring_index(host, ".", -1)).isin(SUSPICIOUS_TLDS),
        "is_shortened": short,
    }
    return {name: flag.cast("int") for name, flag in flags.items()}


def num_subdomains(host: Column) -> Column:
    return _occurrences(host, ".")


def url_record(url: Column) -> Column:
    """All eleven signals of one URL as a struct."""
    host = netloc(url)
    parts = {**url_counts(url), "num_subdomains": num_subdomains(host), **url_flags(url, host)}
    return F.struct(*[c.cast("int").alias(name) for name, c in parts.items()])


def url_records(urls: Column) -> Column:
    return F.transform(urls, url_record)


def url_aggregates(records: Column) -> dict[str, Column]:
    """Per-text summary of an array of URL records; all zero without URLs.

    Works inside the row: no explode, no shuffle.
    """
    n = F.size(records)

    def values(name):
        return F.transform(records, lambda r: r[name])

    def total(name):
        return F.aggregate(records, F.lit(0), lambda acc, r: acc + r[name])

    def mean(name):
        return F.when(n > 0, total(name) / n).otherwise(F.lit(0.0))

    def top(name):
        return F.coalesce(F.array_max(values(name)), F.lit(0))

    return {
        "url_count": n,
        "avg_url_length": mean("url_length"),
        "max_url_length": top("url_length"),
        "avg_num_dots": mean("num_dots"),
        "max_num_dots": top("num_dots"),
        "avg_num_hyphens": mean("num_hyphens"),
        "max_num_hyphens": top("num_hyphens"),
        "has_ip_address": top("has_ip_address"),
        "has_shortened_url": top("is_shortened"),
        "has_suspicious_tld": top("has_suspicious_tld"),
        "has_common_domain": top("is_common_domain"),
        "https_ratio": mean("has_https"),
    }
