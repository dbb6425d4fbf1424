"""Sender address checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailsift.functions.text import WS_SET, or_empty

DOMAIN = f"@([^>@{WS_SET}]+)"

# --- fixed values --------------------------------------------------------------
PROVIDERS = [
    "gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "aol.com", "icloud.com",
]
SENDER_TLDS = ["ru", "cn", "tk", "top", "xyz"]
# --------------------------------------------------------------------------------


def address_domain(address: Column) -> Column:
    """Lower-case domain after the first '@' that has one; '' if none."""
    return F.regexp_extract(F.lower(or_empty(address)), DOMAIN, 1)


def spoofing(sender: Column, reply_to: Column) -> Column:
    """1 when sender and reply domains differ or the sender looks forged."""
    sender_domain = address_domain(sender)
    reply_domain = address_domain(reply_to)
    low = F.lower(or_empty(sender))
    differs = (sender_domain != "") & (reply_domain != "") & (sender_domain != reply_domain)
    odd = low.rlike(
        r"@[^\n]*@|[^a-zA-Z0-9.@_-]|\.(?:" + "|".join(SENDER_TLDS) + ")$"
    )
    return (differs | odd).cast("int")


def domain_features(sender: Column) -> dict[str, Column]:
    domain = address_domain(sender)
    return {
        "is_common_domain": domain.isin(PROVIDERS).cast("int"),
        "domain_length": F.length(domain),
        "subdomain_count": F.length(domain) - F.length(F.replace(domain, F.lit("."), F.lit(""))),
        "domain_has_numbers": domain.rlike(r"\p{Nd}").cast("int"),
    }
