"""Keyword lists and their counters.

A keyword counts once per list entry when it occurs anywhere in the lower-case
text, also inside a longer word; ``whole_word_count`` asks for whole words.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailsift.functions.text import constant_strings, has_phrase

# --- fixed values: word lists ------------------------------------------------
# 'urgent' stands twice in the urgency lists and therefore counts twice.
URGENCY = [
    "urgent", "immediately", "attention", "important", "action",
    "required", "verify", "confirm", "update", "security", "alert",
    "warning", "limited", "expires", "deadline", "asap", "now",
    "quick", "critical", "urgent", "validate", "suspend", "restricted",
    "unauthorized", "blocked", "locked", "disabled", "compromised",
]
URGENCY_SERVING = [
    "urgent", "immediately", "attention", "important", "action",
    "required", "verify", "confirm", "update", "security", "alert",
    "warning", "limited", "expires", "deadline", "asap", "now",
    "quick", "critical", "urgent", "validate", "suspend",
]
FINANCIAL = [
    "bank", "account", "credit", "debit", "card", "payment", "transaction",
    "transfer", "money", "balance", "deposit", "withdraw", "financial",
    "paypal", "bitcoin", "crypto", "wallet", "invoice", "bill", "tax",
    "refund", "cash", "statement", "loan", "mortgage", "interest", "fee",
]
PERSONAL_INFO = [
    "password", "username", "login", "credentials", "ssn", "social security",
    "identity", "id", "driver license", "passport", "date of birth", "address",
    "phone", "email", "verification", "verify", "confirm", "update", "personal",
    "information", "details", "data", "profile",
]
BUSINESS = [
    "meeting", "conference", "project", "report", "team", "client",
    "deadline", "schedule", "agenda", "presentation", "document",
    "review", "approve", "discuss", "follow up", "update",
]
# 'I' can never occur in lower-case text; it is kept so that the list is whole.
PERSONAL_TERMS = [
    "we", "our", "us", "team", "I", "my", "me", "mine",
    "colleague", "coworker", "department", "office",
]
GREETINGS = [
    "hi", "hello", "dear", "greetings", "good morning", "good afternoon",
    "good evening",
]
SIGNATURES = [
    "regards", "sincerely", "thank you", "thanks", "best", "cheers",
    "yours truly", "yours sincerely",
]
REQUESTS = ["please", "kindly", "would you", "could you", "can you"]
# -----------------------------------------------------------------------------


def keyword_count(lowered: Column, entries: list[str]) -> Column:
    """Number of list entries found anywhere in a lower-cased text.

    The text is bound to a lambda variable, so it is computed once however many
    entries are tried.
    """
    words = constant_strings(entries)
    return F.transform(F.array(lowered), lambda t: F.size(F.filter(words, lambda w: t.contains(w))))[0]


def whole_word_count(lowered: Column, words: Column, entries: list[str]) -> Column:
    """Number of list entries found as whole words.

    ``words`` is the word array of ``lowered``; single words are looked up there
    in one pass, only phrases search the text.
    """
    by_times: dict[int, list[str]] = {}
    for entry, times in Counter(e for e in entries if " " not in e).items():
        by_times.setdefault(times, []).append(entry)
    parts = [
        F.size(F.array_intersect(words, constant_strings(group))) * times
        for times, group in by_times.items()
    ]
    parts += [has_phrase(lowered, e).cast("int") for e in entries if " " in e]
    return reduce(add, parts)


def has_any(lowered: Column, words: Column, entries: list[str]) -> Column:
    """1 if some entry occurs as a whole word or phrase."""
    single = constant_strings([e for e in entries if " " not in e])
    found = F.arrays_overlap(words, single)
    for phrase in entries:
        if " " in phrase:
            found = found | has_phrase(lowered, phrase)
    return found.cast("int")


def context_flags(lowered: Column, words: Column) -> dict[str, Column]:
    return {
        "has_greeting": has_any(lowered, words, GREETINGS),
        "has_signature": has_any(lowered, words, SIGNATURES),
        "has_request": has_any(lowered, words, REQUESTS),
        "has_question": lowered.contains("?").cast("int"),
    }


def context_counts(
    lowered: Column,
    words: Column,
    business: list[str] = BUSINESS,
    personal: list[str] = PERSONAL_TERMS,
) -> dict[str, Column]:
    return {
        "business_term_count": keyword_count(lowered, business),
        "personal_term_count": whole_word_count(lowered, words, personal),
    }
