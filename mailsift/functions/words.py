"""Counts of Treebank tokens, made word by word.

The rules of ``text.treebank_tokens`` look no further than the word, so a word is
parted once and its parts are counted; words of letters and digits have none. Only the
rules of joined words (cannot, gimme) take the white space beside them: in texts that
have one, all rules see the whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from mailsift.functions.text import APOSTROPHES, JOINED_WORDS, PUNCTUATION, QUOTES

#: Words a worker remembers the parts of.
REMEMBERED = 1 << 17
_COUNTS = ["tokens", "distinct", "alpha", "letters"]


def _rules(rules: list[tuple[str, str]]) -> list[tuple[re.Pattern, str]]:
    """The rules as Python has them; its ``\\s`` is the set of white space."""
    plain = [(p.format(ws=r"\s", set=r"\s").replace(r"\p{Nd}", r"\d").replace("|$)", r"|\Z)"), new) for p, new in rules]
    return [(re.compile(p), re.sub(r"\$(\d)", r"\\\1", new)) for p, new in plain]


_QUOTES, _PUNCTUATION, _APOSTROPHES, _JOINED = (_rules(r) for r in (QUOTES, PUNCTUATION, APOSTROPHES, JOINED_WORDS))
_SIMPLE = re.compile(r"([^\W_]+)([,:;?!]|(?<=..)\.)")
_WHOLE = ["cannot", "gimme", "gonna", "gotta", "lemme", "wanna"]


def _parted(text: str) -> str:
    """The text with its tokens set apart, but for joined words."""
    for mark, rules in (('"', _QUOTES), ("", _PUNCTUATION), ("'", _APOSTROPHES)):
        if mark in text:
            for pattern, new in rules:
                text = pattern.sub(new, text)
    return text


@lru_cache(REMEMBERED)
def _parts(word: str) -> list[str]:
    simple = _SIMPLE.fullmatch(word)
    return list(simple.groups()) if simple else _parted(word).split()


def token_counts(text: str) -> Counter:
    """How often each Treebank token stands in a text."""
    low = text.lower()
    if any(w in low for w in _WHOLE):
        text = _parted(text)
        for pattern, new in _JOINED:
            text = pattern.sub(new, text)
        return Counter(text.split())
    count, parts = Counter(text.split()), []
    for word in [w for w in count if not w.isalnum()]:
        parts += _parts(word) * count.pop(word)
    count.update(parts)
    return count


@F.arrow_udf(reduce(lambda t, c: t.add(c, LongType()), _COUNTS, StructType()))
def _counted(texts: pa.Array) -> pa.Array:
    rows = []
    for x in texts:
        found = token_counts((x.as_py() or b"").decode("utf-8", "replace"))
        alpha = [(n, len(token)) for token, n in found.items() if token.isalpha()]
        rows.append((sum(found.values()), len(found), sum(n for n, _ in alpha), sum(n * size for n, size in alpha)))
    columns = zip(*rows) if rows else [()] * len(_COUNTS)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=_COUNTS)


def treebank_counts(c: Column) -> Column:
    """Number of Treebank tokens, of different ones, of purely alphabetic ones and of
    the letters in these; all zero for null."""
    return _counted(c.cast("binary"))
