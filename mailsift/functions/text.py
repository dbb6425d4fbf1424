"""Text expressions shared by cleaning, feature building and TF-IDF."""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Explicit character classes, because the shorthand \s, \w and \b cover only
# ASCII in Java while mail text is Unicode.
WS_SET = (
    r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
# The intersection lets Java reject a Latin character after two comparisons.
WS = (
    r"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x20\x{85}\x{A0}"
    r"[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]]]"
)
NOT_WS = f"[^{WS_SET}]"
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
HTML_TAG = r"<[^>]+>"


def constant_strings(values: list[str]) -> Column:
    """A constant string array from one literal; no value may hold a line break."""
    if not values:
        return F.array().cast("array<string>")
    return F.split(F.lit("\n".join(values)), "\n")


def sql_list(values: list[str]) -> str:
    """The values as an SQL list, for membership tests against a hash set."""
    return "(" + ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values) + ")"


def blank(c: Column) -> Column:
    """True for null and for the empty string."""
    return c.isNull() | (c == "")


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def joined_text(subject: Column, body: Column) -> Column:
    """Subject and body in one string, nulls as empty text."""
    return F.concat(or_empty(subject), F.lit(" "), or_empty(body))


def strip_ws(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def collapse_ws(c: Column) -> Column:
    """Runs of white space become one space, the edges are stripped."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, HTML_TAG, " ")


def tokens(c: Column) -> Column:
    """White-space tokens; an empty text gives an empty array."""
    return F.filter(F.split(c, f"{WS}+"), lambda t: t != "")


def word_count(c: Column) -> Column:
    return F.size(tokens(c))


def words_of(c: Column) -> Column:
    """Runs of word characters."""
    return F.regexp_extract_all(c, F.lit(WORD + "+"), F.lit(0))


def has_phrase(lowered: Column, phrase: str) -> Column:
    """A phrase of several words at word borders, Unicode-aware.

    The plain substring test rules out nearly all texts before the pattern runs.
    """
    return lowered.contains(phrase) & lowered.rlike(f"(?:^|{NOT_WORD}){phrase}(?:{NOT_WORD}|$)")


def mean_word_length(words: Column) -> Column:
    """Mean length of the strings of an array, null when it is empty."""
    total = F.aggregate(words, F.lit(0), lambda acc, w: acc + F.length(w))
    return F.when(F.size(words) > 0, total / F.size(words))


def alpha_word_length(words: Column) -> Column:
    """Mean length of purely alphabetic tokens, 0 if there are none."""
    alpha = F.filter(words, lambda w: w.rlike(r"^\p{L}+$"))
    return F.coalesce(mean_word_length(alpha), F.lit(0.0))


def unique_ratio(words: Column) -> Column:
    n = F.size(words)
    return F.when(n > 0, F.size(F.array_distinct(words)) / n).otherwise(F.lit(0.0))


def capital_ratio(c: Column) -> Column:
    upper = F.length(F.regexp_replace(c, r"[^\p{Lu}]+", ""))
    return F.when(F.length(c) > 0, upper / F.length(c)).otherwise(F.lit(0.0))


def is_meaningful(c: Column) -> Column:
    """Mean word length within [2, 15]; no word at all counts as meaningless.

    The word array is bound to a lambda variable, so it is extracted once.
    """

    def sound(words):
        n, letters = F.size(words), F.length(F.array_join(words, ""))
        return (n > 0) & (letters >= 2 * n) & (letters <= 15 * n)

    return F.transform(F.array(words_of(c)), sound)[0]


# Word tokens in the manner of the Penn Treebank: (pattern, replacement), applied in
# order; {ws} stands for a white-space character, {set} for all of them, $n for a group. The patterns mean
# the same to Java and RE2.
QUOTES = [(r'(^|[{set}(\[{{<])"', "$1 `` "), ('"', " '' ")]
PUNCTUATION = [
    (r"(\.{{2,}}|--)", " $1 "),
    (r"([;@#$%&?!\]\[(){{}}<>])", " $1 "),
    (r"([,:])([^\p{{Nd}}]|$)", " $1 $2"),
    # two letters before it: initials and U.S. keep their stop
    (r"([^.{set}]{{2}})\.({ws}|$)", "$1 .$2"),
]
#: The last of them as Java finds it soonest: it looks back from each full stop
#: instead of trying two letters at every place. Nothing between two stops is shared.
FULL_STOP = (r"\.(?<=[^.{set}]{{2}}\.)(?={ws}|$)", " .")
APOSTROPHES = [
    (r"([^{set}'])('[sSmMdD]|'[lL][lL]|'[rR][eE]|'[vV][eE]|[nN]'[tT])({ws}|$)", "$1 $2$3"),
    (r"([^{set}'])'({ws}|$)", "$1 '$2"),
]
_JOINED = [("[cC][aA][nN]", "[nN][oO][tT]"), ("[gG][iI][mM]", "[mM][eE]"), ("[gG][oO][nN]", "[nN][aA]"), ("[gG][oO][tT]", "[tT][aA]"), ("[lL][eE][mM]", "[mM][eE]"), ("[wW][aA][nN]", "[nN][aA]")]
JOINED_WORDS = [(f"(^|{{ws}})({a})({b})({{ws}}|$)", "$1$2 $3$4") for a, b in _JOINED]


def _replaced(c: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, new in rules:
        c = F.regexp_replace(c, pattern.format(ws=WS, set=WS_SET), new)
    return c


def full_stops(x: Column) -> Column:
    """Full stops set apart; Java looks back wrongly over characters beyond U+FFFF."""
    return F.when(x.rlike(r"[\x{10000}-\x{10FFFF}]"), _replaced(x, PUNCTUATION[-1:])).otherwise(_replaced(x, [FULL_STOP]))


def treebank_tokens(c: Column) -> Column:
    """Words and punctuation marks: marks stand alone, contractions are parted
    (do n't, it 's, can not), a full stop ends a word of two letters or more.

    Only texts with a quote, an apostrophe or a joined word are changed for them.
    """

    def within(test, rules):
        return lambda x: F.when(test(x), _replaced(x, rules)).otherwise(x)

    one = F.array(c)
    one = F.transform(one, within(lambda x: x.contains('"'), QUOTES))
    one = F.transform(one, lambda x: _replaced(x, PUNCTUATION[:-1]))
    one = F.transform(one, full_stops)
    one = F.transform(one, within(lambda x: x.contains("'"), APOSTROPHES))
    joined = "|".join(a + b for a, b in _JOINED)
    one = F.transform(one, within(lambda x: x.rlike(joined), JOINED_WORDS))
    return tokens(F.get(one, F.lit(0)))


#: Hangul syllables decompose by arithmetic: first, number of syllables, and the
#: first leading, vowel and trailing letter with how many there are.
_HANGUL, _SYLLABLES = 0xAC00, 11172
_LEADING, _VOWELS, _TRAILING = (0x1100, 19), (0x1161, 21), (0x11A7, 28)


@lru_cache(maxsize=1)
def accent_tables() -> tuple[str, str, str, list[str]]:
    """Compatibility decomposition without combining marks, from the Unicode
    database: characters that become one (with marks, which become none, at the
    end), what they become; characters that become several, what they become."""
    one, to_one, many, to_many, none = [], [], [], [], []
    for code in range(0x80, 0x110000):
        if 0xD800 <= code < 0xE000 or _HANGUL <= code < _HANGUL + _SYLLABLES:
            continue
        c = chr(code)
        base = "".join(p for p in unicodedata.normalize("NFKD", c) if not unicodedata.combining(p))
        if base == c:
            continue
        if not base:
            none.append(c)
        elif len(base) == 1:
            one.append(c)
            to_one.append(base)
        else:
            many.append(c)
            to_many.append(base)
    return "".join(one + none), "".join(to_one), "".join(many), to_many


def _ranges(codes: list[int]) -> str:
    """A character class of the codes, for Java: halves within their bounds, so that
    a character is compared with a few ranges only."""
    starts = [a for i, a in enumerate(codes) if not i or codes[i - 1] != a - 1]
    ends = [a for i, a in enumerate(codes) if i + 1 == len(codes) or codes[i + 1] != a + 1]

    def of(pairs):
        bounds = rf"\x{{{pairs[0][0]:X}}}-\x{{{pairs[-1][1]:X}}}"
        if len(pairs) == 1:
            return f"[{bounds}]"
        half = len(pairs) // 2
        return f"[{bounds}&&[{of(pairs[:half])}{of(pairs[half:])}]]"

    return of(list(zip(starts, ends)))


@lru_cache(maxsize=1)
def _several() -> tuple[str, str, str]:
    """Characters that become several, Hangul syllables too, as a class; runs of all
    others; what the former become, but for Hangul, by the code's high and low bits."""
    many, to_many = accent_tables()[2:]
    codes = sorted({*map(ord, many), *range(_HANGUL, _HANGUL + _SYLLABLES)})
    others = sorted({*range(0x80, 0x110000)}.difference(codes))
    blocks: list[list | None] = [None] * ((max(map(ord, many)) >> 8) + 1)
    for c, base in zip(many, to_many):
        block = blocks[ord(c) >> 8] = blocks[ord(c) >> 8] or [None] * 256
        block[ord(c) & 255] = base
    return _ranges(codes), rf"[\x{{0}}-\x{{7F}}{_ranges(others)}]+", json.dumps(blocks)


def analyzed(c: Column) -> Column:
    """Lower-cased text without accents: decomposed, combining marks dropped.

    Texts of ASCII pass as they are, others are translated; only texts with a
    ligature, a Hangul syllable or another character that becomes several are
    taken apart at these.
    """
    src, dst, _, _ = accent_tables()
    several, others, known = _several()
    known = F.from_json(F.lit(known), "array<array<string>>")

    def letters(x):
        code = F.ascii(x)
        n = code - _HANGUL
        lead, vowel, trail = (F.split(F.lit(",".join(chr(k + i) if k + i != _TRAILING[0] else "" for i in range(size))), ",") for k, size in (_LEADING, _VOWELS, _TRAILING))
        per = _VOWELS[1] * _TRAILING[1]
        jamo = F.concat(F.get(lead, (n / per).cast("int")), F.get(vowel, (n % per / _TRAILING[1]).cast("int")), F.get(trail, (n % _TRAILING[1]).cast("int")))
        other = F.coalesce(F.get(F.get(known, F.shiftright(code, 8)), code % 256), x)
        return F.when(code < 0x80, x).when(n.between(0, _SYLLABLES - 1), jamo).otherwise(other)

    low = F.transform(F.array(c), F.lower)
    low = F.transform(low, lambda x: F.when(x.rlike(r"[^\x00-\x7F]"), F.translate(x, src, dst)).otherwise(x))
    runs = lambda x: F.regexp_extract_all(x, F.lit(f"{several}|{others}"), F.lit(0))
    low = F.transform(low, lambda x: F.when(x.rlike(several), F.array_join(F.transform(runs(x), letters), "")).otherwise(x))
    return F.get(low, F.lit(0))


def terms(c: Column) -> Column:
    """Word tokens of at least two characters of an analysed text."""
    return F.regexp_extract_all(c, F.lit(WORD + "{2,}"), F.lit(0))


def without(words: Column, stop: list[str]) -> Column:
    return F.filter(words, lambda w: ~w.isin(stop))


def word_ngrams(words: Column, n: int) -> Column:
    """All runs of ``n`` neighbouring words, joined with one space."""
    if n == 1:
        return words

    def run(word, i):
        return F.concat_ws(" ", word, *[F.get(words, i + k) for k in range(1, n)])

    # start positions without n - 1 followers are cut off first
    starts = F.slice(words, 1, F.greatest(F.size(words) - (n - 1), F.lit(0)))
    return F.transform(starts, run)
