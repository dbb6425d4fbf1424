"""Rule-based sentiment in the style of VADER (Hutto & Gilbert, 2014).

Applied rules: valence of words and emoticons, capitals for emphasis, boosters
and negations among the three preceding words, "never so", "least", idioms and
boosters of several words, the "but" shift, and exclamation or question marks.
The valence table is a small one of our own; read a complete one with
``mailsift.sources.wordlists.read_lexicon`` and pass it as ``lexicon``.

Everything is computed inside the row on the word array, so scoring needs no
shuffle. Membership tests use a hash set; the valence map is nested by first
letter and is consulted for the few words that are members.
"""

from __future__ import annotations

import json
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.functions.text import WS, constant_strings, sql_list

# --- fixed values: published constants of the rule set ---------------------------
BOOST = 0.293
CAPS = 0.733
NEGATE = -0.74
DAMP = [1.0, 0.95, 0.9]
ALPHA = 15
BEFORE_BUT = 0.5
AFTER_BUT = 1.5
EXCLAMATION = 0.292
QUESTION = 0.18
MANY_QUESTIONS = 0.96
NEVER_SO = [1.5, 1.25]
IDIOMS = {
    "the shit": 3.0, "the bomb": 3.0, "bad ass": 1.5, "yeah right": -2.0, "cut the mustard": 2.0,
    "kiss of death": -1.5, "hand to mouth": -2.0,
}
DAMPERS = ["just enough", "kind of", "sort of"]
# ----------------------------------------------------------------------------------

VALENCE = {
    ":)": 2.0, ":-)": 1.3, ":d": 2.3, ";)": 0.9, "<3": 1.9, ":(": -1.9, ":-(": -1.5, ":'(": -2.2, ":/": -1.4,
    "amazing": 2.8, "awesome": 3.1, "best": 3.2, "better": 1.9, "calm": 1.3,
    "careful": 0.6, "confident": 2.2, "delighted": 2.3, "easy": 1.9,
    "enjoy": 2.2, "excellent": 2.7, "fair": 1.3, "fine": 0.8, "free": 2.3,
    "friendly": 2.2, "glad": 2.0, "good": 1.9, "grateful": 2.0, "great": 3.1,
    "happy": 2.7, "help": 1.7, "helpful": 1.8, "honest": 2.3, "hope": 1.9,
    "kind": 2.4, "kiss": 1.8, "like": 1.5, "love": 3.2, "nice": 1.8, "perfect": 2.7, "pleased": 1.9,
    "profit": 1.9, "prize": 2.3, "protect": 1.6, "reward": 2.7, "safe": 1.9,
    "secure": 1.4, "smart": 1.7, "success": 2.7, "support": 1.7, "thank": 1.5,
    "thanks": 1.9, "trust": 2.3, "useful": 1.9, "welcome": 2.0, "win": 2.8,
    "winner": 2.8, "wonderful": 2.7, "yeah": 1.2,
    "abuse": -3.2, "afraid": -2.0, "alert": -0.4, "angry": -2.3, "ass": -2.5, "attack": -2.1,
    "awful": -2.0, "bad": -2.5, "banned": -2.0, "blame": -1.4, "blocked": -1.1, "bomb": -2.2,
    "broken": -2.1, "cancel": -1.0, "cheat": -2.0, "complain": -1.5,
    "crime": -2.5, "critical": -1.3, "cut": -1.1, "damage": -2.2, "danger": -2.4,
    "dangerous": -2.1, "dead": -3.3, "death": -2.9, "debt": -1.5, "delay": -1.3, "deny": -1.4,
    "error": -1.7, "fail": -2.5, "failed": -2.3, "failure": -2.3, "fake": -2.1,
    "fear": -2.2, "fraud": -2.8, "hate": -2.7, "hurt": -2.4, "illegal": -2.6,
    "kill": -3.7, "lose": -1.6, "loss": -1.3, "lost": -1.3, "miss": -0.6,
    "pain": -2.3, "penalty": -2.0, "poor": -2.1, "problem": -1.7,
    "reject": -1.7, "risk": -1.1, "sad": -2.1, "scam": -2.7, "scared": -1.9, "shit": -2.6,
    "sorry": -0.3, "steal": -2.2, "stop": -1.2, "stolen": -2.2, "suspect": -1.2,
    "terrible": -2.1, "threat": -2.4, "trouble": -1.7, "ugly": -2.3,
    "unfair": -2.1, "upset": -1.6, "urgent": 0.8, "victim": -1.1, "virus": -2.0,
    "warn": -0.4, "warning": -1.4, "worried": -1.2, "worse": -2.1, "worst": -3.1,
    "wrong": -2.1,
}
# --- fixed values: words that strengthen, weaken or turn the next ones --------------
BOOSTERS_UP = [
    "absolutely", "amazingly", "awfully", "completely", "considerably", "decidedly", "deeply",
    "enormously", "entirely", "especially", "exceptionally", "extremely", "fabulously", "flipping",
    "fully", "greatly", "hella", "highly", "hugely", "incredibly", "intensely", "majorly", "more",
    "most", "particularly", "purely", "quite", "really", "remarkably", "so", "substantially",
    "thoroughly", "totally", "tremendously", "uber", "unbelievably", "unusually", "utterly", "very",
]
BOOSTERS_DOWN = [
    "almost", "barely", "hardly", "kinda", "kindof", "kind-of", "less", "little", "marginally",
    "occasionally", "partly", "scarcely", "slightly", "somewhat", "sorta", "sortof", "sort-of",
]
NEGATIONS = [
    "aint", "arent", "cannot", "cant", "couldnt", "darent", "despite", "didnt", "doesnt", "dont",
    "hadnt", "hasnt", "havent", "isnt", "mightnt", "mustnt", "neednt", "neither", "never", "none",
    "nope", "nor", "not", "nothing", "nowhere", "oughtnt", "rarely", "seldom", "shant", "shouldnt",
    "uh-uh", "uhuh", "wasnt", "werent", "without", "wont", "wouldnt",
]
# ----------------------------------------------------------------------------------

EDGE = """.!?,;:'"-"""
PUNCT = f"[{EDGE}]"


def emoticons_of(lexicon: dict[str, float]) -> list[str]:
    """Entries that begin or end with edge punctuation, which other words lose."""
    return [w for w in lexicon if w[0] in EDGE or w[-1] in EDGE]


def sentiment_words(c: Column, emoticons: list[str] = ()) -> Column:
    """Words without edge punctuation, single characters dropped; emoticons stay
    whole. Only texts that contain one are looked at word by word."""
    inner = F.btrim(c, F.lit(EDGE))
    words = F.filter(F.split(inner, f"{PUNCT}*{WS}+{PUNCT}*"), lambda w: F.length(w) > 1)
    if not emoticons:
        return words
    whole = F.transform(F.split(c, f"{WS}+"), lambda w: F.when(F.lower(w).isin(list(emoticons)), w).otherwise(F.btrim(w, F.lit(EDGE))))
    low, some = F.lower(c), F.lit(False)
    for e in emoticons:
        some = some | low.contains(e)
    return F.when(some, F.filter(whole, lambda w: F.length(w) > 1)).otherwise(words)


def _valence_map(lexicon: dict[str, float]) -> Column:
    """A constant map nested by first letter."""
    nested = defaultdict(dict)
    for word, value in lexicon.items():
        nested[word[:1]][word] = float(value)
    return F.from_json(F.lit(json.dumps(nested)), "map<string,map<string,double>>")


def _published(c: Column, digits: int) -> Column:
    """Half-even rounding; the first rounding removes noise of the summation."""
    return F.bround(F.round(c, 9), digits)


def _is_upper(word: Column) -> Column:
    return word.rlike(r"\p{Lu}") & ~word.rlike(r"\p{Ll}")


def _opens(words: Column, i: Column, phrases: list[str]) -> Column:
    """Whether a phrase of two words begins at place i (from 0)."""
    found = F.lit(False)
    for first, second in (p.split(" ") for p in phrases):
        found = found | ((F.get(words, i) == first) & F.coalesce(F.get(words, i + 1) == second, F.lit(False)))
    return found


def with_sentiment(
    df: DataFrame,
    text: str,
    lexicon: dict[str, float] | None = None,
    names: tuple[str, str, str, str] = (
        "sentiment_compound", "sentiment_neg", "sentiment_neu", "sentiment_pos",
    ),
    boosters_up: list[str] = BOOSTERS_UP,
    boosters_down: list[str] = BOOSTERS_DOWN,
    negations: list[str] = NEGATIONS,
    pivot: str = "but",
    idioms: dict[str, float] = IDIOMS,
    dampers: list[str] = DAMPERS,
    never: tuple[str, tuple[str, ...]] = ("never", ("so", "this")),
    least: tuple[str, tuple[str, ...]] = ("least", ("at", "very")),
) -> DataFrame:
    """Append compound, negative, neutral and positive scores of ``text``.

    ``idioms`` are runs of two or three words that take the place of the valence
    of a word within them; they and the ``dampers`` of two words are looked at
    where three words precede and the third is not in the lexicon. ``never``
    before one of its words strengthens, ``least`` turns unless one of its words
    comes before; the first word of a damper has no valence before the second.

    Rounded like the published scorer: four decimals for compound, three else.
    """
    lexicon = VALENCE if lexicon is None else lexicon
    valence = _valence_map(lexicon)
    keep = df.columns

    df = df.withColumn("_w", sentiment_words(F.coalesce(F.col(text), F.lit("")), emoticons_of(lexicon)))
    df = df.withColumn("_l", F.transform("_w", F.lower))
    w, l, n = F.col("_w"), F.col("_l"), F.size("_w")
    df = df.withColumn("_known", F.expr(f"transform(_l, t -> t IN {sql_list(list(lexicon))})"))
    known, boosters = F.col("_known"), constant_strings([*boosters_up, *boosters_down])
    df = df.withColumn(
        "_hits",
        F.filter(
            F.transform(known, lambda k, i: F.when(k & ~F.array_contains(boosters, F.get(l, i)) & ~_opens(l, i, dampers), i + 1)),
            lambda i: i.isNotNull(),
        ),
    )
    # Capitals, "but" and emphasis matter only when some word has a valence.
    hits = F.col("_hits")
    capitals = F.size(F.filter(w, lambda t, i: (t != F.get(l, i)) & _is_upper(t)))
    df = df.withColumn(
        "_caps", (F.size(hits) > 0) & (capitals > 0) & (capitals < n)
    ).withColumn("_but", F.array_position(l, pivot))
    caps, but = F.col("_caps"), F.col("_but")

    def emphasised(value, word):
        return F.when(caps & _is_upper(word), F.when(value > 0, CAPS).otherwise(-CAPS)).otherwise(0.0)

    def one_step(value, d, i):
        at = i - d
        prev, prev_raw = F.get(l, at - 1), F.get(w, at - 1)
        sign = F.when(value < 0, -1.0).otherwise(1.0)
        scale = F.when(prev.isin(boosters_up), BOOST).when(prev.isin(boosters_down), -BOOST)
        damp = F.when(d == 1, DAMP[0]).when(d == 2, DAMP[1]).otherwise(DAMP[2])
        boost = F.coalesce((scale * sign + emphasised(value, prev_raw)) * damp, F.lit(0.0))
        negated = prev.isin(negations) | prev.contains("n't")
        near, nearer = (F.get(l, at + k).isin(list(never[1])) for k in (0, 1))
        # "never so": the word may stand between, or right before where two do
        strong = F.when((d == 2) & (prev == never[0]) & near, NEVER_SO[0]).when((d == 3) & (((prev == never[0]) & near) | nearer), NEVER_SO[1])
        turned = F.coalesce(strong, F.when(negated, NEGATE).otherwise(F.lit(1.0)))
        applies = (at >= 1) & ~F.get(known, at - 1)
        return F.when(applies, (value + boost) * turned).otherwise(value)

    def run(i, first, last):
        """The words from place i + first to i + last, null beyond the edges."""
        words = [F.when(i + k >= 1, F.get(l, F.greatest(i + k - 1, F.lit(0)))) for k in range(first, last + 1)]
        whole = words[0].isNotNull()
        for x in words[1:]:
            whole = whole & x.isNotNull()
        return F.when(whole, F.concat_ws(" ", *words))

    def in_idioms(value, i):
        if not idioms and not dampers:
            return value
        of = F.create_map(*[F.lit(x) for kv in idioms.items() for x in (kv[0], float(kv[1]))]) if idioms else None
        if of is not None:
            before = F.coalesce(*[F.element_at(of, run(i, a, b)) for a, b in ((-1, 0), (-2, 0), (-2, -1), (-3, -1), (-3, -2))])
            value = F.coalesce(*[F.element_at(of, run(i, 0, b)) for b in (2, 1)], before, value)
        weak = F.coalesce(run(i, -3, -2).isin(dampers) | run(i, -2, -1).isin(dampers), F.lit(False)) if dampers else F.lit(False)
        value = F.when(weak, value - BOOST).otherwise(value)
        return value

    def word_valence(i):
        word = F.get(l, i - 1)
        base = F.element_at(F.element_at(valence, F.substring(word, 1, 1)), word)
        start = base + emphasised(base, F.get(w, i - 1))
        steps = F.array(F.lit(1), F.lit(2), F.lit(3))
        value = F.aggregate(steps, start, lambda acc, d: one_step(acc, d, i))
        third = (i >= 4) & ~F.get(known, F.greatest(i - 4, F.lit(0)))
        value = F.when(third, in_idioms(value, i)).otherwise(value)
        weakest = (i >= 2) & (F.get(l, F.greatest(i - 2, F.lit(0))) == least[0]) & ~F.get(known, F.greatest(i - 2, F.lit(0)))
        spared = (i >= 3) & F.get(l, F.greatest(i - 3, F.lit(0))).isin(list(least[1]))
        value = F.when(weakest & ~spared, value * NEGATE).otherwise(value)
        shift = (
            F.when(but == 0, 1.0).when(i < but, BEFORE_BUT).when(i > but, AFTER_BUT).otherwise(1.0)
        )
        return value * shift

    df = df.withColumn("_v", F.transform(hits, word_valence))
    v = F.col("_v")
    zero = F.lit(0.0)
    exclaims = F.least(F.regexp_count(F.col(text), F.lit("!")), F.lit(4)) * EXCLAMATION
    q = F.regexp_count(F.col(text), F.lit(r"\?"))
    questions = F.when(q <= 1, 0.0).when(q <= 3, q * QUESTION).otherwise(MANY_QUESTIONS)
    df = df.select(
        *keep,
        n.alias("_n"),
        F.coalesce(exclaims + questions, zero).alias("_e"),
        F.aggregate(v, zero, lambda a, x: a + x).alias("_s"),
        F.aggregate(v, zero, lambda a, x: a + F.when(x > 0, x + 1).otherwise(0.0)).alias("_p"),
        F.aggregate(v, zero, lambda a, x: a + F.when(x < 0, x - 1).otherwise(0.0)).alias("_q"),
        F.size(F.filter(v, lambda x: x != 0)).alias("_k"),
    )
    s, e, p, neg = F.col("_s"), F.col("_e"), F.col("_p"), F.col("_q")
    total_s = s + F.when(s > 0, e).when(s < 0, -e).otherwise(0.0)
    pos = p + F.when(p > F.abs(neg), e).otherwise(0.0)
    neg = F.abs(neg - F.when(F.col("_p") < F.abs(neg), e).otherwise(0.0))
    neu = F.col("_n") - F.col("_k")
    total = pos + neg + neu
    # A text without words scores zero everywhere.
    compound, neg_name, neu_name, pos_name = names

    def share(x):
        return F.when(total > 0, _published(x / total, 3)).otherwise(zero)

    return df.select(
        *keep,
        _published(total_s / F.sqrt(total_s * total_s + ALPHA), 4).alias(compound),
        share(neg).alias(neg_name),
        share(neu).alias(neu_name),
        share(pos).alias(pos_name),
    )
