"""Sentiment against a plain scorer, word tokens, accents of all scripts."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from mailsift.functions import sentiment as S
from mailsift.functions import text, words
from mailsift.operators import features, tfidf
from mailsift.sources import wordlists


def plain_scores(t, lexicon=S.VALENCE):
    """The published rules, one word after the other."""
    faces = set(S.emoticons_of(lexicon))
    words = [w if w.lower() in faces else w.strip(".!?,;:'\"-") for w in t.split()]
    words = [w for w in words if len(w) > 1]
    low = [w.lower() for w in words]
    upper = [w.isupper() for w in words]
    caps = 0 < sum(upper) < len(words)

    def negated(w):
        return w in S.NEGATIONS or "n't" in w

    values = []
    for i, w in enumerate(low):
        if w not in lexicon or w in S.BOOSTERS_UP + S.BOOSTERS_DOWN or (w == "kind" and low[i + 1 : i + 2] == ["of"]):
            continue
        v = lexicon[w]
        v += (S.CAPS if v > 0 else -S.CAPS) if caps and upper[i] else 0
        for d in (1, 2, 3):
            if i < d or low[i - d] in lexicon:
                continue
            p, b = low[i - d], 0.0
            if p in S.BOOSTERS_UP or p in S.BOOSTERS_DOWN:
                b = S.BOOST if p in S.BOOSTERS_UP else -S.BOOST
                b = -b if v < 0 else b
                b += (S.CAPS if v > 0 else -S.CAPS) if caps and upper[i - d] else 0
            v += b * S.DAMP[d - 1]
            so = ("so", "this")
            if d == 2 and p == "never" and low[i - 1] in so:
                v *= 1.5
            elif d == 3 and ((p == "never" and low[i - 2] in so) or low[i - 1] in so):
                v *= 1.25
            elif negated(p):
                v *= S.NEGATE
            if d == 3:
                for a, z in ((i - 1, i), (i - 2, i), (i - 2, i - 1), (i - 3, i - 1), (i - 3, i - 2)):
                    if (k := " ".join(low[a : z + 1])) in S.IDIOMS:
                        v = S.IDIOMS[k]
                        break
                for z in (i + 1, i + 2):
                    if z < len(low) and (k := " ".join(low[i : z + 1])) in S.IDIOMS:
                        v = S.IDIOMS[k]
                if any(" ".join(low[a : a + 2]) in S.DAMPERS for a in (i - 3, i - 2)):
                    v -= S.BOOST
        if i > 0 and low[i - 1] == "least" and not (i > 1 and low[i - 2] in ("at", "very")):
            v *= S.NEGATE
        if "but" in low and i != low.index("but"):
            v *= 0.5 if i < low.index("but") else 1.5
        values.append(v)
    q = t.count("?")
    e = min(t.count("!"), 4) * 0.292 + (0 if q < 2 else q * 0.18 if q < 4 else 0.96)
    s = round(sum(values), 9)
    s += e if s > 0 else -e if s < 0 else 0
    pos, neg = sum(v + 1 for v in values if v > 0), sum(v - 1 for v in values if v < 0)
    neu = len(words) - sum(v != 0 for v in values)
    pos, neg = pos + (e if pos > abs(neg) else 0), neg - (e if pos < abs(neg) else 0)
    total = pos + abs(neg) + neu
    shares = [abs(neg), neu, pos]
    return [s / (s * s + 15) ** 0.5, *[x / total if total else 0 for x in shares]]


def test_sentiment_equals_the_plain_scorer(spark):
    rng = random.Random(5)
    words = ["good", "BAD", "the", "shit", "bomb", "ass", "yeah", "right", "cut", "mustard", "kiss", "of", "death", "kind", "sort", "just", "enough", "never", "so", "this", "least", "at", "very", "VERY"]
    words += ["not", "isn't", "but", "barely", "plain", "word", "x", "great!", "sad?", ":)", ":-(", ":D", "win,", "'good'", "NOT", "really", "hope."]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 12))) for _ in range(1500)]
    texts += ["the service was kind of good", "it is truly never so good", "that was the worst kiss of death", "you are at least good", "you are least good", "well yeah right good", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(4)
    for r in S.with_sentiment(rows, "text").collect():
        got = [r.sentiment_compound, r.sentiment_neg, r.sentiment_neu, r.sentiment_pos]
        assert got == pytest.approx(plain_scores(texts[r.i] or ""), abs=6e-4), texts[r.i]




def test_lexicon_files(spark, tmp_path):
    (tmp_path / "lex.txt").write_text("Good\t1.9\t0.9\t[1, 2]\n:)\t2.0\t1\t[]\nbroken\ngood\t2.5\t1\t[]\nbad\tx\t1\n")
    assert wordlists.read_lexicon(spark, str(tmp_path / "lex.txt")) == {"good": 2.5, ":)": 2.0}
    with pytest.raises(ValueError):
        wordlists.read_lexicon(spark, str(tmp_path / "lex.txt"), most=1)
    (tmp_path / "stop.txt").write_text("The\nof \n\nthe\n")
    assert wordlists.read_words(spark, str(tmp_path / "stop.txt")) == ["of", "the"]
    df = spark.createDataFrame([(1, "The list of words")], "msg_id int, text string")
    assert tfidf.with_words(df, "text", wordlists.read_words(spark, str(tmp_path / "stop.txt"))).first()._words == ["list", "words"]


GOLDEN = {
    "Good muffins cost $3.88 in New York.  Please buy me two of them.": "Good muffins cost $ 3.88 in New York . Please buy me two of them .",
    "They'll save and invest more.": "They 'll save and invest more .",
    "hi, my name can't hello,": "hi , my name ca n't hello ,",
    "I cannot say. We've gonna (try) it--now...": "I can not say . We 've gon na ( try ) it -- now ...",
    'He said "stop" [twice]; why?': "He said `` stop '' [ twice ] ; why ?",
    "At 10:30, 1,000 of J. Smith's U.S. friends": "At 10:30 , 1,000 of J. Smith 's U.S. friends",
    "": "",
    "dogs' it's he's": "dogs ' it 's he 's",
    "«é» ok.\n": "«é» ok .",
}


def test_tokens(spark):
    rows = spark.createDataFrame(list(GOLDEN), "string").select("value", F.array_join(text.treebank_tokens(F.col("value")), " ").alias("t"))
    assert {r.value: r.t for r in rows.collect()} == GOLDEN


def test_complexity_by_tokenizer(spark):
    df = spark.createDataFrame([(1, "The cat isn't the cat."), (2, ""), (3, "12 34 !"), (4, None)], "msg_id int, text string")
    got = {r.msg_id: (r.avg_word_length, r.unique_words_ratio) for r in features.text_complexity(df).collect()}
    # The cat is n't the cat .
    assert got[1] == pytest.approx((14 / 5, 6 / 7)) and got[2] == (0, 0) and got[3] == (0, 1.0)
    space = {r.msg_id: (r.avg_word_length, r.unique_words_ratio) for r in features.text_complexity(df, tokenizer="space").collect()}
    assert space[1] == (3.0, 1.0)


def stripped(s):
    return "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(c))


def test_accents_of_all_scripts(spark):
    texts = ["ÉÀß é", "Άθήνα ώς ΐ", "ёЙ їЇ", "ﬁn ﬀ ﬆ ½ Ⅷ ㎏ ﷺ", "한국어 각 가", "ệ ộ ǚ", "plain", "", "½한ﬁé", "á̧b", "𝐀𝟗 ｆｕｌｌ", "ガ が"]
    rng = random.Random(2)
    every = [chr(c) for c in range(0x80, 0x30000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    texts += ["".join(rng.choices(every, k=40)) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    got = {r.i: r.a for r in rows.select("i", text.analyzed(F.col("t")).alias("a")).collect()}
    wrong = [(t, got[k]) for k, t in enumerate(texts) if got[k] != stripped(t)]
    assert len(wrong) <= 8, wrong[:3]
    assert not [w for w in wrong if w[0] in texts[:12]]


def test_full_stops_are_found_from_the_stop(spark):
    """The quick pattern gives what the rule shared with SQL gives."""
    pieces = ["ab.", "a.", "U.S.", "a..", "x\U0001F600.", "\U0001F600\U0001F601.", "é́.", ".", "..ab.", "ab.c", "ab.\n", "ab.\u2028", "ab. .cd.", "a b.", "(ab).", ""]
    texts = [a + sep + b for a in pieces for b in pieces for sep in ("", " ", "\r\n", "\u3000")] + [None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    c = F.col("t")
    got = df.select("t", text.full_stops(c).alias("a"), text._replaced(c, text.PUNCTUATION[-1:]).alias("b")).collect()
    assert len(got) == len(texts) and [r.a for r in got] == [r.b for r in got]
    assert sum(r.a != r.t for r in got if r.t) > 100


def test_characters_that_become_several_are_found_within_bounds(spark):
    several, others, _ = text._several()
    chars = [("a\u00bd", True), ("\ufb06", True), ("\ud55c", True), ("a\u03b1\u0438", False), ("\U0001f600", False), ("", False)]
    df = spark.createDataFrame([(c,) for c, _ in chars], "t string")
    got = df.select(F.col("t").rlike(several), F.col("t").rlike(f"^(?:{others})?$"), text.analyzed(F.col("t"))).collect()
    assert [(r[0], r[1]) for r in got] == [(found, not found) for _, found in chars]
    assert got[0][2] == "a1\u20442" and got[1][2] == "st" and got[2][2] == "\u1112\u1161\u11ab"


def test_tokens_counted_by_word_are_those_of_the_whole_text(spark):
    """Among them joined words side by side, of which the rules part every other one."""
    marks = ["cannot", "Cannot", "gimme", "can't", "it's", "'s", "dogs'", '"ab', 'ab"', "(\"x", "ab.", "a.", "U.S.", "...", "x--y", "a,b", "1,000", ",,5", ":", "a:b;", "$5%", "caf\u00e9", "\u0661,\u0662", "x\U0001F600.", "\U0001F600", "[gonna]", "wanna,wanna", "'", "''", "word"]
    rng = random.Random(4)
    texts = ["".join(x + rng.choice([" ", "  ", "\n", "\u3000", "\x1f", "\r\n"]) for x in rng.choices(marks, k=rng.randint(0, 9))) for _ in range(1500)]
    texts += ["cannot cannot", "cannot  cannot", "gimme gimme gimme", "cannot gimme", "", " ", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(4)
    tokens = F.col("tokens")
    want = {r.i: r[1:] for r in df.select("i", text.treebank_tokens(F.col("text")).alias("tokens")).select("i", F.coalesce(text.alpha_word_length(tokens), F.lit(0.0)), text.unique_ratio(tokens), F.coalesce(F.size(tokens), F.lit(0))).collect()}
    counts = {r.i: r.n for r in df.select("i", words.treebank_counts(F.col("text")).alias("n")).collect()}
    got = {r.i: (r.avg_word_length, r.unique_words_ratio, counts[r.i].tokens) for r in features.text_complexity(df).collect()}
    assert got == want
    assert [counts[i].tokens for i, t in enumerate(texts) if t in ("cannot cannot", "cannot  cannot", "gimme gimme gimme")][-3:] == [3, 4, 5]


def test_features_make_no_tokens_of_the_whole_text(spark):
    """The rules ran over every text as patterns, which took most of the time."""
    df = spark.createDataFrame([(1, "a@b.c", "a@b.c", "One", "two")], "msg_id int, `from` string, reply_to string, subject string, body string")
    plan = features.numeric_features(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "lL" not in plan and plan.count("_counted(") == 1
