"""Personal data by weak supervision, in DataFrame functions only.

Base patterns always count. Looser candidates are judged: a format labeler, a
gazetteer labeler and a context labeler vote for, against or not at all;
expectation-maximisation on the counts of vote patterns estimates their
reliabilities, and a logistic span classifier is trained on its posteriors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.llm.common import blank

#: Base kinds in listed order. Java patterns without nested backtracking: each is
#: started once per run of its first class, and inner repeats never give back.
#: Long repeats are taken in lots, so the matcher's stack stays small.
BASE: dict[str, str] = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:(?>(?:\.[A-Za-z0-9-]++){1,200}))++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:(?>(?:[\x20-]?+[0-9]){1,200}))++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Candidates that the classifier judges.
LOOSE: dict[str, str] = {
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "local_phone": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z.-]?[0-9])",
    "national_id": r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z.-]?[0-9])",
}
KINDS = [*BASE, *LOOSE]
LABELERS = ["format", "gazetteer", "context"]
#: Words that announce personal data of a kind, looked for just before it.
CUES: dict[str, str] = {
    "account": r"(?i)iban|account|konto|compte|cuenta|bank",
    "local_phone": r"(?i)phone|tel|call|fax|mobile|cell|contact|t[eé]l|rufen|llam",
    "national_id": r"(?i)ssn|social|security|tax|insured|national|id\b",
}
AGAINST = r"(?i)(?:order|invoice|ticket|version|part|isbn|serial|page|ref)\W*$"
#: Country codes of account numbers.
ACCOUNT_COUNTRIES = ["AT", "BE", "CH", "CZ", "DE", "DK", "ES", "FI", "FR", "GB", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "SE"]
LOOKBACK = 32


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Doubling every second digit from the right, the sum is a multiple of 10."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5)))
    return F.coalesce(F.aggregate(places, F.lit(0).cast("bigint"), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0, F.lit(False))


def _passes(kind: str, hit: Column) -> Column:
    """The base rule that a match of the pattern must also meet."""
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: p.cast("double") <= 255)
    if kind == "card":
        d = _digits(hit)
        return F.length(d).between(14, 19) & _luhn(d)
    if kind == "phone":
        return F.length(_digits(hit)).between(10, 15)
    return F.lit(True)


def _kept(kind: str, spans: Column) -> Column:
    return F.filter(spans, lambda s: _passes(kind, s["hit"]))


SPAN = "array<struct<start:int,rank:int,kind:string,stop:int,hit:string,before:string>>"


def _located(kind: str, hits: Column, gaps: Column) -> Column:
    """Spans of matches between gaps: text = gap, match, gap, ..., gap."""

    def step(acc: Column, i: Column) -> Column:
        hit, gap = F.get(hits, i), F.get(gaps, i)
        start = acc["at"] + F.length(gap)
        stop = start + F.length(hit)
        before = F.when(F.lit(kind in LOOSE), F.right(gap, F.lit(LOOKBACK))).otherwise(F.lit(""))
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), stop.alias("stop"), hit.alias("hit"), before.alias("before"))
        return F.struct(stop.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    none = F.array().cast(SPAN)
    walk = F.aggregate(F.sequence(F.lit(0), F.size(hits) - 1), F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])
    return F.when(F.size(hits) > 0, walk).otherwise(none)


#: A text without a match of this cannot hold the kind: cheap and linear.
GATES = {"email": "@", "phone": r"\+[0-9]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][0-9\x20-]{12}", "account": "[A-Z]{2}[0-9]{2}", "local_phone": r"[0-9]{3}[\x20.-][0-9]{4}", "national_id": "-[0-9]{2}-"}


def candidates(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (the kept columns, all by default), ``base`` and ``loose`` spans.

    Base spans have passed their rule. Loose candidates that overlap a base span
    are dropped. Offsets count code points.
    """
    text = blank(F.col(text_col))
    out = docs.select(F.struct(*(keep or ["*"])).alias("row"), text.alias("t"))
    none = F.array().cast("array<string>")
    for kind, pattern in (BASE | LOOSE).items():
        gate = F.contains("t", F.lit("@")) if kind == "email" else F.col("t").rlike(GATES[kind])
        out = out.withColumn(f"h_{kind}", F.when(gate, F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).otherwise(none))
    for kind, pattern in (BASE | LOOSE).items():
        hits = F.col(f"h_{kind}")
        out = out.withColumn(f"g_{kind}", F.when(F.size(hits) > 0, F.split("t", pattern, -1)).otherwise(none))
    found = {k: _located(k, F.col(f"h_{k}"), F.col(f"g_{k}")) for k in KINDS}
    base = F.concat(*[_kept(k, found[k]) for k in BASE])
    out = out.select("row", F.array_sort(base).alias("base"), F.array_sort(F.concat(*[found[k] for k in LOOSE])).alias("loose"))
    apart = F.filter("loose", lambda s: ~F.exists("base", lambda b: (s["start"] < b["stop"]) & (b["start"] < s["stop"])))
    return out.withColumn("loose", apart)


def votes(s: Column) -> dict[str, Column]:
    """What each labeler says of a loose candidate: 1, -1 or 0."""
    hit, kind, before = s["hit"], s["kind"], s["before"]
    d = _digits(hit)
    country = F.substring(hit, 1, 2).isin(ACCOUNT_COUNTRIES)
    area, group, last = F.substring(d, 1, 3), F.substring(d, 4, 2), F.substring(d, 6, 4)
    fmt = F.when(kind == "account", F.when(F.length(F.regexp_replace(hit, " ", "")).between(15, 34), 1).otherwise(-1))
    fmt = fmt.when(kind == "local_phone", F.when(d.rlike("^[2-9][0-9]{2}[2-9]"), 1).otherwise(-1))
    fmt = fmt.otherwise(F.when((area == "000") | (group == "00") | (last == "0000"), -1).otherwise(1))
    gaz = F.when(kind == "account", F.when(country, 1).otherwise(-1))
    gaz = gaz.when(kind == "local_phone", F.when(F.substring(d, 1, 3).rlike("^[2-9](?:00|11)$"), -1).otherwise(0))
    gaz = gaz.otherwise(F.when((area == "666") | (area >= "900"), -1).otherwise(0))
    cue = F.lit(False)
    for k, words in CUES.items():
        cue = cue | ((kind == k) & before.rlike(words))
    ctx = F.when(before.rlike(AGAINST), -1).when(cue, 1).otherwise(0)
    return dict(zip(LABELERS, (fmt, gaz, ctx), strict=True))


@dataclass(frozen=True)
class SpanClassifier:
    """accuracy of each labeler; weights of kind and vote in the classifier."""

    accuracy: dict[str, float]
    bias: float
    weights: dict[tuple[str, object], float]

    def probability(self, s: Column) -> Column:
        z = F.lit(self.bias)
        features = {"kind": s["kind"], **votes(s)}
        for (name, value), w in sorted(self.weights.items(), key=str):
            z = z + F.when(features[name] == F.lit(value), w).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


def estimate(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 60, trust: float = 0.8, strength: float = 20.0) -> SpanClassifier:
    """Labelers' accuracies by expectation-maximisation, then the classifier.

    ``patterns`` has (kind, votes, count). An accuracy is drawn to ``trust`` by
    ``strength`` votes and stays above one half. The classifier is a logistic
    regression on kind and votes, fitted to the posteriors of the patterns.
    """
    v = np.array([p[1] for p in patterns], dtype=int).reshape(-1, len(LABELERS))
    n = np.array([p[2] for p in patterns], float)
    acc, prior = np.full(len(LABELERS), trust), 0.5
    post = np.zeros(len(v))
    for _ in range(rounds):
        post = 1 / (1 + np.exp(-(np.log(prior / (1 - prior)) + v @ np.log(acc / (1 - acc)))))
        right = np.where(v == 1, post[:, None], np.where(v == -1, 1 - post[:, None], 0.0))
        acc = np.clip(((n[:, None] * right).sum(0) + trust * strength) / ((n[:, None] * (v != 0)).sum(0) + strength), 0.55, 0.99)
        prior = float(np.clip(((n * post).sum() + strength / 2) / (n.sum() + strength), 0.05, 0.95))
    names = [("kind", k) for k in LOOSE] + [(lab, x) for lab in LABELERS for x in (-1, 1)]
    x = np.array([[float(k == value) if f == "kind" else float(vs[LABELERS.index(f)] == value) for f, value in names] for k, vs, _ in patterns]).reshape(-1, len(names))
    w, bias = np.zeros(len(names)), 0.0
    for _ in range(3000 if len(v) else 0):
        err = n * (1 / (1 + np.exp(-(x @ w + bias))) - post) / n.sum()
        w -= 0.5 * (x.T @ err + 1e-4 * w)
        bias -= 0.5 * err.sum()
    return SpanClassifier(dict(zip(LABELERS, acc.tolist(), strict=True)), float(bias), dict(zip(names, w.tolist(), strict=True)))


def fit(docs: DataFrame, text_col: str = "text") -> SpanClassifier:
    """From all loose candidates of ``docs``; one row per kind and vote pattern,
    3 * 27 at most, reaches the driver."""
    s = F.col("s")
    each = candidates(docs, text_col, [text_col]).select(F.explode("loose").alias("s"))
    seen = each.select(s["kind"].alias("kind"), *[c.alias(n) for n, c in votes(s).items()]).groupBy("kind", *LABELERS).count().orderBy("kind", *LABELERS).collect()
    return estimate([(r.kind, tuple(r[n] for n in LABELERS), r["count"]) for r in seen])


def find(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, model: SpanClassifier | None = None, threshold: float = 0.5) -> DataFrame:
    """``row`` (the kept columns), ``base`` and ``spans``, for every row.

    ``spans`` holds the base spans and the candidates with probability
    ``threshold`` or more, by start, then kind as listed. A null text is empty
    and has none; texts of any length are searched whole. Repeated rows and null ids stay; extra columns may have any
    name; an empty table gives no rows.
    """
    model = model or fit(docs, text_col)
    out = candidates(docs, text_col, keep)
    more = F.filter("loose", lambda s: model.probability(s) >= threshold)
    return out.select("row", "base", F.array_sort(F.concat("base", more)).alias("spans"))


def masked(docs: DataFrame, text_col: str = "text", model: SpanClassifier | None = None) -> DataFrame:
    """``docs`` with every span of personal data replaced by its kind in angle
    brackets. Of spans that overlap the one that starts first is replaced, and
    what others reach beyond it goes too. Null texts stay null."""
    names = docs.columns
    found = find(docs, text_col, None, model)
    text = F.col(f"row.{text_col}")

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        tag = F.when(s["start"] >= acc["at"], F.concat(F.lit("<"), s["kind"], F.lit(">"))).otherwise("")
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.concat(acc["out"], F.array(gap, tag)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate("spans", start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    new = F.when(F.size("spans") > 0, done).otherwise(text)
    return found.select(*[(new if c == text_col else F.col("row")[c]).alias(c) for c in names])


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["stop"].cast("string"))), ",")
