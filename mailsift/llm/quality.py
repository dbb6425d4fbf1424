"""Quality by weak supervision.

Rules vote good (1), bad (-1) or abstain (0). A document is good, or bad in the
way that one of the rules looks for. Expectation-maximisation on the counts of
vote patterns estimates how often each rule votes each way on each of these; a
document is kept if the posterior probability of good says so.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


SYMBOLS = b"#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended", "n_capital", "n_lower", "n_distinct", "n_loud"]


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words inside windows that occur twice or more, the first included."""
    if len(words) <= window:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    place = ids[: len(ids) - window + 1]
    for k in range(1, window):
        # pairs of ranks stay below len(words) ** 2, whatever the window
        place = np.unique(place, return_inverse=True)[1] * len(number) + ids[k : len(ids) - window + 1 + k]
    _, back, count = np.unique(place, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(count[back] > 1)
    hit = np.zeros(len(ids) + 1, np.int64)
    np.add.at(hit, twice, 1)
    np.add.at(hit, twice + window, -1)
    return int((np.cumsum(hit)[:-1] > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The values of MEASURES for one text; all zero for a null text."""
    if not text:
        return (0,) * len(MEASURES)
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    upper, lower = (sum(map(raw.count, letters)) for letters in (_UPPER, _LOWER))
    return (
        len(words),
        len(text) - sum(map(text.count, " \t\n\x0b\x0c\r")),
        sum(map(raw.count, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        sum(x.rstrip()[-1:] in b".!?:;\"'" for x in lines),
        upper,
        lower,
        len(set(words)),
        raw.count(b"!"),
    )


_UPPER, _LOWER, _SYMBOLS = ([bytes([c]) for c in s] for s in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", SYMBOLS))


def measures(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns in ``row`` (all by default) and MEASURES as longs."""

    def work(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(t) for t in texts], columns=MEASURES)

    udf = F.pandas_udf(work, ", ".join(f"{m} bigint" for m in MEASURES))
    rows = docs.select(F.struct(*(keep or ["*"])).alias("row"), udf(F.col(text_col)).alias("m"))
    return rows.select("row", *[F.col(f"m.{m}").alias(m) for m in MEASURES])


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def _defect(applies: Column, bad: Column) -> Column:
    return F.when(applies & bad, -1).otherwise(0)


def rules() -> dict[str, Column]:
    """One vote per rule. Rules that look for a defect say bad or abstain: a
    text without this defect may have another. The first three also say good."""
    words, c = F.col("n_words"), F.col
    letters = c("n_capital") + c("n_lower")
    return {
        "length": _vote(words.between(50, 100_000), words < 20),
        "word_length": F.when(words >= 20, _vote(c("word_chars").between(3 * words, 12 * words), ~c("word_chars").between(2 * words, 20 * words))).otherwise(0),
        "endings": F.when(c("n_lines") >= 1, _vote(2 * c("n_ended") >= c("n_lines"), 10 * c("n_ended") < c("n_lines"))).otherwise(0),
        "symbols": _defect(words >= 20, 10 * c("n_symbols") > words),
        "same_lines": _defect(c("n_lines") >= 4, 3 * c("n_dup_lines") > c("n_lines")),
        "same_words": _defect(words >= 20, 3 * c("n_repeat_words") > words),
        "capitals": _defect(letters >= 100, 2 * c("n_capital") > letters),
        "variety": _defect(words.between(50, 2000), 8 * c("n_distinct") < words),
        "loudness": _defect(words >= 20, 5 * c("n_loud") > words),
    }


@dataclass(frozen=True)
class Reliability:
    """good: posterior of each vote pattern. shares: good first, then bad by
    rule. chances[class, rule, vote + 1]. accuracy: right votes among votes."""

    good: np.ndarray
    shares: np.ndarray
    chances: np.ndarray
    accuracy: dict[str, float]


def estimate(votes: np.ndarray, counts: np.ndarray, names: list[str], rounds: int = 60, smooth: float = 0.1) -> Reliability:
    """Expectation-maximisation over distinct vote patterns.

    Starts from "good if no rule says bad, else bad in the ways that rules say".
    Kinds of bad documents seldom come together, so one class for all of them
    would take the commonest kind for good; each has a class of its own.
    """
    n, weight = len(names), counts.astype(float)
    bad = (votes == -1).astype(float)
    none = bad.sum(1) == 0
    q = np.column_stack([none * 0.98, bad * 0.98]) + 0.02 / (n + 1)
    q /= q.sum(1, keepdims=True)
    shares, chances = np.full(n + 1, 1 / (n + 1)), np.full((n + 1, n, 3), 1 / 3)
    for _ in range(rounds if len(votes) else 0):
        w = weight[:, None] * q
        shares = (w.sum(0) + smooth) / (w.sum() + smooth * (n + 1))
        said = np.stack([w.T @ (votes == v) + smooth for v in (-1, 0, 1)], axis=2)
        chances = said / said.sum(2, keepdims=True)
        fit = np.log(shares) + np.log(chances)[:, np.arange(n), votes + 1].sum(2).T
        new = np.exp(fit - fit.max(1, keepdims=True))
        new /= new.sum(1, keepdims=True)
        done = np.abs(new - q).max() < 1e-10
        q = new
        if done:
            break
    good = q[:, 0] if len(votes) else np.zeros(0)
    cast = [(weight * (votes[:, j] != 0)).sum() for j in range(n)] if len(votes) else [0.0] * n
    right = [(weight * np.where(votes[:, j] == 1, good, np.where(votes[:, j] == -1, 1 - good, 0.0))).sum() if c else 0.0 for j, c in enumerate(cast)]
    return Reliability(good, shares, chances, {m: float(r / c) if c else 0.0 for m, r, c in zip(names, right, cast, strict=True)})


def judge(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """``row``, MEASURES, the votes by rule, posterior, base_failed and kept.

    base_failed: fewer than 50 words, or over half of them in repeated 3-word
    windows. kept: not base_failed and a posterior of ``threshold`` or more. At
    most 3 ** rules patterns reach the driver. Null and empty texts measure zero
    and fail the base rule; texts of any length are measured whole; a posterior that
    equals ``threshold`` is kept. Repeated rows and null ids stay; extra columns may
    have any name; an empty table gives no rows.
    """
    names = list(rules())
    voted = measures(docs, text_col, keep).select("*", *[v.cast("int").alias(n) for n, v in rules().items()])
    thin = measures(docs, text_col, [text_col]).select(*[v.cast("int").alias(n) for n, v in rules().items()])
    patterns = thin.groupBy(*names).count().orderBy(*names).collect()
    found = estimate(np.array([[r[n] for n in names] for r in patterns], dtype=int).reshape(-1, len(names)), np.array([r["count"] for r in patterns]), names)
    table = [(*[r[n] for n in names], float(g)) for r, g in zip(patterns, found.good, strict=True)]
    posterior = F.broadcast(docs.sparkSession.createDataFrame(table, ", ".join(f"{n} int" for n in names) + ", posterior double"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return voted.join(posterior, names).withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("posterior") >= threshold))
