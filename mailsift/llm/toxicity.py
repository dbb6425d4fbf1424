"""Toxicity by a factorisation machine over hashed terms.

Terms are words and word beginnings, hashed into a fixed table; a text is the
set of its terms. The machine adds a weight for each term and a learned
interaction for each pair of terms.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsift.llm.common import frames, id_remainder, lower_words_of, to_tasks

#: Size of the hashed term table, and factors of a term.
BUCKETS = 1 << 18
FACTORS = 4
#: Labelled rows the machine is fitted on at most, those of smallest hash.
FIT_ROWS = 12_000
#: Terms of so many fitted rows take part, whether or not they tell by themselves.
LEAST_DOCS = 5
#: How much more strongly terms are held back that do not tell by themselves.
HOLD = 30
#: Texts scored at once; bounds the arrays of a task.
_BATCH = 1000
#: Lengths in bytes of the word beginnings that count as terms.
STEMS = (4, 5, 6)
_XX = xxhash.xxh64_intdigest


def terms_of_word(word: bytes) -> tuple[int, ...]:
    """The word itself and its beginnings; surrounding punctuation is ignored."""
    w = word.strip(b".,;:!?\"'()[]{}<>*_-")
    if not w:
        return ()
    parts = [_XX(w, 1) % BUCKETS]
    parts += [_XX(w[:k], k) % BUCKETS for k in STEMS if len(w) > k]
    return tuple(parts)


def terms(text: str | None, cache: dict[bytes, tuple[int, ...]], wanted: np.ndarray | None = None) -> np.ndarray:
    """Sorted distinct terms of a text; only those marked in ``wanted``."""
    out: set[int] = set()
    for w in set(lower_words_of(text)):
        t = cache.get(w)
        if t is None:
            if len(cache) > 500_000:
                cache.clear()
            t = terms_of_word(w)
            if wanted is not None:
                t = tuple(k for k in t if wanted[k])
            cache[w] = t
        out.update(t)
    return np.fromiter(sorted(out), np.int64, len(out))


@dataclass
class Machine:
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def logits(self, idx: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Scores of texts whose terms lie in idx[starts[i]:starts[i + 1]]."""
        return _logits(self.bias, self.weight, self.factor, idx, starts)[0]


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[starts[1:]] - total[starts[:-1]]


def _logits(bias, weight, factor, idx, starts):
    v = factor[idx]
    s = _sums(v, starts)
    return bias + _sums(weight[idx], starts) + 0.5 * ((s**2).sum(1) - _sums((v**2).sum(1), starts)), s, v


def _rows_with(rows: list[np.ndarray], step: int = 500) -> np.ndarray:
    """How many rows hold each term; some rows at a time, as the driver is small."""
    n = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(rows), step):
        n += np.bincount(np.concatenate(rows[at : at + step]), minlength=BUCKETS)
    return n


def telling(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Terms whose counts in the two classes differ: a likelihood ratio above the
    Bayesian information criterion."""
    n, n1 = len(rows), float(y.sum())

    a, b = (_rows_with([r for r, k in zip(rows, y == c, strict=True) if k]) for c in (1, 0))
    g = np.zeros(BUCKETS)
    for seen, size in ((a, n1), (b, n - n1)):
        for hit, rate in ((seen, (a + b) / max(n, 1)), (size - seen, 1 - (a + b) / max(n, 1))):
            with np.errstate(divide="ignore", invalid="ignore"):
                g += np.where(hit > 0, 2 * hit * np.log(hit / np.maximum(size * rate, 1e-300)), 0.0)
    return g >= np.log(max(n, 2))


def learn(rows: list[np.ndarray], y: np.ndarray, factors: int = FACTORS, epochs: int = 12, steps: int = 2000, rate: float = 0.2, decay: float = 1e-4, seed: int = 3) -> Machine:
    """AdaGrad on logistic loss in seeded mini-batches: ``epochs`` rounds, or as
    many as make ``steps`` batches.

    Terms of LEAST_DOCS rows take part besides the telling ones, as a term that
    is neutral alone may tell in a pair. They decay HOLD times as fast, or they
    would add noise to long texts.
    """
    rng, n = np.random.default_rng(seed), len(rows)
    tells = telling(rows, y) if n else np.zeros(BUCKETS, bool)
    ok = tells | (_rows_with(rows) >= LEAST_DOCS)
    hold = np.where(tells, decay, HOLD * decay)
    rows = [r[ok[r]] for r in rows]
    share = min(max(float(y.mean()), 0.01), 0.99) if n else 0.5
    bias, w = float(np.log(share / (1 - share))), np.zeros(BUCKETS)
    v = np.where(ok[:, None], rng.normal(0, 0.01, (BUCKETS, factors)), 0.0)
    gw, gv, gb = np.full(BUCKETS, 1e-4), np.full((BUCKETS, factors), 1e-4), 1e-6
    for _ in range(max(epochs, -(-64 * steps // max(n, 1))) if 0 < y.sum() < n else 0):
        order = rng.permutation(n)
        for k in range(0, n, 64):
            batch = order[k : k + 64]
            lens = np.array([len(rows[i]) for i in batch])
            idx = np.concatenate([rows[i] for i in batch])
            starts = np.concatenate(([0], np.cumsum(lens)))
            z, s, vx = _logits(bias, w, v, idx, starts)
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]) / len(batch)
            e = np.repeat(err, lens)
            use, place = np.unique(idx, return_inverse=True)
            dw = np.bincount(place, e, len(use)) + hold[use] * w[use]
            sv = np.repeat(s, lens, axis=0) - vx
            dv = np.stack([np.bincount(place, e * sv[:, f], len(use)) for f in range(factors)], axis=1) + hold[use, None] * v[use]
            gw[use] += dw**2
            gv[use] += dv**2
            w[use] -= rate * dw / np.sqrt(gw[use])
            v[use] -= 0.2 * rate * dv / np.sqrt(gv[use])
            db = err.sum()
            gb += db**2
            bias -= rate * db / np.sqrt(gb)
    return Machine(bias, w, v)


def sample_of(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fit_rows: int, fit_on) -> DataFrame:
    """(k, t, y): at most ``fit_rows`` labelled ids, those of smallest hash, one
    row each; of several texts of one id the one of smallest hash counts."""
    known = labels.where(F.col(label_col).isin(0, 1) & fit_on(id_col)).select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y"))
    known = known.groupBy("k").agg(F.max("y").alias("y"))
    picked = known.orderBy(F.xxhash64("k"), "k").limit(fit_rows)
    text = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    one = text.join(F.broadcast(picked), "k").groupBy("k", "y").agg(F.min_by("t", F.struct(F.xxhash64("t"), "t")).alias("t"))
    return one.select("k", "t", "y")


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS, fit_on=lambda c: F.lit(True)
) -> Machine:
    """A machine learned from labels for which ``fit_on(id column)`` holds.

    Terms are hashed in the tasks; what reaches the driver is bounded by
    ``fit_rows``, however often ids repeat. A label other than 0 or 1, or without a
    document, is not used; of several labels of one id the highest counts, of
    several texts one. Without labels of both classes every text gets the same
    score.
    """
    sample = sample_of(docs, labels, id_col, text_col, label_col, fit_rows, fit_on)

    def hashed(batches):
        cache: dict[bytes, tuple[int, ...]] = {}
        for b in frames(batches):
            yield pd.DataFrame({"h": [int(_XX(str(k), 9) >> 1) for k in b["k"]], "y": b["y"], "t": [terms(t, cache).astype(np.int32) for t in b["t"]]})

    # one flat array of terms, and views of it as rows
    got = sample.mapInPandas(hashed, "h bigint, y int, t array<int>").toArrow().combine_chunks()
    if not len(got):
        return learn([], np.zeros(0))
    lists = got["t"].chunk(0)
    at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    order = np.argsort(got["h"].to_numpy(), kind="stable")
    return learn([flat[at[k] : at[k + 1]] for k in order], got["y"].to_numpy()[order].astype(float))


def scores(docs: DataFrame, machine: Machine, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` inside ``row``, and ``score``, the chance of label 1.

    Null and empty texts have no terms and get the bias alone.
    """
    wanted = np.flatnonzero((machine.weight != 0) | (machine.factor != 0).any(1))
    shared = to_tasks(docs.sparkSession, {"use": wanted, "w": machine.weight[wanted], "v": machine.factor[wanted], "bias": machine.bias})

    def logistic(texts: pd.Series) -> pd.Series:
        m = shared.value
        wanted = np.zeros(BUCKETS, bool)
        wanted[m["use"]] = True
        cache: dict[bytes, tuple[int, ...]] = {}
        place = np.cumsum(wanted) - 1
        z = [np.zeros(0)]
        for at in range(0, len(texts), _BATCH):
            found = [terms(t, cache, wanted) for t in texts[at : at + _BATCH]]
            starts = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int64)
            idx = place[np.concatenate(found)] if starts[-1] else np.zeros(0, np.int64)
            z.append(_logits(m["bias"], m["w"], m["v"], idx, starts)[0])
        return pd.Series(1 / (1 + np.exp(-np.clip(np.concatenate(z), -500, 500))))

    score = F.pandas_udf(logistic, "double")
    return docs.select(F.struct("*").alias("row"), score(F.col(text_col)).alias("score"))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> DataFrame:
    """(id_col, held_out, score, predicted), one row per row of ``docs``.

    Labels of ids whose crc32 as text is a multiple of 5 are held out. Null ids
    count as the empty text there. Null and empty texts score by the bias alone;
    texts of any length are read whole, as the set of their terms; a score of 0.5
    predicts 1. An empty table gives no rows; rows that repeat stay repeated.
    Other columns are not read.
    """
    rest = lambda c: id_remainder(c, 5) != 0
    machine = fit(docs, labels, id_col, text_col, label_col, fit_rows, rest)
    out = scores(docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")), machine, "t")
    return out.select(
        F.col("row.k").alias(id_col), (id_remainder("row.k", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def without_toxic(docs: DataFrame, machine: Machine, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs`` whose score stays below ``threshold``."""
    return scores(docs, machine, text_col).where(F.col("score") < threshold).select("row.*")
