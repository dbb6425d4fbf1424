"""Hard negatives by coordinate pruning over length buckets.

Anchors are a stated query set and meet all rows block by block. In a block the
rows lie in buckets of falling length, and a bucket keeps the sorted values of
every coordinate of its normalised rows. A score that an anchor still needs
becomes a least cosine in the bucket; with it an anchor's largest coordinates,
its focus, allow only a range of a row's value there. The ranges' slices of the
sorted lists are intersected, and what is left is scored exactly in integers.
The score needed rises with the results found, so later buckets offer less, and
a bucket too short for it ends the search.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mailsift.llm.common import in_array, stored

#: Rows and anchors that one task holds, about.
ROWS, ANCHORS = 8192, 2048
#: Rows of a length bucket, and coordinates of an anchor's focus.
BUCKET, FOCUS = 512, 4
#: Share of a bucket above which scoring all its rows is cheaper than choosing among them.
MOST = 0.5
#: Keeps rounding from shutting out a row at the edge of its range.
SLACK = 1e-9

_OF = "id array<long>, label long, v array<long>"


def integers(vectors: DataFrame, vec_id: str, label: Column, vector: str) -> DataFrame:
    """(id, label, v) of the rows that take part: a label, a vector without null
    or non-finite components, and components whose products fit 64 bits."""
    x = F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * 256))
    fine = F.forall(F.col(vector), lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double") * 256) * F.sqrt(F.size(vector)) < float(2**31)), F.lit(False)))
    rows = vectors.where(label.isNotNull() & F.col(vector).isNotNull() & fine)
    return rows.select(in_array(vec_id).alias("id"), label.cast("long").alias("label"), x.alias("v"))


class Rows:
    """A block of vectors in buckets of falling length with sorted coordinates."""

    def __init__(self, ids: np.ndarray, none: np.ndarray, label: np.ndarray, v: np.ndarray):
        length = np.sqrt((v.astype(float) ** 2).sum(axis=1))
        order = np.argsort(-length, kind="stable")
        self.ids, self.none, self.label, self.v, length = ids[order], none[order], label[order], v[order], length[order]
        self.exact = self.v.astype(float) if np.abs(v).max(initial=0) * np.sqrt(v.shape[1]) < 2**26 else self.v
        self.buckets = []
        for a in range(0, len(v), BUCKET):
            b = min(a + BUCKET, len(v))
            unit = self.v[a:b] / np.maximum(length[a:b], 1e-300)[:, None]
            place = np.argsort(unit, axis=0).T.copy()
            values = np.take_along_axis(unit.T, place, axis=1)
            self.buckets.append((a, b, float(length[a]), values, place))

    def candidates(self, bucket: tuple, unit: np.ndarray, focus: np.ndarray, least: float) -> np.ndarray | None:
        """Rows of the bucket that can have the cosine ``least``; None: the whole bucket."""
        a, b, _, values, place = bucket
        if least <= 0:
            return None
        q = unit[focus]
        span = np.sqrt(np.maximum(0.0, (1 - q * q) * (1 - least * least))) + SLACK
        lows, highs = q * least - span, q * least + span
        # beyond the angle's own reach the bound is 1, where the row's value may end the range
        lows, highs = np.where(q <= -least, -1 - SLACK, lows), np.where(q >= least, 1 + SLACK, highs)
        slices = [(int(np.searchsorted(values[f], lo)), int(np.searchsorted(values[f], hi, "right")), f) for f, lo, hi in zip(focus.tolist(), lows, highs, strict=True)]
        slices.sort(key=lambda s: s[1] - s[0])
        if slices[0][1] - slices[0][0] > MOST * (b - a):
            return None
        s, e, f = slices[0]
        left = place[f, s:e]
        for s, e, f in slices[1:]:
            if not len(left):
                break
            if e - s < b - a:
                held = np.zeros(b - a, bool)
                held[place[f, s:e]] = True
                left = left[held[left]]
        return left + a

    def scores(self, q: np.ndarray, rows: np.ndarray | slice) -> np.ndarray:
        return (self.exact[rows] @ q.astype(self.exact.dtype)).astype(np.int64)


def first(score: np.ndarray, ids: np.ndarray, none: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k: higher scores, then smaller ids, null last."""
    if len(score) > 4 * k:
        cut = np.partition(score, len(score) - k)[len(score) - k]
        near = np.flatnonzero(score >= cut)
        return near[np.lexsort((ids[near], none[near], -score[near]))[:k]]
    return np.lexsort((ids, none, -score))[:k]


class Wanted:
    """First k rows of one label rule with a score in [low, high]."""

    def __init__(self, k: int, low: int | None, high: int | None):
        self.k, self.low, self.high = k, low, high
        self.score, self.ids, self.none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def least(self) -> int | None:
        """The least score that may still enter; None: any."""
        return int(self.score[-1]) if len(self.score) == self.k else self.low

    def add(self, score: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        least = self.least()
        keep = np.ones(len(score), bool) if least is None else score >= least
        if self.high is not None:
            keep &= score <= self.high
        if keep.any():
            score, ids, none = (np.concatenate(x) for x in ((self.score, score[keep]), (self.ids, ids[keep]), (self.none, none[keep])))
            best = first(score, ids, none, self.k)
            self.score, self.ids, self.none = score[best], ids[best], none[best]


def sweep(rows: Rows, q: np.ndarray, allowed: np.ndarray, wants: list[Wanted]) -> int:
    """Fill ``wants`` from the allowed rows; returns how many rows were scored."""
    length = float(np.sqrt((q.astype(float) ** 2).sum()))
    unit = q / length if length else q.astype(float)
    focus = np.argsort(-np.abs(unit))[:FOCUS]
    seen = 0
    for bucket in rows.buckets:
        a, b, longest, _, _ = bucket
        needs = [w.least() for w in wants]
        need = None if any(n is None for n in needs) else min(needs)
        if need is not None and need > 0 and need > length * longest * (1 + SLACK):
            break  # shorter buckets offer still less
        least = need / (length * longest) if need is not None and length and longest else 0.0
        found = rows.candidates(bucket, unit, focus, min(1.0, least))
        at = np.arange(a, b) if found is None else found
        at = at[allowed[at]]
        if not len(at):
            continue
        seen += len(at)
        score = rows.scores(q, at)
        for w in wants:
            w.add(score, rows.ids[at], rows.none[at])
    return seen


def _matrix(v: pd.Series) -> np.ndarray:
    return np.array(v.tolist(), dtype=np.int64).reshape(len(v), -1)


def _ids(c: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    none = np.array([len(x) == 0 for x in c], bool)
    return np.array([0 if len(x) == 0 else x[0] for x in c], np.int64), none


def _met(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, fn, schema: str) -> DataFrame:
    """Apply ``fn(anchors, rows)`` to each block of anchors with each block of rows."""
    across, down = -(-n_rows // ROWS), -(-n_anchors // ANCHORS)
    block = lambda n, *c: F.pmod(F.xxhash64(*c), F.lit(max(1, n))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(1, n) - 1)))
    size = F.size("v").alias("size")
    r = rows.select("*", size, block(across, "id", "label", "v").alias("x")).select("*", every(down).alias("y"))
    a = anchors.select("*", size, block(down, "anchor").alias("y")).select("*", every(across).alias("x"))

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return fn(left, right) if len(left) and len(right) else pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])

    key = ("size", "x", "y")
    return a.groupBy(*key).cogroup(r.groupBy(*key)).applyInPandas(lambda left, right: work(left, right), schema)


def _place(*by: str) -> Column:
    return F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last(F.get("id", F.lit(0)))))


def mine(
    vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    vec_id: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    An anchor's positives are its first ``positives`` other rows of its label;
    for each, the first ``negatives`` rows of other labels whose score is from
    ``low`` to ``high`` hundredths of the positive's. Scores are integer inner
    products of floor(256 x); higher come first, ties by smaller id, null ids
    last. Rows without a label or vector, with null or non-finite components, or
    with components so large that scores could pass 64 bits take no part.
    Vectors meet vectors of their own dimension only. Repeated rows count each;
    "other" rows are those of another id; an anchor repeated in all columns is
    one anchor, rows that share its id but not its vector or label are anchors of
    their own. A positive that occurs twice is one of the first rows twice.
    Empty tables give no rows; other columns play no part.
    """
    rows = stored(integers(vectors, vec_id, label, vector))
    marked = integers(vectors.where(is_anchor), vec_id, label, vector).distinct()
    marked = stored(marked.withColumn("anchor", F.struct("id", F.md5(F.to_json(F.struct("label", "v"))).alias("of"))))
    n_rows, n_anchors = rows.count(), marked.count()

    def alike(a: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        ids, none = _ids(r["id"])
        block, out = Rows(ids, none, r["label"].to_numpy(np.int64), _matrix(r["v"])), []
        mine, nameless = _ids(a["id"])
        for n, (q, y) in enumerate(zip(_matrix(a["v"]), a["label"].to_numpy(np.int64), strict=True)):
            same = (block.label == y) & ((block.ids != mine[n]) | (block.none != nameless[n]))
            want = Wanted(positives, None, None)
            sweep(block, q, same, [want])
            out += [(a["anchor"].iloc[n], [] if e else [i], s) for s, i, e in zip(want.score.tolist(), want.ids.tolist(), want.none.tolist(), strict=True)]
        return pd.DataFrame(out, columns=["anchor", "id", "score"])

    of = "anchor struct<id:array<long>,of:string>"
    best = _met(rows, marked, n_rows, n_anchors, alike, f"{of}, id array<long>, score long")
    best = best.withColumn("place", _place("anchor")).where(F.col("place") <= positives)
    # a band needs low * score <= high * score, so negative scores have none
    best = best.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("best"))
    asked = stored(marked.join(best, "anchor"))

    def unlike(a: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        ids, none = _ids(r["id"])
        block, out = Rows(ids, none, r["label"].to_numpy(np.int64), _matrix(r["v"])), []
        for n, (q, y) in enumerate(zip(_matrix(a["v"]), a["label"].to_numpy(np.int64), strict=True)):
            score = [int(p["score"]) for p in a["best"].iloc[n]]
            wants = {k: Wanted(negatives, -(-low * s // 100), high * s // 100) for k, s in enumerate(score, 1) if low * s <= high * s}
            if wants:
                sweep(block, q, block.label != y, list(wants.values()))
            for k, w in wants.items():
                out += [(a["anchor"].iloc[n], k, [] if e else [i], s) for s, i, e in zip(w.score.tolist(), w.ids.tolist(), w.none.tolist(), strict=True)]
        return pd.DataFrame(out, columns=["anchor", "place", "id", "score"])

    found = _met(rows, asked, n_rows, n_anchors, unlike, f"{of}, place int, id array<long>, score long")
    found = found.withColumn("rank", _place("anchor", "place")).where(F.col("rank") <= negatives)
    pairs = asked.select("anchor", F.inline("best").alias("place", "positive", "positive_score"))
    one = lambda c: F.get(c, F.lit(0))
    return found.join(pairs, ["anchor", "place"]).select(
        one("anchor.id").alias("anchor_id"), one("positive").alias("positive_id"), "rank", one("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
