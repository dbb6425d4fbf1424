"""Embedding near-duplicates: iterative quantisation, multi-index tables, rerank.

A rotation of the principal axes is learned so that signs lose as little as
possible; the signs are the code. Codes are cut into tables of ``width`` bits.
Each vector owns its bucket in every table and probes the buckets within
``reach`` flipped bits. Pairs that are close in the whole code are reranked by
the cosine of the original vectors.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import comb, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.llm.common import frames, popcount, stored
from mailsift.llm.graph import connected_components
from mailsift.llm.runs import BLOCK, Forest, cut_large, in_runs, meetings

#: Rows the rotation is learned from, those of smallest hash.
FIT_ROWS = 20_000
ROTATIONS = 2


@dataclass(frozen=True)
class Quantiser:
    """Code word r holds the signs of (v / |v| - mean) @ planes[r]."""

    mean: np.ndarray
    planes: list[np.ndarray]

    @property
    def bits(self) -> int:
        return self.planes[0].shape[1]

    def codes(self, v: np.ndarray) -> np.ndarray:
        u = v / np.linalg.norm(v, axis=1, keepdims=True) - self.mean
        weights = np.uint64(1) << np.arange(self.bits, dtype=np.uint64)
        return np.stack([((u @ p > 0) * weights).sum(1, dtype=np.uint64) for p in self.planes], axis=1).view(np.int64)


def learn(sample: np.ndarray, rotations: int = ROTATIONS, rounds: int = 40, seed: int = 7) -> Quantiser:
    u = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    mean = u.mean(0)
    u = u - mean
    axes = np.linalg.eigh(u.T @ u)[1][:, ::-1][:, : min(64, u.shape[1])]
    v, rng, planes = u @ axes, np.random.default_rng(seed), []
    for _ in range(rotations):
        turn = np.linalg.qr(rng.standard_normal((v.shape[1], v.shape[1])))[0]
        for _ in range(rounds):
            left, _, right = np.linalg.svd(np.where(v @ turn > 0, 1.0, -1.0).T @ v)
            turn = right.T @ left.T
        planes.append(axes @ turn)
    return Quantiser(mean, planes)


@dataclass(frozen=True)
class Tables:
    """(word, shift, width) of each table, probes within ``reach`` bits, and the
    largest distance of whole codes that is reranked."""

    cuts: tuple[tuple[int, int, int], ...]
    reach: int
    radius: int


def apart(sample: np.ndarray, model: Quantiser, threshold: float, count: int = 4000, seed: int = 11) -> list[np.ndarray]:
    """Differing code bits of pairs whose cosine is the threshold itself.

    Centring widens the angle of a pair, and not of every pair alike, so the bits
    are measured: one set of pairs parts in any direction, the other as vectors
    of the sample differ from each other. Pairs just over the threshold among
    the first vectors of the sample are a third set, if there are enough.
    """
    u, rng = sample / np.linalg.norm(sample, axis=1, keepdims=True), np.random.default_rng(seed)
    one = u[rng.integers(len(u), size=count)]
    first, second = rng.integers(len(u), size=(2, count))
    out = []
    for way in (rng.standard_normal(one.shape), u[first] - u[second]):
        way = way - (way * one).sum(1, keepdims=True) * one
        size = np.linalg.norm(way, axis=1)
        some = size > 1e-6
        if some.any():
            near = one[some]
            other = threshold * near + sqrt(1 - threshold**2) * way[some] / size[some, None]
            out.append((model.codes(near) ^ model.codes(other)).view(np.uint64))
    some = u[:count]
    pairs = np.concatenate([np.stack([c.ravel() for c in np.nonzero(np.abs(np.triu(some[k : k + 500] @ some.T, k + 1) - threshold - 0.01) <= 0.01)]) + [[k], [0]] for k in range(0, len(some), 500)], axis=1)
    if pairs.shape[1] >= 200:
        i, j = pairs[:, rng.integers(pairs.shape[1], size=count)]
        code = model.codes(some)
        out.append((code[i] ^ code[j]).view(np.uint64))
    return out or [np.zeros((1, len(model.planes)), np.uint64)]


def plan_tables(n: int, bits: int, rotations: int, differ: list[np.ndarray], recall: float = 0.94) -> Tables:
    """Cheapest tables that reach ``recall`` for each set of pairs at the threshold
    itself, given by their differing bits (from ``apart``). Closer pairs are found
    more often. The radius lets all of these pairs through.
    """
    best = None
    for width in range(min(4, bits), min(bits, 40) + 1):
        cuts = []
        for r in range(rotations):
            count = max(1, bits // width)
            edges = [round(k * bits / count) for k in range(count + 1)]
            cuts += [(r, a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
        nearest = [np.min([popcount((x[:, r] >> np.uint64(a)) & np.uint64((1 << w) - 1)) for r, a, w in cuts], axis=0) for x in differ]
        for reach in range(4):
            rows = pairs = 1.0
            for _, _, w in cuts:
                probes = sum(comb(w, t) for t in range(min(reach, w) + 1))
                rows += n * (1 + probes / 2)
                pairs += 0.5 * n * n * probes / 2.0**w
            found = min((k <= reach).mean() for k in nearest)
            # with few bits no plan may reach the recall: then the surest one
            rank = (round(max(0.0, recall - found), 4), rows + 0.05 * pairs)
            if best is None or rank < best[0]:
                best = (rank, tuple(cuts), reach)
    return Tables(best[1], best[2], int(max(popcount(x).sum(1).max() for x in differ)))


def bucket_rows(coded: DataFrame, tables: Tables) -> DataFrame:
    """(bucket, own, id, code): own buckets and probes to keys above the own key."""
    masks = [np.array([sum(1 << i for i in c) for t in range(1, tables.reach + 1) for c in combinations(range(w), t)], dtype=np.uint64) for _, _, w in tables.cuts]

    def work(batches):
        for b in frames(batches):
            ids, code = b["id"].to_numpy(), np.stack(b["code"].to_numpy())
            for number, ((word, shift, width), mask) in enumerate(zip(tables.cuts, masks, strict=True)):
                key = (code[:, word].view(np.uint64) >> np.uint64(shift)) & np.uint64((1 << width) - 1)
                top = np.uint64(number << 56) if width < 56 else np.uint64(number)
                yield pd.DataFrame({"bucket": (key | top).view(np.int64), "own": True, "id": ids, "code": list(code)})
                step = max(1, (1 << 18) // max(1, len(mask)))
                for k in range(0, len(ids), step) if len(mask) else ():
                    other = key[k : k + step, None] ^ mask
                    row, col = np.nonzero(other > key[k : k + step, None])
                    yield pd.DataFrame({"bucket": (other[row, col] | top).view(np.int64), "own": False, "id": ids[k + row], "code": list(code[k + row])})

    return coded.select("id", "code").mapInPandas(work, "bucket bigint, own boolean, id bigint, code array<bigint>")


def _close(code: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, tables: Tables) -> np.ndarray:
    """Pairs within the radius, each in the first table that can show it only."""
    x = (code[i] ^ code[j]).view(np.uint64)
    good = popcount(x).sum(1) <= tables.radius
    for number, (word, shift, width) in enumerate(tables.cuts):
        near = popcount((x[:, word] >> np.uint64(shift)) & np.uint64((1 << width) - 1)) <= tables.reach
        good &= ~near | (table[i] <= number)
    return good


def _frame_close(frame: pd.DataFrame, run: np.ndarray, tables: Tables):
    code, table = np.stack(frame["code"].to_numpy()), (frame["bucket"].to_numpy() >> 56)
    for i, j in meetings(frame, run):
        good = _close(code, table, i, j, tables)
        if good.any():
            yield i[good], j[good]


def usable(c: Column, length: int | None = None) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = c.isNotNull() & (F.size(c) > 0) & ~bad & F.exists(c, lambda x: x != 0)
    return F.coalesce(good if length is None else good & (F.size(c) == length), F.lit(False))


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9, fit_rows: int = FIT_ROWS, block: int = BLOCK
) -> DataFrame:
    """(id_col, n_links, component_id, kept), one row per row of ``vectors``.

    Two vectors link if the cosine in double precision is ``threshold`` or more
    and their codes meet in a table. Vectors that are null, zero, of a length
    other than the commonest, or hold a null or non-finite component link with
    nothing. Equal vectors are searched once and link with each other; a
    repeated row counts as another vector. Null ids never name a component,
    unless it has no other id. An empty table gives no rows.
    """
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).alias("k"), v.alias("v")).withColumn("ok", usable(F.col("v")))
    common = rows.where("ok").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    length = common.d if common else 0
    rows = rows.withColumn("ok", F.col("ok") & (F.size("v") == length)).withColumn("h", F.when(F.col("ok"), F.struct(F.xxhash64("v").alias("p"), F.xxhash64(F.lit(1), "v").alias("q"))))
    distinct = rows.where("ok").groupBy("h").agg(F.min("k").alias("low"), F.count("*").alias("copies"), F.first("v").alias("v"))
    distinct = stored(distinct.withColumn("id", F.xxhash64("h")))
    links = link_counts(distinct, threshold, fit_rows, block)
    parts = connected_components(links.where("b is not null").select("a", "b")).withColumnRenamed("node", "id")
    counts = links.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    named = distinct.select("h", "id", "low", "copies").join(parts, "id", "left").join(counts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    lows = named.groupBy("component").agg(F.min("low").alias("component_id"))
    of = named.join(lows, "component").select("h", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    whole = rows.select("k", "h").join(of, "h", "left")
    lowest = F.when(F.col("h").isNull(), F.col("k")).otherwise(F.col("component_id"))
    return whole.select(
        F.col("k").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), lowest.alias("component_id"), F.coalesce(F.col("k") == lowest, F.lit(True)).alias("kept")
    )


def link_counts(distinct: DataFrame, threshold: float, fit_rows: int, block: int) -> DataFrame:
    """Rows (a, null, n): a links with n vectors more; rows (a, b, null): links
    that connect whatever is connected. ``distinct`` has id, copies, v."""
    spark = distinct.sparkSession
    n = distinct.count()
    if n < 2:
        return spark.createDataFrame([], "a bigint, b bigint, n bigint")
    sample = np.array([r.v for r in distinct.orderBy("id").limit(fit_rows).select("v").collect()], dtype=np.float64)
    model = learn(sample)
    tables = plan_tables(n, model.bits, len(model.planes), apart(sample, model, threshold))

    def encode(batches):
        for b in frames(batches):
            yield pd.DataFrame({"id": b["id"], "code": list(model.codes(np.stack(b["v"].to_numpy()).astype(np.float64)))})

    coded = distinct.select("id", "v").mapInPandas(encode, "id bigint, code array<bigint>")
    rows = cut_large(bucket_rows(coded, tables), block)

    def met(frame: pd.DataFrame, run: np.ndarray) -> pd.DataFrame:
        seen = np.zeros(len(run), bool)
        for i, j in _frame_close(frame, run, tables):
            seen[i] = seen[j] = True
        return frame[seen]

    columns = "bucket bigint, own boolean, id bigint, code array<bigint>, part int, x int, y int"
    close = in_runs(rows, met, columns).join(distinct.select("id", "v", "copies"), "id")

    def rerank(frame: pd.DataFrame, run: np.ndarray) -> pd.DataFrame:
        v = np.stack(frame["v"].to_numpy()).astype(np.float64)
        size, copies, ids = np.sqrt((v * v).sum(1)), frame["copies"].to_numpy(), frame["id"].to_numpy()
        forest, more = Forest(len(ids)), np.zeros(len(ids), np.int64)
        for i, j in _frame_close(frame, run, tables):
            link = (v[i] * v[j]).sum(1) / (size[i] * size[j]) >= threshold
            i, j = i[link], j[link]
            np.add.at(more, i, copies[j])
            np.add.at(more, j, copies[i])
            forest.add(i, j)
        a, b = forest.ends()
        some = more > 0
        return pd.concat([pd.DataFrame({"a": ids[some], "b": None, "n": more[some]}), pd.DataFrame({"a": ids[a], "b": ids[b], "n": None})], ignore_index=True).astype({"b": "Int64", "n": "Int64"})

    return stored(in_runs(close, rerank, "a bigint, b bigint, n bigint"))
