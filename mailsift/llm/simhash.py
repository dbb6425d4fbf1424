"""SimHash near-duplicates by the generalised pigeonhole principle.

64 fingerprint bits are grouped into parts of correlated bits. If part i may
differ in t_i bits and the t_i + 1 sum to k + 1, two fingerprints within k bits
agree in some part up to its t_i. Thresholds are allocated by dynamic
programming on estimated costs: probes sent and candidates met. Every distinct
fingerprint owns its bucket in each part and probes the buckets of nearby keys;
candidates are verified on all 64 bits.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsift.llm.common import frames, in_array, lower_words_of, popcount, stored
from mailsift.llm.graph import connected_components
from mailsift.llm.runs import BLOCK, Forest, cut_large, in_runs, meetings

BITS = 64
_XX = xxhash.xxh64_intdigest


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Unsigned fingerprint of one text.

    A bit is set if it is set in over half the hashes of the word shingles,
    repeats included. Fewer words than a shingle count as one shingle; a null
    text or one without a word has fingerprint zero.
    """
    words = lower_words_of(text)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    stops = ends[-n:].tolist() if len(words) >= shingle else [len(joined)]
    h = np.array([_XX(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)], dtype=np.uint64)
    return _majority(h)


def _majority(h: np.ndarray) -> int:
    count = np.zeros(BITS, np.int64)
    for k in range(0, len(h), 1 << 16):
        part = h[k : k + (1 << 16)].astype(">u8")
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp, h): the fingerprint as a signed long, and a hash of the text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches):
        for b in frames(batches):
            f = np.array([fingerprint(t) for t in b["t"]], dtype=np.uint64)
            yield pd.DataFrame({"k": b["k"], "fp": f.view(np.int64), "h": b["h"]})

    text = docs.select(in_array(id_col).alias("k"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t"))
    return text.mapInPandas(work, f"k array<{kind}>, fp bigint, h bigint").select(F.get("k", F.lit(0)).alias(id_col), "fp", "h")


@dataclass(frozen=True)
class Part:
    bits: tuple[int, ...]
    reach: int


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and how often two bits are set together.

    Each task sends 2080 counts, whatever it has read; 2080 sums come back.
    """

    def work(batches):
        total, n = np.zeros((BITS, BITS)), 0
        for b in frames(batches):
            m = _bit_matrix(b["fp"].to_numpy()).astype(np.float32)
            total, n = total + m.T @ m, n + len(m)
        if n:
            i, j = np.triu_indices(BITS)
            yield pd.DataFrame({"i": np.append(i, -1), "j": np.append(j, -1), "n": np.append(total[i, j], n).astype(np.int64)})

    sums = fps.mapInPandas(work, "i int, j int, n bigint").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both, n = np.zeros((BITS, BITS)), 0
    for r in sums:
        if r.i < 0:
            n = r.n
        else:
            both[r.i, r.j] = both[r.j, r.i] = r.n
    return n, both


def _bit_matrix(fp: np.ndarray) -> np.ndarray:
    return (fp.view(np.uint64)[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)


def _correlation(n: int, both: np.ndarray) -> np.ndarray:
    p = np.diag(both) / n
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return (both / n - np.outer(p, p)) / np.outer(sd, sd)


def group_bits(corr: np.ndarray, parts: int) -> list[tuple[int, ...]]:
    """Parts of nearly equal width; each takes the bits most correlated with it."""
    strength, left, out = np.abs(corr) - np.eye(BITS), set(range(BITS)), []
    for k in range(parts):
        width = len(left) // (parts - k)
        rest = sorted(left)
        start = max(rest, key=lambda b: (strength[b, rest].max(), -b))
        chosen = [start]
        while len(chosen) < width:
            free = [b for b in rest if b not in chosen]
            chosen.append(max(free, key=lambda b: (strength[b, chosen].mean(), -b)))
        left -= set(chosen)
        out.append(tuple(sorted(chosen)))
    return out


def _agreement(p: np.ndarray, corr: np.ndarray, bits: tuple[int, ...], reach: int) -> list[float]:
    """Chance that two fingerprints differ in at most 0..reach of these bits.

    Bits are taken as independent, then the exponent shrinks with the part's
    effective number of independent bits.
    """
    differ = [2 * p[b] * (1 - p[b]) for b in bits]
    row = np.zeros(reach + 2)
    row[0] = 1.0
    for q in differ:
        row[1:] = row[1:] * (1 - q) + row[:-1] * q
        row[0] *= 1 - q
    sub = corr[np.ix_(bits, bits)]
    share = len(bits) / max((sub**2).sum(), 1.0)
    return [min(1.0, float(row[: t + 1].sum()) ** share) for t in range(reach + 1)]


def allocate(n: int, both: np.ndarray, k: int, row_cost: float = 1.0, pair_cost: float = 0.02) -> list[Part]:
    """Parts and reaches of least estimated cost, over all numbers of parts."""
    corr, p = _correlation(max(n, 1), both), np.diag(both) / max(n, 1)
    best: tuple[float, list[Part]] | None = None
    for m in range(1, k + 2):
        groups = group_bits(corr, m)
        cost = []
        for g in groups:
            chance = _agreement(p, corr, g, k)
            probes = np.cumsum([comb(len(g), t) for t in range(k + 1)])
            cost.append([0.0] + [n * (1 + probes[t] / 2) * row_cost + 0.5 * n * n * chance[t] * pair_cost for t in range(k + 1)])
        # table[s]: least cost of the parts so far whose (reach + 1) sum to s
        table: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for c in cost:
            step: dict[int, tuple[float, tuple[int, ...]]] = {}
            for s, (v, ts) in table.items():
                for add in range(min(k + 1 - s, len(c) - 1) + 1):
                    new = (v + c[add], (*ts, add - 1))
                    if s + add not in step or new < step[s + add]:
                        step[s + add] = new
            table = step
        if k + 1 in table and (best is None or table[k + 1][0] < best[0]):
            best = (table[k + 1][0], [Part(g, t) for g, t in zip(groups, table[k + 1][1], strict=True) if t >= 0])
    return best[1]


def bucket_rows(fps: DataFrame, parts: list[Part]) -> DataFrame:
    """(bucket, own, id): own buckets and probes of each fingerprint.

    A probe goes to keys above the own key only: of two keys that differ, the
    lower one's row visits the higher one's bucket.
    """
    flips = [[sum(1 << i for i in c) for t in range(1, p.reach + 1) for c in combinations(range(len(p.bits)), t)] for p in parts]
    masks = [np.array(f, dtype=np.uint64) for f in flips]

    def work(batches):
        for b in frames(batches):
            fp = b["id"].to_numpy()
            m = _bit_matrix(fp)
            for number, (part, mask) in enumerate(zip(parts, masks, strict=True)):
                weights = np.uint64(1) << np.arange(len(part.bits), dtype=np.uint64)
                key = (m[:, part.bits] * weights).sum(1, dtype=np.uint64)
                yield _rows(number, key, True, fp)
                for k in range(0, len(fp), max(1, (1 << 20) // max(1, len(mask)))) if len(mask) else ():
                    stop = k + max(1, (1 << 20) // len(mask))
                    other = key[k:stop, None] ^ mask
                    up = other > key[k:stop, None]
                    yield _rows(number, other[up], False, np.broadcast_to(fp[k:stop, None], other.shape)[up])

    return fps.select(F.col("fp").alias("id")).mapInPandas(work, "bucket bigint, own boolean, id bigint")


def _rows(number: int, key: np.ndarray, own: bool, fp: np.ndarray) -> pd.DataFrame:
    """Part number and key in one long: a key of all 64 bits is alone in its part."""
    mixed = (key ^ np.uint64(number * 0x9E3779B97F4A7C15 % 2**64)).view(np.int64)
    return pd.DataFrame({"bucket": mixed, "own": own, "id": fp})


def links(fps: DataFrame, k: int = 4, block: int = BLOCK) -> DataFrame:
    """(a, b) links between distinct fingerprints within ``k`` bits.

    Enough links to connect whatever is connected, at most one per bucket row.
    Buckets of two parts whose mixed keys fall together only cost candidates.
    """
    n, both = bit_statistics(fps)
    if n < 2:
        return fps.sparkSession.createDataFrame([], "a bigint, b bigint")
    rows = cut_large(bucket_rows(fps, allocate(n, both, k)), block)

    def verify(frame: pd.DataFrame, run: np.ndarray) -> pd.DataFrame:
        fp = frame["id"].to_numpy()
        forest = Forest(len(fp))
        for i, j in meetings(frame, run):
            near = popcount(fp[i] ^ fp[j]) <= k
            forest.add(i[near], j[near])
        a, b = forest.ends()
        return pd.DataFrame({"a": fp[a], "b": fp[b]})

    return in_runs(rows, verify, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, block: int = BLOCK) -> DataFrame:
    """(id_col, fp, h, component_id) for every row of ``docs``.

    component_id is the smallest id reachable over links of at most ``k`` bits.
    Null and empty texts share fingerprint zero and are linked like any other; texts
    of any length count whole; a bit that is set in exactly half the hashes is 0.
    Null ids take part but never name a component, unless it has no other id.
    Repeated rows stay repeated. An empty table gives no rows. Extra columns are
    not read.
    """
    each = stored(fingerprints(docs, id_col, text_col))
    fps = stored(each.groupBy("fp").agg(F.min(id_col).alias("low")))
    parts = connected_components(links(fps.select("fp"), k, block))
    named = fps.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    low = named.groupBy("component").agg(F.min("low").alias("component_id"))
    of = named.join(low, "component").select("fp", "component_id")
    return each.join(of, "fp").select(id_col, "fp", "h", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4) -> DataFrame:
    """The row of smallest id of each component, with all its columns.

    Of rows that share this id the one of smallest text hash stays, of rows that
    repeat, one. A component without an id keeps one row.
    """
    found = near_duplicates(docs, id_col, text_col, k)
    # a component has one lowest id, but components without any id share the null
    best = found.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("alone"))
    best = best.agg(F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("k"), "h")).alias("b")).select("b.k", "b.h")
    rows = docs.select(F.col(id_col).alias("k"), F.xxhash64(text_col).alias("h"), F.struct("*").alias("row"))
    kept = rows.join(best.withColumnsRenamed({"k": "bk", "h": "bh"}), F.col("k").eqNullSafe(F.col("bk")) & (F.col("h") == F.col("bh")), "left_semi")
    return kept.groupBy("k", "h").agg(F.first("row").alias("row")).select("row.*")


def hexadecimal(fp) -> "F.Column":
    """16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
