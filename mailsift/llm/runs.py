"""Pairs inside buckets: sorted runs of rows that share a bucket key.

A row owns its bucket or only probes it. Every owner meets every other row of
its bucket; two probes need not meet. A bucket of more rows than a task should
hold is cut into blocks, and each pair of blocks is a bucket of its own, so the
search stays whole at any bucket size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a bucket that one task takes at once.
BLOCK = 4096


def cut_large(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Add ``x`` and ``y``, the block pair a row takes part in, and ``part``.

    ``rows`` has ``bucket`` and ``id``. Rows of ordinary buckets get (0, 0).
    """
    large = rows.groupBy("bucket").count().where(F.col("count") > 2 * block)
    large = large.select("bucket", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    rows = rows.join(large, "bucket", "left")
    part = F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    others = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.withColumn("part", part).withColumn("other", F.explode(others))
    return rows.withColumns({"x": F.least("part", "other").cast("int"), "y": F.greatest("part", "other").cast("int")}).drop("other", "blocks")


def in_runs(rows: DataFrame, fn: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """Apply ``fn(frame, run)`` to whole runs; ``run`` numbers the frame's runs.

    Owners come first in a run. A frame holds at least one run, so memory is
    bounded by a batch plus the largest run.
    """
    dealt = rows.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y", F.desc("own"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _whole(batches):
            change = np.zeros(len(frame), bool)
            for c in ("bucket", "x", "y"):
                v = frame[c].to_numpy()
                change[1:] |= v[1:] != v[:-1]
            run = np.cumsum(change)
            many = np.bincount(run)[run] > 1
            if many.any():
                out = fn(frame[many].reset_index(drop=True), run[many])
                if len(out):
                    yield out

    return dealt.mapInPandas(work, schema)


def _whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []
    key = None
    for b in batches:
        if not len(b):
            continue
        keys = list(zip(*(b[c].to_numpy()[[0, -1]] for c in ("bucket", "x", "y")), strict=True))
        if held and keys[0] != key:
            yield pd.concat(held, ignore_index=True)
            held = []
        if keys[0] != keys[1]:
            last = (b["bucket"].to_numpy() == keys[1][0]) & (b["x"].to_numpy() == keys[1][1]) & (b["y"].to_numpy() == keys[1][2])
            yield pd.concat([*held, b[~last]], ignore_index=True)
            held = [b[last]]
        else:
            held.append(b)
        key = keys[1]
    if held:
        yield pd.concat(held, ignore_index=True)


def meetings(frame: pd.DataFrame, run: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (owner, other) of each run, in steps of growing distance."""
    own = frame["own"].to_numpy()
    part, cross = frame["part"].to_numpy(), (frame["x"] != frame["y"]).to_numpy()
    i, d, n = np.flatnonzero(own), 1, len(run)
    while len(i):
        i = i[i + d < n]
        i = i[run[i] == run[i + d]]
        j = i + d
        meet = ~cross[i] | (part[i] != part[j])
        if meet.any():
            yield i[meet], j[meet]
        d += 1


class Forest:
    """Keeps only links that join what was apart, at most one per row."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.kept: list[tuple[int, int]] = []

    def _find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return int(i)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        root = self.root
        apart = root[root[i]] != root[root[j]]
        for a, b in zip(i[apart].tolist(), j[apart].tolist(), strict=True):
            ra, rb = self._find(a), self._find(b)
            if ra != rb:
                root[max(ra, rb)] = min(ra, rb)
                self.kept.append((a, b))

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        k = np.array(self.kept, dtype=np.int64).reshape(-1, 2)
        return k[:, 0], k[:, 1]
