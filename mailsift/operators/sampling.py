"""Exact samples and splits without sorting or shuffling rows.

Rows are ordered by ``md5(id || '-' || seed)``, a uniform key both Spark and
other engines can compute. To take the k first rows it is enough to know the
k-th smallest key: it is found by counting keys per hexadecimal prefix (a small
aggregate) and looking at the few keys that share the prefix of the cut. The
sample itself is then a plain filter on the key.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX = 3
SMALL = 5_000


def order_key(ident: str = "msg_id", seed: int = 42) -> Column:
    return F.md5(F.concat(F.col(ident).cast("string"), F.lit(f"-{seed}")))


def _narrow(df: DataFrame, group: str | None, ident: str, seed: int) -> DataFrame:
    g = F.lit("all") if group is None else F.col(group).cast("string")
    return df.select(g.alias("g"), order_key(ident, seed).alias("k")).where(F.col("g").isNotNull())


def _prefix_counts(keys: DataFrame, width: int) -> dict[str, list[tuple[str, int]]]:
    """Sorted (prefix, count) per group: at most 4096 rows per group and level."""
    rows = keys.groupBy("g", F.substring("k", 1, width).alias("p")).count().collect()
    out = defaultdict(list)
    for r in rows:
        out[r["g"]].append((r["p"], r["count"]))
    return {g: sorted(v) for g, v in out.items()}


def cut_keys(
    df: DataFrame,
    ranks_of: Callable[[dict[str, int]], dict[str, list[int]]],
    group: str | None = None,
    ident: str = "msg_id",
    seed: int = 42,
) -> tuple[dict[str, int], dict[str, list[str | None]]]:
    """Class sizes and, per class, the key of the row with each wanted rank.

    ``ranks_of`` maps the class sizes to 1-based ranks. Rank 0 gives None (take
    nothing). Only the id and the class column are read.
    """
    keys = _narrow(df, group, ident, seed)
    level = _prefix_counts(keys, PREFIX)
    sizes = {g: sum(n for _, n in v) for g, v in level.items()}
    wanted = ranks_of(sizes)
    # open searches: (class, position in the answer) -> (prefix, rank inside it)
    answer = {g: [None] * len(r) for g, r in wanted.items()}
    open_cuts = {(g, i): ("", r) for g, rs in wanted.items() for i, r in enumerate(rs) if r > 0}
    width = PREFIX
    while open_cuts:
        narrowed, crowded = {}, False
        for (g, i), (prefix, rank) in open_cuts.items():
            for p, n in level[g]:
                if not p.startswith(prefix):
                    continue
                if rank <= n:
                    narrowed[(g, i)] = (p, rank)
                    crowded = crowded or n > SMALL
                    break
                rank -= n
        inside = F.lit(False)
        for g, p in {(g, p) for (g, _), (p, _) in narrowed.items()}:
            inside = inside | ((F.col("g") == g) & F.col("k").startswith(p))
        rest = keys.where(inside)
        if crowded and width < 30:
            width += PREFIX
            level = _prefix_counts(rest, width)
            open_cuts = narrowed
            continue
        found = defaultdict(list)
        for r in rest.collect():  # at most SMALL keys per open cut
            found[r["g"]].append(r["k"])
        for (g, i), (p, rank) in narrowed.items():
            answer[g][i] = sorted(k for k in found[g] if k.startswith(p))[rank - 1]
        break
    return sizes, answer


def take(
    df: DataFrame,
    size_of: Callable[[dict[str, int]], dict[str, int]],
    group: str | None = None,
    ident: str = "msg_id",
    seed: int = 42,
) -> DataFrame:
    """Exactly ``size_of(class sizes)`` rows per class."""
    _, cuts = cut_keys(df, lambda s: {g: [k] for g, k in size_of(s).items()}, group, ident, seed)
    key = order_key(ident, seed)
    keep = F.lit(False)
    for g, (cut,) in cuts.items():
        if cut is not None:
            inside = key <= F.lit(cut)
            keep = keep | (inside if group is None else inside & (F.col(group).cast("string") == g))
    return df.where(keep)


def sample_balanced(df: DataFrame, size: int, label: str = "label", seed: int = 42) -> DataFrame:
    return take(df, lambda s: {g: min(size // 2, n) for g, n in s.items()}, label, seed=seed)


def sample_proportional(df: DataFrame, size: int, label: str = "label", seed: int = 42) -> DataFrame:
    def sizes(s):
        total = sum(s.values())
        return {g: min(size * n // total, n) for g, n in s.items()}

    return take(df, sizes, label, seed=seed)


def sample_cap(df: DataFrame, cap: int = 5000, label: str = "label", seed: int = 42) -> DataFrame:
    return take(df, lambda s: {g: min(cap, n) for g, n in s.items()}, label, seed=seed)


def sample_uniform(df: DataFrame, n: int = 10_000, gate: int = 150_000, seed: int = 42) -> DataFrame:
    """``n`` rows of tables above ``gate`` rows; smaller tables stay whole."""
    return take(df, lambda s: {g: (min(n, m) if m > gate else m) for g, m in s.items()}, seed=seed)


def undersample(df: DataFrame, label: str = "label", ident: str = "msg_id", seed: int = 42) -> DataFrame:
    """Cut every class to the size of the smallest."""
    return take(df, lambda s: {g: min(s.values()) for g in s}, label, ident, seed)


def split(
    df: DataFrame,
    names: list[str],
    sizes: Callable[[int], list[int]],
    group: str | None = None,
    ident: str = "msg_id",
    seed: int = 42,
) -> DataFrame:
    """Append a ``split`` column; part sizes are exact (per class if grouped).

    Rows with a null class get a null split.
    """

    def ranks(class_sizes):
        out = {}
        for g, n in class_sizes.items():
            ends, total = [], 0
            for s in sizes(n)[:-1]:
                total += s
                ends.append(total)
            out[g] = ends
        return out

    _, cuts = cut_keys(df, ranks, group, ident, seed)
    key = order_key(ident, seed)
    column = F.lit(None).cast("string")
    for g, ends in cuts.items():
        part = F.lit(names[-1])
        for name, cut in reversed(list(zip(names, ends))):
            if cut is not None:
                part = F.when(key <= F.lit(cut), name).otherwise(part)
        column = part if group is None else F.when(F.col(group).cast("string") == g, part).otherwise(column)
    return df.withColumn("split", column)


def three_way_sizes(n: int) -> list[int]:
    """70 / 15 / 15: the hold-out is rounded up, then halved, test rounded up."""
    held = math.ceil(0.3 * n)
    test = math.ceil(0.5 * held)
    return [n - held, held - test, test]


def two_way_sizes(test_size: float) -> Callable[[int], list[int]]:
    def sizes(n):
        test = math.ceil(test_size * n)
        return [n - test, test]

    return sizes


def split_3way(df: DataFrame, group: str | None = None, ident: str = "msg_id", seed: int = 42) -> DataFrame:
    return split(df, ["train", "val", "test"], three_way_sizes, group, ident, seed)


def split_train_test(
    df: DataFrame, test_size: float = 0.2, group: str | None = "label", ident: str = "msg_id", seed: int = 42
) -> DataFrame:
    return split(df, ["train", "test"], two_way_sizes(test_size), group, ident, seed)
