"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact length. Each source's budget is
filled from these counts: an equal share of every length, then the longest that
still fit, then a bounded knapsack over the short lengths for what remains.
Within a length, documents are taken in seeded hash order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailsift.llm.common import WORD, blank, stored

#: Largest remaining budget, in words, that the knapsack fits exactly.
KNAPSACK = 8192
#: Slices of the hash range in which the rank of a document is found.
SLICES = 1024


def targets(sized: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target): one row per source, the only rows that
    meet in one task.

    Sources ordered by code point, null last, weigh ``weights`` in turn and
    share ``share`` times all sizes. What lies above ``cap`` times a source's
    size is shared by the others by weight until none is above.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    ranked = by_source.withColumn("weight", weight).withColumn("full", cap * F.col("source_size"))
    # Sources reach their cap in the order of full / weight: with those before it
    # at their cap, a source is capped too if its share of the rest is above.
    order = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = (share * F.sum("source_size").over(whole) - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    ranked = ranked.withColumn("level", rest)
    open_ = ranked.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("full"), F.struct((F.col("full") / F.col("weight")).alias("o"), "level"))).over(whole)["level"])
    target = F.least("full", F.coalesce(F.col("level") * F.col("weight"), F.col("full")))
    return open_.select("source", "source_size", target.alias("target"))


def fill(sizes: np.ndarray, counts: np.ndarray, budget: int, knapsack: int = KNAPSACK) -> np.ndarray:
    """How many documents of each size to take for a sum near ``budget``."""
    total = int((sizes * counts).sum())
    if budget >= total:
        return counts.copy()
    take, share, words, used = np.zeros(len(sizes), np.int64), max(0, budget - knapsack) / total, 0, 0
    for k in np.argsort(sizes, kind="stable"):
        words += int(sizes[k] * counts[k])
        if sizes[k]:
            take[k] = max(0, min(int(counts[k]), int((share * words - used) // sizes[k])))
            used += int(take[k] * sizes[k])
    left = budget - used
    longest = np.argsort(-sizes, kind="stable")
    for k in longest:
        if left > knapsack and 0 < sizes[k] <= left:
            size = int(sizes[k])
            more = min(int(counts[k] - take[k]), left // size, -(-(left - knapsack) // size))
            take[k] += more
            left -= more * size
    # before[s]: sum s can be made of the documents so far, in lots of 1, 2, 4, ...
    goal = int(min(left, knapsack))
    before, steps = np.zeros(goal + 1, bool), []
    before[0] = True
    for k in longest:
        size, rest, lot = int(sizes[k]), int(counts[k] - take[k]), 1
        while rest > 0 and 0 < lot * size <= goal and not before[goal]:
            lot = min(lot, rest)
            after = before.copy()
            after[lot * size :] |= before[: goal + 1 - lot * size]
            steps.append((k, lot, before))
            before, rest, lot = after, rest - lot, 2 * lot
    s = int(np.flatnonzero(before).max())
    for k, lot, without in reversed(steps):
        if not without[s]:
            take[k] += lot
            s -= lot * int(sizes[k])
    return take


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 11,
    weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, knapsack: int = KNAPSACK,
) -> DataFrame:
    """``row`` (all columns of ``docs``) with size, source_size, target, times
    and taken.

    times is how often the mix takes a document: never, once or twice; taken is
    that many times its words. A null source is a source; a null or empty text
    has size 0, one of any length its whole size. Documents of a source and length are taken in the order of a
    seeded hash of id and text, so reruns agree; rows that agree in id and text
    are taken alike. Null ids count as any other. Extra columns may have any
    name. An empty table gives no rows.
    """
    if cap > 2:
        raise ValueError("a document is taken twice at most")
    narrow = stored(_measured(docs, id_col, text_col, source_col, seed))
    counted = narrow.groupBy("source", "size").agg(F.count("*").alias("n"))
    goal = targets(narrow, weights, share, cap)
    plan = stored(_plan(_on(counted, goal, ["source"], ["size", "n"], ["source_size", "target"]), knapsack))
    # Before each slice: how many documents of that source and size come earlier.
    sliced = narrow.groupBy("source", "size", "slice").agg(F.count("*").alias("here"))
    earlier = F.sum("here").over(Window.partitionBy("source", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    sliced = sliced.withColumn("earlier", F.coalesce(earlier, F.lit(0)))
    partial = _on(sliced, plan, ["source", "size"], ["slice", "here", "earlier"], ["more"]).where("earlier < more and more <= earlier + here")
    rank = F.row_number().over(Window.partitionBy("source", "size").orderBy("h"))
    inside = _on(narrow, partial, ["source", "size", "slice"], ["h"], ["more", "earlier"]).withColumn("rank", rank)
    last = inside.where("rank = more - earlier").select("source", "size", F.struct("slice", "h").alias("last"))
    cuts = plan.join(last.withColumnsRenamed({"source": "s", "size": "z"}), F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")), "left").drop("s", "z")
    each = _measured(docs, id_col, text_col, source_col, seed, whole=True)
    each = _on(each, cuts, ["source", "size"], ["row", "slice", "h"], ["source_size", "target", "base", "last"])
    times = F.col("base") + F.when(F.struct("slice", "h") <= F.col("last"), 1).otherwise(0)
    return each.select("row", "size", "source_size", "target", times.alias("times"), (times * F.col("size")).alias("taken"))


def _measured(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, whole: bool = False) -> DataFrame:
    text, slices = F.col(text_col), F.lit(SLICES)
    h = F.xxhash64(F.lit(seed), F.col(id_col), F.xxhash64(text))
    columns = [F.col(source_col).alias("source"), F.regexp_count(blank(text), F.lit(WORD)).cast("long").alias("size"), h.alias("h")]
    columns.append(F.pmod(F.shiftrightunsigned(h, 20), slices).cast("int").alias("slice"))
    return docs.select(*columns, *([F.struct("*").alias("row")] if whole else []))


def _on(a: DataFrame, b: DataFrame, keys: list[str], of_a: list[str], of_b: list[str]) -> DataFrame:
    """Inner join in which nulls of the keys agree."""
    b = b.select(*[F.col(k).alias(f"_{k}") for k in keys], *of_b)
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return a.select(*keys, *of_a).join(b, on).drop(*[f"_{k}" for k in keys])


def _plan(counted: DataFrame, knapsack: int) -> DataFrame:
    """base and more: whole rounds of a source, and documents of a size in the
    last, partial round. A group has one row per distinct length of a source."""
    kind = counted.schema["source"].dataType.simpleString()

    def work(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("size")
        total, target = int(b["source_size"].iloc[0]), float(b["target"].iloc[0])
        base = int(target // total) if total else 0
        left = round(target - base * total)
        more = fill(b["size"].to_numpy(), b["n"].to_numpy(), left, knapsack) if left else np.zeros(len(b), np.int64)
        return b[["source", "size", "source_size", "target"]].assign(base=base, more=more)

    return counted.groupBy("source").applyInPandas(work, f"source {kind}, size bigint, source_size bigint, target double, base bigint, more bigint")
