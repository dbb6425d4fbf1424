"""Running sums and exact quantiles over an ordered column of any size.

A plain ordered window without a partition would pull the whole table into one
task. Here equal keys are combined first (a score shared by a third of all rows
becomes one row), the key range is cut at approximate quantiles, and each slice
is summed on its own and shifted by the totals of the slices before it. Where
the cuts fall changes only the balance, never the result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_SLICES = 4096
CHUNK = 64


def slice_count(df: DataFrame) -> int:
    """Number of slices: a few per shuffle partition, at most ``MAX_SLICES``."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(8, min(MAX_SLICES, 4 * parts))


def count_not_above(value: Column, cuts: list[float], strict: bool) -> Column:
    """How many of the sorted ``cuts`` are < value (``strict``) or <= value.

    Two levels of about sqrt(len) comparisons each instead of one long scan.
    """
    if not cuts:
        return F.lit(0)
    width = math.isqrt(len(cuts) - 1) + 1
    chunks = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    lasts = F.array(*[F.lit(float(c[-1])) for c in chunks])
    table = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in chunks])

    def passed(x):
        return (x < value) if strict else (x <= value)

    whole = F.size(F.filter(lasts, passed))
    part = F.coalesce(F.size(F.filter(F.get(table, whole), passed)), F.lit(0))
    # the last chunk may be shorter than the others
    return F.when(whole < len(chunks), whole * width + part).otherwise(len(cuts))


def _quantiles(df: DataFrame, key: str) -> Column:
    n = slice_count(df)
    # one literal, whatever the number of slices
    probs = F.split(F.lit(",".join(repr(i / n) for i in range(1, n))), ",").cast("array<double>")
    cuts = F.percentile_approx(F.col(key).cast("double"), probs, F.lit(10 * MAX_SLICES))
    return F.array_sort(F.array_distinct(F.coalesce(cuts, F.array().cast("array<double>"))))


def quantile_cuts(df: DataFrame, key: str) -> list[float]:
    """Approximate inner quantiles as a sorted list of doubles."""
    return df.agg(_quantiles(df, key).alias("cuts")).first()["cuts"]


def group_cuts(df: DataFrame, key: str, group: str) -> DataFrame:
    """(_c_group, _cuts): the quantiles of each group in chunks of ``CHUNK``.

    One row per class, feature or split name; the cuts stay data, so the plan
    does not grow with them.
    """
    cuts = df.groupBy(F.col(group).alias("_c_group")).agg(_quantiles(df, key).alias("_all"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("_all"), F.lit(1)), F.lit(CHUNK))
    return cuts.select("_c_group", F.transform(starts, lambda i: F.slice("_all", i, CHUNK)).alias("_cuts"))


def below_in_chunks(value: Column, chunks: Column) -> Column:
    """How many of the sorted, chunked cuts are < value."""
    whole = F.size(F.filter(chunks, lambda c: F.coalesce(F.element_at(c, -1) < value, F.lit(False))))
    part = F.coalesce(F.size(F.filter(F.get(chunks, whole), lambda x: x < value)), F.lit(0))
    return whole * CHUNK + part


def running_sums(
    df: DataFrame, key: str, sums: list[str], group: str | None = None, descending: bool = False
) -> DataFrame:
    """One row per distinct key with inclusive running sums ``cum_<name>``.

    ``all_<name>`` is the total of the group. ``sums`` must be integer columns,
    so the order of addition is irrelevant.
    """
    # a computed key, so that both uses of the totals keep their own column
    df = df.withColumn(key, F.col(key) + F.lit(0))
    keys = [key] if group is None else [group, key]
    per_key = df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
    value = F.col(key).cast("double")
    if group is None:
        slot = count_not_above(value, quantile_cuts(df, key), strict=True)
    else:
        cuts = group_cuts(df, key, group)
        per_key = per_key.join(F.broadcast(cuts), F.col(group).eqNullSafe(F.col("_c_group")))
        slot = below_in_chunks(value, F.col("_cuts"))
    per_key = per_key.withColumn("_slice", -slot if descending else slot)

    by = [] if group is None else [group]
    # at most MAX_SLICES rows per group
    totals = per_key.groupBy(*by, "_slice").agg(*[F.sum(c).alias(c) for c in sums])
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        *[F.col(b).alias(f"_g_{b}") for b in by],
        F.col("_slice").alias("_o"),
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_before_{c}") for c in sums],
        *[F.sum(c).over(whole).alias(f"all_{c}") for c in sums],
    )
    on = F.col("_slice") == F.col("_o")
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"_g_{b}"))
    order = F.col(key).desc() if descending else F.col(key).asc()
    inside = (
        Window.partitionBy(*by, "_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    )
    out = per_key.join(F.broadcast(offsets), on)
    return out.select(
        *keys,
        *sums,
        *[(F.sum(c).over(inside) + F.col(f"_before_{c}")).alias(f"cum_{c}") for c in sums],
        *[f"all_{c}" for c in sums],
    )


def exact_quantiles(df: DataFrame, key: str, probs: dict[str, float], group: str) -> DataFrame:
    """Exact linearly interpolated quantiles per group, one column per name."""
    ones = df.where(F.col(key).isNotNull()).select(
        group, F.col(key).cast("double").alias(key), F.lit(1).cast("bigint").alias("n")
    )
    at = running_sums(ones, key, ["n"], group)

    def value_at(position):
        inside = (position < F.col("cum_n")) & (position >= F.col("cum_n") - F.col("n"))
        return F.max(F.when(inside, F.col(key)))

    cols = []
    for name, q in probs.items():
        pos = F.lit(float(q)) * (F.col("all_n") - 1)
        low, high = value_at(F.floor(pos)), value_at(F.ceil(pos))
        frac = F.max(pos - F.floor(pos))
        cols.append((low + (high - low) * frac).alias(name))
    return at.groupBy(group).agg(*cols)
