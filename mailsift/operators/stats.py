"""Counts, distributions and top lists of the corpus report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailsift.operators.prefix import exact_quantiles


def counts(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias(name))


def distribution(df: DataFrame, column: str, missing: str | None = None) -> DataFrame:
    """Rows per value with the share of the total in percent, one decimal.

    The total is an aggregate of the counts, so however many values there are,
    none meets all others in one task.
    """
    value = F.col(column) if missing is None else F.coalesce(F.col(column), F.lit(missing))
    n = counts(df.select(value.alias(column)), column)
    total = n.agg(F.sum("n")).scalar()
    return n.select(column, "n", F.round(F.col("n") * 100.0 / total, 1).alias("percent"))


def length_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, exact median, minimum and maximum character length per column."""
    long = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("field"), F.length(F.col(c)).alias("len")) for c in columns])
        ).alias("x")
    ).select("x.*")
    # one row per field and distinct length: all else follows from these few
    per = long.where("len is not null").groupBy("field", "len").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("field").orderBy("len").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("field")
    per = per.withColumns({"cum": F.sum("n").over(upto), "total": F.sum("n").over(whole)})
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)

    def at(position):
        return F.max(F.when((position < F.col("cum")) & (position >= F.col("cum") - F.col("n")), F.col("len")))

    return per.groupBy("field").agg(
        F.round(F.sum(F.col("len") * F.col("n")) / F.max("total"), 6).alias("mean_len"),
        F.min("len").cast("bigint").alias("min_len"),
        F.max("len").cast("bigint").alias("max_len"),
        ((at(low) + at(high)) / 2).alias("median_len"),
    )


def top_values(df: DataFrame, column: str, k: int = 3) -> DataFrame:
    """The k most frequent non-null values, ties by value."""
    n = counts(df.where(F.col(column).isNotNull()), column)
    return n.orderBy(F.desc("n"), F.asc(column)).limit(k)


def top_values_by(df: DataFrame, group: str, column: str, k: int = 10) -> DataFrame:
    """Top k per group. Spark limits each map task to k rows per group first."""
    n = df.where(F.col(column).isNotNull() & F.col(group).isNotNull())
    n = n.groupBy(group, column).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(group).orderBy(F.desc("n"), F.asc(column))
    return n.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, sample std, min, quartiles (linear) and max per column."""
    pairs = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns]
    long = df.select(F.explode(F.array(*pairs)).alias("x")).select("x.*")
    basic = long.groupBy("feature").agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = exact_quantiles(long, "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, "feature")
    return basic.join(F.broadcast(quartiles), "feature")  # one row per feature


def group_means(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    return df.groupBy(group).agg(*[F.avg(c).alias(c) for c in columns])


def imbalance(df: DataFrame, target: str = "label") -> DataFrame:
    """Majority and minority class sizes and their ratio."""
    n = counts(df.where(F.col(target).isNotNull()), target)
    return n.agg(
        F.max("n").alias("majority"),
        F.min("n").alias("minority"),
        (F.max("n") / F.min("n")).alias("ratio"),
    )


def source_stats(df: DataFrame, source: str = "source_file") -> DataFrame:
    """Rows per source with the number of columns of the table."""
    return (
        df.groupBy(source)
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count("label").alias("n_labelled"),
            F.sum(F.length("body")).alias("body_chars"),
        )
        .withColumn("n_columns", F.lit(len(df.columns)).cast("bigint"))
    )
