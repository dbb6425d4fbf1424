"""Evaluation of scored tables: y in {0, 1}, p a probability.

Undefined ratios are 0. Thresholds, curves and areas all start from one
aggregate per score value or grid step; no metric makes a pass per threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailsift.operators.prefix import count_not_above, running_sums

GRID = [i / 100 for i in range(1, 100)]
COARSE_GRID = [i / 100 for i in range(10, 95, 5)]
CURVE_METRICS = ["accuracy", "precision", "recall", "f1", "specificity"]


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _tally(y: Column, pred: Column) -> dict[str, Column]:
    def n(cond):
        return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("bigint")

    return {
        "tp": n((pred == 1) & (y == 1)),
        "fp": n((pred == 1) & (y == 0)),
        "tn": n((pred == 0) & (y == 0)),
        "fn": n((pred == 0) & (y == 1)),
    }


def from_counts(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    return {
        "accuracy": ratio(tp + tn, tp + fp + tn + fn),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "specificity": ratio(tn, tn + fp),
    }


def binary_metrics(df: DataFrame, by: list[str] | None = None, y: str = "y", pred: str = "prediction") -> DataFrame:
    cells = df.groupBy(*(by or [])).agg(
        *[c.alias(n) for n, c in _tally(F.col(y), F.col(pred)).items()]
    )
    metrics = from_counts(*[F.col(c) for c in ("tp", "fp", "tn", "fn")])
    return cells.select(*(by or []), *[c.alias(n) for n, c in metrics.items()], "tp", "fp", "tn", "fn")


def metrics_at(df: DataFrame, threshold: float, y: str = "y", p: str = "p") -> DataFrame:
    pred = df.withColumn("prediction", (F.col(p) >= F.lit(float(threshold))).cast("int"))
    return binary_metrics(pred, y=y).withColumn("threshold", F.lit(float(threshold)))


def threshold_sweep(df: DataFrame, grid: list[float] = GRID, y: str = "y", p: str = "p") -> DataFrame:
    """All metrics at every threshold of the sorted grid, from one pass.

    Each row is assigned the number of thresholds it passes; after the groupBy
    there are at most len(grid) + 1 rows, over which the window sums.
    """
    step = count_not_above(F.col(p), grid, strict=False)
    per_step = df.where(F.col(p).isNotNull() & F.col(y).isin(0, 1)).groupBy(step.alias("passed")).agg(
        F.sum((F.col(y) == 1).cast("bigint")).alias("pos"),
        F.sum((F.col(y) == 0).cast("bigint")).alias("neg"),
    )
    thresholds = F.array(*[F.lit(t) for t in grid])
    steps = df.sparkSession.range(0, len(grid) + 1).select(F.col("id").cast("int").alias("passed"))
    filled = steps.join(F.broadcast(per_step), "passed", "left").na.fill(0, ["pos", "neg"])
    above = Window.partitionBy().orderBy(F.desc("passed")).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    cells = filled.select(
        "passed",
        F.sum("pos").over(above).alias("tp"),
        F.sum("neg").over(above).alias("fp"),
        F.sum("pos").over(everything).alias("_p"),
        F.sum("neg").over(everything).alias("_n"),
    ).where(F.col("passed") >= 1)
    cells = cells.select(
        F.element_at(thresholds, F.col("passed")).alias("threshold"),
        "tp",
        "fp",
        (F.col("_n") - F.col("fp")).alias("tn"),
        (F.col("_p") - F.col("tp")).alias("fn"),
    )
    metrics = from_counts(*[F.col(c) for c in ("tp", "fp", "tn", "fn")])
    return cells.select("threshold", *[c.alias(n) for n, c in metrics.items()], "tp", "fp", "tn", "fn")


def best_threshold(sweep: DataFrame, metric: str = "f1") -> DataFrame:
    """The first threshold that reaches the maximum of ``metric``."""
    if metric not in ("f1", "accuracy", "precision", "recall"):
        raise ValueError(f"cannot optimise {metric!r}")
    return sweep.orderBy(F.desc(F.round(metric, 12)), F.asc("threshold")).limit(1)


def threshold_long(sweep: DataFrame) -> DataFrame:
    """The sweep as (threshold, metric, value) rows, the data of the plot."""
    return sweep.unpivot("threshold", CURVE_METRICS, "metric", "value")


def _cumulative(df: DataFrame, y: str, p: str) -> DataFrame:
    """Per distinct score, descending: class counts and running totals."""
    flags = df.where(F.col(p).isNotNull() & F.col(y).isin(0, 1)).select(
        F.col(p).cast("double").alias("p"),
        (F.col(y) == 1).cast("bigint").alias("pos"),
        (F.col(y) == 0).cast("bigint").alias("neg"),
    )
    return running_sums(flags, "p", ["pos", "neg"], descending=True)


def roc_curve(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """False and true positive rate at every distinct score."""
    return _cumulative(df, y, p).select(
        F.col("p").alias("threshold"),
        ratio(F.col("cum_neg"), F.col("all_neg")).alias("fpr"),
        ratio(F.col("cum_pos"), F.col("all_pos")).alias("tpr"),
    )


def roc_auc(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Exact area under the ROC curve, ties count one half."""
    d = F.col
    area = d("neg").cast("double") * (d("cum_pos") - d("pos") / 2.0)
    sums = _cumulative(df, y, p).agg(
        F.sum(area).alias("a"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    pairs = d("pos").cast("double") * d("neg")
    return sums.select(ratio(d("a"), pairs).alias("auc"))


def pr_curve(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Precision and recall at every distinct score."""
    return _cumulative(df, y, p).select(
        F.col("p").alias("threshold"),
        ratio(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")).alias("precision"),
        ratio(F.col("cum_pos"), F.col("all_pos")).alias("recall"),
    )


def pr_auc(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Trapezoid area under the PR curve, starting at precision 1, recall 0.

    Running totals before and after each score are both on its row, so the
    previous curve point needs no second ordered pass.
    """
    d = F.col
    prev_pos, prev_neg = d("cum_pos") - d("pos"), d("cum_neg") - d("neg")
    here = d("cum_pos") / (d("cum_pos") + d("cum_neg"))
    before = F.when(prev_pos + prev_neg > 0, prev_pos / (prev_pos + prev_neg)).otherwise(1.0)
    sums = _cumulative(df, y, p).agg(
        F.sum(d("pos") * (here + before) / 2.0).alias("a"), F.sum("pos").alias("pos")
    )
    return sums.select(ratio(d("a"), d("pos")).alias("auc"))


def confusion_matrix(df: DataFrame, y: str = "y", pred: str = "prediction") -> DataFrame:
    return (
        df.groupBy(F.col(y).alias("true_label"))
        .pivot(pred, [0, 1])
        .agg(F.count(F.lit(1)))
        .na.fill(0)
        .select("true_label", F.col("0").alias("pred_0"), F.col("1").alias("pred_1"))
    )


def classification_report(df: DataFrame, y: str = "y", pred: str = "prediction") -> DataFrame:
    """Per class, accuracy, macro and weighted rows in long form."""
    one = df.agg(*[c.alias(n) for n, c in _tally(F.col(y), F.col(pred)).items()])
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))

    def row(precision, recall, f1, support):
        return [precision, recall, f1, support]

    c0 = row(ratio(tn, tn + fn), ratio(tn, tn + fp), ratio(2 * tn, 2 * tn + fn + fp), tn + fp)
    c1 = row(ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(2 * tp, 2 * tp + fp + fn), tp + fn)
    n = tp + fp + tn + fn
    acc = ratio(tp + tn, n)
    macro = [(c0[i] + c1[i]) / 2 for i in range(3)] + [n]
    weighted = [ratio(c0[i] * c0[3] + c1[i] * c1[3], n) for i in range(3)] + [n]
    rows = {
        "legitimate": c0, "phishing": c1, "accuracy": [acc, acc, acc, n],
        "macro avg": macro, "weighted avg": weighted,
    }
    packed = F.array(
        *[
            F.struct(
                F.lit(name).alias("row"), v[0].alias("precision"), v[1].alias("recall"),
                v[2].alias("f1"), v[3].cast("bigint").alias("support"),
            )
            for name, v in rows.items()
        ]
    )
    return one.select(F.explode(packed).alias("x")).select("x.*")


def metrics_by_split(df: DataFrame, split: str = "split", y: str = "y", p: str = "p", threshold: float = 0.5) -> DataFrame:
    """Accuracy and exact ROC AUC per split."""
    flags = df.select(
        F.col(split).alias("split"),
        F.col(p).cast("double").alias("p"),
        (F.col(y) == 1).cast("bigint").alias("pos"),
        (F.col(y) == 0).cast("bigint").alias("neg"),
        ((F.col(p) >= threshold).cast("int") == F.col(y)).cast("bigint").alias("hit"),
    )
    d = F.col
    area = d("neg").cast("double") * (d("cum_pos") - d("pos") / 2.0)
    sums = running_sums(flags, "p", ["pos", "neg", "hit"], "split", descending=True).groupBy("split").agg(
        F.sum(area).alias("a"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("hit").alias("hit")
    )
    return sums.select(
        "split",
        ratio(d("hit"), d("pos") + d("neg")).alias("accuracy"),
        ratio(d("a"), d("pos").cast("double") * d("neg")).alias("auc"),
        (d("pos") + d("neg")).alias("n"),
    )
