"""Writing result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailsift.operators import metrics
from mailsift.operators.report import json_results

#: CSV that comes back as it was: quotes doubled, line breaks kept, null and '' apart.
CSV = {"header": "true", "quote": '"', "escape": '"', "nullValue": "\\N", "multiLine": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", by: list[str] | None = None) -> None:
    """Parquet, CSV (with header) or JSON, optionally partitioned or appended."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.options(**CSV)
    if by:
        writer = writer.partitionBy(*by)
    writer.save(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet") -> DataFrame:
    """A table written by ``write_table``, with the types it had."""
    reader = spark.read.schema(schema).format(fmt)
    return (reader.options(**CSV) if fmt == "csv" else reader).load(path)


def write_thresholds(sweep: DataFrame, path: str, metric: str = "f1", fmt: str = "csv") -> None:
    """The table of a threshold sweep, and beside it the chosen threshold as a table
    of one row."""
    write_table(sweep, f"{path}/thresholds", fmt)
    write_table(metrics.best_threshold(sweep, metric), f"{path}/chosen", fmt)


def write_curves(df: DataFrame, path: str, y: str = "y", p: str = "p", threshold: float = 0.5, fmt: str = "csv") -> None:
    """Points of the ROC and PR curves and the confusion matrix at the threshold."""
    pred = df.withColumn("prediction", (F.col(p) >= threshold).cast("int"))
    write_table(metrics.roc_curve(df, y, p), f"{path}/roc", fmt)
    write_table(metrics.pr_curve(df, y, p), f"{path}/pr", fmt)
    write_table(metrics.confusion_matrix(pred, y), f"{path}/confusion", fmt)


def write_processed(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Per-source tables: one folder per table file, and one for all single mails."""
    name = F.substring_index("source_file", "/", -1)
    tag = F.when(F.lower(name).endswith(".eml"), "eml").otherwise(name)
    write_table(df.withColumn("source", tag), path, mode=mode, by=["source"])


def write_json_results(df: DataFrame, path: str, p: str = "p", verbose: bool = False) -> None:
    json_results(df, p, verbose).select("json").write.mode("overwrite").text(path)


def scalar_metrics(metrics: DataFrame) -> DataFrame:
    """The one-row metrics table: plain numbers only."""
    numbers = ("double", "float", "int", "bigint")
    return metrics.select(*[F.col(n) for n, t in metrics.dtypes if t in numbers])
