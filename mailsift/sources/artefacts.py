"""Saving and loading everything fitted, as tables and a Spark ML model."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml.classification import MultilayerPerceptronClassificationModel
from pyspark.sql import SparkSession

from mailsift.operators.matrix import FeatureModel
from mailsift.operators.model import MailModel
from mailsift.operators.scale import ScalerModel
from mailsift.operators.tfidf import TfidfModel


def save_model(spark: SparkSession, model: MailModel, path: str) -> None:
    """Vocabulary, scaler and settings are bounded tables (width of the matrix)."""
    v, s = model.features.tfidf, model.features.scaler
    tables = {
        "vocabulary": (
            list(zip(v.terms, v.document_counts, v.corpus_counts)), "term string, df bigint, cf bigint"
        ),
        "scaler": (list(zip(s.columns, s.means, s.scales)), "feature string, mean double, scale double"),
        "settings": (
            [(v.documents, list(v.orders), v.stop_words, model.threshold, list(s.columns))],
            "documents bigint, orders array<int>, stop_words array<string>, threshold double, columns array<string>",
        ),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")
    model.network.write().overwrite().save(f"{path}/network")


def load_model(spark: SparkSession, path: str) -> MailModel:
    settings = spark.read.parquet(f"{path}/settings").head()
    vocabulary = spark.read.parquet(f"{path}/vocabulary").orderBy("term").collect()
    columns = list(settings["columns"])
    try:
        params = {r["feature"]: r for r in spark.read.parquet(f"{path}/scaler").collect()}
    except AnalysisException:  # stored without a scaler: features stay unscaled
        params = {c: {"mean": 0.0, "scale": 1.0} for c in columns}
    return MailModel(
        features=FeatureModel(
            TfidfModel(
                [r["term"] for r in vocabulary], [r["df"] for r in vocabulary], [r["cf"] for r in vocabulary],
                settings["documents"], tuple(settings["orders"]), list(settings["stop_words"]),
            ),
            ScalerModel(columns, [params[c]["mean"] for c in columns], [params[c]["scale"] for c in columns]),
        ),
        network=MultilayerPerceptronClassificationModel.load(f"{path}/network"),
        threshold=settings["threshold"],
    )
