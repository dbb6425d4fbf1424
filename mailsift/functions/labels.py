"""Label spellings and the columns derived from a label or a score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailsift.functions.text import strip_ws

PHISHING = "phishing"
LEGITIMATE = "legitimate"

# --- fixed values --------------------------------------------------------------
PHISHING_SPELLINGS = ["spam", "phish", "malicious", "bad", "1", "1.0", "true"]
LEGITIMATE_SPELLINGS = ["ham", "legit", "benign", "good", "0", "0.0", "false"]
PASS_PHISHING = ["1", "spam", "phish", "phishing"]
PASS_LEGITIMATE = ["0", "ham", "legitimate", "legit"]
# --------------------------------------------------------------------------------


def normalize(label: Column) -> Column:
    """Known spellings to the two class names, everything else to null."""
    low = F.lower(label)
    return (
        F.when(low.isin([*PHISHING_SPELLINGS, PHISHING]), PHISHING)
        .when(low.isin([*LEGITIMATE_SPELLINGS, LEGITIMATE]), LEGITIMATE)
    )


def passthrough(label: Column) -> Column:
    """Four spellings per class; other values are kept, null is 'unknown'."""
    low = F.lower(label)
    return (
        F.when(label.isNull(), "unknown")
        .when(low.isin(PASS_PHISHING), PHISHING)
        .when(low.isin(PASS_LEGITIMATE), LEGITIMATE)
        .otherwise(label)
    )


def numeric(label: Column) -> Column:
    """1 and 0 to the class names, other numbers to null."""
    return F.when(label == 1, PHISHING).when(label == 0, LEGITIMATE)


def from_path(path: Column) -> Column:
    """Class named by a file path; 'ham' also matches inside longer words."""
    low = F.lower(path)
    name = F.substring_index(low, "/", -1)
    return (
        F.when(low.contains("phish") | name.contains("spam"), PHISHING)
        .when(low.contains("legit") | name.contains("ham"), LEGITIMATE)
    )


def from_dump_name(path: Column) -> Column:
    """Class of the records of a dump: phishing if the file name says so."""
    name = F.substring_index(F.lower(path), "/", -1)
    return F.when(name.contains("phish"), PHISHING).otherwise("unknown")


def evaluation_target(label: Column) -> Column:
    """1 for phishing after trimming, 0 for anything else."""
    return F.coalesce((strip_ws(F.lower(label)) == PHISHING).cast("int"), F.lit(0))


def training_target(label: Column) -> Column:
    """1 / 0 for the exact class names, null otherwise."""
    return F.when(label == PHISHING, 1).when(label == LEGITIMATE, 0)


def predict(p: Column, threshold: float = 0.5) -> Column:
    return (p >= F.lit(float(threshold))).cast("int")


def prediction_label(prediction: Column) -> Column:
    return F.when(prediction == 1, PHISHING).otherwise(F.lit(LEGITIMATE))


def confidence(p: Column) -> Column:
    gap = F.abs(p - 0.5)
    return F.when(gap > 0.4, "high").when(gap > 0.2, "medium").otherwise("low")
