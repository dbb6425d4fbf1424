"""Samples, splits, neighbours and balancing."""

import hashlib
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mailsift.operators import balance, sampling


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.range(1000).select(
        F.col("id").alias("msg_id"), F.when(F.col("id") % 10 == 0, "phishing").otherwise("legitimate").alias("label")
    ).cache()


def test_sizes_are_exact(labelled):
    def sizes(df):
        return {r["label"]: r["count"] for r in df.groupBy("label").count().collect()}

    assert sizes(sampling.sample_balanced(labelled, 301)) == {"phishing": 100, "legitimate": 150}
    assert sizes(sampling.sample_proportional(labelled, 55)) == {"phishing": 5, "legitimate": 49}
    assert sizes(sampling.sample_cap(labelled, 120)) == {"phishing": 100, "legitimate": 120}
    assert sizes(sampling.undersample(labelled)) == {"phishing": 100, "legitimate": 100}
    assert sampling.sample_uniform(labelled, n=10, gate=999).count() == 10
    assert sampling.sample_uniform(labelled, n=10, gate=1000).count() == 1000


def test_samples_follow_the_digest_order_across_levels(labelled, monkeypatch):
    monkeypatch.setattr(sampling, "SMALL", 1)
    monkeypatch.setattr(sampling, "PREFIX", 1)
    got = {r["msg_id"] for r in sampling.sample_uniform(labelled, n=37, gate=0).collect()}
    order = sorted(range(1000), key=lambda i: hashlib.md5(f"{i}-42".encode()).hexdigest())
    assert got == set(order[:37])


def test_splits_are_disjoint_and_cover(labelled):
    parts = sampling.split_3way(labelled).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in parts} == {"train": 700, "val": 150, "test": 150}
    strat = sampling.split_train_test(labelled).where("split = 'test'").groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in strat} == {"phishing": 20, "legitimate": 180}


def brute(vectors, k):
    out = {}
    for i, (a, x) in enumerate(vectors):
        d = sorted((round(float(np.sqrt(((x - y) ** 2).sum())), 9), b) for j, (b, y) in enumerate(vectors) if j != i)
        out[a] = [b for _, b in d[:k]]
    return out


def knn_lists(df, k, block=4096):
    out = {}
    for r in balance.knn_sparse(balance.sparse(df), k, block).orderBy("msg_id", "rank").collect():
        out.setdefault(r["msg_id"], []).append(r["neighbor"])
    return out


@pytest.mark.parametrize("block", [4096, 50])
def test_knn_equals_brute_force(spark, block):
    rng = np.random.default_rng(1)
    vectors = [(i, rng.normal(size=3) + (i % 4) * 5) for i in range(600)]
    # a third of all rows is one vector
    vectors = [(i, np.ones(3) if i % 3 == 0 else x) for i, x in vectors]
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in vectors], "msg_id long, x array<double>")
    assert knn_lists(df, 4, block) == brute(vectors, 4)


@pytest.mark.parametrize("block", [4096, 40])
def test_knn_of_sparse_rows_with_some_common_cells(spark, monkeypatch, block):
    """Few cells a row, three that all have, rows of none; like lengths and unlike."""
    monkeypatch.setattr(balance, "PAIRS", 500)
    rng = np.random.default_rng(3)
    vectors = []
    for i in range(260):
        x = np.zeros(60)
        x[rng.choice(57, 4, replace=False)] = rng.normal(size=4)
        x[57:] = rng.normal(size=3) * (1 if i % 2 else 0.2)
        vectors.append((i, x * (1 + i % 5) if i % 13 else np.zeros(60)))
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in vectors], "msg_id long, x array<double>")
    assert knn_lists(df, 4, block) == brute(vectors, 4)


def test_knn_stores_and_moves_no_dense_rows(spark):
    df = spark.createDataFrame([(1, [0.0] * 50 + [1.0]), (2, [0.0] * 51)], "msg_id long, x array<double>")
    assert balance.sparse(df).where("msg_id = 1").first()[1:] == ([50], [1.0], 51)


def test_knn_of_few_rows(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [1.0])], "msg_id long, x array<double>")
    assert knn_lists(df, 5) == {1: [2], 2: [1]}


@pytest.mark.parametrize(
    "sizes, strategy, want",
    [
        ((10, 8), "combined", {0: 10, 1: 10}),
        ((10, 2), "combined", {0: 6, 1: 6}),
        ((10, 2), "oversample", {0: 10, 1: 10}),
        ((10, 2), "undersample", {0: 2, 1: 2}),
        ((10, 2), "none", {0: 10, 1: 2}),
        ((2, 10), "combined", {0: 6, 1: 6}),
        ((10, 0), "combined", {0: 10}),
    ],
)
def test_balance(spark, sizes, strategy, want):
    rows = [(i, [float(i), float(i * i)], int(i >= sizes[0])) for i in range(sum(sizes))]
    df = spark.createDataFrame(rows, "msg_id long, x array<double>, y int")
    out = balance.balance(df, strategy)
    assert {r["y"]: r["count"] for r in out.groupBy("y").count().collect()} == want


def test_smote_rows_lie_between_neighbours(spark):
    rows = [(i, [float(i)], int(i >= 20)) for i in range(26)]
    df = spark.createDataFrame(rows, "msg_id long, x array<double>, y int")
    new = balance.smote(df, k=2).collect()
    assert len(new) == 14
    for r in new:
        assert min(r["msg_id"], r["neighbor"]) <= r["x"][0] <= max(r["msg_id"], r["neighbor"])


def test_unknown_strategy(spark):
    df = spark.createDataFrame([(1, [0.0], 1)], "msg_id long, x array<double>, y int")
    with pytest.raises(ValueError):
        balance.balance(df, "smoteenn")


def test_the_products_of_two_blocks_are_not_held():
    """Copies and far rows among them; the peak is below one array of all pairs."""
    n = 1500
    x = np.random.default_rng(3).integers(0, 9, (n, 6)).astype(float)
    rows = pd.DataFrame({"msg_id": np.arange(n), "index": [np.arange(6)] * n, "value": [*x]})
    tracemalloc.start()
    got = balance._top_k(rows, rows, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * n * n
    for i in (0, 255, 256, 1499):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        want = np.lexsort((np.arange(n), np.round(d, 9)))[:3]
        assert got[got.msg_id == i].neighbor.tolist() == want.tolist()
