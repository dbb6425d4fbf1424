"""Vocabulary, scaling, training and stored artefacts."""

import random

import pytest
from pyspark.sql import functions as F

from mailsift.operators import balance, matrix, model, scale, tfidf
from mailsift.plans import learning
from mailsift.sources import artefacts

WORDS = "alpha beta gamma delta omega kappa sigma theta zeta iota".split()


@pytest.fixture(scope="module")
def mail(spark):
    rng = random.Random(7)
    rows = []
    for i in range(240):
        bad = i % 3 == 0
        words = rng.choices(WORDS[:5] if bad else WORDS[5:], k=12) + rng.choices(WORDS, k=4)
        body = " ".join(words) + (" urgent http://bit.ly/x" if bad else "")
        rows.append((i, "a@b.com", None, f"note {i}", body, "phishing" if bad else "legitimate"))
    schema = "msg_id long, `from` string, reply_to string, subject string, body string, label string"
    return spark.createDataFrame(rows, schema).cache()


def test_pruned_vocabulary_equals_full_count(spark, mail):
    text = mail.select("msg_id", F.col("body").alias("text"))
    for limit in (5, 40, 100_000):
        got = tfidf.fit(text, "text", limit, min_df=3)
        words = tfidf.with_words(text, "text", tfidf.STOP_WORDS)
        from mailsift.functions.text import word_ngrams

        grams = F.concat(*[word_ngrams(F.col("_words"), n) for n in (1, 2, 3)])
        full = tfidf.gram_counts(words.select("_words"), grams).where("df >= 3 AND df <= 192")
        want = full.orderBy(F.desc("cf"), "term").limit(limit).collect()
        assert dict(zip(got.terms, zip(got.corpus_counts, got.document_counts))) == {
            r["term"]: (r["cf"], r["df"]) for r in want
        }


def test_rows_have_unit_norm_or_are_empty(mail):
    text = mail.select("msg_id", F.when(F.col("msg_id") < 3, "zzz").otherwise(F.col("body")).alias("text"))
    m = tfidf.fit(text, "text", 50)
    norm = F.aggregate("tfidf_weight", F.lit(0.0), lambda a, x: a + x * x)
    rows = tfidf.transform(text, m).select("msg_id", norm.alias("n"), F.size("tfidf_index").alias("k")).collect()
    assert all(r["n"] == pytest.approx(1.0) if r["k"] else r["n"] == 0 for r in rows)
    assert sum(r["k"] == 0 for r in rows) == 3


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(0.1, 1), (0.1, None), (0.1, 3)], "a double, b int")
    m = scale.fit(df, ["a", "b"])
    got = scale.transform(df, m).collect()
    assert [round(r["a"], 9) for r in got] == [0.0, 0.0, 0.0]
    assert sum(r["b"] for r in got) == pytest.approx(0)


def test_dense_row_matches_sparse(mail):
    m = matrix.fit(mail, 30)
    rows = matrix.transform(mail, m).select("msg_id", "tfidf_index", "tfidf_weight", matrix.dense_row(m).alias("x")).collect()
    for r in rows[:20]:
        assert len(r["x"]) == m.width
        assert {i: w for i, w in enumerate(r["x"][: len(m.tfidf.terms)]) if w} == dict(zip(r["tfidf_index"], r["tfidf_weight"]))


def test_train_score_save_load(spark, mail, tmp_path):
    t = model.train(mail, max_terms=30, hidden=(6,), max_iter=30, strategy="combined")
    acc = {r["split"]: r["accuracy"] for r in model.accuracy(t.scored).collect()}
    assert acc["test"] > 0.9
    scored = model.score(mail.drop("from", "reply_to"), t.model)
    assert {"phishing_probability", "prediction", "prediction_label"} <= set(scored.columns)
    artefacts.save_model(spark, t.model, str(tmp_path / "m"))
    again = artefacts.load_model(spark, str(tmp_path / "m"))
    assert again.threshold == t.model.threshold
    a = {r["msg_id"]: r["phishing_probability"] for r in model.score(mail, t.model).collect()}
    b = {r["msg_id"]: r["phishing_probability"] for r in model.score(mail, again).collect()}
    assert max(abs(a[i] - b[i]) for i in a) <= 1e-10
    none = model.score(mail, model.with_threshold(again, 1.1)).agg(F.sum("prediction")).head()[0]
    assert none == 0
    with pytest.raises(ValueError):
        model.score(mail.drop("body"), t.model)


def test_the_network_is_fitted_on_all_training_rows(spark, mail, monkeypatch):
    """Rows above a bound were left out by ``sampling.take``."""
    seen, fit = [], model.fit_stages

    def taken(df, size_of, *args, **kwargs):
        raise AssertionError("training rows were sampled")

    def fit_seen(rows, *args, **kwargs):
        seen.append(rows.count())
        return fit(rows, *args, **kwargs)

    monkeypatch.setattr(model.sampling, "take", taken)
    monkeypatch.setattr(model, "fit_stages", fit_seen)
    t = model.train(mail, max_terms=30, hidden=(4,), max_iter=2, strategy="none")
    assert seen == [168] and t.scored.count() == 72 and t.fit.iterations <= 2


@pytest.fixture
def two_variants(spark, mail, monkeypatch):
    """Mail of which 40 rows have no label, two small variants, and the rows of every
    feature computation."""
    mixed, made, rows_of = mail.withColumn("label", F.when(F.col("msg_id") >= 40, F.col("label"))), [], matrix.numeric_rows

    def counted(df, keep):
        made.append(df.count())
        return rows_of(df, keep)

    small = {"max_terms": 30, "hidden": (4,), "max_iter": 2}
    monkeypatch.setattr(matrix, "numeric_rows", counted)
    monkeypatch.setattr(learning.views, "plain_mail", lambda spark, sf: mixed)
    monkeypatch.setattr(learning, "VARIANTS", {v: {"strategy": v} | small for v in ("none", "combined")})
    return mixed, made


def test_variants_share_their_features(spark, two_variants):
    """Each variant made all features anew."""
    _, made = two_variants
    got = learning.train_variants(spark, "variants").collect()
    assert sorted((r.variant, r.split) for r in got) == [(v, s) for v in ("combined", "none") for s in ("test", "val")]
    assert made == [200]


def test_the_score_table_uses_the_features_of_the_training(spark, two_variants):
    """Features of labelled mail were made twice."""
    mixed, made = two_variants
    table = {r.msg_id: r for r in learning.score_table(spark, "table").collect()}
    assert made == [200, 40]
    want = model.score(mixed, learning.trained(spark, "table").model).collect()
    assert len(table) == len(want) == 240
    for r in want:
        got = table[r.msg_id]
        assert got.label == r.label and got.prediction == r.prediction
        assert got.phishing_probability == pytest.approx(r.phishing_probability, abs=1e-9)


def test_cells_are_balanced_like_dense_rows(spark):
    rng = random.Random(3)
    rows = [(i, int(i % 4 == 0), [rng.choice([0.0, 0.0, rng.random()]) for _ in range(6)]) for i in range(60)]
    dense = spark.createDataFrame(rows, "msg_id long, y int, x array<double>")
    cells = dense.select("msg_id", "y", *matrix.sparse_cells("x"), F.size("x").alias("width"))
    for strategy in ("none", "undersample", "oversample", "combined"):
        a = balance.balance(dense, strategy).select("msg_id", "y", "synthetic", *matrix.sparse_cells("x"))
        b = balance.balance(cells, strategy).select(a.columns)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_ngrams_counted_by_slices_are_all_of_them(spark, monkeypatch):
    monkeypatch.setattr(tfidf, "SLICE_WORDS", 3)
    rows = [(["aa", "bb", "aa", "bb"],), (["bb"],), ([],), (None,), (["cc", "aa", "bb", "aa"],)]
    df = spark.createDataFrame(rows, "_words array<string>")
    got = {r.term: (r.cf, r.df) for r in tfidf.ngram_counts(df, (1, 2)).collect()}
    assert got == {"aa": (4, 2), "bb": (4, 3), "cc": (1, 1), "aa bb": (3, 2), "bb aa": (2, 2), "cc aa": (1, 1)}
    few = {r.term: r.cf for r in tfidf.ngram_counts(df, (2,), {1: ["aa", "bb"]}).collect()}
    assert few == {"aa bb": 3, "bb aa": 2}
