"""The numbered queries on whole small tables against plain re-statements."""

import math
import os
import sys
from collections import Counter

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402

from mailsift.llm import dropout_bpe  # noqa: E402
from mailsift.llm.queries import book  # noqa: E402

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def result(spark, name, folder=SMALL):
    return book.queries[name](spark, folder).collect()


def test_quality_base(spark, documents):
    rows = result(spark, "op1_quality_rules")
    assert len(rows) == len(documents)
    for r in rows:
        want = brute.quality(documents[r.doc_id].text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_quality_follows_labels(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{MORE}/labels.parquet").collect()}
    seen = [(labels[r.doc_id], r.kept) for r in result(spark, "op1_quality_rules", MORE) if r.doc_id in labels and not r.base_failed]
    good, bad = [k for q, k in seen if q == 1], [k for q, k in seen if q == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.1


@pytest.mark.parametrize("name, kinds", [("op2_secret_scan", brute.SECRETS), ("op4_pii", brute.PERSONAL)])
def test_base_spans(spark, documents, name, kinds):
    rows = result(spark, name)
    assert len(rows) == len(documents)
    for r in rows:
        want = brute.spans(documents[r.doc_id].text, kinds)
        assert r.base_sha256 == brute.sha(want)
        n = Counter(s.split(":")[0] for s in want.split(",") if s)
        assert all(r[f"n_{k}"] == n[k] for k, _, _ in kinds)
        assert set(want.split(",")) <= set(r.spans.split(","))


def test_simhash_classes(spark, documents):
    rows = sorted(result(spark, "op3_simhash"), key=lambda r: r.doc_id)
    fp = [int(r.fingerprint, 16) for r in rows]
    assert fp == [brute.fingerprint(documents[r.doc_id].text) for r in rows]
    want = brute.classes(len(rows), lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 4)
    assert [r.component_id for r in rows] == [rows[k].doc_id for k in want]
    assert len(set(want)) < len(rows)


def test_language_model(spark, documents):
    want = brute.unigram([(k, r.text) for k, r in documents.items()])
    rows = result(spark, "op5_suffix_lm")
    assert len(rows) == len(want)
    for r in rows:
        held, n, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0


def test_pieces_come_back(spark, documents):
    raw = dropout_bpe.load()["raw"]
    rows = result(spark, "op6_dropout_bpe")
    assert len(rows) == len(documents)
    assert all(r.lossless and dropout_bpe.decode(raw, r.ids) == documents[r.doc_id].text and r.n_ids == len(r.ids) for r in rows)


def test_mix(spark, documents):
    sizes = Counter()
    for r in documents.values():
        sizes[r.source] += len(brute.WORD.findall(r.text or ""))
    want, taken = brute.targets(sizes), Counter()
    rows = result(spark, "op7_mixing")
    for r in rows:
        d = documents[r.doc_id]
        assert r.size == len(brute.WORD.findall(d.text or "")) and r.source_size == sizes[d.source]
        assert math.isclose(r.target, want[d.source], rel_tol=1e-9) and r.taken in (0, r.size, 2 * r.size)
        taken[d.source] += r.taken
    assert len(rows) == len(documents)
    assert sorted(rows) == sorted(result(spark, "op7_mixing"))
    longest = max(len(brute.WORD.findall(r.text or "")) for r in documents.values())
    assert all(abs(taken[s] - want[s]) <= min(longest, 0.05 * want[s] + 60) for s in sizes)


def test_embedding_links(spark):
    rows = {r.vec_id: r for r in result(spark, "op9_embedding_neardup")}
    vectors = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    v = np.array([r.embedding for r in vectors], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = v @ v.T >= 0.9
    root = brute.classes(len(v), lambda i, j: near[i, j])
    ids = [r.vec_id for r in vectors]
    low = {}
    for k, c in zip(ids, root, strict=True):
        low[c] = min(low.get(c, k), k)
    assert all(rows[k].n_links == near[i].sum() - 1 and rows[k].component_id == low[root[i]] and rows[k].kept == (k == low[root[i]]) for i, k in enumerate(ids))


def test_toxicity_held_out(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{MORE}/labels.parquet").collect()}
    rows = result(spark, "op10_toxicity", MORE)
    assert all(r.held_out == (brute.crc(r.doc_id) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(labels[r.doc_id], r.predicted, r.score) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(y == p for y, p, _ in held) / len(held) > 0.93
    pos, neg = ([s for y, _, s in held if y == v] for v in (1, 0))
    assert sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg)) > 0.9
