"""Each pipeline stage against a plain re-statement on its own input."""

import math
import os
import re
import sys
from collections import Counter

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from mailsift.llm import dropout_bpe, toxicity  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out, columns = [docs.collect()], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER).checkpoint()
        out.append(docs.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    return out


def test_toxic_documents_go(spark, stages):
    m = toxicity.fit(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet"))

    def logit(text):
        t = toxicity.terms(text, {})
        return m.bias + m.weight[t].sum() + sum(float(m.factor[a] @ m.factor[b]) for i, a in enumerate(t) for b in t[:i])

    want = {r.doc_id for r in stages[0] if logit(r.text) < 0}
    assert {r.doc_id for r in stages[1]} == want and 0.7 * len(stages[0]) < len(want) < len(stages[0])


def test_one_of_each_group_stays(stages):
    rows = sorted(stages[1], key=lambda r: r.doc_id)
    fp = [brute.fingerprint(r.text) for r in rows]
    root = brute.classes(len(rows), lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 4)
    assert sorted(r.doc_id for r in stages[2]) == sorted({rows[k].doc_id for k in root})


def test_base_spans_are_masked(stages):
    before = {r.doc_id: r for r in stages[2]}
    assert {r.doc_id for r in stages[3]} == set(before)
    for r in stages[3]:
        text, at, out = before[r.doc_id].text, 0, []
        for s in filter(None, brute.spans(text, brute.PERSONAL).split(",")):
            kind, a, b = s.split(":")
            if int(a) >= at:
                out += [text[at : int(a)], f"<{kind}>"]
            at = max(at, int(b))
        want = "".join([*out, text[at:]])
        assert r.n_chars == len(r.text) and re.sub("<(account|local_phone|national_id)>", "", r.text) in (want, r.text) and r.lang == before[r.doc_id].lang
        if "_" not in "".join(re.findall("<(.*?)>", r.text)):
            assert r.text == want


def test_mix_comes_near_its_targets(stages):
    sizes, taken, longest = Counter(), Counter(), Counter()
    for r in stages[3]:
        n = len(brute.WORD.findall(r.text))
        sizes[r.source] += n
        longest[r.source] = max(longest[r.source], n)
    for r in stages[4]:
        taken[r.source] += len(brute.WORD.findall(r.text))
    want = brute.targets(sizes)
    assert all(abs(taken[s] - want[s]) <= longest[s] for s in sizes)
    assert max(Counter(r.doc_id for r in stages[4]).values()) <= 2
    assert math.isclose(sum(want.values()), 1.5 * sum(sizes.values()))


def test_pieces_decode_to_the_mixed_texts(stages):
    raw = dropout_bpe.load()["raw"]
    texts = {r.doc_id: r.text for r in stages[4]}
    assert Counter(r.doc_id for r in stages[5]) == Counter(r.doc_id for r in stages[4])
    assert all(r.lossless and dropout_bpe.decode(raw, r.ids) == texts[r.doc_id] for r in stages[5])


def test_copies_of_a_document_are_encoded_apart(stages):
    by_id = {}
    for r in stages[5]:
        by_id.setdefault(r.doc_id, []).append(r)
    twice = [v for v in by_id.values() if len(v) == 2]
    assert len(twice) > 20 and all(sorted(r.copy for r in v) == list(range(1, len(v) + 1)) for v in by_id.values())
    long = [v for v in twice if v[0].n_ids > 100]
    assert long and all(v[0].ids != v[1].ids for v in long)


TEXTS = [None, "", " \n ", "one", "a b c d", "a b c d", "mail x@y.zz now", "long words " * 20_000, "▁ é▁"]


def _odd(spark, texts):
    rows = [(k, t, f"s{k % 2}" if k % 3 else None, 0, "r", "h") for k, t in enumerate(texts)]
    rows += [rows[4], (None, "a null id", None, None, None, None), (None, None, None, None, None, None)] if texts else []
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int, copy string, row string")


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_odd_rows(spark, name, stage):
    """Nulls, empty, long and repeated texts, clashing names, no ``lang`` column."""
    docs = _odd(spark, TEXTS)
    got = stage(spark, docs, FOLDER).collect()
    ids = Counter(r.doc_id for r in got)
    if name == "toxicity":
        assert ids == Counter({**{k: 1 for k in range(9)}, 4: 2, None: 2})
    elif name == "simhash_near_dedup":
        assert set(ids.values()) == {1} and {0, 3, 4, 6, 7, 8} <= set(ids) and not {1, 2, 5} & set(ids)
    elif name == "pii":
        by = {r.doc_id: r for r in got if r.doc_id is not None}
        assert len(got) == 12 and by[0].text is None and by[0].n_chars is None and by[1].text == "" and by[6].text == "mail <email> now" and by[6].n_chars == 16
    elif name == "mixing":
        assert max(n for k, n in ids.items() if k not in (4, None)) <= 2 and ids[4] in (0, 2, 4)
    else:
        assert len(got) == 12 and all(r.lossless for r in got) and sorted(r.copy for r in got if r.doc_id == 4) == [1, 2]
        assert {r.doc_id: r.ids for r in got}[0] is None and {r.doc_id: r.ids for r in got}[1] == []
    if name != "sentencepiece":
        assert stage(spark, docs, FOLDER).columns == docs.columns


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_empty_tables(spark, name, stage):
    assert stage(spark, _odd(spark, []), FOLDER).collect() == []
