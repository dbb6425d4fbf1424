"""Ranked lexical search by presence masks.

Texts become narrow rows once: how many terms they have and how often each
query term occurs. A task then takes such rows as blocks. In a block every term
has a bitmap of the documents that hold it; the bitmaps of an item's terms, one
above the other, give each document its mask of matched terms. Documents of
equal mask share an upper bound, the sum of what each matched term scores at
most in the block. Masks are scored in order of falling bound until no mask
left can reach the scores already found, those of the task's earlier blocks
included.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mailsift.llm.common import frames, in_array, stored, to_tasks

#: Rows a block holds at most.
BLOCK = 32_768
#: Terms of all items whose tables are sent to tasks at once; more items take more passes.
PASS_TERMS = 200_000
#: Slices in which an item's candidates are cut down before the last cut.
SLICES = 64
#: Masks whose documents are scored together at first.
STEP = 64

#: Bytes that part terms become blanks, A-Z become a-z; all others belong to terms.
_TABLE = bytes(32 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Terms as UTF-8; null has none."""
    return text.encode().translate(_TABLE).split() if text else []


def _counted(docs: DataFrame, doc_id: str, terms: list[bytes]) -> DataFrame:
    """(doc, n, at, tf): n counts all terms of the text, ``at`` numbers the query
    terms in it, ``tf`` counts them. Texts without terms are left out."""
    number = to_tasks(docs.sparkSession, {t: k for k, t in enumerate(terms)})

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbered = number.value
        for b in frames(batches):
            out = []
            for doc, text in zip(b["doc"], b["text"], strict=True):
                words = terms_of(text)
                if words:
                    # numbers first, counted after: few of a text's terms are asked for
                    tf = Counter(map(numbered.get, words))
                    tf.pop(None, None)
                    out.append((doc, len(words), list(tf), list(tf.values())))
            if out:
                yield pd.DataFrame(out, columns=["doc", "n", "at", "tf"])

    narrow = docs.select(in_array(doc_id).alias("doc"), F.col("text").alias("text"))
    return narrow.mapInPandas(work, "doc array<long>, n long, at array<int>, tf array<int>")


class Item:
    """An item's distinct terms: their numbers, weights times repeats."""

    def __init__(self, key, at: list[int], weight: list[int]):
        self.key, self.at, self.weight = key, np.array(at, np.int64), np.array(weight, np.int64)


class Best:
    """The best rows so far: highest score first, then the smaller id, null last."""

    def __init__(self, k: int):
        self.k, self.score, self.doc = k, np.zeros(0, np.int64), np.zeros(0, object)

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        keep = score > 0
        score, doc = np.concatenate([self.score, score[keep]]), np.concatenate([self.doc, doc[keep]])
        none = np.array([d is None for d in doc], bool)
        ids = np.array([0 if d is None else d for d in doc], np.int64)
        best = np.lexsort((ids, none, -score))[: self.k]
        self.score, self.doc = score[best], doc[best]

    def least(self) -> int:
        """A score below this can't enter; an equal one may, by its id."""
        return int(self.score[-1]) if len(self.score) == self.k else 1


class Block:
    """Postings of a block, by term and document."""

    def __init__(self, doc: np.ndarray, n: np.ndarray, at: np.ndarray, tf: np.ndarray, held: np.ndarray, texts: int, length: int):
        self.doc, self.size = doc, len(doc)
        row = np.repeat(np.arange(len(doc)), held)
        order = np.lexsort((row, at))
        self.at, self.row, tf = at[order], row[order], tf[order]
        m = 100 - 25 + (25 * n * texts) // length
        self.part = (1_000_000_000 * tf) // (1000 * tf + 12 * m[self.row])
        self.key = self.at * self.size + self.row

    def masks(self, item: Item) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bitmaps by term; documents that match; their mask's number; bounds."""
        lo, hi = np.searchsorted(self.at, item.at), np.searchsorted(self.at, item.at, "right")
        present = np.zeros((len(item.at), self.size), bool)
        most = np.zeros(len(item.at), np.int64)
        for k, (a, b) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True)):
            if b > a:
                present[k, self.row[a:b]] = True
                most[k] = self.part[a:b].max()
        packed = np.packbits(present, axis=0)
        found = np.flatnonzero(packed.any(axis=0))
        rows = np.ascontiguousarray(packed[:, found].T)
        masks, group = np.unique(rows.view(np.dtype((np.void, rows.shape[1]))).ravel(), return_inverse=True)
        bits = np.unpackbits(masks.view(np.uint8).reshape(len(masks), rows.shape[1]), axis=1)[:, : len(item.at)]
        return found, group, bits, bits.astype(np.int64) @ (most * item.weight)

    def scores(self, item: Item, rows: np.ndarray) -> np.ndarray:
        """Exact scores of the rows, from the postings of the item's terms."""
        want = item.at[:, None] * self.size + rows[None, :]
        at = np.minimum(np.searchsorted(self.key, want.ravel()), len(self.key) - 1)
        part = np.where(self.key[at] == want.ravel(), self.part[at], 0).reshape(want.shape)
        return item.weight @ part

    def search(self, item: Item, best: Best) -> int:
        """Add the block's best rows; returns how many rows were scored."""
        found, group, bits, bound = self.masks(item)
        if not len(found):
            return 0
        order = np.argsort(-bound, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        by_mask = np.argsort(place[group], kind="stable")
        ends = np.cumsum(np.bincount(place[group], minlength=len(order)))
        done, k, step = 0, 0, STEP
        while k < len(order) and bound[order[k]] >= best.least():
            k = min(k + step, len(order))
            rows = found[by_mask[done : ends[k - 1]]]
            best.add(self.scores(item, rows), self.doc[rows])
            done, step = int(ends[k - 1]), 2 * step
        return done


def _blocks(batches: Iterator[pd.DataFrame], texts: int, length: int) -> Iterator[Block]:
    held: list[pd.DataFrame] = []
    size = 0
    for b in frames(batches):
        held.append(b)
        size += len(b)
        if size >= BLOCK:
            yield _block(held, texts, length)
            held, size = [], 0
    if held:
        yield _block(held, texts, length)


def _block(held: list[pd.DataFrame], texts: int, length: int) -> Block:
    b = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
    doc = np.empty(len(b), object)
    doc[:] = [int(d[0]) if len(d) else None for d in b["doc"]]
    at, tf = (np.concatenate([np.asarray(x, np.int64) for x in b[c]]) for c in ("at", "tf"))
    return Block(doc, b["n"].to_numpy(np.int64), at, tf, np.array([len(x) for x in b["at"]]), texts, length)


def _candidates(rows: DataFrame, items: list[Item], texts: int, length: int, k: int) -> DataFrame:
    sent = to_tasks(rows.sparkSession, items)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = [Best(k) for _ in sent.value]
        for block in _blocks(batches, texts, length):
            for item, b in zip(sent.value, best, strict=True):
                block.search(item, b)
        for n, b in enumerate(best):
            if len(b.doc):
                yield pd.DataFrame({"item": n, "doc": [[] if d is None else [d] for d in b.doc], "score": b.score})

    return rows.mapInPandas(work, "item int, doc array<long>, score long")


def _passes(items: Iterator[tuple], limit: int) -> Iterator[list[tuple]]:
    """Runs of items that hold at most so many distinct terms together."""
    held, terms = [], 0
    for x in items:
        if held and terms + len(x[1]) > limit:
            yield held
            held, terms = [], 0
        held.append(x)
        terms += len(x[1])
    if held:
        yield held


def weight(texts: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * texts + 2) / (2 * df + 1)))


def search(docs: DataFrame, items: DataFrame, k: int = 20, doc_id: str = "doc_id", item_id: str = "item_id", pass_terms: int = PASS_TERMS) -> DataFrame:
    """The ``k`` best documents of each item with a score above 0:
    (item_id, rank, doc_id, score).

    The items are a stated query set: they are read in passes of at most
    ``pass_terms`` terms, so what is sent to tasks is bounded; a pass over the
    documents' texts serves all of its items. Null and empty texts have no
    terms and are never found; items without terms have no rows. Texts of any
    length count whole. Repeated documents are ranked each for itself and
    repeated items each get their rows; equal scores go by ascending id, null
    last. Empty tables give no rows. Other columns play no part.
    """
    spark = docs.sparkSession
    schema = f"{item_id} {items.schema[item_id].dataType.simpleString()}, rank int, {doc_id} {docs.schema[doc_id].dataType.simpleString()}, score long"
    out = None
    listed = ((r[0], Counter(terms_of(r[1]))) for r in items.select(item_id, "text").toLocalIterator())
    for some in _passes((x for x in listed if x[1]), pass_terms):
        terms = sorted({t for _, tf in some for t in tf})
        number = {t: n for n, t in enumerate(terms)}
        rows = stored(_counted(docs, doc_id, terms))
        texts, length = rows.agg(F.count("*"), F.sum("n")).first()
        if not texts:
            break
        df = {r.t: r.df for r in rows.select(F.explode("at").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()}
        asked = [Item(key, [number[t] for t in tf], [c * weight(texts, df.get(number[t], 0)) for t, c in tf.items()]) for key, tf in some]
        found = _candidates(rows.where(F.size("at") > 0), asked, texts, length, k)
        found = found.select("item", F.get("doc", F.lit(0)).alias(doc_id), "score")
        best = [F.desc("score"), F.asc_nulls_last(doc_id)]
        sliced = W.partitionBy("item", F.pmod(F.xxhash64(doc_id), F.lit(SLICES))).orderBy(*best)
        found = found.withColumn("rank", F.row_number().over(sliced)).where(F.col("rank") <= k)
        found = found.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*best))).where(F.col("rank") <= k)
        names = spark.createDataFrame([(n, x.key) for n, x in enumerate(asked)], f"item int, {item_id} {items.schema[item_id].dataType.simpleString()}")
        found = found.join(F.broadcast(names), "item").select(item_id, "rank", doc_id, "score")
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out
