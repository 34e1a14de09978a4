"""Benchmark decontamination: n-gram seeds join passages to test items, Smith-Waterman alignment scores them."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, materialize, text_slices, tidy

WORDS, STRETCH, LEAST_SCORE = 5, 3, 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Bytes of test items that one pass over the documents carries; more items take more passes.
BLOCK_BYTES = 32 << 20
_WORD = re.compile(r"\w+")
_MUL = [np.int64(x) for x in np.random.default_rng(11).integers(2**40, 2**62, 16) | 1]


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _hashed(ids: np.ndarray, n: int) -> np.ndarray:
    h = np.full(len(ids) - n + 1, n, np.int64)
    for i in range(n):
        h = (h ^ (h >> 31)) * _MUL[i] + ids[i : len(ids) - n + 1 + i] * _MUL[-1 - i]
    return h ^ (h >> 29)


class Seeds:
    """The n-grams of a block of test items: number of each word, and where each n-gram stands."""

    def __init__(self, items: list[tuple[int, str]]):
        self.number: dict[str, int] = {}
        self.items = {i: words_of(t) for i, t in items}
        self.at: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.lengths = sorted({min(WORDS, len(w)) for w in self.items.values() if w})
        for i, words in self.items.items():
            if words:
                ids = np.array([self.number.setdefault(w, len(self.number) + 1) for w in words], np.int64)
                for k, g in enumerate(_hashed(ids, min(WORDS, len(words))).tolist()):
                    self.at[g].append((i, k))
        self.grams = np.sort(np.fromiter(self.at, np.int64, len(self.at)))

    def find(self, words: list[str]) -> list[tuple[int, int, int]]:
        """(item, start of the item in the text if they stood one upon the other, place of the n-gram in the item)."""
        ids = np.fromiter(map(self.number.get, words, [0] * len(words)), np.int64, len(words))
        out = []
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        for n in self.lengths:
            if len(words) >= n and len(full := np.flatnonzero(known[n:] - known[:-n] == n)):
                h = _hashed(ids, n)[full]
                hit = self.grams[np.minimum(np.searchsorted(self.grams, h), len(self.grams) - 1)] == h
                for p, g in zip(full[hit].tolist(), h[hit].tolist(), strict=True):
                    out += [(i, p - k, k) for i, k in self.at[g]]
        return out


def align(item: list[str], passage: list[str]) -> tuple[float, int, int]:
    """Smith-Waterman on words: the best local score as a share of the item's score with itself, and the first and one past the last word of the passage in it."""

    def best(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
        row, gaps = np.zeros(len(b) + 1, np.int64), -GAP * np.arange(len(b) + 1)
        top = (0, 0, 0)
        for i, x in enumerate(a):
            now = np.maximum(row + GAP, 0)
            now[1:] = np.maximum(now[1:], row[:-1] + np.where(b == x, MATCH, MISMATCH))
            now = np.maximum.accumulate(now + gaps) - gaps
            j = int(now.argmax())
            if now[j] > top[0]:
                top = (int(now[j]), i + 1, j)
            row = now
        return top

    number: dict[str, int] = {}
    a = np.array([number.setdefault(w, len(number)) for w in item])
    b = np.array([number.setdefault(w, len(number)) for w in passage])
    score, i, j = best(a, b)
    if not score:
        return 0.0, 0, 0
    _, _, back = best(a[:i][::-1], b[:j][::-1])
    return score / (MATCH * len(a)), j - back, j


def _passages(docs: DataFrame, seeds: Seeds, least: float) -> DataFrame:
    """A row for each document, item and neighbourhood with n-grams in common: the passage, wide enough for every alignment
    through one of them that scores ``least``."""
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("first", pa.int32()), ("passage", pa.list_(pa.string()))])

    def run(batches):
        for b in text_slices(batches):
            rows = []
            for d, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = words_of(text)
                last: dict[int, list] = {}
                for item, start, _ in sorted(seeds.find(words)):
                    size = len(seeds.items[item])
                    x = last.get(item)
                    if x is None or start > x[1] + size // 2:
                        last[item] = x = [start, start]
                        rows.append((d, item, x, size, words))
                    x[1] = start
            out = []
            for d, item, (lo, hi), size, words in rows:
                slack = _slack(size, least)
                lo, hi = max(0, lo - slack), hi + size + slack
                out.append((d, item, lo, words[lo:hi]))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 4, schema, strict=True)], schema=schema)

    return documents(docs).mapInArrow(tidy(run), "doc_id long, item_id long, first int, passage array<string>")


def _slack(size: int, least: float) -> int:
    """Words by which an alignment that scores ``least`` can be longer than the item, or be shifted against it: each costs a gap."""
    return math.ceil(MATCH * size * (1 - least) / -GAP)


def _bound(item: Counter, passage: list[str]) -> int:
    """The most words that an alignment can match: those in common, as often as both have them."""
    return (item & Counter(w for w in passage if w in item)).total()


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """doc_id, item_id, score, first_word, end_word (of the document) for each document with a passage that aligns to a test
    item with at least ``least`` of the item's own score; the best passage of each pair.

    Seeds are n-grams of five words (fewer if the item is shorter). Every n-gram of an item is looked up, and every passage
    with one of them is aligned, unless it has too few of the item's words to reach ``least``: an unbroken run of five words
    is always enough. The items come to the tasks in blocks of bounded size, as many passes as that takes, and no more of
    the documents is written than the passages found.

    Null or empty texts, and items without words: no rows. Null ids: rows with null ids are left out. Repeated rows: as one.
    Items with equal texts are each reported. Empty tables: empty result.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    out = None
    for k in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()  # about BLOCK_BYTES at most
        seeds = Seeds([(r["item_id"], r["text"]) for r in rows])
        if not seeds.at:
            continue
        found = materialize(_passages(docs.filter("doc_id is not null"), seeds, least), "passages")
        items_words = seeds.items

        def score(batches, items_words=items_words):
            bags: dict[int, Counter] = {}
            for b in text_slices(batches):
                got = []
                for i, p in zip(b.column("item_id").to_pylist(), b.column("passage").to_pylist(), strict=True):
                    if i not in bags:
                        bags[i] = Counter(items_words[i])
                    got.append(align(items_words[i], p) if _bound(bags[i], p) / len(items_words[i]) >= least else (0.0, 0, 0))
                first = b.column("first").to_pylist()
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("item_id"), pa.array([x[0] for x in got], pa.float64()), pa.array([f + x[1] for f, x in zip(first, got, strict=True)], pa.int32()), pa.array([f + x[2] for f, x in zip(first, got, strict=True)], pa.int32())], names=["doc_id", "item_id", "score", "first_word", "end_word"])

        hits = found.mapInArrow(score, "doc_id long, item_id long, score double, first_word int, end_word int").filter(F.col("score") >= least)
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        return spark.createDataFrame([], "doc_id long, item_id long, score double, first_word int, end_word int")
    best = F.max(F.struct("score", (-F.col("first_word")).alias("neg"), "first_word", "end_word")).alias("x")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "x.score", "x.first_word", "x.end_word")


def without_leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` in which no test item was found, with all their columns. Rows with a null doc_id stay."""
    bad = materialize(contaminated(docs, benchmark, least).select("doc_id").distinct(), "leaks")
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)
