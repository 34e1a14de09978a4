"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length, with exception phrases."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, materialize, text_slices, tidy

#: Terms that are weighted even if the labelled rows don't show them, and phrases in which a term is harmless.
SEED_TERMS = ("idiot", "idiots", "moron", "morons", "stupid", "pathetic", "worthless", "disgusting", "scum", "loser", "losers", "trash", "clown", "imbecile", "bastard", "bitch", "asshole", "retard", "dumbass", "scumbag")
EXCEPTIONS = ("clown fish", "class clown", "trash can", "trash bin", "trash bag", "trash collection", "good loser", "gracious loser", "winner and loser", "idiot proof")
SEED_WEIGHT = 3.0
#: Look-alike letters, and the digits and signs that stand for letters.
HOMOGLYPHS = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ԁ": "d", "ո": "n", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "α": "a", "ε": "e", "ο": "o", "ρ": "p", "τ": "t", "ι": "i", "κ": "k", "ν": "v", "υ": "u", "İ": "i", "ı": "i", "А": "a", "Е": "e", "О": "o", "Р": "p", "С": "c", "Х": "x", "І": "i", "Ѕ": "s", "М": "m", "Т": "t", "В": "b", "Н": "h", "К": "k"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i"}
_FOLD = str.maketrans({**HOMOGLYPHS, **DIGITS, **{chr(0xFF21 + i): chr(97 + i) for i in range(26)}, **{chr(0xFF41 + i): chr(97 + i) for i in range(26)}})
_WORD = re.compile(r"[^\W\d_]+")

TRAIN_ROWS = 20_000


def fold(text: str) -> str:
    """Lower case, look-alikes and substituted digits replaced, one character for each, so that positions stay."""
    return text.translate(_FOLD).lower()


class Lexicon:
    """Terms with weights, and phrases that cover terms; matched together in one pass over the folded text."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for phrase in exceptions:
            self.machine.add_word(fold(phrase), (len(phrase), 0.0))
        for term, w in weights.items():
            self.machine.add_word(term, (len(term), w))
        self.machine.make_automaton()

    def weight(self, text: str) -> float:
        """Sum of the weights of terms that stand as whole words and not within an exception phrase."""
        hits, covered = [], []
        for last, (n, w) in self.machine.iter(fold(text)):
            first = last - n + 1
            if (first == 0 or not text[first - 1].isalnum()) and (last + 1 == len(text) or not text[last + 1].isalnum()):
                (hits if w else covered).append((first, last, w))
        return sum(w for a, b, w in hits if not any(x <= a and b <= y for x, y, _ in covered))


def features(weight: float, text: str) -> tuple[float, float, float, float]:
    """1, any hit, the weight on a logarithmic scale, and the weight per 100 words likewise."""
    words = text.count(" ") + 1
    return 1.0, float(weight > 0), math.log1p(weight), math.log1p(100 * weight / (words + 20))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the first column (the constant) isn't shrunk."""
    b = np.zeros(x.shape[1])
    shrink = np.full(x.shape[1], ridge)
    shrink[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ b))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink), x.T @ (y - p) - shrink * b)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return b


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """text, toxic of at most ``rows`` labelled documents whose crc32(doc_id as text) isn't divisible by 5, in the order of a
    hash of their id. ``rows`` bounds what is fitted on; it bounds nothing else. Equal texts with equal labels are one row, however
    the rows are dealt out; so what is learned doesn't depend on the layout of files."""
    own = labels.filter("doc_id is not null and toxic is not null").filter("crc32(cast(doc_id as string)) % 5 <> 0")
    own = own.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return documents(docs).join(F.broadcast(own), "doc_id").select("text", "toxic").distinct()


def learn_lexicon(train: DataFrame) -> dict[str, float]:
    """Weights (log odds) of all words that mark toxic documents, seed terms included; the distinct rows of ``train`` bound their number.

    A word is learned if most documents with it are toxic, and if it follows many different words there: words of one
    often-copied toxic document follow the same word each time and say nothing.
    """

    def count(batches):
        for b in text_slices(batches, 1024):
            neg: Counter = Counter()
            pos: Counter = Counter()
            for text, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                words = _WORD.findall(fold(text))
                if y:
                    before = defaultdict(str)
                    for p, w in zip(["", *words], words, strict=False):
                        before.setdefault(w, p)
                    pos.update(before.items())
                else:
                    neg.update(set(words))
            rows = [(w, p, n, 0) for (w, p), n in pos.items()] + [(w, None, 0, n) for w, n in neg.items()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["word", "before", "pos", "neg"])

    counted = train.mapInArrow(count, "word string, before string, pos long, neg long").groupBy("word", "before").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    words = counted.groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.count("before").alias("contexts"))
    seeds = list(SEED_TERMS)
    learned = (F.col("pos") >= 5) & (F.col("contexts") >= 5) & (2 * F.col("contexts") >= F.col("pos")) & (F.col("pos") >= 4 * F.col("neg")) & (F.length("word") >= 3)
    found = words.filter(learned | F.col("word").isin(seeds)).collect()  # each in 5 training rows at least
    out = dict.fromkeys(seeds, SEED_WEIGHT)
    for r in sorted(found):
        if r["pos"] + r["neg"] >= 5:
            out[r["word"]] = math.log((r["pos"] + 0.5) / (r["neg"] + 0.5))
    return {k: w for k, w in out.items() if w > 0}


class Model:
    """A lexicon and the curve that turns its weights into a probability."""

    def __init__(self, weights: dict[str, float], curve: list[float]):
        self.weights, self.curve = weights, curve

    def scorer(self):
        lexicon = Lexicon(self.weights)
        return lambda text: 1 / (1 + math.exp(-sum(b * x for b, x in zip(self.curve, features(lexicon.weight(text), text), strict=True))))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Learn the lexicon and the curve from the labelled training rows. Without labelled rows the seed terms and a fixed curve remain."""
    train = materialize(training_rows(docs, labels, rows), "training")
    weights = learn_lexicon(train)

    def measure(batches):
        lexicon = Lexicon(weights)
        for b in batches:
            x = [features(lexicon.weight(t), t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column("toxic")], names=["x", "toxic"])

    got = train.mapInArrow(measure, "x array<double>, toxic int").collect()  # at most ``rows`` rows of four numbers
    if len({r["toxic"] for r in got}) < 2:
        return Model(weights, [-3.0, 3.0, 1.0, 0.5])
    x, y = np.array([r["x"] for r in got]), np.array([float(r["toxic"]) for r in got])
    order = np.lexsort((*x.T, y))  # sums of floats then don't depend on the order of rows
    return Model(weights, fit_logistic(x[order], y[order]).tolist())


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from 0.5) of every row's whole text.

    Null or empty text: the score of a text without hits. A null doc_id is scored like any other, repeated rows alike,
    texts of any length as a whole. Empty table: empty result. No other column has a part in the score.
    """

    def run(batches):
        score = model.scorer()
        for b in text_slices(batches):
            s = [score(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64()), pa.array([int(v >= 0.5) for v in s], pa.int32())], names=["doc_id", "score", "predicted"])

    return documents(docs).mapInArrow(tidy(run), "doc_id long, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with all their columns; no shuffle."""

    def run(batches):
        score = model.scorer()
        for b in text_slices(batches):
            yield b.filter(pa.array([score(t or "") < 0.5 for t in b.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
