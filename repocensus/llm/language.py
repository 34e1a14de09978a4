"""Language identification: an interpolated Kneser-Ney model of characters for each language, in sorted hash arrays; the lowest
cross-entropy per character wins, unless calibration says that no learned language fits."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, materialize, new_folder, partitions, text_slices, tidy

#: Characters to an n-gram; numbers (n-grams of all orders times languages) that a pass over the texts holds. A model of more takes further passes.
ORDER, MODEL_CELLS = 5, 8_000_000
#: Share of rightly judged calibration rows that rejection may cost; parts of a nat by which their cross-entropies are counted.
REJECT, BINS = 0.005, 4096
#: Scales among which calibration chooses.
SCALES = 2.0 ** np.arange(-6, 7, 0.5)
UNDETERMINED = "und"
_SPACE = 32
_MIX = np.uint64(0x9E3779B97F4A7C15)


@cache
def characters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point what it counts as (lower case for letters and marks, else a space), and whether it is a letter."""
    kinds = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
    letter = np.array([k == "L" for k in kinds])
    as_what = np.full(0x110000, _SPACE, np.uint32)
    for c in np.flatnonzero(letter | np.array([k == "M" for k in kinds])):
        as_what[c] = ord(chr(c).lower()[0])
    return as_what, letter


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' characters one behind the other, each text between ORDER - 1 spaces and one, runs of other than letters as one
    space; the text that each belongs to, and whether a text has a letter."""
    as_what, letter = characters()
    raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lens = np.array([len(t) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), lens)
    has = np.bincount(owner[letter[raw]], minlength=len(texts)) > 0
    got = as_what[raw]
    first = np.ones(len(got), bool)
    first[1:] = owner[1:] != owner[:-1]
    before = np.concatenate([[_SPACE], got[:-1]])
    keep = (got != _SPACE) | ((before != _SPACE) & ~first)  # a space only behind a letter of the same text
    got, owner = got[keep], owner[keep]
    if len(got):
        ends = np.flatnonzero(np.append(owner[1:] != owner[:-1], True))
        ends = ends[got[ends] == _SPACE]  # one space behind each text is put there below
        got, owner = np.delete(got, ends), np.delete(owner, ends)
    n = np.bincount(owner, minlength=len(texts))
    out = np.full(int(n.sum()) + len(texts) * ORDER, _SPACE, np.uint32)
    out[np.arange(len(got)) + owner * ORDER + ORDER - 1] = got
    return out, np.repeat(np.arange(len(texts)), n + ORDER), has


def hashes(chars: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of the ``width`` characters that end at each place; the first width - 1 places hash what wraps around."""
    h = np.zeros(len(chars), np.uint64)
    for back in range(width - 1, -1, -1):
        h = (h ^ np.roll(chars, back).astype(np.uint64)) * _MIX
        h ^= h >> np.uint64(29)
    return h


def scored(owner: np.ndarray) -> np.ndarray:
    """Places whose n-gram lies within one text."""
    ok = np.zeros(len(owner), bool)
    ok[ORDER - 1 :] = owner[ORDER - 1 :] == owner[: len(owner) - ORDER + 1]
    return np.flatnonzero(ok)


def gram_counts(rows: DataFrame) -> DataFrame:
    """(text, lang) to (lang, gram, n): every n-gram of every text, counted in the tasks before it is shuffled."""

    def run(batches):
        for b in text_slices(batches, 512):
            langs = b.column("lang").to_pylist()
            chars, owner, _ = code_points(b.column("text").to_pylist())
            at = scored(owner)
            names = sorted(set(langs))
            which = np.array([names.index(x) for x in langs])[owner[at]] if len(at) else at
            key = hashes(chars, ORDER)[at] ^ (which.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
            _, where, n = np.unique(key, return_index=True, return_counts=True)
            windows = np.stack([chars[at[where] - k] for k in range(ORDER - 1, -1, -1)], axis=1) if len(where) else np.zeros((0, ORDER), np.uint32)
            joined = windows.astype("<u4").tobytes().decode("utf-32-le")
            grams = [joined[i : i + ORDER] for i in range(0, len(joined), ORDER)]
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in which[where]], pa.string()), pa.array(grams, pa.string()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    return rows.mapInArrow(tidy(run), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def levels(counts: DataFrame) -> DataFrame:
    """(lang, gram, n) of all orders: occurrences for the longest, for shorter ones how many different characters stand before."""
    out, level = counts, counts
    for _ in range(ORDER - 1):
        level = level.groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("n"))
        out = out.unionByName(level)
    return out


class Model:
    """Log probabilities of n-grams and log weights of contexts, by order, each in an array of sorted hashes with a column a language.

    Where that is more than a pass may hold, it is the first block: the n-grams whose context, last character first, is from ``low`` on and below ``high``,
    and the shorter ones that these fall back on. ``further`` has the bounds of the other blocks, whose rows lie in ``folder``.
    """

    def __init__(self, langs: list[str], tables: dict[int, tuple], contexts: dict[int, tuple], unknown: float):
        self.langs, self.tables, self.contexts, self.unknown = langs, tables, contexts, unknown
        self.scale, self.limits = 1.0, dict.fromkeys(langs, float("inf"))
        self.low, self.high, self.further, self.folder, self.discounts = "", None, [], None, {}

    def blocks(self, spark: SparkSession) -> Iterator[Model]:
        """This block and the others, one after the other."""
        yield self
        for low, high in self.further:
            yield block(spark.read.parquet(self.folder), self.discounts, self.langs, low, high)

    @staticmethod
    def _find(table: tuple, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each hash stands in the sorted ones, and whether it does; the first bits lead to the few that share them."""
        keys, _, shift, starts = table
        first = (h >> np.uint64(shift)).astype(np.int64)
        at, end, found = starts[first], starts[first + 1], np.zeros(len(h), bool)
        open_ = np.flatnonzero(at < end)
        while len(open_):
            same = keys[at[open_]] == h[open_]
            found[open_[same]] = True
            open_ = open_[~same]
            at[open_] += 1
            open_ = open_[at[open_] < end[open_]]
        return np.where(found, at, 0), found

    def log_probabilities(self, chars: np.ndarray, at: np.ndarray, order: int = ORDER, h: np.ndarray | None = None) -> np.ndarray:
        """For each place and language; an n-gram that isn't known takes its context's weight and the next shorter n-gram. ``h``: hashes of
        the longest n-grams there, if they are known already."""
        if not order:
            return np.full((len(at), len(self.langs)), self.unknown, np.float32)
        found_at, found = self._find(self.tables[order], hashes_at(chars, at, order) if h is None else h)
        out = self.tables[order][1][found_at] if len(self.tables[order][0]) else np.zeros((len(at), len(self.langs)), np.float32)
        rest = np.flatnonzero(~found)
        if len(rest):
            low = self.log_probabilities(chars, at[rest], order - 1)
            ctx_at, ctx = self._find(self.contexts[order], hashes_at(chars, at[rest] - 1, order - 1))
            if len(self.contexts[order][0]):
                low = low + np.where(ctx[:, None], self.contexts[order][1][ctx_at], 0)
            out[rest] = low
        return out

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log probabilities of each text's characters whose contexts are in this block, summed by language; the number of all its characters, whether there is a letter."""
        chars, owner, has = code_points(texts)
        at, every = scored(owner), hashes(chars, ORDER)
        n = np.bincount(owner[at], minlength=len(texts))
        if self.low:
            at = at[from_on(chars, at, self.low)]
        if self.high is not None:
            at = at[~from_on(chars, at, self.high)]
        total = np.zeros((len(texts), len(self.langs)))
        for i in range(0, len(at), 1 << 17):
            part = at[i : i + (1 << 17)]
            p = self.log_probabilities(chars, part, h=every[part])
            edge = np.flatnonzero(np.append(True, owner[part][1:] != owner[part][:-1]))
            total[owner[part][edge]] += np.add.reduceat(p.astype(np.float64), edge, axis=0)
        return total, n, has

    def cross_entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nats per character for each text and language, the number of characters, whether there is a letter; of a model of one block."""
        total, n, has = self.sums(texts)
        return -total / np.maximum(n, 1)[:, None], n, has

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The language, its probability among the learned ones, and whether it is accepted; of a model of one block."""
        return verdicts(self.langs, self.scale, self.limits, *self.cross_entropies(texts))


def verdicts(langs: list[str], scale: float, limits: dict[str, float], ce: np.ndarray, n: np.ndarray, has: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """From cross-entropies: the language, its probability among the learned ones, and whether it is accepted."""
    if not langs:
        return [UNDETERMINED] * len(n), np.zeros(len(n)), np.zeros(len(n), bool)
    best = ce.argmin(axis=1)  # of equal ones the first in order of names
    p = probabilities(ce, n, scale)[np.arange(len(n)), best]
    limit = np.array([limits[x] for x in langs])
    fits = has & (ce[np.arange(len(n)), best] <= limit[best])
    return [langs[k] if h else UNDETERMINED for k, h in zip(best, has, strict=True)], np.where(has, p, 0.0), fits


def from_on(chars: np.ndarray, at: np.ndarray, bound: str) -> np.ndarray:
    """Whether the characters before each place, the last first, come to ``bound`` or behind it."""
    out = np.ones(len(at), bool)
    for back in range(len(bound), 0, -1):
        c, x = chars[at - back], ord(bound[back - 1])
        out = (c > x) | ((c == x) & out)
    return out


def probabilities(ce: np.ndarray, n: np.ndarray, scale: float) -> np.ndarray:
    """Characters of a text depend on one another, so its length counts by its root; ``scale`` is calibrated."""
    z = -ce * np.sqrt(n)[:, None] * scale
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def hashes_at(chars: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """As ``hashes``, at the given places only."""
    h = np.zeros(len(at), np.uint64)
    for back in range(width - 1, -1, -1):
        h = (h ^ chars[at - back].astype(np.uint64)) * _MIX
        h ^= h >> np.uint64(29)
    return h


def build(rows: Iterable[tuple] | pa.Table, discounts: dict, langs: list[str]) -> Model:
    """From (lang, gram, n, total of its context): interpolated probabilities; n-grams that were left out count as unseen, and
    their share of the context goes to the shorter ones."""
    if not isinstance(rows, pa.Table):
        rows = pa.table(list(zip(*rows, strict=True)) or [[]] * 4, names=["lang", "gram", "n", "total"])
    rows = rows.set_column(0, "lang", pc.index_in(rows.column("lang"), pa.array(langs, pa.string())))
    lengths, width = pc.utf8_length(rows.column("gram").cast(pa.large_string())), len(langs)
    tables, contexts, known = {}, {}, {}
    letters = max(len(pc.unique(rows.column("gram").filter(pc.equal(lengths, 1)))), 1) + 1

    def under(chars: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
        """Probabilities of the n-grams of k characters that end at each place, known or not."""
        if not k:
            return np.full((len(at), width), 1.0 / letters)
        keys, p, ctx, weight = known[k]
        where, found = _place(keys, hashes_at(chars, at, k))
        out = p[where] if len(keys) else np.zeros((len(at), width))
        rest = np.flatnonzero(~found)
        if len(rest):
            where, found = _place(ctx, hashes_at(chars, at[rest] - 1, k - 1))
            low = under(chars, at[rest], k - 1)
            out[rest] = np.where(found[:, None], weight[where], 1.0) * low if len(ctx) else low
        return out

    for k in range(1, ORDER + 1):
        part = rows.filter(pc.equal(lengths, k))
        c, n, total = (part.column(x).to_numpy().astype(np.float64 if x != "lang" else np.int64) for x in ("lang", "n", "total"))
        chars = _characters(part.column("gram"))
        last = np.arange(1, len(c) + 1) * k - 1
        d = np.array([discounts.get((x, k), 0.5) for x in langs])
        share = np.maximum(n - d[c], 0.0) / total if len(c) else n
        keys, first, at = np.unique(hashes_at(chars, last, k), return_index=True, return_inverse=True)
        ctx, ctx_at = np.unique(hashes_at(chars, last - 1, k - 1), return_inverse=True)
        own = np.bincount(at * width + c, weights=share, minlength=len(keys) * width).reshape(len(keys), width)
        seen = np.bincount(ctx_at * width + c, minlength=len(ctx) * width).reshape(len(ctx), width) > 0
        used = np.bincount(ctx_at * width + c, weights=share, minlength=len(ctx) * width).reshape(len(ctx), width)
        weight = np.where(seen, np.maximum(1.0 - used, 1e-9), 1.0)
        p = own + weight[ctx_at[first]] * under(chars, last[first], k - 1) if len(keys) else own
        known[k] = (keys, p, ctx, weight)
        tables[k], contexts[k] = _found_by_bits(keys, np.log(np.maximum(p, 1e-30))), _found_by_bits(ctx, np.log(weight))
    return Model(langs, tables, contexts, float(np.log(1.0 / letters)))


def _characters(grams: pa.ChunkedArray) -> np.ndarray:
    """The characters of all n-grams one behind the other, without a Python object for each."""
    flat = grams.cast(pa.large_string()).combine_chunks()
    if not len(flat):
        return np.zeros(0, np.uint32)
    ends = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    return np.frombuffer(flat.buffers()[2].slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes().decode().encode("utf-32-le"), np.uint32)


def _place(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each hash stands in the sorted ones, and whether it does."""
    if not len(keys):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return at, keys[at] == h


def _found_by_bits(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """Sorted hashes, their values, and where the hashes with the same first bits begin, one bucket for each n-gram or more."""
    bits = max(1, min(22, len(keys).bit_length()))
    starts = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int64)
    return keys, values.astype(np.float32), 64 - bits, starts


def training(docs: DataFrame) -> DataFrame:
    """doc_id, text, lang, bucket of the rows to learn from: language known, crc32(doc_id as text) not divisible by 5."""
    own = documents(docs, "doc_id", "text", "lang").filter("lang is not null")
    return own.withColumn("bucket", F.expr("crc32(cast(doc_id as string)) % 5")).filter("bucket <> 0")


def ranges(grams: DataFrame, langs: int, cells: int) -> list[tuple[str, str | None]]:
    """Bounds of contexts, last character first, between which the n-grams of a table (gram, context) of two and more characters come to ``cells`` numbers at most, a
    number for each of ``langs``, with the shorter ones that they fall back on. A range holds four contexts at least, whatever ``cells`` is."""
    sizes = materialize(grams.filter("length(gram) > 1").select("gram", "context").distinct().groupBy("context").agg(F.count("*").alias("n")), "contexts")
    every, widest = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.max("n")).first()
    if every * langs <= cells:
        return [("", None)]
    room = max(cells // langs - ORDER * widest, 1)
    own = sizes.repartitionByRange(partitions(sizes.sparkSession), "context").withColumn("part", F.spark_partition_id())
    own, before = materialize(own, "sorted"), []
    for part, n in sorted((r["part"], r["n"]) for r in own.groupBy("part").agg(F.sum("n").alias("n")).collect()):  # a row a partition
        before.append((part, (before[-1][2] if before else 0), (before[-1][2] if before else 0) + n))
    moved = own.join(F.broadcast(own.sparkSession.createDataFrame(before, "part int, start long, stop long")), "part")
    rank = F.sum("n").over(Window.partitionBy("part").orderBy("context")) - F.col("n") + F.col("start")
    lows = [r["low"] for r in moved.select(F.floor(rank / room).alias("block"), "context").groupBy("block").agg(F.min("context").alias("low")).orderBy("low").collect()]
    return list(zip(["", *lows[1:]], [*lows[1:], None], strict=True))


def block(rows: DataFrame, discounts: dict, langs: list[str], low: str, high: str | None) -> Model:
    """The model of the n-grams of a table (lang, gram, context, n, total) whose contexts are in a range, and of the shorter ones that they fall back on."""
    inside = F.col("context") >= low if high is None else (F.col("context") >= low) & (F.col("context") < high)
    got = rows.filter(inside | F.lit(low).startswith(F.col("context"))).select("lang", "gram", "n", "total").toArrow()
    model = build(got, discounts, langs)
    model.low, model.high = low, high
    return model


def fit(docs: DataFrame, cells: int = MODEL_CELLS, calibration_rows: int | None = None) -> Model:
    """Count the n-grams of all rows with remainder 2 to 4, and keep them all; calibrate on all rows with remainder 1. ``cells`` bounds what a pass over the texts holds in
    the driver and in every task (12 bytes for a number at most): a model of more is cut in blocks by the contexts of its n-grams, and every place of a text is
    scored in the pass that has its context. ``calibration_rows``, if given, is the number of documents to calibrate on, in the order of a hash of
    their id. Without calibration rows the scale is 1 and nothing is rejected; without training rows every text is undetermined."""
    train = training(docs)
    all_levels = materialize(levels(materialize(gram_counts(train.filter("bucket > 1").select("text", "lang")), "grams")), "levels")
    order = F.length("gram").alias("k")
    by_length = all_levels.groupBy("lang", order).agg(F.count(F.when(F.col("n") == 1, 1)).alias("once"), F.count(F.when(F.col("n") == 2, 1)).alias("twice"))
    found = by_length.collect()
    discounts = {(r["lang"], r["k"]): r["once"] / (r["once"] + 2 * r["twice"]) if r["once"] and r["twice"] else 0.5 for r in found}
    langs = sorted({r["lang"] for r in found})
    context = F.expr("reverse(left(gram, length(gram) - 1))").alias("context")
    each = all_levels.select("lang", "gram", order, context, "n")
    totals = each.groupBy("lang", "k", "context").agg(F.sum("n").alias("total"))
    folder = new_folder(docs.sparkSession, "model")
    each.join(totals, ["lang", "k", "context"]).drop("k").write.option("compression", "zstd").parquet(folder)
    rows = docs.sparkSession.read.parquet(folder)
    (low, high), *further = ranges(rows, len(langs), cells)
    model = block(rows, discounts, langs, low, high)
    model.further, model.folder, model.discounts = further, folder, discounts
    if model.langs and calibration_rows != 0:
        own = train.filter("bucket = 1")
        if calibration_rows is not None:
            some = own.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(calibration_rows)  # ids alone meet in one task
            own = own.join(F.broadcast(some), "doc_id", "left_semi")
        calibrate(model, own.select("text", "lang"))
    return model


def with_entropies(rows: DataFrame, model: Model, use: Callable, schema: str) -> DataFrame:
    """What ``use`` makes of (batch, cross-entropies, numbers of characters, whether there are letters) of all rows of a table with a column text. A model of one block
    takes one pass; else the texts are written once, and each block's sums, which are added up in the order of the blocks."""
    if not model.further:

        def run(batches):
            yield from use((b, *model.cross_entropies(b.column("text").to_pylist())) for b in text_slices(batches))

        return rows.mapInArrow(tidy(run), schema)
    spark, carried = rows.sparkSession, [c for c in rows.columns if c != "text"]
    texts, folder, width = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "texts"), new_folder(rows.sparkSession, "sums"), len(model.langs)
    for i, own in enumerate(model.blocks(spark)):

        def sums(batches, own=own, i=i):
            for b in text_slices(batches):
                total, n, has = own.sums(b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("row"), pa.array([i] * len(n), pa.int32()), pa.array(list(total), pa.list_(pa.float64())), pa.array(n, pa.int64()), pa.array(has)], names=["row", "block", "sums", "n", "has"])

        texts.select("row", "text").mapInArrow(tidy(sums), "row long, block int, sums array<double>, n long, has boolean").write.mode("append").parquet(folder)
    parts = F.array_sort(F.collect_list(F.struct("block", "sums")))
    added = F.aggregate(parts, F.array_repeat(F.lit(0.0), width), lambda a, x: F.zip_with(a, x["sums"], lambda p, q: p + q))
    per_row = spark.read.parquet(folder).groupBy("row").agg(added.alias("sums"), F.max("n").alias("n"), F.max("has").alias("has"))

    def judged(batches):
        for b in batches:
            n, total = b.column("n").to_numpy(), b.column("sums").flatten().to_numpy().reshape(-1, width)
            yield b, -total / np.maximum(n, 1)[:, None], n, b.column("has").to_numpy(zero_copy_only=False)

    return texts.select("row", *carried).join(per_row, "row").drop("row").mapInArrow(tidy(lambda batches: use(judged(batches))), schema)


def calibrate(model: Model, rows: DataFrame) -> None:
    """The scale that makes the labels likeliest, and for each language the cross-entropy that all but REJECT of its rightly judged rows stay below, to a part of
    BINS of a nat. Tasks send sums and counts, losses as whole numbers of 2^-20, so their order says nothing."""
    langs = model.langs

    def use(judged):
        losses, counts = np.zeros((len(langs), len(SCALES)), np.int64), {}
        for b, ce, n, has in judged:
            y = pc.fill_null(pc.index_in(b.column("lang"), pa.array(langs, pa.string())), -1).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(has & (y >= 0))
            ce, n, y = ce[at], n[at], y[at]
            for i, s in enumerate(SCALES if len(at) else ()):
                loss = -np.log(np.maximum(probabilities(ce, n, s)[np.arange(len(y)), y], 1e-12))
                np.add.at(losses[:, i], y, np.round(loss * (1 << 20)).astype(np.int64))
            right = np.flatnonzero(ce.argmin(axis=1) == y) if len(at) else at
            bins, many = np.unique(np.stack([y[right], np.ceil(ce[right, y[right]] * BINS).astype(np.int64)]), axis=1, return_counts=True)
            for k, x, m in zip(*bins.tolist(), many.tolist(), strict=True):
                counts[k, x] = counts.get((k, x), 0) + m
        out = [(k, -1 - i, int(losses[k, i])) for k in range(len(langs)) for i in range(len(SCALES))] + [(*key, m) for key, m in counts.items()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["lang", "at", "n"])

    got = with_entropies(rows, model, use, "lang int, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).collect()
    loss = [sum(r["n"] for r in got if r["at"] == -1 - i) for i in range(len(SCALES))]
    if any(loss):
        model.scale = float(SCALES[int(np.argmin(loss))])
    for k, lang in enumerate(langs):
        own = sorted((r["at"], r["n"]) for r in got if r["lang"] == k and r["at"] >= 0)
        many = np.cumsum([n for _, n in own])
        if len(own) and many[-1] >= 20:
            model.limits[lang] = own[int(np.searchsorted(many, (1 - REJECT) * many[-1]))][0] / BINS


def languages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (probability among the learned languages), accepted of every row's whole text.

    lang_pred is the learned language of the lowest cross-entropy per character, of equal ones the first by name; und, with score
    0, for null and empty texts and those without a letter, and for all where nothing could be learned. accepted is false for those and for texts
    whose cross-entropy is above what calibration found for their language: text in none of the learned languages. Null ids and
    repeated rows are judged like any other; other columns have no part in it. Empty table: empty result.
    """

    langs, scale, limits = model.langs, model.scale, model.limits

    def use(judged):
        for b, ce, n, has in judged:
            lang, score, fits = verdicts(langs, scale, limits, ce, n, has)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(fits)], names=["doc_id", "lang_pred", "score", "accepted"])

    return with_entropies(documents(docs), model, use, "doc_id long, lang_pred string, score double, accepted boolean")
