"""Phrases that stand together more often than their parts would: level by level, candidates are counted by walking a
double-array trie with all places of a block of text at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, partitions, tidy

#: Bytes that end a piece, and bytes that only end a word.
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
UND = "und"
#: What one pass holds at most: words of the vocabulary, candidates of a trie. More of either take further passes.
WORDS_A_PASS, CANDIDATES_A_PASS = 2_000_000, 2_000_000
#: Sequences are of 2 to LONGEST words; places of the bitmap of hashed pairs, a fixed size; counts that are sent in one.
LONGEST, BITS, SHARD = 5, 1 << 26, 1 << 14
_CUT = -1  # stands before each piece in id streams; words that are too rare for any candidate are 0

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)] = 1
_KIND[list(ENDS)] = 2


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of the texts one behind the other, the text each is in, and whether a piece ends before it."""
    big = texts.cast(pa.large_binary())
    offsets = np.frombuffer(big.buffers()[1], np.int64)[big.offset : big.offset + len(big) + 1]
    lens = np.diff(offsets)
    raw = _FOLD[np.frombuffer(big.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]] if big.buffers()[2] is not None else np.zeros(0, np.uint8)
    kind = _KIND[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[offsets - offsets[0]] = True  # texts begin here; the last place is behind the end
    inside = kind == 0
    starts = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | first[:-1])) if len(raw) else np.zeros(0, np.int64)
    letters = np.concatenate([[0], np.cumsum(inside)])
    begins = letters[starts] if len(starts) else np.zeros(0, np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(begins, letters[-1]).astype(np.int64).tobytes()), pa.py_buffer(raw[inside].tobytes()))
    owner = np.searchsorted((offsets - offsets[0])[1:], starts, side="right")
    ended = np.concatenate([[0], np.cumsum((kind == 2) | first[:-1])]) if len(raw) else np.zeros(1, np.int64)
    marks = ended[starts + 1] if len(starts) else np.zeros(0, np.int64)
    return words, owner, np.concatenate([[True], marks[1:] != marks[:-1]])[: len(starts)]


def slices(batches, size: int = 4 << 20):
    """Slices of Arrow batches with text, of about ``size`` bytes (one row at least)."""
    for b in batches:
        n = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(n) // size
        edges = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]]) if len(part) else [0, 0]
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            if z > a:
                yield b.slice(int(a), int(z - a))


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of all words, counted in the tasks before they are shuffled."""

    def run(batches):
        for b in slices(batches):
            words, owner, _ = words_of(b.column("text"))
            langs = b.column("lang").to_pylist()
            names = sorted(set(langs))
            which = np.array([names.index(x) for x in langs])[owner]
            for k, name in enumerate(names):
                c = pc.value_counts(words.filter(pa.array(which == k)))
                if len(c):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(c), pa.string()), c.field("values").cast(pa.string()), c.field("counts")], names=["lang", "word", "n"])

    return docs.mapInArrow(tidy(run), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def numbered(rows: DataFrame, *order) -> tuple[DataFrame, int]:
    """``rows`` with their number from 1 in the given order, and how many there are: sorted in ranges, each moved by the sizes of those before."""
    inner = F.col("number").bitwiseAND(F.lit((1 << 33) - 1))
    own = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    own = materialize(own.withColumn("part", F.spark_partition_id()).withColumn("number", F.monotonically_increasing_id()), "sorted")
    sizes = sorted((r["part"], r["count"]) for r in own.groupBy("part").count().collect())  # a row a partition
    before, moved = 0, F.lit(0).cast("long")
    for part, n in sizes:
        moved = F.when(F.col("part") == part, F.lit(before)).otherwise(moved) if len(sizes) <= 64 else moved
        before += n
    if len(sizes) > 64:
        starts, at = [], 0
        for part, n in sizes:
            starts.append((part, at))
            at += n
        return own.join(F.broadcast(own.sparkSession.createDataFrame(starts, "part int, moved long")), "part").withColumn("number", inner + F.col("moved") + 1).drop("part", "moved"), before
    return own.withColumn("number", inner + moved + 1).drop("part"), before


def packed(data) -> pa.Array:
    """Bytes as one compressed value, so what Spark moves, and puts into one batch, is as large as what it reads from disk."""
    raw = data.tobytes() if isinstance(data, np.ndarray) else bytes(data)
    return pa.array([len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)], pa.binary())


def unpacked(value: pa.BinaryScalar) -> pa.Buffer:
    whole = value.as_buffer()
    return pa.decompress(whole.slice(8), int.from_bytes(whole.slice(0, 8).to_pybytes(), "little"), "zstd")


def encoded(docs: DataFrame, vocabulary: DataFrame, size: int, width: int) -> DataFrame:
    """(ids): streams of the numbers of frequent words, 0 for the others, a cut before each piece; 32 bits a word, packed, a row for each
    slice of the texts. ``vocabulary`` (number, lang, phrase, in numbers from 1 to ``size``) is given out ``width`` words at a time,
    each in a pass of its own; passes but the first fill in what those before left at 0, slice by slice."""
    out = docs.select("lang", "text")
    for low in range(1, max(size, 1) + 1, width):
        rows = vocabulary.filter(F.col("number").between(low, low + width - 1)).select("lang", "phrase", "number").toArrow()
        by_lang = {}
        for name in rows.column("lang").unique().to_pylist():
            own = rows.filter(pc.equal(rows.column("lang"), name))
            by_lang[name] = (own.column("phrase").combine_chunks().cast(pa.large_string()), own.column("number").to_numpy())
        first, last = low == 1, low + width > size

        def run(batches, by_lang=by_lang, first=first, last=last):
            for texts, before in ((b, None) for b in slices(batches)) if first else _slices_again(batches):
                stream = _stream(texts.column("lang").to_pylist(), texts.column("text"), by_lang)
                ids = packed(stream if first else np.maximum(stream, before))
                yield pa.RecordBatch.from_arrays([ids] if last else [packed(_ipc(texts)), ids], names=["ids"] if last else ["texts", "ids"])

        out = materialize(out.mapInArrow(tidy(run), "ids binary" if last else "texts binary, ids binary"), "ids")
    return out


def _ipc(batch: pa.RecordBatch) -> pa.Buffer:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue()


def _slices_again(batches):
    for b in batches:
        for texts, ids in zip(b.column("texts"), b.column("ids"), strict=True):
            yield pa.ipc.open_stream(unpacked(texts)).read_next_batch(), np.frombuffer(unpacked(ids), "<i4")


def _stream(langs: list[str], texts: pa.Array, by_lang: dict) -> np.ndarray:
    words, owner, begins = words_of(texts)
    ids, names = np.zeros(len(words), np.int32), sorted(set(langs))
    which = np.array([names.index(x) for x in langs])[owner]
    for k, name in enumerate(names):
        if name in by_lang and (own := np.flatnonzero(which == k)).size:
            at = pc.fill_null(pc.index_in(words.take(pa.array(own)), value_set=by_lang[name][0]), -1).to_numpy(zero_copy_only=False)
            ids[own[at >= 0]] = by_lang[name][1][at[at >= 0]]
    stream = np.full(len(ids) + int(begins.sum()), _CUT, np.int32)
    stream[np.arange(len(ids)) + np.cumsum(begins)] = ids
    return stream


class Trie:
    """A double-array trie over sequences of word numbers: from state s letter c leads to base[s] + c if check there says s.
    Letters are the places of the trie's own words among themselves, so the arrays are bounded by the sequences."""

    def __init__(self, sequences: np.ndarray):
        """``sequences``: rows of equal length, sorted, no two alike. Row i is accepted as number i."""
        rows, self.depth = sequences.shape
        self.words = np.unique(sequences)
        self.direct = np.zeros(int(self.words.max(initial=0)) + 1, np.int64) if self.words.max(initial=0) < 1 << 23 else None
        if self.direct is not None:
            self.direct[self.words] = np.arange(1, len(self.words) + 1)
        letters = np.searchsorted(self.words, sequences) + 1
        self.base, self.check = np.zeros(len(self.words) + 2 * rows + 16, np.int64), np.full(len(self.words) + 2 * rows + 16, -1, np.int64)
        self.taken = np.zeros(len(self.base), bool)
        self.taken[0] = True
        state, new = np.zeros(rows, np.int64), np.arange(rows) == 0
        for level in range(self.depth):
            letter, parent = letters[:, level], np.flatnonzero(new)
            new = new | np.append(True, letter[1:] != letter[:-1])[:rows]
            kids = np.flatnonzero(new)
            self._place(state[parent], letter[kids], np.append(np.searchsorted(kids, parent), len(kids)))
            target = self.base[state] + letter
            self.check[target], state = state, target
        self.number = np.full(len(self.base), -1, np.int64)
        self.number[state] = np.arange(rows)
        top = int(np.flatnonzero(self.taken).max()) + 1
        self.base, self.check, self.number = (x[:top].astype(np.int32) for x in (self.base, self.check, self.number))
        del self.taken

    def _place(self, states: np.ndarray, kids: np.ndarray, edges: np.ndarray) -> None:
        """Bases, negative ones too, such that all children fall on free places: first states with several, widest first, by trial; the many
        with one child then fill the free places one after the other. Among states of like width places that took one of them no more aren't tried
        again, so trials grow with the states and the places, not with both multiplied."""
        sizes, width, start = np.diff(edges), 0, 1
        for p in np.argsort(-sizes, kind="stable")[: int((sizes > 1).sum())]:
            own = kids[edges[p] : edges[p + 1]]
            spread = own - own[0]
            if int(sizes[p]).bit_length() != width:
                width = int(sizes[p]).bit_length()
                start = start if width > 8 else 1  # places beside the widest are for narrow ones
            while True:
                self._reach(start + 256 + int(spread[-1]))
                spots, done, step = np.flatnonzero(~self.taken[start : start + 256]) + start, 1, 16
                while len(spots) and done < len(spread):
                    spots = spots[~self.taken[spots[:, None] + spread[done : done + step]].any(axis=1)]
                    done, step = done + step, 4 * step
                if len(spots):
                    break
                start += 256
            fit = int(spots[0])
            self.taken[fit + spread] = True
            self.base[states[p]] = fit - own[0]
        one = np.flatnonzero(sizes == 1)
        if len(one):
            self._reach(int(self.taken.sum()) + len(one))
            spots = np.flatnonzero(~self.taken)[: len(one)]
            self.taken[spots] = True
            self.base[states[one]] = spots - kids[edges[one]]

    def _reach(self, need: int) -> None:
        if need >= len(self.taken):
            more = max(need + 1 - len(self.taken), len(self.taken) // 2)
            self.base, self.check, self.taken = np.append(self.base, np.zeros(more, np.int64)), np.append(self.check, np.full(more, -1, np.int64)), np.append(self.taken, np.zeros(more, bool))

    def walk(self, ids: np.ndarray) -> np.ndarray:
        """For each place of the stream the number of the sequence that begins there, or -1; all places take a step at a time."""
        if self.direct is not None:
            letters = self.direct[np.where((ids > 0) & (ids < len(self.direct)), ids, 0)]
        else:
            at = np.minimum(np.searchsorted(self.words, ids), len(self.words) - 1)
            letters = np.where(self.words[at] == ids, at + 1, 0)
        out, at = np.full(len(ids), -1, np.int64), np.arange(max(len(ids) - self.depth + 1, 0))
        state = np.zeros(len(at), np.int64)
        for level in range(self.depth):
            letter = letters[at + level]
            to = self.base[state] + letter
            ok = (letter > 0) & (to >= 0) & (to < len(self.check))
            ok[ok] = self.check[to[ok]] == state[ok]
            at, state = at[ok], to[ok]
        out[at] = self.number[state]
        return out


def _ints(batch: pa.RecordBatch, col: str, kind: str = "<i4") -> Iterator[np.ndarray]:
    """The streams of a batch, a cut behind each: a piece begins with a cut, but nothing ends the last."""
    for x in batch.column(col):
        yield np.append(np.frombuffer(unpacked(x), kind), np.array([_CUT], kind))


def with_numbers(ids: DataFrame, frequent: DataFrame, size: int, width: int) -> DataFrame:
    """(numbers): for each stream the number of the frequent sequence (number, words) that begins at each place, else 0, 64 bits
    each; a pass for ``width`` sequences."""
    out, lows = ids, [low for low in range(1, size + 1, width) if not frequent.filter(F.col("number").between(low, low + width - 1)).isEmpty()]
    for low in lows:
        numbers, words = sequences(frequent, low, width)
        trie, numbers = Trie(words), np.append(numbers, 0)

        def run(batches, trie=trie, numbers=numbers, first=low == lows[0], last=low == lows[-1]):
            for b in batches:
                for i, s in enumerate(_ints(b, "ids")):
                    got = numbers[trie.walk(s)[:-1]]
                    if not first:
                        got = np.maximum(got, np.frombuffer(unpacked(b.column("numbers")[i]), "<i8"))
                    found = packed(got.astype("<i8"))
                    yield pa.RecordBatch.from_arrays([found] if last else [b.column("ids").slice(i, 1), found], names=["numbers"] if last else ["ids", "numbers"])

        out = materialize(out.mapInArrow(tidy(run), "numbers binary" if low == lows[-1] else "ids binary, numbers binary"), "numbers")
    return out if lows else ids.select(F.col("ids").alias("numbers")).limit(0)


def sequences(rows: DataFrame, low: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from ``low`` on and below ``low + width``, rising, and the words of the sequences that bear them, which rise with them."""
    got = rows.filter(F.col("number").between(low, low + width - 1)).select("number", "words").toArrow()
    numbers = got.column("number").to_numpy()
    words = got.column("words").combine_chunks().flatten().to_numpy().reshape(got.num_rows, -1 if got.num_rows else 0).astype(np.int64)
    return numbers[np.argsort(numbers)], words[np.argsort(numbers)]


def _bucket(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) + np.uint64(0x7F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.int64)


def _pairs(batches, kind: str):
    """Numbers of the frequent sequences at places where one stands a word behind another."""
    for b in batches:
        for n in _ints(b, "numbers", kind):
            at = np.flatnonzero((n[:-1] > 0) & (n[1:] > 0))
            yield n[at].astype(np.int64), n[at + 1].astype(np.int64)


def _distinct(a: np.ndarray, b: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Each pair of numbers of up to ``top`` once."""
    if top < 3_000_000_000:
        key = np.unique(a * (top + 1) + b)
        return key // (top + 1), key % (top + 1)
    return tuple(np.unique(np.stack([a, b]), axis=1))


def summed(counts: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers of all (numbers, counts), and their counts added up. What came is held until it is as much as the sum so far, so work grows with what
    comes, not with that times the sum."""
    numbers, n, held, many = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def merge():
        found, back = np.unique(np.concatenate([numbers, *(h[0] for h in held)]), return_inverse=True)
        out = np.zeros(len(found), np.int64)
        np.add.at(out, back, np.concatenate([n, *(h[1] for h in held)]))
        return found, out

    for own in counts:
        held.append(own)
        many += len(own[0])
        if many > max(len(numbers), 1 << 18):
            (numbers, n), held, many = merge(), [], 0
    return merge() if held else (numbers, n)


def candidates(rows: DataFrame, least: int, top: int, kind: str = "<i8") -> DataFrame:
    """(a, b), each once: numbers of frequent sequences of k words that stand a word apart somewhere, so that both parts of the
    sequence of k + 1 words are frequent, and whose hash of 32 bits is met ``least`` times or more. Both hold for every frequent
    sequence; others may pass, for a hash says nothing about one pair: the trie counts. Tasks leave out what a bitmap of the full
    hashes, folded to BITS places, shows at once; what is left of all tasks is matched hash by hash, packed in parts that grow with the partitions."""

    shift = 32 - max(8, min(20, (2 * partitions(rows.sparkSession)).bit_length()))  # parts grow with the partitions

    def sums(held):
        bucket, n = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        found, back = np.unique(bucket, return_inverse=True)
        n = np.bincount(back, weights=n, minlength=len(found)).astype(np.int64)
        part = found >> shift
        for p in np.unique(part):
            own = part == p
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([found[own].astype("<u4").tobytes()], pa.binary()), pa.array([n[own].astype("<i8").tobytes()], pa.binary())], names=["part", "buckets", "counts"])

    def tally(batches):
        held, many = [], 0
        for a, b in _pairs(batches, kind):
            held.append(np.unique(_bucket(a, b), return_counts=True))
            many += len(held[-1][0])
            if many > 2_000_000:
                yield from sums(held)
                held, many = [], 0
        if held:
            yield from sums(held)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, n = summed((np.frombuffer(x.as_py(), "<u4").astype(np.int64), np.frombuffer(y.as_py(), "<i8")) for t in batches for x, y in zip(t.column("buckets"), t.column("counts"), strict=True))
        full = bucket[n >= least]
        yield pa.RecordBatch.from_arrays([pa.array(full >> shift, pa.int32()), pa.array(full)], names=["part", "bucket"])

    def bitmap(batches):
        bits = np.zeros(BITS >> 3, np.uint8)
        for b in batches:
            at = b.column("bucket").to_numpy() % BITS
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        at = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(bits[at], pa.int32())], names=["place", "bits"])

    full = materialize(rows.mapInArrow(tidy(tally), "part int, buckets binary, counts binary").groupBy("part").applyInArrow(total, "part int, bucket long"), "buckets")
    got = full.mapInArrow(tidy(bitmap), "place int, bits int").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    known = np.zeros(BITS >> 3, np.uint8)
    known[got.column("place").to_numpy()] = got.column("bits").to_numpy()

    def found(held):
        a, b = _distinct(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), top)
        part = _bucket(a, b) >> shift
        order = np.argsort(part, kind="stable")
        edges = np.flatnonzero(np.append(True, part[order][1:] != part[order][:-1])) if len(part) else np.zeros(0, np.int64)
        for at in np.split(order, edges[1:]) if len(edges) else []:
            yield pa.RecordBatch.from_arrays([pa.array(part[at[:1]], pa.int32()), packed(np.stack([a[at], b[at]], axis=1).astype("<i8"))], names=["part", "pairs"])

    def find(batches):
        held, many = [], 0
        for a, b in _pairs(batches, kind):
            h = _bucket(a, b) % BITS
            ok = (known[h >> 3] >> (h & 7)) & 1 > 0
            held.append(_distinct(a[ok], b[ok], top))
            many += len(held[-1][0])
            if many > 2_000_000:
                yield from found(held)
                held, many = [], 0
        if held:
            yield from found(held)

    def matched(buckets: pa.Table, pairs: pa.Table) -> pa.Table:
        both = [np.frombuffer(unpacked(x), "<i8").reshape(-1, 2) for x in pairs.column("pairs")]
        a, b = _distinct(*np.concatenate(both).T, top) if both else (np.zeros(0, np.int64),) * 2
        ok = np.isin(_bucket(a, b), buckets.column("bucket").to_numpy())
        return pa.table({"a": pa.array(a[ok]), "b": pa.array(b[ok])})

    pairs = rows.mapInArrow(tidy(find), "part int, pairs binary")
    return full.groupBy("part").cogroup(pairs.groupBy("part")).applyInArrow(matched, "a long, b long")


def counted(ids: DataFrame, rows: DataFrame, size: int, width: int) -> DataFrame:
    """(number, n): how often each sequence (number, words) stands in the streams, overlaps included; a pass for ``width`` sequences.
    Each task counts in one array, and sends it packed in parts of SHARD numbers, which are summed as arrays."""
    out = None
    for low in range(1, size + 1, width):
        trie = Trie(sequences(rows, low, width)[1])

        def run(batches, trie=trie, low=low, n=min(width, size + 1 - low)):
            own = np.zeros(n, np.int64)
            for b in batches:
                for s in _ints(b, "ids"):
                    hit = trie.walk(s)
                    own += np.bincount(hit[hit >= 0], minlength=n)
            for at in range(0, n, SHARD):
                if own[at : at + SHARD].any():
                    yield pa.RecordBatch.from_arrays([pa.array([low + at], pa.int64()), packed(own[at : at + SHARD].astype("<i8"))], names=["first", "counts"])

        def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first, n = 0, np.zeros(0, np.int64)
            for b in batches:
                for f, x in zip(b.column("first").to_pylist(), b.column("counts"), strict=True):
                    own = np.frombuffer(unpacked(x), "<i8")
                    first, n = f, own + n if len(n) else own
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(first + at, pa.int64()), pa.array(n[at], pa.int64())], names=["number", "n"])

        got = ids.mapInArrow(tidy(run), "first long, counts binary").groupBy("first").applyInArrow(total, "number long, n long")
        out = got if out is None else out.unionByName(got)
    return out


def phrases(docs: DataFrame, least: int = 100, longest: int = LONGEST, width: int = CANDIDATES_A_PASS) -> tuple[DataFrame, DataFrame]:
    """Frequent phrases (lang, phrase, length, n) of 1 to ``longest`` words, and (lang, n) of all words.

    Pieces end at ``ENDS``, words also at blanks; A-Z count as a-z. A null lang counts as und, a null text as empty; repeated
    rows count each time, null ids like any other. Words of any length and texts of any length are taken whole. Empty table,
    or nothing frequent: empty results. Every level holds one block of at most ``width`` sequences in memory, in driver and tasks.
    """
    docs = docs.select(F.coalesce("lang", F.lit(UND)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    words = materialize(word_counts(docs), "words")
    level, size = numbered(words.filter(F.col("n") >= least).select("lang", F.col("word").alias("phrase"), "n"), F.desc("n"), "lang", "phrase")
    level = materialize(level.withColumn("words", F.array(F.col("number").cast("int"))).withColumn("last", F.col("phrase")), "level")
    ids = encoded(docs, level, size, min(WORDS_A_PASS, width))
    out, rows, kind = level.withColumn("length", F.lit(1)), ids.select(F.col("ids").alias("numbers")), "<i4"
    for k in range(2, longest + 1):
        if not size:
            break
        pairs = candidates(rows, least, size, kind)
        first, second = level.select(F.col("number").alias("a"), "lang", "words", "phrase"), level.select(F.col("number").alias("b"), F.element_at("words", -1).alias("w"), F.col("last").alias("last"))
        found = pairs.join(first, "a").join(second, "b").select("lang", F.array_append("words", F.col("w")).alias("words"), F.concat_ws(" ", "phrase", "last").alias("phrase"), "last")
        found, size = numbered(found, "words")
        if not size:
            break
        level = materialize(found.join(counted(ids, found, size, width).filter(F.col("n") >= least), "number"), "level")
        out = out.unionByName(level.withColumn("length", F.lit(k)))
        if k < longest:
            rows, kind = with_numbers(ids, level, size, width), "<i8"
    return out.select("lang", "phrase", "length", "n"), words.groupBy("lang").agg(F.sum("n").alias("n"))


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, longest: int = LONGEST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of each lang the ``top`` phrases of 2 to ``longest`` words that stand together most beyond
    what their parts would (see ``phrases`` for what counts).

    a = f(phrase), l and r the counts of the parts at its weakest cut, score floor(1000 a n / (l r)) there, of equal ones the
    cut after fewest words. A phrase goes if a longer frequent one holds it and is as frequent: then one that is a word longer is,
    too, as nothing between the two can be rarer than the longer or more frequent than the shorter. Ranks are by score and a falling, phrase rising.
    """
    found, totals = phrases(docs, least, longest)
    found = materialize(found, "phrases")
    several = found.filter("length > 1").select("lang", "phrase", "length", F.col("n").alias("a"))
    inner = [F.expr("substring_index(phrase, ' ', length - 1)"), F.expr("substring_index(phrase, ' ', 1 - length)")]
    longer = several.filter("length > 2").select("lang", F.explode(F.array(*inner)).alias("phrase"), F.col("a").alias("within")).groupBy("lang", "phrase").agg(F.max("within").alias("within"))
    left = several.join(longer, ["lang", "phrase"], "left").filter("within is null or 100 * within < 100 * a").drop("within")
    cuts = left.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("length") - 1)))
    cuts = cuts.withColumn("head", F.expr("substring_index(phrase, ' ', k)")).withColumn("tail", F.expr("substring_index(phrase, ' ', k - length)"))
    f = found.select("lang", "phrase", "n")
    cuts = cuts.join(f.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"]).join(f.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r")), ["lang", "tail"])
    score = F.expr("(cast(1000 * a as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    scored = cuts.join(totals, "lang").withColumn("score", score)
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))  # so no task orders all phrases of a language
    near = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
