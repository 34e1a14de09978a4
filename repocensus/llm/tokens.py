"""Token ids of whole texts, and a content-addressed store for them.

The store cuts id streams into chunks where a rolling hash of the last ids says so, keeps each distinct chunk once, and
writes for each document a recipe of chunk digests with a Merkle root. Files hold documents in ascending doc_id order.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from array import array
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialize, new_folder, partitions, sized_slices, tidy

#: WINDOW and MEAN are powers of two.
WINDOW, MEAN, LEAST, MOST = 16, 512, 64, 4096
DIGEST = 16
NO_ID = -(2**63)
#: The digests of a recipe, one by one.
PARTS = f"transform(sequence(0, size(lens) - 1), i -> substring(digests, i * {DIGEST} + 1, {DIGEST}))"
_GEAR = np.random.default_rng(7).integers(0, 2**63, 2**16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Encoder:
    """Ids of whole texts by the tokenizers library.

    A space that stands between two other characters always begins a new word for the tokenizers used here, so a text's
    ids are the ids of its pieces between such spaces, one after the other. A text with a piece for which that isn't certain
    (other white space at its edges, a combining mark, a special token) is encoded as a whole. Within a piece, a run of
    letters, the signs behind it and a line's end are words of their own; such words go to the library's model directly,
    without its search for words and its offsets. Arrow cuts many texts at once, finds their distinct pieces and words, and
    puts the ids in every place, so Python meets a word once in a call. Words and other pieces are remembered, in about
    ``room`` bytes.
    """

    LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
    SIGNS = ".,;:!?$%&*#|()\"/-"
    PLAIN = re.compile(rf"([{LETTERS}]+)([{re.escape(SIGNS)}]*)")
    #: Longer pieces and words aren't remembered. Bytes that an entry takes besides its characters, about.
    LONGEST, ENTRY = 48, 200

    def __init__(self, path: str, room: int = 208 << 20):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.entries = room // 8 // self.ENTRY  # of these, three parts are for words
        self.forms = self._forms()
        #: Whether a word's ids are those of the word in lower case, and those of the word without a space before it.
        self.folds = bool(self.forms) and all(x == self.forms.get(ord(chr(c).lower())) and (x == chr(c) or not "a" <= chr(c) <= "z") for c, x in self.forms.items())
        self.alike = bool(self.forms) and not self.forms[32]
        self.forget()

    def forget(self) -> None:
        self.ids: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.older_words: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}

    def _forms(self) -> dict[int, str] | None:
        """What the tokenizer's normalizer and pre-tokenizer make of each character of plain words; None if words can't go to the model alone."""
        t, forms = self.tokenizer, {}
        chars = [chr(c) for c in range(32, 256) if re.fullmatch(f"[{self.LETTERS}]", chr(c))] + list(self.SIGNS)
        for c in [*chars, "\n", " "]:
            x = t.normalizer.normalize_str(c) if t.normalizer else c
            parts = t.pre_tokenizer.pre_tokenize_str(x) if t.pre_tokenizer else [(x, (0, 1))]
            if len(parts) > 1:
                return None
            forms[ord(c)] = parts[0][0] if parts else ""
        probes = [*chars, "\n", " a", " Zé", " Überall", "word", " \u00c5ngström", "&&&", '."', " naïveté"]
        return forms if all(self._modelled(x, forms) == self.whole(x) for x in probes) else None

    def _modelled(self, word: str, forms: dict[int, str]) -> bytes:
        form = word.translate(forms)
        return array("I", [x.id for x in self.tokenizer.model.tokenize(form)]).tobytes() if form else b""

    @staticmethod
    def certain(piece: str) -> bool:
        return bool(piece) and not piece[0].isspace() and not piece[-1].isspace() and not unicodedata.combining(piece[0]) and piece[0] < "ᄀ" and "<|" not in piece

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _spaced(self, words: list[str]) -> list[bytes]:
        """Ids of a space and a run of letters, which are in lower case if case doesn't matter; each word once."""
        out = list(map(self.words.get, words))
        lacks = [i for i, x in enumerate(out) if x is None]
        older = [self.older_words.get(words[i]) for i in lacks]
        new = [words[i] for i, x in zip(lacks, older, strict=True) if x is None]
        forms, lead, tokenize = self.forms, self.forms[32], self.tokenizer.model.tokenize
        ids: list[int] = []
        ends = [0]
        for word in new:
            ids += [x.id for x in tokenize(lead + (word if self.folds and word.isascii() else word.translate(forms)))]
            ends.append(4 * len(ids))
        raw = array("I", ids).tobytes()
        learned = iter([raw[i:j] for i, j in pairwise(ends)])
        for i, x in zip(lacks, older, strict=True):
            out[i] = x = next(learned) if x is None else x
            if len(words[i]) <= self.LONGEST:
                self.words[words[i]] = x
        return out

    def _word(self, word: str) -> bytes:
        """Ids of signs, or of a word that no space stands before."""
        out = self.bare.get(word)
        if out is None:
            out = self._modelled(word, self.forms)
            if len(word) <= self.LONGEST:
                self.bare[word] = out
        return out

    def _part(self, part: str, spaced: bool) -> bytes | None:
        """Ids of a run of letters and the signs behind it, or None if ``part`` is something else."""
        m = self.PLAIN.fullmatch(part) if self.forms else None
        if m is None:
            return None
        key = m[1].lower() if self.folds else m[1]
        word = (self.words.get(key) or self._spaced([key])[0]) if spaced or self.alike else self._word(m[1])
        return word + self._word(m[2]) if m[2] else word

    def _parts(self, piece: str) -> bytes:
        """Ids of " " + piece."""
        out = [self._part(x, not i) for i, x in enumerate(piece.split("\n"))] if self.forms else [None]
        return self.whole(" " + piece) if None in out else self._word("\n").join(out) if len(out) > 1 else out[0]

    def _other(self, piece: str) -> bytes:
        """Ids of " " + piece, where that isn't one word and the signs behind it; UNSURE if it can't be encoded alone."""
        got = self.ids.get(piece)
        if got is None:
            got = self.older.get(piece)
            if got is None:
                got = self._parts(piece) if self.certain(piece) else UNSURE
            if len(piece) <= self.LONGEST and "\n" not in piece:  # few of these come again
                self.ids[piece] = got
        return got

    def _look_up(self, pieces: pa.Array, names: list[str], used: np.ndarray) -> list[bytes]:
        """Ids of " " + piece for distinct pieces; UNSURE for those that can't be encoded alone, nothing for those not used."""
        out, plain = [b""] * len(names), np.zeros(len(names), bool)
        if self.forms:
            words = pc.ascii_rtrim(pieces, characters=self.SIGNS)
            plain = pc.match_substring_regex(words, rf"\A[{self.LETTERS}]+\z").to_numpy(zero_copy_only=False)
            which = np.flatnonzero(plain & used)
            signs = pc.subtract(pc.binary_length(pieces), pc.binary_length(words)).to_numpy()[which]
            words = words.take(pa.array(which))
            words = (pc.utf8_lower(words) if self.folds else words).dictionary_encode()
            ids = self._spaced(words.dictionary.to_numpy(zero_copy_only=False).tolist())
            which = which.tolist()
            signs = [names[i][-n:] if n else "" for i, n in zip(which, signs.tolist(), strict=True)]
            of_signs = {x: self._word(x) if x else b"" for x in set(signs)}
            for i, word, x in zip(which, words.indices.to_numpy().tolist(), signs, strict=True):
                out[i] = ids[word] + of_signs[x] if x else ids[word]
        for i in np.flatnonzero(used & ~plain).tolist():
            out[i] = self._other(names[i])
        return out

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.ids) > self.entries:  # what wasn't seen for a while goes
            self.ids, self.older = {}, self.ids
        if len(self.words) > 3 * self.entries:
            self.words, self.older_words = {}, self.words
        if len(self.bare) > self.entries // 2:
            self.bare = {}
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        if not len(texts):
            return []
        cut = pc.split_pattern(texts, " ")
        bounds = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        coded = cut.flatten().dictionary_encode()
        names, places = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), np.array(coded.indices)
        heads = [names[i] for i in places[bounds[:-1]].tolist()]
        places[bounds[:-1]] = len(names)  # no space stands before a head: its ids come apart
        used = np.zeros(len(names) + 1, bool)
        used[places] = True
        got = [*self._look_up(coded.dictionary, names, used[:-1]), b""]
        unsure = {i for i, x in enumerate(heads) if not self.certain(x)}
        if UNSURE in got:
            at = np.flatnonzero(np.array([x == UNSURE for x in got])[places])
            unsure.update((np.searchsorted(bounds, at, "right") - 1).tolist())
        placed = pa.array(got, pa.binary()).take(pa.array(places))
        _, ends, ids = placed.buffers()
        ids, at = memoryview(ids or b""), np.frombuffer(ends, np.int32)[placed.offset :][bounds].tolist()
        out = []
        for i, head in enumerate(heads):
            if i in unsure:
                out.append(self.whole(texts[i].as_py()))
            else:
                first = self._part(head, False)
                out.append(b"".join((self.whole(head) if first is None else first, ids[at[i] : at[i + 1]])))
        return out


#: Stands for the ids of a piece that can't be encoded alone; no piece has these.
UNSURE = b"?"


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def token_ids(docs: DataFrame, path: str, end_id: int, then=None, schema: str = "doc_id long, ids binary") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit, ``end_id`` last) of every row; null text: only the end id.

    ``then`` goes on with the batches in the same task, and gives rows of ``schema``.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        for b in sized_slices(batches):
            ids = [x + end for x in encoder(path).encode(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    whole = (lambda batches: then(run(batches))) if then else run
    return documents(docs).mapInArrow(tidy(whole, lambda: encoder(path).forget(), keep=path), schema)


def chunk_lengths(docs: list[np.ndarray]) -> list[list[int]]:
    """Lengths of each document's content-defined chunks: a chunk ends where the rolling hash of the last WINDOW ids is 0 modulo MEAN."""
    starts = np.cumsum([0] + [len(x) + WINDOW for x in docs])  # nothing of the document before is in a window
    h = np.zeros(starts[-1], np.uint64)
    for at, ids in zip(starts.tolist(), docs, strict=False):
        h[at : at + len(ids)] = _GEAR[ids & 0xFFFF] ^ (ids >> 16 if ids.itemsize > 2 else 0)
    have = 1
    while have < WINDOW:  # of twice as many ids each time
        longer = h.copy()
        longer[have:] += h[: max(0, len(h) - have)] << np.uint64(have)
        h, have = longer, 2 * have
    h *= np.uint64(0x9E3779B97F4A7C15)
    marks = np.flatnonzero((h & np.uint64((MEAN - 1) << 40)) == 0) + 1
    cuts = np.searchsorted(marks, starts, "right").tolist()
    out, marks = [], marks.tolist()
    for start, ids, i, j in zip(starts.tolist(), docs, cuts, cuts[1:], strict=False):
        lens, at, end = [], 0, len(ids)
        for m in [*(m for x in marks[i:j] if (m := x - start) <= end), end]:
            while m - at > MOST:
                lens.append(MOST)
                at += MOST
            if m - at >= LEAST or m == end:
                if m > at:
                    lens.append(m - at)
                at = m
        out.append(lens)
    return out


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd node moves up as it is; nothing: the hash of nothing."""
    level = leaves or [hashlib.blake2b(b"", digest_size=DIGEST).digest()]
    while len(level) > 1:
        level = [hashlib.blake2b(b"\x01" + b"".join(level[i : i + 2]), digest_size=DIGEST).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _digest(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=DIGEST).digest()


def _lists(column: pa.ListArray, field: str | None = None) -> list[list]:
    """The lists of a column, or of one field of its structs, faster than its to_pylist; empty for null."""
    values = column.values.field(field) if field else column.values
    values, ends = values.to_numpy(zero_copy_only=False).tolist(), column.offsets.to_numpy().tolist()
    return [values[i:j] for i, j in pairwise(ends)]


def _split(raw: bytes) -> list[bytes]:
    return [raw[i : i + DIGEST] for i in range(0, len(raw), DIGEST)]


_PACK = "kind string, pack int, doc_id long, local_start long, n_tokens long, lens array<int>, digests binary, own array<int>, width int, payload binary, root binary"


def write_store(docs: DataFrame, path: str, end_id: int, folder: str) -> None:
    """Encode every row of ``docs`` and write the store into ``folder``.

    packs/: Parquet files in ascending doc_id order. A row of kind "document" has a recipe (lens and digests of all chunks,
    their Merkle root) and the payload of its private chunks (own). A chunk that several documents have is a row of kind
    "chunk", once, beside the smallest doc_id that has it. The last row of a file (kind "pack") has its token count and the
    Merkle root over its documents' roots. Ids take 16 bits each where all of a document's fit, else 32.

    Null text: the end id alone. A null doc_id sorts first. Repeated rows: a recipe for each, their chunks once. Empty
    table: an empty store. Texts are encoded once; the ids pass one shuffle.
    """
    spark = docs.sparkSession

    def cut(batches):
        for b in (b.slice(i, 64) for b in batches for i in range(0, b.num_rows, 64)):
            rows: tuple[list, ...] = ([], [], [], [])
            docs = [np.frombuffer(x, "<u4") for x in b.column("ids").to_pylist()]
            docs = [x.astype("<u2") if x.max() < 2**16 else x for x in docs]
            for ids, lens in zip(docs, chunk_lengths(docs), strict=True):
                raw, size, at, digests = ids.tobytes(), ids.itemsize, 0, []
                for n in lens:
                    digests.append(_digest(raw[at : at + n * size]))
                    at += n * size
                for c, v in zip(rows, (lens, b"".join(digests), size, raw), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows[0], pa.list_(pa.int32())), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.binary())], names=["doc_id", "lens", "digests", "width", "payload"])

    staged = materialize(token_ids(docs, path, end_id, cut, "doc_id long, lens array<int>, digests binary, width int, payload binary"), "staged")
    uses = staged.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.explode(F.array_distinct(F.expr(PARTS))).alias("digest"))
    shared = uses.groupBy("digest").agg(F.min("doc").alias("owner"), F.count("*").alias("n")).filter("n > 1").select("digest", "owner")
    marks = uses.join(materialize(shared, "shared"), "digest").select("doc", "digest", (F.col("doc") == F.col("owner")).alias("mine")).distinct()

    none = {c: F.lit(None).cast(t) for c, t in staged.dtypes}
    rows = staged.select("doc_id", F.lit(1).alias("kind"), "lens", "digests", "width", "payload")
    rows = rows.unionByName(marks.select(F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), F.lit(0).alias("kind"), none["lens"].alias("lens"), F.col("digest").alias("digests"), F.col("mine").cast("int").alias("width"), none["payload"].alias("payload")))
    rows = rows.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "kind", "digests", "payload")

    def pack(batches):
        from pyspark import TaskContext

        me, start, roots = TaskContext.get().partitionId(), 0, []
        doc, apart = object(), {}  # the document's chunks that others have too: whether they are still to be written here
        for b in batches:
            out = []
            for d, kind, lens, digests, size, payload in zip(*[_lists(b.column(c)) if c == "lens" else b.column(c).to_pylist() for c in ("doc_id", "kind", "lens", "digests", "width", "payload")], strict=True):
                if d != doc:
                    doc, apart = d, {}
                if kind == 0:
                    apart[digests] = bool(size)
                    continue
                own, kept, at, seen = [], [], 0, set()
                for i, (n, x) in enumerate(zip(lens, parts := _split(digests), strict=True)):
                    chunk = payload[at * size : (at + n) * size]
                    if x not in apart and x not in seen:
                        own.append(i)
                        kept.append(chunk)
                    elif apart.get(x):
                        apart[x] = False
                        out.append(("chunk", me, None, None, None, None, x, None, size, chunk, None))
                    seen.add(x)
                    at += n
                roots.append(merkle_root(parts))
                out.append(("document", me, d, start, at, lens, digests, own, size, b"".join(kept), roots[-1]))
                start += at
            if out:
                yield _packed(out)
        if roots:
            yield _packed([("pack", me, None, None, start, None, None, None, None, None, merkle_root(roots))])

    rows.mapInArrow(tidy(pack), _PACK).write.option("compression", "zstd").parquet(f"{folder}/packs")


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(map(list, zip(*rows, strict=True)), types, strict=True)], names=[x.split()[0] for x in _PACK.split(", ")])


class CorruptStore(Exception):
    """A chunk, recipe or pack that doesn't match its digest."""


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (tokens of all documents before), n_tokens, ids (little-endian unsigned 32-bit), n_chunks, root.

    Every chunk read is checked against its digest, every recipe against its root; a mismatch raises CorruptStore. Only
    documents with shared chunks are shuffled.
    """
    packs = spark.read.schema(_PACK).parquet(f"{folder}/packs")
    totals = packs.filter("kind = 'pack'").select("pack", "n_tokens")
    base = totals.select("pack", F.coalesce(F.sum("n_tokens").over(Window.orderBy("pack").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    docs = packs.filter("kind = 'document'")

    def rebuild(batches):
        for b in batches:
            ids, cols = [], [b.column(c).to_pylist() for c in ("digests", "width", "payload", "root")]
            lists = [_lists(b.column("lens")), _lists(b.column("own")), _lists(b.column("more"), "digest"), _lists(b.column("more"), "chunk")]
            for digests, size, payload, root, lens, own, names, chunks in zip(*cols, *lists, strict=True):
                parts, at, have = _split(digests), 0, dict(zip(names, chunks, strict=True))
                for i in own:
                    have[parts[i]] = payload[at : at + lens[i] * size]
                    at += lens[i] * size
                if merkle_root(parts) != root or any(_digest(v) != k for k, v in have.items()) or any(x not in have for x in parts):
                    raise CorruptStore(folder)
                out = b"".join(have[x] for x in parts)
                ids.append(out if size == 4 else np.frombuffer(out, "<u2").astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("doc_id", "pack", "local_start", "n_tokens")] + [pa.array(ids, pa.binary()), pa.array([len(x) for x in lists[0]], pa.int32()), b.column("root")], names=["doc_id", "pack", "local_start", "n_tokens", "ids", "n_chunks", "root"])

    mine = F.expr(f"transform(own, i -> substring(digests, i * {DIGEST} + 1, {DIGEST}))")
    lacks = F.array_except(F.expr(PARTS), mine)
    whole = docs.filter(F.size(lacks) == 0).withColumn("more", F.lit(None).cast("array<struct<digest:binary,chunk:binary>>"))
    partial = docs.filter(F.size(lacks) > 0)
    wants = materialize(partial.select("doc_id", F.col("root").alias("of"), F.explode(lacks).alias("digest")).distinct(), "wants")
    chunks = packs.filter("kind = 'chunk'").select(F.col("digests").alias("digest"), F.col("payload").alias("chunk"))
    more = wants.join(chunks, "digest").groupBy("doc_id", "of").agg(F.collect_list(F.struct("digest", "chunk")).alias("more"))
    partial = partial.join(more.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("root") == F.col("of"))).drop("_id", "of")
    cols = "doc_id long, pack int, local_start long, n_tokens long, ids binary, n_chunks int, root binary"
    keep = ["doc_id", "pack", "local_start", "n_tokens", "lens", "digests", "own", "width", "payload", "root", "more"]
    out = whole.select(*keep).unionByName(partial.select(*keep)).mapInArrow(tidy(rebuild), cols)
    return out.join(base, "pack").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids", "n_chunks", "root")


def store_token_ids(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """Write the documents' ids into a new store in the shared folder and read it back (see write_store, read_store)."""
    folder = new_folder(docs.sparkSession, "tokens")
    write_store(docs, path, end_id, folder)
    return read_store(docs.sparkSession, folder)
