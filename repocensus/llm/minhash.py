"""MinHash near-dedup: b-bit signatures, banded candidates, links confirmed on whole shingle sets."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, documents, materialize, partitions, text_slices, tidy

ROWS, BANDS, BITS = 8, 80, 2
N_HASH = ROWS * BANDS
LONGS = N_HASH * BITS // 64
#: So many texts are confirmed with one copy of the text that they are compared with.
TOGETHER = 128

_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 2**31, N_HASH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_MIX = _rng.integers(0, 2**63, (ROWS,), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(0, 2**63, (BANDS,), dtype=np.uint64)
_STEP = _rng.integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = _rng.integers(0, 2**63, N_HASH, dtype=np.uint64)
EMPTY = np.empty(0, np.uint64)


class _WordHash(dict):
    """Eight bytes for each word, made once; long words aren't kept, and all are dropped when there are too many, or the task ends."""

    def __missing__(self, word: bytes) -> bytes:
        out = xxhash.xxh3_64_digest(word)
        if len(word) <= 48:
            if len(self) > 100_000:
                self.clear()
            self[word] = out
        return out


_words = _WordHash()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct word shingles.

    Words are maximal runs of anything but space and \\t to \\r; A-Z are lower-cased. With fewer than ``width`` words the
    whole sequence is one shingle; without words the set is empty.
    """
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return EMPTY
    h = np.frombuffer(b"".join(map(_words.__getitem__, words)), "<u8")
    n = min(width, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        out = _mixed(out ^ h[i : len(h) - n + 1 + i]) * _STEP[i % 16]
    return np.unique(_mixed(out))


def minima(x: np.ndarray) -> np.ndarray:
    """The 32-bit minimum of each of the N_HASH multiplicative hashes."""
    m = np.full(N_HASH, 2**32 - 1, np.uint32)
    short = (x >> np.uint64(24)).astype(np.uint32)
    for at in range(0, len(short), 2048):
        np.minimum(m, np.multiply.outer(_A, short[at : at + 2048]).min(axis=1), out=m)
    return m.astype(np.uint64)


def packed(m: np.ndarray) -> np.ndarray:
    """BITS bits of each minimum, packed into LONGS 64-bit integers.

    A minimum is mixed with the salt of its hash first: the low bits of odd multiples of two values agree in all hashes or in
    none, those of the mixed ones independently.
    """
    low = (_mixed(_mixed(m ^ _SALT)) & np.uint64(2**BITS - 1)).reshape(LONGS, 64 // BITS)
    return (low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64).view(np.int64)


def band_keys(m: np.ndarray) -> np.ndarray:
    return _mixed((m.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64) ^ _BAND).view(np.int64)


def similarity(jaccard_of: str, other: str):
    """Column: likeness of two packed signatures by bit counts, corrected for low bits that agree by chance."""
    fold = " + ".join(f"bit_count((x{i} | shiftrightunsigned(x{i}, 1)) & 6148914691236517205L)".replace(f"x{i}", f"({jaccard_of}.sig[{i}] ^ {other}.sig[{i}])") for i in range(LONGS))
    chance = 1 / 2**BITS
    return F.expr(f"(1 - ({fold}) / {float(N_HASH)}D - {chance}D) / {1 - chance}D")


def cut_below(threshold: float, sigmas: float = 4.5) -> float:
    """The estimate below which a pair at ``threshold`` practically never falls."""
    chance = 1 / 2**BITS
    p = threshold + (1 - threshold) * chance
    return threshold - sigmas * math.sqrt(p * (1 - p) / N_HASH) / (1 - chance)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, packed signature, band keys (the last two null for an empty set)."""

    def run(batches):
        for b in text_slices(batches):
            cols: tuple[list, ...] = ([], [], [], [])
            for text in b.column("text").to_pylist():
                s = shingle_set(text, width)
                m = minima(s) if len(s) else None
                for c, v in zip(cols, (len(s), xxhash.xxh3_128_digest(s.tobytes()), None if m is None else packed(m), None if m is None else band_keys(m)), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.list_(pa.int64())), pa.array(cols[3], pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "digest", "sig", "bands"])

    return documents(docs).mapInArrow(tidy(run, _words.clear), "doc_id long, n_shingles long, digest binary, sig array<long>, bands array<long>")


def lone_shingles(ids: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(rep, lone): how many shingles of each document in ``ids`` (rep) no other one of them has; documents without such are left out.

    The ids grow with the documents: texts are shuffled to them at every size, none is broadcast.
    """

    def run(batches):
        for b in text_slices(batches):
            sets = [shingle_set(x, width).view(np.int64) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], names=["rep", "h"])

    sets = documents(docs).join(ids.withColumnRenamed("rep", "doc_id").hint("merge"), "doc_id", "left_semi").mapInArrow(tidy(run, _words.clear), "rep long, h array<long>")
    one = sets.select("rep", F.explode("h").alias("h")).groupBy("h").agg(F.count("*").alias("n"), F.min("rep").alias("rep")).filter("n = 1")
    return one.groupBy("rep").agg(F.count("*").alias("lone"))


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, threshold: float) -> DataFrame:
    """Of distinct pairs (a, b) those whose whole shingle sets have 100 * intersection >= 100 * threshold * union.

    The texts of TOGETHER or so partners of ``a`` come behind one copy of its own, in as many groups as it takes.
    """
    per_cent = round(100 * threshold)
    pairs, texts = materialize(pairs, "pairs"), documents(docs)
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("parts"))
    second = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b").join(texts.withColumnRenamed("doc_id", "b"), "b")
    first = parts.join(texts.withColumnRenamed("doc_id", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "text")
    rows = first.unionByName(second.select("a", "part", "b", "text")).repartition(partitions(docs.sparkSession), "a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def run(batches):
        key, left = None, []  # the sets of ``a``: more than one where rows share its id
        for batch in text_slices(batches):
            got: tuple[list, list] = ([], [])
            for a, part, b, text in zip(*[batch.column(c).to_pylist() for c in ("a", "part", "b", "text")], strict=True):
                if (a, part) != key:
                    key, left = (a, part), []
                right = shingle_set(text, width)
                if b is None:
                    left.append(right)
                    continue
                for x in left:
                    both = len(np.intersect1d(x, right, assume_unique=True))
                    if both > 0 and 100 * both >= per_cent * (len(x) + len(right) - both):
                        got[0].append(a)
                        got[1].append(b)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in got], names=["a", "b"])

    return rows.mapInArrow(tidy(run, _words.clear), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text; other columns are ignored).

    Equal sets are one class, its smallest doc_id stands for it. Classes meet in bands of minima; each member of a band is
    tested against the band's smallest member, which links most of a large group with as many tests as it has members.
    Members of a band that are then still in different components are tested against each other, the packed signatures
    being compared inside the join, so a group whose members are linked never makes pairs. Of these a document whose
    shingles mostly stand in no other one of them can have no link and is left out, and so is a pair that is too unlike
    even if it shared all shingles that aren't alone. Links that the estimate leaves are confirmed on whole sets. With 80
    bands of 8 the bands miss a pair at 0.8 with probability 4e-7, the estimate with about 3e-6, for sets of any size.

    Null text: as an empty one. An empty set is linked with nothing and is its own component. A null doc_id: no links,
    component_id null, kept. Repeated rows: as one, each row gets the result. Rows that share a doc_id but differ in text
    are one document with both texts' links. Empty table: empty result.
    """
    per_cent = round(100 * threshold)
    sigs = materialize(signatures(docs, width), "signatures")
    usable = sigs.filter("doc_id is not null and n_shingles > 0")
    classes = usable.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("n_shingles", "sig", "bands"), "doc_id").alias("x"))
    classes = materialize(classes.select("digest", "rep", "x.*"), "classes")
    first, reps = classes.select("digest", "rep"), classes.drop("digest")

    bands = reps.select("rep", F.posexplode("bands").alias("at", "band"))
    shared = materialize(bands.groupBy("band").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).filter("lead < last").select("band", "lead"), "bands")
    members = materialize(bands.join(shared, "band").select("band", "at", "rep", "lead"), "members")

    fit = F.expr(f"100 * least(x.n_shingles, y.n_shingles) >= {per_cent} * greatest(x.n_shingles, y.n_shingles)")
    likely = fit & (similarity("x", "y") >= cut_below(threshold))
    a = reps.select(F.col("rep").alias("a"), F.struct("sig", "n_shingles").alias("x"))
    b = reps.select(F.col("rep").alias("b"), F.struct("sig", "n_shingles").alias("y"))
    to_lead = members.filter("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    links = materialize(confirmed(to_lead.join(a, "a").join(b, "b").filter(likely).select("a", "b").distinct(), docs, width, threshold), "confirmed")

    comps = connected_components(links)
    named = materialize(reps.select("rep").distinct().join(comps, F.col("rep") == comps.node, "left").select("rep", F.coalesce("component", "rep").alias("component")), "named")
    rows = materialize(members.select("band", "at", "rep").join(named, "rep"), "rows")
    rows = materialize(_mixed_bands(rows), "open")
    lone = lone_shingles(rows.select("rep").distinct(), docs, width)
    lone = lone.join(reps.groupBy("rep").agg(F.count("*").alias("n")).filter("n > 1"), "rep", "left_anti")  # two texts of one id: not judged
    facts = reps.join(rows.select("rep").distinct().hint("merge"), "rep", "left_semi").join(lone, "rep", "left").withColumn("common", F.col("n_shingles") - F.coalesce("lone", F.lit(0)))
    facts = materialize(facts.filter(f"100 * common >= {per_cent} * n_shingles").select("rep", F.struct("sig", "n_shingles", "common", "bands").alias("x")), "facts")
    rows = materialize(_mixed_bands(materialize(rows.join(facts.select("rep").distinct(), "rep", "left_semi"), "rows")), "open")
    open_rows = materialize(rows.join(facts, "rep"), "open")
    other = open_rows.select("band", F.col("rep").alias("other"), F.col("component").alias("other_component"), F.col("x").alias("y"))
    # a pair is made in the first band that both are in, not in each
    first_band = F.expr("array_position(zip_with(x.bands, y.bands, (p, q) -> p = q), true) = at + 1")
    enough = F.expr(f"100 * least(x.common, y.common) >= {per_cent} * (x.n_shingles + y.n_shingles - least(x.common, y.common))")
    across = open_rows.join(other, "band").filter((F.col("rep") < F.col("other")) & (F.col("component") != F.col("other_component")) & enough & likely & first_band)
    more = materialize(confirmed(across.select(F.col("rep").alias("a"), F.col("other").alias("b")).distinct(), docs, width, threshold), "confirmed")
    comps = connected_components(links.unionByName(more))

    named = materialize(first.join(comps, first.rep == comps.node, "left").select("digest", F.coalesce("component", "rep").alias("component_id")), "components")
    out = sigs.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _mixed_bands(rows: DataFrame) -> DataFrame:
    """The rows of bands whose members are in different components."""
    mixed = rows.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("band")
    return rows.join(mixed, "band", "left_semi")
