"""Document fingerprints: a digest of quartile codes of hashed byte triplets, compared with a bounded difference."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, partitions

BUCKETS = 256
#: Distances from a triplet's first byte to its second and third.
TRIPLETS = ((3, 7), (5, 11), (8, 13))
#: Texts of fewer bytes are read in a circle, so that each of their bytes begins triplets.
CIRCLE = 32
_MUL = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_LENGTH_STEP = 1.2
_SPARE = np.zeros((256, 256), np.uint8)
for _a in range(256):
    for _s in range(0, 8, 2):
        _d = np.abs((np.arange(256) >> _s & 3) - (_a >> _s & 3))
        _SPARE[_a] += np.where(_d == 3, 6, _d).astype(np.uint8)
WORST = 6 * BUCKETS


def bucket_counts(raw: bytes) -> np.ndarray:
    """How often each bucket is hit by the hashed byte triplets of ``raw``."""
    a = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if 0 < len(a) < CIRCLE:
        a = np.resize(a, len(a) + TRIPLETS[-1][1])
    counts = np.zeros(BUCKETS, np.int64)
    for k, (i, j) in enumerate(TRIPLETS):
        n = len(a) - j
        if n > 0:
            h = a[:n] * _MUL[0] + a[i : i + n] * _MUL[1] + a[j : j + n] * _MUL[2] + np.uint32(k)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            counts += np.bincount(h >> np.uint32(24), minlength=BUCKETS)
    return counts


def fingerprint(raw: bytes) -> str:
    """Hex: one byte for the length on a logarithmic scale, then two bits for each bucket, the quartile of its count."""
    counts = bucket_counts(raw)
    q = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    code = (counts[:, None] > q[None, :]).sum(axis=1).astype(np.uint8).reshape(-1, 4)
    size = min(255, round(np.log(len(raw) + 1) / np.log(_LENGTH_STEP)))
    return (bytes([size]) + (code << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8).tobytes()).hex()


def likeness(one: str, two: str) -> float:
    """1 for equal fingerprints, 0 at the largest difference: bucket codes differ by 0, 1, 2 or (opposite quartiles) 6 each,
    sizes by their distance beyond one step, at most 255."""
    a, b = (np.frombuffer(bytes.fromhex(x), np.uint8) for x in (one, two))
    size = max(0, abs(int(a[0]) - int(b[0])) - 1)
    return 1 - (int(_SPARE[a[1:], b[1:]].sum()) + size) / (WORST + 255)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars (code points), fingerprint of every row's UTF-8 text; null text as empty, repeated rows alike."""

    def run(batches):
        for b in batches:
            raw = b.column("text").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_chars"), pa.array([fingerprint(x) for x in raw], pa.string())], names=["doc_id", "n_chars", "fingerprint"])

    return documents(docs).withColumn("n_chars", F.length("text").cast("long")).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def with_next(docs: DataFrame, each, schema: str, columns: list[str]) -> DataFrame:
    """Apply ``each(doc_id, text, next_text)`` to every row and the one after it in ascending doc_id (then text); the last is followed by the first.

    Documents are dealt into ranges of doc_id; the first document of a range is also sent to the range before, so that
    every range can be read in order by itself. One shuffle of the texts; the driver sees one id for each range.
    """
    spark, docs = docs.sparkSession, documents(docs)
    n = partitions(spark)
    ids = docs.select("doc_id")
    bounds = sorted({int(x) for x in ids.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n)}) if n > 1 else []
    edges = np.array(bounds, np.int64)

    @F.pandas_udf(T.IntegerType())
    def number(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids.to_numpy(np.int64), side="right").astype(np.int32))

    placed = docs.withColumn("range", number(F.coalesce("doc_id", F.lit(-(2**63)))))
    order = F.struct(F.col("doc_id").isNotNull().alias("k"), "doc_id", F.xxhash64("text").alias("h"))
    heads = {r["range"]: r["head"] for r in placed.groupBy("range").agg(F.min(order).alias("head")).collect()}
    if not heads:
        return spark.createDataFrame([], schema)
    ranges = sorted(heads)
    to = {heads[r]: ranges[i - 1] for i, r in enumerate(ranges)}  # the first range's head goes to the last
    marks = spark.createDataFrame([(r, heads[r]["doc_id"], heads[r]["h"], to[heads[r]]) for r in ranges], "r int, head long, h long, before int")
    tails = placed.join(F.broadcast(marks), (F.col("range") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("head")) & (F.xxhash64("text") == F.col("h")))
    tails = tails.select("doc_id", "text", F.col("before").alias("range"), F.lit(True).alias("tail"))
    rows = placed.withColumn("tail", F.lit(False)).unionByName(tails)
    rows = rows.withColumn("_h", F.xxhash64("text")).repartition(n, "range").sortWithinPartitions("range", "tail", F.col("doc_id").asc_nulls_first(), "_h")

    def run(batches):
        held, done = None, None
        for b in batches:
            out = []
            for d, text, r, tail in zip(*[b.column(c).to_pylist() for c in ("doc_id", "text", "range", "tail")], strict=True):
                if tail and done == r:
                    continue  # the head's repeated rows
                if held is not None:
                    out.append(each(*held, text))
                held, done = (None, r) if tail else ((d, text), done)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=columns)

    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in T.StructType.fromDDL(schema)]
    return rows.select("doc_id", "text", "range", "tail").mapInArrow(run, schema)


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of an edited copy, whose last floor(n_chars / 2) code points are replaced by the
    first as many (or all) of the next document in doc_id order; likeness to the edited copy and to the next document.

    Null text: as empty. A null doc_id stands first; rows with one doc_id stand in the order of a hash of their texts. One
    row alone is its own next. Empty table: empty result.
    """

    def each(d, text, after):
        half = len(text) // 2
        edited = (text[: len(text) - half] + after[:half]).encode()
        own, changed, other = fingerprint(text.encode()), fingerprint(edited), fingerprint(after.encode())
        return d, len(text), hashlib.sha256(edited).hexdigest(), own, changed, likeness(own, changed), likeness(own, other)

    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return with_next(docs, each, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double", columns)
