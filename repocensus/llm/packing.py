"""Packing token sequences: best-fit decreasing over a histogram of lengths, then placement of every piece by its rank."""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions, text_slices, tidy
from .tokens import token_ids

class OpenWindows:
    """Open windows by remaining capacity: a segment tree over 0..size finds the tightest that holds a length.

    Windows that are filled alike are kept as intervals of window numbers.
    """

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = np.zeros(2 * self.leaves, np.int64)
        self.at: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, first: int, n: int) -> None:
        if n > 0 and capacity > 0:
            self.at[capacity].append((first, n))
            self._count(capacity, n)

    def _count(self, capacity: int, n: int) -> None:
        node = capacity + self.leaves
        while node:
            self.count[node] += n
            node //= 2

    def tightest(self, length: int) -> int | None:
        """The smallest capacity of at least ``length`` of which a window is open."""
        node = length + self.leaves
        if self.count[node]:
            return length
        while node > 1:
            if node % 2 == 0 and self.count[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None

    def take(self, capacity: int) -> tuple[int, int]:
        first, n = self.at[capacity].pop()
        self._count(capacity, -n)
        return first, n


def best_fit_plan(histogram: dict[int, int], size: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing for ``histogram`` (length to count) into windows of ``size``.

    Gives rows (length, rank, n, window, per, offset) and the number of windows: pieces of ``length`` with ranks from
    ``rank`` on, ``n`` of them, go ``per`` to a window, from ``window`` on, at ``offset`` and behind each other. A piece
    goes to the tightest open window, else to a new one. Pieces of one length are alike, so whole intervals of windows
    are filled at once; each interval's capacity at least halves when it is used, so the plan has at most about
    3 * size * log2(size) rows, whatever the counts.
    """
    open_windows, plan, windows = OpenWindows(size), [], 0
    for length in sorted((x for x, n in histogram.items() if n and x > 0), reverse=True):
        left, rank = histogram[length], 0
        while left:
            capacity = open_windows.tightest(length)
            if capacity is None:
                capacity = size
                n = -(-left // (size // length))
                first, windows = windows, windows + n
            else:
                first, n = open_windows.take(capacity)
            per = capacity // length
            used = min(n, -(-left // per))
            placed = min(left, used * per)
            plan.append((length, rank, placed, first, per, size - capacity))
            full = placed // per
            open_windows.add(capacity - per * length, first, full)
            if full < used:
                open_windows.add(capacity - (placed - full * per) * length, first + full, 1)
            open_windows.add(capacity, first + used, n - used)
            left, rank = left - placed, rank + placed
    return plan, windows


PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"


def cut_windows(size: int):
    """Batches of (doc_id, ids) to pieces: full windows of ``size`` first, then what is left. A piece's ids take 16 bits each where all of them fit, else 32."""

    def run(batches):
        for b in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for d, raw in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist(), strict=True):
                every = np.frombuffer(raw, "<u4")
                for at in range(0, len(every), size):
                    part = every[at : at + size]
                    for c, v in zip(rows, (d, at, len(part), len(every), part.astype("<u2" if part.max() < 2**16 else "<u4").tobytes()), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "start", "length", "doc_tokens", "ids"])

    return run


def widened(ids: pa.Array, length: np.ndarray) -> pa.Array:
    """Each piece's ids 32 bits wide, whichever width they were kept in."""
    return pa.array([raw if len(raw) == 4 * n else np.frombuffer(raw, "<u2").astype("<u4").tobytes() for raw, n in zip(ids.to_pylist(), length.tolist(), strict=True)], pa.binary())


def pack_pieces(pieces: DataFrame, size: int) -> DataFrame:
    """``pieces`` (doc_id, start, length, ids, ...) with sequence_id and offset, ids 32 bits wide: no window holds more than ``size``, offsets have no gaps.

    Only the histogram (at most ``size`` rows) comes to the driver. A piece's rank among those of its length is counted
    within salted groups, with the groups' counts summed before, so a length that a third of all pieces have is spread.
    """
    spark = pieces.sparkSession
    pieces = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start", "doc_tokens"), F.lit(partitions(spark))).cast("int"))
    counts = materialize(pieces.groupBy("length", "_salt").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan, _ = best_fit_plan(histogram, size)
    before = counts.withColumn("_base", F.sum("n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("n")).drop("n")
    rank = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "start", F.xxhash64("ids"))) - 1
    ranked = pieces.withColumn("_rank", rank.cast("long")).join(before, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_base")).drop("_base", "_salt")
    by = {k: np.array([x[1:] for x in v], np.int64) for k, v in groupby(plan, key=lambda x: x[0])}

    def place(batches):
        for b in text_slices(batches, 1024):
            length, r = (b.column(c).to_numpy() for c in ("length", "_rank"))
            where, offset = np.zeros(len(r), np.int64), np.zeros(len(r), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                rank, _, window, per, begin = by[int(n)][np.searchsorted(by[int(n)][:, 0], r[at], side="right") - 1].T
                where[at], offset[at] = window + (r[at] - rank) // per, begin + (r[at] - rank) % per * n
            names = [x for x in b.schema.names if x != "_rank"]
            yield pa.RecordBatch.from_arrays([*[widened(b.column(x), length) if x == "ids" else b.column(x) for x in names], pa.array(where), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {t}" for c, t in ranked.dtypes if c != "_rank") + ", sequence_id long, offset long"
    return ranked.mapInArrow(tidy(place), schema) if histogram else spark.createDataFrame([], schema)


def pack_documents(docs: DataFrame, path: str, end_id: int = 0, size: int = 1024, digest: bool = False) -> DataFrame:
    """Pack every row of ``docs`` (doc_id, text; other columns are ignored) into sequences of at most ``size`` ids.

    doc_id, start, length, doc_tokens, ids (little-endian unsigned 32-bit; with ``digest`` their crc32 is taken once they are
    packed, as ids_crc32 in their stead), sequence_id, offset of each piece. Null or empty text: the end id alone. A null doc_id is packed like any other. Repeated rows: packed as often as they come. Empty
    table: empty result. Pieces are written once before they are placed, so texts are encoded once.
    """
    out = pack_pieces(materialize(token_ids(docs, path, end_id, cut_windows(size), PIECES), "pieces"), size)
    return out.withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32") if digest else out
