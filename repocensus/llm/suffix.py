"""Suffix-array dedup: spans that repeat from a document with a smaller id, found by two-stage suffix sorting.

Equal strings of ``length`` bytes must meet before they can be sorted. Each window of that length is named after the
smallest hash among its ``K``-byte substrings, so equal windows bear equal names wherever they stand, and neighbouring
windows mostly share one. Only names that stand in two documents or more are followed up: their stretches of text are
sent to the bucket of the name, where suffixes are sorted and adjacent common prefixes computed. A name that very many
different stretches bear (of a phrase too short to be cut, in ever other surroundings) is taken apart: each of its windows
is sent by itself to a bucket of its own content.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, partitions

K = 20
BITS = 20  # of a code, for its bucket; the rest for the name
LOW = np.uint64(2 ** (64 - BITS) - 1)
NO_ID = -(2**63)
CHUNK = 4 << 20
#: Bytes of text in a block, about; a block is one task's.
BLOCK = 48 << 20
#: A name with more different stretches than these, added up over the blocks, is taken apart into windows.
HOT = 4096
_BYTE = np.random.default_rng(11).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C15


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Start positions of all suffixes of a byte array, ordered by their first ``depth`` bytes at least.

    Two-stage sorting: suffixes smaller than their successor are sorted directly, eight bytes at a time and only as far as
    ties remain; the others are induced by a scan over the buckets of first bytes, each taking its place when its successor
    is passed. Suffixes equal over ``depth`` bytes stand in no particular order.
    """
    n = len(text)
    if n == 0:
        return np.empty(0, np.int64)
    step = np.sign(text[1:].astype(np.int16) - text[:-1].astype(np.int16))
    where = np.where(step != 0, np.arange(n - 1), n - 1)
    where = np.minimum.accumulate(where[::-1])[::-1]
    small = np.zeros(n, bool)  # the last suffix is larger than the empty one
    small[: n - 1] = np.append(step, -1)[where] > 0
    direct = _sorted_directly(text, np.flatnonzero(small), depth)
    counts = np.bincount(text[direct], minlength=256)
    ends = np.cumsum(counts)
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        bucket = list(waiting[c])
        last = np.concatenate(bucket) if bucket else np.empty(0, np.int64)
        while len(last):  # runs of one byte: induced from within the bucket
            before = last[last > 0] - 1
            last = before[text[before] == c]
            bucket.append(last)
        bucket.append(direct[ends[c] - counts[c] : ends[c]])
        bucket = np.concatenate(bucket)
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        byte = text[before]
        before, byte = before[byte > c], byte[byte > c]
        by = np.argsort(byte, kind="stable")
        before, byte = before[by], byte[by]
        at = np.flatnonzero(np.diff(byte)) + 1
        for part in np.split(before, at):
            if len(part):
                waiting[text[part[0]]].append(part)
    return np.concatenate(out)


def _sorted_directly(text: np.ndarray, idx: np.ndarray, depth: int) -> np.ndarray:
    padded = np.concatenate([text, np.zeros(depth + 16, np.uint8)])
    words = padded[:-7].astype(np.uint64)
    for i in range(1, 8):
        words = (words << np.uint64(8)) | padded[i : len(padded) - 7 + i]
    idx = idx[np.argsort(words[idx], kind="stable")]
    key = words[idx]
    group = np.cumsum(np.append(0, key[1:] != key[:-1])) if len(idx) else idx
    for at in range(8, depth, 8):
        size = np.bincount(group) if len(group) else np.empty(0, int)
        tied = np.flatnonzero(size[group] > 1) if len(group) else group
        if not len(tied):
            break
        key, of = words[idx[tied] + at], group[tied]
        by = np.lexsort((key, of))
        idx[tied], key, of = idx[tied][by], key[by], of[by]
        new = np.append(True, (key[1:] != key[:-1]) | (of[1:] != of[:-1]))
        group = _regrouped(len(idx), tied, new)
    return idx


def _regrouped(n: int, tied: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Group numbers where every element begins a group but those of ``tied`` that aren't ``new``."""
    begins = np.ones(n, np.int64)
    begins[tied] = new
    return np.cumsum(begins) - 1


def shared_runs(text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the suffixes at ``starts``: their order, and for each in that order whether its common prefix with the one before reaches ``length``."""
    order = suffix_order(text, length)
    valid = np.zeros(len(text), bool)
    valid[starts] = True
    order = order[valid[order]]
    reaches = np.zeros(len(order), bool)
    windows = np.lib.stride_tricks.sliding_window_view(text, length)
    for at in range(1, len(order), 65536):
        now = order[at : at + 65536]
        reaches[at : at + len(now)] = (windows[now] == windows[order[at - 1 : at - 1 + len(now)]]).all(axis=1)
    return order, reaches


def _names(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows of ``length`` bytes: where stretches with one name begin, and the names."""
    p = data.astype(np.uint64)
    p = p[:-1] | (p[1:] << np.uint64(8))
    p = p[:-2] | (p[2:] << np.uint64(16))
    four = p
    eight = p[:-4] | (p[4:] << np.uint64(32))
    n = len(data) - K + 1
    h = eight[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= (eight[8 : 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (four[16 : 16 + n] * np.uint64(0x165667B19E3779F9))
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    width, have = length - K + 1, 1
    while 2 * have <= width:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    if have < width:
        h = np.minimum(h[: len(h) - (width - have)], h[width - have :])
    begins = np.append(0, np.flatnonzero(h[1:] != h[:-1]) + 1)
    name = h[begins] * np.uint64(0x9E3779B97F4A7C15)  # smallest hashes are small: mixed again, to be dealt out evenly
    name = (name ^ (name >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return begins, name ^ (name >> np.uint64(32))


def _codes(names: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket in the upper BITS bits, the low bits of the name below. Names that agree by chance only cost work."""
    return (((names >> np.uint64(64 - BITS)) * np.uint64(buckets) >> np.uint64(BITS)) << np.uint64(64 - BITS)) | (names & LOW)


def _bucket_edges(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted codes: their buckets, and where each bucket begins and the last one ends."""
    bucket = (codes >> np.uint64(64 - BITS)).astype(np.int64)
    return bucket, np.append(np.append(0, np.flatnonzero(np.diff(bucket)) + 1), len(bucket)) if len(bucket) else np.zeros(1, int)


def _pack(*columns) -> bytes:
    """Arrays or bytes as one compressed value; what is sent between stages is text that is stored nowhere else."""
    import zstandard

    raw = [x if isinstance(x, bytes) else x.tobytes() for x in columns]
    return zstandard.compress(np.array([len(x) for x in raw], "<i8").tobytes() + b"".join(raw), 1)


def _unpack(blob: bytes, n: int) -> list[bytes]:
    import zstandard

    raw = zstandard.decompress(blob)
    ends = (np.cumsum(np.frombuffer(raw[: 8 * n], "<i8")) + 8 * n).tolist()
    return [raw[a:b] for a, b in zip([8 * n, *ends[:-1]], ends, strict=True)]


def _low_bytes(codes: np.ndarray) -> bytes:
    return codes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_low(raw: bytes, bucket: int) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1) | np.uint64(bucket << (64 - BITS))


def _contents(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A hash of the bytes from each ``lo`` to ``hi``, wherever they stand: differences of one running sum."""
    n = len(data)
    power = np.cumprod(np.full(n, _STEP, np.uint64))
    total = np.append(np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * power))
    back = np.append(np.ones(1, np.uint64), np.cumprod(np.full(n, pow(_STEP, -1, 2**64), np.uint64)))
    return (total[hi] - total[lo]) * back[lo]


def _places(wanted: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which ``codes`` stand in the sorted ``wanted``, and where."""
    at = np.minimum(np.searchsorted(wanted, codes), len(wanted) - 1)
    hit = np.flatnonzero(wanted[at] == codes)
    return hit, at[hit]


def _ids(table: pa.Table) -> list[int]:
    return [NO_ID if x is None else x for x in table.column("doc_id").to_pylist()]


def _stretches(raw: bytes, buckets: int, length: int):
    """starts, ends (of windows, one past the last) and codes of a text; None if it is too short."""
    if len(raw) < length:
        return None
    begins, names = _names(np.frombuffer(raw, np.uint8), length)
    return begins, np.append(begins[1:], len(raw) - length + 1), _codes(names, buckets)


def repeated_spans(docs: DataFrame, length: int = 50, keep_text: bool = True, carry: tuple[str, ...] = (), hot: int = HOT) -> DataFrame:
    """For every row of ``docs`` (doc_id, text): doc_id, n_bytes, spans array<struct<start,end>> to be removed (bytes of the
    UTF-8 text, sorted, apart), kept_sha256 of what remains, with ``keep_text`` the remaining text (a character that is cut
    apart is left out of it), and the columns named in ``carry``, in a struct of that name.

    A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller doc_id; strings are
    judged on the input. Null text: as empty. A null doc_id counts as smaller than any other. Rows with equal doc_ids take
    nothing from each other; repeated rows get equal results. Texts below ``length`` bytes have no spans. Empty table:
    empty result. ``length`` must be at least 2 * K.

    Documents are dealt into blocks by a hash of their id, as many as their bytes ask for; a hot string is one row for each block, not for each document. Names with more than
    ``hot`` different stretches are taken apart; results don't depend on it.
    """
    if length < 2 * K:
        raise ValueError(f"length must be at least {2 * K}")
    spark = docs.sparkSession
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(2 * partitions(spark), -(-size // BLOCK))
    n_buckets = min(2**BITS, n_blocks)
    blocks = docs.select("doc_id", "text", F.struct(*carry).alias("carry") if carry else F.lit(None).cast("int").alias("carry"))
    blocks = documents(blocks, "doc_id", "text", "carry").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(n_blocks)).cast("int"))

    def name_lists(key, table):
        """The names of a block, by bucket: those of one document, those of several; and how many different stretches bear each."""
        got, of, contents = [], [], []
        for d, raw in zip(table.column("doc_id").to_pylist(), table.column("text").cast(pa.binary()).to_pylist(), strict=True):
            if (s := _stretches(raw, n_buckets, length)) is not None:
                got.append(s[2])
                of.append(np.full(len(s[2]), NO_ID if d is None else d, np.int64))
                contents.append(_contents(np.frombuffer(raw, np.uint8), s[0], s[1] + length - 1))
        rows: list[tuple] = []
        if got:
            codes, of, contents = map(np.concatenate, (got, of, contents))
            by = np.lexsort((contents, codes))
            codes, of, contents = codes[by], of[by], contents[by]
            first = np.append(True, codes[1:] != codes[:-1])
            at = np.flatnonzero(first)
            new = first | np.append(True, contents[1:] != contents[:-1])
            counts = np.minimum(np.add.reduceat(new, at, dtype=np.int64), 2**16 - 1).astype("<u2")
            several = np.minimum.reduceat(of, at) != np.maximum.reduceat(of, at)
            codes = codes[at]
            bucket, edges = _bucket_edges(codes)
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                here, many, n = codes[lo:hi], several[lo:hi], counts[lo:hi]
                rows.append((int(bucket[lo]), key[0].as_py(), _low_bytes(here[~many]), _low_bytes(here[many]), n[~many].tobytes() + n[many].tobytes()))
        return pa.table(list(map(list, zip(*rows, strict=True))) or [[]] * 5, schema=pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("once", pa.binary()), ("many", pa.binary()), ("counts", pa.binary())]))

    def found_twice(key, table):
        bucket = key[0].as_py()
        codes, block, many, counts = [], [], [], []
        for b, once, several, n in zip(*[table.column(c).to_pylist() for c in ("block", "once", "many", "counts")], strict=True):
            counts.append(np.frombuffer(n, "<u2"))
            for raw, flag in ((once, False), (several, True)):
                codes.append(_from_low(raw, bucket))
                block.append(np.full(len(codes[-1]), b, np.int32))
                many.append(np.full(len(codes[-1]), flag))
        codes, block, many, counts = map(np.concatenate, (codes, block, many, counts))
        by = np.argsort(codes, kind="stable")
        codes, block, many, counts = codes[by], block[by], many[by], counts[by]
        begins = np.append(True, codes[1:] != codes[:-1])
        at = np.flatnonzero(begins)
        shared = (np.add.reduceat(many, at) > 0) | (np.diff(np.append(at, len(codes))) > 1)
        varied = np.add.reduceat(counts, at, dtype=np.int64) > hot
        of = np.cumsum(begins) - 1
        keep = shared[of]
        codes, block, varied = codes[keep], block[keep], varied[of[keep]]
        by = np.argsort(block, kind="stable")
        codes, block, varied = codes[by], block[by], varied[by]
        edges = np.append(np.append(0, np.flatnonzero(np.diff(block)) + 1), len(block)) if len(block) else [0]
        rows = [(int(block[lo]), bucket, _low_bytes(codes[lo:hi]), np.packbits(varied[lo:hi]).tobytes()) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
        return pa.table(list(map(list, zip(*rows, strict=True))) or [[]] * 4, schema=pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("names", pa.binary()), ("varied", pa.binary())]))

    def stretches_of(key, table, names):
        """The distinct stretches of a block whose name is found twice, with the smallest and largest document they stand in;
        of names that are taken apart, the distinct windows, each with a code of its own beside the name's."""
        wanted, varied = [], []
        for b, raw, bits in zip(*[names.column(c).to_pylist() for c in ("bucket", "names", "varied")], strict=True):
            wanted.append(_from_low(raw, b))
            varied.append(np.unpackbits(np.frombuffer(bits, np.uint8), count=len(wanted[-1])))
        wanted, varied = (np.concatenate(wanted), np.concatenate(varied)) if wanted else (np.empty(0, np.uint64), np.empty(0, np.uint8))
        by = np.argsort(wanted, kind="stable")
        wanted, varied = wanted[by], varied[by]
        seen: dict[bytes, list[int]] = {}
        windows: dict[tuple[int, bytes], list[int]] = {}
        for d, raw in zip(_ids(table), table.column("text").cast(pa.binary()).to_pylist(), strict=True):
            if not len(wanted) or (s := _stretches(raw, n_buckets, length)) is None:
                continue
            begins, ends, codes = s
            hit, at = _places(wanted, codes)
            for lo, hi, code, apart in zip(begins[hit].tolist(), (ends[hit] + length - 1).tolist(), codes[hit].view(np.int64).tolist(), varied[at].tolist(), strict=True):
                to, keys = (windows, [(code, raw[i : i + length]) for i in range(lo, hi - length + 1)]) if apart else (seen, (raw[lo:hi],))
                for k in keys:
                    x = to.get(k)
                    if x is None:
                        to[k] = [code, d, d]
                    elif d < x[1]:
                        x[1] = d
                    elif d > x[2]:
                        x[2] = d
        pieces = [*seen, *(x for _, x in windows)]
        found = [*seen.values(), *windows.values()]
        name, low, high = (np.fromiter((x[i] for x in found), np.int64, len(found)) for i in range(3))
        name = name.view(np.uint64)
        own = np.fromiter((xxhash.xxh3_64_intdigest(x) for _, x in windows), np.uint64, len(windows))
        code = np.append(name[: len(seen)], _codes(own, n_buckets))
        apart = np.arange(len(code)) >= len(seen)
        by = np.argsort(code, kind="stable")
        code, name, low, high, apart = code[by], name[by], low[by], high[by], apart[by]
        pieces = [pieces[i] for i in by.tolist()]
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        bucket, edges = _bucket_edges(code)
        rows = [(int(bucket[lo]), key[0].as_py(), _pack(code[lo:hi], name[lo:hi], apart[lo:hi], size[lo:hi], low[lo:hi], high[lo:hi], b"".join(pieces[lo:hi]))) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
        return pa.table(list(map(list, zip(*rows, strict=True))) or [[]] * 3, schema=pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("pieces", pa.binary())]))

    def sort_suffixes(table):
        """Where a window of a stretch also stands in a smaller document: the smallest one, for each window."""
        codes, names_of, aparts, lows, highs, blocks_of, pieces = [], [], [], [], [], [], []
        for block, blob in zip(table.column("block").to_pylist(), table.column("pieces"), strict=True):
            c, k, w, n, a, b, text = _unpack(blob.as_py(), 7)
            ends = np.cumsum(np.frombuffer(n, "<i8")).tolist()
            pieces += [text[x:y] for x, y in zip([0, *ends[:-1]], ends, strict=True)]
            for to, x in ((codes, np.frombuffer(c, "<u8")), (names_of, np.frombuffer(k, "<u8")), (aparts, np.frombuffer(w, bool)), (lows, np.frombuffer(a, "<i8")), (highs, np.frombuffer(b, "<i8")), (blocks_of, np.full(len(ends), block))):
                to.append(x)
        code, name, apart, low, high, block = map(np.concatenate, (codes, names_of, aparts, lows, highs, blocks_of))
        by = np.argsort(code, kind="stable")
        code, name, apart, low, high, block = code[by], name[by], apart[by], low[by], high[by], block[by]
        pieces = [pieces[i] for i in by.tolist()]
        size = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        got: list[tuple[int, int, bytes]] = []  # place in ``pieces``, window count if they differ (else 0), smallest documents
        lo = 0
        while lo < len(pieces):  # bounded texts; a name is never cut apart
            hi = int(np.searchsorted(size, (size[lo - 1] if lo else 0) + CHUNK, side="right"))
            hi = int(np.searchsorted(code, code[max(hi, lo + 1) - 1], side="right"))
            own: dict[bytes, int] = {}
            number = np.fromiter((own.setdefault(x, len(own)) for x in pieces[lo:hi]), np.int64, hi - lo)
            least = np.full(len(own), 2**63 - 1, np.int64)
            np.minimum.at(least, number, low[lo:hi])
            text = np.frombuffer(b"".join(own), np.uint8)
            lengths = np.fromiter(map(len, own), np.int64, len(own))
            at = np.cumsum(lengths) - lengths
            n_windows = lengths - length + 1
            of = np.repeat(np.arange(len(own)), n_windows)
            first = np.cumsum(n_windows) - n_windows
            starts = np.arange(len(of)) - first[of] + at[of]
            order, reaches = shared_runs(text, starts, length)
            window = np.empty(len(text), np.int64)
            window[starts] = np.arange(len(starts))
            ranked = window[order]
            begins = np.flatnonzero(~reaches)
            smallest = np.minimum.reduceat(least[of[ranked]], begins)
            best = np.empty(len(starts), np.int64)
            best[ranked] = np.repeat(smallest, np.diff(np.append(begins, len(order))))
            lowest, highest = np.minimum.reduceat(best, first), np.maximum.reduceat(best, first)
            for i in (np.flatnonzero(lowest[number] < high[lo:hi])).tolist():
                k = number[i]
                alike = lowest[k] == highest[k]
                got.append((lo + i, 0 if alike else int(n_windows[k]), best[first[k] : first[k] + (1 if alike else n_windows[k])].tobytes()))
            lo = hi
        where = np.array([x[0] for x in got], np.int64)
        by = np.argsort(block[where], kind="stable")
        here = block[where][by]
        edges = np.append(np.append(0, np.flatnonzero(np.diff(here)) + 1), len(here)) if len(here) else [0]
        rows = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            some = [got[i] for i in by[a:b].tolist()]
            at = [x[0] for x in some]
            rows.append((int(here[a]), _pack(name[at], apart[at], b"".join(xxhash.xxh3_64_digest(pieces[i]) for i in at), np.array([x[1] for x in some], "<i8"), b"".join(x[2] for x in some))))
        return pa.table(list(map(list, zip(*rows, strict=True))) or [[]] * 2, schema=pa.schema([("block", pa.int32()), ("best", pa.binary())]))

    def cut(table, found):
        best: dict[tuple[int, bytes], int | np.ndarray] = {}
        wanted, taken_apart = [], set()
        for blob in found.column("best"):
            c, w, digests, n, values = _unpack(blob.as_py(), 5)
            code, n, values = np.frombuffer(c, "<u8"), np.frombuffer(n, "<i8"), np.frombuffer(values, "<i8")
            wanted.append(code)
            taken_apart.update(code[np.frombuffer(w, bool)].tolist())
            ends = np.cumsum(np.maximum(n, 1)).tolist()
            for i, (k, many, end) in enumerate(zip(code.tolist(), n.tolist(), ends, strict=True)):
                best[k, digests[8 * i : 8 * i + 8]] = values[end - many : end] if many else int(values[end - 1])
        wanted = np.unique(np.concatenate(wanted)) if wanted else np.empty(0, np.uint64)
        rows = []
        for d, raw in zip(table.column("doc_id").to_pylist(), table.column("text").cast(pa.binary()).to_pylist(), strict=True):
            me, mask = NO_ID if d is None else d, np.zeros(len(raw), bool)
            if len(wanted) and (s := _stretches(raw, n_buckets, length)) is not None:
                begins, ends, codes = s
                hit, _ = _places(wanted, codes)
                for lo, hi, code in zip(begins[hit].tolist(), ends[hit].tolist(), codes[hit].tolist(), strict=True):
                    if code in taken_apart:
                        for i in range(lo, hi):
                            x = best.get((code, xxhash.xxh3_64_digest(raw[i : i + length])))
                            if x is not None and x < me:
                                mask[i : i + length] = True
                        continue
                    x = best.get((code, xxhash.xxh3_64_digest(raw[lo : hi + length - 1])))
                    if isinstance(x, int):
                        if x < me:
                            mask[lo : hi + length - 1] = True
                    elif x is not None:
                        for i in np.flatnonzero(x < me).tolist():
                            mask[lo + i : lo + i + length] = True
            edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
            spans = list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
            rest = np.frombuffer(raw, np.uint8)[~mask].tobytes() if spans else raw
            rows.append((d, len(raw), [{"start": a, "end": b} for a, b in spans], hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore") if keep_text else None))
        span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
        out = pa.table(list(map(list, zip(*rows, strict=True))) or [[]] * 5, schema=pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(span)), ("kept_sha256", pa.string()), ("kept_text", pa.string())]))
        return out.append_column("carry", table.column("carry"))

    lists = blocks.groupBy("block").applyInArrow(name_lists, "bucket int, block int, once binary, many binary, counts binary")
    names = lists.groupBy("bucket").applyInArrow(found_twice, "block int, bucket int, names binary, varied binary")
    pieces = blocks.groupBy("block").cogroup(names.groupBy("block")).applyInArrow(stretches_of, "bucket int, block int, pieces binary")
    found = pieces.groupBy("bucket").applyInArrow(sort_suffixes, "block int, best binary")
    return blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(cut, T.StructType.fromDDL("doc_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept_sha256 string, kept_text string").add("carry", blocks.schema["carry"].dataType))


def without_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """The rows of ``docs`` with repeated spans cut out of their texts; all other columns stay (n_chars, where there is one, follows the text)."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    cut = repeated_spans(docs, length, carry=others)
    follows = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return cut.select(*[follows.get(c, F.col("carry").getField(c)).alias(c) for c in docs.columns])
