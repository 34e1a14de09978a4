"""Whitening of embeddings: covariances from exact variances of dimensions and of their pair sums, then eigenvectors of the small matrix."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Whole numbers are floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: An entry must lie below this, for its whole number, and the difference of two, to be a long.
LARGEST = 2.0**61 / SCALE
_LIMB = 1 << 62


def whole_vectors(batch: pa.RecordBatch, col: str, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the rows that are kept, and their vectors as whole numbers, a row each."""
    lists = batch.column(col)
    lens = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.fill_null(lists.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(lens)), lens)
    bad = np.bincount(owner[~(np.abs(values) < LARGEST)], minlength=len(lens)) > 0
    kept = (lens == dims) & ~bad if dims else np.zeros(len(lens), bool)
    return np.flatnonzero(kept), np.floor(values[kept[owner]] * SCALE).astype(np.int64).reshape(-1, max(dims, 1)) + OFFSET


def exact_sum(values: np.ndarray) -> list[int]:
    """Column sums as Python integers, whatever their size."""
    room = int(np.abs(values).max(initial=0)) * max(len(values), 1) < _LIMB if values.dtype != object else False
    return [int(v) for v in (values if room else values.astype(object)).sum(axis=0)]


def squares_of_pair_sums(d: np.ndarray) -> list[int]:
    """Sums over the rows of (d_i + d_j)^2, for i <= j in rows of the upper triangle; i = j stands for d_i alone. Exact."""
    room = 4 * int(np.abs(d).max(initial=0)) ** 2 * max(len(d), 1) < _LIMB
    d = d if room else d.astype(object)
    out: list[int] = []
    for i in range(d.shape[1]):
        z = d[:, i:] + d[:, i : i + 1]
        z[:, 0] = d[:, i]
        out += [int(v) for v in (z * z).sum(axis=0)]
    return out


def _limbs(sums: list[int]) -> pa.RecordBatch:
    """(place, high, low) of whole numbers of up to 186 bits: high * 2^62 + low."""
    high, low = [Decimal(s >> 62) for s in sums], [s & (_LIMB - 1) for s in sums]
    return pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array(high, pa.decimal128(38, 0)), pa.array(low, pa.int64())], names=["place", "high", "low"])


def _total(rows: DataFrame, per_batch, size: int) -> list[int]:
    """Sums over all tasks of the lists of ``size`` whole numbers that ``per_batch`` makes of a batch; only those sums reach the driver."""

    def run(batches):
        own = [0] * size
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                own = [x + y for x, y in zip(own, per_batch(b.slice(at, 4096)), strict=True)]
        yield _limbs(own)

    parts = rows.mapInArrow(run, "place int, high decimal(38,0), low long")
    total = parts.groupBy("place").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")])
    got = {r["place"]: int(r["high"]) * _LIMB + int(r["low"]) for r in total.collect()}
    return [got.get(i, 0) for i in range(size)]


class Whitening:
    """What is fitted: n, per-dimension sums, the covariance, its eigenvalues falling, components as rows, their likeness to white."""

    def __init__(self, n: int, sums: list[int], covariance: np.ndarray, components: int):
        self.n, self.sums, self.dims = n, sums, len(sums)
        self.covariance = covariance
        values, vectors = np.linalg.eigh(covariance) if n else (np.zeros(0), np.zeros((self.dims, 0)))
        order = np.argsort(-values, kind="stable")
        usable = [int(i) for i in order if values[i] > len(values) * np.finfo(float).eps * values.max()]
        self.values, self.vectors = values[usable][:components], vectors[:, usable][:, :components]
        trace = float(np.trace(covariance))
        self.explained = self.values / trace if len(self.values) else self.values
        self.error = 0.0
        near = [round_div(s, n) if n else 0 for s in sums]
        self.near, self.rest = np.array(near, np.int64), np.array([(s - n * m) / n if n else 0.0 for s, m in zip(sums, near, strict=True)])

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """(x - S/n) on the components over sqrt(e); the whole part of the mean goes first, so nothing is rounded away."""
        return ((x - self.near).astype(float) - self.rest) @ (self.vectors / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sums over the dimensions of (n x - S)^2, exact; None where a sum passes 38 digits."""
        d = (x - self.near).astype(object)
        off = np.array([s - self.n * int(m) for s, m in zip(self.sums, self.near, strict=True)], object)
        top = max((abs(self.n * int(np.abs(x - self.near).max(initial=0))) + max((abs(int(o)) for o in off), default=0)) ** 2 * self.dims, 1)
        y = (self.n * (x - self.near) - off.astype(np.int64)) if top < _LIMB else self.n * d - off
        return [v if v < 10**38 else None for v in map(int, (y * y).sum(axis=1))]


def round_div(a: int, n: int) -> int:
    return (2 * a + n) // (2 * n)


def dimensions(rows: DataFrame, vec_col: str) -> int:
    """The commonest length of vectors that aren't null or empty, the larger of two as common; 0 where there are none."""
    size = F.size(vec_col)
    got = rows.filter(size > 0).groupBy(size.alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    return got[0]["dims"] if got else 0


def fit(rows: DataFrame, vec_col: str = "embedding", components: int = 32) -> Whitening:
    """Fit on every vector that is kept: sums, then squares of values centred on the whole number next to the mean, for each
    dimension and each sum of two, all as exact integers; what is left of the mean (at most a half) is taken off exactly on the
    driver: n^2 var(z) = n sum(z^2) - sum(z)^2. Differences of those variances are the covariances:
    2 cov(i, j) = var(i + j) - var(i) - var(j).

    A task sends dims * (dims + 1) / 2 sums, and as many reach the driver, however many rows there are.
    Left out are null and empty vectors, those with null, non-finite or huge (3e16 and beyond) entries, and those whose length isn't the commonest.
    Repeated rows count each time. Components without variance can't be whitened and are left out. Nothing kept: no components.
    """
    dims = dimensions(rows, vec_col)
    rows = rows.select(F.col(vec_col).alias("v"))
    if not dims:
        return Whitening(0, [], np.zeros((0, 0)), components)
    n, *sums = _total(rows, lambda b: (lambda x: [len(x), *exact_sum(x)])(whole_vectors(b, "v", dims)[1]), 1 + dims)
    if not n:
        return Whitening(0, [0] * dims, np.zeros((dims, dims)), components)
    near = np.array([round_div(s, n) for s in sums], np.int64)
    pairs = _total(rows, lambda b: squares_of_pair_sums(whole_vectors(b, "v", dims)[1] - near), dims * (dims + 1) // 2)
    off = [s - n * int(m) for s, m in zip(sums, near, strict=True)]
    upper = iter(pairs)
    spread = [[0] * dims for _ in range(dims)]  # n^2 times the variance of i + j, of i alone for i = j
    for i in range(dims):
        for j in range(i, dims):
            spread[i][j] = n * next(upper) - (off[i] + off[j] if j > i else off[i]) ** 2
    cov = np.zeros((dims, dims))
    for i in range(dims):
        cov[i, i] = spread[i][i] / n**2
        for j in range(i + 1, dims):
            cov[i, j] = cov[j, i] = (spread[i][j] - spread[i][i] - spread[j][j]) / (2 * n**2)
    model = Whitening(n, sums, cov, components)
    model.error = identity_error(rows, model)
    return model


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the covariance of all whitened vectors minus the identity, measured on them."""
    k = len(model.values)

    def run(batches):
        first, second, n = np.zeros(k), np.zeros((k, k)), 0
        for b in batches:
            z = model.whiten(whole_vectors(b, "v", model.dims)[1])
            first, second, n = first + z.sum(axis=0), second + z.T @ z, n + len(z)
        yield pa.RecordBatch.from_arrays([pa.array(range(k + k * k), pa.int32()), pa.array(np.concatenate([first, second.ravel()]))], names=["place", "total"])

    if not k:
        return 0.0
    got = {r["place"]: r["total"] for r in rows.mapInArrow(run, "place int, total double").groupBy("place").agg(F.sum("total").alias("total")).collect()}
    flat = np.array([got.get(i, 0.0) for i in range(k + k * k)]) / model.n
    return float(np.abs(flat[k:].reshape(k, k) - np.outer(flat[:k], flat[:k]) - np.eye(k)).max())


def whitened(rows: DataFrame, model: Whitening, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id (as it is), deviation decimal(38,0), whitened array<double>, a row for each vector that is kept (see ``fit``).

    A null id and repeated rows stay as they are; a deviation of over 38 digits is null. No shuffle. Other columns, whatever
    their names, are left out. Empty table, or nothing kept: empty result.
    """
    kind = dict(rows.dtypes)[id_col]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                b = batch.slice(at, 4096)
                kept, x = whole_vectors(b, "v", model.dims)
                if len(kept):
                    z = model.whiten(x)
                    deviation = [None if d is None else Decimal(d) for d in model.deviation(x)]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), pa.array(z.ravel()))
                    yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(kept)), pa.array(deviation, pa.decimal128(38, 0)), lists], names=[id_col, "deviation", "whitened"])

    return rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).mapInArrow(run, f"`{id_col}` {kind}, deviation decimal(38,0), whitened array<double>")
