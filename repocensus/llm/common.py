"""What the operators of this subpackage share: the shared folder, materialised steps, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset and Spark runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: lineage is cut, lost executors lose nothing."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(docs: DataFrame, *cols: str) -> DataFrame:
    """Only the named columns, doc_id as long and text never null; other columns, whatever their names, are left out."""
    pick: dict[str, Column] = {"doc_id": F.col("doc_id").cast("long"), "text": F.coalesce(F.col("text"), F.lit(""))}
    return docs.select(*[pick.get(c, F.col(c)).alias(c) for c in cols or ("doc_id", "text")])


_left: dict[str, Callable[[], None]] = {}


def leave(name: str, forget: Callable[[], None]) -> None:
    """Note in this worker that a task left something for the next task of its kind, and how it is dropped."""
    _left[name] = forget


def drop_all_but(name: str | None) -> None:
    """Drop what tasks of other kinds left in this worker."""
    for other in [x for x in _left if x != name]:
        _left.pop(other)()


def tidy(run, forget=lambda: None, keep: str | None = None):
    """A task's function after which its worker, which outlives it, holds neither what ``forget`` drops nor free Arrow memory.

    With ``keep``, a name, that is dropped only when a task of another kind begins in the worker.
    """

    def wrapped(batches):
        import pyarrow as pa

        drop_all_but(keep)
        try:
            yield from run(batches)
        finally:
            if keep is None:
                forget()
            else:
                leave(keep, forget)
            pa.default_memory_pool().release_unused()

    return wrapped


def text_slices(batches, rows: int = 256, col: str = "text"):
    """Slices of Arrow batches, small enough that the Python objects made from them stay few."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def sized_slices(batches, size: int = 8 << 20, col: str = "text"):
    """Slices of Arrow batches that hold at most ``size`` bytes of ``col``, or one row."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        ends, at = np.cumsum(pc.binary_length(batch.column(col)).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
            yield batch.slice(at, to - at)
            at = to


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links to (node, component): component is the smallest node that can be reached.

    Each round every node takes its smallest neighbour as parent, parents are followed twice, and links are contracted to
    links between parents, so long chains shrink geometrically and a star is gone after one round. Nulls and self links are
    ignored; nodes without links don't appear. Both sides of every join are written tables, so a hub's rows can be split.
    """
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")
    e = materialize(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = None
    while not e.isEmpty():
        parent = materialize(e.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")), "parents")
        for _ in range(2):
            up = parent.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            parent = materialize(parent.join(up, "p", "left").select("a", F.coalesce("pp", "p").alias("p")), "parents")
        if labels is None:
            labels = parent.select(F.col("a").alias("node"), F.col("p").alias("component"))
        else:
            up = parent.select(F.col("a").alias("component"), "p")
            labels = materialize(labels.join(up, "component", "left").select("node", F.coalesce("p", "component").alias("component")), "labels")
        to = parent.select(F.col("a").alias("b"), F.col("p").alias("q"))
        e = materialize(e.join(parent, "a").join(to, "b").filter("p <> q").select(F.col("p").alias("a"), F.col("q").alias("b")).distinct(), "links")
    return labels if labels is not None else e.select(F.col("a").alias("node"), F.col("b").alias("component"))
