"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, an error, but for Spark in one process, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/census-{uuid.uuid4().hex}"


def cut(df: DataFrame, merge: bool = True) -> DataFrame:
    """``df`` written once to the shared folder and read from there. Compressed files say little of the size of their rows, so what is read goes by sort and
    merge where it is joined, unless the other side asks for a broadcast; without ``merge`` the planner chooses."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    return out.hint("merge") if merge else out


#: Rows that a task takes of a table of a few bytes a row which grow to texts or many rows.
ROWS_A_TASK = 20_000


def spread(df: DataFrame, key: str, rows: int = ROWS_A_TASK) -> DataFrame:
    """``df`` dealt over tasks by ``key``, about ``rows`` to each, for what makes much of a few bytes: a file of a million short rows is one or two tasks otherwise.

    The planner guesses the size of what is made from the size of the file, so it goes by sort and merge where it is joined, as after ``cut``.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(tasks, key).hint("merge")
