"""A corpus pipeline: documents pass the stages one after the other, each written as Parquet and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from repocensus.llm import decontaminate, minhash, packing, suffix, toxicity
from repocensus.llm.common import shared_dir
from repocensus.llm.queries import read, vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go.

    Null or empty text: judged as a text without hits, stays. Null ids, ties and repeated rows: each row by its text. Without
    labelled rows a fixed curve over the seed terms judges. Empty table: empty result. Columns, whatever their names, stay.
    """
    return toxicity.without_toxic(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) the document with the smallest id stays.

    Rows without an id and those without words stay: they are linked with nothing. Repeated rows of a document that stays all
    stay, for they are one document. Null text: as empty. Empty table: empty result. Columns stay.
    """
    judged = minhash.near_duplicates(docs, width=5, threshold=0.8)
    gone = judged.filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that a document with a smaller id has too are cut out of the texts; every row stays.

    A null id counts as the smallest; rows that share an id take nothing from each other. Null text becomes empty. n_chars
    follows the text, all other columns stay. Empty table: empty result.
    """
    return suffix.without_repeats(docs, 50)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go.

    Rows without an id and those without words stay. Of repeated rows all go or none. Without items all stay. Empty table:
    empty result. Columns stay.
    """
    return decontaminate.without_leaks(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of token sequences of at most 1024, piece by piece, with the window and place of each.

    Null or empty text: the end id alone. Rows without an id, ties and repeated rows are packed one by one. Empty table: empty
    result.
    """
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), end_id=0, size=1024)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("suffix_dedup", cut_repeats), ("decontamination", drop_leaks), ("packing", pack)]
#: Stages run models and byte-level searches that SQL doesn't express; the pipeline is tested against a brute-force version in tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = read(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
