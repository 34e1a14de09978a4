"""Near-duplicate files: exact Jaccard similarity on distinct token shingles, by prefix filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut

#: Fixed values.
WIDTH, LEAST, THRESHOLD = 5, 40, 0.5
#: Sets of either side that meet in a cell of pairs; sets that a task holds at a time.
BLOCK, SETS_A_TASK = 500, 2_000
TOKEN = r"[A-Za-z_$][\w$]*|[0-9]+|[^\s\w]"


def normalised(text):
    """Comments out, string literals alike, as columns."""
    plain = F.regexp_replace(text, r"(?s)/\*.*?\*/", " ")
    plain = F.regexp_replace(plain, r"(?m)(^|\s)//[^\n]*", " ")
    return F.regexp_replace(plain, "\"[^\"\\n]*\"|'[^'\\n]*'|`[^`]*`", '"s"')


def shingles(files: DataFrame, token: str = TOKEN, clean: bool = True) -> DataFrame:
    """(repo, path, id) with the sorted array ``s`` of its distinct shingle hashes, their number ``n`` and a hash of all, ``key``, for files of at least LEAST shingles.

    Tokens never leave their row. They are hashed inside a transform over an array of one element, so that they are found
    once, not for every use; the sets are written once for the steps that follow, which know a row by its ``id``.
    """
    text = normalised(F.col("content")) if clean else F.col("content")
    found = F.array(F.transform(F.regexp_extract_all(text, F.lit(token), F.lit(0)), lambda t: F.xxhash64(t)))
    starts = lambda t: F.when(F.size(t) >= WIDTH, F.sequence(F.lit(1), F.size(t) - WIDTH + 1)).otherwise(F.array().cast("array<int>"))
    sets = F.transform(found, lambda t: F.array_sort(F.array_distinct(F.transform(starts(t), lambda i: F.xxhash64(F.slice(t, i, WIDTH))))))
    out = files.filter("content is not null").select("repo", "path", F.explode(sets).alias("s"))
    out = out.withColumn("n", F.size("s")).filter(F.col("n") >= LEAST).withColumn("key", F.xxhash64("s"))
    return cut(out.withColumn("id", F.monotonically_increasing_id()), merge=False)


def shared_counts(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b, n, m) with ``shared``, the number of elements that the sets (id, s) of a and b share; a and b differ, no element stands twice in a set.

    Sets don't go with each pair: pairs that lead to the same smallest partner meet in cells of at most about BLOCK sets of either side,
    and a set goes to a cell once. A task takes cells of about SETS_A_TASK sets at a time, so a large family is many cells of many tasks.
    """
    led = pairs.join(pairs.groupBy("b").agg(F.min("a").alias("l")), "b")
    sizes = led.groupBy("l").agg(F.count_distinct("a").alias("na"), F.count_distinct("b").alias("nb"))
    part = lambda x, n: F.pmod(F.xxhash64(x), F.ceil(F.col(n) / BLOCK))
    cells = cut(led.join(sizes, "l").select("a", "b", "n", "m", F.xxhash64("l", part("a", "na"), part("b", "nb")).alias("cell")))
    needs = cut(cells.select("cell", F.col("a").alias("id")).unionByName(cells.select("cell", F.col("b").alias("id"))).distinct())
    group = F.pmod("cell", F.lit(-(-needs.count() // SETS_A_TASK) or 1)).alias("group")
    held = needs.select(group, "id").distinct().join(sets, "id").select("group", "id", "s")

    def count(own, held):
        import numpy as np
        import pyarrow as pa

        s = held.column("s").combine_chunks()
        s = pa.concat_arrays(s.chunks) if isinstance(s, pa.ChunkedArray) else s
        at, values = s.offsets.to_numpy(), s.values.to_numpy()
        of = {x: values[at[i] : at[i + 1]] for i, x in enumerate(held.column("id").to_pylist())}
        found = [np.intersect1d(of[a], of[b], assume_unique=True).size for a, b in zip(own.column("a").to_pylist(), own.column("b").to_pylist(), strict=True)]
        return pa.table([*[own.column(c) for c in ("a", "b", "n", "m")], pa.array(found, pa.int32())], names=["a", "b", "n", "m", "shared"])

    own = cells.select(group, "a", "b", "n", "m")
    return own.groupBy("group").cogroup(held.groupBy("group")).applyInArrow(count, "a long, b long, n int, m int, shared int")


def near_duplicates(files: DataFrame, threshold: float = THRESHOLD, token: str = TOKEN, clean: bool = True) -> DataFrame:
    """Pairs (a, b, jaccard, shared) of files whose shingle sets have at least ``threshold``; exact but for 64-bit hashes.

    Files with equal sets are one class; pairs are between class representatives (first path), with ``copies`` saying how
    many files each stands for. Shingles are ordered by how many classes have them, the rarest first; two sets can only
    reach the threshold if their prefixes meet, so only prefixes are joined, and only shingles that two classes have.
    All shingles are shuffled once, with the number of their class; those that one class alone has end there, and pairs are
    judged by the others, as no other can be shared, in cells (``shared_counts``). Sets stay where they were read, unless copies are too many to be broadcast.
    """
    sets = shingles(files, token, clean)
    first = F.min(F.struct("path", "id")).alias("x")
    classes = cut(sets.groupBy("repo", "key", "n").agg(first, F.count("*").alias("copies")).select("repo", "key", "n", "x.path", "x.id", "copies"))
    many = classes.filter("copies > 1").select("repo", "key", "n", F.col("id").alias("stands"))
    copies = cut(sets.select("repo", "key", "n", "id").join(many, ["repo", "key", "n"]).filter("id <> stands").select("id"), merge=False)
    each = sets.join(copies, "id", "left_anti").select("id", "repo", F.explode("s").alias("h")).select("id", F.xxhash64("repo", "h").alias("h"))
    common = each.withColumn("df", F.count("*").over(Window.partitionBy("h"))).filter("df > 1")
    common = common.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("o"))
    common = cut(common.join(classes, "id").select("id", "repo", "path", "copies", "n", "o"))
    keep = F.col("n") - F.ceil(threshold * F.col("n")).cast("int") + 1
    # shingles of one class alone come first in the order and can't meet: they only use up the prefix
    alone = F.col("n") - F.size("o")
    prefix = common.withColumn("k", F.least(keep - alone, F.size("o"))).filter("k > 0").select("id", "n", F.explode(F.slice("o", 1, F.col("k"))).alias("p"))
    prefix = cut(prefix.select("id", "n", F.col("p.h").alias("h")))
    other = prefix.select("h", F.col("id").alias("b"), F.col("n").alias("m"))
    fits = (F.col("id") < F.col("b")) & (F.col("n") >= threshold * F.col("m")) & (F.col("m") >= threshold * F.col("n"))
    pairs = cut(prefix.join(other, "h").filter(fits).select(F.col("id").alias("a"), "b", "n", "m").distinct())
    both = shared_counts(pairs, common.select("id", F.col("o.h").alias("s")))
    both = both.withColumn("jaccard", F.col("shared") / (F.col("n") + F.col("m") - F.col("shared"))).filter(F.col("jaccard") >= threshold)
    x = common.select("repo", F.col("id").alias("a"), F.struct("path", "copies").alias("x"))
    y = common.select(F.col("id").alias("b"), F.struct("path", "copies").alias("y"))
    both = both.join(x, "a").join(y, "b")
    one, two = F.least(F.struct("x.path", "x.copies"), F.struct("y.path", "y.copies")), F.greatest(F.struct("x.path", "x.copies"), F.struct("y.path", "y.copies"))
    return both.select("repo", one["path"].alias("a"), two["path"].alias("b"), F.round("jaccard", 4).alias("jaccard"), "shared", one["copies"].alias("copies_a"), two["copies"].alias("copies_b"))
