"""Queries that run streams of several batches: what comes too late, and debt that is carried from scan to scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lineage import cut, shared_folder
from ..streaming import streams
from .census import table

Q: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def arrivals(spark, rows, batches, key=None):
    """A stream that reads ``rows`` in the order of the column batch: a folder for each, written one after the other. Without a key all of a batch are in one file, which
    is a batch of the stream; with a key they are in a file a core at most, the rows of one key in one, and a batch of the stream is as many files."""
    folder, files = shared_folder(spark), spark.sparkContext.defaultParallelism if key else 1
    for b in batches:
        own = rows.filter(F.col("batch") == b).drop("batch")
        (own.repartition(files, key) if key else own.coalesce(1)).write.mode("append").option("parquet.block.size", 16 << 20).parquet(f"{folder}/in")  # so large files are read by many tasks
    return spark.readStream.schema(rows.drop("batch").schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")


def finished(stream):
    """All that the stream writes until its input ends, in append mode."""
    folder = shared_folder(stream.sparkSession)
    stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).format("parquet").option("path", f"{folder}/rows").start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


#: Batch of an event: eight days make one; of each ten one comes a batch later, of each twenty one two.
BATCH = "CAST(least(3, (day(ts) - 1) // 8 + CASE WHEN event_id % 20 = 0 THEN 2 WHEN event_id % 20 = 10 THEN 1 ELSE 0 END) AS INTEGER)"
#: A batch's rows are held against the watermark that the batch before it began with.
LATE_SQL = f"""e AS (SELECT *, {BATCH} AS batch FROM events), top AS (SELECT batch, max(ts) AS ts FROM e GROUP BY batch),
mark AS (SELECT b.batch, (SELECT max(ts) FROM top t WHERE t.batch <= b.batch - 2) - INTERVAL 2 DAY AS late, (SELECT max(ts) FROM top) - INTERVAL 2 DAY AS closed FROM top b)"""


def batched_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    late = F.when(F.col("event_id") % 20 == 0, 2).when(F.col("event_id") % 20 == 10, 1).otherwise(0)
    return e.withColumn("batch", F.least(F.lit(3), F.floor((F.dayofmonth("ts") - 1) / 8) + late).cast("int"))


@query(f"""WITH {LATE_SQL}, r AS (SELECT date_trunc('day', ts) AS w, CAST(user_id % 6 AS VARCHAR) AS ledger, event_type, closed, date_trunc('day', ts) + INTERVAL 1 DAY <= late AS dropped FROM e JOIN mark USING (batch)),
c AS (SELECT w, ledger, count(*) AS every, count(*) FILTER (NOT coalesce(dropped, false)) AS n, count(*) FILTER (NOT coalesce(dropped, false) AND event_type <> 'error') AS handled, bool_or(w + INTERVAL 1 DAY <= closed) AS done FROM r GROUP BY ALL)
SELECT strftime(w, '%Y-%m-%d') AS window_start, ledger, CASE WHEN done AND n > 0 THEN n ELSE 0 END AS counted, CASE WHEN done AND n > 0 THEN every - n ELSE 0 END AS late, done AND n > 0 AS closed, CASE WHEN done AND n > 0 THEN handled END AS handled FROM c""")
def late_runs(spark, sf_dir):
    """Ledger windows in append mode over four batches, beside the rows of each that came behind the watermark."""
    e = F.col("event_type")

    def runs(rows):
        return rows.select((F.col("user_id") % 6).cast("string").alias("ledger"), "ts", F.when(e != "error", 1).otherwise(0).alias("handled"), F.when(e == "error", 1).otherwise(0).alias("escalated"), F.lit(0).alias("wrong"))

    rows = batched_events(spark, sf_dir)
    kept = finished(streams.ledger_windows(runs(arrivals(spark, rows, range(4))))).withColumn("n", F.col("handled") + F.col("escalated"))
    every = runs(rows).groupBy(F.date_trunc("day", "ts").alias("window_start"), "ledger").agg(F.count("*").alias("n"))
    out = streams.late_against(every, kept, ["window_start", "ledger"]).join(kept.select("window_start", "ledger", "handled"), ["window_start", "ledger"], "left")
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


@query(f"""WITH {LATE_SQL}, k AS (SELECT unnest(generate_series(0, 9)) AS k), r AS (SELECT date_trunc('day', ts) + INTERVAL 1 DAY + to_days(CAST(k AS INTEGER)) AS w, CAST(user_id % 7 AS VARCHAR) AS repo, event_type, closed, late FROM e JOIN mark USING (batch), k),
c AS (SELECT w, repo, event_type, count(*) AS n FROM r WHERE w <= closed AND (late IS NULL OR w > late) GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY w, repo) AS total FROM c), d AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY w, repo ORDER BY n DESC, event_type) = 1)
SELECT strftime(w, '%Y-%m-%d') AS window_end, repo, 'event' AS dimension, event_type AS dominant, round(n / total, 3) AS share, CAST(total AS BIGINT) AS total, CASE WHEN total < 5 THEN 'too few to say' WHEN round(n / total, 3) >= 0.85 THEN 'convention' WHEN round(n / total, 3) >= 0.6 THEN 'weak' ELSE 'split' END AS verdict FROM d""")
def sliding_verdicts(spark, sf_dir):
    """Verdicts of the sliding windows that closed, from rows that weren't too late."""
    e = arrivals(spark, batched_events(spark, sf_dir), range(4)).select((F.col("user_id") % 7).cast("string").alias("repo"), F.lit("event").alias("dimension"), F.col("event_type").alias("bucket"), "ts")
    counted = finished(streams.sliding_shares(e, "10 days", "1 day", "2 days"))
    return streams.sliding_verdicts(counted).withColumn("window_end", F.date_format("window_end", "yyyy-MM-dd"))


@query("""WITH s AS (SELECT unnest([1, 2, 3]) AS scan), l AS (SELECT DISTINCT CAST(l_suppkey % 20 AS VARCHAR) AS repo, CAST(l_linenumber AS VARCHAR) AS dimension, CAST(l_partkey AS VARCHAR) AS path, l_partkey AS k FROM lineitem),
seen AS (SELECT repo, scan, row_number() OVER (PARTITION BY repo ORDER BY scan) AS o FROM (SELECT DISTINCT repo FROM l), s WHERE NOT (repo = '5' AND scan = 1) AND NOT (repo = '9' AND scan = 2)),
v AS (SELECT l.repo, dimension, path, scan, o, (k + scan) % 3 <> 0 AND NOT (l.repo = '7' AND scan = 2) AS here FROM l JOIN seen USING (repo)),
m AS (SELECT *, min(CASE WHEN NOT here THEN o END) OVER (PARTITION BY repo, dimension, path) AS missing FROM v)
SELECT repo, CAST(scan AS BIGINT) AS scan, dimension, path, CASE WHEN missing IS NULL OR o < missing THEN CASE WHEN o = 1 THEN 'accepted' ELSE 'carried' END WHEN o = missing THEN 'paid' ELSE 'regression' END AS status FROM m WHERE here OR (o = missing AND o > 1)""")
def ratchet_scans(spark, sf_dir):
    """Three scans of many repos, the second delivered twice: one repo comes late, one isn't scanned in between, one pays everything and falls back."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).cast("string").alias("repo"), F.col("l_linenumber").cast("string").alias("dimension"), F.col("l_partkey").cast("string").alias("path"), "l_partkey").distinct()
    rows = cut(rows)  # every batch reads them again
    each = rows.withColumn("scan", F.explode(F.array(*[F.lit(i).cast("long") for i in (1, 2, 3)]))).filter("not (repo = '5' and scan = 1) and not (repo = '9' and scan = 2)")
    found = each.filter("(l_partkey + scan) % 3 <> 0 and not (repo = '7' and scan = 2)").select("repo", "scan", "dimension", "path")
    marks = each.select("repo", "scan", F.lit(None).cast("string").alias("dimension"), F.lit(None).cast("string").alias("path")).distinct()
    scans = found.unionByName(marks).withColumn("batch", F.col("scan"))
    again = scans.filter("scan = 2").withColumn("batch", F.lit(4).cast("long"))
    folder = shared_folder(spark)
    arriving = arrivals(spark, scans.unionByName(again), (1, 2, 4, 3), "repo")
    arriving.writeStream.foreachBatch(streams.ratchet_statuses(folder)).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("repo string, scan long, dimension string, path string, status string").parquet(f"{folder}/rows").drop("batch")
