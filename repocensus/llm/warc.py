"""WARC archives written and read by Spark, and their capture index merged from sorted runs."""

from __future__ import annotations

import hashlib
import zlib
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, new_folder, partitions

LEAST_REVISIT = 1000
#: The date of captures that have none.
START = "2024-01-01T00:00:00Z"
CRLF = "\r\n"


class LoserTree:
    """Merges sorted iterators: a tree of losers gives the smallest head with one comparison a level."""

    def __init__(self, runs, key):
        self.key, self.runs = key, [iter(r) for r in runs]
        self.k = max(1, len(self.runs))
        self.heads = [next(r, None) for r in self.runs] or [None]
        self.tree = [-1] * self.k
        self.winner = -1
        for i in range(len(self.heads)):
            self._replay(i, building=True)

    def _less(self, i: int, j: int) -> bool:
        """Whether run i's head comes before run j's; ended runs come last, ties go to the earlier run."""
        a, b = self.heads[i], self.heads[j]
        if a is None or b is None:
            return b is None and (a is not None or i < j)
        x, y = self.key(a), self.key(b)
        return x < y or (x == y and i < j)

    def _replay(self, i: int, building: bool = False) -> None:
        node = (i + self.k) // 2
        while node:
            other = self.tree[node]
            if other < 0 and building:
                self.tree[node] = i
                return
            if other >= 0 and self._less(other, i):
                self.tree[node], i = i, other
            node //= 2
        self.winner = i

    def __iter__(self):
        while (head := self.heads[self.winner]) is not None:
            yield head
            self.heads[self.winner] = next(self.runs[self.winner], None)
            self._replay(self.winner)


def url_key(url: str | None) -> str:
    """Sort key of a url: host labels reversed and lower-cased, then path and query; without scheme and fragment."""
    rest = (url or "").partition("://")[2] or (url or "")
    rest = rest.split("#", 1)[0]
    host = rest.replace("?", "/").split("/", 1)[0]
    return ",".join(reversed(host.lower().split("."))) + ")" + (rest[len(host) :] or "/")


def record(page_id: int | None, url: str | None, date: str, kind: str, digest: str, n_bytes: int, refers: int | None, payload: str) -> str:
    """A WARC record without the two line ends that close it. A revisit has no block and names what it refers to."""
    uri = quote(url or "", safe="/:?#[]@!$&'()*+,;=%~", encoding="utf-8", errors="replace")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {n_bytes}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>", "Content-Length: 0"]
        payload = ""
    else:
        head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {n_bytes}"]
    return CRLF.join(head) + CRLF + CRLF + payload


def parse_records(raw: bytes):
    """(offset, headers, block) of each record of an archive's bytes."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode("utf-8").split(CRLF)
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        stop = end + 4 + int(headers["Content-Length"])
        if not lines[0].startswith("WARC/") or raw[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"not a WARC record at {at}")
        yield at, headers, raw[end + 4 : stop]
        at = stop + 4


def with_revisits(pages: DataFrame, date: Column | None = None) -> DataFrame:
    """page_id, url, html, date (a column over ``pages``; null: START), digest (SHA-1), n_bytes, refers_to: null, or the largest page_id with the same payload where that
    is another's and the payload has LEAST_REVISIT bytes at least."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), F.coalesce(F.lit(None) if date is None else date, F.lit(START)).alias("date"))
    own = own.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("n_bytes", F.octet_length("html").cast("long"))
    long_ones = own.filter((F.col("n_bytes") >= LEAST_REVISIT) & F.col("page_id").isNotNull()).select("page_id", "digest")
    last = long_ones.groupBy("digest").agg(F.max("page_id").alias("last"), F.min("page_id").alias("first")).filter("first < last").select("digest", "last")
    again = materialize(long_ones.join(materialize(last, "payloads"), "digest").filter("page_id <> last").select("page_id", F.col("digest").alias("of"), F.col("last").alias("refers_to")).distinct(), "revisits")
    return own.join(again, (own.page_id == again.page_id) & (own.digest == again.of), "left").select(own.page_id, "url", "html", "date", "digest", "n_bytes", "refers_to")


def write_archives(pages: DataFrame, folder: str, date: Column | None = None, records_per_file: int = 4_000) -> None:
    """Write one record per row of ``pages`` (page_id, url, html) as gzip-compressed WARC files into ``folder``, by Spark's own writer. ``date`` is a
    column over ``pages`` with the capture's time in ISO 8601, in UTC and whole seconds; without it or where it is null, START.

    A page whose payload of at least LEAST_REVISIT bytes is that of a larger page_id is a revisit of it, all others are
    responses. Null html: an empty payload; null url: an empty target; null page_id: an empty record id, always a response;
    repeated rows: a record each. Control characters in urls are escaped. Empty table: no records.
    """

    def lines(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                s = b.slice(at, 256)
                cols = [s.column(c).to_pylist() for c in ("page_id", "url", "date", "digest", "n_bytes", "refers_to", "html")]
                yield pa.RecordBatch.from_arrays([pa.array([record(p, u, t, "response" if r is None else "revisit", d, n, r, h) for p, u, t, d, n, r, h in zip(*cols, strict=True)], pa.string())], names=["value"])

    out = with_revisits(pages, date).mapInArrow(lines, "value string")
    out.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(f"{folder}/warc")


class CorruptArchive(Exception):
    """A payload that doesn't have the digest its record states."""


def read_archives(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """Every record of the archives: file, offset (in the uncompressed file), page_id, url, date, record_type, payload_digest,
    payload_bytes, refers_to and, with ``payloads``, the block. Each archive's records come sorted by url_key, date and
    page_id: a run of the index. A response's digest is computed anew and must be as stated."""
    schema = "file string, offset long, page_id long, url string, url_key string, date string, record_type string, payload_digest string, payload_bytes long, refers_to long" + ", payload binary" * payloads

    def number(urn: str | None) -> int | None:
        digits = (urn or "")[len("<urn:page:") : -1]
        return int(digits) if digits else None

    def run(batches):
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                rows = []
                for at, h, block in parse_records(zlib.decompress(content.as_py(), 31)):
                    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if h["WARC-Type"] == "response" and hashlib.sha1(block).hexdigest() != digest:
                        raise CorruptArchive(f"{path} at {at}")
                    rows.append((path.rsplit("/", 1)[-1], at, number(h["WARC-Record-ID"]), h["WARC-Target-URI"], url_key(h["WARC-Target-URI"]), h["WARC-Date"], h["WARC-Type"], digest, int(h["WARC-Payload-Length"]), number(h.get("WARC-Refers-To")), *([block] if payloads else [])))
                rows.sort(key=lambda r: (r[4], r[5], -1 if r[2] is None else r[2]))
                for at in range(0, len(rows), 500):
                    yield _batch(rows[at : at + 500])

    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    names = [x.strip().split()[0] for x in schema.split(",")]

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=False)], names=names)

    return spark.read.format("binaryFile").load(f"{folder}/warc").select("path", "content").mapInArrow(run, schema)


def merged_index(records: DataFrame) -> DataFrame:
    """The capture index in global order of url_key, date and page_id, with the rank of each capture in the history of its url_key within its range.

    Each archive's captures form a run, sorted where it was read. Ranges of the keys are then dealt out, a hot url's
    captures among several ranges by date and page_id; each range gets a slice of every run, put in the run's order again
    after the shuffle, and merges the slices by a loser tree. Column ``range`` and ``place`` give the global order.
    """
    schema = ", ".join(f"{c} {t}" for c, t in records.dtypes) + ", range int, place long"
    dealt = records.repartitionByRange(partitions(records.sparkSession), "url_key", "date", "page_id").sortWithinPartitions("file", "url_key", "date", "page_id")

    def merge(batches):
        from pyspark import TaskContext

        got = list(batches)
        if not got:
            return
        table = pa.Table.from_batches(got)
        file = table.column("file").to_pylist()
        keys = list(zip(table.column("url_key").to_pylist(), table.column("date").to_pylist(), [-1 if x is None else x for x in table.column("page_id").to_pylist()], strict=True))
        begins = [i for i in range(len(file)) if i == 0 or file[i] != file[i - 1]]
        tree = LoserTree([range(a, b) for a, b in zip(begins, [*begins[1:], len(file)], strict=True)], keys.__getitem__)
        order = np.fromiter(tree, np.int64, len(file))
        me = TaskContext.get().partitionId()
        for at in range(0, len(order), 5000):  # rows stay in Arrow; only their keys are objects
            part = table.take(pa.array(order[at : at + 5000])).combine_chunks()
            part = part.append_column("range", pa.array(np.full(len(part), me, np.int32))).append_column("place", pa.array(np.arange(at, at + len(part))))
            yield from part.to_batches()

    return dealt.mapInArrow(merge, schema)


def archive_and_index(pages: DataFrame, date: Column | None = None) -> DataFrame:
    """Write the pages into new archives in the shared folder, read them back, and merge the index of their captures."""
    folder = new_folder(pages.sparkSession, "archives")
    write_archives(pages, folder, date)
    return merged_index(read_archives(pages.sparkSession, folder))
