"""Queries on distributions, ratchets, duplicates, security and styles, over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import spread
from ..operators import distributions as D
from ..operators import duplicates, quality, ratchet, security, styles
from ..sources import markup

Q: dict = {}
SQL: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def register(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# distributions: documents are files, their source the repo

def doc_dimensions() -> dict:
    n, t = F.length("text"), F.col("text")
    return {
        "language": F.col("lang"),
        "length": F.when(n < 1000, "short").when(n < 4000, "medium").otherwise("long"),
        "licence": F.when(F.lower(t).contains("licen") | t.contains("All rights reserved."), "stated").otherwise("absent"),
        "layout": F.when(t.contains(" | "), "table").when(t.contains("!!"), "shouting").otherwise("prose"),
        "token": F.when(t.contains('token = "'), "literal"),
    }


def doc_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.observe(table(spark, sf_dir, "documents"), doc_dimensions(), "source", "doc_id")


OBS = """
obs AS (
  SELECT source AS repo, doc_id AS path, 'language' AS dimension, lang AS bucket FROM documents
  UNION ALL SELECT source, doc_id, 'length', CASE WHEN length(text) < 1000 THEN 'short' WHEN length(text) < 4000 THEN 'medium' ELSE 'long' END FROM documents
  UNION ALL SELECT source, doc_id, 'licence', CASE WHEN contains(lower(text), 'licen') OR contains(text, 'All rights reserved.') THEN 'stated' ELSE 'absent' END FROM documents
  UNION ALL SELECT source, doc_id, 'layout', CASE WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, '!!') THEN 'shouting' ELSE 'prose' END FROM documents
  UNION ALL SELECT source, doc_id, 'token', 'literal' FROM documents WHERE contains(text, 'token = "')
)"""


def summary_sql(rows: str, name: str) -> str:
    """CTE ``name``: the verdicts over the observations ``rows``."""
    return f"""
{name}_c AS (SELECT repo, dimension, bucket, count(*) AS n FROM {rows} GROUP BY ALL),
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY repo, dimension ORDER BY n DESC, bucket) AS r, sum(n) OVER (PARTITION BY repo, dimension) AS total FROM {name}_c),
{name} AS (SELECT repo, dimension, bucket AS dominant, round(n / total, 3) AS share, CAST(total AS BIGINT) AS total,
  CASE WHEN total < 5 THEN 'too few to say' WHEN round(n / total, 3) >= 0.85 THEN 'convention' WHEN round(n / total, 3) >= 0.6 THEN 'weak' ELSE 'split' END AS verdict
  FROM {name}_r WHERE r = 1)"""


@query(f"""WITH {OBS}, {summary_sql('obs', 's')}
SELECT s.*, d.distribution FROM s JOIN (SELECT repo, dimension, string_agg(bucket || '=' || n, ',' ORDER BY bucket) AS distribution FROM s_c GROUP BY ALL) d USING (repo, dimension)""")
def convention_verdicts(spark, sf_dir):
    s = D.summarise(D.counts(doc_observations(spark, sf_dir)))
    text = F.array_join(F.transform(F.map_entries("distribution"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return s.withColumn("distribution", text)


@query(f"""WITH {OBS}, r AS (SELECT *, row_number() OVER (PARTITION BY repo, dimension, bucket ORDER BY path) AS k, count(*) OVER (PARTITION BY repo, dimension, bucket) AS n FROM obs)
SELECT repo, dimension, bucket, n, string_agg(CAST(path AS VARCHAR), ',' ORDER BY path) AS examples FROM r WHERE k <= 3 GROUP BY repo, dimension, bucket, n""")
def bucket_examples(spark, sf_dir):
    return D.tally(doc_observations(spark, sf_dir)).withColumn("examples", F.array_join(F.transform("examples", lambda x: x.cast("string")), ","))


@query(f"""WITH {OBS}, {summary_sql('obs', 's')}, b AS (SELECT repo, count(*) FILTER (verdict = 'convention') AS strong, count(*) FILTER (verdict = 'split') AS split, count(*) FILTER (verdict <> 'too few to say') AS readable FROM s GROUP BY repo)
SELECT *, CASE WHEN strong / 5.0 >= 0.7 THEN 'settled' WHEN strong / 5.0 >= 0.4 AND coalesce(split / nullif(readable, 0), 0) >= 0.2 THEN 'drifted' WHEN readable < 2.5 THEN 'too early' WHEN strong > 0 THEN 'mixed' ELSE 'greenfield' END AS mode FROM b""")
def repo_modes(spark, sf_dir):
    return D.mode(D.summarise(D.counts(doc_observations(spark, sf_dir))), 5)


EVENTS = "ev AS (SELECT CAST(user_id % 7 AS VARCHAR) AS repo, 'event' AS dimension, event_type AS bucket, event_id AS path, ts FROM events)"


def event_observations(spark, sf_dir):
    return table(spark, sf_dir, "events").select((F.col("user_id") % 7).cast("string").alias("repo"), F.lit("event").alias("dimension"), F.col("event_type").alias("bucket"), F.col("event_id").alias("path"), "ts")


@query(f"""WITH {EVENTS}, late AS (SELECT * FROM ev WHERE ts >= (SELECT max(ts) FROM ev) - INTERVAL 1 DAY), {summary_sql('ev', 'a')}, {summary_sql('late', 'l')}, j AS (
  SELECT a.repo, a.dimension, CASE WHEN a.dominant <> l.dominant THEN 'moved' WHEN round(l.share - a.share, 3) > 0.15 THEN 'consolidating' END AS kind, a.dominant, a.share, l.dominant AS recent, l.share AS recent_share
  FROM a JOIN l USING (repo, dimension) WHERE l.total >= 10) SELECT * FROM j WHERE kind IS NOT NULL""")
def drift(spark, sf_dir):
    ev = event_observations(spark, sf_dir)
    end = ev.agg(F.max("ts").alias("end"))
    late = ev.join(F.broadcast(end)).filter(F.col("ts") >= F.col("end") - F.expr("INTERVAL 1 DAY"))
    return D.drift(ev, late)


@query(f"""WITH {OBS}, o AS (SELECT obs.*, CAST(floor(n_chars / 1000) AS BIGINT) AS subtree FROM obs JOIN documents ON path = doc_id), f AS (SELECT repo, subtree, count(DISTINCT path) AS files FROM o GROUP BY ALL HAVING count(DISTINCT path) >= 12),
sub AS (SELECT repo || '/' || subtree AS repo, dimension, bucket FROM o), {summary_sql('sub', 'x')}, {summary_sql('obs', 'w')}
SELECT f.repo, f.subtree, x.dimension, x.dominant AS expect, x.share, x.total, f.files, w.dominant AS repo_dominant FROM x JOIN f ON x.repo = f.repo || '/' || f.subtree JOIN w ON w.repo = f.repo AND w.dimension = x.dimension WHERE x.verdict = 'convention' AND x.dominant <> w.dominant""")
def scoped_rules(spark, sf_dir):
    size = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.floor(F.col("n_chars") / 1000).alias("thousands"))
    return D.scoped_rules(doc_observations(spark, sf_dir).join(size, "path"), F.col("thousands"))


@query("""WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS k, sum(n) OVER (PARTITION BY source) AS total FROM c)
SELECT source, lang, n, round(n / total, 3) AS share, CAST(total AS BIGINT) AS total FROM r WHERE k = 1""")
def majority_language(spark, sf_dir):
    return D.majority(table(spark, sf_dir, "documents"), ["source"], "lang")


@query("""WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS k FROM c), t AS (SELECT source, lang AS dominant, n AS dominant_n FROM r WHERE k = 1)
SELECT * FROM c JOIN t USING (source) WHERE lang <> dominant AND 2 * n <= dominant_n""")
def language_outliers(spark, sf_dir):
    return D.outliers(table(spark, sf_dir, "documents"), ["source"], "lang")


@query("SELECT source, doc_id, n_chars, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 5")
def longest_documents(spark, sf_dir):
    return D.top_k(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), F.col("doc_id")], 5)


# ratchet: orders of a clerk's half, status as bucket; the earlier half of the keys is the baseline

ORD = "ord AS (SELECT CAST(o_custkey % 20 AS VARCHAR) AS repo, o_orderpriority AS dimension, o_orderkey AS path, o_orderstatus AS bucket, o_orderdate FROM orders)"
RULES_SQL = """(SELECT repo, dimension, CASE WHEN verdict = 'too few to say' THEN 'undecided' WHEN verdict = 'convention' THEN 'enforce' WHEN verdict = 'weak' THEN 'documented' ELSE 'undecided' END AS standing, dominant AS expect, share, total, 'whole' AS source FROM {0})"""


def order_observations(spark, sf_dir):
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).cast("string").alias("repo"), F.col("o_orderpriority").alias("dimension"), F.col("o_orderkey").alias("path"), F.col("o_orderstatus").alias("bucket"), "o_orderdate")


def split_orders(spark, sf_dir):
    o = order_observations(spark, sf_dir)
    return o.filter("o_orderdate < date '1996-01-01'"), o


@query(f"WITH {OBS}, {summary_sql('obs', 's')} SELECT * FROM {RULES_SQL.format('s')}")
def rule_proposals(spark, sf_dir):
    return ratchet.propose_rules(D.summarise(D.counts(doc_observations(spark, sf_dir))))


@query(f"""WITH {ORD}, early AS (SELECT * FROM ord WHERE o_orderdate < DATE '1996-01-01'), {summary_sql('early', 'a')}, {summary_sql('ord', 'b')}
SELECT repo, dimension, a.dominant AS before, b.dominant AS after, CASE WHEN a.dominant IS NULL THEN 'added' WHEN b.dominant IS NULL THEN 'removed' WHEN a.dominant = b.dominant THEN 'steady' ELSE 'changed' END AS status FROM a FULL JOIN b USING (repo, dimension)""")
def rule_diff(spark, sf_dir):
    a, b = (D.summarise(D.counts(x)).withColumnRenamed("dominant", "expect") for x in split_orders(spark, sf_dir))
    return ratchet.rule_diff(a, b)


@query(f"""WITH {ORD}, early AS (SELECT * FROM ord WHERE o_orderdate < DATE '1996-01-01'), {summary_sql('early', 'a')}, {summary_sql('ord', 'b')},
va AS (SELECT repo, dimension, path FROM early JOIN a USING (repo, dimension) WHERE bucket <> dominant), vb AS (SELECT repo, dimension, path FROM ord JOIN b USING (repo, dimension) WHERE bucket <> dominant),
d AS (SELECT repo, dimension, CASE WHEN a.dominant = b.dominant THEN 'steady' ELSE 'other' END AS rule FROM a FULL JOIN b USING (repo, dimension)),
f AS (SELECT coalesce(va.repo, vb.repo) AS repo, coalesce(va.dimension, vb.dimension) AS dimension, coalesce(va.path, vb.path) AS path, va.path IS NOT NULL AS was, vb.path IS NOT NULL AS is_now FROM va FULL JOIN vb ON va.repo = vb.repo AND va.dimension = vb.dimension AND va.path = vb.path)
SELECT repo, dimension, path, CASE WHEN was AND is_now THEN 'carried' WHEN was THEN CASE WHEN rule = 'steady' THEN 'paid' ELSE 'released' END WHEN rule = 'steady' THEN 'regression' ELSE 'taken on' END AS status FROM f LEFT JOIN d USING (repo, dimension)""")
def ratchet_status(spark, sf_dir):
    early, every = split_orders(spark, sf_dir)
    ra, rb = (D.summarise(D.counts(x)).withColumnRenamed("dominant", "expect") for x in (early, every))
    return ratchet.ratchet(ratchet.violations(early, ra), ratchet.violations(every, rb), ra, rb)


@query(f"""WITH {ORD}, {summary_sql('ord', 'b')}, v AS (SELECT repo, dimension, path, o_orderdate FROM ord JOIN b USING (repo, dimension) WHERE bucket <> dominant)
SELECT repo, dimension, path FROM v WHERE o_orderdate >= DATE '1996-01-01'""")
def gate_new_violations(spark, sf_dir):
    early, every = split_orders(spark, sf_dir)
    rules = D.summarise(D.counts(every)).withColumnRenamed("dominant", "expect")
    return ratchet.gate(ratchet.violations(every, rules), ratchet.violations(early, rules))


# near duplicates: all documents are one repo

FILES = "files AS (SELECT source AS repo, CAST(doc_id AS VARCHAR) || '.txt' AS path, text AS content FROM documents)"


def doc_files(spark, sf_dir, one: bool = False):
    return table(spark, sf_dir, "documents").select((F.lit("all") if one else F.col("source")).alias("repo"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("content"))


@query(r"""WITH t AS (SELECT CAST(doc_id AS VARCHAR) || '.txt' AS path, regexp_extract_all(text, '[^\s]+') AS w FROM documents),
s AS (SELECT path, list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))) AS s FROM t WHERE len(w) >= 5),
k AS (SELECT md5(array_to_string(s, chr(10))) AS key, len(s) AS n, min(path) AS path, count(*) AS copies, any_value(s) AS s FROM s WHERE len(s) >= 40 GROUP BY ALL),
e AS (SELECT path, unnest(s) AS h FROM k),
p AS (SELECT x.path AS a, y.path AS b, count(*) AS shared FROM e x JOIN e y ON x.h = y.h AND x.path < y.path GROUP BY ALL)
SELECT 'all' AS repo, a, b, round(shared / (ka.n + kb.n - shared), 4) AS jaccard, CAST(shared AS INTEGER) AS shared, ka.copies AS copies_a, kb.copies AS copies_b FROM p JOIN k ka ON ka.path = a JOIN k kb ON kb.path = b WHERE shared / (ka.n + kb.n - shared) >= 0.5""")
def near_duplicate_files(spark, sf_dir):
    return duplicates.near_duplicates(doc_files(spark, sf_dir, one=True), token=r"[^\s]+", clean=False)


# security

HEX_TOKEN = {"hex-token": r"token = \"[0-9a-f]{40}\"", **{k: security.SECRET_SHAPES[k] for k in ("aws-access-key", "github-token")}}


@query(rf"""WITH {FILES}, l AS (SELECT repo, path, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM files WHERE contains(content, 'token = "') OR regexp_matches(content, '(AKIA|ASIA)|gh[pousr]_')),
m AS (SELECT repo, path, line, text, 'hex-token' AS shape, unnest(regexp_extract_all(text, 'token = "[0-9a-f]{{40}}"')) AS match FROM l
 UNION ALL SELECT repo, path, line, text, 'aws-access-key', unnest(regexp_extract_all(text, '\b(AKIA|ASIA)[0-9A-Z]{{16}}\b')) FROM l
 UNION ALL SELECT repo, path, line, text, 'github-token', unnest(regexp_extract_all(text, '\bgh[pousr]_[A-Za-z0-9]{{36,255}}\b')) FROM l)
SELECT repo, path, CAST(line AS INTEGER) AS line, shape, substr(match, 1, 4) || '… ' || length(match) || ' characters' AS evidence, regexp_matches(text, '(?i)example|sample|placeholder|dummy|fake|your[-_]?key|xxx|<[a-z]') AS mitigated, false AS in_test FROM m""")
def secrets(spark, sf_dir):
    return security.secrets(doc_files(spark, sf_dir), HEX_TOKEN)


@query(rf"""WITH {FILES} SELECT repo, count(*) AS findings FROM files WHERE regexp_matches(content, 'token = "[0-9a-f]{{40}}"') GROUP BY repo""")
def repos_with_live_secrets(spark, sf_dir):
    found = security.live(security.secrets(doc_files(spark, sf_dir), {"hex-token": r"token = \"[0-9a-f]{40}\""}).withColumn("mitigated", F.lit(False)))
    return found.select("repo", "path").distinct().groupBy("repo").agg(F.count("*").alias("findings"))


PAGES = "pg AS (SELECT regexp_extract(url, '[.](com|net|org)(/|$)', 1) AS repo, CAST(page_id AS VARCHAR) || '.html' AS path, html AS content FROM pages)"


def page_files(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.regexp_extract("url", "[.](com|net|org)(/|$)", 1).alias("repo"), F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("content"))


PAGE_RULES = {"script-injection": (r"<script\b", None), "inline-style": (r"<style\b", r"margin:0"), "cleartext": (r"\bhttp://", r"localhost|w3[.]org")}


@query(rf"""WITH {PAGES}, l AS (SELECT repo, path, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM pg), k AS (SELECT * FROM l WHERE NOT regexp_matches(text, '^\s*(//|\*|/\*)'))
SELECT repo, path, CAST(line AS INTEGER) AS line, 'script-injection' AS kind, false AS mitigated, false AS in_test FROM k WHERE regexp_matches(text, '<script\b')
UNION ALL SELECT repo, path, CAST(line AS INTEGER), 'inline-style', regexp_matches(text, 'margin:0'), false FROM k WHERE regexp_matches(text, '<style\b')
UNION ALL SELECT repo, path, CAST(line AS INTEGER), 'cleartext', regexp_matches(text, 'localhost|w3[.]org'), false FROM k WHERE regexp_matches(text, '\bhttp://')""")
def dangerous_patterns(spark, sf_dir):
    return security.dangerous_patterns(page_files(spark, sf_dir), PAGE_RULES, blank=False)


@query(rf"""WITH {PAGES} SELECT repo, count(*) AS considered, CAST(sum(len(regexp_extract_all(content, '<a\s'))) AS BIGINT) AS links, CAST(sum(len(regexp_extract_all(content, '<p[>\s]'))) AS BIGINT) AS paragraphs, CAST(sum(len(regexp_extract_all(content, '<script[>\s]'))) AS BIGINT) AS scripts FROM pg GROUP BY repo""")
def construct_counts(spark, sf_dir):
    return security.pattern_counts(page_files(spark, sf_dir), {"links": r"<a\s", "paragraphs": r"<p[>\s]", "scripts": r"<script[>\s]"})


@query("""WITH a AS (SELECT CAST(l_suppkey % 10 AS VARCHAR) AS repo, 'm' || l_linenumber AS package, CASE l_returnflag WHEN 'A' THEN 'high' WHEN 'R' THEN 'critical' ELSE 'low' END AS severity, l_linestatus AS cause FROM lineitem),
o AS (SELECT repo, package, cause, CASE WHEN bool_or(severity = 'critical') THEN 'critical' WHEN bool_or(severity = 'high') THEN 'high' WHEN bool_or(severity = 'moderate') THEN 'moderate' ELSE 'low' END AS severity, count(*) AS paths FROM a GROUP BY ALL), b AS (SELECT repo, sum(paths) AS paths, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'moderate') AS moderate, count(*) FILTER (severity = 'low') AS low FROM o GROUP BY repo),
u AS (SELECT CAST(s_suppkey % 12 AS VARCHAR) AS repo, count(*) * max(CASE WHEN s_suppkey % 12 = 3 THEN 0 ELSE 1 END) AS audited FROM supplier GROUP BY ALL)
SELECT repo, CAST(audited AS BIGINT) AS audited, CASE WHEN audited > 0 THEN CAST(coalesce(paths, 0) AS BIGINT) END AS paths, CASE WHEN audited > 0 THEN coalesce(critical, 0) END AS critical, CASE WHEN audited > 0 THEN coalesce(high, 0) END AS high, CASE WHEN audited > 0 THEN coalesce(moderate, 0) END AS moderate, CASE WHEN audited > 0 THEN coalesce(low, 0) END AS low, CASE WHEN audited = 0 THEN 'no dependencies were audited' END AS why FROM u LEFT JOIN b USING (repo)""")
def advisory_counts(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).cast("string").alias("repo"), F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("package"), F.when(F.col("l_returnflag") == "A", "high").when(F.col("l_returnflag") == "R", "critical").otherwise("low").alias("severity"), F.array("l_linestatus").alias("via"))
    u = table(spark, sf_dir, "supplier").groupBy((F.col("s_suppkey") % 12).cast("string").alias("repo")).agg((F.count("*") * F.max(F.when(F.col("s_suppkey") % 12 == 3, 0).otherwise(1))).cast("long").alias("audited"))
    return security.advisory_counts(a, u)


@query("""WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS path, p_name AS content, p_type FROM part), m AS (SELECT path, 'drop-s' AS operator, 'a' AS catch_by, replace(content, 's', '') <> content AS applicable, CASE WHEN p_type LIKE '%STEEL%' THEN ['a'] WHEN p_type LIKE '%TIN%' THEN ['b'] ELSE [] END AS failed FROM p
UNION ALL SELECT path, 'blank', 'b', replace(content, ' ', '') <> content, CASE WHEN p_type LIKE '%STEEL%' THEN ['a'] WHEN p_type LIKE '%TIN%' THEN ['b'] ELSE [] END FROM p)
SELECT operator, count(*) FILTER (applicable AND list_contains(failed, catch_by)) AS intended, count(*) FILTER (applicable AND NOT list_contains(failed, catch_by) AND len(failed) > 0) AS luck, count(*) FILTER (applicable AND len(failed) = 0) AS survived, count(*) FILTER (NOT applicable) AS not_applicable FROM m GROUP BY operator""")
def mutation_kill_rate(spark, sf_dir):
    files = table(spark, sf_dir, "part").select(F.lit("r").alias("repo"), F.col("p_partkey").cast("string").alias("path"), F.col("p_name").alias("content"))
    mutants = security.apply_mutations(files, {"drop-s": ("s", "", "a"), "blank": (" ", "", "b")})
    kind = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), F.when(F.col("p_type").contains("STEEL"), F.array(F.lit("a"))).when(F.col("p_type").contains("TIN"), F.array(F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("failed"))
    return security.kill_rate(mutants.join(kind, "path"))


# styles

@query(rf"""WITH {PAGES}, v AS (SELECT repo, 'spacing' AS kind, 4 AS least, 12 AS most, unnest(regexp_extract_all(content, '(?:margin|padding|gap):\s*([^;}}]+)', 1)) AS value FROM pg UNION ALL SELECT repo, 'size', 3, 12, unnest(regexp_extract_all(content, 'font-size:\s*([^;}}]+)', 1)) FROM pg),
u AS (SELECT repo, kind, least, most, lower(trim(value)) AS value, count(*) AS uses FROM v GROUP BY ALL HAVING count(*) >= least)
SELECT repo, kind, value, uses, rank, kind || '-' || lpad(CAST(rank AS VARCHAR), 2, '0') AS name FROM (SELECT *, CAST(row_number() OVER (PARTITION BY repo, kind ORDER BY uses DESC, value) AS INTEGER) AS rank FROM u) WHERE rank <= most""")
def css_scales(spark, sf_dir):
    return styles.ordinal_names(styles.css_scales(page_files(spark, sf_dir), {k: styles.SCALES[k] for k in ("spacing", "size")}))


COLOURS = """col AS (SELECT p_partkey, '#' || lpad(lower(to_hex(p_partkey * 37 % 256)), 2, '0') || lpad(lower(to_hex(p_partkey * 91 % 256)), 2, '0') || lpad(lower(to_hex(p_partkey * 53 % 256)), 2, '0') AS fg,
 '#' || lpad(lower(to_hex(p_partkey * 11 % 256)), 2, '0') || lpad(lower(to_hex(p_partkey * 7 % 256)), 2, '0') || lpad(lower(to_hex(p_partkey * 3 % 256)), 2, '0') AS bg, p_size FROM part)"""


def lum(c: str) -> str:
    part = lambda i: f"(CAST('0x' || substr({c}, {i}, 2) AS INTEGER) / 255.0)"
    lin = lambda i: f"CASE WHEN {part(i)} <= 0.03928 THEN {part(i)} / 12.92 ELSE pow(({part(i)} + 0.055) / 1.055, 2.4) END"
    return f"(0.2126 * ({lin(2)}) + 0.7152 * ({lin(4)}) + 0.0722 * ({lin(6)}))"


def dist(a: str, b: str) -> str:
    return " + ".join(f"abs(CAST('0x' || substr({a}, {i}, 2) AS INTEGER) - CAST('0x' || substr({b}, {i}, 2) AS INTEGER))" for i in (2, 4, 6))


def part_colours(spark, sf_dir):
    k = F.col("p_partkey")

    def hex_(*by):
        return F.concat(F.lit("#"), *[F.lower(F.lpad(F.hex(k * b % 256), 2, "0")) for b in by])

    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", hex_(37, 91, 53).alias("fg"), hex_(11, 7, 3).alias("bg"), "p_size")


@query(rf"""WITH {COLOURS}, pg AS (SELECT CAST(p_size % 7 AS VARCHAR) AS repo, CAST(p_partkey AS VARCHAR) AS path, 'a{{color:' || fg || ';background:' || bg || ';width:' || p_size || 'px}}' AS content FROM col), c AS (SELECT repo, path, CAST(len(regexp_extract_all(content, '#[0-9a-fA-F]{{6}}\b')) AS BIGINT) AS hex, CAST(len(regexp_extract_all(content, '\b[0-9]+px\b')) AS BIGINT) AS px FROM pg), t AS (SELECT *, hex + px AS total FROM c WHERE hex + px > 0)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY repo ORDER BY total DESC, path) AS INTEGER) AS rank FROM t) WHERE rank <= 20""")
def hardcoded_values(spark, sf_dir):
    c = part_colours(spark, sf_dir)
    css = F.concat(F.lit("a{color:"), F.col("fg"), F.lit(";background:"), F.col("bg"), F.lit(";width:"), F.col("p_size").cast("string"), F.lit("px}"))
    return styles.hardcoded(c.select((F.col("p_size") % 7).cast("string").alias("repo"), F.col("p_partkey").cast("string").alias("path"), css.alias("content")))


@query(f"""WITH {COLOURS}, d AS (SELECT DISTINCT 'all' AS repo, fg, bg FROM col WHERE fg <> bg), l AS (SELECT *, {lum('fg')} AS a, {lum('bg')} AS b FROM d)
SELECT repo, fg, bg, round((greatest(a, b) + 0.05) / (least(a, b) + 0.05), 2) AS ratio, round((greatest(a, b) + 0.05) / (least(a, b) + 0.05), 2) < 4.5 AS fails FROM l""")
def contrast_pairs(spark, sf_dir):
    c = part_colours(spark, sf_dir)
    decls = c.select(F.lit("all").alias("repo"), F.lit("f").alias("file"), F.col("p_partkey").alias("rule_id"), F.lit("a").alias("selector"), F.explode(F.array(F.struct(F.lit("color").alias("prop"), F.col("fg").alias("value"), F.lit(1).alias("ord")), F.struct(F.lit("background").alias("prop"), F.lit("#fff").alias("value"), F.lit(2).alias("ord")), F.struct(F.lit("background").alias("prop"), F.col("bg").alias("value"), F.lit(3).alias("ord")))).alias("d")).select("repo", "file", "rule_id", "selector", "d.*")
    return styles.contrast_pairs(decls).select("repo", "fg", "bg", "ratio", "fails")


@query(f"""WITH RECURSIVE {COLOURS}, k AS (SELECT CAST(p_size % 7 AS VARCHAR) AS repo, p_partkey AS k, fg, bg, lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS file FROM col),
token AS (SELECT repo, '--ink-' || k AS token, fg AS value FROM k UNION ALL SELECT repo, '--paper-' || k, CASE k % 4 WHEN 0 THEN bg WHEN 1 THEN '--ink-' || (k - k % 50) WHEN 2 THEN '--paper-' || (k + 7) ELSE '--paper-' || k END FROM k),
chase AS (SELECT repo, token, value, 0 AS depth FROM token UNION ALL SELECT c.repo, c.token, t.value, depth + 1 FROM chase c JOIN token t ON t.repo = c.repo AND t.token = c.value WHERE depth < 6),
known AS (SELECT repo, token, any_value(value) AS rgb FROM chase WHERE value LIKE '#%' GROUP BY ALL),
rule AS (SELECT repo, file, '--ink-' || k AS fg, '--paper-' || k AS bg, '.card-' || k AS selector, k % 3 = 0 AS state, k FROM k UNION ALL
SELECT repo, file, 'rgb(' || k % 256 || ', ' || k * 7 % 256 || ' 9)' AS fg, '#ffffff' AS bg, '.plain-' || k || ' > b, i' AS selector, false, k FROM k UNION ALL SELECT repo, file, fg, '--nowhere', '.lost', false, k FROM k),
one AS (SELECT repo, fg, bg, max(file) AS file, arg_max(selector, file) AS selector, arg_max(state, file) AS state FROM rule GROUP BY ALL),
seen AS (SELECT o.*, CASE WHEN o.fg LIKE '--%' THEN a.rgb WHEN o.fg LIKE 'rgb%' THEN '#' || array_to_string(list_transform(regexp_extract_all(o.fg, '[0-9]+'), lambda x: lpad(lower(to_hex(CAST(x AS BIGINT))), 2, '0')), '') ELSE o.fg END AS f, CASE WHEN o.bg LIKE '--%' THEN b.rgb ELSE '#ffffff' END AS g
FROM one o LEFT JOIN known a ON a.repo = o.repo AND a.token = o.fg LEFT JOIN known b ON b.repo = o.repo AND b.token = o.bg),
r AS (SELECT *, CASE WHEN state THEN 'state overridden' WHEN f IS NULL OR g IS NULL THEN 'unresolved' ELSE 'checked' END AS outcome, {lum('f')} AS a, {lum('g')} AS b FROM seen)
SELECT repo, fg, bg, file || '.css' AS file, selector, outcome, CASE outcome WHEN 'state overridden' THEN selector || ' is repainted by a state rule' WHEN 'unresolved' THEN concat_ws(', ', CASE WHEN f IS NULL THEN fg END, CASE WHEN g IS NULL THEN bg END) || ' leads to no colour' END AS reason,
CASE WHEN outcome = 'checked' THEN round((greatest(a, b) + 0.05) / (least(a, b) + 0.05), 2) END AS ratio, CASE WHEN outcome = 'checked' THEN round((greatest(a, b) + 0.05) / (least(a, b) + 0.05), 2) < 4.5 END AS fails FROM r""")
def contrast_report(spark, sf_dir):
    k = part_colours(spark, sf_dir)
    css = F.expr("""concat('/* a: b */ @media (min-width: 1px) { :root { --ink-', p_partkey, ': ', fg, '; --paper-', p_partkey, ': ',
    case p_partkey % 4 when 0 then bg when 1 then concat('var(--ink-', p_partkey - p_partkey % 50, ')') when 2 then concat('VAR( --paper-', p_partkey + 7, ', #fff)') else concat('var(--paper-', p_partkey, ')') end, '; } }\n',
    '.card-', p_partkey, ' { color: red; background: var(--never); color: var(--ink-', p_partkey, ', blue); background-color: var(--paper-', p_partkey, '); color: inherit }\n',
    if(p_partkey % 3 = 0, concat('a:checked + .card-', p_partkey, ':hover::before, .other { background: url(x;y) }\n'), ''),
    '.plain-', p_partkey, ' > b, i { color: rgb(', p_partkey % 256, ', ', p_partkey * 7 % 256, ' 9); background: #FFF }\n.lost { color: ', fg, '; background: var(--nowhere) }')""")
    files = k.select((F.col("p_size") % 7).cast("string").alias("repo"), F.format_string("%09d.css", "p_partkey").alias("path"), css.alias("content"))
    return styles.contrast_pairs(markup.css_declarations(files))


@query(f"""WITH {COLOURS}, t AS (SELECT DISTINCT 't' || p_size AS token, bg AS colour FROM col), r AS (SELECT p_partkey, fg AS colour, token, CAST({dist('fg', 't.colour')} AS INTEGER) AS distance FROM col, t)
SELECT p_partkey, colour, token, distance FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY distance, token) AS k FROM r) WHERE k = 1""")
def nearest_token(spark, sf_dir):
    c = part_colours(spark, sf_dir)
    tokens = c.select(F.concat(F.lit("t"), F.col("p_size").cast("string")).alias("token"), F.col("bg").alias("colour")).distinct()
    return styles.nearest_token(c.select("p_partkey", F.col("fg").alias("colour")), tokens)


PIXELS = "px AS (SELECT CAST(l_suppkey % 5 AS VARCHAR) AS image, '#' || repeat(lower(to_hex(CAST(16 + l_linenumber * l_linenumber * 3 AS BIGINT))), 3) AS rgb, CAST(l_quantity AS BIGINT) AS n FROM lineitem)"


def pixels(spark, sf_dir):
    step = F.lower(F.hex((16 + F.col("l_linenumber") * F.col("l_linenumber") * 3).cast("long")))
    return table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 5).cast("string").alias("image"), F.concat(F.lit("#"), F.repeat(step, 3)).alias("rgb"), F.col("l_quantity").cast("long").alias("n"))


def palette_sql(px: str, keep: float, merge: int) -> str:
    """Colour by colour in order of count, with the list of those that stand so far."""
    far = dist("h.rgb", "c.rgb")
    return f"""WITH RECURSIVE {px}, n AS (SELECT image, rgb, CAST(sum(n) AS BIGINT) AS n FROM px GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY image) AS total, row_number() OVER (PARTITION BY image ORDER BY n DESC, rgb) AS k FROM n),
fold AS (SELECT DISTINCT image, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(rgb VARCHAR, n BIGINT)[]) AS heads FROM c UNION ALL
SELECT image, k, CASE WHEN n >= {keep} * total OR near IS NULL OR near > {merge} THEN list_append(heads, {{'rgb': rgb, 'n': n}}) ELSE list_transform(heads, lambda h, i: CASE WHEN i = list_position(away, near) THEN {{'rgb': h.rgb, 'n': h.n + n}} ELSE h END) END
FROM (SELECT *, list_min(away) AS near FROM (SELECT f.image, c.k, c.rgb, c.n, c.total, f.heads, list_transform(f.heads, lambda h: {far}) AS away FROM fold f JOIN c ON c.image = f.image AND c.k = f.k + 1))),
ends AS (SELECT image, unnest(heads) AS h FROM fold WHERE k = (SELECT max(k) FROM c WHERE c.image = fold.image)), t AS (SELECT image, CAST(sum(n) AS BIGINT) AS total FROM n GROUP BY image)
SELECT * FROM (SELECT image, h.rgb AS rgb, h.n AS n, round(h.n / total, 4) AS share, CAST(row_number() OVER (PARTITION BY image ORDER BY h.n DESC, h.rgb) AS INTEGER) AS rank FROM ends JOIN t USING (image)) WHERE rank <= 12"""


@query(palette_sql(PIXELS, 0.1, 200))
def palette(spark, sf_dir):
    return styles.palette(pixels(spark, sf_dir), keep=0.1, merge=200)


MANY = "px AS (SELECT CAST(l_suppkey % 5 AS VARCHAR) AS image, '#' || lpad(lower(to_hex(CAST(l_quantity % 10 * 25 AS BIGINT))), 2, '0') || lpad(lower(to_hex(CAST(l_linenumber * 30 AS BIGINT))), 2, '0') || lpad(lower(to_hex(CAST(l_orderkey % 4 * 10 AS BIGINT))), 2, '0') AS rgb, CAST(CASE WHEN l_quantity >= 40 THEN 1 + l_linenumber ELSE 1 END AS BIGINT) AS n FROM lineitem)"


def many_pixels(spark, sf_dir):
    rgb = [F.lower(F.lpad(F.hex(F.expr(f"cast({x} as long)")), 2, "0")) for x in ("l_quantity % 10 * 25", "l_linenumber * 30", "l_orderkey % 4 * 10")]
    return table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 5).cast("string").alias("image"), F.concat(F.lit("#"), *rgb).alias("rgb"), F.expr("cast(if(l_quantity >= 40, 1 + l_linenumber, 1) as long)").alias("n"))


@query(palette_sql(MANY, 0.01, 36))
def palette_folded(spark, sf_dir):
    return styles.palette(many_pixels(spark, sf_dir), keep=0.01)


def hsl_sql(c: str) -> str:
    r, g, b = [f"CAST('0x' || substr({c}, {i}, 2) AS INTEGER)" for i in (2, 4, 6)]
    top, low = f"greatest({r}, {g}, {b})", f"least({r}, {g}, {b})"
    half = f"(({top} + {low}) / 510.0)"
    return f"CASE WHEN {top} = {low} THEN 0 WHEN {half} > 0.5 THEN ({top} - {low}) / (510.0 - {top} - {low}) ELSE ({top} - {low}) / CAST({top} + {low} AS DOUBLE) END"


@query(f"""WITH {MANY}, c AS (SELECT image, rgb, sum(n) AS n FROM px GROUP BY ALL), s AS (SELECT image, rgb, n / sum(n) OVER (PARTITION BY image) AS share FROM c), g AS (SELECT *, CASE WHEN image <> '4' THEN '#0a3c0a' END AS ground FROM s),
v AS (SELECT *, {lum('rgb')} AS a, {lum('ground')} AS b, {hsl_sql('rgb')} AS sat, greatest({', '.join(f"abs(CAST('0x' || substr(rgb, {i}, 2) AS INTEGER) - CAST('0x' || substr(ground, {i}, 2) AS INTEGER))" for i in (2, 4, 6))}) AS away FROM g WHERE ground IS NOT NULL AND rgb <> ground),
text AS (SELECT image, rgb, round((greatest(a, b) + 0.05) / (least(a, b) + 0.05), 4) AS value FROM v QUALIFY row_number() OVER (PARTITION BY image ORDER BY value DESC, rgb) = 1),
accent AS (SELECT image, rgb, round(sat, 4) AS value FROM v ANTI JOIN text USING (image, rgb) WHERE round(sat, 4) > 0.15 QUALIFY row_number() OVER (PARTITION BY image ORDER BY value DESC, rgb) = 1),
surface AS (SELECT image, rgb, share AS value FROM v ANTI JOIN text USING (image, rgb) ANTI JOIN accent USING (image, rgb) WHERE away <= 24 AND share >= 0.001 QUALIFY row_number() OVER (PARTITION BY image ORDER BY value DESC, rgb) = 1)
SELECT image, 'refused' AS role, NULL AS rgb, NULL AS value FROM g WHERE ground IS NULL GROUP BY image UNION ALL SELECT DISTINCT image, 'background', ground, 1.0 FROM g WHERE ground IS NOT NULL UNION ALL SELECT image, 'text', rgb, value FROM text UNION ALL SELECT image, 'accent', rgb, value FROM accent UNION ALL SELECT image, 'surface', rgb, value FROM surface""")
def named_colours(spark, sf_dir):
    c = many_pixels(spark, sf_dir).groupBy("image", "rgb").agg(F.sum("n").alias("n"))
    total = c.groupBy("image").agg(F.sum("n").alias("all"))
    shares = c.join(total, "image").select("image", "rgb", (F.col("n") / F.col("all")).alias("share"), F.when(F.col("image") != "4", "#0a3c0a").alias("ground"))
    return styles.name_tokens(shares, surface_share=0.001)


@query(f"WITH {PIXELS}, c AS (SELECT image, rgb, sum(n) AS n FROM px GROUP BY ALL) SELECT image, rgb AS ground FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY n DESC, rgb) AS r FROM c) WHERE r = 1")
def page_ground(spark, sf_dir):
    return styles.page_ground(pixels(spark, sf_dir))


@query("""WITH r AS (SELECT user_id AS image, event_id AS y, event_type <> 'purchase' AS empty FROM events), m AS (SELECT *, CASE WHEN empty <> lag(empty) OVER (PARTITION BY image ORDER BY y) THEN 1 ELSE 0 END AS c FROM r), g AS (SELECT *, sum(c) OVER (PARTITION BY image ORDER BY y ROWS UNBOUNDED PRECEDING) AS run FROM m),
l AS (SELECT image, run, count(*) AS length FROM g WHERE empty AND run > 0 GROUP BY ALL), n AS (SELECT image, length, count(*) AS n FROM l GROUP BY ALL)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY image ORDER BY n DESC, length DESC) AS INTEGER) AS rank FROM n) WHERE rank <= 6""")
def rhythm_gaps(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("image"), F.col("event_id").alias("y"), (F.col("event_type") != "purchase").alias("empty"))
    return styles.rhythm_gaps(rows)


# parity, guards, surveys

@query("""WITH k AS (SELECT DISTINCT CAST(n_chars % 5 AS VARCHAR) AS repo, lang AS language, source AS key FROM documents), l AS (SELECT DISTINCT repo, language FROM k)
SELECT repo, language, key FROM (SELECT DISTINCT repo, key FROM k) JOIN l USING (repo) EXCEPT SELECT repo, language, key FROM k""")
def locale_parity(spark, sf_dir):
    keys = table(spark, sf_dir, "documents").select((F.col("n_chars") % 5).cast("string").alias("repo"), F.col("lang").alias("language"), F.concat("source", F.lit("_one")).alias("key"))
    return quality.locale_parity(keys)


@query("""WITH b AS (SELECT source AS repo, count(l.doc_id) AS considered, sum(toxic) AS c FROM documents d LEFT JOIN labels l USING (doc_id) WHERE lang = 'es' OR l.doc_id IS NULL GROUP BY source)
SELECT repo, CASE WHEN c IS NOT NULL AND considered > 0 THEN CAST(c AS BIGINT) END AS value, CAST(considered AS BIGINT) AS considered, CASE WHEN c IS NULL THEN 'not run' WHEN considered = 0 THEN 'nothing to look at' END AS why FROM b""")
def guarded_toxic_counts(spark, sf_dir):
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "toxic", F.lit(1).alias("there"))
    b = d.join(lab, "doc_id", "left").filter("lang = 'es' or there is null").groupBy(F.col("source").alias("repo")).agg(F.count("there").alias("considered"), F.sum("toxic").alias("c"))
    return quality.denominator_guard(b, "c", "considered").select("repo", "value", "considered", "why")


@query("""WITH r AS (SELECT CAST(l_suppkey AS VARCHAR) AS repo, CAST(l_linenumber AS VARCHAR) AS metric, count(*) FILTER (l_returnflag = 'R') AS c, count(*) FILTER (l_linestatus = 'F') AS considered FROM lineitem GROUP BY ALL)
SELECT repo, metric, 'counted over nothing' AS finding FROM r WHERE c > 0 AND considered = 0 UNION ALL SELECT repo, metric, 'share outside 0 to 1' FROM r WHERE 2.0 * c / nullif(considered, 0) > 1 UNION ALL SELECT repo, metric, 'more than were looked at' FROM r WHERE c > considered""")
def suspicious_results(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("repo"), F.col("l_linenumber").cast("string").alias("metric")).agg(F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("count"), F.count(F.when(F.col("l_linestatus") == "F", 1)).alias("considered"))
    return quality.suspicious(r.withColumn("share", 2.0 * F.col("count") / F.when(F.col("considered") > 0, F.col("considered"))).withColumn("why", F.lit(None).cast("string")))


@query(f"""WITH {OBS}, {summary_sql('obs', 's')}, f AS (SELECT source AS repo, count(*) FILTER (contains(lower(text), 'licen')) AS n FROM documents GROUP BY source)
SELECT s.repo, s.share, f.n FROM s JOIN f USING (repo) WHERE dimension = 'licence' AND dominant = 'absent' AND verdict = 'convention' AND n > 0""")
def cross_pass(spark, sf_dir):
    s = D.summarise(D.counts(doc_observations(spark, sf_dir)))
    f = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("repo")).agg(F.count(F.when(F.lower("text").contains("licen"), 1)).alias("n"))
    return quality.cross_pass(s, f, "licence", "absent")


@query("""SELECT source AS repo, count(*) AS documents, count(*) FILTER (contains(text, 'token = "')) AS secrets, CAST(sum(toxic) AS BIGINT) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source""")
def survey(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("repo", F.col("source"))
    t = d.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("repo").agg(F.sum("toxic").cast("long").alias("value"))
    s = d.groupBy("repo").agg(F.count(F.when(F.col("text").contains('token = "'), 1)).alias("value"))
    return quality.survey({"documents": d.groupBy("repo").agg(F.count("*").alias("value")), "secrets": s, "toxic": t}, d)
