"""Queries on source text, over files that Spark makes from the stand-in tables, and over the style rules of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lineage import shared_folder, spread
from ..operators import conventions, distributions, graphs, quality, security
from ..sources import markup, readers
from .census import PAGES, page_files, table

Q: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# every part is a file; its number says how it is written

#: Remainder: text for each, by divisor.
WRITTEN = {
    3: {0: "import { X } from '@/lib/x'", 1: "import X from '../x'", 2: "import X from '@scope/x'"},
    2: {0: "export default X", 1: "export const Card = 1"},
    5: {0: "const handleClick = 1", 1: "const handleClose = 1", 2: "function handleOpen() {}", 3: "function onClick() {}"},
    7: {0: "color: var(--brand-color)", 1: "color: #a1b2c3", 2: "color: #abc"},
    4: {0: "gap: var(--space-2)", 1: "gap: 12px"},
    6: {0: "interface CardProps {", 1: "type CardProps = {"},
    8: {0: "<p>Save changes</p>", 1: "<p>{t('save')}</p>"},
    9: {0: "const Box = styled.div``", 1: "<Box sx={{ m: 1 }} />", 2: '<Box className="flex p-4" />'},
    11: {0: "@if (open) {", 1: '<b *ngIf="open"></b>'},
}
#: What the numbers mean, worked out without reading the text: dimension, and bucket by remainder.
MEANT = {
    "internal imports": (3, {0: "alias", 1: "relative"}), "component export": (2, {0: "default", 1: "named"}), "handler naming": (5, {0: "handle", 1: "handle", 2: "handle", 3: "on"}), "colour values": (7, {0: "tokens", 1: "literal hex", 2: "literal hex"}),
    "sizing values": (4, {0: "tokens", 1: "literal"}), "props declaration": (6, {0: "interface", 1: "type"}), "user-facing text": (8, {0: "literal in markup", 1: "translated"}), "styling": (9, {0: "styled", 1: "sx", 2: "utility classes"}), "template control flow": (11, {0: "blocks", 1: "directives"}),
    "test placement": (10, {0: "beside the code", 1: "separate folder"}), "file structure": (10, {**dict.fromkeys(range(2, 6), "flat"), **dict.fromkeys(range(6, 10), "folder with index")}),
}
FILES = "pf AS (SELECT CAST(p_size % 7 AS VARCHAR) AS repo, p_partkey AS k FROM part)"
OBSERVED = "ob AS (" + " UNION ALL ".join(f"SELECT repo, '{d}' AS dimension, '{b}' AS bucket FROM pf WHERE k % {n} = {r}" for d, (n, by) in MEANT.items() for r, b in by.items()) + "), co AS (SELECT repo, dimension, bucket, count(*) AS n FROM ob GROUP BY ALL)"


def code_files(spark, sf_dir):
    k = F.col("p_partkey")
    parts = [F.coalesce(*[F.when(k % n == r, F.lit(t)) for r, t in by.items()], F.lit("")) for n, by in WRITTEN.items()]
    path = F.when(k % 10 == 0, "src/Card.test.tsx").when(k % 10 == 1, "tests/Card.spec.tsx").when(k % 10 < 6, F.concat(F.lit("src/Card"), k.cast("string"), F.lit(".tsx"))).otherwise("src/Card/index.tsx")
    return table(spark, sf_dir, "part").select((F.col("p_size") % 7).cast("string").alias("repo"), path.alias("path"), F.concat_ws("\n", *parts).alias("content"))


@query(f"WITH {FILES}, {OBSERVED} SELECT * FROM co")
def file_conventions(spark, sf_dir):
    return distributions.counts(conventions.file_conventions(code_files(spark, sf_dir)))


CLAIMS = [("component export", "named", "named export"), ("component export", "default", "default export"), ("internal imports", "alias", "alias"), ("handler naming", "handle", r"\bhandle")]
LINES = {0: "Prefer named exports", 1: "Use default exports", 2: "Imports go through the alias", 3: "First use named exports, then the alias", 4: "Call handlers handleX"}


@query(f"""WITH {FILES}, {OBSERVED}, su AS (SELECT repo, dimension, arg_min(bucket, (-n, bucket)) AS dominant, round(max(n) / sum(n), 3) AS share, sum(n) AS total FROM co GROUP BY ALL),
ln AS (SELECT CAST(n_nationkey % 7 AS VARCHAR) AS repo, CAST(n_nationkey AS INTEGER) AS line, CASE n_nationkey % 5 {' '.join(f"WHEN {k} THEN '{v}'" for k, v in LINES.items())} END AS text FROM nation),
cl AS (SELECT * FROM (VALUES ('component export', 'named', 'named export'), ('component export', 'default', 'default export'), ('internal imports', 'alias', 'alias'), ('handler naming', 'handle', 'handle')) v(dimension, bucket, word)),
sa AS (SELECT repo, dimension, bucket, min(line) AS line, arg_min(text, line) AS text FROM ln JOIN cl ON contains(lower(text), word) WHERE NOT contains(text, 'First') GROUP BY ALL)
SELECT repo, dimension, bucket, line, text, dominant, share, CASE WHEN NOT (share >= 0.85 AND total >= 5) THEN 'decision' WHEN bucket = dominant THEN 'confirmation' ELSE 'contradiction' END AS state FROM sa JOIN su USING (repo, dimension)""")
def claimed_conventions(spark, sf_dir):
    k = F.col("n_nationkey")
    text = F.coalesce(*[F.when(k % 5 == i, F.lit(t)) for i, t in LINES.items()])
    lines = table(spark, sf_dir, "nation").select((k % 7).cast("string").alias("repo"), F.lit("CONTRACT.md").alias("file"), k.cast("int").alias("line"), text.alias("text"))
    summary = distributions.summarise(distributions.counts(conventions.file_conventions(code_files(spark, sf_dir))))
    return conventions.contradictions(lines, spark.createDataFrame(CLAIMS, "dimension string, bucket string, pattern string"), summary)


@query(rf"""WITH {PAGES}, s AS (SELECT repo, unnest(regexp_extract_all(content, '<style>([a-z]+\{{[a-z-]+:[^}}]+)\}}</style>', 1)) AS r FROM pg)
SELECT repo, split_part(r, '{{', 1) AS selector, split_part(split_part(r, '{{', 2), ':', 1) AS prop, split_part(split_part(r, '{{', 2), ':', 2) AS value, count(*) AS uses FROM s GROUP BY ALL""")
def css_rules(spark, sf_dir):
    return markup.css_declarations(page_files(spark, sf_dir)).groupBy("repo", "selector", "prop", "value").agg(F.count("*").alias("uses"))


@query(r"""WITH c AS (SELECT p_partkey AS clause, unnest(list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z]{5,}'))) AS w FROM part), d AS (SELECT DISTINCT p_type || '/' || p_brand AS component, lower(p_type || ' ' || p_name) AS t FROM part),
b AS (SELECT component, unnest(list_distinct(flatten(list(regexp_extract_all(t, '[a-z]{5,}'))))) AS w FROM d GROUP BY component), s AS (SELECT clause, component, count(*) AS shared FROM c JOIN b USING (w) GROUP BY ALL HAVING count(*) >= 2)
SELECT clause, component, shared FROM (SELECT *, row_number() OVER (PARTITION BY clause ORDER BY shared DESC, component) AS r FROM s) WHERE r = 1""")
def component_suggestions(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    described = p.select(F.concat("p_type", F.lit("/"), "p_brand").alias("component"), F.concat("p_type", F.lit(" "), "p_name").alias("d")).distinct()
    described = described.groupBy("component").agg(F.array_join(F.array_sort(F.collect_set("d")), " ").alias("description"))
    return conventions.component_suggestions(p.select(F.col("p_partkey").alias("clause"), F.concat("p_name", F.lit(" "), "p_type").alias("text")), described)


@query("""WITH r AS (SELECT 'o' || o_orderkey AS repo, count(l_orderkey) AS sites FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT repo, 'a registry that nothing calls' AS finding FROM r WHERE sites = 0 UNION ALL SELECT DISTINCT CAST(c_nationkey AS VARCHAR), 'rules enforced too early' FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey % 3 = 0""")
def premature_findings(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    sites = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("sites"))
    registries = o.join(sites, "o_orderkey", "left").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("repo"), F.lit(1).alias("components"), "sites")
    rules = c.select(F.col("c_nationkey").cast("string").alias("repo"), F.when(F.col("c_mktsegment") == "BUILDING", "enforce").otherwise("advise").alias("standing"))
    modes = c.select(F.col("c_nationkey").cast("string").alias("repo"), F.when(F.col("c_nationkey") % 3 == 0, "too early").otherwise("mixed").alias("mode")).distinct()
    return quality.premature(registries, rules, modes)


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) AS size, p_brand AS brand, CAST(NULL AS VARCHAR) AS none FROM part")
def nested_values(spark, sf_dir):
    doc = F.to_json(F.struct(F.struct(F.col("p_size").alias("size"), F.struct(F.col("p_brand").alias("name")).alias("brand")).alias("part")))
    return table(spark, sf_dir, "part").select("p_partkey", *[conventions.json_value(doc, p).alias(n) for n, p in (("size", "part/size"), ("brand", "/part/brand/name"), ("none", "part/nothing/there"))])


@query("SELECT source AS repo, CAST(doc_id AS VARCHAR) AS path, sha256(text) AS sha256 FROM documents")
def file_fingerprints(spark, sf_dir):
    return readers.fingerprint(table(spark, sf_dir, "documents").select(F.col("source").alias("repo"), F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content")))


@query("""SELECT o_orderstatus AS repo, 'all' AS pass, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY ALL UNION ALL SELECT 'F', 'again', count(*) FILTER (o_orderstatus = 'F') FROM orders""")
def artifacts_replaced(spark, sf_dir):
    """An artifact of all repos, then one of a single repo: only that one is replaced."""
    folder, o = shared_folder(spark), table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "repo")
    count = lambda rows, name: rows.groupBy("repo").agg(F.lit(name).alias("pass"), F.count("*").alias("n"))
    readers.write_artifact(count(o, "all"), folder, "orders")
    readers.write_artifact(count(o.filter("repo = 'F'"), "again"), folder, "orders")
    return spark.read.schema("pass string, n long, repo string").parquet(f"{folder}/orders").select("repo", "pass", "n")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT event_type, count(*) AS n FROM events WHERE value > 50 GROUP BY ALL")
def evidence_appended(spark, sf_dir):
    folder, e = f"{shared_folder(spark)}/evidence", table(spark, sf_dir, "events")
    for rows in (e, e.filter("value > 50")):
        readers.append_evidence(rows.groupBy("event_type").agg(F.count("*").alias("n")), folder)
    return spark.read.schema("event_type string, n long").parquet(folder)


@query("""WITH m AS (SELECT CAST(p_size % 7 AS VARCHAR) AS repo, p_partkey AS k FROM part), t AS (SELECT repo, k, k * 7 % 2003 AS to FROM m)
SELECT t.repo, 'src/m' || t.k || '.ts' AS src, CASE t.k % 3 WHEN 0 THEN './m' WHEN 1 THEN '@/m' ELSE '~/m' END || t.to AS specifier, 'src/m' || t.to || CASE WHEN t.to % 4 = 0 THEN '.tsx' ELSE '.ts' END AS dst FROM (SELECT * FROM t WHERE k % 4 <> 0) t JOIN m ON m.repo = t.repo AND m.k = t.to
UNION ALL SELECT t.repo, 'src/m' || t.k || '.tsx', CASE t.k % 3 WHEN 0 THEN './m' WHEN 1 THEN '@/m' ELSE '~/m' END || t.to, 'src/m' || t.to || CASE WHEN t.to % 4 = 0 THEN '.tsx' ELSE '.ts' END FROM (SELECT * FROM t WHERE k % 4 = 0) t JOIN m ON m.repo = t.repo AND m.k = t.to""")
def resolved_imports(spark, sf_dir):
    k = F.col("p_partkey")
    path = F.concat(F.lit("src/m"), k.cast("string"), F.when(k % 4 == 0, ".tsx").otherwise(".ts"))
    base = F.when(k % 3 == 0, "./m").when(k % 3 == 1, "@/m").otherwise("~/m")
    text = F.concat(F.lit("import x from '"), base, (k * 7 % 2003).cast("string"), F.lit("'\n"))
    part = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    files = part.select((F.col("p_size") % 7).cast("string").alias("repo"), path.alias("path"), text.alias("content"))
    return graphs.resolve_imports(graphs.import_edges(files), files)


@query("""WITH e AS (SELECT CAST(o_custkey % 9 AS VARCHAR) AS repo, CASE o_orderkey % 3 WHEN 0 THEN 'app/.env' WHEN 1 THEN '.env.example' ELSE 'env.ts' END AS path, o_orderkey FROM orders) SELECT repo, path, count(*) AS files, 'KEY,MODE' AS keys FROM e WHERE path = 'app/.env' GROUP BY ALL""")
def committed_environments(spark, sf_dir):
    k = F.col("o_orderkey")
    path = F.when(k % 3 == 0, "app/.env").when(k % 3 == 1, ".env.example").otherwise("env.ts")
    files = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 9).cast("string").alias("repo"), path.alias("path"), F.concat(F.lit("# x\nKEY="), k.cast("string"), F.lit("\nexport MODE=on\nNONE=\n")).alias("content"))
    return security.committed_env(files).groupBy("repo", "path", F.array_join("keys", ",").alias("keys")).agg(F.count("*").alias("files"))
