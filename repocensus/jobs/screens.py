"""Queries on screens, interfaces, families, specs and images, over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.shares import share
from ..operators import ledger, retrieval, screens
from .census import COLOURS, part_colours, table

Q: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


STATE_WORDS = {"loading": r"\b(the|les)\b", "error": r"\b(this|des)\b", "empty": r"\b(was|une)\b"}


@query(r"""WITH s AS (SELECT source AS repo, regexp_matches(text, '\b(the|les)\b') AS loading, regexp_matches(text, '\b(this|des)\b') AS error, regexp_matches(text, '\b(was|une)\b') AS empty, round((doc_id % 7) / nullif(doc_id % 7 + doc_id % 5, 0), 3) AS system FROM documents),
m AS (SELECT repo, system, row_number() OVER (PARTITION BY repo ORDER BY system) AS r, count(*) OVER (PARTITION BY repo) AS n FROM s WHERE system IS NOT NULL)
SELECT s.repo, count(*) AS screens, round(avg(CAST(loading AS INTEGER)), 3) AS loading, round(avg(CAST(error AS INTEGER)), 3) AS error, round(avg(CAST(empty AS INTEGER)), 3) AS empty, round(avg(CAST(loading AND error AND empty AS INTEGER)), 3) AS all_states, count(*) FILTER (system < 0.3) AS hand_written, (SELECT max(system) FROM m WHERE m.repo = s.repo AND r = floor(n / 2) + 1) AS system_median FROM s GROUP BY s.repo""")
def screen_states(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("repo"), F.col("doc_id").alias("path"), F.col("text").alias("content"), (F.col("doc_id") % 7).alias("uses"), (F.col("doc_id") % 5).alias("raw"))
    return screens.screen_states(d, STATE_WORDS)


@query("""WITH c AS (SELECT p_brand AS library, p_name AS component, count(*) AS props, count(*) FILTER (p_size > 25) AS booleans FROM part GROUP BY ALL), m AS (SELECT library, props, row_number() OVER (PARTITION BY library ORDER BY props) AS r, count(*) OVER (PARTITION BY library) AS n FROM c)
SELECT c.library, count(*) AS components, count(*) FILTER (booleans >= 4) AS boolean_explosion, count(*) FILTER (props >= 15) AS god_components, (SELECT max(props) FROM m WHERE m.library = c.library AND r = floor(n / 2) + 1) AS median_props FROM c GROUP BY c.library""")
def component_api(spark, sf_dir):
    c = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("library"), F.col("p_name").alias("component")).agg(F.count("*").alias("props"), F.count(F.when(F.col("p_size") > 25, 1)).alias("booleans"))
    return screens.component_api(c)


@query("""SELECT p_name AS region, count(DISTINCT p_brand) AS products, count(DISTINCT p_size) AS frames, CASE WHEN (SELECT count(DISTINCT p_brand) FROM part) >= 2 THEN CASE WHEN count(DISTINCT p_brand) > 1 THEN 'portable' ELSE 'local' END END AS reach FROM part GROUP BY p_name""")
def regions_reach(spark, sf_dir):
    return screens.regions_reach(table(spark, sf_dir, "part").select(F.col("p_brand").alias("product"), F.col("p_size").alias("frame"), F.col("p_name").alias("region")))


@query("""WITH k AS (SELECT CAST(o_custkey % 20 AS VARCHAR) AS repo, CASE WHEN o_orderstatus = 'P' THEN 'norender' WHEN o_orderkey % 5 = 0 THEN 'plumbing' WHEN o_orderpriority <> '5-LOW' THEN 'framed' ELSE 'unframed' END AS kind FROM orders), c AS (SELECT repo, kind, count(*) AS n FROM k GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY repo), 3) AS share FROM c""")
def screen_archetypes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).cast("string").alias("repo"), F.col("o_orderkey").alias("path"), (F.col("o_orderstatus") != "P").alias("renders"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("shell"), (F.col("o_orderkey") % 5).alias("elements"))
    return screens.archetypes(o)


@query("""WITH c AS (SELECT source AS repo, lang AS ext, count(DISTINCT doc_id) AS files FROM documents GROUP BY ALL), o AS (SELECT repo, coalesce(sum(files) FILTER (ext = 'en'), 0) AS readable, coalesce(sum(files) FILTER (ext <> 'en'), 0) AS unread FROM c GROUP BY repo) SELECT repo, ext, files, unread > readable AS majority_unread FROM c JOIN o USING (repo) WHERE ext <> 'en'""")
def other_languages(spark, sf_dir):
    return screens.other_languages(table(spark, sf_dir, "documents").select(F.col("source").alias("repo"), F.col("lang").alias("ext"), F.col("doc_id").alias("path")), ["en"])


@query(r"""WITH e AS (SELECT regexp_extract(url, '[.](com|net|org)(/|$)', 1) AS repo, unnest(regexp_extract_all(html, 'class="([^"]*)"', 1)) AS class FROM pages), u AS (SELECT repo, unnest(list_distinct(string_split_regex(trim(class), '\s+'))) AS c FROM e), k AS (SELECT repo, CASE WHEN regexp_matches(c, '^[a-h]') THEN 'early' WHEN regexp_matches(c, '^[i-z]') THEN 'late' END AS kind, c, count(*) AS n FROM u WHERE c <> '' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY repo, kind ORDER BY n DESC, c) AS i, CAST(sum(n) OVER (PARTITION BY repo, kind) AS BIGINT) AS "of" FROM k WHERE kind IS NOT NULL) SELECT repo, kind, c AS class, n, "of" FROM r WHERE i = 1 AND n >= 2""")
def utility_classes(spark, sf_dir):
    e = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "[.](com|net|org)(/|$)", 1).alias("repo"), F.explode(F.regexp_extract_all("html", F.lit('class="([^"]*)"'), F.lit(1))).alias("class"))
    return screens.utility_classes(e, {"early": "^[a-h]", "late": "^[i-z]"})


@query(r"""WITH s AS (SELECT CAST(p_size % 5 AS VARCHAR) AS repo, p_brand AS file, 'b' || regexp_replace(lower(p_name), ' .*', '') AS base, p_size % 3 AS declarations, CASE WHEN p_partkey % 3 = 0 THEN lower(p_type) END AS variant, CASE WHEN p_partkey % 3 = 1 AND p_size > 40 THEN 'hover' END AS state FROM part),
b AS (SELECT repo, base, coalesce(string_agg(DISTINCT variant, ',' ORDER BY variant), '') AS variants, coalesce(string_agg(DISTINCT state, ',' ORDER BY state), '') AS states, CAST(sum(declarations) AS BIGINT) AS declarations, count(DISTINCT file) AS files FROM s GROUP BY ALL)
SELECT *, CASE WHEN declarations < 4 AND variants = '' AND states = '' THEN 'utility' ELSE 'component' END AS kind FROM b""")
def css_families(spark, sf_dir):
    k = F.col("p_partkey")
    tail = F.when(k % 3 == 0, F.concat(F.lit("--"), F.lower("p_type"))).when((k % 3 == 1) & (F.col("p_size") > 40), F.lit(":hover")).otherwise(F.lit(""))
    s = table(spark, sf_dir, "part").select((F.col("p_size") % 5).cast("string").alias("repo"), F.col("p_brand").alias("file"), F.concat(F.lit(".b"), F.regexp_replace(F.lower("p_name"), " .*", ""), tail).alias("selector"), (F.col("p_size") % 3).alias("declarations"))
    return screens.css_families(s).withColumn("variants", F.array_join("variants", ",")).withColumn("states", F.array_join("states", ","))


CANON = f"{COLOURS}, cc AS (SELECT CAST(p_size % 3 AS VARCHAR) AS source, CASE WHEN p_partkey % 2 = 0 THEN fg ELSE bg END AS hex, count(*) AS uses FROM col WHERE p_partkey % 5 > 0 GROUP BY ALL)"


def canon(spark, sf_dir):
    c = part_colours(spark, sf_dir)
    k = F.col("p_partkey")

    def rgb(c):
        return F.concat(F.lit("rgb("), F.concat_ws(", ", *[F.conv(F.substring(c, i, 2), 16, 10) for i in (2, 4, 6)]), F.lit(")"))

    colour = F.when(k % 5 == 0, "none").when(k % 2 == 0, F.upper("fg")).otherwise(rgb(F.col("bg")))
    return screens.canonical_colours(c.select((F.col("p_size") % 3).cast("string").alias("source"), colour.alias("colour"), F.lit(1).alias("uses")))


@query(f"WITH {CANON} SELECT * FROM cc")
def canonical_colours(spark, sf_dir):
    return canon(spark, sf_dir)


@query(f"WITH {CANON} SELECT hex, count(DISTINCT source) AS sources, CAST(sum(uses) AS BIGINT) AS uses, CASE WHEN count(DISTINCT source) = (SELECT count(DISTINCT source) FROM cc) THEN 'agreed' ELSE 'disputed' END AS state FROM cc GROUP BY hex")
def source_agreement(spark, sf_dir):
    return screens.source_agreement(canon(spark, sf_dir))


@query("""WITH d AS (SELECT CAST(l_suppkey % 8 AS VARCHAR) AS repo, CASE WHEN l_linestatus = 'F' THEN 'gap' ELSE 'padding' END AS prop, '--s' || l_linenumber AS token, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY repo, prop ORDER BY n DESC, token) AS i, sum(n) OVER (PARTITION BY repo, prop) AS total FROM d) SELECT repo, prop, token, round(n / total, 3) AS share FROM r WHERE i = 1""")
def spacing_rhythm(spark, sf_dir):
    value = F.when(F.col("l_returnflag") != "R", F.concat(F.lit("var(--s"), F.col("l_linenumber").cast("string"), F.lit(")"))).otherwise("4px")
    return screens.rhythm(table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 8).cast("string").alias("repo"), F.when(F.col("l_linestatus") == "F", "gap").otherwise("padding").alias("prop"), value.alias("value")))


@query("""WITH e AS (SELECT o_orderkey AS spec, CAST(o_custkey % 9 AS VARCHAR) AS role, CASE WHEN o_orderkey % 4 > 0 THEN 'size' END AS axis, CASE WHEN o_orderkey % 4 > 0 THEN o_orderstatus END AS value FROM orders)
SELECT spec, 'z' AS zone, 0 AS pos, role, axis, value, CASE WHEN role <> '8' THEN 'C' || role END AS component, CASE WHEN role = '8' THEN 'no binding' WHEN role = '7' THEN 'no component' WHEN axis IS NOT NULL AND role = '6' THEN 'axis not bound' WHEN axis IS NOT NULL AND role = '5' THEN 'no prop' WHEN axis IS NOT NULL AND role < '3' AND value = 'P' THEN 'no such value' END AS problem FROM e""")
def resolve_spec(spark, sf_dir):
    k = F.col("o_orderkey") % 4 > 0
    e = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("spec"), F.lit("z").alias("zone"), F.lit(0).alias("pos"), (F.col("o_custkey") % 9).cast("string").alias("role"), F.when(k, "size").alias("axis"), F.when(k, F.col("o_orderstatus")).alias("value"))
    b = spark.createDataFrame([(str(i), f"C{i}", None if i == 6 else "size", None if i == 6 else "s") for i in range(8)], "role string, component string, axis string, prop string")
    r = spark.createDataFrame([(f"C{i}", "t" if i in (5, 6) else "s", ["F", "O"] if i < 3 else None) for i in range(7)], "component string, prop string, values array<string>")
    return screens.resolve_spec(e, b, r)


@query("""WITH b AS (SELECT DISTINCT p_brand AS role, p_type AS component FROM part WHERE p_size < 25), r AS (SELECT DISTINCT p_type AS component FROM part WHERE p_retailprice < 905), v AS (SELECT DISTINCT 'Brand#' || i AS role FROM (SELECT unnest(generate_series(3, 40)) AS i))
SELECT DISTINCT role, 'unknown role' AS problem FROM b WHERE role NOT IN (SELECT role FROM v) UNION ALL SELECT role, 'unknown component' FROM b WHERE component NOT IN (SELECT component FROM r) UNION ALL SELECT role, 'not bound' FROM v WHERE role NOT IN (SELECT role FROM b)""")
def validate_bindings(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    roles = spark.range(3, 41).select(F.concat(F.lit("Brand#"), F.col("id").cast("string")).alias("role"))
    return screens.validate_bindings(p.filter("p_size < 25").select(F.col("p_brand").alias("role"), F.col("p_type").alias("component")), p.filter("p_retailprice < 905").select(F.col("p_type").alias("component")), roles)


@query(r"""SELECT source AS repo, doc_id AS path, concat_ws(',', CASE WHEN regexp_matches(text, '\bwith\b') THEN 'a' END, CASE WHEN regexp_matches(text, '[|]') THEN 'b' END) AS signals FROM documents WHERE regexp_matches(text, '\bwith\b') OR regexp_matches(text, '[|]')""")
def behavioural_files(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("repo"), F.col("doc_id").alias("path"), F.col("text").alias("content"))
    return screens.behaviours(d, {"a": r"\bwith\b", "b": "[|]"}).withColumn("signals", F.array_join("signals", ","))


@query("""WITH c AS (SELECT DISTINCT CAST(o_custkey % 6 AS VARCHAR) AS repo, 'N' || (o_orderkey % 400) AS name FROM orders WHERE o_orderstatus = 'F'), t AS (SELECT DISTINCT CAST(o_custkey % 6 AS VARCHAR) AS repo, 'N' || (o_orderkey % 400) AS name FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 3 = 0 UNION SELECT DISTINCT CAST(o_custkey % 6 AS VARCHAR), 'N' || (o_custkey % 400) FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 3 = 0) SELECT * FROM c EXCEPT SELECT * FROM t""")
def untested_behaviour(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("repo", (F.col("o_custkey") % 6).cast("string")).withColumn("name", F.concat(F.lit("N"), (F.col("o_orderkey") % 400).cast("string")))
    text = F.concat(F.lit("jest.mock('./N1')\nimport { x } from '../src/N"), (F.col("o_custkey") % 400).cast("string"), F.lit(".tsx'"))
    tests = o.filter("o_orderstatus = 'O' and o_orderkey % 3 = 0").select("repo", F.concat(F.lit("a/"), "name", F.lit(".test.tsx")).alias("path"), text.alias("content"))
    return screens.untested_behaviour(o.filter("o_orderstatus = 'F'").select("repo", "name").distinct(), tests)


@query("""SELECT CAST(p_size % 4 AS VARCHAR) AS repo, count(*) AS components, count(*) FILTER (p_partkey % 3 = 0) AS covered, round(count(*) FILTER (p_partkey % 3 = 0) / count(*), 3) AS share FROM part GROUP BY ALL""")
def example_coverage(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("repo", (F.col("p_size") % 4).cast("string")).withColumn("stem", F.concat(F.lit("ui/C"), F.col("p_partkey").cast("string")))
    modules = p.filter("p_partkey % 3 < 2").select("repo", F.concat("stem", F.lit(".example.tsx")).alias("path"), F.when(F.col("p_partkey") % 3 == 0, "export const BasicExample = 1").otherwise("nothing").alias("content"))
    return screens.example_coverage(p.select("repo", F.concat("stem", F.lit(".tsx")).alias("path")), modules)


@query("""WITH s AS (SELECT 'b' || p_size % 20 AS component, p_name || ' ' || p_type AS snippet, p_partkey % 2 = 0 AS authored, p_size % 7 AS props FROM part), r AS (SELECT component, snippet, CAST(authored AS INTEGER) * 1000000 + props * 100 - length(snippet) / 10 AS rank FROM s)
SELECT component, snippet, round(rank, 1) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY rank DESC, snippet) AS i FROM r) WHERE i = 1""")
def best_example(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("b"), (F.col("p_size") % 20).cast("string")).alias("component"), F.concat_ws(" ", "p_name", "p_type").alias("snippet"), (F.col("p_partkey") % 2 == 0).alias("authored"), (F.col("p_size") % 7).alias("props"))
    return screens.best_example(p)


@query("""WITH c AS (SELECT s_nationkey AS library, s_name AS component, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey END AS sites, CASE WHEN s_suppkey % 3 = 1 THEN s_suppkey % 10 END AS in_degree, CAST(7 AS BIGINT) AS substance FROM supplier), w AS (SELECT *, coalesce(sites, in_degree, substance, 0) AS weight FROM c) SELECT *, CAST(row_number() OVER (PARTITION BY library ORDER BY weight DESC, component) AS INTEGER) AS position FROM w""")
def worksheet(spark, sf_dir):
    k = F.col("s_suppkey")
    return screens.worksheet(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("library"), F.col("s_name").alias("component"), F.when(k % 3 == 0, k).alias("sites"), F.when(k % 3 == 1, k % 10).alias("in_degree"), F.lit(7).cast("long").alias("substance")))


@query("""WITH d AS (SELECT DISTINCT p_name AS name, p_brand AS repo FROM part), r AS (SELECT DISTINCT p_name AS component FROM part WHERE p_size > 45) SELECT name, repo FROM d WHERE name IN (SELECT component FROM r)""")
def shadowed_components(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return screens.shadowing(p.select(F.col("p_name").alias("name"), F.col("p_brand").alias("repo")).distinct(), p.filter("p_size > 45").select(F.col("p_name").alias("component")))


@query("SELECT DISTINCT p_name AS component FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_partkey % 30 = 0)")
def unconsumed_components(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("component"))
    return screens.unconsumed(p, p.filter("p_partkey % 30 = 0"))


@query("""WITH m AS (SELECT s_suppkey AS repo, CAST(s_nationkey % 3 AS VARCHAR) AS kind, s_suppkey % 900 + 400 AS width, ['g' || s_suppkey % 4] AS grounds FROM supplier), r AS (SELECT * FROM (VALUES ('0', 600, ['g0', 'g1']), ('1', 800, ['g2'])) v(kind, ref_width, ref_grounds)), j AS (SELECT repo, kind, width, ref_width, abs(width - ref_width) > 160 AS column_differs, NOT list_has_any(grounds, ref_grounds) AS ground_differs FROM m JOIN r USING (kind)) SELECT * FROM j WHERE column_differs OR ground_differs""")
def reference_layout(spark, sf_dir):
    k = F.col("s_suppkey")
    m = table(spark, sf_dir, "supplier").select(k.alias("repo"), (F.col("s_nationkey") % 3).cast("string").alias("kind"), (k % 900 + 400).alias("width"), F.array(F.concat(F.lit("g"), (k % 4).cast("string"))).alias("grounds"))
    return screens.reference_layout(m, spark.createDataFrame([("0", 600, ["g0", "g1"]), ("1", 800, ["g2"])], "kind string, width int, grounds array<string>"))


@query("""SELECT CAST(l_suppkey % 9 AS VARCHAR) AS image, CAST(min(l_orderkey % 1000) AS BIGINT) AS "left", CAST(max(l_orderkey % 1000) AS BIGINT) AS "right" FROM lineitem WHERE l_returnflag = 'A' AND l_quantity = 50 GROUP BY ALL""")
def reading_column(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    px = li.select((F.col("l_suppkey") % 9).cast("string").alias("image"), (F.col("l_orderkey") % 1000).alias("x"), F.when((F.col("l_returnflag") == "A") & (F.col("l_quantity") == 50), "#202020").otherwise("#f0f0f1").alias("rgb"))
    return screens.reading_column(px, px.select("image").distinct().withColumn("ground", F.lit("#f0f0f0")))


@query("""WITH p AS (SELECT o_custkey % 30 AS image, o_orderkey AS x, 0 AS y, CASE WHEN o_orderstatus = 'P' AND o_custkey % 2 = 0 THEN 1 ELSE 0 END AS moved FROM orders), b AS (SELECT image, count(*) AS n, sum(moved) AS m FROM p GROUP BY image)
SELECT image, CASE WHEN image % 5 > 0 THEN CASE WHEN image % 7 = 1 THEN round((m - CASE WHEN (SELECT arg_max(moved, x) FROM p WHERE p.image = b.image) = 1 THEN 1 ELSE 0 END) / n, 4) ELSE round(m / n, 4) END END AS ratio, CASE WHEN image % 5 = 0 THEN 'recorded' WHEN image % 7 = 1 THEN 'resized' WHEN m / n > 0.001 THEN 'changed' ELSE 'same' END AS state FROM b""")
def image_diff(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 30).alias("image"), F.col("o_orderkey").alias("x"), F.lit(0).alias("y"), ((F.col("o_orderstatus") == "P") & (F.col("o_custkey") % 2 == 0)).alias("moved"))
    last = o.groupBy("image").agg(F.max("x").alias("x")).filter("image % 7 = 1")
    before = o.filter("image % 5 > 0").join(last, ["image", "x"], "left_anti").select("image", "x", "y", F.lit("#000000").alias("rgb"))
    after = o.select("image", "x", "y", F.when(F.col("moved"), "#ffffff").otherwise("#000000").alias("rgb"))
    return screens.image_diff(before, after)


@query("""WITH a AS (SELECT source AS repo, CASE WHEN contains(text, chr(10)) THEN 'several lines' ELSE 'one line' END AS answer, count(*) AS n FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n DESC, answer) AS i, CAST(sum(n) OVER (PARTITION BY repo) AS BIGINT) AS total FROM a) SELECT repo, answer, n, round(n / total, 3) AS share, total FROM r WHERE i = 1""")
def idiom_majority(spark, sf_dir):
    return screens.idiom(table(spark, sf_dir, "documents").withColumn("repo", F.col("source")), F.when(F.col("text").contains("\n"), "several lines").otherwise("one line"))


@query("""WITH r AS (SELECT o_custkey % 50 AS task, o_orderkey % 10 = 0 AS is_ref, CAST(o_totalprice AS BIGINT) % 101 AS score FROM orders), f AS (SELECT task, max(score) AS reference FROM r WHERE is_ref GROUP BY task), b AS (SELECT r.task, count(*) AS breaks, count(*) FILTER (score < reference) AS caught, max(reference) AS reference FROM r LEFT JOIN f USING (task) WHERE NOT is_ref GROUP BY r.task) SELECT *, round(caught / breaks, 3) AS share, reference >= 95 AS reference_ok FROM b""".replace("CAST(o_totalprice AS BIGINT)", "CAST(floor(o_totalprice) AS BIGINT)"))
def discrimination(spark, sf_dir):
    r = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("task"), (F.col("o_orderkey") % 10 == 0).alias("is_reference"), (F.floor("o_totalprice") % 101).alias("score"))
    return ledger.discrimination(r)


@query("SELECT DISTINCT user_id, event_type FROM events")
def cases_once(spark, sf_dir):
    return ledger.record_once(table(spark, sf_dir, "events").select("user_id", "event_type"), ["user_id", "event_type"])


@query("""WITH c AS (SELECT conv_id * 100 + turn AS id, unnest(string_split_regex(lower(text), '[.;,]\\s*|\\s+and\\s+')) AS words, generate_subscripts(string_split_regex(lower(text), '[.;,]\\s*|\\s+and\\s+'), 1) - 1 AS clause FROM conversations), q AS (SELECT * FROM (VALUES ('list', 'the', 1), ('list', 'les', 2), ('action', 'ing', 1), ('action', 'ung', 2)) v(role, cue, rank))
SELECT id, CAST(clause AS INTEGER) AS clause, role, cue FROM (SELECT *, row_number() OVER (PARTITION BY id, clause, role ORDER BY rank) AS i FROM c JOIN q ON contains(words, cue)) WHERE i = 1""".replace("\\\\", "\\"))
def draft_roles(spark, sf_dir):
    r = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")
    return retrieval.draft_roles(r, spark.createDataFrame([("list", "the", 1), ("list", "les", 2), ("action", "ing", 1), ("action", "ung", 2)], "role string, cue string, rank int"))


@query("""SELECT CAST(l_suppkey % 10 AS VARCHAR) AS repo, round(count(*) FILTER (l_returnflag = 'A') / nullif(count(*) FILTER (l_returnflag <> 'R'), 0), 3) AS discipline FROM lineitem GROUP BY ALL""")
def query_discipline(spark, sf_dir):
    by = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 10).cast("string").alias("repo")).agg(F.count(F.when(F.col("l_returnflag") == "A", 1)).alias("a"), F.count(F.when(F.col("l_returnflag") != "R", 1)).alias("n"))
    return by.select("repo", share("a", "n").alias("discipline"))
