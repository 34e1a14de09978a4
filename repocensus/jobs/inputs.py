"""Queries on sources and sinks: the stand-in tables are written as registries, trees, logs and lists, and read by the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lineage import shared_folder
from ..operators import graphs, quality, retrieval, rules, security, styles
from ..sources import readers
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


def text(*parts):
    """Columns' names between braces and plain text, put together as one text."""
    return F.concat(*[F.coalesce(F.expr(p[1:-1]).cast("string"), F.lit("")) if p.startswith("<") else F.lit(p) for p in parts])


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS profile, path, name, value, type FROM supplier, LATERAL (SELECT * FROM (VALUES
('color.card', 'card', '#' || lpad(CAST(s_suppkey % 1000 AS VARCHAR), 3, '0'), 'color'), ('color.deep.edge', 'edge', '{color.card}', 'border'), ('gap', 'gap', CAST(s_nationkey AS VARCHAR) || 'px', NULL)) v(path, name, value, type)) WHERE s_suppkey % 5 <> 0""")
def token_leaves(spark, sf_dir):
    tree = text('{"color":{"$type":"color","card":{"$value":"#', "<lpad(cast(s_suppkey % 1000 as string), 3, '0')>", '"},"deep":{"edge":{"$type":"border","$value":"{color.card}"}}},"gap":"', "<s_nationkey>", 'px"}')
    json = F.when(F.col("s_suppkey") % 5 == 0, F.lit("{broken")).otherwise(tree)
    return readers.flatten_tokens(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("profile"), json.alias("json")))


@query("""WITH f AS (SELECT CAST(p_size % 7 AS VARCHAR) AS repo, CASE p_partkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'pt-BR' END AS language, p_brand FROM part)
SELECT DISTINCT repo, language, unnest(['menu.' || p_brand, 'menu.more.open', 'title']) AS key FROM f WHERE language IS NOT NULL""")
def locale_keys(spark, sf_dir):
    path = F.expr("case p_partkey % 4 when 0 then 'src/locales/en.json' when 1 then 'locales/de/common.json' when 2 then 'i18n/pt-BR.json' else 'package.json' end")
    files = table(spark, sf_dir, "part").select((F.col("p_size") % 7).cast("string").alias("repo"), path.alias("path"), text('{"menu":{"', "<p_brand>", '":"x","more":{"open":"y"}},"title":"', "<p_name>", '"}').alias("content"))
    return readers.read_locales(files)


@query("""SELECT CAST(o_custkey AS VARCHAR) AS repo, 'h' || o_orderkey AS hash, 'Author ' || o_custkey % 50 AS author, CASE WHEN o_orderkey % 11 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day, o_orderstatus AS signature,
CASE WHEN o_orderkey % 3 = 0 THEN 'Pair ' || o_orderkey % 9 || '/p@x.org,Bot/b@y.org' ELSE '' END AS co_authors FROM orders""")
def commit_records(spark, sf_dir):
    body = "<case when o_orderkey % 3 = 0 then concat('Fix\\n\\nCo-Authored-By: Pair ', o_orderkey % 9, ' <p@x.org>\\nco-authored-by: Bot <b@y.org>') else 'Fix' end>"
    day = "<case when o_orderkey % 11 = 0 then 'no date' else date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\") end>"
    record = text("h", "<o_orderkey>", "\x1f", "Author ", "<o_custkey % 50>", "\x1f", day, "\x1f", "<o_orderstatus>", "\x1f", body)
    logs = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("repo"), (F.col("o_orderkey") % 16).alias("part")).agg(F.array_join(F.collect_list(record), "\x1e").alias("log"))
    got = readers.read_commits(logs)
    people = F.array_join(F.transform("co_authors", lambda p: F.concat_ws("/", p["name"], p["email"])), ",")
    return got.select("repo", "hash", "author", F.date_format("date", "yyyy-MM-dd").alias("day"), "signature", people.alias("co_authors"))


AUDITED = """a AS (SELECT CAST(p_size AS VARCHAR) AS repo, 'pkg' || p_partkey AS package, CASE p_partkey % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'moderate' ELSE 'low' END AS severity, p_partkey % 3 = 0 AS direct, p_partkey % 7 <> 0 AS fix_available FROM part)"""


def audits(spark, sf_dir):
    """Each part is an audit of one package, in one of four shapes."""
    severity = "<case p_partkey % 5 when 0 then 'Critical' when 1 then 'high' when 2 then 'moderate' else 'low' end>"
    patched = "<if(p_partkey % 7 = 0, '<0.0.0', '>=2.0.0')>"
    path = "<if(p_partkey % 3 = 0, concat('pkg', p_partkey), concat('top>pkg', p_partkey))>"
    one = ['{"module_name":"pkg', "<p_partkey>", '","severity":"', severity, '","title":"t","patched_versions":"', patched, '","findings":[{"paths":["', path, '"]}]}']
    v7 = text('{"vulnerabilities":{"pkg', "<p_partkey>", '":{"severity":"', severity, '","isDirect":', "<p_partkey % 3 = 0>", ',"fixAvailable":', "<p_partkey % 7 <> 0>", ',"via":[{"title":"t"}]}}}')
    v6, plain = text('{"advisories":{"1":', *one, "}}"), text("[", *one, "]")
    yarn = text('{"type":"auditSummary","data":{}}\n{"type":"auditAdvisory","data":{"advisory":', *one, "}}")
    k = F.col("p_partkey") % 4
    return table(spark, sf_dir, "part").select(F.col("p_size").cast("string").alias("repo"), F.when(k == 0, v7).when(k == 1, v6).when(k == 2, yarn).otherwise(plain).alias("json"))


@query(f"WITH {AUDITED} SELECT *, 't' AS via FROM a")
def advisories_read(spark, sf_dir):
    return readers.read_audit(audits(spark, sf_dir)).withColumn("via", F.array_join("via", ","))


@query(f"WITH {AUDITED} SELECT repo, package, severity, direct, CAST(row_number() OVER (PARTITION BY repo ORDER BY direct DESC, severity <> 'critical', package) AS INTEGER) AS rank FROM a WHERE severity IN ('critical', 'high') QUALIFY rank <= 10")
def worst_advisories(spark, sf_dir):
    return security.worst_advisories(readers.read_audit(audits(spark, sf_dir))).select("repo", "package", "severity", "direct", "rank")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS spec, zone, pos, role, size, kind FROM part, LATERAL (SELECT * FROM (VALUES
('main', 0, 'list', CAST(p_size AS VARCHAR), p_brand), ('main', 1, 'filter', NULL, NULL), ('side', 0, 'card', 'small', NULL)) v(zone, pos, role, size, kind))""")
def spec_elements(spark, sf_dir):
    json = text('{"zones":[{"name":"main","elements":["list size=', "<p_size>", " kind=", "<p_brand>", '","filter"]},{"name":"side","elements":["card size=small"]}]}')
    got = readers.read_spec(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("spec"), json.alias("json")))
    return got.select("spec", "zone", "pos", "role", F.try_element_at("axes", F.lit("size")).alias("size"), F.try_element_at("axes", F.lit("kind")).alias("kind"))


def maps(spark, sf_dir):
    json = text('{"C', "<p_partkey>", '":{"level":"', "<p_type>", '","inherits":', "<p_partkey % 2 = 0>", ',"exports":["C', "<p_partkey>", 'Title"],"props":[{"name":"size","required":true,"values":["', "<p_size>", '","auto"]},{"name":"tone","type":"', "<p_brand>", '"}]}}')
    return readers.registry_rows(table(spark, sf_dir, "part").select(F.concat(F.lit("lib"), (F.col("p_size") % 7).cast("string")).alias("library"), json.alias("json")))


@query("""SELECT 'lib' || p_size % 7 AS library, 'C' || p_partkey AS component, p_type AS level, p_partkey % 2 = 0 AS inherits, 'C' || p_partkey || s AS export, s <> '' AS is_part FROM part, (VALUES (''), ('Title')) v(s)""")
def registry_components(spark, sf_dir):
    return maps(spark, sf_dir)[0].select("library", "component", "level", "inherits", "export", "is_part")


@query("""SELECT 'lib' || p_size % 7 AS library, 'C' || p_partkey AS component, prop, type, required, choices FROM part, LATERAL (SELECT * FROM (VALUES ('size', NULL, true, CAST(p_size AS VARCHAR) || '|auto'), ('tone', p_brand, false, NULL)) v(prop, type, required, choices))""")
def registry_props(spark, sf_dir):
    values = F.when(F.col("values").isNotNull(), F.array_join("values", "|"))
    return maps(spark, sf_dir)[1].select("library", "component", "prop", "type", F.coalesce("required", F.lit(False)).alias("required"), values.alias("choices"))


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS profile, id, name, type, 'light' AS mode, value, alias_of FROM supplier, LATERAL (SELECT * FROM (VALUES
('v1', 'card', 'COLOR', '#' || lpad(lower(to_hex(s_suppkey % 256)), 2, '0') || 'ff00', NULL), ('v2', 'gap', 'FLOAT', CAST(s_nationkey AS VARCHAR), NULL), ('v3', 'edge', 'COLOR', NULL, 'v1')) v(id, name, type, value, alias_of))""")
def exported_variables(spark, sf_dir):
    def variable(name, kind, *value):
        return [f'{{"name":"{name}","resolvedType":"{kind}","valuesByMode":{{"light":', *value, "}}"]

    colour = variable("card", "COLOR", '{"r":', "<cast(s_suppkey % 256 as double) / 255>", ',"g":1,"b":0}')
    json = text('{"variables":{"v1":', *colour, ',"v2":', *variable("gap", "FLOAT", "<s_nationkey>"), ',"v3":', *variable("edge", "COLOR", '{"type":"VARIABLE_ALIAS","id":"v1"}'), "}}")
    return readers.figma_variables(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("profile"), json.alias("json")))


@query("SELECT c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS sub FROM customer WHERE c_custkey % 7 <> 0")
def targets_read(spark, sf_dir):
    """Customers written as a tab-separated list with comments and empty lines, and read back."""
    folder = f"{shared_folder(spark)}/targets"
    line = F.expr("case when c_custkey % 7 = 0 then if(c_custkey % 2 = 0, '', concat('# ', c_name)) when c_custkey % 2 = 0 then concat(c_name, '\\t', c_mktsegment) else c_name end")
    table(spark, sf_dir, "customer").select(line.alias("value")).write.text(folder)
    return readers.read_targets(spark, folder)


@query("""SELECT 'repo=' || o_orderstatus AS repo, CASE o_orderkey % 3 WHEN 0 THEN 'fixture' WHEN 1 THEN 'excluded' ELSE 'in scope' END AS reason, count(*) AS lines FROM orders GROUP BY ALL""")
def corpus_scope(spark, sf_dir):
    """Orders written as text files in folders, read as a corpus; lines in scope and out of it."""
    folder = f"{shared_folder(spark)}/corpus"
    where = F.expr("case o_orderkey % 3 when 0 then 'fixtures' when 1 then 'vendor' else 'src' end")
    table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("repo"), where.alias("in"), F.col("o_orderpriority").alias("value")).write.partitionBy("repo", "in").option("maxRecordsPerFile", 100_000).text(folder)
    files = readers.read_corpus(spark, folder, ["txt"]).withColumn("path", F.regexp_replace("path", "^in=", ""))
    lines = F.length("content") - F.length(F.replace(F.col("content"), F.lit("\n")))
    return readers.scope(files, ["vendor/"]).groupBy("repo", F.coalesce("reason", F.lit("in scope")).alias("reason")).agg(F.sum(lines.cast("long")).alias("lines"))


@query("""WITH f AS (SELECT CAST(p_size % 7 AS VARCHAR) AS repo, p_partkey % 6 AS k FROM part), b AS (SELECT repo, CASE WHEN k IN (0, 5) THEN 'route' WHEN k = 1 THEN 'router' WHEN k = 2 THEN 'naming' END AS found_by FROM f) SELECT repo, found_by, count(*) AS files FROM b WHERE found_by IS NOT NULL GROUP BY ALL""")
def screens_found(spark, sf_dir):
    k, n = F.col("p_partkey") % 6, F.col("p_partkey").cast("string")
    path = F.coalesce(*[F.when(k == i, F.concat(F.lit(a), n, F.lit(b))) for i, (a, b) in enumerate([("src/a", ".ts"), ("src/pages/a", ".tsx"), ("src/A", "Page.tsx"), ("src/components/A", "View.tsx"), ("tests/A", "Page.tsx"), ("src/views/a", ".vue")])])
    files = table(spark, sf_dir, "part").select((F.col("p_size") % 7).cast("string").alias("repo"), path.alias("path"), k.alias("k"))
    return readers.is_screen(files, files.filter("k in (0, 5)")).groupBy("repo", "found_by").agg(F.count("*").alias("files"))


@query("""SELECT CAST(o_custkey AS VARCHAR) AS slot, count(DISTINCT o_orderpriority) AS targets, bool_or(o_orderstatus <> 'F') AS stale FROM orders GROUP BY ALL HAVING count(DISTINCT o_orderpriority) > 1 OR bool_or(o_orderstatus <> 'F')""")
def moved_targets(spark, sf_dir):
    return quality.moved_targets(table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("slot"), F.col("o_orderpriority").alias("target"), F.col("o_orderstatus").alias("rules"), F.lit("F").alias("now_rules")))


@query("""SELECT kind, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN p_partkey % 10 = 0 THEN 'no name' END, CASE WHEN p_partkey % 3 = 0 THEN 'no level' END, CASE WHEN p_partkey % 4 = 0 THEN 'no surface' END, CASE WHEN p_partkey % 10 = 1 THEN 'lower-case name' END, CASE WHEN p_size % 2 = 0 THEN 'a prop declared twice' END], lambda x: x IS NOT NULL)) AS kind FROM part) GROUP BY ALL""")
def profile_failures(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.when(k % 10 == 0, "").when(k % 10 == 1, F.concat(F.lit("card"), k.cast("string"))).otherwise(F.concat(F.lit("Card"), k.cast("string")))
    props = F.array(F.lit("size"), F.when(F.col("p_size") % 2 == 0, "size").otherwise("tone"))
    return quality.validate_profile(table(spark, sf_dir, "part").select(name.alias("component"), F.when(k % 3 != 0, F.col("p_type")).alias("level"), F.when(k % 4 != 0, F.col("p_brand")).alias("surface"), props.alias("props")))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS technique, CASE p_partkey % 5 WHEN 0 THEN 'nothing tested' WHEN 1 THEN 'unknown operator' ELSE 'no path' END AS why FROM part WHERE p_partkey % 5 IN (0, 1) OR p_size % 6 = 0""")
def rejected_predicates(spark, sf_dir):
    op = F.expr("case p_partkey % 5 when 1 then 'resembles' when 2 then 'equals' when 3 then 'gte' when 4 then 'startsWith' end")
    given = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("technique"), F.when(F.col("p_size") % 6 != 0, F.col("p_type")).alias("path"), op.alias("op"))
    return rules.validate_predicates(given).select("technique", "why")


@query("""WITH r AS (SELECT * FROM part WHERE (p_size % 3 = 0 OR p_brand = 'Brand#11') AND p_size % 10 <= 4 AND (p_size % 2 = 0 OR p_size % 20 >= 4))
SELECT array_to_string(list_sort(list(DISTINCT p_type)), '|') AS choose, array_to_string(list_sort(list(DISTINCT p_brand)), '|') AS forbid FROM r""")
def allowed_representations(spark, sf_dir):
    n = F.col("p_size")
    given = table(spark, sf_dir, "part").select(F.when(n % 3 != 0, F.col("p_brand")).alias("task"), (n % 10).alias("min_fields"), F.when(n % 2 == 1, n % 20).alias("max_fields"), F.array("p_type").alias("choose"), F.array("p_brand").alias("forbid"))
    got = rules.decide(given, "Brand#11", 4)
    return got.select(F.array_join("choose", "|").alias("choose"), F.array_join("forbid", "|").alias("forbid"))


@query("""WITH c AS (SELECT CAST(l_suppkey % 9 AS VARCHAR) AS repo, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity * 40 ELSE l_quantity * 16 END AS px FROM lineitem WHERE l_linenumber % 3 <> 0), n AS (SELECT repo, px, count(*) AS n FROM c WHERE px >= 480 GROUP BY ALL)
SELECT repo, arg_min(px, (-n, px)) AS dominant, round(max(n) / sum(n), 3) AS share, max(px) AS widest, count(*) AS distinct_caps FROM n GROUP BY repo""")
def layout_caps(spark, sf_dir):
    value = F.expr("case when l_linenumber % 2 = 0 then concat(cast(l_quantity * 40 as int), 'px') else concat(cast(l_quantity as int), 'rem') end")
    return styles.media_caps(table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 9).cast("string").alias("repo"), F.when(F.col("l_linenumber") % 3 == 0, "width").otherwise("max-width").alias("prop"), value.alias("value")))


@query("""SELECT 'src/features/' || l_suppkey % 9 || '/m' || l_partkey AS src, 'src/features/' || l_linenumber || '/n' || l_orderkey AS dst FROM lineitem WHERE l_suppkey % 9 <> l_linenumber AND l_partkey % 4 <> 0""")
def edges_across_features(spark, sf_dir):
    src = text("<if(l_partkey % 4 = 0, 'lib/', 'src/features/')>", "<l_suppkey % 9>", "/m", "<l_partkey>")
    return graphs.cross_feature(table(spark, sf_dir, "lineitem").select(src.alias("src"), text("src/features/", "<l_linenumber>", "/n", "<l_orderkey>").alias("dst")))


@query(r"""WITH ro AS (SELECT n_name AS role, regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') AS r, CASE WHEN n_nationkey % 5 = 0 THEN lower(r_name) || 'list' END AS also FROM nation JOIN region ON r_regionkey = n_regionkey),
re AS (SELECT DISTINCT CASE c_custkey % 3 WHEN 0 THEN n_name WHEN 1 THEN n_name || ' Card' ELSE r_name || ' List' END AS component FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE c_nationkey % 4 <> 0),
s AS (SELECT role, component, CASE WHEN r = c THEN 3 WHEN also = c THEN 2 WHEN contains(c, r) OR contains(r, c) THEN 1 END AS score FROM ro, (SELECT component, regexp_replace(lower(component), '[^a-z0-9]', '', 'g') AS c FROM re)),
t AS (SELECT role, score, min(component) AS component, count(*) AS n FROM s WHERE score IS NOT NULL GROUP BY role, score), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY score DESC) AS k FROM t) WHERE k = 1)
SELECT role, component, coalesce(score, 0) AS score, CASE WHEN score IS NULL THEN 'uncovered' WHEN n > 1 THEN 'questionable' ELSE 'proposed' END AS state FROM ro LEFT JOIN b USING (role)""")
def proposed_bindings(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, sf_dir, "customer").filter("c_nationkey % 4 <> 0").select((F.col("c_custkey") % 3).alias("k"), F.col("c_nationkey").alias("n_nationkey")).distinct().join(n, "n_nationkey")
    name = F.expr("case k when 0 then n_name when 1 then concat(n_name, ' Card') else concat(r_name, ' List') end")
    synonyms = n.filter("n_nationkey % 5 = 0").select(F.col("n_name").alias("role"), F.concat("r_name", F.lit(" List")).alias("synonym"))
    return retrieval.propose_bindings(n.select(F.col("n_name").alias("role")), c.select(name.alias("component")).distinct(), synonyms).fillna(0, ["score"])


@query("""WITH v AS (SELECT DISTINCT l_returnflag AS repo, CAST(l_linenumber AS VARCHAR) AS dimension, CAST(l_partkey AS VARCHAR) AS path, l_linestatus AS s FROM lineitem), a AS (SELECT DISTINCT repo, dimension, path FROM v WHERE s = 'O' OR repo = 'A'), b AS (SELECT DISTINCT repo, dimension, path FROM v WHERE s = 'F' AND repo <> 'A')
SELECT * FROM a WHERE repo NOT IN (SELECT repo FROM b) UNION ALL SELECT a.* FROM a JOIN b USING (repo, dimension, path)""")
def ratchet_batches(spark, sf_dir):
    """Two batches of violations as a stream would bring them; the second shrinks what was accepted of its repos."""
    folder = f"{shared_folder(spark)}/accepted"
    found = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("repo"), F.col("l_linenumber").cast("string").alias("dimension"), F.col("l_partkey").cast("string").alias("path"), "l_linestatus")
    step = streams.ratchet_batch(folder)
    step(found.filter("l_linestatus = 'O' or repo = 'A'"), 0)
    step(found.filter("l_linestatus = 'F' and repo <> 'A'"), 1)
    return spark.read.schema("repo string, dimension string, path string").parquet(f"{folder}/batch=1").filter("path is not null")
