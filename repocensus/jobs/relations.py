"""Queries on registries, graphs, rules, ledgers, retrieval and streams, over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lineage import shared_folder, spread
from ..operators import distributions, graphs, ledger, registry, retrieval, rules, styles
from ..streaming import streams
from .census import OBS, doc_observations, summary_sql, table

Q: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# registries: a part's type is a component, lines are call sites

USAGES = """us AS (SELECT CAST(l_suppkey % 10 AS VARCHAR) AS repo, l_orderkey AS path, 'C' || (l_partkey % 25) AS component, l_orderkey * 10 + l_linenumber AS site_id, unnest([
 {'prop': 'flag', 'value': l_returnflag}, {'prop': 'status', 'value': l_linestatus}, {'prop': 'line', 'value': CAST(l_linenumber AS VARCHAR)}, {'prop': 'width', 'value': CAST(CAST(l_quantity AS BIGINT) % 4 AS VARCHAR) || 'px'}, {'prop': 'price', 'value': CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR)}, {'prop': 'on', 'value': 'true'}]) AS p FROM lineitem),
usages AS (SELECT repo, path, component, site_id, p.prop AS prop, p.value AS value FROM us)"""


def usages(spark, sf_dir):
    # by the file of the sites, so that a site's rows stay together and are counted once where they are
    li = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus"), "l_orderkey", 500_000)
    props = {"flag": F.col("l_returnflag"), "status": F.col("l_linestatus"), "line": F.col("l_linenumber").cast("string"), "width": F.concat((F.col("l_quantity").cast("long") % 4).cast("string"), F.lit("px")), "price": F.floor("l_extendedprice").cast("long").cast("string"), "on": F.lit("true")}
    each = F.array(*[F.struct(F.lit(k).alias("prop"), v.alias("value")) for k, v in props.items()])
    rows = li.select((F.col("l_suppkey") % 10).cast("string").alias("repo"), F.col("l_orderkey").alias("path"), F.concat(F.lit("C"), (F.col("l_partkey") % 25).cast("string")).alias("component"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("site_id"), F.explode(each).alias("p"))
    return rows.select("repo", "path", "component", "site_id", "p.prop", "p.value", F.lit("string").alias("kind"))


def registry_tables(spark):
    components = spark.createDataFrame([(f"C{i}", i % 2 == 0) for i in range(24)], "component string, inherits boolean")
    props = spark.createDataFrame([(f"C{i}", p, v) for i in range(24) for p, v in (("flag", ["A", "N"] if i % 3 else ["A", "N", "R"]), ("status", ["F", "O"]), ("line", None), ("width", None)) if not (p == "width" and i % 5 == 0)], "component string, prop string, values array<string>")
    return F.broadcast(components), F.broadcast(props)


CHECKS = f"""{USAGES}, k AS (SELECT *, CAST(substr(component, 2) AS INTEGER) AS i FROM usages),
checks AS (SELECT DISTINCT repo, path, component, site_id, NULL AS prop, 'component' AS "check", i < 24 AS ok FROM k
UNION ALL SELECT repo, path, component, site_id, prop, 'prop', prop IN ('flag', 'status', 'line') OR (prop = 'width' AND (i % 5 <> 0 OR i % 2 = 0)) FROM k WHERE i < 24
UNION ALL SELECT repo, path, component, site_id, prop, 'value', CASE prop WHEN 'flag' THEN value IN ('A', 'N') OR (i % 3 = 0 AND value = 'R') ELSE value IN ('F', 'O') END FROM k WHERE i < 24 AND prop IN ('flag', 'status'))"""


@query(f"""WITH {CHECKS} SELECT component, prop, "check", ok, count(*) AS n FROM checks GROUP BY ALL""")
def registry_checks(spark, sf_dir):
    got = registry.check_registry(usages(spark, sf_dir), *registry_tables(spark))
    return got.groupBy("component", "prop", "check", "ok").agg(F.count("*").alias("n"))


@query(f"""WITH {CHECKS} SELECT repo, component, CAST(CASE WHEN GROUPING(repo) = 1 THEN 0 WHEN GROUPING(component) = 1 THEN 1 ELSE 2 END AS INTEGER) AS level, CAST(sum(CAST(ok AS INTEGER)) AS BIGINT) AS passed, count(*) AS total, CAST(floor(100 * sum(CAST(ok AS INTEGER)) / count(*)) AS BIGINT) AS percent FROM checks GROUP BY ROLLUP (repo, component)""")
def registry_score(spark, sf_dir):
    return registry.score(registry.check_registry(usages(spark, sf_dir), *registry_tables(spark)), ["repo", "component"])


SCORED = f"""{CHECKS}, f AS (SELECT repo, path % 3 AS kind, path, sum(CAST(ok AS INTEGER)) FILTER (prop IN ('status', 'line', 'flag')) AS passed, count(*) FILTER (prop IN ('status', 'line', 'flag')) AS total FROM checks WHERE prop IN ('status', 'line', 'flag') GROUP BY ALL),
files AS (SELECT repo, kind, path, CAST(floor(100 * passed / total) AS BIGINT) AS percent, total, path % 11 = 0 AS in_baseline FROM f)"""


def scored_files(spark, sf_dir):
    c = registry.check_registry(usages(spark, sf_dir), *registry_tables(spark)).filter(F.col("prop").isin("status", "line", "flag"))
    f = c.groupBy("repo", (F.col("path") % 3).alias("kind"), "path").agg(F.sum(F.col("ok").cast("long")).alias("passed"), F.count("*").alias("total"))
    return f.select("repo", "kind", "path", registry.floor_percent(F.col("passed"), F.col("total")).alias("percent"), "total", (F.col("path") % 11 == 0).alias("in_baseline"))


@query(f"""WITH {SCORED} SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY repo, kind ORDER BY percent DESC, total DESC, path) AS INTEGER) AS rank FROM files WHERE percent = 100 AND total >= 8 AND NOT in_baseline) WHERE rank <= 3""")
def exemplars(spark, sf_dir):
    return registry.exemplars(scored_files(spark, sf_dir))


@query(f"""WITH {SCORED} SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY repo ORDER BY percent, total DESC, path) AS INTEGER) AS rank FROM files WHERE percent < 90 OR in_baseline) WHERE rank <= 8""")
def files_to_avoid(spark, sf_dir):
    return registry.to_avoid(scored_files(spark, sf_dir))


@query(f"""WITH {USAGES}, v AS (SELECT repo, component, prop, value, count(*) AS n FROM usages GROUP BY ALL), b AS (SELECT repo, component, prop, CAST(sum(n) AS BIGINT) AS literals, count(*) AS d, count(*) FILTER (regexp_matches(value, '^-?[0-9]+$')) AS numbers, max(TRY_CAST(value AS BIGINT)) AS hi, min(TRY_CAST(value AS BIGINT)) AS lo, count(*) FILTER (regexp_matches(value, '^-?[0-9.]+(px|rem)$')) AS lengths FROM v GROUP BY ALL),
r AS (SELECT repo, component, prop, literals, d AS "distinct", CAST(0 AS BIGINT) AS expressions, CASE WHEN literals < 5 THEN 'too few literals' WHEN d < 2 THEN 'constant' WHEN 2 * d > literals THEN 'free text' WHEN d > 12 THEN 'too many values' WHEN d >= 3 AND numbers = d AND d / (hi - lo + 1) >= 0.8 THEN 'range' WHEN lengths > 0 AND 2 * lengths >= d THEN 'lengths' END AS refused FROM b)
SELECT *, refused IS NULL AS axis FROM r""")
def prop_axes(spark, sf_dir):
    return registry.axes(registry.prop_usage(usages(spark, sf_dir)))


@query(r"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<([A-Za-z][\w.-]*)((?:\s+[\w:@.-]+(?:\s*=\s*(?:"[^"]*"|''[^'']*''|\{[^}]*\}|[^\s"''>{]+))?)*)\s*/?>')) AS tag FROM pages),
h AS (SELECT regexp_extract(tag, '<([A-Za-z][\w.-]*)', 1) AS component, regexp_extract(tag, '<([A-Za-z][\w.-]*)((?:\s+[\w:@.-]+(?:\s*=\s*(?:"[^"]*"|''[^'']*''|\{[^}]*\}|[^\s"''>{]+))?)*)\s*/?>', 2) AS attrs FROM t),
a AS (SELECT component, unnest(regexp_extract_all(attrs, '([\w:@.-]+)(\s*=\s*("[^"]*"|''[^'']*''|\{[^}]*\}|[^\s"''>{]+))?')) AS a FROM h)
SELECT component, regexp_extract(a, '^([\w:@.-]+)', 1) AS prop, CASE WHEN NOT contains(a, '=') THEN 'boolean' ELSE 'string' END AS kind, count(*) AS n FROM a GROUP BY ALL""")
def tag_usages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.lit("all").alias("repo"), F.col("page_id").alias("path"), F.col("html").alias("content"))
    return registry.tag_usages(pages).filter("prop is not null").groupBy("component", "prop", "kind").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT DISTINCT p_brand AS component FROM part), u AS (SELECT p_brand AS component, count(DISTINCT (l_orderkey, l_linenumber)) AS sites FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT component, coalesce(sites, 0) AS sites, sites IS NOT NULL AS called FROM c LEFT JOIN u USING (component)""")
def vocabulary(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    called = table(spark, sf_dir, "lineitem").join(part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("component")), "l_partkey")
    called = called.select(F.lit("all").alias("repo"), F.col("l_orderkey").alias("path"), "component", F.col("l_linenumber").alias("site_id"))
    return registry.vocabulary(part.select(F.col("p_brand").alias("component")), called)


@query("SELECT p_name AS alias, count(DISTINCT p_brand) AS claims, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS components FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) > 1")
def contested_aliases(spark, sf_dir):
    got = registry.contested(table(spark, sf_dir, "part").select(F.col("p_name").alias("alias"), F.col("p_brand").alias("component")))
    return got.withColumn("components", F.array_join("components", ","))


def jaccard_sql(rows: str, element: str, name: str) -> str:
    """Pairs of components of a library with elements in common."""
    return f"""{name}_i AS (SELECT DISTINCT library, component AS k, {element} AS e FROM {rows}), {name}_n AS (SELECT library, k, count(*) AS n FROM {name}_i GROUP BY ALL),
{name} AS (SELECT x.library, x.k AS a, y.k AS b, count(*) AS shared, any_value(na.n) AS na, any_value(nb.n) AS nb FROM {name}_i x JOIN {name}_i y ON x.library = y.library AND x.e = y.e AND x.k < y.k JOIN {name}_n na ON na.library = x.library AND na.k = x.k JOIN {name}_n nb ON nb.library = x.library AND nb.k = y.k GROUP BY ALL)"""


def component_tables(spark, sf_dir):
    """A supplier's library has a component for each month; it takes the month's discounts, and renders its line numbers or the month before."""
    month = lambda d: F.date_format(d, "yyyy-MM")
    element = F.when(F.col("l_linenumber") == 7, month(F.date_sub("l_shipdate", 31))).otherwise(F.concat(F.lit("L"), F.col("l_linenumber").cast("string")))
    s = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("library"), month("l_shipdate").alias("component"), F.round(F.col("l_discount") * 100).cast("int").cast("string").alias("prop"), element.alias("element"))
    return s.select("library", "component", "prop").distinct(), s.select("library", "component", "element").distinct()


COMPONENTS = "cm AS (SELECT l_suppkey AS library, strftime(l_shipdate, '%Y-%m') AS component, CAST(CAST(round(l_discount * 100) AS INTEGER) AS VARCHAR) AS prop, CASE WHEN l_linenumber = 7 THEN strftime(l_shipdate - INTERVAL 31 DAY, '%Y-%m') ELSE 'L' || l_linenumber END AS element FROM lineitem)"


@query(f"""WITH {COMPONENTS}, {jaccard_sql('cm', 'prop', 'p')}, {jaccard_sql('cm', 'element', 'r')}
SELECT library, a, b, round(p.shared / (p.na + p.nb - p.shared), 3) AS props, round(r.shared / (r.na + r.nb - r.shared), 3) AS renders FROM p JOIN r USING (library, a, b) WHERE least(p.na, p.nb) >= 3 AND least(r.na, r.nb) >= 2 AND p.shared / (p.na + p.nb - p.shared) >= 0.6 AND r.shared / (r.na + r.nb - r.shared) >= 0.5
AND (library, a, b) NOT IN (SELECT library, component, element FROM cm) AND (library, b, a) NOT IN (SELECT library, component, element FROM cm)""")
def twins(spark, sf_dir):
    return registry.twins(*component_tables(spark, sf_dir), by=("library",))


@query(f"""WITH {COMPONENTS}, {jaccard_sql('cm', 'prop', 'p')}, q AS (SELECT library, a, b, round(shared / (na + nb - shared), 3) AS j, shared FROM p WHERE shared >= 2 AND na >= 2 AND nb >= 2), o AS (SELECT * FROM q WHERE j > 0.3 UNION ALL SELECT library, b, a, j, shared FROM q WHERE j > 0.3)
SELECT library, a AS component, b AS nearest, j AS jaccard, shared FROM (SELECT *, row_number() OVER (PARTITION BY library, a ORDER BY j DESC, b) AS r FROM o) WHERE r = 1""")
def nearest_component(spark, sf_dir):
    return registry.nearest_component(component_tables(spark, sf_dir)[0], by=("library",))


@query("""WITH d AS (SELECT DISTINCT CAST(o_custkey % 5 AS VARCHAR) AS repo, 'N' || (o_orderkey % 200) AS name, o_custkey AS path FROM orders), i AS (SELECT DISTINCT CAST(o_custkey % 5 AS VARCHAR) AS repo, o_custkey AS src, o_custkey + 5 AS dst FROM orders),
s AS (SELECT repo, name, count(DISTINCT path) AS files FROM d GROUP BY ALL HAVING count(DISTINCT path) >= 2)
SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM d x JOIN i ON i.repo = x.repo AND i.src = x.path JOIN d y ON y.repo = x.repo AND y.name = x.name AND y.path = i.dst WHERE x.repo = s.repo AND x.name = s.name)""")
def parallel_implementations(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("repo", (F.col("o_custkey") % 5).cast("string"))
    defs = o.select("repo", F.concat(F.lit("N"), (F.col("o_orderkey") % 200).cast("string")).alias("name"), F.col("o_custkey").alias("path")).distinct()
    return registry.parallel_implementations(defs, o.select("repo", F.col("o_custkey").alias("src"), (F.col("o_custkey") + 5).alias("dst")).distinct())


@query("""WITH a AS (SELECT c_nationkey AS key, max(c_mktsegment) AS v FROM customer WHERE c_nationkey < 20 GROUP BY ALL), b AS (SELECT c_nationkey AS key, max(c_mktsegment) AS v FROM customer WHERE c_custkey % 9 = 0 AND c_nationkey > 3 GROUP BY ALL)
SELECT key, a.v AS value_a, b.v AS value_b, CASE WHEN b.v IS NULL THEN 'only a' WHEN a.v IS NULL THEN 'only b' WHEN a.v = b.v THEN 'agreed' ELSE 'different' END AS state FROM a FULL JOIN b USING (key)""")
def compare_registries(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("key", F.col("c_nationkey"))
    a, b = (x.groupBy("key").agg(F.max("c_mktsegment").alias("v")) for x in (c.filter("key < 20"), c.filter("c_custkey % 9 = 0 and key > 3")))
    return registry.compare(a, b, ["key"], "v")


@query("""WITH p AS (SELECT p_type AS prop, p_brand AS component, list_sort(list(DISTINCT p_size % 6)) AS v FROM part GROUP BY ALL), s AS (SELECT prop, count(*) AS components, max({'n': len(v), 'v': v}) AS x FROM p GROUP BY prop HAVING count(*) >= 2)
SELECT prop, component, CASE WHEN v = x.v THEN 'widest' WHEN len(list_filter(v, lambda e: NOT list_contains(x.v, e))) = 0 THEN 'narrowed' ELSE 'collided' END AS state, CAST(len(list_filter(v, lambda e: NOT list_contains(x.v, e))) AS INTEGER) AS outside FROM p JOIN s USING (prop)""")
def prop_vocabulary(spark, sf_dir):
    p = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("prop"), F.col("p_brand").alias("component")).agg(F.array_sort(F.collect_set(F.col("p_size") % 6)).alias("values"))
    return registry.prop_vocabulary(p)


@query("""WITH c AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL), t AS (SELECT *, CAST(sum(n) OVER (PARTITION BY o_orderpriority) AS BIGINT) AS total FROM c)
SELECT *, round(n / total, 3) AS share, round(n / total, 3) >= 0.5 AND total >= 5 AS proposed FROM t""")
def surface_given_level(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus")
    return registry.given(rows, "o_orderpriority", "o_orderstatus", least_share=0.5)


@query("""WITH n AS (SELECT CAST(s_nationkey AS VARCHAR) AS library, s_name AS name FROM supplier), h AS (SELECT library, 3 AS k, substr(name, 1, 3) AS prefix, count(*) AS n FROM n GROUP BY ALL), t AS (SELECT library, count(*) AS total FROM n GROUP BY ALL)
SELECT library, prefix, round(n / total, 3) AS share, total FROM h JOIN t USING (library) WHERE total >= 4 AND n / total >= 0.7""")
def house_prefix(spark, sf_dir):
    return registry.house_prefix(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("library"), F.col("s_name").alias("name")))


# graphs

EDGES = "eg AS (SELECT DISTINCT l_returnflag AS repo, l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_partkey <> l_suppkey)"


def edges(spark, sf_dir):
    """Every line imports: part k is a module, and so is the supplier with that number."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("repo"), F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).filter("src <> dst").distinct()


@query(f"WITH {EDGES} SELECT repo, dst AS module, count(DISTINCT src) AS fan_in FROM eg GROUP BY ALL")
def fan_in(spark, sf_dir):
    return graphs.in_degree(edges(spark, sf_dir))


@query(f"WITH {EDGES} SELECT DISTINCT repo, src AS module FROM eg WHERE NOT EXISTS (SELECT 1 FROM eg e WHERE e.repo = eg.repo AND e.dst = eg.src)")
def orphan_modules(spark, sf_dir):
    e = edges(spark, sf_dir)
    return graphs.orphans(e.select("repo", F.col("src").alias("module")).distinct(), e)


@query(f"""WITH RECURSIVE {EDGES}, reach AS (SELECT repo, src, dst FROM eg WHERE src IN (SELECT dst FROM eg) UNION SELECT r.repo, r.src, e.dst FROM reach r JOIN eg e ON r.repo = e.repo AND r.dst = e.src),
mutual AS (SELECT a.repo, a.src AS node, a.dst AS other FROM reach a JOIN reach b ON a.repo = b.repo AND a.src = b.dst AND a.dst = b.src), c AS (SELECT repo, node, min(other) AS component FROM mutual GROUP BY ALL)
SELECT repo, node, component, count(*) OVER (PARTITION BY repo, component) AS size FROM c""")
def import_cycles(spark, sf_dir):
    return graphs.cycles(edges(spark, sf_dir))


@query("""WITH f AS (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS repo, page_id AS src, html FROM pages), e AS (SELECT DISTINCT repo, src, unnest(regexp_extract_all(html, '<a href="(/[^"/]*)"', 1)) AS target FROM f) SELECT repo, target, count(*) AS links FROM e GROUP BY ALL""")
def page_links(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("repo"), F.col("page_id").alias("src"), "html")
    each = pages.select("repo", "src", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('<a href="(/[^"/]*)"'), F.lit(1)))).alias("target"))
    return each.groupBy("repo", "target").agg(F.count("*").alias("links"))


NEEDS = "nd AS (SELECT DISTINCT 'i' || p_partkey AS item, 'i' || (p_partkey // (2 + p_size % 3)) AS needs FROM part WHERE p_partkey >= 2 + p_size % 3)"


def needs(spark, sf_dir):
    """Every part needs the one whose number is a half, a third or a quarter of its own."""
    rows = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").select(F.concat(F.lit("i"), F.col("p_partkey").cast("string")).alias("item"), F.expr("p_partkey div (2 + p_size % 3)").alias("n"))
    return rows.filter("n > 0").select("item", F.concat(F.lit("i"), F.col("n").cast("string")).alias("needs")).distinct()


@query(f"WITH RECURSIVE {NEEDS}, c AS (SELECT 'i' || p_partkey AS item FROM part WHERE p_size >= 40 UNION SELECT needs FROM c JOIN nd USING (item)) SELECT DISTINCT item FROM c")
def requirement_closure(spark, sf_dir):
    start = table(spark, sf_dir, "part").filter("p_size >= 40").select(F.concat(F.lit("i"), F.col("p_partkey").cast("string")).alias("item")).distinct()
    return graphs.requires_closure(start, needs(spark, sf_dir)).select("item")


@query(f"""WITH RECURSIVE {NEEDS}, it AS (SELECT item FROM nd UNION SELECT needs FROM nd), lv AS (SELECT item, 0 AS level FROM it WHERE item NOT IN (SELECT item FROM nd) UNION SELECT nd.item, level + 1 FROM lv JOIN nd ON nd.needs = lv.item),
m AS (SELECT item, max(level) AS level FROM lv GROUP BY item) SELECT item, CAST(length(item) AS INTEGER) AS r, CAST(level AS INTEGER) AS level, CAST(row_number() OVER (ORDER BY level, length(item), item) AS INTEGER) AS position FROM m""")
def install_order(spark, sf_dir):
    n = needs(spark, sf_dir)
    items = n.select("item").union(n.select("needs")).distinct().withColumn("r", F.length("item"))
    return graphs.install_order(items, n, "r")


@query("""WITH RECURSIVE t AS (SELECT 'r' AS repo, '--t' || p_partkey AS token, CASE WHEN p_partkey % 4 = 0 THEN '#0a0b0c' ELSE 'var(--t' || (p_partkey * 7 % 2500) || ')' END AS value, CASE WHEN p_partkey % 4 <> 0 THEN '--t' || (p_partkey * 7 % 2500) END AS next FROM part),
c AS (SELECT repo, token, next, value, 0 AS d FROM t UNION ALL SELECT c.repo, c.token, t.next, t.value, d + 1 FROM c LEFT JOIN t ON t.repo = c.repo AND t.token = c.next WHERE c.next IS NOT NULL AND d < 3000 AND (t.token IS NULL OR t.token <> c.token)),
e AS (SELECT repo, token, bool_or(next IS NULL AND value IS NOT NULL) AS ok, bool_or(value IS NULL) AS dangling, max(CASE WHEN next IS NULL THEN value END) AS v FROM c GROUP BY ALL)
SELECT repo, token, CASE WHEN ok THEN v END AS value, CASE WHEN dangling THEN 'dangling' WHEN NOT ok THEN 'loop' END AS unresolved FROM e""")
def resolve_aliases(spark, sf_dir):
    k = F.col("p_partkey")
    value = F.when(k % 4 == 0, F.lit("#0a0b0c")).otherwise(F.concat(F.lit("var(--t"), (k * 7 % 2500).cast("string"), F.lit(")")))
    return styles.resolve_aliases(table(spark, sf_dir, "part").select(F.lit("r").alias("repo"), F.concat(F.lit("--t"), k.cast("string")).alias("token"), value.alias("value")))


@query("""WITH d AS (SELECT CAST(p_size % 5 AS VARCHAR) AS repo, '--' || replace(p_name, ' ', '-') AS token, p_partkey, p_type FROM part), f AS (SELECT repo, token, p_type AS value, 'f' AS file FROM (SELECT *, row_number() OVER (PARTITION BY repo, token ORDER BY p_partkey) AS r FROM d) WHERE r = 1),
u AS (SELECT DISTINCT CAST(p_size % 5 AS VARCHAR) AS repo, '--' || replace(p_name, ' ', '-') AS token FROM part WHERE p_brand = 'Brand#2') SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.repo = f.repo AND u.token = f.token)""")
def dead_tokens(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("repo", (F.col("p_size") % 5).cast("string")).withColumn("token", F.concat(F.lit("--"), F.regexp_replace("p_name", " ", "-")))
    decls = p.select("repo", F.lit("f").alias("file"), F.col("p_partkey").alias("rule_id"), F.lit(1).alias("ord"), F.col("token").alias("prop"), F.col("p_type").alias("value"))
    refs = styles.references(p.filter("p_brand = 'Brand#2'").select("repo", F.concat(F.lit("a{b:var("), "token", F.lit(")}")).alias("content")))
    return styles.dead_tokens(styles.first_declared(decls), refs)


# rules

@query("""SELECT event_type AS technique, count(DISTINCT CASE WHEN value > 60 THEN user_id END) AS worked, count(DISTINCT CASE WHEN value < 0.2 THEN user_id END) AS no_effect, CAST(0 AS BIGINT) AS rejected, CAST(min(CAST(ts AS DATE)) AS VARCHAR) AS first, CAST(max(CAST(ts AS DATE)) AS VARCHAR) AS last, CAST(0 AS BIGINT) AS undated,
CASE WHEN count(DISTINCT CASE WHEN value < 0.2 THEN user_id END) >= 2 THEN 'hold' WHEN count(DISTINCT CASE WHEN value > 60 THEN user_id END) >= 2 AND count(DISTINCT CASE WHEN value < 0.2 THEN user_id END) = 0 THEN 'adopt' WHEN count(DISTINCT CASE WHEN value > 60 THEN user_id END) >= 1 THEN 'trial' ELSE 'assess' END AS ring FROM events GROUP BY event_type""")
def technique_rings(spark, sf_dir):
    verdict = F.when(F.col("value") > 60, "worked").when(F.col("value") < 0.2, "no-effect").otherwise("other")
    return rules.ring(table(spark, sf_dir, "events").select(F.col("event_type").alias("technique"), F.col("user_id").alias("project"), verdict.alias("verdict"), F.to_date("ts").alias("date"))).withColumn("first", F.col("first").cast("string")).withColumn("last", F.col("last").cast("string"))


FACTS = """facts AS (SELECT CAST(user_id AS VARCHAR) AS repo, event_type AS path, CAST(count(*) AS VARCHAR) AS value FROM events GROUP BY ALL)"""
PREDICATES = [("cache", 1, "purchase", "gte", "3", False), ("cache", 1, "error", "lt", "9", False), ("cache", 2, "click", "gte", "12", False), ("trace", 1, "signup", "equals", "8", True), ("trace", 1, "view", "contains", "1", False)]


def facts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("repo"), F.col("event_type").alias("path")).agg(F.count("*").cast("string").alias("value"))


LEAVES = f"""{FACTS}, r AS (SELECT * FROM (VALUES {', '.join(f"('{t}', {g}, '{p}', '{o}', '{x}', {str(n).lower()})" for t, g, p, o, x, n in PREDICATES)}) v(technique, grp, path, op, operand, negate)),
lv AS (SELECT q.repo, r.*, f.value, coalesce(CASE op WHEN 'equals' THEN f.value = operand WHEN 'contains' THEN contains(f.value, operand) WHEN 'gte' THEN CAST(f.value AS DOUBLE) >= CAST(operand AS DOUBLE) WHEN 'lt' THEN CAST(f.value AS DOUBLE) < CAST(operand AS DOUBLE) END, false) <> negate AS held FROM (SELECT DISTINCT repo FROM facts) q CROSS JOIN r LEFT JOIN facts f ON f.repo = q.repo AND f.path = r.path)"""


@query(f"WITH {LEAVES}, g AS (SELECT repo, technique, grp, bool_and(held) AS held FROM lv GROUP BY ALL) SELECT repo, technique, bool_or(held) AS applies FROM g GROUP BY ALL")
def applicable_techniques(spark, sf_dir):
    return rules.evaluate_predicates(facts(spark, sf_dir), spark.createDataFrame(PREDICATES, "technique string, group int, path string, op string, operand string, negate boolean"))


@query(f"WITH {LEAVES} SELECT repo, technique, string_agg(path || ' ' || op || ' ' || operand || ' (' || coalesce(value, 'absent') || ')', '; ' ORDER BY path || ' ' || op || ' ' || operand || ' (' || coalesce(value, 'absent') || ')') AS because FROM lv WHERE held GROUP BY ALL")
def why_techniques(spark, sf_dir):
    got = rules.why(facts(spark, sf_dir), spark.createDataFrame(PREDICATES, "technique string, group int, path string, op string, operand string, negate boolean"))
    return got.withColumn("because", F.array_join("because", "; "))


@query("""WITH e AS (SELECT DISTINCT source AS repo, lang AS name FROM documents), m AS (SELECT * FROM (VALUES ('english', '^en'), ('romance', '^(fr|es)'), ('german', 'de')) v(mechanism, pattern)), h AS (SELECT DISTINCT repo, mechanism FROM e JOIN m ON regexp_matches(name, pattern)), a AS (SELECT * FROM (SELECT DISTINCT repo FROM e) CROSS JOIN m)
SELECT a.repo, coalesce(string_agg(a.mechanism, ',' ORDER BY a.mechanism) FILTER (h.repo IS NOT NULL), '') AS present, coalesce(string_agg(a.mechanism, ',' ORDER BY a.mechanism) FILTER (h.repo IS NULL), '') AS missing FROM a LEFT JOIN h ON a.repo = h.repo AND a.mechanism = h.mechanism GROUP BY a.repo""")
def toolchain(spark, sf_dir):
    ev = table(spark, sf_dir, "documents").select(F.col("source").alias("repo"), F.lit("lang").alias("kind"), F.col("lang").alias("name")).distinct()
    m = spark.createDataFrame([("english", "lang", "^en"), ("romance", "lang", "^(fr|es)"), ("german", "lang", "de")], "mechanism string, kind string, pattern string")
    return rules.toolchain(ev, m).select("repo", F.array_join("present", ",").alias("present"), F.array_join("missing", ",").alias("missing"))


@query("""WITH f AS (SELECT source AS repo, lang AS metric, CAST(count(*) AS DOUBLE) AS value FROM documents GROUP BY ALL), p AS (SELECT * FROM (VALUES ('en', 'gte', 20.0, 'fr'), ('es', 'lte', 8.0, 'zz'), ('de', 'equals', 7.0, NULL)) v(metric, op, target, measured_over))
SELECT q.repo, p.metric, op, CAST(target AS DOUBLE) AS target, a.value, b.value AS over, CASE WHEN a.value IS NULL OR (measured_over IS NOT NULL AND coalesce(b.value, 0) = 0) THEN 'gap' WHEN CASE op WHEN 'gte' THEN a.value >= target WHEN 'lte' THEN a.value <= target ELSE a.value = target END THEN 'met' ELSE 'diverges' END AS state
FROM (SELECT DISTINCT repo FROM f) q CROSS JOIN p LEFT JOIN f a ON a.repo = q.repo AND a.metric = p.metric LEFT JOIN f b ON b.repo = q.repo AND b.metric = p.measured_over""")
def practice_compare(spark, sf_dir):
    f = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("repo"), F.col("lang").alias("metric")).agg(F.count("*").cast("double").alias("value"))
    return rules.practice_compare(f, spark.createDataFrame([("en", "gte", 20.0, "fr"), ("es", "lte", 8.0, "zz"), ("de", "equals", 7.0, None)], "metric string, op string, target double, measured_over string"))


@query("""WITH f AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS repo, event_type AS requirement FROM events WHERE value > 40), r AS (SELECT * FROM (VALUES (1, 'click'), (1, 'view'), (2, 'purchase'), (3, 'error'), (3, 'signup')) v(level, requirement)), a AS (SELECT q.repo, level, r.requirement, f.repo IS NOT NULL AS ok FROM (SELECT DISTINCT repo FROM f) q CROSS JOIN r LEFT JOIN f ON f.repo = q.repo AND f.requirement = r.requirement),
b AS (SELECT repo, level, bool_and(ok) AS held, string_agg(requirement, ',' ORDER BY requirement) FILTER (NOT ok) AS lacks FROM a GROUP BY ALL), c AS (SELECT *, bool_and(held) OVER (PARTITION BY repo ORDER BY level) AS run FROM b)
SELECT repo, CAST(coalesce(max(level) FILTER (run), 0) AS INTEGER) AS level, coalesce(arg_min(coalesce(lacks, ''), level) FILTER (NOT run), '') AS missing FROM c GROUP BY repo""")
def delegation_level(spark, sf_dir):
    f = table(spark, sf_dir, "events").filter("value > 40").select(F.col("user_id").cast("string").alias("repo"), F.col("event_type").alias("requirement")).distinct()
    r = spark.createDataFrame([(1, "click"), (1, "view"), (2, "purchase"), (3, "error"), (3, "signup")], "level int, requirement string")
    return rules.delegation_level(f, r).withColumn("missing", F.array_join("missing", ","))


@query("""WITH z AS (SELECT p_partkey AS spec, CASE WHEN p_size % 2 = 0 THEN 'compare' ELSE 'browse' END AS task, p_size % 12 AS fields, CASE p_partkey % 3 WHEN 0 THEN ['card'] WHEN 1 THEN ['table'] ELSE ['card', 'table'] END AS elements FROM part), m AS (SELECT *, task = 'compare' AND fields >= 4 AS r1, fields <= 2 AS r2 FROM z)
SELECT spec, array_to_string(elements, ',') AS elements, CASE WHEN r1 AND list_contains(elements, 'table') THEN 'accept' WHEN r1 THEN 'reject' WHEN r2 AND list_contains(elements, 'table') THEN 'reject' ELSE 'accept' END AS verdict FROM m""")
def selection_rules(spark, sf_dir):
    k = F.col("p_partkey")
    els = F.when(k % 3 == 0, F.array(F.lit("card"))).when(k % 3 == 1, F.array(F.lit("table"))).otherwise(F.array(F.lit("card"), F.lit("table")))
    z = table(spark, sf_dir, "part").select(k.alias("spec"), F.lit("z").alias("zone"), F.when(F.col("p_size") % 2 == 0, "compare").otherwise("browse").alias("task"), F.lit("record").alias("item"), F.lit("many").alias("cardinality"), (F.col("p_size") % 12).alias("fields"), F.lit(False).alias("editable"), els.alias("elements"))
    r = spark.createDataFrame([("compare", None, None, 4, None, None, ["card"], ["table"]), (None, None, None, None, 2, None, ["table"], [])], "task string, item string, cardinality string, min_fields int, max_fields int, editable boolean, forbid array<string>, choose array<string>")
    return rules.selection_rules(z, r).select("spec", F.array_join("elements", ",").alias("elements"), "verdict")


# ledgers

@query("""WITH f AS (SELECT user_id, min(ts) AS t FROM events WHERE event_type = 'purchase' GROUP BY ALL) SELECT event_id, user_id, event_type FROM events JOIN f USING (user_id) WHERE ts >= t""")
def since_first_purchase(spark, sf_dir):
    return ledger.since_first(table(spark, sf_dir, "events"), ["user_id"], "ts", F.col("event_type") == "purchase").select("event_id", "user_id", "event_type")


@query("""WITH c AS (SELECT CAST(user_id % 9 AS VARCHAR) AS repo, ts, event_type = 'signup' AND value > 20 AS agent, event_type = 'view' AS signed, user_id FROM events), f AS (SELECT *, min(CASE WHEN agent THEN ts END) OVER (PARTITION BY repo) AS t FROM c)
SELECT repo, count(*) AS commits, count(*) FILTER (agent) AS agent_named, count(*) FILTER (signed) AS signed, count(DISTINCT user_id) AS authors, count(*) FILTER (ts >= t) AS since_adoption, round(count(*) FILTER (agent) / nullif(count(*) FILTER (ts >= t), 0), 3) AS share_since FROM f GROUP BY repo""")
def provenance(spark, sf_dir):
    agent = F.when((F.col("event_type") == "signup") & (F.col("value") > 20), F.array(F.struct(F.lit("Release Bot").alias("name"), F.lit("x@example.com").alias("email")))).otherwise(F.array(F.struct(F.lit("A Person").alias("name"), F.lit("1+p@users.noreply.example.com").alias("email"))))
    c = table(spark, sf_dir, "events").select((F.col("user_id") % 9).cast("string").alias("repo"), F.col("event_id").alias("hash"), F.col("user_id").alias("author"), F.col("ts").alias("date"), F.when(F.col("event_type") == "view", "X").otherwise("N").alias("signature"), agent.alias("co_authors"))
    return ledger.provenance(c)


RUNS = "runs AS (SELECT CAST(user_id % 6 AS VARCHAR) AS ledger, ts, CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS handled, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS escalated, CASE WHEN event_type = 'click' AND value > 50 THEN 1 ELSE 0 END AS wrong FROM events)"


def runs(spark, sf_dir):
    e = F.col("event_type")
    return table(spark, sf_dir, "events").select((F.col("user_id") % 6).cast("string").alias("ledger"), "ts", F.when(e != "error", 1).otherwise(0).alias("handled"), F.when(e == "error", 1).otherwise(0).alias("escalated"), F.when((e == "click") & (F.col("value") > 50), 1).otherwise(0).alias("wrong"))


@query("""WITH c AS (SELECT CAST(user_id % 9 AS VARCHAR) AS repo, event_id, unnest(CASE event_id % 5 WHEN 0 THEN ['Claude', 'Claude', 'P'] WHEN 1 THEN ['Copilot'] WHEN 2 THEN ['V Gemini', 'gpt-' || user_id % 3] ELSE [] END) AS name FROM events)
SELECT repo, name AS model, count(DISTINCT event_id) AS commits FROM c WHERE name NOT IN ('P', 'V Gemini') GROUP BY ALL""")
def models_named(spark, sf_dir):
    k = F.col("event_id") % 5

    def person(name, email="p@x.org"):
        return F.struct((name if not isinstance(name, str) else F.lit(name)).alias("name"), F.lit(email).alias("email"))

    people = F.when(k == 0, F.array(person("Claude"), person("Claude", "q@x.org"), person("P", "1+claude@users.noreply.host.com"))).when(k == 1, F.array(person("Copilot", "2+Copilot@users.noreply.host.com"))).when(k == 2, F.array(person("V Gemini"), person(F.concat(F.lit("gpt-"), (F.col("user_id") % 3).cast("string")), None)))
    return ledger.models_named(table(spark, sf_dir, "events").select((F.col("user_id") % 9).cast("string").alias("repo"), people.alias("co_authors")))


@query("""WITH r AS (SELECT CAST(user_id % 60 AS VARCHAR) AS ledger, ts, event_id, event_id % 900 + 1 AS h, user_id AS e, event_id % 7 AS w, CASE WHEN event_id % 3 > 0 THEN value / 100 END AS c, 40.0 + user_id % 5 AS b, 1000.0 + event_id % 10 AS v FROM events),
l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY ledger ORDER BY ts DESC, h DESC, e DESC) = 1), m AS (SELECT *, (h * c + e * b) / (h + e) AS blended FROM l)
SELECT ledger, h AS handled, e AS escalated, w AS wrong, h + e AS seen, round(h / (h + e), 3) AS autonomy, round(w / h, 3) AS error_rate, c AS cost_per_unit, round(blended, 2) AS blended, round(b - blended, 2) AS saved_per_unit, round((b - blended) * v, 0) AS saved_per_year FROM m""")
def outcomes(spark, sf_dir):
    k, u = F.col("event_id"), F.col("user_id")
    r = table(spark, sf_dir, "events").select((u % 60).cast("string").alias("ledger"), "ts", (k % 900 + 1).alias("handled"), u.alias("escalated"), (k % 7).alias("wrong"), F.when(k % 3 > 0, F.col("value") / 100).alias("cost_per_unit"), (u % 5 + F.lit(40.0)).alias("baseline"), (k % 10 + F.lit(1000.0)).alias("volume"))
    return ledger.outcome(r).drop("baseline", "volume")


CUES = {"the": "(^| )the( |,|[.])", "die": "(^| )die( |,|[.])", "les": "(^| )les( |,|[.])"}


@query("""WITH m AS (SELECT conv_id, turn, list_filter([CASE WHEN regexp_matches(lower(text), '(^| )die( |,|[.])') THEN 'die' END, CASE WHEN regexp_matches(lower(text), '(^| )les( |,|[.])') THEN 'les' END, CASE WHEN regexp_matches(lower(text), '(^| )the( |,|[.])') THEN 'the' END], lambda x: x IS NOT NULL) AS k FROM conversations)
SELECT conv_id, turn, turn % 4 <> 3 AND len(k) = 1 AS handled, CASE WHEN turn % 4 <> 3 AND len(k) = 1 THEN k[1] END AS decision, turn % 4 <> 3 AND len(k) = 1 AND k[1] <> 'the' AS wrong FROM m""")
def keyword_triage(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.when(F.col("turn") % 4 != 3, "ref").alias("reference"), F.lit("the").alias("label"))
    return ledger.keyword_triage(c, CUES).select("conv_id", "turn", "handled", "decision", "wrong")


@query("SELECT conv_id, turn, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens, ceil(length(text) / 4) > 640 AS over, CAST(640 - ceil(length(text) / 4) AS BIGINT) AS headroom, CAST(greatest(500, ceil(1.25 * ceil(length(text) / 4) / 100) * 100) AS BIGINT) AS generated FROM conversations")
def context_budget(spark, sf_dir):
    return ledger.context_budget(table(spark, sf_dir, "conversations"), 640).select("conv_id", "turn", "tokens", "over", "headroom", "generated")


@query("""WITH m AS (SELECT CAST(user_id % 15 AS VARCHAR) AS repo, event_type AS metric, day(ts) AS d, value FROM events), a AS (SELECT repo, metric, round(avg(value), 3) AS before, DATE '2024-01-05' AS from_day FROM m WHERE d <= 5 GROUP BY ALL), b AS (SELECT repo, metric, round(avg(value), 3) AS after, CASE WHEN metric = 'view' THEN DATE '2024-01-10' ELSE DATE '2024-01-25' END AS to_day FROM m WHERE d >= 2 GROUP BY ALL)
SELECT repo, metric, before, after, round(after - before, 3) AS delta, CASE WHEN metric = 'purchase' THEN CASE WHEN round(after - before, 3) > 0 THEN 'worked' ELSE 'no-effect' END WHEN round(after - before, 3) < 0 THEN 'worked' ELSE 'no-effect' END AS verdict FROM a JOIN b USING (repo, metric) WHERE metric <> 'view'""")
def baseline_vs_now(spark, sf_dir):
    m = table(spark, sf_dir, "events").select((F.col("user_id") % 15).cast("string").alias("repo"), F.col("event_type").alias("metric"), F.dayofmonth("ts").alias("d"), "value")
    mean = F.round(F.avg("value"), 3).alias("value")
    a = m.filter("d <= 5").groupBy("repo", "metric").agg(mean).withColumn("on", F.lit("2024-01-05").cast("date"))
    b = m.filter("d >= 2").groupBy("repo", "metric").agg(mean).withColumn("on", F.when(F.col("metric") == "view", "2024-01-10").otherwise("2024-01-25").cast("date"))
    directions = m.select("metric").distinct().withColumn("direction", F.when(F.col("metric") == "purchase", "up").otherwise("down"))
    return ledger.baseline_vs_now(a, b, directions).select("repo", "metric", "before", "after", "delta", "verdict")


@query("""WITH c AS (SELECT o_custkey % 100 AS "case", o_orderstatus <> 'P' AS ran, o_orderstatus = 'F' OR o_orderkey % 7 > 0 AS passed, 'fails in f' || (o_orderkey % 10) AS output FROM orders), ch AS (SELECT DISTINCT o_custkey % 100 AS "case", 'f' || (o_custkey % 3) AS file FROM orders), o AS (SELECT DISTINCT "case" FROM c JOIN ch USING ("case") WHERE ran AND NOT passed AND contains(output, file)),
b AS (SELECT "case", count(*) AS "all", count(*) FILTER (ran) AS ran, count(*) FILTER (ran AND passed) AS passed FROM c GROUP BY "case")
SELECT b.*, CASE WHEN o."case" IS NOT NULL THEN 'FAILED' WHEN passed < ran THEN 'FAILED ELSEWHERE' WHEN ran = 0 THEN 'NOT PROVEN' WHEN ran < "all" THEN 'PARTLY' ELSE 'PROVEN' END AS verdict FROM b LEFT JOIN o ON o."case" = b."case\"""")
def check_verdicts(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    case = (F.col("o_custkey") % 100).alias("case")
    checks = o.select(case, (F.col("o_orderstatus") != "P").alias("ran"), ((F.col("o_orderstatus") == "F") | (k % 7 > 0)).alias("passed"), F.concat(F.lit("fails in f"), (k % 10).cast("string")).alias("output"))
    return ledger.check_verdict(checks, o.select(case, F.concat(F.lit("f"), (F.col("o_custkey") % 3).cast("string")).alias("file")).distinct())


# retrieval: benchmark items ask, documents answer

STOPS = ", ".join(f"'{w}'" for w in retrieval.STOP)
WORDS = f"""q AS (SELECT DISTINCT item_id AS query, unnest(regexp_extract_all(lower(regexp_replace(text, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[a-z0-9]+')) AS w FROM benchmark), d AS (SELECT DISTINCT doc_id AS doc, unnest(regexp_extract_all(lower(regexp_replace(text, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[a-z0-9]+')) AS w FROM documents),
h AS (SELECT query, doc, count(*) AS score FROM q JOIN d USING (w) WHERE w NOT IN ({STOPS}) GROUP BY ALL), rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INTEGER) AS rank FROM h)"""


def ranked(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")
    return retrieval.rank_docs(q, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text"))


@query(f"WITH {WORDS} SELECT * FROM rk WHERE rank <= 10")
def rank_documents(spark, sf_dir):
    return ranked(spark, sf_dir).filter("rank <= 10")


@query(f"""WITH {WORDS}, w AS (SELECT item_id AS query, min(doc_id) AS doc FROM benchmark JOIN documents ON contains(documents.text, benchmark.text) GROUP BY ALL), j AS (SELECT w.query, rank FROM w LEFT JOIN rk USING (query, doc))
SELECT count(DISTINCT query) AS queries, CASE WHEN count(DISTINCT query) >= 5 THEN count(*) FILTER (rank = 1) END AS top1, CASE WHEN count(DISTINCT query) >= 5 THEN count(rank) END AS found, CASE WHEN count(DISTINCT query) >= 5 THEN round(avg(coalesce(1.0 / rank, 0)), 4) END AS mrr, CASE WHEN count(DISTINCT query) < 5 THEN 'too few distinct queries' END AS why FROM j""")
def retrieval_eval(spark, sf_dir):
    b, d = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    within = retrieval.containing(d.select(F.col("doc_id").alias("doc"), "text"), b.select(F.col("item_id").alias("query"), F.col("text").alias("passage")))
    wanted = within.groupBy("query").agg(F.min("doc").alias("doc"))
    ranks = retrieval.ranks_of(b.select(F.col("item_id").alias("query"), "text"), d.select(F.col("doc_id").alias("doc"), "text"), wanted)
    return retrieval.retrieval_eval(ranks, wanted)


@query("""WITH n AS (SELECT DISTINCT p_name || ' ' || lower(p_type) AS need FROM part), g AS (SELECT DISTINCT p_type AS component, p_type || ' ' || p_name AS text FROM part), w AS (SELECT DISTINCT need, unnest(regexp_extract_all(lower(need), '[a-z]{4,}')) AS w FROM n),
h AS (SELECT need, component, sum(CASE WHEN contains(lower(component), w) THEN 3 ELSE 0 END + 1) AS score FROM w JOIN (SELECT component, string_agg(text, ' ' ORDER BY text) AS text FROM g GROUP BY component) ON contains(lower(component), w) OR contains(lower(text), w) GROUP BY ALL)
SELECT need, component, CAST(score AS BIGINT) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY need ORDER BY score DESC, component) AS INTEGER) AS rank FROM h) WHERE rank <= 5""")
def near_misses(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    needs_ = p.select(F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("need")).distinct()
    g = p.select(F.col("p_type").alias("component"), F.concat_ws(" ", "p_type", "p_name").alias("text")).distinct()
    g = g.groupBy("component").agg(F.array_join(F.array_sort(F.collect_list("text")), " ").alias("text"))
    return retrieval.near_misses(needs_, g)


# streams, each run to its end over the tables

def _run(stream, name: str, mode: str = "append"):
    """Run a stream to its end into files of the shared folder, with its checkpoint beside them, and read them. Complete mode: the last batch's rows."""
    spark, folder = stream.sparkSession, shared_folder(stream.sparkSession)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{folder}/rows").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
    writer.foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(f"{folder}/rows")).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def _stream(spark, sf_dir, name: str):
    path = f"{sf_dir}/{name}.parquet"
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows


@query(f"""WITH {RUNS} SELECT strftime(ts, '%Y-%m-%d') AS window_start, ledger, CAST(sum(handled) AS BIGINT) AS handled, CAST(sum(escalated) AS BIGINT) AS escalated, CAST(sum(wrong) AS BIGINT) AS wrong, round(sum(handled) / (sum(handled) + sum(escalated)), 3) AS autonomy FROM runs GROUP BY ALL""")
def ledger_stream(spark, sf_dir):
    e = F.col("event_type")
    r = _stream(spark, sf_dir, "events").select((F.col("user_id") % 6).cast("string").alias("ledger"), "ts", F.when(e != "error", 1).otherwise(0).alias("handled"), F.when(e == "error", 1).otherwise(0).alias("escalated"), F.when((e == "click") & (F.col("value") > 50), 1).otherwise(0).alias("wrong"))
    return _run(streams.ledger_windows(r), "ledger", "complete").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def cases_once_stream(spark, sf_dir):
    return _run(streams.cases_once(_stream(spark, sf_dir, "events").select("user_id", "event_type", "ts"), ["user_id", "event_type"], "60 days"), "cases").select("user_id", "event_type")


@query(f"""WITH {OBS}, {summary_sql('obs', 's')}, o AS (SELECT obs.* FROM obs) SELECT o.repo, CAST(o.path AS VARCHAR) AS path, dimension, bucket, dominant AS expect FROM o JOIN s USING (repo, dimension) WHERE verdict = 'convention' AND bucket <> dominant""")
def gate_stream(spark, sf_dir):
    rule = distributions.summarise(distributions.counts(doc_observations(spark, sf_dir))).filter("verdict = 'convention'").select("repo", "dimension", F.col("dominant").alias("expect"))
    from .census import doc_dimensions

    arriving = _stream(spark, sf_dir, "documents").select(F.col("source").alias("repo"), F.col("doc_id").cast("string").alias("path"), "text", "lang")
    return _run(streams.gate_stream(arriving, doc_dimensions(), rule), "gate")


@query("""WITH w AS (SELECT unnest(generate_series(0, 9)) AS k), e AS (SELECT CAST(user_id % 7 AS VARCHAR) AS repo, 'event' AS dimension, event_type AS bucket, date_trunc('day', ts) + INTERVAL 1 DAY + to_days(CAST(k AS INTEGER)) AS window_end FROM events, w) SELECT strftime(window_end, '%Y-%m-%d') AS window_end, repo, dimension, bucket, count(*) AS n FROM e GROUP BY ALL""")
def sliding_stream(spark, sf_dir):
    e = _stream(spark, sf_dir, "events").select((F.col("user_id") % 7).cast("string").alias("repo"), F.lit("event").alias("dimension"), F.col("event_type").alias("bucket"), "ts")
    return _run(streams.sliding_shares(e, "10 days", "1 day"), "sliding", "complete").withColumn("window_end", F.date_format("window_end", "yyyy-MM-dd"))
