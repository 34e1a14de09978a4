"""Queries on source text that is written from the stand-in tables: routers, screens and their frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lineage import cut, spread
from ..operators import constructs, graphs, quality, registry, retrieval, screens, security, styles
from ..sources import images, markup, readers, shells
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


def written(spark, sf_dir, name: str, key: str, repo: str, files: list[tuple[str, str, str]]):
    """Files (repo, path, content) of each row of a table where a condition on the key k holds; ``{k}`` in a path or text is the key."""
    rows = spread(table(spark, sf_dir, name).select(F.expr(repo).cast("string").alias("repo"), F.col(key).cast("long").alias("k")), "k")

    def fill(text: str):
        return F.replace(F.lit(text), F.lit("{k}"), F.col("k").cast("string"))

    each = rows.select("repo", "k", F.explode(F.array(*[F.struct(F.lit(when).alias("when"), fill(path).alias("path"), fill(text).alias("content")) for when, path, text in files])).alias("f"))
    fits = F.lit(False)
    for when in sorted({w for w, _, _ in files}):
        fits = fits | ((F.col("f.when") == when) & F.expr(when))
    return each.filter(fits).select("repo", "f.path", "f.content")


ROUTERS = [
    ("k % 7 = 0", "apps/a{k}/src/router.tsx", "import S{k} from './scenes/S{k}'\nimport { Other } from './scenes/Other{k}'\nconst r = <Route path='/' element={<S{k} a={1} />} />"),
    ("k % 7 = 1", "apps/a{k}/src/router.tsx", "import type { S{k} as T{k}, U } from './scenes/S{k}'\nexport default () => <Route component={T{k}} />"),
    ("k % 7 = 2", "apps/a{k}/src/router.jsx", "import Kit, { S{k} } from \"@/scenes/S{k}\"\ncreateBrowserRouter([{ path: '/', Component: S{k} }])"),
    ("k % 7 = 3", "apps/a{k}/src/router.tsx", "const routes: RouteObject[] = [{ lazy: lazy(() => import('~/scenes/S{k}')) }]\nconst z = import('./scenes/Modal{k}')"),
    ("k % 7 = 4", "apps/a{k}/src/router.ts", "const routes: RouteRecordRaw[] = [{ component: () => import('#/scenes/S{k}.vue') }]"),
    ("k % 7 = 5", "apps/a{k}/src/app.routes.ts", "import { S{k} } from './scenes/S{k}'\nexport const routes: Routes = [{ path: '', component: S{k} }]"),
    ("k % 7 = 6", "apps/a{k}/src/split.tsx", "import S{k} from './scenes/S{k}'\nconst Lazy = lazy(() => import('./scenes/S{k}'))\nconst x = { component: S{k} }"),
]
SCENES = [("k % 7 not in (4, 5)", "apps/a{k}/src/scenes/S{k}.tsx", "export default () => <div/>"), ("k % 7 = 4", "apps/a{k}/src/scenes/S{k}.vue", "<template/>"), ("k % 7 = 5", "apps/a{k}/src/scenes/S{k}.ts", "export class S{k} {}"), ("true", "apps/a{k}/src/scenes/Modal{k}.tsx", ""), ("k % 5 = 0", "apps/a{k}/src/app/shop/page.tsx", ""), ("k % 5 = 0", "apps/a{k}/src/app/shop/layout.tsx", ""), ("k % 5 = 1", "apps/a{k}/src/pages/p{k}.tsx", ""), ("k % 5 = 2", "apps/a{k}/src/HomePage.tsx", ""), ("k % 5 = 3", "apps/a{k}/src/components/CardView.tsx", "")]


@query("""WITH k AS (SELECT CAST(p_size % 9 AS VARCHAR) AS repo, p_partkey AS k, 'apps/a' || p_partkey || '/src/' AS d FROM part)
SELECT repo, d || 'scenes/S' || k || CASE k % 7 WHEN 4 THEN '.vue' WHEN 5 THEN '.ts' ELSE '.tsx' END AS path, 'route' AS found_by FROM k WHERE k % 7 <> 6
UNION ALL SELECT repo, d || CASE k % 5 WHEN 0 THEN 'app/shop/page.tsx' WHEN 1 THEN 'pages/p' || k || '.tsx' ELSE 'HomePage.tsx' END, CASE k % 5 WHEN 2 THEN 'naming' ELSE 'router' END FROM k WHERE k % 5 < 3""")
def routed_screens(spark, sf_dir):
    files = written(spark, sf_dir, "part", "p_partkey", "p_size % 9", [*ROUTERS, *SCENES])
    return readers.is_screen(files.select("repo", "path"), graphs.routed(files))


SHELLS = [
    ("k % 8 = 0", "src/pages/p{k}.tsx", "export default function P() {\n  return (\n    <Scene icon={<Icon on={() => { return '>' }} />} title={t(\"x > y\")} wide onClose={() => 1} size={3}>\n      <div className=\"flex flex-col\" />\n    </Scene>\n  )\n}"),
    ("k % 8 = 1", "src/pages/p{k}.tsx", "const P = () => (<AuthProvider value={{ a: 1 }}><React.Fragment><AppShell title=\"a\" isOpen={true} userId={3} items={list} aria-label=\"b\" load={() => go()} plain={false}></AppShell></React.Fragment></AuthProvider>)"),
    ("k % 8 = 2", "src/pages/p{k}.tsx", "import './p.css'\nexport default () => { return <div className=\"grid grid-cols-3 gap\"><Scene title=\"no root\" /></div> }"),
    ("k % 8 = 3", "src/pages/p{k}.tsx", "export const loader = () => 1"),
    ("k % 8 = 4", "src/pages/p{k}.tsx", "export default function L() { return <Outlet /> }"),
    ("k % 8 = 5", "src/pages/p{k}.tsx", "const Box = styled.div`\n  display: grid;\n  grid-template-columns: 1fr 2fr;\n`\nexport default () => <Scene title=\"q\" icon=\"i\" key={1}><Box /></Scene>"),
    ("k % 8 = 6", "src/pages/p{k}.tsx", "export default () => <Panel className=\"x flex\" />"),
    ("k % 8 = 7", "src/pages/p{k}.tsx", "export default () => <Broken title={"),
    ("k % 50 = 1", "src/frames/Scene.tsx", "import type { ReactNode } from 'react'\nexport interface Props { icon?: React.ReactNode; title: string; onClose?: () => void; ref: Ref<Element>; wide?: boolean }\nexport const Scene = ({ icon, title, size }: Props) =>\n  <section style={{ a: size }}><h1 class={size}>{icon}{title}</h1>{children}</section>"),
]
ROOTS_SQL = """k AS (SELECT CAST(c_nationkey AS VARCHAR) AS repo, c_custkey AS k FROM customer), f AS (SELECT DISTINCT repo FROM k WHERE k % 50 = 1),
s AS (SELECT k.repo, 'src/pages/p' || k || '.tsx' AS path, k % 8 AS m, CASE k % 8 WHEN 2 THEN 'unframed' WHEN 3 THEN 'norender' WHEN 4 THEN 'plumbing' WHEN 7 THEN 'unclassified' ELSE 'framed' END AS class,
CASE k % 8 WHEN 0 THEN CASE WHEN f.repo IS NULL THEN 'Scene(size+title)' ELSE 'Scene(icon+title)' END WHEN 1 THEN 'AppShell(items+title)' WHEN 5 THEN 'Scene(icon+title)' WHEN 6 THEN 'Panel' END AS signature,
CASE WHEN k % 8 IN (0, 5) THEN f.repo IS NOT NULL WHEN k % 8 IN (1, 6) THEN false END AS from_declaration, k % 8 IN (0, 2, 5, 6) AS own_layout,
CASE k % 8 WHEN 0 THEN 'flex column' WHEN 2 THEN 'grid 3' WHEN 5 THEN 'grid 2 col' WHEN 6 THEN 'flex row' END AS arrangement FROM k LEFT JOIN f ON f.repo = k.repo)"""


def signed(spark, sf_dir):
    files = written(spark, sf_dir, "customer", "c_custkey", "c_nationkey", SHELLS).distinct()
    roots = shells.read_roots(files.filter("path like 'src/pages/%'"))
    return screens.signatures(roots, shells.read_frames(files.filter("path like 'src/frames/%'")))


@query(f"WITH {ROOTS_SQL} SELECT repo, path, class, signature, from_declaration, own_layout, coalesce(arrangement, '') AS arrangement FROM s")
def screen_shells(spark, sf_dir):
    return signed(spark, sf_dir).withColumn("arrangement", F.array_join("arrangement", ",")).drop("shell")


@query(f"""WITH {ROOTS_SQL}, b AS (SELECT repo, count(*) AS considered, count(*) FILTER (class = 'framed') AS framed, count(*) FILTER (class = 'unframed') AS unframed, count(*) FILTER (class = 'norender') AS norender, count(*) FILTER (class = 'plumbing') AS plumbing, count(*) FILTER (class = 'unclassified') AS unclassified, round(count(*) FILTER (own_layout) / count(*), 3) AS own_layout_share FROM s GROUP BY repo),
t AS (SELECT repo, signature, count(*) AS n, bool_or(from_declaration) AS d FROM s WHERE signature IS NOT NULL GROUP BY ALL), d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY d DESC, n DESC, signature) AS r FROM t) WHERE r = 1),
a AS (SELECT repo, arrangement AS a, count(*) AS c FROM s WHERE arrangement IS NOT NULL GROUP BY ALL), w AS (SELECT *, sum(c) OVER (PARTITION BY repo) AS total FROM a), l AS (SELECT *, round(c / total, 3) AS p FROM w QUALIFY row_number() OVER (PARTITION BY repo ORDER BY c DESC, a) = 1)
SELECT b.*, d.signature AS dominant, round(d.n / framed, 3) AS dominant_share, CASE WHEN total >= 5 THEN a END AS arrangement, p AS arrangement_share, CASE WHEN total IS NULL THEN 'none' WHEN total < 5 THEN 'too few to say' WHEN p >= 0.85 THEN 'convention' WHEN p >= 0.6 THEN 'weak' ELSE 'split' END AS arrangement_verdict FROM b LEFT JOIN d ON d.repo = b.repo LEFT JOIN l ON l.repo = b.repo""")
def archetype_summary(spark, sf_dir):
    return screens.archetype_report(signed(spark, sf_dir))


FRAMES = [
    ("k % 6 = 0", "src/Frame{k}.tsx", "type P = { head?: ReactNode, e: ReactNode, onDone: ReactElement; foot{k}: JSX.Element }\nexport const F = () =>\n  <div title={left ?? 1}>{head}{children}</div>"),
    ("k % 6 = 1", "src/Frame{k}.vue", "<template><slot name=\"head\"></slot><slot/><slot name='tools' :x=\"1\" /></template>"),
    ("k % 6 = 2", "src/frame{k}/index.svelte", "{#each rows as r, i}<li>{r}{i}</li>{/each}{@const z = 1}{z}{@render aside()}<input {placeholder} />"),
    ("k % 6 = 3", "src/frame{k}.component.ts", "template: `<ng-content select=\"[actions]\"></ng-content><ng-content></ng-content>`"),
    ("k % 6 = 4", "src/Plain{k}.tsx", "export const x = ${ value }; const s = <slot />"),
    ("k % 6 = 5", "src/Nothing{k}.tsx", "export const y = <b a={c} />"),
]


@query("""WITH k AS (SELECT s_suppkey AS k, CAST(s_suppkey % 40 AS VARCHAR) AS repo FROM supplier),
r AS (SELECT repo, k, unnest(CASE k % 6 WHEN 0 THEN ['head', 'foot' || k, 'children'] WHEN 1 THEN ['head', 'children', 'tools'] WHEN 2 THEN ['aside'] WHEN 3 THEN ['actions', 'children'] WHEN 4 THEN ['children'] ELSE [] END) AS region FROM k),
n AS (SELECT region, count(DISTINCT repo) AS products, count(DISTINCT repo || '/' || k) AS frames FROM r WHERE region <> 'children' GROUP BY region)
SELECT region, products, frames, CASE WHEN (SELECT count(DISTINCT repo) FROM r WHERE region <> 'children') >= 2 THEN CASE WHEN products > 1 THEN 'portable' ELSE 'local' END END AS reach FROM n""")
def regions_from_text(spark, sf_dir):
    frames = shells.read_frames(written(spark, sf_dir, "supplier", "s_suppkey", "s_suppkey % 40", FRAMES)).filter("region <> 'children'")
    return screens.regions_reach(frames.select(F.col("repo").alias("product"), F.concat_ws("/", "repo", "path").alias("frame"), "region"))


@query("""WITH k AS (SELECT s_suppkey AS k, CAST(s_suppkey % 40 AS VARCHAR) AS repo FROM supplier), r AS (SELECT repo, k, unnest(CASE k % 6 WHEN 0 THEN ['head', 'foot' || k] WHEN 1 THEN ['head', 'tools'] WHEN 2 THEN ['aside'] WHEN 3 THEN ['actions'] ELSE [] END) AS region FROM k)
SELECT repo, count(DISTINCT r.k) AS frames, count(DISTINCT region) AS regions, count(r.k) > 0 AS contributes FROM k LEFT JOIN r USING (repo) GROUP BY repo""")
def products_of_regions(spark, sf_dir):
    files = written(spark, sf_dir, "supplier", "s_suppkey", "s_suppkey % 40", FRAMES)
    return screens.products_of_regions(shells.read_frames(files), files)


CALLS = [
    ("true", "src/c{k}.tsx", "// <Gone/>\n<Bare/><Bare></Bare><Field type='text' placeholder={p} disabled value=\"v\" onChange={() => f('>')} colour='red' size='m{k}' /> <Panel className='x' aria-label='y' data-id={1} key={2} tone='loud' {...rest}><Bare\n/></Panel>"),
    ("k % 2 = 0", "src/d{k}.tsx", "<Panel tone='quiet' width={3} wide/><Pane/><Field name='n' size='s' size2/><Panel.Head made='up' />"),
]
REGISTRY = "r AS (SELECT * FROM (VALUES ('Bare', false, false), ('Field', true, false), ('Panel', false, false), ('Panel.Head', false, true), ('Never', true, false)) v(component, inherits, is_part))"
CALL_ROWS = """k AS (SELECT c_custkey AS k, CAST(c_nationkey AS VARCHAR) AS repo FROM customer),
u AS (SELECT repo, k, 'c' AS f, component, site, prop, kind, value FROM k, (VALUES ('Gone', 0, NULL, NULL, NULL), ('Bare', 1, NULL, NULL, NULL), ('Bare', 2, NULL, NULL, NULL), ('Field', 3, 'type', 'string', 'text'), ('Field', 3, 'placeholder', 'expression', NULL), ('Field', 3, 'disabled', 'boolean', NULL), ('Field', 3, 'value', 'string', 'v'), ('Field', 3, 'onChange', 'expression', NULL), ('Field', 3, 'colour', 'string', 'red'), ('Field', 3, 'size', 'string', 'm'),
('Panel', 4, 'className', 'string', 'x'), ('Panel', 4, 'aria-label', 'string', 'y'), ('Panel', 4, 'data-id', 'expression', NULL), ('Panel', 4, 'key', 'expression', NULL), ('Panel', 4, 'tone', 'string', 'loud'), ('Bare', 5, NULL, NULL, NULL)) v(component, site, prop, kind, value)
UNION ALL SELECT repo, k, 'd', component, site, prop, kind, value FROM k, (VALUES ('Panel', 0, 'tone', 'string', 'quiet'), ('Panel', 0, 'width', 'expression', NULL), ('Panel', 0, 'wide', 'boolean', NULL), ('Pane', 1, NULL, NULL, NULL), ('Field', 2, 'name', 'string', 'n'), ('Field', 2, 'size', 'string', 's'), ('Field', 2, 'size2', 'boolean', NULL), ('Panel.Head', 3, 'made', 'string', 'up')) w(component, site, prop, kind, value) WHERE k % 2 = 0)"""


def calls(spark, sf_dir):
    return markup.tag_usages(written(spark, sf_dir, "customer", "c_custkey", "c_nationkey", CALLS))


def components(spark):
    return spark.createDataFrame([("Bare", False, False), ("Field", True, False), ("Panel", False, False), ("Panel.Head", False, True), ("Never", True, False)], "component string, inherits boolean, is_part boolean")


@query(f"""WITH {CALL_ROWS}, {REGISTRY}, c AS (SELECT DISTINCT repo, k, f, u.component, site, NULL AS prop, 'component' AS "check", r.component IS NOT NULL AS ok FROM u LEFT JOIN r ON r.component = u.component
UNION ALL SELECT repo, k, f, u.component, site, prop, 'prop', (u.component = 'Field' AND prop IN ('size', 'type', 'placeholder', 'disabled', 'value', 'name')) OR (u.component = 'Panel' AND prop = 'tone') FROM u WHERE u.component IN ('Field', 'Panel') AND prop NOT IN ('className', 'aria-label', 'data-id', 'key', 'onChange')
UNION ALL SELECT repo, k, f, u.component, site, prop, 'value', value = 'loud' FROM u WHERE u.component = 'Panel' AND prop = 'tone')
SELECT repo, component, prop, "check", ok, count(*) AS n FROM c GROUP BY ALL""")
def registry_truth(spark, sf_dir):
    """Checks of written markup: bare tags, attributes of elements, those that are never checked, parts."""
    props = spark.createDataFrame([("Field", "size", None), ("Panel", "tone", ["loud", "soft"]), ("Panel.Head", "title", None)], "component string, prop string, values array<string>")
    return registry.check_registry(calls(spark, sf_dir), F.broadcast(components(spark)), F.broadcast(props)).groupBy("repo", "component", "prop", "check", "ok").agg(F.count("*").alias("n"))


@query(f"""WITH {CALL_ROWS} SELECT repo, component, prop, CASE kind WHEN 'boolean' THEN 'true' WHEN 'string' THEN CASE WHEN value = 'm' THEN 'm' || k ELSE value END END AS value, count(*) AS n, count(*) FILTER (kind = 'expression') AS expressions FROM u WHERE prop IS NOT NULL AND prop NOT IN ('className', 'key', 'onChange') GROUP BY ALL""")
def props_given(spark, sf_dir):
    return registry.prop_usage(calls(spark, sf_dir))


@query(f"""WITH {CALL_ROWS} SELECT repo, component, count(DISTINCT f || k || '/' || site) AS sites, count(DISTINCT f || k) AS files FROM u GROUP BY ALL""")
def call_sites(spark, sf_dir):
    return registry.call_sites(calls(spark, sf_dir))


@query(f"""WITH {CALL_ROWS}, {REGISTRY}, s AS (SELECT CASE component WHEN 'Pane' THEN 'Panel' WHEN 'Gone' THEN 'Never' ELSE component END AS component, count(DISTINCT f || k || '/' || site || component) AS sites FROM u GROUP BY 1)
SELECT r.component, coalesce(sites, 0) AS sites, sites IS NOT NULL AS called FROM r LEFT JOIN s ON s.component = r.component""")
def vocabulary_by_alias(spark, sf_dir):
    aliases = spark.createDataFrame([("Pane", "Bare"), ("Pane", "Panel"), ("Gone", "Never"), ("Field", "Never")], "alias string, component string")
    return registry.vocabulary(components(spark), calls(spark, sf_dir), aliases)


#: Components that answer a role, by the remainder of its key by 7.
ANSWERS = [(0, "Exact{k}", None, None, "flat"), (0, "Exact{k}Wide", None, ".exact{k}-w", None), (1, "PrimaryLamp{k}Old", None, None, "Primary,ghost"), (1, "XPrimaryLamp{k}", None, None, None), (2, "Some{k}", None, ".blocky{k}__x", None), (3, "Fam{k}Long", None, "#family{k}__a", None), (3, "Fam{k}", None, ".family{k}_b", None), (4, "Sheet{k}", None, None, None), (4, "MyDialog{k}Content", None, None, None), (6, "Other{k}", "mood{k}", None, None), (6, "Twin{k}", "mood{k}", None, None)]
ROLE = "case k % 7 when 0 then concat('exact', k) when 1 then concat('primaryLamp', k, '-action') when 2 then concat('blocky', k) when 3 then concat('Family', k) when 4 then concat('dialog', k) when 5 then concat('ghost', k) else concat('mood', k) end"
BINDING_SQL = """WITH k AS (SELECT s_suppkey AS k FROM supplier), ro AS (SELECT k, CASE k % 7 WHEN 0 THEN 'exact' || k WHEN 1 THEN 'primaryLamp' || k || '-action' WHEN 2 THEN 'blocky' || k WHEN 3 THEN 'Family' || k WHEN 4 THEN 'dialog' || k WHEN 5 THEN 'ghost' || k ELSE 'mood' || k END AS role FROM k),
r AS (SELECT role, lower(replace(role, '-', '')) AS r, regexp_replace(lower(replace(role, '-', '')), 'action$', '') AS bare, k FROM ro),
c AS (SELECT replace(component, '{k}', CAST(k AS VARCHAR)) AS component, replace(ref, '{k}', CAST(k AS VARCHAR)) AS ref, replace(block, '{k}', CAST(k AS VARCHAR)) AS block, vals FROM k JOIN (VALUES (0, 'Exact{k}', NULL, NULL, 'flat'), (0, 'Exact{k}Wide', NULL, 'exact{k}', NULL), (1, 'PrimaryLamp{k}Old', NULL, NULL, 'primary'), (1, 'XPrimaryLamp{k}', NULL, NULL, NULL), (2, 'Some{k}', NULL, 'blocky{k}', NULL), (3, 'Fam{k}Long', NULL, 'family{k}', NULL), (3, 'Fam{k}', NULL, 'family{k}', NULL), (4, 'Sheet{k}', NULL, NULL, NULL), (4, 'MyDialog{k}Content', NULL, NULL, NULL), (6, 'Other{k}', 'mood{k}', NULL, NULL), (6, 'Twin{k}', 'mood{k}', NULL, NULL)) v(m, component, ref, block, vals) ON m = k % 7),
p AS (SELECT role, r, component, vals, CASE WHEN r IN (lower(component), coalesce(ref, '')) THEN 'exact' WHEN block = r THEN CASE WHEN (SELECT count(*) FROM c d WHERE d.block = c.block) = 1 THEN 'sole in block' ELSE 'block family' END WHEN k % 7 = 4 AND 'sheet' || k = lower(component) THEN 'synonym' WHEN length(bare) > 3 AND (contains(lower(component), bare) OR contains(coalesce(ref, ''), bare)) THEN 'spelling' END AS evidence FROM r, c),
e AS (SELECT *, CASE WHEN evidence IN ('exact', 'sole in block') THEN 3 WHEN evidence = 'synonym' THEN 2 ELSE 1 END AS score, r LIKE 'primary%' AND coalesce(vals, '') <> 'primary' AS weaker FROM p WHERE evidence IS NOT NULL),
b AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY score DESC, weaker, length(component), component) AS o, count(*) OVER (PARTITION BY role) AS considered FROM e), one AS (SELECT * FROM b WHERE o = 1),
t AS (SELECT one.role, coalesce(string_agg(b.component, ',' ORDER BY b.component) FILTER (b.o > 1 AND b.score = one.score AND NOT b.weaker), '') AS tied, count(*) FILTER (b.score = one.score AND NOT b.weaker) > 1 AS many, coalesce(string_agg(b.component, ',' ORDER BY b.component) FILTER (b.o > 1 AND one.score = 2 AND b.score = 1 AND contains(lower(b.component), one.r)), '') AS literal FROM one JOIN b ON b.role = one.role GROUP BY one.role)
SELECT r.role, coalesce(one.component, f.component) AS component, CASE WHEN r.r LIKE 'primary%' AND NOT one.weaker THEN 'primary' END AS variant, one.evidence, CAST(one.score AS INTEGER) AS score, CASE WHEN one.role IS NULL THEN CASE WHEN f.component IS NOT NULL THEN 'fallback' ELSE 'uncovered' END WHEN one.weaker OR one.score = 1 OR many OR literal <> '' THEN 'questionable' ELSE 'proposed' END AS state,
one.weaker, CASE WHEN many THEN tied ELSE '' END AS tied, coalesce(literal, '') AS literal, coalesce(one.considered, 0) AS considered FROM r LEFT JOIN one ON one.role = r.role LEFT JOIN t ON t.role = r.role LEFT JOIN one f ON r.k % 7 = 5 AND r.k % 2 = 0 AND f.role = 'exact' || (r.k - 5)"""


@query(BINDING_SQL)
def bindings_in_full(spark, sf_dir):
    k = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("k"))
    answers = F.array(*[F.struct(F.lit(m).alias("m"), *[F.replace(F.lit(x).cast("string"), F.lit("{k}"), F.col("k").cast("string")).alias(n) for n, x in zip(("component", "ref", "selector", "vals"), rest, strict=True)]) for m, *rest in ANSWERS])
    c = k.select("k", F.explode(answers).alias("a")).filter("a.m = k % 7").select("a.component", "a.ref", "a.selector", F.split("a.vals", ",").alias("values"))
    synonyms = k.filter("k % 7 = 4").select(F.expr(ROLE).alias("role"), F.concat(F.lit("Sheet"), "k").alias("synonym"))
    fallbacks = k.filter("k % 7 = 5 and k % 2 = 0").select(F.expr(ROLE).alias("role"), F.concat(F.lit("exact"), F.col("k") - 5).alias("via"))
    out = retrieval.bindings(k.select(F.expr(ROLE).alias("role")), c, synonyms, fallbacks)
    return out.withColumns({x: F.array_join(x, ",") for x in ("tied", "literal")})


ARTIFACTS = [
    ("k % 7 = 0", "scan.json", '{"mode": "too early to say, {k}", "enforce": {"a": {"share": 1.5}, "b": 1}, "deep": [[{"x": {"ran": false, "why": "undefined{k}"}}], {"share": "2"}]}'),
    ("k % 7 = 1", "defects.json", '{"available": false, "why": " ", "list": [1, "a", {"available": false, "why": "no scanner"}, {"ran": false}], "share": -0.25}'),
    ("k % 7 = 2", "vocabulary.json", '{"axes": {"Button{k}": {"size": {"observed": {"m": 3, "x => y": 1, "a/b": 2}}, "tone": {"observed": {"{open": 1, "a value that is far too long for one of a set": 1}}, "none": {}}}, "considered": {"registry": 5, "called": 0}}'),
    ("k % 7 = 3", "broken.json", '{"mode": "x", '),
    ("k % 7 = 4", "deep.json", '{"mode": "came apart since March", "considered": {"registry": 2}, "notMeasurableByTag": ["A", "B"], "available": "false"}'),
    ("k % 7 = 5", "fine.json", '{"mode": "came apart: 3 of {k}", "ran": true, "share": 0.5, "considered": {"registry": 2, "called": 1}, "enforce": {}}'),
    ("k % 7 = 6", "list.json", '[{"share": 2}, null, [], {"considered": {"registry": 1}}]'),
]


@query("""WITH k AS (SELECT o_orderkey AS k, CAST(o_custkey AS VARCHAR) AS slot FROM orders), f AS (SELECT * FROM (VALUES (0, 'scan.json', 'refusal with no reason', 'deep[0][0].x'), (0, 'scan.json', 'share outside 0..1', 'enforce.a = 1.5'), (0, 'scan.json', 'enforcing what the scan would not claim', '2 rule(s)'),
(1, 'defects.json', 'refusal with no reason', '(root)'), (1, 'defects.json', 'refusal with no reason', 'list[3]'), (1, 'defects.json', 'share outside 0..1', ' = -0.25'),
(2, 'vocabulary.json', 'parse debris in a measured value', 'Button{k}.size = x => y'), (2, 'vocabulary.json', 'content in a measured value', 'Button{k}.size = a/b'), (2, 'vocabulary.json', 'parse debris in a measured value', 'Button{k}.tone = {open'), (2, 'vocabulary.json', 'content in a measured value', 'Button{k}.tone = a value that is far too long for one of a set'), (2, 'vocabulary.json', 'a registry nothing calls', '5 component(s), 0 found'),
(3, 'broken.json', 'unreadable artifact', 'this file is on disk and does not parse'), (4, 'deep.json', 'a collapse claimed without a count', 'came apart since March'), (6, 'list.json', 'share outside 0..1', '[0] = 2')) v(m, file, what, detail))
SELECT slot, file, what, replace(detail, '{k}', CAST(k AS VARCHAR)) AS detail FROM k JOIN f ON m = k % 7""")
def artifact_findings(spark, sf_dir):
    """Nested artifacts, walked node by node."""
    files = written(spark, sf_dir, "orders", "o_orderkey", "o_custkey", ARTIFACTS)
    return quality.artifact_findings(files.select(F.col("repo").alias("slot"), F.col("path").alias("file"), F.col("content").alias("json")))


RISKS = [
    ("k % 3 = 0", "src/r{k}.tsx", "const id = Math.random()\nconst token{k} = Math.random()\n<a target=\"_blank\" href={x}>y</a>\n// eval(z)\nsay('never eval(x)')\nconst safe = DOMPurify.sanitize(v)\nel.innerHTML = safe\nel.outerHTML = raw\nbox.insertAdjacentHTML('beforeend', v)\nw.postMessage(m, '*')"),
    ("k % 3 = 1", "src/r{k}.ts", "const tag = document.createElement('script')\ntag.innerHTML = DOMPurify.sanitize(v)\nconst u = 'http://a{k}.test/x'\nconst w = 'http://localhost:1/'\nrun(`http://no.decl/`)\nconst o = { rejectUnauthorized: false }\nexecSync(`rm ${path}`)\nexecSync('rm x')\nnew Function('a')(eval (b))\nlet h = \"<a target='_blank'>\""),
    ("k % 3 = 2", "tests/r{k}.html", "x = <a target=\"_blank\" rel=\"noopener\">\ny = <a target='_blank'>\nconst c = { securityLevel: 'strict' }\nz.innerHTML = svg\nd = <p dangerouslySetInnerHTML={{ __html: svg }} />"),
]


@query("""WITH k AS (SELECT p_partkey AS k, CAST(p_size AS VARCHAR) AS repo FROM part) SELECT repo, CASE k % 3 WHEN 0 THEN 'src/r' || k || '.tsx' WHEN 1 THEN 'src/r' || k || '.ts' ELSE 'tests/r' || k || '.html' END AS path, line, kind, mitigated, k % 3 = 2 AS in_test FROM k JOIN (VALUES
(0, 2, 'weak-random', false), (0, 3, 'tabnabbing', true), (0, 7, 'raw-html', true), (0, 8, 'raw-html', false), (0, 9, 'raw-html', false), (0, 10, 'postmessage-wildcard', false),
(1, 2, 'script-injection', false), (1, 3, 'cleartext', false), (1, 6, 'tls-off', false), (1, 7, 'shell-injection', false), (1, 9, 'dynamic-code', false), (2, 2, 'tabnabbing', false), (2, 4, 'raw-html', true), (2, 5, 'raw-html', true)) v(m, line, kind, mitigated) ON m = k % 3""")
def dangerous_constructs(spark, sf_dir):
    return security.dangerous_patterns(written(spark, sf_dir, "part", "p_partkey", "p_size", RISKS))


def drawn_pages(spark, sf_dir):
    """An image for each supplier, in four colour types and all filters: a ground, and two cards one below the other."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            made = []
            for k in b.column("k").to_pylist():
                px = np.full((40 + k % 5, 30 + k % 11, 4), 255, np.uint8)
                px[:, :, :3] = (0xF7, 0xF7, 0xF7) if k % 4 == 0 else (0xF7, 0xF8, 0xFA)
                for top, tall in ((5, 6 + k % 4), (5 + 6 + k % 4 + 3 + k % 3, 8)):
                    px[top : top + tall, 4 : 14 + k % 9, :3] = 255
                made.append(images.encode(px, (0, 2, 3, 6)[k % 4], (0, 1, 2, 3, 4)) if k % 10 else b"no image")
            yield pa.RecordBatch.from_arrays([pa.array([str(k) for k in b.column("k").to_pylist()]), pa.array(made, pa.binary())], names=["path", "content"])

    return spread(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("k")), "k", 1_000).mapInArrow(run, "path string, content binary")


@query("""WITH k AS (SELECT s_suppkey AS k, 40 + s_suppkey % 5 AS h, 30 + s_suppkey % 11 AS w, 10 + s_suppkey % 9 AS wide, 6 + s_suppkey % 4 AS tall, 3 + s_suppkey % 3 AS gap FROM supplier), f AS (SELECT *, h - 5 - tall - gap - 8 AS rest FROM k)
SELECT CAST(k AS VARCHAR) AS image, CASE WHEN k % 10 = 0 THEN 'not a PNG' END AS why, CASE WHEN k % 10 > 0 THEN w END AS width, CASE WHEN k % 10 > 0 THEN h END AS height, CASE WHEN k % 10 > 0 THEN CASE WHEN k % 4 = 0 THEN '#f7f7f7' ELSE '#f7f8fa' END END AS ground, CASE WHEN k % 10 > 0 THEN 4 END AS "left", CASE WHEN k % 10 > 0 THEN 3 + wide END AS "right",
CASE WHEN k % 10 > 0 THEN round(wide * (tall + 8) / (w * h), 4) END AS card_share, CASE WHEN k % 10 > 0 THEN CASE WHEN gap = rest THEN CAST(gap AS VARCHAR) ELSE greatest(gap, rest) || ',' || least(gap, rest) END END AS gaps FROM f""")
def images_read(spark, sf_dir):
    """Pixels from PNG files to palette, ground, reading column and vertical gaps."""
    runs = cut(images.read_images(cut(drawn_pages(spark, sf_dir))))
    ground = styles.page_ground(images.edge_pixels(runs))
    seen = cut(images.against_ground(runs, ground))
    column = seen.filter("drawn").groupBy("image").agg(F.min("x").alias("left"), F.max(F.col("x") + F.col("n") - 1).cast("int").alias("right"))
    gaps = styles.rhythm_gaps(seen.groupBy("image", "y").agg((~F.bool_or("drawn")).alias("empty")))
    gaps = gaps.groupBy("image").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("length").alias("l")))), lambda g: g["l"].cast("string")), ",").alias("gaps"))
    card = styles.palette(runs.filter("opaque").select("image", "rgb", "n")).filter("rgb = '#ffffff'").select("image", F.col("share").alias("card_share"))
    out = runs.groupBy("image").agg(F.max("why").alias("why"), F.max("width").alias("width"), F.max("height").alias("height"))
    for more in (ground, column, card, gaps):
        out = out.join(more, "image", "left")
    return out


SOURCES = [
    ("k % 4 = 0", "src/C{k}.tsx", "const [a] = useState<any>(null); useEffect(() => {\n fetch('/x') })\nconst b = a! as Thing; // @ts-ignore\n<form onSubmit={go}><img loading='lazy' /></form>\nconst f = async () => 1"),
    ("k % 4 = 1", "src/hooks/useX{k}.tsx", "export const useX = async () => { try { await axios.get('/y') } catch (e) {} }\nuseQuery(); useMemo (() => 1); React.memo(X); memo(Y)\nclass B { componentDidCatch() {} }"),
    ("k % 4 = 2", "src/form{k}.ts", "useForm(); <form>; p.then(x)\ntype S = { kind: 'a' } | { kind: 'b' }\nlazy(() => import('./z'))"),
    ("k % 4 = 3", "src/c{k}.test.tsx", "screen.getByRole('b'); findByText('x'); getByTestId('z'); fireEvent.click(a); useState(1); fetch(1)"),
    ("k % 5 = 0", "src/s{k}.css", "@media (min-width: 1px) {} @media print {} @container x {}"),
]


@query("""WITH k AS (SELECT p_partkey AS k, CAST(p_size AS VARCHAR) AS repo FROM part), n AS (SELECT repo, count(*) FILTER (k % 4 = 0) AS a, count(*) FILTER (k % 4 = 1) AS b, count(*) FILTER (k % 4 = 2) AS c, count(*) FILTER (k % 4 = 3) AS t, count(*) FILTER (k % 5 = 0) AS s FROM k GROUP BY repo)
SELECT repo, a + b + c AS sources, t AS tests, s AS styles, a AS "any", a AS assertions, CAST(0 AS BIGINT) AS non_null, a AS suppressions, 2 * c AS discriminated_unions, a AS use_state, CAST(0 AS BIGINT) AS use_reducer, CAST(0 AS BIGINT) AS use_context, CAST(0 AS BIGINT) AS create_context, a AS use_effect, b AS server_state_hooks, 2 * b AS memo, b AS use_memo, CAST(0 AS BIGINT) AS use_callback, c AS lazy_routes, CAST(0 AS BIGINT) AS suspense, a AS lazy_images,
2 * t AS accessible_queries, t AS implementation_queries, CAST(0 AS BIGINT) AS user_event, t AS fire_event, CAST(0 AS BIGINT) AS snapshots, CAST(0 AS BIGINT) AS axe, 2 * s AS media_queries, s AS container_queries, CASE WHEN t > 0 THEN 0.667 END AS query_discipline FROM n""")
def constructs_of_sources(spark, sf_dir):
    return constructs.construct_counts(written(spark, sf_dir, "part", "p_partkey", "p_size", SOURCES))


@query("""WITH k AS (SELECT p_partkey AS k, CAST(p_size AS VARCHAR) AS repo FROM part) SELECT repo, list, CASE k % 4 WHEN 0 THEN 'src/C' || k || '.tsx' WHEN 1 THEN 'src/hooks/useX' || k || '.tsx' ELSE 'src/form' || k || '.ts' END AS path FROM k JOIN (VALUES (0, 'fetch in components'), (0, 'effect with fetch'), (0, 'hand-rolled forms'), (0, 'async with nowhere to fail'), (1, 'error boundaries'), (2, 'async with nowhere to fail')) v(m, list) ON m = k % 4""")
def files_to_look_at(spark, sf_dir):
    return constructs.file_lists(written(spark, sf_dir, "part", "p_partkey", "p_size", SOURCES))


TOOLS = [
    ("k % 3 = 0", "package.json", '{"dependencies": {"eslint": "1", "vitest": "2"}, "devDependencies": {"@playwright/test": "1"}, "scripts": {"check:all": "x", "e2e": "check y", "scan": "gitleaks z"}}'),
    ("k % 3 = 0", "src/a.test.ts", ""), ("k % 3 = 0", "docs/AGENTS.md", ""), ("k % 3 = 0", "tsconfig.json", '{"compilerOptions": { "strict" : true }}'),
    ("k % 3 = 1", "package.json", '{"devDependencies": {"jest": "1", "puppeteer": "1", "eslint-plugin-x": "1"}, "scripts": {"visual": "x", "evaluate": "1"}}'),
    ("k % 3 = 1", ".github/workflows/a.yml", ""), ("k % 3 = 1", "CLAUDE.md", ""), ("k % 3 = 1", "tsconfig.json", '{"strict": false}'), ("k % 3 = 1", "lib/tsconfig.json", '{"strict": true}'),
    ("k % 3 = 2", "package.json", "{broken"), ("k % 3 = 2", "tools/scripts/my-lint-x.mjs", ""), ("k % 3 = 2", "a.tokens.json", ""), ("k % 3 = 2", "mcp/server.ts", ""), ("k % 3 = 2", "lefthook.yml", ""),
]


@query(f"""WITH every AS (SELECT unnest({sorted(constructs.MECHANISMS)!r}) AS m), h AS (SELECT * FROM (VALUES (0, 'JS/TS linter'), (0, 'unit tests'), (0, 'strict TypeScript'), (0, 'secret scan'), (0, 'gate aggregate'), (1, 'visual baselines'), (1, 'agent evals'), (1, 'CI pipeline'), (1, 'agent contract'), (2, 'project-specific linter'), (2, 'token export (DTCG)'), (2, 'token tiers'), (2, 'MCP surface'), (2, 'pre-commit hook')) v(r, m)),
l AS (SELECT r, string_agg(every.m, ',' ORDER BY every.m) FILTER (h.m IS NOT NULL) AS present, string_agg(every.m, ',' ORDER BY every.m) FILTER (h.m IS NULL) AS missing FROM (SELECT unnest([0, 1, 2]) AS r) CROSS JOIN every LEFT JOIN h USING (r, m) GROUP BY r)
SELECT CAST(s_suppkey AS VARCHAR) AS repo, present, missing FROM supplier JOIN l ON r = s_suppkey % 3""")
def toolchain_in_full(spark, sf_dir):
    got = constructs.toolchain(constructs.tooling(written(spark, sf_dir, "supplier", "s_suppkey", "s_suppkey", TOOLS)))
    return got.withColumns({c: F.array_join(c, ",") for c in ("present", "missing")})


BEHAVING = [
    ("k % 3 = 0", "src/A{k}.tsx", "const [x] = useState(1); <i aria-expanded={x} aria-label='y' />"),
    ("k % 3 = 1", "src/B{k}.tsx", "<b onChange={f} />; setTimeout(f); if (e.key) useEffect(f)"),
    ("k % 3 = 2", "src/C{k}.tsx", "<p aria-label='nothing to test' />"),
    ("k % 2 = 0", "tests/t{k}.test.tsx", "vi.mock('../src/B{k}',\n  () => 1);\nimport { A{k} as Other, x } from '../src/index'\nimport Z from '../src/A{k}/index'"),
    ("k % 5 = 0", "src/B{k}.spec.ts", "jest.mock('./B{k}')"),
]


@query("""WITH k AS (SELECT p_partkey AS k, CAST(p_size AS VARCHAR) AS repo FROM part)
SELECT repo, 'src/A' || k || '.tsx' AS path, 'A' || k AS name, 'carries an ARIA state,holds state' AS signals FROM k WHERE k % 3 = 0 AND k % 2 <> 0 UNION ALL SELECT repo, 'src/B' || k || '.tsx', 'B' || k, 'does something on a timer,has a keyboard contract,reports a change to its caller,runs an effect' FROM k WHERE k % 3 = 1 AND k % 5 <> 0""")
def behaviour_gaps(spark, sf_dir):
    files = written(spark, sf_dir, "part", "p_partkey", "p_size", BEHAVING)
    test = F.col("path").rlike(r"[.](test|spec)[.]")
    return screens.behaviour_gaps(files.filter(~test), files.filter(test)).withColumn("signals", F.array_join(F.array_sort("signals"), ","))
