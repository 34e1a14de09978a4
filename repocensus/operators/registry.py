"""Component registries against call sites: checks, usage, axes, vocabulary, twins, bindings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.shares import floor_percent, share
from ..sources.markup import tag_usages  # noqa: F401
from .graphs import numbered

FLOOR, MOST_DISTINCT, LONGEST, DENSITY = 5, 12, 32, 0.8
LENGTH = r"^-?[0-9.]+(px|rem|em|%|vh|vw|ch|pt)$"
#: Attributes that an element takes because it is an element; a component that inherits takes them too.
DOM_ATTRIBUTES = (
    "id", "name", "type", "value", "defaultValue", "checked", "defaultChecked", "placeholder", "disabled", "required", "readOnly", "autoFocus", "autoComplete", "maxLength", "minLength",
    "min", "max", "step", "pattern", "multiple", "accept", "rows", "cols", "htmlFor", "form", "src", "alt", "href", "target", "rel", "download", "title", "tabIndex", "role", "lang", "dir",
    "width", "height", "loading", "colSpan", "rowSpan", "scope", "inputMode", "enterKeyHint",
)
#: Attributes that are never held against a registry; those that a framework reads, and bindings of events, which aren't part of what a component takes.
UNCHECKED = r"^(key|ref|className|style|data-|aria-|on[A-Z])"
FRAMEWORK = r"^(key|ref|className|class|style|id|slot|children|v-\w+|\*ng\w+|ng\w*|let-\w+|on[A-Z]\w*|@\w+|#\w+)$|^\("

#: Props that say nothing about what a component is.
UNIVERSAL = ("className", "class", "style", "id", "children", "ref", "key", "as", "asChild", "data-testid", "aria-label", "role", "tabIndex", "onClick", "disabled")


SITE = ("repo", "path", "component", "site_id")


def check_registry(usages: DataFrame, components: DataFrame, props: DataFrame, inherited: tuple[str, ...] = DOM_ATTRIBUTES) -> DataFrame:
    """usages (repo, path, component, site_id, prop, value, kind; prop null for a site without attributes) to checks: the same columns, check, ok.

    ``component``, once a site (prop null): the registry has it. ``prop``, for each attribute of a known component: it is declared, or the component
    inherits and elements take it (``inherited``). ``value``, for a literal of a declared prop with a closed set: the set has it. Keys, refs, classes, styles, data, aria and
    handlers aren't checked, nor are the attributes of parts of a component (column is_part, where components have one).
    components (component, inherits); props (component, prop, values, null: open). A null id of a site counts as one site.
    """
    part = F.coalesce("is_part", F.lit(False)) if "is_part" in components.columns else F.lit(False)
    c = components.select("component", F.coalesce("inherits", F.lit(False)).alias("inherits"), part.alias("is_part"), F.lit(True).alias("known"))
    p = props.select("component", "prop", "values", F.lit(True).alias("declared"))
    rows = usages.select(*SITE, "prop", "value", "kind").join(c, "component", "left")
    site = rows.select(*SITE, "known").distinct().select(*SITE, *[F.lit(None).cast("string").alias(x) for x in ("prop", "value", "kind")], F.lit("component").alias("check"), F.coalesce("known", F.lit(False)).alias("ok"))
    held = rows.filter(F.col("known") & ~F.col("is_part") & F.col("prop").isNotNull() & ~F.col("prop").rlike(UNCHECKED)).join(p, ["component", "prop"], "left")
    declared = F.coalesce("declared", F.lit(False))
    checks = F.array(
        F.struct(F.lit("prop").alias("check"), (declared | (F.col("inherits") & F.col("prop").isin(*inherited))).alias("ok")),
        F.when(declared & F.col("values").isNotNull() & (F.col("kind") == "string"), F.struct(F.lit("value").alias("check"), F.array_contains("values", F.col("value")).alias("ok"))),
    )
    each = held.select(*SITE, "prop", "value", "kind", F.explode(F.array_compact(checks)).alias("c"))
    return site.unionByName(each.select(*SITE, "prop", "value", "kind", "c.check", "c.ok"))


def score(checks: DataFrame, levels: list[str]) -> DataFrame:
    """Passed, total and floor percent at every level of ``levels`` and overall; level says which columns are grouped."""
    out = checks.rollup(*levels).agg(F.sum(F.col("ok").cast("long")).alias("passed"), F.count("*").alias("total"), F.grouping_id().alias("gid"))
    n = len(levels)
    level = F.lit(n) - F.length(F.regexp_replace(F.conv(F.col("gid").cast("string"), 10, 2), "0", ""))
    return out.select(*levels, level.cast("int").alias("level"), "passed", "total", floor_percent(F.col("passed"), F.col("total")).alias("percent"))


def exemplars(files: DataFrame, k: int = 3) -> DataFrame:
    """(repo, kind, path, percent, total, in_baseline): the ``k`` files to copy of each kind: full score, eight checks at least, no accepted debt."""
    good = files.filter((F.col("percent") == 100) & (F.col("total") >= 8) & ~F.col("in_baseline"))
    return good.withColumn("rank", F.row_number().over(Window.partitionBy("repo", "kind").orderBy(F.desc("percent"), F.desc("total"), "path"))).filter(F.col("rank") <= k)


def to_avoid(files: DataFrame, k: int = 8) -> DataFrame:
    bad = files.filter(F.col("in_baseline") | (F.col("percent") < 90))
    return bad.withColumn("rank", F.row_number().over(Window.partitionBy("repo").orderBy("percent", F.desc("total"), "path"))).filter(F.col("rank") <= k)


def prop_usage(usages: DataFrame) -> DataFrame:
    """(repo, component, prop, value) to n and expressions: how often a prop is given each literal, or (value null) an expression. One without a value
    is given true. What a framework reads and bindings of events are left out, and binding signs around a name ([x], :x, bind:x)."""
    name = F.regexp_extract("prop", r"^(?:v-bind:|bind:|:|\[\(|\[)?([\w.-]+?)(?:\)\]|\])?$", 1)
    rows = usages.filter(F.col("prop").isNotNull() & ~F.col("prop").rlike(FRAMEWORK)).withColumn("prop", name).filter((F.col("prop") != "") & ~F.col("prop").rlike(FRAMEWORK))
    value = F.when(F.col("kind") == "boolean", "true").when(F.col("kind") == "string", F.col("value"))
    return rows.groupBy("repo", "component", "prop", value.alias("value")).agg(F.count("*").alias("n"), F.count(F.when(F.col("kind") == "expression", 1)).alias("expressions"))


def call_sites(usages: DataFrame) -> DataFrame:
    """(repo, component, sites, files): call sites, those without attributes too, and files that have any."""
    return usages.select(*SITE).distinct().groupBy("repo", "component").agg(F.count("*").alias("sites"), F.count_distinct("path").alias("files"))


def axes(usage: DataFrame, floor: int = FLOOR) -> DataFrame:
    """Which props are a set of choices; where not, the first reason that holds. usage: repo, component, prop, value, n, expressions."""
    v = F.col("value")
    number = v.rlike("^-?[0-9]+$")
    by = usage.groupBy("repo", "component", "prop").agg(
        F.coalesce(F.sum(F.when(v.isNotNull(), F.col("n"))), F.lit(0)).alias("literals"),
        F.count(v).alias("distinct"),
        F.sum("expressions").alias("expressions"),
        F.count(F.when(number, 1)).alias("numbers"),
        F.max(F.when(number, v.try_cast("decimal(38,0)"))).alias("hi"),
        F.min(F.when(number, v.try_cast("decimal(38,0)"))).alias("lo"),
        F.count(F.when(v.rlike(LENGTH), 1)).alias("lengths"),
        F.count(F.when((F.length(v) > LONGEST) | v.rlike(r"[\s/@]|://"), 1)).alias("unfit"),
    )
    d, n = F.col("distinct"), F.col("literals")
    refused = (
        F.when(n < floor, "too few literals").when(F.col("expressions") > n, "mostly expressions").when(d < 2, "constant").when(2 * d > n, "free text")
        .when(d > MOST_DISTINCT, "too many values").when((d >= 3) & (F.col("numbers") == d) & F.coalesce(d / (F.col("hi") - F.col("lo") + 1).cast("double") >= DENSITY, F.lit(False)), "range")
        .when((F.col("lengths") > 0) & (2 * F.col("lengths") >= d), "lengths").when(F.col("unfit") > 0, "content")
    )
    return by.select("repo", "component", "prop", "literals", "distinct", "expressions", refused.alias("refused"), refused.isNull().alias("axis"))


def vocabulary(components: DataFrame, usages: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """component, sites, called: registry entries with their call sites, those without attributes too; 0 was looked for and not found.

    aliases (alias, component) are other spellings of a component; its own name always stands for itself, and of several that claim an alias the last by name has it.
    """
    sites = usages.select(*SITE).distinct().groupBy("component").agg(F.count("*").alias("sites"))
    own = components.select("component").distinct()
    if aliases is not None:
        other = aliases.join(own.withColumnRenamed("component", "alias"), "alias", "left_anti").groupBy("alias").agg(F.max("component").alias("name"))
        sites = sites.join(other.withColumnRenamed("alias", "component"), "component", "left").groupBy(F.coalesce("name", "component").alias("component")).agg(F.sum("sites").alias("sites"))
    return own.join(sites, "component", "left").select("component", F.coalesce("sites", F.lit(0)).alias("sites"), F.col("sites").isNotNull().alias("called"))


def contested(aliases: DataFrame) -> DataFrame:
    """Aliases that several components claim."""
    return aliases.groupBy("alias").agg(F.count_distinct("component").alias("claims"), F.array_sort(F.collect_set("component")).alias("components")).filter("claims > 1")


def element_sets(items: DataFrame, key: str, element: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, k, n, es): how many elements each key has within its group of ``by`` (a library), and an array of those that aren't null, those that fewest keys have first."""
    rows = cut(items.select(*by, F.col(key).alias("k"), F.col(element).alias("e")).distinct())
    df = rows.groupBy(*by, "e").agg(F.count("*").alias("df"))
    es = F.transform(F.array_sort(F.collect_list(F.when(F.col("e").isNotNull(), F.struct("df", "e")))), lambda x: x["e"])
    own = rows.join(df, [*by, "e"]) if by else rows.join(df, "e")
    nulls = rows.filter("e is null").select(*by, "k", F.lit(None).cast(dict(rows.dtypes)["e"]).alias("e"), F.lit(None).cast("long").alias("df"))
    return own.select(*by, "k", "e", "df").unionByName(nulls).groupBy(*by, "k").agg(F.count("*").alias("n"), es.alias("es"))


def similar_sets(sets: DataFrame, least: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, x, y, shared, jaccard) of pairs of rows of ``sets`` (*by, k, n, es, and what else there is; see ``element_sets``) whose jaccard similarity is ``least`` or more; x and y
    are the whole rows as structs, x that of the smaller key.

    Two sets that are so alike have an element in common among their rarest n - ceil(least * n) + 1, so only those are joined, and a pair counts where the first element
    in common is met: each is held against the other once, where they meet, and no pair is counted up by a shuffle. Sets go along with the elements
    they are looked up by, so they should be of tens or hundreds.
    """
    whole = F.struct(*[c for c in sets.columns if c not in by])
    keep = F.col("n") - F.ceil(least * F.col("n") - 1e-9).cast("int") + 1 - (F.col("n") - F.size("es"))
    met = sets.select(*by, whole.alias("x"), F.explode(F.slice("es", 1, F.greatest(keep.cast("int"), F.lit(0)))).alias("e")).hint("merge")
    fits = (F.col("x.k") < F.col("y.k")) & (F.col("x.n") >= least * F.col("y.n") - 1e-9) & (F.col("y.n") >= least * F.col("x.n") - 1e-9)
    pairs = met.join(met.withColumnRenamed("x", "y"), [*by, "e"]).filter(fits)
    pairs = pairs.select(*by, "x", "y", "e", F.explode(F.array(F.array_intersect("x.es", "y.es"))).alias("i")).filter(F.try_element_at("i", F.lit(1)) == F.col("e"))
    jac = F.size("i") / (F.col("x.n") + F.col("y.n") - F.size("i"))
    return pairs.select(*by, "x", "y", F.size("i").cast("long").alias("shared"), jac.alias("jaccard")).filter(F.col("jaccard") >= least)


def _both_ways(renders: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(*by, a, b): one of the two renders the other."""
    one = renders.select(*by, F.col("component").alias("a"), F.col("element").alias("b"))
    return one.unionByName(one.select(*by, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def twins(props: DataFrame, renders: DataFrame, prop_share: float = 0.6, render_share: float = 0.5, by: tuple[str, ...] = (), universal: tuple[str, ...] = UNIVERSAL) -> DataFrame:
    """Components (a, b) of a library (``by``) that take the same props, universal ones left out, and render the same elements; at least three props and two renders each."""
    own = element_sets(props.filter(~F.col("prop").cast("string").isin(*universal)), "component", "prop", by).filter("n >= 3")
    drawn = renders.select(*by, F.col("component").alias("k"), F.col("element").alias("r")).distinct().groupBy(*by, "k").agg(F.count("*").alias("rn"), F.collect_list("r").alias("rs")).filter("rn >= 2")
    pairs = similar_sets(cut(own.join(drawn.hint("merge"), [*by, "k"])), prop_share, by)
    apart = ~(F.coalesce(F.array_contains("x.rs", F.col("y.k")), F.lit(False)) | F.coalesce(F.array_contains("y.rs", F.col("x.k")), F.lit(False)))
    both = F.size(F.array_intersect("x.rs", "y.rs"))
    pairs = pairs.filter(apart).withColumn("drawn", both / (F.col("x.rn") + F.col("y.rn") - both)).filter(F.col("drawn") >= render_share)
    return pairs.select(*by, F.col("x.k").alias("a"), F.col("y.k").alias("b"), F.round("jaccard", 3).alias("props"), F.round("drawn", 3).alias("renders"))


def twin_states(found: DataFrame, declared: DataFrame, props: DataFrame, renders: DataFrame, by: tuple[str, ...] = (), universal: tuple[str, ...] = UNIVERSAL) -> DataFrame:
    """(*by, a, b, state) of twins found and pairs that were declared to be apart (*by, a, b).

    answered: found and declared; unanswered: found only. Of pairs declared only: uncheckable, if one of them has too few
    props or renders to be compared; composed, if one renders the other; else stale.
    """
    keys = [*by, "a", "b"]
    own = props.filter(~F.col("prop").cast("string").isin(*universal)).select(*by, "component", "prop").distinct().groupBy(*by, "component").count().filter("count >= 3")
    comparable = own.join(renders.select(*by, "component", "element").distinct().groupBy(*by, "component").count().filter("count >= 2"), [*by, "component"], "left_semi").select(*by, "component")
    d = declared.select(*by, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rows = d.withColumn("declared", F.lit(True)).join(found.select(*keys).withColumn("found", F.lit(True)), keys, "full")
    for x in ("a", "b"):
        rows = rows.join(comparable.withColumnRenamed("component", x).withColumn(f"known_{x}", F.lit(True)), [*by, x], "left")
    rows = rows.join(_both_ways(renders, by).withColumn("composed", F.lit(True)), keys, "left")
    state = F.when(F.col("found") & F.col("declared"), "answered").when(F.col("found"), "unanswered").when(F.col("known_a").isNull() | F.col("known_b").isNull(), "uncheckable").when(F.col("composed"), "composed").otherwise("stale")
    return rows.select(*keys, state.alias("state"))


def nearest_component(props: DataFrame, least: float = 0.3, by: tuple[str, ...] = ()) -> DataFrame:
    """Each component's nearest other of its library (``by``) by shared props: two at least on both sides and in common, above ``least``."""
    sets = cut(numbered(element_sets(props, "component", "prop", by).filter("n >= 2"), [*by, "k"], "place"))
    score = F.round(F.round("jaccard", 3) * 1000).cast("long")
    near = similar_sets(sets, least, by).filter(F.col("shared") >= 2).filter(F.round("jaccard", 3) > least)
    # the likeness and, of equal ones, the first by name, in one number: so each component's best is counted where its pairs are
    sides = F.array(*[F.struct(F.col(f"{a}.place").alias("place"), score.alias("score"), F.col(f"{b}.place").cast("long").alias("other")) for a, b in (("x", "y"), ("y", "x"))])
    best = near.select(F.explode(sides).alias("s")).groupBy("s.place").agg(F.max(F.col("s.score") * (1 << 32) + (1 << 31) - F.col("s.other")).alias("m")).select("place", ((1 << 31) - F.pmod(F.col("m"), F.lit(1 << 32))).cast("int").alias("other"))
    x = sets.select(*by, F.col("k").alias("component"), "place", F.col("n").alias("na"), F.col("es").alias("xs"))
    y = sets.select(F.col("place").alias("other"), F.col("k").alias("nearest"), F.col("n").alias("nb"), F.col("es").alias("ys"))
    shared = F.size(F.array_intersect("xs", "ys")).cast("long")
    return x.join(best, "place").join(y, "other").select(*by, "component", "nearest", F.round(shared / (F.col("na") + F.col("nb") - shared), 3).alias("jaccard"), shared.alias("shared"))


def parallel_implementations(defs: DataFrame, imports: DataFrame) -> DataFrame:
    """Names defined in two files or more of a repo none of which imports another: (repo, name, files)."""
    some = defs.groupBy("repo", "name").agg(F.count_distinct("path").alias("files")).filter("files >= 2")
    own = defs.join(some.select("repo", "name"), ["repo", "name"]).select("repo", "name", "path").distinct()
    linked = own.select("repo", "name", F.col("path").alias("src")).join(imports.select("repo", "src", "dst"), ["repo", "src"]).join(own.select("repo", "name", F.col("path").alias("dst")), ["repo", "name", "dst"], "left_semi")
    return some.join(linked.select("repo", "name").distinct(), ["repo", "name"], "left_anti")


def compare(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Two tables side by side: agreed, different, only in a, only in b."""
    x = a.select(*keys, F.col(value).alias("value_a"), F.lit(True).alias("in_a"))
    y = b.select(*keys, F.col(value).alias("value_b"), F.lit(True).alias("in_b"))
    state = F.when(F.col("in_b").isNull(), "only a").when(F.col("in_a").isNull(), "only b").when(F.col("value_a").eqNullSafe(F.col("value_b")), "agreed").otherwise("different")
    return x.join(y, keys, "full_outer").select(*keys, "value_a", "value_b", state.alias("state"))


def prop_vocabulary(props: DataFrame) -> DataFrame:
    """Props that two components or more declare with closed sets: each set against the widest, narrowed or collided."""
    shared = props.filter("values is not null").groupBy("prop").agg(F.count("*").alias("components"), F.max(F.struct(F.size("values").alias("n"), F.array_sort("values").alias("v"))).alias("x")).filter("components >= 2")
    rows = props.filter("values is not null").join(shared.select("prop", F.col("x.v").alias("widest")), "prop")
    extra = F.array_except("values", "widest")
    state = F.when(F.array_sort("values") == F.col("widest"), "widest").when(F.size(extra) == 0, "narrowed").otherwise("collided")
    return rows.select("prop", "component", state.alias("state"), F.size(extra).alias("outside"))


def given(rows: DataFrame, condition: str, outcome: str, least_share: float = 0.7, least: int = FLOOR) -> DataFrame:
    """The distribution of ``outcome`` given ``condition``; proposed where one outcome holds a large share of enough rows."""
    c = rows.groupBy(condition, outcome).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(condition))
    out = c.withColumn("total", total).withColumn("share", share("n", "total"))
    return out.withColumn("proposed", (F.col("share") >= least_share) & (F.col("total") >= least))


def house_prefix(names: DataFrame, lengths: tuple[int, ...] = (3, 2), least_share: float = 0.7, least: int = 4) -> DataFrame:
    """(library, name) to the head of two or three letters that most names share, the longer preferred."""
    heads = names.select("library", "name", F.explode(F.array(*map(F.lit, lengths))).alias("k")).filter(F.length("name") > F.col("k"))
    c = heads.groupBy("library", "k", F.expr("substring(name, 1, k)").alias("prefix")).agg(F.count("*").alias("n"))
    total = names.groupBy("library").agg(F.count("*").alias("total"))
    ok = c.join(total, "library").withColumn("share", share("n", "total")).filter((F.col("total") >= least) & (F.col("share") >= least_share))
    return ok.groupBy("library").agg(F.max(F.struct("k", "n", "prefix", "share", "total")).alias("x")).select("library", "x.prefix", "x.share", "x.total")
