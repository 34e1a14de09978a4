"""Module graphs: edges from text, resolution, degrees, cycles, closures and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut

SPECIFIER = r"""(?:import|export)\s+(?:[^'";]*?\s+from\s+)?['"]([^'"]+)['"]|import\(\s*['"]([^'"]+)['"]\s*\)|require\(\s*['"]([^'"]+)['"]\s*\)"""
#: What may be left out behind a specifier; the first that is a file counts.
SUFFIXES = ("", ".tsx", ".jsx", ".ts", ".vue", ".svelte", "/index.tsx", "/index.jsx", "/index.ts", "/index.vue", "/index.svelte", ".js", "/index.js")
#: Beginnings of specifiers that stand for some folder of the repo, and what is put for them.
ALIASES = {"@/": "", "~/": "", "#/": ""}
#: What only a file that declares routes says; how a route names a component, and how it names a module.
DECLARES_ROUTES = r"<Route\b|createBrowserRouter|createRoutesFromElements|RouteObject|RouteRecordRaw|createRouter\s*\(|\brouter\s*=\s*create|\bRoutes\s*=|provideRouter\s*\(|\broutes\s*(?::|=)[^=\n]{0,40}\["
ROUTED_NAMES = (r"(?:element=\{\s*<|component=\{|Component:\s*)([A-Z]\w*)", r"\bcomponent\s*:\s*([A-Z]\w*)")
ROUTED_MODULES = (r"\blazy\s*\(\s*\(\)\s*=>\s*import\s*\(\s*['\"]([^'\"]+)['\"]", r"\b(?:component|loadComponent|loadChildren)\s*:\s*\(\s*\)\s*=>\s*import\s*\(\s*['\"]([^'\"]+)['\"]")
IMPORTED = r"import\s+([^;'\"]+?)\s+from\s*['\"]([^'\"]+)['\"]"


def import_edges(files: DataFrame) -> DataFrame:
    """(repo, src, specifier) of every import, export from, dynamic import and require in the text."""
    groups = [F.regexp_extract_all("content", F.lit(SPECIFIER), F.lit(i)) for i in (1, 2, 3)]
    return files.select("repo", F.col("path").alias("src"), F.explode(F.array_distinct(F.flatten(F.array(*groups)))).alias("specifier")).filter("specifier <> ''")


def route_references(files: DataFrame) -> DataFrame:
    """(repo, src, specifier) of the modules that files which declare routes point at: those named directly (lazy, component: () => import), and
    those from which a component is imported that a route names (element, component, Component). Any other import is no route. Null content: none."""
    own = files.filter(F.col("content").rlike(DECLARES_ROUTES)).select("repo", F.col("path").alias("src"), "content")

    def every(patterns):
        return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all("content", F.lit(p), F.lit(1)) for p in patterns])))

    clauses = F.arrays_zip(F.regexp_extract_all("content", F.lit(IMPORTED), F.lit(1)).alias("clause"), F.regexp_extract_all("content", F.lit(IMPORTED), F.lit(2)).alias("spec"))
    own = own.select("repo", "src", every(ROUTED_NAMES).alias("named"), every(ROUTED_MODULES).alias("direct"), clauses.alias("imports"))
    direct = own.select("repo", "src", F.explode("direct").alias("specifier"))
    each = own.filter(F.size("named") > 0).select("repo", "src", "named", F.explode("imports").alias("i")).select("repo", "src", "named", F.regexp_replace("i.clause", r"\btype\s+", "").alias("clause"), F.col("i.spec").alias("specifier"))
    listed = F.split(F.regexp_extract("clause", r"\{([^}]*)\}", 1), ",")
    default = F.element_at(F.split(F.regexp_replace("clause", r"\{[^}]*\}", ""), ","), 1)
    bindings = F.transform(F.array_append(listed, default), lambda b: F.trim(F.element_at(F.split(F.trim(b), r"\s+as\s+"), -1)))
    by_name = each.filter(F.arrays_overlap(bindings, "named")).select("repo", "src", "specifier")
    return direct.unionByName(by_name).distinct()


def routed(files: DataFrame) -> DataFrame:
    """(repo, path): files that a router of their repo points at, each once; found as imports are (``resolve_imports``)."""
    return resolve_imports(route_references(files), files).select("repo", F.col("dst").alias("path")).distinct()


def resolve_imports(edges: DataFrame, files: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """(repo, src, specifier, dst): relative and aliased specifiers to files. Suffix by suffix a file of just that path counts, else the first by
    path that ends in it behind a slash; for an alias stands for a folder that isn't known here, and the scan may begin below it.

    Specifiers of packages are left out. Paths are looked up by equality, on one row for each path and each of its tails, not by comparing all paths.
    """
    found = F.lit(None).cast("string")
    for k, v in sorted((ALIASES if aliases is None else aliases).items()):  # of two that fit the longer wins
        found = F.when(F.col("specifier").startswith(k), F.concat(F.lit(v), F.expr(f"substring(specifier, {len(k) + 1})"))).otherwise(found)
    folder = F.regexp_replace("src", "[^/]*$", "")
    base = F.when(F.col("specifier").startswith("."), F.concat(folder, F.col("specifier"))).otherwise(found)
    # one step of the path after the other; ".." takes the folder before it away, and stays where there is none
    step = lambda done, x: F.when(x.isin("", "."), done).when((x == "..") & (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)) != ".."), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))
    plain = F.array_join(F.aggregate(F.split(base, "/"), F.array().cast("array<string>"), step), "/")
    rows = edges.withColumn("base", plain).filter("base is not null")
    tries = rows.select("repo", "src", "specifier", F.posexplode(F.array(*[F.concat("base", F.lit(s)) for s in SUFFIXES])).alias("order", "tail"))
    parts = F.split("path", "/")
    tails = F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/")))
    place = files.select("repo", "path", tails.alias("at", "tail")).groupBy("repo", "tail").agg(F.min(F.struct(F.col("at") > 0, "path")).alias("x"))  # a file of just that path before others
    # every path has a row for each of its tails: far more than its file's size lets the planner guess, so never a broadcast
    hit = tries.join(place.select("repo", "tail", F.col("x.path").alias("dst")).hint("merge"), ["repo", "tail"])
    return hit.groupBy("repo", "src", "specifier").agg(F.min(F.struct("order", "dst")).alias("x")).select("repo", "src", "specifier", "x.dst")


def in_degree(edges: DataFrame) -> DataFrame:
    """(repo, module, fan_in): distinct modules that import it, itself left out."""
    return edges.filter("src <> dst").groupBy("repo", F.col("dst").alias("module")).agg(F.count_distinct("src").alias("fan_in"))


def orphans(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """Modules that nothing imports."""
    return modules.join(edges.filter("src <> dst").select("repo", F.col("dst").alias("module")).distinct(), ["repo", "module"], "left_anti")


def cross_feature(edges: DataFrame, pattern: str = r"^(.*/features|features)/([^/]+)/") -> DataFrame:
    """Edges between sibling features under one root."""
    root = [F.regexp_extract(c, pattern, 1) for c in ("src", "dst")]
    own = [F.regexp_extract(c, pattern, 2) for c in ("src", "dst")]
    return edges.filter((own[0] != "") & (own[1] != "") & (root[0] == root[1]) & (own[0] != own[1]))


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges between modules that are imported and import; one layer of those on no cycle goes."""
    edges = edges.join(edges.select("repo", F.col("dst").alias("src")).distinct(), ["repo", "src"], "left_semi")
    return cut(edges.join(edges.select("repo", F.col("src").alias("dst")).distinct(), ["repo", "dst"], "left_semi"))


def _between(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(repo, node, prv, nxt) of nodes with a single edge in (from prv) and a single one out (to nxt); edges go from ``a`` to ``b``."""
    ins = edges.groupBy("repo", F.col(b).alias("node")).agg(F.count("*").alias("i"), F.min(a).alias("prv")).filter("i = 1")
    outs = edges.groupBy("repo", F.col(a).alias("node")).agg(F.count("*").alias("o"), F.min(b).alias("nxt")).filter("o = 1")
    return ins.join(outs, ["repo", "node"]).select("repo", "node", "prv", "nxt")


def _contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Edges (repo, src, dst) with chains of nodes between put together to one edge, the chains' nodes (repo, node, prv, nxt: where their chain comes from and
    leads to), and rings of such nodes alone (repo, node, component). None if no node is between. Pointers double, so a chain takes as many rounds as its length has binary digits.
    """
    mid = cut(_between(edges, "src", "dst").withColumn("low", F.col("node")))
    n = mid.count()
    if not n:
        return None
    for _ in range(n.bit_length() + 1):
        to = mid.select("repo", F.col("node").alias("nxt"), F.col("nxt").alias("nxt2"), F.col("low").alias("low2"))
        fro = mid.select("repo", F.col("node").alias("prv"), F.col("prv").alias("prv2"))
        both = mid.join(to, ["repo", "nxt"], "left").join(fro, ["repo", "prv"], "left")
        mid = cut(both.select("repo", "node", F.coalesce("prv2", "prv").alias("prv"), F.coalesce("nxt2", "nxt").alias("nxt"), F.least("low", F.coalesce("low2", "low")).alias("low"), (F.col("nxt2").isNotNull() | F.col("prv2").isNotNull()).alias("open")))
        if mid.filter("open").isEmpty():
            break
    names = mid.select("repo", F.col("node").alias("nxt"))
    ring = mid.join(names, ["repo", "nxt"], "left_semi").select("repo", "node", F.col("low").alias("component"))
    chain = cut(mid.join(names, ["repo", "nxt"], "left_anti").select("repo", "node", "prv", "nxt"))
    gone = mid.select("repo", "node")
    rest = edges.join(gone.select("repo", F.col("node").alias("src")), ["repo", "src"], "left_anti").join(gone.select("repo", F.col("node").alias("dst")), ["repo", "dst"], "left_anti")
    return cut(rest.unionByName(chain.select("repo", F.col("prv").alias("src"), F.col("nxt").alias("dst"))).distinct()), chain, cut(ring)


def _spread(edges: DataFrame, labels: DataFrame, back: bool) -> DataFrame:
    """The smallest label that reaches each node along the edges (against them with ``back``), to a fixpoint."""
    a, b = ("dst", "src") if back else ("src", "dst")
    while True:
        sent = edges.join(labels.select("repo", F.col("node").alias(a), "label"), ["repo", a]).select("repo", F.col(b).alias("node"), "label")
        now = cut(labels.unionByName(sent).groupBy("repo", "node").agg(F.min("label").alias("label")))
        if now.exceptAll(labels).isEmpty():
            return labels
        labels = now


def cycles(edges: DataFrame) -> DataFrame:
    """(repo, node, component, size) of every module on an import cycle; component is the smallest module of its strongly connected component.

    First the graph shrinks: chains of modules with one importer and one import become one edge, and modules on no cycle go from the ends, in turn, so
    long chains and rings take as many rounds as their length has binary digits. In what is left labels spread: a module whose
    smallest reaching label comes back to it against the edges too is in that label's component; found components are taken out until nothing is left. A chain's modules are
    in the component of its two ends if that is one. Imports of itself don't count. Empty edges: empty result.
    """
    left = cut(edges.filter("src <> dst").select("repo", "src", "dst").distinct())
    chains, found = [], edges.select("repo", F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    while not left.isEmpty():
        n, shorter = left.count(), _contracted(left)
        if shorter is not None:
            left, chain, ring = shorter
            chains.append(chain)
            found = found.unionByName(ring)
        left = _trimmed(left)
        if shorter is None and left.count() == n:
            break
    while not left.isEmpty():
        nodes = left.select("repo", F.col("src").alias("node")).unionByName(left.select("repo", F.col("dst").alias("node"))).distinct()
        fore = _spread(left, nodes.withColumn("label", F.col("node")), back=False)
        same = left.join(fore.select("repo", F.col("node").alias("src"), F.col("label").alias("la")), ["repo", "src"]).join(fore.select("repo", F.col("node").alias("dst"), F.col("label").alias("lb")), ["repo", "dst"]).filter("la = lb").select("repo", "src", "dst")
        roots = fore.filter("node = label")
        back = _spread(same, roots.select("repo", "node", "label"), back=True)
        part = cut(back.join(fore.select("repo", "node", F.col("label").alias("fl")), ["repo", "node"]).filter("label = fl").select("repo", "node", F.col("label").alias("component")))
        found = found.unionByName(part)
        gone = part.select("repo", "node")
        left = cut(left.join(gone.select("repo", F.col("node").alias("src")), ["repo", "src"], "left_anti").join(gone.select("repo", F.col("node").alias("dst")), ["repo", "dst"], "left_anti"))
        while not left.isEmpty():
            n, left = left.count(), _trimmed(left)
            if left.count() == n:
                break
    for chain in reversed(chains):
        ends = [found.select("repo", F.col("node").alias(c), F.col("component").alias(f"{c}_component")) for c in ("prv", "nxt")]
        on = chain.join(ends[0], ["repo", "prv"]).join(ends[1], ["repo", "nxt"]).filter("prv_component = nxt_component").select("repo", "node", F.col("prv_component").alias("component"))
        found = cut(found.unionByName(on))
    by = found.groupBy("repo", "component").agg(F.count("*").alias("size"), F.min("node").alias("first")).filter("size > 1")
    return found.join(by, ["repo", "component"]).select("repo", "node", F.col("first").alias("component"), "size")


def requires_closure(selected: DataFrame, requires: DataFrame, satisfied: DataFrame | None = None) -> DataFrame:
    """(item, pulled_in_by): selected items (pulled in by null) and all they require, each by the first item (by name) of the round it came in; satisfied ones are skipped."""
    needs = requires.select("item", "needs")
    if satisfied is not None:
        needs = needs.join(satisfied.select(F.col("item").alias("needs")), "needs", "left_anti")
    have = cut(selected.select("item", F.lit(None).cast("string").alias("pulled_in_by")).distinct())
    front = have
    while True:
        new = front.join(needs, "item").select(F.col("needs").alias("n"), F.col("item").alias("by")).groupBy("n").agg(F.min("by").alias("pulled_in_by")).withColumnRenamed("n", "item")
        front = cut(new.join(have, "item", "left_anti"))
        if front.isEmpty():
            return have
        have = cut(have.unionByName(front))


def levels(need: DataFrame) -> DataFrame:
    """(item, needs) to (item, level): the longest chain of needs below, 0 for what needs nothing; null on a cycle or above one.

    Items whose needs are all placed are placed, and chains of items with one need and one that needs them become one edge with their length, in turn; so a
    long chain takes as many rounds as its length has binary digits. base is the least level that what was taken out before leaves an item.
    """
    e = cut(need.select("item", "needs").distinct().withColumn("w", F.lit(1).cast("long")))
    items = e.select("item").unionByName(e.select(F.col("needs").alias("item"))).distinct()
    base = cut(items.withColumn("base", F.lit(0).cast("long")))
    placed, chains = None, []

    def raised(base: DataFrame, more: DataFrame) -> DataFrame:
        return cut(base.unionByName(more).groupBy("item").agg(F.max("base").alias("base")))

    while not base.isEmpty():
        ready = cut(base.join(e.select("item").distinct(), "item", "left_anti").withColumnRenamed("base", "level"))
        some = not ready.isEmpty()
        if some:
            placed = ready if placed is None else placed.unionByName(ready)
            over = e.join(ready.withColumnRenamed("item", "needs"), "needs").select("item", (F.col("level") + F.col("w")).alias("base"))
            base = raised(base.join(ready.select("item"), "item", "left_anti"), over)
            e = cut(e.join(ready.select(F.col("item").alias("needs")), "needs", "left_anti"))
        mid = _between(e.select(F.lit(0).alias("repo"), "item", "needs"), "item", "needs").select(F.col("node").alias("item"), F.col("nxt").alias("to"))
        mid = cut(mid.join(e.select("item", F.col("w").alias("far")), "item").join(base.withColumnRenamed("base", "best"), "item"))
        n = mid.count()
        for _ in range(n.bit_length() + 1 if n else 0):
            nxt = mid.select(F.col("item").alias("to"), F.col("to").alias("to2"), F.col("far").alias("far2"), F.col("best").alias("best2"))
            mid = cut(mid.join(nxt, "to", "left").select("item", F.coalesce("to2", "to").alias("to"), (F.col("far") + F.coalesce("far2", F.lit(0))).alias("far"), F.greatest("best", F.coalesce(F.col("best2") + F.col("far"), F.col("best"))).alias("best"), F.col("to2").isNotNull().alias("open")))
            if mid.filter("open").isEmpty():
                break
        chain = cut(mid.join(mid.select(F.col("item").alias("to")), "to", "left_anti").select("item", "to", "far", "best"))  # rings lead to themselves and stay
        if not chain.isEmpty():
            chains.append(chain)
            heads = e.join(chain.select(F.col("item").alias("needs"), "to", "far", "best"), "needs").join(chain.select("item"), "item", "left_anti")
            base = raised(base.join(chain.select("item"), "item", "left_anti"), heads.select("item", (F.col("best") + F.col("w")).alias("base")))
            kept = e.join(chain.select("item"), "item", "left_anti").join(chain.select(F.col("item").alias("needs")), "needs", "left_anti")
            e = cut(kept.unionByName(heads.select("item", F.col("to").alias("needs"), (F.col("w") + F.col("far")).alias("w"))).groupBy("item", "needs").agg(F.max("w").alias("w")))
        elif not some:
            break  # all that is left lies on a cycle or above one
    out = placed if placed is not None else items.withColumn("level", F.lit(None).cast("long")).limit(0)
    for chain in reversed(chains):
        out = cut(out.unionByName(chain.join(out.select(F.col("item").alias("to"), F.col("level").alias("under")), "to").select("item", F.greatest("best", F.col("under") + F.col("far")).alias("level"))))
    return items.join(out.hint("merge"), "item", "left")


def install_order(items: DataFrame, requires: DataFrame, rank: str) -> DataFrame:
    """Items with their level (longest chain of requirements below) and position: dependencies first, then ``rank``, then name. Items on a cycle, or above one, have no level."""
    need = requires.join(items.select("item"), "item", "left_semi").join(items.select(F.col("item").alias("needs")), "needs", "left_semi").select("item", "needs").distinct()
    need = cut(need)
    level = levels(need)
    free = items.select("item").join(need.select("item").unionByName(need.select(F.col("needs").alias("item"))).distinct(), "item", "left_anti").distinct().withColumn("level", F.lit(0).cast("long"))
    out = cut(items.join(level.unionByName(free).withColumn("level", F.col("level").cast("int")).hint("merge"), "item", "left"))
    return numbered(out, [F.col("level").asc_nulls_last(), F.col(rank), F.col("item")], "position")


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with the place (from 1) of each row in a global order: rows are dealt into ranges, placed within theirs, and moved by the sizes of the ranges before."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(width, *order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))  # a row for each range
    placed = dealt.withColumn("_place", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return placed.join(F.broadcast(before), "_range").withColumn(name, (F.col("_place") + F.col("_before")).cast("int")).drop("_range", "_place", "_before")
