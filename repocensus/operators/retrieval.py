"""Retrieval by words: rankings, their evaluation, near misses, drafts from cues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STOP = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")


def words(text: Column, stop: tuple[str, ...] = STOP) -> Column:
    """Distinct lower-case words of a text, camelCase cut apart, stop words left out."""
    cut = F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(cut), F.lit("[a-z0-9]+"), F.lit(0))), F.array(*map(F.lit, stop)))


#: Pairs of a query and a document that a task may have to count.
PAIRS_A_TASK = 2_000_000


def score_docs(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query, doc, score): number of distinct words in common; documents without one aren't found.

    Only the words of the queries go on from the documents, so an inverted index of the rest is never built. They are dealt by document over as many
    tasks as there may be pairs, and counted there: pairs aren't shuffled, and a task has no more of them on larger tables.
    """
    q = queries.select("query", F.explode(words(F.col("text"))).alias("w"))
    asked = q.select("w").distinct()
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-docs.count() * queries.count() // PAIRS_A_TASK))
    d = docs.select("doc", F.explode(words(F.col("text"))).alias("w")).join(asked, "w", "left_semi").repartition(tasks, "doc")
    return q.join(d, "w").groupBy("query", "doc").agg(F.count("*").alias("score"))


def rank_docs(queries: DataFrame, docs: DataFrame, k: int | None = None) -> DataFrame:
    """(query, doc, score, rank) by words in common, ties by doc; with ``k`` the first so many of each query."""
    ranked = score_docs(queries, docs).withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc")))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def ranks_of(queries: DataFrame, docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query, doc, rank) of wanted (query, doc) pairs as ``rank_docs`` would rank them, those found at all: one more than the documents above it.

    Documents above are counted, in the tasks first; no query's documents are ordered or held together.
    """
    own = wanted.join(queries.select("query", F.col("text").alias("q")), "query").join(docs.select("doc", F.col("text").alias("d")), "doc")
    own = own.select("query", "doc", F.size(F.array_intersect(words(F.col("q")), words(F.col("d")))).alias("own")).filter("own > 0")  # words of wanted documents alone
    above = score_docs(queries, docs).join(own.select("query", F.col("doc").alias("wanted"), "own"), "query").filter("score > own or (score = own and doc < wanted)")
    n = above.groupBy("query", F.col("wanted").alias("doc")).agg(F.count("*").alias("n"))
    return own.join(n, ["query", "doc"], "left").select("query", "doc", (F.coalesce("n", F.lit(0)) + 1).alias("rank"))


def retrieval_eval(ranked: DataFrame, wanted: DataFrame, least: int = 5) -> DataFrame:
    """Over wanted (query, doc): how many are first, how many found, mean reciprocal rank; null with a reason below ``least`` queries."""
    rows = wanted.join(ranked.select("query", "doc", "rank"), ["query", "doc"], "left")
    by = rows.agg(F.count_distinct("query").alias("queries"), F.count(F.when(F.col("rank") == 1, 1)).alias("first"), F.count("rank").alias("found"), F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("m"))
    ok = F.col("queries") >= least
    return by.select("queries", F.when(ok, F.col("first")).alias("top1"), F.when(ok, F.col("found")).alias("found"), F.when(ok, F.round("m", 4)).alias("mrr"), F.when(~ok, "too few distinct queries").alias("why"))


def grams(text: Column, n: int) -> Column:
    """The distinct runs of ``n`` characters of a text; none of a shorter one."""
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def holding(needles: DataFrame, texts: DataFrame, n: int = 3) -> DataFrame:
    """(needle, id) of the texts (id, text) that hold a needle, each pair once; found by an inverted index, without comparing all.

    A text that holds a needle has all its runs of ``n`` characters, so they meet on that run of the needle which fewest texts have, and only those that
    meet are searched. Needles below ``n`` characters meet on themselves. Empty and null needles stand in nothing.
    """
    wanted = needles.select("needle").filter("needle <> ''").distinct()
    out = None
    for size in sorted({min(r[0], n) for r in wanted.select(F.least(F.length("needle"), F.lit(n))).distinct().collect()}):  # 1 to n
        own = wanted.filter(F.least(F.length("needle"), F.lit(n)) == size).select("needle", F.explode(grams(F.col("needle"), size)).alias("gram"))
        index = texts.select("id", F.explode(grams(F.col("text"), size)).alias("gram")).join(own.select("gram").distinct(), "gram", "left_semi")
        rare = own.join(index.groupBy("gram").agg(F.count("*").alias("n")), "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("x"))
        met = rare.filter("x.n > 0").select("needle", "x.gram").join(index, "gram").select("needle", "id")
        hit = met.join(texts.select("id", "text"), "id").filter(F.expr("contains(text, needle)")).select("needle", "id").distinct()
        out = hit if out is None else out.unionByName(hit)
    return out if out is not None else needles.select("needle").limit(0).join(texts.select("id").limit(0))


def near_misses(needs: DataFrame, registry: DataFrame, k: int = 5) -> DataFrame:
    """(need, component, score, rank): words of four letters or more of a need that stand in a component's text, three more if in its name."""
    each = needs.select("need", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("need"), F.lit("[a-z]{4,}"), F.lit(0)))).alias("w"))
    # a word has letters only, so none reaches over the line between name and text; a word is looked up once, however many needs have it
    texts = registry.select(F.struct("component").alias("id"), F.concat_ws("\n", F.lower("component"), F.lower("text")).alias("text"))
    held = holding(each.select(F.col("w").alias("needle")), texts).select(F.col("needle").alias("w"), "id.component")
    points = F.when(F.expr("contains(lower(component), w)"), 4).otherwise(1)
    by = each.join(held.withColumn("points", points), "w").groupBy("need", "component").agg(F.sum("points").alias("score"))
    return by.withColumn("rank", F.row_number().over(Window.partitionBy("need").orderBy(F.desc("score"), "component"))).filter(F.col("rank") <= k)


def draft_roles(requirements: DataFrame, cues: DataFrame) -> DataFrame:
    """(id, clause, role, cue): each clause of a requirement with the first cue (by rank) of each role that stands in it. cues: role, cue, rank."""
    clause = requirements.select("id", F.posexplode(F.split(F.lower("text"), r"[.;,]\s*|\s+and\s+")).alias("clause", "words"))
    hit = clause.join(F.broadcast(cues), F.expr("contains(words, cue)"))
    return hit.groupBy("id", "clause", "role").agg(F.min(F.struct("rank", "cue")).alias("x")).select("id", "clause", "role", "x.cue")


def _flat(c) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def propose_bindings(roles: DataFrame, registry: DataFrame, synonyms: DataFrame) -> DataFrame:
    """role to its best component: 3 for the same name, 2 for a synonym, 1 where one name holds the other; a tie is questionable, none is uncovered."""
    r, c = roles.select("role", _flat("role").alias("r")), registry.select("component", _flat("component").alias("c"))
    same = r.join(c, F.col("r") == F.col("c")).select("role", "component", F.lit(3).alias("score"))
    also = synonyms.select("role", _flat("synonym").alias("c")).join(roles.select("role"), "role").join(c, "c").select("role", "component", F.lit(2).alias("score"))
    within = holding(r.select(F.col("r").alias("needle")), c.select(F.col("component").alias("id"), F.col("c").alias("text"))).join(r, F.col("needle") == F.col("r")).select("role", F.col("id").alias("component"), F.lit(1).alias("score"))
    around = holding(c.select(F.col("c").alias("needle")), r.select(F.col("role").alias("id"), F.col("r").alias("text"))).join(c, F.col("needle") == F.col("c")).select(F.col("id").alias("role"), "component", F.lit(1).alias("score"))
    rows = same.unionByName(also).unionByName(within).unionByName(around).groupBy("role", "component").agg(F.max("score").alias("score"))
    best = rows.groupBy("role").agg(F.min(F.struct((-F.col("score")).alias("m"), "component")).alias("x"), F.max("score").alias("score"))
    ties = rows.groupBy("role", "score").agg(F.count("*").alias("ties"))
    out = roles.select("role").join(best, "role", "left").join(ties, ["role", "score"], "left")
    state = F.when(F.col("score").isNull(), "uncovered").when(F.col("ties") > 1, "questionable").otherwise("proposed")
    return out.select("role", F.col("x.component").alias("component"), "score", state.alias("state"))


#: Tones that a role's name may begin with; endings that say what kind of role it is.
TONE, KIND = r"^(primary|secondary|danger|warning|success|info)", r"(action|input|state|message|tag)$"
#: Evidence in the order in which it is looked for, and its strength.
EVIDENCE = {"exact": 3, "sole in block": 3, "block family": 1, "synonym": 2, "spelling": 1}


def bindings(roles: DataFrame, components: DataFrame, synonyms: DataFrame, fallbacks: DataFrame) -> DataFrame:
    """Which component answers each role, on what evidence, and how far that can be trusted.

    roles (role); components (component, ref, selector, values: those its props take; all but the first may be null); synonyms (role, synonym); fallbacks (role, via).
    Out: role, component, variant, evidence, score, state, weaker, tied, literal, considered.

    A component's evidence is the first that holds: its name or ref is the role's; it is the only one in the block of that name, or one of several there; it
    is named by a synonym; its name holds the role's without its ending, if that has over three letters. A tone in the role's name has to be a
    value the component takes, else it is ``weaker``. Best is the strongest, then not weaker, the shortest name, the first. ``proposed`` if nothing speaks against it;
    ``questionable`` if it rests on spelling or a family, is weaker, is tied (``tied``: the others as strong), or is a synonym while others bear the role's own word
    (``literal``); ``fallback`` if nothing answers but another role does that stands in for it; else ``uncovered``. Null roles and components are left out.
    """
    r = roles.select("role").filter("role is not null").distinct().withColumn("r", _flat("role"))
    r = r.withColumn("tone", F.nullif(F.regexp_extract("r", TONE, 1), F.lit(""))).withColumn("bare", F.regexp_replace("r", KIND, ""))
    c = components.filter("component is not null").withColumn("block", F.nullif(_flat(F.element_at(F.split(F.regexp_replace("selector", "^[.#]", ""), "[^a-zA-Z0-9]"), 1)), F.lit("")))
    names = c.select("component", F.explode(F.array_distinct(F.array_compact(F.array(_flat("component"), _flat("ref"))))).alias("name")).filter("name <> ''")
    shared = c.filter("block is not null").groupBy("block").agg(F.count("*").alias("members"))
    order = {e: i for i, e in enumerate(EVIDENCE)}

    def found(rows: DataFrame, evidence: Column) -> DataFrame:
        return rows.select("role", "component", evidence.alias("evidence"))

    block = r.join(c.select("component", "block"), F.col("r") == F.col("block")).join(shared, "block")
    spelt = holding(r.filter("length(bare) > 3").select(F.col("bare").alias("needle")), names.select(F.struct("component", "name").alias("id"), F.col("name").alias("text")))
    every = (
        found(r.join(names, F.col("r") == F.col("name")), F.lit("exact"))
        .unionByName(found(block, F.when(F.col("members") == 1, "sole in block").otherwise("block family")))
        .unionByName(found(synonyms.select("role", _flat("synonym").alias("name")).join(r.select("role"), "role").join(names, "name"), F.lit("synonym")))
        .unionByName(found(spelt.select(F.col("needle").alias("bare"), "id.component").join(r.filter("length(bare) > 3"), "bare"), F.lit("spelling")))
    )
    rank, strength = (F.create_map(*[F.lit(x) for pair in m.items() for x in pair]) for m in (order, EVIDENCE))
    first = every.groupBy("role", "component").agg(F.min(F.struct(rank[F.col("evidence")].alias("o"), "evidence")).alias("e")).select("role", "component", "e.evidence", strength[F.col("e.evidence")].alias("score"))
    takes = c.select("component", F.transform(F.coalesce("values", F.array().cast("array<string>")), _flat).alias("takes"))
    rows = first.join(r, "role").join(takes, "component").withColumn("weaker", F.coalesce(F.col("tone").isNotNull() & ~F.array_contains("takes", F.col("tone")), F.lit(False)))
    key = F.struct((-F.col("score")).alias("s"), "weaker", F.length("component").alias("l"), "component", "evidence", "tone")
    best = rows.groupBy("role").agg(F.min(key).alias("b"), F.count("*").alias("considered")).select("role", "considered", (-F.col("b.s")).alias("best"), F.col("b.component").alias("chosen"), F.col("b.weaker").alias("chosen_weaker"), F.col("b.evidence").alias("chosen_evidence"), F.col("b.tone").alias("chosen_tone"))
    other = rows.join(best.select("role", "best", "chosen"), "role").filter("component <> chosen")
    lists = other.groupBy("role").agg(
        F.array_sort(F.collect_set(F.when((F.col("score") == F.col("best")) & ~F.col("weaker"), F.col("component")))).alias("tied"),
        F.array_sort(F.collect_set(F.when((F.col("best") == 2) & (F.col("score") == 1) & F.expr("contains(lower(component), r)"), F.col("component")))).alias("literal"),
    )
    none = F.array().cast("array<string>")
    out = r.select("role").join(best, "role", "left").join(lists, "role", "left")
    out = out.withColumns({"tied": F.coalesce("tied", none), "literal": F.coalesce("literal", none)})  # none is as strong as a weaker best without being it
    weak = F.col("chosen_weaker") | (F.col("best") == 1) | (F.size("tied") > 0) | (F.size("literal") > 0)
    stands_in = fallbacks.groupBy("role").agg(F.min("via").alias("via")).join(best.select(F.col("role").alias("via"), F.col("chosen").alias("borrowed")), "via")
    out = out.join(stands_in.select("role", "borrowed"), "role", "left")
    state = F.when(F.col("chosen").isNotNull(), F.when(weak, "questionable").otherwise("proposed")).when(F.col("borrowed").isNotNull(), "fallback").otherwise("uncovered")
    variant = F.when(~F.col("chosen_weaker"), F.col("chosen_tone"))
    return out.select("role", F.coalesce("chosen", "borrowed").alias("component"), variant.alias("variant"), F.col("chosen_evidence").alias("evidence"), F.col("best").alias("score"), state.alias("state"), F.col("chosen_weaker").alias("weaker"), "tied", "literal", F.coalesce("considered", F.lit(0)).alias("considered"))


def containing(docs: DataFrame, passages: DataFrame, anchor: int = 3) -> DataFrame:
    """(query, doc): documents (doc, text) in which a passage (query, passage) stands as it is.

    Words that stand between two spaces in a passage stand so in every text that has it, so texts and passages meet by
    equality on ``anchor`` such words, the passage's first; only those that meet are searched. Shorter passages are looked
    up by fewer words, and those without a word between two spaces are compared with every text.
    """
    words = F.split("passage", " ")
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    p = passages.withColumn("n", F.least(F.size(inner), F.lit(anchor))).withColumn("key", F.xxhash64(F.slice(inner, 1, anchor)))
    out = None
    for r in p.select("n").distinct().collect():  # 0 to ``anchor``
        n, own = r["n"], p.filter(F.col("n") == r["n"]).select("query", "passage", "key")
        if n == 0:
            hit = docs.join(own, F.expr("contains(text, passage)"))
        else:
            keys = F.transform(F.array(F.split("text", " ")), lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, n)))))  # noqa: B023
            at = docs.select("doc", F.explode(F.flatten(keys)).alias("key")).join(own.select("query", "key"), "key").select("doc", "query").distinct()
            hit = at.join(own.select("query", "passage"), "query").join(docs, "doc").filter(F.expr("contains(text, passage)"))
        hit = hit.select("query", "doc")
        out = hit if out is None else out.unionByName(hit)
    return out.distinct() if out is not None else passages.select("query").crossJoin(docs.select("doc")).limit(0)
