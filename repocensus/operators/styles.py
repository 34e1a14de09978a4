"""Style measurements: literals, scales, tokens, contrast, palettes, layout."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import colours as C
from ..functions.lineage import cut
from ..functions.shares import share
from .graphs import numbered

#: Kind to (pattern, least uses, most values).
SCALES = {
    "palette": (r"#[0-9a-fA-F]{6}\b|#[0-9a-fA-F]{3}\b", 3, 16),
    "family": (r"font-family:\s*([^;}]+)", 2, 5),
    "size": (r"font-size:\s*([^;}]+)", 3, 12),
    "weight": (r"font-weight:\s*([^;}]+)", 2, 6),
    "line-height": (r"line-height:\s*([^;}]+)", 3, 6),
    "spacing": (r"(?:margin|padding|gap):\s*([^;}]+)", 4, 12),
    "radius": (r"border-radius:\s*([^;}]+)", 2, 8),
    "shadow": (r"box-shadow:\s*([^;}]+)", 2, 5),
    "motion": (r"transition-duration:\s*([^;}]+)", 2, 5),
    "breakpoint": (r"min-width:\s*([^;)}]+)", 1, 8),
}


def hardcoded(files: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` files of each repo with most hex colours and px lengths."""
    counted = files.select("repo", "path", F.regexp_count("content", F.lit(r"#[0-9a-fA-F]{6}\b")).cast("long").alias("hex"), F.regexp_count("content", F.lit(r"\b[0-9]+px\b")).cast("long").alias("px"))
    counted = counted.withColumn("total", F.col("hex") + F.col("px")).filter("total > 0")
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("total"), "path"))).filter(F.col("rank") <= k)


def css_scales(css: DataFrame, scales: dict | None = None) -> DataFrame:
    """repo, kind, value, uses, rank: values by frequency, those of too few uses left out, at most so many of a kind."""
    scales = scales or SCALES
    cases = []
    for kind, (p, least, most) in sorted(scales.items()):
        group = 1 if "(" in p.replace("(?:", "") else 0
        cases.append(F.struct(F.lit(kind).alias("kind"), F.regexp_extract_all("content", F.lit(p), F.lit(group)).alias("values"), F.lit(least).alias("least"), F.lit(most).alias("most")))
    each = css.select("repo", F.explode(F.array(*cases)).alias("c")).select("repo", "c.kind", "c.least", "c.most", F.explode("c.values").alias("value"))
    used = each.groupBy("repo", "kind", "least", "most", F.lower(F.trim("value")).alias("value")).agg(F.count("*").alias("uses")).filter("uses >= least")
    rank = F.row_number().over(Window.partitionBy("repo", "kind").orderBy(F.desc("uses"), "value"))
    return used.withColumn("rank", rank).filter("rank <= most").select("repo", "kind", "value", "uses", "rank")


def ordinal_names(scale: DataFrame) -> DataFrame:
    """Scale steps named by their rank: spacing-01, spacing-02, ..."""
    return scale.withColumn("name", F.concat_ws("-", "kind", F.lpad(F.col("rank").cast("string"), 2, "0")))


def first_declared(decls: DataFrame) -> DataFrame:
    """(repo, token, value): the first declaration of a custom property by file and order wins."""
    own = decls.filter(F.col("prop").startswith("--"))
    first = own.groupBy("repo", F.col("prop").alias("token")).agg(F.min(F.struct("file", "rule_id", "ord", "value")).alias("x"))
    return first.select("repo", "token", F.trim("x.value").alias("value"), F.col("x.file").alias("file"))


def references(files: DataFrame) -> DataFrame:
    """(repo, token) that any file reads by var(), each once."""
    return files.select("repo", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"var\(\s*(--[\w-]+)"), F.lit(1)))).alias("token")).distinct()


def dead_tokens(declared: DataFrame, referenced: DataFrame) -> DataFrame:
    return declared.join(referenced, ["repo", "token"], "left_anti")


def resolve_aliases(tokens: DataFrame) -> DataFrame:
    """(repo, token, value) to resolved values: aliases var(--x) or {x} are followed to a literal; else why not (dangling, loop).

    Chains are followed by doubling until nothing is open, or each step is longer than there are tokens: what is still
    open then is a loop.
    """
    target = F.coalesce(F.nullif(F.regexp_extract("value", r"^var\(\s*(--[\w-]+)\s*\)$", 1), F.lit("")), F.nullif(F.regexp_extract("value", r"^\{([^}]+)\}$", 1), F.lit("")))
    state = tokens.select("repo", "token", target.alias("next"), "value").withColumn("value", F.when(F.col("next").isNull(), F.col("value"))).withColumn("dangling", F.lit(False))
    state = cut(state)
    for _ in range(state.count().bit_length() + 1):
        if state.filter("next is not null").isEmpty():
            break
        to = state.select("repo", F.col("token").alias("next"), F.col("next").alias("n2"), F.col("value").alias("v2"), F.col("dangling").alias("d2"), F.lit(True).alias("known"))
        follows = F.col("next").isNotNull()
        state = state.join(to, ["repo", "next"], "left").select(
            "repo", "token", F.when(F.col("known"), F.col("n2")).alias("next"), F.when(follows, F.col("v2")).otherwise(F.col("value")).alias("value"),
            F.when(follows & F.col("known").isNull(), True).when(follows, F.col("d2")).otherwise(F.col("dangling")).alias("dangling"),
        )
        state = cut(state)
    why = F.when(F.col("dangling"), "dangling").when(F.col("next").isNotNull(), "loop")
    return state.select("repo", "token", F.when(why.isNull(), F.col("value")).alias("value"), why.alias("unresolved"))


def repainted_subjects(decls: DataFrame) -> DataFrame:
    """(repo, subject): elements whose background a state rule sets, as ``.a:checked + .b:hover`` does for .b; each once."""
    painted = decls.filter(F.col("prop").isin("background", "background-color")).select("repo", "file", "rule_id", "selector").distinct()
    last = painted.select("repo", F.explode(F.split("selector", ",")).alias("part")).select("repo", _subject(F.col("part")).alias("whole"))
    base = F.regexp_replace("whole", r"(:{1,2}[\w-]+(\([^)]*\))?)+$", "")
    return last.select("repo", "whole", base.alias("subject")).filter("subject <> '' and subject <> whole").select("repo", "subject").distinct()


def _subject(selector: Column) -> Column:
    """The last compound of a selector: what it is about, whatever leads to it."""
    return F.element_at(F.split(F.trim(selector), r"\s*[+>~ ]\s*"), -1)


VAR = r"(?i)var\(\s*(--[a-z0-9-]+)"


def token_colours(decls: DataFrame) -> DataFrame:
    """(repo, token, rgb) of the custom properties whose first declaration is a colour or leads to one by var(); rgb null for the others.

    Chains are followed by doubling; one that loops or ends nowhere stays null. As many rounds as the longest chain has binary digits.
    """
    first = first_declared(decls).withColumn("rgb", C.parse_colour(F.col("value")))
    state = cut(first.select("repo", "token", "rgb", F.when(F.col("rgb").isNull(), F.nullif(F.regexp_extract("value", VAR, 1), F.lit(""))).alias("next")))
    for _ in range(state.count().bit_length() + 1):
        open_ = state.filter("next is not null")
        if open_.isEmpty():
            break
        to = state.select("repo", F.col("token").alias("next"), F.col("rgb").alias("to_rgb"), F.col("next").alias("to_next"))
        moved = open_.join(to, ["repo", "next"], "left").select("repo", "token", F.col("to_rgb").alias("rgb"), F.col("to_next").alias("next"))
        state = cut(state.filter("next is null").unionByName(moved))
    return state.select("repo", "token", "rgb")


def contrast_pairs(decls: DataFrame, least: float = 4.5) -> DataFrame:
    """(repo, fg, bg) that some rule sets together, each once, and what became of it: repo, fg, bg, file, selector, outcome, reason, ratio, fails.

    fg and bg are colours as written (hex in full, in small letters), or names of the tokens that var() reads; the last declaration in a rule wins, values that are
    neither (inherit, transparent, a gradient) don't count. Of several rules with a pair the last by file and place speaks for it. outcome
    is ``checked`` (with the ratio of the two colours and whether it is below ``least``), ``state overridden`` where a state rule repaints the rule's subject, so
    the two may never meet, or ``unresolved`` where a token leads to no colour. Only checked pairs have a ratio: the others were not measured.
    """
    value = F.coalesce(F.nullif(F.regexp_extract("value", VAR, 1), F.lit("")), F.when(C.parse_colour(F.col("value")).isNotNull(), F.coalesce(C.expand_hex(F.trim("value")), F.trim("value"))))
    kind = F.when(F.col("prop") == "color", "fg").when(F.col("prop").isin("background", "background-color"), "bg")
    own = decls.withColumn("kind", kind).withColumn("paint", value).filter("kind is not null and paint is not null")

    def last(k: str) -> Column:
        return F.max(F.when(F.col("kind") == k, F.struct("ord", "paint")))["paint"]

    pair = own.groupBy("repo", "file", "rule_id").agg(last("fg").alias("fg"), last("bg").alias("bg"), F.max("selector").alias("selector")).filter("fg <> bg")
    pair = pair.withColumn("subject", _subject(F.element_at(F.split("selector", ","), 1)))
    pair = pair.join(repainted_subjects(decls).withColumn("state", F.lit(True)), ["repo", "subject"], "left")
    pair = pair.groupBy("repo", "fg", "bg").agg(F.max(F.struct("file", "rule_id", "selector", "subject", "state")).alias("x")).select("repo", "fg", "bg", "x.file", "x.selector", "x.subject", "x.state")
    known = token_colours(decls)
    for side in ("fg", "bg"):
        pair = pair.join(known.select("repo", F.col("token").alias(side), F.col("rgb").alias(f"{side}_token")), ["repo", side], "left")
        pair = pair.withColumn(f"{side}_rgb", F.when(F.col(side).startswith("--"), F.col(f"{side}_token")).otherwise(C.parse_colour(F.col(side))))
    lost = F.concat_ws(", ", *[F.when(F.col(f"{side}_rgb").isNull(), F.col(side)) for side in ("fg", "bg")])
    outcome = F.when(F.col("state"), "state overridden").when(lost != "", "unresolved").otherwise("checked")
    reason = F.when(F.col("state"), F.concat("subject", F.lit(" is repainted by a state rule"))).when(lost != "", F.concat(lost, F.lit(" leads to no colour")))
    pair = pair.withColumn("outcome", outcome).withColumn("reason", reason)
    pair = pair.withColumn("ratio", F.when(F.col("outcome") == "checked", F.round(C.contrast_of(F.col("fg_rgb"), F.col("bg_rgb")), 2))).withColumn("fails", F.col("ratio") < least)
    return pair.select("repo", "fg", "bg", "file", "selector", "outcome", "reason", "ratio", "fails")


def with_contrast(pairs: DataFrame, least: float = 4.5) -> DataFrame:
    ratio = F.round(C.contrast(F.col("fg"), F.col("bg")), 2)
    return pairs.withColumn("ratio", ratio).withColumn("fails", F.col("ratio") < least)


#: Tokens that one pass over the colours holds.
TOKENS_A_PASS = 16_384


def nearest_token(used: DataFrame, tokens: DataFrame, width: int = TOKENS_A_PASS) -> DataFrame:
    """(colour, ...) with the token of the same colour, else of the nearest by channel distance (ties: by name).

    Each distinct colour is held against the tokens once, in arrays, ``width`` distinct token colours a pass; a longer list takes further passes. A
    colour that is no #rrggbb is left out, as are such tokens. Without tokens: empty result.
    """
    plain = "^#[0-9a-fA-F]{6}$"
    own, at = numbered(tokens.filter(F.col("colour").rlike(plain)).groupBy(F.lower("colour").alias("tc")).agg(F.min("token").alias("token")), [F.col("token"), F.col("tc")], "_n"), 0
    distinct, best = used.filter(F.col("colour").rlike(plain)).select("colour").distinct(), None
    n = own.count()
    while at < n or best is None:
        part = own.filter(F.col("_n").between(at + 1, at + width)).orderBy("_n").toArrow()
        names = part.column("token").to_pylist()
        rgb = np.array([[int(c[i : i + 2], 16) for i in (1, 3, 5)] for c in part.column("tc").to_pylist()], np.int32).reshape(-1, 3)

        def run(batches, names=names, rgb=rgb):
            for b in batches:
                for low in range(0, b.num_rows if names else 0, 256):
                    c = b.column("colour").slice(low, 256)
                    x = np.array([[int(v[i : i + 2], 16) for i in (1, 3, 5)] for v in c.to_pylist()], np.int32)
                    away = np.abs(x[:, None, :] - rgb[None, :, :]).sum(axis=2)
                    first = away.argmin(axis=1)  # of equally near ones the first by name
                    yield pa.RecordBatch.from_arrays([c, pa.array([names[i] for i in first], pa.string()), pa.array(away[np.arange(len(first)), first], pa.int32())], names=["colour", "token", "distance"])

        got = distinct.mapInArrow(run, "colour string, token string, distance int")
        best, at = got if best is None else best.unionByName(got), at + width
    best = best.groupBy("colour").agg(F.min(F.struct("distance", "token")).alias("x"))
    return used.join(best.select("colour", "x.token", "x.distance"), "colour")


def palette(pixels: DataFrame, keep: float = 0.002, merge: int = 36, top: int = 12) -> DataFrame:
    """(image, rgb, n) to each image's leading colours: (image, rgb, n, share, rank).

    Colours are taken in order of their count, ties by value. One of a share of at least ``keep`` stands for itself; a rarer one
    joins the nearest colour so far (of equally near ones the first) if its channels are at most ``merge`` away in sum, else it stands for itself too; so an
    image of rare colours alone has a palette. Shares are of all pixels. Groups are images; a colour is a row, whatever the number of pixels.
    """

    def fold(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(zip((-n for n in table.column("n").to_pylist()), table.column("rgb").to_pylist(), strict=True))
        total, names = -sum(n for n, _ in rows), [c for _, c in rows]
        rgb = np.array([[int(c[i : i + 2], 16) for i in (1, 3, 5)] for c in names], np.int32).reshape(-1, 3)
        heads, sums = np.zeros(len(rows), np.int64), []
        for k, (minus, _) in enumerate(rows):
            if -minus < keep * total and sums:
                away = np.abs(rgb[heads[: len(sums)]] - rgb[k]).sum(axis=1)
                if away.min() <= merge:
                    sums[int(away.argmin())] -= minus
                    continue
            heads[len(sums)] = k
            sums.append(-minus)
        order = sorted(range(len(sums)), key=lambda i: (-sums[i], names[heads[i]]))[:top]
        return pa.table({"image": pa.array([key[0].as_py()] * len(order), table.schema.field("image").type), "rgb": [names[heads[i]] for i in order], "n": pa.array([sums[i] for i in order], pa.int64()), "all": pa.array([total] * len(order), pa.int64()), "rank": pa.array(range(1, len(order) + 1), pa.int32())})

    counts = pixels.groupBy("image", "rgb").agg(F.sum("n").cast("long").alias("n"))
    out = counts.groupBy("image").applyInArrow(fold, f"image {dict(pixels.dtypes)['image']}, rgb string, n long, all long, rank int")
    return out.select("image", "rgb", "n", share("n", "all", 4).alias("share"), "rank")


def page_ground(edges: DataFrame) -> DataFrame:
    """The most frequent colour at an image's edges (image, rgb, n)."""
    c = edges.groupBy("image", "rgb").agg(F.sum("n").alias("n"))
    return c.groupBy("image").agg(F.min(F.struct((-F.col("n")).alias("m"), "rgb")).alias("x")).select("image", F.col("x.rgb").alias("ground"))


def rhythm_gaps(rows: DataFrame, top: int = 6) -> DataFrame:
    """(image, y, empty) to the lengths of runs of empty rows, the leading run left out, by how often they occur."""
    w = Window.partitionBy("image").orderBy("y")
    run = F.sum(F.when(F.col("empty") != F.lag("empty", 1).over(w), 1).otherwise(0)).over(w)
    runs = rows.withColumn("run", run).groupBy("image", "run", "empty").agg(F.count("*").alias("length")).filter("empty and run > 0")
    c = runs.groupBy("image", "length").agg(F.count("*").alias("n"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("image").orderBy(F.desc("n"), F.desc("length")))).filter(F.col("rank") <= top)


def name_tokens(colours: DataFrame, surface_share: float = 0.1) -> DataFrame:
    """(image, rgb, share, ground) to (image, role, rgb, value): one colour for each role, each from what the roles before it left.

    background: the ground; text: the largest contrast with it; accent: the largest saturation (of hue, saturation and lightness)
    above .15; surface: of the colours whose every channel is within 24 of the ground and whose share is ``surface_share`` or more, that of the largest share. value is what
    decided. Ties: the smaller colour. An image without a ground gets the role ``refused`` alone; a role without a colour no row.
    """
    colours = cut(colours.select("image", "rgb", "share", "ground"))  # every role reads it again
    refused = colours.groupBy("image").agg(F.max("ground").alias("ground")).filter("ground is null").select("image", F.lit("refused").alias("role"), F.lit(None).cast("string").alias("rgb"), F.lit(None).cast("double").alias("value"))
    left = colours.filter("ground is not null").groupBy("image", "rgb").agg(F.max("share").alias("share"), F.max("ground").alias("ground"))
    ground = left.select("image", F.lit("background").alias("role"), F.col("ground").alias("rgb"), F.lit(1.0).alias("value")).distinct()
    left = left.filter("rgb <> ground")
    text, accent = F.round(C.contrast(F.col("rgb"), F.col("ground")), 4), F.round(C.saturation(F.col("rgb")), 4)
    left = left.withColumns({"text": text, "accent": accent, "near": C.widest_channel(F.col("rgb"), F.col("ground"))})
    out = refused.unionByName(ground)
    for role, value, fits in (("text", "text", "true"), ("accent", "accent", "accent > 0.15"), ("surface", "share", f"near <= 24 and share >= {surface_share}")):
        best = left.filter(fits).groupBy("image").agg(F.min(F.struct((-F.col(value)).alias("m"), "rgb")).alias("x")).select("image", F.lit(role).alias("role"), F.col("x.rgb").alias("rgb"), (-F.col("x.m")).cast("double").alias("value"))
        best = cut(best)
        out, left = out.unionByName(best), left.join(best.select("image", "rgb"), ["image", "rgb"], "left_anti")
    return out


def media_caps(decls: DataFrame, least: float = 480) -> DataFrame:
    """Reading columns: max-width caps in px (rem by 16) of at least ``least``, the dominant one and the widest of each repo."""
    number = F.regexp_extract("value", r"^([0-9.]+)", 1).try_cast("double")
    px = F.when(F.col("value").rlike(r"^[0-9.]+px$"), number).when(F.col("value").rlike(r"^[0-9.]+rem$"), 16 * number)
    caps = decls.filter("prop = 'max-width'").withColumn("px", px).filter(F.col("px") >= least)
    c = caps.groupBy("repo", "px").agg(F.count("*").alias("n"))
    out = c.groupBy("repo").agg(F.min(F.struct((-F.col("n")).alias("m"), "px")).alias("x"), F.sum("n").alias("total"), F.max("px").alias("widest"), F.count("*").alias("distinct_caps"))
    return out.select("repo", F.col("x.px").alias("dominant"), share(-F.col("x.m"), F.col("total")).alias("share"), "widest", "distinct_caps")


