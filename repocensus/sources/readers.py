"""Sources and sinks: file trees, registries, tokens, locales, commits, advisories, specs, images; artifacts per repo."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIXTURES = r"(?i)(^|/)(__fixtures__|fixtures?|__mocks__|mocks?|node_modules|dist|build)(/|$)"


def read_corpus(spark: SparkSession, root: str, extensions: list[str], repo_depth: int = 1) -> DataFrame:
    """Every text file below ``root`` with one of the extensions: repo (the first folders below root), path, ext, content, modified. Spark leaves out files and folders whose names begin with _ or a dot."""
    glob = "*.{" + ",".join(extensions) + "}" if len(extensions) > 1 else f"*.{extensions[0]}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    rest = F.regexp_extract("path", f"{root.rstrip('/').removeprefix('file:')}/(.*)$", 1)
    parts = F.split(rest, "/")
    return raw.select(F.array_join(F.slice(parts, 1, repo_depth), "/").alias("repo"), F.array_join(F.slice(parts, repo_depth + 1, F.size(parts)), "/").alias("path"), F.regexp_extract(rest, r"[.]([^./]+)$", 1).alias("ext"), F.decode("content", "UTF-8").alias("content"), F.col("modificationTime").alias("modified"))


def scope(files: DataFrame, exclude: list[str]) -> DataFrame:
    """``files`` with reason: null for those in scope, else excluded or fixture."""
    out = F.when(F.lit(False), "")
    for p in exclude:
        out = out.when(F.col("path").startswith(p), "excluded")
    return files.withColumn("reason", out.when(F.col("path").rlike(FIXTURES), "fixture"))


def scope_counts(scoped: DataFrame) -> DataFrame:
    return scoped.groupBy("repo", F.coalesce("reason", F.lit("in scope")).alias("reason")).agg(F.count("*").alias("files"))


def classify_file(path: Column) -> Column:
    """test, route, component or other by the path."""
    return (
        F.when(path.rlike(r"(?i)[.](test|spec|stories)[.]|(^|/)(tests?|__tests__|e2e)/"), "test")
        .when(path.rlike(r"(^|/)(pages|routes|views|screens|app)/.*[.](tsx|jsx|vue|svelte)$"), "route")
        .when(path.rlike(r"(^|/)components?/.*[.](tsx|jsx|vue|svelte)$"), "component")
        .otherwise("other")
    )


def is_screen(files: DataFrame, routed: DataFrame) -> DataFrame:
    """(repo, path, found_by) of screens, by the first that holds: a route points at the file; a router reads its folder (every file below pages or
    routes; below app only page and route files); it is called ...Page, ...Screen or ...View.

    Tests are none, whatever points at them. Folders of components, helpers and hooks, and files that a router keeps for itself (_app, _document, _error,
    api) are screens only by a route.
    """
    path = F.col("path")
    rows = files.join(routed.select("repo", "path").distinct().withColumn("r", F.lit(True)).hint("merge"), ["repo", "path"], "left").filter(classify_file(path) != "test")
    markup, flat = path.rlike(r"[.](tsx|jsx|vue|svelte)$"), path.rlike(r"(^|/)(pages|routes)/")
    app = path.rlike(r"(^|/)app/") & ~flat
    router = F.when(app, path.rlike(r"(^|/)(page|route)[.][jt]sx$")).otherwise(flat)
    other = path.rlike(r"(^|/)(components?|lib|utils?|hooks?)/") | path.rlike(r"(^|/)(_app|_document|_error|api)[./]")
    by = F.when(F.col("r"), "route").when(markup & ~other & router, "router").when(markup & ~other & path.rlike(r"(Page|Screen|View)[.](tsx|jsx|vue|svelte)$"), "naming")
    return rows.withColumn("found_by", by).filter("found_by is not null").select("repo", "path", "found_by")


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """name and sub of a tab-separated list; lines that begin with # and empty ones are left out."""
    parts = F.split("value", "\t")
    return spark.read.text(path).filter("trim(value) <> '' and not startswith(ltrim(value), '#')").select(F.trim(parts[0]).alias("name"), F.trim(F.try_element_at(parts, F.lit(2))).alias("sub"))


COMPONENT = "struct<from:string,level:string,surface:string,description:string,inherits:boolean,exports:array<string>,props:array<struct<name:string,type:string,required:boolean,values:array<string>>>,renders:array<string>,uses:array<string>>"


def registry_rows(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(library, json) of component maps to one row per component (extra exports as rows with is_part) and one per (component, prop)."""
    one = texts.select("library", F.explode(F.from_json("json", f"map<string,{COMPONENT}>")).alias("component", "c"))
    names = F.array_distinct(F.concat(F.array("component"), F.coalesce("c.exports", F.array().cast("array<string>"))))
    components = one.select("library", "component", "c.*", F.explode(names).alias("export")).withColumn("is_part", F.col("export") != F.col("component"))
    props = one.select("library", "component", F.explode("c.props").alias("p")).select("library", "component", F.col("p.name").alias("prop"), "p.type", "p.required", "p.values")
    return components.drop("props"), props


TOKEN_LEAVES = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("path", "name", "value", "type")]))


@F.pandas_udf(TOKEN_LEAVES)
def token_leaves(texts: pd.Series) -> pd.Series:
    """Leaves of a token tree: nodes with $value (or plain scalars), the type inherited from the group."""

    def walk(node, path, kind):
        if isinstance(node, dict):
            kind = node.get("$type", kind)
            if "$value" in node:
                yield {"path": ".".join(path), "name": path[-1] if path else "", "value": str(node["$value"]), "type": kind}
                return
            for k, v in node.items():
                if not k.startswith("$"):
                    yield from walk(v, [*path, k], kind)
        elif path and node is not None:
            yield {"path": ".".join(path), "name": path[-1], "value": str(node), "type": kind}

    def leaves(t):
        try:
            return list(walk(json.loads(t), [], None))
        except (TypeError, ValueError):
            return []

    return texts.map(leaves)


def flatten_tokens(texts: DataFrame) -> DataFrame:
    """(profile, json) to (profile, path, name, value, type), for flat files and groups of any depth; broken text gives nothing."""
    return texts.select("profile", F.explode(token_leaves("json")).alias("t")).select("profile", "t.*")


@F.pandas_udf(T.ArrayType(T.StringType()))
def key_paths(texts: pd.Series) -> pd.Series:
    """Dotted paths of the leaves of a JSON object."""

    def walk(node, path):
        if isinstance(node, dict):
            for k, v in node.items():
                yield from walk(v, [*path, k])
        else:
            yield ".".join(path)

    def leaves(t):
        try:
            return list(walk(json.loads(t), []))
        except (TypeError, ValueError):
            return []

    return texts.map(leaves)


def read_locales(files: DataFrame) -> DataFrame:
    """(repo, path, content) of locale files to (repo, language, key); the language is the file's or its folder's name."""
    language = F.coalesce(F.nullif(F.regexp_extract("path", r"(?:^|/)([a-z]{2}(?:[-_][A-Z]{2})?)[.]json$", 1), F.lit("")), F.nullif(F.regexp_extract("path", r"(?:^|/)([a-z]{2}(?:[-_][A-Z]{2})?)/[^/]+[.]json$", 1), F.lit("")))
    return files.withColumn("language", language).filter("language is not null").select("repo", "language", F.explode(key_paths("content")).alias("key")).filter("key <> ''").distinct()


def figma_variables(texts: DataFrame) -> DataFrame:
    """(profile, json) of exported variables to one row per variable and mode: colour as hex, number as text, or the id it is an alias of."""
    value = "struct<r:double,g:double,b:double,type:string,id:string>"
    one = texts.select("profile", F.explode(F.from_json(F.get_json_object("json", "$.variables"), "map<string,struct<name:string,resolvedType:string,valuesByMode:map<string,string>>>")).alias("id", "v"))
    each = one.select("profile", "id", "v.name", F.col("v.resolvedType").alias("type"), F.explode("v.valuesByMode").alias("mode", "raw")).withColumn("o", F.from_json("raw", value))
    hex_ = F.concat(F.lit("#"), *[F.lower(F.lpad(F.hex(F.round(255 * F.col(f"o.{c}")).cast("long")), 2, "0")) for c in "rgb"])
    out = F.when(F.col("o.r").isNotNull(), hex_).when(F.col("o.id").isNull(), F.col("raw"))
    return each.select("profile", "id", "name", "type", "mode", out.alias("value"), F.col("o.id").alias("alias_of"))


def read_commits(logs: DataFrame) -> DataFrame:
    """(repo, log) to commits: records parted by \\x1e, fields hash, author, date, signature, body by \\x1f; co-authors from trailers."""
    rec = logs.select("repo", F.explode(F.split("log", "\x1e")).alias("r")).filter("trim(r) <> ''")
    f = F.split(F.trim("r"), "\x1f")
    body = F.coalesce(F.try_element_at(f, F.lit(5)), F.lit(""))
    who = F.regexp_extract_all(body, F.lit(r"(?im)^co-authored-by:\s*([^<\n]+<[^>\n]*>)"), F.lit(1))
    people = F.transform(who, lambda x: F.struct(F.trim(F.regexp_extract(x, "^([^<]*)", 1)).alias("name"), F.regexp_extract(x, "<([^>]*)>", 1).alias("email")))
    return rec.select("repo", f[0].alias("hash"), F.try_element_at(f, F.lit(2)).alias("author"), F.try_to_timestamp(F.try_element_at(f, F.lit(3))).alias("date"), F.try_element_at(f, F.lit(4)).alias("signature"), body.alias("body"), people.alias("co_authors"))


def read_audit(texts: DataFrame) -> DataFrame:
    """(repo, json) of four advisory shapes to one: package, severity (lower case), direct, fix_available, via.

    npm 7 (vulnerabilities by package), npm 6 and pnpm (advisories by id), yarn (lines of JSON), and a plain list.
    """
    v7 = texts.select("repo", F.explode(F.from_json(F.get_json_object("json", "$.vulnerabilities"), "map<string,struct<severity:string,isDirect:boolean,fixAvailable:string,via:array<string>>>")).alias("package", "v"))
    v7 = v7.select("repo", "package", F.lower("v.severity").alias("severity"), F.col("v.isDirect").alias("direct"), (F.coalesce("v.fixAvailable", F.lit("false")) != "false").alias("fix_available"), F.transform("v.via", lambda x: F.coalesce(F.get_json_object(x, "$.title"), x)).alias("via"))
    shape = "struct<module_name:string,severity:string,title:string,patched_versions:string,findings:array<struct<paths:array<string>>>>"

    def classic(rows: DataFrame) -> DataFrame:
        paths = F.flatten(F.transform("a.findings", lambda x: x["paths"]))
        direct = F.exists(paths, lambda p: ~p.contains(">"))
        return rows.select("repo", F.col("a.module_name").alias("package"), F.lower("a.severity").alias("severity"), direct.alias("direct"), (F.coalesce("a.patched_versions", F.lit("<0.0.0")) != "<0.0.0").alias("fix_available"), F.array("a.title").alias("via"))

    v6 = classic(texts.select("repo", F.explode(F.from_json(F.get_json_object("json", "$.advisories"), f"map<string,{shape}>")).alias("id", "a")))
    line = texts.select("repo", F.explode(F.split("json", "\n")).alias("l")).filter(F.get_json_object("l", "$.type") == "auditAdvisory")
    yarn = classic(line.select("repo", F.from_json(F.get_json_object("l", "$.data.advisory"), shape).alias("a")))
    plain = classic(texts.filter("startswith(ltrim(json), '[')").select("repo", F.explode(F.from_json("json", f"array<{shape}>")).alias("a")))
    return v7.unionByName(v6).unionByName(yarn).unionByName(plain)


def read_spec(texts: DataFrame) -> DataFrame:
    """(spec, json) to elements: zone, pos, role and axes of each "role axis=value ..." string."""
    zones = F.from_json(F.get_json_object("json", "$.zones"), "array<struct<name:string,elements:array<string>>>")
    each = texts.select("spec", F.explode(zones).alias("z")).select("spec", F.col("z.name").alias("zone"), F.posexplode("z.elements").alias("pos", "e"))
    rest = F.trim(F.regexp_replace("e", r"^\S+\s*", ""))
    return each.select("spec", "zone", "pos", F.regexp_extract("e", r"^(\S+)", 1).alias("role"), F.when(rest != "", F.str_to_map(rest, F.lit(" "), F.lit("="))).alias("axes"))


def write_artifact(df: DataFrame, folder: str, name: str) -> None:
    """One artifact per (repo, pass): only the repos in ``df`` are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo").parquet(f"{folder}/{name}")


def append_evidence(df: DataFrame, folder: str) -> None:
    df.write.mode("append").parquet(folder)


def fingerprint(files: DataFrame) -> DataFrame:
    """repo, path, sha256 of the content: what an artifact was counted from."""
    return files.select("repo", "path", F.sha2("content", 256).alias("sha256"))


