"""Constructs of source code counted by repo, lists of files to look at, and the tools that a repo has set up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shares import share

#: What is counted in files that are no tests.
CONSTRUCTS = {
    "any": r"(:|<)\s*any\b|\bas\s+any\b",
    "assertions": r"\bas\s+(?!const\b)[A-Z][\w.<>\[\]]*",
    "non_null": r"[\w)\]]!\s*[.);,\]]",
    "suppressions": r"@ts-(ignore|expect-error|nocheck)",
    "discriminated_unions": r"\btype\s+\w+\s*=\s*\{[^}]*\bkind\s*:|(\|\s*\{\s*(kind|type)\s*:)",
    "use_state": r"\buseState\s*[(<]",
    "use_reducer": r"\buseReducer\s*\(",
    "use_context": r"\buseContext\s*\(",
    "create_context": r"\bcreateContext\s*[(<]",
    "use_effect": r"\buseEffect\s*\(",
    "server_state_hooks": r"\buse(Query|Mutation|InfiniteQuery|SWR|SuspenseQuery)\b",
    "memo": r"\bReact\.memo\(|\bmemo\(",
    "use_memo": r"\buseMemo\s*\(",
    "use_callback": r"\buseCallback\s*\(",
    "lazy_routes": r"\bReact\.lazy\(|\blazy\(\s*\(\)\s*=>",
    "suspense": r"<Suspense\b",
    "lazy_images": r"loading=[\"']lazy[\"']",
}
#: What is counted in tests; queries by what a user perceives, and by how it is built.
IN_TESTS = {
    "accessible_queries": r"getBy(Role|LabelText|Text|Placeholder)|findBy(Role|LabelText|Text)",
    "implementation_queries": r"getByTestId|findByTestId|querySelector\(",
    "user_event": r"userEvent\.|user\.(click|type|keyboard|tab)",
    "fire_event": r"fireEvent\.",
    "snapshots": r"toMatchSnapshot|toMatchInlineSnapshot",
    "axe": r"toHaveNoViolations|\baxe\(|a11yViolations|axeViolations|checkA11y",
}
#: What is counted in style sheets.
IN_STYLES = {"media_queries": r"@media", "container_queries": r"@container"}
#: Signs by which files get on a list.
FETCH, ASYNC, HANDLED = r"\bfetch\s*\(|\baxios\s*[.(]|\bXMLHttpRequest\b", r"\basync\b|\.then\s*\(", r"try\s*\{|\.catch\s*\("
FORM, FORM_LIBRARY = r"<form\b|onSubmit=", r"useForm|<Formik|useFormik|useField"
EFFECT_FETCH, BOUNDARY = r"useEffect\s*\([\s\S]{0,400}?(fetch|axios)\s*\(", r"ErrorBoundary|componentDidCatch|getDerivedStateFromError"
HOOK_FILE, TEST_FILE = r"(^|/)(hooks?|lib|services?|api|data)/|/use[A-Z]", r"[.](test|spec)[.][jt]sx?$|(^|/)(tests?|__tests__|e2e)/"
SOURCE_FILE, STYLE_FILE = r"[.][jt]sx?$", r"[.](css|scss|less|pcss)$"

#: Mechanisms of a toolchain. A mechanism is there if each of its parts is, a part if any of its (kind, pattern) matches a name of that kind.
MECHANISMS = {
    "agent contract": [[("root", r"^(AGENTS|CLAUDE)\.md$")]],
    "JS/TS linter": [[("dependency", r"^(eslint|oxlint)$"), ("root", r"^(eslint\.config\.m?js|\.eslintrc\.(json|cjs))$")]],
    "CSS linter": [[("dependency", r"^stylelint$"), ("root", r"^\.stylelintrc(\.json)?$")]],
    "project-specific linter": [[("file", r"scripts/.*lint.*\.(mjs|js|ts)$")]],
    "strict TypeScript": [[("strict", r"^tsconfig(\.base)?\.json$")]],
    "unit tests": [[("dependency", r"^(vitest|jest)$")], [("file", r"\.(test|spec)\.[tj]sx?$")]],
    "accessibility tests": [[("dependency", r"^(vitest-axe|jest-axe|@axe-core/react)$")]],
    "visual baselines": [[("dependency", r"^(playwright|@playwright/test|puppeteer)$")], [("script", r"visual|screenshot")]],
    "contrast check": [[("script", r"contrast")]],
    "component registry": [[("file", r"component-(registry|index)\.json$")]],
    "token tiers": [[("file", r"(primitives|semantic|settings|tokens)\.(css|scss|json)$")]],
    "token export (DTCG)": [[("file", r"\.tokens\.json$")]],
    "screen specs": [[("file", r"screen-specs?/")]],
    "duplication check": [[("dependency", r"^jscpd$")]],
    "dead code check": [[("dependency", r"^(knip|ts-prune)$")]],
    "context budget": [[("script", r"context")]],
    "secret scan": [[("script", r"secret|gitleaks"), ("dependency", r"^gitleaks$")]],
    "pre-commit hook": [[("root", r"^(\.githooks/pre-commit|\.husky/pre-commit|lefthook\.yml|\.pre-commit-config\.yaml)$")]],
    "CI pipeline": [[("root", r"^(\.gitlab-ci\.yml|\.github/workflows(/.*)?|azure-pipelines\.yml|Jenkinsfile)$")]],
    "gate aggregate": [[("script", r"^check(:|$)")]],
    "agent evals": [[("file", r"evals?/"), ("script", r"eval")]],
    "MCP surface": [[("root", r"^(\.mcp\.json|mcp(/.*)?)$")]],
}


def construct_counts(files: DataFrame) -> DataFrame:
    """(repo, path, content) to one row a repo: sources, tests and style sheets read, how often each construct stands in them, and query_discipline: the share
    of test queries by role among all, null where there are none. All patterns in one pass, nothing but counts is shuffled. Null content counts as a file without any."""
    test = F.col("path").rlike(TEST_FILE) & F.col("path").rlike(SOURCE_FILE)
    source, style = F.col("path").rlike(SOURCE_FILE) & ~test, F.col("path").rlike(STYLE_FILE)

    def sums(patterns: dict[str, str], where: Column) -> list[Column]:
        return [F.coalesce(F.sum(F.when(where, F.regexp_count("content", F.lit(p)))), F.lit(0)).cast("long").alias(k) for k, p in patterns.items()]

    kinds = [F.count(F.when(w, 1)).alias(n) for w, n in ((source, "sources"), (test, "tests"), (style, "styles"))]
    out = files.groupBy("repo").agg(*kinds, *sums(CONSTRUCTS, source), *sums(IN_TESTS, test), *sums(IN_STYLES, style))
    return out.withColumn("query_discipline", share(F.col("accessible_queries"), F.col("accessible_queries") + F.col("implementation_queries")))


def file_lists(files: DataFrame) -> DataFrame:
    """(repo, list, path) of sources that are no tests: ``fetch in components`` (markup that fetches, outside hooks and services), ``effect with fetch``, ``hand-rolled forms`` (no
    form library in the file), ``async with nowhere to fail`` (neither try nor catch), ``error boundaries``. A file can be on several. Null content: on none."""
    text, path = F.col("content"), F.col("path")
    lists = {
        "fetch in components": path.rlike(r"[.][jt]sx$") & ~path.rlike(HOOK_FILE) & text.rlike(FETCH),
        "effect with fetch": text.rlike(EFFECT_FETCH),
        "hand-rolled forms": text.rlike(FORM) & ~text.rlike(FORM_LIBRARY),
        "async with nowhere to fail": text.rlike(ASYNC) & ~text.rlike(HANDLED),
        "error boundaries": text.rlike(BOUNDARY),
    }
    on = F.array_compact(F.array(*[F.when(w, F.lit(k)) for k, w in lists.items()]))
    return files.filter(path.rlike(SOURCE_FILE) & ~path.rlike(TEST_FILE)).select("repo", F.explode(on).alias("list"), "path")


def tooling(files: DataFrame) -> DataFrame:
    """(repo, path, content) to (repo, kind, name), each once: every path as ``file`` and, as it is from the top of the repo, ``root``; dependencies,
    scripts and their commands of package.json at the top; ``strict`` for a tsconfig there that is. A package.json that doesn't parse has neither."""
    package = files.filter("path = 'package.json'").select("repo", F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>, scripts map<string,string>").alias("p"))

    def said(kind: str, names: Column) -> Column:
        return F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))

    every = [said("dependency", F.map_keys("p.dependencies")), said("dependency", F.map_keys("p.devDependencies")), said("script", F.map_keys("p.scripts")), said("command", F.map_values("p.scripts"))]
    named = package.select("repo", F.explode(F.flatten(F.array(*every))).alias("n")).select("repo", "n.*")
    paths = files.select("repo", F.explode(F.array(F.lit("file"), F.lit("root"))).alias("kind"), F.col("path").alias("name"))
    strict = files.filter(F.col("path").rlike(r"^tsconfig(\.base)?\.json$") & F.col("content").rlike(r'"strict"\s*:\s*true')).select("repo", F.lit("strict").alias("kind"), F.col("path").alias("name"))
    return named.unionByName(paths).unionByName(strict).distinct()


def toolchain(evidence: DataFrame, mechanisms: dict | None = None) -> DataFrame:
    """(repo, kind, name) to repo, present, missing: mechanisms (``MECHANISMS``) all of whose parts some name of the right kind answers; both sorted. A
    name is tested against all patterns of its kind in one pass, and only what it answers is shuffled; a repo without any still has its list of what is missing."""
    known = MECHANISMS if mechanisms is None else mechanisms
    # a pattern of a script that isn't bound to its name's beginning is looked for in commands too
    answers = [F.when(F.col("kind").isin(kind, *(["command"] if kind == "script" and p[0] != "^" else [])) & F.col("name").rlike(p), F.struct(F.lit(m).alias("mechanism"), F.lit(i).alias("part"))) for m, parts in known.items() for i, part in enumerate(parts) for kind, p in part]
    hit = evidence.select("repo", F.explode(F.array_compact(F.array(*answers))).alias("a")).select("repo", "a.*")
    needed = F.create_map(*[F.lit(x) for m, parts in known.items() for x in (m, len(parts))])
    there = hit.groupBy("repo", "mechanism").agg(F.count_distinct("part").alias("parts")).filter(F.col("parts") == needed[F.col("mechanism")])
    own = there.groupBy("repo").agg(F.array_sort(F.collect_list("mechanism")).alias("present"))
    every, none = F.array(*[F.lit(m) for m in sorted(known)]), F.array().cast("array<string>")
    out = evidence.select("repo").distinct().join(own, "repo", "left").withColumn("present", F.coalesce("present", none))
    return out.withColumn("missing", F.array_except(every, "present"))
