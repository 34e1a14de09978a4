"""Reading what a screen renders into: the frame at its root, the places of that frame it fills, and the places that a frame declares."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .markup import attributes, closing

#: Components that wrap without placing anything; types of what can be rendered; names that are no places, whatever their type.
PLUMBING = re.compile(r"(React\.?Fragment|Fragment|Suspense|ErrorBoundary|Provider|[A-Z]\w*Provider|Observer|Authenticated|[A-Z]\w*Guard|Outlet|RouterProvider)")
RENDERABLE = re.compile(r"\b(ReactNode|ReactElement|ReactChild|JSX\.Element|React\.JSX\.Element|Snippet|TemplateRef)\b")
NO_PLACE = re.compile(r"^(on[A-Z]|handle[A-Z])|([Rr]ef|Handler|Callback)$|^(e|ev|event|props|index|key|data|type|value|name)$")
#: Attributes that say nothing about a frame; those that are handlers, conditions and identities by their name.
IGNORED = r"^(key|ref|className|class|style|id|slot|data-[\w-]+|aria-[\w-]+|v-[\w-]+|ng\w*|let-[\w-]+)$"
HANDLER, CONDITION, IDENTITY = r"^(on[A-Z]|handle[A-Z])", r"^(is|has|can|should|are|did|was)[A-Z]", r"(Id|Ids|Key|Slug|Uuid)$|^(params|searchParams|query)$"
#: How many wrappers are looked through.
DEPTH = 4

_ROOT = re.compile(r"(?:return|=>)\s*\(?\s*<([A-Za-z][\w.]*)")
_COMPONENT = re.compile(r"<([A-Z][\w.]*)")
_TYPED = re.compile(r"(\w+)\s*\??\s*:\s*([^;,\n}]+)")
_MODULE_LINE = re.compile(r"^\s*(?:import|export)\s[^\n]*$", re.MULTILINE)
_TAG, _BRACES = re.compile(r"<[a-zA-Z][^>]*>"), re.compile(r"\{[^}]*\}")
_BOUND = re.compile(r"\{[#:]?(?:each|await|then|catch|const)\s+[^}]*?\bas\s+([\w,\s[\]{}]+)\}|\{@const\s+(\w+)")
_RENDERED = re.compile(r"(?<![=$])\{\s*(\w+)\s*\}")
_SLOT, _SLOT_NAME = re.compile(r"<slot\b([^>]*)>"), re.compile(r"name\s*=\s*[\"']([^\"']+)[\"']")
_SNIPPET = re.compile(r"\{@render\s+(\w+)")
_PROJECTED, _SELECT = re.compile(r"<ng-content\b([^>]*)>"), re.compile(r"select\s*=\s*[\"']([^\"']+)[\"']")
_CLASSES, _CSS_TEXT = re.compile(r"className=[\"'`]([^\"'`]*)[\"'`]"), re.compile(r"`([^`]{0,400}?display\s*:\s*(?:grid|flex)[^`]{0,200}?)`")


def root_of(text: str) -> tuple[str, str | None, list[tuple[str, str]]]:
    """Class of a screen, its shell, and the attributes with a value that the shell is given.

    framed: some returned root is a component that isn't plumbing, or the first such below it; unframed: the first returned root
    is a raw element; norender: nothing is returned as markup; plumbing: wrappers alone; unclassified: a component whose tag can't be read.
    """
    roots = list(_ROOT.finditer(text))
    if not roots:
        return "norender", None, []
    otherwise = "unframed" if roots[0][1][0].islower() else "plumbing"
    m = next((r for r in roots if r[1][0].isupper()), None)
    if m is None:
        return otherwise, None, []
    braces, name, at = closing(text), m[1], m.end()
    for _ in range(DEPTH + 1):
        got = attributes(text, at, braces)
        if got is None:
            return (otherwise if otherwise == "unframed" else "unclassified"), None, []
        if not PLUMBING.fullmatch(name):
            return "framed", name, [(p, v) for p, v, kind in got if kind != "boolean"]
        inner = _COMPONENT.search(text, _tag_end(text, at, braces))
        if inner is None:
            break
        name, at = inner[1], inner.end()
    return otherwise, None, []


def _tag_end(text: str, at: int, braces: dict[int, int]) -> int:
    """Behind the > of the opening tag whose name ends at ``at``."""
    while at < len(text) and text[at] != ">":
        if text[at] == "{" and at in braces:
            at = braces[at]
        elif text[at] in "\"'":
            end = text.find(text[at], at + 1)
            at = end if end >= 0 else at
        at += 1
    return at + 1


def regions_of(text: str) -> list[str]:
    """Places that a frame's source declares: props of a renderable type, props that its markup puts somewhere, slots, snippets, projected content; sorted."""
    found = {m[1] for m in _TYPED.finditer(text) if RENDERABLE.search(m[2]) and not NO_PLACE.search(m[1])}
    body = _TAG.sub(lambda t: _BRACES.sub("", t[0]), _MODULE_LINE.sub("", text))  # an attribute's value is used, not placed
    bound = {n for m in _BOUND.finditer(body) for n in re.split(r"[\s,[\]{}]+", m[1] or m[2]) if n}
    found |= {m[1] for m in _RENDERED.finditer(body) if m[1] not in bound and not NO_PLACE.search(m[1])}
    for slot in _SLOT.finditer(text):
        named = _SLOT_NAME.search(slot[1])
        found.add(named[1] if named else "children")
    found |= {m[1] for m in _SNIPPET.finditer(text)}
    for place in _PROJECTED.finditer(text):
        by = _SELECT.search(place[1])
        found.add(re.sub(r"[\[\].#]", "", by[1]) if by else "children")
    return sorted(found)


def arrangements(text: str) -> list[str]:
    """How the screen lays out its own parts: grids with their columns, flex rows and columns; each once, sorted."""
    found = set()
    for m in _CLASSES.finditer(text):
        words = m[1]
        if re.search(r"\bgrid\b", words):
            columns = re.search(r"grid-cols-\[?([^\s\]]+)", words)
            found.add(f"grid {columns[1]}" if columns else "grid ?" if "grid-cols" in words else "grid")
        elif re.search(r"\bflex\b", words):
            found.add("flex column" if "flex-col" in words else "flex row")
    for m in _CSS_TEXT.finditer(text):
        if re.search(r"display\s*:\s*grid", m[1]):
            columns = re.search(r"grid-template-columns\s*:\s*([^;]+)", m[1])
            found.add(f"grid {len(columns[1].split())} col" if columns else "grid")
        else:
            found.add("flex column" if re.search(r"flex-direction\s*:\s*column", m[1]) else "flex row")
    return sorted(found)


#: Signs that a screen lays itself out: a styled template, utility classes, a style sheet of its own, a style block.
_OWN_LAYOUT = re.compile(r"styled[.(][^`]*`[^`]*display\s*:\s*(?:grid|flex)|className=[\"'`][^\"'`]*\b(?:grid|flex)\b|import\s+['\"][^'\"]*\.(?:css|scss)['\"]|<style[^>]*>.*?display\s*:\s*(?:grid|flex)", re.DOTALL)


def _read(files: DataFrame, make, types: dict[str, str]) -> DataFrame:
    """repo and path with the columns that ``make`` gives for each text, in small slices of Arrow batches."""
    kinds = dict(files.dtypes)
    schema = f"repo {kinds['repo']}, path {kinds['path']}, " + ", ".join(f"{n} {t}" for n, t in types.items())
    arrow = [pa.string() if t == "string" else pa.list_(pa.string()) for t in types.values()]

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                b = batch.slice(low, 256)
                rows = [make(t or "") for t in b.column("content").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("repo"), b.column("path"), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(arrow)]], names=["repo", "path", *types])

    return files.select("repo", "path", "content").mapInArrow(run, schema)


def read_roots(screens: DataFrame) -> DataFrame:
    """(repo, path, content) to (repo, path, class, shell, names, values, arrangement, own_layout); see ``root_of``. Null content: renders nothing.

    names and values are the attributes of the shell, in order; the content goes no further.
    """

    def make(text: str):
        kind, shell, attrs = root_of(text)
        return kind, shell, [n for n, _ in attrs], [v for _, v in attrs], arrangements(text), "yes" if _OWN_LAYOUT.search(text) else "no"

    got = _read(screens, make, {"class": "string", "shell": "string", "names": "array<string>", "values": "array<string>", "arrangement": "array<string>", "own": "string"})
    return got.withColumn("own_layout", F.col("own") == "yes").drop("own")


def read_frames(files: DataFrame) -> DataFrame:
    """(repo, path, content) to (repo, path, frame, region), a row a declared place; the frame is named by its file, or by the folder of an index file."""
    got = _read(files, lambda t: (regions_of(t),), {"regions": "array<string>"})
    stem = F.regexp_extract("path", r"([^/]+?)\.[^/.]+$", 1)
    frame = F.when(stem == "index", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)).otherwise(stem)
    return got.select("repo", "path", frame.alias("frame"), F.explode("regions").alias("region"))
