"""Reading tags and style rules out of text: one pass over each text, however long, in Arrow batches."""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"[A-Za-z][\w.-]*")
_PROP = re.compile(r"[\w:@.-]+")
_BARE = re.compile(r"[^\s\"'>{]+")
_SPACE = re.compile(r"\s*")
_NESTS = re.compile(r"[{}\"'`]")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.DOTALL)
_STYLE = re.compile(r"<style[^>]*>(.*?)</style", re.DOTALL | re.IGNORECASE)
_PLAIN = re.compile(r"[^/'\"`{}]+")
_TEMPLATE = re.compile(r"[\\`]|\$\{")
_INK = re.compile(r"[^\n]")
_CSS = re.compile(r"[{};]|\"[^\"\n]*\"|'[^'\n]*'|\([^()]*\)")


def closing(text: str) -> dict[int, int]:
    """Where each brace that is closed is closed. Braces in quotes that end on their line don't count."""
    out, open_, at = {}, [], 0
    while (m := _NESTS.search(text, at)) is not None:
        at = m.end()
        if m[0] == "{":
            open_.append(m.start())
        elif m[0] == "}":
            if open_:
                out[open_.pop()] = m.start()
        elif open_:  # outside of braces quotes belong to attributes and prose
            end = text.find(m[0], at)
            stop = text.find("\n", at, end) if m[0] != "`" and end >= 0 else -1
            if end >= 0 and stop < 0:
                at = end + 1
    return out


def attributes(text: str, at: int, braces: dict[int, int]) -> list[tuple[str, str, str]] | None:
    """(prop, value, kind) of the attributes of a tag whose name ends at ``at``; None if it is no tag."""
    out: list[tuple[str, str, str]] = []
    while True:
        gap = _SPACE.match(text, at).end()
        char = text[gap : gap + 1]
        if char == ">" or text.startswith("/>", gap):
            return out
        if gap == at and out and text[at - 1] not in "\"'}":
            return None
        if char == "{":  # a spread
            if gap not in braces:
                return None
            at = braces[gap] + 1
            continue
        m = _PROP.match(text, gap)
        if m is None or (gap == at and not out):
            return None
        at = m.end()
        value = _SPACE.match(text, at).end()
        if text[value : value + 1] != "=":
            out.append((m[0], "", "boolean"))
            continue
        value = _SPACE.match(text, value + 1).end()
        char = text[value : value + 1]
        if char in ("'", '"') and char:
            end = text.find(char, value + 1)
            if end < 0:
                return None
            out.append((m[0], text[value + 1 : end], "string"))
        elif char == "{":
            if value not in braces:
                return None
            end = braces[value]
            out.append((m[0], text[value + 1 : end], "expression"))
        else:
            x = _BARE.match(text, value)
            if x is None:
                return None
            out.append((m[0], x[0], "string"))
            end = x.end() - 1
        at = end + 1


def tags(text: str) -> list[tuple[str, list[tuple[str, str, str]]]]:
    """Opening tags in order, each with its attributes; tags within attributes are found too."""
    out, at, braces = [], text.find("<"), closing(text)
    while at >= 0:
        m = _NAME.match(text, at + 1)
        if m is not None and (got := attributes(text, m.end(), braces)) is not None:
            out.append((m[0], got))
        at = text.find("<", at + 1)
    return out


def tag_usages(files: DataFrame) -> DataFrame:
    """(repo, path, component, site_id, prop, value, kind) of every attribute of every opening tag in ``content``; kind string, expression or boolean.
    A tag without attributes has one row, with prop, value and kind null.

    site_id counts the tags of a file from 0. An expression is whole, with the braces and tags within it. Null content: no rows.
    """
    names = ["component", "site_id", "prop", "value", "kind"]

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                b = batch.slice(low, 256)
                of, rows = [], []
                for i, text in enumerate(b.column("content").to_pylist()):
                    for site, (component, props) in enumerate(tags(text or "")):
                        of += [i] * max(len(props), 1)
                        rows += [(component, site, *p) for p in props or [(None, None, None)]]
                cols = zip(*rows, strict=True) if rows else [[]] * 5
                types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
                take = pa.array(of, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("repo").take(take), b.column("path").take(take), *[pa.array(list(c), t) for c, t in zip(cols, types, strict=True)]], names=["repo", "path", *names])

    types = dict(files.dtypes)
    return files.select("repo", "path", "content").mapInArrow(run, f"repo {types['repo']}, path {types['path']}, component string, site_id long, prop string, value string, kind string")


def declarations(css: str) -> list[tuple[int, int, str, str, str, str]]:
    """(rule_id, ord, selector, at, prop, value) of style rules: rules in the order in which they open, declarations in theirs; ``at`` is the at-rules around."""
    css = _COMMENT.sub(" ", css)
    out, stack, rules, at = [], [], 0, 0

    def declare(part: str) -> None:
        prop, found, value = part.partition(":")
        if found and stack and prop.strip() and value.strip():
            rule = stack[-1]
            name = prop.strip()
            out.append((rule[0], rule[2], rule[1] if not rule[1].startswith("@") else "", " ".join(x[1] for x in stack if x[1].startswith("@")), name if name.startswith("--") else name.lower(), value.strip()))
            rule[2] += 1

    for m in _CSS.finditer(css):
        if m[0] == "{":
            stack.append([rules, " ".join(css[at : m.start()].split()), 0])
            rules += 1
        elif m[0] == "}":
            declare(css[at : m.start()])
            if stack:
                stack.pop()
        elif m[0] == ";":
            declare(css[at : m.start()])
        else:
            continue
        at = m.end()
    return out


def css_declarations(files: DataFrame) -> DataFrame:
    """(repo, file, rule_id, ord, selector, at, prop, value) of ``content``: style sheets whole, of other files what stands in style elements.

    Null content, text without rules and unclosed braces give what was declared up to there.
    """
    names = ["rule_id", "ord", "selector", "at", "prop", "value"]

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                b = batch.slice(low, 256)
                of, rows = [], []
                for i, (path, text) in enumerate(zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True)):
                    sheet = text or ""
                    if not re.search(r"\.(css|scss|less|pcss)$", str(path)):
                        sheet = "\n".join(m[1] for m in _STYLE.finditer(sheet))
                    got = declarations(sheet)
                    of += [i] * len(got)
                    rows += got
                cols = zip(*rows, strict=True) if rows else [[]] * 6
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
                take = pa.array(of, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("repo").take(take), b.column("path").take(take), *[pa.array(list(c), t) for c, t in zip(cols, types, strict=True)]], names=["repo", "file", *names])

    types = dict(files.dtypes)
    return files.select("repo", "path", "content").mapInArrow(run, f"repo {types['repo']}, file {types['path']}, rule_id long, ord long, selector string, at string, prop string, value string")


def line_numbers(text: str, places: list[int]) -> list[int]:
    """The line (from 1) of each place."""
    ends = [i for i, c in enumerate(text) if c == "\n"]
    return [bisect_left(ends, p) + 1 for p in places]


def blanked(text: str) -> str:
    """Code with comments, string and template literals and regular expressions replaced by spaces, line by line as long as before.

    An expression inside a template stays. A slash begins a regular expression where no value stands before it.
    """
    out, done, at, n = [], 0, 0, len(text)
    inside: list[int] = []  # depth of braces in each open template expression
    last = ""  # last sign that isn't space

    def clear(a: int, b: int) -> None:
        nonlocal done
        out.append(text[done:a])
        out.append(_INK.sub(" ", text[a:b]))
        done = max(a, min(b, n))

    def template(a: int) -> int:
        """From inside a template to its end, or to an expression."""
        i = a
        while (m := _TEMPLATE.search(text, i)) is not None:
            i = m.start()
            if text[i] == "\\":
                i += 2
            elif text[i] == "`":
                clear(a, i)
                return i + 1
            else:
                clear(a, i)
                inside.append(0)
                return i + 2
        clear(a, n)
        return n

    while at < n:
        if (m := _PLAIN.match(text, at)) is not None:
            at, seen = m.end(), m[0].rstrip()
            last = seen[-1:] or last
            continue
        c = text[at]
        if text.startswith("//", at):
            end = text.find("\n", at)
            end = n if end < 0 else end
            clear(at, end)
        elif text.startswith("/*", at):
            end = text.find("*/", at + 2)
            end = n if end < 0 else end + 2
            clear(at, end)
        elif c in "'\"":
            end = at + 1
            while end < n and text[end] not in (c, "\n"):
                end += 2 if text[end] == "\\" else 1
            clear(at + 1, end)
            end, last = end + 1, c
        elif c == "`":
            end, last = template(at + 1), c
        elif c == "/" and not (last.isalnum() or last in ")]}_$'\"`"):
            end, group = at + 1, False
            while end < n and text[end] != "\n" and (group or text[end] != "/"):
                group = (group or text[end] == "[") and text[end] != "]"
                end += 2 if text[end] == "\\" else 1
            if end < n and text[end] == "/":
                clear(at + 1, end)
                end += 1
            else:
                end = at + 1
            last = "/"
        else:
            end = at + 1
            if inside and c == "{":
                inside[-1] += 1
            elif inside and c == "}":
                if inside[-1] == 0:
                    inside.pop()
                    end = template(at + 1)
                else:
                    inside[-1] -= 1
            if not c.isspace():
                last = c
        at = end
    return "".join(out) + text[done:]


def code_of(files: DataFrame) -> DataFrame:
    """``files`` with column code: the content, blanked; null content: empty."""

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                b = batch.slice(low, 256)
                yield b.append_column("code", pa.array([blanked(x or "") for x in b.column("content").to_pylist()], pa.string()))

    own = files.drop("code")
    schema = own.withColumn("code", F.lit("")).schema
    return own.mapInArrow(run, schema)
