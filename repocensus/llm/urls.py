"""URL filters: allow and block rules by host and path, and for the rest logistic regression on hashed character n-grams."""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .toxicity import fit_logistic

SIZES, SPACE = (3, 4, 5), 2**14
#: General words of hosts and paths of which the labelled table below is made, the first to be blocked.
UNWANTED = ("spam", "bets", "betting", "casino", "poker", "pills", "pharmacy", "porn", "xxx", "adult", "escort", "cams", "prize", "jackpot", "slots", "lottery", "clickbait", "warez", "keygen", "payday", "adserver", "ads", "tracking", "popunder", "banner")
WANTED = ("library", "university", "news", "museum", "docs", "weather", "recipes", "science", "history", "forum", "travel", "school", "council", "garden", "music", "health", "sports", "wiki", "shop", "maps", "photos", "theatre", "bank", "data", "kultur", "ciudad", "musique", "zeitung", "jardin", "biblioteca", "wetter", "research", "archive", "hospital", "kitchen")
HOSTS, BEHIND = ("www.{}", "m.{}", "{}", "blog.{}", "my-{}", "{}-online", "{}-24", "the-{}-site"), ("com/index.html", "org/2019/05/articles/7", "net/read?id=41")


def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled table: each word as a host in every shape, and within a path; shapes are the same for both labels, and say nothing."""
    out = []
    for words, y in ((UNWANTED, 1), (WANTED, 0)):
        for w in words:
            out += [(f"https://{a.format(w)}.{z}", y) for a in HOSTS for z in BEHIND]
            out.append((f"https://www.portal.com/{w}/17", y))
    return out


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; path: from there up to "?", "#" or the end. Both empty without "://"."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    rest = rest.split("#", 1)[0].split("?", 1)[0]
    host, slash, path = rest.partition("/")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path


def features(host: str, path: str) -> np.ndarray:
    """Hashed character n-grams of host and path, kept apart; each counts once."""
    out = set()
    for kind, text in (("h", f"^{host}$"), ("p", f"^{path.lower()}$")):
        raw = text.encode("utf-8", "replace")
        for n in SIZES:
            out.update(zlib.crc32(raw[i : i + n], ord(kind) + n) % SPACE for i in range(len(raw) - n + 1))
    return np.fromiter(out, np.int64, len(out))


@cache
def train(rows: tuple[tuple[str, int], ...], ridge: float = 0.02) -> tuple[np.ndarray, np.ndarray, float]:
    """Fit on the labelled urls: the features seen there, their weights and the constant. The fit runs on the urls' inner products, for there are fewer urls than features."""
    rows = tuple(sorted(rows))
    seen = [features(*host_and_path(u)) for u, _ in rows]
    known = np.unique(np.concatenate(seen))
    x = np.zeros((len(rows), len(known)))
    for i, f in enumerate(seen):
        x[i, np.searchsorted(known, f)] = 1 / math.sqrt(len(f))
    values, vectors = np.linalg.eigh(x @ x.T)
    keep = values > 1e-9
    basis = vectors[:, keep] * np.sqrt(values[keep])
    b = fit_logistic(np.hstack([np.ones((len(rows), 1)), basis]), np.array([float(y) for _, y in rows]), ridge)
    w = x.T @ (vectors[:, keep] / np.sqrt(values[keep])) @ b[1:]
    return known, w, float(b[0])


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], labelled: list[tuple[str, int]] | None = None) -> DataFrame:
    """page_id, host, path, rule, score, verdict of every row of ``pages`` (page_id, url; other columns are ignored).

    ``rules`` are (allow or block, "host/path"): a rule fits its host and all subdomains if the path starts with the rule's;
    the longest that fits decides. Elsewhere the score does (to be blocked from 0.5), which is given for every row.

    Null url, or one without "://": empty host and path, no rule, scored by the share of urls to be blocked in the labelled table. Very long urls are
    judged as a whole; repeated rows alike. Empty table: empty result. No shuffle; rules and weights go with the task.
    """
    labelled = labelled or labelled_urls()
    model, bad = train(tuple(labelled)), sum(y for _, y in labelled)
    prior = math.log((bad + 0.5) / (len(labelled) - bad + 0.5))
    by_host: dict[str, list[tuple[str, str, str]]] = defaultdict(list)
    for verdict, rule in rules:
        host, _, path = rule.partition("/")
        by_host[host].append(("/" + path, rule, verdict))
    for v in by_host.values():
        v.sort(key=lambda x: -len(x[1]))

    def judge(host: str, path: str):
        best = None
        labels = host.split(".")
        for i in range(len(labels)):
            for start, rule, verdict in by_host.get(".".join(labels[i:]), ()):
                if path.startswith(start) and (best is None or len(rule) > len(best[0])):
                    best = rule, verdict
        return best

    def run(batches):
        known, weights, constant = model
        for b in batches:
            rows = []
            for url in b.column("url").to_pylist():
                host, path = host_and_path(url)
                f = features(host, path)
                at = np.searchsorted(known, f)
                at[at == len(known)] = 0
                z = constant + weights[at[known[at] == f]].sum() / math.sqrt(len(f)) if len(f) else prior
                score = 1 / (1 + math.exp(-z))
                rule, verdict = judge(host, path) or (None, "block" if score >= 0.5 else "allow")
                rows.append((host, path, rule, score, verdict))
            cols = zip(zip(*rows, strict=True) if rows else [[]] * 5, (pa.string(), pa.string(), pa.string(), pa.float64(), pa.string()), strict=True)
            yield pa.RecordBatch.from_arrays([b.column("page_id"), *[pa.array(list(c), t) for c, t in cols]], names=["page_id", "host", "path", "rule", "score", "verdict"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url").mapInArrow(run, "page_id long, host string, path string, rule string, score double, verdict string")
