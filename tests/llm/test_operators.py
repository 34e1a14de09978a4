"""Each operator against a brute-force version on the smallest tables, and on tables with nulls, ties, repeats and odd columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from repocensus.llm import decontaminate, fingerprint, licences, minhash, packing, queries, suffix, tokens, toxicity, urls, warc
from repocensus.llm.common import connected_components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block int, `_id` string, digest string"


@pytest.fixture(scope="session")
def docs(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns whose names the operators use inside."""
    base = " ".join(f"word{i} of{i % 7}" for i in range(60))
    long = " ".join(f"w{i * i % 9973}" for i in range(60_000))
    rows = [(1, base), (2, base), (2, base), (3, base + " end"), (4, None), (5, ""), (None, base), (6, long), (7, long[: len(long) // 2]), (8, "  \n\t "), (9, "é" * 80), (9, "ab" * 90), (10, "one two"), (11, "One  TWO")]
    return spark.createDataFrame([(d, t, None, None, None, 1, None, "x") for d, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def encode(path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    return lambda text, end: [*tok.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# token store


def brute_store(rows, path):
    enc, start, out = encode(path), 0, []
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = enc(text, 1)
        out.append((d, start, len(ids), crc(ids)))
        start += len(ids)
    return out


def test_store_round_trip(spark, docs):
    got = queries.op1_token_store(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(rows_of(got)) == brute_store(docs, queries.vocabulary("word_bpe_49k.json"))


def test_store_odd_rows(spark, odd, empty):
    path = queries.vocabulary("word_bpe_49k.json")
    got = rows_of(tokens.store_token_ids(odd, path).select("doc_id", "start", "n_tokens", F.crc32("ids")))
    want = brute_store([(r["doc_id"], r["text"]) for r in odd.collect()], path)
    assert Counter((d, n, c) for d, _, n, c in got) == Counter((d, n, c) for d, _, n, c in want)
    assert sorted(s for _, s, _, _ in got)[0] == 0
    assert sum(n for _, _, n, _ in got) == max(s + n for _, s, n, _ in got)
    assert rows_of(tokens.store_token_ids(empty, path)) == []


def test_store_keeps_chunks_once_and_finds_damage(spark, tmp_path):
    text = " ".join(str(i * 7919 % 100_003) for i in range(9000))
    docs = spark.createDataFrame([(1, text), (2, text), (3, "x " + text)], "doc_id long, text string")
    tokens.write_store(docs, queries.vocabulary("word_bpe_49k.json"), 1, str(tmp_path / "s"))
    packs = spark.read.parquet(str(tmp_path / "s/packs")).filter("kind = 'document'").orderBy("doc_id").collect()
    stored = spark.read.parquet(str(tmp_path / "s/packs")).filter("kind = 'chunk'")
    assert packs[0]["own"] == packs[1]["own"] == [] and len(packs[2]["own"]) < 4
    assert stored.count() == stored.select("digests").distinct().count() == len(packs[0]["lens"]) > 5
    bad = spark.read.parquet(str(tmp_path / "s/packs")).withColumn("payload", F.when(F.col("kind") == "chunk", F.expr("overlay(payload placing X'ffff' from 9)")).otherwise(F.col("payload")))
    bad.write.parquet(str(tmp_path / "t/packs"))
    with pytest.raises(Exception, match="CorruptStore"):
        tokens.read_store(spark, str(tmp_path / "t")).collect()


def test_encoder_equals_library():
    rng = random.Random(5)
    alphabet = [*"abcéñß 12'.,\n\t  $#<|>", "'s", " the", "e", "́", "\xa0", "　", "한", "ᅡ", "<|endoftext|>", "Σ", "\x85", "\x1c", "😀"]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = queries.vocabulary(name)
        enc, own = encode(path), tokens.Encoder(path, room=400_000)
        for _ in range(4):
            texts = ["".join(rng.choices(alphabet, k=rng.randrange(40))) for _ in range(500)]
            for t, raw in zip(texts, own.encode(texts), strict=True):
                assert np.frombuffer(raw, "<u4").tolist() == enc(t, 0)[:-1], t


class Counted:
    """A tokenizer that notes what its model is asked."""

    def __init__(self, tokenizer):
        self.inner, self.asked = tokenizer, []

    def __getattr__(self, name):
        return getattr(self.inner, name)

    @property
    def model(self):
        return self

    def tokenize(self, form):
        self.asked.append(form)
        return self.inner.model.tokenize(form)


def test_encoder_asks_the_model_once_for_a_word():
    path = queries.vocabulary("word_bpe_49k.json")
    enc, own = encode(path), tokens.Encoder(path)
    own.tokenizer = Counted(own.tokenizer)
    for texts in (["Onerest zhéshly. eawhnd", "a onerest, ZHÉSHLY."], ["onerest.\nEawhnd zhéshly, A", "Zhéshly."]):
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [enc(t, 0)[:-1] for t in texts]
    words = [x for x in own.tokenizer.asked if x.isalnum() or "Ã" in x]
    assert len(words) == len(set(words)) == 4, own.tokenizer.asked


def test_words_are_kept_for_tasks_of_one_kind_alone():
    from repocensus.llm import common

    dropped = []
    task = lambda name, keep: list(common.tidy(iter, lambda: dropped.append(name), keep=keep)([1]))
    assert task("a", "kind a") == task("a", "kind a") == [1] and dropped == []
    task("b", "kind b")
    assert dropped == ["a"]
    task("c", None)
    assert dropped == ["a", "b", "c"]


def test_slices_hold_no_more_than_their_size():
    from repocensus.llm import common

    texts = ["x" * n for n in (3, 0, 8, 20, 1, 1, 9, 10)]
    batch = pa.record_batch({"text": texts})
    got = [b.column("text").to_pylist() for b in common.sized_slices([batch.slice(0, 3), batch.slice(3)], 10)]
    assert [x for b in got for x in b] == texts and all(len(b) == 1 or sum(map(len, b)) <= 10 for b in got)


def brute_chunks(ids):
    lens, at, h = [], 0, 0
    for i, x in enumerate(ids):
        h = sum((int(tokens._GEAR[y & 0xFFFF]) ^ (y >> 16)) << j for j, y in enumerate(reversed(ids[max(0, i + 1 - tokens.WINDOW) : i + 1]))) % 2**64
        mark = (h * 0x9E3779B97F4A7C15 % 2**64 >> 40) % tokens.MEAN == 0
        n = i + 1 - at
        if i + 1 == len(ids) or mark and n >= tokens.LEAST or n == tokens.MOST:
            lens.append(n)
            at = i + 1
    return lens


def test_chunks_of_many_documents_are_those_of_each():
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, hi, n).tolist() for hi, n in ((49_408, 1), (49_408, 16), (49_408, 6000), (200_000, 5000), (49_408, 64), (49_408, 0), (50, 3000))] + [[7] * 9000]
    got = tokens.chunk_lengths([np.array(x, "<u2" if max(x, default=0) < 2**16 else "<u4") for x in docs])
    assert got == [brute_chunks(x) for x in docs] and len(got[2]) > 5


# suffix array


def brute_spans(rows, length=50):
    first = {}
    for d, t in rows:
        raw = (t or "").encode()
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            me = -(2**63) if d is None else d
            first[s] = min(first.get(s, me), me)
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - length + 1):
            if first[raw[i : i + length]] < (-(2**63) if d is None else d):
                gone[i : i + length] = True
        gone = gone[:-1]
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out.append((d, len(raw), int(gone.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_suffix_order_sorts():
    rng = random.Random(3)
    for _ in range(150):
        raw = bytes(rng.randrange(rng.choice([1, 2, 4, 256])) for _ in range(rng.choice([1, 2, 5, 30, 200])))
        order = suffix.suffix_order(np.frombuffer(raw, np.uint8), 50)
        assert [raw[i : i + 50] for i in order] == sorted(raw[i : i + 50] for i in range(len(raw)))


def test_repeated_spans(spark, docs):
    assert Counter(rows_of(queries.op2_suffix_dedup(spark, SF))) == brute_spans(docs)


@pytest.mark.parametrize("hot", [0, 3, 10**6])
def test_repeated_spans_of_hot_phrases(spark, hot):
    rng = random.Random(8)

    def noise(n):
        return "".join(rng.choices("abcdefghij é", k=n))

    phrase, longer = "a phrase of forty bytes or nearly as many", noise(48)
    rows = [(i, noise(60) + phrase + noise(rng.choice([3, 9, 60])) + longer + noise(30)) for i in range(120)]
    rows += [(200 + i, rows[i][1][20:110] + noise(40) + rows[i + 1][1][50:105]) for i in range(0, 100, 3)]
    rows += [(400, "x" * 900), (401, "x" * 130 + noise(20)), (7, rows[3][1]), (None, rows[5][1])]
    got = suffix.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 50, hot=hot)
    flat = got.select("doc_id", "n_bytes", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]), F.size("spans"), "kept_sha256")
    assert Counter(rows_of(flat)) == brute_spans(rows)


def test_repeated_spans_odd_rows(spark, odd, empty):
    small = odd.filter("doc_id is null or doc_id not in (6, 7)")
    got = suffix.repeated_spans(small, 50)
    flat = got.select("doc_id", "n_bytes", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]), F.size("spans"), "kept_sha256")
    assert Counter(rows_of(flat)) == brute_spans([(r["doc_id"], r["text"]) for r in small.collect()])
    cut = suffix.without_repeats(odd, 50)
    assert cut.columns == odd.columns and cut.count() == odd.count()
    assert {r["doc_id"]: r["text"] for r in cut.collect()}[7] == ""
    assert rows_of(suffix.repeated_spans(empty)) == []


# urls


def test_url_rules(spark):
    by_hand = [
        (0, "http://A.Example.COM/en/x?y#z", "a.example.com", "/en/x", "example.com/en/", "block"),
        (1, "http://www.example.com/en/x", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        (2, "https://news.example.com", "news.example.com", "", None, "allow"),
        (3, "https://news.example.com/", "news.example.com", "/", "com/", "allow"),
        (4, "https://example.net/es/1", "example.net", "/es/1", "net/es/", "block"),
        (5, "nothing", "", "", None, "allow"),
        (6, None, "", "", None, "allow"),
        (7, "http://free-bets.example.org?q=/com/", "free-bets.example.org", "", None, "block"),
        (8, "http://xexample.com/en/", "xexample.com", "/en/", "com/", "allow"),
        (None, "http://e.org/" + "a" * 50_000, "e.org", "/" + "a" * 50_000, None, None),
    ]
    df = spark.createDataFrame([(p, u, None, "q") for p, u, *_ in by_hand], "page_id long, url string, host string, rule string")
    for got, want in zip(rows_of(urls.judge_urls(df, queries.RULES)), by_hand, strict=True):
        assert (got[0], *got[1:4]) == (want[0], *want[2:5])
        assert want[5] in (None, got[5])
    assert rows_of(urls.judge_urls(df.limit(0), queries.RULES)) == []


def test_url_model_held_out():
    """Trained without a quarter of the rows, it judges the words of the rest right in shapes that it hasn't seen them in."""
    rows = urls.labelled_urls()
    known, w, c = urls.train(tuple(r for i, r in enumerate(rows) if i % 4))
    right = []
    for u, y in rows[::4]:
        f = urls.features(*urls.host_and_path(u))
        seen = f[np.isin(f, known)]
        right.append((c + w[np.searchsorted(known, seen)].sum() / np.sqrt(len(f)) >= 0) == bool(y))
    assert np.mean(right) > 0.9


def test_url_labels_of_one_class(spark):
    df = spark.createDataFrame([(1, "http://a.org/x"), (2, None)], "page_id long, url string")
    assert {r["verdict"] for r in urls.judge_urls(df, [], [("http://bad.org/a", 1), ("http://worse.org/b", 1)]).collect()} == {"block"}
    assert {r["verdict"] for r in urls.judge_urls(df, [], [("http://good.org/a", 0)]).collect()} == {"allow"}


def test_urls_of_all_pages(spark):
    """Every page against rules and a score worked out url by url."""
    pages = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()]
    known, w, c = urls.train(tuple(urls.labelled_urls()))
    want = set()
    for page, url in pages:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = ("".join(x.lower() if x.isascii() else x for x in m[1]), m[2]) if m else ("", "")
        fits = [(len(r), r, v) for v, r in queries.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        _, rule, verdict = max(fits, default=(0, None, None))
        if rule is None:
            f = urls.features(host, path)
            z = c + sum(w[list(known).index(x)] for x in f if x in set(known)) / np.sqrt(len(f))
            verdict = "block" if z >= 0 else "allow"
        want.add((page, host, path, rule, verdict))
    assert {tuple(r)[:5] for r in queries.op3_url_filter(spark, SF).collect()} == want and len(want) == len(pages)


# packing


def check_packing(rows, got, path, size=1024):
    enc = encode(path)
    want = Counter()
    for d, t in rows:
        want[(d, tuple(enc(t, 0)))] += 1
    pieces, used = defaultdict(list), defaultdict(list)
    for d, start, length, crc32, total, seq, offset in got:
        pieces[d].append((total, start, length, crc32))
        used[seq].append((offset, length))
    for seq in used.values():
        at = 0
        for offset, length in sorted(seq):
            assert offset == at
            at += length
        assert at <= size
    need = Counter()
    for (d, ids), n in want.items():
        for at in range(0, len(ids), size):
            need[(d, at, len(ids[at : at + size]), crc(ids[at : at + size]), len(ids))] += n
    assert need == Counter((d, s, n, c, t) for d, s, n, c, t, _, _ in got)
    return len(used), sum(n for _, _, n, _, _, _, _ in got)


def test_packing(spark, docs):
    windows, n = check_packing(docs, rows_of(queries.op4_packing(spark, SF)), queries.vocabulary("byte_bpe_50k.json"))
    assert windows * 1024 - n < 1024 + 0.02 * n


def test_packing_odd_rows(spark, odd, empty):
    path = queries.vocabulary("byte_bpe_50k.json")
    got = packing.pack_documents(odd, path, digest=True).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    check_packing([(r["doc_id"], r["text"]) for r in odd.collect()], rows_of(got), path)
    real = packing.pack_documents(odd, path)
    assert sum(len(r["ids"]) // 4 for r in real.collect()) == sum(r["length"] for r in got.collect())
    assert rows_of(packing.pack_documents(empty, path)) == []


def test_packed_sequences_hold_the_ids(spark):
    """The pipeline's last stage gives ids that make up whole sequences and every text again; wide ids stay whole."""
    import corpus_pipeline

    rng = random.Random(8)
    rows = [(d, " ".join(f"w{rng.randrange(500)}" for _ in range(rng.choice([0, 3, 200, 900])))) for d in range(40)]
    got = corpus_pipeline.pack(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    enc, texts, windows = encode(queries.vocabulary("byte_bpe_50k.json")), defaultdict(list), defaultdict(list)
    for r in sorted(got, key=lambda r: (r["doc_id"], r["start"])):
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"]
        texts[r["doc_id"]] += ids
        windows[r["sequence_id"]].append((r["offset"], ids))
    assert dict(texts) == {d: enc(t, 0) for d, t in rows}
    for parts in windows.values():
        assert [o for o, _ in sorted(parts)] == [sum(len(i) for _, i in sorted(parts)[:k]) for k in range(len(parts))]
        assert sum(len(i) for _, i in parts) <= 1024
    wide = [(1, [5, 2**16, 7]), (2, [2**16 - 1] * 5)]
    ids = spark.createDataFrame([(d, bytearray(np.array(i, "<u4").tobytes())) for d, i in wide], "doc_id long, ids binary")
    out = packing.pack_pieces(ids.mapInArrow(packing.cut_windows(4), packing.PIECES), 4).orderBy("doc_id", "start").collect()
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in out] == [[5, 2**16, 7], [2**16 - 1] * 4, [2**16 - 1]]


def test_plan_is_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(60):
        size = rng.choice([8, 16, 64])
        lengths = sorted((rng.randrange(1, size + 1) for _ in range(rng.randrange(1, 200))), reverse=True)
        open_windows: list[int] = []
        for n in lengths:
            fit = [c for c in open_windows if c >= n]
            if fit:
                open_windows.remove(min(fit))
                open_windows.append(min(fit) - n)
            else:
                open_windows.append(size - n)
        plan, windows = packing.best_fit_plan(Counter(lengths), size)
        assert windows == len(open_windows)
        left = Counter({w: size for w in range(windows)})
        for length, _, n, window, per, _ in plan:
            for i in range(n):
                left[window + i // per] -= length
        assert Counter(left.values()) == Counter(open_windows)


# decontamination


def brute_leaks(docs, items):
    out = {}
    for d, t in docs:
        if d is None:
            continue
        words = decontaminate.words_of(t or "")
        grams = {tuple(words[i : i + 5]) for i in range(len(words))}
        for i, q in items:
            item = decontaminate.words_of(q or "")
            if item and any(tuple(item[k : k + 5]) in grams for k in range(max(1, len(item) - 4))):
                score = decontaminate.align(item, words)[0]
                if score >= decontaminate.LEAST_SCORE:
                    out[(d, i)] = round(score, 6)
    return out


def test_decontamination(spark, docs):
    items = rows_of(spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text"))
    got = {(r["doc_id"], r["item_id"]): round(r["score"], 6) for r in queries.op5_decontamination(spark, SF).collect()}
    assert got == brute_leaks(docs, items) and got


def test_decontamination_finds_edits(spark, odd, empty):
    item = " ".join(f"term{i}" for i in range(40))
    edited = item.split()
    edited[12] = "other"
    del edited[25]
    docs = spark.createDataFrame([(1, "before it " + " ".join(edited) + " after it"), (2, " ".join(item.split()[:8])), (3, None), (None, item), (4, item), (4, item)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "two words"), (None, item)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(docs, bench).collect()}
    assert set(got) == {(1, 7), (4, 7)}
    assert got[(4, 7)]["score"] == 1 and 0.9 < got[(1, 7)]["score"] < 1
    assert (got[(1, 7)]["first_word"], got[(1, 7)]["end_word"]) == (2, 41)
    assert rows_of(decontaminate.contaminated(empty, bench)) == [] and rows_of(decontaminate.contaminated(odd, bench.limit(0))) == []
    assert decontaminate.without_leaks(odd, bench).columns == odd.columns


def test_decontamination_finds_edits_beside_exact_copies(spark):
    """A copy edited every seven words while an exact copy has all its n-grams too, and copies with long insertions."""
    item = [f"term{i}" for i in range(40)]
    seventh = [f"other{i}" if i % 7 == 6 else w for i, w in enumerate(item)]
    inserted = [*item[:20], *(f"x{i}" for i in range(30)), *item[20:]]
    short = [*item[:6], *(f"y{i}" for i in range(300))]
    rng = random.Random(6)
    rows = [(1, " ".join(item)), (2, " ".join(seventh)), (3, " ".join(inserted)), (4, " ".join(short))]
    for d in range(5, 60):
        rows.append((d, " ".join(w for x in item for w in ([f"z{d}"] * rng.randrange(3) if rng.random() < 0.15 else [x]))))
    bench = [(7, " ".join(item))]
    for some, sure in ((rows[:2], {(1, 7), (2, 7)}), (rows[2:4], {(3, 7)}), (rows, {(1, 7), (2, 7), (3, 7)})):
        got = decontaminate.contaminated(spark.createDataFrame(some, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
        got = {(r["doc_id"], r["item_id"]): round(r["score"], 6) for r in got.collect()}
        assert got == brute_leaks(some, bench) and sure <= set(got) and (4, 7) not in got


def test_alignment_by_hand():
    assert decontaminate.align("a b c d".split(), "x a b c d y".split()) == (1.0, 1, 5)
    assert decontaminate.align("a b c d".split(), "x y z".split()) == (0.0, 0, 0)


# fingerprints


def brute_fingerprints(rows):
    rows = sorted(rows)
    out = []
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1] or ""
        t = t or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = (fingerprint.fingerprint(x.encode()) for x in (t, edited, after))
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, fingerprint.likeness(a, b), fingerprint.likeness(a, c)))
    return out


def test_fingerprints(spark, docs):
    got = sorted(rows_of(queries.op6_fingerprints(spark, SF)))
    assert got == brute_fingerprints(docs)
    assert np.mean([r[5] > r[6] for r in got]) > 0.95


def test_fingerprints_odd_rows(spark, odd, empty):
    plain = odd.filter("doc_id is not null").dropDuplicates(["doc_id"])
    got = sorted(rows_of(fingerprint.edited_pairs(plain)))
    assert got == brute_fingerprints([(r["doc_id"], r["text"]) for r in plain.collect()])
    assert fingerprint.edited_pairs(odd).count() == odd.count()
    one = odd.filter("doc_id = 1")
    assert rows_of(fingerprint.edited_pairs(one))[0][6] == 1.0
    assert rows_of(fingerprint.edited_pairs(empty)) == []
    assert fingerprint.likeness(fingerprint.fingerprint(b""), fingerprint.fingerprint(b"")) == 1
    assert fingerprint.likeness(fingerprint.fingerprint(b"cat"), fingerprint.fingerprint(b"dog")) < 1


# archives


def brute_warc(rows):
    last = {}
    for p, _, h in rows:
        raw = (h or "").encode()
        if len(raw) >= 1000 and p is not None:
            last[raw] = max(last.get(raw, p), p)
    out = []
    for p, _, h in rows:
        raw = (h or "").encode()
        to = last.get(raw, p) if p is not None else None
        out.append((p, len(raw), hashlib.sha1(raw).hexdigest(), "response" if to in (p, None) else "revisit", None if to == p else to))
    return Counter(out)


def test_archives(spark):
    rows = rows_of(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html"))
    got = queries.op7_warc(spark, SF)
    assert Counter(rows_of(got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))) == brute_warc(rows)
    order = [(r["url_key"], r["date"], r["page_id"]) for r in got.orderBy("range", "place").collect()]
    assert order == sorted(order)
    assert len({d for _, d, _ in order}) > len(rows) // 2 and all(re.fullmatch(r"2024-\d\d-\d\dT\d\d:\d\d:\d\dZ", d) for _, d, _ in order)


def test_archives_odd_rows(spark, tmp_path):
    big = "<p>" + "é\r\n\r\nWARC/1.1\r\n" * 200
    rows = [(1, "http://a/x\r\nX: y", big), (2, None, big), (2, None, big), (3, "http://b", None), (None, "http://c", big), (4, "", ""), (5, "http://a/x", "short"), (6, "http://a/x", "short")]
    pages = spark.createDataFrame([(*r, "x", None) for r in rows], "page_id long, url string, html string, digest string, file string")
    warc.write_archives(pages, str(tmp_path / "w"), records_per_file=3)
    got = warc.read_archives(spark, str(tmp_path / "w"), payloads=True)
    assert Counter(rows_of(got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))) == brute_warc(rows)
    assert all(r["payload"].decode() == big for r in got.filter("page_id = 2").collect())
    assert warc.merged_index(got).count() == len(rows)
    assert rows_of(warc.archive_and_index(pages.limit(0))) == []


def test_loser_tree():
    rng = random.Random(2)
    for _ in range(60):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(12))) for _ in range(rng.randrange(9))]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


# near duplicates


def brute_shingles(text, width):
    w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (text or "").encode()))
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) or frozenset([tuple(w)] if w else [])


def brute_components(rows, width, per_cent=80):
    sets = [brute_shingles(t, width) for _, t in rows]
    comp = {d: d for d, _ in rows}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    at = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            at[x].append(i)
    seen = Counter((a, b) for v in at.values() for k, a in enumerate(v) for b in v[k + 1 :])
    for (a, b), both in seen.items():
        if 100 * both >= per_cent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(rows[a][0]), root(rows[b][0])))
            comp[y] = x
    return sorted((d, len(s), root(d), root(d) == d) for (d, _), s in zip(rows, sets, strict=True))


def test_near_duplicates(spark, docs):
    assert sorted(rows_of(queries.op8_near_duplicates(spark, SF))) == brute_components(docs, 4)


def test_near_duplicate_groups(spark):
    """A large group whose members differ, some of them below the threshold from each other."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for d in range(250):
        w = list(words)
        for _ in range(rng.randrange(14)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((d, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(rows_of(minhash.near_duplicates(df, 4))) == brute_components(rows, 4)


def test_near_duplicates_odd_rows(spark, odd, empty):
    got = {(r["doc_id"], r["n_shingles"]): r for r in minhash.near_duplicates(odd, 4).collect()}
    assert minhash.near_duplicates(odd, 4).count() == odd.count()
    assert [got[k]["component_id"] for k in ((1, 117), (2, 117), (3, 118))] == [1, 1, 1]
    assert got[(4, 0)]["component_id"] == 4 and got[(5, 0)]["kept"] and got[(8, 0)]["component_id"] == 8
    assert got[(None, 117)]["component_id"] is None and got[(None, 117)]["kept"]
    assert got[(11, 1)]["component_id"] == 10
    assert rows_of(minhash.near_duplicates(empty)) == []


def test_near_duplicates_short_pairs(spark):
    """Many pairs of 4 and 5 shingles, at exactly 0.8."""
    rows = []
    for i in range(1500):
        words = [f"v{i}x{k}" for k in range(8)]
        rows += [(2 * i, " ".join(words[:7])), (2 * i + 1, " ".join(words))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4)
    assert sorted(rows_of(got)) == brute_components(rows, 4)


def test_low_bits_agree_independently():
    """Of two different minima the kept bits agree in a quarter of the hashes, for each pair of values."""
    rng = np.random.default_rng(12)
    for _ in range(300):
        x, y = (minhash.packed(minhash.minima(rng.integers(0, 2**63, 1, dtype=np.uint64))).view(np.uint64) for _ in range(2))
        z = x ^ y
        differ = sum(int(v).bit_count() for v in ((z | (z >> np.uint64(1))) & np.uint64(0x5555555555555555)).tolist())
        assert 0.15 < 1 - differ / minhash.N_HASH < 0.35


def test_connected_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(90)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(70)] + [(None, 3), (5, 5)]
    comp = {}
    links = defaultdict(set)
    for a, b in edges:
        if a is not None and a != b:
            links[a].add(b)
            links[b].add(a)
    for start in sorted(links):
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in comp:
                comp[x] = start
                todo += links[x]
    assert dict(rows_of(connected_components(spark.createDataFrame(edges, "a long, b long")))) == comp


# toxicity


def test_toxicity_held_out(spark):
    got = queries.op9_toxicity(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("held_out").collect()
    pos, neg = [r["score"] for r in got if r["toxic"]], [r["score"] for r in got if not r["toxic"]]
    assert np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg]) > 0.65
    assert sum(r["predicted"] for r in got if not r["toxic"]) == 0
    assert all((r["score"] >= 0.5) == bool(r["predicted"]) and 0 <= r["score"] <= 1 for r in got)


def test_toxicity_folding_and_exceptions(spark, odd, empty):
    lexicon = toxicity.Lexicon({"idiot": 2.0, "clown": 1.0})
    assert lexicon.weight("You 1d10t!") == 2 and lexicon.weight("ІDІОТ$$$") == 2 and lexicon.weight("idiotic") == 0
    assert lexicon.weight("a clown fish") == 0 and lexicon.weight("a clown") == 1
    assert len(toxicity.fold("İdıot 𝟏")) == len("İdıot 𝟏")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    assert toxicity.toxicity(odd, model).count() == odd.count() and rows_of(toxicity.toxicity(empty, model)) == []
    assert toxicity.without_toxic(odd, model).columns == odd.columns


# licences


def test_licences(spark):
    files = [
        ("a/b/c/one.txt", "text\nLicensed under CC BY-NC 4.0."), ("a/b/c/two.txt", "nothing"), ("a/LICENSE", "Released under the MIT License."),
        ("a/b/LICENSE.md", "no terms"), ("a/b/c/d/COPYING", "All rights reserved."), ("a/b/c/d/e/x", None), ("x/y", ""), (None, "All rights reserved"), ("top", "t"), ("a/b/c/two.txt", "nothing"),
    ]
    got = rows_of(licences.scan_licences(spark.createDataFrame([(*f, "z") for f in files], "path string, text string, licence string")).select("path", "own_licence", "inherited_licence", "inherited_from", "licence", "basis"))
    assert Counter(got) == Counter([
        ("a/b/c/one.txt", "CC-BY-NC-4.0", "MIT", "a", "CC-BY-NC-4.0", "own"), ("a/b/c/two.txt", None, "MIT", "a", "MIT", "inherited"), ("a/LICENSE", "MIT", "MIT", "a", "MIT", "own"),
        ("a/b/LICENSE.md", None, "MIT", "a", "MIT", "inherited"), ("a/b/c/d/COPYING", "Proprietary", "Proprietary", "a/b/c/d", "Proprietary", "own"), ("a/b/c/d/e/x", None, "Proprietary", "a/b/c/d", "Proprietary", "inherited"),
        ("x/y", None, None, None, None, "none"), (None, "Proprietary", None, None, "Proprietary", "own"), ("top", None, None, None, None, "none"), ("a/b/c/two.txt", None, "MIT", "a", "MIT", "inherited"),
    ])
    assert rows_of(licences.scan_licences(spark.createDataFrame([], "path string, text string"))) == []
