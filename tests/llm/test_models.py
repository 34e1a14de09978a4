"""Whitening, language models and phrases against brute force in plain Python, and on odd tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from repocensus.llm import language, phrases, queries, whitening

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, v string, id string, whitened int"
TEXTS = "doc_id long, text string, lang string, source string, n_chars long, word string, ids int, number string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, None, "x", None, 1) for i, v in rows], VECTORS)


def brute_whitening(rows):
    """Fractions throughout: sums, covariances, deviations."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    n, dims = len(x), len(x[0])
    sums = [sum(r[k] for r in x) for k in range(dims)]
    centred = [[Fraction(n * r[k] - sums[k], n) for k in range(dims)] for r in x]
    cov = [[sum(r[i] * r[j] for r in centred) / n for j in range(dims)] for i in range(dims)]
    return n, sums, np.array(cov, float), [int(sum((n * c) ** 2 for c in r)) for r in centred], np.array(centred, float)


def test_whitening_equals_fractions(spark):
    rows = [(r["vec_id"], [float(c) for c in r["embedding"]]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    n, sums, cov, deviation, centred = brute_whitening([(i, [*v[:6]]) for i, v in rows])
    df = vectors(spark, [(i, v[:6]) for i, v in rows]).repartition(5)
    model = whitening.fit(df, components=4)
    assert (model.n, model.sums) == (n, sums)
    assert np.array_equal(model.covariance, cov)
    values, axes = np.linalg.eigh(cov)
    want = centred @ axes[:, ::-1][:, :4] / np.sqrt(values[::-1][:4])
    got = {r["vec_id"]: r for r in whitening.whitened(df, model).collect()}
    for (i, _), d, w in zip(rows, deviation, want, strict=True):
        assert int(got[i]["deviation"]) == d
        assert np.allclose(np.abs(got[i]["whitened"]), np.abs(w), rtol=1e-9, atol=1e-9)
    assert np.allclose(model.explained, values[::-1][:4] / cov.trace(), rtol=1e-12)
    assert model.error < 1e-9


def test_whitening_query(spark):
    out = queries.op11_whitening(spark, SF).toPandas()
    assert len(out) == 32 * spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert out.identity_error.nunique() == 1
    assert out.identity_error[0] < 1e-6
    assert (out.groupby("vec_id").deviation.nunique() == 1).all()
    first = out[out.component == 1].whitened
    assert abs((first**2).mean() - 1) < 1e-6
    assert abs(first.mean()) < 1e-9


def test_whitening_odd_rows(spark):
    good = [(k, [float(k % 3), float(k % 5), 1e15 * (k % 2)]) for k in range(12)]
    bad = [(90, None), (91, []), (92, [1.0, None, 2.0]), (93, [1.0, float("nan"), 0.0]), (94, [1.0, float("inf"), 0.0]), (95, [1.0, 2.0]), (96, [1e30, 0.0, 0.0])]
    again = [(None, good[0][1]), (1, good[1][1]), (1, good[1][1])]
    model = whitening.fit(vectors(spark, good + bad + again))
    got = whitening.whitened(vectors(spark, good + bad + again), model).collect()
    assert sorted(-1 if r["vec_id"] is None else r["vec_id"] for r in got) == sorted([*range(12), -1, 1, 1])
    n, sums, cov, deviation, _ = brute_whitening([(i, [float(np.float32(c)) for c in v]) for i, v in good + again])
    assert (n, sums) == (model.n, model.sums)
    assert np.array_equal(cov, model.covariance)
    want = dict(zip([i for i, _ in good], deviation, strict=False))
    assert all(int(r["deviation"]) == want[r["vec_id"]] for r in got if r["vec_id"] is not None)
    empty = vectors(spark, [])
    assert whitening.whitened(empty, whitening.fit(empty)).collect() == []
    assert whitening.fit(vectors(spark, bad[:2])).n == 0
    still = whitening.fit(vectors(spark, [(k, [1.0, 2.0, float(k)]) for k in range(5)]))
    assert len(still.values) == 1  # dimensions without variance give no component


def brute_kneser_ney(texts, order=5):
    """Probability of a gram by the definition: absolute discounting, lower orders by distinct characters before."""
    counts = {k: Counter() for k in range(1, order + 1)}
    for t in texts:
        clean = " ".join(re.findall(r"[^\W\d_]+", t.lower()))
        padded = " " * (order - 1) + clean + " "
        counts[order].update(padded[i : i + order] for i in range(len(padded) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k].update(g[1:] for g in counts[k + 1])
    discount = {}
    for k, c in counts.items():
        once, twice = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        discount[k] = once / (once + 2 * twice) if once and twice else 0.5
    totals = {k: Counter() for k in counts}
    kinds = {k: Counter() for k in counts}
    for k, c in counts.items():
        for g, v in c.items():
            totals[k][g[:-1]] += v
            kinds[k][g[:-1]] += min(v, discount[k])
    letters = len(counts[1]) + 1

    def p(gram):
        if not gram:
            return 1 / letters
        k, h = len(gram), gram[:-1]
        lower = p(gram[1:])
        if not totals[k][h]:
            return lower
        return max(counts[k][gram] - discount[k], 0) / totals[k][h] + kinds[k][h] / totals[k][h] * lower

    return p, counts


def test_language_model_equals_definition(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["the", "then", "other", "moth", "Été", "co-op", "naïve"]) for _ in range(rng.randint(1, 30))) for _ in range(60)]
    docs = spark.createDataFrame([(k, t, "xx", None, None, "a", 1, "b") for k, t in enumerate(texts)], TEXTS)
    model = language.fit(docs, calibration_rows=0)
    learned = [t for k, t in enumerate(texts) if zlib.crc32(str(k).encode()) % 5 > 1]
    p, counts = brute_kneser_ney(learned)
    for gram in [*list(counts[5])[:200], "zzzzz", "ethem", "ther ", "    q", "other"]:
        chars = np.array([ord(c) for c in gram], np.uint32)
        got = float(model.log_probabilities(chars, np.array([4]))[0, 0])
        assert got == pytest.approx(math.log(p(gram)), abs=2e-5), gram
    for context in ("othe", "    ", "zzzz", "then"):
        alphabet = [g for g in counts[1]]
        assert sum(p(context + c) for c in alphabet) <= 1 + 1e-9


def test_language_pruned_model_still_sums_to_one():
    rows = [("xx", "a", 5, 10), ("xx", "b", 5, 10), ("xx", "aa", 6, 8), ("xx", "ab", 1, 8)]
    model = language.build([r for r in rows if r[1] != "ab"], {("xx", k): 0.5 for k in (1, 2)}, ["xx"])

    def p(gram):
        return math.exp(float(model.log_probabilities(np.array([ord(c) for c in gram], np.uint32), np.array([len(gram) - 1]), len(gram))[0, 0]))

    missing = math.exp(float(model.contexts[1][1][0, 0]))  # of the shortest context: what is left for unknown characters
    assert p("aa") + p("ab") == pytest.approx(1 - (1 - p("a") - p("b")) * (1 - 5.5 / 8), abs=1e-6)
    assert 0 < missing < 1


def test_language_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = queries.op12_language(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert len(out) > 100
    assert (out.lang == out.lang_pred).mean() >= 0.99
    assert out.score.between(0, 1).all()
    assert out.accepted.mean() > 0.95


def test_language_rejects_what_it_never_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs)
    strange = ["xqzw vvkj qqxz wkjx zzqv " * 20, "Привет как дела сегодня хорошо " * 20, "漢字仮名交じり文の例です" * 20]
    langs, score, fits = model.judge(strange)
    assert set(langs) <= set(model.langs)
    assert not fits.any()
    assert ((score >= 0) & (score <= 1)).all()


def test_language_odd_rows(spark):
    rows = [(1, "the cat sat", "en"), (2, None, "en"), (3, "", None), (4, "1234 5678 !?", "de"), (None, "the cat", None), (5, "der hund und die katze " * 9000, "de"), (5, "der hund", "de"), (6, "İstanbul ퟿ é", "en")]
    docs = spark.createDataFrame([(d, t, g, None, None, "w", 2, "n") for d, t, g in rows], TEXTS)
    out = language.languages(docs, language.fit(docs)).collect()
    assert len(out) == len(rows)
    und = {r["doc_id"] for r in out if r["lang_pred"] == "und"}
    assert und >= {2, 3, 4}
    assert all((r["score"] == 0 and not r["accepted"]) for r in out if r["lang_pred"] == "und")
    unlearned = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.languages(unlearned, language.fit(unlearned)).collect()} == {"und"}
    nothing = docs.filter("false")
    assert language.languages(nothing, language.fit(nothing)).collect() == []


def brute_phrases(rows, least, top):
    counts = defaultdict(lambda: defaultdict(int))
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall("[^ \t]+", piece)
            for m in range(1, 6):
                for i in range(len(words) - m + 1):
                    counts[lang or "und"][tuple(words[i : i + m])] += 1
    out = []
    for lang, f in counts.items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        several = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in several.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside[p[i : i + m]], a)
        rows_ = []
        for p, a in several.items():
            if 100 * inside[p] < 100 * a:
                score, k = min(((1000 * a * n) // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                rows_.append((score, a, " ".join(p), f[p[:k]], f[p[k:]], n))
        rows_.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, i + 1, p, a, x, y, n, s) for i, (s, a, p, x, y, n) in enumerate(rows_[:top])]
    return sorted(out)


def texts(spark, rows):
    return spark.createDataFrame([(k, t, g, None, None, "w", 2, "n") for k, (g, t) in enumerate(rows)], TEXTS)


@pytest.mark.parametrize("width", [2_000_000, 3])
def test_phrases_equal_brute_force(spark, monkeypatch, width):
    rng = random.Random(width)
    words = "a b of the New York é ça straße  x x y".split(" ")
    rows = [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", ";"]) for _ in range(rng.randint(0, 40)))) for _ in range(120)]
    rows += [("en", None), ("en", ""), (None, "...;;"), ("en", "a " * 5000), ("de", "new york " * 50), ("de", "new york " * 50)]
    if width == 3:  # several passes for words and for candidates
        monkeypatch.setattr(phrases, "CANDIDATES_A_PASS", width)
        real = phrases.phrases
        monkeypatch.setattr(phrases, "phrases", lambda docs, least, longest: real(docs, least, longest, width=200 if width > 3 else 60))
        rows = rows[:40] + rows[-6:]
    got = sorted(tuple(r) for r in phrases.collocations(texts(spark, rows), least=5, top=25).collect())
    assert got == brute_phrases(rows, 5, 25)


def test_phrases_of_nothing(spark):
    assert phrases.collocations(texts(spark, [])).collect() == []
    assert phrases.collocations(texts(spark, [("en", None), ("en", "one two")])).collect() == []


def test_phrases_query_equals_sql(spark):
    got = sorted(tuple(r) for r in queries.op13_collocations(spark, SF).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(queries.ORACLES["op13_collocations"]).fetchall()
    assert got == sorted(want)


def test_trie_finds_what_a_dictionary_finds():
    rng = np.random.default_rng(3)
    for depth, letters, n in ((1, 50, 20), (2, 30, 300), (3, 200, 5000), (5, 4, 400), (2, 10**7, 500)):
        seqs = np.unique(rng.integers(1, letters, (n, depth)), axis=0)
        trie = phrases.Trie(seqs)
        stream = rng.integers(-1, letters, 4000)
        stream[100 : 100 + depth * 50] = seqs[rng.integers(0, len(seqs), 50)].ravel()
        known = {tuple(s): i for i, s in enumerate(seqs.tolist())}
        want = [known.get(tuple(stream[i : i + depth].tolist()), -1) for i in range(len(stream))]
        assert trie.walk(stream).tolist() == want


def test_words_are_cut_at_every_bound():
    import pyarrow as pa

    texts = ["Ab c.d", "", "e", "\tf\x0bg ", "é;É", "...", "h"]
    words, owner, begins = phrases.words_of(pa.array(texts))
    assert words.to_pylist() == ["ab", "c", "d", "e", "f", "g", "é", "É", "h"]
    assert owner.tolist() == [0, 0, 0, 2, 3, 3, 4, 4, 6]
    assert begins.tolist() == [True, False, True, True, True, True, True, True, True]


def test_more_of_the_same_text_keeps_the_same_ngrams(spark):
    rng = random.Random(5)
    texts = [(" ".join("".join(rng.choices(letters, range(9, 0, -1), k=5)) for _ in range(40)), lang) for letters, lang in (("abcdefghi", "aa"), ("ghijklmno", "bb")) for _ in range(20)]
    counted = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5 == 2]
    models = []
    for times in (1, 3, 7):
        rows = [(i, *x) for i, x in zip(counted, texts * times)]
        models.append(language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), cells=3000))
    for k in range(1, language.ORDER + 1):
        assert len({m.tables[k][0].tobytes() for m in models}) == 1
    assert 0 < sum(m.tables[k][1].size for m in models[:1] for k in range(2, language.ORDER + 1)) <= 3000


def test_a_model_of_many_blocks_judges_as_one(spark):
    rng = random.Random(8)
    texts = [(" ".join("".join(rng.choices(letters, range(len(letters), 0, -1), k=5)) for _ in range(rng.randint(1, 30))), lang) for letters, lang in (("abcdefghi", "aa"), ("cdefghijß", "bb"), ("bcdefgh𝒜", "cc")) for _ in range(150)]
    docs = spark.createDataFrame([*((i, *x) for i, x in enumerate(texts)), (None, "", None), (7, None, "aa"), (7, "qqq", None)], "doc_id long, text string, lang string")
    one, many = language.fit(docs), language.fit(docs, cells=4000)
    assert not one.further
    assert len(many.further) > 2
    for m in many.blocks(spark):
        assert sum(m.tables[k][1].size for k in range(2, language.ORDER + 1)) <= 4000
    assert (one.scale, one.limits) == (many.scale, many.limits)
    got, want = (sorted(map(tuple, language.languages(docs, m).collect()), key=str) for m in (many, one))
    assert [(d, p, a) for d, p, _, a in got] == [(d, p, a) for d, p, _, a in want]
    assert [s for _, _, s, _ in got] == pytest.approx([s for _, _, s, _ in want], abs=1e-9)


def test_no_ngram_is_left_out(spark):
    counted = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 5 > 1]
    docs = spark.createDataFrame([(i, "aaaa" * 200 if j else "zyxwv", "en") for j, i in enumerate(counted)], "doc_id long, text string, lang string")
    model = language.fit(docs, cells=3000, calibration_rows=0)
    chars = np.array([ord(c) for c in "zyxwv"], np.uint32)
    assert model._find(model.tables[5], language.hashes_at(chars, np.array([4]), 5))[1].all()


def test_calibration_takes_all_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language, "calibrate", lambda model, rows: seen.append(rows.count()))
    docs = spark.range(27_000).selectExpr("id as doc_id", "'some words' as text", "'en' as lang")
    language.fit(docs)
    assert seen == [docs.filter("crc32(cast(doc_id as string)) % 5 = 1").count()]
    assert seen[0] > 5000


def made_pairs(n):
    """Pairs of numbers, few of them with many followers, as words have."""
    rng = np.random.default_rng(1)

    def drawn():
        return np.minimum((rng.pareto(0.6, 3 * n) * 3).astype(np.int64) + 1, rng.integers(1, n // 3, 3 * n))

    pairs = np.unique(np.stack([drawn(), drawn()], axis=1), axis=0)
    return pairs[np.sort(rng.permutation(len(pairs))[:n])]


def test_trials_of_a_trie_grow_with_its_sequences(monkeypatch):
    pairs, trials, real = made_pairs(40_000), [], phrases.Trie._reach
    monkeypatch.setattr(phrases.Trie, "_reach", lambda self, need: (trials.append(need), real(self, need))[1])
    trie = phrases.Trie(pairs)
    several = int((np.unique(pairs[:, 0], return_counts=True)[1] > 1).sum())
    assert len(trials) < 2 * several + len(trie.base) / 32
    assert trie.walk(np.append(pairs.ravel(), -1))[: 2 * len(pairs) : 2].tolist() == list(range(len(pairs)))


def test_counts_that_come_in_many_parts_are_sorted_few_times(monkeypatch):
    rng, total, real = np.random.default_rng(2), [], np.unique
    parts = [(real(rng.integers(0, 1 << 31, 20_000)), None) for _ in range(60)]
    parts = [(x, rng.integers(1, 9, len(x))) for x, _ in parts] + [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    with monkeypatch.context() as m:
        m.setattr(phrases.np, "unique", lambda x, **k: (total.append(len(x)), real(x, **k))[1])
        numbers, n = phrases.summed(parts)
    want = defaultdict(int)
    for x, y in parts:
        for k, c in zip(x.tolist(), y.tolist()):
            want[k] += c
    assert dict(zip(numbers.tolist(), n.tolist())) == want
    assert sum(total) < 4 * sum(len(x) for x, _ in parts)
    assert [len(a) for a in phrases.summed([])] == [0, 0]
