"""The pipeline, stage by stage, against brute force; its stages on odd tables; scores and recall that can't be worked out by SQL."""

import random
import re

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from repocensus.llm import decontaminate, licences, minhash, queries, toxicity
from test_operators import SCHEMA, SF, brute_components, brute_leaks, check_packing, docs, empty, odd, rows_of  # noqa: F401


def brute_weight(text, weights):
    """Each term searched for on its own: whole words of the folded text, not within an exception phrase."""
    folded = toxicity.fold(text)

    def places(term):
        return [(m.start(), m.start() + len(term)) for m in re.finditer(f"(?={re.escape(term)})", folded) if not (text[: m.start()][-1:].isalnum() or text[m.start() + len(term) :][:1].isalnum())]

    covered = [x for p in toxicity.EXCEPTIONS for x in places(toxicity.fold(p))]
    return sum(w for term, w in weights.items() for a, b in places(term) if not any(x <= a and b <= y for x, y in covered))


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.fit(queries.read(spark, SF, "documents"), queries.read(spark, SF, "labels"))


def brute_score(text, model):
    return 1 / (1 + np.exp(-np.dot(model.curve, toxicity.features(brute_weight(text or "", model.weights), text or ""))))


def test_every_score(spark, model):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op9_toxicity(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        assert abs(r["score"] - brute_score(texts[r["doc_id"]], model)) < 1e-9


def test_learning_does_not_see_the_layout(spark):
    d, labels = queries.read(spark, "/root/testdata/sf0.01", "documents"), queries.read(spark, "/root/testdata/sf0.01", "labels")
    one, many = toxicity.fit(d.coalesce(1), labels), toxicity.fit(d.unionByName(d).repartition(7), labels)
    assert one.weights == many.weights and one.curve == many.curve


def cut(rows, length=50):
    """Texts without the bytes that strings of documents with smaller ids cover."""
    first, out = {}, []
    for d, t in rows:
        raw = t.encode()
        for i in range(len(raw) - length + 1):
            first[raw[i : i + length]] = min(first.get(raw[i : i + length], d), d)
    for d, t in rows:
        raw, gone = t.encode(), set()
        for i in range(len(raw) - length + 1):
            if first[raw[i : i + length]] < d:
                gone.update(range(i, i + length))
        out.append((d, bytes(b for i, b in enumerate(raw) if i not in gone).decode("utf-8", "ignore")))
    return out


def test_pipeline(spark, docs, model):  # noqa: F811
    rows = [(d, t or "") for d, t in docs if brute_score(t, model) < 0.5]
    kept = {d for d, _, _, stays in brute_components(rows, 5) if stays}
    assert len(kept) < len(rows) < len(docs)
    rows = cut([r for r in rows if r[0] in kept])
    leaks = {d for d, _ in brute_leaks(rows, rows_of(spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")))}
    rows = [r for r in rows if r[0] not in leaks]
    out = corpus_pipeline.run(spark, SF).withColumn("ids_crc32", F.crc32("ids"))
    check_packing(rows, rows_of(out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")), queries.vocabulary("byte_bpe_50k.json"))


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_on_odd_tables(spark, odd, empty, stage):  # noqa: F811
    """Nulls in every column, ties, repeated rows, clashing names, no rows at all: all but the last return the columns of their input."""
    name = stage.__name__
    small = odd.filter("doc_id is null or doc_id not in (6, 7)")
    got = stage(spark, small, SF)
    assert stage(spark, empty, SF).count() == 0
    if name == "pack":
        assert {r["doc_id"] for r in got.collect()} == {r["doc_id"] for r in small.collect()}
        return
    assert got.columns == odd.columns and got.schema == spark.createDataFrame([], SCHEMA).schema
    ids = sorted((r["doc_id"] or -1 for r in got.collect()))
    if name == "drop_near_duplicates":  # 2 and 3 are copies of 1, 11 of 10; a row without an id stays
        assert ids == [-1, 1, 4, 5, 8, 9, 9, 10]
    else:
        assert ids == sorted(r["doc_id"] or -1 for r in small.collect())


def test_large_group_of_near_copies(spark):
    """900 copies of one text, many edited too far from the base to be linked with any: the same groups as by brute force."""
    rng, words, rows = random.Random(2), [f"w{i}" for i in range(150)], []
    for d in range(900):
        w = list(words)
        for _ in range(rng.randrange(16)):
            w[rng.randrange(150)] = rng.choice(words)
        rows.append((d, " ".join(w)))
    want = brute_components(rows, 4)
    got = sorted(rows_of(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4)))
    assert got == want and 50 < len({x[2] for x in want}) < 850


def test_licences_of_odd_ids(spark):
    docs = spark.createDataFrame([(None, "Released under the MIT License.", None, None), (-1, "All rights reserved.", "s", "en"), (-19, "x", None, "en"), (1, "word " * 60, "s", "en")], "doc_id long, text string, source string, lang string")  # noqa: F811
    got = licences.scan_licences(queries.files_of(docs), F.size(F.split("text", "\\s+")) <= 40, carry=("doc_id",))
    assert {(r["doc_id"], r["licence"]) for r in got.collect()} == {(None, "MIT"), (-1, "Proprietary"), (-19, None), (1, "Proprietary")}


def edited(words, share, rng):
    out = []
    for w in words:
        if rng.random() < share:
            kind = rng.randrange(3)
            out += [[], [f"new{rng.randrange(10**6)}"], [w, f"more{rng.randrange(10**6)}"]][kind]
        else:
            out.append(w)
    return out


def recall(spark, share, n=150):
    """Of copies of 60-word items with a share of their words edited, whose full alignment reaches the limit: how many are found."""
    rng = random.Random(int(100 * share))
    items = [[f"t{i}x{k}" for k in range(60)] for i in range(n)]
    copies = [edited(x, share, rng) for x in items]
    frame = spark.createDataFrame([(i, " ".join([f"a{i}q{k}" for k in range(30)] + c + [f"b{i}q{k}" for k in range(30)])) for i, c in enumerate(copies)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    want = {i for i, (x, c) in enumerate(zip(items, copies, strict=True)) if decontaminate.align(x, c)[0] >= decontaminate.LEAST_SCORE}
    got = {r["doc_id"] for r in decontaminate.contaminated(frame, bench).collect() if r["doc_id"] == r["item_id"]}
    assert got <= want
    return len(got) / len(want)


def test_recall_on_edited_copies(spark):
    """Against alignment of everything; an item of 60 words with no five in a row left isn't found."""
    found = {s: recall(spark, s) for s in (0.05, 0.1, 0.2, 0.3)}
    assert found[0.05] == found[0.1] == 1 and found[0.2] >= 0.97 and found[0.3] >= 0.8
