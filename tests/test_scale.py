"""What keeps queries within bounds on larger tables: no broadcast of what grows, tasks by rows, no pair counted up by a shuffle."""

import random

from pyspark.sql import functions as F
from repocensus.functions import lineage
from repocensus.operators import graphs


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_imports_are_no_broadcast(spark, tmp_path):
    spark.createDataFrame([("r", "src/a.ts", "import x from './b'"), ("r", "src/b.ts", "")], "repo string, path string, content string").write.parquet(f"{tmp_path}/f")
    files = spark.read.parquet(f"{tmp_path}/f")
    got = graphs.resolve_imports(graphs.import_edges(files), files)
    assert "BroadcastHashJoin" not in plan(got)
    assert [r["dst"] for r in got.collect()] == ["src/b.ts"]


def test_written_tables_are_no_broadcast(spark):
    a = lineage.cut(spark.range(10).withColumn("x", F.lit(1)))
    assert "BroadcastHashJoin" not in plan(a.join(lineage.cut(spark.range(5)), "id"))


def test_short_rows_are_dealt_by_their_number(spark):
    got = lineage.spread(spark.range(1000).coalesce(1), "id", 50)
    assert got.rdd.getNumPartitions() == 20
    assert got.count() == 1000


def test_screens_are_no_broadcast(spark, tmp_path):
    from repocensus.sources import readers

    spark.createDataFrame([("r", "src/pages/a.tsx"), ("r", "src/b.ts")], "repo string, path string").write.parquet(f"{tmp_path}/f")
    files = spark.read.parquet(f"{tmp_path}/f")
    got = readers.is_screen(files, files.filter("path = 'src/b.ts'"))
    assert "BroadcastHashJoin" not in plan(got)
    assert sorted((r["path"], r["found_by"]) for r in got.collect()) == [("src/b.ts", "route"), ("src/pages/a.tsx", "router")]


def test_scans_keep_no_state_but_the_debt(spark, tmp_path):
    from repocensus.streaming import streams

    spark.createDataFrame([("r", 1, "d", "p")], "repo string, scan long, dimension string, path string").write.parquet(f"{tmp_path}/in")
    stream = streams.ratchet_stream(spark.readStream.schema("repo string, scan long, dimension string, path string").parquet(f"{tmp_path}/in"))
    shape = stream._jdf.queryExecution().analyzed().toString()
    assert "Deduplicate" not in shape and "Distinct" not in shape and "explode" not in shape


def test_similar_sets_equal_all_pairs(spark):
    from repocensus.operators import registry

    rng = random.Random(3)
    sets = {(lib, f"c{i}"): set(rng.sample([None, *"abcdefghijk"], rng.randint(1, 8))) for lib in range(3) for i in range(25)}
    df = spark.createDataFrame([(*k, e) for k, es in sets.items() for e in es], "library int, component string, prop string")
    for least in (0.3, 0.6, 1.0):
        want = set()
        for (la, a), x in sets.items():
            for (lb, b), y in sets.items():
                shared = len((x & y) - {None})
                if la == lb and a < b and shared and shared / (len(x) + len(y) - shared) >= least:
                    want.add((la, a, b, shared))
        got = registry.similar_sets(registry.element_sets(df, "component", "prop", ("library",)), least, ("library",))
        assert sorted((r["library"], r["x"]["k"], r["y"]["k"], r["shared"]) for r in got.collect()) == sorted(want)


def test_clauses_of_the_same_words_are_asked_once(spark):
    from repocensus.operators import conventions

    clauses = spark.createDataFrame([(i, "Large button, small" if i % 2 else "small LARGE button") for i in range(6)], "clause int, text string")
    components = spark.createDataFrame([("B", "a large button"), ("A", "button large round")], "component string, description string")
    got = conventions.component_suggestions(clauses, components)
    assert "first(words" in got._jdf.queryExecution().analyzed().toString()
    assert sorted(map(tuple, got.collect())) == [(i, "A", 2) for i in range(6)]


def test_blanked_keeps_the_code_alone():
    from repocensus.sources import markup

    text = "a('b') // c\nx = `t ${y('z')} u`\nq = /a[/]b/; p / 2 /* e\nf */ g"
    assert markup.blanked(text) == "a(' ')     \nx = `  ${y(' ')}  `\nq = /     /; p / 2     \n     g"


def test_lists_that_are_parameters_are_broadcast(spark):
    from repocensus.jobs import relations, written

    for df in (relations.registry_checks(spark, "/root/testdata/sf0.001"), written.registry_truth(spark, "/root/testdata/sf0.001")):
        shape = plan(df)
        assert "SortMergeJoin" not in shape and "BroadcastHashJoin" in shape


def test_colours_are_read_once_for_all_roles(spark, tmp_path):
    from repocensus.operators import styles

    spark.createDataFrame([("i", "#000000", 0.5, "#ffffff"), ("i", "#ff0000", 0.2, "#ffffff")], "image string, rgb string, share double, ground string").write.parquet(f"{tmp_path}/c")
    got = styles.name_tokens(spark.read.parquet(f"{tmp_path}/c"))
    assert f"{tmp_path}/c" not in str(got.inputFiles())
    assert sorted((r["role"], r["rgb"]) for r in got.collect()) == [("accent", "#ff0000"), ("background", "#ffffff"), ("text", "#000000")]


def test_shingles_are_shuffled_once(spark, monkeypatch):
    from repocensus.operators import duplicates

    plans = []

    def cut(df, *more, whole=duplicates.cut, **named):
        plans.append(plan(df))
        return whole(df, *more, **named)

    monkeypatch.setattr(duplicates, "cut", cut)
    body, shared = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    files = [("r", "b", body), ("r", "a", body), ("r", "c", f"{body} z"), ("q", "a", body), ("r", "d", shared), ("r", "d", shared), ("r", "e", shared.replace("b0 ", ""))]
    got = duplicates.near_duplicates(spark.createDataFrame(files, "repo string, path string, content string"))
    assert sorted((r["repo"], r["a"], r["b"], r["shared"], r["copies_a"], r["copies_b"]) for r in got.collect()) == [("r", "a", "c", 56, 2, 1), ("r", "d", "e", 55, 2, 1)]
    assert sum(p.count("Generate explode(s#") for p in plans) == 1


def test_pairs_of_queries_and_documents_are_not_shuffled(spark, monkeypatch):
    from repocensus.jobs import relations
    from repocensus.operators import retrieval

    monkeypatch.setattr(retrieval, "PAIRS_A_TASK", 1000)
    shape = plan(relations.rank_documents(spark, "/root/testdata/sf0.001"))
    pairs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count() * spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").count()
    dealt = [line for line in shape.splitlines() if "Exchange hashpartitioning(doc#" in line]
    assert len(dealt) == 1 and f", {-(-pairs // 1000)})" in dealt[0]
    assert not any("hashpartitioning(query#" in line and "doc#" in line.split("),")[0] for line in shape.splitlines())


def test_words_of_wanted_documents_alone(spark):
    from repocensus.operators import retrieval

    d = spark.createDataFrame([("a", "one two"), ("b", "one")], "doc string, text string")
    q = spark.createDataFrame([(1, "two one"), (2, "three")], "query int, text string")
    got = retrieval.ranks_of(q, d, spark.createDataFrame([(1, "b"), (2, "a")], "query int, doc string"))
    assert "array_intersect(array_except(" in got._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in got.collect()] == [(1, "b", 2)]


def test_sets_meet_in_cells(spark, monkeypatch):
    from repocensus.operators import duplicates

    monkeypatch.setattr(duplicates, "BLOCK", 4)
    monkeypatch.setattr(duplicates, "SETS_A_TASK", 10)
    rng = random.Random(8)
    sets = {i: sorted(rng.sample(range(-60, 60), rng.randint(1, 40))) for i in range(30)}
    pairs = [(a, b, len(sets[a]), len(sets[b])) for a in sets for b in sets if a < b and (a < 20) == (b < 20) and rng.random() < 0.9] + [(3, 25, len(sets[3]), len(sets[25]))]
    got = duplicates.shared_counts(spark.createDataFrame(pairs, "a long, b long, n int, m int"), spark.createDataFrame(list(sets.items()), "id long, s array<long>"))
    assert sorted(map(tuple, got.collect())) == sorted((a, b, n, m, len(set(sets[a]) & set(sets[b]))) for a, b, n, m in pairs)
    none = spark.createDataFrame([], "a long, b long, n int, m int")
    assert duplicates.shared_counts(none, spark.createDataFrame(list(sets.items()), "id long, s array<long>")).collect() == []


def test_scans_of_a_repo_are_held_by_no_task(spark, monkeypatch):
    from repocensus.jobs import streamed
    from repocensus.streaming import streams

    def refuse(*_, **__):
        raise AssertionError("all debt of a shard in one task")

    monkeypatch.setattr(streams, "ratchet_stream", refuse)
    got = streamed.ratchet_scans(spark, "/root/testdata/sf0.001")
    assert got.count() > 0
    assert "Python" not in plan(got) and "Pandas" not in plan(got)
