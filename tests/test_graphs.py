"""Strongly connected components and two-hop counts against plain Python."""

import random

from lodestone.operators import graph


def reachable(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    seen = {}
    for n in {x for e in edges for x in e}:
        todo, got = [n], set()
        while todo:
            for m in out.get(todo.pop(), ()):
                if m not in got:
                    got.add(m)
                    todo.append(m)
        seen[n] = got
    return seen


def circles(edges):
    seen = reachable([e for e in edges if e[0] != e[1]])
    return {n: min(m for m in seen[n] if n in seen[m]) for n in seen if n in seen[n]}


def test_components_of_any_length(spark):
    rng = random.Random(5)
    ring = [(i, i % 40 + 1) for i in range(1, 41)]  # forty nodes
    two = [(100, 101), (101, 100), (101, 102), (102, 103), (103, 102), (40, 100)]
    tail = [(i, i + 1) for i in range(200, 212)] + [(212, 1), (7, 7), (300, 300), (7, 400)]
    some = [(rng.randrange(500, 560), rng.randrange(500, 560)) for _ in range(75)]
    edges = ring + two + tail + some + some[:9]
    df = spark.createDataFrame(edges, "src long, dst long").repartition(3)
    got = {r.node: r.component for r in graph.components(df).collect()}
    assert got == circles(edges) and {1, 100, 102} <= set(got.values())
    named = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in two], "src string, dst string")
    assert {r.node: r.component for r in graph.components(named).collect()} == {"n100": "n100", "n101": "n100", "n102": "n102", "n103": "n102"}


def test_no_circles(spark):
    assert graph.components(spark.createDataFrame([(1, 2), (2, 3), (4, 4)], "src long, dst long")).count() == 0
    assert graph.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_two_hops(spark):
    rng = random.Random(1)
    edges = {(rng.randrange(300), rng.randrange(40)) for _ in range(900)} | {(i, 99) for i in range(0, 300, 3)}
    got = {r.a: r.n for r in graph.two_hops(spark.createDataFrame(sorted(edges), "a long, b long"), "a", "b").collect()}
    at = {}
    for a, b in edges:
        at.setdefault(b, set()).add(a)
    assert got == {a: len(set().union(*(at[b] for x, b in edges if x == a))) for a, _ in edges}


def test_two_hops_in_pieces_and_batches(spark, monkeypatch):
    """Lists of several pieces, words merged on the way, an a over several batches, nulls, repeats and negative numbers; no groups of all that meet."""
    rng = random.Random(2)
    edges = [(rng.randrange(-40_000, 40_000), rng.randrange(12)) for _ in range(2500)] + [(7, b) for b in range(12)] * 2
    df = spark.createDataFrame([*edges, (None, 1), (5, None)], "a long, b long")
    met = graph.two_hops(df, "a", "b")
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.index("MapInArrow") < plan.index("Aggregate")
    at = {}
    for a, b in edges:
        at.setdefault(b, set()).add(a)
    want = {a: len(set().union(*(at[b] for x, b in edges if x == a))) for a, _ in edges}
    assert max(len({x // 64 for x in s}) for s in at.values()) > graph.PIECE // 2
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    monkeypatch.setattr(graph, "PIECE", 50)
    try:
        assert {r.a: r.n for r in graph.two_hops(df, "a", "b").collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.a: r.n for r in met.collect()} == want


def test_words_are_merged_before_they_are_many(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(graph, "MERGED", 3)
    lists = [[0, 1], [1, 2], [0], [5], [2, 1, 0]]
    batch = lambda keys, rows: pa.RecordBatch.from_pydict({"a": pa.array(keys, pa.int64()), "words": pa.array(rows, pa.list_(pa.int64())), "bits": pa.array([[-1] * len(r) for r in rows], pa.list_(pa.int64()))})
    got = [r for b in graph._counted(iter([batch([3, 3], lists[:2]), batch([], []), batch([3, 4, 5], lists[2:])])) for r in b.to_pylist()]
    assert got == [{"a": 3, "n": 192}, {"a": 4, "n": 64}, {"a": 5, "n": 192}]


def test_paths_make_each_step_once(spark, monkeypatch):
    cuts, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: cuts.append(cut(df)) or cuts[-1])
    edges = spark.createDataFrame([(a, b) for a in range(6) for b in range(6) if a != b], "src long, dst long")
    got = sorted(tuple(r.path) for r in graph.cycles(edges, 3).collect())
    pairs = [(a, b) for a in range(6) for b in range(a + 1, 6)]
    assert got == sorted(pairs + [(a, b, c) for a in range(6) for b in range(a + 1, 6) for c in range(a + 1, 6) if b != c])
    # The last step holds circles only: paths that are still open were made there, for nobody.
    assert [c.count() for c in cuts] == [30, 15 + 40, 40]
