"""Joins, the index, sessions and changes on small tables, against plain Python; and some of the queries against their SQL."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import parsing
from lodestone.operators import impact, search, sessions
from lodestone.operators import intervals as iv
from lodestone.operators.index import TermIndex
from lodestone.sources import code
from lodestone.streaming import changes

DATA = "/root/testdata/sf0.001"


def test_containing(spark):
    rng = random.Random(1)
    points = [(rng.choice("ab"), i, rng.randrange(-40, 200)) for i in range(120)] + [("a", 998, None), (None, 999, 5)]
    ranges = [(rng.choice("abc"), i, a, a + rng.choice([0, 1, 7, 63, 300, -1])) for i, a in enumerate(rng.randrange(-50, 150) for _ in range(60))] + [("a", 99, None, 9), ("a", 1000, 0, 0), ("a", 1000, 0, 0)]
    p = spark.createDataFrame(points, "k string, p int, at int").repartition(3)
    r = spark.createDataFrame(ranges, "k string, r int, start int, end int").repartition(3)
    want = sorted((i, j) for k, i, at in points for l, j, a, b in ranges if k == l and None not in (at, a, b) and a <= at <= b)
    assert sorted((x.p, x.r) for x in iv.containing(p, r, "k").collect()) == want
    both = iv.overlaps(r.selectExpr("k", "r as r1", "start as s", "end as e"), r.selectExpr("k", "r as r2", "start as s2", "end as e2"), "k", ("s", "e"), ("s2", "e2"))
    good = [x for x in ranges if x[2] is not None and x[2] <= x[3]]
    pairs = sorted((i, j, min(b, d) - max(a, c) + 1) for k, i, a, b in good for l, j, c, d in good if k == l and a <= d and c <= b)
    assert sorted((x.r1, x.r2, x.shared) for x in both.collect()) == pairs
    assert iv.containing(p.limit(0), r, "k").count() == iv.containing(p, r.limit(0), "k").count() == 0


def test_as_of(spark):
    rng = random.Random(2)
    t = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(300))
    left = [(i, rng.choice("ab"), t()) for i in range(80)] + [(900, None, t()), (901, "a", None)]
    right = [(i, rng.choice("ab"), t()) for i in range(60)] + [(700, None, t()), (701, "a", None)]
    a = spark.createDataFrame(left, "id int, k string, at timestamp").repartition(3)
    b = spark.createDataFrame(right, "v int, k string, then timestamp").repartition(3)
    back = {r.id: r.got for r in iv.last_before(a, b, "k", "id", "at", "then", F.col("v") * 10, "got", "v").collect()}
    on = {r.id: (r.delay, r.v) for r in iv.first_within(a, b, "k", "id", "at", "then", 20, "v").collect()}
    assert len(back) == len(on) == len(left)
    for i, k, at in left:
        ok = [(x, v) for v, l, x in right if l == k and None not in (k, x, at)]
        assert back[i] == max(((x, v * 10) for x, v in ok if x <= at), default=(None, None))[1]
        near = min(((x - at).total_seconds(), v) for x, v in ok if 0 < (x - at).total_seconds() <= 20) if any(0 < (x - at).total_seconds() <= 20 for x, _ in ok) else (None, None)
        assert on[i] == near


def test_index(spark, tmp_path):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(["Tree", "leaf", "root", "x_1", "été"]) for _ in range(rng.randrange(1, 30)))) for i in range(60)] + [(60, ""), (61, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/docs")
    ix = TermIndex.of(spark.read.parquet(f"{tmp_path}/docs"), f"{tmp_path}/docs")
    for q in ("tree leaf", "x_1 x_1 root", "nothing"):
        want = {r.doc_id: round(r.score, 9) for r in search.bm25_scores(df, q).collect()}
        assert {r.doc_id: round(r.score, 9) for r in ix.bm25(q).collect()} == want
    assert {r.doc_id for r in ix.bm25("tree leaf", all_of=("tree", "leaf")).collect()} == {i for i, t in docs if t and "Tree" in t and "leaf" in t}
    want = {r.doc_id: r.score for r in search.token_overlap(df, "tree root", 0.3).collect()}
    assert {r.doc_id: r.score for r in ix.overlap("tree root", 0.3).collect()} == want
    again = TermIndex.of(spark.read.parquet(f"{tmp_path}/docs"), f"{tmp_path}/docs")
    assert again.rows.inputFiles() == ix.rows.inputFiles()


def test_merged_stream(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    frame = lambda rows: spark.createDataFrame([(k, t + dt.timedelta(days=n)) for k, n in rows], "k string, ts timestamp")
    m = changes.merge_batches(f"{tmp_path}/m", "k", "ts", buckets=4)
    with pytest.raises(ValueError):
        m(frame([("a", 1)]), 3)
    assert m.read(spark) is None
    m(frame([("a", 1), ("b", 1), ("c", 1)]), 0)
    m(frame([("a", 2), ("d", 0), ("a", 0)]), 1)
    m(frame([("a", 9)]), 1)  # the same batch again
    assert {r.k: r.ts.day for r in m.read(spark).collect()} == {"a": 3, "b": 2, "c": 2, "d": 1}
    m(frame([]), 2)
    assert m.manifest(spark)["batch"] == 2 and m.read(spark).count() == 4


def test_codes_and_tasks(spark):
    rows = [(1, 1, "impl:parser of files"), (1, 2, "IMPL:parser of files"), (1, 3, "impl:parser of filez"), (1, 4, "done:parser of files"), (1, 5, "next:short"), (1, 6, "why:does it fail?"), (None, 7, "impl:something else"), (2, 1, "impl:parser of files")]
    got = sessions.distinct_codes(spark.createDataFrame(rows, "s int, at int, code string"), "s", "at", "code").collect()
    assert sorted((r.s, r.n, r.code) for r in got) == [(1, 1, "impl:parser of files"), (1, 2, "done:parser of files"), (2, 1, "impl:parser of files")]
    items = spark.createDataFrame([(1, "next", "next:register-again-service"), (1, "done", "done:registered-service"), (1, "next", "next:write docs"), (2, "next", "next:register-again-service"), (2, "next", "next:")], "s int, kind string, text string")
    assert sorted((r.s, r.text) for r in sessions.open_items(items, "s").filter("kind = 'next'").collect()) == [(1, "next:write docs"), (2, "next:"), (2, "next:register-again-service")]


def test_changes(spark):
    files = lambda rows: spark.createDataFrame(rows, "path string, hash int")
    got = impact.change_set(files([("a", 1), ("b", 1), ("c", 1)]), files([("a", 1), ("b", 2), ("d", 1), ("e", 1)]), spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "path string"))
    assert {r.path: r.status for r in got.collect()} == {"b": "modified", "c": "deleted", "d": "added", "e": "untracked"}
    assert parsing.blame("abcdef1 1 4 1\nauthor A B\nauthor-time 7\n\tx\nabcdef1 2 5\n\ty") == [(4, "abcdef1", "A B", "7"), (5, "abcdef1", "A B", "7")]
    assert parsing.name_status("M\ta\nR100\tb\tc\n\nX\ty") == [("M", "a", None), ("R", "c", "b")]
    assert parsing.script_skeleton("function f() {\n  a();\n  b();\n  c();\n}\nclass C {\n  m(x) {\n    a();\n  }\n}") == "function f() {\n  ...\n}\nclass C {\n  m(x) {\n    a();\n  }\n}"
    assert parsing.summary("\n\n// Reads files.\nx") == "Reads files." and parsing.summary("x = 1\ny") == "Code file with 2 lines"
    many = spark.createDataFrame([("a.py", f"f{i}", "function", i, i, None, None) for i in range(12)], "path string, name string, type string, start_line int, end_line int, signature string, parent string")
    kept, over = code.limited(many, 10)
    assert kept.count() == 10 and [(r.total, r.dropped, r.warning) for r in over.collect()] == [(12, 2, "truncated")]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", ["parse_python", "name_types", "method_resolution", "payload", "silent_changes", "impact_report", "branch_report", "memory_injection"])
def test_queries(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry
    from lodestone.session import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    want = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, DATA).select(*want.columns).collect()
    plain = lambda rows: sorted(repr(tuple(f"{x:.9g}" if isinstance(x, float) else x for x in r)) for r in rows)
    assert plain(got) == plain(want.fetchall())
