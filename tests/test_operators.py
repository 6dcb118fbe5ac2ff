import datetime as dt
import json

import numpy as np
from pyspark.sql import functions as F

from lodestone.functions import memories as mm
from lodestone.functions import scores as sc
from lodestone.functions import text as tx
from lodestone.functions import turns as tn
from lodestone.operators import graph, mining, relational, search, windows
from lodestone.sources import transcripts
from lodestone.streaming import changes


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_text(spark):
    got = values(spark, [("Optional[List[int]]",), ("a.b.C",), ("Dict[str, int]",), ("str | None",)], "t string", tx.base_type(F.col("t")))
    assert [g[0] for g in got] == ["List", "C", "Dict", "str"]
    code = "def f():\n    # c\n\n    if a and b:\n        return 1\n"
    assert values(spark, [(code,)], "t string", tx.branches(F.col("t")), tx.code_lines(F.col("t")), tx.nesting(F.col("t")), tx.skeleton_lines(F.col("t"))) == [(2, 3, 2, "def f():\n    # c")]
    assert values(spark, [("tests",), ("running",), ("added",), ("is",)], "t string", tx.stem(F.col("t"))) == [("test",), ("runn",), ("add",), ("is",)]


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "apple banana apple"), (2, "banana"), (3, None), (4, "cherry")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in search.bm25_scores(docs, "apple").collect()}
    idf = np.log((4 - 1 + 0.5) / (1 + 0.5) + 1)
    assert abs(got[1] - idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / 1.25))) < 1e-12 and list(got) == [1]


def test_turns(spark):
    say = ["never use tabs", "what should i do?", "i don't know", "I prefer dark mode", "please be brief", "I like it?"]
    got = values(spark, [(s,) for s in say], "t string", tn.is_command(F.col("t")), tn.is_false_positive(F.col("t")), tn.is_preference(F.col("t")))
    assert got == [(True, False, False), (False, True, False), (False, True, False), (False, False, True), (True, False, False), (False, True, False)]


def test_memories(spark):
    say = ["don't write long comments", "be concise", "tabs is bad", "I want tests", "Use pytest", "never panic in go func"]
    got = values(spark, [(s,) for s in say], "t string", mm.imperative(F.col("t")), mm.scope(F.col("t"), "p"), mm.category(F.col("t"), F.lit("behavior")))
    assert [g[0] for g in got] == ["Avoid write long comments", "Keep output concise", "Avoid tabs", "Tests", "Use pytest", "Never panic in go func"]
    assert got[4][1] == "language:python" and got[5][1] == "language:go" and got[0][2] == "correction"
    prompts = {"quick hack to try": "prototype", "urgent fix, production is down": "hotfix", "refactor and simplify this": "refactor", "explain how does this work": "audit", "deploy the release": "production", "where is the list": "exploration"}
    assert dict(values(spark, [(p,) for p in prompts], "t string", "t", mm.mode(F.col("t")))) == prompts
    commits = ["Merge branch x", "decided to use parquet everywhere", "fix: handle null ids in joins", "v1.2"]
    got = values(spark, [(c,) for c in commits], "t string", mm.is_noise(F.col("t")), mm.commit_pattern(F.col("t"))["type"])
    assert got == [(True, None), (False, "decision"), (False, "correction"), (True, None)]


def test_scores(spark):
    got = values(spark, [(90.0, 0.1, 1.0, 1.0), (None, None, 5.0, None), (50.0, None, 5.0, None)], "a double, b double, c double, d double", sc.stability(*map(F.col, "abcd")))
    assert got == [(0.9,), (None,), (0.52,)]
    assert values(spark, [(0, 0, 0.0), (3, 1, 0.5), (10, 0, 0.9), (20, 0, 0.1)], "a int, b int, c double", sc.impact_risk(*map(F.col, "abc"))) == [("low",), ("medium",), ("medium",), ("critical",)]
    assert values(spark, [(-1.0,), (-30.0,), (None,)], "r double", sc.rank_relevance(F.col("r"))) == [(0.1,), (1.0,), (0.5,)]


def test_cycles_and_linearisation(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "d"), ("d", "e"), ("e", "c"), ("f", "g")], "src string, dst string")
    assert sorted(tuple(r.path) for r in graph.cycles(e, 5).collect()) == [("a", "b"), ("c", "d", "e")]
    b = spark.createDataFrame([("D", "B", 0, 1.0), ("D", "C", 1, 0.9), ("B", "A", 0, 0.8), ("C", "A", 0, 1.0), ("A", "D", 0, 1.0)], "cls string, base string, ord int, confidence double")
    got = [(r.base, r.position, r.confidence) for r in graph.linearised(b).filter("cls = 'D'").orderBy("position").collect()]
    assert got == [("B", 1, 1.0), ("A", 2, 0.8), ("C", 3, 0.9)]


def test_budgets(spark):
    df = spark.createDataFrame([(1, 5), (2, 4), (3, 1), (4, 0)], "id int, c int")
    assert [r.id for r in windows.budget_prefix(df, [], F.col("c"), 8, F.col("id")).collect()] == [1]
    assert [(r.id, r.kept) for r in windows.greedy_cut(df, F.col("c"), 8, F.col("id")).collect()] == [(1, 5), (2, 3), (4, 0)]


def test_similar_pairs_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [f"t{x}" for x in rng.integers(0, 25, rng.integers(1, 8))]) for i in range(80)]
    got = {(r.a, r.b): r.similarity for r in relational.similar_pairs(spark.createDataFrame(rows, "id long, t array<string>"), "id", F.col("t"), 0.3).collect()}
    want = {(i, j): len(set(a) & set(b)) / len(set(a) | set(b)) for i, a in rows for j, b in rows if i < j}
    want = {k: v for k, v in want.items() if v > 0.3}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_mining(spark):
    rows = [(1, 1, "keep output short", "style", 0.8), (1, 2, "keep output short please", "style", 0.8), (1, 3, "never panic", "rule", 1.0), (1, 4, "keep the output short", "style", 0.9), (2, 1, "alone", "rule", 0.5)]
    df = spark.createDataFrame(rows, "conv long, id long, text string, kind string, conf double")
    pairs = mining.tfidf_pairs(df, "id", mining.char_grams(F.col("text")), "conv")
    assert all(0 < r.cosine <= 1 + 1e-9 for r in pairs.collect())
    c = mining.greedy_clusters(df.select("conv", "id"), pairs, "id", "conv")
    assert {(r.conv, r.id): r.cluster for r in c.collect()} == {(1, 1): 1, (1, 2): 1, (1, 4): 1, (1, 3): 3, (2, 1): 1}
    p = mining.proposals(df, c, "id", "conv", "text", "kind", "conf").filter("conv = 1").orderBy("cluster").collect()
    assert [(r.content, r.frequency, r.category) for r in p] == [("Keep output short", 3, "preference"), ("Never panic", 1, "correction")]
    d = np.array([[0, 0.1, 0.9, 0.8], [0.1, 0, 0.9, 0.9], [0.9, 0.9, 0, 0.2], [0.8, 0.9, 0.2, 0]])
    assert mining.average_linkage(d, 2).tolist() == [0, 0, 1, 1]
    day = dt.datetime(2024, 1, 1)
    m = spark.createDataFrame([(1, day), (2, day + dt.timedelta(9)), (3, day), (4, day)], "id long, created timestamp")
    left = mining.resolve(m, spark.createDataFrame([(1, 2), (3, 4)], "a long, b long"))
    assert sorted(r.id for r in left.collect()) == [2, 4]
    v = spark.createDataFrame([("a\nb", "a  \n b"), ("x = 1\ny = 2\n", "try:\n    z = open('f')\nexcept OSError:\n    z = None\n")], "o string, n string")
    got = mining.divergences(v, "o", "n").collect()
    assert [(r["size"], r.structural) for r in got] == [("major", True)]


def test_transcripts(spark, tmp_path):
    lines = [{"message": {"role": "user", "content": [{"type": "text", "text": "hi"}]}}, {"message": {"role": "assistant", "content": [{"type": "text", "text": "a"}, {"type": "tool_use", "name": "Edit"}, {"type": "text", "text": "b"}]}}, {"message": {"role": "system", "content": []}}]
    (tmp_path / "t.jsonl").write_text("\n".join(map(json.dumps, lines)))
    got = transcripts.transcript(spark, str(tmp_path / "t.jsonl")).orderBy("n").collect()
    assert [(r.role, r.text, r.tools) for r in got] == [("user", "hi", []), ("assistant", "a\nb", ["Edit"])]
    (tmp_path / "m.json").write_text('{"id":"1","content":"x"}\n{"id":"2","content":"y","scope":"project:p"}')
    m = transcripts.read_memories(spark, str(tmp_path / "m.json"))
    assert [(r.category, r.scope, r.confidence) for r in m.orderBy("id").collect()] == [("preference", "universal", 0.9), ("preference", "project:p", 0.9)]
    assert transcripts.import_memories(m.limit(1), m).count() == 2
    (tmp_path / "c.json").write_text('{"files": {"a.py": {"executed_lines": [1, 2], "missing_lines": [3]}}}')
    assert transcripts.coverage(spark, str(tmp_path / "c.json")).filter("executed").count() == 2


def test_streams(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [("a", t), ("a", t + dt.timedelta(seconds=2)), ("a", t + dt.timedelta(seconds=9)), ("b", t)]
    spark.createDataFrame(rows, "path string, ts timestamp").write.parquet(f"{tmp_path}/in")
    feed = spark.readStream.schema("path string, ts timestamp").parquet(f"{tmp_path}/in")
    q = changes.debounced(feed).writeStream.format("memory").queryName("bursts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.path, r.changes) for r in spark.table("bursts").collect()) == [("a", 1), ("a", 2), ("b", 1)]
    merge = changes.merge_batches(f"{tmp_path}/out", "path", "ts")
    q = feed.writeStream.foreachBatch(merge).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    merge(spark.createDataFrame([("b", t + dt.timedelta(1))], "path string, ts timestamp"), 1)
    assert {r.path: r.ts for r in spark.read.parquet(f"{tmp_path}/out/batch=1").collect()} == {"a": t + dt.timedelta(seconds=9), "b": t + dt.timedelta(1)}
