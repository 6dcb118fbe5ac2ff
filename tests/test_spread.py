"""Queries that make much of a small table: the work is dealt out, and no join gathers on the driver what Spark takes for a few bytes."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import parsing
from lodestone.operators import mining, relational
from lodestone.plans import project
from lodestone.sources import code

DATA = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@here
def test_files_are_dealt_out(spark):
    files = project.python_files(spark, DATA)
    assert files.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    assert code.symbols(files).rdd.getNumPartitions() == files.rdd.getNumPartitions()


@here
@pytest.mark.parametrize("name", ["call_owners", "touched_symbols", "variable_types", "symbol_dependencies", "impact_report", "anchor_metadata", "base_resolution"])
def test_no_facts_are_broadcast(spark, name):
    import __spark_entry__ as entry

    plan = entry.queries()[name](spark, DATA)._jdf.queryExecution().sparkPlan().toString()
    assert "Join" in plan and "BroadcastHashJoin" not in plan
    # Facts that several steps read are parsed before, not by each of them.
    assert plan.count("MapInArrow") <= 1


def test_definitions_in_nested_statements():
    text = "if a:\n    class A(B):\n        def f(self): pass\nelse:\n    try:\n        pass\n    except E:\n        class C(D.E): pass\nmatch x:\n    case 1:\n        def g():\n            '''doc'''\n"
    assert sorted(parsing.bases("a.py", text)) == [("A", "B", 0), ("C", "D.E", 0)]
    assert sorted(parsing.documented(text)) == [("f", False, False), ("g", True, False)]


def test_contradictions_of_all_texts(spark):
    rng = random.Random(7)
    texts = [(i * 37 - 900, i % 5, " ".join(rng.choice(["the", "not", "tree", "leaf", "do", "root", "nine"]) for _ in range(rng.randrange(1, 4)))) for i in range(150)] + [(9001, 0, None), (9002, 0, "")]
    df = spark.createDataFrame(texts, "id long, g int, text string").repartition(3)
    for within in (None, "g"):
        got = sorted((r.a, r.b) for r in relational.contradictions(df, "id", "text", F.split("text", " "), ["the", "do"], ["not", "nin"], within).collect())
        has = lambda t, marks: any(m in t for m in marks)
        good = [(i, g, set(t.split(" ")), has(t, ["the", "do"]), has(t, ["not", "nin"])) for i, g, t in texts if t]
        assert got == sorted((i, j) for i, g, s, p, n in good for j, h, u, q, m in good if i < j and s & u and (p and m or n and q) and (within is None or g == h))
    # Pairs of two conversations count in the query too.
    import __spark_entry__ as entry

    if os.path.isdir(DATA):
        pairs = entry.queries()["pairwise_contradiction"](spark, DATA)
        assert pairs.filter("a div 100 != b div 100").count() > 0


def test_contradictions_of_several_groups(spark):
    rng = random.Random(8)
    # Some ids repeat with other texts, one word is in nearly all of them, and some words are in two texts only.
    texts = [(i % 370, " ".join(rng.choice(["tree", "not", "the", "leaf", f"w{rng.randrange(300)}"]) for _ in range(5))) for i in range(400)]
    df = spark.createDataFrame(texts, "id long, text string").repartition(3)
    rows = [(i, set(t.split(" ")), "the" in t, "not" in t) for i, t in texts]
    want = sorted({(i, j) for i, s, p, n in rows for j, u, q, m in rows if i < j and s & u and (p and m or n and q)})
    for at_once in (50, 4096):
        found = relational.contradictions(df, "id", "text", F.split("text", " "), ["the"], ["not"], at_once=at_once)
        assert sorted((r.a, r.b) for r in found.collect()) == want
    # Texts meet by groups, not by words: nothing is joined, and pairs are no rows of a shuffle.
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_grams_are_made_where_texts_are_dealt_to(spark, tmp_path):
    spark.createDataFrame([(1, i, f"text {i % 3} of this") for i in range(9)], "conv long, turn long, text string").coalesce(1).write.parquet(f"{tmp_path}/turns")
    df = spark.read.parquet(f"{tmp_path}/turns")
    grams = mining.char_grams(F.col("text"))
    assert mining.tfidf_over(df, "turn", grams, "conv", 0.99).count() == 9
    tf = mining.counted(df, "turn", grams, "conv")
    plan = tf._jdf.queryExecution().optimizedPlan().toString()
    assert "transform" not in plan[plan.index("RepartitionByExpression") :]
    assert tf.filter("t = 'text' and n = 1 and docs = 9").count() == 9


def test_grams_tell_characters_apart_once(spark):
    texts = ["", "a", "Ab", "aBc", "äöü€", "x𝒳yz𝒳", "two\nlines", None]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", mining.char_grams(F.col("t")).alias("g")).collect():
        t = (r.t or "").lower()
        assert r.g == [t[i : i + n] for n in (3, 4, 5) for i in range(len(t) - n + 1)]
    # A text of 20,000 characters took a lower-casing of all of it for every one of its grams.
    long = spark.createDataFrame([("ab" * 10_000,)] * 8, "t string").select(F.size(mining.char_grams(F.col("t"))).alias("n"))
    assert {r.n for r in long.collect()} == {3 * 20_000 - 2 - 3 - 4}


def test_a_text_is_parsed_once_for_all_its_facts(monkeypatch):
    seen, parse = [], parsing.ast.parse
    monkeypatch.setattr(parsing.ast, "parse", lambda text: seen.append(text) or parse(text))
    text = "class A(B, m.C):\n    def f(self, a: int, b: list[int] = (), *c, d=None) -> 'A':\n        '''doc'''\n    def g(self, n: int=2, e=None) -> int: pass\nasync def h(x: T, /, y=True): pass\n"
    for _ in range(2):
        assert [s[4] for s in parsing.symbols("a.py", text)] == [None, None, "(self, a: int, b: list[int]=(), *c, d=None) -> 'A'", "(self, n: int=2, e=None) -> int", "(x: T, /, y=True)"]
        assert parsing.bases("a.py", text) == [("A", "B", 0), ("A", "m.C", 1)]
        assert [d for _, d, _ in parsing.documented(text)] == [False, True, False] and parsing.valid("a.py", text)
    assert seen == [text]
    # A shape takes docstrings out of its own tree.
    assert parsing.shape(text) and "'''doc'''" in parsing.skeleton(text) and parsing.documented(text)[1][1]


def test_statements_written_alike_are_not_looked_into(monkeypatch):
    text = "import a\n@d\nclass A(B):\n    'doc'\n    def f(self):\n        'doc'\n        return [x\n            for x in self]\n    def g(self): pass\nif a:\n    b = 1; c = 2\nelif d:\n    e()\nelse:\n    try:\n        f()\n    except* E:\n        class C: 'doc'\nmatch x:\n    case 1:\n        y = 'é'\n"
    others = [text.replace(*r) for r in (("'doc'", "'other'"), ("        'doc'\n", ""), (": 'doc'", ": pass"), ("@d", "@e"), ("(B)", "(C)"), ("= 1; c", "= 1;  c"), ("= 2", "= 3"), ("elif d", "elif e"), ("except*", "except"), ("case 1", "case 2"), ("    e()", "    e() # e"), ("g(self)", "g(this)"), ("elif d:\n    e()\n", ""), ("'é'", "'e'"), ("\nif", "\r# c\rif"), ("import a", "import a:"), ("import a\n", ""))]
    for other in [text, "", *others]:
        a, b = parsing.shape(text), parsing.shape(other)
        assert parsing.same(text, other) == parsing.same(other, text) == (None if b is None else a == b), other
    assert [parsing.same(text, x) for x in others].count(True) == 6
    seen, dump = [], parsing.ast.dump
    monkeypatch.setattr(parsing.ast, "dump", lambda node: seen.append(node) or dump(node))
    assert parsing.same(text, text.replace("'doc'", "'other'", 2).replace("import a", "import a  # c"))
    assert all(isinstance(n, parsing.ast.alias | parsing.ast.expr | parsing.ast.arguments) for n in seen) and len(seen) < 20


def test_facts_of_one_pass_are_those_of_each(spark):
    texts = [(f"a/m{i}.py", f"import os, b.c as d\nfrom x import y, z\nclass C{i}(B, C{i - 1}):\n    def run(self, n: int) -> int:\n        v: D = D(n)\n        return v.go(n)\n") for i in range(7)]
    texts += [("empty.py", ""), ("none.py", None), (None, "def f(): pass"), ("broken.py", "def f(:\n  a = B(1)"), ("n.md", "# T\nx()"), ("s.ts", "class W extends V {}\nconst a: T = f(1);"), ("k.txt", "x(1)")]
    files = spark.createDataFrame(texts, "path string, text string").repartition(3)
    got = code.facts(files, *code.MAKERS)
    for name, found in zip(code.MAKERS, got, strict=True):
        want = code.documented(files) if name == "documented" else getattr(code, name)(files)
        assert found.schema.simpleString() == want.schema.simpleString()
        assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect())) != []
    assert all(f.count() == 0 for f in code.facts(files.limit(0), "symbols", "calls"))


def test_a_worker_holds_the_rows_of_some_files_at_once(spark):
    files = spark.range(0, 3 * code.AT_ONCE + 7, 1, 1).select(F.concat(F.lit("m"), "id", F.lit(".py")).alias("path"), F.lit("a = f(1)\nb = g(2)").alias("text"))

    def sizes(batches):
        for b in batches:
            yield b.from_pydict({"n": [b.num_rows]})

    got = [r.n for r in code.calls(files).mapInArrow(sizes, "n long").collect()]
    assert sum(got) == 2 * (3 * code.AT_ONCE + 7) and code.calls(files).count() == sum(got)
    assert [len(p) for p, _ in code._some(iter([_batch(3 * code.AT_ONCE + 7)]))] == [code.AT_ONCE] * 3 + [7]


def _batch(n):
    import pyarrow as pa

    return pa.RecordBatch.from_pydict({"path": ["a.py"] * n, "text": ["a = f(1)"] * n})


def test_frequent_words_that_nobody_asks_for_meet_no_join(spark, monkeypatch):
    from lodestone.operators import impact

    tests = spark.createDataFrame([(f"tests/test_m{i}.py", f"test_{i}", w) for i in range(9) for w in ("def", "assert", "go", f"load{i}", f"m{i % 3}")], "path string, test string, word string")
    asked = spark.createDataFrame([("src/m1.py", "load1"), ("src/m2.py", "go"), ("src/x.py", "never")], "path string, name string")
    want = [sorted(map(tuple, f(asked, tests).collect())) for f in (impact.affected_tests, impact.candidate_files)]
    monkeypatch.setattr(impact, "OFTEN", 4)
    left = impact._spoken(tests, asked.select(F.col("name").alias("word")))
    assert {r.word for r in left.select("word").distinct().collect()} == {"go", *(f"load{i}" for i in range(9)), "m0", "m1", "m2"}
    assert [sorted(map(tuple, f(asked, tests).collect())) for f in (impact.affected_tests, impact.candidate_files)] == want
    assert len(want[0]) == 10 and len(want[1]) == 12
