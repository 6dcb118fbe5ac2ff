import os
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import parsing as ps
from lodestone.functions import paths as ph
from lodestone.operators import codeintel as ci
from lodestone.operators import impact
from tests.test_code import PY


def test_paths(spark):
    rows = [("a.b", "x/y/m.py"), (".util", "x/y/m.py"), ("..z", "x/y/m.py"), (".", "m.py")]
    got = spark.createDataFrame(rows, "m string, p string").select(ph.module_path(F.col("m"), F.col("p"))).collect()
    assert [r[0] for r in got] == ["a/b", "x/y/util", "x/z", ""]
    assert [r[0] for r in spark.createDataFrame([("a/__init__.py",), ("/a/b.py",)], "p string").select(ph.module(F.col("p"))).collect()] == ["a", "a.b"]


def test_imports(spark):
    links = spark.createDataFrame([("x/m.py", ".util", ["a", "only", "none"])], "importer string, module string, names array<string>")
    syms = spark.createDataFrame([("a", "x/util.py"), ("a", "other.py"), ("only", "far/away.py")], "name string, path string")
    assert {r["name"]: r.path for r in ci.resolve_imports(links, syms).collect()} == {"a": "x/util.py", "only": "far/away.py", "none": None}


def test_blueprint(spark):
    s = spark.createDataFrame([("m.py", *r) for r in ps.symbols("m.py", PY)], "path string, " + ps.SYMBOL)
    c = spark.createDataFrame([("m.py", *r) for r in ps.calls(PY)], "path string, receiver string, callee string, line int")
    got = {r["name"]: r for r in ci.blueprint(s, spark.createDataFrame([("m.py", PY)], "path string, text string"), c).collect()}
    assert (got["run"].branches, got["run"].deps, got["run"].level) == (2, 4, "low") and got["helper"].deps == 0


def test_context(spark):
    t = spark.createDataFrame([("A", "x" * 100)], "name string, code string")
    b = spark.createDataFrame([("A", 2, "second"), ("A", 1, "first")], "name string, position int, code string")
    i = spark.createDataFrame([], "name string, line int, code string")
    assert [tuple(r) for r in ci.context(t, b, i, 20).collect()] == [("A", "x" * 32, "first\nsecond", "")]


def test_related_takes_few_rows_of_a_key_before_the_shuffle(spark):
    import random

    rng = random.Random(4)
    told = [("test", 0.95), ("caller", 1.0), ("copy", 1.0), ("weak", 0.4)]
    rows = [[(rng.choice([1, 2, None]), rng.choice([None, *range(9)])) for _ in range(60)] for _ in told]
    parts = [(spark.createDataFrame(r, "k int, target int").repartition(3), *t) for r, t in zip(rows, told, strict=True)]
    want = set()
    for key in (1, 2, None):
        best = {}
        for r, (reason, c) in zip(rows, told, strict=True):
            for k, t in r:
                if k == key and c >= 0.5:
                    best[t] = min(best.get(t, (0, "")), (-c, reason))
        first = sorted(best.items(), key=lambda x: (x[1][0], x[0] is not None, x[0] or 0))[:5]
        want |= {(key, t, reason, -c) for t, (c, reason) in first}
    got = ci.related(parts, "k")
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want) == 15
    assert ci.related(parts, "k", 2.0).count() == 0
    plan = ci.related(parts, "k")._jdf.queryExecution().executedPlan().toString()
    # Windows over each target's rows, and distinct rows of every part before, held all rows in tasks.
    assert plan.count("Exchange hashpartitioning") == 1 and "Partial" in plan[plan.index("Exchange hashpartitioning") :]


def test_indirect_callers(spark):
    rng = random.Random(3)
    names = [f"f{i}" for i in range(12)]
    found = {(rng.choice(names), f"p{rng.randrange(4)}", rng.choice(names)) for _ in range(60)} | {("f1", f"q{i}", "run") for i in range(9)} | {("run", f"q{i}", "f2") for i in range(30)}
    asked = {(p, c) for _, p, c in found} | {("p0", n) for n in names} | {("p0", "nobody")}
    want = {}
    for path, name in asked:
        seen, todo, got = set(), [(path, name, 0)], set()
        while todo:
            p, n, depth = todo.pop(0)
            if depth < 2 and (p, n) not in seen:
                seen.add((p, n))
                more = [(q, c) for callee, q, c in found if callee == n and (q, c) not in seen]
                got |= set(more)
                todo += [(q, c, depth + 1) for q, c in more]
        if got:
            want[path, name] = len(got)
    calls = spark.createDataFrame(sorted(found), "name string, path string, caller string")
    for pairs in (1, 40, 10**6):
        rows = impact.indirect_callers(spark.createDataFrame(sorted(asked), "path string, name string"), calls, pairs).collect()
        assert {(r.path, r.name): r.n for r in rows} == want


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables here")
def test_report_counts_callers_of_callers(spark):
    import __spark_entry__ as entry

    rows = entry.queries()["impact_report"](spark, "/root/testdata/sf0.001").filter("name = 'make2'").collect()
    # A method and a function call make2; all functions call a method by that name.
    assert [(r.callers, r.risk) for r in rows] == [(2, "critical")] and "indirect callers" in rows[0].breaking
