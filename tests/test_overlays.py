"""Overlays over small tables: symbols of one name, nulls, empty tables, ties."""

import datetime as dt
import time
from concurrent.futures import ThreadPoolExecutor
from types import SimpleNamespace

from pyspark.sql import functions as F

from lodestone import session
from lodestone.functions import paths as ph
from lodestone.operators import impact as im
from lodestone.operators import overlays as ov

SYMBOL = "path string, name string, type string, start_line int, end_line int, parent string"
EDIT = "path string, line int, author long, day date, commit long"
DAY = dt.date(2024, 3, 10)


def _symbols(spark):
    """Two methods of one name in a file, and the same name in another file."""
    rows = [("a/m.py", "run", "method", 2, 5, "A"), ("a/m.py", "run", "method", 8, 9, "B"), ("b/n.py", "run", "function", 1, 4, None)]
    return spark.createDataFrame(rows, SYMBOL)


def _edits(spark, rows):
    return spark.createDataFrame([(p, x, a, DAY - dt.timedelta(ago) if ago is not None else None, c) for p, x, a, ago, c in rows], EDIT)


def test_symbols_of_one_name_keep_their_own_edits(spark):
    edits = _edits(spark, [("a/m.py", 2, 1, 0, 1), ("a/m.py", 5, 2, 6, 2), ("a/m.py", 3, 2, 7, 3), ("a/m.py", 3, 2, 7, 3), ("a/m.py", 9, 3, 40, 4), ("a/m.py", 6, 9, 0, 5), ("a/m.py", None, 9, 0, 6), ("a/m.py", 2, 9, None, 7), (None, 2, 9, 0, 8)])
    got = {(r.path, r.start_line): (r["last"], r.edit_days, r.authors) for r in ov.overlaid(_symbols(spark), ov.edited(_symbols(spark), edits)).collect()}
    assert got == {("a/m.py", 2): (DAY, 2, 2), ("a/m.py", 8): (DAY - dt.timedelta(40), 1, 1), ("b/n.py", 1): (None, None, None)}
    assert ov.edited(_symbols(spark), edits.limit(0)).count() == 0 and ov.edited(_symbols(spark).limit(0), edits).count() == 0


def test_edits_go_to_their_symbols_once(spark):
    rows = [("a/m.py", 2, 1, 0, 1, False), ("a/m.py", 2, 1, 0, 1, True), ("a/m.py", 3, 2, 7, 2, False), ("a/m.py", 4, 3, None, 3, None), ("a/m.py", 8, 4, None, 4, True), ("c.py", 1, 5, 0, 5, True), (None, 2, 5, 0, 6, True)]
    marks = spark.createDataFrame([r[4:] for r in rows], "commit long, executed boolean")
    edits = _edits(spark, [r[:5] for r in rows]).join(marks, "commit")
    found = ov.measured(_symbols(spark), edits)
    got = {(r.path, r.start_line): (r["last"], r.edit_days, r.authors, r.percent) for r in found.collect()}
    assert got == {("a/m.py", 2): (DAY, 1, 2, 33.33), ("a/m.py", 8): (None, 0, 0, 100.0)}
    # Edits and symbols are dealt out by path once, and nothing that they make is dealt out again.
    plan = ov.measured(_symbols(spark), _edits(spark, [r[:5] for r in rows]).withColumn("executed", F.lit(True)))._jdf.queryExecution().executedPlan().toString()
    assert [x.split("(")[1].split("#")[0] for x in plan.splitlines() if "Exchange" in x] == ["path", "path"] and "Generate" not in plan


def test_stability_needs_two_measures(spark):
    rows = [(50.0, 10, 5, 2), (None, 10, None, 2), (None, 40, 0, None)]
    got = [tuple(r) for r in ov.stable(spark.createDataFrame(rows, "percent double, branches int, edit_days int, deps int")).select("stability", "stability_level").collect()]
    assert got == [(0.53, "medium"), (None, None), (0.47, "low")]


BODY = "def f(x):\n    if x is None:\n        return 0\n    if x:  # TODO\n        pass\n    elif x is None:\n        pass\n    try:\n        pass\n    except ValueError:\n        raise KeyError"


def test_coverage_map(spark):
    files = spark.createDataFrame([("a/m.py", BODY), ("a/none.py", None), ("a/t.py", BODY.replace("f(", "g("))], "path string, text string")
    asked = spark.createDataFrame([("a/m.py", "f", "function", 1, 11, None), ("a/none.py", "h", "function", 1, 2, None), ("a/t.py", "g", "function", 1, 11, None)], SYMBOL)
    words = [("tests/test_x.py", "test_one", "f"), ("tests/test_x.py", "test_exceptions", "g"), ("tests/test_y.py", "test_two", "none")]
    tests = spark.createDataFrame(words, "path string, test string, word string")
    got = {r["name"]: r for r in ov.coverage_map(asked, files, tests).collect()}
    assert got["f"].gaps == ["line 2: None check", "line 10: handler", "line 11: error path"]
    assert (got["f"].percent, got["f"].quality, got["f"].safe, got["f"].covered_by) == (0, "poor", False, ["tests/test_x.py::test_one"])
    assert got["g"].gaps == ["line 2: None check"] and got["g"].percent == 10
    assert (got["h"].gaps, got["h"].quality, got["h"].files) == ([], "none", 1) and got["h"].advice == ["write tests/test_none.py first", "1 test files speak of it, no test does"]

    many = spark.createDataFrame([("tests/t.py", f"test_{i:02d}", "f") for i in range(30)], tests.schema)
    row = ov.coverage_map(asked.limit(1), files, many).collect()[0]
    assert len(row.covered_by) == 20 and row.covered_by[0].endswith("test_00") and (row.gaps, row.percent, row.quality) == ([], 100, "excellent")
    assert im.affected_tests(asked, many).count() == 30  # the list is cut, the operator it comes from is not
    assert {r.quality for r in ov.coverage_map(asked, files, tests.limit(0)).collect()} == {"none"}


def test_anchors(spark):
    calls = spark.createDataFrame([("a/m.py", 3 + i // 6, f"c{i:02d}") for i in range(12)] + [("a/m.py", 4, "c00")], "path string, line int, callee string")
    edits = _edits(spark, [("a/m.py", 2, 1, 3, 1), ("a/m.py", 2, 7, 3, 1), ("a/m.py", 2, 9, -1, 2), ("a/m.py", 4, 1, 89, 3), ("a/m.py", 4, 1, 90, 4), ("b/n.py", 3, 1, None, 5)])
    files = spark.createDataFrame([("a/m.py",), ("b/n.py",), ("b/tests/test_n.py",), ("c/test_m.py",)], "path string")
    got = {(r.path, r.start_line): r for r in ov.anchors(_symbols(spark), calls, edits, edits, files, str(DAY)).collect()}
    a = got[("a/m.py", 2)]
    assert a.deps == [f"c{i:02d}" for i in range(10)] and (a.author, a.days, a.verifiable) == (7, 3, False)
    assert a.churn == 2 / 13 and abs(a.score - (1 / 13 + 0.3)) < 1e-12 and (a.risk, a.guard) == ("medium", "warn")
    n = got[("b/n.py", 1)]
    assert (n.deps, n.churn, n.coverage, n.risk, n.guard, n.author, n.days) == ([], 0.0, 0.75, "low", "allow", None, None)


def test_places(spark):
    symbols = _symbols(spark).union(spark.createDataFrame([("z.py", "lost", "function", 0, 0, None)], SYMBOL))
    asked = spark.createDataFrame([("a/m.py", "run"), ("a/m.py", "run"), ("z.py", "lost"), ("q.py", "run"), ("q.py", "nowhere")], "path string, name string")
    got = {(r.path, r["name"]): (r.status, r.correct) for r in ov.located(asked, symbols).collect()}
    assert got == {("a/m.py", "run"): ("found", None), ("z.py", "lost"): ("uncertain", None), ("q.py", "run"): ("missing", "a/m.py"), ("q.py", "nowhere"): ("missing", None)}


def test_rules_on_files(spark):
    rows = [("x/HANDOFF.md",), ("phase-2.md",), ("A-GUIDE.md",), ("x/readme.md",), ("x/venv/a.py",), ("x/a.py",), ("a.py",), (None,)]
    got = [tuple(r) for r in spark.createDataFrame(rows, "p string").select(ph.is_working_note(F.col("p")), ph.is_watched(F.col("p"))).collect()]
    assert got == [(True, False)] * 3 + [(False, False), (False, False), (False, True), (False, False), (None, None)]
    assert [r[0] for r in spark.createDataFrame([("_a",), ("__a",), ("a",), ("_",)], "p string").select(ph.is_private(F.col("p"))).collect()] == [True, False, False, True]


def test_threads_ship_the_package_once(monkeypatch):
    sent = []
    context = SimpleNamespace(applicationId="app", addPyFile=lambda path: (time.sleep(0.05), sent.append(path)))
    monkeypatch.setattr(session, "_SHIPPED", set())
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(session.ship, [SimpleNamespace(sparkContext=context)] * 8))
    assert len(sent) == 1 and session._SHIPPED == {"app"}
