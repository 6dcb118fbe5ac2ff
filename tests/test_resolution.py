"""Names to definitions, against plain Python on random facts; and that the steps hold, order and write no more than they need."""

import os
import random

import pytest

from lodestone.functions import parsing
from lodestone.operators import codeintel as ci
from lodestone.operators import graph
from lodestone.operators import resolution as rs
from lodestone.sources import code

DATA = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_imports_of_a_frequent_name_are_not_ordered(spark):
    rng = random.Random(5)
    paths = ["a/x.py", "a/y.py", "b/x.py", "b/c/z.py"]
    symbols = {(rng.choice("uvw"), rng.choice(paths)) for _ in range(6)} | {("one", "b/x.py"), ("run", "a/x.py"), ("run", "b/c/z.py")}
    links = [(f"i{i}.py", rng.choice(["a.x", "x", "b.c.z", "c.z", "no.where"]), rng.sample(["u", "v", "w", "one", "run", "os"], 3)) for i in range(40)]
    want = set()
    for importer, module, names in links:
        for n in names:
            there = sorted(p for m, p in symbols if m == n)
            expected = module.replace(".", "/")
            fits = [p for p in there if p[:-3] == expected or p[:-3].endswith("/" + expected) or p[:-3].rpartition("/")[2] == expected.rpartition("/")[2]]
            want.add((importer, n, fits[0] if fits else there[0] if len(there) == 1 else None))
    asked = spark.createDataFrame(links, "importer string, module string, names array<string>").repartition(3)
    defined = spark.createDataFrame(sorted(symbols) * 2, "name string, path string")
    got = ci.resolve_imports(asked, defined)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    # A window over the names of a join held all importers of a name in one task.
    assert "Window" not in _plan(got)
    one = ci.resolve_imports(asked, defined.filter("name in ('one', 'nobody')"))
    assert {r.path for r in one.collect()} == {"b/x.py", None} and "Window" not in _plan(one)


def _facts(rng):
    paths, names = ["p/a.py", "p/b.py", "q/c.py", None], ["u", "v", "self", "mk", "os"]
    kinds = ["int", "Optional[K]", "List[K]", "m.L", "K"]
    symbols = [(rng.choice(paths[:3]), rng.choice(["K", "L", "mk", "go"]), rng.choice(["class", "method", "function"]), i, rng.choice(["(u: int, w=1) -> K", "(self, v: m.L)", "() -> Optional[L]", None]), rng.choice(["K", "L", None])) for i in range(30)]
    imports = [(rng.choice(paths), rng.choice(["os", "x.u", "y"]), rng.sample(names, 2), i) for i in range(8)]
    types = [(rng.choice(paths), rng.choice(names), rng.choice(["mk", "go"]) if how == "call" else rng.choice(kinds), how, rng.randrange(9)) for how in rng.choices(["call", "annotation", "instance", "return"], k=25)]
    calls = [(rng.choice(paths), rng.choice(["u", "u.v", "self", "os", "os.path", None]), rng.choice(["go", "mk"]), rng.randrange(9)) for _ in range(40)]
    links = [(p, n, rng.choice(paths)) for p, _, ns, _ in imports for n in ns]
    return symbols, imports, types, calls, links


def _base(a):
    a = a.removeprefix("Optional[").removesuffix("]") if a.startswith("Optional[") else a
    return a.partition("[")[0].rpartition(".")[2]


def _type_map(symbols, imports, types, links):
    """As ``type_map`` says, a strategy after the other."""
    out = {}
    first = lambda rows: {k: v for k, *_, v in sorted(rows, key=lambda r: r[1:], reverse=True)}
    args = [((p, x.split(":")[0]), at, x.split(": ")[1]) for p, _, t, at, s, _ in symbols if t != "class" and s for x in s[1 : s.index(")")].split(", ") if ": " in x]
    gives = first([(n, (p or "", at), s.split("-> ")[1]) for p, n, t, at, s, _ in symbols if t == "function" and s and "->" in s])
    for n, part in enumerate((
        {(p, x): x for p, x, to in links if to is not None},
        {k: _base(v) for k, _, v in sorted(((p, x), line, a) for p, x, a, how, line in types if how != "call" and p is not None)} | {(None, x): None for p, x, _, how, _ in types if how != "call" and p is None},
        first([((p, "self"), at, parent) for p, _, t, at, _, parent in symbols if t == "method" and parent]),
        {(p, x): x for p, _, xs, _ in imports for x in xs},
        {k: _base(v) for k, v in first(args).items()},
        {k: _base(v) for k, v in first([((p, x), line, gives[a]) for p, x, a, how, line in types if how == "call" and a in gives]).items()},
    ), 1):
        for k, v in part.items():
            out.setdefault(k, (v, n))
    return {k: v for k, v in out.items() if k[0] is not None}


def test_types_and_calls_are_dealt_out_by_path(spark):
    for seed in range(3):
        symbols, imports, types, calls, links = _facts(random.Random(seed))
        frame = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3).hint("merge")
        s = frame(symbols, "path string, name string, type string, start_line int, signature string, parent string")
        i = frame(imports, "path string, module string, names array<string>, line int")
        kinds = rs.type_map(s, i, frame(types, "path string, name string, annotation string, how string, line int"), frame(links, "importer string, name string, path string"))
        known = _type_map(symbols, imports, types, links)
        assert {(r.path, r["name"]): (r.type, r.strategy) for r in kinds.filter("path is not null").collect()} == known
        got = rs.resolve_calls(frame(calls, "path string, receiver string, callee string, line int"), s, kinds, rs.module_imports(i))
        shuffles = _plan(got).count("Exchange hashpartitioning")
        modules = {(p, x) for p, m, xs, _ in imports for x in xs if x == m.rpartition(".")[2]}
        want = set()
        for p, r, c, line in calls:
            if p is None or r is None:
                continue
            cls = known.get((p, r), (None,))[0] or known.get((p, r.split(".")[0]), (None,))[0]
            is_class = cls in {n for _, n, t, *_ in symbols if t == "class"}
            if cls is not None and (is_class or (p, r) in modules):
                want.add((p, line, r, c, cls))
        assert sorted((r.path, r.line, r.receiver, r.callee, r.cls) for r in got.collect()) == sorted(want)
    # What is told of names was shuffled a kind at a time, and calls met it three times.
    assert shuffles <= 9, shuffles


def test_only_imports_of_bases_are_resolved_for_bases(spark, monkeypatch):
    text = "import os\nfrom a.b import B, c\nfrom d import E as F, G\nclass A(B, G.h, B): pass\nclass C(E): pass\n"
    assert parsing.base_imports("m.py", text) == [("a.b", ["B"], 2), ("d", ["E"], 3)]
    assert parsing.base_imports("m.py", "from a import B") == parsing.base_imports("m.py", "class A(B:\nfrom a import B") == []
    if os.path.isdir(DATA):
        import __spark_entry__ as entry

        asked, resolve = [], ci.resolve_imports
        monkeypatch.setattr(ci, "resolve_imports", lambda links, symbols: asked.append(links.selectExpr("explode(names)").count()) or resolve(links, symbols))
        entry.queries()["inherited"](spark, DATA)
        # 200 files import five names each, of which at most one is a base.
        assert 0 < asked[0] <= 200


def test_bases_by_strategy(spark):
    classes = [("p/a.py", "K"), ("p/s/b.py", "K"), ("q/c.py", "K"), ("p/s/b.py", "L")]
    s = spark.createDataFrame([(*c, "class") for c in classes], "path string, name string, type string")
    bases = [("p/a.py", "A", "K", 0), ("p/x.py", "A", "K", 0), ("p/x.py", "B", "L", 1), ("q/y.py", "A", "L", 0), ("r/z.py", "A", "K", 0), (None, "A", "K", 0)]
    links = spark.createDataFrame([("q/y.py", "L", "p/s/b.py"), ("r/z.py", "K", None)], "importer string, name string, path string")
    got = rs.resolve_bases(spark.createDataFrame(bases * 2, "path string, cls string, base string, ord int"), s, links)
    want = [("p/a.py", "A", "K", 0, "p/a.py", 1.0), ("p/x.py", "A", "K", 0, "p/a.py", 0.95), ("p/x.py", "B", "L", 1, "p/s/b.py", 0.95), ("q/y.py", "A", "L", 0, "p/s/b.py", 0.95), ("r/z.py", "A", "K", 0, None, 0.7), (None, "A", "K", 0, None, 0.7)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    # The rows of a base's name met its classes twice, and a window after that.
    assert "Window" not in _plan(got)


@here
def test_places_parse_no_calls(spark, monkeypatch):
    import __spark_entry__ as entry

    asked, facts = [], code.facts
    monkeypatch.setattr(code, "facts", lambda files, *names: asked.append(names) or facts(files, *names))
    assert entry.queries()["symbol_places"](spark, DATA).filter("status = 'found'").count() > 0
    assert asked == [("symbols",)]


def test_callers_of_callers_are_written_only_where_they_are_read(spark, monkeypatch):
    written, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: written.append(1) or cut(df))
    rng = random.Random(6)
    edges = [(rng.choice("abcdef"), rng.choice("abcdefg")) for _ in range(14)]
    got = graph.caller_tree(spark.createDataFrame(edges, "src string, dst string"), 3)
    assert len(written) == 2  # the edges and the callers of callers; the last step was written too
    level, want = {(d, s) for s, d in edges}, set()
    for depth in (1, 2, 3):
        want |= {(r, n, depth) for r, n in level}
        level = {(r, s) for r, n in level for s, d in edges if d == n}
    assert sorted(map(tuple, got.collect())) == sorted(want)
