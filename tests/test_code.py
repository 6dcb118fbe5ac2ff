from lodestone.functions import parsing as ps
from lodestone.sources import code

PY = '''import os
from .util import a as b, c


class Base(Root, mixin.M):
    """Doc."""

    x: int = 3

    def run(self, n: int = 1) -> "Optional[X]":
        """Says."""
        y = Thing(n)
        for i in range(n):
            y.go.now(i)
        return helper(y)


async def helper(v):
    return v
'''
GO = 'package m\n\nimport "fmt"\n\ntype S struct {\n  a string // }\n}\n\nfunc (s *S) Go(x int) error {\n  if x > 0 { fmt.Println("}") }\n  return nil\n}\n'


def test_python():
    got = ps.symbols("p/mod.py", PY)
    assert [(s[0], s[1], s[2], s[3], s[5]) for s in got] == [("mod", "file", 1, 20, None), ("Base", "class", 5, 15, None), ("run", "method", 10, 15, "Base"), ("helper", "function", 18, 19, None)]
    assert got[2][4] == "(self, n: int=1) -> 'Optional[X]'"
    assert [s[0] for s in ps.symbols("x.py", "class A(:\n  def f(self):\n")] == ["x", "A", "f"]
    assert ps.imports("m.py", PY) == [("os", ["os"], 1), (".util", ["a", "c"], 2)]
    assert (None, "helper", 15) in ps.calls(PY) and ("y.go", "now", 14) in ps.calls(PY) and (None, "Thing", 12) in ps.calls(PY)
    assert ps.types("m.py", PY) == [("x", "int", "annotation", 8), ("run", '"Optional[X]"', "return", 10), ("y", "Thing", "instance", 12)]
    assert ps.bases("m.py", PY) == [("Base", "Root", 0), ("Base", "mixin.M", 1)]
    short = ps.skeleton(PY)
    assert '"""Says."""\n        ...\n' in short and "return v" in short and "for i in" not in short
    assert "for i in" in ps.skeleton(PY, frozenset(["run"]))
    assert ps.shape(PY) == ps.shape(PY.replace('"""Says."""', '"""Other."""').replace("\n\n\n", "\n\n# c\n")) != ps.shape(PY.replace("go.now", "go.later"))
    assert ps.documented(PY) == [("helper", False, False), ("run", True, True)] or set(ps.documented(PY)) == {("helper", False, False), ("run", True, True)}


def test_others():
    assert [s[:4] for s in ps.symbols("a.go", GO)] == [("a", "file", 1, 13), ("S", "struct", 5, 7), ("Go", "method", 9, 12)] and ps.symbols("a.go", GO)[2][5] == "S"
    ts = "export interface I {}\nexport abstract class C extends B implements I, J {\n}\nconst n: number = 1;\nconst m = new Map();\nimport { a as b, c } from 'x/y';\n"
    assert [s[:2] for s in ps.symbols("q.ts", ts)[1:]] == [("I", "interface"), ("C", "class"), ("n", "variable"), ("m", "variable")]
    assert ps.bases("q.ts", ts) == [("C", "B", 0), ("C", "I", 1), ("C", "J", 2)]
    assert ps.imports("q.ts", ts) == [("x/y", ["a", "c"], 6)]
    assert [t[:3] for t in ps.types("q.ts", ts)] == [("n", "number", "annotation"), ("m", "Map", "instance")]
    assert ps.sections("# A\nx\n```\n# no\n```\n## B\ny") == [("A", 1, 1, 5), ("B", 2, 6, 7)]
    diff = "diff --git a/x.py b/x.py\n@@ -1,2 +3,4 @@\n@@ -9,0 +12 @@\n@@ -20,2 +21,0 @@\ndiff --git a/n b/n\nnew file mode 1\n"
    assert ps.diff_ranges(diff) == [("x.py", "modified", 3, 6, "modified"), ("x.py", "modified", 12, 12, "added"), ("x.py", "modified", 21, 21, "deleted"), ("n", "added", None, None, None)]
    assert ps.porter_like("running") == "runn" and ps.porter_like("classes") == "class" and ps.porter_like("pass") == "pass"


def test_index(spark, tmp_path):
    for name, text in (("src/m.py", PY), ("src/a.go", GO), ("node_modules/z.js", "class Z {}"), ("big.py", "x = 1\n" * 300_000), ("README.md", "# T\n")):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(text)
    files = code.scan(spark, str(tmp_path))
    assert sorted(r.path.rpartition("/")[2] for r in files.collect()) == ["README.md", "a.go", "m.py"]
    code.write_index(files, f"file://{tmp_path}/index")
    index = code.read_index(spark, f"file://{tmp_path}/index")
    assert index["symbols"].filter("type = 'method'").count() == 2
    edges = {(r.src, r.dst) for r in code.call_edges(index["calls"], index["symbols"]).collect()}
    assert {("run", "helper"), ("run", "Thing"), ("run", "now"), ("Go", "Println")} <= edges
    assert code.skeletons(files).count() == 1
    assert code.diff(spark, "diff --git a/x b/x\n@@ -1 +1 @@\n").count() == 1
