"""Queries over a source tree made from the tables: parsing, and what symbols, imports, calls and types come to."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import codeintel as ci
from lodestone.operators import graph
from lodestone.operators import resolution as rs
from lodestone.plans import project as pj
from lodestone.plans.base import query
from lodestone.sources import code

#: A row per part: its number k (from 1), the one before p, the file's path, whether it is broken (b), its text and lines, and the base that its class names.
PY = f"""p AS (SELECT *, string_split(txt, chr(10)) AS ln FROM (SELECT *, {pj.fill_sql(pj.PYTHON, k="k", p="p", h="p // 50", s="s", j="j", base="base", first="first", broken="CASE WHEN b THEN chr(10)||'def broken(:' ELSE '' END")} AS txt
FROM (SELECT k, k - 1 AS p, k % 7 AS j, p_size AS s, k % 11 = 0 AS b, CASE WHEN k % 4 = 0 THEN 'Base' ELSE 'C' || (k - 1) END AS base,
CASE WHEN k % 2 = 0 THEN '\"\"\"Holds ' || p_size || '.\"\"\"' ELSE 'size = ' || p_size END AS first, 'src/g' || (k // 50) || '/m' || k || '.py' AS path FROM (SELECT p_partkey::BIGINT + 1 AS k, p_size FROM part))))"""
#: Resolved imports: importer k, name, path or null.
LINKS = """i AS (SELECT p.k, p.path AS importer, n.name, q.path AS path FROM (SELECT p.*, unnest(['C' || p, 'make' || p]) AS name FROM p) n JOIN p ON n.k = p.k LEFT JOIN p q ON q.k = p.p
UNION ALL SELECT k, path, unnest(['os', 'Optional', 'List']), NULL FROM p)"""


def _facts(spark, d, *names):
    """The Python files and their facts by name, all parsed in one pass: what follows reads them several times."""
    files = pj.python_files(spark, d)
    return files, *code.facts(files, *names)


def _links(imports, symbols):
    return ci.resolve_imports(imports.withColumnRenamed("path", "importer"), symbols.filter("type != 'file'"))


@query(f"""WITH {PY}, f AS (SELECT path, 'm' || k AS name, 'file' AS type, 1 AS a, CASE WHEN b THEN 29 ELSE 28 END AS e, NULL AS sig, NULL AS parent FROM p
UNION ALL SELECT path, 'C' || k, 'class', 7, CASE WHEN b THEN 7 ELSE 20 END, NULL, NULL FROM p
UNION ALL SELECT path, 'run', CASE WHEN b THEN 'function' ELSE 'method' END, 10, CASE WHEN b THEN 10 ELSE 14 END, CASE WHEN NOT b THEN '(self, n: int) -> int' END, CASE WHEN NOT b THEN 'C' || k END FROM p
UNION ALL SELECT path, 'step' || j, CASE WHEN b THEN 'function' ELSE 'method' END, 16, CASE WHEN b THEN 16 ELSE 20 END, CASE WHEN NOT b THEN '(self, n)' END, CASE WHEN NOT b THEN 'C' || k END FROM p
UNION ALL SELECT path, 'make' || k, 'function', 23, CASE WHEN b THEN 23 ELSE 28 END, CASE WHEN NOT b THEN '(n: int, flag=False) -> C' || k END, NULL FROM p
UNION ALL SELECT path, 'broken', 'function', 29, 29, NULL, NULL FROM p WHERE b)
SELECT path, name, type, a::INTEGER AS start_line, e::INTEGER AS end_line, sig AS signature, parent FROM f""")
def parse_python(spark, d):
    """[P1-P4, S1] Symbols of Python files; those that do not parse, by lines."""
    return code.symbols(pj.python_files(spark, d))


@query("""WITH s AS (SELECT s_suppkey::BIGINT + 1 AS k FROM supplier), f AS (
SELECT 'web/s' || k || '.js' AS path, unnest([{'n': 's' || k, 't': 'file', 'a': 1, 'e': 12}, {'n': 'W' || k, 't': 'class', 'a': 4, 'e': 4}, {'n': 'load' || k, 't': 'function', 'a': 7, 'e': 7}, {'n': 'gen' || k, 't': 'function', 'a': 12, 'e': 12}]) AS x FROM s
UNION ALL SELECT 'web/t' || k || '.ts', unnest([{'n': 't' || k, 't': 'file', 'a': 1, 'e': 13}, {'n': 'I' || k, 't': 'interface', 'a': 2, 'e': 2}, {'n': 'E' || k, 't': 'enum', 'a': 5, 'e': 5}, {'n': 'D' || k, 't': 'class', 'a': 6, 'e': 6}, {'n': 'conv' || k, 't': 'function', 'a': 8, 'e': 8}, {'n': 'item', 't': 'variable', 'a': 9, 'e': 9}, {'n': 'limit' || k, 't': 'variable', 'a': 13, 'e': 13}]) FROM s)
SELECT path, x.n AS name, x.t AS type, x.a::INTEGER AS start_line, x.e::INTEGER AS end_line FROM f""")
def parse_scripts(spark, d):
    """[P5, P6] Symbols of JavaScript and TypeScript files, a line each."""
    return code.symbols(pj.script_files(spark, d)).select("path", "name", "type", "start_line", "end_line")


@query("""WITH g AS (SELECT s_suppkey::BIGINT + 1 AS k FROM supplier), r AS (SELECT n_nationkey::BIGINT + 1 AS k FROM nation), f AS (
SELECT 'svc/g' || k || '.go' AS path, unnest([{'n': 'g' || k, 't': 'file', 'a': 1, 'e': 18, 'p': NULL}, {'n': 'S' || k, 't': 'struct', 'a': 5, 'e': 7, 'p': NULL}, {'n': 'Name' || k, 't': 'method', 'a': 9, 'e': 12, 'p': 'S' || k}, {'n': 'New' || k, 't': 'function', 'a': 14, 'e': 18, 'p': NULL}]) AS x FROM g
UNION ALL SELECT 'core/r' || k || '.rs', unnest([{'n': 'r' || k, 't': 'file', 'a': 1, 'e': 9, 'p': NULL}, {'n': 'P' || k, 't': 'struct', 'a': 2, 'e': 2, 'p': NULL}, {'n': 'K' || k, 't': 'enum', 'a': 3, 'e': 3, 'p': NULL}, {'n': 'T' || k, 't': 'trait', 'a': 4, 'e': 6, 'p': NULL}, {'n': 'go', 't': 'function', 'a': 5, 'e': 5, 'p': NULL}, {'n': 'P' || k, 't': 'impl', 'a': 7, 'e': 9, 'p': NULL}, {'n': 'go', 't': 'function', 'a': 8, 'e': 8, 'p': NULL}]) FROM r)
SELECT path, x.n AS name, x.t AS type, x.a::INTEGER AS start_line, x.e::INTEGER AS end_line, x.p::VARCHAR AS parent FROM f""")
def parse_compiled(spark, d):
    """[P7-P9] Symbols of Go and Rust files, with blocks by matching braces."""
    return code.symbols(pj.compiled_files(spark, d)).select("path", "name", "type", "start_line", "end_line", "parent")


@query("""WITH n AS (SELECT n_nationkey::BIGINT + 1 AS k FROM nation), f AS (
SELECT 'docs/n' || k || '.md' AS path, unnest([{'n': 'n' || k, 't': 'file', 'a': 1, 'e': 7}, {'n': 'Title ' || k, 't': 'section', 'a': 1, 'e': 5}, {'n': 'Part ' || k, 't': 'section', 'a': 6, 'e': 7}]) AS x FROM n
UNION ALL SELECT 'conf/c' || k || '.yaml', {'n': 'c' || k, 't': 'file', 'a': 1, 'e': 2} FROM n)
SELECT path, x.n AS name, x.t AS type, x.a::INTEGER AS start_line, x.e::INTEGER AS end_line FROM f""")
def parse_notes(spark, d):
    """[P10, P11] Sections of Markdown files outside of code fences; of YAML only the file."""
    return code.symbols(pj.note_files(spark, d)).select("path", "name", "type", "start_line", "end_line")


@query(f"""WITH {PY}, s AS (SELECT s_suppkey::BIGINT + 1 AS k FROM supplier), r AS (SELECT n_nationkey::BIGINT + 1 AS k FROM nation), f AS (
SELECT path, unnest([{{'m': 'os', 'n': 'os', 'l': 2}}, {{'m': 'typing', 'n': 'Optional,List', 'l': 3}}, {{'m': 'src.g' || (p // 50) || '.m' || p, 'n': 'C' || p || ',make' || p, 'l': 4}}]) AS x FROM p
UNION ALL SELECT 'web/s' || k || '.js', unnest([{{'m': './s' || (k - 1), 'n': 'Base,helper', 'l': 1}}, {{'m': 'lib' || k, 'n': '', 'l': 2}}]) FROM s
UNION ALL SELECT 'web/t' || k || '.ts', {{'m': './a' || k, 'n': 'A' || k, 'l': 1}} FROM s
UNION ALL SELECT 'svc/g' || k || '.go', {{'m': 'fmt' || k || '/io', 'n': 'io', 'l': 3}} FROM s
UNION ALL SELECT 'core/r' || k || '.rs', {{'m': 'std::collections', 'n': 'HashMap,HashSet', 'l': 1}} FROM r)
SELECT path, x.m AS module, x.n AS names, x.l::INTEGER AS line FROM f""")
def import_facts(spark, d):
    """[P12, P14, Q53, T12] Imports of every language, names without their aliases."""
    got = code.imports(pj.all_files(spark, d))
    return got.select("path", "module", F.array_join("names", ",").alias("names"), "line")


@query(f"""WITH {PY}, s AS (SELECT s_suppkey::BIGINT + 1 AS k FROM supplier), f AS (
SELECT path, unnest([{{'r': 'self', 'c': 'step' || j, 'l': 13}}, {{'r': NULL, 'c': 'make' || p, 'l': 14}}, {{'r': NULL, 'c': 'range', 'l': 18}}, {{'r': NULL, 'c': 'C' || p, 'l': 24}}, {{'r': NULL, 'c': 'C' || k, 'l': 25}}, {{'r': 'os', 'c': 'getcwd', 'l': 26}}, {{'r': 'os.path', 'c': 'join', 'l': 26}}, {{'r': NULL, 'c': 'make' || p, 'l': 27}}, {{'r': 'other', 'c': 'run', 'l': 28}}]) AS x FROM p
UNION ALL SELECT 'web/s' || k || '.js', unnest([{{'r': NULL, 'c': 'require', 'l': 2}}, {{'r': NULL, 'c': 'go', 'l': 5}}, {{'r': NULL, 'c': 'h' || k, 'l': 5}}, {{'r': 'lib.fetch', 'c': 'all', 'l': 10}}]) FROM s
UNION ALL SELECT 'web/t' || k || '.ts', unnest([{{'r': NULL, 'c': 'D' || k, 'l': 9}}, {{'r': NULL, 'c': 'Maker' || k, 'l': 10}}, {{'r': NULL, 'c': 'String', 'l': 11}}]) FROM s
UNION ALL SELECT 'svc/g' || k || '.go', {{'r': 'v', 'c': 'init', 'l': 17}} FROM s)
SELECT path, x.r::VARCHAR AS receiver, x.c AS callee, x.l::INTEGER AS line FROM f""")
def call_facts(spark, d):
    """[P13, P15] Calls and method calls on lines that define nothing."""
    return code.calls(pj.all_files(spark, d))


@query(f"""WITH {PY}, s AS (SELECT s_suppkey::BIGINT + 1 AS k FROM supplier), f AS (
SELECT path, unnest([{{'n': 'run', 'a': 'int', 'h': 'return', 'l': 10}}, {{'n': 'make' || k, 'a': 'C' || k, 'h': 'return', 'l': 23}}, {{'n': 'item', 'a': 'C' || p, 'h': 'annotation', 'l': 24}}, {{'n': 'other', 'a': 'C' || k, 'h': 'instance', 'l': 25}}, {{'n': 'third', 'a': 'make' || p, 'h': 'call', 'l': 27}}]) AS x FROM p
UNION ALL SELECT 'web/t' || k || '.ts', unnest([{{'n': 'conv' || k, 'a': 'string', 'h': 'return', 'l': 8}}, {{'n': 'item', 'a': 'D' || k, 'h': 'annotation', 'l': 9}}, {{'n': 'made', 'a': 'Maker' || k, 'h': 'instance', 'l': 10}}, {{'n': 'limit' || k, 'a': 'number', 'h': 'annotation', 'l': 13}}]) FROM s
UNION ALL SELECT 'svc/g' || k || '.go', unnest([{{'n': 'Name' || k, 'a': 'string', 'h': 'return', 'l': 9}}, {{'n': 'New' || k, 'a': '*S' || k, 'h': 'return', 'l': 14}}, {{'n': 'v', 'a': 'S' || k, 'h': 'instance', 'l': 15}}, {{'n': 'n', 'a': 'int', 'h': 'annotation', 'l': 16}}]) FROM s)
SELECT path, x.n AS name, x.a AS annotation, x.h AS how, x.l::INTEGER AS line FROM f""")
def type_facts(spark, d):
    """[P16-P19] What Python, TypeScript and Go texts tell of types; other languages tell none."""
    return code.types(pj.all_files(spark, d))


@query(f"""WITH {PY}, s AS (SELECT s_suppkey::BIGINT + 1 AS k FROM supplier)
SELECT path, 'C' || k AS cls, base, 0 AS ord FROM p WHERE NOT b
UNION ALL SELECT 'web/s' || k || '.js', 'W' || k, 'W' || (k - 1), 0 FROM s
UNION ALL SELECT 'web/t' || k || '.ts', 'D' || k, unnest(['B' || k, 'I' || k, 'J']), unnest([0, 1, 2]) FROM s""")
def base_facts(spark, d):
    """[P20, Q56] Classes and what they extend, in order."""
    return code.bases(pj.all_files(spark, d))


@query(f"""WITH {PY} SELECT path, CASE WHEN b THEN txt ELSE array_to_string(list_concat(ln[1:11], ['        ...'], ln[15:16], ['        ...'], ln[21:23], ['    ...']), chr(10)) END AS skeleton FROM p""")
def python_skeletons(spark, d):
    """[P21, Q63] Python files with bodies of three lines or more left out; those that do not parse as they are."""
    return code.skeletons(pj.python_files(spark, d), shapes=False).select("path", "skeleton")


@query(f"""WITH {PY} SELECT path, array_to_string(list_concat([ln[7], ln[10], ln[16], ln[23]], CASE WHEN b THEN [ln[29]] ELSE []::VARCHAR[] END), chr(10)) AS skeleton FROM p""")
def line_skeletons(spark, d):
    """[P22] Signatures by lines."""
    return pj.python_files(spark, d).select("path", tx.skeleton_lines(F.col("text")).alias("skeleton"))


@query(f"""WITH s AS (SELECT s_suppkey::BIGINT + 1 AS k FROM supplier), t AS (SELECT k, string_split({pj.fill_sql(pj.SCRIPT, k="k", p="k - 1")}, chr(10)) AS ln FROM s)
SELECT 'web/s' || k || '.js' AS path, array_to_string(list_concat(ln[1:7], ['  ...'], ln[11:12]), chr(10)) AS skeleton, 'loads ' || k AS summary FROM t""")
def script_skeletons(spark, d):
    """[Q65, Q66] JavaScript files with long bodies left out, and their first comment."""
    return code.script_skeletons(pj.script_files(spark, d)).filter("path like '%.js'").select("path", "skeleton", "summary")


@query(f"""WITH {PY} SELECT path, 3::BIGINT AS functions, 1::BIGINT AS documented, 2::BIGINT AS hinted, 33.33::DOUBLE AS doc_percent, 66.67::DOUBLE AS hint_percent FROM p WHERE NOT b""")
def documentation(spark, d):
    """[C5, C6] How many functions of a file have docstrings and type hints."""
    got = code.documented(pj.python_files(spark, d))
    n = F.count(F.lit(1))
    part = lambda c: F.round(100.0 * F.count_if(c) / n, 2)
    return got.groupBy("path").agg(n.alias("functions"), F.count_if("documented").alias("documented"), F.count_if("hinted").alias("hinted"), part("documented").alias("doc_percent"), part("hinted").alias("hint_percent"))


@query(f"""WITH {PY} SELECT path, CASE WHEN NOT b THEN k % 3 <> 0 END AS same FROM p""")
def same_shape(spark, d):
    """[C12] Whether a file means the same after comments and docstrings changed; null where it does not parse."""
    files = pj.python_files(spark, d).withColumn("after", F.concat(F.replace("text", F.lit('"""Runs."""'), F.lit('"""Runs it."""')), F.lit("\n# end")))
    k = F.regexp_extract("path", "m(\\d+)\\.py$", 1).cast("long")
    files = files.withColumn("after", F.when(k % 3 == 0, F.replace("after", F.lit("total += i"), F.lit("total -= i"))).otherwise(F.col("after")))
    return code.same_shape(files, "text", "after").select("path", "same")


@query(f"""WITH {PY}, f AS (SELECT path, unnest(CASE WHEN b THEN [{{'n': 'm' || k, 'a': 1, 'b': 4, 'l': 23, 'd': 3, 'c': 8}}, {{'n': 'C' || k, 'a': 7, 'b': 1, 'l': 1, 'd': 0, 'c': 0}}, {{'n': 'run', 'a': 10, 'b': 1, 'l': 1, 'd': 0, 'c': 0}}, {{'n': 'step' || j, 'a': 16, 'b': 1, 'l': 1, 'd': 0, 'c': 0}}, {{'n': 'make' || k, 'a': 23, 'b': 1, 'l': 1, 'd': 0, 'c': 0}}, {{'n': 'broken', 'a': 29, 'b': 1, 'l': 1, 'd': 0, 'c': 0}}]
ELSE [{{'n': 'm' || k, 'a': 1, 'b': 4, 'l': 22, 'd': 3, 'c': 8}}, {{'n': 'C' || k, 'a': 7, 'b': 4, 'l': 12, 'd': 3, 'c': 3}}, {{'n': 'run', 'a': 10, 'b': 3, 'l': 5, 'd': 2, 'c': 2}}, {{'n': 'step' || j, 'a': 16, 'b': 2, 'l': 5, 'd': 2, 'c': 1}}, {{'n': 'make' || k, 'a': 23, 'b': 1, 'l': 6, 'd': 1, 'c': 6}}] END) AS x FROM p)
SELECT path, x.n AS name, x.a::INTEGER AS start_line, x.b::INTEGER AS branches, x.l::INTEGER AS lines, x.d::INTEGER AS nesting, 'low' AS level, x.c::BIGINT AS deps FROM f""")
def complexity(spark, d):
    """[B1, B3, B4, Q28, X21-X23, S31] Branches, lines, nesting and calls of every symbol, by its own lines."""
    files, symbols, calls = _facts(spark, d, "symbols", "calls")
    return ci.blueprint(symbols, files, calls).select("path", "name", "start_line", "branches", "lines", "nesting", "level", "deps")


@query(f"""WITH {PY}, {LINKS} SELECT importer, name, path FROM i""")
def import_resolution(spark, d):
    """[J16, J23, Q58, X-3] Each imported name with the file that defines it: by path, else the only one there is."""
    _, symbols, imports = _facts(spark, d, "symbols", "imports")
    return _links(imports, symbols).select("importer", "name", "path")


def _bases(spark, d):
    _, symbols, imports, bases = _facts(spark, d, "symbols", "base_imports", "bases")  # other names' imports tell nothing of bases
    return rs.resolve_bases(bases, symbols, _links(imports, symbols)), symbols


@query(f"""WITH {PY} SELECT p.path, 'C' || p.k AS cls, p.base, q.path AS target, CASE WHEN q.path IS NULL THEN 7e-1::DOUBLE ELSE 95e-2::DOUBLE END AS confidence FROM p LEFT JOIN p q ON q.k = p.p AND p.base <> 'Base' WHERE NOT p.b""")
def base_resolution(spark, d):
    """[J17, Q57] The class that each base is, and how sure that is."""
    return _bases(spark, d)[0].select("path", "cls", "base", "target", "confidence")


MRO = """e AS (SELECT p.k, CASE WHEN p.base <> 'Base' THEN p.p END AS nxt, CASE WHEN q.path IS NULL THEN 7e-1::DOUBLE ELSE 95e-2::DOUBLE END AS c FROM p LEFT JOIN p q ON q.k = p.p AND p.base <> 'Base' WHERE NOT p.b),
m AS (SELECT k, nxt AS cur, 1 AS pos, c FROM e UNION ALL SELECT m.k, e.nxt, m.pos + 1, least(m.c, e.c) FROM m JOIN e ON m.cur = e.k)"""


@query(f"""WITH RECURSIVE {PY}, {MRO} SELECT 'C' || k AS cls, coalesce('C' || cur, 'Base') AS base, pos::INTEGER AS position, pos::INTEGER AS depth, c AS confidence FROM m""")
def inherited(spark, d):
    """[G6, Q54] All that a class inherits from, in order, as sure as the least sure step."""
    return graph.linearised(_bases(spark, d)[0].select("cls", "base", "ord", "confidence"))


@query(f"""WITH RECURSIVE {PY}, {MRO} SELECT 'C' || m.k AS cls, 'run' AS method, 'C' || cur AS base, pos::INTEGER AS position, c AS confidence FROM m JOIN p ON p.k = m.cur AND NOT p.b""")
def overridden_methods(spark, d):
    """[J22] Methods that a class and one above it both have."""
    bases, symbols = _bases(spark, d)
    return rs.overridden(symbols, graph.linearised(bases.select("cls", "base", "ord", "confidence")))


KINDS = """t AS (SELECT DISTINCT ON (k, name) k, path, name, type, s FROM (
SELECT i.k, p.path, i.name, i.name AS type, 1 AS s FROM i JOIN p ON p.k = i.k WHERE i.path IS NOT NULL
UNION ALL SELECT k, path, unnest(['run', 'make' || k, 'item', 'other']), unnest(['int', 'C' || k, 'C' || p, 'C' || k]), 2 FROM p
UNION ALL SELECT k, path, 'self', 'C' || k, 3 FROM p WHERE NOT b
UNION ALL SELECT i.k, p.path, i.name, i.name, 4 FROM i JOIN p ON p.k = i.k
UNION ALL SELECT k, path, 'n', 'int', 5 FROM p WHERE NOT b
UNION ALL SELECT p.k, p.path, 'third', 'C' || q.k, 6 FROM p JOIN p q ON q.k = p.p AND NOT q.b) ORDER BY k, name, s)"""


def _kinds(spark, d):
    _, symbols, imports, calls, types = _facts(spark, d, "symbols", "imports", "calls", "types")
    links = _links(imports, symbols)
    return rs.type_map(symbols, imports, types, links), symbols, imports, calls


@query(f"""WITH {PY}, {LINKS}, {KINDS} SELECT path, name, type, s::INTEGER AS strategy FROM t""")
def name_types(spark, d):
    """[J19, Q50, X8] What each name of a file is, by the first of six strategies that tells."""
    return _kinds(spark, d)[0]


CALLS = """c AS (SELECT path, 13 AS line, 'self' AS receiver, 'step' || j AS callee, path AS target, 'C' || k AS cls, 9e-1::DOUBLE AS confidence, 'type_annotation' AS how FROM p WHERE NOT b
UNION ALL SELECT path, 26, 'os', 'getcwd', NULL, 'os', 5e-1::DOUBLE, 'module_import' FROM p
UNION ALL SELECT path, 28, 'other', 'run', path, 'C' || k, CASE WHEN b THEN 5e-1::DOUBLE ELSE 9e-1::DOUBLE END, CASE WHEN b THEN 'heuristic' ELSE 'type_annotation' END FROM p)"""


def _calls(spark, d):
    kinds, symbols, imports, calls = _kinds(spark, d)
    return rs.resolve_calls(calls, symbols, kinds, rs.module_imports(imports)), calls


@query(f"WITH {PY}, {CALLS} SELECT path, line::INTEGER AS line, receiver, callee, target, cls, confidence, how FROM c")
def method_resolution(spark, d):
    """[J18] The method that each call on a receiver is, with how sure that is."""
    return _calls(spark, d)[0]


@query(f"WITH {PY}, {CALLS} SELECT (SELECT count(*) FROM p)::BIGINT * 4 AS total, count(*)::BIGINT AS resolved, round(count(*)::DOUBLE / ((SELECT count(*) FROM p) * 4), 6) AS rate FROM c")
def method_resolution_rate(spark, d):
    """[Q61, A3] How many of the method calls are resolved."""
    found, calls = _calls(spark, d)
    total = calls.filter("receiver is not null").agg(F.count(F.lit(1)).alias("total"))
    got = found.agg(F.count(F.lit(1)).alias("resolved"))
    return total.crossJoin(got).select("total", "resolved", F.round(F.col("resolved") / F.col("total"), 6).alias("rate"))  # one row each


@query(f"WITH {PY} SELECT path, 25 AS line, 'other' AS name, 'C' || k AS cls, path AS target, 85e-2::DOUBLE AS confidence FROM p")
def class_instances(spark, d):
    """[J20] Variables made by calling a class."""
    _, symbols, types = _facts(spark, d, "symbols", "types")
    return rs.instances(types, symbols)


@query(f"""WITH {PY}, {LINKS} SELECT path, 'item' AS name, 'C' || p AS type, 9e-1::DOUBLE AS confidence, 'annotation' AS how FROM p UNION ALL SELECT path, 'other', 'C' || k, 85e-2::DOUBLE, 'instantiation' FROM p
UNION ALL SELECT p.path, i.name, CASE WHEN i.path IS NULL THEN NULL WHEN i.name LIKE 'C%' THEN 'class' ELSE 'function' END, CASE WHEN i.path IS NULL THEN 0e0::DOUBLE ELSE 95e-2::DOUBLE END, CASE WHEN i.path IS NULL THEN 'unknown' ELSE 'import' END FROM i JOIN p ON p.k = i.k
UNION ALL SELECT path, 'third', NULL, 0e0::DOUBLE, 'unknown' FROM p""")
def variable_types(spark, d):
    """[J21, Q60] The type of a variable by annotation, instance or import."""
    _, symbols, imports, types = _facts(spark, d, "symbols", "imports", "types")
    asked = types.filter("how in ('annotation', 'instance', 'call')").select("path", "name").union(imports.select("path", F.explode("names")))
    return rs.variable_types(asked, types, symbols, _links(imports, symbols))


@query(f"""WITH {PY} SELECT path, 'make' || p AS name, (SELECT 'C' || q.k FROM p q WHERE q.k = p.p) AS type, false AS own FROM p UNION ALL SELECT path, 'run', 'int', true FROM p UNION ALL SELECT path, 'make' || k, 'C' || k, true FROM p""")
def type_lookup(spark, d):
    """[Q49, Q59] What a name is in its own file, else in any other: of functions, what they return."""
    _, imports, types = _facts(spark, d, "imports", "types")
    known = types.filter("how = 'return'")
    made = imports.select("path", F.explode("names").alias("name")).filter("name like 'make%'")
    return rs.lookup_types(known.select("path", "name").union(made), known)


@query(f"""WITH {PY}, f AS (SELECT unnest(['make' || p, 'make' || p, 'run', 'step' || j]) AS c FROM p), n AS (SELECT c, count(*)::BIGINT AS calls FROM f GROUP BY 1), t AS (SELECT unnest(['run', 'make' || k]) AS c FROM p WHERE NOT b), y AS (SELECT c, count(*)::BIGINT AS typed FROM t GROUP BY 1)
SELECT n.c AS callee, calls, typed, calls * typed AS pairs FROM n JOIN y USING (c)""")
def typed_calls(spark, d):
    """[J4] Calls that may give a typed value, by name."""
    _, symbols, calls = _facts(spark, d, "symbols", "calls")
    return rs.typed_calls(calls, symbols)


@query(f"""WITH {PY}, f AS (SELECT path, k, unnest(CASE WHEN b THEN []::STRUCT(c VARCHAR, l INTEGER, w VARCHAR)[] ELSE [{{'c': 'step' || j, 'l': 13, 'w': 'run'}}, {{'c': 'make' || p, 'l': 14, 'w': 'run'}}, {{'c': 'range', 'l': 18, 'w': 'step' || j}}, {{'c': 'C' || p, 'l': 24, 'w': 'make' || k}}, {{'c': 'C' || k, 'l': 25, 'w': 'make' || k}}, {{'c': 'getcwd', 'l': 26, 'w': 'make' || k}}, {{'c': 'join', 'l': 26, 'w': 'make' || k}}, {{'c': 'make' || p, 'l': 27, 'w': 'make' || k}}, {{'c': 'run', 'l': 28, 'w': 'make' || k}}] END) AS x FROM p)
SELECT path, x.l::INTEGER AS line, x.c AS callee, x.w AS caller FROM f""")
def call_owners(spark, d):
    """[J6, J7, J9] Each call with the function around it."""
    _, symbols, calls = _facts(spark, d, "symbols", "calls")
    return rs.callers(calls, symbols)


@query(f"""WITH {PY} SELECT q.path, 'make' || q.k AS name, 'caller' AS kind, p.path || ':' || unnest(['run', 'make' || p.k]) AS other FROM p q JOIN p ON p.p = q.k AND NOT p.b
UNION ALL SELECT path, 'make' || k, 'callee', unnest(['C' || p, 'C' || k, 'getcwd', 'join', 'make' || p, 'run']) FROM p WHERE NOT b
UNION ALL SELECT path, 'make' || k, 'import', unnest(['os', 'Optional', 'List', 'C' || p, 'make' || p]) FROM p""")
def symbol_dependencies(spark, d):
    """[G14, Q53] Who calls a module's function, whom it calls, and what its file imports."""
    _, symbols, imports, calls = _facts(spark, d, "symbols", "imports", "calls")
    asked = symbols.filter("type = 'function' and name like 'make%'")
    return rs.dependencies(asked, symbols, calls, _links(imports, symbols))


@query(f"""WITH {PY}, r AS (SELECT path, k, s, CASE WHEN b THEN 29 ELSE 28 END AS lines, CASE WHEN b THEN 5 ELSE 4 END AS n FROM p), f AS (SELECT 'src' AS folder, * FROM r UNION ALL SELECT regexp_extract(path, '^(src/g[0-9]+)/', 1), * FROM r)
SELECT folder, count(*)::BIGINT AS files, sum(n)::BIGINT AS symbols, sum(lines)::BIGINT AS lines, arg_min(path, (-lines, path)) AS largest FROM f GROUP BY 1""")
def package_tree(spark, d):
    """[A21, B11, G12] Folders with what is in and below them."""
    return rs.package_tree(code.symbols(pj.python_files(spark, d)))


@query(f"""WITH RECURSIVE {PY}, {MRO}, t AS (SELECT k, 'C' || k AS name, left(array_to_string(ln[7:20], chr(10)), 160) AS code FROM p WHERE NOT b),
x AS (SELECT m.k, left(string_agg(array_to_string(q.ln[7:20], chr(10)), chr(10) ORDER BY pos), 120) AS bases FROM m JOIN p q ON q.k = m.cur AND NOT q.b GROUP BY 1)
SELECT name, code, coalesce(bases, '') AS bases, left(array_to_string([ln[2], ln[3], ln[4]], chr(10)), 120) AS imports, least(1e0, round((length(code) + length(coalesce(bases, '')) + length(left(array_to_string([ln[2], ln[3], ln[4]], chr(10)), 120)))::DOUBLE / length(txt), 4)) AS ratio FROM t JOIN p USING (k) LEFT JOIN x USING (k)""")
def payload(spark, d):
    """[C13, C14, Q54, Q55, Q64] A class, those above it and its file's imports within a budget of tokens, and how much that is of the file."""
    files, symbols, imports, named, found = _facts(spark, d, "symbols", "imports", "base_imports", "bases")
    bases = rs.resolve_bases(found, symbols, _links(named, symbols))
    classes = symbols.filter("type = 'class' and end_line > start_line").join(files, "path")
    body = classes.select("path", "name", "text", tx.line_range(F.col("text"), F.col("start_line"), F.col("end_line")).alias("code"))
    above = graph.linearised(bases.select("cls", "base", "ord", "confidence")).select(F.col("cls").alias("name"), F.col("base"), "position")
    above = above.join(body.select(F.col("name").alias("base"), "code"), "base").select("name", "position", "code")
    lines = imports.select("path", "line").join(files, "path").join(body.select("path", "name"), "path")
    lines = lines.select("name", "line", tx.line_range(F.col("text"), F.col("line"), F.col("line")).alias("code"))
    got = ci.context(body.select("name", "code"), above, lines, 100).join(body.select("name", "text"), "name")
    ratio = (F.length("code") + F.length("bases") + F.length("imports")) / F.length("text")
    return got.select("name", "code", "bases", "imports", F.least(F.lit(1.0), F.round(ratio, 4)).alias("ratio"))
