"""Queries that judge a source tree: architecture rules, examples, cycles, syntax and style."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import codeintel as ci
from lodestone.operators import graph
from lodestone.plans import project as pj
from lodestone.plans.base import query
from lodestone.plans.facts import LINKS, PY, _facts, _links
from lodestone.session import cut, table
from lodestone.sources import code


def _violations(spark, d):
    files = pj.python_files(spark, d)
    return ci.architecture(files, *code.facts(files, "documented", "imports"), {"src/g0/": ("os",)})


@query(f"""WITH {PY} SELECT path, 'type_coverage' AS rule, 'medium' AS severity, 'step' || j AS what FROM p WHERE NOT b UNION ALL SELECT path, 'docstring_coverage', 'medium', unnest(['step' || j, 'make' || k]) FROM p WHERE NOT b
UNION ALL SELECT path, 'import_restrictions', 'high', 'os' FROM p WHERE k < 50""")
def architecture_violations(spark, d):
    """[C4, Q8] Functions without hints or docstrings, imports that a folder may not have, waiting calls in async functions."""
    return _violations(spark, d)


@query(f"""WITH {PY}, v AS (SELECT 'src/g' || k // 50 AS folder, CASE WHEN b THEN 0 ELSE 3 END AS medium, CASE WHEN k < 50 THEN 1 ELSE 0 END AS high FROM p), s AS (SELECT folder, sum(medium) AS m, sum(high) AS h FROM v GROUP BY 1)
SELECT folder, CASE WHEN h > 0 THEN 'fail' WHEN m > 0 THEN 'warnings' ELSE 'pass' END AS status, CASE WHEN h > 0 THEN h || ' high, ' ELSE '' END || m || ' medium' AS summary FROM s WHERE m + h > 0""")
def architecture_status(spark, d):
    """[Q10, Q11] Whether a folder keeps to the rules, and how many violations of each severity it has."""
    rows = _violations(spark, d).withColumn("folder", F.regexp_extract("path", "^(src/g\\d+)/", 1))
    return ci.severities(rows, "folder")


@query(f"""WITH {PY} SELECT path, 10::INTEGER AS line, trim(array_to_string(ln[9:13], chr(10)), ' ' || chr(10)) AS snippet FROM p ORDER BY path LIMIT 3""")
def pattern_examples(spark, d):
    """[Q7, Q9] The first three files that follow a pattern, each with its first line and the lines around."""
    return ci.examples(pj.python_files(spark, d), "def run\\(", 3)


def _imports(spark, d):
    """(edges between files, symbols)"""
    _, symbols, imports = _facts(spark, d, "symbols", "imports")
    edges = cut(graph.import_edges(_links(imports, symbols))).hint("merge")  # read twice
    k = F.regexp_extract("src", "m(\\d+)\\.py$", 1).cast("long")
    # Every tenth file also imports the one that imports it.
    back = edges.filter(k % 10 == 1).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.union(back), symbols


@query(f"""WITH {PY}, c AS (SELECT p.path AS x, q.path AS y FROM p JOIN p q ON q.k = p.p WHERE p.k % 10 = 1) SELECT array_to_string([least(x, y), greatest(x, y)], ' ') AS path, 2::INTEGER AS length FROM c""")
def import_cycles(spark, d):
    """[G9, Q12, Q24] Circles of up to three files that import each other, by references that are distinct and not to themselves."""
    edges, _ = _imports(spark, d)
    return graph.cycles(edges, 3).select(F.array_join("path", " ").alias("path"), "length")


@query(f"""WITH {PY}, c AS (SELECT unnest([p.path, q.path]) AS path FROM p JOIN p q ON q.k = p.p WHERE p.k % 10 = 1), n AS (SELECT path, unnest(CASE WHEN b THEN ['C' || k, 'run', 'step' || j, 'make' || k, 'broken'] ELSE ['C' || k, 'run', 'step' || j, 'make' || k] END) AS name FROM p) SELECT DISTINCT path, name FROM n JOIN c USING (path)""")
def symbols_in_cycles(spark, d):
    """[G10] The symbols of files that are in a circle of up to three; :func:`graph.components` finds those of any length."""
    edges, symbols = _imports(spark, d)
    inside = graph.cycles(edges, 3).select(F.explode("path").alias("path")).distinct()
    return symbols.filter("type != 'file'").join(inside, "path", "left_semi").select("path", "name").distinct()


@query(f"""WITH {PY}, s AS (SELECT s_suppkey::BIGINT + 1 AS k FROM supplier) SELECT path, NOT b AS valid FROM p UNION ALL SELECT 'web/s' || k || '.js', k % 2 = 0 FROM s UNION ALL SELECT 'web/t' || k || '.ts', k % 2 = 0 FROM s""")
def syntax(spark, d):
    """[X37] Whether a file parses, or of scripts whether their brackets are balanced."""
    scripts = pj.script_files(spark, d)
    k = F.regexp_extract("path", "(\\d+)\\.[jt]s$", 1).cast("long")
    scripts = scripts.withColumn("text", F.when(k % 2 == 1, F.concat("text", F.lit("\nfoo([)]"))).otherwise(F.concat("text", F.lit("\n// :( \n`}` + '['"))))
    return code.valid(pj.python_files(spark, d).union(scripts))


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (SELECT doc_id, t, rtrim(regexp_replace(regexp_replace(t, '[ \\t]+(\\n|$)', '\\1', 'g'), '\\n{4,}', repeat(chr(10), 3), 'g'), chr(10)) || chr(10) AS n FROM d) SELECT doc_id, n <> t AS changed, length(n)::BIGINT AS length FROM f""")
def style_fixes(spark, d):
    """[X20, X19] Texts without white space at the ends of lines, with two blank lines at most and one line end behind."""
    fixed = tx.fixed(F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", (fixed != F.coalesce("text", F.lit(""))).alias("changed"), F.length(fixed).cast("long").alias("length"))


@query(f"WITH {PY}, {LINKS} SELECT i.importer, count(*)::BIGINT AS names, count(i.path)::BIGINT AS resolved, count(DISTINCT i.path)::BIGINT AS files FROM i GROUP BY 1")
def import_report(spark, d):
    """[A3] How many names a file imports, how many of them are found, and in how many files."""
    _, symbols, imports = _facts(spark, d, "symbols", "imports")
    return _links(imports, symbols).groupBy("importer").agg(F.count(F.lit(1)).alias("names"), F.count("path").alias("resolved"), F.count_distinct("path").alias("files"))
