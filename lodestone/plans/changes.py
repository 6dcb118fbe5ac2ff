"""Queries over changes, tests and what projects are made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import rules as ru
from lodestone.operators import impact as im
from lodestone.operators import resolution as rs
from lodestone.plans import project as pj
from lodestone.plans.base import query
from lodestone.plans.facts import PY
from lodestone.plans.probes import expected, parts
from lodestone.sources import code
from lodestone.session import stored, table

DIFF = "diff --git a/src/m{a}.py b/src/m{a}.py\nindex 1..2 100644\n--- a/src/m{a}.py\n+++ b/src/m{a}.py\n@@ -10,3 +12,5 @@ def f\n x\n@@ -20,0 +30,2 @@\n+y\n{new}{old}"


@query("""WITH o AS (SELECT o_orderkey::BIGINT AS k FROM orders) SELECT k::VARCHAR AS id, 'src/m' || k % 50 || '.py' AS path, 'modified' AS status, unnest([12, 30]) AS start, unnest([16, 31]) AS "end", unnest(['modified', 'added']) AS change FROM o
UNION ALL SELECT k::VARCHAR, 'new' || k || '.py', 'added', 1, 4, 'added' FROM o WHERE k % 3 = 0 UNION ALL SELECT k::VARCHAR, 'old' || k || '.py', 'deleted', 0, 0, 'deleted' FROM o WHERE k % 5 = 0""")
def diff_hunks(spark, d):
    """[P23, P24, Q14, S27] Unified diffs as rows, one a hunk."""
    k = F.col("o_orderkey").cast("long")
    new = F.when(k % 3 == 0, pj.fill("diff --git a/new{k}.py b/new{k}.py\nnew file mode 100644\n--- /dev/null\n+++ b/new{k}.py\n@@ -0,0 +1,4 @@\n+z\n", k=k)).otherwise("")
    old = F.when(k % 5 == 0, pj.fill("diff --git a/old{k}.py b/old{k}.py\ndeleted file mode 100644\n--- a/old{k}.py\n+++ /dev/null\n@@ -1,7 +0,0 @@\n-z\n", k=k)).otherwise("")
    return code.diffs(table(spark, d, "orders").select(k.alias("k"), pj.fill(DIFF, a=k % 50, new=new, old=old).alias("text")), "k", "text")


@query("""WITH o AS (SELECT o_orderkey::BIGINT AS k FROM orders) SELECT k::VARCHAR AS id, unnest(['M', 'A', 'R', 'D']) AS status, unnest(['src/a' || k || '.py', 'new' || k || '.py', 'moved' || k || '.py', 'gone' || k || '.py']) AS path, unnest([NULL, NULL, 'was' || k || '.py', NULL]) AS old FROM o""")
def name_status(spark, d):
    """[Q13] Which files a range of commits modified, added, renamed and deleted."""
    k = F.col("o_orderkey").cast("long")
    text = pj.fill("M\tsrc/a{k}.py\nA\tnew{k}.py\nR087\twas{k}.py\tmoved{k}.py\nD\tgone{k}.py\n", k=k)
    return code.statuses(table(spark, d, "orders").select(k.alias("k"), text.alias("text")), "k", "text")


BLAME = "{h} 1 1 2\nauthor A{a}\nauthor-time {t}\n\tline one\n{h} 2 2\n\tline two\nffffffff 1 3 1\nauthor B\nauthor-time {u}\n\tline three"


def _blame(spark, d):
    k = F.col("o_orderkey").cast("long")
    t = 1_700_000_000 + (k % 40) * 86_400
    text = pj.fill(BLAME, h=F.lpad(k.cast("string"), 8, "0"), a=k % 7, t=t, u=F.lit(1_701_000_000))
    return code.blames(table(spark, d, "orders").select(k.alias("k"), text.alias("text")), "k", "text")


@query("""WITH o AS (SELECT o_orderkey::BIGINT AS k FROM orders) SELECT k::VARCHAR AS id, unnest([1, 2, 3]) AS line, unnest([lpad(k::VARCHAR, 8, '0'), lpad(k::VARCHAR, 8, '0'), 'ffffffff']) AS "commit", unnest(['A' || k % 7, 'A' || k % 7, 'B']) AS author, unnest([1700000000 + k % 40 * 86400, 1700000000 + k % 40 * 86400, 1701000000])::BIGINT AS at FROM o""")
def blame_lines(spark, d):
    """[S29, P25] Who wrote each line, and when."""
    return _blame(spark, d)


@query("""WITH o AS (SELECT o_orderkey::BIGINT AS k, 1700000000 + o_orderkey % 40 * 86400 AS t, 1701000000 AS u FROM orders) SELECT k::VARCHAR AS id, CASE WHEN t > u THEN 'A' || k % 7 ELSE 'B' END AS author, greatest(t, u)::BIGINT AS at, CASE WHEN abs(t - u) < 604800 AND t // 86400 <> u // 86400 THEN 2 ELSE 1 END::BIGINT AS days, 2::BIGINT AS authors FROM o""")
def last_edits(spark, d):
    """[Q22, A20, B5] Who edited a text last, on how many recent days it was edited, and by how many."""
    return im.last_edits(_blame(spark, d))


#: Changed lines of files by branch.
BRANCH = """c AS (SELECT k % 4 AS branch, path, 12 AS a, 13 AS e, b FROM p UNION ALL SELECT (k + 1) % 4, path, CASE WHEN k % 20 = 0 THEN 13 ELSE 17 END, 18, b FROM p WHERE k % 10 = 0)"""


def _branches(spark, d):
    files = pj.python_files(spark, d)
    k = F.regexp_extract("path", "m(\\d+)\\.py$", 1).cast("long")
    one = files.select((k % 4).alias("branch"), "path", F.lit(12).alias("start"), F.lit(13).alias("end"))
    two = files.filter(k % 10 == 0).select(((k + 1) % 4).alias("branch"), "path", F.when(k % 20 == 0, 13).otherwise(17).alias("start"), F.lit(18).alias("end"))
    return one.union(two).hint("merge"), code.facts(files, "symbols")[0]  # a row a file at least, which Spark takes for fewer bytes


TOUCHED = """t AS (SELECT c.branch, p.path, unnest(CASE WHEN p.b THEN CASE WHEN a <= 16 AND e >= 16 THEN [{'n': 'step' || j, 't': 'function', 'l': 1}] ELSE []::STRUCT(n VARCHAR, t VARCHAR, l INTEGER)[] END
ELSE list_filter([{'n': 'C' || k, 't': 'class', 'l': least(e, 20) - greatest(a, 7) + 1}, {'n': 'run', 't': 'method', 'l': least(e, 14) - greatest(a, 10) + 1}, {'n': 'step' || j, 't': 'method', 'l': least(e, 20) - greatest(a, 16) + 1}], lambda z: z.l > 0) END) AS x FROM c JOIN p USING (path))"""


@query(f"WITH {PY}, {BRANCH}, {TOUCHED} SELECT branch, path, x.n AS name, x.t AS type, x.l::BIGINT AS lines FROM t")
def touched_symbols(spark, d):
    """[Q15, J12, C10] The symbols that a branch's changed lines touch."""
    changes, symbols = _branches(spark, d)
    return im.touched_symbols(changes, symbols, ("branch",))


@query(f"""WITH {PY}, {BRANCH}, {TOUCHED}, f AS (SELECT DISTINCT branch, path FROM c), s AS (SELECT path FROM f GROUP BY 1 HAVING count(*) > 1), n AS (SELECT branch, count(*)::BIGINT AS n FROM t GROUP BY 1)
SELECT f.branch, count(*)::BIGINT AS files, any_value(coalesce(n, 0)) AS symbols, count(s.path)::BIGINT AS conflicts, CASE WHEN any_value(coalesce(n, 0)) > 50 THEN 'critical' WHEN any_value(coalesce(n, 0)) > 20 THEN 'high' WHEN any_value(coalesce(n, 0)) > 5 THEN 'medium' ELSE 'low' END AS risk FROM f LEFT JOIN s USING (path) LEFT JOIN n USING (branch) GROUP BY 1""")
def branch_report(spark, d):
    """[A34, C10, C11, M16] What each branch changes, where branches meet, and the risk."""
    return im.branch_report(*_branches(spark, d))


@query(f"WITH {PY}, {BRANCH} SELECT path, least(x.branch, y.branch) AS a, greatest(x.branch, y.branch) AS b, sum(least(x.e, y.e) - greatest(x.a, y.a) + 1)::BIGINT AS lines FROM c x JOIN c y USING (path) WHERE x.branch < y.branch AND x.a <= y.e AND y.a <= x.e GROUP BY ALL")
def branch_overlaps(spark, d):
    """[J11] Lines that two branches both change."""
    return im.branch_overlaps(_branches(spark, d)[0])


@query("""WITH p AS (SELECT p_partkey::BIGINT AS k, p_size AS h FROM part) SELECT 'f' || k AS path, CASE WHEN k % 10 = 3 THEN 'deleted' WHEN k % 13 = 0 THEN CASE WHEN k % 2 = 0 THEN 'untracked' ELSE 'added' END ELSE 'modified' END AS status FROM p WHERE k % 10 = 3 AND k % 13 <> 0 OR k % 10 <> 3 AND (k % 13 = 0 OR k % 9 = 0)""")
def change_set(spark, d):
    """[Z3, S28] Files that changed since they were indexed, and files that are not tracked."""
    p = table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("k"), F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("path"), F.col("p_size").alias("h"))
    indexed = p.filter("k % 13 != 0").select("path", F.col("h").alias("hash"))
    present = p.filter("k % 10 != 3").select("path", F.when(F.col("k") % 9 == 0, F.col("h") + 100).otherwise(F.col("h")).alias("hash"))
    return im.change_set(indexed, present, p.filter("not (k % 13 = 0 and k % 2 = 0)"))


@query("""WITH s AS (SELECT s_nationkey AS project, count(*) AS total, count(*) FILTER (s_suppkey % 3 = 0) AS changed FROM supplier GROUP BY 1) SELECT project, total::BIGINT AS total, changed::BIGINT AS changed, changed::DOUBLE / total > 3e-1 AS reparse FROM s""")
def reparse_decision(spark, d):
    """[Z5] Projects of which so much changed that all is parsed again."""
    g = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("project")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("s_suppkey") % 3 == 0).alias("changed"))
    return g.withColumn("reparse", im.reparse_all(F.col("changed"), F.col("total")))


def _words(files, symbols):
    """The words of test functions, which are asked for several times."""
    return stored(im.test_functions(files, symbols)).hint("merge")


TESTS = "from src.g{h}.m{k} import make{k}\n\n\ndef test_make{k}():\n    assert make{k}(1)\n\n\ndef test_other():\n    pass"


def _tested(spark, d):
    files = pj.python_files(spark, d)
    k = F.regexp_extract("path", "m(\\d+)\\.py$", 1).cast("long")
    tests = files.filter(k % 3 == 0).select(F.concat(F.lit("tests/test_m"), k.cast("string"), F.lit(".py")).alias("path"), pj.fill(TESTS, k=k, h=F.floor(k / 50)).alias("text"))
    everything = files.union(tests)
    symbols, calls = code.facts(everything, "symbols", "calls")
    asked = symbols.filter("type = 'function' and name like 'make%'").select("path", "name")
    return everything, symbols, asked, calls


@query(f"WITH {PY} SELECT path, 'make' || k AS name, 'tests/test_m' || k || '.py::test_make' || k AS test FROM p WHERE k % 3 = 0")
def affected_tests(spark, d):
    """[Q1, J29] The tests that speak of a function."""
    files, symbols, asked, _ = _tested(spark, d)
    return im.affected_tests(asked, _words(files, symbols), 10)


@query(f"WITH {PY} SELECT path, 'make' || k AS name, 'tests/test_m' || k || '.py' AS file FROM p WHERE k % 3 = 0")
def test_files(spark, d):
    """[Q5, Q51] The test files that speak of a function or its module."""
    files, symbols, asked, _ = _tested(spark, d)
    return im.candidate_files(asked, _words(files, symbols))


@query(f"""WITH {PY}, g AS (SELECT k FROM p WHERE NOT b), n AS (SELECT q.path, q.k, count(p.k) * 2 AS callers FROM p q LEFT JOIN p ON p.p = q.k AND NOT p.b GROUP BY ALL), m AS (SELECT path, k, callers + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS callers, CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS tests,
CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN callers > 0 THEN (SELECT count(*) FROM g) + 1 + CASE WHEN k + 2 IN (SELECT k FROM g) THEN 1 ELSE 0 END + CASE WHEN k % 3 = 2 THEN 1 ELSE 0 END - CASE WHEN k IN (SELECT k FROM g) THEN 1 ELSE 0 END ELSE 0 END AS indirect FROM n),
c AS (SELECT *, CASE WHEN callers = 0 THEN 1e0 WHEN tests = 0 THEN 0e0 ELSE 1e0 END AS coverage, callers + 3e-1 * indirect AS use FROM m),
r AS (SELECT *, CASE WHEN use = 0 THEN 'low' WHEN use < 5 THEN CASE WHEN coverage >= 7e-1 THEN 'low' ELSE 'high' END WHEN use < 15 THEN CASE WHEN coverage >= 8e-1 THEN 'medium' ELSE 'critical' END WHEN coverage >= 8e-1 THEN 'high' ELSE 'critical' END AS risk FROM c)
SELECT path, 'make' || k AS name, callers::BIGINT AS callers, indirect::BIGINT AS indirect, tests::BIGINT AS tests, coverage, risk, risk = 'low' OR coverage >= 9e-1 AS safe,
array_to_string(list_filter([CASE WHEN callers > 0 THEN 'a new signature breaks ' || callers || ' callers' END, CASE WHEN indirect > 10 THEN indirect || ' indirect callers feel it' END, CASE WHEN coverage < 5e-1 AND callers > 0 THEN 'only 0% covered' END], lambda x: x IS NOT NULL), '; ') AS breaking,
CASE WHEN callers = 0 THEN 'safe to modify' ELSE CASE WHEN risk IN ('high', 'critical') THEN 'deprecate before changing the signature; ' ELSE '' END || CASE WHEN tests > 0 THEN 'update the tests' ELSE 'add tests first; cover more' END END AS advice FROM r""")
def impact_report(spark, d):
    """[C1, G5, Q3, Q4] What changing a function would break, counting who calls its callers too, and what to do first."""
    files, symbols, asked, calls = _tested(spark, d)
    found = stored(rs.callers(calls, symbols).select(F.col("callee").alias("name"), "path", "caller").distinct()).hint("merge")
    direct = found.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    tests = im.affected_tests(asked, _words(files, symbols)).groupBy("path", "name").agg(F.count(F.lit(1)).alias("n"))
    got = im.impact(asked, direct, im.indirect_callers(asked, found), tests)
    return got.select("path", "name", "callers", "indirect", "tests", "coverage", "risk", "safe", F.array_join("breaking", "; ").alias("breaking"), F.array_join("advice", "; ").alias("advice"))


ASK = [("how do we fetch from an API #", "http"), ("where are errors handled #", "errors,logging"), ("sql of table #", "database"), ("nothing at #", "http,errors,database,files,async,logging,validation"), ("await in parallel #", "async"), ("check input #", "validation")]


@query(f"WITH {expected([r[1:] for r in ASK], 'behaviors')} SELECT * FROM x")
def behaviors_asked(spark, d):
    """[Q19] The behaviours that a query is about; all if it names none."""
    return parts(spark, d, q=[r[0] for r in ASK]).select("k", F.array_join(im.behaviors_asked(F.col("q")), ",").alias("behaviors"))


MANIFESTS = [
    ('[project]\nname = "a#"\ndependencies = ["FastAPI", "pytest"]', "FastAPI,pytest", "FastAPI Application"),
    ('[tool.poetry]\nname = "b#"\nsqlalchemy = "*"', "SQLAlchemy", "Python Library"),
    ('[project]\nname = "c#"', "", "Python Project"),
    ('[project]\nrequires = ["flask", "Django"]', "Django,Flask", "Django Application"),
]


@query(f"WITH {expected([r[1:] for r in MANIFESTS], 'stack, type')} SELECT k, stack, type, list_extract(['Server (Python)', 'CLI application (Python)', 'Library with modular components (Python)', 'REST API (Python)', 'Modular Python application'], (k % 5 + 1)::INTEGER) AS architecture FROM x")
def project_stack(spark, d):
    """[Q16, Q17, C9] The technologies, kind and architecture of a project."""
    rows = parts(spark, d, m=[r[0] for r in MANIFESTS], f=["server,api", "cmd,web", "src,docs", "api,models,src", "misc"])
    m = F.col("m")
    return rows.select("k", F.array_join(im.stack(m, "python"), ",").alias("stack"), im.project_type(m).alias("type"), im.architecture(F.split("f", ","), F.lit("python")).alias("architecture"))


@query(f"""WITH {PY} SELECT path, unnest(['step' || j, 'make' || p, 'C' || p, 'C' || k, 'getcwd', 'run']) AS callee, unnest([1, 2, 1, 1, 1, 1])::BIGINT AS calls FROM p""")
def own_calls(spark, d):
    """Calls of each file by name, those of the languages' own left out."""
    calls = code.calls(pj.python_files(spark, d)).filter(~ru.is_builtin(F.col("callee")))
    return calls.groupBy("path", "callee").agg(F.count(F.lit(1)).alias("calls"))


@query(f"""WITH {PY}, n AS (SELECT path, unnest(CASE WHEN b THEN ['C' || k, 'run', 'step' || j, 'make' || k, 'broken'] ELSE ['C' || k, 'run', 'step' || j, 'make' || k] END) AS name, b, k FROM p) SELECT path, count(*) + 1 AS total, greatest(0, count(*) + 1 - 5)::BIGINT AS dropped, CASE WHEN count(*) + 1 > 5 THEN 'truncated' ELSE 'near the limit' END AS warning FROM n GROUP BY path""")
def symbol_limits(spark, d):
    """[F16, Q67] Files with as many symbols as a file may have, or nearly, and how many of them are over that."""
    return code.over_limit(code.symbols(pj.python_files(spark, d)), 5)
