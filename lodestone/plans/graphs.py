"""Graph queries over suppliers, parts and places."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import scores as sc
from lodestone.operators import graph as gr
from lodestone.plans.base import query
from lodestone.session import table

#: Edges among a few numbers, made from keys: they hold cycles.
RING = "e AS (SELECT DISTINCT (l_partkey % 17)::BIGINT AS src, (l_suppkey % 17)::BIGINT AS dst FROM lineitem WHERE l_partkey % 17 <> l_suppkey % 17)"


def _ring(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_partkey") % 17).cast("long").alias("src"), (F.col("l_suppkey") % 17).cast("long").alias("dst")).filter("src != dst").distinct()


def _places(spark, d):
    r = table(spark, d, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"))
    c = table(spark, d, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("src"), F.concat(F.lit("c"), "c_custkey").alias("dst"))
    return r.union(c)


PLACES = "e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer)"


@query(f"WITH RECURSIVE {RING}, b(node, depth) AS (SELECT 0::BIGINT, 0 UNION SELECT dst, depth + 1 FROM b JOIN e ON node = src WHERE depth < 4) SELECT node, min(depth)::INT AS depth FROM b GROUP BY 1")
def bfs_depth(spark, d):
    """[G1, G3-G5, U1] What can be reached in four steps."""
    return gr.reach(_ring(spark, d), spark.range(1).select(F.lit(0).cast("long").alias("node")), 4)


@query(f"WITH RECURSIVE {RING}, b(node, depth) AS (SELECT 3::BIGINT, 0 UNION SELECT src, depth + 1 FROM b JOIN e ON node = dst WHERE depth < 3) SELECT node, min(depth)::INT AS depth FROM b GROUP BY 1 ORDER BY min(depth), node LIMIT 10")
def bfs_reverse_capped(spark, d):
    """[G2, G1] Backwards, and only the first ten nodes by depth."""
    e = _ring(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return gr.reach(e, spark.range(1).select(F.lit(3).cast("long").alias("node")), 3, 10)


@query(f"WITH RECURSIVE {PLACES}, b(root, node, depth) AS (SELECT src, dst, 1 FROM e UNION SELECT root, dst, depth + 1 FROM b JOIN e ON node = src) SELECT root, count(*)::BIGINT AS below, max(depth)::INT AS depth FROM b GROUP BY 1")
def hierarchy_descendants(spark, d):
    """[G7, G12, A21] All that is below each place."""
    return gr.descendants(_places(spark, d), 5).groupBy("root").agg(F.count(F.lit(1)).alias("below"), F.max("depth").alias("depth"))


@query(f"""WITH RECURSIVE {RING}, p(first, last, path) AS (SELECT src, dst, [src, dst] FROM e WHERE src < dst UNION ALL SELECT first, dst, list_append(path, dst) FROM p JOIN e ON last = src WHERE dst > first AND NOT list_contains(path, dst) AND len(path) < 4)
SELECT array_to_string(path, '>') AS path, len(path)::INT AS length FROM p JOIN e ON last = src AND dst = first""")
def cycle_detect(spark, d):
    """[G9, Q12, Q24, J30] Simple cycles of up to four nodes."""
    return gr.cycles(_ring(spark, d), 4).select(F.array_join("path", ">").alias("path"), "length")


@query(f"""WITH RECURSIVE {RING}, p(first, last, path) AS (SELECT src, dst, [src, dst] FROM e WHERE src < dst UNION ALL SELECT first, dst, list_append(path, dst) FROM p JOIN e ON last = src WHERE dst > first AND NOT list_contains(path, dst) AND len(path) < 4),
c AS (SELECT list_transform(path, lambda x: CASE WHEN x % 8 = 0 THEN 'core' || x ELSE 'm' || x END) AS path FROM p JOIN e ON last = src AND dst = first),
s AS (SELECT CASE WHEN len(path) <= 3 THEN CASE WHEN len(list_filter(path, lambda x: x LIKE '%core%')) > 0 THEN 'high' ELSE 'medium' END WHEN len(list_filter(path, lambda x: x LIKE '%core%')) > 0 THEN 'critical' ELSE 'high' END AS severity FROM c)
SELECT severity, count(*)::BIGINT AS n FROM s GROUP BY 1""")
def cycle_severity(spark, d):
    """[M15, T8] Cycles by severity."""
    c = gr.cycles(_ring(spark, d), 4).select(F.transform("path", lambda x: F.when(x % 8 == 0, F.concat(F.lit("core"), x)).otherwise(F.concat(F.lit("m"), x))).alias("path"))
    return c.groupBy(sc.cycle_severity(F.col("path")).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def hierarchy_lists(spark, d):
    """[G11, A21, Q50] Children of each parent as a list."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return gr.children(n, "r_name", F.col("n_name")).select("r_name", F.array_join("children", ",").alias("nations"))


@query("""WITH e AS (SELECT DISTINCT l_suppkey s, l_partkey p FROM lineitem), h AS (SELECT a.s, count(DISTINCT b.s) - 1 AS two FROM e a JOIN e b USING (p) GROUP BY 1), o AS (SELECT s, count(*) AS one FROM e GROUP BY 1),
u AS (SELECT o.s, one, coalesce(two, 0) AS two, (o.s % 10) / 1e1 AS cov FROM o LEFT JOIN h USING (s)), k AS (SELECT *, one + 3e-1 * two AS use FROM u),
r AS (SELECT s, one, two, cov, CASE WHEN use = 0 THEN 'low' WHEN use < 5 THEN CASE WHEN cov >= 7e-1 THEN 'low' WHEN cov >= 4e-1 THEN 'medium' ELSE 'high' END WHEN use < 15 THEN CASE WHEN cov >= 8e-1 THEN 'medium' WHEN cov >= 5e-1 THEN 'high' ELSE 'critical' END ELSE CASE WHEN cov >= 8e-1 THEN 'high' ELSE 'critical' END END AS risk FROM k)
SELECT s AS suppkey, one::BIGINT AS direct, two::BIGINT AS transitive, risk, risk = 'low' OR (risk = 'medium' AND cov >= 7e-1) OR (risk = 'high' AND cov >= 9e-1) AS safe FROM r""")
def impact_risk(spark, d):
    """[C1, M10, G5, Q2] Direct and indirect use, and the risk of a change."""
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).distinct()
    two = gr.two_hops(e, "s", "p").select("s", (F.col("n") - 1).alias("two"))
    u = e.groupBy("s").agg(F.count(F.lit(1)).alias("one")).join(two, "s", "left").withColumn("two", F.coalesce("two", F.lit(0))).withColumn("cov", (F.col("s") % 10) / 10.0)
    u = u.withColumn("risk", sc.impact_risk(F.col("one"), F.col("two"), F.col("cov")))
    return u.select(F.col("s").alias("suppkey"), F.col("one").alias("direct"), F.col("two").alias("transitive"), "risk", sc.safe_to_modify(F.col("risk"), F.col("cov")).alias("safe"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 49 UNION SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity >= 49),
r(a, b) AS (SELECT src, dst FROM e UNION SELECT a, dst FROM r JOIN e ON b = src),
c AS (SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1)
SELECT node, component, count(*) OVER (PARTITION BY component)::BIGINT AS size FROM c""")
def components(spark, d):
    """[G8-G10] Suppliers and parts on circles of any length, over large returns and large sales."""
    li = table(spark, d, "lineitem").filter("l_quantity >= 49")
    s, p = F.concat(F.lit("s"), "l_suppkey"), F.concat(F.lit("p"), "l_partkey")
    there = li.filter("l_returnflag = 'R'").select(s.alias("src"), p.alias("dst"))
    back = li.filter("l_returnflag = 'A'").select(p.alias("src"), s.alias("dst"))
    found = gr.components(there.union(back))
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return found.join(sizes, "component").select("node", "component", "size")
