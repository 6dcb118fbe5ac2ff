"""Interval, as-of, outer, anti and pairwise joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import intervals as iv
from lodestone.operators import relational as rel
from lodestone.plans.base import query
from lodestone.session import dealt, table

#: Turns as ranges of character offsets in their conversation, and every 500th offset.
OFFSETS = """r AS (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - length(text) AS s, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - 1 AS e FROM conversations WHERE length(text) > 0),
p AS (SELECT conv_id, unnest(range(0, t::BIGINT, 500)) AS pt FROM (SELECT conv_id, max(e) + 1 AS t FROM r GROUP BY 1))"""


def _offsets(spark, d):
    c = table(spark, d, "conversations").filter(F.length("text") > 0)
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("text")).over(w)
    r = c.select("conv_id", "turn", (end - F.length("text")).alias("start"), (end - 1).alias("end"))
    p = r.groupBy("conv_id").agg(F.max("end").alias("last")).select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), "last", F.lit(500).cast("long"))).alias("at"))
    return p.withColumn("point", F.concat_ws(":", "conv_id", "at")), r


@query(f"WITH {OFFSETS} SELECT p.conv_id || ':' || pt AS point, arg_min(turn, e - s) AS turn FROM p JOIN r ON p.conv_id = r.conv_id AND pt BETWEEN s AND e GROUP BY 1")
def enclosing_interval(spark, d):
    """[J5-J9, F4, C13] The turn that holds a character offset."""
    p, r = _offsets(spark, d)
    return iv.innermost(p, r, "conv_id", "point", "turn")


@query("""WITH s AS (SELECT l_suppkey AS k, l_orderkey AS id, l_linenumber AS n, l_partkey AS s, l_partkey + (l_quantity*10)::INT AS e FROM lineitem), q AS (SELECT s_suppkey AS k, s_suppkey * 7 AS pt FROM supplier)
SELECT k AS s_suppkey, arg_min(id * 10 + n, (e - s, -s, id * 10 + n)) AS line FROM s JOIN q USING (k) WHERE pt BETWEEN s AND e GROUP BY 1""")
def innermost_range(spark, d):
    """[J5] The shortest range of a key that holds a point."""
    r = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.round(F.col("l_quantity") * 10).cast("int")).alias("end"))
    p = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") * 7).cast("long").alias("at")).withColumn("point", F.col("s_suppkey"))
    return iv.innermost(p, r, "s_suppkey", "point", "line").select(F.col("point").alias("s_suppkey"), "line")


@query(f"WITH {OFFSETS} SELECT p.conv_id || ':' || pt AS point, turn, s::BIGINT AS start FROM p JOIN r ON p.conv_id = r.conv_id AND pt BETWEEN s AND e")
def containing_ranges(spark, d):
    """[J8, J12, S31] Every range that holds a point, by buckets."""
    p, r = _offsets(spark, d)
    wide = 1 << 20  # one axis for all conversations, so that the join has no key but the bucket
    p = p.withColumn("at", F.col("conv_id") * wide + F.col("at"))
    r = r.withColumns({"start": F.col("conv_id") * wide + F.col("start"), "end": F.col("conv_id") * wide + F.col("end")}).drop("conv_id")
    return iv.bucketed(p, r, 4096).select("point", "turn", (F.col("start") - F.col("conv_id") * wide).alias("start"))


@query("""WITH a AS (SELECT l_suppkey k, l_orderkey o, l_linenumber n, l_partkey s, l_partkey + 20 e FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT l_suppkey k, l_orderkey o2, l_partkey s2, l_partkey + 5 e2 FROM lineitem WHERE l_returnflag = 'A')
SELECT k AS l_suppkey, count(*)::BIGINT AS pairs, sum(least(e, e2) - greatest(s, s2) + 1)::BIGINT AS shared FROM a JOIN b USING (k) WHERE s <= e2 AND s2 <= e GROUP BY 1""")
def interval_overlap(spark, d):
    """[J10-J12, M27, J34] Ranges of two sides that overlap, and by how much."""
    li = table(spark, d, "lineitem")
    a = li.filter("l_returnflag = 'R'").select("l_suppkey", F.col("l_partkey").alias("s"), (F.col("l_partkey") + 20).alias("e"))
    b = li.filter("l_returnflag = 'A'").select("l_suppkey", F.col("l_partkey").alias("s2"), (F.col("l_partkey") + 5).alias("e2"))
    return iv.overlaps(a, b, "l_suppkey", ("s", "e"), ("s2", "e2")).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("pairs"), F.sum("shared").alias("shared"))


@query("""WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), c AS (SELECT event_id AS click, user_id, ts AS cts FROM events WHERE event_type = 'click')
SELECT p.event_id, arg_max(click, (cts, click)) AS click FROM p LEFT JOIN c ON p.user_id = c.user_id AND cts <= ts GROUP BY 1""")
def backward_asof(spark, d):
    """[J13, J14, Q60] The latest earlier event of the same user."""
    e = table(spark, d, "events")
    p = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    c = e.filter("event_type = 'click'").select(F.col("event_id").alias("click"), "user_id", F.col("ts").alias("cts"))
    return iv.last_before(p, c, "user_id", "event_id", "ts", "cts", F.col("click"), "found", "click").select("event_id", F.col("found").alias("click"))


FOLLOW = """WITH c AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), p AS (SELECT event_id AS did, user_id, ts AS pts FROM events WHERE event_type = 'purchase'),
f AS (SELECT c.event_id, min(CASE WHEN pts > ts AND pts <= ts + INTERVAL 15 MINUTE THEN epoch_us(pts) - epoch_us(ts) END) AS us FROM c LEFT JOIN p USING (user_id) GROUP BY 1)"""


def _followed(spark, d):
    e = table(spark, d, "events")
    c = e.filter("event_type = 'click'").select("event_id", "user_id", "ts")
    p = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("did"), "user_id", F.col("ts").alias("pts"))
    return iv.first_within(c, p, "user_id", "event_id", "ts", "pts", 900, "did")


@query(FOLLOW + " SELECT event_id, round(us / 1e6, 6) AS delay FROM f")
def prediction_followup(spark, d):
    """[J15] The first purchase within 15 minutes after a click."""
    return _followed(spark, d).select("event_id", F.round("delay", 6).alias("delay"))


@query(FOLLOW + " SELECT count(*)::BIGINT AS total, count(us)::BIGINT AS followed, round(count(us)::DOUBLE/count(*), 3) AS rate, round(avg(us / 1e6), 1) AS mean_delay FROM f")
def prediction_accuracy(spark, d):
    """[A13] How many predictions came true, and how fast."""
    n, hit = F.count(F.lit(1)), F.count("delay")
    return _followed(spark, d).agg(n.alias("total"), hit.alias("followed"), F.round(hit / n, 3).alias("rate"), F.round(F.avg("delay"), 1).alias("mean_delay"))


@query("SELECT doc_id, 'documents' AS side FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) UNION ALL SELECT doc_id, 'labels' FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE l.doc_id = d.doc_id)")
def orphans_both_ways(spark, d):
    """[J25, F10, X-1, X-2, X-5] Rows that lack their counterpart, on both sides."""
    return rel.orphans(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id", "documents", "labels")


@query("""WITH o AS (SELECT user_id, event_type, count(*) n FROM events WHERE ts < TIMESTAMP '2024-01-10' GROUP BY ALL), w AS (SELECT user_id, event_type, count(*) n FROM events WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY ALL)
SELECT coalesce(o.user_id, w.user_id) AS user_id, coalesce(o.event_type, w.event_type) AS event_type, CASE WHEN o.n IS NULL THEN 'added' WHEN w.n IS NULL THEN 'removed' ELSE 'modified' END AS change FROM o FULL JOIN w ON o.user_id = w.user_id AND o.event_type = w.event_type WHERE o.n IS DISTINCT FROM w.n""")
def structural_diff(spark, d):
    """[J31, U3, U1, B8] What came, went and changed between two states."""
    e = table(spark, d, "events")
    count = lambda x: x.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return rel.structural_diff(count(e.filter("ts < timestamp_ntz'2024-01-10'")), count(e.filter("ts >= timestamp_ntz'2024-01-20'")), ["user_id", "event_type"], "n")


@query("SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'N' AND l_quantity > 45")
def conflicting_keys(spark, d):
    """[J32, J30, U2] Keys that both of two sides touch."""
    li = table(spark, d, "lineitem")
    return li.filter("l_returnflag = 'R'").select("l_partkey").intersect(li.filter("l_returnflag = 'N' and l_quantity > 45").select("l_partkey"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id % 7 NOT IN (1, 2) UNION ALL SELECT doc_id, 'new' FROM documents WHERE doc_id % 7 = 1")
def incremental_merge(spark, d):
    """[S22, U2] Old rows but for replaced and deleted ones, and the new rows."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    new = docs.filter("doc_id % 7 = 1").withColumn("lang", F.lit("new"))
    return rel.merge(docs, new, "doc_id", new, docs.filter("doc_id % 7 = 2"))


#: Distinct content words of user turns, with the stop words taken out.
WORDS = """w AS (SELECT conv_id, turn, conv_id * 100 + turn AS id, list_distinct(list_filter(list_transform(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x NOT IN ('the','a','an','and','or','but','in','on','at','to','for','of','with','by','is','are','was','were','be','it','this','that')), lambda x: regexp_replace(x, '^[.,!?;:]+|[.,!?;:]+$', '', 'g')), lambda x: length(x) > 2)) AS ws, lower(text) AS t FROM conversations WHERE role = 'user')"""


def _user_words(spark, d):
    u = table(spark, d, "conversations").filter("role = 'user'")
    return u.withColumn("id", F.col("conv_id") * 100 + F.col("turn")).withColumn("ws", tx.content_words(F.col("text")))


@query(f"WITH {WORDS} SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.ws, b.ws))::DOUBLE / len(list_distinct(list_concat(a.ws, b.ws))), 9) AS similarity FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.id < b.id WHERE len(a.ws) > 0 AND len(b.ws) > 0 AND len(list_intersect(a.ws, b.ws))::DOUBLE / len(list_distinct(list_concat(a.ws, b.ws))) > 5e-2")
def similar_turns(spark, d):
    """[W8, J28, L4] User turns of a conversation that resemble each other."""
    return rel.similar_pairs(_user_words(spark, d), "id", F.col("ws"), 0.05, "conv_id").withColumn("similarity", F.round("similarity", 9))


@query(f"WITH {WORDS}, x AS (SELECT id, t LIKE '%the%' OR t LIKE '%do%' AS p, t LIKE '%not%' OR t LIKE '%nin%' AS n, unnest(ws) AS k FROM w) SELECT DISTINCT a.id AS a, b.id AS b FROM x a JOIN x b ON a.k = b.k AND a.id < b.id WHERE (a.p AND b.n) OR (a.n AND b.p)")
def pairwise_contradiction(spark, d):
    """[J27, X5, X16, L15] Turns about the same thing with opposite markers, of all conversations."""
    u = dealt(table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", "text"), "conv_id", "turn")
    return rel.contradictions(u.withColumn("id", F.col("conv_id") * 100 + F.col("turn")), "id", "text", tx.content_words(F.col("text")), ["the", "do"], ["not", "nin"])


@query("""WITH a AS (SELECT l_orderkey k, 0 AS s, l_suppkey AS v FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT l_orderkey k, 1 AS s, l_suppkey AS v FROM lineitem WHERE l_returnflag = 'A'), c AS (SELECT o_orderkey k, 2 AS s, -1 AS v FROM orders)
SELECT DISTINCT ON (k) k, s AS strategy, v FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) ORDER BY k, s, v""")
def priority_resolution(spark, d):
    """[J19] The answer of the first strategy that has one."""
    li = table(spark, d, "lineitem")
    part = lambda f: li.filter(f"l_returnflag = '{f}'").select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("v"))
    rest = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.lit(-1).cast("long").alias("v"))
    return rel.priority_first([part("R"), part("A"), rest], ["k"], "v").select("k", "strategy", "v")
