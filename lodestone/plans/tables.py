"""Filters, aggregates, deduplication, windows and text measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import scores as sc
from lodestone.functions import text as tx
from lodestone.operators import relational as rel
from lodestone.operators import windows as win
from lodestone.plans.base import query
from lodestone.session import table


@query("SELECT lang, source, count(*)::BIGINT AS n, sum(n_chars)::BIGINT AS chars, round(avg(n_chars), 6) AS mean, max(n_chars) AS longest FROM documents GROUP BY ALL")
def doc_stats(spark, d):
    """[A2, A4, A37] Counts and sizes by facet."""
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.round(F.avg("n_chars"), 6).alias("mean"), F.max("n_chars").alias("longest"))


@query("SELECT 'documents' AS name, count(*)::BIGINT AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'embeddings', count(*) FROM embeddings UNION ALL SELECT 'events', count(*) FROM events")
def table_counts(spark, d):
    """[A1, A6] Row counts of several tables."""
    parts = [table(spark, d, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n") for t in ("documents", "pages", "embeddings", "events")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("SELECT count(*)::BIGINT AS total, count(*) FILTER (quality = 1)::BIGINT AS good, round(count(*) FILTER (quality = 1)::DOUBLE / nullif(count(*), 0), 6) AS rate FROM labels")
def resolution_rate(spark, d):
    """[A3] Totals, resolved and their rate."""
    n, good = F.count(F.lit(1)), F.count_if(F.col("quality") == 1)
    return table(spark, d, "labels").agg(n.alias("total"), good.alias("good"), F.round(F.try_divide(good, n), 6).alias("rate"))


@query("SELECT CASE WHEN source LIKE 'src0%' THEN 'main' WHEN source LIKE 'src1%' THEN 'tens' ELSE 'other' END AS bucket, count(*)::BIGINT AS n FROM documents GROUP BY ALL")
def scope_bucket(spark, d):
    """[A5] Scopes in buckets by prefix."""
    s = F.col("source")
    return table(spark, d, "documents").groupBy(F.when(s.like("src0%"), "main").when(s.like("src1%"), "tens").otherwise("other").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(DISTINCT source)::BIGINT AS sources, count(DISTINCT lang)::BIGINT AS langs FROM documents WHERE n_chars > 100")
def distinct_scopes(spark, d):
    """[A7, A8] Distinct counts."""
    return table(spark, d, "documents").filter("n_chars > 100").agg(F.count_distinct("source").alias("sources"), F.count_distinct("lang").alias("langs"))


@query("SELECT min(doc_id) AS doc_id, count(*)::BIGINT AS copies, md5(text) AS text_md5 FROM documents GROUP BY text")
def dedupe_min_id(spark, d):
    """[A33, S14, U5, U6] The smallest id of equal rows."""
    return rel.keep_least(table(spark, d, "documents"), ["text"], "doc_id").select("doc_id", "copies", F.md5("text").alias("text_md5"))


@query("SELECT DISTINCT ON (user_id, event_type) user_id, event_type, event_id, value FROM events ORDER BY user_id, event_type, ts DESC, event_id DESC")
def latest_per_key(spark, d):
    """[S13, S16, S22, J24] Upsert: the latest row of each key."""
    return win.latest_wins(table(spark, d, "events"), ["user_id", "event_type"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_type", "event_id", "value")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) r FROM events) WHERE r <= 5")
def keep_last_n(spark, d):
    """[W14, F16, Q67, T6, S32] The last rows of each key."""
    return win.first_n(table(spark, d, "events"), ["user_id"], 5, F.desc("ts"), F.desc("event_id")).select("user_id", "event_id")


@query("SELECT doc_id, used FROM (SELECT doc_id, lang, sum(n_chars // 4) OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM documents) WHERE used <= 60000")
def token_budget_prefix(spark, d):
    """[W9, W3, R13] The longest documents of each language within a budget of tokens."""
    return win.budget_prefix(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), ["lang"], F.expr("n_chars div 4"), 60000, F.desc("n_chars"), F.col("doc_id")).select("doc_id", "used")


@query("""WITH c AS (SELECT doc_id, lang, n_chars, len(regexp_split_to_array(text, '\\s+')) * 13e-1 + 1e1 AS cost FROM documents),
u AS (SELECT *, coalesce(sum(floor(cost)::BIGINT) OVER (PARTITION BY lang ORDER BY n_chars, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used FROM c),
o AS (SELECT *, max((used + cost > 2000)::INT) OVER (PARTITION BY lang ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING) AS over FROM u) SELECT doc_id, used FROM o WHERE over = 0""")
def word_budget_prefix(spark, d):
    """[W10] A budget whose costs are added up rounded down."""
    cost = F.size(F.split("text", "\\s+")) * 1.3 + 10.0
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars", cost.alias("cost"))  # no text is dealt out
    return win.budget_prefix_floored(docs, ["lang"], F.col("cost"), 2000, F.col("n_chars"), F.col("doc_id")).select("doc_id", F.col("used").cast("long"))


@query("""WITH o AS (SELECT l_orderkey, count(*) n FROM lineitem GROUP BY 1), u AS (SELECT l_orderkey, n, coalesce(sum(n) OVER (ORDER BY l_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) b FROM o)
SELECT l_orderkey, greatest(0, least(n, 50 - b))::BIGINT AS kept FROM u WHERE greatest(0, least(n, 50 - b)) > 0""")
def greedy_truncation(spark, d):
    """[W12, W11] Fifty items over groups, the last group in part."""
    o = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return win.greedy_cut(o, F.col("n"), 50, F.col("l_orderkey")).select("l_orderkey", F.col("kept").cast("long"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
g AS (SELECT doc_id, n, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS g FROM l WHERE length(line) < 60)
SELECT doc_id, min(n)::BIGINT AS start, count(*)::BIGINT AS length FROM g GROUP BY doc_id, g HAVING count(*) > 2""")
def line_islands(spark, d):
    """[W2, W15] Runs of more than two short lines."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    r = win.runs(lines, ["doc_id"], "n", F.length("line") < 60).filter("length > 2")
    return r.select("doc_id", (F.col("start") + 1).cast("long").alias("start"), "length")


@query("SELECT event_id FROM events WHERE user_id = 7 AND value >= 5 AND event_type ILIKE 'V%'")
def dynamic_filter(spark, d):
    """[F1-F5, F8, F9, F12-F14] A conjunction of the filters given."""
    return rel.where(table(spark, d, "events"), {"user_id": 7, "event_id": None}, {"value": 5}, {"event_type": "V%"}).select("event_id")


@query("SELECT p_partkey FROM part WHERE NOT (p_name LIKE 'small%' OR p_brand IN ('Brand#1', 'Brand#2')) AND length(p_name) <= 12")
def noise_filter(spark, d):
    """[F18, S3] Rows without what is to be left out."""
    return table(spark, d, "part").filter(~(F.col("p_name").rlike("^small") | F.col("p_brand").isin("Brand#1", "Brand#2")) & (F.length("p_name") <= 12)).select("p_partkey")


@query("""SELECT doc_id, len(list_filter(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: true))::INT AS n_tokens, coalesce(length(text) // 4, 0)::BIGINT AS by_chars, floor(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) * 13e-1)::BIGINT AS by_words FROM documents""")
def token_measures(spark, d):
    """[X1, M21-M24, Q48] Tokens, and estimates of them."""
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.size(tx.tokens(t)).alias("n_tokens"), tx.token_estimate(t).alias("by_chars"), tx.word_token_estimate(t).alias("by_words"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) ls FROM documents) SELECT doc_id, len(list_filter(ls, lambda x: regexp_matches(x, '\\s+$')))::INT AS trailing, len(list_filter(ls, lambda x: trim(x) <> ''))::INT AS lines, (ls[len(ls)] <> '') AS no_final_newline FROM l""")
def style_issues(spark, d):
    """[X19, X22, Q52] Trailing white space, lines, missing last line end."""
    ls = F.split("text", "\n")
    return table(spark, d, "documents").select("doc_id", F.size(F.filter(ls, lambda x: x.rlike("\\s+$"))).alias("trailing"), F.size(F.filter(ls, lambda x: F.trim(x) != "")).alias("lines"), (F.element_at(ls, -1) != "").alias("no_final_newline"))


@query("""SELECT doc_id, array_to_string(string_split(text, chr(10))[greatest(1, 3-1):least(len(string_split(text, chr(10))), 4+1)], chr(10)) AS part FROM documents""")
def line_ranges(spark, d):
    """[S31, R17] Lines 3 to 4 with one more on both sides."""
    return table(spark, d, "documents").select("doc_id", tx.line_range(F.col("text"), F.lit(3), F.lit(4), 1).alias("part"))


@query("""WITH h AS (SELECT page_id, regexp_extract_all(html, '<(h[1-6]|p|article|footer)[ >]', 1) AS tags FROM pages), e AS (SELECT page_id, unnest(tags) tag, generate_subscripts(tags, 1) pos, len(tags) n FROM h),
x AS (SELECT page_id, pos, tag, n, coalesce(lead(pos) OVER (PARTITION BY page_id ORDER BY pos) - 1, n) AS last FROM e WHERE tag <> 'p')
SELECT page_id, pos::INT AS start, last::INT AS "end", tag FROM x""")
def html_sections(spark, d):
    """[P10, W1] Sections: from a heading to before the next."""
    tags = F.regexp_extract_all("html", F.lit("<(h[1-6]|p|article|footer)[ >]"), F.lit(1))
    e = table(spark, d, "pages").select("page_id", F.size(tags).alias("n"), F.posexplode(tags).alias("i", "tag")).withColumn("start", F.col("i") + 1).filter("tag <> 'p'")
    w = win.Window.partitionBy("page_id").orderBy("start")
    return e.select("page_id", "start", F.coalesce(F.lead("start").over(w) - 1, F.col("n")).alias("end"), "tag")


@query("""SELECT doc_id, CASE WHEN days < 7 THEN 1e0 WHEN days < 30 THEN 8e-1 WHEN days < 90 THEN 6e-1 WHEN days < 180 THEN 4e-1 ELSE 2e-1 END AS step, round(exp(-23e-3*days), 9) AS decay FROM (SELECT o_orderkey AS doc_id, date_diff('day', o_orderdate::DATE, DATE '1998-08-02') AS days FROM orders) WHERE days >= 0""")
def recency(spark, d):
    """[D-1, D-2, D-4, D-5] Recency in steps and as decay, as of a date."""
    days = F.datediff(F.lit("1998-08-02").cast("date"), F.col("o_orderdate").cast("date"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), days.alias("days")).filter("days >= 0")
    return o.select("doc_id", sc.recency_step(F.col("days")).alias("step"), F.round(sc.recency_decay(F.col("days")), 9).alias("decay"))


@query("""SELECT o_orderkey, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s//60) || 'min ago' WHEN s < 86400 THEN (s//3600) || 'h ago' WHEN s < 604800 THEN (s//86400) || 'd ago' WHEN s < 2592000 THEN (s//604800) || 'w ago' WHEN s < 31536000 THEN (s//2592000) || 'mo ago' ELSE (s//31536000) || 'y ago' END AS ago
FROM (SELECT o_orderkey, date_diff('second', o_orderdate, TIMESTAMP '2003-01-01') AS s FROM orders)""")
def relative_time(spark, d):
    """[D-3] Time in words, as of a date."""
    s = F.unix_timestamp(F.lit("2003-01-01 00:00:00").cast("timestamp")) - F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    return table(spark, d, "orders").select("o_orderkey", sc.ago(s).alias("ago"))
