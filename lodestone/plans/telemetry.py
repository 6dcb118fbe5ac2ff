"""Usage telemetry over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import windows as win
from lodestone.plans.base import query
from lodestone.session import table


@query("SELECT sum(CASE WHEN value > 50 THEN 1 ELSE 0 END)::BIGINT AS valid, sum(CASE WHEN value <= 50 THEN 1 ELSE 0 END)::BIGINT AS expired, count(*)::BIGINT AS total FROM events")
def cache_stats(spark, d):
    """[A9] Conditional sums."""
    return table(spark, d, "events").agg(F.sum(F.when(F.col("value") > 50, 1).otherwise(0)).alias("valid"), F.sum(F.when(F.col("value") <= 50, 1).otherwise(0)).alias("expired"), F.count(F.lit(1)).alias("total"))


@query("SELECT user_id, round(sum(value), 4) AS total FROM events GROUP BY 1 HAVING count(*) >= 5 ORDER BY round(sum(value), 4) DESC, user_id LIMIT 20")
def hot_items(spark, d):
    """[A10, A22, A30, T7] The twenty most used."""
    g = table(spark, d, "events").groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("total"), F.count(F.lit(1)).alias("n"))
    return g.filter("n >= 5").orderBy(F.desc("total"), "user_id").limit(20).select("user_id", "total")


@query("SELECT event_type, count(*)::BIGINT AS calls, round(count(*) FILTER (value < 60)::DOUBLE / count(*), 4) AS success_rate, round(avg(CASE WHEN value > 10 THEN value END), 2) AS mean_positive FROM events GROUP BY 1")
def tool_statistics(spark, d):
    """[A17, A11, A18, A31] Per tool: calls, success, mean over some."""
    v = F.col("value")
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("calls"), F.round(F.count_if(v < 60) / F.count(F.lit(1)), 4).alias("success_rate"), F.round(F.avg(F.when(v > 10, v)), 2).alias("mean_positive"))


@query("SELECT user_id, count(*)::BIGINT AS events, count(*) FILTER (event_type = 'error')::BIGINT AS errors, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS k, count(DISTINCT event_type)::BIGINT AS kinds FROM events GROUP BY 1")
def session_summary(spark, d):
    """[A16, A14, F22, Q38, Q47, Q68] Totals per user, with a value out of JSON."""
    return table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("event_type") == "error").alias("errors"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"), F.count_distinct("event_type").alias("kinds"))


@query("SELECT 'view' AS first, event_type AS next, count(*)::BIGINT AS n FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) b FROM events) WHERE b = 'view' GROUP BY ALL")
def command_bigrams(spark, d):
    """[W18] What comes right after a view."""
    return win.follows(table(spark, d, "events"), "user_id", "event_type", "view", "ts", "event_id")


@query("""WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 3600000000 THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, max(ts) AS "end", count(*)::BIGINT AS events FROM s GROUP BY user_id, s""")
def idle_sessions(spark, d):
    """[W16, L19] Sessions that an hour of rest ends."""
    return win.sessions(table(spark, d, "events"), "user_id", "ts", 3600)


@query("WITH x AS (SELECT event_type, user_id, count(*) c FROM events GROUP BY ALL) SELECT event_type, arg_max(user_id, (c, -user_id)) AS top_user, max(c)::BIGINT AS n FROM x GROUP BY 1")
def most_frequent(spark, d):
    """[A12, A23, A29] The most frequent value of each group; ties to the smaller."""
    c = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("c"))
    return c.groupBy("event_type").agg(F.max_by("user_id", F.struct("c", -F.col("user_id"))).alias("top_user"), F.max("c").alias("n"))


@query("SELECT user_id, max(ts) AS last_ts, count(DISTINCT ts::DATE)::BIGINT AS days, arg_max(event_type, (ts, event_id)) AS last_type FROM events WHERE ts >= TIMESTAMP '2024-01-24' GROUP BY 1")
def churn_stats(spark, d):
    """[A20, B5, Q21] Last edit, days of edits, by whom."""
    e = table(spark, d, "events").filter("ts >= timestamp_ntz'2024-01-24'")
    return e.groupBy("user_id").agg(F.max("ts").alias("last_ts"), F.count_distinct(F.to_date("ts")).alias("days"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"))


@query("SELECT user_id, event_type FROM events GROUP BY ALL HAVING count(*) >= 3 AND bool_and(value < 150)")
def success_patterns(spark, d):
    """[A25-A27, L13, Q29, Q30] Seen three times or more, and always well."""
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("value") < 150).alias("all")).filter("n >= 3 and all").select("user_id", "event_type")


@query("SELECT user_id, CASE WHEN count(DISTINCT event_type) = 1 THEN min(event_type) WHEN count(DISTINCT value > 50) = 1 THEN 'value' ELSE 'universal' END AS scope FROM events GROUP BY 1")
def scope_inference(spark, d):
    """[A28] The narrowest scope that all rows of a key share."""
    kinds, values = F.collect_set("event_type"), F.collect_set(F.col("value") > 50)
    return table(spark, d, "events").groupBy("user_id").agg(F.when(F.size(kinds) == 1, kinds[0]).when(F.size(values) == 1, "value").otherwise("universal").alias("scope"))
