"""Scores and classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import scores as sc
from lodestone.plans.base import query
from lodestone.session import table


@query("""WITH m AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size * 2e0 END AS cov, CASE WHEN p_size % 3 = 0 THEN NULL ELSE (p_partkey % 10) / 1e1 END AS cx, CASE WHEN p_size % 4 = 0 THEN NULL ELSE (p_partkey % 15)::DOUBLE END AS ch, CASE WHEN p_size % 7 = 0 THEN NULL ELSE (p_partkey % 12)::DOUBLE END AS dp FROM part),
s AS (SELECT p_partkey, CASE WHEN (cov IS NOT NULL)::INT + (cx IS NOT NULL)::INT + (ch IS NOT NULL)::INT >= 2 THEN round(4e-1*coalesce(cov/1e2,5e-1)+3e-1*coalesce(1e0-cx,5e-1)+2e-1*CASE WHEN ch IS NULL THEN 5e-1 ELSE 1e0-least(ch/1e1,1e0) END+1e-1*CASE WHEN dp IS NULL THEN 7e-1 ELSE 1e0-least(dp/1e1,1e0) END,2) END AS score FROM m)
SELECT p_partkey, score, CASE WHEN score >= 75e-2 THEN 'high' WHEN score >= 5e-1 THEN 'medium' ELSE 'low' END AS level FROM s""")
def stability_score(spark, d):
    """[M8, B7, C17] Stability of parts, from measures that may be absent."""
    size, key = F.col("p_size"), F.col("p_partkey")
    m = table(spark, d, "part").select(
        "p_partkey",
        sc.stability(F.when(size % 5 != 0, size * 2.0), F.when(size % 3 != 0, (key % 10) / 10.0), F.when(size % 4 != 0, (key % 15).cast("double")), F.when(size % 7 != 0, (key % 12).cast("double"))).alias("score"),
    )
    return m.select("p_partkey", "score", sc.stability_level(F.col("score")).alias("level"))


@query("SELECT p_partkey, CASE WHEN p_size <= 10 AND p_partkey % 200 <= 50 THEN 'low' WHEN p_size <= 20 AND p_partkey % 200 <= 150 THEN 'medium' ELSE 'high' END AS complexity, greatest(0, least(100, 20 * (p_size % 8)) - 10 * (p_partkey % 6))::BIGINT AS coverage, round(least((p_size % 3) / 2e0, 4e-1) + 3e-1 * (1e0 - (p_partkey % 11) / 1e1), 9) AS risk, round(6e-1 * (p_size / 5e1) + 2e-1 * (p_partkey % 2) + 2e-1 * (p_partkey % 3), 9) AS quality FROM part")
def part_scores(spark, d):
    """[M9, M11, M12, M20, Q6, Q23] Levels and scores of code measures."""
    s, k = F.col("p_size"), F.col("p_partkey")
    return table(spark, d, "part").select(
        "p_partkey",
        sc.complexity_level(s, k % 200).alias("complexity"),
        sc.coverage_percent(s % 8, k % 6).cast("long").alias("coverage"),
        F.round(sc.anchor_risk(s % 3, (k % 11) / 10.0)["score"], 9).alias("risk"),
        F.round(sc.anchor_quality(s / 50.0, k % 2, k % 3), 9).alias("quality"),
    )


@query("""WITH m AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'universal' WHEN 1 THEN 'language:' || lang WHEN 2 THEN 'project:' || source ELSE 'else' END AS scope, (doc_id % 11) / 1e1 AS conf, doc_id % 200 AS days FROM documents),
f AS (SELECT doc_id, conf, CASE WHEN scope = 'universal' THEN 1e0 WHEN scope = 'language:en' THEN 8e-1 WHEN scope LIKE 'language:%' THEN 0e0 WHEN scope = 'project:src0' THEN 1e0 WHEN scope LIKE 'project:%' THEN 0e0 ELSE 5e-1 END AS f, CASE WHEN days < 7 THEN 1e0 WHEN days < 30 THEN 8e-1 WHEN days < 90 THEN 6e-1 WHEN days < 180 THEN 4e-1 ELSE 2e-1 END AS r FROM m)
SELECT doc_id, round(f * r * conf, 9) AS relevance, CASE WHEN conf >= 9e-1 THEN 'auto' WHEN conf < 5e-1 THEN 'skip' ELSE 'review' END AS approval FROM f WHERE f * r * conf > 0""")
def memory_relevance(spark, d):
    """[M5, R13, L8, T5, Q33, F8] Relevance of memories by scope, age and confidence."""
    k = F.col("doc_id")
    scope = F.when(k % 4 == 0, "universal").when(k % 4 == 1, F.concat(F.lit("language:"), "lang")).when(k % 4 == 2, F.concat(F.lit("project:"), "source")).otherwise("else")
    m = table(spark, d, "documents").select("doc_id", sc.memory_relevance(scope, "en", "src0", sc.recency_step(k % 200), (k % 11) / 10.0).alias("relevance"), sc.approval((k % 11) / 10.0).alias("approval"))
    return m.filter("relevance > 0").withColumn("relevance", F.round("relevance", 9))


@query("""WITH m AS (SELECT doc_id, doc_id % 3 = 0 u, doc_id % 5 = 0 r, doc_id % 2 = 0 s, CASE doc_id % 3 WHEN 0 THEN 'contradiction' WHEN 1 THEN 'obsolescence' ELSE 'redundancy' END k FROM documents), p AS (SELECT doc_id, 3*u::INT+2*r::INT+2*s::INT+CASE k WHEN 'contradiction' THEN 2 WHEN 'obsolescence' THEN 1 ELSE 0 END AS p FROM m)
SELECT doc_id, CASE WHEN p >= 7 THEN 'critical' WHEN p >= 5 THEN 'high' WHEN p >= 3 THEN 'medium' ELSE 'low' END AS severity FROM p""")
def conflict_severity(spark, d):
    """[M13, L15, Q34, Q35] Severity of conflicts."""
    k = F.col("doc_id")
    kind = F.when(k % 3 == 0, "contradiction").when(k % 3 == 1, "obsolescence").otherwise("redundancy")
    return table(spark, d, "documents").select("doc_id", sc.conflict_severity(k % 3 == 0, k % 5 == 0, k % 2 == 0, kind).alias("severity"))


@query("""SELECT p_partkey, CASE WHEN p_size > 50 OR (c AND p_size > 20) THEN 'critical' WHEN p_size > 20 OR c THEN 'high' WHEN p_size > 5 THEN 'medium' ELSE 'low' END AS branch, CASE WHEN c THEN least(1e0, b + 1e-1) WHEN p_size % 2 = 0 THEN greatest(3e-1, b - 2e-1) ELSE b END AS divergence
FROM (SELECT *, p_name LIKE '%ring%' AS c, CASE p_type WHEN 'ECONOMY' THEN 9e-1 WHEN 'SMALL' THEN 7e-1 ELSE 5e-1 END AS b FROM part)""")
def change_risk(spark, d):
    """[M16, M17, L11] Risk of a branch, confidence of a divergence."""
    c = F.col("p_name").contains("ring")
    size = F.when(F.col("p_type") == "ECONOMY", "major").when(F.col("p_type") == "SMALL", "moderate").otherwise("minor")
    return table(spark, d, "part").select("p_partkey", sc.branch_risk(F.col("p_size"), c).alias("branch"), sc.divergence_confidence(size, c, F.col("p_size") % 2 == 0).alias("divergence"))


@query("SELECT source, round(greatest(0e0, 1e0 - sum(CASE quality WHEN 0 THEN 1 ELSE 0 END + toxic * 2) / (2e0 * count(*))), 2) AS conformance, round(avg(quality::DOUBLE), 2) AS consistency FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def conformance(spark, d):
    """[A35, A36, C3, Q7, Q10] Conformance of sources to rules."""
    x = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    weight = F.when(F.col("quality") == 0, 1).otherwise(0) + F.col("toxic") * 2
    return x.groupBy("source").agg(sc.conformance(F.sum(weight), F.count(F.lit(1))).alias("conformance"), F.round(F.avg(F.col("quality").cast("double")), 2).alias("consistency"))


@query("SELECT doc_id, ((length(text) - 50) * 15)::BIGINT AS tokens_saved, round(1e2 * (length(text) - 50) / length(text), 1) AS percent, round(5e1 / length(text), 3) AS ratio, round(length(text) / 1e6 * 3e0, 9) AS dollars FROM documents WHERE length(text) > 50")
def skeleton_savings(spark, d):
    """[M25, M26, Q64, A32] What leaving lines out saves."""
    n = F.length("text")
    return table(spark, d, "documents").filter(n > 50).select("doc_id", sc.savings(n, F.lit(50)).alias("s"), F.round(sc.dollars(n), 9).alias("dollars")).select("doc_id", F.col("s.tokens_saved").cast("long").alias("tokens_saved"), "s.percent", "s.ratio", "dollars")
