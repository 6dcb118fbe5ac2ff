"""Retrieval over documents and embeddings. Ids in brackets are those of the operator inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import search
from lodestone.operators.index import TermIndex
from lodestone.plans.base import query
from lodestone.session import table

#: Term counts, lengths and statistics of the words the, and, ion.
BM25 = """t AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text,''), '[A-Za-z0-9_]+'), lambda x: lower(x)) AS w FROM documents),
c AS (SELECT doc_id, len(w)::DOUBLE dl, len(list_filter(w, lambda x: x='the'))::DOUBLE a, len(list_filter(w, lambda x: x='and'))::DOUBLE b, len(list_filter(w, lambda x: x='ion'))::DOUBLE d FROM t),
s AS (SELECT count(*)::DOUBLE n, avg(dl) av, sum((a>0)::INT)::DOUBLE da, sum((b>0)::INT)::DOUBLE db, sum((d>0)::INT)::DOUBLE dd FROM c),
r AS (SELECT doc_id, a, b, d, ln((n-db+5e-1)/(db+5e-1)+1e0)*b*25e-1/(b+15e-1*(25e-2+75e-2*dl/av)) + ln((n-dd+5e-1)/(dd+5e-1)+1e0)*d*25e-1/(d+15e-1*(25e-2+75e-2*dl/av)) + ln((n-da+5e-1)/(da+5e-1)+1e0)*a*25e-1/(a+15e-1*(25e-2+75e-2*dl/av)) AS s FROM c, s WHERE a+b+d>0)"""
#: Cosines with the vector of the smallest id.
COSINE = """q AS (SELECT embedding e FROM embeddings ORDER BY vec_id LIMIT 1),
z AS (SELECT vec_id, list_transform(list_zip(embedding, e), lambda p: p[1]::DOUBLE*p[2]::DOUBLE) xy, list_transform(embedding, lambda x: x::DOUBLE*x::DOUBLE) xx, list_transform(e, lambda x: x::DOUBLE*x::DOUBLE) yy FROM embeddings, q),
v AS (SELECT vec_id, list_sum(xy)/(sqrt(list_sum(xx))*sqrt(list_sum(yy))) AS s FROM z)"""
LISTS = f"""{BM25}, {COSINE},
k AS (SELECT doc_id, least(round(s,9)/1e1, 1e0) s, row_number() OVER (ORDER BY least(round(s,9)/1e1, 1e0) DESC, doc_id) rk FROM r QUALIFY rk <= 20),
m AS (SELECT vec_id AS doc_id, round(s,9) s, row_number() OVER (ORDER BY round(s,9) DESC, vec_id) rk FROM v QUALIFY rk <= 20),
j AS (SELECT coalesce(k.doc_id, m.doc_id) AS doc_id, k.s ks, k.rk kr, m.s ms, m.rk mr FROM k FULL JOIN m ON k.doc_id = m.doc_id)"""
KIND = "CASE WHEN kr IS NULL THEN 'semantic' WHEN mr IS NULL THEN 'keyword' ELSE 'both' END AS match_type"


def _index(spark, d):
    return TermIndex.of(table(spark, d, "documents"), f"{d}/documents.parquet")


def _keyword(spark, d):
    return _index(spark, d).bm25("the and ion").withColumn("score", F.round("score", 9))


def _vector(spark, d):
    e = table(spark, d, "embeddings")
    first = e.orderBy("vec_id").select("embedding").first()[0]
    return search.cosine_scores(e, first).select(F.col("vec_id").alias("doc_id"), F.round("score", 9).alias("score"))


@query(f"WITH {BM25} SELECT doc_id, round(s, 6) AS score FROM r ORDER BY round(s,6) DESC, doc_id LIMIT 20")
def bm25_topk(spark, d):
    """[R1, T2, A19, M1-M3] Ranked keyword search."""
    s = _index(spark, d).bm25("the and ion")
    return s.select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


@query(f"WITH {BM25} SELECT doc_id, round(s, 6) AS score FROM r WHERE a > 0 AND b > 0")
def bm25_all_terms(spark, d):
    """[R2, T1] Keyword search for documents that hold all terms; scores as in the any-term search."""
    return _index(spark, d).bm25("the and ion", all_of=("the", "and")).select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {COSINE} SELECT vec_id, round(s, 5) AS score FROM v WHERE s >= 2e-1 ORDER BY s DESC, vec_id LIMIT 10")
def cosine_topk(spark, d):
    """[R3, T3, T4, F11] Nearest vectors by cosine, at least 0.2."""
    e = table(spark, d, "embeddings")
    first = e.orderBy("vec_id").select("embedding").first()[0]
    return search.cosine_topk(e, first, 10, 0.2).select("vec_id", F.round("score", 5).alias("score"))


@query(f"WITH {LISTS} SELECT doc_id, round(coalesce(1e0/(60+kr),0e0)+coalesce(1e0/(60+mr),0e0), 9) AS score, {KIND} FROM j")
def rrf_fusion(spark, d):
    """[R5, M6] Reciprocal rank fusion of the keyword and the vector list."""
    out = search.rrf(search.ranked(search.clipped(_keyword(spark, d)), 20, "doc_id"), search.ranked(_vector(spark, d), 20, "doc_id"), "doc_id")
    return out.withColumn("score", F.round("score", 9))


@query(f"WITH {LISTS} SELECT doc_id, round(7e-1*coalesce(ks,0e0)+3e-1*coalesce(ms,0e0), 6) AS score, {KIND} FROM j")
def weighted_fusion(spark, d):
    """[R6, M7] Weighted fusion."""
    out = search.weighted(search.ranked(search.clipped(_keyword(spark, d)), 20, "doc_id"), search.ranked(_vector(spark, d), 20, "doc_id"), "doc_id", 0.7, 0.3)
    return out.withColumn("score", F.round("score", 6))


@query(f"WITH {LISTS} SELECT doc_id, round(coalesce(1e0/(60+kr),0e0)+coalesce(1e0/(60+mr),0e0), 9) AS score, {KIND} FROM j ORDER BY coalesce(1e0/(60+kr),0e0)+coalesce(1e0/(60+mr),0e0) DESC, doc_id LIMIT 10")
def hybrid_search(spark, d):
    """[R7, R8, R9] Hybrid search, balanced."""
    return search.hybrid(_keyword(spark, d), _vector(spark, d), "doc_id", "the and ion").withColumn("score", F.round("score", 9))


@query(f"WITH {BM25} SELECT doc_id, round(least(round(s,9)/1e1,1e0), 6) AS score, 'keyword_fallback' AS match_type FROM r ORDER BY least(round(s,9)/1e1,1e0) DESC, doc_id LIMIT 10")
def hybrid_fallback(spark, d):
    """[R7, R9] Hybrid search where there are no vectors."""
    return search.hybrid(_keyword(spark, d), None, "doc_id", "the and ion").withColumn("score", F.round("score", 6))


@query("""WITH t AS (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: lower(x))) w FROM documents)
SELECT doc_id, round(len(list_intersect(w, ['the','and','of']))::DOUBLE/len(w), 9) AS score FROM t WHERE len(w) > 0 AND len(list_intersect(w, ['the','and','of']))::DOUBLE/len(w) >= 2e-2""")
def token_overlap(spark, d):
    """[R10] Share of a document's tokens that a query has."""
    return _index(spark, d).overlap("the and of", 0.02).select("doc_id", F.round("score", 9).alias("score"))


@query("""WITH q AS (SELECT DISTINCT p_name AS q FROM part UNION SELECT DISTINCT p_brand FROM part UNION SELECT DISTINCT p_type FROM part UNION SELECT * FROM (VALUES ('getUser'), ('HttpServer'), ('read_file'), ('MAX_SIZE'), ('how do I read a file'), ('find users'), ('one two three four')) t(q)),
w AS (SELECT q, regexp_matches(q, '^[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)+$') OR regexp_matches(q, '^[a-z0-9]+(?:_[a-z0-9]+)+$') OR regexp_matches(q, '^[A-Z][A-Z0-9_]+$') i, regexp_split_to_array(trim(q), '\\s+') ws FROM q)
SELECT q, CASE WHEN i THEN 'keyword' WHEN len(list_filter(ws, lambda x: lower(x) IN ('what','how','where','when','why','which','who','find','show','get','list','all','that','the','a','an'))) > 0 THEN 'semantic' WHEN len(ws) <= 3 THEN 'keyword' ELSE 'semantic' END AS kind FROM w""")
def query_kind(spark, d):
    """[X3] Kinds of queries."""
    p = table(spark, d, "part")
    probes = ["getUser", "HttpServer", "read_file", "MAX_SIZE", "how do I read a file", "find users", "one two three four"]
    q = p.select(F.col("p_name").alias("q")).union(p.select("p_brand")).union(p.select("p_type")).union(spark.createDataFrame([(x,) for x in probes], "q string"))
    return q.distinct().select("q", search.query_kind(F.col("q")).alias("kind"))


@query("""SELECT DISTINCT p_name, array_to_string(list_filter(list_transform(regexp_extract_all(p_name, '[A-Za-z0-9_]+'), lambda x: lower(x)), lambda x: length(x) > 2 AND x NOT IN ('the','and','for')), ' ') AS words FROM part""")
def query_keywords(spark, d):
    """[X4, X6] Keywords of a query, in order."""
    return table(spark, d, "part").select("p_name").distinct().select("p_name", F.array_join(tx.keywords(F.col("p_name")), " ").alias("words"))


@query("""SELECT doc_id, CASE WHEN strpos(lower(text), 'the') > 0 THEN substr(text, greatest(1, strpos(lower(text), 'the')-30), strpos(lower(text), 'the')+50-greatest(1, strpos(lower(text), 'the')-30)) ELSE substr(text, 1, 100) END AS snippet FROM documents""")
def snippets(spark, d):
    """[X9] The surroundings of a word, or how a document begins."""
    return table(spark, d, "documents").select("doc_id", tx.snippet(F.col("text"), ["the"]).alias("snippet"))


@query("""SELECT DISTINCT p_name || s AS q, CASE WHEN regexp_matches(p_name || s, '[^A-Za-z0-9_\\s]') AND NOT regexp_matches(p_name || s, '\\b(?:AND|OR|NOT)\\b') THEN '"' || replace(p_name || s, '"', '""') || '"' ELSE p_name || s END AS escaped FROM part, (VALUES (''), ('.x'), (' AND y.z'), ('"q"')) v(s)""")
def escaped_queries(spark, d):
    """[X2] Queries made safe for a full-text engine."""
    ends = F.explode(F.array(*map(F.lit, ("", ".x", " AND y.z", '"q"'))))
    q = table(spark, d, "part").select("p_name").distinct().withColumn("s", ends).select(F.concat("p_name", "s").alias("q"))
    return q.distinct().select("q", tx.escape_query(F.col("q")).alias("escaped"))
