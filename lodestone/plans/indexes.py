"""Indexes on disk that updates change in part, and searches of them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestone.operators.pivots import PivotIndex
from lodestone.operators.segments import And, Not, Or, Phrase, Prefix, Segments, Term
from lodestone.plans.base import query
from lodestone.session import shared_dir, table


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 97 = 5 THEN text || ' Changed twice' WHEN doc_id % 89 = 4 THEN 'changed once' ELSE text END AS text FROM documents WHERE doc_id % 101 <> 7 OR doc_id % 97 = 5),
t AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9_]+'))) AS term FROM d)
SELECT term, count(DISTINCT doc_id)::BIGINT AS docs, count(*)::BIGINT AS times FROM t GROUP BY 1""")
def index_updates(spark, d):
    """[Z4, Z6, Z7, S7, X-1] A term index after three updates that change, delete and put back about one document in a hundred each: what a full build would have."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    index = Segments(spark, _folder(spark, "segments"))
    index.update(docs)
    index.update(docs.filter("doc_id % 89 = 4").withColumn("text", F.lit("changed once")))
    index.update(docs.limit(0), deleted=docs.filter("doc_id % 101 = 7"))
    index.update(docs.filter("doc_id % 97 = 5").withColumn("text", F.concat("text", F.lit(" Changed twice"))))
    return index.rows().groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("places").cast("long")).alias("times"))


#: Lower-cased words in a row, each with a space on both sides.
WORDS = "t AS (SELECT doc_id, ' ' || array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: lower(x)), ' ') || ' ' AS w FROM documents)"


@query(f"WITH {WORDS} SELECT doc_id, lang FROM t JOIN documents USING (doc_id) WHERE (w LIKE '% the %' OR w LIKE '% que%') AND (w LIKE '% of the %' OR w LIKE '% de la %' OR w LIKE '% in the of %') AND NOT (w LIKE '% is %' AND w LIKE '% and %')")
def boolean_search(spark, d):
    """[R2, F7, J1] Documents by words, beginnings and phrases with AND, OR and NOT, joined to their rows."""
    docs = table(spark, d, "documents")
    index = Segments(spark, _folder(spark, "segments"))
    index.update(docs)
    phrases = Or(Phrase(("of", "the")), Phrase(("de", "la")), Phrase(("in", "the", "of")))
    found = index.matching(And(Or(Term("the"), Prefix("que")), phrases, Not(And(Term("is"), Term("and")))))
    return docs.join(found, docs.doc_id == found.id).select("doc_id", "lang")


@query("""WITH q AS (SELECT embedding e FROM embeddings ORDER BY vec_id LIMIT 1),
v AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]) AS s FROM embeddings, q WHERE vec_id % 50 <> 7)
SELECT vec_id, round(s, 5) AS score FROM v ORDER BY s DESC, vec_id LIMIT 15""")
def pivot_search(spark, d):
    """[R4, S17, S18, J3, X-2] The nearest vectors by an index on disk of which some have been removed, as a scan of the rest finds them."""
    e = table(spark, d, "embeddings")
    index = PivotIndex.build(e, _folder(spark, "pivots"))
    index.remove(e.filter("vec_id % 50 = 7").select("vec_id"))
    first = e.orderBy("vec_id").select("embedding").first()[0]
    return index.search(first, 15).select(F.col("id").alias("vec_id"), F.round("score", 5).alias("score"))
