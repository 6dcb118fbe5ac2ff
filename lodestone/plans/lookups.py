"""Symbols by name, ranked results, and tables that go out to files and come back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestone.operators.segments import Or, Prefix, Segments, Term
from lodestone.plans import project as pj
from lodestone.plans.base import query
from lodestone.plans.facts import PY
from lodestone.plans.searches import BM25, _index
from lodestone.session import cut, shared_dir, table
from lodestone.sources import code


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("SELECT doc_id, lang, source, n_chars::BIGINT AS n_chars, md5(text) AS text_md5 FROM documents")
def json_sink(spark, d):
    """[S8, S9] Documents written as JSON lines and read back by their schema, of which a line that does not fit it fails the job."""
    docs, folder = table(spark, d, "documents"), _folder(spark, "json")
    docs.write.option("compression", "gzip").option("ignoreNullFields", "false").json(folder)
    back = spark.read.schema(docs.schema).option("mode", "FAILFAST").json(folder)
    return back.select("doc_id", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


@query("""SELECT md5('c' || o_orderkey) AS hash, 'order|' || o_orderkey || ' of ' || o_custkey AS subject FROM orders WHERE o_orderdate::TIMESTAMP >= TIMESTAMP '1997-01-01' ORDER BY o_orderdate DESC, md5('c' || o_orderkey) LIMIT 500""")
def commit_log(spark, d):
    """[S26] A log written by a line an order, read back: the newest 500 since a day."""
    folder = _folder(spark, "log")
    at = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    line = F.concat_ws("|", F.md5(F.concat(F.lit("c"), "o_orderkey")), at, F.concat(F.lit("order|"), "o_orderkey", F.lit(" of "), "o_custkey"))
    table(spark, d, "orders").select(line.alias("value")).write.text(folder)
    return code.commit_log(spark, folder, "1997-01-01", 500).select("hash", "subject")


@query(f"""WITH {PY}, n AS (SELECT path, unnest(['C' || k, 'run', 'step' || j, 'make' || k]) AS name FROM p WHERE NOT b) SELECT path, name, name = 'make12' OR name = 'C7' AS exact FROM n WHERE name = 'make12' OR name = 'C7' OR lower(name) LIKE 'make1%' OR lower(name) LIKE 'c77%'""")
def symbol_search(spark, d):
    """[F6, F7, J1] Symbols by exact name or by how it begins, out of an index of their names, joined to their rows."""
    found = code.facts(pj.python_files(spark, d), "symbols")[0].select("path", "name", "type")
    symbols = found.filter("type != 'file' and name != 'broken'").select("path", "name").distinct()
    rows = cut(symbols.join(found.filter("name = 'broken'").select("path"), "path", "left_anti").withColumn("id", F.xxhash64("path", "name"))).hint("merge")
    index = Segments(spark, _folder(spark, "symbols"))
    index.update(rows, None, "id", "name")
    hits = index.matching(Or(Term("make12"), Term("C7"), Prefix("make1"), Prefix("C77")))
    exact = F.col("name").isin("make12", "C7")
    return rows.join(hits, "id").select("path", "name", exact.alias("exact"))


@query(f"""WITH {BM25}, j AS (SELECT doc_id, round(s, 6) AS score, source, lang FROM r JOIN documents USING (doc_id)), b AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY score DESC, doc_id) AS n FROM j)
SELECT doc_id, source, lang, score, row_number() OVER (ORDER BY score DESC, doc_id)::INTEGER AS rank FROM b WHERE n = 1 ORDER BY rank LIMIT 20""")
def ranked_results(spark, d):
    """[W13, U6] The best hit of each source and language, numbered without gaps."""
    from lodestone.operators import search
    from lodestone.operators.windows import latest_wins

    hits = _index(spark, d).bm25("the and ion").withColumn("score", F.round("score", 6))
    rows = hits.join(table(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id")
    best = latest_wins(rows, ["source", "lang"], F.desc("score"), F.col("doc_id"))
    return search.ranked(best, 20, "doc_id").select("doc_id", "source", "lang", "score", "rank")
