"""A term index: built once, so that no search reads the texts again.

Postings (term, id, times, words, terms) lie in Parquet, each file those of some
documents sorted by term, so that a search reads the pages of its own terms
only. Scores are those of the search over texts.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import tokens
from lodestone.session import dealt, shared_dir

#: Postings a file, about.
FILE_ROWS = 4_000_000


def query_terms(query: str) -> list[tuple[str, int]]:
    """The distinct terms of a query and how often each occurs, in order."""
    return sorted(Counter(w.lower() for w in re.findall("[A-Za-z0-9_]+", query)).items())


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, id, times, words, terms): how often a document has a term, how many words and how many different ones it has. Ids are unique; null ids and texts without a term have none."""
    toks = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("t"))
    # Counted before the terms become rows, not again for each of them.
    sized = toks.select("id", "t", F.size("t").alias("words"), F.size(F.array_distinct("t")).alias("terms"))
    rows = sized.select("id", "words", "terms", F.explode("t").alias("term"))
    return rows.groupBy("term", "id", "words", "terms").agg(F.count(F.lit(1)).alias("times"))


class TermIndex:
    """Postings and the corpus statistics (documents, mean words) in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.rows = spark.read.parquet(f"{folder}/postings")
        self.stats = spark.read.parquet(f"{folder}/stats")

    @classmethod
    def build(cls, docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> TermIndex:
        """Writes the index of ``docs`` to ``folder``: documents are dealt out once, and the postings of a part are sorted by term where they are made.

        A term is then in each file, in the pages that the file's statistics name; postings, many times as many as documents, are never shuffled.
        """
        spark = docs.sparkSession
        words = F.coalesce(F.size(tokens(F.coalesce(F.col(text_col), F.lit("")))), F.lit(0)).cast("double")
        docs.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(words).alias("mean")).write.parquet(f"{folder}/stats")
        rows = postings(dealt(docs, id_col), id_col, text_col)
        rows.sortWithinPartitions("term", "id").write.option("maxRecordsPerFile", FILE_ROWS).parquet(f"{folder}/postings")
        return cls(spark, folder)

    @classmethod
    def of(cls, docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> TermIndex:
        """The index of a table's files in the shared folder: built when first asked for, and again once the files at ``path`` change.

        It is put in place by a rename, so a build that fails or that another overtakes leaves nothing behind that counts.
        """
        spark = docs.sparkSession
        jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        source = jvm.org.apache.hadoop.fs.Path(path)
        store = source.getFileSystem(conf)
        about = store.getContentSummary(source)
        name = f"{path}|{about.getLength()}|{about.getFileCount()}|{store.getFileStatus(source).getModificationTime()}|{id_col}|{text_col}"
        folder = f"{shared_dir(spark).rstrip('/')}/term-index-{uuid.uuid5(uuid.NAMESPACE_URL, name).hex}"
        place = jvm.org.apache.hadoop.fs.Path(folder)
        fs = place.getFileSystem(conf)
        if not fs.exists(place):
            new = f"{folder}-{uuid.uuid4().hex}"
            cls.build(docs, new, id_col, text_col)
            if fs.exists(place) or not fs.rename(jvm.org.apache.hadoop.fs.Path(new), place):
                fs.delete(jvm.org.apache.hadoop.fs.Path(new), True)
        return cls(spark, folder)

    def _found(self, terms: list[str]) -> DataFrame:
        return self.rows.filter(F.col("term").isin(terms))

    def bm25(self, query: str, id_col: str = "doc_id", k1: float = 1.5, b: float = 0.75, all_of: tuple[str, ...] = ()) -> DataFrame:
        """Okapi BM25 of every document that holds a term of the query, and all of ``all_of``: (id, score). Repeated terms count as often as they occur."""
        reps = query_terms(query)
        found = self._found([w for w, _ in reps])
        times = [F.coalesce(F.sum(F.when(F.col("term") == w, F.col("times"))), F.lit(0)).cast("double").alias(f"tf{i}") for i, (w, _) in enumerate(reps)]
        rows = found.groupBy("id", "words").agg(*times)
        known = found.agg(*[F.count_if(F.col("term") == w).cast("double").alias(f"df{i}") for i, (w, _) in enumerate(reps)]).crossJoin(self.stats)
        score = F.lit(0.0)
        for i, (_, r) in enumerate(reps):
            tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
            idf = F.ln((F.col("n") - df + 0.5) / (df + 0.5) + 1.0)
            score = score + r * idf * tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * F.col("words").cast("double") / F.col("mean")))
        needed = [F.col(f"tf{i}") > 0 for i, (w, _) in enumerate(reps) if w in all_of]
        for c in needed:
            rows = rows.filter(c)
        return rows.crossJoin(F.broadcast(known)).select(F.col("id").alias(id_col), score.alias("score"))  # one row

    def overlap(self, query: str, floor: float, id_col: str = "doc_id") -> DataFrame:
        """(id, score): the share of a document's distinct terms that the query has, where it is at least ``floor``."""
        found = self._found([w for w, _ in query_terms(query)]).groupBy("id", "terms").agg(F.count(F.lit(1)).alias("n"))
        return found.select(F.col("id").alias(id_col), (F.col("n") / F.col("terms")).alias("score")).filter(F.col("score") >= floor)
