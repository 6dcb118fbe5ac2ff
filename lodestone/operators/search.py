"""Keyword, vector and hybrid retrieval over DataFrames."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import tokens


def bm25_scores(docs: DataFrame, query: str, k1: float = 1.5, b: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Okapi BM25 of every document that holds a query term: (id, score).

    Repeated query terms count as often as they occur. Term counts are taken
    per document row with array functions, so nothing is exploded and only the
    corpus statistics (one row) are shuffled.
    """
    words = [w.lower() for w in re.findall("[A-Za-z0-9_]+", query)]
    reps = sorted(Counter(words).items())
    toks = docs.select(F.col(id_col).alias("_id"), tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("_t"))
    counted = toks.select(
        "_id",
        F.size("_t").cast("double").alias("_dl"),
        *[_times("_t", w).alias(f"_tf{i}") for i, (w, _) in enumerate(reps)],
    )
    stats = counted.agg(
        F.count(F.lit(1)).cast("double").alias("_n"),
        F.avg("_dl").alias("_avg"),
        *[F.sum((F.col(f"_tf{i}") > 0).cast("double")).alias(f"_df{i}") for i in range(len(reps))],
    )
    score = F.lit(0.0)
    hit = F.lit(False)
    for i, (_, r) in enumerate(reps):
        tf, df = F.col(f"_tf{i}"), F.col(f"_df{i}")
        idf = F.ln((F.col("_n") - df + 0.5) / (df + 0.5) + 1.0)
        score = score + r * idf * tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * F.col("_dl") / F.col("_avg")))
        hit = hit | (tf > 0)
    return counted.filter(hit).crossJoin(F.broadcast(stats)).select(F.col("_id").alias(id_col), score.alias("score"))


def bm25_terms(rows: DataFrame, terms: list[str], id_col: str, terms_col: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(id, score): BM25 of rows that hold arrays of terms (stems, grams), where they hold one of ``terms``; a null array holds none."""
    words = sorted(set(terms))
    counted = rows.select(id_col, F.coalesce(F.size(terms_col), F.lit(0)).cast("double").alias("_dl"), *[F.coalesce(_times(terms_col, w), F.lit(0.0)).alias(f"_tf{i}") for i, w in enumerate(words)])
    stats = counted.agg(F.count(F.lit(1)).cast("double").alias("_n"), F.avg("_dl").alias("_avg"), *[F.sum((F.col(f"_tf{i}") > 0).cast("double")).alias(f"_df{i}") for i in range(len(words))])
    score = F.lit(0.0)
    for i in range(len(words)):
        tf, df = F.col(f"_tf{i}"), F.col(f"_df{i}")
        score = score + F.ln((F.col("_n") - df + 0.5) / (df + 0.5) + 1.0) * tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * F.col("_dl") / F.col("_avg")))
    hit = sum((F.col(f"_tf{i}") for i in range(len(words))), F.lit(0.0)) > 0
    return counted.filter(hit).crossJoin(F.broadcast(stats)).select(id_col, score.alias("score"))  # one row of statistics


def _times(col: str, word: str) -> Column:
    """How often ``word`` is in an array column."""
    return F.size(F.filter(col, lambda x: x == word)).cast("double")


def dot(a, b) -> Column:
    """Inner product of two numeric arrays, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, z: s + z)


def cosine_scores(vectors: DataFrame, query: list[float], floor: float = -1.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, score): cosines with ``query``, at least ``floor``, in no order. Zero and null vectors score null and drop out."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.col(vector_col)
    score = dot(v, q) / (F.sqrt(dot(v, v)) * F.sqrt(dot(q, q)))
    return vectors.select(id_col, score.alias("score")).filter(F.col("score") >= floor)


def cosine_topk(vectors: DataFrame, query: list[float], k: int = 10, floor: float = -1.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, score): the ``k`` vectors of largest cosine with ``query``, at least ``floor``; ties by id."""
    return cosine_scores(vectors, query, floor, id_col, vector_col).orderBy(F.desc("score"), id_col).limit(k)


def ranked(df: DataFrame, k: int, id_col: str) -> DataFrame:
    """(id, score, rank) of the best ``k``; the numbering runs over at most k rows."""
    top = df.orderBy(F.desc("score"), id_col).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_col)))


def rrf(keyword: DataFrame, vector: DataFrame, id_col: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists: (id, score, match_type)."""
    both = _outer(keyword, vector, id_col)
    score = F.coalesce(1.0 / (k + F.col("k_rank")), F.lit(0.0)) + F.coalesce(1.0 / (k + F.col("v_rank")), F.lit(0.0))
    return both.select(id_col, score.alias("score"), _match_type())


def weighted(keyword: DataFrame, vector: DataFrame, id_col: str, keyword_weight: float = 0.5, vector_weight: float = 0.5) -> DataFrame:
    """Weighted sum of two lists' scores: (id, score, match_type)."""
    both = _outer(keyword, vector, id_col)
    score = keyword_weight * F.coalesce("k_score", F.lit(0.0)) + vector_weight * F.coalesce("v_score", F.lit(0.0))
    return both.select(id_col, score.alias("score"), _match_type())


def _outer(keyword: DataFrame, vector: DataFrame, id_col: str) -> DataFrame:
    a = keyword.select(id_col, F.col("score").alias("k_score"), F.col("rank").alias("k_rank"))
    b = vector.select(id_col, F.col("score").alias("v_score"), F.col("rank").alias("v_rank"))
    return a.join(b, id_col, "full_outer")


def _match_type() -> Column:
    return F.when(F.col("k_rank").isNull(), "semantic").when(F.col("v_rank").isNull(), "keyword").otherwise("both").alias("match_type")


def clipped(df: DataFrame) -> DataFrame:
    """BM25 scores on the scale of cosines: a tenth, at most 1."""
    return df.withColumn("score", F.least(F.col("score") / 10.0, F.lit(1.0)))


def hybrid(keyword: DataFrame, vector: DataFrame | None, id_col: str, query: str, mode: str = "auto", per_list: int = 20, k: int = 10, fusion: str = "rrf", weights: tuple[float, float] | None = None) -> DataFrame:
    """Hybrid search over scored candidates: (id, score, match_type), best ``k``.

    ``mode``: keyword, semantic, balanced or auto. Auto picks the weights of a
    weighted fusion by the kind of query. Without vectors the keyword list
    alone answers, marked ``keyword_fallback``.
    """
    best_keyword = ranked(clipped(keyword), per_list, id_col)
    if vector is None:
        return best_keyword.select(id_col, "score", F.lit("keyword_fallback").alias("match_type")).orderBy(F.desc("score"), id_col).limit(k)
    best_vector = ranked(vector, per_list, id_col)
    if mode == "keyword":
        out = best_keyword.select(id_col, "score", F.lit("keyword").alias("match_type"))
    elif mode == "semantic":
        out = best_vector.select(id_col, "score", F.lit("semantic").alias("match_type"))
    elif fusion == "rrf":
        out = rrf(best_keyword, best_vector, id_col)
    else:
        if weights is None:
            weights = (0.5, 0.5) if mode == "balanced" else ((0.7, 0.3) if kind_of_query(query) == "keyword" else (0.3, 0.7))
        out = weighted(best_keyword, best_vector, id_col, *weights)
    return out.orderBy(F.desc("score"), id_col).limit(k)


#: Words that make a query a natural-language one.
NATURAL = ("what", "how", "where", "when", "why", "which", "who", "find", "show", "get", "list", "all", "that", "the", "a", "an")


def query_kind(q: Column) -> Column:
    """``keyword`` for identifiers and up to three words without natural-language words, else ``semantic``."""
    words = F.split(F.trim(q), "\\s+")
    natural = F.exists(words, lambda w: F.lower(w).isin(*NATURAL))
    identifier = q.rlike("^[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)+$") | q.rlike("^[a-z0-9]+(?:_[a-z0-9]+)+$") | q.rlike("^[A-Z][A-Z0-9_]+$")
    return F.when(identifier, "keyword").when(natural, "semantic").when(F.size(words) <= 3, "keyword").otherwise("semantic")


def kind_of_query(q: str) -> str:
    """:func:`query_kind` of one string, for plan time."""
    if re.fullmatch("[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)+|[a-z0-9]+(?:_[a-z0-9]+)+|[A-Z][A-Z0-9_]+", q):
        return "keyword"
    words = q.split()
    return "semantic" if any(w.lower() in NATURAL for w in words) or len(words) > 3 else "keyword"


def token_overlap(docs: DataFrame, query: str, floor: float = 0.2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): the share of a document's distinct tokens that the query has, where it is at least ``floor``; texts without tokens have none."""
    q = F.array(*[F.lit(w) for w in sorted({w.lower() for w in re.findall("[A-Za-z0-9_]+", query)})])
    t = F.array_distinct(tokens(F.col(text_col)))
    return docs.select(id_col, F.try_divide(F.size(F.array_intersect(t, q)), F.size(t)).alias("score")).filter(F.col("score") >= floor)
