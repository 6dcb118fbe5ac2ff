"""The queries of this subpackage, each over its whole table, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import ann, langid, mixing, negatives, packing, pii, repetition, sentencepiece, simhash, spelling, toxicity, url_filter, warc
from lodestone.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if it has any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query()
def op1_sentencepiece(spark, d):
    """Ids of every document and the text that they give back."""
    return sentencepiece.round_trip(table(spark, d, "documents"), sentencepiece.load(spark))


@query("""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
p AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
g AS (SELECT rid, pos, lead(word, 2) OVER o AS w3, lead(word, 4) OVER o AS w5,
      concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o) AS s3,
      concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS s5
      FROM p WINDOW o AS (PARTITION BY rid ORDER BY pos)),
r3 AS (SELECT rid, pos FROM (SELECT rid, pos, count(*) OVER (PARTITION BY rid, s3) AS c FROM g WHERE w3 IS NOT NULL) WHERE c > 1),
r5 AS (SELECT rid, pos FROM (SELECT rid, pos, count(*) OVER (PARTITION BY rid, s5) AS c FROM g WHERE w5 IS NOT NULL) WHERE c > 1),
c3 AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest([pos, pos + 1, pos + 2]) AS q FROM r3) GROUP BY rid),
c5 AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest([pos, pos + 1, pos + 2, pos + 3, pos + 4]) AS q FROM r5) GROUP BY rid),
l AS (SELECT DISTINCT rid FROM (SELECT rid, md5(array_to_string(ws[pos : pos + 60], ' ')) AS h FROM r5 JOIN w USING (rid) WHERE pos + 60 <= len(ws)) GROUP BY rid, h HAVING count(*) > 1),
n AS (SELECT w.rid, doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
      len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
      coalesce(c3.n, 0)::BIGINT AS n_repeat_words, coalesce(c5.n, 0)::BIGINT AS covered_words, l.rid IS NOT NULL AS long_one
      FROM w LEFT JOIN c3 ON w.rid = c3.rid LEFT JOIN c5 ON w.rid = c5.rid LEFT JOIN l ON w.rid = l.rid),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM n)
SELECT doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND covered_words <= 0.3::DOUBLE * n_words AND NOT long_one AS kept, covered_words FROM f""")
def op2_repetition(spark, d):
    """Repetition inside every document, and whether it is kept."""
    got = repetition.rules(table(spark, d, "documents"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words")


@query()
def op7_simhash(spark, d):
    """Fingerprint and near-duplicate component of every document."""
    got = simhash.classes(table(spark, d, "documents"))
    return got.select("doc_id", simhash.hex16("fp").alias("fingerprint"), "component_id")


@query()
def op10_langid(spark, d):
    """Language of every document by the nearest centroid."""
    return langid.learn_and_identify(table(spark, d, "documents"))


@query()
def op5_toxicity(spark, d):
    """Toxicity score of every document by a factorization machine."""
    return toxicity.learn_and_score(table(spark, d, "documents"), table(spark, d, "labels"))


@query()
def op9_ann(spark, d):
    """The 20 nearest of every query vector, among all others."""
    return ann.search(table(spark, d, "embeddings"), F.col("vec_id") % 20 == 0)


@query("""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, octet_length(encode(h))::BIGINT AS b, sha1(h) AS s FROM p),
r AS (SELECT *, b >= 1000 AND page_id < max(page_id) OVER (PARTITION BY s) AS again, max(page_id) OVER (PARTITION BY s) AS last FROM q)
SELECT page_id, b AS payload_bytes, s AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN last END AS refers_to, true AS verified FROM r""")
def op8_warc(spark, d):
    """Every page written to WARC archives and read back."""
    return warc.through_archives(table(spark, d, "pages"))


@query()
def op4_url_filter(spark, d):
    """Verdict on every page's URL."""
    return url_filter.judge(table(spark, d, "pages"), coverage=url_filter.COVERAGE)


@query()
def op3_mixing(spark, d):
    """Words that the mix of all sources takes of every document."""
    return mixing.counts(table(spark, d, "documents"))


@query()
def op6_pii(spark, d):
    """Personal data in every document."""
    return pii.digest(table(spark, d, "documents"))


@query()
def op11_best_fit_packing(spark, d):
    """Every document's pieces and their places in sequences of 2048 tokens."""
    import public_tokenizers

    return packing.packed(table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("""
WITH r AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.rid AS anchor, a.vec_id AS anchor_id, b.rid, b.vec_id, a.label = b.label AS same, coalesce(list_inner_product(a.v, b.v), 0)::BIGINT AS score
FROM r a JOIN r b ON a.rid <> b.rid AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, rid) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, (row_number() OVER w)::INTEGER AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor = s.anchor AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
WINDOW w AS (PARTITION BY p.anchor, p.rid ORDER BY s.score DESC, s.vec_id, s.rid) QUALIFY row_number() OVER w <= 3""")
def op12_hard_negatives(spark, d):
    """The hardest negatives in the window of each positive of every anchor."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(negatives.rows(table(spark, d, "embeddings"), label=label), F.col("vec_id") % 50 == 0)


@query("""
WITH RECURSIVE tbl AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM range(256) r(i))),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{7,}')) AS w FROM documents),
c AS (SELECT w, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS x FROM r GROUP BY doc_id, w),
h AS (SELECT w, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(x), 2), lambda i: ((strpos('0123456789ABCDEF', substr(x, i, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(x, i + 1, 1)) - 1)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS h FROM c, tbl),
d AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM d WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
k AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
e AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS s FROM k),
p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM e a JOIN e b ON a.s = b.s AND a.i = b.i AND a.word <> b.word
  UNION SELECT e.word, v.word, v.n FROM e JOIN v ON e.s = v.word UNION SELECT v.word, e.word, e.n FROM e JOIN v ON e.s = v.word),
b AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, encode(near)) AS near, max(near_n) AS near_n FROM p GROUP BY 1),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * v.n THEN near END AS form, CASE WHEN near_n >= 10 * v.n THEN near_n END AS form_n FROM v LEFT JOIN b USING (word)),
g AS (SELECT word, coalesce(form, word) AS root, form IS NOT NULL AS more FROM f UNION ALL SELECT g.word, f.form, true FROM g JOIN f ON g.root = f.word WHERE g.more AND f.form IS NOT NULL),
z AS (SELECT g.word, g.root FROM g JOIN f ON g.root = f.word WHERE f.form IS NULL)
SELECT f.word, form, z.root, n, n_near, form_n FROM f JOIN z USING (word)""")
def op13_spelling(spark, d):
    """Spelling variants of every word of all documents, and the form that each leads to."""
    return spelling.variants(spelling.words(table(spark, d, "documents")))


@query("""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS size, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS i FROM d GROUP BY 1),
w AS (SELECT *, 2e0 * size AS cap, list_extract([3e0, 1e0, 2e0], ((i - 1) % 3 + 1)::INTEGER)::DOUBLE AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, i) AS n FROM w),
l AS (SELECT *, ((SELECT 15e-1 * sum(size) FROM w) - coalesce(sum(cap) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0)) / sum(weight) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM o),
f AS (SELECT arg_min(share, n) FILTER (share * weight <= cap) AS share FROM l)
SELECT doc_id, d.size, l.size AS source_size, round(least(cap, coalesce(f.share, 1e300) * weight), 6) AS target FROM d JOIN l ON d.source IS NOT DISTINCT FROM l.source, f""")
def mixing_targets(spark, d):
    """Of op3: every document's words, its source's, and what the mix is to take of that."""
    got = mixing.counts(table(spark, d, "documents"))
    return got.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))


@query("""
WITH p AS (SELECT page_id, coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) t(rh, rp, rv)),
m AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS verdict FROM h JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY 1)
SELECT h.page_id, host, path, rule, verdict FROM h LEFT JOIN m USING (page_id)""")
def url_rules(spark, d):
    """Of op4: every page's host and path and the verdict of the explicit rules; null where the mined ones decide."""
    got = url_filter.judge(table(spark, d, "pages"), coverage=url_filter.COVERAGE)
    return got.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("verdict"))


@query("""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
c AS (SELECT rid, regexp_replace(unnest(regexp_extract_all(t, '[0-9](?:[\\x20-]?[0-9])+')), '[^0-9]', '', 'g') AS n FROM d),
k AS (SELECT rid, count(*) AS cards FROM c WHERE length(n) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length(n) + 1), lambda i: CASE WHEN (length(n) - i) % 2 = 0 THEN substr(n, i, 1)::INT ELSE (2 * substr(n, i, 1)::INT) // 10 + (2 * substr(n, i, 1)::INT) % 10 END)) % 10 = 0 GROUP BY 1)
SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+'))::BIGINT AS n_email,
len(list_filter(regexp_extract_all(t, '[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+'), lambda x: list_max(list_transform(string_split(x, '.'), lambda y: y::HUGEINT)) <= 255))::BIGINT AS n_ip, coalesce(cards, 0)::BIGINT AS n_card,
len(list_filter(regexp_extract_all(t, '\\+[0-9][\\x20().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 8 AND 15))::BIGINT AS n_phone FROM d LEFT JOIN k USING (rid)""")
def pii_counts(spark, d):
    """Of op6: every document's spans of the base forms, by kind."""
    return pii.digest(table(spark, d, "documents")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")
