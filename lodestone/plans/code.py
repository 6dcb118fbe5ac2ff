"""Code-intelligence composites, with the driver's tables standing in for code facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import paths as ph
from lodestone.operators import codeintel as ci
from lodestone.operators import mining
from lodestone.plans.base import query
from lodestone.session import table

#: Pages' URLs without scheme and query as paths of files.
PATHS = "f AS (SELECT page_id, regexp_extract(url, '://([^?#]*)', 1) AS p FROM pages)"


def _paths(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "://([^?#]*)", 1).alias("p"))


@query(f"WITH {PATHS} SELECT page_id, regexp_extract(p, '([^/]*?)(?:\\.[^./]*)?$', 1) AS stem, replace(regexp_replace(regexp_replace(p, '\\.[A-Za-z]+$', ''), '^/+|/+$', '', 'g'), '/', '.') AS module, array_to_string(string_split(p, '/')[greatest(1, len(string_split(p, '/')) - 2):], '/') AS tail, regexp_matches(p, '^(?:.*/)?en/[^/]*\\.html$') AS in_scope FROM f")
def path_parts(spark, d):
    """[H1-H3, H5, H6, F12] Parts of paths."""
    p = F.col("p")
    return _paths(spark, d).select("page_id", ph.stem(p).alias("stem"), ph.module(p).alias("module"), ph.tail(p).alias("tail"), p.rlike(ph.glob("**/en/*.html")).alias("in_scope"))


@query(f"WITH {PATHS} SELECT page_id, CASE WHEN string_split(p, '.')[1] IN ('www', 'm') THEN 'internal' WHEN string_split(p, '.')[1] IN ('io', 'os') THEN 'stdlib' ELSE 'external' END AS kind FROM f")
def dependency_class(spark, d):
    """[H4, Q25] Internal, standard or external."""
    return _paths(spark, d).select("page_id", ph.dependency(F.split("p", "\\.")[0], ("www", "m")).alias("kind"))


@query(f"""WITH {PATHS}, s AS (SELECT page_id, p, string_split(p, '/')[2] AS lang, CASE WHEN p LIKE 'www.%' THEN 100 ELSE 0 END + greatest(0, 50 - len(string_split(p, '/'))) + CASE WHEN lower(regexp_extract(p, '([^/]*?)(?:\\.[^./]*)?$', 1)) = 'example' THEN 30 ELSE 0 END + CASE WHEN regexp_matches(p, '(?:^|/)(?:src|lib|pkg|internal)/') THEN 20 ELSE 0 END AS score FROM f)
SELECT DISTINCT ON (lang) lang, page_id, score FROM s ORDER BY lang, score DESC, page_id""")
def homonym_ranking(spark, d):
    """[T9] The likeliest of the files that have a name."""
    s = _paths(spark, d).withColumn("lang", F.split("p", "/")[1]).withColumn("score", ph.homonym_score(F.col("p"), F.lit("example"), F.lit("www.")))
    best = s.groupBy("lang").agg(F.max_by(F.struct("page_id", "score"), F.struct("score", -F.col("page_id"))).alias("b"))
    return best.select("lang", "b.page_id", "b.score")


@query("""WITH r AS (SELECT s_suppkey AS k, s_suppkey * 3 AS s, s_suppkey * 3 + 40 AS e FROM supplier), l AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS line, l_returnflag = 'N' AS x FROM lineitem WHERE l_returnflag <> 'A'),
g AS (SELECT r.k, count(line) FILTER (x) AS c, count(line) AS t FROM r LEFT JOIN l ON r.k = l.k AND line BETWEEN s AND e GROUP BY 1)
SELECT k AS s_suppkey, c::BIGINT AS covered, t::BIGINT AS total, CASE WHEN t > 0 THEN round(1e2 * c / t, 2) ELSE 1e2 END AS percent FROM g""")
def coverage_overlay(spark, d):
    """[J35, B6, S30] Executed lines in ranges."""
    r = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") * 3).alias("start"), (F.col("s_suppkey") * 3 + 40).alias("end"))
    li = table(spark, d, "lineitem").filter("l_returnflag <> 'A'")
    lines = li.select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_partkey").alias("line"), (F.col("l_returnflag") == "N").alias("executed")).distinct()
    return ci.coverage(r, lines, "s_suppkey", "s_suppkey")


@query("""WITH s AS (SELECT p_partkey AS k, p_brand AS home, (p_size % 10) / 1e1 AS st FROM part), r AS (SELECT l_partkey AS k, 'Brand#' || (l_suppkey % 25 + 1) AS file FROM lineitem), o AS (SELECT s.k, count(*) AS n FROM s JOIN r USING (k) WHERE file <> home GROUP BY 1)
SELECT s.k AS p_partkey, coalesce(n, 0)::BIGINT AS outside, CASE WHEN coalesce(n, 0) = 0 THEN 'allow' WHEN st >= 75e-2 THEN 'block' ELSE 'warn' END AS verdict FROM s LEFT JOIN o USING (k)""")
def symbol_guard(spark, d):
    """[C17, J33] May a symbol be changed, by who else uses it."""
    s = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("home"), ((F.col("p_size") % 10) / 10.0).alias("st"))
    r = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.concat(F.lit("Brand#"), F.col("l_suppkey") % 25 + 1).alias("file"))
    return ci.guard(s, r, "p_partkey", "home", "st")


@query("""WITH e AS (SELECT DISTINCT l_suppkey s, l_partkey p, l_returnflag f FROM lineitem), u AS (SELECT s, p AS target, 'caller' AS reason, 1e0 AS c FROM e WHERE f = 'R' UNION ALL SELECT s, p, 'test', 95e-2 FROM e WHERE f = 'N' UNION ALL SELECT s, p, 'weak', 4e-1 FROM e WHERE f = 'A'),
b AS (SELECT *, row_number() OVER (PARTITION BY s, target ORDER BY c DESC, reason) r FROM u WHERE c >= 5e-1), t AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY c DESC, target) n FROM b WHERE r = 1) SELECT s AS suppkey, target, reason, c AS confidence FROM t WHERE n <= 5""")
def related_changes(spark, d):
    """[C15, W17, Q51] What else a change is likely to touch."""
    li = table(spark, d, "lineitem")
    part = lambda f: li.filter(f"l_returnflag = '{f}'").select(F.col("l_suppkey").alias("suppkey"), F.col("l_partkey").alias("target"))
    return ci.related([(part("R"), "caller", 1.0), (part("N"), "test", 0.95), (part("A"), "weak", 0.4)], "suppkey").select("suppkey", "target", "reason", "confidence")


@query("""WITH n AS (SELECT l_suppkey AS src, l_returnflag || l_linenumber AS target, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) >= 3), t AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, target) r FROM n), z AS (SELECT l_returnflag || l_linenumber AS target, count(DISTINCT l_shipdate::DATE) % 30 AS symbols FROM lineitem GROUP BY 1),
u AS (SELECT src, t.target, n, symbols * 40 AS tokens, sum(symbols * 40) OVER (PARTITION BY src ORDER BY n DESC, t.target ROWS UNBOUNDED PRECEDING) AS u FROM t JOIN z ON t.target = z.target WHERE r <= 5) SELECT src, target, n::BIGINT AS n, tokens::BIGINT AS tokens FROM u WHERE u <= 2000""")
def hydration(spark, d):
    """[W11, B9, A22] Much-used targets within a budget."""
    li = table(spark, d, "lineitem").withColumn("target", F.concat("l_returnflag", "l_linenumber"))
    sizes = li.groupBy("target").agg((F.count_distinct(F.to_date("l_shipdate")) % 30).alias("symbols"))
    return ci.hydration(li.select(F.col("l_suppkey").alias("src"), "target"), sizes)


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS r, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents), w AS (SELECT doc_id, n, r, concat_ws(chr(10), lag(r) OVER o, r, lead(r) OVER o) AS snippet FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY n)),
h AS (SELECT doc_id, 'long' AS rule, n, snippet FROM w WHERE regexp_matches(r, '^.{400}') UNION ALL SELECT doc_id, 'mark', n, snippet FROM w WHERE regexp_matches(r, '[#%]')) SELECT doc_id, rule, n::INT AS line, snippet FROM h ORDER BY doc_id, n, rule LIMIT 30""")
def pattern_violations(spark, d):
    """[C3, Q8] Lines that break a rule, with the lines around; a report of the first thirty."""
    return ci.violations(table(spark, d, "documents"), {"long": "^.{400}", "mark": "[#%]"}, "doc_id", "text", 30)


@query("""SELECT page_id, array_to_string(list_filter([CASE WHEN CASE WHEN regexp_matches(html, '(?i)\\brequests?\\.|fetch\\(|http') THEN 4e-1 ELSE 0 END + CASE WHEN regexp_matches(html, '(?i)\\b(?:get|post|put|delete)\\(') THEN 3e-1 ELSE 0 END > 4e-1 THEN 'http' END, CASE WHEN regexp_matches(html, '\\b(?:try|except|catch|raise|throw)\\b') THEN 'errors' END,
CASE WHEN CASE WHEN regexp_matches(html, '(?i)\\bselect\\b.+\\bfrom\\b|\\binsert into\\b') THEN 4e-1 ELSE 0 END + CASE WHEN regexp_matches(html, '(?i)cursor|session|connection') THEN 3e-1 ELSE 0 END > 4e-1 THEN 'database' END, CASE WHEN CASE WHEN regexp_matches(html, '\\bopen\\(|Path\\(') THEN 4e-1 ELSE 0 END + CASE WHEN regexp_matches(html, '\\.(?:read|write)\\(') THEN 2e-1 ELSE 0 END > 3e-1 THEN 'files' END,
CASE WHEN regexp_matches(html, '\\basync\\b|\\bawait\\b') THEN 'async' END, CASE WHEN regexp_matches(html, '(?i)\\blog(?:ger|ging)?\\.') THEN 'logging' END, CASE WHEN regexp_matches(html, '(?i)valid|assert\\b|isinstance\\(') THEN 'validation' END], lambda x: x IS NOT NULL), ',') AS behaviors FROM pages""")
def behavior_search(spark, d):
    """[C7, C8] What sources do, by patterns."""
    return table(spark, d, "pages").select("page_id", F.array_join(ci.behaviors(F.col("html")), ",").alias("behaviors"))


@query("""WITH u AS (SELECT conv_id, turn, list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: lower(x)) AS w FROM conversations WHERE role = 'user'), t AS (SELECT conv_id, turn, w AS t, count(*) n FROM (SELECT conv_id, turn, unnest(w) AS w FROM u) GROUP BY ALL), f AS (SELECT conv_id, t, count(*) df FROM t GROUP BY ALL), d AS (SELECT conv_id, count(DISTINCT turn) docs FROM u GROUP BY 1),
v AS (SELECT conv_id, turn, t, (1e0 + ln(n)) * (ln((1e0 + docs) / (1e0 + df)) + 1e0) AS x FROM t JOIN f USING (conv_id, t) JOIN d USING (conv_id)), m AS (SELECT conv_id, turn, sqrt(sum(x * x)) AS norm FROM v GROUP BY ALL), z AS (SELECT conv_id, turn, t, x / norm AS x FROM v JOIN m USING (conv_id, turn))
SELECT a.conv_id, a.turn AS a, b.turn AS b, round(sum(a.x * b.x), 6) AS cosine FROM z a JOIN z b ON a.conv_id = b.conv_id AND a.t = b.t AND a.turn < b.turn GROUP BY ALL""")
def tfidf_similarity(spark, d):
    """[R19, R20, J28] TF-IDF cosines of the turns of a conversation."""
    from lodestone.functions.text import tokens

    u = table(spark, d, "conversations").filter("role = 'user'")
    return mining.tfidf_pairs(u, "turn", tokens(F.col("text")), "conv_id").withColumn("cosine", F.round("cosine", 6))


@query("SELECT lang, count(*)::BIGINT AS files, count(*) FILTER (regexp_matches(text, '(?i)license'))::BIGINT AS licensed, CASE WHEN count(*) FILTER (regexp_matches(text, '(?i)token')) * 100 > count(*) THEN 'service' ELSE 'library' END AS kind FROM documents GROUP BY 1")
def project_summary(spark, d):
    """[C9, A30] Languages, and what their texts mention."""
    t = F.col("text")
    return table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("files"), F.count_if(t.rlike("(?i)license")).alias("licensed"), F.when(F.count_if(t.rlike("(?i)token")) * 100 > F.count(F.lit(1)), "service").otherwise("library").alias("kind"))
