"""Conversations: pairing, repetition and corrections."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions import turns as tn
from lodestone.operators import mining
from lodestone.operators import windows as win
from lodestone.plans.base import query
from lodestone.plans.probes import pick, quoted
from lodestone.session import table

PAIRS = """r AS (SELECT * FROM conversations WHERE role IN ('user','assistant')), f AS (SELECT *, role = 'user' AND coalesce(lag(role) OVER w, '') <> 'user' AS first, first_value(CASE WHEN role = 'assistant' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT f.conv_id, f.turn AS user_turn, f.a AS assistant_turn, f.text AS user_text, b.text AS assistant_text FROM f JOIN conversations b ON f.conv_id = b.conv_id AND f.a = b.turn WHERE first)"""


@query(f"WITH {PAIRS} SELECT conv_id, user_turn, assistant_turn FROM p")
def turn_pairs(spark, d):
    """[W4, S24, L5] Each question with its answer."""
    return win.turn_pairs(table(spark, d, "conversations")).select("conv_id", "user_turn", "assistant_turn")


def _any(text: str, parts: tuple[str, ...], how: str = "contains") -> str:
    return "(" + " OR ".join(f"{how}({text}, {quoted(p)})" for p in parts) + ")"


def _classified(turns: str) -> str:
    """SQL for the kinds of corrections in the pairs of the table ``turns``: every rule on every pair."""
    strong = ("never", "always", "must", "should")
    return f"""{PAIRS.replace("conversations", turns)},
l AS (SELECT *, lower(user_text) AS lo, trim(lower(user_text)) AS tl, list_distinct(regexp_split_to_array(trim(lower(user_text)), '\\s+')) AS ws, row_number() OVER w AS n, lag(assistant_text) OVER w AS before, max(contains(lower(user_text), 'no')) OVER (PARTITION BY conv_id ORDER BY user_turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS nos FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY user_turn)),
a AS (SELECT y.conv_id, y.user_turn, count(*) AS alike FROM l x JOIN l y ON x.conv_id = y.conv_id AND x.user_turn < y.user_turn WHERE len(list_intersect(x.ws, y.ws))::DOUBLE / len(list_distinct(list_concat(x.ws, y.ws))) > 5e-1 GROUP BY ALL),
s AS (SELECT l.*, coalesce(alike, 0) AS alike, {_any("lo", strong)} AS strong,
NOT ends_with(tl, '?') AND NOT {_any("tl", tn.QUESTIONS, "starts_with")} AND ({_any("tl", tn.STARTERS, "starts_with")} OR (len(regexp_split_to_array(trim(user_text), '\\s+')) <= 8 AND len(list_intersect(ws, ['never', 'always', 'must'])) > 0)) AS cmd,
(contains(lo, '?') AND NOT {_any("lo", ("never", "always", "must", "ensure", "make sure"))}) OR {_any("lo", tn.CASUAL)} AS nothing,
coalesce({_any("before", tn.ACTIONS)}, false) AS acted, {_any("lo", tn.PREFERENCES)} AND NOT ends_with(tl, '?') AND NOT {_any("lo", tn.HYPOTHETICAL)} AS likes FROM l LEFT JOIN a USING (conv_id, user_turn)),
k AS (SELECT conv_id, user_turn, CASE WHEN nothing THEN NULL WHEN n >= 2 AND acted AND ({_any("lo", tn.CORRECTIONS)} OR (strong AND cmd)) THEN 1e0 WHEN n >= 3 AND {_any("lo", ("yes", "correct", "right", "exactly"))} AND strong AND nos THEN 95e-2 WHEN alike >= 2 THEN 8e-1 WHEN likes THEN 85e-2 WHEN {_any("lo", tn.COMMANDS)} AND cmd THEN 9e-1 END AS confidence FROM s)
SELECT conv_id, user_turn, CASE WHEN confidence IN (1e0, 95e-2) THEN 'rule' WHEN confidence = 8e-1 THEN 'style' WHEN confidence = 85e-2 THEN 'preference' WHEN confidence = 9e-1 THEN 'behavior' END AS kind, confidence FROM k"""


@query(f"WITH {_classified('conversations')}")
def turn_classifier(spark, d):
    """[L1-L4, W5-W7, X14, X15] Kinds of corrections in the texts as they are."""
    return tn.classify(win.turn_pairs(table(spark, d, "conversations"))).select("conv_id", "user_turn", "kind", "confidence")


#: What users and assistants say before their own texts in :func:`turn_kinds`, by conversation and turn.
SAID = ("Always add tests", "I prefer short names", "what is this?", "please never keep it long", "yes, you should never do that, correct", "actually use tabs", "don't worry about it", "if i want tabs, use them", "never use tabs", "make sure that it ends")
DONE = ("Created a file. ", "done. ", "I've seen it. ")
SPOKEN = f"""t AS (SELECT conv_id, turn, role, CASE role WHEN 'user' THEN list_extract([{", ".join(map(quoted, SAID))}], ((conv_id * 3 + turn) % {len(SAID)} + 1)::INTEGER) || CASE WHEN conv_id % 3 = 0 THEN '' ELSE ' ' || text END
WHEN 'assistant' THEN list_extract([{", ".join(map(quoted, DONE))}], ((conv_id + turn // 2) % {len(DONE)} + 1)::INTEGER) || text ELSE text END AS text FROM conversations UNION ALL SELECT -1 - conv_id, turn, role, CASE WHEN role = 'user' THEN 'keep names short here, ' || turn ELSE text END FROM conversations)"""


def _spoken(spark, d):
    c = table(spark, d, "conversations")
    said = pick(list(SAID), F.col("conv_id") * 3 + F.col("turn"))
    user = F.when(F.col("conv_id") % 3 == 0, said).otherwise(F.concat(said, F.lit(" "), "text"))
    done = F.concat(pick(list(DONE), F.col("conv_id") + F.expr("turn div 2")), "text")
    spoken = c.select("conv_id", "turn", "role", F.when(F.col("role") == "user", user).when(F.col("role") == "assistant", done).otherwise(F.col("text")).alias("text"))
    again = F.when(F.col("role") == "user", F.concat(F.lit("keep names short here, "), F.col("turn").cast("string"))).otherwise(F.col("text"))
    twins = c.select((-1 - F.col("conv_id")).alias("conv_id"), "turn", "role", again.alias("text"))
    return spoken.unionByName(twins)


@query(f"WITH {SPOKEN}, {_classified('t')}")
def turn_kinds(spark, d):
    """[L1-L4, W5, W6, X14, X15, F19] Kinds of corrections in conversations of which each user text begins with an English sentence, or is one; and in twins that repeat one."""
    return tn.classify(win.turn_pairs(_spoken(spark, d))).select("conv_id", "user_turn", "kind", "confidence")


@query("""SELECT conv_id, turn, array_to_string(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), '|') AS context FROM conversations WHERE role = 'user'""")
def last_texts(spark, d):
    """[W7] The last three texts of a user."""
    u = table(spark, d, "conversations").filter("role = 'user'")
    return win.last_texts(u, 3).select("conv_id", "turn", F.array_join("context", "|").alias("context"))


@query("""SELECT left(lower(text), 50) AS head, count(*)::BIGINT AS n FROM conversations GROUP BY 1 HAVING count(*) >= 2""")
def repeated_heads(spark, d):
    """[A24, U7] Repeated beginnings."""
    return table(spark, d, "conversations").groupBy(F.left(F.lower("text"), F.lit(50)).alias("head")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")


@query("""WITH u AS (SELECT conv_id, turn, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: lower(x))) AS w FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn AS t2, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: lower(x))) AS w2 FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn FROM u WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.conv_id = u.conv_id AND len(list_intersect(w, w2)) >= 3e-1 * len(w))""")
def unanswered(spark, d):
    """[J26, L20] Items of which too little is in any item of the other side: a fuzzy anti join within a conversation."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", F.array_distinct(tx.tokens(F.col("text"))).alias("w"))
    u, a = c.filter("role = 'user'").alias("u"), c.filter("role = 'assistant'").alias("a")
    enough = F.size(F.array_intersect("u.w", "a.w")) >= 0.3 * F.size("u.w")
    return u.join(a, (F.col("u.conv_id") == F.col("a.conv_id")) & enough, "left_anti").select("conv_id", "turn")


#: Character n-grams of 3 to 5 of the user's turns as TF-IDF vectors of length 1 (z), and the pairs of a conversation (g).
GRAMS = """u AS (SELECT conv_id, turn, lower(text) AS s FROM conversations WHERE role = 'user' AND text IS NOT NULL),
k AS (SELECT conv_id, turn, s, n, unnest(range(1, length(s) - n + 2)) AS i FROM u, (SELECT unnest([3, 4, 5]) AS n)), t AS (SELECT conv_id, turn, substr(s, i, n) AS t, count(*) AS n FROM k GROUP BY ALL),
f AS (SELECT conv_id, t, count(*) AS df FROM t GROUP BY ALL), d AS (SELECT conv_id, count(DISTINCT turn) AS docs FROM u GROUP BY 1),
v AS (SELECT conv_id, turn, t, (1e0 + ln(n)) * (ln((1e0 + docs) / (1e0 + df)) + 1e0) AS x FROM t JOIN f USING (conv_id, t) JOIN d USING (conv_id)), m AS (SELECT conv_id, turn, sqrt(sum(x * x)) AS norm FROM v GROUP BY ALL), z AS (SELECT conv_id, turn, t, x / norm AS x FROM v JOIN m USING (conv_id, turn)),
g AS (SELECT a.conv_id, a.turn AS a, b.turn AS b, sum(a.x * b.x) AS cosine FROM z a JOIN z b ON a.conv_id = b.conv_id AND a.t = b.t AND a.turn < b.turn GROUP BY ALL)"""
ALIKE = 0.15


def _alike(spark, d):
    u = table(spark, d, "conversations").filter("role = 'user' and text is not null")
    return u, mining.tfidf_over(u, "turn", mining.char_grams(F.col("text")), "conv_id", ALIKE)


@query(f"WITH {GRAMS} SELECT conv_id, a, b, round(cosine, 6) AS cosine FROM g WHERE cosine > {ALIKE}::DOUBLE")
def alike_turns(spark, d):
    """[R18, L6] Pairs of a conversation's user turns with a TF-IDF cosine of character 3- to 5-grams over a floor."""
    _, pairs = _alike(spark, d)
    return pairs.withColumn("cosine", F.round("cosine", 6))


@query(f"""WITH RECURSIVE {GRAMS}, n AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM u),
c(conv_id, i, seeds) AS (SELECT conv_id, 1::BIGINT, [turn] FROM n WHERE i = 1
UNION ALL SELECT n.conv_id, n.i, CASE WHEN EXISTS (SELECT 1 FROM g WHERE g.conv_id = n.conv_id AND g.b = n.turn AND list_contains(c.seeds, g.a) AND cosine > {ALIKE}::DOUBLE) THEN c.seeds ELSE list_append(c.seeds, n.turn) END FROM c JOIN n ON n.conv_id = c.conv_id AND n.i = c.i + 1)
SELECT n.conv_id, n.turn, CASE WHEN list_contains(c.seeds, n.turn) THEN n.turn ELSE (SELECT min(a) FROM g WHERE g.conv_id = n.conv_id AND g.b = n.turn AND list_contains(c.seeds, a) AND cosine > {ALIKE}::DOUBLE) END AS cluster FROM n JOIN c USING (conv_id, i)""")
def turn_clusters(spark, d):
    """[R21, L6] Clusters of a conversation's user turns: in order, a turn that no cluster has taken begins one and takes what resembles it."""
    u, pairs = _alike(spark, d)
    return mining.greedy_clusters(u, pairs, "turn", "conv_id", ALIKE)


@query(f"""WITH RECURSIVE {SPOKEN}, {GRAMS.replace("FROM conversations", "FROM t_").replace("u AS (", "t_ AS (SELECT * FROM t), u AS (", 1).replace(" t AS (SELECT conv_id, turn, substr", " tg AS (SELECT conv_id, turn, substr").replace("FROM t GROUP BY ALL), d AS", "FROM tg GROUP BY ALL), d AS").replace("FROM t JOIN f", "FROM tg JOIN f")}, n AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM u),
c(conv_id, i, seeds) AS (SELECT conv_id, 1::BIGINT, [turn] FROM n WHERE i = 1
UNION ALL SELECT n.conv_id, n.i, CASE WHEN EXISTS (SELECT 1 FROM g WHERE g.conv_id = n.conv_id AND g.b = n.turn AND list_contains(c.seeds, g.a) AND cosine > 45e-2) THEN c.seeds ELSE list_append(c.seeds, n.turn) END FROM c JOIN n ON n.conv_id = c.conv_id AND n.i = c.i + 1),
x AS (SELECT n.conv_id, n.turn, CASE WHEN list_contains(c.seeds, n.turn) THEN n.turn ELSE (SELECT min(a) FROM g WHERE g.conv_id = n.conv_id AND g.b = n.turn AND list_contains(c.seeds, a) AND cosine > 45e-2) END AS cluster FROM n JOIN c USING (conv_id, i)),
y AS (SELECT x.*, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s FROM x JOIN t USING (conv_id, turn) WHERE role = 'user'),
o AS (SELECT *, string_split(s, ' ') AS ws FROM y),
q AS (SELECT *, CASE WHEN lower(ws[1]) IN ({", ".join(map(quoted, mining.VARIANT_STARTS))}) THEN 0 ELSE 1 END AS verb, CASE WHEN len(ws) BETWEEN 5 AND 12 THEN 0 WHEN len(ws) BETWEEN 3 AND 15 THEN 1 ELSE 2 END AS size, -({" + ".join(f"contains(lower(text), {quoted(w)})::INT" for w in mining.VARIANT_WORDS)}) AS telling FROM o)
SELECT conv_id, cluster, first(text ORDER BY verb, size, telling, length(text), turn) AS canonical, count(*)::BIGINT AS frequency FROM q GROUP BY conv_id, cluster""")
def cluster_texts(spark, d):
    """[T11, Q41, R21, A23] Clusters of what users say (as in :func:`turn_kinds`) with the best variant of each."""
    u = _spoken(spark, d).filter("role = 'user' and text is not null")
    pairs = mining.tfidf_over(u, "turn", mining.char_grams(F.col("text")), "conv_id", 0.45)
    return mining.canonical(u, mining.greedy_clusters(u, pairs, "turn", "conv_id", 0.45), "turn", "conv_id", "text")


@query()
def batched_turns(spark, d):
    """[R22] Batches of a conversation's user turns: average linkage of their TF-IDF cosines down to three, or half as many as there are turns; up to three turns are one batch."""
    u = table(spark, d, "conversations").filter("role = 'user'")
    n = F.col("n")
    return mining.linkage(u, mining.tfidf_pairs(u, "turn", tx.tokens(F.col("text")), "conv_id"), "turn", "conv_id", F.when(n <= 3, 1).otherwise(F.least(F.lit(3), F.floor(n / 2))))
