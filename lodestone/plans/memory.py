"""Queries over memories, modes, proposals, observations, conflicts and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import memories as mm
from lodestone.functions import rules as ru
from lodestone.functions import scores as sc
from lodestone.functions import text as tx
from lodestone.operators import mining
from lodestone.operators import sessions as ss
from lodestone.plans.base import query
from lodestone.plans.probes import expected, parts, pick
from lodestone.session import table

RULES = [
    ("Don't use globals in m#", "behavior", "Avoid use globals in m#", "universal", "correction"),
    ("you should always write tests for m#", "rule", "Always write tests for m#", "universal", "rule"),
    ("keep the pip cache of m#", "preference", "Keep the pip cache of m#", "language:python", "preference"),
    ("long functions like f# is bad", "style", "Avoid long functions like f#", "language:javascript", "preference"),
    ("goroutine leaks in our service #", "behavior", "Goroutine leaks in our service #", "language:go", "rule"),
    ("I want short names here #", "preference", "Short names here #", "project:p", "preference"),
    ("be terse in answers #", "style", "Keep output terse in answers #", "universal", "preference"),
    ("make sure to log every error of e#", "style", "Make sure to log every error of e#", "universal", "preference"),
    ("a b c d e f g h i j k l m n o p q r s t u v #", "rule", "A b c d e f g h i j k l m n o p q r s t...", "universal", "rule"),
]


@query(f"""WITH {expected([r[2:] for r in RULES], "content, scope, category")} SELECT k, content, scope, category, CASE WHEN k % 4 = 3 THEN 'Corrected 3 times' WHEN k % 4 = 2 THEN 'Corrected twice' WHEN k % 5 = 4 THEN 'Clear instruction' ELSE 'Inferred from a session' END AS rationale FROM x""")
def memory_rules(spark, d):
    """[X10-X13, L7] Corrections as rules: rewritten, with scope, category and why."""
    rows = parts(spark, d, text=[r[0] for r in RULES], kind=[r[1] for r in RULES])
    text, k = F.col("text"), F.col("k")
    why = mm.rationale((k % 4).cast("int"), F.when(k % 5 == 4, 0.95).otherwise(0.6))
    return rows.select("k", mm.imperative(text).alias("content"), mm.scope(text, "p").alias("scope"), mm.category(text, F.col("kind")).alias("category"), why.alias("rationale"))


MODES = [
    ("quick hack to try idea #", "prototype", 1.0),
    ("deploy the release # to production", "production", 1.0),
    ("urgent bug in f#, fix it now", "hotfix", 1.0),
    ("refactor f# with no new features", "refactor", 0.45),
    ("explain what does f# mean", "audit", 0.6),
    ("where is f# in the codebase", "exploration", 0.45),
    ("say hello to #", "prototype", 0.0),
]


@query(f"""WITH {expected([r[1:] for r in MODES], "mode, score")} SELECT k, mode, round(score + CASE WHEN score < 1 AND ((mode = 'audit' AND k % 3 = 0) OR (mode = 'exploration' AND k % 3 = 1) OR (mode = 'prototype' AND k % 3 = 2)) THEN 6e-2 ELSE 0 END, 6) AS score FROM (
SELECT k, CASE WHEN mode = 'prototype' AND score = 0 THEN CASE k % 3 WHEN 0 THEN 'audit' WHEN 1 THEN 'exploration' ELSE 'prototype' END ELSE mode END AS mode, score FROM x)""")
def mode_detection(spark, d):
    """[M18, Q40] The mode of a prompt by its words, its scope, its urgency and the tools used before it."""
    rows = parts(spark, d, text=[r[0] for r in MODES])
    tools = F.when(F.col("k") % 3 == 0, F.array(F.lit("Read"))).when(F.col("k") % 3 == 1, F.array(F.lit("Grep"), F.lit("Edit"))).otherwise(F.array(F.lit("Write")))
    files = F.array(F.lit("a.py"), F.lit("b.py"))
    rows = rows.withColumns({"s": mm.mode_scores(F.col("text"), files, tools), "mode": mm.mode(F.col("text"), files, tools)})
    return rows.select("k", "mode", F.round(F.col("s")[F.col("mode")], 6).alias("score"))


TAGGED = [
    ("Always write tests for m#", "production,refactor", "production:7,refactor:5"),
    ("Keep it short in m#", "prototype,hotfix,exploration", "prototype:5,hotfix:5,exploration:5"),
    ("Use the factory pattern in m#", "production,refactor", "production:5,refactor:5"),
    ("review m# twice", "audit,exploration", "audit:5,exploration:5"),
    ("urgent hotfix of m#", "hotfix", "hotfix:10"),
    ("prefer names of m#", "prototype,production,hotfix,refactor", "prototype:5,production:5,hotfix:5,refactor:5"),
    ("a quick prototype of m#", "prototype,hotfix,exploration", "prototype:9,hotfix:5,exploration:5"),
]


@query(f"""WITH {expected([r[1:] for r in TAGGED], "modes, priorities")} SELECT k, modes, priorities FROM x""")
def mode_tags(spark, d):
    """[M19] The modes that a memory holds for, and how much."""
    rows = parts(spark, d, text=[r[0] for r in TAGGED]).withColumn("m", ru.mode_tags(F.col("text")))
    each = F.transform("m", lambda m: F.concat_ws(":", m, ru.mode_priority(F.col("text"), m).cast("string")))
    return rows.select("k", F.array_join("m", ",").alias("modes"), F.array_join(each, ",").alias("priorities"))


COMMITS = [
    ("We decided to move the parser # to files", "decision", "decided to move the parser # to files", 0.7),
    ("fix: null check in handler #", "correction", "null check in handler #", 0.6),
    ("use spark instead of threads for job #", "decision", "use spark instead of threads for job #", 0.7),
    ("Merge branch # into main", None, None, None),
    ("fixed it", None, None, None),
    ("never call f# from a signal handler", "correction", "call f# from a signal handler", 0.6),
    ("Add a page about #", None, None, None),
]


@query(f"""WITH {expected([r[1:] for r in COMMITS], "type, content, confidence")} SELECT k, type, content, confidence FROM x WHERE type IS NOT NULL""")
def commit_patterns(spark, d):
    """[X17, X18, L17] Decisions and corrections that commits state."""
    rows = parts(spark, d, subject=[r[0] for r in COMMITS])
    s = F.col("subject")
    return rows.filter(~mm.is_noise(s)).withColumn("p", mm.commit_pattern(s)).filter("p is not null").select("k", "p.type", "p.content", "p.confidence")


@query(f"""WITH {expected([r[1:2] for r in COMMITS], "type")} SELECT coalesce(type, 'none') AS type, count(*)::BIGINT AS commits, round(count(*)::DOUBLE / (SELECT count(*) FROM x), 4) AS share FROM x GROUP BY 1""")
def commit_summary(spark, d):
    """[Q37] How many commits state what."""
    rows = parts(spark, d, subject=[r[0] for r in COMMITS])
    kind = F.coalesce(mm.commit_pattern(F.col("subject"))["type"], F.lit("none"))
    n = rows.count()
    return rows.groupBy(kind.alias("type")).agg(F.count(F.lit(1)).alias("commits")).withColumn("share", F.round(F.col("commits") / F.lit(n), 4))


STEMS = [("running", "runn"), ("passed", "pass"), ("tests", "test"), ("ring", "ring"), ("bed", "bed"), ("was", "was"), ("string", "str"), ("seeds", "seed"), ("need", "need")]


@query(f"""WITH {expected([r[1:] for r in STEMS], "stem")} SELECT k, stem FROM x""")
def word_stems(spark, d):
    """[X7] Words without ing, ed and s."""
    return parts(spark, d, word=[r[0] for r in STEMS]).select("k", tx.stem(F.col("word")).alias("stem"))


TYPES = [("Optional[C#]", "C#"), ("List[C#]", "List"), ("a.b.C#", "C#"), ("C# | None", "C#"), ("Optional[List[int]]", "List"), ("typing.Optional[x.C#]", "C#"), ("dict", "dict")]


@query(f"""WITH {expected([r[1:] for r in TYPES], "base")} SELECT k, base FROM x""")
def base_types(spark, d):
    """[X8] What an annotation comes to."""
    return parts(spark, d, a=[r[0] for r in TYPES]).select("k", tx.base_type(F.col("a")).alias("base"))


@query("""SELECT p_partkey::BIGINT AS k, round(CASE WHEN p_partkey % 6 = 0 THEN 5e-1 ELSE greatest(1e-1, least(1e0, 1e-1 + 9e-1 * ((p_partkey % 40) - 1e0) / 29e0)) END, 6) AS relevance FROM part""")
def rank_relevance(spark, d):
    """[M4] Relevance of a full-text rank; 0.5 without one."""
    k = F.col("p_partkey").cast("long")
    rank = F.when(k % 6 != 0, -(k % 40).cast("double"))
    return table(spark, d, "part").select(k.alias("k"), F.round(sc.rank_relevance(rank), 6).alias("relevance"))


PROPOSED = ["Never use f#", "Keep functions of m# short", "Prefer names", "don't panic in m#", "x" * 201, "Do not log #", "Write docs for #"]


@query("""WITH c AS (SELECT p_partkey::BIGINT AS k, (p_partkey % 11) / 1e1 AS c, p_partkey % 7 IN (1, 2, 6) AS safe FROM part) SELECT k, CASE WHEN c >= 9e-1 AND safe THEN 'auto' WHEN c >= 5e-1 THEN 'review' ELSE 'skip' END AS decision, c >= 85e-2 AND safe AS batch FROM c""")
def approval(spark, d):
    """[L8, L9, Q33, X33] What happens to a proposal with and without anyone to ask."""
    rows = parts(spark, d, text=PROPOSED).withColumn("c", (F.col("k") % 11) / 10.0)
    return rows.select("k", ru.decision(F.col("text"), F.col("c")).alias("decision"), ru.batch_decision(F.col("text"), F.col("c")).alias("batch"))


THEMED = [("style and spacing of #", "style,spacing"), ("test error # of style", "style,test,error"), ("nothing at #", ""), ("doc comment on exception #", "exception,doc,comment"), ("error in check #", "error,check")]


@query(f"""WITH {expected([r[1:] for r in THEMED], "w")}, o AS (SELECT unnest(['style','format','spacing','indent','test','error','exception','validation','check','pattern','structure','doc','comment']) AS word, unnest(range(13)) AS i),
y AS (SELECT k % 50 AS grp, unnest(string_split(w, ',')) AS word FROM x), n AS (SELECT grp, word, count(*) AS n FROM y WHERE word <> '' GROUP BY ALL), b AS (SELECT grp, arg_max(word, (n, -i)) AS word FROM n JOIN o USING (word) GROUP BY 1)
SELECT a.grp, CASE WHEN word IN ('style','format','spacing','indent') THEN 'Code style' WHEN word = 'test' THEN 'Testing' WHEN word IN ('error','exception') THEN 'Error handling' WHEN word IN ('validation','check') THEN 'Validation' WHEN word IN ('pattern','structure') THEN 'Architecture' WHEN word IN ('doc','comment') THEN 'Documentation' ELSE 'General' END AS theme
FROM (SELECT DISTINCT k % 50 AS grp FROM x) a LEFT JOIN b ON a.grp = b.grp""")
def proposal_themes(spark, d):
    """[X32] The theme that most proposals of a group speak of; of equals the one named first in the list."""
    rows = parts(spark, d, text=[r[0] for r in THEMED]).withColumn("grp", F.col("k") % 50)
    place = F.array_position(F.array(*map(F.lit, ru.THEMES)), F.col("w"))
    n = rows.select("grp", F.explode(ru.theme_words(F.col("text"))).alias("w")).groupBy("grp", "w").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("grp").agg(F.max_by("w", F.struct("n", -place)).alias("w"))
    return rows.select("grp").distinct().join(best, "grp", "left").select("grp", ru.theme_of(F.col("w")).alias("theme"))


SEEN = [
    ("split file", "perfect", "success", 0.9, "Plan file splits before writing (200-line limit)", "split file", "Split large files before they exceed limits"),
    ("wrote test first for", "great tdd", "neutral", 0.5, "Write tests before implementation", "wrote test first for", "Write tests before implementation (TDD)"),
    ("long answer on", "stop, never again", "failure", 0.3, "Continue: long answer on", "Verbose explanations", None),
    ("design doc of", "good", "success", 0.7, "Create plan/design before implementation", "design doc of", None),
    ("wait on", "ok", "neutral", 0.5, "Continue: wait on", "Waiting for confirmation on obvious fixes", None),
    ("ran job", "exactly", "neutral", 0.9, "Continue: ran job", "ran job", "Continue approach: ran job"),
    ("a terse summary of", "that is not correct, don't", "failure", 0.7, "Keep summaries 2-3 sentences max", "a terse summary of", "Continue approach: a terse summary of"),
]


@query(f"""WITH {expected([r[2:] for r in SEEN], "kind, confidence, keep_on, leave, praise")} SELECT * FROM x""")
def observations(spark, d):
    """[X29, X30, Q29, Q30] What a response says of what was done: kind, how sure, and what to go on doing or not."""
    rows = parts(spark, d, a=[r[0] for r in SEEN], r=[r[1] for r in SEEN])
    a, r = F.col("a"), F.col("r")
    return rows.select("k", ru.observation_type(r).alias("kind"), ru.observation_confidence(r).alias("confidence"), ru.learned_rule(a).alias("keep_on"), ru.anti_pattern(a).alias("leave"), ru.praised(a, r).alias("praise"))


REFINE = [("please split #", "Plan file splits before writing (200-line limit)"), ("do TDD on #", "Write tests before implementation (TDD)"), ("be concise, not verbose #", "Keep output concise"), ("design first #", "Create design docs before coding"), ("log errors of #", "Log errors before returning"), ("nothing about #", None)]


@query(f"""WITH {expected([r[1:] for r in REFINE], "refined")} SELECT * FROM x""")
def refined_proposals(spark, d):
    """[X31] Proposals by templates."""
    return parts(spark, d, text=[r[0] for r in REFINE]).select("k", ru.refined(F.col("text")).alias("refined"))


@query("""WITH e AS (SELECT user_id, event_type, count(*) AS n, count(*) FILTER (value < 20) AS bad, count(*) FILTER (value >= 20) AS good FROM events GROUP BY ALL)
SELECT user_id, event_type, CASE WHEN n >= 3 AND bad = 0 THEN 'success' WHEN bad >= 2 THEN 'failure' WHEN good >= 3 THEN 'project' END AS pattern FROM e WHERE (n >= 3 AND bad = 0) OR bad >= 2 OR good >= 3""")
def learned_patterns(spark, d):
    """[A26, A27, L13] What of a user's actions is a pattern: always good, bad twice, or often good."""
    bad = F.col("value") < 20
    g = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad"), F.count_if(~bad).alias("good"))
    kind = F.when((F.col("n") >= 3) & (F.col("bad") == 0), "success").when(F.col("bad") >= 2, "failure").when(F.col("good") >= 3, "project")
    return g.select("user_id", "event_type", kind.alias("pattern")).filter("pattern is not null")


CHANGED = [
    # before, after, suffix, pattern, size, confidence, message, kind
    ("x = load(#)\ny = 1\n", "try:\n    x = load(#)\nexcept OSError:\n    raise Fail(#)\n", "py", "error_handling", "major", 0.8, "User added error handling silently", "behavior"),
    ("if a == #:\n    go()\nstop()\nend()\n", "if a != #:\n    run(one, two, three)\nstop()\nend()\n", "py", "logic_fix", "major", 0.8, "User fixed conditional logic", "behavior"),
    ("total# = 1\nprint(total#)\nsave(total#)\n", "sum# = 1\nprint(sum#)\nsave(sum#)\n", "py", "variable_rename", "major", 0.8, "User renamed total# to sum#", "preference"),
    ("a('b#', 'c')\nd('e', 'f')\ng('h', 'i')\n", 'a("b#", "c")\nd("e", "f")\ng("h", "i")\n', "js", "style_change", "major", 0.56, "User changed code style: quote style: single → double", "style"),
    ("alpha #\n", "alpha   #\n", "py", None, None, None, None, None),
    ("one\ntwo\nthree\nfour\n", "uno uno\ndos dos\ntres tres\ncuatro cuatro #\n", "txt", "refactor", "major", 0.72, "User modified generated code (refactor)", "rule"),
]


@query(f"""WITH {expected([r[3:] for r in CHANGED], "pattern, size, confidence, message, kind")} SELECT k, pattern, size, confidence, message, kind FROM x WHERE pattern IS NOT NULL""")
def silent_changes(spark, d):
    """[L11, L12, X24-X28, M17, Q44, Q45, U4] Changes of generated code that tell of a correction, and what they are."""
    rows = parts(spark, d, before=[r[0] for r in CHANGED], after=[r[1] for r in CHANGED], suffix=[r[2] for r in CHANGED])
    got = mining.silent(rows, "before", "after", "suffix")
    return got.select("k", "pattern", F.col("size"), F.round("confidence", 6).alias("confidence"), "message", "kind")


@query(f"""WITH {expected([r[3:] for r in CHANGED], "pattern, size, confidence, message, kind")}, a AS (SELECT k, message AS text, confidence, 'silent' AS source FROM x WHERE pattern IS NOT NULL UNION ALL SELECT conv_id * 1000 + turn, text, 7e-1, 'verbal' FROM conversations WHERE role = 'user')
SELECT k, text, confidence, source FROM a""")
def all_corrections(spark, d):
    """[U8] Corrections that were said and those that were made silently, together."""
    rows = parts(spark, d, before=[r[0] for r in CHANGED], after=[r[1] for r in CHANGED], suffix=[r[2] for r in CHANGED])
    silent = mining.silent(rows, "before", "after", "suffix").select("k", F.col("message").alias("text"), F.round("confidence", 6).alias("confidence"), F.lit("silent").alias("source"))
    said = table(spark, d, "conversations").filter("role = 'user'")
    return silent.unionByName(said.select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), "text", F.lit(0.7).alias("confidence"), F.lit("verbal").alias("source")))


#: Conflicts between the memories of a part and the next, made from sizes and prices.
PAIRS = """m AS (SELECT p_partkey::BIGINT AS id, TIMESTAMP '2024-01-01' + to_days((p_partkey * 37 % 90)::INTEGER) AS created, (p_size % 10) / 1e1 AS confidence FROM part),
c AS (SELECT a.id AS a, b.id AS b, CASE a.id % 3 WHEN 0 THEN 'contradiction' WHEN 1 THEN 'redundancy' ELSE 'obsolescence' END AS kind, a.created AS ca, b.created AS cb, a.confidence AS fa, b.confidence AS fb FROM m a JOIN m b ON b.id = a.id + 1 WHERE a.id % 2 = 0),
r AS (SELECT *, CASE WHEN kind <> 'contradiction' THEN CASE WHEN ca > cb THEN 'keep_a' ELSE 'keep_b' END WHEN date_diff('day', cb, ca) > 30 THEN 'keep_a' WHEN date_diff('day', cb, ca) < -30 THEN 'keep_b' WHEN fa - fb > 2e-1 THEN 'keep_a' WHEN fa - fb < -2e-1 THEN 'keep_b' ELSE 'ask_user' END AS resolution FROM c)"""


def _memories(spark, d):
    k = F.col("p_partkey").cast("long")
    created = F.expr("timestamp'2024-01-01'") + F.make_dt_interval((k * 37 % 90).cast("int"))
    return table(spark, d, "part").select(k.alias("id"), created.alias("created"), ((F.col("p_size") % 10) / 10.0).alias("confidence"))


def _decided(spark, d):
    m = _memories(spark, d)
    a, b = (m.select(F.col("id").alias(s), F.col("created").alias(f"created_{s}"), F.col("confidence").alias(f"confidence_{s}")) for s in "ab")
    pairs = a.filter("a % 2 = 0").withColumn("b", F.col("a") + 1).join(b, "b")
    kind = F.when(F.col("a") % 3 == 0, "contradiction").when(F.col("a") % 3 == 1, "redundancy").otherwise("obsolescence")
    return m, ss.resolutions(pairs.withColumn("kind", kind))


@query(f"WITH {PAIRS} SELECT a, b, kind, resolution, resolution <> 'ask_user' AS auto FROM r")
def conflict_resolutions(spark, d):
    """[M14, L15, Q34, Q35] What to do about each conflict, and whether that needs asking."""
    return _decided(spark, d)[1].select("a", "b", "kind", "resolution", "auto")


@query(f"WITH {PAIRS} SELECT id, confidence FROM m WHERE id NOT IN (SELECT CASE resolution WHEN 'keep_a' THEN b WHEN 'keep_b' THEN a ELSE -1 END FROM r)")
def resolved_memories(spark, d):
    """[L16, X-5] The memories that conflicts leave."""
    m, decided = _decided(spark, d)
    return ss.resolved(m, decided).select("id", "confidence")


#: Memories of customers: a text of a category and scope, as of the first order.
STORE = """m AS (SELECT c_custkey::BIGINT AS id, 'Prefer tests of c' || c_custkey AS content, list_extract(['preference','rule','decision','correction'], (c_custkey % 4 + 1)::INTEGER) AS category,
list_extract(['universal','language:python','project:p','language:go','project:q'], (c_custkey % 5 + 1)::INTEGER) AS scope, (c_custkey % 10) / 1e1 AS confidence, c_custkey % 40 AS age FROM customer)"""


def _store(spark, d):
    k = F.col("c_custkey").cast("long")
    return table(spark, d, "customer").select(
        k.alias("id"), F.concat(F.lit("Prefer tests of c"), k.cast("string")).alias("content"),
        pick(["preference", "rule", "decision", "correction"], k).alias("category"), pick(["universal", "language:python", "project:p", "language:go", "project:q"], k).alias("scope"),
        ((k % 10) / 10.0).alias("confidence"), (k % 40).alias("age"),
    )


@query(f"WITH {STORE} SELECT id, CASE WHEN id % 3 = 0 THEN 'quick note ' || id ELSE content END AS content, CASE WHEN id % 3 = 0 THEN 'prototype,hotfix,exploration' ELSE 'production,refactor' END AS modes FROM m UNION ALL SELECT -id - 1, 'new ' || id, 'prototype,production,hotfix,refactor' FROM m WHERE id % 10 = 0")
def memory_store(spark, d):
    """[S20, S22] Memories with new ones stored over them, and the modes that they hold for."""
    old = _store(spark, d).withColumn("created", F.lit(1)).drop("age")
    again = old.filter("id % 3 = 0").withColumn("content", F.concat(F.lit("quick note "), F.col("id").cast("string"))).withColumn("created", F.lit(2))
    fresh = old.filter("id % 10 = 0").withColumn("content", F.concat(F.lit("new "), F.col("id").cast("string"))).withColumn("id", -F.col("id") - 1)
    return ss.store(old, again.unionByName(fresh)).select("id", "content", F.array_join("modes", ",").alias("modes"))


@query(f"""WITH {STORE} SELECT id, '{{"version":1,"scope":"' || scope || '","category":"' || category || '","content":"' || content || '","confidence":' || confidence::DOUBLE || '}}' AS document FROM m""")
def memory_export(spark, d):
    """[S21] Memories as lines of JSON, each with the version of its form."""
    return ss.exported(_store(spark, d))


RELEVANT = """r AS (SELECT *, CASE WHEN scope = 'universal' THEN 1e0 WHEN scope = 'language:python' THEN 8e-1 WHEN scope = 'project:p' THEN 1e0 ELSE 0e0 END * (1e0 - age / 5e1) * confidence AS relevance, length(content) // 4 AS tokens FROM m),
b AS (SELECT *, sum(tokens) OVER (ORDER BY relevance DESC, id ROWS UNBOUNDED PRECEDING) AS used FROM r WHERE relevance > 0 AND relevance >= 3e-1)"""


def _retrieved(spark, d):
    recency = 1.0 - F.col("age") / 50.0
    return ss.retrieve(_store(spark, d), recency, "python", "p", 300, 0.3)


@query(f"WITH {STORE}, {RELEVANT} SELECT id, round(relevance, 6) AS relevance, tokens::BIGINT AS tokens, used::BIGINT AS used FROM b WHERE used <= 300")
def memory_retrieval(spark, d):
    """[R13, T5, F8, F9] Memories for a language and a project by relevance, within a budget of tokens."""
    return _retrieved(spark, d).select("id", F.round("relevance", 6).alias("relevance"), "tokens", "used")


@query(f"""WITH {STORE}, {RELEVANT} SELECT string_agg(CASE category WHEN 'preference' THEN 'pref' ELSE category END || ':' || content || CASE scope WHEN 'language:python' THEN '[python]' WHEN 'project:p' THEN '[p]' ELSE '' END, chr(10) ORDER BY CASE category WHEN 'preference' THEN 1 WHEN 'rule' THEN 2 WHEN 'decision' THEN 3 ELSE 4 END, relevance DESC, id) AS block, sum(tokens)::BIGINT AS tokens FROM b WHERE used <= 300""")
def memory_injection(spark, d):
    """[R14, R15, X34] The lines that a session begins with."""
    return ss.injected(_retrieved(spark, d))


@query("""WITH c AS (SELECT c_custkey % 100 AS session, c_custkey AS k, CASE WHEN c_custkey % 6 = 0 THEN 'done:wrote parser' ELSE 'fix:' || repeat(chr((97 + (c_custkey // 100) % 20)::INTEGER), 12) END AS code FROM customer WHERE c_custkey % 6 IN (0, 3)),
f AS (SELECT session, code, min(k) AS k FROM c GROUP BY ALL) SELECT session, row_number() OVER (PARTITION BY session ORDER BY k)::INTEGER AS n, code FROM f""")
def session_codes(spark, d):
    """[P30, P31] A session's codes that tell something, without repeats and near repeats."""
    k = F.col("c_custkey")
    again = F.concat(F.lit("fix:"), F.repeat(F.char(97 + F.floor(k / 100) % 20), F.lit(12)))
    code = F.when(k % 6 == 0, "done:wrote parser").when(k % 6 == 1, "next:short").when(k % 6 == 2, "impl:what is this?").when(k % 6 == 3, again).when(k % 6 == 4, "dec:now:something").otherwise("no category at all")
    rows = table(spark, d, "customer").select((k % 100).alias("session"), k.alias("k"), code.alias("code"))
    return ss.distinct_codes(rows, "session", "k", "code")


@query("""WITH c AS (SELECT c_custkey % 100 AS session, c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'next:' WHEN 1 THEN 'done:' ELSE 'dec:' END || 'item ' || c_custkey AS code FROM customer)
SELECT session, string_agg(code, chr(10) ORDER BY CASE WHEN code LIKE 'done%' THEN 1 WHEN code LIKE 'dec%' THEN 2 ELSE 3 END, k) AS text FROM c GROUP BY 1""")
def session_text(spark, d):
    """[Q43, Q42] A session's codes by category, a line each."""
    k = F.col("c_custkey")
    code = F.concat(F.when(k % 3 == 0, "next:").when(k % 3 == 1, "done:").otherwise("dec:"), F.lit("item "), k.cast("string"))
    rows = ss.numbered(table(spark, d, "customer").select((k % 100).alias("session"), k.alias("k"), code.alias("code")), "session", F.col("k"))
    return ss.rendered_codes(rows, "session", ("done", "dec"))


@query("""WITH i AS (SELECT c_custkey % 101 AS session, CASE WHEN c_custkey % 2 = 0 THEN 'next' ELSE 'done' END AS kind, CASE c_custkey % 4 WHEN 0 THEN 'next:parse-files-of-module-' || c_custkey WHEN 1 THEN 'done:parsed-file-of-module' WHEN 2 THEN 'next:deploy-service-' || c_custkey ELSE 'done:renamed things' END AS text, c_custkey AS k FROM customer)
SELECT session, kind, text FROM i WHERE NOT (kind = 'next' AND k % 4 = 0 AND EXISTS (SELECT 1 FROM i d WHERE d.session = i.session AND d.k % 4 = 1))""")
def open_tasks(spark, d):
    """[J26, L20, X7] What is still to do: next items that no done item of the session answers, and the done ones."""
    k = F.col("c_custkey")
    text = F.when(k % 4 == 0, F.concat(F.lit("next:parse-files-of-module-"), k.cast("string"))).when(k % 4 == 1, "done:parsed-file-of-module").when(k % 4 == 2, F.concat(F.lit("next:deploy-service-"), k.cast("string"))).otherwise("done:renamed things")
    rows = table(spark, d, "customer").select((k % 101).alias("session"), F.when(k % 2 == 0, "next").otherwise("done").alias("kind"), text.alias("text"))
    return ss.open_items(rows, "session")


@query("""WITH c AS (SELECT p_partkey::BIGINT AS id, 'f' || j AS path, ((p_partkey * 7 + j * 13) % 11) / 1e1 AS relevance, (p_partkey + j * 50) % 700 AS lines, (p_partkey + j) % 60 AS age FROM part, (VALUES (0), (1), (2)) v(j)),
q AS (SELECT *, 6e-1 * relevance + 2e-1 * (1e0 - least(lines, 500) / 5e2) + 2e-1 * exp(-23e-3 * age) AS q FROM c WHERE id % 5 <> 0) SELECT id, arg_max(path, (q, path)) AS path, round(max(q), 6) AS quality FROM q WHERE q >= 7e-1 GROUP BY 1""")
def memory_anchors(spark, d):
    """[T10, L18, U7, M12] The best example of each memory, where one is good enough; universal ones have none."""
    k, j = F.col("p_partkey").cast("long"), F.col("j")
    rows = table(spark, d, "part").withColumn("j", F.explode(F.array(*map(F.lit, (0, 1, 2)))))
    found = rows.select(k.alias("id"), F.concat(F.lit("f"), j.cast("string")).alias("path"), ((k * 7 + j * 13) % 11 / 10.0).alias("relevance"), ((k + j * 50) % 700).alias("lines"), ((k + j) % 60).alias("age_days"))
    memories = table(spark, d, "part").select(k.alias("id"), F.when(k % 5 == 0, "universal").otherwise("project:p").alias("scope"))
    return ss.anchored(memories, found).select("id", "path", F.round("quality", 6).alias("quality"))


@query("""WITH u AS (SELECT user_id, max(ts) AS last, count(*)::BIGINT AS turns, user_id % 3 AS m FROM events GROUP BY ALL) SELECT user_id AS session, CASE WHEN m = 0 THEN 'closed' WHEN last < TIMESTAMP '2024-01-30' - INTERVAL 7 DAY THEN 'archived' ELSE 'active' END AS status, turns + 5 AS turns FROM u""")
def session_upkeep(spark, d):
    """[X-6, Q42] Sessions brought up to date with their turns, idle ones archived."""
    e = table(spark, d, "events")
    old = e.select(F.col("user_id").alias("session")).distinct().select("session", F.lit(5).cast("long").alias("turns"), F.expr("timestamp_ntz'2023-01-01'").alias("last"))
    now = ss.synced(old, e.select(F.col("user_id").alias("session"), F.col("ts").alias("at")))
    rows = now.withColumn("status", F.when(F.col("session") % 3 == 0, "closed").otherwise("active"))
    return ss.archived(rows, F.expr("timestamp_ntz'2024-01-30'")).select("session", "status", "turns")


@query("""WITH n AS (SELECT user_id AS id, count(*)::BIGINT AS n, max(ts) AS last FROM events WHERE event_type = 'view' GROUP BY 1) SELECT c_custkey::BIGINT AS id, c_custkey % 7 + coalesce(n, 0) AS accesses, last AS last_access FROM customer LEFT JOIN n ON id = c_custkey""")
def access_counts(spark, d):
    """[X-4] Memories with their reads counted in."""
    m = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("id"), (F.col("c_custkey") % 7).cast("long").alias("accesses"))
    reads = table(spark, d, "events").filter("event_type = 'view'").select(F.col("user_id").cast("long").alias("id"), F.col("ts").alias("at"))
    return ss.with_access(m, reads)


@query("""WITH t AS (SELECT user_id, count(*) FILTER (event_type = 'view')::BIGINT AS reads, count(*) FILTER (event_type = 'click')::BIGINT AS snippets, count(*)::BIGINT AS sessions, count(*) FILTER (value > 50)::BIGINT AS mem, count(*) FILTER (event_type = 'signup')::BIGINT AS outlines FROM events GROUP BY 1)
SELECT user_id, array_to_string(list_filter([CASE WHEN reads > 0 AND snippets < 5e-1 * reads THEN (reads - snippets) || ' symbol reads could be snippets' END, CASE WHEN sessions > 0 AND mem < 5e-1 * sessions THEN (sessions - mem) || ' sessions had no memory' END, CASE WHEN outlines = 0 AND reads > 5 THEN 'read the outline before symbols' END], lambda x: x IS NOT NULL), '; ') AS suggestions FROM t""")
def usage_suggestions(spark, d):
    """[Q46] What usage could do better."""
    kind = lambda t: F.count_if(F.col("event_type") == t)
    t = table(spark, d, "events").groupBy("user_id").agg(kind("view").alias("reads"), kind("click").alias("snippets"), F.count(F.lit(1)).alias("sessions"), F.count_if(F.col("value") > 50).alias("with_memory"), kind("signup").alias("outlines"))
    return ss.suggestions(t).select("user_id", F.array_join("suggestions", "; ").alias("suggestions"))


@query("""WITH w AS (SELECT l_orderkey AS k, l_linenumber AS n, l_quantity AS changed, l_quantity + l_partkey % 50 AS total FROM lineitem) SELECT count(*)::BIGINT AS mutations, round(avg(1e0 - changed / total), 4) AS efficiency, sum((total - changed)::BIGINT * 4)::BIGINT AS tokens_saved, count(*) FILTER (changed < total)::BIGINT AS partial FROM w""")
def mutation_ledger(spark, d):
    """[S34, A11] The ledger of edits: how much of each file stayed, and what that saved."""
    rows = table(spark, d, "lineitem").select(F.col("l_quantity").alias("changed"), (F.col("l_quantity") + F.col("l_partkey") % 50).alias("total"))
    return rows.agg(F.count(F.lit(1)).alias("mutations"), F.round(F.avg(1.0 - F.col("changed") / F.col("total")), 4).alias("efficiency"), F.sum(F.round(F.col("total") - F.col("changed")).cast("long") * 4).alias("tokens_saved"), F.count_if(F.col("changed") < F.col("total")).alias("partial"))


@query("""WITH p AS (SELECT DISTINCT l_orderkey, l_suppkey AS s FROM lineitem), n AS (SELECT s, count(*)::BIGINT AS n FROM p GROUP BY 1) SELECT (SELECT count(DISTINCT l_orderkey) FROM lineitem)::BIGINT AS predictions, round((SELECT count(*) FROM p)::DOUBLE / (SELECT count(DISTINCT l_orderkey) FROM lineitem), 4) AS mean_symbols, (SELECT string_agg(s || ':' || n, ',' ORDER BY n DESC, s) FROM (SELECT * FROM n ORDER BY n DESC, s LIMIT 5)) AS top""")
def prediction_log(spark, d):
    """[S35, A12] The log of predictions: how many, how long, and the five symbols most often predicted."""
    log = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("symbols"))
    n = log.select(F.explode("symbols").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "s").limit(5)
    top = n.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("r"), "s", "n"))), lambda x: F.concat_ws(":", x["s"].cast("string"), x["n"].cast("string"))), ",").alias("top"))
    return log.agg(F.count(F.lit(1)).alias("predictions"), F.round(F.avg(F.size("symbols")), 4).alias("mean_symbols")).crossJoin(top)  # one row each


@query("""SELECT * FROM (VALUES ('commit', 'c' || (SELECT max(o_orderkey) FROM orders)), ('files', (SELECT count(*) FROM part)::VARCHAR), ('version', '2')) t(key, value)""")
def index_metadata(spark, d):
    """[S19] Keys and values of an index: the last that was set counts."""
    from lodestone.operators.windows import latest_wins

    last = table(spark, d, "orders").agg(F.concat(F.lit("c"), F.max("o_orderkey").cast("string")).alias("value")).select(F.lit("commit").alias("key"), "value", F.lit(1).alias("at"))
    files = table(spark, d, "part").agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.lit("files").alias("key"), "value", F.lit(1).alias("at"))
    set_ = spark.createDataFrame([("version", "1", 0), ("version", "2", 1), ("files", "0", 0)], "key string, value string, at int")
    return latest_wins(last.union(files).union(set_), ["key"], F.desc("at")).select("key", "value")
