"""URL filters: explicit rules, and association rules mined by FP-growth.

Explicit rules (host, path prefix) decide first; the longest that fits wins.
URLs that they judge are the labelled ones, from which FP-growth mines
combinations of tokens: one that comes with a label often enough (support), and
whose labelled URLs have that label often enough (confidence), becomes a rule
for the rest if enough of the URLs that hold it are labelled (coverage). So what
is common among unlabelled URLs is not judged by the few that have a label.
Without a coverage, unlabelled URLs count against the confidence instead. Rules
are found through an inverted index from each one's rarest token. All of it is
DataFrame operations.

Tokens that always come together, such as the segments of a template path, are
mined as one and put back into the rules, so that their subsets are not listed.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut

#: (host, path prefix, verdict) of the query's explicit rules.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Least support (of all URLs) and confidence of a mined rule, and the least share of labelled ones among the URLs that hold its tokens; tokens in more than MOST of the URLs tell nothing.
SUPPORT, CONFIDENCE, COVERAGE, MOST = 0.002, 0.8, 0.5, 0.95
#: Mined rules up to this many are broadcast (under 100 bytes each); more are joined by a shuffle.
BROADCAST_RULES = 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rest(url: Column) -> Column:
    """What follows the first ``://``; empty if there is none."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host(url: Column) -> Column:
    """Up to the first ``/``, ``?`` or ``#``, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def path(url: Column) -> Column:
    """From the host's end up to ``?`` or ``#``; empty without ``://``."""
    return F.regexp_extract(rest(url), "^[^/?#]*([^?#]*)", 1)


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL: labels of the host, segments of the path and keys of the query, digits left out."""
    tail = F.regexp_extract(rest(url), "^[^?#]*\\?([^#]*)", 1)
    parts = F.concat(
        F.transform(F.split(host(url), "\\."), lambda x: F.concat(F.lit("h:"), x)),
        F.transform(F.split(F.translate(path(url), UPPER, LOWER), "[/.]"), lambda x: F.concat(F.lit("p:"), x)),
        F.transform(F.split(tail, "&"), lambda x: F.concat(F.lit("q:"), F.regexp_extract(x, "^[^=]*", 0))),
    )
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: (F.length(x) > 2) & ~x.rlike("^..[0-9]+$"))))


def explicit(host_: Column, path_: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest explicit rule that fits, else null; of equally long ones the first by text."""
    name = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith(p)
        name = F.when(fits, F.lit(h + p)) if name is None else name.when(fits, F.lit(h + p))
        verdict = F.when(fits, F.lit(v)) if verdict is None else verdict.when(fits, F.lit(v))
    if name is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return name, verdict


def mine(rows: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, coverage: float | None = None) -> DataFrame | None:
    """(tokens, key, label, confidence) of the rules mined from (tokens, label) rows, label null where there is none; None without labels.

    ``key`` is the rule's rarest token, of equally rare ones the first. What
    comes to the driver are the tokens of at least ``support``: no more than
    there are tokens in a URL, on average, over ``support``.
    """
    n, known = rows.agg(F.count(F.lit(1)), F.count("label")).first()
    if not known:
        return None
    spark = rows.sparkSession
    signs = [F.sum(F.xxhash64(F.lit(i), "tokens").cast("decimal(38,0)")).alias(f"s{i}") for i in (0, 1)]  # of the URLs that hold a token
    counted = rows.select("tokens", F.explode("tokens").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"), *signs)
    frequent = sorted(counted.filter(F.col("n") >= support * n).collect(), key=lambda r: r.key)
    dull = {r.key for r in frequent if r.n > MOST * n}
    together: dict[tuple, list[str]] = {}
    for r in frequent:
        if r.key not in dull:
            together.setdefault((r.n, r.s0, r.s1), []).append(r.key)
    out = sorted(dull | {t for same in together.values() for t in same[1:]})
    of_all = F.array_except("tokens", F.array(*map(F.lit, out)).cast("array<string>"))
    label = F.when(F.col("label").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("label="), "label")))
    base = rows if coverage is None else rows.filter("label is not null")
    least = support if coverage is None else min(1.0, support * n / known)
    items = base.select(F.array_union(of_all, label).alias("items")).filter(F.size("items") > 0)
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=confidence).fit(items)
    found = model.associationRules.filter(F.col("consequent")[0].startswith("label=") & ~F.exists("antecedent", lambda x: x.startswith("label=")))
    found = found.select(F.array_sort("antecedent").alias("tokens"), F.substring(F.col("consequent")[0], 7, 1 << 20).alias("label"), "confidence")
    if coverage is not None:
        some = F.array_sort("items").alias("tokens")
        labelled = model.freqItemsets.select(some, F.col("freq").alias("labelled"))
        every = FPGrowth(itemsCol="items", minSupport=support, minConfidence=1.0).fit(rows.select(of_all.alias("items")))
        found = found.join(labelled, "tokens").join(every.freqItemsets.select(some, "freq"), "tokens").filter(F.col("labelled") >= coverage * F.col("freq")).drop("labelled", "freq")
    same = spark.createDataFrame([(s[0], s, k[0]) for k, s in sorted(together.items(), key=lambda z: z[1])], "key string, same array<string>, n long")
    full = found.withColumn("key", F.explode("tokens")).join(F.broadcast(same), "key")  # bounded as what came to the driver
    full = full.groupBy("tokens", "label", "confidence").agg(F.min_by("key", F.struct("n", "key")).alias("key"), F.array_sort(F.flatten(F.collect_list("same"))).alias("all"))
    return full.select(F.col("all").alias("tokens"), "label", "confidence", "key")


def judge(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, support: float = SUPPORT, confidence: float = CONFIDENCE, coverage: float | None = None) -> DataFrame:
    """(id_col, host, path, rule, verdict, mined): the explicit rule's verdict, else that of the best mined rule, else allow.

    Of mined rules that fit, the most confident decides, then the one with more
    tokens, then block, then the first by its tokens; ``mined`` shows its tokens.
    Null URLs and those without ``://`` have empty parts and are allowed.
    Repeated rows give a row each, very long URLs are taken whole, other
    columns play no part.
    """
    url = F.col("url")
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    rows = rows.withColumns({"host": F.coalesce(host(url), F.lit("")), "path": F.coalesce(path(url), F.lit("")), "tokens": F.coalesce(tokens(url), F.array().cast("array<string>"))})
    rule, verdict = explicit(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "said": verdict}).drop("url")
    mined = mine(rows.select("tokens", F.col("said").alias("label")), support, confidence, coverage)
    if mined is None:
        rows = rows.withColumns({"label": F.lit(None).cast("string"), "mined": F.lit(None).cast("string")})
    else:
        mined = cut(mined.withColumnRenamed("tokens", "need"))
        mined = F.broadcast(mined) if mined.count() <= BROADCAST_RULES else mined
        kinds = rows.filter("said is null and size(tokens) > 0").select("tokens").distinct()  # URLs with the same tokens are judged once
        fits = kinds.withColumn("key", F.explode("tokens")).join(mined, "key").filter(F.size(F.array_except("need", "tokens")) == 0)
        best = F.struct(-F.col("confidence"), -F.size("need"), F.when(F.col("label") == "block", 0).otherwise(1), F.array_join("need", " "))
        best = fits.groupBy("tokens").agg(F.min_by(F.struct("label", F.array_join("need", " ").alias("mined")), best).alias("m")).select(F.array_join("tokens", " ").alias("open"), "m.*")
        # What no mined rule is asked about has keys of its own, which a shuffle does not bring together; no token holds a line end in front.
        alone = F.concat(F.lit("\n"), F.xxhash64("id", "host", "path").cast("string"))
        rows = rows.withColumn("open", F.when(F.col("said").isNull() & (F.size("tokens") > 0), F.array_join("tokens", " ")).otherwise(alone))
        rows = rows.join(best, "open", "left")
    return rows.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("said", "label", F.lit("allow")).alias("verdict"), "mined")
