"""Clusters of similar texts, proposals, conflicts and divergences."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import memories as mm
from lodestone.functions import rules as ru
from lodestone.functions import scores as sc
from lodestone.session import cut, dealt


def char_grams(text: Column, low: int = 3, high: int = 5) -> Column:
    """All character n-grams of each length, repeats included."""
    # The characters are told apart once a text: what a lambda only mentions is worked out anew for every element.
    chars = F.filter(F.split(F.lower(text), ""), lambda c: c != "")
    part = lambda cs, n: F.when(F.size(cs) >= n, F.transform(F.sequence(F.lit(1), F.size(cs) - n + 1), lambda i: F.array_join(F.slice(cs, i, n), ""))).otherwise(F.array().cast("array<string>"))
    return F.transform(F.array(chars), lambda cs: F.concat(*[part(cs, n) for n in range(low, high + 1)]))[0]


def tfidf_pairs(df: DataFrame, id_col: str, terms: Column, within: str, sublinear: bool = True) -> DataFrame:
    """(within, a, b, cosine) of the pairs of a group that share a term: smoothed idf per group, vectors of length 1.

    Pairs meet by a term, so none without a common term is looked at.
    """
    tf = df.select(F.col(within).alias("w"), F.col(id_col).alias("id"), F.explode(terms).alias("t")).groupBy("w", "id", "t").agg(F.count(F.lit(1)).alias("n"))
    idf = tf.groupBy("w", "t").agg(F.count(F.lit(1)).alias("df"))
    docs = df.groupBy(F.col(within).alias("w")).agg(F.count_distinct(id_col).alias("docs"))
    weight = ((1.0 + F.log("n")) if sublinear else F.col("n").cast("double")) * (F.log((1.0 + F.col("docs")) / (1.0 + F.col("df"))) + 1.0)
    v = tf.join(idf, ["w", "t"]).join(docs, "w").select("w", "id", "t", weight.alias("x"))
    norm = v.groupBy("w", "id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    v = v.join(norm, ["w", "id"]).select("w", "id", "t", (F.col("x") / F.col("norm")).alias("x"))
    a, b = (v.select("w", "t", F.col("id").alias(s), F.col("x").alias(f"x{s}")) for s in "ab")
    return a.join(b, ["w", "t"]).filter("a < b").groupBy(F.col("w").alias(within), "a", "b").agg(F.sum(F.col("xa") * F.col("xb")).alias("cosine"))


def counted(df: DataFrame, id_col: str, terms: Column, within: str) -> DataFrame:
    """(w, id, docs, t, n): how often each term is in each text of a group, and how many texts the group has."""
    docs = df.groupBy(within).agg(F.count_distinct(id_col).alias("docs"))
    # A text's terms are counted where its row is; a table of few bytes would be cut into terms by few tasks.
    rows = dealt(df.join(docs.hint("merge"), within), within, id_col).select(F.col(within).alias("w"), F.col(id_col).alias("id"), "docs", terms.alias("ts"))
    # Outer: before a plain explode Spark puts a filter on the array, down where the table is read, and makes all terms there as well.
    return rows.select("w", "id", "docs", F.explode_outer("ts").alias("t")).filter("t is not null").groupBy("w", "id", "docs", "t").agg(F.count(F.lit(1)).alias("n"))


def tfidf_over(df: DataFrame, id_col: str, terms: Column, within: str, floor: float) -> DataFrame:
    """(within, a, b, cosine) of the pairs a < b of a group whose TF-IDF cosine is over ``floor`` (above 0): all of them.

    With terms from rare to common, a pair's first common term begins all they
    share; each side's part from there on can add up to no more than its weights
    times the largest of each term. So a pair over the floor meets in both
    prefixes, in front of the tail that stays at or below it, and terms that
    nearly all texts have join nothing.
    """
    tf = counted(df, id_col, terms, within)
    met = Window.partitionBy("w", "t")
    weight = (1.0 + F.log("n")) * (F.log((1.0 + F.col("docs")) / (1.0 + F.col("df"))) + 1.0)
    v = tf.withColumn("df", F.count(F.lit(1)).over(met)).select("w", "id", "t", "df", weight.alias("x"))
    # A term of one text makes its vector longer and meets nothing.
    shared = F.collect_list(F.when(F.col("df") > 1, F.struct("t", "df", "x")))
    vectors = v.groupBy("w", "id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), shared.alias("s"))
    vectors = cut(vectors.filter(F.size("s") > 0).select("w", "id", F.transform("s", lambda c: F.struct(c["t"].alias("t"), c["df"].alias("df"), (c["x"] / F.col("norm")).alias("x"))).alias("s")))
    each = vectors.select("w", "id", F.inline("s")).withColumn("most", F.max("x").over(met))
    tail = Window.partitionBy("w", "id").orderBy(F.desc("df"), F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    prefix = each.withColumn("tail", F.sum(F.col("x") * F.col("most")).over(tail)).filter(F.col("tail") > floor).select("w", "id", "t")
    pairs = prefix.withColumnRenamed("id", "a").hint("merge").join(prefix.withColumnRenamed("id", "b"), ["w", "t"]).filter("a < b").select("w", "a", "b").distinct()
    side = lambda c: vectors.select("w", F.col("id").alias(c), F.col("s.t").alias(f"t{c}"), F.col("s.x").alias(f"x{c}")).hint("merge")
    found = pairs.join(side("a"), ["w", "a"]).join(side("b"), ["w", "b"]).select("w", "a", "b", dot("ta", "xa", "tb", "xb").alias("cosine"))
    return found.filter(F.col("cosine") > floor).withColumnRenamed("w", within)


@F.pandas_udf(T.DoubleType())
def dot(ta: pd.Series, xa: pd.Series, tb: pd.Series, xb: pd.Series) -> pd.Series:
    """Inner products of sparse vectors, each by its terms and their weights."""
    out = []
    for a, x, b, y in zip(ta, xa, tb, xb, strict=True):
        theirs = dict(zip(b, y, strict=True))
        out.append(float(sum(u * theirs[t] for t, u in zip(a, x, strict=True) if t in theirs)))
    return pd.Series(out, dtype="float64")


def greedy_clusters(items: DataFrame, pairs: DataFrame, id_col: str, within: str, over: float = 0.45) -> DataFrame:
    """(within, id, cluster): in the order of ids, an item not yet taken begins a cluster and takes all later ones not yet taken that resemble it.

    By rounds: items all of whose earlier neighbours are taken begin clusters,
    and what they resemble is taken; so no group is in one piece. An item's
    cluster is the first of those it resembles, as it was the first to take it.
    """
    links = cut(pairs.filter(F.col("cosine") > over).select(F.col(within).alias("w"), "a", "b"))
    left = cut(items.select(F.col(within).alias("w"), F.col(id_col).alias("id")).distinct())
    open_, seeds = links, None
    while not left.isEmpty():
        waiting = open_.select("w", F.col("b").alias("id")).distinct()
        new = cut(left.join(waiting, ["w", "id"], "left_anti"))
        seeds = new if seeds is None else seeds.unionByName(new)
        taken = open_.join(new.withColumnRenamed("id", "a"), ["w", "a"], "left_semi").select("w", F.col("b").alias("id")).distinct()
        left = cut(left.join(new, ["w", "id"], "left_anti").join(taken, ["w", "id"], "left_anti"))
        # Only links between items that are still open keep anything waiting.
        open_ = cut(open_.join(left.withColumnRenamed("id", "a"), ["w", "a"], "left_semi").join(left.withColumnRenamed("id", "b"), ["w", "b"], "left_semi"))
    rows = items.select(F.col(within).alias("w"), F.col(id_col).alias("id")).distinct()
    if seeds is None:
        return rows.select(F.col("w").alias(within), F.col("id").alias(id_col), F.col("id").alias("cluster"))
    by = links.join(seeds.withColumnRenamed("id", "a"), ["w", "a"], "left_semi").groupBy("w", F.col("b").alias("id")).agg(F.min("a").alias("first"))
    own = seeds.withColumn("own", F.lit(True))
    out = rows.join(own, ["w", "id"], "left").join(by, ["w", "id"], "left")
    return out.select(F.col("w").alias(within), F.col("id").alias(id_col), F.when(F.col("own"), F.col("id")).otherwise(F.col("first")).alias("cluster"))


def linkage(items: DataFrame, pairs: DataFrame, id_col: str, within: str, k: Column) -> DataFrame:
    """(within, id, cluster): average-linkage clusters of each group, merged until ``k`` (of its size ``n``) are left; named by their first item.

    ``pairs`` (within, a, b, cosine) are alike by their cosine, others not at
    all. All clusters that are each other's nearest merge at once: what is left
    of the rest is no nearer than before, so the tree is that of one merge at a
    time. Of its merges those of the most alike count, of equal ones the
    earlier; clusters that nothing joins are taken in order. A cluster keeps the
    sums of its cosines, never its items.
    """
    rows = items.select(F.col(within).alias("w"), F.col(id_col).alias("id")).distinct()
    sizes = cut(rows.select("w", "id", F.lit(1).cast("long").alias("size")))
    sums = cut(pairs.filter("a != b").select(F.col(within).alias("w"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("cosine").alias("s")).groupBy("w", "a", "b").agg(F.max("s").alias("s")))
    merges, turn = None, 0
    while not sums.isEmpty():
        both = sums.join(sizes.withColumnsRenamed({"id": "a", "size": "na"}), ["w", "a"]).join(sizes.withColumnsRenamed({"id": "b", "size": "nb"}), ["w", "b"])
        both = both.select("w", "a", "b", (F.col("s") / (F.col("na") * F.col("nb"))).alias("mean"))
        ways = both.union(both.select("w", "b", "a", "mean"))
        nearest = ways.groupBy("w", "a").agg(F.min(F.struct((-F.col("mean")).alias("far"), F.col("b").alias("to"))).alias("m")).select("w", "a", F.col("m.to").alias("b"), (-F.col("m.far")).alias("mean"))
        back = nearest.select("w", F.col("b").alias("a"), F.col("a").alias("b"))
        new = cut(nearest.filter("a < b").join(back, ["w", "a", "b"], "left_semi").withColumn("turn", F.lit(turn)))
        merges, turn = new if merges is None else merges.unionByName(new), turn + 1
        into = new.select("w", F.col("b").alias("id"), F.col("a").alias("to"))
        moved = lambda df, c: df.join(into.withColumnRenamed("id", c), ["w", c], "left").withColumn(c, F.coalesce("to", c)).drop("to")  # noqa: E731, B023
        sizes = cut(moved(sizes, "id").groupBy("w", "id").agg(F.sum("size").alias("size")))
        sums = moved(moved(sums, "a"), "b").filter("a != b")
        sums = cut(sums.groupBy("w", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("s").alias("s")))
    # Clusters that nothing joins merge into the first of them, last of all.
    order = Window.partitionBy("w").orderBy("id")
    lone = sizes.select("w", F.first("id").over(order).alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("mean"), (F.lit(turn) + F.row_number().over(order)).alias("turn")).filter("a != b")
    merges = lone if merges is None else merges.unionByName(lone)
    n = rows.groupBy("w").agg(F.count(F.lit(1)).alias("n")).withColumn("k", k)
    rank = F.row_number().over(Window.partitionBy("w").orderBy(F.desc("mean"), "turn", "a", "b"))
    kept = merges.withColumn("rank", rank).join(n, "w").filter("rank <= n - k")
    up = cut(rows.join(kept.select("w", F.col("b").alias("id"), F.col("a").alias("to")), ["w", "id"], "left").select("w", "id", F.coalesce("to", "id").alias("to")))
    while True:  # each look goes twice as far up
        step = cut(up.join(up.select("w", F.col("id").alias("to"), F.col("to").alias("top")), ["w", "to"]).select("w", "id", F.col("top").alias("to"), (F.col("top") != F.col("to")).alias("new")))
        up = step.drop("new")
        if not step.filter("new").take(1):
            return up.select(F.col("w").alias(within), F.col("id").alias(id_col), F.col("to").alias("cluster"))


# First words and words that make a variant a good one.
VARIANT_STARTS = (
    "use", "keep", "avoid", "never", "always", "prefer",
    "write", "add", "remove", "check", "ensure", "follow",
    "split", "plan", "test", "log", "handle", "return",
    "make", "set", "get", "put", "create", "delete",
    "stop", "start", "limit", "validate", "verify",
)
VARIANT_WORDS = ("before", "after", "instead", "when", "always", "never", "must", "should", "limit", "max", "min", "only", "all")
# End of fixed values.


def canonical(items: DataFrame, clusters: DataFrame, id_col: str, within: str, text: str) -> DataFrame:
    """(within, cluster, canonical, frequency): each cluster's best variant: one that begins with a verb, of 5 to 12 words (else 3 to 15), with many words that tell what to do, short; of equal ones the first."""
    t = F.trim(F.regexp_replace(text, "\\s+", " "))
    n = F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))
    length = F.when(n.between(5, 12), 2).when(n.between(3, 15), 1).otherwise(0)
    telling = sum((F.lower(text).contains(w).cast("int") for w in VARIANT_WORDS), F.lit(0))
    score = F.struct((~F.lower(F.split(t, " ")[0]).isin(*VARIANT_STARTS)).alias("verb"), (-length).alias("length"), (-telling).alias("telling"), F.length(text).alias("long"), F.col(id_col).alias("first"))
    return items.join(clusters, [within, id_col]).groupBy(within, "cluster").agg(F.min_by(text, score).alias("canonical"), F.count(F.lit(1)).alias("frequency"))


def average_linkage(distance: np.ndarray, k: int) -> np.ndarray:
    """Labels of an agglomerative clustering with average linkage down to ``k`` clusters; numbered by their first member."""
    groups = [[i] for i in range(len(distance))]
    while len(groups) > max(k, 1):
        best = min((float(distance[np.ix_(a, b)].mean()), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        groups[best[1]] += groups.pop(best[2])
    out = np.empty(len(distance), int)
    for n, g in enumerate(sorted(groups, key=min)):
        out[g] = n
    return out


def proposals(items: DataFrame, clusters: DataFrame, id_col: str, within: str, text: str, kind: str, confidence: str, project: str | None = None, most: int = 5) -> DataFrame:
    """(within, cluster, content, scope, category, frequency, confidence, rationale): the ``most`` clusters of each group by frequency times confidence.

    The canonical text is the shortest variant with a command word, the kind the most frequent, ties to the smaller.
    """
    rows = items.join(clusters, [within, id_col])
    quality = F.struct(~F.lower(text).rlike("^(?:" + "|".join(mm.STARTERS) + ")\\b"), F.length(text), F.col(text))
    n = rows.groupBy(within, "cluster", kind).agg(F.count(F.lit(1)).alias("n")).groupBy(within, "cluster").agg(F.max_by(kind, F.struct("n", F.col(kind))).alias("kind"))
    g = rows.groupBy(within, "cluster").agg(F.min_by(text, quality).alias("canonical"), F.count(F.lit(1)).alias("frequency"), F.avg(confidence).alias("confidence")).join(n, [within, "cluster"])
    c = F.col("canonical")
    out = g.select(within, "cluster", mm.imperative(c).alias("content"), mm.scope(c, project).alias("scope"), mm.category(c, F.col("kind")).alias("category"), "frequency", "confidence", mm.rationale(F.col("frequency"), F.col("confidence")).alias("rationale"))
    from lodestone.operators.windows import first_n

    return first_n(out, [within], most, F.desc(F.col("frequency") * F.col("confidence")), F.col("cluster"))


def resolve(memories: DataFrame, conflicts: DataFrame) -> DataFrame:
    """``memories`` (id, created, ...) without the older of each conflicting pair (a, b); of equally old ones b stays."""
    age = memories.select("id", "created")
    both = conflicts.join(age.withColumnsRenamed({"id": "a", "created": "ca"}), "a").join(age.withColumnsRenamed({"id": "b", "created": "cb"}), "b")
    losers = both.select(F.when(F.col("ca") > F.col("cb"), F.col("b")).otherwise(F.col("a")).alias("id")).distinct()
    return memories.join(losers, "id", "left_anti")


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two texts."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.StructType([T.StructField("added", T.IntegerType()), T.StructField("removed", T.IntegerType()), T.StructField("share", T.DoubleType())]))
def line_diff(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Lines added and removed between two texts, and their share of the longer one's lines."""
    out = []
    for x, y in zip(a, b, strict=True):
        old, new = (x or "").splitlines(), (y or "").splitlines()
        codes = [c for c in difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes() if c[0] != "equal"]
        plus, minus = sum(c[4] - c[3] for c in codes), sum(c[2] - c[1] for c in codes)
        out.append((plus, minus, (plus + minus) / max(len(old), len(new), 1)))
    return pd.DataFrame(out, columns=["added", "removed", "share"])


@F.pandas_udf(T.BooleanType())
def unlike(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether two texts have a Ratcliff-Obershelp similarity of under 0.9; bounds by their lengths and letters are tried first."""
    out = []
    for x, y in zip(a, b, strict=True):
        if x is None or y is None:
            out.append(None)
            continue
        m = difflib.SequenceMatcher(None, x, y)
        out.append(m.real_quick_ratio() < 0.9 or m.quick_ratio() < 0.9 or m.ratio() < 0.9)
    return pd.Series(out, dtype="boolean")


def silent(df: DataFrame, before: str, after: str, suffix: str) -> DataFrame:
    """Rows whose generated text was changed in more than white space and by over a tenth, with what that tells: ``size``, ``structural``, ``style``, ``pattern``, ``confidence``, ``message`` and ``kind``.

    ``suffix`` names the language by a file's ending. A correction that nobody
    spoke of counts four fifths of what its change tells.
    """
    plain = lambda c: F.trim(F.regexp_replace(c, "\\s+", " "))
    a, b = F.col(before), F.col(after)
    rows = df.filter(plain(a) != plain(b)).withColumn("_u", unlike(before, after)).filter("_u").drop("_u").withColumn("_d", line_diff(before, after))
    rows = rows.withColumns({"_r": ru.renamed(a, b), "_h": ru.handling_added(a, b, F.col(suffix)), "_i": ru.inverted(a, b), "style": ru.style_changes(a, b)})
    rows = rows.withColumn("size", F.when(F.col("_d.share") < 0.3, "minor").when(F.col("_d.share") < 0.6, "moderate").otherwise("major"))
    rows = rows.withColumn("structural", F.col("_r").isNotNull() | F.col("_h") | F.col("_i"))
    styled = F.size("style") > 0
    pattern = ru.divergence_pattern(F.col("_r").isNotNull(), F.col("_h"), F.col("_i"), styled, F.col("size"))
    rows = rows.withColumns({"pattern": pattern, "confidence": 0.8 * sc.divergence_confidence(F.col("size"), F.col("structural"), styled)})
    p = F.col("pattern")
    message = (
        F.when(p == "error_handling", "User added error handling silently")
        .when(p == "variable_rename", F.concat(F.lit("User renamed "), F.col("_r.old"), F.lit(" to "), F.col("_r.new")))
        .when(p == "logic_fix", "User fixed conditional logic")
        .when(p == "style_change", F.concat(F.lit("User changed code style: "), F.get("style", F.lit(0))))
        .otherwise(F.concat(F.lit("User modified generated code ("), p, F.lit(")")))
    )
    kind = F.when(p.isin("error_handling", "logic_fix"), "behavior").when(p == "style_change", "style").when(p == "variable_rename", "preference").otherwise("rule")
    return rows.withColumns({"message": message, "kind": kind}).drop("_d", "_r", "_h", "_i")


def divergences(df: DataFrame, before: str, after: str) -> DataFrame:
    """Rows whose text changed in more than white space and by over a tenth; adds ``size``, ``structural`` and ``style``."""
    plain = lambda c: F.trim(F.regexp_replace(c, "\\s+", " "))
    rows = df.filter(plain(F.col(before)) != plain(F.col(after))).withColumn("_u", unlike(before, after)).filter("_u").drop("_u")
    count = lambda c, p: F.regexp_count(F.col(c), F.lit(p))
    names = lambda c: F.array_distinct(F.regexp_extract_all(F.col(c), F.lit("[A-Za-z_]\\w*"), F.lit(0)))
    errors = count(after, "\\b(?:try|except|catch|raise|throw)\\b|err != nil") > count(before, "\\b(?:try|except|catch|raise|throw)\\b|err != nil")
    renamed = (F.size(F.array_except(names(before), names(after))) == 1) & (F.size(F.array_except(names(after), names(before))) == 1)
    inverted = count(after, "\\bnot\\b|!") != count(before, "\\bnot\\b|!")
    quotes = (count(before, '"') > count(before, "'")) != (count(after, '"') > count(after, "'"))
    rows = rows.withColumn("_d", line_diff(before, after))
    size = F.when(F.col("_d.share") < 0.3, "minor").when(F.col("_d.share") < 0.6, "moderate").otherwise("major")
    return rows.withColumns({"size": size, "structural": errors | renamed | inverted, "style": quotes}).drop("_d")
