"""Memories, sessions and ledgers as tables: store, search by scope, conflicts, codes, archives."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import rules
from lodestone.functions import scores as sc
from lodestone.functions import text as tx
from lodestone.operators.windows import budget_prefix, first_n, greedy_cut, latest_wins


def store(memories: DataFrame, new: DataFrame) -> DataFrame:
    """``memories`` with ``new`` (id, content, category, scope, confidence, created): of equal ids the new row, of several the latest; with the modes that each holds for."""
    rows = memories.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    one = latest_wins(rows, ["id"], F.desc("_new"), F.desc("created"), F.col("content")).drop("_new")
    return one.withColumn("modes", rules.mode_tags(F.col("content")))


def exported(memories: DataFrame, version: int = 1) -> DataFrame:
    """(id, document): each memory as a line of JSON that names the version of its form; written as text, the lines are the export."""
    row = F.struct(F.lit(version).alias("version"), "scope", "category", "content", "confidence")
    return memories.select("id", F.to_json(row).alias("document"))


def retrieve(memories: DataFrame, recency: Column, language: str | None, project: str | None, budget: int, floor: float = 0.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """Memories by relevance (scope, recency, confidence) from ``floor`` on, until their tokens (a quarter of the characters) are over the budget; adds ``relevance``, ``tokens``, ``used``.

    Memories of no token tell nothing and are left out; so without ``keys`` at most ``budget`` rows meet in one task.
    """
    rows = memories.withColumn("relevance", sc.memory_relevance(F.col("scope"), language, project, recency, F.col("confidence")))
    rows = rows.filter((F.col("relevance") > 0) & (F.col("relevance") >= floor)).withColumn("tokens", tx.token_estimate(F.col("content"))).filter("tokens > 0")
    order = F.desc("relevance"), F.col("id")
    if not keys:
        rows = greedy_cut(rows, F.col("tokens"), budget, *order).drop("kept")
    return budget_prefix(rows, list(keys), F.col("tokens"), budget, *order)


def injected(retrieved: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, block, tokens): the lines of what was retrieved, by category in the order preference, rule, decision, correction, then as retrieved."""
    order = F.struct(F.array_position(F.array(*map(F.lit, rules.PREFIX)), F.col("category")).alias("c"), (-F.col("relevance")).alias("r"), F.col("id").alias("i"), rules.context_line(F.col("category"), F.col("content"), F.col("scope")).alias("line"))
    g = retrieved.groupBy(*keys).agg(F.array_sort(F.collect_list(order)).alias("rows"), F.sum("tokens").alias("tokens"))
    return g.select(*keys, F.array_join(F.transform("rows", lambda x: x["line"]), "\n").alias("block"), "tokens")


def resolutions(pairs: DataFrame) -> DataFrame:
    """Conflicts (a, b, kind, created_a, created_b, confidence_a, confidence_b) with ``resolution`` and ``auto``: redundant and obsolete ones keep the newer, of equally old ones b; contradictions are decided only where age or confidence tells."""
    days = F.floor((F.unix_micros("created_a") - F.unix_micros("created_b")) / 86_400_000_000)
    own = rules.recommendation(days, F.col("confidence_a") - F.col("confidence_b"))
    newer = F.when(F.col("created_a") > F.col("created_b"), "keep_a").otherwise("keep_b")
    out = pairs.withColumn("resolution", F.when(F.col("kind") == "contradiction", own).otherwise(newer))
    return out.withColumn("auto", F.col("resolution") != "ask_user")


def resolved(memories: DataFrame, decided: DataFrame) -> DataFrame:
    """``memories`` after ``resolution`` of conflicts (a, b): losers go; merged pairs (resolution ``merge``, ``merged``) go for one with the larger confidence under both ids."""
    gone = lambda side, *what: decided.filter(F.col("resolution").isin(*what)).select(F.col(side).alias("id"))
    losers = gone("b", "keep_a", "merge", "delete_both").union(gone("a", "keep_b", "merge", "delete_both")).distinct()
    left = memories.join(losers, "id", "left_anti")
    if "merged" not in decided.columns:
        return left
    new = decided.filter("resolution = 'merge'").select(F.concat_ws("+", "a", "b").alias("id"), F.col("merged").alias("content"), F.greatest("confidence_a", "confidence_b").alias("confidence"))
    return left.unionByName(new, allowMissingColumns=True)


def distinct_codes(codes: DataFrame, key: str, order: str, code: str, most: int = 150, alike: float = 0.85) -> DataFrame:
    """(key, n, code): a session's codes that tell something, in order, without those that are like an earlier one of their category, at most ``most``.

    Alike are codes of which more than ``alike`` of the longer one's characters
    stand in the same place. The order matters, so a session is dealt with in
    one piece, equal codes taken together before; it compares each code with at
    most ``most`` that were kept.
    """
    rows = codes.filter(F.col(key).isNotNull() & rules.meaningful(F.col(code))).groupBy(F.col(key).alias("key"), F.col(code).alias("code")).agg(F.min(order).alias("at"))
    kind = codes.schema[key].dataType.simpleString()

    def same(a: str, b: str) -> bool:
        (ka, _, xa), (kb, _, xb) = a.partition(":"), b.partition(":")
        return a == b or ka == kb and bool(xa and xb) and sum(map(str.__eq__, xa, xb)) / max(len(xa), len(xb)) > alike

    def group(table: pa.Table) -> pa.Table:
        kept, seen = [], []
        for c in table.sort_by([("at", "ascending"), ("code", "ascending")]).column("code").to_pylist():
            low = c.lower().strip()
            if len(kept) < most and not any(same(low, s) for s in seen):
                kept.append(c)
                seen.append(low)
        return pa.table({"key": pa.array([table.column("key")[0].as_py()] * len(kept), table.schema.field("key").type), "n": pa.array(range(1, len(kept) + 1), pa.int32()), "code": pa.array(kept, pa.string())})

    return rows.groupBy("key").applyInArrow(group, f"key {kind}, n int, code string").withColumnRenamed("key", key)


def rendered_codes(codes: DataFrame, key: str, categories: tuple[str, ...]) -> DataFrame:
    """(key, text): a session's codes (key, n, code) by category in the order given, the others behind, one a line."""
    own = F.split("code", ":")[0]
    place = F.array_position(F.array(*map(F.lit, categories)), own)
    rank = F.when(place == 0, len(categories) + 1).otherwise(place)
    g = codes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(rank.alias("r"), F.col("n"), F.col("code")))).alias("c"))
    return g.select(key, F.array_join(F.transform("c", lambda x: x["code"]), "\n").alias("text"))


#: Words that tell nothing of a task.
TASK_STOP = ("the", "and", "or", "to", "a", "an", "is", "for", "of", "in", "on")


def task_words(code: Column) -> Column:
    """The stems of a session code's words behind its category, once each: longer than two characters, no stop words."""
    words = F.split(F.lower(F.regexp_extract(code, "^[^:]*:(.*)$", 1)), "[-_:\\s]+")
    return F.array_distinct(F.transform(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*TASK_STOP)), tx.stem))


def open_items(items: DataFrame, key: str, share: float = 0.6) -> DataFrame:
    """``items`` (key, kind, text) without the next ones that a done one of the same key answers: at least ``share`` of the smaller one's words are common.

    Items meet by their words; repeated items go or stay together.
    """
    rows = items.withColumn("_w", task_words(F.col("text"))).withColumn("_id", F.xxhash64(key, "kind", "text"))
    one = rows.dropDuplicates(["_id"])
    nxt = one.filter("kind = 'next'").select(key, "_id", F.size("_w").alias("n"), F.explode("_w").alias("w"))
    done = one.filter("kind = 'done'").select(key, F.col("_id").alias("d"), F.size("_w").alias("m"), F.explode("_w").alias("w"))
    hit = nxt.join(done, [key, "w"]).groupBy(key, "_id", "n", "m", "d").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= share * F.least("n", "m"))
    return rows.join(hit.select(key, "_id").distinct().withColumn("kind", F.lit("next")), [key, "_id", "kind"], "left_anti").drop("_w", "_id")


def anchored(memories: DataFrame, candidates: DataFrame, floor: float = 0.7, most: int = 20) -> DataFrame:
    """(id, path, quality): the best of a memory's candidate files (id, path, relevance, lines, age_days), at least ``floor``; of candidates of one file the most relevant, of all the ``most`` first by relevance."""
    one = latest_wins(candidates, ["id", "path"], F.desc("relevance"), F.col("lines"))
    top = first_n(one, ["id"], most, F.desc("relevance"), F.col("path"))
    size = 1.0 - F.least(F.col("lines"), F.lit(500)) / 500.0
    quality = sc.anchor_quality(F.col("relevance"), size, F.exp(-0.023 * F.col("age_days")))
    rows = top.withColumn("quality", quality).filter(F.col("quality") >= floor)
    best = rows.join(memories.filter("scope != 'universal'").select("id"), "id", "left_semi")
    return best.groupBy("id").agg(F.max_by(F.struct("path", "quality"), F.struct("quality", "path")).alias("m")).select("id", "m.*")


def archived(sessions: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """``sessions`` (status, last) with those that are active and idle for over ``days`` as archived."""
    idle = (F.col("status") == "active") & (F.col("last") < now - F.expr(f"interval {days} days"))
    return sessions.withColumn("status", F.when(idle, "archived").otherwise(F.col("status")))


def with_access(memories: DataFrame, reads: DataFrame) -> DataFrame:
    """``memories`` (id, accesses) with the reads (id, at) counted in, and the last of them."""
    n = reads.groupBy("id").agg(F.count(F.lit(1)).alias("_n"), F.max("at").alias("last_access"))
    return memories.join(n, "id", "left").withColumn("accesses", F.col("accesses") + F.coalesce("_n", F.lit(0))).drop("_n")


def suggestions(totals: DataFrame) -> DataFrame:
    """``totals`` (reads, snippets, sessions, with_memory, outlines) with the ``suggestions`` that they give, in order."""
    parts = [
        F.when((F.col("reads") > 0) & (F.col("snippets") < 0.5 * F.col("reads")), F.format_string("%d symbol reads could be snippets", F.col("reads") - F.col("snippets"))),
        F.when((F.col("sessions") > 0) & (F.col("with_memory") < 0.5 * F.col("sessions")), F.format_string("%d sessions had no memory", F.col("sessions") - F.col("with_memory"))),
        F.when((F.col("outlines") == 0) & (F.col("reads") > 5), F.lit("read the outline before symbols")),
    ]
    return totals.withColumn("suggestions", F.array_compact(F.array(*parts)))


def synced(sessions: DataFrame, turns: DataFrame, key: str = "session") -> DataFrame:
    """``sessions`` (key, turns, last) brought up to date with ``turns`` (key, at): counted on, or made where there is none."""
    n = turns.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.max("at").alias("_last"))
    both = sessions.join(n, key, "full_outer")
    return both.select(key, (F.coalesce("turns", F.lit(0)) + F.coalesce("_n", F.lit(0))).cast("long").alias("turns"), F.greatest("last", "_last").alias("last"))


def numbered(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """``rows`` with ``n``, from 1 on within a key."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
