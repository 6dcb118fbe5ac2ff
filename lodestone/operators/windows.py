"""Operators that need an order: latest rows, budgets, runs, pairs and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import cut


def latest_wins(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key: the first by ``order`` (give a total one)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def first_n(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """Up to ``n`` rows per key; Spark takes the limit before the shuffle too."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def sliced(df: DataFrame, keys: list[str], size: Column, *order: Column) -> DataFrame:
    """``df`` with ``_size``, its ``_slice`` and ``_start``: what the rows of the key in the slices before add up to.

    Rows are dealt into ranges of key and order, so that the rows of a hot key
    lie in many slices and no task has them all; a slice's sum tells what is used
    up before the next.
    """
    rows = cut(df.withColumn("_size", size).repartitionByRange(*keys, *order).withColumn("_slice", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # a row a key and slice
    sums = rows.groupBy(*keys, "_slice").agg(F.sum("_size").alias("_sum")).withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    starts = sums.select(F.struct(*keys, F.lit(0).alias("_")).alias("_key"), F.col("_slice").alias("_at"), "_start")
    same = F.struct(*keys, F.lit(0).alias("_")).eqNullSafe(F.col("_key")) & (F.col("_slice") == F.col("_at"))
    return rows.join(starts, same).drop("_key", "_at")


def budget_prefix(df: DataFrame, keys: list[str], cost: Column, budget: float, *order: Column) -> DataFrame:
    """Per key the rows before the first whose running cost is over ``budget``; costs are not negative, ``order`` is total. Adds ``used``."""
    w = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = sliced(df, keys, cost, *order).filter(F.col("_start") <= budget)
    return rows.withColumn("used", F.col("_start") + F.sum("_size").over(w)).filter(F.col("used") <= budget).drop("_size", "_slice", "_start")


def budget_prefix_floored(df: DataFrame, keys: list[str], cost: Column, budget: float, *order: Column) -> DataFrame:
    """As :func:`budget_prefix`, but costs are compared in full and added up rounded down. Adds ``used`` (before the row)."""
    w = Window.partitionBy(*keys, "_slice").orderBy(*order)
    rows = sliced(df.withColumn("_cost", cost), keys, F.floor("_cost"), *order).filter(F.col("_start") <= budget)
    used = F.col("_start") + F.coalesce(F.sum("_size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumns({"used": used, "_n": F.row_number().over(w)}).withColumn("_over", F.col("used") + F.col("_cost") > budget)
    # The first row of a key that is over ends it, in whatever slice that is.
    ends = rows.filter("_over").groupBy(*keys).agg(F.min(F.struct("_slice", "_n")).alias("_end"))
    ends = ends.select(F.struct(*keys, F.lit(0).alias("_")).alias("_key"), "_end")
    kept = rows.join(ends, F.struct(*keys, F.lit(0).alias("_")).eqNullSafe(F.col("_key")), "left")
    kept = kept.filter(F.col("_end").isNull() | (F.struct("_slice", "_n") < F.col("_end")))
    return kept.drop("_size", "_slice", "_start", "_cost", "_n", "_over", "_key", "_end")


def greedy_cut(df: DataFrame, size: Column, limit: int, *order: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``kept``: how much of each row's size fits into ``limit`` (of its key), the last row in part; rows of which nothing fits go, empty rows stay."""
    rows = sliced(df, list(keys), size, *order).filter((F.col("_start") < limit) | (F.col("_size") == 0))
    w = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_size").over(w), F.lit(0)) + F.col("_start")
    kept = F.greatest(F.lit(0), F.least(F.col("_size"), F.lit(limit) - before))
    return rows.withColumn("kept", kept).filter((F.col("kept") > 0) | (F.col("_size") == 0)).drop("_size", "_slice", "_start")


def runs(df: DataFrame, keys: list[str], order: str, flag: Column) -> DataFrame:
    """Maximal runs of rows with ``flag`` in a gapless integer order: (keys, start, length)."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = df.filter(flag).withColumn("_g", F.col(order) - F.row_number().over(w))
    return rows.groupBy(*keys, "_g").agg(F.min(order).alias("start"), F.count(F.lit(1)).alias("length")).drop("_g")


def turn_pairs(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Each user turn that begins a run, with the next assistant turn: (key, user_turn, assistant_turn, user_text, assistant_text). Other roles are passed over."""
    rows = turns.filter(F.col(role).isin("user", "assistant"))
    w = Window.partitionBy(key).orderBy(order)
    # Latest first, so that the next answer is carried along and not searched for.
    after = Window.partitionBy(key).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    answer = F.when(F.col(role) == "assistant", F.struct(F.col(order).alias("t"), F.col(text).alias("x")))
    rows = rows.withColumn("_first", (F.col(role) == "user") & (F.coalesce(F.lag(role).over(w), F.lit("")) != "user")).withColumn("_a", F.last(answer, ignorenulls=True).over(after))
    rows = rows.filter(F.col("_first") & F.col("_a").isNotNull())
    return rows.select(key, F.col(order).alias("user_turn"), F.col("_a.t").alias("assistant_turn"), F.col(text).alias("user_text"), F.col("_a.x").alias("assistant_text"))


def sessions(events: DataFrame, key: str, ts: str, gap_seconds: int, width: int = 86_400) -> DataFrame:
    """Runs of a key's events with gaps under ``gap_seconds``: (key, start, end, events); rows without a time are no part of any.

    A key's events are ordered a slice of ``width`` seconds at a time, so no task
    has all of a hot key; what a slice leaves, its last time and the start of its
    last session, goes on to the next by a row a key and slice.
    """
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    rows = events.filter(F.col(ts).isNotNull()).select(F.col(key).alias("k"), F.col(ts).alias("t"), F.floor(micros(F.col(ts)) / (width * 1_000_000)).alias("slice"))
    inside, along = Window.partitionBy("k", "slice").orderBy("t"), Window.partitionBy("k").orderBy("slice")

    def joined(df: DataFrame, small: DataFrame, name: str) -> DataFrame:
        right = small.select(F.col("k").alias("_k"), F.col("slice").alias("_s"), name)
        return df.join(right, F.col("k").eqNullSafe(F.col("_k")) & (F.col("slice") == F.col("_s")), "left").drop("_k", "_s")

    before = rows.groupBy("k", "slice").agg(F.max("t").alias("last")).withColumn("before", F.lag("last").over(along))
    rows = joined(rows, before, "before").withColumn("before", F.coalesce(F.lag("t").over(inside), "before"))
    begins = F.coalesce(micros(F.col("t")) - micros(F.col("before")) >= gap_seconds * 1_000_000, F.lit(True))
    rows = rows.select("k", "t", "slice", F.when(begins, F.col("t")).alias("start"))
    left = rows.groupBy("k", "slice").agg(F.max("start").alias("start")).withColumn("carried", F.last("start", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)))
    # Of equally late rows the one that begins a session comes first.
    ordered = Window.partitionBy("k", "slice").orderBy("t", F.asc_nulls_last("start")).rowsBetween(Window.unboundedPreceding, 0)
    rows = joined(rows, left, "carried").withColumn("start", F.coalesce(F.last("start", ignorenulls=True).over(ordered), "carried"))
    return rows.groupBy("k", "start").agg(F.max("t").alias("end"), F.count(F.lit(1)).alias("events")).select(F.col("k").alias(key), "start", "end", "events")


def follows(events: DataFrame, key: str, value: str, first: str, *order: str) -> DataFrame:
    """(first, next, n): how often each value comes right after ``first`` within a key."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = events.withColumn("_before", F.lag(value).over(w)).filter(F.col("_before") == first)
    return rows.groupBy(F.col("_before").alias("first"), F.col(value).alias("next")).agg(F.count(F.lit(1)).alias("n"))


def last_texts(turns: DataFrame, n: int, key: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """Adds ``context``: the last ``n`` texts of a key up to and with the row, in order."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(1 - n, 0)
    return turns.withColumn("context", F.collect_list(text).over(w))
