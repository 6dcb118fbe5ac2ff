"""Rules on conversation turns as Column expressions. Word lists and phrases are fixed values; all are substrings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


COMMANDS = ("don't", "dont", "never", "stop", "avoid", "not", "no", "always", "must", "should", "make sure", "ensure")
STARTERS = ("don't", "dont", "never", "always", "stop", "keep", "make sure", "ensure", "avoid", "please don't", "please")
QUESTIONS = ("what", "why", "how", "when", "where", "who", "which", "can", "could", "would", "should i")
CASUAL = ("i don't know", "i don't understand", "don't worry", "that's not what", "not sure", "i'm confused", "am i confused", "if i am confused", "sorry if")
PREFERENCES = ("i prefer", "i'd prefer", "i like", "i'd like", "i want", "i'd want", "would rather", "would prefer", "prefer to use", "like to use")
HYPOTHETICAL = ("if i", "what if", "suppose", "imagine", "let's say")
ACTIONS = ("<invoke", "```", "I've", "I'll", "Let me", "I'm going to", "Created", "Modified", "Deleted")
CORRECTIONS = ("actually", "instead", "rather", "wrong", "incorrect", "too", "should be")


def any_of(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in parts])


def starts_with_any(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.startswith(p) for p in parts])


def is_command(text: Column) -> Column:
    """An imperative: begins with a command, or is short and has a strong word; never a question."""
    low = F.trim(F.lower(text))
    short = (F.size(F.split(F.trim(text), "\\s+")) <= 8) & F.arrays_overlap(F.split(low, "\\s+"), F.array(*map(F.lit, ("never", "always", "must"))))
    return ~low.endswith("?") & ~starts_with_any(low, QUESTIONS) & (starts_with_any(low, STARTERS) | short)


def is_false_positive(text: Column) -> Column:
    low = F.lower(text)
    return (low.contains("?") & ~any_of(low, ("never", "always", "must", "ensure", "make sure"))) | any_of(low, CASUAL)


def took_action(text: Column) -> Column:
    return any_of(text, ACTIONS)


def is_preference(text: Column) -> Column:
    low = F.lower(text)
    return any_of(low, PREFERENCES) & ~F.trim(low).endswith("?") & ~any_of(low, HYPOTHETICAL)


def classify(pairs: DataFrame, key: str = "conv_id", order: str = "user_turn", user: str = "user_text", assistant: str = "assistant_text") -> DataFrame:
    """Adds ``kind`` and ``confidence`` to (user, assistant) pairs: a rule, a style, a preference, a behavior, or null.

    In order: after an action of the assistant, over several turns, by
    repetition (two earlier texts of a similarity of over 0.5), by preference,
    by command. Turns of a conversation are told by their order. Earlier texts
    meet a turn by the words that so similar ones must share, so no turn holds
    all that came before it.
    """
    from lodestone.operators.relational import similar_pairs

    w = Window.partitionBy(key).orderBy(order)
    text, low = F.col(user), F.lower(F.col(user))
    words = F.array_distinct(F.split(F.trim(low), "\\s+"))
    strong = any_of(low, ("never", "always", "must", "should"))
    rows = pairs.withColumns({"_n": F.row_number().over(w), "_before": F.lag(assistant).over(w), "_no": low.contains("no") | low.contains("not"), "_w": words})
    rows = rows.withColumn("_nos", F.max("_no").over(w.rowsBetween(-2, 0)))
    ids = pairs.select(F.struct(F.col(key).alias("k"), F.col(order).alias("o")).alias("_id"), F.col(key), words.alias("_w"))
    earlier = similar_pairs(ids, "_id", F.col("_w"), 0.5, key).groupBy(F.col("b.k").alias(key), F.col("b.o").alias(order)).agg(F.count(F.lit(1)).alias("_alike"))
    rows = rows.join(earlier, [key, order], "left")
    alike = F.coalesce("_alike", F.lit(0))
    after = (F.col("_n") >= 2) & F.coalesce(took_action(F.col("_before")), F.lit(False)) & (any_of(low, CORRECTIONS) | (strong & is_command(text)))
    multi = (F.col("_n") >= 3) & any_of(low, ("yes", "correct", "right", "exactly")) & strong & F.col("_nos")
    direct = any_of(low, COMMANDS) & is_command(text)
    kind = F.when(is_false_positive(text), None).when(after, F.struct(F.lit("rule").alias("kind"), F.lit(1.0).alias("confidence")))
    for hit, name, c in ((multi, "rule", 0.95), (alike >= 2, "style", 0.8), (is_preference(text), "preference", 0.85), (direct, "behavior", 0.9)):
        kind = kind.when(hit, F.struct(F.lit(name).alias("kind"), F.lit(c).alias("confidence")))
    rows = rows.withColumn("_k", kind)
    return rows.withColumns({"kind": F.col("_k.kind"), "confidence": F.col("_k.confidence")}).drop("_n", "_before", "_no", "_w", "_alike", "_nos", "_k")
