"""Scores and classes as Column expressions. Thresholds and weights are fixed values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def bands(x: Column, steps: list[tuple[float, object]], rest: object, *, below: bool = True) -> Column:
    """The value of the first step that ``x`` is under (``below``) or at least at, else ``rest``."""
    out = None
    for limit, value in steps:
        hit = x < limit if below else x >= limit
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out.otherwise(F.lit(rest))


def recency_step(days: Column, decay: float = 90) -> Column:
    """1.0 within a week, 0.8 within 30 days, then 0.6 up to ``decay`` and 0.4 up to twice that; 0.2 after, and for null."""
    return F.coalesce(bands(days, [(7, 1.0), (30, 0.8), (decay, 0.6), (2 * decay, 0.4)], 0.2), F.lit(0.2))


def recency_decay(days: Column, rate: float = 0.023) -> Column:
    return F.exp(-rate * days)


def ago(seconds: Column) -> Column:
    """How long ago, in the largest unit that fits."""
    units = [(3600, 60, "min ago"), (86400, 3600, "h ago"), (604800, 86400, "d ago"), (2592000, 604800, "w ago"), (31536000, 2592000, "mo ago")]
    out = F.when(seconds < 60, F.lit("just now"))
    for limit, unit, name in units:
        out = out.when(seconds < limit, F.concat(F.floor(seconds / unit).cast("string"), F.lit(name)))
    return out.otherwise(F.concat(F.floor(seconds / 31536000).cast("string"), F.lit("y ago")))


def stability(coverage: Column, complexity: Column, churn: Column, deps: Column) -> Column:
    """0.4 coverage, 0.3 lack of complexity, 0.2 of churn, 0.1 of dependencies, rounded to 2; null with under two of the first three.

    Coverage is in percent, complexity in 0..1, churn and dependencies count up to 10. Absent ones are 0.5, dependencies 0.7.
    """
    known = sum((c.isNotNull().cast("int") for c in (coverage, complexity, churn)), F.lit(0))
    score = (
        0.4 * F.coalesce(coverage / 100.0, F.lit(0.5))
        + 0.3 * F.coalesce(1.0 - complexity, F.lit(0.5))
        + 0.2 * F.when(churn.isNull(), 0.5).otherwise(1.0 - F.least(churn / 10.0, F.lit(1.0)))
        + 0.1 * F.when(deps.isNull(), 0.7).otherwise(1.0 - F.least(deps / 10.0, F.lit(1.0)))
    )
    return F.when(known >= 2, F.round(score, 2))


def stability_level(score: Column) -> Column:
    return bands(score, [(0.75, "high"), (0.50, "medium")], "low", below=False)


def complexity_level(complexity: Column, lines: Column) -> Column:
    """low up to 10 branches and 50 lines, medium up to 20 and 150, else high."""
    return F.when((complexity <= 10) & (lines <= 50), "low").when((complexity <= 20) & (lines <= 150), "medium").otherwise("high")


def impact_risk(direct: Column, transitive: Column, coverage: Column) -> Column:
    """Risk of a change by how much it is used (direct + 0.3 transitive) and tested (0..1)."""
    use = direct + 0.3 * transitive
    some = bands(coverage, [(0.7, "low"), (0.4, "medium")], "high", below=False)
    much = bands(coverage, [(0.8, "medium"), (0.5, "high")], "critical", below=False)
    most = bands(coverage, [(0.8, "high")], "critical", below=False)
    return F.when(use == 0, "low").when(use < 5, some).when(use < 15, much).otherwise(most)


def safe_to_modify(risk: Column, coverage: Column) -> Column:
    return (risk == "low") | ((risk == "medium") & (coverage >= 0.7)) | ((risk == "high") & (coverage >= 0.9))


def coverage_percent(tests: Column, uncovered: Column) -> Column:
    """20 per test up to 100, less 10 per uncovered branch, not under 0."""
    return F.greatest(F.lit(0), F.least(F.lit(100), 20 * tests) - 10 * uncovered)


def memory_relevance(scope: Column, language: str | None, project: str | None, recency: Column, confidence: Column) -> Column:
    """Scope factor times recency times confidence; scopes of another language or project give 0."""
    factor = (
        F.when(scope == "universal", 1.0)
        .when(scope.startswith("language:"), F.when(F.substring(scope, 10, 1 << 20) == F.lit(language), 0.8).otherwise(0.0) if language else F.lit(0.0))
        .when(scope.startswith("project:"), F.when(F.substring(scope, 9, 1 << 20) == F.lit(project), 1.0).otherwise(0.0) if project else F.lit(0.0))
        .otherwise(0.5)
    )
    return factor * recency * confidence


def rank_relevance(rank: Column) -> Column:
    """A full-text rank (the more negative the better) on a scale of 0.1 to 1: linear from -1 to -30."""
    return F.when(rank.isNull(), 0.5).otherwise(F.greatest(F.lit(0.1), F.least(F.lit(1.0), 0.1 + 0.9 * (-rank - 1.0) / 29.0)))


def conflict_severity(universal: Column, recent: Column, sure: Column, kind: Column) -> Column:
    """3 if either is universal, 2 if both are recent, 2 if either is sure, 2 for contradictions, 1 for obsolescence."""
    points = 3 * universal.cast("int") + 2 * recent.cast("int") + 2 * sure.cast("int") + F.when(kind == "contradiction", 2).when(kind == "obsolescence", 1).otherwise(0)
    return bands(points, [(7, "critical"), (5, "high"), (3, "medium")], "low", below=False)


#: Parts of names that make a module critical.
CRITICAL = ("__init__", "main", "app", "server", "core")


def is_critical(name: Column) -> Column:
    return reduce(lambda a, b: a | b, [name.contains(c) for c in CRITICAL])


def cycle_severity(path: Column) -> Column:
    """By length, one step higher with a critical module; names are strings."""
    critical, n = F.exists(path, is_critical), F.size(path)
    return F.when(n < 2, "low").when(n <= 3, F.when(critical, "high").otherwise("medium")).otherwise(F.when(critical, "critical").otherwise("high"))


def branch_risk(symbols: Column, critical: Column) -> Column:
    """By the number of symbols changed and whether a critical path is among them."""
    return F.when((symbols > 50) | (critical & (symbols > 20)), "critical").when((symbols > 20) | critical, "high").when(symbols > 5, "medium").otherwise("low")


def divergence_confidence(size: Column, structural: Column, style: Column) -> Column:
    base = F.when(size == "major", 0.9).when(size == "moderate", 0.7).otherwise(0.5)
    return F.when(structural, F.least(F.lit(1.0), base + 0.1)).when(style, F.greatest(F.lit(0.3), base - 0.2)).otherwise(base)


def anchor_risk(churn: Column, coverage: Column) -> Column:
    """(score, level): up to 0.4 for churn, 0.3 for what is not covered."""
    score = F.least(churn / 2.0, F.lit(0.4)) + 0.3 * (1.0 - coverage)
    return F.struct(score.alias("score"), bands(score, [(0.3, "low"), (0.7, "medium")], "high").alias("level"))


def anchor_quality(relevance: Column, size: Column, recency: Column) -> Column:
    return 0.6 * relevance + 0.2 * size + 0.2 * recency


def conformance(weighted_violations: Column, files: Column) -> Column:
    """1 less the violations' weight per two files, not under 0, rounded to 2."""
    return F.round(F.greatest(F.lit(0.0), 1.0 - weighted_violations / (2.0 * files)), 2)


def dollars(tokens: Column, output: bool = False) -> Column:
    """At 3 per million tokens of input, 15 of output."""
    return tokens / 1e6 * (15.0 if output else 3.0)


def savings(original: Column, now: Column, tokens_per_line: int = 15) -> Column:
    """(tokens_saved, percent, ratio) of a text cut from ``original`` to ``now`` lines."""
    return F.struct(((original - now) * tokens_per_line).alias("tokens_saved"), F.round(100.0 * (original - now) / original, 1).alias("percent"), F.round(now / original, 3).alias("ratio"))


def approval(confidence: Column, take: float = 0.9, skip: float = 0.5) -> Column:
    return F.when(confidence >= take, "auto").when(confidence < skip, "skip").otherwise("review")
