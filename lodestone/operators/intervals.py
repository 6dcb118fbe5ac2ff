"""Joins on intervals and on time: containment, overlap, as-of.

Ranges are cut into dyadic intervals (at most two of each size), points are
asked for in the one interval of each size that holds them, and both meet by
equality. So no task holds all points and ranges of a key, a wide range costs
two rows a size, and every pair that meets is one of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _levels(ranges: DataFrame, start: str, end: str) -> int:
    """Sizes of dyadic intervals that the longest range needs."""
    longest = ranges.agg(F.max(F.col(end).cast("long") - F.col(start).cast("long") + 1)).first()[0]
    return max(1, int(longest or 1).bit_length())


def containing(points: DataFrame, ranges: DataFrame, key: str | list[str], at: str = "at", start: str = "start", end: str = "end") -> DataFrame:
    """Each point with every range of its key that holds it (ends included); whole numbers.

    Nulls in a key, a point or a range meet nothing, nor do ranges that end
    before they start. Repeated rows meet as often as they repeat.
    """
    keys = [key] if isinstance(key, str) else key
    levels = _levels(ranges, start, end)
    nodes = []
    for k in range(levels):
        a = -F.shiftright(-F.col(start).cast("long"), k)
        b = F.shiftright(F.col(end).cast("long") + 1, k)
        for odd, node in ((a, a), (b, b - 1)):
            nodes.append(F.when((a < b) & (odd.bitwiseAND(F.lit(1)) == 1), F.struct(F.lit(k).alias("k"), node.alias("n"))))
    r = ranges.withColumn("_n", F.explode(F.array_compact(F.array(*nodes))))
    where = [F.struct(F.lit(k).alias("k"), F.shiftright(F.col(at).cast("long"), k).alias("n")) for k in range(levels)]
    p = points.filter(F.col(at).isNotNull()).withColumn("_n", F.explode(F.array(*where)))
    return p.join(r, [*keys, "_n"]).drop("_n")


def innermost(points: DataFrame, ranges: DataFrame, key: str, point_id: str, range_id: str, at: str = "at", start: str = "start", end: str = "end") -> DataFrame:
    """(point_id, range_id) of the shortest range that holds each point; ties to the later start, then the smaller id."""
    order = F.struct(F.col(end) - F.col(start), -F.col(start), F.col(range_id))
    return containing(points, ranges, key, at, start, end).groupBy(point_id).agg(F.min_by(range_id, order).alias(range_id))


def latest_start(points: DataFrame, ranges: DataFrame, key: str, point_id: str, range_id: str, at: str = "at", start: str = "start", end: str = "end") -> DataFrame:
    """(point_id, range_id) of the range that begins last before each point and holds it; ties to the smaller id."""
    order = F.struct(-F.col(start), F.col(range_id))
    return containing(points, ranges, key, at, start, end).groupBy(point_id).agg(F.min_by(range_id, order).alias(range_id))


def bucketed(points: DataFrame, ranges: DataFrame, width: int, at: str = "at", start: str = "start", end: str = "end") -> DataFrame:
    """Containment without a key; ``width`` is of no account any more, as ranges of all widths are cut alike."""
    out = containing(points.withColumn("_one", F.lit(0)), ranges.withColumn("_one", F.lit(0)), "_one", at, start, end)
    return out.drop("_one")


def overlaps(a: DataFrame, b: DataFrame, key: str, a_range: tuple[str, str], b_range: tuple[str, str]) -> DataFrame:
    """Pairs of ranges of a key that share a point, with ``shared``: how many. One of the two holds the start of the other."""
    (a0, a1), (b0, b1) = a_range, b_range
    left, right = a.filter(F.col(a0) <= F.col(a1)), b.filter(F.col(b0) <= F.col(b1))
    first = containing(left, right, key, a0, b0, b1)
    second = containing(right, left, key, b0, a0, a1).filter(F.col(b0) > F.col(a0))
    both = first.unionByName(second)
    low, high = F.greatest(F.col(a0), F.col(b0)), F.least(F.col(a1), F.col(b1))
    return both.withColumn("shared", high - low + 1)


def _merged(left: DataFrame, right: DataFrame, key: str, left_id: str, at: str, then: str, found: Column) -> DataFrame:
    """Both sides in one table (k, t, id, found): ``found`` only on the right, whose rows without a key or time are left out."""
    kind = left.schema[left_id].dataType
    a = left.select(F.col(key).alias("k"), F.col(at).alias("t"), F.lit(1).alias("side"), F.col(left_id).alias("id"))
    b = right.filter(F.col(key).isNotNull() & F.col(then).isNotNull()).select(F.col(key).alias("k"), F.col(then).alias("t"), F.lit(0).alias("side"), F.lit(None).cast(kind).alias("id"), found.alias("found"))
    return a.unionByName(b, allowMissingColumns=True)


#: Seconds (or units of the order, if that is a number) in a slice of a key's rows.
SLICE = 86_400


def _carried(rows: DataFrame, width: float, latest_first: bool) -> DataFrame:
    """Adds ``last``: of the rows (k, t, side, id, found) of a key up to a row, the last ``found``, in order of t, side and tie; or backwards.

    A key's rows are cut into slices of ``width``; a task orders one slice, and
    what a slice leaves goes on to those after it by a row a key and slice, so a
    hot key is never in one task.
    """
    kind = rows.schema["t"].dataType.typeName()
    t = F.col("t").cast("timestamp").cast("double") if kind in ("timestamp", "timestamp_ntz", "date") else F.col("t").cast("double")
    rows = rows.withColumn("_slice", F.floor(t / width))
    turned = (lambda c: F.desc(c)) if latest_first else (lambda c: F.asc(c))
    left = F.min_by if latest_first else F.max_by
    ends = rows.filter("found is not null").groupBy("k", "_slice").agg(left("found", F.struct("t", "found.tie")).alias("_end"))
    # Each slice that has rows at all looks back to the last one with an end.
    there = rows.groupBy("k", "_slice").agg(F.lit(1).alias("_")).join(ends, ["k", "_slice"], "left")
    w = Window.partitionBy("k").orderBy(turned("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    before = there.select("k", "_slice", F.last("_end", ignorenulls=True).over(w).alias("_before"))
    inside = Window.partitionBy("k", "_slice").orderBy(turned("t"), turned("side"), turned("found.tie")).rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumn("last", F.last("found", ignorenulls=True).over(inside)).filter("side = 1")
    return seen.join(before, ["k", "_slice"], "left").withColumn("last", F.coalesce("last", "_before")).drop("_slice", "_before")


def last_before(left: DataFrame, right: DataFrame, key: str, left_id: str, at: str, then: str, value: Column, name: str, tie: str, width: float = SLICE) -> DataFrame:
    """Backward as-of join: (left_id, name), the value of the latest right row of the key with ``then <= at``, of equally late ones that with the largest ``tie``; null without one.

    A row per left row. Both sides are sorted together, a slice of ``width`` at a
    time, and the last value is carried along, so that a key's rows are never paired.
    """
    rows = _merged(left, right, key, left_id, at, then, F.struct(F.col(tie).alias("tie"), value.alias("value")))
    seen = _carried(rows, width, False)
    return seen.select(F.col("id").alias(left_id), F.when(F.col("t").isNotNull(), F.col("last.value")).alias(name))


def first_within(left: DataFrame, right: DataFrame, key: str, left_id: str, at: str, then: str, seconds: int, tie: str, width: float = SLICE) -> DataFrame:
    """Forward as-of join: (left_id, delay, tie), the first right row after ``at`` and at most ``seconds`` later; nulls without one.

    A row per left row. Both sides are sorted together, latest first and a slice
    of ``width`` at a time, and the last right row is carried along; of equally
    early ones the smallest ``tie`` counts.
    """
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    rows = _merged(left, right, key, left_id, at, then, F.struct(F.col(then).alias("then"), F.col(tie).alias("tie")))
    seen = _carried(rows, width, True)
    gap = micros(F.col("last.then")) - micros(F.col("t"))
    hit = (gap > 0) & (gap <= seconds * 1_000_000)
    return seen.select(F.col("id").alias(left_id), F.when(hit, gap / 1e6).alias("delay"), F.when(hit, F.col("last.tie")).alias(tie))
