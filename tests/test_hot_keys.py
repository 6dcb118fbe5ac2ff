"""Windows that cut a key's rows into slices, against plain Python, with ties, nulls and slices of a few rows."""

import datetime as dt
import random

from pyspark.sql import functions as F

from lodestone.operators import intervals, windows

START = dt.datetime(2024, 1, 1)


def test_sessions_over_slices(spark):
    rng = random.Random(4)
    rows = []
    for k in ("a", "b", None):
        t = 0
        for _ in range(60):
            t += rng.choice([0, 0, 30, 50, 59, 60, 61, 300, 900])
            rows.append((k, START + dt.timedelta(seconds=t)))
    rows += rows[:9] + [("a", None)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz").repartition(3)
    want = set()
    for k in ("a", "b", None):
        times, run = sorted(t for x, t in rows if x == k and t), []
        for t in [*times, None]:
            if run and (t is None or (t - run[-1]).total_seconds() >= 60):
                want.add((k, run[0], run[-1], len(run)))
                run = []
            run.append(t)
    for width in (45, 3600, 10**6):
        assert {tuple(r) for r in windows.sessions(df, "k", "ts", 60, width).collect()} == want


def test_budgets_of_a_hot_key(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["x", "x", "x", "y", None]), i, rng.randrange(0, 9)) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, id long, c long").repartition(7)
    whole, floored = set(), set()
    for k in ("x", "y", None):
        used, open_ = 0, True
        for _, i, c in sorted((r for r in rows if r[0] == k), key=lambda r: -r[1]):
            used += c
            if used <= 700:
                whole.add((i, used))
        used = 0
        for _, i, c in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            open_ = open_ and used + c * 1.3 + 0.5 <= 700
            if open_:
                floored.add((i, used))
            used += int(c * 1.3 + 0.5)
    got = windows.budget_prefix(df, ["k"], F.col("c"), 700, F.desc("id"))
    assert {(r.id, r.used) for r in got.collect()} == whole and got.columns == ["k", "id", "c", "used"]
    got = windows.budget_prefix_floored(df, ["k"], F.col("c") * 1.3 + 0.5, 700, F.col("id"))
    assert {(r.id, r.used) for r in got.collect()} == floored and got.columns == ["k", "id", "c", "used"]


def test_asof_over_slices(spark):
    rng = random.Random(3)
    a = [(i, rng.choice([1, 1, 1, 2, None]), START + dt.timedelta(seconds=rng.randrange(4000))) for i in range(200)] + [(500, 1, None)]
    b = [(rng.choice([1, 1, 2, None]), START + dt.timedelta(seconds=rng.randrange(0, 4000, 7)), v) for v in range(120)]
    left, right = spark.createDataFrame(a, "id long, k long, at timestamp_ntz"), spark.createDataFrame(b, "k long, then timestamp_ntz, v long")
    back, ahead = {}, {}
    for i, k, at in a:
        near = [(t, v) for kk, t, v in b if kk == k and k is not None and at and t <= at]
        back[i] = max(near)[1] if near else None
        later = [((t - at).total_seconds(), v) for kk, t, v in b if kk == k and k is not None and at and 0 < (t - at).total_seconds() <= 90]
        ahead[i] = min(later) if later else (None, None)
    for width in (10, 500, 10**6):
        got = intervals.last_before(left, right, "k", "id", "at", "then", F.col("v"), "got", "v", width)
        assert {r.id: r.got for r in got.collect()} == back
        got = intervals.first_within(left, right, "k", "id", "at", "then", 90, "v", width)
        assert {r.id: (r.delay, r.v) for r in got.collect()} == ahead
