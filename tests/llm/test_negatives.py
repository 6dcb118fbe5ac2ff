import math

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score string, row int"


def brute(rows):
    """Exact, with Python's whole numbers."""
    good = []
    for r in rows:
        if r[0] is None or r[1] is None or r[2] is None or any(x is None or not math.isfinite(x) for x in r[1]):
            continue
        good.append((r[0], (r[2] + 1) % 10 if r[0] % 7 == 0 else r[2], [math.floor(256 * float(np.float32(x))) for x in r[1]]))
    out = []
    for i, (a, la, va) in enumerate(good):
        if a % 50:
            continue
        near = [(-sum(x * y for x, y in zip(va, v, strict=True)), b, lb == la) for j, (b, lb, v) in enumerate(good) if j != i and len(v) == len(va)]
        for p, b, _ in sorted(x for x in near if x[2])[:5]:
            inside = sorted(x for x in near if not x[2] and 50 * -p <= 100 * -x[0] <= 95 * -p)[:3]
            out += [(a, b, k + 1, n, -p, -s) for k, (s, n, _) in enumerate(inside)]
    return sorted(out)


def run(spark, rows, parts=3, **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(parts)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = negatives.mine(negatives.rows(df, label=label), F.col("vec_id") % 50 == 0, **more)
    return sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def made(n, dim=12, seed=3, labels=3):
    rng = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in rng.normal(0.2, 0.4, dim)], int(rng.integers(labels))) for i in range(n)]


def test_equals_brute_force_with_odd_rows(spark):
    rows = made(700)
    rows += [(1000 + i, rows[50][1], 1) for i in range(60)]  # many ties
    rows += [rows[100], rows[100], rows[3]]  # repeated rows
    rows += [(5000, None, 1), (5050, [], 1), (5051, [], 1), (5100, [float("nan")] * 12, 1), (5150, [None] * 12, 1), (5200, [1.0] * 12, None), (None, [1.0] * 12, 1), (5250, [float("inf")] * 12, 0)]
    rows += [(6000, [1.0, 2.0], 1), (6001, [2.0, 2.0], 1), (6002, [1.0, 1.5], 2), (6100, [-1.0, 0.0], 1), (6101, [1.0, 0.0], 1)]
    want = brute(rows)
    assert want and run(spark, rows) == want


def test_many_passes_and_one_label_equal_one_pass(spark):
    rows = made(400, labels=2) + [(800 + i, [0.1] * 12, 0) for i in range(200)]
    want = brute(rows)
    assert run(spark, rows, block_bytes=500) == want == run(spark, rows, parts=1)


def test_numbers_beyond_doubles_stay_exact(spark):
    rows = [(0, [float(2**22), 1.0], 0), (1, [float(2**22), 2.0], 1), (2, [float(2**21), 1.0], 2), (3, [float(2**21), 2.0], 2), (4, [float(2**21), 2.0], 2)]
    assert run(spark, rows) == brute(rows) != []


def test_empty_and_lone(spark):
    assert run(spark, []) == []
    assert run(spark, [(50, [1.0], 1)]) == []
    assert run(spark, [(50, [1.0], 1), (51, [1.0], 2)]) == []
