"""Pairs over a floor, clusters by rounds and rollups against plain Python."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from lodestone.operators import mining
from lodestone.operators.rollups import Rollup


def cosines(texts):
    count = {i: Counter(t.split()) for i, t in texts.items()}
    df = Counter(w for c in count.values() for w in c)
    v = {i: {w: (1 + math.log(n)) * (math.log((1 + len(texts)) / (1 + df[w])) + 1) for w, n in c.items()} for i, c in count.items()}
    v = {i: {w: x / math.sqrt(sum(y * y for y in c.values())) for w, x in c.items()} for i, c in v.items() if c}
    return {(a, b): sum(x * v[b].get(w, 0) for w, x in v[a].items()) for a in v for b in v if a < b}


def test_pairs_over_a_floor_are_all_found(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(30)]
    rows = [(g, i, " ".join(["the"] * rng.randrange(4) + [words[min(29, int(rng.expovariate(0.15)))] for _ in range(rng.randrange(0, 9))])) for g in range(3) for i in range(45)]
    df = spark.createDataFrame(rows, "g long, id long, text string")
    terms = F.filter(F.split("text", " "), lambda w: w != "")
    for floor in (0.15, 0.45, 0.9):
        got = {(r.g, r.a, r.b): r.cosine for r in mining.tfidf_over(df, "id", terms, "g", floor).collect()}
        want = {(g, *p): c for g in range(3) for p, c in cosines({i: t for h, i, t in rows if h == g}).items() if c > floor + 1e-9}
        assert want.keys() <= got.keys() and all(abs(got[k] - want.get(k, floor)) < 1e-9 for k in got)
        assert len(want) > 10


def test_greedy_clusters_by_rounds(spark):
    rng = random.Random(7)
    items = [(g, i) for g in range(4) for i in range(40)]
    pairs = [(g, a, b, 0.5) for g in range(3) for a in range(40) for b in range(a + 1, 40) if rng.random() < (0.03, 0.1, 1.0)[g] or (g == 0 and b == a + 1)]
    got = {(r.g, r.id): r.cluster for r in mining.greedy_clusters(spark.createDataFrame(items + items[:5], "g long, id long"), spark.createDataFrame(pairs + [(0, 0, 39, 0.45)], "g long, a long, b long, cosine double"), "id", "g").collect()}
    near = {(g, a, b) for g, a, b, _ in pairs}
    want = {}
    for g, i in items:
        if (g, i) not in want:
            want |= {(g, j): i for j in range(i, 40) if (g, j) not in want and (j == i or (g, i, j) in near)}
    assert got == want


def test_rollups_equal_recomputing(spark, tmp_path):
    rng = random.Random(1)
    rollup = Rollup(spark, f"{tmp_path}/r", ["k"], ["v"], "u")
    assert rollup.read() is None
    rows = []
    for number in range(10):
        some = [(rng.choice("ab") if rng.random() < 0.9 else None, rng.randrange(100), rng.randrange(6)) for _ in range(20)]
        rows += some
        for _ in range(2):  # a batch that comes again counts once
            rollup.add(spark.createDataFrame(some, "k string, v long, u long"), number)
    got = {r.k: (r.n, r.v_sum, r.v_least, r.v_most, r.kinds) for r in rollup.read().collect()}
    for k in ("a", "b", None):
        v = [x for x in rows if x[0] == k]
        assert got[k] == (len(v), sum(x[1] for x in v), min(x[1] for x in v), max(x[1] for x in v), len({x[2] for x in v}))


def test_average_linkage_by_rounds(spark):
    rng = random.Random(11)
    sizes, pairs = {0: 12, 1: 7, 2: 3, 3: 1, 4: 9}, []
    for g, n in sizes.items():
        pairs += [(g, a, b, rng.random()) for a in range(n) for b in range(a + 1, n) if g != 4 or rng.random() < 0.12]
    items = [(g, i) for g, n in sizes.items() for i in range(n)]
    for k in (1, 2, 3, 5):
        df = spark.createDataFrame(pairs, "g long, a long, b long, cosine double")
        got = {(r.g, r.id): r.cluster for r in mining.linkage(spark.createDataFrame(items, "g long, id long"), df, "id", "g", F.lit(k)).collect()}
        for g, n in sizes.items():
            groups, s = [[i] for i in range(n)], {(a, b): c for h, a, b, c in pairs if h == g}
            mean = lambda x, y: sum(s.get((min(a, b), max(a, b)), 0) for a in x for b in y) / len(x) / len(y)  # noqa: E731, B023
            while len(groups) > k:
                _, i, j = min((-mean(x, y), i, j) for i, x in enumerate(groups) for j, y in enumerate(groups) if i < j)
                groups[i] += groups.pop(j)
            assert {i: got[g, i] for i in range(n)} == {i: min(x) for x in groups for i in x}, (g, k)


def test_sums_over_64_bits(spark, tmp_path):
    rollup, big = Rollup(spark, f"{tmp_path}/r", ["k"], ["v"]), 1 << 61
    for number in range(20):  # merged twice on the way
        rollup.add(spark.createDataFrame([("a", big)] * 5, "k string, v long"), number)
    assert [(r.n, int(r.v_sum), r.v_most) for r in rollup.read().collect()] == [(100, 100 * big, big)]
