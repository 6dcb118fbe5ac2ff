import random
import re

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import mixing as mx


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def make(spark, n=900, seed=3):
    rng = random.Random(seed)
    rows = [(i, " ".join(f"w{rng.randrange(999)}" for _ in range(rng.choice([0, 3, 40, 200]))), rng.choice(["b", "b", "b", "a", "é", None, "Z"]), "x") for i in range(n)]
    rows += [(n, None, "a", "x"), (n + 1, "", "only-empty", "x"), (n + 2, "long " * 30_000, "c", "x"), rows[5], rows[5], (None, "one two", "a", "x")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, size string").repartition(4)


def test_targets():
    """Against resharing step by step."""
    s = mx.set_targets([(None, 1000), ("b", 10), ("a", 1000), ("é", 300)])
    assert [x.name for x in s] == ["a", "b", "é", None]
    weight, cap, target = [3, 1, 2, 3], [2000, 20, 600, 2000], [0.0] * 4
    left = 1.5 * 2310
    while left > 1e-9:
        free = [i for i in range(4) if target[i] < cap[i] - 1e-9]
        add = {i: left * weight[i] / sum(weight[j] for j in free) for i in free}
        left = 0.0
        for i, x in add.items():
            left += max(0.0, target[i] + x - cap[i])
            target[i] = min(cap[i], target[i] + x)
    assert np.allclose([x.target for x in s], target)
    assert abs(sum(target) - 1.5 * 2310) < 1e-6


def test_permutations():
    for n in (1, 2, 3, 17, 1000, 4097):
        got = [mx.permute(np.arange(n), n, k) for k in (1, 2)]
        assert all(sorted(g.tolist()) == list(range(n)) for g in got)
        assert mx.permute(got[0], n, 1, back=True).tolist() == list(range(n))
    assert (got[0] != got[1]).any()


def test_counts(spark):
    rows, df = make(spark)
    got = mx.counts(df, block=16, shards=5).collect()
    assert len(got) == len(rows)
    again = mx.counts(df.repartition(7), block=16, shards=5).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    size = {}
    for _, t, s, _ in rows:
        size[s] = size.get(s, 0) + len(words(t))
    source = {r[0]: r[2] for r in rows}
    taken = {}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == size[s] and 0 <= r.taken <= 2 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    want = {s.name: s.target for s in mx.set_targets(list(size.items()))}
    for r in got:
        assert r.target == want[source[r.doc_id]]
    for s in size:
        assert abs(taken[s] - want[s]) <= 1, (s, taken[s], want[s])


def test_slots_and_blocks(spark):
    """The mix, slot by slot, against blocks packed one after another."""
    rows, df = make(spark, 300)
    sources, placed, _ = mx.plan(df, block=16, shards=5)
    streams = {}
    text = {(r[0], r[1]): words(r[1]) for r in rows}
    marks = {r.mark: (r.doc_id, r.text) for r in df.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("mark")).collect()}
    for r in sorted(placed.collect(), key=lambda r: (r.ix, r.start, r.size)):
        streams.setdefault(r.ix, []).extend(text[marks[r.mark]])
    got = {(r.shard, r.source, r.slot): r for r in mx.blocks(df, block=16, shards=5).collect()}
    all_slots = mx.slots(spark, sources, 5, 16).collect()
    assert len(got) == len(all_slots)
    used = {}
    for s in all_slots:
        r = got[s.shard, sources[s.ix].name, s.slot]
        have = [w for p in r.parts for w in text[marks[p.mark]][p["first"] : p["first"] + p.words]]
        assert have == streams[s.ix][16 * s.number : 16 * (s.number + 1)][: s.words]
        used.setdefault((s.ix, s.time), []).append(s.number)
    assert all(len(u) == len(set(u)) for u in used.values())
    shares = np.array([x.slots for x in sources]) / sum(x.slots for x in sources)
    for shard in range(5):
        mine = np.array([sum(s.shard == shard and s.ix == i for s in all_slots) for i in range(len(sources))])
        assert np.abs(mine / mine.sum() - shares).max() < 0.1


def test_documents(spark):
    rows, df = make(spark, 300)
    df = df.withColumn("n_chars", F.length("text").cast("long"))
    out = mx.mixed_documents(df, block=16, shards=5)
    assert out.columns == df.columns
    per = {}
    for r in out.collect():
        assert r.n_chars == len(r.text)
        per.setdefault(r.doc_id, []).append(len(words(r.text)))
    want = {}
    for r in mx.counts(df, block=16, shards=5).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    assert {k: sum(v) for k, v in per.items()} == {k: v for k, v in want.items() if v}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mx.counts(df).count() == 0 and mx.mixed_documents(df).count() == 0
    none = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [r.taken for r in mx.counts(none).collect()] == [0, 0]


def test_one_text_in_two_sources(spark):
    """Rows that share id and text but not the source, or another column, keep what is theirs; many copies go through runs."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "s1", "x"), (1, text, "s2", "x"), (1, text, "s2", "y"), (None, text, "s1", "x"), (None, text, None, "x"), *[(7, text + " tail", "s1", "x")] * 25, (8, None, "s1", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mark string").repartition(5)
    copies, mx.COPIES = mx.COPIES, 4
    try:
        want, got = {}, {}
        size = {}
        for _, t, s, _ in rows:
            size[s] = size.get(s, 0) + len(words(t))
        for r in mx.counts(df, block=8, shards=3).collect():
            want[r.source_size] = want.get(r.source_size, 0) + r.taken
            assert r.taken <= 2 * r.size
        for r in mx.mixed_documents(df, block=8, shards=3).collect():
            got[size[r.source]] = got.get(size[r.source], 0) + len(words(r.text))
            assert (r.doc_id, r.source, r.mark) in {(a, c, d) for a, _, c, d in rows}
        assert got == want
        target = {size[s.name]: s.target for s in mx.set_targets(list(size.items()))}
        assert all(abs(got[k] - target[k]) <= 1 for k in target)
        assert mx.counts(df, block=8, shards=3).count() == len(rows)
    finally:
        mx.COPIES = copies
