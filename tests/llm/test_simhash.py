import random
import re

import numpy as np
import xxhash

from lodestone.llm import simhash as sh


def brute_fp(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(fps):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    fs = sorted(root)
    for i, a in enumerate(fs):
        for b in fs[:i]:
            if bin(a ^ b).count("1") <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fs}


def test_spark_has_the_same_hash(spark):
    assert spark.sql("select xxhash64('a b c é')").first()[0] % 2**64 == xxhash.xxh64_intdigest("a b c é".encode(), 42)


def test_classes(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    base = [[word() for _ in range(rng.choice([3, 5, 60, 200]))] for _ in range(40)]
    some = ["", None, " \t", "One", "one", "É é", "x " * 9000]
    for w in base:
        some.append(" ".join(w))
        for _ in range(rng.randrange(4)):
            v = list(w)
            v[rng.randrange(len(v))] = word()
            some.append("  ".join(v))
    rows = [(i, t, "clash") for i, t in enumerate(some)] + [(7, some[7], "clash")]
    got = sh.classes(spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(5)).collect()
    assert len(got) == len(rows)
    fps = {i: brute_fp(t) for i, t in enumerate(some)}
    root = brute_classes(fps.values())
    least = {}
    for i, f in fps.items():
        least[root[f]] = min(i, least.get(root[f], i))
    for r in got:
        assert r.fp % 2**64 == fps[r.doc_id]
        assert r.component_id == least[root[fps[r.doc_id]]]
    kept = sh.representatives(spark.createDataFrame(rows, "doc_id long, text string, fp string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))


def test_trie_join(spark):
    """Dense clusters, where most pairs are linked, and random values."""
    rng = np.random.default_rng(2)
    values = [int(x) for x in rng.integers(0, 2**63, 300)]
    for _ in range(6):
        c = int(rng.integers(0, 2**63)) * 2 + 1
        values += [c ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 9), replace=False)) for _ in range(60)]
        values += [c ^ int(x) for x in rng.integers(0, 2**11, 150)]
    values = sorted(set(values))
    df = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in values], "fp long")
    got = sh.components(sh.links(df, len(values)).selectExpr("fp a", "to b")).collect()
    root = brute_classes(values)
    parts = {}
    for v, r in root.items():
        parts.setdefault(r, set()).add(v)
    ours = {}
    for r in got:
        ours.setdefault(r.root % 2**64, {r.root % 2**64}).add(r.node % 2**64)
    assert sorted(map(sorted, ours.values())) == sorted(sorted(p) for p in parts.values() if len(p) > 1)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert sh.classes(df).count() == 0
    nulls = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (None, "f g h"), (1, None)], "doc_id long, text string")
    assert sh.classes(nulls).count() == 4


def test_one_row_of_each_component(spark):
    """Also where ids are null or repeated."""
    words = [" ".join(f"{w}{i}" for i in range(300)) for w in ("alpha", "beta", "gamma", "delta")]
    near = [w.upper() for w in words]  # other texts of equal fingerprints
    rows = [(None, words[0]), (None, near[0]), (None, words[0]), (1, words[1]), (None, near[1]), (5, words[2]), (5, words[3]), (5, words[3]), (6, near[2])]
    kept = sh.representatives(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 1, 5, 5]
    assert {r.text for r in kept} - {words[0], near[0]} == set(words[1:])


def test_full_slots(spark):
    """Slots that are dealt on by more bits link as the others do, also where most values share their leading bits."""
    rng = np.random.default_rng(7)
    values = [int(x) for x in rng.integers(0, 2**40, 250)] + [int(x) for x in rng.integers(0, 2**63, 100)]
    for _ in range(8):
        c = int(rng.integers(0, 2**44))
        values += [c ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for _ in range(40)]
    values = sorted(set(values))
    df = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in values], "fp long")
    root, full = brute_classes(values), sh.FULL
    try:
        for sh.FULL in (10, 100):
            got = sh.components(sh.links(df, len(values)).selectExpr("fp a", "to b")).collect()
            ours = {}
            for r in got:
                ours.setdefault(r.root % 2**64, {r.root % 2**64}).add(r.node % 2**64)
            parts = {}
            for v, r in root.items():
                parts.setdefault(r, set()).add(v)
            assert sorted(map(sorted, ours.values())) == sorted(sorted(p) for p in parts.values() if len(p) > 1)
    finally:
        sh.FULL = full


def test_slots_are_walked_a_few_at_a_time(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 400, np.uint64)
    near = base[:150] ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64))
    fps = [(int(x),) for x in np.unique(np.concatenate([base, near]).view(np.int64))]
    df = spark.createDataFrame(fps, "fp long")
    whole = {r.node: r.root for r in sh.components(sh.links(df, len(fps)).toDF("a", "b")).collect()}
    monkeypatch.setattr(sh, "TOGETHER", 20)
    monkeypatch.setattr(sh, "TASK_ROWS", 50)
    assert {r.node: r.root for r in sh.components(sh.links(df, len(fps)).toDF("a", "b")).collect()} == whole
    assert len(whole) >= 150


def test_columns_named_as_the_marks(spark):
    df = spark.createDataFrame([(1, "a b c d e", 5, 6), (2, "a b c d e", 7, 8), (3, "x y z u v", 9, 9)], "doc_id long, text string, _mark int, _mark2 int")
    got = sh.representatives(df)
    assert got.columns == df.columns and sorted(map(tuple, got.collect())) == [(1, "a b c d e", 5, 6), (3, "x y z u v", 9, 9)]
