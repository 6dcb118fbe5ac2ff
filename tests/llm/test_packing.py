import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestone.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, item string, piece int, length int"


def ids(text):
    return Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def checked(rows, got, capacity):
    """Every document's ids in pieces, no sequence too long, no gaps; returns the number of sequences."""
    want = []
    for doc_id, text in rows:
        own = [*(ids(text) if text else []), 0]
        for i in range(0, len(own), capacity):
            part = np.array(own[i : i + capacity], "<u4")
            want.append((doc_id, i // capacity, i, len(part), zlib.crc32(part.tobytes())))
    some = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(some, want)) == sorted(some(r[:5]) for r in got)
    full = {}
    for r in got:
        full.setdefault(r[5], []).append((r[6], r[3]))
    for places in full.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(full)


def run(spark, rows, capacity=2048):
    df = spark.createDataFrame([(*r, "x", 1, 1) for r in rows], SCHEMA).repartition(3)
    got = packing.packed(df, PATH, capacity=capacity)
    return [tuple(r) for r in got.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").collect()]


def test_documents(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["Packing", "of", "düne", "x1,2", "«a»", "don't", "中文", "<|endoftext|>", "́e", "a\xa0b"]) for _ in range(rng.randint(1, 200)))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "long text " * 3000), (None, "no id"), rows[0], rows[0]]
    got = run(spark, rows)
    n = checked(rows, got, 2048)
    assert n == packing.least_bins(np.array([r[3] for r in got]), 2048)
    assert sorted(got, key=str) == sorted(run(spark, rows), key=str)


def test_shards_of_many_levels(spark):
    rng = np.random.default_rng(1)
    lens = rng.integers(1, 65, 700)
    df = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lens)], "item long, length long").repartition(3).cache()
    got = packing.pack(df, 64, 150).collect()
    assert sorted(r.item for r in got) == list(range(700))
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, int(lens[r.item])))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 64
    assert len(by) <= 1.03 * packing.least_bins(lens, 64)


def test_equal_halves_and_empty(spark):
    df = spark.createDataFrame([(i, 33) for i in range(50)], "item long, length long")
    assert len({r.sequence_id for r in packing.pack(df, 64, 10).collect()}) == 50
    assert packing.pack(df.limit(0), 64).count() == 0
    assert run(spark, []) == []


def test_least_bins():
    def plain(lens, capacity):
        best = -(-sum(lens) // capacity)
        for small in range(capacity // 2 + 1):
            alone = sum(n > capacity - small for n in lens)
            large = [n for n in lens if capacity // 2 < n <= capacity - small]
            rest = sum(n for n in lens if small <= n <= capacity // 2) - (len(large) * capacity - sum(large))
            best = max(best, alone + len(large) + max(0, -(-rest // capacity)))
        return best

    rng = np.random.default_rng(5)
    for capacity in (10, 11, 64):
        for _ in range(60):
            lens = rng.integers(1, capacity + 1, rng.integers(1, 40))
            assert packing.least_bins(lens, capacity) == plain(lens.tolist(), capacity)


def test_breeding_beats_best_fit():
    # Bins of exactly three pieces each, which best fit alone does not find.
    rng = np.random.default_rng(2)
    lens = []
    for _ in range(60):
        a, b = sorted(rng.integers(200, 800, 2))
        lens += [a, 1000 - b if b - a < 200 else b - a, 0]
        lens[-1] = 1000 - lens[-2] - lens[-3] if lens[-2] + lens[-3] < 1000 else 1
    lens = -np.sort(-np.array([n for n in lens if n > 0]))
    kept = packing.first_packings(lens, None, 1000, 1)
    first = min(packing.fitness(k, lens) for k in kept)
    for turn in range(4):
        kept = packing.evolve(lens, kept, 1000, turn, 60)
    for k in kept:
        assert np.bincount(k, lens).max() <= 1000
    best = packing.fitness(kept[0], lens)
    assert best <= first and (best < first or best[0] == packing.least_bins(lens, 1000))


def test_child_keeps_every_piece_once():
    rng = np.random.default_rng(8)
    lens = -np.sort(-rng.integers(1, 64, 300))
    a, b = packing.first_packings(lens, None, 64, 3)[:2]
    for seed in range(20):
        c = packing.child(a, b, lens, 64, np.random.default_rng(seed))
        assert len(c) == 300 and np.bincount(c, lens).max() <= 64 and (np.bincount(c) > 0).all()


@pytest.mark.parametrize("window", [5, 1 << 20])
def test_encoder_equals_the_tokenizer(window, monkeypatch):
    monkeypatch.setattr(packing, "WINDOW", window)
    monkeypatch.setattr(packing, "MEMO", 50)
    model = open(PATH).read()
    encoder, plain = packing.Encoder(model), Tokenizer.from_str(model)
    rng = random.Random(1)
    letters = [*"abcXYZ019'stREvemlld  \t\n\x0b\x0c\r.,!?-_éÀßÿª²¼×÷µ\x85\xa0\x1c\x1f\x00\x7f\xad́İſςΣ中😀‍ﬁ　Ⅷ٣ᾳ", "<|endoftext|>", "'ll", "<|starto"]
    for _ in range(1500):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 14)))
        got = b"".join(encoder.windows(text.encode()))
        assert got == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text
