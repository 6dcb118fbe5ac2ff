import os
import random

import pytest

from lodestone.llm import sentencepiece as sp

pytestmark = pytest.mark.skipif(not os.path.exists(sp.DEFAULT_MODEL), reason="no model file here")
SOME = ["the cat", "", None, " lead", "trail ", "a  b   c", "naïve 漢字 \U0001f600\n\nnew\tline", "x" * 300, " ", "\u0000\u0001", "The quick brown fox, jumps! 12345 éèüß �"]


@pytest.fixture(scope="module")
def raw():
    with open(sp.DEFAULT_MODEL, "rb") as f:
        return f.read()


def brute(m: sp.Unigram, text: str) -> list[int]:
    """Viterbi over the whole text with a plain dictionary."""
    norm = (sp.MARK if m.dummy_prefix else "") + text.replace(" ", sp.MARK)
    pieces = m._plain
    best, back = [0.0] + [float("-inf")] * len(norm), [None] * (len(norm) + 1)
    for end in range(1, len(norm) + 1):
        for start in range(max(0, end - m.longest), end):
            p = norm[start:end]
            score = m.scores[pieces[p]] if p in pieces else m.unknown_score if end - start == 1 else None
            if score is not None and best[start] + score > best[end]:
                best[end], back[end] = best[start] + score, start
    out, at = [], len(norm)
    while at:
        p = norm[back[at] : at]
        out = ([pieces[p]] if p in pieces else [int(m.bytes[b]) for b in p.encode()]) + out
        at = back[at]
    return out


@pytest.fixture(scope="module")
def model(raw):
    m = sp.Unigram(raw)
    skip = set(m.bytes.tolist()) | {0, 1, 2}
    m._plain = {p: i for i, p in enumerate(m.pieces) if i not in skip}
    return m


def test_brute_force(model):
    rng = random.Random(3)
    for t in [*SOME, *("".join(rng.choice("thean \nioé#") for _ in range(80)) for _ in range(40))]:
        ids, cuts = model.encode([t])
        assert ids.tolist() == (brute(model, t) if t else [])
        assert cuts.tolist() == [0, len(ids)]


def test_against_the_library(raw, model):
    """The installed library, told that the same pieces are a unigram model, finds no better path, and decodes ours."""
    lib = pytest.importorskip("sentencepiece")
    out, i = bytearray(), 0
    while i < len(raw):  # trainer_spec.model_type: 2 to 1
        key, j = sp._varint(raw, i)
        n, k = sp._varint(raw, j)
        part = raw[k : k + n]
        if key >> 3 == 2:
            at = part.index(b"\x18\x02")
            part = part[:at] + b"\x18\x01" + part[at + 2 :]
        out += raw[i:k] + part
        i = k + n
    native = lib.SentencePieceProcessor(model_proto=bytes(out))
    for t in ["the cat sat on the mat", "Hello, World 42", "naïve café 漢字", "thntblere of then, edtioner in inea"]:
        ours, theirs = model.encode([t])[0].tolist(), native.encode(t)
        assert native.decode(ours) == t
        assert model.scores[ours].sum() >= model.scores[theirs].sum()


def test_round_trip(spark, raw):
    import numpy as np

    rows = [(i, t, "clash") for i, t in enumerate([*SOME, SOME[0], "word " * 50_000])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    m = sp.load(spark)
    got = {r.doc_id: r for r in sp.round_trip(df, m).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        assert got[i].decoded == t
        assert got[i].n_tokens == len(got[i].ids or [])
    assert got[2].ids is None and got[1].ids == []
    enc = sp.encode(df, m)
    back = {r.doc_id: r.text for r in sp.decode(enc, m).collect()}
    assert back == {i: t for i, t, _ in rows}
    assert sp.round_trip(df.limit(0), m).count() == 0
    assert m.value.decode(np.array([m.value.bytes[255], m.value.bytes[65]]), np.array([0, 2])) == ["�A"]


def test_long_texts_without_white_space(model):
    """Windows against plain Viterbi, whatever the window; and a large text in few bytes a character."""
    rng = random.Random(4)
    some = ["".join(rng.choice("thean漢é01=/+") for _ in range(n)) for n in (1, 17, 200, 900)]
    long, window = sp.LONG, sp.WINDOW
    try:
        sp.LONG = 0
        for sp.WINDOW in (1, 5, 64, 1 << 16):
            for t in some:
                model.forget()
                assert model.encode([t])[0].tolist() == brute(model, t)
        sp.LONG, sp.WINDOW = long, window
        import tracemalloc

        text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ0123456789+/", k=100_000)) + "漢" * 1000
        model.forget()
        tracemalloc.start()
        ids, cuts = model.encode([text])
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert model.decode(ids, cuts) == [text] and peak < 200 * len(text)
    finally:
        sp.LONG, sp.WINDOW = long, window
