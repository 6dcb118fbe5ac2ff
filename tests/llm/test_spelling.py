import zlib
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import spelling

DOCS = "doc_id long, text string, word string, n int, key long"


def near(a, b):
    """One inserted, deleted or replaced code point, by the plain table of edits."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1] == 1


def brute(counts):
    words = {w: n for w, n in counts.items() if n >= 2}
    out = {}
    for w, n in words.items():
        found = sorted((-m, v) for v, m in words.items() if near(w, v))
        form = found[0] if found and -found[0][0] >= 10 * n else None
        out[w] = [form[1] if form else None, None, n, len(found), -form[0] if form else None]
    for w, x in out.items():
        at = w
        while out[at][0]:
            at = out[at][0]
        x[1] = at
    return {w: tuple(x) for w, x in out.items()}


def runs(text):
    run = ""
    for c in (text or "") + " ":
        if "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ÿ":
            run += c.lower() if c < "a" else c
        elif run:
            yield run
            run = ""


def counted(rows):
    out = Counter()
    for doc_id, text in rows:
        for run in runs(text):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                out[run] += 1
    return out


def result(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_documents_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    base = ["".join(rng.choice(list("abéÀÿ×"), rng.integers(6, 10))) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(base, 120)) + "-Straßen,ÉCOLES9Übungen") for i in range(60)]
    rows += [(None, "wordword wordword"), (7, None), (8, ""), (9, "q" * 300 + " " + "q" * 299 + " "), (9, "q" * 300 + " " + "q" * 299), rows[0], rows[0]]
    df = spark.createDataFrame([(*r, "x", 1, 1) for r in rows], DOCS).repartition(3)
    want = brute(counted(rows))
    assert result(spelling.variants(spelling.words(df))) == want
    assert sum(x[3] > 0 for x in want.values()) > 20


@pytest.mark.parametrize("long", [96, 8])
def test_words_with_chains_ties_and_long_ones(spark, long):
    counts = {"abcdefghi": 3000, "abcdefgh": 300, "abcdefgx": 30, "abcdefx": 3, "abcdxfgh": 30, "zbcdefgh": 29, "aaaaaaa": 50, "aaaaaaaa": 2, "aaaaaaaaa": 500, "qqqqqqq": 2, "qqqqqqr": 20, "qqqqqqb": 20}
    counts |= {"l" * 200: 5, "l" * 199: 60, "l" * 100 + "m" + "l" * 99: 6, "😀" * 97: 2, "😀" * 96: 40}
    counts |= {"abcdef" + chr(c) + "hij": 2 for c in range(0xE0, 0xFF)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    got = result(spelling.variants(df, long=long))
    assert got == brute(counts)
    assert got["abcdefx"][1] == "abcdefghi" and got["qqqqqqq"][0] == "qqqqqqb"


def test_equal_keys_of_other_strings_are_told_apart():
    rows = [(2, "abcd", 5), (2, "abxd", 9), (1, "wxyz", 4), (1, "wayz", 4), (spelling.OWN, "abd", 3)]
    assert sorted(spelling.neighbours(rows)) == sorted(
        [("abcd", 1, 9, "abxd"), ("abxd", 1, 5, "abcd"), ("wxyz", 1, 4, "wayz"), ("wayz", 1, 4, "wxyz"), ("abd", 2, 9, "abxd"), ("abcd", 1, 3, "abd"), ("abxd", 1, 3, "abd")]
    )


def test_hashes_of_deletions_are_those_of_the_words():
    rng = np.random.default_rng(2)
    points = rng.integers(97, 123, (50, 9))
    _, without = spelling.hashes(points)
    for i in range(9):
        assert (spelling.hashes(np.delete(points, i, 1))[0] == without[:, i]).all()


def test_text_windows(spark, monkeypatch):
    rows = [(i, "lettersonly andmoreletters " * 40) for i in range(3)]
    want = counted(rows)
    monkeypatch.setattr(spelling, "WINDOW", 7)
    batch = spark.createDataFrame(rows, "doc_id long, text string").toArrow().to_batches()
    got = Counter()
    for b in spelling._count(7, 31)(iter(batch)):
        got.update(dict(zip(*(x.to_pylist() for x in b.columns), strict=True)))
    assert got == want


def test_empty(spark):
    df = spark.createDataFrame([], DOCS)
    assert result(spelling.variants(spelling.words(df))) == {}
