import random
import re

import numpy as np

from lodestone.llm import repetition as rep

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text, least):
    w = WORD.findall(text or "")

    def covered(m):
        seen = {}
        for i in range(len(w) - m + 1):
            seen.setdefault(tuple(w[i : i + m]), []).append(i)
        return len({i + j for at in seen.values() if len(at) > 1 for i in at for j in range(m)}), seen

    longest = max((m for m in range(least, len(w)) if covered(m)[0]), default=0)
    maximal = 0
    for m in range(least, longest + 1):
        for at in covered(m)[1].values():
            right = {tuple(w[i + m : i + m + 1]) or ("end", i) for i in at}
            left = {tuple(w[i - 1 : i]) if i else ("start", i) for i in at}
            maximal += len(at) > 1 and len(right) > 1 and len(left) > 1
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": covered(3)[0], "covered_words": covered(least)[0],
        "longest_repeat": longest, "n_maximal_repeats": maximal,
    }


def test_brute_force(spark):
    rng = random.Random(5)
    some = ["", None, "one", "a a a a a a a a a", "\n\n x \n x \ny\n", "é" * 9 + " ünï # | <b>", "a\x0bb\x1cc d", "w " * 3000]
    some += [" ".join(rng.choice("abcd") for _ in range(rng.randrange(60))) for _ in range(40)]
    some += ["\n".join(" ".join(rng.choice("abcdefghijkl") for _ in range(8)) for _ in range(9)) for _ in range(20)]
    passage = " ".join(f"p{i}" for i in range(70))
    plain = " ".join(f"w{i}" for i in range(400))
    some += [f"{plain} {passage} {plain[:9]} {passage}", plain, plain]
    rows = [(i, t, 1) for i, t in enumerate(some)]
    got = {r.doc_id: r.asDict() for r in rep.rules(spark.createDataFrame(rows, "doc_id long, text string, kept int"), 5).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        if t and t.startswith("w w w"):  # too long for brute force
            assert (got[i]["covered_words"], got[i]["longest_repeat"]) == (3000, 2999)
            continue
        want = brute(t, 5)
        assert {k: got[i][k] for k in want} == want, t
        n = want["n_words"]
        failed = n < 50 or 100 * want["n_repeat_words"] > 50 * n
        assert got[i]["base_failed"] == failed
        assert got[i]["kept"] == (not failed and want["covered_words"] <= 0.3 * n and want["longest_repeat"] <= 60)
    assert not got[len(some) - 3]["kept"] and got[len(some) - 1]["kept"]


def test_empty(spark):
    assert rep.rules(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_texts_count_word_by_word_alike(monkeypatch):
    rng = np.random.default_rng(3)
    words = [[b"%d" % w for w in rng.integers(0, k, n)] for k, n in ((2, 300), (9, 500), (40, 900), (1, 60), (5, 0))]
    want = rep.repeats(words)
    monkeypatch.setattr(rep, "WIDE", 10)
    got = rep.repeats(words)
    assert all((got[k] == want[k]).all() for k in want) and want["maximal"].sum() > 50
