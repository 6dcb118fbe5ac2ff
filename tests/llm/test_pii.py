import hashlib
import random
import re

from pyspark.sql import functions as F

from lodestone.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    x = [int(c) for c in reversed(d)]
    return (sum(x[::2]) + sum(sum(divmod(2 * c, 10)) for c in x[1::2])) % 10 == 0


def holds(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if holds(k, m.group())]


def card(rng, good=True):
    while True:
        d = "".join(rng.choice("0123456789") for _ in range(16))
        if luhn(d) == good:
            return d


def make(rng):
    word = lambda: "".join(rng.choice("abcdeéü") for _ in range(5))
    out = []
    for _ in range(rng.randrange(3, 40)):
        out.append(rng.choice([word, word, word, word, lambda: f"{word()}.{rng.randrange(99)}@mail{rng.randrange(9)}.example.com", lambda: ".".join(str(rng.randrange(300)) for _ in range(4)), lambda: card(rng), lambda: card(rng, False), lambda: f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}", lambda: "a@b.c_d@e.f", lambda: "1.2.3.4.5.6.7.8", lambda: "+1.2-3", lambda: "\x01\x02", lambda: "😀"])())
    return rng.choice([" ", "\n", "!! "]).join(out)


def test_base_and_added_spans(spark):
    rng = random.Random(9)
    good, good2, bad = card(rng), card(rng), card(rng, False)
    some = [make(rng) for _ in range(150)] + [None, "", "a" * 60_000, "9" * 60_000, "a@" * 30_000, "1 " * 30_000, "+1" + "." * 30_000, "x " * 10 + f"{good} {good2} z", f"{bad} {good}", f"+1 (826) 555-4081 190.137.223.204 x {bad}", "id 1234-5678 nothing", "Dear Dr. Maria Lopez, patient"]
    rows = [(i, t, "clash") for i, t in enumerate(some)] + [(0, some[0], "clash")]
    got = pii.digest(spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(4)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute(some[r.doc_id])
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest(), (some[r.doc_id], r)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in want) for x in PLAIN]
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))
    by = {r.doc_id: [(s.split(":")[0], *map(int, s.split(":")[1:])) for s in r.spans.split(",") if s] for r in got}
    found = lambda i: [some[i][a:b] for _, a, b in by[i]]
    n = len(some)
    assert found(n - 5) == [good, good2]
    assert found(n - 4) == [good]
    assert found(n - 3) == ["190.137.223.204", "+1 (826) 555-4081"]
    assert found(n - 2) == []


def test_redaction(spark):
    rows = [(1, "mail a.b@c.de now", "en", 3), (2, None, "en", 0), (3, "clean", None, 5), (4, "é +1 (826) 555-4081 and 1.2.3.4 😀 x@y.zz!", "en", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_chars long")
    got = {r.doc_id: r for r in pii.redact(df).collect()}
    assert [got[i].text for i in (1, 2, 3, 4)] == ["mail [EMAIL] now", None, "clean", "é [PHONE] and [IP] 😀 [EMAIL]!"]
    assert got[1].n_chars == 16 and got[3].spans is None and got[1].spans == "en"


def test_estimate_finds_the_bad_labeler():
    """Votes of five labelers of known reliability on hidden classes."""
    rng = random.Random(2)
    right = (0.9, 0.95, 0.6, 0.85, 0.5)
    count = {}
    for _ in range(4000):
        c = rng.random() < 0.6
        v = tuple((1 if (rng.random() < r) == c else -1) if rng.random() < 0.8 else 0 for r in right)
        count[v] = count.get(v, 0) + 1
    _, got = pii.estimate([("k", v, n) for v, n in sorted(count.items())])
    assert all(abs(a - got["k", b]) < 0.05 for a, b in zip(right, pii.LABELERS, strict=True))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pii.digest(df).count() == 0 and pii.redact(df).count() == 0
    assert pii.detect(spark.createDataFrame([(None, "nothing")], "doc_id long, text string")).select(F.size("spans")).first()[0] == 0


def test_many_matches(spark):
    """A megabyte of digits in pairs and hundreds of kilobytes of cards and addresses: as plain search finds, in time that grows with the text."""
    import time

    rng = random.Random(11)
    good, bad = card(rng), card(rng, False)
    some = ["12a" * 350_000, f"{good}," * 20_000, f"1.2.3.4 {bad};" * 10_000, "a@b.cc " * 40_000, f"4{bad} z 123-45-6789 " * 10_000]
    df = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string").repartition(5)
    began = time.time()
    got = {r.doc_id: r for r in pii.digest(df).collect()}
    assert time.time() - began < 120
    for i, t in enumerate(some):
        want = brute(t) if i else []  # the plain patterns need quadratic time for the first, which has none
        assert [got[i][f"n_{k}"] for k in PLAIN] == [sum(k == x for k, *_ in want) for x in PLAIN]
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
    out = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert out[1] == "[CARD]," * 20_000 and out[3] == "[EMAIL] " * 40_000 and out[0] == some[0]


def test_places_and_overlaps(spark):
    """Marks in pieces of any length as in one; overlaps against all pairs."""
    rng = random.Random(5)

    def spans(n):
        cuts = sorted(rng.sample(range(300), 2 * n))
        return [(a, b) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]

    rows = [(i, spans(rng.choice([0, 1, 5, 40])), sorted(spans(rng.choice([0, 1, 5])) + spans(rng.choice([0, 9])))) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, base array<struct<start:bigint,end:bigint>>, more array<struct<start:bigint,end:bigint>>")
    for r in df.select("i", pii.apart(F.col("more"), F.col("base")).alias("a")).collect():
        _, base, more = rows[r.i]
        assert [tuple(x) for x in r.a] == [c for c in more if not any(b[0] < c[1] and c[0] < b[1] for b in base)]
    some = ["".join(rng.choice("aé😀\n\x01\x02") for _ in range(rng.choice([0, 1, 5, 600]))) for _ in range(40)]
    piece = pii.PIECE
    try:
        for pii.PIECE in (1, 3, 512):
            got = spark.createDataFrame(list(enumerate(some)), "i int, t string").select("i", pii.mark_places(F.col("t")).alias("p")).collect()
            for r in got:
                assert r.p == [k - sum(c in "\x01\x02" for c in some[r.i][:k]) for k, c in enumerate(some[r.i]) if c in "\x01\x02"]
    finally:
        pii.PIECE = piece
