import random
import re

import corpus_pipeline as cp
from lodestone.llm import mixing
from tests.llm.test_langid import make
from tests.llm.test_simhash import brute_classes, brute_fp


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_stages(spark, tmp_path):
    """Each stage against a plain version on its own input."""
    rng = random.Random(12)
    rows = []
    for i in range(400):
        lang = rng.choice(["aa", "bb", "cc"])
        t = make(lang, rng, rng.choice([30, 90]))
        if rng.random() < 0.2:
            t += f" {rng.randrange(9)}a@mail.example.com and +1 (555) 555-{rng.randrange(1000, 9999)}"
        rows.append((i, t, lang, rng.choice(["s1", "s1", "s2", None]), len(t)))
        if rng.random() < 0.2:
            rows.append((1000 + i, t, lang, "s2", len(t)))
    rows += [(5000, "漢字仮名交じり文は日本語です" * 5, None, "s1", 70), (5001, None, None, None, None), (5002, "123 ##", None, "s1", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    at, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in cp.STAGES:
        out = stage(spark, at, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(at.collect())
        if name != "tokens":
            assert tuple(at.columns) == cp.COLUMNS
    lang, dedup, private, mixed, tokens = seen
    assert {r.doc_id for r in lang} == {r[0] for r in rows} - {5000, 5001, 5002}
    root = brute_classes({brute_fp(r.text) for r in lang})
    least = {}
    for r in lang:
        k = root[brute_fp(r.text)]
        least[k] = min(r.doc_id, least.get(k, r.doc_id))
    assert sorted(r.doc_id for r in dedup) == sorted(least.values())
    before = {r.doc_id: r.text for r in dedup}
    for r in private:
        plain = re.sub(r"\+1 \(555\) 555-\d{4}", "[PHONE]", re.sub(r"\da@mail\.example\.com", "[EMAIL]", before[r.doc_id]))
        assert r.text == plain and r.n_chars == len(plain)
    assert len(private) == len(dedup)
    source = {r.doc_id: r.source for r in private}
    size, got = {}, {}
    for r in private:
        size[r.source] = size.get(r.source, 0) + len(words(r.text))
    whole = {r.doc_id: r.text for r in private}
    for r in mixed:
        got[r.source] = got.get(r.source, 0) + len(words(r.text))
        assert r.source == source[r.doc_id] and all(p in whole[r.doc_id] for p in words(r.text))
    want = {s.name: s.target for s in mixing.set_targets(list(size.items()))}
    assert all(abs(got[s] - want[s]) <= 1 for s in want)
    assert sorted((r.doc_id, r.decoded) for r in tokens) == sorted((r.doc_id, r.text) for r in mixed)
    run = cp.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, tuple(r.ids)) for r in run) == sorted((r.doc_id, tuple(r.ids)) for r in tokens)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
