"""Indexes in segments and by pivots, and streams of several batches, against plain Python."""

import random
import re
import uuid

import numpy as np
from pyspark.sql import functions as F

from lodestone.operators.index import TermIndex
from lodestone.operators.pivots import PivotIndex
from lodestone.operators.segments import And, Not, Or, Phrase, Prefix, Segments, Term, postings
from lodestone.streaming import changes

WORDS = "red green blue Fox fox_1 hen the of and river".split()


def text(rng):
    return ", ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 25)))


def tokens(t):
    return [w.lower() for w in re.findall("[A-Za-z0-9_]+", t or "")]


def held(index):
    return {(r.term, r.id): list(r.places) for r in index.rows().collect()}


def full(docs):
    out = {}
    for i, t in docs.items():
        for place, w in enumerate(tokens(t)):
            out.setdefault((w, i), []).append(place)
    return out


def test_updates_equal_a_full_build(spark, tmp_path):
    rng = random.Random(3)
    index, docs = Segments(spark, f"{tmp_path}/i"), {}
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert index.rows().count() == 0 and index.matching(Term("red")).count() == 0
    for step in range(7):
        some = {rng.randrange(60): text(rng) for _ in range(40 if not step else 3)}
        gone = [rng.randrange(60) for _ in range(2 if step else 0)]
        gone = [g for g in gone if g not in some]
        index.update(frame([*some.items(), (None, "none")]), frame([(g, None) for g in gone]) if gone else None)
        docs = {k: v for k, v in docs.items() if k not in gone} | some
    assert held(index) == full(docs)
    state = index.state()
    assert len(state["segments"]) < 7 and state["number"] == 7
    # An update writes rows of its own documents only.
    before = {s["name"] for s in state["segments"]}
    index.update(frame([(1, "one two three")]))
    docs[1] = "one two three"
    new = [s for s in index.state()["segments"] if s["name"] not in before]
    assert held(index) == full(docs) and (len(new) == 1)

    say = {i: tokens(t) for i, t in docs.items()}
    has = lambda w, p: any(w[i : i + len(p)] == p for i in range(len(w)))
    searches = {
        And(Term("Red"), Term("hen")): lambda w: "red" in w and "hen" in w,
        Or(Phrase(("the", "of")), Phrase(("fox", "fox", "red"))): lambda w: has(w, ["the", "of"]) or has(w, ["fox", "fox", "red"]),
        And(Prefix("fo"), Not(Or(Term("blue"), Phrase(("of", "and"))))): lambda w: any(x.startswith("fo") for x in w) and not ("blue" in w or has(w, ["of", "and"])),
        Term("absent"): lambda w: False,
        Phrase(("red", "red")): lambda w: has(w, ["red", "red"]),
    }
    for tree, plain in searches.items():
        assert {r.id for r in index.matching(tree).collect()} == {i for i, w in say.items() if plain(w)}, tree


def test_pivots_find_what_a_scan_finds(spark, tmp_path):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8)) * 4
    x = np.concatenate([c + rng.normal(size=(50, 8)) * 0.2 for c in centres])
    rows = [(i, [float(z) for z in v]) for i, v in enumerate(x)] + [(9000, rows_ := [float(z) for z in x[3]]), (9001, None), (9002, [0.0] * 8), (None, rows_)]
    index = PivotIndex.build(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), f"{tmp_path}/p")
    index.remove(spark.createDataFrame([(i,) for i in range(0, 600, 5)], "vec_id long"))
    there = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if i is not None and v and any(v) and not (i < 600 and i % 5 == 0)}
    for q, k, floor in ((x[3], 10, -1.0), (x[77], 60, 0.5), (rng.normal(size=8), 7, -1.0), (x[5], 1000, -1.0), (x[9], 3, 0.9999)):
        unit = q / np.linalg.norm(q)
        want = [(i, s) for s, i in sorted((-round(float(v @ unit), 12), i) for i, v in there.items()) if -s >= floor][:k]
        got = [(r.id, r.score) for r in index.search([float(z) for z in q], k, floor).collect()]
        assert len(got) == len(want) and np.allclose([s for _, s in got], [-s for _, s in want])
        assert {i for i, _ in got} == {i for i, _ in want}
    unit = x[3] / np.linalg.norm(x[3])
    to = np.sqrt(((index.pivots - unit) ** 2).sum(1))
    all_rows = spark.read.parquet(f"{tmp_path}/p/vectors")
    assert all_rows.filter(index.rings(to, 0.2)).count() < all_rows.count() / 3  # a cluster's rings, not all
    empty = PivotIndex.build(spark.createDataFrame([], "vec_id long, embedding array<double>"), f"{tmp_path}/e")
    assert empty.search([1.0, 0.0]).count() == 0


def test_streams_of_several_files(spark, tmp_path):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["a", "b", ""])) for c in range(9) for t in range(rng.randrange(1, 12))]
    schema = "conv_id long, turn long, text string"
    folder = f"{tmp_path}/conversations.parquet"
    for part in (0, 1):  # the later turns come in a later batch
        spark.createDataFrame([r for r in rows if (r[1] >= 6) == bool(part)], schema).coalesce(1).write.mode("append").parquet(folder)
        got = None
        feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        query = changes.stateful_turns(feed).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        got = {(r.conv_id, r.turn): (r.seen, r.repeats) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {}
    for c, t, x in rows:
        last = [z for cc, tt, z in rows if cc == c and tt < t][-3:]
        want[c, t] = (t, last.count(x))
    assert got == want


def test_streamed_table_keeps_the_latest_over_batches(spark, tmp_path):
    rows = [(i % 7, i, f"r{i}") for i in range(60)]
    random.Random(1).shuffle(rows)
    folder = f"{tmp_path}/events.parquet"
    for i in range(0, 60, 20):
        spark.createDataFrame(rows[i : i + 20], "k long, at long, v string").coalesce(1).write.mode("append").parquet(folder)
    merge = changes.merge_batches(f"{tmp_path}/t-{uuid.uuid4().hex}", "k", "at", buckets=4)
    feed = spark.readStream.schema("k long, at long, v string").option("maxFilesPerTrigger", 1).parquet(folder)
    feed.writeStream.foreachBatch(merge).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert {r.k: r.at for r in merge.read(spark).collect()} == {k: max(a for kk, a, _ in rows if kk == k) for k in range(7)}


def test_postings_of_long_empty_and_null_texts(spark):
    words = [f"w{i % 700}" for i in range(9000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, ""), (3, None), (None, "a b"), (4, "the The the x")], "doc_id long, text string")
    got = {(r.id, r.term): (r.words, r.places) for r in postings(docs, "doc_id", "text").collect()}
    want = {(1, w): (9000, [i for i in range(9000) if words[i] == w]) for w in set(words)}
    assert got == want | {(4, "the"): (4, [0, 1, 2]), (4, "x"): (4, [3])}


def test_postings_stay_where_their_document_is(spark, tmp_path):
    """Files sorted by term, and all postings of a document in one of them: they were dealt out by ranges of terms."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + j) % 90}" for j in range(i % 23))) for i in range(200)] + [(900, None), (901, "")], "doc_id long, text string").repartition(3)
    TermIndex.build(docs, f"{tmp_path}/index")
    segments = Segments(spark, f"{tmp_path}/segments")
    segments.update(docs)
    parts = [f"{tmp_path}/index/postings", f"{tmp_path}/segments/{segments.state()['segments'][0]['name']}"]
    for part in parts:
        rows = spark.read.parquet(part).select("term", "id", F.input_file_name().alias("file"))
        files = [r.file for r in rows.select("file").distinct().collect()]
        assert len(files) > 1 and rows.select("id", "file").distinct().count() == rows.select("id").distinct().count() == sum(i % 23 > 0 for i in range(200))
        for f in files:
            got = [(r.term, r.id) for r in spark.read.parquet(f).select("term", "id").coalesce(1).collect()]
            assert got == sorted(got)
