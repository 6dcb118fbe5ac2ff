"""Mixing sources to target weights.

Each source's words stand in one row, document after document, and are packed
into blocks of fixed length. The mix is a row of slots of one block each, dealt
into output shards; a shard's counts of sources are drawn from a multinomial
over what the sources still have to give, so that the totals meet the targets.
A source's slots, in the order of the shards, go through a pseudorandom
permutation of its block numbers, once for each time round, and slots and
blocks are joined by source and number. Nothing is drawn from a clock: equal
input gives an equal mix.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, cut, free, texts

#: Words a block, output shards, documents a chunk within which offsets are summed, and equal rows that are made in one place.
BLOCK, SHARDS, CHUNK, COPIES = 128, 64, 4096, 10_000
#: Weights by the order of the sources, repeating; the mix has TOTAL of all words; a target is at most TIMES its source.
WEIGHTS, TOTAL, TIMES = (3.0, 1.0, 2.0), 1.5, 2.0
#: Sources at most: their table is on the driver and broadcast.
MAX_SOURCES = 10_000
SEED = 20_240_601


@dataclass
class Source:
    name: str | None
    size: int  # words
    target: float = 0.0
    slots: int = 0  # blocks that the mix takes
    last: int = 0  # words of the last slot


def set_targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, total: float = TOTAL, times: float = TIMES) -> list[Source]:
    """Sources by code point, null last, with their targets: shares of ``total`` of all words by weight, none above ``times`` its size."""
    out = [Source(n, s) for n, s in sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))]
    weight = [weights[i % len(weights)] for i in range(len(out))]
    left, open_ = total * sum(s.size for s in out), list(range(len(out)))
    while open_:
        share = left / sum(weight[i] for i in open_)
        over = [i for i in open_ if share * weight[i] > times * out[i].size]
        for i in over or open_:
            out[i].target = times * out[i].size if over else share * weight[i]
        left -= sum(out[i].target for i in over)
        open_ = [i for i in open_ if i not in set(over)] if over else []
    return out


def permute(x: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 (``back``: its inverse): a Feistel network over an even number of bits, walked until below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def mix(v: np.ndarray, r: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            f = (v + np.uint64((key * 4 + r + 1) & 0xFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0xBF58476D1CE4E5B9)
        return (f ^ (f >> np.uint64(32))) & mask

    out = x.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for r in (3, 2, 1, 0) if back else range(4):
            left, right = (right ^ mix(left, r), left) if back else (right, left ^ mix(right, r))
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def set_slots(sources: list[Source], block: int = BLOCK, times: float = TIMES) -> None:
    """How many blocks each source gives, and how much of the last, so that the words meet the target as near as they can.

    The words of j slots are known without drawing: all blocks are full but the
    source's last, whose place in the permutation can be looked up.
    """
    for i, s in enumerate(sources):
        want = round(s.target)
        n = -(-s.size // block)
        if not n or not want:
            continue
        want = min(want, int(times * s.size))
        rounds, rest = divmod(want, s.size)
        short = n * block - s.size
        s.slots, s.last = rounds * n, block  # a block in full, be it the short one
        if rest:
            place = int(permute(np.array([n - 1]), n, _key(i, rounds), back=True)[0])
            words = lambda j: j * block - (short if j > place else 0)
            j = max(1, rest // block)
            while words(j) < rest:
                j += 1
            s.slots, s.last = s.slots + j, rest - words(j - 1)


def _key(source: int, time: int) -> int:
    return (SEED + 1_000_003 * source + 7919 * time) & 0x3FFFFFFF


def draw(sources: list[Source], shards: int = SHARDS, seed: int = SEED) -> list[tuple[int, int, int, int]]:
    """(shard, source, first of the source's slots, slots): per shard a multinomial draw over what is left of each source.

    What a draw takes beyond a source's rest is drawn again among the others, so all slots are given out.
    """
    rng = np.random.default_rng(seed)
    left = np.array([s.slots for s in sources], np.int64)
    given = np.zeros(len(left), np.int64)
    total, out = int(left.sum()), []
    for shard in range(shards):
        need = total * (shard + 1) // shards - total * shard // shards
        got = np.zeros(len(left), np.int64)
        while need:
            rest = left - got
            some = np.minimum(rng.multinomial(need, rest / rest.sum()), rest)
            got += some
            need -= int(some.sum())
        out += [(shard, int(i), int(given[i]), int(got[i])) for i in np.flatnonzero(got)]
        given += got
        left -= got
    return out


def _marks(id_col: str, text_col: str, more: list[str]) -> list[Column]:
    """Two hashes that together tell a row by 128 bits: of id and text, and of these and the columns ``more``."""
    return [F.xxhash64(id_col, text_col).alias("mark"), F.xxhash64(F.lit(1), id_col, text_col, *more).alias("mark2")]


def _told(docs: DataFrame) -> list[str]:
    """The columns by which rows of equal id and text are told apart: all that can be hashed."""
    return [f"`{f.name}`" for f in docs.schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, mark, mark2, n): words of each document (null: 0), hashes that tell its row, and how many rows are equal to it."""
    marks = [m.alias(f"_mix_{i}") for i, m in enumerate(_marks(id_col, text_col, _told(docs)))]
    marked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).cast("string").alias("source"), *marks)
    rows = texts(marked, "doc_id", "text", "source", F.col("_mix_0").alias("mark"), F.col("_mix_1").alias("mark2"))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    return rows.select("doc_id", "source", size, "mark", "mark2").groupBy("doc_id", "source", "size", "mark", "mark2").agg(F.count(F.lit(1)).alias("n"))


def place(rows: DataFrame, sources: list[Source], count: int) -> DataFrame:
    """A row for each document, with ``ix`` (the source's number) and ``start``, the offset of the document's words among its source's.

    Documents stand by chunk (of a hash), id and hashes; equal rows stand
    together. Sums run within chunks of a source, whose own offsets come from
    their totals, those from totals of many chunks, so no task sees a source.
    """
    spark = rows.sparkSession
    named = spark.createDataFrame([(s.name, i) for i, s in enumerate(sources)], "name string, ix int")
    rows = rows.join(F.broadcast(named), rows.source.eqNullSafe(named.name)).drop("name")
    rows = rows.withColumn("chunk", F.pmod("mark", F.lit(max(1, -(-count // CHUNK)))).cast("int"))
    totals = rows.groupBy("ix", "chunk").agg(F.sum(F.col("size") * F.col("n")).alias("words")).withColumn("far", F.floor(F.col("chunk") / CHUNK))
    wide = totals.groupBy("ix", "far").agg(F.sum("words").alias("words"))
    wide = wide.select("ix", "far", (F.sum("words").over(Window.partitionBy("ix").orderBy("far")) - F.col("words")).alias("base"))
    near = F.sum("words").over(Window.partitionBy("ix", "far").orderBy("chunk")) - F.col("words")
    before = totals.withColumn("near", near).join(wide, ["ix", "far"]).select("ix", "chunk", (F.col("base") + F.col("near")).alias("before"))
    inside = Window.partitionBy("ix", "chunk").orderBy("doc_id", "mark", "mark2", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("inside", F.sum(F.col("size") * F.col("n")).over(inside) - F.col("size") * F.col("n"))
    rows = rows.join(before, ["ix", "chunk"]).withColumn("start", F.col("before") + F.col("inside")).drop("chunk", "before", "inside")
    # Of very many equal rows, runs of COPIES are dealt out before each becomes a row.
    run = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long")))
    runs = rows.filter(F.col("n") > COPIES).withColumn("run", run).repartition("ix", "start", "run")
    runs = rows.filter(F.col("n") <= COPIES).withColumn("run", F.lit(0).cast("long")).unionByName(runs)
    copy = F.explode(F.sequence(F.col("run"), F.least(F.col("n"), F.col("run") + COPIES) - 1))
    return runs.withColumn("copy", copy).withColumn("start", F.col("start") + F.col("copy") * F.col("size")).drop("run", "copy", "n")


def pieces(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """(ix, start, number, lo, hi, at): the part [lo, hi) of block ``number`` that a document has, from its word ``at`` on."""
    first, end = F.col("start"), F.col("start") + F.col("size")
    rows = placed.filter("size > 0").select("ix", "start", "size", F.explode(F.sequence(F.floor(first / block), F.floor((end - 1) / block))).alias("number"))
    lo, hi = F.greatest(first, F.col("number") * block), F.least(end, (F.col("number") + 1) * block)
    return rows.select("ix", "start", "number", (lo - F.col("number") * block).alias("lo"), (hi - F.col("number") * block).alias("hi"), (lo - first).alias("at"))


def slots(spark, sources: list[Source], shards: int = SHARDS, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """(shard, slot, ix, number, time, words): every slot of the mix, the block it takes and how many of its words.

    The draws (shards times sources) are made on the driver; the slots they stand for, on the executors.
    """
    sizes = {i: (-(-s.size // block), s.slots, s.last) for i, s in enumerate(sources)}
    drawn = [(shard, i, first + k, min(65536, n - k), k) for shard, i, first, n in draw(sources, shards, seed) for k in range(0, n, 65536)]

    def run(batches):
        for b in batches:
            for shard, i, first, n, skip in zip(*(c.to_pylist() for c in b.columns), strict=True):
                blocks, total, last = sizes[i]
                at = np.arange(first, first + n)
                time = at // blocks
                number = np.empty(n, np.int64)
                for t in np.unique(time):
                    part = time == t
                    number[part] = permute(at[part] % blocks, blocks, _key(i, int(t)))
                words = np.full(n, block, np.int64)
                words[at == total - 1] = last
                cols = [np.full(n, shard, np.int32), skip + np.arange(n), np.full(n, i, np.int32), number, time.astype(np.int32), words]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["shard", "slot", "ix", "number", "time", "words"])

    frame = spark.createDataFrame(drawn, "shard int, ix int, first long, n long, skip long")
    return frame.repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, "shard int, slot long, ix int, number long, time int, words long")


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, shards: int = SHARDS, weights=WEIGHTS, total: float = TOTAL, times: float = TIMES) -> tuple[list[Source], DataFrame, DataFrame]:
    """(sources with targets, documents with their offsets, pieces of documents joined with the slots that take their block). More than ``MAX_SOURCES`` sources raise."""
    rows = cut(sized(docs, id_col, text_col, source_col))
    sums = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.sum("n").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(sums) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sources = set_targets([(r.source, r["size"]) for r in sums], weights, total, times)
    set_slots(sources, block, times)
    placed = place(rows, sources, sum(r.n for r in sums))
    # Slots come from few rows on the driver, from which their number cannot be told: never broadcast them.
    taken = pieces(placed, block).join(slots(docs.sparkSession, sources, shards, block).hint("merge"), ["ix", "number"])
    taken = taken.withColumn("hi", F.least("hi", "words")).filter("hi > lo")
    return sources, placed, taken


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """(doc_id, size, source_size, target, taken): the words that the mix takes of each document, repeats counted.

    Documents without words (null and empty texts) give none. A null source is
    a source, the last. Repeated rows are documents of their own.
    """
    spark = docs.sparkSession
    sources, placed, taken = plan(docs, id_col, text_col, source_col, **settings)
    per = taken.groupBy("ix", "start").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"))
    about = spark.createDataFrame([(i, s.size, s.target) for i, s in enumerate(sources)], "ix int, source_size long, target double")
    # Documents without words share their start with the next one: only those with words have pieces.
    keyed = placed.withColumn("has", F.when(F.col("size") > 0, F.col("start")))
    out = keyed.join(per.withColumnRenamed("start", "has"), ["ix", "has"], "left").join(F.broadcast(about), "ix")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """(shard, slot, source, time, parts): the mix itself; ``parts`` has (doc_id, mark, first word, words) in order."""
    sources, placed, taken = plan(docs, id_col, text_col, source_col, **settings)
    named = docs.sparkSession.createDataFrame([(i, s.name) for i, s in enumerate(sources)], "ix int, source string")
    ids = placed.filter("size > 0").select("ix", "start", "doc_id", "mark")
    part = F.struct("lo", "doc_id", "mark", F.col("at").alias("first"), (F.col("hi") - F.col("lo")).alias("words"))
    mixed = taken.join(ids, ["ix", "start"]).groupBy("shard", "ix", "slot", "time").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return mixed.join(F.broadcast(named), "ix").select("shard", "slot", "source", "time", "parts")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size_col: str = "n_chars", **settings) -> DataFrame:
    """``docs`` as the mix takes them: for each time round a row with the words taken of the document, in its own order.

    A text that is taken whole stays as it is, white space included; of others
    the words taken follow each other, each with the white space behind it. ``size_col`` is set to
    the new length where ``docs`` has it. Documents of which nothing is taken
    go, and so do those without words. Rows with the same id and text in other
    sources, or with other columns, are documents of their own and keep these;
    only columns that hold maps do not tell rows apart. Null ids, sources and
    texts, ties and very long texts need no care; no row is told by less than
    128 bits of hash.
    """
    _, placed, taken = plan(docs, id_col, text_col, source_col, **settings)
    spans = taken.groupBy("ix", "start", "time").agg(F.array_sort(F.collect_list(F.struct("at", (F.col("hi") - F.col("lo")).alias("n")))).alias("spans"))
    wanted = placed.filter("size > 0").select("ix", "start", "mark", "mark2", "size").join(spans, ["ix", "start"])
    size_, spans_, words_, mark, mark2, own, own2 = free(docs, "_mix_size", "_mix_spans", "_mix_words", "_mix_mark", "_mix_mark2", "_mix_0", "_mix_1")
    wanted = wanted.select(F.col("mark").alias(mark), F.col("mark2").alias(mark2), F.col("size").alias(size_), F.col("spans").alias(spans_))
    cols = docs.columns
    marks = [m.alias(name) for m, name in zip(_marks(id_col, text_col, _told(docs)), (own, own2), strict=True)]
    one = docs.select("*", *marks).dropDuplicates([own, own2])  # equal rows are told apart by their spans
    both = one.join(wanted, (F.col(own) == F.col(mark)) & (F.col(own2) == F.col(mark2)))
    words = F.regexp_extract_all(F.col(text_col), F.lit(f"{WORD}[ \\x09-\\x0D]*"), F.lit(0))
    whole = F.aggregate(spans_, F.lit(0).cast("long"), lambda a, s: a + s["n"]) == F.col(size_)
    # Each word brings the white space behind it, so stretches need nothing between them.
    part = F.array_join(F.transform(spans_, lambda s: F.array_join(F.slice(F.col(words_), s["at"].cast("int") + 1, s["n"].cast("int")), "")), "")
    both = both.withColumn(words_, F.when(~whole, words)).withColumn(text_col, F.when(whole, F.col(text_col)).otherwise(part))
    if size_col in cols:
        both = both.withColumn(size_col, F.length(text_col).cast(docs.schema[size_col].dataType))
    return both.select(*cols)
