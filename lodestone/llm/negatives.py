"""Hard-negative mining by blocked dense products.

Anchors go to the executors in blocks of bounded size; each task multiplies them
with the candidates of its partition, a block of both at a time, in float64:
components are whole numbers, so a product is exact below 2^53. The first pass
keeps the best rows of the anchor's own label a task, which merge to the best
overall; the second keeps the best rows of other labels whose scores lie in the
window that each positive sets, and merges these alike.

Rows with a null id, label or vector, or with a null or non-finite component,
take no part. Vectors meet only vectors of their length. A repeated row is a row
of its own: a positive or negative of its twin, and an anchor again. Ties go to
the smaller id. Columns other than the three named ones are not looked at. No
rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut

#: Positives an anchor, negatives a positive, and the window of a negative's score in hundredths of the positive's.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
#: A component x becomes floor(SCALE * x).
SCALE = 256.0
#: Bytes of anchors that are broadcast at a time; anchors and candidates of one product.
BLOCK_BYTES, ANCHORS, CANDIDATES = 16 << 20, 512, 2048
#: Below all scores.
NONE = np.iinfo(np.int64).min
PAIR = "anchor long, anchor_id long, place int, row long, vec_id long, score long"


def rows(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | str = "label") -> DataFrame:
    """(row, vec_id, label, vector) of all rows that take part, written once so that ``row`` stays."""
    label = F.col(label) if isinstance(label, str) else label
    v = F.col(vector_col).cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = df.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("vector"), F.coalesce(whole, F.lit(False)).alias("whole"))
    some = some.filter("whole and vec_id is not null and label is not null").drop("whole")
    return cut(some.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "vector"))


class Block:
    """Rows of one length as arrays: ids, labels, and a matrix of whole numbers."""

    def __init__(self, row: np.ndarray, vec_id: np.ndarray, label: np.ndarray, x: np.ndarray):
        self.row, self.vec_id, self.label, self.x = row, vec_id, label, x
        self.norm = float((x * x).sum(1).max()) if x.size else 0.0

    def take(self, at) -> Block:
        return Block(self.row[at], self.vec_id[at], self.label[at], self.x[at])

    def __len__(self) -> int:
        return len(self.row)


def blocks(batch: pa.RecordBatch | pa.Table) -> Iterator[Block]:
    """The rows of a batch (row, vec_id, label, vector) by the length of their vectors, each block by ascending id."""
    if not batch.num_rows:
        return
    flat = batch.column(3)
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    ends = np.asarray(flat.offsets)
    size, values = np.diff(ends), np.asarray(flat.values)
    row, vec_id, label = (np.asarray(batch.column(i)) for i in range(3))
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        at = at[np.lexsort((row[at], vec_id[at]))]
        x = values[ends[at][:, None] + np.arange(n)] if n else np.zeros((len(at), 0))
        yield Block(row[at], vec_id[at], label[at], np.floor(SCALE * x))


def product(a: Block, c: Block) -> np.ndarray:
    """All inner products; by Cauchy and Schwarz no sum of them, on the way either, exceeds the product of the norms."""
    if np.sqrt(a.norm) * np.sqrt(c.norm) < 2.0**53:
        return a.x @ c.x.T
    whole = np.frompyfunc(int, 1, 1)
    return whole(a.x).dot(whole(c.x).T)  # exact, one number at a time


class Best:
    """The first ``k`` (by score, then smaller id) of every slot, over all the blocks met."""

    def __init__(self, slots: int, k: int):
        self.k, self.worst = k, np.full(slots, NONE)
        self.kept: list[np.ndarray] = [np.zeros(0, np.int64)] * 4  # slot, score, vec_id, row

    def add(self, slot: np.ndarray, score: np.ndarray, vec_id: np.ndarray, row: np.ndarray) -> None:
        if not len(slot):
            return
        kept = [np.concatenate(z) for z in zip(self.kept, (slot, score.astype(np.int64), vec_id, row), strict=True)]
        order = np.lexsort((kept[3], kept[2], -kept[1], kept[0]))
        kept = [z[order] for z in kept]
        first = np.flatnonzero(np.diff(kept[0], prepend=-1))
        rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        full = rank == self.k - 1
        self.worst[kept[0][full]] = kept[1][full]
        self.kept = [z[rank < self.k] for z in kept]


def _positives(anchors: list[Block], k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's best ``k`` rows of each anchor's own label."""

    def run(batches: Iterator[pa.RecordBatch], anchors=anchors) -> Iterator[pa.RecordBatch]:
        best = [Best(len(a), k) for a in anchors]
        for c in (c for batch in batches for c in blocks(batch)):
            for a, kept in zip(anchors, best, strict=True):
                if a.x.shape[1] != c.x.shape[1]:
                    continue
                for label in np.intersect1d(a.label, c.label):
                    mine, theirs = np.flatnonzero(a.label == label), np.flatnonzero(c.label == label)
                    for i in range(0, len(mine), ANCHORS):
                        at = mine[i : i + ANCHORS]
                        part = a.take(at)
                        for j in range(0, len(theirs), CANDIDATES):
                            some = c.take(theirs[j : j + CANDIDATES])
                            s = product(part, some)
                            r, q = np.nonzero((s >= kept.worst[at][:, None]) & (part.row[:, None] != some.row[None, :]))
                            kept.add(at[r], s[r, q], some.vec_id[q], some.row[q])
        yield from _out([(a.row[b.kept[0]], a.vec_id[b.kept[0]], np.zeros(len(b.kept[0]), np.int32), b) for a, b in zip(anchors, best, strict=True)])

    return run


def _out(found: list[tuple[np.ndarray, np.ndarray, np.ndarray, Best]]) -> Iterator[pa.RecordBatch]:
    for anchor, anchor_id, place, best in found:
        _, score, vec_id, row = best.kept
        yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(anchor_id), pa.array(place), pa.array(row), pa.array(vec_id), pa.array(score)], ["anchor", "anchor_id", "place", "row", "vec_id", "score"])


def _negatives(anchors: list[Block], bars: list[np.ndarray], k: int, most: int, low: int, high: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's best ``k`` rows of other labels in the window of each positive; ``bars``: the positives' scores by anchor and place, None where there are fewer."""

    def run(batches: Iterator[pa.RecordBatch], anchors=anchors, bars=bars) -> Iterator[pa.RecordBatch]:
        best, ceil = [], []
        for bar in bars:
            least, top = np.full(bar.size, -(NONE + 1)), np.full(bar.size, NONE)
            there = [(i, int(p)) for i, p in enumerate(bar.ravel()) if p is not None]
            for i, p in there:
                least[i], top[i] = -((-low * p) // 100), (high * p) // 100
            b = Best(bar.size, k)
            b.worst = least
            best.append(b)
            ceil.append(top.reshape(bar.shape))
        for c in (c for batch in batches for c in blocks(batch)):
            for a, kept, top in zip(anchors, best, ceil, strict=True):
                if a.x.shape[1] != c.x.shape[1]:
                    continue
                for i in range(0, len(a), ANCHORS):
                    part = a.take(slice(i, i + ANCHORS))
                    slot = np.arange(i, i + len(part))[:, None] * most + np.arange(most)
                    for j in range(0, len(c), CANDIDATES):
                        some = c.take(slice(j, j + CANDIDATES))
                        s = product(part, some)
                        other = part.label[:, None] != some.label[None, :]
                        for p in range(most):
                            r, q = np.nonzero((s >= kept.worst[slot[:, p]][:, None]) & (s <= top[i : i + len(part), p][:, None]) & other)
                            kept.add(slot[r, p], s[r, q], some.vec_id[q], some.row[q])
        yield from _out([(a.row[b.kept[0] // most], a.vec_id[b.kept[0] // most], (b.kept[0] % most).astype(np.int32), b) for a, b in zip(anchors, best, strict=True)])

    return run


def _merged(df: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of what the tasks kept for each anchor and place; ``rank`` counts from 1."""
    w = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "vec_id", "row")
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def mine(all_rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``rows()``, for the rows where ``anchor`` holds.

    Anchors go in as many passes over the candidates as blocks of ``block_bytes`` hold them.
    """
    spark = all_rows.sparkSession
    chosen = all_rows.filter(anchor)
    n, size = chosen.agg(F.count("*"), F.coalesce(F.sum(8 * F.size("vector") + 24), F.lit(0))).first()
    passes = max(1, -(-size // block_bytes))
    out = None
    for i in range(passes if n else 0):
        here = list(blocks(chosen.filter(F.pmod(F.xxhash64("row"), F.lit(passes)) == i).toArrow()))
        sent = spark.sparkContext.broadcast(here)
        ours = cut(_merged(all_rows.mapInArrow(_sent(sent, None, lambda a, _: _positives(a, positives)), PAIR), positives))
        bars = [np.full((len(a), positives), None, object) for a in here]
        where = {int(r): (b, j) for b, a in enumerate(here) for j, r in enumerate(a.row)}
        for r, place, score in zip(*(x.to_pylist() for x in ours.select("anchor", "rank", "score").toArrow().columns), strict=True):
            b, j = where[r]
            bars[b][j, place - 1] = score
        windows = spark.sparkContext.broadcast(bars)
        theirs = _merged(all_rows.mapInArrow(_sent(sent, windows, lambda a, w: _negatives(a, w, negatives, positives, low, high)), PAIR), negatives)
        ours = ours.select("anchor", (F.col("rank") - 1).alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        theirs = theirs.select("anchor", "place", "anchor_id", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        part = theirs.join(ours, ["anchor", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
        if passes > 1:
            part = cut(part)
            sent.unpersist()
            windows.unpersist()
        out = part if out is None else out.unionAll(part)
    if out is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out


def _sent(anchors, windows, made: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    return lambda batches: made(anchors.value, windows.value if windows else None)(batches)
