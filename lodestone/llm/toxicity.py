"""Toxicity by a factorization machine over hashed terms.

Terms are words and the beginnings of words. Those whose presence goes with
the label in a bounded sample of labelled rows are the features; the machine
has a weight for each and a short vector for each, whose inner products are the
weights of pairs, so that a pair can mean more or less than its parts.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, held_out, slices, texts

#: Buckets of terms, features kept, and length of the vectors.
BUCKETS, FEATURES, FACTORS = 1 << 18, 1024, 8
#: What keeps weights and vectors small.
SMALL_W, SMALL_V = 1e-6, 1e-5
#: Labelled rows of each class that are learned from, about.
SAMPLE = 4000
#: Lengths of the beginnings of words that are terms.
HEADS = (4, 5, 6, 7)
#: Score from which on a text is predicted toxic.
THRESHOLD = 0.3
#: Words whose terms a worker keeps.
KEEP = 80_000

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


class Terms(dict):
    """Word to the buckets of its terms."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        w = _EDGE.sub("", word.decode("utf-8", "replace").lower())
        heads = [f"<{w}>", *(f"<{w[:n]}" for n in HEADS if len(w) >= n)] if w else []
        self[word] = out = tuple(zlib.crc32(h.encode()) % BUCKETS for h in heads)
        return out

    def of(self, text: bytes | None) -> np.ndarray:
        """The distinct buckets of a text, in order."""
        if len(self) > KEEP:
            self.clear()
        out: set[int] = set()
        out.update(*map(self.__getitem__, set((text or b"").split())))
        return np.array(sorted(out), np.int64)


@dataclass
class Machine:
    bias: float
    weight: np.ndarray  # per feature
    vector: np.ndarray  # per feature, FACTORS long
    number: np.ndarray  # bucket to feature, -1 for none

    def score(self, buckets: np.ndarray) -> float:
        f = self.number[buckets]
        f = f[f >= 0]
        v = self.vector[f]
        s = v.sum(0)
        return float(1.0 / (1.0 + np.exp(-(self.bias + self.weight[f].sum() + 0.5 * ((s * s).sum() - (v * v).sum())))))


def gradient(theta: dict[str, np.ndarray], x: np.ndarray, label: np.ndarray, cost: np.ndarray) -> dict[str, np.ndarray]:
    """Of the log loss over rows of 0 and 1 weighed by ``cost``, and of what keeps weights and vectors small."""
    w, v = theta["w"].astype(x.dtype), theta["v"].astype(x.dtype)
    xv = x @ v
    out = theta["b"][0] + x @ w + 0.5 * ((xv * xv).sum(1) - x @ (v * v).sum(1))
    d = (cost * (1 / (1 + np.exp(-np.clip(out, -30, 30))) - label)).astype(x.dtype)
    xd = x.T @ d
    return {"b": np.array([d.sum()]), "w": xd + SMALL_W * w, "v": x.T @ (d[:, None] * xv) - v * xd[:, None] + SMALL_V * v}


def train(features: list[np.ndarray], wide: int, label: np.ndarray, cost: np.ndarray, rounds: int = 300, seed: int = 7) -> tuple[float, np.ndarray, np.ndarray]:
    """(bias, weights, vectors) of ``wide`` features by Adam on the log loss; rows, weighed by ``cost``, hold numbers of features."""
    prior = float(np.clip((cost * label).sum() / max(cost.sum(), 1e-9), 1e-4, 1 - 1e-4))
    rng = np.random.default_rng(seed)
    theta = {"b": np.array([np.log(prior / (1 - prior))]), "w": np.zeros(wide), "v": 0.05 * rng.standard_normal((wide, FACTORS))}
    if wide and 0 < label.mean() < 1:
        x = np.zeros((len(features), wide), np.float32)
        for i, f in enumerate(features):
            x[i, f] = 1
        c = (cost / cost.sum()).astype(np.float64)
        m = {k: np.zeros_like(t) for k, t in theta.items()}
        s = {k: np.zeros_like(t) for k, t in theta.items()}
        for step in range(1, rounds + 1):
            for k, g in gradient(theta, x, label, c).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.99 * s[k] + 0.01 * g * g
                theta[k] = theta[k] - 0.05 * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)
    return float(theta["b"][0]), theta["w"], theta["v"]


def telling(sample: DataFrame, rows: int, positive: int) -> list[int]:
    """The at most ``FEATURES`` buckets, in order, whose share of positive rows differs most from that of all, by its standard error; counted on the executors."""
    if not 0 < positive < rows:
        return []

    def counts(batches):
        total, of = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in batches:
            for toxic, terms in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at = np.frombuffer(terms, np.int32)
                total[at] += 1
                of[at] += toxic
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at]), pa.array(of[at])], ["bucket", "total", "positive"])

    p = positive / rows
    total = F.col("total")
    z = F.abs(F.col("positive") - total * p) / F.sqrt(F.greatest(total * p * (1 - p) * (1 - total / rows), F.lit(1e-9)) + 1.0)
    found = sample.select("toxic", "terms").mapInArrow(counts, "bucket long, total long, positive long").groupBy("bucket").agg(F.sum("total").alias("total"), F.sum("positive").alias("positive"))
    best = found.filter("total >= 4").select("bucket", z.alias("z")).filter("z > 3").orderBy(F.desc("z"), "bucket").limit(FEATURES)
    return sorted(r.bucket for r in best.collect())


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Machine:
    """Learns from about ``sample`` labelled ids of each class, picked by a hash of the id.

    Rows of a class are weighed by how many the sample stands for, so that
    scores keep to the label's frequency. Ids with a null or no label teach
    nothing; repeated labels count once; an id with both labels teaches both; of
    documents that share an id the one with the least terms teaches. Without
    labels the machine scores 1 in 10,000 for all. Features are chosen on the
    executors; what comes to the driver is their numbers in the sampled rows,
    at most 2 * ``FEATURES`` bytes a row.
    """
    marked = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").distinct()
    size = {r.toxic: r.n for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, F.lit(sample / size.get(1, 1))).otherwise(F.lit(sample / size.get(0, 1)))
    some = marked.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))

    def terms(batches):
        known = Terms()
        for b in slices(batches):
            got = [known.of(t).astype(np.int32).tobytes() for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(got, pa.binary())], ["doc_id", "toxic", "terms"])

    # The sample's ids are at most about 2 * sample, so they may be broadcast.
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    found = texts(docs, id_col, text_col).join(F.broadcast(some), "doc_id").select("doc_id", "text", "toxic").mapInArrow(terms, f"doc_id {kind}, toxic int, terms binary")
    found = cut(found.groupBy("doc_id", "toxic").agg(F.min("terms").alias("terms")).select("toxic", "terms"))
    taken = {r.toxic: r.n for r in found.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    take = telling(found, sum(taken.values()), taken.get(1, 0))
    number = np.full(BUCKETS, -1, np.int32)
    number[take] = np.arange(len(take))

    def numbers(batches):
        for b in batches:
            rows = [number[np.frombuffer(t, np.int32)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[r >= 0].astype(np.int16).tobytes() for r in rows], pa.binary())], ["toxic", "features"])

    rows = sorted((r.toxic, bytes(r.features)) for r in found.mapInArrow(numbers, "toxic int, features binary").collect())
    label = np.array([y for y, _ in rows], float)
    cost = np.array([size[y] / taken[y] for y, _ in rows], float)
    if not rows:
        return Machine(float(np.log(1e-4 / (1 - 1e-4))), np.zeros(0), np.zeros((0, FACTORS)), number)
    return Machine(*train([np.frombuffer(f, np.int16) for _, f in rows], len(take), label, cost), number)


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score double) of every whole text; null and empty texts score as texts without terms. Repeated rows repeat; very long texts count by their distinct terms; other columns play no part."""
    known = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        terms = Terms()
        for b in slices(batches):
            got = [known.value.score(terms.of(t)) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.float64())], ["doc_id", "score"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return texts(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, score double")


def learn_and_score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(doc_id, held_out, score, predicted): learns from the labels that are not held out, scores all documents."""
    machine = fit(docs, labels.filter(~held_out(F.col(id_col))), id_col, text_col, label_col)
    got = score(docs, machine, id_col, text_col)
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
