"""Approximate nearest neighbours by inner product over robust-pruned directed graphs.

Vectors are dealt into shards of bounded size. A shard's graph grows by groups
of vectors: a greedy beam search over the graph so far proposes neighbours for
each, and pruning keeps those that no kept neighbour is much nearer to
(``ALPHA``), so that edges point in many directions. One more coordinate makes
all vectors of a shard equally long, by which the largest inner product is the
least distance. Every query then searches every shard with a beam, and the
best of all shards are put together. Equal vectors are one node, with as many
of their smallest ids as an answer can hold.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut

#: Nearest returned, vectors a shard, edges a node, beam when building and when searching, and slack of pruning.
K, SHARD, EDGES, BUILD_BEAM, BEAM, ALPHA = 20, 12_000, 48, 96, 144, 1.15
#: As every query goes to every shard, shards grow by the root of the vectors from SHARD on, up to what fits a worker: copies of queries then grow as the vectors to the power 1.5.
GROWTH, SHARD_BYTES = 12.0, 256 << 20
#: Vectors that enter a graph together, and nodes that each search opens at a time.
GROUP, OPEN = 512, 4
#: Bytes of the marks of which nodes a search has met; of more rows than these hold, some wait.
STAMP_BYTES = 64 << 20


class Graph:
    """A graph over the rows of ``vectors``; ``edges`` holds -1 where a node has fewer."""

    def __init__(self, vectors: np.ndarray, edges: int = EDGES, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 11):
        # Scaled to components of 1 at most, whose squares no large or small number can spoil.
        x = (vectors / (np.abs(vectors).max() if len(vectors) else 1.0)).astype(np.float32)
        square = (x.astype(np.float64) ** 2).sum(1)
        self.radius = float(square.max()) if len(x) else 0.0
        self.x = np.concatenate([x, np.sqrt(np.maximum(self.radius - square, 0))[:, None].astype(np.float32)], 1)
        self.most, self.alpha = edges, alpha
        n = len(x)
        self.edges = np.full((n, edges + edges // 2), -1, np.int32)
        self.degree = np.zeros(n, np.int64)
        if not n:
            return
        mean = self.x.mean(0)
        self.entry = np.array([int((self.x @ mean).argmax())])
        order = np.random.default_rng(seed).permutation(n)
        order = np.concatenate([self.entry, order[order != self.entry[0]]])
        at, size = 1, 1
        while at < n:
            new = order[at : at + size]
            near, sims = self.beam(self.x[new], beam)
            self._set(new, *self._prune(near, sims, new))
            self._back(new)
            at += len(new)
            size = min(GROUP, 2 * size)
        # Nodes that no path from the start leads to would never be found: searches start from them, too.
        led = np.zeros(n, bool)
        led[self.edges[self.edges >= 0]] = True
        self.entry = np.concatenate([self.entry, np.setdiff1d(np.flatnonzero(~led), self.entry)])
        reached = np.zeros(n, bool)
        self._spread(self.entry, reached)
        while len(left := np.flatnonzero(~reached)):  # circles of nodes that are cut off
            self.entry = np.append(self.entry, left[0])
            self._spread(left[:1], reached)

    def _spread(self, nodes: np.ndarray, reached: np.ndarray) -> None:
        """Marks all that edges lead to from ``nodes``."""
        while len(nodes):
            reached[nodes] = True
            nodes = np.unique(self.edges[nodes])
            nodes = nodes[(nodes >= 0) & ~reached[nodes]]

    def beam(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row of ``q`` up to ``width`` nodes, the best that a greedy search with a beam meets, and their inner products; -1 where fewer."""
        rows, n = len(q), len(self.x)
        width, most = min(width, n), max(1, STAMP_BYTES // (4 * n))
        if rows > most:
            parts = [self.beam(q[i : i + most], width) for i in range(0, rows, most)]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        stamp = np.full((rows, n), -1, np.int32)
        ids = np.full((rows, width), -1, np.int32)
        sims = np.full((rows, width), -np.inf, np.float32)
        opened = np.ones((rows, width), bool)
        live = np.arange(rows)
        r, c = np.repeat(live, len(self.entry)), np.tile(self.entry, rows)
        while True:
            where = np.arange(len(c), dtype=np.int32)
            fresh = stamp[r, c] < 0
            r, c, where = r[fresh], c[fresh], where[fresh]
            stamp[r, c] = where
            fresh = stamp[r, c] == where
            r, c = r[fresh], c[fresh]
            if len(r):
                s = np.einsum("ij,ij->i", self.x[c], q[r])
                # The r are in ascending order: place each row's newcomers side by side.
                count = np.bincount(r, minlength=rows)
                wide = int(count.max())
                col = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
                who = np.flatnonzero(count)
                line = np.cumsum(count > 0) - 1
                more_s = np.full((len(who), wide), -np.inf, np.float32)
                more_i = np.full((len(who), wide), -1, np.int32)
                more_s[line[r], col], more_i[line[r], col] = s, c
                all_s = np.concatenate([sims[who], more_s], 1)
                all_i = np.concatenate([ids[who], more_i], 1)
                all_o = np.concatenate([opened[who], more_i < 0], 1)
                top = np.argpartition(-all_s, width - 1, axis=1)[:, :width]
                sims[who], ids[who], opened[who] = (np.take_along_axis(z, top, 1) for z in (all_s, all_i, all_o))
            wait = np.where(opened[live], -np.inf, sims[live])
            k = min(OPEN, width)
            pick = np.argpartition(-wait, k - 1, axis=1)[:, :k]
            ok = np.take_along_axis(wait, pick, 1) > -np.inf
            live_on = ok.any(1)
            live, pick, ok = live[live_on], pick[live_on], ok[live_on]
            if not len(live):
                break
            rr = np.repeat(live, k).reshape(-1, k)
            opened[rr[ok], pick[ok]] = True
            node = ids[rr, pick]
            nbr = np.where(ok[..., None], self.edges[node], -1).reshape(len(live), -1)
            r = np.repeat(live, nbr.shape[1])
            c = nbr.ravel()
            r, c = r[c >= 0], c[c >= 0]
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def _prune(self, near: np.ndarray, sims: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row's candidates, nearest first, those to keep: (kept flags in the order of the rows' candidates, candidates)."""
        alive = (near >= 0) & (near != own[:, None])
        kept = np.zeros_like(alive)
        v = self.x[np.maximum(near, 0)]
        pair = 2 * self.radius - 2 * np.matmul(v, v.transpose(0, 2, 1))
        to = 2 * self.radius - 2 * sims
        rows = np.arange(len(near))
        for _ in range(self.most):
            some = alive.any(1)
            if not some.any():
                break
            first = alive.argmax(1)
            kept[rows[some], first[some]] = True
            alive &= ~((self.alpha**2 * pair[rows, first] <= to) & some[:, None])
            alive[rows, first] = False
        return kept, near

    def _set(self, nodes: np.ndarray, kept: np.ndarray, near: np.ndarray) -> None:
        order = np.argsort(~kept, axis=1, kind="stable")[:, : self.most]
        take = np.take_along_axis(near, order, 1)
        take[~np.take_along_axis(kept, order, 1)] = -1
        self.edges[nodes] = -1
        self.edges[nodes, : take.shape[1]] = take
        self.degree[nodes] = kept.sum(1)

    def _back(self, new: np.ndarray) -> None:
        """Edges back to the new nodes; nodes that get too many are pruned."""
        to = self.edges[new]
        src = np.repeat(new, to.shape[1])[to.ravel() >= 0]
        dst = to.ravel()[to.ravel() >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        nodes, start, count = np.unique(dst, return_index=True, return_counts=True)
        room = self.edges.shape[1]
        full = self.degree[nodes] + count > room
        easy = ~full
        pos = np.arange(len(dst)) - np.repeat(start, count)
        one = np.repeat(easy, count)
        self.edges[dst[one], self.degree[dst[one]] + pos[one]] = src[one]
        self.degree[nodes[easy]] += count[easy]
        todo = np.flatnonzero(full)
        for i in range(0, len(todo), GROUP):
            part = todo[i : i + GROUP]
            wide = int((self.degree[nodes[part]] + count[part]).max())
            cand = np.full((len(part), wide), -1, np.int32)
            for j, p in enumerate(part):
                have = self.edges[nodes[p]]
                have = have[have >= 0]
                cand[j, : len(have)] = have
                cand[j, len(have) : len(have) + count[p]] = src[start[p] : start[p] + count[p]]
            sims = np.einsum("ijk,ik->ij", self.x[np.maximum(cand, 0)], self.x[nodes[part]])
            sims[cand < 0] = -np.inf
            order = np.argsort(-sims, axis=1, kind="stable")[:, : 2 * room]
            self._set(nodes[part], *self._prune(np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1), nodes[part]))


def answers(graph: Graph, x: np.ndarray, ids: list[list[int]], q: np.ndarray, own: np.ndarray, k: int = K, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, id, score) of each query's ``k`` best here, its own row left out; scores in double precision on the given vectors."""
    out_r, out_i, out_s = [], [], []
    for a in range(0, len(q), 256):
        part = q[a : a + 256]
        scaled = part / np.abs(part).max(1, keepdims=True)
        near, _ = graph.beam(np.concatenate([scaled, np.zeros((len(part), 1))], 1).astype(np.float32), beam)
        near = near[:, : max(k + 1, beam // 2)]
        exact = np.einsum("ijk,ik->ij", x[np.maximum(near, 0)], part)
        exact[near < 0] = -np.inf
        for j in range(len(part)):
            found = []
            for t in np.argsort(-exact[j], kind="stable").tolist():
                if near[j, t] < 0 or (len(found) >= k and exact[j, t] < found[-1][0]):
                    break
                found += [(float(exact[j, t]), i) for i in ids[near[j, t]] if i != own[a + j]]
            found.sort(key=lambda f: (-f[0], f[1]))
            out_r += [a + j] * len(found[:k])
            out_s += [f[0] for f in found[:k]]
            out_i += [f[1] for f in found[:k]]
    return np.array(out_r, np.int64), np.array(out_i, np.int64), np.array(out_s)


def search(df: DataFrame, queries, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, shard: int = SHARD, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): for the rows of ``df`` for which the Column ``queries`` holds the ``k`` nearest others.

    Nearness is the inner product; ties go to the smaller id. Rows whose vector
    is null, empty, zero or holds a null or non-finite component take no part,
    nor do rows without an id; a repeated row counts once. Vectors are compared
    with those of their own length only. ``shard`` is the size of a shard while
    vectors are few (see ``GROWTH``); other columns play no part.
    """
    v = F.col("v")
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))) & F.exists(v, lambda e: e != 0)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), queries.alias("q")).filter(F.col("id").isNotNull() & sound)
    first = Window.partitionBy("v").orderBy("id")
    # The few smallest ids of equal vectors; the limit is taken before the shuffle too.
    nodes = rows.select("id", "v").withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1).groupBy("v").agg(F.array_sort(F.array_distinct(F.collect_list("id"))).alias("ids"))
    nodes = cut(nodes)
    sizes = {r.d: r.n for r in nodes.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    base, starts = 0, {}
    for d in sorted(sizes):
        size = max(shard, min(int(GROWTH * math.sqrt(sizes[d])), SHARD_BYTES // (4 * d)))
        starts[d] = (base, -(-sizes[d] // size))
        base += starts[d][1]
    of = F.create_map(*[F.lit(z) for d, s in starts.items() for z in (d, s[0])])
    many = F.create_map(*[F.lit(z) for d, s in starts.items() for z in (d, s[1])])
    own = of[F.size("v")]
    index = nodes.select((own + F.pmod(F.xxhash64("v"), many[F.size("v")]).cast("int")).alias("shard"), F.lit(0).alias("ask"), F.lit(None).cast("long").alias("id"), "v", "ids")
    asked = rows.filter("q").select("id", "v").dropDuplicates(["id", "v"])
    asked = asked.select(F.explode(F.sequence(own, own + many[F.size("v")] - 1)).alias("shard"), F.lit(1).alias("ask"), "id", "v", F.array().cast("array<bigint>").alias("ids"))

    def run(batches):
        now, held, ready = None, [], None
        for b in batches:
            shards, ask = b.column(0).to_numpy(), b.column(1).to_numpy()
            ends = np.flatnonzero(np.concatenate([(shards[1:] != shards[:-1]) | (ask[1:] != ask[:-1]), [True]])) + 1 if len(shards) else []
            at = 0
            for end in ends:
                part = b.slice(at, end - at)
                s, a, at = shards[at], ask[at], end
                if s != now:
                    now, held, ready = s, [], None
                if not a:
                    held.append(part)
                    continue
                if ready is None:
                    x = np.concatenate([_matrix(p.column(3)) for p in held])
                    ids = [i for p in held for i in p.column(4).to_pylist()]
                    held = []
                    ready = Graph(x), x, ids
                own_ids = part.column(2).to_numpy()
                r, i, sc = answers(*ready, _matrix(part.column(3)), own_ids, k, beam)
                yield pa.RecordBatch.from_arrays([pa.array(own_ids[r]), pa.array(i), pa.array(sc)], ["query_id", "vec_id", "score"])

    # Each shard is a task of its own.
    found = index.unionByName(asked).repartitionById(base, F.col("shard")).sortWithinPartitions("shard", "ask", "v", "id").mapInArrow(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)
