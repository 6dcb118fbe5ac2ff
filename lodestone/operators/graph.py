"""Graph operators over edge tables: bounded reach, descendants, linearisation, cycles, hierarchies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import cut


def reach(edges: DataFrame, roots: DataFrame, max_depth: int, max_nodes: int | None = None) -> DataFrame:
    """(node, depth): what edges (src, dst) lead to from ``roots`` (node), at its least depth; breadth first, cut off each round.

    ``max_nodes`` keeps the first nodes by depth and name.
    """
    edges = edges.select("src", "dst").distinct()
    seen = frontier = cut(roots.select("node").distinct().withColumn("depth", F.lit(0)))
    for depth in range(1, max_depth + 1):
        step = frontier.join(edges, frontier.node == edges.src).select(F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen if max_nodes is None else seen.orderBy("depth", "node").limit(max_nodes)


#: Words of 64 bits in a piece of a list, and in what a worker merges at once.
PIECE, MERGED = 256, 1 << 20


def two_hops(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(a, n): how many distinct a there are, itself included, that share a b with each a.

    The a of a b are bits of words of 64, so that a b of many a makes a 64th of
    what pairs would. Each a gets the words of its b in pieces of lists; these
    come sorted by a, and a worker keeps the words of one a at a time, so no
    task holds groups of all that meet. ``a`` is a whole number; rows with a
    null count for nothing.
    """
    rows = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col(a), F.lit(64)).cast("int"))
    words = rows.groupBy(b, F.floor(F.col(a) / 64).alias("_w")).agg(F.bit_or(bit).alias("_bits"))
    lists = words.groupBy(b).agg(F.collect_list(F.struct("_w", "_bits")).alias("_l"))
    pieces = F.transform(F.sequence(F.lit(1), F.size("_l"), F.lit(PIECE)), lambda i: F.slice("_l", i, PIECE))
    lists = lists.select(F.col("_l").alias("_all"), F.explode(pieces).alias("_l")).select(F.inline("_all"), "_l")
    inside = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("_bits", i) == 1)
    met = lists.select(F.explode(inside).alias("_i"), "_w", F.col("_l._w").alias("words"), F.col("_l._bits").alias("bits"))
    met = met.select((F.col("_w") * 64 + F.col("_i")).alias("a"), "words", "bits").repartition("a").sortWithinPartitions("a")
    return met.mapInArrow(_counted, "a long, n long").select(F.col("a").cast(edges.schema[a].dataType).alias(a), "n")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, n) of rows (a, words, bits) in order of a: the bits of all its words, those of equal words or-ed."""
    now, words, bits, held = None, [], [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        w, v = np.concatenate(words), np.concatenate(bits)
        order = np.argsort(w)
        w, v = w[order], v[order]
        first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        return w[first], np.bitwise_or.reduceat(v, first)

    for batch in batches:
        keys, done = batch.column(0).to_numpy(), []
        ends = batch.column(1).offsets.to_numpy()
        w, v = (batch.column(i).values.to_numpy() for i in (1, 2))
        if not len(keys):
            continue
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        for i, j in zip(starts, [*starts[1:], len(keys)], strict=True):
            if now is not None and keys[i] != now:
                done.append((now, int(np.bitwise_count(merged()[1].view(np.uint64)).sum())))
                words, bits, held = [], [], 0
            now = int(keys[i])
            words.append(w[ends[i] : ends[j]])
            bits.append(v[ends[i] : ends[j]])
            held += ends[j] - ends[i]
            if held > MERGED:
                one, two = merged()
                words, bits, held = [one], [two], 0
        if done:
            yield pa.RecordBatch.from_pydict({"a": [k for k, _ in done], "n": [n for _, n in done]})
        # What is kept for the next batch is no view of this one.
        words, bits = [x.copy() for x in words], [x.copy() for x in bits]
    if now is not None:
        yield pa.RecordBatch.from_pydict({"a": [now], "n": [int(np.bitwise_count(merged()[1].view(np.uint64)).sum())]})


def import_edges(links: DataFrame) -> DataFrame:
    """(src, dst): which file imports from which, by resolved imports (importer, name, path); distinct, none to itself."""
    return links.filter("path is not null and path != importer").select(F.col("importer").alias("src"), F.col("path").alias("dst")).distinct()


def caller_tree(edges: DataFrame, max_depth: int = 3) -> DataFrame:
    """(root, name, depth): for every called node who calls it (1), who calls those (2) and so on; each name once a root and depth.

    ``edges`` (src, dst): src calls dst. Circles end at the depth.
    """
    step = cut(edges.select("src", "dst").distinct())
    out = level = step.select(F.col("dst").alias("root"), F.col("src").alias("name"), F.lit(1).alias("depth"))
    for depth in range(2, max_depth + 1):
        nxt = level.join(step.select(F.col("dst").alias("name"), F.col("src").alias("up")), "name").select("root", F.col("up").alias("name")).distinct()
        level = nxt.withColumn("depth", F.lit(depth))
        level = cut(level) if depth < max_depth else level  # nobody goes on from the last
        out = out.unionByName(level)
    return out


def descendants(edges: DataFrame, max_depth: int) -> DataFrame:
    """(root, node, depth) for every node with children: all below it, at the least depth."""
    step = cut(edges.select(F.col("src").alias("root"), F.col("dst").alias("node")).distinct())
    seen = frontier = step.withColumn("depth", F.lit(1))
    for depth in range(2, max_depth + 1):
        more = frontier.select("root", F.col("node").alias("mid")).join(step.select(F.col("root").alias("mid"), "node"), "mid").select("root", "node").distinct()
        frontier = cut(more.join(seen, ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def paths(edges: DataFrame, max_length: int) -> DataFrame:
    """(path, closed) of simple paths of up to ``max_length`` edges whose first node is their smallest; ``closed`` if they end where they began."""
    e = cut(edges.select("src", "dst").filter("src != dst").distinct()).hint("merge")
    found = None
    open_ = e.filter("src < dst").select(F.array("src", "dst").alias("path"))
    for length in range(2, max_length + 1):
        last, first = F.element_at("path", -1), F.col("path")[0]
        step = open_.join(e, last == e.src).filter((F.col("dst") == first) | ((F.col("dst") > first) & ~F.array_contains("path", F.col("dst"))))
        # A step is made once; of the last one nobody asks for what is still open.
        step = cut((step if length < max_length else step.filter(F.col("dst") == first)).select("path", "dst"))
        closed = step.filter(F.col("dst") == first).select("path")
        found = closed if found is None else found.union(closed)
        open_ = step.filter(F.col("dst") != first).select(F.array_append("path", F.col("dst")).alias("path"))
    return found


def cycles(edges: DataFrame, max_length: int) -> DataFrame:
    """(path, length) of all simple cycles of up to ``max_length`` nodes, each from its smallest node on."""
    return paths(edges, max_length).select("path", F.size("path").alias("length"))


def _settled(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node, least): the least of the starting values (node, least) that edges lead to each node; a round sends on only what changed."""
    now = changed = cut(start)
    while not changed.isEmpty():
        sent = changed.join(edges, changed.node == edges.src).groupBy(F.col("dst").alias("node")).agg(F.min("least").alias("new"))
        step = cut(now.join(sent, "node", "left").select("node", F.least("least", "new").alias("least"), (F.col("new") < F.col("least")).alias("better")))
        now, changed = step.select("node", "least"), step.filter("better").select("node", "least")
    return now


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the strongly connected component of every node that is on a circle of edges (src, dst), named by its smallest node.

    Rounds: nodes without a way in or a way out are taken off; every other takes
    on the least node that leads to it; backwards from those that kept their own
    name, all of that name that lead there are a component, which is taken off.
    All components of a round are found at once and circles may be of any
    length; a round has about as many steps as its longest way has nodes. A hub
    costs a row a task, as minima are taken before the shuffle.
    """
    left, found = cut(edges.select("src", "dst").filter("src != dst").distinct()), None
    while True:
        size = left.count()
        while size:
            ends = left.select(F.col("src").alias("node")).intersect(left.select(F.col("dst").alias("node")))
            left = cut(left.join(ends, left.src == ends.node, "left_semi").join(ends, left.dst == ends.node, "left_semi"))
            before, size = size, left.count()
            if size == before:
                break
        if not size:
            break
        nodes = left.select(F.col("src").alias("node")).union(left.select(F.col("dst").alias("node"))).distinct()
        named = _settled(left, nodes.withColumn("least", F.col("node")))
        a, b = named.select(F.col("node").alias("src"), F.col("least").alias("a")), named.select(F.col("node").alias("dst"), F.col("least").alias("b"))
        inside = cut(left.join(a, "src").join(b, "dst").filter("a = b").select(F.col("src").alias("dst"), F.col("dst").alias("src"), "a"))  # turned round
        reached = frontier = cut(named.filter("node = least"))
        while not frontier.isEmpty():
            step = frontier.join(inside, (frontier.node == inside.src) & (frontier.least == inside.a)).select(F.col("dst").alias("node"), "least").distinct()
            frontier = cut(step.join(reached, ["node", "least"], "left_anti"))
            reached = cut(reached.unionByName(frontier))
        part = reached.select("node", F.col("least").alias("component"))
        found = part if found is None else found.unionByName(part)
        left = cut(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")).join(part, F.col("src") == part.node, "left_anti").join(part, F.col("dst") == part.node, "left_anti"))
    if found is None:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    several = found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return cut(found.join(several, "component", "left_semi").select("node", "component"))


def linearised(bases: DataFrame, max_depth: int = 50) -> DataFrame:
    """(cls, base, position, depth, confidence): every class with all it inherits from, depth first, bases by ``ord``.

    ``bases`` has (cls, base, ord, confidence). The first occurrence of a base
    counts; its confidence is the least on the way.
    """
    step = cut(bases.select("cls", "base", "ord", "confidence"))
    frontier = step.select("cls", "base", F.array(F.col("ord").cast("int")).alias("way"), F.lit(1).alias("depth"), "confidence", F.array("cls", "base").alias("seen"))
    out = frontier
    for _ in range(max_depth - 1):
        nxt = step.select(F.col("cls").alias("base"), F.col("base").alias("up"), F.col("ord").cast("int").alias("o"), F.col("confidence").alias("c"))
        frontier = frontier.join(nxt, "base").filter(~F.array_contains("seen", F.col("up"))).select("cls", F.col("up").alias("base"), F.array_append("way", F.col("o")).alias("way"), (F.col("depth") + 1).alias("depth"), F.least("confidence", "c").alias("confidence"), F.array_append("seen", F.col("up")).alias("seen"))
        frontier = cut(frontier)
        if frontier.isEmpty():
            break
        out = out.unionByName(frontier)
    first = out.groupBy("cls", "base").agg(F.min(F.struct("way", "depth", "confidence")).alias("m")).select("cls", "base", "m.*")
    w = Window.partitionBy("cls").orderBy("way")
    return first.select("cls", "base", F.row_number().over(w).alias("position"), "depth", "confidence")


def children(df: DataFrame, parent: str, child: Column) -> DataFrame:
    """(parent, children): the children of each parent as a sorted array."""
    return df.groupBy(parent).agg(F.array_sort(F.collect_list(child)).alias("children"))
