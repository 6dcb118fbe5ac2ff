"""SimHash near-duplicates, linked by a self-join of binary tries.

Equal fingerprints are one key from the start, however many texts share it.
Of two fingerprints that differ in at most ``4`` bits, one of three blocks of
the 64 bits differs in at most one bit. So each fingerprint is turned three
times, so that each block leads once, and dealt by its leading bits; copies go
to the prefixes that differ in one set bit. Every task then has tries of its
own and walks pairs of their nodes together, from pairs of siblings deep down
up to the roots, adding up the bits that differ and dropping a pair as soon as
the error budget (one in the leading block, four in all) is spent, or as all
below both nodes is linked already. A task returns one link for each
fingerprint that it joined to another, never all pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lodestone.llm.common import cut, free, slices, texts

#: Bits that linked fingerprints may differ in, and words in a shingle.
ERRORS, SHINGLE, SEED = 4, 4, 42
BLOCK = 21
#: Node pairs expanded at a time, and leaf pairs below which two nodes are compared leaf by leaf.
CHUNK, LEAVES = 200_000, 256
#: Rows beyond which a slot is dealt on, and by how many bits; rows of whole slots that are walked together; rows a task, about.
FULL, DEEPER, TOGETHER, TASK_ROWS = 2_000_000, 5, 500_000, 4_000_000


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Of UTF-8 text: a bit is 1 if it is in over half the shingles' hashes; 0 for no words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    spans = zip(starts[: len(words) - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)
    h = np.fromiter((xxh64_intdigest(line[a:b], SEED) for a, b in spans), np.uint64, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 30_000):
        ones += np.unpackbits(h[i : i + 30_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long, mark long, mark2 long) of every row; null and empty texts have 0, repeated rows repeat. The marks are two hashes of the text, which together tell it by 128 bits."""

    def run(batches):
        for b in slices(batches):
            got = np.array([fingerprint(x, shingle) for x in b.column(1).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got.view(np.int64)), b.column(2), b.column(3)], ["doc_id", "fp", "mark", "mark2"])

    kind = df.select(id_col).schema[0].dataType.simpleString()
    return texts(df, id_col, text_col, *_marks(text_col)).mapInArrow(run, f"doc_id {kind}, fp long, mark long, mark2 long")


def _marks(text_col: str) -> list[F.Column]:
    return [F.xxhash64(text_col).alias("mark"), F.xxhash64(F.lit(1), text_col).alias("mark2")]


class _Sets:
    """Disjoint sets of 0..n-1, joined many at a time."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.up[a], self.up[b]
            apart = a != b
            a, b = a[apart], b[apart]
            if not len(a):
                return
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))
            self.flat()

    def flat(self) -> None:
        while True:
            up = self.up[self.up]
            if (up == self.up).all():
                return
            self.up = up


def trie_links(slot: np.ndarray, value: np.ndarray, who: np.ndarray, n: int, prefix: int, errors: int = ERRORS, block: int = BLOCK) -> np.ndarray:
    """For each of ``n`` fingerprints the smallest that it is linked with here.

    A row is a turned fingerprint ``value`` of number ``who`` in a ``slot``;
    it is at home there if the slot's low ``prefix`` bits lead it, else a guest
    whose prefix differs in one bit. Guests meet those at home only.
    """
    order = np.lexsort((value, slot))
    slot, value, who = slot[order], value[order], who[order]
    lead = (value >> np.uint64(64 - prefix)).astype(np.int64)
    home = (slot & ((1 << prefix) - 1)) == lead
    first = np.flatnonzero(np.concatenate([[True], (slot[1:] != slot[:-1]) | (lead[1:] != lead[:-1])]))
    last = np.append(first[1:], len(value))
    sets = _Sets(n)
    ones: dict[int, np.ndarray] = {}

    def middle(lo, hi, bit):
        """Where, in ranges that agree above ``bit``, the rows with that bit set begin."""
        if bit not in ones:
            ones[bit] = np.concatenate([[0], np.cumsum((value >> np.uint64(bit)) & np.uint64(1), dtype=np.int32)]).astype(np.int32)
        return hi - (ones[bit][hi] - ones[bit][lo])

    def compare(alo, ahi, blo, bhi):
        """Links among all leaves of node pairs; of a node with itself, each pair once."""
        na, nb = ahi - alo, bhi - blo
        for i in range(0, len(alo), CHUNK // 32):
            part = slice(i, i + CHUNK // 32)
            size = na[part] * nb[part]
            at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            wide = np.repeat(nb[part], size)
            x, y = np.repeat(alo[part], size) + at // wide, np.repeat(blo[part], size) + at % wide
            near = np.bitwise_count(value[x] ^ value[y]) <= errors
            near &= who[x] != who[y]
            sets.join(who[x[near]], who[y[near]])

    def open_pairs(alo, ahi, blo, bhi):
        """Of node pairs those below which not all is in one set yet."""
        root = sets.up[who]
        steps = np.concatenate([[0], np.cumsum(root[1:] != root[:-1])])
        return ~((steps[ahi - 1] == steps[alo]) & (steps[bhi - 1] == steps[blo]) & (root[alo] == root[blo]))

    def walk(pairs, bit):
        """Node pairs (a, b, errors so far) whose ``bit`` comes next."""
        todo = [(pairs, bit)]
        while todo:
            (alo, ahi, blo, bhi, err), bit = todo.pop()
            ok = open_pairs(alo, ahi, blo, bhi)
            alo, ahi, blo, bhi, err = (z[ok] for z in (alo, ahi, blo, bhi, err))
            few = (ahi - alo) * (bhi - blo) <= LEAVES if bit >= 0 else np.ones(len(alo), bool)
            compare(*(z[few] for z in (alo, ahi, blo, bhi)))
            alo, ahi, blo, bhi, err = (z[~few] for z in (alo, ahi, blo, bhi, err))
            if not len(alo):
                continue
            most = 1 if bit >= 64 - block else errors
            am, bm = middle(alo, ahi, bit), middle(blo, bhi, bit)
            parts = [(alo, am, blo, bm, err), (am, ahi, bm, bhi, err), (alo, am, bm, bhi, err + 1), (am, ahi, blo, bm, err + 1)]
            made = [np.concatenate(z) for z in zip(*parts, strict=True)]
            ok = (made[0] < made[1]) & (made[2] < made[3]) & (made[4] <= most)
            made = [z[ok] for z in made]
            for i in range(0, len(made[0]), CHUNK):
                todo.append((tuple(z[i : i + CHUNK] for z in made), bit - 1))

    # Each node with itself: down to small nodes, keeping the pairs of siblings on the way.
    lo, hi, bit, siblings = first[home[first]], last[home[first]], 63 - prefix, []
    while len(lo) and bit >= 0:
        few = (hi - lo) ** 2 <= LEAVES
        compare(lo[few], hi[few], lo[few], hi[few])
        lo, hi = lo[~few], hi[~few]
        mid = middle(lo, hi, bit)
        both = (lo < mid) & (mid < hi)
        siblings.append((lo[both], mid[both], mid[both], hi[both], np.ones(int(both.sum()), np.int64), bit))
        lo, hi = np.concatenate([lo[lo < mid], mid[mid < hi]]), np.concatenate([mid[lo < mid], hi[mid < hi]])
        bit -= 1
    for *pairs, bit in reversed(siblings):
        walk(pairs, bit - 1)
    # Those at home with each group of guests.
    own = np.full(len(first), -1)
    slots, at = np.unique(slot[first], return_inverse=True)
    where = np.full(len(slots), -1)
    where[at[home[first]]] = np.flatnonzero(home[first])
    own = where[at]
    guest = np.flatnonzero(~home[first] & (own >= 0))
    if len(guest):
        walk((first[own[guest]], last[own[guest]], first[guest], last[guest], np.ones(len(guest), np.int64)), 63 - prefix)
    return sets.up


def links(fps: DataFrame, distinct: int, errors: int = ERRORS) -> DataFrame:
    """(fp, to): enough links between the distinct fingerprints of column ``fp`` to connect all within ``errors`` (4 or 5) bits."""
    if not 0 <= errors <= 5:
        raise ValueError("three blocks of which one has at most one error take up to 5 errors")
    prefix = min(20, max(6, math.ceil(math.log2(max(distinct, 1) / 2**15))))
    low = (1 << prefix) - 1
    # Each fingerprint is at home in three slots, and a guest in half a slot for each bit of the prefix.
    parts = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-distinct * 3 * (2 + prefix) // (2 * TASK_ROWS)))
    turned = [F.col("fp") if not r else F.shiftleft("fp", r).bitwiseOR(F.shiftrightunsigned("fp", 64 - r)) for r in (0, BLOCK, 2 * BLOCK)]
    rows = F.explode(F.array(*[F.struct(F.lit(i << prefix).alias("of"), v.alias("value")) for i, v in enumerate(turned)]))
    dealt = fps.select(rows.alias("r")).select("r.*").withColumn("lead", F.shiftrightunsigned("value", 64 - prefix).bitwiseAND(low).cast("int"))
    flips = F.filter(F.transform(F.array(*[F.lit(1 << i) for i in range(prefix)]), lambda m: F.when(F.col("lead").bitwiseAND(m) != 0, F.col("lead") - m)), lambda x: x.isNotNull())
    dealt = dealt.select("value", F.explode(F.concat(F.array(F.col("lead")), flips)).alias("to"), "of").select((F.col("of") + F.col("to")).cast("long").alias("slot"), "value")
    found = None
    while True:
        # What one slot holds goes to one task: those that are full are dealt on by their next bits.
        full = cut(dealt.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > FULL).select("slot")) if prefix + DEEPER <= BLOCK else None
        deeper = full is not None and not full.isEmpty()
        part = dealt.join(full, "slot", "left_anti") if deeper else dealt
        part = _linked(part, prefix, errors, parts)
        found = part if found is None else found.unionByName(part)
        if not deeper:
            return found
        low = (1 << DEEPER) - 1
        own = F.shiftrightunsigned("value", 64 - prefix - DEEPER).bitwiseAND(low).cast("int")
        home = F.shiftrightunsigned("value", 64 - prefix).bitwiseAND((1 << prefix) - 1) == F.col("slot").bitwiseAND((1 << prefix) - 1)
        rows = dealt.join(full, "slot", "left_semi").withColumns({"own": own, "home": home})
        # A guest has spent its error before these bits; one at home may spend it on one of them.
        cleared = F.filter(F.transform(F.array(*[F.lit(1 << i) for i in range(DEEPER)]), lambda m: F.when(F.col("home") & (F.col("own").bitwiseAND(m) != 0), F.col("own") - m)), lambda x: x.isNotNull())
        dealt = rows.select("value", F.explode(F.concat(F.array("own"), cleared)).alias("to"), "slot").select((F.shiftleft(F.col("slot").cast("long"), DEEPER) + F.col("to")).alias("slot"), "value")
        prefix += DEEPER


def _linked(dealt: DataFrame, prefix: int, errors: int, parts: int) -> DataFrame:
    """(fp, to) of rows (slot, value), whose slots are a turn and ``prefix`` bits, over ``parts`` tasks."""

    def run(batches):
        """Walks whole slots, as many at a time as come to ``TOGETHER`` rows; rows come by ascending slot."""
        slots, values = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for b in batches:
            slots.append(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            values.append(b.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
            if sum(map(len, slots)) < TOGETHER:
                continue
            slot, value = np.concatenate(slots), np.concatenate(values)
            done = int(np.searchsorted(slot, slot[-1]))  # the last slot may go on
            if done:
                yield walked(slot[:done], value[:done])
            slots, values = [slot[done:]], [value[done:]]
        slot, value = np.concatenate(slots), np.concatenate(values)
        if len(slot):
            yield walked(slot, value)

    def walked(slot, value):
        turn = ((slot >> prefix) * BLOCK).astype(np.uint64)
        fp, who = np.unique((value >> turn) | np.where(turn > 0, value << (np.uint64(64) - np.maximum(turn, np.uint64(1))), np.uint64(0)), return_inverse=True)
        up = trie_links(slot, value, who, len(fp), prefix, errors)
        away = np.flatnonzero(up != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[away].view(np.int64)), pa.array(fp[up[away]].view(np.int64))], ["fp", "to"])

    return dealt.repartition(parts, "slot").sortWithinPartitions("slot").mapInArrow(run, "fp long, to long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): connected components of an undirected edge table (a, b), root the smallest node.

    Alternates large-star and small-star steps: minima are taken before the
    shuffle, so that a hub costs a row a task, and every round is cut off in the
    shared checkpoint folder. Ends when a round changes nothing.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    state = None
    while True:
        new_state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if new_state[0] == 0 or new_state == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = new_state
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("v", "m").filter("v != m").union(low.select("u", "m"))
        now = cut(small.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).distinct())


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", errors: int = ERRORS) -> DataFrame:
    """(doc_id, fp long, root long, component_id, mark long, mark2 long): ``component_id`` is the smallest doc_id that links reach.

    ``root`` names the component by a fingerprint, also where ids are null.
    Texts without words have fingerprint 0 and are linked like any other.
    Repeated rows give a row each; texts are taken whole; other columns play no
    part. A component of null ids alone has a null ``component_id``.
    """
    docs = cut(fingerprints(df, id_col, text_col))
    fps = cut(docs.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(fps.select("fp"), fps.count(), errors).select(F.col("fp").alias("a"), F.col("to").alias("b")))
    rooted = fps.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return docs.join(rooted.select("fp", "root").join(ids, "root"), "fp").select("doc_id", "fp", "root", "component_id", "mark", "mark2")


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", errors: int = ERRORS) -> DataFrame:
    """The rows of ``df`` of which each component keeps one: that with the smallest id (null ids only where there is no other), of equal ids that with the least hash of its text."""
    got = classes(df, id_col, text_col, errors)
    marks = free(df, "_mark", "_mark2")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark", "mark2"))
    keep = got.groupBy("root").agg(first.alias("k")).select(F.col("k.doc_id").alias(id_col), F.col("k.mark").alias(marks[0]), F.col("k.mark2").alias(marks[1]))
    rows = df.withColumns(dict(zip(marks, _marks(text_col), strict=True)))
    named = rows.filter(F.col(id_col).isNotNull()).join(keep.filter(F.col(id_col).isNotNull()), [id_col, *marks], "left_semi").dropDuplicates([id_col, *marks])
    if _has_nulls(df, id_col):
        unnamed = rows.filter(F.col(id_col).isNull()).join(keep.filter(F.col(id_col).isNull()).select(*marks), marks, "left_semi").dropDuplicates(marks)
        named = named.unionByName(unnamed)
    return named.drop(*marks)


def _has_nulls(df: DataFrame, col: str) -> bool:
    return bool(df.filter(F.col(col).isNull()).take(1))


def hex16(fp) -> F.Column:
    """16 lower-case hex digits of a long."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
