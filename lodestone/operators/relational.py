"""Set-like operators: orphans, differences, deduplication, merges, similarity of pairs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import stored


def where(df: DataFrame, equal: dict[str, object] | None = None, at_least: dict[str, object] | None = None, like: dict[str, str] | None = None) -> DataFrame:
    """Conjunction of the filters given; None values filter nothing. ``like`` patterns ignore case."""
    parts = [F.col(k) == v for k, v in (equal or {}).items() if v is not None]
    parts += [F.col(k) >= v for k, v in (at_least or {}).items() if v is not None]
    parts += [F.col(k).ilike(v) for k, v in (like or {}).items() if v is not None]
    return df.filter(reduce(lambda a, b: a & b, parts)) if parts else df


def keep_least(df: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Per key the smallest id: (keys, id, copies)."""
    return df.groupBy(*keys).agg(F.min(id_col).alias(id_col), F.count(F.lit(1)).alias("copies"))


def orphans(a: DataFrame, b: DataFrame, key: str, a_name: str, b_name: str) -> DataFrame:
    """Keys that only one side has: (key, side)."""
    left = a.select(key).join(b.select(key), key, "left_anti").select(key, F.lit(a_name).alias("side"))
    return left.union(b.select(key).join(a.select(key), key, "left_anti").select(key, F.lit(b_name).alias("side")))


def structural_diff(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, change): added, removed or modified; rows alike on both sides are left out."""
    a = old.select(*keys, F.struct(value).alias("_old"))
    b = new.select(*keys, F.struct(value).alias("_new"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "modified")
    return a.join(b, keys, "full_outer").select(*keys, change.alias("change")).filter("change is not null")


def merge(old: DataFrame, new: DataFrame, key: str, replaced: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """Rows of ``old`` without those of replaced and deleted keys, and all of ``new``."""
    gone = replaced.select(key) if deleted is None else replaced.select(key).union(deleted.select(key))
    return old.join(gone.distinct(), key, "left_anti").unionByName(new)


def similar_pairs(df: DataFrame, id_col: str, terms: Column, floor: float, within: str | None = None) -> DataFrame:
    """(a, b, similarity) of rows a < b whose term sets have a Jaccard similarity of over ``floor`` (at least 0).

    Candidates share one of the rarest terms that any pair so similar must
    share (prefix filter), so no pair is looked at without a common term.
    """
    rows = df.select(F.col(id_col).alias("_id"), *([F.col(within).alias("_w")] if within else [F.lit(0).alias("_w")]), F.array_distinct(terms).alias("_t")).filter(F.size("_t") > 0)
    freq = rows.select("_w", F.explode("_t").alias("t")).groupBy("_w", "t").agg(F.count(F.lit(1)).alias("n"))
    ranked = rows.select("_id", "_w", F.explode("_t").alias("t")).join(freq, ["_w", "t"]).groupBy("_id", "_w").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda x: x["t"]).alias("s"))
    prefix = ranked.select("*", F.explode(F.slice("s", 1, (F.size("s") - F.floor(F.size("s") * floor)).cast("int"))).alias("t"))
    a, b = prefix.select(F.col("_id").alias("a"), "_w", F.col("s").alias("sa"), "t"), prefix.select(F.col("_id").alias("b"), "_w", F.col("s").alias("sb"), "t")
    pairs = a.join(b, ["_w", "t"]).filter("a < b").dropDuplicates(["_w", "a", "b"])
    sim = F.size(F.array_intersect("sa", "sb")) / F.size(F.array_union("sa", "sb"))
    return pairs.select("a", "b", sim.alias("similarity")).filter(F.col("similarity") > floor)


def contradictions(df: DataFrame, id_col: str, text_col: str, words: Column, positive: list[str], negative: list[str], within: str | None = None, at_once: int = 4096) -> DataFrame:
    """(a, b) of texts (of one ``within``, if that is given) that share a word, one with a positive and the other with a negative marker (substrings, lower-cased); ids are whole numbers.

    The texts are dealt by id into groups of about ``at_once`` (fewer, if they
    are long), and each two groups meet in a task of their own as a table of
    bits: so two texts meet once however many words they share, and a task is
    as large for a frequent word as for a rare one, at any size of the input.
    """
    low = F.lower(text_col)
    has = lambda marks: reduce(lambda x, y: x | y, [F.coalesce(low.contains(m), F.lit(False)) for m in marks])
    rows = df.select(F.col(id_col).cast("long").alias("id"), has(positive).alias("p"), has(negative).alias("n"), (F.col(within) if within else F.lit(0)).alias("k"), F.array_compact(words).alias("w"))
    rows = stored(rows.filter("(p or n) and size(w) > 0 and id is not null and k is not null"))
    groups = F.ceil(F.greatest(F.count(F.lit(1)) / at_once, F.sum(F.size("w")) / (64 * at_once))).cast("int")
    if within:
        rows, most = rows.join(rows.groupBy("k").agg(groups.alias("_g")), "k"), 1
    else:
        most = rows.agg(groups).first()[0] or 1
        rows = rows.withColumn("_g", F.lit(most))
    rows = rows.withColumn("_own", F.pmod(F.xxhash64("id"), F.col("_g")).cast("int")).withColumn("_to", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
    least, last = F.least("_own", "_to"), F.greatest("_own", "_to")
    side = F.when(least == last, 2).when(F.col("_own") == least, 0).otherwise(1)
    met = rows.select(F.concat_ws("/", F.col("k").cast("string"), least.cast("string"), last.cast("string")).alias("key"), "id", side.alias("side"), "p", "n", "w")
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism, most * (most + 1) // 2)
    return met.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_opposed, "a long, b long")


def _opposed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of rows (key, id, side, p, n, w) in order of key, those of one key at a time."""
    held, now = [], None
    for batch in batches:
        keys = batch.column(0).to_pylist()
        starts = [i for i, key in enumerate(keys) if i == 0 or key != keys[i - 1]]
        for i, j in zip(starts, [*starts[1:], len(keys)], strict=True):
            if held and keys[i] != now:
                yield from _met(pa.Table.from_batches(held))
                held = []
            now = keys[i]
            held.append(batch.slice(i, j - i))
    if held:
        yield from _met(pa.Table.from_batches(held))


#: Cells of a table of bits whose pairs go out at once; pairs of a word up to which words are met together, and pairs so met at once.
CELLS, RARE, TOGETHER = 1 << 20, 64, 1 << 20


def _met(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """The pairs of one key: texts of side 0 with those of side 1, or those of side 2 among themselves."""
    ids, side, p, n = (rows.column(i).combine_chunks().to_numpy(zero_copy_only=False) for i in (1, 2, 3, 4))
    w = rows.column(5).combine_chunks()
    word = w.flatten().dictionary_encode().indices.to_numpy()
    row = np.repeat(np.arange(len(ids)), w.value_lengths().to_numpy())
    sides = []
    for mine in (0, 1):
        chosen = (side == mine) | (side == 2)
        names, at = np.unique(ids[chosen], return_inverse=True)
        place = np.zeros(len(ids), np.int64)
        place[chosen] = at
        of = [row[np.flatnonzero((chosen & mark)[row])] for mark in (p, n)]
        said = [word[np.flatnonzero((chosen & mark)[row])] for mark in (p, n)]
        orders = [np.argsort(x, kind="stable") for x in said]
        sides.append((names, [(x[o], place[r][o]) for x, r, o in zip(said, of, orders, strict=True)]))
    (a, mine), (b, theirs) = sides
    if not len(a) or not len(b):
        return
    bits = np.zeros((len(a), len(b)), bool)
    for x, y in ((mine[0], theirs[1]), (mine[1], theirs[0])):
        _mark(bits, *x, *y)
    step = max(1, CELLS // len(b))
    for i in range(0, len(a), step):
        u, v = np.nonzero(bits[i : i + step])
        u, v = a[u + i], b[v]
        if len(side) and side[0] == 2:
            keep = u < v
            u, v = u[keep], v[keep]
        if len(u):
            yield pa.RecordBatch.from_pydict({"a": np.minimum(u, v), "b": np.maximum(u, v)})


def _mark(bits: np.ndarray, words: np.ndarray, at: np.ndarray, others: np.ndarray, there: np.ndarray) -> None:
    """Sets the bits of all (at, there) that have an equal word; words are sorted."""
    common = np.intersect1d(words, others)
    s, e = (np.searchsorted(words, common, x) for x in ("left", "right"))
    t, f = (np.searchsorted(others, common, x) for x in ("left", "right"))
    pairs = (e - s) * (f - t)
    rare = np.flatnonzero(pairs <= RARE)
    for part in np.array_split(rare, 1 + len(rare) * RARE // TOGETHER):
        one = np.repeat(part, pairs[part])
        k = np.arange(len(one)) - np.repeat(np.cumsum(pairs[part]) - pairs[part], pairs[part])
        width = (f - t)[one]
        bits[at[s[one] + k // width], there[t[one] + k % width]] = True
    line = np.zeros(bits.shape[1], bool)
    for i in np.flatnonzero(pairs > RARE):
        line[there[t[i] : f[i]]] = True
        bits[at[s[i] : e[i]]] |= line
        line[:] = False


def priority_first(parts: list[DataFrame], keys: list[str], order: str) -> DataFrame:
    """Of several answers per key the one from the first part that has any; within a part the first by ``order``. Adds ``strategy``."""
    rows = reduce(DataFrame.unionByName, [p.withColumn("strategy", F.lit(i)) for i, p in enumerate(parts)])
    w = Window.partitionBy(*keys).orderBy("strategy", order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
