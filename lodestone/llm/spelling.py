"""Spelling variants: words one inserted, deleted or replaced code point apart, by hashes of their deletions.

Two words are near if one is the other without a code point, or if both without
the code point at the same place are equal. A word's prefix and suffix hashes
(polynomials over two primes) give the hashes of all its deletions in NumPy
arrays, whatever its length. The keys are dealt out by their leading bits and
sorted; rows of equal keys are told apart by the strings themselves, so hashes
decide nothing. A group of equal deletions holds no more words than the alphabet
has letters at each place. It gives each of its words a count and its best
neighbour, never a row for a pair.

A null text has no words; a null id reads as an empty one in the hash that
decides which runs lose a letter. Repeated rows count as often as they occur.
Other columns are not looked at. Whole texts are read in windows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, slices, texts

#: A run of letters; one in TYPO loses a letter; a word has LEAST code points and occurs MIN_COUNT times; a form occurs TIMES as often.
RUN, TYPO, LEAST, MIN_COUNT, TIMES = "[a-zÀ-ÿ]", 31, 7, 2, 10
#: Characters of a text that are read at a time; words that a task counts before it sends them on; key rows a task.
WINDOW, HELD, KEY_ROWS = 1 << 20, 200_000, 1_000_000
#: Deletions longer than this travel without their string until their key is known to be shared.
LONG = 96
#: Primes and bases of the two hashes, which make a key of 62 bits.
PRIMES, BASES, KEY_BITS = (2_147_483_647, 2_147_483_629), (1_000_003, 69_069_069), 62
OWN = -1


def _count(least: int, typo: int):
    long_runs, letter = re.compile(RUN + "{%d,}" % least), re.compile(RUN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in slices(batches):
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
                if not raw.is_valid:
                    continue
                text = raw.as_py().lower().decode()  # bytes: A-Z only
                inside: Counter[str] = Counter()
                at = 0
                while at < len(text):
                    end = min(len(text), at + WINDOW)
                    while end < len(text) and letter.match(text, end):
                        end += 1
                    inside.update(long_runs.findall(text, at, end))
                    at = end
                start = f"{'' if doc_id is None else doc_id}:"
                for word, n in inside.items():
                    h = zlib.crc32((start + word).encode())
                    if typo and h % typo == 0:
                        k = h % len(word)
                        word = word[:k] + word[k + 1 :]
                        if len(word) < least:
                            continue
                    counts[word] += n
                if len(counts) > HELD:
                    yield _counted(counts)
                    counts = Counter()
        if counts:
            yield _counted(counts)

    return run


def _counted(counts: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, min_count: int = MIN_COUNT, typo: int = TYPO) -> DataFrame:
    """(word, n) of the runs of letters, after the planned typing errors (``typo`` 0: none)."""
    part = texts(docs, id_col, text_col).mapInArrow(_count(least, typo), "word string, n long")
    return part.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def hashes(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of words of one length (rows of code points): the key of each, and of each without its i-th code point."""
    rows, n = points.shape
    whole, without = np.zeros(rows, np.int64), np.zeros((rows, n), np.int64)
    x = points.astype(np.int64) + 1
    for prime, base in zip(PRIMES, BASES, strict=True):
        before, after = np.zeros((rows, n + 1), np.int64), np.zeros((rows, n + 1), np.int64)
        power = np.ones(n + 1, np.int64)
        for i in range(n):
            before[:, i + 1] = (before[:, i] * base + x[:, i]) % prime
            power[i + 1] = power[i] * base % prime
        for i in range(n - 1, -1, -1):
            after[:, i] = (x[:, i] * power[n - 1 - i] + after[:, i + 1]) % prime
        whole = (whole << 31) | before[:, n]
        without = (without << 31) | ((before[:, :-1] * power[n - 1 :: -1][:n] + after[:, 1:]) % prime)
    return whole, without


def _keys(long: int) -> object:
    """Rows of (key, place, word, n): of every word itself and of all its deletions.

    ``word`` is left null where what is hashed is longer than ``long``, and travels as its number only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, n = np.asarray(batch.column(0)), np.asarray(batch.column(2))
            word = np.array(batch.column(1).to_pylist(), object)
            size = np.fromiter(map(len, word), np.int64, len(word))
            for length in np.unique(size):
                found = np.flatnonzero(size == length)
                step = max(1, 200_000 // int(length))
                for at in (found[i : i + step] for i in range(0, len(found), step)):
                    points = np.frombuffer("".join(word[at]).encode("utf-32-le"), np.uint32).reshape(len(at), length)
                    whole, without = hashes(points)
                    for keys, places, kept in ((whole[:, None], [OWN], length <= long), (without, range(length), length - 1 <= long)):
                        k = keys.shape[1]
                        for j in range(0, k, 200_000):
                            wide = min(k - j, 200_000)
                            strings = np.repeat(word[at], wide) if kept else np.full(len(at) * wide, None, object)
                            columns = [keys[:, j : j + wide].ravel(), np.tile(np.array(places[j : j + wide], np.int32), len(at)), np.repeat(number[at], wide), strings, np.repeat(n[at], wide)]
                            yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2]), pa.array(columns[3], pa.string()), pa.array(columns[4])], ["key", "place", "number", "word", "n"])

    return run


def neighbours(rows: list[tuple[int, str, int]]) -> Iterator[tuple[str, int, int, str]]:
    """Of rows (place, word, n) of one key: each word's count of near words here, and the best of them with its n."""
    by_string: dict[str, dict[int, list[tuple[int, str]]]] = defaultdict(lambda: defaultdict(list))
    for place, word, n in rows:
        by_string[word if place == OWN else word[:place] + word[place + 1 :]][place].append((-n, word))
    for places in by_string.values():
        own = places.pop(OWN, None)
        for group in places.values():  # replaced at the same place
            if len(group) > 1:
                first, second = sorted(group)[:2]
                for x in group:
                    other = second if x == first else first
                    yield x[1], len(group) - 1, -other[0], other[1]
        if own and places:  # one is the other without a code point
            longer = {x for group in places.values() for x in group}
            best = min(longer)
            yield own[0][1], len(longer), -best[0], best[1]
            for x in longer:
                yield x[1], 1, -own[0][0], own[0][1]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the words in rows (key, place, word, n) sorted by key; a group may go on in the next batch."""
    rest: pa.Table | None = None

    def linked(t: pa.Table) -> pa.RecordBatch:
        key = np.asarray(t.column(0))
        same = key[1:] == key[:-1]
        shared = np.flatnonzero(np.append(same, False) | np.append(False, same))
        key = key[shared]
        rows = list(zip(*(t.column(i).take(pa.array(shared)).to_pylist() for i in (1, 2, 3)), strict=True))
        starts = np.append(np.flatnonzero(np.diff(key, prepend=-1)), len(key)).tolist()
        out = [x for a, b in zip(starts, starts[1:], strict=False) for x in neighbours(rows[a:b])]
        word, count, n, form = zip(*out, strict=True) if out else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(count, pa.int64()), pa.array(n, pa.int64()), pa.array(form, pa.string())], ["word", "n_near", "near_n", "near"])

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        key = np.asarray(t.column(0))
        done = int(np.searchsorted(key, key[-1]))
        if done:
            yield linked(t.slice(0, done))
        rest = t.slice(done)
    if rest is not None:
        yield linked(rest)


def links(vocabulary: DataFrame, long: int = LONG) -> DataFrame:
    """(word, n_near, near_n, near) of words (number, word, n) that have near words: how many, and the one of largest n."""
    size, longest = vocabulary.agg(F.coalesce(F.sum(F.length("word") + 1), F.lit(0)), F.coalesce(F.max(F.length("word")), F.lit(0))).first()
    keys = vocabulary.select("number", "word", "n").mapInArrow(_keys(long), "key long, place int, number long, word string, n long")
    rows = keys.filter("word is not null").drop("number")
    if longest > long:
        far = keys.filter("word is null").drop("word", "n")
        shared = far.groupBy("key").count().filter("count > 1").select("key")
        rows = rows.unionByName(far.join(shared, "key").join(vocabulary, "number").select("key", "place", "word", "n"))
    parts = max(int(vocabulary.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // KEY_ROWS))
    radix = F.shiftright("key", KEY_BITS - min(40, (16 * parts).bit_length()))
    dealt = rows.repartition(parts, radix).sortWithinPartitions("key").select("key", "place", "word", "n")
    found = dealt.mapInArrow(_groups, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.n")).alias("near_n"), F.col("best.near").alias("near"))


def variants(counted: DataFrame, times: int = TIMES, long: int = LONG) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct words (word, n).

    A form has ``times`` the count of its word, so chains have no circles and at
    most log(n) links; roots are found by doubling.
    """
    vocabulary = cut(counted.select(F.monotonically_increasing_id().alias("number"), "word", "n"))
    joined = vocabulary.join(links(vocabulary, long), "word", "left")
    fits = F.col("near_n") >= times * F.col("n")
    formed = cut(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("near")).alias("form"), F.when(fits, F.col("near_n")).alias("form_n")))
    roots, most = formed.filter("form is not null").select("word", F.col("form").alias("root")), formed.agg(F.max("n")).first()[0] or 1
    chain = max(1, int(math.log(most, max(2, times))) + 1)
    for _ in range(math.ceil(math.log2(chain))):
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = cut(roots.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
