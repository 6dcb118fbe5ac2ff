"""Quality rules on repetition inside a text, by suffix arrays.

Texts are read in groups; a group's words are numbered per text, so that no
repeat can reach across texts, and the suffixes of all texts are sorted
together by prefix doubling, each round only those that still have an equal.
Where neighbours in the suffix array share ``least`` words or more, the
longest-common-prefix intervals are the maximal repeated substrings; their
spans together cover a fraction of the words, which the verdict limits along
with the longest repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.common import slices, texts

WHITE = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
#: Shortest repeat that counts, in words.
LEAST = 5
#: Words beyond which a text's ranks by 1, 2, 4, ... words are not all kept, and what neighbours share is counted word by word.
WIDE = 2_000_000
#: Most of a kept text that repeats may cover, and its longest repeat in words.
MAX_COVERED, MAX_LONGEST = 0.3, 60

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "covered_words long, longest_repeat long, n_maximal_repeats long"
)


def suffix_ranks(first: np.ndarray, ends: np.ndarray, all_levels: bool = True) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words, until all differ; or only the first and the last of these.

    ``first`` numbers words so that those of different texts differ; ``ends``
    is, per position, where its text ends. A suffix shorter than the prefix
    sorts before those that go on. The last of the levels is the order of the
    suffix array.
    """
    n = len(first)
    order = np.argsort(first, kind="stable")
    new = np.concatenate([[True], first[order][1:] != first[order][:-1]])
    at = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(at, np.diff(np.append(at, n)))
    levels, width = [rank.astype(np.int32)], 1  # a batch has fewer than 2^31 words
    while True:
        size = np.diff(np.append(at, n))
        busy = np.repeat(size > 1, size)  # along the order: suffixes with an equal
        if not busy.any():
            return levels
        slot = np.flatnonzero(busy)
        who = order[slot]
        nxt = who + width
        tail = np.where(nxt < ends[who], rank[np.minimum(nxt, n - 1)], -1)
        inner = np.lexsort((tail, rank[who]))
        who, tail = who[inner], tail[inner]
        order = order.copy()
        order[slot] = who
        head = rank[who]
        split = np.concatenate([[True], (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])])
        rank = rank.copy()
        rank[who] = np.repeat(slot[split], np.diff(np.append(np.flatnonzero(split), len(who))))
        new = new.copy()
        new[slot] = split
        at = np.flatnonzero(new)
        levels = [*levels[: None if all_levels else 1], rank.astype(np.int32)]
        width *= 2


def common_prefixes(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Words that suffixes ``a`` and ``b`` (of one text) share from their starts on."""
    out = np.zeros(len(a), np.int64)
    n = len(ends)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + out, b + out
        ok = (x < ends[a]) & (y < ends[b])
        same = ok & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])
        # Equal ranks mean 2^k equal words, or that both texts end alike before them; the latter needs equal positions.
        out[same] += 1 << k
    return out


def neighbours_share(sa: np.ndarray, rank: np.ndarray, first: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """What each suffix shares with the next one of the array, in text order: a suffix shares at most a word less than the one that begins before it."""
    out = np.zeros(len(sa), np.int64)
    order, at, words, stop = (memoryview(np.ascontiguousarray(z, np.int64)) for z in (sa, rank, first, ends))
    n, h = len(sa), 0
    for i in range(n):
        r = at[i]
        if r + 1 == n:
            h = 0
            continue
        j = order[r + 1]
        most = min(stop[i] - i, stop[j] - j)
        while h < most and words[i + h] == words[j + h]:
            h += 1
        out[r] = h
        h = max(0, h - 1)
    return out


def intervals(lcp: np.ndarray, least: int) -> Iterator[tuple[int, int, int, list[int]]]:
    """The LCP intervals of ``least`` words or more: (words, first, last, the suffixes between that lie in none within it).

    ``lcp[i]`` is what suffixes i and i + 1 share. An interval closes where the
    shared words fall below its own; what then has no interval yet is its own.
    """
    stack, loose = [], []  # stack: (words, first)
    for i, v in enumerate([*lcp.tolist(), 0]):
        first = i
        loose.append(i)
        while stack and stack[-1][0] > v:
            words, first = stack.pop()
            own = []
            while loose and loose[-1] >= first:
                own.append(loose.pop())
            yield words, first, i, own
        if v >= least and (not stack or stack[-1][0] < v):
            stack.append((v, first))


def maximal_repeats(lcp: np.ndarray, left: np.ndarray, least: int) -> Iterator[tuple[int, list[int]]]:
    """The intervals whose suffixes differ in the word before, ``left`` (-1: none): (words, suffixes that this is the longest repeat of).

    Where an interval's suffixes all have the same word before, the repeat that
    begins there covers it, so these spans together cover all that repeats.
    """
    change = np.concatenate([[0], np.cumsum((left[1:] != left[:-1]) | (left[1:] < 0))])
    for words, first, last, own in intervals(lcp, least):
        if change[last] != change[first]:
            yield words, own


def repeats(words: list[list[bytes]], least: int = LEAST) -> dict[str, np.ndarray]:
    """Per text: words in repeated windows of 3, words covered, longest repeat, number of maximal repeats."""
    size = np.array([len(w) for w in words], np.int64)
    zero = np.zeros(len(words), np.int64)
    out = {"window": zero.copy(), "covered": zero.copy(), "longest": zero.copy(), "maximal": zero.copy()}
    n = int(size.sum())
    if not n:
        return out
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for text in words for w in text), np.int64, n)
    text = np.repeat(np.arange(len(words)), size)
    ends = np.repeat(np.cumsum(size), size)
    first = text * len(number) + ids
    levels = suffix_ranks(first, ends, n <= WIDE)
    sa = np.empty(n, np.int64)
    sa[levels[-1]] = np.arange(n)
    if n <= WIDE:
        # Only neighbours that share their first word can share more.
        pair = np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]])
        lcp = np.zeros(n, np.int64)
        lcp[pair] = common_prefixes(levels, sa[pair], sa[pair + 1], ends)
    else:
        lcp = neighbours_share(sa, levels[-1], first, ends)
    del levels
    reach = np.zeros(n, np.int64)  # longest prefix that occurs again
    np.maximum.at(reach, sa, lcp)
    np.maximum.at(reach, sa[1:], lcp[:-1])
    again = np.flatnonzero(reach >= 3)
    out["window"] = _union(again, np.full(len(again), 3), text, len(words))
    high = np.flatnonzero(lcp >= least)
    left = np.where(np.arange(n) > np.repeat(np.cumsum(size) - size, size), ids[np.arange(n) - 1], -1)
    starts, lengths = [], []
    for run in np.split(high, np.flatnonzero(np.diff(high) > 1) + 1):
        if len(run):
            span = sa[run[0] : run[-1] + 2]
            at, of = span.tolist(), text[span[0]]
            for length, own in maximal_repeats(lcp[run], left[span], least):
                out["maximal"][of] += 1
                out["longest"][of] = max(out["longest"][of], length)
                starts += [at[i] for i in own]
                lengths += [length] * len(own)
    out["covered"] = _union(np.array(starts, np.int64), np.array(lengths, np.int64), text, len(words))
    return out


def _union(start: np.ndarray, length: np.ndarray, text: np.ndarray, texts_: int) -> np.ndarray:
    """Words of each text that lie in any of the spans."""
    diff = np.zeros(len(text) + 1, np.int64)
    np.add.at(diff, start, 1)
    np.add.at(diff, start + length, -1)
    return np.bincount(text[np.cumsum(diff[:-1]) > 0], minlength=texts_).astype(np.int64)


def rules(df: DataFrame, least: int = LEAST, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and verdict of every text: doc_id and the columns of ``SCHEMA``.

    Null and empty texts have no words and fail. A text is kept if the base
    rules pass and repeats of ``least`` words or more cover at most
    ``max_covered`` of its words and none is longer than ``max_longest``.
    Repeated rows give a row each; very long texts are taken whole; other
    columns play no part.
    """

    def run(batches):
        for b in slices(batches):
            raw = [x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()]
            words = [x.split() for x in raw]  # bytes.split() splits at the six ASCII white-space characters
            n = np.array([len(w) for w in words], np.int64)
            chars = np.array([sum(map(_code_points, w)) if not x.isascii() else sum(map(len, w)) for x, w in zip(raw, words, strict=True)], np.int64)
            symbols = np.array([len(x) - len(x.translate(None, SYMBOLS)) for x in raw], np.int64)
            lines = np.array([_dup_lines(x) for x in raw], np.int64)
            got = repeats(words, least)
            failed = (n < 50) | (100 * got["window"] > 50 * n)
            kept = ~failed & (got["covered"] <= max_covered * n) & (got["longest"] <= max_longest)
            cols = [n, chars, symbols, lines, got["window"], failed, kept, got["covered"], got["longest"], got["maximal"]]
            names = ["doc_id", *(c.split()[0] for c in SCHEMA.split(", "))]
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, cols)], names)

    kind = df.select(id_col).schema[0].dataType.simpleString()
    return texts(df, id_col, text_col).mapInArrow(run, f"doc_id {kind}, {SCHEMA}")


def _code_points(x: bytes) -> int:
    return len(x) - len(x.translate(None, _LEADS))


_LEADS = bytes(i for i in range(256) if i & 0xC0 != 0x80)


def _dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(WHITE)]
    return len(lines) - len(set(lines))
