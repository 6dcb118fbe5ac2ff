"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie.

A model file (pieces with log scores) is read on the driver, its trie laid out
as a double array, and the arrays broadcast; their size is bound by
``MAX_MODEL_BYTES``. No piece may hold the white-space marker behind another
character, so that the best path of a text is the best paths of its chunks
``markers + word`` one after another. Each worker keeps the paths of the chunks
that it has met (bounded) and finds those of new chunks together, with array
operations over all their positions; a very long chunk is walked in windows, for
which a few bytes a character are kept.

Scores are those of the model file, as they are: tokenizers are not trained
here. A file whose scores are ranks of merges gives, of all ways to spell a
text, the one with the largest sum of these.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import slices, texts

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
MAX_MODEL_BYTES = 64 << 20
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: What an unknown character costs beyond the worst piece.
UNKNOWN_PENALTY = 10.0
#: Chunks whose paths a worker keeps, and their characters; characters of chunks that are solved together.
KEEP, KEEP_CHARS, ROOM = 100_000, 3_000_000, 60_000
#: Chunks of more characters than LONG (texts without white space) are solved alone, in windows.
LONG, WINDOW = 20_000, 1 << 16


def _varint(b: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        out |= (b[i] & 127) << shift
        shift += 7
        i += 1
        if b[i - 1] < 128:
            return out, i


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol-buffer message: (number, value)."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(b, i)
        else:
            if kind == 2:
                n, i = _varint(b, i)
            else:
                n = {1: 8, 5: 4}[kind]
            value, i = b[i : i + n], i + n
        yield key >> 3, value


def double_array(keys: list[tuple[list[int], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, value) of a trie over code sequences; codes are 1 or more.

    From state s, code c leads to ``base[s] + c`` if ``check`` there is s.
    ``value`` is the key's number at a state where one ends, else -1.
    """
    children: list[dict[int, int]] = [{}]
    ends = [-1]
    for codes, number in keys:
        at = 0
        for c in codes:
            to = children[at].get(c)
            if to is None:
                to = children[at][c] = len(children)
                children.append({})
                ends.append(-1)
            at = to
        ends[at] = number
    top = max((c for codes, _ in keys for c in codes), default=0)
    size = len(children) + 2 * top + 16
    base, check, value = [0] * size, [-1] * size, [-1] * size
    check[0] = -2
    value[0] = ends[0]
    free = 1
    todo = [(0, 0)]
    while todo:
        node, state = todo.pop()
        kids = sorted(children[node].items())
        if not kids:
            continue
        while check[free] != -1:
            free += 1
        first, at = kids[0][0], free
        while True:
            if at + top >= len(check):
                grow = len(check)
                base += [0] * grow
                check += [-1] * grow
                value += [-1] * grow
            b = at - first
            if b >= 0 and check[at] == -1 and all(check[b + c] == -1 for c, _ in kids):
                break
            at += 1
        base[state] = b
        for c, child in kids:
            check[b + c] = state
            value[b + c] = ends[child]
            todo.append((child, b + c))
    pad = [0] * (top + 1), [-1] * (top + 1), [-1] * (top + 1)
    return tuple(np.array(x + y, np.int32) for x, y in zip((base, check, value), pad, strict=True))


class Unigram:
    """A model ready for encoding and decoding; holds no Spark objects."""

    def __init__(self, model: bytes):
        if len(model) > MAX_MODEL_BYTES:
            raise ValueError(f"the model has {len(model)} bytes; the bound for what is broadcast is {MAX_MODEL_BYTES}")
        pieces, self.dummy_prefix = [], True
        for number, value in _fields(model):
            if number == 1:
                part = dict(_fields(value))
                pieces.append((part.get(1, b"").decode(), struct.unpack("<f", part[2])[0] if 2 in part else 0.0, part.get(3, NORMAL)))
            elif number == 3:
                spec = dict(_fields(value))
                if spec.get(2):
                    raise ValueError("models that normalise characters are not supported")
                if spec.get(4, 1):
                    raise ValueError("models that remove white space cannot give texts back")
                self.dummy_prefix = bool(spec.get(3, 1))
        self.pieces = [p for p, _, _ in pieces]
        byte_ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        if len(byte_ids) != 256:
            raise ValueError("the model has no 256 byte pieces to fall back to")
        self.bytes = np.array([byte_ids[f"<0x{b:02X}>"] for b in range(256)], np.int32)
        scores = [s for _, s, kind in pieces if kind == NORMAL]
        most, self.unknown_score = max(scores), min(scores) - UNKNOWN_PENALTY
        use = [(i, p, s if kind == NORMAL else len(p.encode()) * most - 0.1) for i, (p, s, kind) in enumerate(pieces) if kind in (NORMAL, USER) and p]
        if any(MARK in p.lstrip(MARK) for _, p, _ in use):
            raise ValueError("a piece has the white-space marker behind another character")
        self.newline = any("\n" in p for _, p, _ in use)
        alphabet = sorted({c for _, p, _ in use for c in p})
        self.alphabet = np.array([ord(c) for c in alphabet], np.int32)
        code = {c: i + 1 for i, c in enumerate(alphabet)}
        self.longest = max(len(p) for _, p, _ in use)
        self.scores = np.zeros(len(pieces))
        for i, _, s in use:
            self.scores[i] = s
        self.base, self.check, self.value = double_array([([code[c] for c in p], i) for i, p, _ in use])
        raw = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else p.replace(MARK, " ").encode() for p, _, kind in pieces]
        self.out = np.frombuffer(b"".join(raw), np.uint8)
        self.out_len = np.array([len(x) for x in raw], np.int64)
        self.out_at = np.cumsum(self.out_len) - self.out_len
        self.is_byte = np.zeros(len(pieces), bool)
        self.is_byte[self.bytes] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = _Numbered()
        self.ids, self.lens = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        self.done = self.held = 0

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "ids", "lens", "done", "held", "codes")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.forget()

    def _paths(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The best paths of ``chunks``: all their ids in a row, and how many each has."""
        if not hasattr(self, "codes"):
            self.codes = np.zeros(0x110000, np.int32)
            self.codes[self.alphabet] = np.arange(1, len(self.alphabet) + 1)
        width = self.longest
        size = np.array([len(c) for c in chunks], np.int64)
        # Each chunk is followed by one empty cell: the node at its end.
        cells = np.frombuffer("\0".join([*chunks, "\0" * width]).encode("utf-32-le", "surrogatepass"), np.uint32)
        start = np.cumsum(size + 1) - size - 1
        real = np.ones(len(cells), bool)
        real[start + size] = False
        real[start[-1] + size[-1] :] = False
        code = np.where(real, self.codes[cells], 0)
        # Row n, column j: what a piece of ``width - j`` characters that ends at node n brings.
        gain = np.full((len(cells) + 1, width), -np.inf)
        which = np.full((len(cells) + 1, width), -1, np.int32)
        at = np.flatnonzero(code)
        state = np.zeros(len(at), np.int32)
        for k in range(width):
            c = code[at + k]
            to = self.base[state] + c
            ok = (c > 0) & (self.check[to] == state)
            at, state = at[ok], to[ok]
            if not len(at):
                break
            ends = self.value[state]
            hit = ends >= 0
            gain[at[hit] + k + 1, width - k - 1] = self.scores[ends[hit]]
            which[at[hit] + k + 1, width - k - 1] = ends[hit]
        lone = np.flatnonzero(real)
        lone = lone[which[lone + 1, width - 1] < 0]
        gain[lone + 1, width - 1] = self.unknown_score
        best = np.full(len(cells) + 1 + width, -np.inf)  # node n is at n + width
        best[start + width] = 0.0
        took = np.zeros(len(cells) + 1, np.int32)
        back = np.arange(width)
        order = np.argsort(-size, kind="stable")
        by_size = size[order]
        for j in range(1, int(by_size[0]) + 1):
            node = start[order[: np.searchsorted(-by_size, -j, "right")]] + j
            cand = best[node[:, None] + back] + gain[node]
            top = cand.argmax(1)  # of equals the first: the longest piece
            best[node + width] = cand[np.arange(len(node)), top]
            took[node] = top
        node, owner, found = start + size, np.arange(len(chunks)), []
        while len(node):
            more = node > start[owner]
            node, owner = node[more], owner[more]
            found.append(node)
            node = node - (width - took[node])
        ends = np.sort(np.concatenate(found))
        ids = which[ends, took[ends]]
        count = np.bincount(np.searchsorted(start, ends - 1, "right") - 1, minlength=len(chunks))
        if (ids < 0).any():  # spell unknown characters in bytes
            chars = [chr(cells[e - 1]).encode("utf-8", "replace") if i < 0 else b"" for e, i in zip(ends, ids, strict=True)]
            reps = np.array([len(x) or 1 for x in chars])
            count = np.add.reduceat(reps, np.cumsum(count) - count)
            ids = np.repeat(ids, reps)
            ids[ids < 0] = self.bytes[np.frombuffer(b"".join(chars), np.uint8)]
        return ids.astype(np.int32), count.astype(np.int64)

    def _long(self, chunk: str) -> np.ndarray:
        """The ids of the best path of one long chunk: window by window, keeping a piece and its length for each character."""
        if not hasattr(self, "codes"):
            self.codes = np.zeros(0x110000, np.int32)
            self.codes[self.alphabet] = np.arange(1, len(self.alphabet) + 1)
        n, width = len(chunk), self.longest
        cells = np.frombuffer(chunk.encode("utf-32-le", "surrogatepass"), np.uint32)
        took, piece = np.zeros(n + 1, np.uint16), np.zeros(n + 1, np.int32)
        best = [0.0]  # of the nodes up to the window's first, the last ``width`` of them
        for a in range(0, n, WINDOW):
            b = min(a + WINDOW, n)
            # Pieces that end in the window begin in it or up to ``width`` characters before.
            low = max(0, a - width + 1)
            code = np.append(self.codes[cells[low:b]], np.zeros(width, np.int32))
            at = np.flatnonzero(code)
            state, ends, sizes, ids = np.zeros(len(at), np.int32), [], [], []
            for k in range(width):
                c = code[at + k]
                to = self.base[state] + c
                ok = (c > 0) & (self.check[to] == state)
                at, state = at[ok], to[ok]
                hit = (self.value[state] >= 0) & (at + low + k >= a)
                ends.append(at[hit] + low + k + 1)
                sizes.append(np.full(int(hit.sum()), k + 1))
                ids.append(self.value[state[hit]])
            ends, sizes, ids = map(np.concatenate, (ends, sizes, ids))
            order = np.lexsort((-sizes, ends))
            cuts = np.searchsorted(ends[order], np.arange(a + 1, b + 2)).tolist()
            sizes, ids = sizes[order], ids[order]
            size, number, score = sizes.tolist(), ids.tolist(), self.scores[ids].tolist()
            some_took, some_piece = [0] * (b - a), [0] * (b - a)
            for j in range(b - a):
                top, long, which = -np.inf, 1, -1
                for h in range(cuts[j], cuts[j + 1]):  # the longest first, which wins among equals
                    if (z := best[-size[h]] + score[h]) > top:
                        top, long, which = z, size[h], number[h]
                if cuts[j] == cuts[j + 1] or size[cuts[j + 1] - 1] > 1:
                    if (z := best[-1] + self.unknown_score) > top:
                        top, long, which = z, 1, -1
                best.append(top)
                some_took[j], some_piece[j] = long, which
            best = best[-width:]
            took[a + 1 : b + 1], piece[a + 1 : b + 1] = some_took, some_piece
        out, at = [], n
        while at:
            if piece[at] >= 0:
                out.append(int(piece[at]))
            else:
                out += self.bytes[np.frombuffer(chr(cells[at - 1]).encode("utf-8", "replace"), np.uint8)[::-1]].tolist()
            at -= int(took[at])
        return np.array(out[::-1], np.int32)

    def _learn(self) -> None:
        new = list(self.known)[self.done :]
        self.done = len(self.known)
        self.held += sum(map(len, new))
        order = sorted(range(len(new)), key=lambda i: len(new[i]))
        at = 0
        lens, flat = np.zeros(len(new), np.int64), [None] * len(new)
        while at < len(order):
            room, end = ROOM, at
            if len(new[order[at]]) > LONG:
                flat[order[at]] = self._long(new[order[at]])
                lens[order[at]] = len(flat[order[at]])
                at += 1
                continue
            while end < len(order) and (end == at or room > 0) and len(new[order[end]]) <= LONG:
                room -= len(new[order[end]]) + 1
                end += 1
            some = order[at:end]
            ids, count = self._paths([new[i] for i in some])
            lens[some] = count
            for i, part in zip(some, np.split(ids, np.cumsum(count)[:-1]), strict=True):
                flat[i] = part
            at = end
        if new:
            self.ids.append(np.concatenate(flat))
            self.lens.append(lens)

    def encode(self, batch: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and the offsets between texts; null and empty texts have none."""
        if len(self.known) > KEEP or self.held > KEEP_CHARS:
            self.forget()
        split = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+" if self.newline else f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+").findall
        number, seen, cuts = self.known.__getitem__, [], [0]
        for t in batch:
            if t:
                seen.extend(map(number, split((MARK if self.dummy_prefix else "") + t.replace(" ", MARK))))
            cuts.append(len(seen))
        self._learn()
        self.ids, self.lens = [np.concatenate(self.ids)], [np.concatenate(self.lens)]
        index = np.array(seen, np.int64)
        ids = gather(self.ids[0], np.cumsum(self.lens[0]) - self.lens[0], self.lens[0], index)
        return ids, np.concatenate([[0], np.cumsum(self.lens[0][index])])[cuts]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of id sequences; bytes that are not UTF-8 become U+FFFD each."""
        flat = gather(self.out, self.out_at, self.out_len, ids).tobytes()
        cuts = np.concatenate([[0], np.cumsum(self.out_len[ids])])[offsets]
        out = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = flat[a:b]
            if self.dummy_prefix and part[:1] == b" ":
                part = part[1:]
            try:
                out.append(part.decode())
            except UnicodeDecodeError:
                out.append(part.decode("utf-8", "surrogateescape").encode("utf-16", "surrogatepass").decode("utf-16", "replace"))
        return out


class _Numbered(dict):
    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def gather(flat: np.ndarray, at: np.ndarray, size: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The runs ``flat[at[i] : at[i] + size[i]]`` for each i of ``index``, in a row."""
    n = size[index]
    total = int(n.sum())
    shift = np.repeat(at[index] - (np.cumsum(n) - n), n)
    return flat[shift + np.arange(total)]


def load(spark: SparkSession, path: str = DEFAULT_MODEL) -> Broadcast:
    """Reads a model on the driver and broadcasts it (bounded by ``MAX_MODEL_BYTES``)."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(Unigram(f.read()))


def encode(df: DataFrame, model: Broadcast, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>): the best path of every text.

    Null text: null ids. Empty text: no ids. A literal U+2581 is taken for a
    space. Between equal paths the one with the longer last piece wins. Rows
    keep their number and repeat as they repeat; texts are taken whole, those
    without white space in windows; other columns play no part.
    """

    def run(batches):
        for b in slices(batches):
            ids, cuts = model.value.encode(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(b.column(1), cuts, ids)], ["doc_id", "ids"])

    return texts(df, id_col, text_col).mapInArrow(run, f"doc_id {_kind(df, id_col)}, ids array<int>")


def decode(df: DataFrame, model: Broadcast, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text): what id sequences spell. Null ids: null text. Ids outside the model raise."""

    def run(batches):
        for b in batches:
            col = b.column(1)
            if not len(col):
                continue
            size = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            got = model.value.decode(col.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(size)]))
            out = [t if ok else None for t, ok in zip(got, col.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return texts(df, id_col, ids_col).mapInArrow(run, f"doc_id {_kind(df, id_col)}, text string")


def round_trip(df: DataFrame, model: Broadcast, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encoding and decoding in one pass: (doc_id, n_tokens, n_byte_tokens, ids, decoded).

    As :func:`encode` and :func:`decode`; null text gives null ids and decoded, and zero counts.
    """

    def run(batches):
        for b in slices(batches):
            m = model.value
            ids, cuts = m.encode(b.column(1).to_pylist())
            in_bytes = np.concatenate([[0], np.cumsum(m.is_byte[ids])])
            got = [t if ok else None for t, ok in zip(m.decode(ids, cuts), b.column(1).is_valid().to_pylist(), strict=True)]
            cols = [b.column(0), pa.array(np.diff(cuts)), pa.array(np.diff(in_bytes[cuts])), _lists(b.column(1), cuts, ids), pa.array(got, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "n_byte_tokens", "ids", "decoded"])

    return texts(df, id_col, text_col).mapInArrow(run, f"doc_id {_kind(df, id_col)}, n_tokens long, n_byte_tokens long, ids array<int>, decoded string")


def _kind(df: DataFrame, col: str) -> str:
    return df.select(col).schema[0].dataType.simpleString()


def _lists(texts_: pa.Array, cuts: np.ndarray, ids: np.ndarray) -> pa.Array:
    null = np.concatenate([texts_.is_null().to_numpy(zero_copy_only=False), [False]])
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32), mask=null), pa.array(ids, pa.int32()))
