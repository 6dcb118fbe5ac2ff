"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

Documents are encoded by a public tokenizer and cut at the sequence's length.
Full pieces are sequences of their own; the others are dealt into shards of
bounded size. A shard is packed by islands: each keeps a few packings and breeds
new ones. A child takes whole well-filled bins of one parent into the other, bins
that hold the same documents are dissolved, and the documents they leave, with
those of a few of the emptiest bins, go to the bin that they fit best, longest
first. After each round the best packing of every island moves to the next one.
Bins that stay poorly filled are put together with those of other shards and
packed again, from the packing they have, until one shard holds them.

A shard's packings are one row an island, so a lost executor costs a round of
its islands. Nothing is drawn from a clock: equal input gives equal packings.

A null text is an empty one: a document of its closing id alone. Repeated rows
and null ids are documents of their own. Columns other than the two named ones
are not looked at. No rows give no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, slices, texts

#: Tokens a sequence, and the id that closes a document.
CAPACITY, CLOSE = 2048, 0
#: Pieces a shard; islands a shard; rounds, between which the best move on; packings an island keeps, and children a round.
SHARD, ISLANDS, ROUNDS, KEPT, CHILDREN = 16_384, 4, 3, 4, 40
#: Largest share of the bins that a child takes from its second parent, bins it dissolves, and fill from which a bin is not packed again.
INJECTED, DISSOLVED, FULL = 0.15, 6, 0.98
#: Pieces are packed again only while they are at most this share of those before.
AGAIN = 0.75
#: Tasks that islands are dealt to at most.
TASKS = 4096
#: Words whose ids a worker keeps in a generation, and bytes of a text that are encoded at a time.
MEMO, WINDOW = 300_000, 1 << 20
MAX_MODEL_BYTES = 64 << 20
PIECES = "doc_id {}, piece int, start long, length long, ids_crc32 long"
SEED = 7


class Encoder:
    """Ids of texts by a tokenizer that splits at white space, as bytes of little-endian 32-bit numbers.

    White space ends every word of the tokenizer, so a text can be cut there.
    Latin-1 text is split into the tokenizer's words by its own pattern; the ids
    of words are kept in two generations of bounded size. Chunks with other
    letters or a special token in them go through the tokenizer as they are.
    """

    #: What the tokenizer's pattern makes of lower-case Latin-1 text; its alternatives begin with different characters.
    WORDS = re.compile("[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|'(?:s|t|re|ve|m|ll|d)|[^\\s0-9a-zªµºß-öø-ÿ²³¹¼½¾]+")
    PLAIN = re.compile("[\t-\r -~¡-ÿ]*")

    def __init__(self, model: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(model)
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)")
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelt = {c: as_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(33, 256)}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        """The ids of a word that ``young`` lacks."""
        ids = self.old.get(word)
        if ids is None:
            ids = b"".join([t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(word.translate(self.spelt))])
        if len(word) <= 64:
            if len(self.young) >= MEMO:
                self.young, self.old = {}, self.young
            self.young[word] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        kept, other = self.young.get, self._word
        return b"".join([kept(w) or other(w) for w in self.WORDS.findall(text.lower())])

    def _text(self, text: str) -> bytes:
        if self.PLAIN.fullmatch(text) and not self.special.search(text):
            return self._plain(text)
        out, plain = [], []
        for chunk in re.split("[\t-\r ]+", text):
            if self.PLAIN.fullmatch(chunk) and not self.special.search(chunk):
                plain.append(chunk)
                continue
            out += [self._plain(" ".join(plain)), np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()]
            plain = []
        return b"".join([*out, self._plain(" ".join(plain))])

    def windows(self, text: bytes) -> Iterator[bytes]:
        """The ids of a text, a window of it at a time."""
        at = 0
        while at < len(text):
            end = min(len(text), at + WINDOW)
            while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
                end += 1
            yield self._text(text[at:end].decode())
            at = end


@lru_cache(1)
def _encoder(model: str) -> Encoder:
    return Encoder(model)


def _pieces(model, capacity: int, close: int, kind: pa.DataType):
    end = int(close).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model.value)
        for batch in slices(batches):
            at, rows = [], []
            for i, text in enumerate(batch.column(1).cast(pa.large_binary())):
                left, piece = b"", 0
                for ids in (*(encoder.windows(text.as_py()) if text.is_valid else ()), end):
                    left += ids
                    while len(left) > 4 * capacity:
                        rows.append((piece, piece * capacity, capacity, zlib.crc32(left[: 4 * capacity])))
                        left, piece = left[4 * capacity :], piece + 1
                rows.append((piece, piece * capacity, len(left) // 4, zlib.crc32(left)))
                at += [i] * (piece + 1)
            piece, start, length, crc = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, close: int = CLOSE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids, ``close`` last, cut into pieces of ``capacity``.

    ``tokenizer`` is the path of the tokenizer's file, read on the driver.
    """
    model = Path(tokenizer).read_text()
    if len(model) > MAX_MODEL_BYTES:
        raise ValueError(f"the tokenizer has {len(model)} characters; the bound for what is broadcast is {MAX_MODEL_BYTES}")
    some = texts(docs, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return some.mapInArrow(_pieces(sent, capacity, close, None), PIECES.format(some.schema["doc_id"].dataType.simpleString()))


def least_bins(lens: np.ndarray, capacity: int) -> int:
    """Bins that no packing can do without: by the sum, and by what must stand apart from pieces that are too long for it."""
    count = np.bincount(lens, minlength=capacity + 1)
    size = np.arange(capacity + 1)
    most, total = np.cumsum(count), np.cumsum(count * size)
    small = np.arange(capacity // 2 + 1)  # pieces below this are left out
    half = capacity // 2
    alone = most[capacity] - most[capacity - small]
    large_n, large_sum = most[capacity - small] - most[half], total[capacity - small] - total[half]
    before = np.where(small > 0, total[small - 1], 0)
    rest = total[half] - before - (large_n * capacity - large_sum)
    return int(max(-(-int(total[capacity]) // capacity), (alone + large_n + np.maximum(0, -(-rest // capacity))).max()))


def best_fit(lens: np.ndarray, order: np.ndarray, bins: np.ndarray, fill: np.ndarray, capacity: int) -> np.ndarray:
    """Puts the pieces ``order`` into the fullest bins that have room; new bins where none has. Returns ``bins``, changed."""
    room = capacity - fill
    least = int(lens[order].min()) if len(order) else capacity
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for b in np.flatnonzero((room >= least) & (fill > 0)).tolist():
        by_room[room[b]].append(b)
        mask |= 1 << int(room[b])
    new = len(fill)
    for i, n in zip(order.tolist(), lens[order].tolist(), strict=True):
        fits = mask >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                mask ^= 1 << r
        else:
            r, b = capacity, new
            new += 1
        bins[i] = b
        by_room[r - n].append(b)
        mask |= 1 << (r - n)
    return bins


def dense(bins: np.ndarray) -> np.ndarray:
    return np.unique(bins, return_inverse=True)[1].astype(np.int32)


def fitness(bins: np.ndarray, lens: np.ndarray) -> tuple[int, int]:
    """Few bins first, then some that are full and some that are empty rather than all half full; less is better."""
    fill = np.bincount(bins, lens).astype(np.int64)
    return int((fill > 0).sum()), -int((fill * fill).sum())


def child(a: np.ndarray, b: np.ndarray, lens: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """``a`` with some of the well-filled bins of ``b``."""
    fill_a, fill_b = np.bincount(a, lens).astype(np.int64), np.bincount(b, lens).astype(np.int64)
    well = np.argsort(-fill_b, kind="stable")[: max(1, len(fill_b) // 2)]
    chosen = np.zeros(len(fill_b), bool)
    chosen[rng.choice(well, max(1, int(len(fill_b) * INJECTED * rng.random())), replace=False)] = True
    injected = chosen[b]
    gone = np.zeros(len(fill_a), bool)
    gone[a[injected]] = True
    gone[np.argsort(fill_a + rng.integers(0, max(1, capacity // 8), len(fill_a)), kind="stable")[: rng.integers(1, DISSOLVED + 1)]] = True
    loose = gone[a] & ~injected
    out = np.where(injected, len(fill_a) + b, a)
    fill = np.bincount(out[~loose], lens[~loose], len(fill_a) + len(fill_b)).astype(np.int64)
    return dense(best_fit(lens, np.flatnonzero(loose), out, fill, capacity))


def evolve(lens: np.ndarray, kept: list[np.ndarray], capacity: int, seed: int, children: int = CHILDREN) -> list[np.ndarray]:
    """A round of an island: the best packings of ``kept`` and of the children bred; ``lens`` from long to short."""
    rng, least = np.random.default_rng(seed), least_bins(lens, capacity)
    ranked = sorted(((fitness(k, lens), i, k) for i, k in enumerate(kept)), key=lambda x: x[:2])
    for i in range(children):
        if ranked[0][0][0] <= least:
            break
        a, b = rng.permutation(len(ranked))[:2] if len(ranked) > 1 else (0, 0)
        new = child(ranked[a][2], ranked[b][2], lens, capacity, rng)
        score = fitness(new, lens)
        if all(score != r[0] for r in ranked):
            ranked = sorted([*ranked, (score, len(kept) + i, new)], key=lambda x: x[:2])[:KEPT]
    return [r[2] for r in ranked][:KEPT]


def first_packings(lens: np.ndarray, given: np.ndarray | None, capacity: int, seed: int) -> list[np.ndarray]:
    """What an island begins with: best fit from long to short, that of about this order, and the packing given, if any."""
    rng, out = np.random.default_rng(seed), [] if given is None else [dense(given)]
    for i in range(KEPT - len(out)):
        order = np.arange(len(lens)) if not i else np.argsort(-lens * rng.uniform(0.8, 1.25, len(lens)), kind="stable")
        out.append(dense(best_fit(lens, order, np.zeros(len(lens), np.int64), np.zeros(0, np.int64), capacity)))
    return out


STATE = "shard int, island int, lens binary, kept array<binary>, bins int, least int"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _round(capacity: int, level: int, turn: int, first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            lens = np.frombuffer(r["lens"], np.int32).astype(np.int64)
            seed = [SEED, level, turn, r["shard"], r["island"]]
            if first:
                kept = first_packings(lens, np.frombuffer(r["given"], np.int64) if r["given"] else None, capacity, seed)
            else:
                kept = [np.frombuffer(k, np.int32) for k in [*r["kept"], *([r["elite"]] if r["elite"] else [])]]
            kept = evolve(lens, kept, capacity, seed)
            row = {"shard": r["shard"], "island": r["island"], "lens": r["lens"], "kept": [k.astype(np.int32).tobytes() for k in kept], "bins": fitness(kept[0], lens)[0], "least": least_bins(lens, capacity)}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("shard", pa.int32()), ("island", pa.int32()), ("lens", pa.binary()), ("kept", pa.list_(pa.binary())), ("bins", pa.int32()), ("least", pa.int32())]))

    return run


def _gather(key: tuple, t: pa.Table) -> pa.Table:
    """A shard's pieces as one row, from long to short; ``given`` is null where they have no bins yet."""
    t = t.sort_by([("length", "descending"), ("item", "ascending")])
    given = None if t.column("bin").null_count else np.asarray(t.column("bin").combine_chunks()).tobytes()
    row = {"shard": key[0].as_py(), "items": np.asarray(t.column("item").combine_chunks()).tobytes(), "lens": np.asarray(t.column("length").combine_chunks()).astype(np.int32).tobytes(), "given": given}
    return pa.Table.from_pylist([row], pa.schema([("shard", pa.int32()), ("items", pa.binary()), ("lens", pa.binary()), ("given", pa.binary())]))


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each piece of a packed shard: its bin, its place there, and how full the bin is."""
    for r in _rows(batches):
        items, lens, bins = np.frombuffer(r["items"], np.int64), np.frombuffer(r["lens"], np.int32).astype(np.int64), np.frombuffer(r["best"], np.int32).astype(np.int64)
        order = np.argsort(bins, kind="stable")
        total = np.cumsum(lens[order]) - lens[order]
        first = np.flatnonzero(np.diff(bins[order], prepend=-1))
        offset = total - np.repeat(total[first], np.diff(np.append(first, len(order))))
        fill = np.bincount(bins, lens).astype(np.int64)
        columns = [items[order], lens[order], np.int64(r["shard"]) * (1 << 24) + bins[order], offset, fill[bins[order]]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["item", "length", "bin", "offset", "fill"])


def pack(items: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """(item, sequence_id, offset) of pieces (item, length), ``item`` a whole number of its own for each.

    ``items`` is read more than once and has to be stable.
    """
    out = items.filter(F.col("length") >= capacity).select("item", (2 * F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left = items.filter(F.col("length") < capacity).select("item", "length", F.lit(None).cast("long").alias("bin"))
    n, level = left.count(), 0
    while n:
        shards = -(-n // shard)
        tasks = min(TASKS, shards * ISLANDS)
        key = F.pmod(F.xxhash64(F.coalesce("bin", "item"), F.lit(level)), F.lit(shards)).cast("int").alias("shard")
        gathered = cut(left.select(key, "item", "length", "bin").groupBy("shard").applyInArrow(_gather, "shard int, items binary, lens binary, given binary"))
        islands = gathered.select("shard", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "lens", "given")
        state = cut(islands.repartition(tasks, "shard", "island").mapInArrow(_round(capacity, level, 0, True), STATE))
        for turn in range(1, ROUNDS):
            if not state.groupBy("shard").agg(F.min("bins").alias("bins"), F.max("least").alias("least")).filter("bins > least").limit(1).count():
                break
            moved = state.select("shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("kept")[0].alias("elite"))
            met = state.drop("bins", "least").join(moved, ["shard", "island"])
            state = cut(met.repartition(tasks, "shard", "island").mapInArrow(_round(capacity, level, turn, False), STATE))
        best = state.groupBy("shard").agg(F.min_by(F.col("kept")[0], F.struct("bins", "island")).alias("best"))
        placed = cut(gathered.drop("given").join(best, "shard").mapInArrow(_placed, "item long, length long, bin long, offset long, fill long"))
        poor = placed.filter(F.col("fill") < FULL * capacity)
        again = poor.count() if shards > 1 else 0
        last = not again or again > AGAIN * n
        done = placed if last else placed.filter(F.col("fill") >= FULL * capacity)
        # Odd numbers, with the level above the shard's bits.
        number = 2 * (F.col("bin") + F.lit(level << 56)) + 1
        out = out.unionAll(done.select("item", number.alias("sequence_id"), "offset"))
        if last:
            break
        left, n, level = poor.select("item", "length", "bin"), again, level + 1
    return out


def packed(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents with their sequences: (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    all_pieces = cut(pieces(docs, tokenizer, id_col, text_col, capacity)).withColumn("item", F.monotonically_increasing_id())
    return all_pieces.join(pack(all_pieces.select("item", "length"), capacity), "item").drop("item")
