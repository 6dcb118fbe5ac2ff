"""Language identification by nearest centroid.

A text is a vector of hashed character 1- to 3-grams (letters lower-cased, all
else one space), weighed by TF-IDF with ``1 + ln tf`` and of length 1. Document
frequencies are counted over all training documents. Each language has several
centroids, found by clustering a bounded sample of its training documents; a
text has the language of the centroid with the largest cosine, and is rejected
if that cosine is below ``PART`` of what nearly all texts of that language and of
like size reach: a low quantile over a part of the sample that is not clustered.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import held_out, slices, texts

#: Characters hashed at a time.
PIECE = 1 << 18
#: Buckets of n-grams (16 bits at most); centroids per language; training documents per language that are clustered, about.
BUCKETS, CENTROIDS, SAMPLE = 1 << 14, 4, 256
#: Languages at most, so that what is broadcast stays small (64 KB a centroid).
MAX_LANGUAGES = 200
#: One in APART texts of the sample is not clustered; its cosines' quantile LOW counts in sizes with FEW such texts or more; a text with less than PART of that is rejected.
APART, LOW, FEW, PART = 3, 0.01, 6, 0.5
#: Upper ends of the sizes (in n-grams) for which a language's low quantile is kept.
SIZES = (16, 64, 256, 1024)
UNKNOWN = "und"

_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Per code point the lower-case letter's code point, a mark's own, or 32 for what is neither; built once a process."""
    if not _LETTERS:
        table, mark = np.full(0x110000, 32, np.uint32), np.zeros(0x110000, bool)
        for i in range(0x110000):
            if (kind := unicodedata.category(c := chr(i))[0]) in "LM":
                low = c.lower()
                table[i], mark[i] = ord(low) if len(low) == 1 else i, kind == "M"
        _LETTERS.extend([table, mark])
    return _LETTERS[0]


def has_letter(text: str) -> bool:
    """Whether a text has a letter; marks alone (accents, vowel signs) are none."""
    table, cp = letters(), np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return bool(((table[cp] != 32) & ~_LETTERS[1][cp]).any())


def grams(text: str) -> np.ndarray:
    """The buckets of a text's n-grams, repeats included; none if it has no letter. Long texts are hashed ``PIECE`` characters at a time."""
    cp = letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not (cp != 32).any() or not has_letter(text):
        return np.zeros(0, np.uint16)
    cp = np.concatenate([[32], cp, [32]]).astype(np.uint32)
    cp = cp[np.concatenate([[True], (cp[1:] != 32) | (cp[:-1] != 32)])]
    # A piece has two characters of the next one, in which its last n-grams end but none begins.
    return np.concatenate([_hashed(cp[i : i + PIECE + 2], i + PIECE + 2 >= len(cp)) for i in range(0, max(1, len(cp) - 2), PIECE)])


def _hashed(cp: np.ndarray, last: bool) -> np.ndarray:
    """Buckets of the n-grams that begin in a piece; of the last piece also those in its final two characters."""
    n = len(cp) if last else len(cp) - 2
    with np.errstate(over="ignore"):
        one = cp * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + one[1:]
        three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(0xC2B2AE3D) + one[2:]
        h = np.concatenate([one[:n][cp[:n] != 32], two[:n], three[:n]])
        h ^= h >> np.uint32(16)
        h *= np.uint32(0x7FEB352D)
    return (h >> np.uint32(18)).astype(np.uint16)


def vector(buckets: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, weights) of the normalised TF-IDF vector."""
    count = np.bincount(buckets, minlength=BUCKETS)
    at = np.flatnonzero(count)
    w = (1.0 + np.log(count[at])) * idf[at]
    return at, w / max(float(np.sqrt(w @ w)), 1e-12)


def cluster(rows: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means; starts at the row farthest from those taken, so equal input gives equal centroids. (centroids, owner)"""
    take = [0]
    near = rows @ rows[0]
    while len(take) < min(k, len(rows)):
        far = int(near.argmin())
        if near[far] > 1 - 1e-6:
            break
        take.append(far)
        near = np.maximum(near, rows @ rows[far])
    centre = rows[take].copy()
    for _ in range(rounds):
        own = (rows @ centre.T).argmax(1)
        for j in range(len(centre)):
            s = rows[own == j].sum(0)
            if (n := float(np.sqrt(s @ s))) > 0:
                centre[j] = s / n
    return centre, (rows @ centre.T).argmax(1)


@dataclass
class Model:
    idf: np.ndarray
    langs: list[str]  # per centroid
    centroids: np.ndarray  # (BUCKETS, number of centroids), float32
    least: dict[str, np.ndarray]  # per language and size class what nearly all texts reach

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, cosine, rejected)."""
        b = grams(text) if text else np.zeros(0, np.uint16)
        if not len(b) or not self.langs:
            return UNKNOWN, 0.0, True
        at, w = vector(b, self.idf)
        cos = w @ self.centroids[at]
        best = int(cos.argmax())
        score = min(1.0, max(0.0, float(cos[best])))
        lang = self.langs[best]
        return lang, score, score < PART * float(self.least[lang][size_class(len(b))])


def size_class(n: int) -> int:
    return int(np.searchsorted(SIZES, n))


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """Learns from rows with a language; null texts and languages teach nothing.

    Document frequencies come from all rows. Centroids come from about
    ``sample`` distinct texts per language, picked by a hash of the text. No
    rows give a model that knows no language; more than ``MAX_LANGUAGES``
    languages raise.
    """
    rows = texts(train, id_col, text_col, F.col(lang_col).alias("lang")).filter("lang is not null and text is not null")

    def frequencies(batches):
        df = np.zeros(BUCKETS, np.int64)
        n = 0
        for b in slices(batches):
            for t in b.column(1).to_pylist():
                df[np.unique(grams(t))] += 1
                n += 1
        if n:
            at = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], ["bucket", "df"])

    counted = rows.select("doc_id", "text").mapInArrow(frequencies, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(BUCKETS)
    total = 1
    for r in counted:
        if r.bucket < 0:
            total = r.df
        else:
            df[r.bucket] = r.df
    idf = np.log((1.0 + total) / (1.0 + df)) + 1.0
    # Texts count once in the sample, however many rows have them.
    sizes = {r.lang: max(1, r.n) for r in rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return Model(idf, [], np.zeros((BUCKETS, 0), np.float32), {})
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(sample / n))])
    picked = F.pmod(F.xxhash64("lang", "text"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)
    some = rows.filter(picked).select("lang", "text").dropDuplicates()

    def centres(table: pa.Table) -> pa.Table:
        lang = table.column("lang")[0].as_py()
        found = [g for g in (grams(t) for t in sorted(table.column("text").to_pylist())) if len(g)]
        dense = np.zeros((len(found), BUCKETS), np.float32)
        for i, g in enumerate(found):
            at, w = vector(g, idf)
            dense[i, at] = w
        got, least = [], [0.0] * (len(SIZES) + 1)
        if found:
            # Texts are in their own order, which says nothing about them; a sample of a few texts is clustered and judged as a whole.
            apart = np.arange(len(found)) % APART == 0 if len(found) >= FEW * APART else np.zeros(len(found), bool)
            centre, _ = cluster(dense[~apart], centroids)
            got = [c.astype(np.float32).tobytes() for c in centre]
            judged = apart if apart.any() else ~apart
            cosine, size = (dense[judged] @ centre.T).max(1), np.array([size_class(len(g)) for g in found])[judged]
            low = [float(np.quantile(cosine[size == i], LOW)) if (size == i).sum() >= FEW else None for i in range(len(least))]
            # A size with few texts is judged as strictly as the least strict of the others, or of all texts.
            rest = min([x for x in low if x is not None] or [float(cosine.min())])
            least = [rest if x is None else x for x in low]
        return pa.table({"lang": pa.array([lang] * len(got), pa.string()), "centre": pa.array(got, pa.binary()), "least": pa.array([least] * len(got), pa.list_(pa.float64()))})

    rest = some.groupBy("lang").applyInArrow(centres, "lang string, centre binary, least array<double>").collect()
    rest = sorted(rest, key=lambda r: (r.lang, bytes(r.centre)))
    matrix = np.stack([np.frombuffer(bytes(r.centre), np.float32) for r in rest], 1) if rest else np.zeros((BUCKETS, 0), np.float32)
    return Model(idf, [r.lang for r in rest], np.ascontiguousarray(matrix), {r.lang: np.array(r.least) for r in rest})


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang_pred, score, rejected, ...): the nearest centroid's language of every text.

    Texts that are null or have no letter are ``und``, score 0 and rejected;
    so is all if the model knows no language. Of equal cosines the first by
    language counts. Repeated rows give a row each; very long texts are read
    whole, ``PIECE`` characters at a time. ``keep``: columns of ``df`` that the
    result takes over after these, none named as these are; other columns play
    no part. Only texts go to the Python workers, and only verdicts come back.
    """
    known = df.sparkSession.sparkContext.broadcast(model)
    kinds = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    @F.arrow_udf("lang_pred string, score double, rejected boolean")
    def judged(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            got = [known.value.predict(t.as_py()) for t in column]  # one text at a time as a Python string
            yield pa.StructArray.from_arrays([pa.array([g[i] for g in got], k.type) for i, k in enumerate(kinds)], fields=list(kinds))

    rows = texts(df, id_col, text_col, *(F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)))
    # A filter on a verdict would otherwise be planned below, with a second judgement of its own.
    got = rows.withColumn("_judged", judged.asNondeterministic()("text"))
    return got.select("doc_id", "_judged.*", *(F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)))


def learn_and_identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected): learns from the rows that are not held out, judges all."""
    model = fit(df.filter(~held_out(F.col(id_col))), id_col, text_col, lang_col)
    got = identify(df, model, id_col, text_col)
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
