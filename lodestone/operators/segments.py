"""A term index in segments that never change: an update writes its own rows and no others.

A segment holds the postings (term, id, words, places) of the documents that one
update brought, each file sorted by term; ``gone`` holds the ids that an update replaced or
deleted, by which postings of earlier segments are dead. A manifest names what
counts and is put in place in one step, so that readers see the index before or
after an update. Segments of like size are merged, dead postings left out, so a
document is written again about log(n) times in all.

Searches read the pages of their own terms. A search is a tree of
:class:`Term`, :class:`Prefix`, :class:`Phrase`, :class:`And`, :class:`Or` and
:class:`Not`; one pass over the postings of all its terms tells of each document
what leaves of the tree it meets.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import tokens
from lodestone.session import dealt
from lodestone.sources import manifests

#: Segments of one size class (rows by powers of WIDER) that are merged once there are as many.
MERGE, WIDER = 4, 4


@dataclass(frozen=True)
class Term:
    word: str


@dataclass(frozen=True)
class Prefix:
    start: str


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]


class And(tuple):
    """All of its parts."""

    def __new__(cls, *parts):
        return tuple.__new__(cls, parts)


class Or(tuple):
    """Any of its parts."""

    def __new__(cls, *parts):
        return tuple.__new__(cls, parts)


@dataclass(frozen=True)
class Not:
    """What does not meet ``part``; of the documents that hold some term of the search."""

    part: object


Leaf = Term | Prefix | Phrase


def leaves(tree) -> list[Leaf]:
    if isinstance(tree, Term | Prefix | Phrase):
        return [tree]
    return [x for part in ((tree.part,) if isinstance(tree, Not) else tree) for x in leaves(part)]


def _asked(leaf: Leaf) -> Column:
    """Which postings a leaf needs."""
    if isinstance(leaf, Prefix):
        return F.col("term").startswith(leaf.start.lower())
    return F.col("term").isin([w.lower() for w in ((leaf.word,) if isinstance(leaf, Term) else leaf.words)])


def _met(leaf: Leaf) -> Column:
    """Over the postings of one document: does it meet the leaf."""
    if not isinstance(leaf, Phrase):
        return F.bool_or(_asked(leaf))
    if not leaf.words:
        return F.lit(False)
    # Places of each word; the phrase is where all stand in a row.
    first, *rest = (F.coalesce(F.max(F.when(F.col("term") == w.lower(), F.col("places"))), F.array().cast("array<int>")) for w in leaf.words)
    return F.exists(first, lambda p: reduce(lambda a, b: a & b, [F.array_contains(places, p + i) for i, places in enumerate(rest, 1)], F.lit(True)))


def _holds(tree, names: dict[Leaf, str]) -> Column:
    if isinstance(tree, Not):
        return ~_holds(tree.part, names)
    if isinstance(tree, And | Or):
        parts = [_holds(part, names) for part in tree]
        return reduce((lambda a, b: a & b) if isinstance(tree, And) else (lambda a, b: a | b), parts)
    return F.col(names[tree])


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(term, id, words, places): where in a document a term stands, from 0; null ids have none.

    A document's words are sorted and cut where the term changes within its row,
    so that places are gathered without a shuffle.
    """
    toks = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("t"))
    pairs = F.sort_array(F.transform("t", lambda x, i: F.struct(x.alias("term"), i.alias("place"))))
    rows = toks.select("id", F.size("t").alias("words"), pairs.alias("s")).filter("words > 0")
    first = lambda i: (i == 0) | (F.get("s", i)["term"] != F.get("s", i - 1)["term"])
    rows = rows.withColumn("starts", F.filter(F.sequence(F.lit(0), F.col("words") - 1), first))
    run = lambda at, j: F.slice("s", at + 1, F.coalesce(F.get("starts", j + 1), F.col("words")) - at)
    found = F.transform("starts", lambda at, j: F.struct(F.get("s", at)["term"].alias("term"), F.transform(run(at, j), lambda x: x["place"]).alias("places")))
    return rows.select("id", "words", F.explode(found).alias("p")).select("p.term", "id", "words", "p.places")


class Segments:
    """The index in ``folder``; ids are unique among the documents of an update."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def state(self) -> dict:
        return manifests.read(self.spark, f"{self.folder}/manifest.json") or {"number": 0, "segments": [], "gone": []}

    def _put(self, state: dict) -> None:
        manifests.put(self.spark, f"{self.folder}/manifest.json", state, uuid.uuid4().hex)

    def _write(self, rows: DataFrame, number: int) -> dict:
        """Postings in files sorted by term, each of the documents of one part: none is shuffled, as they are many times as many."""
        name = f"postings-{number}-{uuid.uuid4().hex}"
        rows.sortWithinPartitions("term", "id").write.parquet(f"{self.folder}/{name}")
        written = self.spark.read.parquet(f"{self.folder}/{name}")
        return {"name": name, "number": number, "rows": written.count()}

    def update(self, docs: DataFrame, deleted: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Adds ``docs``, each in place of an earlier one of its id, and takes off those of ``deleted``."""
        state = self.state()
        number = state["number"] + 1
        ids = docs.select(F.col(id_col).alias("id"))
        ids = ids if deleted is None else ids.union(deleted.select(F.col(id_col).alias("id")))
        if state["segments"]:
            name = f"gone-{number}-{uuid.uuid4().hex}"
            ids.filter("id is not null").distinct().withColumn("since", F.lit(number)).write.parquet(f"{self.folder}/{name}")
            state["gone"].append(name)
        state["segments"].append(self._write(postings(dealt(docs, id_col), id_col, text_col), number))
        state["number"] = number
        self._put(state)
        self._merge(state)

    def _live(self, state: dict, segments: list[dict], wanted: Column | None = None) -> DataFrame:
        """The postings of segments that no later update has replaced."""
        parts = []
        for s in segments:
            rows = self.spark.read.parquet(f"{self.folder}/{s['name']}")
            rows = rows if wanted is None else rows.filter(wanted)
            later = [n for n in state["gone"] if int(n.split("-")[1]) > s["number"]]
            if later:
                gone = self.spark.read.parquet(*[f"{self.folder}/{n}" for n in later]).select("id").distinct()
                rows = rows.join(gone, "id", "left_anti").select("term", "id", "words", "places")
            parts.append(rows)
        return reduce(DataFrame.unionByName, parts)

    def _merge(self, state: dict) -> None:
        """Merges the segments of a size class that has ``MERGE`` of them, and so on for what comes of it."""
        while True:
            classes: dict[int, list[dict]] = {}
            for s in state["segments"]:
                size, k = s["rows"], 0
                while size >= WIDER:
                    size, k = size // WIDER, k + 1
                classes.setdefault(k, []).append(s)
            full = next((v for _, v in sorted(classes.items()) if len(v) >= MERGE), None)
            if full is None:
                return
            # Postings of documents that later updates replaced are left out, so the merged segment counts as of the last update.
            merged = self._write(self._live(state, full), state["number"])
            state = state | {"segments": [s for s in state["segments"] if s not in full] + [merged]}
            least = min(s["number"] for s in state["segments"])
            state["gone"] = [n for n in state["gone"] if int(n.split("-")[1]) > least]
            self._put(state)

    def rows(self, wanted: Column | None = None) -> DataFrame:
        """(term, id, words, places) of the index as it stands, of the terms ``wanted``."""
        state = self.state()
        if not state["segments"]:
            return self.spark.createDataFrame([], "term string, id long, words int, places array<int>")
        return self._live(state, state["segments"], wanted)

    def matching(self, tree) -> DataFrame:
        """(id) of the documents that meet a search; those that hold none of its terms meet none."""
        named = {leaf: f"leaf{i}" for i, leaf in enumerate(dict.fromkeys(leaves(tree)))}
        wanted = reduce(lambda a, b: a | b, map(_asked, named))
        found = self.rows(wanted).groupBy("id").agg(*[_met(leaf).alias(name) for leaf, name in named.items()])
        return found.filter(_holds(tree, named)).select("id")
