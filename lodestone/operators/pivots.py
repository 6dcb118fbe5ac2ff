"""A vector index on disk that answers exactly: vectors by their nearest pivot and their distance to it.

Vectors are scaled to length 1, so that the largest cosine is the least distance.
Each goes to the nearest of a bounded number of pivots; files are sorted by pivot
and distance. By the triangle inequality a vector within r of a query lies in a
ring around its pivot, whose bounds the query's distance to the pivot tells: what
is outside is not read. A first look at the nearest pivots gives r, a second reads
the rings. Removed ids are rows that searches leave out.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.search import dot

#: Pivots at most: the driver and every task hold them.
MAX_PIVOTS = 256
#: Room for rounding in the bounds of a ring.
SLACK = 1e-9


def _near(pivots: np.ndarray):
    """Adds to (id, v) the nearest pivot and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.asarray(b.column(1).flatten()).reshape(b.num_rows, -1)
            square = np.maximum(0.0, 2.0 - 2.0 * (x @ pivots.T))  # all of length 1
            best = square.argmin(1)
            far = np.sqrt(((x - pivots[best]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(best.astype(np.int32)), pa.array(far), b.column(0), b.column(1)], ["pivot", "far", "id", "v"])

    return run


class PivotIndex:
    """Vectors of one length in ``folder``: pivots, (pivot, far, id, v), the shape of each pivot's set, and removed ids."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.pivots = np.array([r.v for r in spark.read.parquet(f"{self.folder}/pivots").orderBy("h", "id").collect()])
        self.shapes = [(r.pivot, r.n, r.low, r.high) for r in spark.read.parquet(f"{self.folder}/shapes").collect()]

    @classmethod
    def build(cls, vectors: DataFrame, folder: str, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int | None = None) -> PivotIndex:
        """Writes all vectors but null and zero ones; ids are unique, null ids are left out. About the root of their number, by a hash of the id, are pivots."""
        spark = vectors.sparkSession
        rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter("id is not null")
        rows = rows.withColumn("norm", F.sqrt(dot("v", "v"))).filter("norm > 0")
        rows = rows.select("id", F.transform("v", lambda x: x / F.col("norm")).alias("v"))
        many = pivots or min(MAX_PIVOTS, max(1, math.isqrt(rows.count())))
        rows.select(F.xxhash64("id").alias("h"), "id", "v").orderBy("h", "id").limit(many).write.parquet(f"{folder}/pivots")
        chosen = np.array([r.v for r in spark.read.parquet(f"{folder}/pivots").orderBy("h", "id").collect()])
        placed = rows.mapInArrow(_near(chosen), "pivot int, far double, id long, v array<double>")
        placed.repartitionByRange("pivot", "far").sortWithinPartitions("pivot", "far").write.option("parquet.block.size", str(8 << 20)).parquet(f"{folder}/vectors")
        shape = spark.read.parquet(f"{folder}/vectors").groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("low"), F.max("far").alias("high"))
        shape.write.parquet(f"{folder}/shapes")
        return cls(spark, folder)

    def remove(self, ids: DataFrame, id_col: str = "vec_id") -> None:
        """Leaves the vectors of ``ids`` out of all later searches; nothing else is written."""
        ids.select(F.col(id_col).cast("long").alias("id")).filter("id is not null").distinct().write.parquet(f"{self.folder}/removed/{uuid.uuid4().hex}")

    def _removed(self) -> DataFrame | None:
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        place = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/removed")
        if not place.getFileSystem(conf).exists(place):
            return None
        return self.spark.read.option("recursiveFileLookup", "true").schema("id long").parquet(f"{self.folder}/removed")

    def _read(self, rings: Column) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.folder}/vectors").filter(rings)
        removed = self._removed()
        return rows if removed is None else rows.join(removed.distinct(), "id", "left_anti")

    def rings(self, to: np.ndarray, r: float) -> Column:
        """Where vectors within ``r`` of a query can lie, whose distances to the pivots are ``to``."""
        parts = [(F.col("pivot") == p) & F.col("far").between(max(0.0, float(to[p]) - r - SLACK), float(to[p]) + r + SLACK) for p, _, low, high in self.shapes if to[p] - r - SLACK <= high and to[p] + r + SLACK >= low]
        return reduce(lambda a, b: a | b, parts, F.lit(False))

    def search(self, query: list[float], k: int = 10, floor: float = -1.0) -> DataFrame:
        """(id, score): the ``k`` vectors of largest cosine with ``query``, at least ``floor``; ties by id. As many as a scan finds."""
        q = np.array(query, float)
        q = q / np.sqrt(q @ q)
        to = np.sqrt(((self.pivots - q) ** 2).sum(1)) if len(self.pivots) else np.zeros(0)
        literal = F.array(*[F.lit(float(x)) for x in q])
        scored = lambda rows: rows.select("id", dot("v", literal).alias("score"))
        # The nearest pivots with enough vectors bound how far the k-th can be; fewer found (some removed): all may count.
        first, n = [], 0
        for p, size, _, _ in sorted(self.shapes, key=lambda s: to[s[0]]):
            first.append(p)
            n += size
            if n >= 2 * k:
                break
        near = scored(self._read(F.col("pivot").isin(first))).orderBy(F.desc("score")).limit(k).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).first()
        least = max(floor, near.least if near.n == k else -1.0)
        r = math.sqrt(max(0.0, 2.0 - 2.0 * least)) + 1e-7
        return scored(self._read(self.rings(to, r))).filter(F.col("score") >= floor).orderBy(F.desc("score"), "id").limit(k)
