"""Aggregates kept up to date: each batch adds partial states to a table, and reading merges them.

A state is a count, sums, least and largest values, and a sketch of distinct
values, all of which merge; so a batch costs its own rows, not those before it.
A batch that comes again replaces its own states. Once there are ``MERGE``
batches or more their states are merged into one, as of the last of them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources import manifests

#: Batches whose states are merged into one.
MERGE = 8


class Rollup:
    """States by ``keys`` in ``folder``, of the columns ``values`` (sum, least, largest) and ``distinct`` (sketched)."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], values: list[str], distinct: str | None = None):
        self.spark, self.folder, self.keys, self.values, self.distinct = spark, folder.rstrip("/"), keys, values, distinct

    def _state(self) -> dict:
        return manifests.read(self.spark, f"{self.folder}/manifest.json") or {"upto": -1, "batches": {}}

    def _write(self, states: DataFrame) -> str:
        name = f"states-{uuid.uuid4().hex}"
        states.write.parquet(f"{self.folder}/{name}")
        return name

    def add(self, batch: DataFrame, number: int) -> None:
        """Takes in batch ``number``; numbers that have been merged are not taken again. Also a function for foreachBatch."""
        state = self._state()
        if number <= state["upto"]:
            return
        aggs = [F.count(F.lit(1)).alias("n")]
        for v in self.values:
            # Sums of whole numbers may be over 64 bits, as those of a few thousand times in microseconds are.
            whole = batch.schema[v].dataType.typeName() in ("byte", "short", "integer", "long")
            aggs += [F.sum(F.col(v).cast("decimal(28,0)") if whole else v).alias(f"{v}_sum"), F.min(v).alias(f"{v}_least"), F.max(v).alias(f"{v}_most")]
        if self.distinct:
            aggs.append(F.hll_sketch_agg(self.distinct).alias("sketch"))
        state["batches"][str(number)] = self._write(batch.groupBy(*self.keys).agg(*aggs))
        if len(state["batches"]) >= MERGE:
            last = max(map(int, state["batches"]))
            state = {"upto": last, "batches": {str(last): self._write(self._merged(list(state["batches"].values())))}}
        manifests.put(self.spark, f"{self.folder}/manifest.json", state, uuid.uuid4().hex)

    __call__ = add

    def _merged(self, names: list[str]) -> DataFrame:
        rows = self.spark.read.parquet(*[f"{self.folder}/{n}" for n in sorted(names)])
        aggs = [F.sum("n").alias("n")]
        for v in self.values:
            kind = rows.schema[f"{v}_sum"].dataType  # merging keeps the kind, or merged states would not be read beside others
            aggs += [F.sum(f"{v}_sum").cast(kind).alias(f"{v}_sum"), F.min(f"{v}_least").alias(f"{v}_least"), F.max(f"{v}_most").alias(f"{v}_most")]
        if self.distinct:
            aggs.append(F.hll_union_agg("sketch").alias("sketch"))
        return rows.groupBy(*self.keys).agg(*aggs)

    def read(self) -> DataFrame | None:
        """(keys, n, and of each value its sum, least and largest; the estimate ``kinds`` of distinct values); None before any batch."""
        names = list(self._state()["batches"].values())
        if not names:
            return None
        rows = self._merged(names)
        return rows.withColumn("kinds", F.hll_sketch_estimate("sketch")).drop("sketch") if self.distinct else rows
