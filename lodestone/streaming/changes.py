"""Structured Streaming: debounced change feeds, running counts, and stateful turns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.session import cut
from lodestone.sources import manifests


def debounced(changes: DataFrame, key: str = "path", ts: str = "ts", gap: str = "3 seconds", late: str = "1 minute") -> DataFrame:
    """(key, start, end, changes): bursts of changes that a rest of ``gap`` ends; rows later than ``late`` are left out."""
    rows = changes.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    out = rows.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("changes"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "changes")


class Merged:
    """A table at ``target`` that holds the latest row of each key, kept by ``foreachBatch``.

    Keys are dealt into ``buckets`` by hash (one, unless told: then each batch
    writes the whole table; large tables want about one per 100 MB). A batch reads and writes anew only
    the buckets that it touches, into a folder of its own, and then puts a
    manifest in place that names each bucket's folder: until then readers see
    the table as of the batch before. A batch that comes again changes nothing.
    Without a manifest the table is empty, which only batch ``first`` may find;
    a folder that the manifest names and that is gone raises.
    """

    def __init__(self, target: str, key: str, order: str, buckets: int = 1, first: int = 0):
        self.target, self.key, self.order, self.buckets, self.first = target.rstrip("/"), key, order, buckets, first

    def manifest(self, spark) -> dict | None:
        return manifests.read(spark, f"{self.target}/_manifest.json")

    def _read(self, spark, manifest: dict, buckets) -> DataFrame | None:
        folders = [f"{self.target}/batch={manifest['buckets'][str(b)]}/_bucket={b}" for b in sorted(buckets) if str(b) in manifest["buckets"]]
        return spark.read.parquet(*folders) if folders else None

    def read(self, spark) -> DataFrame | None:
        """The table as of the last batch that ended; None before any."""
        manifest = self.manifest(spark)
        return self._read(spark, manifest, range(self.buckets)) if manifest else None

    def __call__(self, batch: DataFrame, number: int) -> None:
        from lodestone.operators.windows import latest_wins

        spark = batch.sparkSession
        manifest = self.manifest(spark)
        if manifest is None:
            if number > self.first:
                raise ValueError(f"batch {number} finds no table at {self.target}; an empty one is only there at batch {self.first}")
            manifest = {"batch": number - 1, "buckets": {}, "count": self.buckets}
        if manifest["count"] != self.buckets:
            raise ValueError(f"the table has {manifest['count']} buckets")
        if number <= manifest["batch"]:
            return
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        rows = cut(batch)
        touched = [r[0] for r in rows.select(bucket.alias("b")).distinct().collect()]
        old = self._read(spark, manifest, touched)
        rows = rows if old is None else old.unionByName(rows)
        if touched:
            latest_wins(rows, [self.key], F.desc(self.order)).withColumn("_bucket", bucket).write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.target}/batch={number}")
        manifests.put(spark, f"{self.target}/_manifest.json", {"batch": number, "count": self.buckets, "buckets": {**manifest["buckets"], **{str(b): number for b in touched}}}, str(number))


def merge_batches(target: str, key: str, order: str, buckets: int = 1, first: int = 0) -> Merged:
    """For foreachBatch: see :class:`Merged`."""
    return Merged(target, key, order, buckets, first)


def stateful_turns(turns: DataFrame, keep: int = 3) -> DataFrame:
    """(conv_id, turn, seen, repeats): per conversation, how many turns came before and how many of the last ``keep`` had the same text.

    Turns of one conversation have to arrive in order; state is bound by ``keep`` texts a conversation.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, last = state.get if state.exists else (0, [])
        last = list(last)
        out = []
        for r in pd.concat(frames).sort_values("turn").itertuples():  # what a batch brings of a conversation, in order
            out.append((key[0], r.turn, seen, last.count(r.text)))
            seen, last = seen + 1, [*last, r.text][-keep:]
        yield pd.DataFrame(out, columns=["conv_id", "turn", "seen", "repeats"])
        state.update((seen, last))

    return turns.select("conv_id", "turn", "text").groupBy("conv_id").applyInPandasWithState(step, "conv_id long, turn long, seen long, repeats long", "seen long, last array<string>", "append", GroupStateTimeout.NoTimeout)
