"""Structured Streaming over the driver's tables: each query runs a stream to its end and returns what its sink then holds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.rollups import Rollup
from lodestone.plans.base import query
from lodestone.session import shared_dir, table
from lodestone.streaming import changes


def _streamed(spark, d: str, name: str) -> DataFrame:
    """A table as a stream of its files; a pattern, as a stream's path may be one but not a single file."""
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")


def _drained(rows: DataFrame, sink: str, mode: str = "append") -> DataFrame:
    """What a Parquet sink holds once the stream has read all that is there."""
    spark, root = rows.sparkSession, f"{shared_dir(rows.sparkSession).rstrip('/')}/stream-{sink}-{uuid.uuid4().hex}"
    rows.writeStream.format("parquet").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{root}/rows")


@query("""WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 3600000000 THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM g),
b AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 1 HOUR AS "end", count(*)::BIGINT AS changes FROM s GROUP BY user_id, s)
SELECT user_id, start, "end", changes FROM b WHERE "end" <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""")
def streamed_bursts(spark, d):
    """[Z1, Z2, W16] A watched feed in which an hour of rest ends a burst: session windows with a watermark of a day; what is still open at the end is not yet given out."""
    found = changes.debounced(_streamed(spark, d, "events"), "user_id", "ts", "1 hour", "1 day")
    out = _drained(found, "bursts")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "changes")


@query("""WITH t AS (SELECT *, row_number() OVER w - 1 AS seen, list(coalesce(text, '')) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, seen::BIGINT AS seen, coalesce(len(list_filter(before, lambda x: x = coalesce(text, ''))), 0)::BIGINT AS repeats FROM t""")
def streamed_turns(spark, d):
    """[Z11, Z10] Turns as they come, with state a conversation: how many came before, and how many of the last three said the same."""
    turns = _streamed(spark, d, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    return _drained(changes.stateful_turns(turns), "turns")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY 1")
def streamed_latest(spark, d):
    """[Z4, X-3, S13, S16] The latest event of each user, upserted batch by batch into a table in buckets."""
    root = f"{shared_dir(spark).rstrip('/')}/stream-latest-{uuid.uuid4().hex}"
    merge = changes.merge_batches(f"{root}/rows", "user_id", "at", buckets=8)
    rows = _streamed(spark, d, "events").select("user_id", F.struct("ts", "event_id").alias("at"))
    rows.writeStream.foreachBatch(merge).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return merge.read(spark).select("user_id", "at.event_id", "at.ts")


@query("SELECT event_type, count(*)::BIGINT AS n, round(sum(value), 2) AS total, min(value) AS least, max(value) AS most, max(ts) AS last_ts, count(DISTINCT user_id)::BIGINT > 0 AS used FROM events GROUP BY 1")
def streamed_totals(spark, d):
    """[A15, A14] Totals by kind of event, kept by partial states a batch that reading merges: first the events before the middle of a month, then a stream of the others."""
    rollup = Rollup(spark, f"{shared_dir(spark).rstrip('/')}/rollup-{uuid.uuid4().hex}", ["event_type"], ["value", "ts"], "user_id")
    columns = ["event_type", "value", "ts", "user_id"]
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    rollup.add(table(spark, d, "events").filter(early).select(*columns).withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp"))), 0)
    rest = _streamed(spark, d, "events").filter(~early).select(*columns).withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")))
    state = f"{shared_dir(spark).rstrip('/')}/stream-rollup-{uuid.uuid4().hex}"
    rest.writeStream.foreachBatch(lambda batch, number: rollup.add(batch, number + 1)).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    got = rollup.read()
    return got.select("event_type", "n", F.round("value_sum", 2).alias("total"), F.col("value_least").alias("least"), F.col("value_most").alias("most"), F.timestamp_micros("ts_most").cast("timestamp_ntz").alias("last_ts"), (F.col("kinds") > 0).alias("used"))
