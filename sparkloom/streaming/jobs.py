"""Structured Streaming jobs: ring alerts, telemetry averages, keyed counts, keyed and file sinks."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkloom.operators.rings import MAX_RINGS, rings_udf
from sparkloom.sources.folders import Files, Versions
from sparkloom.sources.log import Log
from sparkloom.sources.readers import alert_json


def ring_alerts(transactions: DataFrame, window: str = "5 seconds", delay: str | None = "5 seconds", most: int = MAX_RINGS, event_time: bool = True) -> DataFrame:
    """One alert per tumbling window that has rings: start, end, rings and the alert's JSON.

    Windows are on event time by default, so batch and stream agree; with ``event_time`` off rows are stamped as they
    arrive and no watermark is set. Edges are collected distinct per window; a window is one function call.
    """
    ts = F.timestamp_millis("timestamp") if event_time else F.current_timestamp()
    rows = transactions.where("senderAccount <> receiverAccount").select(ts.alias("ts"), F.struct(F.col("senderAccount").alias("src"), F.col("receiverAccount").alias("dst")).alias("e"))
    if rows.isStreaming and event_time and delay:
        rows = rows.withWatermark("ts", delay)
    windows = rows.groupBy(F.window("ts", window).alias("w")).agg(F.collect_set("e").alias("edges"))
    found = windows.select("w.start", "w.end", rings_udf(most)("edges").alias("rings")).where(F.size("rings") > 0)
    return found.withColumn("alert", alert_json(F.col("start"), F.col("end"), F.col("rings")))


def window_averages(telemetry: DataFrame, window: str = "10 seconds", delay: str = "10 seconds") -> DataFrame:
    """The average temperature of each sensor and tumbling window; rows later than the watermark are dropped in streams."""
    rows = telemetry.select("sensor_id", "temperature", F.timestamp_millis("timestamp").alias("ts"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", delay)
    out = rows.groupBy(F.window("ts", window).alias("w"), "sensor_id").agg(F.avg("temperature").alias("avg_temperature"), F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "sensor_id", "avg_temperature", "n")


def keyed_counts(log: DataFrame, key: str = "payload") -> DataFrame:
    """Exactly-once counts per key; state and position commit together in the query's checkpoint."""
    return log.groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("count"))


def count_next(log: Log, path: str, limit: int) -> int:
    """Counts the next ``limit`` records of a log into the table of counts at ``path``; returns how many there were.

    The new table and the position after it are named by one small file, which is put in place as a whole. So a job that dies at
    any moment and starts again counts every record exactly once.
    """
    kept, files = Versions(log.spark, f"{path}/commits"), Files(log.spark, f"{path}/tables")
    now = json.loads(kept.load() or b'{"next": 0, "table": null}')
    first = max(now["next"], log.first_offset())
    rows = log.read_from(first, limit)
    n = min(limit, log.next_offset() - first)
    if n <= 0:
        return 0
    for name in set(files.names()) - {now["table"]}:
        files.delete(name)
    counts, table = keyed_counts(rows), f"counts-{uuid.uuid4().hex}"
    if now["table"]:
        old = log.spark.read.schema("key string, count long").parquet(f"{path}/tables/{now['table']}")
        counts = counts.unionByName(old).groupBy("key").agg(F.sum("count").alias("count"))
    counts.write.parquet(f"{path}/tables/{table}")
    kept.save(json.dumps({"next": first + n, "table": table}).encode())
    return n


def counted(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The table of counts that :func:`count_next` keeps at ``path``, and the position up to which it counts."""
    now = json.loads(Versions(spark, f"{path}/commits").load() or b'{"next": 0, "table": null}')
    if not now["table"]:
        return spark.createDataFrame([], "key string, count long"), now["next"]
    return spark.read.schema("key string, count long").parquet(f"{path}/tables/{now['table']}"), now["next"]


def naive_counts(log: DataFrame, crash_at: int, state_every: int = 500, offset_every: int = 1000) -> DataFrame:
    """What counts become if state and position are kept apart and the job dies once: rows between the last kept position
    and the last kept state are counted twice."""
    state, position = crash_at // state_every * state_every, crash_at // offset_every * offset_every
    again = log.where((F.col("offset") >= position) & (F.col("offset") < state))
    return keyed_counts(log.unionAll(again))


def to_files(stream: DataFrame, path: str, checkpoint: str, kind: str = "parquet", once: bool = False, **options: str) -> StreamingQuery:
    """An append sink with exactly-once files."""
    writer = stream.writeStream.format(kind).options(**options).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def to_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", once: bool = False) -> StreamingQuery:
    """Calls ``write(batch, batch_id)`` for each micro-batch; a write that keeps batch_id can tell repeats."""
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode)
    return (writer.trigger(availableNow=True) if once else writer).start()


def by_key(df: DataFrame, key: str, n: int = 3, order: str = "timestamp") -> DataFrame:
    """Rows dealt by key and in order within each key, as a keyed producer would send them."""
    return df.repartition(n, key).sortWithinPartitions(order)


def ring_messages(alerts: DataFrame) -> DataFrame:
    """One row per ring of each alert's JSON; what does not parse is dropped."""
    parsed = alerts.select(F.from_json("alert", "windowStart bigint, windowEnd bigint, rings array<array<string>>").alias("a")).where("a.rings is not null")
    return parsed.select("a.windowStart", "a.windowEnd", F.explode("a.rings").alias("ring"))
