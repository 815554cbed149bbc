"""Streams: line-wise ingest into an index, the query log, and event-time counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skein.functions.runtime import scratch
from skein.sources.documents import infer_mappings, split_valid, to_payload, typed
from skein.sources.store import Store


def json_lines(spark: SparkSession, path: str, files_per_batch: int = 50) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)


def ingest(lines: DataFrame, store: Store, index: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Upsert documents of a stream of JSON lines, batch by batch; lines that are no objects or don't fit become dead letters.

    A batch that is repeated after a failure writes the same documents again, which upserts make harmless.
    """
    dynamic = store.settings(index).dynamic_mapping

    def batch(df: DataFrame, _: int) -> None:
        mappings = store.mappings(index)
        df = df.where("trim(value) <> ''")
        ok = F.coalesce(F.try_parse_json("value").isNotNull() & F.trim("value").startswith("{"), F.lit(False))
        broken = df.where(~ok).select(F.sha2("value", 256).alias("id"), F.col("value").alias("payload"), F.lit("no JSON object").alias("error"), F.current_timestamp().alias("at"))
        rows = scratch(to_payload(df.where(ok)).withColumn("seq", F.monotonically_increasing_id()), "lines")
        if dynamic:
            new = {k: v for k, v in infer_mappings(rows.where("fields IS NOT NULL"), "fields", mappings).items() if k not in mappings}
            if new:
                store.update(index, new)
                mappings = mappings | new
        good, bad = split_valid(rows, mappings)
        store.upsert(index, typed(good, mappings, rest=True))
        letters = bad.unionByName(broken)
        if not letters.isEmpty():
            store.bury(letters, "stream", index)

    writer = lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


def log_events(events: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append query and click events by day; files are committed exactly once."""
    writer = events.withColumn("dt", F.to_date("ts")).writeStream.partitionBy("dt").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


def windowed_counts(events: DataFrame, window: str = "1 day", late: str = "7 days", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts by event-time window and keys (an extension); works on a stream and on a batch alike."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("ts", late)
    return e.groupBy(F.window("ts", window).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")
