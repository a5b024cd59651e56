"""Structured Streaming ingest: landing folders of syslog lines or container lines into a LogStore."""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logloom.functions.parse import parse_container_line, parse_syslog, truncate_utf8
from logloom.functions.timeutil import nanos
from logloom.operators.aggregates import after_checkpoint, sender_counts, summary_of
from logloom.streaming.containers import keyed_state, unread
from logloom.streaming.store import LogStore

CONTAINER_SCHEMA = "host_name string, container_id string, name string, project string, service string, stream string, line string, received_at timestamp"
SYSLOG_SCHEMA = "value string, source_ip string, received_at timestamp, transport string"


def read_lines(spark: SparkSession, folder: str, max_bytes: int = 8192, max_files: int = 1000) -> DataFrame:
    """JSON files of lines with their source and receipt time, as a stream.

    Empty lines are dropped. A line of more than max_bytes is cut if its transport is udp, else dropped.
    """
    lines = spark.readStream.schema(SYSLOG_SCHEMA).option("maxFilesPerTrigger", max_files).json(folder)
    whole = F.when(F.col("transport") == "udp", truncate_utf8(F.col("value"), max_bytes)).otherwise(F.col("value"))
    return lines.withColumn("value", whole).where(F.octet_length("value").between(1, max_bytes)).drop("transport")


def read_containers(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(CONTAINER_SCHEMA).option("maxFilesPerTrigger", max_files).json(folder)


def parsed_syslog(lines: DataFrame) -> DataFrame:
    """Log fields of lines (value, source_ip, received_at)."""
    return lines.select(parse_syslog(F.col("value"), F.col("source_ip"), F.col("received_at")).alias("p"), "received_at").select("p.*", "received_at")


def parsed_containers(lines: DataFrame) -> DataFrame:
    fields = parse_container_line(*(F.col(c) for c in ("host_name", "container_id", "name", "project", "service", "stream", "line", "received_at")))
    rows = lines.select("host_name", "container_id", fields.alias("p"), "received_at").where("p IS NOT NULL").select("host_name", "container_id", "p.*", "received_at")
    return rows.withColumn("last_timestamp", F.col("timestamp"))


def ingest(lines: DataFrame, store: LogStore, checkpoint: str, containers: bool = False, every: str | None = None, blocked=lambda: False, name: str | None = None, ttl_ms: int | None = None) -> StreamingQuery:
    """Starts the stream into store; without `every` it takes what there is and ends.

    A replayed batch is committed once. Container lines not later than their container's checkpoint are dropped: by the
    store's table, or with ttl_ms by the stream's own keyed state, which touches only the containers of a batch. Streams
    into one store need a name each, kept with their checkpoint; without one it is syslog or containers.
    """
    stream, keyed = name or ("containers" if containers else "syslog"), containers and ttl_ms is not None

    def commit(batch: DataFrame, batch_id: int) -> None:
        rows = batch.drop("host_name", "container_id", "last_timestamp") if keyed else parsed_containers(batch) if containers else parsed_syslog(batch)
        if containers and not keyed:
            seen = store.checkpoints().select("host_name", "container_id", nanos(F.col("last_timestamp")).alias("checkpoint_nanos"))
            rows = after_checkpoint(rows.withColumn("entry_nanos", nanos(F.col("timestamp"))), seen).drop("entry_nanos")
        store.commit_batch(rows, batch_id, blocked(), stream)

    with keyed_state(lines.sparkSession) if keyed else contextlib.nullcontext():
        rows = unread(parsed_containers(lines), ttl_ms) if keyed else lines
        writer = rows.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def summarize(rows: DataFrame, sink: Callable[[DataFrame], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Starts the ingest summary of a stream of parsed rows: sink gets each minute's line, with its top senders, once it is over.

    The stream's state holds counts by minute and sender; a minute is over when rows of a minute and more after its end have
    come, and rows later than that are not counted. What sink gets equals summary_of(sender_counts(rows)) of a table.
    """
    counts = sender_counts(rows.withWatermark("received_at", "1 minute"))
    writer = counts.writeStream.outputMode("append").foreachBatch(lambda batch, n: sink(summary_of(batch))).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
