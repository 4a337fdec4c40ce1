"""Mail as a stream: poll a folder, process each message once, keep state in snapshots."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from orderloom.operators import state as st
from orderloom.operators.state import first_by_key, merge
from orderloom.session import cut_lineage
from orderloom.sources.documents import read_snapshot, write_snapshot
from orderloom.sources.mime import message_key, with_mime

#: Seconds between looks at the folder, and files taken at once.
POLL_SECONDS, BATCH_FILES = 15, 50


def message_stream(spark: SparkSession, folder: str, provider: str = "local", batch_files: int = BATCH_FILES) -> DataFrame:
    """Decoded messages of a folder as they arrive."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.eml").option("maxFilesPerTrigger", batch_files)
    parsed = with_mime(reader.load(folder).select("path", "content").withColumn("provider", F.lit(provider)))
    return parsed.withColumn("provider_message_id", message_key("mime.message_id", "content"))


def table_stream(spark: SparkSession, path: str, schema: str, batch_files: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", batch_files).parquet(path)


def once_per_key(stream: DataFrame, keys: list[str], state_root: str, schema: str, process: Callable[[DataFrame], DataFrame], order: list[str], redo_failed: bool = True):
    """foreachBatch function: each key is processed once over all batches and restarts.

    ``process`` gives a row per key with a column status; keys whose status is FAILED are taken again
    if they are delivered again and ``redo_failed``. The snapshot is replaced whole, so a batch that is
    run again after a crash changes nothing.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = read_snapshot(spark, state_root, schema)
        done = state.where("status <> 'FAILED'") if redo_failed else state
        # finished keys leave before the costly step
        fresh = first_by_key(batch, keys, order).join(done.select(*keys), keys, "left_anti")
        write_snapshot(merge(state, process(fresh), keys), state_root)

    return run


class Snapshots(NamedTuple):
    """Schemas of the tables that a mail stream keeps, each a snapshot below one root."""

    mails: str = "provider string, provider_message_id string, id string, status string, error_message string, subject string"
    files: str = "file_hash string, id string, email_id string, status string, error_message string, duplicate_of string"
    orders: str = "id string, document_id string, dedupe_key string"
    acknowledged: str = "provider string, provider_message_id string"


def processed(root: str, attachments: DataFrame, orders: DataFrame, items: DataFrame):
    """foreachBatch function: mails go through all steps by their keys, in arrival order.

    Mails are registered, their attachments (email_id) registered as files, the orders of files that
    are no duplicates saved or found to be duplicates, and each mail gets what becomes of its files.
    Finished mails leave before the costly steps. Snapshots are replaced whole and the mails' last, so
    a batch that runs again after a crash changes nothing that was done.
    """
    kept = Snapshots()

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        table = {name: read_snapshot(spark, f"{root}/{name}", schema) for name, schema in kept._asdict().items()}
        step = st.register_mails(table["mails"], batch, ["created_at", "id"], ["subject"])
        outcomes = cut_lineage(step.outcomes)
        # of deliveries of one message the last is worked on
        live = outcomes.where("action <> 'finished'")
        arrived = attachments.join(live.select(F.col("id").alias("email_id"), F.col("email_id").alias("_mail")), "email_id").withColumn("email_id", F.col("_mail")).drop("_mail")
        files = st.register_files(table["files"], table["orders"].select("document_id", "id"), arrived.select("file_hash", "id", "email_id", "created_at"), ["created_at", "id"])
        placed = cut_lineage(files.outcomes)
        fresh = orders.join(placed.where("action <> 'duplicate'").select(F.col("id").alias("document_id"), F.col("document_id").alias("_file")), "document_id").withColumn("document_id", F.col("_file")).drop("_file")
        saved = st.save_orders(table["orders"], fresh, items, ["created_at", "id"])
        changes = cut_lineage(saved.documents)
        parts = placed.join(changes.select(F.col("id").alias("document_id"), F.col("status").alias("_status")), "document_id", "left").join(arrived.select("id", F.col("attachment_index").alias("place"), "filename"), "id")
        status = F.when(F.col("action") == "duplicate", "DUPLICATE").otherwise(F.coalesce("_status", F.lit("FAILED")))
        parts = parts.select("email_id", "place", "filename", status.alias("status"), F.when(status == "FAILED", "no order in document").alias("error"))
        rolled = st.mail_outcomes(live.select(F.col("email_id").alias("id")).distinct(), parts)
        after = {
            "files": st.update_status(files.state, changes.withColumnRenamed("error_message", "message")), "orders": table["orders"].unionByName(saved.headers.select("id", "document_id", "dedupe_key")),
            "mails": st.update_status(step.state, rolled),
        }
        after["acknowledged"] = st.acknowledge(table["acknowledged"], after["mails"].join(batch.select("provider", "provider_message_id").distinct(), ["provider", "provider_message_id"]))
        for name in ("files", "orders", "acknowledged", "mails"):
            write_snapshot(cut_lineage(after[name].select(*table[name].columns)), f"{root}/{name}")

    return run


def start(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Run until all is processed (``once``) or poll for ever."""
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{POLL_SECONDS} seconds")).start()


def deduplicated(stream: DataFrame, keys: list[str], event_time: str | None = None, late: str = "7 days") -> DataFrame:
    """Each key once; with an event time the state of keys older than ``late`` is dropped."""
    if event_time is None:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark(keys)


class Progress(StreamingQueryListener):
    """Latest counts of each running query, to be asked for while it runs."""

    def __init__(self) -> None:
        self.latest: dict[str, dict] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.latest[str(event.id)] = {"state": "started", "rows": 0}

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        seen = self.latest.get(str(p.id), {"rows": 0})
        self.latest[str(p.id)] = {"state": "running", "batch": p.batchId, "rows": seen.get("rows", 0) + p.numInputRows}

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.latest.setdefault(str(event.id), {})["state"] = "failed" if event.exception else "ended"
