"""Keyed state in snapshots: insert if absent, take over, duplicates, roll-ups, event log.

Incoming batches are first made unique by key in arrival order; a merge is one outer join and gives
the new snapshot, so it can be run again with the same result.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.functions import vocab
from orderloom.functions.text import dedupe_key, norm_key
from orderloom.session import cut_lineage


def _unkeyed(keys: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))


def numbered_by_key(batch: DataFrame, keys: list[str], order: list[str], name: str = "_n") -> DataFrame:
    """Adds the number of each row among those of its key in arrival order; rows without a key have 1 and stay out of the exchange."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return batch.where(~_unkeyed(keys)).withColumn(name, rank).unionByName(batch.where(_unkeyed(keys)).withColumn(name, F.lit(1)))


def first_by_key(batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in arrival order; rows with a NULL in their key are kept, each on its own."""
    return numbered_by_key(batch, keys, order).where("_n = 1").drop("_n")


def register(state: DataFrame, batch: DataFrame, keys: list[str], order: list[str], finished: Column) -> DataFrame:
    """Rows of the batch, one per key, with action: 'new', 'finished' (known and done) or 'again' (known, to be redone).

    ``finished`` is a condition on the state's columns. Columns of the state come with prefix ``old_``.
    """
    incoming = first_by_key(batch, keys, order)
    known = state.withColumn("_finished", finished).select(*keys, *(F.col(c).alias(f"old_{c}") for c in state.columns if c not in keys), "_finished", F.lit(True).alias("_known"))
    joined = incoming.join(known, keys, "left")
    action = F.when(F.col("_known").isNull(), "new").when(F.coalesce("_finished", F.lit(False)), "finished").otherwise("again")
    return joined.withColumn("action", action).drop("_known", "_finished")


def merge(state: DataFrame, changes: DataFrame, keys: list[str], insert_only: bool = False) -> DataFrame:
    """Snapshot after the changes (unique by key): new keys are added, known ones replaced unless ``insert_only``.

    A column missing in the changes keeps its old value.
    """
    new = changes.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in changes.columns if c not in keys), F.lit(True).alias("_is_new"))
    both = state.withColumn("_is_old", F.lit(True)).join(new, keys, "full")
    take = F.col("_is_new").isNotNull() & (F.col("_is_old").isNull() if insert_only else F.lit(True))
    pick = lambda c: F.when(take, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if f"_new_{c}" in both.columns else F.col(c)
    return both.select(*keys, *(pick(c) for c in state.columns if c not in keys))


def mark_duplicates(batch: DataFrame, key: Column, order: list[str], known: DataFrame | None = None) -> DataFrame:
    """Adds key and duplicate: whether an earlier row of the batch or of ``known`` (column key) has the key.

    Empty and NULL keys are never duplicates, and take no part in the exchange by key.
    """
    keyed = batch.withColumn("key", key).withColumn("_key", F.nullif("key", F.lit("")))
    seen = numbered_by_key(keyed, ["_key"], order)
    if known is not None:
        seen = seen.join(known.select(F.col("key").alias("_key")).distinct().withColumn("_old", F.lit(True)), "_key", "left")
    else:
        seen = seen.withColumn("_old", F.lit(None).cast("boolean"))
    return seen.withColumn("duplicate", F.col("_key").isNotNull() & ((F.col("_n") > 1) | F.col("_old").isNotNull())).drop("_n", "_old", "_key")


class Step(NamedTuple):
    """What a step gives: the new snapshot, one outcome for each incoming row, and events (entity_type, entity_id, status, message, created_at)."""

    state: DataFrame
    outcomes: DataFrame
    events: DataFrame


def _arrivals(state: DataFrame, batch: DataFrame, keys: list[str], order: list[str], done: Column) -> DataFrame:
    """Rows of the batch with _n, entity (id of their key's row), action and the known row's columns with prefix old_.

    Of a known and done key every row is 'finished'; of another the first row is 'new' if the key is,
    and every other row goes through it 'again'.
    """
    old = state.withColumn("_done", done).select(*keys, *(F.col(c).alias(f"old_{c}") for c in state.columns if c not in keys), "_done", F.lit(True).alias("_known"))
    rows = numbered_by_key(batch, keys, order).join(old, keys, "left")
    first = F.first("id").over(Window.partitionBy(*keys).orderBy("_n"))
    rows = rows.where(~_unkeyed(keys)).withColumn("_first", first).unionByName(rows.where(_unkeyed(keys)).withColumn("_first", F.col("id")))
    action = F.when(F.coalesce("_done", F.lit(False)), "finished").when(F.col("_known").isNull() & (F.col("_n") == 1), "new").otherwise("again")
    return rows.withColumn("entity", F.coalesce("old_id", "_first")).withColumn("action", action).drop("_done", "_known", "_first")


def _latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("_last", F.max("_n").over(Window.partitionBy(*keys))).where("_n = _last").drop("_last")


def register_mails(state: DataFrame, batch: DataFrame, order: list[str], values: list[str]) -> Step:
    """Messages by (provider, provider_message_id): new ones are RECEIVED, finished ones stay, others are taken anew with their errors cleared.

    ``state`` has both keys, id, status, error_message and ``values``; ``batch`` keys, id, ``values`` and created_at.
    """
    keys = ["provider", "provider_message_id"]
    rows = _arrivals(state, batch, keys, order, F.col("status").isin(*vocab.DONE))
    taken = _latest(rows.where("action <> 'finished'"), keys)
    changes = taken.select(*keys, F.col("entity").alias("id"), F.lit("RECEIVED").alias("status"), F.lit(None).cast("string").alias("error_message"), *values)
    status = F.when(F.col("action") == "finished", F.col("old_status")).otherwise("RECEIVED")
    said = F.when(F.col("action") == "new", vocab.NEW_MAIL).when(F.col("action") == "finished", vocab.DONE_MAIL).otherwise(vocab.MAIL_AGAIN)
    events = rows.select(F.lit("email").alias("entity_type"), F.col("entity").alias("entity_id"), status.alias("status"), said.alias("message"), "created_at")
    return Step(merge(state, changes, keys), rows.select("id", F.col("entity").alias("email_id"), "action", status.alias("status")), events)


def register_files(state: DataFrame, saved: DataFrame, batch: DataFrame, order: list[str]) -> Step:
    """Attachments by file_hash: duplicates of files with an order are told, others are new or taken over by the later mail.

    ``state`` has file_hash, id, email_id, status, error_message and duplicate_of (an order's id);
    ``saved`` document_id and id of orders; ``batch`` file_hash, id, email_id and created_at.
    """
    own = saved.groupBy(F.col("document_id").alias("id")).agg(F.min("id").alias("_order"))
    linked = state.join(own, "id", "left").withColumn("order_id", F.coalesce("_order", F.when(F.col("status") == "DUPLICATE", F.col("duplicate_of"))))
    rows = _arrivals(linked.select("file_hash", "id", "email_id", "order_id"), batch, ["file_hash"], order, F.col("order_id").isNotNull())
    action = F.when(F.col("action") == "finished", "duplicate").when(F.col("action") == "new", "new").otherwise("taken over")
    rows = rows.withColumn("action", action)
    taken = _latest(rows.where("action <> 'duplicate'"), ["file_hash"])
    none = F.lit(None).cast("string")
    changes = taken.select("file_hash", F.col("entity").alias("id"), "email_id", F.lit("DOCUMENT_DOWNLOADED").alias("status"), none.alias("error_message"), none.alias("duplicate_of"))
    other = (F.col("action") == "duplicate") & (F.col("email_id") != F.col("old_email_id"))
    repeated = F.struct(F.lit("email").alias("entity_type"), F.col("email_id").alias("entity_id"), F.lit("DUPLICATE").alias("status"), F.concat(F.lit(vocab.DONE_FILE), F.lit(" "), F.col("entity")).alias("message"))
    said = F.when(F.col("action") == "new", vocab.NEW_FILE).otherwise(vocab.FILE_AGAIN)
    downloaded = F.struct(F.lit("document").alias("entity_type"), F.col("entity").alias("entity_id"), F.lit("DOCUMENT_DOWNLOADED").alias("status"), said.alias("message"))
    events = rows.select(F.when(other, repeated).when(F.col("action") != "duplicate", downloaded).alias("e"), "created_at").where("e is not null").select("e.*", "created_at")
    return Step(merge(state, changes, ["file_hash"]), rows.select("id", F.col("entity").alias("document_id"), "email_id", "action", F.col("old_order_id").alias("order_id")), events)


def store_parsed(documents: DataFrame, parsed: DataFrame) -> DataFrame:
    """Documents (by id) with parser and page_count of ``parsed``, which are DOCUMENT_PARSED now."""
    return merge(documents, parsed.select("id", "parser", "page_count", F.lit("DOCUMENT_PARSED").alias("status")), ["id"])


def store_extraction(documents: DataFrame, extracted: DataFrame) -> DataFrame:
    """Documents with the document_type of ``extracted``, which are EXTRACTED now."""
    return merge(documents, extracted.select("id", "document_type", F.lit("EXTRACTED").alias("status")), ["id"])


def store_validation(documents: DataFrame, checked: DataFrame, issues: DataFrame) -> DataFrame:
    """Documents of ``checked`` (id): VALIDATED, or FAILED with all errors in error_message as ``field: message; ...``.

    ``issues`` has id, place (their order), field, severity and message. A valid document keeps an older error.
    """
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "field", "message"))), lambda x: F.concat(x["field"], F.lit(": "), x["message"])), "; ")
    errors = issues.where("severity = 'error'").groupBy("id").agg(told.alias("_errors"))
    judged = checked.select("id").distinct().join(errors, "id", "left").join(documents.select("id", F.col("error_message").alias("_before")), "id", "left")
    return merge(documents, judged.select("id", F.when(F.col("_errors").isNull(), "VALIDATED").otherwise("FAILED").alias("status"), F.coalesce("_errors", "_before").alias("error_message")), ["id"])


class Saved(NamedTuple):
    """Outcomes (id, document_id, outcome, order_id), headers and items of the orders that are new, and changes of documents."""

    outcomes: DataFrame
    headers: DataFrame
    items: DataFrame
    documents: DataFrame


def save_orders(known: DataFrame, orders: DataFrame, items: DataFrame, order: list[str]) -> Saved:
    """Orders of documents in arrival order: 'no number', 'saved before' (same document), 'duplicate' (same business key) or 'created'.

    ``known`` has id, document_id and dedupe_key; ``orders`` id, document_id, po_number, supplier_name,
    buyer_name; ``items`` purchase_order_id and sequence, which is given anew from 1.
    """
    keyed = orders.withColumn("dedupe_key", F.when(norm_key("po_number") != "", dedupe_key("po_number", "supplier_name", "buyer_name")))
    by_document = known.groupBy("document_id").agg(F.min("id").alias("_saved"))
    by_key = known.groupBy("dedupe_key").agg(F.min("id").alias("_same"))
    rows = keyed.join(by_document, "document_id", "left").join(by_key, "dedupe_key", "left")
    open_rows = rows.where("dedupe_key is not null and _saved is null")
    # of one document the first row is saved, if anything; of one business key the first of these
    once = numbered_by_key(open_rows, ["document_id"], order, "_d")
    first = numbered_by_key(once.where("_d = 1"), ["dedupe_key"], order).where("_n = 1 and _same is null").select("dedupe_key", F.col("id").alias("_created"), F.col("document_id").alias("_by"))
    placed = rows.join(first, "dedupe_key", "left")
    outcome = (
        F.when(F.col("dedupe_key").isNull(), "no number").when(F.col("_saved").isNotNull(), "saved before").when(F.col("id") == F.col("_created"), "created")
        .when(F.col("document_id") == F.col("_by"), "saved before").otherwise("duplicate")
    )
    of = F.when(F.col("dedupe_key").isNotNull(), F.coalesce("_saved", "_same", "_created"))
    # read for outcomes, headers and items
    placed = cut_lineage(placed.withColumn("outcome", outcome).withColumn("order_id", of))
    headers = placed.where("outcome = 'created'").select(*orders.columns, "dedupe_key")
    sequence = F.row_number().over(Window.partitionBy("purchase_order_id").orderBy("sequence"))
    lines = items.join(headers.select(F.col("id").alias("purchase_order_id")), "purchase_order_id").withColumn("sequence", sequence)
    status = F.when(F.col("outcome") == "created", "SAVED").otherwise("DUPLICATE")
    message = F.when(F.col("outcome") == "duplicate", F.concat(F.lit("PO "), "po_number", F.lit(" already exists")))
    changed = numbered_by_key(placed.where("outcome in ('created', 'duplicate')"), ["document_id"], order).where("_n = 1")
    documents = changed.select(F.col("document_id").alias("id"), status.alias("status"), message.alias("error_message"), F.when(F.col("outcome") == "duplicate", F.col("order_id")).alias("duplicate_of"))
    return Saved(placed.select("id", "document_id", "outcome", "order_id"), headers, lines, documents)


def update_status(state: DataFrame, updates: DataFrame) -> DataFrame:
    """Rows (by id) with the status of ``updates`` (id, status, message), unique by id.

    A message, or FAILED, replaces the error; SAVED and IGNORED without a message clear it; any other
    status leaves it. Ids that are not known change nothing.
    """
    joined = state.join(updates.select("id", F.col("status").alias("_status"), F.col("message").alias("_message"), F.lit(True).alias("_now")), "id", "left")
    replaces = (F.col("_status") == "FAILED") | (F.coalesce("_message", F.lit("")) != "")
    error = F.when(F.col("_now").isNull(), F.col("error_message")).when(replaces, F.col("_message")).when(F.col("_status").isin("SAVED", "IGNORED"), None).otherwise(F.col("error_message"))
    return joined.withColumn("error_message", error).withColumn("status", F.coalesce("_status", "status")).select(*state.columns)


def mail_outcomes(mails: DataFrame, parts: DataFrame) -> DataFrame:
    """id, status, message of mails from their documents (email_id, place, filename, status, error).

    No documents: IGNORED; any FAILED: FAILED with what failed; all DUPLICATE: DUPLICATE; else SAVED.
    """
    failed = F.array_sort(F.collect_list(F.when(F.col("status") == "FAILED", F.struct("place", "filename", "error"))))
    summary = F.array_join(F.transform(failed, lambda x: F.concat(F.coalesce(x["filename"], F.concat(F.lit("attachment-"), x["place"].cast("string"))), F.lit(": "), F.coalesce(x["error"], F.lit("")))), "; ")
    rolled = parts.groupBy(F.col("email_id").alias("id")).agg(F.bool_and(F.col("status") == "DUPLICATE").alias("_same"), summary.alias("_summary"), F.max(F.col("status") == "FAILED").alias("_failed"))
    status = F.when(F.col("_failed").isNull(), "IGNORED").when(F.col("_failed"), "FAILED").when(F.col("_same"), "DUPLICATE").otherwise("SAVED")
    message = F.when(F.col("_failed").isNull(), vocab.NO_PDF).when(F.col("_failed"), F.col("_summary"))
    return mails.select("id").join(rolled, "id", "left").select("id", status.alias("status"), message.alias("message"))


def is_permanent(error_type: Column) -> Column:
    """Whether an error stays however often its step is tried again; NULL is no error."""
    return error_type.isin(*vocab.PERMANENT_ERRORS)


def acknowledge(known: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Set of acknowledged messages after deliveries (provider, provider_message_id, status): those with a final status, each once.

    To acknowledge again, also a finished message that is delivered again, changes nothing.
    """
    keys = ["provider", "provider_message_id"]
    return known.select(*keys).unionByName(deliveries.where(F.col("status").isin(*vocab.FINAL)).select(*keys)).distinct()


def roll_up(parts: DataFrame, key: str, status: str = "status") -> DataFrame:
    """key, outcome, parts: FAILED if any part failed, DUPLICATE if all are, else SAVED."""
    any_failed = F.bool_or(F.col(status) == "FAILED")
    all_same = F.bool_and(F.col(status) == "DUPLICATE")
    return parts.groupBy(key).agg(F.when(any_failed, "FAILED").when(all_same, "DUPLICATE").otherwise("SAVED").alias("outcome"), F.count("*").alias("parts"))


def append_events(log: DataFrame, events: DataFrame, order: list[str]) -> DataFrame:
    """The log with events added under ids that go on from its highest one, in their order.

    Events are sorted over all tasks by range; a row's number is its place in its task behind the
    counts of the tasks before, so neither one task nor one hour has to hold them all.
    """
    last = log.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    tasks = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id()
    # written once: ranges are sampled, and counts must be of the very same ones
    ranged = cut_lineage(events.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("_task", F.shiftright(place, 33)).withColumn("_at", place.bitwiseAND(F.lit((1 << 33) - 1))))
    counts = sorted((r["_task"], r["n"]) for r in ranged.groupBy("_task").agg(F.count("*").alias("n")).collect())
    before, rows = 0, []
    for task, n in counts:
        rows.append((task, last + before + 1))
        before += n
    offsets = F.broadcast(events.sparkSession.createDataFrame(rows, "_task bigint, _from bigint"))
    return log.unionByName(ranged.join(offsets, "_task").withColumn("id", F.col("_from") + F.col("_at")).select(*log.columns))


def transitions(log: DataFrame, entity: list[str], order: str = "id", status: str = "status") -> DataFrame:
    """Each event with the status before it, per entity."""
    return log.withColumn("before", F.lag(status).over(Window.partitionBy(*entity).orderBy(order)))


def step_kinds(log: DataFrame, entity: list[str], order: str = "id") -> DataFrame:
    """Each event with before and kind: 'start', 'forward', 'end', 'restart', 'repeat' or 'illegal'.

    States have an order; work goes forward in it, by any number of states, ends in any final state, and starts
    anew from what is not done. What is done is only told again.
    """
    rank = F.create_map(*(F.lit(x) for k, name in enumerate(vocab.STAGES) for x in (name, k)))
    of = lambda c: F.try_element_at(rank, F.col(c))
    done = F.col("before").isin(*vocab.DONE)
    kind = (
        F.when(F.col("before").isNull(), F.when(of("status").isNotNull() & (of("status") < 3), "start").otherwise("illegal"))
        .when(done, F.when(F.col("status") == F.col("before"), "repeat").otherwise("illegal"))
        .when(F.col("status").isin(*vocab.FINAL), "end").when(of("status") > of("before"), "forward").when(of("status").isin(0, 2), "restart").otherwise("illegal")
    )
    return transitions(log, entity, order).withColumn("kind", kind)
