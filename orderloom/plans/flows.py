"""State, event and streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.functions.text import dedupe_key
from orderloom.operators import state as st
from orderloom.operators import validate as va
from orderloom.session import shared_folder, table
from orderloom.sources.documents import read_snapshot, write_snapshot
from orderloom.streaming import mail

MESSAGE = ["provider", "provider_message_id"]


def register_messages(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of each message of the later half of time, given the earlier half as state."""
    mails = table(spark, d, "inbound_emails").select("id", *MESSAGE, "processing_status", "created_at")
    middle = F.lit("2025-07-01").cast("timestamp")
    state = st.first_by_key(mails.where(F.col("created_at") < middle), MESSAGE, ["created_at", "id"])
    done = F.col("processing_status").isin("SAVED", "DUPLICATE", "IGNORED")
    found = st.register(state.drop("created_at"), mails.where(F.col("created_at") >= middle), MESSAGE, ["created_at", "id"], done)
    return found.select("id", "action", F.col("old_id"))


def register_files(spark: SparkSession, d: str) -> DataFrame:
    """Attachments by file: the first with a hash is new, later ones are duplicates."""
    docs = table(spark, d, "attached_documents")
    marked = st.mark_duplicates(docs.select("id", "file_hash", "created_at"), F.col("file_hash"), ["created_at", "id"])
    return marked.select("id", "duplicate")


def save_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders by business key: which are the same order saved again."""
    orders = table(spark, d, "purchase_orders").select("id", "po_number", "supplier_name", "buyer_name", "created_at")
    key = F.when(F.col("po_number").isNotNull(), dedupe_key("po_number", "supplier_name", "buyer_name"))
    return st.mark_duplicates(orders, key, ["created_at", "id"]).select("id", "key", "duplicate")


def merged_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Two batches merged into a snapshot that is written and read again."""
    mails = table(spark, d, "inbound_emails").select(*MESSAGE, "processing_status", "created_at", "id")
    first = st.first_by_key(mails.where(F.col("created_at") < F.lit("2025-07-01").cast("timestamp")), MESSAGE, ["created_at", "id"])
    last = st.first_by_key(mails, MESSAGE, [F.desc("created_at"), F.desc("id")])
    root = shared_folder(spark, "snapshot")
    write_snapshot(st.merge(first, last, MESSAGE), root)
    return read_snapshot(spark, root, mails.schema).select(*MESSAGE, "processing_status", "id")


def mail_roll_up(spark: SparkSession, d: str) -> DataFrame:
    return st.roll_up(table(spark, d, "attached_documents"), "email_id", "processing_status")


def event_log(spark: SparkSession, d: str) -> DataFrame:
    """Events of documents appended to the log of the mails' events."""
    events = table(spark, d, "processing_events").select("id", "entity_type", "entity_id", "status", "created_at")
    log, more = events.where("entity_type = 'email'"), events.where("entity_type = 'document'")
    return st.append_events(log, more, ["created_at", "entity_id", "status"]).select("id", "entity_type", "entity_id", "status")


def event_steps(spark: SparkSession, d: str) -> DataFrame:
    steps = st.transitions(table(spark, d, "processing_events"), ["entity_type", "entity_id"])
    return steps.groupBy("entity_type", F.coalesce("before", F.lit("-")).alias("before"), "status").agg(F.count("*").alias("n"))


def polled_once(spark: SparkSession, d: str) -> DataFrame:
    """The mail table as a stream, each message taken once, all that is there now."""
    source = f"{d}/inbound_emails.parquet"
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).parquet(f"{source}*").select(*MESSAGE, "id", "created_at", "processing_status")
    state = "provider string, provider_message_id string, id string, created_at timestamp, status string"
    process = lambda df: df.withColumn("status", F.lit("SAVED")).select(*MESSAGE, "id", "created_at", "status")
    root = shared_folder(spark, "polled")
    each = mail.once_per_key(stream, MESSAGE, f"{root}/state", state, process, ["created_at", "id"])
    mail.start(stream, each, f"{root}/checkpoint", once=True).awaitTermination()
    return read_snapshot(spark, f"{root}/state", state).select(*MESSAGE, "status")


def streamed_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events counted by status as a stream into a table that is complete after the last batch."""
    source = f"{d}/processing_events.parquet"
    schema = spark.read.parquet(source).schema
    stream = mail.deduplicated(spark.readStream.schema(schema).parquet(f"{source}*"), ["id"])
    counted = stream.groupBy("entity_type", "status").agg(F.count("*").alias("n"))
    root = shared_folder(spark, "counts")
    each = lambda df, _: write_snapshot(df, f"{root}/table")
    query = counted.writeStream.outputMode("complete").foreachBatch(each).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return read_snapshot(spark, f"{root}/table", "entity_type string, status string, n bigint")


def _halves(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    middle = F.lit("2025-07-01").cast("timestamp")
    return df.where(F.col("created_at") < middle), df.where(F.col("created_at") >= middle)


def _mail_step(spark: SparkSession, d: str) -> st.Step:
    """The later half of the mails registered upon the earlier half as state."""
    mails = table(spark, d, "inbound_emails").select("id", *MESSAGE, "processing_status", "error_message", "subject", "created_at")
    old, new = _halves(mails)
    state = st.first_by_key(old, MESSAGE, ["created_at", "id"]).withColumnRenamed("processing_status", "status").drop("created_at")
    return st.register_mails(state, new, ["created_at", "id"], ["subject"])


def mail_deliveries(spark: SparkSession, d: str) -> DataFrame:
    return _mail_step(spark, d).outcomes


def mail_states(spark: SparkSession, d: str) -> DataFrame:
    return _mail_step(spark, d).state.groupBy("status", F.col("error_message").isNull().alias("clear")).agg(F.count("*").alias("n"), F.count("subject").alias("subjects"))


def mail_events(spark: SparkSession, d: str) -> DataFrame:
    return _mail_step(spark, d).events.select("entity_id", "status", "message")


def file_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Attachments of the later half upon the earlier half; the first three letters of the hash stand for the file, so that files repeat."""
    files = table(spark, d, "attached_documents").withColumn("file_hash", F.left("file_hash", F.lit(3)))
    old, new = _halves(files.select("file_hash", "id", "email_id", F.col("processing_status").alias("status"), "error_message", F.lit(None).cast("string").alias("duplicate_of"), "created_at"))
    state = st.first_by_key(old, ["file_hash"], ["created_at", "id"]).drop("created_at")
    step = st.register_files(state, table(spark, d, "purchase_orders").select("document_id", "id"), new, ["created_at", "id"])
    return step.outcomes.select("id", "document_id", "action", F.col("order_id").isNotNull().alias("has_order"))


def stored_results(spark: SparkSession, d: str) -> DataFrame:
    """Documents parsed, extracted and validated by their orders and items, errors told in one text."""
    files = table(spark, d, "attached_documents").select("id", "document_type", "parser", "page_count", F.col("processing_status").alias("status"), "error_message")
    orders, items = table(spark, d, "purchase_orders"), table(spark, d, "purchase_order_items")
    heads = orders.withColumn("order_date", F.lit(None).cast("date")).withColumn("requested_delivery_date", F.lit(None).cast("date"))
    lines = items.select("purchase_order_id", "sequence", "line_number", "part_number", "part_name", F.lit(1).cast("decimal(18,4)").alias("quantity"), F.lit(None).cast("decimal(18,4)").alias("unit_price"), "line_total")
    issues = va.header_issues(heads).unionByName(va.item_issues(lines).withColumnRenamed("purchase_order_id", "id")).unionByName(va.total_issues(orders, items))
    told = va.with_messages(issues.where("severity = 'error'")).join(orders.select("id", "document_id"), "id").drop("id").withColumnRenamed("document_id", "id")
    parsed = files.where("page_count is not null").select("id", F.lit("text").alias("parser"), "page_count")
    extracted = parsed.select("id", F.lit("PURCHASE_ORDER").alias("document_type"))
    after = st.store_validation(st.store_extraction(st.store_parsed(files, parsed), extracted), orders.select(F.col("document_id").alias("id")), told)
    return after.select("id", "parser", "document_type", "status", "error_message")


def saved_orders(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "purchase_orders").select("id", "document_id", "po_number", "supplier_name", "buyer_name", "created_at")
    key = dedupe_key("po_number", "supplier_name", "buyer_name")
    old, new = _halves(orders.withColumn("document_id", F.left("document_id", F.lit(3))))
    known = old.where("po_number is not null").select("id", "document_id", key.alias("dedupe_key"))
    found = st.save_orders(known, new, table(spark, d, "purchase_order_items"), ["created_at", "id"])
    lines = found.items.groupBy(F.col("purchase_order_id").alias("id")).agg(F.count("*").alias("lines"), F.max("sequence").alias("last"))
    return found.outcomes.join(lines, "id", "left").select("id", "outcome", "order_id", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("last", F.lit(0)).alias("last"))


def updated_states(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "attached_documents").select("id", F.col("processing_status").alias("status"), "error_message", F.ascii(F.left("id", F.lit(1))).alias("c"))
    files = files.withColumn("error_message", F.when(F.col("c") % 2 == 0, "older error").otherwise(F.col("error_message")))
    status = F.element_at(F.array(*(F.lit(x) for x in ("SAVED", "FAILED", "DUPLICATE", "IGNORED", "EXTRACTED"))), F.col("c") % 5 + 1)
    updates = files.where("c % 7 <> 0").select("id", status.alias("status"), F.when(F.col("c") % 3 == 0, "said").alias("message"))
    return st.update_status(files, updates).select("id", "status", "error_message")


def mail_results(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "attached_documents").select("email_id", F.col("attachment_index").alias("place"), "filename", F.col("processing_status").alias("status"), F.col("error_message").alias("error"))
    return st.mail_outcomes(table(spark, d, "inbound_emails"), parts)


def error_classes(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("processing_status") == "FAILED", "DocumentParseError").when(F.col("page_count").isNull(), "TimeoutError")
    return table(spark, d, "attached_documents").select("id", kind.alias("error_type"), st.is_permanent(kind).alias("permanent"))


def event_kinds(spark: SparkSession, d: str) -> DataFrame:
    kinds = st.step_kinds(table(spark, d, "processing_events"), ["entity_type", "entity_id"])
    return kinds.groupBy("entity_type", "kind", "status").agg(F.count("*").alias("n"))


def acknowledged(spark: SparkSession, d: str) -> DataFrame:
    """Messages of the mails acknowledged, then all again: a set."""
    mails = table(spark, d, "inbound_emails").select(*MESSAGE, F.col("processing_status").alias("status"))
    once = st.acknowledge(mails.limit(0), mails)
    return st.acknowledge(once, mails)


def streamed_states(spark: SparkSession, d: str) -> DataFrame:
    """Mails as a stream through all steps by key; what the snapshots say in the end."""
    source = f"{d}/inbound_emails.parquet"
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(f"{source}*").select(*MESSAGE, "id", "subject", "created_at")
    root = shared_folder(spark, "processed")
    each = mail.processed(root, *(table(spark, d, t) for t in ("attached_documents", "purchase_orders", "purchase_order_items")))
    mail.start(stream, each, f"{root}/checkpoint", once=True).awaitTermination()
    kept = mail.Snapshots()
    count = lambda name, schema: read_snapshot(spark, f"{root}/{name}", schema).groupBy(F.lit(name).alias("kind"), "status").agg(F.count("*").alias("n"))
    orders = read_snapshot(spark, f"{root}/orders", kept.orders).agg(F.lit("orders").alias("kind"), F.lit(None).cast("string").alias("status"), F.count("*").alias("n"))
    told = read_snapshot(spark, f"{root}/acknowledged", kept.acknowledged).agg(F.lit("acknowledged").alias("kind"), F.lit(None).cast("string").alias("status"), F.count("*").alias("n"))
    return count("mails", kept.mails).unionByName(count("files", kept.files)).unionByName(orders).unionByName(told)


QUERIES = {
    "k1_register_messages": register_messages, "k2_register_files": register_files, "k4_save_orders": save_orders, "k1_merged_snapshot": merged_snapshot, "k7_mail_roll_up": mail_roll_up,
    "k6_event_log": event_log, "k10_event_steps": event_steps, "r1_r2_polled_once": polled_once, "r6_streamed_counts": streamed_counts,
    "k1_mail_deliveries": mail_deliveries, "k1_mail_states": mail_states, "k6_mail_events": mail_events, "k2_file_outcomes": file_outcomes, "k3_d1_d6_stored_results": stored_results, "k4_saved_orders": saved_orders,
    "k5_updated_states": updated_states, "k7_mail_outcomes": mail_results, "k9_error_classes": error_classes, "k10_event_kinds": event_kinds, "s4_r3_acknowledged": acknowledged, "r4_streamed_states": streamed_states,
}

NORM = "regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]', '', 'g')"
MAILS = """WITH old AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY provider, provider_message_id ORDER BY created_at, id) AS n FROM inbound_emails
    WHERE created_at < TIMESTAMPTZ '2025-07-01 00:00:00+00') WHERE n = 1),
    new AS (SELECT *, row_number() OVER w AS n, first(id) OVER w AS first_id FROM inbound_emails WHERE created_at >= TIMESTAMPTZ '2025-07-01 00:00:00+00' WINDOW w AS (PARTITION BY provider, provider_message_id ORDER BY created_at, id)),
    deliveries AS (SELECT new.*, old.processing_status AS old_status, coalesce(old.id, first_id) AS email_id, CASE WHEN old.processing_status IN ('SAVED', 'DUPLICATE', 'IGNORED') THEN 'finished'
        WHEN old.id IS NULL AND new.n = 1 THEN 'new' ELSE 'again' END AS action FROM new LEFT JOIN old USING (provider, provider_message_id))"""
ORACLES = {
    "k1_register_messages": """WITH old AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY provider, provider_message_id ORDER BY created_at, id) AS n FROM inbound_emails
        WHERE created_at < TIMESTAMPTZ '2025-07-01 00:00:00+00') WHERE n = 1), new AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY provider, provider_message_id ORDER BY created_at, id) AS n
        FROM inbound_emails WHERE created_at >= TIMESTAMPTZ '2025-07-01 00:00:00+00') WHERE n = 1)
        SELECT new.id, CASE WHEN old.id IS NULL THEN 'new' WHEN old.processing_status IN ('SAVED', 'DUPLICATE', 'IGNORED') THEN 'finished' ELSE 'again' END AS action, old.id AS old_id
        FROM new LEFT JOIN old USING (provider, provider_message_id)""",
    "k2_register_files": "SELECT id, row_number() OVER (PARTITION BY file_hash ORDER BY created_at, id) > 1 AND coalesce(file_hash, '') <> '' AS duplicate FROM attached_documents",
    "k4_save_orders": f"""WITH k AS (SELECT id, created_at, CASE WHEN po_number IS NOT NULL THEN {NORM.format('po_number')} || '|' || {NORM.format('supplier_name')} || '|' || {NORM.format('buyer_name')} END AS key
        FROM purchase_orders) SELECT id, key, coalesce(key, '') <> '' AND row_number() OVER (PARTITION BY key ORDER BY created_at, id) > 1 AS duplicate FROM k""",
    "k1_merged_snapshot": """SELECT provider, provider_message_id, processing_status, id FROM (SELECT *, row_number() OVER (PARTITION BY provider, provider_message_id
        ORDER BY created_at DESC, id DESC) AS n FROM inbound_emails) WHERE n = 1""",
    "k7_mail_roll_up": """SELECT email_id, CASE WHEN bool_or(processing_status = 'FAILED') THEN 'FAILED' WHEN bool_and(processing_status = 'DUPLICATE') THEN 'DUPLICATE' ELSE 'SAVED' END AS outcome,
        count(*) AS parts FROM attached_documents GROUP BY email_id""",
    "k6_event_log": """WITH e AS (SELECT * FROM processing_events WHERE entity_type = 'email') SELECT id, entity_type, entity_id, status FROM e
        UNION ALL SELECT (SELECT max(id) FROM e) + row_number() OVER (ORDER BY created_at, entity_id, status), entity_type, entity_id, status FROM processing_events WHERE entity_type = 'document'""",
    "k10_event_steps": """SELECT entity_type, coalesce(before, '-') AS before, status, count(*) AS n FROM (SELECT *, lag(status) OVER (PARTITION BY entity_type, entity_id ORDER BY id) AS before
        FROM processing_events) GROUP BY ALL""",
    "r1_r2_polled_once": "SELECT DISTINCT provider, provider_message_id, 'SAVED' AS status FROM inbound_emails",
    "r6_streamed_counts": "SELECT entity_type, status, count(*) AS n FROM processing_events GROUP BY entity_type, status",
    "k1_mail_deliveries": f"""{MAILS} SELECT id, email_id, action, CASE WHEN action = 'finished' THEN old_status ELSE 'RECEIVED' END AS status FROM deliveries""",
    "k6_mail_events": f"""{MAILS} SELECT email_id AS entity_id, CASE WHEN action = 'finished' THEN old_status ELSE 'RECEIVED' END AS status, CASE action WHEN 'new' THEN 'email received'
        WHEN 'finished' THEN 'delivered again after it was finished' ELSE 'taken again as it was not finished' END AS message FROM deliveries""",
    "k1_mail_states": f"""{MAILS}, taken AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY provider, provider_message_id ORDER BY created_at DESC, id DESC) AS l FROM deliveries WHERE action <> 'finished') WHERE l = 1),
        after AS (SELECT 'RECEIVED' AS status, true AS clear, subject FROM taken UNION ALL SELECT processing_status, error_message IS NULL, subject FROM old ANTI JOIN taken USING (provider, provider_message_id))
        SELECT status, clear, count(*) AS n, count(subject) AS subjects FROM after GROUP BY ALL""",
    "k2_file_outcomes": """WITH f AS (SELECT *, left(file_hash, 3) AS h FROM attached_documents), old AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY created_at, id) AS n FROM f
        WHERE created_at < TIMESTAMPTZ '2025-07-01 00:00:00+00') WHERE n = 1), linked AS (SELECT old.h, old.id, min(p.id) AS order_id FROM old LEFT JOIN purchase_orders p ON p.document_id = old.id GROUP BY ALL),
        new AS (SELECT *, row_number() OVER w AS n, first(id) OVER w AS first_id FROM f WHERE created_at >= TIMESTAMPTZ '2025-07-01 00:00:00+00' WINDOW w AS (PARTITION BY h ORDER BY created_at, id))
        SELECT new.id, coalesce(l.id, first_id) AS document_id, CASE WHEN order_id IS NOT NULL THEN 'duplicate' WHEN l.id IS NULL AND n = 1 THEN 'new' ELSE 'taken over' END AS action, order_id IS NOT NULL AS has_order
        FROM new LEFT JOIN linked l USING (h)""",
    "k3_d1_d6_stored_results": """WITH i AS (SELECT *, row_number() OVER (PARTITION BY purchase_order_id ORDER BY sequence) AS pos FROM purchase_order_items), e AS (
        SELECT document_id AS id, -1 AS place, 'po_number: PO number is required' AS m FROM purchase_orders WHERE coalesce(po_number, '') = ''
        UNION ALL SELECT document_id, 0, 'line_items: at least one line item is required' FROM purchase_orders p WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.purchase_order_id = p.id)
        UNION ALL SELECT document_id, pos, 'line_items[' || pos || ']: line item has neither part number nor description' FROM i JOIN purchase_orders p ON p.id = purchase_order_id
            WHERE coalesce(part_number, '') = '' AND coalesce(part_name, '') = ''), told AS (SELECT id, string_agg(m, '; ' ORDER BY place, m) AS m FROM e GROUP BY id)
        SELECT a.id, CASE WHEN page_count IS NULL THEN parser ELSE 'text' END AS parser, CASE WHEN page_count IS NULL THEN document_type ELSE 'PURCHASE_ORDER' END AS document_type,
        CASE WHEN told.id IS NOT NULL THEN 'FAILED' WHEN a.id IN (SELECT document_id FROM purchase_orders) THEN 'VALIDATED' WHEN page_count IS NULL THEN processing_status ELSE 'EXTRACTED' END AS status,
        coalesce(told.m, error_message) AS error_message FROM attached_documents a LEFT JOIN told USING (id)""",
    "k4_saved_orders": f"""WITH k AS (SELECT id, left(document_id, 3) AS doc, created_at, CASE WHEN regexp_replace(lower(coalesce(po_number, '')), '[^a-z0-9]', '', 'g') <> '' THEN
        {NORM.format('po_number')} || '|' || {NORM.format('supplier_name')} || '|' || {NORM.format('buyer_name')} END AS key FROM purchase_orders),
        old AS (SELECT * FROM k JOIN purchase_orders USING (id) WHERE po_number IS NOT NULL AND k.created_at < TIMESTAMPTZ '2025-07-01 00:00:00+00'),
        docs AS (SELECT doc, min(id) AS saved FROM old GROUP BY 1), keys AS (SELECT key, min(id) AS same FROM old GROUP BY 1),
        new AS (SELECT k.*, saved, same FROM k LEFT JOIN docs USING (doc) LEFT JOIN keys USING (key) WHERE created_at >= TIMESTAMPTZ '2025-07-01 00:00:00+00'),
        once AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY created_at, id) AS d FROM new WHERE key IS NOT NULL AND saved IS NULL),
        firsts AS (SELECT key, id AS made, doc AS maker FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY created_at, id) AS n FROM once WHERE d = 1) WHERE n = 1 AND same IS NULL),
        r AS (SELECT new.id, CASE WHEN new.key IS NULL THEN 'no number' WHEN saved IS NOT NULL THEN 'saved before' WHEN new.id = made THEN 'created' WHEN doc = maker THEN 'saved before' ELSE 'duplicate' END AS outcome,
        CASE WHEN new.key IS NOT NULL THEN coalesce(saved, same, made) END AS order_id FROM new LEFT JOIN firsts ON firsts.key = new.key),
        n AS (SELECT purchase_order_id AS id, count(*) AS c FROM purchase_order_items GROUP BY 1)
        SELECT r.*, CASE WHEN outcome = 'created' THEN coalesce(c, 0) ELSE 0 END AS lines, CASE WHEN outcome = 'created' THEN coalesce(c, 0) ELSE 0 END AS last FROM r LEFT JOIN n USING (id)""",
    "k5_updated_states": """WITH f AS (SELECT id, processing_status AS status, ascii(left(id, 1)) AS c, CASE WHEN ascii(left(id, 1)) % 2 = 0 THEN 'older error' ELSE error_message END AS e FROM attached_documents),
        u AS (SELECT *, CASE WHEN c % 7 <> 0 THEN ['SAVED', 'FAILED', 'DUPLICATE', 'IGNORED', 'EXTRACTED'][CAST(c % 5 + 1 AS INTEGER)] END AS s, CASE WHEN c % 3 = 0 THEN 'said' END AS m FROM f)
        SELECT id, coalesce(s, status) AS status, CASE WHEN s IS NULL THEN e WHEN s = 'FAILED' OR m IS NOT NULL THEN m WHEN s IN ('SAVED', 'IGNORED') THEN NULL ELSE e END AS error_message FROM u""",
    "k7_mail_outcomes": """WITH r AS (SELECT email_id AS id, bool_and(processing_status = 'DUPLICATE') AS same, bool_or(processing_status = 'FAILED') AS failed,
        string_agg(coalesce(filename, 'attachment-' || attachment_index) || ': ' || coalesce(error_message, ''), '; ' ORDER BY attachment_index, filename) FILTER (WHERE processing_status = 'FAILED') AS told
        FROM attached_documents GROUP BY 1) SELECT e.id, CASE WHEN failed IS NULL THEN 'IGNORED' WHEN failed THEN 'FAILED' WHEN same THEN 'DUPLICATE' ELSE 'SAVED' END AS status,
        CASE WHEN failed IS NULL THEN 'no PDF attachment found' WHEN failed THEN told END AS message FROM inbound_emails e LEFT JOIN r USING (id)""",
    "k9_error_classes": """SELECT id, CASE WHEN processing_status = 'FAILED' THEN 'DocumentParseError' WHEN page_count IS NULL THEN 'TimeoutError' END AS error_type,
        CASE WHEN processing_status = 'FAILED' THEN true WHEN page_count IS NULL THEN false END AS permanent FROM attached_documents""",
    "k10_event_kinds": """WITH o(status, r) AS (VALUES ('RECEIVED', 0), ('EMAIL_PARSED', 1), ('DOCUMENT_DOWNLOADED', 2), ('DOCUMENT_PARSED', 3), ('EXTRACTED', 4), ('VALIDATED', 5), ('SAVED', 6)),
        e AS (SELECT *, lag(status) OVER (PARTITION BY entity_type, entity_id ORDER BY id) AS before FROM processing_events), k AS (SELECT entity_type, e.status, CASE
        WHEN before IS NULL THEN CASE WHEN s.r < 3 THEN 'start' ELSE 'illegal' END WHEN before IN ('SAVED', 'DUPLICATE', 'IGNORED') THEN CASE WHEN before = e.status THEN 'repeat' ELSE 'illegal' END
        WHEN e.status IN ('SAVED', 'DUPLICATE', 'IGNORED', 'FAILED') THEN 'end' WHEN s.r > b.r THEN 'forward' WHEN s.r IN (0, 2) THEN 'restart' ELSE 'illegal' END AS kind
        FROM e LEFT JOIN o s ON s.status = e.status LEFT JOIN o b ON b.status = before) SELECT entity_type, kind, status, count(*) AS n FROM k GROUP BY ALL""",
    "s4_r3_acknowledged": "SELECT DISTINCT provider, provider_message_id FROM inbound_emails WHERE processing_status IN ('SAVED', 'DUPLICATE', 'IGNORED', 'FAILED')",
    "r4_streamed_states": f"""WITH m AS (SELECT id, first(id) OVER (PARTITION BY provider, provider_message_id ORDER BY created_at, id) AS mail FROM inbound_emails),
        f AS (SELECT a.id, m.mail FROM attached_documents a JOIN m ON m.id = a.email_id),
        k AS (SELECT p.id, document_id AS doc, created_at, CASE WHEN regexp_replace(lower(coalesce(po_number, '')), '[^a-z0-9]', '', 'g') <> '' THEN
            {NORM.format('po_number')} || '|' || {NORM.format('supplier_name')} || '|' || {NORM.format('buyer_name')} END AS key FROM purchase_orders p JOIN f ON f.id = document_id),
        once AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY created_at, id) AS d FROM k WHERE key IS NOT NULL),
        firsts AS (SELECT key, id AS made, doc AS maker FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY created_at, id) AS n FROM once WHERE d = 1) WHERE n = 1),
        r AS (SELECT k.*, CASE WHEN k.key IS NULL THEN 'no number' WHEN id = made THEN 'created' WHEN doc = maker THEN 'saved before' ELSE 'duplicate' END AS outcome FROM k LEFT JOIN firsts ON firsts.key = k.key),
        changed AS (SELECT doc, outcome FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY created_at, id) AS n FROM r WHERE outcome IN ('created', 'duplicate')) WHERE n = 1),
        fs AS (SELECT f.*, CASE outcome WHEN 'created' THEN 'SAVED' WHEN 'duplicate' THEN 'DUPLICATE' END AS s FROM f LEFT JOIN changed ON doc = f.id),
        ms AS (SELECT mail, CASE WHEN bool_or(s IS NULL) THEN 'FAILED' WHEN bool_and(s = 'DUPLICATE') THEN 'DUPLICATE' ELSE 'SAVED' END AS status FROM fs GROUP BY 1)
        SELECT 'mails' AS kind, coalesce(status, 'IGNORED') AS status, count(*) AS n FROM (SELECT DISTINCT mail FROM m) LEFT JOIN ms USING (mail) GROUP BY 2
        UNION ALL SELECT 'files', coalesce(s, 'DOCUMENT_DOWNLOADED'), count(*) FROM fs GROUP BY 2 UNION ALL SELECT 'orders', NULL, count(*) FROM r WHERE outcome = 'created'
        UNION ALL SELECT 'acknowledged', NULL, count(*) FROM (SELECT DISTINCT provider, provider_message_id FROM inbound_emails)""",
}
