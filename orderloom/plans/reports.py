"""Reports over mails, documents, orders, items and events, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.session import table


def status_report(spark: SparkSession, d: str) -> DataFrame:
    mails = table(spark, d, "inbound_emails")
    return mails.select(
        "provider_message_id", "sender_name", "sender_email", "subject", "received_at", "processing_status", F.left("error_message", F.lit(80)).alias("error")
    ).orderBy(F.col("received_at").asc_nulls_last())


def documents_with_mail(spark: SparkSession, d: str) -> DataFrame:
    docs, mails = table(spark, d, "attached_documents"), table(spark, d, "inbound_emails")
    joined = docs.join(mails.select(F.col("id").alias("email_id"), "subject"), "email_id")
    return joined.select(
        "filename", "mime_type", "size_bytes", F.concat(F.left("file_hash", F.lit(16)), F.lit("...")).alias("sha256"), "parser", "page_count", "processing_status",
        F.left("error_message", F.lit(80)).alias("error"), F.col("subject").alias("from_email"),
    )


def order_headers(spark: SparkSession, d: str) -> DataFrame:
    names = ("po_number", "supplier_name", "supplier_email", "buyer_name", "order_date", "requested_delivery_date", "currency", "subtotal", "tax", "shipping", "total_amount", "payment_terms", "shipping_terms")
    return table(spark, d, "purchase_orders").select(*names).orderBy(F.col("order_date").asc_nulls_last())


def items_of_order(spark: SparkSession, d: str) -> DataFrame:
    """Items of the order that was stored first."""
    orders, items = table(spark, d, "purchase_orders"), table(spark, d, "purchase_order_items")
    first = orders.orderBy("created_at", "id").limit(1).select(F.col("id").alias("purchase_order_id"))
    return items.join(F.broadcast(first), "purchase_order_id", "left_semi").select("sequence", "line_number", "part_number", "part_name", "quantity", "unit_of_measure", "unit_price", "line_total").orderBy("sequence")


def reconciliation(spark: SparkSession, d: str) -> DataFrame:
    orders, items = table(spark, d, "purchase_orders"), table(spark, d, "purchase_order_items")
    sums = items.groupBy(F.col("purchase_order_id").alias("id")).agg(F.count("id").alias("line_items"), F.sum("line_total").cast("decimal(38,4)").alias("sum_of_lines"))
    return orders.join(sums, "id").select("id", "po_number", "line_items", "sum_of_lines", "subtotal", "total_amount", "currency")


def lineage(spark: SparkSession, d: str) -> DataFrame:
    orders, docs, mails = (table(spark, d, t) for t in ("purchase_orders", "attached_documents", "inbound_emails"))
    joined = orders.join(docs.select(F.col("id").alias("document_id"), "filename"), "document_id")
    joined = joined.join(mails.select(F.col("id").alias("email_id"), "provider_message_id", "sender_email", "subject", "workflow_id"), "email_id")
    return joined.select("provider_message_id", "sender_email", "subject", "filename", "po_number", "total_amount", "workflow_id")


def repeated_orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "purchase_orders").groupBy("po_number", "supplier_name").agg(F.count("*").alias("n")).where("n > 1")


def repeated_files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "attached_documents").groupBy("file_hash").agg(F.count("*").alias("n")).where("n > 1")


def repeated_messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "inbound_emails").groupBy("provider", "provider_message_id").agg(F.count("*").alias("n")).where("n > 1")


def audit_trail(spark: SparkSession, d: str) -> DataFrame:
    """Events of the newest mail and of its documents."""
    mails, docs, events = (table(spark, d, t) for t in ("inbound_emails", "attached_documents", "processing_events"))
    newest = mails.orderBy(F.desc("created_at"), F.desc("id")).limit(1).select("id")
    of_mail = docs.join(F.broadcast(newest.withColumnRenamed("id", "email_id")), "email_id", "left_semi").select("id")
    entities = newest.union(of_mail).distinct().withColumnRenamed("id", "entity_id")
    return events.join(entities, "entity_id", "left_semi").select("id", "entity_type", "status", F.left("message", F.lit(90)).alias("message")).orderBy("id")


def failures(spark: SparkSession, d: str) -> DataFrame:
    mails, docs = table(spark, d, "inbound_emails"), table(spark, d, "attached_documents")
    failed = lambda df, kind, ref, details: df.where("processing_status = 'FAILED'").select(F.lit(kind).alias("entity"), F.col(ref).alias("ref"), "error_message", details.alias("error_details"))
    return failed(mails, "email", "provider_message_id", F.col("error_details")).unionByName(failed(docs, "document", "filename", F.lit(None).cast("string")))


def failure_details(spark: SparkSession, d: str) -> DataFrame:
    """JSON drill-down: what the failed mails' details hold."""
    mails = table(spark, d, "inbound_emails").where("error_details is not null")
    pairs = F.explode(F.from_json("error_details", "map<string,string>")).alias("key", "value")
    return mails.select("id", pairs)


def attachment_facts(spark: SparkSession, d: str) -> DataFrame:
    """One row per attachment named in the mails' JSON."""
    schema = "array<struct<index:int,filename:string,mime_type:string,size_bytes:bigint>>"
    mails = table(spark, d, "inbound_emails").select("id", F.explode(F.from_json("attachments", schema)).alias("a"))
    return mails.select("id", F.col("a.index").alias("attachment_index"), "a.filename", "a.mime_type", "a.size_bytes")


def order_detail(spark: SparkSession, d: str) -> DataFrame:
    """Each order with its lines in order, as one text."""
    orders, items = table(spark, d, "purchase_orders"), table(spark, d, "purchase_order_items")
    text = F.concat_ws(":", F.col("sequence").cast("string"), F.coalesce("part_number", F.lit("-")))
    lines = items.groupBy(F.col("purchase_order_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("sequence", text.alias("t")))).alias("l"))
    joined = orders.select("id", "po_number").join(lines, "id", "left")
    return joined.select("id", "po_number", F.coalesce(F.array_join(F.transform("l", lambda x: x["t"]), ","), F.lit("")).alias("lines"))


def order_summary(spark: SparkSession, d: str) -> DataFrame:
    """All orders with their number of lines, none included."""
    orders, items = table(spark, d, "purchase_orders"), table(spark, d, "purchase_order_items")
    counts = items.groupBy(F.col("purchase_order_id").alias("id")).agg(F.count("*").alias("n"))
    return orders.join(counts, "id", "left").select("id", "po_number", "supplier_name", F.coalesce("n", F.lit(0)).alias("items"))


def mail_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each mail with their order, if any, and its number of lines."""
    docs, orders, items = (table(spark, d, t) for t in ("attached_documents", "purchase_orders", "purchase_order_items"))
    counts = items.groupBy("purchase_order_id").agg(F.count("*").alias("n"))
    ordered = orders.select(F.col("id").alias("purchase_order_id"), "document_id", "po_number").join(counts, "purchase_order_id", "left")
    joined = docs.select("email_id", F.col("id").alias("document_id"), "attachment_index", "processing_status").join(ordered, "document_id", "left")
    return joined.select("email_id", "document_id", "attachment_index", "processing_status", "po_number", F.coalesce("n", F.lit(0)).alias("items"))


def mail_results(spark: SparkSession, d: str) -> DataFrame:
    """Per mail: its first document with an order, and the lines of all of them."""
    outcomes = mail_outcomes(spark, d)
    first = F.min_by("po_number", F.when(F.col("po_number").isNotNull(), F.struct("attachment_index", "document_id")))
    return outcomes.groupBy("email_id").agg(first.alias("po_number"), F.count("*").alias("documents"), F.sum("items").alias("items"))


def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "processing_events").groupBy("entity_type", "status").agg(F.count("*").alias("n"), F.countDistinct("entity_id").alias("entities"))


QUERIES = {
    "v1_status_report": status_report, "v2_documents_with_mail": documents_with_mail, "v3_order_headers": order_headers, "v4_items_of_order": items_of_order,
    "v5_reconciliation": reconciliation, "v6_lineage": lineage, "v7_repeated_orders": repeated_orders, "v7_repeated_files": repeated_files, "v7_repeated_messages": repeated_messages,
    "v8_audit_trail": audit_trail, "v9_failures": failures, "v10_failure_details": failure_details, "v10_attachment_facts": attachment_facts, "v11_order_detail": order_detail,
    "v12_order_summary": order_summary, "v14_mail_outcomes": mail_outcomes, "k8_mail_results": mail_results, "v16_status_counts": status_counts,
}

ORACLES = {
    "v1_status_report": "SELECT provider_message_id, sender_name, sender_email, subject, received_at, processing_status, left(error_message, 80) AS error FROM inbound_emails ORDER BY received_at NULLS LAST",
    "v2_documents_with_mail": """SELECT d.filename, d.mime_type, d.size_bytes, left(d.file_hash, 16) || '...' AS sha256, d.parser, d.page_count, d.processing_status,
        left(d.error_message, 80) AS error, e.subject AS from_email FROM attached_documents d JOIN inbound_emails e ON e.id = d.email_id""",
    "v3_order_headers": """SELECT po_number, supplier_name, supplier_email, buyer_name, order_date, requested_delivery_date, currency, subtotal, tax, shipping, total_amount,
        payment_terms, shipping_terms FROM purchase_orders ORDER BY order_date NULLS LAST""",
    "v4_items_of_order": """SELECT sequence, line_number, part_number, part_name, quantity, unit_of_measure, unit_price, line_total FROM purchase_order_items
        WHERE purchase_order_id = (SELECT id FROM purchase_orders ORDER BY created_at, id LIMIT 1) ORDER BY sequence""",
    "v5_reconciliation": """SELECT p.id, p.po_number, count(i.id) AS line_items, CAST(sum(i.line_total) AS DECIMAL(38,4)) AS sum_of_lines, p.subtotal, p.total_amount, p.currency
        FROM purchase_orders p JOIN purchase_order_items i ON i.purchase_order_id = p.id GROUP BY p.id, p.po_number, p.subtotal, p.total_amount, p.currency""",
    "v6_lineage": """SELECT e.provider_message_id, e.sender_email, e.subject, d.filename, p.po_number, p.total_amount, e.workflow_id
        FROM purchase_orders p JOIN attached_documents d ON d.id = p.document_id JOIN inbound_emails e ON e.id = p.email_id""",
    "v7_repeated_orders": "SELECT po_number, supplier_name, count(*) AS n FROM purchase_orders GROUP BY po_number, supplier_name HAVING count(*) > 1",
    "v7_repeated_files": "SELECT file_hash, count(*) AS n FROM attached_documents GROUP BY file_hash HAVING count(*) > 1",
    "v7_repeated_messages": "SELECT provider, provider_message_id, count(*) AS n FROM inbound_emails GROUP BY provider, provider_message_id HAVING count(*) > 1",
    "v8_audit_trail": """WITH newest AS (SELECT id FROM inbound_emails ORDER BY created_at DESC, id DESC LIMIT 1)
        SELECT id, entity_type, status, left(message, 90) AS message FROM processing_events WHERE entity_id IN
        (SELECT id FROM newest UNION SELECT d.id FROM attached_documents d WHERE d.email_id IN (SELECT id FROM newest)) ORDER BY id""",
    "v9_failures": """SELECT 'email' AS entity, provider_message_id AS ref, error_message, error_details FROM inbound_emails WHERE processing_status = 'FAILED'
        UNION ALL SELECT 'document', filename, error_message, CAST(NULL AS VARCHAR) FROM attached_documents WHERE processing_status = 'FAILED'""",
    "v10_failure_details": """SELECT e.id, k.key, json_extract_string(e.error_details, '$."' || k.key || '"') AS value
        FROM inbound_emails e, LATERAL (SELECT unnest(json_keys(e.error_details)) AS key) k WHERE e.error_details IS NOT NULL""",
    "v10_attachment_facts": """SELECT id, CAST(json_extract(a, '$.index') AS INTEGER) AS attachment_index, json_extract_string(a, '$.filename') AS filename,
        json_extract_string(a, '$.mime_type') AS mime_type, CAST(json_extract(a, '$.size_bytes') AS BIGINT) AS size_bytes
        FROM (SELECT id, unnest(CAST(attachments AS JSON[])) AS a FROM inbound_emails WHERE attachments IS NOT NULL)""",
    "v11_order_detail": """SELECT p.id, p.po_number, coalesce(string_agg(i.sequence || ':' || coalesce(i.part_number, '-'), ',' ORDER BY i.sequence, i.part_number), '') AS lines
        FROM purchase_orders p LEFT JOIN purchase_order_items i ON i.purchase_order_id = p.id GROUP BY p.id, p.po_number""",
    "v12_order_summary": """SELECT p.id, p.po_number, p.supplier_name, count(i.id) AS items
        FROM purchase_orders p LEFT JOIN purchase_order_items i ON i.purchase_order_id = p.id GROUP BY p.id, p.po_number, p.supplier_name""",
    "v14_mail_outcomes": """SELECT d.email_id, d.id AS document_id, d.attachment_index, d.processing_status, p.po_number, coalesce(c.n, 0) AS items
        FROM attached_documents d LEFT JOIN purchase_orders p ON p.document_id = d.id
        LEFT JOIN (SELECT purchase_order_id, count(*) AS n FROM purchase_order_items GROUP BY 1) c ON c.purchase_order_id = p.id""",
    "k8_mail_results": """SELECT d.email_id, min_by(p.po_number, ROW(d.attachment_index, d.id)) FILTER (WHERE p.po_number IS NOT NULL) AS po_number, count(*) AS documents,
        CAST(sum(coalesce(c.n, 0)) AS BIGINT) AS items
        FROM attached_documents d LEFT JOIN purchase_orders p ON p.document_id = d.id
        LEFT JOIN (SELECT purchase_order_id, count(*) AS n FROM purchase_order_items GROUP BY 1) c ON c.purchase_order_id = p.id GROUP BY d.email_id""",
    "v16_status_counts": "SELECT entity_type, status, count(*) AS n, count(DISTINCT entity_id) AS entities FROM processing_events GROUP BY entity_type, status",
}
