"""Extraction, MIME, evaluation and validation queries: documents are rendered from the order tables and read back.

The SQL reads the base tables only and never calls the extraction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderloom.functions.text import clean_inline
from orderloom.operators import evaluate as ev
from orderloom.operators import validate as va
from orderloom.operators.documents import render_letters, render_orders
from orderloom.operators.headers import HEADER_FIELDS, candidates_of, extract, header_fields
from orderloom.operators.items import item_tables, line_items
from orderloom.plans.expressions import CLEAN
from orderloom.session import spread, table
from orderloom.sources import mime
from orderloom.sources.documents import parse_documents

ITEM_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")


def rendered(spark: SparkSession, d: str) -> DataFrame:
    return render_orders(*(table(spark, d, t) for t in ("orders", "lineitem", "customer")))


def headers(spark: SparkSession, d: str) -> DataFrame:
    found = header_fields(rendered(spark, d))
    return found.select("document_id", "purchase_order_number", "order_date", "buyer_name", "currency", F.col("total_amount").cast("decimal(18,2)").alias("total_amount"))


def header_notes(spark: SparkSession, d: str) -> DataFrame:
    found = header_fields(rendered(spark, d))
    return found.select("document_id", F.array_join("warnings", "; ").alias("warnings"), F.array_join(F.array_sort(F.map_keys("evidence")), ",").alias("evidence"))


def candidates(spark: SparkSession, d: str) -> DataFrame:
    found = candidates_of(rendered(spark, d)).select(F.explode_outer("candidates").alias("x")).select("x.*")
    return found.where("value is not null").groupBy("field", "priority").agg(F.count("*").alias("n"))


def items(spark: SparkSession, d: str) -> DataFrame:
    found = line_items(rendered(spark, d))
    return found.select(
        "document_id", "seq", "line_number", "part_number", "part_name", F.col("quantity").cast("int").alias("quantity"), "unit_of_measure", F.col("line_total").cast("decimal(18,2)").alias("line_total")
    )


def continued_tables(spark: SparkSession, d: str) -> DataFrame:
    found = item_tables(rendered(spark, d)).withColumn("heads", F.filter(F.transform("parts", lambda p: p["header_r"]), lambda r: r.isNotNull()))
    return found.select("document_id", F.size("heads").cast("bigint").alias("tables"), F.size(F.filter("heads", lambda r: r < 0)).cast("bigint").alias("continued"))


def letters(spark: SparkSession, d: str) -> DataFrame:
    return render_letters(*(table(spark, d, t) for t in ("orders", "lineitem")))


def letter_headers(spark: SparkSession, d: str) -> DataFrame:
    """All header fields of the fuller layouts."""
    found = header_fields(letters(spark, d))
    amount = lambda f: F.col(f).cast("decimal(18,2)").alias(f) if f in ("subtotal", "tax", "shipping", "total_amount") else F.col(f)
    return found.select("document_id", *(amount(f) for f in HEADER_FIELDS))


def letter_notes(spark: SparkSession, d: str) -> DataFrame:
    """Warnings and some evidence of whole extractions of the fuller layouts."""
    found = extract(letters(spark, d))
    said = lambda f: F.col("evidence")[f].alias(f)
    return found.select("document_id", F.array_join("warnings", "; ").alias("warnings"), F.array_join(F.array_sort(F.map_keys("evidence")), ",").alias("evidence"), said("buyer_name"), said("supplier_address"), said("currency"), F.size("line_items").cast("bigint").alias("items"))


def letter_items(spark: SparkSession, d: str) -> DataFrame:
    found = line_items(letters(spark, d))
    return found.select(
        "document_id", "seq", "line_number", "part_number", "part_name", F.col("quantity").cast("int").alias("quantity"), "unit_of_measure", F.col("line_total").cast("decimal(18,2)").alias("line_total"), "numbers_given"
    )


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as items: sequence by all columns, quantities one lower so that some are not positive, every ninth part nameless."""
    lines = table(spark, d, "lineitem")
    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*ITEM_ORDER))
    part = F.when(F.col("l_partkey") % 9 > 0, F.col("l_partkey").cast("string"))
    quantity = F.when(F.col("l_suppkey") % 7 > 0, F.col("l_quantity") - 1)
    return lines.select(
        F.col("l_orderkey").alias("purchase_order_id"), seq.alias("sequence"), F.col("l_linenumber").alias("line_number"), part.alias("part_number"), F.lit(None).cast("string").alias("part_name"),
        quantity.cast("decimal(18,4)").alias("quantity"), F.lit("1.0000").cast("decimal(18,4)").alias("unit_price"),
        F.when(F.col("l_partkey") % 5 > 0, (F.col("l_quantity") - 1).cast("decimal(18,4)")).otherwise(F.col("l_extendedprice").cast("decimal(18,4)")).alias("line_total"),
    )


def _heads(spark: SparkSession, d: str) -> DataFrame:
    """Orders as headers: number, supplier, currency and parts of the total missing by key."""
    key, total = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,4)")
    return table(spark, d, "orders").select(
        key.alias("id"), F.when(key % 11 > 0, key.cast("string")).alias("po_number"), F.when(key % 3 > 0, F.lit("S")).alias("supplier_name"), F.when(key % 4 > 0, F.lit("EUR")).alias("currency"),
        F.col("o_orderdate").cast("date").alias("order_date"), F.date_add(F.col("o_orderdate").cast("date"), (key % 5 - 1).cast("int")).alias("requested_delivery_date"),
        F.when(key % 2 == 0, total).alias("subtotal"), F.when(key % 6 == 0, F.lit("1.0000").cast("decimal(18,4)")).alias("tax"), F.lit(None).cast("decimal(18,4)").alias("shipping"), total.alias("total_amount"),
    )


def header_issues(spark: SparkSession, d: str) -> DataFrame:
    return va.header_issues(va.normalise_orders(_heads(spark, d)))


def item_issues(spark: SparkSession, d: str) -> DataFrame:
    return va.item_issues(_lines(spark, d))


def total_issues(spark: SparkSession, d: str) -> DataFrame:
    return va.total_issues(_heads(spark, d), _lines(spark, d))


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    heads, lines = _heads(spark, d), _lines(spark, d)
    issues = va.header_issues(heads).unionByName(va.item_issues(lines).withColumnRenamed("purchase_order_id", "id")).unionByName(va.total_issues(heads, lines))
    return va.verdicts(heads, issues)


def evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Expected headers against ones with every seventh total changed and every fifth currency lost."""
    heads = _heads(spark, d).withColumn("line_items", F.array(F.struct(F.col("po_number").alias("part_number"), F.lit("2.00").alias("quantity"))))
    key = F.col("id")
    actual = heads.withColumn("total_amount", F.when(key % 7 == 0, F.col("total_amount") + 1).otherwise(F.col("total_amount"))).withColumn("currency", F.when(key % 5 > 0, F.col("currency")))
    actual = actual.withColumn("line_items", F.when(key % 13 > 0, F.array(F.struct(F.col("po_number").alias("part_number"), F.lit("2.0").alias("quantity")))).otherwise(F.array().cast("array<struct<part_number:string,quantity:string>>")))
    fields = ["currency", "total_amount", "order_date"]
    return ev.accuracy(ev.evaluate(ev.long_form(heads, fields, "id"), ev.long_form(actual, fields, "id"), "id"), "id")


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return mime.with_mime(spread(mime.render_messages(table(spark, d, "inbound_emails"))))


def mail_round_trip(spark: SparkSession, d: str) -> DataFrame:
    found = mime.metadata(_messages(spark, d))
    return found.select(
        "provider", "provider_message_id", "internet_message_id", "thread_id", "sender_email", F.coalesce(clean_inline("sender_name"), F.lit("")).alias("sender_name"), F.array_join("recipient_emails", ",").alias("recipients"),
        F.array_join("cc_emails", ",").alias("cc"), F.col("received_at").cast("string").alias("received_at"), "email_body", F.size("attachments").cast("bigint").alias("files"), "error_type",
    )


def mail_attachments(spark: SparkSession, d: str) -> DataFrame:
    return mime.attachments(_messages(spark, d)).drop("content")


def second_attachments(spark: SparkSession, d: str) -> DataFrame:
    """Attachment number 1 of each mail, or why there is none."""
    found = mime.attachment(_messages(spark, d), 1)
    return found.select("provider", "provider_message_id", "filename", F.length("content").cast("bigint").alias("bytes"), "error_type")


def parsed_texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents parsed as plain text: number of blocks and tables, or the error."""
    files = table(spark, d, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    return parse_documents(files, "text").select("doc_id", F.size("text_blocks").alias("blocks"), F.size("tables").alias("tables"), "error_type")


QUERIES = {
    "x3_x8_headers": headers, "x19_x20_notes": header_notes, "x3_x4_x5_candidates": candidates, "x11_x12_x16_x18_items": items, "x14_continued_tables": continued_tables,
    "x1_x9_t15_t17_letter_headers": letter_headers, "x8_x10_x19_x20_letter_notes": letter_notes, "x13_x18_letter_items": letter_items,
    "d2_d4_header_issues": header_issues, "d5_d7_item_issues": item_issues, "d8_d10_total_issues": total_issues, "d11_verdicts": verdicts, "e1_e3_evaluation": evaluation,
    "m1_m4_mail_round_trip": mail_round_trip, "m6_m9_m12_attachments": mail_attachments, "m7_second_attachments": second_attachments, "s12_parsed_texts": parsed_texts,
}

HEADS = """heads AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 > 0 THEN CAST(o_orderkey AS VARCHAR) END AS po_number, CASE WHEN o_orderkey % 3 > 0 THEN 'S' END AS supplier_name,
    CASE WHEN o_orderkey % 4 > 0 THEN 'EUR' END AS currency, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_totalprice AS DECIMAL(18,4)) END AS subtotal,
    CASE WHEN o_orderkey % 6 = 0 THEN 1.0000 END AS tax, CAST(o_totalprice AS DECIMAL(18,4)) AS total_amount, o_orderkey % 5 - 1 AS days FROM orders)"""
LINES = """lines AS (SELECT l_orderkey AS purchase_order_id, l_linenumber AS line_number,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS pos,
    row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS nth,
    l_partkey % 9 = 0 AS nameless, CASE WHEN l_suppkey % 7 > 0 THEN CAST(l_quantity - 1 AS DECIMAL(18,4)) END AS quantity,
    CAST(CASE WHEN l_partkey % 5 > 0 THEN l_quantity - 1 ELSE l_extendedprice END AS DECIMAL(18,4)) AS line_total FROM lineitem)"""
FILES = """files AS (SELECT id, provider, provider_message_id, a.filename AS f, a.mime_type AS m, k, 'content of ' || id || '/' || k AS bytes FROM (SELECT *,
    unnest(from_json(attachments, '[{"index":"INTEGER","filename":"VARCHAR","mime_type":"VARCHAR"}]')) AS a, generate_subscripts(from_json(attachments, '["JSON"]'), 1) - 1 AS k FROM inbound_emails))"""
LETTERS = """letters AS (SELECT 'PO-' || o_orderkey AS document_id, CAST(o_orderdate AS DATE) AS day, o_custkey AS c, o_custkey % 100 AS s, o_orderkey % 2 = 0 AS a, n,
    CAST(o_totalprice AS DECIMAL(18,2)) AS goods, CAST(o_orderkey % 1000 / 100 AS DECIMAL(18,2)) AS tax, CAST(o_orderkey % 40 AS DECIMAL(18,2)) AS freight
    FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""
NEAR = "abs({0} - {1}) <= greatest(0.02, abs({1}) * 0.0005)"
HEAD_ISSUES = """SELECT id, 'po_number' AS field, 'error' AS severity, 'required' AS rule FROM heads WHERE po_number IS NULL
    UNION ALL SELECT id, 'supplier_name', 'warning', 'missing' FROM heads WHERE supplier_name IS NULL
    UNION ALL SELECT id, 'currency', 'warning', 'missing' FROM heads WHERE currency IS NULL
    UNION ALL SELECT id, 'requested_delivery_date', 'warning', 'before_order_date' FROM heads WHERE days < 0"""
ITEM_ISSUES = f"""SELECT purchase_order_id, 'line_items[' || pos || ']' AS field, 'error' AS severity, 'no_part' AS rule FROM lines WHERE nameless
    UNION ALL SELECT purchase_order_id, 'line_items[' || pos || '].quantity', 'error', 'missing' FROM lines WHERE quantity IS NULL
    UNION ALL SELECT purchase_order_id, 'line_items[' || pos || '].quantity', 'error', 'not_positive' FROM lines WHERE quantity <= 0
    UNION ALL SELECT purchase_order_id, 'line_items[' || pos || '].line_number', 'warning', 'duplicate' FROM lines WHERE nth > 1
    UNION ALL SELECT purchase_order_id, 'line_items[' || pos || '].line_total', 'warning', 'arithmetic' FROM lines WHERE NOT ({NEAR.format('line_total', 'quantity')})"""
SUMS = "sums AS (SELECT purchase_order_id AS id, count(*) AS n, sum(line_total) AS lines_sum FROM lines GROUP BY 1)"
TOTAL_ISSUES = f"""SELECT h.id, 'line_items' AS field, 'error' AS severity, 'required' AS rule FROM heads h LEFT JOIN sums s USING (id) WHERE s.n IS NULL
    UNION ALL SELECT id, 'subtotal', 'warning', 'sum_of_lines' FROM heads JOIN sums USING (id) WHERE NOT ({NEAR.format('subtotal', 'lines_sum')})
    UNION ALL SELECT id, 'total_amount', 'warning', 'sum_of_lines' FROM heads JOIN sums USING (id) WHERE subtotal IS NULL AND tax IS NULL AND NOT ({NEAR.format('total_amount', 'lines_sum')})
    UNION ALL SELECT id, 'total_amount', 'warning', 'sum_of_parts' FROM heads WHERE NOT ({NEAR.format('total_amount', '(subtotal + coalesce(tax, 0))')})"""

ORACLES = {
    "m1_m4_mail_round_trip": f"""SELECT provider, provider_message_id, coalesce(internet_message_id, '<' || id || '@none>') AS internet_message_id, coalesce(thread_id, internet_message_id, '<' || id || '@none>') AS thread_id,
        lower(sender_email) AS sender_email, trim(regexp_replace(coalesce(sender_name, ''), '\\s+', ' ', 'g')) AS sender_name, lower(array_to_string(recipient_email, ',')) AS recipients,
        lower(array_to_string(coalesce(cc, []), ',')) AS cc, strftime(date_trunc('second', created_at), '%Y-%m-%d %H:%M:%S') AS received_at, {CLEAN.format('email_body')} AS email_body,
        len(coalesce(json_extract(attachments, '$[*]'), [])) AS files, CAST(NULL AS VARCHAR) AS error_type FROM inbound_emails""",
    "m6_m9_m12_attachments": f"""WITH {FILES} SELECT provider, provider_message_id, CAST(k AS INTEGER) AS attachment_index, coalesce(f, 'attachment-' || k || '.pdf') AS filename, m AS mime_type,
        CAST(strlen(bytes) AS BIGINT) AS size_bytes, sha256(bytes) AS file_hash, m = 'application/pdf' OR coalesce(lower(f), '') LIKE '%.pdf' AS is_pdf FROM files""",
    "m7_second_attachments": f"""WITH {FILES} SELECT e.provider, e.provider_message_id, f AS filename, CAST(strlen(bytes) AS BIGINT) AS bytes, CASE WHEN bytes IS NULL THEN 'AttachmentNotFound' END AS error_type
        FROM inbound_emails e LEFT JOIN files ON files.id = e.id AND k = 1""",
    "s12_parsed_texts": r"""WITH p AS (SELECT doc_id, unnest(string_split(replace(coalesce(text, ''), chr(13), ''), chr(10) || chr(10))) AS part FROM documents),
        l AS (SELECT doc_id, list_filter(string_split(part, chr(10)), lambda x: regexp_matches(x, '[^\s\x{1c}-\x{1f}\x{85}\x{a0}\x{0b}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]')) AS lines FROM p),
        n AS (SELECT doc_id, count(*) FILTER (WHERE len(lines) > 0 AND len(list_filter(lines, lambda x: NOT contains(x, chr(9)))) > 0) AS blocks,
            count(*) FILTER (WHERE len(lines) > 0 AND len(list_filter(lines, lambda x: NOT contains(x, chr(9)))) = 0) AS tables FROM l GROUP BY doc_id)
        SELECT d.doc_id, CASE WHEN blocks + tables > 0 THEN CAST(blocks AS INTEGER) END AS blocks, CASE WHEN blocks + tables > 0 THEN CAST(tables AS INTEGER) END AS tables,
        CASE WHEN coalesce(blocks + tables, 0) = 0 THEN 'DocumentParse' END AS error_type FROM documents d LEFT JOIN n USING (doc_id)""",
    "x3_x8_headers": """SELECT 'PO-' || o_orderkey AS document_id, 'PO-' || o_orderkey AS purchase_order_number, CAST(o_orderdate AS DATE) AS order_date, 'Client ' || o_custkey AS buyer_name,
        CASE o_orderkey % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'GBP' END AS currency, CAST(o_totalprice AS DECIMAL(18,2)) AS total_amount
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "x3_x4_x5_candidates": """WITH n AS (SELECT count(*) FILTER (WHERE o_orderkey % 3 = 0) AS a, count(*) FILTER (WHERE o_orderkey % 3 = 1) AS b, count(*) FILTER (WHERE o_orderkey % 3 = 2) AS c
        FROM orders JOIN customer ON o_custkey = c_custkey)
        SELECT 'purchase_order_number' AS field, 0 AS priority, a + b AS n FROM n UNION ALL SELECT 'purchase_order_number', 1, c FROM n
        UNION ALL SELECT 'order_date', 0, a + b FROM n UNION ALL SELECT 'order_date', 1, c FROM n UNION ALL SELECT 'buyer_name', 0, a + b + c FROM n
        UNION ALL SELECT 'currency', 0, a + b FROM n UNION ALL SELECT 'total_amount', 0, 2 * a + b FROM n UNION ALL SELECT 'total_amount', 1, c FROM n""",
    "x19_x20_notes": """SELECT 'PO-' || o_orderkey AS document_id, 'supplier_name not found in document' AS warnings,
        'buyer_name,currency,order_date,purchase_order_number,total_amount' AS evidence
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "x11_x12_x16_x18_items": """SELECT 'PO-' || l_orderkey AS document_id, n AS seq, n AS line_number, 'P-' || l_partkey AS part_number, 'Part ' || l_partkey AS part_name,
        CAST(l_quantity AS INTEGER) AS quantity, 'EA' AS unit_of_measure, CAST(l_extendedprice AS DECIMAL(18,2)) AS line_total FROM (SELECT *,
        CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS INTEGER) AS n
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)""",
    "x14_continued_tables": """SELECT 'PO-' || o_orderkey AS document_id, CASE WHEN o_orderkey % 3 = 2 AND coalesce(n, 0) > 1 THEN 2 ELSE 1 END AS tables,
        CASE WHEN o_orderkey % 3 = 2 AND coalesce(n, 0) > 1 THEN 1 ELSE 0 END AS continued FROM orders JOIN customer ON o_custkey = c_custkey
        LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
    "x1_x9_t15_t17_letter_headers": f"""WITH {LETTERS} SELECT document_id, document_id AS purchase_order_number, day AS order_date, CAST(day + 14 AS DATE) AS requested_delivery_date,
        CASE WHEN NOT a THEN 'CHF' END AS currency, 'Maker ' || s || CASE WHEN a THEN ' Ltd' ELSE ' GmbH' END AS supplier_name, 'sales@s' || s || '.example' AS supplier_email,
        CASE WHEN a THEN s || ' Quay Road, Leeds' ELSE 'Hafenstrasse ' || s || ', 20457 Hamburg' END AS supplier_address,
        'Client ' || c || CASE WHEN a THEN ' Trading Inc.' ELSE ' Ltd' END AS buyer_name, CASE WHEN a THEN c || ' Industrial Way, Springfield, IL 62701' ELSE c || ' Elm Road, York' END AS buyer_address,
        CASE WHEN a THEN 'Dock 3, ' || c || ' Harbour Street, Springfield' END AS ship_to_address, CASE WHEN NOT a THEN 'Client ' || c || ' Ltd, Box ' || c END AS bill_to_address,
        CASE WHEN a THEN 'Net 30' ELSE 'Net 45' END AS payment_terms, CASE WHEN a THEN 'CIF Rotterdam' ELSE 'DDP Leeds' END AS shipping_terms,
        goods AS subtotal, tax, freight AS shipping, CAST(goods + tax + freight AS DECIMAL(18,2)) AS total_amount FROM letters""",
    "x8_x10_x19_x20_letter_notes": f"""WITH {LETTERS} SELECT document_id,
        CASE WHEN a THEN 'buyer_name taken from document letterhead (no explicit buyer label); currency symbol ''$'' found but ambiguous (USD/CAD/AUD...); currency left empty'
            ELSE 'line numbers not present in document; assigned sequentially by row order' END AS warnings,
        CASE WHEN a THEN 'buyer_name,order_date,payment_terms,purchase_order_number,requested_delivery_date,ship_to_address,shipping,shipping_terms,subtotal,supplier_address,supplier_email,supplier_name,tax,total_amount'
            ELSE 'bill_to_address,buyer_address,buyer_name,currency,order_date,payment_terms,purchase_order_number,requested_delivery_date,shipping,shipping_terms,subtotal,supplier_address,supplier_email,supplier_name,tax,total_amount' END AS evidence,
        CASE WHEN a THEN 'Client ' || c || ' Trading Inc.' ELSE 'Buyer:' END AS buyer_name, CASE WHEN a THEN 'Vendor: Maker ' || s || ' Ltd, ' || s || ' Quay Road, Leeds' ELSE 'Supplier:' END AS supplier_address,
        CASE WHEN NOT a THEN 'currency code/symbol found in document body' END AS currency, n AS items FROM letters""",
    "x13_x18_letter_items": """SELECT 'PO-' || l_orderkey AS document_id, n AS seq, CASE WHEN l_orderkey % 2 = 0 THEN 10 * n ELSE n END AS line_number, 'P-' || l_partkey AS part_number,
        'Part ' || l_partkey || CASE WHEN l_orderkey % 2 = 0 AND l_partkey % 3 = 0 THEN ' (lot ' || l_suppkey || ')' ELSE '' END AS part_name, CAST(l_quantity AS INTEGER) AS quantity,
        CASE WHEN l_orderkey % 2 = 0 THEN 'PC' ELSE 'PK' END AS unit_of_measure, CAST(l_extendedprice AS DECIMAL(18,2)) AS line_total, l_orderkey % 2 = 1 AS numbers_given FROM (SELECT *,
        CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS INTEGER) AS n
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "d2_d4_header_issues": f"WITH {HEADS} {HEAD_ISSUES}",
    "d5_d7_item_issues": f"WITH {LINES} {ITEM_ISSUES}",
    "d8_d10_total_issues": f"WITH {HEADS}, {LINES}, {SUMS} {TOTAL_ISSUES}",
    "d11_verdicts": f"""WITH {HEADS}, {LINES}, {SUMS}, issues AS ({HEAD_ISSUES} UNION ALL {ITEM_ISSUES} UNION ALL {TOTAL_ISSUES})
        SELECT h.id, count(severity) FILTER (WHERE severity = 'error') AS errors, count(severity) FILTER (WHERE severity = 'warning') AS warnings,
        count(severity) FILTER (WHERE severity = 'error') = 0 AS is_valid FROM heads h LEFT JOIN issues i ON i.id = h.id GROUP BY h.id""",
    "e1_e3_evaluation": """WITH r AS (SELECT o_orderkey AS id, 6 AS total, 6 - CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 4 > 0 THEN 1 ELSE 0 END - CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END
        - CASE WHEN o_orderkey % 13 = 0 THEN CASE WHEN o_orderkey % 11 = 0 THEN 2 ELSE 3 END ELSE 0 END AS correct FROM orders)
        SELECT id, CAST(total AS BIGINT) AS total, CAST(correct AS BIGINT) AS correct, correct / 6 AS accuracy FROM r
        UNION ALL SELECT NULL, CAST(sum(total) AS BIGINT), CAST(sum(correct) AS BIGINT), sum(correct) / sum(total) FROM r""",
}
