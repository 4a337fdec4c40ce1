"""Queries of the text and order expressions over the tables, with SQL that does not call them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.functions import orders as o
from orderloom.functions import text as t
from orderloom.operators.documents import table_markdown
from orderloom.session import table
from orderloom.sources import mime


def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", t.clean_text("text").alias("clean"))


def clean_inline(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", t.clean_inline("text").alias("clean"))


def find_emails(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "inbound_emails").select("id", F.explode(t.find_emails("email_body")).alias("address"))


def first_email(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "inbound_emails").select("id", t.normalize_email("email_body").alias("address"))


def dedupe_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "purchase_orders").select("id", t.dedupe_key("po_number", "supplier_name", "buyer_name").alias("key"))


def _amounts(spark: SparkSession, d: str) -> DataFrame:
    """Line prices written in five notations by line number."""
    plain = F.format_number("l_extendedprice", 2)
    swapped = F.translate(plain, ",.", ".,")
    kind = F.col("l_linenumber") % 5
    text = (
        F.when(kind == 0, plain).when(kind == 1, F.concat(swapped, F.lit(" €"))).when(kind == 2, F.concat(F.lit("("), plain, F.lit(")")))
        .when(kind == 3, F.concat(F.lit("USD "), F.replace(plain, F.lit(","), F.lit("'")))).otherwise(F.concat(plain, F.lit("-")))
    )
    return table(spark, d, "lineitem").withColumn("amount", text)


def decimals(spark: SparkSession, d: str) -> DataFrame:
    return _amounts(spark, d).select("l_orderkey", "l_linenumber", t.parse_decimal("amount").cast("decimal(18,4)").alias("value"))


def last_amounts(spark: SparkSession, d: str) -> DataFrame:
    written = F.concat(F.lit("3 lines, VAT 19% EUR "), F.format_number("l_extendedprice", 2))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", o.last_money(written).cast("decimal(18,4)").alias("value"))


def dates(spark: SparkSession, d: str) -> DataFrame:
    day, kind = F.col("o_orderdate"), F.col("o_orderkey") % 6
    text = (
        F.when(kind == 0, F.date_format(day, "yyyy-MM-dd")).when(kind == 1, F.date_format(day, "MM/dd/yyyy")).when(kind == 2, F.date_format(day, "dd.MM.yyyy"))
        .when(kind == 3, F.date_format(day, "d MMM yyyy")).when(kind == 4, F.date_format(day, "MMMM d, yyyy")).otherwise(F.date_format(day, "dd-MMM-yyyy"))
    )
    return table(spark, d, "orders").select("o_orderkey", o.parse_date(text).alias("day"))


def day_first_dates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", o.parse_date(F.date_format("o_orderdate", "d/M/yyyy"), "DMY").alias("day"))


def quantities(spark: SparkSession, d: str) -> DataFrame:
    text = F.format_string("%d %s", F.col("l_quantity").cast("int"), F.when(F.col("l_linenumber") % 2 == 0, "ea").otherwise("kg"))
    number = t.parse_int(F.concat(F.lit(" #"), F.col("l_linenumber").cast("string"), F.lit(". ")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", t.parse_decimal(text).cast("int").alias("quantity"), o.uom_of_quantity(text).alias("unit"), number.alias("number"))


def currencies(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("o_orderkey") % 5
    text = (
        F.when(kind == 0, "Total in USD and EUR").when(kind == 1, "sum € 12").when(kind == 2, "$ 5").when(kind == 3, "due: chf 7").otherwise("THE AMOUNT ¥ 9")
    )
    return table(spark, d, "orders").select("o_orderkey", t.detect_currency(text).alias("currency"))


def order_numbers(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("your order PO-"), F.col("o_orderkey").cast("string"), F.lit("/A. of today"))
    return table(spark, d, "orders").select("o_orderkey", o.po_number(text).alias("number"))


def parties(spark: SparkSession, d: str) -> DataFrame:
    kind, key = F.col("c_custkey") % 3, F.col("c_custkey").cast("string")
    text = (
        F.when(kind == 0, F.concat(F.lit("Firm "), key, F.lit(" Ltd., "), key, F.lit(" Main St")))
        .when(kind == 1, F.concat(F.lit("Firm "), key, F.lit("\n"), key, F.lit(" Main St\nTown;"))).otherwise(F.concat(F.lit("a"), key, F.lit("@x.example Firm "), key))
    )
    return table(spark, d, "customer").select("c_custkey", o.split_party(text).alias("p")).select("c_custkey", "p.name", "p.address", "p.email")


def labels(spark: SparkSession, d: str) -> DataFrame:
    kind, key = F.col("o_orderkey") % 6, F.col("o_orderkey").cast("string")
    text = F.concat(
        F.when(kind == 0, "**PO Number**: ").when(kind == 1, "Vendor E-mail - ").when(kind == 2, "Ship-to Address: ").when(kind == 3, "Grand Total # ").when(kind == 4, "- Terms of Delivery ").otherwise("Totally "), key
    )
    return table(spark, d, "orders").select("o_orderkey", o.match_label(text).alias("l")).select("o_orderkey", "l.field", "l.rest")


def keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "inbound_emails").select(
        "id", mime.storage_key("provider", "provider_message_id").alias("storage_key"), mime.workflow_key("provider", "internet_message_id").alias("workflow_key"), mime.safe_name("subject").alias("name")
    )


def pdf_files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "attached_documents").select("id", mime.is_pdf("mime_type", "filename").alias("pdf"))


def html_text(spark: SparkSession, d: str) -> DataFrame:
    html = F.concat(F.lit("<html><style>a{}</style><body><div>"), F.replace("text", F.lit("\n"), F.lit("<br/>")), F.lit("</div><script>x<y</script></body></html>"))
    return table(spark, d, "documents").select("doc_id", mime.html_to_text(html).alias("plain"))


def markdown_tables(spark: SparkSession, d: str) -> DataFrame:
    row = F.struct("l_linenumber", "l_partkey", F.array(F.col("l_linenumber").cast("string"), F.concat(F.col("l_partkey").cast("string"), F.lit("|x"))).alias("cells"))
    rows = F.transform(F.array_sort(F.collect_list(row)), lambda x: x["cells"])
    grouped = table(spark, d, "lineitem").groupBy("l_orderkey").agg(rows.alias("rows"))
    return grouped.select("l_orderkey", table_markdown(F.concat(F.array(F.array(F.lit("No"), F.lit("Part"), F.lit("Note"))), "rows")).alias("markdown"))


QUERIES = {
    "t1_clean_text": clean_text, "t2_clean_inline": clean_inline, "t3_first_email": first_email, "t4_find_emails": find_emails, "t5_decimals": decimals, "t6_t19_quantities": quantities,
    "t7_currencies": currencies, "t8_dates": dates, "t8_day_first_dates": day_first_dates, "t10_t11_dedupe_keys": dedupe_keys, "t12_last_amounts": last_amounts,
    "t15_parties": parties, "t18_order_numbers": order_numbers, "x2_labels": labels, "m5_html_text": html_text, "m8_pdf_files": pdf_files, "m10_m11_s8_keys": keys, "s11_markdown_tables": markdown_tables,
}

CLEAN = r"""nullif(array_to_string(list_filter(list_transform(string_split(replace({0}, chr(13), ''), chr(10)),
    lambda x: regexp_replace(regexp_replace(x, '[ \t\x{{a0}}]+', ' ', 'g'), '^[\s\p{{Z}}\x0b\x1c-\x1f]+|[\s\p{{Z}}\x0b\x1c-\x1f]+$', '', 'g')), lambda x: x <> ''), chr(10)), '')"""
MAIL = r"[A-Za-z0-9._%+''-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
NORM = "regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]', '', 'g')"

ORACLES = {
    "t1_clean_text": f"SELECT doc_id, {CLEAN.format('text')} AS clean FROM documents",
    "t2_clean_inline": r"SELECT doc_id, nullif(trim(regexp_replace(text, '[\s\p{Z}\x0b\x1c-\x1f\x{85}]+', ' ', 'g')), '') AS clean FROM documents",
    "t3_first_email": f"SELECT id, lower(nullif(regexp_extract(email_body, '{MAIL}'), '')) AS address FROM inbound_emails",
    "t4_find_emails": f"SELECT DISTINCT id, unnest(regexp_extract_all(lower(email_body), '{MAIL}')) AS address FROM inbound_emails",
    "t5_decimals": "SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_linenumber % 5 IN (2, 4) THEN -l_extendedprice ELSE l_extendedprice END AS DECIMAL(18,4)) AS value FROM lineitem",
    "t6_t19_quantities": "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS quantity, CASE WHEN l_linenumber % 2 = 0 THEN 'EA' ELSE 'KG' END AS unit, l_linenumber AS number FROM lineitem",
    "t7_currencies": "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 3 THEN 'CHF' END AS currency FROM orders",
    "t8_dates": "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders",
    "t8_day_first_dates": "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders",
    "t10_t11_dedupe_keys": f"SELECT id, {NORM.format('po_number')} || '|' || {NORM.format('supplier_name')} || '|' || {NORM.format('buyer_name')} AS key FROM purchase_orders",
    "t12_last_amounts": "SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(18,4)) AS value FROM lineitem",
    "t15_parties": """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Firm ' || c_custkey || ' Ltd.' ELSE 'Firm ' || c_custkey END AS name,
        CASE c_custkey % 3 WHEN 0 THEN c_custkey || ' Main St' WHEN 1 THEN c_custkey || ' Main St, Town' END AS address,
        CASE WHEN c_custkey % 3 = 2 THEN 'a' || c_custkey || '@x.example' END AS email FROM customer""",
    "t18_order_numbers": "SELECT o_orderkey, 'PO-' || o_orderkey || '/A' AS number FROM orders",
    "x2_labels": """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'purchase_order_number' WHEN 1 THEN 'supplier_email' WHEN 2 THEN 'ship_to_address' WHEN 3 THEN 'total_amount'
        WHEN 4 THEN 'shipping_terms' END AS field, CASE WHEN o_orderkey % 6 < 5 THEN CAST(o_orderkey AS VARCHAR) END AS rest FROM orders""",
    "m5_html_text": r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace('<html><style>a{}</style><body><div>' || replace(text, chr(10), '<br/>') ||
        '</div><script>x<y</script></body></html>', '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '(?i)<br\s*/?>|</p>|</div>', chr(10), 'g'),
        '<[^>]+>', ' ', 'g') AS plain FROM documents""",
    "m8_pdf_files": "SELECT id, lower(coalesce(mime_type, '')) = 'application/pdf' OR lower(coalesce(filename, '')) LIKE '%.pdf' AS pdf FROM attached_documents",
    "m10_m11_s8_keys": """SELECT id, left(sha256(provider || ':' || provider_message_id), 32) AS storage_key,
        'po-email-' || provider || '-' || left(regexp_replace(internet_message_id, '[^A-Za-z0-9._@-]+', '_', 'g'), 120) || '-' || left(sha256(internet_message_id), 8) AS workflow_key,
        coalesce(nullif(left(regexp_replace(regexp_replace(subject, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), 120), ''), 'file') AS name FROM inbound_emails""",
    "s11_markdown_tables": r"""SELECT l_orderkey, '| No | Part | Note |' || chr(10) || '| --- | --- | --- |' || chr(10) ||
        string_agg('| ' || l_linenumber || ' | ' || l_partkey || '\|x |  |', chr(10) ORDER BY l_linenumber, l_partkey) AS markdown FROM lineitem GROUP BY l_orderkey""",
}
