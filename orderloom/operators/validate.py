"""Declarative checks of orders and their lines; each finding is a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.functions import vocab
from orderloom.functions.orders import close
from orderloom.functions.text import blank_to_null, clean_inline, normalize_email, strip

TEXT_FIELDS = ("supplier_name", "supplier_address", "buyer_name", "buyer_address", "payment_terms", "shipping_terms", "ship_to_address", "bill_to_address")


def normalise_orders(orders: DataFrame) -> DataFrame:
    """Upper-case number and currency, e-mail address and one-line texts."""
    upper = {c: F.upper(strip(c)) for c in ("po_number", "currency") if c in orders.columns}
    texts = {c: clean_inline(c) for c in TEXT_FIELDS if c in orders.columns}
    mail = {"supplier_email": normalize_email("supplier_email")} if "supplier_email" in orders.columns else {}
    return orders.withColumns(upper | texts | mail)


def normalise_items(items: DataFrame) -> DataFrame:
    return items.withColumns({"part_number": clean_inline("part_number"), "part_name": clean_inline("part_name"), "unit_of_measure": blank_to_null(F.upper(clean_inline("unit_of_measure")))})


def _issue(field: Column | str, severity: str, rule: str, when: Column) -> Column:
    name = F.lit(field) if isinstance(field, str) else field
    return F.when(when, F.struct(name.alias("field"), F.lit(severity).alias("severity"), F.lit(rule).alias("rule")))


def _found(df: DataFrame, key: str, issues: list[Column]) -> DataFrame:
    found = F.explode(F.filter(F.array(*issues), lambda i: i.isNotNull()))
    return df.select(key, found.alias("i")).select(key, "i.field", "i.severity", "i.rule")


def header_issues(orders: DataFrame, key: str = "id") -> DataFrame:
    """Missing fields and days out of order. Columns: key, field, severity, rule."""
    missing = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    issues = [_issue("po_number", "error", "required", missing("po_number"))]
    issues += [_issue(c, "warning", "missing", missing(c)) for c in ("supplier_name", "order_date", "currency", "total_amount")]
    issues.append(_issue("requested_delivery_date", "warning", "before_order_date", F.col("requested_delivery_date") < F.col("order_date")))
    return _found(orders, key, issues)


def item_issues(items: DataFrame, key: str = "purchase_order_id") -> DataFrame:
    """Per line: no part, no or bad quantity, negative price, repeated number, wrong total. Lines are counted by sequence."""
    lines = items.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy("sequence")))
    again = F.row_number().over(Window.partitionBy(key, "line_number").orderBy("sequence")) > 1
    lines = lines.withColumn("again", F.col("line_number").isNotNull() & again)
    ref = F.format_string("line_items[%d]", F.col("pos"))
    at = lambda f: F.concat(ref, F.lit(f".{f}"))
    none = F.coalesce("part_number", F.lit("")) == ""
    product = (F.col("quantity").cast("decimal(18,4)") * F.col("unit_price").cast("decimal(18,4)")).cast("decimal(38,8)")
    return _found(lines, key, [
        _issue(ref, "error", "no_part", none & (F.coalesce("part_name", F.lit("")) == "")),
        _issue(at("quantity"), "error", "missing", F.col("quantity").isNull()),
        _issue(at("quantity"), "error", "not_positive", F.col("quantity") <= 0),
        _issue(at("unit_price"), "error", "negative", F.col("unit_price") < 0),
        _issue(at("line_number"), "warning", "duplicate", F.col("again")),
        _issue(at("line_total"), "warning", "arithmetic", ~close("line_total", product)),
    ])


def total_issues(orders: DataFrame, items: DataFrame, key: str = "id") -> DataFrame:
    """No lines; subtotal or total against the lines, where all have a total; total against its parts."""
    sums = items.groupBy(F.col("purchase_order_id").alias(key)).agg(
        F.count("*").alias("n"), F.count("line_total").alias("n_totals"), F.sum(F.col("line_total").cast("decimal(18,4)")).cast("decimal(30,4)").alias("lines_sum")
    )
    both = orders.join(sums, key, "left")
    complete = F.coalesce((F.col("n") == F.col("n_totals")) & (F.col("n") > 0), F.lit(False))
    alone = F.col("subtotal").isNull() & F.col("tax").isNull() & F.col("shipping").isNull()
    parts = F.col("subtotal") + F.coalesce("tax", F.lit(0)) + F.coalesce("shipping", F.lit(0))
    return _found(both, key, [
        _issue("line_items", "error", "required", F.col("n").isNull()),
        _issue("subtotal", "warning", "sum_of_lines", complete & ~close("subtotal", "lines_sum")),
        _issue("total_amount", "warning", "sum_of_lines", complete & alone & ~close("total_amount", "lines_sum")),
        _issue("total_amount", "warning", "sum_of_parts", ~close("total_amount", parts)),
    ])


def verdicts(orders: DataFrame, issues: DataFrame, key: str = "id") -> DataFrame:
    """key, errors, warnings, is_valid of every order."""
    counts = issues.groupBy(key).agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    every = orders.select(key).join(counts, key, "left")
    return every.select(key, F.coalesce("errors", F.lit(0)).alias("errors"), F.coalesce("warnings", F.lit(0)).alias("warnings"), (F.coalesce("errors", F.lit(0)) == 0).alias("is_valid"))


def with_messages(issues: DataFrame) -> DataFrame:
    """Adds the message of each error, and place, the order in which errors are told: fields of the order, then its lines."""
    by_rule = F.create_map(*(F.lit(x) for pair in vocab.ISSUE_MESSAGES.items() for x in pair))
    required = F.create_map(*(F.lit(x) for pair in vocab.REQUIRED_MESSAGES.items() for x in pair))
    message = F.when(F.col("rule") == "required", F.try_element_at(required, F.col("field"))).otherwise(F.try_element_at(by_rule, F.col("rule")))
    line = F.nullif(F.regexp_extract("field", r"line_items\[(\d+)\]", 1), F.lit("")).cast("int")
    place = F.coalesce(line, F.when(F.col("field") == "line_items", 0).otherwise(-1))
    return issues.withColumns({"message": message, "place": place})
