import datetime as dt
import time

from pyspark.sql import functions as F

from orderloom.operators import evaluate as ev
from orderloom.operators import state as st
from orderloom.operators import validate as va
from orderloom.sources.documents import read_snapshot, write_snapshot
from orderloom.streaming import mail


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_register_and_merge(spark):
    state = spark.createDataFrame([("a", "SAVED", 1), ("b", "FAILED", 1)], "k string, status string, n int")
    batch = spark.createDataFrame([("a", 5), ("b", 6), ("b", 7), ("c", 8), (None, 9), (None, 9)], "k string, n int")
    found = st.register(state, batch, ["k"], ["n"], F.col("status") == "SAVED")
    assert rows(found.select("k", "n", "action"), "n") == [("a", 5, "finished"), ("b", 6, "again"), ("c", 8, "new"), (None, 9, "new"), (None, 9, "new")]
    changes = spark.createDataFrame([("b", 6), ("c", 8)], "k string, n int")
    assert rows(st.merge(state, changes, ["k"]), "k") == [("a", "SAVED", 1), ("b", "FAILED", 6), ("c", None, 8)]
    assert rows(st.merge(state, changes, ["k"], insert_only=True), "k") == [("a", "SAVED", 1), ("b", "FAILED", 1), ("c", None, 8)]
    once = st.merge(state, changes, ["k"])
    assert rows(st.merge(once, changes, ["k"]), "k") == rows(once, "k")
    assert st.merge(state.limit(0), changes.limit(0), ["k"]).count() == 0


def test_duplicates_rollup_events(spark):
    batch = spark.createDataFrame([("x", "1", 1), ("x", "2", 2), ("", "3", 1), ("", "4", 1), (None, "5", 1), ("y", "6", 1)], "h string, id string, n int")
    known = spark.createDataFrame([("y",), ("y",)], "key string")
    assert rows(st.mark_duplicates(batch, F.col("h"), ["n", "id"], known).select("id", "duplicate"), "id") == [("1", False), ("2", True), ("3", False), ("4", False), ("5", False), ("6", True)]
    parts = spark.createDataFrame([("a", "SAVED"), ("a", "FAILED"), ("b", "DUPLICATE"), ("c", "DUPLICATE"), ("c", "SAVED")], "m string, status string")
    assert rows(st.roll_up(parts, "m"), "m") == [("a", "FAILED", 2), ("b", "DUPLICATE", 1), ("c", "SAVED", 2)]
    log = spark.createDataFrame([(7, "a", "2026-01-01 00:00:00")], "id bigint, e string, at string").withColumn("at", F.col("at").cast("timestamp"))
    more = spark.createDataFrame([("b", "2026-01-02 00:00:01"), ("c", "2026-01-01 05:00:00"), ("d", "2026-01-02 00:00:00")], "e string, at string").withColumn("at", F.col("at").cast("timestamp"))
    assert rows(st.append_events(log, more, ["at", "e"]).select("id", "e"), "id") == [(7, "a"), (8, "c"), (9, "d"), (10, "b")]
    assert rows(st.append_events(log.limit(0), more, ["at", "e"]).select("id"), "id") == [(1,), (2,), (3,)]


def test_validation(spark):
    heads = spark.createDataFrame([(1, " po-1 ", "S", "x", "EUR", 10.0, 1.0, 11.0), (2, None, None, None, None, None, None, None)], "id int, po_number string, supplier_name string, d string, currency string, s double, t double, g double")
    money = lambda c, n: F.col(c).cast("decimal(18,4)").alias(n)
    day = F.lit("2026-01-02").cast("date")
    orders = heads.select("id", "po_number", "supplier_name", "currency", day.alias("order_date"), F.date_sub(day, 1).alias("requested_delivery_date"), money("s", "subtotal"), money("t", "tax"), F.lit(None).cast("decimal(18,4)").alias("shipping"), money("g", "total_amount"))
    assert va.normalise_orders(orders).where("id = 1").first().po_number == "PO-1"
    items = spark.createDataFrame([(1, 1, 1, "p", None, "2", "2", "4"), (1, 2, 1, None, None, "0", "-1", "6")], "purchase_order_id int, sequence int, line_number int, part_number string, part_name string, quantity string, unit_price string, line_total string")
    items = items.withColumns({c: F.col(c).cast("decimal(18,4)") for c in ("quantity", "unit_price", "line_total")})
    found = sorted((r.field, r.rule) for r in va.item_issues(items).collect())
    assert found == [("line_items[2]", "no_part"), ("line_items[2].line_number", "duplicate"), ("line_items[2].line_total", "arithmetic"), ("line_items[2].quantity", "not_positive"), ("line_items[2].unit_price", "negative")]
    assert sorted((r.id, r.rule) for r in va.total_issues(orders, items).collect()) == [(2, "required")]
    issues = va.header_issues(orders).unionByName(va.total_issues(orders, items))
    assert rows(va.verdicts(orders, issues).select("id", "is_valid"), "id") == [(1, True), (2, False)]


def test_evaluation(spark):
    kind = "document_id string, currency string, total_amount string, line_items array<struct<part_number:string,quantity:string>>"
    want = spark.createDataFrame([("a", "EUR", "1.0", [("p", "2")]), ("b", None, "5", [])], kind)
    got = spark.createDataFrame([("a", "EUR", "1.00", []), ("b", "USD", "5", [])], kind)
    fields = ["currency", "total_amount"]
    results = ev.evaluate(ev.long_form(want, fields), ev.long_form(got, fields))
    assert rows(results.where("not matches").select("document_id", "path"), "document_id", "path") == [("a", "line_items.count"), ("a", "line_items[1].part_number"), ("a", "line_items[1].quantity"), ("b", "currency")]
    assert rows(ev.accuracy(results), "document_id") == [(None, 8, 4, 0.5), ("a", 5, 2, 0.4), ("b", 3, 2, 2 / 3)]
    assert tuple(ev.passes(results, 0.6).first()) == (0.5, False) and tuple(ev.passes(results.limit(0), 0.9).first()) == (1.0, True)


def test_stream_takes_each_message_once(spark, tmp_path):
    source, schema = tmp_path / "in", "provider string, mid string, at int, body string"
    state = "provider string, mid string, at int, status string"
    each = mail.once_per_key(None, ["provider", "mid"], str(tmp_path / "state"), state, lambda df: df.select("provider", "mid", "at", F.when(F.col("body") == "bad", "FAILED").otherwise("SAVED").alias("status")), ["at"])

    def deliver(name, data):
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(source / name))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(source))
        mail.start(stream, each, str(tmp_path / "checkpoint"), once=True).awaitTermination()
        return rows(read_snapshot(spark, str(tmp_path / "state"), state), "mid")

    assert deliver("1", [("p", "a", 1, "x"), ("p", "a", 2, "y"), ("p", "b", 3, "bad")]) == [("p", "a", 1, "SAVED"), ("p", "b", 3, "FAILED")]
    assert deliver("2", [("p", "a", 9, "z"), ("p", "b", 10, "ok"), ("p", "c", 11, "x")]) == [("p", "a", 1, "SAVED"), ("p", "b", 10, "SAVED"), ("p", "c", 11, "SAVED")]


def test_message_stream_and_progress(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.eml").write_bytes(b"From: a@b.de\nMessage-ID: <1@x>\n\nhi\n")
    seen = []
    progress = mail.Progress()
    spark.streams.addListener(progress)
    try:
        query = mail.start(mail.message_stream(spark, str(tmp_path / "in")), lambda df, n: seen.extend(r[0] for r in df.select("provider_message_id").collect()), str(tmp_path / "c"), once=True)
        query.awaitTermination()
        for _ in range(50):
            # listeners are told a little later
            if progress.latest.get(str(query.id), {}).get("state") == "ended":
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(progress)
    assert seen == ["1@x"]
    assert {k: progress.latest[str(query.id)][k] for k in ("state", "rows")} == {"state": "ended", "rows": 1}


MAIL = "provider string, provider_message_id string, id string, status string, error_message string, subject string"
DAY = [dt.datetime(2026, 1, d) for d in range(1, 9)]


def told(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_mails_new_again_and_finished(spark):
    state = spark.createDataFrame([("p", "done", "m1", "SAVED", None, "old"), ("p", "failed", "m2", "FAILED", "bad", "old")], MAIL)
    batch = spark.createDataFrame(
        [("p", "new", "a", "s1", DAY[0]), ("p", "new", "b", "s2", DAY[1]), ("p", "done", "c", "s3", DAY[0]), ("p", "failed", "d", "s4", DAY[0]), (None, "x", "e", None, DAY[0]), (None, "x", "f", None, DAY[0])],
        "provider string, provider_message_id string, id string, subject string, created_at timestamp",
    )
    step = st.register_mails(state, batch, ["created_at", "id"], ["subject"])
    assert told(step.outcomes, "id", "email_id", "action", "status") == [
        ("a", "a", "new", "RECEIVED"), ("b", "a", "again", "RECEIVED"), ("c", "m1", "finished", "SAVED"), ("d", "m2", "again", "RECEIVED"), ("e", "e", "new", "RECEIVED"), ("f", "f", "new", "RECEIVED"),
    ]
    kept = {r.provider_message_id: (r.id, r.status, r.error_message, r.subject) for r in step.state.where("provider is not null").collect()}
    assert kept == {"done": ("m1", "SAVED", None, "old"), "failed": ("m2", "RECEIVED", None, "s4"), "new": ("a", "RECEIVED", None, "s2")}
    assert step.events.count() == 6
    none = st.register_mails(state.limit(0), batch.limit(0), ["created_at", "id"], ["subject"])
    assert none.state.count() == none.outcomes.count() == none.events.count() == 0


def test_files_with_an_order_are_duplicates_and_others_are_taken_over(spark):
    schema = "file_hash string, id string, email_id string, status string, error_message string, duplicate_of string"
    state = spark.createDataFrame([("own", "f1", "m1", "SAVED", None, None), ("linked", "f2", "m1", "DUPLICATE", "e", "o9"), ("open", "f3", "m1", "FAILED", "bad", None)], schema)
    saved = spark.createDataFrame([("f1", "o1")], "document_id string, id string")
    batch = spark.createDataFrame([(h, i, "m2", DAY[0]) for h, i in (("own", "x1"), ("linked", "x2"), ("open", "x3"), ("fresh", "x4"))], "file_hash string, id string, email_id string, created_at timestamp")
    step = st.register_files(state, saved, batch, ["created_at", "id"])
    assert told(step.outcomes, "id", "document_id", "action", "order_id") == [("x1", "f1", "duplicate", "o1"), ("x2", "f2", "duplicate", "o9"), ("x3", "f3", "taken over", None), ("x4", "x4", "new", None)]
    assert ("open", "f3", "m2", "DOCUMENT_DOWNLOADED", None, None) in told(step.state, *state.columns) and step.state.count() == 4
    assert told(step.events, "entity_type", "status") == [("document", "DOCUMENT_DOWNLOADED")] * 2 + [("email", "DUPLICATE")] * 2


def test_orders_saved_once(spark):
    known = spark.createDataFrame([("o1", "d1", "7|s|b")], "id string, document_id string, dedupe_key string")
    orders = spark.createDataFrame(
        [("a", "d1", "9", "S", "B", DAY[0]), ("b", "d2", "7", "s.", "b!", DAY[0]), ("c", "d3", "8", "S", "B", DAY[0]), ("d", "d4", "8", "s", "b", DAY[1]), ("e", "d5", None, "S", "B", DAY[0]), ("f", "d3", "8", "S", "B", DAY[2]), ("g", "d6", "--", "S", "B", DAY[0])],
        "id string, document_id string, po_number string, supplier_name string, buyer_name string, created_at timestamp",
    )
    items = spark.createDataFrame([("c", 5), ("c", 9), ("d", 1)], "purchase_order_id string, sequence int")
    found = st.save_orders(known, orders, items, ["created_at", "id"])
    assert told(found.outcomes, "id", "outcome", "order_id") == [
        ("a", "saved before", "o1"), ("b", "duplicate", "o1"), ("c", "created", "c"), ("d", "duplicate", "c"), ("e", "no number", None), ("f", "saved before", "c"), ("g", "no number", None),
    ]
    assert told(found.items, "purchase_order_id", "sequence") == [("c", 1), ("c", 2)] and told(found.headers, "id", "dedupe_key") == [("c", "8|s|b")]
    assert told(found.documents, "id", "status", "duplicate_of") == [("d2", "DUPLICATE", "o1"), ("d3", "SAVED", None), ("d4", "DUPLICATE", "c")]
    # again with what is known now: nothing is created twice
    again = st.save_orders(known.unionByName(found.headers.select("id", "document_id", "dedupe_key")), orders, items, ["created_at", "id"])
    assert again.headers.count() == 0


def test_status_updates_set_and_clear_errors(spark):
    state = spark.createDataFrame([(k, "X", "old") for k in "abcdef"], "id string, status string, error_message string")
    updates = spark.createDataFrame([("a", "FAILED", "bad"), ("b", "FAILED", None), ("c", "SAVED", None), ("d", "DUPLICATE", None), ("e", "IGNORED", "no file"), ("z", "SAVED", None)], "id string, status string, message string")
    assert told(st.update_status(state, updates), "id", "status", "error_message") == [
        ("a", "FAILED", "bad"), ("b", "FAILED", None), ("c", "SAVED", None), ("d", "DUPLICATE", "old"), ("e", "IGNORED", "no file"), ("f", "X", "old"),
    ]


def test_validation_told_in_one_text(spark):
    documents = spark.createDataFrame([("a", "EXTRACTED", None), ("b", "EXTRACTED", "old"), ("c", "RECEIVED", None)], "id string, status string, error_message string")
    issues = spark.createDataFrame([("a", 1, "line_items[1]", "error", "no part"), ("a", -1, "po_number", "error", "is required"), ("b", 0, "currency", "warning", "missing")], "id string, place int, field string, severity string, message string")
    stored = st.store_validation(documents, documents.where("id <> 'c'"), issues)
    assert told(stored, "id", "status", "error_message") == [("a", "FAILED", "po_number: is required; line_items[1]: no part"), ("b", "VALIDATED", "old"), ("c", "RECEIVED", None)]


def test_mail_outcomes_acknowledging_and_error_classes(spark):
    parts = spark.createDataFrame([("m1", 0, "a.pdf", "SAVED", None), ("m1", 1, None, "FAILED", "bad"), ("m2", 0, "b.pdf", "DUPLICATE", None), ("m3", 0, "c.pdf", "SAVED", None), ("m3", 1, "d.pdf", "DUPLICATE", None)], "email_id string, place int, filename string, status string, error string")
    mails = spark.createDataFrame([(f"m{k}",) for k in range(1, 5)], "id string")
    assert told(st.mail_outcomes(mails, parts), "id", "status", "message") == [("m1", "FAILED", "attachment-1: bad"), ("m2", "DUPLICATE", None), ("m3", "SAVED", None), ("m4", "IGNORED", "no PDF attachment found")]
    sent = spark.createDataFrame([("p", "1", "SAVED"), ("p", "1", "SAVED"), ("p", "2", "RECEIVED"), ("p", "3", "FAILED")], "provider string, provider_message_id string, status string")
    once = st.acknowledge(sent.limit(0), sent)
    assert told(once, "provider_message_id") == [("1",), ("3",)] == told(st.acknowledge(once, sent), "provider_message_id")
    kinds = spark.createDataFrame([("MalformedEmailError",), ("TimeoutError",), (None,)], "e string")
    assert [r[0] for r in kinds.select(st.is_permanent(F.col("e"))).collect()] == [True, False, None]


def test_steps_and_events_numbered_in_order(spark):
    log = spark.createDataFrame([(k, "m", s) for k, s in enumerate(["RECEIVED", "EMAIL_PARSED", "FAILED", "RECEIVED", "SAVED", "SAVED", "RECEIVED", "?"])] + [(99, "n", "SAVED")], "id bigint, e string, status string")
    assert [r.kind for r in st.step_kinds(log, ["e"]).orderBy("id").collect()] == ["start", "forward", "end", "restart", "end", "repeat", "illegal", "illegal", "illegal"]
    events = spark.createDataFrame([(DAY[k % 3], f"e{k:03}") for k in range(200)], "created_at timestamp, name string")
    base = spark.createDataFrame([(40, DAY[0], "first")], "id bigint, created_at timestamp, name string")
    got = [(r.id, r.name) for r in st.append_events(base, events, ["created_at", "name"]).orderBy("id").collect()]
    assert got == [(40, "first")] + [(41 + k, n) for k, (_, n) in enumerate(sorted((DAY[k % 3], f"e{k:03}") for k in range(200)))]
    assert st.append_events(base, events.limit(0), ["created_at", "name"]).count() == 1


def test_old_snapshots_are_deleted(spark, tmp_path):
    root = str(tmp_path / "s")
    for k in range(4):
        write_snapshot(spark.range(k + 1), root)
    assert read_snapshot(spark, root, "id bigint").count() == 4
    assert sum(p.is_dir() for p in (tmp_path / "s").iterdir()) == 2
