import hashlib

import pytest

from orderloom.sources import mime
from orderloom.sources.documents import parse_documents, read_golden, read_snapshot, write_snapshot

PLAIN = b"From: Jane Buyer <Jane@X.org>\r\nTo: a@b.de, Bad, C <c@d.de>\r\nCc: E@F.de\r\nSubject: =?utf-8?q?Gr=C3=BC=C3=9Fe?=  now\r\nDate: Thu, 15 Jan 2026 10:00:00 +0100\r\nMessage-ID: <m1@x>\r\nReferences: <r0@x> <r1@x>\r\n\r\nHello  there\r\n\r\nBye\r\n"
MIXED = (
    b'From: x@y.de\nSubject: s\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="b"\n\n--b\nContent-Type: text/html; charset=utf-8\n\n<p>Hi<br>you</p><script>x</script>\n'
    b'--b\nContent-Type: application/octet-stream; name="A.PDF"\nContent-Disposition: attachment; filename="A.PDF"\nContent-Transfer-Encoding: base64\n\naGVsbG8=\n--b\nContent-Type: text/csv\nContent-Disposition: attachment\n\n1,2\n--b--\n'
)


@pytest.fixture
def folder(tmp_path):
    for name, content in (("a.eml", PLAIN), ("b.eml", MIXED), ("c.eml", PLAIN), ("d.eml", b"  \n"), ("e.eml", b"no header at all"), ("x.txt", PLAIN)):
        (tmp_path / name).write_bytes(content)
    return str(tmp_path)


def test_scan_first_path_wins(spark, folder):
    found = mime.scan_messages(spark, folder).orderBy("path").collect()
    assert [r.path[-5] for r in found] == ["a", "b", "d", "e"]
    assert found[0].provider_message_id == "m1@x" and found[1].provider_message_id == "sha256-" + hashlib.sha256(MIXED).hexdigest()[:32]
    assert mime.scan_messages(spark, folder, limit=2).count() == 2
    assert mime.provider("local") is mime.scan_messages
    with pytest.raises(ValueError, match="unknown mail provider"):
        mime.provider("pigeon")


def test_metadata(spark, folder):
    rows = {r.provider_message_id: r for r in mime.metadata(mime.scan_messages(spark, folder)).collect()}
    r = rows["m1@x"]
    assert (r.internet_message_id, r.thread_id, r.sender_email, r.sender_name) == ("<m1@x>", "<r0@x>", "jane@x.org", "Jane Buyer")
    assert (r.recipient_emails, r.cc_emails, r.subject, r.email_body) == (["a@b.de", "c@d.de"], ["e@f.de"], "Grüße now", "Hello there\nBye")
    assert str(r.received_at) == "2026-01-15 09:00:00" or r.received_at.isoformat().startswith("2026-01-15")
    mixed = next(x for x in rows.values() if x.sender_email == "x@y.de")
    assert mixed.email_body == "Hi\nyou" and [(a["index"], a.filename, a.size_bytes) for a in mixed.attachments] == [(0, "A.PDF", 5), (1, None, 3)]
    assert sorted(x.error_type or "" for x in rows.values()) == ["", "", "MalformedEmail", "MalformedEmail"]


def test_attachments(spark, folder):
    messages = mime.scan_messages(spark, folder)
    found = mime.attachments(messages).orderBy("attachment_index").collect()
    assert [(r.filename, r.is_pdf, r.file_hash) for r in found] == [("A.PDF", True, hashlib.sha256(b"hello").hexdigest()), ("attachment-1.pdf", False, hashlib.sha256(b"1,2").hexdigest())]
    one = mime.attachment(messages, 0).collect()
    assert [bytes(r.content) for r in one if r.content is not None] == [b"hello"] and sum(r.error_type == "AttachmentNotFound" for r in one) == 3
    assert {r.error_type for r in mime.attachment(messages, -1).collect()} == {"AttachmentNotFound"}


def test_fetch_order(spark, folder):
    messages = mime.scan_messages(spark, folder).select("provider_message_id", "path")
    assert mime.fetch(messages.limit(0), messages, "m1@x").count() == 1 and mime.fetch(messages, messages, "none").count() == 0


def test_names_and_keys(apply):
    assert apply(mime.safe_name, ["a b/ü.pdf", "..", "x" * 200, None]) == ["a_b_.pdf", "file", "x" * 120, "file"]
    digest = hashlib.sha256(b"id 1").hexdigest()[:8]
    assert apply(lambda c: mime.workflow_key(c, c), ["id 1"]) == [f"po-email-id 1-id_1-{digest}"]
    assert apply(mime.html_to_text, ["a<STYLE>x\n</STYLE>b<br/>c</P>d&amp;<i>e"]) == ["a b\nc\nd&amp; e"]


def test_parsers(spark):
    files = spark.createDataFrame([(1, b"one\n\na\tb\nc\td"), (2, b""), (3, b"\xff\xfe")], "id int, content binary")
    found = {r.id: r for r in parse_documents(files, "text").collect()}
    assert found[1].text_blocks == ["one"] and found[1].tables[0].rows == [["a", "b"], ["c", "d"]]
    assert found[2].error_type == "DocumentParse" and found[3].error_type is None
    with pytest.raises(ValueError, match="unknown document parser"):
        parse_documents(files, "magic")


def test_snapshot_and_golden(spark, tmp_path):
    root = str(tmp_path / "t")
    assert read_snapshot(spark, root, "a int").count() == 0
    write_snapshot(spark.range(3).selectExpr("cast(id as int) a"), root)
    write_snapshot(read_snapshot(spark, root, "a int").where("a > 0"), root)
    assert sorted(r.a for r in read_snapshot(spark, root, "a int").collect()) == [1, 2]
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "x.json").write_text('{\n"a": "1.50"}')
    assert read_golden(spark, str(tmp_path / "g"), "a string").first().a == "1.50"
