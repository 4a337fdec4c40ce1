"""RFC 822 messages: scan, decode, attachments, keys.

Only the MIME tree is read in Python (Arrow batches); everything after it is Column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from email import policy
from email.parser import BytesParser
from email.utils import getaddresses, parsedate_to_datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderloom.functions.text import ColumnLike, blank_to_null, clean_text, col, normalize_email, strip

MIME_STRUCT = (
    "struct<status:string,message_id:string,references:string,subject:string,sender_name:string,sender_email:string,to:array<string>,cc:array<string>,"
    "sent_at:string,body:string,body_type:string,attachments:array<struct<index:int,filename:string,mime_type:string,content:binary>>>"
)


def _addresses(message: object, header: str) -> list[tuple[str, str]]:
    return [(n, a) for n, a in getaddresses([str(v) for v in message.get_all(header, [])]) if a]


def _decoded(part: object) -> str:
    try:
        return part.get_content()
    except (LookupError, UnicodeError, KeyError, ValueError):
        return (part.get_payload(decode=True) or b"").decode("utf-8", errors="replace")


def read_message(raw: bytes | None) -> dict:
    """Fields of one message; status tells an empty or headerless one from a good one."""
    none = dict.fromkeys(("message_id", "references", "subject", "sender_name", "sender_email", "to", "cc", "sent_at", "body", "body_type", "attachments"))
    if raw is None or not raw.strip():
        return {"status": "empty", **none}
    message = BytesParser(policy=policy.default).parsebytes(raw)
    if not message.keys():
        return {"status": "no headers", **none}
    name, address = (_addresses(message, "From") or [("", "")])[0]
    try:
        sent = parsedate_to_datetime(str(message["Date"])).isoformat() if message["Date"] else None
    except (TypeError, ValueError):
        sent = None
    part = message.get_body(preferencelist=("plain", "html"))
    files = [
        {"index": i, "filename": p.get_filename(), "mime_type": p.get_content_type(), "content": p.get_payload(decode=True) or b""}
        for i, p in enumerate(message.iter_attachments())
    ]
    return {
        "status": "ok", "message_id": str(message["Message-ID"]).strip() if message["Message-ID"] else None, "references": str(message["References"] or ""),
        "subject": str(message["Subject"]) if message["Subject"] else None, "sender_name": name, "sender_email": address,
        "to": [a for _, a in _addresses(message, "To")], "cc": [a for _, a in _addresses(message, "Cc")], "sent_at": sent,
        "body": _decoded(part) if part is not None else None, "body_type": part.get_content_type() if part is not None else None, "attachments": files,
    }


def html_to_text(c: ColumnLike) -> Column:
    """Scripts and styles to a blank, breaks and block ends to line feeds, other tags to blanks; entities stay."""
    bare = F.regexp_replace(F.regexp_replace(col(c), r"(?is)<script.*?</script>", " "), r"(?is)<style.*?</style>", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"(?i)<br\s*/?>|</p>|</div>", "\n"), r"<[^>]+>", " ")


def content_key(content: ColumnLike) -> Column:
    """SHA-256 of bytes, hexadecimal."""
    return F.sha2(col(content), 256)


def message_key(header: ColumnLike, content: ColumnLike) -> Column:
    """Id of a message: its header without brackets, else from its bytes."""
    bare = blank_to_null(F.regexp_replace(strip(header), r"^[<>]+|[<>]+$", ""))
    return F.coalesce(bare, F.concat(F.lit("sha256-"), F.left(content_key(content), F.lit(32))))


def storage_key(provider: ColumnLike, message_id: ColumnLike) -> Column:
    return F.left(F.sha2(F.concat_ws(":", col(provider), col(message_id)), 256), F.lit(32))


def workflow_key(provider: ColumnLike, message_id: ColumnLike) -> Column:
    """Readable, bounded and unique key of a message's processing."""
    safe = F.left(F.regexp_replace(col(message_id), r"[^A-Za-z0-9._@-]+", "_"), F.lit(120))
    return F.concat(F.lit("po-email-"), col(provider), F.lit("-"), safe, F.lit("-"), F.left(F.sha2(col(message_id), 256), F.lit(8)))


def safe_name(c: ColumnLike) -> Column:
    """File name of safe characters, at most 120."""
    plain = F.regexp_replace(F.regexp_replace(col(c), r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")
    return F.coalesce(blank_to_null(F.left(plain, F.lit(120))), F.lit("file"))


def is_pdf(mime_type: ColumnLike, filename: ColumnLike) -> Column:
    return (F.lower(F.coalesce(col(mime_type), F.lit(""))) == "application/pdf") | F.lower(F.coalesce(col(filename), F.lit(""))).endswith(".pdf")


def scan_messages(spark: SparkSession, folder: str, provider: str = "local", limit: int | None = None) -> DataFrame:
    """provider, path, content, provider_message_id of the .eml files of a folder; of one id the first path counts."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").load(folder).select("path", "content")
    parsed = with_mime(files.withColumn("provider", F.lit(provider)))
    keyed = parsed.withColumn("provider_message_id", message_key("mime.message_id", "content"))
    first = F.row_number().over(Window.partitionBy("provider_message_id").orderBy("path"))
    kept = keyed.withColumn("n", first).where("n = 1").drop("n")
    return kept.orderBy("path").limit(limit) if limit else kept


def fetch(pending: DataFrame, processed: DataFrame, message_id: str) -> DataFrame:
    """The message of an id, from the pending ones before the processed ones; no row if there is none."""
    both = pending.withColumn("_rank", F.lit(0)).unionByName(processed.withColumn("_rank", F.lit(1)))
    return both.where(F.col("provider_message_id") == message_id).orderBy("_rank").limit(1).drop("_rank")


def with_mime(raw: DataFrame, content: str = "content") -> DataFrame:
    """Adds ``mime``, the decoded message."""

    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for contents in batches:
            yield pd.DataFrame([read_message(bytes(c) if c is not None else None) for c in contents])

    return raw.withColumn("mime", F.pandas_udf(decode, MIME_STRUCT)(content))


def metadata(messages: DataFrame, native_thread: str | None = None) -> DataFrame:
    """One row per decoded message with clean metadata; malformed ones keep their row with error_type set."""
    m = lambda f: F.col(f"mime.{f}")
    valid = lambda a: F.filter(F.transform(a, normalize_email), lambda e: e.isNotNull())
    root = F.get(F.split(F.trim(m("references")), r"\s+"), F.lit(0))
    thread = F.coalesce(*([F.col(native_thread)] if native_thread else []), blank_to_null(root), m("message_id"))
    body = F.when(m("body_type") == "text/html", html_to_text(m("body"))).otherwise(m("body"))
    info = F.transform(m("attachments"), lambda a: F.struct(a["index"].alias("index"), a["filename"].alias("filename"), a["mime_type"].alias("mime_type"), F.octet_length(a["content"]).cast("bigint").alias("size_bytes")))
    return messages.select(
        "provider", "provider_message_id", m("message_id").alias("internet_message_id"), thread.alias("thread_id"), normalize_email(m("sender_email")).alias("sender_email"),
        blank_to_null(strip(m("sender_name"))).alias("sender_name"), valid(m("to")).alias("recipient_emails"), valid(m("cc")).alias("cc_emails"), clean_text(m("subject")).alias("subject"),
        m("sent_at").try_cast("timestamp").alias("received_at"), clean_text(body).alias("email_body"), info.alias("attachments"),
        F.when(m("status") != "ok", "MalformedEmail").alias("error_type"),
    )


def attachments(messages: DataFrame) -> DataFrame:
    """One row per attachment with its bytes' hash; the bytes themselves stay out of later shuffles."""
    files = messages.select("provider", "provider_message_id", F.explode("mime.attachments").alias("a"))
    name = F.coalesce("a.filename", F.concat(F.lit("attachment-"), F.col("a.index").cast("string"), F.lit(".pdf")))
    return files.select(
        "provider", "provider_message_id", F.col("a.index").alias("attachment_index"), name.alias("filename"), "a.mime_type", F.octet_length("a.content").cast("bigint").alias("size_bytes"),
        content_key("a.content").alias("file_hash"), is_pdf("a.mime_type", "a.filename").alias("is_pdf"), F.col("a.content").alias("content"),
    )


def attachment(messages: DataFrame, index: int) -> DataFrame:
    """Attachment ``index`` of each message; error_type says where there is none."""
    rows = messages.select("provider", "provider_message_id", F.get("mime.attachments", F.lit(index)).alias("a"))
    return rows.select("provider", "provider_message_id", "a.filename", "a.mime_type", "a.content", F.when(F.col("a").isNull(), "AttachmentNotFound").alias("error_type"))


def render_messages(emails: DataFrame) -> DataFrame:
    """Raw messages made from stored mails, to decode again: UTF-8 text by base64, parts for the attachments that the mail lists.

    An attachment's bytes are ``content of {id}/{place}``; one without a file name has none in its headers either.
    """
    based = lambda c: F.regexp_replace(F.base64(F.encode(c, "UTF-8")), r"[\r\n]", "")
    word = lambda c: F.concat(F.lit("=?utf-8?B?"), based(c), F.lit("?="))
    listed = F.from_json("attachments", "array<struct<index:int,filename:string,mime_type:string>>")
    files = F.coalesce(listed, F.array().cast("array<struct<index:int,filename:string,mime_type:string>>"))
    named = lambda a: F.when(a["filename"].isNotNull(), F.concat(F.lit('; filename="'), a["filename"], F.lit('"'))).otherwise(F.lit(""))
    text = F.concat(F.lit("Content-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: base64\r\n\r\n"), based(F.coalesce("email_body", F.lit(""))))
    part = lambda a, k: F.concat(
        F.lit("--=part\r\nContent-Type: "), F.coalesce(a["mime_type"], F.lit("application/octet-stream")), F.lit("\r\nContent-Disposition: attachment"), named(a),
        F.lit("\r\nContent-Transfer-Encoding: base64\r\n\r\n"), based(F.concat(F.lit("content of "), F.col("id"), F.lit("/"), k.cast("string"))),
    )
    parts = F.concat(F.lit("Content-Type: multipart/mixed; boundary=\"=part\"\r\n\r\n--=part\r\n"), text, F.lit("\r\n"), F.array_join(F.transform("_files", part), "\r\n"), F.lit("\r\n--=part--\r\n"))
    lines = [
        F.concat(F.lit("Message-ID: "), F.coalesce("internet_message_id", F.concat(F.lit("<"), "id", F.lit("@none>")))), F.when(F.col("thread_id").isNotNull(), F.concat(F.lit("References: "), "thread_id")),
        F.concat(F.lit("From: "), F.when(F.length(F.trim("sender_name")) > 0, word(F.col("sender_name"))).otherwise(F.lit("")), F.lit(" <"), F.col("sender_email"), F.lit(">")),
        F.concat(F.lit("To: "), F.array_join("recipient_email", ", ")), F.when(F.size("cc") > 0, F.concat(F.lit("Cc: "), F.array_join("cc", ", "))),
        F.concat(F.lit("Date: "), F.date_format("created_at", "d MMM yyyy HH:mm:ss"), F.lit(" +0000")), F.when(F.length(F.trim("subject")) > 0, F.concat(F.lit("Subject: "), word(F.col("subject")))),
        F.lit("MIME-Version: 1.0"), F.when(F.size("_files") > 0, parts).otherwise(text),
    ]
    rows = emails.withColumn("_files", files)
    return rows.select("id", "provider", "provider_message_id", F.encode(F.concat_ws("\r\n", *lines), "UTF-8").alias("content"))


PROVIDERS = {"local": scan_messages}


def provider(name: str):
    """Scan function of a registered mail provider."""
    if name not in PROVIDERS:
        raise ValueError(f"unknown mail provider {name!r}; known are {sorted(PROVIDERS)}")
    return PROVIDERS[name]


