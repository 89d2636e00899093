"""WARC derivatives: response records to linked metadata and plain-text conversion records.

A response record is a row (record_id, target_uri, date, headers, block): the
named fields of the WARC record as a map and its content block, an HTTP
response. For each one two records are built: a ``metadata`` record with what is
known of the page (status, type, title, language, links) and a ``conversion``
record with its plain text. Both refer to the response by WARC-Refers-To and
repeat its target, its date and the digests and fields of the source in
``headers``; every record has a block digest of its own, conversions name the
payload digest of their source.

Ids are derived from the source's id and the record type, so building again,
also after a lost executor, gives the same records. Rows are independent: one
pass, no shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vinculo.llm.common import column, map_slices

VERSION = "WARC/1.1"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:vinculo:warc")
_CRLF = "\r\n"
RECORD = (
    "record_id string, record_type string, refers_to string, target_uri string, date string, content_type string, content_length long, "
    "block_digest string, payload_digest string, headers map<string,string>, block string"
)

#: The head with what may stand in it; its end tag may be left out, then it ends before anything else.
_HEAD = (
    r"<head(?:\s[^>]*|/)?>(?:\s+|<!--.*?(?:-->|\Z)|<![^>]*>|</?(?:meta|link|base|basefont|bgsound)\b[^>]*>"
    r"|<(?P<inner>title|script|style|noscript|template)\b(?:.*?</(?P=inner)\s*>|.*?(?=</head\b|<body\b)|.*))*(?:</head\s*>)?"
)
_DROPPED = re.compile(rf"{_HEAD}|<(?P<outer>script|style|noscript|template)\b.*?(?:</(?P=outer)\s*>|\Z)|<!--.*?(?:-->|\Z)", re.IGNORECASE | re.DOTALL)
_BREAK = re.compile(r"<(?:/?(?:p|div|h[1-6]|li|ul|ol|tr|table|section|article|main|nav|header|footer|aside|form|blockquote|pre|dd|dt)\b[^>]*|br\b[^>]*)>", re.IGNORECASE)
_TAG = re.compile(r"<[/!?a-zA-Z][^>]*>?")
_TITLE = re.compile(r"<title[^>]*>(.*?)</title", re.IGNORECASE | re.DOTALL)
_LANGUAGE = re.compile(r"<html[^>]*\blang\s*=\s*[\"']?([\w-]+)", re.IGNORECASE)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.IGNORECASE)
_LINK = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def record_uri(*parts: object) -> str:
    """A stable id of a record from the things that make it."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(31).join(map(str, parts)))}>"


def one_line(value: str) -> str:
    return " ".join(value.split())


def split_http(block: bytes) -> tuple[str, dict[str, str], bytes]:
    """Status line, lower-case header fields and payload of an HTTP response; a block without a header is all payload.

    The values of a repeated field are joined by commas, in their order.
    """
    if not block.startswith(b"HTTP/"):
        return "", {}, block
    head, found, payload = block.partition(b"\r\n\r\n")
    if not found:
        head, _, payload = block.partition(b"\n\n")
    status, *lines = head.decode("latin-1").splitlines()
    fields: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if colon:
            name, value = name.strip().lower(), value.strip()
            fields[name] = f"{fields[name]}, {value}" if name in fields else value
    return status, fields, payload


def decode_payload(fields: dict[str, str], payload: bytes) -> str:
    declared = _CHARSET.search(fields.get("content-type", "")) or _CHARSET.search(payload[:2048].decode("latin-1"))
    try:
        return payload.decode(declared[1] if declared else "utf-8", "replace")
    # Names of no charset, and codecs that can't read bytes like these or pass over errors.
    except (LookupError, ValueError):
        return payload.decode("utf-8", "replace")


def plain_text(page: str) -> str:
    """The text of all of a page but its head, scripts and styles, one line per block."""
    page = _TAG.sub("", _BREAK.sub("\n", _DROPPED.sub("\n", page)))
    return "\n".join(line for x in html.unescape(page).split("\n") if (line := one_line(x)))


def derive(record_id: str, target: str, date: str, source: dict[str, str], block: bytes) -> list[dict]:
    """The metadata and the conversion record of one response."""
    status, fields, payload = split_http(block)
    page = decode_payload(fields, payload)
    payload_digest = source.get("WARC-Payload-Digest") or digest(payload)
    title, language = _TITLE.search(page), _LANGUAGE.search(page)
    links = [html.unescape(next(filter(None, x), "")) for x in _LINK.findall(page)]
    facts = [
        ("http-status", status), ("content-type", fields.get("content-type", "")), ("payload-length", len(payload)),
        ("title", html.unescape(title[1]) if title else ""), ("language", language[1] if language else ""),
        *(("outlink", x) for x in links), ("source-payload-digest", payload_digest), ("source-block-digest", source.get("WARC-Block-Digest") or digest(block)),
    ]
    metadata = "".join(f"{name}: {one_line(str(value))}{_CRLF}" for name, value in facts)
    out = []
    for kind, content_type, text in (("metadata", "application/warc-fields", metadata), ("conversion", "text/plain; charset=utf-8", plain_text(page))):
        raw = text.encode("utf-8", "replace")
        headers = {f"Source-{k.removeprefix('WARC-')}": v for k, v in source.items() if v is not None}
        headers |= {f"Source-HTTP-{k}": v for k, v in fields.items()}
        out.append({
            "record_id": record_uri(kind, record_id), "record_type": kind, "refers_to": record_id, "target_uri": target, "date": date,
            "content_type": content_type, "content_length": len(raw), "block_digest": digest(raw), "payload_digest": payload_digest,
            "headers": list(headers.items()), "block": text,
        })
    return out


def derivatives(responses: DataFrame) -> DataFrame:
    """Two records of each response (record_id, target_uri, date, headers, block), in the columns of ``RECORD``.

    A null or empty block gives a conversion record with an empty text; null
    targets, dates and headers count as empty. A null id gets one derived from
    target, date and block, so no record refers to nothing. Repeated rows give
    repeated records with the same ids. Other columns are not read; an empty
    table gives no rows.
    """
    kinds = {"record_id": pa.string(), "record_type": pa.string(), "refers_to": pa.string(), "target_uri": pa.string(), "date": pa.string(), "content_type": pa.string(),
             "content_length": pa.int64(), "block_digest": pa.string(), "payload_digest": pa.string(), "headers": pa.map_(pa.string(), pa.string()), "block": pa.string()}

    def make():
        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for record, target, date, headers, block in zip(*(column(part, c).to_pylist() for c in ("record_id", "target_uri", "date", "headers", "block")), strict=True):
                block = block or b""
                record = record or record_uri("response", target or "", date or "", digest(block))
                rows += derive(record, target or "", date or "", dict(headers or []), block)
            return pa.RecordBatch.from_pylist(rows, schema=pa.schema(list(kinds.items())))

        return one

    wanted = responses.select("record_id", "target_uri", "date", "headers", F.col("block").cast("binary").alias("block"))
    return map_slices(wanted, make, RECORD, "block", 1 << 20)


def _sha1_base32(data: Column) -> Column:
    """``sha1:`` and the base-32 digest: each five hexadecimal digits are four letters."""
    letters = F.array(*[F.lit(x) for x in "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"])
    value = lambda k: F.conv(F.substring(F.sha1(data), 5 * (k // 4) + 1, 5), 16, 10).cast("int")
    parts = [F.element_at(letters, F.shiftright(value(k), 15 - 5 * (k % 4)).bitwiseAND(31) + 1) for k in range(32)]
    return F.concat(F.lit("sha1:"), *parts)


def responses_of_pages(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of a table (page_id, url, html), as a crawler would have written them on ``date``."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "), F.octet_length(body).cast("string"), F.lit(_CRLF + _CRLF))
    block = F.concat(F.encode(head, "UTF-8"), body)
    name = F.md5(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit(""))))
    cut = [F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    record = F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))
    rows = pages.select("page_id", "url", block.alias("block"), body.alias("body"), record.alias("record_id"))
    fields = F.create_map(
        F.lit("WARC-Type"), F.lit("response"), F.lit("WARC-Record-ID"), F.col("record_id"), F.lit("WARC-Target-URI"), F.coalesce("url", F.lit("")),
        F.lit("WARC-Date"), F.lit(date), F.lit("WARC-Payload-Digest"), _sha1_base32(F.col("body")), F.lit("WARC-Block-Digest"), _sha1_base32(F.col("block")),
        F.lit("Content-Type"), F.lit("application/http; msgtype=response"), F.lit("Content-Length"), F.octet_length("block").cast("string"),
    )
    return rows.select("page_id", "record_id", F.col("url").alias("target_uri"), F.lit(date).alias("date"), fields.alias("headers"), "block")


def record_bytes(records: DataFrame) -> DataFrame:
    """Add ``warc``: each record as it stands in a WARC file, so that files are these bytes one after another."""
    line = lambda name, value: F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF))).otherwise(F.lit(""))
    kept = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"], F.lit(_CRLF)))), "")
    head = F.concat(
        F.lit(VERSION + _CRLF), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", F.col("record_id")), line("WARC-Refers-To", F.col("refers_to")),
        line("WARC-Target-URI", F.col("target_uri")), line("WARC-Date", F.col("date")), line("WARC-Block-Digest", F.col("block_digest")),
        line("WARC-Payload-Digest", F.when(F.col("record_type") != "metadata", F.col("payload_digest"))), kept,
        line("Content-Type", F.col("content_type")), line("Content-Length", F.col("content_length").cast("string")), F.lit(_CRLF),
    )
    return records.withColumn("warc", F.concat(F.encode(head, "UTF-8"), F.encode(F.coalesce("block", F.lit("")), "UTF-8"), F.encode(F.lit(_CRLF * 2), "UTF-8")))
