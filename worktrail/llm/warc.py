"""WARC derivatives: metadata and plain-text conversion records of response records.

Each response yields two linked records. Both refer to the response's identifier, keep its
target, date and digests, and carry digests of their own; identifiers are derived from the
source's, so a task that runs again makes the same records.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktrail.llm.words import plus, settle

#: Elements without text, and elements that end a line.
_SILENT = "script style noscript template svg iframe"
_LINES = (
    "address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main "
    "menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul"
)
#: Up to a tag's end. An open angle outside of quotes ends it too, so that no character is read
#: again for every tag that is never closed.
_ATTRIBUTES = r"""(?:[^<>"']|"[^"]*"|'[^']*')*+"""
_MARKUP = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<silent>{'|'.join(_SILENT.split())})\b{_ATTRIBUTES}>.*?(?:</(?P=silent)\s*>|\Z)|</?(?P<tag>[a-z][a-z0-9]*){_ATTRIBUTES}>|<[!?][^<>]*>", re.S | re.I
)
_LINE_ENDS = frozenset(_LINES.split())
_TITLE = re.compile(rf"<title\b{_ATTRIBUTES}>(.*?)(?:</title\s*>|\Z)", re.S | re.I)
_LINK = re.compile(r"""<a\b(?:[^<>"']|"[^"]*"|'[^']*')*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_CHARSET = re.compile(rb"""<meta[^>]+?charset\s*=\s*["']?([A-Za-z0-9_-]+)""", re.I)

RESPONSE = "record_id string, target_uri string, date string, block binary, block_digest string, payload_digest string"
DERIVED = (
    "record_id string, warc_type string, refers_to string, target_uri string, date string, content_type string, "
    "source_block_digest string, source_payload_digest string, block string, block_digest string, content_length long"
)


#: Numbers of characters that no text has; the longest can't be read as numbers either.
_FAR = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{7,});?")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def identifier(*of: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, json.dumps(of))}>"


def _unescaped(text: str) -> str:
    return html.unescape(_FAR.sub("\ufffd", text))


def visible_text(page: str) -> str:
    """The text of an HTML page, a line per block element, blanks collapsed."""

    def replaced(m: re.Match) -> str:
        return "\n" if (m["tag"] or "").lower() in _LINE_ENDS else " " if m["silent"] else ""

    flat = _unescaped(_MARKUP.sub(replaced, re.sub(r"[\r\n]+", " ", page)))
    lines = (" ".join(line.split()) for line in flat.split("\n"))
    return "\n".join(line for line in lines if line)


def _split(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers in order and payload of an HTTP message."""
    head, _, body = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("latin-1").split("\r\n")
    return status, [(n.strip(), v.strip()) for n, _, v in (x.partition(":") for x in lines if x)], body


def _decoded(headers: list[tuple[str, str]], body: bytes) -> str:
    kind = next((v for n, v in headers if n.lower() == "content-type"), "")
    named = re.search(r"charset\s*=\s*\"?([\w-]+)", kind, re.I)
    found = _CHARSET.search(body[:2048])
    name = named[1] if named else found[1].decode() if found else "utf-8"
    try:
        return body.decode(name, "replace")
    except (LookupError, ValueError):
        return body.decode("utf-8", "replace")


def derive_one(record_id: str, target: str | None, date: str | None, block: bytes, block_digest: str | None, payload_digest: str | None) -> list[tuple]:
    """The two derived records of one response."""
    status, headers, body = _split(block)
    page = _decoded(headers, body)
    title = _TITLE.search(page)
    sums = digest(block), digest(body)
    envelope = {
        "http-status": status,
        "http-headers": headers,
        "payload-length": len(body),
        "payload-digest": sums[1],
        "digests-agree": all(old is None or old == new for old, new in zip((block_digest, payload_digest), sums, strict=True)),
        "title": " ".join(_unescaped(_MARKUP.sub("", title[1])).split()) if title else None,
        "links": [_unescaped(a or b or c) for a, b, c in _LINK.findall(page)],
    }
    out = []
    for kind, media, text in (("metadata", "application/json", json.dumps(envelope, ensure_ascii=False)), ("conversion", "text/plain; charset=utf-8", visible_text(page))):
        raw = text.encode("utf-8", "replace")
        out.append((identifier(kind, record_id), kind, record_id, target, date, media, block_digest or sums[0], payload_digest or sums[1], raw.decode(), digest(raw), len(raw)))
    return out


def _rows(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)


def responses(pages: DataFrame, date: str, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Response records (key and RESPONSE columns) of a table of pages fetched at ``date``.

    A null page has an empty payload, a null url stays null. Rows equal in key, url and page
    are the same record and get the same identifier; null keys are a value like others.
    """
    settle(pages.sparkSession)
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(page).alias("page"))
    names = ["key", *[c.split()[0] for c in RESPONSE.split(", ")]]

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, u, p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                body = (p or "").encode()
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
                out.append((k, identifier("response", k, u, digest(body)), u, date, block, digest(block), digest(body)))
            yield _rows(out, names, [batch.schema.field("key").type, pa.string(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.string()])

    return rows.mapInArrow(tasks, plus(rows.select("key").schema, RESPONSE)).withColumnRenamed("key", key)


def derivatives(records: DataFrame) -> DataFrame:
    """Two rows, metadata and conversion, per response record: the columns of ``records`` that
    aren't RESPONSE columns or clash with DERIVED ones, then DERIVED.

    Digests that a response brings along are kept as they are; missing ones are computed, and
    the metadata say whether they agree with the block. A null block is an empty message; a
    record without an identifier can't be referred to and yields nothing. Repeated records
    yield equal rows each.
    """
    settle(records.sparkSession)
    own = [c.split()[0] for c in RESPONSE.split(", ")]
    names = [c.split()[0] for c in DERIVED.split(", ")]
    rest = [c for c in records.columns if c not in own and c not in names]
    types = [pa.string()] * (len(names) - 1) + [pa.int64()]

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.select(rest)
            source, out = [], []
            for i, row in enumerate(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in own), strict=True)):
                if row[0] is not None:
                    made = derive_one(*row[:3], row[3] or b"", *row[4:])
                    source += [i] * len(made)
                    out += made
            new = _rows(out, names, types)
            at = pa.array(source, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in kept.columns), *new.columns], names=[*rest, *names])

    return records.select(*rest, *own).mapInArrow(tasks, plus(records.select(*rest).schema, DERIVED))


def record_text() -> Column:
    """A derived row as WARC record text: header lines, an empty line, the block."""
    fields = [
        ("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"),
        ("WARC-Source-Block-Digest", "source_block_digest"), ("WARC-Source-Payload-Digest", "source_payload_digest"),
        ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"),
    ]
    lines = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{n}: "), F.regexp_replace(F.col(c).cast("string"), r"[\r\n]+", " "))) for n, c in fields]
    return F.concat(F.concat_ws("\r\n", F.lit("WARC/1.1"), *lines), F.lit("\r\n\r\n"), F.col("block"))


def write_warc(derived: DataFrame, path: str, compression: str = "gzip") -> None:
    """WARC files of all records, one file per task."""
    derived.select(record_text()).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)
