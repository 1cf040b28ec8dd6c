"""WARC derivatives: metadata and plain-text conversion records of responses.

Response records are read from WARC data, files or bytes in a column. Each gives two records that
refer to it: `metadata` (warc-fields: the digests of the response, what the server's headers and
the page's head say, and the page's links) and `conversion` (the page's text). Record ids follow
from the response's id and the record's type, so that a lost task that runs again makes the same
records; dates, source headers and the response's digests are carried over.
"""

from __future__ import annotations

import base64
import contextlib
import gzip
import hashlib
import html
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plenara.llm.common import add_columns, table, without

#: Names and line ends of the WARC 1.1 format.
VERSION, END = "WARC/1.1", "\r\n"
#: The date of records whose response has none, as a record must have one.
NO_DATE = "1970-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg)\b[^<>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_TAG = r"""(?:(?:[^<>"']|"[^"<]*"|'[^'<]*')*+>|[^<>]*>)"""
_BLOCK = re.compile(rf"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|td|th|title|tr|ul)\b{_TAG}", re.I)
_ANY = re.compile(rf"<[/!?a-zA-Z]{_TAG}")
_TITLE = re.compile(r"<title\b[^<>]*>(.*?)(?:</title|\Z)", re.S | re.I)
_LANG = re.compile(r"""<html\b[^<>]*?\blang\s*=\s*["']?([A-Za-z0-9-]+)""", re.I)
_HREF = re.compile(r"""<a\b[^<>]*?\bhref\s*=\s*(?:"([^"<]*)"|'([^'<]*)'|([^\s"'<>]+))""", re.I)

#: Bytes of blocks after which rows that were made of them are handed on.
_HAND_ON = 4 << 20
RECORD = "response_id string, record_type string, record_id string, target_uri string, headers string, block binary, block_digest string, refers_to_digest string"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(0).join(parts))}>"


def text_of(page: str) -> str:
    """The text of a page: one line for each block that has words, white space collapsed."""
    shown = _ANY.sub("", _BLOCK.sub("\n", _HIDDEN.sub(" ", page)))
    lines = (" ".join(line.split()) for line in html.unescape(shown).split("\n"))
    return "\n".join(line for line in lines if line)


def fields_of(page: str, url: str, http: str, source: tuple[str, str]) -> str:
    """The warc-fields of a metadata record."""
    clean = lambda s: " ".join(s.split())
    status, _, rest = http.partition("\r\n")
    out = [("refers-to-payload-digest", source[0]), ("refers-to-block-digest", source[1])]
    out += [("http-status", clean(status))] if status else []
    out += [(f"http-{name.strip().lower()}", clean(value)) for name, colon, value in (line.partition(":") for line in rest.split("\r\n")) if colon]
    visible = _HIDDEN.sub(" ", page)
    if m := _TITLE.search(visible):
        out.append(("title", clean(html.unescape(_ANY.sub("", m[1])))))
    if m := _LANG.search(visible):
        out.append(("language", m[1].lower()))
    for m in _HREF.finditer(visible):
        target = html.unescape(m[1] or m[2] or m[3] or "").strip()
        try:
            out.append(("outlink", clean(f"{urljoin(url, target)} A/@href")))
        except ValueError:
            out.append(("outlink", clean(f"{target} A/@href")))
    return "".join(f"{name}: {value}{END}" for name, value in out)


def derived(kind: str, response_id: str, url: str, date: str, content_type: str, block: bytes, source: tuple[str, str]) -> dict:
    payload, block_of_response = source
    named = [
        ("WARC-Type", kind), ("WARC-Record-ID", record_id(response_id, kind)), ("WARC-Date", date or NO_DATE), ("WARC-Target-URI", url), ("WARC-Refers-To", response_id),
        ("WARC-Refers-To-Target-URI", url), ("WARC-Refers-To-Date", date), ("X-Refers-To-Payload-Digest", payload), ("X-Refers-To-Block-Digest", block_of_response),
        ("WARC-Block-Digest", digest(block)), ("Content-Type", content_type), ("Content-Length", str(len(block))),
    ]
    headers = VERSION + END + "".join(f"{k}: {' '.join(v.split())}{END}" for k, v in named if v)
    return {"response_id": response_id, "record_type": kind, "record_id": named[1][1], "target_uri": url, "headers": headers, "block": block, "block_digest": named[9][1], "refers_to_digest": payload}


def derivatives(responses: DataFrame) -> DataFrame:
    """The metadata and conversion records of `responses`, with the other columns of each response.

    `responses` has response_id, target_uri, date, http (status line and header lines, joined
    by CRLF, without the blank line) and payload (the page), as `read_responses` gives them, and
    payload_digest and block_digest as the response's record names them; where it doesn't, they
    are computed over what it says. Nulls are empty; a response without id gets one from its
    address, date and payload, so that equal responses get equal ids, and repeated rows and ties
    give repeated records; one without a date gives records of NO_DATE. An empty page gives a
    conversion record without text; a very long one is taken whole, in one pass over it. Columns
    named like those of a record are replaced.
    """
    for name in ("payload_digest", "block_digest"):
        if name not in responses.columns:
            responses = responses.withColumn(name, F.lit(""))
    schema = T.DataType.fromDDL(RECORD)
    inputs = ["response_id", "target_uri", "date", "http", "payload", "payload_digest", "block_digest"]
    taken = {n.lower() for n in (*inputs, *schema.fieldNames())}
    others = [c for c in responses.columns if c.lower() not in taken]
    kept = T.StructType([f for f in responses.schema.fields if f.name in others])
    frame = responses.select(*others, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in inputs])
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                rows, owner = [], []
                columns = [batch.column(len(others) + k).to_pylist() for k in range(len(inputs))]
                for i, (rid, url, date, http, page, *named) in enumerate(zip(*columns, strict=True)):
                    payload = page.encode("utf-8", "replace")
                    source = named[0] or digest(payload), named[1] or digest(http.encode("utf-8", "replace") + b"\r\n\r\n" + payload)
                    rid = rid or record_id("response", url, date, source[0])
                    rows.append(derived("metadata", rid, url, date, "application/warc-fields", fields_of(page, url, http, source).encode("utf-8", "replace"), source))
                    rows.append(derived("conversion", rid, url, date, "text/plain; charset=utf-8", text_of(page).encode("utf-8", "replace"), source))
                    owner += [i, i]
                taken_ = batch.select(list(range(len(others)))).take(pa.array(owner, pa.int64())) if others else None
                arrays = [taken_.column(k) for k in range(len(others))] + [pa.array([r[f.name] for r in rows], f.type) for f in target]
                yield pa.RecordBatch.from_arrays(arrays, names=[*others, *target.names])

    return frame.mapInArrow(run, T.StructType([*kept.fields, *schema.fields]))


def _named(head: bytes) -> dict[str, str]:
    """Header lines as a dict by lower-case name; a line that begins with a blank goes on with the one before."""
    out: dict[str, str] = {}
    last = ""
    for line in head.decode("utf-8", "replace").split("\n"):
        name, colon, value = line.rstrip("\r").partition(":")
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif colon:
            last = name.strip().lower()
            out[last] = value.strip()
    return out


def records_in(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the WARC records that a binary file object holds one after the other; a record that is cut off ends them."""
    while True:
        line = source.readline()
        while line in (b"\r\n", b"\n"):
            line = source.readline()
        if not line.startswith(b"WARC/"):
            return
        head = []
        while (line := source.readline()) not in (b"\r\n", b"\n", b""):
            head.append(line)
        named = _named(b"".join(head))
        if not line or not named.get("content-length", "").isdigit():
            return
        size = int(named["content-length"])
        block = source.read(size)
        if len(block) < size:
            return
        yield named, block


def _dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        size = body[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size) or not int(size, 16):
            break
        out.append(body[end + 2 : end + 2 + int(size, 16)])
        at = end + 2 + int(size, 16) + 2
    return b"".join(out) if out else body


_CHARSET = re.compile(r"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.I)


def response_of(named: dict[str, str], block: bytes) -> dict:
    """The columns of a response, from its record: the payload is unpacked and decoded as its HTTP headers say."""
    head, _, body = block.partition(b"\r\n\r\n")
    http = _named(head.partition(b"\n")[2])
    if "chunked" in http.get("transfer-encoding", "").lower():
        body = _dechunked(body)
    if http.get("content-encoding", "").lower() in ("gzip", "x-gzip", "deflate"):
        with contextlib.suppress(zlib.error):
            body = zlib.decompress(body, 47)
    said = _CHARSET.search(http.get("content-type", ""))
    try:
        page = body.decode(said[1] if said else "utf-8", "replace")
    except LookupError:
        page = body.decode("utf-8", "replace")
    return {
        "response_id": named.get("warc-record-id", ""), "target_uri": named.get("warc-target-uri", ""), "date": named.get("warc-date", ""), "http": head.decode("utf-8", "replace"),
        "payload": page, "payload_digest": named.get("warc-payload-digest", ""), "block_digest": named.get("warc-block-digest", ""),
    }


RESPONSE = "response_id string, target_uri string, date string, http string, payload string, payload_digest string, block_digest string"


def read_responses(data: DataFrame, content: str = "content") -> DataFrame:
    """The responses in a column of WARC bytes, plain or gzip (record by record or whole), with the other columns of each row.

    Records of other types, and what isn't WARC, give no rows; null and empty bytes hold none.
    Columns named like those of a response are replaced.
    """
    schema = T.DataType.fromDDL(RESPONSE)
    data = without(data, schema.fieldNames())
    others = [c for c in data.columns if c != content]
    kept = T.StructType([f for f in data.schema.fields if f.name in others])
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)

    def opened(raw: bytes):
        return gzip.GzipFile(fileobj=io.BytesIO(raw)) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw)

    def run(batches):
        def made(batch, rows, owner):
            keys = batch.select(list(range(len(others)))).take(pa.array(owner, pa.int64())).columns if others else []
            return pa.RecordBatch.from_arrays([*keys, *[pa.array([r[f.name] for r in rows], f.type) for f in target]], names=[*others, *target.names])

        for batch in batches:
            rows, owner, size = [], [], 0
            for i in range(batch.num_rows):
                raw = batch.column(len(others))[i].as_py()
                with contextlib.suppress(EOFError, gzip.BadGzipFile, zlib.error):  # what comes before damage counts
                    for named, block in records_in(opened(raw or b"")):
                        if named.get("warc-type", "").lower() == "response":
                            rows.append(response_of(named, block))
                            owner.append(i)
                            size += len(block)
                        if size >= _HAND_ON:
                            yield made(batch, rows, owner)
                            rows, owner, size = [], [], 0
            if rows:
                yield made(batch, rows, owner)

    return data.select(*others, content).mapInArrow(run, T.StructType([*kept.fields, *schema.fields]))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The responses in WARC files, plain or .warc.gz, with the file of each as `path`."""
    return read_responses(spark.read.format("binaryFile").load(path).select("path", "content"))


def response_records(pages: DataFrame, date: str = NO_DATE) -> DataFrame:
    """`pages` (page_id, url, html) as WARC response records in `content`: served as UTF-8 HTML, at `date` as the table has none."""

    def one(url: str | None, page: str | None) -> bytes:
        payload = (page or "").encode("utf-8", "replace")
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
        url = " ".join((url or "").split())
        named = [
            ("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", url, date, digest(payload))), ("WARC-Date", date), ("WARC-Target-URI", url),
            ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
        ]
        return (VERSION + END + "".join(f"{k}: {v}{END}" for k, v in named if v) + END).encode("utf-8", "replace") + block + b"\r\n\r\n"

    make = lambda: lambda urls, pages: [[one(u, p) for u, p in zip(urls, pages, strict=True)]]
    return add_columns(pages, ["url", "html"], "content binary", make).select("page_id", "content")


def as_file_part(headers: str, block: bytes) -> bytes:
    """A record as a gzip member of its own, the unit of a .warc.gz file; equal records give equal bytes."""
    return gzip.compress(headers.encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n", mtime=0)


def op4_warc_derivatives(spark, sf_dir: str) -> DataFrame:
    """Both derivative records of every page: ids, links, digests and the SHA-256 of header and block; see the README's contract table."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = derivatives(read_responses(response_records(pages)))
    return out.select(
        "page_id", "record_type", "record_id", F.col("response_id").alias("refers_to"), "target_uri", "block_digest", "refers_to_digest",
        F.octet_length("block").cast("long").alias("content_length"), F.sha2("headers", 256).alias("headers_sha256"), F.sha2("block", 256).alias("block_sha256"),
    )
