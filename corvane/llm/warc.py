"""WARC derivatives: responses become linked metadata and plain-text conversion records.

Records are rows: (record_id, record_type, target_uri, date, content_type, headers, block), where headers holds
all named fields of the record, in order, and block its bytes. ``derivatives`` makes two records of every response:

* a *metadata* record (application/warc-fields) with title, language, charset, status, the HTTP headers of the
  source and the outgoing links;
* a *conversion* record (text/plain) with the text of the page.

Both name the response in WARC-Refers-To, WARC-Refers-To-Target-URI and WARC-Refers-To-Date, carry its payload
and block digests as WARC-Refers-To-Payload-Digest and -Block-Digest, and have digests and lengths of their own.
Record ids are name-based UUIDs of the response's id and the kind of record, so a rerun gives the same ids and the
links between the records can be checked. The metadata record also points to the conversion record and back.

``read_warc`` and ``write_warc`` exchange such rows with gzipped or plain files; ``responses`` makes response
records of (page_id, url, html) tables. The work is one pass without a shuffle.
"""

from __future__ import annotations

import base64
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

from corvane.llm import common

#: Name space of the ids of derived records, and the date of records whose source has none.
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "corvane:warc-derivatives")
DEFAULT_DATE = "1970-01-01T00:00:00Z"

RECORD = (
    "record_id string, record_type string, target_uri string, date string, content_type string, "
    "headers array<struct<name:string,value:string>>, block binary"
)
DERIVED = "page_id long, refers_to string, source_block_digest string, source_payload_digest string, block_digest string, content_length long, " + RECORD

_GONE = re.compile(
    r"<(?:!--.*?(?:-->|\Z)|(script|style|noscript|template|svg|iframe)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)|!\[CDATA\[)|\]\]>",
    re.IGNORECASE | re.DOTALL,
)
_TAG = re.compile(r"<(?:(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|[!?/][^>]*>)")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.IGNORECASE | re.DOTALL)
_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.IGNORECASE)
_CHARSET = re.compile(rb"<meta\b[^>]*?\bcharset\s*=\s*[\"']?\s*([A-Za-z0-9_:.-]+)", re.IGNORECASE)
_HREF = re.compile(r"<a\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.IGNORECASE)
_HTTP_CHARSET = re.compile(r"charset\s*=\s*\"?([A-Za-z0-9_:.-]+)", re.IGNORECASE)
#: Runs of white space but for single blanks, which may stay as they are.
_SPACES, _LINES = re.compile(r"(?: (?=[^\S\n])|[^\S\n ])[^\S\n]*"), re.compile(r" ?\n[ \n]*")
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i img input kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())


def digest(block: bytes) -> str:
    """sha1 in base 32, as archives label it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_urn(*name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(0).join(name))}>"


def html_text(page: str) -> str:
    """The text of a page: no scripts, styles, comments and tags; block elements begin a line, entities are decoded."""
    if "<" in page:
        body = _GONE.sub(" ", page)
        body = _TITLE.sub(" ", body)
        body = _SPACES.sub(" ", body.replace("\n", " "))
        body = _TAG.sub(lambda m: "" if m[2] and m[2].lower() in _INLINE else "\n", body)
    else:
        body = _SPACES.sub(" ", page)
    if "&" in body:
        body = _SPACES.sub(" ", html.unescape(body))
    return _LINES.sub("\n", body).strip()


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(status line, headers, body) of an HTTP response; a block without a status line is all body."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    head, sep, body = block.partition(b"\r\n\r\n")
    if not sep:
        head, sep, body = block.partition(b"\n\n")
    lines = head.decode("latin-1").splitlines()
    fields: list[tuple[str, str]] = []
    for line in lines[1:]:
        if line[:1] in " \t" and fields:  # folded
            fields[-1] = (fields[-1][0], f"{fields[-1][1]} {line.strip()}")
            continue
        name, colon, value = line.partition(":")
        if colon:
            fields.append((name.strip(), value.strip()))
    return lines[0], fields, body


def _get(fields: list[tuple[str, str]], name: str) -> str | None:
    return next((v for n, v in fields if n.lower() == name), None)


def _unchunk(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end >= 0 else 0
        except ValueError:
            return body
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def _payload(fields: list[tuple[str, str]], body: bytes) -> bytes:
    """The body without transfer and content encodings; what can't be decoded stays as it is."""
    if (_get(fields, "transfer-encoding") or "").lower() == "chunked":
        body = _unchunk(body)
    kind = (_get(fields, "content-encoding") or "").lower()
    try:
        if kind in ("gzip", "x-gzip"):
            return zlib.decompressobj(31).decompress(body)
        if kind == "deflate":
            return zlib.decompress(body)
    except zlib.error:
        pass
    return body


def _decode(body: bytes, fields: list[tuple[str, str]]) -> tuple[str, str]:
    """(text, charset): by the HTTP header, else the meta element, else UTF-8; faults become replacement characters."""
    said = _HTTP_CHARSET.search(_get(fields, "content-type") or "")
    meta = None if said else _CHARSET.search(body)
    charset = said[1] if said else meta[1].decode("ascii") if meta else "utf-8"
    try:
        return body.decode(charset, "replace"), charset.lower()
    except LookupError:
        return body.decode("utf-8", "replace"), "utf-8"


def _links(page: str, base: str) -> list[str]:
    """Absolute targets of the links, each once, in order; other schemes than http(s) are left out."""
    found = {}
    for m in _HREF.finditer(page):
        raw = html.unescape(m[1] or m[2] or m[3] or "").strip()
        if not raw or raw.startswith("#"):
            continue
        try:
            to = urljoin(base, raw)
        except ValueError:
            continue
        if to.startswith(("http://", "https://")):
            found.setdefault(to.replace("\r", "").replace("\n", ""))
    return list(found)


def _line(value: str) -> str:
    return " ".join(value.split())


def derive(record_id: str, target_uri: str | None, date: str | None, headers: list[tuple[str, str]], block: bytes) -> list[tuple]:
    """The metadata and the conversion record of one response, as tuples in the order of DERIVED after page_id."""
    status, http, raw = split_http(block)
    body = _payload(http, raw)
    page, charset = _decode(body, http)
    text = html_text(page).encode("utf-8", "replace")
    uri, when = target_uri or "", date or DEFAULT_DATE
    block_digest = _get(headers, "warc-block-digest") or digest(block)
    payload_digest = _get(headers, "warc-payload-digest") or digest(raw)
    ids = {kind: record_urn(record_id, kind) for kind in ("metadata", "conversion")}
    title, lang = _TITLE.search(page), _LANG.search(page)
    fields = [("status", status)] if status else []
    fields += [("title", _line(html.unescape(title[1])))] if title else []
    fields += [("language", lang[1].lower())] if lang else []
    fields += [("charset", charset), ("text-length", str(len(text)))]
    fields += [(f"http-{n.lower()}", _line(v)) for n, v in http]
    fields += [("outlink", to) for to in _links(page, uri)]
    meta = "".join(f"{n}: {v}\r\n" for n, v in fields).encode("utf-8", "replace")
    out = []
    for kind, other, content_type, content in (
        ("metadata", "conversion", "application/warc-fields", meta), ("conversion", "metadata", "text/plain; charset=utf-8", text)):
        own = digest(content)
        named = [
            ("WARC-Type", kind), ("WARC-Record-ID", ids[kind]), ("WARC-Date", when), *([("WARC-Target-URI", uri)] if uri else []),
            ("WARC-Refers-To", record_id), *([("WARC-Refers-To-Target-URI", uri)] if uri else []), ("WARC-Refers-To-Date", when),
            ("WARC-Refers-To-Block-Digest", block_digest), ("WARC-Refers-To-Payload-Digest", payload_digest),
            ("WARC-Concurrent-To", ids[other]), ("WARC-Block-Digest", own), ("Content-Type", content_type), ("Content-Length", str(len(content))),
        ]
        known = {n.lower() for n, _ in named} | {"warc-payload-digest", "warc-ip-address-policy"}
        # other fields of the source (address, identified type, crawl id, ...) are preserved
        named += [(n, v) for n, v in headers if n.lower() not in known and n.lower() != "warc-concurrent-to"]
        out.append((record_id, block_digest, payload_digest, own, len(content), ids[kind], kind, target_uri, when, content_type, named, content))
    return out


def response_record(url: str | None, page: str | None, date: str = DEFAULT_DATE, name: str = "") -> tuple:
    """A response record, in the order of RECORD, around a page. A null page has an empty body."""
    raw = (page or "").encode("utf-8", "replace")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(raw) + raw
    record_id = record_urn("response", name, url or "", digest(raw))
    named = [
        ("WARC-Type", "response"), ("WARC-Record-ID", record_id), ("WARC-Date", date), *([("WARC-Target-URI", url)] if url else []),
        ("WARC-Payload-Digest", digest(raw)), ("WARC-Block-Digest", digest(block)),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    return record_id, "response", url, date, "application/http; msgtype=response", named, block


_FIELDS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
_ARROW = {
    "page_id": pa.int64(), "refers_to": pa.string(), "source_block_digest": pa.string(), "source_payload_digest": pa.string(), "block_digest": pa.string(), "content_length": pa.int64(),
    "record_id": pa.string(), "record_type": pa.string(), "target_uri": pa.string(), "date": pa.string(), "content_type": pa.string(), "headers": _FIELDS, "block": pa.binary(),
}
_RECORD_NAMES, _DERIVED_NAMES = list(_ARROW)[6:], list(_ARROW)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    arrays = []
    for name, column in zip(names, columns, strict=True):
        if name == "headers":
            column = [[{"name": n, "value": v} for n, v in fields] for fields in column]
        arrays.append(pa.array(column, _ARROW[name]))
    return pa.RecordBatch.from_arrays(arrays, names=names)


#: Bytes of blocks gathered in one output batch.
_BATCH_BYTES = 4 << 20


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records of a table of pages, with page_id. Null urls give records without a target; null and empty
    pages give an empty body; repeated rows give equal records; extra columns are ignored."""
    narrow = pages.select(common.col(id_col).cast("long").alias("page_id"), common.col(url_col).alias("url"), common.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for i, url, page in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                rows.append((i, *response_record(url, page, name=str(i))))
                size += len(rows[-1][-1])
                if size > _BATCH_BYTES:
                    yield _batch(rows, ["page_id", *_RECORD_NAMES])
                    rows, size = [], 0
            yield _batch(rows, ["page_id", *_RECORD_NAMES])

    return narrow.mapInArrow(run, f"page_id long, {RECORD}")


def derivatives(records: DataFrame) -> DataFrame:
    """The metadata and conversion records of all response records, as DERIVED says; other records give none.

    records: the columns of RECORD and, optionally, page_id, which is carried along (else null). A response with a
    null id is skipped: nothing could refer to it. A null block counts as empty: it gives both records, the text empty.
    Repeated responses give equal records. An empty table gives an empty result.
    """
    page_id = F.col("page_id").cast("long") if "page_id" in records.columns else F.lit(None).cast("long")
    narrow = records.filter("lower(record_type) = 'response' and record_id is not null").select(
        page_id.alias("page_id"), "record_id", "target_uri", "date", "headers", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for i, record_id, uri, date, headers, block in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                fields = [(h["name"], h["value"] or "") for h in headers or [] if h and h["name"]]
                for made in derive(record_id, uri, date, fields, block or b""):
                    rows.append((i, *made))
                    size += len(made[-1])
                if size > _BATCH_BYTES:
                    yield _batch(rows, _DERIVED_NAMES)
                    rows, size = [], 0
            yield _batch(rows, _DERIVED_NAMES)

    return narrow.mapInArrow(run, DERIVED)


def page_derivatives(pages: DataFrame) -> DataFrame:
    """derivatives(responses(pages)) in one pass: the responses' blocks don't travel between two Python stages."""
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for i, url, page in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                record_id, _, uri, date, _, named, block = response_record(url, page, name=str(i))
                for made in derive(record_id, uri, date, named, block):
                    rows.append((i, *made))
                    size += len(made[-1])
                if size > _BATCH_BYTES:
                    yield _batch(rows, _DERIVED_NAMES)
                    rows, size = [], 0
            yield _batch(rows, _DERIVED_NAMES)

    return narrow.mapInArrow(run, DERIVED)


# ---------------------------------------------------------------- files


_END = b"\r\n\r\n"
#: The type of rows that stand for what couldn't be read.
DAMAGED = "damaged"


def serialise(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """The bytes of one record. Content-Length is that of the block whatever the headers say."""
    kept = [(n, v) for n, v in headers if n.lower() != "content-length"]
    head = "".join(f"{n}: {v}\r\n" for n, v in [*kept, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode("utf-8", "replace") + b"\r\n" + block + _END


def _damaged(reason: str, rest: bytes = b"") -> tuple:
    return None, DAMAGED, None, None, None, [("Error", reason)], rest


def parse(data: io.BufferedIOBase) -> Iterator[tuple]:
    """The records of an uncompressed stream, in the order of RECORD.

    What can't be read as a record ends the stream with a row of the type DAMAGED, whose only header says why and whose
    block is what was read of it.
    """
    while True:
        line = data.readline()
        while line in (b"\r\n", b"\n"):
            line = data.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            yield _damaged("no version line", line)
            return
        named: list[tuple[str, str]] = []
        while (line := data.readline()) not in (b"\r\n", b"\n", b""):
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text[:1] in (" ", "\t") and named:
                named[-1] = (named[-1][0], f"{named[-1][1]} {text.strip()}")
                continue
            name, _, value = text.partition(":")
            named.append((name.strip(), value.strip()))
        length = _get(named, "content-length")
        if line == b"" or length is None or not length.isdigit():
            yield _damaged("header cut short" if line == b"" else "no length")
            return
        block = data.read(int(length))
        if len(block) < int(length):
            yield _damaged("block cut short", block)
            return
        yield (_get(named, "warc-record-id"), _get(named, "warc-type"), _get(named, "warc-target-uri"), _get(named, "warc-date"), _get(named, "content-type"), named, block)


class _Members(io.RawIOBase):
    """The bytes of gzip members, one after the other; ends at the first damage and says in ``error`` what it was."""

    def __init__(self, data: memoryview):
        self.data, self.at, self.pending, self.z, self.begun, self.error = data, 0, b"", zlib.decompressobj(31), False, None

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while self.error is None:
            if self.z.eof:
                self.z, self.begun = zlib.decompressobj(31), False
            if not self.pending:
                self.pending, self.at = bytes(self.data[self.at : self.at + 4096]), self.at + 4096
            if not self.pending:
                self.error = "ends within a member" if self.begun else None
                return 0
            try:
                out, self.begun = self.z.decompress(self.pending, len(into)), True
            except zlib.error as e:
                self.error = str(e)
                return 0
            self.pending = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if out:
                into[: len(out)] = out
                return len(out)
        return 0


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all files under path, gzipped (record by record or whole) or plain, and a row of the type DAMAGED
    for every file that doesn't end as it should: count those. A file is read by one task; one of 2 GB or more, which is
    beyond the usual size of 1 GB, makes the read fail."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data = memoryview(content.as_buffer())
                members = _Members(data) if bytes(data[:2]) == b"\x1f\x8b" else None
                rows, size, whole = [], 0, True
                for row in parse(io.BytesIO(data) if members is None else io.BufferedReader(members)):
                    rows.append(row)
                    size, whole = size + len(row[-1]), row[1] != DAMAGED
                    if size > _BATCH_BYTES:
                        yield _batch(rows, _RECORD_NAMES)
                        rows, size = [], 0
                if whole and members is not None and members.error:
                    rows.append(_damaged(f"compressed data: {members.error}"))
                yield _batch(rows, _RECORD_NAMES)

    return files.mapInArrow(run, RECORD)


def write_warc(records: DataFrame, folder: str, compression: str = "gzip") -> None:
    """Writes one file for each partition (headers, block) to folder, on any file system that Spark knows.

    Spark's own committer names the files when they are complete, so repeated tasks leave no half and no double files. Null
    headers and blocks are empty. compression: gzip (a file is one member) or none.
    """
    narrow = records.select("headers", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for headers, block in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                record = serialise([(h["name"], h["value"] or "") for h in headers or []], block or b"")
                out.append(record[: -len(_END)])
                size += len(record)
                if size > _BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    # bytes pass through a string column unchanged, and what ends a record is what the text sink puts behind each row
    lines = narrow.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", _END.decode()).option("compression", compression).text(folder)
