"""WARC derivatives: metadata and plain-text conversion records of responses.

Each response yields two records that refer to it (``WARC-Refers-To`` is its record id)
and to each other's target: a ``metadata`` record (JSON with the source's WARC and HTTP
headers, its digests, title and links) and a ``conversion`` record (the page as plain
text).  Digests are ``sha1:`` and base32; the payload digest of the source is preserved as
given, or computed where it is missing.  Record ids are UUIDs derived from the source's id
and the kind, so a repeated run or a retried task gives the same records.

Null payloads count as empty; null urls give an empty target.  Repeated rows give repeated
records.  Pages are scanned once from left to right, in time linear in their length, however
long or malformed.  Input columns that are not named in ``carry`` are left out; one in
``carry`` that bears the name of a result is refused.  All work is one narrow pass.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as entities
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122
RESPONSE = "record_id string, target_uri string, warc_date string, headers map<string,string>, http string, payload string, digest string"
DERIVED = "record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, block_digest string, payload_digest string, content_length long, block string"

_BLOCK = frozenset("address article aside blockquote br dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
#: Elements whose content is no text of the page; one that is never closed ends with the page.
_HIDDEN = frozenset("script style noscript template title".split())
_CLOSE = {name: re.compile(f"</{name}", re.I | re.A) for name in _HIDDEN}
#: A comment's begin, a tag (quotes may hide a ``>``), or any other ``<!``, ``<?``, ``</``.
_MARKUP = re.compile(r"<!--|<(/?)([a-zA-Z][a-zA-Z0-9]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+>)|<[!?/][^>]*+>")
_ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_BLANK = re.compile(r"[^\S\n]+")


def digest(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def read_page(page: str) -> tuple[str, str, list[str]]:
    """The visible text, the title and the link targets.

    Of the text block elements end a line, runs of blanks are one, empty lines go.  Nothing after
    the last ``>`` can be a tag, so every search ends with a tag found and the scan is linear.
    """
    page = page.replace("\n", " ")
    out, title, links = [], None, []
    at, last = 0, page.rfind(">") + 1
    while found := _MARKUP.search(page, at, last):
        if found.start() > at:
            out.append(page[at : found.start()])
        at = found.end()
        if (name := found[2]) is None:
            if found[0] == "<!--":
                end = page.find("-->", at)
                at = len(page) if end < 0 else end + 3
            continue
        name = name.lower()
        if name in _BLOCK:
            out.append("\n")
        elif found[1]:
            continue
        elif name == "a":
            for m in _ATTRIBUTE.finditer(found[3][:-1]):
                if m[1].lower() == "href":
                    links.append(entities.unescape(m[2] or m[3] or m[4] or ""))
                    break
        elif name in _HIDDEN:
            end = _CLOSE[name].search(page, at)
            end = end.start() if end else len(page)
            if name == "title" and title is None:
                title = " ".join(entities.unescape(page[at:end]).split())
            at = end
    rest = page[at:]
    out.append(rest[: rest.find("<!--")] if "<!--" in rest else rest)
    rows = (_BLANK.sub(" ", row).strip() for row in entities.unescape("".join(out)).replace("\r", " ").split("\n"))
    return "\n".join(row for row in rows if row), title or "", links


def plain_text(page: str) -> str:
    return read_page(page)[0]


def derive(record_id: str, target: str, date: str, headers: dict[str, str], http: str, payload: str, source: str | None = None) -> Iterator[tuple]:
    """The rows of ``DERIVED`` for one response; ``source`` is the digest of its payload, if known."""
    source = headers.get("WARC-Payload-Digest") or source or digest(payload.encode())
    text, title, links = read_page(payload)
    meta = {
        "source": {"WARC-Record-ID": record_id, "WARC-Target-URI": target, "WARC-Date": date, "WARC-Payload-Digest": source} | headers,
        "http": dict(h.split(": ", 1) for h in http.split("\r\n")[1:] if ": " in h),
        "status": http.split("\r\n")[0],
        "title": title,
        "links": links,
        "text_digest": digest(text.encode()),
    }
    blocks = (("metadata", "application/json", json.dumps(meta, ensure_ascii=False, sort_keys=True)), ("conversion", "text/plain", text))
    for kind, content, block in blocks:
        own = f"<urn:uuid:{uuid.uuid5(_SPACE, f'{kind} {record_id}')}>"
        raw = block.encode()
        yield kind, own, record_id, target, date, content, digest(raw), source, len(raw), block


def derivatives(responses: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Two records for each row of ``responses`` (columns ``RESPONSE``), with the columns ``carry`` in front."""
    carry = carry or []
    if clash := set(carry) & {x.split()[0] for x in DERIVED.split(", ")}:
        raise ValueError(f"columns {sorted(clash)} bear the name of a result; rename them")
    kinds = {f.name: f.dataType.simpleString() for f in responses.schema}
    names = [x.split()[0] for x in DERIVED.split(", ")]

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                lists = [c.to_pylist() for c in part.columns[len(carry) :]]
                rows = [row for rec, uri, date, heads, http, body, known in zip(*lists, strict=True) for row in derive(rec or "", uri or "", date or "", dict(heads or {}), http or "", body or "", known)]
                twice = pa.array([k // 2 for k in range(2 * part.num_rows)], pa.int64())
                made = [pa.array(x, pa.int64() if n == "content_length" else pa.string()) for n, x in zip(names, zip(*rows, strict=True), strict=True)] if rows else [pa.array([], pa.int64() if n == "content_length" else pa.string()) for n in names]
                yield pa.RecordBatch.from_arrays([*(c.take(twice) for c in part.columns[: len(carry)]), *made], names=[*carry, *names])

    wanted = [x.split()[0] for x in RESPONSE.split(", ")]
    return responses.select(*carry, *wanted).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), DERIVED]))


def responses_of_pages(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records for raw pages; the record id is derived from page id and url."""
    body = F.coalesce("html", F.lit(""))
    name = F.sha1(F.concat_ws(" ", F.col("page_id").cast("string"), F.coalesce("url", F.lit(""))))
    part = lambda a, n: F.substring(name, a, n)
    return pages.select(
        "page_id",
        F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-a"), part(18, 3), F.lit("-"), part(21, 12), F.lit(">")).alias("record_id"),
        F.coalesce("url", F.lit("")).alias("target_uri"),
        F.lit(date).alias("warc_date"),
        F.create_map(F.lit("WARC-Type"), F.lit("response"), F.lit("Content-Type"), F.lit("application/http; msgtype=response")).alias("headers"),
        F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string")).alias("http"),
        body.alias("payload"),
        F.lit(None).cast("string").alias("digest"),
    )


# --- files ----------------------------------------------------------------------------


def to_warc(headers: dict[str, str], block: bytes) -> bytes:
    """One record as it stands in a file."""
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return f"WARC/1.0\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def parse_warc(raw: bytes | BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a file, gzipped (by record or whole) or plain; one record is held at a time."""
    f = io.BufferedReader(io.BytesIO(raw) if isinstance(raw, bytes) else raw)
    f = gzip.open(f) if f.peek(2)[:2] == b"\x1f\x8b" else f
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        heads = {}
        while (line := f.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            heads[k.strip()] = v.strip()
        yield heads, f.read(int(heads.get("Content-Length", 0)))


_CHARSET = re.compile(rb"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.I)


def _unchunked(body: bytes) -> bytes:
    """The content of a chunked body; what is cut short or malformed ends it."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            break
        if size <= 0:
            break
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
    return b"".join(out)


def payload_of(http: bytes, body: bytes) -> tuple[str, str]:
    """The text of a response and the digest of its payload.

    Transfer coding (chunked) and content coding (gzip, deflate) are undone where they hold true; the
    charset is that of the HTTP header, else of the page's first kilobyte, else UTF-8.  Bytes that
    do not fit it become U+FFFD.  The digest is that of the bytes without the transfer coding.
    """
    heads = {k.strip().lower(): v.strip() for k, _, v in (h.partition(b":") for h in http.split(b"\r\n")[1:])}
    if b"chunked" in heads.get(b"transfer-encoding", b"").lower():
        body = _unchunked(body) or body
    own = digest(body)
    coding = heads.get(b"content-encoding", b"").lower()
    if coding in (b"gzip", b"x-gzip", b"deflate"):
        for bits in (47, -15):  # with a gzip or zlib head, or bare
            try:
                body = zlib.decompressobj(bits).decompress(body)
                break
            except zlib.error:
                continue
    found = _CHARSET.search(heads.get(b"content-type", b"")) or _CHARSET.search(body[:1024])
    try:
        return body.decode(found[1].decode() if found else "utf-8", "replace"), own
    except LookupError:
        return body.decode("utf-8", "replace"), own


def read_responses(spark: SparkSession, path: str, *, by_path: bool = False) -> DataFrame:
    """The response records of WARC files, one file to a task at a time and one record in memory.

    Spark's binary reader brings a file's bytes, compressed as they are (below 2 GB).  With
    ``by_path`` tasks open the files themselves and stream them, whatever their size; the path must
    then be one that ``pyarrow.fs`` can open on the executors.
    """
    names = [x.split()[0] for x in RESPONSE.split(", ")]

    def run(batches):
        for batch in batches:
            for given in batch.column(0):
                if by_path:
                    system, where = pa.fs.FileSystem.from_uri(given.as_py())
                    raw = system.open_input_file(where)
                else:
                    raw = given.as_py()
                for heads, block in parse_warc(raw):
                    if heads.get("WARC-Type") != "response":
                        continue
                    http, _, body = block.partition(b"\r\n\r\n")
                    payload, own = payload_of(http, body)
                    row = [heads.get("WARC-Record-ID", ""), heads.get("WARC-Target-URI", ""), heads.get("WARC-Date", "")]
                    row += [list(heads.items()), http.decode("utf-8", "replace"), payload, own]
                    kinds = [pa.map_(pa.string(), pa.string()) if n == "headers" else pa.string() for n in names]
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").load(path)
    return files.select("path" if by_path else "content").mapInArrow(run, RESPONSE)


def with_bytes(derived: DataFrame) -> DataFrame:
    """Adds ``warc``, the serialised record, ready to be concatenated into files."""
    names = derived.columns
    kinds = {f.name: f.dataType.simpleString() for f in derived.schema}

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                heads = {"WARC-Type": row["record_type"], "WARC-Record-ID": row["record_id"], "WARC-Refers-To": row["refers_to"], "WARC-Target-URI": row["target_uri"], "WARC-Date": row["warc_date"], "Content-Type": row["content_type"], "WARC-Block-Digest": row["block_digest"], "WARC-Payload-Digest": row["payload_digest"]}
                out.append(to_warc(heads, row["block"].encode()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*names, "warc"])

    return derived.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "warc binary"]))
