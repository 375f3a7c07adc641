r"""Operator 9: WARC derivatives of web responses.

From a response come a ``metadata`` record (title, links, language, character set,
the source's HTTP headers and digests) and a ``conversion`` record (its plain text).
Both refer to the response by its identifier, address and date, and carry digests
of their own blocks and of their source.  ``read_warc`` gives the responses of WARC
files, whose identifiers, dates, headers and digests are kept; a table of pages has
none of these, so theirs are made from the page.  Identifiers of derived records are
made from their source, so a lost task that runs again gives the same records.

Plain text: comments, and the content of scripts, styles, templates and the head,
go; the ends of block elements break the line; other tags go, whatever their quoted
attributes hold; character references are resolved; runs of white space are one
space, and empty lines go.

Edge cases: a null url or html is empty; every input row gives one row of
derivatives, null ids included; repeated rows give equal records; unclosed comments
and scripts reach to the end, as in browsers; an unclosed head ends where the body
begins, at the first text or element that no head holds; an empty table gives no
records; a WARC file that ends within a record gives the records before it, other
damage raises; bodies whose encoding is broken or not known are taken as they are.
"""

from __future__ import annotations

import gzip
import hashlib
import html
import os
import re
import uuid
import zlib
from base64 import b32encode
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122's name space of URLs
DATE = "1970-01-01T00:00:00Z"
SOFTWARE = "tidemark"
#: The inside of a tag: quoted values after an equals sign may hold anything.
_ATTRS = r"[^>=]*+(?:=\s*+(?:\"[^\"]*+\"|'[^']*+')?+[^>=]*+)*+"
_UP_TO = r"(?:[^>=]*+=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*?[^>=]*?"  # the same, attribute by attribute, as little as possible

_COMMENT = r"!--.*?(?:-->|\Z)"  # this and the next ones behind a <


def _whole(*kinds: str) -> str:
    """Elements with their contents; without groups, which loops that never go back cannot hold."""
    return "|".join(rf"{k}\b{_ATTRS}>.*?(?:</{k}\s*>|\Z)" for k in kinds)


_UNSEEN = _whole("script", "style", "template", "noscript")
#: What a head holds, piece by piece; anything else is the start of the body.
_IN_HEAD = rf"(?:\s++|<(?:{_COMMENT}|{_UNSEEN}|{_whole('title', 'noframes')}|/?(?:meta|link|base|basefont|bgsound)\b{_ATTRS}>|head\b{_ATTRS}>))*+"
#: Up to </head>, over odd text and tags, but no further than the first element that only a body has.
_BODY = r"/?(?:body|html|p|div|article|section|header|footer|nav|main|aside|ul|ol|li|table|tr|h[1-6]|blockquote|pre|form|dl|dt|dd|head)\b"
_ODD_HEAD = rf"(?:[^<]++|<(?:{_COMMENT}|{_UNSEEN}|(?!{_BODY}|!--|(?:script|style|template|noscript)\b)))*+"
_HIDDEN = re.compile(rf"<(?:{_COMMENT}|(?P<head>head\b{_ATTRS}>(?:{_IN_HEAD}</head\s*>|{_ODD_HEAD}</head\s*>|{_IN_HEAD}))|{_UNSEEN})", re.S | re.I)
_BREAK = re.compile(rf"<(?:/?(?:p|div|article|section|header|footer|nav|main|aside|ul|ol|li|table|tr|h[1-6]|blockquote|pre|form|dl|dt|dd|title|body|html)\b{_ATTRS}|[bh]r\b{_ATTRS})>", re.I)
_TAG = re.compile(rf"<[!/?a-zA-Z]{_ATTRS}>")
_BLANKS = re.compile(r"[ \t\r\f\v ]+")
_LINES = re.compile(r" ?\n[ \n]*")
_TITLE = re.compile(rf"<title\b{_ATTRS}>(.*?)(?:</title\s*>|\Z)", re.S | re.I)
_HREF = re.compile(rf"<a\b{_UP_TO}\shref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_LANG = re.compile(rf"<html\b{_UP_TO}\slang\s*=\s*[\"']?([\w-]+)", re.I)
_CHARSET = re.compile(r"<meta\b[^>]*?charset\s*=\s*[\"']?([\w-]+)", re.I)


def plain_text(page: str) -> str:
    text = _HIDDEN.sub(" ", page)
    last = text.rfind(">") + 1  # no tag ends behind it
    text = _TAG.sub("", _BREAK.sub("\n", text[:last])) + text[last:]
    return _LINES.sub("\n", _BLANKS.sub(" ", html.unescape(text))).strip()


def digest(block: bytes) -> str:
    return "sha1:" + b32encode(hashlib.sha1(block).digest()).decode()


def record_id(kind: str, url: str, source: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{kind} {source} {url}')}>"


def _one_line(text: str) -> str:
    return " ".join(text.split())


def _record(headers: list[tuple[str, str]], block: bytes) -> str:
    lines = [*headers, ("Content-Length", str(len(block)))]
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n" + block.decode() + "\r\n\r\n"


def derive(page_id: int | None, url: str | None, page: str | None, date: str = DATE, response: dict | None = None) -> dict:
    """The fields of both records of one response, and the records as they stand in a file.

    response: what read_warc() gives of it; without one, the page is taken for the
    payload of a response that has the usual headers.
    """
    url, page = _one_line(url or ""), page or ""
    if response is None:
        payload = page.encode()
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
        response = {"record_id": record_id("response", url, page_id), "date": date, "head": head, "payload_digest": digest(payload), "block_digest": digest(head.encode() + payload), "payload_bytes": len(payload)}
        own = page_id
    else:
        own = response["record_id"]
    source, date, refers = response["payload_digest"], response["date"] or date, response["record_id"]
    shown = _HIDDEN.sub(lambda m: m[0] if m["head"] else " ", page)
    links = [html.unescape(next(x for x in m if x)) for m in _HREF.findall(shown[: shown.rfind(">") + 1]) if any(m)]
    title = _TITLE.search(shown)
    sent = [tuple(map(_one_line, x.split(":", 1))) for x in response["head"].split("\r\n")[1:] if ":" in x]
    kind = next((v for k, v in sent if k.lower() == "content-type"), "")
    fields = [("title", _one_line(html.unescape(title[1])) if title else ""), ("language", (_LANG.search(page) or ("", ""))[1]), ("charset", (_CHARSET.search(page) or ("", ""))[1])]
    fields += [("sourceContentType", kind), ("sourceContentLength", str(response["payload_bytes"])), ("sourcePayloadDigest", source), ("sourceBlockDigest", response["block_digest"]), ("sourceStatus", _one_line(response["head"].split("\r\n")[0]))]
    fields += [("sourceHeader", f"{k}: {v}") for k, v in sent]
    fields += [("outlink", f"{_one_line(x)} L a/@href") for x in links]
    meta = "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "replace")
    text = plain_text(page)
    block = text.encode("utf-8", "replace")
    meta_id, text_id = record_id("metadata", url, own), record_id("conversion", url, own)
    common = [("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Refers-To", refers), ("WARC-Refers-To-Target-URI", url), ("WARC-Refers-To-Date", date)]
    records = (
        _record([("WARC-Type", "metadata"), ("WARC-Record-ID", meta_id), *common, ("WARC-Concurrent-To", text_id), ("WARC-Block-Digest", digest(meta)), ("Content-Type", "application/warc-fields")], meta),
        _record([("WARC-Type", "conversion"), ("WARC-Record-ID", text_id), *common, ("WARC-Concurrent-To", meta_id), ("WARC-Source-Payload-Digest", source), ("WARC-Block-Digest", digest(block)), ("Content-Type", "text/plain; charset=utf-8")], block),
    )
    return {
        "page_id": page_id, "url": url, "response_id": refers, "metadata_id": meta_id, "conversion_id": text_id, "source_digest": source, "metadata_digest": digest(meta), "conversion_digest": digest(block),
        "title": fields[0][1], "language": fields[1][1], "n_links": len(links), "source_bytes": response["payload_bytes"], "metadata_bytes": len(meta), "text_bytes": len(block), "text": block.decode(), "metadata_record": records[0], "conversion_record": records[1],
    }


_LONGS = {"page_id", "n_links", "source_bytes", "metadata_bytes", "text_bytes"}
DIGESTS = ("page_id", "url", "response_id", "metadata_id", "conversion_id", "source_digest", "metadata_digest", "conversion_digest", "title", "language", "n_links", "source_bytes", "metadata_bytes", "text_bytes")
FULL = (*DIGESTS, "text", "metadata_record", "conversion_record")
RESPONSE = ("record_id", "date", "head", "payload_digest", "block_digest", "payload_bytes")


def derivatives(pages: DataFrame, columns: tuple[str, ...] = FULL, date: str = DATE) -> DataFrame:
    """One row for each page (page_id, url, html) or response of read_warc(), with the columns asked for.  One pass, no shuffle."""
    given = set(RESPONSE) <= set(pages.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 200):
                part = batch.slice(i, 200)
                told = zip(*(part.column(k).to_pylist() for k in range(part.num_columns)))
                rows = [derive(*x[:3], date, dict(zip(RESPONSE, x[3:])) if given else None) for x in told]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64() if c in _LONGS else pa.string()) for c in columns], names=list(columns))

    base = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), *(RESPONSE if given else ()))
    return base.mapInArrow(run, ", ".join(f"{c} {'long' if c in _LONGS else 'string'}" for c in columns))


def _unpacked(raw: bytes) -> bytes:
    """The content of a file that is plain or a row of gzip members; the whole members of one that was cut off."""
    if raw[:2] != b"\x1f\x8b":
        return raw
    out = []
    while raw:
        member = zlib.decompressobj(31)
        out.append(member.decompress(raw))
        raw = member.unused_data.lstrip(b"\0") if member.eof else b""
    return b"".join(out)


def records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers, their names in lower case, and block of each whole record of a file."""
    data, at = _unpacked(raw), 0
    while at < len(data):
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0 and data[at : at + 5] in (b"WARC/", b"WARC/"[: len(data) - at]):
            return
        lines = re.sub(r"\r\n[ \t]+", " ", data[at : max(stop, 0)].decode("utf-8", "replace")).split("\r\n")
        if not re.fullmatch(r"WARC/\d+\.\d+", lines[0]):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        begin = stop + 4
        end = begin + int(fields["content-length"])
        if end > len(data):
            return
        yield fields, data[begin:end]
        at = end + 4
        if data[end:at] not in (b"\r\n\r\n", b"\r\n\r\n"[: len(data) - end]):
            raise ValueError(f"no end of a record at byte {end}")


def _dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while m := re.compile(rb"([0-9a-fA-F]+)[^\r\n]*\r\n").match(body, at):
        size = int(m[1], 16)
        if size == 0:
            return b"".join(out)
        out.append(body[m.end() : m.end() + size])
        at = m.end() + size + 2
    return b"".join(out) if out else body


def payload(block: bytes) -> tuple[str, bytes, str]:
    """Head, payload and text of an HTTP response: chunks joined, gzip and deflate undone, decoded by the named character set."""
    head, _, body = block.partition(b"\r\n\r\n")
    shown = head.decode("iso-8859-1")
    sent = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in shown.split("\r\n")[1:])}
    if sent.get("transfer-encoding", "").lower() == "chunked":
        body = _dechunked(body)
    try:
        if sent.get("content-encoding", "").lower() in ("gzip", "x-gzip"):
            body = gzip.decompress(body)
        elif sent.get("content-encoding", "").lower() == "deflate":
            body = zlib.decompress(body) if body[:1] == b"\x78" else zlib.decompress(body, -15)
    except (OSError, EOFError, zlib.error):
        pass
    named = re.search(r"charset\s*=\s*[\"']?([\w-]+)", sent.get("content-type", ""), re.I) or _CHARSET.search(body[:2048].decode("iso-8859-1"))
    try:
        text = body.decode(named[1] if named else "utf-8", "replace")
    except LookupError:
        text = body.decode("utf-8", "replace")
    return shown, body, text


_READ = (("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("record_id", pa.string()), ("date", pa.string()), ("head", pa.string()), ("payload_digest", pa.string()), ("block_digest", pa.string()), ("payload_bytes", pa.int64()))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The responses of WARC files, plain or gzipped, as derivatives() takes them; page_id is null.  A file is read by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                rows, size = [], 0
                for fields, block in records(batch.column(0)[k].as_py()):
                    if fields.get("warc-type") != "response":
                        continue
                    head, body, text = payload(block)
                    rows.append((None, fields.get("warc-target-uri", "").strip("<>"), text.encode("utf-8", "replace").decode(), fields.get("warc-record-id", ""), fields.get("warc-date"), head + "\r\n\r\n", fields.get("warc-payload-digest") or digest(body), fields.get("warc-block-digest") or digest(block), len(body)))
                    size += len(text)
                    if size > 4 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, ", ".join(f"{n} {'long' if t == pa.int64() else 'string'}" for n, t in _READ))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _READ)], names=[n for n, _ in _READ])


def _info(date: str, name: str) -> str:
    """The record that a file begins with."""
    block = f"software: {SOFTWARE}\r\nformat: WARC File Format 1.1\r\n".encode()
    return _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("warcinfo", "", name)), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], block)


def write_warc(pages: DataFrame, path: str, date: str = DATE, compress: bool = True) -> None:
    """WARC files of all derived records, one for each partition, each beginning with a warcinfo record.

    compress: one gzip member for each record, as readers expect that jump to records.
    The workers write these files themselves, so the path must be a folder that driver
    and workers share; a task that runs again leaves no second file.  Without it, Spark's
    writer is used, so the path may be in any store that Spark can write.
    """
    made = derivatives(pages, ("metadata_record", "conversion_record"), date)
    if not compress:
        _plain(made, date).write.option("lineSep", "\r\n\r\n").text(path)
        return
    at = urlsplit(path)
    if at.scheme not in ("", "file"):
        raise ValueError("compressed WARC files need a shared folder; write plain ones to other stores")
    folder = unquote(at.path) if at.scheme else path
    if os.path.exists(folder):
        raise FileExistsError(folder)
    os.makedirs(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, count = f"{uuid.uuid4().hex}.tmp", 0
        with open(os.path.join(folder, name), "wb") as out:
            out.write(gzip.compress(_info(date, name).encode(), mtime=0))
            for batch in batches:
                for pair in zip(*(batch.column(k).to_pylist() for k in range(2))):
                    for record in pair:
                        out.write(gzip.compress(record.encode(), mtime=0))
                        count += 1
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count])], names=["name", "records"])

    done = sorted(r.name for r in made.mapInArrow(run, "name string, records long").collect())  # one row for each partition
    for k, name in enumerate(done):
        os.rename(os.path.join(folder, name), os.path.join(folder, f"part-{k:05d}.warc.gz"))
    for name in os.listdir(folder):
        if name.endswith(".tmp"):  # of tasks that were lost
            os.remove(os.path.join(folder, name))


def _plain(made: DataFrame, date: str) -> DataFrame:
    """One row for each record, without the four bytes that end it, which the writer puts there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([_info(date, uuid.uuid4().hex)[:-4]])], names=["value"])
        for batch in batches:
            for i in range(0, len(batch), 200):
                pairs = zip(*(batch.column(k).slice(i, 200).to_pylist() for k in range(2)))
                yield pa.RecordBatch.from_arrays([pa.array([r[:-4] for pair in pairs for r in pair], pa.string())], names=["value"])

    return made.mapInArrow(run, "value string")
