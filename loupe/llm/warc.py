"""WARC derivatives of crawl responses.

Pages become WARC response records; from the responses, as read back, come a
metadata record (title, HTTP headers, digests, outlinks) and a conversion
record (plain text), each with an id of its own and WARC-Refers-To its source.

Records are text whose blocks are counted in UTF-8 bytes, so Spark's text
writer stores them with its line end set to the two line breaks that close a
WARC record: any file system will do, and a lost task is written again whole.
The files are gzipped.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator
from html import unescape
from html.parser import HTMLParser
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.llm.common import shared_path
from loupe.sources.facts import _PLAIN, _attributes

#: The format's version line and line breaks.
VERSION, BREAK = "WARC/1.1", "\r\n"
#: Records of a file; a file is read by one task.
FILE_RECORDS = 2000
#: Capture time of pages that come without one.
CAPTURED = "1970-01-01T00:00:00Z"

_SKIPPED = frozenset({"script", "style", "noscript", "template", "head"})
_INLINE = frozenset({"a", "abbr", "b", "bdi", "bdo", "cite", "code", "em", "font", "i", "kbd", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "u", "var"})

#: Elements whose content is raw text, and those where parsers differ on that.
_ENDS = {tag: re.compile(rf"</{tag}([\t\n\f\r ]*>)?", re.I) for tag in ("script", "style", "title")}
_UNSURE = frozenset({"iframe", "noembed", "noframes", "noscript", "plaintext", "textarea", "xmp"})


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    """An id that depends on the parts alone, so reruns agree."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(parts))}>"


def _value(text: str) -> str:
    """A header's value on one line."""
    return re.sub(r"[\r\n]+", " ", text).strip()


def record(headers: list[tuple[str, str]], block: str) -> str:
    """A record without the two line breaks that close it."""
    size = len(block.encode())
    lines = [VERSION, *(f"{k}: {_value(v)}" for k, v in headers), f"Content-Length: {size}"]
    return BREAK.join(lines) + BREAK * 2 + block


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.links: list[str] = []
        self.heading: list[str] = []
        self.within: list[str] = []
        self.titled = False

    def handle_starttag(self, tag, attrs):
        if tag == "title":
            self.titled = True
        elif tag in _SKIPPED:
            self.within.append(tag)
        elif tag == "body":  # a head that is not closed ends here
            self.within = []
        if tag == "a" and (href := dict(attrs).get("href")):
            self.links.append(href)
        if tag not in _INLINE:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag == "title":
            self.titled = False
        elif tag in self.within:
            while self.within.pop() != tag:
                pass
        if tag not in _INLINE:
            self.parts.append("\n")

    def handle_data(self, data):
        if self.titled:
            self.heading.append(data)
        elif not self.within:
            self.parts.append(data)


def plainly(page: _Page, html: str) -> bool:
    """Reads a page whose markup all parsers read alike (``facts``), several
    times as fast as the parser; False at the first that is not of that kind."""
    at, n, find, match = 0, len(html), html.find, _PLAIN.match
    while at < n:
        lt = find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            said = html[at:lt]
            page.handle_data(unescape(said) if "&" in said else said)
        if lt == n:
            return True
        m = match(html, lt)
        if m is None:
            return False
        at = m.end()
        tag, attrs, closed, ended = m.groups()
        if tag:
            tag = tag.lower()
            if tag in _UNSURE or closed and tag in _ENDS:
                return False
            page.handle_starttag(tag, _attributes(attrs) if tag == "a" and attrs else ())
            if closed:
                page.handle_endtag(tag)
            elif tag in _ENDS:
                end = _ENDS[tag].search(html, at)
                if end is None or not end[1] or "<" in html[at:end.start()] and (tag == "title" or "<!--" in html[at:end.start()]):
                    return False
                if tag != "title":  # what it holds is no text
                    at = end.start()
        elif ended:
            page.handle_endtag(ended.lower())
    return True


def plain_text(html: str) -> tuple[str, str, list[str]]:
    """The text of a page, a line for each block with its white space
    collapsed; its title; its links in order, repeated ones once."""
    page = _Page()
    if not plainly(page, html):
        page = _Page()
        try:
            page.feed(html)
            page.close()
        except AssertionError:  # a malformed declaration: what was read so far stands
            pass
    lines = (" ".join(line.split()) for line in "".join(page.parts).split("\n"))
    return "\n".join(line for line in lines if line), " ".join("".join(page.heading).split()), list(dict.fromkeys(page.links))


def response(page: str, url: str, html: str, captured: str) -> str:
    payload = html.encode()
    told = digest(payload)
    http = BREAK.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]) + BREAK * 2 + html
    return record([("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", page, url, told)), ("WARC-Target-URI", url), ("WARC-Date", captured),
                   ("WARC-Payload-Digest", told), ("WARC-Block-Digest", digest(http.encode())), ("X-Source-ID", page),
                   ("Content-Type", "application/http; msgtype=response")], http)


def records_in(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a WARC file, gzipped or not, by
    their lengths; a header that is given twice keeps its first value."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while (at := data.find(VERSION[:5].encode(), at)) >= 0:
        end = data.find(BREAK.encode() * 2, at)
        if end < 0:
            return
        headers: dict[str, str] = {}
        for line in data[at:end].decode("utf-8", "replace").split(BREAK)[1:]:
            name, _, value = line.partition(":")
            headers.setdefault(name.strip(), value.strip())
        start = end + 2 * len(BREAK)
        size = int(headers.get("Content-Length") or 0)
        yield headers, data[start:start + size]
        at = start + size


def derivatives(headers: dict[str, str], block: bytes) -> list[str]:
    """The metadata and the conversion record of a response record."""
    head, _, payload = block.partition(BREAK.encode() * 2)
    html = payload.decode("utf-8", "replace")
    text, title, links = plain_text(html)
    source, url, when = (headers.get(h, "") for h in ("WARC-Record-ID", "WARC-Target-URI", "WARC-Date"))
    shared = [("WARC-Target-URI", url), ("WARC-Date", when), ("WARC-Refers-To", source), ("X-Source-ID", headers.get("X-Source-ID", ""))]
    ids = {kind: record_id(kind, source) for kind in ("metadata", "conversion")}
    status, *fields = head.decode("utf-8", "replace").split(BREAK)
    about = [("http-status", status), *((f"http-{k.strip().lower()}", v) for k, _, v in (f.partition(":") for f in fields)),
             ("source-payload-digest", headers.get("WARC-Payload-Digest", "")), ("source-block-digest", headers.get("WARC-Block-Digest", "")),
             ("source-verified", str(digest(payload) == headers.get("WARC-Payload-Digest") and digest(block) == headers.get("WARC-Block-Digest")).lower()),
             ("title", title), ("conversion", ids["conversion"]), *(("outlink", link) for link in links)]
    meta = "".join(f"{k}: {_value(v)}{BREAK}" for k, v in about)
    return [record([("WARC-Type", "metadata"), ("WARC-Record-ID", ids["metadata"]), *shared, ("WARC-Block-Digest", digest(meta.encode())), ("Content-Type", "application/warc-fields")], meta),
            record([("WARC-Type", "conversion"), ("WARC-Record-ID", ids["conversion"]), *shared, ("WARC-Block-Digest", digest(text.encode())), ("Content-Type", "text/plain; charset=utf-8")], text)]


def write_records(records: DataFrame, path: str) -> None:
    (records.write.option("lineSep", BREAK * 2).option("maxRecordsPerFile", FILE_RECORDS)
     .option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path))


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def write_responses(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", captured: str = CAPTURED) -> None:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                rows = [response(*r.values(), captured) for r in batch.slice(at, 200).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["value"])

    src = pages.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((key, "k"), (url, "u"), (html, "h"))))
    write_records(src.mapInArrow(run, "value string"), path)


def _batched(rows: Iterator[list], schema: pa.Schema, most: int = 100) -> Iterator[pa.RecordBatch]:
    """Arrow batches of up to ``most`` rows."""
    while some := list(islice(rows, most)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


def write_derivatives(spark: SparkSession, responses: str, path: str) -> None:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (r for batch in batches for data in batch.column(0) for r in records_in(data.as_py()))
        rows = ([text] for headers, block in found if headers.get("WARC-Type") == "response" for text in derivatives(headers, block))
        yield from _batched(rows, pa.schema([("value", pa.string())]))

    write_records(_files(spark, responses).mapInArrow(run, "value string"), path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """type, id, refers_to, uri, date, digest, source, block (text), verified
    (its digest is the block's) of all records of a folder."""
    names = ("WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI", "WARC-Date", "WARC-Block-Digest", "X-Source-ID")

    columns = ("type", "id", "refers_to", "uri", "date", "digest", "source", "block")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (r for batch in batches for data in batch.column(0) for r in records_in(data.as_py()))
        rows = ([*(headers.get(n, "") for n in names), block.decode("utf-8", "replace"), digest(block) == headers.get("WARC-Block-Digest")] for headers, block in found)
        yield from _batched(rows, pa.schema([*((c, pa.string()) for c in columns), ("verified", pa.bool_())]))

    return _files(spark, path).mapInArrow(run, "type string, id string, refers_to string, uri string, date string, digest string, source string, block string, verified boolean")


def derived(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", captured: str = CAPTURED) -> DataFrame:
    """key, uri, response_id, metadata_id, conversion_id, payload_digest,
    metadata_digest, conversion_digest, title, outlinks, text, verified: a row
    for each row of ``pages``, from the written derivative files.

    Null urls, pages and keys are empty (the key comes back null); an empty
    page has an empty text; pages with equal key, url and content share their
    ids, and each comes back; an empty table gives no rows; other columns
    are not read.
    """
    spark = pages.sparkSession
    first, second = shared_path(spark, "responses"), shared_path(spark, "derivatives")
    write_responses(pages, first, key, url, html, captured)
    write_derivatives(spark, first, second)
    rows = read_records(spark, second)

    def said(name: str):
        return F.regexp_extract("block", rf"(?m)^{name}: ?(.*?)\r?$", 1)

    kind = pages.schema[key].dataType.simpleString()
    meta = F.struct(
        F.when(F.col("source") != "", F.col("source")).cast(kind).alias(key), "uri", F.col("id").alias("metadata_id"),
        said("source-payload-digest").alias("payload_digest"), F.col("digest").alias("metadata_digest"), said("title").alias("title"),
        F.regexp_count("block", F.lit(r"(?m)^outlink: ")).cast("long").alias("outlinks"), (F.col("verified") & (said("source-verified") == "true")).alias("ok"))
    text = F.struct(F.col("id").alias("conversion_id"), F.col("digest").alias("conversion_digest"), F.col("block").alias("text"), F.col("verified").alias("whole"))
    # equal response ids mean equal pages: repeated rows are counted and dealt out again
    one = rows.select(F.col("refers_to").alias("response_id"), F.when(F.col("type") == "metadata", meta).alias("m"), F.when(F.col("type") == "conversion", text).alias("t")) \
        .groupBy("response_id").agg(F.max("m").alias("m"), F.max("t").alias("t"), F.count("m").alias("n")).where("m IS NOT NULL AND t IS NOT NULL")
    out = one.select("response_id", "m.*", "t.*", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("_copy"))
    return out.withColumn("verified", F.col("ok") & F.col("whole")).select(
        "response_id", key, "uri", "metadata_id", "payload_digest", "metadata_digest", "title", "outlinks", "conversion_id", "conversion_digest", "text", "verified")
