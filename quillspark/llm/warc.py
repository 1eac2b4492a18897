r"""WARC transaction assembly: request, response and metadata records joined through their concurrent-to identifiers.

*Records.* ``read`` streams records from .warc and .warc.gz files (one gzip member a record or not); ``parsed`` takes raw records apart,
in SQL expressions: header names are case-insensitive, lines may be folded, WARC-Concurrent-To may be repeated. Records, blocks and payloads are bytes all the way: a block is
cut to its Content-Length in bytes, and only headers and fields are decoded, as UTF-8, with U+FFFD for what isn't.

*Captures.* Concurrent-to links are followed in both directions, over any number of records; what they connect is one
capture. Its row has the response's columns, its HTTP status, headers and payload, and nested: ``requests`` and ``metadata`` (arrays by record_id),
``request`` (the first of the requests) and ``others``, the identifiers of the further requests and of whatever else belongs to it. If several responses
are connected, each has a row; any other record goes to the response that it names, else to one that names it, else to that of a record that it names (of
several the least record_id), and what is left to the least of the responses. A capture without a response has a row with null response columns, under its least record_id.

*At scale.* Records that are connected with one response and nothing else, as most are, are told by two shuffles of identifiers; only the links between the others (pairs of
identifiers) go through ``components``, if there are any. Requests and metadata, which are small, are shuffled twice: by record_id, to drop repeats and learn the response that they belong to, and by that
response. Payloads go through one shuffle, by record_id, that both drops repeated records and joins the rest. A record that more than ``hot`` others are
connected with (a warcinfo record, say) is no skew: what is known of it reaches them by a broadcast.

*Odd input.* Records with a null or empty record_id, and raw records that are null or don't begin with ``WARC/``, are left out. Repeated record_ids are
one record, the least by (type, target, date, block). Nested records tie in nothing, as their identifiers differ. A link to a missing record still connects those that share it. Links to
itself, nulls and repeats don't matter. A missing block is empty; a block without an empty line is all header; a record shorter than its Content-Length has what there is; headers and
payloads may have any length. An empty table gives no captures. Extra columns of records are not read, whatever their names. ``from_pages``: a page without page_id has no records; a null url is an empty
target URI, a null html an empty payload; page ids of any type will do; pages that are the same in all three columns are one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.shared import attached, column, components, cut

RECORD = "record_id string, type string, concurrent_to array<string>, target_uri string, date string, content_type string, block binary"


BREAK = "\r\n\r\n"


def head_of(block: Column) -> Column:
    """Bytes before the first empty line, all if there is none, as a string that need not be valid: it is searched byte by byte, and nothing after it is looked at."""
    return F.substring_index(block.cast("string"), BREAK, 1)


def text_of(block: Column) -> Column:
    return F.make_valid_utf8(block.cast("string"))


def parsed(raw: DataFrame, name: str = "raw") -> DataFrame:
    """Columns of ``RECORD`` for each raw record, given as bytes or as text."""
    r = raw.select(column(raw, name).cast("binary").alias("raw")).where(F.substring("raw", 1, 5) == F.lit(b"WARC/"))
    r = r.withColumn("own", head_of(F.col("raw")))
    r = r.select(F.make_valid_utf8("own").alias("head"), "raw", (F.octet_length("own") + len(BREAK) + 1).alias("start"))
    # a folded line goes on with a space or tab
    lines = F.split(F.regexp_replace("head", "\r\n[ \t]+", " "), "\r\n")
    r = r.withColumn("fields", F.transform(F.filter(lines, lambda x: F.instr(x, ":") > 0), lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("v"))))

    def one(key: str) -> Column:
        return F.try_element_at(F.filter("fields", lambda f: f["k"] == key), F.lit(1))["v"]

    return r.select(
        one("warc-record-id").alias("record_id"),
        F.lower(one("warc-type")).alias("type"),
        F.transform(F.filter("fields", lambda f: f["k"] == "warc-concurrent-to"), lambda f: f["v"]).alias("concurrent_to"),
        one("warc-target-uri").alias("target_uri"),
        one("warc-date").alias("date"),
        one("content-type").alias("content_type"),
        F.substring("raw", F.col("start"), F.coalesce(F.greatest(one("content-length").try_cast("int"), F.lit(0)), F.octet_length("raw"))).alias("block"),
    )


def _http(block: Column, own: Column) -> tuple[Column, Column, Column]:
    """(first line, further header lines, payload) of an HTTP message with the given header."""
    head = F.make_valid_utf8(own)
    return F.substring_index(head, "\r\n", 1), F.when(F.instr(head, "\r\n") > 0, F.substring(head, F.instr(head, "\r\n") + 2, F.length(head))).otherwise(""), F.substring(block, F.octet_length(own) + len(BREAK) + 1, F.octet_length(block))


def _leaves(narrow: DataFrame, links: DataFrame, is_response: Column, hot: int, n: int) -> DataFrame:
    """(``record_id``, ``capture``, ``ends``) of the records, not responses, that are connected with one record alone, if that is a response; ``ends``: how many links tie the two.

    They belong to that response whatever else it is connected with, and nothing is connected through them.
    """
    ends = links.select(F.explode(F.array(F.struct(F.col("record_id").alias("node"), F.col("to").alias("x")), F.struct(F.col("to").alias("node"), F.col("record_id").alias("x")))).alias("e")).select("e.*")
    ends = ends.union(narrow.where(is_response).select("record_id", F.lit(None).cast("string")))
    # a response counts as a node with a null neighbour
    nodes = ends.groupBy("node").agg(F.min("x").alias("capture"), F.max("x").alias("last"), F.count("x").alias("ends"), F.count("*").alias("rows"))
    lone = nodes.where("capture = last and ends = rows").select(F.col("node").alias("record_id"), "capture", "ends")
    # of a record_id that is repeated, every record must be a response
    pure = narrow.groupBy(F.col("record_id").alias("capture")).agg(F.min(is_response).alias("pure")).where("pure")
    return attached(lone, pure, "capture", hot, n).where("pure").select("record_id", "capture", "ends")


def _connected(links: DataFrame, responses: DataFrame, hot: int, n: int) -> DataFrame:
    """(``record_id``, ``capture``) of all ends of the ``n`` links; ``responses``: the identifiers (``node``) that are responses."""
    group = components(links, "record_id", "to", hot=hot)
    # the response that has the rest of its capture: the least of those connected
    answered = group.join(responses, "node", "left_semi")
    heads = answered.groupBy("root").agg(F.min("node").alias("head"), F.max("node").alias("last"))
    heads = cut(heads.select("root", "head", (F.col("head") != F.col("last")).alias("several")))
    # of n links there are 2 n nodes at most
    out = attached(group, heads.select("root", "head"), "root", hot, 2 * n)
    if heads.where("several").isEmpty():
        return out.select(F.col("node").alias("record_id"), F.coalesce("head", "root").alias("capture"))
    # where there are several, a record's own links come first
    rivals = answered.join(heads.where("several"), "root", "left_semi").select("node")
    named = links.join(rivals, F.col("to") == F.col("node")).select("record_id", F.lit(0).alias("rank"), F.col("to").alias("owner"))
    named = named.union(links.join(rivals, F.col("record_id") == F.col("node")).select(F.col("to").alias("record_id"), F.lit(1).alias("rank"), F.col("node").alias("owner")))
    near = named.groupBy(F.col("record_id").alias("via")).agg(F.min(F.struct("rank", "owner"))["owner"].alias("owner"))
    by_way = attached(links.withColumnRenamed("to", "via"), near, "via", hot, n).where("owner is not null")
    named = named.union(by_way.select("record_id", F.lit(2).alias("rank"), "owner"))
    owners = named.groupBy(F.col("record_id").alias("node")).agg(F.min(F.struct("rank", "owner"))["owner"].alias("owner"))
    return out.join(owners, "node", "left").select(F.col("node").alias("record_id"), F.coalesce("owner", "head", "root").alias("capture"))


def captures(records: DataFrame, hot: int = 1_000_000) -> DataFrame:
    """One nested row for each capture; see the module. ``records`` has the columns of ``RECORD``."""
    r = records.select(*[column(records, c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in RECORD.split(", ")]).where("record_id is not null and record_id <> ''")
    is_response = F.coalesce(F.col("type") == "response", F.lit(False))
    # everything but the payloads is written once, so raw records are taken apart twice in all
    narrow = cut(r.select("record_id", "type", "concurrent_to", *[F.when(~is_response, F.col(c)).alias(c) for c in ("target_uri", "date", "block")]))
    links = narrow.select("record_id", F.explode("concurrent_to").alias("to")).where("to is not null and to <> ''")
    n = links.count()
    placed = cut(_leaves(narrow, links, is_response, hot, n))
    # each link of a leaf has one end there, so this many are left
    left = n - (placed.agg(F.sum("ends")).first()[0] or 0)
    placed = placed.select("record_id", "capture")
    if left:
        if left < n:
            for end in ("record_id", "to"):
                links = attached(links, placed.select(F.col("record_id").alias(end), F.lit(True).alias("leaf")), end, hot, n).where("leaf is null").drop("leaf")
            links = cut(links)
        placed = placed.union(_connected(links, narrow.where(is_response).select(F.col("record_id").alias("node")), hot, left))
    responses, rest = r.where(is_response), narrow.where(~is_response)
    small = rest.groupBy("record_id").agg(F.min(F.struct("type", "target_uri", "date", "block")).alias("x")).select("record_id", "x.*")
    small = small.join(placed, "record_id", "left").withColumn("capture", F.coalesce("capture", "record_id"))
    small = small.withColumn("block", F.coalesce("block", F.lit(b""))).withColumn("own", head_of(F.col("block")))
    line, lines, payload = _http(F.col("block"), F.col("own"))
    small = small.select(
        "capture",
        F.when(F.col("type") == "request", F.struct("record_id", F.element_at(F.split(line, " "), 1).alias("method"), F.try_element_at(F.split(line, " "), F.lit(2)).alias("path"), lines.alias("headers"), payload.alias("body"))).alias("request"),
        F.when(F.col("type") == "metadata", F.struct("record_id", "date", text_of(F.col("block")).alias("fields"))).alias("metadata"),
        F.when(F.coalesce(~F.col("type").isin("request", "metadata"), F.lit(True)), F.col("record_id")).alias("other"),
        "target_uri",
        "date",
    )
    small = small.groupBy("capture").agg(F.sort_array(F.collect_list("request")).alias("requests"), F.sort_array(F.collect_list("metadata")).alias("metadata"), F.sort_array(F.collect_list("other")).alias("others"), F.min("target_uri").alias("uri_"), F.min("date").alias("date_"))
    big = responses.groupBy("record_id").agg(F.min(F.struct("target_uri", "date", "content_type", "block")).alias("x")).select("record_id", "x.*")
    both = big.join(small.withColumnRenamed("capture", "record_id"), "record_id", "full_outer")
    both = both.withColumn("own", head_of(F.col("block")))
    line, lines, payload = _http(F.col("block"), F.col("own"))
    return both.select(
        "record_id",
        F.coalesce("target_uri", "uri_").alias("target_uri"),
        F.coalesce("date", "date_").alias("date"),
        F.substring_index(F.substring_index(line, " ", 2), " ", -1).try_cast("int").alias("status"),
        lines.alias("headers"),
        F.when(F.col("block").isNotNull(), payload).alias("payload"),
        F.try_element_at("requests", F.lit(1)).alias("request"),
        F.coalesce("requests", F.array().cast("array<struct<record_id:string,method:string,path:string,headers:string,body:binary>>")).alias("requests"),
        F.coalesce("metadata", F.array().cast("array<struct<record_id:string,date:string,fields:string>>")).alias("metadata"),
        F.coalesce(F.sort_array(F.concat("others", F.transform(F.slice("requests", 2, F.greatest(F.size("requests") - 1, F.lit(0))), lambda x: x["record_id"]))), F.array().cast("array<string>")).alias("others"),
    )


def uuid_of(*parts: Column | str) -> Column:
    """A record identifier made from the parts."""
    h = F.md5(F.concat_ws(":", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def from_pages(pages: DataFrame) -> DataFrame:
    """Raw records (``raw``, bytes) of the three kinds for each page (page_id, url, html), as a crawler would have written them."""
    p = pages.select(column(pages, "page_id").cast("string").alias("page_id"), F.coalesce(column(pages, "url"), F.lit("")).alias("url"), F.coalesce(column(pages, "html"), F.lit("")).alias("html")).where("page_id is not null")
    p = p.withColumn("h", F.md5("html"))
    response, date = uuid_of(F.lit("response"), "page_id", "url", "h"), F.lit("2024-01-01T00:00:00Z")
    path = F.regexp_replace("url", "^[a-z]+://[^/?#]*", "")
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    body = {
        "response": F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit("\r\n\r\n"), "html"),
        "request": F.concat(F.lit("GET "), F.when(F.regexp_replace(path, "#.*$", "") == "", "/").otherwise(F.regexp_replace(path, "#.*$", "")), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n")),
        "metadata": F.concat(F.lit("charset-detected: utf-8\r\nfetchTimeMs: "), F.coalesce(F.expr("cast(pmod(try_cast(page_id as bigint), 1000) as string)"), F.lit("0")), F.lit("\r\n")),
    }
    made = []
    for kind, block in body.items():
        ident = response if kind == "response" else uuid_of(F.lit(kind), "page_id", "url", "h")
        head = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: "), ident, F.lit("\r\nWARC-Date: "), date, F.lit("\r\nWARC-Target-URI: "), F.col("url")]
        if kind != "response":
            head += [F.lit("\r\nWARC-Concurrent-To: "), response]
        mime = "application/warc-fields" if kind == "metadata" else f"application/http; msgtype={kind}"
        made.append(F.concat(*head, F.lit(f"\r\nContent-Type: {mime}\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block))
    return p.select(F.explode(F.array(*made)).alias("raw")).select(F.col("raw").cast("binary").alias("raw"))


def _stream(path: str) -> Iterator[bytes]:
    """Bytes of a file on any file system that pyarrow knows, decompressed if it is gzip."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    with system.open_input_stream(name, compression=None) as f:
        chunk = f.read(1 << 20)
        if chunk[:2] != b"\x1f\x8b":
            while chunk:
                yield chunk
                chunk = f.read(1 << 20)
            return
        z = zlib.decompressobj(31)
        while chunk:
            out = z.decompress(chunk)
            if out:
                yield out
            chunk = z.unused_data
            if z.eof:
                z = zlib.decompressobj(31)
            if not chunk:
                chunk = f.read(1 << 20)


def records_of(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Raw records, each its header and the block of the length that it gives."""
    have = b""
    ended = False
    while True:
        at = have.find(b"\r\n\r\n")
        while at < 0 and not ended:
            more = next(chunks, None)
            ended = more is None
            have += more or b""
            at = have.find(b"\r\n\r\n")
        start = len(have) - len(have.lstrip(b"\r\n"))
        if start:
            have = have[start:]
            continue
        if at < 0:
            return
        n = 0
        for x in have[:at].split(b"\r\n"):
            k, _, v = x.partition(b":")
            if k.strip().lower() == b"content-length" and v.strip().isdigit():
                n = int(v)
        parts, size = [have], len(have)
        while size < at + 4 + n and not ended:
            more = next(chunks, None)
            ended = more is None
            parts.append(more or b"")
            size += len(more or b"")
        have = b"".join(parts)
        yield have[: at + 4 + n]
        have = have[at + 4 + n :]


def read(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Records of WARC files, one task a file, streamed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column(0).to_pylist():
                held, size = [], 0
                for raw in records_of(_stream(p)):
                    held.append(raw)
                    size += len(raw)
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["raw"])
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["raw"])

    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return parsed(listed.mapInArrow(run, "raw binary"))


def flat(captures_: DataFrame) -> DataFrame:
    """Captures with the nested columns as JSON (bodies of requests in base 64), the payload as text, and the MD5 of its bytes."""
    return captures_.select("record_id", "target_uri", "date", "status", "headers", text_of(F.col("payload")).alias("payload"), F.md5("payload").alias("payload_md5"), F.to_json("request").alias("request"), F.to_json("metadata").alias("metadata"), F.to_json("others").alias("others"))


#: flat(captures(parsed(from_pages(pages)))) in SQL.
SQL = r"""
WITH p AS (SELECT DISTINCT page_id::VARCHAR AS page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages WHERE page_id IS NOT NULL),
k AS (SELECT *, ':' || page_id || ':' || url || ':' || md5(html) AS k FROM p),
m AS (SELECT *, md5('response' || k) AS a, md5('request' || k) AS b, md5('metadata' || k) AS c FROM k),
u AS (SELECT *, regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '#.*$', '') AS path, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host,
  '<urn:uuid:' || substr(a, 1, 8) || '-' || substr(a, 9, 4) || '-' || substr(a, 13, 4) || '-' || substr(a, 17, 4) || '-' || substr(a, 21, 12) || '>' AS ida,
  '<urn:uuid:' || substr(b, 1, 8) || '-' || substr(b, 9, 4) || '-' || substr(b, 13, 4) || '-' || substr(b, 17, 4) || '-' || substr(b, 21, 12) || '>' AS idb,
  '<urn:uuid:' || substr(c, 1, 8) || '-' || substr(c, 9, 4) || '-' || substr(c, 13, 4) || '-' || substr(c, 17, 4) || '-' || substr(c, 21, 12) || '>' AS idc FROM m)
SELECT ida AS record_id, url AS target_uri, '2024-01-01T00:00:00Z' AS date, 200 AS status, 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) AS headers, html AS payload, md5(html) AS payload_md5,
  '{"record_id":"' || idb || '","method":"GET","path":"' || CASE WHEN path = '' THEN '/' ELSE path END || '","headers":"Host: ' || host || '","body":""}' AS request,
  '[{"record_id":"' || idc || '","date":"2024-01-01T00:00:00Z","fields":"charset-detected: utf-8\r\nfetchTimeMs: ' || coalesce(try_cast(page_id AS BIGINT) % 1000, 0) || '\r\n"}]' AS metadata, '[]' AS others FROM u
"""
