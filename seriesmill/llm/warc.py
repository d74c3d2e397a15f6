"""WARC archives with revisit resolution.

Headers (page id, digest, size) are shuffled by payload digest, payloads never are:
the smallest page id of each digest becomes the response and the rest revisit it.
A payload whose digest occurs once goes straight into its record; which ones may
occur again is told by a bit map of fixed size. Of the others only the responses'
payloads are moved, by the number of their row, so that a payload of a third of
all pages travels once. The archives are written with fresh headers by Spark's own
text writer: a WARC record ends in CRLF CRLF, which is given as the line separator,
so the files go to whatever store Spark can write to and a lost task is just rerun.
A file holds at most ``records_per_file`` records, which bounds what a reader has
in memory; reading follows Content-Length, since payloads may hold any bytes.

Null html: empty payload. Null page id: after all others; ids may have any type with
an order, and go percent-encoded into headers. Several pages with the same id and
payload: one of them is the response. Very long payloads are written whole; a
reader holds a file, so fewer records to a file suit them. Null url: a record with
no target URI. Empty table: no records. Payloads shorter than ``min_payload`` bytes
are all responses. Other columns of the table, of any name, are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, bit_map, row_id, with_mark

REVISIT_PROFILE = "http://netpreservefoundation.org/warc/1.0/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
UNSAFE = re.compile(r"[\x00-\x20\x7f]")
#: Places of the bit maps; more keys only let more rows through to the exact joins.
MAP_BITS = 1 << 23
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL namespace of RFC 4122


def record_id(page_id, uid) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'page:{page_id}:{uid}')}>"


def record(page_id, uid, url, html, n: int, digest: str, original, original_uid, date: str) -> str:
    """One WARC record of a payload of n bytes without its closing CRLF CRLF; ``original_uid`` is null for a response."""
    html = html or ""
    head = ["WARC/1.0", f"WARC-Type: {'response' if original_uid is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, uid)}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {n}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {quote(page_id, safe='')}")
    if url is not None:
        head.append("WARC-Target-URI: " + UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if original_uid is None:
        body = HTTP.format(n) + html
        head.append("Content-Type: application/http; msgtype=response")
    else:
        body = ""
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(original, original_uid)}"]
        if original is not None:
            head.append(f"X-Refers-To-Page-Id: {quote(original, safe='')}")
    return "\r\n".join([*head, f"Content-Length: {len(body.encode())}", "", body])


def write_archives(pages: DataFrame, path: str, *, min_payload: int = 0, date: str = "2024-01-01T00:00:00Z", records_per_file: int = 2000, tables: Tables) -> None:
    """Writes one record per row of pages(page_id, url, html) to ``path``."""
    # the table is scanned more than once, and every scan must number its rows alike
    uid = row_id(pages)
    if uid is None:
        pages = tables.save(pages.select("page_id", "url", "html"), "pages")
        uid = row_id(pages)
    body = F.coalesce("html", F.lit("")).cast("binary")
    p = pages.select("page_id", "url", "html", uid.alias("uid"), F.sha1(body).alias("sha"), F.length(body).cast("long").alias("n"))
    heads = tables.save(p.drop("html"), "heads")
    # the first of each digest, and only digests that occur again
    first = F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id", "uid")).alias("first")
    again = heads.where(F.col("n") >= min_payload).groupBy("sha").agg(first, F.count("*").alias("c")).where("c > 1")
    again = tables.save(again.select("sha", F.col("first.page_id").alias("o_id"), F.col("first.uid").alias("o_uid")), "first")
    digest = F.xxhash64("sha")
    repeated = tables.save(bit_map(again, digest, MAP_BITS), "repeated")
    once = with_mark(p, digest, repeated, MAP_BITS).where(~F.col("__maybe") | (F.col("n") < min_payload)).drop("__maybe")
    joined = with_mark(heads, digest, repeated, MAP_BITS).where(F.col("__maybe") & (F.col("n") >= min_payload)).drop("__maybe").join(again, "sha", "left")
    joined = tables.save(joined.withColumn("revisit", F.coalesce(F.col("o_uid") != F.col("uid"), F.lit(False))), "joined")
    kept = joined.where(~F.col("revisit")).drop("o_id", "o_uid", "revisit")
    place = tables.save(bit_map(kept, F.col("uid"), MAP_BITS), "place")
    payloads = with_mark(pages.select(uid.alias("uid"), "html"), F.col("uid"), place, MAP_BITS).where("__maybe").drop("__maybe")
    q = once.unionByName(kept.join(payloads, "uid")).unionByName(joined.where("revisit").drop("revisit"), allowMissingColumns=True)
    # numbers as text: pandas would turn a whole-number column with nulls into floats
    q = q.select("url", "html", "n", "sha", *[F.col(c).cast("string").alias(c) for c in ("page_id", "uid", "o_id", "o_uid")])

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for url, html, n, sha, i, u, o, ou in zip(*(b[c] for c in b.columns), strict=True):
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                out.append(record(i, u, url, html, n, digest, o, ou, date))
            yield pd.DataFrame({"value": out})

    q.mapInPandas(lines, "value string").write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)
    tables.drop("pages", "heads", "first", "repeated", "joined", "place")


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
        start = end + 4
        stop = start + int(head["Content-Length"])
        yield head, data[start:stop]
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError("a record does not end in CRLF CRLF")
        at = stop + 4


READ = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, html string"


def read_archives(spark, path: str, payloads: bool = True, id_type: str = "long") -> DataFrame:
    """A row per record, with page ids of a type; html is null for revisits, or where payloads are not wanted. Each response's digest is computed again and compared."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["content"]:
                out = []
                for head, block in parsed(gzip.decompress(data)):
                    digest, html = head["WARC-Payload-Digest"].removeprefix("sha1:"), None
                    if head["WARC-Type"] == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != int(head["X-Payload-Length"]):
                            raise ValueError(f"payload of {head['WARC-Record-ID']} does not match its header")
                        html = payload.decode() if payloads else None
                    name = lambda k: unquote(head[k]) if k in head else None  # noqa: B023, E731
                    out.append((name("X-Page-Id"), head.get("WARC-Target-URI"), int(head["X-Payload-Length"]), digest, head["WARC-Type"], name("X-Refers-To-Page-Id"), html))
                yield pd.DataFrame(out, columns=[x.split()[0] for x in READ.split(", ")], dtype=object)

    return files.mapInPandas(rows, READ).withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def op9_warc(spark, sf_dir):
    tables = Tables(spark, "warc")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    write_archives(pages, tables.path("archives"), tables=tables)
    return read_archives(spark, tables.path("archives"), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op9_warc": op9_warc}
# DuckDB has no base32 function: the digest is put together from its bits.
WARC_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS x FROM p),
b AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS o FROM d),
e AS (SELECT *, array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform(range(0, 4), lambda j:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, (i * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * j)) & 31)::INT + 1, 1)), '')), '') AS payload_digest FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = o THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = o THEN NULL ELSE o END AS refers_to FROM e
"""
ORACLE = {"op9_warc": WARC_SQL}
