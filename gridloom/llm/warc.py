"""WARC output and input, index first.

Writing returns an index with the file, offset, length, URL and digest of every record. Reading starts from
the index: the selected records' byte ranges are sorted by file, ranges that touch or nearly touch become one
read, and each read is cut into its records again.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import filesystem, slots, table, work_dir

#: A file is closed at the first record end past so many bytes.
FILE_BYTES = 64 << 20
#: Ranges of one file closer than this are read together, up to READ_BYTES.
GAP_BYTES = 64 << 10
READ_BYTES = 8 << 20
_INDEX = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, file string, offset long, length long"
_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def header_url(url: str) -> str:
    """The URL with blanks and control characters percent-encoded, so that it stays on one header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def base32_sha1(hexadecimal: str) -> str:
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, refers_url: str | None = None) -> bytes:
    """One gzip member with one WARC/1.1 record; ``refers_to`` makes it a revisit, which has no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        *([] if url is None else [f"WARC-Target-URI: {header_url(url)}"]),
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def parse(member: bytes) -> dict:
    """The fields of one record. A response's size and digest are taken from its payload, a revisit's from
    its headers, as its payload lies elsewhere."""
    head, _, rest = gzip.decompress(member).partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields["WARC-Type"] == "revisit"
    number = lambda name: None if (x := fields[name][10:-1]) == "none" else int(x)
    return {
        "page_id": number("WARC-Record-ID"),
        "payload_bytes": int(re.search(rb"Content-Length: (\d+)", http)[1]) if revisit else len(payload),
        "payload_digest": fields["WARC-Payload-Digest"][5:] if revisit else base64.b32encode(hashlib.sha1(payload).digest()).decode(),
        "record_type": fields["WARC-Type"],
        "refers_to": number("WARC-Refers-To") if revisit else None,
        "payload": None if revisit else payload,
    }


def record_roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, sha1, n_bytes, refers_to for each page: null for a response.

    Only digests are shuffled. The smallest page_id of each digest is pre-aggregated by every map task, so
    that a digest of a third of all pages is one row of each; the join back is one that Spark can split.
    """
    html = F.coalesce("html", F.lit(""))
    digests = pages.select("page_id", F.sha1(html.cast("binary")).alias("sha1"), F.octet_length(html).cast("long").alias("n_bytes"))
    first = digests.groupBy("sha1").agg(F.min("page_id").alias("first_id"))
    other = (F.col("n_bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return digests.join(first, "sha1").select("page_id", "sha1", "n_bytes", F.when(other, F.col("first_id")).alias("refers_to"), other.alias("revisit"))


def write_warc(pages: DataFrame, folder: str, least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record per page to ``folder`` and return the index.

    Of records with equal payloads of at least ``least_bytes``, that with the smallest page_id is the
    response; rows that repeat its page_id are responses too. Null html is an empty payload, a null url has
    no target line, a null page_id sorts last and becomes a response only where no other page has its payload.
    """
    spark = pages.sparkSession
    filesystem(folder)[0].create_dir(filesystem(folder)[1], recursive=True)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        fs, path = filesystem(folder)
        stem, n, out, name, at = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}", 0, None, "", 0
        for batch in batches:
            told = []
            for page, url, html, sha1, size, refers, revisit in batch.itertuples(index=False):
                if out is None:
                    name, at = f"{stem}-{n:05d}.warc.gz", 0
                    out, n = fs.open_output_stream(f"{path}/{name}", compression=None), n + 1
                page, refers = None if pd.isna(page) else int(page), int(refers) if revisit else None
                digest = base32_sha1(sha1)
                data = record(page, url, (html or "").encode(), int(size), digest, refers)
                out.write(data)
                told.append((page, url, "revisit" if revisit else "response", refers, digest, int(size), f"{folder}/{name}", at, len(data)))
                at += len(data)
                if at >= file_bytes:
                    out.close()
                    out = None
            frame = pd.DataFrame(told, columns=[c.split()[0] for c in _INDEX.split(", ")])
            yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})
        if out is not None:
            out.close()

    roles = record_roles(pages, least_bytes).dropDuplicates(["page_id", "sha1"])
    html = F.coalesce("html", F.lit(""))
    full = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("sha1")).alias("p")
    same = F.col("p.page_id").eqNullSafe(F.col("r.page_id")) & (F.col("p.sha1") == F.col("r.sha1"))
    joined = full.join(roles.alias("r"), same).select("p.page_id", "p.url", F.when(~F.col("revisit"), F.col("html")).alias("html"), "p.sha1", "n_bytes", "refers_to", "revisit")
    joined.mapInPandas(write, _INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(_INDEX).parquet(f"{folder}/index")


def coalesced_reads(index: DataFrame, gap: int = GAP_BYTES, most: int = READ_BYTES) -> DataFrame:
    """file, start, size, records (array of place and length within the read), for the index rows given.

    Ranges sorted by file and offset start a new read after a wide gap or at the next multiple of ``most``.
    """
    order = W.partitionBy("file").orderBy("offset")
    end = F.max(F.col("offset") + F.col("length")).over(order.rowsBetween(W.unboundedPreceding, -1))
    cut = end.isNull() | (F.col("offset") - end > gap) | (F.floor(F.col("offset") / most) > F.floor(F.lag("offset").over(order) / most))
    numbered = index.select("file", "offset", "length", cut.cast("int").alias("cut")).withColumn("read", F.sum("cut").over(order))
    grouped = numbered.groupBy("file", "read").agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("stop"), F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records"))
    return grouped.select("file", "start", (F.col("stop") - F.col("start")).alias("size"), "records")


def read_warc(index: DataFrame) -> DataFrame:
    """The records of the index rows given, read from the archives; payload is null for revisits."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, start, size, records in batch.itertuples(index=False):
                fs, path = filesystem(file)
                with fs.open_input_file(path) as f:
                    data = f.read_at(int(size), int(start))
                found = [parse(data[r["offset"] - start : r["offset"] - start + r["length"]]) for r in records]
                yield pd.DataFrame(found, columns=[c.split()[0] for c in _RECORD.split(", ")]).astype({"page_id": "Int64", "refers_to": "Int64"})

    reads = coalesced_reads(index).repartition(slots(index.sparkSession), "file", "start")
    return reads.mapInPandas(read, _RECORD)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_warc(table(spark, sf_dir, "pages"), work_dir(spark, "warc"))
    return read_warc(index).drop("payload")
