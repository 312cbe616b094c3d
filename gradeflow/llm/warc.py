"""WARC archives: written once, indexed per record, read back by coalesced byte ranges."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import scratch_path, small_blocks, written

LEAST_REVISIT = 1000   # bytes of payload from which equal payloads are stored once
COALESCE_GAP = 64 << 10
COALESCE_BYTES = 8 << 20
FILE_BYTES = 256 << 20
# The date of records whose capture time is unknown, so that a repeated run writes the same bytes.
UNKNOWN_DATE = "1970-01-01T00:00:00Z"

INDEX = ("page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, "
         "file string, offset long, length long")


def _url(url: str | None) -> str:
    """A header value: line ends would end the header."""
    return (url or "").replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, kind: str, refers_to: int | None, digest: str, size: int,
           payload: bytes) -> bytes:
    """One gzip member with one record. The digest header is base32, as archives have it."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>",
             f"WARC-Date: {UNKNOWN_DATE}", f"WARC-Target-URI: {_url(url)}",
             f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
             f"X-Payload-Length: {size}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: <urn:page:{refers_to}>"]
    else:
        lines.append("Content-Type: text/html")
    lines += [f"Content-Length: {len(payload)}", "", ""]
    return gzip.compress("\r\n".join(lines).encode() + payload + b"\r\n\r\n", 4, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return headers, rest[:int(headers["Content-Length"])]


def _files(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """Write a record per row; returns the index: id, url, type, refers_to, digest, file, offset, length.

    Of rows with equal payloads of at least ``least`` bytes the one with the largest id is a
    response (a null id is the smallest; of rows that repeat id and payload one), the others
    revisit it. Null html is an empty payload. An empty table gives an empty index. Each task
    writes files of its own under new names, so a task that runs again never touches another's;
    the index, itself a table, names only files of tasks that succeeded.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        payload.alias("payload"))
    facts = rows.select("page_id", "url", F.sha1("payload").alias("sha"), F.sha2("payload", 256).alias("sha2"),
                        F.length("payload").cast("long").alias("size"), "payload")
    # Types follow from ids and digests alone. What is decided is written, so that Spark knows its
    # size: while it is small it is broadcast and payloads stay where they are, else they move once.
    narrow = facts.where(F.col("size") >= least).drop("payload", "sha")
    groups = (narrow.groupBy("sha2", "size").agg(F.max("page_id").alias("best"), F.count("*").alias("copies"))
              .where("copies > 1").drop("copies"))
    copies = written(narrow.join(groups, ["sha2", "size"]).groupBy("page_id", "sha2", "size")
                     .agg(F.max("best").alias("best"), F.count("*").alias("same"),
                          F.min(F.struct(F.col("url"))).alias("first"))
                     .toDF("own", "own_sha2", "own_size", "best", "same", "first"), "warc-copies")
    twice = "same > 1 and own <=> best"
    meets = F.expr("page_id <=> own and sha2 = own_sha2 and size = own_size")
    decided = (facts.join(copies, meets, "left").where(f"same is null or not ({twice})")
               .withColumn("response", F.expr("same is null or page_id <=> best")))
    # Rows that repeat id and payload: equal ones are counted before they move, and the first is the response.
    repeated = (facts.join(written(copies.where(twice), "warc-repeated"), meets)
                .groupBy("page_id", "url", "sha", "size", "best", F.col("url").eqNullSafe(F.col("first.url")).alias("lowest"))
                .agg(F.any_value("payload").alias("payload"), F.count("*").alias("rows"))
                .withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
                .withColumn("response", F.expr("lowest and turn = 1")))
    wanted = ["page_id", "url", "sha", "size", "response", "best", "payload"]
    kinds = decided.select(*wanted).unionByName(repeated.select(*wanted)).select(
        *wanted[:5], F.expr("if(response, null, best)").alias("refers_to"),
        F.expr("if(response, payload, null)").alias("payload"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = _files(folder)
        where.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        for block in small_blocks(batches, "payload"):
            index = []
            for page, url, sha, size, response, refers, body in zip(*(c.to_pylist() for c in block.columns)):
                kind = "response" if response else "revisit"
                member = record(page, url, kind, refers, sha, size, body or b"")
                if out is None or at > FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = where.open_output_stream(f"{base}/{name}", compression=None)
                out.write(member)
                index.append((page, url, kind, refers, sha, size, name, at, len(member)))
                at += len(member)
            types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index), types)], names)
        if out is not None:
            out.close()

    names = [part.split()[0] for part in INDEX.split(", ")]
    index = written(kinds.mapInArrow(run, INDEX), "warc-index")
    return index.select(*names[:6], F.concat(F.lit(folder + "/"), "file").alias("file"), "offset", "length")


def read_records(index: DataFrame, content: bool = True) -> DataFrame:
    """Records of an index (all or a selection): what headers and payload say, read by byte ranges.

    Rows are sorted by file and offset; neighbouring ranges are read in one request of a bounded
    size. Gives page_id, payload_bytes, payload_digest, record_type, refers_to and, if
    ``content``, the payload. A response's length and digest come from the bytes read and must
    equal its header.
    """
    def ranges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[str, object] | None = None
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))))
            first = 0
            while first < len(rows):
                name, start, length = rows[first]
                end, last = start + length, first + 1
                while (last < len(rows) and rows[last][0] == name and rows[last][1] <= end + COALESCE_GAP
                       and rows[last][1] + rows[last][2] - start <= COALESCE_BYTES):
                    end = max(end, rows[last][1] + rows[last][2])
                    last += 1
                if opened is None or opened[0] != name:
                    where, path = _files(name)
                    opened = name, where.open_input_file(path)
                opened[1].seek(start)
                data = opened[1].read(end - start)
                yield settled([parse(data[o - start:o - start + n]) for _, o, n in rows[first:last]])
                first = last

    def settled(found: list[tuple[dict[str, str], bytes]]) -> pa.RecordBatch:
        out = []
        for headers, payload in found:
            kind = headers["WARC-Type"]
            digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
            size = int(headers["X-Payload-Length"])
            if kind == "response" and (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
                raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
            refers = headers.get("WARC-Refers-To")
            page = [None if x in (None, "None") else int(x) for x in
                    (headers["WARC-Record-ID"][10:-1], refers and refers[10:-1])]
            out.append((page[0], size, digest, kind, page[1], payload))
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        columns = [pa.array(c, t) for c, t in zip(zip(*out), types)]
        return pa.RecordBatch.from_arrays(columns[:len(names)], names)

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + (["payload"] if content else [])
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return (index.select("file", "offset", "length").repartitionByRange("file", "offset")
            .sortWithinPartitions("file", "offset")
            .mapInArrow(ranges, schema + (", payload binary" if content else "")))
