"""WARC archives: write, index, and read back by coalesced byte ranges.

Writers put one gzip member per record into archive files of the shared folder and return
the index: page, file, offset, length, URL and digest. Readers take the selected index rows
sorted by file and offset, join neighbouring ranges into one read, and parse the members.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, stage

#: Payloads from this size on are stored once; equal ones revisit the first.
REVISIT_BYTES = 100
#: Bytes of unpacked payloads after which a reader hands on what it holds.
UNPACKED_BYTES = 16 << 20


def member(headers: list[tuple[str, str]], payload: bytes) -> bytes:
    """One record as a gzip member of its own, so that any record can be read alone."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(payload)}\r\n\r\n"
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(head.encode() + payload + b"\r\n\r\n") + z.flush()


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-cased names) and payload of one unpacked record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in head.decode().split("\r\n")[1:])}
    return headers, rest[: int(headers["content-length"])]


def _header_text(url: str | None) -> str:
    """A URL as one header line: line ends and percent signs are escaped."""
    return (url or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def write_archives(pages: DataFrame, folder: str, max_bytes: int = 64 << 20) -> DataFrame:
    """Write the rows of ``pages`` and return their index, itself written.

    ``pages`` has page_id, url, html, payload_bytes, payload_digest, refers_to. Files are
    named by task attempt: a repeated attempt writes files of its own, and only the files
    of attempts that succeeded are in the index.
    """
    schema = (
        "page_id long, file string, offset long, length long, url string, payload_bytes long, "
        "payload_digest string, record_type string, refers_to long"
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        stem, n, out, at = f"{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}", 0, None, 0
        try:
            for batch in batches:
                rows, index = batch.to_pylist(), []
                for r in rows:
                    if out is None or at >= max_bytes:
                        if out is not None:
                            out.close()
                        name, at, n = f"part-{stem}-{n:04d}.warc.gz", 0, n + 1
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    revisit = r["refers_to"] is not None
                    headers = [
                        ("WARC-Type", "revisit" if revisit else "response"),
                        ("WARC-Record-ID", f"<urn:page:{r['page_id']}>"),
                        ("WARC-Target-URI", _header_text(r["url"])),
                        ("WARC-Payload-Digest", f"sha256:{r['payload_digest']}"),
                        ("X-Payload-Length", str(r["payload_bytes"])),
                    ]
                    if revisit:
                        headers.append(("WARC-Refers-To", f"<urn:page:{r['refers_to']}>"))
                    data = member(headers, b"" if revisit else r["html"].encode())
                    out.write(data)
                    index.append((r["page_id"], name, at, len(data), r["url"], r["payload_bytes"], r["payload_digest"], headers[0][1], r["refers_to"]))
                    at += len(data)
                cols = list(zip(*index, strict=True)) or [()] * 9
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=NAMES)
        finally:
            if out is not None:
                out.close()

    NAMES = [x.split()[0] for x in schema.split(", ")]
    columns = ("page_id", "url", "html", "payload_bytes", "payload_digest", "refers_to")
    return stage(pages.select(*columns).mapInArrow(write, schema), "warc-index")


_RECORD = pa.schema(
    [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
)


def range_reader(folder: str, gap: int, most: int, hold: int = UNPACKED_BYTES) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Reads the records of index rows sorted by file and offset; see ``read_records``."""

    def records(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [()] * len(_RECORD)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _RECORD, strict=True)], schema=_RECORD)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        fs, root = pafs.FileSystem.from_uri(folder)
        name, source = None, None
        try:
            for batch in batches:
                rows = batch.to_pylist()
                out: list[tuple] = []
                lo = held = 0
                while lo < len(rows):
                    start, end, hi = rows[lo]["offset"], rows[lo]["offset"] + rows[lo]["length"], lo + 1
                    while (
                        hi < len(rows)
                        and rows[hi]["file"] == rows[lo]["file"]
                        and rows[hi]["offset"] - end <= gap
                        and rows[hi]["offset"] + rows[hi]["length"] - start <= most
                    ):
                        end = rows[hi]["offset"] + rows[hi]["length"]
                        hi += 1
                    if rows[lo]["file"] != name:
                        if source is not None:
                            source.close()
                        name = rows[lo]["file"]
                        source = fs.open_input_file(f"{root}/{name}")
                    data = source.read_at(end - start, start)
                    for r in rows[lo:hi]:
                        if held >= hold:
                            yield records(out)
                            out, held = [], 0
                        at = r["offset"] - start
                        headers, payload = parse(zlib.decompress(data[at : at + r["length"]], 31))
                        kind = headers["warc-type"]
                        digest = headers["warc-payload-digest"].removeprefix("sha256:")
                        n = int(headers["x-payload-length"])
                        if kind == "response":
                            n, found = len(payload), hashlib.sha256(payload).hexdigest()
                            if found != digest:
                                raise ValueError(f"record at {r['offset']} of {name}: digest {found}, index {digest}")
                        other = headers.get("warc-refers-to")
                        refers = int(other.removeprefix("<urn:page:").removesuffix(">")) if other else None
                        out.append((r["page_id"], n, digest, kind, refers, payload))
                        held += len(payload)
                    yield records(out)
                    out, held = [], 0
                    lo = hi
        finally:
            if source is not None:
                source.close()

    return read


def read_records(index: DataFrame, folder: str, gap: int = 64 << 10, most: int = 4 << 20, span: int = 16 << 20) -> DataFrame:
    """Records of the selected index rows, each checked against its digest.

    Tasks take spans of ``span`` bytes of a file, so a large file is read by several, and
    there are as many tasks as the selected bytes fill spans. Ranges at most ``gap`` apart are one
    read of at most ``most`` bytes (more for a record that is longer itself). Records leave the
    task after each such range, and within it after UNPACKED_BYTES of payload.
    """
    selected = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    ranges = (
        index.select("page_id", "file", "offset", "length", F.expr(f"offset div {span}").alias("span"))
        .repartition(max(1, -(-selected // span)), "file", "span")
        .sortWithinPartitions("file", "offset")
        .drop("span")
    )
    return ranges.mapInArrow(
        range_reader(folder, gap, most), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    )


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> tuple[DataFrame, str]:
    """Write one record per row; the index and the archive folder.

    Of rows with equal payloads of ``REVISIT_BYTES`` or more, the one with the smallest id
    is the response and the others revisit it; shorter payloads are all responses. Null
    texts are empty payloads; very long ones are records like all others. Rows that repeat
    id and payload are responses each, where that id is the smallest. Null ids sort last.
    Other columns are ignored, whatever their names. An empty table gives an empty index.
    Only payloads that occur again take part in the lookup of the response.
    """
    payload = F.coalesce(F.col(text_col), F.lit(""))
    plain = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        payload.alias("html"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload.cast("binary"), 256).alias("payload_digest"),
    )
    again = (
        plain.where(F.col("payload_bytes") >= REVISIT_BYTES)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("payload_digest", "first_id")
    )
    # Written first, so that adaptive execution can broadcast it or split a payload that many rows hold.
    again = stage(again, "warc-again")
    first = F.col("first_id")
    marked = plain.join(again, "payload_digest", "left").withColumn(
        "refers_to", F.when(first.isNotNull() & ~first.eqNullSafe(F.col("page_id")), first)
    )
    folder = fresh_path(pages.sparkSession, "warc")
    return write_archives(marked, folder), folder


def op5(pages: DataFrame) -> DataFrame:
    index, folder = archive(pages)
    return read_records(index, folder).drop("payload")


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages
), d AS (
  SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS first_id FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id IS NOT NULL AND first_id IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id IS NOT NULL AND first_id IS DISTINCT FROM page_id THEN first_id END AS refers_to
FROM f
"""
