"""WARC archives with an index of records.

Writing: every record is a gzip member of its own in a ``.warc.gz`` file, and its file, offset,
length, URL and digest go into an index table.  Of records with equal payloads one holds the
payload; the others are revisits that refer to it.  Reading starts from the index: the selected
records' byte ranges are sorted by file and offset, neighbours are joined into one read while the
gap between them stays small, and the records are cut from the block.

Defined results: a null payload is an empty one; a null URL is an empty URI; rows that repeat the
group's largest id are all responses, and where no id is known all are; an empty table gives no
archive and an empty result; very long payloads are written and read whole; other columns are left
alone, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecmosaic.llm.files import new_folder, reader, writer
from vecmosaic.session import written

RESPONSE_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
INDEX = "page_id long, url string, digest string, record_type string, refers_to long, path string, offset long, length long"


@dataclass(frozen=True)
class WarcOptions:
    level: int = 2  # of gzip
    revisit_bytes: int = 0  # smaller payloads are always responses
    max_gap: int = 64 << 10  # bytes between ranges that one read may cover
    max_read: int = 8 << 20
    date: str = "2020-01-01T00:00:00Z"


def _urn(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def _record(page_id: int | None, url: str, kind: str, refers: int | None, digest: str, payload: bytes, place: str, options: WarcOptions) -> bytes:
    """A response is named by page and digest, so that its revisits can name it; they are named by their place."""
    urn = _urn(f"{page_id} {digest}" if kind == "response" and page_id is not None else place)
    uri = "".join(c if c > " " else "%%%02X" % ord(c) for c in url)
    head = [
        "WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {urn}", f"WARC-Date: {options.date}", f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-Id: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http + payload if kind == "response" else http
    if kind == "revisit":
        head += [f"WARC-Refers-To: {_urn(f'{refers} {digest}')}", f"X-Refers-To-Page: {refers}", f"WARC-Profile: {RESPONSE_PROFILE}"]
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """The headers by lower-case name and the payload of an uncompressed record."""
    top, _, rest = raw.partition(b"\r\n\r\n")
    lines = top.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    body = rest[: int(head["content-length"])]
    return head, body.partition(b"\r\n\r\n")[2]


def with_record_types(pages: DataFrame, options: WarcOptions = WarcOptions()) -> DataFrame:
    """(page_id, url, body, digest, record_type, refers_to).

    Digests are grouped without the payloads, with partial counts before the shuffle; only digests
    that occur more than once are joined back, in a join that adaptive execution can split.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("body"))
    rows = rows.withColumn("digest", F.sha1("body"))
    groups = rows.groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = written(groups.where("n > 1 and first is not null").select(F.col("digest").alias("shared"), "first"), "digests")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.length("body") >= options.revisit_bytes)
    return rows.join(groups, F.col("digest") == F.col("shared"), "left").select(
        "page_id", "url", "body", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to")
    )


def write_warc(pages: DataFrame, options: WarcOptions = WarcOptions(), folder: str | None = None) -> DataFrame:
    """Write the archives, one per task, and return their index.

    A task that runs again writes under another name; only the index of the tasks that counted
    is kept, so no record is read twice.
    """
    folder = folder or new_folder(pages.sparkSession, "warc")
    typed = with_record_types(pages, options)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, out, at = f"{folder}/{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or writer(path)
            cols = [batch.column(c) for c in ("page_id", "url", "body", "digest", "record_type", "refers_to")]
            digests, offsets, lengths = [], [], []
            for i in range(batch.num_rows):
                page_id, url, body, digest, kind, refers = (c[i].as_py() for c in cols)
                digests.append(base64.b32encode(bytes.fromhex(digest)).decode())
                pack = zlib.compressobj(options.level, zlib.DEFLATED, 31)
                member = pack.compress(_record(page_id, url or "", kind, refers, digests[-1], body, f"{path} {at}", options)) + pack.flush()
                out.write(member)
                offsets.append(at)
                lengths.append(len(member))
                at += len(member)
            yield pa.RecordBatch.from_arrays(
                [cols[0], cols[1], pa.array(digests), cols[4], cols[5], pa.array([path] * batch.num_rows), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
                names=["page_id", "url", "digest", "record_type", "refers_to", "path", "offset", "length"],
            )
        if out:
            out.close()

    return written(typed.mapInArrow(write, INDEX), "warc-index")


def blocks(ranges: list[tuple[str, int, int]], options: WarcOptions) -> Iterator[tuple[str, int, int, list[int]]]:
    """(path, from, to, rows): reads that cover sorted (path, offset, length) ranges."""
    path, a, b, rows = None, 0, 0, []
    for k, (p, offset, length) in enumerate(ranges):
        if rows and p == path and offset - b <= options.max_gap and offset + length - a <= options.max_read:
            b = max(b, offset + length)
            rows.append(k)
            continue
        if rows:
            yield path, a, b, rows
        path, a, b, rows = p, offset, offset + length, [k]
    if rows:
        yield path, a, b, rows


def read_records(selected: DataFrame, options: WarcOptions = WarcOptions()) -> DataFrame:
    """The records that index rows name, from the archives alone.

    (page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload); a revisit has
    the digest and length of the payload it stands for and no payload of its own.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, last = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"], (None, None)
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            ranges = list(zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length")), strict=True))
            for path, a, b, rows in blocks(ranges, options):
                if last[0] != path:
                    last = path, reader(path)
                block, found = last[1].read_at(b - a, a), []
                for k in rows:
                    _, offset, length = ranges[k]
                    head, payload = parse_record(zlib.decompress(block[offset - a : offset - a + length], 31))
                    kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"{path} at {offset}: the payload doesn't have its digest")
                    refers = head.get("x-refers-to-page")
                    size = len(payload) if kind == "response" else int(head["x-payload-length"])
                    found.append((int(head["x-page-id"]) if head["x-page-id"] else None, head["warc-target-uri"], kind, digest, size, int(refers) if refers else None, payload if kind == "response" else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names=names)

    n = max(1, int(selected.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # a file's records go to a few tasks by stretches of the file, so that one file is no bottleneck
    stretch = F.floor(F.col("offset") / F.lit(options.max_read))
    placed = selected.select("path", "offset", "length").repartition(n, "path", stretch).sortWithinPartitions("path", "offset")
    return placed.mapInArrow(read, "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary")
