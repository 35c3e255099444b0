"""WARC archives: writing, reading, and reassembly of segmented records (operator 9).

Pages become HTTP responses with chunked framing. A block longer than a segment is written as a record and its
continuations, which may lie in any archives of the set. Reading parses each archive by itself; records of one segment are decoded in place, others are
grouped by their origin, ordered by segment number, checked against the stated total length, joined, and then decoded. Of equal payloads
only one is written in full; the others are revisit records that name it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinproof.llm.base import qualified, slices, stored
from twinproof.llm.tokens import open_store
from twinproof.session import scratch

SEGMENT, CHUNK, ARCHIVE = 16 << 10, 4096, 8 << 20
# Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_ID = "<urn:page:%s>"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [payload[i: i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are skipped, and a body that breaks off raises."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if at + n + 2 > len(body):
            raise ValueError("a chunk breaks off")
        out.append(body[at: at + n])
        at += n + 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response, its transfer coding undone."""
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if re.search(rb"(?mi)^transfer-encoding:[^\r\n]*\bchunked", head) else body


def record(kind: str, record_id: str, block: bytes, **headers) -> bytes:
    lines = [VERSION, b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: " + record_id.encode(), b"WARC-Date: 2024-01-01T00:00:00Z"]
    for k, v in headers.items():
        if v is not None:
            value = re.sub(r"[\r\n]", lambda m: "%%%02X" % ord(m[0]), str(v))
            lines.append(f"{k.replace('_', '-')}: {value}".encode())
    lines.append(b"Content-Length: %d" % len(block))
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not first.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower().decode(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines)}
    n = int(fields["content-length"])
    if len(rest) < n:
        raise ValueError("a record breaks off")
    return fields, rest[:n]


def _records(page, url, payload: bytes, digest: str, refers) -> Iterator[tuple[int, bytes]]:
    """Records of a page, with their segment numbers."""
    own = _ID % page
    common = {"WARC_Target_URI": url, "WARC_Payload_Digest": f"sha1:{digest}", "Content_Type": "application/http; msgtype=response"}
    if refers is not None:
        yield 1, record("revisit", own, HTTP, WARC_Profile=PROFILE, WARC_Refers_To=_ID % refers, **common)
        return
    block = HTTP + chunked(payload)
    parts = [block[i: i + SEGMENT] for i in range(0, len(block), SEGMENT)]
    if len(parts) == 1:
        yield 1, record("response", own, block, **common)
        return
    # One name for each writing of a page, so that repeated pages keep their segments apart.
    origin = f"<urn:uuid:{uuid.uuid4()}>"
    for k, part in enumerate(parts, 1):
        total = {"WARC_Segment_Total_Length": len(block)} if k == len(parts) else {}
        if k == 1:
            yield k, record("response", origin, part, WARC_Segment_Number=k, WARC_Page=own, **common)
        else:
            yield k, record("continuation", f"<urn:uuid:{uuid.uuid4()}>", part, WARC_Segment_Number=k, WARC_Segment_Origin_ID=origin, **total)


def _pressed(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


_FILES = pa.schema([("path", pa.string()), ("n_bytes", pa.int64()), ("n_records", pa.int64())])


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write (page_id, url, html) as archives in ``folder``, a gzip member per record; a row per archive: path, n_bytes, n_records.

    Of pages with equal payloads of at least ``least_bytes`` bytes, the one with the largest page_id is written in full. Archives get a
    name of their own in each attempt, and only those in the returned, stored rows count. Continuations go to an archive of
    their own beside the task's main one.
    """
    folder = qualified(pages.sparkSession, folder)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    winners = rows.filter(F.length("payload") >= least_bytes).groupBy("digest").agg(
        F.max("page_id").alias("winner"), F.count(F.lit(1)).alias("times")).filter("times > 1").select("digest", "winner")

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            z = [zlib.compress(p, 1) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(z, pa.binary()), batch.column(3)],
                                             names=["page_id", "url", "z", "digest"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, inner = open_store(folder)
        held: dict[bool, list] = {}

        def close(later):
            out, name, size, n = held.pop(later)
            out.close()
            return pa.RecordBatch.from_pydict({"path": [name], "n_bytes": [size], "n_records": [n]}, schema=_FILES)

        for batch in slices(batches):
            for page, url, z, digest, winner in zip(*(c.to_pylist() for c in batch.columns)):
                digest = base64.b32encode(bytes.fromhex(digest)).decode()
                refers = winner if winner is not None and winner != page else None
                for number, data in _records(page, url, zlib.decompress(z), digest, refers):
                    later = number > 1
                    if later not in held:
                        store.create_dir(inner, recursive=True)
                        name = f"{inner}/{uuid.uuid4().hex}.warc.gz"
                        held[later] = [store.open_output_stream(name, compression=None), name, 0, 0]
                    data = _pressed(data)
                    held[later][0].write(data)
                    held[later][2] += len(data)
                    held[later][3] += 1
                    if held[later][2] >= ARCHIVE:
                        yield close(later)
        for later in list(held):
            yield close(later)

    small = rows.mapInArrow(press, "page_id long, url string, z binary, digest string")
    marked = small.join(winners, "digest", "left").select("page_id", "url", "z", "digest", "winner")
    return stored(marked.mapInArrow(write, "path string, n_bytes long, n_records long"), "archives")


_PARTS = pa.schema([("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("kind", pa.string()), ("page", pa.string()),
                    ("url", pa.string()), ("digest", pa.string()), ("refers", pa.string()), ("block", pa.binary())])


def members(store, path: str, step: int = 1 << 16) -> Iterator[bytes]:
    """The gzip members of a file, one at a time, in bounded memory."""
    with store.open_input_file(path) as f:
        rest = b""
        while rest or (rest := f.read(step)):
            z, parts = zlib.decompressobj(31), []
            while not z.eof:
                if not rest and not (rest := f.read(step)):
                    raise ValueError(f"{path} breaks off")
                parts.append(z.decompress(rest))
                rest = z.unused_data
            yield b"".join(parts)


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """Pages of archives (column path): page (record id), url, digest, kind, refers, payload (NULL for revisits).

    The digest of a response is that of the payload as read, of others what the record says. Raises where a response's record says otherwise, and
    where segments are missing, doubled, or do not add up to their total length. An origin's segments, one page, meet in one row
    and are put together when its payload is decoded.
    """
    folder = qualified(files.sparkSession, folder)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                out, size = [], 0
                for data in members(store, path):
                    h, block = parse_record(data)
                    own = h["warc-record-id"]
                    number = int(h.get("warc-segment-number", 0))
                    total = h.get("warc-segment-total-length")
                    out.append({
                        "origin": h.get("warc-segment-origin-id", own) if number else None, "number": number, "total": int(total) if total else None,
                        "kind": h["warc-type"], "page": h.get("warc-page", own), "url": h.get("warc-target-uri"),
                        "digest": h.get("warc-payload-digest", "").removeprefix("sha1:"), "refers": h.get("warc-refers-to"), "block": block})
                    size += len(block)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(out, schema=_PARTS)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=_PARTS)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kinds, blocks = batch.column(3).to_pylist(), batch.column(5).to_pylist()
            payload = [payload_of(b"".join(b)) if k == "response" else None for k, b in zip(kinds, blocks)]
            digests = batch.column(2).to_pylist()
            for k, (page, p, stated) in enumerate(zip(batch.column(0).to_pylist(), payload, digests)):
                if p is not None:
                    digests[k] = digest_of(p)
                    # Other algorithms than SHA-1 keep their name in front.
                    if stated and ":" not in stated and stated != digests[k]:
                        raise ValueError(f"the payload of {page} does not have the digest of its record")
            columns = [*batch.columns[:2], pa.array(digests, pa.string()), *batch.columns[3:5], pa.array(payload, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:5], "payload"])

    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = files.select("path").repartition(n, "path").mapInArrow(parse, ", ".join(
        ["origin string, number int, total long, kind string, page string, url string, digest string, refers string, block binary"]))
    parts = stored(parts, "records")
    names = ["page", "url", "digest", "kind", "refers"]
    whole = parts.filter("number = 0").select(*names, F.array("block").alias("blocks"))
    grouped = parts.filter("number > 0").groupBy("origin").agg(
        F.array_sort(F.collect_list(F.struct("number", "block"))).alias("s"), F.max("total").alias("total"), F.sum(F.length("block")).alias("held"),
        *[F.max(F.when(F.col("number") == 1, F.col(c))).alias(c) for c in names])
    sound = (F.col("held") == F.col("total")) & (F.col("s.number") == F.sequence(F.lit(1), F.size("s")))
    joined = grouped.select(*names, F.when(sound, F.col("s.block")).otherwise(F.raise_error("segments do not add up")).alias("blocks"))
    return whole.unionByName(joined).mapInArrow(decode, "page string, url string, digest string, kind string, refers string, payload binary")


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write pages as archives and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    NULL html is an empty payload, a NULL url a record without target. Repeated pages are records of their own; those equal to the one
    written in full are written in full too. A revisit's length comes from the record it refers to. An empty table gives an empty result.
    """
    folder = scratch(pages.sparkSession, "warc")
    found = read_archives(write_archives(pages, folder, least_bytes), folder)
    number = lambda c: F.regexp_extract(c, r"(-?\d+)>$", 1).try_cast("long")
    slim = stored(found.select(
        number(F.col("page")).alias("page_id"), F.length("payload").cast("long").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.col("kind").alias("record_type"), number(F.col("refers")).alias("refers_to")), "pages")
    full = slim.filter("record_type = 'response'").groupBy(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest")).agg(
        F.max("payload_bytes").alias("_bytes"))
    joined = slim.join(full, (F.col("refers_to") == F.col("_id")) & (F.col("payload_digest") == F.col("_digest")), "left")
    return joined.select("page_id", F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


#: The same result in SQL: base32 digits of the 160 bits, five at a time.
SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS h FROM pages),
w AS (SELECT h, max(page_id) AS winner FROM p GROUP BY h)
SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
    (CAST('0x' || substr(p.h || '0', 1 + (i * 5) // 4, 2) AS INTEGER) >> (3 - (i * 5) % 4)) & 31 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = winner THEN NULL ELSE winner END AS refers_to
FROM p JOIN w USING (h)
"""
