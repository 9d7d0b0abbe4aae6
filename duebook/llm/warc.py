"""WARC archives: writing pages as records, and reading records back, segmented ones
put together.

Archives are written by Spark's text writer: a row is one record without its last line
end, which the writer adds; so they go to any file system Spark knows, committed task by
task. A record's block is at most ``SEGMENT`` bytes; a longer one is split into a first
segment and continuation records. A page whose payload another page has too is written
as a revisit of it. Reading takes each archive (of at most ``RECORDS`` records) as one
file, groups the segments by the identifier of their origin, orders them by number,
checks the total length and decodes the chunked transfer framing.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duebook.llm.common import materialise, small_side

SEGMENT = 32 * 1024
RECORDS = 2048          # records of an archive: 64 MB of blocks at most
CHUNK = 8 * 1024        # bytes of a chunk of the transfer framing
REVISIT = 1000          # bytes of the smallest payload that is not written twice
NO_URL = "urn:page:none"
DATE = "2024-01-01T00:00:00Z"
STATUS = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def chunked(payload: bytes) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(payload[i:i + CHUNK]), payload[i:i + CHUNK])
             for i in range(0, len(payload), CHUNK)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload; chunk extensions and trailers are skipped. ValueError if the framing
    is broken or ends too early."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        at = end + 2
        if body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("chunk without its end")
        out.append(body[at:at + size])
        at += size + 2


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the last of its line ends."""
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return b"WARC/1.1\r\n%bContent-Length: %d\r\n\r\n%b\r\n" % (head.encode(), len(block), block)


def records_of(page_id, url, payload: bytes, original, name: str) -> list[bytes]:
    """A page as one record, or as segments. `original` is the page it revisits."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    uri = "".join((url or "").split()) or NO_URL
    mark = f"<urn:page:{'' if page_id is None else page_id}:{name}>"
    common = [("WARC-Date", DATE), ("WARC-Target-URI", uri),
              ("WARC-Payload-Digest", f"sha1:{digest}"),
              ("Content-Type", "application/http; msgtype=response")]
    if original is not None:
        head = STATUS + b"Content-Length: %d\r\n\r\n" % len(payload)
        return [record([("WARC-Type", "revisit"), ("WARC-Record-ID", mark),
                        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/"
                                         "identical-payload-digest"),
                        ("WARC-Refers-To", f"<urn:page:{original}>"), *common], head)]
    block = STATUS + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    first = [("WARC-Type", "response"), ("WARC-Record-ID", mark), *common]
    if len(block) <= SEGMENT:
        return [record(first, block)]
    parts = [block[i:i + SEGMENT] for i in range(0, len(block), SEGMENT)]
    out = [record([*first, ("WARC-Segment-Number", "1")], parts[0])]
    for number, part in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if number == len(parts) else []
        out.append(record([("WARC-Type", "continuation"),
                           ("WARC-Record-ID", f"{mark[:-1]}:{number}>"), ("WARC-Date", DATE),
                           ("WARC-Target-URI", uri), ("WARC-Segment-Origin-ID", mark),
                           ("WARC-Segment-Number", str(number)), *last], part))
    return out


def write_archives(pages: DataFrame, path: str, records: int = RECORDS) -> None:
    """Write `pages` (page_id, url, html) as gzipped archives below `path`. A null html is
    an empty payload. Of pages with equal payloads of at least ``REVISIT`` bytes the one
    with the largest page_id is the response and the others revisit it; equal rows of that
    page are responses too, and so are pages without page_id if no other has the payload."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary")
                        .alias("payload"))
    keyed = rows.withColumn("digest", F.when(F.length("payload") >= REVISIT, F.sha1("payload")))
    shared = small_side(keyed.filter("digest is not null").groupBy("digest")
                        .agg(F.max("page_id").alias("original"), F.count("*").alias("n"))
                        .filter("n > 1").select("digest", "original"))
    marked = keyed.join(shared, "digest", "left").select(
        "page_id", "url", "payload",
        F.when(~F.col("page_id").eqNullSafe(F.col("original")), F.col("original"))
        .alias("original"))

    def run(batches):
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            out = []
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                out += records_of(*row, name=f"{task}-{n}")
                n += 1
            for at in range(0, len(out), 256):
                yield pa.RecordBatch.from_arrays([pa.array(out[at:at + 256], pa.binary())],
                                                 ["value"])

    (marked.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
     .write.option("lineSep", "\r\n").option("compression", "gzip")
     .option("maxRecordsPerFile", records).text(path))


# ----------------------------------------------------------------- reading --
def unzipped(data: bytes) -> bytes:
    """All members of a gzip file; other bytes as they are."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        unzip = zlib.decompressobj(31)
        out.append(unzip.decompress(data) + unzip.flush())
        data = unzip.unused_data
    return b"".join(out)


def parsed(data: bytes):
    """(headers with names in lower case, block) of each record."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        head = {}
        for line in data[at:end].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            head[name.strip().lower().decode()] = value.strip().decode()
        start = end + 4
        to = start + int(head["content-length"])
        if data[to:to + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end where it says")
        yield head, data[start:to]
        at = to + 4


def body_of(block: bytes) -> tuple[dict, bytes]:
    head, _, body = block.partition(b"\r\n\r\n")
    fields = dict(x.lower().split(b": ", 1) for x in head.split(b"\r\n")[1:])
    return fields, unchunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body


def page_of(mark: str | None):
    """The page_id in a record's identifier."""
    number = (mark or "").strip("<>").split(":")[2:3]
    return int(number[0]) if number and number[0] else None


def sha1_hex(value: str | None):
    return base64.b32decode(value.split(":")[1]).hex() if value else None


FIELDS = ("origin string, number int, total long, page_id long, url string, "
          "record_type string, refers_to long, payload_digest string, payload binary, "
          "problem string")


def read_records(spark, path: str) -> DataFrame:
    """Each record of the archives below `path`. Of segments `payload` is the block's part;
    of others, the decoded payload. What cannot be read of an archive is one row of type
    unreadable, with the reason in `problem`."""
    def row(head, block):
        kind, number = head["warc-type"], head.get("warc-segment-number")
        problem = None
        if number is None and kind == "response":
            try:
                block = body_of(block)[1]
            except ValueError as e:
                block, problem = None, str(e)
        mark, uri = head["warc-record-id"], head.get("warc-target-uri")
        total = head.get("warc-segment-total-length")
        return (head.get("warc-segment-origin-id", mark) if number else None,
                int(number) if number else None, int(total) if total else None,
                page_of(mark), None if uri == NO_URL else uri, kind,
                page_of(head.get("warc-refers-to")),
                sha1_hex(head.get("warc-payload-digest")), block, problem)

    def run(batches):
        types = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(),
                 pa.int64(), pa.string(), pa.binary(), pa.string())
        for batch in batches:
            for data in batch.column(0):
                out = []
                try:
                    for head, block in parsed(unzipped(data.as_py())):
                        out.append(row(head, block))
                except (ValueError, KeyError, zlib.error) as e:
                    out.append((None,) * 5 + ("unreadable",) + (None,) * 3 + (str(e),))
                for at in range(0, len(out), 256):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out[at:at + 256]), types)],
                        [f.split()[0] for f in FIELDS.split(", ")])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, FIELDS)


def whole_blocks(segments: DataFrame) -> DataFrame:
    """Segments put together: one row for each origin, with the payload, or null and the
    reason in `problem` where a segment or the stated total length is missing or wrong."""
    parts = F.array_sort(F.collect_list(F.struct("number", "payload")))
    joined = (segments.groupBy("origin").agg(
        parts.alias("parts"), F.max("total").alias("total"),
        *[F.max(F.when(F.col("number") == 1, F.col(c))).alias(c) for c in (
            "page_id", "url", "record_type", "refers_to", "payload_digest")])
        .withColumn("block", F.aggregate("parts", F.lit(b""), lambda s, x: F.concat(
            s, x["payload"])))
        .withColumn("problem", F.when(
            F.transform("parts", lambda x: x["number"])
            != F.sequence(F.lit(1), F.size("parts")), "segments are missing or repeated")
            .when(F.col("total").isNull(), "no total length")
            .when(F.col("total") != F.length("block"), "wrong total length")))

    def run(batches):
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            payloads, problems = [], []
            for block, problem in zip(batch.column(at["block"]).to_pylist(),
                                      batch.column(at["problem"]).to_pylist()):
                payload = None
                if problem is None:
                    try:
                        payload = body_of(block)[1]
                    except ValueError as e:
                        problem = str(e)
                payloads.append(payload)
                problems.append(problem)
            yield pa.RecordBatch.from_arrays(
                [batch.column(at[c]) for c in ("page_id", "url", "record_type", "refers_to",
                                               "payload_digest")]
                + [pa.array(payloads, pa.binary()), pa.array(problems, pa.string())],
                [f.split()[0] for f in PAGE.split(", ")])

    return joined.drop("parts", "origin", "total").mapInArrow(run, PAGE)


PAGE = ("page_id long, url string, record_type string, refers_to long, "
        "payload_digest string, payload binary, problem string")


def read_archives(spark, path: str) -> DataFrame:
    """Each page in the archives below `path`: page_id, url, record_type, refers_to (the
    page a revisit stands for), payload_digest, payload_bytes, payload (null for a
    revisit) and problem: null, or why a payload could not be read or has another digest
    than the archive says. An empty folder of archives gives no rows."""
    records = materialise(read_records(spark, path))
    single = records.filter("number is null").select(
        "page_id", "url", "record_type", "refers_to", "payload_digest",
        "payload", "problem")
    pages = single.union(whole_blocks(records.filter("number is not null")))
    stated = F.regexp_extract(F.col("payload").cast("string"), r"Content-Length: (\d+)", 1)
    revisit = F.col("record_type") == "revisit"
    return pages.select(
        "page_id", "url", "record_type", "refers_to", "payload_digest",
        F.when(revisit, stated.cast("long")).otherwise(F.length("payload").cast("long"))
        .alias("payload_bytes"),
        F.when(~revisit, F.col("payload")).alias("payload"),
        F.coalesce("problem", F.when(~revisit & (F.sha1("payload") != F.col("payload_digest")),
                                     "wrong digest")).alias("problem"))
