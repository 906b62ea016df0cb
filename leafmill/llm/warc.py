"""WARC archives: a writer that leaves whole files on the shared store, and a splittable reader.

Writing: each task writes archives of gzip members, one record each, under a name of its
own attempt, and yields a manifest row once a file is complete. Only files in the
manifest count, so a lost or repeated task leaves nothing that is read.

Reading: files are cut into byte ranges. A task looks in its range for the gzip magic,
takes a place for a member if what decodes there begins with a whole WARC header, and
owns the records that start inside its range, reading on beyond its end where the last
one does. From a record it goes on at that record's end. Bytes that look like a member
may lie inside the payload of another record (an archive stored in an archive): such a
find starts before an earlier range's record ends, and is dropped by that test, also if its
body is broken. A broken record that lies in no other is an error.

Payloads that many pages share are stored once: the page with the largest id holds the
response, the others are revisits that name it, with the payload's digest and, in the
HTTP header they keep, its length.

Defined results: a null body is an empty payload; a null URL leaves the header out, and
control characters in a URL are percent-encoded; a null id makes a record without a
number; rows that repeat id and payload are all responses; an empty table makes no file.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import texts as X
from leafmill.session import scratch, written

#: Bytes of an archive before the next begins, of a reading range, and of a record header decoded at once.
ARCHIVE_BYTES, RANGE_BYTES, HEADER_STEP = 256 << 20, 32 << 20, 64 << 10
MAGIC, VERSION, LENGTH, BLANK_LINE = b"\x1f\x8b\x08", b"WARC/1.", b"content-length:", b"\r\n\r\n"
#: Stands for the type of a find whose header decodes but whose body does not.
BROKEN = "\0broken"
#: Reading tasks at most; beyond, a task reads several ranges.
MOST_TASKS = 50_000
NAME = "urn:leafmill:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = (
    "file string, range_start long, offset long, end long, record_type string, record_id string, "
    "refers_to string, target_uri string, payload_digest string, payload_bytes long, payload binary"
)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def opened(uri: str):
    """The store of a file and its path there; any store that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def record(page_id: int | None, url: str | None, payload: bytes, keeper: int | None, revisit: bool) -> bytes:
    """One WARC record, not compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{NAME}{'' if page_id is None else page_id}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        clean = "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
        head.append(f"WARC-Target-URI: {clean}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{NAME}{keeper}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Writes the pages and returns the manifest: ``file``, ``length``, ``records``.

    Equal payloads of at least ``least`` bytes are stored once.
    """
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
        X.whole(F.col(html_col)).cast("binary").alias("payload"),
    ).withColumn("sum", F.sha2("payload", 256))
    groups = rows.groupBy("sum").agg(F.max("page_id").alias("keeper"))
    # Equal payloads meet by their digest; adaptive execution splits those of many copies.
    joined = rows.join(groups, "sum").withColumn(
        "revisit", (F.length("payload") >= least) & F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    )

    def write(batches):
        store, root = opened(folder)
        store.create_dir(root, recursive=True)
        name = out = None
        length = records = 0
        for batch in batches:
            for page, url, payload, keeper, revisit in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                if out is None:
                    name, length, records = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = packer.compress(record(page, url, payload, keeper, revisit)) + packer.flush()
                out.write(member)
                length, records = length + len(member), records + 1
                if length >= ARCHIVE_BYTES:
                    out.close()
                    yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "length": [length], "records": [records]})
                    out = None
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "length": [length], "records": [records]})

    columns = joined.select("page_id", "url", "payload", "keeper", "revisit")
    return written(columns.mapInArrow(write, "file string, length long, records long"), "warc-manifest")


def listed(spark: SparkSession, path: str) -> DataFrame:
    """``file`` and ``length`` of the archives in a folder, without reading them."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(path)
    return found.select(F.col("path").alias("file"), "length")


def headers(raw: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in raw.split(b"\r\n")[1:]:
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def is_member(source, at: int) -> bool:
    """Whether a gzip member begins there whose content begins with a whole WARC header, however long."""
    unpack, read = zlib.decompressobj(31), 0
    begin, tail, sized = b"", b"", False
    try:
        while not unpack.eof:
            piece = unpack.unconsumed_tail
            if not piece:
                piece = source.read_at(4096, at + read)
                read += len(piece)
            if not piece:
                return False
            more = unpack.decompress(piece, HEADER_STEP)
            begin = (begin + more[: len(VERSION)])[: len(VERSION)]
            if not VERSION.startswith(begin):
                return False
            head, found, _ = (tail + more).partition(BLANK_LINE)
            sized = sized or LENGTH in head.lower()
            if found:
                return sized
            tail = head[-len(LENGTH) :]  # what either mark may begin with
    except zlib.error:
        pass
    return False


def member(source, at: int) -> tuple[bytes, int] | None:
    """The content of the member at a place, and where it ends; None if its body is broken or cut off."""
    unpack, out, read = zlib.decompressobj(31), io.BytesIO(), at
    try:
        while not unpack.eof:
            piece = source.read_at(256 << 10, read)
            if not piece:
                return None
            read += len(piece)
            out.write(unpack.decompress(piece))
    except zlib.error:
        return None
    return out.getvalue(), read - len(unpack.unused_data)


def starts(source, at: int, stop: int):
    """The first member that begins in [at, stop), or None."""
    step = 1 << 20
    while at < stop:
        piece = source.read_at(min(step, stop - at) + len(MAGIC) - 1, at)
        place = piece.find(MAGIC)
        if place < 0:
            at += min(step, stop - at)
        elif is_member(source, at + place):
            return at + place
        else:
            at += place + 1
    return None


def parsed(content: bytes) -> dict:
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = headers(head)
    block = rest[: int(fields.get("content-length", 0))]
    kind, length, payload = fields.get("warc-type"), None, block
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        length = headers(http).get("content-length")
    if kind != "revisit":
        length = len(payload)
    return {
        "record_type": kind,
        "record_id": fields.get("warc-record-id", "").strip("<>"),
        "refers_to": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None,
        "target_uri": fields.get("warc-target-uri"),
        "payload_digest": payload_digest(payload) if kind == "response" else fields.get("warc-payload-digest", "").removeprefix("sha1:") or None,
        "payload_bytes": None if length is None else int(length),
        "payload": payload,
    }


def read_archives(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of ``files`` (``file``, ``length``), columns as in ``RECORD``.

    The digest of a response is computed from the payload that was read.
    """
    # A number of partitions, as adaptive execution would merge these slim rows into one task.
    count = files.filter("length > 0").agg(F.sum(F.ceil(F.col("length") / range_bytes))).first()[0] or 1
    ranges = files.filter("length > 0").select(
        "file", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("start"), "length"
    ).repartition(min(int(count), MOST_TASKS), "file", "start")

    def read(batches):
        for batch in batches:
            for file, start, length in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                store, path = opened(file)
                with store.open_input_file(path) as source:
                    stop, rows, held = min(start + range_bytes, length), [], 0
                    at = starts(source, start, stop)
                    while at is not None:
                        whole = member(source, at)
                        if whole is None:  # lies in another record, or is an error
                            rows.append({"file": file, "range_start": start, "offset": at, "end": at + 1, "record_type": BROKEN})
                            at = starts(source, at + 1, stop)
                            continue
                        content, end = whole
                        rows.append({"file": file, "range_start": start, "offset": at, "end": end} | parsed(content))
                        held += len(content)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=kind)
                            rows, held = [], 0
                        at = starts(source, end, stop)
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=kind)

    texts = {"range_start": pa.int64(), "offset": pa.int64(), "end": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
    kind = pa.schema([(n, texts.get(n, pa.string())) for n in (c.split()[0] for c in RECORD.split(", "))])
    records = without_nested(written(ranges.mapInArrow(read, RECORD), "warc-records"))
    broken = records.filter(F.col("record_type") == BROKEN).select("file", "offset").first()
    if broken:
        raise ValueError(f"a record of {broken.file} at byte {broken.offset} is cut off")
    return records


def without_nested(records: DataFrame) -> DataFrame:
    """Drops finds inside a record of an earlier range of their file."""
    from pyspark.sql import Window as W

    ranges = records.groupBy("file", "range_start").agg(F.min("offset").alias("first"), F.max("end").alias("last"))
    earlier = W.partitionBy("file").orderBy("range_start").rowsBetween(W.unboundedPreceding, -1)
    hit = ranges.withColumn("until", F.max("last").over(earlier)).filter("first < until").select("file", "range_start", "until")
    if hit.isEmpty():
        return records
    both = records.join(hit, ["file", "range_start"], "left").filter("until IS NULL OR offset >= until")
    return both.select(*records.columns)
