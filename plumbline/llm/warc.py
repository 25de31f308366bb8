"""Operator 10: WARC archives with Zstandard, one frame for each record and the dictionary in a leading skippable frame.

Writer: payload digests are computed once; of records with equal payloads the one with the largest page_id is the
response and the others are revisits that name it. A payload that many pages share is found by salted partial maxima, so
no task gets all its rows. Each task writes archives of at most about ``file_bytes`` of records.

Reader: Spark's binaryFile source brings each archive; the dictionary is taken from the skippable frame, frame ends are
found from the block headers, each frame is decoded alone, and WARC version, header names, record type, Content-Length,
payload length and digests are checked. Archives of other writers are read too: all record types, WARC 1.0, frames
without a size, more skippable frames. A bad archive raises ValueError; no record is skipped.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import drop, put, shared_dir, written

# fixed values of the formats
SKIPPABLE, FRAME, DICTIONARY = 0x184D2A5D, 0xFD2FB528, 0xEC30A437  # the leading frame, frames, trained dictionaries
VERSION, VERSIONS, PROFILE = b"WARC/1.1", (b"WARC/1.0", b"WARC/1.1"), "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
TYPES = ("warcinfo", "response", "resource", "request", "metadata", "revisit", "conversion", "continuation")
NAME = re.compile(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+")
CONTENT = "application/http; msgtype=response"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record_uri(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _b32(hexed: str) -> str:
    return base64.b32encode(bytes.fromhex(hexed)).decode()


def record(row: dict, payload: bytes) -> bytes:
    """One WARC record. A revisit carries the HTTP head only; the payload's length stands in WARC-Payload-Length."""
    revisit = row["record_type"] == "revisit"
    block = HTTP if revisit else HTTP + payload
    fields = [
        ("WARC-Type", row["record_type"]), ("WARC-Record-ID", record_uri(row["page_id"])), ("WARC-Date", DATE),
        ("WARC-Target-URI", "".join((row["url"] or "about:blank").split())), ("WARC-Page-ID", "" if row["page_id"] is None else row["page_id"]),
        ("WARC-Payload-Digest", f"sha1:{_b32(row['sha1'])}"), ("WARC-Payload-Length", len(payload)),
        ("Content-Type", CONTENT), ("Content-Length", len(block)),
    ]
    if revisit:
        fields[3:3] = [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_uri(row["refers_to"])), ("WARC-Refers-To-Page-ID", row["refers_to"])]
    head = b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in fields)])
    return head + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(lines: list[bytes]) -> dict[str, str]:
    """Header fields by lower-case name; a line that starts with white space goes on with the one before."""
    fields: dict[str, str] = {}
    name = None
    for line in lines:
        if line[:1] in (b" ", b"\t") and name:
            fields[name] += " " + line.decode().strip()
            continue
        key, colon, value = line.decode().partition(":")
        name = key.lower()
        if not colon or not NAME.fullmatch(key) or (name in fields and name != "warc-concurrent-to"):
            raise ValueError(f"bad header line {line[:60]!r}")
        fields[name] = value.strip()
    return fields


def _checked(given: str | None, data: bytes, what: str) -> None:
    """A labelled SHA-1 must be that of the data; other algorithms are not checked."""
    if given and given.startswith("sha1:") and _b32(hashlib.sha1(data).hexdigest()) != given[5:].upper():
        raise ValueError(f"{what} digest doesn't match")


def parse_record(raw: bytes) -> dict:
    """url, page_id, payload_bytes, payload_digest, record_type, refers_to, payload (None in a revisit); ValueError if anything disagrees.

    Records of other writers need not have the page and payload fields of ours: page_id and refers_to are then null, and
    the payload is what follows the HTTP head, or the whole block of a record without one. A payload in chunks is kept
    as it is and its digest, of unknown form, is not checked.
    """
    head, gap, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not gap or version not in VERSIONS:
        raise ValueError("no WARC header")
    fields = _fields(lines)
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - fields.keys():
        raise ValueError(f"headers missing: {sorted(missing)}")
    if not fields["content-length"].isdecimal():
        raise ValueError("Content-Length is no number")
    size, kind = int(fields["content-length"]), fields["warc-type"].lower()
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("Content-Length doesn't match the record")
    if kind not in TYPES:
        raise ValueError(f"record type {kind}")
    block, http = rest[:size], b""
    _checked(fields.get("warc-block-digest"), block, "block")
    payload = block
    if fields.get("content-type", "").lower().startswith("application/http"):
        http, cut, payload = block.partition(b"\r\n\r\n")
        if not cut and kind != "revisit":
            raise ValueError("no HTTP head")
    length, digest = fields.get("warc-payload-length"), fields.get("warc-payload-digest")
    if kind == "revisit":
        if payload or "warc-profile" not in fields or ("warc-page-id" in fields and "warc-refers-to-page-id" not in fields):
            raise ValueError("bad revisit record")
    else:
        if length is not None and int(length) != len(payload):
            raise ValueError("payload length doesn't match")
        if b"\r\ntransfer-encoding:" not in http.lower():
            _checked(digest, payload, "payload")
        digest = digest or f"sha1:{_b32(hashlib.sha1(payload).hexdigest())}"
        length = len(payload)
    number = lambda v: int(v) if v else None
    return {
        "page_id": number(fields.get("warc-page-id")), "payload_bytes": None if length is None else int(length), "payload_digest": digest.removeprefix("sha1:") if digest else None, "record_type": kind,
        "refers_to": number(fields.get("warc-refers-to-page-id")), "payload": None if kind == "revisit" else payload, "url": fields.get("warc-target-uri"),
    }


def frames(data: bytes, at: int) -> Iterator[tuple[int, int]]:
    """(from, to) of each Zstandard frame from ``at`` on, found by its block headers; skippable frames are passed over."""
    import zstandard

    view = memoryview(data)
    while at < len(data):
        if len(data) - at >= 8 and data[at + 1 : at + 4] == SKIPPABLE.to_bytes(4, "little")[1:] and data[at] >> 4 == 5:
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            if at > len(data):
                raise ValueError("a skippable frame is cut off")
            continue
        if len(data) - at < 6 or struct.unpack_from("<I", data, at)[0] != FRAME:
            raise ValueError("no Zstandard frame where one should begin")
        end = at + zstandard.frame_header_size(view[at : at + 18])
        last = False
        while not last:
            if end + 3 > len(data):
                raise ValueError("the last frame is cut off")
            block = int.from_bytes(view[end : end + 3], "little")
            last, kind, size = block & 1, block >> 1 & 3, block >> 3
            if kind == 3:
                raise ValueError("reserved block type")
            end += 3 + (1 if kind == 1 else size)
        end += 4 * (data[at + 4] >> 2 & 1)
        if end > len(data):
            raise ValueError("the last frame is cut off")
        yield at, end
        at = end


def read_archive(data: bytes) -> Iterator[dict]:
    """The records of one archive; the dictionary may itself be a Zstandard frame."""
    import zstandard

    if len(data) < 8:
        raise ValueError("too short for an archive")
    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE or size < 4 or 8 + size > len(data):
        raise ValueError("no leading dictionary frame")
    raw = data[8 : 8 + size]
    if struct.unpack_from("<I", raw)[0] == FRAME:
        raw = zstandard.ZstdDecompressor().decompress(raw)
    unzip = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    view = memoryview(data)
    for a, b in frames(data, 8 + size):
        yield parse_record(_unzipped(unzip, view[a:b]))


def _unzipped(unzip, frame: memoryview) -> bytes:
    """One whole frame, also one that doesn't tell its size."""
    import zstandard

    if zstandard.frame_content_size(frame) >= 0:
        return unzip.decompress(frame)
    one = unzip.decompressobj()
    out = one.decompress(frame)
    if not one.eof:
        raise ValueError("a frame is cut off")
    return out


def train_dictionary(pages: DataFrame, samples: int = 256, most: int = 64_000) -> bytes:
    """A compression dictionary from ``samples`` whole payloads at most, those of least hash below ``most`` bytes.

    With too few to train on, records of numbered pages made by a rule take their place, so it is a trained one always.
    """
    small = pages.where(F.col("page_id").isNotNull() & F.length("html").between(1, most))
    ids = [r["page_id"] for r in small.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(samples).collect()]  # ids first: no payload but the chosen ones leaves its task
    own = small.where(F.col("page_id").isin(ids)).orderBy(F.xxhash64("page_id"), "page_id", "sha1").limit(samples)  # an id can have any number of rows
    few = sorted(own.select("page_id", "html").collect()) if ids else []
    return train_dictionary_from([_sample(r["page_id"], r["html"].encode()) for r in few])


def train_dictionary_from(rows: list[bytes]) -> bytes:
    """A trained dictionary from sample records, or from made ones where these are too few."""
    import zstandard

    try:
        return zstandard.train_dictionary(32_768, rows).as_bytes()
    except zstandard.ZstdError:
        made = [_sample(k, b"".join(b"<p>%d %s</p>" % (k * j, hashlib.sha1(b"%d.%d" % (k, j)).hexdigest().encode()) for j in range(20))) for k in range(256)]
        return zstandard.train_dictionary(16_384, made).as_bytes()


def _sample(page_id: int, payload: bytes) -> bytes:
    return record({"record_type": "response", "page_id": page_id, "url": "https://example.org/", "sha1": hashlib.sha1(payload).hexdigest()}, payload)


def revisit_plan(pages: DataFrame, least: int = 0, salts: int = 64) -> DataFrame:
    """Adds sha1, payload_bytes, record_type and refers_to to (page_id, url, html).

    Payloads below ``least`` bytes are always responses. A null html is an empty payload. A null page_id is a response
    only if no page with an id has its payload, and it is then shared by none. Equal (page_id, payload) rows are all
    responses where that id is the largest.
    """
    bytes_ = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    known = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(bytes_).alias("sha1"), F.octet_length(bytes_).cast("long").alias("payload_bytes"))
    keyed = known.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int"))
    part = keyed.where(F.col("payload_bytes") >= least).groupBy("sha1", "payload_bytes", "salt").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n"))
    whole = part.groupBy("sha1", "payload_bytes").agg(F.max("top").alias("first"), F.sum("n").alias("n"), F.collect_set("salt").alias("salts"))
    shared = whole.where("n > 1").select("sha1", "payload_bytes", "first", F.explode("salts").alias("salt"))
    joined = keyed.join(shared, ["sha1", "payload_bytes", "salt"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "url", "html", "sha1", "payload_bytes", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def write_archives(plan: DataFrame, folder: str, dictionary: bytes, level: int = 3, file_bytes: int = 64 << 20) -> DataFrame:
    """Write the rows of :func:`revisit_plan` as part-*.warc.zst below ``folder``; returns (name, records, bytes), a row per file.

    The rows are those of a table in the shared folder, so a retried task writes the same files. No rows: no files.
    """
    lead = struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        zipper = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, size
            name = f"part-{part:06d}-{seq:06d}.warc.zst"
            put(f"{folder}/{name}", lead + b"".join(held))
            row = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)], pa.int64()), pa.array([size], pa.int64())], ["name", "records", "bytes"])
            held.clear()
            seq, size = seq + 1, 0
            return row

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                for row in batch.slice(at, 200).to_pylist():
                    held.append(zipper.compress(record(row, (row["html"] or "").encode())))
                    size += len(held[-1])
                    if size >= file_bytes:
                        yield flush()
        if held:
            yield flush()

    return written(plan.mapInArrow(run, "name string, records long, bytes long"), "warc-manifest")[0]


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """All records of the archives below ``folder``, of any WARC type: the fields of :func:`parse_record`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("url", pa.string())])
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows = []
                for row in read_archive(data):
                    rows.append(row)
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content")
    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, url string")


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write WARC archives of ``pages`` (page_id, url, html) and read them back; other columns are not read.

    An empty table gives an empty result. See :func:`revisit_plan` for nulls and repeats.
    """
    spark = pages.sparkSession
    plan, at = written(revisit_plan(pages), "warc-plan")
    folder = shared_dir(spark, "warc")
    manifest = write_archives(plan, folder, train_dictionary(plan))
    drop(spark, at)
    if not manifest.take(1):
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, url string")
    return read_archives(spark, folder)
