"""WARC archives: write whole-file gzip streams, normalise them, read them back.

`write_monolithic` writes each partition's records as gzip files that are one
stream each, as careless crawlers leave them. `normalise` inflates such a stream
once, writes every record as a gzip member of its own, and puts beside it a
sidecar index of offsets. `read_records` opens single members by that index.
Files go to a folder that driver and executors share, through pyarrow's
filesystems, under a name of the task attempt's own: a lost or repeated task
leaves a file that no row names.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, cut, shared_dir, small_batches

DATE = "2026-01-01T00:00:00Z"
RECORD_ID = "<urn:page:{}>"
INDEX_SCHEMA = "archive string, sidecar string, records long"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id, url, payload: bytes, digest: str, response_id) -> bytes:
    """One WARC/1.0 record: a response, or a revisit of `response_id` that leaves out the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (b"" if response_id is not None else payload)
    target = "".join(c if c > " " else f"%{ord(c):02X}" for c in url) if url is not None else None
    head = ["WARC/1.0", f"WARC-Type: {'response' if response_id is None else 'revisit'}", f"WARC-Record-ID: {RECORD_ID.format('' if page_id is None else page_id)}", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {target}"] if target else []
    head += [f"WARC-Payload-Digest: sha1:{digest}"]
    if response_id is not None:
        head += [f"WARC-Refers-To: {RECORD_ID.format(response_id)}", "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_headers(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def inflate(stream, piece: int = 1 << 20) -> Iterator[bytes]:
    """The plain bytes of a gzip file of one member or several, piece by piece."""
    one = zlib.decompressobj(31)
    while data := stream.read(piece):
        while data:
            if plain := one.decompress(data, piece):
                yield plain
            data = one.unconsumed_tail
            if one.eof:
                data = one.unused_data
                one = zlib.decompressobj(31)
    if plain := one.flush():
        yield plain


def split_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record) for each record of the plain stream; one record is held at a time."""
    held = bytearray()
    ended = False

    def more() -> bool:
        nonlocal ended
        piece = next(pieces, None)
        ended = piece is None
        held.extend(piece or b"")
        return not ended

    while True:
        seen = 0
        while (at := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0 and not ended:
            seen = len(held)
            more()
        if at < 0:
            if held.strip():
                raise ValueError("a record breaks off in its headers")
            return
        headers = parse_headers(bytes(held[:at]))
        size = at + 4 + int(headers["content-length"]) + 4
        while len(held) < size:
            if not more():
                raise ValueError("a record breaks off in its block")
        yield headers, bytes(held[:size])
        del held[:size]


def _opened(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def with_revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload and response_id: of equal payloads of at least `least_bytes`
    bytes, the largest id is the response (response_id null) and the others name it.
    A null payload is empty. Rows that repeat the largest id are all responses."""
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("payload"))
    base = base.withColumn("digest", F.sha1("payload"))
    groups = base.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1").drop("n")
    return base.join(groups, "digest", "left").select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest")).alias("response_id"))


def write_monolithic(records: DataFrame, folder: str, roll_bytes: int = 32 << 20, level: int = 6) -> DataFrame:
    """Write `page_id, url, payload, response_id` rows; one row (archive) per file, of about `roll_bytes` plain bytes."""

    def run(batches):
        files, top = _opened(folder)
        files.create_dir(top)
        name = out = deflate = None
        size = 0

        def close():
            out.write(deflate.flush())
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name])], names=["archive"])

        for batch in batches:
            for start, payloads in batches_of(batch.column(2), 4 << 20):
                part = batch.slice(start, len(payloads))
                for page_id, url, payload, response_id in zip(*(part.column(i).to_pylist() for i in range(4))):
                    if out is None:
                        name = f"{top}/{uuid.uuid4().hex}.warc.gz"
                        out, deflate, size = files.open_output_stream(name, compression=None), zlib.compressobj(level, zlib.DEFLATED, 31), 0
                    plain = record_bytes(page_id, url, payload, payload_digest(payload), response_id)
                    out.write(deflate.compress(plain))
                    size += len(plain)
                    if size >= roll_bytes:
                        yield close()
                        out = None
        if out is not None:
            yield close()

    return records.mapInArrow(run, "archive string")


def normalise(archives: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Rewrite whole-file streams record by record; one row (archive, sidecar, records) per file.

    The sidecar has a JSON line for each record: offset and length of its member, its id and type.
    A file that breaks off raises an error.
    """

    def run(batches):
        files, top = _opened(folder)
        files.create_dir(top)
        for batch in batches:
            for source in batch.column(0).to_pylist():
                target = f"{top}/{uuid.uuid4().hex}.warc.gz"
                offset = records = 0
                with files.open_input_stream(source, compression=None) as stream, files.open_output_stream(target, compression=None) as out, files.open_output_stream(f"{target}.index", compression=None) as index:
                    for headers, record in split_records(inflate(stream)):
                        one = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = one.compress(record) + one.flush()
                        out.write(member)
                        index.write((json.dumps({"offset": offset, "length": len(member), "id": headers["warc-record-id"], "type": headers["warc-type"]}) + "\n").encode())
                        offset += len(member)
                        records += 1
                yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([f"{target}.index"]), pa.array([records], pa.int64())], names=["archive", "sidecar", "records"])

    return archives.mapInArrow(run, INDEX_SCHEMA)


def read_records(indexed: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """One row per record, each read from its own member: page_id, payload_bytes, payload_digest, record_type, refers_to, payload (null unless asked for; revisits have none)."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def page_of(record_id: str | None):
        digits = (record_id or "").removeprefix("<urn:page:").removesuffix(">")
        return int(digits) if digits else None

    def run(batches):
        files, _ = _opened(folder)
        for batch in batches:
            for archive, sidecar in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with files.open_input_stream(sidecar, compression=None) as stream:
                    entries = [json.loads(x) for x in stream.read().splitlines()]
                rows, held = [], 0
                with files.open_input_file(archive) as source:
                    for entry in entries:
                        source.seek(entry["offset"])
                        record = zlib.decompress(source.read(entry["length"]), 31)
                        head, _, rest = record.partition(b"\r\n\r\n")
                        headers = parse_headers(head)
                        http, _, payload = rest[: int(headers["content-length"])].partition(b"\r\n\r\n")
                        digest = headers["warc-payload-digest"].removeprefix("sha1:")
                        full = headers["warc-type"] == "response"
                        if full and payload_digest(payload) != digest:
                            raise ValueError(f"{archive} at {entry['offset']}: the payload has another digest")
                        length = len(payload) if full else int(parse_headers(http)["content-length"])
                        rows.append((page_of(headers["warc-record-id"]), length, digest, headers["warc-type"], page_of(headers.get("warc-refers-to")), payload if full and with_payload else None))
                        held += len(payload) if with_payload else 100
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return indexed.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def remove_streams(written: DataFrame, folder: str) -> None:
    """Deletes whole-file streams once their members are indexed; those that are gone already are passed by."""

    def run(batches):
        files, _ = _opened(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                if files.get_file_info(name).is_file:
                    files.delete_file(name)
            yield batch

    written.mapInArrow(run, "archive string").write.format("noop").mode("overwrite").save()


def archive_pages(pages: DataFrame, folder: str | None = None, keep_streams: bool = False, **columns) -> DataFrame:
    """Write, normalise and index `pages`; the index rows (archive, sidecar, records). An empty table has none. The whole-file streams go when the index is kept, unless they are wanted."""
    spark = small_batches(pages).sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    written = cut(write_monolithic(with_revisits(pages, **columns), f"{folder}/streams"))
    indexed = cut(normalise(written.repartition(spark.sparkContext.defaultParallelism * 4), f"{folder}/members"))
    if not keep_streams:
        remove_streams(written, f"{folder}/streams")
    return indexed
