"""WARC archives with an embedded Zstandard dictionary, and their reader.

An archive starts with a skippable frame that holds a dictionary built from its own
records; each record is then one Zstandard frame, so a record can be read alone.
Files get names that no other attempt of a task uses; the table of written archives
is stored by Spark, so files of failed attempts are never listed or read, and
``remove_unlisted`` deletes them. Record ids are derived from where a row lies in its
table, so that rows without an id and rows that repeat one have ids of their own.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import shared_dir
from .common import stored, text_or_empty, with_place

# Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_OK = "HTTP/1.1 200 OK"

RAW_BYTES = 16 << 20  # payload bytes held for one archive before it is written
SAMPLE_BYTES = 2 << 20  # of them shown to the dictionary builder, spread evenly
DICTIONARY_BYTES = 64 << 10
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uri(file: str, row: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{file}#{row}')}>"


def header_value(text: str | None) -> str:
    return (text or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if text and ("\r" in text or "\n" in text) else text or ""


def record(uri: str, page_id: int | None, url: str | None, payload: bytes, refers_to: tuple[int, str] | None, date: str) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit of ``refers_to`` (page, record id) with the HTTP header only."""
    revisit = refers_to is not None
    http = f"{HTTP_OK}\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {uri}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {header_value(url)}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Key: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {IDENTICAL}", f"WARC-Refers-To: {refers_to[1]}", f"X-Refers-To-Key: {refers_to[0]}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary_of(records: list[bytes]) -> bytes:
    """A trained dictionary, or the sample itself as raw content where there is too little to train on."""
    step = max(1, sum(map(len, records)) // SAMPLE_BYTES)
    sample = [r[: SAMPLE_BYTES // 8] for r in records[::step]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()
    except zstandard.ZstdError:
        return b"WARC/1.1\r\n" + b"".join(sample)[:DICTIONARY_BYTES]


def archive_of(records: list[bytes], level: int) -> Iterator[bytes]:
    raw = dictionary_of(records)
    yield struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw
    packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(raw), write_checksum=True)
    for r in records:
        yield packer.compress(r)


def records_of(stream) -> Iterator[bytes]:
    """The records of one archive, read front to back; holds one record at a time."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive does not start with a dictionary frame")
    words = zstandard.ZstdCompressionDict(stream.read(size))
    rest, ended = b"", False
    while True:
        if not rest and not ended:
            rest = stream.read(1 << 20)
        if not rest:
            return
        frame, out = zstandard.ZstdDecompressor(dict_data=words).decompressobj(), []
        while not frame.eof:
            out.append(frame.decompress(rest))
            rest = frame.unused_data if frame.eof else stream.read(1 << 20)
            if not rest and not frame.eof:
                raise ValueError("the archive ends inside a record")
        yield b"".join(out)


def parsed(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields, HTTP header and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_archives(
    pages: DataFrame,
    directory: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_revisit_bytes: int = 0,
    level: int = 3,
    date: str = "1970-01-01T00:00:00Z",
    raw_bytes: int = RAW_BYTES,
) -> DataFrame:
    """Write all rows as records; the stored table ``archive, records, bytes`` of what was written.

    Of records with equal payloads (by SHA-256 and length) of ``min_revisit_bytes``
    or more, the one with the largest id is a response and the others revisit it; if
    rows repeat that id they are all responses, and so are all rows of a payload
    that has null ids only. A null payload is empty, a null url an empty field.
    Other columns aren't read. An empty table gives no archive.

    The shuffle is by payload digest; copies meet one row with the largest id, so
    Spark can split a hot payload.
    """
    rows = with_place(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")), "warc-pages").select(
        F.col("id").cast("long").alias("id"), F.col("url").cast("string").alias("url"), text_or_empty(F.col("html")).cast("binary").alias("payload"), "at"
    )
    rows = rows.withColumn("key", F.unhex(F.sha2("payload", 256)))
    large = rows.where(F.length("payload") >= min_revisit_bytes)
    several = large.groupBy("key").agg(F.max(F.struct("id", "at")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    several = stored(several.drop("n"), "warc-copies")
    revisits = "first.id is not null and not (id <=> first.id)"
    marked = rows.join(several, "key", "left").select(
        "id", "url", "payload", "at.file", "at.row", F.expr(f"case when {revisits} then first.id end").alias("first"), "first.at.file", "first.at.row"
    )
    marked = marked.toDF("id", "url", "payload", "file", "row", "first", "first_file", "first_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = place(directory)
        held, size, listed = [], 0, []

        def flush():
            name = f"{folder}/{uuid.uuid4().hex}.warc.zst"
            written = 0
            with system.open_output_stream(name, compression=None) as out:
                for part in archive_of(held, level):
                    out.write(part)
                    written += len(part)
            listed.append((name, len(held), written))
            held.clear()

        for batch in batches:
            for page_id, url, payload, file, row, first, first_file, first_row in zip(*(c.to_pylist() for c in batch.columns)):
                response = None if first is None else (first, record_uri(first_file, first_row))
                held.append(record(record_uri(file, row), page_id, url, payload, response, date))
                size += len(held[-1])
                if size >= raw_bytes:
                    flush()
                    size = 0
        if held:
            flush()
        names, counts, sizes = zip(*listed) if listed else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["archive", "records", "bytes"]
        )

    place(directory)[0].create_dir(place(directory)[1], recursive=True)
    return stored(marked.mapInArrow(run, "archive string, records long, bytes long"), "warc-listing")


def read_archives(listing: DataFrame, directory: str, bytes_per_task: int = 32 << 20) -> DataFrame:
    """Every record of the listed archives, checked: responses against their digest, lengths against their headers.

    Archives are dealt out by range into tasks of about ``bytes_per_task``, though into
    as many as there are cores where there are archives enough.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = place(directory)
        for batch in batches:
            for name, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                with system.open_input_stream(name, compression=None) as stream:
                    for data in records_of(stream):
                        fields, http, payload = parsed(data)
                        size = int(http.rsplit(b"Content-Length: ", 1)[1])
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        kind = fields["WARC-Type"]
                        if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
                            raise ValueError(f"a record of {name} does not match its digest")
                        own, other = fields.get("X-Page-Key"), fields.get("X-Refers-To-Key")
                        rows.append((own and int(own), size, digest, kind, other and int(other)))
                if len(rows) != count:
                    raise ValueError(f"{name} holds {len(rows)} records, not {count}")
                columns = zip(*rows)
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)],
                    ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
                )

    total = listing.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    cores = listing.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(total.n, max(cores, -(-total.bytes // bytes_per_task))))
    # A given number of tasks, which Spark does not merge.
    spread = listing.select("archive", "records").repartitionByRange(tasks, "archive")
    return spread.mapInArrow(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )


def remove_unlisted(directory: str, *listings: DataFrame) -> int:
    """Delete archives of the folder that none of the listings names, left by failed attempts; returns their number.

    Not while somebody writes there: unfinished archives aren't listed either. Files
    are found, compared and deleted by Spark, by their names alone.
    """
    listed = listings[0].select("archive")
    for more in listings[1:]:
        listed = listed.unionByName(more.select("archive"))
    name = lambda path: F.element_at(F.split(path, "/"), -1)
    reader = listed.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst")
    found = reader.load(directory).select(name("path").alias("name"))
    orphans = found.join(listed.select(name("archive").alias("name")), "name", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = place(directory)
        for batch in batches:
            gone = 0
            for file in batch.column(0).to_pylist():
                try:
                    system.delete_file(f"{folder}/{file}")
                    gone += 1
                except FileNotFoundError:  # another attempt of this task was there first
                    pass
            yield pa.RecordBatch.from_arrays([pa.array([gone], pa.int64())], ["gone"])

    return orphans.mapInArrow(run, "gone long").agg(F.coalesce(F.sum("gone"), F.lit(0)).alias("gone")).first().gone


def archive_folder(spark) -> str:
    return shared_dir(spark, "warc")
