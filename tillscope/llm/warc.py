"""WARC archives: one gzip member per record, written and read in tasks.

Archives go to the shared folder through pyarrow's file systems, since Spark has no
binary sink for them. Readers go through an archive in sequence: chunks are inflated
as they come, records are framed by their content length, and every digest is
checked.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.llm.columns import apart
from tillscope.session import materialise, scratch_path, ship_package

# Format version, revisit profile, and the smallest payload that a
# revisit record may stand for.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_REVISIT_BYTES = 100

_CHUNK = 1 << 16


def payload_of(text: Column) -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return F.encode(F.coalesce(text, F.lit("")), "utf-8")


def mark_revisits(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` with payload, digest, record type and ``refers_to``.

    Of equal payloads of at least 100 bytes, the one with the smallest page_id is
    the response and the others revisit it. Rows that repeat the smallest page_id
    are all responses. Rows without an id revisit, unless no equal payload has one.
    Digests are grouped with a combine before the shuffle, and come back by a plain
    join that AQE can split, so a payload may have any number of copies.
    """
    payload = payload_of(F.col("html"))
    marked = pages.select(
        F.col("page_id").cast("long"),
        F.col("url").cast("string"),
        payload.alias("payload"),
        F.sha2(payload, 256).alias("digest"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
    )
    copies = (
        marked.where(F.col("payload_bytes") >= MIN_REVISIT_BYTES)
        .groupBy(F.col("digest").alias("_digest"), F.col("payload_bytes").alias("_bytes"))
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND first_id IS NOT NULL")
        .select("_digest", apart(F.col("_bytes")).alias("_bytes"), "first_id")
    )
    same = (F.col("digest") == F.col("_digest")) & (F.col("payload_bytes") == F.col("_bytes"))
    later = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return marked.join(copies, same, "left").select(
        "page_id",
        "url",
        "payload",
        "digest",
        F.when(later, "revisit").otherwise("response").alias("record_type"),
        F.when(later, F.col("first_id")).alias("refers_to"),
    )


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _id_of(name: str | None) -> int | None:
    digits = name.removeprefix("<urn:page:").removesuffix(">") if name else ""
    return int(digits) if digits else None


def record(
    page_id: int | None,
    url: str | None,
    payload: bytes,
    digest: str,
    record_type: str,
    refers_to: int | None,
    date: str,
) -> bytes:
    """One record as a gzip member. A revisit holds the HTTP head alone."""
    head = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = head if record_type == "revisit" else head + payload
    fields = {
        "WARC-Type": record_type,
        "WARC-Record-ID": record_id(page_id),
        "WARC-Date": date,
        "WARC-Target-URI": "".join((url or "").split("\r")).replace("\n", "") or None,
        "WARC-Refers-To": record_id(refers_to) if record_type == "revisit" else None,
        "WARC-Profile": REVISIT_PROFILE if record_type == "revisit" else None,
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": str(len(block)),
    }
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in fields.items() if v is not None)]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    whole = b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"
    return packer.compress(whole) + packer.flush()


def members(stream: BinaryIO) -> Iterator[tuple[int, Iterator[bytes]]]:
    """``(offset, inflated chunks)`` of each gzip member, one after the other.

    The chunks of a member must be used up before the next member. A cut-off
    member raises.
    """
    rest, offset = stream.read(_CHUNK), 0
    while rest:
        unpacker = zlib.decompressobj(31)

        def chunks() -> Iterator[bytes]:
            nonlocal rest, offset
            while not unpacker.eof:
                if not rest:
                    rest = stream.read(_CHUNK)
                    if not rest:
                        raise ValueError("archive ends within a record")
                fed = len(rest)
                out = unpacker.decompress(rest, _CHUNK)
                rest = unpacker.unconsumed_tail or unpacker.unused_data
                offset += fed - len(rest)
                if out:
                    yield out

        yield offset, chunks()
        if not rest:
            rest = stream.read(_CHUNK)


def parse_record(chunks: Iterator[bytes]) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and the block of one record.

    The block is framed by Content-Length and checked against its digest.
    """
    held = bytearray()
    while (end := held.find(b"\r\n\r\n")) < 0:
        chunk = next(chunks, None)
        if chunk is None:
            raise ValueError("record without a complete header")
        held += chunk
    version, *lines = bytes(held[:end]).split(b"\r\n")
    if version != VERSION:
        raise ValueError(f"not a {VERSION.decode()} record: {version[:20]!r}")
    fields = {}
    for line in lines:
        name, _, value = line.partition(b":")
        fields[name.decode().lower()] = value.decode().strip()
    size = int(fields["content-length"])
    del held[: end + 4]
    digest, taken, parts = hashlib.sha256(), 0, []
    tail = bytearray()
    for chunk in _first(bytes(held), chunks):
        own = chunk[: size - taken]
        digest.update(own)
        parts.append(own)
        taken += len(own)
        tail += chunk[len(own) :]
    if taken != size or tail != b"\r\n\r\n":
        raise ValueError(f"record {fields.get('warc-record-id')}: content length does not frame it")
    if fields.get("warc-block-digest", "sha256:" + digest.hexdigest()) != (
        "sha256:" + digest.hexdigest()
    ):
        raise ValueError(f"record {fields.get('warc-record-id')}: block digest differs")
    return fields, b"".join(parts)


def _first(held: bytes, chunks: Iterator[bytes]) -> Iterator[bytes]:
    yield held
    yield from chunks


def write_archives(
    records: DataFrame,
    folder: str,
    date: str = "1970-01-01T00:00:00Z",
    max_bytes: int = 64 << 20,
) -> DataFrame:
    """Write ``mark_revisits`` rows to archives below ``folder``; return their manifest.

    Each task writes files of its own, of about ``max_bytes`` at most, and reports
    ``(path, records, bytes)`` once they are closed. The manifest is materialised:
    a repeated or lost attempt leaves files that no manifest names.
    """
    ship_package(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        out, path, count, size = None, "", 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": [count], "bytes": [size]})

        for batch in batches:
            columns = [batch.column(c) for c in names]
            for row in zip(*columns):
                if out is None:
                    path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.warc.gz"
                    out = system.open_output_stream(
                        f"{base.rstrip('/')}/{path.rpartition('/')[2]}", compression=None
                    )
                    count = size = 0
                written = record(*[v.as_py() for v in row], date)
                out.write(written)
                count, size = count + 1, size + len(written)
                if size >= max_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    names = ["page_id", "url", "payload", "digest", "record_type", "refers_to"]
    return materialise(
        records.select(names).mapInArrow(run, "path string, records long, bytes long")
    )


def read_archives(manifest: DataFrame) -> DataFrame:
    """The records of all archives that ``manifest(path)`` names.

    Returns page_id, url, ``record_type``, ``payload`` (null for a revisit),
    ``payload_bytes`` and ``payload_digest`` of the full payload, ``refers_to``,
    and the archive's path with the record's offset. One task reads an archive
    from front to back. A broken frame or a wrong digest raises.
    """
    ship_package(manifest.sparkSession)
    schema = (
        "page_id long, url string, record_type string, payload binary, payload_bytes long, "
        "payload_digest string, refers_to long, path string, offset long"
    )
    names = [part.split()[0] for part in schema.split(", ")]

    def records_of(path: str) -> Iterator[tuple]:
        system, place = fs.FileSystem.from_uri(path)
        with system.open_input_stream(place, compression=None) as stream:
            for offset, chunks in members(stream):
                fields, block = parse_record(chunks)
                head, _, payload = block.partition(b"\r\n\r\n")
                size = next(
                    int(line.partition(b":")[2])
                    for line in head.split(b"\r\n")
                    if line.lower().startswith(b"content-length:")
                )
                digest = fields["warc-payload-digest"].removeprefix("sha256:")
                revisit = fields["warc-type"] == "revisit"
                if not revisit and (
                    len(payload) != size or hashlib.sha256(payload).hexdigest() != digest
                ):
                    raise ValueError(f"{path} at {offset}: payload digest differs")
                yield (
                    _id_of(fields["warc-record-id"]),
                    fields.get("warc-target-uri"),
                    fields["warc-type"],
                    None if revisit else payload,
                    size,
                    digest,
                    _id_of(fields.get("warc-refers-to")),
                    path,
                    offset,
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [
            pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(),
            pa.string(), pa.int64(), pa.string(), pa.int64(),
        ]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), types)], names
            )

        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, held = [], 0
                for row in records_of(path):
                    rows.append(row)
                    held += row[4]
                    if held > 16 << 20 or len(rows) >= 4096:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return manifest.select("path").mapInArrow(run, schema)


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write every page to archives and read them back; see ``read_archives``.

    Null html is an empty payload; null urls and ids are left out of the record
    and come back null. An empty table gives no archives and no rows. Columns
    other than page_id, url and html are dropped.
    """
    folder = folder or scratch_path(pages.sparkSession, "warc")
    return read_archives(write_archives(mark_revisits(pages), folder))
