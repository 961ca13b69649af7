"""WARC archives: monolithic gzip files, and their normaliser.

A monolithic archive is one gzip stream over the whole file, as crawlers and
command line tools often leave it: no record can be read without inflating all
before it.  The normaliser inflates such a file once, as a stream, rewrites
every record as a gzip member of its own, and writes a sidecar index of
offsets.  On the way, records whose payload another record holds become
revisits of that one.

Files are written by tasks below a folder that all executors share, under names
that no other attempt uses; only files listed in the stored manifest count, so
a task that runs again leaves nothing but an unused file.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborist.session import cut_lineage, drop_path

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_BYTES = 256 << 20
READ_BYTES = 1 << 20
DATE = "2020-01-01T00:00:00Z"

WRITTEN = "archive STRING, record LONG, page_id LONG, content BINARY, payload_bytes LONG"
INDEX = "archive STRING, page_id LONG, offset LONG, length LONG, record_type STRING"
READ = "page_id LONG, url STRING, payload_bytes LONG, payload_digest STRING, record_type STRING, refers_to LONG, payload BINARY"


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or local path."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), unquote(urlsplit(uri).path)
    return fs.FileSystem.from_uri(uri)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, fields: dict[str, str], block: bytes) -> bytes:
    head = {"WARC-Type": kind, **fields, "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def http_head(payload_bytes: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()


def fields_of(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")[1:]
    return dict(line.split(": ", 1) for line in lines if line)


def records(stream: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of a stream of inflated bytes."""
    held = bytearray()
    done = False

    def fill(size: int) -> bool:
        nonlocal done
        while len(held) < size and not done:
            piece = next(stream, None)
            if piece is None:
                done = True
            else:
                held.extend(piece)
        return len(held) >= size

    while fill(1):
        searched = 0
        while (end := held.find(b"\r\n\r\n", max(0, searched - 3))) < 0:
            searched = len(held)
            if not fill(searched + 1):
                raise ValueError("archive ends within a record's header")
        fields = fields_of(bytes(held[:end]))
        size = int(fields["Content-Length"])
        if not fill(end + 4 + size + 4):
            raise ValueError("archive ends within a record's block")
        yield fields, bytes(held[end + 4 : end + 4 + size])
        del held[: end + 8 + size]


def inflated(source: pa.NativeFile) -> Iterator[bytes]:
    """Inflated bytes of a gzip file, member after member, in bounded pieces."""
    inflate = zlib.decompressobj(31)
    while data := source.read(READ_BYTES):
        while data:
            piece = inflate.decompress(data, READ_BYTES)
            if piece:
                yield piece
            data = inflate.unconsumed_tail
            if inflate.eof:
                data = inflate.unused_data
                inflate = zlib.decompressobj(31)
    if tail := inflate.flush():
        yield tail


def write_monolithic(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write every row of `pages` (page_id, url, html) as a response record; returns the manifest.

    Each task writes its partition as one gzip stream per file, starting a new
    file beyond `file_bytes` of payload.  The manifest has one row per record:
    archive, record number, page_id, SHA-256 of the payload and its length.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = place(folder)
        system.create_dir(root, recursive=True)
        out = None

        def finished() -> pa.RecordBatch:
            sink.write(squeeze.flush())
            sink.close()
            return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("archive", pa.string()), ("record", pa.int64()), ("page_id", pa.int64()), ("content", pa.binary()), ("payload_bytes", pa.int64())]))

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    out = f"mono-{uuid.uuid4().hex}.warc.gz"
                    sink, squeeze, rows, written = system.open_output_stream(f"{root}/{out}", compression=None), zlib.compressobj(3, zlib.DEFLATED, 31), [], 0
                payload = (row["html"] or "").encode()
                fields = {
                    "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{out}#{len(rows)}')}>",
                    "WARC-Date": DATE,
                    "WARC-Target-URI": quote(row["url"] or "", safe=";/?:@&=+$,#!*'()%~[]"),
                    "WARC-Payload-Digest": f"sha1:{base32_sha1(payload)}",
                    "Content-Type": "application/http; msgtype=response",
                }
                if row["page_id"] is not None:
                    fields["Page-ID"] = str(row["page_id"])
                sink.write(squeeze.compress(record("response", fields, http_head(len(payload)) + payload)))
                rows.append({"archive": out, "record": len(rows), "page_id": row["page_id"], "content": hashlib.sha256(payload).digest(), "payload_bytes": len(payload)})
                written += len(payload)
                if written >= file_bytes:
                    yield finished()
                    out = None
        if out is not None:
            yield finished()

    return cut_lineage(pages.select("page_id", "url", "html").mapInArrow(write, WRITTEN))


def roles(manifest: DataFrame, min_payload: int = 0) -> DataFrame:
    """What each record becomes: of equal payloads the largest page_id stays a response, the others revisit it.

    Payloads below `min_payload` bytes are all responses.  The choice is an
    aggregate with a combine before the shuffle; the join back moves digests
    only, and adaptive execution splits a payload that a third of all rows hold.
    """
    keeper = manifest.where(F.col("payload_bytes") >= min_payload).groupBy("content").agg(
        F.max(F.struct("page_id", "archive", "record")).alias("keeper")
    )
    own = F.struct("page_id", "archive", "record")
    return manifest.join(keeper, "content", "left").select(
        "archive", "record",
        (F.col("keeper").isNotNull() & (F.col("keeper") != own)).alias("revisit"),
        F.col("keeper.page_id").alias("refers_to"), F.col("keeper.archive").alias("refers_archive"), F.col("keeper.record").alias("refers_record"),
    )


def per_archive(rows: DataFrame, *then: str) -> DataFrame:
    """`rows` in as many partitions as they name archives, by archive and then by the columns of `then`."""
    archives = rows.agg(F.count_distinct("archive")).first()[0]
    return rows.repartitionByRange(max(1, archives), "archive", *then)


def normalise(wanted: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrite the monolithic archives named in `wanted` (see `roles`) record by record; returns the manifest.

    Archives are dealt to as many tasks as there are archives: the rows that name
    them are few, and would be put into one task for their size, while the work
    lies in the files.  One task handles one archive: it inflates the file once, holds one record at
    a time, and writes `<archive>` and its sidecar `<archive>.cdxj`, a line of
    JSON per record with offset and length.
    """

    def rewrite(table: pa.Table) -> pa.Table:
        (old,) = set(table["archive"].to_pylist())
        role = {r["record"]: r for r in table.to_pylist()}
        reading, source_root = place(source)
        writing, target_root = place(target)
        writing.create_dir(target_root, recursive=True)
        new = f"{uuid.uuid4().hex}.warc.gz"
        offset = 0
        with (
            reading.open_input_stream(f"{source_root}/{old}", compression=None) as packed,
            writing.open_output_stream(f"{target_root}/{new}", compression=None) as out,
            writing.open_output_stream(f"{target_root}/{new}.cdxj", compression=None) as index,
        ):
            for number, (fields, block) in enumerate(records(inflated(packed))):
                r = role[number]
                kind = "revisit" if r["revisit"] else "response"
                fields.pop("WARC-Type")
                fields.pop("Content-Length")
                if r["revisit"]:
                    block = block[: block.index(b"\r\n\r\n") + 4]
                    target_id = uuid.uuid5(uuid.NAMESPACE_URL, f"{r['refers_archive']}#{r['refers_record']}")
                    fields |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": f"<urn:uuid:{target_id}>"}
                    if r["refers_to"] is not None:
                        fields["Refers-To-Page"] = str(r["refers_to"])
                member = gzip.compress(record(kind, fields, block), 6, mtime=0)
                out.write(member)
                page = fields.get("Page-ID")
                line = {"archive": new, "page_id": None if page is None else int(page), "offset": offset, "length": len(member), "record_type": kind}
                index.write(json.dumps(line).encode() + b"\n")
                offset += len(member)
        return pa.table({"archive": [new], "records": pa.array([len(role)], pa.int64()), "bytes": pa.array([offset], pa.int64())})

    wanted = cut_lineage(wanted)
    return cut_lineage(per_archive(wanted).groupBy("archive").applyInArrow(rewrite, "archive STRING, records LONG, bytes LONG"))


def offset_index(manifest: DataFrame, folder: str) -> DataFrame:
    """The sidecar lines of the archives in the manifest."""
    lines = manifest.sparkSession.read.schema(INDEX).option("pathGlobFilter", "*.cdxj").json(folder)
    return lines.join(manifest.select("archive"), "archive", "left_semi")


def read_records(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Records at the offsets of `index`, each inflated alone.

    Returns page_id, url, payload_bytes, payload_digest, record_type, refers_to
    and payload (null for revisits).  Length and digest are of the full payload
    also for revisits; a response's are computed from its bytes and must agree
    with its header.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = place(folder)
        name, source = None, None
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["archive"] != name:
                    if source is not None:
                        source.close()
                    name, source = row["archive"], system.open_input_file(f"{root}/{row['archive']}")
                source.seek(row["offset"])
                ((fields, block),) = records(iter([gzip.decompress(source.read(row["length"]))]))
                cut = block.index(b"\r\n\r\n") + 4
                stated = int(fields_of(block[:cut])["Content-Length"])
                payload = block[cut:] if fields["WARC-Type"] == "response" else None
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if payload is not None and (len(payload) != stated or base32_sha1(payload) != digest):
                    raise ValueError(f"damaged record in {name} at {row['offset']}")
                page, refers = fields.get("Page-ID"), fields.get("Refers-To-Page")
                rows.append({
                    "page_id": None if page is None else int(page), "url": unquote(fields["WARC-Target-URI"]), "payload_bytes": stated,
                    "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": None if refers is None else int(refers),
                    "payload": payload if payloads else None,
                })
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]))
        if source is not None:
            source.close()

    dealt = per_archive(cut_lineage(index.select("archive", "offset", "length")), "offset")
    return dealt.sortWithinPartitions("archive", "offset").mapInArrow(read, READ)


def archive_pages(pages: DataFrame, folder: str, min_payload: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Archive `pages` (page_id, url, html) below `folder`; returns the offset index of the normalised archives.

    A null html is an empty payload, a null url an empty target; a null page_id
    is below every other.  Repeated rows are records of their own: one is the
    response, the others revisit it.  Extra columns are ignored.  An empty
    table gives no archives and an empty index.
    """
    folder = folder.rstrip("/")
    written = write_monolithic(pages, f"{folder}/monolithic", file_bytes)
    done = normalise(roles(written, min_payload), f"{folder}/monolithic", f"{folder}/records")
    drop_path(pages.sparkSession, f"{folder}/monolithic")
    if done.isEmpty():
        return pages.sparkSession.createDataFrame([], INDEX)
    return offset_index(done, f"{folder}/records")
