"""WARC archives: deduplicating writer, gzip normaliser with offset index, and reader.

Every task of the writer streams its records into one gzip member per file, as many
crawlers' tools do. The normaliser inflates such a file once as a stream, writes each
record as a member of its own and puts the members' offsets in a sidecar index, so that
any record can be read by itself. Files lie in the folder all executors share and are
opened through pyarrow's file systems. A task names its files anew on every attempt and
only names in its result count, so a lost executor leaves no half-written archive behind
that is read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagepulse.llm.common import fresh_path, materialise

MIN_REVISIT_BYTES = 1000
SEGMENT_BYTES = 64 << 20  # of records before compression, in one archive file
CHUNK = 1 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"


def _name(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _page(name: str | None) -> int | None:
    digits = (name or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(digits) if digits else None


def _clean(url: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "about:blank")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One uncompressed record; a revisit carries no payload."""
    http = (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean(url)}",
        "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + END + block + END


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def inflate(stream) -> Iterator[bytes]:
    """The inflated bytes of a gzip stream of one or more members, piece by piece."""
    member, begun = zlib.decompressobj(31), False
    data = stream.read(CHUNK)
    while data:
        out, begun = member.decompress(data, CHUNK), True
        if out:
            yield out
        data = member.unconsumed_tail
        if member.eof:
            data = member.unused_data or stream.read(CHUNK)
            member, begun = zlib.decompressobj(31), False
        elif not data:
            data = stream.read(CHUNK)
    if begun:
        yield member.flush()
        if not member.eof:
            raise ValueError("gzip stream ends within a member")


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and whole bytes of each record in inflated pieces; holds one record at a time."""
    held = bytearray()
    for piece in pieces:
        held += piece
        at = 0
        while (end := held.find(END, at)) >= 0:
            fields = _fields(bytes(held[at:end]))
            stop = end + len(END) + int(fields["content-length"]) + len(END)
            if stop > len(held):
                break
            yield fields, bytes(held[at:stop])
            at = stop
        del held[:at]
    if held:
        raise ValueError("archive ends within a record")


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out = packer = None
        size, paths = 0, []
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "html", "digest", "original", "revisit"))):
                page_id, url, html, digest, original, revisit = (x.as_py() for x in row)
                if out is None:
                    paths.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, packer, size = store.open_output_stream(f"{base}/{paths[-1]}", compression=None), zlib.compressobj(1, wbits=31), 0
                data = record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), digest, original, revisit)
                out.write(packer.compress(data))
                size += len(data)
                if size >= SEGMENT_BYTES:
                    out.write(packer.flush())
                    out.close()
                    out = None
        if out is not None:
            out.write(packer.flush())
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["archive"])

    return run


def _normalise(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            done = []
            for archive in batch.column("archive").to_pylist():
                name = f"{archive.removesuffix('.warc.gz')}-{uuid.uuid4().hex}"
                offset = 0
                with (
                    store.open_input_stream(f"{base}/{archive}", compression=None) as stream,
                    store.open_output_stream(f"{base}/{name}.warc.gz", compression=None) as out,
                    store.open_output_stream(f"{base}/{name}.index", compression=None) as index,
                ):
                    for fields, data in records(inflate(stream)):
                        packer = zlib.compressobj(6, wbits=31)
                        member = packer.compress(data) + packer.flush()
                        out.write(member)
                        entry = [offset, len(member), fields["warc-record-id"], fields["warc-type"]]
                        index.write((json.dumps(entry) + "\n").encode())
                        offset += len(member)
                done.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["archive"])

    return run


def read_member(data: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload bytes, payload digest, type and refers_to of one gzip member.

    The digest of a response is taken from its payload and held against its header.
    """
    whole = zlib.decompress(data, 31)
    head, _, rest = whole.partition(END)
    fields = _fields(head)
    http, _, payload = rest[: int(fields["content-length"])].partition(END)
    named = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    if fields["warc-type"] == "response" and hashlib.sha1(payload).hexdigest() != named:
        raise ValueError(f"payload of {fields['warc-record-id']} differs from its digest")
    return (
        _page(fields["warc-record-id"]),
        int(_fields(http)["content-length"]),
        named,
        fields["warc-type"],
        _page(fields.get("warc-refers-to")),
    )


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                with store.open_input_stream(f"{base}/{archive}.index", compression=None) as index:
                    entries = [json.loads(line) for line in index.read().splitlines()]
                with store.open_input_file(f"{base}/{archive}.warc.gz") as members:
                    rows = [read_member(members.read_at(length, offset)) for offset, length, *_ in entries]
                columns = list(zip(*rows)) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)],
                    ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
                )

    return run


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, original and whether the record is a revisit.

    Of pages with equal payloads of MIN_REVISIT_BYTES or more, the one with the largest
    page_id is stored. A null html is an empty payload. Rows repeating that page_id are
    stored again; a null page_id never leads a group unless all of its ids are null.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    keyed = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
        F.sha1(html.cast("binary")).alias("digest"),
        F.octet_length(html).alias("bytes"),
    )
    originals = (
        keyed.where(F.col("bytes") >= MIN_REVISIT_BYTES)
        .groupBy("digest", "bytes")
        .agg(F.max("page_id").alias("original"), F.count("*").alias("n"))
        .where("n > 1 AND original IS NOT NULL")
        .drop("n")
    )
    return keyed.join(originals, ["digest", "bytes"], "left").select(
        "page_id",
        "url",
        "html",
        "digest",
        "original",
        (F.col("original").isNotNull() & ~F.col("original").eqNullSafe(F.col("page_id"))).alias("revisit"),
    )


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write one-member gzip archives under ``folder``; returns the names ``archive``."""
    return materialise(plan_records(pages).mapInArrow(_write(folder), "archive string"), "archives")


def _spread(archives: DataFrame) -> DataFrame:
    # A handful of short names: one partition per file, whatever the file of names held.
    return archives.repartition(max(1, archives.count()))


def normalise_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive with a member per record and an index; returns new names."""
    return materialise(_spread(archives).mapInArrow(_normalise(folder), "archive string"), "members")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """A row per record of normalised archives, found through their indexes."""
    return _spread(archives).mapInArrow(
        _read(folder),
        "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long",
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages(page_id, url, html)`` to archives, normalise them, and read them back.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to. Other columns
    are ignored, repeated rows make repeated records, an empty table makes none.
    """
    folder = fresh_path(pages.sparkSession, "warc")
    return read_archives(normalise_archives(write_archives(pages, folder), folder), folder)
