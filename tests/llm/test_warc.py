import gzip
import hashlib
import io
import json
import zlib

import pytest
from pyarrow import fs

from usagepulse.llm import warc
from usagepulse.llm.common import fresh_path

SCHEMA = "page_id long, url string, html string, digest string, original long, revisit boolean, bytes int"
BIG = "<p>é</p>" * 200


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1, True, 2) for i, u, h in rows], SCHEMA)


ROWS = [
    (1, "http://a/", BIG),
    (5, "http://b/ x\r\ny", BIG),
    (3, None, BIG),
    (None, "http://n/", BIG),
    (2, "http://c/", "short"),
    (4, "http://d/", "short"),
    (6, "http://e/", None),
    (7, "http://f/", ""),
    (8, "http://g/", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 100),
    (9, "http://h/", "x" * 3_000_000),
    (9, "http://h/", "x" * 3_000_000),
    (10, "http://h/2", "x" * 999),
    (11, "http://h/3", "x" * 999),
]


def expected(rows):
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        same = [i for i, _, h in rows if (h or "").encode() == data and i is not None]
        lead = max(same) if same and len(data) >= 1000 else page_id
        revisit = lead != page_id
        out.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", lead if revisit else None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    got = sorted(map(tuple, warc.round_trip(pages(spark, ROWS)).collect()), key=repr)
    assert got == expected(ROWS)


def test_no_rows(spark):
    assert warc.round_trip(pages(spark, [])).count() == 0


@pytest.mark.parametrize("segment", [64 << 20, 2000])
def test_archives_members_and_index(spark, monkeypatch, segment):
    """Monolithic archives hold one member; normalised ones one for each record, found by
    offset, with the payloads unchanged."""
    monkeypatch.setattr(warc, "SEGMENT_BYTES", segment)
    folder = fresh_path(spark, "warc")
    raw = warc.write_archives(pages(spark, ROWS).coalesce(1), folder)
    store, base = fs.FileSystem.from_uri(folder)

    def read(name):
        with store.open_input_stream(f"{base}/{name}", compression=None) as f:
            return f.read()

    for r in raw.collect():
        member = zlib.decompressobj(31)
        member.decompress(read(r.archive))
        assert member.eof and not member.unused_data
    payloads = []
    for r in warc.normalise_archives(raw, folder).collect():
        data, at = read(f"{r.archive}.warc.gz"), 0
        for line in read(f"{r.archive}.index").splitlines():
            offset, length, name, kind = json.loads(line)
            assert offset == at
            at += length
            whole = zlib.decompress(data[offset : offset + length], 31)
            assert whole.startswith(b"WARC/1.1\r\n") and f"WARC-Record-ID: {name}".encode() in whole
            if kind == "response":
                payloads.append(whole.split(warc.END, 2)[2][: -len(warc.END)].decode())
        assert at == len(data)
    kept = [h or "" for i, _, h in ROWS if not (h == BIG and i != 5)]
    assert sorted(payloads) == sorted(kept)


def test_inflate_reads_many_members_and_refuses_a_cut_stream():
    parts = [b"a" * 3_000_000, b"", b"b" * 10]
    data = b"".join(gzip.compress(p) for p in parts)
    assert b"".join(warc.inflate(io.BytesIO(data))) == b"".join(parts)
    with pytest.raises(ValueError):
        list(warc.inflate(io.BytesIO(data[:-5])))
    with pytest.raises(ValueError):
        list(warc.records(iter([warc.record(1, "u", b"p", "00" * 20, None, False)[:-1]])))
