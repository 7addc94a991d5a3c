import gzip
import hashlib
import io
import random
import struct
import time
import zipfile
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from edictum.llm import media


def png(w=2, h=2):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" * (w + 1) * h)) + chunk(b"IEND", b"")


def packed():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "PK\x03\x04 inside" * 5)
    return out.getvalue()


def bmp():
    size = 14 + 40 + 8
    return b"BM" + struct.pack("<IIIIiiH", size, 0, 54, 40, 2, 1, 1) + b"\0" * (size - 28)


GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0" * 6 + b"\x2c" + b"\0" * 8 + b"\0" + b"\x02\x02\x4c\x01\x00" + b"\x3b"
JPEG = b"\xff\xd8\xff\xe0\x00\x10JFIF\0\x01\x01\0\0\x01\0\x01\0\0" + b"\xff\xda\x00\x08\x01\x01\0\0\x3f\0" + b"abc\xff\x00\xff\xd0d" + b"\xff\xd9"
PDF = b"%PDF-1.4\n1 0 obj\n<<>>\nendobj\nstartxref\n9\n%%EOF"
OGG = b"OggS\x00\x02" + b"\0" * 20 + b"\x01\x05hello" + b"OggS\x00\x04" + b"\0" * 20 + b"\x01\x03end"
FILES = {"image/png": png(), "application/zip": packed(), "application/gzip": gzip.compress(b"data" * 100), "image/bmp": bmp(), "image/gif": GIF, "image/jpeg": JPEG, "application/pdf": PDF, "application/ogg": OGG, "audio/wav": media.to_wav(b"12345678")}


@pytest.mark.parametrize("kind", FILES)
def test_each_format_alone_embedded_and_broken(kind):
    data = FILES[kind]
    assert media.sniff(data) == [media.Found(kind, 0, len(data))]
    assert media.true_type(data, "text/plain") == kind
    assert media.Found(kind, 7, len(data)) in media.sniff(b"before " + data + b" after it")
    assert not any(f.kind == kind and f.length == len(data) for f in media.sniff(data[: len(data) // 2]))


def test_embedded_media_are_carved_in_order():
    blob = b"--".join(FILES.values())
    found = media.sniff(blob)
    assert [f.kind for f in found] == list(FILES) and [blob[f.start : f.start + f.length] for f in found] == list(FILES.values())


def test_saved_again_and_inside_containers():
    """A PDF ends at its last end mark before the next one; what containers hold is listed with them."""
    again = PDF + b"\n2 0 obj\n<<>>\nendobj\nstartxref\n60\n%%EOF"
    assert media.sniff(b"x" + again + b"\n" + PDF) == [media.Found("application/pdf", 1, len(again)), media.Found("application/pdf", len(again) + 2, len(PDF))]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("p.png", FILES["image/png"])
        z.writestr("g.gif", GIF)
    data = b"##" + out.getvalue()
    found = media.sniff(data)
    assert [(f.kind, f.inside) for f in found] == [("application/zip", None), ("image/png", 2), ("image/gif", 2)]
    assert all(data[f.start : f.start + f.length] == FILES[f.kind] for f in found[1:])
    inner = b"%PDF-1.4\n" + JPEG + b"\nstartxref\n9\n%%EOF"
    assert [str(f) for f in media.sniff(inner)] == [f"application/pdf@0+{len(inner)}", f"image/jpeg@9+{len(JPEG)} in 0"]


@pytest.mark.parametrize("mark", [b"PK\x03\x04", b"%PDF-1.", b"PK\x05\x06", b"%PDF-1.4 startxref ", b"%%EOF", b"\x1f\x8b\x08", b"RIFF", b"GIF89a", b"BM"])
def test_texts_full_of_marks(mark):
    """5 MB of markers take seconds."""
    start = time.perf_counter()
    media.sniff(mark * (5_000_000 // len(mark)))
    assert time.perf_counter() - start < 20


OGG = b"OggS\0\0" + bytes(20) + b"\1\0"
HOSTILE = {
    "ogg pages without an end": OGG * 180_000,
    "gif heads and blocks": (b"GIF89a" + bytes(7) + b"!\xf9\x01") * 300_000,
    "gif data of one byte": b"GIF89a" * 400_000 + bytes(7) + b"!\xf9" + b"\x01" * 2_500_000,
    "jpeg heads and segments": (b"\xff\xd8\xff\xe0\x00\x02" + b"\xff\xe1\x00\x02") * 500_000,
    "flac blocks": b"fLaC\x00\x00\x00\x22" * 300_000 + b"\x01\x00\x00\x00" * 600_000,
    "png chunks to the end": b"".join(b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + bytes(13) + struct.pack(">I", zlib.crc32(b"IHDR" + bytes(13))) + struct.pack(">I4s", 41 * (50_000 - i - 1), b"tEXt") for i in range(50_000)) + b"abcd",
    "riff heads before small chunks": b"".join(b"RIFF" + struct.pack("<I", 12 * (150_000 - i) - 8 + 8 * (i % 1000)) + b"WAVE" for i in range(150_000)) + b"abcd\0\0\0\0" * 300_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_chains_that_many_hits_share(name):
    """No chain of blocks is walked for each hit on it."""
    start = time.perf_counter()
    media.sniff(HOSTILE[name])
    assert time.perf_counter() - start < 20


@given(st.integers(0, 9), st.integers(0, 30_000), st.integers(0, 30_000))
@settings(max_examples=100, deadline=None)
def test_checksums_of_parts(seed, a, z):
    data = random.Random(seed).randbytes(30_000)
    a, z = min(a, z), max(a, z)
    assert media.Scan(data).crc(a, z) == zlib.crc32(data[a:z])


def _plain_riff(b, at, form):
    if at + 12 > len(b) or b[at + 8 : at + 12] != form:
        return None
    end, i, seen = at + 8 + struct.unpack_from("<I", b, at + 4)[0], at + 12, set()
    if end > len(b):
        return None
    while i + 8 <= end:
        kind, n = struct.unpack_from("<4sI", b, i)
        seen.add(kind)
        i += 8 + n + (n & 1)
    return None if i not in (end, end + 1) or (form == b"WAVE" and not {b"fmt ", b"data"} <= seen) else end - at


@given(st.lists(st.sampled_from([b"RIFF", b"WAVE", b"AVI ", b"fmt ", b"data", b"abcd", bytes(4), b"\4\0\0\0", b"\x10\0\0\0", b"\x18\0\0\0", b"\x24\0\0\0", b"\x44\0\0\0"]), max_size=60).map(b"".join))
@settings(max_examples=500, deadline=None)
def test_riff_chunks_against_a_plain_walk(data):
    scan = media.Scan(data)
    for at in range(len(data)):
        if data[at : at + 4] == b"RIFF":
            for form in (b"WAVE", b"AVI "):
                assert media._riff(form)(scan, at) == _plain_riff(data, at, form)


def test_the_query_on_a_table(spark):
    from edictum.llm.queries import op7_media

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = op7_media(spark, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"] for r in got} == set(texts) and len(got) == len(texts)
    for r in got:
        data = (texts[r["doc_id"]] or "").encode()
        payload = data + b"\0" * (-len(data) % 64 if data else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["media_bytes"] == len(payload) + 44 and r["media_sha256"] == hashlib.sha256(media.to_wav(payload)).hexdigest()


@given(st.binary(max_size=300))
@settings(max_examples=200, deadline=None)
def test_any_bytes_round_trip(data):
    payload = media.padded(data)
    assert len(payload) % 64 == 0 and payload and payload.startswith(data)
    stored = media.to_wav(payload)
    assert media.from_wav(stored) == payload and media.sniff(stored)[0] == media.Found("audio/wav", 0, len(stored))


def test_texts_as_media(spark):
    texts = ["abc", "", None, "x" * 64, "ü" * 100_000, "abc", "GIF89a is no picture", "RIFFxxxxWAVE"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "abc")], "doc_id long, text string").selectExpr("*", "1 as media", "2 as n_bytes")
    out = media.inspect_media(media.store_texts(docs)).collect()
    assert len(out) == len(texts) + 1
    for r in out:
        t = (texts[r["doc_id"]] if r["doc_id"] is not None else "abc") or ""
        payload = media.padded(t.encode())
        stored = media.to_wav(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(t.encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"], r["declared"], r["media_type"]) == (len(stored), hashlib.sha256(stored).hexdigest(), "application/octet-stream", "audio/wav")
    assert len({r["feature"] for r in out if r["doc_id"] in (0, 5, None)}) == 1


def test_other_media_and_nulls(spark):
    rows = [(1, 0, FILES["image/png"], "image/jpeg"), (2, 0, None, "a/b"), (3, None, b"plain", "text/plain"), (4, 0, b"", None), (5, 0, b"##" + FILES["image/png"], "text/plain")]
    out = {r["doc_id"]: r for r in media.inspect_media(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary, declared string")).collect()}
    assert [out[i]["media_type"] for i in range(1, 6)] == ["image/png", "a/b", "text/plain", None, "text/plain"]
    assert out[5]["embedded"] == [f"image/png@2+{len(FILES['image/png'])}"] and out[2]["media_bytes"] is None and all(r["payload_bytes"] is None for r in out.values())
    assert media.inspect_media(spark.createDataFrame([], "doc_id long, n_bytes long, media binary, declared string")).count() == 0


def test_media_inside_a_text_payload(spark):
    wav = media.to_wav(media.padded(b"text " + FILES["image/gif"]))
    r = media.inspect_media(spark.createDataFrame([(1, 0, wav, "x/y")], "doc_id long, n_bytes long, media binary, declared string")).first()
    assert r["embedded"] == [f"image/gif@5+{len(GIF)}"]
