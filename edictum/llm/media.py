"""Media columns: what bytes are, whatever they are declared to be.

One Aho-Corasick automaton finds the magic bytes of all formats, and the end marks of those that
are read from their end, in one pass over the bytes (as Latin-1, a character a byte). Each hit
goes to a validator of its format, which walks the structure, or looks up the marks by binary
search, and gives the exact length of the media or rejects the hit. A valid hit at the first byte
corrects the declared type; valid hits further in are media to carve out, also those that stand
inside a container (a document, an archive, a film).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edictum.shipping import ship_package


@dataclass(frozen=True)
class Found:
    """Media of ``kind`` in the bytes from ``start`` on, ``length`` long; ``inside`` is the start of the container, if it is in one."""

    kind: str
    start: int
    length: int
    inside: int | None = None

    def __str__(self) -> str:
        return f"{self.kind}@{self.start}+{self.length}" + ("" if self.inside is None else f" in {self.inside}")


class Scan:
    """Bytes, and where the automaton found each mark in them."""

    def __init__(self, data: bytes):
        self.data = data
        self.hits: list[tuple[int, str, Callable]] = []
        self.marks: dict[bytes, list[int]] = {}
        for end, of in _automaton().iter(data.decode("latin-1")) if data else ():
            for back, kind, check in of:
                if check is None:
                    self.marks.setdefault(kind, []).append(end + 1 - back)
                else:
                    self.hits.append((end + 1 - back, kind, check))
        self.hits.sort(key=lambda h: h[:2])
        self._archives: dict[int, int] | None = None
        self._zero = (0, -2)
        self._chains: dict[str, array] = {}
        self._chunks: dict[int, tuple[int, int, int, int, int]] = {}
        self._upto: list[int] | None = None

    def end_of(self, name: str, at: int, step: Callable[[bytes, int], tuple[int | None, bool]]) -> int | None:
        """Where a chain of blocks ends that begins at ``at``; None if it breaks.

        ``step`` gives the place after the block at a place and whether the chain ends there. All blocks of a chain share
        its end, so it is kept for each, and no block is walked twice, however many hits lead to it.
        """
        ends = self._chains.get(name)
        if ends is None:
            ends = self._chains[name] = array("q", bytes(8 * (len(self.data) + 1)))
        path, i, end, last = [], at, -1, False
        while i < len(self.data):
            if ends[i]:
                end = ends[i]
                break
            path.append(i)
            to, last = step(self.data, i)
            if to is None or to > len(self.data):
                break
            i = to
            if last:
                end = i
                break
        for i in path:
            ends[i] = end
        return end if end > 0 else None

    def chunk(self, at: int) -> tuple[int, int, int, int, int]:
        """Of the RIFF chunk at ``at``: the place after it, its rank from the end, a place further on, and how many fmt and data chunks follow, itself included.

        Places further on make it quick to find where a chain passes a bound.
        """
        b, path, i = self.data, [], at
        while i + 8 <= len(b) and i not in self._chunks:
            path.append(i)
            i += 8 + (n := struct.unpack_from("<I", b, i + 4)[0]) + (n & 1)
        if i + 8 > len(b):
            self._chunks[i] = (i, 0, i, 0, 0)
        for i in reversed(path):
            n = struct.unpack_from("<I", b, i + 4)[0]
            to = i + 8 + n + (n & 1)
            _, rank, far, formats, samples = self._chunks[to]
            _, middle, farther, *_ = self._chunks[far]
            skip = farther if rank - middle == middle - self._chunks[farther][1] else to
            kind = b[i : i + 4]
            self._chunks[i] = (to, rank + 1, skip, formats + (kind == b"fmt "), samples + (kind == b"data"))
        return self._chunks[at]

    def crc(self, a: int, z: int) -> int:
        """The crc32 of the bytes from ``a`` to ``z``; of many, from the sums up to every 4,096th byte."""
        if z - a <= 2 * _STEP:
            return zlib.crc32(self.data[a:z])
        if self._upto is None:
            self._upto = [0]
            for i in range(0, len(self.data), _STEP):
                self._upto.append(zlib.crc32(self.data[i : i + _STEP], self._upto[-1]))
        before, after = (zlib.crc32(self.data[i // _STEP * _STEP : i], self._upto[i // _STEP]) for i in (a, z))
        return after ^ _shifted(before, z - a)

    def zero(self, at: int) -> int:
        """The first zero byte from ``at`` on, or -1; what the last search saw isn't searched again."""
        seen, found = self._zero
        if not (seen <= at and (found == -1 or at <= found)):
            self._zero = at, self.data.find(b"\0", at)
        return self._zero[1]

    def after(self, mark: bytes, at: int) -> int | None:
        """The first such mark from ``at`` on."""
        own = self.marks.get(mark, [])
        i = bisect_left(own, at)
        return own[i] if i < len(own) else None

    def before(self, mark: bytes, at: int) -> int | None:
        """The last such mark that begins before ``at``."""
        own = self.marks.get(mark, [])
        i = bisect_left(own, at)
        return own[i - 1] if i else None

    @property
    def archives(self) -> dict[int, int]:
        """For the first byte of each ZIP archive the byte after it: an end record tells where its archive begins."""
        if self._archives is None:
            self._archives, b = {}, self.data
            for i in self.marks.get(ZIP_END, []):
                if i + 22 <= len(b):
                    size, start, note = struct.unpack_from("<IIH", b, i + 12)
                    at = i - size - start
                    if at >= 0 and (not size or b[at + start : at + start + 4] == b"PK\x01\x02") and i + 22 + note <= len(b):
                        self._archives.setdefault(at, i + 22 + note)
        return self._archives


#: Sums of all bytes so far are kept for every so many bytes.
_STEP = 4096
#: Fixed values of the formats: what the end of a PDF file has, and the end record of a ZIP archive.
PDF_START, PDF_END, PDF_TABLE, ZIP_END = b"%PDF-", b"%%EOF", b"startxref", b"PK\x05\x06"


def _product(a: int, b: int) -> int:
    """Of two polynomials over one bit, as crc32 has them (highest power first, in the lowest bit), modulo its own."""
    out = 0
    while a:
        if a & 0x80000000:
            out ^= b
        a = a << 1 & 0xFFFFFFFF
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


@lru_cache(maxsize=1)
def _powers() -> list[int]:
    """x to 8, 16, 32, ...: what a crc32 is multiplied by as a byte, two bytes, four bytes, ... follow."""
    out = [0x00800000]
    while len(out) < 40:
        out.append(_product(out[-1], out[-1]))
    return out


def _shifted(crc: int, n: int) -> int:
    """What a crc32 adds to that of its bytes and ``n`` more."""
    for k, power in enumerate(_powers()):
        if n >> k & 1:
            crc = _product(crc, power)
    return crc


def _png(scan: Scan, at: int) -> int | None:
    b = scan.data
    if b[at + 8 : at + 16] != b"\0\0\0\rIHDR":
        return None

    def step(b: bytes, i: int) -> tuple[int | None, bool]:
        if i + 12 > len(b):
            return None, False
        n, kind = struct.unpack_from(">I4s", b, i)
        whole = i + 12 + n <= len(b) and scan.crc(i + 4, i + 8 + n) == struct.unpack_from(">I", b, i + 8 + n)[0]
        return (i + 12 + n if whole else None), kind == b"IEND"

    end = scan.end_of("png", at + 8, step)
    return end - at if end else None


def _gif(scan: Scan, at: int) -> int | None:
    b = scan.data
    if at + 13 > len(b):
        return None

    def data(b: bytes, i: int) -> tuple[int | None, bool]:
        return i + 1 + b[i], not b[i]

    def step(b: bytes, i: int) -> tuple[int | None, bool]:
        if b[i] == 0x3B:
            return i + 1, True
        if b[i] == 0x21:
            return scan.end_of("gif data", i + 2, data), False
        if b[i] == 0x2C and i + 10 < len(b):
            return scan.end_of("gif data", i + 11 + (3 << (b[i + 9] & 7) + 1 if b[i + 9] & 0x80 else 0), data), False
        return None, False

    end = scan.end_of("gif", at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 0x80 else 0), step)
    return end - at if end else None


def _jpeg(scan: Scan, at: int) -> int | None:
    def step(b: bytes, i: int) -> tuple[int | None, bool]:
        if b[i : i + 2] == b"\xff\xd9":
            return i + 2, True
        if i + 4 > len(b) or b[i] != 0xFF:
            return None, False
        kind, n = b[i + 1], struct.unpack_from(">H", b, i + 2)[0]
        if kind < 0xC0 or 0xD0 <= kind <= 0xD8 or n < 2:
            return None, False
        i += 2 + n
        if kind == 0xDA:  # entropy-coded data: up to a marker that is neither stuffing nor a restart
            while (i := b.find(b"\xff", i)) >= 0 and i + 1 < len(b) and (b[i + 1] == 0 or 0xD0 <= b[i + 1] <= 0xD7):
                i += 2
        return (i if i >= 0 else None), False

    end = scan.end_of("jpeg", at + 2, step)
    return end - at if end else None


def _riff(form: bytes) -> Callable[[Scan, int], int | None]:
    def of(scan: Scan, at: int) -> int | None:
        b = scan.data
        if at + 12 > len(b) or b[at + 8 : at + 12] != form:
            return None
        end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
        if end > len(b):
            return None
        first, i = scan.chunk(at + 12), at + 12
        while i + 8 <= end:  # the first chunk that doesn't fit
            to, _, far, *_ = scan.chunk(i)
            i = far if far + 8 <= end else to
        *_, formats, samples = scan.chunk(i)
        if i not in (end, end + 1) or (form == b"WAVE" and (first[3] == formats or first[4] == samples)):
            return None
        return end - at

    return of


def _bmp(scan: Scan, at: int) -> int | None:
    b = scan.data
    if at + 30 > len(b):
        return None
    size, _, pixels, header, _, _, planes = struct.unpack_from("<IIIIiiH", b, at + 2)
    return size if planes == 1 and header in (12, 40, 52, 56, 108, 124) and 14 + header <= pixels <= size and at + size <= len(b) else None


def _pdf(scan: Scan, at: int) -> int | None:
    """Up to the last end mark before the next document: files that were saved several times have several."""
    b = scan.data
    if not (b[at + 5 : at + 6].isdigit() and b[at + 6 : at + 7] == b"."):
        return None
    end = scan.before(PDF_END, scan.after(PDF_START, at + 1) or len(b))
    table = scan.after(PDF_TABLE, at)
    return end + 5 - at if end is not None and table is not None and at < table < end else None


def _zip(scan: Scan, at: int) -> int | None:
    end = scan.archives.get(at)
    return end - at if end else None


def _gzip(scan: Scan, at: int) -> int | None:
    b, i = scan.data, at + 10
    if i > len(b) or b[at + 3] & 0xE0:
        return None
    flags = b[at + 3]
    if flags & 4:  # a field of its own length
        i += 2 + int.from_bytes(b[i : i + 2], "little")
    for flag in (8, 16):  # a name and a comment, each up to a zero
        if flags & flag:
            if (i := scan.zero(i) + 1) <= 0:
                return None
    i += 2 if flags & 2 else 0
    d = zlib.decompressobj(-15)
    try:
        while i < len(b) and not d.eof:
            d.decompress(b[i : i + 4096], 1 << 20)
            while d.unconsumed_tail and not d.eof:
                d.decompress(d.unconsumed_tail, 1 << 20)
            i += 4096
    except zlib.error:
        return None
    end = min(i, len(b)) - len(d.unused_data) + 8  # a checksum and the length follow
    return end - at if d.eof and end <= len(b) else None


def _ogg(scan: Scan, at: int) -> int | None:
    def step(b: bytes, i: int) -> tuple[int | None, bool]:
        if i + 27 > len(b) or b[i : i + 5] != b"OggS\x00":
            return None, False
        segments = b[i + 26]
        return i + 27 + segments + sum(b[i + 27 : i + 27 + segments]), bool(b[i + 5] & 4)

    end = scan.end_of("ogg", at, step)
    return end - at if end else None


def _flac(scan: Scan, at: int) -> int | None:
    def step(b: bytes, i: int) -> tuple[int | None, bool]:
        return (i + 4 + int.from_bytes(b[i + 1 : i + 4], "big") if i + 4 <= len(b) else None), bool(b[i] & 0x80)

    b = scan.data
    if b[at + 4 : at + 5] not in (b"\x00", b"\x80") or b[at + 5 : at + 8] != b"\x00\x00\x22":
        return None
    end = scan.end_of("flac", at + 4, step)
    return len(b) - at if end and b[end : end + 1] in (b"\xff", b"") else None  # frames have no length: they go to the end


#: Fixed values of the formats: magic bytes, how far into the media they are, type, validator.
SIGNATURES: tuple[tuple[bytes, int, str, Callable[[Scan, int], int | None]], ...] = (
    (b"\x89PNG\r\n\x1a\n", 0, "image/png", _png),
    (b"GIF87a", 0, "image/gif", _gif),
    (b"GIF89a", 0, "image/gif", _gif),
    (b"\xff\xd8\xff", 0, "image/jpeg", _jpeg),
    (b"RIFF", 0, "audio/wav", _riff(b"WAVE")),
    (b"RIFF", 0, "image/webp", _riff(b"WEBP")),
    (b"RIFF", 0, "video/avi", _riff(b"AVI ")),
    (b"BM", 0, "image/bmp", _bmp),
    (b"%PDF-", 0, "application/pdf", _pdf),
    (b"PK\x03\x04", 0, "application/zip", _zip),
    (b"\x1f\x8b\x08", 0, "application/gzip", _gzip),
    (b"OggS", 0, "application/ogg", _ogg),
    (b"fLaC", 0, "audio/flac", _flac),
)


#: Types that can hold other media.
CONTAINERS = frozenset(("application/pdf", "application/zip", "video/avi"))


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    found: dict[bytes, list] = {}
    for magic, into, kind, check in SIGNATURES:
        found.setdefault(magic, []).append((into + len(magic), kind, check))
    for mark in (PDF_START, PDF_END, PDF_TABLE, ZIP_END):
        found.setdefault(mark, []).append((len(mark), mark, None))
    out = ahocorasick.Automaton()
    for magic, of in found.items():
        out.add_word(magic.decode("latin-1"), of)
    out.make_automaton()
    return out


def sniff(data: bytes) -> list[Found]:
    """All media in the bytes, in order of their start; of media inside other media, those in containers."""
    scan = Scan(data)
    out: list[Found] = []
    around: list[Found] = []  # media that the next hit may lie in
    for start, kind, check in scan.hits:
        while around and start >= around[-1].start + around[-1].length:
            around.pop()
        if around and (around[-1].kind not in CONTAINERS or start == around[-1].start):
            continue
        n = check(scan, start)
        if n and (not around or start + n <= around[-1].start + around[-1].length):
            out.append(Found(kind, start, n, around[-1].start if around else None))
            around.append(out[-1])
    return out


def true_type(data: bytes | None, declared: str | None) -> str | None:
    """The type of media that fill the bytes from the first on; else what is declared."""
    first = next(iter(sniff(data or b"")), None)
    return first.kind if first and first.start == 0 else declared


RATE = 8000
#: Bytes of media that a task holds before it sends them on (or one text, if it is longer).
HELD = 1 << 22


def to_wav(payload: bytes) -> bytes:
    """8-bit mono PCM of which each sample is a byte of the payload."""
    pad = b"\x00" * (len(payload) & 1)
    return b"RIFF" + struct.pack("<I", 36 + len(payload) + len(pad)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload + pad


def from_wav(data: bytes) -> bytes:
    """The samples of an 8-bit mono PCM file, as bytes."""
    i = 12
    while i + 8 <= len(data):
        kind, n = struct.unpack_from("<4sI", data, i)
        if kind == b"fmt " and struct.unpack_from("<HH", data, i + 8) + struct.unpack_from("<H", data, i + 22) != (1, 1, 8):
            raise ValueError("not 8-bit mono PCM")
        if kind == b"data":
            return data[i + 8 : i + 8 + n]
        i += 8 + n + (n & 1)
    raise ValueError("no samples")


def padded(text: bytes, unit: int = 64) -> bytes:
    """The bytes with zeros up to a positive multiple of ``unit``."""
    return text + b"\x00" * (-len(text) % unit if text else unit)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes``, ``media`` (a WAV file), ``declared`` (its type, unknown as yet) for every row.

    Null texts count as empty and have one unit of zeros. Rows are kept as they are, repeated ones
    and those with a null doc_id too; other columns are left out. An empty table gives no rows.
    """

    kinds = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("declared", pa.string())])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
                text = text.as_py() or b""
                rows.append((doc_id, len(text), to_wav(padded(text)), "application/octet-stream"))
                held += len(text)
                if held > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.types)], schema=kinds)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.types)], schema=kinds)

    ship_package(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(store, "doc_id bigint, n_bytes bigint, media binary, declared string")


def inspect_media(media: DataFrame) -> DataFrame:
    """Sniff a media column: for every row the corrected type, lengths and digests of the file and of its samples, and what is embedded.

    Media that are null or of no known type keep the declared type and have null payload columns.
    ``embedded`` lists type, start and length of media found further in, also inside the samples, and of what containers hold.
    A text full of start and end marks takes time in proportion to its length, times its logarithm for chunks and
    checksums; only gzip streams are inflated for each hit, up to where they break.
    """
    kinds = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("declared", pa.string()), ("media_type", pa.string()), ("embedded", pa.list_(pa.string()))])

    def one(doc_id: int | None, n_bytes: int | None, data: bytes | None, declared: str | None) -> tuple:
        found = sniff(data or b"")
        first = found[0] if found and found[0].start == 0 else None
        kind = first.kind if first else declared
        size, sha = (len(data), hashlib.sha256(data).hexdigest()) if data is not None else (None, None)
        if kind != "audio/wav" or not first:
            return doc_id, n_bytes, None, None, None, size, sha, None, declared, kind, [str(f) for f in found if f is not first]
        samples = from_wav(data[: first.length])
        inside = [*map(str, sniff(samples)), *map(str, found[1:])]
        feature = f"{kind};pcm8;mono;{RATE}Hz;{len(samples)} samples;mean {np.frombuffer(samples, np.uint8).mean():.4f};max {np.frombuffer(samples, np.uint8).max()};embedded {len(inside)}" if samples else f"{kind};pcm8;mono;{RATE}Hz;0 samples"
        return doc_id, n_bytes, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), size, sha, feature, declared, kind, inside

    def inspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(*(c[i].as_py() for c in batch.columns)) for i in range(batch.num_rows)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.types)], schema=kinds)

    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, declared string, media_type string, embedded array<string>"
    ship_package(media.sparkSession)
    return media.select("doc_id", "n_bytes", "media", "declared").mapInArrow(inspect, schema)
