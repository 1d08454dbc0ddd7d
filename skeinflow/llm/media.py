"""Media columns: signature sniffing with an Aho-Corasick automaton.

One automaton finds every magic number in a column's bytes in one pass. A hit is only a candidate:
the format's validator must confirm the structure behind it (chunk sizes, checksums, end markers)
and gives the media's exact length. The first confirmed format at offset zero corrects the declared
type; confirmed media further in, not inside one already taken, are carved out.

Formats: WAV, PNG, GIF, JPEG, PDF, ZIP, GZIP, BMP. `wrap_wav` stores bytes losslessly as 8-bit mono
samples and `samples` reads them back from the carved file.

`example` makes small whole files of each format, and `planted` puts them into texts by a rule.

Nulls count as empty; empty bytes have no type and keep the declared one. Damaged or cut media don't
confirm and are left alone. Equal bytes give equal results, repeated rows each their own. Content of any length is
searched whole, in one pass for the magic numbers and one for each end marker. An empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import io
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Magic numbers, the type they announce, and where in the file they stand.
MAGIC = (
    (b"RIFF", "audio/wav", 0),
    (b"\x89PNG\r\n\x1a\n", "image/png", 0),
    (b"GIF87a", "image/gif", 0),
    (b"GIF89a", "image/gif", 0),
    (b"\xff\xd8\xff", "image/jpeg", 0),
    (b"%PDF-", "application/pdf", 0),
    (b"PK\x03\x04", "application/zip", 0),
    (b"\x1f\x8b\x08", "application/gzip", 0),
    (b"BM", "image/bmp", 0),
)
UNIT = 192
RATE = 8000
#: Bytes that are decompressed at a time.
STEP = 1 << 16
#: Bytes between kept running checksums.
CRC_STEP = 256


class Content:
    """Bytes and, once asked for, the places of the markers that end a format, the ends of walks and running checksums: however many hits ask, the bytes are gone through once."""

    def __init__(self, raw: bytes) -> None:
        self.raw = raw
        self._places: dict[bytes, list[int]] = {}
        self._archives: dict[int, int] | None = None
        self._ends: dict[str, dict[int, int]] = {}
        self._crcs: list[int] | None = None

    def after(self, marker: bytes, at: int) -> int:
        """The first place of `marker` from `at` on, or -1."""
        if marker not in self._places:
            places, found = [], self.raw.find(marker)
            while found >= 0:
                places.append(found)
                found = self.raw.find(marker, found + 1)
            self._places[marker] = places
        places = self._places[marker]
        k = bisect.bisect_left(places, at)
        return places[k] if k < len(places) else -1

    def chain(self, name: str, place: int, step: Callable[[int], int]) -> int:
        """Where a walk from `place` ends, zero if it breaks off. `step` gives the next place, minus the end, or zero.

        A walk stops where an earlier one of its name has been, so all walks of a content take as many steps as it has places.
        """
        ends = self._ends.setdefault(name, {})
        been = []
        while place not in ends:
            been.append(place)
            after = step(place)
            if after <= 0:
                ends[place] = -after
                break
            place = after
        end = ends[place]
        for p in been:
            ends[p] = end
        return end

    def checksum(self, start: int, stop: int) -> int:
        """CRC-32 of a range. A long one is taken from two running ones, so that many overlapping ranges cost no second pass."""
        if stop - start < 4 * CRC_STEP:
            return zlib.crc32(memoryview(self.raw)[start:stop])
        if self._crcs is None:
            crc, self._crcs = 0, [0]
            for k in range(0, len(self.raw), CRC_STEP):
                crc = zlib.crc32(memoryview(self.raw)[k : k + CRC_STEP], crc)
                self._crcs.append(crc)
        before, both = (zlib.crc32(memoryview(self.raw)[p - p % CRC_STEP : p], self._crcs[p // CRC_STEP]) for p in (start, stop))
        return both ^ shifted(before, stop - start)

    def archives(self) -> dict[int, int]:
        """Where ZIP archives begin, by their end records, and where the first of each begin ends."""
        if self._archives is None:
            self._archives, b, end = {}, self.raw, self.after(b"PK\x05\x06", 0)
            while 0 <= end <= len(b) - 22:
                size, start, note = struct.unpack_from("<IIH", b, end + 12)
                begin = end - start - size
                if begin >= 0 and b[begin + start : begin + start + 4] == b"PK\x01\x02" and end + 22 + note <= len(b):
                    self._archives.setdefault(begin, end + 22 + note)
                end = self.after(b"PK\x05\x06", end + 1)
        return self._archives


def _times(a: int, b: int) -> int:
    """Product of two polynomials over two elements modulo that of CRC-32, lowest powers in the highest bits."""
    out = 0
    while a:
        if a & 0x80000000:
            out ^= b
        a = a << 1 & 0xFFFFFFFF
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


_SHIFTS = [0x00800000]  # x^8, and the squares of it
for _ in range(47):
    _SHIFTS.append(_times(_SHIFTS[-1], _SHIFTS[-1]))


def shifted(crc: int, n: int) -> int:
    """The part of the CRC of n more bytes that what stood before them makes."""
    k = 0
    while n:
        if n & 1:
            crc = _times(crc, _SHIFTS[k])
        n, k = n >> 1, k + 1
    return crc


# Each validator gives the length of the media that begins at `at`, zero if it isn't one, whole.


def _wav(c: Content, at: int) -> int:
    b, n = c.raw, len(c.raw)
    if at + 44 > n or b[at + 8 : at + 12] != b"WAVE":
        return 0
    end = at + struct.unpack_from("<I", b, at + 4)[0] + 8
    if end > n:
        return 0
    place, seen = at + 12, set()
    while place + 8 <= end:
        name, size = struct.unpack_from("<4sI", b, place)
        place += 8 + size + size % 2
        seen.add(name)
    return end - at if place == end and {b"fmt ", b"data"} <= seen else 0


def _png(c: Content, at: int) -> int:
    b, n = c.raw, len(c.raw)
    if b[at + 8 : at + 16] != b"\0\0\0\rIHDR":
        return 0

    def step(place: int) -> int:
        """The place of the next chunk; minus the end after the last, zero for none."""
        if place + 12 > n:
            return 0
        size, name = struct.unpack_from(">I4s", b, place)
        stop = place + 12 + size
        if stop > n or not name.isalpha() or c.checksum(place + 4, stop - 4) != struct.unpack_from(">I", b, stop - 4)[0]:
            return 0
        return -stop if name == b"IEND" else stop

    end = c.chain("png", at + 8, step)
    return end - at if end else 0


def _gif(c: Content, at: int) -> int:
    b, n = c.raw, len(c.raw)

    def block(place: int) -> int:
        if place >= n or not b[place]:
            return -(place + 1)
        return place + b[place] + 1

    def step(place: int) -> int:
        if place >= n:
            return 0
        if b[place] == 0x3B:
            return -(place + 1)
        if b[place] == 0x21:
            return c.chain("gif blocks", place + 2, block)
        if b[place] == 0x2C and place + 10 < n:
            return c.chain("gif blocks", place + 11 + (3 << (b[place + 9] % 8 + 1)) * (b[place + 9] >> 7), block)
        return 0

    if at + 14 > n:
        return 0
    end = c.chain("gif", at + 13 + (3 << (b[at + 10] % 8 + 1)) * (b[at + 10] >> 7), step)
    return end - at if end else 0


def _jpeg(c: Content, at: int) -> int:
    b = c.raw

    def step(place: int) -> int:
        if place + 4 > len(b) or b[place] != 0xFF:
            return 0
        if b[place + 1] == 0xDA:  # the scan: look for the end marker
            end = c.after(b"\xff\xd9", place)
            return -(end + 2) if end > 0 else 0
        return place + 2 + struct.unpack_from(">H", b, place + 2)[0]

    end = c.chain("jpeg", at + 2, step)
    return end - at if end else 0


def _pdf(c: Content, at: int) -> int:
    end, table = c.after(b"%%EOF", at), c.after(b"startxref", at)
    return end + 5 - at if 0 <= table < end else 0


def _zip(c: Content, at: int) -> int:
    end = c.archives().get(at)
    return end - at if end else 0


def _gzip(c: Content, at: int) -> int:
    b, n = c.raw, len(c.raw)
    if at + 18 > n or b[at + 3] & 0xE0:
        return 0
    flags, place = b[at + 3], at + 10
    if flags & 4:
        place += 2 + struct.unpack_from("<H", b, place)[0]
    for text in (8, 16):  # a name and a note, each up to a zero byte
        if flags & text:
            place = c.after(b"\0", place) + 1
            if not place:
                return 0
    place += 2 * (flags >> 1 & 1)
    d, crc, size, more, step = zlib.decompressobj(-15), 0, 0, True, 256
    try:
        while not d.eof and (more or place < n):
            part = d.unconsumed_tail
            if not part:
                part = b[place : place + step]
                place, step = place + step, min(2 * step, STEP)
            out = d.decompress(part, STEP)
            crc, size, more = zlib.crc32(out, crc), size + len(out), len(out) == STEP or bool(d.unconsumed_tail)
    except zlib.error:
        return 0
    end = min(place, n) - len(d.unused_data)
    return end + 8 - at if d.eof and end + 8 <= n and struct.unpack_from("<II", b, end) == (crc, size & 0xFFFFFFFF) else 0


def _bmp(c: Content, at: int) -> int:
    b = c.raw
    if at + 26 > len(b):
        return 0
    size, zero, data, header = struct.unpack_from("<IIII", b, at + 2)
    return size if not zero and header in (12, 40, 52, 56, 64, 108, 124) and 14 + header <= data <= size <= len(b) - at else 0


VALIDATE = {"audio/wav": _wav, "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "application/pdf": _pdf, "application/zip": _zip, "application/gzip": _gzip, "image/bmp": _bmp}
_AUTOMATON: list[ahocorasick.Automaton] = []


def automaton() -> ahocorasick.Automaton:
    if not _AUTOMATON:
        a = ahocorasick.Automaton()
        for magic, kind, offset in MAGIC:
            a.add_word(magic.decode("latin-1"), (len(magic) + offset, kind))
        a.make_automaton()
        _AUTOMATON.append(a)
    return _AUTOMATON[0]


def sniff(content: bytes) -> list[tuple[int, int, str]]:
    """(offset, length, type) of all confirmed media, outermost first, none inside another."""
    found, whole, free = [], Content(content), 0
    for last, (length, kind) in automaton().iter(content.decode("latin-1")):
        at = last + 1 - length
        if at >= free and (size := VALIDATE[kind](whole, at)):
            found.append((at, size, kind))
            free = at + size
    return found


def sniff_column(df: DataFrame, id_col: str, content_col: str, declared_col: str) -> DataFrame:
    """Rows (id_col, declared, media_type, corrected, media array<struct<offset, length, type, content>>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("content", pa.binary())]))
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                declared, media, types = part.column(2).to_pylist(), [], []
                for content in part.column(1).to_pylist():
                    hits = sniff(content or b"")
                    types.append(hits[0][2] if hits and hits[0][0] == 0 else None)
                    media.append([{"offset": a, "length": n, "type": t, "content": content[a : a + n]} for a, n, t in hits])
                actual = [t or d for t, d in zip(types, declared, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(actual, pa.string()), pa.array([a != d for a, d in zip(actual, declared, strict=True)]), pa.array(media, kind)], names=["id", "declared", "media_type", "corrected", "media"])

    picked = df.select(F.col(id_col).alias("id"), F.col(content_col).cast("binary").alias("content"), F.col(declared_col).cast("string").alias("declared"))
    done = picked.mapInArrow(run, f"id {dict(picked.dtypes)['id']}, declared string, media_type string, corrected boolean, media array<struct<offset:bigint,length:bigint,type:string,content:binary>>")
    return done.withColumnRenamed("id", id_col)


def pad(content: bytes) -> bytes:
    """Spaces up to a positive multiple of 192 bytes."""
    return content + b" " * (-len(content) % UNIT if content else UNIT)


def wrap_wav(payload: bytes) -> bytes:
    """A WAV file whose 8-bit mono samples are the payload, with the pad byte of odd lengths."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(payload) % 2, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * (len(payload) % 2)


def samples(wav: bytes) -> bytes:
    """The bytes of the data chunk of a confirmed WAV file."""
    at = 12
    while True:
        name, size = struct.unpack_from("<4sI", wav, at)
        if name == b"data":
            return wav[at + 8 : at + 8 + size]
        at += 8 + size + size % 2


def example(kind: str, payload: bytes) -> bytes:
    """A small whole file of one of the formats, made of `payload`."""
    if kind == "audio/wav":
        return wrap_wav(payload)
    if kind == "image/png":
        row = payload[:64] or b"\0"
        parts = ((b"IHDR", struct.pack(">IIBBBBB", len(row), 1, 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(b"\0" + row)), (b"IEND", b""))
        return MAGIC[1][0] + b"".join(struct.pack(">I", len(x)) + n + x + struct.pack(">I", zlib.crc32(n + x)) for n, x in parts)
    if kind == "image/gif":
        data = payload[:64] or b"\0"
        return b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02" + bytes([len(data)]) + data + b"\0;"
    if kind == "image/jpeg":
        note = payload[:64]
        return b"\xff\xd8\xff\xfe" + struct.pack(">H", len(note) + 2) + note + b"\xff\xda" + struct.pack(">H", 2) + note + b"\xff\xd9"
    if kind == "application/pdf":
        return b"%PDF-1.4\n% " + payload[:64].replace(b"%", b".") + b"\nstartxref\n0\n%%EOF"
    if kind == "application/zip":
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(zipfile.ZipInfo("a.txt"), payload[:64])
        return out.getvalue()
    if kind == "application/gzip":
        return gzip.compress(payload[:64], mtime=0)
    if kind == "image/bmp":
        row = payload[:64] or b"\0"
        return b"BM" + struct.pack("<IIIIIIHHIIIIII", 54 + len(row), 0, 54, 40, len(row), 1, 1, 8, 0, len(row), 0, 0, 0, 0) + row
    raise ValueError(kind)


def planted(content: bytes) -> tuple[str | None, bytes, list[tuple[int, int, str]]]:
    """(declared type, content, what is in it whole): by CRC-32 of the text a quarter each is left as it is, opens with a
    file of another type than declared, holds one in its middle, or holds a cut one; the formats take turns."""
    draw = zlib.crc32(content)
    kind = list(VALIDATE)[draw // 4 % len(VALIDATE)]
    file = example(kind, content)
    middle = len(content) // 2
    if draw % 4 == 0:
        return "text/plain", content, []
    if draw % 4 == 1:
        return "text/plain", file + content, [(0, len(file), kind)]
    if draw % 4 == 2:
        return None, content[:middle] + file + content[middle:], [(middle, len(file), kind)]
    return kind, content[:middle] + file[:-1], []


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text as WAV samples, sniff what was stored, and read it back; then sniff the text with planted media.

    The feature string is type:offset:length of all that was confirmed, then sample minimum, maximum, mean
    and zero-based crossings of the middle value. `declared`, `media_type`, `corrected` and `carved`
    (type:offset:length of each, SHA-256 of all carved bytes) are of the text with media planted by rule.
    """
    import numpy as np

    def one(text: bytes) -> tuple:
        declared, mixed, _ = planted(text)
        inside = sniff(mixed)
        actual = inside[0][2] if inside and inside[0][0] == 0 else declared
        carving = ",".join(f"{t}:{a}:{n}" for a, n, t in inside)
        digest = hashlib.sha256(b"".join(mixed[a : a + n] for a, n, _ in inside)).hexdigest() if inside else None
        stored = wrap_wav(pad(text))
        hits = sniff(stored)
        at, size, _ = hits[0]
        carved = stored[at : at + size]
        back = samples(carved)
        values = np.frombuffer(back, np.uint8)
        high = values >= 128
        feature = ",".join(f"{t}:{a}:{n}" for a, n, t in hits) + f";min={values.min()};max={values.max()};mean={values.mean():.6f};crossings={int((high[1:] != high[:-1]).sum())}"
        return len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(carved), hashlib.sha256(carved).hexdigest(), feature, declared, actual, actual != declared, carving, digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "declared", "media_type", "corrected", "carved", "carved_sha256"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string()]
        for batch in batches:
            rows = [one(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in batch.column(1)]
            columns = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", *names])

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("content"))
    schema = f"id {dict(picked.dtypes)['id']}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, declared string, media_type string, corrected boolean, carved string, carved_sha256 string"
    return picked.mapInArrow(run, schema).withColumnRenamed("id", id_col)
