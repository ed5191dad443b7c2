"""Media columns: storing payloads as media, and signature sniffing of media bytes.

Sniffing: an Aho-Corasick automaton over all magic bytes finds candidate starts in one pass over
a value; each candidate is handed to its format's validator, which reads the structure and the
length it declares. A candidate that doesn't hold to its format is noise. A valid file at the
start gives the value's true type, whatever was declared; valid files at other places are carved
as embedded media, those within another valid file too, at any depth.

Storing: a payload of bytes becomes the 8-bit samples of a mono WAVE file, without loss.

Nulls: a null text is an empty payload; a null value or one without any valid file has the type
application/octet-stream. Repeated rows give equal rows, an empty table none. Very long values
are read whole, one at a time. Columns other than those named are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, text_bytes

#: Payloads are filled with zero bytes to a positive multiple of this.
BLOCK = 64
SAMPLE_RATE = 8000
UNKNOWN = "application/octet-stream"
#: Declared types of a stored text: of the file and of the payload in it.
STORED, TEXT = "audio/wav", "text/plain"


def _wave(b: bytes, at: int) -> int:
    if b[at + 8 : at + 12] != b"WAVE":
        return 0
    size = 8 + struct.unpack_from("<I", b, at + 4)[0]
    if at + size > len(b):
        return 0
    k, chunks = at + 12, set()
    while k + 8 <= at + size:
        name, n = b[k : k + 4], struct.unpack_from("<I", b, k + 4)[0]
        if name == b"fmt " and n < 16 or k + 8 + n > at + size:
            return 0
        chunks.add(name)
        k += 8 + n + n % 2
    return size if {b"fmt ", b"data"} <= chunks and k >= at + size else 0


def _png(b: bytes, at: int) -> int:
    k, first = at + 8, True
    while k + 12 <= len(b):
        n, name = struct.unpack_from(">I4s", b, k)
        if first and (name != b"IHDR" or n != 13) or k + 12 + n > len(b):
            return 0
        if zlib.crc32(b[k + 4 : k + 8 + n]) != struct.unpack_from(">I", b, k + 8 + n)[0]:
            return 0
        k, first = k + 12 + n, False
        if name == b"IEND":
            return k - at
    return 0


def _gif(b: bytes, at: int) -> int:
    if at + 13 > len(b):
        return 0
    k = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 0x80 else 0)

    def blocks(k: int) -> int:
        while k < len(b) and b[k]:
            k += 1 + b[k]
        return k + 1

    while k < len(b):
        if b[k] == 0x3B:
            return k + 1 - at
        if b[k] == 0x21:
            k = blocks(k + 2)
        elif b[k] == 0x2C and k + 10 <= len(b):
            k = blocks(k + 11 + (3 << (b[k + 9] & 7) + 1 if b[k + 9] & 0x80 else 0))
        else:
            return 0
    return 0


def _jpeg(b: bytes, at: int) -> int:
    k, frame = at + 2, False
    while k + 4 <= len(b) and b[k] == 0xFF:
        mark = b[k + 1]
        n = struct.unpack_from(">H", b, k + 2)[0]
        if n < 2 or not 0xC0 <= mark <= 0xFE or 0xD0 <= mark <= 0xD9:
            return 0
        frame |= 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC)
        k += 2 + n
        if mark == 0xDA:  # then coded data, in which FF is followed by 0 or a restart mark
            while (k := b.find(b"\xff", k)) >= 0 and k + 1 < len(b):
                if b[k + 1] == 0xD9:
                    return k + 2 - at if frame else 0
                if b[k + 1] and not 0xD0 <= b[k + 1] <= 0xD7:
                    break
                k += 2
            if k < 0:
                return 0
    return 0


def _bmp(b: bytes, at: int) -> int:
    if at + 30 > len(b):
        return 0
    size, _, data, head, _, _, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    good = at + size <= len(b) and head in (40, 52, 56, 108, 124) and 14 + head <= data <= size and planes == 1 and bits in (1, 4, 8, 16, 24, 32)
    return size if good else 0


def _gzip(b: bytes, at: int) -> int:
    if at + 18 > len(b) or b[at + 2] != 8 or b[at + 3] & 0xE0:
        return 0
    d, k = zlib.decompressobj(31), at
    try:
        while not d.eof and k < len(b):
            d.decompress(b[k : k + 65536])
            k += 65536
    except zlib.error:
        return 0
    return min(k, len(b)) - len(d.unused_data) - at if d.eof else 0


def _zip(b: bytes, at: int) -> int:
    end = at
    while (end := b.find(b"PK\x05\x06", end + 1)) >= 0 and end + 22 <= len(b):  # a stored zip has one of its own
        size, start, note = struct.unpack_from("<IIH", b, end + 12)
        if at + start + size == end and b[at + start : at + start + 4] == b"PK\x01\x02" and end + 22 + note <= len(b):
            return end + 22 + note - at
    return 0


def _pdf(b: bytes, at: int) -> int:
    if not b[at + 5 : at + 6].isdigit() or b[at + 6 : at + 7] != b".":
        return 0
    end, after = b.find(b"%%EOF", at), b.find(b"%PDF-", at + 5)
    while after > 0 and 0 <= (more := b.find(b"%%EOF", end + 5)) < after or after < 0 <= (more := b.find(b"%%EOF", end + 5)):
        end = more
    return end + 5 - at if end > 0 and b.find(b"startxref", at, end) > 0 else 0


#: Magic bytes and media types.
FORMATS: dict[bytes, tuple[str, Callable[[bytes, int], int]]] = {
    b"RIFF": ("audio/wav", _wave),
    b"\x89PNG\r\n\x1a\n": ("image/png", _png),
    b"GIF87a": ("image/gif", _gif),
    b"GIF89a": ("image/gif", _gif),
    b"\xff\xd8\xff": ("image/jpeg", _jpeg),
    b"BM": ("image/bmp", _bmp),
    b"\x1f\x8b": ("application/gzip", _gzip),
    b"PK\x03\x04": ("application/zip", _zip),
    b"%PDF-": ("application/pdf", _pdf),
}

_automata: list = []


def _automaton():
    """The automaton over all magic bytes (as Latin-1 text), made once in each worker."""
    if not _automata:
        import ahocorasick

        a = ahocorasick.Automaton()
        for magic in FORMATS:
            a.add_word(magic.decode("latin-1"), magic)
        a.make_automaton()
        _automata.append(a)
    return _automata[0]


def nested(value: bytes) -> list[tuple[str, int, int, int, int]]:
    """Valid files in the value, in order of place: (type, offset, length, depth, parent). A file
    within another one has that one's depth plus 1 and its place in this list as parent, else 0
    and -1. What starts in a file has to end in it."""
    out, open_ = [], []
    for last, magic in _automaton().iter(value.decode("latin-1")):
        at = last + 1 - len(magic)
        while open_ and at >= out[open_[-1]][1] + out[open_[-1]][2]:
            open_.pop()
        end = out[open_[-1]][1] + out[open_[-1]][2] if open_ else len(value)
        kind, valid = FORMATS[magic]
        try:
            n = valid(value, at)
            if at + n > end:
                n = valid(value[:end], at)
        except struct.error:
            n = 0
        if n:
            out.append((kind, at, n, len(open_), open_[-1] if open_ else -1))
            open_.append(len(out) - 1)
    return out


def sniff(value: bytes) -> list[tuple[str, int, int]]:
    """Valid files in the value that are in no other one, in order of place: (type, offset, length)."""
    return [f[:3] for f in nested(value) if not f[3]]


def wave_of(payload: bytes) -> bytes:
    n = len(payload)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n + n % 2, b"WAVE", b"fmt ", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8, b"data", n) + payload + b"\0" * (n % 2)


def wave_samples(wave: bytes, at: int, n: int) -> bytes:
    """Samples of the valid WAVE file at that place."""
    k = at + 12
    while wave[k : k + 4] != b"data":
        size = struct.unpack_from("<I", wave, k + 4)[0]
        k += 8 + size + size % 2
    return wave[k + 8 : k + 8 + struct.unpack_from("<I", wave, k + 4)[0]]


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: every whole text as a stored media file, its type declared
    (declared)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column(1).to_pylist()
            waves = [wave_of(x + b"\0" * (-len(x) % BLOCK if x else BLOCK)) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array(waves, pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")
    return rows.withColumn("declared", F.lit(STORED))


SNIFFED = "type string, corrected boolean, found array<struct<type string, offset long, length long, depth int, parent int>>"


def sniffed(media: DataFrame, keep: list[str], value: str = "media", declared: str = "declared") -> DataFrame:
    """The kept columns of media, its value and what was found in it: type (of the file at the
    start), corrected (type differs from the declared one) and found (all valid files at any depth,
    as nested() gives them; those past the first are embedded ones, to be carved by offset and length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [nested(v or b"") for v in batch.column(value).to_pylist()]
            types = [f[0][0] if f and not f[0][1] else UNKNOWN for f in found]
            right = [t != d for t, d in zip(types, batch.column(declared).to_pylist(), strict=True)]
            spans = pa.array([[dict(zip(("type", "offset", "length", "depth", "parent"), x, strict=True)) for x in f] for f in found], pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("depth", pa.int32()), ("parent", pa.int32())])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(types), pa.array(right), spans], names=[*batch.schema.names, "type", "corrected", "found"])

    chosen = media.select(*keep, value, declared)
    return chosen.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema) + ", " + SNIFFED)


def carved(found: DataFrame, keep: list[str], value: str = "media") -> DataFrame:
    """One row per file found: the kept columns, type, offset, length, depth, parent and its bytes."""
    return found.select(*keep, value, F.explode("found").alias("f")).select(*keep, "f.type", "f.offset", "f.length", "f.depth", "f.parent", F.substring(value, F.col("f.offset").cast("int") + 1, F.col("f.length").cast("int")).alias("bytes"))


def features(media: DataFrame) -> DataFrame:
    """Payload features of stored texts, read back from the media bytes at the sniffed place. What
    was found below the stored file is in the payload: its type (the declared one, corrected where a
    valid file stands at its start), how many valid files it holds at any depth, and their types."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = []
            for doc, n, wave, kind, wrong, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media", "type", "corrected", "found")), strict=True):
                samples = wave_samples(wave, found[0]["offset"], found[0]["length"]) if kind == "audio/wav" else b""
                levels = np.frombuffer(samples, np.uint8)
                # The payload is the end of the stored file, but for a padding byte.
                start = found[0]["offset"] + found[0]["length"] - len(samples) if found else 0
                inner = next((f["type"] for f in found[1:] if f["offset"] == start), TEXT)
                held = ",".join(sorted({f["type"] for f in found[1:]}))
                some = f"{kind};payload={inner};corrected={int(inner != TEXT)};wrong_file={int(wrong)};embedded={len(found) - 1};held={held};rate={SAMPLE_RATE};frames={len(samples)};mean={levels.mean():.4f};peak={levels.max()};crossings={int(np.count_nonzero(np.diff(levels >= 128)))}"
                out.append((doc, n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-BLOCK:]), len(wave), hashlib.sha256(wave).hexdigest(), some))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), FEATURE_TYPES, strict=True)] if out else [pa.array([], t) for t in FEATURE_TYPES], names=FEATURES)

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


FEATURES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
FEATURE_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
