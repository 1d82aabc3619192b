"""Media columns: what stored bytes really are, by signature sniffing.

An Aho-Corasick automaton finds the magic bytes of all formats in one pass. A hit counts only if the format's validator can
walk the structure from there: chunk lengths, checksums and end marks must agree with the bytes. What validates at the
start corrects the declared type; what validates further in is carved out as embedded media.

op9 stores each text as 8-bit mono PCM (WAV): a byte is a sample. Defined cases: null text is empty and stored as 64 zero
bytes; null or empty bytes have no type, so the declared one is replaced by application/octet-stream; equal bytes give equal
values; repeated rows stay repeated; a very long text is stored as a whole, one at a time; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches
from .words import as_bytes, row_slices

UNKNOWN = "application/octet-stream"
ALIGN = 64
RATE = 8000


def _png(b: memoryview, at: int) -> int | None:
    at += 8
    while at + 12 <= len(b):
        n = int.from_bytes(b[at : at + 4], "big")
        if at + 12 + n > len(b) or zlib.crc32(b[at + 4 : at + 8 + n]) != int.from_bytes(b[at + 8 + n : at + 12 + n], "big"):
            return None
        kind, at = bytes(b[at + 4 : at + 8]), at + 12 + n
        if kind == b"IEND":
            return at
    return None


def _riff(b: memoryview, at: int) -> int | None:
    if at + 12 > len(b):
        return None
    end = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little")
    if end > len(b) or bytes(b[at + 8 : at + 12]) != b"WAVE":
        return None
    seen, at = set(), at + 12
    while at + 8 <= end:
        seen.add(bytes(b[at : at + 4]))
        n = int.from_bytes(b[at + 4 : at + 8], "little")
        at += 8 + n + n % 2
    return end if at == end and {b"fmt ", b"data"} <= seen else None


def _gif(b: memoryview, at: int) -> int | None:
    if at + 13 > len(b):
        return None
    flags = b[at + 10]
    at += 13 + (3 << (1 + (flags & 7)) if flags & 128 else 0)
    while at < len(b):
        kind = b[at]
        if kind == 0x3B:
            return at + 1
        if kind == 0x2C:
            if at + 10 > len(b):
                return None
            flags = b[at + 9]
            at += 11 + (3 << (1 + (flags & 7)) if flags & 128 else 0)
        elif kind == 0x21:
            at += 2
        else:
            return None
        while at < len(b) and b[at]:
            at += 1 + b[at]
        at += 1
    return None


def _jpeg(b: memoryview, at: int) -> int | None:
    at += 2
    while at + 4 <= len(b):
        if b[at] != 0xFF:
            return None
        kind = b[at + 1]
        if kind == 0xD9:
            return at + 2
        at += 2 + int.from_bytes(b[at + 2 : at + 4], "big")
        if kind == 0xDA:  # coded data: up to the next marker
            while at + 1 < len(b) and not (b[at] == 0xFF and b[at + 1] not in (0, *range(0xD0, 0xD8))):
                at += 1
    return at + 2 if at + 2 == len(b) and bytes(b[at:]) == b"\xff\xd9" else None


def _bmp(b: memoryview, at: int) -> int | None:
    if at + 54 > len(b):
        return None
    size, _, start, head, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    ok = size >= 54 and at + size <= len(b) and 54 <= start <= size and head in (40, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32)
    return at + size if ok and width > 0 and start + (width * bits + 31) // 32 * 4 * abs(height) <= size else None


def _pdf(b: memoryview, at: int) -> int | None:
    """Up to the last end mark before another document begins."""
    data = b.obj
    stop = data.find(b"%PDF-", at + 5)
    stop = len(data) if stop < 0 else stop
    end = data.rfind(b"%%EOF", at, stop)
    return end + 5 if end > 0 and data.find(b"startxref", at, end) >= 0 else None


@lru_cache(maxsize=1)
def _directories(data: bytes) -> list[int]:
    """Where the end records of zip directories begin, found once for all the entries before them."""
    return [m.start() for m in re.finditer(b"PK\x05\x06", data)]


def _zip(b: memoryview, at: int) -> int | None:
    ends = _directories(b.obj)
    i = bisect.bisect_left(ends, at)
    if i == len(ends) or ends[i] + 22 > len(b):
        return None
    tail = ends[i]
    size, start, note = struct.unpack_from("<IIH", b, tail + 12)
    return tail + 22 + note if start + size == tail - at and tail + 22 + note <= len(b) else None


#: (magic, type, validator: the end of what starts at an offset, or None)
FORMATS: tuple[tuple[bytes, str, Callable[[memoryview, int], int | None]], ...] = (
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"RIFF", "audio/wav", _riff),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"BM", "image/bmp", _bmp),
    (b"%PDF-", "application/pdf", _pdf),
    (b"PK\x03\x04", "application/zip", _zip),
)


def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for i, (magic, _, _) in enumerate(FORMATS):
        out.add_word(magic.decode("latin-1"), i)
    out.make_automaton()
    return out


def sniff(data: bytes, automaton: ahocorasick.Automaton | None = None) -> list[tuple[str, int, int]]:
    """(type, start, end) of the media in data, in order, outermost first; what starts at 0 is the type of data."""
    view, found = memoryview(data), []
    for last, i in (automaton or _automaton()).iter(data.decode("latin-1")):
        magic, kind, valid = FORMATS[i]
        start = last - len(magic) + 1
        if (end := valid(view, start)) is not None:
            found.append((kind, start, end))
    return sorted(found, key=lambda x: (x[1], -x[2]))


def store(payload: bytes) -> bytes:
    """payload as 8-bit mono PCM samples in a WAV container."""
    fmt = struct.pack("<HHIIHH", 1, 1, RATE, RATE, 1, 8)
    pad = b"\0" * (len(payload) % 2)
    return struct.pack("<4sI4s4sI", b"RIFF", 36 + len(payload) + len(pad), b"WAVE", b"fmt ", 16) + fmt + struct.pack("<4sI", b"data", len(payload)) + payload + pad


def read(stored: bytes) -> bytes:
    """The samples of the data chunk."""
    at = 12
    while stored[at : at + 4] != b"data":
        at += 8 + int.from_bytes(stored[at + 4 : at + 8], "little")
    return stored[at + 8 : at + 8 + int.from_bytes(stored[at + 4 : at + 8], "little")]


def _sniff_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = _automaton()
    for batch in batches:
        kinds, media = [], []
        for data in as_bytes(batch.column(1)):
            found = sniff(data, automaton)
            kinds.append(found[0][0] if found and found[0][1] == 0 else UNKNOWN)
            media.append([{"type": k, "start": s, "media": data[s:e]} for k, s, e in found if s > 0])
        kind = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("media", pa.binary())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(kinds), pa.array(media, kind)], ["id", "declared", "type", "embedded"])


def sniffed(rows: DataFrame) -> DataFrame:
    """(id, declared, type, embedded) of rows (id, data binary, declared): the corrected type, and media carved from within."""
    kind = dict(rows.dtypes)["id"]
    return rows.select("id", "data", "declared").mapInArrow(_sniff_rows, f"id {kind}, declared string, type string, embedded array<struct<type:string,start:bigint,media:binary>>")


def _feature(stored: bytes, payload: bytes, automaton: ahocorasick.Automaton) -> str:
    found = sniff(stored, automaton)
    samples = np.frombuffer(payload, np.uint8).astype(np.float64) - 128.0
    inner = ",".join(f"{k}@{s}" for k, s, _ in found if s > 0)
    kind = found[0][0] if found and found[0][1] == 0 else UNKNOWN
    crossings = int(np.count_nonzero(np.diff(samples < 0)))
    return f"{kind};samples={len(samples)};mean={samples.mean():.4f};rms={np.sqrt(np.mean(samples * samples)):.4f};crossings={crossings};embedded={inner}"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = _automaton()
    for batch in batches:
        for lo, hi in row_slices(batch.column(1), 8 << 20):
            out: dict[str, list] = {c: [] for c in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for data in as_bytes(batch.column(1).slice(lo, hi - lo)):
                stored = store(data + b"\0" * (max(ALIGN, -(-len(data) // ALIGN) * ALIGN) - len(data)))
                payload = read(stored)
                row = (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ALIGN:]), len(stored), hashlib.sha256(stored).hexdigest(), _feature(stored, payload, automaton))
                for c, x in zip(out, row):
                    out[c].append(x)
            cols = [pa.array(x, pa.string() if c == "feature" or c.endswith("sha256") else pa.int64()) for c, x in out.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *cols], ["doc_id", *out])


def op9_media_columns(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.mapInArrow(_digests, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
