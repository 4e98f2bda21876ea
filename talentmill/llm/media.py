"""ISO media containers: writing, and reading of features from boxes (operator 9).

``mux`` stores bytes as 8-bit PCM access units of ``unit`` bytes in one track; ``features``
walks the nested boxes, decodes the sample tables and gives codec, duration and the byte ranges
that start at keyframes. It reads headers and tables only; sample data are skipped over by
their boxes' sizes and fetched from the ranges alone.

Edge cases: a null or empty text becomes one unit of blanks; equal texts give equal bytes, whatever
their rows; very long texts become longer tables, a text at a time in memory; truncated, damaged or
foreign files and fragmented ones, whose tables are elsewhere, give codec null and no ranges; of
several tracks the first sound one counts; null ids and repeated rows are kept one by one; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentmill.llm._common import batch, strings, text_or_empty, tidy

UNIT, RATE, KEY_EVERY, UNITS_A_CHUNK = 192, 8000, 16, 64
#: Boxes that hold boxes, and the bytes before the first of them.
NESTED = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"dinf": 0}
MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def mux(payload: bytes, unit: int = UNIT, rate: int = RATE, key_every: int = KEY_EVERY, units_a_chunk: int = UNITS_A_CHUNK) -> bytes:
    """A file of one track: each access unit holds ``unit`` 8-bit samples, every ``key_every``-th is a keyframe."""
    n = len(payload) // unit
    chunks = -(-n // units_a_chunk)
    duration = n * unit
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    runs = [(1, units_a_chunk)] * (n >= units_a_chunk) + [(chunks, n % units_a_chunk)] * (n % units_a_chunk > 0)
    keys = range(1, n + 1, key_every)
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, rate << 16))

    def moov(first: int) -> bytes:
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, unit)),
            full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", at, k, 1) for at, k in runs)),
            full(b"stsz", struct.pack(">II", unit, n)),
            full(b"co64", struct.pack(f">I{chunks}Q", chunks, *(first + i * units_a_chunk * unit for i in range(chunks)))),
        )
        minf = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, rate, duration, 0x55C4, 0)), full(b"hdlr", bytes(4), b"soun", bytes(12), b"sound\0"), minf)
        tkhd = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, duration), bytes(8), struct.pack(">hhhh", 0, 0, 256, 0), MATRIX, bytes(8), flags=7)
        mvhd = full(b"mvhd", struct.pack(">IIII", 0, 0, rate, duration), struct.pack(">IH", 0x10000, 256), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    first = len(head) + len(moov(0)) + 8
    return b"".join((head, moov(first), struct.pack(">I4s", len(payload) + 8, b"mdat"), payload))


def walk(data: bytes, begin: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start of body, end) of every box, depth first; a box that overruns its parent ends the walk."""
    at, end = begin, len(data) if end is None else end
    while at + 8 <= end:
        length, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if length == 1 and at + 16 <= end:
            length, body = struct.unpack_from(">Q", data, at + 8)[0], at + 16
        length = end - at if length == 0 else length
        if at + length > end or length < body - at:
            return
        yield kind, body, at + length
        if kind in NESTED:
            yield from walk(data, body + NESTED[kind], at + length)
        at += length


NOTHING = {"codec": None, "timescale": 0, "duration": 0, "samples": [], "ranges": []}


def tracks(data: bytes) -> list[dict[bytes, tuple[int, int]]]:
    """Boxes (start of body, end) of each track."""
    own: list[dict[bytes, tuple[int, int]]] = []
    until = 0
    for kind, a, b in walk(data):
        if kind == b"trak":
            own.append({})
            until = b
        elif own and a < until:
            own[-1].setdefault(kind, (a, b))
    return own


def features(data: bytes) -> dict:
    """codec, timescale, duration, sizes and offsets of samples, and keyframe byte ranges of the first track whose
    tables are sound. A track is not if its tables overrun their boxes, contradict each other or point beyond the file."""
    for found in tracks(data):
        try:
            out = track_features(data, found)
        except (struct.error, IndexError, ValueError):
            continue
        if out["codec"] and all(0 <= at and at + size <= len(data) for at, size in out["samples"]):
            return out
    return NOTHING


def track_features(data: bytes, found: dict[bytes, tuple[int, int]]) -> dict:
    out = dict(NOTHING)
    u32 = lambda at, n=1: struct.unpack_from(f">{n}I", data, at)
    room = {kind: (b - a) // 4 for kind, (a, b) in found.items()}  # longs that fit into the box
    if not {b"stsd", b"stsz", b"stsc", b"mdhd"} <= found.keys() or not found.keys() & {b"stco", b"co64"}:
        return out
    out["codec"] = data[found[b"stsd"][0] + 12 : found[b"stsd"][0] + 16].decode("latin-1")
    at = found[b"mdhd"][0]
    out["timescale"], out["duration"] = u32(at + 12, 2) if data[at] == 0 else struct.unpack_from(">IQ", data, at + 20)
    at = found[b"stsz"][0]
    fixed, n = u32(at + 4, 2)
    if not fixed and n > room[b"stsz"] or fixed * n > len(data):
        raise ValueError("sizes")
    sizes = [fixed] * n if fixed else u32(at + 12, n)
    at, wide = found.get(b"co64", found.get(b"stco"))[0], b"co64" in found
    chunks = struct.unpack_from(f">{u32(at + 4)[0]}{'Q' if wide else 'I'}", data, at + 8)
    at = found[b"stsc"][0]
    table = u32(at + 8, 3 * u32(at + 4)[0])
    runs = [*zip(table[::3], table[1::3], strict=True), (len(chunks) + 1, 0)]
    samples: list[tuple[int, int]] = []
    for (first, count), (until, _) in zip(runs, runs[1:], strict=False):
        for chunk in chunks[first - 1 : until - 1]:
            own = sizes[len(samples) : len(samples) + count]
            samples += zip(accumulate(own[:-1], initial=chunk), own, strict=False)
    if len(samples) != n or [*table[::3]] != sorted({*table[::3]}) or n and table[:1] != (1,):
        raise ValueError("samples")
    out["samples"] = samples
    keys = u32(found[b"stss"][0] + 8, u32(found[b"stss"][0] + 4)[0]) if b"stss" in found else range(1, n + 1)
    if any(not 1 <= k <= n for k in keys) or [*keys] != sorted({*keys}):
        raise ValueError("keyframes")
    out["ranges"] = [(samples[k - 1][0], sum(size for _, size in samples[k - 1 : after - 1])) for k, after in zip(keys, [*keys[1:], n + 1], strict=True)]
    return out


def read_samples(data: bytes, samples: list[tuple[int, int]]) -> bytes:
    return b"".join([data[at : at + size] for at, size in samples])


def padded(text: str, unit: int = UNIT) -> tuple[int, bytes]:
    raw = text.encode()
    return len(raw), raw + b" " * (-len(raw) % unit if raw else unit)


def media_columns(docs: DataFrame, unit: int = UNIT) -> DataFrame:
    """Container column and its features for each row: doc_id, n_bytes, media (binary), codec, seconds,
    keyframes (array of begin, length), payload (bytes read back through the sample tables)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("codec", pa.string()), ("seconds", pa.float64()), ("keyframes", pa.list_(pa.struct([("begin", pa.int64()), ("length", pa.int64())]))), ("payload", pa.binary())])

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):  # containers of at most 512 texts in memory
                b = whole.slice(at, 512)
                raw = [padded(t, unit) for t in strings(b.column(1))]
                files = [mux(p, unit) for _, p in raw]
                read = [features(f) for f in files]
                yield batch(schema, b.column(0), [n for n, _ in raw], files, [r["codec"] for r in read], [r["duration"] / max(1, r["timescale"]) for r in read], [[{"begin": x, "length": y} for x, y in r["ranges"]] for r in read], [read_samples(f, r["samples"]) for f, r in zip(files, read, strict=True)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(tidy(convert), "doc_id long, n_bytes long, media binary, codec string, seconds double, keyframes array<struct<begin:long,length:long>>, payload binary")


def media_digest(docs: DataFrame, unit: int = UNIT) -> DataFrame:
    """The operator's columns as digests, made in the task that holds the container, so that no container is moved;
    codec, seconds and keyframes (begin:length of each, comma-joined) whole."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("codec", pa.string()), ("seconds", pa.float64()), ("keyframes", pa.string())])

    def row(n_bytes: int, data: bytes) -> tuple:
        got = features(data)
        payload = read_samples(data, got["samples"])
        ranges = ",".join(f"{a}:{n}" for a, n in got["ranges"])
        feature = f"codec={got['codec']};seconds={got['duration'] / max(1, got['timescale']):.3f};units={len(got['samples'])};keyframes={len(got['ranges'])};ranges={hashlib.sha256(ranges.encode()).hexdigest()[:16]}"
        return n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature, got["codec"], got["duration"] / max(1, got["timescale"]), ranges

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [row(n, mux(p, unit)) for n, p in (padded(t, unit) for t in strings(b.column(1)))]
            yield batch(schema, b.column(0), *(zip(*rows, strict=True) if rows else [[]] * 10))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(tidy(convert), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, seconds double, keyframes string")
