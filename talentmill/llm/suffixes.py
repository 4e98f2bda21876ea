"""Removal of repeated byte strings by a distributed sort of suffixes (operator 5).

A byte goes if a string of ``least`` bytes over it also starts in a document with a smaller id.

Not every suffix is sorted. Each window of ``least`` bytes has an anchor, the least-hashed gram of
GRAM bytes in it, and equal windows have equal anchors at equal places, so suffixes that start at
anchors stand for all windows. Texts are looked at side by side, SEGMENT bytes at a time. Anchors whose gram occurs in one text only drop out before any
suffix is made. The others' suffixes, with the bytes to their left as a second part of the key, are
sorted in each task, front-coded (length of the prefix shared with the suffix before, then the
rest) and exchanged by ranges, all ranges of a task's 100,000 suffixes in one batch. A range's runs are
decoded and merged at once by a sort that starts from the runs, so that neither more runs nor more
ranges cost steps of Python for each suffix; neighbours then tell the prefixes they share.

The merged prefixes decide: suffixes between which none is shorter than a window's part from the
anchor on are one run; among them, the parts before the anchor are told apart by their own order
and its shared prefixes. So a class of equal windows is a pair of two runs, no bytes but those
compared in sorting count, and the least id of each class stays.

A range holds all suffixes of its grams; ranges are as many as the suffixes demand, dealt by the
gram's hash. A gram with more than ``hot_anchors`` anchors is split by further bytes: windows that lie
mostly right of their anchor go by the gram and the bytes after it, the others by the gram and the
bytes before it, in suffixes that are sorted by these first.

Equal texts are settled first: all but those of the least id go whole. A task sends at most one
suffix of each distinct context, and one marker for each gram that it has in several texts, so
that hot passages grow with the number of tasks, not of rows.

Edge cases: null texts are empty; texts under ``least`` bytes stay whole; very long texts are cut into
overlapping segments for their anchors and else taken whole, one at a time; rows with a null id
neither remove nor lose anything; equal rows and equal ids are treated alike, as only a smaller id
removes; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentmill.llm._common import batch, discard, materialise, text_or_empty, tidy
from talentmill.llm.jaccard import mixed

U64 = np.uint64
GRAM = 16
#: Bytes that are looked at together for their anchors; arrays of so many longs are not yet mapped anew for each step.
SEGMENT = 1 << 14
NONE = np.zeros(0, np.int64)


def anchors_of(texts: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts of less than SEGMENT bytes together: the text's number, hash and place of each anchor, and the first and last
    window start that it stands for. Short texts are looked at side by side, as each step over an array has a cost of its own."""
    size = np.array([len(x) for x in texts], np.int64)
    begin, windows = np.cumsum(size) - size, np.maximum(size - least + 1, 0)
    if not windows.any():
        return (NONE,) * 5
    raw = b"".join(texts)
    eight = np.empty(len(raw) - 7, U64)
    for k in range(8):
        eight[k::8] = np.frombuffer(raw, "<u8", max(0, len(eight) - k + 7) // 8, k)
    h = mixed(eight[:-8] * U64(0x9E3779B97F4A7C15) ^ mixed(eight[8:]))
    low = h & ~U64(SEGMENT - 1)
    low |= np.arange(len(h), dtype=U64)  # ties: the leftmost
    span, step = least - GRAM + 1, 1
    while step * 2 <= span:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if step < span:
        low = np.minimum(low[: len(low) - (span - step)], low[span - step :])
    text = np.repeat(np.arange(len(texts)), windows)
    start = np.arange(len(text)) + np.repeat(begin - (np.cumsum(windows) - windows), windows)  # windows within one text
    place = (low[start] & U64(SEGMENT - 1)).astype(np.int64)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    last = np.append(first[1:] - 1, len(place) - 1)
    m, own = place[first], text[first]
    return own, h[m].astype(np.int64), m - begin[own], start[first] - begin[own], start[last] - begin[own]


def anchors(raw: bytes, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and place of each anchor of a text, and the first and last window start that it stands for."""
    parts = []
    for at in range(0, max(0, len(raw) - least + 1), SEGMENT - least):
        _, h, *places = anchors_of([raw[at : at + SEGMENT - 1]], least)
        parts.append((h, *(x + at for x in places)))
    return tuple(np.concatenate([p[i] for p in parts]) if parts else NONE for i in range(4))


def anchored(texts: pa.Array, least: int) -> Iterator[tuple[int, list[bytes], tuple[np.ndarray, ...]]]:
    """A column of texts in stretches of up to SEGMENT bytes or one text: the first one's place, the texts, and what ``anchors_of`` gives."""
    held, size, at = [], 0, 0

    def found() -> tuple[np.ndarray, ...]:
        if size < SEGMENT:
            return anchors_of(held, least)
        whole = anchors(held[0], least)  # a long text is alone
        return np.zeros(len(whole[0]), np.int64), *whole

    for i, x in enumerate(texts):
        raw = x.as_buffer()
        if held and size + len(raw) >= SEGMENT:
            yield at, held, found()
            held, size, at = [], 0, i
        held.append(raw.to_pybytes())
        size += len(raw)
    if held:
        yield at, held, found()


def keep_bits(keys: DataFrame, most_bits: int = 1 << 28) -> np.ndarray:
    """Bit table over the longs ``k``, of 16 bits a key up to ``most_bits``; when full it lets more through, never less."""
    n = keys.count()
    bits = min(most_bits, max(1 << 19, 1 << (16 * n).bit_length()))
    schema = pa.schema([("block", pa.int32()), ("v", pa.binary())])

    def fill(t: pa.Table) -> pa.Table:
        v = np.zeros(1 << 19, bool)
        v[t.column("at").to_numpy() & ((1 << 19) - 1)] = True
        return pa.Table.from_batches([batch(schema, [t.column("block")[0].as_py()], [np.packbits(v).tobytes()])])

    at = F.pmod(F.col("k"), F.lit(bits))
    out = np.zeros((bits >> 19, 1 << 16), np.uint8)
    for r in keys.select(F.shiftright(at, 19).cast("int").alias("block"), at.alias("at")).groupBy("block").applyInArrow(fill, "block int, v binary").collect():  # at most 512 blocks of 64 KB
        out[r.block] = np.frombuffer(r.v, np.uint8)
    return out.reshape(-1)


def held(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys.astype(np.int64) % (8 * len(bits))
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def rows_of(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("rid"), text.alias("text"))


def filtered(rows: DataFrame, bits: np.ndarray) -> DataFrame:
    """Rows (rid, text) whose rid may be in the table, texts as bytes."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(held(shared.value, b.column(1).to_numpy())))

    return rows.mapInArrow(tidy(keep), rows.schema)


def shared_anchors(rows: DataFrame, bits: np.ndarray, least: int, buckets: int, hot_anchors: int, chunk: int = 500_000) -> DataFrame:
    """(rid, pos) of the anchors, in rows whose rid may be in the table ``bits``, whose gram occurs in two texts or more;
    for grams with more than ``hot_anchors`` of them a row (hash of the gram, minus their number)."""
    wanted = rows.sparkSession.sparkContext.broadcast(bits)
    schema = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("rids", pa.binary()), ("pos", pa.binary())])
    kind = "bucket int, keys binary, rids binary, pos binary"

    def groups(keys: np.ndarray, rids: np.ndarray, pos: np.ndarray):
        """Order by key; in that order, the groups' starts, and which groups span texts."""
        order = np.argsort(keys, kind="stable")
        keys, rids, pos = keys[order], rids[order], pos[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        several = (np.minimum.reduceat(rids, first) != np.maximum.reduceat(rids, first)) | (np.minimum.reduceat(pos, first) < 0)
        return order, first, np.repeat(several, np.diff(np.append(first, len(order)))), several

    def pack(bucket: int, keys, rids, pos) -> pa.RecordBatch:
        return batch(schema, [bucket], [keys.tobytes()], [rids.tobytes()], [pos.astype(np.int32).tobytes()])

    def flush(parts: list) -> Iterator[pa.RecordBatch]:
        keys, rids, pos = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order, first, known, several = groups(keys, rids, pos)
        number = np.diff(np.append(first, len(order)))[several]
        shared, other, mark = np.sort(order[known]), np.sort(order[~known]), order[first[several]]  # in the texts' order, which packs well
        if len(shared):  # in several texts already: only a marker for each gram is sent
            yield pack(-1 - int(rids[shared[0]] % 1024), NONE, rids[shared], pos[shared])
        keys, rids, pos = np.append(keys[other], keys[mark]), np.append(rids[other], rids[mark]), np.append(pos[other], -number)
        bucket = (keys.astype(U64) % U64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for i in np.flatnonzero(np.diff(ends)):
            own = order[ends[i] : ends[i + 1]]
            yield pack(int(i), keys[own], rids[own], pos[own])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for b in batches:
            b = b.filter(pa.array(held(wanted.value, b.column(1).to_numpy())))
            rids = b.column(1).to_numpy()
            for at, _, (own, key, m, *_) in anchored(b.column(2), least):
                if len(m):
                    parts.append((key, rids[at + own], m))
                    size += len(m)
                if size >= chunk:
                    yield from flush(parts)
                    parts, size = [], 0
        if parts:
            yield from flush(parts)

    out_schema = pa.schema([("rid", pa.int64()), ("pos", pa.int32())])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []

        def done():
            if parts:
                keys, rids, pos = (np.concatenate([p[i] for p in parts]) for i in range(3))
                order, first, known, _ = groups(keys, rids, pos)
                number = np.add.reduceat(np.where(pos < 0, -pos, 1)[order].astype(np.int64), first)
                hot = number > hot_anchors
                keep = np.sort(order[known & (pos[order] >= 0)])
                yield batch(out_schema, np.append(rids[keep], keys[order[first[hot]]]), np.append(pos[keep], -np.minimum(number[hot], 1 << 30)).astype(np.int32))

        for b in batches:
            for i in range(b.num_rows):
                bucket = b.column(0)[i].as_py()
                keys, rids, pos = (np.frombuffer(b.column(c)[i].as_py(), t) for c, t in ((1, np.int64), (2, np.int64), (3, np.int32)))
                if bucket < 0:
                    yield batch(out_schema, rids, pos)
                    continue
                if bucket != now:
                    yield from done()
                    now, parts = bucket, []
                parts.append((keys, rids, pos))
        yield from done()

    return rows.mapInArrow(tidy(find), kind).repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(settle), "rid long, pos int")


class Suffixes:
    """Keys (right part, then left part from the anchor outwards, zero-padded) and what they stand for."""

    def __init__(self, least: int):
        self.right, self.left = least, least - GRAM
        self.width = self.right + self.left

    def cut(self, raw: bytes, m: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Keys of suffixes at m whose windows start lo to hi bytes before it; bytes outside all of these are blank."""
        pad = np.zeros(len(raw) + self.width, np.uint8)
        pad[self.left : self.left + len(raw)] = np.frombuffer(raw, np.uint8)
        keys = np.empty((len(m), self.width), np.uint8)
        keys[:, : self.right] = np.lib.stride_tricks.sliding_window_view(pad, self.right)[m + self.left]
        keys[:, self.right :] = np.lib.stride_tricks.sliding_window_view(pad, self.left)[m][:, ::-1]
        place, lo, hi = (x.astype(np.int16) for x in (np.arange(self.width), lo, hi))  # under the window's length
        keys[((place >= self.right - lo[:, None]) & (place < self.right)) | (place >= self.right + hi[:, None])] = 0
        return keys

    def turn(self, keys: np.ndarray) -> np.ndarray:
        """Gram, left part, rest of the right part."""
        return np.hstack([keys[:, :GRAM], keys[:, self.right :], keys[:, GRAM : self.right]])

    @staticmethod
    def shared_of(keys: np.ndarray) -> np.ndarray:
        """Of sorted keys: the prefix each shares with the one before."""
        lcp = np.zeros(len(keys), np.uint8)
        if len(keys) > 1:
            differ = keys[1:] != keys[:-1]
            at = differ.argmax(1)
            lcp[1:] = np.where(differ[np.arange(len(at)), at], at, keys.shape[1])
        return lcp

    def front_code(self, keys: np.ndarray, first: np.ndarray | None = None) -> tuple[np.ndarray, bytes]:
        """Of sorted keys: shared prefix with the key before, and the rests in one string. ``first``: where runs begin, if there are several."""
        lcp = self.shared_of(keys)
        if first is not None:
            lcp[first] = 0
        return lcp, keys[np.arange(self.width, dtype=np.uint8) >= lcp[:, None]].tobytes()

    def decode(self, lcp: np.ndarray, rests: bytes) -> np.ndarray:
        """Keys of what ``front_code`` gives, also of several runs one behind another."""
        keys = np.zeros((len(lcp), self.width), np.uint8)
        keys[np.arange(self.width, dtype=np.uint8) >= lcp[:, None]] = np.frombuffer(rests, np.uint8)
        rows = np.arange(len(lcp), dtype=np.int32)
        for c in range(int(lcp.max(initial=0))):
            keys[:, c] = keys[np.maximum.accumulate(np.where(lcp <= c, rows, 0)), c]
        return keys


def merge_runs(runs: list[tuple[bytes, list[int]]], width: int) -> np.ndarray:
    """Sorted runs (keys in one string, shared prefixes) as one: rows of run, index and the prefix shared with the row before."""
    size = np.array([len(lcp) for _, lcp in runs], np.int64)
    order, prefix = merged(np.frombuffer(b"".join(k for k, _ in runs), np.uint8).reshape(-1, width))
    run = np.repeat(np.arange(len(runs)), size)[order]
    return np.stack([run, order - (np.cumsum(size) - size)[run], prefix], 1)


def merged(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of keys, given as sorted runs one behind another, and the prefix that each shares with the one before in that order.

    numpy's stable sort of strings finds the runs and merges them, without a step of Python for each key."""
    order = np.argsort(np.ascontiguousarray(keys).view(f"S{keys.shape[1]}").ravel(), kind="stable")
    return order, Suffixes.shared_of(keys[order]).astype(np.int64)


RUN = pa.schema([("range", pa.int32()), ("lcp", pa.binary()), ("rests", pa.binary()), ("rid", pa.binary()), ("doc", pa.binary()), ("m", pa.binary()), ("lo", pa.binary()), ("hi", pa.binary())])
RUN_KIND = "range int, lcp binary, rests binary, rid binary, doc binary, m binary, lo binary, hi binary"
SPANS = pa.schema([("rid", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])
#: Odd numbers that spread the bytes of keys over ranges.
SPREAD = np.random.default_rng(20).integers(1, 1 << 63, 4096, np.uint64) * U64(2) + U64(1)


def window_classes(keys: np.ndarray, prefix: np.ndarray, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, cut: Suffixes, turned: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, j) of the windows j bytes left of their anchor whose bytes also stand in a document of a smaller id.

    ``keys`` are sorted, with the prefix each shares with the one before. A window is a part of the key's first
    ``cut.right`` bytes, told apart by these prefixes, and a part of its side, the bytes after, told apart by theirs."""
    n, side = len(keys), np.ascontiguousarray(keys[:, cut.right :])
    gram = np.cumsum(prefix < GRAM)
    order = np.lexsort((side.view(f"S{cut.left}").ravel(), gram))
    own = side[order]
    differ = own[1:] != own[:-1]
    shared = np.append(-1, np.where(gram[order][1:] != gram[order][:-1], -1, np.where(differ.any(1), differ.argmax(1), cut.left)))
    prefix = np.append(-1, prefix[1:])
    either = lambda same: same | np.append(same[1:], False)
    rows, places, in_side, side_class = [], [], np.zeros(n, bool), np.zeros(n, np.int64)
    for j in range(cut.left + 1):
        same, same_side = (prefix >= GRAM + j, shared >= cut.left - j) if turned else (prefix >= cut.right - j, shared >= j)
        in_side[order] = either(same_side)
        row = np.flatnonzero((lo <= j) & (j <= hi) & in_side & either(same))
        if len(row) < 2:
            continue
        side_class[order] = np.cumsum(~same_side)
        code = np.cumsum(~same)[row] * (n + 1) + side_class[row]
        by = np.argsort(code, kind="stable")
        row, code = row[by], code[by]
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        gone = row[doc[row] > np.repeat(np.minimum.reduceat(doc[row], first), np.diff(np.append(first, len(row))))]
        rows.append(gone)
        places.append(np.full(len(gone), j))
    return (np.concatenate(rows), np.concatenate(places)) if rows else (NONE, NONE)


def spans_of(rid: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Runs of consecutive window starts of each text."""
    order = np.lexsort((start, rid))
    rid, start = rid[order], start[order]
    if not len(rid):
        return batch(SPANS, rid, start, start)
    new = np.append(True, (rid[1:] != rid[:-1]) | (start[1:] > start[:-1] + 1))
    first = np.flatnonzero(new)
    return batch(SPANS, rid[first], start[first], start[np.append(first[1:] - 1, len(start) - 1)])


def repeated_windows(texts: DataFrame, least: int, n_ranges: int, hot: np.ndarray) -> DataFrame:
    """(rid, lo, hi): window starts lo to hi of a text whose bytes also start in a document of a smaller id.

    ``texts``: doc_id, rid, text (bytes), pos (sorted anchors). ``hot``: hashes of the grams that are split."""
    cut = Suffixes(least)
    half = cut.left // 2
    shared_hot = texts.sparkSession.sparkContext.broadcast(np.sort(hot))  # of bounded length

    def suffixes(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        """Keys, rid, doc, place, lo, hi and hash of the anchors asked for, for stretches of texts."""
        doc, rid, pos = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3)
        ends = np.cumsum(np.append(0, pos.value_lengths().to_numpy()))
        pos = pos.flatten().to_numpy().astype(np.int64)
        for at, texts, (own, h, m, first, last) in anchored(b.column(2), least):
            size = ends[at + 1 : at + len(texts) + 1] - ends[at : at + len(texts)]
            asked = np.repeat(np.arange(len(texts)) << 32, size) | pos[ends[at] : ends[at + len(texts)]]
            kept = np.isin(own << 32 | m, asked)
            own, h, m, first, last = (x[kept] for x in (own, h, m, first, last))
            begin = np.cumsum([0, *map(len, texts)])[own]
            yield cut.cut(b"".join(texts), m + begin, m - last, m - first), rid[at + own], doc[at + own], m, m - last, m - first, h

    def range_of(h: np.ndarray) -> np.ndarray:
        return ((mixed(h.astype(U64) ^ U64(0x2545F4914F6CDD1D)) >> U64(32)) * U64(n_ranges) >> U64(32)).astype(np.int64)

    def spread(keys: np.ndarray) -> np.ndarray:
        return range_of(((keys.astype(U64) + U64(1)) * SPREAD[: keys.shape[1]]).sum(1, dtype=U64))

    def dealt(keys, rid, doc, m, lo, hi, h) -> Iterator[tuple]:
        """Sorted suffixes by range, in order: those of hot grams twice, by the bytes after and by the bytes before the gram."""
        at = shared_hot.value
        found = at[np.minimum(np.searchsorted(at, h), len(at) - 1)] == h if len(at) else np.zeros(len(h), bool)

        def by_range(to, *columns) -> tuple:
            order = np.argsort(to, kind="stable")
            return to[order], *(x[order] for x in columns)

        k, r, d, p, a, b, g = (x[~found] for x in (keys, rid, doc, m, lo, hi, h)) if found.any() else (keys, rid, doc, m, lo, hi, h)
        yield by_range(range_of(g), k, r, d, p, a, b)
        if not found.any():
            return
        k, r, d, p, a, b = (x[found & (lo <= half)] for x in (keys, rid, doc, m, lo, hi))
        yield by_range(spread(k[:, : cut.right - half]), k, r, d, p, a, np.minimum(b, half))
        k, r, d, p, a, b = (x[found & (hi > half)] for x in (keys, rid, doc, m, lo, hi))
        k = np.ascontiguousarray(cut.turn(k))
        order = np.lexsort((d, k.view(f"S{cut.width}").ravel()))
        k, r, d, p, a, b = (x[order] for x in (k, r, d, p, a, b))
        yield by_range(n_ranges + spread(k[:, : GRAM + half + 1]), k, r, d, p, np.maximum(a, half + 1), b)

    def cells(data: bytes, ends: np.ndarray) -> pa.Array:
        """``data`` cut at these places."""
        return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data)])

    def sort_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            keys, rid, doc, m, lo, hi, h = (np.concatenate([p[i] for p in parts]) for i in range(7))
            parts.clear()
            order = np.lexsort((doc, keys.view(f"S{cut.width}").ravel()))
            keys, rid, doc, m, lo, hi, h = (x[order] for x in (keys, rid, doc, m, lo, hi, h))
            new = np.append(True, (keys[1:] != keys[:-1]).any(1))
            group = np.cumsum(new) - 1
            best = np.flatnonzero(new)  # least id of each context
            later = doc > doc[best][group]
            wide = (lo[best][group] <= lo) & (hi <= hi[best][group])  # its windows are the same: the shorter text's end may hide some
            row = np.flatnonzero(later & wide)
            if len(row):  # settled here: passed on as a run of range -1
                size = hi[row] - lo[row] + 1
                start = np.repeat(m[row] - hi[row] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                out = spans_of(np.repeat(rid[row], size), start)
                yield batch(RUN, [-1], [b""], [b""], [out.column(0).to_numpy().tobytes()], [b""], [b""], [out.column(1).to_numpy().tobytes()], [out.column(2).to_numpy().tobytes()])
            keep = np.flatnonzero(~(later & wide))
            for to, k, r, d, p, a, b in dealt(*(x[keep] for x in (keys, rid, doc, m, lo, hi, h))):
                if len(to):  # a row for each range, all in one batch
                    first = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
                    ends = np.append(first, len(to))
                    lcp, rests = cut.front_code(k, first)
                    long = np.append(0, np.cumsum(cut.width - lcp.astype(np.int64)))[ends]
                    yield batch(RUN, to[first], cells(lcp.tobytes(), ends), cells(rests, long), *(cells(x.tobytes(), ends * 8) for x in (r, d, p)), *(cells(x.astype(np.uint8).tobytes(), ends) for x in (a, b)))

        size = 0
        for b in batches:
            for some in suffixes(b):
                parts.append(some)
                size += len(some[3])
                if size >= 100_000:
                    yield from flush()
                    size = 0
        if size:
            yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, runs = None, []
        for b in batches:
            for i in range(b.num_rows):
                row = [c[i].as_py() for c in b.columns]
                if row[0] < 0:
                    yield batch(SPANS, *(np.frombuffer(row[c], np.int64) for c in (3, 6, 7)))
                    continue
                if row[0] != now:
                    yield from settle(runs)
                    now, runs = row[0], []
                runs.append(row)
        yield from settle(runs)

    def settle(runs: list) -> Iterator[pa.RecordBatch]:
        """Merge the runs of a range and find the repeated windows."""
        if not runs:
            return
        turned = runs[0][0] >= n_ranges
        keys = cut.decode(np.concatenate([np.frombuffer(r[1], np.uint8) for r in runs]), b"".join(r[2] for r in runs))
        order, prefix = merged(keys)
        keys = keys[order]
        rid, doc, m = (np.concatenate([np.frombuffer(r[c], np.int64) for r in runs])[order] for c in (3, 4, 5))
        lo, hi = (np.concatenate([np.frombuffer(r[c], np.uint8) for r in runs])[order].astype(np.int64) for c in (6, 7))
        first = np.flatnonzero(prefix < GRAM)  # suffixes from here on share their gram
        size = np.diff(np.append(first, len(order)))
        several = np.repeat(np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first), size)
        use = np.flatnonzero(several)
        ends = np.flatnonzero(np.append(prefix[use][1:] < GRAM, True)) + 1 if len(use) else NONE
        at = 0
        while at < len(use):  # whole groups, about 50,000 suffixes at a time
            until = ends[min(np.searchsorted(ends, at + 50_000), len(ends) - 1)]
            own = use[at:until]
            row, j = window_classes(keys[own], prefix[own], doc[own], lo[own], hi[own], cut, turned)
            if len(row):
                yield spans_of(rid[own][row], m[own][row] - j)
            at = until

    runs = texts.select("doc_id", "rid", "text", "pos").mapInArrow(tidy(sort_runs), RUN_KIND)
    to = F.pmod(F.when(F.col("range") < 0, F.xxhash64("rid")).otherwise(F.col("range")), F.lit(n_ranges))
    return runs.withColumn("to", to).repartition(n_ranges, "to").sortWithinPartitions("range").drop("to").mapInArrow(tidy(merge), "rid long, lo long, hi long")


def least_ids(facts: DataFrame, most_hot: int = 1000) -> DataFrame:
    """``facts`` with ``least_id``, the least id of a row's sha. Where a sha has more than one of ``most_hot`` parts of all
    rows, its rows stay where they are."""
    found = materialise(facts.groupBy("sha").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies")).where("copies > 1"))
    bound = facts.count() // most_hot
    hot = F.broadcast(found.where(F.col("copies") > bound).select("sha", F.col("least_id").alias("hot_id"), F.lit(True).alias("hot")))  # at most most_hot rows
    split = facts.join(hot, "sha", "left")
    rest = split.where("hot is null").select(facts.columns).join(found.select("sha", "least_id"), "sha", "left").withColumn("least_id", F.coalesce("least_id", "doc_id"))
    return rest.unionByName(split.where("hot").withColumn("least_id", F.col("hot_id")).select(rest.columns))


def remove_repeats(docs: DataFrame, least: int = 50, bucket_anchors: int = 500_000, range_rows: int = 100_000, hot_anchors: int = 200_000, most_hot: int = 10_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    ``most_hot`` bounds the grams that are split, the most frequent ones of those with over ``hot_anchors``."""
    rows = rows_of(docs)
    facts = materialise(rows.select("doc_id", "rid", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha")))
    marked = materialise(least_ids(facts))
    discard(facts)
    size = marked.where("doc_id = least_id").agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    firsts = keep_bits(marked.where((F.col("doc_id") == F.col("least_id")) & (F.col("n_bytes") >= least)).select(F.col("rid").alias("k")).distinct())
    buckets = max(1, -(-size * 2 // ((least - GRAM + 2) * bucket_anchors)))
    whole = rows.where("doc_id is not null").withColumn("text", F.col("text").cast("binary"))
    found = materialise(shared_anchors(whole, firsts, least, buckets, hot_anchors))
    shared, hot = found.where("pos >= 0"), [r.rid for r in found.where("pos < 0").orderBy("pos", "rid").limit(most_hot).collect()]
    n_ranges = max(1, -(-shared.count() // range_rows))
    places = shared.groupBy("rid").agg(F.collect_list("pos").alias("pos"))
    affected = filtered(whole, keep_bits(shared.select(F.col("rid").alias("k")).distinct()))
    texts = materialise(affected.dropDuplicates(["rid"]).join(places, "rid").select("doc_id", "rid", "text", "pos"))
    discard(found)
    spans = repeated_windows(texts, least, n_ranges, np.array(hot, np.int64)).groupBy("rid").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    schema = pa.schema([("rid", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.string())])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for rid, text, lo, hi in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3), strict=True):
                raw = text.as_py()
                change = np.zeros(len(raw) + 1, np.int64)
                np.add.at(change, lo.values.to_numpy(), 1)
                np.add.at(change, hi.values.to_numpy() + least, -1)
                gone = np.cumsum(change)[:-1] > 0
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                out.append((rid, int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(kept).hexdigest()))
            yield batch(schema, *(zip(*out, strict=True) if out else [[]] * 4))

    edits = texts.join(spans, "rid").select("rid", "text", "lo", "hi").mapInArrow(tidy(remove), "rid long, n_removed long, n_spans long, kept string")
    copy = (F.col("doc_id") > F.col("least_id")) & (F.col("n_bytes") >= least)
    return marked.join(edits, "rid", "left").select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )
