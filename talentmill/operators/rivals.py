"""Which rows may share a key with another: a first look that moves six bytes a key instead of rows.

Keys are hashes. Tasks send each hash at most twice of a million, sorted by buckets of bounded size; those that a bucket holds more than once
become a table of bits. Equal hashes of different keys, and bits that several hashes share, let more rows through, never fewer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentmill.sources.shared import remove, stored

#: Hashes of a bucket, and of a task at a time; bits of the table at most, and of a block of it.
BUCKET, CHUNK, MOST_BITS, PER = 1_000_000, 1_000_000, 1 << 28, 1 << 19
HASH_BITS = 48


def key_hash(*parts: Column) -> Column:
    return F.xxhash64(*parts).bitwiseAND(F.lit((1 << HASH_BITS) - 1))


def met_twice(hashes: DataFrame, buckets: int) -> DataFrame:
    """(h): what the only column, of hashes without nulls, holds more than once."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0

        def flush() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(parts), return_counts=True)
            h = np.repeat(h, np.minimum(n, 2))
            bucket = h % buckets
            order = np.argsort(bucket, kind="stable")
            h, bucket = h[order], bucket[order]
            first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            ends = np.append(first, len(h)).astype(np.int64)
            cut = lambda x: pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((ends * x.itemsize).astype(np.int32).tobytes()), pa.py_buffer(x.tobytes())])
            return pa.RecordBatch.from_arrays([pa.array(bucket[first], pa.int64()), cut((h & 0xFFFFFFFF).astype("<u4")), cut((h >> 32).astype("<u2"))], names=["bucket", "low", "high"])

        for b in batches:
            parts.append(b.column(0).to_numpy())
            size += b.num_rows
            if size >= CHUNK:
                yield flush()
                parts, size = [], 0
        if size:
            yield flush()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []

        def several() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.int64), np.zeros(0))
            return pa.RecordBatch.from_arrays([pa.array(h[n > 1], pa.int64())], names=["h"])

        for b in batches:
            for bucket, low, high in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bucket != now:
                    yield several()
                    now, parts = bucket, []
                parts.append(np.frombuffer(high, "<u2").astype(np.int64) << 32 | np.frombuffer(low, "<u4"))
        yield several()

    sent = hashes.mapInArrow(send, "bucket long, low binary, high binary")
    return sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(find, "h long")


def bit_table(hashes: DataFrame) -> np.ndarray:
    """Packed bits at the places of the hashes: 16 bits a hash up to MOST_BITS, made in blocks."""
    bits = min(MOST_BITS, max(PER, 1 << (16 * hashes.count()).bit_length()))

    def fill(t: pa.Table) -> pa.Table:
        v = np.zeros(PER, bool)
        v[t.column("at").to_numpy() % PER] = True
        return pa.table({"block": pa.array([t.column("block")[0].as_py()], pa.int32()), "v": pa.array([np.packbits(v).tobytes()], pa.binary())})

    at = F.col("h") % bits
    out = np.zeros((bits // PER, PER // 8), np.uint8)
    for r in hashes.select(F.floor(at / PER).cast("int").alias("block"), at.alias("at")).groupBy("block").applyInArrow(fill, "block int, v binary").collect():  # at most 512 blocks of 64 KB
        out[r["block"]] = np.frombuffer(r["v"], np.uint8)
    return out.reshape(-1)


def may_have_rivals(df: DataFrame, hashes: list[Column]) -> Column:
    """Condition over rows of ``df``: one of the hashes, of which null binds nothing, may be met in the table again."""
    each = df.select(F.explode(F.array_compact(F.array(*hashes))).alias("h"))
    found = stored(met_twice(each, df.count() * len(hashes) // BUCKET + 1), "rivals")
    shared = df.sparkSession.sparkContext.broadcast(bit_table(found))  # of bounded size
    remove(found)

    @F.arrow_udf("boolean")
    def held(h: pa.Array) -> pa.Array:
        bits, at = shared.value, h.fill_null(0).to_numpy(zero_copy_only=False) % (8 * len(shared.value))
        there = (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
        return pa.array(there & h.is_valid().to_numpy(zero_copy_only=False))

    condition = F.lit(False)
    for h in hashes:
        condition = condition | held(h)
    return condition
