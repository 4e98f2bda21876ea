"""Jaccard self-join of word shingles, and its classes (operator 3).

Size-aware heavy-light join. Documents with equal shingle sets are one set from the start.

Light (small) sets, up to a boundary size, enumerate their subsets of fixed sizes: two of them
with enough overlap share a subset of the size that the larger one demands. Heavy (large) sets
scan inverted lists: elements are ordered by rarity, and two sets with enough overlap share an
element in their prefixes. Light sets near the boundary also enter the lists, since heavy ones may
match them. The boundary is the largest size for which enumerating subsets costs no more than
scanning the lists of a prefix; list lengths come from a frequency sketch of fixed width over all
documents, which also orders the elements.

Lists of at most ``near`` + 1 sets give all pairs that pass the size and position filters. Longer
lists take three steps, each of which is verified before the next. In stars, every set of a list meets
one of it, another one in each of a few turns. Then blocks meet blocks: a list is dealt by size and
hash into blocks of about BLOCK sets, and those of like sizes are compared. The first time they give
a forest, pairs that join the classes found so far as far as the filters can tell; the second time,
all pairs that pass the filters and whose ends are still in different classes. So large groups of
copies give few pairs, and no link between classes is lost. Lists that hold a great part of all
entries are known from counts of each task and take these steps at once; no list, however long, is
sorted or counted in one task.

Before any set is moved, a parity sketch of ODD bits drops pairs: each element that only one of two
sets has flips one bit, so the sketches' distance never exceeds the sets'. What is left is verified
exactly on the whole sets. Shingles and sets are 64-bit hashes.

Edge cases: a null or wordless text has an empty set, no links and its own id as class; a very long
text is one set, held by one task at a time; equal sizes and elements of equal rarity are ordered by
their hashes, classes are named by the least id; null ids take part (their class is null if no id is
reachable); repeated rows are one set; an empty table gives an empty result; other columns are kept by
``one_of_each``, whatever their names, and ignored elsewhere.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talentmill.llm._common import batch, discard, materialise, strings, text_or_empty, tidy, worker_cache
from talentmill.llm.components import components

U64 = np.uint64
MOST_LIGHT = 40
BLOCK = 1024
ODD = 1024


class WordHashes(dict):
    """word -> hash, for the first ``room`` words of at most ``longest`` bytes."""

    room, longest = 250_000, 40

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.room and len(word) <= self.longest:
            self[word] = h
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(29))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(32))


def shingles(text: str, k: int) -> np.ndarray:
    """Sorted distinct hashes of a text's k-word shingles; with fewer words, of the whole sequence. A-Z are lower-cased."""
    words = text.encode().lower().split()  # of bytes: A-Z, and blanks 9 to 13 and 32
    if not words:
        return np.zeros(0, U64)
    ids = np.fromiter(map(worker_cache("jaccard", None, WordHashes).__getitem__, words), U64, len(words))
    k = min(k, len(words))
    n = len(words) - k + 1
    h = np.full(n, k, U64)
    for j in range(k):
        h = mixed(h * U64(0x9E3779B97F4A7C15) + ids[j : j + n])
    return np.unique(h)


def set_key(h: np.ndarray) -> int:
    """Key of a set as a signed long."""
    return int((mixed(h ^ U64(0x5851F42D4C957F2D)).sum() + U64(len(h))).astype(np.int64)) if len(h) else 0


@dataclass(frozen=True)
class Bounds:
    """Similarity of at least num / den, and what follows from it."""

    num: int
    den: int

    def least_overlap(self, size: int) -> int:
        """Any partner of a set shares at least so many elements with it."""
        return -(-size * self.num // self.den)

    def prefix(self, size: int) -> int:
        return size - self.least_overlap(size) + 1

    def subset_sizes(self, size: int) -> range:
        """Sizes of subsets that the set shares with partners of its size and above, up to the largest possible."""
        return range(self.least_overlap(size), self.least_overlap(size * self.den // self.num) + 1)

    def light(self, list_length: float) -> int:
        """Boundary: the largest size up to which subsets cost no more than lists."""
        size = 0
        while size < MOST_LIGHT and sum(comb(size + 1, c) for c in self.subset_sizes(size + 1)) <= self.prefix(size + 1) * max(1.0, list_length):
            size += 1
        return size


def rarity(docs: DataFrame, k: int, width: int) -> np.ndarray:
    """Frequency sketch: how many sets have an element in each of ``width`` hash buckets, over all documents.

    Each task sends one vector, in blocks; sums are taken in two levels, so that no task reads more than
    a few MB a block for any number of tasks."""
    per = 1 << 14
    shift = U64(64 - width.bit_length() + 1)
    schema = pa.schema([("block", pa.int32()), ("part", pa.int64()), ("v", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.uint32)
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                held = [shingles(t, k) >> shift for t in strings(b.column(0).slice(at, 1024))]
                np.add.at(total, np.concatenate(held).astype(np.int64), 1)
        parts = total.astype("<u4").reshape(-1, min(per, width))
        yield batch(schema, np.arange(len(parts)), [TaskContext.get().partitionId()] * len(parts), [zlib.compress(p.tobytes(), 1) for p in parts])  # mostly noughts

    def add(t: pa.Table) -> pa.Table:
        v = np.zeros(min(per, width), np.int64)
        for x in t.column("v"):
            v += np.frombuffer(zlib.decompress(x.as_py()), "<u4")
        out = zlib.compress(np.minimum(v, (1 << 32) - 1).astype("<u4").tobytes(), 1)
        return pa.Table.from_batches([batch(schema, [t.column("block")[0].as_py()], [0], [out])])

    kind = "block int, part long, v binary"
    parts = docs.select(text_or_empty()).mapInArrow(tidy(count), kind).withColumn("part", F.floor(F.col("part") / 256))
    sums = parts.groupBy("block", "part").applyInArrow(add, kind).groupBy("block").applyInArrow(add, kind)
    found = {r.block: np.frombuffer(zlib.decompress(r.v), "<u4") for r in sums.collect()}  # width numbers
    return np.concatenate([found[i] for i in sorted(found)]) if found else np.zeros(width, "<u4")


def list_length(sketch: np.ndarray) -> float:
    """Length of the list that an element drawn from a document meets, less chance collisions of buckets."""
    total, squares = float(sketch.sum(dtype=np.float64)), 0.0
    for part in np.array_split(sketch, -(-len(sketch) // (1 << 16))):  # the driver holds no second copy
        v = part.astype(np.float64)
        squares += float(v @ v)
    return max(1.0, squares / total - total / len(sketch)) if total else 1.0


def signatures(docs: DataFrame, k: int, bounds: Bounds, sketch: np.ndarray, light: int) -> DataFrame:
    """doc_id, n, sid and, as packed longs, subset keys of light sets and prefix elements of the others."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)  # of fixed width
    shift = U64(64 - len(sketch).bit_length() + 1)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("sid", pa.int64()), ("subsets", pa.binary()), ("prefix", pa.binary()), ("odd", pa.binary())])
    listed = bounds.least_overlap(light + 1)

    def subset_keys(h: np.ndarray) -> bytes:
        each = mixed(h ^ U64(0x2545F4914F6CDD1D))
        out, total = [], each.sum()
        for c in bounds.subset_sizes(len(h)):
            left = [*combinations(range(len(h)), len(h) - c)]
            sums = total - each[np.array(left)].sum(1) if len(h) > c else np.array([total])
            out.append(mixed(sums ^ U64(c)))
        return np.concatenate(out).astype(np.int64).tobytes()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = shared.value
        for b in (whole.slice(at, 1024) for whole in batches for at in range(0, whole.num_rows, 1024)):
            sizes, keys, subsets, prefixes, odd = [], [], [], [], []
            for t in strings(b.column(1)):
                h = shingles(t, k)
                n = len(h)
                sizes.append(n)
                keys.append(set_key(h))
                odd.append(np.packbits((np.bincount((h & U64(ODD - 1)).astype(np.int64), minlength=ODD) & 1).astype(bool)).tobytes())
                subsets.append(subset_keys(h) if 0 < n <= light else b"")
                if n >= listed and n:
                    rare = seen[h >> shift]
                    p = bounds.prefix(n)
                    if p < n // 2:
                        cut = np.flatnonzero(rare <= np.partition(rare, p - 1)[p - 1])
                        h, rare = h[cut], rare[cut]
                    prefixes.append(h[np.lexsort((h, rare))[:p]].astype(np.int64).tobytes())
                else:
                    prefixes.append(b"")
            yield batch(schema, b.column(0), sizes, keys, subsets, prefixes, odd)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(tidy(sign), "doc_id long, n int, sid long, subsets binary, prefix binary, odd binary")


def postings(sets: DataFrame) -> DataFrame:
    """key, sid, n, pos (-1 for subsets) of each entry of the inverted lists."""
    schema = pa.schema([("key", pa.int64()), ("sid", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                sid, n = b.column(0).to_numpy(), b.column(1).to_numpy()
                for column, first in ((2, None), (3, 0)):
                    raw = [x.as_py() for x in b.column(column)]
                    counts = np.array([len(x) // 8 for x in raw], np.int64)
                    if counts.sum():
                        begins = np.repeat(np.cumsum(counts) - counts, counts)
                        pos = np.arange(counts.sum()) - begins if first == 0 else np.full(counts.sum(), -1)
                        yield batch(schema, np.frombuffer(b"".join(raw), np.int64), np.repeat(sid, counts), np.repeat(n, counts), pos.astype(np.int32))

    return sets.select("sid", "n", "subsets", "prefix").mapInArrow(tidy(spread), "key long, sid long, n int, pos int")


def heavy_keys(sets: DataFrame, total: int, part: int = 2000, chunk: int = 500_000) -> DataFrame:
    """Keys that hold more than one of ``part`` parts of all ``total`` entries, fewer than ``part``: by counts of chunks,
    of which only those that are great for their chunk are sent. One that is missed costs time, no pair."""
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64())])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0

        def great() -> pa.RecordBatch:
            keys, n = np.unique(np.frombuffer(b"".join(rows), np.int64), return_counts=True)
            many = n > max(16, size // (32 * part))
            return batch(schema, keys[many], n[many])

        for b in batches:
            for column in b.columns:
                for x in column:
                    rows.append(x.as_py())
                    size += len(rows[-1])
                    if size >= 8 * chunk:
                        yield great()
                        rows, size = [], 0
        yield great()

    counts = sets.select("subsets", "prefix").mapInArrow(tidy(local), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return materialise(counts.where(F.col("n") * part > total).select("key"))


def possible(bounds: Bounds, light: int, n1, p1, n2, p2):
    """May two sets match whose first common element is at these places of their prefixes (arrays)?"""
    left = np.minimum(n1 - np.maximum(p1, 0), n2 - np.maximum(p2, 0)).astype(np.int64)
    fits = left * (bounds.num + bounds.den) >= bounds.num * (n1.astype(np.int64) + n2)
    return fits & ((p1 < 0) | (np.maximum(n1, n2) > light))  # two light sets meet by subsets


NONE = np.zeros(0, np.int64)
PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])
FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("sid", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])


def scan_lists(entries: DataFrame, bounds: Bounds, light: int, near: int) -> DataFrame:
    """Candidate pairs (a, b) of lists of at most near + 1 sets, and the entries (key, sid, n, pos) of longer ones."""
    order = Window.partitionBy("key").orderBy("n", "sid")
    ranked = entries.select("key", "sid", "n", "pos", (F.row_number().over(order) - 1).cast("long").alias("at"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 5  # the last rows of the batch before
        for b in batches:
            old = len(held[0])
            key, sid, n, pos, at = rows = [np.concatenate([x, c.to_numpy()]) for x, c in zip(held, b.columns, strict=True)]
            first, second = [NONE], [NONE]
            for d in range(1, near + 1):
                two = np.flatnonzero(key[d:] == key[:-d]) + d if len(key) > d else NONE
                if not len(two):
                    break
                two = two[(two >= old) & (at[two] <= near)]
                two = two[possible(bounds, light, n[two - d], pos[two - d], n[two], pos[two])]
                first.append(sid[two - d])
                second.append(sid[two])
            x, y = np.concatenate(first), np.concatenate(second)
            yield batch(FOUND, np.minimum(x, y), np.maximum(x, y), *[pa.nulls(len(x), f.type) for f in [*FOUND][2:]])
            fresh = np.arange(old, len(key))
            turn = fresh[at[fresh] == near + 1]  # here a list turns out to be long: the rows before follow
            long = np.append((turn[:, None] - np.arange(near + 1, -1, -1)).ravel(), fresh[at[fresh] > near + 1])
            yield batch(FOUND, *[pa.nulls(len(long), pa.int64())] * 2, key[long], sid[long], n[long].astype(np.int32), pos[long].astype(np.int32))
            held = [x[-near - 1 :] for x in rows]

    return ranked.mapInArrow(tidy(scan), "a long, b long, key long, sid long, n int, pos int")


def close(bounds: Bounds, n1, odd1, n2, odd2) -> np.ndarray:
    """May sets of these sizes match, by their parity sketches (rows of longs)?"""
    apart = np.bitwise_count(odd1 ^ odd2).sum(1, dtype=np.int64)
    return apart * (bounds.num + bounds.den) <= (bounds.den - bounds.num) * (n1.astype(np.int64) + n2)


def longs(column: pa.Array) -> np.ndarray:
    """Binary values of ODD bits as rows of longs."""
    return np.frombuffer(b"".join(x.as_py() for x in column), U64).reshape(-1, ODD // 64)


def prune(pairs: DataFrame, sets: DataFrame, bounds: Bounds) -> DataFrame:
    """Pairs (a, b) that the sketches allow."""
    side = lambda c: sets.select(F.col("sid").alias(c), F.col("n").alias(f"n_{c}"), F.col("odd").alias(f"odd_{c}"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = close(bounds, b.column(2).to_numpy(), longs(b.column(3)), b.column(4).to_numpy(), longs(b.column(5)))
            yield b.select([0, 1]).filter(pa.array(ok))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "odd_a", "n_b", "odd_b").mapInArrow(tidy(keep), "a long, b long")


def if_few(table: DataFrame, most: int = 500_000) -> DataFrame:
    """``table``, written once, with a broadcast hint if it has at most ``most`` rows; so rows of a hot key stay where they are."""
    table = materialise(table)
    return F.broadcast(table) if table.count() <= most else table


def with_roots(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """Entries of long lists with the classes found so far, but for lists of one class."""
    own = entries.join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    several = own.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    return own.join(if_few(several), "key", "left_semi")


def stars(own: DataFrame, bounds: Bounds, turn: int) -> DataFrame:
    """Pairs of one set of each list and every other one of another class and possible size."""
    centre = own.groupBy("key").agg(F.min_by(F.struct("sid", "n", "root"), F.xxhash64("sid", F.lit(turn))).alias("c"))
    both = own.join(if_few(centre), "key").where("c.root <> root").where(F.least("n", "c.n") * bounds.den >= F.greatest("n", "c.n") * bounds.num)
    return both.select(F.least("sid", "c.sid").alias("a"), F.greatest("sid", "c.sid").alias("b")).distinct()


def scan_blocks(own: DataFrame, sets: DataFrame, bounds: Bounds, light: int, forest: bool) -> DataFrame:
    """Pairs of long lists that pass the filters and whose ends are in different classes, in pairs of blocks of
    like sizes. ``forest``: only as many as join those classes, were all of them links."""
    step = log(bounds.den / bounds.num * (1 + 1e-6)) if bounds.num < bounds.den else 1e-6  # partners are in the same band or the next
    banded = own.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / step))
    order = Window.partitionBy("key").orderBy("band")  # of bands, of which a list has a bounded number
    bands = banded.groupBy("key", "band").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    beside = lambda c, k: F.when(c(F.col("band")).over(order) == F.col("band") + k, c(F.col("blocks")).over(order)).otherwise(0)
    bands = bands.select("key", "band", "blocks", beside(F.lag, -1).alias("below"), beside(F.lead, 1).alias("above"))
    placed = banded.join(if_few(bands), ["key", "band"]).withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")))
    name = lambda k, block: F.struct((F.col("band") + k).alias("band"), block.alias("block"))
    numbers = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>"))
    blocks_of = lambda c, k: F.transform(numbers(F.col(c)), lambda i: name(k, i))  # noqa: E731  (a second parameter of the inner one would be the place in the array)
    others = F.concat(blocks_of("blocks", 0), blocks_of("below", -1), blocks_of("above", 1))
    dealt = placed.withColumn("mine", name(0, F.col("block"))).withColumn("other", F.explode(others)).join(sets.select("sid", "odd"), "sid")
    meet = F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))
    side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
    dealt = dealt.select(meet.alias("meet"), side.alias("side"), "n", "sid", "pos", "root", "odd")

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [*[NONE] * 6, np.zeros((0, ODD // 64), U64)]  # the last two blocks that meet
        joined: dict[int, int] = {}  # of classes of this task, for the forest

        def find(x: int) -> int:
            while x in joined:
                x = joined[x]
            return x

        for b in batches:
            old = len(held[0])
            now = [*(c.to_numpy() for c in b.columns[:6]), longs(b.column(6))]
            meet, side, n, sid, pos, root, odd = rows = [np.concatenate([x, c]) for x, c in zip(held, now, strict=True)]
            label = np.array([find(x) for x in root.tolist()], np.int64) if joined else root.copy()
            for d in range(1, len(meet)):
                same = meet[d:] == meet[:-d]
                if not same.any():
                    break
                second = np.flatnonzero(same & (label[d:] != label[:-d]) & ((side[d:] != side[:-d]) | (side[d:] == 0))) + d
                second = second[second >= old]
                second = second[possible(bounds, light, n[second - d], pos[second - d], n[second], pos[second])]
                second = second[close(bounds, n[second - d], odd[second - d], n[second], odd[second])]
                if forest and len(second):
                    chosen = []
                    for i in second.tolist():
                        x, y = find(int(label[i - d])), find(int(label[i]))
                        if x != y:
                            joined[max(x, y)] = min(x, y)
                            chosen.append(i)
                    second = np.array(chosen, np.int64)
                    label = np.array([find(x) for x in label.tolist()], np.int64) if chosen else label
                if len(second):
                    x, y = sid[second - d], sid[second]
                    yield batch(PAIR, np.minimum(x, y), np.maximum(x, y))
            held = [x[np.searchsorted(meet, meet[-1]) :] if len(meet) else x for x in rows]

    return dealt.repartition("meet").sortWithinPartitions("meet", "n", "sid").mapInArrow(tidy(cross), "a long, b long").distinct()


PROBES = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9))


def places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """Three places of each key (long) in a table of so many bits, a power of two."""
    return [((mixed(keys.astype(U64) * p)) & U64(bits - 1)).astype(np.int64) for p in PROBES]


class MayHold:
    """Bloom filter of longs: true for all that were put in, and for few others until it is full."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        found = [(self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1 for at in places(keys, 8 * len(self.bits))]
        return found[0] & found[1] & found[2]

    @classmethod
    def of(cls, keys: DataFrame, most_bits: int = 1 << 28) -> MayHold:
        """Of the column of longs of ``keys``, with 16 bits a key up to ``most_bits``; made in blocks of 64 KB."""
        n, per = keys.count(), 1 << 19
        bits = min(most_bits, max(per, 1 << (16 * n).bit_length()))
        schema = pa.schema([("block", pa.int32()), ("v", pa.binary())])
        place = pa.schema([("block", pa.int32()), ("at", pa.int32())])

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = np.concatenate(places(b.column(0).to_numpy(), bits))
                yield batch(place, (at // per).astype(np.int32), (at % per).astype(np.int32))

        def fill(t: pa.Table) -> pa.Table:
            v = np.zeros(per, bool)
            v[t.column("at").to_numpy()] = True
            return pa.Table.from_batches([batch(schema, [t.column("block")[0].as_py()], [np.packbits(v, bitorder="little").tobytes()])])

        out = np.zeros((bits // per, per // 8), np.uint8)
        found = keys.mapInArrow(tidy(spread), "block int, at int").distinct()
        for r in found.groupBy("block").applyInArrow(fill, "block int, v binary").collect():  # at most 512 blocks
            out[r.block] = np.frombuffer(r.v, np.uint8)
        return cls(out.reshape(-1))


def whole_sets(needed: DataFrame, docs: DataFrame, sets: DataFrame, k: int) -> DataFrame:
    """(sid, h): the sets that are needed, made again from the texts of one document each."""
    ids = needed.join(sets.select("sid", "doc"), "sid").select(F.xxhash64("doc").alias("k")).distinct()
    wanted = docs.sparkSession.sparkContext.broadcast(MayHold.of(ids))  # of bounded size; lets others through, never fewer
    schema = pa.schema([("sid", pa.int64()), ("h", pa.binary())])

    def remake(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(wanted.value(b.column(0).to_numpy())))
            for some in (b.slice(i, 512) for i in range(0, b.num_rows, 512)):
                h = [shingles(t, k) for t in strings(some.column(1))]
                yield batch(schema, [set_key(x) for x in h], [x.tobytes() for x in h])

    rows = docs.select(F.xxhash64(F.col("doc_id").cast("long")).alias("at"), text_or_empty().alias("text")).mapInArrow(tidy(remake), "sid long, h binary")
    return materialise(rows.join(needed, "sid", "left_semi").dropDuplicates(["sid"]))


def verify(pairs: DataFrame, whole: DataFrame, bounds: Bounds) -> DataFrame:
    """Pairs whose whole sets are similar enough, with overlap and union size. Only sets of pairs are moved."""
    pairs = materialise(pairs)
    n, ends = pairs.count(), {c: pairs.select(c).distinct() for c in ("a", "b")}
    if not n:
        return pairs.select("a", "b", F.lit(0).cast("long").alias("overlap"), F.lit(0).cast("long").alias("total"))
    x, y = (whole.select(F.col("sid").alias(c), F.col("h").alias(h)).join(F.broadcast(ends[c]) if n <= 500_000 else ends[c], c, "left_semi") for c, h in (("a", "x"), ("b", "y")))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
    link = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("overlap", pa.int64()), ("total", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, (x, y) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                x, y = np.frombuffer(x.as_py(), U64), np.frombuffer(y.as_py(), U64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                if common * (bounds.num + bounds.den) >= bounds.num * (len(x) + len(y)):
                    rows.append((b.column(0)[i].as_py(), b.column(1)[i].as_py(), common, len(x) + len(y) - common))
            yield batch(link, *(zip(*rows, strict=True) if rows else [[]] * 4))

    return materialise(both.mapInArrow(tidy(compare), "a long, b long, overlap long, total long"))


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose ends are in different classes so far."""
    side = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r_{c}"))
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return both.where(F.coalesce("r_a", "a") != F.coalesce("r_b", "b")).select("a", "b")


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, width: int = 1 << 21, near: int = 8, turns: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the least id reachable over pairs of similarity num / den or more."""
    bounds = Bounds(num, den)
    sketch = rarity(docs, k, width)
    light = bounds.light(list_length(sketch))
    signed = materialise(signatures(docs, k, bounds, sketch, light))
    sets = materialise(signed.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("subsets").alias("subsets"), F.first("prefix").alias("prefix"), F.first("odd").alias("odd")))
    entries = postings(sets)
    total = sets.agg(F.coalesce(F.sum(F.octet_length("subsets") + F.octet_length("prefix")), F.lit(0)) / 8).first()[0]
    heavy = F.broadcast(heavy_keys(sets, int(total)))  # fewer than 2000 keys
    scanned = materialise(scan_lists(entries.join(heavy, "key", "left_anti"), bounds, light, near))
    pairs = materialise(prune(scanned.where("a is not null").select("a", "b").distinct(), sets, bounds))
    long = materialise(scanned.where("a is null").select("key", "sid", "n", "pos").unionByName(entries.join(heavy, "key", "left_semi").select("key", "sid", "n", "pos")))
    discard(scanned)
    needed = materialise(pairs.select(F.explode(F.array("a", "b")).alias("sid")).unionByName(long.select("sid")).distinct())
    whole = whole_sets(needed, docs, sets, k)
    roots = components(verify(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), whole, bounds))  # a pair for each set first

    def take(found: DataFrame) -> None:
        """Verify pairs and join the classes of those that hold."""
        nonlocal roots
        more = verify(found, whole, bounds)
        if not more.isEmpty():
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more.select("a", "b")))

    take(apart(pairs, roots))
    for turn in range(turns):
        if long.isEmpty():
            break
        take(prune(stars(with_roots(long, roots), bounds, turn), sets, bounds))
    for forest in (True, False) if not long.isEmpty() else ():
        take(scan_blocks(with_roots(long, roots), sets, bounds, light, forest))
    discard(pairs, long, needed, whole)
    classes = sets.select("sid", "doc").join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    least = classes.groupBy("root").agg(F.min("doc").alias("component_id"))
    named = classes.join(least, "root").select("sid", "component_id")
    full = signed.where("n > 0").join(named, "sid").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    return full.unionByName(signed.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each class, that of the least id; rows without an id stay, equal rows become one.

    Only rows whose id goes or repeats, as far as a table of bits can tell, are moved for that."""
    ids = docs.select(F.col("doc_id").cast("long").alias("other_id"))
    found = near_duplicates(docs.select("doc_id", "text"), **options)
    others = materialise(found.where("doc_id <> component_id").select(F.col("doc_id").alias("other_id")).distinct())
    repeated = ids.groupBy("other_id").count().where("count > 1").select("other_id")
    doubtful = docs.sparkSession.sparkContext.broadcast(MayHold.of(others.unionByName(repeated).select(F.xxhash64("other_id").alias("k"))))  # of bounded size

    @F.arrow_udf("boolean")
    def in_doubt(keys: pa.Array) -> pa.Array:
        return pa.array(doubtful.value(keys.to_numpy()))

    doubt = in_doubt(F.xxhash64(F.col("doc_id").cast("long")))
    some = docs.where(doubt)
    settled = some.join(others, some["doc_id"].cast("long") == others["other_id"], "left_anti").dropDuplicates(["doc_id", "text"])
    return docs.where(~doubt).unionByName(settled)
