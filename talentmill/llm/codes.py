"""Compression of vectors to product codes by cover-tree Lloyd (operator 11).

Vectors become integers, are cut into equal parts, and each part position has a codebook of its own. Every task cuts its
rows into chunks and builds, once, a cover tree over the distinct parts of each chunk and position: the children of a
node lie within a smaller radius of it, siblings farther apart, and points are stored in the order of the tree, so that a
subtree is a range whose sum and count are differences of cumulative ones. The trees are a stored table. A round
walks each tree downwards for all nodes of a level at once: entries that are farther from a node's point than the nearest
entry by more than twice the node's radius serve none of its points (triangle inequality). Where one entry is left, the whole
subtree is its own; only the points of leaves that stay ambiguous are compared one by one, in integers, ties to the
lower index. Tasks hand on sums by position and entry; the driver gets positions times entries of them, and no more.

Edge cases: null vectors, those with null or non-finite components, empty ones and those whose length is not the commonest
one that the number of parts divides are left out; scaled components are held within +-2^27, where distances are exact; repeated rows count each; rows with
a null id come last among the smallest ids, of equal ids the smaller vector comes first; with fewer rows than entries the codebook is as
short; null labels are one group; an empty table gives an empty result; other columns are kept by ``compress``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentmill.llm._common import discard, free_name, materialise
from talentmill.llm._vectors import matrix, quoted, scaled, usable

BOUND = 1 << 27
#: Rows of a chunk, points of a leaf, and by how much radii shrink from level to level.
CHUNK, LEAF, SHRINK = 8192, 24, 1.6
#: Labels up to which their sums are broadcast.
BROADCAST_ROWS = 100_000

Codebooks = list[list[list[int]]]


class CoverTree:
    """Points (distinct, in the tree's order), how often each occurs, and nodes as ranges of points with radius and children."""

    def __init__(self, points: np.ndarray, times: np.ndarray, nodes: np.ndarray, radius: np.ndarray):
        self.points, self.times, self.nodes, self.radius = points, times, nodes, radius
        self.sums = np.vstack([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points * times[:, None], axis=0)])
        self.counts = np.concatenate([[0], np.cumsum(times)])

    @classmethod
    def build(cls, rows: np.ndarray) -> tuple[CoverTree, np.ndarray]:
        """The tree of the rows, and at which of its points each row is."""
        points, place, times = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        exact = points.astype(float)
        order, nodes, radius = np.arange(len(points)), [[0, len(points), 0, 0]], []
        for node in nodes:  # grows while it is walked
            lo, hi = node[:2]
            own = order[lo:hi]
            far = np.sqrt(((exact[own] - exact[own[0]]) ** 2).sum(1))
            radius.append(far.max())
            if hi - lo <= LEAF or not radius[-1]:
                continue
            groups, reach = [], radius[-1] / SHRINK
            while len(own):
                near = far <= reach
                near[0] = True  # a child's own point comes first
                groups.append(own[near])
                own = own[~near]
                if len(own):
                    far = np.sqrt(((exact[own] - exact[own[0]]) ** 2).sum(1))
            order[lo:hi] = np.concatenate(groups)
            ends = lo + np.cumsum([len(g) for g in groups])
            node[2:] = len(nodes), len(groups)
            nodes.extend([int(end - len(g)), int(end), 0, 0] for g, end in zip(groups, ends, strict=True))
        at = np.empty(len(points), np.int64)
        at[order] = np.arange(len(points))
        return cls(points[order], times[order], np.array(nodes, np.int64), np.array(radius)), at[place.ravel()]

    def nearest(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(nodes, their entries, points, their entries): whole subtrees, and the points that had to be compared."""
        level, allowed = np.zeros(1, np.int64), np.ones((1, len(entries)), bool)
        whole, of_whole, single, of_single = [], [], [], []
        while len(level):
            lo, hi, first, n = self.nodes[level].T
            d = np.sqrt(((self.points[lo][:, None] - entries) ** 2).sum(2).astype(float))
            d[~allowed] = np.inf
            bound = (d.min(1) + 2 * self.radius[level]) * (1 + 1e-9) + 1e-6  # above what rounding can take away
            allowed = d <= bound[:, None]
            clear = allowed.sum(1) == 1
            whole.append(level[clear])
            of_whole.append(allowed[clear].argmax(1))
            leaf = ~clear & (n == 0)
            points = spread(lo[leaf], (hi - lo)[leaf])
            single.append(points)
            of_single.append(((self.points[points][:, None] - entries) ** 2).sum(2).argmin(1))
            inner = ~clear & (n > 0)
            level, allowed = spread(first[inner], n[inner]), np.repeat(allowed[inner], n[inner], axis=0)
        return np.concatenate(whole), np.concatenate(of_whole), np.concatenate(single), np.concatenate(of_single)

    def add_to(self, entries: np.ndarray, total: np.ndarray) -> None:
        """Adds (count, sums) of each entry's points to the rows of ``total``."""
        whole, of_whole, single, of_single = self.nearest(entries)
        lo, hi = self.nodes[whole, 0], self.nodes[whole, 1]
        np.add.at(total, of_whole, np.column_stack([self.counts[hi] - self.counts[lo], self.sums[hi] - self.sums[lo]]))
        np.add.at(total, of_single, np.column_stack([self.times[single], self.points[single] * self.times[single, None]]))

    def assign(self, entries: np.ndarray) -> np.ndarray:
        """The entry of each point."""
        whole, of_whole, single, of_single = self.nearest(entries)
        out = np.empty(len(self.points), np.int64)
        lo, hi = self.nodes[whole, 0], self.nodes[whole, 1]
        out[spread(lo, hi - lo)] = np.repeat(of_whole, hi - lo)
        out[single] = of_single
        return out

    def pack(self) -> list[bytes]:
        return [self.points.astype(np.int32).tobytes(), self.times.astype(np.int32).tobytes(), self.nodes.astype(np.int32).tobytes(), self.radius.tobytes()]

    @classmethod
    def unpack(cls, parts: list[bytes], width: int) -> CoverTree:
        ints = [np.frombuffer(p, np.int32).astype(np.int64) for p in parts[:3]]
        return cls(ints[0].reshape(-1, width), ints[1], ints[2].reshape(-1, 4), np.frombuffer(parts[3]))


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each range, one after another."""
    return np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)


def chunks(rows: DataFrame, parts: int, width: int, column: str) -> DataFrame:
    """Chunks of rows: ``kept`` (an array of the other columns' values), ``trees`` (four buffers for each part position) and
    ``places`` (the point of each row in each of its trees)."""
    others = [c for c in rows.columns if c != column]
    spec = "array<struct<" + ", ".join(f"{quoted(c)}: {t}" for c, t in rows.dtypes if c != column) + ">>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def one(group: pa.Table) -> pa.RecordBatch:
            x = matrix(group.column(column).combine_chunks(), parts * width)
            trees = [CoverTree.build(x[:, p * width : (p + 1) * width]) for p in range(parts)]
            kept = pa.StructArray.from_arrays([group.column(c).combine_chunks() for c in others], fields=[group.schema.field(c) for c in others])
            columns = [pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), kept), pa.array([[b for t, _ in trees for b in t.pack()]], pa.list_(pa.binary())), pa.array([np.vstack([at for _, at in trees]).astype(np.int32).tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["kept", "trees", "places"])

        for b in batches:
            held, n = [*held, b], n + b.num_rows
            while n >= CHUNK:
                table = pa.Table.from_batches(held)
                yield one(table.slice(0, CHUNK))
                held, n = table.slice(CHUNK).to_batches(), n - CHUNK
        if n:
            yield one(pa.Table.from_batches(held))

    return rows.mapInArrow(run, f"kept {spec}, trees array<binary>, places binary")


def unpacked(trees: list[bytes], width: int) -> list[CoverTree]:
    return [CoverTree.unpack(trees[i : i + 4], width) for i in range(0, len(trees), 4)]


def refine(table: DataFrame, books: Codebooks, rounds: int) -> Codebooks:
    """Codebooks after so many rounds: each entry goes to the floor of its parts' mean, unused ones stay."""
    parts, width = len(books), len(books[0][0])
    for _ in range(rounds):
        entries = [np.array(b, np.int64) for b in books]

        def run(batches: Iterator[pa.RecordBatch], entries=entries) -> Iterator[pa.RecordBatch]:
            total = np.zeros((parts, len(entries[0]), 1 + width), np.int64)
            for b in batches:
                for trees in b.column(0):
                    for p, tree in enumerate(unpacked(trees.as_py(), width)):
                        tree.add_to(entries[p], total[p])
            used = np.argwhere(total[:, :, 0] > 0)
            values = [total[p, e] for p, e in used]
            yield pa.RecordBatch.from_arrays([pa.array(used[:, 0], pa.int32()), pa.array(used[:, 1], pa.int32()), *(pa.array([int(v[i]) for v in values], pa.int64()) for i in range(1 + width))], names=names)

        names = ["part", "entry", *(f"s{i}" for i in range(1 + width))]
        each = table.select("trees").mapInArrow(run, "part int, entry int, " + ", ".join(f"s{i} long" for i in range(1 + width)))
        for r in each.groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in names[2:])).collect():
            books[r["part"]][r["entry"]] = [r[c] // r["s0"] for c in names[3:]]
    return books


def assign(table: DataFrame, books: Codebooks) -> DataFrame:
    """Rows of the chunks with ``code`` (two hex digits a part) and ``error``."""
    parts, width, entries = len(books), len(books[0][0]), [np.array(b, np.int64) for b in books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                kept = b.column(0).slice(i, 1).flatten()
                places = np.frombuffer(b.column(2)[i].as_py(), np.int32).reshape(parts, -1)
                codes, error = np.empty((places.shape[1], parts), np.uint8), np.zeros(places.shape[1], np.int64)
                for p, tree in enumerate(unpacked(b.column(1)[i].as_py(), width)):
                    of_point = tree.assign(entries[p])
                    codes[:, p] = of_point[places[p]]
                    error += ((tree.points - entries[p][of_point]) ** 2).sum(1)[places[p]]
                yield pa.RecordBatch.from_arrays([*kept.flatten(), pa.array([c.tobytes().hex() for c in codes]), pa.array(error)], names=[*kept.type.names, "code", "error"])

    kept = table.schema["kept"].dataType.elementType
    fields = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in kept)
    return table.mapInArrow(run, f"{fields}, code string, error long")


def fit(table: DataFrame, seeds: list[list[int]], parts: int, rounds: int) -> Codebooks:
    width = len(seeds[0]) // parts
    return refine(table, [[s[p * width : (p + 1) * width] for s in seeds] for p in range(parts)], rounds)


def compress(df: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, vector: str = "embedding", key: str = "vec_id") -> tuple[DataFrame, Codebooks]:
    """(usable rows of ``df`` without the vector, with last columns ``code`` and ``error``; the codebooks). At most 256 entries."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part")
    kept, length = usable(df, vector, parts)
    x, names = free_name("x", df.columns), [free_name(n, df.columns) for n in ("code", "error")]
    rows = kept.withColumn(x, scaled(F.col(vector), scale, BOUND)).drop(vector)
    seeds = [r[x] for r in rows.orderBy(F.col(key).asc_nulls_last(), x).select(x).limit(entries).collect()]
    if not seeds:
        return rows.drop(x).withColumns({names[0]: F.lit(None).cast("string"), names[1]: F.lit(None).cast("long")}), []
    inside = rows.select(*(F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(rows.columns)))  # names that cannot clash
    table = materialise(chunks(inside, parts, length // parts, f"c{len(rows.columns) - 1}"))
    books = fit(table, seeds, parts, rounds)
    coded = materialise(assign(table, books))
    discard(table)
    return coded.toDF(*rows.columns[:-1], *names), books


def digest(books: Codebooks) -> str:
    return hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()


def report(df: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256."""
    coded, books = compress(df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label"))
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    few = sums.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    both = coded.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("of")))
    return both.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
