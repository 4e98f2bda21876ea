"""Connected components of an edge table, by local forests, minimum labels and pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentmill.llm._common import batch, materialise, tidy

EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def forest(edges: DataFrame, chunk: int) -> DataFrame:
    """Edges (a, b) with the same components: of each ``chunk`` edges of a task, every node and the least of its component there."""

    def stars(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        up = [*range(len(names))]
        for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
            while up[x] != x:
                up[x] = x = up[up[x]]
            while up[y] != y:
                up[y] = y = up[up[y]]
            up[max(x, y)] = min(x, y)
        root = np.array(up, np.int64)
        while len(root) and (root[root] != root).any():
            root = root[root]
        leaf = np.flatnonzero(root != np.arange(len(root)))
        return batch(EDGE, names[leaf], names[root[leaf]])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for whole in batches:
            for at in range(0, whole.num_rows, chunk):
                b = whole.slice(at, chunk)
                held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
                size += b.num_rows
                if size >= chunk:
                    yield stars(*map(np.concatenate, zip(*held, strict=True)))
                    held, size = [], 0
        if held:
            yield stars(*map(np.concatenate, zip(*held, strict=True)))

    return edges.mapInArrow(tidy(local), "a long, b long")


def components(edges: DataFrame, chunk: int = 200_000) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b): root is the least node of its component.

    Tasks first put stars in the place of their edges, ``chunk`` of them at a time, so that few rounds are left. Each round takes
    the least label among neighbours, then the label of that label, and is written to the shared folder, so that plans stay flat and
    lost executors cost one round at most.

    Edges with a null end and self-loops count for nothing, so a node that has no others is not in the result; repeated
    and reversed edges count once; an empty table gives an empty result; other columns are ignored."""
    pairs = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    ends = F.array(*(F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in (("a", "b"), ("b", "a"), ("a", "a"), ("b", "b"))))
    both = materialise(forest(pairs, chunk).select(F.explode(ends).alias("e")).select("e.a", "e.b").distinct())  # a node is beside itself
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("low"), F.max(F.when(F.col("a") == F.col("b"), F.col("root"))).alias("old"))
        of_low = labels.select(F.col("node").alias("low"), F.col("root").alias("above"))
        after = materialise(near.join(of_low, "low", "left").select("node", F.coalesce(F.least("low", "above"), "low").alias("new"), "old"))
        labels = after.select("node", F.col("new").alias("root"))
        if after.where("new <> old").isEmpty():
            return labels
