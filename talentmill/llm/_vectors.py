"""Integer vectors from float columns, shared by the operators on embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def usable(df: DataFrame, vector: str = "embedding", multiple: int = 1) -> tuple[DataFrame, int]:
    """Rows whose vector has only finite components, and the commonest length among them that ``multiple`` divides
    (the shorter of equally common ones; 0 if there is none). Null and empty vectors and those of another length are left out."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = df.where(v.isNotNull() & (F.size(v) > 0) & (F.size(v) % multiple == 0)).where(finite)
    top = kept.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    length = top[0]["n"] if top else 0
    return kept.where(F.size(v) == length), length


def scaled(vector: Column, scale: int, bound: int) -> Column:
    """floor(scale * x) of each component as int, held within +-``bound``."""
    return F.transform(vector, lambda x: F.greatest(F.lit(-bound), F.least(F.lit(bound), F.floor(x.cast("double") * float(scale)))).cast("int"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column without nulls as a matrix of 64-bit integers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def task_sums(df: DataFrame, add: Callable[[np.ndarray], np.ndarray], vector: str, width: int, kind: str) -> list:
    """Element-wise sums, over all rows of ``vector``, of the arrays that ``add`` makes of a batch's matrix.

    Each task adds up its batches and hands on one array, whose elements are then summed by position: what is moved
    grows with the tasks and the array, what is collected with the array alone. ``kind``: "long" (exact) or "double"."""
    arrow = pa.int64() if kind == "long" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                one = add(matrix(b.column(0), width))
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], type=pa.list_(arrow))], ["sums"])

    each = df.select(vector).mapInArrow(run, f"sums array<{kind}>").select(F.posexplode("sums").alias("at", "v"))
    value = F.col("v").cast("decimal(38,0)") if kind == "long" else F.col("v")
    rows = each.groupBy("at").agg(F.sum(value).alias("v")).collect()
    return [int(r["v"]) if kind == "long" else r["v"] for r in sorted(rows, key=lambda r: r["at"])]
