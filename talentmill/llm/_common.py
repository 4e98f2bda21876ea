"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
_WORKER: dict[tuple, Any] = {}


def scratch(spark: SparkSession) -> str:
    """A fresh path below ``spark.checkpoint.dir``; a temporary folder only for local masters without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _LOCAL.setdefault("root", tempfile.mkdtemp(prefix="talentmill-"))
    return f"{root.rstrip('/')}/talentmill-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, so that later jobs neither recompute it nor depend on executors that held it."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def strings(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Column as Python strings, null as empty."""
    return [x or "" for x in column.to_pylist()]


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def worker_cache(operator: str, key: object, make: Callable[[], Any]) -> Any:
    """What this Python worker keeps for an operator: one value, made on first use. Workers are reused, so the value of
    the operator or the parameters before is given back first."""
    if (operator, key) not in _WORKER:
        release()
        _WORKER[operator, key] = make()
    return _WORKER[operator, key]


def release() -> None:
    """Give back what this worker keeps."""
    if _WORKER:
        _WORKER.clear()
        trim()


def trim() -> None:
    """Return freed memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over batches that returns its freed memory when it ends: workers wait for their next task with little."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        trim()

    return run


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with as many underscores added as no other column, in any case of letters, has."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote, once all that is made of them is written itself."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            spark = df.sparkSession
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
            if path.getName().startswith("talentmill-"):
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
