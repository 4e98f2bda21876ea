"""Structured Streaming forms of the incremental batch contracts."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from talentmill.operators.merge import keep_one, merge_latest
from talentmill.sources.tables import read_pointer, write_pointer


def read_landing(spark: SparkSession, path: str, schema: StructType, kind: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).format(kind).load(path)


def stream_ingest(source: DataFrame, target: str, checkpoint: str, keys: list[str], clean: Callable[[DataFrame], DataFrame] = lambda df: df, parts: int = 64, newest: str | None = None):
    """Clean each micro-batch and merge it into a table that is split by a hash of the keys: only parts that the batch touches
    are written anew, the others are pointed to where they are. A batch is known by its number and the checkpoint, so a repeated
    one changes nothing; a new checkpoint goes on from the newest version, which ``read_ingested`` finds. With ``newest`` the row that is greatest in it
    stays, whatever batch it came in; without it the later batch wins, and a hash of the row within a batch."""

    def merge(batch: DataFrame, number: int) -> None:
        spark, name = batch.sparkSession, f"{hashlib.sha1(checkpoint.encode()).hexdigest()[:8]}-{number:09d}"
        known = _manifest(spark, target)
        if name in known["batches"][-1000:]:
            return
        new = clean(batch).withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")).persist()
        touched = sorted(r[0] for r in new.select("_part").distinct().collect())  # at most ``parts``
        before = {p: known["parts"][str(p)] for p in touched if str(p) in known["parts"]}
        fresh = keep_one(new, keys, [F.col(newest).desc_nulls_last()] if newest else [])
        old = spark.read.schema(new.schema).parquet(*before.values()) if before else None
        if old is None:
            merged = fresh
        else:
            merged = keep_one(old.unionByName(fresh), keys, [F.col(newest).desc_nulls_last()]) if newest else merge_latest(old, fresh, keys)
        run = f"{target}/{name}-{uuid.uuid4().hex[:8]}"
        merged.withColumn("_folder", F.col("_part")).repartition("_folder").write.partitionBy("_folder").parquet(run)
        new.unpersist()
        places = known["parts"] | {str(p): f"{run}/_folder={p}" for p in touched}
        write_pointer(spark, f"{target}/manifest", json.dumps({"parts": places, "batches": [*known["batches"][-999:], name]}))

    return source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _manifest(spark: SparkSession, target: str) -> dict:
    found = read_pointer(spark, f"{target}/manifest")
    return json.loads(found) if found else {"parts": {}, "batches": []}


def read_ingested(spark: SparkSession, target: str) -> DataFrame | None:
    """The newest version of a table that ``stream_ingest`` keeps; None before the first batch."""
    places = _manifest(spark, target)["parts"]
    return spark.read.parquet(*places.values()).drop("_part") if places else None


def stream_dedupe(source: DataFrame, key: str, ts: str, lateness: str = "1 day") -> DataFrame:
    """One row an id within bounded lateness."""
    return source.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])


def stream_daily(source: DataFrame, ts: str, lateness: str = "1 day") -> DataFrame:
    """Counts per day; a day is given out once its watermark has passed."""
    return source.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness).groupBy(F.window(ts, "1 day").alias("w")).agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "n")


class HealthState(StatefulProcessor):
    """Consecutive failures of a source since its last success, in the order of event time.

    Rows wait in the state until the watermark has passed them, so that batches may deal them in any order within the
    lateness; a timer at the latest of them lets go what no further batch would."""

    def __init__(self, limits: dict[str, int], default: int):
        self.limits, self.default = limits, default

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fails = handle.getValueState("fails", "fails long, reason string")
        self.waiting = handle.getListState("waiting", "ms long, us long, seq long, ok boolean, reason string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        fresh = []
        for pdf in rows:
            us = pdf["ts"].astype("datetime64[us]").astype("int64")
            reasons = pdf["reason"].astype(object).where(pdf["reason"].notna(), None)
            fresh += [(int(u) // 1000, int(u), int(s), bool(o), r) for u, s, o, r in zip(us, pdf["seq"], pdf["ok"], reasons, strict=True)]
        self.waiting.appendList(fresh)
        self.handle.registerTimer(max(r[0] for r in fresh) + 1)
        yield from self.let_go(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self.let_go(key, timerValues.getCurrentWatermarkInMs())

    def let_go(self, key, watermark: int) -> Iterator[pd.DataFrame]:
        held = list(self.waiting.get()) if self.waiting.exists() else []
        ready = sorted((r for r in held if r[0] < watermark), key=lambda r: (r[1], r[2]))
        if not ready:
            return
        fails, reason = self.fails.get() if self.fails.exists() else (0, None)
        for row in ready:
            fails, reason = (0, reason) if row[3] else (fails + 1, row[4])
        self.fails.update((fails, reason))
        left = [tuple(r) for r in held if r[0] >= watermark]
        self.waiting.put(left) if left else self.waiting.clear()
        yield pd.DataFrame({"source": [key[0]], "fail_count": [fails], "last_reason": [reason], "is_active": [fails < self.limits.get(reason, self.default)]})

    def close(self) -> None:
        pass


def stream_health(source: DataFrame, limits: dict[str, int] | None = None, default: int = 3, lateness: str = "1 hour") -> DataFrame:
    """Health of each source up to the watermark, whenever that has passed rows of it (needs the RocksDB state store). ``source``: source, ts,
    seq, ok, reason; rows later than ``lateness`` behind the latest are dropped."""
    processor = HealthState(limits or {"permanent": 2, "temporary": 5}, default)
    timed = source.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return timed.groupBy("source").transformWithStateInPandas(processor, f"source {source.schema['source'].dataType.simpleString()}, fail_count long, last_reason string, is_active boolean", "Update", "EventTime")
