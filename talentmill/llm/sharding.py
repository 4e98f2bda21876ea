"""Balanced shards through fixed virtual slots (operator 4).

Every record hashes into one of ``n_slots`` virtual slots; only bytes and rows per slot are
aggregated (a table of ``n_slots`` rows, whatever the input). A versioned map from slots to
shards is built from those sums, and edited, not rebuilt, when loads or the number of shards
change: ``rebalance`` moves as few slots as it needs and raises the version.

Placement needs no shuffle of texts: the map is a broadcast of ``n_slots`` rows. Positions in a
shard come from counts per slot and a window inside each slot, so that no task sees a whole shard.
Rows of one id and text fall into one slot; where they are more than a slot's share of all rows, a
number of the row, written down before, deals them over all slots. Groups of equal texts are not kept
together, which law ``bytes`` would forbid if one had more than a shard's share.

The map is stored as a table with a folder for each version, which is written once. A run without one
stores version 1 and places by what it reads back; a run that finds one edits the newest version for the
loads it measures and stores the next.

Edge cases: a null text has size ``overhead`` and checksum 0; null ids hash like any value; very long
texts count like others; equal rows have places of their own in any order, slots of equal weight go by
number; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talentmill.llm._common import materialise, scratch, text_or_empty


@dataclass(frozen=True)
class SlotMap:
    """Version, number of shards and the shard of each virtual slot."""

    version: int
    n_shards: int
    shards: tuple[int, ...]

    def loads(self, weights: list[int]) -> list[int]:
        out = [0] * self.n_shards
        for slot, shard in enumerate(self.shards):
            out[shard] += weights[slot]
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """(version, vslot, shard), the form in which the map is stored."""
        return spark.createDataFrame([(self.version, i, s) for i, s in enumerate(self.shards)], "version int, vslot int, shard int")

    def store(self, spark: SparkSession, path: str) -> None:
        """Add this version below ``path``; fails if it is there."""
        self.table(spark).drop("version").coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={self.version}")

    @classmethod
    def stored(cls, spark: SparkSession, path: str) -> SlotMap | None:
        """The newest version below ``path``, if there is any."""
        try:
            found = spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return cls.read(found)

    @classmethod
    def read(cls, table: DataFrame, version: int | None = None) -> SlotMap:
        """The newest version, or the one asked for, of a stored map."""
        at = version if version is not None else table.agg(F.max("version")).first()[0]
        rows = table.where(F.col("version") == at).orderBy("vslot").collect()
        return cls(at, max(r.shard for r in rows) + 1, tuple(r.shard for r in rows))


def first_map(weights: list[int], n_shards: int) -> SlotMap:
    """Heaviest slot first onto the lightest shard."""
    heap = [(0, s) for s in range(n_shards)]
    shards = [0] * len(weights)
    for slot in sorted(range(len(weights)), key=lambda i: (-weights[i], i)):
        load, shard = heapq.heappop(heap)
        shards[slot] = shard
        heapq.heappush(heap, (load + weights[slot], shard))
    return SlotMap(1, n_shards, tuple(shards))


def rebalance(old: SlotMap, weights: list[int], n_shards: int | None = None, tolerance: float = 0.01) -> SlotMap:
    """Edit the map: new shards are filled from the fullest ones, then single slots move until
    no shard is more than ``tolerance`` over the mean or no move helps."""
    n = max(n_shards or old.n_shards, old.n_shards)
    shards, edited = list(old.shards), replace(old, n_shards=n)
    loads, mean = edited.loads(weights), sum(weights) / n
    members: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for slot, shard in enumerate(shards):
        members[shard].append((weights[slot], slot))
    for m in members:
        m.sort()
    for _ in range(len(shards)):
        full, light = max(range(n), key=loads.__getitem__), min(range(n), key=loads.__getitem__)
        gap = min(loads[full] - mean, mean - loads[light]) if loads[light] < mean else 0
        if loads[full] <= mean * (1 + tolerance) and loads[light] >= mean * (1 - tolerance):
            break
        fits = [x for x in members[full] if 0 < x[0] <= max(gap, (loads[full] - loads[light]) / 2)]
        if not fits:
            break
        moved = fits[-1]
        members[full].remove(moved)
        members[light] = sorted([*members[light], moved])
        loads[full] -= moved[0]
        loads[light] += moved[0]
        shards[moved[1]] = light
    return SlotMap(old.version + 1, n, tuple(shards))


def measured(docs: DataFrame, n_slots: int, overhead: int) -> DataFrame:
    """doc_id, size, text_crc32 and virtual slot of each row; texts go no further."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long") + overhead).alias("size"),
        F.crc32(text_or_empty().cast("binary")).alias("text_crc32"),
    ).withColumn("vslot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(n_slots)).cast("int"))


def slot_weights(rows: DataFrame, n_slots: int) -> list[tuple[int, int]]:
    """(bytes, rows) of each virtual slot: n_slots pairs."""
    out = [(0, 0)] * n_slots
    for r in rows.groupBy("vslot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
        out[r.vslot] = (r.b, r.n)
    return out


def spread_repeats(rows: DataFrame, weights: list[tuple[int, int]], n_slots: int, least: int = 1000) -> DataFrame | None:
    """Rows with repeats of an id and text, if they fill a slot, dealt over all slots; None if there are none."""
    share = sum(n for _, n in weights) // n_slots
    full = [i for i, (_, n) in enumerate(weights) if n > max(least, 4 * share)]
    if not full:
        return None
    key = ["doc_id", "text_crc32"]
    many = rows.where(F.col("vslot").isin(full)).groupBy(*key).count().where(F.col("count") > max(least, share)).select(*(F.col(c).alias(f"_{c}") for c in key), F.lit(True).alias("many"))  # at most n_slots rows
    own = materialise(rows.withColumn("number", F.monotonically_increasing_id()))
    both = own.join(F.broadcast(many), F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_crc32") == F.col("_text_crc32")), "left")
    dealt = F.pmod(F.xxhash64(*key, "number"), F.lit(n_slots)).cast("int")
    return both.withColumn("vslot", F.when(F.col("many"), dealt).otherwise(F.col("vslot"))).select(rows.columns)


def assign_shards(docs: DataFrame, n_shards: int = 24, n_slots: int = 4096, overhead: int = 8, map_path: str | None = None, least: int = 1000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (gapless in its shard from 0), grown_shard, vslot, map_version.

    Sizes of shards are near equal (law ``bytes``). ``map_path`` is where the map is kept; without it, it is a
    fresh table in the shared folder."""
    spark, path = docs.sparkSession, map_path or scratch(docs.sparkSession)
    rows = measured(docs, n_slots, overhead)
    weights = slot_weights(rows, n_slots)
    split = spread_repeats(rows, weights, n_slots, least)
    if split is not None:
        rows, weights = split, slot_weights(split, n_slots)
    in_bytes, old = [b for b, _ in weights], SlotMap.stored(spark, path)
    (rebalance(old, in_bytes, n_shards) if old else first_map(in_bytes, n_shards)).store(spark, path)
    used = SlotMap.stored(spark, path)
    begin, placed = [0] * used.n_shards, []
    for vslot, shard in enumerate(used.shards):
        placed.append((vslot, shard, begin[shard]))
        begin[shard] += weights[vslot][1]
    table = F.broadcast(spark.createDataFrame(placed, "vslot int, shard int, begins long"))  # n_slots rows
    inside = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("at", F.row_number().over(inside) - 1)
        .join(table, "vslot")
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("begins") + F.col("at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot", F.lit(used.version).alias("map_version"))
    )
