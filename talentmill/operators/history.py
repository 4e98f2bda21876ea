"""Histories of content, kept as edits: a snapshot writes only keys whose change points it moves.

The table is a folder of two versioned ones. ``edits`` has rows (key, at, hash, columns, gone, edit): a change point, or that one is none any
more; the latest edit of a key and time counts. ``seen`` has what was observed when (key, at, hash), and is read only for the
changed keys of a snapshot that came late. After any sequence of snapshots, late and repeated ones included, the change
points are those of ``merge.change_points`` over all observations."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talentmill.operators.merge import keep_one
from talentmill.sources import versions
from talentmill.sources.shared import stored


def fingerprint(columns: list[str]) -> Column:
    """Hash of a row's content in which null and blank differ."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def change_points(spark: SparkSession, root: str, key: str, number: int | None = None) -> DataFrame | None:
    """(key, at, hash, columns) of every change, as of a version of the edits; None before the first snapshot."""
    edits = versions.read(spark, f"{root}/edits", number)
    if edits is None:
        return None
    last = Window.partitionBy(key, "at").orderBy(F.desc("edit"))
    return edits.withColumn("_k", F.row_number().over(last)).where("_k = 1 AND NOT gone").drop("_k", "gone", "edit")


def intervals(spark: SparkSession, root: str, key: str) -> DataFrame | None:
    """The change points as versions, each valid until the next of its key, the last one open."""
    points = change_points(spark, root, key)
    if points is None:
        return None
    return points.withColumnRenamed("at", "valid_from").withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy(key).orderBy("valid_from")))


def merge_snapshot(snapshot: DataFrame, root: str, key: str, at: Any, columns: list[str]) -> int:
    """Merge what was seen at the time ``at`` (a value of any ordered type); number of changed keys.

    Of rows of one key the first by a hash counts; rows of a null key are left out; a snapshot of the same time adds only keys that it lacked. A
    run that dies before it has written ``seen`` is merged again with the same result."""
    spark = snapshot.sparkSession
    new = keep_one(snapshot.where(F.col(key).isNotNull()).select(key, F.lit(at).alias("at"), fingerprint(columns).alias("hash"), *columns), [key], [])
    before, seen = change_points(spark, root, key), versions.read(spark, f"{root}/seen")
    number = len(versions.numbers(spark, f"{root}/edits"))
    if seen is not None:
        new = new.join(seen.where(F.col("at") == F.lit(at)).select(key), key, "left_anti")
    new = stored(new, "snapshot")
    if before is None:
        edits = new.withColumn("gone", F.lit(False))
    else:
        edits = _edits(new, before, seen if seen is not None else new.limit(0), key, at, columns)
    edits = stored(edits.withColumn("edit", F.lit(number)), "edits")
    changed = edits.select(key).distinct().count()
    if changed:
        versions.append(edits, f"{root}/edits")
    versions.append(new.select(key, "at", "hash"), f"{root}/seen")
    return changed


def _edits(new: DataFrame, before: DataFrame, seen: DataFrame, key: str, at: Any, columns: list[str]) -> DataFrame:
    point = F.struct("at", "hash", *columns)
    late = F.col("at") > F.lit(at)
    around = before.join(new.select(key), key, "left_semi").groupBy(key).agg(F.max(F.when(~late, F.col("at"))).alias("_a"), F.max_by(F.when(~late, point), F.when(~late, F.col("at"))).alias("prev"), F.min_by(F.when(late, point), F.when(late, F.col("at"))).alias("next"))
    changed = new.join(around, key, "left").where(F.col("prev").isNull() | (F.col("prev.hash") != F.col("hash")))
    following = seen.where(late).join(changed.select(key), key, "left_semi").groupBy(key).agg(F.min_by(F.struct("at", "hash"), "at").alias("then"))
    rows = changed.join(following, key, "left")
    edit = lambda row, time, gone: F.struct(time.alias("at"), row["hash"].alias("hash"), *(row[c].alias(c) for c in columns), F.lit(gone).alias("gone"))
    own = F.struct("hash", *columns)
    moved = F.when(F.col("then.at") == F.col("next.at"), F.when(F.col("next.hash") == F.col("hash"), edit(F.col("next"), F.col("next.at"), True)))  # the next one repeats the new content
    back = F.when(F.col("then").isNotNull() & (F.col("next").isNull() | (F.col("then.at") < F.col("next.at"))), edit(F.col("prev"), F.col("then.at"), False))  # the content before comes again
    each = F.array_compact(F.array(edit(own, F.lit(at), False), moved, back))
    return rows.select(key, F.explode(each).alias("e")).select(key, "e.*")
