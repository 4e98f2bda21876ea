"""Approximate vector search by an inverted file with residual codes.

Centroids are trained on a bounded sample. The index is a folder: ``settings`` (one row), ``centroids``, and ``entries``, a table
partitioned by list with each vector's id, the code of its residual (its difference from the list's centroid, one byte a dimension) and
the vector itself. Rows are dealt to files by range over (list, hash of the id), so that a list with a large share of
all rows is spread over many files; ``append`` adds rows to the same lists.

A search meets only lists near a query and reads only codes there: each task multiplies the decoded block with the queries that
probe its list and hands on a bounded number of candidates a query. Candidates of all tasks are ranked, and only this
shortlist fetches vectors for exact scores. How many lists are probed is measured when the index is built: the least number that finds the wanted
share of true neighbours within the sample. Ids are unique long integers; rows without an id or vector are left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentmill.operators.blocks import Best, rows_of
from talentmill.operators.vector import dot, query_blocks, top_k
from talentmill.sources.shared import scratch

#: Bytes of vectors, as doubles, that training may fetch; and lists an index may have.
SAMPLE_BYTES, MOST_LISTS = 64 << 20, 4096
#: Rows of a shortlist, over all queries of a block, up to which it is broadcast.
BROADCAST_ROWS = 500_000
#: Lists up to which a scan names those it needs.
NAMED_LISTS = 512


@dataclass(frozen=True)
class Index:
    folder: str
    centroids: np.ndarray
    step: np.ndarray
    probes: int

    def entries(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("vec_id long, code binary, unit array<double>, list int").parquet(f"{self.folder}/entries")

    def sizes(self, spark: SparkSession) -> dict[int, int]:
        """Rows of each list."""
        return {r["list"]: r["count"] for r in self.entries(spark).groupBy("list").count().collect()}


def unit_rows(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def lloyd(sample: np.ndarray, lists: int, rounds: int) -> np.ndarray:
    """Centroids of unit vectors by the largest product; a list without vectors gets the one that its own centroid fits least."""
    centroids = sample[np.linspace(0, len(sample) - 1, lists).astype(int)]
    for _ in range(rounds):
        fit = sample @ centroids.T
        own = fit.argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        empty = np.bincount(own, minlength=lists) == 0
        sums[empty] = sample[np.argsort(fit.max(1), kind="stable")[: empty.sum()]]
        centroids = unit_rows(sums)
    return centroids


def probes_for(sample: np.ndarray, centroids: np.ndarray, k: int, recall: float, asked: int = 256) -> int:
    """The least number of lists in which ``asked`` sample vectors find the share ``recall`` of their ``k`` nearest others in the sample."""
    asked = min(asked, len(sample))
    near = sample[:asked] @ sample.T
    near[np.arange(asked), np.arange(asked)] = -np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return len(centroids)
    found = np.argpartition(-near, k - 1, axis=1)[:, :k]
    order = np.argsort(-(sample[:asked] @ centroids.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1, kind="stable")  # rank of each list for each asked vector
    at = np.take_along_axis(place, (sample @ centroids.T).argmax(1)[found], axis=1)
    return int(np.quantile(at.ravel(), recall, method="higher")) + 1


def build(items: DataFrame, folder: str | None = None, lists: int | None = None, k: int = 10, recall: float = 0.95, rounds: int = 10, sample_bytes: int = SAMPLE_BYTES, files: int | None = None) -> Index:
    """Train on a sample of ``items`` (vec_id, unit) of at most ``sample_bytes`` and index every row."""
    spark = items.sparkSession
    rows = items.where("vec_id is not null and unit is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("unit").cast("array<double>").alias("unit"))
    counted = rows.agg(F.count("*").alias("n"), F.max(F.size("unit")).alias("width")).first()
    if not counted["n"]:
        raise ValueError("no vectors to index")
    lists = min(MOST_LISTS, lists or max(1, round(counted["n"] ** 0.5)), counted["n"])
    bound = max(lists, sample_bytes // (8 * counted["width"]))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(bound).select("unit").toArrow().column("unit").combine_chunks()
    sample = rows_of(sample, counted["width"])
    centroids = lloyd(sample, lists, rounds)
    residual = np.abs(sample - centroids[(sample @ centroids.T).argmax(1)]).max(0)
    step = np.where(residual > 0, residual, 1.0) / 127
    probes = probes_for(sample, centroids, k, recall)
    folder = folder or scratch(spark, "index")
    spark.createDataFrame([(i, c) for i, c in enumerate(centroids.tolist())], "list int, centroid array<double>").coalesce(1).write.parquet(f"{folder}/centroids")
    spark.createDataFrame([(json.dumps({"probes": probes, "step": step.tolist()}),)], "value string").coalesce(1).write.text(f"{folder}/settings")
    index = Index(folder, centroids, step, probes)
    append(index, rows, files)
    return index


def load(spark: SparkSession, folder: str) -> Index:
    rows = spark.read.parquet(f"{folder}/centroids").orderBy("list").collect()
    settings = json.loads(spark.read.text(f"{folder}/settings").first()[0])
    return Index(folder, np.array([r["centroid"] for r in rows]), np.array(settings["step"]), settings["probes"])


def append(index: Index, items: DataFrame, files: int | None = None) -> None:
    """Add rows (vec_id, unit) to the lists of their nearest centroids; ``files`` asks for so many ranges of rows instead of as many as their size needs."""
    centroids, step = index.centroids, index.step

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = rows_of(b.column(1), centroids.shape[1])
            own = (x @ centroids.T).argmax(1)
            codes = np.clip(np.rint((x - centroids[own]) / step), -127, 127).astype(np.int8)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), b.column(1), pa.array(own, pa.int32())], names=["vec_id", "code", "unit", "list"])

    rows = items.where("vec_id is not null and unit is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("unit").cast("array<double>").alias("unit"))
    coded = rows.mapInArrow(run, "vec_id long, code binary, unit array<double>, list int")
    ranges = ["list", F.xxhash64("vec_id")]
    dealt = coded.repartitionByRange(files, *ranges) if files else coded.repartitionByRange(*ranges)
    dealt.sortWithinPartitions("list").write.mode("append").partitionBy("list").parquet(f"{index.folder}/entries")


def probed(index: Index, queries: np.ndarray, probes: int) -> np.ndarray:
    """The nearest lists of each query."""
    fit = queries @ index.centroids.T
    return np.argsort(-fit, axis=1, kind="stable")[:, :probes]


def shortlist(index: Index, spark: SparkSession, names: list, queries: np.ndarray, probes: int, n: int, kind: str) -> DataFrame:
    """(query_id, list, vec_id): the ``n`` best candidates of each query by codes."""
    lists = probed(index, queries, probes)
    asks = {int(x): np.nonzero((lists == x).any(1))[0] for x in np.unique(lists)}
    centroids, step = index.centroids, index.step
    entries = index.entries(spark).select("list", "vec_id", "code")
    if len(asks) <= NAMED_LISTS:
        entries = entries.where(F.col("list").isin(list(asks)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(queries), n)
        for b in batches:
            own, ids, codes = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)
            for x in np.unique(own):
                which = asks.get(int(x))
                if which is not None:
                    here = np.nonzero(own == x)[0]
                    block = np.frombuffer(b"".join(codes.take(pa.array(here)).to_pylist()), np.int8).reshape(len(here), -1)
                    best.score_all(ids[here], block * step + centroids[x], queries, which, tag=int(x))
        yield pa.RecordBatch.from_pydict({"query_id": [names[q] for q in best.query], "list": pa.array(best.tag, pa.int32()), "vec_id": pa.array(best.id), "score": pa.array(best.score)})

    found = entries.mapInArrow(run, f"query_id {kind}, list int, vec_id long, score double")
    return top_k(found, n).drop("score", "rank")


def search(index: Index, queries: DataFrame, k: int = 10, probes: int | None = None, candidates: int | None = None, places: int = 4) -> DataFrame:
    """query_id, vec_id, score, rank: approximate neighbours by cosine of ``queries`` (query_id, q_unit), a stated set that is taken in
    blocks. ``candidates`` (twice ``k`` by default) of each query are scored exactly."""
    spark, n, out = queries.sparkSession, candidates or 2 * k, None
    kind = dict(queries.dtypes)["query_id"]
    asked = min(probes or index.probes, len(index.centroids))
    for names, block in query_blocks(queries):
        some = shortlist(index, spark, names, block, asked, n, kind)
        own = index.entries(spark).drop("code").join(F.broadcast(some) if len(names) * n <= BROADCAST_ROWS else some, ["list", "vec_id"])
        of_query = spark.createDataFrame(list(zip(names, block.tolist(), strict=True)), f"query_id {kind}, q_unit array<double>")
        scored = own.join(F.broadcast(of_query), "query_id").select("query_id", "vec_id", F.round(dot(F.col("unit"), F.col("q_unit")), places).alias("score"))
        one = top_k(scored, k)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], f"query_id {kind}, vec_id long, score double, rank int")


def cost(index: Index, queries: DataFrame, k: int = 10, probes: int | None = None, candidates: int | None = None) -> dict[str, float]:
    """Shares of all pairs of a query and a vector that ``search`` scores by codes and exactly, and the share of rows in the largest list."""
    sizes = index.sizes(queries.sparkSession)
    total, coded, exact, m = sum(sizes.values()), 0, 0, 0
    for names, block in query_blocks(queries):
        met = [sum(sizes.get(int(x), 0) for x in row) for row in probed(index, block, min(probes or index.probes, len(index.centroids)))]
        coded, exact, m = coded + sum(met), exact + sum(min(candidates or 2 * k, x) for x in met), m + len(names)
    pairs = max(1, m * total)
    return {"coded_share": coded / pairs, "scored_share": exact / pairs, "largest_list": max(sizes.values(), default=0) / max(1, total)}
