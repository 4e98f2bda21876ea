"""Vector search: exact cosine top-k for many queries, filters and reranking. The approximate index is in ``ivf``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentmill.functions.hashing import FORMATS_ALLOWED, GRADES_ALLOWED
from talentmill.functions.text import let, lookup
from talentmill.operators import blocks
from talentmill.operators.blocks import Pairs

#: Queries taken at a time; more are taken in blocks. Where conditions are asked, as many as have so many bytes of vectors.
QUERY_BLOCK, QUERY_BYTES = 2_000, 16 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(df: DataFrame, vector: str = "embedding", name: str = "unit") -> DataFrame:
    """``df`` with the vector scaled to length 1, as doubles; zero vectors stay zero."""
    norm = F.sqrt(dot(F.col(vector), F.col(vector)))
    scaled = lambda n: F.transform(F.col(vector), lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))
    return df.withColumn(name, F.when(F.col(vector).isNotNull(), let(norm, scaled)))  # bound once: a column of its own would be put in for each element


def top_k(scored: DataFrame, k: int, by: str = "query_id", score: str = "score", key: str = "vec_id") -> DataFrame:
    """Best k per query, with ``rank``. The rank filter is applied in each task before the shuffle too, so that at most k rows
    a task and query are moved, and it sorts instead of collecting, so that memory does not grow with the rows."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), key))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def query_tables(queries: DataFrame, width: int) -> Iterator[pa.Table]:
    """A stated set of queries as Arrow tables of bounded size."""
    at_most = max(QUERY_BLOCK, QUERY_BYTES // (8 * max(1, width)))
    number = -(-queries.count() // at_most)
    for b in range(number):
        some = (queries if number == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(number)) == b)).toArrow()
        if some.num_rows:
            yield some


def search(items: DataFrame, queries: DataFrame, k: int, keep: Callable[[Pairs], np.ndarray] | None = None, places: int = 4, with_columns: tuple[str, ...] = (), rerank: Callable[[np.ndarray, Pairs], np.ndarray] | None = None, on: tuple[str, ...] = ()) -> DataFrame:
    """query_id, vec_id, score, rank: nearest items of each query by cosine, with further columns of either side.

    ``queries`` (query_id, q_unit) is a stated set, sent to all items in blocks of bounded size, which meet blocks of items by matrix
    products; a task hands on the best ``k`` of each query alone. ``keep`` may compare columns ``on`` both sides and drops pairs
    before ranking; ``rerank`` changes the score that is ranked. ``vec_id`` is an integer; rows without it or a vector are left out."""
    types, own = dict(queries.dtypes) | dict(items.dtypes), dict.fromkeys((*on, *with_columns))
    rows = items.where("vec_id is not null and unit is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("unit").cast("array<double>").alias("unit"), *(c for c in own if c in items.columns and c != "vec_id"), *([F.col("vec_id").alias("vec_id_")] if "vec_id" in own else []))
    asked = queries.where("q_unit is not null").select("query_id", F.col("q_unit").cast("array<double>").alias("q_unit"), *(c for c in own if c in queries.columns and c not in items.columns and c != "query_id"))
    kinds = {"query_id": dict(queries.dtypes)["query_id"]} | {c: types[c] for c in with_columns}
    first, out = asked.select(F.size("q_unit").alias("n")).first(), None
    for block in query_tables(asked, first["n"]) if first else ():
        one = top_k(blocks.best_pairs(rows, block, k, places, kinds, keep, rerank), k)
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = items.sparkSession.createDataFrame([], ", ".join(f"{c} {t}" for c, t in ({"query_id": kinds["query_id"], "vec_id": "long", "score": "double"} | kinds | {"rank": "int"}).items()))
    return out.withColumn("vec_id", F.col("vec_id").cast(dict(items.dtypes)["vec_id"]))


def query_blocks(queries: DataFrame) -> Iterator[tuple[list, np.ndarray]]:
    """A stated set of queries (query_id, q_unit) in blocks of bounded size: ids, and vectors as rows. Queries without a vector are left out."""
    asked = queries.where("q_unit is not null").select("query_id", F.col("q_unit").cast("array<double>").alias("q_unit"))
    first = asked.limit(QUERY_BLOCK + 1).collect()
    if len(first) <= QUERY_BLOCK:
        if first:
            yield [r["query_id"] for r in first], np.array([r["q_unit"] for r in first])
        return
    number = -(-asked.count() // QUERY_BLOCK)
    for b in range(number):
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(number)) == b).collect()
        if rows:
            yield [r["query_id"] for r in rows], np.array([r["q_unit"] for r in rows])


def search_exact(items: DataFrame, queries: DataFrame, k: int, places: int = 4) -> DataFrame:
    """query_id, vec_id, score, rank: what ``search`` gives without conditions, by products of blocks of vectors with blocks of queries.

    A task keeps the best ``k`` of each query and hands on no other pair. ``vec_id`` is a long integer; rows without it or a vector are left out."""
    kind, out = dict(queries.dtypes)["query_id"], None
    rows = items.where("vec_id is not null and unit is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("unit").cast("array<double>").alias("unit"))
    for names, block in query_blocks(queries):
        one = top_k(blocks.nearest(rows, names, block, k, places, kind), k)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else items.sparkSession.createDataFrame([], f"query_id {kind}, vec_id long, score double, rank int")


def rerank_skill(score: Column | np.ndarray, matches: Column | np.ndarray) -> Column | np.ndarray:
    return score + 0.15 * matches


def rerank_mix(score: Column | np.ndarray, overlap: Column | np.ndarray, n: Column | int) -> Column | np.ndarray:
    return 0.6 * score + 0.4 * overlap / (n + 1)


def with_fallback(first: DataFrame, other: DataFrame, by: str = "query_id") -> DataFrame:
    """Rows of ``first``; for queries that have none there, those of ``other``."""
    return first.unionByName(other.join(first.select(by).distinct(), by, "left_anti"))


def _allowed(table: dict[str, list[str]], value: Column) -> Column:
    """What a grade or format allows; an unknown one allows itself."""
    return F.coalesce(lookup(table, F.lower(value)), F.array(value))


def for_candidates(items: DataFrame, candidates: DataFrame, k: int = 20) -> DataFrame:
    """Vacancies for many candidates at once: filtered by what grade, formats and country allow, nearest first, with the overlap of skills.

    ``items``: vec_id, unit, grade, work_format, country, skills. ``candidates``: query_id, q_unit, q_grade, q_formats, q_country, q_skills;
    null asks for nothing. Skills are compared without case."""
    formats = F.flatten(F.transform("q_formats", lambda f: _allowed(FORMATS_ALLOWED, f)))
    allowed = {"_grades": _allowed(GRADES_ALLOWED, F.col("q_grade")), "_formats": formats, "_country": F.upper("q_country")}

    def keep(p: Pairs) -> np.ndarray:
        return (p.unset("q_grade") | p.among("grade", "_grades")) & (p.unset("q_formats") | p.among("work_format", "_formats")) & (p.unset("_country") | p.same("country", "_country"))

    low = lambda c: F.array_distinct(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), F.lower))
    sides = items.withColumn("skills", low("skills")), candidates.withColumn("q_skills", low("q_skills")).withColumns(allowed)
    found = search(*sides, k, keep, with_columns=("skills", "q_skills"), on=("grade", "work_format", "country", "q_grade", "q_formats", *allowed)).drop("rank")
    matched, missing = F.array_sort(F.array_intersect("q_skills", "skills")), F.array_sort(F.array_except("q_skills", "skills"))
    out = found.select("query_id", "vec_id", "score", F.size(matched).alias("skill_match_count"), F.round(100.0 * F.size(matched) / F.greatest(F.size("q_skills"), F.lit(1)), 1).alias("skill_match_pct"), matched.alias("matched_skills"), missing.alias("missing_skills"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("skill_match_count"), "vec_id"))
    return out.withColumn("rank", rank)


def similar_to_jobs(items: DataFrame, asked: DataFrame, k: int = 20, exclude_same_company: bool = True) -> DataFrame:
    """query_id, vec_id, score, rank: items like a job, none of its own company.

    ``items``: vec_id, unit, company. ``asked``: query_id, job_id, q_company, q_text_unit. A job that is indexed gives its vector and
    company; for others the vector of their text is taken and the company that was given. Those with neither get nothing."""
    known = items.select(F.col("vec_id").alias("_id"), F.col("unit").alias("_unit"), F.col("company").alias("_company"))
    own = asked.join(known, F.col("job_id") == F.col("_id"), "left")
    queries = own.select("query_id", F.coalesce("_unit", "q_text_unit").alias("q_unit"), F.coalesce("_company", "q_company").alias("q_company")).where("q_unit is not null")
    return search(items, queries, k, (lambda p: ~p.same("company", "q_company")) if exclude_same_company else None, on=("company", "q_company"))


def search_city(items: DataFrame, queries: DataFrame, k: int = 5, times: int = 5, boost: float = 0.15) -> DataFrame:
    """Nearest ``k`` of ``times`` as many: other cities drop out for those who do not relocate, the own city gains ``boost``;
    where nothing is left, all count as they are. ``items`` has city, ``queries`` q_city and q_relocation."""
    found = search(items, queries, k * times, with_columns=("city", "q_city", "q_relocation")).drop("rank")
    known = F.col("q_city").isNotNull() & F.col("city").isNotNull()
    own = F.coalesce(known & (F.lower("city") == F.lower("q_city")), F.lit(False))
    near = found.where(F.col("q_relocation") | ~known | own).withColumn("score", F.round(F.col("score") + F.when(own, boost).otherwise(0.0), 4))
    return top_k(with_fallback(near, found).select("query_id", "vec_id", "score"), k)


def retrieve(items: DataFrame, queries: DataFrame, k: int = 10, threshold: float = 0.5, or_remote: bool = False, fallback: bool = False) -> DataFrame:
    """Nearest ``k`` of a score of at least ``threshold`` in the query's city (``or_remote``: or anywhere without office) and with the
    least pay it asks for; with ``fallback``, queries without a result get those of all items."""

    def keep(p: Pairs) -> np.ndarray:
        place = p.unset("q_city") | p.same("city", "q_city")
        return (place | p.item("remote") if or_remote else place) & (p.unset("q_salary_min") | (p.item("salary_from") >= p.query("q_salary_min")))

    good = lambda found: found.where(F.col("score") >= threshold)
    first = good(search(items, queries, k, keep, on=("city", "salary_from", "q_city", "q_salary_min", *(("remote",) if or_remote else ()))))
    return with_fallback(first, good(search(items, queries, k))) if fallback else first
