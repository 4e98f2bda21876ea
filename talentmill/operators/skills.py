"""Skill bridge: resolution of names and synonyms, arrays and set algebra."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentmill.functions.text import table_of

#: Rows up to which a dictionary is broadcast.
BROADCAST_ROWS = 500_000
#: source type -> (column, confidence, required)
SOURCES = {"normalized_array": ("skills_normalized", 1.0, None), "text_extract": ("skills_extracted", 0.85, None), "key_skill": ("key_skills", 1.0, True)}


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint where the table is within the bound; otherwise the planner's own choice."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def resolve(names: DataFrame, dictionary: DataFrame, synonyms: DataFrame, name: str = "skill_name") -> DataFrame:
    """``names`` with skill_id: by canonical name, else by synonym, whatever the case; unresolved rows have null."""
    key = F.lower(F.col(name))
    canonical = small(dictionary.select(F.lower("canonical_name").alias("_c"), F.col("skill_id").alias("_a")).dropDuplicates(["_c"]))
    other = small(synonyms.select(F.lower("synonym").alias("_s"), F.col("skill_id").alias("_b")).dropDuplicates(["_s"]))
    return names.join(canonical, key == F.col("_c"), "left").join(other, key == F.col("_s"), "left").withColumn("skill_id", F.coalesce("_a", "_b")).drop("_c", "_a", "_s", "_b")


def build_job_skills(jobs: DataFrame, dictionary: DataFrame, synonyms: DataFrame) -> DataFrame:
    """job_id, skill_id, source_type, confidence, is_required: one row per key, from three arrays in one scan."""
    parts = [F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), _tagged(kind, conf, required)) for kind, (c, conf, required) in SOURCES.items()]
    each = jobs.select("job_id", F.explode(F.concat(*parts)).alias("e")).select("job_id", F.trim("e.name").alias("skill_name"), "e.source_type", "e.confidence", "e.is_required").where("skill_name <> ''")
    return resolve(each, dictionary, synonyms).where("skill_id is not null").drop("skill_name").dropDuplicates(["job_id", "skill_id", "source_type"])


def _tagged(kind: str, confidence: float, required: bool | None):
    return lambda n: F.struct(n.alias("name"), F.lit(kind).alias("source_type"), F.lit(confidence).cast("decimal(5,4)").alias("confidence"), F.lit(required).cast("boolean").alias("is_required"))


def skill_parent(dictionary: DataFrame) -> DataFrame:
    """Each skill with its parent's name."""
    up = dictionary.select(F.col("skill_id").alias("_p"), F.col("canonical_name").alias("parent_name"))
    return dictionary.join(up, F.col("parent_skill_id") == F.col("_p"), "left").drop("_p")


def orphans(fact: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    return fact.join(dimension.select(key), key, "left_anti")


def without_skill(jobs: DataFrame, job_skills: DataFrame, skill_id: int | None = None) -> DataFrame:
    """Jobs that lack the skill, or any skill at all."""
    own = job_skills if skill_id is None else job_skills.where(F.col("skill_id") == skill_id)
    return jobs.join(own.select("job_id"), "job_id", "left_anti")


def with_skill(jobs: DataFrame, job_skills: DataFrame, skill_id: int) -> DataFrame:
    """Jobs that have the skill."""
    return jobs.join(job_skills.where(F.col("skill_id") == skill_id).select("job_id"), "job_id", "left_semi")


def skill_flag(jobs: DataFrame, job_skills: DataFrame, skill_id: int, name: str = "has_skill") -> DataFrame:
    """``jobs`` with a flag of whether they have the skill."""
    own = job_skills.where(F.col("skill_id") == skill_id).select("job_id").distinct().withColumn("_f", F.lit(True))
    return jobs.join(own, "job_id", "left").withColumn(name, F.col("_f").isNotNull()).drop("_f")


def explode_values(df: DataFrame, key: str, values: Column, name: str = "skill") -> DataFrame:
    """A row for each value of an array, in capitals."""
    return df.select(key, F.explode(values).alias(name)).withColumn(name, F.upper(name))


def job_skill_list(job_skills: DataFrame, dictionary: DataFrame) -> DataFrame:
    named = job_skills.select("job_id", "skill_id").distinct().join(small(dictionary.select("skill_id", "canonical_name")), "skill_id")
    return named.groupBy("job_id").agg(F.count("*").alias("n_skills"), F.array_join(F.array_sort(F.collect_list("canonical_name")), ",").alias("skills"))


def compare_skills(mine: Column, theirs: Column, empty: int = 100) -> Column:
    """Struct of matching, missing and extra skills and the percentage matched; ``empty`` where the job lists none."""
    match, missing, extra = F.array_intersect(theirs, mine), F.array_except(theirs, mine), F.array_except(mine, theirs)
    pct = F.when(F.size(theirs) == 0, empty).otherwise(F.bround(100.0 * F.size(match) / F.size(F.array_distinct(theirs))).cast("int"))
    return F.struct(F.array_sort(match).alias("match"), F.array_sort(missing).alias("missing"), F.array_sort(extra).alias("extra"), pct.alias("match_pct"))


def implied(skills: DataFrame, rules: DataFrame, key: str = "job_id") -> DataFrame:
    """(key, skill) with the skills that one hop of ``rules`` (skill, implies) adds."""
    more = skills.join(small(rules), "skill").select(key, F.col("implies").alias("skill"))
    return skills.select(key, "skill").unionByName(more).distinct()


def normalize_skills(skills: Column, synonyms: dict[str, str]) -> Column:
    """Canonical names of an array, unknown ones kept, distinct and sorted."""
    table = table_of(synonyms)
    return F.array_sort(F.array_distinct(F.transform(skills, lambda s: F.coalesce(F.element_at(table, F.lower(F.trim(s))), s))))


def merge_sources(*arrays: Column) -> Column:
    """Sorted union of several arrays; null counts as empty."""
    return F.array_sort(reduce(F.array_union, (F.coalesce(a, F.array().cast("array<string>")) for a in arrays)))
