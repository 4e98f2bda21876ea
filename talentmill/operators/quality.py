"""Data-quality checks, coverage and distributions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """A row per broken rule of a row, in one pass; a rule that is null holds."""
    broken = F.filter(F.array(*(F.when(~c, F.lit(name)) for name, c in rules.items())), lambda r: r.isNotNull())
    return df.withColumn("rule", F.explode(broken))


def salary_rules() -> dict[str, Column]:
    return {"salary_range": F.col("salary_from") <= F.col("salary_to"), "salary_positive": F.coalesce("salary_from", "salary_to") > 0, "seniority_known": F.col("seniority").isNotNull()}


# What a seniority and an embedding status may be.
SENIORITIES = ["intern", "junior", "middle", "senior", "lead", "principal", "manager", "director", "unknown"]
EMBEDDING_STATUSES = ["pending", "created", "failed", "skipped"]


def job_rules() -> dict[str, Column]:
    """Constraints of a curated row; null values break none."""
    return {
        "salary_range": F.col("salary_from") <= F.col("salary_to"), "years_range": F.col("years_min") <= F.col("years_max"),
        "seniority": F.col("seniority").isin(SENIORITIES), "embedding_status": F.col("embedding_status").isin(EMBEDDING_STATUSES),
    }


def key_violations(df: DataFrame, keys: dict[str, list[str]]) -> DataFrame:
    """``df`` with ``rule`` for every row that shares a key (rule -> columns) with another; the last column of a key must not be blank.

    Rows are counted by key, partly in their tasks, and only keys of several rows are joined back."""
    out = None
    for rule, columns in keys.items():
        bound = df.where(F.trim(F.col(columns[-1]).cast("string")) != "")
        twice = bound.groupBy(*columns).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
        one = bound.join(twice, columns, "left_semi").withColumn("rule", F.lit(rule))
        out = one if out is None else out.unionByName(one)
    return out


def constraint_violations(df: DataFrame) -> DataFrame:
    """A row per constraint that a curated row breaks: ranges, enums and unique keys of its source."""
    keys = {"source_url": ["source", "url"], "source_job": ["source", "source_job_id"]}
    return violations(df, job_rules()).unionByName(key_violations(df, keys))


def mart_groups(salary: DataFrame, by: list[str] = ("country",)) -> DataFrame:
    """Number of groups of a mart."""
    return salary.groupBy(*by).agg(F.count("*").alias("groups_count"))


def load_counters(audit: DataFrame, rejected: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """One row of a load's counters. ``audit`` has the action of each row; ``before`` and ``after`` are registries with ``is_active``."""
    actions = audit.agg(*(F.count_if(F.col("action") == a).alias(a) for a in ("inserted", "updated", "unchanged")))
    closed = after.where("NOT is_active").join(before.where("is_active").select("job_id"), "job_id", "left_semi").agg(F.count("*").alias("archived"))
    return actions.join(F.broadcast(rejected.agg(F.count("*").alias("failed")))).join(F.broadcast(closed))  # one row each


def counts_where(df: DataFrame, tests: dict[str, Column], by: list[str] = ()) -> DataFrame:
    """Rows and conditional counts, global or by group."""
    return df.groupBy(*by).agg(F.count("*").alias("total"), *(F.count_if(c).alias(n) for n, c in tests.items()))


def fill_rates(df: DataFrame, tests: dict[str, Column], by: list[str], places: int = 1) -> DataFrame:
    counted = counts_where(df, tests, by)
    return counted.select(*by, "total", *(F.round(100.0 * F.col(n) / F.col("total"), places).alias(f"{n}_pct") for n in tests))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Count of each value, null included."""
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))


def distributions(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Distributions of several columns in one pass."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns)))
    return df.select(pairs.alias("p")).groupBy("p.field", "p.value").agg(F.count("*").alias("n"))


def daily_counts(df: DataFrame, ts: str) -> DataFrame:
    return df.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))


def layer_counts(layers: dict[str, DataFrame]) -> DataFrame:
    """Rows of each layer."""
    out = None
    for name, df in layers.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("layer"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


def coverage(jobs: DataFrame, job_skills: DataFrame, by: list[str] = ()) -> DataFrame:
    """Jobs with pay, with skills, with both, and their shares."""
    flag = job_skills.select("job_id").distinct().withColumn("_s", F.lit(True))
    paid, skilled = F.coalesce("salary_from", "salary_to").isNotNull(), F.col("_s").isNotNull()
    out = jobs.join(flag, "job_id", "left").groupBy(*by).agg(F.count("*").alias("total"), F.count_if(paid).alias("with_salary"), F.count_if(skilled).alias("with_skills"), F.count_if(paid & skilled).alias("with_both"))
    pct = lambda c: F.round(100.0 * F.col(c) / F.nullif(F.col("total"), F.lit(0)), 1).alias(f"{c}_pct")
    return out.select(*by, "total", "with_salary", "with_skills", "with_both", pct("with_salary"), pct("with_skills"), pct("with_both"))


def company_quality(jobs: DataFrame, company: str, least: int = 1) -> DataFrame:
    """Companies with at least so many jobs, and the share of these that name pay."""
    paid = F.col("salary_from").isNotNull() | F.col("salary_to").isNotNull()
    return fill_rates(jobs, {"with_salary": paid}, [company]).where(F.col("total") >= least).withColumnRenamed("total", "jobs")


def available(base: DataFrame, column: str, order: list[str] | None = None) -> DataFrame:
    """Values with their numbers of jobs; with ``order``, also their places in it (unknown ones last)."""
    out = base.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    if order is None:
        return out.orderBy(F.desc("n"), "value")
    place = F.nullif(F.array_position(F.array(*(F.lit(x) for x in order)), F.col("value")), F.lit(0))
    return out.withColumn("place", F.coalesce(place, F.lit(len(order) + 1)).cast("int"))


def skill_demand(jobs: DataFrame, job_skills: DataFrame, skills: DataFrame, by: list[str] = ()) -> DataFrame:
    """Skills with their numbers of jobs and, of all jobs of the group, the share in percent."""
    own = job_skills.select("job_id", "skill_id").distinct().join(jobs.select("job_id", *by), "job_id").groupBy("skill_id", *by).agg(F.count("*").alias("n"))
    total = jobs.groupBy(*by).agg(F.count("*").alias("_t"))
    named = own.join(skills, "skill_id")
    both = named.join(total, by) if by else named.join(F.broadcast(total))  # one row
    return both.withColumn("pct", F.round(100.0 * F.col("n") / F.col("_t"), 2)).drop("_t")


def available_skills(skills: DataFrame, job_skills: DataFrame, base: DataFrame) -> DataFrame:
    """Skills with their numbers of jobs in ``base``: those no job has count 0, those only other jobs have are left out."""
    used = job_skills.groupBy("skill_id", "job_id").agg(F.lit(True).alias("_u")).join(base.select("job_id", F.lit(True).alias("_b")), "job_id", "left")
    counts = used.groupBy("skill_id").agg(F.count_if("_b").alias("_n"))
    return skills.join(counts, "skill_id", "left").where("_n is null or _n > 0").select(*skills.columns, F.coalesce("_n", F.lit(0).cast("long")).alias("n"))


def bridge_reconcile(jobs: DataFrame, job_skills: DataFrame, array: str) -> DataFrame:
    """Jobs whose skill array and bridge disagree on the number of skills."""
    bridged = job_skills.groupBy("job_id").agg(F.countDistinct("skill_id").alias("n_bridge"))
    out = jobs.select("job_id", F.size(F.coalesce(F.col(array), F.array().cast("array<string>"))).alias("n_array")).join(bridged, "job_id", "left").withColumn("n_bridge", F.coalesce("n_bridge", F.lit(0)))
    return out.where("n_array <> n_bridge")


def mart_checks(salary: DataFrame, roles: DataFrame) -> DataFrame:
    """Sanity of marts: tiny samples, negative competition, unordered percentiles."""
    return layer_counts({"tiny_sample": salary.where("sample_size <= 1"), "unordered": salary.where("p25 > p50 OR p50 > p75"), "negative_competition": roles.where("competition_proxy < 0")})


def suspicious_experience(df: DataFrame, text: str = "description", years: str = "years_min") -> DataFrame:
    """Years beyond reason, or found where the text speaks of no experience or of the company's history."""
    none = F.col(text).rlike(r"(?iu)(no experience|without experience|без опыта)")
    company = F.col(text).rlike(r"(?iu)(our company|founded|years of innovation|since \d{4})")
    reason = F.when(F.col(years) > 25, "too_many").when(F.col(years).isNotNull() & none, "says_none").when(F.col(years).isNotNull() & company, "company_history")
    return df.withColumn("reason", reason).where("reason is not null")


def order_by_enum(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    rank = F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(x) for x in order)), F.col(column)), F.lit(0)), F.lit(len(order) + 1))
    return df.orderBy(rank, column)


def spot_check(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows in an order that looks random but repeats."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def clean_metrics(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows before and after cleaning, missing countries, remote jobs."""
    b = before.agg(F.count("*").alias("rows_in"))
    a = after.agg(F.count("*").alias("rows_out"), F.count_if(F.col("country").isNull()).alias("missing_country"), F.count_if(F.coalesce("remote", F.lit(False))).alias("remote_rows"))
    return b.join(a).withColumn("dropped", F.col("rows_in") - F.col("rows_out"))
