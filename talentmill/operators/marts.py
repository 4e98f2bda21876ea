"""Market marts: salary, role and skill statistics, first and second version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentmill.operators.fx import with_mid
from talentmill.operators.quantiles import quantiles, quantiles_of_counts, with_quantiles

SLICE = ["role", "country", "seniority", "is_remote"]


def blank_to(c: Column, default: str) -> Column:
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(default))


def base_v2(jobs: DataFrame, rates: DataFrame, target: str = "RUB") -> DataFrame:
    """job_id, slice columns and the midpoint in ``target``; sentinels for blank keys, unknown remote counts as not remote."""
    out = with_mid(jobs, rates, target)
    return out.select("job_id", blank_to(F.col("role_family"), "other").alias("role"), blank_to(F.col("country"), "unknown").alias("country"), blank_to(F.col("seniority"), "unknown").alias("seniority"), F.coalesce("remote", F.lit(False)).alias("is_remote"), "salary_mid", *[c for c in ("years_min",) if c in out.columns])


def salary_agg_v2(base: DataFrame, least: int = 10, approximate: bool = False) -> DataFrame:
    q = quantiles(base, SLICE, "salary_mid", [0.25, 0.5, 0.75], approximate=approximate).where(F.col("n") >= least)
    return q.select(*SLICE, F.col("n").alias("sample_size"), F.round(F.col("q")[0], 2).alias("p25"), F.round(F.col("q")[1], 2).alias("p50"), F.round(F.col("q")[2], 2).alias("p75"), F.round("mean", 1).alias("avg_salary"))


def role_stats_v2(base: DataFrame, least: int = 20) -> DataFrame:
    years = F.nullif(F.col("years_min"), F.lit(0))
    stats = base.groupBy(*SLICE).agg(F.count("*").alias("jobs_count"), F.avg("salary_mid").alias("a"), F.avg(years).alias("y")).where(F.col("jobs_count") >= least)
    out = with_quantiles(stats, quantiles(base, SLICE, "salary_mid", [0.5]), SLICE)
    return out.select(*SLICE, "jobs_count", F.round(F.col("q")[0], 2).alias("median_salary"), F.round("a", 1).alias("avg_salary"), F.round(F.col("jobs_count") / F.greatest("y", F.lit(1.0)), 2).alias("competition_proxy"))


def skill_stats_v2(base: DataFrame, job_skills: DataFrame, least_slice: int = 20, least_skill: int = 3) -> DataFrame:
    """Medians with and without each skill of a slice.

    Jobs without a skill are not listed. A slice's values are ranked once. The k-th value without a skill is the one of
    rank k + r among all of them, where r values of the skill stand before it: the most for which fewer than k others do.
    So rows grow with job skills and distinct values, neither with jobs times skills nor with values times skills."""
    slices = base.groupBy(*SLICE).agg(F.count("*").alias("jobs_total"), F.count("salary_mid").alias("paid")).where(F.col("jobs_total") >= least_slice)
    having = base.join(job_skills.select("job_id", "skill_id").distinct(), "job_id").join(slices, SLICE)
    key = [*SLICE, "skill_id"]
    with_skill = having.groupBy(*key).agg(F.count("*").alias("jobs_with_skill"), F.first("jobs_total").alias("jobs_total"), (F.first("paid") - F.count("salary_mid")).alias("others")).where(F.col("jobs_with_skill") >= least_skill)
    values = ranked_values(base.where("salary_mid is not null").groupBy(*SLICE, F.col("salary_mid").alias("v")).agg(F.count("*").alias("n")), SLICE)
    own = having.where("salary_mid is not null").groupBy(*key, F.col("salary_mid").alias("v")).agg(F.count("*").alias("n"))
    with_skill = with_quantiles(with_skill, quantiles_of_counts(own, key, [0.5]), key).withColumn("w", F.col("q")[0]).drop("q")
    before = own.join(values.select(*SLICE, "v", "upto"), [*SLICE, "v"]).select(*key, "upto", F.sum("n").over(Window.partitionBy(*key).orderBy("v")).alias("r"))
    k = {"low": F.floor((F.col("others") + 1) / 2), "high": F.floor((F.col("others") + 2) / 2)}
    passed = with_skill.where("others > 0").select(*key, "others").join(before, key, "left")
    ranks = passed.groupBy(*key).agg(*(F.first(v).alias(f"k_{name}") for name, v in k.items()), *(F.coalesce(F.max(F.when(F.col("upto") - F.col("r") < v, F.col("r"))), F.lit(0)).alias(f"r_{name}") for name, v in k.items()))
    asked = ranks.select(*key, F.explode(F.array(*(F.col(f"k_{name}") + F.col(f"r_{name}") for name in k))).alias("rank"))
    median = values_at(values, asked.select(*SLICE, "rank").distinct(), SLICE).join(asked, [*SLICE, "rank"]).groupBy(*key).agg(F.avg("v").alias("o"))  # of one or two values
    out = with_skill.join(median, key, "left")
    return out.select(*key, "jobs_with_skill", "jobs_total", F.round(100.0 * F.col("jobs_with_skill") / F.col("jobs_total"), 2).alias("share_pct"), F.round("w", 2).alias("median_with"), F.round("o", 2).alias("median_without"), F.round(F.col("w") - F.col("o"), 2).alias("salary_delta"))


def ranked_values(histogram: DataFrame, by: list[str]) -> DataFrame:
    """``histogram`` (by, v, n) with ``part`` of v's scale and ``upto``, how many values of the group are v or less.

    Sums run over parts first, then inside a part, so that no task sorts all values of a large group."""
    own = histogram.withColumn("part", F.floor(F.log2(F.greatest("v", F.lit(1e-6))) * 64))
    parts = own.groupBy(*by, "part").agg(F.sum("n").alias("size"))
    earlier = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*by, "part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("earlier"))
    inside = F.sum("n").over(Window.partitionBy(*by, "part").orderBy("v"))
    return own.withColumn("inside", inside).join(parts, [*by, "part"]).select(*by, "part", "v", (F.col("earlier") + F.col("inside")).alias("upto"))


def values_at(values: DataFrame, asked: DataFrame, by: list[str]) -> DataFrame:
    """``asked`` (by, rank) with the value v of that rank: its part first, then the value in the part."""

    def following(known: DataFrame, queries: DataFrame, keys: list[str], name: str) -> DataFrame:
        """Each query with the first known ``name`` whose ``upto`` reaches its rank."""
        rows = known.select(*keys, F.col("upto").alias("rank"), name, F.lit(1).alias("late")).unionByName(queries.select(*keys, "rank", F.lit(None).alias(name), F.lit(0).alias("late")), allowMissingColumns=False)
        ahead = Window.partitionBy(*keys).orderBy("rank", "late").rowsBetween(Window.currentRow, Window.unboundedFollowing)
        return rows.withColumn(name, F.first(name, ignorenulls=True).over(ahead)).where("late = 0").drop("late")

    parts = values.groupBy(*by, "part").agg(F.max("upto").alias("upto"))
    return following(values, following(parts, asked, by, "part"), [*by, "part"], "v")


def salary_agg_v1(jobs: DataFrame, mids: dict[str, str], least: int = 3) -> DataFrame:
    """By title, country and seniority in several currencies (currency -> column of midpoints), in one pass."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("currency"), F.col(c).cast("double").alias("mid")) for k, c in mids.items())))
    rows = jobs.select(F.col("title_normalized").alias("role"), blank_to(F.col("country"), "__ALL__").alias("country"), blank_to(F.col("seniority"), "unknown").alias("seniority"), each.alias("e")).where("role is not null and e.mid > 0").select("role", "country", "seniority", "e.currency", "e.mid")
    keys, names = ["role", "country", "seniority", "currency"], ["p10", "p25", "p50", "p75", "p90"]
    q = quantiles(rows, keys, "mid", [0.1, 0.25, 0.5, 0.75, 0.9, 0.0, 1.0]).where(F.col("n") >= least)
    each = [F.round(F.col("q")[i], 2).alias(p) for i, p in enumerate(names)]
    return q.select(*keys, F.col("n").alias("sample_size"), *each, F.round("mean", 1).alias("avg_salary"), F.round(F.col("q")[5], 2).alias("min_salary"), F.round(F.col("q")[6], 2).alias("max_salary"))


def role_stats_v1(jobs: DataFrame) -> DataFrame:
    """Counts, mean experience (unknown as 0), share of remote jobs, mean pay, and competition by count."""
    rows = jobs.select(F.col("title_normalized").alias("role"), blank_to(F.col("country"), "__ALL__").alias("country"), blank_to(F.col("seniority"), "unknown").alias("seniority"), "remote", "years_min", "salary_mid").where("role is not null")
    out = rows.groupBy("role", "country", "seniority").agg(F.count("*").alias("job_count"), F.avg(F.coalesce("years_min", F.lit(0))).alias("y"), F.count_if(F.coalesce("remote", F.lit(False))).alias("r"), F.avg("salary_mid").alias("a"))
    level = F.when(F.col("job_count") >= 100, "high").when(F.col("job_count") >= 30, "medium").otherwise("low")
    return out.select("role", "country", "seniority", "job_count", F.round("y", 2).alias("avg_experience"), F.round(100.0 * F.col("r") / F.col("job_count"), 2).alias("remote_pct"), F.round("a", 1).alias("avg_salary"), level.alias("competition"))


def skill_stats_v1(jobs: DataFrame) -> DataFrame:
    """Share of a slice's jobs with each distinct skill name, and their mean pay. ``jobs`` has ``skills`` (array) and ``salary_mid``."""
    rows = jobs.select("job_id", F.col("title_normalized").alias("role"), blank_to(F.col("country"), "__ALL__").alias("country"), blank_to(F.col("seniority"), "unknown").alias("seniority"), "skills", "salary_mid").where("role is not null")
    keys = ["role", "country", "seniority"]
    total = rows.groupBy(*keys).agg(F.countDistinct("job_id").alias("total"))
    each = rows.withColumn("skill_name", F.explode(F.array_distinct("skills"))).where("trim(skill_name) <> ''")
    out = each.groupBy(*keys, "skill_name").agg(F.countDistinct("job_id").alias("job_count"), F.avg("salary_mid").alias("a")).join(total, keys)
    return out.select(*keys, "skill_name", F.round(100.0 * F.col("job_count") / F.col("total"), 2).alias("share_pct"), F.round("a", 1).alias("avg_salary"), "job_count")
