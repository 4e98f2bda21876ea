"""Matching of skill sets to jobs, market questions over marts or live data, and candidate metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentmill.operators.quantiles import quantiles, tenth_from_above, with_quantiles
from talentmill.operators.skills import small


def market_filter(df: DataFrame, country: str | None = None, seniority: str | None = None, remote_only: bool = False, role: str | None = None) -> DataFrame:
    """Filters that are left out when their parameter is None."""
    for column, value in (("country", country), ("seniority", seniority), ("role", role)):
        if value is not None:
            df = df.where(F.col(column) == value)
    return df.where("remote") if remote_only else df


def analytics_base(jobs: DataFrame) -> DataFrame:
    """Active jobs with a title."""
    return jobs.where("is_active AND trim(title) <> ''")


def salary_filter(df: DataFrame, desired: float) -> DataFrame:
    """Jobs whose upper bound reaches the wish, or is not known."""
    return df.where((F.col("salary_to") >= desired) | F.col("salary_to").isNull())


def geo_filter(df: DataFrame, relocation: bool, city: str | None, country: str | None) -> DataFrame:
    """Nothing for candidates who relocate; else by city, unless it says remote; else by country. Case does not matter."""
    if relocation:
        return df
    for column, value in (("city", city if city and city.lower() != "remote" else None), ("country", country)):
        if value:
            return df.where(F.lower(column) == value.lower())
    return df


def capped_queries(queries: DataFrame, cap: int) -> DataFrame:
    """source, q, place: distinct queries of each source in order of first use, up to the cap."""
    first = queries.groupBy("source", F.lower("q").alias("_l")).agg(F.min_by("q", "at").alias("q"), F.min("at").alias("at"))
    place = F.row_number().over(Window.partitionBy("source").orderBy("at"))
    return first.withColumn("place", place).where(F.col("place") <= cap).select("source", "q", "place")


def queries_for(queries: DataFrame, caps: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """source, q, place: queries (source, category, q, at) of the chosen categories, all if none are named, distinct whatever their case,
    in order of first use and up to the cap of their source (source, cap); sources without a cap keep all."""
    some = queries.where(F.col("category").isin(categories)) if categories is not None else queries
    first = some.groupBy("source", F.lower(F.trim("q")).alias("_l")).agg(F.min_by("q", F.struct("at", "q")).alias("q"), F.min("at").alias("at"))
    place = F.row_number().over(Window.partitionBy("source").orderBy("at", "_l"))
    limited = first.withColumn("place", place).join(small(caps), "source", "left")
    return limited.where(F.col("cap").isNull() | (F.col("place") <= F.col("cap"))).select("source", "q", "place")


def skill_ids(dictionary: DataFrame, names: list[str]) -> DataFrame:
    return dictionary.where(F.lower("canonical_name").isin([n.lower() for n in names])).select("skill_id", "canonical_name")


def match_detail(job_skills: DataFrame, dictionary: DataFrame, names: list[str], least: int) -> DataFrame:
    """Per job with enough matches: matched and missing names, counts; one aggregation over its skills."""
    ids = [r.skill_id for r in skill_ids(dictionary, names).collect()]  # at most as many as names
    named = job_skills.select("job_id", "skill_id").distinct().join(small(dictionary.select("skill_id", "canonical_name")), "skill_id")
    own = F.col("skill_id").isin(ids)
    out = named.groupBy("job_id").agg(F.count("*").alias("total_job_skills"), F.count_if(own).alias("matched_count"), F.array_sort(F.collect_list(F.when(own, F.col("canonical_name")))).alias("matched_skills"), F.array_sort(F.collect_list(F.when(~own, F.col("canonical_name")))).alias("missing_skills"))
    return out.where(F.col("matched_count") >= least)


def fit(names: list[str]) -> tuple[Column, Column]:
    """(coverage of the user's skills %, fit of the job's skills %)."""
    return F.round(100.0 * F.col("matched_count") / max(1, len(names)), 1), F.round(100.0 * F.col("matched_count") / F.greatest("total_job_skills", F.lit(1)), 1)


def matching_jobs(jobs: DataFrame, job_skills: DataFrame, dictionary: DataFrame, names: list[str], least: int = 1, n: int = 50, offset: int = 0, **filters) -> DataFrame:
    """Jobs ranked by fit, with matched and missing skills. ``jobs`` is the analytics base with ``salary_mid``."""
    cover, share = fit(names)
    out = market_filter(jobs, **filters).join(match_detail(job_skills, dictionary, names, least), "job_id").withColumn("user_coverage_pct", cover).withColumn("job_fit_pct", share)
    return out.orderBy(F.desc("job_fit_pct"), F.desc("matched_count"), F.col("published_at").desc_nulls_last(), "job_id").offset(offset).limit(n)


def matching_jobs_count(jobs: DataFrame, job_skills: DataFrame, dictionary: DataFrame, names: list[str], least: int = 1, **filters) -> DataFrame:
    """One row: jobs that match, mean coverage and fit, median pay."""
    out = market_filter(jobs, **filters).join(match_detail(job_skills, dictionary, names, least), "job_id")
    stats = out.agg(F.count("*").alias("total_matching_jobs"), F.round(F.avg(100.0 * F.col("matched_count") / max(1, len(names))), 1).alias("avg_coverage_pct"), F.round(F.avg(100.0 * F.col("matched_count") / F.greatest("total_job_skills", F.lit(1))), 1).alias("avg_fit_pct"))
    return with_quantiles(stats, quantiles(out, [], "salary_mid", [0.5]), []).select(*stats.columns, F.round(F.col("q")[0], 2).alias("median_salary"))


def weighted(value: str, weight: str, places: int = 0) -> Column:
    """Mean of pre-aggregates, weighted by their counts where the value is known."""
    known = F.col(value).isNotNull()
    return F.round(F.sum(F.when(known, F.col(value) * F.col(weight))) / F.nullif(F.sum(F.when(known, F.col(weight)).otherwise(0)), F.lit(0)), places)


def ranked_skills(counted: DataFrame, total: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Counted skills by name, with their share of one row's total."""
    share = F.round(100.0 * F.col("jobs_with_skill") / F.nullif(F.col("jobs_total"), F.lit(0)), 1)
    named = counted.join(dictionary, "skill_id").join(F.broadcast(total))  # one row
    return named.select(F.col("canonical_name").alias("skill_name"), "category", "jobs_with_skill", "jobs_total", share.alias("share_pct"), "salary_median_with", F.col("salary_delta").cast("double").alias("salary_delta"))


def best_skills(rows: DataFrame, n: int) -> DataFrame:
    return rows.orderBy(F.desc("share_pct"), F.desc("jobs_with_skill"), "skill_name").limit(n)


def market_skills(role_stats: DataFrame, skill_stats: DataFrame, dictionary: DataFrame, **filters) -> DataFrame:
    slices = market_filter(role_stats, **filters).select("role", "country", "seniority", "is_remote", "jobs_count")
    total = slices.agg(F.coalesce(F.sum("jobs_count"), F.lit(0)).alias("jobs_total"))
    out = skill_stats.drop("jobs_total").join(slices, ["role", "country", "seniority", "is_remote"]).groupBy("skill_id").agg(F.sum("jobs_with_skill").alias("jobs_with_skill"), weighted("median_with", "jobs_with_skill").alias("salary_median_with"), weighted("salary_delta", "jobs_with_skill").alias("salary_delta"))
    return ranked_skills(out, total, dictionary)


def live_skills(base: DataFrame, job_skills: DataFrame, dictionary: DataFrame, **filters) -> DataFrame:
    own = market_filter(base, **filters)
    rows = own.join(job_skills.select("job_id", "skill_id").distinct(), "job_id")
    counted = rows.groupBy("skill_id").agg(F.count("*").alias("jobs_with_skill"))
    out = with_quantiles(counted, quantiles(rows, ["skill_id"], "salary_mid", [0.5]), ["skill_id"])
    return ranked_skills(out.withColumns({"salary_median_with": F.round(F.col("q")[0], 2), "salary_delta": F.lit(None).cast("double")}), own.agg(F.count("*").alias("jobs_total")), dictionary)


def top_skills_from_marts(role_stats: DataFrame, skill_stats: DataFrame, dictionary: DataFrame, n: int, **filters) -> DataFrame:
    return best_skills(market_skills(role_stats, skill_stats, dictionary, **filters), n)


def top_skills_live(base: DataFrame, job_skills: DataFrame, dictionary: DataFrame, n: int, **filters) -> DataFrame:
    """The same from jobs, where no mart slice fits; no pay difference."""
    return best_skills(live_skills(base, job_skills, dictionary, **filters), n)


def top_skills_for_market(role_stats: DataFrame, skill_stats: DataFrame, base: DataFrame, job_skills: DataFrame, dictionary: DataFrame, n: int = 20, slices: DataFrame | None = None, **filters) -> DataFrame:
    """From marts if any slice fits, else live: both in one plan, of which one has no rows.

    A relation of one row, there only if no slice fits, is joined to jobs and to their skills before anything of them is
    moved; where it is empty, adaptive execution drops what stands above it. Whether a slice fits is asked of ``slices``, the distinct
    slices of jobs, if given: cheaper than of marts that are not yet written. No job runs before the result's."""
    fits = market_filter(role_stats if slices is None else slices, **filters).limit(1)
    none = F.broadcast(fits.agg(F.count("*").alias("_n")).where("_n = 0").select(F.lit(True).alias("_live")))  # one row at most
    live = live_skills(base.join(none).drop("_live"), job_skills.join(none).drop("_live"), dictionary, **filters)
    return best_skills(market_skills(role_stats, skill_stats, dictionary, **filters).unionByName(live), n)


def skill_gap(market: DataFrame, names: list[str], n: int = 15, least_share: float = 5.0) -> DataFrame:
    """Skills of a market (its top 100) that the user lacks, by share and pay premium."""
    gain = F.greatest("salary_delta", F.lit(0.0))
    best = market.agg(F.max(F.greatest(F.coalesce("salary_delta", F.lit(0.0)), F.lit(0.0))).alias("best"))
    out = market.where(~F.lower("skill_name").isin([x.lower() for x in names]) & (F.col("share_pct") >= least_share)).join(F.broadcast(best))  # one row
    score = F.round(F.col("share_pct") + F.coalesce(F.when(F.col("salary_delta").isNotNull(), gain) / F.nullif(F.col("best"), F.lit(0.0)) * 20, F.lit(0.0)), 1)
    return out.select("skill_name", "category", "share_pct", "salary_delta", score.alias("priority_score")).orderBy(F.desc("priority_score"), F.desc("share_pct"), "skill_name").limit(n)


def salary_benchmark(salary: DataFrame, **filters) -> DataFrame:
    """Weighted recombination of salary marts by role, country and seniority."""
    rows = market_filter(salary.withColumn("remote", F.col("is_remote")), **filters)
    return rows.groupBy("role", "country", "seniority").agg(F.sum("sample_size").alias("n"), *(weighted(c, "sample_size").alias(c) for c in ("p25", "p50", "p75", "avg_salary"))).withColumnRenamed("n", "sample_size")


def salary_benchmark_live(base: DataFrame, **filters) -> DataFrame:
    q = quantiles(market_filter(base, **filters), [], "salary_mid", [0.25, 0.5, 0.75])
    return q.select(F.col("n").alias("sample_size"), *(F.round(F.col("q")[i], 2).alias(c) for i, c in enumerate(("p25", "p50", "p75"))), F.round("mean", 0).alias("avg_salary"))


def top_k_names(rows: DataFrame, keys: list[str], order: list[Column], name: str, k: int, out: str) -> DataFrame:
    """Array of the k best names of each key, best first."""
    ranked = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_at") <= k)
    return ranked.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", name))), lambda s: s[name]).alias(out))


def country_overview(role_stats: DataFrame, skill_stats: DataFrame, dictionary: DataFrame, country: str, n: int = 30, k: int = 5) -> DataFrame:
    """Roles and seniorities of a country with their weighted pay, competition and top skills."""
    keys = ["role", "seniority"]
    rows = role_stats.where(F.col("country") == country).groupBy(*keys).agg(F.sum("jobs_count").alias("n"), weighted("median_salary", "jobs_count").alias("median_salary"), weighted("avg_salary", "jobs_count").alias("avg_salary"), weighted("competition_proxy", "jobs_count", 2).alias("competition_proxy"))
    counted = skill_stats.where(F.col("country") == country).groupBy(*keys, "skill_id").agg(F.sum("jobs_with_skill").alias("c")).join(small(dictionary.select("skill_id", "canonical_name")), "skill_id")
    top = top_k_names(counted, keys, [F.desc("c"), F.col("canonical_name")], "canonical_name", k, "top_skills")
    return rows.withColumnRenamed("n", "jobs_count").join(top, keys, "left").orderBy(F.desc("jobs_count"), *keys).limit(n)


def best_countries(base: DataFrame, job_skills: DataFrame, dictionary: DataFrame, names: list[str], n: int = 10, k: int = 5, least: int = 1) -> DataFrame:
    """Countries by number of jobs that match the skills, with fit, pay and the matched skills most in demand."""
    ids = [r.skill_id for r in skill_ids(dictionary, names).collect()]
    own = job_skills.select("job_id", "skill_id").distinct().where(F.col("skill_id").isin(ids))
    matched = own.groupBy("job_id").agg(F.count("*").alias("m")).where(F.col("m") >= least)
    rows = base.join(matched, "job_id")
    stats = rows.groupBy("country").agg(F.count("*").alias("matching_jobs"), F.round(F.avg(100.0 * F.col("m") / max(1, len(names))), 1).alias("avg_coverage_pct"))
    out = with_quantiles(stats, quantiles(rows, ["country"], "salary_mid", [0.5]), ["country"]).select(*stats.columns, F.round(F.col("q")[0], 2).alias("median_salary"))
    each = rows.select("job_id", "country").join(own, "job_id").groupBy("country", "skill_id").agg(F.count("*").alias("c")).join(small(dictionary.select("skill_id", "canonical_name")), "skill_id")
    top = top_k_names(each, ["country"], [F.desc("c"), F.col("canonical_name")], "canonical_name", k, "top_matched_skills")
    return out.join(top, "country", "left").orderBy(F.desc("matching_jobs"), "country").limit(n)


def remote_comparison(base: DataFrame, **filters) -> DataFrame:
    rows = market_filter(base, **filters).withColumn("work_format", F.when(F.col("is_remote"), "remote").otherwise("on_site"))
    stats = rows.groupBy("work_format").agg(F.count("*").alias("jobs_count"), F.round(F.avg("salary_mid"), 1).alias("avg_salary"))
    out = with_quantiles(stats, quantiles(rows, ["work_format"], "salary_mid", [0.5]), ["work_format"])
    return out.select("work_format", "jobs_count", F.round(F.col("q")[0], 2).alias("median_salary"), "avg_salary")


def missing_counts(result_skills: DataFrame, own: list[str], n: int) -> DataFrame:
    """Skills of a result set that the candidate lacks, by demand."""
    return result_skills.where(~F.lower("skill").isin([s.lower() for s in own])).groupBy("skill").agg(F.countDistinct("job_id").alias("demand")).orderBy(F.desc("demand"), "skill").limit(n)


def imputed_mid() -> Column:
    """Mean of bounds, else 1.2 times the lower, else 0.8 times the upper one."""
    return F.coalesce((F.col("salary_from") + F.col("salary_to")) / 2, F.col("salary_from") * 1.2, F.col("salary_to") * 0.8)


def market_context(results: DataFrame, mid: Column, by: list[str] = (), top: str = "max") -> DataFrame:
    """Median, top and range of pay of a result set; ``top``: the maximum, the 90th percentile, or the value a tenth down the list."""
    rows = results.withColumn("_m", mid).where("_m is not null")
    best = {"max": 1.0, "p90": 0.9, "tenth": tenth_from_above}[top]
    out = quantiles(rows, list(by), "_m", [0.5, best, 0.0, 1.0])
    return out.select(*by, "n", *(F.round(F.col("q")[i], 2).alias(c) for i, c in enumerate(("median", "top", "low", "high"))))


def best_and_gaps(results: DataFrame, own: list[str], by: list[str], best: int = 3, gaps: int = 10) -> DataFrame:
    """(by, match_score, skill_gaps): mean of the best scores of each group's results, and the skills that most of its results ask for and the candidate lacks.

    ``results``: by, job_id, score (per cent), skills (array). Scores are ranked in their tasks first; skills are counted partly there."""
    ranked = results.select(*by, "job_id", "score").withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "job_id"))).where(F.col("_at") <= best)
    mean = ranked.groupBy(*by).agg(F.round(F.avg(F.round("score", 1)), 1).alias("match_score"))
    lacking = results.select(*by, F.explode(F.array_distinct("skills")).alias("skill")).where(~F.lower("skill").isin([s.lower() for s in own])).groupBy(*by, "skill").agg(F.count("*").alias("_n"))
    return mean.join(top_k_names(lacking, by, [F.desc("_n"), F.col("skill")], "skill", gaps, "skill_gaps"), by, "left")


def roadmap(result_skills: DataFrame, own: list[str], n: int = 5) -> DataFrame:
    """Missing skills with demand, pay, priority and weeks to learn; the gain of the best two is 8 % each."""
    rows = result_skills.where(~F.lower("skill").isin([s.lower() for s in own])).groupBy("skill").agg(F.countDistinct("job_id").alias("demand"), F.avg("salary_mid").alias("a"))
    score = F.col("demand") * (1 + F.coalesce("a", F.lit(0.0)) / 100000)
    return rows.select("skill", "demand", F.round("a", 1).alias("avg_salary"), F.round(score, 2).alias("priority"), F.greatest(F.lit(1), 4 - F.col("demand")).cast("int").alias("weeks")).orderBy(F.desc("priority"), "skill").limit(n)


def match_histogram(scores: DataFrame, column: str = "score") -> DataFrame:
    """Five bins of 20 points; 100 falls in the last."""
    return scores.groupBy(F.floor(F.least(F.col(column), F.lit(99)) / 20).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def result_stats(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count_if(F.col("score") >= 80).alias("high_match"), F.round(F.avg("salary_mid"), 1).alias("avg_salary"), F.countDistinct("company").alias("companies"))


def scorecard(turns: DataFrame) -> DataFrame:
    """Per conversation: answers, right ones, integer mean score; a missing score counts 50."""
    return turns.groupBy("conv_id").agg(F.count("*").alias("answered"), F.count_if("correct").alias("correct"), F.floor(F.avg(F.coalesce("score", F.lit(50)))).cast("long").alias("mean_score"))


def resume_fit(mine: Column, theirs: Column) -> Column:
    """Percentage, projection after closing gaps, first missing and extra skills, and a note on weak fits."""
    hit, gaps, extra = F.size(F.array_intersect(theirs, mine)), F.array_sort(F.array_except(theirs, mine)), F.array_sort(F.array_except(mine, theirs))
    pct = F.when(F.size(theirs) == 0, 100).otherwise(F.bround(100.0 * hit / F.size(theirs)).cast("int"))
    return F.struct(pct.alias("pct"), F.when(F.size(gaps) > 0, F.least(F.lit(95), pct + 15)).otherwise(pct).alias("projected"), F.slice(gaps, 1, 5).alias("missing"), F.slice(extra, 1, 3).alias("extra"), (pct < 50).alias("weak"))
