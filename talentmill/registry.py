"""Queries of the analytics operators over the given tables, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talentmill.functions import hashing as H
from talentmill.functions import location as L
from talentmill.functions import salary as S
from talentmill.functions import text as X
from talentmill.operators import fx, ivf, marts, match, merge, quality, skills, vector
from talentmill.operators.quantiles import quantiles, with_quantiles
from talentmill.plans import clean, views
from talentmill.plans.views import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
USER = ["Brand#3", "Brand#12", "Brand#25"]
USER_SQL = "('brand#3', 'brand#12', 'brand#25')"


def query(sql: str | None = None):
    """Register a query under its function's name; SQL over views gets their definitions in front."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH {views.SQL.strip()}\n{sql.strip()}" if "v_" in sql and not sql.lstrip().startswith(",") else f"WITH {views.SQL.strip()}{sql.strip()}" if sql.lstrip().startswith(",") else sql.strip()
        return f

    return add


def base(spark: SparkSession, d: str) -> DataFrame:
    return marts.base_v2(views.jobs(spark, d).where("is_active"), views.rates(spark, d))


def doc_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")


def health_log(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("source"), "ts", F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"), F.element_at(F.array(F.lit("permanent"), F.lit("temporary"), F.lit("other")), (F.col("event_id") % 3 + 1).cast("int")).alias("reason"))


def snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    j = views.jobs(spark, d)
    old = j.where("job_id % 10 < 8").select("job_id", F.concat(F.lit("src"), (F.col("job_id") % 3).cast("string")).alias("source"), "salary_from", "salary_to")
    new = j.where("job_id % 10 > 2").select("job_id", F.concat(F.lit("src"), (F.col("job_id") % 3).cast("string")).alias("source"), F.when(F.col("job_id") % 3 == 0, F.col("salary_from") + 1).otherwise(F.col("salary_from")).alias("salary_from"), "salary_to")
    return old, new


OLD_NEW = """, old AS (SELECT job_id, 'src' || CAST(job_id % 3 AS VARCHAR) AS source, salary_from, salary_to FROM v_jobs WHERE job_id % 10 < 8),
new AS (SELECT job_id, 'src' || CAST(job_id % 3 AS VARCHAR) AS source, CASE WHEN job_id % 3 = 0 THEN salary_from + 1 ELSE salary_from END AS salary_from, salary_to FROM v_jobs WHERE job_id % 10 > 2)
"""
ROLE_V2 = """, role2 AS (SELECT role, country, seniority, is_remote, count(*) AS jobs_count, round(quantile_cont(salary_mid, 0.5), 2) AS median_salary, round(avg(salary_mid), 1) AS avg_salary,
  round(count(*) / greatest(avg(nullif(years_min, 0)), 1), 2) AS competition_proxy FROM v_base GROUP BY ALL HAVING count(*) >= {n})"""
SAL_V2 = """, sal2 AS (SELECT role, country, seniority, is_remote, count(*) AS sample_size, round(quantile_cont(salary_mid, 0.25), 2) AS p25, round(quantile_cont(salary_mid, 0.5), 2) AS p50,
  round(quantile_cont(salary_mid, 0.75), 2) AS p75, round(avg(salary_mid), 1) AS avg_salary FROM v_base WHERE salary_mid IS NOT NULL GROUP BY role, country, seniority, is_remote HAVING count(*) >= {n})"""
SKILL_V2 = """, slices AS (SELECT role, country, seniority, is_remote, count(*) AS jobs_total FROM v_base GROUP BY ALL HAVING count(*) >= {n}),
own AS (SELECT DISTINCT job_id, skill_id FROM v_job_skills),
w AS (SELECT b.role, b.country, b.seniority, b.is_remote, s.jobs_total, o.skill_id, count(*) AS jobs_with_skill, quantile_cont(salary_mid, 0.5) AS m FROM v_base b JOIN slices s USING (role, country, seniority, is_remote) JOIN own o USING (job_id) GROUP BY ALL HAVING count(*) >= 3),
wo AS (SELECT b.role, b.country, b.seniority, b.is_remote, w.skill_id, quantile_cont(b.salary_mid, 0.5) AS m FROM v_base b JOIN w USING (role, country, seniority, is_remote)
  LEFT JOIN own o ON o.job_id = b.job_id AND o.skill_id = w.skill_id WHERE o.job_id IS NULL GROUP BY ALL),
skill2 AS (SELECT w.role, w.country, w.seniority, w.is_remote, w.skill_id, jobs_with_skill, jobs_total, round(100.0 * jobs_with_skill / jobs_total, 2) AS share_pct, round(w.m, 2) AS median_with, round(wo.m, 2) AS median_without, round(w.m - wo.m, 2) AS salary_delta
  FROM w LEFT JOIN wo USING (role, country, seniority, is_remote, skill_id))"""
#: Least jobs a slice of the test tables must have.
LEAST = 5


# ---- joins and conversion -------------------------------------------------------------------


@query("SELECT job_id, currency, published_at, r AS rate FROM v_conv")
def jon04_asof_fx(spark, d):
    out = fx.as_of_rate(views.jobs(spark, d), views.rates(spark, d), "RUB", date="published_at")
    return out.select("job_id", "currency", "published_at", F.col("rate").cast("double").alias("rate"))


@query("SELECT base_currency, target_currency, CAST(max(rate_date) AS DATE) AS rate_date, CAST(arg_max(rate, rate_date) AS DOUBLE) AS rate FROM v_rates GROUP BY 1, 2")
def jon05_latest_rates(spark, d):
    return fx.latest_rates(views.rates(spark, d)).select("base_currency", "target_currency", "rate_date", F.col("rate").cast("double").alias("rate"))


@query(", q AS (SELECT rate_date, base_currency AS c, CAST(rate AS DOUBLE) AS v FROM v_rates UNION ALL SELECT DISTINCT rate_date, 'RUB', 1.0 FROM v_rates) SELECT a.rate_date, a.c AS base_currency, b.c AS target_currency, round(a.v / b.v, 6) AS rate FROM q a JOIN q b USING (rate_date)")
def jon15_cross_rates(spark, d):
    return fx.cross_rates(views.rates(spark, d))


@query("SELECT job_id, salary_mid FROM v_mid")
def sal12_converted_mid(spark, d):
    return fx.with_mid(views.jobs(spark, d), views.rates(spark, d), "RUB").select("job_id", "salary_mid")


@query("SELECT job_id, CASE WHEN salary_from IS NOT NULL AND salary_to IS NOT NULL THEN (coalesce(low, salary_from) + coalesce(high, salary_to)) / 2 ELSE coalesce(low, high, salary_from, salary_to) END AS salary_mid FROM v_mid")
def sal14_mid_or_raw(spark, d):
    return fx.with_mid(views.jobs(spark, d), views.rates(spark, d), "RUB", keep_raw=True).select("job_id", F.col("salary_mid").cast("double").alias("salary_mid"))


@query("SELECT m.job_id, CAST(round(CAST(m.salary_mid / CAST(u.rate AS DOUBLE) AS DECIMAL(20,6)), 2) AS DOUBLE) AS mid_usd, m.salary_mid AS mid_rub FROM v_mid m LEFT JOIN v_int u ON u.base_currency = 'USD' AND m.published_at >= u.rate_date AND (u.until IS NULL OR m.published_at < u.until)")
def sal12_currency_views(spark, d):
    return fx.currency_views(views.jobs(spark, d), views.rates(spark, d), targets=("USD", "RUB")).select("job_id", "mid_usd", "mid_rub")


@query("SELECT job_id, CAST(round_even(salary_from * coalesce(r, CASE currency WHEN 'USD' THEN 82.1314 WHEN 'EUR' THEN 95.0038 WHEN 'GBP' THEN 109.8261 WHEN 'PLN' THEN 22.2289 ELSE 1.0 END), 0) AS BIGINT) AS salary_from_rub FROM v_conv")
def sal13_reprice(spark, d):
    out = fx.reprice(views.jobs(spark, d), views.rates(spark, d), S.lookup(S.V.FALLBACK_RUB, F.col("currency")))
    return out.select("job_id", "salary_from_rub")


@query("SELECT j.job_id, count(*) AS n FROM v_jobs j JOIN v_job_skills s ON s.job_id = j.job_id JOIN v_skills k ON k.skill_id = s.skill_id WHERE j.is_active GROUP BY 1")
def jon01_jobs_skills(spark, d):
    rows = views.jobs(spark, d).where("is_active").join(views.job_skills(spark, d), "job_id").join(skills.small(views.skills(spark, d)), "skill_id")
    return rows.groupBy("job_id").agg(F.count("*").alias("n"))


@query("SELECT job_id FROM v_jobs WHERE job_id NOT IN (SELECT job_id FROM v_job_skills WHERE skill_id = 3)")
def jon07_without_skill(spark, d):
    return skills.without_skill(views.jobs(spark, d), views.job_skills(spark, d), 3).select("job_id")


@query("SELECT s.skill_id, s.canonical_name, p.canonical_name AS parent_name FROM v_skills s LEFT JOIN v_skills p ON p.skill_id = s.skill_id // 10 AND s.skill_id >= 10")
def jon10_skill_parent(spark, d):
    dictionary = views.skills(spark, d).withColumn("parent_skill_id", F.when(F.col("skill_id") >= 10, F.floor(F.col("skill_id") / 10)).cast("int"))
    return skills.skill_parent(dictionary).select("skill_id", "canonical_name", "parent_name")


@query("SELECT job_id, skill_id, source_type FROM v_job_skills WHERE job_id NOT IN (SELECT job_id FROM v_jobs WHERE is_active)")
def jon11_orphans(spark, d):
    return skills.orphans(views.job_skills(spark, d), views.jobs(spark, d).where("is_active"), "job_id").select("job_id", "skill_id", "source_type")


@query(", c AS (SELECT role_family AS role, skill_id, count(DISTINCT s.job_id) AS n FROM v_jobs j JOIN v_job_skills s ON s.job_id = j.job_id GROUP BY 1, 2), r AS (SELECT role, canonical_name, n, row_number() OVER (PARTITION BY role ORDER BY n DESC, canonical_name) AS k FROM c JOIN v_skills USING (skill_id)) SELECT role, string_agg(canonical_name, ',' ORDER BY k) AS top_skills FROM r WHERE k <= 5 GROUP BY role")
def jon12_top_skills_per_role(spark, d):
    own = views.job_skills(spark, d).select("job_id", "skill_id").distinct()
    counted = views.jobs(spark, d).join(own, "job_id").groupBy(F.col("role_family").alias("role"), "skill_id").agg(F.count("*").alias("n")).join(skills.small(views.skills(spark, d)), "skill_id")
    return match.top_k_names(counted, ["role"], [F.desc("n"), F.col("canonical_name")], "canonical_name", 5, "t").select("role", F.array_join("t", ",").alias("top_skills"))


@query(", a AS (SELECT job_id, lower(canonical_name) AS s, source_type FROM v_job_skills JOIN v_skills USING (skill_id)) SELECT job_id, skill_id, source_type, CAST(CASE source_type WHEN 'text_extract' THEN 0.85 ELSE 1.0 END AS DOUBLE) AS confidence, CASE WHEN source_type = 'key_skill' THEN TRUE END AS is_required FROM v_job_skills")
def agg07_job_skills(spark, d):
    named = views.job_skills(spark, d).join(skills.small(views.skills(spark, d)), "skill_id")
    arrays = named.groupBy("job_id").agg(*(F.collect_list(F.when(F.col("source_type") == k, F.concat(F.lit(" "), F.upper("canonical_name")))).alias(c) for k, (c, _, _) in skills.SOURCES.items()))
    half = views.skills(spark, d)
    synonyms = half.where("skill_id % 2 = 0").select(F.lower("canonical_name").alias("synonym"), "skill_id")
    return skills.build_job_skills(arrays, half.where("skill_id % 2 = 1"), synonyms).select("job_id", "skill_id", "source_type", F.col("confidence").cast("double").alias("confidence"), "is_required")


@query("SELECT job_id, count(*) AS n_skills, string_agg(canonical_name, ',' ORDER BY canonical_name) AS skills FROM (SELECT DISTINCT job_id, canonical_name FROM v_job_skills JOIN v_skills USING (skill_id)) GROUP BY job_id")
def agg21_job_skill_list(spark, d):
    return skills.job_skill_list(views.job_skills(spark, d), views.skills(spark, d))


# ---- marts ----------------------------------------------------------------------------------


@query(SAL_V2.format(n=LEAST) + " SELECT * FROM sal2")
def agg04_salary_v2(spark, d):
    return marts.salary_agg_v2(base(spark, d), least=LEAST)


@query(ROLE_V2.format(n=LEAST) + " SELECT * FROM role2")
def agg05_role_stats_v2(spark, d):
    return marts.role_stats_v2(base(spark, d), least=LEAST)


@query(SKILL_V2.format(n=LEAST) + " SELECT * FROM skill2")
def agg06_skill_premium(spark, d):
    return marts.skill_stats_v2(base(spark, d), views.job_skills(spark, d), least_slice=LEAST)


def v1_jobs(spark, d):
    return fx.with_mid(views.jobs(spark, d), views.rates(spark, d), "RUB").withColumn("title_normalized", F.lower("role_family"))


@query(", x AS (SELECT lower(role_family) AS role, country, seniority, unnest([{'c': 'RUB', 'm': salary_mid}, {'c': 'RAW', 'm': CAST(coalesce((salary_from + salary_to) / 2.0, salary_from, salary_to) AS DOUBLE)}]) AS e FROM v_mid) SELECT role, country, seniority, e.c AS currency, count(*) AS sample_size, round(quantile_cont(e.m, 0.1), 2) AS p10, round(quantile_cont(e.m, 0.25), 2) AS p25, round(quantile_cont(e.m, 0.5), 2) AS p50, round(quantile_cont(e.m, 0.75), 2) AS p75, round(quantile_cont(e.m, 0.9), 2) AS p90, round(avg(e.m), 1) AS avg_salary, round(min(e.m), 2) AS min_salary, round(max(e.m), 2) AS max_salary FROM x WHERE e.m > 0 GROUP BY 1, 2, 3, 4 HAVING count(*) >= 3")
def agg02_salary_v1(spark, d):
    rows = v1_jobs(spark, d).withColumn("raw_mid", fx.midpoint(F.col("salary_from"), F.col("salary_to")))
    return marts.salary_agg_v1(rows, {"RUB": "salary_mid", "RAW": "raw_mid"})


@query("SELECT lower(role_family) AS role, country, seniority, count(*) AS job_count, round(avg(coalesce(years_min, 0)), 2) AS avg_experience, round(100.0 * count(*) FILTER (WHERE remote) / count(*), 2) AS remote_pct, round(avg(salary_mid), 1) AS avg_salary, CASE WHEN count(*) >= 100 THEN 'high' WHEN count(*) >= 30 THEN 'medium' ELSE 'low' END AS competition FROM v_mid GROUP BY 1, 2, 3")
def agg03_role_stats_v1(spark, d):
    return marts.role_stats_v1(v1_jobs(spark, d))


@query(", t AS (SELECT lower(role_family) AS role, country, seniority, count(*) AS total FROM v_mid GROUP BY 1, 2, 3), o AS (SELECT DISTINCT job_id, canonical_name FROM v_job_skills JOIN v_skills USING (skill_id)), s AS (SELECT lower(role_family) AS role, country, seniority, canonical_name AS skill_name, count(*) AS job_count, avg(salary_mid) AS a FROM v_mid JOIN o USING (job_id) GROUP BY 1, 2, 3, 4) SELECT role, country, seniority, skill_name, round(100.0 * job_count / total, 2) AS share_pct, round(a, 1) AS avg_salary, job_count FROM s JOIN t USING (role, country, seniority)")
def agg01_skill_stats_v1(spark, d):
    listed = views.job_skills(spark, d).join(skills.small(views.skills(spark, d)), "skill_id").groupBy("job_id").agg(F.collect_list("canonical_name").alias("skills"))
    return marts.skill_stats_v1(v1_jobs(spark, d).join(listed, "job_id", "left"))


# ---- quality and distributions --------------------------------------------------------------

DL = "documents LEFT JOIN labels USING (doc_id)"


@query(f"SELECT source, lang, count(*) AS total, count(*) FILTER (WHERE n_chars > 2000) AS long_text, count(quality) AS labelled, count(*) FILTER (WHERE toxic = 1) AS toxic FROM {DL} GROUP BY 1, 2")
def agg08_parsing_stats(spark, d):
    return quality.counts_where(doc_labels(spark, d), {"long_text": F.col("n_chars") > 2000, "labelled": F.col("quality").isNotNull(), "toxic": F.coalesce(F.col("toxic") == 1, F.lit(False))}, ["source", "lang"])


@query(", o AS (SELECT DISTINCT job_id, skill_id FROM v_job_skills) SELECT canonical_name AS skill, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM v_jobs), 2) AS pct FROM o JOIN v_skills USING (skill_id) JOIN v_jobs USING (job_id) GROUP BY 1")
def agg09_top_skills(spark, d):
    return quality.skill_demand(views.jobs(spark, d), views.job_skills(spark, d), skills.small(views.skills(spark, d))).select(F.col("canonical_name").alias("skill"), "n", "pct")


@query("SELECT country, canonical_name AS skill, count(DISTINCT j.job_id) AS n FROM v_jobs j JOIN v_job_skills s ON s.job_id = j.job_id JOIN v_skills USING (skill_id) GROUP BY 1, 2")
def agg10_top_skills_country(spark, d):
    return quality.skill_demand(views.jobs(spark, d), views.job_skills(spark, d), skills.small(views.skills(spark, d)), ["country"]).select("country", F.col("canonical_name").alias("skill"), "n")


@query("SELECT country, currency, count(*) AS n, round(avg(salary_from), 1) AS avg_from, round(avg(salary_to), 1) AS avg_to, round(quantile_cont(coalesce((salary_from + salary_to) / 2.0, salary_from, salary_to), 0.5), 2) AS median_mid FROM v_jobs WHERE coalesce(salary_from, salary_to) IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3")
def agg11_salary_overview(spark, d):
    rows = views.jobs(spark, d).where("coalesce(salary_from, salary_to) is not null").withColumn("m", fx.midpoint(F.col("salary_from"), F.col("salary_to")))
    stats = rows.groupBy("country", "currency").agg(F.count("*").alias("n"), F.round(F.avg("salary_from"), 1).alias("avg_from"), F.round(F.avg("salary_to"), 1).alias("avg_to")).where("n >= 3")
    found = with_quantiles(stats, quantiles(rows, ["country", "currency"], "m", [0.5]), ["country", "currency"])
    return found.select(*stats.columns, F.round(F.col("q")[0], 2).alias("median_mid"))


@query(f"SELECT source, count(*) AS total, round(100.0 * count(*) FILTER (WHERE length(trim(text)) > 0) / count(*), 1) AS text_pct, round(100.0 * count(quality) / count(*), 1) AS label_pct FROM {DL} GROUP BY 1")
def agg12_quality_by_source(spark, d):
    return quality.fill_rates(doc_labels(spark, d), {"text": F.length(F.trim("text")) > 0, "label": F.col("quality").isNotNull()}, ["source"])


@query("SELECT seniority AS value, count(*) AS n FROM v_jobs GROUP BY 1")
def agg13_seniority_distribution(spark, d):
    return quality.distribution(views.jobs(spark, d), "seniority")


COVER = "count(*) AS total, count(*) FILTER (WHERE p) AS with_salary, count(*) FILTER (WHERE s) AS with_skills, count(*) FILTER (WHERE p AND s) AS with_both, round(100.0 * count(*) FILTER (WHERE p) / count(*), 1) AS with_salary_pct, round(100.0 * count(*) FILTER (WHERE s) / count(*), 1) AS with_skills_pct, round(100.0 * count(*) FILTER (WHERE p AND s) / count(*), 1) AS with_both_pct FROM (SELECT role_family, coalesce(salary_from, salary_to) IS NOT NULL AS p, job_id IN (SELECT job_id FROM v_job_skills) AS s FROM v_jobs)"


@query(f"SELECT {COVER}")
def agg14_coverage(spark, d):
    return quality.coverage(views.jobs(spark, d), views.job_skills(spark, d))


@query(f"SELECT role_family, {COVER} GROUP BY 1")
def agg14_coverage_by_source(spark, d):
    return quality.coverage(views.jobs(spark, d), views.job_skills(spark, d), ["role_family"])


@query("SELECT canonical_name AS skill, category, count(DISTINCT s.job_id) AS n, round(100.0 * count(DISTINCT s.job_id) / (SELECT count(*) FROM v_jobs WHERE is_active), 2) AS pct FROM v_job_skills s JOIN v_skills USING (skill_id) JOIN v_jobs j ON j.job_id = s.job_id WHERE is_active GROUP BY 1, 2")
def agg15_active_top_skills(spark, d):
    active = match.analytics_base(views.jobs(spark, d))
    return quality.skill_demand(active, views.job_skills(spark, d), skills.small(views.skills(spark, d))).select(F.col("canonical_name").alias("skill"), "category", "n", "pct")


@query("SELECT s.skill_id, s.canonical_name, count(DISTINCT b.job_id) AS n FROM v_skills s LEFT JOIN (SELECT skill_id, x.job_id FROM v_job_skills x JOIN v_jobs j ON j.job_id = x.job_id) b ON b.skill_id = s.skill_id GROUP BY 1, 2")
def agg16_available_skills(spark, d):
    some = views.job_skills(spark, d).join(views.jobs(spark, d).select("job_id"), "job_id")
    return views.skills(spark, d).join(some, "skill_id", "left").groupBy("skill_id", "canonical_name").agg(F.countDistinct("job_id").alias("n"))


ALL_COVER = COVER.replace("FROM v_jobs)", "FROM v_jobs WHERE is_active AND trim(title) <> '')")


@query(f"SELECT {ALL_COVER}")
def agg14_coverage_all(spark, d):
    return quality.coverage(match.analytics_base(views.jobs(spark, d)), views.job_skills(spark, d))


@query(f"SELECT role_family, {ALL_COVER} GROUP BY 1")
def agg14_coverage_by_source_all(spark, d):
    return quality.coverage(match.analytics_base(views.jobs(spark, d)), views.job_skills(spark, d), ["role_family"])


@query("SELECT s.skill_id, s.canonical_name, count(DISTINCT j.job_id) AS n FROM v_skills s LEFT JOIN v_job_skills x ON x.skill_id = s.skill_id LEFT JOIN (SELECT job_id FROM v_jobs WHERE is_active AND trim(title) <> '') j ON j.job_id = x.job_id WHERE j.job_id IS NOT NULL OR x.job_id IS NULL GROUP BY 1, 2")
def agg16_available_skills_all(spark, d):
    known = views.skills(spark, d).select("skill_id", "canonical_name")
    return quality.available_skills(known, views.job_skills(spark, d), match.analytics_base(views.jobs(spark, d)))


@query("SELECT 'currency' AS field, currency AS value, count(*) AS n FROM v_jobs GROUP BY currency UNION ALL SELECT 'country', country, count(*) FROM v_jobs GROUP BY country UNION ALL SELECT 'remote', CAST(remote AS VARCHAR), count(*) FROM v_jobs GROUP BY remote UNION ALL SELECT 'role_family', role_family, count(*) FROM v_jobs GROUP BY role_family")
def agg18_distributions(spark, d):
    return quality.distributions(views.jobs(spark, d), ["currency", "country", "remote", "role_family"])


@query("SELECT count(*) AS total, count(salary_from) AS has_from, count(salary_to) AS has_to, count(*) FILTER (WHERE remote) AS remote_rows, count(*) FILTER (WHERE is_active) AS active FROM v_jobs")
def agg19_coverage_counts(spark, d):
    return quality.counts_where(views.jobs(spark, d), {"has_from": F.col("salary_from").isNotNull(), "has_to": F.col("salary_to").isNotNull(), "remote_rows": F.col("remote"), "active": F.col("is_active")})


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1")
def agg20_daily_counts(spark, d):
    return quality.daily_counts(table(spark, d, "events"), "ts")


@query("SELECT role_family, count(*) AS n, round(quantile_cont(m, 0.5), 2) AS median, round(max(m), 2) AS top, round(min(m), 2) AS low, round(max(m), 2) AS high FROM (SELECT role_family, CAST(coalesce((salary_from + salary_to) / 2.0, salary_from * 1.2, salary_to * 0.8) AS DOUBLE) AS m FROM v_jobs) WHERE m IS NOT NULL GROUP BY 1")
def agg23_market_context(spark, d):
    return match.market_context(views.jobs(spark, d), match.imputed_mid().cast("double"), ["role_family"])


@query("SELECT role_family, count(*) AS n, round(quantile_cont(m, 0.5), 2) AS median, round(quantile_cont(m, 0.9), 2) AS top, round(min(m), 2) AS low, round(max(m), 2) AS high FROM (SELECT role_family, CAST(coalesce((salary_from + salary_to) / 2.0, salary_from, salary_to) AS DOUBLE) AS m FROM v_jobs) WHERE m IS NOT NULL GROUP BY 1")
def agg24_market_context_p90(spark, d):
    return match.market_context(views.jobs(spark, d), fx.midpoint(F.col("salary_from"), F.col("salary_to")), ["role_family"], top="p90")


@query(f", m AS (SELECT canonical_name AS skill, count(DISTINCT job_id) AS demand, avg(salary_mid) AS a FROM (SELECT DISTINCT b.job_id, canonical_name, salary_mid FROM v_base b JOIN v_job_skills USING (job_id) JOIN v_skills USING (skill_id)) WHERE lower(canonical_name) NOT IN {USER_SQL} GROUP BY 1) SELECT skill, demand, round(a, 1) AS avg_salary, round(demand * (1 + coalesce(a, 0) / 100000), 2) AS priority, CAST(greatest(1, 4 - demand) AS INT) AS weeks FROM m ORDER BY priority DESC, skill LIMIT 5")
def agg25_roadmap(spark, d):
    named = views.job_skills(spark, d).join(skills.small(views.skills(spark, d)), "skill_id").select("job_id", F.col("canonical_name").alias("skill")).distinct()
    return match.roadmap(base(spark, d).join(named, "job_id").select("job_id", "skill", "salary_mid"), USER)


SCORES = ", sc AS (SELECT job_id, round(100.0 * count(*) FILTER (WHERE skill_id IN (3, 12, 25)) / count(*), 1) AS score FROM (SELECT DISTINCT job_id, skill_id FROM v_job_skills) GROUP BY 1)"


def scores(spark, d):
    own = views.job_skills(spark, d).select("job_id", "skill_id").distinct()
    return own.groupBy("job_id").agg(F.round(100.0 * F.count_if(F.col("skill_id").isin(3, 12, 25)) / F.count("*"), 1).alias("score"))


@query(SCORES + " SELECT CAST(floor(least(score, 99) / 20) AS INT) AS bin, count(*) AS n FROM sc GROUP BY 1")
def agg26_match_histogram(spark, d):
    return match.match_histogram(scores(spark, d))


@query(SCORES + " SELECT count(*) FILTER (WHERE score >= 80) AS high_match, round(avg(salary_mid), 1) AS avg_salary, count(DISTINCT country) AS companies FROM sc JOIN v_mid USING (job_id)")
def agg26_result_stats(spark, d):
    mids = fx.with_mid(views.jobs(spark, d), views.rates(spark, d), "RUB")
    return match.result_stats(scores(spark, d).join(mids, "job_id").withColumn("company", F.col("country")))


@query("SELECT conv_id, count(*) AS answered, count(*) FILTER (WHERE length(text) % 2 = 0) AS correct, CAST(floor(avg(coalesce(CASE WHEN length(text) % 5 <> 0 THEN length(text) % 101 END, 50))) AS BIGINT) AS mean_score FROM conversations WHERE role = 'user' GROUP BY 1")
def agg27_scorecard(spark, d):
    n = F.length("text")
    turns = table(spark, d, "conversations").where("role = 'user'").select("conv_id", (n % 2 == 0).alias("correct"), F.when(n % 5 != 0, n % 101).alias("score"))
    return match.scorecard(turns)


@query("SELECT count(*) AS rows_in, count(*) FILTER (WHERE is_active) AS rows_out, count(*) FILTER (WHERE is_active AND country IS NULL) AS missing_country, count(*) FILTER (WHERE is_active AND remote) AS remote_rows, count(*) FILTER (WHERE NOT is_active) AS dropped FROM v_jobs")
def agg28_clean_metrics(spark, d):
    jobs = views.jobs(spark, d)
    return quality.clean_metrics(jobs, jobs.where("is_active"))


@query("SELECT 'jobs' AS layer, count(*) AS n FROM v_jobs UNION ALL SELECT 'active', count(*) FROM v_jobs WHERE is_active UNION ALL SELECT 'job_skills', count(*) FROM v_job_skills UNION ALL SELECT 'skills', count(*) FROM v_skills")
def set01_layer_counts(spark, d):
    jobs = views.jobs(spark, d)
    return quality.layer_counts({"jobs": jobs, "active": jobs.where("is_active"), "job_skills": views.job_skills(spark, d), "skills": views.skills(spark, d)})


@query("SELECT source_type, count(*) AS n FROM v_job_skills GROUP BY 1")
def set02_skill_sources(spark, d):
    own = views.job_skills(spark, d)
    parts = [own.where(F.col("source_type") == k) for k in skills.SOURCES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("source_type").agg(F.count("*").alias("n"))


@query(f", a AS (SELECT job_id, list(DISTINCT canonical_name) AS l FROM v_job_skills JOIN v_skills USING (skill_id) GROUP BY 1) SELECT job_id, CAST(len(list_filter(l, lambda x: lower(x) IN {USER_SQL})) AS INT) AS n_match, CAST(len(list_filter(l, lambda x: lower(x) NOT IN {USER_SQL})) AS INT) AS n_missing, CAST(round_even(100.0 * len(list_filter(l, lambda x: lower(x) IN {USER_SQL})) / len(l), 0) AS INT) AS match_pct FROM a")
def set03_compare_skills(spark, d):
    listed = views.job_skills(spark, d).join(skills.small(views.skills(spark, d)), "skill_id").groupBy("job_id").agg(F.collect_set("canonical_name").alias("l"))
    c = skills.compare_skills(F.array(*(F.lit(u) for u in USER)), F.col("l"))
    return listed.select("job_id", c.alias("c")).select("job_id", F.size("c.match").alias("n_match"), F.size("c.missing").alias("n_missing"), "c.match_pct")


@query("SELECT job_id, unnest(list_filter([CASE WHEN NOT salary_from <= salary_to THEN 'salary_range' END, CASE WHEN NOT salary_from > 5000 THEN 'low_pay' END, CASE WHEN NOT currency <> 'RUB' THEN 'foreign' END], lambda x: x IS NOT NULL)) AS rule FROM v_jobs")
def dq01_violations(spark, d):
    rules = {"salary_range": F.col("salary_from") <= F.col("salary_to"), "low_pay": F.col("salary_from") > 5000, "foreign": F.col("currency") != "RUB"}
    return quality.violations(views.jobs(spark, d), rules).select("job_id", "rule")


@query("SELECT count(*) AS total, count(*) FILTER (WHERE text IS NULL OR trim(text) = '') AS no_text, count(*) FILTER (WHERE source IS NULL) AS no_source FROM documents")
def dq02_missing_counts(spark, d):
    return quality.counts_where(table(spark, d, "documents"), {"no_text": X.is_missing(F.col("text")), "no_source": F.col("source").isNull()})


@query(SAL_V2.format(n=1) + ROLE_V2.format(n=1) + " SELECT 'tiny_sample' AS layer, count(*) AS n FROM sal2 WHERE sample_size <= 1 UNION ALL SELECT 'unordered', count(*) FROM sal2 WHERE p25 > p50 OR p50 > p75 UNION ALL SELECT 'negative_competition', count(*) FROM role2 WHERE competition_proxy < 0")
def dq04_mart_checks(spark, d):
    b = base(spark, d)
    return quality.mart_checks(marts.salary_agg_v2(b, 1), marts.role_stats_v2(b, 1))


@query(", a AS (SELECT job_id, count(*) AS n_array FROM v_job_skills GROUP BY 1), b AS (SELECT job_id, count(DISTINCT skill_id) AS n_bridge FROM v_job_skills GROUP BY 1) SELECT job_id, CAST(n_array AS INT) AS n_array, n_bridge FROM a JOIN b USING (job_id) WHERE n_array <> n_bridge")
def dq05_bridge_reconcile(spark, d):
    own = views.job_skills(spark, d)
    arrays = own.groupBy("job_id").agg(F.collect_list(F.col("skill_id").cast("string")).alias("listed"))
    return quality.bridge_reconcile(arrays, own, "listed")


# ---- sort, top-k, sampling ------------------------------------------------------------------


@query("SELECT job_id, salary_to, published_at FROM v_jobs ORDER BY salary_to DESC NULLS LAST, published_at DESC NULLS FIRST, job_id LIMIT 50 OFFSET 20")
def srt01_page(spark, d):
    return views.jobs(spark, d).select("job_id", "salary_to", "published_at").orderBy(F.col("salary_to").desc_nulls_last(), F.col("published_at").desc_nulls_first(), "job_id").offset(20).limit(50)


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 20")
def srt02_top_sources(spark, d):
    return quality.top_values(table(spark, d, "documents"), "source", 20)


@query("SELECT seniority AS value, count(*) AS n FROM v_jobs GROUP BY 1")
def srt03_enum_order(spark, d):
    counted = quality.distribution(views.jobs(spark, d), "seniority")
    return quality.order_by_enum(counted, "value", ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"])


@query()
def srt04_spot_check(spark, d):
    return quality.spot_check(table(spark, d, "documents").select("doc_id", "source", "n_chars"), 20, "doc_id")


# ---- deduplication and merge ----------------------------------------------------------------


@query("SELECT min(doc_id) AS doc_id, source, lang FROM documents GROUP BY source, lang")
def ded01_dedupe(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", F.col("lang").alias("source_job_id"), F.lit(None).cast("string").alias("url"), F.col("doc_id").cast("string").alias("job_id"), F.lit("t").alias("title"), F.lit("c").alias("company_name"))
    return merge.dedupe(rows, "doc_id").select("doc_id", "source", F.col("source_job_id").alias("lang"))


@query(OLD_NEW + "SELECT coalesce(n.job_id, o.job_id) AS job_id, coalesce(n.source, o.source) AS source, CASE WHEN n.job_id IS NOT NULL THEN n.salary_from ELSE o.salary_from END AS salary_from, CASE WHEN n.job_id IS NOT NULL THEN n.salary_to ELSE o.salary_to END AS salary_to FROM old o FULL JOIN new n ON n.job_id = o.job_id")
def ded02_merge_latest(spark, d):
    return merge.merge_latest(*snapshots(spark, d), ["job_id"])


#: One number a line: lines may share their order and number.
LINE_SQL = "((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey % 1000"


def line_number() -> Column:
    return ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")) * 1000 + F.col("l_suppkey") % 1000


def greedy(rows: str) -> str:
    """Rounds over rows (k, a, b) with two keys, null where they bind nothing."""
    return f"""WITH RECURSIVE r(k, a, b, state) AS (SELECT k, a, b, 'open' FROM ({rows}) UNION ALL
SELECT k, a, b, CASE WHEN won THEN 'kept' ELSE 'open' END FROM (
  SELECT *, a IS NOT NULL AND max(won::INT) OVER (PARTITION BY a) = 1 OR b IS NOT NULL AND max(won::INT) OVER (PARTITION BY b) = 1 AS lost FROM (
    SELECT k, a, b, (a IS NULL OR k = max(k) OVER (PARTITION BY a)) AND (b IS NULL OR k = max(k) OVER (PARTITION BY b)) AS won FROM r WHERE state = 'open')) WHERE won OR NOT lost)
SELECT k FROM r WHERE state = 'kept'"""


@query(greedy(f"SELECT {LINE_SQL} AS k, l_orderkey || '/' || l_partkey AS a, l_orderkey || '/' || l_suppkey AS b FROM lineitem"))
def ded03_dedupe_multi(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", line_number().alias("k"))
    return merge.dedupe_multi(rows, "k", [["l_orderkey", "l_partkey"], ["l_orderkey", "l_suppkey"]]).select("k")


@query(greedy(f"SELECT {LINE_SQL} AS k, CASE WHEN l_returnflag <> 'N' THEN l_partkey || l_returnflag END AS a, CASE WHEN l_linenumber < 6 THEN l_suppkey || '/' || l_linenumber || l_linestatus END AS b FROM lineitem"))
def ded03_chained_conflicts(spark, d):
    """Keys of many rivals each, so that decisions depend on one another over rounds; a third of the rows has a blank part."""
    rows = table(spark, d, "lineitem").select("l_partkey", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("flag"), "l_suppkey", "l_linestatus", F.when(F.col("l_linenumber") < 6, F.col("l_linenumber")).alias("line"), line_number().alias("k"))
    return merge.dedupe_multi(rows, "k", [["l_partkey", "flag"], ["l_suppkey", "line", "l_linestatus"]]).select("k")


@query("SELECT max(page_id) AS page_id, split_part(url, '?', 1) AS url FROM pages GROUP BY 2")
def ded04_dedupe_url(spark, d):
    return merge.dedupe_url(table(spark, d, "pages").select("page_id", "url"), "page_id").select("page_id", merge.url_key(F.col("url")).alias("url"))


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2 HAVING count(*) > 1")
def ded06_dup_report(spark, d):
    return merge.dup_report(table(spark, d, "documents"), ["source", "lang"])


@query(OLD_NEW + "SELECT job_id, salary_from FROM new WHERE job_id NOT IN (SELECT job_id FROM old)")
def snk04_append_new(spark, d):
    old, new = snapshots(spark, d)
    return merge.append_new(old, new, "job_id").select("job_id", "salary_from")


@query(OLD_NEW + "SELECT n.job_id, CASE WHEN o.job_id IS NULL THEN 'inserted' WHEN n.salary_from IS NOT DISTINCT FROM o.salary_from AND n.salary_to IS NOT DISTINCT FROM o.salary_to THEN 'unchanged' ELSE 'updated' END AS action FROM new n LEFT JOIN old o ON o.job_id = n.job_id")
def mrg02_audit(spark, d):
    old, new = (x.withColumn("content_hash", merge.content_hash(["salary_from", "salary_to"])) for x in snapshots(spark, d))
    return merge.classify_changes(old, new).select("job_id", "action")


@query(OLD_NEW + "SELECT coalesce(n.job_id, o.job_id) AS job_id, coalesce(n.salary_from, o.salary_from) AS salary_from, coalesce(n.salary_to, o.salary_to) AS salary_to FROM old o FULL JOIN new n ON n.job_id = o.job_id")
def mrg03_upsert_coalesce(spark, d):
    return merge.upsert_coalesce(*(x.drop("source") for x in snapshots(spark, d)), "job_id")


def registry_after(spark, d):
    old, new = snapshots(spark, d)
    before = old.select("job_id", "source", F.lit("r1").alias("first_seen_run_id"), F.lit("r1").alias("last_seen_run_id"), F.lit(True).alias("is_active"))
    return merge.merge_registry(before, new.where("source <> 'src2'"), "r2")


@query(OLD_NEW + "SELECT coalesce(n.job_id, o.job_id) AS job_id, coalesce(n.source, o.source) AS source, CASE WHEN o.job_id IS NULL THEN 'r2' ELSE 'r1' END AS first_seen_run_id, CASE WHEN n.job_id IS NULL THEN 'r1' ELSE 'r2' END AS last_seen_run_id, TRUE AS is_active FROM old o FULL JOIN (SELECT * FROM new WHERE source <> 'src2') n ON n.job_id = o.job_id")
def mrg04_registry(spark, d):
    return registry_after(spark, d)


@query(OLD_NEW + "SELECT coalesce(n.job_id, o.job_id) AS job_id, (n.job_id IS NOT NULL OR o.source = 'src2') AS is_active FROM old o FULL JOIN (SELECT * FROM new WHERE source <> 'src2') n ON n.job_id = o.job_id")
def mrg05_archive(spark, d):
    return merge.deactivate_missing(registry_after(spark, d), "r2").select("job_id", "is_active")


@query(OLD_NEW + "SELECT n.job_id, CASE WHEN o.job_id IS NOT NULL AND n.salary_from IS NOT DISTINCT FROM o.salary_from AND n.salary_to IS NOT DISTINCT FROM o.salary_to THEN 'embedded' ELSE 'pending' END AS embedding_status FROM new n LEFT JOIN old o ON o.job_id = n.job_id")
def mrg06_embedding_status(spark, d):
    old, new = (x.withColumn("content_hash", merge.content_hash(["salary_from", "salary_to"])) for x in snapshots(spark, d))
    return merge.embedding_status(old.withColumn("embedding_status", F.lit("embedded")), new).select("job_id", "embedding_status")


@query("SELECT job_id FROM v_jobs WHERE job_id % 3 = 0 ORDER BY published_at NULLS FIRST, job_id LIMIT 100")
def mrg07_embed_queue(spark, d):
    rows = views.jobs(spark, d).select("job_id", "title", F.array(F.lit("x")).alias("skills"), F.when(F.col("job_id") % 3 == 0, "pending").otherwise("embedded").alias("embedding_status"), F.col("published_at").alias("updated_at"))
    return merge.embed_queue(rows, 100).select("job_id")


@query("SELECT job_id FROM v_jobs WHERE NOT is_active AND job_id % 3 <> 0")
def mrg07_evict_queue(spark, d):
    rows = views.jobs(spark, d).select("job_id", "is_active", F.when(F.col("job_id") % 3 == 0, "pending").otherwise("embedded").alias("embedding_status"))
    return merge.evict_queue(rows.drop("is_active"), rows).select("job_id")


@query("SELECT job_id, CASE WHEN salary_to > salary_from THEN salary_from ELSE coalesce(CASE WHEN salary_to < salary_from THEN salary_to END, salary_from) END AS salary_from FROM v_jobs WHERE job_id % 11 <> 0")
def mrg08_normalize_record(spark, d):
    rows = views.jobs(spark, d).select(F.when(F.col("job_id") % 11 != 0, F.col("job_id")).alias("job_id"), F.lit("s").alias("source"), "title", "salary_from", "salary_to", "seniority")
    return merge.normalize_record(rows)[0].select(F.col("job_id").cast("long").alias("job_id"), "salary_from")


@query("SELECT user_id AS source, max(CASE WHEN event_type = 'error' THEN value END) AS fail_count FROM events WHERE event_type = 'error' GROUP BY 1")
def mrg09_merge_status(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'").select(F.col("user_id").alias("source"), F.col("value").alias("fail_count"), "event_id")
    return merge.merge_status(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "source").select("source", "fail_count")


HEALTH = """WITH l AS (SELECT user_id AS source, ts, event_id, event_type <> 'error' AS ok, CASE event_id % 3 WHEN 0 THEN 'permanent' WHEN 1 THEN 'temporary' ELSE 'other' END AS reason,
row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
w AS (SELECT source, max(CASE WHEN ok THEN k END) AS won, max(CASE WHEN NOT ok THEN k END) AS lost FROM l GROUP BY 1),
f AS (SELECT w.source, count(*) FILTER (WHERE NOT l.ok AND l.k > coalesce(w.won, 0)) AS fail_count, max(CASE WHEN l.k = w.lost THEN reason END) AS last_reason FROM w JOIN l ON l.source = w.source GROUP BY 1)
SELECT source, fail_count, last_reason, fail_count < CASE last_reason WHEN 'permanent' THEN 2 WHEN 'temporary' THEN 5 ELSE 3 END AS is_active FROM f"""


@query(HEALTH)
def hlt01_source_health(spark, d):
    return merge.source_health(health_log(spark, d))


@query("SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k = 1 OR event_type IS DISTINCT FROM b")
def his01_change_points(spark, d):
    rows = table(spark, d, "events").withColumn("at", F.struct("ts", "event_id"))
    return merge.change_points(rows, "user_id", "at", ["event_type"]).select("event_id")


@query("SELECT conv_id, turn, sha1(text) AS description_hash FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) WHERE k = 1 OR text IS DISTINCT FROM b")
def his02_content_snapshots(spark, d):
    return merge.content_snapshots(table(spark, d, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "description_hash")


# ---- matching and market questions ----------------------------------------------------------


def mid_base(spark, d):
    b = base(spark, d).withColumn("remote", F.col("is_remote"))
    return b.join(views.jobs(spark, d).select("job_id", "published_at"), "job_id")


DETAIL = f""", o AS (SELECT DISTINCT job_id, skill_id, canonical_name, lower(canonical_name) IN {USER_SQL} AS mine FROM v_job_skills JOIN v_skills USING (skill_id)),
md AS (SELECT job_id, count(*) AS total_job_skills, count(*) FILTER (WHERE mine) AS matched_count, string_agg(CASE WHEN mine THEN canonical_name END, ',' ORDER BY canonical_name) AS matched, coalesce(string_agg(CASE WHEN NOT mine THEN canonical_name END, ',' ORDER BY canonical_name), '') AS missing FROM o GROUP BY 1)"""


@query(DETAIL + " SELECT count(*) AS total_matching_jobs, round(avg(100.0 * matched_count / 3), 1) AS avg_coverage_pct, round(avg(100.0 * matched_count / total_job_skills), 1) AS avg_fit_pct, round(quantile_cont(salary_mid, 0.5), 2) AS median_salary FROM md JOIN v_base USING (job_id) WHERE matched_count >= 1 AND is_remote")
def mat01_matching_jobs_count(spark, d):
    return match.matching_jobs_count(mid_base(spark, d), views.job_skills(spark, d), views.skills(spark, d), USER, remote_only=True)


@query(DETAIL + " SELECT job_id, matched, missing, matched_count, total_job_skills, round(100.0 * matched_count / 3, 1) AS user_coverage_pct, round(100.0 * matched_count / total_job_skills, 1) AS job_fit_pct, salary_mid FROM md JOIN v_base USING (job_id) WHERE matched_count >= 1 ORDER BY job_fit_pct DESC, matched_count DESC, published_at DESC NULLS LAST, job_id LIMIT 50")
def mat02_matching_jobs(spark, d):
    out = match.matching_jobs(mid_base(spark, d), views.job_skills(spark, d), views.skills(spark, d), USER)
    return out.select("job_id", F.array_join("matched_skills", ",").alias("matched"), F.array_join("missing_skills", ",").alias("missing"), "matched_count", "total_job_skills", "user_coverage_pct", "job_fit_pct", "salary_mid")


TOP = ROLE_V2.format(n=LEAST) + SKILL_V2.format(n=LEAST) + """, sel AS (SELECT * FROM role2 WHERE country = 'NATION_3'), mk AS (
SELECT canonical_name AS skill_name, category, sum(s.jobs_with_skill) AS jobs_with_skill, (SELECT sum(jobs_count) FROM sel) AS jobs_total, round(100.0 * sum(s.jobs_with_skill) / (SELECT sum(jobs_count) FROM sel), 1) AS share_pct,
round(sum(s.median_with * s.jobs_with_skill) / sum(CASE WHEN s.median_with IS NOT NULL THEN s.jobs_with_skill END), 0) AS salary_median_with, round(sum(s.salary_delta * s.jobs_with_skill) / sum(CASE WHEN s.salary_delta IS NOT NULL THEN s.jobs_with_skill END), 0) AS salary_delta
FROM skill2 s JOIN sel USING (role, country, seniority, is_remote) JOIN v_skills USING (skill_id) GROUP BY 1, 2 ORDER BY share_pct DESC, jobs_with_skill DESC, skill_name LIMIT 100)"""


def market(spark, d, n=100, least=LEAST, **filters):
    """Marts are built for the market only: filters name whole slices."""
    b = match.market_filter(base(spark, d), **filters)
    own = views.job_skills(spark, d)
    slices = b.groupBy(*marts.SLICE).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return match.top_skills_for_market(marts.role_stats_v2(b, least), marts.skill_stats_v2(b, own, least), b, own, views.skills(spark, d), n, slices, **filters)


@query(TOP.replace("NATION_3", "{c}") + " SELECT skill_name, category, CAST(jobs_with_skill AS BIGINT) AS jobs_with_skill, CAST(jobs_total AS BIGINT) AS jobs_total, share_pct, salary_median_with, salary_delta FROM mk")
def mat03_top_skills(spark, d):
    return market(spark, d, country=COUNTRY)


@query(TOP.replace("NATION_3", "{c}") + f" SELECT skill_name, category, share_pct, salary_delta, round(share_pct + coalesce(CASE WHEN salary_delta IS NOT NULL THEN greatest(salary_delta, 0) END / nullif((SELECT max(greatest(coalesce(salary_delta, 0), 0)) FROM mk), 0) * 20, 0), 1) AS priority_score FROM mk WHERE lower(skill_name) NOT IN {USER_SQL} AND share_pct >= 5 ORDER BY priority_score DESC, share_pct DESC, skill_name LIMIT 15")
def mat04_skill_gap(spark, d):
    return match.skill_gap(market(spark, d, country=COUNTRY), USER)


@query(SAL_V2.format(n=LEAST) + " SELECT role, country, seniority, CAST(sum(sample_size) AS BIGINT) AS sample_size, round(sum(p25 * sample_size) / sum(sample_size), 0) AS p25, round(sum(p50 * sample_size) / sum(sample_size), 0) AS p50, round(sum(p75 * sample_size) / sum(sample_size), 0) AS p75, round(sum(avg_salary * sample_size) / sum(sample_size), 0) AS avg_salary FROM sal2 GROUP BY 1, 2, 3")
def mat05_salary_benchmark(spark, d):
    return match.salary_benchmark(marts.salary_agg_v2(base(spark, d), LEAST))


@query("SELECT count(*) AS sample_size, round(quantile_cont(salary_mid, 0.25), 2) AS p25, round(quantile_cont(salary_mid, 0.5), 2) AS p50, round(quantile_cont(salary_mid, 0.75), 2) AS p75, round(avg(salary_mid), 0) AS avg_salary FROM v_base WHERE salary_mid IS NOT NULL AND is_remote")
def mat05_salary_benchmark_live(spark, d):
    return match.salary_benchmark_live(mid_base(spark, d), remote_only=True)


@query(ROLE_V2.format(n=LEAST) + SKILL_V2.format(n=LEAST) + """, rs AS (SELECT role, seniority, CAST(sum(jobs_count) AS BIGINT) AS jobs_count, round(sum(median_salary * jobs_count) / sum(CASE WHEN median_salary IS NOT NULL THEN jobs_count END), 0) AS median_salary, round(sum(avg_salary * jobs_count) / sum(CASE WHEN avg_salary IS NOT NULL THEN jobs_count END), 0) AS avg_salary, round(sum(competition_proxy * jobs_count) / sum(jobs_count), 2) AS competition_proxy FROM role2 WHERE country = '{c}' GROUP BY 1, 2),
tk AS (SELECT role, seniority, canonical_name, row_number() OVER (PARTITION BY role, seniority ORDER BY sum(jobs_with_skill) DESC, canonical_name) AS k FROM skill2 JOIN v_skills USING (skill_id) WHERE country = '{c}' GROUP BY role, seniority, canonical_name)
SELECT rs.*, (SELECT string_agg(canonical_name, ',' ORDER BY k) FROM tk WHERE tk.role = rs.role AND tk.seniority = rs.seniority AND k <= 5) AS top_skills FROM rs ORDER BY jobs_count DESC, role, seniority LIMIT 30""")
def mat06_country_overview(spark, d):
    b = base(spark, d)
    out = match.country_overview(marts.role_stats_v2(b, LEAST), marts.skill_stats_v2(b, views.job_skills(spark, d), LEAST), views.skills(spark, d), COUNTRY)
    return out.withColumn("top_skills", F.array_join("top_skills", ","))


@query(DETAIL + " SELECT country, count(*) AS matching_jobs, round(avg(100.0 * matched_count / 3), 1) AS avg_coverage_pct, round(quantile_cont(salary_mid, 0.5), 2) AS median_salary FROM md JOIN v_base USING (job_id) WHERE matched_count >= 1 GROUP BY 1 ORDER BY matching_jobs DESC, country LIMIT 10")
def mat07_best_countries(spark, d):
    return match.best_countries(base(spark, d), views.job_skills(spark, d), views.skills(spark, d), USER).drop("top_matched_skills")


@query("SELECT CASE WHEN is_remote THEN 'remote' ELSE 'on_site' END AS work_format, count(*) AS jobs_count, round(quantile_cont(salary_mid, 0.5), 2) AS median_salary, round(avg(salary_mid), 1) AS avg_salary FROM v_base GROUP BY 1")
def mat08_remote_comparison(spark, d):
    return match.remote_comparison(base(spark, d))


@query(DETAIL + " SELECT job_id, CAST(round_even(100.0 * matched_count / total_job_skills, 0) AS INT) AS pct, CASE WHEN total_job_skills > matched_count THEN CAST(least(95, round_even(100.0 * matched_count / total_job_skills, 0) + 15) AS INT) ELSE CAST(round_even(100.0 * matched_count / total_job_skills, 0) AS INT) END AS projected, CAST(least(5, total_job_skills - matched_count) AS INT) AS n_missing, round_even(100.0 * matched_count / total_job_skills, 0) < 50 AS weak FROM md")
def mat09_resume_fit(spark, d):
    listed = views.job_skills(spark, d).join(skills.small(views.skills(spark, d)), "skill_id").groupBy("job_id").agg(F.collect_set("canonical_name").alias("l"))
    f = match.resume_fit(F.array(*(F.lit(u) for u in USER)), F.col("l"))
    return listed.select("job_id", f.alias("f")).select("job_id", "f.pct", "f.projected", F.size("f.missing").alias("n_missing"), "f.weak")


@query(f"SELECT canonical_name AS skill, count(DISTINCT job_id) AS demand FROM v_job_skills JOIN v_skills USING (skill_id) WHERE lower(canonical_name) NOT IN {USER_SQL} GROUP BY 1 ORDER BY demand DESC, skill LIMIT 10")
def mat10_skills_gap(spark, d):
    named = views.job_skills(spark, d).join(skills.small(views.skills(spark, d)), "skill_id").select("job_id", F.col("canonical_name").alias("skill"))
    return match.missing_counts(named, USER, 10)


# ---- vectors --------------------------------------------------------------------------------


def vec_sides(spark, d):
    items = vector.normalised(table(spark, d, "embeddings"))
    return items, items.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("q_label"), F.col("unit").alias("q_unit"))


DOT = "round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) * list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 4)"


@query(f"SELECT query_id, vec_id, score FROM (SELECT q AS query_id, v AS vec_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, v) AS k FROM (SELECT a.vec_id AS q, b.vec_id AS v, {DOT} AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0)) WHERE k <= 10")
def vec01_topk(spark, d):
    return vector.search_exact(*vec_sides(spark, d), 10).select("query_id", "vec_id", "score")


@query(f"SELECT query_id, vec_id, score FROM (SELECT q AS query_id, v AS vec_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, v) AS k FROM (SELECT a.vec_id AS q, b.vec_id AS v, {DOT} AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.label = b.label AND a.vec_id <> b.vec_id)) WHERE k <= 5")
def vec03_similar_filtered(spark, d):
    keep = lambda p: p.same("label", "q_label") & ~p.same("vec_id_", "query_id")
    return vector.search(*vec_sides(spark, d), 5, keep, on=("label", "q_label", "vec_id")).select("query_id", "vec_id", "score")


@query()
def vec08_ann_join(spark, d):
    """Neighbours by the index, with the share of the true ten that were found and the shares of pairs scored exactly and by codes."""
    items, asked = vec_sides(spark, d)
    index = ivf.build(items)
    found, spent = ivf.search(index, asked, 10).select("query_id", "vec_id", "score"), ivf.cost(index, asked, 10)
    true = vector.search_exact(items, asked, 10).select("query_id", "vec_id", F.lit(1).alias("hit"))
    recall = true.join(found, ["query_id", "vec_id"], "left").agg(F.round(F.count("score") / F.count("hit"), 4).alias("recall"))
    return found.join(F.broadcast(recall)).withColumns({c: F.lit(round(spent[c], 4)) for c in ("scored_share", "coded_share")})  # one row


# ---- text -----------------------------------------------------------------------------------


@query("SELECT page_id, CASE WHEN url IS NULL OR lower(trim(url)) IN ('', 'nan', 'none', 'null') THEN 'https://hh.ru/' || CAST(page_id AS VARCHAR) WHEN trim(url) LIKE '//%' THEN 'https:' || trim(url) WHEN trim(url) LIKE '/%' THEN 'https://hh.ru' || trim(url) WHEN NOT regexp_matches(trim(url), '^https?://', 'i') THEN 'https://' || trim(url) ELSE trim(url) END AS fixed FROM pages")
def url01_fix_url(spark, d):
    return table(spark, d, "pages").select("page_id", L.fix_url(F.col("url"), F.lit("hh.ru"), F.col("page_id").cast("string")).alias("fixed"))


@query(r"""SELECT page_id, nullif(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(html, '<script\b.*?</script\s*>', ' ', 'gis'), '<style\b.*?</style\s*>', ' ', 'gis'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '<[^>]+>', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')), '') AS body FROM pages""")
def str03_html_text(spark, d):
    return table(spark, d, "pages").select("page_id", X.html_text(F.col("html")).alias("body"))


@query("SELECT doc_id, CASE WHEN length(regexp_replace(substring(text, 1, 2000), '[^а-яёА-ЯЁ]', '', 'g')) > 0.3 * (length(regexp_replace(substring(text, 1, 2000), '[^а-яёА-ЯЁa-zA-Z]', '', 'g'))) THEN 'Russian' ELSE 'English' END AS language FROM documents")
def cls11_language(spark, d):
    return table(spark, d, "documents").select("doc_id", X.posting_language(F.col("text")).alias("language"))


WORDS = ["the", "and", "with", "para", "der", "les", "was"]


@query(", ".join(["SELECT doc_id"] + [f"regexp_matches(' ' || lower(text) || ' ', '[^a-z0-9_+#.-]{w}[^a-z0-9_+#.-]') AS has_{w}" for w in WORDS]) + " FROM documents")
def txt01_skills(spark, d):
    found = table(spark, d, "documents").select("doc_id", X.extract_skills(F.col("text"), WORDS).alias("s"))
    return found.select("doc_id", *(F.array_contains("s", w).alias(f"has_{w}") for w in WORDS))


@query("SELECT doc_id, CASE WHEN lower(text) LIKE '%intern%' OR lower(text) LIKE '%trainee%' THEN 'x' END IS NOT NULL AS internish, CASE WHEN contains(lower(text), 'visa') THEN TRUE ELSE FALSE END AS visa FROM documents")
def cls08_visa_words(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", (X.first_keyword(t, {"intern": "intern", "trainee": "intern"}, None).isNotNull()).alias("internish"), F.lower(t).contains("visa").alias("visa"))


@query(r"""SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name), 'widget|gadget') THEN 'tool' WHEN regexp_matches(lower(p_name), 'a') THEN 'a' ELSE 'other' END AS label FROM part""")
def cls01_classify(spark, d):
    return table(spark, d, "part").select("p_partkey", X.classify(F.col("p_name"), {"tool": ["widget", "gadget"], "a": ["a"]}, "other").alias("label"))




@query("SELECT o_orderkey, CAST(floor(o_totalprice) AS DOUBLE) AS low, CAST(floor(o_totalprice * 1.5) AS DOUBLE) AS high, 'USD' AS currency, 'year' AS period FROM orders")
def sal01_salary_from_text(spark, d):
    whole = lambda c: F.floor(c).cast("long").cast("string")
    o = table(spark, d, "orders")
    text = F.concat(F.lit("Salary $"), whole(F.col("o_totalprice")), F.lit(" - $"), whole(F.col("o_totalprice") * 1.5), F.lit(" per year"))
    rows = o.select("o_orderkey", text.alias("t")).select("o_orderkey", S.salary_from_text_safe(F.col("t")).alias("s"), S.period_hint(F.col("t")).alias("period"))
    return rows.select("o_orderkey", "s.low", "s.high", "s.currency", "period")


@query("""WITH p(months, place, bonus) AS (VALUES (CAST(1 AS DOUBLE) / 12, 0, 0.05::DOUBLE), (CAST(1 AS DOUBLE), 1, 0::DOUBLE), (4.33::DOUBLE, 2, 0::DOUBLE), (21::DOUBLE, 3, 0::DOUBLE), (160::DOUBLE, 4, 0::DOUBLE)),
s AS (SELECT o_orderkey, o_totalprice * months AS v, place, CASE WHEN o_totalprice * months < 1000 THEN (1000 - o_totalprice * months) / 1000 WHEN o_totalprice * months > 30000 THEN (o_totalprice * months - 30000) / 30000 ELSE 0 END - bonus AS score FROM orders CROSS JOIN p)
SELECT o_orderkey, round_even(v, 0) AS monthly FROM s QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY score, place) = 1""")
def sal06_to_monthly(spark, d):
    p = F.col("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", S.to_monthly(p, p, F.lit("USD"), F.lit("yearly"))["high"].alias("monthly"))


@query()
def sal06_to_monthly_all(spark, d):
    """Every order; amounts outside a currency's bounds take the nearest period, which the tests check by brute force."""
    p = F.col("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", S.to_monthly(p, p, F.lit("USD"), F.lit("yearly"))["high"].alias("monthly"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 15 = 0 THEN NULL ELSE CAST(o_orderkey % 15 AS INT) END AS low FROM orders")
def exp01_years(spark, d):
    text = F.concat(F.lit("Requirements: at least "), (F.col("o_orderkey") % 15).cast("string"), F.lit(" years of experience with SQL"))
    return table(spark, d, "orders").select("o_orderkey", S.years_safe(text)["low"].alias("low"))


@query("SELECT s_suppkey, n_name AS city, CAST(NULL AS VARCHAR) AS country FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def loc02_location(spark, d):
    rows = table(spark, d, "supplier").join(skills.small(table(spark, d, "nation"), 10_000), F.col("s_nationkey") == F.col("n_nationkey"))
    place = F.concat(F.lit("Remote - "), F.col("n_name"), F.lit(", EMEA"))
    return rows.select("s_suppkey", L.city_of(place).alias("city"), L.country_from_text(place).alias("country"))


@query("SELECT job_id, substring(sha256('hh.ru:' || CAST(job_id AS VARCHAR)), 1, 32) AS id FROM v_jobs")
def hsh01_job_id(spark, d):
    return views.jobs(spark, d).select("job_id", H.job_id(F.lit("hh.ru"), F.col("job_id").cast("string"), F.lit(None), F.col("title"), F.lit(None)).alias("id"))


@query("SELECT job_id, 'passage: Specialist ' || title || ' at Company in ' || country || '. Format: ' || CASE WHEN remote THEN 'Remote' ELSE 'Office' END || '.' AS document FROM v_jobs")
def doc01_vacancy_document(spark, d):
    j = views.jobs(spark, d)
    text = H.vacancy_document(F.col("seniority"), F.col("title"), F.lit(None), F.col("country"), F.lit(None), F.when(F.col("remote"), "remote").otherwise("office"), F.array().cast("array<string>"), F.lit(None))
    return j.select("job_id", text.alias("document"))


@query()
def hsh03_uuid5(spark, d):
    return table(spark, d, "pages").select("page_id", H.uuid5(F.col("url")).alias("point_id"))


@query("SELECT conv_id, turn, CASE WHEN lower(text) LIKE '%the%' THEN 'resume' ELSE 'chat' END AS intent FROM conversations")
def cls13_intent(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.intent(F.col("text"), {"resume": ["the"]}).alias("intent"))


# ---- filters, further joins and aggregates --------------------------------------------------


@query("SELECT doc_id FROM documents WHERE lower(trim(source)) IN ('src0', 'src1')")
def flt01_valid_source(spark, d):
    return clean.valid_source(table(spark, d, "documents"), ["src0", "src1"]).select("doc_id")


@query("SELECT doc_id FROM documents WHERE trim(text) <> '' AND lower(trim(text)) NOT IN ('nan', 'none', 'null')")
def flt02_require_text(spark, d):
    return table(spark, d, "documents").where(~X.is_missing(F.col("text"))).select("doc_id")


@query("SELECT job_id FROM v_jobs WHERE is_active AND trim(title) <> ''")
def flt03_analytics_base(spark, d):
    return match.analytics_base(views.jobs(spark, d)).select("job_id")


@query("SELECT job_id FROM v_jobs WHERE country = '{c}' AND remote")
def flt04_market_filter(spark, d):
    return match.market_filter(views.jobs(spark, d), country=COUNTRY, remote_only=True).select("job_id")


@query("SELECT job_id, title, country FROM v_jobs WHERE seniority = '1-URGENT' ORDER BY published_at DESC NULLS LAST, job_id LIMIT 40")
def flt05_list_jobs(spark, d):
    rows = match.market_filter(views.jobs(spark, d), seniority="1-URGENT")
    return rows.orderBy(F.col("published_at").desc_nulls_last(), "job_id").limit(40).select("job_id", "title", "country")


@query(SKILL_V2.format(n=LEAST) + " SELECT skill_id, role, seniority, is_remote, share_pct FROM skill2 WHERE country = '{c}' ORDER BY share_pct DESC, skill_id, role, seniority, is_remote LIMIT 25")
def flt06_skills_mart(spark, d):
    out = match.market_filter(marts.skill_stats_v2(base(spark, d), views.job_skills(spark, d), LEAST), country=COUNTRY)
    return out.select("skill_id", "role", "seniority", "is_remote", "share_pct").orderBy(F.desc("share_pct"), "skill_id", "role", "seniority", "is_remote").limit(25)


@query("SELECT doc_id, contains(lower(text), 'the and') OR (contains(lower(text), 'sthe') AND contains(lower(text), 'rdand')) AS hit FROM documents")
def flt07_matches_query(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", (F.lower(t).contains("the and") | X.matches_query(t, F.lit("sthe rdand"))).alias("hit"))


PHRASES = ["deep", "sthe", "the"]


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'deep') THEN 'deep' WHEN contains(lower(text), 'sthe') THEN 'sthe' ELSE 'the' END AS q FROM documents WHERE contains(lower(text), 'deep') OR contains(lower(text), 'sthe') OR contains(lower(text), 'the')")
def flt08_first_matching_query(spark, d):
    return table(spark, d, "documents").select("doc_id", X.first_match(F.col("text"), PHRASES).alias("q")).where("q is not null")


@query("SELECT source, lang AS q, CAST(k AS INT) AS place FROM (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY first) AS k FROM (SELECT source, lang, min(doc_id) AS first FROM documents GROUP BY 1, 2)) WHERE k <= 2")
def flt09_queries_for(spark, d):
    return match.capped_queries(table(spark, d, "documents").select("source", F.col("lang").alias("q"), F.col("doc_id").alias("at")), 2)


@query("SELECT p_partkey, length(trim(p_name)) < 3 OR regexp_matches(lower(p_name), '\\bprogram\\b|\\bsummit\\b') AS suspicious FROM part")
def flt10_suspicious_title(spark, d):
    return table(spark, d, "part").select("p_partkey", X.suspicious_title(F.col("p_name")).alias("suspicious"))


@query("SELECT job_id FROM v_jobs WHERE salary_to >= 100000 OR salary_to IS NULL")
def flt12_salary_filter(spark, d):
    return match.salary_filter(views.jobs(spark, d), 100000).select("job_id")


@query("SELECT DISTINCT job_id FROM v_jobs j WHERE EXISTS (SELECT 1 FROM v_job_skills s WHERE s.job_id = j.job_id AND s.skill_id = 12)")
def jon09_semi(spark, d):
    return skills.with_skill(views.jobs(spark, d), views.job_skills(spark, d), 12).select("job_id")


@query("SELECT job_id, job_id IN (SELECT job_id FROM v_job_skills WHERE skill_id = 3) AS has_skill FROM v_jobs")
def jon13_coverage_flag(spark, d):
    return skills.skill_flag(views.jobs(spark, d), views.job_skills(spark, d), 3).select("job_id", "has_skill")


@query("SELECT canonical_name, category FROM v_skills WHERE lower(canonical_name) NOT IN ('brand#3', 'brand#12', 'brand#25')")
def jon08_missing_skills(spark, d):
    own = match.skill_ids(views.skills(spark, d), USER).select("skill_id")
    return views.skills(spark, d).join(own, "skill_id", "left_anti").select("canonical_name", "category")


@query("SELECT job_id, upper(s) AS skill FROM (SELECT job_id, unnest([currency, country]) AS s FROM v_jobs)")
def jon06_explode(spark, d):
    return skills.explode_values(views.jobs(spark, d), "job_id", F.array("currency", "country"))


@query(ROLE_V2.format(n=LEAST) + SAL_V2.format(n=LEAST) + " SELECT r.role, r.country, r.seniority, r.is_remote, jobs_count, p50 FROM role2 r JOIN sal2 s USING (role, country, seniority, is_remote)")
def jon02_join_slices(spark, d):
    b = base(spark, d)
    return marts.role_stats_v2(b, LEAST).join(marts.salary_agg_v2(b, LEAST), marts.SLICE).select(*marts.SLICE, "jobs_count", "p50")


@query(SAL_V2.format(n=LEAST) + " SELECT country, round(sum(p50 * sample_size) / sum(sample_size), 0) AS median FROM sal2 GROUP BY 1")
def agg17_weighted_rollup(spark, d):
    return marts.salary_agg_v2(base(spark, d), LEAST).groupBy("country").agg(match.weighted("p50", "sample_size").alias("median"))


@query(SCORES + " SELECT role_family, count(*) AS n, round(quantile_cont(salary_mid, 0.5), 2) AS median, round(max(salary_mid), 2) AS top, round(min(salary_mid), 2) AS low, round(max(salary_mid), 2) AS high FROM v_mid JOIN sc USING (job_id) WHERE salary_mid IS NOT NULL AND score > 0 GROUP BY 1")
def agg22_market_context_of_matches(spark, d):
    rows = fx.with_mid(views.jobs(spark, d), views.rates(spark, d), "RUB").join(scores(spark, d).where("score > 0"), "job_id")
    return match.market_context(rows, F.col("salary_mid"), ["role_family"])


@query(OLD_NEW + "SELECT action, count(*) AS n FROM (SELECT CASE WHEN o.job_id IS NULL THEN 'inserted' WHEN n.salary_from IS NOT DISTINCT FROM o.salary_from AND n.salary_to IS NOT DISTINCT FROM o.salary_to THEN 'unchanged' ELSE 'updated' END AS action FROM new n LEFT JOIN old o ON o.job_id = n.job_id) GROUP BY 1")
def agg29_load_metrics(spark, d):
    return QUERIES["mrg02_audit"](spark, d).groupBy("action").agg(F.count("*").alias("n"))


@query(OLD_NEW + "SELECT source, count(*) AS clean_rows, count(*) FILTER (WHERE salary_from IS NOT NULL) AS loaded_rows FROM new GROUP BY 1")
def agg30_manifest(spark, d):
    return quality.counts_where(snapshots(spark, d)[1], {"loaded_rows": F.col("salary_from").isNotNull()}, ["source"]).withColumnRenamed("total", "clean_rows")


@query("SELECT country, count(*) AS jobs_count FROM v_jobs WHERE is_active GROUP BY 1")
def agg16_available_countries(spark, d):
    return match.analytics_base(views.jobs(spark, d)).groupBy("country").agg(F.count("*").alias("jobs_count"))


@query("SELECT min(doc_id) AS doc_id, source FROM documents GROUP BY source")
def snk05_merge_sources(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", (-F.col("doc_id")).alias("newest"))
    return merge.merge_sources([rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1")], "source", "newest").select("doc_id", "source")


@query("SELECT base_currency, target_currency, rate_date, CAST(CASE WHEN month(rate_date) = 7 THEN rate + 1 ELSE rate END AS DOUBLE) AS rate FROM v_rates")
def snk06_upsert_rates(spark, d):
    rates = views.rates(spark, d)
    new = rates.where("month(rate_date) = 7").withColumn("rate", (F.col("rate") + 1).cast("decimal(18,6)"))
    return merge.upsert(rates, new, ["rate_date", "base_currency", "target_currency"]).select("base_currency", "target_currency", "rate_date", F.col("rate").cast("double").alias("rate"))


@query("SELECT job_id, CASE WHEN job_id % 3 = 0 THEN 'too_many' ELSE 'company_history' END AS reason FROM v_jobs WHERE job_id % 3 < 2")
def dq03_suspicious_experience(spark, d):
    k = F.col("job_id") % 3
    rows = views.jobs(spark, d).select("job_id", F.when(k == 0, 30).when(k == 1, 5).alias("years_min"), F.when(k == 1, "Our company was founded long ago").otherwise("x").alias("description"))
    return quality.suspicious_experience(rows).select("job_id", "reason")


@query("SELECT p_partkey, nullif(trim(regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-zа-яё0-9\\s+#.]', ' ', 'g'), '\\s+', ' ', 'g')), '') AS title FROM part")
def str04_normalize_title(spark, d):
    return table(spark, d, "part").select("p_partkey", X.normalize_title(F.col("p_name"), F.lit("Acme")).alias("title"))


@query("SELECT page_id, 'a,' || CAST(page_id AS VARCHAR) AS items FROM pages")
def str05_parse_array(spark, d):
    text = F.concat(F.lit("{ a , '"), F.col("page_id").cast("string"), F.lit("'}"))
    return table(spark, d, "pages").select("page_id", F.array_join(X.parse_array(text), ",").alias("items"))


@query("SELECT o_orderkey, floor(o_totalprice) * 1000 AS v FROM orders WHERE o_totalprice < 1000 UNION ALL SELECT o_orderkey, floor(o_totalprice) FROM orders WHERE o_totalprice >= 1000")
def str07_parse_number(spark, d):
    text = F.concat(F.lit("$ "), F.floor("o_totalprice").cast("long").cast("string"), F.lit("k"))
    return table(spark, d, "orders").select("o_orderkey", X.parse_number(text).alias("v"))


@query("SELECT job_id, CAST(CASE WHEN salary_from IS NOT NULL AND salary_to IS NOT NULL THEN CAST(salary_from AS VARCHAR) || ' - ' || CAST(salary_to AS VARCHAR) || ' ' || currency || ' per month' WHEN coalesce(salary_from, salary_to) IS NOT NULL THEN CAST(coalesce(salary_from, salary_to) AS VARCHAR) || ' ' || currency || ' per month' ELSE 'нет данных' END AS VARCHAR) AS t FROM v_jobs")
def str08_salary_text(spark, d):
    return views.jobs(spark, d).select("job_id", X.salary_text(F.col("salary_from"), F.col("salary_to"), F.col("currency"), F.lit(None).cast("string")).alias("t"))


@query("SELECT job_id, coalesce((salary_from + salary_to) / 2.0, salary_from, salary_to) AS mid FROM v_jobs")
def sal10_midpoint(spark, d):
    return views.jobs(spark, d).select("job_id", fx.midpoint(F.col("salary_from").cast("double"), F.col("salary_to").cast("double")).alias("mid"))


@query("SELECT job_id, round_even(salary_to * CASE currency WHEN 'USD' THEN 82.1314 WHEN 'EUR' THEN 95.0038 WHEN 'GBP' THEN 109.8261 WHEN 'PLN' THEN 22.2289 ELSE 1.0 END, 0) AS rub FROM v_jobs")
def sal11_to_rub_fallback(spark, d):
    return views.jobs(spark, d).select("job_id", S.to_rub_fallback(F.col("salary_to").cast("double"), F.col("currency")).alias("rub"))


@query("SELECT job_id, sha1(coalesce(CAST(salary_from AS VARCHAR), '') || chr(30) || coalesce(CAST(salary_to AS VARCHAR), '')) AS h FROM v_jobs")
def hsh02_content_hash(spark, d):
    return views.jobs(spark, d).select("job_id", merge.content_hash(["salary_to", "salary_from"]).alias("h"))


@query("SELECT job_id, CASE WHEN job_id % 2 = 0 THEN published_at ELSE DATE '2000-01-01' END AS d FROM v_jobs")
def dat01_effective_date(spark, d):
    published = F.when(F.col("job_id") % 2 == 0, F.col("published_at"))
    return views.jobs(spark, d).select("job_id", X.effective_date(published, F.lit(None), "2000-01-01").alias("d"))


@query(f"SELECT query_id, vec_id, total FROM (SELECT query_id, vec_id, total, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, vec_id) AS k FROM (SELECT q AS query_id, v AS vec_id, round(score + 0.15 * CASE WHEN same THEN 1 ELSE 0 END, 4) AS total FROM (SELECT a.vec_id AS q, b.vec_id AS v, a.label = b.label AS same, {DOT} AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0))) WHERE k <= 3")
def vec04_rerank_skill(spark, d):
    by_label = lambda score, p: vector.rerank_skill(score, p.same("label", "q_label"))
    return vector.search(*vec_sides(spark, d), 3, rerank=by_label, on=("label", "q_label")).select("query_id", "vec_id", F.col("score").alias("total"))


#: Country of the market questions.
COUNTRY = "NATION_3"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Salary mart; slices of at least two jobs, as the smallest tables have few."""
    return marts.salary_agg_v2(base(spark, sf_dir), least=2)


ORACLE_SQL.update({k: v.replace("{c}", COUNTRY) for k, v in ORACLE_SQL.items() if "{c}" in v})
