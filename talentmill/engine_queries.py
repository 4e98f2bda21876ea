"""Queries of dictionary joins, sorted as-of joins, histories and market questions in one plan, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentmill.functions import salary as S
from talentmill.functions import text as X
from talentmill.operators import dictionary, fx, history, marts, match, merge, quality, vector
from talentmill.plans import clean, sql, views
from talentmill.plans.views import table
from talentmill.registry import COUNTRY, DETAIL, DOT, LEAST, OLD_NEW, SAL_V2, USER_SQL, base, market, query, snapshots
from talentmill.registry import USER as WANTED
from talentmill.rule_queries import USER, raw_jobs, registered, same_as
from talentmill.sources.shared import scratch

# ---- dictionaries ---------------------------------------------------------------------------


def flat(text: str) -> str:
    return f"regexp_replace(lower({text}), '\\s+', ' ', 'g')"


#: A dictionary of some thousand entries: neighbouring words of the benchmark, and its longer words.
PAIRS_SQL = f"""SELECT DISTINCT unnest(list_concat([t[i] || ' ' || t[i + 1] for i in range(1, len(t))], [x for x in t if length(x) > 7])) AS phrase
FROM (SELECT string_split(trim({flat('text')}), ' ') AS t FROM benchmark)"""


def benchmark_phrases(spark: SparkSession, d: str) -> DataFrame:
    words = F.split(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")), " ")
    w = F.col("w")
    pairs = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.element_at(w, i), F.element_at(w, i + 1)))
    each = F.concat(F.when(F.size(w) > 1, pairs).otherwise(F.array().cast("array<string>")), F.filter(w, lambda x: F.length(x) > 7))
    return table(spark, d, "benchmark").select(words.alias("w")).select(F.explode(each).alias("phrase")).distinct()


def hit_sql(key: str, source: str, text: str, word: str, phrases: str) -> str:
    """Common tables up to h (key, phrase): phrases that a text holds between characters that are none of a word."""
    return f"""d AS ({phrases}), t AS (SELECT {key} AS key, {text} AS t FROM {source}),
h AS (SELECT key, phrase FROM t JOIN d ON contains(t, phrase) WHERE regexp_matches(t, '(^|[^{word}])' || regexp_escape(phrase) || '($|[^{word}])'))"""


SKILL = "A-Za-z0-9_+#.\\-"
TITLE = "a-zа-яё0-9"


@query("WITH " + hit_sql("doc_id", "documents", flat("coalesce(text, '')"), SKILL, PAIRS_SQL) + " SELECT doc_id, coalesce(count(phrase), 0) AS n, min(phrase) AS first, max(phrase) AS last, md5(coalesce(string_agg(phrase, '|' ORDER BY phrase), '')) AS all_of FROM documents LEFT JOIN h ON key = doc_id GROUP BY 1")
def txt01_dictionary_join(spark, d):
    """Thousands of entries, which are rows of a table, in every document."""
    found = dictionary.skills_of(table(spark, d, "documents"), "doc_id", F.col("text"), benchmark_phrases(spark, d))
    return found.select("doc_id", F.size("labels").cast("long").alias("n"), F.array_min("labels").alias("first"), F.array_max("labels").alias("last"), F.md5(F.array_join("labels", "|").cast("binary")).alias("all_of"))


NORM = "trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-zа-яё0-9+#./\\-\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
TITLES_SQL = f"SELECT DISTINCT phrase FROM (SELECT trim(regexp_replace(regexp_replace(phrase, '[^a-zа-яё0-9+#./\\-\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS phrase FROM ({PAIRS_SQL})) WHERE phrase <> ''"


@query(", " + hit_sql("conv_id || '/' || turn", "conversations", NORM, TITLE, TITLES_SQL) + """, l AS (SELECT key, phrase, row_number() OVER (PARTITION BY key ORDER BY length(phrase) DESC, phrase) AS k FROM h)
SELECT conv_id, turn, phrase AS specialty FROM conversations LEFT JOIN l ON key = conv_id || '/' || turn AND k = 1""")
def cls09_dictionary_join(spark, d):
    """The longest of thousands of phrases that each turn holds as whole words."""
    turns = table(spark, d, "conversations").withColumn("key", F.concat_ws("/", "conv_id", "turn"))
    phrases = benchmark_phrases(spark, d).select(X.norm_query(F.col("phrase")).alias("phrase")).where("phrase <> ''").distinct()
    found = dictionary.specialties(turns, "key", F.col("text"), dictionary.ranked(phrases, "phrase", [F.col("phrase")]))
    return found.select(*(F.split("key", "/")[i].cast("long").alias(c) for i, c in enumerate(("conv_id", "turn"))), F.col("label").alias("specialty"))


@query("""WITH p AS (SELECT item_id AS rank, lower(substring(text, 3, 9)) AS phrase FROM benchmark UNION ALL SELECT 1000000 + item_id, lower(substring(text, 11, 2)) FROM benchmark),
d AS (SELECT phrase, min(rank) AS rank FROM p WHERE trim(phrase) <> '' GROUP BY 1) SELECT doc_id, arg_min(phrase, rank) AS phrase FROM documents LEFT JOIN d ON contains(lower(text), phrase) GROUP BY 1""")
def flt08_dictionary_join(spark, d):
    """The first phrase by place in a list that stands anywhere in a document, also inside words; the list is a table."""
    b = table(spark, d, "benchmark")
    low = lambda start, n: F.lower(F.substring("text", start, n)).alias("phrase")
    both = b.select(F.col("item_id").alias("rank"), low(3, 9)).unionByName(b.select((F.col("item_id") + 1_000_000).alias("rank"), low(11, 2)))
    phrases = both.where(F.trim("phrase") != "").groupBy("phrase").agg(F.min("rank").alias("rank")).withColumn("label", F.col("phrase"))
    docs = table(spark, d, "documents")
    return dictionary.first_label(docs, "doc_id", dictionary.substring_hits(docs, "doc_id", F.lower(F.coalesce("text", F.lit(""))), phrases)).withColumnRenamed("label", "phrase")


# ---- as-of join by sort ---------------------------------------------------------------------


@query("SELECT job_id, currency, published_at, r AS rate FROM v_conv")
def jon04_asof_sorted(spark, d):
    """The as-of join of rate tables too large to be broadcast; months of over 100 jobs are split, so that the small tables show it."""
    out = fx.as_of_by_sort(views.jobs(spark, d), views.rates(spark, d), "RUB", date="published_at", task_rows=100)
    return out.select("job_id", "currency", "published_at", F.col("rate").cast("double").alias("rate"))


# ---- market questions in one plan, and as SQL functions -------------------------------------

#: No slice of the test tables has so many jobs: the question goes to the jobs themselves.
NONE_FITS = 1_000_000
LIVE = """, own AS (SELECT DISTINCT job_id, skill_id FROM v_job_skills), b AS (SELECT * FROM v_base WHERE {where}), s AS (SELECT skill_id, count(*) AS n, round(quantile_cont(salary_mid, 0.5), 2) AS m FROM b JOIN own USING (job_id) GROUP BY 1)
SELECT canonical_name AS skill_name, category, n AS jobs_with_skill, (SELECT count(*) FROM b) AS jobs_total, round(100.0 * n / (SELECT count(*) FROM b), 1) AS share_pct, m AS salary_median_with, CAST(NULL AS DOUBLE) AS salary_delta
FROM s JOIN v_skills USING (skill_id) ORDER BY share_pct DESC, jobs_with_skill DESC, skill_name LIMIT 100"""


@query(LIVE.format(where="country = '{c}'").replace("{c}", COUNTRY))
def mat03_top_skills_live(spark, d):
    """A market that no mart has."""
    return market(spark, d, least=NONE_FITS, country=COUNTRY)


@query(LIVE.format(where=f"country = '{COUNTRY}' AND role = 'BUILDING'"))
def udf03_top_skills_live(spark, d):
    """The SQL function for a market that no mart has."""
    sql.register(spark, views.jobs(spark, d).where("is_active"), views.rates(spark, d), views.job_skills(spark, d), views.skills(spark, d), least=(NONE_FITS, NONE_FITS, NONE_FITS))
    return sql.call(spark, f"SELECT * FROM fn_top_skills_for_market('{COUNTRY}', 'BUILDING', _limit => 100)")


same_as("udf02_matching_jobs", "mat02_matching_jobs", f"SELECT job_id, matched_skills AS matched, missing_skills AS missing, CAST(size(matched_skills) AS BIGINT) AS matched_count, CAST(size(matched_skills) + size(missing_skills) AS BIGINT) AS total_job_skills, user_skill_coverage_pct AS user_coverage_pct, job_fit_pct, salary_mid FROM fn_matching_jobs({USER})")
same_as("udf02_country_overview", "mat06_country_overview", f"SELECT * FROM fn_country_market_overview('{COUNTRY}')")
same_as("udf02_best_countries", "mat07_best_countries", f"SELECT country, matching_jobs, avg_user_skill_coverage_pct AS avg_coverage_pct, median_salary_mid AS median_salary FROM fn_best_countries_for_skills({USER}, 1, 10)")


@query(DETAIL + f" SELECT CASE WHEN is_remote THEN 'remote' ELSE 'on_site' END AS work_mode, count(*) AS matching_jobs, round(quantile_cont(salary_mid, 0.5), 2) AS median_salary_mid, round(avg(100.0 * matched_count / 3), 1) AS avg_user_skill_coverage_pct, round(avg(100.0 * matched_count / total_job_skills), 1) AS avg_job_fit_pct FROM md JOIN v_base USING (job_id) WHERE matched_count >= 1 AND country = '{COUNTRY}' GROUP BY 1")
def udf02_remote_comparison(spark, d):
    registered(spark, d)
    return sql.call(spark, f"SELECT * FROM fn_remote_comparison({USER}, 1, '{COUNTRY}')")


@query(""", day AS (SELECT rate_date, CAST(rate AS DOUBLE) AS usd FROM v_rates WHERE base_currency = 'USD'),
q AS (SELECT base_currency AS c, rate_date, round(CAST(rate AS DOUBLE) / usd, 6) AS rate FROM v_rates JOIN day USING (rate_date) UNION ALL SELECT 'RUB', rate_date, round(1.0 / usd, 6) FROM day),
i AS (SELECT *, lead(rate_date) OVER (PARTITION BY c ORDER BY rate_date) AS until FROM q),
j AS (SELECT salary_from, salary_to, CASE WHEN currency = 'USD' THEN 1.0 ELSE i.rate END AS r FROM v_jobs LEFT JOIN i ON c = currency AND published_at >= rate_date AND (until IS NULL OR published_at < until) WHERE is_active AND role_family = 'BUILDING' AND seniority = '1-URGENT'),
m AS (SELECT coalesce((round(salary_from * r, 2) + round(salary_to * r, 2)) / 2, round(salary_from * r, 2), round(salary_to * r, 2)) AS mid FROM j)
SELECT 'BUILDING' AS role, 'all' AS country, '1-URGENT' AS seniority, 'USD' AS currency, count(mid) AS sample_size, round(quantile_cont(mid, 0.25), 2) AS p25, round(quantile_cont(mid, 0.5), 2) AS p50, round(quantile_cont(mid, 0.75), 2) AS p75, round(avg(mid), 0) AS avg_salary FROM m""")
def udf02_salary_benchmark_in_usd(spark, d):
    """Pay from live jobs in a currency that the marts do not have."""
    registered(spark, d)
    return sql.call(spark, "SELECT role, country, seniority, currency, sample_size, round(p25, 2) AS p25, round(p50, 2) AS p50, round(p75, 2) AS p75, avg_salary FROM fn_salary_benchmark('BUILDING', _seniority => '1-URGENT', _target_currency => 'usd')")


# ---- histories ------------------------------------------------------------------------------

#: Days of January up to which a snapshot saw the events, in the order in which the snapshots come: some are late, one comes twice.
SNAPSHOTS = [14, 7, 31, 21, 7, 28]


@query(""", days AS (SELECT unnest([7, 14, 21, 28, 31]) AS day), o AS (SELECT user_id, day, arg_max(event_type, (ts, event_id)) AS event_type FROM events JOIN days ON ts < TIMESTAMP '2024-01-01' + to_days(CAST(day AS INT)) GROUP BY 1, 2),
c AS (SELECT *, lag(event_type) OVER w AS b, row_number() OVER w AS k FROM o WINDOW w AS (PARTITION BY user_id ORDER BY day)), p AS (SELECT * FROM c WHERE k = 1 OR event_type <> b)
SELECT user_id, day AS valid_from, lead(day) OVER (PARTITION BY user_id ORDER BY day) AS valid_to, event_type FROM p""".replace(", days", "WITH days", 1))
def his01_incremental(spark, d):
    """Validity of each user's last event as successive snapshots saw it, merged in any order."""
    e, root = table(spark, d, "events"), scratch(spark, "history")
    for day in SNAPSHOTS:
        upto = e.where(F.col("ts") < F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(F.lit(day)))
        seen = upto.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))
        history.merge_snapshot(seen, root, "user_id", day, ["event_type"])
    return history.intervals(spark, root, "user_id").select("user_id", "valid_from", "valid_to", "event_type")


# ---- checks, counters, contexts -------------------------------------------------------------

CURATED = """, c AS (SELECT job_id, 'src' || CAST(job_id % 3 AS VARCHAR) AS source, CASE WHEN job_id % 11 <> 0 THEN 'u' || CAST(job_id // 2 AS VARCHAR) ELSE ' ' END AS url, CASE WHEN job_id % 13 <> 0 THEN CAST(job_id % 4001 AS VARCHAR) END AS source_job_id,
salary_to AS salary_from, salary_from AS salary_to, years_min, CAST(job_id % 7 AS INT) AS years_max, CASE job_id % 5 WHEN 0 THEN 'senior' WHEN 1 THEN 'boss' WHEN 2 THEN NULL ELSE 'unknown' END AS seniority, CASE job_id % 3 WHEN 0 THEN 'created' WHEN 1 THEN 'done' END AS embedding_status FROM v_jobs)"""


def curated(spark: SparkSession, d: str) -> DataFrame:
    """Curated rows in which every constraint is broken by some."""
    j, key = views.jobs(spark, d), F.col("job_id")
    word = lambda n, *values: F.element_at(F.array(*(F.lit(v) for v in values)), (key % n + 1).cast("int"))
    return j.select(
        "job_id", F.concat(F.lit("src"), (key % 3).cast("string")).alias("source"), F.when(key % 11 != 0, F.concat(F.lit("u"), F.floor(key / 2).cast("string"))).otherwise(" ").alias("url"), F.when(key % 13 != 0, (key % 4001).cast("string")).alias("source_job_id"),
        F.col("salary_to").alias("salary_from"), F.col("salary_from").alias("salary_to"), "years_min", (key % 7).cast("int").alias("years_max"), word(5, "senior", "boss", None, "unknown", "unknown").alias("seniority"), word(3, "created", "done", None).alias("embedding_status"), "title",
    )


@query(CURATED + """ SELECT job_id, unnest(list_filter([CASE WHEN salary_from > salary_to THEN 'salary_range' END, CASE WHEN years_min > years_max THEN 'years_range' END, CASE WHEN seniority = 'boss' THEN 'seniority' END, CASE WHEN embedding_status = 'done' THEN 'embedding_status' END], lambda x: x IS NOT NULL)) AS rule FROM c
UNION ALL SELECT job_id, 'source_url' FROM (SELECT job_id, count(*) OVER (PARTITION BY source, url) AS n FROM c WHERE trim(url) <> '') WHERE n > 1
UNION ALL SELECT job_id, 'source_job' FROM (SELECT job_id, count(*) OVER (PARTITION BY source, source_job_id) AS n FROM c WHERE trim(source_job_id) <> '') WHERE n > 1""")
def dq01_constraints(spark, d):
    return quality.constraint_violations(curated(spark, d)).select("job_id", "rule")


@query(SAL_V2.format(n=LEAST) + " SELECT country, count(*) AS groups_count FROM sal2 GROUP BY 1")
def dq04_groups_per_country(spark, d):
    return quality.mart_groups(marts.salary_agg_v2(base(spark, d), LEAST))


@query(CURATED + " SELECT job_id, least(salary_from, salary_to) AS salary_from, greatest(salary_from, salary_to) AS salary_to, least(years_min, years_max) AS years_min, greatest(years_min, years_max) AS years_max, coalesce(seniority, 'unknown') AS seniority, CASE WHEN embedding_status = 'created' THEN 'created' ELSE 'pending' END AS embedding_status, FALSE AS relocation FROM c WHERE salary_from IS NOT NULL AND salary_to IS NOT NULL")
def mrg08_years_and_defaults(spark, d):
    good, _ = merge.normalize_record(curated(spark, d))
    return good.where("salary_from is not null and salary_to is not null").select("job_id", "salary_from", "salary_to", "years_min", "years_max", "seniority", "embedding_status", "relocation")


@query(OLD_NEW + """, n2 AS (SELECT * FROM new WHERE job_id % 11 <> 0), a AS (SELECT CASE WHEN o.job_id IS NULL THEN 'inserted' WHEN n.salary_from IS NOT DISTINCT FROM o.salary_from AND n.salary_to IS NOT DISTINCT FROM o.salary_to THEN 'unchanged' ELSE 'updated' END AS action FROM n2 n LEFT JOIN old o ON o.job_id = n.job_id)
SELECT count(*) FILTER (WHERE action = 'inserted') AS inserted, count(*) FILTER (WHERE action = 'updated') AS updated, count(*) FILTER (WHERE action = 'unchanged') AS unchanged, (SELECT count(*) FROM new WHERE job_id % 11 = 0) AS failed, (SELECT count(*) FROM old WHERE job_id NOT IN (SELECT job_id FROM n2)) AS archived FROM a""")
def agg29_load_counters(spark, d):
    """Rows without a title fail; jobs of a source that took part and were not seen are archived."""
    old, new = snapshots(spark, d)
    good, rejected = merge.normalize_record(new.withColumn("title", F.when(F.col("job_id") % 11 != 0, "x")))
    hashed = [x.withColumn("content_hash", merge.content_hash(["salary_from", "salary_to"])) for x in (old, good)]
    before = old.select("job_id", "source", F.lit("r1").alias("first_seen_run_id"), F.lit("r1").alias("last_seen_run_id"), F.lit(True).alias("is_active"))
    after = merge.deactivate_missing(merge.merge_registry(before, good, "r2"), "r2")
    return quality.load_counters(merge.classify_changes(*hashed), rejected, before, after)


@query(f""", l AS (SELECT job_id, list(DISTINCT canonical_name) AS skills FROM v_job_skills JOIN v_skills USING (skill_id) GROUP BY 1),
r AS (SELECT role_family, job_id, skills, 100.0 * len(list_filter(skills, lambda x: lower(x) IN {USER_SQL})) / len(skills) AS score FROM v_jobs JOIN l USING (job_id)),
b AS (SELECT role_family, round(avg(round(score, 1)), 1) AS match_score FROM (SELECT *, row_number() OVER (PARTITION BY role_family ORDER BY score DESC, job_id) AS k FROM r) WHERE k <= 3 GROUP BY 1),
g AS (SELECT role_family, skill, row_number() OVER (PARTITION BY role_family ORDER BY count(*) DESC, skill) AS k FROM (SELECT role_family, unnest(skills) AS skill FROM r) WHERE lower(skill) NOT IN {USER_SQL} GROUP BY 1, 2)
SELECT role_family, match_score, (SELECT string_agg(skill, ',' ORDER BY k) FROM g WHERE g.role_family = b.role_family AND k <= 10) AS skill_gaps FROM b""")
def agg24_best_and_gaps(spark, d):
    listed = views.job_skills(spark, d).join(views.skills(spark, d), "skill_id").groupBy("job_id").agg(F.collect_set("canonical_name").alias("skills"))
    score = 100.0 * F.size(F.filter("skills", lambda s: F.lower(s).isin([u.lower() for u in WANTED]))) / F.size("skills")
    results = views.jobs(spark, d).select("job_id", "role_family").join(listed, "job_id").withColumn("score", score)
    return match.best_and_gaps(results, WANTED, ["role_family"]).withColumn("skill_gaps", F.array_join("skill_gaps", ","))


@query(f"""WITH q AS (SELECT vec_id AS q, CASE WHEN vec_id % 200 = 0 THEN vec_id ELSE vec_id + 1 END AS v, CASE WHEN vec_id % 200 = 0 THEN label ELSE 3 END AS company FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT q AS query_id, b.vec_id, {DOT} AS score FROM q JOIN embeddings a ON a.vec_id = v JOIN embeddings b ON b.label <> company)
SELECT query_id, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s) WHERE k <= 5""")
def vec03_other_companies(spark, d):
    """Jobs like an indexed one, or like a text; its own company, the label, is left out."""
    items = vector.normalised(table(spark, d, "embeddings")).withColumn("company", F.col("label"))
    key = F.col("vec_id")
    jobs = items.where("vec_id % 200 = 0").select(key.alias("query_id"), key.alias("job_id"), F.lit(None).cast("int").alias("q_company"), F.lit(None).cast("array<double>").alias("q_text_unit"))
    texts = items.where("vec_id % 200 = 101").select((key - 1).alias("query_id"), (-key).alias("job_id"), F.lit(3).alias("q_company"), F.col("unit").alias("q_text_unit"))
    return vector.similar_to_jobs(items, jobs.unionByName(texts), 5).select("query_id", "vec_id", "score")


# ---- query sets, plain years, the clean dataset ---------------------------------------------


@query(""", caps AS (SELECT DISTINCT currency AS source, CASE currency WHEN 'USD' THEN 3 WHEN 'EUR' THEN 50 WHEN 'RUB' THEN 7 END AS cap FROM v_jobs WHERE currency <> 'PLN'),
f AS (SELECT currency AS source, lower(role_family || ' ' || country) AS l, min(job_id) AS first FROM v_jobs WHERE seniority IN ('1-URGENT', '5-LOW') GROUP BY 1, 2),
n AS (SELECT source, l, CAST(row_number() OVER (PARTITION BY source ORDER BY first) AS INT) AS place FROM f)
SELECT n.source, upper(l) AS q, place FROM n LEFT JOIN caps USING (source) WHERE cap IS NULL OR place <= cap""")
def flt09_categories_and_caps(spark, d):
    """Queries of two categories, with a cap for some sources; case does not make a query another."""
    j = views.jobs(spark, d)
    text = F.concat_ws(" ", "role_family", "country")
    queries = j.select(F.col("currency").alias("source"), F.col("seniority").alias("category"), F.when(F.col("job_id") % 2 == 0, F.lower(text)).otherwise(text).alias("q"), F.col("job_id").alias("at"))
    caps = j.select(F.col("currency").alias("source")).where("source <> 'PLN'").distinct().withColumn("cap", F.when(F.col("source") == "USD", 3).when(F.col("source") == "EUR", 50).when(F.col("source") == "RUB", 7))
    return match.queries_for(queries, caps, ["1-URGENT", "5-LOW"]).withColumn("q", F.upper("q"))


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 5 THEN NULL ELSE CAST(o_orderkey % 40 AS INT) END AS low, CASE o_orderkey % 6 WHEN 0 THEN CAST(o_orderkey % 40 + 2 AS INT) WHEN 5 THEN NULL ELSE CAST(o_orderkey % 40 AS INT) END AS high FROM orders""")
def exp03_years_plain(spark, d):
    """Years without context or bounds: ranges, lower and upper bounds, and single numbers, in two languages."""
    key = F.col("o_orderkey")
    n = (key % 40).cast("string")
    shapes = [F.concat(n, F.lit(" - "), (key % 40 + 2).cast("string"), F.lit(" Years, from 1 years")), F.concat(F.lit("опыт от "), n, F.lit(" лет, 1 год")), F.concat(F.lit("UP TO "), n, F.lit(" years")), F.concat(n, F.lit("+ лет")), F.concat(F.lit("about "), n, F.lit(" year")), F.concat(n, F.lit(" months"))]
    text = F.element_at(F.array(*shapes), (key % 6 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", S.years_plain(text).alias("y")).select("o_orderkey", "y.low", "y.high")


@query("SELECT CAST(job_id AS VARCHAR) AS source_job_id, 'adzuna.com' AS source, 'GERMANY' AS country, 'senior' AS seniority_normalized, CAST(4 AS INT) AS years_experience_min, TRUE AS is_data_role, CAST(NULL AS VARCHAR) AS tools, CAST(41 AS INT) AS n_columns FROM v_jobs")
def prj03_clean_dataset(spark, d):
    out = clean.clean_dataset(clean.clean(raw_jobs(spark, d)))
    return out.select("source_job_id", "source", "country", "seniority_normalized", "years_experience_min", "is_data_role", "tools", F.lit(len(out.columns)).alias("n_columns"))
