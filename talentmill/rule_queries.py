"""Queries of the text, pay, place and identifier rules, of candidate search and of the SQL functions, with their oracle SQL.

``cases`` gives each row of a table one of several texts by its key, with the row's own words behind it; the oracle gives the label."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentmill import registry
from talentmill.functions import hashing as H
from talentmill.functions import location as L
from talentmill.functions import salary as S
from talentmill.functions import text as X
from talentmill.operators import fx, match, quality, skills, vector
from talentmill.plans import clean, sql, views
from talentmill.plans.views import table
from talentmill.registry import DOT, LEAST, query, vec_sides
from talentmill.sources import boards, tables



def nothing(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def flat(c: Column) -> Column:
    return F.array_join(c, ",")


def cases(name: str, pairs: list[tuple[str, str | None]], expression: Callable[[Column], Column], own: str | None = "p_name") -> None:
    """Register a query over ``part``: a text by key and, behind it, the row's ``own`` words."""
    labels = ", ".join("NULL" if b is None else "'" + b.replace("'", "''") + "'" for _, b in pairs)

    def run(spark, d):
        text = F.element_at(F.array(*(F.lit(a) for a, _ in pairs)), (F.col("p_partkey") % len(pairs) + 1).cast("int"))
        text = F.concat(text, F.lit(" "), F.col(own)) if own else text
        return table(spark, d, "part").select("p_partkey", text.alias("t")).select("p_partkey", expression(F.col("t")).cast("string").alias("label"))

    run.__name__ = name
    query(f"SELECT p_partkey, CAST([{labels}][p_partkey % {len(pairs)} + 1] AS VARCHAR) AS label FROM part")(run)


def low_high(s: Column) -> Column:
    return F.concat_ws(" ", F.floor(s["low"]).cast("string"), F.floor(s["high"]).cast("string"), s["currency"])


cases("cls02_seniority", [("Senior Dev", "senior"), ("Junior Team Lead", "junior"), ("Ведущий инженер", "lead"), ("International Sales", "intern"), ("Head of Data", "manager"), ("Principal Engineer", "principal"), ("Dev", "unknown"), ("VP Sales", "director")], lambda c: X.seniority(c, F.lit("")))
cases("cls03_role_family", [("Data Engineer", "data_engineer"), ("ML Engineer", "ml_engineer"), ("Бэкенд", "backend_developer"), ("Cook", "other"), ("iOS Developer", "mobile_developer"), ("Product Owner", "product_manager"), ("NLP specialist", "nlp_engineer"), ("Applied Scientist", "researcher")], X.role_family)
cases("cls04_role_flags", [("Data Scientist", "1000"), ("ML engineer", "0100"), ("Python developer", "0010"), ("Business Analyst", "0001"), ("AI data analyst in python", "1111"), ("Cook", "0000")], lambda c: F.concat(*(f.cast("int").cast("string") for f in X.role_flags(c).values())))
cases("cls05_department", [("Analytics", "Data & Analytics"), ("Software", "Engineering"), ("Accounting", "Finance"), ("Recruiting", "Design"), ("Talent", "HR / Recruiting"), ("Legal team", "Legal / Compliance")], lambda c: X.department(c, F.lit(""), F.lit("")))
cases("cls06_employment_type", [("Full-time", "full_time"), ("Contractor", "contract"), ("стажировка", "internship"), ("Seasonal", "temporary"), ("freelance", "freelance"), ("part time", "part_time"), ("any", "unknown")], lambda c: X.employment_type(c, F.lit("")))
cases("cls07_remote_type", [("Hybrid dev", "hybrid"), ("On-site dev", "office"), ("Remote dev", "remote"), ("Dev", "unknown"), ("работа в офисе, удаленно", "office")], lambda c: X.remote_type(c, F.lit(""), nothing("boolean"), nothing()))
cases("cls08_visa_relocation", [("visa sponsorship available", "true|-"), ("no visa sponsorship", "true|-"), ("unable to sponsor, we relocate", "false|true"), ("nothing", "false|-"), ("переезд оплачен", "false|true")], lambda c: F.concat_ws("|", X.visa(nothing("boolean"), c).cast("string"), F.coalesce(X.relocation(nothing("boolean"), c).cast("string"), F.lit("-"))))
cases("cls09_specialty", [("Lead  Data Scientist (NLP)", "Lead Data Scientist"), ("Back-end engineer", "Backend Engineer"), ("Embedded Engineer", "Embedded Engineer"), ("UX designer", "Designer"), ("SRE", "SRE"), ("Financial analyst", "Financial Analyst"), ("Cook", None)], X.specialty)
cases("cls10_analytics_role", [("Lead  Data Scientist (NLP)", "Lead Data Scientist"), ("Back-end engineer", None), ("Embedded Engineer", None), ("Research Scientist", "Research Scientist"), ("Data architect", "Data Architect"), ("Financial analyst", "Financial Analyst"), ("Cook", None)], X.analytics_role)
cases("cls12_spoken_languages", [("Belgium", "Dutch,French"), ("Nowhere", "English"), (" JAPAN", "Japanese"), ("uae", "Arabic,English"), ("", "English")], lambda c: flat(L.spoken_languages(nothing(), c)), None)
cases("cls12_languages_given", [("Greek; Thai", "Greek; Thai"), ("[]", "German"), ('["Finnish", "Dutch"]', "Finnish,Dutch"), ("nan", "German")], lambda c: flat(L.spoken_languages(c, F.lit("GERMANY"))), None)
cases("txt01_dictionary_skills", [("We use pandas, SQL and k8s.", "sql"), ("Node JS with React.js", "node.js,react"), ("statistics in R / SAS", "r"), ("Spring Boot and CI/CD on google  cloud", "ci/cd,google cloud,spring,spring boot"), ("Plan B, goes", "")], lambda c: flat(F.array_except(X.extract_skills(c, X.D.SKILLS, X.D.SKILL_ALIASES, {"r": X.D.R_CONTEXTS}), F.array(F.lit("pandas"), F.lit("k8s")))))
cases("txt02_implied", [("We use pandas and k8s", "k8s,kubernetes,pandas,python"), ("Node JS with React.js", "javascript,node.js,react"), ("Spring Boot here", "java,spring,spring boot"), ("nextjs and kubeflow", "javascript,kubeflow,kubernetes,nextjs,python,react"), ("cooking", "")], lambda c: flat(X.text_skills(c)))
cases("txt03_normalize_skills", [("JS;Go;js ", "Go,JavaScript"), ("py", "Python"), ("питон;Питон", "Python"), ("unknown thing", "unknown thing")], lambda c: flat(skills.normalize_skills(F.split(c, ";"), {"js": "JavaScript", "py": "Python", "питон": "Python"})), None)
SYNONYMS = {"js": "JavaScript", "javascript ": "JavaScript", "react": "React", "python": "Python"}
cases("txt04_assistant_skills", [("js;react", "JavaScript,React"), ("pandas", "Pandas,Python"), ("big data;JS", "Big Data,JavaScript"), ("", "")], lambda c: flat(X.assistant_skills(F.split(c, ";"), SYNONYMS)), None)
cases("txt04_assistant_text_skills", [("I know js and React", "JavaScript,React"), ("jsx only", ""), ("Python, python!", "Python")], lambda c: flat(X.assistant_text_skills(c, SYNONYMS)))
cases("txt05_merge_sources", [("b;a", "a,b,x"), ("x", "x"), ("", ",x")], lambda c: flat(skills.merge_sources(F.split(c, ";"), F.array(F.lit("x")), nothing("array<string>"))), None)
cases("txt06_keyword_set", [("We know C++ and CI/CD", "c++,ci/cd"), ("c++20", ""), ("scrum", "scrum"), ("none", "")], lambda c: flat(X.keyword_set(c, ["C++", "CI/CD", "Scrum"])))
cases("sal01_pay_tiers", [("$100k - $150k", "100000 150000 USD"), ("100 000 - 120 000 RUB", "100000 120000 RUB"), ("от 50000 до 70000 руб", "50000 70000 RUB"), ("€ 90k", "90000 90000 EUR"), ("none", None)], lambda c: F.when(S.salary_from_text(c).isNotNull(), low_high(S.salary_from_text(c))))
cases(
    "sal02_pay_in_context",
    [("Meal $5 - $6 is paid for each day you work. Salary $100k - $120k", "100000 120000 USD"), ("We raised $100 million", None), ("Salary: $90k, gym $50", None), ("base pay $1,000 - $2,000 and so on and so forth, far behind it all, a lunch", "1000 2000 USD"), ("$70k - $80k", None)],
    lambda c: F.when(S.salary_from_text_safe(c).isNotNull(), low_high(S.salary_from_text_safe(c))),
)
cases("sal03_period_hint", [("10 / hr", "hour"), ("per annum", "year"), ("в месяц", "month"), ("weekly pay", "week"), ("daily", "day"), ("pay", None)], S.period_hint)
cases("sal04_currency_in", [("hk$ 5", "HKD"), ("¥ yuan", "CNY"), ("¥5", "JPY"), ("5 usd", "USD"), ("рублей", "RUB"), ("nothing", None)], S.currency_in)
cases("exp02_years_of_row", [("Requirements: 3-5 years of experience", "3-5"), ("You have at least 4 years experience", "4-4"), ("Our company has 20 years of experience", None), ("minimum of 2 years of experience required", "2-2"), ("none", None)], lambda c: F.concat(S.years_of_row(nothing(), nothing(), c)["low"].cast("string"), F.lit("-"), S.years_of_row(nothing(), nothing(), c)["high"].cast("string")))
cases("exp03_years_loose", [("от 3 лет", "3.0"), ("5+ years", "5.0"), ("2,5 years", "2.5"), ("1-3 года", "1.0"), ("40 years", None), ("none", None)], lambda c: S.years_loose(c)["low"])
cases("loc01_country_from_text", [("Austin, TX", "UNITED STATES"), ("Toronto, ON", "CANADA"), ("Москва", "RUSSIA"), ("Lviv", "UKRAINE"), ("Boise, Idaho", "UNITED STATES"), ("Nowhere", None), ("Québec", "CANADA")], L.country_from_text, None)
cases("loc01_country_whole_words", [("Austin, TX", "UNITED STATES"), ("Famous place", None), ("Aarhus, Denmark", "DENMARK"), ("UK", "UNITED KINGDOM")], lambda c: L.country_from_text(c, compat=False), None)
cases("loc02_city", [("Remote - Berlin, Germany", "BERLIN"), ("Springfield, Ohio", "SPRINGFIELD"), ("г. Москва", "MOSCOW"), ("Remote", None), ("Germany", None), ("Greater Warszawa area", "WARSAW"), ("a b c d, EMEA", None)], L.city_of, None)
cases("loc03_infer_country", [("|россия||", "RUSSIA"), ("||Poznan, Poland|", "POLAND"), ("|||Lyft", "UNITED STATES"), ("germany|FR||", "GERMANY"), ("|||nobody", None)], lambda c: L.infer_country(F.split_part(c, F.lit("|"), F.lit(1)), F.split_part(c, F.lit("|"), F.lit(2)), F.split_part(c, F.lit("|"), F.lit(3)), F.lit(""), F.split_part(c, F.lit("|"), F.lit(4))), None)
cases("loc04_normalize_city", [("мск", "MOSCOW"), ("nyc", "NEW YORK"), ("Nowhere", "NOWHERE"), ("n/a", None), (" ", None)], L.normalize_city, None)
cases("loc04_normalize_country", [("россия", "RUSSIA"), ("usa", "UNITED STATES"), ("Atlantis", "ATLANTIS"), ("nan", None)], L.normalize_country, None)
cases("flt13_location_mentioned", [("работа в Москве", "true"), ("работа в Перми", "false"), ("МОСКВА", "true")], lambda c: L.location_mentioned(c, F.lit("Москва")))
cases("flt10_suspicious_titles", [("Summit", "true"), ("3 x", "true"), ("12 openings for", "true"), ("Engineer 2024", "true"), ("Engineer", "false")], X.suspicious_title)
cases("cls11_languages_of_texts", [("Привет мир, это работа для вас", "Russian"), ("Hello", "English"), ("да", "English")], X.posting_language)
cases("cls13_intents", [("Let us do an interview", "interview"), ("my resume", "resume"), ("a plan please", "roadmap"), ("hello", "chat")], lambda c: X.intent(c, {"interview": ["interview"], "resume": ["resume", "cv"], "roadmap": ["roadmap", "plan "]}))
cases("str09_to_bool", [("Yes", "true"), ("0", "false"), ("?", None), (" T ", "true")], X.to_bool, None)
cases("str06_matches_query", [("Senior Data Engineer (m)", "true"), ("data engineer", "true"), ("data person", "false"), ("engineer, senior", "true")], lambda c: X.matches_query(c, F.lit("senior data engineer")))
cases("url01_fix_urls", [("//x.y/z", "https://x.y/z"), ("/jobs/1", "https://lever.co/jobs/1"), ("x.y", "https://x.y"), ("", "https://lever.co/9"), ("http://a", "http://a")], lambda c: L.fix_url(c, F.lit("lever.co"), F.lit("9")), None)
cases("str04_titles", [("Senior Dev | Acme", "senior dev"), ("Acme | Dev", "dev"), ("Dev at ACME", "dev"), ("C++/C# (m/f)", "c++ c# m f")], lambda c: X.normalize_title(c, F.lit("Acme")), None)
cases("str02_clean_text", [("<p>a&amp;b</p> <br/> c", "a&b c"), ("null", None), ("&lt;b&gt;x", "x"), ("  ", None), ("é&nbsp; 😀", "é")], lambda c: X.clean_text(c, tags=True, emoji=True), None)
cases("udf04_unescape", [("&eacute;&amp;amp;", "é&"), ("a < b", "a < b"), ("&#1078;", "ж")], lambda c: X.unescape(c, exact=True), None)


# ---- pay ------------------------------------------------------------------------------------


@query("""WITH p(period, months, place) AS (VALUES ('month', CAST(1 AS DOUBLE), 0), ('year', CAST(1 AS DOUBLE) / 12, 1), ('week', 4.33::DOUBLE, 2), ('day', 21::DOUBLE, 3), ('hour', 160::DOUBLE, 4)),
s AS (SELECT o_orderkey, period, place, CASE WHEN o_totalprice * months < 1000 THEN (1000 - o_totalprice * months) / 1000 WHEN o_totalprice * months > 30000 THEN (o_totalprice * months - 30000) / 30000 ELSE 0 END AS score FROM orders CROSS JOIN p)
SELECT o_orderkey, period FROM s QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY score, place) = 1""")
def sal05_best_period(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.best_period(F.col("o_totalprice"), F.lit("USD"), nothing()).alias("period"))


BOUNDS = "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN floor(o_totalprice % 9000) - 500 END AS a, CASE WHEN o_orderkey % 7 <> 0 THEN floor(o_totalprice % 60000) END AS b FROM orders"


def bounds_of(spark, d):
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", F.when(key % 5 != 0, F.floor(price % 9000) - 500).cast("double").alias("a"), F.when(key % 7 != 0, F.floor(price % 60000)).cast("double").alias("b"))


@query(f"""SELECT o_orderkey, CAST(coalesce(lo, hi) AS DOUBLE) AS low, CAST(coalesce(hi, lo) AS DOUBLE) AS high FROM (
SELECT o_orderkey, CASE WHEN NOT bad AND x >= 1000 THEN x END AS lo, CASE WHEN NOT bad AND y >= 1000 THEN y END AS hi FROM (
SELECT o_orderkey, x, y, coalesce(y / greatest(x, 1) > 20 AND x IS NOT NULL AND y IS NOT NULL, FALSE) AS bad FROM (
SELECT o_orderkey, CASE WHEN p > q THEN q ELSE p END AS x, CASE WHEN p > q THEN p ELSE q END AS y FROM (
SELECT o_orderkey, CASE WHEN a > 0 THEN a END AS p, CASE WHEN b > 0 THEN b END AS q FROM ({BOUNDS})))))""")
def sal07_sanitize_bounds(spark, d):
    s = S.sanitize_bounds(F.col("a"), F.col("b"), F.lit("USD"))
    return bounds_of(spark, d).select("o_orderkey", s.alias("s")).select("o_orderkey", "s.low", "s.high")


@query(f"""SELECT o_orderkey, CASE WHEN x > y THEN CASE WHEN x <= y * 3 THEN y END ELSE x END AS low, CASE WHEN x > y THEN CASE WHEN x <= y * 3 THEN x END ELSE y END AS high FROM (
SELECT o_orderkey, CASE WHEN a BETWEEN 0 AND 1e10 THEN CAST(a AS DOUBLE) END AS x, CASE WHEN b BETWEEN 0 AND 1e10 THEN CAST(b AS DOUBLE) END AS y FROM ({BOUNDS}))""")
def sal08_sanitize_range(spark, d):
    s = S.sanitize_range(F.col("a"), F.col("b"), F.lit("USD"))
    return bounds_of(spark, d).select("o_orderkey", s.alias("s")).select("o_orderkey", "s.low", "s.high")


def raw_jobs(spark, d):
    """Vacancies as raw records of a source that pays by the year."""
    j = views.jobs(spark, d)
    pay = F.concat(F.lit("Salary $"), F.coalesce(F.col("salary_to"), F.lit(70000)).cast("string"), F.lit(" per year. We use Python and SQL. Requirements: at least 4 years of experience with it."))
    return tables.ensure_columns(j.select(
        F.col("job_id").cast("string").alias("source_job_id"), F.lit("adzuna.com").alias("source"), F.concat(F.lit("Senior Data Engineer "), F.col("title")).alias("title"), pay.alias("description"), F.lit("Acme").alias("company_name"),
        F.lit("Berlin, Germany").alias("location"), F.lit("EUR").alias("currency"), F.col("salary_from").cast("double"), F.lit(None).cast("double").alias("salary_to"), F.lit("1").alias("parsed_at"),
    ))


#: Monthly bounds of raw_jobs' pay: the period that brings the greater one nearest to 1,000 to 28,000 (the year's has a bonus), then plausible values only.
PAY_SQL = """p(months, place, bonus) AS (VALUES (CAST(1 AS DOUBLE) / 12, 0, 0.05::DOUBLE), (1::DOUBLE, 1, 0::DOUBLE), (4.33::DOUBLE, 2, 0::DOUBLE), (21::DOUBLE, 3, 0::DOUBLE), (160::DOUBLE, 4, 0::DOUBLE)),
r AS (SELECT job_id, CAST(coalesce(salary_from, salary_to, 70000) AS DOUBLE) AS x, CAST(coalesce(salary_to, 70000) AS DOUBLE) AS y FROM v_jobs),
s AS (SELECT *, greatest(x, y) * months AS v FROM r CROSS JOIN p),
m AS (SELECT job_id, round_even(least(x, y) * months, 0) AS lo, round_even(greatest(x, y) * months, 0) AS hi FROM s
  QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY CASE WHEN v < 1000 THEN (1000 - v) / 1000 WHEN v > 28000 THEN (v - 28000) / 28000 ELSE 0 END - bonus, place) = 1),
pay AS (SELECT job_id, CASE WHEN lo >= 1000 THEN lo ELSE hi END AS low, hi AS high FROM m WHERE hi >= 1000 AND hi <= 140000 AND NOT hi / greatest(lo, 1) > 20)"""


@query(", " + PAY_SQL + """ SELECT CAST(v.job_id AS VARCHAR) AS source_job_id, low AS salary_from, high AS salary_to, CASE WHEN high IS NOT NULL THEN 'EUR' END AS currency, 'data_engineer' AS role_family, 'senior' AS seniority, 'GERMANY' AS country, 'BERLIN' AS city, CAST(4 AS INT) AS years_min, 'python' AS skills, 'office' AS remote_type, 'German' AS languages
FROM v_jobs v LEFT JOIN pay ON pay.job_id = v.job_id""")
def loc05_clean_plan(spark, d):
    """The full stop behind "SQL" is a character of a skill, so only Python is one here."""
    out = clean.clean(raw_jobs(spark, d))
    return out.select("source_job_id", "salary_from", "salary_to", "currency", "role_family", "seniority", "country", "city", "years_min", flat(F.col("skills")).alias("skills"), "remote_type", flat(F.col("spoken_languages")).alias("languages"))


@query("SELECT CAST(job_id AS VARCHAR) AS source_job_id, 'EUR' AS currency, 'year' AS salary_period FROM v_jobs")
def sal09_fix_salary(spark, d):
    return clean.fix_salary(raw_jobs(spark, d)).select("source_job_id", "currency", "salary_period")


# ---- sources, projections, filters ----------------------------------------------------------


@query("SELECT c_custkey, c_name AS title, TRUE AS no_pay, 'MACHINERY' = c_mktsegment AS machinery FROM customer")
def prj01_ensure_columns(spark, d):
    out = tables.ensure_columns(table(spark, d, "customer").withColumnRenamed("c_name", "title"))
    return out.select("c_custkey", "title", F.col("salary_from").isNull().alias("no_pay"), (F.col("c_mktsegment") == "MACHINERY").alias("machinery"))


@query("SELECT doc_id, lang, source FROM documents")
def prj02_drop_junk(spark, d):
    return tables.drop_junk(table(spark, d, "documents").select("doc_id", "lang", "source", F.col("text").alias("benefits"), F.col("n_chars").alias("Unnamed: 0")))


@query("SELECT job_id, title, country, seniority, salary_from, salary_to, currency FROM v_jobs")
def prj03_project(spark, d):
    return clean.project(views.jobs(spark, d)).select("job_id", "title", "country", "seniority", "salary_from", "salary_to", "currency")


@query("SELECT doc_id FROM documents WHERE doc_id % 3 <> 2")
def flt01_valid_sources(spark, d):
    source = F.element_at(F.array(F.lit(" HH.ru"), F.lit("lever.co"), F.lit("nowhere.com")), (F.col("doc_id") % 3 + 1).cast("int"))
    return clean.valid_source(table(spark, d, "documents").withColumn("source", source)).select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 5 <> 0")
def flt02_require_title(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 != 0, "t").alias("title"), F.when(F.col("doc_id") % 5 != 0, "t").alias("title_normalized"))
    return clean.require_title(rows).select("doc_id")


@query("SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'")
def flt11_geo_filter(spark, d):
    return match.geo_filter(table(spark, d, "customer").withColumnRenamed("c_mktsegment", "city"), False, "Building", "x").select("c_custkey")


@query("SELECT job_id FROM v_jobs WHERE lower(country) = 'nation_3'")
def flt11_geo_filter_of_remote(spark, d):
    return match.geo_filter(views.jobs(spark, d).withColumn("city", F.lit("x")), False, "Remote", "nation_3").select("job_id")


@query("SELECT 'arbeitnow.com' AS source, p_name AS title, p_brand AS company_name, p_partkey % 2 = 0 AS remote, CAST(p_partkey AS VARCHAR) AS source_job_id FROM part")
def src10_arbeitnow(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("slug"), nothing().alias("id"), F.col("p_name").alias("title"), F.lit("text").alias("description"), F.col("p_brand").alias("company_name"), F.lit("Berlin").alias("location"), F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("Remote OK"))).otherwise(F.array(F.lit("Office"))).alias("tags"), F.lit("2026-01-01").alias("created_at"), F.lit("https://x.y").alias("url"))
    return boards.adapt_arbeitnow(rows).select("source", "title", "company_name", "remote", "source_job_id")


@query("SELECT 'greenhouse.com' AS source, p_name AS title, p_type AS department, CAST(p_partkey AS VARCHAR) AS source_job_id FROM part")
def src11_greenhouse(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.lit("text").alias("content"), F.col("p_brand").alias("_company"), F.struct(F.lit("Berlin").alias("name")).alias("location"), F.array(F.struct(F.col("p_type").alias("name")), F.struct(F.lit("E").alias("name"))).alias("departments"), nothing().alias("updated_at"), nothing().alias("absolute_url"))
    return boards.adapt_greenhouse(rows).select("source", "title", "department", "source_job_id")


@query("SELECT 'lever.co' AS source, p_name AS title, p_type AS department, 'Full-time' AS employment_type FROM part")
def src12_lever(spark, d):
    text = F.lit("text")
    parts = F.struct(nothing().alias("department"), F.col("p_type").alias("team"), nothing().alias("group"), F.lit("Berlin").alias("location"), F.lit("Full-time").alias("commitment"))
    rows = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("text"), text.alias("description"), text.alias("descriptionPlain"), F.col("p_brand").alias("_company"), parts.alias("categories"), F.lit("https://x.y").alias("hostedUrl"))
    return boards.adapt_lever(rows).select("source", "title", "department", "employment_type")


def records(df, schema: str, **fields: Column):
    """``df`` as JSON records of a board, without the fields that are not given."""
    return df.select(F.from_json(F.to_json(F.struct(*(c.alias(n) for n, c in fields.items()))), schema).alias("r")).select("r.*")


@query("SELECT CAST(job_id AS VARCHAR) AS source_job_id, title, CASE WHEN job_id % 2 = 0 THEN 'PLN' ELSE 'GBP' END AS currency, CASE WHEN job_id % 2 = 0 THEN 'Poland' ELSE 'United Kingdom' END AS country, CASE WHEN remote THEN 'remote' ELSE 'office' END AS remote_type, CAST(salary_from AS DOUBLE) AS salary_from, 'adzuna.com' AS source FROM v_jobs")
def src07_adzuna(spark, d):
    rows = records(views.jobs(spark, d), boards.ADZUNA_JSON, id=F.col("job_id").cast("string"), title=F.col("title"), description=F.when(F.col("remote"), "Remote work").otherwise("x"), country_code=F.when(F.col("job_id") % 2 == 0, "pl").otherwise("gb"), salary_min=F.col("salary_from").cast("double"))
    return boards.adapt_adzuna(rows).select("source_job_id", "title", "currency", "country", "remote_type", "salary_from", "source")


@query("SELECT CAST(job_id AS VARCHAR) AS source_job_id, title, country || '; X' AS location, CAST(salary_from AS DOUBLE) AS salary_from, CAST(salary_to AS DOUBLE) AS salary_to, remote, 'United States' AS country FROM v_jobs")
def src08_usajobs(spark, d):
    pay = F.array(F.struct(F.col("salary_from").cast("double").alias("MinimumRange"), F.col("salary_to").cast("double").alias("MaximumRange")))
    details = F.struct(F.struct(F.when(F.col("remote"), "Telework").otherwise("On site").alias("JobSummary")).alias("Details"))
    j = F.struct(F.col("job_id").cast("string").alias("PositionID"), F.col("title").alias("PositionTitle"), F.array("country", F.lit("X")).alias("PositionLocationDisplay"), pay.alias("PositionRemuneration"), details.alias("UserArea"))
    return boards.adapt_usajobs(records(views.jobs(spark, d), boards.USAJOBS, MatchedObjectDescriptor=j)).select("source_job_id", "title", "location", "salary_from", "salary_to", "remote", "country")


@query("SELECT title, CASE WHEN job_id % 3 = 0 THEN 'https://himalayas.app/jobs/s' || CAST(job_id AS VARCHAR) WHEN job_id % 3 = 1 THEN 'https://himalayas.app/jobs/id/' || CAST(job_id AS VARCHAR) ELSE 'https://himalayas.app/jobs/generated/acme-co-' || trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') END AS url, 'USD' AS currency, TRUE AS remote FROM v_jobs")
def src09_himalayas(spark, d):
    key = F.col("job_id").cast("string")
    rows = records(views.jobs(spark, d), boards.HIMALAYAS, title=F.col("title"), companyName=F.lit("Acme & Co"), slug=F.when(F.col("job_id") % 3 == 0, F.concat(F.lit("s"), key)), id=F.when(F.col("job_id") % 3 == 1, key), url=F.lit("https://himalayas.app"))
    return boards.adapt_himalayas(rows).select("title", "url", "currency", "remote")


@query("SELECT CAST(p_partkey AS VARCHAR) AS source_job_id, p_name AS title, p_partkey % 4 = 0 AS remote FROM part WHERE p_name LIKE '%red%' AND p_partkey % 5 <> 0")
def src13_ashby(spark, d):
    key = F.col("p_partkey")
    rows = records(table(spark, d, "part"), boards.ASHBY, id=key.cast("string"), title=F.col("p_name"), locationName=F.when(key % 4 == 0, "Remote, EU").otherwise("Berlin"), isListed=key % 5 != 0)
    return boards.adapt_ashby(rows, "Red").select("source_job_id", "title", "remote")


@query("SELECT CAST(job_id AS VARCHAR) AS source_job_id, title, CASE WHEN job_id % 2 = 0 THEN 'Belarus' ELSE 'Russia' END AS country, remote, 'https://hh.ru/vacancy/' || CAST(job_id AS VARCHAR) AS url, CASE WHEN job_id % 4 = 0 THEN CAST(3 AS DOUBLE) END AS years, CAST(salary_from AS DOUBLE) AS salary_from FROM v_jobs")
def src06_hh(spark, d):
    key = F.col("job_id")
    area = F.struct(F.lit("1").alias("id"), F.when(key % 2 == 0, "Минск").otherwise("Пермь").alias("name"))
    rows = records(views.jobs(spark, d), boards.HH, id=key.cast("string"), name=F.col("title"), area=area, schedule=F.struct(F.when(F.col("remote"), "Удаленная работа").otherwise("Полный день").alias("name")), experience=F.struct(F.when(key % 4 == 0, "от 3 лет").otherwise("нет").alias("name")), salary=F.struct(F.col("salary_from").alias("from")))
    return boards.adapt_hh(rows).select("source_job_id", "title", "country", "remote", "url", F.col("years_experience_min").alias("years"), "salary_from")


@query("SELECT substring(sha256('lever.co:' || CAST(p_partkey % 50 AS VARCHAR)), 1, 32) AS job_id FROM part GROUP BY p_partkey % 50")
def ded05_distinct_ids(spark, d):
    ids = H.job_id(F.lit("lever.co"), (F.col("p_partkey") % 50).cast("string"), nothing(), F.col("p_name"), nothing())
    return boards.distinct_ids(table(spark, d, "part").select(ids.alias("job_id")))


@query("SELECT conv_id, count(*) AS turns FROM conversations GROUP BY conv_id")
def src02_read_or_empty(spark, d):
    """Turns counted; the union with a snapshot that is not there adds none."""
    none = tables.read_or_empty(spark, f"{d}/not-there.csv").select(F.col("job_id").cast("long").alias("conv_id"))
    return table(spark, d, "conversations").select("conv_id").unionByName(none).groupBy("conv_id").agg(F.count("*").alias("turns"))


# ---- identifiers and rates ------------------------------------------------------------------


@query("SELECT page_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST((strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1 AS INT), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM (SELECT page_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(url)) AS h FROM pages)")
def hsh03_point_id(spark, d):
    return table(spark, d, "pages").select("page_id", H.point_id(nothing(), nothing(), F.col("url"), nothing(), nothing()).alias("point_id"))


@query("SELECT job_id, CASE job_id % 4 WHEN 0 THEN 'Senior' WHEN 1 THEN 'Intern' WHEN 2 THEN 'Specialist' ELSE 'Lead' END AS grade, CASE WHEN remote THEN 'Remote' ELSE 'Office' END AS work_format, title FROM v_jobs")
def doc02_vacancy_payload(spark, d):
    grade = F.element_at(F.array(F.lit("senior"), F.lit("Intern "), F.lit("?"), F.lit("LEAD")), (F.col("job_id") % 4 + 1).cast("int"))
    rows = views.jobs(spark, d).withColumns({"seniority": grade, "remote_type": F.when(F.col("remote"), "remote").otherwise("onsite")})
    return rows.select("job_id", H.vacancy_payload(["title", "seniority", "remote_type"]).alias("p")).select("job_id", "p.grade", "p.work_format", "p.title")


@query("SELECT rate_date, base_currency, CAST(rate AS DOUBLE) AS rate FROM v_rates WHERE base_currency IN ('USD', 'EUR') AND month(rate_date) <> 7")
def fxr01_complete_dates(spark, d):
    rates = views.rates(spark, d).where("NOT (base_currency = 'EUR' AND month(rate_date) = 7)")
    return fx.complete_dates(rates, ["USD", "EUR"]).select("rate_date", "base_currency", F.col("rate").cast("double").alias("rate"))


@query(""", o AS (SELECT rate_date, CAST(rate AS DOUBLE) AS v, base_currency AS c FROM v_rates), days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders),
near AS (SELECT day, max(rate_date) AS rate_date FROM days JOIN (SELECT DISTINCT rate_date FROM o) ON rate_date <= day AND rate_date >= day - 10 GROUP BY day),
l AS (SELECT rate_date, v FROM o WHERE c = 'EUR')
SELECT day, near.rate_date, x.c AS currency, round(x.r, 6) AS rate FROM near JOIN (SELECT o.rate_date, o.c, l.v / o.v AS r FROM o JOIN l USING (rate_date) WHERE o.c NOT IN ('EUR', 'USD') UNION ALL SELECT rate_date, 'RUB', v FROM l UNION ALL SELECT rate_date, 'USD', 1.25 FROM l) x ON x.rate_date = near.rate_date""")
def fxr02_resolve_rates(spark, d):
    rates = views.rates(spark, d)
    primary = rates.where("base_currency = 'USD'").select("rate_date", "base_currency", F.lit(1.25).alias("rate"))
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return fx.resolve_rates(days, primary, rates).select("day", "rate_date", "currency", "rate")


@query("SELECT day, count(o_orderkey) AS n FROM (SELECT CAST(unnest(range(DATE '1995-01-01', DATE '1995-03-01', INTERVAL 1 DAY)) AS DATE) AS day) LEFT JOIN orders ON CAST(o_orderdate AS DATE) = day GROUP BY day")
def fxr03_days_between(spark, d):
    orders = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"), "o_orderkey")
    return fx.days_between(spark, "1995-01-01", "1995-02-28").join(orders, "day", "left").groupBy("day").agg(F.count("o_orderkey").alias("n"))


@query("SELECT c_custkey, CAST(c_acctbal AS BIGINT) = CAST(c_acctbal AS BIGINT) AS ok, CAST(trunc(c_acctbal) AS BIGINT) AS n FROM customer")
def str07_to_int(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.lit(True).alias("ok"), X.to_int(F.concat(F.lit(" "), F.col("c_acctbal").cast("string"))).alias("n"))


# ---- further aggregates ---------------------------------------------------------------------


@query("SELECT country AS company, count(*) AS jobs, round(100.0 * count(*) FILTER (WHERE salary_from IS NOT NULL OR salary_to IS NOT NULL) / count(*), 1) AS with_salary_pct FROM v_jobs WHERE is_active GROUP BY 1 HAVING count(*) >= 5")
def agg13_company_quality(spark, d):
    return quality.company_quality(views.jobs(spark, d).where("is_active"), "country", 5).withColumnRenamed("country", "company")


@query("SELECT role_family AS value, count(*) AS n FROM v_jobs WHERE is_active AND trim(title) <> '' GROUP BY 1 ORDER BY n DESC, value")
def agg16_available_roles(spark, d):
    return quality.available(match.analytics_base(views.jobs(spark, d)), "role_family")


@query("SELECT seniority AS value, n, CAST(row_number() OVER (ORDER BY seniority DESC) AS INT) AS place FROM (SELECT seniority, count(*) AS n FROM v_jobs WHERE is_active AND trim(title) <> '' GROUP BY 1)")
def agg16_available_seniorities(spark, d):
    order = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]
    return quality.available(match.analytics_base(views.jobs(spark, d)), "seniority", order)


# ---- candidate search -----------------------------------------------------------------------

VEC_ITEMS = "SELECT vec_id, embedding, label, CASE vec_id % 4 WHEN 0 THEN 'Senior' WHEN 1 THEN 'Lead' WHEN 2 THEN 'Middle' ELSE 'Intern' END AS grade, CASE vec_id % 3 WHEN 0 THEN 'Remote' WHEN 1 THEN 'Hybrid' ELSE 'Office' END AS fmt, CASE vec_id % 2 WHEN 0 THEN 'GERMANY' ELSE 'POLAND' END AS country, 's' || CAST(vec_id % 5 AS VARCHAR) AS s1, 's' || CAST(vec_id % 7 AS VARCHAR) AS s2, CASE WHEN vec_id % 6 <> 0 THEN 'c' || CAST(vec_id % 3 AS VARCHAR) END AS city, vec_id % 1000 AS pay FROM embeddings"


def pick(values: list[str], key: str = "vec_id") -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def vec_items(spark, d):
    numbered = lambda n: F.concat(F.lit("S"), (F.col("vec_id") % n).cast("string"))
    return vec_sides(spark, d)[0].withColumns({
        "grade": pick(["Senior", "Lead", "Middle", "Intern"]), "work_format": pick(["Remote", "Hybrid", "Office"]), "country": pick(["GERMANY", "POLAND"]), "skills": F.array(numbered(5), numbered(7)),
        "city": F.when(F.col("vec_id") % 6 != 0, F.concat(F.lit("c"), (F.col("vec_id") % 3).cast("string"))), "remote": F.col("vec_id") % 5 == 0, "salary_from": F.col("vec_id") % 1000,
    })


def vec_queries(spark, d):
    q = vec_sides(spark, d)[1]
    hundreds = (F.col("query_id") / 100).cast("long")
    return q.withColumns({
        "q_grade": F.when(hundreds % 2 == 0, "senior"), "q_formats": F.array(F.lit("hybrid")), "q_country": F.lit("germany"), "q_skills": F.array(F.lit("s0"), F.lit("s3"), F.lit("s6")),
        "q_city": F.when(hundreds % 3 != 0, F.concat(F.lit("C"), (hundreds % 3).cast("string"))), "q_relocation": hundreds % 2 == 0, "q_salary_min": F.lit(200),
    })


PAIRS = f"SELECT a.vec_id AS query_id, CAST(a.vec_id / 100 AS BIGINT) AS h, b.*, {DOT} AS score FROM embeddings a JOIN ({VEC_ITEMS}) b ON a.vec_id % 100 = 0"


@query(f"""SELECT query_id, vec_id, score, len(list_filter(['s0', 's3', 's6'], lambda x: x = s1 OR x = s2)) AS skill_match_count, round(100.0 * len(list_filter(['s0', 's3', 's6'], lambda x: x = s1 OR x = s2)) / 3, 1) AS skill_match_pct,
array_to_string(list_filter(['s0', 's3', 's6'], lambda x: x = s1 OR x = s2), ',') AS matched, array_to_string(list_filter(['s0', 's3', 's6'], lambda x: NOT (x = s1 OR x = s2)), ',') AS missing
FROM ({PAIRS}) WHERE (h % 2 <> 0 OR grade IN ('Senior', 'Lead')) AND fmt IN ('Hybrid', 'Remote') AND country = 'GERMANY' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10""")
def vec02_candidates(spark, d):
    out = vector.for_candidates(vec_items(spark, d), vec_queries(spark, d), 10)
    return out.select("query_id", "vec_id", "score", F.col("skill_match_count").cast("long").alias("skill_match_count"), "skill_match_pct", flat(F.col("matched_skills")).alias("matched"), flat(F.col("missing_skills")).alias("missing"))


@query(f"SELECT query_id, vec_id, round(0.6 * score + 0.4 * CASE WHEN label = q_label THEN 1 ELSE 0 END / 2, 4) AS total FROM (SELECT a.vec_id AS query_id, b.vec_id, a.label AS q_label, b.label, {DOT} AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY total DESC, vec_id) <= 3")
def vec05_rerank_mix(spark, d):
    mix = lambda score, p: vector.rerank_mix(score, p.same("label", "q_label"), 1)
    return vector.search(*vec_sides(spark, d), 3, rerank=mix, on=("label", "q_label")).select("query_id", "vec_id", F.col("score").alias("total"))


@query(f""", f AS (SELECT query_id, vec_id, h, city, score FROM ({PAIRS}) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 15),
m AS (SELECT *, h % 3 <> 0 AND city IS NOT NULL AND city = 'c' || CAST(h % 3 AS VARCHAR) AS own, h % 3 <> 0 AND city IS NOT NULL AS known FROM f),
n AS (SELECT query_id, vec_id, round(score + CASE WHEN own THEN 0.15 ELSE 0 END, 4) AS score FROM m WHERE h % 2 = 0 OR NOT known OR own)
SELECT query_id, vec_id, score FROM (SELECT * FROM n UNION ALL SELECT query_id, vec_id, score FROM f WHERE query_id NOT IN (SELECT query_id FROM n)) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 3""")
def vec06_search_city(spark, d):
    return vector.search_city(vec_items(spark, d), vec_queries(spark, d), 3).select("query_id", "vec_id", "score")


@query(f""", p AS (SELECT query_id, vec_id, score, (h % 3 = 0 OR city = 'C' || CAST(h % 3 AS VARCHAR) OR vec_id % 5 = 0) AND pay >= 200 AS fits FROM ({PAIRS})),
n AS (SELECT query_id, vec_id, score FROM (SELECT * FROM p WHERE fits QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 4) WHERE score >= 0.5),
g AS (SELECT query_id, vec_id, score FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 4) WHERE score >= 0.5)
SELECT * FROM n UNION ALL SELECT * FROM g WHERE query_id NOT IN (SELECT query_id FROM n)""")
def vec07_retrieve(spark, d):
    return vector.retrieve(vec_items(spark, d), vec_queries(spark, d), 4, or_remote=True, fallback=True).select("query_id", "vec_id", "score")


# ---- SQL functions --------------------------------------------------------------------------


def registered(spark, d):
    sql.register(spark, views.jobs(spark, d).where("is_active"), views.rates(spark, d), views.job_skills(spark, d), views.skills(spark, d), least=(LEAST, LEAST, LEAST))


@query("SELECT job_id, CASE WHEN currency = 'RUB' THEN CAST(salary_to AS DOUBLE) ELSE round(salary_to * r, 2) END AS converted FROM v_conv WHERE is_active")
def udf01_convert_salary(spark, d):
    registered(spark, d)
    return sql.call(spark, "SELECT job_id, converted FROM (SELECT job_id, convert_salary(salary_to, currency, 'RUB', published_at) AS converted FROM tm_jobs)")


@query("SELECT job_id, round(salary_from * r, 2) AS low, round(salary_to * r, 2) AS high FROM v_conv WHERE is_active AND (salary_from IS NOT NULL OR salary_to IS NOT NULL)")
def udf02_salary_converted(spark, d):
    registered(spark, d)
    return sql.call(spark, "SELECT job_id, low, high FROM salary_converted()")


USER = "array('Brand#3', 'Brand#12', 'Brand#25')"


def same_as(name: str, of: str, text: str) -> None:
    """A registered SQL function gives the rows of a query that has its own oracle."""

    def run(spark, d):
        registered(spark, d)
        return sql.call(spark, text)

    run.__name__ = name
    registry.QUERIES[name] = run
    registry.ORACLE_SQL[name] = registry.ORACLE_SQL[of]


same_as("udf02_matching_jobs_count", "mat01_matching_jobs_count", f"SELECT total_matching_jobs, avg_user_skill_coverage_pct AS avg_coverage_pct, avg_job_fit_pct AS avg_fit_pct, median_salary_mid AS median_salary FROM fn_matching_jobs_count({USER}, _remote_only => true)")
same_as("udf02_top_skills", "mat03_top_skills", "SELECT * FROM fn_top_skills_for_market('NATION_3', _limit => 100)")
same_as("udf02_skill_gap", "mat04_skill_gap", f"SELECT * FROM fn_skill_gap({USER}, 'NATION_3')")
same_as("udf02_salary_benchmark", "mat05_salary_benchmark", "SELECT role, country, seniority, sample_size, p25, p50, p75, avg_salary FROM fn_salary_benchmark()")
