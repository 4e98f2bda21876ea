"""The cleaning plan: raw records to the clean dataset, as one lazy lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentmill.functions import dictionaries as D
from talentmill.functions import location as L
from talentmill.functions import salary as S
from talentmill.functions import text as X
from talentmill.functions.values import SOURCES
from talentmill.operators.merge import dedupe
from talentmill.operators.skills import normalize_skills
from talentmill.sources.tables import drop_junk, ensure_columns

# Pay period by source.
SOURCE_PERIOD = {"adzuna.com": "year", "usajobs.gov": "year", "himalayas.app": "year", "hh.ru": "month"}
#: Column sets of projections.
PAYLOAD = ["job_id", "source", "url", "title", "title_normalized", "company_name", "seniority", "role_family", "specialty", "skills", "country", "city", "remote_type", "employment_type", "years_min", "years_max", "salary_from", "salary_to", "currency", "salary_from_rub", "salary_to_rub", "posting_language", "visa_sponsorship", "relocation", "description"]

# Columns of the clean dataset.
CLEAN_COLUMNS = [
    "job_id", "source_job_id", "source", "url", "title", "title_normalized", "description", "company_name", "department", "country", "city", "location", "remote", "remote_type", "employment_type",
    "seniority_normalized", "years_experience_min", "years_experience_max", "analytics_role", "analytics_row_ok", "salary_from", "salary_to", "salary_mid_monthly", "currency", "salary_from_rub", "salary_to_rub",
    "key_skills", "skills_extracted", "skills_normalized", "tech_stack_tags", "tools", "methodologies", "spoken_languages", "is_data_role", "is_ml_role", "is_python_role", "is_analyst_role",
    "visa_sponsorship", "relocation", "published_at", "parsed_at",
]
#: Names that ``clean`` uses for columns of the clean dataset.
OWN_NAMES = {"seniority_normalized": "seniority", "years_experience_min": "years_min", "years_experience_max": "years_max"}


def valid_source(df: DataFrame, sources: list[str] = SOURCES) -> DataFrame:
    return df.where(F.lower(F.trim("source")).isin(sources))


def require_title(df: DataFrame) -> DataFrame:
    return df.where("title is not null and title_normalized is not null")


def fix_salary(df: DataFrame) -> DataFrame:
    """Bounds per month: given values, completed from the text where one is missing, then made plausible."""
    missing = F.col("salary_from").isNull() | F.col("salary_to").isNull()
    parsed = df.withColumn("_p", F.when(missing, S.salary_from_text_safe(F.coalesce("description", F.lit("")))))
    given = S.currency_code(F.col("currency"))
    own = parsed.withColumns({
        "salary_from": F.coalesce("salary_from", F.col("_p.low")),
        "salary_to": F.coalesce("salary_to", F.col("_p.high")),
        "currency": F.coalesce(given, F.when(missing, F.col("_p.currency"))),
        "salary_period": F.coalesce(X.first_non_null(F.col("salary_period")), S.lookup(SOURCE_PERIOD, F.lower(F.trim("source"))), F.when(missing, S.period_hint(F.coalesce("description", F.lit(""))))),
        "salary_text_raw": F.col("_p.raw"),
    })
    monthly = own.withColumn("_m", S.to_monthly(F.col("salary_from"), F.col("salary_to"), F.col("currency"), F.col("salary_period")))
    sane = monthly.withColumn("_s", S.sanitize_bounds(F.col("_m.low"), F.col("_m.high"), F.col("currency")))
    return sane.withColumns({"salary_from": F.col("_s.low"), "salary_to": F.col("_s.high")}).drop("_p", "_m", "_s")


def clean(raw: DataFrame, order: str = "parsed_at", phrases: list[str] = D.SPECIALTY_PHRASES, synonyms: dict[str, str] | None = None, exact: bool = False) -> DataFrame:
    """Clean dataset of a run. ``order`` says which of equal records comes first; search phrases and synonyms of skills are parameters."""
    df = dedupe(valid_source(drop_junk(ensure_columns(raw))), order)

    def tidy(name: str, **how: bool) -> Column:
        """The cleaned column, its text bound once: rules of many columns else grow into one method of generated code."""
        return X.clean_text(F.col(name), exact=True, **how) if exact else X.let(F.col(name), lambda t: X.clean_text(t, **how))

    df = df.withColumn("title", tidy("title")).withColumn("description", tidy("description", tags=True, emoji=True))
    df = df.withColumns({c: tidy(c) for c in ("company_name", "location", "department", "employment_type", "country", "url", "requirements", "responsibilities", "nice_to_have")})
    df = require_title(df.withColumn("title_normalized", X.let(F.struct("title", "company_name"), lambda r: X.normalize_title(r["title"], r["company_name"]))))
    title, text = F.col("title"), F.coalesce("description", F.lit(""))
    years = S.years_of_row(F.col("requirements"), F.col("nice_to_have"), F.col("description"))
    df = df.withColumn("_years", years).withColumns({
        "specialty": X.specialty(title, phrases),
        "analytics_role": X.analytics_role(title, phrases),
        "role_family": X.role_family(title),
        "seniority": X.seniority(title, text),
        "years_min": F.col("_years.low"), "years_max": F.col("_years.high"),
        "skills_text": X.text_skills(text),
        "key_list": X.parse_array(F.coalesce("key_skills", F.lit(""))),
        "department": X.department(F.col("department"), title, text),
        "analytics_row_ok": ~X.suspicious_title(title),
        "posting_language": X.posting_language(text),
        "employment_type": X.employment_type(F.col("employment_type"), text),
        "visa_sponsorship": X.visa(F.col("visa_sponsorship"), text),
        "relocation": X.relocation(F.col("relocation"), text),
        "remote_type": X.remote_type(title, text, F.col("remote"), F.col("location")),
        "city": X.let(L.city_of(F.col("location")), L.normalize_city),
        "parsed_country": L.country_from_text(L.strip_work_mode(F.col("location"))),
        "url": L.fix_url(F.col("url"), F.col("source"), F.col("source_job_id")),
    })
    df = fix_salary(df)
    df = df.withColumns({
        "skills": F.array_sort(F.array_union(F.transform("key_list", F.lower), "skills_text")),
        "remote": F.col("remote_type").isin("remote", "hybrid"),
        "city": F.when(F.col("remote_type") != "remote", F.col("city")),
        "country": L.infer_country(F.col("parsed_country"), F.col("country"), F.col("location"), text, F.col("company_name")),
        "skills_extracted": F.to_json("skills_text"),
    })
    df = df.withColumns({"skills_normalized": F.to_json(normalize_skills(F.col("skills"), synonyms or {})), "spoken_languages": L.spoken_languages(F.col("spoken_languages"), F.col("country"))})
    paid = F.coalesce("salary_from", "salary_to").isNotNull()
    df = df.withColumn("currency", F.when(paid, F.coalesce("currency", S.default_currency(F.col("country")))))
    df = df.withColumn("_r", S.sanitize_range(F.col("salary_from"), F.col("salary_to"), F.col("currency"))).withColumns({"salary_from": F.col("_r.low"), "salary_to": F.col("_r.high")}).drop("_r")
    return df.withColumns({
        "salary_mid_monthly": F.bround(F.coalesce((F.col("salary_from") + F.col("salary_to")) / 2, "salary_from", "salary_to"), 2),
        "salary_from_rub": S.to_rub_fallback(F.col("salary_from"), F.col("currency")),
        "salary_to_rub": S.to_rub_fallback(F.col("salary_to"), F.col("currency")),
        "salary_text": X.salary_text(F.col("salary_from"), F.col("salary_to"), F.col("currency"), F.col("salary_text_raw")),
        "experience_text": X.experience_text(F.col("years_min"), F.col("years_max")),
        **X.role_flags(F.col("title")),
    }).drop("skills_text", "key_list", "parsed_country", "_years")


def project(df: DataFrame, columns: list[str] = PAYLOAD) -> DataFrame:
    return df.select(*(c for c in columns if c in df.columns))


def clean_dataset(df: DataFrame) -> DataFrame:
    """The columns of the clean dataset, in order, of what ``clean`` gives; those it lacks are null."""
    at = {c: OWN_NAMES.get(c, c) for c in CLEAN_COLUMNS}
    return df.select(*((F.col(own) if own in df.columns else F.lit(None).cast("string")).alias(c) for c, own in at.items()))
