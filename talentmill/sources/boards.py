"""Adapters from landed JSON of job boards to raw records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentmill.functions.hashing import job_id, present
from talentmill.functions.salary import lookup, years_loose
from talentmill.functions.text import first_keyword, is_missing
from talentmill.functions.values import SOURCES
from talentmill.sources.tables import RAW, ensure_columns

# Country hints of the Russian board, and the countries and currencies of the European one.
HH_HINTS = {"росс": "Russia", "russia": "Russia", "белар": "Belarus", "belarus": "Belarus", "казах": "Kazakhstan", "kazakhstan": "Kazakhstan", "узбек": "Uzbekistan", "uzbekistan": "Uzbekistan", "украин": "Ukraine", "ukraine": "Ukraine", "минск": "Belarus", "minsk": "Belarus", "алматы": "Kazakhstan", "almaty": "Kazakhstan", "астана": "Kazakhstan", "astana": "Kazakhstan", "ташкент": "Uzbekistan", "tashkent": "Uzbekistan"}
ADZUNA = {"gb": ("United Kingdom", "GBP"), "de": ("Germany", "EUR"), "fr": ("France", "EUR"), "nl": ("Netherlands", "EUR"), "pl": ("Poland", "PLN"), "ca": ("Canada", "CAD"), "au": ("Australia", "AUD"), "in": ("India", "INR"), "sg": ("Singapore", "SGD")}

NAME = "struct<id:string,name:string>"
HH = f"id string, name string, description string, salary struct<from:double,to:double,currency:string>, area {NAME}, employer {NAME}, experience {NAME}, schedule {NAME}, employment {NAME}, department {NAME}, work_mode {NAME}, address struct<city:string,raw:string>, snippet struct<requirement:string,responsibility:string>, key_skills array<struct<name:string>>, published_at string, alternate_url string"
ADZUNA_JSON = "id string, title string, description string, salary_min double, salary_max double, salary_currency string, company struct<display_name:string>, location struct<display_name:string>, created string, redirect_url string, country_code string"
USAJOBS = "MatchedObjectDescriptor struct<PositionID:string,PositionTitle:string,PositionLocationDisplay:array<string>,OrganizationName:string,PositionURI:string,PublicationStartDate:string,PositionSchedule:array<struct<Name:string>>,PositionRemuneration:array<struct<MinimumRange:double,MaximumRange:double>>,UserArea:struct<Details:struct<JobSummary:string,MajorDuties:string>>>"
HIMALAYAS = "id string, slug string, title string, description string, companyName string, minSalary double, maxSalary double, salaryCurrency string, location string, country string, employmentType string, pubDate string, url string"
ARBEITNOW = "slug string, id string, title string, description string, company_name string, location string, tags array<string>, created_at string, url string"
GREENHOUSE = "id string, title string, content string, _company string, location struct<name:string>, departments array<struct<name:string>>, updated_at string, absolute_url string"
LEVER = "id string, text string, description string, descriptionPlain string, _company string, categories struct<department:string,team:string,`group`:string,location:string,commitment:string>, hostedUrl string"
ASHBY = "id string, title string, description string, descriptionHtml string, _company string, location string, locationName string, employmentType string, publishedAt string, jobUrl string, isListed boolean"


def to_raw(df: DataFrame, source: str) -> DataFrame:
    """Raw records of a source: id, columns in order, rows without a title or with an unknown source left out."""
    if source not in SOURCES:
        raise ValueError(f"unknown source {source}")
    out = ensure_columns(df.withColumn("source", F.lit(source)))
    identity = job_id(F.col("source"), F.col("source_job_id"), F.col("url"), F.col("title"), F.col("company_name"))
    return out.withColumn("job_id", identity).where(~is_missing(F.col("title"))).select(*RAW.names)


def distinct_ids(df: DataFrame) -> DataFrame:
    return df.dropDuplicates(["job_id"])


def text_or(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def adapt_hh(df: DataFrame, country: str | None = None) -> DataFrame:
    remote = (F.coalesce(F.col("work_mode.id"), F.lit("")) == "REMOTE") | F.contains(F.lower(F.coalesce("schedule.name", F.lit(""))), F.lit("удален"))
    place = F.concat_ws(" | ", "area.name", "address.city", "address.raw")
    letters = F.when(place.rlike("[а-яА-ЯёЁ]"), "Russia")
    inferred = F.when(F.col("area.id") == "113", "Russia").otherwise(F.coalesce(first_keyword(place, HH_HINTS, None), letters))
    skills = F.filter(F.transform("key_skills", lambda s: s["name"]), lambda s: s.isNotNull())
    description = F.coalesce(present(F.col("description")), F.concat_ws(" ", "snippet.requirement", "snippet.responsibility"))
    years = years_loose(F.col("experience.name"))
    return to_raw(
        df.select(
            F.coalesce("id", F.lit("")).alias("source_job_id"), F.col("name").alias("title"), description.alias("description"), F.coalesce(F.when(F.size(skills) > 0, F.array_join(skills, "; ")), "snippet.requirement", F.lit("")).alias("requirements"),
            F.coalesce("snippet.responsibility", F.lit("")).alias("responsibilities"), F.col("employer.name").alias("company_name"), F.col("department.name").alias("department"), F.col("salary.from").alias("salary_from"), F.col("salary.to").alias("salary_to"),
            F.col("salary.currency").alias("currency"), F.col("experience.name").alias("experience_level"), years["low"].alias("years_experience_min"), years["high"].alias("years_experience_max"), F.to_json(skills).alias("key_skills"),
            F.coalesce(present(F.col("address.city")), present(F.col("address.raw")), F.col("area.name")).alias("location"), F.coalesce(F.lit(country), inferred).alias("country"), remote.alias("remote"), F.when(remote, "remote").otherwise("office").alias("remote_type"),
            F.coalesce("employment.name", "schedule.name").alias("employment_type"), "published_at", F.coalesce(present(F.col("alternate_url")), F.concat(F.lit("https://hh.ru/vacancy/"), "id")).alias("url"),
            F.when(F.lower(description).rlike("visa|виза|визовая"), True).alias("visa_sponsorship"), F.lower(description).rlike("relocation|релокац|переезд").alias("relocation"),
        ), "hh.ru",
    )


def adapt_adzuna(df: DataFrame) -> DataFrame:
    remote = F.contains(F.lower(text_or("description")), F.lit("remote"))
    years = years_loose(F.col("description"))
    return to_raw(
        df.select(
            F.coalesce("id", F.lit("")).alias("source_job_id"), "title", text_or("description").alias("description"), F.col("company.display_name").alias("company_name"), F.col("salary_min").alias("salary_from"), F.col("salary_max").alias("salary_to"),
            F.coalesce(present(F.col("salary_currency")), lookup({k: v[1] for k, v in ADZUNA.items()}, F.col("country_code"))).alias("currency"), F.col("location.display_name").alias("location"), lookup({k: v[0] for k, v in ADZUNA.items()}, F.col("country_code")).alias("country"),
            remote.alias("remote"), F.when(remote, "remote").otherwise("office").alias("remote_type"), F.col("created").alias("published_at"), F.col("redirect_url").alias("url"), years["low"].alias("years_experience_min"), years["high"].alias("years_experience_max"),
        ), "adzuna.com",
    )


def adapt_usajobs(df: DataFrame) -> DataFrame:
    j = df.select("MatchedObjectDescriptor.*")
    description = F.coalesce(present(F.col("UserArea.Details.JobSummary")), F.col("UserArea.Details.MajorDuties"), F.lit(""))
    pay = F.get("PositionRemuneration", F.lit(0))
    return to_raw(
        j.select(
            F.coalesce("PositionID", F.lit("")).alias("source_job_id"), F.col("PositionTitle").alias("title"), description.alias("description"), F.col("OrganizationName").alias("company_name"), pay["MinimumRange"].alias("salary_from"), pay["MaximumRange"].alias("salary_to"),
            F.lit("USD").alias("currency"), F.array_join("PositionLocationDisplay", "; ").alias("location"), F.lit("United States").alias("country"), F.get("PositionSchedule", F.lit(0))["Name"].alias("employment_type"),
            F.lower(description).rlike("remote|telework|work from home").alias("remote"), F.col("PublicationStartDate").alias("published_at"), F.col("PositionURI").alias("url"),
        ), "usajobs.gov",
    )


def adapt_himalayas(df: DataFrame) -> DataFrame:
    """Always remote; a URL that is only the site gives way to slug, id, or title and company."""
    slug, url = F.trim(text_or("slug")), F.trim(text_or("url"))
    own = F.coalesce(present(F.col("id")), present(slug), F.lit(""))
    dashed = lambda c: F.regexp_replace(F.regexp_replace(F.lower(text_or(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    site = F.lit("https://himalayas.app/jobs/")
    final = F.when(~url.isin("", "https://himalayas.app", "http://himalayas.app"), url).when(slug != "", F.concat(site, slug)).when(own != "", F.concat(site, F.lit("id/"), own)).otherwise(F.left(F.concat(site, F.lit("generated/"), dashed("companyName"), F.lit("-"), dashed("title")), F.lit(500)))
    return to_raw(
        df.select(
            own.alias("source_job_id"), "title", "description", F.col("companyName").alias("company_name"), F.col("minSalary").alias("salary_from"), F.col("maxSalary").alias("salary_to"), F.coalesce("salaryCurrency", F.lit("USD")).alias("currency"), "location", "country",
            F.lit(True).alias("remote"), F.lit("remote").alias("remote_type"), F.col("employmentType").alias("employment_type"), F.col("pubDate").alias("published_at"), final.alias("url"),
        ), "himalayas.app",
    )


def adapt_arbeitnow(df: DataFrame) -> DataFrame:
    remote = F.exists(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.contains(F.lower(t), F.lit("remote")))
    return to_raw(df.select(F.coalesce(present(F.col("slug")), present(F.col("id")), F.lit("")).alias("source_job_id"), F.trim("title").alias("title"), F.trim("description").alias("description"), "company_name", "location", remote.alias("remote"), F.when(remote, "remote").otherwise("office").alias("remote_type"), F.col("created_at").alias("published_at"), "url"), "arbeitnow.com")


def adapt_greenhouse(df: DataFrame) -> DataFrame:
    return to_raw(df.select(F.coalesce("id", F.lit("")).alias("source_job_id"), "title", F.col("content").alias("description"), F.col("_company").alias("company_name"), F.get("departments", F.lit(0))["name"].alias("department"), F.col("location.name").alias("location"), F.col("updated_at").alias("published_at"), F.col("absolute_url").alias("url")), "greenhouse.com")


def adapt_lever(df: DataFrame) -> DataFrame:
    c = F.col("categories")
    department = F.coalesce(present(c["department"]), present(c["team"]), present(c["group"]))
    return to_raw(df.select(F.coalesce("id", F.lit("")).alias("source_job_id"), F.col("text").alias("title"), F.coalesce(present(F.col("descriptionPlain")), "description", F.lit("")).alias("description"), F.col("_company").alias("company_name"), department.alias("department"), c["location"].alias("location"), c["commitment"].alias("employment_type"), F.col("hostedUrl").alias("url")), "lever.co")


def adapt_ashby(df: DataFrame, keyword: str | None = None) -> DataFrame:
    """Listed jobs whose title or body holds the keyword."""
    body = F.trim(F.coalesce(present(F.col("descriptionHtml")), F.col("description"), F.lit("")))
    text = F.lower(F.concat_ws("\n", F.trim("title"), body))
    place = F.coalesce("location", "locationName")
    remote = F.contains(text, F.lit("remote")) | F.contains(F.lower(F.coalesce(place, F.lit(""))), F.lit("remote"))
    rows = df.where(F.coalesce("isListed", F.lit(True)) & (F.contains(text, F.lit(keyword.lower())) if keyword else F.lit(True)))
    return to_raw(rows.select(F.coalesce("id", F.lit("")).alias("source_job_id"), F.trim("title").alias("title"), body.alias("description"), F.col("_company").alias("company_name"), place.alias("location"), remote.alias("remote"), F.when(remote, "remote").otherwise("office").alias("remote_type"), F.col("employmentType").alias("employment_type"), F.col("publishedAt").alias("published_at"), F.col("jobUrl").alias("url")), "ashbyhq.com")
