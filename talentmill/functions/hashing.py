"""Identifiers, and the texts and payloads that go with vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentmill.functions.salary import lookup

# Seniority -> grade, remote type -> work format, and what a candidate's grade and format allow.
GRADES = {"intern": "Intern", "junior": "Junior", "middle": "Middle", "senior": "Senior", "lead": "Lead", "principal": "Principal", "manager": "Manager", "director": "Director", "unknown": "Specialist"}
WORK_FORMATS = {"remote": "Remote", "hybrid": "Hybrid", "onsite": "Office", "office": "Office", "unknown": "Unknown"}
GRADES_ALLOWED = {"intern": ["Intern"], "junior": ["Intern", "Junior"], "middle": ["Middle", "Junior"], "senior": ["Senior", "Lead"], "lead": ["Lead", "Senior", "Principal"], "principal": ["Principal", "Lead", "Senior"], "manager": ["Manager", "Lead", "Director"], "director": ["Director", "Manager"]}
FORMATS_ALLOWED = {"remote": ["Remote"], "hybrid": ["Hybrid", "Remote"], "office": ["Office"], "onsite": ["Office"]}
#: The URL namespace of RFC 4122.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def present(c: Column) -> Column:
    return F.nullif(c.cast("string"), F.lit(""))


def job_id(source: Column, own: Column, url: Column, title: Column, company: Column) -> Column:
    """First 32 hex digits of sha256 over the source and its id, else URL, else title and company."""
    stable = F.coalesce(present(own), present(url), F.concat_ws("|", F.coalesce(title, F.lit("")), F.coalesce(company, F.lit(""))))
    return F.left(F.sha2(F.concat_ws(":", source, stable).cast("binary"), 256), F.lit(32))


def uuid5(name: Column) -> Column:
    """RFC 4122 version 5 UUID of a name in the URL namespace, assembled from sha1."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), name.cast("binary")))
    variant = F.substring(F.lit("89ab"), F.shiftright(F.conv(F.substring(h, 17, 1), 16, 10).cast("int"), 0).bitwiseAND(3) + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def point_id(job: Column, own: Column, url: Column, company: Column, title: Column) -> Column:
    return uuid5(F.coalesce(present(job), present(own), present(url), F.concat_ws("_", F.coalesce(company, F.lit("")), F.coalesce(title, F.lit("")))))


def set_hash(items: Column) -> Column:
    """md5 of a set of strings, whatever their order."""
    return F.md5(F.array_join(F.array_sort(F.array_distinct(items)), "|").cast("binary"))


def grade(seniority: Column) -> Column:
    return F.coalesce(lookup(GRADES, F.lower(F.trim(seniority))), F.lit("Specialist"))


def work_format(remote_type: Column) -> Column:
    return F.coalesce(lookup(WORK_FORMATS, F.lower(remote_type)), F.lit("Unknown"))


def vacancy_document(seniority: Column, title: Column, company: Column, country: Column, city: Column, remote_type: Column, skills: Column, description: Column) -> Column:
    """Text that is embedded for a vacancy."""
    head = F.concat(F.lit("passage: "), grade(seniority), F.lit(" "), F.coalesce(present(title), F.lit("Position")), F.lit(" at "), F.coalesce(present(company), F.lit("Company")), F.coalesce(F.concat(F.lit(" in "), present(country)), F.lit("")), F.coalesce(F.concat(F.lit(" ("), present(city), F.lit(")")), F.lit("")), F.lit("."))
    form = F.when(work_format(remote_type) != "Unknown", F.concat(F.lit("Format: "), work_format(remote_type), F.lit(".")))
    listed = F.when(F.size(skills) > 0, F.concat(F.lit("Skills: "), F.array_join(skills, ", "), F.lit(".")))
    return F.concat_ws(" ", head, form, listed, present(F.left(description, F.lit(800))))


def query_text(specialization: Column, own_grade: Column, skills: Column, country: Column, years: Column) -> Column:
    """Text that is embedded for a candidate."""
    parts = [present(specialization), present(own_grade), F.when(F.size(skills) > 0, F.concat(F.lit("Skills: "), F.array_join(skills, ", "))), F.concat(F.lit("in "), present(country)), F.when(years > 0, F.concat(years.cast("int").cast("string"), F.lit(" years experience")))]
    return F.concat(F.lit("query: "), F.concat_ws(" ", *parts))


def vacancy_payload(columns: list[str]) -> Column:
    """Payload struct of the columns that are there, with mapped grade and work format."""
    own = [F.col(c) for c in columns if c not in ("grade", "work_format")]
    extra = [grade(F.col("seniority")).alias("grade")] * ("seniority" in columns) + [work_format(F.col("remote_type")).alias("work_format")] * ("remote_type" in columns)
    return F.struct(*own, *extra)
