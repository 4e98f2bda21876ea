"""Country, city and URL rules as column expressions. Gazetteers are parameters."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentmill.functions import dictionaries as D
from talentmill.functions.text import first_keyword, is_missing, let, lookup, parse_array, table_of

def _words(words: list[str]) -> str:
    return r"(?iU)(?<!\w)(?:" + "|".join(re.escape(w) for w in words) + r")(?!\w)"


def country_from_text(c: Column, hints: dict[str, str] = D.COUNTRY_HINTS, compat: bool = True) -> Column:
    """Country by hints in order, then states and provinces. Hints stand anywhere, as whole words only without ``compat``."""
    t = F.lower(c)
    other = F.when(t.rlike(_words(D.US_STATES)) | t.rlike(_words(D.US_ABBR)), "UNITED STATES").when(t.rlike("|".join(D.CA_PROVINCES)) | t.rlike(_words(D.CA_ABBR)), "CANADA")
    return F.when(~is_missing(c), F.coalesce(first_keyword(c, hints, None, bounded=not compat), other))


def strip_work_mode(c: Column) -> Column:
    t = F.regexp_replace(F.trim(c), r"(?i)^(remote|hybrid|onsite|on-site)\s*[-–—,:/|]\s*", "")
    return F.regexp_replace(F.regexp_replace(t, r"(?i)\b(remote|hybrid|onsite|on-site)\b\s*$", ""), r"^[ \-–—,;/|]+|[ \-–—,;/|]+$", "")


def city_of(c: Column, cities: dict[str, str] = D.CITIES, hints: dict[str, str] = D.COUNTRY_HINTS) -> Column:
    """City by exact part, by a known name inside the text, else the first part that is no noise, country or state and has at most three words."""
    return F.when(~is_missing(c), let(strip_work_mode(c), lambda text: _city_in(text, cities, hints)))


def _city_in(text: Column, cities: dict[str, str], hints: dict[str, str]) -> Column:
    parts = F.filter(F.transform(F.split(text, r"[,;|/]"), lambda p: F.regexp_replace(F.trim(p), r"^[ \-–—]+|[ \-–—]+$", "")), lambda p: p != "")
    exact = lambda parts: F.get(F.filter(F.transform(parts, lambda p: lookup(cities, F.lower(p))), lambda x: x.isNotNull()), F.lit(0))
    inside = first_keyword(text, cities, None, bounded=True)
    never = {*D.NOISE, *D.REGIONS, *hints, *(v.lower() for v in D.COUNTRY_NAMES.values()), "usa", "uk", "us", "uae", *D.US_STATES, *(a.lower() for a in (*D.US_ABBR, *D.CA_ABBR)), *D.CA_PROVINCES}
    known = table_of(dict.fromkeys(sorted(never), "x"))
    other = lambda parts: F.get(F.filter(parts, lambda p: F.element_at(known, F.lower(p)).isNull() & (F.size(F.split(p, r"\s+")) <= 3)), F.lit(0))
    return F.when(text != "", let(parts, lambda p: F.coalesce(exact(p), inside, F.upper(other(p)))))


def infer_country(parsed: Column, given: Column, location: Column, description: Column, company: Column, aliases: dict[str, str] = D.COUNTRY_NAMES, companies: dict[str, str] = D.COMPANY_COUNTRIES) -> Column:
    """Parsed, else given country by its canonical name; else by hints in the location, in the description's first 800 characters, or the company."""
    own = F.upper(F.trim(F.coalesce(F.when(~is_missing(parsed), parsed), F.when(~is_missing(given), given))))
    by_company = [lookup(companies, F.lower(F.trim(company)))] if companies else []
    return F.coalesce(lookup(aliases, own), own, country_from_text(location), country_from_text(F.left(description, F.lit(800))), *by_company) if aliases else F.coalesce(own, country_from_text(location), country_from_text(F.left(description, F.lit(800))), *by_company)


def normalize_city(c: Column, cities: dict[str, str] = D.CITIES) -> Column:
    return F.when(is_missing(c) | F.lower(F.trim(c)).isin("n/a", "na"), None).otherwise(F.coalesce(lookup(cities, F.lower(F.trim(c))), F.upper(F.trim(c))))


def normalize_country(c: Column, names: dict[str, str] = D.COUNTRY_NAMES) -> Column:
    return F.when(~is_missing(c), F.coalesce(lookup(names, F.upper(F.trim(c))), F.upper(F.trim(c))))


def spoken_languages(own: Column, country: Column, languages: dict[str, list[str]] = D.LANGUAGES) -> Column:
    """Array of languages: those given, else those of the country, else English."""
    table = table_of(languages)
    given = F.when(~is_missing(own) & ~F.trim(own).isin("{}", "[]"), parse_array(own))
    return F.coalesce(given, F.element_at(table, F.upper(F.trim(country))), F.array(F.lit("English")))


def location_mentioned(text: Column, place: Column) -> Column:
    """The place, or its stem without up to two last letters, stands in the text."""
    t, p = F.lower(text), F.lower(F.trim(place))
    stems = F.array(p, F.left(p, F.length(p) - 1), F.left(p, F.length(p) - 2))
    return F.exists(stems, lambda s: (F.length(s) >= 3) & F.contains(t, s))


def fix_url(url: Column, source: Column, source_job_id: Column, bases: dict[str, str] | None = None) -> Column:
    """Absolute URL; a bare path gets its source's base, a missing one a URL made of source and id."""
    base = F.coalesce(lookup(bases, source), F.concat(F.lit("https://"), source)) if bases else F.concat(F.lit("https://"), source)
    u = F.trim(url)
    return F.when(is_missing(url), F.concat(base, F.lit("/"), source_job_id)).when(F.startswith(u, F.lit("//")), F.concat(F.lit("https:"), u)).when(F.startswith(u, F.lit("/")), F.concat(base, u)).when(~u.rlike("(?i)^https?://"), F.concat(F.lit("https://"), u)).otherwise(u)
