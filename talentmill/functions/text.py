"""Text rules as column expressions: cleaning, classifiers, dictionary skills."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from talentmill.functions import dictionaries as D
from talentmill.functions import values as V

EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{1FA00}-\x{1FAFF}\x{2600}-\x{26FF}\x{FE00}-\x{FE0F}\x{200D}\x{23CF}-\x{23F3}\x{1F900}-\x{1F9FF}]+"


def is_missing(c: Column) -> Column:
    """Null, blank, or a usual spelling of nothing."""
    return c.isNull() | F.lower(F.trim(c)).isin("", "nan", "none", "null")


def collapse(c: Column) -> Column:
    """Single blanks, trimmed; blank becomes null."""
    return F.nullif(F.trim(F.regexp_replace(c, r"[\s\x{A0}]+", " ")), F.lit(""))


@F.pandas_udf(StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    def all_the_way(t):
        for _ in range(3):
            if t is None or (u := html.unescape(t)) == t:
                break
            t = u
        return t

    return texts.map(all_the_way)


def unescape(c: Column, exact: bool = False) -> Column:
    """Entities to characters: the common ones without leaving the JVM, all of HTML's with ``exact`` (an Arrow UDF)."""
    if exact:
        return F.when(F.instr(c, "&") > 0, _unescape(c)).otherwise(c)
    pairs = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&ndash;", "–"), ("&mdash;", "—"), ("&amp;", "&"))
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def clean_text(c: Column, tags: bool = False, emoji: bool = False, exact: bool = False) -> Column:
    """Unescaped, without tags and emoji if asked, single blanks; missing becomes null."""
    t = unescape(c, exact)
    if tags:
        t = F.regexp_replace(t, r"(?i)<\s*br\s*/?\s*>|</\s*(p|div|li|ul|ol|h\d)\s*>", "\n")
        t = unescape(F.regexp_replace(t, r"<[^>]+>", " "), exact)
    if emoji:
        t = F.regexp_replace(t, EMOJI, "")
    return F.when(is_missing(c), None).otherwise(collapse(t))


def html_text(c: Column) -> Column:
    """Visible text of a page: no scripts and styles, no tags."""
    return clean_text(F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>", " "), tags=True)


def normalize_title(title: Column, company: Column) -> Column:
    """Lower-case title without the company's name at either end."""
    name = F.trim(F.coalesce(company, F.lit("")))
    t = F.trim(title)
    cut = F.when(name == "", t).when(F.contains(t, F.concat(F.lit(" | "), name)), F.replace(t, F.concat(F.lit(" | "), name), F.lit(""))).when(F.contains(t, F.concat(name, F.lit(" | "))), F.replace(t, F.concat(name, F.lit(" | ")), F.lit(""))).otherwise(t)
    ends = (name != "") & F.endswith(F.lower(cut), F.concat(F.lit(" at "), F.lower(name)))
    cut = F.when(ends, F.left(cut, F.length(cut) - F.length(name) - 4)).otherwise(cut)
    return collapse(F.regexp_replace(F.lower(cut), r"[^a-zа-яё0-9\s+#.]", " "))


def parse_array(c: Column) -> Column:
    """Array from JSON, a bracketed or braced list, or comma-separated text; items trimmed, blanks and quotes dropped."""
    t = F.trim(c)
    listed = F.split(F.regexp_replace(t, r"^[\[({]|[\])}]$", ""), ",")
    as_json = F.when(t.rlike(r'^\[\s*"'), F.from_json(t, "array<string>"))
    items = F.transform(F.coalesce(as_json, listed), lambda x: F.trim(F.regexp_replace(F.trim(x), r"""^["']+|["']+$""", "")))
    return F.when(is_missing(c), F.array().cast("array<string>")).otherwise(F.filter(items, lambda x: x != ""))


def to_json_array(c: Column) -> Column:
    return F.to_json(F.filter(F.transform(c, F.trim), lambda x: x != ""))


def parse_number(c: Column) -> Column:
    """Tolerant number: thousands commas, decimal comma, k and m suffixes; 1000k and more counts as written."""
    s = F.regexp_replace(F.lower(c), r"[^\d.,km]", "")
    suffix = F.regexp_extract(s, r"([km])$", 1)
    body = F.regexp_replace(s, r"[km]$", "")
    body = F.when(F.contains(body, F.lit(",")) & F.contains(body, F.lit(".")), F.replace(body, F.lit(","), F.lit(""))).when(body.rlike(r"^\d*(,\d{3})+$"), F.replace(body, F.lit(","), F.lit(""))).otherwise(F.replace(body, F.lit(","), F.lit(".")))
    value = body.try_cast("double")
    times = F.when(suffix == "k", F.when(value >= 1000, 1.0).otherwise(1000.0)).when(suffix == "m", 1_000_000.0).otherwise(1.0)
    return F.when(is_missing(c), None).otherwise(value * times)


def to_bool(c: Column) -> Column:
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isin("true", "t", "1", "yes", "y"), True).when(t.isin("false", "f", "0", "no", "n"), False)


def to_int(c: Column) -> Column:
    return F.trim(c.cast("string")).try_cast("double").cast("long")


def to_ts(c: Column) -> Column:
    return F.trim(c.cast("string")).try_cast("timestamp")


def first_non_null(*columns: Column) -> Column:
    return F.coalesce(*(F.when(~is_missing(c.cast("string")), c.cast("string")) for c in columns))


def norm_query(c: Column) -> Column:
    return collapse(F.regexp_replace(F.lower(c), r"[^a-zа-яё0-9+#./\-\s]", " "))


def query_tokens(c: Column, stop: tuple[str, ...] = ("and", "or", "the", "of", "in", "for", "a", "и", "в", "на", "для")) -> Column:
    return F.filter(F.split(norm_query(c), " "), lambda t: (t != "") & ~t.isin(*stop))


def matches_query(text: Column, query: Column) -> Column:
    """The phrase, or all its tokens, or two thirds of two or more of them stand in the text."""
    t, tokens = F.lower(text), query_tokens(query)
    hits = F.size(F.filter(tokens, lambda x: F.contains(t, x)))
    return F.contains(t, F.lower(query)) | ((F.size(tokens) > 0) & (hits == F.size(tokens))) | ((F.size(tokens) >= 2) & (hits / F.nullif(F.size(tokens), F.lit(0)) >= 0.66))


def table_of(table: dict) -> Column:
    """A fixed map as one literal, of texts, texts to lists of texts, or texts to numbers: entries of their own would be a call to the planner each."""
    kinds = {type(v) for v in table.values()} or {str}
    kind = "array<string>" if kinds == {list} else "string" if kinds == {str} else "int" if kinds == {int} else "double"
    return F.from_json(F.lit(json.dumps(table, ensure_ascii=False)), f"map<string,{kind}>")


def lookup(table: dict, key: Column) -> Column:
    """What a fixed table has for a text; null for others."""
    return F.element_at(table_of(table), key)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is used: expressions are trees, in which each use is a copy."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))  # of one argument, whatever further ones ``body`` has


def first_of(branches: list[tuple[Column, object]], default: object) -> Column:
    """Value of the first branch whose condition holds. All are branches of one expression, which generated code takes apart; nested ones grow into one method."""
    out = None
    for condition, value in branches:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    default = default if isinstance(default, Column) else F.lit(default)
    return default if out is None else out.otherwise(default)


def first_match(text: Column, phrases: list[str]) -> Column:
    """First phrase, by place in the list, that stands in the text."""
    t = F.lower(text)
    return first_of([(F.contains(t, F.lit(p.lower())), p) for p in phrases], F.lit(None).cast("string"))


def effective_date(published: Column, parsed: Column, as_of: str) -> Column:
    """Published, else parsed, else a stated day, so that results repeat."""
    return F.coalesce(published.cast("date"), parsed.cast("date"), F.lit(as_of).cast("date"))


def salary_text(low: Column, high: Column, currency: Column, raw: Column, nothing: str = "нет данных") -> Column:
    month = F.lit(" per month")
    both = F.concat(low.cast("long").cast("string"), F.lit(" - "), high.cast("long").cast("string"), F.lit(" "), currency, month)
    one = F.concat(F.coalesce(low, high).cast("long").cast("string"), F.lit(" "), currency, month)
    return F.coalesce(both, one, F.nullif(F.trim(raw), F.lit("")), F.lit(nothing))


def experience_text(low: Column, high: Column, nothing: str = "нет данных") -> Column:
    a, b = low.cast("int").cast("string"), high.cast("int").cast("string")
    return F.coalesce(F.when(a == b, F.concat(a, F.lit(" years"))), F.concat(a, F.lit("-"), b, F.lit(" years")), F.lit(nothing))


def _literal(words: list[str], bounded: bool) -> str:
    return ("(?U)(?<!\\w)(?:" if bounded else "(?:") + "|".join(re.escape(w.strip()) if bounded else re.escape(w) for w in words) + (")(?!\\w)" if bounded else ")")


def classify(c: Column, ordered: dict[str, list[str]], default: str | None, bounded: bool = False) -> Column:
    """First label, in order, any of whose words stands in the text; ``bounded`` asks for whole words."""
    t = F.lower(c)
    return first_of([(t.rlike(_literal(words, bounded)), label) for label, words in ordered.items()], default)


def first_keyword(c: Column, ordered: dict[str, str], default: str | None, bounded: bool = False) -> Column:
    """Label of the first keyword, in order of the dictionary, that stands in the text. Neighbouring keywords of one label share a test."""
    runs: list[tuple[str, list[str]]] = []
    for word, label in ordered.items():
        if runs and runs[-1][0] == label:
            runs[-1][1].append(word)
        else:
            runs.append((label, [word]))
    t = F.lower(c)
    return first_of([(t.rlike(_literal(words, bounded)), label) for label, words in runs], default)


def seniority(title: Column, description: Column, experience: Column | None = None, compat: bool = True) -> Column:
    tries = [x for x in (experience, title, F.left(description, F.lit(300))) if x is not None]
    return F.coalesce(*(first_keyword(t, V.SENIORITY, None, bounded=not compat) for t in tries), F.lit("unknown"))


def role_family(title: Column, compat: bool = True) -> Column:
    return F.when(is_missing(title), "other").otherwise(classify(title, V.ROLE_FAMILIES, "other", bounded=not compat))


def role_flags(title: Column) -> dict[str, Column]:
    t = F.lower(title)
    return {"is_data_role": t.rlike(r"data|дан"), "is_ml_role": t.rlike(r"machine learning|\bml\b|deep learning|\bai\b"), "is_python_role": F.contains(t, F.lit("python")), "is_analyst_role": t.rlike("analyst|аналитик")}


def department(own: Column, title: Column, description: Column) -> Column:
    given = F.nullif(F.trim(F.coalesce(own, F.lit(""))), F.lit(""))
    text = F.coalesce(given, F.concat_ws(" ", F.coalesce(title, F.lit("")), F.left(F.coalesce(description, F.lit("")), F.lit(300))))
    return F.coalesce(classify(text, V.DEPARTMENTS, None), given)


def employment_type(own: Column, description: Column) -> Column:
    return classify(F.concat_ws(" ", F.coalesce(own, F.lit("")), F.left(F.coalesce(description, F.lit("")), F.lit(500))), V.EMPLOYMENT, "unknown")


def remote_type(title: Column, description: Column, flag: Column, location: Column) -> Column:
    """hybrid, office, remote or unknown: by words, then the flag, then remote words, then a given place."""
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.left(F.coalesce(description, F.lit("")), F.lit(800)), F.coalesce(location, F.lit(""))))
    return F.when(text.rlike(_literal(V.HYBRID, False)), "hybrid").when(text.rlike(_literal(V.OFFICE, False)), "office").when(flag, "remote").when(~flag, "office").when(text.rlike(_literal(V.REMOTE, False)), "remote").when(~is_missing(location), "office").otherwise("unknown")


def visa(flag: Column, description: Column, compat: bool = True) -> Column:
    t = F.lower(F.coalesce(description, F.lit("")))
    yes, no = t.rlike(_literal(V.VISA_YES, False)), t.rlike(_literal(V.VISA_NO, False))
    return F.coalesce(flag, yes if compat else yes & ~no)


def relocation(flag: Column, description: Column) -> Column:
    """Given value, else true by wording, else unknown."""
    return F.coalesce(flag, F.when(F.lower(description).rlike(_literal(V.RELOCATION, False)), True))


def suspicious_title(c: Column) -> Column:
    t = F.lower(F.trim(c))
    return is_missing(c) | (F.length(t) < 3) | t.rlike("|".join(V.SUSPICIOUS))


def spellings(phrase: str) -> list[str]:
    """A phrase with each of its hyphens as such or as a blank."""
    first, *rest = phrase.lower().split("-")
    out = [first]
    for part in rest:
        out = [f"{x}{sep}{part}" for x in out for sep in "- "]
    return out


def specialty(title: Column, phrases: list[str] = D.SPECIALTY_PHRASES, patterns: list[tuple[str, str]] = D.SPECIALTY_PATTERNS) -> Column:
    """Longest phrase, word-bounded, that stands in the title (by its own spelling), else the first pattern's label.

    One zero-width scan a layer finds all phrases at once, and their ranks are looked up. Dictionaries of thousands of phrases
    are joined instead (``operators.dictionary.specialties``)."""
    t = norm_query(title)
    ordered = sorted(dict.fromkeys(phrases), key=len, reverse=True)
    place = {s: i for i, p in reversed(list(enumerate(ordered))) for s in spellings(p)}
    found = F.array().cast("array<string>")
    for layer in layers(list(place)):
        found = F.concat(found, F.regexp_extract_all(t, F.lit(rf"(?<![a-zа-яё0-9])(?=({'|'.join(re.escape(p) for p in layer)})(?![a-zа-яё0-9]))"), F.lit(1)))
    if place:
        rank = F.array_min(F.transform(found, lambda f: lookup(place, f)))
        by_phrase = F.get(F.array(*map(F.lit, ordered)), rank)
    else:
        by_phrase = F.lit(None).cast("string")
    return F.when(is_missing(title), None).otherwise(F.coalesce(by_phrase, first_pattern(t, patterns)))


def first_pattern(t: Column, patterns: list[tuple[str, str]]) -> Column:
    """Label of the first pattern, in order, that a text holds."""
    return first_of([(t.rlike(p), label) for p, label in patterns], F.lit(None).cast("string"))


def analytics_role(title: Column, phrases: list[str] = D.SPECIALTY_PHRASES) -> Column:
    """Specialty by phrases, else by the narrower patterns without general labels."""
    return specialty(title, phrases, D.ROLE_PATTERNS)


def posting_language(c: Column) -> Column:
    """Russian if over 0.3 of the letters in the first 2000 characters are Cyrillic, else English."""
    t = F.left(c, F.lit(2000))
    cyrillic, latin = F.length(F.regexp_replace(t, "[^а-яёА-ЯЁ]", "")), F.length(F.regexp_replace(t, "[^a-zA-Z]", ""))
    return F.when(F.try_divide(cyrillic, cyrillic + latin) > 0.3, "Russian").otherwise("English")


def intent(c: Column, words: dict[str, list[str]]) -> Column:
    return classify(c, words, "chat")


BOUNDARY = r"A-Za-z0-9_+#.\-"


def layers(phrases: list[str]) -> list[list[str]]:
    """Phrases in lists without one that is a prefix of another, so that a single scan of each finds them all."""
    out: list[list[str]] = []
    for p in sorted(phrases):
        for layer in out:
            if not any(p.startswith(q) for q in layer):
                layer.append(p)
                break
        else:
            out.append([p])
    return out


def extract_skills(c: Column, skills: list[str] = D.SKILLS, aliases: dict[str, str] | None = None, contexts: dict[str, list[str]] | None = None) -> Column:
    """Dictionary skills that stand in a text, sorted.

    Single tokens meet the dictionary by set intersection; phrases are found by one zero-width scan per
    layer, which keeps overlapping hits; aliases (skill -> pattern) and ``contexts`` (skill -> patterns of which
    one must fit) are tested one by one."""
    t = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " ")
    single = [s for s in skills if re.fullmatch(rf"[{BOUNDARY}]+", s)]
    found = F.array_intersect(F.regexp_extract_all(t, F.lit(f"[{BOUNDARY}]+"), F.lit(0)), F.array(*(F.lit(s) for s in single)) if single else F.array().cast("array<string>"))
    for layer in layers([s for s in skills if s not in single]):
        pattern = rf"(?<![{BOUNDARY}])(?=({'|'.join(re.escape(p) for p in layer)})(?![{BOUNDARY}]))"
        found = F.array_union(found, F.regexp_extract_all(t, F.lit(pattern), F.lit(1)))
    tests = {**(aliases or {}), **{k: "|".join(v) for k, v in (contexts or {}).items()}}
    if tests:
        found = F.array_union(found, F.array_compact(F.array(*(F.when(t.rlike(rf"(?U){pattern}"), skill) for skill, pattern in tests.items()))))
    return F.array_sort(F.array_distinct(found))


def text_skills(c: Column) -> Column:
    """Skills of the fixed dictionary, its aliases and the language R in context, with those they imply."""
    return with_implied(extract_skills(c, D.SKILLS, D.SKILL_ALIASES, {"r": D.R_CONTEXTS}))


def with_implied(skills: Column, rules: dict[str, list[str]] = D.IMPLIED) -> Column:
    """Sorted skills and what they imply, one hop."""
    table = table_of(rules)
    more = F.flatten(F.transform(skills, lambda s: F.coalesce(F.element_at(table, s), F.array().cast("array<string>"))))
    return F.array_sort(F.array_union(skills, more))


def assistant_skills(skills: Column, synonyms: dict[str, str], rules: dict[str, list[str]] = D.IMPLIED) -> Column:
    """Canonical names of skills and of those that they imply; names without a synonym in title case."""
    clean = {k.strip().lower(): v.strip() for k, v in synonyms.items()}
    table = table_of(clean)
    named = lambda s: F.coalesce(F.element_at(table, F.lower(F.trim(s))), F.initcap(F.lower(F.trim(s))))
    lower = F.array_distinct(F.transform(F.filter(F.coalesce(skills, F.array().cast("array<string>")), lambda s: F.trim(s) != ""), lambda s: F.lower(named(s))))
    return F.array_sort(F.array_distinct(F.transform(with_implied(lower, rules), named)))


def assistant_text_skills(c: Column, synonyms: dict[str, str], rules: dict[str, list[str]] = D.IMPLIED) -> Column:
    """Canonical names of the synonyms that stand in a text as whole words, and of what they imply."""
    clean = {k.strip().lower(): v.strip() for k, v in synonyms.items()}
    t = F.lower(F.coalesce(c, F.lit("")))
    hits = [F.when(t.rlike(rf"(?U)\b{re.escape(k)}\b"), v) for k, v in clean.items()]
    return assistant_skills(F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>"), synonyms, rules)


def keyword_set(c: Column, words: list[str]) -> Column:
    return extract_skills(c, [w.lower() for w in words])
