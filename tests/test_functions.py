"""Table-driven cases of the scalar rules."""

import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from talentmill.functions import hashing as H
from talentmill.functions import location as L
from talentmill.functions import salary as S
from talentmill.functions import text as X
from talentmill.functions import values as V


def each(spark, expression, values, kind="string"):
    """Results of a column expression over values, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, c {kind}")
    return [r.x for r in df.select("i", expression(F.col("c")).alias("x")).orderBy("i").collect()]


def cases(spark, expression, pairs, kind="string"):
    assert each(spark, expression, [a for a, _ in pairs], kind) == [b for _, b in pairs]


def test_missing_and_clean(spark):
    cases(spark, X.is_missing, [(None, True), (" ", True), ("NaN", True), (" none ", True), ("x", False)])
    cases(spark, lambda c: X.clean_text(c, tags=True, emoji=True), [("<p>a&amp;b</p> <br/> c d 😀", "a&b c d"), ("null", None), ("&lt;b&gt;x", "x"), ("  ", None)])
    cases(spark, lambda c: X.clean_text(c, exact=True), [("&eacute;&amp;amp;", "é&")])
    cases(spark, X.html_text, [("<script>var a='</p>';</script><style>p{}</style><p>Hi <b>you</b></p>", "Hi you")])


def test_titles_arrays_numbers(spark):
    cases(spark, lambda c: X.normalize_title(c, F.lit("Acme")), [("Senior Dev | Acme", "senior dev"), ("Acme | Dev", "dev"), ("Dev at ACME", "dev"), ("C++/C# (m/f)", "c++ c# m f")])
    cases(spark, X.parse_array, [('["a", "b "]', ["a", "b"]), ("['a','b']", ["a", "b"]), ("{x,\"y z\"}", ["x", "y z"]), ("(p,q)", ["p", "q"]), ("m, ,n", ["m", "n"]), ("nan", []), (None, []), ("[]", [])])
    cases(spark, X.parse_number, [("120k", 120000.0), ("1,200.50", 1200.5), ("1,200", 1200.0), ("3,5", 3.5), ("2m", 2e6), ("1500k", 1500.0), ("$ 90 000", 90000.0), ("", None), ("abc", None)])
    cases(spark, X.to_bool, [("Yes", True), ("0", False), ("?", None)])
    cases(spark, X.to_int, [(" 12.0 ", 12), ("x", None)])
    cases(spark, lambda c: X.matches_query(c, F.lit("senior data engineer")), [("Senior Data Engineer (m)", True), ("data engineer", True), ("data person", False)])


def test_classifiers(spark):
    nothing = F.lit("")
    cases(spark, lambda c: X.seniority(c, nothing), [("Senior Dev", "senior"), ("Junior Team Lead", "junior"), ("Ведущий инженер", "lead"), ("International Sales", "intern"), ("Dev", "unknown")])
    cases(spark, lambda c: X.seniority(c, nothing, compat=False), [("International Sales", "unknown"), ("Sales intern", "intern")])
    cases(spark, X.role_family, [("Data Engineer", "data_engineer"), ("ML Engineer", "ml_engineer"), (None, "other"), ("Бэкенд", "backend_developer"), ("Cook", "other")])
    cases(spark, lambda c: X.department(c, F.lit("Growth lead"), nothing), [("", "Marketing"), ("Cooking", "Cooking"), ("Legal team", "Legal / Compliance")])
    cases(spark, lambda c: X.employment_type(c, nothing), [("Full-time", "full_time"), ("Contractor", "contract"), ("стажировка", "internship"), (None, "unknown")])
    cases(spark, lambda c: X.remote_type(c, nothing, F.lit(None).cast("boolean"), F.lit("Berlin")), [("Hybrid dev", "hybrid"), ("On-site dev", "office"), ("Remote dev", "remote"), ("Dev", "office")])
    cases(spark, lambda c: X.visa(F.lit(None).cast("boolean"), c), [("no visa sponsorship", True), ("unable to sponsor", False), ("x", False)])
    cases(spark, lambda c: X.visa(F.lit(None).cast("boolean"), c, compat=False), [("no visa sponsorship", False), ("visa sponsorship", True)])
    cases(spark, lambda c: X.relocation(F.lit(None).cast("boolean"), c), [("We relocate", True), ("x", None)])
    cases(spark, X.suspicious_title, [("Summit 2024", True), ("3 x Dev", True), ("12 openings", True), ("ab", True), ("Python Developer", False)])
    cases(spark, lambda c: X.specialty(c, ["Data Engineer", "Senior Data Engineer", "SRE"]), [("Senior  Data Engineer (Spark)", "Senior Data Engineer"), ("Big-data engineer", "Data Engineer"), ("Presre", None), (None, None)])
    cases(spark, X.posting_language, [("Привет мир", "Russian"), ("Hello", "English"), ("", "English"), (None, "English"), ("abc где", "Russian")])


def test_skills(spark):
    terms = ["python", "sql", "c++", "google cloud", "google cloud run", "ci/cd", "node.js", "r"]
    cases(
        spark,
        lambda c: X.extract_skills(c, terms, {"node.js": r"(?<!\w)node(?:\.?\s*js)(?!\w)"}),
        [("Python, SQL and C++", ["c++", "python", "sql"]), ("We use python.", []), ("Google  Cloud Run", ["google cloud", "google cloud run"]), ("CI/CD; node js", ["ci/cd", "node.js"]), (None, [])],
    )
    assert all(not a.startswith(b) for layer in X.layers(terms) for a in layer for b in layer if a != b)


def test_dictionary_of_skills(spark):
    from talentmill.functions import dictionaries as D

    assert len(D.SKILLS) == len(set(D.SKILLS)) > 170 and len(D.IMPLIED) == 73 and len(D.LANGUAGES) == 51 and len(D.US_STATES) == 50
    assert set(D.COUNTRY_HINTS.values()) == set(D.COUNTRY_NAMES.values())
    cases(spark, X.text_skills, [("PySpark on k8s, with R / SQL.", ["k8s", "kubernetes", "pyspark", "python", "r", "spark"]), ("React Native app", ["javascript", "react", "react native"]), (None, [])])
    named = {"js": "JavaScript", "javascript": "JavaScript", "python": "Python"}
    cases(spark, lambda c: X.assistant_skills(F.split(c, ","), named), [("JS, pandas", ["JavaScript", "Pandas", "Python"]), ("", [])])


def test_pay(spark):
    def low_high(c, safe=False):
        s = S.salary_from_text_safe(c) if safe else S.salary_from_text(c)
        return F.array(s["low"].cast("string"), s["high"].cast("string"), s["currency"])

    cases(spark, low_high, [("$100k - $150k", ["100000.0", "150000.0", "USD"]), ("100 000 - 120 000 RUB", ["100000.0", "120000.0", "RUB"]), ("от 50000 до 70000 руб", ["50000.0", "70000.0", "RUB"]), ("€ 90k", ["90000.0", "90000.0", "EUR"]), ("none", [None, None, None])])
    cases(spark, lambda c: low_high(c, True), [("gym allowance $500. Salary range: nothing here at all for long enough text to be far away; base salary $90k - $95k", ["90000.0", "95000.0", "USD"]), ("We raised $100 million", [None, None, None]), ("Meal $5 - $6 is paid for each day you work. Salary $100k - $120k", ["100000.0", "120000.0", "USD"]), ("salary " + "x" * 44 + "$5k", [None, None, None]), ("salary " + "x" * 43 + "$5k", ["5000.0", "5000.0", "USD"]), ("gym " + "y" * 37 + " pay rate $50", ["50.0", "50.0", "USD"])])
    cases(spark, S.period_hint, [("10 / hr", "hour"), ("per annum", "year"), ("в месяц", "month"), ("x", None)])
    cases(spark, S.currency_in, [("hk$ 5", "HKD"), ("¥ yuan", "CNY"), ("¥5", "JPY"), ("5 usd", "USD"), ("nothing", None)])
    cases(spark, lambda c: S.best_period(c, F.lit("USD"), F.lit(None).cast("string")), [(50.0, "day"), (30.0, "hour"), (5000.0, "month"), (120000.0, "year")], "double")
    assert each(spark, lambda c: S.to_monthly(c, c, F.lit("USD"), F.lit("annual"))["low"], [120000.0], "double") == [10000.0]
    sane = lambda a, b: tuple(spark.range(1).select(S.sanitize_bounds(F.lit(a).cast("double"), F.lit(b).cast("double"), F.lit("USD")).alias("s")).first().s)
    assert sane(5000, 3000) == (3000.0, 5000.0) and sane(None, 4000) == (4000.0, 4000.0) and sane(1000, 900000) == (None, None) and sane(-5, 10) == (None, None)
    again = lambda a, b: tuple(spark.range(1).select(S.sanitize_range(F.lit(a).cast("double"), F.lit(b).cast("double"), F.lit("USD")).alias("s")).first().s)
    assert again(5000, 3000) == (3000.0, 5000.0) and again(50000, 3000) == (None, None) and again(1e9, 3000) == (None, 3000.0)


def test_experience(spark):
    years = lambda c: F.array(S.years_safe(c)["low"], S.years_safe(c)["high"])
    cases(spark, years, [("Requirements: 3-5 years of experience", [3, 5]), ("You have at least 4 years experience", [4, 4]), ("Our company has 20 years of experience", [None, None]), ("Requirements: 40 years of experience", [None, None])])
    cases(spark, lambda c: S.years_loose(c)["low"], [("от 3 лет", 3.0), ("5+ years", 5.0), ("2,5 years", 2.5), ("x", None)])


def test_places(spark):
    cases(spark, lambda c: L.country_from_text(c, compat=False), [("Austin, TX", "UNITED STATES"), ("Australia", "AUSTRALIA"), ("Toronto, ON", "CANADA"), ("Москва", "RUSSIA"), ("Nowhere", None)])
    cases(spark, L.country_from_text, [("Austin", "UNITED STATES"), ("Australia", "UNITED STATES"), ("Lisbon, Portugal", "PORTUGAL"), ("Київ", "UKRAINE"), ("nan", None)])  # hints stand anywhere, the first in order counts
    nothing = F.lit(None).cast("string")
    cases(spark, lambda c: L.infer_country(nothing, c, nothing, F.lit("Our office in Yerevan"), F.lit("Lyft")), [("россия", "RUSSIA"), ("Atlantis", "ATLANTIS"), (None, "ARMENIA")])
    cases(spark, lambda c: L.infer_country(nothing, nothing, nothing, nothing, c), [("Lyft", "UNITED STATES"), ("Nobody", None)])
    cases(spark, lambda c: L.spoken_languages(nothing, c), [("switzerland", ["German", "French"]), (None, ["English"])])
    cases(spark, L.city_of, [("Remote - Berlin, Germany", "BERLIN"), ("Springfield, Ohio", "SPRINGFIELD"), ("Москва", "MOSCOW"), ("Remote", None), ("Germany", None), (None, None)])
    cases(spark, lambda c: L.fix_url(c, F.lit("lever.co"), F.lit("9")), [("//x.y/z", "https://x.y/z"), ("/jobs/1", "https://lever.co/jobs/1"), ("x.y", "https://x.y"), (None, "https://lever.co/9"), ("http://a", "http://a")])
    cases(spark, lambda c: L.location_mentioned(c, F.lit("Москва")), [("работа в Москве", True), ("работа в Перми", False)])


@pytest.mark.parametrize("name", ["https://example.com/a", "", "ключ"])
def test_ids(spark, name):
    assert each(spark, H.uuid5, [name]) == [str(uuid.uuid5(uuid.NAMESPACE_URL, name))]
    assert each(spark, lambda c: H.job_id(F.lit("lever.co"), c, F.lit(None), F.lit("t"), F.lit("c")), [name]) == [hashlib.sha256(f"lever.co:{name or 't|c'}".encode()).hexdigest()[:32]]


def test_documents(spark):
    got = spark.range(1).select(H.vacancy_document(F.lit("senior"), F.lit("Dev"), F.lit("Acme"), F.lit("Spain"), F.lit("Vigo"), F.lit("remote"), F.array(F.lit("sql")), F.lit("Text")).alias("d"), H.query_text(F.lit("Dev"), F.lit("Senior"), F.array(F.lit("sql")), F.lit("Spain"), F.lit(5)).alias("q")).first()
    assert got.d == "passage: Senior Dev at Acme in Spain (Vigo). Format: Remote. Skills: sql. Text" and got.q == "query: Dev Senior Skills: sql in Spain 5 years experience"


def monthly(low, high, currency, period):
    """SAL-06 by brute force: month, year, week, day and hour in this order after the hint."""
    months = {"month": 1.0, "year": 1.0 / 12.0, "week": 4.33, "day": 21.0, "hour": 160.0}
    hint = {"annual": "year", "yearly": "year", "monthly": "month", "hourly": "hour", "daily": "day"}.get(period, period)
    known = [float(v) for v in (low, high) if v is not None]
    if not known:
        return None, None
    least, most = V.MONTHLY_BOUNDS.get(currency or "USD", V.DEFAULT_BOUNDS)
    best, best_score = "month", float("inf")
    for p in [hint] * (hint in months) + [p for p in months if p != hint]:
        v = max(known) * months[p]
        score = ((least - v) / least if v < least else (v - most) / most if v > most else 0.0) - 0.05 * (p == hint)
        if score < best_score:
            best, best_score = p, score
    return tuple(None if v is None else float(round(v * months[best])) for v in (low, high))


def test_to_monthly_of_all_amounts(spark, sf_dir):
    amounts = [None, 0.0, 0.5, 7.0, 15.5, 40.0, 120.0, 333.3, 799.0, 800.0, 2500.0, 29_999.0, 30_001.0, 51_000.0, 360_001.0, 700_000.0, 5e6, 4e8]
    rows = [(i, a, b, c, p) for i, (a, b, c, p) in enumerate((a, b, c, p) for a in amounts for b in amounts for c in (None, "USD", "RUB", "EUR") for p in (None, "hourly", "daily", "week", "monthly", "yearly", "other"))]
    df = spark.createDataFrame(rows, "i long, a double, b double, c string, p string")
    got = {r.i: tuple(r.m) for r in df.select("i", S.to_monthly(F.col("a"), F.col("b"), F.col("c"), F.col("p")).alias("m")).collect()}
    assert [(r, got[r[0]], monthly(*r[1:])) for r in rows if got[r[0]] != monthly(*r[1:])][:5] == []


def test_to_monthly_of_every_order(spark, sf_dir):
    from talentmill import registry

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice").collect()
    got = {r.o_orderkey: r.monthly for r in registry.QUERIES["sal06_to_monthly_all"](spark, sf_dir).collect()}
    assert got == {r.o_orderkey: monthly(r.o_totalprice, r.o_totalprice, "USD", "yearly")[1] for r in orders}


def test_pay_patterns_look_ahead_before_they_try_tokens(spark):
    """Time at size: a pattern that begins with a token of money tries none where no number follows, and finds what it found without."""
    import re
    import time

    texts = ["Salary $70000 per year", "pay hk$ 5k - us$7k", "zł  12", "USD12", "in USD", "a 5", "", "USD\n\t 9 to EUR 11", "c$5 c$6-7", "x€1", "₽₽₽ 8", "nosek 5 SEK 7", "ab$  , 3"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern in (S.TIERS[0][0], S.TIERS[3][0]):
        plain = pattern.replace(S.BEFORE, "")
        assert plain != pattern
        for g in range(re.compile(pattern).groups + 1):
            both = df.select("t", F.regexp_extract_all("t", F.lit(f"(?iu){pattern}"), F.lit(g)).alias("a"), F.regexp_extract_all("t", F.lit(f"(?iu){plain}"), F.lit(g)).alias("b")).collect()
            assert all(r.a == r.b for r in both) and any(r.a for r in both)

    def took(pattern):
        began = time.process_time()
        assert not re.search(f"(?i){pattern}", "harbour cash using pound rupee " * 3000)
        return time.process_time() - began

    assert took(S.TIERS[3][0]) * 2 < took(S.TIERS[3][0].replace(S.BEFORE, ""))
