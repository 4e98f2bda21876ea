"""Invariants of operators, adapters, snapshots and the cleaning plan."""

import json

import pytest
from pyspark.sql import functions as F

from talentmill import registry
from talentmill.operators import fx, ivf, marts, merge, quality, skills, vector
from talentmill.plans import views
from talentmill.plans.clean import clean, project
from talentmill.sources import boards, rates, tables


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=str)


def test_as_of_without_broadcast(spark, sf_dir):
    jobs, quotes = views.jobs(spark, sf_dir), views.rates(spark, sf_dir)
    small = fx.as_of_rate(jobs, quotes, "RUB", date="published_at")
    large = fx.as_of_rate(jobs, quotes, "RUB", date="published_at", broadcast_rows=1)
    assert rows(small, "job_id", "rate") == rows(large, "job_id", "rate")
    known = sorted((r.rate_date, r.base_currency, r.rate) for r in quotes.collect())
    for r in small.collect():
        fits = [x for d, c, x in known if c == r.currency and d <= r.published_at]
        assert r.rate == (1 if r.currency == "RUB" else fits[-1] if fits else None)


def test_skill_premium_equals_brute_force(spark, sf_dir):
    base, own = registry.base(spark, sf_dir), views.job_skills(spark, sf_dir)
    got = marts.skill_stats_v2(base.withColumn("country", F.lit("x")).withColumn("seniority", F.lit("y")), own, least_slice=5).collect()
    jobs, has = base.collect(), {(r.job_id, r.skill_id) for r in own.collect()}
    from statistics import median

    assert len(got) > 20
    for r in got:
        out = [j.salary_mid for j in jobs if (j.role, j.is_remote) == (r.role, r.is_remote) and (j.job_id, r.skill_id) not in has and j.salary_mid is not None]
        assert r.median_without == (pytest.approx(median(out), abs=0.006) if out else None)


def test_skill_premium_with_ties_and_empty_rests(spark):
    from statistics import median

    import random

    r = random.Random(3)
    pay = {i: r.choice([None, 100.0, 100.0, 200.0, 300.5, 0.5, float(i)]) for i in range(300)}
    base = spark.createDataFrame([(i, "a" if i % 3 else "b", "x", "y", False, v) for i, v in pay.items()], "job_id long, role string, country string, seniority string, is_remote boolean, salary_mid double")
    has = {(i, k) for i in pay for k in range(5) if r.random() < (0.1, 0.5, 0.9, 1.0, 0.02)[k]}
    got = marts.skill_stats_v2(base, spark.createDataFrame(sorted(has) * 2, "job_id long, skill_id int"), 5, 1).collect()
    assert len(got) >= 8
    for x in got:
        out = [v for i, v in pay.items() if (i % 3 != 0) == (x.role == "a") and (i, x.skill_id) not in has and v is not None]
        assert x.median_without == (pytest.approx(median(out), abs=0.006) if out else None), x


def test_candidate_search(spark, sf_dir):
    unit = [1.0, 0.0]
    items = spark.createDataFrame([(1, unit, "Senior", "Remote", "GERMANY", ["SQL", "Spark"], "c1", True, 10), (2, [0.8, 0.6], "Lead", "Hybrid", "GERMANY", None, "c2", False, 5), (3, [0.6, 0.8], "Intern", "Remote", "GERMANY", ["sql"], None, False, 9), (4, [0.0, 1.0], "Senior", "Office", "POLAND", ["sql"], "c1", False, 9)], "vec_id long, unit array<double>, grade string, work_format string, country string, skills array<string>, city string, remote boolean, salary_from long")
    ask = spark.createDataFrame([(1, unit, "Senior", ["hybrid"], "germany", ["sql", "dbt"], "C1", False, 6), (2, unit, None, None, None, None, None, True, None)], "query_id long, q_unit array<double>, q_grade string, q_formats array<string>, q_country string, q_skills array<string>, q_city string, q_relocation boolean, q_salary_min long")
    got = {(r.query_id, r.vec_id): (r.rank, r.skill_match_count, r.missing_skills) for r in vector.for_candidates(items, ask).collect()}
    assert got[1, 1] == (1, 1, ["dbt"]) and got[1, 2] == (2, 0, ["dbt", "sql"]) and {v for q, v in got if q == 1} == {1, 2} and {v for q, v in got if q == 2} == {1, 2, 3, 4}
    near = {(r.query_id, r.vec_id): r.score for r in vector.search_city(items, ask, 4).collect()}
    assert near == {(1, 1): 1.15, (1, 4): 0.15, (1, 3): 0.6, (2, 1): 1.0, (2, 2): 0.8, (2, 3): 0.6, (2, 4): 0.0}
    only = lambda **o: {(r.query_id, r.vec_id) for r in vector.retrieve(items, ask, 2, 0.5, **o).collect()}
    assert only() == {(2, 1), (2, 2)} and only(or_remote=True) == {(1, 1), (2, 1), (2, 2)} and only(fallback=True) == {(1, 1), (1, 2), (2, 1), (2, 2)}


def test_sql_functions(spark, sf_dir):
    from talentmill import rule_queries
    from talentmill.plans import sql

    rule_queries.registered(spark, sf_dir)
    rate = {r.base_currency: r.rate for r in registry.QUERIES["jon05_latest_rates"](spark, sf_dir).collect()}
    got = spark.sql("SELECT convert_salary(10, 'usd', 'RUB'), convert_salary(10, 'RUB', 'rub'), convert_salary(10, 'USD', 'XXX'), convert_salary(10, 'USD', 'RUB', DATE '1990-01-01')").first()
    assert tuple(got) == (round(10 * rate["USD"], 2), 10.0, None, None)
    own = "array('Brand#3', 'Brand#12', 'Brand#25')"
    for call in (f"fn_matching_jobs({own}, _limit => 5)", f"fn_best_countries_for_skills({own})", f"fn_remote_comparison({own}, 1)", "fn_country_market_overview('NATION_3')", f"fn_skill_gap({own})"):
        assert spark.sql(f"SELECT * FROM {call}").columns
    top = [r.job_id for r in spark.sql(f"SELECT * FROM fn_matching_jobs({own}, _limit => 5) ORDER BY place").collect()]
    want = registry.match.matching_jobs(registry.mid_base(spark, sf_dir), views.job_skills(spark, sf_dir), views.skills(spark, sf_dir), registry.USER, n=5)
    assert top == [r.job_id for r in want.collect()]
    assert set(sql.FUNCTIONS) >= {"convert_salary", "fn_salary_benchmark"}


def test_merge_invariants(spark, sf_dir):
    old, new = registry.snapshots(spark, sf_dir)
    assert rows(merge.merge_latest(old, old, ["job_id"])) == rows(old)
    once = merge.merge_latest(old, new, ["job_id"])
    assert rows(merge.merge_latest(once, new, ["job_id"])) == rows(once)
    frame = spark.createDataFrame([(1, "s", "a", None, "j1", "t", "c"), (2, "s", "a", None, "j2", "t", "c"), (3, "s", None, "U?x", "j3", "t", "c"), (4, "s", None, "u?x", "j4", "t", "c"), (5, None, None, None, "j5", "t", "c"), (6, None, None, None, None, "T", "C"), (7, None, None, None, "nan", "t", "c")], "n int, source string, source_job_id string, url string, job_id string, title string, company_name string")
    kept = merge.dedupe(frame, "n")
    assert [r.n for r in kept.orderBy("n").collect()] == [1, 3, 5, 6] and rows(merge.dedupe(kept, "n")) == rows(kept)
    good, bad = merge.normalize_record(spark.createDataFrame([("1", "s", "t", 9, 5, None), (None, "s", "t", 1, 2, "x")], "job_id string, source string, title string, salary_from int, salary_to int, seniority string"))
    assert rows(good, "salary_from", "salary_to", "seniority", "relocation") == [(5, 9, "unknown", False)] and bad.count() == 1
    multi = merge.dedupe_multi(spark.createDataFrame([(1, "a", None), (2, "a", None), (3, None, "u"), (4, None, "u"), (5, None, None), (6, None, None)], "n int, k string, u string"), "n", [["k"], ["u"]])
    assert sorted(r.n for r in multi.collect()) == [2, 4, 5, 6]


def test_distribution_sums(spark, sf_dir):
    jobs = views.jobs(spark, sf_dir)
    assert quality.distribution(jobs, "country").agg(F.sum("n")).first()[0] == jobs.count()
    c = skills.compare_skills(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"))).alias("c")
    assert spark.range(1).select(c).first().c.asDict() == {"match": ["b"], "missing": ["c"], "extra": ["a"], "match_pct": 50}
    rules = spark.createDataFrame([("pandas", "python"), ("python", "scripting")], "skill string, implies string")
    assert rows(skills.implied(spark.createDataFrame([(1, "pandas")], "job_id int, skill string"), rules), "skill") == [("pandas",), ("python",)]
    assert spark.range(1).select(skills.normalize_skills(F.array(F.lit("JS "), F.lit("Go"), F.lit("js")), {"js": "javascript"}).alias("s")).first().s == ["Go", "javascript"]


def test_vectors(spark, sf_dir):
    items, queries = registry.vec_sides(spark, sf_dir)
    exact = {(r.query_id, r.vec_id) for r in vector.search(items, queries, 10).collect()}
    near = {(r.query_id, r.vec_id) for r in ivf.search(ivf.build(items), queries, 10).collect()}
    assert len(exact & near) / len(exact) >= 0.9
    first = vector.search(items, queries, 1).collect()
    assert all(r.query_id == r.vec_id and r.score == 1.0 for r in first)
    both = vector.with_fallback(spark.createDataFrame([(1, "a")], "query_id int, x string"), spark.createDataFrame([(1, "b"), (2, "c")], "query_id int, x string"))
    assert rows(both) == [(1, "a"), (2, "c")]


def landed(spark, tmp_path, schema, *records):
    path = tmp_path / "in.json"
    path.write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in records))
    return spark.read.schema(schema).json(str(path))


BOARDS = {
    "hh": (boards.adapt_hh, boards.HH, {"id": "7", "name": "Data Engineer", "salary": {"from": 1, "to": 2, "currency": "RUR"}, "area": {"id": "1002", "name": "Минск"}, "experience": {"name": "от 3 лет"}, "schedule": {"name": "Удаленная работа"}, "snippet": {"requirement": "SQL", "responsibility": "переезд"}}, {"country": "Belarus", "remote": True, "years_experience_min": 3.0, "url": "https://hh.ru/vacancy/7", "relocation": True, "requirements": "SQL"}),
    "adzuna": (boards.adapt_adzuna, boards.ADZUNA_JSON, {"id": "1", "title": "Dev", "description": "remote", "country_code": "pl", "salary_min": 5.0}, {"currency": "PLN", "country": "Poland", "remote_type": "remote"}),
    "usajobs": (boards.adapt_usajobs, boards.USAJOBS, {"MatchedObjectDescriptor": {"PositionID": "p", "PositionTitle": "Clerk", "PositionLocationDisplay": ["A", "B"], "PositionRemuneration": [{"MinimumRange": 10, "MaximumRange": 20}], "UserArea": {"Details": {"JobSummary": "Telework"}}}}, {"location": "A; B", "salary_to": 20.0, "remote": True, "country": "United States"}),
    "himalayas": (boards.adapt_himalayas, boards.HIMALAYAS, {"title": "QA Lead!", "companyName": "A & B", "url": "https://himalayas.app"}, {"url": "https://himalayas.app/jobs/generated/a-b-qa-lead", "currency": "USD", "remote": True}),
    "arbeitnow": (boards.adapt_arbeitnow, boards.ARBEITNOW, {"slug": "s", "title": " T ", "tags": ["Remote OK"]}, {"title": "T", "remote": True}),
    "greenhouse": (boards.adapt_greenhouse, boards.GREENHOUSE, {"id": "1", "title": "T", "departments": [{"name": "D"}, {"name": "E"}]}, {"department": "D"}),
    "lever": (boards.adapt_lever, boards.LEVER, {"id": "1", "text": "T", "categories": {"team": "Core", "commitment": "Full-time"}}, {"department": "Core", "employment_type": "Full-time"}),
    "ashby": (lambda df: boards.adapt_ashby(df, "spark"), boards.ASHBY, {"id": "1", "title": "Spark dev", "locationName": "Remote"}, {"remote": True, "location": "Remote"}),
}


@pytest.mark.parametrize("board", BOARDS)
def test_boards(spark, tmp_path, board):
    adapt, schema, record, want = BOARDS[board]
    out = adapt(landed(spark, tmp_path, schema, record))
    assert out.columns == tables.RAW.names
    got = out.first().asDict()
    assert {k: got[k] for k in want} == want and len(got["job_id"]) == 32


def test_snapshots(spark, tmp_path):
    root = str(tmp_path)
    (tmp_path / "raw/2026-01-01/r1").mkdir(parents=True)
    (tmp_path / "raw/2026-01-01/r1/a.csv").write_bytes(b"\xef\xbb\xbf" + ",".join(tables.RAW.names).encode() + b'\nid1,s1,"A ""q""\nline",' + b"," * 39 + b"\n")
    assert tables.read_or_empty(spark, f"{root}/none.csv").count() == 0
    found = tables.read_many(spark, [*tables.resolve_inputs(spark, root, "2026-01-01"), f"{root}/none.csv"])
    assert found.first().title == 'A "q"\nline' and found.first().job_id == "id1"
    with pytest.raises(FileNotFoundError):
        tables.read_many(spark, [f"{root}/none.csv"])
    assert tables.resolve_clean(spark, root) is None
    path = tables.write_snapshot(found, root, "2026-01-01", "r1")
    assert tables.resolve_clean(spark, root) == path
    first = tables.write_latest(found, root)
    assert tables.resolve_clean(spark, root) == first
    tables.write_latest(found.union(found), root)
    assert spark.read.parquet(tables.resolve_clean(spark, root)).count() == 2
    assert spark.read.parquet(first).count() == 1  # readers of the version before are not disturbed
    (tmp_path / "other.csv").write_text("a,b\n1,2\n")
    (tmp_path / "nothing.csv").write_text("")
    (good,) = tables.resolve_inputs(spark, root, "2026-01-01")
    assert tables.read_many(spark, [f"{root}/other.csv", good, f"{root}/nothing.csv"]).count() == 1


def test_rate_files(spark, tmp_path):
    (tmp_path / "cbr.xml").write_text('<ValCurs Date="02.01.2026"><Valute><CharCode>USD</CharCode><Nominal>1</Nominal><Value>80,5</Value></Valute><Valute><CharCode>EUR</CharCode><Nominal>10</Nominal><Value>905,0</Value></Valute></ValCurs>')
    (tmp_path / "ecb.csv").write_text("CURRENCY,TIME_PERIOD,OBS_VALUE\nUSD,2026-01-02,1.1\nGBP,2026-01-02,0.9\nUSD,2026-01-03,1.2\n")
    cbr, ecb = rates.read_cbr(spark, str(tmp_path / "cbr.xml"), "2026-01-02"), rates.read_ecb(spark, str(tmp_path / "ecb.csv"))
    assert {r.base_currency: float(r.rate) for r in cbr.collect()} == {"USD": 80.5, "EUR": 90.5}
    assert {str(r.rate_date) for r in fx.complete_dates(ecb, ["USD", "GBP"]).collect()} == {"2026-01-02"}
    got = {(str(r.day), r.currency): r.rate for r in fx.resolve_rates(fx.days_between(spark, "2026-01-01", "2026-01-05"), ecb, cbr).collect()}
    assert got[("2026-01-05", "USD")] == 1.1 and got[("2026-01-05", "RUB")] == 90.5 and ("2026-01-01", "USD") not in got


def test_clean_plan(spark, tmp_path):
    record = {"source_job_id": "1", "source": "lever.co", "title": "Senior Data Engineer | Acme", "company_name": "Acme", "description": "<p>Requirements: 3-5 years of experience. Salary $96k - $120k per year. python and sql</p>", "location": "Remote - Berlin, Germany", "parsed_at": "1"}
    raw = tables.ensure_columns(spark.createDataFrame([record, record | {"parsed_at": "2"}, record | {"source": "nowhere", "source_job_id": "9"}, record | {"title": None, "source_job_id": "8"}]))
    got = clean(raw, phrases=["Data Engineer"], synonyms={"sql": "SQL"}).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.title_normalized, r.specialty, r.role_family, r.seniority, r.years_min, r.years_max) == ("senior data engineer", "Data Engineer", "data_engineer", "senior", 3, 5)
    assert (r.salary_from, r.salary_to, r.currency, r.salary_mid_monthly) == (8000.0, 10000.0, "USD", 9000.0)
    assert (r.remote_type, r.city, r.country, r.skills, r.posting_language) == ("remote", None, "GERMANY", ["python", "sql"], "English")
    assert (r.analytics_role, r.skills_normalized, r.spoken_languages) == ("Data Engineer", '["SQL","python"]', ["German"])
    assert project(clean(raw)).columns[0] == "job_id"


def test_coverage_counts_all_skills_and_active_jobs(spark, sf_dir):
    import duckdb

    from talentmill.operators import match

    jobs = spark.createDataFrame([(1, 10, None, True, "a"), (2, None, None, True, "b"), (3, 5, 6, False, "c"), (4, 7, 8, True, " ")], "job_id long, salary_from long, salary_to long, is_active boolean, title string")
    own = spark.createDataFrame([(1, 20, "x"), (1, 20, "y"), (1, 3, "x"), (3, 21, "x"), (4, 22, "x")], "job_id long, skill_id int, source_type string")
    known = spark.createDataFrame([(3, "c"), (20, "t"), (21, "u"), (22, "v"), (23, "w")], "skill_id int, canonical_name string")
    base = match.analytics_base(jobs)
    assert sorted(map(tuple, quality.available_skills(known, own, base).collect())) == [(3, "c", 1), (20, "t", 1), (23, "w", 0)]
    assert tuple(quality.coverage(base, own).first()) == (2, 1, 1, 1, 50.0, 50.0, 50.0)
    db = duckdb.connect()
    for name in ("orders", "customer", "nation", "lineitem", "part"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    for name in ("agg14_coverage_all", "agg14_coverage_by_source_all", "agg16_available_skills_all"):
        got, sql = registry.QUERIES[name](spark, sf_dir), registry.ORACLE_SQL[name]
        want = db.execute(sql)
        assert got.columns == [c[0] for c in want.description]
        assert sorted(map(tuple, got.collect())) == sorted(want.fetchall()), name


def test_conditional_search_in_blocks(spark, monkeypatch):
    """Search with conditions and changed scores: by blocks of queries and items, with nulls on either side, as one by one; no plan joins all pairs."""
    import numpy as np

    from talentmill.operators import blocks, vector

    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=6).tolist() if i % 50 else None if i % 100 else [0.0] * 6, [None, "a", "b", "C"][i % 4], None if i % 9 == 0 else i % 7) for i in range(400)]
    items = vector.normalised(spark.createDataFrame(rows, "vec_id int, embedding array<double>, city string, n int"))
    asked = items.where("vec_id % 10 = 3 or vec_id = 0").select(F.col("vec_id").alias("query_id"), F.col("unit").alias("q_unit"), F.when(F.col("vec_id") % 20 != 3, "a").alias("q_city"), F.col("n").alias("q_n"))
    monkeypatch.setattr(vector, "QUERY_BLOCK", 7)
    monkeypatch.setattr(vector, "QUERY_BYTES", 0)
    monkeypatch.setattr(blocks, "BLOCK", 300)
    keep = lambda p: (p.unset("q_city") | p.same("city", "q_city")) & (p.unset("q_n") | (p.item("n") >= p.query("q_n")))
    on = ("city", "n", "q_city", "q_n")
    unit = {x.vec_id: x.unit for x in items.collect()}
    for change, same in ((None, 0), (lambda s, p: s + 0.25 * p.same("city", "q_city"), 0.25)):
        found = vector.search(items, asked, 3, keep, with_columns=("city", "q_n"), rerank=change, on=on)
        assert not {"CartesianProduct", "BroadcastNestedLoopJoin"} & {*found._jdf.queryExecution().optimizedPlan().toString().replace("(", " ").split()} and "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
        want = set()
        for q in asked.collect():
            all_of = []
            for i, _, city, n in rows:
                if unit[i] is not None and (q.q_city is None or city == q.q_city) and (q.q_n is None or (n is not None and n >= q.q_n)):
                    score = round(float(np.dot(unit[i], q.q_unit)), 4) + (same if city is not None and city == q.q_city else 0)
                    all_of.append((-round(score, 4), i, city))
            want |= {(q.query_id, i, -s + 0.0, k + 1, city, q.q_n) for k, (s, i, city) in enumerate(sorted(all_of)[:3])}
        assert {(x.query_id, x.vec_id, x.score, x["rank"], x.city, x.q_n) for x in found.collect()} == want and want
    assert vector.search(items, asked.limit(0), 3, keep, on=on).collect() == [] and dict(found.dtypes)["vec_id"] == "int"


def test_vectors_are_scaled_by_a_norm_computed_once(spark):
    """The norm is not put in the place of its name for every element, which made scaling quadratic in the dimension."""
    from talentmill.operators import vector

    plan = vector.normalised(spark.createDataFrame([([3.0, 4.0],)], "embedding array<double>"))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("aggregate(") <= 1 and plan.first()["unit"] == [0.6, 0.8]
