"""Index, blocked search, greedy keep-last, dictionary joins, sorted as-of joins, ranks, histories, versions and tolerant reads against brute force."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from talentmill import engine_queries, registry
from talentmill.functions import dictionaries as D
from talentmill.functions import text as X
from talentmill.operators import dictionary, fx, history, ivf, marts, match, merge, vector
from talentmill.operators.blocks import Best
from talentmill.operators.quantiles import quantiles, tenth_from_above, upper_median, with_quantiles
from talentmill.plans import views
from talentmill.sources import tables, versions


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- vectors --------------------------------------------------------------------------------


def clustered(spark, n=3000, width=16, clusters=60, seed=1):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((clusters, width))
    x = centres[r.integers(0, clusters, n)] + 0.25 * r.standard_normal((n, width))
    x[: n // 3] = x[0]  # copies: a third of all rows
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(4)
    items = vector.normalised(df)
    return items, items.where("vec_id % 40 = 0 and vec_id > 1000").select(F.col("vec_id").alias("query_id"), F.col("unit").alias("q_unit"))


def test_index_finds_neighbours_with_few_scores(spark, tmp_path):
    items, asked = clustered(spark)
    index = ivf.build(items, str(tmp_path / "index"), files=8)
    true = {(r.query_id, r.vec_id) for r in vector.search_exact(items, asked, 10).collect()}
    assert true == {(r.query_id, r.vec_id) for r in vector.search(items, asked, 10).collect()}
    found = {(r.query_id, r.vec_id) for r in ivf.search(index, asked).collect()}
    spent = ivf.cost(index, asked)
    assert len(true & found) >= 0.9 * len(true)
    assert spent["scored_share"] <= 0.05 and spent["coded_share"] <= 0.5
    assert spent["largest_list"] >= 0.3  # copies share a list, which is in several files
    big = max(index.sizes(spark), key=index.sizes(spark).get)
    assert index.entries(spark).where(F.col("list") == big).select(F.input_file_name()).distinct().count() > 1
    again = ivf.load(spark, index.folder)
    assert again.probes == index.probes and np.allclose(again.step, index.step)
    ivf.append(again, spark.createDataFrame([(10**6, asked.first().q_unit)], "vec_id long, unit array<double>"))
    first = asked.first().query_id
    assert 10**6 in {r.vec_id for r in ivf.search(again, asked.where(F.col("query_id") == first), 3).collect()}


def test_index_of_the_given_vectors(spark, sf_dir):
    got = registry.QUERIES["vec08_ann_join"](spark, sf_dir).collect()
    assert got and {r.recall >= 0.9 and r.scored_share <= 0.05 for r in got} == {True}


def test_index_edges(spark, tmp_path):
    schema = "vec_id long, unit array<double>"
    with pytest.raises(ValueError):
        ivf.build(spark.createDataFrame([(1, None), (None, [1.0])], schema))
    index = ivf.build(spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (None, [0.0, 1.0]), (3, [0.0, 0.0])], schema))
    ask = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None)], "query_id string, q_unit array<double>")
    assert [(r.query_id, r.vec_id, r.rank) for r in ivf.search(index, ask, 2).orderBy("rank").collect()] == [("a", 1, 1), ("a", 2, 2)]
    assert ivf.search(index, ask.limit(0)).collect() == [] and vector.search_exact(vector.normalised(ask.limit(0), "q_unit", "unit").withColumn("vec_id", F.lit(1)), ask, 2).collect() == []


def test_best_keeps_ties_by_id():
    r = np.random.default_rng(0)
    best, all_of = Best(5, 4), []
    for b in range(6):
        ids, scores = r.permutation(50) + 50 * b, r.integers(0, 6, (5, 50)).astype(float)
        best.add(np.arange(5), ids, scores, tag=b)
        all_of += [(q, -scores[q, i], ids[i]) for q in range(5) for i in range(50)]
    want = [x for q in range(5) for x in sorted(x for x in all_of if x[0] == q)[:4]]
    assert [(q, -s, i) for q, s, i in zip(best.query, best.score, best.id, strict=True)] == want and (best.tag == best.id // 50).all()


# ---- greedy keep-last -----------------------------------------------------------------------


def greedy(records, keys):
    seen, out = set(), []
    for r in sorted(records, key=lambda r: -r["n"]):
        own = {(i, *(r[k] for k in key)) for i, key in enumerate(keys) if all(r[k] not in (None, "", " nan ") for k in key)}
        if not own & seen:
            seen |= own
            out.append(r["n"])
    return sorted(out)


@pytest.mark.parametrize("spread,seed", [(4, 1), (30, 2), (120, 3), (10**6, 4)])
def test_keep_last_equals_a_loop(spark, spread, seed):
    r = random.Random(seed)
    value = lambda: r.choice([None, "", " nan "]) if r.random() < 0.3 else f"v{r.randrange(spread)}"
    records = [{"n": i, "a": value(), "b": value(), "c": value()} for i in range(400)]
    records += [{"n": 1000 + i, "a": f"chain{i}", "b": f"chain{i + 1}", "c": None} for i in range(12)]
    records += [{"n": 1000 + i + 0.5, "a": f"chain{i}", "b": None, "c": f"chain{i}"} for i in range(0, 12, 3)]
    keys = [["a"], ["b"], ["a", "c"]]
    df = spark.createDataFrame([(float(x["n"]), x["a"], x["b"], x["c"]) for x in records], "n double, a string, b string, c string")
    want = greedy(records, keys)
    assert sorted(x.n for x in merge.dedupe_multi(df.repartition(3), "n", keys).collect()) == want
    assert sorted(x.n for x in merge.dedupe_multi(df.orderBy(F.rand(seed)), "n", keys).collect()) == want


def test_ties_are_kept_alike_in_every_run(spark):
    df = spark.createDataFrame([(i % 7, i % 3, f"x{i}") for i in range(200)], "k long, n long, v string")
    for make in (lambda x: merge.keep_one(x, ["k"], [F.desc("n")]), lambda x: merge.dedupe_multi(x, "n", [["k"]]), lambda x: merge.merge_status(x.withColumnRenamed("n", "fail_count"), x.limit(0).withColumnRenamed("n", "fail_count"), "k")):
        assert rows(make(df.repartition(1))) == rows(make(df.orderBy(F.rand(5)).repartition(6)))
    same = spark.createDataFrame([(1, "a")] * 5, "n long, k string")
    assert rows(merge.dedupe_multi(same, "n", [["k"]])) == [(1, "a")] and merge.dedupe_multi(same.limit(0), "n", [["k"]]).count() == 0


# ---- dictionaries ---------------------------------------------------------------------------

TEXTS = ["Python, SQL. and C++/C# with Spring Boot; machine  learning", "ci/cd power bi (R) spring-boot", "", None, "go golang Go! .net node.js", "react native React\nNative", "ünïque go-to"]


def test_skills_by_join_equal_skills_by_scan(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, t string")
    entries = spark.createDataFrame([(s,) for s in [*D.SKILLS, "(r)", ".net", "c++/c#", "ü", "go-to"]], "phrase string")
    got = {r.id: r.labels for r in dictionary.skills_of(df, "id", F.col("t"), entries).collect()}
    words = [r.phrase for r in entries.collect()]
    boundary = f"[{dictionary.SKILL_WORD}]"
    import re

    for i, t in enumerate(TEXTS):
        flat = re.sub(r"\s+", " ", (t or "").lower())
        assert got[i] == sorted({w for w in words if re.search(f"(?<!{boundary}){re.escape(w)}(?!{boundary})", flat)})
    scanned = df.select("id", X.extract_skills(F.col("t"), D.SKILLS).alias("s")).collect()
    assert {r.id: [s for s in got[r.id] if s in D.SKILLS] for r in scanned} == {r.id: r.s for r in scanned}


TITLES = ["Senior Data Scientist (NLP)", "Lead full-stack developer", "Full Stack Developer", "Machine Learning Engineer / Data Engineer", "qa engineer", "financial analyst", "SRE", "Back-end engineer", "UX/UI designer", None, "nan", "barista", "iOS   Engineer II"]


def test_specialties_by_join_and_by_scan(spark):
    df = spark.createDataFrame(list(enumerate(TITLES)), "id long, t string")
    phrases = [*D.SPECIALTY_PHRASES, "Full-Stack Developer", "c++ developer"]
    entries = dictionary.ranked(spark.createDataFrame([(p, i) for i, p in enumerate(phrases)], "phrase string, i int"), "phrase", [F.col("i")])
    got = {r.id: r.label for r in dictionary.specialties(df, "id", F.col("t"), entries).collect()}
    want = {r.id: r.s for r in df.select("id", X.specialty(F.col("t"), phrases, []).alias("s")).collect()}
    assert got == want and got[1] == "Full-Stack Developer" and got[0] == "Senior Data Scientist"
    assert {r.id: r.s for r in df.select("id", X.specialty(F.col("t")).alias("s")).collect()}[5] == "Financial Analyst"


def test_plan_does_not_grow_with_entries(spark):
    df = spark.createDataFrame([(i, f"word{i} word{i + 1} of nothing") for i in range(50)], "id long, t string")
    plans = []
    for n in (10, 100_000):
        entries = spark.range(n).select(F.concat_ws(" ", F.concat(F.lit("word"), "id"), F.concat(F.lit("word"), F.col("id") + 1)).alias("phrase"))
        out = dictionary.skills_of(df, "id", F.col("t"), entries)
        assert out.where("size(labels) = 1").count() == min(n, 50)
        plans.append(len(out._jdf.queryExecution().optimizedPlan().toString()))
    assert abs(plans[0] - plans[1]) < 200


def test_first_phrase_inside_words(spark):
    df = spark.createDataFrame([(0, "abcabd"), (1, "xx"), (2, None), (3, ""), (4, "zabd\nq")], "id long, t string")
    entries = spark.createDataFrame([("bd\nq", 1), ("abd", 2), ("x", 3), ("ab", 4), ("bcab", 5)], "phrase string, rank int").withColumn("label", F.col("phrase"))
    hits = dictionary.substring_hits(df, "id", F.coalesce("t", F.lit("")), entries)
    assert sorted((r.id, r.phrase) for r in hits.collect()) == sorted([(0, "abd"), (0, "ab"), (0, "bcab"), (1, "x"), (4, "bd\nq"), (4, "abd"), (4, "ab")])
    assert {r.id: r.label for r in dictionary.first_label(df, "id", hits).collect()} == {0: "abd", 1: "x", 2: None, 3: None, 4: "bd\nq"}
    assert dictionary.substring_hits(df, "id", F.col("t"), entries.limit(0)).count() == 0 and dictionary.hits(df, "id", F.col("t"), dictionary.entries(entries.limit(0), "a-z")).count() == 0


# ---- rates and ranks ------------------------------------------------------------------------


def test_as_of_by_sort_and_by_day_equal_a_loop(spark):
    r, day = random.Random(3), datetime.date(2020, 1, 1)
    quotes = [(day + datetime.timedelta(days=r.randrange(900)), c, "RUB", float(i)) for i, c in enumerate(["USD", "EUR", "USD", "GBP"] * 20)]
    facts = [(i, r.choice(["USD"] * 20 + ["eur ", "GBP", "RUB", "XXX", None]), None if r.random() < 0.05 else day + datetime.timedelta(days=r.randrange(-50, 1100))) for i in range(600)]
    rates = spark.createDataFrame(quotes, "rate_date date, base_currency string, target_currency string, rate double").withColumn("rate", F.col("rate").cast("decimal(18,6)"))
    df = spark.createDataFrame(facts, "id long, currency string, date date")

    def loop(c, d):
        c = c and c.strip().upper()
        if c == "RUB":
            return 1.0
        return max(((q[0], q[3]) for q in quotes if q[1] == c and d and q[0] <= d), default=(None, None))[1]

    want = sorted((i, loop(c, d)) for i, c, d in facts)
    value = lambda out: sorted((x.id, None if x.rate is None else float(x.rate)) for x in out.collect())
    assert value(fx.as_of_rate(df, rates, "RUB")) == want
    assert value(fx.as_of_rate(df, rates, "RUB", broadcast_rows=1)) == want
    assert value(fx.as_of_by_sort(df, rates, "RUB", task_rows=7)) == want
    assert value(fx.as_of_by_sort(df, rates.limit(0), "RUB")) == [(i, 1.0 if (c or "").strip() == "RUB" else None) for i, c, _ in facts]


def test_ranks_equal_sorted_lists(spark):
    r = random.Random(1)
    data = [(k, r.choice([None, 0.0, -5.5, 1e-9, 100.0]) if r.random() < 0.4 else round(r.uniform(-1000, 1e6), 2)) for k in ("a", "b", "b", "b", None) for _ in range(90)] + [("one", 3.0), ("none", None)]
    df = spark.createDataFrame(data, "k string, v double").repartition(4)
    points = [0.0, 0.25, 0.5, 0.9, 1.0, upper_median, tenth_from_above]
    got = {x.k: x for x in quantiles(df, ["k"], "v", points).collect()}
    for key in {k for k, _ in data}:
        own = sorted(v for k, v in data if k == key and v is not None)
        if not own:
            assert key not in got
            continue
        n = len(own)
        want = [*np.percentile(own, [0, 25, 50, 90, 100]), own[n // 2], own[n - 1 - n // 10]]
        assert np.allclose(got[key].q, want) and got[key].n == n and np.isclose(got[key].mean, np.mean(own))
    whole = quantiles(df.where("k is null"), [], "v", [0.5]).first()
    assert np.isclose(whole.q[0], got[None].q[2])
    empty = quantiles(df.limit(0), [], "v", [0.5]).first()
    assert (empty.q, empty.n, empty.mean) == ([None], 0, None)
    stats = df.groupBy("k").agg(F.count("*").alias("c"))
    assert {x.k: x.q is None for x in with_quantiles(stats, quantiles(df, ["k"], "v", [0.5]), ["k"]).collect()} == {k: k == "none" for k, _ in data}
    assert quantiles(df, ["k"], "v", [0.5], approximate=True).where("k = 'one'").first().q == [3.0]


def test_no_plan_keeps_the_values_of_a_group(spark, sf_dir):
    b = marts.base_v2(views.jobs(spark, sf_dir), views.rates(spark, sf_dir))
    for df in (marts.salary_agg_v2(b), marts.role_stats_v2(b), marts.skill_stats_v2(b, views.job_skills(spark, sf_dir)), match.remote_comparison(b), match.salary_benchmark_live(b), match.market_context(b, F.col("salary_mid"), ["role"], "tenth")):
        assert "percentile" not in df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_branch_is_chosen_while_the_plan_runs(spark, sf_dir):
    b = marts.base_v2(views.jobs(spark, sf_dir), views.rates(spark, sf_dir)).withColumn("remote", F.col("is_remote"))
    own, names = views.job_skills(spark, sf_dir), views.skills(spark, sf_dir)
    for least, live in ((1, False), (10**6, True)):
        last = lambda: max(spark.sparkContext.statusTracker().getJobIdsForGroup(None), default=-1)
        before = last()
        out = match.top_skills_for_market(marts.role_stats_v2(b, least), marts.skill_stats_v2(b, own, least), b, own, names, 50, country="NATION_3")
        assert last() == before  # no job yet
        want = match.top_skills_live(b, own, names, 50, country="NATION_3") if live else match.top_skills_from_marts(marts.role_stats_v2(b, least), marts.skill_stats_v2(b, own, least), names, 50, country="NATION_3")
        assert [tuple(r) for r in out.collect()] == [tuple(r) for r in want.collect()]


# ---- histories and versions -----------------------------------------------------------------


@pytest.mark.parametrize("seed", [1, 2])
def test_history_equals_change_points_in_any_order(spark, tmp_path, seed):
    r = random.Random(seed)
    seen = {t: [(k, r.choice(["x", "y", None])) for k in range(25) if r.random() < 0.7] for t in range(7)}
    order = list(seen)
    r.shuffle(order)
    root = str(tmp_path / "history")
    for t in [*order, order[0]]:
        history.merge_snapshot(spark.createDataFrame([*seen[t], *seen[t][:2], (None, "x")], "k long, v string"), root, "k", t, ["v"])
    full = spark.createDataFrame([(k, t, v) for t, some in seen.items() for k, v in some], "k long, at int, v string")
    assert rows(history.change_points(spark, root, "k").select("k", "at", "v")) == rows(merge.change_points(full, "k", "at", ["v"]).select("k", "at", "v"))
    valid = history.intervals(spark, root, "k")
    assert valid.where("valid_to <= valid_from").count() == 0 and valid.where("valid_to is null").count() == full.select("k").distinct().count()
    assert history.merge_snapshot(full.where("at = 6").select("k", "v"), root, "k", 6, ["v"]) == 0
    again = spark.createDataFrame([(k, v) for k, v in seen[6]], "k long, v string")
    assert history.merge_snapshot(again, root, "k", 9, ["v"]) == len({k for k, v in seen[6] if v != dict((row.k, row.v) for row in valid.where("valid_to is null").collect()).get(k)})


def test_two_writers_and_expiry(spark, tmp_path):
    root, df = str(tmp_path / "table"), lambda *x: spark.createDataFrame([(i,) for i in x], "n long")
    assert versions.read(spark, root) is None and versions.append(df(1), root) == 0
    first = {r.n for r in versions.read(spark, root).collect()}
    number, _ = versions.version(spark, root)
    versions.append(df(2), root)  # another writer
    with pytest.raises(versions.ConflictError):
        versions.replace(df(9), root, number)
    tries = []

    def doubled(old):
        tries.append(1)
        if len(tries) == 1:
            versions.append(df(3), root)  # comes in between: the first try is lost
        return old.select((F.col("n") * 2).alias("n"))

    versions.update(spark, root, doubled)
    assert len(tries) == 2 and rows(versions.read(spark, root)) == [(2,), (4,), (6,)] and {r.n for r in versions.read(spark, root, 0).collect()} == first
    for i in range(9):
        versions.append(df(100 + i), root)
    assert versions.compact(spark, root, least_parts=8) is not None and len(versions.version(spark, root)[1]["parts"]) == 1
    before = rows(versions.read(spark, root))
    df(5).write.parquet(f"{root}/part-of-a-writer-at-work")
    gone = versions.expire(spark, root, keep=2)
    assert gone and rows(versions.read(spark, root)) == before and len(versions.numbers(spark, root)) == 2
    left = set(tables.children(spark, root)) - {"log"}
    assert left == {p for n in versions.numbers(spark, root) for p in versions.version(spark, root, n)[1]["parts"]} | {"part-of-a-writer-at-work"}
    with pytest.raises(LookupError):
        versions.version(spark, root, 0)
    assert "part-of-a-writer-at-work" in versions.expire(spark, root, keep=2, unused_seconds=-1)


def test_latest_versions_expire(spark, tmp_path):
    for i in range(5):
        tables.write_latest(spark.createDataFrame([(i,)], "n long"), str(tmp_path), keep=2)
    assert len([c for c in tables.children(spark, f"{tmp_path}/clean") if c.startswith("version=")]) == 2
    assert spark.read.parquet(tables.resolve_clean(spark, str(tmp_path))).first().n == 4


def test_tolerant_read(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("pay", T.DoubleType()), T.StructField("remote", T.BooleanType())])
    files = {
        "good.csv": '﻿id,pay,remote\na,1.5,true\n"b\nb",,false\n',
        "rows.csv": "id,pay,remote\nc,2,true\nd,much,true\ne,1\nf,1,true,more\ng,3,maybe\n",
        "head.csv": "id,salary,remote\nh,1,true\n", "only.csv": "id,pay,remote\n", "empty.csv": "",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    paths = [f"{tmp_path}/{n}" for n in (*files, "missing.csv")]
    good, damaged = tables.read_tolerant(spark, paths, schema)
    assert rows(good) == rows(spark.createDataFrame([("a", 1.5, True), ("b\nb", None, False), ("c", 2.0, True)], schema)) and good.schema == schema
    assert {(r.file, r.reason) for r in damaged.collect()} == {("rows.csv", "type: pay"), ("rows.csv", "columns"), ("rows.csv", "type: remote"), ("head.csv", "header"), ("empty.csv", "empty"), ("missing.csv", "missing")}
    assert damaged.where("reason = 'columns'").count() == 2 and damaged.where("reason = 'header'").first().record == "id,salary,remote"
    with pytest.raises(FileNotFoundError):
        tables.read_many(spark, [f"{tmp_path}/missing.csv"], schema)


def test_queries_of_this_module_are_registered():
    assert {"txt01_dictionary_join", "jon04_asof_sorted", "his01_incremental", "udf03_top_skills_live"} <= set(registry.ORACLE_SQL) and engine_queries.SNAPSHOTS


@pytest.mark.parametrize("sent", [100_000, 0])
def test_sent_and_joined_dictionaries_give_the_same(spark, monkeypatch, sent):
    """Entries of one and many pieces, with open and closed ends, beside the text's ends and each other; equal phrases of several labels; keys of any name."""
    import re

    monkeypatch.setattr(dictionary, "SENT_ROWS", sent)
    words = ["ab", "ab cd", "(ab", "ab)", "é", "éa", "aé", "é é", " ab", "ab ", "c++", "-", ".", "x.y z", "😀", "😀ab", "ab\n"]
    texts = ["ab cd", "(ab)", "éaé é é", "zab abz ab", " ab  ab ", "c++ c+++ c++é", "x.y z. x.y z", "😀ab 😀", "ab\nab", "", None, "-. - .", "é"]
    df = spark.createDataFrame(list(enumerate(texts)), "`my id` int, t string")
    table = spark.createDataFrame([(w, f"{w}{i}", i) for w in words for i in (2, 1)], "phrase string, label string, rank int")
    found = dictionary.hits(df, "my id", F.col("t"), dictionary.entries(table, dictionary.SKILL_WORD))
    assert ("MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()) == (sent > 0)  # one look at a text, whatever the entries' lengths
    b = f"[{dictionary.SKILL_WORD}]"
    want = sorted((i, w, f"{w}{n}", n) for i, t in enumerate(texts) for w in words for n in (1, 2) if w.strip() and re.search(f"(?<!{b}){re.escape(w)}(?!{b})", t or ""))
    assert sorted(tuple(r) for r in found.collect()) == want and dict(found.dtypes)["my id"] == "int"


def test_rows_without_rivals_are_neither_stored_nor_shuffled(spark, monkeypatch):
    """Of 3,000 rows few share a key; only these go into the rounds, also in many small buckets and chunks, and the result is that of a loop."""
    from talentmill.operators import rivals

    written = []
    monkeypatch.setattr(merge, "stored", lambda df, name, f=merge.stored: written.append((name, f(df, name))) or written[-1][1])
    monkeypatch.setattr(rivals, "BUCKET", 200)
    monkeypatch.setattr(rivals, "CHUNK", 70)
    records = [{"n": i, "a": f"a{i % 2900}", "b": None if i % 5 == 0 else f"b{i if i % 40 else 7}"} for i in range(3000)]
    df = spark.createDataFrame([(x["n"], x["a"], x["b"]) for x in records], "n long, a string, b string").repartition(5)
    got = merge.dedupe_multi(df, "n", [["a"], ["b"]])
    assert sorted(x.n for x in got.collect()) == greedy(records, [["a"], ["b"]])
    assert dict(written)["rows"].count() < 600
    assert got.columns == df.columns
