"""Operator 3 against brute force."""

import random
import re

import pytest

from talentmill.llm import jaccard
from talentmill.llm.queries import table
from tests.llm.fixture import SCHEMA, corpus, empty, prose


def brute(rows, k, num, den):
    """(doc_id, n, component) by all pairs of distinct sets."""
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        s = frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()
        sets.setdefault(s, []).append(d)
    keys = [s for s in sets if s]
    root = {s: s for s in keys}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    for i, a in enumerate(keys):
        for b in keys[:i]:
            common = len(a & b)
            if common * (num + den) >= num * (len(a) + len(b)):
                root[find(a)] = find(b)
    least = {}
    for s in keys:
        least.setdefault(id(find(s)), []).extend(d for d in sets[s] if d is not None)
    out = []
    for s, ids in sets.items():
        out += [(d, len(s), (min(least[id(find(s))], default=None) if s else d)) for d in ids]
    return sorted(out, key=str)


def run(frame, k, num, den, **options):
    return sorted((tuple(r) for r in jaccard.near_duplicates(frame, k, num, den, **options).collect()), key=str)


@pytest.mark.parametrize("k,num,den,near", [(3, 9, 10, 4), (5, 4, 5, 32), (3, 9, 10, 2), (1, 4, 5, 3)])
def test_against_brute_force(spark, k, num, den, near):
    r = random.Random(k + near)
    rows = [(d, t) for d, t in corpus(spark).select("doc_id", "text").collect()]
    for i in range(220):  # sets around the boundary of light and heavy, with chains of edits
        words = prose(500 + i // 20, 6 + i // 8).split() if i % 20 == 0 else words
        words = [*words]
        words[r.randrange(len(words))] = r.choice(["new", "old", "odd"])
        rows.append((1000 + i, " ".join(words)))
    frame = spark.createDataFrame([(d, t, None, None, None, None) for d, t in rows], SCHEMA)
    assert run(frame, k, num, den, near=near, width=1 << 14) == brute(rows, k, num, den)


@pytest.mark.parametrize("block", [12, 1024])
def test_long_lists_over_blocks_and_sizes(spark, monkeypatch, block):
    """Groups of near copies whose lists take several blocks and sizes: all blocks of like sizes meet, so no link between classes is lost."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    r, rows = random.Random(4), []
    for g, (words, most) in enumerate([(90, 4), (30, 2), (160, 7)]):
        base = prose(70 + g, words).split()
        for _ in range(130):
            t = [*base]
            for _ in range(r.randrange(most + 1)):
                at = r.randrange(len(t))
                t[at : at + r.randrange(2)] = [f"x{r.randrange(10**6)}"] * r.randrange(2)
            rows.append((len(rows), " ".join(t)))
    frame = spark.createDataFrame([(d, t, None, None, None, None) for d, t in rows], SCHEMA).repartition(3)
    assert run(frame, 3, 9, 10, turns=0) == brute(rows, 3, 9, 10)


def test_boundary_by_cost():
    bounds = jaccard.Bounds(9, 10)
    assert bounds.light(1.0) < bounds.light(20.0) < bounds.light(1000.0)
    assert list(bounds.subset_sizes(9)) == [9] and list(bounds.subset_sizes(10)) == [9, 10] and bounds.prefix(100) == 11


def test_edges(spark):
    assert jaccard.near_duplicates(empty(spark)).count() == 0
    kept = jaccard.one_of_each(corpus(spark))
    assert kept.columns == corpus(spark).columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(310) == 0 and ids.count(3) == 1 and ids.count(None) == 2 and {300, 301, 302, 303} <= {*ids}
    assert sum(100 <= (i or 0) < 112 for i in ids) == 1 and sum(200 <= (i or 0) < 212 for i in ids) == 0


def test_on_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [(d, t) for d, t in docs.select("doc_id", "text").collect()]
    assert run(docs, 3, 9, 10) == brute(rows, 3, 9, 10)


def test_components_edges(spark):
    from talentmill.llm.components import components

    edges = spark.createDataFrame([(5, 4, "x"), (4, 5, "x"), (5, 4, "y"), (9, 5, "x"), (7, 7, "x"), (None, 8, "x"), (8, None, "x"), (None, None, "x"), (20, 21, "x")] + [(100 + i, 101 + i, "z") for i in range(40)], "a long, b long, root string")
    got = {tuple(r) for r in components(edges).collect()}
    assert got == {(4, 4), (5, 4), (9, 4), (20, 20), (21, 20)} | {(100 + i, 100) for i in range(41)}
    assert components(edges.limit(0)).count() == 0


def test_components_of_a_chain_take_few_rounds(spark, monkeypatch):
    """Tasks replace their edges by stars, so that the driver plans few rounds; small chunks give the same."""
    from talentmill.llm import components as module

    written = []
    monkeypatch.setattr(module, "materialise", lambda df, f=module.materialise: written.append(1) or f(df))
    edges = spark.createDataFrame([((7 * i) % 401, (7 * i + 7) % 401) for i in range(400)], "a long, b long").coalesce(1)
    assert {tuple(r) for r in module.components(edges).collect()} == {(i, 0) for i in range(401)}
    assert len(written) <= 3
    assert {tuple(r) for r in module.components(edges, chunk=7).collect()} == {(i, 0) for i in range(401)}
