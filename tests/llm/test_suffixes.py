"""Operator 5 against brute force."""

import hashlib
import random

import numpy as np
import pytest

from talentmill.llm import suffixes
from talentmill.llm.queries import table
from tests.llm.fixture import SCHEMA, corpus, empty, prose


def brute(rows, least=50):
    first = {}
    texts = [(d, (t or "").encode()) for d, t in rows]
    for d, raw in texts:
        if d is not None:
            for p in range(len(raw) - least + 1):
                w = raw[p : p + least]
                first[w] = min(first.get(w, d), d)
    out = []
    for d, raw in texts:
        gone = np.zeros(len(raw), bool)
        if d is not None:
            for p in range(len(raw) - least + 1):
                if first[raw[p : p + least]] < d:
                    gone[p : p + least] = True
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(raw) else 0
        out.append((d, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(frame, **options):
    return sorted((tuple(r) for r in suffixes.remove_repeats(frame, **options).collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"bucket_anchors": 500, "range_rows": 300}, {"range_rows": 400, "hot_anchors": 30}, {"hot_anchors": 2, "most_hot": 40}])
def test_against_brute_force(spark, options):
    r = random.Random(5)
    rows = [(d, t) for d, t in corpus(spark).select("doc_id", "text").collect()]
    passage = prose(77, 70)
    for i in range(60):
        a, b = sorted(r.randrange(len(passage)) for _ in range(2))
        rows.append((400 + i * 7 % 60, prose(800 + i, r.randrange(40)) + passage[a:b] + ("é\0\0" * r.randrange(30)) + prose(900 + i, r.randrange(9))))
    rows += [(500, "x" * 49), (501, "x" * 49), (502, "y" * 50), (503, "y" * 50), (504, "ab" * 700), (505, "ab" * 300 + "c"), (499, "\0" * 130), (498, "\0" * 90 + "q"), (497, passage), (496, passage[20:90] + "|" + passage[20:90])]
    frame = spark.createDataFrame([(d, t, None, None, None, None) for d, t in rows], SCHEMA).repartition(3)
    assert run(frame, **options) == brute(rows)


def test_empty_and_table(spark, sf_dir):
    assert suffixes.remove_repeats(empty(spark)).count() == 0
    docs = table(spark, sf_dir, "documents")
    assert run(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_long_texts_are_cut_into_segments(monkeypatch):
    monkeypatch.setattr(suffixes, "SEGMENT", 1 << 9)
    raw = prose(3, 900).encode()
    _, m, first, last = suffixes.anchors(raw, 50)
    starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last)])
    assert sorted(starts) == [*range(len(raw) - 49)] and (m >= first).all() and (m <= last + 34).all()


def test_loser_tree_and_front_coding():
    r = np.random.default_rng(1)
    cut = suffixes.Suffixes(50)
    keys = r.integers(0, 2, (700, cut.width)).astype(np.uint8) * np.uint8(200)
    keys[::3] = keys[0]
    keys[1::3, :60] = keys[1, :60]
    runs = []
    for part in np.array_split(keys, 7):
        part = np.ascontiguousarray(part[np.lexsort(part.T[::-1])])
        lcp, rests = cut.front_code(part)
        assert (cut.decode(lcp, rests) == part).all()
        runs.append((part.tobytes(), lcp.tolist()))
    merged = [(runs[a][0][i * cut.width : (i + 1) * cut.width], p) for a, i, p in suffixes.merge_runs(runs, cut.width)]
    assert [k for k, _ in merged] == sorted(x.tobytes() for x in keys)
    for (a, _), (b, p) in zip(merged, merged[1:]):
        assert a[:p] == b[:p] and (p == cut.width or a[p] < b[p])


def calls(f, name):
    """What ``f`` returns, and how often Python functions with this in their names are called."""
    import sys

    n = 0

    def count(frame, event, _):
        nonlocal n
        n += event == "call" and name in frame.f_code.co_name

    sys.setprofile(count)
    try:
        return f(), n
    finally:
        sys.setprofile(None)


def test_many_runs_and_short_texts_cost_no_python_for_each():
    """Time at size: neither the merge of a range's runs nor the anchors of short texts take steps of Python for each suffix or text."""
    import pyarrow as pa

    cut = suffixes.Suffixes(50)
    keys = np.random.default_rng(2).integers(97, 122, (6000, cut.width)).astype(np.uint8)
    runs = []
    for part in np.array_split(keys, 300):
        part = np.ascontiguousarray(part[np.lexsort(part.T[::-1])])
        runs.append((part.tobytes(), cut.front_code(part)[0].tolist()))
    merged, n = calls(lambda: [*suffixes.merge_runs(runs, cut.width)], "")
    assert len(merged) == 6000 and n < 6000
    texts = [prose(i, 12).encode() for i in range(400)] + [b"", b"x" * 49, b"\0" * 70, prose(9, 5000).encode(), prose(8, 20).encode()]
    found, n = calls(lambda: [*suffixes.anchored(pa.array(texts, pa.binary()), 50)], "mixed")
    assert n < 40
    got = {(at + o, *x) for at, _, (own, *rest) in found for o, *x in zip(own.tolist(), *(c.tolist() for c in rest))}
    assert got == {(i, *x) for i, t in enumerate(texts) for x in zip(*(c.tolist() for c in suffixes.anchors(t, 50)))}
