"""The pipeline's stages against brute force, each on its own input."""

import re
from collections import Counter

from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from talentmill.llm import decontaminate, pii, quality
from talentmill.llm._common import materialise
from talentmill.llm.queries import table, tokenizer_path
from tests.llm.fixture import corpus
from tests.llm.test_free import least_distance
from tests.llm.test_jaccard import brute


def test_stages_one_by_one(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    labels, items = table(spark, sf_dir, "labels"), table(spark, sf_dir, "benchmark").collect()
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = materialise(stage(spark, before, sf_dir))
        old, new = before.collect(), after.collect()
        if name != "packing":
            assert after.columns == docs.columns
        if name == "quality":
            good = {r.doc_id for r in quality.quality(docs, labels).collect() if r.predicted}
            assert sorted(r.doc_id for r in new) == sorted(good)
            marks = {r.doc_id: r.quality for r in labels.collect()}
            assert sum(marks[d] == 1 for d in good if d in marks) >= 0.97 * sum(q == 1 for q in marks.values())
        if name == "near_duplicates":
            assert sorted(r.doc_id for r in new) == sorted(d for d, _, c in brute([(r.doc_id, r.text) for r in old], 5, 4, 5) if d == c)
        if name == "decontamination":
            leaks = set()
            for r in old:
                text = decontaminate.normalise(r.text)
                for i in items:
                    item = decontaminate.normalise(i.text)
                    if item in text or len(text) < 600 and least_distance(item, text) <= max(1, len(item) // 20):
                        leaks.add(r.doc_id)
            assert {r.doc_id for r in old} - {r.doc_id for r in new} == leaks
        if name == "pii":
            spans = {r.doc_id: r.spans for r in pii.add_spans(before).collect()}
            text = {r.doc_id: r for r in new}
            assert len(old) == len(new)
            for r in old:
                at, out = 0, ""
                for s in spans[r.doc_id]:
                    if s.start >= at:
                        out += r.text[at : s.start] + f"<{s.kind}>"
                    at = max(at, s.end)
                want = out + r.text[at:]
                assert text[r.doc_id].text == want and text[r.doc_id].n_chars == len(want)
                assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", want)
        if name == "packing":
            t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
            want = Counter(i for r in old for i in [*t.encode(r.text, add_special_tokens=False).ids, 2])
            assert Counter(int.from_bytes(r.ids[i : i + 4], "little") for r in new for i in range(0, len(r.ids), 4)) == want
        before = after
    assert corpus_pipeline.run(spark, sf_dir).count() == after.count()


def test_stages_take_awkward_rows(spark, sf_dir):
    docs = start = corpus(spark).withColumns({"contamination": F.lit("c"), "base": F.lit(1), "spans": F.lit("s"), "text_": F.lit("t"), "other_id": F.lit(2)})
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
        if name != "packing":
            assert docs.columns == start.columns and docs.select("contamination", "base", "spans", "text_", "other_id").distinct().count() == 1
    assert docs.count()
    docs = corpus(spark).drop("score").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    assert docs.count() == 0
