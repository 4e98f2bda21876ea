"""From raw documents to packed training windows, by the operators of talentmill.llm.

Stages take null, empty and very long texts, null ids, repeated rows, empty tables and further columns of any name: what an
operator says of them in its docstring holds for its stage. All but the last keep the columns of their input. Rows without an id
pass all filters that go by ids; a null text has no n-grams, benchmark items or personal data, and is scored like an empty one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentmill.llm import decontaminate, jaccard, packing, pii, quality
from talentmill.llm._common import free_name, materialise
from talentmill.llm.queries import table, tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    score = free_name("score", docs.columns)
    scored = quality.add_score(docs, quality.train(docs, table(spark, sf_dir, "labels")), score)
    return scored.where(F.col(score) >= 0.3).drop(score)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the least id, of each class of five-word shingle similarity 0.8 or more."""
    return jaccard.one_of_each(docs, k=5, num=4, den=5)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its error budget."""
    flagged = decontaminate.flag_contaminated(docs, table(spark, sf_dir, "benchmark"))
    hits = flagged.columns[-1]
    return flagged.where(F.size(hits) == 0).drop(hits)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by marks; n_chars follows the text."""
    redacted = pii.redact(docs)
    return redacted.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 4096 token ids."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("pii", redact_personal_data),
    ("packing", pack_windows),
]

#: No stage's decisions can be stated in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
