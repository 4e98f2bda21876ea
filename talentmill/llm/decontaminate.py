"""Benchmark decontamination by pigeonhole edit matching (operator 10).

Texts and items are normalised to lower-case words with one blank between. An item of m
characters may differ by ``m // per_edit`` edits (at least one). It is split into budget + 1
pieces: a passage within the budget holds one of them unchanged. Pieces of a block of items form
one Aho-Corasick automaton; each hit fixes where the passage must lie, and Myers' bit-parallel
distance over that window decides. Items that normalise to fewer than ``least_chars`` characters
have no budget: they match where they stand unchanged as whole words.

Items are taken in blocks of bounded bytes, so that each automaton has a fixed bound; a task holds
``held_bytes`` of texts at a time and takes one block after the other over them. Texts are never moved.

Edge cases: null or empty texts and items match nothing, as do items without a letter or digit; a
very long text is searched whole, in one pass a block; equal items are reported one by one, ties
between places of an item go to the first; repeated rows are judged alike; an empty table gives an
empty result; other columns of ``docs`` are kept as they are, and if one is called like the new
column, the new one gets underscores.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentmill.llm._common import free_name, tidy, worker_cache

_WORDS = re.compile(r"[^\W_]+")
HIT = pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("budget", pa.int32()), ("begin", pa.int64())])
HITS = "array<struct<item_id:long,distance:int,budget:int,begin:long>>"


def normalise(text: str | None) -> str:
    return " ".join(_WORDS.findall((text or "").lower()))


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 pieces of near equal length with their offsets."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def distance_within(item: str, text: str, masks: dict[str, int]) -> int:
    """Least edit distance between the item and any substring of the text (Myers' bit vectors)."""
    m = len(item)
    every, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = every, 0, m
    best = m
    for c in text:
        eq = masks.get(c, 0)
        vertical = eq | minus
        across = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | (every & ~(across | plus)), plus & across
        if up & high:
            score += 1
        elif down & high:
            score -= 1
            if score < best:
                best = score
        up, down = (up << 1) & every, (down << 1) & every
        plus, minus = down | (every & ~(vertical | up)), up & vertical
    return best


def masks_of(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


class Matcher:
    """Automaton over the pieces of a block of items."""

    def __init__(self, items: list[tuple[int, str]], per_edit: int, least_chars: int):
        self.items: list[tuple[int, str, int, dict[str, int]]] = []
        held: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            t = normalise(text)
            if not t:
                continue
            budget = max(1, len(t) // per_edit)
            if len(t) < least_chars:
                t, budget = f" {t} ", 0
            for at, piece in pieces(t, budget):
                held.setdefault(piece, []).append((len(self.items), at))
            self.items.append((item_id, t, budget, masks_of(t)))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in held.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if held:
            self.automaton.make_automaton()

    def hits(self, text: str) -> list[dict]:
        """Best hit of each item in a text."""
        if not self.items:
            return []
        text = f" {normalise(text)} "
        tried: set[tuple[int, int]] = set()
        best: dict[int, tuple[int, int]] = {}
        for end, (size, owners) in self.automaton.iter(text):
            for k, at in owners:
                _, item, budget, masks = self.items[k]
                begin = end + 1 - size - at  # where the item would start without edits
                if best.get(k, (1,))[0] == 0 or (k, begin) in tried:
                    continue
                tried.add((k, begin))
                a = max(0, begin - budget)
                part = text[a : max(0, begin + len(item) + budget)]
                d = 0 if item in part else distance_within(item, part, masks)
                if d <= budget and d < best.get(k, (budget + 1,))[0]:
                    best[k] = (d, max(0, begin - (budget > 0)))  # texts have a blank more in front, as have short items
        return [{"item_id": self.items[k][0], "distance": d, "budget": self.items[k][2], "begin": at} for k, (d, at) in sorted(best.items())]


def flag_contaminated(docs: DataFrame, benchmark: DataFrame, per_edit: int = 20, least_chars: int = 24, block_bytes: int = 4_000_000, held_bytes: int = 64_000_000, name: str = "contamination") -> DataFrame:
    """``docs`` with a last column ``name``: the benchmark items that a text holds, within their error budgets."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("length(text) > 0")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = 1 + total // block_bytes
    blocks = []
    for k in range(n_blocks):  # each is of bounded bytes and leaves the driver before the next is read
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k).orderBy("item_id", "text").collect()
        blocks.append(spark.sparkContext.broadcast([(r.item_id, r.text) for r in block]))
    run = uuid.uuid4().hex
    name = free_name(name, docs.columns)
    text_at = docs.columns.index("text")

    def matched(texts: list[list]) -> list[list[list[dict]]]:
        """Hits of each text of each batch, one block of items after the other."""
        found = [[[] for _ in own] for own in texts]
        for k, shared in enumerate(blocks):
            matcher = worker_cache("decontaminate", (run, k), lambda shared=shared: Matcher(shared.value, per_edit, least_chars))
            for own, out in zip(texts, found, strict=True):
                for t, hits in zip(own, out, strict=True):
                    hits += matcher.hits(t)
        return found

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def done() -> Iterator[pa.RecordBatch]:
            for b, hits in zip(held, matched([b.column(text_at).cast(pa.string()).to_pylist() for b in held]), strict=True):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hits, pa.list_(HIT))], names=[*b.schema.names, name])

        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                held.append(whole.slice(at, 512))
                size += held[-1].nbytes
                if n_blocks == 1 or size >= held_bytes:
                    yield from done()
                    held, size = [], 0
        yield from done()

    return docs.mapInArrow(tidy(flag), docs.withColumn(name, F.lit(None).cast(HITS)).schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """A row for each document and the item it holds: doc_id, item_id, distance, budget, begin."""
    flagged = flag_contaminated(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, **options)
    return flagged.select("doc_id", F.explode("contamination").alias("hit")).select("doc_id", "hit.*")
