"""Token counts of whole texts (operator 2).

Map-side two-tier lookup. A text is cut into units at white space, so that byte-level
pre-tokens never cross a unit; equal units always have equal token counts. Tier one is a
broadcast table of the lengths of the most frequent units (at most ``table_size`` entries,
a fixed bound); tier two is a cache in each Python worker, filled by encoding the units that
tier one lacks. No unit is shuffled for the counting itself: the frequent table comes from
bounded summaries (``summary_size`` units a task) that cover all rows.

Edge cases: a null or empty text has 0 bytes and 0 tokens; very long texts are counted whole, and
long units are encoded each time instead of being kept; ties for the last places of the table go to
the least unit, and do not change a count; null ids are kept; repeated rows are counted one by one;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentmill.llm._common import batch, strings, text_or_empty, tidy, worker_cache

#: White space of the pre-tokeniser's pattern (Unicode White_Space).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The pre-tokeniser whose pieces never cross white space but for one leading blank; others get whole texts.
_CUT = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
_ADJACENT = re.compile(f"[{SPACE}][{SPACE}]")
_UNITS = re.compile(f"[{SPACE}]+(?![^{SPACE}])| ?[^{SPACE}]+|[{SPACE}]")


def units(text: str) -> list[str]:
    """Pieces whose token counts add up to the text's."""
    if " " not in text or _ADJACENT.search(text):
        return _UNITS.findall(text)
    head, *rest = text.split(" ")  # single white space throughout: each further piece owns the space before it
    return [head, *map(" ".__add__, rest)] if head else [*map(" ".__add__, rest)]


class UnitEncoder(dict):
    """unit -> number of tokens; misses are encoded, and those of at most ``longest`` characters cached up to ``room`` entries."""

    def __init__(self, path: str, room: int = 600_000, longest: int = 64):
        from tokenizers import Tokenizer

        self.tokenizer, self.room, self.longest = Tokenizer.from_file(path), room, longest
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        made = json.loads(self.tokenizer.to_str())
        self.in_units = made["normalizer"] is None and made["pre_tokenizer"] == _CUT
        self.split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def __missing__(self, unit: str) -> int:
        n = len(self.tokenizer.encode(unit, add_special_tokens=False).ids)
        if len(self) < self.room and len(unit) <= self.longest:
            self[unit] = n
        return n

    def count(self, text: str, frequent: dict[str, int]) -> int:
        if not self.in_units:
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        total, parts = 0, [text]
        if self.split and self.split.search(text):
            parts = self.split.split(text)
            total = len(parts) - 1  # each special string is one token
        for part in parts:
            pieces = units(part)
            tier_one = [*map(frequent.get, pieces)]
            if None in tier_one:
                total += sum(self[p] for p, n in zip(pieces, tier_one, strict=True) if n is None)
                tier_one = filter(None, tier_one)
            total += sum(tier_one)
        return total


def encoder(path: str) -> UnitEncoder:
    return worker_cache("tokens", path, lambda: UnitEncoder(path))


def frequent_units(docs: DataFrame, table_size: int, summary_size: int) -> list[str]:
    """Most frequent units over all rows; each task sends ``summary_size`` counts at most."""
    schema = pa.schema([("unit", pa.string()), ("n", pa.int64())])

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for b in batches:
            for text in strings(b.column(0)):
                counts.update(units(text))
                if len(counts) > 40 * summary_size:  # forget the rare ones, as in lossy counting
                    counts = Counter(dict(counts.most_common(8 * summary_size)))
        top = counts.most_common(summary_size)
        yield batch(schema, [u for u, _ in top], [n for _, n in top])

    found = docs.select(text_or_empty()).mapInArrow(tidy(summarise), "unit string, n long")
    top = found.groupBy("unit").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "unit").limit(table_size)
    return [r.unit for r in top.collect()]


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, table_size: int = 8192, summary_size: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs`` (doc_id, text)."""
    names = frequent_units(docs, table_size, summary_size)
    known = encoder(tokenizer_path)
    shared = docs.sparkSession.sparkContext.broadcast({u: known[u] for u in names})
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, own = shared.value, encoder(tokenizer_path)
        for b in batches:
            yield batch(schema, b.column(0), b.column(1), [own.count(t, frequent) for t in strings(b.column(2))])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text_or_empty()).cast("long").alias("n_bytes"), text_or_empty().alias("text"))
    return rows.mapInArrow(tidy(count), "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
