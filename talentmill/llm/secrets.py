"""Secrets in texts by a trigram inverted index (operator 12), DataFrame functions only.

From each rule's pattern a Boolean query of trigrams is derived (an alternative of conjunctions that every match must hold,
in lower case). The index holds postings (trigram, key of a text) for the trigrams that some rule asks for, sorted
by trigram in each file, and is stored; equal texts share a key, their hash, so that a lost task makes the same postings
again. Postings of a text are intersected as bits under its key, which gives the rules whose query it meets; these are verified by
the whole pattern on the whole text. Rules without mandatory trigrams (``hex``) scan all texts. Candidates go to the texts by
broadcast up to a counted number of rows, beyond it by a join on the key. A clash of hashes adds candidates, never spans.

Edge cases: a null or empty text has no spans (``base_sha256`` of the empty string); very long texts are searched whole, by
patterns that do not backtrack over more than a keyword's neighbourhood; spans of different kinds may overlap, and of those that start together the kind
listed first comes first; added spans that overlap a base one are left out; repeated rows are judged alike; null ids are kept; an empty table gives
an empty result; other columns are kept by ``add_spans``, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentmill.llm._common import discard, free_name, materialise

#: Candidate texts up to which their keys are broadcast (some 24 bytes each).
BROADCAST_ROWS = 2_000_000
#: Classes of characters and sets of strings that are spelled out when queries are derived.
MOST_CLASS, MOST_STRINGS = 8, 64
SPAN = "array<struct<start:int,ord:int,end:int,kind:string,value:string>>"


@dataclass(frozen=True)
class Rule:
    """A pattern, and the least number of characters of a group of it; ``exact`` gives the same matches of that length without short ones."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    exact: str | None = None


#: Fixed patterns.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18, exact=r"AKIA[A-Z0-9]{14,}+"),
    Rule("hex", r"[0-9a-f]+", 16, exact=r"(?<![0-9a-f])[0-9a-f]{16,}+"),
)
MORE = (
    Rule("github", r"(?<![A-Za-z0-9_])(?:gh[pousr]_[A-Za-z0-9]{36,255}|github_pat_[A-Za-z0-9_]{40,255})(?![A-Za-z0-9_])"),
    Rule("gitlab", r"(?<![A-Za-z0-9_-])glpat-[A-Za-z0-9_-]{20,64}(?![A-Za-z0-9_-])"),
    Rule("slack", r"(?<![A-Za-z0-9-])xox[abeoprs]-[A-Za-z0-9-]{10,255}(?![A-Za-z0-9-])"),
    Rule("google", r"(?<![A-Za-z0-9_-])AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])"),
    Rule("stripe", r"(?<![A-Za-z0-9_])[rs]k_(?:live|test)_[A-Za-z0-9]{16,255}(?![A-Za-z0-9_])"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,1000}\.eyJ[A-Za-z0-9_-]{8,4000}\.[A-Za-z0-9_-]{8,1000}"),
    Rule("pem", r"-----BEGIN (?:[A-Z]{2,10} ){0,2}PRIVATE KEY-----"),
    Rule("userinfo", r"(?<![a-z])(?:https?|ftp|ssh|postgres|postgresql|mysql|mongodb|redis|amqp)://[A-Za-z0-9._-]{1,64}:[A-Za-z0-9._%+!$*-]{6,128}@(?=[A-Za-z0-9])"),
)
RULES = BASE + MORE

Query = frozenset[frozenset[str]]
#: The query that every text meets.
ANY: Query = frozenset([frozenset()])


def least(query: set[frozenset[str]]) -> Query:
    """Without alternatives that another one implies."""
    return frozenset(a for a in query if not any(b < a for b in query))


def both(a: Query, b: Query) -> Query:
    """Either query alone is a valid bound, so the longer one is given up where the product gets too large."""
    if len(a) * len(b) > MOST_STRINGS * 4:
        return min(a, b, key=len)
    return least({x | y for x in a for y in b})


def of_strings(strings: set[str]) -> Query:
    """What holds where one of the strings does."""
    return least({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def trigram_query(pattern: str) -> Query:
    """Alternatives of sets of lower-case trigrams, one of which any match of the pattern holds completely."""

    def characters(items: list) -> set[str] | None:
        out: set[str] = set()
        for op, value in items:
            if op is C.LITERAL:
                out.add(chr(value).lower())
            elif op is C.RANGE and value[1] - value[0] < 64:
                out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return out if len(out) <= MOST_CLASS else None

    def visit(items) -> tuple[set[str] | None, Query]:
        """All strings that the items can match, if they are few and next to each other; else None and the items' query."""
        exact, query, whole = {""}, ANY, True
        for op, value in items:
            strings, own = None, ANY
            if op is C.LITERAL:
                strings = {chr(value).lower()}
            elif op is C.IN:
                strings = characters(value)
            elif op is C.SUBPATTERN:
                strings, own = visit(value[-1])
            elif op is C.BRANCH:
                parts = [visit(p) for p in value[1]]
                if all(p[0] is not None for p in parts):
                    strings = set().union(*(p[0] for p in parts))
                else:
                    own = least(set().union(*(of_strings(p[0]) if p[0] is not None else p[1] for p in parts)))
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
                low, high, inner = value
                once, own = visit(inner)
                if low == 0:
                    strings, own = ({"", *once} if high == 1 and once is not None else None), ANY
                elif low == high == 1:
                    strings = once
                elif once is not None:
                    own = of_strings(once)
            elif op in (C.AT, C.ASSERT, C.ASSERT_NOT):
                strings = {""}
            if strings is None or len(exact) * len(strings) > MOST_STRINGS:
                query, exact, whole = both(both(query, own), of_strings(exact)), {""}, False
            if strings is not None:
                exact = {a + b for a in exact for b in strings}
        return (exact, ANY) if whole else (None, both(query, of_strings(exact)))

    C = re._constants
    strings, query = visit(re._parser.parse(pattern))
    return of_strings(strings) if strings is not None else query


def vocabulary(rules: tuple[Rule, ...] = RULES) -> list[str]:
    return sorted(set().union(*(g for r in rules for g in trigram_query(r.pattern))))


def key_of(text: Column) -> Column:
    return F.xxhash64(text)


def build_index(docs: DataFrame, grams: list[str]) -> DataFrame:
    """Stored postings (gram, key) of the trigrams ``grams`` in ``docs``' texts, sorted by trigram in each file."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    low = docs.select(key_of(text).alias("key"), F.lower(text).alias("low"))
    found = F.filter(F.array(*map(F.lit, grams)).cast("array<string>"), lambda g: F.contains(F.col("low"), g))
    return materialise(low.select("key", F.explode(found).alias("gram")).sortWithinPartitions("gram", "key"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, kinds): for each text the rules with a query that its postings meet; rules that scan all texts are left out."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) != ANY}
    grams = sorted(set().union(*(g for q in queries.values() for g in q)))
    if not grams:
        return index.select("key", F.array().cast("array<string>").alias("kinds")).limit(0)
    bit = {g: (i // 62, 1 << i % 62) for i, g in enumerate(grams)}
    words = range(1 + (len(grams) - 1) // 62)
    masks = [F.create_map(*(F.lit(x) for g, (w, b) in bit.items() if w == word for x in (g, b))) for word in words]
    held = index.where(F.col("gram").isin(grams)).groupBy("key").agg(*(F.bit_or(F.coalesce(masks[w][F.col("gram")], F.lit(0))).alias(f"m{w}") for w in words))

    def meets(query: Query) -> Column:
        def conjunction(grams: frozenset[str]) -> Column:
            need = [sum(bit[g][1] for g in grams if bit[g][0] == w) for w in words]
            return reduce(lambda a, b: a & b, (F.col(f"m{w}").bitwiseAND(F.lit(n)) == n for w, n in enumerate(need) if n))

        return reduce(lambda a, b: a | b, map(conjunction, sorted(query, key=sorted)))

    kinds = F.filter(F.array(*(F.when(meets(q), k) for k, q in queries.items())), lambda k: k.isNotNull())
    return held.select("key", kinds.alias("kinds")).where(F.size("kinds") > 0)


def matches(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, ord, end, kind, value) of the leftmost non-overlapping matches that are long enough.

    Starts are sums of the lengths before, taken in blocks, so that a text with very many matches does not cost their square."""
    pattern = rule.exact or rule.pattern
    outside, inside = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.slice(outside, 1, F.size(inside)).alias("o"), inside.alias("m"))
    size = 256
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(inside) - 1) / size).cast("int")), lambda b: F.slice(pairs, b * size + 1, size))
    lengths = lambda block: F.aggregate(block, F.lit(0), lambda n, x: n + F.length(x["o"]) + F.length(x["m"]))
    empty = F.array().cast(SPAN)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["o"])
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(F.struct(start.alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(rule.kind).alias("kind"), x["m"].alias("value")))).alias("spans"))

    begin = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")), lambda acc, b: F.struct((acc["at"] + lengths(b)).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")), lambda acc: acc["all"])
    found = F.flatten(F.zip_with(blocks, begin, lambda b, at: F.aggregate(b, F.struct(at.alias("at"), empty.alias("spans")), step, lambda acc: acc["spans"])))
    if not rule.exact and rule.least > 1:
        found = F.filter(found, lambda s: F.length(F.regexp_extract(s["value"], rule.pattern, rule.group)) >= rule.least)
    return F.when(text.rlike(pattern), found).otherwise(empty)


def add_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE, names: tuple[str, str] = ("base", "spans"), index: DataFrame | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` with two last columns, by default ``base`` and ``spans``: arrays of (start, ord, end, kind, value), by start,
    then in the order of ``rules``. ``index`` may be one that ``build_index`` made of these texts before, for these rules' ``vocabulary``."""
    own = index if index is not None else build_index(docs, vocabulary(rules))
    wanted = materialise(candidates(own, rules))
    if index is None:
        discard(own)
    first, last = (free_name(n, docs.columns) for n in names)
    key, kinds = free_name("key", [*docs.columns, first, last]), free_name("kinds", [*docs.columns, first, last])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    some = wanted.select(F.col("key").alias(key), F.col("kinds").alias(kinds))
    few = some.limit(broadcast_rows + 1).count() <= broadcast_rows
    marked = docs.withColumn(key, key_of(text)).join(F.broadcast(some) if few else some, key, "left")
    order = {r.kind: i for i, r in enumerate(rules)}

    def spans(rule: Rule) -> Column:
        found = matches(text, rule, order[rule.kind])
        if trigram_query(rule.pattern) == ANY:
            return found
        return F.when(F.array_contains(kinds, rule.kind), found).otherwise(F.array().cast(SPAN))

    out = marked.withColumn(first, F.array_sort(F.concat(*map(spans, base))))
    more = [spans(r) for r in rules if r not in base]
    added = F.concat(*more) if more else F.array().cast(SPAN)
    fresh = F.filter(added, lambda c: ~F.exists(F.col(first), lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return out.withColumn(last, F.array_sort(F.concat(F.col(first), fresh))).drop(key, kinds)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = add_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *(number(r.kind) for r in BASE), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
