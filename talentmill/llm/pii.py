"""Personal data by weak supervision (operator 6), DataFrame functions only.

Base kinds (email, ip, card, phone) are found by fixed patterns and always stay. Further
candidates (spelled-out mail addresses, phones without country code, account numbers, secrets)
are judged by labelers that vote yes, no or abstain: a strict pattern, a gazetteer of known
endings, prefixes and codes, the words before the span, and its share of digits. Votes are
aggregated into counts per pattern of votes (at most 3 ** 4 * 4 rows a kind). Expectation
maximisation over those counts estimates each labeler's reliability, and its posteriors train
the span classifier, a logistic model over votes and shape, whose weights enter the plan as
constants. Texts are read twice and never moved.

Positions are code points, ends exclusive: the text is split at the pattern's matches, and
lengths of pieces and matches are added up.

Edge cases: a null or empty text has no spans (``base_sha256`` of the empty string); very long texts
are searched whole, by patterns that do not backtrack; spans of different kinds may overlap, and of
those that start together the kind listed first comes first; repeated rows are judged alike; null ids
are kept; an empty table gives an empty result; other columns are kept by ``add_spans`` and
``redact``, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentmill.llm._common import free_name

_LOCAL = "[A-Za-z0-9._%+-]"
#: Same matches as the contract's patterns; possessive, so that long runs need no backtracking.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[ -]?[0-9]){11,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
#: Candidates that labelers judge.
WIDER = {
    "email": r"(?<![A-Za-z0-9._+-])[A-Za-z0-9._+-]{2,}+ ?(?:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]{2,63} ?(?:\[dot\]|\(dot\)| dot ) ?[A-Za-z]{2,10}",
    "phone": r"(?<![0-9+.-])\(?[0-9]{2,4}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?:[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20,}+",
}
_WIDER_NEEDS = {"email": r"\bdot\b", "phone": r"[0-9][ .-][0-9]{3}[ .-][0-9]{4}", "account": r"[A-Z]{2}[0-9]{2}", "secret": r"[A-Za-z0-9_/+-]{20}"}
_STRICT = {"email": r"(?i)^[a-z0-9._+-]+ ?(\[at\]|\(at\)) ?[a-z0-9-]+ ?(\[dot\]|\(dot\)) ?[a-z]{2,10}$", "phone": r"^\(?[2-9][0-9]{2}\)?[ .-][2-9][0-9]{2}[ .-][0-9]{4}$", "account": r"^[A-Z]{2}[0-9]{2}( ?[0-9]{4}){3,}", "secret": r"^([0-9a-f]{32,}|[A-Za-z0-9_/+-]*[0-9][A-Za-z0-9_/+-]*[A-Z][A-Za-z0-9_/+-]*)$"}
_GAZETTEER = {"email": r"(?i)(com|org|net|edu|de|fr|es|io)$", "phone": r"^\(?(2|3|4|5|6|7|8|9)[0-9]{2}\)?", "account": r"^(DE|FR|ES|GB|IT|NL|BE|AT|CH|PL|PT|IE)", "secret": r"^(AKIA|ASIA|ghp_|gho_|sk-|xox|eyJ)|^[0-9a-f]{40}$|^[0-9a-f]{32}$|^[0-9a-f]{64}$"}
_CONTEXT = {"email": r"(?i)(mail|contact|write|reach)", "phone": r"(?i)(tel|phone|call|fax|mobile|whatsapp)", "account": r"(?i)(iban|account|bank|konto|cuenta|compte)", "secret": r"(?i)(token|secret|key|password|passwd|api|bearer)"}
_AGAINST = r"(?i)(sha256|md5|hash|digest|commit|isbn|version|figure|page|/)\W*$"
ORDER = [*BASE, *(k for k in WIDER if k not in BASE)]
VOTES = ("strict", "gazetteer", "context", "digits")
SPAN = "array<struct<start:int,ord:int,end:int,kind:string,value:string>>"


def matches(text: Column, kind: str, pattern: str, needs: str, context: int = 0) -> Column:
    """Array of (start, ord, end, kind, value[, before]) of the leftmost non-overlapping matches."""
    outside, inside = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.slice(outside, 1, F.size(inside)).alias("o"), inside.alias("m"))
    empty = F.array().cast(SPAN.replace("value:string", "value:string,before:string") if context else SPAN)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["o"])
        end = start + F.length(x["m"])
        fields = [start.alias("start"), F.lit(ORDER.index(kind)).alias("ord"), end.alias("end"), F.lit(kind).alias("kind"), x["m"].alias("value")]
        if context:
            fields.append(F.right(x["o"], F.lit(context)).alias("before"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(F.struct(*fields))).alias("spans"))

    found = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step, lambda acc: acc["spans"])
    return F.when(text.rlike(needs), found).otherwise(empty)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        d = F.ascii(F.substring(digits, F.length(digits) - i + 1, F.lit(1))) - 48
        twice = d * 2
        return acc + F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> Column:
    """Base spans by start, then kind as listed."""
    found = {k: matches(text, k, p, _NEEDS[k]) for k, p in BASE.items()}
    small = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"
    found["ip"] = F.filter(found["ip"], lambda s: F.forall(F.split(s["value"], r"\."), lambda p: p.rlike(small)))
    found["card"] = F.filter(found["card"], lambda s: F.when(F.length(digits_of(s["value"])) <= 19, luhn(digits_of(s["value"]))).otherwise(False))
    found["phone"] = F.filter(found["phone"], lambda s: F.length(digits_of(s["value"])).between(9, 15))
    return F.array_sort(F.concat(*found.values()))


def candidates(text: Column, context: int = 32) -> Column:
    return F.array_sort(F.concat(*(matches(text, k, p, _WIDER_NEEDS[k], context) for k, p in WIDER.items())))


def votes(c: Column) -> list[Column]:
    """Labelers' votes on a candidate: 1 yes, -1 no, 0 none."""

    def by_kind(patterns: dict[str, str], value: Column) -> Column:
        return reduce(lambda rest, k: F.when(c["kind"] == k, value.rlike(patterns[k])).otherwise(rest), patterns, F.lit(False))

    share = F.length(digits_of(c["value"])) / F.greatest(F.length(c["value"]), F.lit(1))
    return [
        F.when(by_kind(_STRICT, c["value"]), 1).otherwise(-1),
        F.when(by_kind(_GAZETTEER, c["value"]), 1).otherwise(0),
        F.when(by_kind(_CONTEXT, c["before"]), 1).when(c["before"].rlike(_AGAINST), -1).otherwise(0),
        F.when(c["kind"] == "email", F.when(share > 0.5, -1).otherwise(0)).when(c["kind"] == "secret", F.when(share.between(0.15, 0.9), 1).otherwise(-1)).otherwise(F.when(share >= 0.5, 1).otherwise(-1)),
    ]


def shape(c: Column) -> Column:
    """0 to 3: whether the span is short or long, and has separators."""
    return F.when(F.length(c["value"]) > 24, 2).otherwise(0) + F.when(c["value"].rlike(r"[ .()\[\]-]"), 1).otherwise(0)


@dataclass(frozen=True)
class Model:
    """Reliabilities and class shares by kind, and the classifier's weights."""

    reliability: dict
    prior: dict
    weights: dict

    def probability(self, c: Column) -> Column:
        values = [v.cast("double") for v in votes(c)]
        out = F.lit(0.0)
        for kind, w in self.weights.items():
            z = reduce(lambda a, b: a + b, (F.lit(x) * v for x, v in zip(w, values, strict=False)), F.lit(w[-1]))
            z = z + F.element_at(F.array(*(F.lit(x) for x in w[len(VOTES) : -1])), shape(c) + 1)
            out = F.when(c["kind"] == kind, 1 / (1 + F.exp(-z))).otherwise(out)
        return out


def expectation_maximisation(counts: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[list[float], float, list[float]]:
    """Reliabilities of labelers, share of true spans, and the posterior of each vote pattern."""
    reliability, prior = [0.8] * len(VOTES), 0.5
    posterior = [0.5] * len(counts)
    total = sum(n for _, n in counts) or 1
    for _ in range(rounds):
        for i, (pattern, _) in enumerate(counts):
            yes, no = math.log(prior), math.log(1 - prior)
            for r, v in zip(reliability, pattern, strict=False):
                if v:
                    yes, no = yes + math.log(r if v > 0 else 1 - r), no + math.log(1 - r if v > 0 else r)
            posterior[i] = 1 / (1 + math.exp(min(60, max(-60, no - yes))))
        prior = min(0.95, max(0.05, (1 + sum(n * p for (_, n), p in zip(counts, posterior, strict=True))) / (2 + total)))
        for j in range(len(VOTES)):
            right = sum(n * (p if pattern[j] > 0 else 1 - p) for (pattern, n), p in zip(counts, posterior, strict=True) if pattern[j])
            voted = sum(n for pattern, n in counts if pattern[j])
            reliability[j] = min(0.98, max(0.55, (right + 4) / (voted + 5)))  # no labeler is taken for worse than chance
    return reliability, prior, posterior


def span_classifier(counts: list[tuple[tuple[int, ...], int]], posterior: list[float], steps: int = 300) -> list[float]:
    """Logistic weights (votes, four shapes, constant) fitted to the posteriors."""
    rows = [([*map(float, p[: len(VOTES)]), *(float(p[-1] == s) for s in range(4)), 1.0], n, y) for (p, n), y in zip(counts, posterior, strict=True)]
    total, w = sum(n for _, n, _ in rows) or 1, [0.0] * (len(VOTES) + 5)
    for _ in range(steps):
        slope = [1e-3 * x for x in w]
        for x, n, y in rows:
            p = 1 / (1 + math.exp(-min(60.0, max(-60.0, sum(a * b for a, b in zip(w, x, strict=True))))))
            slope = [s + n / total * (p - y) * a for s, a in zip(slope, x, strict=True)]
        w = [a - b for a, b in zip(w, slope, strict=True)]
    return w


def train(docs: DataFrame) -> Model:
    """Vote counts over all documents, then EM and the classifier for each kind."""
    each = docs.select(F.explode(candidates(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("c"))
    c = F.col("c")
    keys = [v.alias(name) for v, name in zip(votes(c), VOTES, strict=True)]
    rows = each.select(c["kind"].alias("kind"), *keys, shape(c).alias("shape")).groupBy("kind", *VOTES, "shape").count().orderBy("kind", *VOTES, "shape").collect()  # bounded by the number of patterns
    reliability, prior, weights = {}, {}, {}
    for kind in WIDER:
        counts = [((*(r[v] for v in VOTES), r["shape"]), r["count"]) for r in rows if r["kind"] == kind]
        if counts:
            reliability[kind], prior[kind], posterior = expectation_maximisation(counts)
            weights[kind] = span_classifier(counts, posterior)
    return Model(reliability, prior, weights)


def add_spans(docs: DataFrame, model: Model | None = None, accept_at: float = 0.5, names: tuple[str, str] = ("base", "spans")) -> DataFrame:
    """``docs`` with two last columns, by default ``base`` and ``spans``: arrays of (start, ord, end, kind, value).
    Added spans never overlap base ones. Names that ``docs`` has already get underscores."""
    model = model or train(docs)
    base, spans = (free_name(name, docs.columns) for name in names)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.withColumn(base, base_spans(text))
    wider = F.filter(candidates(text), lambda c: (model.probability(c) >= accept_at) & ~F.exists(F.col(base), lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    more = F.transform(wider, lambda c: F.struct(c["start"].alias("start"), c["ord"].alias("ord"), c["end"].alias("end"), c["kind"].alias("kind"), c["value"].alias("value")))
    return out.withColumn(spans, F.array_sort(F.array_union(base, more)))


def of_kind(kind: str):
    return lambda s: s["kind"] == kind


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    found = add_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    n = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *n, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` with every span replaced by ``<kind>``; overlapping spans give one mark, of the first. Null texts stay null."""
    found = add_spans(docs, model)
    *_, base, spans = found.columns
    text = F.col("text").cast("string")

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        kept = F.struct(acc["at"].alias("at"), s["start"].alias("start"), s["kind"].alias("kind"))
        return F.struct(F.when(fresh, F.concat(acc["out"], F.array(kept))).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    start = F.struct(F.array().cast("array<struct<at:int,start:int,kind:string>>").alias("out"), F.lit(0).alias("at"))

    def mark(acc: Column) -> Column:
        pieces = F.transform(acc["out"], lambda x: F.concat(F.substring(text, x["at"] + 1, x["start"] - x["at"]), F.lit("<"), x["kind"], F.lit(">")))
        return F.concat(F.array_join(pieces, ""), F.substring(text, acc["at"] + 1, F.length(text)))

    return found.withColumn("text", F.when(F.size(spans) > 0, F.aggregate(spans, start, step, mark)).otherwise(text)).drop(base, spans)
