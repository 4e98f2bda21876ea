"""Quality classifier by positive-unlabelled learning (operator 7).

Trusted positives are documents labelled good outside the held-out fold; unlabelled ones are any
documents outside it, whatever their label. A linear model minimises the non-negative unbiased
risk pi R+(P) + max(0, R-(U) - pi R-(P)) with logistic loss; the class prior pi is estimated from
how many of all unlabelled rows score like positives, by models that have not seen them. At most
``sample`` labelled positives, those of least hash, are learnt from. R-(U) is over all unlabelled rows:
as many of them are fetched to give it its curve, and ``rounds`` times its value and slope over all rows,
one sum a coordinate, take the place of theirs at the weights found so far; the weights of least risk over all rows stay. Every row also counts for the
prior, and every row is scored. Sums are of whole numbers, so that they don't depend on how rows are dealt.

Features come from the text alone: shares of byte classes and hashed byte pairs, word and line
repetition, mean lengths.

Edge cases: null and empty texts are scored like an empty text; very long texts are described whole,
one at a time; null labels and null ids are no positives; with no positives at all every row gets
``prior_without_labels``; of an id that repeats with several texts, the one of least hash is learnt from;
ties of hashes go by id; repeated rows score alike; an empty table gives an empty result; other columns
are kept by ``add_score``, whose column ``name`` takes the place of one so called.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentmill.llm._common import release, text_or_empty, tidy, trim

N_PAIRS, N_TALL = 256, 14
N_THRESHOLDS = 30
N_FEATURES = 128 + N_PAIRS + N_TALL


def describe(text: str | None) -> np.ndarray:
    """Feature vector of a whole text."""
    text = text or ""
    raw = np.frombuffer(text.encode(), np.uint8)
    out = np.zeros(N_FEATURES, np.float32)
    if not len(raw):
        return out
    n = len(raw)
    single = np.bincount(raw, minlength=256)
    out[:128] = np.sqrt(single[:128] / n)
    pairs = (raw[:-1].astype(np.uint32) * 2654435 + raw[1:] * np.uint32(40503)) >> 7
    out[128 : 128 + N_PAIRS] = np.sqrt(np.bincount(pairs & (N_PAIRS - 1), minlength=N_PAIRS) / n)
    words, lines = text.split(), text.split("\n")
    n_words, n_lines = max(1, len(words)), len(lines)
    upper, lower, digit = single[65:91].sum(), single[97:123].sum(), single[48:58].sum()
    letters = max(1, upper + lower + single[128:].sum())
    marks = single[33:48].sum() + single[58:65].sum() + single[91:97].sum() + single[123:127].sum()
    out[128 + N_PAIRS :] = (
        np.log1p(n) / 10, np.log1p(n_words) / 10, len(set(words)) / n_words, len(set(lines)) / n_lines, n / n_words / 10, upper / letters, digit / n, marks / n,
        single[128:].sum() / n, single[10] / n, single[32] / n, marks / n_words, np.log1p(n_lines) / 5, np.log1p(n_words / n_lines) / 5,
    )
    return out


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return 1 / (1 + np.exp(-np.clip(z @ self.weights[:-1] + self.weights[-1], -30, 30)))


def _descend(x: np.ndarray, gradient, steps: int, rate: float, decay: float) -> np.ndarray:
    """Adam from zero; gradient(w) gives the slope without the decay."""
    w, m, v = (np.zeros(x.shape[1]) for _ in range(3))
    for t in range(1, steps + 1):
        g = gradient(w) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass(frozen=True)
class Tail:
    """A model fitted to one half of the sample, and what the positives of the other half score: thresholds and shares of them at or above each."""

    weights: np.ndarray
    thresholds: np.ndarray
    shares: np.ndarray

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Number of thresholds that each row reaches."""
        return np.searchsorted(self.thresholds, x @ self.weights, side="right")

    def least_ratio(self, counts: np.ndarray) -> float:
        """Least ratio of the two tails; ``counts``: unlabelled rows by the number of thresholds reached."""
        reached = np.cumsum(counts[::-1])[::-1][1:]
        return float((reached / max(1, counts.sum()) / self.shares).min())


def half_models(p: np.ndarray, u: np.ndarray) -> list[Tail]:
    """For each half of positives and unlabelled rows (standardised), a model and its tail; none if a half is empty."""
    out = []
    for k in (0, 1):
        fit_p, fit_u, own_p = p[k::2], u[k::2], p[1 - k :: 2]
        if not min(map(len, (fit_p, fit_u, own_p))):
            return []
        x, y = np.vstack([fit_p, fit_u]), np.repeat([1.0, 0.0], [len(fit_p), len(fit_u)])
        share = np.where(y == 1, 0.5 / len(fit_p), 0.5 / len(fit_u))
        w = _descend(x, lambda w, x=x, y=y, share=share: x.T @ (share * (_sigmoid(x @ w) - y)), 150, 0.02, 1e-3)
        scores = own_p @ w
        thresholds = np.quantile(scores, np.linspace(0.02, 0.6, N_THRESHOLDS))
        out.append(Tail(w, thresholds, np.array([np.mean(scores >= t) for t in thresholds])))
    return out


def estimate_prior(tails: list[Tail], counts: list[np.ndarray]) -> float:
    """Share of positives among all unlabelled rows: mean over the halves of the least ratio of tails."""
    return float(np.clip(np.mean([t.least_ratio(c) for t, c in zip(tails, counts, strict=True)]), 0.05, 0.98)) if tails else 0.5


@dataclass(frozen=True)
class Whole:
    """Risk of all unlabelled rows as negatives, and its slope, at some weights."""

    at: np.ndarray
    value: float
    slope: np.ndarray


def negative_risk(u: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean logistic loss of rows taken as negatives, and its slope."""
    s = _sigmoid(u @ w)
    return float(-np.log1p(-np.minimum(s, 1 - 1e-9)).mean()), u.T @ s / len(u)


def fit(p: np.ndarray, u: np.ndarray, prior: float, whole: Whole | None = None, steps: int = 400, rate: float = 0.02, decay: float = 1e-4) -> np.ndarray:
    """Weights of the non-negative risk estimator on positives p and unlabelled rows (standardised). The latter's risk is
    that of u, moved and tilted so that it has the value and slope of ``whole`` at its weights."""
    shift, tilt = 0.0, np.zeros(u.shape[1])
    if whole:
        value, slope = negative_risk(u, whole.at)
        tilt = whole.slope - slope
        shift = whole.value - value - tilt @ whole.at

    def gradient(w: np.ndarray) -> np.ndarray:
        value, slope = negative_risk(u, w)
        own, down = negative_risk(p, w)
        rest, down = value + shift + tilt @ w - prior * own, slope + tilt - prior * down
        up = -prior * (p.T @ (1 - _sigmoid(p @ w))) / len(p)
        return up + down if rest >= 0 else -down  # step back where the negative risk has become negative

    return _descend(p, gradient, steps, rate, decay)


def refine(p: np.ndarray, u: np.ndarray, prior: float, whole: Callable[[np.ndarray], Whole | None], rounds: int) -> np.ndarray:
    """Weights fitted to u, then ``rounds`` times with what ``whole`` says of all unlabelled rows; those whose risk over all rows is least."""
    weights, best = fit(p, u, prior), None
    for at in range(rounds + 1 if rounds else 0):
        found = whole(weights)
        if found is None:
            break
        risk = prior * float(-np.log(np.maximum(_sigmoid(p @ weights), 1e-9)).mean()) + max(0.0, found.value - prior * negative_risk(p, weights)[0])
        if best is None or risk < best[0]:
            best = risk, weights
        if at < rounds:
            weights = fit(p, u, prior, found)
    return best[1] if best else weights


def standardised(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.hstack([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))])


def count_bins(docs: DataFrame, seen: dict[int, int], tails: list[Tail], mean: np.ndarray, scale: np.ndarray) -> list[np.ndarray]:
    """For each half model, how many of ``docs`` reach how many of its thresholds. Rows that it was fitted to (``seen``: id -> half) don't count."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((tails, mean, scale))
    known = F.broadcast(spark.createDataFrame([*seen.items()], "doc_id long, half int"))  # of bounded size

    @F.arrow_udf("array<int>")
    def bins(texts: pa.Array, halves: pa.Array) -> pa.Array:
        own, mean, scale = shared.value
        parts = [np.zeros((0, len(own)), np.int64)]
        for at in range(0, len(texts), 1024):
            x = standardised(np.array([describe(t.as_py()) for t in texts.slice(at, 1024)], np.float64), mean, scale)
            parts.append(np.stack([t.bins(x) for t in own], 1))
        found = np.concatenate(parts)
        half = halves.fill_null(-1).to_numpy(zero_copy_only=False)
        found[np.flatnonzero(half >= 0), half[half >= 0]] = -1
        return pa.array(found.tolist(), pa.list_(pa.int32()))

    rows = docs.join(known, "doc_id", "left").select(F.posexplode(bins("text", "half")).alias("k", "bin")).where("bin >= 0")
    out = [np.zeros(N_THRESHOLDS + 1, np.int64) for _ in tails]
    for r in rows.groupBy("k", "bin").count().collect():  # at most two rows a threshold and model
        out[r.k][r.bin] = r["count"]
    return out


def whole_risk(docs: DataFrame, w: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> Whole | None:
    """``negative_risk`` of all ``docs`` at w; None without rows. A task gives one row a coordinate."""
    shared, unit = docs.sparkSession.sparkContext.broadcast((w, mean, scale)), 1 << 16

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, mean, scale = shared.value
        total = np.zeros(len(w) + 2, np.int64)  # slope, value and rows, in parts of 1 / unit
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                x = standardised(np.array([describe(t.as_py()) for t in b.column(0).slice(at, 1024)], np.float64), mean, scale)
                s = _sigmoid(x @ w)
                total[: len(w)] += np.rint(unit * x * s[:, None]).astype(np.int64).sum(0)
                total[len(w)] += np.rint(-unit * np.log1p(-np.minimum(s, 1 - 1e-9))).astype(np.int64).sum()
                total[len(w) + 1] += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["k", "part"])

    sums = {r.k: int(r.total) for r in docs.select("text").mapInArrow(tidy(partial), "k int, part long").groupBy("k").agg(F.sum("part").alias("total")).collect()}
    n = sums.get(len(w) + 1, 0)
    return Whole(w, sums[len(w)] / unit / n, np.array([sums[k] for k in range(len(w))]) / unit / n) if n else None


def fold(name: str = "doc_id", folds: int = 5):
    return F.pmod(F.crc32(F.col(name).cast("string").cast("binary")), F.lit(folds))


def train(docs: DataFrame, labels: DataFrame, sample: int = 6000, folds: int = 5, rounds: int = 2) -> Model | None:
    """Model from rows outside fold 0; None without positives. ``sample`` bounds the labelled rows learnt from, and the
    unlabelled ones that are fetched; the others count by ``rounds`` + 1 passes over all."""
    known = F.col("doc_id").isNotNull() & (fold(folds=folds) != 0)
    least = lambda df: df.select(F.col("doc_id").cast("long").alias("doc_id")).where(known).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    positive = least(labels.where("quality = 1")).withColumn("trusted", F.lit(True))
    ids = [*positive.collect(), *least(docs).withColumn("trusted", F.lit(False)).collect()]  # at most 2 * sample ids
    wanted = F.broadcast(docs.sparkSession.createDataFrame(ids, "doc_id long, trusted boolean"))

    @F.arrow_udf("binary")
    def features(texts: pa.Array) -> pa.Array:
        return pa.array([describe(t.as_py()).tobytes() for t in texts], pa.binary())

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(wanted, "doc_id").select("doc_id", "trusted", features("text").alias("x"), F.xxhash64("text").alias("h"))
    rows = found.groupBy("doc_id", "trusted").agg(F.min_by("x", "h").alias("x")).collect()  # one row an id, however often it repeats
    rows.sort(key=lambda r: r.doc_id)
    rows.sort(key=lambda r: not r.trusted)  # the trusted ones first
    n_trusted = sum(r.trusted for r in rows)
    if n_trusted in (0, len(rows)):
        return None
    seen = {r.doc_id: i % 2 for i, r in enumerate(rows[n_trusted:])}
    both = np.frombuffer(b"".join(r.x for r in rows), np.float32).reshape(-1, N_FEATURES).astype(np.float64)
    del rows  # the driver holds little more than one form of them at a time
    mean, scale = both.mean(0), both.std(0) + 1e-3
    p, u = (standardised(x, mean, scale) for x in (both[:n_trusted], both[n_trusted:]))
    del both
    tails = half_models(p, u)
    trim()
    others = docs.where(known).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    prior = estimate_prior(tails, count_bins(others, seen, tails, mean, scale) if tails else [])
    weights = refine(p, u, prior, lambda w: whole_risk(others, w, mean, scale), rounds)
    del p, u
    trim()
    return Model(mean, scale, weights, prior)


def add_score(docs: DataFrame, model: Model | None, name: str = "score", prior_without_labels: float = 0.5) -> DataFrame:
    """``docs`` and the score of each text."""
    if model is None:
        return docs.withColumn(name, F.lit(prior_without_labels))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        release()
        parts = [shared.value.score(np.array([describe(t.as_py()) for t in texts.slice(at, 1024)], np.float64)) for at in range(0, len(texts), 1024)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return docs.withColumn(name, score(text_or_empty()))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = 6000) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = add_score(own, train(docs, labels, sample))
    return scored.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
