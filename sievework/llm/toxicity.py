"""Operator 4: toxic passages by maximum-scoring segments of token log-odds.

Tokens are runs of ASCII letters, digits and bytes of other scripts, lower-cased. A token has as features
itself and its beginnings of ``STEMS`` bytes, hashed into ``2**BITS``. Their log-odds between toxic and clean
labelled documents use an informative Dirichlet prior (the frequencies of all labelled documents); a document
counts a feature once, a text counts once for each class, and features whose z-score is small count as neutral. A token scores as its most telling feature does, and every token
costs a small drift, so that random text scores negative. A linear-time scan finds all maximal-scoring
segments of a document. A segment's significance follows from extreme-value theory: lambda solves
sum p*exp(lambda*s) = 1 over the clean token scores (with the prior, so that words which no clean document
has don't lack a chance), and S counts as lambda*S - ln(K*m) in a document
of m tokens; K is read off the tail of clean documents. Documents add up their significant segments; a logistic curve maps that to a
probability. K and the curve come from documents that had no part in the odds they are scored with (two folds).

Labels are a bounded sample: about ``max_labels`` labelled rows, those below a bound of a hash of the id, so their ids can
be sent to all tasks. The model has a fixed size. All documents are scored, over their whole texts.

Defined results: null or empty text scores as a document without any evidence; labels that are null are left
out and of several for one id the highest holds; without labelled texts of both classes nothing can be told and
every score is near 0; of one text with several labels the highest holds; repeated rows give repeated rows; a null doc_id is not held
out; an empty table gives no rows; a text of any length is scored whole, in one task; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import staged, texts
from sievework.llm.kernels import LOWER, byte_values, prefix, slices, span_hashes, utf8

BITS = 20
STEMS = (4, 5, 6)
DRIFT = 0.5
MIN_Z = 3.5
#: Evidence beyond this says nothing more.
MOST = 20.0
PRIOR_TOKENS = 10_000.0
FOLDS = 5
#: K is read off where this share of the clean documents lies below, between bounds for samples that have no such tail.
TAIL, LOG_K = 0.95, (-7.0, 3.0)

#: Bytes that are part of a token.
_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Features (of the token, and of its beginnings), start and end of each token of a slice, and the number of tokens before each row."""
    inside = _TOKEN[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    full = off[:-1] < off[1:]
    start[off[:-1][full]] = inside[off[:-1][full]]
    end[off[1:][full] - 1] = inside[off[1:][full] - 1]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    sums = prefix(byte_values(LOWER[data]))
    hashes = [span_hashes(sums, start, end), *(span_hashes(sums, start, np.minimum(start + k, end)) + np.uint64(k) for k in STEMS)]
    return [(h >> np.uint64(64 - BITS)).astype(np.int64) for h in hashes], start, end, np.searchsorted(start, off)


def token_scores(weights: np.ndarray, features: list[np.ndarray]) -> np.ndarray:
    """The weight that is furthest from 0 among a token's features, less the drift."""
    out = weights[features[0]]
    for f in features[1:]:
        other = weights[f]
        out = np.where(np.abs(other) > np.abs(out), other, out)
    return out - np.float32(DRIFT)


@dataclass(frozen=True)
class Model:
    weights: bytes  # of each feature, float32
    rate: float  # lambda
    log_k: float
    intercept: float
    slope: float

    def scores(self) -> np.ndarray:
        return np.frombuffer(self.weights, np.float32)


def best_segments(scores: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The highest sum of neighbouring scores in each row, 0 at least, in one pass over all rows."""
    out = np.zeros(len(before) - 1)
    full = np.flatnonzero(np.diff(before))
    if not len(full):
        return out
    sums = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    row = np.repeat(np.arange(len(out)), np.diff(before))
    apart = (np.abs(scores).sum(dtype=np.float64) + 1) * row  # so that no minimum reaches into a later row
    low = np.minimum.accumulate(sums[:-1] - apart) + apart
    out[full] = np.maximum.reduceat(sums[1:] - low, before[:-1][full])
    return np.maximum(out, 0)


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) in linear time; each positive run enters a stack once."""
    sums = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    up = np.flatnonzero(scores > 0)
    if not len(up):
        return []
    cut = np.flatnonzero(np.diff(up) > 1)
    stack: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum after
    lower: list[int] = []  # for each entry, the last one before it that began lower
    for a, b in zip(up[np.concatenate([[0], cut + 1])], up[np.append(cut, len(up) - 1)] + 1, strict=True):
        a, left, right = int(a), float(sums[a]), float(sums[b])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = lower[j]
            if j < 0 or stack[j][3] >= right:
                stack.append((a, int(b), left, right))
                lower.append(j)
                break
            a, left = stack[j][0], stack[j][2]
            del stack[j:], lower[j:]
    return [(a, b, right - left) for a, b, left, right in stack]


def evidence(scores: np.ndarray, before: np.ndarray, rate: float, log_k: float) -> np.ndarray:
    """The normalised score of each row: the sum over its significant segments, or else that of its best."""
    m = np.maximum(np.diff(before), 1)
    norm = log_k + np.log(m)
    out = rate * best_segments(scores, before) - norm
    for i in np.flatnonzero(out > 0):
        found = rate * np.array([s for _, _, s in maximal_segments(scores[before[i] : before[i + 1]])]) - norm[i]
        out[i] = found[found > 0].sum()
    return out


def _labelled(docs: DataFrame, labels: DataFrame, max_labels: int, training_only: bool) -> DataFrame:
    """Distinct labelled texts with their class and fold; about ``max_labels`` ids, those below a bound of a hash."""
    kept = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    if training_only:
        kept = kept.where(~held_out())
    n = kept.count()
    if n > max_labels:
        kept = kept.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) < F.lit((max_labels << 31) // n))
    found = docs.join(F.broadcast(kept), "doc_id")  # about max_labels rows of 16 bytes
    return found.where(F.length("text") > 0).groupBy("text").agg(F.max("toxic").alias("toxic")).withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int"))


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))


@dataclass(frozen=True)
class _Odds:
    """Weights of the features and lambda, from the documents of some folds."""

    weights: np.ndarray
    rate: float

    @classmethod
    def of(cls, clean: np.ndarray, toxic: np.ndarray) -> _Odds:
        if not clean.sum() or not toxic.sum():
            return cls(np.zeros(1 << BITS, np.float32), 1.0)
        prior = PRIOR_TOKENS * (clean + toxic) / (clean + toxic).sum() + 1e-9
        n1, n0 = toxic.sum() + PRIOR_TOKENS, clean.sum() + PRIOR_TOKENS
        y1, y0 = toxic + prior, clean + prior
        odds = np.log(y1 / (n1 - y1)) - np.log(y0 / (n0 - y0))
        z = odds / np.sqrt(1 / y1 + 1 / y0)
        weights = np.where(np.abs(z) >= MIN_Z, odds, 0.0).astype(np.float32)
        return cls(weights, _rate(weights - DRIFT, y0 / y0.sum()))


def fit(documents: DataFrame, labels: DataFrame, max_labels: int = 20_000, training_only: bool = True) -> Model:
    """Passes over the labelled sample: feature counts by class and fold; then, on documents that had no part in the odds they are scored with, the best segments of clean ones (which give K) and a histogram of the evidence (which gives the logistic curve)."""
    sample = _labelled(texts(documents), labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic"), max_labels, training_only)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((4, 1 << BITS), np.int64)
        for b in batches:
            data, off = utf8(b["text"])
            group = 2 * b["fold"].to_numpy() + (b["toxic"].to_numpy() > 0)
            for i, j in slices(off):
                features, _, _, before = tokens(data[off[i] : off[j]], off[i : j + 1] - off[i])
                row = np.repeat(np.arange(i, j), np.diff(before))
                once = np.unique(np.concatenate([row << BITS | f for f in features])) if len(row) else np.zeros(0, np.int64)
                of = group[once >> BITS]
                for k in range(4):
                    found[k] += np.bincount(once[of == k] & ((1 << BITS) - 1), minlength=1 << BITS)
        used = np.flatnonzero(found.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(x[used]) for x in found)], names=["feature", "g0", "g1", "g2", "g3"])

    # 2**BITS rows at most, whatever the input.
    sample = staged(sample)
    rows = sample.mapInArrow(counts, "feature long, g0 long, g1 long, g2 long, g3 long").groupBy("feature").agg(*(F.sum(f"g{k}").alias(f"g{k}") for k in range(4))).toArrow()
    found = np.zeros((4, 1 << BITS))
    for k in range(4):
        found[k, rows["feature"].to_numpy()] = rows[f"g{k}"].to_numpy()
    whole = _Odds.of(found[0] + found[2], found[1] + found[3])
    if not (found[0] + found[2]).sum() or not (found[1] + found[3]).sum():
        return Model(whole.weights.tobytes(), 1.0, 0.0, -30.0, 0.0)
    others = [_Odds.of(found[2], found[3]), _Odds.of(found[0], found[1])]  # for the documents of fold 0 and of fold 1

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fold = b["fold"].to_numpy()
            x = np.zeros(b.num_rows)
            for f, odds in enumerate(others):
                own = np.flatnonzero(fold == f)
                x[own] = _by_slices(b["text"].take(pa.array(own)), odds.weights, lambda s, m, odds=odds: odds.rate * best_segments(s, m) - np.log(np.maximum(np.diff(m), 1)))
            yield pa.RecordBatch.from_arrays([pa.array(np.rint(10 * np.clip(x, -MOST, MOST)).astype(np.int64))], names=["bin"])

    # 401 bins at most, as below.
    clean = sample.where("toxic <= 0").mapInArrow(best, "bin long").groupBy("bin").count().orderBy("bin").toArrow()
    log_k = _log_k(clean["bin"].to_numpy() / 10, clean["count"].to_numpy())

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fold = b["fold"].to_numpy()
            x = np.zeros(b.num_rows)
            for f, odds in enumerate(others):
                own = np.flatnonzero(fold == f)
                x[own] = _evidence(b["text"].take(pa.array(own)), odds.weights, odds.rate, log_k)
            yield pa.RecordBatch.from_arrays([pa.array(np.rint(10 * x).astype(np.int64)), b["toxic"]], names=["bin", "toxic"])

    table = sample.mapInArrow(bins, "bin long, toxic int").groupBy("bin").agg(F.count("*").alias("n"), F.sum((F.col("toxic") > 0).cast("long")).alias("toxic")).orderBy("bin").toArrow()
    intercept, slope = _logistic(table["bin"].to_numpy() / 10, table["toxic"].to_numpy(), table["n"].to_numpy())
    return Model(whole.weights.tobytes(), whole.rate, log_k, intercept, slope)


def _log_k(x: np.ndarray, n: np.ndarray) -> float:
    """ln K from the upper tail of lambda*S - ln(m) over clean documents: P(above x) = 1 - exp(-K*exp(-x)) at its ``TAIL`` quantile."""
    if not len(x):
        return 0.0
    at = x[np.searchsorted(np.cumsum(n), TAIL * n.sum())]
    return float(np.clip(at + np.log(-np.log(TAIL)), *LOG_K))


def _rate(weights: np.ndarray, p: np.ndarray) -> float:
    """lambda with sum p*exp(lambda*s) = 1."""
    used = p > 0
    s, p = weights[used].astype(np.float64), p[used]
    if s.max() <= 0:
        return 1.0
    low, high = 1e-6, 1.0
    while (p * np.exp(np.minimum(high * s, 700))).sum() < 1 and high < 1e3:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(np.minimum(mid * s, 700))).sum() < 1 else (low, mid)
    return low


def _logistic(x: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Newton's method with a small ridge; the slope is not negative."""
    w = np.zeros(2)
    design = np.stack([np.ones(len(x)), x], 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (toxic - n * p) - 1e-3 * w
        step = np.linalg.solve((design * (n * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2), gradient)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(max(w[1], 0.0))


def _by_slices(column: pa.Array, weights: np.ndarray, f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """f of the token scores, and the tokens before each row, of every row."""
    data, off = utf8(column)
    out = np.zeros(len(off) - 1)
    for i, j in slices(off):
        features, _, _, before = tokens(data[off[i] : off[j]], off[i : j + 1] - off[i])
        out[i:j] = f(token_scores(weights, features), before)
    return out


def _evidence(column: pa.Array, weights: np.ndarray, rate: float, log_k: float) -> np.ndarray:
    return np.clip(_by_slices(column, weights, lambda s, m: evidence(s, m, rate, log_k)), -MOST, MOST)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.scores()
        for b in batches:
            x = model.intercept + model.slope * _evidence(b["text"], weights, model.rate, model.log_k)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(1 / (1 + np.exp(-np.clip(x, -30, 30))))], names=["doc_id", "score"])

    return texts(docs, id_col, text_col).mapInArrow(rows, "doc_id long, score double")


def passages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, end (bytes), the segment's score and its normalised score, for every significant passage."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.scores()
        for b in batches:
            data, off = utf8(b["text"])
            out = []
            for i, j in slices(off):
                features, start, end, before = tokens(data[off[i] : off[j]], off[i : j + 1] - off[i])
                scores = token_scores(weights, features)
                best = model.rate * best_segments(scores, before) - model.log_k - np.log(np.maximum(np.diff(before), 1))
                for k in np.flatnonzero(best > 0):
                    at, m = before[k], before[k + 1] - before[k]
                    for s, e, total in maximal_segments(scores[at : before[k + 1]]):
                        if (x := model.rate * total - model.log_k - np.log(m)) > 0:
                            first = off[i + k] - off[i]
                            out.append((b["doc_id"][i + k].as_py(), int(start[at + s] - first), int(end[at + e - 1] - first), total, float(x)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names=["doc_id", "start", "end", "segment_score", "normalised"])

    return texts(docs, id_col, text_col).mapInArrow(rows, "doc_id long, start long, end long, segment_score double, normalised double")


def flagged(docs: DataFrame, model: Model, text_col: str = "text") -> F.Column:
    """A column for ``docs``: whether the row's text scores 0.5 or more."""

    def rows(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights = model.scores()
        for c in column:
            x = model.intercept + model.slope * _evidence(c, weights, model.rate, model.log_k)
            yield pa.array(x >= 0)

    return F.arrow_udf(rows, "boolean")(F.col(text_col))


def predictions(documents: DataFrame, labels: DataFrame) -> DataFrame:
    out = scored(documents, fit(documents, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
