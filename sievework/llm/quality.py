"""Operator 2: quality rules of documents and of the hosts they come from.

Each document is measured once. The failures of each rule are summed by host, a beta prior is fitted to the hosts' rates of
each rule (method of moments), and each host's rate is shrunk towards it. Two verdicts on a host follow and are joined back:

* A host of which the shrunk rate of documents with a base failure is at least ``host_limit`` loses all its documents.
* A host is suspect of a rule if its shrunk rate lies above the mean of the fitted prior by more than its standard deviation. What
  fails a mild rule (``MILD``) may be an accident elsewhere, but goes if its host is suspect of that rule.

Defined results: null or empty text has no words and fails; a null host forms no host, so only its own
rules decide about such a document; without any rows there is no prior and no host; repeated rows count each; a host at a
limit exactly is rejected, at the bound of suspicion it is not; a text of any length is measured whole, in one task; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import staged
from sievework.llm.kernels import SPACE, slices, strings, utf8, word_codes

#: The symbols that count.
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Conditions under which a document fails a rule; the first two are the base.
RULES = {
    "short": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars < 3 * n_words OR word_chars > 10 * n_words",
}
BASE, MILD = ("short", "repeats"), ("symbols", "dup_lines", "word_length")
#: Hosts up to this number (about 10 MB) are sent to all tasks; more are joined by a shuffle.
BROADCAST_HOSTS = 100_000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def _repeats(codes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which elements share code and row with another; those of a row stand together."""
    order = np.argsort(codes, kind="stable")
    same = (codes[order][1:] == codes[order][:-1]) & (rows[order][1:] == rows[order][:-1])
    out = np.zeros(len(codes), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def measured(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """MEASURES of each row of a slice."""
    n = len(off) - 1
    per_row = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[off])
    codes, _, before = word_codes(data, off)
    row = np.repeat(np.arange(n), np.diff(before))
    lead = (data & 0xC0) != 0x80
    out = [np.diff(before), per_row(lead & ~SPACE[data]), per_row(_SYMBOL[data])]

    feed = np.flatnonzero(data == 10)
    bounds = np.unique(np.concatenate([feed, feed + 1, off]))
    dup, lines = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if len(bounds) > 1:
        words = np.concatenate([[0], np.cumsum(~SPACE[data])])
        line = words[bounds[1:]] > words[bounds[:-1]]
        kinds = strings(data, bounds).dictionary_encode().indices.to_numpy()[line].astype(np.int64)
        of = np.searchsorted(off, bounds[:-1][line], "right") - 1
        order = np.argsort(kinds, kind="stable")
        again = (kinds[order][1:] == kinds[order][:-1]) & (of[order][1:] == of[order][:-1])
        dup, lines = np.bincount(of[order][1:][again], minlength=n), np.bincount(of, minlength=n)
    out.append(dup)

    repeated = np.zeros(len(codes), bool)
    if len(codes) > 2:
        whole = row[2:] == row[:-2]
        codes = codes.astype(np.int64)
        pairs = np.unique(codes[:-1] * (codes.max() + 1) + codes[1:], return_inverse=True)[1]
        windows = pairs[:-1] * (codes.max() + 1) + codes[2:]
        hit = np.zeros(len(windows), bool)
        hit[whole] = _repeats(windows[whole], row[2:][whole])
        for k in range(3):
            repeated[k : k + len(hit)] |= hit
    return [*out, np.bincount(row[repeated], minlength=n), lines]


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host and MEASURES of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8(b["text"])
            found = [measured(data[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in slices(off)]
            columns = [pa.array(np.concatenate([x[k] for x in found]).astype(np.int64) if found else np.zeros(0, np.int64)) for k in range(len(MEASURES))]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["host"], *columns], names=["doc_id", "host", *MEASURES])

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return docs.mapInArrow(rows, "doc_id long, host string, " + ", ".join(f"{m} long" for m in MEASURES))


def fails(rule: str) -> F.Column:
    return F.expr(RULES[rule])


def base_failed() -> F.Column:
    return fails("short") | fails("repeats")


def beta_priors(hosts: DataFrame, failures: Sequence[str]) -> dict[str, tuple[float, float]]:
    """For each column of failures the beta prior of the hosts' rates (by their column n), by the method of moments; uniform where they don't vary."""
    rates = {f: F.col(f) / F.col("n") for f in failures}
    row = hosts.agg(F.avg(1 / F.col("n")).alias("inverse"), *(x for f, r in rates.items() for x in (F.avg(r).alias(f"m_{f}"), F.var_pop(r).alias(f"v_{f}")))).first()
    out = {}
    for f in failures:
        m, v = row[f"m_{f}"], row[f"v_{f}"]
        if m is None or not 0 < m < 1:
            out[f] = (1.0, 1.0)
            continue
        v = max(v - m * (1 - m) * row["inverse"], 1e-4 * m * (1 - m))  # without what sampling alone adds
        total = max(m * (1 - m) / v - 1, 1e-3)
        out[f] = (m * total, (1 - m) * total)
    return out


def suspicion(a: float, b: float) -> float:
    """The mean of a beta prior and its standard deviation, added."""
    return a / (a + b) + math.sqrt(a * b / (a + b + 1)) / (a + b)


def host_verdicts(measures: DataFrame, host_limit: float = 0.5) -> DataFrame:
    """host, n, and for each rule and the base the failures, the shrunk rate and, for rules, whether the host is suspect; host_kept."""
    failures = {**{r: fails(r) for r in RULES}, "base": base_failed()}
    hosts = staged(measures.where(F.col("host").isNotNull()).groupBy("host").agg(F.count("*").alias("n"), *(F.count_if(c).alias(f"failed_{r}") for r, c in failures.items())))
    priors = beta_priors(hosts, [f"failed_{r}" for r in failures])
    for r in failures:
        a, b = priors[f"failed_{r}"]
        shrunk = (F.col(f"failed_{r}") + F.lit(a)) / (F.col("n") + F.lit(a + b))
        hosts = hosts.withColumn(f"shrunk_{r}", shrunk)
        if r != "base":
            hosts = hosts.withColumn(f"suspect_{r}", F.col(f"shrunk_{r}") > suspicion(a, b))
    return hosts.withColumn("host_kept", F.col("shrunk_base") < host_limit)


def filtered(docs: DataFrame, host_limit: float = 0.5, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Measures, base_failed, what the host's rates say, and kept, for every row."""
    measures = staged(measure(docs, id_col, text_col, host_col))
    hosts = host_verdicts(measures, host_limit).select("host", "shrunk_base", *(f"suspect_{r}" for r in MILD), "host_kept")
    if hosts.count() <= BROADCAST_HOSTS:
        hosts = F.broadcast(hosts)
    suspect = F.lit(False)
    for r in MILD:
        suspect = suspect | (fails(r) & F.coalesce(f"suspect_{r}", F.lit(False)))
    return (
        measures.join(hosts, "host", "left")
        .withColumn("base_failed", base_failed())
        .withColumn("suspect", suspect)
        .withColumn("kept", ~F.col("base_failed") & F.coalesce("host_kept", F.lit(True)) & ~F.col("suspect"))
        .withColumnRenamed("shrunk_base", "shrunk_rate")
    )
