"""Large instruments: thousands of patterns over texts, of which a text meets only those that could match it.

Of each pattern a *need* is found: literal texts of which any match holds one. All needs are one Aho-Corasick automaton, which goes
over each text once in an Arrow task; only the patterns whose need occurs are then tried, as Java regular expressions like all others. A
pattern without a need is tried on every text. Texts and needs are case-folded, so the case never matters for a need.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import cache
from re import _constants as op
from re import _parser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.operators.anchors import Anchor

#: Shorter literals occur in most texts.
LEAST = 2
#: Capital and small letters that Java matches with i and I, and Python's case folding doesn't.
_FOLD = str.maketrans({"İ": "i", "ı": "i"})


def folded(text: str) -> str:
    return text.translate(_FOLD).casefold()


def need_of(pattern: str) -> frozenset[str] | None:
    """Folded literals of which every match of a pattern holds one; None if none can be told."""
    flags = re.match(r"\(\?[a-zA-Z]+\)", pattern)
    body = pattern[flags.end() :] if flags else pattern
    if flags and "x" in flags[0] or re.search(r"\(\?[<!=>a-zA-Z-]|\\[QEGXRhHvVNkpP]|&&|[*+?}]\+", body):  # what Java reads in another way
        return None
    try:
        return _need(_parser.parse(body))
    except (re.error, OverflowError, RecursionError):
        return None


def _need(items: Sequence) -> frozenset[str] | None:
    """The best need among the parts that must all match: the one whose shortest literal is longest."""
    found, run = [], ""
    for kind, value in [*items, (None, None)]:
        if kind is op.LITERAL:
            run += chr(value)
            continue
        if run:
            found.append(frozenset([folded(run)]))
            run = ""
        if kind is op.SUBPATTERN:
            found.append(_need(value[3]))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] > 0:
            found.append(_need(value[2]))
        elif kind is op.BRANCH:
            ways = [_need(way) for way in value[1]]
            found.append(None if None in ways else frozenset().union(*ways))
    good = [n for n in found if n and min(map(len, n)) >= LEAST]
    return max(good, key=lambda n: (min(map(len, n)), -len(n)), default=None)


@cache
def _automaton(needs: tuple[frozenset[str] | None, ...]):
    """The automaton of all needs (each literal with the patterns it stands for), and the patterns without a need."""
    import ahocorasick

    of: dict[str, list[int]] = {}
    for k, need in enumerate(needs):
        for literal in need or ():
            of.setdefault(literal, []).append(k)
    found = ahocorasick.Automaton()
    for literal, patterns in of.items():
        found.add_word(literal, patterns)
    found.make_automaton()
    return found, [k for k, need in enumerate(needs) if need is None]


def candidates(texts: pa.Array, needs: tuple[frozenset[str] | None, ...]) -> pa.Array:
    """For each text the patterns to try."""
    automaton, always = _automaton(needs)
    out = []
    for text in texts.to_pylist():
        met = set(always) if text is not None else set()
        for _, patterns in automaton.iter(folded(text)) if text and len(automaton) else ():
            met.update(patterns)
        out.append(sorted(met))
    return pa.array(out, pa.list_(pa.int32()))


def matches(units: DataFrame, text: str, instrument: Sequence[Anchor]) -> DataFrame:
    """Units with group_id, ord and matched for every pattern that matches, as ``anchors.matches`` gives them, for an instrument of any size
    that a user can write (it goes to the tasks with the code)."""
    instrument = list(instrument)
    needs = tuple(need_of(a.pattern) for a in instrument)
    tried = F.arrow_udf(lambda t: candidates(t, needs), "array<int>")
    patterns = units.sparkSession.createDataFrame([(k, *a) for k, a in enumerate(instrument)], "instrument__k int, group_id string, ord int, instrument__p string")
    rows = units.withColumn("instrument__k", F.explode(tried(F.col(text)))).join(F.broadcast(patterns), "instrument__k")
    found = rows.withColumn("matched", F.regexp_substr(text, F.col("instrument__p"))).where("matched IS NOT NULL")
    return found.select(*units.columns, "group_id", "ord", "matched")


def leaks(files: DataFrame, key: str, text: str, banned: Sequence[Anchor]) -> DataFrame:
    """key and group_id of what files must not hold, each once."""
    return matches(files.select(key, text), text, banned).select(key, "group_id").distinct()
