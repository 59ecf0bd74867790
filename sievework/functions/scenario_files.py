"""The parts of scenario files: a table function over (key, text), one file a row, whatever its blanks and line ends are.

``parts_of`` makes rows of a file: the header (comments before the feature), the feature, the background, every scenario, and everything
that is out of place. All kinds of white space around a line count as blank.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator, Sequence
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that begin a step, and blocks of a scenario file.
STEP_WORDS = ("Given", "When", "Then", "And", "But", "*")
BLOCKS = ("Feature", "Background", "Scenario Outline", "Scenario", "Examples", "Rule")
QUOTES = ('"""', "```")
BOM = "\ufeff"

PART = "part string, place int, line int, name string, keyword string, tags array<string>, comments array<string>, steps array<string>, text string, defect string"
_MARKS, _STEPS, _BLOCKS = frozenset(QUOTES), frozenset(STEP_WORDS), frozenset(BLOCKS)
#: Characters of texts whose parts are held at a time, so that memory does not grow with the files of a batch.
SLICE = 1 << 20
#: The lists of a part that stay empty; none is ever written to.
_NONE: list[str] = []


class Part:
    """One row: what a part of a file states. Its lists grow while the part is read."""

    __slots__ = ("part", "place", "line", "name", "keyword", "tags", "comments", "steps", "lines", "defect")

    def __init__(self, part: str, place: int = 0, line: int | None = None, name: str | None = None, keyword: str | None = None, tags: list[str] | None = None, comments: list[str] | None = None, lines: list[str] | None = None, defect: str | None = None) -> None:
        self.part, self.place, self.line, self.name, self.keyword, self.defect = part, place, line, name, keyword, defect
        self.tags, self.comments, self.lines = tags or _NONE, comments or _NONE, lines or _NONE
        self.steps: list[str] = _NONE


def parts_of(text: str) -> list[Part]:
    """The parts of a file: header, feature if there is one, background, scenarios and defects.

    One loop over the stripped lines, as this is what reading files costs. ``here`` is the background or scenario that is being read;
    tags and comments above the next one wait for it. The mark that opened a quote closes it; the other mark inside it changes nothing.
    """
    header, feature = Part("header"), Part("feature")
    header.comments, feature.lines = [], []
    background: Part | None = None
    here: Part | None = None
    scenarios: list[Part] = []
    defects: list[Part] = []
    features, past_steps, quote = 0, False, ""
    tags: list[str] = []
    comments: list[str] = []

    def wrong(defect: str, number: int | None, line: str) -> None:
        name = None if here is None else here.name or "(background)"
        defects.append(Part("defect", line=number, name=name, lines=[line] if line else None, defect=defect))

    for number, line in enumerate(map(str.strip, text.splitlines()), 1):
        first = line[:1]
        if quote:
            if here is not None:
                here.lines.append("" if line[:3] in _MARKS else line)
            if line[:3] == quote:
                quote = ""
        elif not first:
            pass
        elif first == "#":  # before the feature it is the header's; later it goes with the scenario that it is in, and with the next one
            if not features:
                header.comments.append(line)
            else:
                comments.append(line)
                if here is not None and here.part == "scenario":
                    here.comments.append(line)
        elif first == "@":
            words = line.split()
            own = [w for w in words if w[0] == "@"]
            if len(own) < len(words):
                wrong("malformed_tag_line", number, line)
            tags += own
        elif first == "|":
            if here is not None:
                here.lines.append(line)
        elif first in "\"`" and line[:3] in _MARKS:
            quote = line[:3]
            if here is not None:
                here.lines.append("")
        elif ":" in line and (block := line.partition(":"))[0] in _BLOCKS:
            kind, name = block[0], block[2].strip()
            if kind == "Feature":
                if features:
                    wrong("multiple_feature_blocks", number, "")
                features += 1
                feature.name, feature.line, feature.tags = name, number, tags
                here, past_steps, tags, comments = None, False, [], []
            elif kind == "Background":
                here = background = Part("background", line=number)
                here.steps, here.lines = [], []
                past_steps, tags, comments = False, [], []
            elif kind == "Examples":
                past_steps = True
            elif kind == "Rule":
                wrong("rule_block_not_in_contract", number, "")
            else:
                here = Part("scenario", len(scenarios) + 1, number, name, kind, tags, None, [name])
                here.comments, here.steps = comments, []
                scenarios.append(here)
                past_steps, tags, comments = False, [], []
        elif line.partition(" ")[0] in _STEPS:
            if here is None:
                wrong("step_outside_scenario", number, line)
            else:
                here.steps.append(line)
                here.lines.append(line)
                past_steps = True
        elif not features:  # free text describes what it stands under, but after a step it is the rest of a wrapped one
            wrong("text_before_feature", number, line)
        elif here is None:
            feature.lines.append(line)
        elif past_steps:
            wrong("wrapped_step_continuation", number, line)
        else:
            here.lines.append(line)
    if quote:
        wrong("unterminated_docstring", None, "")
    if not features:
        wrong("no_feature_block", None, "")
    told = [feature] if features or feature.lines else []
    return [header, *told, *([background] if background else []), *scenarios, *defects]


def _lists(values: list[list[str]]) -> pa.Array:
    offsets = pa.array([0, *accumulate(map(len, values))], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(list(chain.from_iterable(values)), pa.string()))


def _column(rows: list[Part], name: str) -> pa.Array:
    if name in ("tags", "comments", "steps"):
        return _lists([getattr(p, name) for p in rows])
    if name == "text":
        return pa.array(["\n".join(p.lines) for p in rows], pa.string())
    return pa.array([getattr(p, name) for p in rows], pa.int32() if name in ("place", "line") else pa.string())


def _table(keys: pa.Array, rows: list[Part], at: list[int], names: list[str]) -> pa.Table:
    """A table of some parts; ``at`` are the places of their files among the keys."""
    return pa.table([keys.take(pa.array(at, pa.int64())), *(_column(rows, n) for n in names[1:])], names=names)


def scenario_parts(texts: DataFrame, key: str, text: str, columns: Sequence[str] = (), kinds: Sequence[str] = ()) -> DataFrame:
    """key and the columns of ``PART`` for every part of every file (null: an empty file; a byte order mark is no part of the text).

    place numbers the scenarios of a file from 1; the text of a part is all that it states, without tags and comments. With ``columns`` or
    ``kinds`` of parts only these are made; of kind "mark" is a row for a byte order mark.
    """
    fields = [x for x in PART.split(", ") if not columns or x.split()[0] in columns]
    names, wanted = [key, *(x.split()[0] for x in fields)], frozenset(kinds)

    class Reader:
        def eval(self, table: pa.RecordBatch) -> Iterator[pa.Table]:
            gc.disable()  # parts hold no cycles; looking for some takes a quarter of the time
            try:
                keys, rows, at, held = table.column(0), [], [], 0
                for k, t in enumerate(table.column(1)):
                    t = t.as_py() or ""
                    own = parts_of(t.removeprefix(BOM))
                    own = [p for p in own if p.part in wanted] if wanted else own
                    if "mark" in wanted and t.startswith(BOM):
                        own.append(Part("mark"))
                    rows += own
                    at += [k] * len(own)
                    held += len(t)
                    if held >= SLICE:
                        yield _table(keys, rows, at, names)
                        rows, at, held = [], [], 0
                yield _table(keys, rows, at, names)
            finally:
                gc.enable()

    Reader.eval.__annotations__ = {"table": pa.RecordBatch, "return": Iterator[pa.Table]}
    read = F.arrow_udtf(Reader, returnType=", ".join([f"`{key}` {texts.schema[key].dataType.simpleString()}", *fields]))
    return read(texts.select(key, text).asTable())
