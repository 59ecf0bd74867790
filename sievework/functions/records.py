"""Arrow functions for what built-in functions can't express: strict JSON, YAML, fences, normal forms, citations."""

from __future__ import annotations

import itertools
import json
import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dashes, blanks and quotes that are written in one way.
FOLDED = {
    "\u2010": "-",
    "\u2011": "-",
    "\u2012": "-",
    "\u2013": "-",
    "\u2014": "-",
    "\u2015": "-",
    "\u2212": "-",
    "\u00a0": " ",
    "\u2009": " ",
    "\u202f": " ",
    "\u2018": "'",
    "\u2019": "'",
    "\u201c": '"',
    "\u201d": '"',
}
#: What a fence with JSON and a fence with a program look like.
FENCE = r"```(?:json)?\s*\n?(.*?)\n?\s*```"
FENCED_OBJECT = r"```(?:json)?\s*(\{.*?\})\s*```"
CODE = r"```(?:python|py)?[ \t]*\n(.*?)```"
#: A whole fence (to the end of the text if nothing closes it), or a tag outside of fences.
_FENCE_OR_TAG = re.compile(r"```.*?(?:```|\Z)|<think>|</think>", re.DOTALL)


#: Bytes of texts whose Python values are held at a time.
HELD = 1 << 20


def _column(f: Callable, kind: pa.DataType, schema: str, made: Callable | None = None) -> Callable[[Column], Column]:
    """A column function that applies f to the values of each Arrow batch; null stays null. ``made`` makes an array of the results, else Arrow itself does.

    A batch has up to 10,000 texts of any length, so their Python values are made and dropped ``HELD`` bytes at a time.
    """

    def rows(values: pa.Array) -> pa.Array:
        step = max(1, len(values) * HELD // max(1, values.nbytes))
        done = [(made or pa.array)([None if v is None else f(v) for v in values[i : i + step].to_pylist()], kind) for i in range(0, len(values), step)]
        return pa.concat_arrays(done) if done else pa.array([], kind)

    return lambda column: F.arrow_udf(rows, schema)(column)


def loads(text: str, **more):
    """Strict JSON (of equal keys the last counts, nothing may follow the value); raises ValueError for anything else, deep nesting included."""
    try:
        return json.loads(text, **more)
    except RecursionError as e:
        raise ValueError("nested too deeply") from e


#: What stands for a number that JSON can't write while a value is written, and the number that readers then see.
_MARK, _BEYOND = "\ue000beyond\ue000", "1e999"


_WRITTEN_MARK = json.dumps(_MARK)
#: Made once: ``json.loads`` makes a decoder for each text if it is given an option.
_DECODER = json.JSONDecoder(parse_constant=lambda _: _MARK)


def _strict(text: str) -> str | None:
    """Normal JSON. NaN and the infinities, which some writers give, stay numbers: they become one beyond all others."""
    if text.startswith("\ufeff"):  # json.loads refuses a mark of the byte order, and a decoder does too
        return None
    try:
        return json.dumps(_DECODER.decode(text)).replace(_WRITTEN_MARK, _BEYOND)
    except (ValueError, RecursionError):
        return None


def _canonical(text: str) -> str | None:
    try:
        return json.dumps(loads(text), indent=2, sort_keys=True) + "\n"
    except ValueError:
        return None


def _yaml(text: str) -> str | None:
    import yaml

    try:
        found = yaml.load(text, getattr(yaml, "CSafeLoader", yaml.SafeLoader))
        return json.dumps(found, default=str) if isinstance(found, dict) else None
    except yaml.YAMLError:
        return None


def _toml(text: str) -> str | None:
    import tomllib

    try:
        return json.dumps(tomllib.loads(text), default=str)
    except tomllib.TOMLDecodeError:
        return None


def normal_form(text: str) -> str:
    """NFKC, case folding, and one form of dashes, quotes and blanks."""
    return unicodedata.normalize("NFKC", text).casefold().translate(str.maketrans(FOLDED))


def _tags(text: str) -> list[re.Match]:
    return [m for m in _FENCE_OR_TAG.finditer(text) if not m[0].startswith("`")]


#: What the tags of a text, in their order, say about its thinking; all others have several blocks.
_OUTCOMES = {"": "no_think_block", "<think></think>": "ok", "<think>": "unterminated_think_block", "</think><think>": "think_block_out_of_order"}


def split_thinking(text: str) -> tuple[str, str, str]:
    """(outcome, thinking, the rest): 'ok' where tags outside of fences enclose one block, else what is wrong and the text as it is."""
    tags = _tags(text)
    order = "".join(m[0] for m in tags)
    outcome = _OUTCOMES.get(order if "<think>" in order else "", "several_think_blocks")
    if outcome != "ok":
        return outcome, "", text
    first, last = tags
    return outcome, text[first.end() : last.start()], text[: first.start()] + text[last.end() :]


#: Braces, and strings whose braces count for nothing; one that never ends reaches to the end.
_BRACE = re.compile(r'[{}]|"(?:[^"\\]|\\.)*(?:"|\\?\Z)', re.DOTALL)


def balanced_object(text: str) -> str | None:
    """The first part of the text from a brace to the one that closes it, whether it is JSON or not."""
    begin, depth = text.find("{"), 0
    for m in _BRACE.finditer(text, max(begin, 0)) if begin >= 0 else ():
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if not depth:
            return text[begin : m.end()]
    return None


def response_payload(text: str) -> dict:
    """The object of a response: what follows the thinking as a whole, else its first fence, else an object it begins with.

    A fence that holds anything else than an object ends the search.
    """
    thinking, _, rest = split_thinking(text)
    body = rest.strip()
    found, source = _strict(body), "whole"
    if not (found or "").startswith("{"):
        if fence := re.search(FENCE, rest, re.DOTALL):
            found, source = _strict(fence[1].strip()), "fence"
        elif body.startswith("{") and (leading := _leading(body)):
            found, source = leading, "leading"
        elif found is None:
            source = "none"
    state = "ok" if (found or "").startswith("{") else "unparseable" if found is None else "not_object"
    return {"state": state, "source": source, "json": found if state == "ok" else None, "thinking": thinking}


def _leading(text: str) -> str | None:
    try:
        return json.dumps(json.JSONDecoder().raw_decode(text)[0])
    except (ValueError, RecursionError):
        return None


def any_object(text: str) -> str | None:
    """The JSON object that a fence holds, else the first balanced part of the text; null if neither is one. No part inside of these is tried."""
    fenced = re.search(FENCED_OBJECT, text, re.DOTALL)
    tried = (_strict(x) for x in (fenced and fenced[1], balanced_object(text)) if x)
    return next((x for x in tried if x and x.startswith("{")), None)


def program_of(text: str) -> str | None:
    """The first fence with a program, else the trimmed text and a line end if that is a program."""
    import ast

    if m := re.search(CODE, text, re.DOTALL):
        return m[1]
    text = text.strip()
    try:
        ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return None
    return text + "\n" if text else None


def _named(x: object) -> list[str]:
    """Names in a list of names, or of objects with a filename."""
    found = []
    for i in x if type(x) is list else ():
        if type(i) is str:
            if i.strip():
                found.append(i)
        elif type(i) is dict and type(name := i.get("filename")) is str:
            found.append(name)
    return found


#: The fields that cite documents, and how each names them.
CITING = {
    "document": lambda x: [x] if type(x) is str else [],
    "cited_docs": _named,
    "source_documents": _named,
    "suggested_context_files": lambda x: [i for i in x if type(i) is str and i.endswith(".md")] if type(x) is list else [],
}


def _citing(text: str) -> list[tuple[str, str]]:
    """(name, field) of every citation; all objects and lists of the record are gone over, each once."""
    try:
        left = [loads(text)]
    except ValueError:
        return []
    found = set()
    for x in left:  # grows meanwhile
        if type(x) is dict:
            for field, value in x.items():
                if field in CITING:
                    for name in CITING[field](value):
                        found.add((name, field))
                if type(value) is dict or type(value) is list:
                    left.append(value)
        elif type(x) is list:
            left += [i for i in x if type(i) is dict or type(i) is list]
    return sorted(found)


def citations(text: str) -> list[dict]:
    """Every document that a record cites, at any depth, with the field that cites it, each once."""
    return [{"name": n, "kind": k} for n, k in _citing(text)]


def _flat(rows: list[list[tuple[str, str]] | None], kind: pa.DataType) -> pa.Array:
    """Lists of pairs as lists of structs: their values are laid one after the other, without a Python object for each struct."""
    ends = pa.array([0, *itertools.accumulate(len(r or ()) for r in rows)], pa.int32())
    values = [pa.array([pair[k] for r in rows for pair in r or ()], pa.string()) for k in (0, 1)]
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(values, fields=list(kind.value_type)), kind, mask=pa.array([r is None for r in rows], pa.bool_()))


strict_json = _column(_strict, pa.string(), "string")
canonical_json = _column(_canonical, pa.string(), "string")
yaml_json = _column(_yaml, pa.string(), "string")
toml_json = _column(_toml, pa.string(), "string")
normalised = _column(normal_form, pa.string(), "string")
first_object = _column(any_object, pa.string(), "string")
program = _column(program_of, pa.string(), "string")
payload = _column(response_payload, pa.struct([("state", pa.string()), ("source", pa.string()), ("json", pa.string()), ("thinking", pa.string())]), "state string, source string, json string, thinking string")
cited = _column(_citing, pa.list_(pa.struct([("name", pa.string()), ("kind", pa.string())])), "array<struct<name: string, kind: string>>", _flat)


def _with_reasoning(content: str | None, reasoning: str | None) -> str | None:
    if not reasoning or any(m[0] == "<think>" for m in _tags(content or "")):
        return content
    return f"<think>{reasoning}</think>\n{content or ''}"


def response_text(content: Column, reasoning: Column) -> Column:
    """The content, after its reasoning in a think block if no such block begins in it outside of fences."""

    def rows(contents: pa.Array, reasons: pa.Array) -> pa.Array:
        return pa.array([_with_reasoning(c, r) for c, r in zip(contents.to_pylist(), reasons.to_pylist(), strict=True)], pa.string())

    return F.arrow_udf(rows, "string")(content, reasoning)
