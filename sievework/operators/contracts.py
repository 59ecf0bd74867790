"""Contracts of nested JSON records: declared fields are checked in one pass, and children are exploded to rows of their own.

Records are read as VARIANT, so that a key that is absent, null or of another type can be told apart, and no value is
coerced. A text is read once, strictly (``variant``), and its parts stay VARIANT: every function takes a column of texts or of VARIANT.
What can't be read has the finding not_object.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.functions.exprs import SENTENCE_END, WHITE
from sievework.functions.records import strict_json
from sievework.operators.findings import Rule, check, failures, found_in, union

#: How ``kind_of`` names the type of a value, by kind; JSON numbers are whole, decimal or binary.
KINDS = {"string": "STRING", "int": "BIGINT", "number": "BIGINT|DECIMAL.*|DOUBLE|FLOAT", "boolean": "BOOLEAN", "list": "ARRAY", "object": "OBJECT"}
#: Lists whose elements all have one kind.
ELEMENTS = {"strings": "STRING", "objects": "OBJECT"}


#: The column that holds the record as VARIANT.
RECORD = "contract__record"


@dataclass(frozen=True)
class Field:
    """``kind`` is one of KINDS or ELEMENTS; least and most bound a number, the characters of a string or the elements of a list."""

    name: str
    kind: str
    required: bool = True
    nullable: bool = False
    domain: tuple[str, ...] = ()
    least: float | None = None
    most: float | None = None
    sentences: int = 0
    not_blank: bool = False


def variant(json: Column) -> Column:
    """A text of strict JSON as VARIANT, null where it is none: of equal keys the last counts, nothing may follow the value."""
    return F.try_parse_json(strict_json(json))


def record_of(rows: DataFrame, json: str) -> Column:
    """The column as VARIANT, whether it holds texts or is VARIANT already."""
    return F.col(json) if isinstance(rows.schema[json].dataType, T.VariantType) else variant(F.col(json))


def list_of(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def kind_of(value: Column) -> Column:
    """ARRAY, OBJECT, VOID or the name of a scalar's type; what lists and objects hold is not looked at."""
    whole = F.when(list_of(value).isNotNull(), "ARRAY").when(F.try_variant_get(value, "$", "map<string, variant>").isNotNull(), "OBJECT")
    return whole.otherwise(F.schema_of_variant(value))


# The rules of all fields are one SQL expression: a contract has hundreds of terms, and building each of them as a column takes seconds.


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _kind_sql(x: str) -> str:
    return f"CASE WHEN try_variant_get({x}, '$', 'array<variant>') IS NOT NULL THEN 'ARRAY' WHEN try_variant_get({x}, '$', 'map<string, variant>') IS NOT NULL THEN 'OBJECT' ELSE schema_of_variant({x}) END"


def _facts(f: Field) -> dict[str, Column]:
    """What the rules of a field ask of its value, as columns of their own, so that each is worked out once: kind, and text, number or items."""
    path = _quoted(f"$['{f.name}']")
    value = f"try_variant_get({RECORD}, {path}, 'variant')"
    if f.kind == "string":
        what = f"CASE WHEN schema_of_variant({value}) = 'STRING' THEN try_variant_get({RECORD}, {path}, 'string') END"
    else:
        what = f"try_variant_get({RECORD}, {path}, '{'array<variant>' if f.kind == 'list' or f.kind in ELEMENTS else 'double'}')"
    return {f"contract__k_{f.name}": F.expr(_kind_sql(value)), f"contract__v_{f.name}": F.expr(what)}


def _failures(f: Field) -> list[str]:
    """For each rule of a field a struct (defect, detail), or null if it holds."""
    kind, what, there = f"`contract__k_{f.name}`", f"`contract__v_{f.name}`", f"array_contains(contract__keys, {_quoted(f.name)})"
    listed = f.kind == "list" or f.kind in ELEMENTS
    right = f"{kind} RLIKE '^({KINDS['list' if listed else f.kind]})$'"
    if f.kind in ELEMENTS:
        right += f" AND forall({what}, x -> coalesce({_kind_sql('x')} = '{ELEMENTS[f.kind]}', false))"
    right = f"coalesce({right}, false)"
    text = f"CASE WHEN {right} THEN {what} END" if f.kind == "string" else "CAST(NULL AS STRING)"
    size = f"length({text})" if f.kind == "string" else f"CASE WHEN {right} THEN {f'size({what})' if listed else what} END"
    allowed = f"({kind} IS NULL OR {kind} = 'VOID')" if f.nullable else "false"
    white = _quoted(WHITE)
    rules = {"wrong_type": f"{there} AND NOT {right} AND NOT {allowed}"}
    if f.required:
        rules["missing_key"] = f"NOT {there}"
    if f.domain:
        rules["not_in_domain"] = f"{text} NOT IN ({', '.join(map(_quoted, f.domain))})"
    if f.least is not None:
        rules["below_least"] = f"{size} < {f.least}"
    if f.most is not None:
        rules["above_most"] = f"{size} > {f.most}"
    if f.sentences:
        rules["too_few_sentences"] = f"size(filter(split(btrim({text}, {white}), {_quoted(SENTENCE_END)}), x -> btrim(x, {white}) <> '')) < {f.sentences}"
    if f.not_blank:
        rules["blank"] = f"btrim({text}, {white}) = ''"
    return [f"if({failed}, named_struct('defect', '{defect}', 'detail', {_quoted(f.name)}), NULL)" for defect, failed in rules.items()]


def violations(rows: DataFrame, entity: str, json: str, gate: str, fields: Sequence[Field], closed: bool = False, denied: Sequence[str] = (), extra: Sequence[Rule] = ()) -> DataFrame:
    """Findings of each row's record; a closed contract allows no other keys, ``denied`` keys are never allowed.

    A value that is no object has the one finding not_object. Conditions of ``extra`` may use ``RECORD``, the record as VARIANT.
    """
    rows = rows.select(F.col(entity), record_of(rows, json).alias(RECORD))
    facts = {name: c for f in fields for name, c in _facts(f).items()}
    rows = rows.withColumns({"contract__keys": F.map_keys(F.try_variant_get(RECORD, "$", "map<string, variant>"))} | facts)
    names = ", ".join(_quoted(f.name) for f in fields)
    others = [("unknown_key", f"array_sort(array_except(contract__keys, array({names})))")] if closed else []
    others += [("forbidden_key", f"array_sort(array_intersect(contract__keys, array({', '.join(map(_quoted, denied))})))")] if denied else []
    made = [x for f in fields for x in _failures(f)] + [f"if(size({keys}) > 0, named_struct('defect', '{defect}', 'detail', array_join({keys}, ',')), NULL)" for defect, keys in others]
    failed = F.expr(f"array_compact(array({', '.join(made)}))")
    failed = F.concat(failed, failures(list(extra))) if extra else failed
    return found_in(rows, entity, gate, F.when(F.col("contract__keys").isNull(), failures([Rule("not_object", F.lit(True))])).otherwise(failed))


def children(rows: DataFrame, keys: Sequence[str], json: str, path: str) -> DataFrame:
    """The elements of the list at a path (such as ``$.epics``): keys, position (from 1) and json of each."""
    inner = F.try_variant_get(record_of(rows, json), path, "array<variant>")
    found = rows.select(*keys, F.posexplode(inner).alias("position", "contract__child"))
    return found.select(*keys, (F.col("position") + 1).alias("position"), F.coalesce(F.to_json("contract__child"), F.lit("null")).alias("json"))


def elements(rows: DataFrame, entity: str, json: str, field: str) -> DataFrame:
    """The elements of a list as records of their own: entity_id (``<entity>.<field>[<place from 0>]``) and json, as VARIANT."""
    inner = F.try_variant_get(record_of(rows, json), f"$['{field}']", "array<variant>")
    found = rows.select(F.col(entity).cast("string").alias("entity_id"), F.posexplode(inner).alias("place", "json"))
    return found.select(F.format_string(f"%s.{field}[%d]", "entity_id", "place").alias("entity_id"), "json")


def entries(rows: DataFrame, entity: str, json: str, field: str) -> DataFrame:
    """The values of an object's keys as records: entity_id (``<entity>.<field>.<key>``) and json, as VARIANT."""
    inner = F.try_variant_get(record_of(rows, json), f"$['{field}']", "map<string, variant>")
    found = rows.select(F.col(entity).cast("string").alias("entity_id"), F.explode(inner).alias("contract__key", "json"))
    return found.select(F.format_string(f"%s.{field}.%s", "entity_id", "contract__key").alias("entity_id"), "json")


def citation_findings(rows: DataFrame, entity: str, json: str, gate: str, most_quote: int | None = 200) -> DataFrame:
    """Citations: a document, at least one section, lines in order and a short quote; without ``most_quote`` a long one may be cut later."""
    line = lambda k: F.try_variant_get(RECORD, f"$.{k}", "long")
    fields = (Field("document", "string"), Field("section_path", "strings", least=1), Field("quote", "string", required=False, nullable=True, most=most_quote))
    fields += tuple(Field(k, "int", required=False, nullable=True) for k in ("line_start", "line_end"))
    return violations(rows, entity, json, gate, fields, extra=[Rule("lines_out_of_order", line("line_end") < line("line_start"))])


def field_citation_findings(rows: DataFrame, entity: str, json: str, gate: str, most_quote: int | None = 200, field: str = "field_citations") -> DataFrame:
    """Citations of single fields: an object that has a list of citations for each field; a record without the object is right."""
    lists = entries(rows, entity, json, field)
    not_list = lists.select("entity_id", list_of(F.col("json")).isNotNull().alias("listed"))
    single = lists.select("entity_id", F.posexplode(list_of(F.col("json"))).alias("place", "json"))
    single = single.select(F.format_string("%s[%d]", "entity_id", "place").alias("entity_id"), "json")
    return union(check(not_list, "entity_id", gate, [Rule("not_a_list", ~F.col("listed"))]), citation_findings(single, "entity_id", "json", gate, most_quote))


def flattening_findings(rows: DataFrame, entity: str, whole: str, parts: str, gate: str) -> DataFrame:
    """Two arrays of ids that must hold the same ids equally often, each id once."""
    twice = F.size(F.array_distinct(whole)) < F.size(whole)
    return check(rows, entity, gate, [Rule("not_the_same", ~F.array_sort(whole).eqNullSafe(F.array_sort(parts))), Rule("duplicate_id", twice)])
