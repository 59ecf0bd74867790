"""Columns for the checks and texts of evaluation records; all run inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.functions.records import FENCE

#: Where a sentence ends, and an address with user and password.
SENTENCE_END = r"[.!?]\s+|[.!?]$"
PASSWORD = "://([^:/@]+):([^@]+)@"
#: All white space of Unicode, and the control characters that part records.
WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(text, F.lit(WHITE))


def sentence_count(text: Column) -> Column:
    """Parts between sentence ends that are not blank."""
    return F.size(F.filter(F.split(stripped(text), SENTENCE_END), lambda x: stripped(x) != ""))


def blank(text: Column) -> Column:
    """Null, or nothing but white space of any kind."""
    return text.isNull() | (stripped(text) == "")


def not_in_domain(value: Column, domain: Sequence[str]) -> Column:
    """True for a value outside the domain; null is allowed."""
    return value.isNotNull() & ~value.isin(*domain)


def missing_keys(json: Column, required: Sequence[str]) -> Column:
    """Keys that must be present, even if null, and are not."""
    return F.array_except(F.array(*map(F.lit, required)), F.coalesce(F.json_object_keys(json), F.array().cast("array<string>")))


def keys_outside(json: Column, allowed: Sequence[str]) -> Column:
    return F.array_except(F.json_object_keys(json), F.array(*map(F.lit, allowed)))


def keys_among(json: Column, denied: Sequence[str]) -> Column:
    return F.array_intersect(F.json_object_keys(json), F.array(*map(F.lit, denied)))


def same_multiset(a: Column, b: Column) -> Column:
    return F.array_sort(a).eqNullSafe(F.array_sort(b))


def iso_timestamp(text: Column) -> Column:
    """A date with a time of day; a trailing Z counts as +00:00."""
    shaped = text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?$")
    return F.when(shaped, F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00")))


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds with three decimals, null if either is null."""
    return F.round((F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6), 3)


def first_present(json: Column, key: str) -> Column:
    """The value at key if the key is present, else that of the first key."""
    keys = F.json_object_keys(json)
    chosen = F.when(F.array_contains(keys, key), F.lit(key)).otherwise(F.get(keys, F.lit(0)))
    return F.from_json(json, "map<string,string>")[chosen]


def null_unless_any(*fields: Column) -> Column:
    """A struct of the fields, or null if all of them are."""
    return F.when(F.coalesce(*(f.cast("string") for f in fields)).isNotNull(), F.struct(*fields))


def redacted(text: Column) -> Column:
    """The password of an address with user and password is left out."""
    return F.regexp_replace(text, PASSWORD, "://$1:<redacted>@")


def redacted_query(url: Column) -> Column:
    return F.regexp_replace(url, r"\?.*$", "?<redacted>")


def first_fence(text: Column) -> Column:
    """What the first fenced block holds."""
    return F.regexp_extract(text, "(?s)" + FENCE, 1)


def blocks_of(text: Column, kind: str) -> Column:
    """All fenced blocks of a kind."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)```{kind}\s*\n(.*?)```"), 1)


def without_comments(text: Column) -> Column:
    return F.regexp_replace(text, r"(?m)//.*$", "")


def missing_parts(text: Column, parts: Sequence[str]) -> Column:
    """Those of the parts that the text does not contain."""
    return F.filter(F.array(*map(F.lit, parts)), lambda p: ~F.contains(text, p))


def undeclared(text: Column, keyword: str, names: Sequence[str]) -> Column:
    """Names that no ``keyword name`` declares outside comments."""
    code = without_comments(text)
    return F.array_compact(F.array(*(F.when(~code.rlike(rf"\b{keyword}\s+{n}\b"), F.lit(n)) for n in names)))


def header_field(text: Column, pattern: str, last: bool = False) -> Column:
    """What the pattern's group finds, null without a match; the first or the last one."""
    found = F.regexp_extract_all(text, F.lit(f"(?m){pattern}"), 1)
    return F.try_element_at(found, F.lit(-1 if last else 1))


def header_counts(text: Column, pattern: str, groups: int) -> Column:
    """The whole numbers of a header line's groups, null without a match."""
    return F.when(text.rlike(f"(?m){pattern}"), F.array(*(F.regexp_extract(text, f"(?m){pattern}", k + 1).try_cast("int") for k in range(groups))))


def lines_without(text: Column, pattern: str) -> Column:
    """The text without the lines that match; what remains is byte for byte as it was."""
    return F.array_join(F.filter(F.split(text, r"(?<=\n)"), lambda x: ~x.rlike(pattern)), "")


def tail(text: Column, n: int) -> Column:
    return F.right(text, F.lit(n))


def family_key(base: Column, quantisation: Column) -> Column:
    return F.concat_ws("/", base, quantisation)


def task_type(raw: Column, aliases: dict[str, str], default: str = "feature") -> Column:
    known = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv))
    return F.coalesce(known[raw], raw, F.lit(default))


def populated_fields(*fields: Column) -> Column:
    """How many of the fields are neither null nor empty; 0 and false count."""
    return sum((F.when(f.isNotNull() & (f.cast("string") != "") & (f.cast("string") != "[]"), 1).otherwise(0) for f in fields), F.lit(0))


def content_of(response: Column) -> Column:
    return F.get_json_object(response, "$.choices[0].message.content")


def finish_of(response: Column) -> Column:
    return F.get_json_object(response, "$.choices[0].finish_reason")


def config_record(**fields: Column) -> Column:
    """A record of settings as JSON, its keys in order and nulls written, so that equal settings have equal texts."""
    return F.to_json(F.struct(*(v.alias(k) for k, v in sorted(fields.items()))), {"ignoreNullFields": "false"})


def environment(**variables: Column) -> Column:
    """A map of environment variables; every one is a text."""
    return F.create_map(*(x for k, v in sorted(variables.items()) for x in (F.lit(k), v.cast("string"))))
