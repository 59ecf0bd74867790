"""Contracts of recorded verdicts, reviews, evidence bundles and checker results."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.exprs import blank
from sievework.operators.contracts import record_of, variant
from sievework.operators.findings import Rule, check, failures, found_in


@dataclass(frozen=True)
class Grammar:
    """The words of a kind of verdict: ``accepting`` has no findings, ``rejecting`` has one or more."""

    accepting: str
    rejecting: str
    class_field: str
    classes: tuple[str, ...]
    texts: tuple[str, ...]


#: The two kinds of verdicts in use.
VERDICT = Grammar("approve", "reject", "class", ("DC-03", "DC-05", "DC-08", "DC-12", "DC-14"), ("locus",))
REVIEW = Grammar("approve", "revise", "pattern", ("PHANTOM", "UNGROUNDED", "SCOPE_CREEP", "MISSING_TRADEOFF", "SOURCE_COLLAPSE", "DOMAIN_DILUTION", "UNSTATED_ASSUMPTION", "MISSING_SEAM"), ("target", "evidence"))


def _string(x: Column, name: str) -> Column:
    v = F.try_variant_get(x, f"$['{name}']", "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def verdict_findings(rows: DataFrame, entity: str, json: str, gate: str, grammar: Grammar = VERDICT, load_error: str | None = None) -> DataFrame:
    """What is wrong with each verdict; a record that could not be loaded has the one finding unloadable.

    Findings that are no list end the check of a record. A finding's detail begins with its place. A record is read once and checked in one pass.
    """
    own = rows.select(F.col(entity).alias("entity_id"), (F.col(load_error) if load_error else F.lit(None).cast("string")).alias("error"), record_of(rows, json).alias("v"))
    is_object = F.try_variant_get("v", "$", "map<string, variant>").isNotNull()
    error = F.coalesce("error", F.when(~F.coalesce(is_object, F.lit(False)), F.lit("not_object")))
    own = own.select("entity_id", error.alias("error"), _string(F.col("v"), "verdict").alias("verdict"), F.try_variant_get("v", "$.findings", "array<variant>").alias("items"))
    listed, some = F.col("items").isNotNull(), F.size("items") > 0
    whole = failures(
        [
            Rule("verdict_enum", ~F.coalesce(F.col("verdict").isin(grammar.accepting, grammar.rejecting), F.lit(False)), F.col("verdict")),
            Rule("findings_shape", ~listed),
            Rule(f"{grammar.accepting}_with_findings", (F.col("verdict") == grammar.accepting) & listed & some),
            Rule(f"{grammar.rejecting}_without_findings", (F.col("verdict") == grammar.rejecting) & listed & ~some),
        ]
    )

    def single(x: Column, place: Column) -> Column:
        at, named = F.concat(F.lit("findings["), place, F.lit("]")), F.try_variant_get(x, "$", "map<string, variant>").isNotNull()
        rules = [Rule("finding_shape", ~named, at), Rule(f"{grammar.class_field}_enum", named & ~F.coalesce(_string(x, grammar.class_field).isin(*grammar.classes), F.lit(False)), at)]
        return failures([*rules, *(Rule(f"finding_{t}", named & blank(_string(x, t)), at) for t in grammar.texts)])

    each = F.flatten(F.transform(F.coalesce("items", F.array().cast("array<variant>")), single))
    broken = failures([Rule("unloadable", F.col("error").isNotNull(), F.col("error"))])
    return found_in(own, "entity_id", gate, F.when(F.col("error").isNotNull(), broken).otherwise(F.concat(whole, each)))


def other_verdicts(rows: DataFrame, entity: str, json: str, gate: str, verdict: str) -> DataFrame:
    """Records whose verdict is not the one that must be given."""
    own = rows.select(F.col(entity).alias("verdict__e"), _string(record_of(rows, json), "verdict").alias("verdict__own"))
    return check(own, "verdict__e", gate, [Rule("other_verdict", ~F.col("verdict__own").eqNullSafe(F.lit(verdict)), F.col("verdict__own"))])


def found_text(json: Column, grammar: Grammar = VERDICT) -> Column:
    """The text that anchors are matched in: class and texts of all findings, a line each."""
    items = F.filter(F.coalesce(F.try_variant_get(variant(json), "$.findings", "array<variant>"), F.array().cast("array<variant>")), lambda x: F.coalesce(F.schema_of_variant(x).startswith("OBJECT"), F.lit(False)))
    parts = F.flatten(F.transform(items, lambda x: F.array(*(F.coalesce(_string(x, n), F.lit("")) for n in (grammar.class_field, *grammar.texts)))))
    return F.array_join(parts, "\n")


def found_classes(json: Column, grammar: Grammar = VERDICT) -> Column:
    """The classes of all findings."""
    items = F.coalesce(F.try_variant_get(variant(json), "$.findings", "array<variant>"), F.array().cast("array<variant>"))
    return F.filter(F.transform(items, lambda x: _string(x, grammar.class_field)), lambda c: c.isNotNull())


def bundle_findings(rows: DataFrame, entity: str, json: str, gate: str, ids: Sequence[str], evidence: Sequence[str], allowed: Sequence[str], own_id: str = "bundle_id") -> DataFrame:
    """Bundles (entity is their directory): ids and evidence that are missing (null counts as there), another id than the directory, and fields that nothing allows."""
    rows = rows.select(F.col(entity).alias("bundle__entity"), record_of(rows, json).alias("bundle__v"))
    rows = rows.withColumn("bundle__keys", F.coalesce(F.map_keys(F.try_variant_get("bundle__v", "$", "map<string, variant>")), F.array().cast("array<string>")))
    missing = lambda names: F.array_except(F.array(*map(F.lit, names)), F.col("bundle__keys"))
    other = F.array_sort(F.array_except("bundle__keys", F.array(*map(F.lit, [*ids, *evidence, *allowed]))))
    theirs = _string(F.col("bundle__v"), own_id)
    lost = lambda names, defect: F.transform(missing(names), lambda n: F.struct(F.lit(defect).alias("defect"), n.alias("detail")))
    rules = [Rule("other_id", ~theirs.eqNullSafe(F.col("bundle__entity").cast("string")), theirs), Rule("unknown_field", F.size(other) > 0, F.array_join(other, ","))]
    return found_in(rows, "bundle__entity", gate, F.concat(lost(ids, "id_missing"), lost(evidence, "evidence_missing"), failures(rules)))


# Results of a checker: an envelope (json) and an exit code.


def errors_of(envelope: Column) -> Column:
    """Its diagnostics of severity error."""
    found = F.coalesce(F.try_variant_get(variant(envelope), "$.diagnostics", "array<variant>"), F.array().cast("array<variant>"))
    return F.filter(found, lambda d: F.coalesce(_string(d, "severity") == "error", F.lit(False)))


def _told(envelope: str, exit_code: str) -> tuple[Column, Column, Column]:
    record = variant(F.col(envelope))
    ok = F.try_variant_get(record, "$.ok", "variant")
    ok = F.when(F.schema_of_variant(ok) == "BOOLEAN", F.try_variant_get(ok, "$", "boolean"))
    return ok, F.try_variant_get(record, "$.errorCount", "long"), F.col(exit_code)


def compile_findings(rows: DataFrame, entity: str, envelope: str, exit_code: str, gate: str) -> DataFrame:
    """A clean result says ok, counts no errors and ends with 0; warnings are allowed."""
    ok, errors, code = _told(envelope, exit_code)
    n = F.size(errors_of(F.col(envelope)))
    return check(rows, entity, gate, [Rule("not_ok", ~F.coalesce(ok, F.lit(False)), n), Rule("errors", ~F.coalesce(errors == 0, F.lit(False)), n), Rule("exit_code", ~F.coalesce(code == 0, F.lit(False)), code)])


def wrongly_accepted(rows: DataFrame, entity: str, envelope: str, exit_code: str, gate: str) -> DataFrame:
    """What is known to be bad must not be ok, must count errors and end with 1."""
    ok, errors, code = _told(envelope, exit_code)
    return check(rows, entity, gate, [Rule("accepted", ~F.coalesce(~ok, F.lit(False))), Rule("no_errors", F.coalesce(errors, F.lit(0)) < 1), Rule("exit_code", ~F.coalesce(code == 1, F.lit(False)), code)])


def envelope_clean(envelope: Column) -> Column:
    record = variant(envelope)
    return F.coalesce(F.try_variant_get(record, "$.ok", "boolean") & (F.coalesce(F.try_variant_get(record, "$.errorCount", "long"), F.lit(1)) == 0), F.lit(False))


def slot_ready(payload: Column, alias: Column) -> Column:
    """Whether a server's answer names the model as ready: a list of entries, an object with such a list, or a map of names to states."""
    record = variant(payload)
    as_list = lambda path: F.try_variant_get(record, path, "array<variant>")
    entries = F.coalesce(as_list("$.running"), as_list("$.models"), as_list("$.data"), as_list("$"))
    first = lambda x, names: F.coalesce(*(F.nullif(_string(x, n), F.lit("")) for n in names))
    ready = F.exists(entries, lambda x: (first(x, ("model", "alias", "id", "name")) == alias) & (first(x, ("state", "status")) == "ready"))
    mapped = F.try_variant_get(record, "$", "map<string, variant>")
    single = F.exists(F.map_entries(mapped), lambda e: (e["key"] == alias) & (F.schema_of_variant(e["value"]) == "STRING") & (F.try_variant_get(e["value"], "$", "string") == "ready"))
    return F.coalesce(F.when(entries.isNotNull(), ready).otherwise(single), F.lit(False))
