"""Contracts of planning records: roadmaps, epic plans and batches of enrichments, with all that they hold.

Each function takes records (entity, json) and gives findings; a finding's entity_id is the path of the part it is about
(``7.epics[0].features[2]``). Parts are exploded to rows of their own, so a plan of any size is checked in parallel.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.exprs import blank, iso_timestamp
from sievework.operators.contracts import RECORD, Field, citation_findings, elements, field_citation_findings, flattening_findings, record_of, variant, violations
from sievework.operators.findings import Rule, check, union
from sievework.sources.staging import staged

#: The domains of the contracts.
MODES = ("idea", "extract", "greenfield", "evolve", "impact", "scope")
PRIORITY = ("Low", "Normal", "High", "Critical")
MOSCOW = ("Must (core)", "Must", "Should", "Could", "Won't", "N/A", "?")
VALUE = ("1 (Lowest)", "2 (Low)", "3 (Medium)", "4 (High)", "5 (Highest)")
COMPLEXITY = ("Very easy (<.5d)", "Easy (≈1d)", "Normal (2-5d)", "Complex (5-10d)", "Very complex (>10d)", "Unknown", "N/A")
ESTIMATE_UNIT = ("story-points", "t-shirt", "person-days", "complexity-bucket", "ideal-hours")
CONFIDENCE = ("high", "medium", "low")
ENRICHING = ("priority", "moscow", "value", "role", "complexity", "acceptance_criteria", "field_citations")
STUB_KEYS = ("feature_id", "title", "intent", "source_citations")
IDENTITY_KEYS = ("title", "bounded_context")
MOST_QUOTE, MOST_INTENT = 200, 100


def _strings(*names: str) -> tuple[Field, ...]:
    return tuple(Field(n, "string") for n in names)


def _by_text(rows: DataFrame, entity: str) -> DataFrame:
    """Parts have paths as entities, so the whole record's is a text too."""
    return rows.withColumn(entity, F.col(entity).cast("string"))


def _lists(*names: str, required: bool = True) -> tuple[Field, ...]:
    return tuple(Field(n, "strings", required=required) for n in names)


def _optional(name: str, kind: str, domain: tuple[str, ...] = ()) -> Field:
    """May be absent or null."""
    return Field(name, kind, required=False, nullable=True, domain=domain)


#: The fields of each kind of record.
ENRICHMENT = (
    _optional("priority", "string", PRIORITY),
    _optional("moscow", "string", MOSCOW),
    _optional("value", "string", VALUE),
    _optional("complexity", "string", COMPLEXITY),
    _optional("role", "string"),
    *_lists("acceptance_criteria", "technical_notes", "risks", "open_questions", "links", required=False),
    Field("field_citations", "object", required=False),
)
FEATURE = (
    *_strings("feature_id", "title", "bounded_context"),
    Field("description", "string", sentences=2),
    *_lists("source_documents", "constraints", "suggested_context_files", "depends_on"),
    _optional("type", "string"),
    *ENRICHMENT,
)
EPIC = (*_strings("id", "name", "bounded_context", "description"), Field("features", "list", least=1), *_lists("source_documents"), Field("field_citations", "object", required=False))
ROADMAP = (
    *_strings("project_name", "priority_rationale"),
    Field("mode", "string", domain=MODES),
    *_lists("constraints_and_dependencies", "open_questions"),
    Field("epics", "list", least=1),
    Field("feature_spec_inputs", "list"),
    _optional("change_summary", "string"),
    _optional("coverage_score", "number"),
    _optional("estimate_unit", "string", ESTIMATE_UNIT),
)
SOURCE_DOCUMENT = tuple(Field(n, "string", not_blank=True) for n in ("filename", "contribution"))
ASSUMPTION = (*_strings("id", "category", "statement", "source", "impact_if_wrong"), Field("confidence", "string", domain=CONFIDENCE))
STUB = (*_strings("feature_id", "title"), Field("intent", "string", most=MOST_INTENT), Field("source_citations", "list", required=False, nullable=True))
EPIC_STUB = (*_strings("epic_id", "name", "bounded_context"), Field("cited_docs", "strings", least=1), Field("feature_stubs", "list", least=1))
PLAN = (
    *_strings("project_name"),
    Field("mode", "string", required=False, domain=("extract",)),
    Field("epics", "list", least=1),
    *_lists("open_questions", "constraints_and_dependencies", required=False),
    _optional("coverage_score", "number"),
    Field("priority_rationale", "string", required=False),
    _optional("nfr_candidates", "objects"),
)
ENRICHED = (
    *_strings("feature_id"),
    Field("description", "string", sentences=2),
    Field("source_documents", "strings", least=1),
    *_lists("constraints", "suggested_context_files", "depends_on", required=False),
    Field("type", "string", required=False),
    *ENRICHMENT,
)
BATCH = (*_strings("project_name", "epic_id"), Field("enrichments", "list", least=1))


def feature_findings(rows: DataFrame, entity: str, json: str, gate: str) -> DataFrame:
    return union(violations(_by_text(rows, entity), entity, json, gate, FEATURE), field_citation_findings(rows, entity, json, gate))


def source_document_findings(rows: DataFrame, entity: str, json: str, gate: str) -> DataFrame:
    return violations(rows, entity, json, gate, SOURCE_DOCUMENT)


def assumption_findings(rows: DataFrame, entity: str, json: str, gate: str) -> DataFrame:
    return violations(rows, entity, json, gate, ASSUMPTION)


def stub_findings(rows: DataFrame, entity: str, json: str, gate: str) -> DataFrame:
    """Other keys than a stub's own are enrichment that leaked (unknown_key)."""
    return union(violations(_by_text(rows, entity), entity, json, gate, STUB, closed=True), citation_findings(elements(rows, entity, json, "source_citations"), "entity_id", "json", gate, MOST_QUOTE))


def enrichment_findings(rows: DataFrame, entity: str, json: str, gate: str) -> DataFrame:
    """Keys of the identity are not allowed (forbidden_key); long quotes are, since they are cut later."""
    return union(violations(_by_text(rows, entity), entity, json, gate, ENRICHED, denied=IDENTITY_KEYS), field_citation_findings(rows, entity, json, gate, most_quote=None))


def _shared(rows: DataFrame, entity: str, json: str, gate: str) -> list[DataFrame]:
    return [
        source_document_findings(elements(rows, entity, json, "source_documents"), "entity_id", "json", gate),
        assumption_findings(elements(rows, entity, json, "assumptions"), "entity_id", "json", gate),
    ]


def _ids(record: Column, epics: str | None, features: str) -> Column:
    """The feature ids of all objects in a list, or in that list of all objects of ``epics``; '?' where one has none."""
    objects = lambda x, path: F.filter(F.coalesce(F.try_variant_get(x, path, "array<variant>"), F.array().cast("array<variant>")), lambda e: F.try_variant_get(e, "$", "map<string, variant>").isNotNull())
    ids = lambda x: F.transform(objects(x, f"$.{features}"), lambda f: F.coalesce(F.try_variant_get(f, "$.feature_id", "string"), F.lit("?")))
    return F.flatten(F.transform(objects(record, f"$.{epics}"), ids)) if epics else ids(record)


def duplicate_features(rows: DataFrame, entity: str, json: str, gate: str, epics: str | None, features: str) -> DataFrame:
    """One finding for each record in which a feature id occurs twice, with these ids."""
    ids = _ids(record_of(rows, json), epics, features)
    own = rows.select(F.col(entity).alias("entity_id"), F.array_sort(ids).alias("ids"))
    before = F.slice("ids", 1, F.greatest(F.size("ids") - 1, F.lit(0)))
    twice = F.array_distinct(F.filter(F.zip_with("ids", F.concat(F.array(F.lit(None).cast("string")), before), lambda a, b: F.when(a == b, a)), lambda x: x.isNotNull()))
    return check(own, "entity_id", gate, [Rule("duplicate_feature", F.size(twice) > 0, F.array_join(twice, ","))])


def read_once(rows: DataFrame, entity: str, json: str) -> DataFrame:
    """entity (as text) and json as VARIANT, written: a record's text is read once, however many of its parts are checked."""
    return staged(rows.select(F.col(entity).cast("string").alias(entity), record_of(rows, json).alias(json)))


def roadmap_findings(rows: DataFrame, entity: str, json: str, gate: str = "roadmap") -> DataFrame:
    """A whole roadmap; its flat list of features must hold the ids of the epics' features equally often."""
    rows = read_once(rows, entity, json)
    record = F.col(json)
    epics = elements(rows, entity, json, "epics")
    both = F.try_variant_get(record, "$.epics", "array<variant>").isNotNull() & F.try_variant_get(record, "$.feature_spec_inputs", "array<variant>").isNotNull()
    flat = rows.where(both).select(F.col(entity).alias("entity_id"), _ids(record, "epics", "features").alias("whole"), _ids(record, None, "feature_spec_inputs").alias("parts"))
    return union(
        violations(_by_text(rows, entity), entity, json, gate, ROADMAP),
        violations(epics, "entity_id", "json", gate, EPIC),
        field_citation_findings(epics, "entity_id", "json", gate),
        feature_findings(elements(epics, "entity_id", "json", "features"), "entity_id", "json", gate),
        feature_findings(elements(rows, entity, json, "feature_spec_inputs"), "entity_id", "json", gate),
        flattening_findings(flat, "entity_id", "whole", "parts", gate),
        *_shared(rows, entity, json, gate),
    )


def plan_findings(rows: DataFrame, entity: str, json: str, gate: str = "plan") -> DataFrame:
    """A plan of epics with stubs; its mode is extract, also where none is given."""
    rows = read_once(rows, entity, json)
    at = F.try_variant_get(RECORD, "$.phase_a_completed_at", "variant")
    kind = F.schema_of_variant(at)
    told = kind.isNotNull() & (kind != "VOID") & ~kind.rlike("^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$")
    text = F.when(kind == "STRING", F.try_variant_get(at, "$", "string"))
    day = text.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_timestamp(text).isNotNull()
    wrong = told & ~F.coalesce(iso_timestamp(text).isNotNull() | day, F.lit(False))
    epics = elements(rows, entity, json, "epics")
    return union(
        violations(rows, entity, json, gate, PLAN, extra=[Rule("not_a_timestamp", wrong, F.lit("phase_a_completed_at"))]),
        violations(epics, "entity_id", "json", gate, EPIC_STUB),
        stub_findings(elements(epics, "entity_id", "json", "feature_stubs"), "entity_id", "json", gate),
        duplicate_features(rows, entity, json, gate, "epics", "feature_stubs"),
        *_shared(rows, entity, json, gate),
    )


def batch_findings(rows: DataFrame, entity: str, json: str, gate: str = "batch") -> DataFrame:
    """A batch of enrichments, and each of them."""
    rows = read_once(rows, entity, json)
    return union(
        violations(rows, entity, json, gate, BATCH),
        enrichment_findings(elements(rows, entity, json, "enrichments"), "entity_id", "json", gate),
        duplicate_features(rows, entity, json, gate, None, "enrichments"),
    )


def enriching_fields(json: Column) -> Column:
    """How many of the enriching fields hold something; 0 and false do, empty texts, lists and objects don't."""
    record = variant(json)
    told = lambda n: ~F.coalesce(F.to_json(F.try_variant_get(record, f"$.{n}", "variant")), F.lit("null")).isin("null", '""', "[]", "{}")
    return sum((told(n).cast("int") for n in ENRICHING), F.lit(0))


def batch_against_stubs(enrichments: DataFrame, stubs: DataFrame, gate: str = "batch", least_fields: int = 3) -> DataFrame:
    """Enrichments (batch, feature_id, json) of features that the stubs (batch, feature_id) don't have, stubs that none enriches, and batches all of whose enrichments are thin.

    A batch without enrichments is not thin.
    """
    own, theirs = enrichments.select("batch", "feature_id"), stubs.select("batch", "feature_id")
    row = lambda df, defect: df.distinct().select(F.col("batch").cast("string").alias("entity_id"), F.lit(gate).alias("gate"), F.lit(defect).alias("defect"), F.col("feature_id").cast("string").alias("detail"))
    thin = enrichments.groupBy("batch").agg(F.bool_and(enriching_fields(F.col("json")) < least_fields).alias("thin")).where("thin")
    return union(
        row(own.join(theirs, ["batch", "feature_id"], "left_anti"), "not_in_stubs"),
        row(theirs.join(own, ["batch", "feature_id"], "left_anti"), "stub_not_enriched"),
        row(thin.withColumn("feature_id", F.lit("")), "all_thin"),
    )


def structure_counts(json: Column) -> Column:
    """A struct of the number of epics and of features (or stubs) in them."""
    epics = F.coalesce(F.try_variant_get(variant(json), "$.epics", "array<variant>"), F.array().cast("array<variant>"))
    features = lambda e: F.greatest(F.size(F.coalesce(F.try_variant_get(e, "$.feature_stubs", "array<variant>"), F.try_variant_get(e, "$.features", "array<variant>"), F.array().cast("array<variant>"))), F.lit(0))
    return F.struct(F.size(epics).alias("epics"), F.aggregate(epics, F.lit(0), lambda n, e: n + features(e)).alias("features"))


def structure_floors(rows: DataFrame, entity: str, json: str, gate: str, epics: int = 5, features: int = 18) -> DataFrame:
    n = rows.withColumn("roadmap__n", structure_counts(F.col(json)))
    return check(n, entity, gate, [Rule("too_few_epics", F.col("roadmap__n.epics") < epics, F.col("roadmap__n.epics")), Rule("too_few_features", F.col("roadmap__n.features") < features, F.col("roadmap__n.features"))])


def _cites(name: str) -> Callable[[Column], Column]:
    """Whether a list or an object of that name holds anything."""
    held = lambda x, kind: F.coalesce(F.size(F.try_variant_get(x, f"$.{name}", kind)), F.lit(0)) > 0
    return lambda x: held(x, "array<variant>") | held(x, "map<string, variant>")


#: What a plan without sources must not have, at any level.
CITING = ("source_documents", "field_citations", "source_citations", "cited_docs")


def nothing_claimed(rows: DataFrame, entity: str, json: str, gate: str, assumptions: int = 3) -> DataFrame:
    """A plan without sources: no coverage score, no citations at any level, and some assumptions that say something.

    The levels are the plan, its epics and flat features, and the features or stubs of epics; an empty list or object cites nothing.
    """
    own = rows.select(F.col(entity).alias("plan__e"), record_of(rows, json).alias("plan__v"))
    record, nothing = F.col("plan__v"), F.array().cast("array<variant>")
    under = lambda x, name: F.coalesce(F.try_variant_get(x, f"$.{name}", "array<variant>"), nothing)
    said = F.size(F.filter(under(record, "assumptions"), lambda a: ~blank(_string(a, "statement"))))
    epics = under(record, "epics")
    levels = F.concat(F.array(record), epics, under(record, "feature_spec_inputs"), F.flatten(F.transform(epics, lambda e: F.concat(under(e, "features"), under(e, "feature_stubs")))))
    score = F.try_variant_get(record, "$.coverage_score", "string")
    own = own.withColumn("plan__levels", levels).withColumn("plan__said", said)
    cites = [Rule("cites", F.exists("plan__levels", _cites(n)), F.lit(n)) for n in CITING]
    return check(own, "plan__e", gate, [Rule("coverage_claimed", score.isNotNull(), score), *cites, Rule("too_few_assumptions", F.col("plan__said") < assumptions, F.col("plan__said"))])


def selection_findings(rows: DataFrame, entity: str, json: str, gate: str, mode: str = "scope") -> DataFrame:
    """The mode is the one that was asked for, and something is selected."""
    n = structure_counts(F.col(json))["features"]
    own = F.get_json_object(json, "$.mode")
    return check(rows, entity, gate, [Rule("other_mode", ~F.coalesce(own == mode, F.lit(False)), own), Rule("nothing_selected", F.coalesce(n, F.lit(0)) == 0)])


# Texts and selections.


def _text(x: Column, *names: str) -> Column:
    return F.concat_ws("\n", *(_string(x, n) for n in names))


def _string(x: Column, name: str) -> Column:
    v = F.try_variant_get(x, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def requirement_units(rows: DataFrame, entity: str, json: str) -> DataFrame:
    """entity, unit and text of all that states requirements: epics, their features or stubs, and the rationale."""
    own = staged(rows.select(entity, record_of(rows, json).alias("roadmap__r")))  # three branches read it
    epics = own.select(entity, F.posexplode(F.try_variant_get("roadmap__r", "$.epics", "array<variant>")).alias("place", "e"))
    named = lambda kind, x, key: F.concat(F.lit(f"{kind}:"), F.coalesce(_string(x, key), F.col("place").cast("string")))
    of_epics = epics.select(entity, named("epic", F.col("e"), "id").alias("unit"), _text(F.col("e"), "name", "bounded_context", "description").alias("text"))
    inner = F.coalesce(F.try_variant_get("e", "$.feature_stubs", "array<variant>"), F.try_variant_get("e", "$.features", "array<variant>"))
    features = epics.select(entity, F.posexplode(inner).alias("place", "f"))
    limits = F.array_join(F.filter(F.transform(F.try_variant_get("f", "$.constraints", "array<variant>"), lambda c: F.when(F.schema_of_variant(c) == "STRING", F.try_variant_get(c, "$", "string"))), lambda c: c.isNotNull()), "\n")
    parts = [F.nullif(_string(F.col("f"), n), F.lit("")) for n in ("title", "intent", "description", "bounded_context")]
    of_features = features.select(entity, named("feature", F.col("f"), "feature_id").alias("unit"), F.concat_ws("\n", *parts, F.nullif(limits, F.lit(""))).alias("text"))
    why = own.select(entity, F.lit("priority_rationale").alias("unit"), _string(F.col("roadmap__r"), "priority_rationale").alias("text")).where(~blank(F.col("text")))
    return union(of_epics, of_features, why)


def license_statements(rows: DataFrame, entity: str, json: str) -> DataFrame:
    """entity and text of each assumption's statement and of each open question."""
    own = rows.select(entity, record_of(rows, json).alias("roadmap__r"))
    said = own.select(entity, F.explode(F.try_variant_get("roadmap__r", "$.assumptions", "array<variant>")).alias("x")).select(entity, _string(F.col("x"), "statement").alias("text"))
    asked = own.select(entity, F.explode(F.try_variant_get("roadmap__r", "$.open_questions", "array<variant>")).alias("x")).select(entity, F.when(F.schema_of_variant("x") == "STRING", F.try_variant_get("x", "$", "string")).alias("text"))
    return said.unionAll(asked).where("text IS NOT NULL")


def selected_features(rows: DataFrame, entity: str, json: str) -> DataFrame:
    """entity, place, feature_id, title, bounded_context and depends_on of every feature in the epics, in their order."""
    epics = children_of(rows, entity, json, "epics")
    found = children_of(epics, entity, "json", "features", "place")
    x = F.col("json")
    needs = F.filter(F.transform(F.coalesce(F.try_variant_get(x, "$.depends_on", "array<variant>"), F.array().cast("array<variant>")), lambda d: F.when(F.schema_of_variant(d) == "STRING", F.try_variant_get(d, "$", "string"))), lambda d: d.isNotNull())
    out = found.select(entity, F.struct("place", "inner").alias("place"), _string(x, "feature_id").alias("feature_id"), F.coalesce(_string(x, "title"), F.lit("")).alias("title"), F.coalesce(_string(x, "bounded_context"), F.lit("")).alias("bounded_context"), needs.alias("depends_on"))
    return out.where("feature_id IS NOT NULL")


def children_of(rows: DataFrame, entity: str, json: str, field: str, *keys: str) -> DataFrame:
    """The elements of a list (json, as VARIANT) with their place in it."""
    inner = F.try_variant_get(record_of(rows, json), f"$.{field}", "array<variant>")
    return rows.select(entity, *keys, F.posexplode(inner).alias("inner" if keys else "place", "json"))


def reference_features(selected: DataFrame, entity: str) -> DataFrame:
    """One row for each feature id; of several the last counts."""
    return selected.groupBy(entity, "feature_id").agg(F.max_by(F.struct("title", "bounded_context", "depends_on"), "place").alias("f")).select(entity, "feature_id", "f.*")
