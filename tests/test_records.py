"""Contracts and gates of whole records: a right record has no findings, each change to it has the named one."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from sievework.functions import exprs, records
from sievework.operators import anchors, benchmarks, contracts, graphs, relations, roadmaps, specs, verdict_records, verdicts
from sievework.operators.anchors import Anchor
from sievework.sources import records as scans
from sievework.sources import sinks

CITATION = {"document": "d.md", "section_path": ["1"], "line_start": 2, "line_end": 2, "quote": "q"}
FEATURE = {
    "feature_id": "F-1",
    "title": "t",
    "bounded_context": "b",
    "description": "One. Two.",
    "source_documents": ["d.md"],
    "constraints": ["c"],
    "suggested_context_files": [],
    "depends_on": [],
    "priority": "High",
    "moscow": None,
    "field_citations": {"title": [CITATION]},
}
ASSUMPTION = {"id": "a", "category": "c", "statement": "s", "source": "x", "impact_if_wrong": "i", "confidence": "low"}
ROADMAP = {
    "project_name": "p",
    "priority_rationale": "why",
    "mode": "extract",
    "constraints_and_dependencies": [],
    "open_questions": ["q?"],
    "epics": [{"id": "E", "name": "n", "bounded_context": "b", "description": "d", "features": [FEATURE], "source_documents": ["d.md"]}],
    "feature_spec_inputs": [FEATURE],
    "source_documents": [{"filename": "d.md", "contribution": "all"}],
    "assumptions": [ASSUMPTION],
}
PLAN = {"project_name": "p", "epics": [{"epic_id": "E", "name": "n", "bounded_context": "b", "cited_docs": ["d.md"], "feature_stubs": [{"feature_id": "F-1", "title": "t", "intent": "i", "source_citations": [CITATION]}]}], "phase_a_completed_at": "2026-01-01T00:00:00Z"}
BATCH = {"project_name": "p", "epic_id": "E", "enrichments": [{"feature_id": "F-1", "description": "One. Two.", "source_documents": ["d.md"], "field_citations": {"x": [CITATION | {"quote": "q" * 300}]}}]}


def changed(record, path, value):
    """A copy with another value at a path of keys and places; ... takes it away."""
    out = json.loads(json.dumps(record))
    at = out
    for k in path[:-1]:
        at = at[k]
    if value is ...:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return out


def table_of(spark, *records_):
    return spark.createDataFrame([(i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records_)], "id int, json string")


def defects(found):
    return sorted({(r["defect"], r["entity_id"]) for r in found.collect()})


E, F0 = ("epics", 0), ("epics", 0, "features", 0)
CASES = [
    (roadmaps.roadmap_findings, ROADMAP, ("mode",), "other", "not_in_domain"),
    (roadmaps.roadmap_findings, ROADMAP, ("project_name",), ..., "missing_key"),
    (roadmaps.roadmap_findings, ROADMAP, ("open_questions",), [1], "wrong_type"),
    (roadmaps.roadmap_findings, ROADMAP, ("epics",), [], "below_least"),
    (roadmaps.roadmap_findings, ROADMAP, (*F0, "description"), "Only one.", "too_few_sentences"),
    (roadmaps.roadmap_findings, ROADMAP, (*F0, "constraints"), [None], "wrong_type"),
    (roadmaps.roadmap_findings, ROADMAP, (*F0, "priority"), "Urgent", "not_in_domain"),
    (roadmaps.roadmap_findings, ROADMAP, (*F0, "field_citations"), None, "wrong_type"),
    (roadmaps.roadmap_findings, ROADMAP, (*F0, "field_citations", "title"), "x", "not_a_list"),
    (roadmaps.roadmap_findings, ROADMAP, (*F0, "field_citations", "title", 0, "quote"), "q" * 201, "above_most"),
    (roadmaps.roadmap_findings, ROADMAP, (*F0, "field_citations", "title", 0, "line_end"), 1, "lines_out_of_order"),
    (roadmaps.roadmap_findings, ROADMAP, (*F0, "field_citations", "title", 0, "section_path"), [], "below_least"),
    (roadmaps.roadmap_findings, ROADMAP, (*F0, "field_citations", "title", 0), None, "not_object"),
    (roadmaps.roadmap_findings, ROADMAP, (*F0, "feature_id"), "F-2", "not_the_same"),
    (roadmaps.roadmap_findings, ROADMAP, (*E, "features"), [], "below_least"),
    (roadmaps.roadmap_findings, ROADMAP, ("source_documents", 0, "contribution"), " ", "blank"),
    (roadmaps.roadmap_findings, ROADMAP, ("assumptions", 0, "confidence"), "sure", "not_in_domain"),
    (roadmaps.roadmap_findings, ROADMAP, ("coverage_score",), "5", "wrong_type"),
    (roadmaps.plan_findings, PLAN, ("mode",), "idea", "not_in_domain"),
    (roadmaps.plan_findings, PLAN, ("mode",), None, "wrong_type"),
    (roadmaps.plan_findings, PLAN, ("phase_a_completed_at",), "yesterday", "not_a_timestamp"),
    (roadmaps.plan_findings, PLAN, (*E, "cited_docs"), [], "below_least"),
    (roadmaps.plan_findings, PLAN, (*E, "feature_stubs", 0, "priority"), "High", "unknown_key"),
    (roadmaps.plan_findings, PLAN, (*E, "feature_stubs", 0, "intent"), "i" * 101, "above_most"),
    (roadmaps.plan_findings, PLAN, (*E, "feature_stubs"), [PLAN["epics"][0]["feature_stubs"][0]] * 2, "duplicate_feature"),
    (roadmaps.batch_findings, BATCH, ("enrichments", 0, "title"), "t", "forbidden_key"),
    (roadmaps.batch_findings, BATCH, ("enrichments", 0, "source_documents"), [], "below_least"),
    (roadmaps.batch_findings, BATCH, ("enrichments", 0, "type"), None, "wrong_type"),
    (roadmaps.batch_findings, BATCH, ("enrichments",), [], "below_least"),
    (roadmaps.batch_findings, BATCH, ("enrichments",), BATCH["enrichments"] * 2, "duplicate_feature"),
]


@pytest.mark.parametrize("contract", [roadmaps.roadmap_findings, roadmaps.plan_findings, roadmaps.batch_findings])
def test_contracts(spark, contract):
    own = [c for c in CASES if c[0] is contract]
    right = own[0][1]
    accepted = [right, right | {"phase_a_completed_at": 5}] if contract is roadmaps.plan_findings else [right]
    rows = table_of(spark, *accepted, *(changed(r, p, v) for _, r, p, v, _ in own), "[]")
    found = {}
    for d, e in defects(contract(rows, "id", "json")):
        found.setdefault(int(e.split(".")[0]), set()).add(d)
    n = len(accepted)
    assert not set(found) & set(range(n))
    for k, (*_, path, _, defect) in enumerate(own):
        assert defect in found[n + k] and len(found[n + k]) <= 2, (path, defect, found.get(n + k))
    assert found[n + len(own)] == {"not_object"}


def test_enrichments_against_stubs(spark):
    rich = json.dumps({"priority": 0, "moscow": "Must", "role": False})
    own = spark.createDataFrame([("a", "1", rich), ("a", "9", "{}"), ("b", "2", "{}"), ("b", "3", json.dumps({"priority": "", "value": []}))], "batch string, feature_id string, json string")
    stubs = spark.createDataFrame([("a", "1"), ("b", "2"), ("b", "3"), ("c", "4")], "batch string, feature_id string")
    found = {(r["entity_id"], r["defect"], r["detail"]) for r in roadmaps.batch_against_stubs(own, stubs).collect()}
    assert found == {("a", "not_in_stubs", "9"), ("c", "stub_not_enriched", "4"), ("b", "all_thin", "")}


def test_structure_and_emptiness(spark):
    rows = table_of(spark, {"epics": [{"features": [1, 2]}, {"feature_stubs": [1], "features": [1, 2, 3]}, 5]}, {"epics": []}, {})
    assert [tuple(r[0]) for r in rows.orderBy("id").select(roadmaps.structure_counts(F.col("json"))).collect()] == [(3, 3), (0, 0), (0, 0)]
    assert {d for d, e in defects(roadmaps.structure_floors(rows, "id", "json", "g", epics=1, features=3)) if e == 0} == set()
    good = {"coverage_score": None, "epics": [{"source_documents": []}], "assumptions": [{"statement": "x"}] * 3}
    found = defects(roadmaps.nothing_claimed(table_of(spark, good, good | {"coverage_score": 0.5}, good | {"cited_docs": ["a"]}, good | {"assumptions": [{"statement": " "}] * 5}), "id", "json", "g"))
    assert found == [("cites", 2), ("coverage_claimed", 1), ("too_few_assumptions", 3)]
    chosen = table_of(spark, {"mode": "scope", "epics": [{"features": [1]}]}, {"mode": "idea", "epics": []})
    assert defects(roadmaps.selection_findings(chosen, "id", "json", "g")) == [("nothing_selected", 1), ("other_mode", 1)]


def test_units_and_selection(spark):
    record = {
        "epics": [{"id": "E", "name": "n", "bounded_context": None, "description": "d", "features": [{"feature_id": "F", "title": "t", "description": "", "constraints": ["a", 5, "b"], "depends_on": ["G", 1]}, {"title": "x"}, {"feature_id": "F", "title": "last"}]}, {"name": "only"}],
        "priority_rationale": " ",
        "assumptions": [{"statement": "we assume"}, {"statement": 5}, "x"],
        "open_questions": ["who?", None],
    }
    rows = table_of(spark, record)
    units = {r["unit"]: r["text"] for r in roadmaps.requirement_units(rows, "id", "json").collect()}
    assert units["epic:E"] == "n\nd" and units["epic:1"] == "only" and units["feature:1"] == "x" and "priority_rationale" not in units
    assert sorted(r["text"] for r in roadmaps.license_statements(rows, "id", "json").collect()) == ["we assume", "who?"]
    chosen = roadmaps.selected_features(rows, "id", "json")
    assert sorted((r["feature_id"], r["title"], r["depends_on"]) for r in chosen.collect()) == [("F", "last", []), ("F", "t", ["G"])]
    assert [(r["title"]) for r in roadmaps.reference_features(chosen, "id").collect()] == ["last"]


def test_verdicts_and_reviews(spark):
    one = {"class": "DC-03", "locus": "l"}
    cases = [
        ({"verdict": "approve", "findings": []}, None),
        ({"verdict": "reject", "findings": [one], "more": 1}, None),
        ({"verdict": "reject", "findings": []}, "reject_without_findings"),
        ({"verdict": "approve", "findings": [one]}, "approve_with_findings"),
        ({"verdict": "REJECT", "findings": [one]}, "verdict_enum"),
        ({"verdict": "reject", "findings": {}}, "findings_shape"),
        ({"verdict": "reject"}, "findings_shape"),
        ({"verdict": "reject", "findings": ["x"]}, "finding_shape"),
        ({"verdict": "reject", "findings": [one | {"class": "other"}]}, "class_enum"),
        ({"verdict": "reject", "findings": [one | {"locus": " "}]}, "finding_locus"),
        ({"verdict": "reject", "findings": [one | {"locus": None}]}, "finding_locus"),
        ("[]", "unloadable"),
    ]
    found = defects(verdict_records.verdict_findings(table_of(spark, *(c for c, _ in cases)), "id", "json", "g"))
    assert found == sorted((d, i) for i, (_, d) in enumerate(cases) if d)
    lost = spark.createDataFrame([(1, None, "missing")], "id int, json string, load_error string")
    assert defects(verdict_records.verdict_findings(lost, "id", "json", "g", load_error="load_error")) == [("unloadable", 1)]
    good = {"pattern": "PHANTOM", "target": "t", "evidence": "e"}
    rows = table_of(spark, {"verdict": "revise", "findings": [good]}, {"verdict": "revise", "findings": [good | {"evidence": ""}, good | {"pattern": "X"}]})
    assert defects(verdict_records.verdict_findings(rows, "id", "json", "g", verdict_records.REVIEW)) == [("finding_evidence", 1), ("pattern_enum", 1)]
    text = table_of(spark, {"findings": [one, "x", {"class": "c"}]}).select(verdict_records.found_text(F.col("json")).alias("t"), verdict_records.found_classes(F.col("json")).alias("c")).first()
    assert tuple(text) == ("DC-03\nl\nc\n", ["DC-03", "c"])


def test_bundles_and_checkers(spark):
    rows = spark.createDataFrame([("a", json.dumps({"bundle_id": "a", "task": None, "tests": None, "x": 1})), ("b", json.dumps({"bundle_id": "a", "tests": 1}))], "dir string, json string")
    found = {(r["entity_id"], r["defect"], r["detail"]) for r in verdict_records.bundle_findings(rows, "dir", "json", "g", ("bundle_id", "task"), ("tests",), ("y",)).collect()}
    assert found == {("a", "unknown_field", "x"), ("b", "id_missing", "task"), ("b", "other_id", "a")}
    clean = {"ok": True, "errorCount": 0, "diagnostics": [{"severity": "warning"}]}
    bad = {"ok": False, "errorCount": 1, "diagnostics": [{"severity": "error"}]}
    rows = spark.createDataFrame([(0, json.dumps(clean), 0), (1, json.dumps(bad), 1), (2, json.dumps(clean), 1), (3, "{}", 0)], "id int, json string, code int")
    assert defects(verdict_records.compile_findings(rows, "id", "json", "code", "g")) == [("errors", 1), ("errors", 3), ("exit_code", 1), ("exit_code", 2), ("not_ok", 1), ("not_ok", 3)]
    assert defects(verdict_records.wrongly_accepted(rows, "id", "json", "code", "g")) == [("accepted", 0), ("accepted", 2), ("accepted", 3), ("exit_code", 0), ("exit_code", 3), ("no_errors", 0), ("no_errors", 2), ("no_errors", 3)]
    assert [r[0] for r in rows.orderBy("id").select(verdict_records.envelope_clean(F.col("json"))).collect()] == [True, False, True, False]
    assert rows.where("id = 1").select(F.size(verdict_records.errors_of(F.col("json")))).first()[0] == 1
    slots = [({"running": [{"model": "m", "state": "ready"}]}, True), ([{"alias": "m", "status": "ready"}], True), ({"m": "ready"}, True), ({"m": "loading"}, False), ({"data": [{"id": "x", "state": "ready"}]}, False), ("{", False)]
    got = table_of(spark, *(s for s, _ in slots)).orderBy("id").select(verdict_records.slot_ready(F.col("json"), F.lit("m"))).collect()
    assert [r[0] for r in got] == [x for _, x in slots]


SPEC = """# Generated by tool
# Feature: f
# Stack: none
# Assumptions: 2
# Generated: 2026-01-01T00:00:00Z
Feature: booking
  As a user
  I want x
  So that y

  Background:
    Given a base

  # Why: it matters
  # [ASSUMPTION: confidence=low]
  @key-example @smoke
  @task:T-1
  Scenario: first
    Given a
    Then b

  @boundary
  Scenario Outline: second
    # [ASSUMPTION: confidence=sure]
    Given SELECT 1
    Examples:
      | a |
"""


def test_scenarios(spark):
    texts = spark.createDataFrame([("k", SPEC)], "key string, text string")
    found = specs.scenarios(texts, "key", "text").orderBy("place")
    rows = found.collect()
    assert [(r["scenario"], r["tags"], r["steps"]) for r in rows] == [("first", ["@key-example", "@smoke", "@task:T-1"], ["Given a", "Then b"]), ("second", ["@boundary"], ["Given SELECT 1"])]
    assert rows[0]["comments"] == ["# Why: it matters", "# [ASSUMPTION: confidence=low]"]
    assert [r["n"] for r in specs.tag_count(found, "key", "@smoke").collect()] == [1]
    tags = specs.task_tags(found, "key")
    assert {r["scenario"]: r["tasks"] for r in tags.collect()} == {"first": ["T-1"], "second": []}
    units = {r["unit"]: r["text"] for r in specs.requirement_units(texts, "key", "text").collect()}
    assert set(units) == {"feature", "background", "scenario:first", "scenario:second"} and "Why" not in str(units) and units["scenario:first"] == "first\nGiven a\nThen b"
    assert [(r["scenario"], r["matched"]) for r in specs.banned_language(found, "key", [Anchor("sql", 1, "SELECT")]).collect()] == [("second", "SELECT")]
    head = texts.select(specs.header_block(F.col("text")).alias("h")).first()["h"]
    assert (head["generated_by"], head["feature"], head["stack"], head["assumptions"], head["generated"]) == ("Generated by tool", "f", "none", "2", "2026-01-01T00:00:00Z")
    assert {d for d, _ in defects(specs.category_findings(found, "key", least=2))} == {"category_missing", "why_missing"}
    assert {d for d, _ in defects(specs.structure_findings(found, texts, "key", "text"))} == {"no_then"}
    bom = spark.createDataFrame([("k", "﻿" + SPEC.replace("I want", "I like"))], "key string, text string")
    assert {d for d, _ in defects(specs.structure_findings(found, bom, "key", "text"))} == {"no_then", "byte_order_mark", "story_line_missing"}
    entries = spark.createDataFrame([("k", 1, "ASSUM-001", "first"), ("k", 2, "ASSUM-002", "second"), ("k", 3, "ASSUM-003", "other")], "key string, place int, id string, scenario string")
    assert {d for d, _ in defects(specs.annotation_findings(found, entries, "key"))} == {"annotation_confidence_enum"}
    bare = specs.scenarios(spark.createDataFrame([("k", "Feature: f\n Scenario: first\n  Given a\n")], "key string, text string"), "key", "text")
    assert [(r["defect"], r["detail"]) for r in specs.annotation_findings(bare, entries, "key").collect()] == [("annotation_missing", "ASSUM-001")]
    note = spark.createDataFrame([("k", "a\n  # Implementation: x.py\n# implementation\n")], "key string, text string")
    assert [r["line_no"] for r in specs.implementation_comments(note, "key", "text").collect()] == [2]
    tasks = spark.createDataFrame([("k", "T-1", "feature"), ("k", "T-2", "feature"), ("k", "T-3", "docs")], "key string, task string, task_type string")
    assert defects(specs.linkage_findings(tags, tasks, "key")) == [("feature_task_owns_no_scenario", "k")]
    assert {d for d, _ in defects(specs.linkage_findings(tags, tasks.where("task <> 'T-1'"), "key"))} == {"dangling_task_tag", "feature_task_owns_no_scenario"}
    none = tags.withColumn("tasks", F.array().cast("array<string>"))
    assert {d for d, _ in defects(specs.linkage_findings(none, tasks.where("task = 'T-3'"), "key"))} == {"no_scenarios_linked", "smoke_scenario_unlinked"}


def test_manifests_and_summaries(spark):
    fields = "key string, place int, id string, scenario string, assumption string, confidence string, basis string, human_response string"
    good = [("k", 1, "ASSUM-001", "s", "a", "low", "b", "deferred"), ("k", 2, "ASSUM-002", "s", "a", "low", "b", "deferred")]
    bad = [("m", 1, "ASSUM-002", "s", "a", "sure", "b", "no"), ("m", 2, "ASSUM-002", "x", " ", "low", "b", "overridden: y")]
    heads = spark.createDataFrame([("k", "f", "g", "s", True), ("m", "f", None, "s", None)], "key string, feature string, generated string, stack string, review_required boolean")
    names = spark.createDataFrame([("k", "s"), ("m", "s")], "key string, scenario string")
    entries = spark.createDataFrame(good + bad, fields)
    found = defects(specs.manifest_findings(heads, entries, "key", names))
    assert {e for _, e in found} == {"m"} and {d for d, _ in found} == {"top_level_field", "entry_field", "id_not_sequential", "confidence_enum", "human_response_enum", "scenario_not_in_feature"}
    assert defects(specs.automatic_findings(heads, entries, "key")) == [("not_all_deferred", "m"), ("not_all_low", "m"), ("review_not_required", "m")]
    scenarios = spark.createDataFrame([("k", ["@smoke", "@boundary"]), ("k", ["@regression"])], "key string, tags array<string>")
    text = "**Stack**: x\n**Scenarios**: 2 total (1 smoke, 1 regression)\n**Assumptions**: 2 total (0 high / 0 medium / 2 low)\n**Review required**: Yes\n"
    rows = "| Key examples (@key-example) | 0 |\n| Boundary conditions (@boundary) | 1 |\n| Negative cases (@negative) | 0 |\n| Edge cases (@edge-case) | 0 |\n"
    claim = lambda t: spark.createDataFrame([("k", t)], "key string, text string")
    assert defects(specs.summary_findings(claim(text + rows), scenarios, entries.where("key = 'k'"), "key", "text")) == []
    wrong = text.replace("2 total (1", "3 total (1").replace("2 low", "1 low") + rows.replace("(@boundary) | 1", "(@boundary) | 2")
    assert [d for d, _ in defects(specs.summary_findings(claim(wrong), scenarios, entries.where("key = 'k'"), "key", "text"))] == ["assumptions", "categories", "scenarios"]
    parsed = claim(text).select(specs.parsed_summary(F.col("text")).alias("s")).first()["s"]
    assert (parsed["stack"], parsed["review_required"], parsed["scenarios"], parsed["generated"]) == ("x", "Yes", [2, 1, 1], None)
    headers = spark.createDataFrame([("k", "f", "2 in all", "2026-01-01T00:00:00Z")], "key string, feature string, assumptions string, generated string")
    manifest = heads.withColumn("generated", F.lit("2026-01-01T00:00:00Z"))
    assert defects(specs.header_findings(headers, manifest, entries, "key")) == []
    assert {d for d, _ in defects(specs.header_findings(headers, heads.withColumn("feature", F.lit("z")), entries.where("key = 'm'"), "key"))} == {"feature", "assumptions", "generated"}


def test_plans(spark):
    tasks = spark.createDataFrame([("k", t, f"{t}.md") for t in "abcd"], "key string, task string, file_path string")
    front = lambda **x: json.dumps({"id": "a", "task_type": "feature", "feature_id": "P", "wave": 1} | x)
    fronts = spark.createDataFrame([("k", "a.md", front()), ("k", "b.md", front(id="b", task_type="odd", feature_id="Q")), ("k", "c.md", None)], "key string, file_path string, json string")
    waves = spark.createDataFrame([("k", 1, ["a", "c"]), ("k", 2, ["b", "a"])], "key string, place int, wave array<string>")
    plans = spark.createDataFrame([("k", "P")], "key string, plan_id string")
    assert {r["task"]: r["wave"] for r in specs.wave_of(waves, "key").collect()} == {"a": 1, "b": 2, "c": 1}
    found = defects(specs.frontmatter_findings(tasks, fronts, waves, plans, "key", ("feature", "docs")))
    assert found == [("feature_id_mismatch", "b"), ("frontmatter_unparseable", "c"), ("task_file_missing", "d"), ("task_type_invalid", "b"), ("wave_mismatch", "b")]
    modes = spark.createDataFrame([("a", 4, "direct"), ("b", 3, "direct"), ("c", None, None), ("d", 2, None)], "task string, complexity int, implementation_mode string")
    assert defects(specs.mode_findings(modes)) == [("mode_assignment", "a"), ("mode_assignment", "d")]
    floors = spark.createDataFrame([("k", 2, 1, True, None, ["x"]), ("m", 3, 2, True, True, [])], "key string, n_tasks int, n_waves int, has_diagram boolean, has_lint boolean, files_missing array<string>")
    assert [d for d, e in defects(specs.plan_floors(floors, "key")) if e == "k"] == ["file_missing", "no_lint_criterion", "too_few_tasks", "too_few_waves"] and all(e == "k" for _, e in defects(specs.plan_floors(floors, "key")))
    was = spark.createDataFrame([("k", "@a\nScenario: s\n"), ("m", "x\n"), ("n", "y")], "key string, text string")
    now = spark.createDataFrame([("k", "@a\n  @task:T-1\nScenario: s\n"), ("m", "x \n")], "key string, text string")
    assert defects(specs.preserved(was, now, "key", "text")) == [("changed", "m"), ("missing", "n")]
    files = [("k", "features/s/s.feature"), ("k", "features/s/s.md"), ("m", "features/s/s.feature"), ("m", "features/s/x"), ("m", "features/s/deep/y"), ("n", "other")]
    found = defects(specs.layout_findings(spark.createDataFrame(files, "root string, path string"), "root", "path", (".feature", ".md")))
    assert found == [("layout", "n"), ("missing_file", "m"), ("unexpected_file", "m")]


def test_benchmark_rows(spark):
    fields = "benchmark string, prompt string, canonical_solution string, test string, entry_point string, code string, test_setup_code string, test_list array<string>"
    rows = spark.createDataFrame([("humaneval", "def f():\n", "    return 1\n", "def check(c): pass", "f", None, None, None), ("mbpp", None, None, None, None, "x = 1", "import a", ["assert x", "assert 1"])], fields)
    kind = F.col("benchmark")
    got = {r["benchmark"]: r["s"] for r in rows.select(kind, benchmarks.execution_script(kind, benchmarks.reference_program(kind)).alias("s")).collect()}
    assert got == {"humaneval": "def f():\n    return 1\n\ndef check(c): pass\n\ncheck(f)\n", "mbpp": "x = 1\n\nimport a\nassert x\nassert 1\n"}
    assert rows.limit(1).select(benchmarks.filled("a {x} b {y} {x}{z}", x=F.lit("{y}"), y=F.lit(2)).alias("t")).first()["t"] == "a {y} b 2 {y}{z}"
    files = spark.createDataFrame([("k", "b", "2"), ("k", "a", "1")], "k string, name string, text string")
    assert [r["blocks"] for r in benchmarks.file_blocks(files, "k", "name", "text", "[{name}] {text}").collect()] == ["[a] 1\n\n[b] 2"]
    order = spark.createDataFrame([("X/10",), ("X/9",), ("X",)], "id string").orderBy(benchmarks.task_number(F.col("id")).asc_nulls_last())
    assert [r["id"] for r in order.collect()] == ["X/9", "X/10", "X"]
    rows = spark.createDataFrame([("g", 1, True), ("g", 2, False), ("g", 3, True), ("g", 4, True), ("h", 1, True)], "g string, n int, ok boolean")
    pinned = benchmarks.pinned_subset(rows, ["g"], [F.col("n")], F.col("ok"), 2)
    assert sorted((r["g"], r["n"], r["status"]) for r in pinned.collect()) == [("g", 1, "kept"), ("g", 2, "excluded"), ("g", 3, "kept"), ("h", 1, "short")]
    pins = benchmarks.with_pins(spark.createDataFrame([("x",)], "c string"), "c").first()["sha256"]
    assert pins == "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"
    nested = spark.createDataFrame([(json.dumps({"fam": {"t1": {"baseline_solved": 20}}}),)], "j string")
    assert [tuple(r) for r in benchmarks.baselines(nested, "j").collect()] == [("fam", "t1", 20)]


def test_floors_and_repetitions(spark):
    grades = spark.createDataFrame([(run, "t", i, "pass" if i < n else "fail") for run, n in (("oracle", 4), ("o2", 5), ("good", 3), ("bad", 2), ("new", 5)) for i in range(5)], "run string, task string, row_id int, status string")
    candidates = spark.createDataFrame([("oracle", "x", True), ("o2", "x", True), ("good", "f", None), ("bad", "f", False), ("new", "z", None)], "run string, family string, oracle boolean")
    known = spark.createDataFrame([("f", "t", 5)], "family string, task string, baseline int")
    found = {(r["entity_id"], r["defect"], r["detail"]) for r in benchmarks.floor_findings(grades, candidates, known).collect()}
    assert found == {("oracle", "oracle_not_total", "t:4"), ("bad", "below_floor", "t:2,3,4"), ("new", "no_baseline", "t")}
    seen, tasks = spark.createDataFrame([("a", 1), ("a", 2), ("a", 4), ("b", 1)], "task string, rep int"), spark.createDataFrame([("a",), ("b",)], "task string")
    got = {(r["task"], r["rep"], r["defect"]) for r in benchmarks.repetition_findings(seen, tasks, 2).collect()}
    assert got == {("a", 4, "extra"), ("b", 2, "missing")}
    folders = spark.createDataFrame([("a", '{"suite": "gc"}', False), ("b", '{"suite": "x"}', False), ("c", "{", None), ("d", None, True)], "folder string, config string, has_verdicts boolean")
    assert defects(benchmarks.output_findings(folders, "gc")) == [("records_of_another_suite", "b"), ("records_of_another_suite", "c"), ("verdicts_of_another_suite", "d")]
    arms = spark.createDataFrame([("off", None), ("fixture:a", None), ("on", "b")], "arm string, fixture string")
    assert [r[0] for r in arms.select(benchmarks.retrieval_arm(F.col("arm"), F.col("fixture"))).collect()] == ["off", "fixture:a", "fixture:b"]
    with pytest.raises(Exception, match="fixture"):
        arms.select(benchmarks.retrieval_arm(F.lit("on"), F.lit(None).cast("string"))).collect()
    notes = spark.createDataFrame([("k", 2, "[b] [a]"), ("k", 1, "[a] [c]")], "k string, n int, t string")
    assert [r["names"] for r in benchmarks.first_appearances(notes, "k", "n", "t", r"\[(\w)\]").collect()] == [["a", "c", "b"]]
    board = spark.createDataFrame([("1", "done", None), ("2", "todo", None), ("3", None, "bad"), ("4", "other", None)], "id string, status string, error string")
    assert [r["id"] for r in benchmarks.by_board_order(board, ("todo", "done"), "status", "id", "error").collect()] == ["2", "1", "4", "3"]


def test_suites_as_data(spark):
    rules = verdicts.suite_rules(spark)
    assert {r["suite"] for r in rules.collect()} == {"po", "po-idea", "po-spec", "arch", "coach", "qav", "gc", "dcl"}
    full = rules.select("suite", "gate", F.explode(F.sequence(F.lit(1), "of")).alias("k")).withColumn("passed", F.lit(True))
    assert {r["verdict"] for r in verdicts.suite_verdict(verdicts.gate_outcomes(full, rules), "suite").collect()} == {"PASS"}
    found = spark.createDataFrame([(1, "a"), (2, "a"), (1, "a"), (3, "b")], "entity_id int, gate string")
    assert {(r["gate"], r["n_failed"], r["failed"], r["disposition"]) for r in verdicts.failure_report(found, {"a": "x"}, "y").collect()} == {("a", 2, "1,2", "x"), ("b", 1, "3", "y")}


def test_responses_and_programs(spark):
    rows = spark.createDataFrame([("c", "why"), ("<think>own</think>c", "why"), ("a\n```\n<think>\n```", "why"), ("c", ""), ("c", None), (None, "why")], "c string, r string")
    got = [r[0] for r in rows.select(records.response_text(F.col("c"), F.col("r"))).collect()]
    assert got == ["<think>why</think>\nc", "<think>own</think>c", "<think>why</think>\na\n```\n<think>\n```", "c", "c", "<think>why</think>\n"]
    assert records.response_payload('[1]\n```json\n{"a": 1}\n```')["state"] == "ok"
    assert records.response_payload('[1]\n```json\n[2]\n```')["state"] == "not_object"
    assert records.split_thinking("</think>x")[0] == "no_think_block" and records.split_thinking("</think><think>")[0] == "think_block_out_of_order"
    assert records.split_thinking("<think>a</think>b<think>c</think>")[0] == "several_think_blocks" and records.split_thinking("x<think>a</think>y") == ("ok", "a", "xy")
    assert records.program_of("```py\nx\n```") == "x\n" and records.program_of(" ") is None
    assert records.balanced_object('a {x} {"b": {"c": "}"}} d') == "{x}" and records.balanced_object('a {"b": {"c": "}"}} d {x}') == '{"b": {"c": "}"}}'
    text = "a ```json\n{1}\n``` ```dcl\nb // c\n```"
    row = spark.createDataFrame([(text, "line\n@t\nlast")], "t string, u string").select(
        exprs.first_fence(F.col("t")), exprs.blocks_of(F.col("t"), "dcl"), exprs.without_comments(F.lit("a // b")), exprs.missing_parts(F.col("t"), ["json", "zz"]), exprs.lines_without(F.col("u"), "^@"), exprs.tail(F.lit("abc"), 2),
        exprs.family_key(F.lit("b"), F.lit("q")), exprs.task_type(F.lit("x"), {"x": "y"}), exprs.task_type(F.lit(None).cast("string"), {"x": "y"}), exprs.populated_fields(F.lit(0), F.lit(""), F.lit(None).cast("string")),
        exprs.header_field(F.lit("A: 1\nA: 2"), "^A: (.*)$"), exprs.header_field(F.lit("A: 1\nA: 2"), "^A: (.*)$", last=True), exprs.header_field(F.lit("x"), "^A: (.*)$"), exprs.content_of(F.lit('{"choices": [{"message": {"content": "c"}, "finish_reason": "stop"}]}')), exprs.finish_of(F.lit('{"choices": [{"finish_reason": "stop"}]}')),
        exprs.first_present(F.lit('{"a": 1, "b": 2}'), "b"), exprs.first_present(F.lit('{"a": 1}'), "b"), exprs.keys_among(F.lit('{"a": 1}'), ["a", "z"]), exprs.redacted_query(F.lit("u?x=1")), exprs.null_unless_any(F.lit(None).cast("int").alias("x")),
    ).first()
    assert list(row) == ["{1}", ["b // c\n"], "a ", ["zz"], "line\nlast", "bc", "b/q", "y", "feature", 1, "1", "2", None, "c", "stop", "2", "1", ["a"], "u?<redacted>", None]


def test_scans(spark, tmp_path):
    for d, files in (("b", {"bundle.json": "{}"}), ("a", {"bundle.json": "{}"}), ("c", {"x.txt": ""})):
        (tmp_path / d).mkdir()
        for name, text in files.items():
            (tmp_path / d / name).write_text(text)
    (tmp_path / "empty").mkdir()
    assert scans.folders_with(spark, str(tmp_path), "bundle.json") == ["a", "b"]
    state = {r["name"]: r["complete"] for r in scans.folders(spark, str(tmp_path), "bundle.json").collect()}
    assert state == {"a": True, "b": True, "c": False, "empty": False}
    assert scans.required_text(spark, f"{tmp_path}/a/bundle.json") == "{}"
    for missing in (f"{tmp_path}/a/none.txt", f"{tmp_path}/c/x.txt"):
        with pytest.raises(FileNotFoundError):
            scans.required_text(spark, missing)
    (tmp_path / "t.toml").write_text('[task]\nid = "x"\nreps = 3\nok = true\n[other]\ny = 1\n')
    (tmp_path / "u.toml").write_text("= broken")
    texts = scans.texts(spark, f"{tmp_path}/*.toml", r"(\w+)\.toml$", "key")
    got = {r["key"]: (r["id"], r["reps"], r["ok"]) for r in scans.tables_of_toml(texts, "key", "id string, reps int, ok boolean", ("task",)).collect()}
    assert got == {"t": ("x", 3, True), "u": (None, None, None)}
    with gzip.open(tmp_path / "rows.jsonl.gz", "wt") as f:
        f.write('{"task_id": "X/1"}\n\n{"task_id": "X/2"}\n')
    assert [json.loads(r["json"])["task_id"] for r in scans.json_lines(spark, f"{tmp_path}/rows.jsonl.gz").collect()] == ["X/1", "X/2"]
    (tmp_path / "manifest.json").write_text(json.dumps({"rows": [{"row_id": "r1", "sha256": "s"}, {"row_id": "r2", "sha256": "t"}, {"row_id": "r1", "sha256": "u"}]}))
    rows = scans.rows_of(scans.texts(spark, f"{tmp_path}/manifest.json", r"(\w+)\.json$", "key"), "row_id string, sha256 string", "key")
    assert [(r["position"], r["row_id"]) for r in rows.orderBy("position").collect()] == [(1, "r1"), (2, "r2"), (3, "r1")]
    assert {(r["row_id"], r["sha256"]) for r in scans.registry(rows, "row_id").collect()} == {("r1", "u"), ("r2", "t")}
    (tmp_path / "anchors.json").write_text(json.dumps({"groups": [{"id": "g", "alternates": ["a", "b"]}, {"id": "h", "alternates": ["c"]}]}))
    assert scans.anchors_of(spark, f"{tmp_path}/anchors.json") == [Anchor("g", 1, "a"), Anchor("g", 2, "b"), Anchor("h", 1, "c")]
    (tmp_path / "run-1" / "rep-2" / "task-x" / "verdicts").mkdir(parents=True)
    (tmp_path / "run-1" / "rep-2" / "task-x" / "verdicts" / "B-1.json").write_text("{}")
    recorded = scans.recorded_runs(spark, f"{tmp_path}/run-*", "verdicts").collect()
    assert [(r["run"], r["rep"], r["task"], r["name"]) for r in recorded] == [("run-1", 2, "task-x", "B-1")]
    expected = spark.createDataFrame([("r1",), ("r9",)], "row_id string")
    both = scans.with_optional(expected, rows.select("row_id", F.col("sha256").alias("value")).dropDuplicates(["row_id"]), "row_id")
    assert {r["row_id"]: r["value"] is None for r in both.collect()} == {"r1": False, "r9": True}


def test_pinned_rows_are_written(spark, tmp_path):
    rows = spark.createDataFrame([("a", "r1", '{"b": 1, "a": 2}'), ("b", "r2", "{}")], "task string, row_id string, json string")
    pinned = sinks.write_pinned(rows, "json", f"{tmp_path}/out", "task")
    assert {r["task"]: r["row_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {"a": "r1", "b": "r2"}
    assert pinned.where("row_id = 'r1'").first()["sha256"] == __import__("hashlib").sha256(b'{\n  "a": 2,\n  "b": 1\n}\n').hexdigest()
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_pinned(rows, "json", f"{tmp_path}/out", "task")


def test_leaks_and_instruments(spark):
    files = spark.createDataFrame([("a", "all GOOD"), ("b", "has SECRET mark")], "path string, text string")
    assert [r["path"] for r in anchors.leaks(files, "text", "SECRET").collect()] == ["b"]
    own = [Anchor("g", 1, "GOOD"), Anchor("h", 1, "none")]
    assert [(r["path"], r["group_id"]) for r in anchors.matches(files, "text", own).collect()] == [("a", "g")]
    golds = spark.createDataFrame([("a", '{"x": 1, "y": [1, 2]}'), ("b", '{"x": 1}'), ("d", "{}")], "k string, json string")
    built = spark.createDataFrame([("a", '{"y": [1, 2], "x": 1}'), ("b", '{"x": 2, "z": null}'), ("c", "{}")], "k string, json string")
    found = {(r["k"], r["field"], r["defect"]) for r in relations.record_differences(golds, built, "k", "json").collect()}
    assert found == {("b", "x", "differs"), ("b", "z", "unexpected"), ("c", None, "unexpected"), ("d", None, "missing")}
    clean, poisoned = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20)))], "id int, text string"), spark.createDataFrame([(1, "x " + " ".join(f"v{i}" for i in range(9)) + " y")], "id int, text string")
    held = spark.createDataFrame([(7, " ".join(f"v{i}" for i in range(12)))], "item int, text string")
    gate = lambda docs: relations.shared_shingles(docs, held, "id", "item", "text", 8).collect()
    assert not gate(clean) and [(r["id"], r["n_shared"]) for r in gate(poisoned)] == [(1, 2)]
    verdict = relations.contamination_verdict(clean, held, [poisoned], "id", "item", "text", 8)
    assert verdict == "clean" and relations.contamination_verdict(poisoned, held, [poisoned], "id", "item", "text", 8) == "contaminated"
    assert relations.contamination_verdict(clean, held, [clean], "id", "item", "text", 8) == "blocked"
    names = spark.createDataFrame([("a.md", "A"), ("b.md", "B")], "name string, text string")
    cited = spark.createDataFrame([("b.md",), ("z.md",)], "name string")
    there, lost = relations.cited_subset(names, cited, "name")
    assert [r["text"] for r in there.collect()] == ["B"] and [r["name"] for r in lost.collect()] == ["z.md"]


def test_helper_names_do_not_clash(spark):
    rows = table_of(spark, {"id": "a"}).withColumn("_v", F.lit(1)).withColumn("_keys", F.lit(2)).withColumn("helper", F.lit(3))
    assert [r["defect"] for r in contracts.violations(rows, "id", "json", "g", (contracts.Field("id", "int"),)).collect()] == ["wrong_type"]


def test_small_gates(spark):
    edges = spark.createDataFrame([(3, 2), (2, 1), (5, 9)], "node int, needs int")
    assert [tuple(r) for r in graphs.first_chain(edges).collect()] == [(3, 2)] and graphs.first_chain(edges.where("node = 5")).count() == 0
    areas = spark.createDataFrame([("b", True, False), ("a", True, False), ("c", False, False), ("d", True, True)], "group_id string, required boolean, covered boolean")
    assert [r["group_id"] for r in anchors.uncovered(areas).collect()] == ["a", "b"]
    rows = table_of(spark, {"verdict": "revise"}, {"verdict": "approve"}, {})
    assert defects(verdict_records.other_verdicts(rows, "id", "json", "g", "revise")) == [("other_verdict", 1), ("other_verdict", 2)]
    got = spark.range(1).select(exprs.config_record(b=F.lit(1), a=F.lit(None).cast("string")).alias("c"), exprs.environment(X=F.lit(True), A=F.lit(5)).alias("e")).first()
    assert got["c"] == '{"a":null,"b":1}' and got["e"] == {"A": "5", "X": "true"}
    tasks = spark.createDataFrame([("b", "s"), ("a", "s"), ("c", "t")], "id string, suite string")
    assert [r["id"] for r in scans.suites(tasks, "s").collect()] == ["a", "b"]
    files = spark.createDataFrame([("k", "a"), ("k", "b"), ("m", "c")], "key string, file string")
    assert [tuple(r) for r in scans.single_files(files, "key").collect()] == [("k", 2)]


def test_what_a_spec_invents(spark):
    """Units of scenario files against the assumptions of their manifest."""
    texts = spark.createDataFrame([("k", SPEC)], "key string, text string")
    own = [Anchor("sql", 1, "SELECT"), Anchor("base", 1, "a base")]
    said = lambda *t: spark.createDataFrame([("k", x) for x in t], "key string, text string")
    units = specs.requirement_units(texts, "key", "text")
    find = lambda s: sorted((r["unit"], r["group_id"]) for r in anchors.unlicensed(units, s, "key", "text", own).collect())
    assert find(said("we run SELECT")) == [("background", "base")]
    assert find(said("we run SELECT on a base")) == []
    assert find(said("nothing")) == [("background", "base"), ("scenario:second", "sql")]
