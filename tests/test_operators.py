"""Operators on small fixtures: broken input has the named defect, tricky but right input has none."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from sievework.functions import exprs, records
from sievework.operators import contracts, graphs, lines, relations, rollouts, verdicts
from sievework.operators.contracts import Field
from sievework.plans import catalogue
from sievework.sources import records as scans
from sievework.sources import sinks

FIELDS = (
    Field("id", "string", not_blank=True),
    Field("mode", "string", domain=("extract", "idea")),
    Field("score", "number", nullable=True),
    Field("text", "string", sentences=2, most=40),
    Field("parts", "list", least=1),
    Field("note", "string", required=False, nullable=True),
)
GOOD = {"id": "a", "mode": "idea", "score": None, "text": "One is. Two are.", "parts": ["x"]}


def rows_of(spark, *values):
    return spark.createDataFrame([(i, v if v is None or isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)], "id int, json string")


@pytest.mark.parametrize(
    ("change", "defect"),
    [
        ({"id": " "}, "blank"),
        ({"id": 5}, "wrong_type"),
        ({"mode": "other"}, "not_in_domain"),
        ({"mode": None}, "wrong_type"),
        ({"score": "5"}, "wrong_type"),
        ({"score": ...}, "missing_key"),
        ({"text": "Only one."}, "too_few_sentences"),
        ({"text": "One. Two. " * 9}, "above_most"),
        ({"parts": []}, "below_least"),
        ({"parts": {"x": 1}}, "wrong_type"),
        ({"other": 1}, "unknown_key"),
    ],
)
def test_broken_records(spark, change, defect):
    record = {k: v for k, v in (GOOD | change).items() if v is not ...}
    found = contracts.violations(rows_of(spark, record), "id", "json", "g", FIELDS, closed=True).collect()
    assert [r["defect"] for r in found] == [defect]


def test_right_records_and_no_records(spark):
    rows = rows_of(spark, GOOD, GOOD | {"score": 1}, GOOD | {"score": 1.5}, GOOD | {"note": None}, "[1]", "{", None)
    found = contracts.violations(rows, "id", "json", "g", FIELDS, closed=True).collect()
    assert sorted((r["entity_id"], r["defect"]) for r in found) == [(4, "not_object"), (5, "not_object"), (6, "not_object")]
    denied = contracts.violations(rows_of(spark, GOOD), "id", "json", "g", FIELDS, denied=("mode", "parts")).collect()
    assert [(r["defect"], r["detail"]) for r in denied] == [("forbidden_key", "mode,parts")]


def test_children_and_citations(spark):
    record = {"epics": [{"c": 1}, {"c": 2}], "none": None}
    assert [(r["position"], json.loads(r["json"])) for r in contracts.children(rows_of(spark, record), ["id"], "json", "$.epics").orderBy("position").collect()] == [(1, {"c": 1}), (2, {"c": 2})]
    assert contracts.children(rows_of(spark, record, "{"), ["id"], "json", "$.none").count() == 0
    good = {"document": "d", "section_path": ["1"], "line_start": 3, "line_end": 3, "quote": None}
    bad = good | {"line_end": 2, "quote": "q" * 201, "section_path": []}
    found = contracts.citation_findings(rows_of(spark, good, bad), "id", "json", "c").collect()
    assert sorted((r["entity_id"], r["defect"]) for r in found) == [(1, "above_most"), (1, "below_least"), (1, "lines_out_of_order")]
    flat = spark.createDataFrame([(1, ["a", "b"], ["b", "a"]), (2, ["a", "a"], ["a"])], "id int, whole array<string>, parts array<string>")
    assert sorted(r["defect"] for r in contracts.flattening_findings(flat, "id", "whole", "parts", "f").collect()) == ["duplicate_id", "not_the_same"]


def test_gates_and_suites(spark):
    rules = spark.createDataFrame([("s", "a", 2, 3), ("s", "b", 3, 3), ("t", "a", 1, 1), ("u", "a", 1, 2)], "suite string, gate string, need int, of int")
    results = spark.createDataFrame([("s", "a", True), ("s", "a", True), ("s", "a", False), ("s", "b", True), ("s", "b", False), ("s", "b", True), ("t", "a", True), ("u", "a", True)], "suite string, gate string, passed boolean")
    gates = verdicts.gate_outcomes(results, rules)
    assert {(r["suite"], r["gate"]): r["outcome"] for r in gates.collect()} == {("s", "a"): "PASS", ("s", "b"): "FAIL", ("t", "a"): "PASS", ("u", "a"): "INVALID"}
    blocked = verdicts.gate_outcomes(results, rules, spark.createDataFrame([("s", "a")], "suite string, gate string"))
    assert {r["suite"]: r["verdict"] for r in verdicts.suite_verdict(blocked, "suite").collect()} == {"s": "BLOCKED", "t": "PASS", "u": "INVALID"}


def test_floor(spark):
    solved = spark.createDataFrame([("a", 8), ("b", 7), ("c", 9)], "k string, solved int")
    found = verdicts.regression_floor(solved, spark.createDataFrame([("a", 10), ("b", 10)], "k string, baseline int"), "k")
    assert {r["k"]: r["status"] for r in found.collect()} == {"a": "pass", "b": "fail", "c": "blocked"}


def test_responses():
    ok = records.response_payload('<think>why</think>{"a": 1}')
    assert (ok["state"], ok["source"], json.loads(ok["json"]), ok["thinking"]) == ("ok", "whole", {"a": 1}, "ok")
    assert records.response_payload('<think>x</think>```json\n{"a": 2}\n```')["source"] == "fence"
    assert records.response_payload('<think>x</think>```json\n{"a": \n```\n{"a": 1}')["state"] == "unparseable"
    assert records.response_payload('{"a": 1} and more')["source"] == "leading"
    assert records.response_payload("[1]")["state"] == "not_object"
    assert records.split_thinking("a ```<think>``` b")[0] == "no_think_block"
    assert records.split_thinking("<think>a")[0] == "unterminated_think_block"
    assert records.any_object('x {"a": "}"} y') == '{"a": "}"}'
    assert records.any_object("none {") is None
    assert records.normal_form("– １ßÉ") == "- 1ssé"
    assert records.program_of("  x = 1") == "x = 1\n" and records.program_of("not a program") is None
    assert records.citations('{"a": [{"document": "d", "cited_docs": ["x", " "]}]}') == [{"name": "d", "kind": "document"}, {"name": "x", "kind": "cited_docs"}]


def test_scenario_files(spark):
    good = "# c\nFeature: f\n  text\n  @t @u\n  Scenario: s\n    Given a\n    '''\n".replace("'''", '"""') + '    free\n    """\n    Then b\n'
    bad = "Scenario: s\n Given a\n and wrapped\nRule: r\n@t junk\n"
    found = lines.scenario_findings(spark.createDataFrame([(1, good), (2, bad)], "id int, text string"), "id", "text").collect()
    assert {r["id"] for r in found} == {2}
    assert {"no_feature_block", "rule_block_not_in_contract", "malformed_tag_line"} <= {r["defect"] for r in found}


def test_graphs(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 9)], "node int, needs int")
    nodes = spark.createDataFrame([(i,) for i in range(1, 7)], "node int")
    assert {r["node"] for r in graphs.on_cycles(edges).collect()} == {1, 2, 3}
    assert {(r["node"], r["length"]) for r in graphs.cycle_paths(edges, 8).collect()} == {(1, 3), (2, 3), (3, 3)}
    assert [tuple(r) for r in graphs.dangling(edges, nodes).collect()] == [(5, 9)]
    assert [r["node"] for r in graphs.roots(edges, nodes).collect()] == [6]


def _shortest_cycles(edges):
    after, found = {}, {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    for start in after:
        seen, front, n = set(), {start}, 0
        while front and start not in seen:
            front = {b for a in front for b in after.get(a, ())} - seen
            seen, n = seen | front, n + 1
        if start in seen:
            found[start] = n
    return found


def test_cycles_of_any_length(spark):
    r = random.Random(31)
    ring = [(i, (i + 1) % 70) for i in range(70)]
    dense = [(a, b) for a in range(14) for b in range(14) if a != b]
    some = [(r.randrange(40), r.randrange(40)) for _ in range(55)]
    for edges in (ring, dense, some, [(1, 1), (1, 2)], [(1, 2)], [*some, (None, 1), (2, None)]):
        got = graphs.cycle_paths(spark.createDataFrame(edges, "node int, needs int")).collect()
        assert len(got) == len({x["node"] for x in got})
        assert {x["node"]: x["length"] for x in got} == _shortest_cycles([e for e in edges if None not in e])


def test_cycles_over_all_customers(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/customer.parquet").select("c_nationkey", "c_custkey").collect()
    got = {x["node"]: x["length"] for x in catalogue.queries()["q51_all_cycles"](spark, sf).collect()}
    assert got == _shortest_cycles([(x["c_nationkey"], x["c_custkey"] % 25) for x in rows])


def test_pins_and_last_rows(spark):
    want = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "k string, sha256 string")
    have = spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "4")], "k string, sha256 string")
    assert {(r["k"], r["defect"]) for r in relations.pin_findings(want, have, "k").collect()} == {("b", "drifted"), ("c", "missing"), ("d", "stray")}
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "k string, pos int, v string")
    assert [tuple(r) for r in relations.last_by_key(rows, "k", "pos").collect()] == [("a", 2, "y")]


def test_record_files(spark, tmp_path):
    for name, text in (("a", '{"x": 1}'), ("b", "[1]"), ("c", "{")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "v.json").write_text(text)
    found = scans.texts(spark, f"{tmp_path}/*/v.json", r"([^/]+)/v\.json$", "key")
    expected = spark.createDataFrame([(k,) for k in "abcd"], "key string")
    state = {r["key"]: r["load_error"] for r in scans.expected_records(expected, found, "key").collect()}
    assert state == {"a": None, "b": "not_object", "c": "unparseable", "d": "missing"}
    hashes = {r["key"]: r["sha256"] for r in scans.file_hashes(spark, f"{tmp_path}/*/v.json", r"([^/]+)/v\.json$", "key").collect()}
    assert hashes["a"] == hashlib.sha256(b'{"x": 1}').hexdigest()
    (tmp_path / "sums.txt").write_text("ab  *one.md\n\ncd  two.md\n")
    assert sorted(tuple(r) for r in scans.checksum_list(spark, f"{tmp_path}/sums.txt").collect()) == [("ab", "one.md"), ("cd", "two.md")]
    (tmp_path / "log.jsonl").write_text('{"items": [1, 2]}\nbad\n{"items": []}\n')
    assert [r["retrieval_items"] for r in scans.retrieval_items(scans.json_lines(spark, f"{tmp_path}/log.jsonl")).collect()] == [2]


def test_trials(spark, tmp_path):
    for name, body in (("t1", {"task_name": "k", "started_at": "2026-01-01T00:00:02Z", "verifier_result": {"rewards": {"z": 0.5, "reward": 0.0}}}), ("t2", {"task_name": "k", "started_at": "2026-01-01T00:00:01Z", "agent_execution": {"started_at": "2026-01-01T00:00:00Z", "finished_at": "2026-01-01T00:00:01.500Z"}}), ("t3", {"other": 1})):
        (tmp_path / name).mkdir()
        (tmp_path / name / "result.json").write_text(json.dumps(body))
    rows = {r["trial"]: r for r in rollouts.trial_rows(scans.trial_records(spark, str(tmp_path))).collect()}
    assert set(rows) == {"t1", "t2"} and (rows["t2"]["rep"], rows["t1"]["rep"]) == (1, 2)
    assert rows["t1"]["reward"] == 0.0 and rows["t2"]["reward"] is None and rows["t2"]["wallclock"] == 1.5 and rows["t1"]["tokens"] is None


def test_sinks(spark, tmp_path):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, None)], "k int, v string")
    both = sinks.upserted(old, new, "k")
    assert sorted((r["k"], r["v"] or "") for r in both.collect()) == [(1, "a"), (2, "c"), (3, "")]
    sinks.write_json_lines(both, f"{tmp_path}/out")
    assert any('"v":null' in r["value"] for r in spark.read.text(f"{tmp_path}/out").collect())
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_json_lines(both, f"{tmp_path}/out")


def test_expressions(spark):
    row = spark.createDataFrame([("a b. C d! e", "pg://u:p@h/x", "2026-01-01T00:00:00Z", "x // decl no\ndecl yes")], "t string, u string, s string, c string")
    got = row.select(exprs.sentence_count(F.col("t")).alias("n"), exprs.redacted(F.col("u")).alias("u"), exprs.iso_timestamp(F.col("s")).isNotNull().alias("s"), exprs.iso_timestamp(F.lit("2026-01-01")).isNull().alias("d"), exprs.undeclared(F.col("c"), "decl", ["yes", "no"]).alias("c")).first()
    assert tuple(got) == (3, "pg://u:<redacted>@h/x", True, True, ["no"])
