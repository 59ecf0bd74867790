"""Records and files that readers take in different ways, and operators over groups of any size against plain versions."""

import collections
import hashlib
import itertools
import json
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from sievework.functions import records
from sievework.functions.scenario_files import scenario_parts
from sievework.operators import anchors, benchmarks, contracts, graphs, instruments, lines, ordering, relations, roadmaps, rollouts, specs, verdict_records, verdicts
from sievework.operators.anchors import Anchor
from sievework.sources import records as scans
from sievework.sources import sinks

SPEC = """# Generated by tool
# Stack: none
@feature-tag
Feature: f
  As a user I want x
  So that y

  Background:
    Given a base
    and wrapped

  # Why: one
  @a @b
  Scenario: first
    Given a
    # inside
    When b
      wrapped on
    Then c
    ```
    Scenario: quoted
    \"\"\"
    Then not a step
    ```

  @c junk
  Scenario Outline: second
    described here
    Given <x>
    Examples: e
      | x |
      free
  Rule: r
  Feature: again
  Given outside
"""


def parts_of(spark, *texts):
    rows = scenario_parts(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "k", "t").collect()
    out = collections.defaultdict(list)
    for r in rows:
        out[r["k"]].append(tuple(r)[1:])
    return out


def test_blanks_and_line_ends_change_nothing(spark):
    tabs = re.sub(r"(?m)^ +", lambda m: "\t" * len(m[0]), SPEC)
    wide = re.sub(r"(?m)^ +", lambda m: " 　" * len(m[0]), SPEC)
    got = parts_of(spark, SPEC, tabs, SPEC.replace("\n", "\r\n"), "﻿" + SPEC, wide, SPEC.replace("\n", " \t\n"))
    assert len(got[0]) > 10
    for k in range(1, 6):
        assert got[k] == got[0]


def test_parts_of_a_scenario_file(spark):
    got = parts_of(spark, SPEC, None, "Scenario: s\n```\nGiven x\n")
    by = {(p[0], p[1]): p for p in got[0] if p[0] != "defect"}
    assert by["header", 0][6] == ["# Generated by tool", "# Stack: none"]
    assert by["feature", 0][3] == "again" and by["feature", 0][8] == "As a user I want x\nSo that y"
    assert by["scenario", 1][5:9] == (["@a", "@b"], ["# Why: one", "# inside"], ["Given a", "When b", "Then c"], 'first\nGiven a\nWhen b\nThen c\n\nScenario: quoted\n\nThen not a step\n')
    assert by["scenario", 2][3:9] == ("second", "Scenario Outline", ["@c"], ["# inside"], ["Given <x>"], "second\ndescribed here\nGiven <x>\n| x |")
    assert sorted((p[2], p[9], p[3]) for p in got[0] if p[0] == "defect") == [
        (10, "wrapped_step_continuation", "(background)"), (18, "wrapped_step_continuation", "first"), (26, "malformed_tag_line", "first"), (32, "wrapped_step_continuation", "second"),
        (33, "rule_block_not_in_contract", "second"), (34, "multiple_feature_blocks", "second"), (35, "step_outside_scenario", None)]
    assert [p[9] for p in got[1] if p[0] == "defect"] == ["no_feature_block"]
    assert sorted(p[9] for p in got[2] if p[0] == "defect") == ["no_feature_block", "unterminated_docstring"]
    texts = spark.createDataFrame([(1, SPEC)], "k int, t string")
    assert [r["line_no"] for r in lines.wrapped_steps(texts, "k", "t").orderBy("line_no").collect()] == [10, 18, 32]
    assert {r["unit"] for r in specs.requirement_units(texts, "k", "t").collect()} == {"feature", "background", "scenario:first", "scenario:second"}


def found(df):
    return sorted((r["entity_id"], r["defect"], r["detail"]) for r in df.collect())


def rows_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "id int, json string")


def test_strict_records_in_contracts(spark):
    one = '[{"class": "DC-03", "locus": "%s"}]'
    rows = rows_of(
        spark,
        '{"verdict": "approve", "verdict": "reject", "findings": ' + one % "x" + "}",
        '{"verdict": "approve", "findings": [], "score": NaN, "least": -Infinity}',
        '{"verdict": "approve", "findings": []} and more',
        '{"verdict": "reject", "findings": ' + one % "\\n\\t" + "}",
        '{"verdict": "reject", "findings": ' + one % " " + "}",
        "{" + '"a": [' * 3000 + "]" * 3000 + "}",
    )
    assert found(verdict_records.verdict_findings(rows, "id", "json", "g")) == [(3, "unloadable", "not_object"), (4, "finding_locus", "findings[0]"), (5, "finding_locus", "findings[0]"), (6, "unloadable", "not_object")]
    fields = (contracts.Field("score", "number", nullable=True), contracts.Field("x", "string", required=False))
    numbers = rows_of(spark, '{"score": NaN}', '{"score": 1, "score": null}', '{"score": "NaN"}', '{"score": 1} 2', '{"score": Infinity, "x": "\\ud800"}')
    assert found(contracts.violations(numbers, "id", "json", "g", fields, closed=True)) == [(3, "wrong_type", "score"), (4, "not_object", "")]
    assert found(roadmaps.source_document_findings(rows_of(spark, '{"filename": "\\t", "contribution": "\\u2028x"}'), "id", "json", "g")) == [(1, "blank", "filename")]
    variants = rows_of(spark, '{"filename": " ", "contribution": 1}').select("id", F.parse_json("json").alias("json"))
    assert found(roadmaps.source_document_findings(variants, "id", "json", "g")) == [(1, "blank", "filename"), (1, "wrong_type", "contribution")]


def test_only_the_first_balanced_part_counts():
    for text in ('{x: {"a": 1}}', '{"a":[{"b":1}, oops]}', '{bad} {"a":1}', "{" * 50_000, '{"a": "}', "```json\n[1]\n```", ""):
        assert records.any_object(text) is None
    assert json.loads(records.any_object('so {"a": "}\\"{"} and {"b": 1}')) == {"a": '}"{'}
    assert json.loads(records.any_object('```json\n{bad}\n``` {"a": 1}') or "null") is None
    assert json.loads(records.any_object('{"x": 1}\n```\n{"a": {"b": 2}}\n```')) == {"a": {"b": 2}}
    assert records.balanced_object('a {"q": "\\\\"} }') == '{"q": "\\\\"}' and records.balanced_object("{{}") is None


def test_baselines_with_the_real_nesting(spark):
    whole = {"_doc": ["x"], "families": {"base/Q4": {"instrument": True, "note": "n", "benchmarks": {"t1": {"baseline_solved": 7, "reps": [7, 7, 8]}, "t2": {"note": "none"}}}, "other/NONE": {"benchmarks": {}}}}
    rows = spark.createDataFrame([(json.dumps(whole),)], "j string")
    assert [tuple(r) for r in benchmarks.baselines(rows, "j").collect()] == [("base/Q4", "t1", 7)]


def test_records_are_compared_deeply_and_with_types(spark):
    a = spark.createDataFrame([(1, '{"x": {"p": 1, "q": [1, {"r": 2, "s": 3}]}}'), (2, '{"x": 1, "y": "1"}'), (3, "[1]"), (4, "[1]")], "k int, j string")
    b = spark.createDataFrame([(1, '{"x": {"q": [1, {"s": 3, "r": 2}], "p": 1}}'), (2, '{"x": "1", "y": "1"}'), (3, "[1]"), (4, "{}")], "k int, j string")
    assert sorted((r["k"], r["field"], r["defect"]) for r in relations.record_differences(a, b, "k", "j").collect()) == [(2, "x", "differs"), (4, None, "differs")]


@pytest.mark.parametrize("seed", range(4))
def test_grids_of_any_size(spark, seed):
    r = random.Random(seed)
    axes = [[r.choice([None, *range(50)]) for _ in range(r.randint(1, 30))], ["a", "b", None][: r.randint(1, 3)], list(range(r.randint(1, 60)))]
    every = list(itertools.product(*(sorted(set(a), key=str) for a in axes)))
    seen = r.sample(every, r.randint(0, len(every))) + [(999, "zz", 1)]
    frames = [spark.createDataFrame([(x,) for x in a], f"{n} {t}") for a, n, t in zip(axes, "abc", ("int", "string", "int"), strict=True)]
    got = [tuple(x) for x in relations.unseen_grid(spark.createDataFrame(seen + seen[:5], "a int, b string, c int"), frames).collect()]
    assert collections.Counter(got) == collections.Counter(set(every) - set(seen))
    if seed == 0:
        large = relations.unseen_grid(spark.range(300_000).select(F.col("id").alias("a"), (F.col("id") % 7).alias("b")), [spark.range(300_000).select(F.col("id").alias("a")), spark.range(7).select(F.col("id").alias("b"))])
        assert large.count() == 300_000 * 6
        assert relations.unseen_grid(frames[0].select("a", F.lit(1).alias("b")).limit(0), [frames[0], frames[1].limit(0)]).count() == 0


def test_running_sums_and_medians_of_hot_groups(spark):
    r = random.Random(2)
    rows = [(r.choice([1, 1, 1, 2, None]), k, r.choice([0.0, -1.5, r.gauss(0, 9), r.random() * 1e9, None, 3.25])) for k in range(4000)] + [(7, k, 2.0) for k in range(60)] + [(8, 1, None)]
    df = spark.createDataFrame(rows, "g int, k int, v double").repartition(7)
    got = {(x["g"], x["k"]): x["n"] for x in ordering.with_running(df, ["g"], ["k"], F.lit(1), "n").collect()}
    for g in {x[0] for x in rows}:
        for n, k in enumerate(sorted(x[1] for x in rows if x[0] == g), 1):
            assert got[g, k] == n
    tied = ordering.with_running(df.withColumn("k", F.col("k") % 10), ["g"], ["k"], F.lit(1), "n", peers=True).where("g = 7").groupBy("k").agg(F.min("n").alias("a"), F.max("n").alias("b")).orderBy("k")
    assert [(x["a"], x["b"]) for x in tied.collect()] == [(6 * k, 6 * k) for k in range(1, 11)]
    values = collections.defaultdict(list)
    for g, _, v in rows:
        values[g] += [v] if v is not None else []
    for steps, few in ((1024, 10_000), (4, 3), (3, 50)):
        medians = {x["g"]: (x["median"], x["n"]) for x in ordering.exact_medians(df, ["g"], "v", steps=steps, few=few).collect()}
        for g in {x[0] for x in rows}:
            want = statistics.median(values[g]) if values[g] else None
            assert medians[g][1] == len(values[g]) and (medians[g][0] == want or medians[g][0] == pytest.approx(want, rel=1e-12))
    base = {x["g"]: (x["baseline"], x["n_reps"]) for x in rollouts.median_baseline(df, ["g"], "v").collect()}
    assert base[7] == (2.0, 60) and base[8] == (None, 1)
    kept = verdicts.first_survivors(df.where("g = 1"), ["g"], [F.col("k")], F.col("v") > 0, 5)
    want, n = [], 0
    for g, k, v in sorted((x for x in rows if x[0] == 1), key=lambda x: x[1]):
        if n < 5:
            n += bool(v is not None and v > 0)
            want.append((k, "kept" if v is not None and v > 0 else "excluded"))
    assert sorted((x["k"], x["status"]) for x in kept.collect()) == want


@pytest.mark.parametrize("seed", range(3))
def test_components_are_what_reaches_each_other(spark, seed):
    r = random.Random(seed)
    edges = [(r.randint(0, 25), r.randint(0, 25)) for _ in range(26 + 6 * seed)] + [(40, 40), (41, 42)]
    after = collections.defaultdict(set)
    for a, b in edges:
        after[a].add(b)

    def reach(a):
        seen, left = set(), [a]
        while left:
            for b in after[left.pop()] - seen:
                seen.add(b)
                left.append(b)
        return seen

    nodes = {x for e in edges for x in e}
    reached = {a: reach(a) for a in nodes}
    want = {(a, min(b for b in reached[a] if a in reached[b])) for a in nodes if a in reached[a]}
    got = graphs.components(spark.createDataFrame(edges, "node int, needs int"))
    assert {tuple(x) for x in got.collect()} == want
    if not seed:
        assert graphs.components(spark.createDataFrame([(1, 2)], "node int, needs int")).count() == 0


def test_many_patterns_are_the_plain_loop(spark):
    assert instruments.need_of("ab(?:cd|efg)h+ij*") == frozenset({"ab"}) or instruments.need_of("ab(?:cd|efg)h+ij*")
    assert instruments.need_of("(cat|horse)s?") == frozenset({"cat", "horse"}) and instruments.need_of("x*|y") is None and instruments.need_of("(?iu)STRASSE") == frozenset({"strasse"})
    assert instruments.need_of(r"a?b?") is None and instruments.need_of(r"\d{3}") is None and instruments.need_of("(?=ab)c") is None
    r = random.Random(9)
    words = ["".join(r.choice("abcdeés") for _ in range(r.randint(2, 6))) for _ in range(400)] + ["İs", "ſun", "Kelvin"]
    texts = [" ".join(r.choice([w, w.upper()]) for w in r.choices(words, k=12)) for _ in range(60)] + [None, "", "ISUN SUN kelvin"]
    forms = ["{a} {b}", "(?i){a}", "{a}|{b}x", "({a})+", "[ab]{a}", "{a}.?{b}", r"\b{a}\b", "(?iu){a}", "^{a}", "x?"]
    patterns = [Anchor("g", k, r.choice(forms).format(a=r.choice(words), b=r.choice(words))) for k in range(5000)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {(x["id"], x["ord"], x["matched"]) for x in instruments.matches(df, "text", patterns).collect()}
    every = spark.createDataFrame([(a.ord, a.pattern) for a in patterns], "ord int, p string")
    plain = df.crossJoin(every).withColumn("matched", F.regexp_substr("text", F.col("p"))).where("matched IS NOT NULL")
    want = {(x["id"], x["ord"], x["matched"]) for x in plain.select("id", "ord", "matched").collect()}
    assert got == want and len({k for _, k, _ in got}) > 500


def test_hashes_of_files_are_streamed(spark, tmp_path):
    import os

    want = {}
    for name, size in (("a", 0), ("b", 10), ("c", (8 << 20) + 3)):
        data = os.urandom(size)
        (tmp_path / f"{name}.bin").write_bytes(data)
        want[name] = hashlib.sha256(data).hexdigest()
    found_ = scans.file_hashes(spark, f"file://{tmp_path}/*.bin", r"([^/]+)\.bin$", "name")
    assert {x["name"]: x["sha256"] for x in found_.collect()} == want
    (tmp_path / "d").mkdir()
    (tmp_path / "e").mkdir()
    (tmp_path / "d" / "bundle.json").write_text("{}")
    assert [tuple(x) for x in scans.folders(spark, str(tmp_path), "bundle.json").collect()] == [("d", True), ("e", False)]


def test_floors_name_few_rows_and_count_many(spark):
    grades = spark.createDataFrame([("r", "t", k, "fail" if k < 30 else "pass") for k in range(40)], "run string, task string, row_id int, status string")
    candidates = spark.createDataFrame([("r", "f", False)], "run string, family string, oracle boolean")
    known = spark.createDataFrame([("f", "t", 40)], "family string, task string, baseline int")
    assert [r["detail"] for r in benchmarks.floor_findings(grades, candidates, known, named=29).collect()] == ["t:30"]
    assert benchmarks.lost_rows(grades).count() == 30
    none = known.limit(0).select("task", F.lit(1).alias("rep"), F.lit("d").alias("defect"), F.lit("").alias("detail"))
    tasks, seen = spark.createDataFrame([("t",)], "task string"), spark.createDataFrame([("t", 1), ("t", 2)], "task string, rep int")
    assert benchmarks.run_findings(seen, tasks, 2, none, none, "G1", {"t": "G2"}).count() == 0
    late = benchmarks.run_findings(seen, tasks, 3, none, none.union(spark.createDataFrame([("t", 1, "below", "")], "task string, rep int, defect string, detail string")), "G1", {"t": "G2"})
    assert sorted((r["gate"], r["defect"], r["entity_id"]) for r in late.collect()) == [("G1", "missing", "t/3"), ("G2", "below", "t/1")]


# Anchors as RE2 reads them.


def test_word_edges_are_those_of_ascii_words(spark):
    """Tables by which q08, q09 and q10 differed from their SQL: words that a letter beyond ASCII goes on with, and letters that fold to s or k."""
    import duckdb

    from sievework.plans import catalogue

    texts = ["m. Undöei", "rä undübe", "öund", "und", "fund", "und_", "THE éthe", "the9", "iſa", " iſ é", "ıs", "of́", "wıth With", None, ""]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (id INT, text VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(texts)))
    for instrument, own in ((catalogue.TALK, catalogue.JAVA_TALK), (catalogue.ANCHORS, catalogue.JAVA_ANCHORS)):
        want = con.execute(f"SELECT id, group_id, ord, regexp_extract(text, pattern) FROM t, {catalogue._values_sql(instrument)} WHERE regexp_matches(text, pattern)").fetchall()
        got = anchors.matches(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "text", own).select("id", "group_id", "ord", "matched").collect()
        assert sorted(map(tuple, got)) == sorted(want) != []
        groups = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", anchors.matched_groups(F.col("text"), own).alias("g"))
        assert {(r.id, g) for r in groups.collect() for g in r.g} == {x[:2] for x in want}


def test_only_the_parts_that_are_asked_for_are_made(spark):
    texts = spark.createDataFrame([(0, SPEC), (1, "﻿" + SPEC), (2, None)], "k int, t string")
    every = scenario_parts(texts, "k", "t")
    some = scenario_parts(texts, "k", "t", ("part", "name", "steps"), ("scenario", "mark"))
    assert some.columns == ["k", "part", "name", "steps"]
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(some.where("part = 'scenario'")) == rows(every.where("part = 'scenario'").select("k", "part", "name", "steps")) != []
    assert rows(some.where("part = 'mark'").select("k")) == [(1,)]


def test_findings_of_files_read_their_parts_once(spark):
    """q79 read every file six times."""
    from sievework.plans import catalogue, contract_catalogue  # noqa: F401

    plan = catalogue.queries()["q79_spec_gates"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPythonUDTF" not in plan and "BatchEvalPythonUDTF" not in plan


def test_waves_of_q57_are_numbered_in_whole_nations():
    from sievework.plans import catalogue, record_catalogue  # noqa: F401

    assert "row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey)" in catalogue.oracle_sql()["q57_frontmatter"]


def test_files_of_plans_are_not_broadcast_by_their_tables_size(spark):
    from sievework.plans import catalogue, contract_catalogue  # noqa: F401

    plan = catalogue.queries()["q100_plan_facts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_files_of_rows_are_written_and_scanned_by_tasks(spark, tmp_path):
    root = f"file://{tmp_path}/rows"
    rows = spark.createDataFrame([(str(k), f'{{"items": [{k}, 2]}}\r\n\n{{"items": \n{{}}') for k in range(40)], "name string, value string")
    sinks.write_files(rows, "name", "value", root, ".jsonl.gz")
    sinks.write_files(rows, "name", "value", f"{root}-plain")
    assert not any(p.is_dir() and p.name.startswith("name=") for p in tmp_path.rglob("*"))  # no folder for each row
    key = r"name=(\d+)\."
    lines_ = scans.json_lines_in(spark, f"{root}/*").withColumn("name", F.regexp_extract("path", key, 1)).collect()
    assert collections.Counter((r["name"], r["json"]) for r in lines_) == collections.Counter((str(k), j) for k in range(40) for j in (f'{{"items": [{k}, 2]}}', None, "{}"))
    assert {(r["name"], r["value"]) for r in scans.texts_in(spark, f"{root}-plain/*", key, "name").collect()} == {tuple(r) for r in rows.collect()}
    (tmp_path / "rows-plain" / "000").mkdir(exist_ok=True)
    (tmp_path / "rows-plain" / "000" / "name=99.txt").write_bytes(b"")
    sums = {r["name"]: r["sha256"] for r in scans.hashes_of(scans.files_in(spark, f"{root}-plain/*"), key, "name").collect()}
    assert sums == {r["name"]: hashlib.sha256(r["value"].encode()).hexdigest() for r in rows.collect()} | {"99": hashlib.sha256(b"").hexdigest()}
    assert scans.texts_in(spark, f"{root}-none/*", key, "name").count() == 0


def python_steps(df):
    """How many steps of the plan run Python."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython")


def test_records_are_read_once_for_their_differences(spark):
    a, b = (spark.createDataFrame(rows, "k int, json string") for rows in ([(1, '{"a": 1, "b": null}'), (2, "["), (3, "{}"), (5, "[")], [(1, '{"b": null, "a": 1.5, "c": NaN}'), (2, "{}"), (4, "{}"), (5, "x")]))
    found = relations.record_differences(a, b, "k", "json")
    assert python_steps(found) == 1
    assert {tuple(r) for r in found.collect()} == {(1, "a", "differs"), (1, "c", "unexpected"), (2, None, "differs"), (3, None, "missing"), (4, None, "unexpected")}


def test_python_values_of_long_texts_are_held_in_parts(monkeypatch):
    import pyarrow as pa

    held, most = [0], [0]

    def f(text):
        held[0] += 1
        return text

    class Watched:
        def __getattr__(self, name):
            return getattr(pa, name)

        def array(self, values, kind):
            most[0], held[0] = max(most[0], held[0]), 0
            return pa.array(values, kind)

    monkeypatch.setattr(records, "pa", Watched())
    monkeypatch.setattr(records.F, "arrow_udf", lambda rows, schema: rows)
    apply = records._column(f, pa.string(), "string")
    texts = pa.array(["x" * 100_000, None] * 100)
    assert apply(texts).equals(texts) and most[0] <= 12
    assert apply(texts[:0]).equals(texts[:0])


def test_feature_contract_reads_its_records_once(spark, monkeypatch):
    from sievework.plans import record_catalogue

    read, read_once = [], roadmaps.read_once
    monkeypatch.setattr(roadmaps, "read_once", lambda *a: read.append(read_once(*a)) or read[-1])
    assert python_steps(record_catalogue.q52(spark, "/root/testdata/sf0.001")) == 0 and len(read) == 1


def test_requirement_units_read_their_records_once(spark):
    rows = spark.createDataFrame([(1, '{"epics": [{"id": "e", "features": [{"title": "t"}]}], "priority_rationale": "why"}')], "k int, json string")
    found = roadmaps.requirement_units(rows, "k", "json")
    assert python_steps(found) == 0  # what is read was written before
    assert sorted(tuple(r) for r in found.collect()) == [(1, "epic:e", ""), (1, "feature:0", "t"), (1, "priority_rationale", "why")]


def test_missing_and_foreign_keys_are_counted_without_a_join(spark):
    rows = lambda values, schema="key long": spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], schema)
    expected, given = rows([1, 1, 2, 3, 4, None]), rows([(1, 10), (2, 40), (2, 1), (3, None), (8, 50), (8, 1), (9, 1), (None, 40)], "key int, n int")
    large = given.where("n > 30")
    missing, foreign, both = relations.incomplete(expected, "key", large, given.where("n = 40")), relations.ungrounded(given, expected, "key"), relations.completeness(expected, given, "key", F.col("n") > 30)
    assert collections.Counter(r.key for r in missing.collect()) == {1: 2, 3: 1, 4: 1, None: 1}
    assert sorted(r.key for r in foreign.collect()) == [8, 9] and foreign.schema["key"].dataType == given.schema["key"].dataType
    assert collections.Counter(map(tuple, both.collect())) == {(1, "unanswered"): 2, (3, "unanswered"): 1, (4, "unanswered"): 1, (None, "unanswered"): 1, (8, "foreign"): 1, (9, "foreign"): 1}
    # However small the files of the keys are, they are neither broadcast nor sorted as a whole.
    assert not any("Join" in d._jdf.queryExecution().executedPlan().toString() for d in (missing, foreign, both))


def test_cited_records_are_made_after_their_keys_are_collected(spark):
    from sievework.plans import record_catalogue

    plan = record_catalogue.q63(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    collected = re.findall(r"partial_collect_list\(.*", plan)
    assert collected and not any("suggested_context_files" in c for c in collected)


def test_citations_come_back_flat(spark):
    deep = '{"a": [[{"document": "d", "x": {"cited_docs": ["c", " ", {"filename": "f"}, {"filename": 1}, null]}}]], "document": ["no"], "suggested_context_files": ["a.md", "b.txt", 3]}'
    texts = [deep, None, "[]", "no json", '{"a": {"document": "lost"}, "a": {"document": "kept"}}', '{"document": "d", "x": {"document": "d"}}', '{"source_documents": {"filename": "f"}}']
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, json string").repartition(1).select("k", records.cited(F.col("json")).alias("c")).collect()
    found = {r.k: None if r.c is None else [tuple(x) for x in r.c] for r in rows}
    assert found == {0: [("a.md", "suggested_context_files"), ("c", "cited_docs"), ("d", "document"), ("f", "cited_docs")], 1: None, 2: [], 3: [], 4: [("kept", "document")], 5: [("d", "document")], 6: []}
