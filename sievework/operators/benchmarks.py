"""Benchmark rows: programs and prompts from templates, pinned subsets, and the floors of a run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.operators.contracts import variant
from sievework.operators.findings import Rule, check, union
from sievework.operators.verdicts import first_survivors

FUNCTION, TESTS = "humaneval", "mbpp"


def with_line_end(text: Column) -> Column:
    return F.when(text.endswith("\n"), text).otherwise(F.concat(text, F.lit("\n")))


def reference_program(benchmark: Column) -> Column:
    """The benchmark's own solution of a row, null for another benchmark."""
    return F.when(benchmark == FUNCTION, F.concat("prompt", "canonical_solution")).when(benchmark == TESTS, with_line_end(F.col("code")))


def reference_assertions(benchmark: Column) -> Column:
    setup = F.coalesce("test_setup_code", F.lit(""))
    return F.when(benchmark == FUNCTION, F.concat("test", F.lit("\n\ncheck("), "entry_point", F.lit(")\n"))).when(
        benchmark == TESTS, F.concat(F.when(setup != "", F.concat(setup, F.lit("\n"))).otherwise(""), F.array_join("test_list", "\n"), F.lit("\n"))
    )


def execution_script(benchmark: Column, program: Column) -> Column:
    """What a sandbox runs: the program, a blank line, and the assertions."""
    return F.concat(with_line_end(program), F.lit("\n"), reference_assertions(benchmark))


def filled(template: str, **parts: Column) -> Column:
    """A template with its {names} replaced; what the parts hold is never taken for a name."""
    pieces: list[Column] = []
    rest = template
    while rest:
        at = [(rest.index("{" + n + "}"), n) for n in parts if "{" + n + "}" in rest]
        if not at:
            pieces.append(F.lit(rest))
            break
        i, name = min(at)
        pieces += [F.lit(rest[:i]), parts[name].cast("string")]
        rest = rest[i + len(name) + 2 :]
    return F.concat(*pieces) if pieces else F.lit("")


def file_blocks(files: DataFrame, key: str, name: str, text: str, block: str = "### {name}\n\n{text}") -> DataFrame:
    """key and blocks: a block for each file of a key, by name, joined by blank lines."""
    made = files.select(key, name, filled(block, name=F.col(name), text=F.col(text)).alias("block"))
    return made.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(name, "block"))), lambda x: x["block"]), "\n\n").alias("blocks"))


def task_number(task_id: Column) -> Column:
    """The number after the slash, so that tasks sort by number and not by text."""
    return F.get(F.split(task_id, "/"), F.lit(1)).try_cast("int")


def pinned_subset(rows: DataFrame, group: Sequence[str], order: Sequence[Column], passed: Column, size: int) -> DataFrame:
    """The first ``size`` rows that pass and those left out before them; a group that has fewer is refused (status short)."""
    chosen = first_survivors(rows, group, order, passed, size)
    n = chosen.groupBy(*group).agg(F.count_if(F.col("status") == "kept").alias("pinned__n"))
    return chosen.join(n, list(group)).withColumn("status", F.when(F.col("pinned__n") < size, "short").otherwise(F.col("status"))).drop("pinned__n")


def with_pins(rows: DataFrame, content: str) -> DataFrame:
    return rows.withColumn("sha256", F.sha2(F.encode(content, "UTF-8"), 256))


def baselines(json: DataFrame, column: str) -> DataFrame:
    """family, task and baseline of an instrument: ``{families: {family: {benchmarks: {task: {baseline_solved}}}}}``, or the same maps without these two keys."""
    parts = lambda v, name: F.coalesce(F.try_variant_get(v, f"$.{name}", "map<string, variant>"), F.try_variant_get(v, "$", "map<string, variant>"))
    families = json.select(F.explode(parts(variant(F.col(column)), "families")).alias("family", "f"))
    tasks = families.select("family", F.explode(parts(F.col("f"), "benchmarks")).alias("task", "b"))
    return tasks.select("family", "task", F.try_variant_get("b", "$.baseline_solved", "int").alias("baseline")).where("baseline IS NOT NULL")


def is_oracle(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False))


#: So many lost rows are named in a finding.
NAMED = 1000


def lost_rows(grades: DataFrame) -> DataFrame:
    """run, task and row_id of every row that is not passed."""
    return grades.where(~F.col("status").eqNullSafe(F.lit("pass"))).select("run", "task", "row_id")


def floor_findings(grades: DataFrame, candidates: DataFrame, known: DataFrame, margin: int = 2, gate: str = "floor", named: int = NAMED) -> DataFrame:
    """grades: run, task, row_id, status; candidates: run, family, oracle; known: family, task, baseline.

    An oracle must solve every row. Others may lose ``margin`` rows against the baseline of their own family; without one they can't be judged.
    The detail names the rows that were lost if they are few, else it tells their number; ``lost_rows`` has them all.
    """
    own = grades.groupBy("run", "task").agg(F.count_if(F.col("status") == "pass").alias("solved"), F.count("*").alias("total"))
    few = own.where(F.col("total") - F.col("solved") <= named).select("run", "task")
    lost = lost_rows(grades).join(few, ["run", "task"]).groupBy("run", "task").agg(F.array_join(F.array_sort(F.collect_list(F.col("row_id").cast("string"))), ",").alias("lost"))
    both = own.join(candidates, "run").join(known, ["family", "task"], "left").join(lost, ["run", "task"], "left")
    oracle = is_oracle(F.col("oracle"))
    detail = F.concat_ws(":", "task", F.coalesce("lost", (F.col("total") - F.col("solved")).cast("string")))
    return check(both, "run", gate, [
        Rule("oracle_not_total", oracle & (F.col("solved") < F.col("total")), detail),
        Rule("no_baseline", ~oracle & F.col("baseline").isNull(), F.col("task")),
        Rule("below_floor", ~oracle & (F.col("solved") < F.col("baseline") - margin), detail),
    ])


def run_findings(seen: DataFrame, tasks: DataFrame, repetitions: int, contract: DataFrame, floor: DataFrame, contract_gate: str, floor_gates: dict[str, str]) -> DataFrame:
    """All that speaks against a run, by gate: repetitions that are missing or too many, findings of the contract and of the floor.

    seen: task, rep; contract and floor: task, rep, defect, detail. A floor's gate is that of its task. ``verdicts.failures_by_gate`` tells
    what the gates mean for the run; a run without findings passes.
    """
    own = lambda df, gate: df.select(F.concat_ws("/", "task", "rep").alias("entity_id"), gate.alias("gate"), "defect", "detail")
    by_task = F.create_map(*(F.lit(x) for kv in floor_gates.items() for x in kv))
    gaps = repetition_findings(seen, tasks, repetitions).withColumn("detail", F.lit(""))
    return union(own(gaps, F.lit(contract_gate)), own(contract, F.lit(contract_gate)), own(floor, by_task[F.col("task")]))


def repetition_findings(seen: DataFrame, tasks: DataFrame, repetitions: int) -> DataFrame:
    """(task, rep) that should be there and are not, or are there and should not be."""
    grid = tasks.select("task").distinct().select("task", F.explode(F.sequence(F.lit(1), F.lit(repetitions))).alias("rep"))
    own = seen.select("task", F.col("rep").cast("int").alias("rep")).distinct()
    return union(grid.join(own, ["task", "rep"], "left_anti").withColumn("defect", F.lit("missing")), own.join(grid, ["task", "rep"], "left_anti").withColumn("defect", F.lit("extra")))


def output_findings(folders: DataFrame, suite: str, gate: str = "output") -> DataFrame:
    """folders (folder, config, has_verdicts): records of another suite are never written over."""
    other = F.col("config").isNotNull() & ~F.get_json_object("config", "$.suite").eqNullSafe(F.lit(suite))
    return check(folders, "folder", gate, [Rule("records_of_another_suite", other, F.get_json_object("config", "$.suite")), Rule("verdicts_of_another_suite", F.coalesce("has_verdicts", F.lit(False)))])


def retrieval_arm(arm: Column, fixture: Column) -> Column:
    """off, or the fixture to read; anything else raises."""
    given = F.coalesce(fixture, F.lit("")) != ""
    return (
        F.when(arm == "off", arm)
        .when(arm.startswith("fixture:") & (F.length(arm) > len("fixture:")), arm)
        .when((arm == "on") & given, F.concat(F.lit("fixture:"), fixture))
        .otherwise(F.raise_error(F.concat(F.lit("no arm without a fixture: "), F.coalesce(arm, F.lit("null")))))
    )


def first_appearances(texts: DataFrame, key: str, order: str, text: str, pattern: str) -> DataFrame:
    """key and names: what the pattern's group finds in a key's texts, oldest first, each name once."""
    names = F.regexp_extract_all(text, F.lit(pattern), 1)
    found = texts.select(key, order, F.posexplode(names).alias("place", "name"))
    first = found.groupBy(key, "name").agg(F.min(F.struct(order, "place")).alias("at"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("names"))


def by_board_order(rows: DataFrame, statuses: Sequence[str], status: str, key: str, broken: str) -> DataFrame:
    """Rows in the order of the board's columns; those that could not be read come last."""
    rank = F.array_position(F.array(*map(F.lit, statuses)), F.col(status))
    return rows.orderBy(F.col(broken).isNotNull(), F.when(rank == 0, len(statuses) + 1).otherwise(rank), key)
