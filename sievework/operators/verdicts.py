"""Gates over verdicts, and run-level decisions: catches, floors, baselines, K of N repetitions, dispositions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators.ordering import with_running
from sievework.operators.anchors import Anchor, matched_groups

#: What a failed gate means for a run.
OUTCOMES = ("FAIL", "INVALID", "BLOCKED")
#: The gates of each suite (suite, gate, passes needed, results needed).
SUITE_RULES = (
    ("po", "G1", 12, 12),
    ("po", "G2", 12, 12),
    ("po", "G3", 2, 3),
    ("po", "G4", 3, 3),
    ("po", "G5", 3, 3),
    ("po-idea", "G-I1", 6, 6),
    ("po-idea", "G-I2", 3, 3),
    ("po-idea", "G-I3", 3, 3),
    ("po-idea", "G-I4", 3, 3),
    ("po-spec", "G-S1", 6, 6),
    ("po-spec", "G-S2", 3, 3),
    ("po-spec", "G-S3", 3, 3),
    ("po-spec", "G-S4", 3, 3),
    ("po-spec", "G-S5", 3, 3),
    ("arch", "G-A1", 6, 6),
    ("arch", "G-A2", 3, 3),
    ("arch", "G-A3", 3, 3),
    ("coach", "G-C1", 6, 6),
    ("coach", "G-C2", 3, 3),
    ("coach", "G-C3", 3, 3),
    ("coach", "G-C4", 3, 3),
    ("qav", "G-Q1", 6, 6),
    ("qav", "G-Q2", 3, 3),
    ("qav", "G-Q3", 3, 3),
    ("qav", "G-Q4", 3, 3),
    ("qav", "G-Q5", 1, 1),
    ("gc", "G-G1", 6, 6),
    ("gc", "G-G2", 3, 3),
    ("gc", "G-G3", 3, 3),
    ("gc", "G-G4", 1, 1),
    ("dcl", "author-1", 2, 3),
    ("dcl", "author-2", 2, 3),
    ("dcl", "author-3", 2, 3),
    ("dcl", "repair", 3, 3),
)
#: Gates that test the instrument: where they fail, nothing is judged.
INSTRUMENT_GATES = (("qav", "G-Q5"), ("gc", "G-G4"))


def suite_rules(spark: SparkSession) -> DataFrame:
    """SUITE_RULES as a table for ``gate_outcomes``."""
    return spark.createDataFrame(SUITE_RULES, "suite string, gate string, need int, of int")


def must_catch(registry: DataFrame, verdicts: DataFrame, key: str, anchors: Sequence[Anchor]) -> DataFrame:
    """Misses of expected rejections. registry has key and class; verdicts has key, verdict, classes and locus.

    A missing verdict or an approval ends the check; a missed class and a locus without the class's anchors are
    told apart.
    """
    both = registry.join(verdicts, key, "left")
    seen = F.array_contains(matched_groups(F.col("locus"), anchors), F.col("class"))
    defects = (
        F.when(F.col("verdict").isNull(), F.array(F.lit("no_verdict")))
        .when(F.col("verdict") != "reject", F.array(F.lit("approved")))
        .otherwise(F.array_compact(F.array(F.when(~F.coalesce(F.array_contains("classes", F.col("class")), F.lit(False)), "class_missed"), F.when(~F.coalesce(seen, F.lit(False)), "signal_missed"))))
    )
    return both.select(key, "class", F.explode(defects).alias("defect"))


def false_blocks(registry: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """Expected approvals that were not approved, missing verdicts included."""
    return registry.join(verdicts, key, "left").where(~F.coalesce(F.col("verdict") == "approve", F.lit(False))).select(key, F.coalesce("verdict", F.lit("no_verdict")).alias("verdict"))


def regression_floor(solved: DataFrame, baselines: DataFrame, key: str, margin: int = 2) -> DataFrame:
    """pass, fail (solved < baseline - margin) or blocked (no baseline of that key)."""
    both = solved.join(baselines, key, "left")
    status = F.when(F.col("baseline").isNull(), "blocked").when(F.col("solved") < F.col("baseline") - margin, "fail").otherwise("pass")
    return both.select(key, "solved", "baseline", status.alias("status"))


def matching_baseline(runs: DataFrame, baselines: DataFrame) -> DataFrame:
    """For each run (family, task) its baseline, or which part has none; baselines of other families never count."""
    families = baselines.select("family").distinct().withColumn("verdict__known", F.lit(True))
    both = runs.join(baselines, ["family", "task"], "left").join(families, "family", "left")
    state = F.when(F.col("baseline").isNotNull(), "found").when(F.col("verdict__known").isNull(), "family_missing").otherwise("benchmark_missing")
    return both.withColumn("state", state).drop("verdict__known")


def k_of_n(results: DataFrame, groups: Sequence[str], passed: Column, need: Column, of: Column) -> DataFrame:
    """Passes of each group against what it needs; INVALID where results are missing."""
    counts = results.groupBy(*groups).agg(F.count_if(passed).alias("n_passed"), F.count("*").alias("n_results"), F.max(need).alias("need"), F.max(of).alias("of"))
    outcome = F.when(F.col("n_results") < F.col("of"), "INVALID").when(F.col("n_passed") >= F.col("need"), "PASS").otherwise("FAIL")
    return counts.withColumn("outcome", outcome)


def gate_outcomes(results: DataFrame, rules: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """outcome of every gate of ``rules`` (suite, gate, need, of) by results (suite, gate, passed).

    Gates without enough results are INVALID; gates in ``blocked`` (suite, gate) are BLOCKED whatever their results say.
    """
    counts = results.groupBy("suite", "gate").agg(F.count_if("passed").alias("n_passed"), F.count("*").alias("n_results"))
    both = rules.join(counts, ["suite", "gate"], "left").fillna(0, ["n_passed", "n_results"])
    broken = F.lit(False)
    if blocked is not None:
        both = both.join(blocked.select("suite", "gate", F.lit(True).alias("verdict__blocked")).distinct(), ["suite", "gate"], "left")
        broken = F.coalesce("verdict__blocked", F.lit(False))
    outcome = F.when(broken, "BLOCKED").when(F.col("n_results") < F.col("of"), "INVALID").when(F.col("n_passed") >= F.col("need"), "PASS").otherwise("FAIL")
    return both.select("suite", "gate", "need", "of", "n_passed", "n_results", outcome.alias("outcome"))


def suite_verdict(gates: DataFrame, suite: str) -> DataFrame:
    """PASS if every gate of a suite passes; else BLOCKED before INVALID before FAIL."""
    worst = F.max(F.when(F.col("outcome") == "BLOCKED", 3).when(F.col("outcome") == "INVALID", 2).when(F.col("outcome") == "FAIL", 1).otherwise(0))
    return gates.groupBy(suite).agg(F.element_at(F.array(*map(F.lit, ("PASS", *OUTCOMES))), worst + 1).alias("verdict"), F.count("*").alias("n_gates"))


def failed_entities(findings: DataFrame) -> DataFrame:
    """gate and entity_id of every failure, each once; of any number."""
    return findings.select("gate", "entity_id").distinct()


def failures_by_gate(findings: DataFrame, dispositions: dict[str, str], default: str) -> DataFrame:
    """For each gate its number of failed entities and what the failure means; ``failed_entities`` has their names."""
    known = F.create_map(*(F.lit(x) for kv in dispositions.items() for x in kv))
    grouped = failed_entities(findings).groupBy("gate").agg(F.count("*").alias("n_failed"))
    return grouped.withColumn("disposition", F.coalesce(known[F.col("gate")], F.lit(default)))


def failure_report(findings: DataFrame, dispositions: dict[str, str], default: str) -> DataFrame:
    """The same with the sorted names in one list, for the report of a run of bounded size."""
    names = failed_entities(findings).groupBy("gate").agg(F.array_join(F.transform(F.array_sort(F.collect_list("entity_id")), lambda x: x.cast("string")), ",").alias("failed"))
    return failures_by_gate(findings, dispositions, default).join(names, "gate")


def catch_rates(expected_and_found: DataFrame, bad: Column, flagged: Column, *groups: str) -> DataFrame:
    """Share of the bad that are flagged, and of the flagged that are not bad."""
    n = expected_and_found.groupBy(*groups).agg(F.count_if(bad).alias("n_bad"), F.count_if(bad & flagged).alias("n_caught"), F.count_if(flagged).alias("n_flagged"))
    return n.withColumn("catch_rate", F.round(F.try_divide(F.col("n_caught"), F.col("n_bad")), 6)).withColumn("over_flag_rate", F.round(F.try_divide(F.col("n_flagged") - F.col("n_caught"), F.col("n_flagged")), 6))


def first_survivors(rows: DataFrame, group: Sequence[str], order: Sequence[Column], passed: Column, most: int) -> DataFrame:
    """The first ``most`` rows of each group that pass, and the rows left out before the last of them.

    status is kept or excluded; rows after the last survivor are not looked at. A group may be of any size.
    """
    out = with_running(rows.withColumn("verdict__p", F.coalesce(passed, F.lit(False))), group, order, F.col("verdict__p").cast("int"), "verdict__n", peers=True)
    return out.where((F.col("verdict__n") < most) | ((F.col("verdict__n") == most) & F.col("verdict__p"))).withColumn("status", F.when(F.col("verdict__p"), "kept").otherwise("excluded")).drop("verdict__n", "verdict__p")
