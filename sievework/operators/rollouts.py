"""Trial records: numbering of repetitions, durations, rewards and token counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.exprs import first_present, iso_timestamp, null_unless_any, seconds_between
from sievework.functions.records import strict_json
from sievework.operators.ordering import exact_medians


def numbered(trials: DataFrame, groups: Sequence[str], started: Column, tie: Column, forced: Column | None = None) -> DataFrame:
    """rep: 1, 2, ... in each group by start; a trial without a start comes first; forced numbers hold."""
    w = Window.partitionBy(*groups).orderBy(started.asc_nulls_first(), tie)
    n = F.row_number().over(w)
    return trials.withColumn("rep", n if forced is None else F.coalesce(forced, n))


def trial_rows(trials: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """Records of trials (trial, json, meta): task, arm, reward, wallclock, tokens and retrieval items, numbered."""
    at = lambda p: F.get_json_object("json", f"$.{p}")
    meta = strict_json(F.col("meta")) if "meta" in trials.columns else F.lit(None).cast("string")
    of_meta = lambda k: F.get_json_object(meta, f"$.{k}")
    timed = seconds_between(iso_timestamp(at("agent_execution.started_at")), iso_timestamp(at("agent_execution.finished_at")))
    tokens = null_unless_any(*(at(f"agent_result.{f}").cast(t).alias(f) for f, t in (("n_input_tokens", "long"), ("n_cache_tokens", "long"), ("n_output_tokens", "long"), ("cost_usd", "double"))))
    rows = trials.select(
        "trial",
        at("task_name").alias("task"),
        of_meta("arm").alias("arm"),
        at("started_at").alias("started_at"),
        first_present(at("verifier_result.rewards"), "reward").cast("double").alias("reward"),
        of_meta("config_hash").alias("config_hash"),
        F.coalesce(of_meta("wallclock_sec").cast("double"), timed).alias("wallclock"),
        tokens.alias("tokens"),
    )
    rows = rows.join(items.select("trial", "retrieval_items"), "trial", "left") if items is not None else rows.withColumn("retrieval_items", F.lit(None).cast("long"))
    return numbered(rows, ["task", "arm"], F.coalesce("started_at", F.lit("")), F.col("trial"))


def median_baseline(results: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """The exact median and the number of repetitions of each group; a group may be of any size."""
    n = results.groupBy(*groups).agg(F.count("*").alias("n_reps"))
    return _with(n, exact_medians(results, groups, value, "baseline").drop("n"), groups)


def latency(results: DataFrame, groups: Sequence[str], seconds: str, digits: int = 2) -> DataFrame:
    """Least, median and largest duration of each group, which may be of any size."""
    own = results.groupBy(*groups).agg(F.round(F.min(seconds), digits).alias("min_s"), F.round(F.max(seconds), digits).alias("max_s"), F.count("*").alias("n"))
    both = _with(own, exact_medians(results, groups, seconds, "median_s").drop("n"), groups)
    return both.select(*groups, "min_s", F.round("median_s", digits).alias("median_s"), "max_s", "n")


def _with(a: DataFrame, b: DataFrame, groups: Sequence[str]) -> DataFrame:
    """A join by groups, of which null is one."""
    b = b.select(F.struct(*groups).alias("rollout__g"), *(c for c in b.columns if c not in groups))
    return a.withColumn("rollout__g", F.struct(*groups)).join(b, "rollout__g").drop("rollout__g")
