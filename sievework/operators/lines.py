"""Line-level work on texts: lines, kinds of lines, places in a sequence, and what is out of place in scenario files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.exprs import stripped
from sievework.functions.scenario_files import scenario_parts
from sievework.operators.ordering import with_running

def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no (from 1) and line."""
    return df.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def scenario_findings(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Structural defects of scenario files: key, defect, line_no, line and the scenario it is in.

    No or several features, rules, junk on tag lines, quotes that never end, steps and text in the wrong place.
    """
    return out_of_place(scenario_parts(texts, key, text, ("part", "line", "name", "text", "defect"), ("defect",)), key)


def out_of_place(parts: DataFrame, key: str) -> DataFrame:
    """The same for parts that were read before."""
    return parts.where("part = 'defect'").select(key, "defect", F.col("line").alias("line_no"), F.col("text").alias("line"), F.col("name").alias("scenario"))


def wrapped_steps(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Lines that go on with a step, which must stand on one line."""
    return scenario_findings(texts, key, text).where("defect = 'wrapped_step_continuation'")


def line_summary(texts: DataFrame, key: str, text: str) -> DataFrame:
    """For each text its lines by coarse kind and its runs of blank lines; all inside the row, without a shuffle."""
    coarse = lambda x: F.when(stripped(x) == "", "blank").when(stripped(x).startswith("#"), "comment").otherwise("other")
    kinds = F.transform(F.split(F.col(text), "\n"), coarse)
    state = F.struct(*(F.lit(0).cast("long").alias(n) for n in ("n_blank", "n_comment", "n_other", "n_blank_runs")), F.lit("").alias("before"))
    one = lambda c: c.cast("long")

    def step(acc: Column, k: Column) -> Column:
        counts = [(acc[f"n_{n}"] + one(k == n)).alias(f"n_{n}") for n in ("blank", "comment", "other")]
        return F.struct(*counts, (acc["n_blank_runs"] + one((k == "blank") & (acc["before"] != "blank"))).alias("n_blank_runs"), k.alias("before"))

    rows = texts.where(F.col(text).isNotNull()).select(key, F.aggregate(kinds, state, step).alias("helper__s"))
    total = F.col("helper__s.n_blank") + F.col("helper__s.n_comment") + F.col("helper__s.n_other")
    return rows.select(key, total.alias("n_lines"), "helper__s.n_blank", "helper__s.n_comment", "helper__s.n_other", "helper__s.n_blank_runs")


def out_of_sequence(rows: DataFrame, group: str, number: str, order: str, first: int = 1) -> DataFrame:
    """Rows whose number is not its place in the group; a group may be of any size."""
    placed = with_running(rows, [group], [order], F.lit(1), "expected")
    return placed.withColumn("expected", (F.col("expected") + (first - 1)).cast("int")).where(~F.col(number).eqNullSafe(F.col("expected")))
