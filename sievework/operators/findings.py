"""Findings: the rows that all gates emit. An entity without findings passes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``failed`` is a condition (null: not failed); ``detail`` is what to report."""

    defect: str
    failed: Column
    detail: Column | None = None


def failures(rules: list[Rule]) -> Column:
    """An array of structs (defect, detail) of the rules that fail."""
    made = [F.when(r.failed, F.struct(F.lit(r.defect).alias("defect"), (F.lit("") if r.detail is None else F.coalesce(r.detail.cast("string"), F.lit(""))).alias("detail"))) for r in rules]
    return F.array_compact(F.array(*made))


def check(df: DataFrame, entity: str, gate: str, rules: list[Rule]) -> DataFrame:
    """entity_id, gate, defect and detail of every rule that fails, in one pass over df."""
    return found_in(df, entity, gate, failures(rules))


def found_in(df: DataFrame, entity: str, gate: str, failed: Column) -> DataFrame:
    """The findings of an array of ``failures``."""
    found = df.select(F.col(entity).alias("entity_id"), F.explode(failed).alias("f"))
    return found.select("entity_id", F.lit(gate).alias("gate"), "f.defect", "f.detail")


def union(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def keys_as_findings(df: DataFrame, entity: str, gate: str, defect: str, keys: Column) -> DataFrame:
    """One finding for each element of an array, such as missing or forbidden keys."""
    return df.select(F.col(entity).alias("entity_id"), F.lit(gate).alias("gate"), F.lit(defect).alias("defect"), F.explode(keys).alias("detail"))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
