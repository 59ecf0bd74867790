"""Running sums, numbers and medians over groups of any size: no task holds a group.

A running sum is made in two steps: rows are cut into ranges of (group, order), summed inside each range, and the totals of the ranges before are
added. A median is selected by counts: the values of a group are counted in even steps between its least and its largest, and only the step that holds
the median is looked at again, in finer steps, until few values are left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.sources.staging import staged

#: Steps that a group's values are counted in at a time.
STEPS = 1024
#: Values of a group that are sorted in one task.
FEW = 10_000


def with_running(rows: DataFrame, group: Sequence[str], order: Sequence[Column | str], value: Column, name: str, peers: bool = False) -> DataFrame:
    """Adds the sum of ``value`` over the rows of the group up to this one; with ``peers`` also those that are equal to it in order.

    Null is a group like any other. The ranges are written once, so that all later steps see the same cuts.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    key = F.struct(*group) if group else F.lit(0)
    cut = rows.withColumn("running__g", key).withColumn("running__v", value).repartitionByRange("running__g", *order)
    cut = staged(cut.withColumn("running__p", F.spark_partition_id()))
    totals = cut.groupBy("running__g", "running__p").agg(F.sum("running__v").alias("t"))
    before = F.sum("t").over(Window.partitionBy("running__g").orderBy("running__p").rowsBetween(Window.unboundedPreceding, -1))
    before = totals.select("running__g", "running__p", F.coalesce(before, F.lit(0)).alias("running__b"))
    inside = Window.partitionBy("running__g", "running__p").orderBy(*order)
    inside = inside if peers else inside.rowsBetween(Window.unboundedPreceding, 0)
    out = cut.join(before, ["running__g", "running__p"])
    return out.withColumn(name, F.sum("running__v").over(inside) + F.col("running__b")).drop("running__g", "running__p", "running__v", "running__b")


def numbered_from_zero(rows: DataFrame, name: str) -> DataFrame:
    """Distinct rows numbered 0, 1, ... in their order."""
    return with_running(rows.distinct(), [], rows.columns, F.lit(1), name).withColumn(name, F.col(name).cast("long") - 1)


def exact_medians(rows: DataFrame, groups: Sequence[str], value: str, name: str = "median", steps: int = STEPS, few: int = FEW) -> DataFrame:
    """groups, the exact median of the finite values (null values don't count; of an even number the mean of the middle two), and n.

    A group whose values are all null is there with a null median and n = 0.
    """
    own = staged(rows.select(F.struct(*groups).alias("g"), F.col(value).cast("double").alias("v")))
    v = F.col("v")
    whole = staged(own.groupBy("g").agg(F.count("v").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")))
    # What is known of a group: its middle ranks lie in [a, b], which has ``held`` values, and ``before`` values lie below.
    open_ = whole.where("n > 0").select("g", "n", "a", "b", F.col("n").alias("held"), F.lit(0).cast("long").alias("before"))
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    settled, bounded = [], []
    while True:
        flat = F.col("a") == F.col("b")
        settled.append(open_.where(flat).select("g", F.col("a").alias("median")))
        bounded.append(open_.where(~flat & (F.col("held") <= few)))
        open_ = staged(open_.where(~flat & (F.col("held") > few)))
        if open_.isEmpty():
            break
        step = F.least(F.floor((v - F.col("a")) / (F.col("b") - F.col("a")) * steps), F.lit(steps - 1))
        inside = own.join(open_, "g").where(v.between(F.col("a"), F.col("b")))
        counts = inside.groupBy("g", step.alias("step")).agg(F.count("*").alias("c"), F.min("v").alias("least"), F.max("v").alias("most"), F.first("n").alias("n"), F.first("before").alias("before"))
        running = F.sum("c").over(Window.partitionBy("g").orderBy("step").rowsBetween(Window.unboundedPreceding, -1))
        counts = counts.withColumn("before", F.col("before") + F.coalesce(running, F.lit(0)))
        has = lambda rank: (F.col("before") <= rank) & (rank < F.col("before") + F.col("c"))
        found = staged(counts.where(has(low) | has(high)))
        both = found.where(has(low) & has(high))
        apart = found.groupBy("g").agg(F.max(F.when(has(low) & ~has(high), F.col("most"))).alias("x"), F.min(F.when(has(high) & ~has(low), F.col("least"))).alias("y")).where("x IS NOT NULL")
        settled.append(apart.select("g", (F.col("x") * 0.5 + F.col("y") * 0.5).alias("median")))
        open_ = both.select("g", "n", F.col("least").alias("a"), F.col("most").alias("b"), F.col("c").alias("held"), "before")
    left = bounded[0]
    for b in bounded[1:]:
        left = left.unionByName(b)
    inside = own.join(left, "g").where(v.between(F.col("a"), F.col("b")))
    values = inside.groupBy("g").agg(F.array_sort(F.collect_list("v")).alias("vs"), F.first("n").alias("n"), F.first("before").alias("before"))
    at = lambda rank: F.element_at("vs", (rank - F.col("before") + 1).cast("int"))
    out = values.select("g", (at(low) * 0.5 + at(high) * 0.5).alias("median"))
    for s in settled:
        out = out.unionByName(s)
    return whole.select("g", "n").join(out, "g", "left").select("g.*", F.col("median").alias(name), "n")
