"""Operator 12: sharding by a two-pass external shuffle, with DataFrame functions only.

The rows get running numbers and are written once, so that every later pass, and every task that is run again, sees the same
rows under the same numbers. The first pass scatters them uniformly into memory-sized buckets by a seeded hash of their number,
so rows that are alike are dealt as evenly as any others. The second takes each bucket by itself: its places are put in the order
of a Fisher-Yates shuffle (Spark's ``shuffle``), and the buckets follow one another. Shards are equal cuts of that order, so the
law ``rows`` holds: any two shards differ by one row at most, whatever the rows weigh. Where a bucket begins comes from the counts
of the buckets alone, summed in two steps.

Defined results: null ids and texts, empty and very long texts and repeated rows are rows like any others; all columns stay, and
may be null and of any name (a column called shard or slot is replaced); an empty table gives no rows; with fewer rows than
shards the first shards get one each. There are no ties. The same table in the same partitions gives the same order for a seed;
other partitions give another order, which is as random.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.common import staged

LAW = "rows"
SHARDS = 24
SEED = 20240501
#: Bytes of text that a bucket holds, on average.
BUCKET_BYTES = 16 << 20
#: Partitions of the second pass; more buckets share them and are taken one after another.
TASKS = 1 << 14
#: Neighbouring buckets whose counts are summed before the sums of all such spans are.
SPAN = 1024


def _before(order: str, *by: str) -> Column:
    """The sum of n over the rows before this one."""
    return F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _buckets(rows: DataFrame, tasks: int, seed: int) -> DataFrame:
    """bucket, before (rows of all buckets before it) and places (its places, shuffled): one row for each bucket."""
    counts = rows.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("span", F.floor(F.col("bucket") / SPAN))
    spans = counts.groupBy("span").agg(F.sum("n").alias("n")).select("span", _before("span").alias("span_before"))
    found = counts.withColumn("in_span", _before("bucket", "span")).join(spans, "span")
    # shuffle() draws its random numbers row after row of a partition, so the order of the rows is settled first.
    ordered = found.repartition(tasks, "bucket").sortWithinPartitions("bucket")
    places = F.shuffle(F.sequence(F.lit(0), F.col("n").cast("int") - 1), seed)
    return staged(ordered.select("bucket", (F.col("span_before") + F.col("in_span")).alias("before"), places.alias("places")))


def sharded(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows and columns with their shard (from 0) and their slot in it (from 0, without gaps)."""
    docs = docs.drop("shard", "slot")
    weight = F.coalesce(F.octet_length(text_col), F.lit(0)).alias("weight")
    rows = staged(docs.select(F.monotonically_increasing_id().alias("number"), weight, F.struct("*").alias("row")))
    n, weight = rows.agg(F.count("*"), F.coalesce(F.sum("weight"), F.lit(0))).first()
    buckets = max(docs.sparkSession.sparkContext.defaultParallelism, math.ceil(weight / bucket_bytes))
    tasks = min(buckets, TASKS)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("number", F.lit(seed)), F.lit(buckets)))
    found = _buckets(rows.select("bucket"), tasks, seed)
    turn = F.row_number().over(Window.partitionBy("bucket").orderBy("number"))
    dealt = rows.select("bucket", "number", "row").repartition(tasks, "bucket").withColumn("turn", turn).join(found, "bucket")
    place = F.col("before") + F.element_at("places", F.col("turn"))
    least, more = divmod(n, shards)  # the first ``more`` shards have a row more than the others
    late = place - more * (least + 1)
    shard = F.when(late < 0, F.floor(place / (least + 1))).otherwise(more + F.floor(late / max(least, 1)))
    slot = F.when(late < 0, place % (least + 1)).otherwise(late % max(least, 1))
    return dealt.select("row.*", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> None:
    """Parquet with a folder for each shard; a file holds the rows of some buckets in the order of their slots."""
    sharded(docs, shards, seed, text_col, bucket_bytes).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def placements(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size and checksum of the text, the law that holds, shard and slot; growth to one more shard is no part of the law."""
    text = F.coalesce("text", F.lit(""))
    size = (F.octet_length(text) + 8).cast("long")
    found = sharded(docs, shards, seed)
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
