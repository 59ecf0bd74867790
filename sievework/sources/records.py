"""Scans of record files: JSON, JSONL, text, checksum lists, TOML, YAML and frontmatter; keys come from the path.

All scans are distributed reads of a glob; a file that is missing or broken becomes a row that says so.
"""

from __future__ import annotations

import hashlib
import io
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.records import strict_json, toml_json, yaml_json
from sievework.operators.anchors import Anchor, anchor_list


def texts(spark: SparkSession, glob: str, key_pattern: str, *keys: str) -> DataFrame:
    """path, value (the whole text) and one column for each group of key_pattern."""
    rows = spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return rows.select("path", "value", *(F.regexp_extract("path", key_pattern, i + 1).alias(k) for i, k in enumerate(keys)))


def folders(spark: SparkSession, root: str, needed: str) -> DataFrame:
    """name and complete of every folder under the root: whether it holds the file ``needed``; empty folders are there too.

    Two listings, by the file system that holds the root: of its folders, and of the files of that name in them.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    held = system.globStatus(jvm.org.apache.hadoop.fs.Path(path, f"*/{needed}")) or []
    complete = {s.getPath().getParent().getName() for s in held}
    rows = [(name, name in complete) for name in (s.getPath().getName() for s in system.listStatus(path) if s.isDirectory())]
    return spark.createDataFrame(rows, "name string, complete boolean").orderBy("name")


def folders_with(spark: SparkSession, root: str, needed: str) -> list[str]:
    """The names of the folders that hold the file, sorted."""
    return [r["name"] for r in folders(spark, root, needed).where("complete").orderBy("name").collect()]


def required_text(spark: SparkSession, path: str) -> str:
    """The text of one small file; raises FileNotFoundError where it is absent or empty."""
    from pyspark.errors import AnalysisException

    try:
        row = spark.read.text(path, wholetext=True).first()
    except AnalysisException as e:
        raise FileNotFoundError(path) from e
    if row is None or not row["value"]:
        raise FileNotFoundError(f"{path} is empty")
    return row["value"]


def rows_of(texts_by_key: DataFrame, schema: str, *keys: str, path: str = "rows") -> DataFrame:
    """The rows of the list at ``path`` in each JSON text, with their position (from 1)."""
    inner = F.from_json("value", f"struct<{path}: array<struct<{schema}>>>")[path]
    return texts_by_key.select(*keys, F.posexplode(inner).alias("position", "scan__r")).select(*keys, (F.col("position") + 1).alias("position"), "scan__r.*")


def registry(rows: DataFrame, key: str) -> DataFrame:
    """Of the rows of ``rows_of`` the last for each key."""
    rest = [c for c in rows.columns if c not in (key, "position")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "position").alias("scan__r")).select(key, "scan__r.*")


def with_optional(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Expected keys with what was scanned for them, null where nothing was."""
    return expected.join(found, key, "left")


def anchors_of(spark: SparkSession, path: str) -> list[Anchor]:
    """The anchors of an instrument: a JSON file of groups with their alternates in order."""
    groups = F.from_json("value", "struct<groups: array<struct<id: string, alternates: array<string>>>>")["groups"]
    each = spark.read.text(path, wholetext=True).select(F.explode(groups).alias("g")).select(F.col("g.id").alias("group_id"), F.posexplode("g.alternates").alias("ord", "pattern"))
    return anchor_list(each.withColumn("ord", F.col("ord") + 1))


def recorded_runs(spark: SparkSession, glob: str, kind: str, suffix: str = ".json") -> DataFrame:
    """run, rep, task, name and value of the files ``<run>/rep-<n>/<task>/<kind>/<name><suffix>``."""
    pattern = rf"([^/]+)/rep-(\d+)/([^/]+)/{kind}/([^/]+){suffix.replace('.', chr(92) + '.')}$"
    found = texts(spark, f"{glob}/rep-*/*/{kind}/*{suffix}", pattern, "run", "rep", "task", "name")
    return found.withColumn("rep", F.col("rep").cast("int"))


def suites(tasks: DataFrame, suite: str) -> DataFrame:
    """The task descriptors of a suite, in order."""
    return tasks.where(F.col("suite") == suite).orderBy("id")


def single_files(files: DataFrame, key: str) -> DataFrame:
    """Keys that don't have exactly one file, with their number."""
    return files.groupBy(key).agg(F.count("*").alias("n")).where("n <> 1")


def load_state(text: Column, kind: str = "object") -> Column:
    """'missing', 'unparseable', 'not_<kind>' or null for a text that should hold one JSON value."""
    json = strict_json(text)
    first = F.substring(F.ltrim(json), 1, 1)
    return (
        F.when(text.isNull(), "missing")
        .when(json.isNull(), "unparseable")
        .when(first != F.lit("{" if kind == "object" else "["), f"not_{kind}")
    )


def expected_records(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """A left join of expected keys with scanned records (key, value): load_error tells what is wrong."""
    return expected.join(found.select(key, "value"), key, "left").withColumn("load_error", load_state(F.col("value")))


def checksum_list(spark: SparkSession, glob: str) -> DataFrame:
    """sha256 and name of lines such as ``<sha>  *<name>``; blank lines are left out."""
    parts = F.split(F.trim("value"), r"\s+", 2)
    return spark.read.text(glob).where(F.trim("value") != "").select(parts[0].alias("sha256"), F.ltrim(parts[1], F.lit("*")).alias("name"))


#: Bytes of a file that are read at a time.
CHUNK_BYTES = 8 << 20


def _from_files(paths: DataFrame, read: Callable, schema: str) -> DataFrame:
    """The rows (tuples after the path) that ``read`` gives for the stream of each file; what is in work at a time is bounded by ``CHUNK_BYTES`` or one row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        kind = pa.schema([(c.split()[0], pa.string()) for c in schema.split(", ")])
        held, size = [], 0
        for b in batches:
            for path in b["path"].to_pylist():
                system, where = fs.FileSystem.from_uri(path)
                with system.open_input_stream(where) as f:
                    for found in read(f):
                        held.append((path, *found))
                        size += sum(map(len, held[-1]))
                        if size >= CHUNK_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], schema=kind)
                            held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], schema=kind)

    return paths.mapInArrow(rows, schema)


def files_in(spark: SparkSession, folders: str) -> DataFrame:
    """path of every file in the folders of a glob, empty files too. The driver lists the folders, and tasks what is in them."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for folder in b["folder"].to_pylist():
                system, where = fs.FileSystem.from_uri(folder)
                names = [i.base_name for i in system.get_file_info(fs.FileSelector(where)) if i.is_file]
                names = [n for n in names if not n.startswith(("_", "."))]  # as Spark's own scans
                yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{n}" for n in names], pa.string())], names=["path"])

    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folders)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    names = [(re.sub("^file:/+", "file:///", s.getPath().toString()),) for s in found if s.isDirectory()]
    return spark.createDataFrame(names, "folder string").repartition(max(1, len(names))).mapInArrow(listed, "path string")


def texts_in(spark: SparkSession, folders: str, key_pattern: str, *keys: str) -> DataFrame:
    """What ``texts`` gives, for the files in the folders of a glob: for many small files, as no list of them goes through the driver."""
    rows = _from_files(files_in(spark, folders), lambda f: [(f.read().decode("utf-8", "replace"),)], "path string, value string")
    return rows.select("path", "value", *(F.regexp_extract("path", key_pattern, i + 1).alias(k) for i, k in enumerate(keys)))


def hashes_of(paths: DataFrame, key_pattern: str, key: str) -> DataFrame:
    """The key and SHA-256 of the bytes of each file; files of any size, each read by one task as a stream."""

    def hashed(f) -> list[tuple[str]]:
        digest = hashlib.sha256()
        while part := f.read(CHUNK_BYTES):
            digest.update(part)
        return [(digest.hexdigest(),)]

    return _from_files(paths, hashed, "path string, sha256 string").select(F.regexp_extract("path", key_pattern, 1).alias(key), "sha256")


def file_hashes(spark: SparkSession, glob: str, key_pattern: str, key: str) -> DataFrame:
    """``hashes_of`` the files of a glob, which the driver lists."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(glob)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    names = [(re.sub("^file:/+", "file:///", s.getPath().toString()),) for s in found if s.isFile()]  # Spark's own scans leave out empty files
    return hashes_of(spark.createDataFrame(names, "path string").repartition("path"), key_pattern, key)


def json_lines(spark: SparkSession, glob: str) -> DataFrame:
    """path and json of each line; json is null where a line can't be parsed; blank lines are left out."""
    rows = spark.read.text(glob).where(F.trim("value") != "")
    return rows.select(F.col("_metadata.file_path").alias("path"), strict_json(F.col("value")).alias("json"))


def json_lines_in(spark: SparkSession, folders: str) -> DataFrame:
    """What ``json_lines`` gives, for the files (gzip by their names) in the folders of a glob; each is read as a stream."""
    rows = _from_files(files_in(spark, folders), lambda f: ((x.rstrip("\n"),) for x in io.TextIOWrapper(f, "utf-8", "replace")), "path string, value string")
    return rows.where(F.trim("value") != "").select("path", strict_json(F.col("value")).alias("json"))


def retrieval_items(lines: DataFrame) -> DataFrame:
    """For each file the number of items over its good lines; null if none could be parsed."""
    items = F.coalesce(F.size(F.from_json(F.get_json_object("json", "$.items"), "array<string>")), F.lit(0))
    return lines.groupBy("path").agg(F.sum(F.when(F.col("json").isNotNull(), items)).alias("retrieval_items"))


def tables_of_toml(texts_by_key: DataFrame, key: str, schema: str, pick: tuple[str, ...]) -> DataFrame:
    """One row for each TOML text: the table at ``pick`` read by schema; a text that is no TOML gives nulls."""
    path = "$" + "".join(f".{p}" for p in pick)
    rows = texts_by_key.select(key, F.get_json_object(toml_json(F.col("value")), path).alias("toml__json"))
    return rows.select(key, F.from_json("toml__json", schema).alias("toml__fields")).select(key, "toml__fields.*")


def yaml_records(rows: DataFrame, text: str = "value") -> DataFrame:
    """Adds json, the YAML mapping as JSON (null if it can't be read or is no mapping)."""
    return rows.withColumn("json", yaml_json(F.col(text)))


def frontmatter(rows: DataFrame, text: str = "value") -> DataFrame:
    """Adds json of the block between a first line of three dashes and the next such line; null without one."""
    block = F.regexp_extract(F.col(text), r"(?s)\A---\r?\n(.*?)\n---", 1)
    return rows.withColumn("json", yaml_json(F.when(block != "", block)))


def trial_records(spark: SparkSession, root: str) -> DataFrame:
    """result.json of the root and its children, for those that have the key task_name (even null)."""
    rows = texts(spark, f"{root}/{{,*/}}result.json", r"([^/]+)/result\.json$", "trial")
    parsed = rows.withColumn("json", strict_json(F.col("value")))
    return parsed.where(F.array_contains(F.json_object_keys("json"), "task_name"))
