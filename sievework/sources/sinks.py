"""Writers: JSON lines, a file for each row, hashed subsets and summaries that are merged by key."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.records import canonical_json


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object a line, with null fields written; an existing folder is refused unless mode says otherwise."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


#: Folders that the files of ``write_files`` are dealt to, and tasks that write them.
FOLDERS, WRITERS = 256, 48


def write_files(rows: DataFrame, key: str, text: str, root: str, suffix: str = ".txt") -> None:
    """A file ``<root>/<folder>/<key>=<value><suffix>`` with the text of each row (gzip if the suffix ends so); keys are unique and have no slash.

    The tasks write the files themselves, where they stay: a writer that partitions by key has a folder to list and move for each row.
    The folder follows from the key, so a task that is run again writes the same files.
    """

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        made = set()
        for b in batches:
            for k, t in zip(b[0].to_pylist(), b[1].to_pylist(), strict=True):
                folder = f"{base}/{zlib.crc32(k.encode()) % FOLDERS:03d}"
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                data = t.encode()
                with system.open_output_stream(f"{folder}/{key}={k}{suffix}", compression=None) as f:
                    f.write(gzip.compress(data, mtime=0) if suffix.endswith(".gz") else data)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    rows.select(F.col(key).cast("string"), text).repartition(WRITERS, key).mapInArrow(written, "n long").write.format("noop").mode("overwrite").save()


def upserted(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Old rows whose key is not in new, and all new rows."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def with_content_hash(df: DataFrame, *columns: str, name: str = "sha256") -> DataFrame:
    """The SHA-256 of the columns as compact JSON, in the columns' order by name."""
    return df.withColumn(name, content_hash(*columns))


def content_hash(*columns: str) -> Column:
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def write_pinned(rows: DataFrame, json: str, path: str, *by: str) -> DataFrame:
    """Writes rows with the SHA-256 of their canonical JSON, a folder for each value of ``by``; never over what is there."""
    pinned = rows.withColumn("sha256", F.sha2(F.encode(canonical_json(F.col(json)), "UTF-8"), 256))
    pinned.write.partitionBy(*by).mode("errorifexists").parquet(path)
    return rows.sparkSession.read.parquet(path)
