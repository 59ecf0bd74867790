"""Recall of operator 8: the documents whose id is divisible by 50 against all rows, counted exhaustively.

``python tests/llm/recall.py TABLE.parquet`` prints how many links there are and how many the operator keeps together.
"""

import collections
import os
import re
import sys

import pyarrow.dataset as ds

EVERY = 50


def shingles(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return set(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else {tuple(w)} if w else set()


def links(path):
    """All pairs (query id, other id) at a similarity of 0.75 or more: each row meets the queries that share a shingle with it."""
    rows = lambda: ((r["doc_id"], r["text"]) for b in ds.dataset(path).to_batches(columns=["doc_id", "text"]) for r in b.to_pylist())
    size, of = {}, collections.defaultdict(list)
    for i, text in rows():
        if i is not None and i % EVERY == 0 and (own := shingles(text)):
            size[i] = len(own)
            for s in own:
                of[s].append(i)
    found = set()
    for i, text in rows():
        own = shingles(text)
        for q, n in collections.Counter(q for s in own for q in of.get(s, ())).items():
            if q != i and 100 * n >= 75 * (size[q] + len(own) - n):
                found.add((q, i))
    return found


def recall(spark, path):
    """(links of the queries, those whose ends have one component)."""
    from sievework.llm import neardup

    component = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.read.parquet(path)).select("doc_id", "component_id").collect()}
    pairs = links(path)
    return len(pairs), sum(component[a] == component[b] for a, b in pairs)


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    from pyspark.sql import SparkSession

    from sievework.sources.shipping import ship_package

    session = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    total, found = recall(session, sys.argv[1])
    print(f"{found:,} of {total:,} links of the documents whose id is divisible by {EVERY}, against all rows")
