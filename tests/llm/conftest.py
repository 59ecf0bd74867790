import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block int, ids string, rep long, node long, score double, kept boolean, part string"


def awkward_rows():
    """Null texts and ids, empty and very long texts, repeated rows, ties and odd characters."""
    r = random.Random(4)
    words = ["the", "of", "and", "naïve", "Straße", "日本語", "x1", "don't", "I'll", "a.b@c.de", "1.2.3.4", "idiot", "token=abcdef123", "####", " x", " "]
    say = lambda n: "".join(r.choice(words) + r.choice([" ", "  ", "\n", "\t", " \n "]) for _ in range(n))
    texts = [None, "", " \n\t", "one", "one two three four", "same words here for all of us today", "Same WORDS here for all of us today", say(60), say(700), say(20_000), "x" * 3000, "é" * 500, "'s 't're \r\n\x0b\x1c"]
    rows = [(i, t) for i, t in enumerate(texts)]
    copy = texts[8]
    near = copy.split(" ")
    near[100] = "changed"
    rows += [(50, copy), (51, copy), (52, " ".join(near)), (7, texts[7]), (7, texts[7]), (None, copy), (None, None), (60, copy + " " + texts[7])]
    return rows


@pytest.fixture(scope="session")
def awkward(spark):
    rows = [(i, t, "en", None if i == 3 else f"src{(i or 0) % 3}", len(t or ""), 1, "x", 2, 3, 0.5, True, "p") for i, t in awkward_rows()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def by_id(df):
    return [(r["doc_id"], r) for r in df.collect()]
