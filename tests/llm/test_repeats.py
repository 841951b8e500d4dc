import random

import pytest
from brute import substring, suffix
from pyspark.sql import functions as F

from flowvigil.llm.substring import deep_nodes, remove_repeats
from flowvigil.llm.suffixes import radix_groups, remove_repeated_bytes

SCHEMA = "doc_id long, text string, pack string, kept int"


def words_result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()), key=str)


def bytes_result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", F.size("starts"), F.sha2("kept", 256)).collect()), key=str)


def awkward():
    rng = random.Random(5)
    vocabulary = ["ä", "b", "cc", "thé", "日本"]
    passage = " ".join(rng.choice(vocabulary) for _ in range(40))
    rows = [(None, passage), (3, passage), (3, passage), (4, None), (5, ""), (6, " \t\n"), (7, "x" * 300),
            (8, "y " * 200), (9, "y " * 90), (10, "b " + passage + "\n" + passage), (11, passage[:60] + "  " + passage[10:]), (12, None)]
    for i in range(20, 60):
        start = rng.randrange(30)
        rows.append((i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60))) + rng.choice([" ", "\n"]) + passage[start:start + rng.randrange(90)]))
    rows.append((1, "z" * 100 + "é" * 40 + " " + "k" * 3000))
    return rows


@pytest.mark.parametrize("hot", [200, 2])
def test_awkward_rows(spark, hot):
    rows = awkward()
    df = spark.createDataFrame([(i, t, "p", 1) for i, t in rows], SCHEMA)
    for size in (1 << 20, 400):
        for width in (20, 3):
            assert words_result(remove_repeats(df, width, pack_bytes=size, hot_packs=hot)) == sorted(substring(rows, width), key=str)
        for width in (50, 9):
            assert bytes_result(remove_repeated_bytes(df, width, pack_bytes=size, hot_packs=hot)) == sorted(suffix(rows, width), key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert remove_repeats(df).count() == 0 and remove_repeated_bytes(df).count() == 0


def test_given_documents(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet").filter("length(text) < 4000")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert words_result(remove_repeats(df, pack_bytes=20_000)) == sorted(substring(rows), key=str)
    assert bytes_result(remove_repeated_bytes(df, pack_bytes=20_000)) == sorted(suffix(rows), key=str)


@pytest.mark.parametrize("limit", [2, 7, 1000])
def test_grouping_by_tree_and_by_digits(limit):
    import numpy as np
    rng = np.random.default_rng(3)
    tokens = rng.integers(0, 2, 600).astype(np.uint8)
    start = np.arange(580)
    for width in (3, 9, 17):
        want = {}
        for s in start:
            want.setdefault((s % 3, tokens[s:s + width].tobytes()), set()).add(s)
        want = {frozenset(v) for v in want.values() if len(v) > 1}
        for label in (deep_nodes(tokens.astype(np.uint64), start, start % 3, width, limit), radix_groups(tokens, start, start % 3, width)):
            have = {}
            for s in start[label >= 0]:
                have.setdefault(label[s], set()).add(s)
            assert {frozenset(v) for v in have.values()} == want
