"""Positions, batches and top-n, with and without hot keys."""

import random

import pytest
from pyspark.sql import functions as F

from officelake.operators import ordering


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [("hot" if i % 3 else f"k{i % 17}", rng.randrange(50), i) for i in range(3000)]
    return data, spark.createDataFrame(data, "k string, v long, i long").repartition(7)


def brute(data):
    out, seen = {}, {}
    for k, v, i in sorted(data):
        out[i] = seen.get(k, 0)
        seen[k] = out[i] + 1
    return out


@pytest.mark.parametrize("bounded", [True, False])
def test_ordinal(rows, bounded):
    data, df = rows
    got = ordering.ordinal(df, ["k"], [F.col("v"), F.col("i")], "n", bounded)
    assert {r["i"]: r["n"] for r in got.collect()} == brute(data)


@pytest.mark.parametrize("bounded", [True, False])
def test_running_total(rows, bounded):
    data, df = rows
    got = ordering.running_total(df, ["k"], [F.col("v"), F.col("i")], F.col("v"), "t", bounded)
    want, sums = {}, {}
    for k, v, i in sorted(data):
        want[i] = sums[k] = sums.get(k, 0) + v
    assert {r["i"]: r["t"] for r in got.collect()} == want


def test_ordinal_null_key(spark):
    df = spark.createDataFrame([(None, i) for i in range(40)] + [("a", 1)], "k string, i long")
    got = ordering.ordinal(df, ["k"], [F.col("i")], "n").collect()
    assert sorted((r["k"] or "", r["i"], r["n"]) for r in got) == sorted([("", i, i) for i in range(40)] + [("a", 1, 0)])


def test_global_index(rows):
    data, df = rows
    got = ordering.global_index(df, [F.col("v").desc(), F.col("i")], "n").orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(len(data)))
    assert [r["i"] for r in got] == [d[2] for d in sorted(data, key=lambda d: (-d[1], d[2]))]


def test_batches_last_one_short_and_empty(spark):
    df = spark.createDataFrame([(i,) for i in range(45)], "i long")
    got = ordering.batches(df, [F.col("i")], 20).orderBy("batch").collect()
    assert [[x["i"] for x in r["items"]] for r in got] == [list(range(20)), list(range(20, 40)), list(range(40, 45))]
    assert ordering.batches(df.limit(0), [F.col("i")], 20).count() == 0


def test_ordered_lists_have_one_row_per_key(rows):
    data, df = rows
    got = ordering.ordered_lists(df, ["k"], [F.col("i")], F.col("i")).collect()
    assert len(got) == len({d[0] for d in data})
    assert {r["k"]: r["items"] for r in got} == {k: [i for kk, _, i in data if kk == k] for k in {d[0] for d in data}}


def test_newest_and_every_nth(rows):
    data, df = rows
    got = ordering.newest(df, ["k"], [F.col("i").desc()], 5).collect()
    want = {k: sorted((i for kk, _, i in data if kk == k), reverse=True)[:5] for k in {d[0] for d in data}}
    have = {}
    for r in got:
        have.setdefault(r["k"], []).append(r["i"])
    assert {k: sorted(v, reverse=True) for k, v in have.items()} == want
    nth = ordering.every_nth(df, ["k"], [F.col("i")], 100).where("k = 'hot'").collect()
    hot = [i for k, _, i in data if k == "hot"]
    assert sorted(r["i"] for r in nth) == hot[99::100]
    assert ordering.every_nth(df, ["k"], [F.col("i")], 0).count() == 0


def test_last_wins(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "y")], "k string, o int, v string")
    assert sorted(map(tuple, ordering.last_wins(df, ["k"], [F.col("o")]).collect())) == [("a", 2, None), ("b", 1, "y")]
