"""Interval joins and rules over finite domains against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from officelake.operators import domains, lookups
from officelake.operators.domains import Equal, Holds, Within
from officelake.operators.lookups import interval_join


@pytest.mark.parametrize("width", [1, 16])
def test_interval_join_meets_every_pair_once(spark, width):
    r = random.Random(width)

    def spans(n):
        rows = [(i, r.choice("ab"), s := r.randint(-200, 200), s + r.choice([0, 0, 1, 3, 40, 500])) for i in range(n)]
        return rows + [(n, "a", 5, 4), (n + 1, "a", None, 3), (n + 2, "b", 3, None), (n + 3, None, 0, 900)]

    one, two = spans(60), spans(50)
    left = spark.createDataFrame(one, "id long, k string, start long, stop long")
    right = spark.createDataFrame(two, "id long, k string, `from` int, upto int")
    sound = lambda x: None not in x[2:] and x[2] <= x[3]
    want = sorted((a[0], b[0]) for a, b in itertools.product(one, two) if sound(a) and sound(b) and a[2] <= b[3] and b[2] <= a[3])
    out = interval_join(left, right, ("start", "stop"), ("from", "upto"), width=width)
    assert sorted(tuple(x) for x in out.select("left.id", "right.id").collect()) == want
    keyed = interval_join(left, right, ("start", "stop"), ("from", "upto"), ["k"], width)
    same = {(a[0], b[0]) for a, b in itertools.product(one, two) if a[1] is not None and a[1] == b[1]}
    assert sorted(tuple(x) for x in keyed.select("left.id", "right.id").collect()) == [p for p in want if p in same]
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert interval_join(left.limit(0), right, ("start", "stop"), ("from", "upto")).count() == 0



@pytest.mark.parametrize("size", [3, 10, 1000])
def test_interval_join_counts_without_pairs(spark, size, monkeypatch):
    """Chunks of few starts, so that intervals end in others and span some; numbers repeat, are negative or null."""
    monkeypatch.setattr(lookups, "CHUNK_ROWS", size)
    r = random.Random(size)

    def spans(n):
        rows = [(i, r.choice([None, r.randint(-9, 9)]), s := r.choice([7, r.randint(-200, 200)]), s + r.choice([0, 0, 1, 3, 40, 500])) for i in range(n)]
        return rows + [(n, 99, 5, 4), (n + 1, 99, None, 3), (n + 2, 99, 3, None), (n + 3, 1, 9000, 9000)]

    one, two = spans(70), spans(90)
    left = spark.createDataFrame(one, "id long, v long, start long, stop long")
    right = spark.createDataFrame(two, "id long, v int, `from` int, upto int")
    sound = lambda x: None not in x[2:] and x[2] <= x[3]
    want = {}
    for a, b in itertools.product(one, two):
        if sound(a) and sound(b) and a[2] <= b[3] and b[2] <= a[3]:
            want.setdefault(a[0], []).append(b[1])
    out = interval_join(left, right, ("start", "stop"), ("from", "upto"), last_of="v")
    got = out.groupBy("left.id").agg(F.sum("met"), F.max("last")).collect()
    assert {x[0]: (x[1], x[2]) for x in got} == {i: (len(v), max([x for x in v if x is not None], default=None)) for i, v in want.items()}
    assert len(got) == len(want) and out.select("left.*").columns == left.columns
    assert interval_join(left.limit(0), right, ("start", "stop"), ("from", "upto"), last_of="v").count() == 0
    with pytest.raises(ValueError):
        interval_join(left, right, ("start", "stop"), ("from", "upto"), ["v"], last_of="v")


def test_events_at_one_time_are_not_paired(spark, tmp_path):
    """30,000 events that all meet each other: 900 million pairs, which were listed before."""
    from officelake.catalog import relational

    e = spark.range(30_000).selectExpr("id AS event_id", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id % 100) AS ts", "100.0D AS value")
    e.write.parquet(f"{tmp_path}/events.parquet")
    out = relational.j8_overlap(spark, str(tmp_path))
    assert "_bin" not in out._jdf.queryExecution().toString()
    assert out.select("met", "last").distinct().collect() == [(30_000, 29_999)] and out.count() == 30_000


RULES = [
    Holds("odd", "a % 2 = 1", ("a",)),
    Equal("twice", "a", "a * 2", "b", "b"),
    Within("near", "b", "b - 1", "b + 1", "c", "c"),
    Holds("three", "a + b + c <> 9", ("a", "b", "c")),
]


def plain(values, rules, names):
    """Per group status and smallest solution."""
    out = {}
    for g, domain in values.items():
        good = []
        for point in itertools.product(*(sorted(set(x for x in domain[n] if x is not None)) for n in names)):
            at = dict(zip(names, point))
            test = {"odd": lambda: at["a"] % 2 == 1, "twice": lambda: at["a"] * 2 == at["b"], "near": lambda: abs(at["c"] - at["b"]) <= 1, "three": lambda: at["a"] + at["b"] + at["c"] != 9}
            if all(test[r.label]() for r in rules):
                good.append(point)
        out[g] = ("UNSAT" if not good else "SAT" if len(good) == 1 else "AMBIGUOUS", min(good) if good else None)
    return out


@pytest.mark.parametrize("used", [[0, 1, 2, 3], [0, 1], [2], [3], []])
def test_solutions_of_groups(spark, used):
    r = random.Random(7)
    names, rules = ["c", "a", "b"], [RULES[i] for i in used]
    values = {g: {n: [r.choice([None, *range(1, 9)]) for _ in range(r.randint(0, 6))] for n in names} for g in [None, *range(25)]}
    tables = {n: spark.createDataFrame([(g, v) for g, d in values.items() for v in d[n]], f"g int, {n} int") for n in names}
    want = {g: x for g, x in plain(values, rules, names).items() if any(values[g].values())}
    got = {x["g"]: (x["status"], tuple(x["model"]) if x["model"] else None) for x in domains.solutions(tables, ["g"], rules).collect()}
    assert got == want
    states = {x["g"]: x["status"] for x in domains.consistency(tables, ["g"], rules).collect()}
    assert states == {g: "UNSAT" if s == "UNSAT" else "SAT" for g, (s, _) in want.items()}


def test_large_domains_are_never_multiplied(spark):
    """Four variables of 1,000 values: 10^12 combinations, four rules."""
    numbers = {n: spark.range(1000).select(F.col("id").cast("int").alias(n)) for n in "wxyz"}
    rules = [
        Equal("next", "w", "w + 1", "x", "x"),
        Within("close", "x", "x", "x + 1", "y", "y"),
        Equal("half", "y", "y", "z", "z * 2"),
        Holds("last", "z >= 499 AND y <> 999", ("z", "y")),
    ]
    out = domains.solutions(numbers, [], rules)
    assert [(r["status"], tuple(r["model"])) for r in out.collect()] == [("AMBIGUOUS", (996, 997, 998, 499))]
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    none = [*rules, Holds("never", "x > 2000", ("x",))]
    assert domains.consistency(numbers, [], none).first()["status"] == "UNSAT"


def test_rules_must_fit_their_domains(spark):
    numbers = {"a": spark.range(3).select(F.col("id").cast("int").alias("a"))}
    with pytest.raises(ValueError, match="without a domain"):
        domains.solutions(numbers, [], [Holds("x", "b > 1", ("b",))])
    with pytest.raises(ValueError, match="differ"):
        domains.solutions(numbers, [], [Holds("x", "a > 1", ("a",)), Holds("x", "a > 2", ("a",))])
    assert [(r["status"], r["model"]["a"]) for r in domains.solutions(numbers, [], [Holds("x", "a = 2", ("a",))]).collect()] == [("SAT", 2)]


def test_interval_join_is_dealt_over_many_tasks(spark):
    rows = spark.range(64).selectExpr("id", "id * 10 AS start", "id * 10 + 100 AS stop")
    out = interval_join(rows, rows, ("start", "stop"), ("start", "stop"), width=16)
    # before, as few as the bytes of the bins asked for, however many pairs they made
    assert out.rdd.getNumPartitions() == 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert out.count() == sum(abs(a - b) <= 10 for a in range(64) for b in range(64))
