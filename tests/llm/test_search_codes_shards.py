"""Ranked search, vector codes and sharding against brute force on odd tables."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from officelake.llm import codes, lexical, queries, sharding

RNG = random.Random(21)
VOCABULARY = ["".join(RNG.choice("aeioulnrstbd") for _ in range(RNG.randint(2, 7))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY[: r.randint(5, 300)]) for _ in range(n))


TEXTS = [None, "", " \n ", "ONE two One", "naïve café Ärger ÄRGER 日本語 x²", "a" * 50, prose(40, 1), prose(40, 1), prose(40, 1).upper(), prose(3000, 2), prose(30_000, 3)]
TEXTS += [prose(random.Random(i).choice([1, 5, 30, 30, 30, 200]), i) for i in range(10, 400)] + [prose(25, 5)] * 60
ODD = "doc_id long, text string, lang string, source string, n_chars long, shard int, slot long, curve long, row string, term string, part int, `at` int, size long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, repeated rows, ties, long texts, and columns named like the operators' own."""
    rows = [(None if i == 5 else i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", None if t is None else len(t), 1, 2, 3, "x", "y", 4, 5, 6) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + [rows[6], rows[0]], ODD).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], ODD)


# --- 11 ---------------------------------------------------------------------------------------------------------


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, top=10):
    held = [(i, Counter(plain_terms(t)), len(plain_terms(t))) for i, t in docs]
    held = [x for x in held if x[2]]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in sorted(set((i, t) for i, t in items if t is not None), key=str):
        scores = []
        for i, c, size in held:
            m = 100 - 75 + (75 * size * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in plain_terms(text) if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(str(item), k, str(None if none else i), -s) for k, (s, none, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out)


def given(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def searched(docs, items):
    return sorted((str(r["item_id"]), r["rank"], str(r["doc_id"]), r["score"]) for r in lexical.search(docs, items).collect())


ITEMS = [(1, prose(30, 1)), (2, None), (3, ""), (4, "nowhere zzz"), (5, prose(25, 5)), (5, prose(25, 5)), (6, "ÄRGER café x²"), (7, " ".join([VOCABULARY[0]] * 5)), (None, prose(10, 9))]


@pytest.fixture(scope="module")
def items(spark):
    rows = ITEMS + [(i, prose(20, i)) for i in range(100, 140)]
    return spark.createDataFrame([(i, t, 1, "q") for i, t in rows], "item_id long, text string, rank int, query string")


def test_search_agrees_with_every_score(spark, odd, items, empty):
    assert searched(odd, items) == plain_search(given(odd, "doc_id", "text"), given(items, "item_id", "text"))
    assert lexical.search(empty, items).count() == 0 and lexical.search(odd, items.limit(0)).count() == 0


def test_search_in_small_parts_and_blocks(spark, odd, items, monkeypatch):
    want = plain_search(given(odd, "doc_id", "text"), given(items, "item_id", "text"))
    monkeypatch.setattr(lexical, "PART_POSTINGS", 300)
    monkeypatch.setattr(lexical, "FIRST_PARTS", 2)
    monkeypatch.setattr(lexical, "BLOCK_ROWS", 200)
    monkeypatch.setattr(lexical, "CELLS", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        assert searched(odd, items) == want
        monkeypatch.setattr(lexical, "HANDED_TERMS", 3)
        monkeypatch.setattr(lexical, "EXACT", 1)
        assert searched(odd, items) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_strata_below_a_query_s_best_are_not_visited(monkeypatch):
    import pyarrow as pa

    # 200 lengths; the word asked for is often in short texts and once in long ones
    lengths = [n for n in range(10, 2010, 10) for _ in range(5)]
    held = pa.table(
        {
            "segment": pa.array([1]),
            "term": pa.array([["w"] * 1000], pa.list_(pa.string())),
            "at": pa.array([list(range(1000))], pa.list_(pa.int32())),
            "tf": pa.array([[5 if n < 100 else 1 for n in lengths]], pa.list_(pa.int32())),
            "id": pa.array([list(range(1000))], pa.list_(pa.int64())),
            "n": pa.array([lengths], pa.list_(pa.int64())),
        }
    )
    part = lexical.Part(held, {"w": 0}, np.array([700]), 1000, sum(lengths))
    assert len(part.normal) > 100 and len(np.unique(part.impact)) <= len(part.normal)
    visited = []
    monkeypatch.setattr(lexical, "stratum_scores", lambda p, s, *a, f=lexical.stratum_scores: visited.append(s) or f(p, s, *a))
    ask = lexical.Queries(np.array([0, 1]), np.array([0]), np.array([1]))
    found = sorted(lexical.best_of(part, ask, np.zeros(1, np.int64), 10), key=lambda x: -x[3])
    assert sorted(x[1] for x in found) == list(range(10)) and len(visited) <= 7


# --- 12 ---------------------------------------------------------------------------------------------------------


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([[math.floor(4096 * c) for c in v] for _, v, _ in kept], object)
    width = x.shape[1] // parts
    cut = [x[:, p * width : (p + 1) * width] for p in range(parts)]
    books = [[list(r) for r in c[:entries]] for c in cut]

    def assign(p):
        out = []
        for v in cut[p]:
            d = [sum((a - b) ** 2 for a, b in zip(v, e)) for e in books[p]]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        for p in range(parts):
            own = assign(p)
            books[p] = [[sum(v[j] for v in of) // len(of) for j in range(width)] if (of := [v for v, (k, _) in zip(cut[p], own) if k == e]) else books[p][e] for e in range(len(books[p]))]
    final = [assign(p) for p in range(parts)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    errors = [sum(final[p][i][1] for p in range(parts)) for i in range(len(kept))]
    by_label = Counter()
    for (_, _, label), e in zip(kept, errors):
        by_label[label] += e
    return sorted((str(r[0]), "".join(f"{final[p][i][0]:02x}" for p in range(parts)), errors[i], by_label[r[2]], digest) for i, r in enumerate(kept))


def coded(df):
    return sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in codes.compressed(df).collect())


VECTORS = "vec_id long, embedding array<float>, label int, code string, error long, `of` int, ids long"


def vectors_of(n, seed, kind=0):
    r = np.random.default_rng(seed)
    centres = r.normal(0, 0.3, (6, 16))
    x = centres[r.integers(0, 6, n)] + r.normal(0, 0.05, (n, 16))
    if kind:  # few different values: ties, equal entries and unused ones
        x = np.round(x * 2) / 2
    return [(int(i), [float(np.float32(c)) for c in v], int(i) % 3 if i % 7 else None, "x", 1, 2, 3) for i, v in enumerate(x)]


@pytest.mark.parametrize("kind", [0, 1])
def test_codes_agree_with_plain_rounds(spark, monkeypatch, kind):
    rows = vectors_of(300, 4, kind)
    rows += [(500, None, 1, "x", 1, 2, 3), (501, [None] + [0.0] * 15, 1, "x", 1, 2, 3), (-3, [float("nan")] * 16, 1, "x", 1, 2, 3), (-4, [float("inf")] + [1.0] * 15, 0, "x", 1, 2, 3)]
    rows += [rows[10], rows[10], (None, rows[3][1], None, None, None, None, None)]
    monkeypatch.setattr(codes.chunked, "__defaults__", (64,))
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    assert coded(df) == plain_codes([r[:3] for r in rows])


def test_codes_of_few_no_and_unequal_vectors(spark):
    rows = vectors_of(5, 1)
    assert coded(spark.createDataFrame(rows, VECTORS)) == plain_codes([r[:3] for r in rows])
    assert codes.compressed(spark.createDataFrame([], VECTORS)).count() == 0
    unequal = [(9, [1.0] * 8, 1, "", 0, 0, 0), (10, [], 1, "", 0, 0, 0), (-1, [1.0] * 9, 1, "", 0, 0, 0)]
    assert coded(spark.createDataFrame(rows + unequal, VECTORS)) == plain_codes([r[:3] for r in rows])


@pytest.mark.parametrize("n", [1, 2, 40, 3000])
def test_trees_give_plain_sums(n):
    r = np.random.default_rng(n)
    for spread in (0, 1, 300):
        points = (r.integers(-2, 3, (n, 6)) if not spread else r.normal(0, spread, (n, 6)) + r.normal(0, 900, (8, 6))[r.integers(0, 8, n)]).astype(np.int64)
        tree = codes.Tree.unpacked(codes.grown(points).packed(), n, 6)
        assert sorted(tree.order.tolist()) == list(range(n))
        for b in range(len(tree.n)):
            own = points[tree.order[tree.start[b] : tree.stop[b]]]
            assert (own.sum(0) == tree.sums[b]).all()
            assert np.sqrt(((own - points[tree.pivot[b]]) ** 2).sum(1)).max() <= tree.radius[b] + 1e-9
        entries = np.vstack([points[:12], points[:2]])
        want = codes.distances(points, entries).argmin(1)
        assert (codes.nearest(tree, points, entries) == want).all()
        sums, counts = codes.entry_sums(tree, points, entries)
        for e in range(len(entries)):
            assert (sums[e] == points[want == e].sum(0)).all() and counts[e] == (want == e).sum()


def test_points_of_a_tight_cluster_come_with_their_ball():
    r = np.random.default_rng(1)
    centres = r.normal(0, 900, (8, 6)).astype(np.int64)
    points = centres[r.integers(0, 8, 3000)] + r.integers(-3, 4, (3000, 6))
    balls, owner, places, _ = codes.walked(tree := codes.grown(points), points, centres)
    assert len(places) == 0 and len(balls) < 100
    assert sorted(np.concatenate([tree.order[tree.start[b] : tree.stop[b]] for b in balls]).tolist()) == list(range(3000))


# --- 13 ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n,bits", [(1, 4), (2, 3), (3, 2), (4, 2)])
def test_the_curve_visits_neighbours(spark, n, bits):
    points = list(itertools.product(range(1 << bits), repeat=n))
    df = spark.createDataFrame(points, ", ".join(f"c{i} int" for i in range(n)))
    rows = df.select("*", sharding.hilbert([F.col(f"c{i}") for i in range(n)], bits).alias("place")).orderBy("place").collect()
    assert [r["place"] for r in rows] == list(range(len(points)))
    assert all(sum(abs(a[i] - b[i]) for i in range(n)) == 1 for a, b in zip(rows, rows[1:]))


def plain_tiles(values, bits):
    """Tile of every value: nulls last, numbers by their class, texts by code point."""

    def key(v):
        if v is None:
            return (2, 0)
        return (0, math.floor(math.copysign(math.log2(abs(v) + 1), v) * sharding.PER_OCTAVE)) if isinstance(v, int) else (1, v)

    keys = [key(v) for v in values]
    counts, seen, out = Counter(keys), 0, {}
    for k in sorted(counts):
        out[k] = (2 * seen + counts[k]) * (1 << bits) // (2 * len(values))
        seen += counts[k]
    return [out[k] for k in keys]


def test_tiles_follow_the_distribution(odd):
    names = ["source", "lang", "n_chars", "doc_id"]
    rows = sharding.quantised(odd, names, 4, "tiles").collect()
    want = list(zip(*[plain_tiles([r[n] for r in rows], 4) for n in names]))
    assert [tuple(r["tiles"]) for r in rows] == want


@pytest.mark.parametrize("law", sharding.LAWS)
def test_shards_keep_their_law(odd, empty, law):
    rows = sharding.placed(odd, 8, law).collect()
    sizes = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in given(odd, "doc_id", "text"))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == sizes
    rows.sort(key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve"] for r in rows] == sorted(r["curve"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    assert all([r["slot"] for r in own] == list(range(len(own))) for own in by.values())
    if law == "rows":
        counts = [len(by.get(k, [])) for k in range(8)]
        assert max(counts) - min(counts) <= 1
    else:
        upto, total = 0, sum(r["size"] for r in rows)
        for r in rows:
            assert r["shard"] == (upto + r["size"] // 2) * 8 // total
            upto += r["size"]
    again = sharding.placed(odd.repartition(7), 8, law).collect()
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(map(key, again)) == sorted(map(key, rows))
    assert sharding.placed(empty, 8, law).count() == 0
    with pytest.raises(ValueError):
        sharding.placed(odd, 8, "names")


def test_written_shards_can_be_skipped(spark, tmp_path):
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('t', id) AS text", "concat('s', id % 8) AS source", "concat('l', id % 4) AS lang", "(id * 7919) % 4000 AS n_chars")
    path = str(tmp_path / "shards")
    manifest = sharding.write_shards(docs, path, 16).collect()
    back = spark.read.parquet(path)
    assert back.count() == 4000 and set(back.columns) == {*docs.columns, "shard"}
    assert sum(r["rows"] for r in manifest) == 4000 and {r["rows"] for r in manifest} == {250}
    found = {(r["shard"], r["n"]) for r in back.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    assert found == {(r["shard"], r["rows"]) for r in manifest}
    # a filter on any one dimension leaves files out
    for column, value in (("source", "s3"), ("n_chars", 100), ("doc_id", 100)):
        hit = [r for r in manifest if r["lo"][column] <= value <= r["hi"][column]]
        assert 0 < len(hit) <= 12, column


# --- queries ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op11_lexical_search", "op12_vector_codes"])
def test_query_agrees_with_its_sql_at_the_next_size(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(queries.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(map(str, map(tuple, queries.QUERIES[name](spark, sf).select(*names).collect()))) == sorted(map(str, want.fetchall()))
