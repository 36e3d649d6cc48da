"""Vector codes by product quantisation, whose rounds walk anchors-hierarchy metric trees instead of single vectors.

Vectors are cut into parts, and each part position has a codebook that rounds of exact k-means refine. A chunk of
vectors gets one tree per part position, built middle-out: anchors far apart take the points nearer to them than to
other anchors (a new anchor looks only at points that may be nearer to it), neighbouring anchors are merged into
balls upwards, and each anchor's own points are treated likewise downwards. Every ball caches the sum and the count of
its points. A round walks the tree with a list of candidate entries: an entry that is farther than another one from
every point of a ball leaves the ball's list for good, and a ball whose list has one entry is that entry's with all its
points, by its cached sums. Only the points of leaves with several candidates are measured. Components are integers and
so are sums and distances; a candidate is dropped only beyond a margin for rounding, so the codes are those of plain
k-means.

Spark deals the chunks, adds up their sums per entry (one row per entry and chunk) and hands the next codebooks on:
parts * entries * width integers, whatever the number of vectors. Trees are written once to the shared folder.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from officelake.llm.common import pinned, small_side

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors of a chunk, whose trees one row holds.
CHUNK = 4096
#: Points of a ball that is not divided further.
LEAF = 24
#: A difference that rounding can't bring about, as a share of the numbers compared.
MARGIN = 1e-9

CHUNK_SCHEMA = "ids array<long>, labels array<int>, points binary, trees array<binary>"


def limit_of(width: int) -> int:
    """The largest size of a component for which squared distances over ``width`` components fit 62 bits."""
    return 1 << ((62 - max(width - 1, 0).bit_length()) // 2 - 1)


def distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances, exact, of all points to all entries."""
    out = np.zeros((len(points), len(entries)), np.int64)
    for j in range(points.shape[1]):
        d = points[:, j, None] - entries[None, :, j]
        out += d * d
    return out


# --- trees ------------------------------------------------------------------------------------------------------


@dataclass
class Tree:
    """Balls in breadth-first order: children of a ball stand at ``first`` and the ``n`` places from there, or n is 0.

    A ball's points are ``order[start:stop]``, their sum is ``sums``, and ``pivot`` is the place of its centre among
    all points.
    """

    order: np.ndarray
    pivot: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    first: np.ndarray
    n: np.ndarray
    radius: np.ndarray
    sums: np.ndarray

    def packed(self) -> bytes:
        ints = [self.order, self.pivot, self.start, self.stop, self.first, self.n]
        return b"".join(x.astype("<i4").tobytes() for x in ints) + self.radius.astype("<f8").tobytes() + self.sums.astype("<i8").tobytes()

    @staticmethod
    def unpacked(raw: bytes, points: int, width: int) -> Tree:
        balls = (len(raw) - 4 * points) // (5 * 4 + 8 + 8 * width)
        ints = np.frombuffer(raw, "<i4", points + 5 * balls).astype(np.int64)
        at = 4 * (points + 5 * balls)
        sums = np.frombuffer(raw, "<i8", balls * width, at + 8 * balls).reshape(balls, width)
        return Tree(ints[:points], *ints[points:].reshape(5, balls), np.frombuffer(raw, "<f8", balls, at), sums)


def anchors(points: np.ndarray, at: np.ndarray, wanted: int) -> tuple[list[np.ndarray], list[int]]:
    """(points of each anchor, the anchor's own place): ``at`` dealt to ``wanted`` anchors at most.

    The next anchor is the point farthest from its anchor. It takes points that are nearer to it; of another anchor's
    points, sorted from far to near, those nearer than half the anchors' distance stay unasked.
    """
    x = points[at].astype(np.float64)
    far = np.sqrt(((x - x[0]) ** 2).sum(1))
    by = np.argsort(-far, kind="stable")
    owned, lengths, centres = [by], [far[by]], [0]
    while len(owned) < wanted:
        widest = max(range(len(owned)), key=lambda k: lengths[k][0])
        if lengths[widest][0] == 0:
            break
        new = int(owned[widest][0])
        taken, taken_far = [], []
        for k, centre in enumerate(centres):
            between = np.sqrt(((x[new] - x[centre]) ** 2).sum())
            ask = int(np.searchsorted(-lengths[k], -between / 2, "right"))  # these lie at half the distance or beyond
            if not ask:
                continue
            own = owned[k][:ask]
            there = np.sqrt(((x[own] - x[new]) ** 2).sum(1))
            nearer = there < lengths[k][:ask]
            if nearer.any():
                taken.append(own[nearer])
                taken_far.append(there[nearer])
                stay = np.concatenate([~nearer, np.ones(len(owned[k]) - ask, bool)])
                owned[k], lengths[k] = owned[k][stay], lengths[k][stay]
        mine, mine_far = np.concatenate(taken), np.concatenate(taken_far)
        by = np.argsort(-mine_far, kind="stable")
        owned.append(mine[by])
        lengths.append(mine_far[by])
        centres.append(new)
    return [at[o] for o in owned], [int(at[c]) for c in centres]


def merged(points: np.ndarray, centres: list[int], radii: list[float], sizes: list[int]) -> tuple:
    """Nested pairs of anchor numbers: the two whose common ball is smallest are merged first."""
    place = points[np.array(centres)].astype(np.float64)
    radius, weight = np.array(radii), np.array(sizes, np.float64)
    nodes: list = list(range(len(centres)))
    gaps = np.sqrt(np.maximum(((place[:, None] - place[None]) ** 2).sum(2), 0))
    cost = (gaps + radius[:, None] + radius[None]) / 2
    np.fill_diagonal(cost, np.inf)
    for _ in range(len(nodes) - 1):
        i, j = divmod(int(cost.argmin()), len(nodes))
        nodes[i] = (nodes[i], nodes[j])
        radius[i] = max(cost[i, j], radius[i], radius[j])
        place[i] = (weight[i] * place[i] + weight[j] * place[j]) / (weight[i] + weight[j])
        weight[i] += weight[j]
        cost[j] = cost[:, j] = np.inf
        gap = np.sqrt(((place - place[i]) ** 2).sum(1))
        cost[i] = cost[:, i] = np.where(np.isfinite(cost[i]), (gap + radius[i] + radius) / 2, np.inf)
        cost[i, i] = np.inf
        top = nodes[i]
    return top


def grown(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """The anchors hierarchy of all points."""
    def build(at: np.ndarray) -> dict:
        if len(at) > leaf:
            owned, centres = anchors(points, at, max(2, int(np.sqrt(len(at)))))
            if len(owned) > 1:
                radii = [float(np.sqrt(((points[o].astype(np.float64) - points[c]) ** 2).sum(1)).max()) for o, c in zip(owned, centres)]
                parts = [build(o) for o in owned]

                def joined(node) -> dict:
                    return parts[node] if not isinstance(node, tuple) else {"children": [joined(x) for x in node]}

                return joined(merged(points, centres, radii, [len(o) for o in owned]))
        return {"at": at}

    root = build(np.arange(len(points)))
    order: list[np.ndarray] = []
    placed = 0

    def number(node: dict) -> np.ndarray:
        nonlocal placed
        node["start"] = placed
        if "at" in node:
            order.append(node["at"])
            placed += len(node["at"])
            node["stop"] = placed
            return node["at"]
        at = np.concatenate([number(c) for c in node["children"]])
        node["stop"] = placed
        return at

    number(root)
    places = np.concatenate(order) if order else np.zeros(0, np.int64)
    balls = [root]
    for node in balls:  # grows as children are put behind
        children = node.get("children", [])
        node["first"] = len(balls)
        balls.extend(children)
    pivot, radius, sums = [], [], []
    for node in balls:
        at = places[node["start"] : node["stop"]]
        x = points[at].astype(np.float64)
        k = int(((x - x.mean(0)) ** 2).sum(1).argmin())
        pivot.append(int(at[k]))
        radius.append(float(np.sqrt(((x - x[k]) ** 2).sum(1).max())))
        sums.append(points[at].sum(0))
    ints = [np.array([f(b) for b in balls], np.int64) for f in (lambda b: b["start"], lambda b: b["stop"], lambda b: b["first"], lambda b: len(b.get("children", [])))]
    return Tree(places, np.array(pivot), *ints, np.array(radius), np.array(sums))


def walked(tree: Tree, points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(balls, their entry, places, their entry): balls owned as a whole, and the points of all others."""
    same = (entries[:, None] == entries[None]).all(2)
    first_of_equals = ~np.triu(same, 1).any(0)  # the others lose every tie
    apart = np.sqrt(((entries[:, None].astype(np.float64) - entries[None]) ** 2).sum(2))
    balls, lists = np.zeros(1, np.int64), first_of_equals[None]
    owned, owners, places, open_lists = [], [], [], []
    while len(balls):
        d = distances(points[tree.pivot[balls]], entries).astype(np.float64)
        best = np.where(lists, d, np.inf).argmin(1)
        least = d[np.arange(len(balls)), best][:, None]
        # over the ball, the two squared distances differ by at least this much less the reach
        reach = 2 * tree.radius[balls, None] * apart[best]
        lists = lists & ~(d - least > reach + MARGIN * (d + least + reach + 1))
        one = lists.sum(1) == 1
        owned.append(balls[one])
        owners.append(best[one])
        leaf = ~one & (tree.n[balls] == 0)
        places += [tree.order[a:b] for a, b in zip(tree.start[balls[leaf]], tree.stop[balls[leaf]])]
        open_lists.append(np.repeat(lists[leaf], (tree.stop - tree.start)[balls[leaf]], axis=0))
        inner = ~one & (tree.n[balls] > 0)
        n = tree.n[balls[inner]]
        balls = np.repeat(tree.first[balls[inner]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        lists = np.repeat(lists[inner], n, axis=0)
    rest = np.concatenate([np.zeros(0, np.int64), *places])
    measured = np.where(np.concatenate(open_lists), distances(points[rest], entries), np.iinfo(np.int64).max)
    return np.concatenate(owned), np.concatenate(owners), rest, measured.argmin(1) if len(rest) else rest


def entry_sums(tree: Tree, points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and number of the points of every entry; owned balls give what they have cached."""
    sums, counts = np.zeros(entries.shape, np.int64), np.zeros(len(entries), np.int64)
    balls, owner, places, entry = walked(tree, points, entries)
    np.add.at(sums, owner, tree.sums[balls])
    np.add.at(counts, owner, (tree.stop - tree.start)[balls])
    np.add.at(sums, entry, points[places])
    np.add.at(counts, entry, 1)
    return sums, counts


def nearest(tree: Tree, points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The entry of every point."""
    out = np.empty(len(points), np.int64)
    balls, owner, places, entry = walked(tree, points, entries)
    for a, b, e in zip(tree.start[balls], tree.stop[balls], owner):
        out[tree.order[a:b]] = e
    out[places] = entry
    return out


# --- Spark ------------------------------------------------------------------------------------------------------


def kept_vectors(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, label, vector) of the rows whose vector has only finite components."""
    v = F.col(vector)
    sound = v.isNotNull() & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    label = F.col("label") if "label" in vectors.columns else F.lit(None)
    return vectors.where(sound).select(F.col(id_column).cast("long").alias("vec_id"), label.cast("int").alias("label"), v.cast("array<double>").alias("vector"))


def _integers(vectors: list, length: int, width: int) -> np.ndarray:
    x = np.array(vectors, np.float64).reshape(-1, length)
    most = limit_of(width)
    return np.clip(np.floor(x * SCALE), -most, most).astype(np.int64)


def chunked(kept: DataFrame, length: int, parts: int, size: int = CHUNK) -> DataFrame:
    """One row per chunk of at most ``size`` vectors: ids, labels, integer components, and a tree per part position."""
    import pyarrow as pa

    width = length // parts

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, size):
                b = batch.slice(k, size)
                points = _integers(b.column("vector").to_pylist(), length, width)
                trees = [grown(points[:, p * width : (p + 1) * width]).packed() for p in range(parts)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b.column("vec_id").to_pylist()], pa.list_(pa.int64())),
                        pa.array([b.column("label").to_pylist()], pa.list_(pa.int32())),
                        pa.array([points.astype("<i8").tobytes()], pa.binary()),
                        pa.array([trees], pa.list_(pa.binary())),
                    ],
                    ["ids", "labels", "points", "trees"],
                )

    return kept.mapInArrow(run, CHUNK_SCHEMA)


def _of_chunk(row: dict, length: int, width: int):
    points = np.frombuffer(row["points"], "<i8").reshape(-1, length)
    for p, raw in enumerate(row["trees"]):
        yield np.ascontiguousarray(points[:, p * width : (p + 1) * width]), Tree.unpacked(raw, len(points), width)


def refined(chunks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The next codebooks (part, entry, component): every entry the floored mean of its parts, unused ones as they are."""
    import pyarrow as pa

    parts, entries, width = books.shape

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                out = [entry_sums(tree, points, books[p]) for p, (points, tree) in enumerate(_of_chunk(row, parts * width, width))]
                counts = np.concatenate([c for _, c in out])
                used = np.flatnonzero(counts)
                sums = np.concatenate([s for s, _ in out])[used]
                yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used]), pa.array(sums.tolist(), pa.list_(pa.int64()))], ["entry", "n", "sums"])

    found = chunks.select("points", "trees").mapInArrow(run, "entry long, n long, sums array<long>")
    total = found.groupBy("entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(j))).alias(f"s{j}") for j in range(width)])
    out = books.copy().reshape(parts * entries, width)
    for row in total.collect():  # parts * entries rows at most
        out[row["entry"]] = [row[f"s{j}"] // row["n"] for j in range(width)]
    return out.reshape(books.shape)


def fitted(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(chunks, codebooks) after ``rounds`` rounds from the vectors with the smallest ids (nulls last, then by components).

    All vectors must be as long as the first one whose length ``parts`` divides; rows of another length are left out,
    and without any vector there are no chunks and no entries.
    """
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").where(F.size("vector") >= parts).where(F.size("vector") % parts == 0).limit(1).collect()
    length = len(first[0]["vector"]) if first else parts
    kept = kept.where(F.size("vector") == length)
    seeds = [r["vector"] for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()]
    width = length // parts
    chunks = pinned(chunked(kept, length, parts), "vector-trees")
    books = np.ascontiguousarray(_integers(seeds, length, width).reshape(-1, parts, width).transpose(1, 0, 2))
    for _ in range(rounds if seeds else 0):
        before, books = books, refined(chunks, books)
        if (before == books).all():
            break
    return chunks, books


def encoded(chunks: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error): indexes of the nearest entries in part order, two hex digits each, and squared distances."""
    import pyarrow as pa

    parts, _, width = books.shape

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                codes, error = [], np.zeros(len(row["ids"]), np.int64)
                for p, (points, tree) in enumerate(_of_chunk(row, parts * width, width)):
                    entry = nearest(tree, points, books[p])
                    codes.append(entry)
                    error += ((points - books[p][entry]) ** 2).sum(1)
                code = [bytes(c).hex() for c in np.array(codes, np.uint8).T]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], pa.int64()), pa.array(row["labels"], pa.int32()), pa.array(code, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"]
                )

    return chunks.mapInArrow(run, "vec_id long, label int, code string, error long")


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, in decimal, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every kept row of ``vectors``.

    Null vectors and those with null or non-finite components are left out, as are vectors of another length than the
    first one (by id) whose length ``parts`` divides; components beyond ``limit_of`` in size are taken as that limit. Null ids count as the largest ones, equal ids are ordered by their
    components, repeated rows each get a code, null labels are one label, and an empty table gives no rows. With
    fewer vectors than ``entries`` there are as many entries as vectors. Other columns are not read.
    """
    if not 0 < entries <= 256:
        raise ValueError("an index must fit two hex digits")
    chunks, books = fitted(kept_vectors(vectors), parts, entries, rounds)
    rows = pinned(encoded(chunks, books), "vector-codes")
    sums = rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return rows.join(small_side(sums), F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def codes_sql(vectors: str = "embeddings", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same by plain k-means in SQL, every part measured against every entry in every round."""
    nearest = """near{k} AS MATERIALIZED (
  SELECT vec_id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
    SELECT p.vec_id, p.part, b.entry, list_sum(list_transform(list_zip(p.xs, b.xs), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM cut p JOIN book{k} b USING (part)) GROUP BY ALL)"""
    refined = """book{j} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.xs, b.xs) AS xs FROM book{k} b LEFT JOIN (
    SELECT part, entry, list(x ORDER BY pos) AS xs FROM (
      SELECT n.part, n.entry, pos, floor(sum(p.xs[pos])::DOUBLE / count(*))::BIGINT AS x
      FROM near{k} n JOIN cut p USING (vec_id, part), range(1, len(p.xs) + 1) r(pos) GROUP BY ALL) GROUP BY part, entry) m USING (part, entry))"""
    steps = [nearest.format(k=0)]
    for k in range(rounds):
        steps += [refined.format(k=k, j=k + 1), nearest.format(k=k + 1)]
    return f"""WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM {vectors}
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS MATERIALIZED (
  SELECT vec_id, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS xs FROM kept, range({parts}) r(part)),
book0 AS MATERIALIZED (
  SELECT part, entry, xs FROM cut JOIN (
    SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {entries}) USING (vec_id)),
{', '.join(steps)},
coded AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
  FROM near{rounds} JOIN kept USING (vec_id) GROUP BY vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(xs, ','), ',' ORDER BY part, entry)) FROM book{rounds}) AS codebooks_sha256
FROM coded"""
