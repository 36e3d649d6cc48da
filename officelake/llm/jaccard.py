"""Jaccard join on word shingles by partitioning the universe of shingles.

Sets of sizes that can meet form a band. For a band, the symmetric difference of a pair that links is at most H, so the
shingles are hashed into parts that together need more than H differences to all change. A part with k differences
spared is indexed by what such a change must leave equal:

* exact: one signature, the part itself (spares 0);
* subsets: the part is cut in ``CUTS`` segments, and each choice of all but one is a signature (spares 1);
* one deletion: the part and each part with one shingle taken out (spares 1);
* fullest: there are more parts than needed, and a set is indexed by as many of its fullest ones as need more than its
  own differences to all change (spares 0). Of P parts linked sets have P - h in common, so in any order that all sets
  share, here by what parts hold, one of the first h + 1 of either is in both.

Which of them a band uses is decided by cost: signatures to shuffle against sets that would meet by chance, from
the number and size of the sets in the band. The last one is for links of less than ``PARTS_FROM`` per cent, where parts
hold so few shingles that unrelated sets meet in empty ones. On request a set is indexed by its prefix instead: its first
n - ceil(t n) + 1 shingles in an order that all sets share, of which linked sets have one in common; any order is exact.

Sets that share a signature form families (connected candidates); within a
family every pair that is not yet linked is verified exactly, by shingle sets.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from dataclasses import dataclass
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from officelake.llm.common import WORD, components, pinned, small_side, texts

#: Segments of a part in the subset form.
CUTS = 3
#: Bands grow by this factor.
GROWTH = 1.25
#: What a set that meets another by chance costs, in signatures.
CHANCE_COST = 50.0
#: Shingles of the sets verified together in one task; larger families are verified by ranges of size, and blocks of them.
BLOCK = 2_000_000
FORMS = ("exact", "subsets", "deletion")
#: Links of fewer per cent may be found by the fullest parts.
PARTS_FROM = 85
#: Parts of the fullest form for each that differences can change.
SPARE = 1.15
#: Shingles that are counted for the order of prefixes, about; decides what is compared, not what is found.
ORDER_SHINGLES = 1 << 26


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: near inputs get unrelated outputs."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_code(word: str) -> int:
    """64 bits of a word."""
    import xxhash

    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


def shingles(text: str, size: int, known: dict[str, int]) -> np.ndarray:
    """Sorted distinct 64-bit codes of the word shingles of a whole text; the whole sequence where it is shorter."""
    words = WORD.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))
    if not words:
        return np.zeros(0, np.uint64)
    codes = []
    for w in words:
        c = known.get(w)
        if c is None:
            c = known[w] = word_code(w)
        codes.append(c)
    c = np.array(codes, dtype=np.uint64)
    n = min(size, len(c))
    out = np.full(len(c) - n + 1, np.uint64(len(c) if n < size else size))
    for k in range(n):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + c[k : len(c) - n + 1 + k])
    return np.unique(out)


def set_code(tokens: np.ndarray) -> int:
    """One signed 64-bit code of a whole set."""
    total = mixed(tokens ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(tokens))
    return int(mixed(np.array([total], np.uint64)).view(np.int64)[0])


def _edges() -> list[int]:
    out = [1]
    while out[-1] < 1 << 50:
        out.append(max(out[-1] + 1, int(out[-1] * GROWTH)))
    return out


#: Band b holds the sizes from EDGES[b] to EDGES[b + 1] - 1.
EDGES = _edges()


def bands(n: int, percent: int) -> list[int]:
    """Bands in which a set of n may meet another: its own, and higher ones that a linked set may lie in.

    A pair meets in the band of its larger set.
    """
    b = bisect_right(EDGES, n) - 1
    out = [b]
    while 100 * n >= percent * EDGES[out[-1] + 1]:
        out.append(out[-1] + 1)
    return out


def differences(b: int, percent: int) -> int:
    """Most shingles in just one of two linked sets whose larger one is in band b."""
    top = EDGES[b + 1] - 1
    # |x ∩ y| >= t (|x| + |y|) / (1 + t), so |x Δ y| <= (1 - t) / (1 + t) * 2 top
    return 2 * top * (100 - percent) // (100 + percent)


def reach(n: int, b: int, percent: int) -> int:
    """Most shingles in just one of a set of n and another linked with it, the larger of them in band b."""
    top = min(EDGES[b + 1] - 1, 100 * n // percent)
    return (n + top) * (100 - percent) // (100 + percent)


@dataclass(frozen=True)
class Allocation:
    """How a band is indexed: the form and the number of parts, and for the fullest form what per cent link."""

    form: str
    parts: int
    percent: int = 0


def allocate(b: int, sets: int, percent: int) -> Allocation:
    """The cheapest form for a band of ``sets`` sets: signatures, and chance meetings of parts with few shingles.

    Two sets meet by chance where both have no, or the same few, shingles in what a signature covers; its mean number
    of shingles m makes that about exp(-m) of them.
    """
    h = differences(b, percent)
    n = (EDGES[b] + EDGES[b + 1]) / 2
    best = None
    for form in FORMS if percent >= PARTS_FROM else (*FORMS, "fullest"):
        spared = 1 if form in ("exact", "fullest") else 2
        parts = h // spared + 1 if form != "fullest" else math.ceil(SPARE * (h + 1)) + 2
        held = n / parts
        if form == "exact":
            rows, cover = parts, held
        elif form == "fullest":  # an empty part is among the fullest where all but h are empty
            rows, cover = h + 1, held * (parts - h)
        elif form == "subsets":
            rows, cover = parts * CUTS, held * (CUTS - 1) / CUTS
        else:
            rows, cover = n + parts, max(0.0, held - 1)
        alone = math.exp(-cover) if parts > 1 or form == "subsets" else 0.0
        cost = rows + CHANCE_COST * rows * min(1.0, sets * alone * alone)
        if best is None or cost < best[0]:
            best = (cost, Allocation(form, parts, percent if form == "fullest" else 0))
    return best[1]


def signatures(tokens: np.ndarray, b: int, how: Allocation) -> np.ndarray:
    """The 64-bit signatures of a set in band b; linked sets that meet in this band share one at least."""
    salt = np.uint64((b + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    spread = mixed(tokens ^ salt)
    part = (spread % np.uint64(how.parts)).astype(np.int64)
    weight = mixed(spread + np.uint64(0xD1342543DE82EF95))
    name = mixed(np.arange(how.parts, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407) + salt)
    order = np.argsort(part, kind="stable")
    at = np.searchsorted(part[order], np.arange(how.parts + 1))
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weight[order], dtype=np.uint64)])
    total = running[at[1:]] - running[at[:-1]]
    if how.form == "exact":
        return mixed(total + name)
    if how.form == "fullest":
        codes = mixed(total + name)
        return codes[np.lexsort((codes, -np.diff(at)))[: reach(len(tokens), b, how.percent) + 1]]
    if how.form == "deletion":
        return np.unique(np.concatenate([mixed(total + name), mixed(total[part] - weight + name[part])]))
    cut = ((spread // np.uint64(how.parts)) % np.uint64(CUTS)).astype(np.int64)
    out = []
    for c in range(CUTS):
        keep = (cut != c)[order]
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.where(keep, weight[order], np.uint64(0)), dtype=np.uint64)])
        out.append(mixed(running[at[1:]] - running[at[:-1]] + name * np.uint64(2 * c + 3)))
    return np.concatenate(out)


@dataclass(frozen=True)
class Order:
    """Of the counted shingles (those whose place is below ``upto``) the ones seen in several sets, sorted, and in how many."""

    codes: np.ndarray
    seen: np.ndarray
    upto: int

    def prefix(self, tokens: np.ndarray, percent: int) -> np.ndarray:
        """The shingles of a set of which one at least is in the prefix of every set linked with it.

        Shingles known to be in one set only come first, then those that weren't counted, then the others, rare ones first.
        """
        place = places(tokens)
        rank = np.ones(len(tokens), np.int64)
        counted = np.flatnonzero(place <= np.uint64(self.upto))
        if len(self.codes):
            at = np.minimum(np.searchsorted(self.codes, tokens[counted]), len(self.codes) - 1)
            rank[counted] = np.where(self.codes[at] == tokens[counted], self.seen[at], 0)
        else:
            rank[counted] = 0
        keep = len(tokens) - -(-percent * len(tokens) // 100) + 1
        return tokens[np.lexsort((place, rank))[:keep]]


def places(tokens: np.ndarray) -> np.ndarray:
    """A place of each shingle that has nothing to do with how common it is."""
    return mixed(tokens ^ np.uint64(0x2545F4914F6CDD1D))


def sampled_order(docs: DataFrame, groups: DataFrame, size: int) -> Order:
    """The order of prefixes: about ``ORDER_SHINGLES`` of the shingles of all different sets, chosen by their place, counted."""
    import pyarrow as pa

    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    upto = (1 << 64) - 1 if total <= ORDER_SHINGLES else int(ORDER_SHINGLES / total * (1 << 64))

    def run(batches):
        for b in batches:
            known: dict[str, int] = {}
            sets = [np.zeros(0, np.uint64)]
            for t in b.column("text").to_pylist():
                s = shingles(t, size, known)
                sets.append(s[places(s) <= np.uint64(upto)])
            codes, seen = np.unique(np.concatenate(sets), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(seen.astype(np.int32))], ["code", "seen"])

    firsts = groups.select(F.col("first").alias("doc_id")).distinct()
    counted = texts(docs).join(small_side(firsts), "doc_id", "left_semi").select("text").mapInArrow(run, "code long, seen int")
    common = counted.groupBy("code").agg(F.sum("seen").cast("int").alias("seen")).where("seen > 1").toArrow()
    codes, seen = common.column("code").to_numpy().view(np.uint64), common.column("seen").to_numpy()
    order = np.argsort(codes)
    return Order(codes[order], 1 + seen[order], upto)


def described(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, code): the set of every row in brief."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            known: dict[str, int] = {}
            sets = [shingles(t, size, known) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_code(s) for s in sets], pa.int64())],
                ["doc_id", "n_shingles", "code"],
            )

    return texts(docs).mapInArrow(run, "doc_id long, n_shingles long, code long")


def _met(docs: DataFrame, size: int, percent: int, plan: dict[int, Allocation], order: Order | None = None) -> DataFrame:
    """(key, code, pivot) of every signature (with ``order``, of every shingle of a prefix, by band); sets of one batch that share one have met, and only one of them goes on.

    A set that met another within its batch is sent once, under a key of its own, with that other as ``pivot``, so a
    signature that very many sets share reaches the shuffle once per batch.
    """
    import pyarrow as pa

    handed = docs.sparkSession.sparkContext.broadcast(order)

    def keys(s: np.ndarray) -> list[np.ndarray]:
        held = [k for k in bands(len(s), percent) if k in plan]
        if handed.value is None:
            return [signatures(s, k, plan[k]) for k in held]
        first = handed.value.prefix(s, percent) if held else s
        return [mixed(first + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) for k in held]

    def run(batches):
        for b in batches:
            known: dict[str, int] = {}
            seen: dict[int, np.ndarray] = {}
            none = np.zeros(0, np.uint64)
            for t in b.column("text").to_pylist():
                s = shingles(t, size, known)
                if len(s):
                    code = set_code(s)
                    if code not in seen:
                        seen[code] = np.concatenate([none, *keys(s)])
            if not seen:
                continue
            owners = np.repeat(np.fromiter(seen, np.int64, len(seen)), [len(v) for v in seen.values()])
            key = np.concatenate(list(seen.values()))
            if not len(key):
                continue
            order = np.lexsort((owners, key))
            key, owners = key[order], owners[order]
            first = np.concatenate([[True], key[1:] != key[:-1]])
            pivots = owners[first][np.cumsum(first) - 1]
            late = owners != pivots
            links = np.unique(np.stack([owners[late], pivots[late]], axis=1), axis=0) if late.any() else np.zeros((0, 2), np.int64)
            own = mixed(links[:, 0].view(np.uint64) + mixed(links[:, 1].view(np.uint64)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([key[first].view(np.int64), own.view(np.int64)])),
                    pa.array(np.concatenate([owners[first], links[:, 0]])),
                    pa.array(np.concatenate([owners[first], links[:, 1]])),
                ],
                ["key", "code", "pivot"],
            )

    return texts(docs).select("text").mapInArrow(run, "key long, code long, pivot long")


def verified(sets: list[np.ndarray], names: list[int], percent: int, side: list[int] | None = None) -> list[tuple[int, int]]:
    """Links (a, b) that join all sets linked with one another, each checked exactly; a spanning forest of them.

    With ``side``, only pairs on different sides are looked at. Sets are taken in order of size and looked up by their
    rarest shingles: linked sets share one of the first (1 - t) of either's in any common order. Pairs that are
    already joined are skipped.
    """
    n = len(sets)
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    lengths = np.fromiter((len(s) for s in sets), np.int64, n)
    flat = np.concatenate(sets)
    codes, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(codes), np.int64)
    rank[np.lexsort((codes, count))] = np.arange(len(codes))
    ranked = rank[inverse]
    ends = np.cumsum(lengths)
    rows = [np.sort(ranked[e - k : e]) for e, k in zip(ends, lengths)]
    index: dict[int, list[int]] = {}
    out = []
    held = np.zeros(len(codes), bool)
    for i in np.argsort(lengths, kind="stable"):
        row, m = rows[i], int(lengths[i])
        prefix = row[: m - -(-percent * m // 100) + 1]
        near: set[int] = set()
        for r in prefix:
            near.update(index.get(int(r), ()))
        if near:
            held[row] = True
            mine = root(int(i))
            for j in sorted(near, key=lambda k: -lengths[k]):
                k = int(lengths[j])
                if 100 * k < percent * m or (side is not None and side[i] == side[j]) or root(j) == mine:
                    continue
                both = int(held[rows[j]].sum())
                if 100 * both >= percent * (m + k - both):
                    out.append((names[i], names[j]))
                    parent[root(j)] = mine
            held[row] = False
        for r in prefix:
            index.setdefault(int(r), []).append(int(i))
    return out


def linked(docs: DataFrame, size: int = 3, percent: int = 90, prefixes: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the smallest doc_id reachable by links, its own included.

    Two rows link when 100 * |both| >= ``percent`` * |either| for their sets of distinct ``size``-word shingles (a
    shorter text is one shingle). Rows without words have no shingles and are alone; equal sets link; repeated rows of
    one id count as one document; rows with a null id come back alone, with a null component. With ``prefixes`` sets are
    indexed by those instead of parts of the universe; the links are the same.
    """
    brief = pinned(described(docs, size), "sets")
    found = brief.where("n_shingles > 0 AND doc_id IS NOT NULL")
    groups = found.groupBy("code").agg(F.min("doc_id").alias("first"), F.max("n_shingles").alias("n"))
    sizes = groups.groupBy("n").count().collect()  # one row per distinct size, which the longest text bounds
    inhabited: dict[int, int] = {}
    for row in sizes:
        for b in bands(row["n"], percent):
            inhabited[b] = inhabited.get(b, 0) + row["count"]
    plan = {b: allocate(b, k, percent) for b, k in inhabited.items() if k > 1 and differences(b, percent) > 0}
    least = F.min("pivot").over(Window.partitionBy("key"))
    whole = docs.where("doc_id IS NOT NULL")
    met = _met(whole, size, percent, plan, sampled_order(whole, groups, size) if prefixes else None).withColumn("least", least)
    edges = pinned(met.where("code <> least").select(F.col("code").alias("a"), F.col("least").alias("b")).distinct(), "met")
    families = pinned(components(edges), "families")
    links = pinned(_links(docs, groups, families, size, percent), "links")
    roots = components(links)
    named = (
        groups.join(roots.withColumnRenamed("node", "code"), "code", "left")
        .select("code", "first", F.coalesce("root", "code").alias("root"))
    )
    smallest = named.groupBy("root").agg(F.min("first").alias("smallest"))
    component = pinned(named.join(smallest, "root").select("code", "smallest"), "components")
    return brief.join(small_side(component), "code", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("smallest") + F.lit(0) * F.col("doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def _links(docs: DataFrame, groups: DataFrame, families: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b) of linked sets by code, joining all that are linked within each family.

    Families are dealt over tasks. One with more than ``BLOCK`` shingles is cut by size, into ranges so wide that linked
    sets lie in the same or in neighbouring ones: each range is a task's work together with the one below it, and if that
    is still too much it is cut in blocks by code, each pair of blocks a task's work. So what a task holds doesn't
    grow with a family, and a text goes to two ranges at most.
    """
    import pyarrow as pa

    members = families.join(groups, families["node"] == groups["code"]).select("code", "first", "n", F.col("root").alias("family"))
    large = members.groupBy("family").agg((F.sum("n") > BLOCK).alias("large"))
    wide = math.log(100 / percent) + 0.02
    range_ = F.when(F.col("large"), F.floor(F.log(F.col("n")) / wide)).otherwise(0).cast("int")
    members = pinned(members.join(large, "family").withColumn("range", range_), "members")
    own = members.groupBy("family", "range").agg(F.sum("n").alias("s"))
    below = own.select("family", (F.col("range") + 1).alias("range"), F.col("s").alias("below"))
    blocks = F.ceil((F.col("s") + F.coalesce("below", F.lit(0))) / F.lit(BLOCK)).cast("int")
    work = own.join(below, ["family", "range"], "left").select("family", "range", blocks.alias("blocks"))
    placed = members.select("code", "first", "family", "range").unionByName(
        members.where("large").select("code", "first", "family", (F.col("range") + 1).alias("range"))
    )
    placed = placed.join(small_side(work), ["family", "range"]).withColumn("block", F.pmod(F.xxhash64("code"), F.col("blocks")).cast("int"))
    placed = pinned(placed, "placed")
    held = texts(docs).join(small_side(placed), F.col("doc_id") == F.col("first")).select("family", "range", "block", "blocks", "code", "text")
    other = F.sequence(F.lit(0), F.col("blocks") - 1)
    dealt = held.select("family", "range", "block", "code", "text", F.explode(other).alias("other"))
    dealt = dealt.select("family", "range", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "code", "text")
    dealt = dealt.repartition("family", "range", "i", "j").sortWithinPartitions("family", "range", "i", "j")

    def rows(batches):
        for b in batches:
            yield from zip(*(b.column(c).to_pylist() for c in ("family", "range", "i", "j", "block", "code", "text")))

    def run(batches):
        out: list[tuple[int, int]] = []
        known: dict[str, int] = {}
        for (_, _, i, j), group in groupby(rows(batches), key=lambda r: r[:4]):
            sets: dict[int, tuple[np.ndarray, int]] = {}
            for *_, block, code, text in group:
                if code not in sets:
                    s = shingles(text, size, known)
                    if set_code(s) == code:  # rows that share an id may differ in text
                        sets[code] = (s, block)
            if len(sets) > 1:
                side = None if i == j else [block for _, block in sets.values()]
                out += verified([s for s, _ in sets.values()], list(sets), percent, side)
            if len(known) > 1 << 20:
                known.clear()
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], ["a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def representatives(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, with all columns, whatever their names.

    Rows with null or empty texts, or without an id, stay; repeated rows stay or go together; texts of any length are
    compared whole.
    """
    alone = linked(docs, size, percent).where("component_id <> doc_id").select("doc_id").distinct()
    nested = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    return nested.join(small_side(alone), "doc_id", "left_anti").select("row.*")
