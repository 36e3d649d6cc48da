"""Ranked lexical search over a length-stratified index.

Documents are dealt to parts of bounded size. Within a part, documents with the same length normaliser form a stratum,
and a stratum's postings are grouped by term and term frequency, so that the impact of a term is computed once for
each frequency, not for each document. The largest frequency of each term in a stratum bounds what any of its
documents can score for a query. A query visits the strata of a part in the order of these bounds, and stops where the
bound is below its tenth best score so far; a few parts are searched first, and what they give is where the others
start from. All scores are integers and exact.

Texts are read once: a task turns each batch of them into one packed row of postings, kept in the shared folder.
Statistics are sums over all of these rows.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from officelake.llm.common import ASCII_LOWER, pinned

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Share of the normaliser that follows the length, in hundredths; weight of the normaliser in an impact.
LENGTH_SHARE = 75
IMPACT, SCALE, NORMAL = 1_000_000_000, 1000, 8
TOP = 10
#: Postings of a part, which one task holds.
PART_POSTINGS = 1 << 21
#: Parts searched first, whose results all others start from.
FIRST_PARTS = 6
#: Different terms of queries up to which tasks are handed them when texts are read; beyond, terms are joined.
HANDED_TERMS = 1 << 19
#: (query, term) rows of the queries that are searched together.
BLOCK_ROWS = 1 << 18
#: Scores of a stratum computed together.
CELLS = 1 << 22
#: Doubles add integers without rounding up to here.
EXACT = 1 << 53

SEGMENT = "segment long, term array<string>, at array<int>, tf array<int>, id array<long>, n array<long>"
HITS = "query long, doc_id long, known boolean, score long"


def terms_of(text: str) -> list[str]:
    """Maximal runs of letters and digits; only A-Z are lower-cased."""
    return TERM.findall(text.translate(ASCII_LOWER))


def weight(documents: int, holding: int) -> int:
    """Of a term that ``holding`` of all documents hold."""
    return int(np.floor(1000 * np.log((2 * documents + 2) / (2 * holding + 1))))


def normaliser(n, documents: int, terms: int):
    """Of a document of ``n`` terms, where all documents have ``terms``; works on arrays too."""
    return 100 - LENGTH_SHARE + (LENGTH_SHARE * n * documents) // max(1, terms)


# --- index ------------------------------------------------------------------------------------------------------


def segments(docs: DataFrame, wanted: set[str] | None) -> DataFrame:
    """One packed row per batch of documents with a term: their ids (null stays null) and lengths, and their postings.

    Posting i says that document ``at[i]`` of the batch holds ``term[i]`` ``tf[i]`` times; the row's other arrays are by
    document. With ``wanted`` only those terms are kept; lengths count all terms.
    """
    import pyarrow as pa
    from pyspark import TaskContext

    handed = docs.sparkSession.sparkContext.broadcast(wanted) if wanted is not None else None

    def run(batches):
        task = TaskContext.get().partitionId()
        for k, b in enumerate(batches):
            ids, lengths, term, at, tf = [], [], [], [], []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                found = terms_of(text)
                if not found:
                    continue
                counts = Counter(found)
                for t in counts if handed is None else [t for t in counts if t in handed.value]:
                    term.append(t)
                    at.append(len(ids))
                    tf.append(counts[t])
                ids.append(doc_id)
                lengths.append(len(found))
            if ids:
                lists = [[term], [at], [tf], [ids], [lengths]]
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                columns = [pa.array([task << 32 | k]), *(pa.array(x, pa.list_(kind)) for x, kind in zip(lists, kinds))]
                yield pa.RecordBatch.from_arrays(columns, ["segment", "term", "at", "tf", "id", "n"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, SEGMENT)


@dataclass
class Index:
    """Segments, dealt to ``parts``, and the statistics of all documents."""

    segments: DataFrame
    holding: DataFrame
    parts: int
    documents: int
    terms: int


def indexed(docs: DataFrame, vocabulary: DataFrame | None = None) -> Index:
    """The index of all documents over the terms in ``vocabulary`` (a column ``term``; None: over all terms)."""
    wanted = None
    if vocabulary is not None:
        vocabulary = vocabulary.select("term").distinct()
        few = vocabulary.limit(HANDED_TERMS + 1).collect()
        if len(few) <= HANDED_TERMS:
            wanted = {r["term"] for r in few}
    kept = pinned(segments(docs, wanted), "lexical-segments")
    sums = kept.agg(
        F.coalesce(F.sum(F.size("id")), F.lit(0)).alias("documents"),
        F.coalesce(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)).alias("terms"),
        F.coalesce(F.sum(F.size("term")), F.lit(0)).alias("postings"),
    ).first()
    holding = kept.select(F.explode("term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    if vocabulary is not None and wanted is None:
        holding = holding.join(vocabulary, "term")
    return Index(kept, pinned(holding, "lexical-holding"), sums["postings"] // PART_POSTINGS + FIRST_PARTS, sums["documents"], sums["terms"])


# --- search -----------------------------------------------------------------------------------------------------


class Part:
    """The strata of one part: documents by normaliser, postings by (stratum, term, tf)."""

    def __init__(self, held, place: dict[str, int], weights: np.ndarray, documents: int, terms: int):
        """From the packed rows of the part as an Arrow table; ``place`` numbers the terms asked for."""
        import pyarrow as pa
        import pyarrow.compute as pc

        flat = lambda name: held.column(name).combine_chunks().flatten()
        sizes = lambda name: pc.list_value_length(held.column(name)).to_numpy().astype(np.int64)
        number = pc.index_in(flat("term"), value_set=pa.array(list(place), pa.string()))
        mine = pc.is_valid(number).to_numpy(zero_copy_only=False)
        term = number.filter(pc.is_valid(number)).to_numpy().astype(np.int64)
        seen = np.cumsum(sizes("id")) - sizes("id")
        at = (flat("at").to_numpy() + np.repeat(seen, sizes("at")))[mine]
        tf = flat("tf").to_numpy().astype(np.int64)[mine]
        ids, lengths = flat("id"), flat("n").to_numpy()
        known = pc.is_valid(ids).to_numpy(zero_copy_only=False)
        ids = ids.fill_null(0).to_numpy()
        m = normaliser(lengths, documents, terms)
        # documents in the order of their strata
        order = np.argsort(m, kind="stable")
        self.ids, self.known = ids[order], known[order]
        self.normal, self.starts = np.unique(m[order], return_index=True)
        self.starts = np.append(self.starts, len(order))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        doc = rank[at]
        stratum = np.searchsorted(self.starts, doc, "right") - 1
        by = np.lexsort((tf, term, stratum))
        self.doc, term, tf, stratum = doc[by], term[by], tf[by], stratum[by]
        # an impact for each (stratum, term, tf), which the group's postings share
        new = np.ones(len(by), bool)
        new[1:] = (np.diff(stratum) != 0) | (np.diff(term) != 0) | (np.diff(tf) != 0)
        group = np.flatnonzero(new)
        impact = weights[term[group]] * ((IMPACT * tf[group]) // (SCALE * tf[group] + NORMAL * self.normal[stratum[group]]))
        self.impact = np.repeat(impact, np.diff(np.append(group, len(by))))
        # runs of one term in one stratum; the last posting has the largest tf, and so the run's bound
        last = np.ones(len(by), bool)
        last[:-1] = (np.diff(stratum) != 0) | (np.diff(term) != 0)
        self.run_stop = np.flatnonzero(last) + 1
        self.run_start = np.append(0, self.run_stop[:-1])[: len(self.run_stop)]
        self.run_key = stratum[self.run_start] * len(weights) + term[self.run_start]
        self.run_bound = self.impact[self.run_stop - 1] if len(by) else np.zeros(0, np.int64)
        self.terms = len(weights)

    def runs(self, strata: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places among the pairs, runs): the runs of those (stratum, term) pairs that have one."""
        if not len(self.run_key):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        key = strata * self.terms + terms
        at = np.minimum(np.searchsorted(self.run_key, key), len(self.run_key) - 1)
        found = np.flatnonzero(self.run_key[at] == key)
        return found, at[found]


@dataclass
class Queries:
    """Queries numbered from 0: query q asks for ``term[start[q]:start[q + 1]]``, each ``times`` times."""

    start: np.ndarray
    term: np.ndarray
    times: np.ndarray


def bounds(part: Part, queries: Queries) -> np.ndarray:
    """(query, stratum): the most any document of the stratum can score."""
    n, strata = len(queries.start) - 1, len(part.normal)
    out = np.zeros((n, strata), np.int64)
    if not strata:
        return out
    whose = np.repeat(np.arange(n), np.diff(queries.start))
    step = max(1, CELLS // strata)
    for k in range(0, len(queries.term), step):
        t, w = queries.term[k : k + step], queries.times[k : k + step]
        found, run = part.runs(np.tile(np.arange(strata), len(t)), np.repeat(t, strata))
        np.add.at(out, (whose[k : k + step][found // strata], found % strata), w[found // strata] * part.run_bound[run])
    return out


def stratum_scores(part: Part, stratum: int, asking: np.ndarray, queries: Queries) -> np.ndarray:
    """Scores of all documents of a stratum (columns) for the asking queries (rows)."""
    sizes = (queries.start[asking + 1] - queries.start[asking]).astype(np.int64)
    entry = np.repeat(queries.start[asking] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    row = np.repeat(np.arange(len(asking)), sizes)
    found, run = part.runs(np.full(len(entry), stratum), queries.term[entry])
    length = part.run_stop[run] - part.run_start[run]
    posting = np.repeat(part.run_start[run] - np.cumsum(length) + length, length) + np.arange(length.sum())
    docs = int(part.starts[stratum + 1] - part.starts[stratum])
    cell = np.repeat(row[found], length) * docs + part.doc[posting] - part.starts[stratum]
    value = np.repeat(queries.times[entry[found]], length) * part.impact[posting]
    if len(value) and int(value.max()) * int(sizes.max()) < EXACT:
        return np.bincount(cell, value, len(asking) * docs).astype(np.int64).reshape(len(asking), docs)
    out = np.zeros(len(asking) * docs, np.int64)
    np.add.at(out, cell, value)
    return out.reshape(len(asking), docs)


def best_of(part: Part, queries: Queries, floor: np.ndarray, top: int) -> list[tuple[int, int, bool, int]]:
    """(query, doc_id, known, score): of every query the rows of the part that can be among its ``top``.

    ``floor`` is a score that ``top`` rows elsewhere reach; rows with the same score stay.
    """
    upper = bounds(part, queries)
    order = np.argsort(-upper, axis=1, kind="stable")
    least = np.maximum(floor, 1)
    kept: dict[int, list] = defaultdict(list)
    done, step, strata = 0, 1, len(part.normal)
    open_ = np.arange(len(floor))
    while done < strata and len(open_):
        # the next strata of every query that is not finished, gathered by stratum
        turn = order[open_, done : done + step]
        visits = upper[open_[:, None], turn] >= least[open_, None]
        who, stratum = np.repeat(open_, turn.shape[1])[visits.ravel()], turn[visits]
        by = np.argsort(stratum, kind="stable")
        who, stratum = who[by], stratum[by]
        for asked in np.split(np.arange(len(who)), np.flatnonzero(np.diff(stratum)) + 1):
            if not len(asked):
                continue
            s = int(stratum[asked[0]])
            first, docs = int(part.starts[s]), int(part.starts[s + 1] - part.starts[s])
            for k in range(0, len(asked), max(1, CELLS // docs)):
                asking = who[asked[k : k + max(1, CELLS // docs)]]
                scores = stratum_scores(part, s, asking, queries)
                rows, columns = np.nonzero(scores >= least[asking, None])
                for q, at in zip(np.unique(rows), np.split(np.arange(len(rows)), np.flatnonzero(np.diff(rows)) + 1)):
                    which = columns[at]
                    found = kept[int(asking[q])]
                    found += zip((-scores[q, which]).tolist(), (~part.known[first + which]).tolist(), part.ids[first + which].tolist())
                    found.sort()
                    del found[top:]
                    if len(found) == top:
                        least[asking[q]] = max(least[asking[q]], -found[-1][0])
        done += step
        step *= 2
        if done < strata:
            open_ = open_[upper[open_, order[open_, done]] >= least[open_]]
    return [(q, i, not nameless, -score) for q, found in kept.items() for score, nameless, i in found]


def _searched(index: Index, parts, block: list, floor: dict[int, int], top: int) -> DataFrame:
    """Hits of a block of (query, term, times, weight) rows in some of the parts."""
    import pyarrow as pa

    words = sorted({r["term"] for r in block})
    place = {t: k for k, t in enumerate(words)}
    weights = np.zeros(len(words), np.int64)
    for r in block:
        weights[place[r["term"]]] = r["weight"]
    names = sorted({r["query"] for r in block})
    number = {q: k for k, q in enumerate(names)}
    rows = sorted((number[r["query"]], place[r["term"]], r["times"]) for r in block)
    start = np.searchsorted([r[0] for r in rows], np.arange(len(names) + 1))
    queries = Queries(start, np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64))
    least = np.array([floor.get(q, 0) for q in names], np.int64)
    handed = index.segments.sparkSession.sparkContext.broadcast((place, weights, queries, least, names))
    documents, terms = index.documents, index.terms

    def run(held: pa.Table) -> pa.Table:
        place, weights, queries, least, names = handed.value
        hits = best_of(Part(held, place, weights, documents, terms), queries, least, top)
        q, i, known, score = zip(*hits) if hits else ((), (), (), ())
        return pa.table(
            {"query": pa.array([names[x] for x in q], pa.int64()), "doc_id": pa.array(i, pa.int64()), "known": pa.array(known, pa.bool_()), "score": pa.array(score, pa.int64())}
        )

    part = F.pmod(F.xxhash64("segment"), F.lit(index.parts))
    dealt = index.segments.withColumn("part", part).where(parts(F.col("part")))
    return dealt.groupBy("part").applyInArrow(run, HITS)


def _top(hits: DataFrame, top: int) -> DataFrame:
    order = [F.col("score").desc(), F.col("known").desc(), F.col("doc_id")]
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): for every item the ``top`` documents with the highest scores above 0.

    An item asks for each of its terms as often as it holds it. Null texts and texts without a term hold nothing and
    don't count as documents; items without one find nothing. Equal rows of ``items`` count once; rows of one id
    with different texts are queries of their own. Repeated rows of ``docs`` are ranked each; rows without an id
    count and are ranked as rows, after the others at equal scores. Other columns are not read.

    Queries go in blocks of at most ``BLOCK_ROWS`` terms, each block against the whole index.
    """
    import pyarrow as pa

    def asked(batches):
        for b in batches:
            out = [(q, t, n) for q, text in zip(b.column("query").to_pylist(), b.column("text").to_pylist()) for t, n in Counter(terms_of(text)).items()]
            q, t, n = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(t, pa.string()), pa.array(n, pa.int64())], ["query", "term", "times"])

    texts = items.where(F.col("text").isNotNull()).select("item_id", "text").distinct()
    queries = pinned(texts.withColumn("query", F.monotonically_increasing_id()), "lexical-queries")
    wanted = pinned(queries.select("query", "text").mapInArrow(asked, "query long, term string, times long"), "lexical-terms")
    index = indexed(docs, wanted)
    weighed = pinned(wanted.join(index.holding, "term").repartitionByRange("query").sortWithinPartitions("query"), "lexical-weighed")
    found = []
    for block in _blocks(weighed, index.documents):
        first = pinned(_searched(index, lambda p: p < FIRST_PARTS, block, {}, top), "lexical-hits")
        found.append(first)
        if index.parts > FIRST_PARTS:
            best = _top(first, top).where(F.col("rank") == top).select("query", "score")
            floor = {r["query"]: r["score"] for r in best.collect()}
            found.append(pinned(_searched(index, lambda p: p >= FIRST_PARTS, block, floor, top), "lexical-hits"))
    spark = docs.sparkSession
    hits = spark.createDataFrame([], HITS)
    for f in found:
        hits = hits.unionByName(f)
    best = _top(hits, top).select("query", "rank", F.when(F.col("known"), F.col("doc_id")).alias("doc_id"), "score")
    return best.join(queries.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")


def _blocks(weighed: DataFrame, documents: int):
    """Lists of (query, term, times, weight) rows of whole queries, read from the table one after the other."""
    block: list[dict] = []
    last: list[dict] = []
    for r in weighed.orderBy("query").toLocalIterator():
        row = {"query": r["query"], "term": r["term"], "times": r["times"], "weight": weight(documents, r["df"])}
        if last and last[0]["query"] != row["query"]:
            if block and len(block) + len(last) > BLOCK_ROWS:
                yield block
                block = []
            block, last = block + last, []
        last.append(row)
    if block and len(block) + len(last) > BLOCK_ROWS:
        yield block
        block = []
    if block or last:
        yield block + last


#: The same in SQL, over views ``documents`` and ``benchmark``.
SEARCH_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
weighed AS (SELECT item_id, term, times, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM asked JOIN dfs USING (term), whole),
scored AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
  FROM weighed JOIN tfs USING (term) JOIN lengths USING (doc_id), whole GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
