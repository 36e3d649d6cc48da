"""Personal data: fixed patterns, and a skip-chain conditional random field over the tokens that could be part of any.

Tokens with digits or an @ are the field's nodes. Neighbours in the text share a chain potential, and a token shares a
skip potential with the last earlier one that has the same digits or letters (or ends in the same seven digits), so that
what is evident in one place carries over to the others. What the patterns found is given; loopy message passing
spreads it over the document. Potentials are trained on the patterns' own findings in all texts: Spark counts feature
combinations and label pairs, of which there are a fixed number, and the driver fits weights to the counts.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from officelake.llm.common import texts

#: Kinds in the order in which they rank.
KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)
LABELS = OTHER + 1
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TRIGGER = re.compile(r"@|[0-9][0-9]|\+[0-9]")
SPACE = re.compile(r"[\x20\x09-\x0D]")
#: Edge kinds.
CHAIN, SKIP = 0, 1
#: Words between two nodes that still count as neighbours.
REACH = 1
#: Marginal probability from which a token joins a kind, and rounds of message passing.
SURE = 0.9
ROUNDS = 8


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number is right."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(rank, start, end) of the fixed patterns, leftmost and non-overlapping per kind, by rank and start."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", m.end() if m else at + 1)
    for m in IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(DIGIT.findall(m[0])) <= 15:
            out.append((3, m.start(), m.end()))
    return out


@dataclass
class Field:
    """The nodes of one text: places, feature codes, given labels (OTHER: none), and edges (from, to, kind)."""

    places: list[tuple[int, int]]
    codes: list[int]
    given: list[int]
    edges: list[tuple[int, int, int]]


def bucket(n: int, *steps: int) -> int:
    return bisect_right(steps, n)


#: Values each feature can take; a code is their mixed-radix number.
RADIX = (8, 2, 4, 3, 2, 4, 3, 3)


def features(token: str, before: str | None, near: bool) -> tuple[int, ...]:
    """Digits, @, dots, dashes and brackets, leading plus, letters, length, and what a near node before looks like."""
    digits = len(DIGIT.findall(token))
    letters = [c for c in token if c.isalpha()]
    upper = sum(c.isupper() for c in letters)
    shape = 0 if not letters else 1 if not upper else 2 if upper == len(letters) else 3
    return (
        bucket(digits, 1, 3, 5, 7, 10, 13, 16),
        "@" in token,
        min(3, token.count(".")),
        1 if "-" in token else 2 if "(" in token or ")" in token else 0,
        token.startswith("+"),
        shape,
        bucket(len(token), 6, 14),
        0 if not near else 2 if before.startswith("+") or before.startswith("(") else 1,
    )


def code_of(values: tuple[int, ...]) -> int:
    code = 0
    for v, r in zip(values, RADIX):
        code = code * r + int(v)
    return code


def values_of(code: int) -> list[int]:
    out = []
    for r in reversed(RADIX):
        code, v = divmod(code, r)
        out.append(v)
    return out[::-1]


def field_of(text: str, base: list[tuple[int, int, int]]) -> Field:
    """Nodes and edges of a whole text."""
    out = Field([], [], [], [])
    spans = sorted((a, z, k) for k, a, z in base)
    starts = [a for a, _, _ in spans]
    last: dict[str, int] = {}
    end = 0
    for m in TRIGGER.finditer(text):
        if m.start() < end:
            continue
        start = m.start()
        while start > end and not SPACE.match(text[start - 1]):
            start -= 1
        stop = SPACE.search(text, m.end())
        stop = stop.start() if stop else len(text)
        before_end, end = end, stop
        token = text[start:stop]
        lead = len(token) - len(token.lstrip("\"'<[{,;:"))
        tail = len(token) - len(token.rstrip("\"'>]},;:.!?"))
        a, z = start + lead, max(start + lead + 1, stop - tail)
        node = len(out.places)
        near = bool(node) and len(text[before_end:start].split()) <= REACH if start - before_end < 40 else False
        previous = text[slice(*out.places[-1])] if node else None
        out.places.append((a, z))
        out.codes.append(code_of(features(text[a:z], previous, near)))
        at = bisect_right(starts, z - 1) - 1
        given = OTHER
        while at >= 0 and at > bisect_right(starts, z - 1) - 5:
            if spans[at][1] > a:
                given = spans[at][2]
                break
            at -= 1
        out.given.append(given)
        if near:
            out.edges.append((node - 1, node, CHAIN))
        digits = "".join(DIGIT.findall(text[a:z]))
        keys = {digits, digits[-7:]} if len(digits) >= 4 else set()
        if "@" in token:
            keys = {text[a:z].lower()}
        linked = set()
        for key in keys:
            other = last.get(key)
            if other is not None and other not in linked:
                linked.add(other)
                out.edges.append((other, node, SKIP))
            last[key] = node
    return out


def _counts(batches):
    import pyarrow as pa

    for b in batches:
        seen: Counter = Counter()
        for text in b.column("text").to_pylist():
            if not TRIGGER.search(text):
                continue
            f = field_of(text, base_spans(text))
            seen.update((0, c, g) for c, g in zip(f.codes, f.given))
            seen.update((1 + k, f.given[i], f.given[j]) for i, j, k in f.edges)
        keys = list(seen)
        yield pa.RecordBatch.from_arrays(
            [*(pa.array([k[i] for k in keys], pa.int32()) for i in range(3)), pa.array([seen[k] for k in keys], pa.int64())], ["what", "a", "b", "n"]
        )


@dataclass
class PiiModel:
    """Unary potentials by feature code and pairwise ones by edge kind."""

    weights: np.ndarray
    pairwise: np.ndarray

    def unary(self, codes: list[int]) -> np.ndarray:
        return one_hot(codes) @ self.weights


def one_hot(codes: list[int]) -> np.ndarray:
    out = np.zeros((len(codes), sum(RADIX) + 1))
    out[:, -1] = 1
    for i, c in enumerate(codes):
        at = 0
        for v, r in zip(values_of(c), RADIX):
            out[i, at + v] = 1
            at += r
    return out


def fit(docs: DataFrame, ridge: float = 1.0, steps: int = 300) -> PiiModel:
    """Potentials from all texts. Unary ones are a softmax regression on the counted feature combinations; pairwise
    ones compare how often two labels meet across an edge with how often they would by chance (piecewise training).
    """
    counted = texts(docs).select("text").mapInArrow(_counts, "what int, a int, b int, n long")
    rows = counted.groupBy("what", "a", "b").agg(F.sum("n").alias("n")).orderBy("what", "a", "b").collect()
    codes = sorted({r["a"] for r in rows if r["what"] == 0})
    at = {c: i for i, c in enumerate(codes)}
    y = np.zeros((len(codes), LABELS))
    pair = np.ones((2, LABELS, LABELS))
    for r in rows:
        if r["what"] == 0:
            y[at[r["a"]], r["b"]] += r["n"]
        else:
            pair[r["what"] - 1, r["a"], r["b"]] += r["n"]
    x = one_hot(codes)
    w = np.zeros((x.shape[1], LABELS))
    total = y.sum()
    if total:
        share = y.sum(axis=1, keepdims=True)
        m, v = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, steps + 1):
            z = x @ w
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            g = (x.T @ (share * p - y) + ridge * w) / total
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    potentials = []
    for n in pair:
        chance = n.sum(axis=1, keepdims=True) * n.sum(axis=0, keepdims=True) / n.sum()
        potentials.append(np.clip(np.log(n / chance), -3, 3))
    potentials[SKIP] = (potentials[SKIP] + potentials[SKIP].T) / 2
    return PiiModel(w, np.array(potentials))


def marginals(f: Field, model: PiiModel) -> np.ndarray:
    """Label probabilities of each node by loopy sum-product; given labels are held."""
    unary = model.unary(f.codes)
    for i, g in enumerate(f.given):
        if g != OTHER:
            unary[i] = -30.0
            unary[i, g] = 0.0
    if f.edges:
        e = np.array(f.edges)
        src, dst = np.concatenate([e[:, 0], e[:, 1]]), np.concatenate([e[:, 1], e[:, 0]])
        pair = np.concatenate([model.pairwise[e[:, 2]], model.pairwise[e[:, 2]].transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(e)) + len(e), np.arange(len(e))])
        sent = np.zeros((len(src), LABELS))
        for _ in range(ROUNDS):
            belief = unary.copy()
            np.add.at(belief, dst, sent)
            own = (belief[src] - sent[back])[:, :, None] + pair
            top = own.max(axis=1, keepdims=True)
            new = np.log(np.exp(own - top).sum(axis=1)) + top[:, 0]
            sent = 0.5 * sent + 0.5 * (new - new.max(axis=1, keepdims=True))
        np.add.at(unary, dst, sent)
    p = np.exp(unary - unary.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def plausible(kind: int, token: str) -> bool:
    """What a span of a kind must have whatever its surroundings say."""
    digits = len(DIGIT.findall(token))
    return (
        "@" in token[1:-1]
        if kind == 0
        else token.count(".") == 3 and 4 <= digits <= 12
        if kind == 1
        else 13 <= digits <= 19
        if kind == 2
        else 7 <= digits <= 15
    )


def added_spans(text: str, base: list[tuple[int, int, int]], model: PiiModel) -> list[tuple[int, int, int]]:
    """(rank, start, end) that the field adds: runs of neighbouring nodes of one kind that no pattern covers."""
    f = field_of(text, base)
    if all(g != OTHER for g in f.given):
        return []
    p = marginals(f, model)
    near = {j for _, j, k in f.edges if k == CHAIN}
    out: list[list[int]] = []
    open_kind = OTHER
    for i, (a, z) in enumerate(f.places):
        kind = int(p[i, :OTHER].argmax())
        sure = f.given[i] == OTHER and p[i, kind] >= SURE
        if sure and open_kind == kind and i in near:
            out[-1][2] = z
        elif sure:
            out.append([kind, a, z])
        open_kind = kind if sure else OTHER
    return [(k, a, z) for k, a, z in out if plausible(k, text[a:z]) and not any(a < e and s < z for _, s, e in base)]


def scan(docs: DataFrame, model: PiiModel) -> DataFrame:
    """(doc_id, base, spans) per row: what the patterns find and that with what the field adds, by rank and start.

    Both are arrays of struct(rank, start, end), in code points. Null and empty texts have none; repeated rows are
    scanned alike; other columns aren't read.
    """
    import pyarrow as pa

    handed = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("rank", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        listed = lambda spans: [{"rank": k, "start": a, "end": z} for k, a, z in spans]
        for b in batches:
            base, every = [], []
            for text in b.column("text").to_pylist():
                found = base_spans(text) if TRIGGER.search(text) else []
                more = added_spans(text, found, handed.value) if TRIGGER.search(text) else []
                base.append(listed(found))
                every.append(listed(sorted([*found, *more])))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(base, kind), pa.array(every, kind)], ["doc_id", "base", "spans"])

    span = "array<struct<rank: int, start: int, end: int>>"
    return texts(docs).mapInArrow(run, f"doc_id long, base {span}, spans {span}")


def joined(found: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
