"""Rules over variables with finite domains, answered by eliminating one variable after the other.

A domain is a table of values, per group. Variables that a rule ties together are joined by that rule, an equality or a
range, other rules filter as soon as all their variables are there (tables are multiplied only for a predicate over
variables that nothing else ties together), and a variable no rule needs any more is aggregated
away, keeping how many ways lead on (none, one, several) and the smallest of them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from officelake.operators.lookups import interval_join

#: Ways are counted up to here: more than one is ambiguous.
SEVERAL = 2


@dataclass(frozen=True)
class Holds:
    """A predicate in SQL over some variables."""

    label: str
    predicate: str
    variables: tuple[str, ...]


@dataclass(frozen=True)
class Equal:
    """An SQL expression over ``a`` equals one over ``b``, a variable each."""

    label: str
    a: str
    left: str
    b: str
    right: str

    @property
    def variables(self) -> tuple[str, ...]:
        return self.a, self.b


@dataclass(frozen=True)
class Within:
    """A whole-number expression over ``b`` lies from ``low`` to ``high``, both over ``a``."""

    label: str
    a: str
    low: str
    high: str
    b: str
    value: str

    @property
    def variables(self) -> tuple[str, ...]:
        return self.a, self.b


Rule = Holds | Equal | Within


def elimination_order(variables: list[str], rules: list[Rule]) -> list[str]:
    """Variables with the fewest neighbours first; eliminating one makes its neighbours each other's."""
    near = {v: set() for v in variables}
    for r in rules:
        for v in r.variables:
            near[v] |= set(r.variables) - {v}
    out = []
    while near:
        v = min(near, key=lambda x: (len(near[x]), variables.index(x)))
        out.append(v)
        for n in near.pop(v):
            near[n] = (near[n] | {m for m in near if v in near[m]}) - {n, v}
        for m in near:
            near[m].discard(v)
    return out


def solutions(domains: dict[str, DataFrame], keys: list[str], rules: list[Rule]) -> DataFrame:
    """Per group of ``keys`` UNSAT, SAT or AMBIGUOUS, and as ``model`` the smallest solution in the order of ``domains``.

    Each table has the keys and a column named as its variable; repeated values count once, null is no value. Groups
    are those any domain has; one without a value for some variable has no solution. Without keys there is one group.
    """
    names = list(domains)
    labels = [r.label for r in rules]
    if len(set(labels)) < len(labels):
        raise ValueError("rule labels must differ")
    unknown = {v for r in rules for v in r.variables} - set(names)
    if unknown:
        raise ValueError(f"rules over variables without a domain: {sorted(unknown)}")
    group = keys or ["_all"]
    one = [F.col(k) for k in keys] or [F.lit(1).alias("_all")]
    empty = F.struct(*[F.lit(None).cast(domains[n].schema[n].dataType).alias(n) for n in names])
    tables = [
        (frozenset([n]), domains[n].where(F.col(n).isNotNull()).select(*one, n).distinct().withColumn("_ways", F.lit(1)).withColumn("_model", empty)) for n in names
    ]
    left = list(rules)

    def filtered(scope: frozenset, df: DataFrame) -> DataFrame:
        nonlocal left
        for r in [r for r in left if set(r.variables) <= scope]:
            df = df.where(F.coalesce(_as_column(r), F.lit(False)))
            left.remove(r)
        return df

    tables = [(s, filtered(s, df)) for s, df in tables]
    for v in elimination_order(names, left):
        mine = [t for t in tables if v in t[0]]
        rest = [t for t in tables if v not in t[0]]
        while True:
            needed = {x for r in left if v in r.variables for x in r.variables}
            scope = frozenset().union(*(t[0] for t in mine))
            if len(mine) == 1 and not needed - scope:
                break
            if len(mine) > 1:
                joined = _joined(mine[0], mine[1], None, group)
                mine = [(mine[0][0] | mine[1][0], joined), *mine[2:]]
                mine[0] = (mine[0][0], filtered(*mine[0]))
                continue
            # a table the variable is tied to, best by an equality
            ties = sorted((r for r in left if not isinstance(r, Holds) and v in r.variables and set(r.variables) - scope), key=lambda r: isinstance(r, Within))
            tie = ties[0] if ties else None
            wanted = set(tie.variables) - scope if tie else needed - scope
            other = next(t for t in rest if t[0] & wanted)
            rest = [t for t in rest if t is not other]
            if tie is not None:
                left.remove(tie)
            mine = [(scope | other[0], _joined(mine[0], other, tie, group))]
            mine[0] = (mine[0][0], filtered(*mine[0]))
        scope, df = mine[0]
        model = F.struct(*[F.col(v).alias(n) if n == v else F.col(f"_model.{n}").alias(n) for n in names])
        kept = sorted(scope - {v})
        gone = df.groupBy(*group, *kept).agg(F.least(F.sum("_ways"), F.lit(SEVERAL)).cast("int").alias("_ways"), F.min(model).alias("_model"))
        tables = [*rest, (frozenset(kept), gone)]
    whole = reduce(lambda a, b: (frozenset(), _joined(a, b, None, group)), tables)[1]
    if not keys:
        only = whole.agg(F.max("_ways").alias("_ways"), F.min("_model").alias("_model"))
        return only.select(_status().alias("status"), F.col("_model").alias("model"))
    groups = reduce(lambda a, b: a.unionByName(b), [d.select(*one) for d in domains.values()]).distinct()
    found = whole.select(*[F.col(k).alias(f"_of_{k}") for k in group], "_ways", "_model")
    out = groups.join(found, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in group]), "left")
    return out.select(*keys, _status().alias("status"), F.col("_model").alias("model"))


def _status():
    ways = F.coalesce("_ways", F.lit(0))
    return F.when(ways == 0, "UNSAT").when(ways == 1, "SAT").otherwise("AMBIGUOUS")


def consistency(domains: dict[str, DataFrame], keys: list[str], rules: list[Rule]) -> DataFrame:
    """SAT or UNSAT per group."""
    found = solutions(domains, keys, rules)
    return found.select(*keys, F.when(F.col("status") == "UNSAT", "UNSAT").otherwise("SAT").alias("status"))


def _as_column(r: Rule):
    if isinstance(r, Holds):
        return F.expr(r.predicate)
    if isinstance(r, Equal):
        return F.expr(f"({r.left}) = ({r.right})")
    return F.expr(f"({r.value}) BETWEEN ({r.low}) AND ({r.high})")


def _joined(a: tuple, b: tuple, tie: Rule | None, group: list[str]) -> DataFrame:
    """Two tables in one by their groups, the variables both have, and the rule between them; ways multiply."""
    (mine, x), (theirs, y) = a, b
    common = sorted(mine & theirs)
    on = [*group, *common]
    if isinstance(tie, Within):
        if tie.a not in mine:
            mine, x, theirs, y = theirs, y, mine, x
        x = x.withColumn("_low", F.expr(tie.low).cast("long")).withColumn("_high", F.expr(tie.high).cast("long"))
        y = y.withColumn("_at", F.expr(tie.value).cast("long"))
        # null keys are groups too
        flat = [F.struct(F.col(k)).cast("string").alias(f"_g{i}") for i, k in enumerate(on)]
        x, y = x.select("*", *flat), y.select("*", *flat)
        both = interval_join(x, y, ("_low", "_high"), ("_at", "_at"), [f"_g{i}" for i in range(len(on))])
    else:
        same = reduce(lambda p, q: p & q, [F.col(f"left.{k}").eqNullSafe(F.col(f"right.{k}")) for k in on])
        if tie is not None:
            left, right = (tie.left, tie.right) if tie.a in mine else (tie.right, tie.left)
            x, y = x.withColumn("_tie", F.expr(left)), y.withColumn("_tie", F.expr(right))
            same = same & (F.col("left._tie") == F.col("right._tie"))
        both = x.select(F.struct("*").alias("left")).join(y.select(F.struct("*").alias("right")), same)
    names = [f.name for f in x.schema["_model"].dataType.fields]
    model = F.struct(*[F.coalesce(f"left._model.{n}", f"right._model.{n}").alias(n) for n in names])
    return both.select(
        *[F.col(f"left.{k}").alias(k) for k in group],
        *[F.col(f"{'left' if n in mine else 'right'}.{n}").alias(n) for n in sorted(mine | theirs)],
        F.least(F.col("left._ways") * F.col("right._ways"), F.lit(SEVERAL)).alias("_ways"),
        model.alias("_model"),
    )
