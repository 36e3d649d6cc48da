"""Labelled rules over rows: audits, consistency, solutions and conflict cores.

The assignments a rule set is tried on are rows of a table; every question is an aggregate over them, per group.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

NO_DESCRIPTION = "No description provided"


@dataclass(frozen=True)
class Rule:
    """A predicate in SQL with its label."""

    label: str
    predicate: str
    description: str | None = None

    def holds(self) -> Column:
        return F.coalesce(F.expr(self.predicate), F.lit(False))


def checked(rules: list[Rule]) -> list[Rule]:
    """The rules, when their labels differ."""
    labels = [r.label for r in rules]
    twice = sorted({x for x in labels if labels.count(x) > 1})
    if twice:
        raise ValueError(f"duplicate rule labels: {twice}")
    return rules


def audit(rows: DataFrame, rules: list[Rule], name: str = "violations") -> DataFrame:
    """Rows with the labels and descriptions of the rules they break."""
    found = [
        F.struct(
            F.lit(r.label).alias("label"),
            F.lit(r.description or NO_DESCRIPTION).alias("description"),
            r.holds().alias("ok"),
        )
        for r in checked(rules)
    ]
    broken = F.filter(F.array(*found), lambda v: ~v["ok"])
    return rows.withColumn(name, F.transform(broken, lambda v: v.dropFields("ok")))


def _all_hold(rules: list[Rule]) -> Column:
    return reduce(lambda a, b: a & b, [r.holds() for r in checked(rules)])


def consistency(assignments: DataFrame, keys: list[str], rules: list[Rule]) -> DataFrame:
    """SAT or UNSAT per group: whether some assignment keeps all rules."""
    out = assignments.groupBy(*keys).agg(F.max(_all_hold(rules)).alias("_ok"))
    return out.select(*keys, F.when(F.col("_ok"), "SAT").otherwise("UNSAT").alias("status"))


def solutions(assignments: DataFrame, keys: list[str], variables: list[str], rules: list[Rule]) -> DataFrame:
    """Per group UNSAT, SAT or AMBIGUOUS (several assignments keep the rules), and the smallest of them."""
    distinct = assignments.select(*keys, *variables).distinct()
    good = _all_hold(rules)
    model = F.struct(*variables)
    out = distinct.groupBy(*keys).agg(F.count_if(good).alias("_n"), F.min(F.when(good, model)).alias("model"))
    status = F.when(F.col("_n") == 0, "UNSAT").when(F.col("_n") == 1, "SAT").otherwise("AMBIGUOUS")
    return out.select(*keys, status.alias("status"), "model")


def conflict_core(assignments: DataFrame, keys: list[str], rules: list[Rule]) -> DataFrame:
    """Per group labels that cannot hold together, none of which can be left out; empty when consistent.

    An assignment is reduced to the list of rules it breaks. Rules conflict when every assignment breaks one of
    them; a rule is dropped from the core when the rest still conflicts.
    """
    checked(rules)
    numbers = F.array(*[F.lit(i) for i in range(len(rules))])
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(r.holds(), F.lit(False)), F.lit(i)) for i, r in enumerate(rules)]))
    sets = assignments.groupBy(*keys).agg(F.collect_set(broken).alias("_sets"))

    def conflicts(core: Column) -> Column:
        return F.forall("_sets", lambda m: F.arrays_overlap(m, core))

    def shrink(core: Column, number: Column) -> Column:
        rest = F.filter(core, lambda x: x != number)
        return F.when(conflicts(rest), rest).otherwise(core)

    kept = F.when(conflicts(numbers), F.aggregate(numbers, numbers, shrink)).otherwise(F.array().cast("array<int>"))
    labels = F.array(*[F.lit(r.label) for r in rules])
    return sets.withColumn("_core", kept).select(*keys, F.transform("_core", lambda i: F.get(labels, i)).alias("core"))
