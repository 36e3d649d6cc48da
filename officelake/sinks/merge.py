"""Insert, upsert, cascade and change-table application over keyed tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from officelake.operators.ordering import last_wins
from officelake.schemas import ANALYSIS
from officelake.sinks.store import Placed, TableStore, Transaction


class DuplicateKey(ValueError):
    """A key that an insert would create twice."""


def _same(a: DataFrame, b: DataFrame, key: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k] == b[k] for k in key])


def conflicts(rows: DataFrame, stored: DataFrame | None, key: list[str]) -> DataFrame:
    """Keys among ``rows`` that occur twice there or exist already."""
    twice = rows.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > 1).select(*key)
    if stored is None:
        return twice
    known = rows.select(*key).join(stored.select(*key), key, "left_semi")
    return twice.unionByName(known)


def insert(store: TableStore, name: str, rows: DataFrame, key: list[str]) -> DataFrame:
    """Append rows and hand them on; a duplicate key fails before anything is written."""
    stored = store.read(name, store.buckets_of(name, rows)) if store.exists(name) else None
    bad = conflicts(rows, stored, key).limit(5).collect()
    if bad:
        raise DuplicateKey(f"{name}: {[tuple(r) for r in bad]}")
    if store.exists(name):
        store.append(name, rows)
    else:
        store.replace(name, rows, key)
    return rows


def one_per_key(rows: DataFrame, key: list[str], order: list[Column] | None) -> DataFrame:
    """The last of the rows of each key, so that no key is ever stored twice."""
    if set(rows.columns) == set(key):
        return rows.distinct()
    return last_wins(rows, key, order or [F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})])


def merged(stored: DataFrame, rows: DataFrame, key: list[str], order: list[Column] | None = None) -> DataFrame:
    """Stored rows with ``rows`` merged in by key.

    A column the incoming rows have overwrites the stored one, null included; a column they do not have
    keeps its value. ``order`` says which of several incoming rows with one key comes last; without it, the one
    that is greatest as text.
    """
    src = one_per_key(rows, key, order)
    have = [c for c in src.columns if c not in key]
    if set(src.columns) == set(stored.columns):
        return stored.join(src.select(*key), key, "left_anti").unionByName(src)
    s = src.select(*key, F.struct(*have).alias("_new"), F.lit(True).alias("_in"))
    both = stored.join(s, key, "full_outer")
    out = []
    for c in stored.columns:
        if c in key or c not in have:
            out.append(F.col(c))
        else:
            out.append(F.when(F.col("_in"), F.col("_new")[c]).otherwise(F.col(c)).alias(c))
    out += [F.col("_new")[c].alias(c) for c in have if c not in stored.columns]
    return both.select(*out)


def upsert(
    store: TableStore, name: str, rows: DataFrame, key: list[str], order: list[Column] | None = None
) -> DataFrame:
    """Merge rows into a table, publish it and return the merged rows of the incoming keys."""
    txn = store.begin()
    touched = upsert_in(txn, store, name, rows, key, order)
    txn.commit()
    back = store.read(name, touched)
    return back.join(rows.select(*key).distinct(), key, "left_semi")


def upsert_in(txn, store: TableStore, name: str, rows: DataFrame, key: list[str], order=None) -> list[int] | None:
    """Stage an upsert in a transaction; only the buckets of the incoming keys are read and written.

    Returns these buckets. ``rows`` is used more than once, so rows that are dear to compute, such as model
    answers, have to be pinned before.
    """
    if not store.exists(name):
        txn.replace(name, one_per_key(rows, key, order), key)
        return None
    touched = store.buckets_of(name, rows)
    txn.replace_buckets(name, merged(store.read(name, touched), rows, key, order), touched)
    return touched


def add_in(txn, store: TableStore, name: str, rows: DataFrame | Placed, key: list[str], folders: int = 16) -> list[int] | None:
    """Stage an upsert of rows whose keys mostly aren't stored: what its buckets hold is then left as it is.

    A bucket that has ``folders`` folders is written anew with the rows, so that none is in more pieces than that.
    Rows may be ``Placed`` if the caller knows that none of their keys is stored or comes twice: nothing is compared
    then, and their folders are taken over.
    """
    if isinstance(rows, Placed):
        if rows.by == key and store.fits(name, rows):
            touched = sorted(map(int, rows.dirs))
            if store.pieces(name, touched) < folders:
                txn.take_over(name, rows)
            else:
                txn.replace_buckets(name, store.read(name, touched).unionByName(store.rows(rows), allowMissingColumns=True), touched)
            return touched
        rows = store.rows(rows)
    if not store.exists(name):
        return upsert_in(txn, store, name, rows, key)
    touched = store.buckets_of(name, rows)
    if touched is None or store.pieces(name, touched) >= folders or conflicts(rows, store.read(name, touched), key).agg(F.count("*")).first()[0]:
        txn.replace_buckets(name, merged(store.read(name, touched), rows, key), touched)
    elif touched:
        txn.append(name, rows)
    return touched


def merge_into(target: str, rows: DataFrame, key: list[str]) -> None:
    """The same upsert by ``MERGE INTO``, for catalogs whose tables support it."""
    on = reduce(lambda a, b: a & b, [F.col(f"{target}.{k}") == F.col(f"src.{k}") for k in key])
    rows.alias("src").mergeInto(target, on).whenMatched().updateAll().whenNotMatched().insertAll().merge()


def cascade(nested: DataFrame) -> dict[str, DataFrame]:
    """A nested source (id, type, created_time, analysis struct with items) as one frame per table.

    Mail sources may bring ``mail_metadata`` and ``mail_data`` structs (each with an id), analyses may bring people
    and identifiers.
    """
    a = nested.where(F.col("analysis").isNotNull())
    held = nested.schema["analysis"].dataType
    lists = {name: ANALYSIS[name].dataType for name in ("people", "identifiers")}
    extra = [F.col(f"analysis.{n}") if n in held.fieldNames() else F.lit(None).cast(t).alias(n) for n, t in lists.items()]
    items = a.select("id", F.posexplode("analysis.action_items").alias("action_number", "item"))
    parts = {
        "source": nested.select("id", "type", "created_time"),
        "analysis": a.select("id", F.col("analysis.category").alias("category"), "analysis.noteworthy_details", *extra),
        "action_item": items.select(F.col("id").alias("analysis_id"), "action_number", "item.*"),
    }
    if "mail_metadata" in nested.columns:
        known = nested.where(F.col("mail_metadata").isNotNull())
        data_id = F.col("mail_data.id") if "mail_data" in nested.columns else F.lit(None).cast("string")
        parts["mail_source"] = known.select("id", F.col("mail_metadata.id").alias("mail_metadata_id"))
        parts["mail_metadata"] = known.select("mail_metadata.*", data_id.alias("mail_data_id"))
    if "mail_data" in nested.columns:
        parts["gmail_message"] = nested.where(F.col("mail_data").isNotNull()).select("mail_data.*")
    return parts


def cascade_upsert(store: TableStore, nested: DataFrame, txn: Transaction | None = None) -> None:
    """Upsert a nested source into its tables as one publication, or as part of the caller's ``txn``.

    Analyses and items of a rewritten source that the new version no longer has are removed.
    """
    parts = cascade(nested)
    rewritten = nested.select("id")
    own, txn = txn is None, txn or store.begin()
    for name in ("source", "mail_source", "mail_metadata", "gmail_message"):
        if name in parts:
            upsert_in(txn, store, name, parts[name], ["id"])
    # Items are bucketed by their analysis, so that a source's items are found by its id.
    for name, owner in (("analysis", "id"), ("action_item", "analysis_id")):
        rows = parts[name]
        if not store.exists(name):
            txn.replace(name, rows, [owner])
            continue
        touched = store.buckets_of(name, rewritten, ["id"])
        orphan_of = rewritten.withColumnRenamed("id", owner)
        kept = store.read(name, touched).join(orphan_of, owner, "left_anti")
        txn.replace_buckets(name, kept.unionByName(rows, allowMissingColumns=True), touched)
    if own:
        txn.commit()


def classify_update(requests: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """``update`` when the key is stored, else ``create``; a create without a name is an error."""
    known = existing.select(key, F.lit(True).alias("_known"))
    out = requests.join(known, key, "left")
    action = (
        F.when(F.col("_known"), "update").when(F.coalesce(F.col("name"), F.lit("")) != "", "create").otherwise("error")
    )
    return out.withColumn("action", action).drop("_known")


def apply_changes(stored: DataFrame, changes: DataFrame, key: str, op: str = "op", place: str = "tasklist_id") -> DataFrame:
    """Apply a change table in one join: ``I`` insert, ``U`` update, ``D`` delete, ``M`` move to another list.

    One change per key. The result has every row with what happened to it in ``outcome``; a row whose
    outcome is an error or a delete is not part of the new table.
    """
    rest = [c for c in stored.columns if c != key]
    s = stored.select(key, F.struct(*rest).alias("_old"))
    c = changes.select(key, op, F.struct(*rest).alias("_new"))
    both = s.join(c, key, "full_outer")
    has_old, o = F.col("_old").isNotNull(), F.col(op)
    outcome = (
        F.when(o.isNull(), "kept")
        .when((o == "I") & ~has_old, "inserted")
        .when(o == "I", "error: id must not exist")
        .when(~has_old, "error: id not found")
        .when(o == "U", "updated")
        .when(o == "M", "moved")
        .when(o == "D", "deleted")
        .otherwise("error: unknown op")
    )
    out = both.withColumn("outcome", outcome)
    take_new = F.col("outcome").isin("inserted", "updated")
    cols = []
    for name in rest:
        old, new = F.col("_old")[name], F.col("_new")[name]
        value = F.when(take_new, new).otherwise(old)
        if name == place:
            value = F.when(take_new | (F.col("outcome") == "moved"), new).otherwise(old)
        cols.append(value.alias(name))
    return out.select(key, *cols, "outcome")
