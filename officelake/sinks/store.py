"""Parquet tables whose versions are published together.

A write goes to a new folder; publishing creates the next numbered commit file, which lists the current folders
of every table. Creating that file fails if another writer has taken the number, so nothing is half visible
and no table that is being read is overwritten.

A keyed table is kept in buckets of its key, one folder each, so that a merge reads and rewrites only the
buckets its rows fall into, however big the table is.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

WHOLE = "whole"


def bucket_of(by: list[str], n: int) -> Column:
    """Bucket number of a row; keys are hashed as text, so that equal keys of different number types meet."""
    return F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in by]), F.lit(n)).cast("int")


class CommitConflict(RuntimeError):
    """Another writer published first."""


class Placed(NamedTuple):
    """Rows that lie in a store's folders, one per bucket of ``by`` out of ``n``, and need not be published."""

    schema: T.StructType
    by: list[str]
    n: int
    dirs: dict[str, str]


class TableStore:
    """Named tables under one shared folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._seen: tuple[int, dict] | None = None  # number and tables of the newest complete commit seen so far

    def _latest(self) -> tuple[int, dict]:
        """Highest commit number and the tables of the newest complete commit.

        A writer lost between creating and filling its commit file has published nothing. Complete commits never
        change, so only those after the last one seen are looked for.
        """
        number, known = self._seen or self._listed()
        top = number
        while self._fs.exists(self._commit(top + 1)):
            top += 1
        for later in range(top, number, -1):
            text = self._text(later)
            if text.endswith("}\n"):
                number, known = later, json.loads(text)
                break
        self._seen = number, known
        return top, known

    def _commit(self, number: int):
        return self._path(f"{self.root}/_commits/{number:010d}.json")

    def _text(self, number: int) -> str:
        stream = self._fs.open(self._commit(number))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _listed(self) -> tuple[int, dict]:
        """Number and tables of the newest complete commit, from all there are; numbers have no gaps."""
        folder = self._path(f"{self.root}/_commits")
        if not self._fs.exists(folder):
            return 0, {}
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        for number in sorted((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), reverse=True):
            text = self._text(number)
            if text.endswith("}\n"):
                return number, json.loads(text)
        return 0, {}

    def exists(self, name: str) -> bool:
        return name in self._latest()[1]

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """The published rows of a table, pinned to the version current now; of a keyed one also part."""
        entry = self._latest()[1][name]
        wanted = entry["dirs"] if buckets is None else [str(b) for b in buckets]
        paths = [f"{self.root}/{d}" for b in wanted for d in entry["dirs"].get(b, [])]
        schema = T.StructType.fromJson(entry["schema"])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def buckets_of(self, name: str, rows: DataFrame, owner: list[str] | None = None) -> list[int] | None:
        """Buckets of a keyed table that rows fall into (a list no longer than there are buckets), else None.

        ``owner`` names the columns of ``rows`` that hold the bucketing key, where they are called otherwise.
        """
        entry = self._latest()[1][name]
        if not entry["by"]:
            return None
        found = rows.select(bucket_of(owner or entry["by"], entry["n"]).alias("b")).distinct().collect()
        return sorted(r["b"] for r in found)

    def buckets(self, name: str) -> int:
        """How many buckets a keyed table is kept in, or would be if it were stored now."""
        entry = self._latest()[1].get(name)
        return entry["n"] if entry else int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def fits(self, name: str, placed: Placed) -> bool:
        """Whether a table is kept in the same buckets, or not stored yet."""
        entry = self._latest()[1].get(name)
        return not entry or (entry["by"], entry["n"]) == (placed.by, placed.n)

    def pieces(self, name: str, buckets: list[int]) -> int:
        """The most folders that one of these buckets lies in."""
        entry = self._latest()[1].get(name)
        dirs = entry["dirs"] if entry else {}
        return max([len(dirs.get(str(b), [])) for b in buckets], default=0)

    def new_folder(self, name: str) -> str:
        """A new, unused folder for rows of a table, below ``root``."""
        return f"{name}/{uuid.uuid4().hex}"

    def bucket_dirs(self, folder: str) -> dict[str, str]:
        """The sub-folder of each bucket that rows in ``folder`` were written to; none if it isn't there."""
        path = self._path(f"{self.root}/{folder}")
        names = [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []
        return {x[8:]: f"{folder}/{x}" for x in names if x.startswith("_bucket=")}

    def rows(self, placed: Placed) -> DataFrame:
        """Rows that lie in the store, published or not."""
        paths = [f"{self.root}/{d}" for d in placed.dirs.values()]
        return self.spark.read.schema(placed.schema).parquet(*paths) if paths else self.spark.createDataFrame([], placed.schema)

    def begin(self) -> "Transaction":
        """Start a set of writes that is published as one."""
        return Transaction(self, *self._latest())

    def replace(self, name: str, rows: DataFrame, by: list[str] | None = None) -> None:
        """Publish new contents of one table, kept in buckets of ``by`` if given."""
        txn = self.begin()
        txn.replace(name, rows, by)
        txn.commit()

    def append(self, name: str, rows: DataFrame) -> None:
        """Publish additional rows of one table."""
        txn = self.begin()
        txn.append(name, rows)
        txn.commit()


class Transaction:
    """Staged writes; nothing is visible before ``commit`` and nothing at all without it."""

    def __init__(self, store: TableStore, number: int, tables: dict):
        self._store, self.number = store, number  # number of the commit it starts from
        self._tables = json.loads(json.dumps(tables))

    def _write(self, name: str, rows: DataFrame, by: list[str], n: int) -> dict[str, list[str]]:
        """Write rows to a new folder and return its sub-folder per bucket."""
        store = self._store
        folder = store.new_folder(name)
        path = f"{store.root}/{folder}"
        if not by:
            rows.write.parquet(path)
            return {WHOLE: [folder]}
        # Rebalanced, so that a bucket is written by one task unless it is so big that AQE splits it.
        marked = rows.withColumn("_bucket", bucket_of(by, n)).hint("rebalance", "_bucket")
        marked.write.partitionBy("_bucket").parquet(path)
        return {b: [d] for b, d in store.bucket_dirs(folder).items()}

    def replace(self, name: str, rows: DataFrame, by: list[str] | None = None) -> None:
        """Stage new contents of a table."""
        n = int(self._store.spark.conf.get("spark.sql.shuffle.partitions"))
        dirs = self._write(name, rows, by or [], n)
        self._tables[name] = {"by": by or [], "n": n, "schema": rows.schema.jsonValue(), "dirs": dirs}

    def append(self, name: str, rows: DataFrame) -> None:
        """Stage additional rows of a table."""
        if name not in self._tables:
            return self.replace(name, rows)
        entry = self._tables[name]
        for b, dirs in self._write(name, rows, entry["by"], entry["n"]).items():
            entry["dirs"].setdefault(b, []).extend(dirs)
        self._widen(entry, rows.schema)

    def take_over(self, name: str, placed: Placed) -> None:
        """Stage rows that lie in the store already, in a keyed table's buckets."""
        new = {"by": placed.by, "n": placed.n, "schema": placed.schema.jsonValue(), "dirs": {}}
        entry = self._tables.setdefault(name, new)
        for b, folder in placed.dirs.items():
            entry["dirs"].setdefault(b, []).append(folder)
        self._widen(entry, placed.schema)

    def replace_buckets(self, name: str, rows: DataFrame, buckets: list[int] | None) -> None:
        """Stage new contents of some buckets of a keyed table (None: of the whole table)."""
        entry = self._tables[name]
        if buckets is None:
            return self.replace(name, rows, entry["by"])
        for b in buckets:
            entry["dirs"].pop(str(b), None)
        entry["dirs"].update(self._write(name, rows, entry["by"], entry["n"]))
        self._widen(entry, rows.schema)

    @staticmethod
    def _widen(entry: dict, schema: T.StructType) -> None:
        known = {f["name"] for f in entry["schema"]["fields"]}
        entry["schema"]["fields"] += [f.jsonValue() for f in schema.fields if f.name not in known]

    def commit(self) -> None:
        store = self._store
        target = store._commit(self.number + 1)
        text = json.dumps(self._tables) + "\n"
        try:
            out = store._fs.create(target, False)
        except Exception as e:
            raise CommitConflict(f"commit {self.number + 1} exists already") from e
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()
        store._seen = self.number + 1, json.loads(text)
