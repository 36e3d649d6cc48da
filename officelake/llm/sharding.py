"""Sharding along a Hilbert curve: rows near each other in several metadata dimensions share a shard.

Every dimension is quantised by its exact distribution, the quantised values give each row a place on the curve, rows
are sorted by it, and the sorted rows are cut into runs of equal count or equal bytes. A reader who filters by any of
the dimensions then skips most files by their smallest and largest values. Only DataFrame functions are used, and no
step needs all rows, or all rows of one source, in a task: distributions combine map-side, the sort is by range, and
positions come from counts per sorted piece.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from officelake.llm.common import small_side
from officelake.operators.ordering import global_index, running_total

#: Dimensions of ``documents``: names of columns; numbers by size, everything else by code point.
DIMENSIONS = ("source", "lang", "n_chars", "doc_id")
BITS = 5
#: Numbers are counted in so many classes per power of two, 2 * 64 * 64 classes at most.
PER_OCTAVE = 64
LAWS = ("rows", "bytes")


def curve_table(n: int) -> list[int]:
    """The curve's step for every (orientation, corner): next orientation << n, plus the corner's place on the curve.

    An orientation is the corner at which the curve enters a cube and the axis along which it leaves; those that can
    be reached from the first one are numbered as they are found.
    """
    full = (1 << n) - 1
    turn = lambda x, k: ((x << k % n) | (x >> (n - k % n))) & full
    gray = [i ^ (i >> 1) for i in range(1 << n)]
    place_of = {g: i for i, g in enumerate(gray)}
    ones = lambda i: ((i ^ (i + 1)).bit_length() - 1) % n  # noqa: E731  trailing ones
    enter = [0] + [gray[(i - 1) // 2 * 2] for i in range(1, 1 << n)]
    leave = [0] + [ones(i if i % 2 else i - 1) for i in range(1, 1 << n)]
    known, table = {(0, 0): 0}, []
    todo = [(0, 0)]
    for corner, axis in todo:
        for at in range(1 << n):
            place = place_of[turn(at ^ corner, n - (axis + 1) % n)]
            after = (corner ^ turn(enter[place], axis + 1), (axis + leave[place] + 1) % n)
            if after not in known:
                known[after] = len(known)
                todo.append(after)
            table.append(known[after] << n | place)
    return table


def hilbert(coordinates: Sequence[Column], bits: int) -> Column:
    """Place on the Hilbert curve of a point whose coordinates are integers from 0 to 2^bits - 1."""
    n = len(coordinates)
    table = F.lit(curve_table(n))

    def step(state: Column, level: Column) -> Column:
        corner = sum((F.call_function("shiftright", c, level).bitwiseAND(1) * (1 << i) for i, c in enumerate(coordinates)), F.lit(0))
        code = F.get(table, (state["turn"] * (1 << n) + corner).cast("int"))
        return F.struct(F.shiftright(code, n).alias("turn"), (state["place"] * (1 << n) + code.bitwiseAND((1 << n) - 1)).alias("place"))

    start = F.struct(F.lit(0).alias("turn"), F.lit(0).cast("long").alias("place"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step, lambda s: s["place"])


def _classes(df: DataFrame, name: str) -> tuple[Column, Column]:
    """(number, text) by which a dimension is ordered; one of them is null."""
    kind = dict(df.dtypes)[name]
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        x = F.col(name).cast("double")
        return F.when(F.isnan(x), None).otherwise(F.floor(F.signum(x) * F.log2(F.abs(x) + 1) * PER_OCTAVE)).cast("long"), F.lit(None).cast("string")
    return F.lit(None).cast("long"), F.col(name).cast("string")


def quantised(df: DataFrame, dimensions: Sequence[str], bits: int = BITS, name: str = "at") -> DataFrame:
    """``df`` with an array ``name``: for every dimension the 2^bits-tile of its rows that holds the row's value.

    Equal values share a tile, which is the one of the middle row among them; nulls come last. Value counts combine
    map-side and are summed up over a range sort, so a dimension may have any number of values.
    """
    classes = [_classes(df, d) for d in dimensions]
    counts = (
        df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), x.alias("number"), t.alias("value")) for i, (x, t) in enumerate(classes)])).alias("c"))
        .groupBy("c.dim", "c.number", "c.value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    total = df.count()
    order = [F.col("number").asc_nulls_last(), F.col("value").asc_nulls_last()]
    upto = running_total(counts, ["dim"], order, F.col("rows"), "upto").withColumn(
        "tile", F.expr(f"cast((2 * upto - rows) * {1 << bits} div {2 * max(total, 1)} as int)")
    )
    out = df.select(F.struct("*").alias("row"), *[c.alias(f"{k}{i}") for i, (x, t) in enumerate(classes) for k, c in (("x", x), ("t", t))])
    for i in range(len(dimensions)):
        tiles = upto.where(F.col("dim") == i).select(F.col("number").alias(f"nx{i}"), F.col("value").alias(f"nt{i}"), F.col("tile").alias(f"at{i}"))
        same = F.col(f"x{i}").eqNullSafe(F.col(f"nx{i}")) & F.col(f"t{i}").eqNullSafe(F.col(f"nt{i}"))
        out = out.join(small_side(tiles), same)
    return out.select("row.*", F.array(*[F.col(f"at{i}") for i in range(len(dimensions))]).alias(name))


def placed(
    docs: DataFrame, shards: int, law: str = "rows", dimensions: Sequence[str] = DIMENSIONS, bits: int = BITS, carry: bool = False
) -> DataFrame:
    """(doc_id, size, text_crc32, curve, shard, slot), and with ``carry`` the whole row as ``row``.

    By the law ``rows`` shards differ by one row at most; by ``bytes`` each shard ends with the row in which its
    share of the bytes ends. ``slot`` counts the rows of a shard along the curve from 0; rows at one place of the curve
    are ordered by id (nulls last), size and checksum, and rows equal in all of these by chance, which no result shows.
    A null text has no bytes and the checksum 0; an empty table gives no rows; a column named as a dimension that the
    table lacks is an error; other columns are only read for ``carry`` and may have any name.
    """
    if law not in LAWS:
        raise ValueError(f"law must be one of {LAWS}")
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        F.struct(
            F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32")
        ).alias("doc"),
        *[F.col(d).alias(f"d{i}") for i, d in enumerate(dimensions)],
        *([F.struct("*").alias("row")] if carry else []),
    )
    ranked = quantised(narrow, [f"d{i}" for i in range(len(dimensions))], bits)
    keyed = ranked.select("doc.*", hilbert([F.get("at", i) for i in range(len(dimensions))], bits).alias("curve"), *(["row"] if carry else []))
    keyed = keyed.withColumn("chance", F.monotonically_increasing_id())
    order = [F.col("curve"), F.col("doc_id").asc_nulls_last(), F.col("size"), F.col("text_crc32"), F.col("chance")]
    whole = docs.select(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length(text).cast("long") + 1).alias("bytes")).first()
    if law == "rows":
        at = global_index(keyed, order, "at").withColumn("shard", F.expr(f"cast(at * {shards} div {max(1, whole['rows'])} as int)"))
    else:
        summed = running_total(keyed, [], order, F.col("size"), "upto")
        at = global_index(summed, [F.col("upto")], "at").withColumn(
            "shard", F.expr(f"cast(greatest(0, ((upto - size) + size div 2)) * {shards} div {max(1, whole['bytes'] or 0)} as int)")
        )
    first = at.groupBy("shard").agg(F.min("at").alias("first")).select(F.col("shard").alias("of"), "first")
    found = at.join(small_side(first), F.col("shard") == F.col("of"))
    return found.select("doc_id", "size", "text_crc32", "curve", *(["row"] if carry else []), "shard", (F.col("at") - F.col("first")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int, law: str = "rows", dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Write whole rows as Parquet, a folder ``shard=n`` each with its rows along the curve, and return the manifest.

    The manifest has one row per shard: rows, bytes and the smallest and largest value of every dimension.
    """
    found = placed(docs, shards, law, dimensions, carry=True).select("row.*", F.col("shard").alias("_shard"), F.col("slot").alias("_slot"), F.col("size").alias("_size"))
    sorted_ = found.repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot")
    sorted_.withColumn("shard", F.col("_shard")).drop("_shard", "_slot", "_size").write.partitionBy("shard").parquet(path)
    return manifest(found, dimensions)


def manifest(found: DataFrame, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """(shard, rows, bytes, lo, hi) from rows with ``_shard`` and ``_size``; lo and hi are structs of the dimensions."""
    lo = F.struct(*[F.min(d).alias(d) for d in dimensions])
    hi = F.struct(*[F.max(d).alias(d) for d in dimensions])
    return found.groupBy(F.col("_shard").alias("shard")).agg(F.count(F.lit(1)).alias("rows"), F.sum("_size").alias("bytes"), lo.alias("lo"), hi.alias("hi"))
