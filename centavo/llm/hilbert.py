"""Sharding along a Hilbert curve.

Some metadata columns are brought to a few bits each; the index of their cell on a Hilbert curve
orders all rows, so that rows near in every dimension lie near in the order, and the order is cut
into shards of equal row counts (law "rows") or near equal bytes (law "bytes"). A reader that
filters on any of the dimensions can skip most shards.

A cell that holds many rows is dealt into parts by a hash of its rows, so positions are counted in
many tasks; the counts of the parts are summed up in two levels, and only one row per coarse
stretch of the curve (256) ever meets in one task.

Missing values have a cell of their own at the low end; an empty table has no shards. Rows are
ordered by cell, part, id, checksum and size. Equal rows take neighbouring slots. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from centavo.session import written

SHARDS, BITS = 24, 4
PART_ROWS = 65_536  # most rows of a part, about
PARTS = 512  # a part holds no more than this share of all rows, about


def with_curve(df: DataFrame, dims: list[str], bits: int, name: str = "curve") -> DataFrame:
    """Adds the Hilbert index of the cell (dims: columns of integers under 2^bits).

    The steps of the transform run inside array functions: as columns built on each other they
    would be copied into one another by the optimiser.
    """
    kept = df.columns
    levels = [1 << level for level in range(bits - 1, 0, -1)]
    steps = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(i).alias("i")) for q in levels for i in range(len(dims))])

    def step(x, s):
        first, own, low = x[0], F.element_at(x, s["i"] + 1), s["q"] - 1
        flip = own.bitwiseAND(s["q"]) != 0
        swap = first.bitwiseXOR(own).bitwiseAND(low)
        change = lambda v, k: (
            F.when(k == 0, first.bitwiseXOR(F.when(flip, low).otherwise(swap))).when((k == s["i"]) & ~flip, v.bitwiseXOR(swap)).otherwise(v)
        )
        return F.transform(x, change)

    start = F.array(*[F.col(d).cast("int") for d in dims])
    turned = F.aggregate(steps, start, step) if levels else start
    gray = F.aggregate(turned, F.array().cast("array<int>"), lambda a, v: F.concat(a, F.array(v.bitwiseXOR(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0))))))
    df = df.withColumn("__gray", gray)
    turn = F.lit(0)
    for q in levels:
        turn = turn.bitwiseXOR(F.when(F.col("__gray")[len(dims) - 1].bitwiseAND(q) != 0, F.lit(q - 1)).otherwise(F.lit(0)))
    df = df.withColumn("__turn", turn)
    index = F.lit(0)
    for level in range(bits - 1, -1, -1):
        for i in range(len(dims)):
            index = index * 2 + F.shiftright(F.col("__gray")[i].bitwiseXOR(F.col("__turn")), level).bitwiseAND(1)
    return df.select(*kept, index.cast("int").alias(name))


def document_cells(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32 and four dimensions: source, language, size and place of the id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    top = (1 << bits) - 1
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text).cast("bigint") + 8).alias("size"),
        F.crc32(text).alias("text_crc32"),
        named_cell("source", bits).alias("d_source"),
        named_cell("lang", bits).alias("d_lang"),
    )
    rows = written(rows, "shard-rows")
    ends = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    low, span = ends[0] or 0, (ends[1] or 0) - (ends[0] or 0) + 1
    place = F.floor((F.col("doc_id") - F.lit(low)).cast("double") / F.lit(float(span)) * top) + 1
    return rows.withColumns({
        "d_size": F.least(F.lit(top), F.floor(F.log2("size"))).cast("int"),
        "d_id": F.when(F.col("doc_id").isNull(), 0).otherwise(F.least(F.lit(top), place)).cast("int"),
    })


def named_cell(name: str, bits: int) -> Column:
    """A text column as a cell: 0 for null, else by hash."""
    return F.when(F.col(name).isNull(), 0).otherwise(F.pmod(F.xxhash64(F.col(name).cast("string")), F.lit((1 << bits) - 1)) + 1).cast("int")


def shard(rows: DataFrame, dims: list[str], bits: int = BITS, shards: int = SHARDS, law: str = "rows") -> DataFrame:
    """Adds curve, shard and slot. rows: doc_id, size, text_crc32 and the dimensions."""
    rows = written(with_curve(rows, dims, bits), "shard-curve")
    cells = written(rows.groupBy("curve").agg(F.count("*").alias("n")), "shard-cells")
    total = int(cells.agg(F.sum("n")).first()[0] or 0)
    if law not in ("rows", "bytes"):
        raise ValueError(f"unknown law: {law}")
    per_part = max(1, min(PART_ROWS, -(-total // PARTS)))
    parts = cells.select("curve", F.ceil(F.col("n") / per_part).alias("parts"))
    rows = rows.join(parts, "curve").withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.col("parts"))).drop("parts")

    groups = rows.groupBy("curve", "part").agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    coarse = F.shiftright(F.col("curve"), max(0, len(dims) * bits - 8))
    groups = written(groups.withColumn("coarse", coarse), "shard-groups")
    stretch = groups.groupBy("coarse").agg(F.sum("n").alias("cn"), F.sum("b").alias("cb"))
    up_to = Window.orderBy("coarse").rowsBetween(Window.unboundedPreceding, -1)  # at most 256 rows
    stretch = stretch.select("coarse", *[F.coalesce(F.sum(c).over(up_to), F.lit(0)).alias(c) for c in ("cn", "cb")])
    inside = Window.partitionBy("coarse").orderBy("curve", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.join(stretch, "coarse").select(
        "curve",
        "part",
        (F.col("cn") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("rows_before"),
        (F.col("cb") + F.coalesce(F.sum("b").over(inside), F.lit(0))).alias("bytes_before"),
    )
    order = Window.partitionBy("curve", "part").orderBy("doc_id", "text_crc32", "size")
    placed = rows.withColumns({
        "__n": F.row_number().over(order) - 1,
        "__b": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"),
    }).join(offsets, ["curve", "part"])
    placed = placed.withColumn("position", F.col("rows_before") + F.col("__n"))
    if law == "rows":
        placed = placed.withColumn("shard", F.expr(f"cast(position * {shards} div {max(total, 1)} as int)"))
        begin = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
        return placed.withColumn("slot", F.col("position") - begin).drop("__n", "__b", "part", "rows_before", "bytes_before", "position")
    whole = int(groups.agg(F.sum("b")).first()[0] or 1)
    placed = placed.withColumn("shard", F.expr(f"cast(cast((bytes_before + __b) as decimal(38,0)) * {shards} div {whole} as int)"))
    placed = written(placed, "shard-places")
    begin = placed.groupBy("shard").agg(F.min("position").alias("begin"))  # one row per shard
    out = placed.join(begin, "shard").withColumn("slot", F.col("position") - F.col("begin"))
    return out.drop("__n", "__b", "part", "rows_before", "bytes_before", "position", "begin")
