"""Compression of vectors to codes of one entry per part, with equal-average search for the nearest entry.

Components become integers, floor(256 * x), and a vector is cut into equal consecutive parts. Each position has a
codebook of at most 64 entries, begun with the parts of the vectors of smallest id and improved by rounds: every part
goes to its nearest entry, and an entry becomes the floor of the mean of its parts.

Equal-average search: the entries of a position are sorted by the sum of their components. By Cauchy's
inequality the squared gap of two sums is at most the dimension times the squared distance, so from the place of a
part's own sum the search moves outward, the nearer sum first, and ends when the squared gap exceeds
dimension times the best distance. The end is strict, so an entry that ties is always met and the lower index
wins. All parts of a batch move together; those that have ended leave.

A round is one narrow pass over the vectors with a sum per (part, entry), added up in each task and then on
Spark; what reaches the driver and the tasks is a codebook of parts * entries rows, whatever the table's size. Sums are exact integers.

Vectors that are null or hold null or non-finite components are dropped, and so are rows without an id and vectors whose
length is not that of the vector of smallest id (it must be divisible by the number of parts). Components beyond 2^15 in
size are refused, since distances must stay exact. Rows with the same id are coded each; the codebook takes the smaller vector
first. Fewer vectors than entries give as many entries; an empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centavo.llm.arrow import map_batches

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LARGEST = 1 << 15  # of a component before scaling
SALTS = 16


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label and the integer components of the usable rows."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(fine)
    small = F.assert_true(F.forall("embedding", lambda x: F.abs(x) <= LARGEST), F.lit(f"a component is larger than {LARGEST}"))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("int"))
    return rows.select(F.col("vec_id").cast("bigint"), "label", F.when(small.isNull(), whole).alias("x"))


def first_codebook(rows: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """Parts of the vectors of smallest id, as part x entry x component; None without rows."""
    first = rows.select("vec_id", "x").orderBy("vec_id", "x").limit(1).first()
    if first is None:
        return None
    if not first.x or len(first.x) % parts:
        raise ValueError(f"vectors of {len(first.x)} components cannot be cut into {parts} equal parts")
    same = rows.where(F.size("x") == len(first.x)).select("vec_id", "x").orderBy("vec_id", "x").limit(entries)
    chosen = np.array([r.x for r in same.orderBy("vec_id", "x").collect()], np.int64)
    return chosen.reshape(len(chosen), parts, -1).transpose(1, 0, 2)


class Codebook:
    """The entries of one position, in the order of their sums."""

    def __init__(self, entries: np.ndarray) -> None:
        total = entries.sum(1)
        self.order = np.argsort(total, kind="stable")
        self.entries, self.total = entries[self.order], total[self.order]

    def nearest(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each row, ties to the lower index, and the squared distance."""
        n, dim = part.shape
        best = np.full(n, np.iinfo(np.int64).max)
        index = np.full(n, len(self.order))
        rows, total = np.arange(n), part.sum(1)
        up = np.searchsorted(self.total, total)
        down = up - 1
        far = np.iinfo(np.int64).max
        while len(rows):
            gap_up = np.where(up < len(self.total), np.abs(self.total[np.minimum(up, len(self.total) - 1)] - total), far)
            gap_down = np.where(down >= 0, np.abs(total - self.total[np.maximum(down, 0)]), far)
            rising = gap_up <= gap_down
            gap = np.where(rising, gap_up, gap_down)
            go = gap < far
            go[go] = gap[go] ** 2 <= np.minimum(best[rows[go]], far // dim) * dim
            rows, total, up, down, rising = rows[go], total[go], up[go], down[go], rising[go]
            place = np.where(rising, up, down)
            distance = ((part[rows] - self.entries[place]) ** 2).sum(1)
            entry = self.order[place]
            closer = (distance < best[rows]) | ((distance == best[rows]) & (entry < index[rows]))
            best[rows[closer]], index[rows[closer]] = distance[closer], entry[closer]
            up, down = up + rising, down - ~rising
        return index, best


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1).astype(np.int64)


def _nearest(books: list[Codebook], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of every part: rows x parts each."""
    split = x.reshape(len(x), len(books), -1)
    found = [book.nearest(split[:, p]) for p, book in enumerate(books)]
    return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def improved(rows: DataFrame, codebook: np.ndarray) -> np.ndarray:
    """The codebook after one round. Every task adds up its parts and sends one row per (part, entry) it met."""
    parts, entries, dim = codebook.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Codebook(c) for c in codebook]
        sums, counts = np.zeros_like(codebook), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = _matrix(batch.column(0))
            if not len(x):
                continue
            found, _ = _nearest(books, x)
            split = x.reshape(len(x), parts, dim)
            for p in range(parts):
                np.add.at(sums[p], found[:, p], split[:, p])
                counts[p] += np.bincount(found[:, p], minlength=entries)
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "total"]
        )

    met = rows.select("x").mapInArrow(run, "part int, entry int, n bigint, total array<bigint>")
    totals = [F.sum(F.col("total")[k]).alias(f"t{k}") for k in range(dim)]
    out = codebook.copy()
    for r in met.groupBy("part", "entry").agg(F.sum("n").alias("n"), *totals).collect():  # at most parts * entries rows
        out[r.part, r.entry] = [r[f"t{k}"] // r.n for k in range(dim)]
    return out


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """part x entry x component of the final codebook of quantised rows; None without rows."""
    codebook = first_codebook(rows, parts, entries)
    if codebook is None:
        return None
    same = rows.where(F.size("x") == codebook.shape[0] * codebook.shape[2])
    for _ in range(rounds):
        codebook = improved(same, codebook)
    return codebook


def encode(rows: DataFrame, codebook: np.ndarray) -> DataFrame:
    """vec_id, label, codes (an entry per part) and error, the sum of the squared distances, of quantised rows."""
    parts, _, dim = codebook.shape
    books = [Codebook(c) for c in codebook]
    kind = rows.schema["label"].dataType.simpleString()

    def fn(batch: pa.RecordBatch):
        found, distance = _nearest(books, _matrix(batch.column(2)))
        codes = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * parts, pa.int32()), pa.array(found.ravel(), pa.int32()))
        yield {"vec_id": batch.column(0), "label": batch.column(1), "codes": codes, "error": distance.sum(1)}

    same = rows.where(F.size("x") == parts * dim).select("vec_id", "label", "x")
    return map_batches(same, fn, f"vec_id bigint, label {kind}, codes array<int>, error bigint")


def decode(codes: DataFrame, codebook: np.ndarray) -> DataFrame:
    """vec_id and the integer components that its codes stand for."""
    parts, _, dim = codebook.shape

    def fn(batch: pa.RecordBatch):
        found = _matrix(batch.column(1))
        x = codebook[np.arange(parts), found].reshape(len(found), parts * dim)
        yield {"vec_id": batch.column(0), "x": pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * parts * dim, pa.int32()), pa.array(x.ravel(), pa.int32()))}

    return map_batches(codes.select("vec_id", "codes"), fn, "vec_id bigint, x array<int>")


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds the error summed over the rows of a label; rows without a label together.

    Sums are small; each is dealt to `SALTS` keys, so that the rows of one label meet it in as many tasks.
    """
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    sums = sums.select(F.col("label").alias("_label"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt_of"))
    salted = coded.withColumn("_salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int"))
    met = salted.join(sums, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_salt") == F.col("_salt_of")))
    return met.drop("_label", "_salt", "_salt_of")


def digest(vectors: DataFrame) -> DataFrame:
    """vec_id, code (hex), error, label_error and the hash of the codebooks."""
    rows = quantised(vectors)
    codebook = fit(rows)
    if codebook is None:
        empty = "CAST(vec_id AS BIGINT) AS vec_id, CAST(NULL AS STRING) AS code, 0L AS error, 0L AS label_error, CAST(NULL AS STRING) AS codebooks_sha256"
        return rows.selectExpr(*empty.split(", ")).limit(0)
    told = hashlib.sha256(",".join(map(str, codebook.ravel().tolist())).encode()).hexdigest()
    coded = with_label_error(encode(rows, codebook))
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return coded.select("vec_id", code.alias("code"), "error", "label_error", F.lit(told).alias("codebooks_sha256"))
