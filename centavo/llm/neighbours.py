"""Approximate nearest neighbours by cross-polytope hashing.

A table of the index turns a vector by three rounds of random signs and a fast Hadamard transform
and keeps the signed axis nearest to it. A query probes the few nearest axes of every table; a row
that shares a probed axis in some table is a candidate and is scored exactly, in double precision.

`build_index` covers every row and is written once. `search` takes queries in blocks of at most
about `block` rows; each block is one pass over the index in which every task keeps the k best per
query of what it has read, so what leaves a task does not depend on how many rows share an axis.
A query with fewer than k candidates is searched again against all rows.

Vectors that are null, all zero, hold null or non-finite components, or are not of the table's
commonest length take no part, nor do rows without an id. A row with the query's id is the query's
own; rows repeated under another id are candidates each, ties go to the smaller id. A repeated query id is
one query. Only the id and the vector column are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from centavo.session import written

TABLES, PROBES, BLOCK = 20, 4, 2048
SLICE = 512
HITS = "query_id bigint, vec_id bigint, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("bigint"), v.alias("embedding")).where(fine)
    common = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("embedding") == (common.n if common else 0))


def rotations(dim: int, tables: int, seed: int = 0) -> np.ndarray:
    """Random signs: tables x 3 x dim padded to a power of two."""
    wide = 1 << max(0, dim - 1).bit_length()
    return np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 3, wide))


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    wide = signs.shape[1]
    y = np.zeros((len(x), wide))
    y[:, : x.shape[1]] = x
    for s in signs:
        y, h = y * s, 1
        while h < wide:
            z = y.reshape(len(y), -1, 2, h)
            y = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], 2).reshape(len(y), wide)
            h *= 2
    return y


def axes(x: np.ndarray, signs: np.ndarray, count: int) -> np.ndarray:
    """The `count` nearest signed axes of each row in each table: rows x tables x count."""
    out = []
    for s in signs:
        y = rotate(x, s)
        both = np.concatenate([y, -y], 1)
        out.append(np.argsort(-both, 1, kind="stable")[:, :count] if count > 1 else np.argmax(both, 1)[:, None])
    return np.stack(out, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def build_index(vectors: DataFrame, tables: int = TABLES, seed: int = 0) -> DataFrame:
    """vec_id, embedding and the axis in each table, of every usable row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            codes = axes(x, rotations(x.shape[1], tables, seed), 1)[:, :, 0].astype(np.int32)
            flat = pa.ListArray.from_arrays(np.arange(0, codes.size + 1, tables, dtype=np.int32), codes.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), flat], ["vec_id", "embedding", "codes"])

    return usable(vectors).mapInArrow(run, "vec_id bigint, embedding array<double>, codes array<int>")


def _search_block(index: DataFrame, ids: np.ndarray, x: np.ndarray, k: int, tables: int, probes: int, seed: int, every: bool) -> DataFrame:
    """The k best candidates of each query in each task."""
    signs = rotations(x.shape[1], tables, seed)
    probed = np.zeros((tables, 2 * signs.shape[2], len(ids)), bool)
    if every:
        probed[:] = True
    else:
        own = axes(x, signs, min(probes, 2 * signs.shape[2]))
        for t in range(tables):
            for p in range(own.shape[2]):
                probed[t, own[:, t, p], np.arange(len(ids))] = True
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))  # query, vec_id, score
        least = np.full(len(ids), -np.inf)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                rows, v, codes = np.asarray(part.column(0)), _matrix(part.column(1)), _matrix(part.column(2))
                mask = np.zeros((len(rows), len(ids)), bool)
                for t in range(tables):
                    mask |= probed[t][codes[:, t]]
                mask &= rows[:, None] != ids[None, :]
                size = np.sqrt(np.einsum("ij,ij->i", v, v))
                new = []
                r, q = np.nonzero(mask)
                for i in range(0, len(r), 1 << 15):
                    a, b = r[i : i + (1 << 15)], q[i : i + (1 << 15)]
                    score = np.einsum("ij,ij->i", v[a], x[b]) / (size[a] * norm[b])
                    good = score >= least[b]
                    new.append((b[good], rows[a[good]], score[good]))
                if new:
                    query, vec, score = (np.concatenate(c) for c in zip(best, *new, strict=True))
                    order = np.lexsort((vec, -score, query))
                    query, vec, score = query[order], vec[order], score[order]
                    first = np.searchsorted(query, query)
                    rank = np.arange(len(query)) - first
                    best = (query[rank < k], vec[rank < k], score[rank < k])
                    full = rank == k - 1
                    least[query[full]] = score[full]
        if len(best[0]):
            yield pa.RecordBatch.from_arrays([pa.array(ids[best[0]]), pa.array(best[1]), pa.array(best[2])], ["query_id", "vec_id", "score"])

    return index.select("vec_id", "embedding", "codes").mapInArrow(run, HITS)


def _blocks(queries: DataFrame, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Queries by blocks of about `block` rows, one at a time on the driver."""
    n = max(1, -(-queries.count() // block))
    for b in range(n):
        rows = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(n)) == b).collect() if n > 1 else queries.collect()
        if rows:
            yield np.array([r.vec_id for r in rows], np.int64), np.array([r.embedding for r in rows])


def _search(index: DataFrame, queries: DataFrame, k: int, tables: int, probes: int, block: int, seed: int, every: bool) -> DataFrame:
    parts = [_search_block(index, ids, x, k, tables, probes, seed, every) for ids, x in _blocks(queries, block)]
    spark = index.sparkSession
    hits = parts[0] if parts else spark.createDataFrame([], HITS)
    for part in parts[1:]:
        hits = hits.unionByName(part)
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)


def search(vectors: DataFrame, is_query, k: int = 5, tables: int = TABLES, probes: int = PROBES, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every usable row for which `is_query` holds."""
    index = written(build_index(vectors, tables, seed), "vector-index")
    queries = index.where(is_query).select("vec_id", "embedding").dropDuplicates(["vec_id"])
    found = written(_search(index, queries, k, tables, probes, block, seed, False), "vector-hits")
    enough = found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = queries.join(enough, "vec_id", "left_anti")
    again = _search(index, short, k, tables, probes, block, seed, True)
    settled = found.join(enough.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi")
    return settled.unionByName(again).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
