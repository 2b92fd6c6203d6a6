"""Nearest text chunks to one question vector. Financial facts are never looked up this way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def nearest_chunks(chunks: DataFrame, asked: DataFrame, k: int, row_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The k chunks of highest cosine similarity, by a full scan and a distributed top-k.

    `asked` is a frame of one row and one vector; it is read as a scalar subquery of the job itself.
    """
    question, own = F.col("_question"), F.col(embedding)
    cosine = _dot(own, question) / (F.sqrt(_dot(own, own)) * F.sqrt(_dot(question, question)))
    return chunks.withColumn("_question", asked.scalar()).select(row_id, F.round(cosine, 6).alias("similarity")).orderBy(F.col("similarity").desc(), row_id).limit(k)
