import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from centavo.llm import hilbert
from centavo.llm.queries import QUERIES


def position(x, bits):
    """Hilbert index by turning each cube, independent of the column form."""
    x, n, m = list(x), len(x), 1 << (bits - 1)
    q = m
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, m
    while q > 1:
        if x[-1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    out = 0
    for level in range(bits - 1, -1, -1):
        for v in x:
            out = out * 2 + (v >> level & 1)
    return out


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_curve_is_one_path(spark, dims, bits):
    size = 1 << (dims * bits)
    names = [f"d{i}" for i in range(dims)]
    cells = spark.range(size).select(*[F.shiftright("id", i * bits).bitwiseAND((1 << bits) - 1).cast("int").alias(n) for i, n in enumerate(names)])
    rows = sorted(((r.curve, tuple(r)[:dims]) for r in hilbert.with_curve(cells, names, bits).collect()))
    assert [c for c, _ in rows] == list(range(size))
    assert all(position(x, bits) == c for c, x in rows)
    assert all(sum(abs(a - b) for a, b in zip(x, y, strict=True)) == 1 for (_, x), (_, y) in zip(rows, rows[1:], strict=False))


def check_law(rows, given, law):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in given
    )
    counts = Counter(r.shard for r in rows)
    for s, n in counts.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    if law == "rows":
        all_counts = [counts.get(s, 0) for s in range(24)]
        assert max(all_counts) - min(all_counts) <= 1 and set(counts) <= set(range(24))
    else:
        whole, largest = sum(r.size for r in rows), max(r.size for r in rows)
        per = Counter()
        for r in rows:
            per[r.shard] += r.size
        assert all(abs(per[s] - whole / 24) <= largest for s in range(24))


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_laws(spark, law):
    path = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    rows = hilbert.shard(hilbert.document_cells(docs), ["d_source", "d_lang", "d_size", "d_id"], law=law).collect()
    check_law(rows, [(r.doc_id, r.text) for r in docs.collect()], law)
    order = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in order] == sorted(r.curve for r in rows)
    assert all(r.curve == position((r.d_source, r.d_lang, r.d_size, r.d_id), hilbert.BITS) for r in rows)


def test_shards_prune(spark):
    rows = hilbert.shard(hilbert.document_cells(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")), ["d_source", "d_lang", "d_size", "d_id"])
    per = rows.groupBy("shard").agg(F.countDistinct("d_source").alias("sources"), F.countDistinct("d_id").alias("ids")).collect()
    assert sum(r.sources * r.ids for r in per) / len(per) < 0.6 * 16 * 15


def test_odd_rows(frame, spark):
    given = [(i, t) for i, t in enumerate([None, "", "é" * 50_000, "a", "a"] + ["copy"] * 40)] + [(None, "x"), (None, "x"), (7, "again")]
    rows = hilbert.shard(hilbert.document_cells(frame(given)), ["d_source", "d_lang", "d_size", "d_id"]).collect()
    check_law(rows, given, "rows")
    few = hilbert.shard(hilbert.document_cells(frame(["one"])), ["d_source", "d_lang", "d_size", "d_id"]).collect()
    assert [(r.shard, r.slot) for r in few] == [(0, 0)]
    for law in ("rows", "bytes"):
        assert hilbert.shard(hilbert.document_cells(frame([])), ["d_source", "d_lang", "d_size", "d_id"], law=law).collect() == []


def test_query_is_native(spark, small):
    df = QUERIES["op7_hilbert_sharding"](spark, small)
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert df.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
