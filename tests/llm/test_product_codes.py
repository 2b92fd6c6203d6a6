import hashlib
import math
import random

import numpy as np
import pytest

from centavo.llm import product_codes as pc

SCHEMA = "vec_id bigint, embedding array<float>, label int, x string, codes int, error int, part int"


def make(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1, 2, 3) for i, v, label in rows], SCHEMA)


def brute(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v], label) for i, v, label in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0], r[1]))
    dim = len(kept[0][1]) // parts
    kept = [r for r in kept if len(r[1]) == parts * dim]
    cut = [[v[p * dim : p * dim + dim] for p in range(parts)] for _, v, _ in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(c[p], e, strict=True)), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [c[p] for c, f in zip(cut, found, strict=True) if f[p][1] == k]
                if own:
                    books[p][k] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    found = assign()
    told = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] = by_label.get(label, 0) + e
    return sorted((i, "".join(f"{k:02x}" for _, k in f), e, by_label[label], told) for (i, _, label), f, e in zip(kept, found, errors, strict=True))


def test_search_equals_all_distances():
    rng = np.random.default_rng(1)
    for dim, spread in ((1, 3), (4, 2), (4, 300), (8, 40)):
        entries, part = rng.integers(-spread, spread + 1, (64, dim)), rng.integers(-2 * spread, 2 * spread + 1, (2000, dim))
        index, best = pc.Codebook(entries).nearest(part)
        distance = ((part[:, None] - entries[None]) ** 2).sum(2)
        assert (index == distance.argmin(1)).all() and (best == distance.min(1)).all()


def test_embeddings(spark, small):
    table = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = [tuple(r) for r in table.select("vec_id", "embedding", "label").collect()]
    assert sorted(map(tuple, pc.digest(table).collect())) == brute(rows)


def test_odd_rows(spark):
    random.seed(4)
    rows = [(i, [random.choice([-0.5, -0.004, 0.0, 0.25, random.uniform(-2, 2)]) for _ in range(32)], random.choice([None, 1, 1, 2])) for i in range(-20, 150)]
    rows += [(5, rows[0][1], 7), (5, rows[3][1], None), (900, None, 1), (901, [None, *rows[0][1][1:]], 1), (902, [float("nan"), *rows[0][1][1:]], 1)]
    rows += [(903, [float("inf"), *rows[0][1][1:]], 1), (904, [0.5] * 16, 1), (905, [], 1), (None, rows[0][1], 1), *[(1000 + k, rows[0][1], None) for k in range(80)]]
    assert sorted(map(tuple, pc.digest(make(spark, rows)).collect())) == brute(rows)


def test_few_vectors_and_none(spark):
    rows = [(3, [0.1 * k for k in range(16)], None), (1, [0.2] * 16, None)]
    assert sorted(map(tuple, pc.digest(make(spark, rows)).collect())) == brute(rows)
    empty = pc.digest(make(spark, [(1, None, 1)]))
    assert empty.collect() == [] and empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(ValueError):
        pc.digest(make(spark, [(1, [0.5] * 10, 1)]))


def test_decoded_vectors_have_the_stated_error(spark, small):
    rows = pc.quantised(spark.read.parquet(f"{small}/embeddings.parquet"))
    codebook = pc.fit(rows, rounds=1)
    coded = pc.encode(rows, codebook)
    back = {r.vec_id: np.array(r.x) for r in pc.decode(coded, codebook).collect()}
    error = {r.vec_id: r.error for r in coded.collect()}
    for r in rows.collect():
        assert ((back[r.vec_id] - np.array(r.x)) ** 2).sum() == error[r.vec_id]
