import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from centavo.llm import neighbours
from centavo.llm.queries import QUERIES


def brute(rows, k=5):
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v) and i is not None]
    out = {}
    for q, x in good:
        if q % 50:
            continue
        near = sorted((-float(x @ y) / math.sqrt(float(x @ x) * float(y @ y)), i) for i, y in good if i != q)
        out[q] = [(i, -s) for s, i in near[:k]]
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_recall_and_scores(spark, sf):
    path = f"/root/testdata/{sf}"
    given = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    want, got = brute(given), {}
    for r in sorted(QUERIES["op9_nearest_neighbours"](spark, path).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want)
    same = 0
    for q, near in want.items():
        assert [r for r, _, _ in got[q]] == [1, 2, 3, 4, 5]
        assert [(-s, i) for _, i, s in got[q]] == sorted((-s, i) for _, i, s in got[q])
        same += len({i for i, _ in near} & {i for _, i, _ in got[q]})
    assert same >= 0.9 * 5 * len(want)


def test_odd_rows_few_rows_and_blocks(spark):
    one, nan, inf = [1.0, 2.0, 0.5], float("nan"), float("inf")
    rows = [(0, one), (50, [2.0, 4.0, 1.0]), (7, one), (3, one), (3, one), (100, None), (150, [0.0] * 3), (200, [1.0, None, 1.0]),
            (250, [nan, 1.0, 1.0]), (300, [inf, 1.0, 1.0]), (350, [1.0]), (None, one), (-50, [-1.0, 0.0, 0.1])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<float>, score string")
    for block in (1, 2048):
        out = neighbours.search(frame, F.col("vec_id") % 50 == 0, block=block).collect()
        got = {q: [(r.rank, r.vec_id) for r in sorted(out, key=lambda r: r.rank) if r.query_id == q] for q in {r.query_id for r in out}}
        assert set(got) == {0, 50, -50}
        assert got[50] == [(1, 0), (2, 3), (3, 3), (4, 7), (5, -50)]
        assert got[0] == [(1, 3), (2, 3), (3, 7), (4, 50), (5, -50)]


def test_empty_table(spark):
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert neighbours.search(none, F.col("vec_id") % 50 == 0).collect() == []
