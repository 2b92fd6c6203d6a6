import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from centavo.llm import middle

ODD = ["", None, "\n", "\n\n\n", "a", "a\n", "no end\nof line", "é\nüß\n😀\n你", "x<P>y\nz", "a<S", "<M>\n", "tail<", "S>\nb\nP>", "\r\n\r\n", "same\n", "same\n"]


def brute(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    told = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(told[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, len(units), "plain", text, None, None
    if h[3] % 100 < spm:
        return doc_id, len(units), "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return doc_id, len(units), "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


def compare(docs, rows, **options):
    got = sorted(map(tuple, middle.fill_in_middle(docs, **options).collect()), key=str)
    want = sorted((brute(i, t, options.get("seed", 7), options.get("rate", 100), options.get("spm_rate", 50)) for i, t in rows), key=str)
    assert got == want


def test_rank_and_select():
    random.seed(3)
    data = np.array([random.choice([10, 10, 65, 0x8A, 0, 9, 11]) for _ in range(1003)], np.uint8)
    marks = middle.unit_ends(middle.as_words(data), np.array([0, 1003]))
    want = sorted({*np.flatnonzero(data == 10).tolist(), 1002})
    assert marks.select(np.arange(1, len(want) + 1)).tolist() == want
    assert marks.rank(np.arange(1004)).tolist() == [sum(w < k for w in want) for k in range(1004)]


def test_odd_rows(spark, frame):
    random.seed(5)
    made = ["".join(random.choices(["a", "é", "😀", "\n", "bc", "<", "P>", "\x00"], k=random.randint(0, 60))) for _ in range(400)]
    rows = list(enumerate(ODD + made + ["line\n" * 200_000 + "é" * 100_000]))
    rows += [(3, "another text\nwith this id"), (None, "no id\nat all\n"), (-5, "below\nzero")]
    compare(frame(rows), rows)
    compare(frame(rows[:200]), rows[:200], seed=11, rate=40, spm_rate=90)
    assert middle.fill_in_middle(frame([]).limit(0)).count() == 0


def test_documents_and_round_trip(spark, small, frame):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    compare(docs, rows)
    rows += list(enumerate(ODD, 10_000))
    made = middle.fill_in_middle(frame(rows))
    back = dict(made.select("doc_id", middle.restored(F.col("form"), F.col("output"))).collect())
    assert back == {i: t or "" for i, t in rows}
    assert {r.form for r in made.collect()} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("form,output", [(None, "a"), ("psm", None)])
def test_nothing_to_restore(spark, form, output):
    row = spark.createDataFrame([(form, output)], "form string, output string")
    assert row.select(middle.restored(F.col("form"), F.col("output"))).first()[0] is None
