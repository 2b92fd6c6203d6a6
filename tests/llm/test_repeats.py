import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from centavo.llm import repeats


def brute(texts, length=200):
    raws = [(t or "").encode() for t in texts]
    times = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if times[r[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def words(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 8))) for _ in range(n))


def case():
    random.seed(8)
    passages = [words(n, i) for i, n in enumerate([30, 45, 60, 120, 200])]
    texts = []
    for i in range(120):
        parts = [words(random.randint(0, 60), 1000 + i)]
        for _ in range(random.randint(0, 3)):
            p = random.choice(passages)
            if random.random() < 0.5:
                k = random.randrange(len(p))
                p = p[:k] + random.choice("xyz") + p[k + 1 :]
            parts += [p[random.randint(0, 40) :], words(random.randint(0, 30), random.random())]
        texts.append("".join(parts))
    same = words(80, "s")
    texts += [None, "", "short", "short", same, same, same + "!", "a" * 5000, "ab" * 700 + "c", "é" * 300, words(50, 1) * 2, passages[4][:200], passages[4][:199]]
    return texts


def rows_of(frame, texts):
    rows = repeats.digest(repeats.remove_repeats(frame(texts))).collect()
    return [tuple(r)[1:] for r in sorted(rows, key=lambda r: r.doc_id)]


def test_equals_brute_force(frame):
    assert rows_of(frame, case()) == brute(case())


@pytest.mark.parametrize(("many", "here"), [(2, 32), (512, 1)])
def test_split_anchors_give_the_same(frame, monkeypatch, many, here):
    monkeypatch.setattr(repeats, "MANY", many)
    monkeypatch.setattr(repeats, "MANY_HERE", here)
    assert rows_of(frame, case()) == brute(case())


def test_given_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    given = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: tuple(r)[1:] for r in repeats.digest(repeats.remove_repeats(docs)).collect()}
    assert got == dict(zip(given, brute(given.values()), strict=True))


def test_suffix_order():
    random.seed(3)
    data = np.frombuffer(("".join(random.choices("ab", k=900)) * 3).encode() + b"c" * 200, np.uint8)
    place = np.array(random.sample(range(2600), 500))
    group = np.sort(np.array(random.choices(range(7), k=500)))
    order = repeats.suffix_order(repeats.Prefix(data), data, group, place)
    key = lambda i: (group[i], data[place[i] : place[i] + 200].tobytes())
    assert [key(i) for i in order] == sorted(map(key, range(500)))
    assert sorted(order.tolist()) == list(range(500))


def test_odd_rows(frame):
    text = words(90, 1)
    rows = repeats.remove_repeats(frame([(None, text), (None, text), (4, None), (4, "x"), (5, text)])).collect()
    assert sorted([(r.doc_id, r.n_removed) for r in rows], key=str) == sorted([(None, len(text.encode()))] * 2 + [(4, 0), (4, 0), (5, len(text.encode()))], key=str)
    assert repeats.remove_repeats(frame([])).collect() == []
