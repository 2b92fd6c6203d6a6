import random
import re

import numpy as np
import pytest

from centavo.llm import components, jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """rows: (doc_id, text)."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(d, least.get(top(i), d))
    return [(d, len(sets[i]), least[top(i)]) for i, (d, _) in enumerate(rows)]


def made(seed, groups=25, vocabulary=400):
    random.seed(seed)
    v = [f"w{i}" for i in range(vocabulary)] + ["É", "The", "x,"]
    passage = random.choices(v, k=60)
    texts = []
    for _ in range(groups):
        base = random.choices(v, k=random.choice([1, 3, 5, 8, 30, 80, 200]))
        if random.random() < 0.4:
            base = base[: len(base) // 2] + passage + base[len(base) // 2 :]
        for _ in range(random.randint(1, 12)):
            copy = list(base)
            for _ in range(random.randint(0, max(1, len(base) // 25))):
                k = random.randrange(len(copy))
                copy[k : k + random.randint(0, 1)] = random.choices(v, k=random.randint(0, 2))
            texts.append(" ".join(copy))
    random.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", range(6))
def test_tree_join_finds_every_pair(seed):
    sets = list(dict.fromkeys(frozenset(shingles(t)) for t in made(seed) if t.split()))
    ids = {s: i for i, s in enumerate({x for y in sets for x in y})}
    arrays = [np.array(sorted(ids[x] for x in s), np.uint64) for s in sets]
    want = {(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    got = set(zip(*[x.tolist() for x in jaccard.tree_join(arrays, None, 75)]))
    assert {tuple(sorted(p, reverse=True)) for p in got} == want and len(got) == len(want)
    half = len(arrays) // 2
    cross = set(zip(*[x.tolist() for x in jaccard.tree_join(arrays[:half], arrays[half:], 75)]))
    assert {(j + half, i) for i, j in cross} == {(i, j) for i, j in want if i >= half > j}


@pytest.mark.parametrize("unit", [1024, 3])
def test_components_equal_brute_force(frame, unit):
    texts = [*made(7), None, "", " \n", "same", "same", "Same", "é " * 30_000, "é " * 30_001]
    random.seed(1)
    ids = random.sample(range(10_000), len(texts))
    rows = list(zip(ids, texts, strict=True))
    got = jaccard.jaccard_components(frame(rows), unit=unit, share=0.05).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute(rows))


def test_repeated_and_missing_ids(frame):
    long = "one two three four five six seven"
    rows = [(5, long), (5, "quite another text of seven words here"), (9, long), (3, long + " "), (None, long), (None, "no id at all in this row")]
    got = sorted(jaccard.jaccard_components(frame(rows)).collect(), key=str)
    assert sorted([(r.doc_id, r.component_id) for r in got], key=str) == sorted([(5, 3), (5, 5), (9, 3), (3, 3), (None, 3), (None, None)], key=str)
    kept = jaccard.keep_smallest(frame(rows))
    assert sorted([r.doc_id for r in kept.collect()], key=str) == sorted([3, 5, None, None], key=str)


def test_a_repeated_id_loses_no_text(frame):
    t, u = "one two three four five six seven", "quite another text of seven words here"
    rows = [(2, t), (2, u), (3, u), (2, u.upper()), (4, None), (4, " "), (5, t + " "), (6, u)]
    kept = jaccard.keep_smallest(frame(rows)).collect()
    assert sorted((r.doc_id, (r.text or "").lower()) for r in kept) == sorted([(2, t), (2, u), (4, ""), (4, " ")])


def test_empty_table(frame):
    assert jaccard.jaccard_components(frame([])).collect() == []
    assert jaccard.keep_smallest(frame([])).collect() == []


def test_components_of_a_path(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7)]
    got = {r.id: r.label for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == dict.fromkeys(range(41), 0) | dict.fromkeys((100, 101, 102), 100)
