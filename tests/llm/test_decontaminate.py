import hashlib
import random
import re

import pytest

from centavo.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(item))
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for n in {len(p) for p in windows}:
            for k in range(len(w) - n + 1):
                if owners := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= owners
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def case():
    random.seed(1)
    v = ["a", "b", "É", "c1", "The", "x", "word"]
    texts = [" ".join(random.choices(v, k=random.randint(0, 60))) + random.choice(["", " ", "\x00", "."]) for _ in range(300)]
    items = [(k, ", ".join(random.choices(v, k=random.randint(4, 14)))) for k in range(12)] + [(90, ""), (91, ".."), (92, None)]
    texts += [None, "", "same text", "same text", "y " * 60_000 + (items[0][1] or ""), items[1][1]]
    return texts, items


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_equals_brute_force(spark, frame, block_bytes):
    texts, items = case()
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    scanned = decontaminate.scan(frame(texts), benchmark, block_bytes=block_bytes)
    rows = {r.doc_id: tuple(r)[1:] for r in decontaminate.digest(scanned).collect()}
    assert [rows[i] for i in range(len(texts))] == brute(texts, items)


def test_clean_documents_stay(spark, frame):
    texts, items = case()
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    given = frame(texts)
    kept = decontaminate.drop_contaminated(given, benchmark)
    assert kept.columns == given.columns
    clean = [i for i, row in enumerate(brute(texts, items)) if not row[-1]]
    assert sorted(r.doc_id for r in kept.collect()) == clean


def test_empty_tables(spark, frame):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.digest(decontaminate.scan(frame([]), none)).collect() == []
    row = decontaminate.digest(decontaminate.scan(frame(["one two"]), none)).first()
    assert (row.n_words, row.n_hit, row.contaminated) == (2, 0, False)
