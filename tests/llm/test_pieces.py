import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
import sentencepiece

from centavo.llm import pieces


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def odd_texts():
    random.seed(1)
    v = ["a", "b", " ", "  ", "the", "é", "\n", "你", "😀", "1", "of", " x", "\t", "_", "ing", "▁", "Ünf", "==", "----", "\x00", "\xa0"]
    made = ["".join(random.choices(v, k=random.randint(0, 40))) for _ in range(1500)]
    return [*made, *(" " * k for k in range(40)), "a" * 3000, "ab" * 500, "-" * 100, "word " * 30_000, "same", "same"]


def test_ids_equal_the_library(library):
    texts = odd_texts()
    encoder = pieces.Encoder(pieces.Model.load())
    for part in (texts, texts[::-1]):  # the second time from memory
        ids, bounds = encoder.encode(part)
        for k, text in enumerate(part):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == library.encode(text), text


def test_documents(spark, small, library):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = pieces.encoded_and_checked(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = library.encode(texts[r.doc_id])
        assert r.ids == want and r.n_tokens == len(want) and r.round_trip
        assert r.n_byte_tokens == sum(library.is_byte(i) for i in want)


def test_rows_and_round_trip(frame, spark, library):
    given = [None, "", "é x", "é x", "  two  spaces ", "mark ▁ here"]
    encoded = pieces.encode(frame(given))
    rows = {r.doc_id: r.text for r in pieces.decode(encoded).collect()}
    assert rows == {0: "", 1: "", 2: "é x", 3: "é x", 4: "  two  spaces ", 5: "mark   here"}
    assert pieces.encode(frame([])).collect() == []
    loose = spark.createDataFrame([(1, None), (2, []), (3, library.encode("a b")), (4, None), (5, [0, 1, 2])], "doc_id bigint, ids array<int>")
    assert {r.doc_id: r.text for r in pieces.decode(loose).collect()} == {1: "", 2: "", 3: "a b", 4: "", 5: ""}


def test_unigram_path_is_the_best():
    random.seed(4)
    texts = ["<unk>", *"▁abc", "ab", "bc", "abc", "ca", "▁a", "▁ab", "cab"]
    scores = np.array([0.0, *[round(random.uniform(-9, -1), 3) for _ in texts[1:]]])
    model = pieces.Model("unigram", texts, scores, np.zeros(256, np.int32), {t: i for i, t in enumerate(texts) if i})
    encoder = pieces.Encoder(model)

    def best(text):
        if not text:
            return 0.0
        return max((scores[i] + best(text[len(t) :]) for t, i in model.ids.items() if text.startswith(t)), default=-1e9)

    for _ in range(200):
        text = "".join(random.choices("abc", k=random.randint(1, 9)))
        ids, _ = encoder.encode([text])
        assert "".join(texts[i] for i in ids) == "▁" + text
        assert scores[ids].sum() == pytest.approx(best("▁" + text))


MEASURED = """
import random, resource, sys
sys.path.insert(0, {root!r})
from centavo.llm import pieces
encoder = pieces.Encoder(pieces.Model.load())
decoder = pieces.Decoder(encoder.model)
encoder.encode(["a b c"])
random.seed(1)
def new(size):
    return " ".join("".join(random.choices("abcdefghijklmnop", k=7)) for _ in range(size // 8))
start = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
for size in [2 << 20] * 8:
    ids, bounds = encoder.encode([new(size)])
    decoder.decode(ids, bounds)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - start) >> 10)
"""


def test_memory_over_chunks_of_new_words():
    root = str(Path(__file__).resolve().parents[2])
    done = subprocess.run([sys.executable, "-c", MEASURED.format(root=root)], capture_output=True, text=True, check=True, timeout=600)
    assert int(done.stdout) < 250, done.stdout


def test_texts_in_parts(library, monkeypatch):
    monkeypatch.setattr(pieces, "PART", 7)
    monkeypatch.setattr(pieces, "LEARNED", 100)
    monkeypatch.setattr(pieces, "KEPT_BYTES", 5000)
    texts = odd_texts()[:600] + [" " * 30 + "x  y" * 20]
    encoder = pieces.Encoder(pieces.Model.load())
    decoder = pieces.Decoder(encoder.model)
    ids, bounds = encoder.encode(texts)
    back = decoder.decode(ids, bounds)
    for k, text in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == library.encode(text), text
        assert back[k] == text.replace("▁", " ")


def test_rows_without_text(spark, frame):
    got = pieces.encoded_and_checked(frame([None, "", "a"])).collect()
    assert [(r.doc_id, r.n_tokens, r.round_trip) for r in got] == [(0, 0, True), (1, 0, True), (2, 1, True)]
    assert pieces.encoded_and_checked(frame(["a"]).limit(0)).collect() == []
