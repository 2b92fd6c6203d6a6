import os
import random

import pytest
import sentencepiece

from centavo.llm import token_counts


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=token_counts.MODEL)


def odd_texts():
    random.seed(2)
    v = ["a", "b", " ", "  ", "the", "é", "\n", "\n\n", "你", "😀", "1", "of", " x", "\t", "\r", "ing", "▁", "==", "----", "\x00", "\xa0", "</s>", "<0x0A>", " "]
    made = ["".join(random.choices(v, k=random.randint(0, 40))) for _ in range(2000)]
    return [None, "", *made, *(" " * k for k in range(40)), "\n" * 50, "a" * 3000, "x \n" * 2000, "same", "same"]


def check(library, docs, rows):
    got = sorted((tuple(r) for r in token_counts.count_tokens(docs).collect()), key=str)
    want = []
    for i, text in rows:
        n = len(library.encode(text or ""))
        want.append((i, len((text or "").encode()), n, n > 4096))
    assert got == sorted(want, key=str)


@pytest.fixture(scope="module")
def parting():
    return token_counts.Pieces().parting()


def test_pre_tokens_are_the_text(parting, library):
    ahead = len(library.encode("\n"))
    for text in odd_texts():
        parts = [p for part in parting.pre_tokens(text or "") for p in part]
        assert "".join(parts) == (" " + text.replace("▁", " ") if text else "")
        assert sum(len(library.encode("\n" + p)) - ahead for p in parts) == len(library.encode(text or "")), text


def test_slices_end_between_pre_tokens(parting, monkeypatch):
    for text in odd_texts()[1:]:
        whole = [p for part in parting.pre_tokens(text) for p in part]
        with monkeypatch.context() as m:
            m.setattr(token_counts, "SLICE", 5)
            assert [p for part in parting.pre_tokens(text) for p in part] == whole


def test_odd_rows(spark, frame, library, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK_BYTES", 10_000)  # many blocks
    rows = [*enumerate(odd_texts()), (None, "no id"), (None, "no id"), (3, "a repeated id"), (9_999, "word " * 200_000)]
    check(library, frame(rows), rows)


def test_nothing_but_empty_texts(spark, frame):
    assert token_counts.count_tokens(frame([None, ""])).select("n_tokens").collect() == [(0,), (0,)]
    assert token_counts.count_tokens(frame(["a"]).limit(0)).count() == 0


def test_documents(spark, small, library):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    check(library, docs, [(r.doc_id, r.text) for r in docs.collect()])


def test_each_pre_token_is_encoded_once(spark, frame, monkeypatch, tmp_path):
    class Noted(token_counts.Pieces):
        def count(self, pre_tokens):
            with open(f"{tmp_path}/{os.getpid()}-{id(pre_tokens)}-{len(os.listdir(tmp_path))}", "w") as f:
                f.write("\n".join(pre_tokens))
            return super().count(pre_tokens)

    monkeypatch.setattr(token_counts, "Pieces", Noted)
    monkeypatch.setattr(token_counts, "ENCODED_BYTES", 8)
    docs = frame(["the cat the cat", "the dog", "the dog", "a the cat"] * 5).repartition(3)
    assert token_counts.count_tokens(docs).count() == 20
    encoded = [w for f in tmp_path.iterdir() for w in f.read_text().split("\n") if w]
    assert sorted(encoded) == [" a", " cat", " dog", " the"]
