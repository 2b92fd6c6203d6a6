import re

import sentencepiece

import corpus_pipeline
from centavo.llm import pieces, toxicity
from tests.llm import test_decontaminate, test_jaccard, test_secrets


def test_run_equals_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{small}/labels.parquet"))
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = [(i, t) for i, t in rows if scores[i] < 0.5]
    assert 0 < len(kept) < len(rows)
    kept = [(i, t) for (i, t), (_, _, least) in zip(kept, test_jaccard.brute(kept), strict=True) if i == least]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    flags = test_decontaminate.brute([t for _, t in kept], items)
    kept = [row for row, flag in zip(kept, flags, strict=True) if not flag[-1]]
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    want = {}
    for i, text in kept:
        spans = [tuple(map(int, s.split(":")[1:])) for s in test_secrets.brute(text)]
        for b, e in sorted(spans, reverse=True):
            if not any(x <= b and e <= y and (x, y) != (b, e) for x, y in spans):
                text = text[:b] + "[SECRET]" + text[e:]
        want[i] = library.encode(text)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, small).collect()}
    assert {i: r.ids for i, r in got.items()} == want
    assert all(r.round_trip for r in got.values())


def test_stages_keep_the_columns_and_stand_odd_rows(spark, small, frame):
    given = [None, "", "a clean text", "a clean text", "token = abcdefgh12", "you stupid idiot moron loser", "x " * 40_000]
    docs = frame(given)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for rows in (docs, docs.limit(0)):
            out = stage(spark, rows, small)
            assert out.columns == docs.columns, name
            out.collect()
    assert re.search("SECRET", corpus_pipeline.hide_secrets(spark, docs, small).where("doc_id = 4").first().text)
    assert corpus_pipeline.keep_one_of_each(spark, docs, small).where("doc_id = 3").count() == 0


def test_first_stage_against_the_labels(spark):
    """By the labels of rows that the model is not fitted on, not by its own scores."""
    path = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    name, stage = corpus_pipeline.STAGES[0]
    kept = {r.doc_id for r in stage(spark, docs, path).select("doc_id").collect()}
    told = docs.join(labels.where("toxic IS NOT NULL"), "doc_id").where(toxicity.held_out(docs.doc_id)).select("doc_id", "lang", "toxic").collect()
    for lang in ("en", "de", "fr", "es"):
        toxic = [r.doc_id not in kept for r in told if r.lang == lang and r.toxic]
        clean = [r.doc_id in kept for r in told if r.lang == lang and not r.toxic]
        assert sum(toxic) / len(toxic) > 0.8, (name, lang, sum(toxic), len(toxic))
        assert sum(clean) / len(clean) > 0.95, (name, lang, sum(clean), len(clean))
