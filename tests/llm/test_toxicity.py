import random
import zlib

import pytest

from centavo.llm import toxicity
from centavo.llm.queries import QUERIES


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_finds_equal_edit_distance(frame):
    random.seed(2)
    words = []
    for _ in range(1500):
        w = list(random.choice(toxicity.LEXICON))
        for _ in range(random.randint(0, 3)):
            i, c = random.randrange(len(w) + 1), random.choice("abcdeflost0135é")
            match random.randrange(3):
                case 0:
                    w.insert(i, c)
                case 1:
                    w[i : i + 1] = [c]
                case _:
                    del w[i : i + 1]
        words.append("".join(w))
    rows = {r.doc_id: r.finds for r in toxicity.find_terms(frame(words)).collect()}
    for i, word in enumerate(words):
        plain = "".join(toxicity.LOOKS_LIKE.get(c, c) for c in word)
        near = [(distance(plain, t), t) for t in toxicity.LEXICON]
        want = [(min(x)[1], min(x)[0]) for x in [[p for p in near if p[0] <= toxicity.allowed_errors(p[1])]] if x]
        assert [(f.term, f.distance) for f in rows[i]] == want, word


def test_edges(frame):
    given = [None, "", "idiot idiot", "idiot idiot", "x" * 200_000 + " moron$$$", "stupid" * 3, "ID10T"]
    rows = {r.doc_id: [f.form for f in r.finds] for r in toxicity.find_terms(frame(given)).collect()}
    assert rows == {0: [], 1: [], 2: ["idiot"] * 2, 3: ["idiot"] * 2, 4: ["moron"], 5: [], 6: ["id10t"]}
    assert toxicity.find_terms(frame([])).collect() == []


def test_quotation_scores_lower():
    plain = toxicity.context_score("this is a ", " plan")
    assert toxicity.context_score('he said the word "', '" once') < plain < toxicity.context_score("you are a ", " and")


@pytest.fixture(scope="module")
def model(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.fit(docs, labels)


def test_fit_without_labels(spark, frame):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    bare = toxicity.fit(frame(["a text"]), none)
    assert bare.score([]) < 0.5 < bare.score([("moron", "moron", 0, 1.0)])


def test_toxic_go_and_clean_stay(frame, model):
    given = frame(["all quiet here", None, "", "you are a stupid moron and an idiot", "such a stupidd morron"])
    assert sorted(r.doc_id for r in toxicity.drop_toxic(given, model).collect()) == [0, 1, 2]
    assert toxicity.drop_toxic(given, model).columns == given.columns


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    rows = QUERIES["op10_toxicity"](spark, path).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    told = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.toxic for r in told) / len(told) > 0.85
    caught = [r for r in told if r.predicted]
    assert caught and sum(r.toxic for r in caught) / len(caught) > 0.95


def test_letters_of_other_languages(frame):
    exact = ("réeuxou", "ßchön", "дурак", "naïf", "né")
    given = ["RÉEUXOU réeuxo réeuxou.", "ßchön schön", "Дурак, дурака", "n4ïf naîf", "né nè idïot idiot"]
    rows = {r.doc_id: [f.form for f in r.finds] for r in toxicity.find_terms(frame(given), toxicity.LEXICON, exact).collect()}
    assert rows == {0: ["réeuxou", "réeuxou"], 1: ["ßchön"], 2: ["дурак"], 3: ["n4ïf"], 4: ["né", "idïot", "idiot"]}


def told_by_language(spark, path):
    """(lang, toxic, predicted) of the rows that no label is learned from."""
    read = lambda t: spark.read.parquet(f"{path}/{t}.parquet")
    rows = QUERIES["op10_toxicity"](spark, path).where("held_out").join(read("labels"), "doc_id").join(read("documents"), "doc_id")
    return [(r.lang, r.toxic, r.predicted) for r in rows.where("toxic IS NOT NULL").select("lang", "toxic", "predicted").collect()]


def test_held_out_recall_of_each_language(spark):
    told = told_by_language(spark, "/root/testdata/sf0.1")
    for lang in ("en", "de", "fr", "es"):
        toxic = [p for l, y, p in told if l == lang and y]
        clean = [p for l, y, p in told if l == lang and not y]
        assert sum(toxic) / len(toxic) > 0.8, (lang, sum(toxic), len(toxic))
        assert sum(clean) / len(clean) < 0.1, (lang, sum(clean), len(clean))
