"""Matching against brute force on small random books, and under heavy skew."""

import datetime as dt
import random
from collections import defaultdict

import pytest

from centavo.operators import matching

D0 = dt.date(2001, 1, 1)
ROWS = "org_id int, source string, row_id string, direction string, amount_minor bigint, day date, descriptor string"


def feed(rng, n):
    return [
        (
            rng.randrange(2),
            rng.choice(["books", "bank", "card"]),
            f"r{i}",
            rng.choice(["inflow", "outflow"]),
            rng.choice([100, 200]),
            D0 + dt.timedelta(days=rng.randrange(60)),
            rng.choice(["SQ *Cafe #1", "cafe", "Shop"]),
        )
        for i in range(n)
    ]


def merchant(text):
    return "shop" if text == "Shop" else "cafe"


def brute(rows, priority, days):
    """Sources by priority, nearest dates first; like rows of a day in the order of their hash and id."""
    import hashlib

    order = lambda r: (hashlib.md5(r[2].encode()).hexdigest()[:2], r[2])
    out = {r[2]: None for r in rows}
    for i, better in enumerate(priority):
        for other in priority[i + 1 :]:
            sides = []
            for source in (better, other):
                lanes = defaultdict(list)
                for r in rows:
                    if r[1] == source and out[r[2]] is None:
                        lanes[r[0], r[3], r[4], merchant(r[6]), r[5]].append(r)
                sides.append(lanes)
            for gap in sorted(range(-days, days + 1), key=lambda k: (abs(k), k < 0)):
                for key in list(sides[0]):
                    there = (*key[:-1], key[-1] + dt.timedelta(days=gap))
                    a, b = sorted(sides[0][key], key=order), sorted(sides[1].get(there, []), key=order)
                    n = min(len(a), len(b))
                    for x, y in zip(a[:n], b[:n], strict=True):
                        out[y[2]] = x[2]
                    sides[0][key] = a[n:]
                    if there in sides[1]:
                        sides[1][there] = b[n:]
    return out


def test_pairs_lie_in_the_window_and_one_missing_row_moves_no_other(spark):
    books = [(1, "books", f"a{i}", "outflow", 100, D0 + dt.timedelta(days=3 * i), "cafe") for i in range(10)]
    bank = [(1, "bank", f"b{i}", "outflow", 100, D0 + dt.timedelta(days=3 * i), "cafe") for i in (5, 9)]

    def mirrors(rows):
        got = matching.cross_source_duplicates(spark.createDataFrame(rows, ROWS), ["books", "bank"]).collect()
        return {r.row_id: r.mirrors_row_id for r in got if r.mirrors_row_id}

    assert mirrors(books + bank) == {"b5": "a5", "b9": "a9"}
    assert mirrors(books[:2] + books[3:] + bank) == {"b5": "a5", "b9": "a9"}


@pytest.mark.parametrize("few", [2000, 5])
def test_duplicates_match_brute_force(spark, few, monkeypatch):
    """Also when most keys have too many rows for one task."""
    monkeypatch.setattr(matching, "FEW_ROWS", few)
    rows = feed(random.Random(1), 300)
    priority = ["books", "bank", "card"]
    df = spark.createDataFrame(rows, ROWS)
    got = matching.cross_source_duplicates(df, priority).collect()
    assert {r.row_id: r.mirrors_row_id for r in got} == brute(rows, priority, 3)
    assert all(r.is_canonical == (r.mirrors_row_id is None) for r in got)


def test_keys_with_few_rows_are_paired_by_runs_across_batches(spark, monkeypatch):
    """Rows are not copied to the shared folder first, and a key may lie in several batches or on one side alone."""
    rng = random.Random(4)
    kinds = "org_id int, name string, account string, day date, row_id string"

    def rows(mark, n):
        return [(rng.choice([None, 1, 2]), rng.choice(["x", "y", None]), rng.choice("ab"), D0 + dt.timedelta(days=rng.randrange(6)), f"{mark}{i}") for i in range(n)]

    only = [(7, "one side", "a", D0, f"o{i}") for i in range(100)]
    copies = [(8, "copies", "a", D0, f"c{i}") for i in range(30)]
    left = spark.createDataFrame([*rows("l", 200), *only, *copies], kinds)
    right = spark.createDataFrame([*rows("r", 150), *((8, "copies", "b", D0 + dt.timedelta(days=2), f"d{i}") for i in range(20))], kinds)

    def pairs(account):
        found = matching.nearest_pairs(left, right, ["org_id", "name"], 2, account)
        return sorted(map(str, found.collect()))

    names, write = [], matching.written
    monkeypatch.setattr(matching, "written", lambda df, name: names.append(name) or write(df, name))
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
        few = [pairs(None), pairs("account")]
        assert names == ["pair-keys"] * 2
        monkeypatch.setattr(matching, "FEW_ROWS", 1)
        assert few == [pairs(None), pairs("account")]
        assert sum("copies" in p for p in few[0]) == sum("copies" in p for p in few[1]) == 20
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


def test_deciding_again_changes_nothing(spark):
    rows = feed(random.Random(3), 200)
    df = spark.createDataFrame(rows, ROWS)
    priority = ["books", "bank"]
    first = matching.cross_source_duplicates(df, priority)
    marked = df.join(first.drop("org_id", "source"), "row_id").repartition(7, "day")
    again = matching.cross_source_duplicates(marked, priority)
    assert first.count() == 200
    assert sorted(map(str, again.collect())) == sorted(map(str, first.collect()))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        above, row = row, [i + 1]
        for j, y in enumerate(b):
            row.append(min(above[j] + (x != y), above[j + 1] + 1, row[j] + 1))
    return row[-1]


def test_similar_keys_against_all_pairs(spark):
    rng = random.Random(8)
    names = ["coffee house", "cofee house", "coffe house", "coffee houses", "toffee house", "aaaaa", "aaaaaa", "abcd", "abce", "xyxyxyxy", "xyxyxy", "ünder", "under"]
    sides = [[(rng.randrange(2), rng.choice([None, "x"]), rng.choice(names), D0 + dt.timedelta(days=rng.randrange(15))) for _ in range(120)] for _ in range(2)]
    left, right = (spark.createDataFrame(rows, "org_id int, kind string, name string, day date") for rows in sides)
    for most in (1, 2):
        got = {(r.org_id, r.kind, r.name, r.day): r.similar for r in matching.similar_keys(left, right, ["org_id", "kind"], "name", 2, most).collect()}
        want = {}
        for o, k, n, d in set(sides[1]):
            near = [
                (edits(m, n), abs((e - d).days), m)
                for p, j, m, e in sides[0]
                if (p, j) == (o, k) and m != n and len(m) >= 5 and len(n) >= 5 and abs((e - d).days) <= 2 and edits(m, n) <= most
            ]
            if near:
                want[o, k, n, d] = min(near)[2]
        assert got == want


def test_a_typo_is_mirrored_and_two_are_not(spark):
    def at(source, key, name, day=0, amount=100):
        return (1, source, key, "outflow", amount, D0 + dt.timedelta(days=day), name)

    rows = [
        at("books", "a1", "Blue Bottle"), at("bank", "b1", "BLUE BOTLE", 1),
        at("books", "a2", "Green Grocer", amount=200), at("bank", "b2", "Gren Grcer", amount=200),
        at("books", "a3", "Old Mill", amount=300), at("bank", "b3", "Old Mil", 5, 300),
        at("books", "a4", "Red Lion", amount=400), at("bank", "b4", "Red Lion", amount=400), at("bank", "b5", "Red Lyon", amount=400),
        at("books", "a6", "Shop", amount=500), at("bank", "b6", "Shap", amount=500),
    ]
    got = {r.row_id: (r.mirrors_row_id, r.dedup_method) for r in matching.cross_source_duplicates(spark.createDataFrame(rows, ROWS), ["books", "bank"]).collect()}
    assert {k: v[0] for k, v in got.items() if v[0]} == {"b1": "a1", "b4": "a4"}
    assert got["b1"][1] == matching.SIMILAR and got["b4"][1] == matching.EXACT


def test_similar_keys_meet_only_in_their_block(spark):
    left = spark.createDataFrame([(i, "coffee house", D0) for i in range(50)], "amount int, name string, day date")
    right = spark.createDataFrame([(i, "cofee house", D0) for i in range(50)], "amount int, name string, day date")
    found = matching.similar_keys(left, right, ["amount"], "name", 3)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    assert found.count() == 50


def test_one_source_never_mirrors_itself(spark):
    rows = [(1, "bank", f"r{i}", "outflow", 500, D0, "cafe") for i in range(20)]
    got = matching.cross_source_duplicates(spark.createDataFrame(rows, ROWS), ["books", "bank"])
    assert got.where("NOT is_canonical").count() == 0


def test_a_heavy_key_is_numbered_in_many_parts(spark):
    n = 20_000
    df = spark.range(n).selectExpr("1 AS org_id", "IF(id % 3 = 0, 500, id) AS amount_minor", "CAST(id AS STRING) AS row_id")
    ranked = matching.numbered(df, ["org_id", "amount_minor"], "row_id")
    heavy = ranked.where("amount_minor = 500")
    count = heavy.count()
    assert heavy.select("nth").distinct().count() == count
    assert heavy.agg({"nth": "max"}).first()[0] == count
    assert ranked.count() == n


MOVES = "org_id int, row_id string, account_id string, direction string, amount_minor bigint, day date"


def test_transfers_pair_once_between_different_accounts(spark):
    def move(key, account, direction, amount, day):
        return (1, key, account, direction, amount, D0 + dt.timedelta(days=day))

    rows = [
        move("o1", "checking", "outflow", 100, 0), move("i1", "savings", "inflow", 100, 1),
        move("o2", "checking", "outflow", 100, 2), move("i2", "savings", "inflow", 100, 2),
        move("o3", "checking", "outflow", 70, 0), move("i3", "checking", "inflow", 70, 1),
        move("o4", "checking", "outflow", 60, 0), move("i4", "savings", "inflow", 60, 9),
        move("o5", "checking", "outflow", 50, 0),
    ]
    got = matching.transfer_pairs(spark.createDataFrame(rows, MOVES)).collect()
    assert sorted((r.outflow_id, r.inflow_id) for r in got) == [("o1", "i1"), ("o2", "i2")]
    alone = [
        move("o1", "checking", "outflow", 100, 0),
        move("o2", "checking", "outflow", 100, 3), move("i2", "savings", "inflow", 100, 3),
        move("o3", "checking", "outflow", 100, 6), move("i3", "savings", "inflow", 100, 6),
    ]
    got = matching.transfer_pairs(spark.createDataFrame(alone, MOVES)).collect()
    assert sorted((r.outflow_id, r.inflow_id) for r in got) == [("o2", "i2"), ("o3", "i3")]


def test_transfers_are_the_same_in_tasks_and_in_jobs(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(1, f"r{i}", rng.choice("abc"), rng.choice(["outflow", "inflow"]), rng.choice([1, 2]), D0 + dt.timedelta(days=rng.randrange(9))) for i in range(50)]
    frame = spark.createDataFrame([*rows, (1, "n1", "a", "outflow", 1, None), (1, "n2", None, "inflow", 1, D0)], MOVES)
    in_tasks = sorted(map(tuple, matching.transfer_pairs(frame).collect()))
    monkeypatch.setattr(matching, "FEW_ROWS", 1)
    assert sorted(map(tuple, matching.transfer_pairs(frame).collect())) == in_tasks != []


def test_transfers_leave_nothing_that_could_still_pair(spark):
    rng = random.Random(4)
    rows = [(1, f"r{i}", rng.choice("abc"), rng.choice(["outflow", "inflow"]), 100, D0 + dt.timedelta(days=rng.randrange(12))) for i in range(60)]
    pairs = matching.transfer_pairs(spark.createDataFrame(rows, MOVES)).collect()
    by_id = {r[1]: r for r in rows}
    used = [x for p in pairs for x in (p.outflow_id, p.inflow_id)]
    assert len(used) == len(set(used))

    def could(o, i):
        return o[3] == "outflow" and i[3] == "inflow" and o[2] != i[2] and abs((i[5] - o[5]).days) <= 3

    assert all(could(by_id[p.outflow_id], by_id[p.inflow_id]) for p in pairs)
    left = [r for r in rows if r[1] not in used]
    assert not any(could(o, i) for o in left for i in left)


def test_entity_links(spark):
    rows = [
        (1, "a", "1", "ACME Corp"), (1, "b", "2", "Acme Corporation"), (1, "c", "3", "acme corp llc"),
        (1, "a", "4", "Globex Partners"), (1, "b", "5", "Globex Partnrs Inc"), (1, "b", "6", "Initech"),
        (2, "a", "7", "Acme"),
    ]
    got = {r.source_entity_id: r for r in matching.entity_links(
        spark.createDataFrame(rows, "org_id int, source string, source_entity_id string, name string")).collect()}
    assert len({got[k].canonical_key for k in "123"}) == 1
    assert got["4"].canonical_key == got["5"].canonical_key
    assert [got[k].needs_review for k in "123"] == [False] * 3
    assert {got["4"].method, got["5"].method} == {"deterministic", "fuzzy"}
    assert got["6"].method == "deterministic"
    assert got["7"].org_id == 2
    assert got["7"].compared is False and got["4"].compared is True
    chain = [(1, "a", str(i), name) for i, name in enumerate(["abcdefgh", "abcdefghi", "abcdefghij", "abcdefghijk"])]
    got = matching.entity_links(spark.createDataFrame(chain, "org_id int, source string, source_entity_id string, name string"))
    assert {r.canonical_key for r in got.collect()} == {"abcdefgh"}


def test_layered_categories(spark):
    rows = spark.createDataFrame(
        [(1, "SQ *Cafe #1", "opex.travel", False), (1, "Cafe", "opex.rent", True), (1, "Shop", None, False), (2, "Cafe", "opex.other", False)],
        "org_id int, merchant_name string, category string, category_locked boolean",
    )
    rules = spark.createDataFrame(
        [(1, "cafe", "meals", 2), (1, "cafe", "team", 1)], "org_id int, merchant_key string, category string, priority int"
    )
    got = sorted((r.org_id, r.merchant_name, r.category, r.category_source) for r in matching.categorise(rows, rules).collect())
    assert got == [
        (1, "Cafe", "opex.rent", "user"),
        (1, "SQ *Cafe #1", "team", "rule"),
        (1, "Shop", "uncategorized", "default"),
        (2, "Cafe", "opex.other", "source_system"),
    ]
