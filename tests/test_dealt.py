"""Rows are sorted once on the way to their rank, slim until they are written, and pages are parsed once."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from catalog import raw_books
from centavo.operators import normalize as nz
from centavo.sources import landing
from centavo.sources.books import Books
from tests.test_normalize import PAGE


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("lines"))
    lines = [(1, 1, 7, 3), (1, 1, 7, 2), (1, None, 7, 5), (1, None, 7, 4), (None, 2, 7, 1), (None, 2, 7, 1), (2, 65, 7, 1), (2, 1, 7, 1)]
    rows = [(o, n, p, 1, float(q), 10.0, 0.0, 0.0, "N", "F", dt.datetime(2001, 1, q)) for o, n, p, q in lines]
    names = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    tables = {
        "lineitem": spark.createDataFrame(rows, names),
        "part": spark.createDataFrame([(7, "LARGE", "Brand#2")], "p_partkey long, p_type string, p_brand string"),
        "supplier": spark.createDataFrame([(1, 4, "S")], "s_suppkey long, s_nationkey int, s_name string"),
        "customer": spark.createDataFrame([(9, 4, "C")], "c_custkey long, c_nationkey int, c_name string"),
        "orders": spark.createDataFrame([(1, 9, "F", dt.datetime(2001, 1, 1), 5.0)], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp, o_totalprice double"),
    }
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{at}/{name}.parquet")
    return at


def test_lines_are_sorted_once_and_the_first_of_a_key_is_kept(spark, path):
    lines = Books(spark, path).line_items
    assert plan(lines).count("Sort [") == 1
    got = sorted(str((r.l_orderkey, r.l_linenumber, r.l_shipdate.day)) for r in lines.collect())
    assert got == sorted(map(str, [(1, 1, 2), (1, None, 4), (None, 2, 1), (2, 1, 1), (2, 65, 1)]))


def test_ledger_is_shuffled_without_what_follows_from_a_kind(spark, path):
    books = Books(spark, path, stored=True)
    assert "source_record_type" not in books._slim_ledger.columns
    columns = sorted(books.computed_ledger.columns)
    stored, computed = ([tuple(r) for r in df.select(columns).collect()] for df in (books.ledger, books.computed_ledger))
    assert sorted(map(str, stored)) == sorted(map(str, computed)) and len(stored) == 7
    ids = {(r.source_record_type, r.source_txn_id, r.direction, r.posted_at is None) for r in books.ledger.collect()}
    assert ("Purchase", "1", "outflow", False) in ids and ("Invoice", "1", "inflow", True) in ids and ("Payment", "1", "inflow", False) in ids


def test_records_are_sorted_once_and_pages_parsed_once(spark):
    def page(at, index, rows, time):
        return (1, "c", "Vendor", index, dt.datetime(2001, 1, at), json.dumps({"QueryResponse": {"Vendor": rows}, "time": time}))

    first = [{"Id": "1", "n": 1}, {"Id": "1", "n": 2}, {"n": 3}]
    pages = spark.createDataFrame([page(1, 0, first, "a"), page(2, 0, first, "b"), page(3, 1, [{"Id": "1", "n": 4}], "c")], PAGE)
    rows = landing.unique_records(pages)
    assert plan(rows).count("from_json") + plan(rows).count("jsontostructs") == 1
    kept = nz.latest_records(rows)
    assert plan(kept).count("Sort [") == 2  # pages, records
    assert sorted(r.n for r in kept.select(F.try_variant_get("record", "$.n", "int").alias("n")).collect()) == [3, 4]
    whole = landing.records(landing.unique_pages(pages))
    assert sorted(map(str, rows.select(F.to_json("record"), "position", "page_index").collect())) == sorted(map(str, whole.select(F.to_json("record"), "position", "page_index").collect()))


def test_pages_are_made_once_from_rows_dealt_before_their_text(spark, tmp_path):
    orders = [(k, k % 7, "FOP"[k % 3], dt.datetime(2001, 1, 1 + k % 28), 10.5 * k) for k in range(0, 4000, 3)]
    odd = [(1, 1, "F", dt.datetime(2001, 1, 1), 3.0), (1, 1, "F", dt.datetime(2001, 1, 1), 2.0), (None, 1, "F", None, None), (5, None, None, None, 1.0), (1700, 1, "F", None, None)]
    names = "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp, o_totalprice double"
    spark.createDataFrame(orders + odd, names).write.parquet(f"{tmp_path}/orders.parquet")
    books = Books(spark, str(tmp_path))
    made = raw_books._pages(books, "Invoice")
    assert plan(made).count("Exchange hashpartitioning") == 1 and plan(made).count("FileScan") == 1
    assert "structstojson" not in plan(made).split("Exchange hashpartitioning")[1].lower() and "to_json" not in plan(made).split("Exchange hashpartitioning")[1]
    first = raw_books.to_pages(raw_books.invoice_records(books), raw_books.FIRST_FETCH)
    again = raw_books.refetched(first, raw_books.SECOND_FETCH)
    edits = raw_books.to_pages(raw_books.invoice_edits(books), raw_books.SECOND_FETCH, first_page=raw_books.EDITED_PAGES)
    assert again.count() > 0 and sorted(map(str, made.collect())) == sorted(map(str, first.unionByName(again).unionByName(edits).collect()))
    body = {r.page_index: json.loads(r.payload)["QueryResponse"]["Invoice"] for r in made.where("org_id = 1 AND fetched_at < '2001-07-30'").collect()}
    assert [(r["Id"], r["TotalAmt"], r["Balance"]) for r in body[0][:2]] == [("1", 2.0, 2.0), ("1", 3.0, 3.0)] and body[None][0]["CustomerRef"]["value"] == "1"
