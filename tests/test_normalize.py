"""Provider records, case by case."""

import datetime as dt
import json
from decimal import Decimal

from pyspark.sql import functions as F

from centavo.operators import accounts as acc
from centavo.operators import normalize as nz
from centavo.operators import versions
from centavo.sources import landing

PAGE = "org_id int, connection_id string, record_type string, page_index int, fetched_at timestamp, payload string"
T0 = dt.datetime(2001, 7, 1)


def page(record_type, rows, index=0, fetched=T0, time="a", org=1):
    body = {"startPosition": 1, "maxResults": len(rows)}
    if rows:
        body[record_type] = rows
    return (org, "c", record_type, index, fetched, json.dumps({"QueryResponse": body, "time": time}))


def records(spark, record_type, rows):
    return landing.records(spark.createDataFrame([page(record_type, rows)], PAGE))


CHART = [
    # type, subtype, name, class, category, confidence
    ("Expense", "PayrollTaxExpense", "Taxes", "payroll", "payroll.taxes", "0.980"),
    ("Expense", "PayrollExpenses", "Health plan", "payroll", "payroll.benefits", "0.950"),
    ("Expense", "SuppliesMaterialsCOGS", "Supplies", "cogs", "cogs.materials", "0.950"),
    ("Cost of Goods Sold", "CostOfServiceCos", "AWS", "cogs", "cogs.hosting", "0.950"),
    ("Income", "", "Retainers", "revenue", "revenue.services", "0.950"),
    ("Other Income", "", "Interest earned", "other_income", "uncategorized", "0.900"),
    ("Cost of Goods Sold", "", "Labor", "cogs", "cogs.subcontractors", "0.920"),
    ("Bank", "", "Checking", "asset", "uncategorized", "0.980"),
    ("Credit Card", "", "Visa", "liability", "uncategorized", "0.980"),
    ("Equity", "", "Owner", "equity", "uncategorized", "0.950"),
    ("Long Term Liability", "", "Loan", "liability", "uncategorized", "0.900"),
    ("Accounts Payable", "", "AP", "liability", "uncategorized", "0.900"),
    ("Fixed Asset", "", "Laptops", "asset", "uncategorized", "0.900"),
    ("Accounts Receivable", "", "AR", "asset", "uncategorized", "0.900"),
    ("Expense", "", "Salaries", "payroll", "payroll.wages", "0.850"),
    ("Expense", "", "Freelancers", "cogs", "cogs.subcontractors", "0.550"),
    ("Expense", "", "Income tax", "other_expense", "other.taxes", "0.750"),
    ("Other Expense", "", "Interest", "other_expense", "other.interest", "0.800"),
    ("Expense", "", "Office lease", "opex", "opex.rent", "0.880"),
    ("Expense", "", "Current office", "opex", "opex.rent", "0.880"),
    ("Expense", "", "Telephone", "opex", "opex.utilities", "0.880"),
    ("Expense", "", "Misc", "opex", "opex.other", "0.880"),
    ("Memo", "", "Notes", None, "uncategorized", "0.000"),
]


def test_chart_of_accounts(spark):
    rows = [
        {"Id": str(i), "Name": n, "AccountType": t, "AccountSubType": s} for i, (t, s, n, *_) in enumerate(CHART)
    ]
    got = {int(r.source_account_id): r for r in acc.normalize_accounts(records(spark, "Account", rows)).collect()}
    for i, (_, _, name, statement, category, confidence) in enumerate(CHART):
        r = got[i]
        assert (r.statement, r.category_key, r.mapping_confidence) == (statement, category, Decimal(confidence)), name
        assert r.needs_review == (statement is None or Decimal(confidence) < Decimal("0.7"))


def test_account_defaults_and_warnings(spark):
    rows = records(spark, "Account", [{"Name": "no id"}, {"Id": "9"}, {"Id": "8", "Name": "Freelance", "AccountType": "Expense"}])
    (only, _) = sorted(acc.normalize_accounts(rows).collect(), key=lambda r: r.source_account_id, reverse=True)
    assert (only.source_account_id, only.name, only.account_type) == ("9", "Account 9", "")
    kinds = sorted(r.kind for r in acc.account_warnings(rows).collect())
    assert kinds == ["ambiguous_account", "missing_field", "unmapped_account"]


PURCHASES = [
    {"Id": "1", "TxnDate": "2001-07-01", "EntityRef": {"name": "Acme"}, "Line": [
        {"Amount": 10.5, "Description": "d", "AccountBasedExpenseLineDetail": {"AccountRef": {"value": "A"}}},
        {"Amount": 2, "AccountBasedExpenseLineDetail": {"AccountRef": {"value": "B"}}},
        {"Amount": "7"},
        {"Amount": 3},
    ]},
    {"Id": "2", "TxnDate": "2001-07-02", "TotalAmt": 8.005},
    {"Id": "3", "TxnDate": "2001-07-02", "TotalAmt": None},
    {"TxnDate": "2001-07-02", "TotalAmt": 1},
    {"Id": "4", "TotalAmt": 1},
    {"Id": "5", "TxnDate": "2001-07-03", "Line": [
        {"Amount": 1, "AccountBasedExpenseLineDetail": {"AccountRef": {"value": "A"}}}]},
]


def test_expense_lines(spark):
    lookup = spark.createDataFrame(
        [(1, "A", "opex", "Rent", "opex.rent"), (2, "B", "opex", "Other tenant", "opex.other")],
        "org_id int, source_account_id string, statement string, name string, category_key string",
    )
    rows = records(spark, "Purchase", PURCHASES)
    got = {r.source_txn_id: r for r in nz.normalize_expenses(rows, "Purchase", lookup).collect()}
    assert set(got) == {"1:0", "1:1", "1:3", "2", "5:0"}
    assert got["1:0"].amount == Decimal("10.5000") and got["1:0"].statement == "opex"
    assert got["1:0"].merchant_name == "Acme" and got["5:0"].merchant_name == "Rent"
    assert got["1:1"].statement is None and got["1:1"].category_key == "uncategorized"
    assert got["1:3"].category_source == "default"
    header = got["2"]
    assert (header.amount, header.category_key, header.category_confidence) == (Decimal("8.0100"), "opex.other", 0)
    assert got["5:0"].posted_at == dt.date(2001, 7, 3)
    bills = nz.normalize_expenses(rows, "Bill", lookup).collect()
    assert all(r.posted_at is None for r in bills)
    warnings = sorted((r.kind, r.source_id or "") for r in nz.document_warnings(rows, "Purchase").collect())
    assert warnings == [
        ("missing_field", ""),
        ("missing_field", ""),
        ("unparseable_amount", "1"),
        ("unparseable_amount", "3"),
    ]


def test_invoice_states_and_accrual(spark):
    def doc(key, balance, due="2001-07-01", **more):
        return {"Id": key, "TxnDate": "2001-06-01", "DueDate": due, "TotalAmt": 100, "Balance": balance,
                "CustomerRef": {"value": "7", "name": "N"}, "MetaData": {"LastUpdatedTime": "2001-07-05T23:00:00-07:00"}, **more}

    rows = records(spark, "Invoice", [
        doc("paid", 0), doc("late", 40), doc("part", 40, "2001-09-01"), doc("open", 100, "2001-09-01"),
        doc("nodue", 100, None), {**doc("nobal", 0), "Balance": None},
    ])
    got = {r.source_invoice_id: r for r in nz.normalize_invoices(rows, dt.date(2001, 8, 1)).collect()}
    assert {k: r.status for k, r in got.items()} == {
        "paid": "paid", "late": "overdue", "part": "partial", "open": "open", "nodue": "open", "nobal": "paid"}
    assert got["paid"].paid_on == dt.date(2001, 7, 5) and got["late"].paid_on is None
    revenue = nz.invoice_revenue(rows).collect()
    assert {r.statement for r in revenue} == {"revenue"} and all(r.posted_at is None for r in revenue)
    paid = nz.normalize_payments(rows).collect()
    assert {r.statement for r in paid} == {"asset"} and all(r.posted_at == r.occurred_at for r in paid)


def test_page_hash_ignores_envelope_and_key_order(spark):
    a = {"Id": "1", "z": {"b": 1, "a": [2, 3]}}
    b = {"z": {"a": [2, 3], "b": 1}, "Id": "1"}
    pages = spark.createDataFrame(
        [
            page("Item", [a], 0, T0, "first"),
            page("Item", [b], 0, dt.datetime(2001, 7, 2), "second"),
            page("Item", [{**a, "z": 0}], 1),
            page("Bill", [a], 0, T0, "decoy"),
            page("Vendor", [], 0),
        ],
        PAGE,
    )
    unique = landing.unique_pages(pages).collect()
    assert sorted((r.record_type, r.record_count) for r in unique) == [("Bill", 1), ("Item", 1), ("Item", 1), ("Vendor", 0)]
    assert {r.fetched_at for r in unique} == {T0}
    assert landing.records(pages.where("record_type = 'Vendor'")).count() == 0


def test_latest_record_wins_and_unnamed_records_stay(spark):
    def v(updated, n):
        return {"Id": "1", "MetaData": {"LastUpdatedTime": updated}, "n": n}

    rows = records(spark, "Invoice", [v("2001-07-01T00:00:00Z", 1), v("2001-07-03T00:00:00Z", 3), v("2001-07-02T00:00:00Z", 2), {"n": 4}, {"n": 5}])
    got = nz.latest_records(rows).select(F.try_variant_get("record", "$.n", "int").alias("n")).collect()
    assert sorted(r.n for r in got) == [3, 4, 5]


def test_merge_updates_only_named_columns(spark):
    old = spark.createDataFrame([(1, "a", "x", 10), (1, "b", "y", 20)], "org_id int, id string, name string, total int")
    new = spark.createDataFrame([(1, "a", "x2", 99, 1), (1, "a", "x3", 98, 2), (2, "a", "z", 30, 1)], "org_id int, id string, name string, total int, v int")
    got = versions.merge_update(old, new, ["org_id", "id"], ["name"], [F.col("v").desc()])
    assert sorted(map(tuple, got.collect())) == [(1, "a", "x3", 10), (1, "b", "y", 20), (2, "a", "z", 30)]
    again = versions.merge_update(got, new, ["org_id", "id"], ["name"], [F.col("v").desc()])
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.collect()))


def test_insert_absent_ignores_voided_rows(spark):
    old = spark.createDataFrame([("a", False), ("b", True)], "id string, is_voided boolean")
    new = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("c", 2)], "id string, n int")
    got = versions.insert_absent(old, new, ["id"], [F.col("n")]).collect()
    assert sorted((r.id, r.n) for r in got) == [("b", 1), ("c", 1)]


def test_category_of_the_tenant_wins_over_the_system_row(spark):
    cats = spark.createDataFrame(
        [(None, "opex.rent", "S"), (1, "opex.rent", "T")], "org_id int, key string, category_id string"
    )
    rows = spark.createDataFrame(
        [(1, "opex.rent", "x", "y", "1"), (2, "opex.rent", None, "y", "2"), (2, "nothing", "x", None, "3")],
        "org_id int, category_key string, source_account_id string, source_customer_id string, source_txn_id string",
    )
    none_a = spark.createDataFrame([], "org_id int, source_account_id string")
    none_c = spark.createDataFrame([], "org_id int, source_customer_id string")
    got = {(r.org_id, r.category_key): r.category_id for r in nz.resolve_keys(rows, none_a, none_c, cats).collect()}
    assert got == {(1, "opex.rent"): "T", (2, "opex.rent"): "S", (2, "nothing"): None}
