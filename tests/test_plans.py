"""Schemas and plan shape."""

import pytest

from catalog.forecast import OPTIONS, inputs
from centavo import schemas
from centavo.operators import breakdowns, metrics
from centavo.plans import forecast as fc
from centavo.plans.dashboard import bundle, dashboard
from centavo.sources.books import AS_OF, Books
from centavo.functions.periods import trailing_months


def shape(schema):
    return [(f.name, f.dataType) for f in schema.fields]


@pytest.fixture(scope="module")
def books(spark, small):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return Books(spark, small)


def test_canonical_schemas(books):
    assert shape(books.ledger.schema) == shape(schemas.LEDGER)
    assert shape(books.invoices.schema) == shape(schemas.INVOICES)
    assert shape(books.customers.schema) == shape(schemas.CUSTOMERS)
    assert shape(metrics.metric_table(books.ledger, trailing_months(AS_OF, 12)).schema) == shape(schemas.METRICS)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rank_is_limited_before_the_shuffle(books):
    text = plan(breakdowns.drill_down(books.ledger))
    assert text.count("WindowGroupLimit") >= 2


def test_no_cross_joins(books):
    for df in (
        fc.forecast_points(inputs(books), OPTIONS),
        metrics.metric_table(books.ledger, trailing_months(AS_OF, 12), None, books.organizations),
        breakdowns.revenue_by_customer(books.ledger, books.customers, trailing_months(AS_OF, 12)),
    ):
        text = plan(df)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_dashboard_has_every_part(books):
    parts = dashboard(books.ledger, books.invoices, books.customers, books.organizations, AS_OF)
    counts = {}
    for r in bundle({k: parts[k] for k in ("cards", "aging", "forecast_points", "forecast_assumptions")}).collect():
        counts.setdefault(r.part, {})[r.org_id] = r.n
    assert set(parts) == {
        "cards", "series", "by_category", "by_customer", "aging", "concentration", "drivers",
        "forecast_points", "forecast_risks", "forecast_assumptions",
    }
    assert set(counts["cards"].values()) == {8} and set(counts["forecast_points"].values()) == {91}


def test_critical_alerts_reach_ranking(spark, small):
    import __spark_entry__ as entry

    critical = entry.queries()["forecast_alerts"](spark, small).where("severity = 'critical'").count()
    assert critical > 0
    assert entry.queries()["alerts_for_week"](spark, small).where("rank = 0").count() == critical
