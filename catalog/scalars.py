"""Scalar money and date functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from centavo.functions import money, periods


@query(
    "allocate_orders",
    "F-7",
    sql="""WITH o AS (SELECT o_orderkey, CAST(ROUND(o_totalprice * 100) AS BIGINT) AS m, CAST(o_custkey % 7 + 1 AS BIGINT) AS n FROM orders)
SELECT o_orderkey, CAST(i AS INT) AS part_no, m // n + CASE WHEN i < m % n THEN 1 ELSE 0 END AS part_minor FROM (SELECT *, UNNEST(generate_series(0, n - 1)) AS i FROM o) x""",
    views=False,
)
def allocate_orders(b):
    total = money.minor(F.col("o_totalprice").cast("decimal(20,4)"))
    rows = b.table("orders").select("o_orderkey", money.allocate(total, F.col("o_custkey") % 7 + 1).alias("parts"))
    return rows.select("o_orderkey", F.posexplode("parts").alias("part_no", "part_minor"))


@query(
    "money_arithmetic",
    "F-6",
    "F-8",
    "F-9",
    sql="""WITH o AS (SELECT o_orderkey, CAST(ROUND(o_totalprice * 100) AS BIGINT) AS m FROM orders)
SELECT o_orderkey, m AS minor, CAST(ROUND(m * 1.30) AS BIGINT) AS burdened_minor, -m AS negated_minor, CAST(CASE WHEN m < 10000000 THEN -1 WHEN m > 10000000 THEN 1 ELSE 0 END AS INT) AS side,
'$' || printf('%,d', m // 100) || '.' || lpad(CAST(m % 100 AS VARCHAR), 2, '0') AS shown, FLOOR(CAST(m AS DOUBLE) / CAST(300 AS DOUBLE) * CAST(10 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(10 AS DOUBLE) AS tenth FROM o""",
    views=False,
)
def money_arithmetic(b):
    rows = b.table("orders").select("o_orderkey", money.minor(F.col("o_totalprice").cast("decimal(20,4)")).alias("minor"))
    m = F.col("minor")
    return rows.select(
        "o_orderkey",
        "minor",
        money.scale_minor(m, "1.30").alias("burdened_minor"),
        (-m).alias("negated_minor"),
        money.compare(m, F.lit(10_000_000)).alias("side"),
        money.format_usd(m).alias("shown"),
        money.round_half_up(m.cast("double") / F.lit(300.0), 1).alias("tenth"),
    )


@query(
    "parsed_amount_text",
    "F-6",
    "N-4",
    sql="""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN CAST(ROUND(o_totalprice * 100) AS BIGINT) WHEN 4 THEN -CAST(ROUND(o_totalprice * 100) AS BIGINT) WHEN 3 THEN CAST(ROUND(o_totalprice * 100) AS BIGINT) END AS parsed_minor FROM orders""",
    views=False,
)
def parsed_amount_text(b):
    """Plain, exponent, sub-cent, padded and negative texts: only plain decimals are accepted."""
    plain = F.col("o_totalprice").cast("decimal(20,2)").cast("string")
    text = (
        F.when(F.col("o_orderkey") % 5 == 0, plain)
        .when(F.col("o_orderkey") % 5 == 1, F.lit("1e5"))
        .when(F.col("o_orderkey") % 5 == 2, F.concat(plain, F.lit("7")))
        .when(F.col("o_orderkey") % 5 == 3, F.concat(plain, F.lit("00")))
        .otherwise(F.concat(F.lit("-"), plain))
    )
    return b.table("orders").select("o_orderkey", money.parse_minor(text).alias("parsed_minor"))


@query(
    "single_currency_sum",
    "A-28",
    sql="SELECT org_id, CAST(SUM(minor) AS BIGINT) AS total_minor FROM base WHERE statement = 'revenue' GROUP BY 1",
)
def single_currency_sum(b):
    from centavo.operators.predicates import analytical, of_statement

    rows = of_statement(analytical(b.ledger), "revenue").withColumn("currency", F.lit("USD"))
    return rows.groupBy("org_id").agg(money.sum_one_currency(money.minor("amount"), "currency").alias("total_minor"))


@query(
    "fiscal_periods",
    "F-12",
    sql="""SELECT org_id, CAST(year(CAST(issued_on - INTERVAL 6 MONTH AS DATE)) AS INT) AS fiscal_year, CAST(quarter(CAST(issued_on - INTERVAL 6 MONTH AS DATE)) AS INT) AS fiscal_quarter, CAST(SUM(total_minor) AS BIGINT) AS total_minor FROM docs GROUP BY 1, 2, 3""",
)
def fiscal_periods(b):
    day = F.col("issued_on")
    return b.invoices.groupBy(
        "org_id",
        periods.fiscal_year(day, 7).alias("fiscal_year"),
        periods.fiscal_quarter(day, 7).alias("fiscal_quarter"),
    ).agg(F.sum(money.minor("total")).alias("total_minor"))


@query(
    "invoice_json",
    "F-4",
    sql="""SELECT invoice_id, '{"customer":' || customer_id || ',"status":"' || status || '"}' AS document, status AS read_back FROM docs""",
)
def invoice_json(b):
    packed = F.to_json(F.struct(F.col("customer_id").alias("customer"), F.col("status").alias("status")))
    rows = b.invoices.select("invoice_id", packed.alias("document"))
    return rows.withColumn("read_back", F.get_json_object("document", "$.status"))
