"""Duplicates, transfers, entity links, merchant names, layered categories, currency."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from catalog.registry import query
from centavo.functions.money import minor, signed
from centavo.functions.text import merchant_key
from centavo.operators import matching
from centavo.operators.predicates import analytical, settled
from centavo.operators.rates import to_base
from centavo.sources.books import AS_OF


def two_sources(b):
    """The settled ledger as the accounting system has it, and as the bank shows it up to two days later.

    The bank writes names its own way and now and then loses a letter of them, or two.
    """
    rows = analytical(b.ledger).where(settled(AS_OF)).select(
        "org_id",
        F.concat_ws(":", "source_record_type", "source_txn_id").alias("row_id"),
        "direction",
        minor("amount").alias("amount_minor"),
        F.col("posted_at").alias("day"),
        F.coalesce("merchant_name", F.lit("Deposit")).alias("descriptor"),
        "amount",
    )
    books = rows.withColumn("source", F.lit("accounting"))
    shift = (F.col("amount_minor") % 3).cast("int")
    name = F.col("descriptor")
    misspelt = (
        F.when(F.col("amount_minor") % 35 == 0, F.concat(F.substring(name, 1, 2), F.substring(name, 5, 100)))
        .when(F.col("amount_minor") % 7 == 0, F.concat(F.substring(name, 1, 2), F.substring(name, 4, 100)))
        .otherwise(name)
    )
    bank = rows.select(
        "org_id",
        F.concat(F.lit("bank:"), F.col("row_id")).alias("row_id"),
        "direction",
        "amount_minor",
        F.date_add("day", shift).alias("day"),
        F.concat(F.lit("SQ *"), F.upper(misspelt), F.lit(" #42")).alias("descriptor"),
        "amount",
        F.lit("bank").alias("source"),
    )
    return books.unionByName(bank).drop("amount")


SOURCES = """, books AS (SELECT org_id, source_record_type || ':' || source_txn_id AS row_id, direction, minor AS amount_minor, posted_at AS day, lower(COALESCE(merchant_name, 'Deposit')) AS merchant, 'accounting' AS source FROM base WHERE posted_at <= DATE '2001-08-01'),
feed AS MATERIALIZED (SELECT * REPLACE (split_part(merchant, '#', 1) AS merchant) FROM books UNION ALL SELECT org_id, 'bank:' || row_id, direction, amount_minor, CAST(day + CAST(amount_minor % 3 AS INT) AS DATE),
split_part(CASE WHEN amount_minor % 35 = 0 THEN substr(merchant, 1, 2) || substr(merchant, 5) WHEN amount_minor % 7 = 0 THEN substr(merchant, 1, 2) || substr(merchant, 4) ELSE merchant END, '#', 1), 'bank' FROM books),
left0 AS MATERIALIZED (SELECT org_id, direction, amount_minor, merchant, day, row_id FROM feed WHERE source = 'accounting'),
right0 AS MATERIALIZED (SELECT org_id, direction, amount_minor, merchant, day, row_id FROM feed WHERE source = 'bank'),
"""


def rounds(keys: str, days: int, mark: str = "") -> str:
    """Subqueries that pair left0 and right0 by the definition: nearest dates first, like rows in order; ends in `met`.

    `mark` begins the names of all of them.
    """
    out, gaps = [], sorted(range(-days, days + 1), key=lambda k: (abs(k), k < 0))
    for i, gap in enumerate(gaps):
        nth = f"ROW_NUMBER() OVER (PARTITION BY {keys}, day ORDER BY substr(md5(row_id), 1, 2), row_id) AS nth"
        out += [
            f"{mark}pair{i} AS MATERIALIZED (SELECT l.row_id AS l, r.row_id AS r, {gap} AS gap FROM (SELECT *, {nth} FROM {mark}left{i}) l "
            f"JOIN (SELECT * REPLACE (CAST(day - {gap} AS DATE) AS day), {nth} FROM {mark}right{i}) r USING ({keys}, day, nth))",
            f"{mark}left{i + 1} AS MATERIALIZED (SELECT * FROM {mark}left{i} ANTI JOIN (SELECT l AS row_id FROM {mark}pair{i}) USING (row_id))",
            f"{mark}right{i + 1} AS MATERIALIZED (SELECT * FROM {mark}right{i} ANTI JOIN (SELECT r AS row_id FROM {mark}pair{i}) USING (row_id))",
        ]
    return ",\n".join([*out, f"{mark}met AS (" + " UNION ALL ".join(f"SELECT * FROM {mark}pair{i}" for i in range(len(gaps))) + ")"]) + "\n"


DUPLICATE_KEYS = "org_id, direction, amount_minor, merchant"


@query(
    "cross_source_duplicates",
    "A-30",
    "J-14",
    sql=SOURCES
    + rounds(DUPLICATE_KEYS, 3)
    + """, named AS (SELECT r.org_id, r.direction, r.amount_minor, r.merchant, r.day, arg_min(l.merchant, {'e': levenshtein(l.merchant, r.merchant), 'd': abs(l.day - r.day), 'm': l.merchant}) AS near
FROM (SELECT DISTINCT org_id, direction, amount_minor, merchant, day FROM left7) l JOIN (SELECT DISTINCT org_id, direction, amount_minor, merchant, day FROM right7) r
ON l.org_id = r.org_id AND l.direction = r.direction AND l.amount_minor = r.amount_minor AND abs(l.day - r.day) <= 3 AND l.merchant <> r.merchant
WHERE length(l.merchant) >= 5 AND length(r.merchant) >= 5 AND levenshtein(l.merchant, r.merchant) <= 1 GROUP BY ALL),
near_left0 AS (SELECT * FROM left7), near_right0 AS MATERIALIZED (SELECT r.* REPLACE (near AS merchant) FROM right7 r JOIN named USING (org_id, direction, amount_minor, merchant, day)),
"""
    + rounds(DUPLICATE_KEYS, 3, "near_")
    + """SELECT org_id, source, row_id, m.l IS NULL AND n.l IS NULL AS is_canonical, COALESCE(m.l, n.l) AS mirrors_row_id,
CASE WHEN m.l IS NOT NULL THEN 'amount+date+merchant' WHEN n.l IS NOT NULL THEN 'amount+date+similar merchant' END AS dedup_method
FROM feed LEFT JOIN met m ON m.r = row_id LEFT JOIN near_met n ON n.r = row_id""",
)
def cross_source_duplicates(b):
    return matching.cross_source_duplicates(two_sources(b), ("accounting", "bank"))


def own_accounts(b):
    """Payments received in checking; each is swept to savings the next day."""
    received = b.invoices.where(F.col("paid_on").isNotNull()).select(
        "org_id",
        F.concat(F.lit("in:"), F.col("invoice_id").cast("string")).alias("row_id"),
        F.lit("checking").alias("account_id"),
        F.lit("inflow").alias("direction"),
        minor("total").alias("amount_minor"),
        F.col("paid_on").alias("day"),
    )
    key = F.substring("row_id", 4, 20)
    out = received.select(
        "org_id",
        F.concat(F.lit("out:"), key).alias("row_id"),
        "account_id",
        F.lit("outflow").alias("direction"),
        (F.col("amount_minor") + 1).alias("amount_minor"),
        F.date_add("day", 1).alias("day"),
    )
    into = out.withColumns(
        {
            "row_id": F.concat(F.lit("sav:"), F.substring("row_id", 5, 20)),
            "account_id": F.lit("savings"),
            "direction": F.lit("inflow"),
            "day": F.date_add("day", 1),
        }
    )
    return received.unionByName(out).unionByName(into)


TRANSFERS = """, r AS (SELECT org_id, invoice_id, total_minor, paid_on FROM docs WHERE paid_on IS NOT NULL),
moves AS (SELECT org_id, 'in:' || invoice_id AS row_id, 'checking' AS acct, 'inflow' AS direction, total_minor AS m, paid_on AS day FROM r
UNION ALL SELECT org_id, 'out:' || invoice_id, 'checking', 'outflow', total_minor + 1, paid_on + 1 FROM r
UNION ALL SELECT org_id, 'sav:' || invoice_id, 'savings', 'inflow', total_minor + 1, paid_on + 2 FROM r),
left0 AS (SELECT org_id, m, day, row_id FROM moves WHERE direction = 'outflow'),
right0 AS (SELECT org_id, m, day, row_id FROM moves WHERE direction = 'inflow' AND acct <> 'checking'),
""" + rounds("org_id, m", 3) + """, pairs AS (SELECT org_id, m, l AS outflow_id, r AS inflow_id, gap AS days_between FROM met JOIN left0 ON l = row_id)
"""


@query(
    "transfer_pairs",
    "A-31",
    "J-15",
    sql=TRANSFERS + "SELECT org_id, CAST(m AS BIGINT) AS amount_minor, outflow_id, inflow_id, days_between FROM pairs",
)
def transfer_pairs(b):
    return matching.transfer_pairs(own_accounts(b))


@query(
    "transfers_leave_net_unchanged",
    "A-31",
    sql=TRANSFERS
    + """SELECT p.org_id, COUNT(*) AS pairs, CAST(SUM(i.m) - SUM(o.m) AS BIGINT) AS net_minor FROM pairs p
JOIN moves o ON o.row_id = outflow_id JOIN moves i ON i.row_id = inflow_id GROUP BY 1""",
)
def transfers_leave_net_unchanged(b):
    moves, pairs = own_accounts(b), matching.transfer_pairs(own_accounts(b))
    ids = pairs.select("org_id", F.explode(F.array("outflow_id", "inflow_id")).alias("row_id"))
    flows = moves.join(ids, ["org_id", "row_id"], "left_semi")
    net = flows.groupBy("org_id").agg(
        F.sum(signed("direction", F.col("amount_minor"))).alias("net_minor"), (F.count("*") / 2).cast("bigint").alias("pairs")
    )
    return net.select("org_id", "pairs", "net_minor")


def two_directories(b):
    """Customers as two systems write them: legal forms, case, and now and then a letter lost."""
    code = F.substring(F.md5(F.col("c_name").cast("binary")), 1, 14)
    first = b.table("customer").select(
        F.col("c_nationkey").alias("org_id"),
        F.lit("accounting").alias("source"),
        F.col("c_custkey").alias("source_entity_id"),
        F.concat(F.lit("Firm "), code, F.lit(" LLC")).alias("name"),
    )
    lost = F.concat(F.substring(code, 1, 6), F.substring(code, 8, 7))
    second = b.table("customer").select(
        F.col("c_nationkey").alias("org_id"),
        F.lit("payments").alias("source"),
        F.col("c_custkey").alias("source_entity_id"),
        F.concat(F.lit("FIRM-"), F.upper(F.when(F.col("c_acctbal") < 0, lost).otherwise(code))).alias("name"),
    )
    return first.unionByName(second)


LINKS_SQL = """WITH RECURSIVE c AS (SELECT c_nationkey AS org_id, c_custkey AS id, substr(md5(c_name), 1, 14) AS code, c_acctbal FROM customer),
e AS (SELECT org_id, 'accounting' AS source, id, 'firm' || code AS key FROM c UNION ALL
SELECT org_id, 'payments', id, 'firm' || CASE WHEN c_acctbal < 0 THEN substr(code, 1, 6) || substr(code, 8, 7) ELSE code END FROM c),
n AS (SELECT DISTINCT org_id, key FROM e),
v AS (SELECT DISTINCT org_id, key, variant FROM (SELECT org_id, key, key AS variant FROM n UNION ALL SELECT org_id, key, substr(key, 1, CAST(i AS INT) - 1) || substr(key, CAST(i AS INT) + 1) FROM (SELECT *, UNNEST(generate_series(1, length(key))) AS i FROM n) x) y),
x AS (SELECT DISTINCT a.org_id, a.key AS a, b.key AS b FROM v a JOIN v b USING (org_id, variant) WHERE length(a.key) >= 6 AND length(b.key) >= 6),
reach AS (SELECT org_id, key AS a, key AS b FROM n UNION SELECT reach.org_id, reach.a, x.b FROM reach JOIN x ON x.org_id = reach.org_id AND x.a = reach.b),
l AS (SELECT org_id, a AS key, MIN(b) AS canonical FROM reach GROUP BY 1, 2)
"""


@query(
    "entity_links",
    "A-32",
    "J-16",
    sql=LINKS_SQL
    + """SELECT e.org_id, e.source, e.id AS source_entity_id, l.canonical AS canonical_key, CASE WHEN l.canonical = e.key THEN 'deterministic' ELSE 'fuzzy' END AS method,
CAST(CASE WHEN l.canonical = e.key THEN 1.0 ELSE 0.8 END AS DOUBLE) AS confidence, l.canonical <> e.key AS needs_review, length(e.key) >= 6 AS compared FROM e JOIN l ON l.org_id = e.org_id AND l.key = e.key""",
    views=False,
)
def entity_links(b):
    return matching.entity_links(two_directories(b))


@query(
    "entity_review_queue",
    "A-32",
    "J-16",
    sql=LINKS_SQL
    + """SELECT org_id, key, canonical AS canonical_key, COUNT(*) AS entities, COUNT(DISTINCT source) AS sources,
FLOOR((GREATEST(length(key), length(canonical)) - levenshtein(key, canonical)) * 10000 / GREATEST(length(key), length(canonical))) / 10000 AS score
FROM e JOIN l USING (org_id, key) WHERE canonical <> key GROUP BY 1, 2, 3""",
    views=False,
)
def entity_review_queue(b):
    entities = two_directories(b)
    return matching.review_queue(entities, matching.entity_links(entities))


@query(
    "merchant_names",
    "N-15",
    sql="""SELECT s_suppkey, 'store ' || lower(md5(s_name)) AS merchant FROM supplier""",
    views=False,
)
def merchant_names(b):
    raw = F.concat(
        F.when(F.col("s_suppkey") % 3 == 0, "SQ *").when(F.col("s_suppkey") % 3 == 1, "PAYPAL *").otherwise("  "),
        F.lit("Store  "),
        F.md5(F.col("s_name").cast("binary")),
        F.when(F.col("s_suppkey") % 2 == 0, " #1234 NY").otherwise(" 00012345"),
    )
    return b.table("supplier").select("s_suppkey", merchant_key(raw).alias("merchant"))


@query(
    "layered_categories",
    "N-16",
    sql=""", r AS (SELECT CAST(s_nationkey AS INT) AS org_id, lower(split_part(s_name, '#', 1)) AS mk, MIN(CASE WHEN s_acctbal < 0 THEN 1 ELSE 2 END) AS p FROM supplier WHERE s_acctbal < 500 GROUP BY 1, 2),
x AS (SELECT b.org_id, b.category, b.statement = 'cogs' AS locked, b.merchant_name, r.p FROM base b LEFT JOIN r ON r.org_id = b.org_id AND r.mk = lower(split_part(b.merchant_name, '#', 1)) WHERE direction = 'outflow')
SELECT org_id, CASE WHEN locked THEN category ELSE COALESCE(CASE p WHEN 1 THEN 'watch' WHEN 2 THEN 'usual' END, category, 'uncategorized') END AS category,
CASE WHEN locked THEN 'user' WHEN p IS NOT NULL THEN 'rule' WHEN category IS NOT NULL THEN 'source_system' ELSE 'default' END AS category_source, COUNT(*) AS n FROM x GROUP BY 1, 2, 3""",
)
def layered_categories(b):
    rules = b.table("supplier").where(F.col("s_acctbal") < 500).select(
        F.col("s_nationkey").cast("int").alias("org_id"),
        merchant_key(F.col("s_name")).alias("merchant_key"),
        F.when(F.col("s_acctbal") < 0, "watch").otherwise("usual").alias("category"),
        F.when(F.col("s_acctbal") < 0, 1).otherwise(2).alias("priority"),
    )
    rows = analytical(b.ledger).where(F.col("direction") == "outflow").select(
        "org_id",
        "merchant_name",
        "category",
        F.coalesce(F.col("statement") == "cogs", F.lit(False)).alias("category_locked"),
    )
    return matching.categorise(rows, rules).groupBy("org_id", "category", "category_source").agg(F.count("*").alias("n"))


@query(
    "base_currency",
    "N-17",
    sql="""SELECT invoice_id, CAST(ROUND(CAST(total AS DECIMAL(20,4)) * CAST(CASE customer_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 1.2537 ELSE 0.7461 END AS DECIMAL(10,4)), 4) * 10000 AS BIGINT) AS base_e4 FROM docs""",
)
def base_currency(b):
    key = F.col("customer_id") % 3
    rate = F.when(key == 0, F.lit("1")).when(key == 1, F.lit("1.2537")).otherwise(F.lit("0.7461")).cast("decimal(18,10)")
    converted = matching.to_base_currency(F.col("total"), rate)
    return b.invoices.select("invoice_id", (converted * 10000).cast("bigint").alias("base_e4"))


@query(
    "dated_currency",
    "N-17",
    sql=""", rates AS (SELECT currency, day, CAST(rate AS DECIMAL(18,10)) AS rate FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders) o
CROSS JOIN (VALUES ('EUR', 5, 1.1), ('GBP', 3, 1.4)) c(currency, gap, level), LATERAL (SELECT CAST(level + (day - DATE '1990-01-01') % 97 * 0.001 AS DECIMAL(18,4)) AS rate) r WHERE (day - DATE '1990-01-01') % gap = 0 AND day >= DATE '1996-01-01'),
x AS (SELECT invoice_id, total, issued_on AS day, CASE customer_id % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' END AS currency FROM docs)
SELECT x.invoice_id, x.currency, CASE WHEN x.currency = 'USD' THEN x.day ELSE r.day END AS rate_day, CAST(ROUND(x.total * CASE WHEN x.currency = 'USD' THEN 1 ELSE r.rate END, 4) * 10000 AS BIGINT) AS base_e4,
COALESCE(x.currency, '') <> 'USD' AND r.rate IS NULL AS rate_missing FROM x ASOF LEFT JOIN rates r ON x.currency = r.currency AND x.day >= r.day""",
)
def dated_currency(b):
    """Invoices in three currencies, some in none; rates are told on some days only, from 1996 on."""
    days = b.table("orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    number = F.date_diff("day", F.lit(dt.date(1990, 1, 1)))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("currency"), F.lit(g).alias("gap"), F.lit(v).cast("decimal(18,10)").alias("level")) for c, g, v in (("EUR", 5, "1.1"), ("GBP", 3, "1.4"))]))
    told = days.where(F.col("day") >= F.lit(dt.date(1996, 1, 1))).select("day", each.alias("c")).where(number % F.col("c.gap") == 0)
    rates = told.select("c.currency", "day", (F.col("c.level") + (number % 97).cast("decimal(18,10)") * F.lit("0.001").cast("decimal(4,3)")).cast("decimal(18,10)").alias("rate"))
    currency = F.element_at(F.create_map(*[F.lit(v) for pair in enumerate(("USD", "EUR", "GBP")) for v in pair]), (F.col("customer_id") % 4).cast("int"))
    rows = b.invoices.select("invoice_id", "total", F.col("issued_on").alias("day"), currency.alias("currency"))
    out = to_base(rows, rates, "USD", "total", "invoice_id")
    return out.select("invoice_id", "currency", "rate_day", (F.col("base_amount") * 10000).cast("bigint").alias("base_e4"), "rate_missing")
