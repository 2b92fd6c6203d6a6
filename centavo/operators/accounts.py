"""Map a provider's chart of accounts to statement classes and categories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REVIEW_BELOW = "0.7"

# Ordered mapping rules, first match wins. Each row holds patterns
# searched in the lower-cased subtype, type and name (None matches anything),
# then the statement class and the confidence.
STATEMENT_RULES = (
    ("payrolltax", None, None, "payroll", "0.98"),
    ("payroll", None, None, "payroll", "0.95"),
    ("cogs$", None, None, "cogs", "0.95"),
    ("costofservice", None, None, "cogs", "0.95"),
    (None, "^(?!.*other).*income", None, "revenue", "0.95"),
    (None, "other income", None, "other_income", "0.90"),
    (None, "cost of goods", None, "cogs", "0.92"),
    (None, "^bank$", None, "asset", "0.98"),
    (None, "credit card", None, "liability", "0.98"),
    (None, "equity", None, "equity", "0.95"),
    (None, "liability|payable", None, "liability", "0.90"),
    (None, "asset|receivable", None, "asset", "0.90"),
    (None, "expense", "payroll|salar|wage", "payroll", "0.85"),
    (None, "expense", "subcontract|contractor|freelance", "cogs", "0.55"),
    (None, "expense", "tax", "other_expense", "0.75"),
    (None, "expense", "interest", "other_expense", "0.80"),
    (None, "expense", None, "opex", "0.88"),
)

# Category by statement class and pattern in the lower-cased name,
# first match wins; the last row of a class is its default.
CATEGORY_RULES = (
    ("revenue", None, "revenue.services"),
    ("payroll", "tax", "payroll.taxes"),
    ("payroll", "benefit|health|dental|insurance", "payroll.benefits"),
    ("payroll", None, "payroll.wages"),
    ("cogs", "host|cloud|aws|server|infra", "cogs.hosting"),
    ("cogs", "material|supply|supplies", "cogs.materials"),
    ("cogs", None, "cogs.subcontractors"),
    ("opex", "rent|lease", "opex.rent"),
    ("opex", "software|subscription|saas|licen", "opex.software"),
    ("opex", "marketing|advertis|promo", "opex.marketing"),
    ("opex", "travel|meal|entertain", "opex.travel"),
    ("opex", "legal|professional|account|consult", "opex.professional"),
    ("opex", "insurance", "opex.insurance"),
    ("opex", "utilit|power|electric|internet|phone", "opex.utilities"),
    ("opex", "office|supply|supplies", "opex.office"),
    ("opex", None, "opex.other"),
    ("other_expense", "interest", "other.interest"),
    ("other_expense", None, "other.taxes"),
)
UNCATEGORIZED = "uncategorized"

# The system taxonomy (key, name, class, discretionary).
SYSTEM_CATEGORIES = (
    ("revenue.services", "Services Revenue", "revenue", False),
    ("revenue.product", "Product Revenue", "revenue", False),
    ("revenue.other", "Other Revenue", "revenue", False),
    ("cogs.subcontractors", "Subcontractors", "cogs", False),
    ("cogs.materials", "Materials", "cogs", False),
    ("cogs.hosting", "Hosting & Infrastructure", "cogs", False),
    ("payroll.wages", "Wages & Salaries", "payroll", False),
    ("payroll.taxes", "Payroll Taxes", "payroll", False),
    ("payroll.benefits", "Benefits", "payroll", False),
    ("opex.rent", "Rent", "opex", False),
    ("opex.software", "Software & Subscriptions", "opex", True),
    ("opex.marketing", "Marketing", "opex", True),
    ("opex.travel", "Travel & Entertainment", "opex", True),
    ("opex.professional", "Professional Fees", "opex", False),
    ("opex.insurance", "Insurance", "opex", False),
    ("opex.utilities", "Utilities", "opex", False),
    ("opex.office", "Office & Supplies", "opex", True),
    ("opex.other", "Other Operating", "opex", True),
    ("other.taxes", "Income Taxes", "other_expense", False),
    ("other.interest", "Interest", "other_expense", False),
    ("uncategorized", "Uncategorized", "opex", False),
)


def _lower(value: Column) -> Column:
    return F.lower(F.coalesce(value, F.lit("")))


def statement_of(account_type: Column, subtype: Column, name: Column) -> Column:
    """Struct of statement class (null when unmapped) and confidence."""
    texts = (_lower(subtype), _lower(account_type), _lower(name))
    chain = None
    for *patterns, statement, confidence in STATEMENT_RULES:
        tests = [text.rlike(p) for text, p in zip(texts, patterns, strict=True) if p is not None]
        result = _mapping(F.lit(statement), confidence)
        test = reduce(lambda a, b: a & b, tests)
        chain = F.when(test, result) if chain is None else chain.when(test, result)
    return chain.otherwise(_mapping(F.lit(None).cast("string"), "0"))


def _mapping(statement: Column, confidence: str) -> Column:
    return F.struct(
        statement.alias("statement"), F.lit(confidence).cast("decimal(4,3)").alias("confidence")
    )


def category_of(name: Column, statement: Column) -> Column:
    text = _lower(name)
    chain = None
    for cls, pattern, category in CATEGORY_RULES:
        test = statement == cls
        if pattern is not None:
            test = test & text.rlike(pattern)
        chain = F.when(test, category) if chain is None else chain.when(test, category)
    return chain.otherwise(UNCATEGORIZED)


def normalize_accounts(records: DataFrame) -> DataFrame:
    """Mapped accounts; records without an id are left to the warnings."""
    mapped = with_mapping(records).where(_has(F.col("source_account_id")))
    return mapped.select(
        "org_id",
        "source_account_id",
        F.coalesce("raw_name", F.concat(F.lit("Account "), F.col("source_account_id"))).alias("name"),
        F.coalesce("account_type", F.lit("")).alias("account_type"),
        F.coalesce("account_subtype", F.lit("")).alias("account_subtype"),
        "statement",
        category_of(F.col("raw_name"), F.col("statement")).alias("category_key"),
        F.col("confidence").alias("mapping_confidence"),
        needs_review().alias("needs_review"),
    )


def needs_review() -> Column:
    return F.col("statement").isNull() | (F.col("confidence") < F.lit(REVIEW_BELOW).cast("decimal(4,3)"))


def _has(text: Column) -> Column:
    return text.isNotNull() & (text != "")


def with_mapping(records: DataFrame) -> DataFrame:
    field = lambda path: F.try_variant_get("record", f"$.{path}", "string")
    return (
        records.select(
            "org_id",
            field("Id").alias("source_account_id"),
            field("Name").alias("raw_name"),
            field("AccountType").alias("account_type"),
            field("AccountSubType").alias("account_subtype"),
        )
        .withColumn("m", statement_of(F.col("account_type"), F.col("account_subtype"), F.col("raw_name")))
        .select("*", "m.statement", "m.confidence")
        .drop("m")
    )


def account_warnings(records: DataFrame) -> DataFrame:
    """Accounts without id, without a mapping, or mapped with low confidence."""
    mapped = with_mapping(records)
    known = F.coalesce(F.col("raw_name"), F.col("source_account_id"))
    missing = ~F.coalesce(_has(F.col("source_account_id")), F.lit(False))
    kind = (
        F.when(missing, "missing_field")
        .when(F.col("statement").isNull(), "unmapped_account")
        .when(needs_review(), "ambiguous_account")
    )
    percent = F.round(F.col("confidence") * 100).cast("int").cast("string")
    detail = (
        F.when(missing, "Account without Id")
        .when(
            F.col("statement").isNull(),
            F.concat(known, F.lit(" ("), F.coalesce("account_type", F.lit("no type")), F.lit(") has no class")),
        )
        .otherwise(F.concat(known, F.lit(" mapped to "), F.col("statement"), F.lit(" at "), percent, F.lit("%")))
    )
    return mapped.select(
        "org_id", kind.alias("kind"), detail.alias("detail"), F.when(~missing, F.col("source_account_id")).alias("source_id")
    ).where(F.col("kind").isNotNull())


def system_categories(spark) -> DataFrame:
    """The shared taxonomy: 21 rows, no tenant."""
    rows = [(None, *row) for row in SYSTEM_CATEGORIES]
    return spark.createDataFrame(
        rows, "org_id int, key string, name string, statement string, is_discretionary boolean"
    )


def category_lookup(categories: DataFrame) -> DataFrame:
    """Category key to id; ids are derived from tenant and key, so reruns agree."""
    tenant = F.coalesce(F.col("org_id").cast("string"), F.lit("system"))
    return categories.withColumn("category_id", F.sha2(F.concat_ws("|", tenant, "key"), 256))
