"""Duplicates across sources, transfers between own accounts, and entity links.

Rows that could match share a key. They are matched in rounds, nearest dates first: in the round of k days
the n-th free row of one side on a day meets the n-th free row of the other side k days away. Rows of
one key, side and day are alike, so which of them meet does not matter; every pair lies
within the window, and a row that is missing on one day moves no pair of another day. The rounds depend on the
window alone and each row takes part in each once, so the work is linear in rows.

How the rounds are run goes by the rows of a key. Up to `FEW_ROWS`: the rows of the key meet in one task and go
through the rounds there. More: every round is a job over all such keys, with rows numbered in parts (see
`numbered`), so a key that holds a third of all rows is still spread over many tasks. Both give the same pairs.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from centavo.functions.text import merchant_key, name_key
from centavo.operators.components import components
from centavo.operators.versions import attach, latest_by, lookup
from centavo.session import written


def _part(row_id: str) -> Column:
    """The part of a key that a row is numbered in: a prefix of a hash of its id, one of 256."""
    return F.substring(F.md5(F.col(row_id).cast("binary")), 1, 2)


def numbered(df: DataFrame, keys: Sequence[str], row_id: str) -> DataFrame:
    """Add `nth`, the 1-based number of a row among those of equal keys, without one task per key.

    Rows are counted per key and prefix of a hash of their id, at most 256 parts; a window over the
    counts gives each part its offset, and rows are numbered inside their part.
    """
    part = [*keys, "_part"]
    rows = df.withColumn("_part", _part(row_id))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        rows.groupBy(*part)
        .agg(F.count("*").alias("_count"))
        .withColumn("_offset", F.coalesce(F.sum("_count").over(before), F.lit(0).cast("bigint")))
        .drop("_count")
    )
    inside = Window.partitionBy(*part).orderBy(row_id)
    return attach(rows, parts, part).withColumn("nth", F.row_number().over(inside) + F.col("_offset")).drop("_part", "_offset")


FEW_ROWS = 2000  # of one key, both sides; beyond, the rounds of the key are spread over many tasks


def _gaps(days: int) -> list[int]:
    return sorted(range(-days, days + 1), key=lambda k: (abs(k), k < 0))


def nearest_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], days: int, account: str | None = None) -> DataFrame:
    """One-to-one pairs `left_id, right_id, gap` of rows with equal keys at most `days` apart, nearest first.

    Input: the keys, `day`, `row_id` and, if rows of one account must not meet, the account's column; rows
    without a day or account are in no pair. Both frames are read twice. With accounts a round is repeated until no pair is left to make, at most once per account of a key and day.
    """

    def side(rows: DataFrame, number: int) -> DataFrame:
        own = F.col(account).cast("string") if account else F.lit(str(number))
        return rows.select(F.lit(number).alias("side"), *keys, "day", F.col("row_id").cast("string").alias("row_id"), own.alias("account"))

    rows = side(left, 0).unionByName(side(right, 1)).where("day IS NOT NULL AND account IS NOT NULL")
    n0, n1 = (F.count_if(F.col("side") == n) for n in (0, 1))
    large = written(rows.groupBy(*keys).agg(n0.alias("n0"), n1.alias("n1")).where(F.col("n0") + F.col("n1") > FEW_ROWS), "pair-keys")
    if large.isEmpty():
        return _pairs_in_tasks(rows, keys, days)
    few = attach(rows, large.select(*keys, F.lit(True).alias("_large")), keys, "left").where("_large IS NULL").drop("_large")
    pairs = _pairs_in_tasks(few, keys, days)
    crowded = large.where("n0 > 0 AND n1 > 0").select(*keys)
    return pairs if crowded.isEmpty() else pairs.unionByName(_pairs_in_jobs(attach(rows, crowded, keys), keys, days, account))


def _pairs_in_tasks(rows: DataFrame, keys: Sequence[str], days: int) -> DataFrame:
    """The rounds of keys with few rows: the rows of a key are neighbours in one task, by side, day, account and their numbers.

    Rows alike in all of these are a run. A round takes the first free rows of a run, so pairs are made of stretches of two
    runs: keys with one run on each side are settled together, others run by run. Only runs of several accounts are taken
    row by row.
    """
    kinds = {f.name: f.dataType for f in rows.schema}
    out = T.StructType([*(T.StructField(k, kinds[k]) for k in keys), *(T.StructField(n, T.StringType()) for n in ("left_id", "right_id")), T.StructField("gap", T.IntegerType())])
    target = to_arrow_schema(out)
    gaps, width = _gaps(days), len(keys)

    def stretches(sides: tuple[dict, dict]) -> Iterator[tuple[int, int, int, int]]:
        """sides: (first row, rows) by day; yields first rows of both sides, rows and gap."""
        for gap in gaps:
            for day, (l, n) in sides[0].items():
                r, m = sides[1].get(day + gap, (0, 0))
                if took := min(n, m):
                    yield l, r, took, gap
                    sides[0][day], sides[1][day + gap] = (l + took, n - took), (r + took, m - took)

    def met(sides: tuple[dict, dict]) -> Iterator[tuple[int, int, int, int]]:
        """sides: account -> rows in order, by day; yields like `stretches`, row by row."""
        for gap in gaps:
            for day, free in sorted(sides[0].items()):
                other = sides[1].get(day + gap)
                made = free and other
                while made:
                    made = []
                    for nth in range(min(max(map(len, free.values())), max(map(len, other.values())))):
                        l, r = ([(a, ids[nth]) for a, ids in s.items() if nth < len(ids)] for s in (free, other))
                        pair = next(((x, y) for x, y in ((min(l), max(r)), (max(l), min(r))) if x[0] != y[0]), None)
                        if pair:
                            made.append(pair)
                    for (a, x), (b, y) in made:
                        free[a].remove(x)
                        other[b].remove(y)
                        yield x, y, 1, gap
                    for s in (free, other):
                        for a in [a for a, ids in s.items() if not ids]:
                            del s[a]
                    made = made and free and other

    def codes(column: pa.Array) -> np.ndarray:
        return column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)

    def changes(columns: list[np.ndarray], size: int) -> np.ndarray:
        new = np.zeros(size, bool)
        new[:1] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        return new

    def paired(batch: pa.RecordBatch) -> pa.RecordBatch:
        """The pairs of whole keys."""
        side, day = (batch.column(n).to_numpy() for n in ("side", "day"))
        of_key = changes([codes(c) for c in batch.columns[:width]], len(batch))
        runs = np.flatnonzero(changes([side, day, codes(batch.column("account"))], len(batch)) | of_key)
        size = np.diff(runs, append=len(batch))
        first = np.flatnonzero(of_key[runs])  # run of each key
        count = np.diff(first, append=len(runs))
        side, day = side[runs], day[runs].astype(np.int64)
        both = (side[first] == 0) & (side[first + count - 1] == 1)
        account = batch.column("account").take(pa.array(runs))
        two = first[both & (count == 2)]
        alike = pc.equal(account.take(pa.array(two)), account.take(pa.array(two + 1))).to_numpy(zero_copy_only=False).astype(bool)
        two = two[(np.abs(day[two + 1] - day[two]) <= days) & ~alike]
        plain = [runs[two], runs[two + 1], np.minimum(size[two], size[two + 1]), day[two + 1] - day[two]]
        made = []
        many = both & (count > 2)
        if many.any():
            named, at, n, s, d = account.to_pylist(), runs.tolist(), size.tolist(), side.tolist(), day.tolist()
            for low, runs_of in zip(first[many].tolist(), count[many].tolist(), strict=True):
                here = range(low, low + runs_of)
                ours, theirs = ({named[i] for i in here if s[i] == number} for number in (0, 1))
                sides = ({}, {})
                if len(ours) == len(theirs) == 1 and ours != theirs:
                    for i in here:
                        sides[s[i]][d[i]] = at[i], n[i]
                    made += stretches(sides)
                else:
                    for i in here:
                        sides[s[i]].setdefault(d[i], {})[named[i]] = list(range(at[i], at[i] + n[i]))
                    made += met(sides)
        rest = np.array(made, np.int64).reshape(-1, 4).T
        l, r, took, gap = (np.concatenate([x, y]) for x, y in zip(plain, rest, strict=True))
        nth = np.arange(took.sum()) - np.repeat(np.cumsum(took) - took, took)
        l, r = (pa.array(np.repeat(x, took) + nth) for x in (l, r))
        row_id = batch.column("row_id")
        columns = [*(c.take(l) for c in batch.columns[:width]), row_id.take(l), row_id.take(r), pa.array(np.repeat(gap, took))]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the rows of the last key, which may go on
        for batch in batches:
            if not len(batch):
                continue
            whole = batch if held is None else pa.concat_batches([held, batch])
            last = int(np.flatnonzero(changes([codes(c) for c in whole.columns[:width]], len(whole)))[-1])
            if last:
                yield paired(whole.slice(0, last))
            held = whole.slice(last)
        if held is not None:
            yield paired(held)

    day = F.date_diff("day", F.lit(dt.date(1970, 1, 1))).alias("day")
    order = ["_key", *keys, "side", "day", "account", "_part", "row_id"]
    ordered = rows.withColumns({"_key": F.xxhash64(*keys), "_part": _part("row_id")}).repartition("_key").sortWithinPartitions(*order)
    return ordered.select(*keys, "side", day, "account", "row_id").mapInArrow(run, out)


def _pairs_in_jobs(rows: DataFrame, keys: Sequence[str], days: int, account: str | None) -> DataFrame:
    """The rounds of keys with many rows, each a job. The rows still free are written after each, so no round repeats an earlier one."""
    state = written(rows.withColumns({"mate": F.lit(None).cast("string"), "gap": F.lit(None).cast("int")}), "pairs")
    made = []
    for gap in _gaps(days):
        while True:
            free = state.withColumn("at", F.when(F.col("side") == 1, F.date_sub("day", gap)).otherwise(F.col("day")))
            ranked = numbered(free, [*keys, "at", "side", "account"], "row_id")

            def end(number: int, pick) -> Column:
                return pick(F.when(F.col("side") == number, F.struct("account", "row_id")))

            ends = [end(0, F.min).alias("l"), end(1, F.max).alias("r"), end(0, F.max).alias("l2"), end(1, F.min).alias("r2")]
            met = ranked.groupBy(*keys, "at", "nth").agg(*ends)
            pair = F.when(F.col("l.account") != F.col("r.account"), F.struct(F.col("l.row_id").alias("l"), F.col("r.row_id").alias("r"))).when(
                F.col("l2.account") != F.col("r2.account"), F.struct(F.col("l2.row_id").alias("l"), F.col("r2.row_id").alias("r"))
            )
            pairs = met.select(pair.alias("p")).where("p IS NOT NULL").select("p.*")
            mates = pairs.select(F.lit(0).alias("side"), F.col("l").alias("row_id"), F.col("r").alias("new")).unionByName(
                pairs.select(F.lit(1).alias("side"), F.col("r").alias("row_id"), F.col("l").alias("new"))
            )
            after = state.join(mates, ["side", "row_id"], "left").withColumns({
                "mate": F.coalesce("mate", "new"),
                "gap": F.coalesce("gap", F.when(F.col("new").isNotNull(), F.lit(gap))),
            })
            done = written(after.select(state.columns), "pairs")
            state, paired = done.where("mate IS NULL"), done.where("mate IS NOT NULL AND side = 0")
            made.append(paired.select(*keys, F.col("row_id").alias("left_id"), F.col("mate").alias("right_id"), "gap"))
            if account is None or paired.isEmpty():
                break
    return reduce(DataFrame.unionByName, made)


GRAM = 3  # letters of the pieces by which similar descriptors find each other
LEAST_LETTERS = 5  # of a descriptor that may have a typo


def similar_keys(left: DataFrame, right: DataFrame, block: Sequence[str], key: str, days: int, edits: int = 1) -> DataFrame:
    """For each (block, key, day) of `right` the nearest other key of `left` in its block, at most `edits` letters and `days` apart.

    A string-similarity join inside the block: strings that are `edits` apart share one of their first
    `edits * GRAM + 1` pieces of `GRAM` letters in any one order, here the rarest first, and their lengths differ by `edits`
    at most. Only pairs that share such a piece, the block and a stretch of days are compared letter by letter. Distinct
    keys and days are joined, not rows. The nearest key has the fewest edits; then the fewest days between, then it comes first.
    """
    stretch = 2 * days + 1

    def distinct(rows: DataFrame) -> DataFrame:
        return rows.where(F.length(key) >= LEAST_LETTERS).select(*block, key, "day").distinct()

    def grams(text: Column) -> Column:
        padded = F.concat(F.lit("^" * (GRAM - 1)), text, F.lit("$" * (GRAM - 1)))
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - GRAM + 1), lambda i: F.substring(padded, i, F.lit(GRAM))))

    sides = [written(distinct(rows), "similar-keys") for rows in (left, right)]
    names = sides[0].select(key).unionByName(sides[1].select(key)).distinct()
    spread = names.select(key, F.explode(grams(F.col(key))).alias("gram"))
    rare = spread.groupBy("gram").agg(F.count("*").alias("n"))
    first = F.slice(F.array_sort(F.collect_list(F.struct("n", "gram"))), 1, edits * GRAM + 1)
    prefix = written(spread.join(rare, "gram").groupBy(key).agg(first["gram"].alias("grams")), "similar-grams")

    def probed(rows: DataFrame, at: Column) -> DataFrame:
        return rows.join(prefix, key).select(*block, F.col(key).alias("name"), "day", F.explode("grams").alias("gram"), at.alias("at"))

    number = F.floor(F.date_diff("day", F.lit(dt.date(1970, 1, 1))) / stretch)
    stored = probed(sides[0], number)
    # within `days` of a day lie at most two stretches
    asking = probed(sides[1], number).withColumn("low", F.floor(F.date_diff(F.date_sub("day", days), F.lit(dt.date(1970, 1, 1))) / stretch))
    asking = asking.withColumn("at", F.explode(F.array_distinct(F.array("low", F.floor(F.date_diff(F.date_add("day", days), F.lit(dt.date(1970, 1, 1))) / stretch))))).drop("low")
    l, r = stored.alias("l"), asking.alias("r")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*block, "gram", "at")]
    apart = F.date_diff("l.day", "r.day")
    close = (F.abs(apart) <= days) & (F.abs(F.length("l.name") - F.length("r.name")) <= edits) & (F.col("l.name") != F.col("r.name"))
    met = l.join(r, [*same, close]).select(*[F.col(f"r.{c}").alias(c) for c in block], F.col("r.name").alias(key), F.col("r.day").alias("day"), F.col("l.name").alias("other"), F.abs(apart).alias("apart"))
    steps = met.withColumn("steps", F.levenshtein("other", key, edits)).where("steps >= 0")
    return steps.groupBy(*block, key, "day").agg(F.min(F.struct("steps", "apart", "other")).alias("best")).select(*block, key, "day", F.col("best.other").alias("similar"))


EXACT, SIMILAR = "amount+date+merchant", "amount+date+similar merchant"


def cross_source_duplicates(rows: DataFrame, priority: Sequence[str], days: int = 3, edits: int = 1) -> DataFrame:
    """Decision per row: canonical, or mirror of the same event in a better source.

    Input: `org_id, source, row_id, direction, amount_minor, day, descriptor`.
    Rows mirror each other when tenant, direction, amount and merchant key are equal, their sources
    differ and their dates are at most `days` apart; a row has at most one mirror in each other
    source. Rows left over then take the nearest other merchant key of the better source's rows left over (see `similar_keys`;
    keys under `LEAST_LETTERS` letters have no typos) and are matched once more by it. Row ids are unique.
    Reading the decision again from undecided input gives the same answer.
    """
    block = ["org_id", "direction", "amount_minor"]
    keys = [*block, "merchant"]
    keyed = rows.withColumn("merchant", F.coalesce(merchant_key(F.col("descriptor")), F.lit("")))
    narrow = written(keyed.select("source", *keys, "day", "row_id"), "feed")
    none = narrow.limit(0).select(F.col("row_id").alias("right_id"), F.col("row_id").alias("left_id"), F.lit("").alias("dedup_method"))
    mirrors = none

    def without(rows: DataFrame, taken: DataFrame, column: str) -> DataFrame:
        return rows.join(taken.select(F.col(column).alias("row_id")), "row_id", "left_anti")

    def free(source: str, column: str, taken: DataFrame) -> DataFrame:
        return without(narrow.where(F.col("source") == source), taken, column)

    for i, better in enumerate(priority):
        for other in priority[i + 1 :]:
            # a row that mirrors a better one is out; one that is mirrored may have a mirror in each other source
            left, right = free(better, "right_id", mirrors), free(other, "right_id", mirrors)
            exact = written(nearest_pairs(left, right, keys, days).select("right_id", "left_id", F.lit(EXACT).alias("dedup_method")), "mirrors")
            mirrors = mirrors.unionByName(exact)
            if not edits:
                continue
            left = written(without(left, exact, "left_id"), "left-over")
            right = written(without(right, exact, "right_id"), "left-over")
            named = written(attach(right, similar_keys(left, right, block, "merchant", days, edits), [*keys, "day"]), "similar")
            found = nearest_pairs(left, named.withColumn("merchant", F.col("similar")), keys, days)
            mirrors = mirrors.unionByName(written(found.select("right_id", "left_id", F.lit(SIMILAR).alias("dedup_method")), "mirrors"))
    decided = narrow.join(mirrors, F.col("row_id") == F.col("right_id"), "left")
    return decided.select(
        "org_id",
        "source",
        "row_id",
        F.col("left_id").isNull().alias("is_canonical"),
        F.col("left_id").alias("mirrors_row_id"),
        "dedup_method",
    )


def transfer_pairs(rows: DataFrame, days: int = 3) -> DataFrame:
    """Pairs of an outflow and an inflow of one amount between two own accounts, at most `days` apart.

    Input: `org_id, row_id, account_id, direction, amount_minor, day`. Each row is in one pair at most;
    no outflow and inflow that could still pair are left over.
    """
    keys = ["org_id", "amount_minor"]
    rows = written(rows.select(*keys, "row_id", "account_id", "direction", "day"), "transfers")
    sides = [rows.where(F.col("direction") == d) for d in ("outflow", "inflow")]
    pairs = nearest_pairs(*sides, keys, days, "account_id")
    return pairs.select(*keys, F.col("left_id").alias("outflow_id"), F.col("right_id").alias("inflow_id"), F.col("gap").alias("days_between"))


# Legal forms that do not tell two businesses apart.
LEGAL_FORMS = ("inc", "incorporated", "llc", "ltd", "limited", "corp", "corporation", "co", "company", "gmbh")


def entity_key(name: Column) -> Column:
    """Normalised name without trailing legal forms."""
    words = F.regexp_replace(F.lower(name), r"[^a-z0-9]+", " ")
    forms = "|".join(LEGAL_FORMS)
    return name_key(F.regexp_replace(F.trim(words), rf"(\s+({forms}))+$", ""))


def one_letter_variants(key: Column) -> Column:
    """The key itself and the key with each single letter left out."""
    cut = F.transform(
        F.sequence(F.lit(1), F.length(key)),
        lambda i: F.concat(F.substring(key, F.lit(1), i - 1), F.substring(key, i + 1, F.length(key))),
    )
    return F.array_distinct(F.concat(F.array(key), F.when(F.length(key) > 1, cut).otherwise(F.array().cast("array<string>"))))


FUZZY_LETTERS = 6  # shorter keys differ by a letter too easily; they are reported as not compared


def entity_links(entities: DataFrame) -> DataFrame:
    """Link each source entity to a canonical key within its tenant.

    Input: `org_id, source, source_entity_id, name`. Equal keys are the same
    entity. Keys that share a one-letter deletion (one letter more, fewer or different) are linked, for
    review, and so are keys joined by a chain of such links: the canonical key is the smallest of all. A chain is
    followed in rounds that grow with the logarithm of its length (see `components`). Each distinct key adds as many rows as it has letters; no two names are compared. `compared` is
    false for keys too short to be compared by letters.
    """
    keyed = entities.withColumn("key", entity_key(F.col("name")))
    names = keyed.select("org_id", "key").distinct()
    long = F.length("key") >= FUZZY_LETTERS
    variants = names.select(
        "org_id", "key", F.explode(F.when(long, one_letter_variants(F.col("key"))).otherwise(F.array("key"))).alias("variant")
    )
    # the keys of a variant hang on the smallest of them
    hubs = variants.groupBy("org_id", "variant").agg(F.min("key").alias("b"), F.count("*").alias("n")).where("n > 1")
    links = variants.join(hubs, ["org_id", "variant"]).select("org_id", F.col("key").alias("a"), "b")
    labels = components(links, ["org_id"])
    joined = keyed.join(labels, ["org_id", "key"], "left").withColumn("canonical", F.coalesce("canonical", "key"))
    exact = F.col("key") == F.col("canonical")
    return joined.select(
        "org_id",
        "source",
        "source_entity_id",
        F.col("canonical").alias("canonical_key"),
        F.when(exact, "deterministic").otherwise("fuzzy").alias("method"),
        F.when(exact, 1.0).otherwise(0.8).alias("confidence"),
        (~exact).alias("needs_review"),
        long.alias("compared"),
    )


def review_queue(entities: DataFrame, links: DataFrame) -> DataFrame:
    """Keys linked by likeness, scored, those that bear on most entities first; one row per key and its canonical key.

    The score is the share of letters that agree. A key linked through a chain of others may have a low score.
    """
    keyed = entities.select("org_id", "source", "source_entity_id", entity_key(F.col("name")).alias("key"))
    named = links.where("needs_review").join(keyed, ["org_id", "source", "source_entity_id"])
    pairs = named.groupBy("org_id", "key", "canonical_key").agg(F.count("*").alias("entities"), F.count_distinct("source").alias("sources"))
    length = F.greatest(F.length("key"), F.length("canonical_key"))
    score = F.floor((length - F.levenshtein("key", "canonical_key")) * 10_000 / length) / 10_000
    return pairs.withColumn("score", score).orderBy(F.col("entities").desc(), "score", "org_id", "key")


def categorise(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Layered category: a locked choice, then the tenant's rule, then the account mapping.

    `rules`: `org_id, merchant_key, category, priority`, at most one kept per
    merchant (the lowest priority number).
    """
    best = latest_by(rules, ["org_id", "merchant_key"], [F.col("priority"), F.col("category")]).select(
        "org_id", "merchant_key", F.col("category").alias("rule_category")
    )
    keyed = rows.withColumn("merchant_key", merchant_key(F.col("merchant_name")))
    keyed = keyed.withColumn("_row", F.xxhash64(*rows.columns))
    source = (
        F.when(F.col("category_locked"), "user")
        .when(F.col("rule_category").isNotNull(), "rule")
        .when(F.col("category").isNotNull(), "source_system")
        .otherwise("default")
    )
    joined = lookup(keyed, best, ["org_id", "merchant_key"], "_row")
    return joined.select(
        *[c for c in rows.columns if c != "category"],
        F.when(F.col("category_locked"), F.col("category"))
        .otherwise(F.coalesce("rule_category", "category", F.lit("uncategorized")))
        .alias("category"),
        source.alias("category_source"),
    )


def to_base_currency(amount: Column, rate: Column) -> Column:
    """Amount in the tenant's base currency at four decimals."""
    product = amount.cast("decimal(20,4)") * rate.cast("decimal(18,10)")
    return F.round(product, 4).cast("decimal(20,4)")
