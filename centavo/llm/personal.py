"""Personal data: candidates, boosted trees over their format and context, calibrated redactions.

Everything is built-in column functions. A pattern gives the matches of a text and the gaps between
them, so positions are sums of lengths (in code points). The patterns here match what the plain forms
match; they are written so that no start is tried twice in a run and no group repeats.

Base spans: e-mail, ip, card and phone, with their checks (parts up to 255, Luhn, numbers of digits).
Beyond them a generator of high recall proposes every number-like stretch, overlapping the base
spans. A candidate that meets a checked span is a known example of personal data, one that meets none is
an example of other numbers; neither the checks nor the overlap are features. Features are single bits of format and
context, so all candidates of the table sum up to at most 2^12 counts; gradient boosting of small
trees runs on those counts of all rows, and the threshold is the least score whose
candidates are personal data at the wanted precision. Candidates above it that meet no base span are
added as `number` spans.

Null and empty texts have no spans; rows are judged alone; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from centavo.session import written

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind: string, begin: int, end: int, found: string, before: string>>"
DOT, OLD = "\x01", "\x02"  # stand for a separator between two characters that belong together
NEAR = 28  # characters of context before a candidate
PRECISION, ROUNDS, RATE = 0.9, 20, 0.3

EMAIL = rf"(?:(?<![A-Za-z0-9._%+{DOT}-])|\G)[A-Za-z0-9._%+{DOT}-]++@[A-Za-z0-9-]++{DOT}[A-Za-z0-9{DOT}-]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = rf"[0-9{DOT}]{{13,}}"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
NUMBER = r"[(]?[0-9][0-9 ().-]{5,}[0-9]"
PART = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})$"


def _joined(text: Column, before: str, separator: str, after: str) -> Column:
    """The text with each such separator replaced by one character, so that a chain is a run of a class."""
    return F.regexp_replace(F.translate(text, DOT, OLD), f"(?<=[{before}]){separator}(?=[{after}])", DOT)


def _matches(text: Column, pattern: str, kind: str) -> Column:
    """Spans of all matches. Lengths are taken from one pass over gaps and matches, nothing is evaluated per element."""
    steps = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda p, m: F.struct(F.length(p).alias("gap"), F.right(p, F.lit(NEAR)).alias("before"), m.alias("found")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def add(a, x):
        begin = a["at"] + x["gap"]
        end = begin + F.length(x["found"])
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("begin"), end.alias("end"), x["found"].alias("found"), x["before"].alias("before"))
        return F.when(x["found"].isNull(), a).otherwise(F.struct(end.alias("at"), F.concat(a["out"], F.array(span)).alias("out")))

    return F.aggregate(steps, start, add, lambda a: a["out"])


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(found: Column) -> Column:
    turned = F.reverse(_digits(found))
    worth = F.transform(F.split(turned, ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(worth, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def base_spans(text: Column) -> Column:
    """Base spans of a text, by kind as listed, then begin."""
    none = F.array().cast(SPANS)
    some_digits = lambda s, low, high: F.length(_digits(s["found"])).between(low, high)
    email = F.when(F.contains(text, F.lit("@")), _matches(_joined(text, "A-Za-z0-9-", r"\.", "A-Za-z0-9-"), EMAIL, "email")).otherwise(none)
    ip = F.filter(_matches(text, IP, "ip"), lambda s: F.forall(F.split(s["found"], r"\."), lambda p: p.rlike(PART)))
    card = F.filter(_matches(_joined(text, "0-9", "[ -]", "0-9"), CARD, "card"), lambda s: some_digits(s, 13, 19))
    card = F.filter(card, lambda s: _luhn(s["found"]))
    phone = F.filter(F.when(F.contains(text, F.lit("+")), _matches(text, PHONE, "phone")).otherwise(none), lambda s: some_digits(s, 9, 15))
    return F.concat(email, F.when(text.rlike("[0-9]"), F.concat(ip, card, phone)).otherwise(none))


def _bits(s: Column) -> Column:
    """Format and context of a candidate, a bit each."""
    found, before = s["found"], F.lower(s["before"])
    digits = F.length(_digits(found))
    flags = [
        F.contains(found, F.lit("(")),
        F.contains(found, F.lit("-")),
        F.contains(found, F.lit(" ")),
        F.contains(found, F.lit(".")),
        digits >= 9,
        digits >= 13,
        digits > 16,
        before.rlike(r"\+[0-9 ]*$"),
        before.rlike(r"(?:tel|phone|call|fax|mobile|contact|dial)\W*\w*\W*$"),
        before.rlike(r"(?:card|visa|account|iban|ssn|passport|ip|host|addr\w*)\W*\w*\W*$"),
        before.rlike(r"[#$€£%=:/_]\s*$"),
        before.rlike(r"[a-z]$"),
    ]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(flags)), F.lit(0))


N_BITS = 12


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, base spans and proposed spans with their feature bits and whether they meet a base span."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    numbers = F.when(text.rlike("[0-9]"), _matches(text, NUMBER, "number")).otherwise(F.array().cast(SPANS))
    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), base_spans(text).alias("base"), numbers.alias("numbers"))
    found = written(found, "personal-spans")
    meets = lambda n: F.exists("base", lambda b: (b["begin"] < n["end"]) & (n["begin"] < b["end"]))
    proposed = F.transform("numbers", lambda n: F.struct(n["begin"].alias("begin"), n["end"].alias("end"), _bits(n).alias("bits"), meets(n).alias("known")))
    base = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["begin"].alias("begin"), s["end"].alias("end")))
    return found.select("doc_id", base.alias("base"), proposed.alias("proposed"))


@dataclass(frozen=True)
class Trees:
    """Boosted trees of two splits: (bit, bit if clear, bit if set, the four leaves)."""

    base: float
    trees: tuple[tuple[int, int, int, tuple[float, float, float, float]], ...]
    threshold: float

    def scores(self) -> np.ndarray:
        """The probability for every combination of bits."""
        bits = np.arange(1 << N_BITS)
        raw = np.full(len(bits), self.base)
        for first, low, high, leaves in self.trees:
            side = bits >> first & 1
            second = np.where(side == 1, bits >> high & 1, bits >> low & 1)
            raw += np.array(leaves)[side * 2 + second]
        return 1 / (1 + np.exp(-raw))


def boost(cells: list[tuple[int, int, int]], precision: float = PRECISION, rounds: int = ROUNDS, rate: float = RATE) -> Trees:
    """Fit to counts: (bits, candidates, of them known). Needs no rows beside the counts."""
    bits = np.array([c[0] for c in cells], np.int64)
    n, y = np.array([c[1] for c in cells], float), np.array([c[2] for c in cells], float)
    if not len(bits) or not y.sum() or y.sum() == n.sum():
        return Trees(-20.0 if not len(bits) or not y.sum() else 0.0, (), 1.1)
    base = float(np.log(y.sum() / (n.sum() - y.sum())))
    raw, trees = np.full(len(bits), base), []
    has = [(bits >> b & 1).astype(bool) for b in range(N_BITS)]

    def gain(grad, weight, rows):
        return grad[rows].sum() ** 2 / (weight[rows].sum() + 1.0)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        grad, weight = y - n * p, n * p * (1 - p)

        def split(rows, grad=grad, weight=weight):
            worth = [gain(grad, weight, rows & h) + gain(grad, weight, rows & ~h) for h in has]
            return int(np.argmax(worth)), max(worth)

        every = np.ones(len(bits), bool)
        first = max(range(N_BITS), key=lambda b: split(has[b])[1] + split(~has[b])[1])
        low, high = split(~has[first])[0], split(has[first])[0]
        side, second = has[first], np.where(has[first], has[high], has[low])
        leaves = []
        for s in (False, True):
            for t in (False, True):
                rows = every & (side == s) & (second == t)
                leaves.append(float(rate * grad[rows].sum() / (weight[rows].sum() + 1.0)))
                raw[rows] += leaves[-1]
        trees.append((first, low, high, tuple(leaves)))
    fitted = Trees(base, tuple(trees), 1.1)
    score = fitted.scores()[bits]
    order = np.argsort(-score, kind="stable")
    ahead = np.cumsum(y[order]) / np.cumsum(n[order])
    last = np.append(score[order][1:] != score[order][:-1], True)
    good = score[order][last & (ahead >= precision)]
    return Trees(base, tuple(trees), float(good.min()) if len(good) else 1.1)


def train(found: DataFrame) -> Trees:
    """From all candidates; at most 2^12 counts reach the driver."""
    each = found.select(F.explode("proposed").alias("c")).groupBy("c.bits").agg(F.count("*").alias("n"), F.sum(F.col("c.known").cast("int")).alias("known"))
    return boost([(r.bits, r.n, r.known) for r in each.collect()])


def personal_spans(docs: DataFrame) -> DataFrame:
    """doc_id and `spans`: base spans by kind, then begin; then the added ones."""
    found = written(candidates(docs), "personal-candidates")
    trees = train(found)
    chosen = np.flatnonzero(trees.scores() >= trees.threshold).tolist()
    picked = F.array(*map(F.lit, chosen)).cast("array<int>")
    added = F.transform(
        F.filter("proposed", lambda c: ~c["known"] & F.array_contains(picked, c["bits"])),
        lambda c: F.struct(F.lit("number").alias("kind"), c["begin"].alias("begin"), c["end"].alias("end")),
    )
    return found.select("doc_id", F.concat("base", added).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """doc_id and text with every base span replaced by its kind in brackets."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select("doc_id", text.alias("text"), F.array_sort(base_spans(text), lambda a, b: F.when(a["begin"] == b["begin"], a["end"] - b["end"]).otherwise(a["begin"] - b["begin"])).alias("spans"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(a, s):
        part = F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, s["begin"] - a["at"]), F.lit("["), s["kind"], F.lit("]"))
        inside = F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))
        return F.when(s["begin"] < a["at"], inside).otherwise(F.struct(s["end"].alias("at"), part.alias("out")))

    done = F.aggregate("spans", start, add)
    return found.select("doc_id", done.alias("d"), "text").select("doc_id", F.concat(F.col("d.out"), F.expr("substring(text, d.at + 1)")).alias("text"))


def digest(spans: DataFrame) -> DataFrame:
    def listed(array):
        return F.array_join(F.transform(array, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    return spans.select("doc_id", *[count(k) for k in KINDS], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
