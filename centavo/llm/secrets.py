"""Secret scans: one byte pass of a combined deterministic automaton over every text.

All rules are compiled into one minimal automaton (`automaton.combine`). A match is a head (such as
a keyword, quotes and an equals sign) and the longest run of tail bytes after it; matches of a kind
are leftmost and do not overlap, and a run shorter than the rule's least length is used up without
being reported. The pass finds the tails; the head of a variable length is then read backwards from
the tail, which is done for reported matches only.

Null and empty texts hold nothing. Rows are judged one by one: repeated rows give repeated results,
and columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centavo.llm.arrow import id_and_text, map_batches, separated, text_bytes
from centavo.llm.automaton import Part, Rule, chars, choice, combine, one, runs, sequence, word

OUTSIDE = 0xFF  # never a byte of UTF-8
WORDS = ("password", "passwd", "secret", "token")
QUOTE, SPACE = chars("\"'"), chars(" ")


def _between(keyword: Part, backwards: bool = False) -> Part:
    around = [one(QUOTE).optional(), one(SPACE).repeated(), one(chars(":=")), one(SPACE).repeated(), one(QUOTE).optional()]
    return sequence(*around, keyword) if backwards else sequence(keyword, *around)


def _keyword(backwards: bool = False) -> Part:
    turn = (lambda w: w[::-1]) if backwards else (lambda w: w)
    plain = [word(turn(w), fold=True) for w in WORDS]
    for middle in ("", "_"):
        plain.append(word(turn(f"api{middle}key"), fold=True))
    return choice(*plain)


@dataclass(frozen=True)
class Secret:
    """A rule, and the fixed length of its head; None if it varies and `back` reads it backwards."""

    rule: Rule
    head_bytes: int | None
    back: Part | None = None


BASE = (
    Secret(Rule("assign", _between(_keyword()), chars("A-Za-z0-9+/_.=") | {ord("-")}, 8), None, _between(_keyword(True), True)),
    Secret(Rule("access", word("AKIA"), chars("A-Z0-9"), 12), 4),
    Secret(Rule("hex", Part(), chars("0-9a-f"), 32), 0),
)
ADDED = (
    Secret(Rule("github", sequence(word("gh"), one(chars("pousr")), word("_")), chars("A-Za-z0-9"), 36), 4),
    Secret(Rule("slack", sequence(word("xox"), one(chars("abprs")), word("-")), chars("A-Za-z0-9") | {ord("-")}, 10), 5),
    Secret(Rule("google", word("AIza"), chars("A-Za-z0-9_") | {ord("-")}, 35), 4),
    Secret(Rule("signed", word("eyJ"), chars("A-Za-z0-9_.") | {ord("-")}, 40), 3),
    Secret(Rule("private", word("-----BEGIN "), chars("A-Z") | SPACE, 11), 11),
)


def _read_back(part: Part, data: np.ndarray, end: int) -> int:
    """Begin of the head that ends before `end`."""
    live, at = set(), end
    allowed = part.first
    while at:
        byte = int(data[at - 1])
        live = {p for p in allowed if byte in part.sets[p]}
        if not live:
            break
        at -= 1
        if live & part.last:
            return at
        allowed = {q for p in live for q in part.follow.get(p, ())}
    raise ValueError("a reported tail has no head")


def _spans(data: np.ndarray, secrets: tuple[Secret, ...], automaton) -> list[list[tuple[int, int]]]:
    """Byte spans of each kind in the separated buffer, in order."""
    label = automaton.label[automaton.scan(data)]
    out = []
    for i, s in enumerate(secrets):
        begin, end = runs((label >> i) & 1 == 1)
        long = end - begin >= s.rule.least
        begin, end = begin[long], end[long]
        if s.head_bytes is not None:
            out.append(list(zip((begin - s.head_bytes).tolist(), end.tolist(), strict=True)))
        else:
            out.append([(_read_back(s.back, data, b), e) for b, e in zip(begin.tolist(), end.tolist(), strict=True)])
    return out


def find_secrets(docs: DataFrame, secrets: tuple[Secret, ...] = BASE + ADDED) -> DataFrame:
    """doc_id and `found`: array of (kind, begin, end) in code points by begin, then kind as listed."""
    automaton = combine([s.rule for s in secrets])
    kinds = [s.rule.kind for s in secrets]

    def fn(batch):
        raw, at = text_bytes(batch.column(1))
        data, starts = separated(raw, at, OUTSIDE)
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(batch.num_rows)]
        for rank, spans in enumerate(_spans(data, secrets, automaton)):
            rows = np.searchsorted(starts, [b for b, _ in spans], side="right") - 1
            for row, (b, e) in zip(rows.tolist(), spans, strict=True):
                found[row].append((b - int(starts[row]), rank, e - int(starts[row])))
        listed = []
        for row, spans in enumerate(found):
            own, done, points = [], 0, 0
            begins = raw[at[row] : at[row + 1]] & 0xC0 != 0x80
            for b, rank, e in sorted(spans):
                points += int(np.count_nonzero(begins[done:b]))
                done = b
                own.append({"kind": kinds[rank], "begin": points, "end": points + int(np.count_nonzero(begins[b:e]))})
            listed.append(own)
        yield {"doc_id": batch.column(0), "found": listed}

    return map_batches(id_and_text(docs), fn, "doc_id bigint, found array<struct<kind string, begin bigint, end bigint>>")


def redact_secrets(docs: DataFrame, secrets: tuple[Secret, ...] = BASE + ADDED, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every found span replaced by `mark` (overlapping spans by one), n_chars counted anew.

    All rows and columns are kept; a null text stays null.
    """
    automaton = combine([s.rule for s in secrets])
    marker = mark.encode()
    others = [c for c in docs.columns if c not in ("text", "n_chars")]

    def fn(batch):
        column = batch.column(batch.schema.names.index("text"))
        raw, at = text_bytes(column.fill_null("") if column.null_count else column)
        data, starts = separated(raw, at, OUTSIDE)
        spans = sorted(s for kind in _spans(data, secrets, automaton) for s in kind)
        merged: list[list[int]] = []
        for b, e in spans:
            if merged and b < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([b, e])
        texts = column.to_pylist()
        counts = [None if t is None else len(t) for t in texts]
        rows = np.searchsorted(starts, [b for b, _ in merged], side="right") - 1
        own: dict[int, list[list[int]]] = {}
        for row, span in zip(rows.tolist(), merged, strict=True):
            own.setdefault(row, []).append(span)
        for row, spans_ in own.items():
            base, done, parts = int(starts[row]), 0, []
            whole = raw[at[row] : at[row + 1]].tobytes()
            for b, e in spans_:
                parts += [whole[done : b - base], marker]
                done = e - base
            texts[row] = b"".join([*parts, whole[done:]]).decode()
            counts[row] = len(texts[row])
        yield {c: batch.column(batch.schema.names.index(c)) for c in others} | {"text": texts, "n_chars": counts}

    wide = docs.withColumn("text", F.col("text").cast("string")).withColumn("n_chars", F.col("n_chars").cast("bigint"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wide.schema)
    return map_batches(wide, fn, schema)


def digest(found: DataFrame, base: tuple[Secret, ...] = BASE) -> DataFrame:
    """Counts per base kind, the hash of the base spans, and all spans as text."""
    names = [s.rule.kind for s in base]

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")

    def of_kind(kind):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[of_kind(k) for k in names],
        F.sha2(listed(F.filter("found", lambda s: s["kind"].isin(names))), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"),
    )
