"""Benchmark decontamination: Wu-Manber search for the word windows of all benchmark items at once.

Texts and windows are brought to one form: A-Z lower-cased, words parted by single spaces, a space
at both ends. A window is a pattern of that form, so its words match whole words only. A table of
shifts by block of bytes lets the search jump over positions where no pattern can end; where the
shift is zero, the patterns of that suffix block are compared with the text byte by byte. Many
stretches of the text are searched side by side.

Benchmark items are read in blocks of at most `block_bytes`; each block is one pass over the
documents, so no task ever holds more than one block of patterns.

A null or empty text has no words and is clean; an item without words has no window. Items are
known by item_id: rows that share one are one item (a null id counts as the id ""). Repeated
documents are judged one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centavo.llm.arrow import map_batches, ragged, separated, text_bytes

WINDOW = 10
BLOCK_BYTES = 16 << 20
SPACE, BOUNDARY = 0x20, 0x00
LANES = 8192
BITS = 18

_FORM = np.full(256, SPACE, np.uint8)
for _b in (*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)):
    _FORM[_b] = _b
for _b in range(ord("A"), ord("Z") + 1):
    _FORM[_b] = _b + 32


def normal_form(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All rows in one buffer, each as " w1 w2 ... " after a boundary byte; where each row's first space is."""
    out, starts = separated(_FORM[data], at, BOUNDARY, before=3)
    out[starts - 1] = SPACE
    out[starts - 3] = SPACE  # ends the row before
    out[-1] = SPACE
    space = out == SPACE
    keep = np.ones(len(out), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    return out[keep], (np.cumsum(keep) - 1)[starts - 1]


@dataclass(frozen=True)
class Patterns:
    """Tables of one search; all patterns have at least `shortest` bytes."""

    texts: list[bytes]
    shortest: int
    block: int
    shift: np.ndarray
    suffix: np.ndarray  # sorted suffix blocks of the first `shortest` bytes
    owner: np.ndarray  # pattern of each

    @classmethod
    def of(cls, texts: list[bytes]) -> Patterns:
        m = min(map(len, texts))
        block = 8 if m >= 16 else max(1, m // 2)
        heads = np.frombuffer(b"".join(t[:m] for t in texts), np.uint8).reshape(len(texts), m)
        shift = np.full(1 << BITS, min(m - block + 1, 255), np.uint8)
        for end in range(block, m + 1):
            np.minimum.at(shift, _slot(_value(heads[:, end - block : end])), min(m - end, 255))
        last = _value(heads[:, m - block :])
        order = np.argsort(last, kind="stable")
        return cls(texts, m, block, shift, last[order], order)

    def find(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and pattern of every occurrence."""
        n, m, block = len(data), self.shortest, self.block
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        eight = np.ndarray((n + 1,), "<u8", padded, strides=(1,))
        mask = np.uint64((1 << 8 * block) - 1)
        lanes = max(1, min(LANES, n // 64))
        step = -(-n // lanes)
        end = np.arange(lanes, dtype=np.int64) * step + m - 1
        stop = np.minimum(np.arange(1, lanes + 1, dtype=np.int64) * step + m - 1, n)
        live = end < stop
        end, stop, found = end[live], stop[live], []
        while len(end):
            jump = self.shift[_slot(eight[end - (block - 1)] & mask)].astype(np.int64)
            here = jump == 0
            found.append(end[here])
            end = end + np.where(here, 1, jump)
            live = end < stop
            if not live.all():
                end, stop = end[live], stop[live]
        at = np.concatenate(found) if found else np.zeros(0, np.int64)
        value = eight[at - (block - 1)] & mask
        low, high = np.searchsorted(self.suffix, value), np.searchsorted(self.suffix, value, side="right")
        begin = np.repeat(at - (m - 1), high - low)
        pattern = self.owner[ragged(low, high - low)]
        whole = data.tobytes()
        real = [whole.startswith(self.texts[p], b) for b, p in zip(begin.tolist(), pattern.tolist(), strict=True)]
        real = np.array(real, bool)
        return begin[real], pattern[real]


def _value(blocks: np.ndarray) -> np.ndarray:
    """Bytes of each row as one little-endian number."""
    out = np.zeros(len(blocks), np.uint64)
    for k in range(blocks.shape[1]):
        out |= blocks[:, k].astype(np.uint64) << np.uint64(8 * k)
    return out


def _slot(value: np.ndarray) -> np.ndarray:
    return (value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)


@dataclass(frozen=True)
class Search:
    """Patterns of one block of items: whole windows and, apart from them, the shorter ones."""

    groups: list[tuple[Patterns, np.ndarray, list[list[str]]]]  # patterns, words of each, items of each


def windows_of(items: list[tuple[str, str]], window: int = WINDOW) -> Search:
    owners: dict[bytes, set[str]] = {}
    for item, text in items:
        raw = np.frombuffer(text.encode(), np.uint8)
        data, _ = normal_form(raw, np.array([0, len(raw)]))
        words = data.tobytes()[1:].split()[0:] if len(raw) else []
        words = [w for w in words if w != b"\0"]
        for i in range(max(1, len(words) - window + 1) if words else 0):
            owners.setdefault(b" " + b" ".join(words[i : i + window]) + b" ", set()).add(item)
    groups = []
    for short in (False, True):
        texts = sorted(t for t in owners if (t.count(b" ") <= window) == short)
        if texts:
            counts = np.array([t.count(b" ") - 1 for t in texts])
            groups.append((Patterns.of(texts), counts, [sorted(owners[t]) for t in texts]))
    return Search(groups)


def _judge(search: Search, column) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]]]:
    """Per row: number of words, hit ranges of words, items found."""
    raw, at = text_bytes(column)
    data, starts = normal_form(raw, at)
    inside = (data != SPACE) & (data != BOUNDARY)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    before = np.cumsum(first)  # words begun up to and with this byte
    base = before[starts]
    counts = np.diff(np.append(base, before[-1])) if len(base) else base
    hits: list[list[tuple[int, int]]] = [[] for _ in range(len(starts))]
    items: list[set[str]] = [set() for _ in range(len(starts))]
    for patterns, lengths, owners in search.groups:
        begin, pattern = patterns.find(data)
        row = np.searchsorted(starts, begin, side="right") - 1
        word = before[begin] - base[row]
        for r, w, p, k in zip(row.tolist(), word.tolist(), pattern.tolist(), lengths[pattern].tolist(), strict=True):
            hits[r].append((w, w + k))
            items[r].update(owners[p])
    return counts, hits, items


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for b, e in sorted(spans):
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((b, e))
    return out


def _blocks(benchmark: DataFrame, block_bytes: int) -> int:
    size = benchmark.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    return max(1, -(-size * 2 // block_bytes))


def _block(benchmark: DataFrame, k: int, n: int) -> list[tuple[str, str]]:
    rows = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else benchmark
    return [("" if r.item_id is None else str(r.item_id), r.text) for r in rows.where("text IS NOT NULL").select("item_id", "text").collect()]


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents' columns and n_words, `hits` (ranges of hit words, disjoint) and `items` (found item ids)."""
    n = _blocks(benchmark, block_bytes)
    frame = docs.withColumns({
        "n_words": F.lit(None).cast("bigint"),
        "hits": F.expr("cast(array() as array<struct<begin: bigint, end: bigint>>)"),
        "items": F.expr("cast(array() as array<string>)"),
    })
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)
    names = frame.columns
    for k in range(n):
        search = windows_of(_block(benchmark, k, n), window)

        def fn(batch, search=search):
            column = batch.column(names.index("text"))
            counts, hits, items = _judge(search, column.fill_null("") if column.null_count else column)
            old_hits, old_items = batch.column(names.index("hits")).to_pylist(), batch.column(names.index("items")).to_pylist()
            hits = [union([*h, *((s["begin"], s["end"]) for s in old)]) for h, old in zip(hits, old_hits, strict=True)]
            out = {c: batch.column(i) for i, c in enumerate(names)}
            out["n_words"] = counts
            out["hits"] = [[{"begin": b, "end": e} for b, e in h] for h in hits]
            out["items"] = [sorted({*i, *old}) for i, old in zip(items, old_items, strict=True)]
            yield out

        frame = map_batches(frame, fn, schema)
    return frame


def digest(scanned: DataFrame) -> DataFrame:
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["begin"])
    return scanned.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without a benchmark window; their columns as given."""
    for k in range(n := _blocks(benchmark, block_bytes)):
        search = windows_of(_block(benchmark, k, n), window)

        def fn(batch, search=search):
            column = batch.column(batch.schema.names.index("text"))
            _, hits, _ = _judge(search, column.fill_null("") if column.null_count else column)
            clean = batch.filter(np.array([not h for h in hits], bool))
            yield dict(zip(clean.schema.names, clean.columns, strict=True))

        docs = map_batches(docs, fn, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
    return docs
