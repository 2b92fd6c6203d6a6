"""Fill-in-the-middle transformation over lines, cut with SWAR words.

The UTF-8 bytes of a chunk of texts are viewed as 64-bit words. The bytes that end a unit (a newline, or
the last byte of a text) are marked by word arithmetic, 0x80 in each; `bitwise_count` gives the
marks per word and their running sum. The k-th unit end is found by a search of the sums for its word and
a select inside the word, where running counts of the eight bytes come from one multiplication. Bytes
that begin a code point are marked likewise, so lengths in characters are differences of ranks.

A text of n lines is cut after the smaller and the larger of two numbers from 0 to n, both taken from
the SHA-256 of the seed and the id. A text that is empty or holds a sentinel stays plain, as does the share
of texts that the rate leaves out. No sentinel overlaps itself or another, and a transformed text
holds each once, so `restore` gives the text back exactly.

A null text is empty; a null id counts as an empty one. Rows are treated alone, so repeated rows give equal results; only
the id and the text are looked at. A long text is one row of a chunk and takes a few times its size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from centavo.llm.arrow import id_and_text, map_batches, text_bytes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_RATE = 7, 100, 50  # the rates are percentages

ONES = np.uint64(0x0101010101010101)
LOW = np.uint64(0x7F7F7F7F7F7F7F7F)
HIGH = np.uint64(0x8080808080808080)
NEWLINES = ONES * np.uint64(0x0A)
SEVEN, BYTE = np.uint64(7), np.uint64(8)


class Marks:
    """Marked bytes of a buffer, with rank and select. `words` has 0x80 in each marked byte."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        self.before = np.append(0, np.cumsum(np.bitwise_count(words), dtype=np.int64))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marks ahead of each byte position."""
        word, byte = at >> 3, (at & 7).astype(np.uint64)
        inside = np.append(self.words, np.uint64(0))[word] & ((np.uint64(1) << (byte * BYTE)) - np.uint64(1))
        return self.before[word] + np.bitwise_count(inside)

    def select(self, nth: np.ndarray) -> np.ndarray:
        """Byte position of the n-th mark, counted from 1."""
        word = np.searchsorted(self.before, nth) - 1
        running = (self.words[word] >> SEVEN) * ONES  # byte i: marks in the bytes up to i
        wanted = (nth - self.before[word]).astype(np.uint64) * ONES
        reached = ((running | HIGH) - wanted) & HIGH  # bytes whose running count is not below the wanted one
        return word * 8 + 8 - np.bitwise_count(reached)


def as_words(data: np.ndarray) -> np.ndarray:
    padded = np.zeros(-(-len(data) // 8) * 8, np.uint8)
    padded[: len(data)] = data
    return padded.view("<u8")


def unit_ends(words: np.ndarray, at: np.ndarray) -> Marks:
    other = words ^ NEWLINES  # zero where a byte is a newline
    marks = ~(((other & LOW) + LOW) | other | LOW)
    last = at[1:][np.diff(at) > 0] - 1
    np.bitwise_or.at(marks, last >> 3, np.uint64(0x80) << ((last & 7).astype(np.uint64) * BYTE))
    return Marks(marks)


def characters(words: np.ndarray) -> Marks:
    """Bytes that are not of the form 10xxxxxx. Padding counts too, but lies behind every text."""
    return Marks((~words | (words << np.uint64(1))) & HIGH)


def cut(data: np.ndarray, at: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, ...]:
    """n units of each text, the byte positions after its prefix and middle, and their lengths in characters."""
    words = as_words(data)
    ends, chars = unit_ends(words, at), characters(words)
    ahead = ends.rank(at)
    n = np.diff(ahead)
    x, y = first % (n + 1), second % (n + 1)

    def after(units: np.ndarray) -> np.ndarray:
        out = at[:-1].copy()
        some = units > 0
        out[some] = ends.select(ahead[:-1][some] + units[some]) + 1
        return out

    one, two = after(np.minimum(x, y)), after(np.maximum(x, y))
    begin, b, c = (chars.rank(p) for p in (at[:-1], one, two))
    return n, one, two, b - begin, c - b


def draws(doc_id: Column, seed: int) -> list[Column]:
    """The first four groups of eight hex digits of the hash, as integers."""
    told = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(told, 8 * k + 1, 8), 16, 10).cast("bigint").alias(f"h{k + 1}") for k in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """doc_id, n (lines), form, output and, if not plain, prefix_chars and middle_chars of each document.

    `rate` percent of the texts are transformed, `spm_rate` percent of those with the suffix first.
    """
    rows = id_and_text(docs)
    rows = rows.select("doc_id", "text", *draws(F.col("doc_id"), seed))
    marks = [s.encode() for s in (PREFIX, SUFFIX, MIDDLE)]
    p, s, m = marks

    def fn(batch: pa.RecordBatch):
        data, at = text_bytes(batch.column(1))
        h1, h2, h3, h4 = (np.asarray(batch.column(k)) for k in range(2, 6))
        n, one, two, before, inside = cut(data, at, h1, h2)
        raw = data.tobytes()
        out, forms = [], []
        for k, (a, b, c, d) in enumerate(zip(at[:-1].tolist(), one.tolist(), two.tolist(), at[1:].tolist(), strict=True)):
            if a == d or h3[k] % 100 >= rate or any(raw.find(x, a, d) >= 0 for x in marks):
                forms.append("plain")
                out.append(raw[a:d])
            elif h4[k] % 100 < spm_rate:
                forms.append("spm")
                out.append(b"".join((s, raw[c:d], p, raw[a:b], m, raw[b:c])))
            else:
                forms.append("psm")
                out.append(b"".join((p, raw[a:b], s, raw[c:d], m, raw[b:c])))
        plain = np.array([f == "plain" for f in forms], bool)
        yield {
            "doc_id": batch.column(0),
            "n": n,
            "form": forms,
            "output": pa.array(out, pa.binary()).cast(pa.string()),
            "prefix_chars": pa.array(before, mask=plain),
            "middle_chars": pa.array(inside, mask=plain),
        }

    return map_batches(rows, fn, "doc_id bigint, n bigint, form string, output string, prefix_chars bigint, middle_chars bigint")


def restored(form: Column, output: Column) -> Column:
    """The text of a transformed one, from its form and output alone. Null form or output gives null."""
    tail = F.substring_index(output, MIDDLE, -1)
    head = F.substring_index(output, MIDDLE, 1)
    skip = len(PREFIX) + 1

    def part(mark: str, first: bool) -> Column:
        side = F.substring_index(head, mark, 1 if first else -1)
        return F.substring(side, F.lit(skip), F.length(side)) if first else side

    psm = F.concat(part(SUFFIX, True), tail, part(SUFFIX, False))
    spm = F.concat(part(PREFIX, False), tail, part(PREFIX, True))
    return F.when(form == "psm", psm).when(form == "spm", spm).when(form == "plain", output)


def digest(made: DataFrame) -> DataFrame:
    back = restored(F.col("form"), F.col("output"))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(back, 256).alias("restored_sha256"),
    )
