"""Token counts of whole texts from the counts of their distinct pre-tokens.

A text is parted wherever no piece of the vocabulary has the two neighbouring characters side by side: no merge
can cross such a place, so the tokens of a text are the sum over its parts, the pre-tokens. The job has four steps:

1. Documents are read in blocks of about `BLOCK_BYTES` (a longer text alone). A block holds its distinct
   pre-tokens once, and per document the places of its distinct pre-tokens and how often each occurs.
2. The pre-tokens of all blocks are dealt out and sorted, so equal ones follow one another in one task; the library
   encodes each distinct one once, and only the length is kept. A frequent pre-token has one row per block it
   occurs in, not one per document or occurrence, so no key is heavier than the number of blocks.
3. The counts go back to their blocks, packed, and are joined to the frequencies there.
4. Every document is the sum of count times frequency. No id is ever stored.

Blocks are written to the shared folder once, and steps 2 and 3 read them, so block numbers never change.

A null or empty text has no tokens; a null id is kept. Rows are told apart by block and place, so repeated rows and ids have a
result each. Only the id and the text are looked at. A very long text is read in slices of about `SLICE` characters;
a single pre-token of many megabytes takes about a hundred bytes of memory per character in the library.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centavo.llm.arrow import id_and_text, map_batches, slices, text_bytes
from centavo.session import written

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
LIMIT = 4096
MARK = "▁"
BLOCK_BYTES = 12 << 20
ENCODED_BYTES = 1 << 20  # of pre-tokens encoded together; their ids live only that long
SLICE = 1 << 18
PACKED = 1 << 21  # counts that a task holds before it sends them
BLOCK = "block bigint, doc_ids array<bigint>, n_bytes array<bigint>, widths binary, slots binary, times binary, pre_tokens array<string>"
REPLY = "block bigint, places binary, counts binary"
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


class Pieces:
    """Counts the pieces of a pre-token as the library would inside a text."""

    def __init__(self, path: str = MODEL) -> None:
        self.path = path
        self.library = self._load()
        if "".join(self.library.encode("  ﬁ", out_type=str)) != MARK * 3 + "ﬁ":
            raise ValueError("models that rewrite the text before encoding are not supported")
        if "\n" in "".join(self._pieces()):
            raise ValueError("models with a piece for the newline are not supported")
        self.ahead = len(self.library.encode("\n"))  # the space put in front of a text, and a newline

    def _pieces(self) -> list[str]:
        """Ordinary pieces, with spaces for their marks."""
        n = self.library
        odd = (n.is_byte, n.is_control, n.is_unknown, n.is_unused)
        return [n.id_to_piece(i).replace(MARK, " ") for i in range(n.get_piece_size()) if not any(f(i) for f in odd)]

    def parting(self) -> Parting:
        return Parting(self._pieces())

    def _load(self):
        return sentencepiece.SentencePieceProcessor(model_file=self.path)

    def __getstate__(self) -> dict:
        return {"path": self.path, "ahead": self.ahead}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.library = self._load()

    def count(self, pre_tokens: list[str]) -> list[int]:
        """The library puts a space in front; behind a newline it meets no letter of the pre-token."""
        return [len(ids) - self.ahead for ids in self.library.encode(["\n" + p for p in pre_tokens], num_threads=1)]


class Parting:
    """Where texts may be parted: a table, by hash, of the neighbouring characters that some piece has.

    A clash of hashes only leaves two pre-tokens together.
    """

    def __init__(self, pieces: list[str]) -> None:
        pairs = sorted({p[k : k + 2] for p in pieces for k in range(len(p) - 1)})
        self.joined = np.zeros(1 << 20, bool)
        if pairs:
            first, second = np.array([[ord(c) for c in pair] for pair in pairs], np.uint64).T
            self.joined[self._hash(first, second)] = True

    @staticmethod
    def _hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return ((first * _FACTORS[0] + second) * _FACTORS[1]) >> np.uint64(44)

    def _bounds(self, text: str) -> list[int]:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        return (np.flatnonzero(~self.joined[self._hash(codes[:-1], codes[1:])]) + 1).tolist()

    def pre_tokens(self, text: str) -> Iterator[list[str]]:
        """Pre-tokens of a text as the library sees it, in order; a slice of the text at a time."""
        if not text:
            return
        text = " " + text.replace(MARK, " ")
        begin, size = 0, SLICE
        while begin < len(text):
            part = text[begin : begin + size]
            ends = self._bounds(part)
            if begin + size >= len(text):
                ends.append(len(part))
            elif not ends:
                size *= 2
                continue
            yield [part[b:e] for b, e in zip([0, *ends], ends, strict=False)]
            begin, size = begin + ends[-1], SLICE


def planes(values: np.ndarray) -> bytes:
    """int32 numbers as four runs of bytes, lowest first: small numbers leave runs of zeros, which compress to nothing."""
    return np.ascontiguousarray(values.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def frequencies(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """Blocks of documents: their distinct pre-tokens, and each document's frequencies of them.

    `widths` counts the distinct pre-tokens of each document, `slots` are their places in `pre_tokens`, ascending
    and as differences from the one before, and `times` how often each occurs (all in `planes`).
    """
    parting = Pieces(path).parting()
    last = [0]

    def fn(batch: pa.RecordBatch):
        number: dict[str, int] = {}
        widths, slots, times = [], [], []
        for text in batch.column(1):
            seen: Counter[str] = Counter()
            for part in parting.pre_tokens(text.as_py()):
                seen.update(part)
            slot = np.fromiter((number.setdefault(w, len(number)) for w in seen), np.int32, len(seen))
            order = np.argsort(slot)
            widths.append(len(seen))
            slots.append(np.diff(slot[order], prepend=np.int32(0)))
            times.append(np.fromiter(seen.values(), np.int32, len(seen))[order])
        yield {
            "block": [(TaskContext.get().partitionId() << 32) + last[0]],
            "doc_ids": [batch.column(0)],
            "n_bytes": [np.diff(text_bytes(batch.column(1))[1])],
            "widths": [planes(np.array(widths, np.int32))],
            "slots": [planes(np.concatenate(slots))],
            "times": [planes(np.concatenate(times))],
            "pre_tokens": [list(number)],
        }
        last[0] += 1

    return map_batches(id_and_text(docs), fn, BLOCK, BLOCK_BYTES)


def piece_counts(spread: DataFrame, path: str = MODEL) -> DataFrame:
    """The numbers of pieces of rows (block, place, pre_token), packed by block; each distinct pre-token is encoded once."""
    pieces = Pieces(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, 0
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, ENCODED_BYTES):
                words = part.column(2).dictionary_encode()
                number = words.indices.to_numpy()  # in order of appearance, and equal ones are neighbours
                distinct = words.dictionary.to_pylist()
                ahead = int(bool(distinct) and distinct[0] == last)  # begun in the slice before
                count = np.array([known] * ahead + pieces.count(distinct[ahead:]), np.int32)
                if distinct:
                    last, known = distinct[-1], int(count[-1])
                held.append((np.asarray(part.column(0)), np.asarray(part.column(1)), count[number]))
                size += part.num_rows
                if size >= PACKED:
                    yield packed(held)
                    held, size = [], 0
        if held:
            yield packed(held)

    def packed(held: list[tuple]) -> pa.RecordBatch:
        block, place, count = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((place, block))
        block, place, count = block[order], place[order], count[order]
        edges = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)] if len(block) else [0]
        each = list(zip(edges[:-1], edges[1:], strict=True))
        columns = [pa.array([block[b] for b, _ in each], pa.int64()), *(pa.array([planes(c[b:e]) for b, e in each], pa.binary()) for c in (place, count))]
        return pa.RecordBatch.from_arrays(columns, ["block", "places", "counts"])

    dealt = spread.select("block", "place", "pre_token").repartition("pre_token").sortWithinPartitions("pre_token")
    return dealt.mapInArrow(run, REPLY)


def count_tokens(docs: DataFrame, path: str = MODEL, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each document."""
    blocks = written(frequencies(docs, path), "token-blocks")
    replies = piece_counts(blocks.select("block", F.posexplode("pre_tokens").alias("place", "pre_token")), path)
    # one row per block and task that counted some of its pre-tokens: no more than the block holds
    found = replies.groupBy("block").agg(F.collect_list(F.struct("places", "counts")).alias("found"))
    told = blocks.drop("pre_tokens").join(found, "block", "left")

    def fn(batch: pa.RecordBatch):
        for row in range(batch.num_rows):
            doc_ids, n_bytes, widths, slots, times, found = (batch.column(k)[row] for k in range(1, 7))
            widths, steps, times = (from_planes(c.as_py()) for c in (widths, slots, times))
            ends = np.cumsum(widths, dtype=np.int64)
            total = np.zeros(len(steps) + 1, np.int64)
            if len(steps):
                place, count = (np.concatenate([from_planes(r[k]) for r in found.as_py()]) for k in ("places", "counts"))
                per_piece = np.zeros(len(place), np.int64)
                per_piece[place] = count
                running = np.cumsum(steps, dtype=np.int64)
                slot = running - np.repeat(np.append(0, running)[ends - widths], widths)  # each document starts from nought again
                np.cumsum(per_piece[slot] * times, out=total[1:])
            yield {"doc_id": doc_ids.values, "n_bytes": n_bytes.values, "n_tokens": total[ends] - total[ends - widths]}

    answer = map_batches(told, fn, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return answer.withColumn("over_limit", F.col("n_tokens") > limit)
