"""SentencePiece encoding and decoding with a batched Viterbi in numpy.

Words of equal length advance together: at every position the substrings that end there are looked
up by polynomial hash among the sorted keys of the pieces, each is worth the best value where it
begins and its own, and the maxima and their lengths are stored to walk back from the end.

What a piece is worth depends on the kind of model. `unigram`: its score. `bpe`: nothing or minus
infinity, by whether it may follow the piece stored where it begins; a sequence of pieces is the one
that byte-pair merging gives exactly if each neighbouring pair is what merging gives for
that pair alone, so one path stays finite and the ids are those of merging. The vocabulary file at hand is such a model.

A text gets a space in front; spaces become the piece mark; runs of spaces and characters without a
piece (then taken byte by byte) part the words. Texts are encoded whole; a long one goes through
in parts. Words already seen by a task are kept up to `KEPT_BYTES`. A null or empty text has no ids and decodes to the empty text. Rows are treated alone; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from centavo.llm.arrow import give_back, id_and_text, map_batches, ragged, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15)
BOUND = re.compile("(?<=[^ ])(?= )")  # where a text may be parted: ahead of the space of a word
KEPT_BYTES = 64 << 20  # of words a task remembers; beyond, it starts anew
WORD_BYTES = 150  # of memory that a remembered word takes besides its letters, about
PAIRS = 1 << 20  # remembered verdicts on neighbouring pieces
LEARNED = 4 << 20  # characters whose new words are learned together: they are few, and a pass over them costs the same
NEW_WORDS = 100_000  # most words learned together, about
PART = 1 << 18  # characters of a text, or ids, that are handled at a time
CHUNK = LEARNED  # bytes of text whose new words are learned together; a longer text comes alone and is encoded in parts
SHOWN = 1 << 20  # bytes of text that are encoded and decoded together once their words are known
BATCH = 1 << 18  # characters of words that advance together, about


@dataclass
class Model:
    kind: str
    texts: list[str]
    scores: np.ndarray
    byte_ids: np.ndarray  # id of each byte
    ids: dict[str, int]  # of ordinary pieces

    @classmethod
    def load(cls, path: str = MODEL, kind: str = "bpe") -> Model:
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        if "".join(sp.encode("  ﬁ", out_type=str)) != MARK * 3 + "ﬁ":
            raise ValueError("models that rewrite the text before encoding are not supported")
        texts = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        return cls(kind, texts, np.array([sp.get_score(i) for i in range(n)]), byte_ids, {t: i for i, t in enumerate(texts) if not special[i]})


class Encoder:
    """The tables of a model, and what a task remembers."""

    def __init__(self, model: Model) -> None:
        self.model = model
        # ordinary pieces in the order in which merging makes them: single characters, then by score
        order = sorted(model.ids.items(), key=lambda x: (len(x[0]) > 1, -model.scores[x[1]], x[1]))
        self.pieces = [t for t, _ in order]
        self.id_of = np.array([i for _, i in order], np.int32)
        self.score = model.scores[self.id_of]
        self.width = max(map(len, self.pieces))
        self.length = np.array([len(t) for t in self.pieces])
        self.letters = np.zeros((len(order), self.width), np.uint32)
        for r, t in enumerate(self.pieces):
            self.letters[r, : len(t)] = np.frombuffer(t.encode("utf-32-le"), np.uint32)
        self.power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(self.width + 1, BASE))])
        value = np.zeros(len(order), np.uint64)
        for k in range(self.width):
            more = k < self.length
            value[more] = value[more] * BASE + self.letters[more, k].astype(np.uint64) + np.uint64(1)
        self.value = value
        key = self._key(value, self.length)
        self.sorted = np.argsort(key)
        self.keys = key[self.sorted]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.maybe = np.zeros(1 << 20, bool)  # most substrings are no piece, and this tells so at once
        self.maybe[key >> np.uint64(44)] = True
        # characters that some longer piece has; the others, digits among them, stand alone in every word
        joined = sorted(set("".join(t for t in self.pieces if len(t) > 1)))
        self.known = re.compile("[" + "".join(map(re.escape, joined)) + "]+|.", re.S)
        self.left = np.arange(len(order))
        self.right = np.arange(len(order))
        self.alone = np.ones(len(order), bool)
        if model.kind == "bpe":
            self._split()
        self.pair_key = np.full(PAIRS, -1, np.int64)
        self.pair_good = np.zeros(PAIRS, bool)
        self.start()
        self.runs = [self._run(k) for k in range(max(k for k in range(1, self.width + 1) if MARK * k in model.ids) + 1)]
        self.mark = model.ids[MARK]

    def start(self) -> None:
        self.kept = 0  # bytes, about
        self.number: dict[str, int] = {}
        self.flat = np.zeros(0, np.int32)  # ids of all remembered words
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)

    @staticmethod
    def _key(value: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return value ^ (np.asarray(length).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))

    def _find(self, value: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Rank of the piece with a hash and length, or -1."""
        key = self._key(value, length)
        out = np.full(len(key), -1)
        some = np.flatnonzero(self.maybe[key >> np.uint64(44)])
        key = key[some]
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        out[some] = np.where(self.keys[at] == key, self.sorted[at], -1)
        return out

    def _split(self) -> None:
        """The two pieces that merging joins last to make each piece; `alone`: merging a piece's own text gives it back."""
        rank = {t: r for r, t in enumerate(self.pieces)}
        for r, text in enumerate(self.pieces):
            parts = list(text)
            while len(parts) > 1:
                best = min(((rank.get(a + b, len(rank)), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
                if best[0] == len(rank) or (len(parts) == 2 and best[0] != r):
                    break
                k = best[1]
                if len(parts) == 2:
                    self.left[r], self.right[r] = rank[parts[0]], rank[parts[1]]
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            self.alone[r] = len(parts) == 1

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the text of piece a and piece b gives these two pieces."""
        pair = a.astype(np.int64) * len(self.pieces) + b
        slot = (pair.view(np.uint64) * BASE >> np.uint64(44)).astype(np.int64)
        new = np.flatnonzero(self.pair_key[slot] != pair)
        good = self.pair_good[slot]
        if len(new):
            fresh, back = np.unique(pair[new], return_inverse=True)
            verdict = self._walk(fresh // len(self.pieces), fresh % len(self.pieces))
            good[new] = verdict[back.ravel()]
            self.pair_key[slot[new]], self.pair_good[slot[new]] = pair[new], good[new]
        return good

    def _walk(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Undo the later merge of either side until nothing is left, looking for an earlier merge across."""
        out = np.ones(len(a), bool)
        row = np.arange(len(a))
        limit = np.full(len(a), 1 << 60)
        while len(row):
            joint = self.length[a] + self.length[b]
            fits = joint <= self.width
            across = np.full(len(a), -1)
            across[fits] = self._find(self.value[a[fits]] * self.power[self.length[b[fits]]] + self.value[b[fits]], joint[fits])
            bad = (across >= 0) & (across < limit)
            out[row[bad]] = False
            go = ~bad
            row, a, b, limit = row[go], a[go], b[go], limit[go]
            later = a > b
            down_a, down_b = self.right[a], self.left[b]
            stuck_a, stuck_b = down_a == a, down_b == b
            use_a = np.where(later, ~stuck_a, stuck_b & ~stuck_a)
            use_b = np.where(later, stuck_a & ~stuck_b, ~stuck_b)
            limit = np.where(use_a, a, b + 1)
            a, b = np.where(use_a, down_a, a), np.where(use_b, down_b, b)
            on = use_a | use_b
            row, a, b, limit = row[on], a[on], b[on], limit[on]
        return out

    def _advance(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the pieces of words of one length (rows of code points), and how many each word has."""
        n, size = words.shape
        prefix = np.zeros((size + 1, n), np.uint64)
        for k in range(size):
            prefix[k + 1] = prefix[k] * BASE + words[:, k].astype(np.uint64) + np.uint64(1)
        best = np.full((size + 1, n), -np.inf)
        best[0] = 0
        last = np.zeros((size + 1, n), np.int64)
        for end in range(1, size + 1):
            for k in range(min(end, self.width), 0, -1):
                begin = end - k
                todo = np.flatnonzero(np.isneginf(best[end])) if self.model.kind == "bpe" else np.arange(n)
                if not len(todo):
                    break
                piece = self._find(prefix[end, todo] - prefix[begin, todo] * self.power[k], k)
                hit = piece >= 0
                todo, piece = todo[hit], piece[hit]
                same = (self.letters[piece, :k] == words[todo, begin:end]).all(1)
                todo, piece = todo[same], piece[same]
                if self.model.kind == "bpe":
                    good = self.alone[piece]
                    if begin:
                        good &= self.may_follow(last[begin, todo], piece)
                    worth = np.where(good, best[begin, todo], -np.inf)
                else:
                    worth = best[begin, todo] + self.score[piece]
                more = worth > best[end, todo]
                best[end, todo[more]], last[end, todo[more]] = worth[more], piece[more]
        if np.isneginf(best[size]).any():
            raise ValueError("a word has no path")
        place = np.full(n, size)
        steps = []
        while (place > 0).any():
            piece = np.where(place > 0, last[place, np.arange(n)], -1)
            steps.append(piece)
            place = place - np.where(place > 0, self.length[piece], 0)
        path = np.array(steps[::-1]).T
        return path[path >= 0], (path >= 0).sum(1)

    def _learn_all(self, new: set[str]) -> None:
        new.discard("")
        if new:
            self._learn(list(new))
            new.clear()

    def _learn(self, words: list[str]) -> None:
        """Encode new words (each with a mark in front) and remember them."""
        runs = [self.known.findall(MARK + w) for w in words]
        fresh = {r for parts in runs for r in parts if len(r) > 1 or r in self.model.ids}
        by_size: dict[int, list[str]] = {}
        for r in fresh:
            by_size.setdefault(len(r), []).append(r)
        flat, begun, place = [], 0, {}
        for size, group in by_size.items():
            step = max(1, BATCH // size)
            for i in range(0, len(group), step):
                some = group[i : i + step]
                codes = np.frombuffer("".join(some).encode("utf-32-le"), np.uint32).reshape(len(some), size)
                ranks, counts = self._advance(codes)
                starts = (np.cumsum(counts) - counts + begun).tolist()
                place.update(zip(some, zip(starts, counts.tolist(), strict=True), strict=True))
                flat.append(self.id_of[ranks])
                begun += len(ranks)
        known = np.concatenate(flat) if flat else np.zeros(0, np.int32)
        self.kept += sum(map(len, words)) + WORD_BYTES * len(words)
        base, more, starts, sizes = len(self.flat), [], [], []
        at = base + len(known)
        self.number.update(zip(words, range(len(self.starts), len(self.starts) + len(words)), strict=True))
        for parts in runs:
            if len(parts) == 1 and parts[0] in place:
                start, size = place[parts[0]]
                starts.append(base + start)
            else:
                ids = [known[place[r][0] : sum(place[r])] if r in place else self.model.byte_ids[np.frombuffer(r.encode(), np.uint8)] for r in parts]
                more.append(np.concatenate(ids))
                size = len(more[-1])
                starts.append(at)
                at += size
            sizes.append(size)
        self.flat = np.concatenate([self.flat, known, *more])
        self.starts = np.concatenate([self.starts, np.array(starts, np.int64)])
        self.sizes = np.concatenate([self.sizes, np.array(sizes, np.int64)])

    def _run(self, count: int) -> list[int]:
        """Ids of a short run of marks: its merges are worth the same, so the leftmost comes first."""
        parts = [1] * count
        while k := next((k for k in range(1, len(parts)) if MARK * (parts[k - 1] + parts[k]) in self.model.ids), 0):
            parts[k - 1 : k + 1] = [parts[k - 1] + parts[k]]
        return [self.model.ids[MARK * p] for p in parts]

    def _spaces(self, count: int) -> np.ndarray:
        whole, rest = divmod(count, len(self.runs) - 1)
        return np.array(self.runs[-1] * whole + self.runs[rest], np.int32)

    @staticmethod
    def _parts(text: str) -> Iterator[list[str]]:
        """The words of a text, each with a space in front, in parts of about `PART` characters; an empty word is one more space."""
        text = " " + text.replace(MARK, " ")
        begin = 0
        while begin < len(text):
            bound = BOUND.search(text, begin + PART) if len(text) - begin > PART else None
            end = bound.start() if bound else len(text)
            yield text[begin:end].split(" ")[1:]
            begin = end

    def _groups(self, texts: list[str]) -> Iterator[list[tuple[int, list[str]]]]:
        """Parts and the texts they belong to, so many that their new words are learned together."""
        group, held = [], 0
        for k, text in enumerate(texts):
            for part in self._parts(text) if text else ():
                group.append((k, part))
                held += min(len(text), PART)
                if held >= LEARNED:
                    yield group
                    group, held = [], 0
        if group:
            yield group

    def slices(self, batch: pa.RecordBatch, column: int = 1) -> Iterator[pa.RecordBatch]:
        """Parts of a batch that may be encoded one by one, the words of all of it learned at once unless a text is long."""
        if sum(map(len, batch.column(column).to_pylist())) <= 2 * LEARNED:
            if self.kept > KEPT_BYTES:
                self.start()
            new: set[str] = set()
            for text in batch.column(column):
                for words in self._parts(text.as_py()) if text.as_py() else ():
                    new.update(w for w in words if w not in self.number)
                    if len(new) > NEW_WORDS:
                        self._learn_all(new)
            self._learn_all(new)
            del new
            give_back()
        yield from slices(batch, SHOWN)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array and the bounds of each text."""
        out, sizes = [], np.zeros(len(texts), np.int64)
        for group in self._groups(texts):
            if self.kept > KEPT_BYTES + LEARNED * 8:  # a batch may have learned beyond the bound
                self.start()
            new: set[str] = set()
            for _, words in group:
                new.update(w for w in words if w not in self.number)
                if len(new) > NEW_WORDS:
                    self._learn_all(new)
            self._learn_all(new)
            for k, words in group:
                ids = self._ids(words)
                out.append(ids)
                sizes[k] += len(ids)
        return np.concatenate(out) if out else self.flat[:0], np.append(0, np.cumsum(sizes))

    def _ids(self, words: list[str]) -> np.ndarray:
        """Ids of known words."""
        base, number, starts, sizes = self.flat, self.number, self.starts, self.sizes
        if "" not in words:
            w = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
            return base[ragged(starts[w], sizes[w])]
        parts, spaces = [], 0
        for word in words:
            spaces += 1
            if word:
                k = number[word]
                own = base[starts[k] : starts[k] + sizes[k]]
                if own[0] == self.mark:
                    parts += [self._spaces(spaces), own[1:]]
                else:
                    parts += [self._spaces(spaces - 1), own]
                spaces = 0
        return np.concatenate([*parts, self._spaces(spaces)])


class Decoder:
    def __init__(self, model: Model) -> None:
        raw = [t.replace(MARK, " ").encode() if t in model.ids and model.ids[t] == i else b"" for i, t in enumerate(model.texts)]
        for b, i in enumerate(model.byte_ids.tolist()):
            raw[i] = bytes([b])
        self.size = np.array([len(r) for r in raw])
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(raw), np.uint8)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The texts of the ids; the space put in front is taken off."""
        some = [ids[k : k + PART] for k in range(0, len(ids), PART)]
        data = b"".join([self.data[ragged(self.start[i], self.size[i])].tobytes() for i in some])
        ends = np.append(0, np.cumsum(self.size[ids]))[bounds].tolist()
        return [data[b:e].removeprefix(b" ").decode(errors="replace") for b, e in zip(ends[:-1], ends[1:], strict=True)]


def encode(docs: DataFrame, path: str = MODEL, kind: str = "bpe") -> DataFrame:
    """doc_id and ids."""
    encoder = Encoder(Model.load(path, kind))

    def fn(batch):
        for part in encoder.slices(batch):
            ids, bounds = encoder.encode(part.column(1).to_pylist())
            yield {"doc_id": part.column(0), "ids": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))}

    return map_batches(id_and_text(docs), fn, "doc_id bigint, ids array<int>", CHUNK)


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id and text of doc_id and ids; null ids give the empty text."""
    decoder = Decoder(Model.load(path))

    def fn(batch):
        column = batch.column(1)
        sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = column.drop_null().flatten().to_numpy(zero_copy_only=False)
        yield {"doc_id": batch.column(0), "text": decoder.decode(flat, np.append(0, np.cumsum(sizes)))}

    return map_batches(encoded.select("doc_id", "ids"), fn, "doc_id bigint, text string")


def encoded_and_checked(docs: DataFrame, path: str = MODEL, kind: str = "bpe") -> DataFrame:
    """doc_id, ids, n_tokens, n_byte_tokens, and round_trip: whether the ids decode to the text (piece marks read as spaces)."""
    model = Model.load(path, kind)
    encoder, decoder = Encoder(model), Decoder(model)
    is_byte = np.zeros(len(model.texts), bool)
    is_byte[model.byte_ids] = True

    def fn(batch):
        for part in encoder.slices(batch):
            texts = part.column(1).to_pylist()
            ids, bounds = encoder.encode(texts)
            back = decoder.decode(ids, bounds)
            single = np.append(0, np.cumsum(is_byte[ids]))
            yield {
                "doc_id": part.column(0),
                "ids": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())),
                "n_tokens": np.diff(bounds),
                "n_byte_tokens": np.diff(single[bounds]),
                "round_trip": [b == t.replace(MARK, " ") for b, t in zip(back, texts, strict=True)],
            }

    return map_batches(id_and_text(docs), fn, "doc_id bigint, ids array<int>, n_tokens bigint, n_byte_tokens bigint, round_trip boolean", CHUNK)
