"""Toxicity: Levenshtein automata intersected with a lexicon trie, and scores from the context of each find.

The lexicon is a trie. Walking it with an error count (a letter matched, replaced, inserted or
left out) gives a nondeterministic automaton of all words within the allowed distance of a term;
subset construction turns it into one automaton that reads all texts in one pass. Terms of up to
4 letters must match, up to 7 letters may have one error, longer ones two. Digits count as the
letters they look like. A word that ends in an accepting state is a find.

Terms of any language are learned too (`learn_terms`): words that labelled texts tie to toxic ones.
They are added to the trie and must match as written, but for capitals and digits: words of a family
differ by an ending of a letter or two, and so do clean words from them. The automaton reads the
letters of all terms as UTF-8, one character a step.

Each find gets a context score: quotation marks around it and words of reporting near it lower the
score, words of address raise it. `fit` learns from labelled rows how toxic the texts with each
written form are, and a logistic model over the finds of a text; `score` applies both.

Empty and null texts have no finds and get the base score. Label rows without a toxic value or
without a document are not used. Rows are scored one by one; columns other than doc_id and text
are never looked at.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from centavo.llm.arrow import id_and_text, map_batches, separated, text_bytes
from centavo.llm.automaton import Automaton, minimise
from centavo.session import written

LEXICON = (
    "bastard bitch brainless clown coward cretin degenerate despicable dimwit disgusting dumb filth fool freak "
    "garbage idiot imbecile jerk loser lowlife maggot moron parasite pathetic retard scum stupid trash vermin worthless"
).split()
LOOKS_LIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
OTHER, CONTINUED, BREAK = 26, 27, 28  # classes beside the letters
OUTSIDE = 0xFF
LEAST_TOXIC = 3  # labelled texts that a learned term is in, at least
LEAST_Z = 5.0  # standard deviations of toxic texts with the word over the mean of all texts
BETWEEN_WORDS = r"[\x00-\x7F&&[^0-9A-Za-z]]+"  # the bytes of class BREAK
REPORTING = frozenset("said says saying called calls word words term terms quote quoted wrote writes slur insult insults".split())
ADDRESS = frozenset("you your youre u ur yourself".split())
QUOTES = re.compile(r"[\"“”„«»‘’]")
NEAR = 80  # bytes of context on each side

PRIOR_ROWS = 4.0  # a form counts as if it had been seen in so many rows before
PRIOR_RATE = (0.9, 0.65, 0.55)  # of them toxic, by distance
PRIOR_PRECISION = (0.01, 25.0, 25.0)  # of the logistic weights
STEP = 0.25  # of the features' buckets
MOST = 12.0  # largest value of a feature


def allowed_errors(term: str) -> int:
    return 0 if len(term) <= 4 else 1 if len(term) <= 7 else 2


def _byte_classes(more: dict[int, int]) -> np.ndarray:
    """The class of each byte; `more` has those of bytes of letters outside a to z."""
    of = np.full(256, BREAK, np.uint8)
    for b in range(26):
        of[ord("a") + b] = of[ord("A") + b] = b
    for d in "0123456789":
        of[ord(d)] = ord(LOOKS_LIKE[d]) - ord("a") if d in LOOKS_LIKE else OTHER
    of[0x80:0xC0] = CONTINUED
    of[0xC0:0xF8] = OTHER
    for byte, c in more.items():
        of[byte] = c
    return of


@dataclass(frozen=True)
class Lexicon:
    automaton: Automaton
    accepts: list[tuple[str, int] | None]  # of each label: nearest term and its distance


def compile_lexicon(terms: list[str], exact: tuple[str, ...] = ()) -> Lexicon:
    """`exact` terms allow no errors. Terms are in small letters."""
    allowed = dict.fromkeys(exact, 0) | {t: allowed_errors(t) for t in terms}
    children: list[dict[str, int]] = [{}]
    ends: dict[int, str] = {}
    most: list[int] = [0]
    for term in sorted(allowed):
        k, node = allowed[term], 0
        most[0] = max(most[0], k)
        for key in term:
            if key not in children[node]:
                children[node][key] = len(children)
                children.append({})
                most.append(0)
            node = children[node][key]
            most[node] = max(most[node], k)
        ends[node] = term

    def closed(pairs: dict[int, int]) -> frozenset[tuple[int, int]]:
        """With letters left out; only the fewest errors of a node are kept."""
        todo = list(pairs.items())
        while todo:
            node, e = todo.pop()
            if pairs[node] < e:
                continue
            for child in children[node].values():
                if e < most[child] and pairs.get(child, 99) > e + 1:
                    pairs[child] = e + 1
                    todo.append((child, e + 1))
        return frozenset(pairs.items())

    def step(state: frozenset[tuple[int, int]], c: str) -> frozenset[tuple[int, int]]:
        out: dict[int, int] = {}
        for node, e in state:
            if e < most[node] and out.get(node, 99) > e + 1:
                out[node] = e + 1
            for key, child in children[node].items():
                cost = e + (key != c)
                if cost <= most[child] and out.get(child, 99) > cost:
                    out[child] = cost
        return closed(out)

    plain, rest = "abcdefghijklmnopqrstuvwxyz", ""  # `rest`: any other letter
    far = sorted({c for t in allowed for c in t} - set(plain))
    begin = closed({0: 0})
    states, order, after = {begin: 0}, [begin], []
    for state in order:
        row, used = {}, {key for node, _ in state for key in children[node]}
        for c in (rest, *plain, *far):
            to = step(state, c) if c == rest or c in used else order[row[rest]]
            if to not in states:
                states[to] = len(order)
                order.append(to)
            row[c] = states[to]
        after.append(row)
    moves, shown = _over_bytes(after, plain, rest, far)
    labels: dict[tuple[str, int] | None, int] = {None: 0}
    of = []
    for state in order:
        fits = [(e, ends[n]) for n, e in state if n in ends and e <= allowed[ends[n]]]
        best = (min(fits)[1], min(fits)[0]) if fits else None
        of.append(labels.setdefault(best, len(labels)))
    block, small, label = minimise(np.array(moves), np.array(of)[shown])
    return Lexicon(Automaton(small.astype(np.int32), _byte_classes(_far_bytes(far)), label, int(block[0])), list(labels))


def _written(c: str) -> list[bytes]:
    """A letter's bytes, small and capital."""
    return [x.encode() for x in {c, c.upper()} if len(x) == 1]


def _far_bytes(far: list[str]) -> dict[int, int]:
    """Classes of the bytes of letters outside a to z."""
    return {byte: BREAK + 1 + i for i, byte in enumerate(sorted({b for c in far for w in _written(c) for b in w}))}


def _over_bytes(after: list[dict[str, int]], plain: str, rest: str, far: list[str]) -> tuple[list[list[int]], list[int]]:
    """Moves by byte classes from moves by letters, and the state whose label each state has.

    Beside each state there is one for each beginning of a longer letter read in it; it stands for
    `rest` until the letter is whole.
    """
    letters = {w: c for c in far for w in _written(c)}
    begun = sorted({w[:i] for w in letters for i in range(1, len(w))})
    more, size = _far_bytes(far), len(after)
    inside = {w: size * (i + 1) for i, w in enumerate(begun)}

    def lead(s: int, byte: int) -> int:
        return inside[bytes([byte])] + s if byte >= 0xC0 else s

    moves = [[*(row[c] for c in plain), row[rest], s, 0, *(lead(s, b) for b in more)] for s, row in enumerate(after)]
    shown = list(range(size))
    for w in begun:
        for row in after:
            s = row[rest]
            to = {b: row[letters[w + bytes([b])]] if w + bytes([b]) in letters else None for b in more}
            longer = {b: inside[w + bytes([b])] + len(moves) % size for b in more if w + bytes([b]) in inside}
            ends = [lead(s, b) if to[b] is None else to[b] for b in more]
            moves.append([*moves[s][:CONTINUED], s, 0, *(longer.get(b, e) for b, e in zip(more, ends, strict=True))])
            shown.append(s)
    return moves, shown


def context_score(before: str, after: str) -> float:
    """1 for a plain find; less where it looks quoted or reported, a little more where somebody is addressed."""
    score = 1.0
    if QUOTES.search(before) and QUOTES.search(after):
        score -= 0.5
    words = re.findall(r"[^\W\d_]+", before.lower())[-6:]
    if REPORTING & set(words):
        score -= 0.25
    if ADDRESS & set(words[-3:]) | ADDRESS & set(re.findall(r"[^\W\d_]+", after.lower())[:3]):
        score += 0.15
    return score


def _finds(lexicon: Lexicon, column) -> list[list[tuple[str, str, int, float]]]:
    """Per row: (written form, term, distance, context score) of each find."""
    raw, at = text_bytes(column)
    data, starts = separated(raw, at, OUTSIDE)
    label = lexicon.automaton.label[lexicon.automaton.scan(data)]
    kind = lexicon.automaton.byte_class[data]
    gap = np.flatnonzero(kind == BREAK)  # the buffer ends with one
    last = np.flatnonzero((label[:-1] > 0) & (kind[1:] == BREAK) & (kind[:-1] != BREAK))
    first = gap[np.searchsorted(gap, last) - 1] + 1
    row = np.searchsorted(starts, last, side="right") - 1
    out: list[list[tuple[str, str, int, float]]] = [[] for _ in range(len(starts))]
    for r, b, e, k in zip(row.tolist(), first.tolist(), (last + 1).tolist(), label[last].tolist(), strict=True):
        low, high = int(starts[r]), int(starts[r] + at[r + 1] - at[r])
        before = data[max(low, b - NEAR) : b].tobytes().decode(errors="ignore")
        after = data[e : min(high, e + NEAR)].tobytes().decode(errors="ignore")
        term, distance = lexicon.accepts[k]
        out[r].append((data[b:e].tobytes().decode(errors="ignore").lower(), term, distance, context_score(before, after)))
    return out


def find_terms(docs: DataFrame, terms: list[str] = LEXICON, exact: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and `finds`: array of (form, term, distance, context)."""
    lexicon = compile_lexicon(terms, exact)

    def fn(batch):
        finds = [[dict(zip(("form", "term", "distance", "context"), f, strict=True)) for f in row] for row in _finds(lexicon, batch.column(1))]
        yield {"doc_id": batch.column(0), "finds": finds}

    return map_batches(id_and_text(docs), fn, "doc_id bigint, finds array<struct<form string, term string, distance int, context double>>")


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from; a missing id counts as an empty one."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


@dataclass(frozen=True)
class Model:
    terms: tuple[str, ...]
    base: float  # log-odds of a text without finds
    forms: dict[str, float]  # log-odds that a form adds
    weights: tuple[float, float, float]
    learned: tuple[str, ...] = ()

    def lexicon(self) -> Lexicon:
        return compile_lexicon(list(self.terms), self.learned)

    def features(self, finds: list[tuple[str, str, int, float]]) -> tuple[float, float]:
        """The strongest find, and what the others add."""
        worth = [max(0.0, self.forms.get(f, self.unseen(d))) * c for f, _, d, c in finds]
        top = max(worth, default=0.0)
        return min(MOST, top), min(MOST, sum(worth) - top)

    def unseen(self, distance: int) -> float:
        return _logit(PRIOR_RATE[distance]) - self.base

    def buckets(self, finds: list[tuple[str, str, int, float]]) -> tuple[float, float]:
        top, rest = self.features(finds)
        return round(top / STEP) * STEP, round(rest / STEP) * STEP

    def score(self, finds: list[tuple[str, str, int, float]]) -> float:
        top, rest = self.buckets(finds)
        a, b, c = self.weights
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * top + c * rest))))


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def learn_terms(texts: DataFrame, known: list[str]) -> tuple[str, ...]:
    """Words that toxic texts hold far more often than others; `texts`: text, toxic.

    A word counts once a text. It is a term if it is in LEAST_TOXIC toxic texts or more, most texts
    with it are toxic, and they are LEAST_Z deviations over what the share of toxic texts gives.
    Only such words reach the driver. Words with digits are found through the letters they look like.
    """
    total = texts.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    if not 0 < total.toxic < total.n:
        return ()
    rate = total.toxic / total.n
    over = F.col("toxic") - F.col("n") * rate
    words = (
        texts.select("toxic", F.explode(F.array_distinct(F.split(F.lower("text"), BETWEEN_WORDS))).alias("word"))
        .where((F.col("word") != "") & ~F.col("word").rlike("[0-9]"))
        .groupBy("word")
        .agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"))
        .where((F.col("toxic") >= LEAST_TOXIC) & (F.col("toxic") * 2 > F.col("n")))
        .where(over >= LEAST_Z * F.sqrt(F.col("n") * (rate * (1 - rate))))
    )
    return tuple(sorted({r.word for r in words.select("word").collect()} - set(known)))


def fit(docs: DataFrame, labels: DataFrame, terms: list[str] = LEXICON) -> Model:
    """Learn from every labelled row that is not held out: terms first, then what each is worth.

    What reaches the driver: the learned terms, one row for each written form within the allowed
    distance of a term, and one for each bucket of the two features. The terms and STEP bound both.
    The texts meet their labels by a sort merge at every size, so the shuffle follows the input.
    """
    told = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    texts = id_and_text(docs).where(~held_out(F.col("doc_id"))).join(told.hint("merge"), "doc_id").select("text", "toxic")
    learned = learn_terms(texts, terms)
    finds = written(find_terms(docs, terms, learned), "toxicity-finds")
    rows = finds.where(~held_out(F.col("doc_id"))).join(told, "doc_id").select("toxic", "finds")
    plain = rows.where(F.size("finds") == 0).agg(F.count("*"), F.sum("toxic")).first()
    base = _logit(((plain[1] or 0) + 1) / (plain[0] + 10))
    seen = (
        rows.select("toxic", F.explode(F.array_distinct(F.transform("finds", lambda f: F.struct(f["form"], f["distance"])))).alias("f"))
        .groupBy("f.form", "f.distance")
        .agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"))
        .collect()
    )
    forms = {
        r.form: _logit((r.toxic + PRIOR_ROWS * PRIOR_RATE[r.distance]) / (r.n + PRIOR_ROWS)) - base for r in seen
    }
    start = Model(tuple(terms), base, forms, (base, 1.0, 0.5), learned)
    table = _bucketed(rows.where(F.size("finds") > 0), start).groupBy("top", "rest").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).collect()
    cells = [(0.0, 0.0, plain[0], plain[1] or 0), *((r.top, r.rest, r.n, r.toxic) for r in table)]
    return replace(start, weights=_logistic(cells, np.array([base, 1.0, 0.5])))


def _bucketed(rows: DataFrame, model: Model) -> DataFrame:
    """toxic, and `Model.features` in buckets."""

    def fn(batch):
        found = [[(f["form"], f["term"], f["distance"], f["context"]) for f in finds] for finds in batch.column(1).to_pylist()]
        both = [model.buckets(f) for f in found]
        yield {"toxic": batch.column(0), "top": [b[0] for b in both], "rest": [b[1] for b in both]}

    return map_batches(rows.select("toxic", "finds"), fn, "toxic int, top double, rest double")


def _logistic(cells: list[tuple[float, float, int, int]], prior: np.ndarray) -> tuple[float, float, float]:
    """Newton steps for grouped rows, with a normal prior on the weights; a step that makes the fit worse is halved."""
    x = np.array([[1.0, t, r] for t, r, _, _ in cells])
    n, y = np.array([c[2] for c in cells], float), np.array([c[3] for c in cells], float)
    keep, w = np.diag(PRIOR_PRECISION), prior.copy()

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(n @ np.logaddexp(0, z) - y @ z + (w - prior) @ keep @ (w - prior) / 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - n * p) - keep @ (w - prior)
        change = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + keep, slope)
        while np.abs(change).max() >= 1e-9 and loss(w + change) > loss(w):
            change = change / 2
        w = w + change
        if np.abs(change).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, and how many finds there were."""
    lexicon = model.lexicon()

    def fn(batch):
        finds = _finds(lexicon, batch.column(1))
        yield {"doc_id": batch.column(0), "score": [model.score(f) for f in finds], "n_finds": [len(f) for f in finds]}

    return map_batches(id_and_text(docs), fn, "doc_id bigint, score double, n_finds bigint")


def drop_toxic(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents with a score under `least`; their columns as given."""
    lexicon = model.lexicon()

    def fn(batch):
        column = batch.column(batch.schema.names.index("text"))
        finds = _finds(lexicon, column.fill_null("") if column.null_count else column)
        clean = batch.filter(np.array([model.score(f) < least for f in finds], bool))
        yield dict(zip(clean.schema.names, clean.columns, strict=True))

    return map_batches(docs, fn, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
