"""N-gram Jaccard join: a prefix-tree join of the word shingle sets of all documents.

1. One scan gives each document its set size and the hash of its set (documents of one hash are one
   node), and the heavy shingles: those in more than a stated share of all documents, whose number
   that share bounds.
2. Sieve: by pigeonhole two similar sets share at least so many of their first shingles in any one
   order. Prefixes in order of hash (heavy ones last) are shuffled by shingle in packed blocks; nodes
   with too few prefix shingles in common with others drop out.
3. The texts of the nodes left are read again. All their shingles are counted; a node stays if enough of
   them are shared. Ordered by count, rarest first, similar sets share a shingle of their prefixes: these
   link the nodes into candidate groups (every similar pair lies in one). A heavy shingle is a
   vertex of its own there, so its documents never meet in a task.
4. The sets of a group are dealt in blocks; each pair of blocks is one unit of work.
   A unit stores its sets in a prefix tree, walks it with all probing sets together, shares the
   overlap of a path among the sets below it and leaves a subtree as soon as the lengths that
   remain cannot reach the threshold. Linked sets leave the unit as a spanning forest.

Steps 2 and 3 know a shingle by 32 bits beside its block.
Sets are compared as 63-bit hashes of their shingles. A text without words has an empty set that is
linked with nothing; one with fewer words than a shingle is one shingle of all its words. doc_id names
a document: a component is named by its smallest doc_id and rows that repeat a doc_id are each answered.
A row without a doc_id takes no part in links; its component is that of its text, or null. Only doc_id
and text are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from centavo.llm.arrow import id_and_text, map_batches, separated, slices, text_bytes
from centavo.llm.components import components, forest
from centavo.llm.packed import RECORD, by_block, pack, records
from centavo.session import written

NGRAM, PERCENT = 5, 75
HEAVY_SHARE = 0.002  # of all documents; at most (mean set size / share) shingles are heavy
SEGMENT = 1 << 21  # shingles counted at a time when looking for heavy ones
PACKED = 1 << 20  # prefix shingles in a block of the first shuffle, about
UNIT = 1024  # sets of a group in a block

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_RATIO = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the first word of each row (one more than rows)."""
    raw, at = text_bytes(column)
    data, starts = separated(_LOWER[raw], at, 0x20)
    inside = ~_SPACE[data]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    begin = np.flatnonzero(edge == 1)
    end = np.flatnonzero(edge == -1)
    first = np.append(np.searchsorted(begin, starts), len(begin))
    if not len(begin):
        return np.zeros(0, np.uint64), first
    length = end - begin
    letters = data[inside]
    bounds = np.cumsum(length) - length
    place = np.arange(len(letters)) - np.repeat(bounds, length)
    powers = np.cumprod(np.full(int(length.max()), _RATIO, np.uint64))
    return mix(np.add.reduceat(_BYTE[letters] * powers[place], bounds) + length.astype(np.uint64)), first


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of every row as 63-bit numbers in rising order, and their bounds (one more than rows)."""
    words, first = word_hashes(column)
    counts = np.diff(first)
    factor = [np.uint64(pow(0xD1342543DE82EF95, i + 1, 1 << 64)) for i in range(n)]
    many = np.maximum(counts - n + 1, 0)
    row = np.repeat(np.arange(len(counts)), many)
    begin = np.repeat(first[:-1] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    value = np.zeros(len(begin), np.uint64)
    for i in range(n):
        value += words[begin + i] * factor[i]
    few = np.flatnonzero((counts > 0) & (counts < n))
    short = np.zeros(len(few), np.uint64)
    for i in range(n - 1):
        has = counts[few] > i
        short[has] += words[first[few[has]] + i] * factor[i]
    short += counts[few].astype(np.uint64) << np.uint64(32)
    row, value = np.concatenate([row, few]), mix(np.concatenate([value, short])) >> np.uint64(1)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[new], value[new]
    return value, np.searchsorted(row, np.arange(len(counts) + 1))


def nodes_of(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each set; 0 for an empty one."""
    size = np.diff(bounds)
    out = np.zeros(len(size), np.uint64)
    full = size > 0
    if full.any():
        out[full] = mix(np.add.reduceat(mix(value ^ _RATIO), bounds[:-1][full]) + size[full].astype(np.uint64)) | np.uint64(1)
    return out.view(np.int64)


def _counted(segment: list[np.ndarray], docs: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of a segment that reach half the share there (and three documents)."""
    token, n = np.unique(np.concatenate(segment), return_counts=True)
    keep = n >= max(3, share / 2 * docs)
    return token[keep], n[keep]


def measure(docs: DataFrame, n: int, share: float) -> DataFrame:
    """kind 0: doc_id, set size, node. kind 1: shingle, how many documents of a segment have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(kind, a, b, c):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], ["kind", "a", "b", "c"])

        def heavy(segment, held):
            token, count = _counted(segment, held, share)
            return rows(1, token.view(np.int64), count, np.zeros(len(token), np.int64))

        segment, size, held = [], 0, 0
        for batch in batches:
            for part in slices(batch):
                value, bounds = shingle_sets(part.column(1), n)
                yield rows(0, part.column(0), np.diff(bounds), nodes_of(value, bounds))
                segment.append(value)
                size, held = size + len(value), held + part.num_rows
                if size >= SEGMENT:
                    yield heavy(segment, held)
                    segment, size, held = [], 0, 0
        if segment:
            yield heavy(segment, held)

    return id_and_text(docs).mapInArrow(run, "kind int, a bigint, b bigint, c bigint")


def needed(size: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap with any set that is similar enough."""
    return -(-size * percent // 100)


def prefix_sizes(size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """How many first shingles of a set are looked at, and how many of them a similar set must share at least."""
    need = needed(size, percent)
    return np.minimum(size, size - need + 1 + size // 16), 1 + need // 16


#: Packed postings: a shingle's part within its block, and the node and size of a set that has it.
PART, OWNER = np.dtype("<u4"), np.dtype([("node", "<i8"), ("size", "<u4")])
#: The same with the whole shingle and how many nodes have it (HEAVY_COUNT: a heavy one).
FULL = np.dtype([("shingle", "<u8"), ("count", "<u4")])
HEAVY_COUNT = 0xFFFFFFFF
SHARED, HEAVY, LINK = 0, 1, 2  # kinds of packed records: by shingle, heavy, links of a finished forest


def _by_node(node: np.ndarray, blocks: int) -> np.ndarray:
    return (node.view(np.uint64) % np.uint64(blocks)).astype(np.int64)


def _postings(docs: DataFrame, heavy: np.ndarray, n: int, percent: int, blocks: int, prefix: bool) -> DataFrame:
    """Packed postings of the prefixes, or of whole sets; a node is sent once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for batch in batches:
            for part in slices(batch):
                value, bounds = shingle_sets(part.column(1), n)
                node, size = nodes_of(value, bounds), np.diff(bounds)
                _, first = np.unique(node, return_index=True)
                new = np.zeros(len(node), bool)
                new[first] = True
                new &= ~np.isin(node, seen) & (size > 0)
                seen = np.union1d(seen, node[new])
                row = np.repeat(np.arange(len(size)), size)
                value, row = value[new[row]], row[new[row]]
                if not len(value):
                    continue
                at = np.searchsorted(heavy, value)
                common = np.zeros(len(value), bool)
                common[at < len(heavy)] = heavy[at[at < len(heavy)]] == value[at < len(heavy)]
                if prefix:
                    order = np.lexsort((value, common, row))
                    value, row, common = value[order], row[order], common[order]
                    keep = np.arange(len(row)) - np.searchsorted(row, row) < prefix_sizes(size, percent)[0][row]
                    value, row, common = value[keep], row[keep], common[keep]
                owner = np.empty(len(row), OWNER)
                owner["node"], owner["size"] = node[row], size[row]
                rare = ~common
                block, inner = value % np.uint64(blocks), (value // np.uint64(blocks)).astype(PART)
                rows = list(pack(SHARED, block[rare].astype(np.int64), inner[rare], owner[rare]))
                full = np.empty(int(common.sum()), FULL)
                full["shingle"], full["count"] = value[common], HEAVY_COUNT
                rows += list(pack(HEAVY, _by_node(owner["node"][common], blocks), full, owner[common]))
                yield records(rows)

    return id_and_text(docs).mapInArrow(run, RECORD)


def _once(key: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Places of each (key, node) once, by key, then node."""
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    new = np.ones(len(order), bool)
    new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    return order[new]


def _shared_only(blocks: int):
    """Keep shingles of two nodes or more with their counts, and deal what is left by node."""

    def fn(kind, block, first, second):
        owner = np.frombuffer(second, OWNER)
        if kind == HEAVY:
            full = np.frombuffer(first, FULL)
        else:
            inner = np.frombuffer(first, PART)
            place = _once(inner, owner["node"])
            inner, owner = inner[place], owner[place]
            _, at, count = np.unique(inner, return_inverse=True, return_counts=True)
            count = count[at.ravel()]
            many = count > 1
            owner = owner[many]
            full = np.empty(len(owner), FULL)
            full["shingle"] = inner[many].astype(np.uint64) * np.uint64(blocks) + np.uint64(block)
            full["count"] = count[many]
        if len(full):
            yield from pack(SHARED, _by_node(np.ascontiguousarray(owner["node"]), blocks), full, owner)

    return fn


def _of_nodes(first: bytes, second: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Postings by node, each once; how many the node has."""
    full, owner = np.frombuffer(first, FULL), np.frombuffer(second, OWNER)
    place = _once(full["shingle"], owner["node"])
    full, owner = full[place], owner[place]
    _, at, count = np.unique(owner["node"], return_inverse=True, return_counts=True)
    return full, owner, count[at.ravel()]


def _sieved(percent: int):
    """Nodes with as many shared prefix shingles as a similar set asks for."""

    def fn(kind, block, first, second):
        _, owner, count = _of_nodes(first, second)
        keep = count >= prefix_sizes(owner["size"].astype(np.int64), percent)[1]
        node = np.unique(owner["node"][keep])
        yield (LINK, 0, node.tobytes(), node.tobytes())

    return fn


def _rare_prefix(percent: int, blocks: int):
    """Of nodes with enough shared shingles, the shared ones of the prefix, rarest first; heavy ones end as links here."""

    def fn(kind, block, first, second):
        full, owner, count = _of_nodes(first, second)
        size = owner["size"].astype(np.int64)
        keep = count >= needed(size, percent)
        full, owner, count, size = full[keep], owner[keep], count[keep], size[keep]
        order = np.lexsort((full["shingle"], full["count"], owner["node"]))
        full, node, count, size = full[order], owner["node"][order], count[order], size[order]
        # the shingles of one node alone come first in its order
        keep = np.arange(len(node)) - np.searchsorted(node, node) < size - needed(size, percent) + 1 - (size - count)
        full, node = full[keep], np.ascontiguousarray(node[keep])
        rare = full["count"] != HEAVY_COUNT
        shingle = np.ascontiguousarray(full["shingle"])
        yield from pack(SHARED, (shingle[rare] % np.uint64(blocks)).astype(np.int64), shingle[rare], node[rare])
        # shingle vertices are even, nodes odd, so they never meet
        a, b = forest(node[~rare], (shingle[~rare] << np.uint64(1)).view(np.int64))
        if len(a):
            yield (LINK, block, a.tobytes(), b.tobytes())

    return fn


def _linked(kind, block, first, second):
    """Forest of the nodes that share a shingle."""
    if kind == LINK:
        yield (LINK, 0, first, second)
        return
    key, node = np.frombuffer(first, np.uint64), np.frombuffer(second, np.int64)
    place = _once(key, node)
    key, node = key[place], node[place]
    same = np.flatnonzero(key[1:] == key[:-1])
    a, b = forest(node[same], node[same + 1])
    if len(a):
        yield (LINK, 0, a.tobytes(), b.tobytes())


def _links(packed: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(a, np.int64)), pa.array(np.frombuffer(b, np.int64))], ["a", "b"])

    return packed.mapInArrow(run, "a bigint, b bigint")


def tree_join(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (probe, stored) of similar sets; without `right`, of the pairs within `left`.

    Sets are ordered by how common a shingle is in the unit, so that similar sets share long paths.
    """
    stored = left if right is None else right
    both = left if right is None else left + right
    whole = np.concatenate(both)
    token, inverse, count = np.unique(whole, return_inverse=True, return_counts=True)
    rank = np.empty(len(token), np.int64)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(token))
    useful = int((count > 1).sum())  # shingles of one set alone come last and overlap with nothing
    ranks = rank[inverse.ravel()]
    cut = np.cumsum([0, *map(len, both)])
    own = [np.sort(ranks[b:e]).astype(">u4") for b, e in zip(cut[:-1], cut[1:], strict=True)]
    probes, paths = own[: len(left)], own if right is None else own[len(left) :]
    size = np.array([len(p) for p in probes])
    has = np.zeros((useful, len(probes)), bool)
    for i, p in enumerate(probes):
        has[p[p < useful], i] = True
    order = sorted(range(len(stored)), key=lambda i: paths[i].tobytes())
    place = np.empty(len(stored), np.int64)  # of a probe among the stored sets, when they are the same
    place[order] = np.arange(len(stored))
    length = np.array([len(paths[i]) for i in order])
    found_probe, found_stored = [], []
    todo = [(0, len(order), 0, np.arange(len(probes)), np.zeros(len(probes), np.int64))]
    while todo:
        low, high, depth, probe, overlap = todo.pop()
        if right is None:  # each pair once
            later = place[probe] > low
            probe, overlap = probe[later], overlap[later]
        if not len(probe):
            continue
        a, b = paths[order[low]], paths[order[high - 1]]
        least = min(len(a), len(b))
        differ = np.flatnonzero(a[depth:least] != b[depth:least])
        upto = depth + (int(differ[0]) if len(differ) else least - depth)
        step = a[depth:upto]
        step = step[step < useful].astype(np.int64)
        if len(step):
            shared = has[step]
            overlap = overlap + (shared[:, probe] if len(probe) < shared.shape[1] else shared).sum(0, dtype=np.int64)
        longest, shortest = int(length[low:high].max()), int(length[low:high].min())
        most = longest - (upto - overlap)  # what the longest set below can still reach
        near = (most * (100 + percent) >= percent * (size[probe] + longest)) & (percent * shortest <= 100 * size[probe])
        probe, overlap = probe[near], overlap[near]
        if not len(probe):
            continue
        while low < high and length[low] == upto:  # a set that ends here; equal sets sort together
            hit = 100 * overlap >= percent * (size[probe] + upto - overlap)
            if right is None:
                hit &= place[probe] > low
            found_probe.append(probe[hit])
            found_stored.append(np.full(int(hit.sum()), order[low]))
            low += 1
        while low < high:
            nxt = paths[order[low]][upto]
            end, far = low + 1, high
            while end < far:  # first set with another shingle here
                mid = (end + far) // 2
                end, far = (mid + 1, far) if paths[order[mid]][upto] == nxt else (end, mid)
            todo.append((low, end, upto, probe, overlap))
            low = end
    none = np.zeros(0, np.int64)
    return (np.concatenate(found_probe), np.concatenate(found_stored)) if found_probe else (none, none)


def _unit_links(units: DataFrame, percent: int) -> DataFrame:
    """Forest of the similar sets of each unit. units: grp, i, j, side, node, shingles; a unit's rows together."""

    def close(key, sides):
        left, right = sides
        nodes = [np.array([n for n, _ in s], np.int64) for s in (left, right)]
        sets = [[np.frombuffer(b, np.uint64) for _, b in s] for s in (left, right)]
        if key[1] == key[2]:
            a, b = tree_join(sets[0], None, percent) if len(left) > 1 else (np.zeros(0, np.int64),) * 2
            a, b = nodes[0][a], nodes[0][b]
        else:
            a, b = tree_join(sets[0], sets[1], percent) if left and right else (np.zeros(0, np.int64),) * 2
            a, b = nodes[0][a], nodes[1][b]
        a, b = forest(a, b)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sides = None, ([], [])
        for batch in batches:
            for grp, i, j, side, node, shingles in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held != (grp, i, j):
                    if held is not None:
                        yield close(held, sides)
                    held, sides = (grp, i, j), ([], [])
                sides[side].append((node, shingles))
        if held is not None:
            yield close(held, sides)

    return units.mapInArrow(run, "a bigint, b bigint")


def _classes(docs: DataFrame, n: int = NGRAM, percent: int = PERCENT, share: float = HEAVY_SHARE, unit: int = UNIT) -> tuple[DataFrame, DataFrame]:
    """doc_id, n_shingles, node of every row; of (a node), component_id and first (the node that names it) of every node."""
    spark = docs.sparkSession
    measured = written(measure(docs, n, share), "shingle-measures")
    sets = measured.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"), F.col("c").alias("node"))
    total = sets.agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    common = measured.where("kind = 1").groupBy("a").agg(F.sum("b").alias("n")).where(F.col("n") >= share * total[0])
    heavy = np.sort(np.array([r.a for r in common.select("a").collect()], np.int64).view(np.uint64))
    width = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    blocks = max(width, int(total[1]) // 3 // PACKED + 1)

    named = sets.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    named = written(named, "shingle-nodes")
    shared = by_block(_postings(docs, heavy, n, percent, blocks, True), blocks, _shared_only(blocks))
    sieved = _links(by_block(shared, blocks, _sieved(percent))).select(F.col("a").alias("node"))
    wanted = named.join(sieved, "node")
    # one text per node is read again; a repeated doc_id may have other texts, which only add nodes
    texts = written(id_and_text(docs).join(wanted.select("doc_id").distinct(), "doc_id", "left_semi"), "shingle-texts")

    shared = by_block(_postings(texts, heavy, n, percent, blocks, False), blocks, _shared_only(blocks))
    prefixes = by_block(shared, blocks, _rare_prefix(percent, blocks))
    groups = components(_links(by_block(prefixes, blocks, _linked)))

    # shingle vertices are even
    members = groups.where("id % 2 <> 0").select(F.col("id").alias("node"), F.col("label").alias("grp"))
    counts = members.groupBy("grp").agg(F.count("*").alias("members")).where("members > 1")
    chosen = members.join(counts, "grp").join(named, "node").withColumn("blocks", F.ceil(F.col("members") / unit).cast("int"))
    chosen = chosen.select("doc_id", F.col("node").alias("want"), "grp", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("own"))
    again = texts.join(written(chosen, "shingle-candidates"), "doc_id")

    def sets_again(batch):
        value, bounds = shingle_sets(batch.column(1), n)
        node = nodes_of(value, bounds)
        rows = [value[b:e].tobytes() for b, e in zip(bounds[:-1], bounds[1:], strict=True)]
        keep = node == np.asarray(batch.column(2))  # a repeated doc_id may have other texts
        part = batch.filter(keep)
        yield {"grp": part.column(3), "blocks": part.column(4), "own": part.column(5), "node": node[keep], "shingles": [r for r, k in zip(rows, keep, strict=True) if k]}

    dealt = map_batches(again, sets_again, "grp bigint, blocks int, own int, node bigint, shingles binary")
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = dealt.select(
        "grp",
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).cast("int").alias("side"),
        "node",
        "shingles",
    )
    units = units.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j")
    linked = components(_unit_links(units, percent))

    least = named.join(linked.select(F.col("id").alias("node"), "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = least.groupBy("label").agg(F.min(F.struct("doc_id", "node")).alias("first"))
    answer = least.join(smallest, "label").select(F.col("node").alias("of"), F.col("first.doc_id").alias("component_id"), F.col("first.node").alias("first"))
    return sets, written(answer, "shingle-classes")


def jaccard_components(docs: DataFrame, n: int = NGRAM, **options) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    sets, answer = _classes(docs, n, **options)
    told = sets.where("n_shingles > 0").join(answer, F.col("node") == F.col("of"), "left").select("doc_id", "n_shingles", "component_id")
    return told.unionByName(sets.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_smallest(docs: DataFrame, n: int = NGRAM, **options) -> DataFrame:
    """One row of each component: of its texts with the smallest doc_id one set of shingles, and of the rows
    with that doc_id and set the one whose text comes first by hash.

    A repeated doc_id with texts that are not linked keeps one of each. Rows without a doc_id or without words are all kept.
    """
    _, answer = _classes(docs, n, **options)
    firsts = answer.where("of = first").select(F.col("component_id").alias("_first_id"), F.col("of").alias("_first_node"))

    @arrow_udf("bigint")
    def node(texts: pa.Array) -> pa.Array:
        out = [nodes_of(*shingle_sets(part.column(0), n)) for part in slices(pa.RecordBatch.from_arrays([texts], ["text"]))]
        return pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("bigint").alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    rows = rows.select("row", "id", "mark", "text", node("text").alias("node"))
    apart = F.col("id").isNull() | (F.col("node") == 0)
    linked = rows.where(~apart).join(firsts, (F.col("id") == F.col("_first_id")) & (F.col("node") == F.col("_first_node")), "left_semi")
    order = Window.partitionBy("id", "node").orderBy("mark", "text")
    kept = linked.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").select("row.*")
    return kept.unionByName(rows.where(apart).select("row.*"))
