"""Removal of repeated byte strings by hash-compared suffix sorting.

A 200-byte string is repeated if it also starts anywhere else in the corpus; every byte that a
repeated string covers is removed. The suffixes that could be equal are brought together thus:

1. The least hash among the 120-byte strings within a window of 200 bytes, its anchor, depends on the
   window alone, so equal windows have equal anchors. Neighbouring windows mostly share theirs: they
   form runs, and only (anchor, hash of the run's bytes, place) of each run is shuffled, packed.
2. Runs with equal bytes are repeated as a whole. A run that shares only its anchor with others is sent on
   with its bytes, as is one of each set of repeated runs beside it.
3. Windows with one anchor are suffixes sorted by mergesort: two are compared by the length of their common
   extension, found by binary search over prefix polynomial hashes, and then by the byte after it.
   Neighbours in the order with 200 bytes in common, checked byte by byte, are repeated.

An anchor with very many different runs is split: its windows are dealt by two hashes of their
bytes instead, and equal pairs of hashes count as equal. Repeats seen within one task are settled
there and stand for themselves once. Exact copies of a text are one node (64-bit hash of the text); they are
repeated as a whole if long enough.

Null texts are empty; texts shorter than the string have nothing to remove; repeated rows are copies. Only doc_id and
text are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centavo.llm.arrow import ragged, slices, text_bytes
from centavo.llm.jaccard import mix
from centavo.llm.packed import RECORD, by_block, pack, records
from centavo.session import written

LENGTH, GRAM = 200, 120
LONGEST_RUN = 4 * (LENGTH - GRAM + 1)  # windows; in repetitive text an anchor lasts on and on
MANY = 512  # different runs of an anchor, beyond which its windows are dealt singly
MANY_HERE = 32  # the same within one chunk of texts
BYTES_PER_BLOCK = 32 << 20
SORTED_AT_ONCE = 1 << 21  # bytes whose suffixes are sorted together, about

BASE = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(int(BASE), -1, 1 << 64))
SECOND = np.uint64(0xD1342543DE82EF95)
SECOND_BACK = np.uint64(pow(int(SECOND), -1, 1 << 64))

RUN, WINDOW, SPAN = 0, 1, 2  # kinds of packed records
REPEATED, CROWDED, PERIODIC = 1, 2, 4  # flags of a run: its bytes, its anchor's runs or its anchor's places are known to be many
KEY = np.dtype([("anchor", "<u8"), ("bytes", "<u8")])
PLACE = np.dtype([("node", "<i8"), ("begin", "<i4"), ("count", "<i2"), ("flag", "<i2")])
SORT, DEAL = 1, 2  # what is to be done with a run's windows
TASK = np.dtype([("anchor", "<u8"), ("begin", "<i4"), ("count", "<i2"), ("what", "<i2")])
RANGE = np.dtype([("node", "<i8"), ("begin", "<i4"), ("end", "<i4")])


class Prefix:
    """Prefix polynomial hashes of a buffer: hash of any range in constant time."""

    def __init__(self, data: np.ndarray, base: np.uint64 = BASE, back: np.uint64 = BACK) -> None:
        n = len(data)
        power = np.cumprod(np.full(n, base))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, out=self.sums[1:])
        self.back = np.cumprod(np.full(n + 1, back))

    def of(self, begin: np.ndarray, length) -> np.ndarray:
        return (self.sums[begin + length] - self.sums[begin]) * self.back[begin]


def anchors(grams: np.ndarray, n: int) -> np.ndarray:
    """The least gram hash within the window at each place, as if the buffer were one text."""
    wide = LENGTH - GRAM + 1
    padded = np.concatenate([grams, np.full(-len(grams) % wide, ~np.uint64(0))]).reshape(-1, wide)
    ahead = np.minimum.accumulate(padded, 1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    windows = n - LENGTH + 1
    return np.minimum(behind[:windows], ahead[wide - 1 : wide - 1 + windows])


def _periodic(grams: np.ndarray, anchor: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Runs whose anchor is in more than one place: only these can hold the same window twice."""
    marked = np.zeros(1 << 20, bool)
    marked[anchor >> np.uint64(44)] = True
    spot = np.flatnonzero(marked[grams >> np.uint64(44)])
    known = np.unique(anchor)
    which = np.minimum(np.searchsorted(known, grams[spot]), len(known) - 1)
    real = known[which] == grams[spot]
    step = len(grams) + 1
    places = np.sort(which[real] * step + spot[real])
    own = np.searchsorted(known, anchor) * step
    return np.searchsorted(places, own + end) - np.searchsorted(places, own + begin) > 1


def _runs(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, begin in the buffer, number of windows, anchor, byte hash and flag of every run."""
    n = len(data)
    if n < LENGTH:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.int16))
    prefix = Prefix(data)
    grams = mix(prefix.of(np.arange(n - GRAM + 1), GRAM))
    least = anchors(grams, n)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    whole = row[: len(least)] == row[LENGTH - 1 :]
    edge = np.ones(len(least) + 1, bool)
    edge[1:-1] = (least[1:] != least[:-1]) | (row[1 : len(least)] != row[: len(least) - 1]) | (whole[1:] != whole[:-1])
    begin = np.flatnonzero(edge[:-1])
    end = np.append(begin[1:], len(least))
    begin, end = begin[whole[begin]], end[whole[begin]]
    parts = -(-(end - begin) // LONGEST_RUN)
    cut = ragged(np.zeros(len(parts), np.int64), parts) * LONGEST_RUN
    begin, end = np.repeat(begin, parts) + cut, np.repeat(end, parts)
    count = np.minimum(end - begin, LONGEST_RUN)
    anchor = least[begin]
    flag = np.where(_periodic(grams, anchor, begin, begin + count + LENGTH - GRAM), PERIODIC, 0) if len(begin) else np.zeros(0)
    return row[begin], begin, count, anchor, mix(prefix.of(begin, count + LENGTH - 1) + count.astype(np.uint64)), flag.astype(np.int16)


def _hash(texts: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return texts.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("node"))


def _by_node(node: np.ndarray, blocks: int) -> np.ndarray:
    return (node.view(np.uint64) % np.uint64(blocks)).astype(np.int64)


def _find_runs(docs: DataFrame, blocks: int) -> DataFrame:
    """Runs by anchor; what a chunk of texts settles alone goes to the nodes at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for batch in batches:
            for part in slices(batch):
                node = np.asarray(part.column(1))
                _, first = np.unique(node, return_index=True)
                new = np.zeros(len(node), bool)
                new[first] = True
                new &= ~np.isin(node, seen)
                seen = np.union1d(seen, node[new])
                part, node = part.filter(pa.array(new)), node[new]
                data, at = text_bytes(part.column(0))
                row, begin, count, anchor, content, flag = _runs(data, at)
                if not len(row):
                    continue
                key = np.empty(len(row), KEY)
                key["anchor"], key["bytes"] = anchor, content
                place = np.empty(len(row), PLACE)
                place["node"], place["begin"], place["count"], place["flag"] = node[row], begin - at[row], count, flag
                order = np.lexsort((content, anchor))
                key, place = key[order], place[order]
                fresh = np.ones(len(key), bool)
                fresh[1:] = key[1:] != key[:-1]
                times = np.diff(np.append(np.flatnonzero(fresh), len(key)))
                twice = np.repeat(times > 1, times)
                rows = []
                if twice.any():
                    rows += _settled(place[twice], blocks)
                key, place = key[fresh], place[fresh]
                place["flag"] |= np.where(times > 1, REPEATED, 0).astype(np.int16)
                _, group, crowd = np.unique(key["anchor"], return_inverse=True, return_counts=True)
                crowded = crowd[group.ravel()] > MANY_HERE
                if crowded.any():
                    lead = np.ones(len(key), bool)  # goes by anchor, to tell the other tasks
                    lead[1:] = key["anchor"][1:] != key["anchor"][:-1]
                    rest = crowded & ~lead
                    rows += _due(key[rest]["anchor"], place[rest], np.full(int(rest.sum()), DEAL), blocks)
                    place["flag"] |= np.where(crowded, CROWDED, 0).astype(np.int16)
                    keep = ~crowded | lead
                    key, place = key[keep], place[keep]
                rows += list(pack(RUN, (key["anchor"] % np.uint64(blocks)).astype(np.int64), key, place))
                yield records(rows)

    return docs.select("text", "node").mapInArrow(run, RECORD)


def _settled(place: np.ndarray, blocks: int) -> list[tuple]:
    """Runs that are repeated as a whole, as ranges of bytes by node."""
    out = np.empty(len(place), RANGE)
    out["node"], out["begin"], out["end"] = place["node"], place["begin"], place["begin"] + place["count"] + LENGTH - 1
    return list(pack(SPAN, _by_node(np.ascontiguousarray(place["node"]), blocks), out, np.zeros(len(out), "V1")))


def _due(anchor: np.ndarray, place: np.ndarray, what: np.ndarray, blocks: int) -> list[tuple]:
    """Runs whose windows are to be compared, by node."""
    task = np.empty(len(place), TASK)
    task["anchor"], task["begin"], task["count"], task["what"] = anchor, place["begin"], place["count"], what
    node = np.ascontiguousarray(place["node"])
    return list(pack(WINDOW, _by_node(node, blocks), task, node))


def _judge_runs(blocks: int):
    def fn(kind, block, first, second):
        if kind != RUN:
            yield (kind, block, first, second)
            return
        key, place = np.frombuffer(first, KEY), np.frombuffer(second, PLACE).copy()
        order = np.lexsort((key["bytes"], key["anchor"]))
        key, place = key[order], place[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        of = np.cumsum(fresh) - 1
        times = np.bincount(of)
        again = np.zeros(len(times), bool)
        np.logical_or.at(again, of, (place["flag"] & REPEATED) > 0)
        told = np.zeros(len(times), bool)
        np.logical_or.at(told, of, (place["flag"] & CROWDED) > 0)
        repeated = ((times > 1) | again)[of]
        if repeated.any():
            yield from _settled(place[repeated], blocks)
        # of equal runs one stands for all where others share the anchor
        key, place, repeated = key[fresh], place[fresh], repeated[fresh]
        _, group, crowd = np.unique(key["anchor"], return_inverse=True, return_counts=True)
        group = group.ravel()
        crowded = crowd > MANY
        np.logical_or.at(crowded, group, told)
        open_ = np.zeros(len(crowd), bool)
        np.logical_or.at(open_, group, ~repeated)
        due = ((crowd > 1) & open_ | crowded)[group] | ((place["flag"] & PERIODIC) > 0) & ~repeated
        if due.any():
            yield from _due(key["anchor"][due], place[due], np.where(crowded[group[due]], DEAL, SORT), blocks)

    return fn


def _per_node(frame: DataFrame, kind: int, dtype: np.dtype, schema: str, blocks: int, gather) -> DataFrame:
    """One row for each node: all of its records of a kind, as `gather` arranges them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first, second = None, [], []

        def close():
            node, rows = gather(np.frombuffer(b"".join(first), dtype), b"".join(second))
            order = np.argsort(node, kind="stable")
            node, rows = node[order], rows[order]
            cut = np.append(np.flatnonzero(np.append(True, node[1:] != node[:-1])), len(node)) if len(node) else np.zeros(1, np.int64)
            blobs = [rows[b:e].tobytes() for b, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(node[cut[:-1]]), pa.array(blobs, pa.binary())], ["node", "blob"])

        for batch in batches:
            for block, a, b in zip(*[c.to_pylist() for c in batch.columns[1:]], strict=True):
                if held is not None and held != block:
                    yield close()
                    first, second = [], []
                held = block
                first.append(a)
                second.append(b)
        if held is not None:
            yield close()

    own = frame.where(F.col("kind") == kind)
    return own.repartition(blocks, "block").sortWithinPartitions("block").mapInArrow(run, schema)


def _merged(node: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Union of ranges of bytes, within each node."""
    order = np.lexsort((begin, node))
    node, begin, end = node[order], begin[order].astype(np.int64), end[order].astype(np.int64)
    if not len(node):
        return np.zeros(0, RANGE)
    fresh = np.append(True, node[1:] != node[:-1])
    lift = np.cumsum(fresh) * (int(end.max()) + 2)  # so that one running maximum serves all nodes
    reach = np.maximum.accumulate(end + lift)
    start = np.append(True, fresh[1:] | (begin[1:] + lift[1:] > reach[:-1]))
    at = np.flatnonzero(start)
    out = np.empty(len(at), RANGE)
    out["node"], out["begin"] = node[at], begin[at]
    out["end"] = (reach - lift)[np.append(at[1:], len(node)) - 1]
    return out


def _send_windows(texts: DataFrame, blocks: int) -> DataFrame:
    """Bytes of the runs to sort, by anchor; hashes of the windows to deal, by hash. texts: text, node, blob."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, at = text_bytes(part.column(0))
                node, blobs = np.asarray(part.column(1)), part.column(2).to_pylist()
                tasks = np.concatenate([np.frombuffer(b, TASK) for b in blobs]) if blobs else np.zeros(0, TASK)
                row = np.repeat(np.arange(len(blobs)), [len(b) // TASK.itemsize for b in blobs])
                begin = at[row] + tasks["begin"]
                rows = []
                sort = tasks["what"] == SORT
                if sort.any():
                    place = np.empty(int(sort.sum()), PLACE)
                    place["node"], place["begin"], place["count"], place["flag"] = node[row[sort]], tasks["begin"][sort], tasks["count"][sort], 0
                    anchor = tasks["anchor"][sort]
                    block = (anchor % np.uint64(blocks)).astype(np.int64)
                    order = np.argsort(block, kind="stable")
                    size = (place["count"].astype(np.int64) + LENGTH - 1)[order]
                    whole = data[ragged(begin[sort][order], size)].tobytes()
                    cut = np.append(0, np.cumsum(size))
                    block, head = block[order], np.empty(len(order), [("anchor", "<u8"), ("place", PLACE)])
                    head["anchor"], head["place"] = anchor[order], place[order]
                    edge = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block))
                    for b, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                        rows.append((RUN, int(block[b]), head[b:e].tobytes(), whole[cut[b] : cut[e]]))
                if not sort.all():
                    count = tasks["count"][~sort].astype(np.int64)
                    first = ragged(begin[~sort], count)
                    own = np.repeat(row[~sort], count)
                    key = np.empty(len(first), KEY)
                    key["anchor"] = mix(Prefix(data).of(first, LENGTH))
                    key["bytes"] = mix(Prefix(data, SECOND, SECOND_BACK).of(first, LENGTH))
                    place = np.empty(len(first), PLACE)
                    place["node"], place["begin"], place["count"], place["flag"] = node[own], first - at[own], 1, 0
                    order = np.lexsort((key["bytes"], key["anchor"]))
                    key, place = key[order], place[order]
                    fresh = np.append(True, key[1:] != key[:-1])
                    times = np.diff(np.append(np.flatnonzero(fresh), len(key)))
                    twice = np.repeat(times > 1, times)
                    if twice.any():
                        rows += _settled(place[twice], blocks)
                    key, place = key[fresh], place[fresh]
                    place["flag"] = np.where(times > 1, REPEATED, 0)
                    rows += list(pack(WINDOW, (key["anchor"] % np.uint64(blocks)).astype(np.int64), key, place))
                yield records(rows)

    return texts.mapInArrow(run, RECORD)


def common_extension(prefix: Prefix, a: np.ndarray, b: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Length of the common beginning of the suffixes at a and b, up to `most`, by binary search over hashes."""
    low, high = np.zeros(len(a), np.int64), np.full(len(a), most)
    while (low < high).any():
        mid = (low + high + 1) >> 1
        same = prefix.of(a, mid) == prefix.of(b, mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def before(prefix: Prefix, data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the suffix at a sorts before the one at b; equal for LENGTH bytes is not before."""
    n = common_extension(prefix, a, b)
    differ = n < LENGTH
    at = np.where(differ, n, 0)
    return differ & (data[a + at] < data[b + at])


def suffix_order(prefix: Prefix, data: np.ndarray, group: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A stable mergesort of the suffixes at `place` by their LENGTH bytes, within each group (groups lie together)."""
    n = len(place)
    order = np.arange(n)
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(first, n))
    begin, total = np.repeat(first, size), np.repeat(size, size)
    inner = np.arange(n) - begin
    width = 1
    while len(size) and width < size.max():
        # every element finds its place in the block beside its own by binary search
        pair = inner // (2 * width) * (2 * width)
        left = inner - pair < width
        other = np.where(left, pair + width, pair)
        other_size = np.where(left, np.clip(total - other, 0, width), width)
        act = np.flatnonzero((other_size > 0) & (total > width))
        low, high = np.zeros(len(act), np.int64), other_size[act].copy()
        mine = place[order[act]]
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) >> 1
            a = act[open_]
            theirs = place[order[begin[a] + other[a] + mid]]
            # from the left: count of right ones strictly before; from the right: count of left ones not after
            goes = np.where(left[a], before(prefix, data, theirs, mine[open_]), ~before(prefix, data, mine[open_], theirs))
            low[open_], high[open_] = np.where(goes, mid + 1, low[open_]), np.where(goes, high[open_], mid)
        target = np.arange(n)
        offset = inner[act] - pair[act] - np.where(left[act], 0, width)
        target[act] = begin[act] + pair[act] + offset + low
        moved = np.empty(n, np.int64)
        moved[target] = order
        order = moved
        width *= 2
    return order


def _repeated_windows(anchor: np.ndarray, place: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Windows of the runs that also start elsewhere among them, as ranges by node."""
    count = place["count"].astype(np.int64)
    size = count + LENGTH - 1
    start = np.cumsum(size) - size
    prefix = Prefix(data)
    run = np.repeat(np.arange(len(count)), count)
    window = ragged(start, count)
    # windows with equal bytes have their anchor at equal distance; that alone tells most of them apart
    gram = np.full(len(data), ~np.uint64(0))
    gram[: len(data) - GRAM + 1] = mix(prefix.of(np.arange(len(data) - GRAM + 1), GRAM))
    spots = np.flatnonzero(gram == np.repeat(anchor, size))
    distance = spots[np.searchsorted(spots, window)] - window
    _, kind = np.unique(anchor, return_inverse=True)
    group = kind.ravel()[run] * LENGTH + distance
    order = np.argsort(group, kind="stable")
    group, window, run = group[order], window[order], run[order]
    fine = suffix_order(prefix, data, group, window)
    window, run = window[fine], run[fine]
    same = np.flatnonzero(group[1:] == group[:-1])
    same = same[common_extension(prefix, window[same], window[same + 1]) == LENGTH]
    sure = np.ones(len(same), bool)
    for i in range(0, len(same), 1 << 15):  # hashes may clash; bytes do not
        a, b = window[same[i : i + (1 << 15)]], window[same[i : i + (1 << 15)] + 1]
        sure[i : i + (1 << 15)] = (data[a[:, None] + np.arange(LENGTH)] == data[b[:, None] + np.arange(LENGTH)]).all(1)
    same = same[sure]
    again = np.zeros(len(window), bool)
    again[same] = again[same + 1] = True
    window, run = window[again], run[again]
    begin = place["begin"][run] + window - start[run]
    return _merged(place["node"][run], begin, begin + LENGTH)


def _judge_windows(blocks: int):
    head = np.dtype([("anchor", "<u8"), ("place", PLACE)])

    def fn(kind, block, first, second):
        if kind == SPAN:
            yield (kind, block, first, second)
        elif kind == WINDOW:
            key, place = np.frombuffer(first, KEY), np.frombuffer(second, PLACE)
            order = np.lexsort((key["bytes"], key["anchor"]))
            key, place = key[order], place[order]
            of = np.cumsum(np.append(True, key[1:] != key[:-1])) - 1
            again = np.bincount(of) > 1
            np.logical_or.at(again, of, (place["flag"] & REPEATED) > 0)
            if again.any():
                yield from _settled(place[again[of]], blocks)
        else:
            heads, data = np.frombuffer(first, head), np.frombuffer(second, np.uint8)
            size = heads["place"]["count"].astype(np.int64) + LENGTH - 1
            start = np.cumsum(size) - size
            order = np.argsort(heads["anchor"], kind="stable")
            begun = 0
            total = np.cumsum(size[order])
            anchor = heads["anchor"][order]
            while begun < len(order):  # whole anchors, about SORTED_AT_ONCE bytes
                done = int(np.searchsorted(total, (total[begun - 1] if begun else 0) + SORTED_AT_ONCE))
                done = int(np.searchsorted(anchor, anchor[min(done, len(order) - 1)], side="right"))
                some = order[begun:done]
                out = _repeated_windows(heads["anchor"][some], heads["place"][some], data[ragged(start[some], size[some])])
                yield from pack(SPAN, _by_node(np.ascontiguousarray(out["node"]), blocks), out, np.zeros(len(out), "V1"))
                begun = done

    return fn


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The texts with their nodes, and for each node with something repeated its ranges of bytes (packed)."""
    spark = docs.sparkSession
    texts = _hash(docs)
    measures = texts.groupBy("node").agg(F.count("*").alias("copies"), F.max(F.octet_length("text")).alias("size"), F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("rep"))
    nodes = written(measures, "repeat-nodes")
    total = int(nodes.agg(F.sum("size")).first()[0] or 0)
    width = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    blocks = max(width, total // BYTES_PER_BLOCK + 1)

    judged = written(by_block(_find_runs(texts, blocks), blocks, _judge_runs(blocks)), "repeat-runs")
    due = _per_node(judged, WINDOW, TASK, "node bigint, blob binary", blocks, lambda task, node: (np.frombuffer(node, np.int64), task))
    wanted = due.join(nodes.select("node", F.col("rep").alias("__rep")), "node")
    chosen = texts.withColumn("__rep", F.coalesce("doc_id", F.lit(-(1 << 63)))).join(wanted, ["node", "__rep"])
    chosen = chosen.dropDuplicates(["node", "__rep"]).select("text", "node", "blob")
    windows = by_block(_send_windows(chosen, blocks), blocks, _judge_windows(blocks))
    spans = judged.where(F.col("kind") == SPAN).unionByName(windows.where(F.col("kind") == SPAN))

    def gather(ranges, _):
        out = _merged(ranges["node"], ranges["begin"], ranges["end"])
        return np.ascontiguousarray(out["node"]), out

    ranges = _per_node(spans, SPAN, RANGE, "node bigint, blob binary", blocks, gather)
    copied = nodes.where((F.col("copies") > 1) & (F.col("size") >= LENGTH)).select("node", F.lit(True).alias("copied"))
    return texts, written(ranges.join(copied, "node", "full_outer"), "repeat-ranges")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (begin, end of each removed run of bytes) and kept: the bytes that stay."""
    texts, ranges = repeated_spans(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = [[], [], [], [], []]
                for doc, text, blob, copied in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    raw = text.encode()
                    spans = [(0, len(raw))] if copied else [(int(r["begin"]), int(r["end"])) for r in np.frombuffer(blob or b"", RANGE)]
                    kept, at = [], 0
                    for b, e in spans:
                        kept.append(raw[at:b])
                        at = e
                    left = b"".join([*kept, raw[at:]])
                    for column, v in zip(out, (doc, len(raw), len(raw) - len(left), [{"begin": b, "end": e} for b, e in spans], left), strict=True):
                        column.append(v)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.binary())
                names = ["doc_id", "n_bytes", "n_removed", "spans", "kept"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    joined = texts.join(ranges, "node", "left").select("doc_id", "text", "blob", "copied")
    return joined.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<struct<begin: bigint, end: bigint>>, kept binary")


def digest(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
