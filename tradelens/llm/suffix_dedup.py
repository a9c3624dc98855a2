"""Exact removal of repeated passages by a hash-compared suffix sort.

A byte is removed when it lies in a string of ``length`` bytes that also starts earlier, in a
document with a smaller id or further left in the same document. Sorting every suffix of the
corpus would shuffle it many times over, so suffixes are first put in buckets:

1.  Each window of ``length`` bytes picks an anchor, the ``k``-gram in it with the least hash
    (leftmost of equals). Equal windows pick equal anchors at equal distances, so they meet in
    the bucket of that anchor. Runs of windows that share an anchor travel as one row.
2.  Runs with equal anchor, distance and context are whole repeats of each other: all but
    the first are marked, already before the shuffle where one batch holds several (there their
    bytes are compared); those marks are joined to one row where runs follow each other. Between
    batches contexts count as equal when the 128 bits of their BLAKE2 digests are. ``by_bytes``
    leaves this step out and decides everything by bytes, which moves many more of them.
3.  Anchors that occur in unequal contexts get the bytes of their contexts. The suffixes that
    start at their windows are put in order by a merge sort; a comparison finds the common
    extension of two suffixes by binary search over prefix polynomial hashes. Neighbours whose
    common extension reaches ``length`` are equal; bytes are compared to verify it.
4.  An anchor with more than ``hot`` contexts is not sorted in one task: its windows are
    grouped by their bytes with map-side aggregation. Anchors that hold more rows than a task
    should (found in a sample of documents) are also dealt by context in step 2.

Ids: a null id counts as the smallest. A row that repeats another row's id and text counts as the
same document. Different texts under one id or under none are documents of their own, in the place
of their id and, there, in the order of a hash. Null or empty texts and texts shorter than ``length``
lose nothing; long texts are taken in blocks that overlap. An empty table gives no rows. Columns
other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import hot_keys
from .textcols import WindowPrefix, document_ids, i64, mix, narrow, parts_for, slices, stream, utf8, written

_U = np.uint64
_BLOCK = 1 << 23
_POSITION = _U((1 << 24) - 1)

REPEAT, DISTINCT, CROWDED = 0, 1, 2


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` values."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def anchor_runs(data: np.ndarray, offsets: np.ndarray, length: int, k: int):
    """Runs of windows with one anchor: (document, first window, windows, anchor's distance, anchor hash)."""
    if len(data) < length:
        return None
    grams = WindowPrefix(data).every(k)
    order = (grams & ~_POSITION) | np.arange(len(grams), dtype=_U)
    anchor = (_least(order, length - k + 1) & _POSITION).astype(np.int64)
    n = len(anchor)
    edge = np.zeros(n + 1, np.int64)
    bad_from = np.minimum(np.maximum(offsets[:-1], offsets[1:] - length + 1), n)
    np.add.at(edge, bad_from, 1)
    np.add.at(edge, np.minimum(offsets[1:], n), -1)
    valid = np.cumsum(edge[:n]) == 0
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    first = np.flatnonzero(valid & new)
    if not len(first):
        return None
    upto = np.cumsum(valid)
    ends = np.append(upto[first[1:] - 1], upto[-1])
    count = ends - (upto[first] - 1)
    document = np.searchsorted(offsets, first, "right") - 1
    return document, first - offsets[document], count, anchor[first] - first, grams[anchor[first]]


def _leads(identity: np.ndarray, ids: np.ndarray, lows: np.ndarray) -> np.ndarray:
    """For each row the row of smallest (id, position) with its identity."""
    lead = np.arange(len(identity))
    ordered = np.sort(identity)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if len(twice):
        at = np.searchsorted(twice, identity)
        some = np.flatnonzero(twice[np.minimum(at, len(twice) - 1)] == identity)
        some = some[np.lexsort((lows[some], ids[some], identity[some]))]
        head = np.flatnonzero(np.append(True, identity[some][1:] != identity[some][:-1]))
        lead[some] = some[np.repeat(head, np.diff(np.append(head, len(some))))]
    return lead


#: ``place`` holds first window, windows and the anchor's distance, of a REPEAT only the first two.
_RUNS = pa.schema([("kind", pa.int8()), ("key", pa.int64()), ("context", pa.int64()), ("more", pa.int64()), ("id", pa.int64()), ("place", pa.int64())])
RUNS_DDL = "kind byte, key long, context long, more long, id long, place long"


def _place(lows, counts, distances):
    return (lows.astype(np.int64) << 16) | (counts.astype(np.int64) << 8) | distances.astype(np.int64)


def _joined(ids: np.ndarray, lows: np.ndarray, counts: np.ndarray, leads: np.ndarray) -> tuple[np.ndarray, ...]:
    """Neighbouring runs as one run of fewer than 2**16 windows where what they repeat (``leads``, places of windows) follows too: (first of the runs, windows)."""
    if not len(ids):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    lows, counts = lows.astype(np.int64), counts.astype(np.int64)
    apart = np.append(True, (ids[1:] != ids[:-1]) | (lows[1:] != lows[:-1] + counts[:-1]) | (leads[1:] != leads[:-1] + counts[:-1]))
    ahead = np.cumsum(counts) - counts
    base = ahead[apart][np.cumsum(apart) - 1]
    piece = (ahead - base) >> 15
    head = np.flatnonzero(apart | np.append(True, piece[1:] != piece[:-1]))
    return head, np.add.reduceat(counts, head)


def _digests(raw: bytes, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """(runs, 2) halves of the 128-bit digests of byte ranges."""
    view, digest = memoryview(raw), hashlib.blake2b
    return np.frombuffer(b"".join([digest(view[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]), np.int64).reshape(-1, 2)


def _anchors(length: int, k: int, by_bytes: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        texts: list[bytes] = []
        held = size = 0

        def out():
            ids, lows, counts, distances, keys, at = (np.concatenate(x) for x in zip(*kept, strict=True))
            raw = b"".join(texts)
            place = _place(lows, counts, distances)
            digests = np.zeros((len(ids), 2), np.int64) if by_bytes else _digests(raw, at, at + counts + length - 1)
            lead = np.arange(len(ids)) if by_bytes else _leads(mix(keys ^ mix(digests[:, 0].view(_U) + (place & 0xFFFF).astype(_U))), ids, lows)
            later = np.flatnonzero((ids != ids[lead]) | (lows != lows[lead]))
            head, windows = _joined(ids[later], lows[later], counts[later], at[lead[later]])
            again = later[head]
            for a, b, n in zip(at[again].tolist(), at[lead[again]].tolist(), (windows + length - 1).tolist(), strict=True):
                if raw[a : a + n] != raw[b : b + n]:  # no whole repeats are marked in this batch
                    later = again = windows = np.empty(0, np.int64)
                    break
            left = np.ones(len(ids), bool)
            left[later] = False
            kind = np.repeat(np.array([DISTINCT, REPEAT], np.int8), [left.sum(), len(again)])
            none = np.zeros(len(again), np.int64)
            columns = [np.concatenate(x) for x in (
                (keys[left].view(np.int64), mix(ids[again].astype(_U) + lows[again].astype(_U)).view(np.int64)), (digests[left, 0], none), (digests[left, 1], none),
                (ids[left], ids[again]), (place[left], lows[again].astype(np.int64) << 16 | windows),
            )]
            return pa.record_batch([pa.array(kind), *map(i64, columns)], schema=_RUNS)

        for rows, data, offsets in slices(batches):
            ids = rows.column("id").to_numpy(zero_copy_only=False)
            for start in range(0, max(len(data), 1), _BLOCK) if len(ids) == 1 else [0]:
                part, cuts = (data[start : start + _BLOCK + length - 1], None) if len(ids) == 1 else (data, offsets)
                cuts = np.array([0, len(part)]) if cuts is None else cuts
                found = anchor_runs(part, cuts, length, k)
                if found is not None:
                    document, low, count, distance, key = found
                    kept.append((ids[document], low + start, count, distance, key, size + cuts[document] + low))
                    texts.append(part.tobytes())
                    held += len(low)
                    size += len(part)
                if held > 250_000:
                    yield out()
                    kept.clear()
                    texts.clear()
                    held = size = 0
        if kept:
            yield out()

    return work


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole key groups from batches sorted by key."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rest.append(batch)
        if sum(x.num_rows for x in rest) < 100_000 and sum(x.nbytes for x in rest) < 16_000_000:
            continue
        table = pa.Table.from_batches(rest)
        keys = table.column("key").to_numpy()
        last = int(np.searchsorted(keys, keys[-1], "left"))
        if last:
            yield table.slice(0, last)
            rest = table.slice(last).combine_chunks().to_batches()
    if rest:
        yield pa.Table.from_batches(rest)


_MARKS = pa.schema([("kind", pa.int8()), ("key", pa.int64()), ("id", pa.int64()), ("place", pa.int64())])
MARKS_DDL = "kind byte, key long, id long, place long"


def _meet(hot: int, by_bytes: bool):
    """Whole repeats, and the anchors that stand in several contexts.

    Rows come in order of key, context, shape, id and place, so that a context's first row is
    met before all others and an anchor needs no more room than its first ``hot`` contexts.
    """

    def rows_of(kind: int, part: tuple) -> pa.RecordBatch:
        return pa.record_batch([pa.array(np.full(len(part[0]), kind, np.int8)), *map(i64, part)], schema=_MARKS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # key, context, more and shape of the last row, id and first window of its first row
        held: list[tuple] = []  # contexts of the last key
        size = 0

        def settled():
            if size > 1 and held:
                part = tuple(np.concatenate(x) for x in zip(*held, strict=True))
                yield rows_of(CROWDED if size > hot else DISTINCT, part)

        def take(key, ids, place):
            """More contexts of the last key; a key with too many is not held any longer."""
            nonlocal held, size
            size += len(key)
            held.append((key, ids, place))
            if size > hot:
                yield from settled()
                held = []

        for batch in batches:
            kind, ids, place = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "id", "place"))
            done = kind == REPEAT
            if done.any():
                yield pa.record_batch([batch.column(c).filter(pa.array(done)) for c in _MARKS.names], schema=_MARKS)
            rest = np.flatnonzero(~done)
            if not len(rest):
                continue
            key, context, more = (batch.column(c).to_numpy()[rest] for c in ("key", "context", "more"))
            spread = batch.column("spread").to_numpy(zero_copy_only=False)[rest]
            ids, place = ids[rest], place[rest]
            shape, low = place & 0xFFFF, place >> 16
            n = len(rest)
            new = np.ones(n, bool)
            if not by_bytes:
                new[1:] = (key[1:] != key[:-1]) | (context[1:] != context[:-1]) | (more[1:] != more[:-1]) | (shape[1:] != shape[:-1])
                if last is not None:
                    new[0] = last[:4] != (key[0], context[0], more[0], shape[0])
            first = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            lead, lead_at = ids[np.maximum(first, 0)], low[np.maximum(first, 0)]
            if last is not None:
                lead, lead_at = np.where(first < 0, last[4], lead), np.where(first < 0, last[5], lead_at)
            again = np.flatnonzero(~new & ((ids != lead) | (low != lead_at)))
            if len(again):
                yield rows_of(REPEAT, (key[again], ids[again], low[again] << 16 | (place[again] >> 8) & 0xFF))
            open_ = last is not None and last[0] == key[0]
            last = (key[-1], context[-1], more[-1], shape[-1], lead[-1], lead_at[-1])
            one = np.flatnonzero(new)
            if not open_:
                yield from settled()
                held, size = [], 0
            if not len(one):
                continue
            wide = np.flatnonzero(spread[one])  # known to be crowded: several tasks share them
            if len(wide):
                yield rows_of(CROWDED, (key[one[wide]], ids[one[wide]], place[one[wide]]))
            one = one[~spread[one]]
            if not len(one):
                continue
            key, ids, place = key[one], ids[one], place[one]
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            edge, tail = (start[1], start[-1]) if len(start) > 1 else (len(key), len(key))
            yield from take(key[:edge], ids[:edge], place[:edge])  # may go on from the batch before
            if len(start) > 1:
                yield from settled()
                held, size = [], 0
                counts = np.diff(start[1:])  # of keys that begin and end in this batch
                many = np.repeat(counts, counts)
                for code, good in ((DISTINCT, (many > 1) & (many <= hot)), (CROWDED, many > hot)):
                    if good.any():
                        yield rows_of(code, tuple(x[edge:tail][good] for x in (key, ids, place)))
                yield from take(key[tail:], ids[tail:], place[tail:])
        yield from settled()

    return work


class Suffixes:
    """Suffixes of a byte array, compared over their first ``length`` bytes by prefix hashes."""

    def __init__(self, data: np.ndarray, length: int):
        self.data, self.length, self.hashes = data, length, WindowPrefix(data)

    def equal(self, x, y, n) -> np.ndarray:
        return self.hashes.raw(x, x + n) == self.hashes.raw(y, y + n)

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension, at most ``length``, by binary search."""
        low, high = np.zeros(len(x), np.int64), np.full(len(x), self.length, np.int64)
        while True:
            busy = np.flatnonzero(low < high)
            if not len(busy):
                return low
            middle = (low[busy] + high[busy] + 1) >> 1
            same = self.equal(x[busy], y[busy], middle)
            low[busy[same]] = middle[same]
            high[busy[~same]] = middle[~same] - 1

    def less(self, x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        answer = or_equal.copy()
        differ = np.flatnonzero(~self.equal(x, y, self.length))
        if len(differ):
            a, b = x[differ], y[differ]
            at = self.common(a, b)
            answer[differ] = self.data[a + at] < self.data[b + at]
        return answer

    def sort(self, suffix: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Stable merge sort of the suffixes inside each bucket; ``bucket`` is ascending. Returns the order."""
        order = np.arange(len(suffix))
        starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        sizes = np.diff(np.append(starts, len(suffix)))
        begin, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
        rank = np.arange(len(suffix)) - begin
        width = 1
        while True:
            busy = np.flatnonzero(size > width)
            if not len(busy):
                return order
            own = rank[busy] // width
            right = (own & 1).astype(bool)
            pair = begin[busy] + (own >> 1) * (2 * width)
            end = begin[busy] + size[busy]
            low = np.where(right, pair, np.minimum(pair + width, end))
            high = np.where(right, pair + width, np.minimum(pair + 2 * width, end))
            first = low.copy()
            mine = suffix[order[busy]]
            while True:
                active = np.flatnonzero(low < high)
                if not len(active):
                    break
                middle = (low[active] + high[active]) >> 1
                ahead = self.less(suffix[order[middle]], mine[active], right[active])
                low[active[ahead]] = middle[ahead] + 1
                high[active[~ahead]] = middle[~ahead]
            target = pair + rank[busy] % width + (low - first)
            merged = order.copy()
            merged[target] = order[busy]
            order, width = merged, width * 2

    def repeats(self, suffix: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """For each suffix the index of the first equal one in its bucket (itself if none is earlier)."""
        order = self.sort(suffix, bucket)
        ordered = suffix[order]
        new = np.ones(len(order), bool)
        new[1:] = (bucket[order][1:] != bucket[order][:-1]) | (self.common(ordered[:-1], ordered[1:]) < self.length)
        heads = np.flatnonzero(new)
        lead = np.empty(len(order), np.int64)
        lead[order] = order[np.repeat(heads, np.diff(np.append(heads, len(order))))]
        view = np.lib.stride_tricks.sliding_window_view(self.data, self.length)
        claimed = np.flatnonzero(lead != np.arange(len(lead)))
        for at in range(0, len(claimed), 50_000):
            some = claimed[at : at + 50_000]
            false = some[(view[suffix[some]] != view[suffix[lead[some]]]).any(axis=1)]
            if len(false):  # a collision: these classes are made again from the bytes
                classes = np.unique(lead[false])
                members = np.flatnonzero(np.isin(lead, classes))
                firsts: dict[tuple, int] = {}
                for i in members:
                    lead[i] = firsts.setdefault((lead[i], bucket[i], view[suffix[i]].tobytes()), i)
        return lead


_SPANS = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("bytes", pa.int64())])
SPANS_DDL = "id long, start long, bytes long"


def _windows(table: pa.Table, length: int):
    key, ids, place = (table.column(x).to_numpy() for x in ("key", "id", "place"))
    data, offsets = utf8(table.column("context").combine_chunks())
    count, distance, low = (place >> 8) & 0xFF, place & 0xFF, place >> 16
    row = np.repeat(np.arange(len(key)), count)
    step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return key, ids, low, data, row, step, offsets[row] + step, distance[row] - step


def _sort_contexts(length: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _groups(batches):
            at = 0
            keys = whole.column("key").to_numpy()
            while at < whole.num_rows:  # about 6,000 contexts at a time, never part of a group
                stop = min(at + 6_000, whole.num_rows)
                stop = int(np.searchsorted(keys, keys[stop - 1], "right"))
                key, ids, low, data, row, step, suffix, distance = _windows(whole.slice(at, stop - at), length)
                at = stop
                position = low[row] + step
                order = np.lexsort((position, ids[row], distance, key[row]))
                row, step, suffix, position = row[order], step[order], suffix[order], position[order]
                bucket = mix(key[row].view(_U) + distance[order].astype(_U))
                lead = Suffixes(data, length).repeats(suffix, bucket)
                again = np.flatnonzero((ids[row] != ids[row[lead]]) | (position != position[lead]))
                row, step = row[again], step[again]
                order = np.lexsort((step, row))
                row, step = row[order], step[order]
                if not len(row):
                    continue
                head = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (step[1:] != step[:-1] + 1)))
                runs = np.diff(np.append(head, len(row)))
                yield pa.record_batch([i64(ids[row[head]]), i64(low[row[head]] + step[head]), i64(runs + length - 1)], schema=_SPANS)

    return work


_RESULT = pa.schema([("id", pa.int64()), ("own", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))), ("kept", pa.binary())])
RESULT_DDL = "id long, own long, n_bytes long, spans array<struct<start:long,length:long>>, kept binary"


def merge_spans(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the ranges."""
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], np.maximum.accumulate(stops[order])
    head = np.append(True, starts[1:] > stops[:-1])
    at = np.flatnonzero(head)
    return starts[at], stops[np.append(at[1:] - 1, len(stops) - 1)]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in slices(batches):
        raw = data.tobytes()
        spans, kept = [], []
        ranges = rows.column("ranges")
        values = ranges.flatten()
        starts = values.field("start").to_numpy(zero_copy_only=False) if len(values) else np.empty(0, np.int64)
        sizes = values.field("bytes").to_numpy(zero_copy_only=False) if len(values) else np.empty(0, np.int64)
        lengths = np.nan_to_num(np.asarray(ranges.value_lengths().fill_null(0)), nan=0).astype(np.int64)
        firsts = np.concatenate([[0], np.cumsum(lengths)])
        for i in range(rows.num_rows):
            text = raw[offsets[i] : offsets[i + 1]]
            a, b = firsts[i], firsts[i + 1]
            if a == b:
                spans.append([])
                kept.append(text)
                continue
            low, high = merge_spans(starts[a:b], np.minimum(starts[a:b] + sizes[a:b], len(text)))
            spans.append([{"start": int(x), "length": int(y - x)} for x, y in zip(low, high, strict=True)])
            edges = [0, *np.stack([low, high], 1).ravel().tolist(), len(text)]
            kept.append(b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
        yield pa.record_batch([rows.column("id"), rows.column("own"), i64(np.diff(offsets)), pa.array(spans, _RESULT.field("spans").type), pa.array(kept, pa.binary())], schema=_RESULT)


def repeated_ranges(text: DataFrame, length: int = 100, k: int = 32, hot: int = 4096, by_bytes: bool = False, rows: int | None = None) -> DataFrame:
    """(id, start, bytes): ranges of bytes, overlapping ones included, that repeat an earlier passage, from (id, text), about ``rows``."""
    if not 8 <= k < length or length - k + 1 > 255:
        raise ValueError("k must be at least 8, below length, and length - k below 255")
    n = parts_for(text)
    filled, anchors = text.where(F.length("text") > 0), _anchors(length, k, by_bytes)
    # a sample shows which anchors to spread; what is found does not hang on it
    wide = hot_keys(filled.where(F.pmod(F.xxhash64("id"), F.lit(64)) == 0).mapInArrow(anchors, RUNS_DDL).where(F.col("kind") != REPEAT), "key", least=max(100, hot))
    runs = filled.mapInArrow(anchors, RUNS_DDL)
    spread = F.lit(False)
    if wide is not None:
        runs = runs.join(F.broadcast(wide.select("key", F.lit(True).alias("wide"))), "key", "left")
        spread = F.coalesce("wide", F.lit(False)) & (F.col("kind") != REPEAT)
    runs = runs.withColumn("spread", spread)
    windows = F.col("place").bitwiseAND(F.lit(0xFFFF))
    ordered = runs.repartition(n, "key", F.when(F.col("spread"), F.col("context"))).sortWithinPartitions("key", "context", "more", windows, "id", "place")
    marks = written(narrow(ordered.mapInArrow(_meet(hot, by_bytes), MARKS_DDL), text.count() if rows is None else rows, 5_000))
    whole = marks.where(F.col("kind") == REPEAT).select("id", F.shiftright("place", 16).alias("start"), (windows + length - 1).alias("bytes"))
    several = marks.where(F.col("kind") != REPEAT).hint("shuffle_hash")
    low, count = F.shiftright("place", 16), F.shiftright("place", 8).bitwiseAND(F.lit(255))
    context = F.substring(F.col("text").cast("binary"), (low + 1).cast("int"), (count + length - 1).cast("int"))
    contexts = text.join(several, "id").select("kind", "key", "id", "place", context.alias("context"))
    ordered = contexts.where(F.col("kind") == DISTINCT).drop("kind").repartition(n, "key").sortWithinPartitions("key")
    found = whole.unionByName(ordered.mapInArrow(_sort_contexts(length), SPANS_DDL))
    if marks.where(F.col("kind") == CROWDED).isEmpty():
        return found
    # windows of crowded anchors, by their bytes
    windows = contexts.where(F.col("kind") == CROWDED).select("id", "place", "context", F.explode(F.sequence(F.lit(0), count.cast("int") - 1)).alias("step"))
    windows = windows.select(F.substring("context", F.col("step") + 1, F.lit(length)).alias("window"), "id", (low + F.col("step")).alias("position"))
    first = windows.groupBy("window").agg(F.min(F.struct("id", "position")).alias("first"))
    crowd = windows.join(first, "window").where((F.col("id") != F.col("first.id")) | (F.col("position") != F.col("first.position")))
    return found.unionByName(crowd.select("id", F.col("position").alias("start"), F.lit(length).cast("long").alias("bytes")))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, k: int = 32, hot: int = 4096, by_bytes: bool = False, documents: DataFrame | None = None) -> DataFrame:
    """One row per input row: id, n_bytes, spans removed, and the bytes kept (binary: a cut may split a character).

    ``documents``, if given, are the rows of ``document_ids`` for ``docs``; their number is then in ``document``.
    """
    rows = document_ids(docs, id_col, text_col) if documents is None else documents
    text = rows.select(F.col("document").alias("id"), "own", "text")
    ranges = repeated_ranges(text.select("id", "text"), length, k, hot, by_bytes, docs.count())
    ranges = ranges.groupBy("id").agg(F.collect_list(F.struct("start", "bytes")).alias("ranges")).hint("shuffle_hash")
    out = text.join(ranges, "id", "left").mapInArrow(_cut, RESULT_DDL)
    return out.select(F.col("own").alias(id_col), *([] if documents is None else [F.col("id").alias("document")]), "n_bytes", "spans", "kept")


__all__ = ["suffix_dedup", "repeated_ranges", "Suffixes", "merge_spans", "anchor_runs", "stream"]
