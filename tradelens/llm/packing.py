"""Packing documents into fixed-length sequences with controlled source proportions.

Texts are tokenized once and the ids are written to the shared folder. Documents are then dealt
to shards of about ``shard_tokens`` tokens; every shard is packed on its own by deficit
round-robin. A source has one queue in each shard where it occurs. At each window every queue
that still has tokens earns its target share of the window; queues are served in turn when they
have earned at least ``least_piece`` tokens, and what they earned but did not use (or used ahead)
stays with them for the next windows. Between shards deficits carry on too: what a source lacks of
its share after the shards before, by their token counts, is its deficit at the start of a shard.
With targets, documents are dealt to shards so that each has the target proportions as long as
every source lasts: all tokens are packed in the end, so the last shards hold what is over. Without
targets a source's share is its part of all tokens. Documents are cut wherever a window ends. What is left in a shard below one window goes
into sequences whose lengths are powers of two, so no sequence needs padding.

Null texts are empty: they are one end token. A null source is a source of its own. Repeated
rows are packed as often as they occur. A text of any length is packed whole; it is held by one
worker. Queues that lag equally are served in order of their names. An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pretokens import tokens
from .textcols import id_or_least, narrow, null_if_least, parts_for, settle, slices, written

_OUT = pa.schema([
    ("id", pa.int64()), ("source", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
])
OUT_DDL = "id long, source string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Queue:
    """Documents of one source that wait to be packed."""

    def __init__(self, name: str | None, share: float, deficit: float):
        self.name, self.share, self.deficit = name, share, deficit
        self.docs: deque = deque()
        self.waiting, self.start = 0, 0

    def push(self, doc: tuple) -> None:
        self.docs.append(doc)
        self.waiting += len(doc[1])

    def take(self, n: int) -> Iterator[tuple]:
        """Pieces of the first documents, n tokens in all."""
        self.waiting -= n
        self.deficit -= n
        while n:
            doc, ids = self.docs[0]
            size = min(n, len(ids) - self.start)
            yield doc, ids, self.start, size
            self.start += size
            n -= size
            if self.start == len(ids):
                self.docs.popleft()
                self.start = 0


def fill(queues: list[Queue], turn: int, room: int, least_piece: int) -> tuple[list[tuple], int]:
    """The pieces of one window of ``room`` tokens, and whose turn is next. There must be ``room`` tokens waiting."""
    live = [q for q in queues if q.waiting]
    total = sum(q.share for q in live)
    for q in live:
        q.deficit += room * (q.share / total if total > 0 else 1 / len(live))
    pieces: list[tuple] = []
    n = len(queues)
    for step in range(n):
        q = queues[(turn + step) % n]
        if q.waiting and q.deficit >= min(least_piece, q.waiting, room):
            size = min(room, int(q.deficit), q.waiting)
            if size > 0:
                pieces += [(q, *p) for p in q.take(size)]
                room -= size
                if not room:
                    return pieces, (turn + step) % n if q.deficit >= least_piece else (turn + step + 1) % n
    while room:  # nobody has earned enough: the one that lags most goes ahead of its share
        q = max((q for q in queues if q.waiting), key=lambda q: q.deficit)
        size = min(room, q.waiting)
        pieces += [(q, *p) for p in q.take(size)]
        room -= size
    return pieces, turn


def _encode(path: str, end: int):
    schema = pa.schema([("id", pa.int64()), ("source", pa.string()), ("salt", pa.int64()), ("tokens", pa.int64()), ("ids", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens(path)
        for rows, data, offsets in slices(batches):
            ids, at = coder.encode(data, offsets)
            kind = coder.width
            own = [np.append(ids[at[i] : at[i + 1]], end).astype(kind).tobytes() for i in range(rows.num_rows)]
            yield pa.record_batch([rows.column("id"), rows.column("source"), rows.column("salt"), pa.array(np.diff(at) + 1), pa.array(own, pa.binary())], schema=schema)

    return work


def _pack(window: int, least_piece: int, width: str):
    def shard_rows(shard: int, queues: dict) -> Iterator[pa.RecordBatch]:
        order = [queues[k] for k in sorted(queues, key=lambda k: (k is None, k or ""))]
        waiting = sum(q.waiting for q in order)
        sequence, turn, rows = (shard or 0) << 32, 0, []
        while waiting:
            room = window if waiting >= window else 1 << (waiting.bit_length() - 1)
            pieces, turn = fill(order, turn, room, least_piece)
            offset = 0
            for q, doc, ids, start, size in pieces:
                rows.append((doc, q.name, start, size, ids[start : start + size].astype("<u4").tobytes(), len(ids), sequence, offset))
                offset += size
            waiting -= room
            sequence += 1
            if len(rows) > 5_000:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT)
                rows = []
        if rows:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, queues = None, {}
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("shard", "control", "source", "id", "share", "deficit"))
            for i, (s, control, source, doc, share, deficit) in enumerate(zip(*columns, strict=True)):
                if s != shard:
                    yield from shard_rows(shard, queues)
                    shard, queues = s, {}
                if control:
                    queues[source] = Queue(source, share, deficit)
                else:  # a copy, so that the batch need not stay
                    queues[source].push((doc, np.frombuffer(batch.column("ids")[i].as_py(), width)))
        yield from shard_rows(shard, queues)

    return work


def sums_before(rows: DataFrame, value: str, at: str, block: int, *keys: str) -> DataFrame:
    """``rows`` (keys, ``at``, value) with ``<value>_before``, the sum of ``value`` over smaller places, added up in blocks of places."""
    rows = rows.withColumn("block", F.floor(F.col(at) / block))
    sums = rows.groupBy(*keys, "block").agg(F.sum(value).alias("sum"))
    ahead = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*(F.col(k).alias("at_" + k) for k in keys), F.col("block").alias("at_block"), F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("start"))
    same = F.col("block") == F.col("at_block")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col("at_" + k))
    own = Window.partitionBy(*keys, "block").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum(value).over(own), F.lit(0))).join(starts, same)
    return rows.withColumn(value + "_before", F.col("start") + F.col("inside")).drop("block", "at_block", "start", "inside", *("at_" + k for k in keys))


def dealt_to_targets(coded: DataFrame, wanted: DataFrame, shards: int, buckets: int = 16) -> DataFrame:
    """``coded`` with a ``shard`` under which every shard has the proportions of ``wanted`` (target_source, target) as long as all sources last.

    A source's documents are dealt to ``shards * buckets`` cells, whose sizes are added up, so no task
    holds a source. The cells of a source follow each other at its target's pace: a cell comes when
    the tokens ahead of it, over the target, have passed in every source. Sources without a target come last.
    """
    cells = shards * buckets
    coded = coded.withColumn("cell", F.pmod(F.xxhash64("id", "salt"), F.lit(cells)))
    sizes = settle(coded.groupBy("source", "cell").agg(F.sum("tokens").alias("size")))
    sums = sizes.groupBy("source").agg(F.sum("size").alias("all"))
    sums = sums.join(F.broadcast(wanted), F.col("source").eqNullSafe(F.col("target_source")), "left").select("source", F.coalesce("target", F.lit(0.0)).alias("target"), "all")
    paces = [(float(r.target), float(r["all"])) for r in sums.where("target > 0").select("target", "all").collect()]  # as long as the caller's list
    known = sum(n for _, n in paces)
    at = sums_before(sizes, "size", "cell", 1024, "source").withColumn("ahead", F.col("size_before") + F.col("size") / 2)
    rest = sums.where("target = 0").agg(F.coalesce(F.sum("all"), F.lit(0)).alias("rest"))
    at = at.join(sums.select(F.col("source").alias("of"), "target", "all"), F.col("source").eqNullSafe(F.col("of"))).crossJoin(F.broadcast(rest))  # one row
    time = F.try_divide("ahead", "target")
    passed = F.lit(0.0)
    for pace, all_ in paces:
        passed = passed + F.least(time * pace, F.lit(all_))
    passed = F.when(F.col("target") > 0, passed).otherwise(known + F.col("ahead") / F.col("all") * F.col("rest"))
    total = known + F.col("rest")
    places = at.select(F.col("source").alias("of"), F.col("cell").alias("of_cell"), F.least(F.lit(shards - 1), F.floor(passed * shards / total)).cast("long").alias("shard"))
    return coded.join(places, F.col("source").eqNullSafe(F.col("of")) & (F.col("cell") == F.col("of_cell"))).drop("cell", "of", "of_cell")


def carried(counts: DataFrame, wanted: DataFrame | None = None, block: int = 1024) -> DataFrame:
    """(shard, source, tokens, share, deficit) from (shard, source, tokens): the share, and what is lacking of it after the shards before.

    The share is the target of ``wanted`` (target_source, target), which add up to 1, else the part of
    all tokens. A source's shards are added up in blocks, so no task holds all shards of one source.
    """
    if wanted is not None:
        share = wanted.select(F.col("target_source").alias("of"), F.col("target").alias("share"))
    else:
        total = counts.agg(F.sum("tokens").alias("total"))
        share = counts.groupBy("source").agg(F.sum("tokens").alias("own")).crossJoin(F.broadcast(total)).select(F.col("source").alias("of"), (F.col("own") / F.col("total")).alias("share"))  # one row of totals
    per_shard = counts.groupBy("shard").agg(F.sum("tokens").alias("shard_tokens"))

    rows = sums_before(counts, "tokens", "shard", block, "source").join(sums_before(per_shard, "shard_tokens", "shard", block).drop("shard_tokens"), "shard")
    rows = rows.join(share, F.col("source").eqNullSafe(F.col("of")), "inner" if wanted is None else "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
    return rows.select("shard", "source", "tokens", "share", (F.col("share") * F.col("shard_tokens_before") - F.col("tokens_before")).alias("deficit"))


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    window: int = 1024, targets: dict[str | None, float] | None = None, least_piece: int = 128,
    shard_tokens: int = 4_000_000, end: int = 0,
) -> DataFrame:
    """One row per piece: id, source, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    ``targets`` are shares of tokens by source (a source without one gets what the others leave of
    a window); without them each source's target is its part of all tokens.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    rows = docs.select(id_or_least(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(source_col).cast("string").alias("source"), F.monotonically_increasing_id().alias("salt"))
    coded = written(rows.mapInArrow(_encode(tokenizer, end), "id long, source string, salt long, tokens long, ids binary"))
    total, n_rows = coded.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
    shards = max(1, round(total / shard_tokens))
    wanted = None
    if targets:
        whole = float(sum(targets.values()))
        wanted = docs.sparkSession.createDataFrame([(k, float(v) / whole) for k, v in targets.items()], "target_source string, target double")
        coded = settle(dealt_to_targets(coded, wanted, shards))
    else:  # repeated rows and rows without an id spread over the shards too
        coded = coded.withColumn("shard", F.pmod(F.xxhash64("id", "salt"), F.lit(shards)))
    control = carried(coded.groupBy("shard", "source").agg(F.sum("tokens").alias("tokens")), wanted)
    control = control.select("shard", F.lit(True).alias("control"), "source", F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("ids"), "share", "deficit", F.lit(0).cast("long").alias("salt"))
    body = coded.select("shard", F.lit(False).alias("control"), "source", "id", "ids", F.lit(0.0).alias("share"), F.lit(0.0).alias("deficit"), "salt")
    # a task packs several shards, one after the other
    n = min(shards, max(parts_for(docs), -(-shards // 64)))
    ready = control.unionByName(body).repartition(n, "shard").sortWithinPartitions("shard", F.desc("control"), F.xxhash64("id", "salt"), "id")
    out = ready.select("shard", "control", "source", "id", "ids", "share", "deficit").mapInArrow(_pack(window, least_piece, tokens(tokenizer).width), OUT_DDL)
    out = narrow(out, n_rows, 5_000)
    return out.withColumn("id", null_if_least("id")).withColumnRenamed("id", id_col)
