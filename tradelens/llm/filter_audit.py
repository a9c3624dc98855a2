"""How five document filters interact: what each removes in every order of application.

Each document gets a mask of the filters that it fails. Masks are counted by part; since there are
32 of them, what every filter removes at every step of all 120 orders follows from these counts.

A few words (``A``), few different words (``B``), many capitals (``C``) and symbols (``D``) are
judged on one document alone. ``E``, a text that stands under a smaller id already, is found by
partition refinement: all rows are split by code-point length, what is alone leaves; the rest is
split by a hash of the first block of the text, then of the next, which is eight times as long,
and so on to the end of the texts, and every time what is alone leaves. Only the texts of the
rows that remain are compared, in full. Hashes never decide: where a class that remains holds
different texts, its rows are compared by text.

Nulls and ties: a null text is empty, and all empty texts are equal. A null source is the part ''.
A row without an id is never a duplicate and makes none of another row (no id is smaller or
larger); it has no labels. Rows with equal id and text count as often as they occur and do not
make duplicates of each other. A document has a label if any row of the labels says so. An empty
table has no parts and gives no rows. Other columns are ignored. A text of any length is taken
whole; its words are counted in pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import salted, spread_join
from .textcols import parts_for, release, settle, written

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Code points of the first block, and how many times longer each next one is; nine reach beyond 2^31.
FIRST_BLOCK, GROWTH, BLOCKS = 256, 8, 9

_UPPER, _SYMBOLS, _GAPS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|", b" \t\n\v\f\r"
_SLICE = 4 << 20


def _counted(text: bytes) -> tuple[int, int]:
    """(words, different words); a long text goes through in pieces that end between words."""
    if len(text) <= _SLICE:
        words = text.split()  # of bytes: at the six white characters of ASCII
        return len(words), len(set(words))
    n, seen, at = 0, set(), 0
    while at < len(text):
        stop = min(at + _SLICE, len(text))
        while stop < len(text) and text[stop] not in _GAPS:
            stop += 1
        words = text[at:stop].split()
        n += len(words)
        seen.update(words)
        at = stop
    return n, len(seen)


def own_failures(text: bytes, length: int) -> int:
    """Bits 0 to 3 for the filters A to D that a text of ``length`` code points fails."""
    n, different = _counted(text)
    capitals = len(text) - len(text.translate(None, _UPPER))
    symbols = len(text) != len(text.translate(None, _SYMBOLS))
    return (n < 50) | (100 * different < 65 * n) << 1 | (100 * capitals > 5 * length) << 2 | symbols << 3


def _judge(schema: pa.Schema):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, length = batch.column("text").cast(pa.binary()), batch.column("length")
            masks = np.fromiter((own_failures(t.as_py(), n.as_py()) for t, n in zip(text, length, strict=True)), np.int32, batch.num_rows)
            yield pa.record_batch([pc.cast(batch.column(f.name), f.type) if f.name != "mask" else pa.array(masks) for f in schema], schema=schema)
        release()

    return work


def block_hash(text: Column, start: int, size: int) -> Column:
    """A hash of the code points [start, start + size)."""
    return F.xxhash64(F.substring(text, start + 1, min(size, 2**31 - 1)))


def _start(level: int) -> int:
    """Code points before a block."""
    return FIRST_BLOCK * (GROWTH**level - 1) // (GROWTH - 1)


def _hashes(text: Column, length: Column, hashed: Callable[[Column, int, int], Column]) -> Column:
    """Hashes of the blocks of a text, null beyond its end."""
    return F.array(*(F.when(length > _start(k), hashed(text, _start(k), FIRST_BLOCK * GROWTH**k)) for k in range(BLOCKS)))


def _class(length: Column, hashes: Column) -> Column:
    """The class of a text after all its blocks: equal for equal texts."""
    return F.aggregate(F.filter(hashes, lambda h: h.isNotNull()), F.xxhash64(length), lambda a, h: F.xxhash64(a, h))


class _Shared:
    """Classes that hold more than one row, with the salts of the large ones."""

    def __init__(self, rows: DataFrame, total: int):
        sizes = rows.groupBy("class").agg(F.count("*").alias("rows"))
        self.classes = settle(sizes.where("rows > 1"))
        limit = max(1_000, total // (4 * parts_for(rows)))
        large = self.classes.where(F.col("rows") > limit).select("class", F.ceil(F.col("rows") / limit).cast("int").alias("_copies")).collect()  # no more than rows / limit
        self.hot = rows.sparkSession.createDataFrame(large, "class long, _copies int") if large else None

    def of(self, rows: DataFrame, by: str, table: DataFrame | None = None, how: str = "inner") -> DataFrame:
        """``rows`` of these classes, with the columns of ``table`` (one row a class)."""
        table = self.classes.select("class") if table is None else table
        return spread_join(salted(rows, "class", by, self.hot), table, "class", self.hot, how)


def refine(rows: DataFrame) -> _Shared:
    """Classes of more than one row of ``rows`` (row, length, hashes) after all blocks."""
    rows = rows.select("row", "length", "hashes", F.xxhash64("length").alias("class"))
    total, done, level = rows.count(), None, 0
    while True:
        shared = _Shared(rows, total)
        rows = settle(shared.of(rows, "row").select("row", "length", "hashes", "class"))
        over = rows.where(F.col("length") <= _start(level)).select("class")  # whole texts are in their class
        done = over if done is None else done.unionByName(over)
        rows = rows.where(F.col("length") > _start(level))
        if level == BLOCKS or rows.isEmpty():
            return _Shared(done, total)
        rows = rows.withColumn("class", F.xxhash64("class", F.col("hashes")[level]))
        level += 1


def duplicates(texts: DataFrame, judged: DataFrame, hashed: Callable[[Column, int, int], Column] = block_hash) -> DataFrame:
    """``judged`` (doc_id, part, mask) with bit 4 of the mask for texts that stand under a smaller id.

    ``texts`` are (row, doc_id, part, text, length); ``judged`` has their masks and block hashes, stored.
    """
    judged = judged.withColumn("class", _class(F.col("length"), F.col("hashes")))
    shared = refine(judged.select("row", "length", "hashes"))
    # only texts of classes that remain move, spread by their rows; equal ones meet before they are sent on
    texts = texts.withColumn("class", _class(F.col("length"), _hashes(F.col("text"), F.col("length"), hashed)))
    kinds = shared.of(texts.select("class", "doc_id", "text", "row"), "row").groupBy("class", "text").agg(F.min("doc_id").alias("first"))
    firsts = settle(kinds.groupBy("class").agg(F.min("first").alias("first"), F.count("*").alias("texts")))
    out = shared.of(judged, "row", firsts, "left")
    later = F.when(F.col("doc_id") > F.col("first"), 16).otherwise(0)
    one = out.where(F.coalesce("texts", F.lit(1)) == 1).select("doc_id", "part", (F.col("mask") + later).alias("mask"))
    mixed = firsts.where("texts > 1").select("class")
    if mixed.isEmpty():
        return one
    # different texts whose hashes all agree: as rare as that is, their rows are told apart by text
    rows = shared.of(texts, "row", mixed)
    own = rows.groupBy("class", "text").agg(F.min("doc_id").alias("first"))
    rows = rows.select("doc_id", "part", "length", "text", "class").join(own, ["class", "text"])
    rows = rows.select("doc_id", "part", "length", "text", F.when(F.col("doc_id") > F.col("first"), 16).otherwise(0).alias("later"))
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("later", pa.int32()), ("mask", pa.int32())])
    two = rows.mapInArrow(_judge(schema), "doc_id long, part string, later int, mask int")
    return one.unionByName(two.select("doc_id", "part", (F.col("mask") + F.col("later")).alias("mask")))


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", hashed: Callable[[Column, int, int], Column] = block_hash) -> DataFrame:
    """(doc_id, part, mask) of every row: bits 0 to 4 for the filters A to E that it fails."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"length": F.length("text"), "row": F.monotonically_increasing_id()})
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("part", pa.string()), ("length", pa.int32()), ("hashes", pa.list_(pa.int64())), ("mask", pa.int32())])
    judged = written(rows.withColumn("hashes", _hashes(F.col("text"), F.col("length"), hashed)).mapInArrow(_judge(schema), "row long, doc_id long, part string, length int, hashes array<long>, mask int"))
    return duplicates(rows, judged, hashed)


def interactions(counts: DataFrame) -> DataFrame:
    """One row per part, order and step from (part, mask, n, good, toxic), at most 32 rows a part."""
    cells = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most 32
    steps = cells.withColumn("filter_order", F.explode(F.lit(ORDERS))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(5))))
    letters = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.pow(F.lit(2), F.ascii(F.substring("filter_order", i, F.lit(1))) - ord("A")).cast("int"))
    steps = steps.withColumn("bits", letters)
    steps = steps.select(
        "part", "filter_order", "step", "cells", F.col("bits")[F.col("step") - 1].alias("own"),
        F.aggregate(F.slice("bits", 1, F.col("step") - 1), F.lit(0), lambda a, b: a + b).alias("before"),
    )
    own, before = F.col("own"), F.col("before")

    def total(value: str, condition: Callable[[Column], Column]) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + F.when(condition(c.mask), c[value]).otherwise(0)).alias(value)

    def has(mask: Column, bits: Column) -> Column:
        return mask.bitwiseAND(bits) != 0

    # a document that fails k filters is removed by each of them in 120 / k of the orders
    share = F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + F.when(has(c.mask, own), c.n * (len(ORDERS) / F.bit_count(c.mask)).cast("long")).otherwise(0))
    return steps.select(
        "part", "filter_order", "step",
        total("n", lambda m: ~has(m, own) & ~has(m, before)).alias("kept"), total("n", lambda m: has(m, own) & ~has(m, before)).alias("removed"),
        total("n", lambda m: has(m, own) & has(m, before)).alias("redundant"), total("n", lambda m: m == own).alias("unique_fails"),
        total("good", lambda m: has(m, own) & ~has(m, before)).alias("good_lost"), total("toxic", lambda m: has(m, own) & ~has(m, before)).alias("toxic_lost"),
        share.alias("shapley"),
    )


def filter_audit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
    hashed: Callable[[Column, int, int], Column] = block_hash,
) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): 600 rows a part."""
    failed = masks(docs, id_col, text_col, part_col, hashed)
    # rows of one id, part and mask are one row before they meet their labels
    rows = failed.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))
    said = labels.groupBy(F.col(id_col).cast("long").alias("labelled")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = rows.where("doc_id is not null").join(said, F.col("doc_id") == F.col("labelled"), "left").unionByName(rows.where("doc_id is null"), allowMissingColumns=True)
    n = F.col("n")
    counts = rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(n * F.coalesce("good", F.lit(0))).alias("good"), F.sum(n * F.coalesce("toxic", F.lit(0))).alias("toxic"))
    return interactions(counts)
