"""Near-duplicate groups by an LSH forest over MinHash signatures.

Each document is a set of distinct word shingles. Equal sets are one class. A class has one
label of ``depth`` MinHash values in each of ``trees`` sorted orders; classes that agree on a
long prefix of a label stand near each other. In each order a region of classes with a common
prefix is as deep as it must be to hold at most ``region`` classes; inside it each class is
compared with the classes that follow, up to ``region`` places on. Where a region stays larger
at full depth, its classes stand in another order in every tree, each is compared with the next
``crowd`` of them, and also with ``hubs`` classes that stand for the region: those that share
the most crowded regions, hence most of the values that are common there. A variant far from
all other variants still finds the text that all of them come from this way. Candidates whose whole signatures agree too little to be
links are dropped (with 64 values and similarity 0.85 that loses about one link in a million),
the others are confirmed on the full sets. Confirmation takes two rounds: first the next
neighbours of the first two orders, then only pairs that are not connected yet. What crowded
regions leave unconnected is then compared exactly: two sets that are similar enough share one of
their rarest shingles (as many of each as the threshold allows to be missing, and one), so classes
of crowded regions meet in a bucket for each of these, unless they are connected already.

Ids: a null id counts as the smallest. A node is a hash of id and text, so different texts under
one id or under none are different documents; rows with equal id and text are one. Null, empty
or blank texts have an empty set and are linked with nothing. Long texts are read whole. Of equal
ids in a component the least hash of id and text is kept; labels that are equal in all values are
ordered by a hash, in each tree anew. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import connected, hot_keys, salted, small, spread_join
from .textcols import Prefix, i64, id_or_least, lower_ascii, mix, null_if_least, parts_for, row_key, slices, stream, words

_U = np.uint64


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all documents, offsets by document)."""
    data = lower_ascii(data)
    start, stop, first = words(data, offsets)
    n = len(first) - 1
    counts = np.diff(first)
    if not len(start):
        return np.empty(0, _U), np.zeros(n + 1, np.int64)
    word = Prefix(data).of(start, stop)
    chain = Prefix(word, 1)
    long_ = np.maximum(counts - width + 1, np.minimum(counts, 1))
    document = np.repeat(np.arange(n), long_)
    step = np.arange(len(document)) - np.repeat(np.cumsum(long_) - long_, long_)
    begin = first[:-1][document] + step
    hashes = chain.of(begin, np.minimum(begin + width, first[1:][document]))
    order = np.lexsort((hashes, document))
    hashes, document = hashes[order], document[order]
    new = np.append(True, (hashes[1:] != hashes[:-1]) | (document[1:] != document[:-1]))
    hashes, document = hashes[new], document[new]
    return hashes, np.searchsorted(document, np.arange(n + 1))


def signatures(hashes: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """(documents, size) MinHash values of 32 bits; empty sets get zeros."""
    full = np.flatnonzero(np.diff(offsets) > 0)
    out = np.zeros((len(offsets) - 1, size), np.uint32)
    if len(full):
        seeds = stream(101, 2 * size)
        for j in range(size):
            value = (hashes ^ seeds[j]) * (seeds[size + j] | _U(1))
            value ^= value >> _U(29)
            out[full, j] = (np.minimum.reduceat(value * _U(0xBF58476D1CE4E5B9) >> _U(32), offsets[:-1][full])).astype(np.uint32)
    return out


_DOCS_DDL = "id long, own long, n_shingles long, set_a long, set_b long, signature binary"


def _describe(width: int, size: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches):
            hashes, at = shingle_sets(data, offsets, width)
            n = np.diff(at)
            sums = []
            for seed in (7, 8):  # an order-free hash of the set
                total = np.zeros(len(hashes) + 1, _U)
                np.cumsum(mix(hashes + stream(seed, 1)), out=total[1:])
                sums.append(mix(total[at[1:]] - total[at[:-1]] + n.astype(_U)))
            sign = signatures(hashes, at, size)
            flat = pa.array([x.tobytes() for x in sign], pa.binary())
            yield pa.record_batch([rows.column("id"), rows.column("own"), i64(n), i64(sums[0]), i64(sums[1]), flat], names=["id", "own", "n_shingles", "set_a", "set_b", "signature"])

    return work


def _sets(width: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches):
            hashes, at = shingle_sets(data, offsets, width)
            lists = pa.LargeListArray.from_arrays(pa.array(at), i64(hashes)).cast(pa.list_(pa.int64()))
            yield pa.record_batch([rows.column("id"), lists], names=["id", "shingles"])

    return work


_TREE_DDL = "tree int, label binary, id long"


def _labels(trees: int, depth: int):
    schema = pa.schema([("tree", pa.int32()), ("label", pa.binary()), ("id", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            raw = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(n, trees, depth)
            # the last part of a label orders classes whose values are all equal, in each tree anew
            tie = mix(batch.column("id").to_numpy().view(_U)[:, None] + stream(301, trees)[None, :])
            own = np.concatenate([raw, (tie >> _U(32)).astype(np.uint32)[:, :, None]], axis=2)
            data = np.ascontiguousarray(own.astype(">u4")).tobytes()
            step = 4 * (depth + 1)
            buffers = [None, pa.py_buffer(np.arange(0, len(data) + 1, step, dtype=np.int32).tobytes()), pa.py_buffer(data)]
            label = pa.BinaryArray.from_buffers(pa.binary(), n * trees, buffers)
            yield pa.record_batch([pa.array(np.tile(np.arange(trees, dtype=np.int32), n)), label, pa.array(np.repeat(batch.column("id").to_numpy(), trees))], schema=schema)

    return work


_PAIRS_DDL = "a long, b long, tree int, gap int"
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("tree", pa.int32()), ("gap", pa.int32())])


def neighbours(tree: np.ndarray, labels: np.ndarray, ids: np.ndarray, least: int, region: int, crowd: int):
    """Pairs of near neighbours in labels that are sorted inside each tree: (left index, right index, places between)."""
    n, depth = labels.shape
    common = np.zeros(n, np.int64)  # of each label with the one before it
    alike = tree[1:] == tree[:-1]
    for d in range(depth):
        alike = alike & (labels[1:, d] == labels[:-1, d])
        common[1:] += alike
    settled = np.zeros(n, bool)
    span = np.zeros(n, np.int64)  # places on, up to the end of the region
    for d in range(least, depth + 1):
        start = np.flatnonzero(common < d)
        start = start if len(start) and start[0] == 0 else np.append(0, start)
        size = np.diff(np.append(start, n))
        end = np.repeat(start + size, size)
        fits = (np.repeat(size, size) <= region) & ~settled
        last = ~settled if d == depth else fits
        reach = end - 1 - np.arange(n)
        span = np.where(fits, reach, np.where(last, np.minimum(reach, crowd), span))
        settled |= last
    # a region that had to go deeper keeps its next neighbour at the least depth too
    span = np.maximum(span, np.append(common[1:] >= least, False).astype(np.int64))
    left = np.repeat(np.arange(n), span)
    gap = np.arange(len(left)) - np.repeat(np.cumsum(span) - span, span) + 1
    return left, left + gap, gap


def _pairs(depth: int, least: int, region: int, crowd: int):
    """Candidate pairs of whole blocks; guests, the first rows of the next block, are only the right one of a pair."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(table: pa.Table):
            group = (table.column("block").to_numpy() << 16) | table.column("tree").to_numpy()
            ids, guest = table.column("id").to_numpy(), table.column("guest").to_numpy()
            labels = np.frombuffer(b"".join(table.column("label").to_pylist()), ">u4").reshape(len(ids), depth + 1)[:, :depth]
            left, right, gap = neighbours(group, labels, ids, least, region, crowd)
            keep = (ids[left] != ids[right]) & ~guest[left]
            left, right, gap = left[keep], right[keep], gap[keep]
            a, b = np.minimum(ids[left], ids[right]), np.maximum(ids[left], ids[right])
            return pa.record_batch([i64(a), i64(b), pa.array((group[left] & 0xFFFF).astype(np.int32)), pa.array(gap.astype(np.int32))], schema=_PAIRS)

        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            block = table.column("block").to_numpy()
            last = int(np.searchsorted(block, block[-1], "left"))
            if last > 50_000:
                yield out(table.slice(0, last))
                rest = table.slice(last).combine_chunks()
            else:
                rest = table
        if rest is not None:
            yield out(rest)

    return work


def hub_pairs(ordered: DataFrame, depth: int, region: int, hubs: int, tasks: int, visits: int = 3) -> tuple[DataFrame, DataFrame]:
    """(id) of all classes in crowded regions, and (a, b, tree, gap): the classes of crowded regions with the hubs of their first ``visits`` crowded regions.

    A region has one hub in each of ``hubs`` slots (a hash of the id): the class of the slot that
    stands in the most crowded regions. The first hub of all has gap 1 in tree 0: it comes in the
    first round of confirmation.
    """
    rows = ordered.select("tree", F.xxhash64("tree", F.substring("label", 1, 4 * depth)).alias("region"), "id")
    crowded = small(rows.groupBy("region").agg(F.count("*").alias("size")).where(F.col("size") > region).select("region"), tasks=tasks)
    inside = small(rows.join(crowded.hint("shuffle_hash"), "region"), tasks=tasks)
    of_class = inside.groupBy("id").agg(F.count("*").alias("rank"), F.slice(F.array_sort(F.collect_list("tree")), 1, visits).alias("visited"))
    inside = small(inside.join(of_class, "id").withColumn("slot", F.pmod(F.xxhash64("id"), F.lit(hubs))), tasks=tasks)
    ids = inside.select("id").distinct()
    best = inside.groupBy("region", "slot").agg(F.max(F.struct("rank", (-F.col("id")).alias("minus"))).alias("best"))
    lead = best.groupBy("region").agg(F.collect_list("best").alias("bests"), F.max("best").alias("lead"))
    visited = inside.where(F.array_contains("visited", F.col("tree"))).select("region", "id")
    hot = hot_keys(visited, "region")
    pairs = spread_join(salted(visited, "region", "id", hot), lead, "region", hot)
    pairs = pairs.select("id", F.explode("bests").alias("best"), "lead").select("id", (-F.col("best.minus")).alias("hub"), (F.col("best") == F.col("lead")).alias("first"))
    ends = [F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")]
    return ids, pairs.where("id <> hub").select(*ends, F.lit(0).alias("tree"), F.when(F.col("first"), 1).otherwise(2).alias("gap"))


def candidates(classes: DataFrame, trees: int, depth: int, least: int, region: int, crowd: int, hubs: int, tasks: int, block: int = 8192) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a, b, tree, gap), a < b, from (id, signature), and (id) of the classes in crowded regions.

    The sorted orders are cut to blocks of ``block`` places; each block also gets the first places
    of the next one, so no neighbours are parted wherever a task's rows end.
    """
    n, reach = parts_for(classes), max(region, crowd)
    rows = classes.mapInArrow(_labels(trees, depth), _TREE_DDL)
    ordered = small(rows.repartitionByRange(n, "tree", "label", "id").sortWithinPartitions("tree", "label", "id").withColumn("at", F.monotonically_increasing_id()), tasks=tasks)
    stretch = F.shiftright("at", 33)
    counts = ordered.groupBy(stretch.alias("stretch")).agg(F.count("*").alias("rows"))
    ahead = F.coalesce(F.sum("rows").over(Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(counts.select("stretch", ahead.alias("before")))  # one row a partition
    placed = ordered.join(starts, stretch == F.col("stretch")).withColumn("place", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    own = F.floor(F.col("place") / block)
    both = (own > 0) & (F.col("place") % block < reach)
    placed = placed.select("tree", "label", "id", own.alias("own"), F.explode(F.when(both, F.array(own, own - 1)).otherwise(F.array(own))).alias("block"))
    placed = placed.select("block", "tree", "label", "id", (F.col("block") != F.col("own")).alias("guest"))
    pairs = placed.repartition(n, "block").sortWithinPartitions("block", "tree", "label", "id").mapInArrow(_pairs(depth, least, region, crowd), _PAIRS_DDL)
    crowded, hub = hub_pairs(ordered, depth, region, hubs, tasks)
    return pairs.unionByName(hub), crowded


def rare_pairs(sets: DataFrame, percent: int, tasks: int) -> DataFrame:
    """(a, b), a < b: all pairs of different components that can be links, from (id, component, shingles).

    The order of shingles is by number of sets, rarest first. Sets of x and y shingles that are
    links share at least ``need`` = percent * (x + y) / (100 + percent), hence one of the first
    x - need + 1 of the one and of the first y - need + 1 of the other. Sets meet in a bucket for
    each of these, first by the smallest set of the bucket, then by each other's size. In a bucket
    only classes outside its largest component look for partners.
    """
    def need(x, y):
        return F.ceil(percent * (x + y) / (100 + percent))

    n, m, at = F.col("n"), F.col("m"), F.col("at")
    tokens = sets.select("id", "component", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("often"))
    hot = hot_keys(tokens, "token")
    ranked = spread_join(salted(tokens, "token", "id", hot), often, "token", hot).groupBy("id", "component", "n").agg(F.array_sort(F.collect_list(F.struct("often", "token"))).alias("ranked"))
    # with a partner of its own size or smaller, down to percent of it
    most = (n - need(n, F.ceil(n * percent / 100)) + 1).cast("int")
    rare = ranked.select("id", "component", "n", F.posexplode(F.slice("ranked", F.lit(1), most)).alias("at", "one"))
    rare = small(rare.where("one.often > 1").select("id", "component", "n", F.col("one.token").alias("token"), (at + 1).alias("at")), tasks=tasks)
    sizes = rare.groupBy("token", "component").agg(F.count("*").alias("rows"), F.min("n").alias("m")).groupBy("token")
    bucket = sizes.agg(F.max(F.struct("rows", "component")).alias("lead"), F.count("*").alias("components"), F.min("m").alias("m"))
    bucket = small(bucket.where("components > 1").select("token", F.col("lead.component").alias("lead"), "m"), tasks=tasks)
    near = rare.join(bucket, "token").where(at <= n - need(n, F.greatest(m, F.ceil(n * percent / 100))) + 1)
    near = small(near.select("token", "id", "component", "n", "at", "lead"), tasks=tasks)
    own = near.where("component <> lead").select("token", F.col("id").alias("x"), F.col("component").alias("cx"), n.alias("m"), F.col("at").alias("x_at"))
    pairs = own.join(near, "token").where("component <> cx and (component = lead or x < id)")
    pairs = pairs.where((100 * F.least(n, m) >= percent * F.greatest(n, m)) & (at <= n - need(n, m) + 1) & (F.col("x_at") <= m - need(n, m) + 1))
    return pairs.select(F.least("x", "id").alias("a"), F.greatest("x", "id").alias("b")).distinct()


def _agree(size: int, least: float, *more: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*_ENDS, *more]
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(n, size) for c in ("signature_a", "signature_b"))
            keep = pa.array((one == two).sum(axis=1) >= least * size)
            yield pa.record_batch([batch.column(c).filter(keep) for c in names], names=names)

    return work


_ENDS = ("a", "b", "_salt_a", "_salt_b")
_ENDS_DDL = "a long, b long, _salt_a int, _salt_b int"


def _dealt(pairs: DataFrame) -> tuple[DataFrame, dict[str, DataFrame | None]]:
    """Pairs (a, b, ...) ready for joins by either end, whatever number of pairs an end is in, and the ends in many."""
    hot = {end: hot_keys(pairs, end) for end in ("a", "b")}
    return salted(salted(pairs, "a", "b", hot["a"]), "b", "a", hot["b"]), hot


def _both(pairs: DataFrame, table: DataFrame, column: str, one: str, two: str, hot: dict[str, DataFrame | None], how: str = "inner") -> DataFrame:
    """Dealt pairs with ``column`` of both ends as ``one`` and ``two``, from (id, column)."""
    for end, name in (("a", one), ("b", two)):
        pairs = spread_join(pairs, table.select(F.col("id").alias(end), F.col(column).alias(name)), end, hot[end], how)
    return pairs


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, hot: dict[str, DataFrame | None]) -> DataFrame:
    """(a, b) of the dealt pairs that are links."""
    both = F.size(F.array_intersect("one", "two")).cast("long")
    rows = _both(pairs, sets, "shingles", "one", "two", hot).select("a", "b", both.alias("both"), (F.size("one") + F.size("two")).cast("long").alias("sizes"))
    return rows.where(100 * F.col("both") >= percent * (F.col("sizes") - F.col("both"))).select("a", "b")


def lsh_forest(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, width: int = 5,
    trees: int = 16, depth: int = 4, least: int = 3, region: int = 16, crowd: int = 2, hubs: int = 8, agree: float | None = None,
    with_key: bool = False,
) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each input row, and its ``row_key`` if ``with_key``.

    A component is named by its smallest id; ``kept`` are its rows with that id, of different
    texts under that id only one.

    Links join classes with 100 * intersection >= ``percent`` * union. ``agree`` is the share of
    signature values that a candidate pair must have in common to be confirmed on its sets
    (default: percent / 100 - 0.25, over five standard deviations below the threshold).
    """
    size = trees * depth
    agree = percent / 100 - 0.25 if agree is None else agree
    tasks = max(1, docs.count() // 2_000)
    text = docs.select(row_key(id_col, text_col).alias("id"), id_or_least(id_col).alias("own"), F.col(text_col).cast("string").alias("text"))
    described = small(text.mapInArrow(_describe(width, size), _DOCS_DDL).repartition(tasks), 5_000)
    full = described.where("n_shingles > 0")
    # one class for equal sets: its smallest key stands for it, its row of smallest id may be kept, and its signature is any member's
    lead = F.min(F.struct("own", "id")).alias("lead")
    classes = small(full.groupBy("set_a", "set_b").agg(F.min("id").alias("rep"), lead, F.first("signature").alias("signature")), 5_000, tasks=tasks)
    nodes = classes.groupBy(F.col("rep").alias("id")).agg(F.first("signature").alias("signature"))
    found, crowded = candidates(nodes, trees, depth, least, region, crowd, hubs, tasks)
    found = small(found.groupBy("a", "b").agg(F.max((F.col("tree") < 2) & (F.col("gap") == 1)).alias("soon")), tasks=tasks)
    found, hot = _dealt(found)
    pairs = small(_both(found, nodes, "signature", "signature_a", "signature_b", hot).mapInArrow(_agree(size, agree, "soon"), _ENDS_DDL + ", soon boolean"), tasks=tasks)
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).union(crowded).distinct()
    texts = text.join(wanted.hint("shuffle_hash"), "id", "left_semi")
    sets = small(texts.mapInArrow(_sets(width), "id long, shingles array<long>").dropDuplicates(["id"]), 2_000, tasks=tasks)
    links = small(_confirmed(pairs.where("soon"), sets, percent, hot), tasks=tasks)
    labels = connected(links, tasks=tasks).withColumnRenamed("node", "id")
    # of the rest only pairs that are not connected by now
    rest = _both(pairs.where("not soon"), labels, "component", "ca", "cb", hot, "left")
    rest = rest.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select(*_ENDS)
    links = small(links.union(_confirmed(rest, sets, percent, hot)), tasks=tasks)
    labels = connected(links, tasks=tasks)
    named = classes.join(labels, classes.rep == labels.node, "left").select("rep", "set_a", "set_b", "lead", F.coalesce("component", "rep").alias("component"))
    if not crowded.isEmpty():
        inside = sets.join(crowded, "id", "left_semi").join(named.select(F.col("rep").alias("id"), "component").dropDuplicates(["id"]), "id")
        last, hot = _dealt(small(rare_pairs(small(inside, 2_000, tasks=tasks), percent, tasks), tasks=tasks))
        last = small(_both(last, nodes, "signature", "signature_a", "signature_b", hot).mapInArrow(_agree(size, agree), _ENDS_DDL), tasks=tasks)
        labels = connected(links.union(_confirmed(last, sets, percent, hot)), tasks=tasks)
        named = classes.join(labels, classes.rep == labels.node, "left").select("rep", "set_a", "set_b", "lead", F.coalesce("component", "rep").alias("component"))
    named = small(named, tasks=tasks)
    best = named.groupBy("component").agg(F.min("lead").alias("best"))
    hot = hot_keys(named, "component")
    components = spread_join(salted(named, "component", "rep", hot), best, "component", hot).select("set_a", "set_b", "best")
    out = described.drop("signature").join(components, ["set_a", "set_b"], "left")
    linked = F.col("n_shingles") > 0
    component = F.when(linked, F.col("best.own")).otherwise(F.col("own"))
    kept = F.when(linked, F.col("best.id") == F.col("id")).otherwise(True)
    out = out.select(F.col("own").alias("id"), "n_shingles", component.alias("component_id"), kept.alias("kept"), F.col("id").alias("row_key"))
    columns = [null_if_least("id").alias(id_col), "n_shingles", null_if_least("component_id").alias("component_id"), "kept"]
    return out.select(*columns, *(["row_key"] if with_key else []))
