"""Token ids in files of Simple-8b words.

A 64-bit word holds a selector in its highest four bits and as many ids as the selector says in the
other 60, the first id lowest. Ids are coded in blocks of 1,024; every block starts with a new
word, and its first word and first escape are kept, so any block can be decoded alone and all
blocks at once. A field of ones is an escape: the id stands in the block's list of escapes, in
order. For every word the selector that spends the fewest bits an id is taken, escapes included
(of equal ones that with more ids).

A file is a Parquet file of the shared folder, written by Spark, so that a task that is run
again leaves nothing behind. Its rows are segments: whole documents of about 262,144 ids, or one
longer document. Files and the segments in them stand in ascending order of id. The payload of a segment
is little-endian: the bytes ``S8B1``; six 32-bit numbers (documents, ids, ids in a block, blocks,
words, escapes); the ids in each document, first word and first escape of each block, escapes
(32 bits each); the words (64 bits each).

Null texts are empty: they are one end id. Rows without an id come first. Rows of one id are in
the order of a hash of their texts, repeated rows one after the other. Every row is in the files as
often as it occurs. An empty table gives no segments. Other columns are ignored. A text of any
length is coded whole, by one worker; a document has fewer than 2^32 ids.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import Tokens
from .textcols import parts_for, release, slices

BLOCK = 1024
SEGMENT = 1 << 18
#: (ids in a word, bits of an id) by selector; ids of no bits are all 0.
SELECTORS = [(240, 0), (120, 0), *((60 // bits, bits) for bits in (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60))]
_COUNTS, _BITS = (np.array(x, np.int64) for x in zip(*SELECTORS, strict=True))
_GAPS = b" \t\n\v\f\r"
_REACH = max(n for n, _ in SELECTORS)
_TOGETHER = 32
_MAGIC = b"S8B1"
_U = np.uint64

SEGMENT_DDL = "shard int, ahead long, n_ids long, first_id long, last_id long, doc_ids array<long>, payload binary"


def _choices(ids: np.ndarray) -> np.ndarray:
    """The selector to take at each place of rows of ids that are filled up with zeros by as many as a word can hold."""
    rows, width = ids.shape
    width -= _REACH
    best, cost = np.zeros((rows, width), np.uint8), np.full((rows, width), np.inf, np.float32)
    escapes = np.zeros((rows, width + _REACH + 1), np.int32)
    usual = np.inf  # what any word costs at most
    for selector in range(len(SELECTORS) - 1, -1, -1):  # of equal ones the last stays: more ids
        count, bits = SELECTORS[selector]
        if bits < 32:
            np.cumsum(ids > 0 if not bits else ids >= (1 << bits) - 1, axis=1, out=escapes[:, 1:])
        needed = escapes[:, count : count + width] - escapes[:, :width]
        least, each = np.float32(64 / count), np.float32(32 / count if bits else np.inf)
        if needed.min() and least + needed.min() * each > usual:
            continue
        own = needed.astype(np.float32) * each + least if bits else np.where(needed, each, least)
        better = own <= cost
        np.copyto(cost, own, where=better)
        np.copyto(best, np.uint8(selector), where=better)
        usual = min(usual, float(cost.max()))
    return best


def encode(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of each block, escapes, first escape of each block) of unsigned 32-bit ids."""
    n, n_blocks = len(ids), -(-len(ids) // block)
    if not n:
        return np.empty(0, _U), np.empty(0, np.int64), np.empty(0, np.uint32), np.empty(0, np.int64)
    # what follows the end of a block fits in any word
    grid = np.zeros((n_blocks, block + _REACH), np.uint32)
    whole = n // block
    grid[:whole, :block] = ids[: whole * block].reshape(whole, block)
    grid[whole:, : n - whole * block] = ids[whole * block :]
    # some blocks at a time, so that what is compared stays in a processor's cache
    best = np.concatenate([_choices(grid[i : i + _TOGETHER]) for i in range(0, n_blocks, _TOGETHER)])
    # the words of all blocks are found side by side, one word of each at a time; places are those of all blocks in a row
    at = np.arange(n_blocks) * block
    stops = np.minimum(at + block, n)
    flat, begins = best.ravel(), np.zeros(n_blocks * block, bool)
    while len(at):
        begins[at] = True
        at = at + _COUNTS[flat[at]]
        live = at < stops
        if not live.all():
            at, stops = at[live], stops[live]
    begin = np.flatnonzero(begins)
    selector = flat[begin]
    words = selector.astype(_U) << _U(60)
    row = begin // block
    place = begin + row * _REACH  # in the grid
    fill, escaped = grid.ravel(), np.zeros(grid.size, bool)
    for s in np.unique(selector).tolist():
        count, bits = SELECTORS[s]
        if not bits:
            continue
        own = np.flatnonzero(selector == s)
        most = (1 << bits) - 1
        places = place[own, None] + np.arange(count)
        fields = fill[places].astype(_U)
        over = fields >= _U(most)
        if over.any():
            escaped[places[over]] = True
            fields[over] = most
        packed = words[own]
        for k in range(count):
            packed |= fields[:, k] << _U(bits * k)
        words[own] = packed
    first_word = np.searchsorted(row, np.arange(n_blocks))
    place = np.flatnonzero(escaped)
    return words, first_word, fill[place], np.searchsorted(place // (block + _REACH), np.arange(n_blocks))


def decode(words: np.ndarray, first_word: np.ndarray, escapes: np.ndarray, first_escape: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The n ids of whole blocks: all words of one selector at a time."""
    ids = np.zeros(n, np.uint32)
    if not n:
        return ids
    selector = (words >> _U(60)).astype(np.int64)
    owner = np.searchsorted(first_word, np.arange(len(words)), "right") - 1
    ends = np.minimum((np.arange(len(first_word)) + 1) * block, n)
    # a block's words are full but for its last, so its ids start where the counts before it end
    counts = _COUNTS[selector]
    before = np.cumsum(counts) - counts
    begin = owner * block + before - before[first_word[owner]]
    room = ends[owner] - begin
    escaped = np.zeros(n, bool)
    for s, (count, bits) in enumerate(SELECTORS):
        own = np.flatnonzero(selector == s)
        if not bits or not len(own):
            continue
        most = _U((1 << bits) - 1)
        for k in range(count):
            own = own[room[own] > k]
            values = (words[own] >> _U(bits * k)) & most
            places = begin[own] + k
            ids[places] = values
            escaped[places[values == most]] = True
    ids[escaped] = escapes[: np.count_nonzero(escaped)]
    return ids


def to_payload(ids: np.ndarray, sizes: np.ndarray) -> bytes:
    words, first_word, escapes, first_escape = encode(ids)
    head = np.array([len(sizes), len(ids), BLOCK, len(first_word), len(words), len(escapes)], "<u4")
    return _MAGIC + head.tobytes() + b"".join(x.astype("<u4").tobytes() for x in (sizes, first_word, first_escape, escapes)) + words.astype("<u8").tobytes()


def from_payload(payload: bytes, only: range | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ids in each document); ``only`` some blocks, which are decoded alone."""
    if payload[:4] != _MAGIC:
        raise ValueError("not a segment of Simple-8b words")
    docs, n, block, blocks, n_words, n_escapes = np.frombuffer(payload, "<u4", 6, 4).tolist()
    at, parts = 28, []
    for size in (docs, blocks, blocks, n_escapes):
        parts.append(np.frombuffer(payload, "<u4", size, at).astype(np.int64))
        at += 4 * size
    sizes, first_word, first_escape, escapes = parts
    words = np.frombuffer(payload, "<u8", n_words, at)
    if len(payload) != at + 8 * n_words or sizes.sum() != n:
        raise ValueError("a damaged segment of Simple-8b words")
    if only is not None:
        a, b = min(only.start, blocks), min(only.stop, blocks)
        word_edges, escape_edges = np.append(first_word, n_words), np.append(first_escape, n_escapes)
        words, escapes = words[word_edges[a] : word_edges[b]], escapes[escape_edges[a] : escape_edges[b]]
        first_word, first_escape, n = first_word[a:b] - word_edges[a], first_escape[a:b] - escape_edges[a], min(b * block, n) - a * block
    return decode(words, first_word, escapes, first_escape, n, block), sizes


class LibraryTokens(Tokens):
    """Ids by the ``tokenizers`` library, which encodes each distinct piece of text once."""

    def __init__(self, path: str):
        super().__init__(path)
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a worker has one core
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._line = self._library.encode("\n", add_special_tokens=False).ids[0]

    def _pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces that do not end white are encoded in one text, a line each: a line end before them is a piece of its own."""
        line = np.array([p[-1] not in _GAPS and (p[-1] < 128 or not p.decode().isspace()) and p not in self._added for p in pieces], bool)
        at, sizes = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        parts, used = [], 0
        if line.any():
            text = b"\n".join(p for p, own in zip(pieces, line.tolist(), strict=True) if own).decode()
            ids = np.array(self._library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.append(np.flatnonzero(ids == self._line), len(ids))
            if len(ends) == line.sum():
                at[line] = np.append(0, ends[:-1] + 1)
                sizes[line] = ends - at[line]
                parts, used = [ids], len(ids)
            else:  # another way of splitting than that of ``split``
                line[:] = False
        rest = np.flatnonzero(~line)
        coded = [x.ids for x in self._library.encode_batch_fast([pieces[i].decode() for i in rest.tolist()], add_special_tokens=False)]
        sizes[rest] = [len(x) for x in coded]
        at[rest] = used + np.cumsum(sizes[rest]) - sizes[rest]
        return np.concatenate([*parts, np.array([i for x in coded for i in x], np.uint32)]), at, sizes


@lru_cache(2)
def _library(path: str) -> LibraryTokens:
    return LibraryTokens(path)


def _segments(path: str, end: int, size: int):
    """Texts in order as segments of whole documents."""
    schema = pa.schema([
        ("shard", pa.int32()), ("ahead", pa.int64()), ("n_ids", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("payload", pa.binary()),
    ])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _library(path)
        shard, ahead, waiting = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        names: list[int | None] = []

        def segment() -> pa.RecordBatch:
            payload = to_payload(np.concatenate(held), np.array([len(x) for x in held]))
            row = [shard, ahead, waiting, names[0], names[-1], list(names), payload]
            return pa.record_batch([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for rows, data, offsets in slices(batches, limit=2 << 20):
            ids, at = coder.encode(data, offsets)
            for name, a, b in zip(rows.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                own = np.append(ids[a:b], np.uint32(end))
                if held and waiting + len(own) > size:
                    yield segment()
                    ahead += waiting
                    held, names, waiting = [], [], 0
                held.append(own)
                names.append(name)
                waiting += len(own)
        if held:
            yield segment()
        release()

    return work


def write_ids(docs: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text", end: int = 0, shard_bytes: int = 128 << 20, segment: int = SEGMENT) -> None:
    """Write the ids of all texts to files under ``path``, in ascending order of id; about ``shard_bytes`` of text a file."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.xxhash64(text).alias("tie"), text.alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    # rows of one id, and repeated ones, are parted by their rows
    ordered = rows.repartitionByRange(max(parts_for(docs), -(-total // shard_bytes)), "doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row")
    files = ordered.select("doc_id", "text").mapInArrow(_segments(tokenizer, end, segment), SEGMENT_DDL)
    files.write.option("compression", "none").parquet(path)


def _documents(with_ids: bool):
    """Segments as documents."""
    names = ["doc_id", "shard", "ahead", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, sizes = from_payload(batch.column("payload")[i].as_py())
                stops = np.cumsum(sizes)
                raw = memoryview(ids.astype("<u4")).cast("B")
                own = [raw[4 * (b - n) : 4 * b] for b, n in zip(stops.tolist(), sizes.tolist(), strict=True)]
                shard = pa.array(np.full(len(sizes), batch.column("shard")[i].as_py(), np.int32))
                columns = [batch.column("doc_ids")[i].values, shard, pa.array(stops - sizes + batch.column("ahead")[i].as_py()), pa.array(sizes), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                yield pa.record_batch(columns + ([pa.array([bytes(x) for x in own], pa.binary())] if with_ids else []), names)
        release()

    return work


def read_ids(spark, path: str, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) from the files: ``ids`` are little-endian unsigned 32-bit, ``start`` counts those of all documents before.

    The totals of files, of which there are as many as tasks that wrote them, are added up first.
    """
    files = spark.read.parquet(path)
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()  # one row a file
    starts, at = [], 0
    for row in totals:
        starts.append((row["shard"], at))
        at += row["n"]
    before = spark.createDataFrame(starts, "shard int, before long")
    more = ["ids"] if with_ids else []
    rows = files.select("shard", "ahead", "doc_ids", "payload").mapInArrow(_documents(with_ids), "doc_id long, shard int, ahead long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
    out = rows.join(F.broadcast(before), "shard")  # one row a file
    return out.select(F.col("doc_id").alias(id_col), (F.col("before") + F.col("ahead")).alias("start"), "n_tokens", "ids_crc32", *more)
