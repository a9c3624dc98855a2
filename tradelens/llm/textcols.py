"""Arrow text columns as flat bytes, and the prefix polynomial hashes over them.

Every operator of this subpackage that needs byte-level work receives Arrow batches from
``mapInArrow``, cuts them to slices of bounded size and computes on whole slices with numpy.
"""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import checkpoint_folder, settle

#: Bytes of text that one numpy pass works on (a longer document makes a slice of its own).
SLICE_BYTES = 1 << 20
#: Stands for a null id wherever ids are ordered: a null id comes before every other id.
NULL_ID = -(1 << 63)

_U = np.uint64


def id_or_least(name: str) -> Column:
    """The id as long, null as the least long."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def null_if_least(name: str) -> Column:
    """Undo :func:`id_or_least`."""
    return F.when(F.col(name) != F.lit(NULL_ID), F.col(name))


def row_key(id_col: str, text_col: str) -> Column:
    """A hash of id and text: rows are one document when both agree, whatever other rows have the same id or none."""
    text = F.col(text_col).cast("string")
    return F.xxhash64(id_or_least(id_col), text.isNull(), F.coalesce(text, F.lit("")))


def document_ids(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """(document, own, text, ``more``): ``document`` tells different texts apart and is ordered as ids are.

    It is the id, ``own``, where every text has one alone. Where texts share an id or lack one, it is
    a rank by id (none is the least) and two hashes of id and text, so 128 bits tell texts apart;
    rows with equal id and text are one document.
    """
    text = F.col(text_col).cast("string")
    known = [F.col(id_col).cast("long"), text.isNull(), F.coalesce(text, F.lit(""))]
    keys = {"own": known[0], "k1": F.xxhash64(*known), "k2": F.xxhash64(F.lit("other seed"), *known)}
    rows = docs.select(*(c.alias(n) for n, c in keys.items()), text.alias("text"), F.struct(F.lit(0), *more).alias("more"))
    bounds = rows.groupBy("own").agg(*(f(k).alias(f"{k}_{f.__name__}") for k in ("k1", "k2") for f in (F.min, F.max)))
    if bounds.where("own is null or k1_min <> k1_max or k2_min <> k2_max").isEmpty():
        return rows.select(F.col("own").alias("document"), "own", "text", "more.*").drop("col1")
    from .graph import hot_keys, salted, spread_join

    ordered = rows.select(*keys).distinct().repartitionByRange(parts_for(docs), *keys).sortWithinPartitions(*keys)
    ranks = settle(ordered.select("k1", F.col("k2").alias("rank_k2"), F.col("own").alias("rank_own"), F.monotonically_increasing_id().alias("document")))
    rows = rows.withColumn("spread", F.monotonically_increasing_id())
    hot = hot_keys(rows.select("k1"), "k1")
    rows = spread_join(salted(rows, "k1", "spread", hot), ranks, "k1", hot).where((F.col("k2") == F.col("rank_k2")) & F.col("own").eqNullSafe(F.col("rank_own")))
    return rows.select("document", "own", "text", "more.*").drop("col1")


def crc_remainder(name: str, modulus: int) -> Column:
    """crc32 of the id written as decimal text, modulo ``modulus``; a null id counts as ''."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def parts_for(docs: DataFrame) -> int:
    """Shuffle partitions of the session: the one place where operators read it."""
    return max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def small_batches(spark, rows: int = 2000, bytes_: int = 8 << 20):
    """Arrow batches of at most ``rows`` rows and about ``bytes_`` bytes for this session: whole texts make large rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(bytes_))
    return spark


def written(df: DataFrame) -> DataFrame:
    """The rows as Parquet in the shared checkpoint folder, read back: single columns can be read of it."""
    path = f"{checkpoint_folder(df.sparkSession)}/rows-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def narrow(df: DataFrame, rows: int, each: int = 10_000, of: DataFrame | None = None, bytes_: int = 32 << 20) -> DataFrame:
    """``df`` of about ``rows`` rows in no more tasks than hold ``each`` of them: a small table is not written as a crowd of small files.

    What ``df`` is made of in the same stage is narrowed too. Where that reads texts, ``of`` names
    them: there is at least a task for every ``bytes_`` of what Spark takes their size to be.
    """
    tasks = -(-rows // each)
    if of is not None:
        tasks = max(tasks, int(str(of._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // bytes_)
    return df.coalesce(max(1, min(tasks, 1 << 30)))


def gathered(df: DataFrame, rows: int, each: int = 10_000) -> DataFrame:
    """``df`` worked out in all its tasks, its about ``rows`` small rows then dealt to no more than hold ``each`` of them."""
    return df.repartition(max(1, -(-rows // each)))


def release() -> None:
    """Hand memory that a worker has freed back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null counts as empty."""
    column = pc.cast(column, pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) for runs of rows that hold about ``limit`` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = utf8(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start), data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]
            start = stop
    release()


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: spreads every input bit over the 64 output bits."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U((seed * 0xD1342543DE82EF95) & (2**64 - 1)))


_P = (1 << 61) - 1
_BASES = (0x9E3779B97F4A7C15 % _P, 0xC2B2AE3D27D4EB4F % _P)
_POWERS: dict[tuple[int, bool], np.ndarray] = {}
#: Numbers that are multiplied at a time: what is made in between stays in a processor's cache.
_CHUNK = 1 << 15


def _reduced(x: np.ndarray) -> np.ndarray:
    """Numbers of 64 bits modulo 2^61 - 1."""
    x = (x & _U(_P)) + (x >> _U(61))
    return np.where(x >= _U(_P), x - _U(_P), x)


def multiplied(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo 2^61 - 1 of numbers below it."""
    out = np.empty(len(a), _U)
    half, low = _U((1 << 31) - 1), _U((1 << 30) - 1)
    for at in range(0, len(a), _CHUNK):
        x, y = a[at : at + _CHUNK], b[at : at + _CHUNK]
        x1, x0, y1, y0 = x >> _U(31), x & half, y >> _U(31), y & half
        middle = x0 * y1 + x1 * y0
        out[at : at + _CHUNK] = _reduced(((x1 * y1) << _U(1)) + (middle >> _U(30)) + ((middle & low) << _U(31)) + x0 * y0)
    return out


def _powers(family: int, n: int, inverse: bool = False) -> np.ndarray:
    have = _POWERS.get((family, inverse))
    if have is None or len(have) < n:
        base = pow(_BASES[family], -1, _P) if inverse else _BASES[family]
        size = max(n, SLICE_BYTES + 1)
        have, done = np.empty(size, _U), 1
        have[0] = 1
        while done < size:
            more = min(done, size - done)
            have[done : done + more] = multiplied(have[:more], np.full(more, pow(base, done, _P), _U))
            done += more
        if n <= SLICE_BYTES + 1:  # those of a longer text are not kept
            _POWERS[family, inverse] = have
    return have[:n]


class Prefix:
    """Prefix polynomial hashes of a byte (or code) array, modulo the prime 2^61 - 1.

    ``of(start, stop)`` gives the hash of any substring in constant time, the same for equal
    substrings wherever they stand. ``family`` picks one of two independent hash functions. (Modulo
    2^64 there are short pairs of strings whose hashes are equal for every base.)
    """

    def __init__(self, codes: np.ndarray, family: int = 0):
        self.family, n = family, len(codes)
        if codes.dtype == np.uint8:
            values = _reduced(stream(family + 11, 256))[codes]
        else:
            values = _reduced(mix(codes.astype(_U) + _U(family + 0x5851F42D4C957F2D)))
        values = multiplied(values, _powers(family, n))
        self.sums = np.zeros(n + 1, _U)
        low, high = np.cumsum(values & _U(0xFFFFFFFF)), np.cumsum(values >> _U(32))
        # high * 2^32 modulo 2^61 - 1 is a turn of its bits
        self.sums[1:] = _reduced(_reduced(((high << _U(32)) & _U(_P)) + (high >> _U(29))) + _reduced(low))

    def raw(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return multiplied(_reduced(self.sums[stop] + _U(_P) - self.sums[start]), _powers(self.family, len(self.sums), True)[start])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, stop))

    def every(self, width: int) -> np.ndarray:
        """Hashes of all substrings of that width."""
        n = len(self.sums) - width
        if n <= 0:
            return np.empty(0, _U)
        return mix(multiplied(_reduced(self.sums[width:] + _U(_P) - self.sums[:n]), _powers(self.family, n, True)))


_ODD = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
_ODD_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def _odd_powers(family: int, n: int, inverse: bool = False) -> np.ndarray:
    have = _ODD_POWERS.get((family, inverse))
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), pow(_ODD[family], -1, 1 << 64) if inverse else _ODD[family], _U)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= SLICE_BYTES + 1:  # those of a longer text are not kept
            _ODD_POWERS[family, inverse] = have
    return have[:n]


class WindowPrefix(Prefix):
    """The same modulo 2^64, several times faster: for short substrings of bytes whose equality is verified afterwards.

    Strings of a thousand letters or more exist that no base tells apart here; shorter ones collide by chance only.
    """

    def __init__(self, codes: np.ndarray, family: int = 0):
        self.family = family
        values = stream(family + 11, 256)[codes]
        values *= _odd_powers(family, len(codes))
        self.sums = np.zeros(len(codes) + 1, _U)
        np.cumsum(values, out=self.sums[1:])

    def raw(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * _odd_powers(self.family, len(self.sums), True)[start]

    def every(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        if n <= 0:
            return np.empty(0, _U)
        return mix((self.sums[width:] - self.sums[:n]) * _odd_powers(self.family, n, True))


_PLACES: list[np.ndarray] = []


def piece_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of whole pieces that follow each other: sums of a random value for each byte at its place in the piece."""
    if not _PLACES:
        _PLACES.extend(stream(seed, 1 << 16) for seed in (31, 32))
    sizes = stop - start
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 1 << 22 else np.int64
    place = np.arange(total, dtype=kind) - np.repeat((ends - sizes).astype(kind), sizes)
    codes = data if total == len(data) else data[place + np.repeat(start, sizes)]
    far = np.flatnonzero(place > 255) if sizes.max(initial=0) > 256 else None
    at = ((place & 255) << 8) | codes
    out = []
    for table in _PLACES:
        values = table[at]
        if far is not None:
            values[far] = mix(values[far] + place[far].astype(_U) * _U(0x9E3779B97F4A7C15))
        sums = np.zeros(total + 1, _U)
        np.cumsum(values, out=sums[1:])
        out.append(sums[ends] - sums[ends - sizes])
    return out[0], out[1]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, first word of each document) of the words ``[^\\x20\\x09-\\x0D]+``; no word crosses documents."""
    inside = ~_SPACE[data]
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    before[edges] = False
    after[edges - 1] = False
    start, stop = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return start, stop, np.searchsorted(start, offsets)


def sums_by(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sums of ``values[firsts[i]:firsts[i+1]]``, 0 for empty ranges."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[firsts[1:]] - total[firsts[:-1]]


def i64(x: np.ndarray) -> pa.Array:
    """A 64-bit array as Spark's long."""
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == _U else x.astype(np.int64))
