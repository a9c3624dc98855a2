"""ISO base media containers: written, walked and described without decoding a payload.

A payload becomes a track of raw 8-bit grey frames of 24 x 24 samples (576 bytes), one sample
each, with every ``sync_every``-th frame listed as a sync sample. Reading walks the nested boxes
(32-bit, 64-bit and to-the-end sizes), decodes the sample tables, those of movie fragments
included, and gives the byte range, time and sync flag of every sample; sample bytes are only ever
copied. Features are those of the first track.

Null texts are empty: their payload is one frame of bytes 255. A container that is cut off or
has broken tables gives a row with ``error`` set and null features. Equal payloads give equal
containers, an empty table no rows. Long texts are stored whole, past 4 GB with 64-bit offsets.
Other columns are ignored.
"""

from __future__ import annotations

import struct
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcols import SLICE_BYTES, id_or_least, null_if_least, slices

FRAME = 576
_PARENTS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"moof", b"traf", b"mvex"}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, flags: int, *parts: bytes, version: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def write_media(payload: bytes, width: int = 24, height: int = 24, timescale: int = 25, sync_every: int = 16, chunk_frames: int = 8) -> bytes:
    """A container with one track of raw grey frames."""
    frame = width * height
    n = len(payload) // frame
    if n * frame != len(payload) or not n:
        raise ValueError("the payload must be a positive multiple of one frame")
    starts = range(0, n, chunk_frames)
    large = len(payload) + 4096 + 8 * len(starts) + 4 * (n // sync_every + 1) >= 1 << 32
    entry = box(
        b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", width, height, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 40, -1)
    )
    last = n % chunk_frames or chunk_frames
    chunks = [(1, chunk_frames, 1)] if last == chunk_frames else ([(1, last, 1)] if n < chunk_frames else [(1, chunk_frames, 1), (len(starts), last, 1)])
    sync = range(1, n + 1, sync_every)

    def head(base: int) -> bytes:
        places = [base + s * frame for s in starts]
        table = box(
            b"stbl",
            full(b"stsd", 0, struct.pack(">I", 1), entry),
            full(b"stts", 0, struct.pack(">III", 1, n, 1)),
            full(b"stss", 0, struct.pack(f">I{len(sync)}I", len(sync), *sync)),
            full(b"stsc", 0, struct.pack(">I", len(chunks)), *(struct.pack(">III", *c) for c in chunks)),
            full(b"stsz", 0, struct.pack(">II", frame, n)),
            full(b"co64", 0, struct.pack(f">I{len(places)}Q", len(places), *places)) if large else full(b"stco", 0, struct.pack(f">I{len(places)}I", len(places), *places)),
        )
        media = box(
            b"mdia",
            full(b"mdhd", 0, struct.pack(">QIIHH", 0, timescale, n, 0x55C4, 0)),
            full(b"hdlr", 0, struct.pack(">I4s", 0, b"vide"), bytes(12), b"frames\0"),
            box(b"minf", full(b"vmhd", 1, bytes(8)), box(b"dinf", full(b"dref", 0, struct.pack(">I", 1), full(b"url ", 1))), table),
        )
        track = box(b"trak", full(b"tkhd", 7, struct.pack(">QIII", 0, 1, 0, n), bytes(16), _MATRIX, struct.pack(">II", width << 16, height << 16)), media)
        movie = full(b"mvhd", 0, struct.pack(">QIIIH", 0, timescale, n, 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41") + box(b"moov", movie, track)

    data = box(b"mdat", payload)
    size = len(head(0))
    return head(size + len(data) - len(payload)) + data


def walk(data, start: int = 0, stop: int | None = None, path: tuple = ()) -> Iterator[tuple[tuple, int, int]]:
    """(path of box types, body start, body end) of every box, parents before children."""
    stop = len(data) if stop is None else stop
    while start < stop:
        if stop - start < 8:
            raise ValueError("a box header is cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if stop - start < 16:
                raise ValueError("a box header is cut off")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        end = stop if size == 0 else start + size
        if end > stop or end < body:
            raise ValueError(f"box {kind!r} does not fit its parent")
        own = (*path, kind)
        yield own, body, end
        if kind in _PARENTS:
            yield from walk(data, body, end, own)
        start = end


def _ints(data, at: int, count: int, code: str = "I") -> tuple:
    return struct.unpack_from(f">{count}{code}", data, at)


def _fits(data, count: int, least: int, what: str) -> None:
    """A table can't count more entries than the file has bytes for."""
    if count * least > len(data):
        raise ValueError(f"{what} counts more than the file holds")


def _tables(data, table: dict) -> list[tuple]:
    """Samples (offset, size, time, sync) of one track's sample tables."""
    body = table[b"stsz"][0]
    same, n = _ints(data, body + 4, 2)
    _fits(data, n, same or 4, "the size table")
    sizes = [same] * n if same else list(_ints(data, body + 12, n))
    body = table[b"stts"][0]
    times, now = [], 0
    for i in range(_ints(data, body + 4, 1)[0]):
        count, delta = _ints(data, body + 8 + 8 * i, 2)
        if len(times) + count > n:
            raise ValueError("the sample tables disagree")
        times += range(now, now + count * delta, delta) if delta else [now] * count
        now += count * delta
    wide = b"co64" in table
    body = table[b"co64" if wide else b"stco"][0]
    places = _ints(data, body + 8, _ints(data, body + 4, 1)[0], "Q" if wide else "I")
    body = table[b"stsc"][0]
    runs = [_ints(data, body + 8 + 12 * i, 3) for i in range(_ints(data, body + 4, 1)[0])]
    firsts = [r[0] for r in runs]
    offsets: list[int] = []
    for chunk, place in enumerate(places, 1):
        for _ in range(runs[bisect_right(firsts, chunk) - 1][1]):
            if len(offsets) == n:
                break
            offsets.append(place)
            place += sizes[len(offsets) - 1]
    if len(offsets) != n or len(times) != n:
        raise ValueError("the sample tables disagree")
    sync = range(1, n + 1)
    if b"stss" in table:
        body = table[b"stss"][0]
        sync = set(_ints(data, body + 8, _ints(data, body + 4, 1)[0]))
    return list(zip(offsets, sizes, times, (i in sync for i in range(1, n + 1)), strict=True))


def _fields(data, body: int, flags: int, *known: tuple[int, str, str]) -> tuple[dict, int]:
    """Fields that stand in a box only where their flag is set: (values by name, end)."""
    out, at = {}, body
    for bit, name, code in known:
        if flags & bit:
            (out[name],) = struct.unpack_from(f">{code}", data, at)
            at += struct.calcsize(code)
    return out, at


def _fragment(data, start: int, boxes: list[tuple[bytes, int, int]], tracks: dict[int, dict]) -> None:
    """Append the samples of one track fragment of the movie fragment that starts at ``start``."""
    track, place = None, start
    for kind, body, _ in boxes:
        flags = _ints(data, body, 1)[0] & 0xFFFFFF
        if kind == b"tfhd":
            track = tracks[_ints(data, body + 4, 1)[0]]
            own, _ = _fields(data, body + 8, flags, (0x1, "base", "Q"), (0x2, "entry", "I"), (0x8, "duration", "I"), (0x10, "size", "I"), (0x20, "flags", "I"))
            default = track["default"] | own
            base = own.get("base", start)
            place = base
        elif kind == b"tfdt" and track is not None:
            track["now"] = _ints(data, body + 4, 1, "Q" if data[body] else "I")[0]
        elif kind == b"trun" and track is not None:
            (count,) = _ints(data, body + 4, 1)
            run, at = _fields(data, body + 8, flags, (0x1, "offset", "i"), (0x4, "first", "I"))
            each = 4 * bin(flags & 0xF00).count("1")
            _fits(data, count, each or default.get("size", 0) or 1, "a fragment's run")
            place = base + run["offset"] if "offset" in run else place
            for i in range(count):
                own, at = _fields(data, at, flags, (0x100, "duration", "I"), (0x200, "size", "I"), (0x400, "flags", "I"), (0x800, "shift", "I"))
                mark = own.get("flags", run["first"] if i == 0 and "first" in run else default.get("flags", 0))
                size = own.get("size", default.get("size", 0))
                track["samples"].append((place, size, track["now"], not mark & 0x10000))
                place += size
                track["now"] += own.get("duration", default.get("duration", 0))


def sample_table(data) -> list[dict]:
    """Tracks with codec, timescale, duration and samples (offset, size, time, sync)."""
    tracks: list[dict] = []
    defaults: dict[int, dict] = {}
    fragments: list[tuple[int, list]] = []
    moof = 0
    for path, body, end in walk(data):
        kind = path[-1]
        if path == (b"moov", b"trak"):
            tracks.append({"tables": {}})
        elif path[:2] == (b"moov", b"trak") and kind not in _PARENTS:
            tracks[-1]["tables"][kind] = (body, end)
        elif path == (b"moov", b"mvex", b"trex"):
            number, entry, duration, size, flags = _ints(data, body + 4, 5)
            defaults[number] = {"entry": entry, "duration": duration, "size": size, "flags": flags}
        elif path == (b"moof",):
            moof = body - (16 if data[body - 16 : body - 8] == b"\0\0\0\1moof" else 8)
        elif path == (b"moof", b"traf"):
            fragments.append((moof, []))
        elif path[:2] == (b"moof", b"traf"):
            fragments[-1][1].append((kind, body, end))
    by_number: dict[int, dict] = {}
    for track in tracks:
        table = track.pop("tables")
        body = table[b"mdhd"][0]
        track["timescale"], track["duration"] = _ints(data, body + 20, 1) + _ints(data, body + 24, 1, "Q") if data[body] else _ints(data, body + 12, 2)
        track["handler"] = bytes(data[table[b"hdlr"][0] + 8 : table[b"hdlr"][0] + 12]).decode("latin-1")
        track["codec"] = bytes(data[table[b"stsd"][0] + 12 : table[b"stsd"][0] + 16]).decode("latin-1")
        track["width"], track["height"] = _ints(data, table[b"stsd"][0] + 8 + 32, 2, "H")
        track["samples"] = _tables(data, table)
        number = _ints(data, table[b"tkhd"][0] + (20 if data[table[b"tkhd"][0]] else 12), 1)[0]
        by_number[number] = track | {"now": track["duration"], "default": defaults.get(number, {})}
    for start, boxes in fragments:
        _fragment(data, start, boxes, by_number)
    for track, more in zip(tracks, by_number.values(), strict=True):
        track["duration"] = max(track["duration"], more["now"])
        if any(o < 0 or o + s > len(data) for o, s, _, _ in track["samples"]):
            raise ValueError("a sample lies outside the file")
    return tracks


_KEY = pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("time", pa.int64())])
_FEATURES = [("codec", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("timescale", pa.int64()), ("duration", pa.int64()), ("n_samples", pa.int64()), ("keyframes", pa.list_(_KEY)), ("error", pa.string())]
_FEATURES_DDL = "codec string, width int, height int, timescale long, duration long, n_samples long, keyframes array<struct<offset:long,length:long,time:long>>, error string"


def described(data) -> tuple[tuple, list[tuple]]:
    """(features, samples) of the first track; a broken file has no samples."""
    try:
        track = sample_table(data)[0]
    except (ValueError, KeyError, IndexError, struct.error) as e:
        return (None, None, None, None, None, None, None, str(e) or type(e).__name__), []
    keys = [{"offset": o, "length": s, "time": t} for o, s, t, k in track["samples"] if k]
    return (track["codec"], track["width"], track["height"], track["timescale"], track["duration"], len(track["samples"]), keys, None), track["samples"]


def features(data) -> tuple:
    """Codec, frame size, timescale, duration, samples and keyframe byte ranges of the first track, and an error."""
    return described(data)[0]


def _runs(samples: list[tuple]) -> Iterator[tuple[int, int]]:
    """Byte ranges of the samples in order, neighbours joined."""
    start = end = None
    for offset, size, _, _ in samples:
        if offset == end:
            end += size
            continue
        if start is not None:
            yield start, end
        start, end = offset, offset + size
    if start is not None:
        yield start, end


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in slices(batches, "text", 4 * SLICE_BYTES):
        raw = data.tobytes()
        made = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            padded = max(1, -(-(b - a) // FRAME)) * FRAME
            made.append(write_media(raw[a:b] + b"\xff" * (padded - (b - a))))
        yield pa.record_batch([rows.column("id"), pa.array(np.diff(offsets)), pa.array(made, pa.binary())], names=["id", "n_bytes", "media"])


def _describe(with_payload: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches, "media", 4 * SLICE_BYTES):
            found, payloads = [], []
            raw = data.tobytes()
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                own = raw[a:b]
                about, samples = described(own)
                found.append(about)
                if with_payload:
                    payloads.append(None if about[-1] else b"".join(own[x:y] for x, y in _runs(samples)))
            columns = [pa.array(c, t) for c, (_, t) in zip(zip(*found, strict=True), _FEATURES, strict=True)]
            names = [n for n, _ in _FEATURES]
            extra = [pa.array(payloads, pa.binary())] if with_payload else []
            yield pa.record_batch([*rows.columns, *columns, *extra], names=[*rows.schema.names, *names, *["payload"] * with_payload])

    return work


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text as a media file of whole frames, filled up with bytes 255."""
    text = docs.select(id_or_least(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return text.mapInArrow(_store, "id long, n_bytes long, media binary").select(null_if_least("id").alias(id_col), "n_bytes", "media")


def describe_media(files: DataFrame, media_col: str = "media", with_payload: bool = False) -> DataFrame:
    """The columns of ``files`` with the media's features, and on request the samples' bytes in order."""
    rest = files.drop(*(n for n, _ in _FEATURES), "payload").withColumnRenamed(media_col, "media")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    return rest.mapInArrow(_describe(with_payload), f"{ddl}, {_FEATURES_DDL}" + ", payload binary" * with_payload).withColumnRenamed("media", media_col)
