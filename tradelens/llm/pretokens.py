"""Byte-level BPE ids of whole slices of text.

The split pattern of the vocabulary is applied to all characters of a slice at once; each
distinct piece is encoded once and its ids are kept by two 64-bit hashes of it. The ids are those of the
``tokenizers`` library on the same file; as there, strings of added tokens are cut out of a text
first and have their own ids.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np

from .textcols import piece_hashes

# The code points of the Unicode property White_Space.
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3


@lru_cache(1)
def _classes() -> np.ndarray:
    kinds = {"L": _LETTER, "N": _NUMBER}
    table = np.full(0x110000, _OTHER, np.uint8)
    # planes from 4 on have neither letters nor numbers
    table[:0x40000] = [kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x40000)]
    table[_WHITE] = _SPACE
    return table


def split(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Starts of the pieces of ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.

    ``first`` marks the first character of each document; no piece crosses it.
    """
    n = len(codes)
    kind = _classes()[codes]
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    # the last white character before a word: a blank joins the word, any other stands alone
    word = np.flatnonzero((kind[1:] != _SPACE) & (kind[:-1] == _SPACE) & ~first[1:]) + 1
    start[word - 1] = True
    start[word[codes[word - 1] == 32]] = False
    quote = np.flatnonzero((codes == 39) & start)
    quote = quote[quote + 1 < n]
    quote = quote[~first[quote + 1] & (kind[quote + 1] == _LETTER)]
    if len(quote):
        one = np.isin(codes[quote + 1], [ord(c) for c in "stmd"])
        ends = quote[one]
        start[ends + 1] = False
        ends = ends[ends + 2 < n]
        start[ends + 2] = True
        pairs = quote[~one]
        pairs = pairs[pairs + 2 < n]
        pairs = pairs[~first[pairs + 2]]
        a, b = codes[pairs + 1], codes[pairs + 2]
        pairs = pairs[(((a == ord("r")) | (a == ord("v"))) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))]
        start[pairs + 1] = False
        pairs = pairs[pairs + 3 < n]
        start[pairs + 3] = True
    return np.flatnonzero(start)


def _byte_alphabet() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write bytes as."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokens:
    """Ids of byte-level BPE pieces, from the JSON file of the ``tokenizers`` library."""

    def __init__(self, path: str, most: int = 1_000_000):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec.get("added_tokens", [])
        if any(t.get(flag) for t in added for flag in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take in what stands beside them are not known here")
        letters = _byte_alphabet()
        self._added = {t["content"].encode(): [t["id"]] for t in added}
        self._cut = re.compile(b"|".join(re.escape(x) for x in sorted(self._added, key=len, reverse=True))) if added else None
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token.encode() not in self._added}
        self._coder = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        #: The narrowest little-endian type that holds every id.
        self.width = "<u2" if max([*ranks.values(), *(i[0] for i in self._added.values())]) < 1 << 16 else "<u4"
        self.most = most
        self._clear()

    def _piece(self, piece: bytes) -> list[int]:
        return self._added.get(piece) or self._coder.encode_ordinary(piece.decode())

    def _pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where those of each piece begin, how many they are)."""
        ids = [self._piece(x) for x in pieces]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), np.cumsum(sizes) - sizes, sizes

    def _added_at(self, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, stop) of the added tokens, leftmost first; none crosses documents."""
        found, at = [], 0
        while self._cut and (hit := self._cut.search(raw, at)):
            a, b = hit.span()
            whole = offsets[np.searchsorted(offsets, a, "right")] >= b
            if whole:
                found.append((a, b))
            at = b if whole else a + 1
        return tuple(np.array(found, np.int64).reshape(-1, 2).T)

    def _clear(self) -> None:
        # hashes in ascending order and the slot of each; slots are in the order in which pieces came
        self._keys, self._slot = np.empty(0, np.uint64), np.empty(0, np.int32)
        self._other, self._again = np.empty(0, np.uint64), np.empty(0, bool)
        self._at, self._size = np.empty(0, np.int64), np.empty(0, np.int64)
        self._ids = np.empty(0, np.uint32)

    def _trim(self) -> None:
        """Keep the pieces that were met again since they came; all go where that leaves too many."""
        keep = np.flatnonzero(self._again)
        if len(keep) > self.most // 2:
            return self._clear()
        size = self._size[keep]
        ends = np.cumsum(size)
        self._ids = self._ids[np.repeat(self._at[keep] - (ends - size), size) + np.arange(int(size.sum()))]
        stay = self._again[self._slot]
        slots = np.cumsum(self._again, dtype=np.int32) - np.int32(1)
        self._keys, self._slot = self._keys[stay], slots[self._slot[stay]]
        self._at, self._size, self._other = ends - size, size, self._other[keep]
        self._again = np.zeros(len(keep), bool)

    def _find(self, keys: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Slots of pieces by both hashes, -1 for those not met yet."""
        if not len(self._keys):
            return np.full(len(keys), -1, np.int64)
        place = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        slot = np.where(self._keys[place] == keys, self._slot[place], -1).astype(np.int64)
        if (self._other[slot] != other)[slot >= 0].any():  # another piece with the same first hash
            self._clear()
            slot[:] = -1
        return slot

    def _add(self, pieces: list[bytes], keys: np.ndarray, other: np.ndarray) -> None:
        """Encode new pieces, which come in ascending order of their hashes."""
        ids, at, sizes = self._pieces(pieces)
        have, n = len(self._keys), len(pieces)
        own = np.searchsorted(self._keys, keys) + np.arange(n)
        old = np.ones(have + n, bool)
        old[own] = False
        for name, new in (("_keys", keys), ("_slot", np.arange(have, have + n, dtype=np.int32))):
            merged = np.empty(have + n, new.dtype)
            merged[own], merged[old] = new, getattr(self, name)
            setattr(self, name, merged)
        self._at = np.concatenate([self._at, len(self._ids) + at])
        self._size = np.concatenate([self._size, sizes])
        self._other = np.concatenate([self._other, other])
        self._ids = np.concatenate([self._ids, ids])
        self._again = np.concatenate([self._again, np.zeros(n, bool)])

    def _known(self, raw: bytes, begin: np.ndarray, stop: np.ndarray, keys: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Slots of distinct pieces, which come in ascending order of their hashes; new ones are encoded."""
        slot = self._find(keys, other)
        new = np.flatnonzero(slot < 0)
        self._again[slot[slot >= 0]] = True
        if len(new) and len(self._keys) + len(new) > self.most:
            self._trim()
            slot = self._find(keys, other)
            new = np.flatnonzero(slot < 0)
        if len(new):
            slot[new] = np.arange(len(self._keys), len(self._keys) + len(new))
            self._add([raw[a:b] for a, b in zip(begin[new].tolist(), stop[new].tolist(), strict=True)], keys[new], other[new])
        return slot

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents, offsets by document) of UTF-8 bytes."""
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
        raw = data.tobytes()
        head = (data & 0xC0) != 0x80
        at = np.append(np.flatnonzero(head), len(data))
        codes = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        first = np.zeros(len(codes), bool)
        chars = np.searchsorted(at, offsets)
        first[chars[:-1][chars[:-1] < len(codes)]] = True
        cut, uncut = self._added_at(raw, offsets)
        edges = np.searchsorted(at, np.concatenate([cut, uncut]))
        first[edges[edges < len(codes)]] = True  # what stands around an added token is split on its own
        begin = at[split(codes, first)]
        if len(cut):  # nothing starts inside one
            inside = np.searchsorted(cut, begin, "left") - 1
            begin = begin[(inside < 0) | (begin >= uncut[np.maximum(inside, 0)])]
        stop = np.append(begin[1:], len(data))
        key, other = piece_hashes(data, begin, stop)
        order = np.argsort(key)
        keys = key[order]
        head = np.append(True, keys[1:] != keys[:-1])
        one, inverse = order[head], np.empty(len(key), np.int64)
        inverse[order] = np.cumsum(head) - 1
        if (other != other[one][inverse]).any():  # two pieces of one hash: told apart by their bytes
            names: dict[bytes, int] = {}
            inverse = np.array([names.setdefault(raw[a:b], len(names)) for a, b in zip(begin.tolist(), stop.tolist(), strict=True)], np.int64)
            store, at, size = self._pieces(list(names))
            at, size = at[inverse], size[inverse]
        else:
            where = self._known(raw, begin[one], stop[one], keys[head], other[one])[inverse]
            store, at, size = self._ids, self._at[where], self._size[where]
        ends = np.cumsum(size)
        ids = store[np.repeat(at - (ends - size), size) + np.arange(int(ends[-1]))]
        per = np.searchsorted(begin, offsets)
        return ids, np.append(0, ends)[per]


@lru_cache(2)
def tokens(path: str) -> Tokens:
    """One tokenizer for each file and worker process."""
    return Tokens(path)
