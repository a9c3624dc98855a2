"""Line-first cleaning: lines are judged one by one, then documents by what they lost.

A line with a word fails when it is

* navigation: at least ``nav_marks`` separators ``| > » • ·`` with no more than three words to a
  separator, or at most ``nav_words`` words that hold a menu phrase;
* boilerplate: it holds a fixed phrase of page furniture;
* without punctuation: under ``short_words`` words and no sentence mark at its end;
* noise: more than ``noise`` of its characters outside white space are symbols.

Phrases are those of English, German, French and Spanish pages, in any case of A-Z. Failing lines
go. A document is rejected when it loses more than ``most_lost`` of its word
characters, or fails the base rules (``n_words`` < 50, or more than half of its words lie in
three-word windows that occur twice). Lines are parted by ``\\n``; a line without words never
fails. A null text has no words and is rejected. Repeated rows get equal verdicts. Long texts are
judged whole; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcols import Prefix, i64, id_or_least, lower_ascii, null_if_least, slices, sums_by, words

# Phrases of menus and of page furniture, in lower case.
MENU = [
    "home", "log in", "login", "sign up", "sign in", "menu", "next page", "previous page", "skip to content", "read more", "click here", "back to top", "search", "share this",
    "startseite", "anmelden", "registrieren", "menü", "nächste seite", "vorherige seite", "zum inhalt springen", "weiterlesen", "nach oben", "suche",
    "accueil", "connexion", "s'inscrire", "page suivante", "page précédente", "aller au contenu", "lire la suite", "haut de page", "rechercher",
    "inicio", "iniciar sesión", "registrarse", "menú", "página siguiente", "página anterior", "ir al contenido", "leer más", "volver arriba", "buscar",
]
FURNITURE = [
    "all rights reserved", "cookie policy", "we use cookies", "privacy policy", "terms of use", "terms of service", "subscribe to our newsletter", "enable javascript", "lorem ipsum",
    "alle rechte vorbehalten", "cookie-richtlinie", "wir verwenden cookies", "datenschutzerklärung", "nutzungsbedingungen", "newsletter abonnieren", "javascript aktivieren",
    "tous droits réservés", "politique de cookies", "nous utilisons des cookies", "politique de confidentialité", "conditions d'utilisation", "abonnez-vous à notre newsletter", "activer javascript",
    "todos los derechos reservados", "política de cookies", "utilizamos cookies", "política de privacidad", "términos de uso", "suscríbete a nuestro boletín", "activar javascript",
]
SENTENCE_MARKS, CLOSERS = ".!?…:;。！？", "'\")]»”’"
SEPARATORS = "|>»•·"
SYMBOLS = "#*$%&|<>"
NOISE = SYMBOLS + "{}=~^_"


def _any_of(chars: str) -> bytes:
    return b"(?:" + b"|".join(re.escape(c.encode()) for c in chars) + b")"


_CLOSED = re.compile(_any_of(SENTENCE_MARKS) + _any_of(CLOSERS) + rb"*[ \t\r]*\Z")
_MENU = re.compile(rb"(?<![a-z])(?:" + b"|".join(re.escape(x.encode()) for x in MENU) + rb")(?![a-z])")


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_SYMBOL, _NOISE, _ASCII_MARK = _table(SYMBOLS), _table(NOISE), _table("".join(c for c in SEPARATORS if c < "\x80"))
_BASE_DDL = "id long, text string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines_removed long, chars_removed long"


def _counted(flags: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum(flags))


def _marks(data: np.ndarray) -> np.ndarray:
    """Whether a separator starts at each byte."""
    out = _ASCII_MARK[data]
    for mark in (c.encode() for c in SEPARATORS if c >= "\x80"):
        here = data[: len(data) - len(mark) + 1] == mark[0]
        for k in range(1, len(mark)):
            here &= data[k : len(data) - len(mark) + 1 + k] == mark[k]
        out[: len(here)] |= here
    return out


def _holding(raw: bytes, phrases: list[str], start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Which of the lines, in order, hold one of the phrases."""
    out = np.zeros(len(start), bool)
    for phrase in (x.encode() for x in phrases):
        at = raw.find(phrase)
        while at >= 0:
            line = int(np.searchsorted(start, at, "right")) - 1
            if line >= 0 and at + len(phrase) <= stop[line]:
                out[line] = True
            at = raw.find(phrase, at + 1)
    return out


def failing(data: np.ndarray, start: np.ndarray, stop: np.ndarray, count: np.ndarray, chars: np.ndarray, nav_marks: int = 3, nav_words: int = 6, short_words: int = 8, noise: float = 0.2) -> np.ndarray:
    """Which of the lines [start, stop) with ``count`` words of ``chars`` characters fail one of the rules."""
    marks, symbols = _counted(_marks(data)), _counted(_NOISE[data])
    own = marks[stop] - marks[start]
    low = lower_ascii(data).tobytes()
    out = (own >= nav_marks) & (count <= 4 * own)
    out |= symbols[stop] - symbols[start] > noise * chars + 1e-9
    out |= _holding(low, FURNITURE, start, stop)
    for i in np.flatnonzero(~out & (count > 0) & ((count < short_words) | (count <= nav_words))).tolist():
        a, b = int(start[i]), int(stop[i])
        if not _CLOSED.search(low, a, b):
            out[i] = count[i] < short_words or bool(_MENU.search(low, a, b))
    return out & (count > 0)


def _again(hashes: np.ndarray, document: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(equal to an earlier one of its document, equal to any other of its document)."""
    order = np.lexsort((hashes, document))
    h, d = hashes[order], document[order]
    same = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
    later, any_ = np.zeros(len(h), bool), np.zeros(len(h), bool)
    later[order[1:]] = same
    any_[order] = np.append(False, same) | np.append(same, False)
    return later, any_


def _judge(rules: dict):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches):
            yield _judged(rows, data, offsets, rules)

    return work


def _judged(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, rules: dict) -> pa.RecordBatch:
    n = len(offsets) - 1
    start, stop, first = words(data, offsets)
    points = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    chars = sums_by(points[stop] - points[start], first)
    symbols = np.append(0, np.cumsum(_SYMBOL[data]))
    symbols = symbols[offsets[1:]] - symbols[offsets[:-1]]
    hashes = Prefix(data)
    # lines: every \n ends one, and every document's end
    breaks = np.flatnonzero(data == 10)
    line_doc = np.concatenate([np.searchsorted(offsets, breaks, "right") - 1, np.arange(n)])
    line_stop = np.concatenate([breaks, offsets[1:]])
    order = np.lexsort((line_stop, line_doc))
    line_doc, line_stop = line_doc[order], line_stop[order]
    line_start = np.append(0, line_stop[:-1] + 1) if n else line_stop
    new = np.append(True, line_doc[1:] != line_doc[:-1]) if len(line_doc) else np.empty(0, bool)
    line_start[new] = offsets[line_doc[new]]
    head, tail = np.searchsorted(start, line_start), np.searchsorted(start, line_stop)
    has_word = tail > head
    ls, le, ld = line_start[has_word], line_stop[has_word], line_doc[has_word]
    of_words = _counted(points[stop] - points[start])
    line_chars = of_words[tail] - of_words[head]
    fails = failing(data, line_start, line_stop, tail - head, line_chars, **rules)
    removed = np.bincount(line_doc[fails], minlength=n)
    lost = np.bincount(line_doc[fails], weights=line_chars[fails], minlength=n).astype(np.int64)
    later, _ = _again(hashes.of(ls, le), ld)
    dup = np.bincount(ld[later], minlength=n)
    # three-word windows
    word = hashes.of(start, stop)
    doc = np.repeat(np.arange(n), np.diff(first))
    repeat = np.zeros(n, np.int64)
    if len(word) >= 3:
        inside = doc[2:] == doc[:-2]
        window = Prefix(word, 1).every(3)
        at = np.flatnonzero(inside)
        _, several = _again(window[at], doc[at])
        cover = np.zeros(len(word), bool)
        for step in range(3):
            cover[at[several] + step] = True
        repeat = np.bincount(doc[cover], minlength=n)
    texts = rows.column("text")
    if fails.any():
        raw, edges, keep = data.tobytes(), np.searchsorted(line_doc, np.arange(n + 1)), ~fails
        texts = texts.to_pylist()
        for d in np.flatnonzero(removed).tolist():
            own = np.arange(edges[d], edges[d + 1])[keep[edges[d] : edges[d + 1]]]
            texts[d] = b"\n".join(raw[a:b] for a, b in zip(line_start[own].tolist(), line_stop[own].tolist(), strict=True)).decode()
        texts = pa.array(texts, pa.string())
    columns = [np.diff(first), chars, symbols, dup, repeat, removed, lost]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines_removed", "chars_removed"]
    return pa.record_batch([rows.column("id"), texts.cast(pa.string()), *map(i64, columns)], names=["id", "text", *names])


def line_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_lost: float = 0.3, least_words: int = 50, **rules) -> DataFrame:
    """Per row: id, base counts, base_failed, kept, n_lines_removed, chars_removed and the cleaned text."""
    text = docs.select(id_or_least(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    judged = text.mapInArrow(_judge(rules), _BASE_DDL)
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    out = judged.select(null_if_least("id").alias(id_col), *counts, failed.alias("base_failed"), "n_lines_removed", "chars_removed", "text")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("chars_removed") <= most_lost * F.col("word_chars") + 1e-9))
