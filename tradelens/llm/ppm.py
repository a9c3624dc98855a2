"""Prediction by partial matching over byte contexts, and a unigram word baseline.

Learning counts every string of ``order`` + 1 bytes of the training texts (texts are led by
``order`` zero bytes and closed by one, which is coded as the end). Shorter contexts follow by
summing. No context is left out: the trie is a set of tables, one for each depth, that are
joined by context and grow with the corpus. Escapes are estimated as the number of distinct
symbols over that number plus the count (method C), and symbols seen in a longer context are
excluded from the shorter ones.

Scoring sums the code lengths of a text's strings. Strings that make up at least one in
``common_strings`` of the training bytes (so at most that many) are sent to every task with
their code lengths; the others of each text are counted and joined with the tables. A string
that was never seen goes down the trie by its contexts. In the same way words that make up at
least one in ``common_words`` of the tokens are sent to every task for the baseline, all others
are joined by hash.

Null texts are empty: they code one end. A null id counts as the smallest in hashing and as ''
in choosing training rows. Rows repeated exactly are scored once each. Long texts are scored
whole. Empty tables give an empty result; without training rows every byte costs 8 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcols import Prefix, crc_remainder, i64, id_or_least, lower_ascii, null_if_least, row_key, settle, slices, sums_by, words, written

_WORD, _GRAM, _TEXT = 0, 1, 2


def byte_stream(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all texts with leading zeros and an end, indexes of coded bytes, their offsets by document)."""
    sizes = np.diff(offsets)
    starts = np.append(0, np.cumsum(sizes + order + 1))
    out = np.zeros(int(starts[-1]), np.uint8)
    where = np.arange(len(data)) + np.repeat(starts[:-1] + order - offsets[:-1], sizes)
    out[where] = data
    coded = np.ones(len(out), bool)
    for k in range(order):
        coded[starts[:-1] + k] = False
    return out, np.flatnonzero(coded), np.append(0, np.cumsum(sizes + 1))


def grams(bytes_: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` bytes that end at each place, as a number."""
    value = np.zeros(len(bytes_), np.uint64)
    for back in range(width - 1, -1, -1):
        value <<= np.uint64(8)
        value[back:] |= bytes_[: len(bytes_) - back]
    return value[at]


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values = np.sort(values)
    head = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.empty(0, np.int64)
    return values[head], np.diff(np.append(head, len(values)))


def _count(order: int):
    schema = pa.schema([("kind", pa.int8()), ("key", pa.int64()), ("n", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_, grams_, held, texts = [], [], 0, 0

        def out():
            for kind, parts in ((_WORD, words_), (_GRAM, grams_)):
                keys = np.concatenate([k for k, _ in parts])
                counts = np.concatenate([n for _, n in parts])
                by = np.argsort(keys, kind="stable")
                keys, counts = keys[by], counts[by]
                head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
                if len(head):
                    yield pa.record_batch([pa.array(np.full(len(head), kind, np.int8)), i64(keys[head]), i64(np.add.reduceat(counts, head))], schema=schema)

        for rows, data, offsets in slices(batches):
            texts += rows.num_rows
            held += len(data)
            stream, at, _ = byte_stream(data, offsets, order)
            grams_.append(_counted(grams(stream, at, order + 1)))
            low = lower_ascii(data)
            start, stop, _ = words(low, offsets)
            words_.append(_counted(Prefix(low).of(start, stop)))
            if held > 16 << 20:
                yield from out()
                words_, grams_, held = [], [], 0
        if words_:
            yield from out()
        if texts:  # the end of a text is a token of its own
            yield pa.record_batch([pa.array([_WORD], pa.int8()), pa.array([END]), pa.array([texts])], schema=schema)

    return work


#: Key of the end token among the word hashes.
END = 0x656E64


class Trie:
    """Tables of all contexts.

    ``strings[k]`` has (string, n): the counts of all strings of a context of k bytes and the byte
    after it, as one number. ``contexts[k]`` has (context, total, kinds, free_total, free_kinds):
    counts and distinct symbols after it, and what the context one byte shorter has besides them.
    """

    def __init__(self, counts: DataFrame, order: int = 4):
        if not 1 <= order <= 6:
            raise ValueError("order must be from 1 to 6: a string is one number")
        self.order = order
        self.strings = {order: counts.where(F.col("kind") == _GRAM).select(F.col("key").alias("string"), "n")}
        for k in range(order - 1, -1, -1):
            self.strings[k] = settle(self.strings[k + 1].groupBy(self._last(k + 1).alias("string")).agg(F.sum("n").alias("n")))
        self.contexts: dict[int, DataFrame] = {}
        for k in range(order + 1):
            rows = self.strings[k].withColumn("context", F.shiftright("string", 8))
            if k:
                shorter = self.strings[k - 1].select(F.col("string").alias("shorter"), F.col("n").alias("also"))
                rows = rows.join(shorter, self._last(k) == F.col("shorter"))
            else:
                rows = rows.withColumn("also", F.lit(0).cast("long"))
            own = rows.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.sum("also").alias("also"))
            if k:
                up = self.contexts[k - 1].select(F.col("context").alias("up"), F.col("total").alias("up_total"), F.col("kinds").alias("up_kinds"))
                own = own.join(up, F.col("context").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1)) == F.col("up"))
                free = [(F.col("up_total") - F.col("also")).alias("free_total"), (F.col("up_kinds") - F.col("kinds")).alias("free_kinds")]
            else:
                free = [F.lit(0).cast("long").alias("free_total"), F.lit(0).cast("long").alias("free_kinds")]
            self.contexts[k] = settle(own.select("context", "total", "kinds", *free))

    @staticmethod
    def _last(size: int):
        return F.col("string").bitwiseAND(F.lit((1 << 8 * size) - 1))

    def seen(self) -> DataFrame:
        """(string, n, bits) of all strings that were learned from."""
        own = self.contexts[self.order].select("context", "total", "kinds")
        escape = F.when(F.col("kinds") < 256, F.col("kinds")).otherwise(0)
        rows = self.strings[self.order].withColumn("context", F.shiftright("string", 8)).join(own, "context")
        return rows.select("string", "n", F.log2((F.col("total") + escape) / F.col("n")).alias("bits"))

    def bits(self, strings: DataFrame, seen: DataFrame | None = None) -> DataFrame:
        """(string, bits): the code length of a string's last byte after the others, from (string), distinct."""
        known = strings.join(self.seen() if seen is None else seen, "string", "left").select("string", F.col("bits").alias("known"))
        known = settle(known)
        rows = known.where("known is null").select("string")
        for k in range(self.order, -1, -1):
            names = [F.col(c).alias(f"{c}_{k}") for c in ("context", "total", "kinds", "free_total", "free_kinds")]
            rows = rows.join(self.contexts[k].select(*names), F.shiftright(self._last(k + 1), 8) == F.col(f"context_{k}"), "left")
            if k < self.order:  # at the full order it was not seen
                rows = rows.join(self.strings[k].select(F.col("string").alias(f"string_{k}"), F.col("n").alias(f"n_{k}")), self._last(k + 1) == F.col(f"string_{k}"), "left")
            else:
                rows = rows.withColumn(f"n_{k}", F.lit(None).cast("long"))
        bits, found, entered = F.lit(0.0), F.lit(False), F.lit(False)
        for k in range(self.order, -1, -1):
            there, hit = F.col(f"total_{k}").isNotNull(), F.col(f"n_{k}").isNotNull()
            mass, kinds = F.col(f"total_{k}"), F.col(f"kinds_{k}")
            if k < self.order:  # after an escape only what the longer context lacks is left
                mass, kinds = F.when(entered, F.col(f"free_total_{k + 1}")).otherwise(mass), F.when(entered, F.col(f"free_kinds_{k + 1}")).otherwise(kinds)
            escape = F.when(F.col(f"kinds_{k}") < 256, kinds).otherwise(0)
            step = F.when(~there, 0.0).when(hit, F.log2((mass + escape) / F.col(f"n_{k}"))).when(escape > 0, F.log2((mass + escape) / escape)).otherwise(0.0)
            bits = bits + F.when(found, 0.0).otherwise(step)
            found, entered = found | hit, entered | there
        rest = F.log2(F.greatest(F.lit(1), F.lit(256) - F.coalesce("kinds_0", F.lit(0))))
        new = rows.select("string", (bits + F.when(found, 0.0).otherwise(rest)).alias("bits"))
        return known.where("known is not null").select("string", F.col("known").alias("bits")).unionByName(new)


_SCORE = pa.schema([("kind", pa.int8()), ("id", pa.int64()), ("row_key", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("bits", pa.float64())])
_SCORE_DDL = "kind byte, id long, row_key long, key long, n long, n_tokens long, n_known long, base double, bits double"


def _found(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each key is in a sorted table, its value or 0)."""
    known, values = table
    if not len(known):
        return np.zeros(len(keys), bool), np.zeros(len(keys))
    place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    there = known[place] == keys
    return there, np.where(there, values[place], 0)


def _score(shared, order: int, least: float, ends: int):
    """A row for each text, and one for each of its words and strings that are not among the common ones."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common_words, common_strings = shared.value
        for rows, data, offsets in slices(batches):
            n = rows.num_rows
            ids, keys = (rows.column(c).to_numpy() for c in ("id", "row_key"))

            def rest(kind, first, places, names, which):
                """Rows of what each text has of the uncommon ones."""
                doc = np.searchsorted(first, places, "right") - 1
                pairs, times = _counted(doc.astype(np.uint64) << np.uint64(40) | which[places].astype(np.uint64))
                doc, own = (pairs >> np.uint64(40)).astype(np.int64), (pairs & np.uint64((1 << 40) - 1)).astype(np.int64)
                none, no = np.zeros(len(doc), np.int64), np.zeros(len(doc))
                return pa.record_batch([pa.array(np.full(len(doc), kind, np.int8)), i64(ids[doc]), i64(keys[doc]), i64(names[own]), i64(times), i64(none), i64(none), pa.array(no), pa.array(no)], schema=_SCORE)

            stream, at, coded = byte_stream(data, offsets, order)
            strings, which = np.unique(grams(stream, at, order + 1), return_inverse=True)
            there, bits = _found(common_strings, strings)
            bits = sums_by(bits[which], coded)
            yield rest(_GRAM, coded, np.flatnonzero(~there[which]), strings, which)
            low = lower_ascii(data)
            start, stop, first = words(low, offsets)
            word, which = np.unique(Prefix(low).of(start, stop), return_inverse=True)
            there, count = _found(common_words, word)
            token = count[which]
            base = sums_by(np.where(token > 0, np.log10(token + 1) + least, 0.0), first) + np.log10(ends + 1) + least
            sure = sums_by(there[which].astype(np.int64), first) + (ends > 0)
            yield rest(_WORD, first, np.flatnonzero(~there[which]), word, which)
            zero = np.zeros(n, np.int64)
            yield pa.record_batch([pa.array(np.full(n, _TEXT, np.int8)), i64(ids), i64(keys), i64(zero), i64(zero + 1), i64(np.diff(first) + 1), i64(sure), pa.array(base), pa.array(bits)], schema=_SCORE)

    return work


def learn(docs: DataFrame, text_col: str = "text", order: int = 4) -> DataFrame:
    """(kind, key, n): counts of all words (0) and byte strings (1) of the texts."""
    text = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return text.mapInArrow(_count(order), "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _sorted(rows: DataFrame, key: str, value: str) -> tuple[np.ndarray, np.ndarray]:
    """A small table as sorted keys and their values."""
    table = rows.select(key, value).toArrow()
    keys = table.column(key).to_numpy().astype(np.int64).view(np.uint64)
    by = np.argsort(keys)
    return keys[by], table.column(value).to_numpy()[by]


def ppm_scores(docs: DataFrame, training, id_col: str = "doc_id", text_col: str = "text", order: int = 4, common_strings: int = 1 << 22, common_words: int = 1 << 20) -> DataFrame:
    """Per row: id, n_tokens, n_known, train_tokens, base_score, score (log10 probability of the text).

    ``training`` is a condition on the rows of ``docs`` that the model learns from.
    """
    spark = docs.sparkSession
    counts = settle(learn(docs.where(training), text_col, order))
    vocabulary = counts.where(F.col("kind") == _WORD).select("key", "n")
    total, types = vocabulary.agg(F.sum("n"), F.count("*")).first()
    total, types = total or 0, types or 0
    ends = (vocabulary.where(F.col("key") == END).agg(F.sum("n")).first()[0]) or 0
    vocabulary = vocabulary.where(F.col("key") != END)
    trie = Trie(counts, order)
    seen = settle(trie.seen())
    size = seen.agg(F.sum("n")).first()[0] or 0
    # at most common_words and common_strings rows
    common = _sorted(vocabulary.where(F.col("n") * common_words >= total), "key", "n"), _sorted(seen.where(F.col("n") * common_strings >= size), "string", "bits")
    least = -float(np.log10(total + types + 1))
    text = docs.select(id_or_least(id_col).alias("id"), row_key(id_col, text_col).alias("row_key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = written(text.mapInArrow(_score(spark.sparkContext.broadcast(common), order, least, ends), _SCORE_DDL))
    none, no = F.lit(0).cast("long"), F.lit(0.0)
    rare = vocabulary.where(F.col("n") * common_words < total).select("key", F.col("n").alias("count"))
    count = F.coalesce("count", F.lit(0))
    of_words = rows.where(F.col("kind") == _WORD).select("id", "row_key", "key", "n").join(rare, "key", "left").select(
        "id", "row_key", none.alias("copies"), none.alias("n_tokens"), F.when(count > 0, F.col("n")).otherwise(0).alias("n_known"), (F.col("n") * (F.log10(count + 1) + least)).alias("base"), no.alias("bits"))
    strings = rows.where(F.col("kind") == _GRAM).select("id", "row_key", F.col("key").alias("string"), "n")
    lengths = trie.bits(strings.select("string").distinct(), seen)
    of_strings = strings.join(lengths, "string").select("id", "row_key", none.alias("copies"), none.alias("n_tokens"), none.alias("n_known"), no.alias("base"), (F.col("n") * F.col("bits")).alias("bits"))
    of_texts = rows.where(F.col("kind") == _TEXT).select("id", "row_key", F.col("n").alias("copies"), "n_tokens", "n_known", "base", "bits")
    sums = ["copies", "n_tokens", "n_known", "base", "bits"]
    out = of_texts.unionByName(of_words).unionByName(of_strings).groupBy("id", "row_key").agg(*(F.sum(c).alias(c) for c in sums))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    each = [(F.col(c) / F.col("copies")).cast("long").alias(c) for c in ("n_tokens", "n_known")]
    score = F.col("bits") / F.col("copies") * F.lit(-float(np.log10(2)))
    return out.select(null_if_least("id").alias(id_col), *each, F.lit(total).cast("long").alias("train_tokens"), (F.col("base") / F.col("copies")).alias("base_score"), score.alias("score"))


__all__ = ["ppm_scores", "learn", "Trie", "crc_remainder"]
