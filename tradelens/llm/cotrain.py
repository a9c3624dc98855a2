"""Quality classifier by co-training on two views of a page.

The content view sees shares and repetition of the text: symbols, capitals, digits, marks, word
and line lengths, repeated lines, words and three-word windows, sentence ends. The metadata view
sees only what is recorded about the page: source, language and the recorded length. Each view
is a ridge logistic regression (the content view on values and squares). Both start from the
labelled rows. In each round either view labels all rows without a label of whose kind it is
sure (its calibrated probability passes ``sure``), and the other view learns from them: Spark
sums their gradients and curvatures over all rows, the driver gets these sums and makes a Newton
step. Rows labelled by the other view weigh as much as the labelled rows of their kind at most.
A part of the labelled rows is kept aside for calibration: each view's log-odds are calibrated on
it (Platt), then combined by a logistic regression on both.

The labelled rows of the fit are a bounded sample (about ``most_labelled``), chosen by a hash of
the id; every other row takes part in the rounds and every row is scored. Null texts are empty;
null metadata is a value of its own. Long texts are read whole. Repeated label rows count once for
each id (the smallest label). Without labels of both kinds every row scores the share of good
labels (1 without any) and is kept. Equal rows get equal scores; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .line_rules import _again
from .textcols import NULL_ID, Prefix, gathered, id_or_least, null_if_least, row_key, slices, sums_by, words, written
from .toxicity import logistic

FEATURES = ["log_words", "word_length", "symbols", "capitals", "digits", "marks", "shouts", "distinct_words", "repeated_windows", "repeated_lines", "words_a_line", "sentence_ends", "white", "non_ascii"]


def _set(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode())] = True
    return table


_SYMBOLS, _CAPITALS, _DIGITS = _set("#*$%&|<>{}=~^_\\/@+"), _set("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _set("0123456789")
_MARKS, _SHOUTS, _WHITE, _ENDS = _set(".,;:?!()'\"-"), _set("!"), _set(" \t\n\r\x0b\x0c"), _set(".!?")


def content(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, features) of the content view; an empty text gives zeros."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1).astype(float)

    def share(table):
        total = np.append(0, np.cumsum(table[data]))
        return (total[offsets[1:]] - total[offsets[:-1]]) / size

    start, stop, first = words(data, offsets)
    count = np.diff(first)
    some = np.maximum(count, 1).astype(float)
    doc = np.repeat(np.arange(n), count)
    hashes = Prefix(data)
    word = hashes.of(start, stop)
    later, _ = _again(word, doc)
    distinct = 1 - np.bincount(doc[later], minlength=n) / some
    windows = np.zeros(n)
    if len(word) >= 3:
        at = np.flatnonzero(doc[2:] == doc[:-2])
        later, _ = _again(Prefix(word, 1).every(3)[at], doc[at])
        windows = np.bincount(doc[at][later], minlength=n) / some
    breaks = np.flatnonzero(data == 10)
    ends = np.sort(np.concatenate([breaks, offsets[1:][np.diff(offsets) > 0]]))
    begin = np.append(0, ends[:-1] + (data[np.minimum(ends[:-1], max(len(data) - 1, 0))] == 10)) if len(ends) else ends
    line_doc = np.searchsorted(offsets, begin, "right") - 1
    ok = ends > begin
    begin, ends, line_doc = begin[ok], ends[ok], line_doc[ok]
    lines = np.bincount(line_doc, minlength=n)
    later, _ = _again(hashes.of(begin, ends), line_doc)
    repeated = np.bincount(line_doc[later], minlength=n) / np.maximum(lines, 1)
    closed = np.bincount(line_doc[_ENDS[data[ends - 1]]], minlength=n) / np.maximum(lines, 1) if len(ends) else np.zeros(n)
    length = sums_by(stop - start, first) / some
    columns = [np.log1p(count), length, share(_SYMBOLS), share(_CAPITALS), share(_DIGITS), share(_MARKS), share(_SHOUTS), distinct * (count > 0), windows, repeated, np.log1p(count / np.maximum(lines, 1)), closed, share(_WHITE), share(np.arange(256) >= 128)]
    return np.stack(columns, axis=1)


def _content(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in slices(batches):
        values = content(data, offsets)
        keep = [c for c in rows.schema.names if c != "text"]
        yield pa.record_batch([*(rows.column(c) for c in keep), pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), values.shape[1]).cast(pa.list_(pa.float64()))], names=[*keep, "content"])


class Content:
    """Standardized values and squares."""

    def __init__(self, x: np.ndarray):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([z, z * z / 4], axis=1)


def buckets(values: pd.Series, salt: str, size: int) -> np.ndarray:
    return (pd.util.hash_array((salt + values.fillna("\0").astype(str)).to_numpy(dtype=object), categorize=True) % size).astype(np.int64)


class Metadata:
    """Hashed source and language, and the recorded length."""

    SOURCES, LANGS = 64, 16

    def __call__(self, source: pd.Series, lang: pd.Series, length: np.ndarray) -> np.ndarray:
        out = np.zeros((len(source), self.SOURCES + self.LANGS + 3))
        rows = np.arange(len(source))
        out[rows, buckets(source, "source ", self.SOURCES)] = 1
        out[rows, self.SOURCES + buckets(lang, "lang ", self.LANGS)] = 1
        known = np.isfinite(length) & (length >= 0)
        log = np.where(known, np.log1p(np.where(known, length, 0)) - 7, 0)
        out[:, -3], out[:, -2], out[:, -1] = log, log * log / 4, ~known
        return out


def _odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _platt(odds: np.ndarray, y: np.ndarray) -> np.ndarray:
    w = logistic(odds[:, None], y, ridge=0.1) if 0 < y.sum() < len(y) else np.array([1.0, 0.0])
    return np.array([max(w[0], 0.0), w[1]])


def slopes(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gradient, curvature) of the logistic loss of these rows, summed."""
    x = np.column_stack([x, np.ones(len(x))])
    p = _sigmoid(x @ w)
    return x.T @ (p - y), (x * (p * (1 - p))[:, None]).T @ x


def _columns(rows: pa.RecordBatch) -> tuple[np.ndarray, pd.Series, pd.Series, np.ndarray]:
    values = rows.column("content").flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, len(FEATURES))
    return values, rows.column("source").to_pandas(), rows.column("lang").to_pandas(), rows.column("length").to_pandas().to_numpy(dtype=float, na_value=np.nan)


_SUMS = pa.schema([("view", pa.int8()), ("kind", pa.int8()), ("place", pa.int32()), ("value", pa.float64())])


def _sums(shared):
    """Of the rows that the other view is sure of, for each view and kind: their number, gradient and curvature."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        total: dict[tuple[int, int], np.ndarray] = {}
        for rows in batches:
            if not rows.num_rows:
                continue
            views = model.views(*_columns(rows))
            for pupil, teacher in ((0, 1), (1, 0)):
                sure = _sigmoid(model.calibrated(teacher, views[teacher]))
                for kind, p in ((0, 1 - sure), (1, sure)):
                    own = views[pupil][p >= model.sure]
                    if len(own):
                        grad, curve = slopes(own, np.full(len(own), float(kind)), model.w[pupil])
                        sums = np.concatenate([[len(own)], grad, curve[np.triu_indices(len(grad))]])
                        total[pupil, kind] = total.get((pupil, kind), 0.0) + sums
        for (view, kind), sums in total.items():
            n = len(sums)
            yield pa.record_batch([pa.array(np.full(n, view, np.int8)), pa.array(np.full(n, kind, np.int8)), pa.array(np.arange(n, dtype=np.int32)), pa.array(sums)], schema=_SUMS)

    return work


class Model:
    """Fitted views, their calibration and their combination."""

    def __init__(self, frame: pd.DataFrame, sure: float, ridge: float):
        """``frame``: labelled rows with content, source, lang, length, quality and part."""
        y = frame["quality"].to_numpy(dtype=float)
        self.rate = float(y.mean()) if len(y) else 1.0
        self.ready = bool(0 < y.sum() < len(y))
        self.sure, self.ridge, self.sizes = sure, ridge, []
        if not self.ready:
            return
        x = np.stack(frame["content"].to_numpy())
        self.scale, self.meta = Content(x), Metadata()
        aside = frame["part"].to_numpy() % 4 == 0
        if not 0 < y[aside].sum() < aside.sum():
            aside = np.ones(len(y), bool)
        learn = ~aside if 0 < y[~aside].sum() < (~aside).sum() else np.ones(len(y), bool)
        views = self.views(x, frame["source"], frame["lang"], frame["length"].to_numpy(dtype=float))
        self.learn, self.aside = [(v[learn], y[learn]) for v in views], [(v[aside], y[aside]) for v in views]
        self.w = [logistic(v, t, ridge) for v, t in self.learn]
        self._calibrate()

    def views(self, content_: np.ndarray, source: pd.Series, lang: pd.Series, length: np.ndarray) -> list[np.ndarray]:
        return [self.scale(content_), self.meta(source, lang, length)]

    def calibrated(self, view: int, x: np.ndarray) -> np.ndarray:
        return self.cal[view][0] * _odds(x, self.w[view]) + self.cal[view][1]

    def _calibrate(self) -> None:
        self.cal = [_platt(_odds(x, w), y) for (x, y), w in zip(self.aside, self.w, strict=True)]
        odds = np.stack([self.calibrated(i, x) for i, (x, _) in enumerate(self.aside)], axis=1)
        self.mix = logistic(odds, self.aside[0][1], ridge=0.1)
        self.mix[:2] = np.maximum(self.mix[:2], 0)

    def step(self, sums: dict[tuple[int, int], np.ndarray], calibrate: bool) -> None:
        """A Newton step of both views from labelled rows and the sums of ``_sums``; rounded, so that the order of sums does not show."""
        self.sizes.append({k: int(v[0]) for k, v in sums.items()})
        for view, (x, y) in enumerate(self.learn):
            w = self.w[view]
            d = len(w)
            grad, curve = slopes(x, y, w)
            for kind in (0, 1):
                own = sums.get((view, kind))
                if own is not None:
                    weight = min(1.0, (y == kind).sum() / own[0])
                    square = np.zeros((d, d))
                    square[np.triu_indices(d)] = own[1 + d :]
                    grad, curve = grad + weight * own[1 : 1 + d], curve + weight * (square + np.triu(square, 1).T)
            penalty = np.append(np.full(d - 1, self.ridge), 1e-6)
            self.w[view] = np.round(w - np.linalg.solve(curve + np.diag(penalty) + 1e-9 * np.eye(d), grad + penalty * w), 9)
        if calibrate:
            self._calibrate()

    def score(self, content_: np.ndarray, source: pd.Series, lang: pd.Series, length: np.ndarray) -> tuple[np.ndarray, ...]:
        """(combined, content, metadata) probabilities of good quality."""
        if not self.ready:
            flat = np.full(len(source), self.rate)
            return flat, flat, flat
        odds = [self.calibrated(i, x) for i, x in enumerate(self.views(content_, source, lang, length))]
        both = self.mix[0] * odds[0] + self.mix[1] * odds[1] + self.mix[2]
        return tuple(_sigmoid(o) for o in (both, *odds))


def _apply(shared, threshold: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for rows in batches:
            if not rows.num_rows:
                continue
            both, one, two = model.score(*_columns(rows))
            kept = both >= threshold if model.ready else np.ones(len(both), bool)
            yield pa.record_batch([rows.column("id"), rows.column("row_key"), *map(pa.array, (both, one, two, kept))], names=["id", "row_key", "score", "text_score", "meta_score", "kept"])

    return work


def cotrain(
    docs: DataFrame, labels: DataFrame, training=None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
    length_col: str = "n_chars", label_col: str = "quality", most_labelled: int = 8_000, rounds: int = 4, steps: int = 2,
    sure: float = 0.95, ridge: float = 1.0, threshold: float = 0.5, with_key: bool = False,
) -> DataFrame:
    """Per row: id, its ``row_key`` if ``with_key``, score (0 to 1, of good quality), text_score, meta_score, kept (score >= ``threshold``).

    ``training`` is a condition on the rows of ``docs`` whose labels may be used (default: all);
    other rows count as rows without a label. A round makes ``steps`` Newton steps.
    """
    spark = docs.sparkSession
    training = F.lit(True) if training is None else training
    rows = docs.select(
        id_or_least(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(source_col).cast("string").alias("source"),
        F.col(lang_col).cast("string").alias("lang"), F.col(length_col).cast("double").alias("length"), F.coalesce(training, F.lit(False)).alias("training"),
        row_key(id_col, text_col).alias("row_key"),
    )
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("label_id")).agg(F.min((F.col(label_col) > 0).cast("int")).alias("quality"))
    described = rows.mapInArrow(_content, "id long, source string, lang string, length double, training boolean, row_key long, content array<double>")
    # rows without an id have no label; they go by their key, so that they do not meet in one task
    at = F.when(F.col("id") == F.lit(NULL_ID), F.col("row_key")).otherwise(F.col("id"))
    described = described.join(known, (at == F.col("label_id")) & (F.col("id") == F.col("label_id")), "left")
    quality = F.when(F.col("training"), F.col("quality")).cast("double").alias("quality")
    described = written(gathered(described.select("id", "row_key", "source", "lang", "length", "content", quality), docs.count()))
    n_known = known.count()
    taken = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, most_labelled / max(n_known, 1)))
    sample = described.where(F.col("quality").isNotNull() & taken).select("id", "row_key", "source", "lang", "length", "content", "quality", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 20)).alias("part"))
    sample = sample.toArrow().to_pandas().sort_values(["part", "id", "row_key"], kind="stable")  # about most_labelled rows
    model = Model(sample, sure, ridge)
    pool = described.where(F.col("quality").isNull())
    for i in range(rounds * steps if model.ready else 0):
        found = pool.mapInArrow(_sums(spark.sparkContext.broadcast(model)), "view byte, kind byte, place int, value double")
        found = found.groupBy("view", "kind", "place").agg(F.sum("value").alias("value")).toArrow().to_pandas().sort_values(["view", "kind", "place"])  # as many as both views have weights, squared
        model.step({k: g["value"].to_numpy() for k, g in found.groupby(["view", "kind"])}, calibrate=(i + 1) % steps == 0)
    out = described.select("id", "row_key", "source", "lang", "length", "content").mapInArrow(_apply(spark.sparkContext.broadcast(model), threshold), "id long, row_key long, score double, text_score double, meta_score double, kept boolean")
    return out.select(null_if_least("id").alias(id_col), *(["row_key"] if with_key else []), "score", "text_score", "meta_score", "kept")
