"""Toxic passages by maximum-scoring segments over token log-odds.

1.  Terms are tokens (runs of letters, digits and non-ASCII bytes, A-Z lowered) and their stems
    of 4, 5 and 6 bytes; a term counts once for each toxic or other training row that has it.
    Its weight is the log-odds ratio under an informative Dirichlet prior: the prior of a term
    is the share ``prior`` of its counts in both classes together. Terms whose weight exceeds ``least_weight`` and
    ``z`` standard errors form the lexicon (at most ``most_terms``).
2.  In a text a token scores the largest weight of its terms, a token without lexicon terms a
    small negative drift. All maximal-scoring segments are found in one scan.
3.  Scores of segments in random text follow an extreme-value law: with the background of the
    other class, lambda solves E[exp(lambda * score)] = 1, and K comes from the mean of the
    best segments of rows that are not toxic. A passage is significant when its expected
    number K * n * exp(-lambda * score) is below ``significance``.
4.  A document's score is a logistic function of its best passage on that scale and of the sum
    over its passages.

Lexicon and logistic function are fitted on a sample of about ``most_fitted`` labelled rows,
chosen by a hash of the id; every row is scored.

Null and empty texts have no passage and get the lowest score. Without labels of both kinds all
scores are the share of toxic labels (0 without labels). Repeated label rows count once for
each id (the largest label); a null label or id labels nothing. Long texts are scanned whole;
segments of equal score are all kept. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcols import Prefix, i64, id_or_least, lower_ascii, mix, null_if_least, settle, slices, words

_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_AS_SPACE = np.where(_PLAIN, np.arange(256), 32).astype(np.uint8)


def tokens_of(data: np.ndarray, offsets: np.ndarray):
    """(start, stop, first of each document, bytes with blanks between tokens)."""
    low = _AS_SPACE[lower_ascii(data)]
    return *words(low, offsets), low


def maximal_segments(left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Ruzzo and Tompa's scan. Item i is a positive score between the running totals left[i] and right[i].

    Returns (first item, last item) of all maximal-scoring segments, in order.
    """
    lows: list[float] = []
    highs: list[float] = []
    spans: list[tuple[int, int]] = []
    links: list[int] = []  # nearest earlier candidate with a smaller low
    for i in range(len(left)):
        low, high, begin = float(left[i]), float(right[i]), i
        while True:
            j = len(lows) - 1
            while j >= 0 and lows[j] >= low:
                j = links[j]
            if j < 0 or highs[j] >= high:
                lows.append(low)
                highs.append(high)
                spans.append((begin, i))
                links.append(j)
                break
            low, begin = lows[j], spans[j][0]
            del lows[j:], highs[j:], spans[j:], links[j:]
    return spans


STEMS = (4, 5, 6)


def terms_of(hashes: Prefix, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """(1 + stems, tokens) hashes: the token, and its stem of each length where it is longer than that (else 0)."""
    out = [hashes.of(start, stop)]
    for size in STEMS:
        out.append(np.where(stop - start > size, hashes.of(start, np.minimum(start + size, stop)) ^ np.uint64(size), np.uint64(0)))
    return np.stack(out)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in slices(batches):
        toxic = rows.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
        start, stop, first, low = tokens_of(data, offsets)
        hashes = Prefix(low)
        doc = np.repeat(np.arange(rows.num_rows), np.diff(first))
        _, one = np.unique(hashes.of(start, stop) ^ mix(doc.astype(np.uint64)), return_index=True)
        terms = terms_of(hashes, start[one], stop[one]).ravel()
        doc = np.tile(doc[one], 1 + len(STEMS))
        _, one = np.unique(terms ^ mix(doc.astype(np.uint64)), return_index=True)
        one = one[terms[one] != 0]
        keys, inverse = np.unique(terms[one], return_inverse=True)
        bad = np.bincount(inverse, weights=toxic[doc[one]], minlength=len(keys)).astype(np.int64)
        yield pa.record_batch([i64(keys), i64(bad), i64(np.bincount(inverse, minlength=len(keys)) - bad)], names=["token", "toxic", "other"])


def lexicon(labelled: DataFrame, prior: float = 0.02, z: float = 2.5, least_weight: float = 1.5, most_terms: int = 20_000, most_weight: float = 8.0) -> dict:
    """Weights, background shares and drift from rows (text, toxic)."""
    counts = labelled.select("text", "toxic").mapInArrow(_count, "token long, toxic long, other long").groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    n1, n0 = counts.agg(F.sum("toxic"), F.sum("other")).first()
    n1, n0 = n1 or 0, n0 or 0
    empty = {"keys": np.empty(0, np.uint64), "weights": np.empty(0), "drift": 0.1, "lambda": 1.0}
    if not n1 or not n0:
        return empty
    own = F.lit(prior) * (F.col("toxic") + F.col("other"))
    prior *= n1 + n0
    a, b = F.col("toxic") + own, F.col("other") + own
    odds = F.log(a / (F.lit(n1 + prior) - a)) - F.log(b / (F.lit(n0 + prior) - b))
    sure = counts.withColumn("weight", odds).withColumn("z", odds / F.sqrt(1 / a + 1 / b)).where((F.col("z") >= z) & (F.col("weight") >= least_weight))
    top = sure.orderBy(F.desc("z"), "token").limit(most_terms).toArrow().to_pandas()  # bounded by most_terms
    if not len(top):
        return empty
    keys = top["token"].to_numpy().astype(np.int64).view(np.uint64)
    by = np.argsort(keys)
    weights = np.minimum(top["weight"].to_numpy(), most_weight)[by]
    share = top["other"].to_numpy()[by] / n0
    drift = max(0.1, 2.0 * float((share * weights).sum() / (1 - share.sum())))
    low, high = 1e-6, 50.0
    for _ in range(200):  # E[exp(lambda * score)] is below 1 just above 0 and grows without bound
        middle = (low + high) / 2
        value = float((share * np.exp(np.minimum(middle * weights, 600))).sum() + (1 - share.sum()) * np.exp(-middle * drift))
        low, high = (middle, high) if value < 1 else (low, middle)
    return {"keys": keys[by], "weights": weights, "drift": drift, "lambda": low}


_PASSAGE = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("score", pa.float64())])
_SCAN_DDL = "n_tokens long, passages array<struct<start:long,length:long,score:double>>"


def _scan(model):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        keys, weights, drift = m["keys"], m["weights"], m["drift"]
        for rows, data, offsets in slices(batches):
            start, stop, first, low = tokens_of(data, offsets)
            found: list[list] = [[] for _ in range(rows.num_rows)]
            if len(keys) and len(start):
                hashes = Prefix(low)
                _, one, inverse = np.unique(hashes.of(start, stop), return_index=True, return_inverse=True)
                terms = terms_of(hashes, start[one], stop[one])
                place = np.minimum(np.searchsorted(keys, terms), len(keys) - 1)
                weight = np.where(keys[place] == terms, weights[place], 0.0).max(axis=0)[inverse]
                hit = np.flatnonzero(weight > 0)
                score = weight[hit]
                bounds = np.searchsorted(hit, first)
                for d in np.flatnonzero(np.diff(bounds)).tolist():
                    a, b = bounds[d], bounds[d + 1]
                    gain = np.append(0, np.cumsum(score[a:b]))
                    loss = drift * (hit[a:b] - first[d] - np.arange(b - a))
                    left, right = gain[:-1] - loss, gain[1:] - loss
                    for i, j in maximal_segments(left, right):
                        x, y = start[hit[a + i]], stop[hit[a + j]]
                        found[d].append({"start": int(x - offsets[d]), "length": int(y - x), "score": float(right[j] - left[i])})
            keep = [c for c in rows.schema.names if c != "text"]
            yield pa.record_batch([*(rows.column(c) for c in keep), i64(np.diff(first)), pa.array(found, pa.list_(_PASSAGE))], names=[*keep, "n_tokens", "passages"])

    return work


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights (intercept last) of a logistic regression by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty) + 1e-9 * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def toxicity(docs: DataFrame, labels: DataFrame, training, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", significance: float = 0.05, most_fitted: int = 20_000, **options) -> DataFrame:
    """Per row: id, score (0 to 1), predicted, n_passages and the significant passages (byte ranges with scores).

    ``training`` is a condition on the rows of ``docs`` whose labels may be used. The fit
    takes about ``most_fitted`` labelled rows at most, chosen by a hash of the id.
    """
    spark = docs.sparkSession
    text = docs.select(id_or_least(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), training.alias("training"))
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("toxic"))
    n = known.count()
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, most_fitted / max(n, 1)))
    labelled = settle(text.where("training").where(share).join(known.where(share), "id").select("id", "text", "toxic"))
    model = lexicon(labelled, **options)
    shared = spark.sparkContext.broadcast(model)
    scanned = labelled.mapInArrow(_scan(shared), "id long, toxic int, " + _SCAN_DDL)
    best = F.coalesce(F.array_max(F.transform("passages", lambda p: p.score)), F.lit(0.0))
    fit = scanned.select("toxic", "n_tokens", best.alias("best"), F.aggregate("passages", F.lit(0.0), lambda a, p: a + p.score).alias("all")).limit(2 * most_fitted).toArrow().to_pandas()
    lam = model["lambda"]
    clean = fit[(fit.toxic == 0) & (fit.n_tokens > 0)]
    k = float(np.exp(np.clip((lam * clean.best - np.log(clean.n_tokens)).mean() - 0.5772156649, -30, 5))) if len(clean) else 1.0
    y = fit.toxic.to_numpy(dtype=float)

    def evidence(best, all_, tokens):
        return np.column_stack([lam * best - np.log(k * (tokens + 1)), np.log1p(all_)])

    if 0 < y.sum() < len(y):
        w = logistic(evidence(fit.best.to_numpy(), fit["all"].to_numpy(), fit.n_tokens.to_numpy()), y)
        w[:2] = np.maximum(w[:2], 0)
    else:
        rate = y.mean() if len(y) else 0.0
        w = np.array([0.0, 0.0, np.log((rate + 1e-9) / (1 - rate + 1e-9))])
    out = text.select("id", "text").mapInArrow(_scan(shared), "id long, " + _SCAN_DDL)
    total = F.aggregate("passages", F.lit(0.0), lambda a, p: a + p.score)
    x = F.lit(float(w[0])) * (lam * best - F.log(k * (F.col("n_tokens") + 1))) + F.lit(float(w[1])) * F.log1p(total) + F.lit(float(w[2]))
    certain = F.filter("passages", lambda p: k * F.col("n_tokens") * F.exp(-lam * p.score) < significance)
    out = out.select(null_if_least("id").alias(id_col), (1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), x))))).alias("score"), certain.alias("passages"))
    return out.select(id_col, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"), "passages")
