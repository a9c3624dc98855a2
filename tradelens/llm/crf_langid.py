"""Language of every word by a linear-chain conditional random field, and of texts by its marginals.

Words carry hashed features: the word itself (lexicon), its first and last 1 to 3 characters
(affixes, on bytes) and all its byte trigrams with word ends. Training sequences are spliced
from stretches of documents in different languages, so the transitions learn how seldom text
switches; weights and transitions follow the gradient of the likelihood: marginals of words and
of neighbouring label pairs, both from the messages of forward-backward. A text is tagged exactly and as a whole: stretches of ``stretch`` words are
first folded to transfer matrices, the matrices are chained over the text, and then marginals
are worked out inside all stretches at once. The language of a text is the label with the
largest sum of marginals over its words, the score its share.

Null texts and texts without a letter give ``und`` with score 0. Without training rows all
others do so too. A null language or id teaches nothing (a null id may be scored). Repeated
rows get equal results; of languages with equal sums the first by name is taken. Long texts are
tagged whole. An empty table gives no rows. Other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcols import Prefix, i64, id_or_least, lower_ascii, null_if_least, slices, sums_by, words

BITS = 17


def word_features(hashes: Prefix, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature indexes of all words, offsets by word)."""
    size = stop - start
    shift = np.uint64(64 - BITS)
    fixed = [hashes.of(start, stop)]
    for n in (1, 2, 3):
        fixed.append(hashes.of(start, np.minimum(start + n, stop)) ^ np.uint64(0x9E37 * n << 40))
        fixed.append(hashes.of(np.maximum(stop - n, start), stop) ^ np.uint64(0xC2B2 * n << 40))
    grams = np.maximum(size - 2, 0)
    per = grams + len(fixed)
    at = np.append(0, np.cumsum(per))
    out = np.empty(int(at[-1]), np.int64)
    for i, h in enumerate(fixed):
        out[at[:-1] + i] = h >> shift
    word = np.repeat(np.arange(len(size)), grams)
    step = np.arange(len(word)) - np.repeat(np.cumsum(grams) - grams, grams)
    begin = start[word] + step
    out[at[:-1][word] + len(fixed) + step] = (hashes.of(begin, begin + 3) ^ np.uint64(0x165667B1 << 32)) >> shift
    return out, at


def emissions(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, labels) scores of all words, worked out once for each distinct word; first word by document."""
    low = lower_ascii(data)
    start, stop, first = words(low, offsets)
    if not len(start):
        return np.zeros((0, weights.shape[1])), first
    hashes = Prefix(low)
    _, one, inverse = np.unique(hashes.of(start, stop), return_index=True, return_inverse=True)
    features, at = word_features(hashes, start[one], stop[one])
    scores = np.add.reduceat(weights[features], at[:-1], axis=0)
    return scores[inverse], first


def marginals(scores: np.ndarray, first: np.ndarray, transition: np.ndarray, stretch: int = 64, pairs: np.ndarray | None = None) -> np.ndarray:
    """Posterior label probabilities of all words; documents are words first[i] to first[i+1].

    Any label may have stood before a document's first word. The expected numbers of all label
    pairs, that one included, are added to ``pairs`` (labels x labels) if it is given.
    """
    n, labels = scores.shape
    if not n:
        return scores
    e = np.exp(scores - scores.max(axis=1, keepdims=True)) + 1e-30
    t = np.exp(transition - transition.max())
    counts = np.diff(first)
    pieces = -(-counts // stretch)
    doc_piece = np.append(0, np.cumsum(pieces))
    doc = np.repeat(np.arange(len(counts)), pieces)
    begin = first[:-1][doc] + (np.arange(len(doc)) - doc_piece[:-1][doc]) * stretch
    size = np.minimum(begin + stretch, first[1:][doc]) - begin
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    live = [int(np.searchsorted(-size, -step, "left")) for step in range(int(size[0]))]  # pieces longer than step come first
    m = len(order)
    fold = np.tile(np.eye(labels), (m, 1, 1))
    for step, k in enumerate(live):
        own = (fold[:k].reshape(-1, labels) @ t).reshape(k, labels, labels) * e[begin[:k] + step][:, None, :]
        fold[:k] = own / own.sum(axis=(1, 2), keepdims=True)
    back_to = np.empty(m, np.int64)
    back_to[order] = np.arange(m)
    ahead, behind = np.ones((m, labels)), np.ones((m, labels))
    rows = np.flatnonzero(pieces > 1)
    for k in range(1, int(pieces.max())):
        rows = rows[pieces[rows] > k]
        left, right = back_to[doc_piece[rows] + k - 1], back_to[doc_piece[rows] + k]
        a = np.einsum("ij,ijk->ik", ahead[left], fold[left])
        ahead[right] = a / a.sum(axis=1, keepdims=True)
        last, before = back_to[doc_piece[rows + 1] - k], back_to[doc_piece[rows + 1] - k - 1]
        b = np.einsum("ijk,ik->ij", fold[last], behind[last])
        behind[before] = b / b.sum(axis=1, keepdims=True)
    out = np.empty_like(e)
    start = ahead.copy() if pairs is not None else ahead
    a = ahead
    for step, k in enumerate(live):
        x = (a[:k] @ t) * e[begin[:k] + step]
        x /= x.sum(axis=1, keepdims=True)
        a[:k] = out[begin[:k] + step] = x
    b = behind
    for step in range(len(live) - 1, -1, -1):
        k = live[step]
        at = begin[:k] + step
        if pairs is not None:  # forward message of the word before, transition, this word, backward message
            left, right = out[at - 1] if step else start[:k], e[at] * b[:k]
            pairs += t * ((left / ((left @ t) * right).sum(axis=1, keepdims=True)).T @ right)
        both = out[at] * b[:k]
        out[at] = both / both.sum(axis=1, keepdims=True)
        y = (e[at] * b[:k]) @ t.T
        b[:k] = y / y.sum(axis=1, keepdims=True)
    return out


def pair_counts(y: np.ndarray, first: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Label pairs of known labels; the label before a first word is known only by the model."""
    t = np.exp(transition - transition.max())
    out = np.zeros_like(t)
    heads = np.zeros(len(y), bool)
    heads[first[:-1][np.diff(first) > 0]] = True
    inner = np.flatnonzero(~heads)
    np.add.at(out, (y[inner - 1], y[inner]), 1)
    return out + t / t.sum(axis=0) * np.bincount(y[heads], minlength=len(t))


class Model:
    def __init__(self, labels: list[str], weights: np.ndarray, transition: np.ndarray):
        self.labels, self.weights, self.transition = labels, weights, transition


def fit(texts: list[bytes], langs: list[str], passes: int = 2, sequence: int = 64, batch: int = 128, rate: float = 0.3, seed: int = 5) -> Model:
    """Stochastic gradient (AdaGrad) on spliced sequences of the sample."""
    labels = sorted(set(langs))
    index = {x: i for i, x in enumerate(labels)}
    n = len(labels)
    weights = np.zeros((1 << BITS, n), np.float32)
    transition = np.zeros((n, n))
    if n < 2:
        return Model(labels, weights, transition)
    offsets = np.append(0, np.cumsum([len(t) for t in texts]))
    data = lower_ascii(np.frombuffer(b"".join(texts), np.uint8))
    start, stop, first = words(data, offsets)
    features, at = word_features(Prefix(data), start, stop)
    label = np.repeat([index[x] for x in langs], np.diff(first))
    rng = np.random.default_rng(seed)
    half = sequence // 4
    pieces = np.concatenate([np.arange(a, b - half + 1, half) for a, b in zip(first[:-1], first[1:], strict=True) if b - a >= half] or [np.empty(0, np.int64)])
    if not len(pieces):
        return Model(labels, weights, transition)
    seen_w, seen_t = np.full(weights.shape, 1e-3, np.float32), np.full((n, n), 1e-3)
    for _ in range(passes):
        rng.shuffle(pieces)
        usable = pieces[: len(pieces) // 4 * 4]
        for at_ in range(0, len(usable), 4 * batch):
            own = usable[at_ : at_ + 4 * batch]
            # runs of one language stand together within a batch, so most places do not switch
            own = own.reshape(-1, 4)
            mixed = rng.random(len(own)) < 0.3
            flat = own[~mixed].ravel()
            flat = flat[np.argsort(label[flat], kind="stable")]
            own = np.concatenate([own[mixed], flat.reshape(-1, 4)]) if len(flat) else own
            word = (own[:, :, None] + np.arange(half)).reshape(len(own), -1)
            ids = word.ravel()
            sizes = at[ids + 1] - at[ids]
            cut = np.append(0, np.cumsum(sizes))
            f = features[np.repeat(at[ids] - cut[:-1], sizes) + np.arange(cut[-1])]
            scores = np.add.reduceat(weights[f], cut[:-1], axis=0).astype(float)
            firsts = np.arange(len(own) + 1) * word.shape[1]
            pairs = np.zeros((n, n))
            p = marginals(scores, firsts, transition, pairs=pairs)
            y = label[ids]
            gap = p.copy()
            gap[np.arange(len(y)), y] -= 1
            grad = np.zeros_like(weights)
            np.add.at(grad, f, np.repeat(gap, sizes, axis=0).astype(np.float32))
            grad /= len(own)
            seen_w += grad * grad
            weights -= rate * grad / np.sqrt(seen_w)
            g = (pairs - pair_counts(y, firsts, transition)) / len(own)
            seen_t += g * g
            transition -= rate * g / np.sqrt(seen_t)
    return Model(labels, weights, transition)


_TAGS_DDL = "lang_pred string, score double, mass array<double>"


def _tag(shared, spans: bool):
    span = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("lang", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for rows, data, offsets in slices(batches):
            scores, first = emissions(data, offsets, model.weights)
            p = marginals(scores, first, model.transition)
            total = np.stack([sums_by(p[:, j], first) for j in range(len(model.labels))], axis=1) if len(model.labels) else np.zeros((rows.num_rows, 0))
            count = np.maximum(np.diff(first), 1)
            best = total.argmax(axis=1) if len(model.labels) else np.zeros(rows.num_rows, np.int64)
            score = np.clip(total[np.arange(len(best)), best] / count, 0, 1) if len(model.labels) else np.zeros(rows.num_rows)
            names = pa.array([model.labels[i] for i in best] if model.labels else ["und"] * rows.num_rows, pa.string())
            columns = [rows.column("id"), rows.column("letters"), names, pa.array(score), pa.array(list(total / count[:, None]), pa.list_(pa.float64()))]
            fields = ["id", "letters", "lang_pred", "score", "mass"]
            if spans:
                start, stop, _ = words(lower_ascii(data), offsets)
                tags = p.argmax(axis=1) if len(p) else np.empty(0, np.int64)
                runs = []
                for d in range(rows.num_rows):
                    a, b = first[d], first[d + 1]
                    cuts = np.flatnonzero(tags[a + 1 : b] != tags[a : b - 1]) + a + 1 if b > a else []
                    edges = [a, *cuts, b] if b > a else []
                    runs.append([{"start": int(start[x] - offsets[d]), "length": int(stop[y - 1] - start[x]), "lang": model.labels[tags[x]]} for x, y in zip(edges[:-1], edges[1:], strict=False)])
                columns.append(pa.array(runs, pa.list_(span)))
                fields.append("spans")
            yield pa.record_batch(columns, names=fields)

    return work


def language_id(docs: DataFrame, training, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_fitted: int = 2_000, most_bytes: int = 20_000, with_spans: bool = False) -> DataFrame:
    """Per row: id, lang_pred, score, mass (share of each learned label, in name order), and on request spans by language.

    Learns from about ``most_fitted`` rows (twice that at most) for which ``training`` holds,
    chosen by a hash of the id among texts of at most ``most_bytes`` bytes; tags every row.
    """
    spark = docs.sparkSession
    usable = docs.where(training & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & (F.octet_length(text_col) <= most_bytes))
    n = usable.count()
    share = F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(1 << 20)) < int((1 << 20) * min(1.0, most_fitted / max(n, 1)))
    sample = usable.where(share).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).limit(2 * most_fitted).toArrow().to_pandas()
    sample = sample.sort_values(["id", "text"], kind="stable")
    model = fit([t.encode() for t in sample.text], list(sample.lang))
    shared = spark.sparkContext.broadcast(model)
    text = docs.select(id_or_least(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    spans = ", spans array<struct<start:long,length:long,lang:string>>" if with_spans else ""
    out = text.mapInArrow(_tag(shared, with_spans), "id long, letters boolean, " + _TAGS_DDL + spans)
    known = F.col("letters") & F.lit(bool(model.labels))
    return out.select(null_if_least("id").alias(id_col), F.when(known, F.col("lang_pred")).otherwise("und").alias("lang_pred"), F.when(known, F.col("score")).otherwise(0.0).alias("score"), "mass", *(["spans"] if with_spans else []))


__all__ = ["language_id", "fit", "marginals", "emissions", "i64"]
