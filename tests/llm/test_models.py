"""Model parts against enumeration, and held-out accuracy."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradelens.llm import queries as q
from tradelens.llm.crf_langid import language_id, marginals, pair_counts
from tradelens.llm.media import box, features, sample_table, walk, write_media
from tradelens.llm.mixing import mix_documents, rake
from tradelens.llm.ppm import Trie, learn
from tradelens.llm.textcols import crc_remainder
from tradelens.llm.toxicity import maximal_segments


def test_code_lengths_are_a_distribution_in_every_context(spark, small):
    """Also after contexts that were never seen, and after those that were seen only in part."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    trie = Trie(learn(docs))
    seen = trie.contexts[4].orderBy(F.xxhash64("context")).limit(30).select("context")
    other = spark.createDataFrame([(int.from_bytes(x, "big"),) for x in (b"\xff\xfe\xfd\xfc", b"\xffthe", b"\xff\xfehe", b"\0\0\0\0", b"\xff\xfe\xfde")], "context long")
    strings = seen.union(other).distinct().select(F.explode(F.sequence(F.lit(0), F.lit(255))).alias("symbol"), "context").select((F.shiftleft("context", 8) + F.col("symbol")).alias("string"))
    total = trie.bits(strings).groupBy(F.shiftright("string", 8).alias("context")).agg(F.sum(F.pow(F.lit(2.0), -F.col("bits"))).alias("p"), F.count("*").alias("n")).collect()
    assert len(total) >= 30 and all(r.n == 256 and r.p == pytest.approx(1, abs=1e-9) for r in total)


def test_code_length_by_hand(spark):
    docs = spark.createDataFrame([("ab",), ("ab",), ("ac",)], "text string")
    trie = Trie(learn(docs, order=1), order=1)
    want = {
        b"\0a": np.log2(4 / 3), b"ab": np.log2(5 / 2), b"b\0": np.log2(3 / 2),  # after nothing: a (3 of 3, one kind); after a: b 2 of 3, two kinds; after b: the end, 2 of 2
        b"bc": np.log2(3) + np.log2((6 + 3) / 1),  # an escape from b, then c once among a, b, c (6 of 9 bytes, the end excluded)
        b"xa": np.log2((9 + 4) / 3),  # x is no context: of all 9 bytes a is three, four kinds
        b"xy": np.log2((9 + 4) / 4) + np.log2(252),
    }
    got = {r.string.to_bytes(2, "big"): r.bits for r in trie.bits(spark.createDataFrame([(int.from_bytes(x, "big"),) for x in want], "string long")).collect()}
    assert got == {x: pytest.approx(v) for x, v in want.items()}


def test_marginals_by_enumeration():
    rng = np.random.default_rng(1)
    scores, transition = rng.normal(size=(9, 3)), rng.normal(size=(3, 3))
    first = np.array([0, 5, 5, 9])
    got = marginals(scores, first, transition, stretch=2)
    t = np.exp(transition)
    for a, b in ((0, 5), (5, 9)):
        want = np.zeros((b - a, 3))
        for path in itertools.product(range(3), repeat=b - a):
            p = t[:, path[0]].sum() * np.exp(sum(scores[a + k, y] for k, y in enumerate(path)))
            p *= np.prod([t[x, y] for x, y in itertools.pairwise(path)])
            for k, y in enumerate(path):
                want[k, y] += p
        assert np.allclose(got[a:b], want / want.sum(axis=1, keepdims=True), atol=1e-9)


def log_likelihood(scores, first, transition, y):
    total = 0.0
    for a, b in itertools.pairwise(first):
        def weight(path, a=a):
            return np.logaddexp.reduce(transition[:, path[0]]) + sum(scores[a + k, x] for k, x in enumerate(path)) + sum(transition[x, z] for x, z in itertools.pairwise(path))
        if b > a:
            total += weight(y[a:b]) - np.logaddexp.reduce([weight(p) for p in itertools.product(range(len(transition)), repeat=b - a)])
    return total


@pytest.mark.parametrize("stretch", [2, 64])
def test_transition_gradient_by_finite_differences(stretch):
    rng = np.random.default_rng(3)
    scores, transition, y = rng.normal(size=(10, 3)), rng.normal(size=(3, 3)), rng.integers(0, 3, 10)
    first = np.array([0, 6, 6, 7, 10])
    pairs = np.zeros((3, 3))
    marginals(scores, first, transition, stretch=stretch, pairs=pairs)
    assert pairs.sum() == pytest.approx(10)
    got = pair_counts(y, first, transition) - pairs
    for i, j in itertools.product(range(3), repeat=2):
        step = np.zeros((3, 3))
        step[i, j] = 1e-5
        want = (log_likelihood(scores, first, transition + step, y) - log_likelihood(scores, first, transition - step, y)) / 2e-5
        assert got[i, j] == pytest.approx(want, abs=1e-6)


def segments_by_hand(values, begin=0):
    best, where = 0.0, None
    for i in range(len(values)):
        total = 0.0
        for j in range(i, len(values)):
            total += values[j]
            if total > best + 1e-12:
                best, where = total, (i, j)
    if where is None:
        return []
    i, j = where
    return segments_by_hand(values[:i], begin) + [(begin + i, begin + j)] + segments_by_hand(values[j + 1 :], begin + j + 1)


def test_segments_against_the_definition():
    rng = random.Random(2)
    for _ in range(200):
        values = [rng.uniform(-2, 2) for _ in range(rng.randrange(0, 25))]
        at = [i for i, v in enumerate(values) if v > 0]
        sums = np.append(0, np.cumsum(values))
        found = [(at[a], at[b]) for a, b in maximal_segments(sums[at] if at else np.empty(0), sums[[i + 1 for i in at]] if at else np.empty(0))]
        assert found == segments_by_hand(values)


def test_boxes_of_all_sizes_and_broken_files():
    media = write_media(bytes(576 * 40))
    assert features(media)[5] == 40 and len(features(media)[6]) == 3
    assert [p[-1] for p, _, _ in walk(box(b"free", b"abc") + b"\0\0\0\1wide" + (24).to_bytes(8, "big") + bytes(8) + b"\0\0\0\0mdat123")] == [b"free", b"wide", b"mdat"]
    for cut in (3, 40, 300, len(media) - 1):
        assert features(media[:cut])[-1]
    assert features(b"")[-1]


def fragmented(frames, explicit):
    """A file whose samples stand in two movie fragments; sizes, durations and flags by run or by default."""
    whole = write_media(frames[0])
    moov = next(whole[body - 8 : end] for path, body, end in walk(whole) if path == (b"moov",))

    def rebuilt(data):
        """Boxes of ``data`` with the tables emptied."""
        out, at = b"", 0
        while at < len(data):
            size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
            body = data[at + 8 : at + size]
            if kind in (b"trak", b"mdia", b"minf", b"stbl"):
                body = rebuilt(body)
            elif kind in (b"stts", b"stsc", b"stco"):
                body = bytes(8)
            elif kind == b"stsz":
                body = bytes(12)
            if kind != b"stss":
                out += box(kind, body)
            at += size
        return out

    trex = box(b"mvex", box(b"trex", bytes(4), *(x.to_bytes(4, "big") for x in (1, 1, 1, 576, 0x10000))))
    out = box(b"ftyp", b"isom", bytes(4)) + box(b"moov", rebuilt(moov[8:]), trex)
    time = 0
    for payload in frames:
        n = len(payload) // 576
        if explicit:
            rows = b"".join(x.to_bytes(4, "big") for i in range(n) for x in (1, 576, 0x10000 if i % 4 else 0))
            run = lambda at: box(b"trun", (0x701).to_bytes(4, "big"), n.to_bytes(4, "big"), at.to_bytes(4, "big"), rows)  # noqa: B023, E731
        else:
            run = lambda at: box(b"trun", (0x5).to_bytes(4, "big"), n.to_bytes(4, "big"), at.to_bytes(4, "big"), bytes(4))  # noqa: B023, E731
        head = lambda at: box(b"moof", box(b"mfhd", bytes(8)), box(b"traf", box(b"tfhd", (0x20000).to_bytes(4, "big"), (1).to_bytes(4, "big")), box(b"tfdt", bytes(4), time.to_bytes(4, "big")), run(at)))  # noqa: B023, E731
        out += head(len(head(0)) + 8) + box(b"mdat", payload)
        time += n
    return out


@pytest.mark.parametrize("explicit", [True, False])
def test_samples_of_movie_fragments(explicit):
    frames = [bytes([k]) * (576 * n) for k, n in ((1, 9), (2, 5))]
    media = fragmented(frames, explicit)
    (track,) = sample_table(media)
    assert [t for _, _, t, _ in track["samples"]] == list(range(14)) and track["duration"] >= 14
    assert b"".join(media[o : o + n] for o, n, _, _ in track["samples"]) == b"".join(frames)
    assert [i for i, x in enumerate(track["samples"]) if x[3]] == ([0, 4, 8, 9, 13] if explicit else [0, 9])
    assert features(media)[5] == 14 and features(media)[-1] is None


def test_counts_beyond_the_file_are_errors():
    media = write_media(bytes(576 * 40))
    for kind, at in ((b"stsz", 8), (b"stts", 8), (b"stts", 4), (b"stsc", 4), (b"stco", 4)):
        body = next(b for p, b, _ in walk(media) if p[-1] == kind)
        broken = media[: body + at] + b"\xff\xff\xff\xf0" + media[body + at + 4 :]
        assert features(broken)[-1], kind


def test_raking_meets_every_margin(spark):
    rng = random.Random(4)
    cells = [(s, l, t, rng.randrange(1, 1000)) for s in "abc" for l in "xy" for t in "pqr"]
    frame = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    targets = {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "lang": {"x": 0.6, "y": 0.4}, "topic": {"p": 0.2, "q": 0.3, "r": 0.5}}
    out = rake(frame, ["source", "lang", "topic"], targets, tolerance=1e-7).toPandas()
    mass = out.tokens * out.weight
    for m, want in targets.items():
        have = mass.groupby(out[m]).sum() / mass.sum()
        for k, v in want.items():
            assert have[k] == pytest.approx(v, abs=1e-5)


def test_probabilities_equal_plain_raking(spark):
    """Documents of a small table against raking by hand over the whole table of cells."""
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 30)), rng.choice("abc"), rng.choice(["x", "y", None]), 0) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    targets = {"source": {"a": 0.5, "b": 0.25, "c": 0.25}, "lang": {"x": 0.2, "y": 0.5, None: 0.3}}
    got = {r.doc_id: r for r in mix_documents(docs, targets=targets, tolerance=1e-12).collect()}
    tokens = {i: len(t.split()) for i, t, *_ in rows}
    cell = {i: (s, lang) for i, _, s, lang, _ in rows}
    weight, total = {c: 1.0 for c in cell.values()}, sum(tokens.values())
    for _ in range(200):
        for place, name in enumerate(("source", "lang")):
            for value, share in targets[name].items():
                now = sum(tokens[i] * weight[c] for i, c in cell.items() if c[place] == value)
                for c in weight:
                    if c[place] == value:
                        weight[c] *= share * total / now
    top = max(weight.values())
    for i, c in cell.items():
        assert got[i].probability == pytest.approx(weight[c] / top, rel=1e-6) and got[i].n_tokens == tokens[i]


def test_a_tiny_heavy_cell_does_not_thin_out_the_rest(spark):
    rows = [(i, "w " * 20, "rare" if i == 0 else "ab"[i % 2], "en", 0) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    targets = {"source": {"rare": 0.1, "a": 0.45, "b": 0.45}}
    whole = mix_documents(docs, targets=targets).agg(F.sum("probability")).first()[0]
    spared = mix_documents(docs, targets=targets, spare=0.01)
    assert whole < 15 and spared.agg(F.sum("probability")).first()[0] > 350
    assert spared.where("doc_id = 0").first().probability == 1 and spared.agg(F.max("copies")).first()[0] == 1


def test_targets_that_cannot_be_met_are_told(spark):
    frame = spark.createDataFrame([("a", "x", "p", 10), ("b", "y", "p", 10)], "source string, lang string, topic string, tokens long")
    with pytest.warns(UserWarning, match="no weights meet"):
        rake(frame, ["source", "lang", "topic"], {"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.1, "y": 0.9}}, most_rounds=8)


def test_sampled_tokens_come_near_their_targets(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    out = mix_documents(docs).toPandas()
    expected = (out.n_tokens * out.probability).groupby(out.source.fillna("?")).sum()
    assert out.probability.between(0, 1).all()
    full = out.n_tokens.groupby(out.source.fillna("?")).sum() ** 0.7
    assert np.allclose(expected / expected.sum(), full / full.sum(), atol=1e-3)
    assert abs(out.selected.mean() - out.probability.mean()) < 0.05


def test_language_on_held_out_rows(spark, medium):
    lang = spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "lang")
    out = q.op6_crf_langid(spark, medium).join(lang, "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").toPandas()
    assert (out.lang == out.lang_pred).mean() > 0.9
    assert out.score.between(0, 1).all()


def test_code_switched_text_gets_spans(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet").where("lang is not null")
    long_ = docs.where(F.length("text").between(800, 3000))
    two = [long_.where(F.col("lang") == c).orderBy("doc_id").first() for (c,) in docs.select("lang").distinct().orderBy("lang").limit(2).collect()]
    mixed = spark.createDataFrame([(10**9, two[0].text + " " + two[1].text, None, "s", 1)], docs.schema.simpleString()[7:-1].replace(":", " "))
    out = language_id(docs.unionByName(mixed), F.col("doc_id") < 10**9, with_spans=True).where(F.col("doc_id") == 10**9).first()
    by = {}
    for s in out.spans:
        by[s.lang] = by.get(s.lang, 0) + s.length
    assert {two[0].lang, two[1].lang} <= set(by)


def test_switches_inside_a_text_are_found(spark, medium):
    """Words of texts spliced from held-out stretches of all languages get their own language."""
    docs = spark.read.parquet(f"{medium}/documents.parquet").where("lang is not null and length(text) between 600 and 6000")
    held = docs.where(crc_remainder("doc_id", 4) == 2).orderBy("doc_id").limit(160).collect()
    rng = random.Random(9)
    made, truth = [], {}
    for n in range(60):
        parts = [(r.lang, " ".join(r.text.split()[:25])) for r in rng.sample(held, 4)]
        truth[10**9 + n] = [(lang, len(t.encode()) + 1) for lang, t in parts]
        made.append((10**9 + n, " ".join(t for _, t in parts)))
    rows = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(made, "doc_id long, text string").withColumn("lang", F.lit(None).cast("string")))
    out = language_id(rows, crc_remainder("doc_id", 4) != 2, with_spans=True).where(F.col("doc_id") >= 10**9).collect()
    right = total = 0
    for r in out:
        want = np.repeat([lang for lang, _ in truth[r.doc_id]], [n for _, n in truth[r.doc_id]])
        for s in r.spans:
            right += (want[s.start : s.start + s.length] == s.lang).sum()
            total += s.length
    print("share of bytes with the right language", right / total)
    assert right > 0.9 * total


def area(score, label):
    order = np.argsort(score, kind="stable")
    ranks = np.empty(len(order))
    ranks[order] = np.arange(1, len(order) + 1)
    pos = label == 1
    return (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_toxicity_on_held_out_rows(spark, medium):
    large = medium.replace("sf0.01", "sf0.1")  # the smaller tables have six toxic rows held out
    labels = spark.read.parquet(f"{large}/labels.parquet")
    out = q.op10_toxicity(spark, large).join(labels, "doc_id").where("held_out").toPandas()
    assert area(out.score.to_numpy(), out.toxic.to_numpy()) > 0.9
    assert ((out.score >= 0.5) == (out.predicted == 1)).all()


def test_quality_on_held_out_rows(spark, medium):
    from tradelens.llm.cotrain import cotrain

    docs, labels = (spark.read.parquet(f"{medium}/{t}.parquet") for t in ("documents", "labels"))
    out = cotrain(docs, labels, training=crc_remainder("doc_id", 4) != 1)
    out = out.join(labels, "doc_id").where(crc_remainder("doc_id", 4) == 1).toPandas()
    assert area(out.score.to_numpy(), out.quality.to_numpy()) > 0.75


def cotrained_by_hand(frame, rounds, steps, sure, ridge):
    """The whole of co-training on one frame of all rows, by loops over the rows."""
    from tradelens.llm.cotrain import Content, Metadata
    from tradelens.llm.toxicity import logistic

    label = frame.quality.to_numpy(float)
    known = ~np.isnan(label)
    x = np.stack(frame.content.to_numpy())
    views = [Content(x[known])(x), Metadata()(frame.source, frame.lang, frame.length.to_numpy(float))]
    aside, learn = known & (frame.part.to_numpy() % 4 == 0), known & (frame.part.to_numpy() % 4 > 0)
    sigmoid = lambda t: 1 / (1 + np.exp(-np.clip(t, -60, 60)))
    w = [logistic(v[learn], label[learn], ridge) for v in views]

    def calibrate():
        out = []
        for v, own in zip(views, w, strict=True):
            odds = np.clip(v @ own[:-1] + own[-1], -30, 30)
            a, b = logistic(odds[aside][:, None], label[aside], ridge=0.1)
            out.append(max(a, 0.0) * odds + b)
        return out

    odds = calibrate()
    for _ in range(rounds):
        scale = [(np.polyfit(np.clip(v @ own[:-1] + own[-1], -30, 30), o, 1)) for v, own, o in zip(views, w, odds, strict=True)]
        for _ in range(steps):
            teach = [sigmoid(k[0] * np.clip(v @ own[:-1] + own[-1], -30, 30) + k[1]) for v, own, k in zip(views, w, scale, strict=True)]
            new = []
            for pupil in (0, 1):
                target, weight = np.where(learn, label, 0.0), learn.astype(float)
                for kind, p in ((0.0, 1 - teach[1 - pupil]), (1.0, teach[1 - pupil])):
                    rows = ~known & (p >= sure)
                    target[rows] = kind
                    weight[rows] = min(1.0, (label[learn] == kind).sum() / max(rows.sum(), 1))
                z = np.column_stack([views[pupil], np.ones(len(x))])
                p = sigmoid(z @ w[pupil])
                penalty = np.append(np.full(z.shape[1] - 1, ridge), 1e-6)
                grad, curve = penalty * w[pupil], np.diag(penalty) + 1e-9 * np.eye(z.shape[1])
                for r in np.flatnonzero(weight):
                    grad = grad + weight[r] * (p[r] - target[r]) * z[r]
                    curve = curve + weight[r] * p[r] * (1 - p[r]) * np.outer(z[r], z[r])
                new.append(np.round(w[pupil] - np.linalg.solve(curve, grad), 9))
            w = new
        odds = calibrate()
    mix = logistic(np.stack(odds, axis=1)[aside], label[aside], ridge=0.1)
    return sigmoid(max(mix[0], 0) * odds[0] + max(mix[1], 0) * odds[1] + mix[2])


def quality_rows(n=600, seed=7):
    """Good and bad texts; sources tell them apart too. Labels only for sources a and b."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good, source = i % 2, "ab"[i % 2] if i % 3 else "cd"[i % 2]
        words = [rng.choice(["river", "stone", "letter", "garden", "winter", "music"]) for _ in range(rng.randrange(8, 60))]
        text = " ".join(words).capitalize() + "." if good else "$$ " + "BUY NOW !! " * rng.randrange(2, 9) + "\n" + " ".join(words[:6])
        rows.append((i, text, "en", source, len(text)))
        if i % 3 and i % 5 < 2:
            labels.append((i, good, 0))
    return rows, labels


def test_cotraining_equals_a_plain_version(spark):
    from tradelens.llm.cotrain import _content, cotrain
    from tradelens.llm.textcols import id_or_least

    made, given = quality_rows()
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    labels = spark.createDataFrame(given, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in cotrain(docs, labels, rounds=2, sure=0.8).collect()}
    rows = docs.select(id_or_least("doc_id").alias("id"), "text", "source", "lang", F.col("n_chars").cast("double").alias("length"), F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 20)).alias("part"))
    frame = rows.mapInArrow(_content, "id long, source string, lang string, length double, part long, content array<double>").toPandas()
    frame["quality"] = frame.id.map({i: y for i, y, _ in given}).astype(float)
    frame = frame.sort_values(["part", "id"])
    want = cotrained_by_hand(frame, 2, 2, 0.8, 1.0)
    for i, p in zip(frame.id, want, strict=True):
        assert got[i] == pytest.approx(p, abs=1e-6)


def test_views_teach_each_other(spark):
    """Sources c and d have no labels: only the content view can tell the metadata view about them."""
    from tradelens.llm.cotrain import cotrain

    made, given = quality_rows(900)
    docs = spark.createDataFrame([(*r[:4], None) for r in made], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame(given, "doc_id long, quality int, toxic int")
    gap = {}
    for rounds in (0, 3):
        out = cotrain(docs, labels, rounds=rounds, sure=0.8).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.avg("meta_score").alias("m"))
        by = {r.source: r.m for r in out.collect()}
        gap[rounds] = by["d"] - by["c"]
    assert gap[3] > gap[0] + 0.2
