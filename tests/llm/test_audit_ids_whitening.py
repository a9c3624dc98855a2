"""Filter audit, Simple-8b files and whitening against plain versions and exact round trips."""

import itertools
import os
import re
import uuid
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tradelens.llm import filter_audit as audit
from tradelens.llm.queries import oracle_sql, queries, tokenizer_path
from tradelens.llm.simple8b import BLOCK, decode, encode, from_payload, read_ids, to_payload, write_ids
from tradelens.llm.textcols import checkpoint_folder, small_batches
from tradelens.llm.whitening import by_component, moments, whiten

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_audit(docs, labels):
    """The contract, order by order and document by document."""
    good = {d for d, q, t in labels if q == 1}
    toxic = {d for d, q, t in labels if t == 1}
    texts = {}
    for d, text, *_ in docs:
        if d is not None:
            texts.setdefault(text or "", []).append(d)
    rows = []
    for d, text, _, source, _ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": d is not None and min(texts[text]) < d,
        }
        rows.append((source or "", {f for f, x in fails.items() if x}, d in good, d in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        removed_by = dict.fromkeys("ABCDE", 0)
        own = [r for r in rows if r[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                before = len(own) - len(left)
                left = [r for r in left if f not in r[1]]
                redundant = sum(f in r[1] for r in own) - len(gone)
                assert redundant <= before
                removed_by[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed_by[order[step - 1]])
    return out


def audit_rows():
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(1, long, "en", "a", 1), (2, long, "en", "a", 1), (2, long, "en", "b", 1), (5, long + " X", "en", "a", 1), (4, long, "de", None, 1), (None, long, "en", "a", 1), (None, long, "en", "a", 1)]
    rows += [(10, None, "en", "a", 0), (11, "", "en", "", 0), (12, "", None, None, 0), (13, "same " * 80, "en", "a", 1), (14, "SHOUT " * 60, "en", "b", 1), (15, long + " #", "en", "b", 1)]
    rows += [(20 + i, long[:300] + chr(97 + i % 3) * 40, "en", "a", 1) for i in range(9)]  # one length, equal first blocks
    rows += [(40 + i, "x" * 3000 + "yz"[i % 2], "en", "c", 1) for i in range(4)]
    rows += [(60, "a\x1cb c\x85d e " * 30, "fr", "c", 1), (61, "漢字 " * 70, "zh", "c", 1), (-3, "漢字 " * 70, "zh", "c", 1)]
    return rows


@pytest.mark.parametrize("weak", [False, True])
def test_audit_equals_the_plain_version_even_where_all_hashes_collide(spark, weak):
    rows, labels = audit_rows(), [(1, 1, 0), (2, 1, 1), (2, 0, 0), (10, None, 1), (14, 0, 1), (None, 1, 1), (99, 1, 1), (61, 1, None)]
    docs = small_batches(spark).createDataFrame(rows, DOCS).repartition(3)
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    hashed = (lambda text, start, size: F.lit(7).cast("long")) if weak else audit.block_hash
    out = audit.filter_audit(docs, said, hashed=hashed).collect()
    assert {(r.part, r.filter_order, r.step): list(r[3:]) for r in out} == plain_audit(rows, labels)
    assert len(out) == 600 * len({r[3] or "" for r in rows})


def test_audit_of_a_hot_text_salts_its_class(spark):
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "one common text").otherwise(F.concat(F.lit("text "), F.lpad(F.col("id").cast("string"), 10, "0"))).alias("text"), F.lit("s").alias("source"))
    out = {r.mask: r.n for r in audit.masks(docs).groupBy("mask").agg(F.count("*").alias("n")).collect()}
    assert out == {1: 4501, 17: 4499}


def test_words_of_long_texts_are_counted_in_pieces(monkeypatch):
    text = b"alpha beta\x0bgamma alpha " * 50
    whole = audit._counted(text)
    monkeypatch.setattr(audit, "_SLICE", 7)
    assert audit._counted(text) == whole == (200, 3)
    assert audit._counted(b"x" * 100) == (1, 1)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**32 - 1), st.just(0)), max_size=700), st.sampled_from([1, 2, 16, 1024]))
def test_simple8b_round_trip(ids, block):
    ids = np.array(ids, np.uint32)
    words, first_word, escapes, first_escape = encode(ids, block)
    assert (decode(words, first_word, escapes, first_escape, len(ids), block) == ids).all()


def test_simple8b_words_hold_what_their_selectors_say():
    zeros = encode(np.zeros(1024, np.uint32))[0]
    assert len(zeros) == 5 and {int(w >> np.uint64(60)) for w in zeros} <= {0, 1}
    small = np.tile(np.arange(15, dtype=np.uint32), 68)
    words, _, escapes, _ = encode(small)
    assert len(words) == 68 and not len(escapes)  # 15 ids of 4 bits; 15 itself would be an escape
    mixed = np.array([3] * 11 + [70_000] + [3] * 3, np.uint32)
    words, _, escapes, _ = encode(mixed)
    assert len(escapes) and escapes.tolist() == [70_000]


def test_blocks_of_a_segment_decode_alone():
    rng = np.random.default_rng(5)
    ids = np.where(rng.random(5000) < 0.05, rng.integers(0, 2**32, 5000), rng.geometric(0.01, 5000)).astype(np.uint32)
    payload = to_payload(ids, np.array([1000, 0, 4000]))
    whole, sizes = from_payload(payload)
    assert (whole == ids).all() and sizes.tolist() == [1000, 0, 4000]
    for b in range(5):
        assert (from_payload(payload, range(b, b + 1))[0] == ids[b * BLOCK : (b + 1) * BLOCK]).all()
    assert (from_payload(payload, range(1, 9))[0] == ids[BLOCK:]).all()
    with pytest.raises(ValueError):
        from_payload(payload[:-8])
    with pytest.raises(ValueError):
        from_payload(b"abcd" + payload[4:])


def test_ids_in_files_equal_those_of_the_library(spark):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(tokenizer_path())
    texts = ["Hello world, it's 12 o'clock", "", None, "naïve  \n\n  spaces\t漢字", "<|endoftext|> inside <|endoftext|>", "long " * 30_000, "don't 'stop", " lead", "😀 emoji ‍ ok"]
    rows = [(3 * i - 7, t) for i, t in enumerate(texts)] + [(2, "again"), (2, "again"), (2, "other"), (None, "no id"), (-(1 << 63), "least id"), ((1 << 63) - 1, "last id")]
    docs = small_batches(spark).createDataFrame(rows, "doc_id long, text string").repartition(4)
    path = f"{checkpoint_folder(spark)}/ids-{uuid.uuid4()}"
    write_ids(docs, tokenizer_path(), path, segment=100)
    got = read_ids(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, *sorted(r[0] for r in rows if r[0] is not None)]
    at = 0
    want = sorted((d is not None, d or 0, [*coder.encode(t or "", add_special_tokens=False).ids, 0]) for d, t in rows)
    for r in got:
        assert r.start == at
        at += r.n_tokens
        assert r.n_tokens * 4 == len(r.ids) and r.ids_crc32 == zlib.crc32(r.ids)
    assert sorted((r.doc_id is not None, r.doc_id or 0, np.frombuffer(r.ids, "<u4").tolist()) for r in got) == want
    files = spark.read.parquet(path)
    edges = [(r.first_id, r.last_id) for r in files.orderBy("shard", "ahead").select("first_id", "last_id").collect()]
    flat = [x for e in edges for x in e]
    assert flat == sorted(flat, key=lambda x: (x is not None, x or 0))


def test_ids_of_nothing(spark):
    path = f"{checkpoint_folder(spark)}/ids-{uuid.uuid4()}"
    write_ids(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path(), path)
    assert read_ids(spark, path).collect() == []


def test_ids_of_one_hot_document_spread_over_files(spark):
    docs = small_batches(spark).range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same text in every row").alias("text"))
    path = f"{checkpoint_folder(spark)}/ids-{uuid.uuid4()}"
    write_ids(docs, tokenizer_path(), path, shard_bytes=20_000)
    sizes = [r.n for r in spark.read.parquet(path).groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()]
    assert len(sizes) > 3 and max(sizes) < 3 * sorted(sizes)[len(sizes) // 2]


def plain_whitening(rows, k=8):
    """With whole numbers throughout, but for the eigenvectors."""
    fit = [(i, [int(np.floor(1024 * np.float64(c))) + 100_000 for c in v]) for i, v in rows]
    x = np.array([v for _, v in fit], object)
    n, sums = len(x), x.sum(axis=0)
    apart = x * n - sums
    cov = np.array([[sum(apart[:, i] * apart[:, j]) / n**3 for j in range(x.shape[1])] for i in range(x.shape[1])], float)
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    white = (apart / n).astype(float) @ axes[:, order] / np.sqrt(values[order])
    return n, [int((a * a).sum()) for a in apart], white, values[order] / np.trace(cov)


def vectors(n, dim, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) * np.linspace(2, 0.3, dim) + rng.normal(size=dim) * 50
    return [(i, [float(np.float32(c)) for c in row]) for i, row in enumerate(x)]


def test_whitening_equals_whole_number_arithmetic(spark):
    rows = vectors(301, 12)
    bad = [(900, None), (901, [1.0] * 11 + [float("nan")]), (902, [float("inf")] + [0.0] * 11), (903, [None] + [0.5] * 11), (904, []), (905, [1.0] * 3), (None, rows[0][1]), (7, rows[7][1])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").repartition(5)
    out = by_component(whiten(df)).collect()
    used = rows + bad[-2:]
    n, deviation, white, explained = plain_whitening(used)
    assert len(out) == 8 * n
    want = {}
    for (i, _), d, w in zip(used, deviation, white, strict=True):
        want.setdefault(i, []).append((d, w))
    signs = {}
    for r in out:
        d, w = want[r.vec_id][0]
        k = r.component - 1
        assert r.n == n and r.deviation == d and abs(r.explained / explained[k] - 1) < 1e-9 and r.identity_error < 1e-9
        signs.setdefault(k, np.sign(r.whitened * w[k]))
        assert abs(r.whitened - signs[k] * w[k]) < 1e-7
    assert len({r.identity_error for r in out}) == 1


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5, 0.25])], [(1, [0.5, 0.25])] * 5])
def test_whitening_without_variance_gives_no_rows(spark, rows):
    assert by_component(whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))).collect() == []


def test_whitening_of_fewer_dimensions_and_of_large_entries(spark):
    rows = [(i, [float(i % 3), float(i % 5) * 2.0**45]) for i in range(60)] + [(99, [1e30, 0.0])]
    more = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("?") for c in ("id", "x", "c", "n", "k", "part", "dim")})
    out = whiten(more).collect()
    assert len(out) == 60 and {r.n for r in out} == {60}
    exact = [np.array([60 * (1024 * (i % 3)) - sum(1024 * (j % 3) for j in range(60)), 60 * ((i % 5) * 2**55) - sum((j % 5) * 2**55 for j in range(60))], object) for i in range(60)]
    assert {r.vec_id: int(r.deviation) for r in out} == {i: int((e * e).sum()) for i, e in enumerate(exact)}
    assert by_component(whiten(more)).where("deviation is not null and abs(deviation) > 1e18").count() == 0


def test_merged_moments_equal_those_of_all_rows():
    x = np.random.default_rng(1).integers(-(10**6), 10**6, (997, 5)) + 10**8
    parts = [moments(x[a:b]) for a, b in zip([0, 1, 400, 777], [1, 400, 777, 997], strict=True)]
    merged = parts[3].merge(parts[0].merge(parts[2])).merge(parts[1])
    whole = x.astype(object) * 997 - x.astype(object).sum(axis=0)
    exact = np.array([[sum(whole[:, i] * whole[:, j]) / 997**2 for j in range(5)] for i in range(5)], float)
    assert merged.n == 997 and merged.sums == x.sum(axis=0).tolist()
    assert np.abs(merged.scatter - exact).max() < 1e-11 * np.abs(exact).max()


def test_queries_of_whole_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = queries()["op12_simple8b"](spark, small).orderBy("start").collect()
    assert len(got) == docs.count() and [r.doc_id for r in got] == sorted(r.doc_id for r in got)
    vectors_ = spark.read.parquet(f"{small}/embeddings.parquet")
    white = queries()["op13_whitening"](spark, small)
    assert white.count() == 8 * vectors_.count() and white.agg(F.max("identity_error")).first()[0] < 1e-9


def test_audit_equals_its_sql(spark, small):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet/*.parquet'" if os.path.isdir(f"{small}/{name}.parquet") else f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    want = con.sql(oracle_sql()["op11_filter_audit"])
    got = queries()["op11_filter_audit"](spark, small).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


@pytest.mark.parametrize("most", [3, 40, 100_000])
def test_a_small_memory_of_pieces_changes_no_ids(most):
    from tokenizers import Tokenizer

    from tradelens.llm.pretokens import Tokens
    from tradelens.llm.simple8b import LibraryTokens

    whole = Tokenizer.from_file(tokenizer_path())
    for coder in (Tokens(tokenizer_path()), LibraryTokens(tokenizer_path())):
        coder.most = most
        for turn in range(6):
            texts = [f"the same words come again, and word{turn * 7 + i} once \n\n" * (1 + i % 2) for i in range(7)]
            raw = [t.encode() for t in texts]
            ids, at = coder.encode(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(x) for x in raw])))
            assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [x.ids for x in whole.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("weak", ["first", "first of later texts"])
def test_pieces_of_one_hash_keep_their_own_ids(monkeypatch, weak):
    from tokenizers import Tokenizer

    from tradelens.llm import pretokens
    from tradelens.llm.simple8b import LibraryTokens

    def colliding(data, start, stop):
        key, other = piece_hashes(data, start, stop)
        return (key * np.uint64(0) if weak == "first" else key % np.uint64(3)), other

    piece_hashes = pretokens.piece_hashes
    monkeypatch.setattr(pretokens, "piece_hashes", colliding)
    whole = Tokenizer.from_file(tokenizer_path())
    for coder in (pretokens.Tokens(tokenizer_path()), LibraryTokens(tokenizer_path())):
        for text in ("!", "?", " words", "! !\0 !\0\0 ! words", "one, two, three, one"):  # texts of one piece meet those before them
            raw = text.encode()
            ids, _ = coder.encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids
