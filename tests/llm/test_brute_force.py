"""Whole queries against plain versions in Python."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tradelens.llm import queries as q

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def texts(spark, small):
    return {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_media_round_trip(spark, small, texts):
    got = rows(q.op2_media(spark, small))
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        payload = t + b"\xff" * (max(1, -(-len(t) // 576)) * 576 - len(t))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.media_bytes > r.payload_bytes and len(r.media_sha256) == 64 and "codec=raw" in r.feature


def removed_by_hand(texts, length):
    seen, out = set(), {}
    for i in sorted(texts):
        t, cover = texts[i], bytearray(len(texts[i]))
        for p in range(len(t) - length + 1):
            w = hash(t[p : p + length])
            if w in seen:
                cover[p : p + length] = b"\1" * length
            else:
                seen.add(w)
        out[i] = cover
    return out


def check_removed(got, texts, length):
    want = removed_by_hand(texts, length)
    for i, t in texts.items():
        cover = want[i]
        spans = sum(1 for k, _ in itertools.groupby(cover) if k)
        kept = bytes(b for b, c in zip(t, cover, strict=True) if not c)
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(t), sum(cover), spans, hashlib.sha256(kept).hexdigest()), i


def test_suffix_dedup(spark, small, texts):
    check_removed(rows(q.op3_suffix_dedup(spark, small)), texts, 100)


@pytest.fixture
def tiny_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "37")
    yield
    spark.conf.set(name, before)


@pytest.mark.parametrize("hot,by_bytes", [(4096, False), (2, False), (40, False), (4096, True), (50, True)])
def test_suffix_dedup_of_periodic_and_crowded_texts(spark, tiny_batches, hot, by_bytes):
    """``hot`` and batches so small that anchors pass them; with and without marks of whole repeats."""
    from pyspark.sql import functions as F

    from tradelens.llm.suffix_dedup import suffix_dedup

    rng = random.Random(3)
    passage = bytes(rng.choices(b"abcdefghij ", k=160)).decode()
    made = {1: "a" * 1000, 2: "ab" * 300, 3: "xyz " * 100, 4: "a" * 99, 5: "a" * 100}
    for i in range(6, 60):
        own = "".join(rng.choices("klmnopqrst ", k=rng.randrange(0, 120)))
        cut = rng.randrange(0, 60)
        made[i] = own + passage[cut:] + own[::-1] + passage[: 160 - cut]
    for i in range(60, 260):  # one anchor in many contexts, and in many equal ones
        made[i] = f"{i % 120:04d} " + passage[20:120] + f" {i % 90:04d} " + "filler " * (i % 3)
    docs = spark.createDataFrame(list(made.items()), "doc_id long, text string").repartition(5)
    out = suffix_dedup(docs, hot=hot, by_bytes=by_bytes)
    out = out.select("doc_id", "n_bytes", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s.length).alias("n_removed"), F.size("spans").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    check_removed(rows(out), {i: t.encode() for i, t in made.items()}, 100)


def test_suffix_dedup_tells_texts_of_one_id_apart(spark):
    from tradelens.llm.suffix_dedup import suffix_dedup

    rng = random.Random(12)
    passage = "".join(rng.choices("abcdefghij ", k=130))
    own = ["".join(rng.choices("klmnopqrst ", k=150)) for _ in range(12)]
    ids = [None, None, None, 7, 7, 7, 7, 1, 2, 3, 4, 5]
    made = [(i, t + passage) for i, t in zip(ids, own, strict=True)] + [(7, own[3] + passage), (None, None), (None, "")]
    got = suffix_dedup(spark.createDataFrame(made, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == len(made)
    kept = {bytes(r.kept).decode() for r in got}
    assert sum(passage in t for t in kept) == 1  # the copied row is the same document as the first of it
    assert all(any(t[:-5] in k for k in kept) for t in own)


def test_suffix_dedup_of_a_text_beyond_one_block(spark):
    from tradelens.llm.suffix_dedup import _BLOCK, suffix_dedup

    rng = np.random.default_rng(5)
    text = bytes(rng.integers(97, 123, _BLOCK + 70_000, dtype=np.uint8)).decode()
    made = [(1, text), (2, text[_BLOCK - 300 : _BLOCK + 200]), (3, "x" + text[-150:])]
    got = {r.doc_id: [(s.start, s.length) for s in r.spans] for r in suffix_dedup(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [(0, 500)], 3: [(1, 150)]}


def shingles(text, width=5):
    w = WORD.findall(text.translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)])


def components_by_hand(texts, percent):
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in holders[s])
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
        for s in sets[i]:
            holders[s].append(i)
    return {i: (len(sets[i]), find(i)) for i in texts}


def check_components(got, texts, percent):
    for i, (n, c) in components_by_hand(texts, percent).items():
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (n, c, c == i), i


def test_near_duplicates(spark, medium):
    own = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{medium}/documents.parquet").collect()}
    check_components(rows(q.op4_lsh_forest(spark, medium)), own, 85)


def test_near_duplicates_in_a_large_group(spark):
    from tradelens.llm.lsh_forest import lsh_forest

    rng = random.Random(5)
    base = [rng.choice("abcdefgh") + str(rng.randrange(500)) for _ in range(300)]
    made = {}
    for i in range(400):
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        made[i] = " ".join(w)
    for i in range(400, 500):  # chains: each differs a little from the one before
        w = made[i - 1].split() if i > 400 else [f"c{j}" for j in range(200)]
        w[rng.randrange(len(w))] = f"step{i}"
        made[i] = " ".join(w)
    docs = spark.createDataFrame(list(made.items()), "doc_id long, text string").repartition(7)
    check_components(rows(lsh_forest(docs, percent=85)), {i: t.encode() for i, t in made.items()}, 85)


def without_centre(variants=800, seed=8):
    """Variants of one text, most of them too far from each other; each tenth has a partner of similarity 0.87 or more."""
    rng = random.Random(seed)

    def changed(words, n):
        words = list(words)
        for j in rng.sample(range(len(words)), n):
            words[j] = f"new{rng.randrange(10**9)}"
        return words

    made = [changed([f"w{j}" for j in range(300)], 3) for _ in range(variants)]
    made += [changed(made[i], 4) for i in range(0, variants, 10)]
    return {i: " ".join(w) for i, w in enumerate(made)}


def test_partners_in_a_group_without_a_centre(spark):
    from tradelens.llm.lsh_forest import lsh_forest

    made = without_centre()
    docs = spark.createDataFrame(list(made.items()), "doc_id long, text string").repartition(7)
    got = rows(lsh_forest(docs, percent=85))
    lost = [i for i in range(80) if got[800 + i].component_id != got[10 * i].component_id]
    assert not lost, len(lost)


def test_packing(spark, small, texts):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(q.tokenizer_path())
    want = {i: [*coder.encode(t.decode(), add_special_tokens=False).ids, 0] for i, t in texts.items()}
    pieces = q.op5_packing(spark, small).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = want[p.doc_id][p.start : p.start + p.length]
        assert p.length == len(ids) > 0 and p.doc_tokens == len(want[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        by_doc[p.doc_id].append((p.start, p.length))
        by_sequence[p.sequence_id].append((p.offset, p.length))
    assert by_doc.keys() == want.keys()
    for parts, n in [*((v, len(want[i])) for i, v in by_doc.items()), *((v, None) for v in by_sequence.values())]:
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == n if n is not None else at <= 1024
    sizes = [sum(n for _, n in v) for v in by_sequence.values()]
    padding = sum(0 if s & (s - 1) == 0 else 1024 - s for s in sizes)
    assert padding <= 0.01 * sum(sizes)


def test_line_rules_base_counts(spark, small, texts):
    got = rows(q.op7_line_rules(spark, small))
    for i, raw in texts.items():
        text = raw.decode()
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {k + o for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for o in range(3)}
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, i
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w))
        assert not (r.kept and r.base_failed)


def test_line_rules_sql(spark, small):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    want = con.sql(q.oracle_sql()["op7_line_rules"])
    columns = want.columns
    got = [tuple(r[c] for c in columns) for r in q.op7_line_rules(spark, small).collect()]
    assert sorted(got) == sorted(want.fetchall())


def test_unigram_baseline(spark, small, texts):
    train = Counter()
    tokens = {i: [*WORD.findall(t.translate(LOWER)), None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    for i, w in tokens.items():
        if not held[i]:
            train.update(w)
    total, kinds = sum(train.values()), len(train)
    got = rows(q.op9_ppm(spark, small))
    for i, w in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w), sum(train[x] > 0 for x in w), total)
        assert r.base_score == pytest.approx(sum(np.log10((train[x] + 1) / (total + kinds + 1)) for x in w), rel=1e-9)
        assert r.score < 0


def bits_by_hand(texts, training, order):
    """Code length of each text by a plain adaptive walk down the contexts."""
    counts = [defaultdict(Counter) for _ in range(order + 1)]
    for i, t in texts.items():
        if training(i):
            own = bytes(order) + t + b"\0"
            for p in range(order, len(own)):
                for k in range(order + 1):
                    counts[k][own[p - k : p]][own[p]] += 1
    out = {}
    for i, t in texts.items():
        own, bits = bytes(order) + t + b"\0", 0.0
        for p in range(order, len(own)):
            gone: set[int] = set()
            for k in range(order, -1, -1):
                here = counts[k].get(own[p - k : p])
                if not here:
                    continue
                free = {x: n for x, n in here.items() if x not in gone}
                escape = len(free) if len(here) < 256 else 0
                if own[p] in free:
                    bits += np.log2((sum(free.values()) + escape) / free[own[p]])
                    break
                if escape:
                    bits += np.log2((sum(free.values()) + escape) / escape)
                gone |= set(here)
            else:
                bits += np.log2(256 - len(gone))
        out[i] = bits
    return out


@pytest.mark.parametrize("order,common", [(4, 1 << 22), (4, 300), (2, 1), (6, 1000)])
def test_code_lengths_of_whole_texts(spark, small, texts, order, common):
    """With all, some and no strings sent to the tasks."""
    from pyspark.sql import functions as F

    from tradelens.llm.ppm import ppm_scores

    some = {i: t for i, t in texts.items() if len(t) < 3000}
    want = bits_by_hand(some, lambda i: i % 3 > 0, order)
    docs = spark.read.parquet(f"{small}/documents.parquet").where(F.octet_length(F.coalesce("text", F.lit(""))) < 3000)
    got = rows(ppm_scores(docs, F.col("doc_id") % 3 > 0, order=order, common_strings=common))
    assert got.keys() == want.keys()
    for i, bits in want.items():
        assert got[i].score == pytest.approx(-bits * np.log10(2), rel=1e-9)


def test_contexts_beat_words_where_words_follow_from_each_other(spark):
    """Held-out text with spelling and word order of its own: the baseline sees words only."""
    from pyspark.sql import functions as F

    from tradelens.llm.ppm import ppm_scores

    rng = random.Random(4)
    stems, endings = ["walk", "talk", "jump", "play", "look", "turn", "call", "open"], ["s", "ed", "ing", "er", "able", "less"]
    made = [(i, " ".join(f"{rng.choice(stems)}{rng.choice(stems)}{e} {e}ly" for e in rng.choices(endings, k=60))) for i in range(120)]
    out = ppm_scores(spark.createDataFrame(made, "doc_id long, text string"), F.col("doc_id") < 80).where("doc_id >= 80").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > 0.9 * out[1]


def test_longer_contexts_predict_unseen_text_better(spark, medium):
    from pyspark.sql import functions as F

    from tradelens.llm.ppm import ppm_scores
    from tradelens.llm.textcols import crc_remainder

    docs = spark.read.parquet(f"{medium}/documents.parquet")
    held_out = crc_remainder("doc_id", 7) == 2
    total = [ppm_scores(docs, ~held_out, order=k).join(docs.where(held_out).select("doc_id"), "doc_id").agg(F.sum("score")).first()[0] for k in (1, 4)]
    assert total[1] > 0.9 * total[0]


@pytest.mark.parametrize("most", [5, 64, 1 << 20])
def test_components_of_random_graphs(spark, most):
    from tradelens.llm.graph import connected

    rng = random.Random(most)
    edges = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(50)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)] + [(7, 7)]
    rng.shuffle(edges)
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r.node: r.component for r in connected(spark.createDataFrame(edges, "a long, b long").repartition(6), most=most).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_join_of_a_hot_key_keeps_all_rows(spark):
    from tradelens.llm.graph import hot_keys, salted, spread_join

    rows = spark.range(3000).selectExpr("id as node", "if(id % 3 = 0, 5, id % 700) as k")
    table = spark.range(650).selectExpr("id as k", "id * 2 as v")
    want = rows.join(table, "k", "left").select("node", "k", "v")
    hot = hot_keys(rows, "k", least=10)
    assert [r.k for r in hot.collect()] == [5] and hot_keys(rows, "k", least=5000) is None
    assert sorted(map(repr, spread_join(salted(rows, "k", "node", hot), table, "k", hot, "left").select("node", "k", "v").collect())) == sorted(map(repr, want.collect()))


@pytest.mark.parametrize("text", ["<|endoftext|>", "a<|endoftext|>b  <|endoftext|><|endoftext|> c", "<|endoftext|", "it's <|endoftext|>'s   <|endoftext|>\n\n x", "é<|endoftext|>漢"])
def test_ids_with_added_tokens(text):
    from tokenizers import Tokenizer

    from tradelens.llm.pretokens import tokens

    coder = Tokenizer.from_file(q.tokenizer_path())
    texts = [text, "text|> more", text + text, "", "<|endof", "text|>"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.append(0, np.cumsum([len(t.encode()) for t in texts]))
    ids, at = tokens(q.tokenizer_path()).encode(data, offsets)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == coder.encode(t, add_special_tokens=False).ids


def packed_by_sequence(spark, made, **options):
    from tradelens.llm.packing import pack

    docs = spark.createDataFrame(made, "doc_id long, text string, source string").repartition(4)
    out = defaultdict(list)
    for p in sorted(pack(docs, q.tokenizer_path(), **options).collect(), key=lambda r: (r.sequence_id, r.offset)):
        out[p.sequence_id].append((p.source, p.length))
    return out


def test_windows_keep_their_target_proportions(spark):
    rng = random.Random(1)
    made = [(i, " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=rng.randrange(50, 900))), "abc"[i % 10 // 4]) for i in range(300)]
    targets, piece = {"a": 0.2, "b": 0.3, "c": 0.5}, 128
    windows = packed_by_sequence(spark, made, targets=targets, least_piece=piece)
    left = Counter()
    for parts in windows.values():
        for s, n in parts:
            left[s] += n
    done, total = Counter(), 0
    for _, parts in sorted(windows.items()):
        for s, n in parts:
            done[s] += n
            total += n
        if any(left[s] - done[s] < 1024 for s in targets):  # from here on a source has run dry
            break
        for s, share in targets.items():
            assert abs(done[s] - share * total) <= 2 * piece, s
    assert total > 20_000


def test_shards_keep_their_target_proportions_while_sources_last(spark):
    from tradelens.llm.packing import pack

    rng = random.Random(8)
    names = ["a"] * 50 + ["b"] * 28 + ["c"] * 20 + ["d"] + [None]
    made = [(i, " ".join(rng.choices(["alpha", "beta", "gamma"], k=rng.randrange(20, 200))), rng.choice(names)) for i in range(3000)]
    docs = spark.createDataFrame(made, "doc_id long, text string, source string").repartition(4)
    targets = {"a": 0.4, "b": 0.3, "c": 0.25, None: 0.05, "nowhere": 0.5}
    targets.pop("nowhere")
    rows = pack(docs, q.tokenizer_path(), targets=targets, shard_tokens=10_000).collect()
    pieces = defaultdict(int)
    for r in rows:
        pieces[r.doc_id] += r.length
    assert len(pieces) == len(made) and all(pieces[r.doc_id] == r.doc_tokens for r in rows)
    shards = sorted({r.sequence_id >> 32 for r in rows})
    assert len(shards) > 20
    first = [r for r in rows if r.sequence_id >> 32 < len(shards) * 0.18]  # the source without a name lasts for about a fifth
    total, by = sum(r.length for r in first), Counter()
    for r in first:
        by[r.source] += r.length
    for name, share in targets.items():
        assert abs(by[name] / total - share) < 0.05, (name, by, total)
    assert by["d"] == 0 and {r.source for r in rows if r.sequence_id >> 32 == shards[-1]} >= {"d"}
    half = [r for r in rows if r.sequence_id >> 32 < len(shards) // 2]
    total, part = sum(r.length for r in half), sum(r.length for r in half if r.source == "c")
    assert abs(part / total - 0.26) < 0.04  # 0.25 of what the lasting sources share


def test_deficits_carry_from_shard_to_shard(spark):
    from tradelens.llm.packing import carried

    rng = random.Random(2)
    counts = [(shard, s, rng.randrange(1, 5000)) for shard in range(40) for s in ("a", "b", None, *(f"rare{k}" for k in range(80))) if s in ("a", None) or rng.random() < 0.3]
    got = {(r.shard, r.source): r for r in carried(spark.createDataFrame(counts, "shard long, source string, tokens long"), block=7).collect()}
    assert len(got) == len(counts)
    total, own = sum(n for *_, n in counts), Counter()
    for _, s, n in counts:
        own[s] += n
    for shard, s, n in counts:
        before = sum(m for k, _, m in counts if k < shard)
        had = sum(m for k, x, m in counts if k < shard and x == s)
        r = got[shard, s]
        assert (r.tokens, r.share) == (n, pytest.approx(own[s] / total))
        assert r.deficit == pytest.approx(own[s] / total * before - had, abs=1e-6)


def test_every_source_has_its_name_and_all_tokens_over_many_shards(spark):
    rng = random.Random(3)
    made = [(i % 50 if i % 3 else None, " ".join(rng.choices(["one", "two", "three"], k=rng.randrange(0, 400))), f"s{i % 90}" if i % 90 else None) for i in range(700)]
    made += [(5, "same text " * 40, "s1")] * 60
    want = Counter()
    windows = packed_by_sequence(spark, made, shard_tokens=9_000)
    for parts in windows.values():
        size = sum(n for _, n in parts)
        assert size == 1024 or size & (size - 1) == 0
        for s, n in parts:
            want[s] += n
    assert len({k >> 32 for k in windows}) > 5
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(q.tokenizer_path())
    have = Counter()
    for _, t, s in made:
        have[s] += len(coder.encode(t, add_special_tokens=False).ids) + 1
    assert want == have


def thue_morse(n):
    """Two different words of 2**n letters whose polynomial hashes modulo 2**64 are equal for every odd base (n of 10 or more)."""
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_prefix_hashes_are_products_modulo_the_prime():
    import numpy as np

    from tradelens.llm.textcols import Prefix, multiplied

    p = (1 << 61) - 1
    rng = random.Random(2)
    a, b = ([rng.choice([0, 1, p - 1, rng.randrange(p)]) for _ in range(70_000)] for _ in range(2))
    assert multiplied(np.array(a, np.uint64), np.array(b, np.uint64)).tolist() == [x * y % p for x, y in zip(a, b, strict=True)]
    text = np.frombuffer(bytes(rng.choices(range(3), k=3000)), np.uint8)
    hashes = Prefix(text)
    spans = [(i, i + w) for i in range(0, 2900, 7) for w in (1, 4, 60)]
    start, stop = (np.array(x) for x in zip(*spans, strict=True))
    by = defaultdict(set)
    for (i, j), h in zip(spans, hashes.of(start, stop).tolist(), strict=True):
        by[text[i:j].tobytes()].add(h)
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)
    assert hashes.every(60)[start[2::3]].tolist() == hashes.of(start[2::3], stop[2::3]).tolist()


def test_words_that_no_base_tells_apart_modulo_2_64(spark):
    from tradelens.llm.line_rules import line_rules
    from tradelens.llm.lsh_forest import lsh_forest
    from tradelens.llm.ppm import ppm_scores
    from pyspark.sql import functions as F

    one, other = thue_morse(10)
    docs = spark.createDataFrame([(1, f"{one}\n{other}")], "doc_id long, text string")
    assert line_rules(docs).first().n_dup_lines == 0
    pair = spark.createDataFrame([(1, " ".join([one] * 9)), (2, " ".join([other] * 9))], "doc_id long, text string")
    assert [r.kept for r in lsh_forest(pair, percent=85).collect()] == [True, True]
    scored = ppm_scores(pair, F.col("doc_id") == 1).collect()
    assert {r.doc_id: r.n_known for r in scored} == {1: 10, 2: 1}
    from tokenizers import Tokenizer

    from tradelens.llm.pretokens import Tokens

    ids, at = Tokens(q.tokenizer_path()).encode(np.frombuffer((one + other).encode(), np.uint8), np.array([0, 1024, 2048]))
    assert ids[at[1] :].tolist() == Tokenizer.from_file(q.tokenizer_path()).encode(other, add_special_tokens=False).ids


def test_suffix_dedup_of_texts_under_one_id_and_of_ids_at_the_ends(spark):
    from tradelens.llm.suffix_dedup import suffix_dedup

    rng = random.Random(21)
    passage = "".join(rng.choices("abcdefghij ", k=300))
    docs = spark.createDataFrame([(1, passage + " first"), (5, passage + " second one"), (5, "other")], "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.n_bytes): len(r.kept) for r in suffix_dedup(docs).collect()}
    assert got == {(1, 306): 306, (5, 311): 10, (5, 5): 5} or got == {(1, 306): 306, (5, 311): 11, (5, 5): 5}
    ends = [-(1 << 63), -(1 << 62) - 5, 0, (1 << 63) - 1]
    for more in ([], [(None, "null " + passage)], [(0, "again " + passage)]):
        docs = spark.createDataFrame([(i, f"{i} " + passage) for i in ends] + more, "doc_id long, text string").repartition(3)
        out = suffix_dedup(docs).collect()
        assert sorted((r.doc_id is not None, r.doc_id or 0) for r in out) == sorted((i is not None, i or 0) for i, _ in [(e, "") for e in ends] + more)
        whole = [r.doc_id for r in out if passage.encode() in bytes(r.kept)]
        assert whole == [None if more and more[0][0] is None else ends[0]]
