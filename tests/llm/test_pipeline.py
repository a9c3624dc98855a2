"""Each stage of the pipeline keeps what it should, and the whole agrees with its parts."""

import random

import corpus_pipeline as p
import pytest
from pyspark.sql import functions as F

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def _words(rng, n, least=4, most=9):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(least, most))) for _ in range(n))


def _rows(made):
    return [(i, t, "en", "a", len(t)) for i, t in made]


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    before = docs.count()
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, small).cache()
        assert docs.columns == p.COLUMNS, name
        n = docs.count()
        assert 0 < n <= before and docs.select("doc_id").distinct().count() == n
        before = n
    out = p.STAGES[-1][1](spark, docs, small).toPandas()
    assert set(out.doc_id) == {r.doc_id for r in docs.select("doc_id").collect()}
    assert (out.groupby("sequence_id")["length"].sum() <= 1024).all()
    assert out.groupby("doc_id")["length"].sum().eq(out.groupby("doc_id").doc_tokens.first()).all()


def test_run_equals_its_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for name, stage in p.STAGES:
        stage(spark, docs, small).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    pieces = lambda d: sorted((r.doc_id, r.source, r.doc_tokens) for r in d.where("start = 0").collect())
    rows = p.run(spark, small)
    assert rows.columns == docs.columns and pieces(rows) == pieces(docs) != []


def edge_rows():
    plain = "The quick brown fox jumps over the lazy dog near the old river bank. " * 6
    rows = [
        (1, plain, "en", "a", len(plain)), (2, plain, "en", "a", len(plain)), (2, plain, "en", "a", len(plain)), (3, None, "en", "a", 0), (4, "", None, None, None),
        (None, plain + "One more ending.", None, None, None), (None, "Another text without an id, and short.", "en", "b", 38), (6, "x", None, "b", -1), (7, " \n\t ", "de", "b", 4),
        (8, "Ünïcödé wörter sind hier 漢字. " * 9, "de", "b", None), (9, "A long line of words that goes on. " * 9000, "en", "c", 1), (-5, "a\x00b", "fr", "c", 3), (1, "Other words under the same id.", "en", "a", 30),
    ]
    return rows


@pytest.mark.parametrize("name,stage", p.STAGES)
def test_stages_on_edges(spark, small, name, stage):
    """Nulls, empty and long texts, repeated rows, shared and missing ids, and columns of other tables: documents come out as they went in, or cut."""
    rows = edge_rows()
    docs = spark.createDataFrame(rows, DDL).repartition(3)
    more = docs.withColumns({c: F.lit("?") for c in ("row_key", "document", "kept", "spans", "shared", "id", "own", "quality", "weight", "shard", "more")})
    shown = [c for c in stage(spark, docs, small).columns if c not in ("sequence_id", "offset")]
    got = sorted(map(repr, stage(spark, docs, small).select(*shown).where("start = 0" if name == "packed" else "true").collect()))
    assert sorted(map(repr, stage(spark, more, small).select(*shown).where("start = 0" if name == "packed" else "true").collect())) == got
    out = stage(spark, docs, small)
    if name == "packed":
        assert out.where("start = 0").count() == len(rows)
        return
    assert out.columns == p.COLUMNS
    kept = [tuple(r) for r in out.collect()]
    whole = {(r[0], r[1]) for r in rows}
    if name == "repeated_passages":
        assert {i for i, *_ in kept} <= {i for i, *_ in rows} and any((i, t) in whole for i, t, *_ in kept)
    else:
        assert {(i, t) for i, t, *_ in kept} <= whole
    if name == "near_duplicates":  # of the four copies of one text the one of least id stays; empty texts are like no other
        ids = [i for i, *_ in kept]
        assert 2 not in ids and {3, 4, 6, 7, 8, 9, -5} <= set(ids) and len(kept) == len({(i, t) for i, t, *_ in kept})


@pytest.mark.parametrize("name,stage", p.STAGES)
def test_stages_of_no_documents(spark, small, name, stage):
    out = stage(spark, spark.createDataFrame([], DDL), small)
    assert out.collect() == [] and (name == "packed" or out.columns == p.COLUMNS)


def test_near_copies_and_passages_go(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    twin = docs.limit(5).selectExpr("doc_id + 1000000 as doc_id", "text || ' ' as text", "lang", "source", "n_chars")
    kept = p.near_duplicates(spark, docs.unionByName(twin), small)
    assert kept.where("doc_id >= 1000000").where("length(trim(text)) > 0").count() == 0


def test_texts_without_an_id_or_under_one_id_are_documents_of_their_own(spark, small):
    rng = random.Random(3)
    texts = [_words(rng, 120) for _ in range(60)]
    ids = [None] * 20 + [7] * 20 + list(range(100, 120))
    passage = _words(rng, 80)
    made = [(i, f"{t} {passage}" if n in (5, 6, 25, 26) else t) for n, (i, t) in enumerate(zip(ids, texts, strict=True))]
    twins = [(None, made[0][1] + " end"), (7, made[21][1] + " end"), made[1], made[22]]
    docs = spark.createDataFrame(_rows(made + twins), DDL).repartition(3)
    got = lambda d: sorted(((r.doc_id, r.text) for r in d.collect()), key=repr)
    # a rejected text goes also where another text under its id, or without one, is kept
    verdict = {(r.doc_id, r.row_key): r.kept for r in p.cotrain(docs, spark.read.parquet(f"{small}/labels.parquet"), with_key=True, threshold=0.5).collect()}
    good = p.quality(spark, docs, small)
    keyed = {(r.doc_id, r.text): r.row_key for r in p._keyed(docs).collect()}
    assert got(good) == sorted([(i, t) for i, t in made + twins if verdict[i, keyed[i, t]]], key=repr)
    first = p.near_duplicates(spark, docs, small).cache()
    left = got(first)
    assert len(left) == len(set(left)) == 60
    assert {t for _, t in left} >= {t for n, (_, t) in enumerate(made) if n not in (0, 21)}
    second = p.repeated_passages(spark, first, small).cache()
    cut = got(second)
    assert len(cut) == 60 and sum(passage in t for _, t in cut) == 1
    whole = {x for x in left if passage not in x[1]}
    assert whole <= set(cut) and sum(len(t) for _, t in cut) <= sum(len(t) for _, t in left) - 3 * len(passage)
    taken = got(p.mixture(spark, second, small))
    assert len(taken) == len(set(taken)) and set(taken) <= set(cut)
    pieces = p.packed(spark, second, small).collect()
    assert sum(r.start == 0 for r in pieces) == 60


def test_rejected_texts_do_not_stay_for_another_row_of_their_id(spark):
    docs = p._keyed(spark.createDataFrame(_rows([(None, "good"), (None, "bad"), (1, "good"), (1, "bad")]), DDL))
    kept = p._only(docs, docs.where("text = 'good'"))
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "good"), (1, "good")]


def test_passages_of_51_short_words_are_cut_and_clean_documents_stay(spark, small):
    rng = random.Random(4)
    passages = [_words(rng, 51, 1, 2), _words(rng, 51, 2, 5)]
    made = [(i, _words(rng, 60) + (f" {passages[i % 2]}" if i < 40 else "")) for i in range(80)]
    docs = spark.createDataFrame(_rows(made), DDL).repartition(3)
    out = {r.doc_id: r.text for r in p.repeated_passages(spark, docs, small).collect()}
    for passage in passages:
        assert 100 < len(passage) < 300 and sum(passage in t for t in out.values()) == 1
    assert all(out[i] == t for i, t in made if i >= 40)


def test_kept_tokens_meet_the_target_shares(spark, small):
    rng = random.Random(6)
    sizes = {"a": 2400, "b": 500, "c": 100}
    made = [(s, _words(rng, 20)) for s, n in sizes.items() for _ in range(n)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, (s, t) in enumerate(made)], DDL).repartition(3)
    tokens = {r.source: 20 * r["count"] for r in p.mixture(spark, docs, small).groupBy("source").count().collect()}
    want = {s: n**0.9 / sum(m**0.9 for m in sizes.values()) for s, n in sizes.items()}
    for s in sizes:
        assert abs(tokens[s] / sum(tokens.values()) - want[s]) < 0.05 * want[s], s


def test_raking_few_cells_shuffles_nothing(spark, monkeypatch):
    """Every shuffle of a step is a stage that the driver plans anew."""
    from tradelens.llm import mixing

    plans, settle = [], mixing.settle

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return settle(df)

    monkeypatch.setattr(mixing, "settle", noted)
    cells = spark.createDataFrame([(a, b, 10 + 7 * i + 3 * j * j) for i, a in enumerate("pqrs") for j, b in enumerate(["x", "y", None])], "source string, lang string, tokens long").repartition(4)
    weights = mixing.rake(cells, ["source", "lang"], {}).collect()
    steps = [x for x in plans if "Window" in x]
    assert steps and not any("Exchange hashpartitioning" in x for x in steps)
    for k, names in (("source", "pqrs"), ("lang", ["x", "y", None])):
        sums = [sum(r.tokens for r in weights if r[k] == name) ** 0.7 for name in names]
        total = sum(r.tokens * r.weight for r in weights)
        for name, want in zip(names, sums, strict=True):
            assert abs(sum(r.tokens * r.weight for r in weights if r[k] == name) / total - want / sum(sums)) < 1e-4
