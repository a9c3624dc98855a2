"""Nulls in every column, empty and long texts, repeated rows, empty tables and clashing column names."""

import uuid

import pytest
from pyspark.sql import functions as F

from tradelens.llm.cotrain import cotrain
from tradelens.llm.crf_langid import language_id
from tradelens.llm.filter_audit import masks
from tradelens.llm.line_rules import line_rules
from tradelens.llm.lsh_forest import lsh_forest
from tradelens.llm.media import describe_media, store_media
from tradelens.llm.mixing import mix_documents
from tradelens.llm.packing import pack
from tradelens.llm.ppm import ppm_scores
from tradelens.llm.queries import tokenizer_path
from tradelens.llm.simple8b import read_ids, write_ids
from tradelens.llm.suffix_dedup import suffix_dedup
from tradelens.llm.textcols import checkpoint_folder
from tradelens.llm.toxicity import toxicity


def coded(docs):
    path = f"{checkpoint_folder(docs.sparkSession)}/ids-{uuid.uuid4()}"
    write_ids(docs, tokenizer_path(), path)
    return read_ids(docs.sparkSession, path)


OPS = {
    "mixing": lambda d, y: mix_documents(d),
    "media": lambda d, y: describe_media(store_media(d), with_payload=True),
    "suffix": lambda d, y: suffix_dedup(d),
    "forest": lambda d, y: lsh_forest(d, percent=85),
    "packing": lambda d, y: pack(d, tokenizer_path()).where("start = 0"),
    "crf": lambda d, y: language_id(d, F.lit(True), with_spans=True),
    "lines": lambda d, y: line_rules(d),
    "cotrain": lambda d, y: cotrain(d, y),
    "ppm": lambda d, y: ppm_scores(d, F.lit(True)),
    "audit": lambda d, y: masks(d),
    "simple8b": lambda d, y: coded(d),
    "toxicity": lambda d, y: toxicity(d, y, F.lit(True)),
}
DDL = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["id", "key", "kind", "place", "start", "bytes", "shard", "control", "share", "word", "n", "count", "label", "tree", "weight", "tokens", "node", "component", "part", "quality", "toxic_", "letters", "class", "row", "tie", "mask", "length", "hashes", "first", "rows", "ahead", "before", "doc_ids", "media", "n_words"]


def edge_rows():
    plain = "the quick brown fox jumps over the lazy dog near the old river bank. " * 4
    rows = [
        (1, plain, "en", "a", 10), (2, plain, "en", "a", 10), (2, plain, "en", "a", 10), (3, None, "en", "a", 0), (4, "", "en", None, 0),
        (None, plain + "one more ending", None, None, None), (6, "x", None, "b", -1), (7, " \n\t ", "de", "b", 4), (8, "ünïcödé wörter sind hier 漢字 " * 9, "de", "b", None),
        (9, "long line of words that goes on " * 9000, "en", "c", 1), (10, "damn awful stupid thing " * 5, "en", "c", 5), (-5, "a\x00b", "fr", "c", 3),
    ]
    return rows


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (2, 1, 0), (2, 1, 0), (10, 0, 1), (6, 0, 1), (None, 1, 1), (9, None, None), (99, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def result(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("name", OPS)
def test_every_row_gets_a_result_whatever_other_columns_exist(spark, labels, name):
    rows = edge_rows()
    docs = spark.createDataFrame(rows, DDL).repartition(3)
    out = OPS[name](docs, labels)
    got = result(out)
    assert len(got) == len(rows)
    ids = sorted((r.doc_id is not None, r.doc_id or 0) for r in out.select("doc_id").collect())
    assert ids == sorted((r[0] is not None, r[0] or 0) for r in rows)
    more = docs.withColumns({c: F.lit("?") for c in CLASH})
    assert result(OPS[name](more, labels)) == got


@pytest.mark.parametrize("name", OPS)
def test_empty_tables_give_no_rows(spark, labels, name):
    docs = spark.createDataFrame([], DDL)
    out = OPS[name](docs, labels.where("false"))
    assert out.columns and out.collect() == []


@pytest.mark.parametrize("name", OPS)
def test_rows_of_nulls(spark, labels, name):
    docs = spark.createDataFrame([(None, None, None, None, None)] * 3, DDL)
    assert len(OPS[name](docs, labels.where("false")).collect()) == 3
