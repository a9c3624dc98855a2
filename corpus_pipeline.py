"""A training-data pipeline over ``documents``: quality, near-duplicates, repeated passages, mixture, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but
the last return the columns of ``documents``. A document is an id with a text: several texts under
one id or under none are documents of their own, rows with equal id and text are one. Null texts
and metadata have the meaning that each operator's docstring gives them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradelens.llm.cotrain import cotrain
from tradelens.llm.lsh_forest import lsh_forest
from tradelens.llm.mixing import mix_documents
from tradelens.llm.packing import pack
from tradelens.llm.queries import tokenizer_path
from tradelens.llm.suffix_dedup import suffix_dedup
from tradelens.llm.textcols import checkpoint_folder, document_ids, narrow, row_key, small_batches

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS, row_key("doc_id", "text").alias("row_key"))


def _only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of keyed ``docs`` whose key is among ``kept``."""
    return docs.join(kept.select("row_key").distinct(), "row_key", "left_semi").select(*COLUMNS, "row_key")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    A null text is judged as an empty one, a null source or language as a value of its own. A text
    of any length is read whole. A score that equals the threshold stays. Rows with equal id and
    text share a verdict; no documents give none.
    """
    small_batches(spark)
    verdict = cotrain(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), with_key=True)
    return narrow(_only(_keyed(docs), verdict.where("kept")).select(*COLUMNS), docs.count(), of=docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest id (no id is the least).

    Of texts under the same smallest id, the one with the least hash of id and text stays. Null,
    empty and blank texts are like nothing and all stay; rows with equal id and text are one.
    """
    small_batches(spark)
    groups = lsh_forest(docs, with_key=True)
    # rows with equal id and text are one document
    return narrow(_only(_keyed(docs), groups.where("kept")).dropDuplicates(["row_key"]).select(*COLUMNS), docs.count(), of=docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes or more that stand earlier are cut out; documents that were nothing else go.

    Over 50 words with a blank between them are at least 101 bytes, however short the words.
    A cut inside a character also drops the rest of that character.
    """
    small_batches(spark)
    rows = document_ids(docs, "doc_id", "text", "doc_id", "lang", "source", "n_chars", F.col("text").isNull().alias("none"))
    cut = suffix_dedup(docs, length=100, k=32, documents=rows).select("document", "spans", "kept").dropDuplicates(["document"])
    joined = rows.drop("text").dropDuplicates(["document"]).join(cut, "document")
    whole = F.size("spans") == 0
    # bytes that do not form a character become U+FFFD, which no valid text part needs to keep
    text = F.when(~F.col("none"), F.when(whole, F.col("kept").cast("string")).otherwise(F.replace(F.make_valid_utf8(F.col("kept").cast("string")), F.lit("\ufffd"), F.lit(""))))
    out = joined.withColumn("text", text).where(whole | (F.length(F.trim("text")) > 0))
    out = out.select("doc_id", "text", "lang", "source", F.when(whole, F.col("n_chars")).otherwise(F.length("text")).cast("long").alias("n_chars"))
    return narrow(out, docs.count(), of=docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled so that sources, languages and topics have their target shares of the tokens.

    The heaviest cells are kept whole and all others are sampled down to them: no weight asks for
    copies, which would be lost here, but those of cells that hold at most 1 % of all tokens.
    A null source or language is a value of its own. Documents without tokens, null texts among
    them, change no share and stay. A document is drawn by a hash of its id and text, so equal rows
    share their fate. Texts of any length count with all their tokens.
    """
    small_batches(spark)
    keyed = _keyed(docs)
    taken = mix_documents(keyed, id_col="row_key", flatten=0.9, rate=None, spare=0.01)
    return narrow(_only(keyed, taken.where("selected")).select(*COLUMNS), docs.count(), of=docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens.

    A null text is one end token, a null source a source of its own; a text of any length is cut
    where sequences end; repeated rows are packed as often as they come. No documents, no pieces.
    """
    small_batches(spark)
    out = pack(docs, tokenizer_path())
    return out.select("doc_id", "source", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mixture", mixture), ("packed", packed)]

#: The classifier, MinHash and sampling stages cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet to the shared checkpoint folder and read again."""
    import uuid

    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
