"""The queries of this subpackage over the tables of a data folder, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cotrain import cotrain
from .crf_langid import language_id
from .filter_audit import filter_audit
from .line_rules import FURNITURE, MENU, line_rules
from .lsh_forest import lsh_forest
from .media import describe_media, store_media
from .mixing import mix_documents
from .packing import pack
from .ppm import ppm_scores
from .simple8b import read_ids, write_ids
from .suffix_dedup import suffix_dedup
from .textcols import checkpoint_folder, crc_remainder, small_batches
from .toxicity import toxicity
from .whitening import by_component, whiten


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated sampling: every document with its weight, probability and whether it is taken."""
    return mix_documents(table(spark, sf_dir, "documents"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a media file, read back."""
    files = describe_media(store_media(table(spark, sf_dir, "documents")), with_payload=True)
    ranges = F.array_join(F.transform("keyframes", lambda k: F.concat_ws("+", k.offset, k.length)), ",")
    feature = F.format_string("codec=%s;size=%dx%d;timescale=%d;duration=%d;samples=%d;keyframes=%s", F.trim("codec"), "width", "height", "timescale", "duration", "n_samples", ranges)
    payload = F.octet_length("payload").cast("long")
    return files.select(
        "doc_id", "n_bytes", payload.alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.expr("substring(payload, -32)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s.length)
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest(table(spark, sf_dir, "documents"), percent=85)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_crf_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_remainder("doc_id", 4) == 2
    out = language_id(table(spark, sf_dir, "documents"), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules(table(spark, sf_dir, "documents")).drop("text")


def op8_cotrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_remainder("doc_id", 7) == 2
    out = ppm_scores(table(spark, sf_dir, "documents"), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_remainder("doc_id", 5) == 0
    out = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted", "n_passages")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in every order, by source."""
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All token ids written to files and read back."""
    path = f"{checkpoint_folder(spark)}/ids-{uuid.uuid4()}"
    write_ids(table(spark, sf_dir, "documents"), tokenizer_path(), path)
    return read_ids(spark, path, with_ids=False)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the eight leading components."""
    return by_component(whiten(table(spark, sf_dir, "embeddings")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_mixing, op2_media, op3_suffix_dedup, op4_lsh_forest, op5_packing, op6_crf_langid, op7_line_rules, op8_cotrain, op9_ppm, op10_toxicity, op11_filter_audit, op12_simple8b, op13_whitening]
    return {f.__name__: f for f in own}


_LOW = "translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _alternatives(phrases: list[str]) -> str:
    return "|".join(phrases).replace("'", "''")


OP7_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^ \t\n\x0b\f\r]+') AS words, string_split(text, chr(10)) AS lines FROM d),
rep AS (
  SELECT doc_id, count(DISTINCT i + o) AS n FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS times
    FROM (SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w))
  ), (VALUES (0), (1), (2)) o(o) WHERE times > 1 GROUP BY doc_id),
l AS (
  SELECT doc_id, n, line, len(regexp_extract_all(line, '[^ \t\n\x0b\f\r]+')) AS nw, regexp_replace(line, '[ \t\n\x0b\f\r]+', '', 'g') AS packed,
    regexp_matches(line, '[.!?…:;。！？][''")\]»”’]*[ \t\r]*$') AS closed
  FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS n FROM w)),
f AS (
  SELECT *, length(packed) AS chars, length(regexp_replace(packed, '[^|>»•·]', '', 'g')) AS marks, length(regexp_replace(packed, '[^#*$%&|<>{{}}=~^_]', '', 'g')) AS symbols FROM l),
j AS (
  SELECT *, nw > 0 AND ((marks >= 3 AND nw <= 4 * marks)
    OR (nw <= 6 AND regexp_matches({_LOW}, '(^|[^a-z])({_alternatives(MENU)})([^a-z]|$)') AND NOT closed)
    OR regexp_matches({_LOW}, '({_alternatives(FURNITURE)})') OR (nw < 8 AND NOT closed) OR symbols > 0.2 * chars) AS fails FROM f),
g AS (
  SELECT doc_id, CAST(sum(CASE WHEN fails THEN 1 ELSE 0 END) AS BIGINT) AS n_lines_removed, CAST(sum(CASE WHEN fails THEN chars ELSE 0 END) AS BIGINT) AS chars_removed,
    CAST(sum(CASE WHEN nw > 0 THEN 1 ELSE 0 END) - count(DISTINCT CASE WHEN nw > 0 THEN line END) AS BIGINT) AS n_dup_lines
  FROM j GROUP BY doc_id),
b AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[ \t\n\x0b\f\r]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    n_lines_removed, chars_removed
  FROM w JOIN g USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_lines_removed, chars_removed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND chars_removed <= 0.3 * word_chars AS kept
FROM b
"""


OP11_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0b\f\r]+') AS words FROM documents),
m AS (
  SELECT doc_id, part,
    CASE WHEN len(words) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask
  FROM w),
y AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN y USING (doc_id) GROUP BY part, mask),
f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN mask & (own | before) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & own <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_line_rules": OP7_SQL, "op11_filter_audit": OP11_SQL}
