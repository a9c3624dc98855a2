"""Mixing sources to target weights by iterative proportional fitting.

Tokens (words) are summed to cells of source, language and topic. Raking scales one factor for
each value of a margin in turn until the weighted tokens of every margin agree with its target
shares; only one table of factors for each margin is kept. A document's sampling probability is
the weight of its cell, scaled so that the largest is 1 (``rate`` None) or so that the expected
tokens are the share ``rate`` of all tokens; weights above 1 are whole extra copies. Whether a
document is taken depends on a hash of its id and the seed alone.

Targets that a margin has no tokens for are left out and the others scaled up. Without targets
a margin flattens: shares are raised to the power ``flatten`` and scaled to 1. Null sources,
languages and texts (topic of an empty text) are values of their own. Rows with equal id are
taken together or not at all. Long texts are counted whole; a text that fits several topics has
the first of them. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textcols import id_or_least, narrow, null_if_least, settle

#: Topics are found by the first rule that fits; texts that fit none are "prose".
TOPICS = {
    "empty": r"\A[ \t-\r]*\z",
    "licence": r"(?i)licen[sc]e|copyright|all rights reserved",
    "contact": r"[\w.+-]+@[\w-]+\.[a-z]{2,}|\+?\d[\d .()-]{8,}\d",
    "table": r"(\|[^|\n]*){3,}",
    "code": r"[{};=]\s*\n|</?[a-z]+[^>\n]*>",
}


def topic_of(text: Column) -> Column:
    rule = F.lit("prose")
    for name, pattern in reversed(TOPICS.items()):
        rule = F.when(F.coalesce(text, F.lit("")).rlike(pattern), name).otherwise(rule)
    return rule


def token_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; 0 for a null text."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^ \t-\r]+", "w")
    return (F.length(marks) - F.length(F.translate(marks, "w", ""))).cast("long")


def _targets(cells: DataFrame, margin: str, targets: dict | None, flatten: float) -> DataFrame:
    """(value, target): shares of tokens by value of one margin, sum 1 over values with tokens."""
    have = cells.groupBy(F.col(margin).alias("value")).agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    if targets is None:
        have = have.withColumn("want", F.pow(F.col("tokens").cast("double"), F.lit(flatten)))
    else:
        given = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in targets.items()], "given string, want double")
        have = have.join(F.broadcast(given), F.col("value").eqNullSafe(F.col("given"))).drop("given")
    total = have.agg(F.sum("want").alias("total"))
    return have.crossJoin(F.broadcast(total)).select("value", (F.col("want") / F.col("total")).alias("target"))  # one row of totals


def rake(cells: DataFrame, margins: list[str], targets: dict[str, dict | None], flatten: float = 0.7, tolerance: float = 1e-5, most_rounds: int = 60, steps: int = 4) -> DataFrame:
    """The cells (margins..., tokens) with a ``weight`` under which every margin has its target shares.

    Each round scales all margins once; ``steps`` rounds make one job. Ends when no margin is off by more than ``tolerance`` of
    all tokens; stops with a warning after ``most_rounds`` for targets that no weights can meet together.
    """
    n = cells.count()
    # few cells are one partition, and Spark knows it: no sum over a margin moves them
    cells = narrow(cells, n)
    state = cells.where("tokens > 0").withColumn("weight", F.lit(1.0))
    for m in margins:  # values without a target weigh nothing
        wanted = _targets(cells, m, targets.get(m), flatten).select(F.col("value").alias(m + "_value"), F.col("target").alias(m + "_target"))
        state = state.join(wanted, F.col(m).eqNullSafe(F.col(m + "_value"))).drop(m + "_value")
    state = narrow(settle(narrow(state, n)), n)
    total = state.agg(F.sum("tokens")).first()[0] or 0
    for done in range(0, most_rounds, steps):
        for _ in range(steps):
            gap = F.lit(0.0)
            for m in margins:
                now = F.sum(F.col("tokens") * F.col("weight")).over(Window.partitionBy(m))
                state = state.withColumn("now", now)
                gap = F.greatest(gap, F.abs(F.col("now") / total - F.col(m + "_target")))
                state = state.withColumn("gap", gap).withColumn("weight", F.col("weight") * F.col(m + "_target") * total / F.col("now"))
                gap = F.col("gap")
        state = narrow(settle(narrow(state, n)), n)
        gap = state.agg(F.max("gap")).first()[0] or 0.0
        if gap <= tolerance:
            break
    else:
        warnings.warn(f"margins are off by up to {gap:.2g} of all tokens: no weights meet all targets", stacklevel=2)
    return state.select(*margins, "tokens", "weight")


def heaviest(weights: DataFrame, spare: float) -> float:
    """The weight that no cells exceed but those that hold together at most the share ``spare`` of all tokens (0 without cells).

    Tokens are added up by eighths of a power of two, so the driver gets as many sums as a double has such steps at most.
    """
    top, total = weights.agg(F.max("weight"), F.sum("tokens")).first()
    if not top or not spare:
        return top or 0.0
    steps = weights.groupBy(F.floor(F.log2("weight") * 8).alias("step")).agg(F.sum("tokens").alias("tokens")).collect()
    above = 0
    for r in sorted(steps, key=lambda r: -r.step):
        above += r.tokens
        if above > spare * total:
            return min(top, 2.0 ** ((r.step + 1) / 8))
    return top


def mix_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None,
    targets: dict[str, dict | None] | None = None, flatten: float = 0.7, rate: float | None = None, spare: float = 0.0, seed: int = 17, tolerance: float = 1e-5,
) -> DataFrame:
    """Per row: id, source, lang, topic, n_tokens, weight, probability, copies, selected.

    With ``spare``, cells that hold at most that share of all tokens may weigh more than the one
    that is kept whole; they are kept whole too, and all others need not be sampled down to them.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(id_or_least(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"), (topic_of(text) if topic is None else topic).alias("topic"), token_count(text).alias("n_tokens"))
    rows = settle(rows)
    margins = ["source", "lang", "topic"]
    cells = settle(narrow(rows.groupBy(*margins).agg(F.sum("n_tokens").alias("tokens")), docs.count()))
    weights = rake(cells, margins, targets or {}, flatten, tolerance)
    top, mass = heaviest(weights, spare), weights.agg(F.sum(F.col("tokens") * F.col("weight"))).first()[0]
    all_tokens = cells.agg(F.sum("tokens")).first()[0] or 0
    factor = (1.0 / top if top else 0.0) if rate is None else (rate * all_tokens / mass if mass else 0.0)
    w = weights.select(*(F.col(m).alias("w_" + m) for m in margins), "weight")
    joined = rows.join(w, F.col("source").eqNullSafe(F.col("w_source")) & F.col("lang").eqNullSafe(F.col("w_lang")) & F.col("topic").eqNullSafe(F.col("w_topic")), "left")
    expected = F.coalesce("weight", F.lit(0.0)) * F.lit(float(factor))
    if rate is None:
        expected = F.least(F.lit(1.0), expected)
    # documents without tokens change no margin: they stay
    expected = F.when(F.col("n_tokens") == 0, 1.0).otherwise(expected)
    draw = F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))
    out = joined.withColumn("expected", expected).withColumn("copies", (F.floor("expected") + (draw < F.col("expected") - F.floor("expected")).cast("long")).cast("long"))
    return out.select(null_if_least("id").alias(id_col), "source", "lang", "topic", "n_tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.col("expected").alias("probability"), "copies", (F.col("copies") > 0).alias("selected"))
