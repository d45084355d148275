"""Decisions level by level: chunks make sections, sections texts, texts groups, groups larger groups.

Texts of any length get an answer: one over the size gate is first cut into sections that pass it, by the same
planner as chunks, so that text which sections share counts once. Each level's answer is the combination of
the answers below it, weighted by their bytes of text, and says how far they agree. With "average" a level's
answer is the average over all text below it, whatever the levels between; with "max" it is the strongest's.

The answers of sections and of every level are written once, to the shared folder: no level asks or adds up again.
Levels above are sums that combine before the shuffle; no group's rows are gathered.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import invalid
from ..functions.text import nonblank
from ..plans.chunks import chunk_text, plan_chunks
from ..shared import fresh_folder
from ..shipping import ship
from .combine import combine_rows
from .decide import MAX_INPUT_TOKENS, decide

_ANSWER = ("value", "label", "probs", "confidence")


def _level(rows: DataFrame, question, how: str, key: Column, kept: dict[str, Column]) -> DataFrame:
    """Rows (at, bytes, answer, kept) of the groups of rows (at, bytes, answer) by ``key``."""
    rows = rows.withColumn("id", key)
    sums = rows.groupBy("id").agg(F.min("at").alias("at"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("parts"))
    whole = sums.select(F.col("id").alias("_of"), F.col("bytes").alias("_all"))
    shares = rows.join(whole, F.col("id").eqNullSafe(F.col("_of"))).select("id", F.col("at").alias("idx"), (F.col("bytes") / F.col("_all")).alias("weight"), *_ANSWER)
    answers = combine_rows(shares, question, how)
    out = answers.join(sums.select(F.col("id").alias("_of"), "at", "bytes", "parts"), F.col("id").eqNullSafe(F.col("_of")))
    return out.select("at", "bytes", "parts", *_ANSWER, "agreement", *[c.alias(n) for n, c in kept.items()])


def decide_levels(df: DataFrame, question, groups: Sequence[Sequence[str]], order_col: str, input_col: str = "text", combine_how: str = "average", section_tokens: int = MAX_INPUT_TOKENS, **options) -> DataFrame:
    """(level, group columns, value, label, probs, confidence, agreement, parts, bytes) of every text and group.

    ``groups``: columns of each level, from the finest; each level's are among the one's below, and none means all
    texts. Level 0 is the texts, with ``order_col``; a level's row has null in the group columns that it doesn't know.
    ``order_col``: whole numbers, different for every row; the smallest comes first where the strongest tie. ``parts``:
    sections of a text, or rows of the level below. ``options``: of ``decide``. Any failure fails the job; blank texts fail too,
    unless ``ask_blank`` is among the options. A blank section of a text with something in it is asked about like others.
    """
    for fine, coarse in zip(groups, groups[1:], strict=False):
        if set(coarse) - set(fine):
            raise invalid("The columns of a level have to be among those of the level below.")
    spark, columns = df.sparkSession, list(dict.fromkeys(c for level in groups for c in level))
    if order_col in columns or set(columns) & {"level", *_ANSWER, "agreement", "parts", "bytes", "at"}:
        raise invalid("A group column has the name of a column of the result.")
    ship(spark)
    text = F.col(input_col)
    if not options.pop("ask_blank", False):
        text = F.when(nonblank(text), text)
    rows = df.select(F.col(order_col).cast("long").alias("at"), F.struct(*[F.col(c).alias(c) for c in columns]).alias("g") if columns else F.struct(F.lit(0).alias("_all")).alias("g"), text.alias("text"))
    cut = rows.withColumn("s", plan_chunks(F.col("text"), section_tokens))
    section = F.transform("s", lambda s: F.struct(s["weight"].alias("weight"), chunk_text(F.col("text"), s).alias("part")))
    # Null texts, and blank ones, have no sections; as inputs they fail.
    sections = cut.select("at", "g", F.octet_length("text").cast("long").alias("size"), F.posexplode_outer(section).alias("idx", "s")).select("at", "g", "size", "idx", "s.weight", "s.part")
    asked = decide(sections, question, input_col="part", combine_how=combine_how, max_input_tokens=max(section_tokens, options.pop("max_input_tokens", MAX_INPUT_TOKENS)), ask_blank=True, **options)
    folder = fresh_folder(spark, "levels")

    def kept(rows: DataFrame, name) -> DataFrame:
        rows.write.parquet(f"{folder}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

    leaves = kept(asked.select("at", "g", "size", "idx", "weight", *[f"result.{c}" for c in _ANSWER]), "sections")
    texts = combine_rows(leaves.withColumn("id", F.col("at")), question, combine_how)
    facts = leaves.groupBy("at").agg(F.first("g").alias("g"), F.first("size").alias("bytes"), F.count(F.lit(1)).alias("parts"))
    level = kept(facts.join(texts, F.col("at") == F.col("id")).select("at", "bytes", "parts", *_ANSWER, "agreement", "g"), 0)
    shown = lambda rows, n, known: rows.select(F.lit(n).alias("level"), F.col("at").alias(order_col) if n == 0 else F.lit(None).cast("long").alias(order_col), *[(F.col("g")[c] if c in known else F.lit(None).cast(df.schema[c].dataType)).alias(c) for c in columns], *_ANSWER, "agreement", "parts", "bytes")
    out = [shown(level, 0, columns)]
    for n, known in enumerate(groups, 1):
        key = F.struct(*[F.col("g")[c].alias(c) for c in known]) if known else F.struct(F.lit(0).alias("_all"))
        level = kept(_level(level, question, combine_how, key, {"g": F.col("id")}), n)
        out.append(shown(level, n, known))
    return reduce(DataFrame.union, out)
