"""Quality rules: fixed base rules plus adaptive thresholds from mergeable quantile sketches.

DataFrame functions only. Measures are computed inside the row and written without the texts; from
them ``percentile_approx`` (a mergeable quantile summary, combined map-side, so a hot source moves one
summary per task) gives quartiles per (lang, source), per lang and over all; the thresholds they set
are joined back to decide. Texts are never shuffled.

Defined results: null text counts as empty; null lang or source form groups of their own (null-safe
joins); repeated rows are judged row by row; an empty table gives an empty result; a group with fewer
than ``min_group`` rows uses its language's thresholds, and a small language those of all rows.
Extra columns pass through unless their names are those of the measures, which replace them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, let, without_chars, words, written

WINDOW = 8
#: measure -> (least spread taken for a group, both sides). A bound lies SPREADS spreads outside the
#: middle half of the group, so a group whose values are all alike still tolerates SPREADS * least.
MEASURES = {
    "symbols_per_word": (0.05, False),
    "chars_per_word": (0.75, True),
    "dup_line_share": (0.15, False),
}
SPREADS = 4.0
MIN_GROUP = 50
#: Thresholds tables up to this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_GROUPS = 20_000
ADDED = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *MEASURES)


def _covered(positions: Column) -> Column:
    """Words covered by windows that start at these ascending positions."""
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"))
    return F.aggregate(positions, start, step, lambda a: a["n"])


def _repeated(hashes: Column) -> Column:
    """Words inside windows that occur twice or more; hashes: one for each window, by position."""
    tagged = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    positions = let(
        tagged,
        lambda s: F.filter(
            F.transform(
                s,
                lambda x, k: F.when(
                    (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"]
                ),
            ),
            lambda p: p.isNotNull(),
        ),
    )
    return _covered(F.sort_array(positions))


def repeat_words(w: Column) -> Column:
    """Number of words in WINDOW-word windows found twice or more among the words ``w``."""

    def windows(h: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(h) - WINDOW),
            lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]),
        )

    counted = let(
        let(F.transform(w, lambda x: F.xxhash64(x)), windows),
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_repeated(h)),
    )
    return F.when(F.size(w) > WINDOW, counted).otherwise(F.lit(0)).cast("long")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the base measures; a column is computed only if something reads it."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(NOT_SPACE))
    docs = docs.drop(*ADDED).withColumns({"_w": words(F.col(text)), "_lines": lines})
    docs = docs.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(without_chars(body, " \t\n\x0b\x0c\r")).cast("long"),
            "n_symbols": (F.length(body) - F.length(without_chars(body, "#*$%&|<>"))).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": repeat_words(F.col("_w")),
        }
    ).drop("_w", "_lines")
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return docs.withColumns(
        {
            "symbols_per_word": share("n_symbols", "n_words"),
            "chars_per_word": share("word_chars", "n_words"),
            "dup_line_share": share("n_dup_lines", "n_lines"),
            "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
        }
    )


def thresholds(measures: DataFrame, min_group: int = MIN_GROUP, spreads: float = SPREADS) -> DataFrame:
    """One row for each (lang, source): low and high bound of each measure, from the smallest level with enough rows."""
    sketch = [F.count(F.lit(1)).alias("n")] + [
        F.percentile_approx(m, F.array(F.lit(0.25), F.lit(0.75)), F.lit(1000)).alias(m) for m in MEASURES
    ]
    by_group = measures.where("n_words > 0").groupBy("lang", "source").agg(*sketch)
    by_lang = measures.where("n_words > 0").groupBy("lang").agg(*sketch)
    over_all = measures.where("n_words > 0").agg(*sketch)

    def bounds(df: DataFrame, tag: str) -> DataFrame:
        out = []
        for m, (least, both) in MEASURES.items():
            low, high = F.get(F.col(m), F.lit(0)), F.get(F.col(m), F.lit(1))
            reach = F.greatest(high - low, F.lit(least)) * spreads
            out += [(low - reach if both else F.lit(float("-inf"))).alias(f"{m}_low_{tag}"), (high + reach).alias(f"{m}_high_{tag}")]
        return df.select(*[c for c in ("lang", "source") if c in df.columns], F.col("n").alias(f"n_{tag}"), *out)

    g, l, a = bounds(by_group, "g"), bounds(by_lang, "l").withColumnRenamed("lang", "_lang"), bounds(over_all, "a")
    wide = g.join(l, g["lang"].eqNullSafe(l["_lang"]), "left").drop("_lang").withColumn("_k", F.lit(1))
    wide = wide.join(a.withColumn("_one", F.lit(1)), F.col("_k") == F.col("_one"), "left")
    pick = lambda c: F.when(F.col("n_g") >= min_group, F.col(f"{c}_g")).when(F.col("n_l") >= min_group, F.col(f"{c}_l")).otherwise(F.col(f"{c}_a")).alias(c)
    return wide.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *[pick(f"{m}_{side}") for m in MEASURES for side in ("low", "high")])


def decide(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """Measured rows with ``kept``: the base rules hold and every measure lies within its group's bounds."""
    if bounds.count() <= BROADCAST_GROUPS:
        bounds = F.broadcast(bounds)
    rows = rows.join(bounds, rows["lang"].eqNullSafe(bounds["_lang"]) & rows["source"].eqNullSafe(bounds["_source"]), "left")
    inside = F.lit(True)
    for m in MEASURES:
        inside = inside & F.coalesce(F.col(m).between(F.col(f"{m}_low"), F.col(f"{m}_high")), F.lit(True))
    return rows.withColumn("kept", ~F.col("base_failed") & inside).drop("_lang", "_source", *[f"{m}_{s}" for m in MEASURES for s in ("low", "high")])


def judge(docs: DataFrame, text: str = "text", min_group: int = MIN_GROUP, spreads: float = SPREADS) -> DataFrame:
    """Every row, with its text, its measures, ``base_failed`` and ``kept``. Reads the texts twice and moves none."""
    rows = measured(docs, text)
    cheap = written(rows.select("lang", "source", "n_words", *MEASURES), "quality-measures")
    return decide(rows, written(thresholds(cheap, min_group, spreads), "quality-bounds"))


def keep(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows that stay, all their columns as they were, whatever their names."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    return judge(packed).where("kept").select("_row.*")


def judge_measures(docs: DataFrame, keep: tuple[str, ...], text: str = "text", min_group: int = MIN_GROUP, spreads: float = SPREADS) -> DataFrame:
    """As ``judge``, without the text: columns ``keep`` and the measures. Reads the texts once."""
    rows = written(measured(docs, text).select(*dict.fromkeys((*keep, "lang", "source", *ADDED[:7], *MEASURES))), "quality-measures")
    return decide(rows, written(thresholds(rows, min_group, spreads), "quality-bounds"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge_measures(docs, ("doc_id",)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
