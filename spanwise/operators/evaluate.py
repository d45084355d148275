"""How good decisions are against known truth: errors, calibration, and F1 by label and by threshold.

All of it is sums that combine before the shuffle. What is sorted afterwards are bins, thresholds of a grid, or
pairs of labels: a few rows for each group, however many decisions there are. Rows without a truth or without an
answer don't count; ``n`` says how many did.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sizes of inputs in chunks that results are told apart by.
CHUNK_BANDS = ((1, "1"), (2, "2"), (5, "3-5"), (10, "6-10"))


def chunk_band(chunks: Column) -> Column:
    """The band of a number of chunks."""
    out = None
    for most, name in CHUNK_BANDS:
        out = F.when(chunks <= most, name) if out is None else out.when(chunks <= most, name)
    return out.otherwise("over 10")


def _scored(rows: DataFrame, by: Sequence[str], p: Column, truth: Column) -> DataFrame:
    one = rows.select(*by, p.cast("double").alias("p"), truth.cast("double").alias("y"))
    return one.where("p is not null and not isnan(p) and y is not null")


def _bin(p: Column, bins: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(p * bins))).cast("int")


def reliability(rows: DataFrame, p: Column, truth: Column, by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """(by, bin, n, mean_p, share): of each bin of equal width, the mean probability and the share that is true."""
    each = _scored(rows, by, p, truth).groupBy(*by, _bin(F.col("p"), bins).alias("bin"))
    return each.agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("share"))


def calibration(rows: DataFrame, p: Column, truth: Column, by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """(by, n, accuracy, brier, mae, ece) of probabilities against a truth of 0 and 1.

    accuracy: at 0.5; brier: the mean squared error; mae: the mean absolute one; ece: the mean over all rows of how
    far their bin's mean probability lies from its share that is true.
    """
    off = F.col("p") - F.col("y")
    right = ((F.col("p") >= 0.5) == (F.col("y") >= 0.5)).cast("long")
    sums = {"p": F.col("p"), "y": F.col("y"), "square": off * off, "off": F.abs(off), "right": right}
    each = _scored(rows, by, p, truth).groupBy(*by, _bin(F.col("p"), bins).alias("bin"))
    binned = each.agg(F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(c) for c, x in sums.items()])
    total = F.sum("n")
    measures = [(F.sum("right") / total).alias("accuracy"), (F.sum("square") / total).alias("brier"), (F.sum("off") / total).alias("mae"), (F.sum(F.abs(F.col("p") - F.col("y"))) / total).alias("ece")]
    return binned.groupBy(*by).agg(total.alias("n"), *measures)


def score_errors(rows: DataFrame, score: Column, truth: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, mae, rmse, bias) of scores against true levels."""
    off = F.col("p") - F.col("y")
    return _scored(rows, by, score, truth).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(off)).alias("mae"), F.sqrt(F.avg(off * off)).alias("rmse"), F.avg(off).alias("bias"))


def thresholds(rows: DataFrame, p: Column, truth: Column, by: Sequence[str] = (), steps: int = 100) -> DataFrame:
    """(by, step, threshold, precision, recall, f1) of calling true what has at least the threshold ``step / steps``.

    One pass counts rows and true ones by step; a running sum from the highest step down gives every threshold.
    Steps without a row of their own are left out: they do as the next higher one does.
    """
    step = F.greatest(F.lit(0), F.least(F.lit(steps), F.floor(F.col("p") * steps))).cast("int")
    counts = _scored(rows, by, p, truth).groupBy(*by, step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"))
    down = Window.partitionBy(*by).orderBy(F.desc("step"))
    every = Window.partitionBy(*by)
    counts = counts.withColumns({"called": F.sum("n").over(down), "hit": F.sum("y").over(down), "there": F.sum("y").over(every)})
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    hit, called, there = F.col("hit"), F.col("called"), F.col("there")
    return counts.select(*by, "step", (F.col("step") / steps).alias("threshold"), ratio(hit, called).alias("precision"), ratio(hit, there).alias("recall"), ratio(2 * hit, called + there).alias("f1"))


def best_threshold(rows: DataFrame, p: Column, truth: Column, by: Sequence[str] = (), steps: int = 100) -> DataFrame:
    """(by, threshold, precision, recall, f1): the threshold of the largest F1, the highest one on ties."""
    all_ = thresholds(rows, p, truth, by, steps)
    best = all_.groupBy(*by).agg(F.max(F.struct("f1", "step", "threshold", "precision", "recall")).alias("b"))
    return best.select(*by, *[F.col("b")[c].alias(c) for c in ("threshold", "precision", "recall", "f1")])


def label_f1(rows: DataFrame, label: Column, truth: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by, label, called, there, precision, recall, f1) of every label that is called or true, and macro_f1 over them."""
    pairs = rows.select(*by, label.alias("label"), truth.alias("truth")).where("label is not null and truth is not null")
    pairs = pairs.groupBy(*by, "label", "truth").count()
    hit = F.when(F.col("label") == F.col("truth"), F.col("count")).otherwise(0)
    none = F.lit(0).cast("long")
    called = pairs.select(*by, "label", F.col("count").alias("called"), none.alias("there"), hit.alias("hit"))
    there = pairs.select(*by, F.col("truth").alias("label"), none.alias("called"), F.col("count").alias("there"), none.alias("hit"))
    each = called.union(there).groupBy(*by, "label").agg(*[F.sum(c).alias(c) for c in ("called", "there", "hit")])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    out = each.select(*by, "label", "called", "there", ratio(F.col("hit"), F.col("called")).alias("precision"), ratio(F.col("hit"), F.col("there")).alias("recall"), ratio(2 * F.col("hit"), F.col("called") + F.col("there")).alias("f1"))
    return out.withColumn("macro_f1", F.avg("f1").over(Window.partitionBy(*by)))
