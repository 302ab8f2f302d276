"""Metrics of classifiers as aggregations: confusion, F1, calibration error, AUC, thresholds and bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.operators import ordering


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(truth, predicted).agg(F.count("*").alias("n"))


def per_class(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """label, precision, recall, f1 and support; undefined ratios are 0."""
    both = F.explode(F.array(F.struct(F.col(truth).alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col(predicted).alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"))))
    hit = (F.col(truth) == F.col(predicted)).cast("int")
    g = df.select(both.alias("b"), hit.alias("hit")).groupBy("b.label").agg(F.sum("b.t").alias("support"), F.sum("b.p").alias("found"), F.sum(F.col("hit") * F.col("b.t")).alias("hits"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    f1 = F.when(F.col("support") + F.col("found") > 0, 2 * F.col("hits") / (F.col("support") + F.col("found"))).otherwise(0.0)
    return g.select("label", ratio("hits", "found").alias("precision"), ratio("hits", "support").alias("recall"), f1.alias("f1"), "support")


def macro_f1(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Over the classes that occur as truth or prediction."""
    acc = df.agg(F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("accuracy"))
    return per_class(df, truth, predicted).agg(F.avg("f1").alias("macro_f1")).join(acc)


def calibration_error(df: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over bins that are open below and closed above."""
    b = df.withColumn("_b", F.ceil(F.col(confidence) * bins)).groupBy("_b").agg(F.count("*").alias("n"), F.avg(F.col(correct).cast("double")).alias("a"), F.avg(confidence).alias("c"))
    return b.filter("_b > 0").agg(F.sum(F.col("n") * F.abs(F.col("a") - F.col("c"))).alias("s")).join(df.agg(F.count("*").alias("n"))).select(F.try_divide("s", "n").alias("ece"))


def auc(df: DataFrame, score: str, positive: str) -> DataFrame:
    """Area under the ROC curve by ranks, ties counting half. Scores are grouped first."""
    g = df.groupBy(score).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.sum(1 - F.col(positive).cast("long")).alias("n"))
    part = ordering.running(g, [score], {"_below": "n"})
    return part.agg(F.try_divide(F.sum(F.col("p") * (F.col("_below") + F.col("n") / 2)), (F.sum("p") * F.sum("n")).cast("double")).alias("auc"))


def threshold(df: DataFrame, score: str, alarms: int) -> DataFrame:
    """The smallest score that at most so many rows reach; ties are never split."""
    g = df.groupBy(score).agg(F.count("*").alias("n"))
    above = ordering.running(g, [F.desc(score)], {"_above": "n"})
    return above.filter(F.col("_above") + F.col("n") <= alarms).agg(F.min(score).alias("threshold"))


def bootstrap(df: DataFrame, group: str, truth: str, predicted: str, rounds: int = 400, seed: int = 7) -> DataFrame:
    """95 % interval of the accuracy over resampled groups. Each round weighs a group by a Poisson draw from its hash,
    so rounds need no shuffle of rows: groups are counted once."""
    g = df.groupBy(group).agg(F.count("*").alias("n"), F.sum((F.col(truth) == F.col(predicted)).cast("long")).alias("hits"))
    u = (F.pmod(F.xxhash64(F.col(group), "round", F.lit(seed)), F.lit(1_000_003)) + 0.5) / 1_000_003
    limits, total, p = [], 0.0, 2.718281828459045**-1
    for k in range(8):
        total += p
        limits.append(total)
        p /= k + 1
    weight = sum(((u > x).cast("int") for x in limits), F.lit(0))
    w = g.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("w", weight)
    per = w.groupBy("round").agg(F.try_divide(F.sum(F.col("w") * F.col("hits")), F.sum(F.col("w") * F.col("n"))).alias("accuracy"))
    return per.agg(F.percentile("accuracy", F.lit(0.025)).alias("low"), F.percentile("accuracy", F.lit(0.975)).alias("high"))


def quartiles(df: DataFrame, label: str, value: str, classes: list[str]) -> DataFrame:
    """Quartiles per class of a fixed list; classes without rows stay, with nulls."""
    q = df.groupBy(label).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.count("*").alias("n"))
    base = df.sparkSession.createDataFrame([(c,) for c in classes], f"{label} string")
    return base.join(q, label, "left").select(label, F.coalesce("n", F.lit(0)).alias("n"), F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
