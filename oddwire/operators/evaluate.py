"""Precision, recall, F-measures and curves by threshold.

A prediction is scored by its cluster number or by any number, and normal traffic is the positive
class. All reports come from one table with a row per distinct score. Continuous scores are as
many as the rows, so the table is sorted by range partitions: sums run inside a partition, and
begin at the sums of the partitions before it, one row each.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddwire.schema import NORMAL
from oddwire.session import materialise

# The betas of the F-measure report.
BETAS = [0.5, 1.0, 2.0, 3.0]


def score_and_label(
    predictions: DataFrame, score: str = "prediction", positive: str | Column = NORMAL
) -> DataFrame:
    """(score, label): the cluster number, or another column, and 1.0 for the positive class.

    ``positive`` is a label or a condition.
    """
    is_positive = F.col("label") == positive if isinstance(positive, str) else positive
    return predictions.select(
        F.col(score).cast("double").alias("score"), is_positive.cast("double").alias("label")
    )


def confusion_by_threshold(scores: DataFrame) -> DataFrame:
    """(threshold, point, pos, neg, tp, fp, positives, negatives) of each distinct score.

    ``point`` counts the scores from the highest, ``pos`` and ``neg`` are the rows at the score,
    ``tp`` and ``fp`` those at or above it. The table is written once and serves every report.
    """
    positive = F.col("label") > 0.5
    counts = scores.groupBy(F.col("score").alias("threshold")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")
    )
    falling = F.desc("threshold")
    placed = materialise(
        counts.repartitionByRange(falling)
        .sortWithinPartitions(falling)
        .select("*", F.spark_partition_id().alias("part"))
    )
    sums = [F.count("*"), F.sum("pos"), F.sum("neg")]
    # A row for each partition of the sort, however many scores there are.
    parts = sorted(tuple(r) for r in placed.groupBy("part").agg(*sums).collect())
    before = list(accumulate((p[1:] for p in parts), lambda a, b: tuple(map(sum, zip(a, b))), initial=(0, 0, 0)))
    rows = [(p[0], *b, *before[-1][1:]) for p, b in zip(parts, before)]
    offsets = scores.sparkSession.createDataFrame(
        rows, "part int, points long, tp0 long, fp0 long, positives long, negatives long"
    )
    so_far = Window.partitionBy("part").orderBy(falling)
    until_here = so_far.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.join(F.broadcast(offsets), "part").select(
        "threshold",
        (F.col("points") + F.row_number().over(so_far)).alias("point"),
        "pos",
        "neg",
        (F.col("tp0") + F.sum("pos").over(until_here)).alias("tp"),
        (F.col("fp0") + F.sum("neg").over(until_here)).alias("fp"),
        "positives",
        "negatives",
    )


def _ratio(part: Column, total: Column, empty: float) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), total), F.lit(empty))


def _precision(tp: Column, fp: Column) -> Column:
    return _ratio(tp, tp + fp, 1.0)


def _rates(tp: Column, fp: Column) -> tuple[Column, Column]:
    """False and true positive rate."""
    return _ratio(fp, F.col("negatives"), 0.0), _ratio(tp, F.col("positives"), 0.0)


def precision_recall(scores: DataFrame) -> DataFrame:
    """(threshold, precision, recall)."""
    return confusion_by_threshold(scores).select(
        "threshold",
        _precision(F.col("tp"), F.col("fp")).alias("precision"),
        _ratio(F.col("tp"), F.col("positives"), 0.0).alias("recall"),
    )


def f_measure(precision: Column, recall: Column, beta: Column) -> Column:
    squared = beta * beta
    f = F.try_divide((1 + squared) * precision * recall, squared * precision + recall)
    return F.coalesce(f, F.lit(0.0))


def f_beta(by_threshold: DataFrame, betas: Sequence[float] = BETAS) -> DataFrame:
    """(beta, threshold, f), from precision and recall by threshold."""
    each = by_threshold.withColumn("beta", F.explode(F.lit([float(b) for b in betas])))
    return each.select(
        "beta",
        "threshold",
        f_measure(F.col("precision"), F.col("recall"), F.col("beta")).alias("f"),
    )


def f_beta_pivot(f_table: DataFrame, thresholds: Sequence[float] | None = None) -> DataFrame:
    """One row per beta and one column per threshold, highest threshold first."""
    if thresholds is None:
        rows = f_table.select("threshold").distinct().orderBy(F.desc("threshold")).collect()
        thresholds = [row["threshold"] for row in rows]
    return (
        f_table.groupBy("beta").pivot("threshold", list(thresholds)).agg(F.first("f")).orderBy("beta")
    )


def best_f_beta(f_table: DataFrame) -> DataFrame:
    """Per beta the largest F-measure and its threshold, the higher threshold on a tie."""
    best = F.max_by(F.struct("threshold", "f"), F.struct("f", "threshold"))
    return f_table.groupBy("beta").agg(best.alias("best")).select("beta", "best.threshold", "best.f")


def roc_curve(scores: DataFrame) -> DataFrame:
    """(point, x, y): false and true positive rate, from (0, 0) to (1, 1)."""
    confusion = confusion_by_threshold(scores)
    x, y = _rates(F.col("tp"), F.col("fp"))
    rates = confusion.select(F.col("point").cast("int").alias("point"), x.alias("x"), y.alias("y"))
    first = scores.sparkSession.createDataFrame([(0, 0.0, 0.0)], "point int, x double, y double")
    last = rates.agg((F.coalesce(F.max("point"), F.lit(0)) + 1).alias("point")).select(
        "point", F.lit(1.0).alias("x"), F.lit(1.0).alias("y")
    )
    return first.unionByName(rates).unionByName(last)


def pr_curve(scores: DataFrame) -> DataFrame:
    """(point, x, y): recall and precision, begun at recall 0 with the first precision."""
    points = confusion_by_threshold(scores).select(
        F.col("point").cast("int").alias("point"),
        _ratio(F.col("tp"), F.col("positives"), 0.0).alias("x"),
        _precision(F.col("tp"), F.col("fp")).alias("y"),
    )
    first = points.where("point = 1").select(F.lit(0).alias("point"), F.lit(0.0).alias("x"), "y")
    return first.unionByName(points)


def areas_under_curves(scores: DataFrame) -> DataFrame:
    """(curve, area) of ``roc`` and ``pr``, both from one aggregation.

    Each score adds the trapezoid between the point before it and its own; what was before it
    follows from its own counts, so no row looks at another.
    """
    tp, fp = F.col("tp"), F.col("fp")
    tp0, fp0 = tp - F.col("pos"), fp - F.col("neg")

    def slice_(before: tuple[Column, Column], here: tuple[Column, Column]) -> Column:
        return (here[0] - before[0]) * (here[1] + before[1]) / 2

    roc = slice_(_rates(tp0, fp0), _rates(tp, fp))
    here = (_ratio(tp, F.col("positives"), 0.0), _precision(tp, fp))
    first = F.when(tp0 + fp0 == 0, here[1]).otherwise(_precision(tp0, fp0))
    pr = slice_((_ratio(tp0, F.col("positives"), 0.0), first), here)
    # The curve ends at (1, 1), where the last point is unless a class is empty.
    ends = [(F.coalesce(F.max(c), F.lit(0)) > 0).cast("double") for c in ("negatives", "positives")]
    to_end = (1 - ends[0]) * (1 + ends[1]) / 2
    areas = confusion_by_threshold(scores).agg(
        (F.coalesce(F.sum(roc), F.lit(0.0)) + to_end).alias("roc"),
        F.coalesce(F.sum(pr), F.lit(0.0)).alias("pr"),
    )
    return areas.select(F.explode(F.create_map(F.lit("roc"), "roc", F.lit("pr"), "pr")).alias("curve", "area"))
