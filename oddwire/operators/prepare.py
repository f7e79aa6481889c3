"""Feature table to standardised vectors: fitted on one table, applied to any.

What is fitted is plain data: means and deviations of the numeric columns, and a stored table of
categories with their ranks and frequencies. Vectors are built from these by expressions and
joins, so a table of any width, and a stream, is prepared the same way.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddwire.operators import categories
from oddwire.schema import CATEGORICAL_COLUMNS
from oddwire.session import materialise


def require_columns(table: DataFrame, names: list[str]) -> None:
    missing = [name for name in names if name not in table.columns]
    if missing:
        raise ValueError(f"table must contain the columns {missing}")


def varying_columns(table: DataFrame, columns: list[str]) -> list[str]:
    """The numeric columns that hold more than one value."""
    if not columns:
        return []
    differ = table.agg(*[(F.min(c) < F.max(c)).alias(c) for c in columns]).first().asDict()
    return [name for name in columns if differ[name]]


@dataclass(frozen=True)
class Statistics:
    """Mean and sample deviation of numeric columns."""

    columns: list[str]
    means: list[float]
    deviations: list[float]

    @property
    def scales(self) -> list[float]:
        return [1 / d if d > 0 else 0.0 for d in self.deviations]


def _numbers(columns: Sequence[str]) -> Column:
    """The columns as an array of doubles; a null or NaN ends the job."""
    values = F.array(*[F.col(c).cast("double") for c in columns])
    bad = F.exists(values, lambda x: x.isNull() | F.isnan(x))
    message = F.lit("numeric features must not be null or NaN")
    return F.when(~bad, values).otherwise(F.raise_error(message).cast("array<double>"))


def numeric_statistics(table: DataFrame, columns: list[str]) -> Statistics:
    """One row of sums per task reaches the driver, as wide as there are columns."""
    if not columns:
        return Statistics([], [], [])
    summary = Summarizer.metrics("mean", "std").summary(array_to_vector(_numbers(columns)))
    row = table.select(summary.alias("s")).select(
        vector_to_array("s.mean").alias("mean"), vector_to_array("s.std").alias("std")
    ).first()
    if row is None or row["mean"] is None or len(row["mean"]) != len(columns):
        return Statistics(list(columns), [0.0] * len(columns), [0.0] * len(columns))
    return Statistics(list(columns), list(row["mean"]), list(row["std"]))


def standardised(statistics: Statistics, centred: bool = False) -> Column:
    """Array of the columns divided by their deviations, constant ones zero."""
    values = _numbers(statistics.columns)
    if centred:
        values = F.zip_with(values, F.lit(statistics.means), lambda x, m: x - m)
    return F.zip_with(values, F.lit(statistics.scales), lambda x, s: x * s)


@dataclass(frozen=True)
class Preparation:
    """Fitted statistics and categories.

    ``index`` has (column, value, index, share, scale): rank, share of the fitted rows, and one
    over the deviation of the column's indicator. Elements are the numeric columns in table
    order, then the indicators of each encoded column, all but its last one (with ``keep``, all).
    """

    numeric: Statistics
    encoded: list[str]
    widths: list[int]
    handle_invalid: str
    index: DataFrame

    @property
    def width(self) -> int:
        return len(self.numeric.columns) + sum(self.widths)

    def offsets(self) -> list[int]:
        start = len(self.numeric.columns)
        return [start + sum(self.widths[:k]) for k in range(len(self.widths))]


def fit_preparation(
    table: DataFrame, handle_invalid: str = "skip", drop_constant: bool = False
) -> Preparation:
    """Ranks of the categories, and statistics of what is left of the rows.

    Ranks count all rows; means and deviations those that ``skip`` keeps. A categorical column
    with a single value is left out, ``drop_constant`` leaves out numeric ones as well.
    """
    require_columns(table, CATEGORICAL_COLUMNS)
    if handle_invalid not in categories.HANDLE_INVALID:
        raise ValueError(f"handle_invalid must be one of {categories.HANDLE_INVALID}")
    index = categories.category_index(table, CATEGORICAL_COLUMNS)
    sizes = categories.widths(index)
    encoded = [c for c in CATEGORICAL_COLUMNS if sizes.get(c, 0) > 1]
    if single := [c for c in CATEGORICAL_COLUMNS if c not in encoded]:
        warnings.warn(f"left out of the features, fewer than two values: {single}", stacklevel=2)
    known = table if handle_invalid == "keep" else table.where(categories.all_known(encoded))
    numeric = [c for c in table.columns if c not in ("id", "label", *CATEGORICAL_COLUMNS)]
    if drop_constant:
        numeric = varying_columns(known, numeric)
    rows = known.count()
    shares = index.where(F.col("column").isin(encoded))
    if handle_invalid == "skip" and rows < table.count():
        kept = categories.value_counts(known, encoded).withColumnRenamed("count", "kept")
        shares = shares.join(kept, ["column", "value"], "left").withColumn("count", F.coalesce("kept", F.lit(0)))
    share = F.col("count") / F.lit(float(max(rows, 1)))
    shares = shares.select("column", "value", "index", share.alias("share"))
    variance = F.col("share") * (1 - F.col("share")) * F.lit(rows / max(rows - 1, 1))
    scaled = shares.select("*", F.when(variance > 0, 1 / F.sqrt(variance)).otherwise(F.lit(0.0)).alias("scale"))
    last = 0 if handle_invalid == "keep" else 1
    return Preparation(
        numeric_statistics(known, numeric),
        encoded,
        [sizes[c] - last for c in encoded],
        handle_invalid,
        materialise(scaled),
    )


def _indicators(absent: list[float], rank: Column, scale: Column) -> Column:
    return F.transform(F.lit(absent), lambda x, i: F.when(i == rank, x + scale).otherwise(x))


def _dense(model: Preparation) -> Column:
    """Centred elements: all indicators at their absent value, but for the row's own."""
    parts = [standardised(model.numeric, True)] if model.numeric.columns else []
    for column, width in zip(model.encoded, model.widths):
        own = model.index.where((F.col("column") == column) & (F.col("index") < width)).orderBy("index")
        # As wide as the vectors themselves.
        absent = [-r["share"] * r["scale"] for r in own.select("share", "scale").collect()]
        parts.append(_indicators(absent, F.col(f"{column}_index"), F.col(f"{column}_scale")))
    return array_to_vector(F.concat(*parts))


def _sparse(model: Preparation) -> Column:
    parts = []
    if model.numeric.columns:
        numbers = standardised(model.numeric)
        parts.append(
            F.transform(numbers, lambda x, i: F.struct(i.cast("long").alias("i"), x.alias("x")))
        )
    if model.encoded:
        entries = [
            categories.one_hot_entry(F.col(f"{c}_index"), width, F.col(f"{c}_scale"), offset)
            for c, width, offset in zip(model.encoded, model.widths, model.offsets())
        ]
        parts.append(F.array(*entries))
    return categories.sparse_layout(F.lit(model.width), F.concat(*parts))


def prepared(model: Preparation, table: DataFrame, centred: bool = False) -> DataFrame:
    """(id, label, scaled_features) of a feature table.

    Vectors are divided by the deviations. Clusters and squared Euclidean distances are the same
    about any origin, and vectors that are not centred stay as sparse as their one-hot part;
    ``centred`` subtracts the fitted means, which makes every vector dense. Sparse vectors are
    written as they are made, as iterations read them again and again.
    """
    require_columns(table, [*model.numeric.columns, *model.encoded])
    table = categories.with_category_index(
        table, model.index, model.encoded, model.handle_invalid, also=["scale"]
    )
    vector = _dense(model) if centred else _sparse(model)
    vectors = table.select("id", "label", vector.alias("scaled_features"))
    return vectors if centred else categories.as_vectors(vectors, "scaled_features")


def prepare(table: DataFrame, centred: bool = False, **options) -> DataFrame:
    """Fit on a table and transform the same table."""
    return prepared(fit_preparation(table, **options), table, centred)


def prepare_sets(
    train: DataFrame, test: DataFrame, refit: bool = False, centred: bool = False, **options
) -> tuple[DataFrame, DataFrame, Preparation]:
    """Prepared training and test set, and what was fitted on the training set.

    With ``refit`` the test set is fitted on its own, as when the two are prepared in two
    independent runs; each is then centred about its own means, as the two have no common origin.
    Vectors of different width cannot be compared, so that is an error.
    """
    model = fit_preparation(train, **options)
    centred |= refit
    if not refit:
        return prepared(model, train, centred), prepared(model, test, centred), model
    own = fit_preparation(test, **options)
    if model.width != own.width:
        raise ValueError(
            f"training vectors have {model.width} elements, test vectors {own.width}: "
            "the sets have different categories, prepare them with refit=False"
        )
    return prepared(model, train, centred), prepared(own, test, centred), model
