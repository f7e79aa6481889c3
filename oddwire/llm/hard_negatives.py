"""Hard negatives by angular triangle filtering.

Every vector stores its norm and its angles to a few reference directions. Angles on a sphere keep
the triangle inequality, so an anchor and a row with angles s and t to a reference enclose an angle
between ``|s - t|`` and ``min(s + t, 2 pi - s - t)``. Over all references this gives an interval of
the cosine and, times both norms and widened by more than any rounding, an interval that is sure to
hold the score. Only pairs whose interval overlaps a window of wanted scores are scored, in exact
integers.

Rows and anchors are packed into tiles of neighbours by label and angle. Each tile knows the ranges
of its angles, norms and labels, so a join drops pairs of tiles whole. Anchors are a stated query
set against all rows: their tiles go to every group of row tiles, and a task holds the results of
one anchor tile at a time. The best of all tasks are ranked by the window functions of Spark, which
cut each task's rows before the shuffle.

1. The positives of an anchor are the best rows of its label; the running last of them is the
   lower edge of the window.
2. Each positive gives a window of scores for its negatives, between two shares of its score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddwire.llm import words
from oddwire.llm.shared import stored, with_row_key, written

REFERENCES = 8
ANCHOR_TILE = 256
ROW_TILE = 2048
POSITIVES = 5
NEGATIVES = 3
#: More than the error of an angle computed from doubles, and of a score's bound.
ANGLE_SLACK = 1e-6
SHARE_SLACK = 1e-9
#: Products below this are exact in doubles, however they are summed.
EXACT = 2.0**52
_LONG = 2**63 - 1


def integers(column: pa.Array, scale: float, width: int) -> np.ndarray:
    """floor(scale * x) of each component, short vectors filled with zeros."""
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy()[ends[0] : ends[-1]].astype(np.float64)
    lengths = np.diff(ends)
    rows = np.zeros((len(column), width))
    if len(flat):
        at = np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], lengths)
        rows[np.repeat(np.arange(len(column)), lengths), at] = np.floor(scale * flat)
    return rows


def _sums(scale: float, width: int):
    """Sum of the directions of each reference's rows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((REFERENCES, width))
        for batch in batches:
            rows = integers(batch.column("vector"), scale, width)
            norms = np.sqrt((rows**2).sum(axis=1))
            rows = rows / np.where(norms > 0, norms, 1)[:, None]
            np.add.at(total, batch.column("reference").to_numpy(), np.nan_to_num(rows))
        yield pa.RecordBatch.from_arrays(
            [
                words.arrow(np.repeat(np.arange(REFERENCES, dtype=np.int32), width)),
                words.arrow(np.tile(np.arange(width, dtype=np.int32), REFERENCES)),
                words.arrow(total.reshape(-1)),
            ],
            ["reference", "at", "total"],
        )

    return task


def references(rows: DataFrame, scale: float, width: int) -> np.ndarray:
    """Directions of the mean vectors of the labels, dealt to a fixed number of references."""
    found = (
        rows.select(F.pmod(F.xxhash64("label"), F.lit(REFERENCES)).cast("int").alias("reference"), "vector")
        .mapInArrow(_sums(scale, width), "reference int, at int, total double")
        .groupBy("reference", "at")
        .agg(F.sum("total").alias("total"))
        .toArrow()
    )
    means = np.zeros((REFERENCES, width))
    means[found.column("reference").to_numpy(), found.column("at").to_numpy()] = found.column("total").to_numpy()
    # References without rows get some direction.
    means[np.arange(REFERENCES), np.arange(REFERENCES) % width] += 1e-9
    return means / np.sqrt((means**2).sum(axis=1))[:, None]


def angles(rows: np.ndarray, norms: np.ndarray, directions: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        cosines = rows @ directions.T / np.where(norms > 0, norms, 1)[:, None]
    return np.arccos(np.clip(np.nan_to_num(cosines), -1, 1))


def _measured(scale: float, width: int, directions: np.ndarray):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = integers(batch.column("vector"), scale, width)
            norms = np.sqrt((rows**2).sum(axis=1))
            angle = angles(rows, norms, directions)
            near = np.argmin(angle, axis=1) if len(angle) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in ("row_key", "id", "label", "is_anchor")]
                + [
                    words.arrow([r.tobytes() for r in rows], pa.binary()),
                    words.arrow(norms),
                    words.arrow([a.tobytes() for a in angle], pa.binary()),
                    words.arrow(near.astype(np.int32)),
                    words.arrow(angle[np.arange(len(angle)), near]),
                ],
                ["row_key", "id", "label", "is_anchor", "parts", "norm", "angles", "near", "angle"],
            )

    return task


MEASURED = (
    "row_key long, id long, label long, is_anchor boolean, parts binary, norm double, "
    "angles binary, near int, angle double"
)
TILE = (
    "tile long, least_label long, most_label long, least_angle array<double>, "
    "most_angle array<double>, most_norm double, low long, high long, keys binary, ids binary, "
    "labels binary, parts binary, norms binary, angles binary, windows binary"
)


def _tiles(size: int):
    """Neighbours packed together, with the ranges of what they hold."""

    def packed(rows: pa.Table) -> pa.RecordBatch:
        numbers = {k: rows.column(k).to_numpy() for k in ("row_key", "id", "label", "norm")}
        blobs = {k: b"".join(rows.column(k).to_pylist()) for k in ("parts", "angles")}
        angle = np.frombuffer(blobs["angles"]).reshape(len(rows), -1)
        windows = b"".join(rows.column("windows").to_pylist()) if "windows" in rows.column_names else b""
        edges = np.frombuffer(windows, np.int64).reshape(-1, 2)
        edges = edges[edges[:, 0] <= edges[:, 1]]
        values = {
            "tile": int(numbers["row_key"][0]),
            "least_label": int(numbers["label"].min()),
            "most_label": int(numbers["label"].max()),
            "least_angle": angle.min(axis=0).tolist(),
            "most_angle": angle.max(axis=0).tolist(),
            "most_norm": float(numbers["norm"].max()),
            "low": int(edges[:, 0].min()) if len(edges) else None,
            "high": int(edges[:, 1].max()) if len(edges) else None,
            "keys": numbers["row_key"].tobytes(),
            "ids": numbers["id"].tobytes(),
            "labels": numbers["label"].tobytes(),
            "parts": blobs["parts"],
            "norms": numbers["norm"].tobytes(),
            "angles": blobs["angles"],
            "windows": windows,
        }
        return pa.RecordBatch.from_pylist([values], schema=_TILE_SCHEMA)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, count = [], 0
        for batch in batches:
            while len(batch):
                part = batch.slice(0, size - count)
                batch = batch.slice(len(part))
                waiting.append(part)
                count += len(part)
                if count == size:
                    yield packed(pa.Table.from_batches(waiting))
                    waiting, count = [], 0
        if waiting:
            yield packed(pa.Table.from_batches(waiting))

    return task


_KINDS = {"long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}
_TILE_SCHEMA = pa.schema([(n, _KINDS[k]) for n, k in (f.split() for f in TILE.split(", "))])


class _Tile:
    """The arrays of one side of a joined row."""

    def __init__(self, row: dict, side: str):
        self.keys, self.ids, self.labels = (
            np.frombuffer(row[side + k], np.int64) for k in ("keys", "ids", "labels")
        )
        self.norms = np.frombuffer(row[side + "norms"])
        self.parts = np.frombuffer(row[side + "parts"]).reshape(len(self.keys), -1)
        self.angles = np.frombuffer(row[side + "angles"]).reshape(len(self.keys), -1)


def bounds(anchors: _Tile, rows: _Tile) -> tuple[np.ndarray, np.ndarray]:
    """Below and above every score of an anchor and a row."""
    least = np.zeros((len(anchors.keys), len(rows.keys)))
    most = np.full_like(least, np.pi)
    for k in range(anchors.angles.shape[1]):
        s, t = anchors.angles[:, k, None], rows.angles[None, :, k]
        np.maximum(least, np.abs(s - t), out=least)
        around = s + t
        np.minimum(most, np.minimum(around, 2 * np.pi - around), out=most)
    with np.errstate(all="ignore"):
        product = anchors.norms[:, None] * rows.norms[None, :]
        slack = product * SHARE_SLACK + 1
        above = product * np.cos(np.clip(least - ANGLE_SLACK, 0, np.pi)) + slack
        below = product * np.cos(np.clip(most + ANGLE_SLACK, 0, np.pi)) - slack
    return below, above


def scores(anchors: np.ndarray, rows: np.ndarray, norm: float) -> np.ndarray:
    """Exact inner products of integers held as doubles; beyond 64 bits they stop at the ends.

    ``norm`` is at least the product of any two norms.
    """
    if norm < EXACT:
        return np.rint(anchors @ rows.T).astype(np.int64)
    left, right = ([[int(x) for x in row] for row in side] for side in (anchors, rows))
    whole = [[sum(a * b for a, b in zip(x, y)) for y in right] for x in left]
    return np.array(
        [[max(-_LONG, min(_LONG, s)) for s in row] for row in whole], dtype=np.int64
    ).reshape(len(left), len(right))


class _Best:
    """The best (score, id) of each window of each anchor of a tile."""

    def __init__(self, windows: np.ndarray, count: int):
        #: (anchor, window): lowest and highest score wanted; lowest rises as rows are found.
        self.low, self.high = windows[:, :, 0].copy(), windows[:, :, 1]
        self.count = count
        self.found: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def add(self, anchors: _Tile, rows: _Tile, allowed: np.ndarray) -> None:
        """Look through the allowed pairs whose bounds overlap a window."""
        below, above = bounds(anchors, rows)
        edge = np.where(self.low <= self.high, self.low, _LONG).min(axis=1).astype(np.float64)
        top = np.where(self.low <= self.high, self.high, -_LONG).max(axis=1).astype(np.float64)
        # Written so that a bound that is no number rules nothing out.
        open_ = allowed & ~(above < edge[:, None]) & ~(below > top[:, None])
        some, columns = open_.any(axis=1), open_.any(axis=0)
        if not some.any():
            return
        norm = anchors.norms[some].max() * rows.norms[columns].max()
        exact = scores(anchors.parts[some], rows.parts[columns], norm)
        ids, open_ = rows.ids[columns], open_[np.ix_(some, columns)]
        for place, anchor in enumerate(np.flatnonzero(some)):
            own = exact[place]
            wanted = np.flatnonzero(open_[place] & (own >= self.low[anchor].min()))
            if not len(wanted):
                continue
            wanted = wanted[np.lexsort((ids[wanted], -own[wanted]))]
            for window in range(self.low.shape[1]):
                self._put(int(anchor), window, own[wanted], ids[wanted])

    def _put(self, anchor: int, window: int, own: np.ndarray, ids: np.ndarray) -> None:
        low, high = self.low[anchor, window], self.high[anchor, window]
        if low > high:
            return
        first = np.searchsorted(-own, -high)
        chosen = slice(first, min(first + self.count, np.searchsorted(-own, -low, "right")))
        own, ids = own[chosen], ids[chosen]
        if not len(own):
            return
        if (before := self.found.get((anchor, window))) is not None:
            own, ids = np.concatenate([before[0], own]), np.concatenate([before[1], ids])
            order = np.lexsort((ids, -own))[: self.count]
            own, ids = own[order], ids[order]
        self.found[anchor, window] = own, ids
        if len(own) == self.count:
            # A row of the same score may still have a smaller id.
            self.low[anchor, window] = max(low, own[-1])

    def rows(self, keys: np.ndarray) -> pa.RecordBatch:
        columns: list[list] = [[], [], [], []]
        for (anchor, window), (own, ids) in self.found.items():
            columns[0] += [int(keys[anchor])] * len(own)
            columns[1] += [window + 1] * len(own)
            columns[2] += ids.tolist()
            columns[3] += own.tolist()
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays(
            [words.arrow(c, k) for c, k in zip(columns, kinds)], ["anchor_key", "window", "id", "score"]
        )


FOUND = "anchor_key long, window int, id long, score long"


def _search(same_label: bool, n_windows: int, count: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, anchors, best = None, None, None
        for batch in batches:
            for k in range(len(batch)):
                row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
                if row["a_tile"] != tile:
                    if best is not None and best.found:
                        yield best.rows(anchors.keys)
                    tile, anchors = row["a_tile"], _Tile(row, "a_")
                    if row["a_windows"]:
                        windows = np.frombuffer(row["a_windows"], np.int64).reshape(-1, n_windows, 2)
                    else:
                        windows = np.tile(np.array([-_LONG, _LONG]), (len(anchors.keys), n_windows, 1))
                    best = _Best(windows, count)
                rows = _Tile(row, "r_")
                alike = anchors.labels[:, None] == rows.labels[None, :]
                other = anchors.keys[:, None] != rows.keys[None, :]
                best.add(anchors, rows, alike & other if same_label else ~alike)
        if best is not None and best.found:
            yield best.rows(anchors.keys)

    return task


def _joined(anchor_tiles: DataFrame, row_tiles: DataFrame, groups: int, condition: Column) -> DataFrame:
    """Pairs of tiles that meet the condition; anchor tiles go to every group of row tiles."""
    spread = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group")
    left = anchor_tiles.select(*(F.col(c).alias(f"a_{c}") for c in anchor_tiles.columns), spread)
    right = row_tiles.select(*(F.col(c).alias(f"r_{c}") for c in row_tiles.columns))
    right = right.withColumn("group", F.pmod(F.xxhash64("r_tile"), F.lit(groups)).cast("int"))
    names = ["keys", "ids", "labels", "parts", "norms", "angles"]
    pairs = left.join(right.hint("merge"), "group").where(condition)
    return pairs.select(
        "a_tile", "a_windows", *(f"a_{n}" for n in names), *(f"r_{n}" for n in names)
    )


def _highest_score() -> Column:
    """Above every score of two tiles, from the ranges of their angles."""
    gaps = F.transform(
        F.sequence(F.lit(0), F.size("a_least_angle") - 1),
        lambda k: F.greatest(
            F.get("a_least_angle", k) - F.get("r_most_angle", k),
            F.get("r_least_angle", k) - F.get("a_most_angle", k),
        ),
    )
    gap = F.greatest(F.array_max(gaps) - ANGLE_SLACK, F.lit(0.0))
    product = F.col("a_most_norm") * F.col("r_most_norm")
    return product * F.greatest(F.cos(gap), F.lit(0.0)) + product * SHARE_SLACK + 1


def _first(found: DataFrame, own: list[str], count: int) -> DataFrame:
    order = Window.partitionBy(*own).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    scale: float = 256.0,
    shares: tuple[int, int] = (50, 95),
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    sizes: tuple[int, int] = (ANCHOR_TILE, ROW_TILE),
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has id, vector and label; components become ``floor(scale * x)``. Rows with a null
    id, label or vector and rows with a null or non-finite component take no part. An anchor's
    positives are the first other rows of its label; a positive's negatives the first rows of other
    labels whose score lies between the two shares (percent, both included) of the positive's.
    Higher scores come first, then smaller ids. Repeated rows are rows of their own, also of an
    anchor. Vectors shorter than others end in zeros. Scores are exact up to 64 bits and stop
    there. Empty tables and anchors without positives or negatives give no rows.
    """
    spark = vectors.sparkSession
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = stored(vectors, "vectors")
    rows = with_row_key(
        rows,
        [
            F.col("id").cast("long").alias("id"),
            F.col("vector").cast("array<double>").alias("vector"),
            F.col("label").cast("long").alias("label"),
            F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
        ],
    )
    rows = rows.dropna(subset=["id", "vector", "label"]).where(~bad)
    width = max(rows.agg(F.max(F.size("vector"))).first()[0] or 0, 1)
    measured = rows.mapInArrow(_measured(scale, width, references(rows, scale, width)), MEASURED)
    measured = written(measured, "angles")
    place = ["label", "near", "angle", "row_key"]

    def tiles(table: DataFrame, size: int, name: str) -> DataFrame:
        ordered = table.repartitionByRange(*place).sortWithinPartitions(*place)
        return written(ordered.mapInArrow(_tiles(size), TILE), name)

    groups = int(spark.conf.get("spark.sql.shuffle.partitions"))
    row_tiles = tiles(measured, sizes[1], "row-tiles")
    anchors = measured.where("is_anchor")
    same = (F.col("a_least_label") <= F.col("r_most_label")) & (
        F.col("r_least_label") <= F.col("a_most_label")
    )
    near = _joined(tiles(anchors, sizes[0], "anchor-tiles"), row_tiles, groups, same)
    best = near.mapInArrow(_search(True, 1, positives), FOUND)
    best = written(_first(best, ["anchor_key"], positives).drop("window"), "positives")

    edges = best.groupBy("anchor_key").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("own"))
    windows = anchors.join(edges, F.col("row_key") == F.col("anchor_key")).drop("anchor_key")
    windows = windows.mapInArrow(_windows(shares, positives), MEASURED + ", windows binary")
    far = (F.col("a_low").isNotNull()) & ~(_highest_score() < F.col("a_low"))
    far &= (F.col("a_least_label") != F.col("a_most_label")) | (
        F.col("r_least_label") != F.col("r_most_label")
    ) | (F.col("a_least_label") != F.col("r_least_label"))
    found = _joined(tiles(windows, sizes[0], "window-tiles"), row_tiles, groups, far)
    found = found.mapInArrow(_search(False, positives, negatives), FOUND)
    found = _first(found, ["anchor_key", "window"], negatives)
    named = best.select(
        "anchor_key",
        F.col("rank").alias("window"),
        F.col("id").alias("positive_id"),
        F.col("score").alias("positive_score"),
    ).join(anchors.select(F.col("row_key").alias("anchor_key"), F.col("id").alias("anchor_id")), "anchor_key")
    return found.join(named, ["anchor_key", "window"]).select(
        "anchor_id",
        "positive_id",
        "rank",
        F.col("id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )


def window(score: int, shares: tuple[int, int]) -> tuple[int, int]:
    """Least and greatest integer between the two shares of a score, in percent."""
    return -(-score * shares[0] // 100), score * shares[1] // 100


def _windows(shares: tuple[int, int], count: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for own in batch.column("own").to_pylist():
                edges = [window(entry["score"], shares) for entry in own]
                edges += [(1, 0)] * (count - len(edges))
                made.append(np.array(edges, dtype=np.int64).tobytes())
            yield batch.drop_columns(["own"]).append_column("windows", words.arrow(made, pa.binary()))

    return task
