import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddwire.llm import hard_negatives as hn

SCHEMA = "id long, vector array<double>, label int, score string, rank string, `group` int"


def brute(rows, every, scale=256.0, shares=(50, 95), positives=5, negatives=3):
    """(anchor, positive, rank, negative, scores) by comparing all rows, in Python integers."""
    known = []
    for id_, vector, label in rows:
        if id_ is None or label is None or vector is None:
            continue
        if any(x is None or not math.isfinite(x) for x in vector):
            continue
        known.append((id_, [math.floor(scale * x) for x in vector], label))
    found = []
    for a, (id_, vector, label) in enumerate(known):
        if id_ % every:
            continue
        scored = [
            (-sum(x * y for x, y in zip(vector, other)), i, own == label)
            for k, (i, other, own) in enumerate(known)
            if k != a
        ]
        scored.sort()
        for score, positive, _ in [s for s in scored if s[2]][:positives]:
            wanted = [
                s
                for s in scored
                if not s[2] and shares[0] * -score <= 100 * -s[0] <= shares[1] * -score
            ]
            for rank, (other, negative, _) in enumerate(wanted[:negatives], 1):
                found.append((id_, positive, rank, negative, -score, -other))
    return sorted(found)


def mined(spark, rows, tmp_path, every=5, **options):
    wide = [(*row, "s", "r", 1) for row in rows]
    path = str(tmp_path / "vectors")
    spark.createDataFrame(wide, SCHEMA).repartition(5).write.parquet(path)
    table = hn.mine(spark.read.parquet(path), F.col("id") % every == 0, **options)
    return sorted(tuple(r) for r in table.collect())


def draw(count, width, labels, seed):
    random_ = random.Random(seed)
    centres = [[random_.gauss(0, 0.1) for _ in range(width)] for _ in range(labels)]
    return [
        (k, [x + random_.gauss(0, 0.08) for x in centres[k % labels]], (k + (k % 7 == 0)) % labels)
        for k in range(count)
    ]


@pytest.mark.parametrize("sizes", [(256, 2048), (7, 11)])
def test_like_brute_force(spark, tmp_path, sizes):
    rows = draw(400, 16, 4, 1)
    assert mined(spark, rows, tmp_path, sizes=sizes) == brute(rows, 5) != []


def test_odd_rows(spark, tmp_path):
    rows = draw(60, 4, 2, 2)
    rows += [
        (None, [0.1] * 4, 0),
        (100, None, 0),
        (105, [0.1] * 4, None),
        (110, [0.1, None, 0.2, 0.3], 0),
        (115, [0.1, math.nan, 0.2, 0.3], 0),
        (120, [0.1, math.inf, 0.2, 0.3], 1),
        (125, [], 0),
        (130, [0.0] * 4, 1),
        (135, [0.3, 0.4], 0),
        (140, [-0.3, -0.4, 0.1, 0.0], 0),
    ]
    rows += rows[:12] + rows[:5]
    rows = [(i, v and [*v], n) for i, v, n in rows]
    assert mined(spark, rows, tmp_path) == brute(rows, 5) != []


def test_many_ties(spark, tmp_path):
    rows = [(k, [0.5, 0.5 if k % 3 else 0.4], k % 3) for k in range(90)]
    assert mined(spark, rows, tmp_path, sizes=(4, 8)) == brute(rows, 5) != []


def test_large_components(spark, tmp_path):
    rows = [(k, [2.0**18 * (k + 1), 3.0**10 * (k % 4 + 0.5)], k % 2) for k in range(20)]
    assert mined(spark, rows, tmp_path) == brute(rows, 5) != []
    ends = [(k, [1e30 * (k + 1)], k % 2) for k in range(10)]
    assert mined(spark, ends, tmp_path / "ends") == []


def test_empty_table(spark, tmp_path):
    assert mined(spark, [], tmp_path) == []


def test_bounds_hold():
    draw_ = np.random.default_rng(3)
    parts = np.floor(draw_.normal(0, 40, (300, 24)))
    parts[:3] = [[0], [1], [-1]]
    directions = draw_.normal(0, 1, (6, 24))
    directions[0] = parts[5]
    directions /= np.sqrt((directions**2).sum(axis=1))[:, None]

    def tile(part):
        made = object.__new__(hn._Tile)
        made.keys, made.parts = np.arange(len(part)), part
        made.norms = np.sqrt((part**2).sum(axis=1))
        made.angles = hn.angles(part, made.norms, directions)
        return made

    below, above = hn.bounds(tile(parts[:100]), tile(parts))
    exact = parts[:100] @ parts.T
    assert (below <= exact).all() and (exact <= above).all()
    product = np.outer(np.ones(100), np.ones(300))
    assert ((above - below) < 2 * (np.abs(exact).max() * product)).any()
