import random
from collections import defaultdict

import numpy as np
import pyarrow as pa

import messy
from oddwire.llm import jaccard
from oddwire.llm.components import components


def sets(rows):
    result = []
    for _, text in rows:
        w = messy.words(text, lower=True)
        short = [tuple(w)] if w else []
        long = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        result.append(frozenset(long if len(w) >= 5 else short))
    return result


def brute(rows):
    shingles = sets(rows)
    parent = list(range(len(rows)))

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, left in enumerate(shingles):
        for b in range(a):
            both = len(left & shingles[b])
            if both and 100 * both >= 75 * len(left | shingles[b]):
                parent[top(a)] = top(b)
    least = defaultdict(list)
    for k, (doc_id, _) in enumerate(rows):
        least[top(k)].append(doc_id)
    return sorted(
        (
            (
                doc_id,
                len(shingles[k]),
                min((d for d in least[top(k)] if d is not None), default=None)
                if shingles[k]
                else doc_id,
            )
            for k, (doc_id, _) in enumerate(rows)
        ),
        key=str,
    )


def near_copies(draw, families):
    """Families of texts about as far apart as the threshold, in chains and with shared parts."""
    common = [f"c{k}" for k in range(30)]
    texts = []
    for f in range(families):
        w = [f"f{f}w{draw.randrange(50)}" for _ in range(draw.randrange(20, 90))]
        if f % 3 == 0:
            w[5:5] = common
        for _ in range(draw.randrange(1, 7)):
            w = list(w)
            for _ in range(draw.randrange(0, 4)):
                w[draw.randrange(len(w))] = f"e{draw.randrange(1000)}"
            texts.append(" ".join(w))
    return texts


def test_links_and_classes_like_brute_force(spark, tmp_path):
    draw = random.Random(9)
    texts = near_copies(draw, 45)
    texts += [texts[0].upper(), texts[1], texts[2].replace(" ", "\n\n")]
    rows = [(1000 - k, t) for k, t in enumerate(texts)]
    rows += [(2000 + k, t) for k, t in enumerate(messy.ODD)] + [(None, texts[3]), (None, "lone w")]
    rows += [rows[5], (None, None)]
    docs = messy.stored(spark, rows, tmp_path)
    result = jaccard.similarity_classes(docs).collect()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in result), key=str)
    assert got == brute(rows)
    kept = [r for r in result if r.representative]
    named = {r.component_id for r in result if r.n_shingles and r.component_id is not None}
    assert named <= {r.doc_id for r in kept}
    assert len(kept) == len({(r.component_id, r.n_shingles == 0) for r in kept if r.n_shingles}) + sum(
        r.n_shingles == 0 for r in result
    )


def test_index_alone_finds_every_link(spark, tmp_path, monkeypatch):
    """Without any leader all links must come from the prefix index."""
    draw = random.Random(4)
    rows = list(enumerate(near_copies(draw, 25)))

    def none(rows, keys, rarity):
        schema = "x long, r long, similarity double, lost array<long>, gained array<long>"
        return spark.createDataFrame([], schema)

    monkeypatch.setattr(jaccard, "leader_links", none)
    monkeypatch.setattr(jaccard, "BLOCK_ENTRIES", 2)
    docs = messy.stored(spark, rows, tmp_path)
    result = jaccard.similarity_classes(docs).collect()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in result), key=str)
    assert got == brute(rows)


def test_empty_table(spark, tmp_path):
    assert jaccard.similarity_classes(messy.stored(spark, [], tmp_path)).count() == 0


def test_components(spark):
    links = [(k, k + 1) for k in range(10, 40)] + [(3, 2), (2, 1), (1, 3), (7, 7), (50, 1)]
    frame = spark.createDataFrame([*links, (None, 4)], "a long, b long")
    got = dict(components(frame).collect())
    assert got == {k: 10 for k in range(10, 41)} | {1: 1, 2: 1, 3: 1, 50: 1}


def test_driver_gets_a_byte_a_counter():
    """Counts of several tasks are added and ranked in a task; ranks alone go on."""
    counts = np.zeros((3, jaccard.COUNTER_BLOCK), np.uint8)
    counts[0, :3], counts[1, 1:4], counts[2, 5] = 255, 255, 9
    batch = pa.RecordBatch.from_arrays(
        [pa.array([2, 2, 7], pa.int32()), pa.array([c.tobytes() for c in counts], pa.binary())],
        ["block", "counts"],
    )
    got = [r for made in jaccard._ranks(iter([batch])) for r in made.to_pylist()]
    assert [r["block"] for r in got] == [2, 7]
    ranks = [np.frombuffer(r["ranks"], np.uint8) for r in got]
    assert all(len(r) == jaccard.COUNTER_BLOCK for r in ranks)
    assert ranks[0][:5].tolist() == [64, 71, 71, 64, 0] and ranks[1][5] == 26
