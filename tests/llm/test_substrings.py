import random
from collections import Counter

import numpy as np
import pytest

import messy
from oddwire.llm import substrings


def brute(rows, size):
    documents = [messy.words(text) for _, text in rows]
    counts = Counter(
        tuple(w[i : i + size]) for w in documents for i in range(len(w) - size + 1)
    )
    result = []
    for (doc_id, _), w in zip(rows, documents):
        gone = set()
        for i in range(len(w) - size + 1):
            if counts[tuple(w[i : i + size])] > 1:
                gone.update(range(i, i + size))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        result.append((doc_id, len(w), len(gone), kept.decode()))
    return sorted(result, key=str)


def found(frame):
    columns = ("doc_id", "n_words", "n_removed", "kept_text")
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=str)


@pytest.mark.parametrize("log2_cells", [16, 6])
def test_like_brute_force_however_full_the_sketch(spark, tmp_path, log2_cells):
    draw = random.Random(5)
    passage = [f"p{k}" for k in range(12)]
    rows = []
    for k in range(60):
        w = [draw.choice("abcdefgh") + str(draw.randrange(40)) for _ in range(draw.randrange(60))]
        if k % 3 == 0:
            at = draw.randrange(len(w) + 1)
            w[at:at] = passage[draw.randrange(4) :]
        rows.append((k, " ".join(w)))
    rows += [(100 + k, t) for k, t in enumerate(messy.ODD)] + [rows[0], (None, rows[1][1])]
    docs = messy.stored(spark, rows, tmp_path)
    got = found(substrings.remove_repeats(docs, size=7, log2_cells=log2_cells))
    assert got == brute(rows, 7)


def test_anchor_counts_reach_window_counts():
    draw = np.random.default_rng(2)
    for _ in range(200):
        hashes = draw.integers(0, 4, draw.integers(0, 60)).astype(np.uint64)
        least, marked = substrings.anchors(hashes, 9)
        windows = Counter(tuple(hashes[i : i + 9]) for i in range(len(least)))
        counts = Counter(marked.tolist())
        for i, anchor in enumerate(least.tolist()):
            assert counts[anchor] >= windows[tuple(hashes[i : i + 9])]


def test_empty_table(spark, tmp_path):
    assert substrings.remove_repeats(messy.stored(spark, [], tmp_path)).count() == 0
