import random

import messy
from oddwire.llm import decontaminate

ITEM = " ".join(f"w{k}" for k in range(40))


def pairs(frame):
    return sorted((r.doc_id, r.item_id, r.covered, r.tiles) for r in frame.collect())


def test_tiles_are_longest_first_and_do_not_overlap():
    draw = random.Random(1)
    for _ in range(60):
        item = [draw.randrange(4) for _ in range(draw.randrange(30))]
        text = [draw.randrange(4) for _ in range(draw.randrange(60))]
        tiles = decontaminate.tile(item, text, 3)
        used_item, used_text, sizes = set(), set(), []
        for a, b, size in tiles:
            assert item[a : a + size] == text[b : b + size] and size >= 3
            assert not used_item & set(range(a, a + size))
            assert not used_text & set(range(b, b + size))
            used_item |= set(range(a, a + size))
            used_text |= set(range(b, b + size))
        for a in range(len(item) - 2):
            for b in range(len(text) - 2):
                if item[a : a + 3] == text[b : b + 3]:
                    free = set(range(a, a + 3)) - used_item == set(range(a, a + 3))
                    assert not free or used_text & set(range(b, b + 3))
    assert decontaminate.tile([1, 2, 3, 9, 4, 5, 6, 7], [4, 5, 6, 7, 8, 1, 2, 3], 3) == [
        (4, 0, 4),
        (0, 5, 3),
    ]
    assert decontaminate.tile(list(range(100)), list(range(100)), 5) == [(0, 0, 100)]


def test_reordered_partial_and_odd_texts(spark, tmp_path):
    w = ITEM.split()
    turned = w[30:] + ["x"] + w[15:30] + ["y"] + w[:15]
    rows = [
        (1, f"before {ITEM.upper()} after"),
        (2, "\n".join(turned)),
        (3, " ".join(w[:20])),
        (4, " ".join(f"{x} z" for x in w)),
        (None, ITEM),
        (1, ITEM),
        (5, "nothing " * 5000),
    ] + [(10 + k, t) for k, t in enumerate(messy.ODD)]
    docs = messy.stored(spark, rows, tmp_path)
    items = [(7, ITEM), (8, None), (9, "a b"), (None, " ".join(f"v{k}" for k in range(9))), (11, "")]
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, row_key int")
    found = decontaminate.contaminated(docs, benchmark).collect()
    got = sorted(((r.doc_id, r.item_id, r.covered, r.tiles) for r in found), key=str)
    assert got == sorted(
        [(1, 7, 40, 1), (1, 7, 40, 1), (2, 7, 40, 3), (None, 7, 40, 1)], key=str
    )
    left = decontaminate.clean_documents(docs, benchmark)
    assert left.columns == docs.columns
    assert left.count() == len(rows) - 4
    assert decontaminate.contaminated(docs, benchmark.limit(0)).count() == 0
    assert decontaminate.contaminated(docs.limit(0), benchmark).count() == 0


def test_items_that_repeat_their_words(spark, tmp_path):
    sentence = " ".join(f"s{k}" for k in range(10))
    said = [" ".join(["again"] * 30), " ".join([sentence] * 9), "a b c " * 20]
    rows = [(k, f"before it {text} behind it") for k, text in enumerate(said)]
    rows += [(7, " ".join([sentence] * 5)), (8, " ".join([sentence] * 6)), (9, "again " * 12)]
    docs = messy.stored(spark, rows, tmp_path)
    benchmark = spark.createDataFrame(list(enumerate(said)), "item_id long, text string")
    found = pairs(decontaminate.contaminated(docs, benchmark))
    assert found == [(0, 0, 30, 1), (1, 1, 90, 1), (2, 2, 60, 1), (8, 1, 60, 1)]
    left = decontaminate.clean_documents(docs, benchmark)
    assert sorted(r.doc_id for r in left.collect()) == [7, 9]


def test_tiles_of_repeated_words_in_linear_space():
    assert decontaminate.tile([1] * 60, [1] * 20_000, 5) == [(0, 0, 60)]
    item, text = [1, 2, 3] * 10, [1, 2, 3] * 4 + [9] + [1, 2, 3] * 3
    assert decontaminate.tile(item, text, 5) == [(0, 0, 12), (12, 13, 9)]
