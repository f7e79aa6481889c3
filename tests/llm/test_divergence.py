import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from oddwire.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, n int, id string"


def brute(rows, least, top):
    term = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    docs = []
    for text, lang, source in rows:
        data = (text or "").encode()
        data = re.sub(rb"[A-Z]", lambda m: m[0].lower(), data)
        docs.append((lang or "", source or "", Counter(term.findall(data))))
    found = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        spread = Counter(t for d in own for t in d[2])
        kept = sorted(t for t, n in spread.items() if n >= least)
        groups = {}
        for _, source, counts in own:
            groups.setdefault(source, Counter()).update(counts)
        whole = sum(groups.values(), Counter())

        def p(counts):
            total = sum(counts[t] for t in kept) + 2 * len(kept)
            return [1 + 10**9 * (counts[t] + 2) // total for t in kept]

        prices, q = {s: p(c) for s, c in groups.items()}, p(whole)
        for source, own_p in prices.items():
            part = [
                (sum((a - b) ** 2 // (a + b) for a, b in zip(own_p, other)), s.encode())
                for s, other in prices.items()
                if s != source
            ]
            terms = [
                ((a - b) ** 2 // (a + b), t)
                for a, b, t in zip(own_p, q, kept)
                if groups[source][t] and a > b
            ]
            for kind, entries, most in (("pair", part, None), ("term", terms, top)):
                entries.sort(key=lambda e: (-e[0], e[1]))
                for rank, (value, item) in enumerate(entries[:most], 1):
                    found.append((lang, source, kind, item.decode(), value, rank))
    return sorted(found)


def audited(spark, rows, tmp_path, least=2, top=3):
    path = str(tmp_path / "documents")
    wide = [(k, *row, "t", 1, "i") for k, row in enumerate(rows)]
    spark.createDataFrame(wide, SCHEMA).repartition(4).write.parquet(path)
    return sorted(tuple(r) for r in divergence.audit(spark.read.parquet(path), least, top).collect())


ROWS = [
    ("The cat, the Cat; the dog", "en", "a"),
    ("a dog and THE bird 12 x_y", "en", "a"),
    ("cat bird bird", "en", "b"),
    ("Élan élan naïve İ", "fr", "b"),
    ("élan naïve\tnaïve naïve", "fr", "a"),
    (None, "en", "c"),
    ("", "en", None),
    ("the the the", None, None),
    ("the dog", None, "z"),
    ("only once", "xx", "p"),
    ("12 34 !", "xx", "q"),
    ("cat " * 20_000 + "dog", "en", "long"),
    ("cat bird bird", "en", "b"),
    ("\u00a0nbsp dog", "en", "é"),
]


@pytest.mark.parametrize("block", [1 << 14, 2])
def test_like_brute_force(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(divergence, "BLOCK_TERMS", block)
    monkeypatch.setattr(divergence, "PAIR_SOURCES", 2)
    assert audited(spark, ROWS, tmp_path) == brute(ROWS, 2, 3)


def test_small_tables_of_a_task(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, "text string, lang string, source string").coalesce(1)
    one = sorted(map(tuple, divergence.term_counts(docs).collect()), key=str)
    assert sorted(map(tuple, divergence.term_counts(docs, flush=3).collect()), key=str) == one


def test_empty_table(spark, tmp_path):
    assert audited(spark, [], tmp_path) == []


def test_pairs_of_sorted_lists():
    draw = np.random.default_rng(5)
    for _ in range(200):
        one, two = (np.unique(draw.integers(0, 4000, draw.integers(0, n))) for n in (1500, 300))
        left, right = divergence.gallop(one, two)
        assert one[left].tolist() == two[right].tolist() == sorted({*one} & {*two})
    for ids1, ids2 in (([], []), ([1], []), ([], [3]), ([1, 2], [2, 5])):
        n1, n2 = dict(zip(ids1, (4, 7))), dict(zip(ids2, (1, 9)))
        total1, total2 = sum(n1.values()), sum(n2.values())
        p = [divergence.price(n1.get(t, 0), total1, 6) for t in range(6)]
        q = [divergence.price(n2.get(t, 0), total2, 6) for t in range(6)]
        arrays = [np.array(x, dtype=np.int64) for x in (ids1, [*n1.values()], ids2, [*n2.values()])]
        found = divergence.pair_sum(*arrays[:2], total1, *arrays[2:], total2, 6, 6)
        assert found == sum((a - b) ** 2 // (a + b) for a, b in zip(p, q))


def test_price_is_exact():
    for count, total, kept in ((0, 0, 1), (5, 17, 3), (10**13, 10**13 + 9, 10**6), (9, 10**14, 7)):
        assert divergence.price(count, total, kept) == 1 + 10**9 * (count + 2) // (total + 2 * kept)


def test_price_of_columns(spark):
    rows = [(0, 0, 1), (5, 17, 3), (10**13, 10**13 + 9, 10**6), (9, 10**14, 7)]
    frame = spark.createDataFrame(rows, "a long, b long, c long")
    made = frame.select("*", divergence._price(frame.a, frame.b, frame.c).alias("p")).collect()
    assert [r.p for r in made] == [divergence.price(r.a, r.b, r.c) for r in made]


def test_rows_of_tasks_are_added_up_after_the_exchange_only(spark):
    docs = spark.createDataFrame(ROWS, "text string, lang string, source string")
    plan = divergence.term_counts(docs)._jdf.queryExecution().executedPlan().toString()
    above, below = plan.split("Exchange hashpartitioning", 1)
    assert "HashAggregate" in above and "MapInArrow" in below
    assert "Aggregate" not in below


def test_counts_of_a_task_stay_with_their_terms():
    texts = ["b a a", None, "c b ; b", "", "a"]
    arrays = [["x", "x", "y", "z", "x"], ["p", "p", "p", "q", "p"]]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(a, pa.string()) for a in (texts, *arrays)], ["text", "lang", "source"]
    )
    (sent,) = divergence._counts(100)(iter([batch]))
    rows = sorted(map(tuple, (r.values() for r in sent.to_pylist())), key=str)
    assert rows == sorted(
        [("x", "p", None, 0, 0), ("x", "p", "b", 1, 1), ("x", "p", "a", 3, 2)]
        + [("y", "p", None, 0, 0), ("y", "p", "c", 1, 1), ("y", "p", "b", 2, 1)]
        + [("z", "q", None, 0, 0)],
        key=str,
    )
