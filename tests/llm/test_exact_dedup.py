import hashlib
import random
import re
from collections import defaultdict

import messy
from oddwire.llm import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for k, (doc_id, text) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((doc_id, text or "", k))
    result = []
    for norm, members in groups.items():
        best = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        sha = hashlib.sha256(norm.encode()).hexdigest()
        result += [(m[0], best[0], len(members), sha) for m in members]
    return sorted(result, key=str)


def found(frame):
    rows = frame.collect()
    plain = [(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows]
    return sorted(plain, key=str), rows


def test_odd_texts_ties_and_repeated_rows(spark, tmp_path):
    rows = list(enumerate(messy.ODD)) + [(None, "ab"), (3, "ab"), (3, "ab"), (None, None)]
    docs = messy.stored(spark, rows, tmp_path)
    got, raw = found(exact_dedup.exact_dedup(docs))
    assert got == brute(rows)
    assert sum(r.kept for r in raw) == len({r.text_sha256 for r in raw})
    left = exact_dedup.distinct_documents(docs)
    assert left.columns == docs.columns
    assert left.count() == sum(r.kept for r in raw)


def test_buckets_are_partitioned_until_they_fit(spark, tmp_path):
    draw = random.Random(3)
    texts = ["".join(draw.choices("abc ", k=200)) for _ in range(150)]
    rows = [(k, draw.choice(texts) + " " * draw.randrange(3)) for k in range(400)]
    docs = messy.stored(spark, rows, tmp_path)
    got, _ = found(exact_dedup.exact_dedup(docs, bucket_bytes=400, fan_out=2))
    assert got == brute(rows)


def test_unlike_contents_of_one_hash_stay_apart():
    table = exact_dedup.ContentTable()
    assert table.owner(5, b"a", 1) == 1
    assert table.owner(5, b"b", 2) == 2
    assert table.owner(5, b"a", 3) == 1
    for k in range(3000):
        assert table.owner(k * 1024, b"%d" % k, k) == k
    assert table.owner(5, b"b", 9) == 2


def test_empty_table(spark, tmp_path):
    assert exact_dedup.exact_dedup(messy.stored(spark, [], tmp_path)).count() == 0
