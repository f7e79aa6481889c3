from pathlib import Path

import pytest

import corpus_pipeline
import messy
import test_decontaminate
import test_jaccard
from oddwire.llm import pieces

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


def test_order_and_columns(spark):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == [
        "quality classifier",
        "exact dedup",
        "n-gram jaccard join",
        "benchmark decontamination",
        "sentence pieces",
    ]


def test_stages_like_brute_force(spark, tmp_path):
    """Each stage against a plain version on what the stage before it kept."""
    stages = dict(corpus_pipeline.STAGES)
    whole = spark.read.parquet(f"{SF_DIR}/documents.parquet")

    def after(name, docs):
        path = str(tmp_path / name.replace(" ", "-"))
        stages[name](spark, docs, SF_DIR).write.parquet(path)
        return spark.read.parquet(path)

    good = after("quality classifier", whole)
    assert good.columns == whole.columns
    labels = {
        r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()
    }
    kept = {r.doc_id for r in good.collect()}
    assert all(d in kept for d, q in labels.items() if q == 1)
    assert sum(d not in kept for d, q in labels.items() if q == 0) > 0

    single = after("exact dedup", good)
    best = {}
    for r in good.collect():
        key = b"".join(messy.words(r.text))
        rank = (-len(r.text or ""), r.doc_id)
        best[key] = min(best.get(key, (rank, r.doc_id)), (rank, r.doc_id))
    assert {r.doc_id for r in single.collect()} == {d for _, d in best.values()}

    unlike = after("n-gram jaccard join", single)
    rows = [(r.doc_id, r.text) for r in single.collect()]
    wanted = {c if n else d for d, n, c in test_jaccard.brute(rows)}
    assert {r.doc_id for r in unlike.collect()} == wanted

    clean = after("benchmark decontamination", unlike)
    items = [messy.words(r.text, True) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    dropped = set()
    for r in unlike.collect():
        text = messy.words(r.text, True)
        runs = {tuple(text[i : i + 5]) for i in range(len(text) - 4)}
        for item in items:
            covered = set()
            for i in range(len(item) - 4):
                if tuple(item[i : i + 5]) in runs:
                    covered.update(range(i, i + 5))
            if item and len(covered) >= 0.6 * len(item):
                dropped.add(r.doc_id)
    assert {r.doc_id for r in clean.collect()} == wanted - dropped and dropped

    last = after("sentence pieces", clean)
    texts = {r.doc_id: r.text for r in clean.collect()}
    encoder = pieces.encoder(pieces.MODEL, pieces.N_BEST)
    for r in last.collect():
        scores, ids = encoder.encode(texts[r.doc_id] or "")
        assert pieces.packed(r.ids) == ids[0] and r.restored
        assert r.scores == pytest.approx(scores)
    assert last.count() == clean.count() == len(texts)


def test_odd_documents_pass_all_stages(spark, tmp_path):
    rows = list(enumerate(messy.ODD)) + [(None, None), (3, "ab"), (70, test_decontaminate.ITEM)]
    docs = messy.stored(spark, rows, tmp_path)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, SF_DIR)
        if name != "sentence pieces":
            assert made.columns == docs.columns
        made.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    assert docs.count() <= len(rows)
