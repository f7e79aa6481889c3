"""Row keys and word hashes must not follow how a table happens to be read."""

import re

import numpy as np
import pytest

import messy
from oddwire.llm import exact_dedup, jaccard, shared, substrings, words
from oddwire.llm.members import without
from oddwire.llm.shared import stored, with_row_key

SPLITS = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def splits(spark):
    """Sets how small the splits of a scan are."""
    yield lambda size: spark.conf.set(SPLITS, size)
    spark.conf.unset(SPLITS)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def many_files(spark, tmp_path, rows, files=9):
    path = str(tmp_path / "documents.parquet")
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(files, "doc_id")
    frame.write.option("parquet.block.size", 2048).parquet(path)
    return spark.read.parquet(path)


def passages(count):
    base = " ".join(f"w{k}" for k in range(60))
    return [(k, f"{base} {k}" if k % 3 == 0 else " ".join(f"{k}x{j}" for j in range(60))) for k in range(count)]


def test_keys_stay_when_splits_change(spark, tmp_path, splits):
    docs = many_files(spark, tmp_path, passages(300))
    splits("128m")
    keyed = with_row_key(docs, ["doc_id"])
    parts, before = keyed.rdd.getNumPartitions(), {r.row_key: r.doc_id for r in keyed.collect()}
    splits("3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    again = spark.read.parquet(docs.inputFiles()[0].rsplit("/", 1)[0])
    keyed = with_row_key(again, ["doc_id"])
    assert keyed.rdd.getNumPartitions() != parts
    after = {r.row_key: r.doc_id for r in keyed.collect()}
    assert before == after and len(before) == 300 and min(before) >= 0


def test_without_after_splits_change(spark, tmp_path, splits):
    docs = many_files(spark, tmp_path, passages(300))
    dropped = with_row_key(docs, ["doc_id"]).where("doc_id % 4 = 1").select("row_key")
    dropped = spark.createDataFrame(dropped.collect(), "row_key long")
    splits("3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    kept = without(docs, dropped)
    assert {r.doc_id for r in kept.collect()} == {k for k in range(300) if k % 4 != 1}


def test_operators_while_splits_change(spark, tmp_path, splits, monkeypatch):
    """Splits change each time an operator writes a table."""
    rows = passages(120) + [(500 + k, f"w{k} same words") for k in (1, 1, 2)]
    docs = many_files(spark, tmp_path, rows)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")

    def run():
        repeats = substrings.remove_repeats(docs).select("doc_id", "n_removed").collect()
        classes = jaccard.similarity_classes(docs).select("doc_id", "component_id").collect()
        distinct = [r.doc_id for r in exact_dedup.distinct_documents(docs).collect()]
        unlike = [r.doc_id for r in jaccard.one_of_each_class(docs).collect()]
        return sorted(repeats), sorted(classes), sorted(distinct), sorted(unlike)

    wanted = run()
    sizes = iter(["3000", "128m", "9000", "1m"] * 1000)
    for module in (substrings, jaccard, exact_dedup):
        def changed(table, name, plain=module.written):
            made = plain(table, name)
            splits(next(sizes))
            return made

        monkeypatch.setattr(module, "written", changed)
    assert run() == wanted


def test_rows_that_are_not_stored_are_written(spark):
    frame = spark.createDataFrame(passages(20), "doc_id long, text string")
    assert len(stored(frame).inputFiles()) > 0
    named = frame.withColumnRenamed("text", "_metadata")
    assert with_row_key(stored(named), ["doc_id"]).count() == 20
    assert with_row_key(stored(frame.limit(0)), ["doc_id"]).count() == 0


def plain_spans(data):
    return [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]


@pytest.mark.parametrize("chunk", [7, 64, 1 << 18])
def test_spans_and_hashes_in_chunks(monkeypatch, chunk):
    draw = np.random.default_rng(chunk)
    texts = [draw.choice(np.frombuffer(b"ab \n", np.uint8), n) for n in (0, 1, 6, 7, 8, 200, 1000)]
    texts += [np.frombuffer(b"x" * 50 + b" " + b"y" * 90, np.uint8), np.frombuffer(b" " * 30, np.uint8)]
    whole = [(s := words.spans(t), words.hashes(t, *s), words.runs(words.hashes(t, *s), 5)) for t in texts]
    monkeypatch.setattr(words, "CHUNK", chunk)
    monkeypatch.setattr(words, "_OF_BYTES", words.Powers(words._BASE[0]))
    monkeypatch.setattr(words, "_OF_WORDS", (words.Powers(words._BASE[1]), words.Powers(words._BASE[2])))
    for text, (spans, hashes, runs) in zip(texts, whole):
        made = words.spans(text)
        assert list(zip(*made)) == plain_spans(text.tobytes())
        assert words.hashes(text, *made).tolist() == hashes.tolist()
        assert words.runs(hashes, 5).tolist() == runs.tolist()


def test_equal_words_at_other_places_have_equal_hashes():
    long = b"z" * 600_000
    text = np.frombuffer(b"a " + long + b" bb " + long, np.uint8)
    hashes = words.hashes(text, *words.spans(text))
    assert hashes[1] == hashes[3] and len(set(hashes.tolist())) == 3


def test_memory_of_a_very_long_text():
    """Tables of powers and the space of a hash do not grow with the text."""
    import tracemalloc

    text = np.frombuffer(b"word " * 4_000_000, np.uint8)
    assert len(words._OF_BYTES.up) == words.CHUNK + 1
    tracemalloc.start()
    starts, ends = words.spans(text)
    base = tracemalloc.get_traced_memory()[1]
    words.hashes(text, starts, ends)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert base < 200e6 and peak < 320e6


def test_what_a_worker_keeps_goes_when_another_operator_begins():
    freed = []
    words.keep("a", lambda: freed.append("a"))
    words.keep("a", lambda: freed.append("last a"))
    words.keep("b", lambda: freed.append("b"))
    assert list(words.slices(iter([]))) == [] and freed == ["last a", "b"]
    words.let_go()
    assert freed == ["last a", "b"]


def test_batches_are_small_unless_the_session_says_otherwise(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    session = spark.newSession()
    shared.small_batches(session)
    assert session.conf.get(name) == "4194304b"
    session.conf.set(name, "9m")
    shared.small_batches(session)
    assert session.conf.get(name) == "9m"
