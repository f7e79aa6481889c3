from itertools import combinations
from pathlib import Path

import numpy as np
import pytest

import messy
from oddwire.llm import quality

SF_DIR = "/root/testdata/sf0.01"


def test_linear_time_margin_is_the_sum_over_pairs():
    draw = np.random.default_rng(1)
    machine = quality.Machine(0.3, draw.normal(size=50), draw.normal(size=(50, 4)))
    index, value = draw.permutation(50)[:9], draw.normal(size=9)
    pairs = sum(
        machine.factors[index[a]] @ machine.factors[index[b]] * value[a] * value[b]
        for a, b in combinations(range(9), 2)
    )
    margin, _ = machine.margins(index, value, np.zeros(1, int))
    assert margin[0] == pytest.approx(0.3 + machine.linear[index] @ value + pairs)


@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")
def test_held_out_labels_are_predicted(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    machine = quality.train(docs, labels)
    scored = quality.score(docs.select("doc_id", "text", "n_chars"), machine)
    rows = scored.join(labels, "doc_id").where(quality.held_out()).collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.9
    good = np.array([r.score for r in rows if r.quality == 1])
    poor = np.array([r.score for r in rows if r.quality == 0])
    assert (good[:, None] > poor).mean() > 0.95


def test_held_out_labels_and_other_columns_change_no_score(spark, tmp_path):
    rows = [(k, "good words here " * (k % 7 + 1) if k % 2 else "BAD!! " * (k % 5 + 1)) for k in range(80)]
    docs = messy.stored(spark, rows, tmp_path)
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)], "doc_id long, quality int")
    turned = labels.withColumn(
        "quality", (1 - labels.quality).cast("int")
    ).where(quality.held_out())
    changed = labels.where(~quality.held_out()).unionByName(turned)
    one, other = quality.train(docs, labels), quality.train(docs, changed)
    assert np.array_equal(one.factors, other.factors) and one.bias == other.bias
    assert len(quality.train(docs, labels, sample_rows=5).linear) == quality.N_FEATURES


def test_odd_texts_have_scores(spark, tmp_path):
    docs = messy.stored(spark, list(enumerate(messy.ODD)) + [(None, "a"), (1, "")], tmp_path)
    labels = spark.createDataFrame([(None, 1), (4, None), (8, 1), (8, 0)], "doc_id long, quality int")
    scored = quality.score(docs, quality.train(docs, labels))
    rows = scored.collect()
    assert len(rows) == len(messy.ODD) + 2
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    empty = messy.stored(spark, [], tmp_path / "none")
    machine = quality.train(empty, labels)
    assert quality.score(empty, machine).count() == 0
    assert machine.scores(*quality.features(np.zeros(0, np.uint8)), np.zeros(1, int)) == pytest.approx(
        0.5, abs=0.01
    )


def test_stated_length_is_an_input_with_a_bin_for_none(spark):
    text = np.frombuffer(b"some words", np.uint8)
    last = {n: quality.features(text, n)[0][-1] - quality.STATED for n in (None, 0, 10, 10**9, 2**62)}
    assert last[None] == quality.BINS and last[0] == 0 and 0 < last[10] < last[10**9] <= last[2**62]
    assert last[2**62] == quality.BINS - 1
    odd = "12", "-3", "many", None
    rows = spark.createDataFrame([(n,) for n in odd], "n_chars string")
    assert [r[0] for r in rows.select(quality.stated_length(rows)).collect()] == [12, None, None, None]
    for schema, value in (("n_chars array<int>", [1]), ("other int", 1)):
        rows = spark.createDataFrame([(value,)], schema)
        assert rows.select(quality.stated_length(rows)).first()[0] is None


def test_repeated_ids_give_the_same_machine_in_any_order(spark):
    rows = [(k % 20, f"text {k} of {k % 3}", k) for k in range(60)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, quality int")
    schema = "doc_id long, text string, n_chars int"
    one = quality.train(spark.createDataFrame(rows, schema).repartition(2), labels)
    other = quality.train(spark.createDataFrame(rows[::-1], schema).repartition(5), labels)
    assert np.array_equal(one.factors, other.factors) and np.array_equal(one.linear, other.linear)


def test_a_column_named_like_the_length_stays(spark):
    docs = spark.createDataFrame([(1, "a b", "mine", "x")], "doc_id long, text string, stated string, n_chars string")
    scored = quality.score(docs, quality.fit([], np.zeros(0, np.float32)))
    assert scored.columns == [*docs.columns, "score", "predicted"] and scored.first().stated == "mine"
