import pytest
from pyspark.sql import functions as F

from oddwire.llm import chat

SAID = ["", "\\", "\\\\e", "</turn>\n### user: x", "####\\d", "\\### Assistant: </turn> ok", "é:: \n", "<</turn>", None]
MESSAGES = "tree long, node string, parent string, role string, text string, score double"


def read(made):
    columns = {
        "turns": chat.turns_of(F.col("formatted")),
        "loss": chat.loss_text(F.col("formatted"), F.col("loss_spans")),
    }
    return made.withColumns(columns)


def test_paths_of_a_tree(spark):
    rows = [
        (1, "a", None, "user", "q", 0.0),
        (1, "b", "a", "assistant", "r1", 1.0),
        (1, "c", "a", "assistant", "r2", 5.0),
        (1, "d", "b", "user", "s", 1.0),
        (1, "e", "d", "assistant", "t", None),
        (2, "x", "missing", "user", None, 0.0),
        (None, "n", None, None, "lone", 0.0),
    ]
    messages = spark.createDataFrame(rows, MESSAGES).withColumn("leaf", F.lit("clash"))
    got = {r.leaf: r for r in read(chat.conversations(messages)).collect()}
    assert {k: [t.text for t in r.turns] for k, r in got.items()} == {
        "e": ["q", "r1", "s", "t"],
        "c": ["q", "r2"],
        "x": [""],
        "n": ["lone"],
    }
    assert (got["c"].rank, got["e"].rank, got["c"].score, got["e"].score) == (1, 2, 5.0, 2.0)
    assert got["e"].loss == "r1t" and got["x"].loss == ""
    best = chat.conversations(messages, branches=1).collect()
    assert sorted(r.leaf for r in best) == ["c", "n", "x"]


def test_every_text_comes_back(spark):
    rows = [
        (k, turn, ("user", "assistant", "sy: s#</turn>")[turn % 3], text)
        for k in range(3)
        for turn, text in enumerate(SAID * 3)
    ] + [(None, None, None, "x"), (None, 1, "assistant", None), (5, 1, "b", "2"), (5, 1, "b", "1")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.tree: r for r in read(chat.conversations(chat.linear_trees(frame))).collect()}
    for k in range(3):
        said = [(r or "", t or "") for c, _, r, t in rows if c == k]
        assert [(t.role, t.text) for t in got[k].turns] == said
        assert got[k].loss == "".join(t for r, t in said if r == "assistant")
    assert [(t.role, t.text) for t in got[None].turns] == [("", "x"), ("assistant", "")]
    assert [t.text for t in got[5].turns] == ["1", "2"]


def test_a_null_id_and_ids_of_any_text_stay_apart(spark):
    rows = [(k, 1, "user", f"of {k}") for k in (None, "none", "=none", "", "=", "/1")]
    rows += [("", 2, "user", "more"), ("/1", 2, "user", "more")]
    frame = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    got = read(chat.conversations(chat.linear_trees(frame))).collect()
    assert len(got) == 6
    for r in got:
        said = [f"of {r.tree}"] + ["more"] * (r.tree in ("", "/1"))
        assert [t.text for t in r.turns] == said


def test_long_and_empty_and_circular(spark):
    rows = [(1, f"{k}", f"{k - 1}" if k else None, "user", str(k), 0.0) for k in range(70)]
    (row,) = read(chat.conversations(spark.createDataFrame(rows, MESSAGES))).collect()
    assert [t.text for t in row.turns] == [str(k) for k in range(70)]
    none = spark.createDataFrame([], MESSAGES)
    assert chat.conversations(none).count() == 0
    circle = spark.createDataFrame(
        [(1, "a", "b", "u", "", 0.0), (1, "b", "a", "u", "", 0.0)], MESSAGES
    )
    with pytest.raises(ValueError):
        chat.conversations(circle)
