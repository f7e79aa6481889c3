from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
import messy
from oddwire.llm import pieces
from oddwire.llm.queries import QUERIES

pytestmark = pytest.mark.skipif(not Path(pieces.MODEL).exists(), reason="no vocabulary")


def every_path(vocabulary, word):
    found = []

    def walk(at, score, ids):
        if at == len(word):
            found.append((score, tuple(ids)))
            return
        for end, more, own in vocabulary.arcs(word, at):
            walk(end, score + more, ids + list(own))

    walk(0, 0.0, [])
    return sorted(found, key=lambda f: -f[0])


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab the.▁ü\n€", max_size=9))
def test_n_best_like_enumeration(text):
    encoder = pieces.encoder(pieces.MODEL, 4)
    scores, ids = encoder.encode(text)
    assert encoder.vocabulary.decode(pieces._id_lists(ids)) == [text] * len(ids)
    if text:
        wanted = every_path(encoder.vocabulary, " " + text)[:4]
        assert scores == pytest.approx([s for s, _ in wanted])
        assert len(set(ids)) == len(scores)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_any_text_comes_back(text):
    encoder = pieces.encoder(pieces.MODEL, 2)
    _, ids = encoder.encode(text, every=False)
    assert encoder.vocabulary.decode(pieces._id_lists(ids)) == [text]


def test_forward_scores_and_gaps():
    vocabulary = pieces.encoder(pieces.MODEL, 4).vocabulary
    for word in (" another", "  x", " aü€", " thththe"):
        paths = every_path(vocabulary, word)
        ids, best, gap = vocabulary.forward(word)
        assert best == pytest.approx(paths[0][0])
        assert gap == pytest.approx(paths[0][0] - paths[1][0])
        assert vocabulary.n_best(word, 1)[0][0] == pytest.approx(best)


def test_odd_documents(spark, tmp_path):
    rows = list(enumerate(messy.ODD)) + [(None, "▁ a\u0000b"), (1, "")]
    docs = messy.stored(spark, rows, tmp_path)
    got = pieces.decode(pieces.encode(docs, all_ids=True)).collect()
    assert len(got) == len(rows)
    assert all(r.decoded == (r.text or "") for r in got)
    assert all(r.alternatives[0] == r.ids and r.scores == sorted(r.scores)[::-1] for r in got)
    checked = pieces.encode(docs, verify=True).collect()
    assert all(r.restored for r in checked) and len(checked) == len(rows)
    assert pieces.encode(docs.limit(0), verify=True).count() == 0


def test_query_and_stage_return_every_segmentation(spark, tmp_path):
    rows = list(enumerate(messy.ODD)) + [(90, "another word, then the end.")]
    docs = messy.stored(spark, rows, tmp_path)
    stage = dict(corpus_pipeline.STAGES)["sentence pieces"]
    encoder = pieces.encoder(pieces.MODEL, pieces.N_BEST)
    texts = dict(rows)
    for made in (QUERIES["op8_sentence_pieces"](spark, str(tmp_path)), stage(spark, docs, "")):
        got = made.collect()
        assert len(got) == len(rows)
        for r in got:
            scores, ids = encoder.encode(texts[r.doc_id] or "")
            assert [pieces.packed(i) for i in r.alternatives] == ids and r.scores == scores
            decoded = encoder.vocabulary.decode(pieces._id_lists(ids))
            assert set(decoded) == {texts[r.doc_id] or ""} and r.restored
        assert max(len(r.alternatives) for r in got) == pieces.N_BEST


def test_one_wrong_alternative_is_not_restored():
    encoder = pieces.encoder(pieces.MODEL, 3)
    texts = ["another", "", "third one"]
    ids = [encoder.encode(t)[1] for t in texts]
    counts = [len(i) for i in ids]
    right = pieces._id_lists([i for own in ids for i in own])
    data = [t.encode() for t in texts]
    assert encoder.vocabulary.restored(right, counts, data) == [True] * 3
    ids[0][1] = ids[0][1][:-4]
    wrong = pieces._id_lists([i for own in ids for i in own])
    assert encoder.vocabulary.restored(wrong, counts, data) == [False, True, True]


def test_words_together_like_one_by_one():
    """Pieces, bytes, lone surrogates and long words; the packed ids, scores and gaps are equal."""
    encoder = pieces.Encoder(pieces.Vocabulary(pieces.MODEL), 3, 500)
    vocabulary = encoder.vocabulary
    cut = [" another", " th€", "  x", "\n", "a", "\U0001f600" * 5, " \ud800x", "กข", "e" * 64]
    cut += [f" {a}{b}tion" for a in "the an" for b in ("", "ü", "ou", "\x7f", "ࠀ")]
    assert vocabulary.forward_together(cut) == [vocabulary.forward(word) for word in cut]
    assert vocabulary.forward_together([" a"]) == [vocabulary.forward(" a")]


def test_new_words_of_a_group_are_learnt_together(monkeypatch):
    encoder = pieces.Encoder(pieces.Vocabulary(pieces.MODEL), 3, 200)
    texts = [" ".join(f"wo{k}rd{j}" for k in range(40)) for j in range(12)]
    wanted = [pieces.Encoder(encoder.vocabulary, 3, 10_000).encode(text) for text in texts]
    one_by_one = []
    forward = pieces.Vocabulary.forward
    monkeypatch.setattr(
        pieces.Vocabulary, "forward", lambda self, w: one_by_one.append(w) or forward(self, w)
    )
    got = []
    for some in pieces._groups([text.encode() for text in texts], 1000):
        cuts = [encoder.cut(text.decode()) for text in some]
        encoder.learn(cuts)
        got += map(encoder.encode_words, cuts)
    assert got == wanted
    assert not one_by_one
    sizes = [[len(t) for t in g] for g in pieces._groups([b"a" * 5, b"", b"b" * 9, b"c"], 6)]
    assert sizes == [[5, 0], [9], [1]]
