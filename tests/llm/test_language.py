import math
import re
from pathlib import Path

import numpy as np
import pytest

import messy
from oddwire.llm import language

SF_DIR = "/root/testdata/sf0.01"


@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")
def test_held_out_documents_and_mixtures(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    profiles = language.train(docs)
    held = docs.where(language.held_out())
    rows = language.identify(held, profiles).join(held.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.97
    texts = {r.lang: r.text for r in docs.where("n_chars > 1500").collect()}
    mixed = " ".join([texts["de"][:1200], texts["fr"][:1200]])
    row = language.identify(messy.documents(spark, [(1, mixed)]), profiles).first()
    assert set(row.languages) == {"de", "fr"} and 0.3 < row.score < 0.7
    rows = language.identify(
        messy.documents(spark, list(enumerate(messy.ODD)) + [(None, "12 !?"), (4, "é")]), profiles
    ).collect()
    unknown = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert {0, 1, 2, 3, None} == unknown
    assert all(0 <= r.score <= 1 for r in rows) and len(rows) == len(messy.ODD) + 2


def test_expectation_maximisation_climbs_to_the_mixture():
    draw = np.random.default_rng(3)
    logs = draw.normal(size=(400, 3))
    logs[:300, 0] += 6
    logs[300:, 1] += 6
    shares, size = language.detect([logs, logs[:1]])
    assert size.tolist() == [2, 1]
    assert shares[0] == pytest.approx([0.75, 0.25, 0], abs=0.05)
    likelihood = np.exp(logs - logs.max(axis=1, keepdims=True))
    share, found = language.mixtures(
        likelihood, np.array([0]), np.array([400]), np.ones((1, 3))
    )
    assert found[0] >= np.log(likelihood @ np.full(3, 1 / 3)).sum()
    assert share.sum() == pytest.approx(1)


def plain_word_logs(text, profiles):
    """Words by their 4-grams, each hashed with plain integers: the byte before a byte, itself
    and the next two, which may be those of the next word."""
    primes = language._PRIMES.tolist()
    blanks = b" \t\n\v\f\r"
    data = [32, *[32 if b in blanks else b + 32 if 65 <= b <= 90 else b for b in text.encode()], 32, 32]
    for found in re.finditer(rb"[^\x20\x09-\x0D]+", text.encode()):
        logs = [0.0] * len(profiles.languages)
        for i in range(*found.span()):
            bucket = 0
            for byte, prime in zip(data[i : i + 4], primes):
                bucket = (bucket + byte * prime) % 2**32
                bucket ^= bucket >> 15
            bucket = bucket * primes[0] % 2**32 >> 16
            for k in range(len(logs)):
                logs[k] += float(profiles.logs[bucket, k])
        yield logs


def plain_mixture(rows, allowed):
    """Expectation maximisation of one document, word by word."""
    share = {k: 1 / len(allowed) for k in allowed}
    value = -math.inf
    while True:
        new, found = dict.fromkeys(allowed, 0.0), 0.0
        for row in rows:
            total = sum(share[k] * row[k] for k in allowed)
            found += math.log(total)
            for k in allowed:
                new[k] += share[k] * row[k] / total / len(rows)
        if found - value < 1e-6:
            return share, found
        share, value = new, found


@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")
def test_like_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    profiles = language.train(docs)
    rows = [(r.doc_id, r.text) for r in docs.where("n_chars < 600").orderBy("doc_id").collect()]
    rows = rows[:100] + [(-1 - i, t) for i, t in enumerate(messy.ODD) if len(t or "") < 600]
    mixed = [r[1] for r in rows[:40]]
    rows += [(-100 - i, f"{a} {b}") for i, (a, b) in enumerate(zip(mixed[::2], mixed[1::2]))]
    got = {r.doc_id: r for r in language.identify(messy.documents(spark, rows), profiles).collect()}
    assert len(got) == len(rows)
    several = 0
    for doc_id, text in rows:
        words, row = messy.words(text), got[doc_id]
        if not any(c.isalpha() for c in text or ""):
            assert row.lang_pred == "und"
            continue
        logs = list(plain_word_logs(text, profiles))
        assert len(logs) == len(words)
        likelihood = [[math.exp(max(x - max(w), -60)) for x in w] for w in logs]
        everything = range(len(profiles.languages))
        full, _ = plain_mixture(likelihood, list(everything))
        alone = max(everything, key=lambda k: sum(math.log(w[k]) for w in likelihood))
        order = [alone, *sorted((k for k in everything if k != alone), key=lambda k: -full[k])]
        penalty = math.log(max(len(words), 2)) / 2
        tried = [plain_mixture(likelihood, order[: k + 1]) for k in everything]
        values = [value - k * penalty for k, (_, value) in enumerate(tried)]
        chosen = len(row.languages) - 1
        assert values[chosen] > max(values) - 0.1
        share, _ = tried[chosen]
        assert set(row.languages) == {profiles.languages[k] for k in order[: chosen + 1]}
        assert row.score == pytest.approx(max(share.values()), abs=0.03)
        assert share[profiles.languages.index(row.lang_pred)] > max(share.values()) - 0.06
        several += chosen > 0
    assert several >= 5


def test_slow_mixtures_reach_the_top():
    draw = np.random.default_rng(8)
    counts = np.array([3000, 40, 1])
    likelihood = np.exp(-draw.exponential(0.3, size=(counts.sum(), 4)))
    first = np.array([0, 3000, 3040])
    share, found = language.mixtures(likelihood, first, counts, np.ones((3, 4)))
    most = language.best_likelihood(likelihood, first, counts, share)
    # What is left to gain is small beside the least penalty, log(2) / 2.
    assert (most - found < 0.1).all()
    assert share.sum(axis=1) == pytest.approx(np.ones(3))


def test_no_training_rows(spark, tmp_path):
    docs = spark.createDataFrame([(1, None, "en"), (2, "abc", None)], "doc_id long, text string, lang string")
    profiles = language.train(docs)
    rows = language.identify(docs, profiles).collect()
    assert [(r.lang_pred, r.score) for r in rows] == [("und", 0.0)] * 2
    assert language.identify(docs.limit(0), profiles).count() == 0


def test_a_few_words_among_many_earn_their_language():
    logs = np.full((30_025, 3), -30.0)
    logs[:30_000, 0] = logs[30_000:, 1] = 0.0
    shares, size = language.detect([logs, logs[:30_000]])
    assert size.tolist() == [2, 1]
    assert shares[0] == pytest.approx([1 - 25 / 30_025, 25 / 30_025, 0], abs=1e-5)


def test_no_mixture_exceeds_the_bound():
    draw = np.random.default_rng(4)
    for _ in range(20):
        counts = draw.integers(1, 60, 5)
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        likelihood = np.exp(-draw.exponential(5, size=(counts.sum(), 4)))
        full, _ = language.mixtures(likelihood, first, counts, np.ones((5, 4)))
        most = language.best_likelihood(likelihood, first, counts, full)
        for share in draw.dirichlet(np.full(4, 0.3), size=50):
            found = np.add.reduceat(np.log(likelihood @ share), first)
            assert (found <= most + 1e-9).all()
