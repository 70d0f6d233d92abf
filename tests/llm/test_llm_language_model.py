import math
import random
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from cases import TEXTS, clashing, documents
from gablework.llm.language_model import (
    END,
    LOWER,
    Corpus,
    Network,
    Shape,
    Trainer,
    first_weights,
    language_model,
    op13_language_model,
    views,
)
from pyspark.sql import functions as F

SMALL = Shape(classes=4, class_words=5, inner=6, embedding=5, window=7, scored_window=9, least_lanes=2, most_lanes=3, scored_lanes=4, rounds=2, replica_tokens=300, pool_words=200, least_count=3)


def words_of(text):
    return (text or "").encode().translate(LOWER).split()


def weights(shape, seed=3):
    draw = np.random.default_rng(seed)
    return (first_weights(shape, np.arange(shape.places) % 7) + draw.normal(size=len(first_weights(shape, np.ones(shape.places)))) * 0.3).astype(np.float32)


def plain_score(shape, flat, words):
    """One document, one step after the other, in double precision."""
    w = {n: v.astype(float) for n, v in views(shape, flat).items()}
    h, last, total = np.zeros(shape.inner), END, 0.0
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for word in [*words, END]:
        x, g = w["embed"][last] @ w["in_w"] + w["in_b"], h @ w["state_w"]
        k = shape.inner
        update, reset = sigmoid(x[:k] + g[:k]), sigmoid(x[k : 2 * k] + g[k : 2 * k])
        new = np.tanh(x[2 * k :] + reset * g[2 * k :])
        h = (1 - update) * new + update * h
        kinds = h @ w["class_w"] + w["class_b"]
        inside = h @ w["word_w"][word // shape.class_words] + w["word_b"][word // shape.class_words]
        total += kinds[word // shape.class_words] - np.log(np.exp(kinds).sum())
        total += inside[word % shape.class_words] - np.log(np.exp(inside).sum())
        last = word
    return total


def test_batched_scores_match_single_steps():
    draw = np.random.default_rng(1)
    docs = [draw.integers(0, SMALL.places, n) for n in (0, 1, 40, 7, 8, 0, 23, 100)]
    flat = weights(SMALL)
    found = Network(SMALL, flat).score(np.concatenate(docs), np.array([len(d) for d in docs]))
    assert np.allclose(found, [plain_score(SMALL, flat, d.tolist()) for d in docs], rtol=1e-4)


def test_probabilities_of_the_next_word_sum_to_one():
    flat = weights(SMALL)
    net = Network(SMALL, flat)
    states = np.random.default_rng(2).normal(size=(1, SMALL.inner)).astype(np.float32)
    logp, _ = net.output(np.repeat(states, SMALL.places, 0), np.arange(SMALL.places))
    assert math.isclose(float(np.exp(logp.astype(float)).sum()), 1.0, rel_tol=1e-5)


def test_large_logits_stay_exact():
    """Beyond the range of exponentials in single precision, log-probabilities and gradients are still right."""
    flat = weights(SMALL)
    views(SMALL, flat)["class_w"][:] *= 300
    views(SMALL, flat)["word_w"][:] *= 300
    net, draw = Network(SMALL, flat), np.random.default_rng(6)
    states, targets = draw.normal(size=(30, SMALL.inner)).astype(np.float32), draw.integers(0, SMALL.places, 30)
    grads = views(SMALL, np.zeros_like(flat))
    logp, back = net.output(states, targets, grads)
    w = {n: v.astype(float) for n, v in views(SMALL, flat).items()}
    for state, target, found in zip(states.astype(float), targets, logp):
        kind, word = divmod(int(target), SMALL.class_words)
        kinds, inside = state @ w["class_w"] + w["class_b"], state @ w["word_w"][kind] + w["word_b"][kind]
        exact = kinds[kind] - np.logaddexp.reduce(kinds) + inside[word] - np.logaddexp.reduce(inside)
        assert np.isclose(found, exact, rtol=1e-4, atol=1e-3)
    assert np.isfinite(back).all() and all(np.isfinite(g).all() for g in grads.values())


def test_gradients_match_differences():
    shape = Shape(classes=3, class_words=4, inner=5, embedding=4, window=50, least_lanes=2, most_lanes=2)
    ids, lengths = np.random.default_rng(4).integers(0, shape.places, 24), np.array([9, 3, 12])
    flat = weights(shape)
    trainer = Trainer(shape, flat, np.ones_like(flat))
    kept = {}
    trainer.step = lambda tokens: kept.setdefault("grad", trainer.grad.copy())
    trainer.learn(ids, lengths)
    total = lambda f: Network(shape, f).score(ids, lengths).sum()
    for at in np.random.default_rng(5).choice(len(flat), 60, replace=False):
        up, down = flat.copy(), flat.copy()
        up[at] += 1e-2
        down[at] -= 1e-2
        assert abs((total(up) - total(down)) / 2e-2 + kept["grad"][at]) < 2e-2 * max(1.0, abs(kept["grad"][at]))


def test_first_weights_give_the_base():
    corpus = Corpus(100, 20, 10, [(b"a", 30), (b"b", 20)])
    net = Network(SMALL, first_weights(SMALL, corpus.place_counts(SMALL)))
    logp, _ = net.output(np.zeros((4, SMALL.inner), dtype=np.float32), np.array([0, 1, 5, 6]))
    assert np.allclose(np.exp(logp), np.array([11, 58, 31, 21]) / 121, rtol=1e-5)


def plain_counts(rows, held):
    words = Counter(w for (i, t) in rows if not held(i) for w in words_of(t))
    ends = sum(not held(i) for i, _ in rows)
    tokens, distinct = sum(words.values()) + ends, len(words) + (ends > 0)
    out = []
    for i, text in rows:
        counts = [*(words[w] for w in words_of(text)), ends]
        base = sum(math.log10((c + 1) / (tokens + distinct + 1)) for c in counts)
        out.append((i, held(i), len(counts), sum(c > 0 for c in counts), tokens, base))
    return out, words, ends


def is_held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def held_column():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2


def same_base(found, expected):
    left = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in found), key=repr)
    right = sorted(expected, key=repr)
    assert [r[:5] for r in left] == [r[:5] for r in right]
    assert np.allclose([r[5] for r in left], [r[5] for r in right], rtol=1e-9)


@pytest.mark.parametrize("block_bytes", [300, 4 << 20])
def test_rows_match_plain_python(spark, block_bytes):
    draw = random.Random(2)
    letters = ["River", "sea", "\troad\n", "the", "a b", "\x85", "ÄÖ", "\x0b", "word"]
    rows = [(i, " ".join(draw.choice(letters) for _ in range(draw.randint(0, 30)))) for i in range(120)] + TEXTS
    made = language_model(clashing(documents(spark, rows)), held_column(), shape=SMALL, block_bytes=block_bytes)
    expected, words, ends = plain_counts(rows, is_held)
    found = made.documents.collect()
    same_base(found, expected)
    # Scores: every word by the weights that were learned, unknown ones with their share of the rest.
    vocabulary = sorted(((-n, w) for w, n in words.items() if len(w) <= 64 and n >= 3))[: SMALL.most_words]
    assert made.corpus.vocabulary == [(w, -n) for n, w in vocabulary]
    place = {w: k for k, (_, w) in enumerate(vocabulary, SMALL.class_words)}
    rest = sum(n for w, n in words.items() if w not in place) + sum(w not in place for w in words) + 1
    scores = []
    for i, text in rows:
        if len(text or "") < 5000:
            score = plain_score(SMALL, made.weights, [place.get(w, 1) for w in words_of(text)]) / math.log(10)
            scores.append((repr(i), round(len(words_of(text))), score + sum(math.log10((words[w] + 1) / rest) for w in words_of(text) if w not in place)))
    left = sorted((repr(r.doc_id), r.n_tokens - 1, r.score) for r in found if r.n_tokens < 1000)
    assert np.allclose([r[2] for r in left], [r[2] for r in sorted(scores)], rtol=1e-4)


def test_training_beats_the_base_on_held_out_documents(spark):
    rows = op13_language_model(spark, "/root/testdata/sf0.01").collect()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    same_base(rows, plain_counts([(r.doc_id, r.text) for r in docs], is_held)[0])
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score < 0 for r in rows)


def test_the_same_rows_give_the_same_scores(spark):
    rows = [(i, f"one text number {i % 11} of a few words") for i in range(90)]
    first, again = ({r.doc_id: r.score for r in language_model(documents(spark, rows), held_column(), shape=SMALL, block_bytes=400).documents.collect()} for _ in range(2))
    assert first == again


def test_no_training_documents(spark):
    made = language_model(documents(spark, [(1, "a b"), (2, None)]), F.lit(True), shape=SMALL)
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in made.documents.collect()) == [(1, 3, 0, 0, 0.0), (2, 1, 0, 0, 0.0)]


def test_empty_table(spark):
    assert language_model(documents(spark).limit(0), held_column(), shape=SMALL).documents.count() == 0


def test_shares_outside_the_vocabulary():
    assert Corpus(100, 20, 10, [(b"a", 30), (b"b", 20)]).outside == (40, 17)
