"""The two networks: gradients against differences, held-out accuracy, awkward tables."""

import random

import numpy as np
import pyarrow as pa
import pytest
from fixtures import awkward_texts, frame, sentence

from claimgrid.llm import byte_cnn, toxic_gru
from claimgrid.llm.common import bucket_of_id


def numeric(loss, array, index, step):
    keep = array[index]
    array[index] = keep + step
    up = loss()
    array[index] = keep - step
    down = loss()
    array[index] = keep
    return (up - down) / (2 * step)


def entropy(p, y):
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return -(y * np.log(p) + (1 - y) * np.log(1 - p))


def test_byte_cnn_gradients():
    r = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in byte_cnn.initial(1).items()}
    texts = ["".join(map(chr, r.integers(97, 105, n))) for n in (900, 30, 2000)]
    data, offsets = byte_cnn.utf8(pa.array(texts))
    chunks, row = byte_cnn.chunked(data, offsets)
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        p = np.maximum(byte_cnn.convolved(w, chunks).max(1) + w["bias"], 0)
        return entropy(byte_cnn.combined(w, p, row, 3)[1], y).mean()

    grads = byte_cnn.gradients(w, chunks, row, y)
    for name, index in [("out", (3,)), ("shift", (0,)), ("bias", (2,)), ("kernel", (0, 5, 2)), ("kernel", (7, 3, 7)), ("embed", (100, 3))]:
        assert numeric(loss, w[name], index, 1e-6) == pytest.approx(grads[name][index], rel=1e-3, abs=1e-6)


def test_byte_cnn_against_a_loop_over_bytes():
    """Chunks, filters at every byte, pooling and the probability, worked out one byte at a time."""
    r = np.random.default_rng(3)
    w = byte_cnn.initial(4)
    texts = ["", "a", "short one", "x" * 512, "y" * 513, *("".join(map(chr, r.integers(32, 300, n))) for n in (7, 8, 300, 449, 900, 1500))]
    got = byte_cnn.scores(w, pa.array([*texts, None]))
    for text, score in zip([*texts, ""], got, strict=True):
        raw, chunks, at = list(text.encode()), [], 0
        while True:
            chunk = raw[at : at + byte_cnn.CHUNK]
            chunks.append(chunk + [byte_cnn.PAD] * (byte_cnn.CHUNK - len(chunk)))
            if at + byte_cnn.CHUNK >= len(raw):
                break
            at += byte_cnn.STEP
        best = []
        for chunk in chunks:
            top = np.full(byte_cnn.FILTERS, -np.inf)
            for place in range(byte_cnn.CHUNK - byte_cnn.SPAN + 1):
                hit = sum(w["embed"][chunk[place + k]] @ w["kernel"][k] for k in range(byte_cnn.SPAN))
                top = np.maximum(top, hit)
            best.append(np.maximum(top + w["bias"], 0))
        z = np.concatenate([np.max(best, 0), np.mean(best, 0)])
        assert score == pytest.approx(1 / (1 + np.exp(-(z @ w["out"] + w["shift"][0]))), abs=1e-5)


def test_filters_see_every_alignment():
    """A text inside one chunk reaches the same activations wherever it stands."""
    w = byte_cnn.initial(5)
    texts = [" " * n + "one strange passage here" + " " * (40 - n) for n in range(9, 20)]
    assert np.ptp(byte_cnn.scores(w, pa.array(texts))) < 1e-6


def test_gru_gradients():
    r = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in toxic_gru.initial(2).items()}
    x = r.normal(size=(30, toxic_gru.INPUT))
    x[0] = 0
    windows = r.integers(1, 30, (5, toxic_gru.WINDOW))
    windows[1, 9:] = 0
    y, weight = np.array([1, 0, 1, 0, 1.0]), np.array([1, 2, 1, 1, 3.0])

    def loss():
        p = toxic_gru.sigmoid(toxic_gru.forward(w, x, windows)[0])
        return (entropy(p, y) * weight).sum() / weight.sum()

    grads = toxic_gru.gradients(w, x, windows, y, weight)
    for name, index in [("out", (3,)), ("shift", (0,)), ("attend", (5,)), ("in_f", (1, 4)), ("in_b", (2, 25)), ("rec_f", (3, 11)), ("rec_b", (0, 28)), ("bias_b", (6,))]:
        # States are kept in single precision.
        assert numeric(loss, w[name], index, 1e-3) == pytest.approx(grads[name][index], rel=5e-2, abs=1e-4)


def test_chunks_and_windows_cover_everything():
    texts = ["a" * 3000, "", "b" * 512, "c" * 513, "d"]
    chunks, row = byte_cnn.chunked(*byte_cnn.utf8(pa.array(texts)))
    for n, t in enumerate(texts):
        own = chunks[row == n]
        covered = byte_cnn.CHUNK + byte_cnn.STEP * (len(own) - 1)
        assert covered >= len(t) and (own != byte_cnn.PAD).sum() >= len(t)
    words = toxic_gru.Words(*toxic_gru.utf8(pa.array(["w " * 300, "", "x y"])))
    assert [(words.row == n).sum() for n in range(3)] == [-(-(300 - 8) // 56), 1, 1]
    assert (words.windows[words.row == 0] > 0).sum() >= 300


def labelled(n=260):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        text = sentence(r, r.randrange(20, 200))
        if bad:
            words = text.split()
            for _ in range(1 + len(words) // 25):
                words.insert(r.randrange(len(words)), "gribble" + r.choice("abcdefgh") + "x")
            text = " ".join(words)
        rows.append((i, text, "s"))
        labels.append((i, int(bad), int(bad), "x"))
    return rows, labels


@pytest.mark.parametrize("which", ["quality", "toxic"])
def test_learns_and_holds_out(spark, which):
    rows, labels = labelled()
    rows += [(None if i is None else i + 1000, t, s) for i, t, s in awkward_texts()]
    docs = frame(spark, rows)
    table = spark.createDataFrame([*labels, (None, 1, 1, "x"), (5, None, None, "x")], "doc_id long, quality int, toxic int, text string")
    score, modulus, held = (byte_cnn.quality_scores, 3, 1) if which == "quality" else (toxic_gru.toxicity_scores, 5, 0)
    got = score(docs, table).collect()
    assert len(got) == len(rows)
    truth = {i: y for i, y, _, _ in labels}
    out = {x.doc_id for x in docs.where(bucket_of_id(docs.doc_id, modulus) == held).collect()}
    assert all(x.held_out == (x.doc_id in out) and 0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got)
    tested = [x for x in got if x.held_out and x.doc_id in truth]
    assert len(tested) > 30
    assert sum(x.predicted == truth[x.doc_id] for x in tested) / len(tested) >= 0.93
    again = {x.doc_id: x.score for x in score(docs.repartition(2), table).collect()}
    assert all(again[x.doc_id] == pytest.approx(x.score, abs=1e-4) for x in got if x.doc_id is not None)


def test_without_labels(spark):
    docs = frame(spark, [(1, "some words", "s"), (2, None, "s")])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for score in (byte_cnn.quality_scores, toxic_gru.toxicity_scores):
        assert len({x.score for x in score(docs, none).collect()}) == 1
        assert score(docs.where("false"), none).count() == 0
    kept = toxic_gru.non_toxic(docs, none)
    assert kept.columns == docs.columns and kept.count() == 2


@pytest.mark.parametrize("module", [byte_cnn, toxic_gru])
def test_scores_keep_the_class_shares_of_all_labels(spark, monkeypatch, module):
    """Texts that say nothing of the label score its share, also where the sample's caps are full."""
    docs = frame(spark, [(i, "the same words in every text", "s") for i in range(400)])
    labels = spark.createDataFrame([(i, int(i % 10 == 0), int(i % 10 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(module, "SAMPLE_PER_CLASS", (25, 25))
    score = byte_cnn.quality_scores if module is byte_cnn else toxic_gru.toxicity_scores
    got = {round(x.score, 3) for x in score(docs, labels).collect()}
    assert len(got) == 1 and 0.04 < got.pop() < 0.2


def test_toxic_gru_multiplies_only_the_words_of_the_windows_at_hand(monkeypatch):
    r = np.random.default_rng(2)
    w, x = toxic_gru.initial(1), r.normal(size=(5000, toxic_gru.INPUT)).astype(np.float32)
    windows = r.integers(0, 5000, (40, toxic_gru.WINDOW)).astype(np.int32)
    whole, given = toxic_gru.forward(w, x, windows)[0], []

    def watched(w, x, windows, keep=False):
        given.append((len(x), windows.size))
        return forward(w, x, windows, keep)

    forward = toxic_gru.forward
    monkeypatch.setattr(toxic_gru, "forward", watched)
    assert np.allclose(toxic_gru.window_logits(w, x, windows, 8), whole, atol=1e-5)
    assert len(given) == 5 and all(words <= places + 1 for words, places in given)
