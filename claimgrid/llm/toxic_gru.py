"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Every word is read twice: as a whole and as its characters, each by what the labels say of it.
The word input is the shrunken log-odds of the hashed word and how often it was seen; the
character input pools the log-odds of its hashed byte runs (largest, mean and least). The network
runs over overlapping windows of words that cover the whole text, attention pools a window's
states into one logit, and a last logistic layer combines a document's worst window with the mean
over its windows. While the network learns, the statistics a document is read with come from the
other folds of the sample, so no word is seen through the document that is judged; training alternates between
finding each document's worst window and learning from it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgrid.llm.common import (
    BYTE_VALUE,
    LOWER,
    Adam,
    blocks,
    bucket_of_id,
    labelled_sample,
    prefix_hash,
    prior_shift,
    sigmoid,
    span_hash,
    utf8,
    word_hashes,
    word_spans,
)

#: Words of a window and of the step to the next one.
WINDOW, STEP = 64, 56
WORD_BUCKETS, CHAR_BUCKETS = 1 << 18, 1 << 18
#: Byte runs of a marked word: all of the first length, and its beginnings of the others.
CHAR_RUN, PREFIXES = 5, (7, 9)
INPUT, HIDDEN = 5, 10
SAMPLE_PER_CLASS, SAMPLE_BYTES = (1500, 1500), 32_768
#: Folds of the sample; rounds of training, more where they would be fewer steps than STEPS.
FOLDS, ROUNDS, STEPS, BATCH, RATE, SEED = 4, 5, 200, 128, 0.015, 11
#: Documents' worth of the prior in every log-odds.
PRIOR = 5.0

LETTER = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
MARK = np.uint64(0x9E3779B97F4A7C15)


#: Words hashed at once.
PART = 1 << 15


def _in_parts(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Word hashes, some words at a time: the memory does not grow with the text."""
    parts = [np.zeros(0, np.uint64)]
    for a in range(0, len(start), PART):
        b, base = min(a + PART, len(start)), start[a]
        parts.append(word_hashes(data[base : end[b - 1]], start[a:b] - base, end[a:b] - base))
    return np.concatenate(parts)


def char_runs(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte runs of some words, each with a mark on both sides, and runs per word."""
    size = end - start + 2
    stop = np.cumsum(size)
    begin = stop - size
    values = np.full(int(size.sum()), MARK, np.uint64)
    place = np.repeat(begin + 1 - start, end - start)
    source = np.arange(int((end - start).sum())) + np.repeat(start - (np.cumsum(end - start) - (end - start)), end - start)
    values[source + place] = BYTE_VALUE[low[source]]
    n = np.maximum(1, size - CHAR_RUN + 1)
    at = np.repeat(begin, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    to = np.minimum(at + CHAR_RUN, np.repeat(stop, n))
    word = np.repeat(np.arange(len(n)), n)
    for length in PREFIXES:
        long = np.flatnonzero(size >= length)
        word = np.append(word, long)
        at, to = np.append(at, begin[long]), np.append(to, begin[long] + length)
    order = np.argsort(word, kind="stable")
    bucket = (span_hash(prefix_hash(values), at, to) >> np.uint64(40)).astype(np.int64)[order] % CHAR_BUCKETS
    return bucket, np.bincount(word, minlength=len(n))


class Words:
    """The words of some texts: distinct words with their buckets, and windows as indexes of them.

    Index 0 is padding. ``windows`` is (window, WINDOW); ``row`` the text of each window.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        low = LOWER[data]
        start, end, row = word_spans(low, offsets, LETTER)
        hashes, first, of = np.unique(_in_parts(low, start, end), return_index=True, return_inverse=True)
        self.n_rows = len(offsets) - 1
        self.word_bucket = (hashes >> np.uint64(40)).astype(np.int64) % WORD_BUCKETS
        start, end = start[first], end[first]
        parts = [char_runs(low, start[a : a + PART], end[a : a + PART]) for a in range(0, len(start), PART)]
        self.char_bucket = np.concatenate([np.zeros(0, np.int64), *(p[0] for p in parts)])
        self.char_count = np.concatenate([np.zeros(0, np.int64), *(p[1] for p in parts)])
        self.char_first = np.cumsum(self.char_count) - self.char_count
        n_words = np.bincount(row, minlength=self.n_rows)
        n = np.maximum(1, -(-(n_words - (WINDOW - STEP)) // STEP))
        self.row = np.repeat(np.arange(self.n_rows), n)
        begin = np.cumsum(n_words) - n_words
        at = begin[self.row] + STEP * (np.arange(len(self.row)) - np.repeat(np.cumsum(n) - n, n))
        stop = (begin + n_words)[self.row]
        padded = np.append(of + 1, 0).astype(np.int32)
        self.windows = np.zeros((len(at), WINDOW), np.int32)
        for a in range(0, len(at), PART // WINDOW):
            some = at[a : a + PART // WINDOW, None] + np.arange(WINDOW)
            inside = some < stop[a : a + PART // WINDOW, None]
            self.windows[a : a + PART // WINDOW][inside] = padded[some[inside]]

def log_odds(seen: np.ndarray, toxic: np.ndarray, share: float) -> np.ndarray:
    """Log-odds of label 1 in each bucket against the sample's, shrunk towards 0 by the prior."""
    odds = (toxic + PRIOR * share) / (seen - toxic + PRIOR * (1 - share))
    return np.log(odds * (1 - share) / share).astype(np.float32)


def fold_counts(words: Words, y: np.ndarray, fold: np.ndarray, docs_at_once: int = 128) -> dict[str, np.ndarray]:
    """Documents per word and character bucket, by fold and label: (FOLDS, 2, buckets)."""
    counts = {"word": np.zeros((FOLDS, 2, WORD_BUCKETS), np.int32), "char": np.zeros((FOLDS, 2, CHAR_BUCKETS), np.int32)}
    for d in range(0, len(y), docs_at_once):
        lo, hi = np.searchsorted(words.row, [d, d + docs_at_once])
        own = words.windows[lo:hi].ravel()
        n_words = len(words.word_bucket) + 1
        pairs = np.unique(np.repeat(words.row[lo:hi], WINDOW)[own > 0] * n_words + own[own > 0])
        doc, word = pairs // n_words, pairs % n_words - 1
        n = words.char_count[word]
        at = np.repeat(words.char_first[word], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        for name, who, bucket, size in (
            ("word", doc, words.word_bucket[word], WORD_BUCKETS),
            ("char", np.repeat(doc, n), words.char_bucket[at], CHAR_BUCKETS),
        ):
            once = np.unique(who * size + bucket)
            who, bucket = once // size, once % size
            np.add.at(counts[name], (fold[who], y[who].astype(np.int64), bucket), 1)
    return counts


def statistics(counts: dict[str, np.ndarray], share: float, without: int | None = None) -> dict[str, np.ndarray]:
    """Word and character tables from the counts of all folds but one."""
    kept = [k for k in range(FOLDS) if k != without]
    clean, toxic = counts["word"][kept].sum(0)
    tables = {"word": log_odds(clean + toxic, toxic, share), "seen": np.log1p(clean + toxic).astype(np.float32) / 4}
    clean, toxic = counts["char"][kept].sum(0)
    return tables | {"char": log_odds(clean + toxic, toxic, share)}


def initial(seed: int) -> dict[str, np.ndarray]:
    r = np.random.Generator(np.random.PCG64(seed))
    w = {
        "out": r.normal(0, 0.3, 2 * HIDDEN),
        "shift": np.full(1, -1.0),
        "attend": r.normal(0, 0.3, 2 * HIDDEN),
    }
    for d in ("f", "b"):
        w["in_" + d] = r.normal(0, 0.4, (INPUT, 3 * HIDDEN))
        w["rec_" + d] = r.normal(0, 0.3, (HIDDEN, 3 * HIDDEN))
        w["bias_" + d] = np.zeros(3 * HIDDEN)
    return {k: v.astype(np.float32) for k, v in w.items()}


def inputs(tables: dict[str, np.ndarray], words: Words) -> np.ndarray:
    """Word and character input of every distinct word; row 0 is padding."""
    out = np.zeros((len(words.word_bucket) + 1, INPUT), np.float32)
    if len(words.word_bucket):
        out[1:, 0] = tables["word"][words.word_bucket]
        out[1:, 1] = tables["seen"][words.word_bucket]
        runs = tables["char"][words.char_bucket]
        out[1:, 2] = np.maximum.reduceat(runs, words.char_first)
        out[1:, 3] = np.add.reduceat(runs, words.char_first) / words.char_count
        out[1:, 4] = np.minimum.reduceat(runs, words.char_first)
    return out


def run_direction(w: dict[str, np.ndarray], d: str, given: np.ndarray, windows: np.ndarray, keep: bool = False):
    """States (WINDOW, windows, HIDDEN) of one direction; padding leaves the state as it is."""
    n = len(windows)
    h = np.zeros((n, HIDDEN), np.float32)
    states = np.zeros((WINDOW, n, HIDDEN), np.float32)
    saved = []
    rec = w["rec_" + d]
    for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
        at = windows[:, t]
        x = given[at]
        hr = h @ rec
        gates = sigmoid(x[:, : 2 * HIDDEN] + hr[:, : 2 * HIDDEN])
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        c = np.tanh(x[:, 2 * HIDDEN :] + r * hr[:, 2 * HIDDEN :])
        z = z * (at > 0)[:, None]  # share of the new state
        new = h + z * (c - h)
        if keep:
            saved.append((t, h, hr, z, gates[:, :HIDDEN], r, c))
        h = new
        states[t] = h
    return states, saved


def forward(w: dict[str, np.ndarray], x: np.ndarray, windows: np.ndarray, keep: bool = False):
    """Logits of the windows, and what the backward pass needs."""
    runs = {d: run_direction(w, d, x @ w["in_" + d] + w["bias_" + d], windows, keep) for d in ("f", "b")}
    states = np.concatenate([runs["f"][0], runs["b"][0]], 2)
    energy = states @ w["attend"]
    energy[windows.T == 0] = -30
    a = np.exp(energy - energy.max(0))
    a /= a.sum(0)
    pooled = np.einsum("tn,tnh->nh", a, states)
    return pooled @ w["out"] + w["shift"], (runs, states, a, pooled)


def gradients(w: dict[str, np.ndarray], x: np.ndarray, windows: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Backpropagation through time of the weighted cross-entropy over some windows."""
    # Only the words of these windows.
    used, windows = np.unique(np.append(0, windows), return_inverse=True)
    x, windows = x[used], windows[1:].reshape(-1, WINDOW)
    logit, (runs, states, a, pooled) = forward(w, x, windows, True)
    g = ((sigmoid(logit) - y) * weight / weight.sum()).astype(np.float32)
    out = {"out": pooled.T @ g, "shift": g.sum(keepdims=True)}
    g_pooled = g[:, None] * w["out"]
    g_a = np.einsum("tnh,nh->tn", states, g_pooled)
    g_e = a * (g_a - (a * g_a).sum(0))
    out["attend"] = np.einsum("tn,tnh->h", g_e, states)
    g_states = a[:, :, None] * g_pooled + g_e[:, :, None] * w["attend"]
    for k, d in enumerate(("f", "b")):
        rec = w["rec_" + d]
        g_rec, g_given = np.zeros_like(rec), np.zeros((len(x), 3 * HIDDEN), np.float32)
        g_h = np.zeros((len(windows), HIDDEN), np.float32)
        for t, h, hr, z, z_full, r, c in reversed(runs[d][1]):
            g_h = g_h + g_states[t, :, k * HIDDEN : (k + 1) * HIDDEN]
            g_z, g_c = g_h * (c - h) * (z > 0), g_h * z
            g_cp = g_c * (1 - c * c)
            g_zp = g_z * z_full * (1 - z_full)
            g_rp = g_cp * hr[:, 2 * HIDDEN :] * r * (1 - r)
            g_hr = np.hstack([g_zp, g_rp, g_cp * r])
            np.add.at(g_given, windows[:, t], np.hstack([g_zp, g_rp, g_cp]))
            g_rec += h.T @ g_hr
            g_h = g_h * (1 - z) + g_hr @ rec.T
        out["rec_" + d], out["bias_" + d] = g_rec, g_given[1:].sum(0)
        g_given[0] = 0
        out["in_" + d] = x.T @ g_given
    return out


def window_logits(w: dict[str, np.ndarray], given: np.ndarray, windows: np.ndarray, at_once: int = 1024) -> np.ndarray:
    """Logits of the windows, some at a time; only the words of those are multiplied."""
    out = np.empty(len(windows), np.float32)
    for at in range(0, len(out), at_once):
        used, own = np.unique(np.append(0, windows[at : at + at_once]), return_inverse=True)
        out[at : at + at_once] = forward(w, given[used], own[1:].reshape(-1, WINDOW))[0]
    return out


def document_features(logits: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
    """Worst window, mean probability over the windows and a constant, for every text."""
    first = np.searchsorted(row, np.arange(n_rows))
    n = np.diff(np.append(first, len(row)))
    mean = np.add.reduceat(sigmoid(logits.astype(np.float64)), first) / n
    return np.stack([np.maximum.reduceat(logits, first), 4 * mean, np.ones(n_rows)], 1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Newton steps of a ridge logistic regression."""
    v = np.zeros(x.shape[1])
    for _ in range(25):
        p = sigmoid(x @ v)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(v))
        v -= np.linalg.solve(hessian, x.T @ (p - y) + ridge * v)
    return v


def worst_windows(logits: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
    """Index of each row's window with the largest logit."""
    order = np.lexsort((-logits, row))
    return order[np.searchsorted(row, np.arange(n_rows))]


def train(sample: list[tuple[str, int]], seed: int = SEED, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Weights and tables from a bounded sample; without both labels, a constant score."""
    w = initial(seed)
    y = np.array([label for _, label in sample], np.float32)
    r = np.random.Generator(np.random.PCG64(seed))
    fold = r.permutation(len(y)) % FOLDS
    others = [y[fold != k] for k in range(FOLDS)]
    if any(len(part) == 0 or part.min() == part.max() for part in others):
        w |= {"word": np.zeros(WORD_BUCKETS, np.float32), "char": np.zeros(CHAR_BUCKETS, np.float32)}
        return w | {"seen": w["word"], "combine": np.array([0, 0, 4.0 if len(y) and y.mean() > 0.5 else -4.0])}
    words = Words(*utf8(pa.array([t for t, _ in sample], pa.string())))
    # Each fold has inputs of its own: the words of fold k are k times their number further on.
    counts, share = fold_counts(words, y, fold), float(y.mean())
    n_words = len(words.word_bucket)
    x = np.zeros((FOLDS * n_words + 1, INPUT), np.float32)
    for k in range(FOLDS):
        x[1 + k * n_words : 1 + (k + 1) * n_words] = inputs(statistics(counts, share, k), words)[1:]
    row = words.row
    windows = np.where(words.windows > 0, words.windows + (n_words * fold[row][:, None]).astype(np.int32), 0)
    logits = (x[:, 0] + x[:, 2])[windows].max(1)
    clean = np.flatnonzero(y[row] == 0)
    adam = Adam(w, RATE)
    rounds = max(rounds, -(-STEPS * BATCH // (len(y) + min(len(clean), len(y)))))
    for turn in range(rounds):
        other = r.choice(clean, min(len(clean), len(y)), replace=False)
        picked = np.concatenate([worst_windows(logits, row, len(y)), other])
        label = y[row[picked]]
        weight = np.where(label == 1, (label == 0).sum() / (label == 1).sum() / 2, 1).astype(np.float32)
        adam.rate = RATE * (1 - turn / rounds) ** 0.5
        order = r.permutation(len(picked))
        for at in range(0, len(order), BATCH):
            b = order[at : at + BATCH]
            adam.step(gradients(w, x, windows[picked[b]], label[b], weight[b]))
        logits = window_logits(w, x, windows)
    w["combine"] = logistic(document_features(logits, row, len(y)), y)
    return w | statistics(counts, share)


def scores(w: dict[str, np.ndarray], texts: pa.Array) -> np.ndarray:
    """Probability of label 1 of every whole text."""
    data, offsets = utf8(texts)
    out = np.zeros(len(offsets) - 1)
    for a, b in blocks(offsets):
        words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        logits = window_logits(w, inputs(w, words), words.windows)
        out[a:b] = sigmoid(document_features(logits, words.row, b - a) @ w["combine"])
    return out


def scorer(w):
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(scores(w.value, batch), pa.float64())

    return F.arrow_udf(score, "double")


def fitted_scorer(docs: DataFrame, labels: DataFrame, label: str = "toxic"):
    """A scoring function trained on rows of ``labels`` whose CRC-32 of the id is not 0 modulo 5.

    The sample has its own class shares; the last logit is shifted to those of all admissible labels.
    """
    learn = bucket_of_id(F.col("doc_id"), 5) != 0
    w = train(labelled_sample(docs, labels, label, learn, SAMPLE_PER_CLASS, SAMPLE_BYTES))
    w["combine"] = w["combine"] + np.array([0, 0, prior_shift(labels, label, learn, SAMPLE_PER_CLASS)])
    return scorer(docs.sparkSession.sparkContext.broadcast(w))


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Null and empty texts are one window of padding and get its score. Null ids are never held
    out, null labels are no labels. Repeated rows score alike. Without labels of both kinds the
    score is constant. Only doc_id and text of ``docs`` are read.
    """
    rows = docs.select(
        "doc_id",
        F.coalesce(bucket_of_id(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
        fitted_scorer(docs, labels, label)(F.col("text")).alias("score"),
    )
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def non_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``limit``."""
    return docs.where(fitted_scorer(docs, labels)(F.col("text")) < limit)
