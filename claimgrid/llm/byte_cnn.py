"""Quality classifier: a byte-level convolutional network in numpy.

A document is cut into overlapping chunks that cover all of its bytes. Learned filters run over
each chunk and are max-pooled inside it; the chunks' activations are pooled over the document
(maximum and mean) and combined into one probability. Training runs on the driver over a bounded
sample of labelled rows, scoring on the executors over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgrid.llm.common import Adam, blocks, bucket_of_id, labelled_sample, prior_shift, sigmoid, utf8

#: Bytes of a chunk, of the step to the next one and of a filter, which stands on every byte.
CHUNK, STEP, SPAN = 512, 448, 8
EMBEDDING, FILTERS = 8, 32
PAD = 256
#: The training sample: documents of class 0 and 1, and bytes of a text in it at most.
SAMPLE_PER_CLASS, SAMPLE_BYTES = (1500, 3500), 32_768
TRAIN_STEPS, BATCH, RATE, SEED = 1200, 24, 0.004, 5
#: Chunks convolved at once.
AT_ONCE = 64


def chunked(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all chunks (padded) and the row of each; an empty text is one chunk of padding."""
    size = np.diff(offsets)
    n = np.maximum(1, -(-(size - (CHUNK - STEP)) // STEP))
    row = np.repeat(np.arange(len(size)), n)
    start = offsets[row] + STEP * (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))
    at = start[:, None] + np.arange(CHUNK)
    inside = at < offsets[row + 1][:, None]
    padded = np.append(data, 0).astype(np.int16)
    return np.where(inside, padded[np.where(inside, at, 0)], PAD), row


def initial(seed: int) -> dict[str, np.ndarray]:
    r = np.random.Generator(np.random.PCG64(seed))
    return {
        k: v.astype(np.float32)
        for k, v in {
            "embed": r.normal(0, 0.5, (257, EMBEDDING)),
            "kernel": r.normal(0, 1 / np.sqrt(SPAN * EMBEDDING), (SPAN, EMBEDDING, FILTERS)),
            "bias": np.zeros(FILTERS),
            "out": r.normal(0, 0.1, 2 * FILTERS),
            "shift": np.zeros(1),
        }.items()
    }


def convolved(w: dict[str, np.ndarray], chunks: np.ndarray) -> np.ndarray:
    """Every filter at every byte of every chunk where it fits, one alignment at a time."""
    n, places = len(chunks), CHUNK - SPAN + 1
    x = w["embed"][chunks].reshape(n, CHUNK * EMBEDDING)
    kernel = w["kernel"].reshape(SPAN * EMBEDDING, FILTERS)
    out = np.empty((n, places, FILTERS), x.dtype)
    for shift in range(SPAN):
        fit = (CHUNK - shift) // SPAN
        span = np.ascontiguousarray(x[:, shift * EMBEDDING : (shift + fit * SPAN) * EMBEDDING])
        out[:, shift::SPAN] = (span.reshape(n * fit, -1) @ kernel).reshape(n, fit, FILTERS)
    return out


def pooled(w: dict[str, np.ndarray], chunks: np.ndarray) -> np.ndarray:
    out = np.empty((len(chunks), FILTERS), np.float32)
    for at in range(0, len(chunks), AT_ONCE):
        out[at : at + AT_ONCE] = convolved(w, chunks[at : at + AT_ONCE]).max(1)
    return np.maximum(out + w["bias"], 0)


def combined(w: dict[str, np.ndarray], p: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Document features (maximum and mean over its chunks) and probability."""
    first = np.searchsorted(row, np.arange(n_rows))
    count = np.diff(np.append(first, len(row)))
    z = np.hstack([np.maximum.reduceat(p, first), np.add.reduceat(p, first) / count[:, None]])
    return z, sigmoid(z @ w["out"] + w["shift"])


def train(sample: list[tuple[str, int]], seed: int = SEED, steps: int = TRAIN_STEPS) -> dict[str, np.ndarray]:
    """Weights after a fixed number of Adam steps; without both labels, the untrained prior."""
    w = initial(seed)
    y = np.array([label for _, label in sample], np.float32)
    if len(y) == 0 or y.min() == y.max():
        w["out"][:] = 0
        w["shift"][:] = 0 if len(y) == 0 else (4 if y[0] else -4)
        return w
    data, offsets = utf8(pa.array([t for t, _ in sample], pa.string()))
    parts = [(a, *chunked(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])) for a, b in blocks(offsets)]
    chunks = np.concatenate([p[1] for p in parts])
    row = np.concatenate([p[0] + p[2] for p in parts])
    first = np.searchsorted(row, np.arange(len(y) + 1))
    adam, r = Adam(w, RATE), np.random.Generator(np.random.PCG64(seed))
    order = np.zeros(0, np.int64)
    for step in range(steps):
        adam.rate = RATE * min(1, 2 * (1 - step / steps))
        if len(order) < BATCH:
            order = np.concatenate([order, r.permutation(len(y))])
        docs, order = order[:BATCH], order[BATCH:]
        picked = np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])
        owner = np.repeat(np.arange(len(docs)), first[docs + 1] - first[docs])
        adam.step(gradients(w, chunks[picked], owner, y[docs]))
    return w


def gradients(w: dict[str, np.ndarray], chunks: np.ndarray, row: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean cross-entropy; each filter passes them on at its strongest place."""
    place = np.empty((len(chunks), FILTERS), np.int64)
    top = np.empty((len(chunks), FILTERS), np.float32)
    for at in range(0, len(chunks), AT_ONCE):
        part = convolved(w, chunks[at : at + AT_ONCE])
        place[at : at + AT_ONCE] = part.argmax(1)
        top[at : at + AT_ONCE] = part.max(1)
    p = np.maximum(top + w["bias"], 0)
    z, said = combined(w, p, row, len(y))
    g = ((said - y) / len(y)).astype(np.float32)
    gz = g[:, None] * w["out"]
    count = np.bincount(row, minlength=len(y)).astype(np.float32)
    gp = gz[row, FILTERS:] / count[row][:, None]
    largest = p == z[row, :FILTERS]  # ties share
    shares = np.add.reduceat(largest.astype(np.float32), np.searchsorted(row, np.arange(len(y))))
    gp += np.where(largest, gz[row, :FILTERS] / shares[row], 0)
    gp = np.where(p > 0, gp, 0).astype(np.float32)
    # The bytes under each filter's strongest place: (chunk, filter, SPAN).
    at = place[:, :, None] + np.arange(SPAN)
    under = chunks[np.arange(len(chunks))[:, None, None], at]
    x = w["embed"][under].reshape(len(chunks), FILTERS, -1)
    both = np.einsum("nf,nfk->kf", gp, x, optimize=True)
    gx = (gp[:, :, None] * w["kernel"].reshape(-1, FILTERS).T).reshape(-1, EMBEDDING)
    flat = under.ravel()
    embed = np.stack([np.bincount(flat, gx[:, d], 257) for d in range(EMBEDDING)], 1)
    return {
        "embed": embed.astype(np.float32),
        "kernel": both.reshape(w["kernel"].shape),
        "bias": gp.sum(0),
        "out": z.T @ g,
        "shift": g.sum(keepdims=True),
    }


def scores(w: dict[str, np.ndarray], texts: pa.Array) -> np.ndarray:
    """Probability of label 1 of every whole text."""
    data, offsets = utf8(texts)
    out = np.zeros(len(offsets) - 1)
    for a, b in blocks(offsets):
        chunks, row = chunked(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        out[a:b] = combined(w, pooled(w, chunks), row, b - a)[1]
    return out


def scorer(w: dict[str, np.ndarray]):
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(scores(w, batch), pa.float64())

    return F.arrow_udf(score, "double")


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Learns from rows of ``labels`` whose CRC-32 of the id is not 1 modulo 3; null labels are no
    labels. Null and empty texts are one chunk of padding and get its score. Null ids are never
    held out. Repeated rows score alike. Without labels of both kinds the score is constant. Only
    doc_id and text of ``docs`` are read.
    """
    learn = bucket_of_id(F.col("doc_id"), 3) != 1
    w = train(labelled_sample(docs, labels, label, learn, SAMPLE_PER_CLASS, SAMPLE_BYTES))
    # The sample has its own class shares; scores have those of all admissible labels.
    w["shift"] = w["shift"] + np.float32(prior_shift(labels, label, learn, SAMPLE_PER_CLASS))
    rows = docs.select(
        "doc_id",
        F.coalesce(bucket_of_id(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"),
        scorer(w)(F.col("text")).alias("score"),
    )
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
