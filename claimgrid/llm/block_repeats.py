"""Removal of word sequences that an earlier document holds, by fixed-block anchors.

Every text is cut into consecutive blocks of BLOCK words: the index. Any window of WINDOW words holds
one whole block of the text it stands in, so a window that two texts share puts one block of the
earlier text under a rolling run of BLOCK words of the later one. Hence all rolling runs of all texts
are probed against the index, and every hit is extended word by word on both sides, in all the ways
a window can lie around it; windows that still agree with an earlier text are joined to maximal
repeats. Hits are extended by grouping on the extended words, never pair by pair, so a passage in a
third of all texts costs each text its own length.

The work is two exchanges of the same form. A task gathers the hashes of a few million words, settles
on the spot what it can (a run of words in two of its own texts is a hit, all but its earliest text
repeat a window), and sends one entry of the rest for each hash to the hash's bucket, packed in
arrays. So a hot passage reaches its bucket once per task, not once per text. Answers go back by text.

Texts are named by 64-bit hash and length, windows by 64-bit hashes; hits by 30 bits and the
bucket, as they are only the candidates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgrid.llm.common import blocks, id_filter, may_hold, prefix_hash, span_hash, stored, utf8, word_hashes, word_spans

WINDOW, BLOCK = 13, 7
#: Bytes of text whose words share a bucket, on average; the number of buckets grows with the corpus.
BUCKET_BYTES = 24_000_000
#: Hashes that one task gathers before it sends them.
GATHERED = 1 << 19
#: Texts that are taken apart at once.
TEXTS_AT_ONCE = 256
#: Answers in one Arrow batch.
ROWS_AT_ONCE = 1 << 16
PRINT_BITS = 30
PRINT = np.uint64((1 << PRINT_BITS) - 1)
ALIGNED, SETTLED = np.uint32(1), np.uint32(2)

PACKED = "bucket int, texts binary, firsts binary, counts binary, entries binary, answers binary"
ANSWER = "tid long, key long"


# ---- hashes --------------------------------------------------------------------------------


def runs(hashes: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word, and hash, of every run of ``size`` words that stays in one text."""
    place = np.arange(max(0, len(hashes) - size + 1))
    place = place[row[place] == row[place + size - 1]] if len(place) else place
    return place, span_hash(prefix_hash(hashes), place, place + size)


def hit_key(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bucket and 30 more bits of a hash."""
    return (bucket_of(hashes, bits).astype(np.uint64) << np.uint64(PRINT_BITS) | hashes & PRINT).view(np.int64)


def bucket_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def group_starts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal sorted values begin."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)


# ---- packed rows ---------------------------------------------------------------------------


def pack(bucket: np.ndarray, text: np.ndarray, entry: np.ndarray, tids: np.ndarray, firsts: np.ndarray, answers: tuple) -> pa.RecordBatch:
    """One row for each bucket: its texts, the number of entries of each, and the entries; then a row
    with the answers (text, key) that the task has found itself."""
    order = np.lexsort((text, bucket))
    bucket, text, entry = bucket[order], text[order], entry[order]
    cuts = np.append(group_starts(bucket), len(bucket))
    rows: list[list] = [[], [], [], [], [], []]

    def add(*row):
        for values, x in zip(rows, row, strict=True):
            values.append(x)

    for a, b in zip(cuts, cuts[1:], strict=False):
        own = group_starts(text[a:b])
        which = text[a:b][own]
        counts = np.diff(np.append(own, b - a)).astype(np.int32)
        add(int(bucket[a]), tids[which].tobytes(), firsts[which].tobytes(), counts.tobytes(), entry[a:b].tobytes(), b"")
    if len(answers[0]):
        spread = int(tids[0] & 0xFFFF)  # anywhere: answers only pass through
        add(spread, b"", b"", b"", b"", np.stack(answers, 1).astype(np.int64).tobytes())
    kinds = [pa.int32(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays(
        [pa.array(v, k) for v, k in zip(rows, kinds, strict=True)], names=["bucket", "texts", "firsts", "counts", "entries", "answers"]
    )


def unpack(batches: Iterator[pa.RecordBatch], kind: type) -> Iterator[tuple[np.ndarray, ...] | np.ndarray]:
    """Answers as they come, then once (text, first, entry) of all entries."""
    parts: list[list[np.ndarray]] = [[], [], []]
    for batch in batches:
        for texts, firsts, counts, entries, answers in zip(*(batch.column(c).to_pylist() for c in ("texts", "firsts", "counts", "entries", "answers")), strict=True):
            if answers:
                yield np.frombuffer(answers, np.int64).reshape(-1, 2)
            if entries:
                times = np.frombuffer(counts, np.int32)
                parts[0].append(np.repeat(np.frombuffer(texts, np.int64), times))
                parts[1].append(np.repeat(np.frombuffer(firsts, np.int64), times))
                parts[2].append(np.frombuffer(entries, kind))
    yield tuple(np.concatenate(p) if p else np.zeros(0, k) for p, k in zip(parts, (np.int64, np.int64, kind), strict=True))


def answer_rows(found: np.ndarray) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(found), ROWS_AT_ONCE):
        part = found[a : a + ROWS_AT_ONCE]
        yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1])], names=["tid", "key"])


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the bounds of each row's; null lists are empty."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(sizes, dtype=np.int64))


class Gathered:
    """Arrays of a task's texts, filled until they are worth sending."""

    def __init__(self):
        self.tids: list[np.ndarray] = []
        self.firsts: list[np.ndarray] = []
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.texts = self.size = 0

    def add(self, tids: np.ndarray, firsts: np.ndarray, text: np.ndarray, *values: np.ndarray) -> None:
        self.parts.append(((text + self.texts).astype(np.int32), *values))
        self.tids.append(tids)
        self.firsts.append(firsts)
        self.texts += len(tids)
        self.size += len(text)

    def all(self) -> tuple[np.ndarray, ...]:
        return np.concatenate(self.tids), np.concatenate(self.firsts), *(np.concatenate(p) for p in zip(*self.parts, strict=True))


# ---- index and probes ----------------------------------------------------------------------


def settle_probes(tids: np.ndarray, firsts: np.ndarray, text: np.ndarray, hashes: np.ndarray, aligned: np.ndarray, bits: int) -> pa.RecordBatch:
    order = np.argsort(hashes, kind="stable")
    hashes, text, aligned = hashes[order], text[order], aligned[order]
    start = group_starts(hashes)
    block = np.logical_or.reduceat(aligned, start)
    hit = block & (np.minimum.reduceat(text, start) != np.maximum.reduceat(text, start))
    inside = np.repeat(hit, np.diff(np.append(start, len(hashes))))
    answers = (tids[text[inside]], hit_key(hashes[inside], bits))
    sent = ~inside
    flags = aligned.astype(np.uint32)
    sent[start[hit]] = True  # one entry that stands for a settled hit
    flags[start[hit]] = SETTLED
    entry = (hashes[sent] & PRINT).astype(np.uint32) << np.uint32(2) | flags[sent]
    return pack(bucket_of(hashes[sent], bits), text[sent], entry, tids, firsts, answers)


def probe(bits: int, gathered: int = GATHERED):
    """All blocks and all rolling runs of the texts, to their buckets."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Gathered()
        for batch in batches:
            tids, firsts = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("tid", "first"))
            data, offsets = utf8(batch.column("text"))
            for a, b in blocks(offsets, min(1 << 19, 8 * gathered)):
                part, bounds = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                start, end, row = word_spans(part, bounds)
                place, hashes = runs(word_hashes(part, start, end), row, BLOCK)
                if not len(place):
                    continue
                text = row[place]
                aligned = (place - np.searchsorted(row, text)) % BLOCK == 0
                held.add(tids[a:b], firsts[a:b], text, hashes, aligned)
                if held.size >= gathered:
                    yield settle_probes(*held.all(), bits)
                    held = Gathered()
        if held.size:
            yield settle_probes(*held.all(), bits)

    return send


def meet(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one bucket: runs of words that stand in two texts, as a block in one of them."""
    for got in unpack(batches, np.uint32):
        if isinstance(got, np.ndarray):
            yield from answer_rows(got)
            continue
        tid, _, entry = got
        if not len(tid):
            continue
        flags, prints = entry & np.uint32(3), entry >> np.uint32(2)
        order = np.argsort(prints, kind="stable")
        tid, flags, prints = tid[order], flags[order], prints[order]
        start = group_starts(prints)
        settled = np.logical_or.reduceat(flags == SETTLED, start)
        several = np.minimum.reduceat(tid, start) != np.maximum.reduceat(tid, start)
        hit = settled | several & np.logical_or.reduceat(flags == ALIGNED, start)
        asked = np.repeat(hit, np.diff(np.append(start, len(tid)))) & (flags != SETTLED)
        bucket = np.int64(key[0].as_py() << PRINT_BITS)
        yield from answer_rows(np.stack([tid[asked], bucket | prints[asked].astype(np.int64)], 1))


# ---- extension -----------------------------------------------------------------------------


def settle_windows(tids: np.ndarray, firsts: np.ndarray, text: np.ndarray, hashes: np.ndarray, bits: int) -> pa.RecordBatch:
    order = np.lexsort((firsts[text], hashes))
    hashes, text = hashes[order], text[order]
    start = group_starts(hashes)
    least = np.repeat(firsts[text[start]], np.diff(np.append(start, len(hashes))))
    later = firsts[text] > least
    answers = (tids[text[later]], hashes[later].view(np.int64))
    return pack(bucket_of(hashes[~later], bits), text[~later], hashes[~later], tids, firsts, answers)


def around(hits: np.ndarray, n: int) -> np.ndarray:
    """Starts of the windows of a text of ``n`` words that hold one of the hits, marked by first word."""
    total = np.append(0, np.cumsum(hits))
    first = np.arange(n - WINDOW + 1)
    return first[total[first + WINDOW - BLOCK + 1] > total[first]]


def extend(bits: int, gathered: int = GATHERED):
    """The windows around all hits of the texts, to their buckets."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Gathered()
        for batch in batches:
            tids, firsts = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("tid", "first"))
            data, offsets = utf8(batch.column("text"))
            keys, upto = lists(batch.column("keys"))
            for a, b in blocks(offsets, min(1 << 19, 8 * gathered)):
                part, bounds = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                start, end, row = word_spans(part, bounds)
                words = word_hashes(part, start, end)
                edge = np.searchsorted(row, np.arange(b - a + 1))
                place, hashes = runs(words, row, BLOCK)
                found = hit_key(hashes, bits)
                cut = np.searchsorted(place, edge)
                wanted = [np.zeros(0, np.int64)]
                for i in range(b - a):
                    n = int(edge[i + 1] - edge[i])
                    if n >= WINDOW:
                        hits = np.zeros(n - BLOCK + 1, np.int64)
                        hits[np.isin(found[cut[i] : cut[i + 1]], keys[upto[a + i] : upto[a + i + 1]])] = 1
                        wanted.append(edge[i] + around(hits, n))
                at = np.concatenate(wanted)
                if len(at):
                    held.add(tids[a:b], firsts[a:b], row[at], span_hash(prefix_hash(words), at, at + WINDOW))
                if held.size >= gathered:
                    yield settle_windows(*held.all(), bits)
                    held = Gathered()
        if held.size:
            yield settle_windows(*held.all(), bits)

    return send


def compare(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one bucket: windows that an earlier document holds."""
    for got in unpack(batches, np.uint64):
        if isinstance(got, np.ndarray):
            yield from answer_rows(got)
            continue
        tid, first, hashes = got
        if not len(tid):
            continue
        order = np.lexsort((first, hashes))
        tid, first, hashes = tid[order], first[order], hashes[order]
        start = group_starts(hashes)
        later = first > np.repeat(first[start], np.diff(np.append(start, len(tid))))
        yield from answer_rows(np.stack([tid[later], hashes[later].view(np.int64)], 1))


# ---- the operator --------------------------------------------------------------------------


def named(docs: DataFrame) -> DataFrame:
    """(doc_id, text, tid, n_bytes) of all rows; null texts are empty."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("tid"), F.octet_length(text).cast("long").alias("n_bytes"))


def repeated_windows(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, gathered: int = GATHERED) -> DataFrame:
    """(tid, n_bytes, first, gone) of the texts that have copies, or windows that an earlier document holds.

    ``first`` is the least id of the text where it has copies, else null; ``gone`` are the hashes of
    the windows that an earlier document with another text holds.
    """
    least = WINDOW * 2 - 1  # bytes that WINDOW words need
    long = named(docs).where((F.col("n_bytes") >= least) & F.col("doc_id").isNotNull())
    names = stored(long.groupBy("tid", "n_bytes").agg(F.min("doc_id").cast("long").alias("first"), F.count("*").alias("copies")))
    total = names.agg(F.sum("n_bytes")).head()[0] or 0
    bits = max(0, (int(total) // bucket_bytes).bit_length())
    copied = names.where("copies > 1").drop("copies")

    # One row for each different text. Only texts with copies are shuffled, combined by every task first.
    may = long.withColumn("__may", may_hold(docs, id_filter(copied))("tid"))
    alone = may.where(~F.col("__may")).select("tid", F.col("doc_id").cast("long").alias("first"), "text")
    merged = stored(may.where("__may").groupBy("tid", "n_bytes").agg(F.min("doc_id").cast("long").alias("first"), F.min("text").alias("text")))
    texts = alone.union(merged.select("tid", "first", "text"))

    hits = texts.mapInArrow(probe(bits, gathered), PACKED).groupBy("bucket").applyInArrow(meet, ANSWER)
    hits = stored(hits.groupBy("tid").agg(F.collect_set("key").alias("keys")))
    asked = texts.where(may_hold(docs, id_filter(hits))("tid")).join(hits, "tid").select("tid", "first", "text", "keys")
    gone = asked.mapInArrow(extend(bits, gathered), PACKED).groupBy("bucket").applyInArrow(compare, ANSWER)
    gone = stored(gone.groupBy("tid").agg(F.collect_set("key").alias("gone")))
    return stored(
        gone.join(names, "tid")
        .select("tid", "n_bytes", F.when(F.col("copies") > 1, F.col("first")).alias("first"), "gone")
        .unionByName(copied.join(gone.select("tid"), "tid", "left_anti").select("tid", "n_bytes", "first", F.lit(None).cast("array<long>").alias("gone")))
    )


def removed_words(raw: bytes, gone: np.ndarray) -> np.ndarray:
    """Whether each word of a text stands in one of the windows."""
    start, end, row = word_spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    place, hashes = runs(word_hashes(np.frombuffer(raw, np.uint8), start, end), row, WINDOW)
    at = place[np.isin(hashes.view(np.int64), gone)]
    depth = np.zeros(len(start) + 1, np.int64)
    depth[at] += 1  # places are distinct, and so are places + WINDOW
    depth[at + WINDOW] -= 1
    return np.cumsum(depth[:-1]) > 0


def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for a in range(0, whole.num_rows, TEXTS_AT_ONCE):  # few texts at a time as Python objects
            yield finished(whole.slice(a, TEXTS_AT_ONCE))


def finished(batch: pa.RecordBatch) -> pa.RecordBatch:
    words, removed, digests = [], [], []
    gone, upto = lists(batch.column("gone"))
    raws = batch.column("text").cast(pa.binary()).to_pylist()
    for i, (raw, doc_id, first) in enumerate(zip(raws, batch.column("doc_id").to_pylist(), batch.column("first").to_pylist(), strict=True)):
        kept = raw.split()  # splits bytes at the white space of the word pattern
        words.append(len(kept))
        if doc_id is None or len(kept) < WINDOW:
            pass
        elif first is not None and doc_id > first:
            kept = []
        elif upto[i + 1] > upto[i]:
            kept = list(compress(kept, (~removed_words(raw, gone[upto[i] : upto[i + 1]])).tolist()))
        removed.append(words[-1] - len(kept))
        digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())],
        names=["doc_id", "n_words", "n_removed", "kept_sha256"],
    )


def without_earlier(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, gathered: int = GATHERED) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of ``docs``.

    A null text has no words; texts of fewer than WINDOW words lose nothing. Copies of a text lose
    everything but for rows of the least id; repeated rows have one id, so neither is earlier than the
    other. A row without an id is neither earlier nor later than any: it loses nothing and takes
    nothing. An empty table gives no rows; columns other than doc_id and text are ignored.
    """
    lost = repeated_windows(docs, bucket_bytes, gathered)
    rows = named(docs).withColumn("__may", F.col("doc_id").isNotNull() & may_hold(docs, id_filter(lost))("tid"))
    rest = rows.where(~F.col("__may")).select("doc_id", "text", F.lit(None).cast("long").alias("first"), F.lit(None).cast("array<long>").alias("gone"))
    cut = rows.where("__may").join(lost, ["tid", "n_bytes"], "left").select("doc_id", "text", "first", "gone")
    kind = dict(docs.dtypes)["doc_id"]
    return rest.union(cut).mapInArrow(finish, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")
