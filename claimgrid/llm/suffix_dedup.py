"""Removal of repeated byte strings with two-stage suffix sorting.

A string of LENGTH bytes has one anchor: the run of ANCHOR bytes inside it with the least hash.
Equal strings have equal anchors, so only the neighbourhoods of anchors that occur more than once
are looked at. A segment is an anchor with all window starts that belong to it and the bytes they
reach. Equal segments are settled by counting. Different segments with the same anchor are
gathered in small groups and suffix-sorted: suffixes smaller than their successors are sorted
directly, the rest is induced by scanning the buckets in order, and neighbours in the order that
share LENGTH bytes are marked. Anchors with very many different segments, such as a passage in a
third of all texts, would make large groups: their windows are counted by hash instead, in slices
of neighbours first, and one by one only where the middle of a slice is shared but not all of it.

Texts are named by 64-bit hash and length, strings by 64-bit hashes within equal anchors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgrid.llm.common import BYTE_VALUE, blocks, id_filter, may_hold, mix, prefix_hash, span_hash, stored, utf8

LENGTH, ANCHOR = 400, 64
#: Anchors with more different segments than this are settled by counting windows.
MOST_SEGMENTS = 256
#: Neighbouring windows that are counted as one at first.
SLICE = 8
#: Window starts, and bytes, sorted together, in whole groups: a start may bring LENGTH bytes along.
STARTS_AT_ONCE, BYTES_AT_ONCE = 1 << 14, 1 << 18
#: Neighbours in the sorted order compared together.
PAIRS_AT_ONCE = 4096
#: Segments or slices in one Arrow batch, about.
ROWS_AT_ONCE = 4096
HIGH, LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)


# ---- anchors -------------------------------------------------------------------------------


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours, by doubling."""
    reach = 1
    while 2 * reach <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR):
    """(row, start in row, windows, offset of the anchor, anchor hash, segment hash) of every segment."""
    none = np.zeros(0, np.int64)
    nothing = (none, none, none, none, none.view(np.uint64), none.view(np.uint64))
    if len(data) < length:
        return nothing
    sums = prefix_hash(BYTE_VALUE[data])
    place = np.arange(len(data) - anchor + 1)
    hashes = span_hash(sums, place, place + anchor)
    least = sliding_minimum((hashes & HIGH) | place.astype(np.uint64), length - anchor + 1)
    at = (least & LOW).astype(np.int64)  # of every window start; the leftmost on ties
    row = np.searchsorted(offsets, np.arange(len(at)), "right") - 1
    fits = np.arange(len(at)) + length <= offsets[row + 1]
    new = fits.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~fits[:-1] | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    if not len(first):
        return nothing
    # A run of windows ends before the next run or with the last window of its text.
    last = np.minimum(np.append(first[1:], len(at)) - 1, offsets[row[first] + 1] - length)
    whole = span_hash(sums, first, last + length)
    own, offset = row[first], at[first] - first
    return own, first - offsets[own], last - first + 1, offset, hashes[at[first]], mix(whole ^ offset.astype(np.uint64))


def text_id(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(F.coalesce(text, F.lit(""))).alias("tid"), F.octet_length(F.coalesce(text, F.lit(""))).cast("long").alias("n_bytes")


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.append(0, np.cumsum([len(v) for v in values])).astype(np.int32)
    flat = np.concatenate([np.zeros(0, np.int64), *values])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat).cast(kind))


def anchor_table(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """One row per long text (a few for texts with copies): its segments as arrays."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            names = list(zip(batch.column("tid").to_pylist(), batch.column("n_bytes").to_pylist(), strict=True))
            fresh = [i for i, k in enumerate(names) if k not in seen and not seen.add(k)]
            if not fresh:
                continue
            if len(fresh) < len(names):
                batch = batch.take(pa.array(fresh))
            data, offsets = utf8(batch.column("text"))
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for a, b in blocks(offsets):
                row, *parts = segments(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], length, anchor)
                bounds = np.searchsorted(row, np.arange(b - a + 1))
                for values, part in zip(out, parts, strict=True):
                    part = part.view(np.int64)
                    values += [part[x:y] for x, y in zip(bounds, bounds[1:], strict=False)]
            start, windows, offset, anchors, whole = out
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("tid"),
                    batch.column("n_bytes"),
                    _lists(anchors, pa.int64()),
                    _lists(whole, pa.int64()),
                    _lists(start, pa.int64()),
                    _lists(windows, pa.int32()),
                    _lists(offset, pa.int32()),
                ],
                names=["tid", "n_bytes", "anchor", "segment", "start", "windows", "offset"],
            )

    long = docs.select(*text_id(F.col("text")), "text").where(F.col("n_bytes") >= length)
    lists = "anchor array<long>, segment array<long>, start array<long>, windows array<int>, offset array<int>"
    return long.mapInArrow(find, f"tid long, n_bytes long, {lists}")


# ---- two-stage suffix sorting ----------------------------------------------------------------


def suffix_order(text: bytes, ends: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The wanted suffixes (and those that their order is induced from), sorted to ``depth`` bytes.

    ``ends`` is, for every position, the end of its string; a suffix ends there, before all bytes.
    """
    t = np.frombuffer(text, np.uint8)
    n = len(t)
    last = np.arange(n) == ends - 1
    # Smaller than its successor: by the next byte, through runs of equal bytes; never at the end.
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int16) - t[:-1])
    step[last] = -1
    known = np.flatnonzero(step)
    decides = known[np.searchsorted(known, np.arange(n))]
    smaller = step[decides] > 0
    # A larger suffix is induced from its successors up to the first smaller one or the end.
    need = np.zeros(n + 1, bool)
    need[:-1] = wanted
    stops = np.flatnonzero(smaller | last)
    reach = stops[np.searchsorted(stops, np.arange(n))]
    starts = np.flatnonzero(wanted & ~smaller)
    delta = np.zeros(n + 2, np.int32)
    np.add.at(delta, starts, 1)
    np.add.at(delta, reach[starts] + 1, -1)
    need[:-1] |= np.cumsum(delta)[:n] > 0
    need = need[:-1]

    direct = sorted(np.flatnonzero(need & smaller).tolist(), key=lambda i: text[i : min(i + depth, ends[i])])
    direct = np.array(direct, np.int64)
    firsts = np.searchsorted(t[direct], np.arange(257)) if len(direct) else np.zeros(257, np.int64)
    larger = need & ~smaller
    begins = np.zeros(n, bool)
    begins[0] = True
    begins[np.flatnonzero(last)[:-1] + 1] = True
    heads: list[list[np.ndarray]] = [[] for _ in range(256)]

    def induce(bucket: np.ndarray, above: int) -> None:
        """Appends the larger predecessors of a bucket's entries to the buckets above it, in order."""
        bucket = bucket[~begins[bucket]] - 1
        bucket = bucket[larger[bucket]]
        byte = t[bucket]
        bucket, byte = bucket[byte > above], byte[byte > above]
        by = np.argsort(byte, kind="stable")
        bucket, byte = bucket[by], byte[by]
        cut = np.flatnonzero(np.diff(byte)) + 1
        for part, c in zip(np.split(bucket, cut), byte[np.append(0, cut)] if len(byte) else (), strict=False):
            heads[c].append(part)

    only = np.flatnonzero(last & larger)  # one byte before the end: induced from the end itself
    byte = t[only]
    for c in np.unique(byte):
        heads[c].append(only[byte == c])
    out = []
    for c in range(256):
        grown = list(heads[c])
        newest = np.concatenate(grown) if grown else direct[:0]
        while len(newest):  # runs of the bucket's own byte
            before = newest[~begins[newest]] - 1
            newest = before[larger[before] & (t[before] == c)]
            if len(newest):
                grown.append(newest)
        bucket = np.concatenate([*grown, direct[firsts[c] : firsts[c + 1]]]) if grown else direct[firsts[c] : firsts[c + 1]]
        if len(bucket):
            out.append(bucket)
            induce(bucket, c)
    return np.concatenate(out) if out else direct


def common_prefixes(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Bytes that each suffix in ``order`` shares with the next one, counted up to ``length``.

    Every suffix has at least ``length`` bytes. The bytes themselves are compared.
    """
    out = np.zeros(max(len(order) - 1, 0), np.int64)
    if not len(out):
        return out
    heads = np.lib.stride_tricks.sliding_window_view(text, length)
    for at in range(0, len(out), PAIRS_AT_ONCE):
        upper, lower = order[:-1][at : at + PAIRS_AT_ONCE], order[1:][at : at + PAIRS_AT_ONCE]
        differ = heads[upper] != heads[lower]
        out[at : at + PAIRS_AT_ONCE] = np.where(differ.any(1), differ.argmax(1), length)
    return out


def repeated_starts(bodies: list[bytes], windows: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each segment, which of its window starts begin a string that another start begins too."""
    text = b"".join(bodies)
    size = np.array([len(b) for b in bodies])
    end = np.cumsum(size)
    begin = end - size
    wanted = np.zeros(len(text), bool)
    for b, w in zip(begin.tolist(), windows, strict=True):
        wanted[b : b + w] = True
    order = suffix_order(text, np.repeat(end, size), wanted, length)
    order = order[wanted[order]]
    same = common_prefixes(np.frombuffer(text, np.uint8), order, length) >= length
    marked = np.zeros(len(text), bool)
    marked[order[1:][same]] = True
    marked[order[:-1][same]] = True
    return [marked[b : b + w] for b, w in zip(begin.tolist(), windows, strict=True)]


def runs_of(marked: np.ndarray) -> np.ndarray:
    """First and last index of every run of marks, flattened."""
    edge = np.diff(np.concatenate([[0], marked.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1], 1).ravel()


def _sort_groups(length: int):
    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []

        def solve(rows):
            found = repeated_starts([r[3] for r in rows], [r[2] for r in rows], length)
            kept = [(r, runs_of(m)) for r, m in zip(rows, found, strict=True) if m.any()]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r, _ in kept], pa.int64()),
                    pa.array([r[1] for r, _ in kept], pa.int64()),
                    _lists([x for _, x in kept], pa.int32()),
                ],
                names=["anchor", "segment", "runs"],
            )

        for batch in batches:
            held += zip(*(batch.column(c).to_pylist() for c in ("anchor", "segment", "windows", "body")), strict=True)
            while True:
                starts, size, cut, full = 0, 0, 0, False
                for i in range(1, len(held)):
                    starts, size = starts + held[i - 1][2], size + len(held[i - 1][3])
                    full = starts >= STARTS_AT_ONCE or size >= BYTES_AT_ONCE
                    if held[i][0] != held[i - 1][0]:
                        cut = i
                        if full:
                            break
                if not cut or not full:
                    break
                yield solve(held[:cut])
                held = held[cut:]
        if held:
            yield solve(held)

    return sort


# ---- the operator ----------------------------------------------------------------------------


BODY = "anchor long, segment long, windows int, body binary, place int, core long, content long, hashes array<long>"


def slices(body: bytes, windows: int, offset: int, length: int) -> list[tuple[int, int, int, np.ndarray]]:
    """(first window, hash of the bytes all windows of the slice share, hash of all its bytes, window
    hashes) for runs of up to SLICE windows. Slices are cut by distance from the anchor, so equal
    windows stand in slices with equal middles."""
    sums = prefix_hash(BYTE_VALUE[np.frombuffer(body, np.uint8)])
    at = np.arange(windows)
    hashes = span_hash(sums, at, at + length).view(np.int64)
    part = (offset - at) // SLICE
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    last = np.append(first[1:], windows) - 1
    middle = offset - SLICE * part[first]
    core = mix(span_hash(sums, middle, middle - SLICE + 1 + length) ^ part[first].astype(np.uint64)).view(np.int64)
    content = span_hash(sums, first, last + length).view(np.int64)
    return [(int(f), int(c), int(x), hashes[f : t + 1]) for f, t, c, x in zip(first, last, core, content, strict=True)]


def _body_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays(
        [pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), kinds, strict=True)],
        names=["anchor", "segment", "windows", "body", "place", "core", "content", "hashes"],
    )


def _bodies(length: int):
    """Bytes of the wanted segments; hashed slices instead where ``counted``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, wanted in zip(batch.column("text"), batch.column("wanted"), strict=True):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                for w in wanted.as_py():
                    name = (w["anchor"], w["segment"], w["windows"])
                    body = raw[w["start"] : w["start"] + w["windows"] + length - 1]
                    if w["counted"]:
                        out += [(*name, None, *part) for part in slices(body, w["windows"], w["offset"], length)]
                    else:
                        out.append((*name, body, None, None, None, None))
                if len(out) >= ROWS_AT_ONCE:
                    yield _body_rows(out)
                    out = []
            if out:
                yield _body_rows(out)

    return cut


def _counted(bodies: DataFrame) -> DataFrame:
    """(anchor, segment, runs) of sliced segments: repeated windows by counting."""
    parts = bodies.where("hashes IS NOT NULL").select("anchor", "segment", "place", "core", "content", "hashes")
    kinds = stored(parts.groupBy("core", "content").agg(F.count("*").alias("n"), F.first("hashes").alias("hashes")))
    whole = kinds.where("n > 1").select("core", "content", F.sequence(F.lit(0), F.size("hashes") - 1).alias("marks"))
    mixed = stored(kinds.groupBy("core").agg(F.count("*").alias("kinds")).where("kinds > 1").select("core"))
    each = kinds.join(mixed, "core").select("core", "content", F.posexplode("hashes").alias("mark", "hash"))
    again = stored(each.groupBy("hash").agg(F.count("*").alias("times")).where("times > 1").select("hash"))
    some = each.join(again, "hash").groupBy("core", "content").agg(F.collect_set("mark").alias("marks"))
    marks = stored(whole.union(some))
    hit = parts.join(marks, ["core", "content"]).select("anchor", "segment", F.transform("marks", lambda m: F.col("place") + m).alias("places"))
    hit = hit.groupBy("anchor", "segment").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"))
    return hit.select("anchor", "segment", F.flatten(F.transform("places", lambda p: F.array(p, p))).alias("runs"))


def repeated_pieces(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, most_segments: int = MOST_SEGMENTS) -> DataFrame:
    """(tid, n_bytes, whole, pieces) of every text that loses bytes.

    ``whole`` marks texts that have copies; ``pieces`` are (start, windows, runs) of segments with
    repeated strings, ``runs`` being null where all windows of the segment are.
    """
    long = docs.select(*text_id(F.col("text")), F.xxhash64("doc_id").alias("rid"), "text").where(F.col("n_bytes") >= length)
    copies = stored(long.groupBy("tid", "n_bytes").agg(F.count("*").alias("copies"), F.min("rid").alias("rid")))
    table = stored(anchor_table(docs, length, anchor))
    occurrence = F.xxhash64("tid", "n_bytes", "start").alias("occurrence")
    each = table.select("tid", "n_bytes", F.explode(F.arrays_zip("anchor", "segment", "start", "windows", "offset")).alias("s")).select("tid", "n_bytes", "s.*")

    # Anchors in more than one place, and the segments around them.
    many = each.select("anchor", occurrence).groupBy("anchor").agg(F.min("occurrence").alias("lo"), F.max("occurrence").alias("hi"))
    many = stored(many.where("lo <> hi").select("anchor"))
    active = stored(each.join(many, "anchor"))
    kinds = stored(
        active.select("anchor", "segment", occurrence).groupBy("anchor", "segment").agg(F.min("occurrence").alias("lo"), F.max("occurrence").alias("hi"))
    )
    equal = kinds.where("lo <> hi").select("anchor", "segment", F.lit(None).cast("array<int>").alias("runs"))

    # One text of each different segment, where an anchor has several.
    several = stored(kinds.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"))
    wanted = stored(kinds.join(several, "anchor").select("anchor", "segment", "lo", (F.col("n") > most_segments).alias("counted")))
    chosen = active.withColumn("lo", F.xxhash64("tid", "n_bytes", "start")).join(wanted, ["anchor", "segment", "lo"])
    asked = stored(
        chosen.groupBy("tid", "n_bytes").agg(F.collect_set(F.struct("anchor", "segment", "start", "windows", "offset", "counted")).alias("wanted"))
        .join(copies.drop("copies"), ["tid", "n_bytes"])
    )
    texts = long.where(may_hold(docs, id_filter(asked))("tid")).join(asked, ["tid", "n_bytes", "rid"])
    bodies = stored(
        texts.select("text", "wanted").mapInArrow(_bodies(length), BODY)
    )
    groups = bodies.where("body IS NOT NULL").select("anchor", "segment", "windows", "body").repartition("anchor").sortWithinPartitions("anchor")
    sorted_ = groups.mapInArrow(_sort_groups(length), "anchor long, segment long, runs array<int>")

    found = stored(equal.union(sorted_).union(_counted(bodies)))
    pieces = active.select("tid", "n_bytes", "anchor", "segment", "start", "windows").join(found, ["anchor", "segment"])
    pieces = pieces.groupBy("tid", "n_bytes").agg(F.collect_set(F.struct("start", "windows", "runs")).alias("pieces"))
    twins = copies.where("copies > 1").select("tid", "n_bytes", F.lit(True).alias("__twin"))
    return stored(
        pieces.join(twins, ["tid", "n_bytes"], "full").select(
            "tid", "n_bytes", F.coalesce("__twin", F.lit(False)).alias("whole"), F.when(F.col("__twin").isNull(), F.col("pieces")).alias("pieces")
        )
    )


def removed_spans(n_bytes: int, pieces: list[dict], length: int) -> list[tuple[int, int]]:
    """Maximal removed runs from a text's pieces."""
    spans = []
    for p in pieces:
        runs = p["runs"]
        pairs = [(0, p["windows"] - 1)] if runs is None else zip(runs[::2], runs[1::2], strict=True)
        spans += [(p["start"] + a, p["start"] + b + length) for a, b in pairs]
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, min(b, n_bytes)) for a, b in out]


def _finish(length: int):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans_, digests = [], [], []
            # One row's pieces at a time: as Python objects a batch of them is many times its size.
            for text, whole, pieces in zip(*(batch.column(c) for c in ("text", "whole", "pieces")), strict=True):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                spans = [(0, len(raw))] if whole.as_py() else removed_spans(len(raw), pieces.as_py() or [], length)
                digest, at = hashlib.sha256(), 0
                for a, b in spans:
                    digest.update(raw[at:a])
                    at = b
                digest.update(raw[at:])
                removed.append(sum(b - a for a, b in spans))
                spans_.append(len(spans))
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(removed, pa.int64()), pa.array(spans_, pa.int64()), pa.array(digests, pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return finish


def without_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, most_segments: int = MOST_SEGMENTS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs``.

    Null texts are empty. Texts shorter than ``length`` lose nothing; a text with a copy of that
    length loses everything, in every copy; repeated rows are copies. Nothing crosses documents.
    An empty table gives no rows; columns other than doc_id and text are ignored.
    """
    lost = repeated_pieces(docs, length, anchor, most_segments)
    rows = docs.select("doc_id", *text_id(F.col("text")), "text")
    rows = rows.withColumn("__loses", (F.col("n_bytes") >= length) & may_hold(docs, id_filter(lost))("tid"))
    rest = rows.where(~F.col("__loses")).select(
        "doc_id",
        "n_bytes",
        F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"),
        F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"),
    )
    kind = dict(docs.dtypes)["doc_id"]
    cut = rows.where("__loses").drop("__loses").join(lost, ["tid", "n_bytes"], "left").select("doc_id", "n_bytes", "text", "whole", "pieces")
    return cut.mapInArrow(_finish(length), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").union(rest)
