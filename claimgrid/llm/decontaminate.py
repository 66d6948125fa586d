"""Benchmark decontamination by greedy string tiling.

Seeds are the runs of ``k`` tokens of the test items. Documents that share seeds with an item are
tiled against it: the longest common runs of unmarked tokens, found by running Karp-Rabin with a
falling search length, are marked again and again, so reordered passages are still found. A
document is contaminated when the tiles of some item cover enough of the item's tokens. An item of
fewer tokens than a seed is matched by its whole run, in documents that are little more than it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgrid.llm.common import LOWER, blocks, prefix_hash, span_hash, stored, utf8, word_hashes, word_spans

SEED_TOKENS = 6
MIN_COVERAGE = 0.5
#: Bytes of benchmark text that one block of items may hold; more items mean more blocks.
BLOCK_BYTES = 16 << 20

#: Token bytes: ASCII letters and digits and everything beyond ASCII.
TOKEN = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])

MATCHES = "array<struct<item:int,covered:int,tiles:int>>"


def token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every lower-cased token and the row it stands in."""
    low = LOWER[data]
    start, end, row = word_spans(low, offsets, TOKEN)
    return word_hashes(low, start, end), row


def run_hashes(tokens: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``length`` tokens."""
    n = len(tokens) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    start = np.arange(n)
    return span_hash(prefix_hash(tokens), start, start + length)


def tile(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (length, position in doc, position in item), longest first, non-overlapping.

    Searches runs of ``size`` unmarked tokens by their hashes, extends them, marks the longest
    first, and lowers ``size`` down to ``least``. A match that a longer one has cut into is found
    again in what is left of it.
    """
    free_doc, free_item = np.ones(len(doc), bool), np.ones(len(item), bool)
    tiles: list[tuple[int, int, int]] = []
    size = max(least, len(item))
    while True:
        found = []
        at_item: dict[int, list[int]] = {}
        for j, h in enumerate(run_hashes(item, size).tolist()):
            if free_item[j : j + size].all():
                at_item.setdefault(h, []).append(j)
        hashes = run_hashes(doc, size)
        hits = np.flatnonzero(np.isin(hashes, np.fromiter(at_item, np.uint64, len(at_item)))) if at_item else []
        for i in map(int, hits):
            if not free_doc[i : i + size].all():
                continue
            for j in at_item[int(hashes[i])]:
                if i and j and free_doc[i - 1] and free_item[j - 1] and doc[i - 1] == item[j - 1]:
                    continue  # the same run was found one token earlier
                n = 0
                while i + n < len(doc) and j + n < len(item) and free_doc[i + n] and free_item[j + n] and doc[i + n] == item[j + n]:
                    n += 1
                if n >= size:
                    found.append((n, i, j))
        cut = False
        for n, i, j in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
            if free_doc[i : i + n].all() and free_item[j : j + n].all():
                free_doc[i : i + n] = free_item[j : j + n] = False
                tiles.append((n, i, j))
            else:
                cut = True
        if cut:
            continue  # remainders of this size may be left
        if size == least:
            return tiles
        size = max(least, size // 2)


def _found(tokens: np.ndarray, row: np.ndarray, length: int, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token position, place in ``runs``) of the runs of ``length`` tokens in the sorted ``runs``."""
    h = run_hashes(tokens, length)
    none = np.zeros(0, np.int64)
    if not len(h) or not len(runs):
        return none, none
    whole = row[: len(h)] == row[length - 1 :]
    first = np.searchsorted(runs, h)
    hit = np.flatnonzero(whole & (runs[np.minimum(first, len(runs) - 1)] == h))
    first = first[hit]
    n = np.searchsorted(runs, h[hit], "right") - first
    return np.repeat(hit, n), np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


class Items:
    """A block of test items as token hashes, with their sorted seeds.

    ``short`` holds the whole runs of items of fewer than ``k`` tokens, by length.
    """

    def __init__(self, texts: list[str | None], k: int):
        data, offsets = utf8(pa.array([t or "" for t in texts], pa.string()))
        tokens, row = token_hashes(data, offsets)
        bounds = np.searchsorted(row, np.arange(len(texts) + 1))
        self.k = k
        self.tokens = [tokens[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        seeds, owner, place = [], [], []
        runs: dict[int, list[tuple[int, int]]] = {}
        for n, t in enumerate(self.tokens):
            if 0 < len(t) < k:
                runs.setdefault(len(t), []).append((int(run_hashes(t, len(t))[0]), n))
            h = run_hashes(t, k)
            seeds.append(h)
            owner.append(np.full(len(h), n))
            place.append(np.arange(len(h)))
        empty = np.zeros(0, np.int64)
        seed = np.concatenate([np.zeros(0, np.uint64), *seeds])
        order = np.argsort(seed, kind="stable")
        self.seed = seed[order]
        self.owner = np.concatenate([empty, *owner]).astype(np.int64)[order]
        self.place = np.concatenate([empty, *place]).astype(np.int64)[order]
        self.short = {
            length: (np.array([h for h, _ in sorted(found)], np.uint64), np.array([n for _, n in sorted(found)]))
            for length, found in runs.items()
        }

    def shared(self, tokens: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(token position, item, position in item) of every seed and short item that the tokens hold."""
        hit, at = _found(tokens, row, self.k, self.seed)
        parts = [(hit, self.owner[at], self.place[at])]
        for length, (runs, owner) in self.short.items():
            hit, at = _found(tokens, row, length, runs)
            parts.append((hit, owner[at], np.zeros(len(hit), np.int64)))
        pos, item, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(pos, kind="stable")
        return pos[order], item[order], place[order]

    def matches(self, tokens: np.ndarray, hits: tuple[np.ndarray, np.ndarray, np.ndarray], coverage: float):
        """(item, covered tokens, tiles) for the items that one document covers far enough."""
        pos, item, place = hits
        out = []
        for n in np.unique(item):
            own = item == n
            size = len(self.tokens[n])
            if size < self.k:  # its whole run was found; in a long text that is no evidence
                if size >= coverage * len(tokens):
                    out.append({"item": int(n), "covered": size, "tiles": 1})
                continue
            least = coverage * size
            possible = np.zeros(size, bool)  # tiles are made of shared seeds: an upper bound
            near = np.zeros(len(tokens), bool)
            for d in range(self.k):
                possible[np.minimum(place[own] + d, size - 1)] = True
                near[np.minimum(pos[own] + d, len(tokens) - 1)] = True
            if possible.sum() < least:
                continue
            # Only the stretches that hold seeds can be tiled; a mark no item has keeps them apart.
            kept = np.flatnonzero(near)
            gap = np.flatnonzero(np.diff(kept) > 1) + 1
            region = np.insert(tokens[kept], gap, np.uint64(0))
            tiles = tile(region, self.tokens[n], self.k)
            covered = sum(t[0] for t in tiles)
            if covered >= least:
                out.append({"item": int(n), "covered": covered, "tiles": len(tiles)})
        return out


def _matcher(items, coverage: float):
    def match(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("item", pa.int32()), ("covered", pa.int32()), ("tiles", pa.int32())]))
        for batch in batches:
            data, offsets = utf8(batch)
            out: list = []
            for a, b in blocks(offsets):
                own = offsets[a : b + 1] - offsets[a]
                tokens, row = token_hashes(data[offsets[a] : offsets[b]], own)
                hits = items.value.shared(tokens, row)
                bounds = np.searchsorted(row, np.arange(b - a + 1))
                cut = np.searchsorted(hits[0], bounds)
                for n in range(b - a):
                    lo, hi = cut[n], cut[n + 1]
                    if lo == hi:
                        out.append([])
                        continue
                    mine = (hits[0][lo:hi] - bounds[n], hits[1][lo:hi], hits[2][lo:hi])
                    out.append(items.value.matches(tokens[bounds[n] : bounds[n + 1]], mine, coverage))
            yield pa.array(out, kind)

    return F.arrow_udf(match, MATCHES)


def block_count(benchmark: DataFrame, block_bytes: int) -> int:
    """Hash blocks that keep each near half of ``block_bytes`` of text, the size being measured."""
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, n: int | None = None) -> Iterator[list]:
    """The test items in hash blocks of a bounded size, one gathered after the other."""
    n = n or block_count(benchmark, block_bytes)
    for b in range(n):
        part = benchmark if n == 1 else benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        rows = part.select("item_id", "text").where("text is not null").distinct().collect()
        yield sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def _block_by_block(docs: DataFrame, benchmark: DataFrame, k: int) -> Iterator[tuple[list, object, bool]]:
    """(rows, broadcast items, whether more follow); a block is released when the next one is asked for."""
    n = block_count(benchmark, BLOCK_BYTES)
    for b, rows in enumerate(item_blocks(benchmark, BLOCK_BYTES, n)):
        items = docs.sparkSession.sparkContext.broadcast(Items([r[1] for r in rows], k))
        yield rows, items, b + 1 < n
        if b + 1 < n:
            items.destroy()


def contaminated_pairs(
    docs: DataFrame, benchmark: DataFrame, k: int = SEED_TOKENS, coverage: float = MIN_COVERAGE
) -> DataFrame:
    """(doc_id, item_id, item_tokens, covered_tokens, n_tiles, coverage) of every document and test
    item with coverage at or above the limit.

    Tokens are runs of letters, digits and non-ASCII characters, A-Z lower-cased. Null and empty
    texts, and items without a token, match nothing. An item of fewer than ``k`` tokens matches the
    documents that hold its whole run and of whose own tokens it is at least ``coverage``. Repeated
    rows give repeated pairs, repeated items one. Documents are never shuffled. Items come in blocks
    whose size is measured before they are broadcast; a block's pairs are written, and the block
    released, before the next one is gathered.
    """
    out = None
    for rows, items, more in _block_by_block(docs, benchmark, k):
        found = docs.select("doc_id", F.explode(_matcher(items, coverage)("text")).alias("m"))
        names = docs.sparkSession.createDataFrame(
            [(n, r[0], len(t)) for n, (r, t) in enumerate(zip(rows, items.value.tokens, strict=True))],
            f"item int, item_id {dict(benchmark.dtypes)['item_id']}, item_tokens int",
        )
        part = found.select("doc_id", "m.*").join(F.broadcast(names), "item")
        part = stored(part) if more else part
        out = part if out is None else out.union(part)
    return out.select(
        "doc_id",
        "item_id",
        "item_tokens",
        F.col("covered").alias("covered_tokens"),
        F.col("tiles").alias("n_tiles"),
        (F.col("covered") / F.col("item_tokens")).alias("coverage"),
    )


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, k: int = SEED_TOKENS, coverage: float = MIN_COVERAGE
) -> DataFrame:
    """The rows of ``docs``, all columns, that no test item contaminates; blocks as above."""
    for _, items, more in _block_by_block(docs, benchmark, k):
        docs = docs.where(F.size(_matcher(items, coverage)("text")) == 0)
        docs = stored(docs) if more else docs
    return docs
