"""N-gram Jaccard join with grouped prefixes.

Shingles are put in one global order, rare first. Two sets that are similar enough must share a
token among their first few, so candidates meet on prefix tokens. Documents with equal sets are
one node; nodes with equal prefixes and sizes are one group, and groups, not documents, are
joined and filtered. Members of the groups that are left are compared by histograms of their
shingles, which bound what two sets can share, and those that pass by their whole sets.

A cluster of near copies would give all its pairs. Only the links that join components are needed,
so every token list is first compared with one pivot (its most copied group), verified links are
merged into components, and only pairs across different components are looked at afterwards. No
pair that could still join two components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgrid.llm.common import (
    LOWER,
    blocks,
    components,
    id_filter,
    may_hold,
    mix,
    prefix_hash,
    span_hash,
    stored,
    text_key,
    utf8,
    word_hashes,
    word_spans,
)

PERCENT = 90
SHINGLE = 3
#: Document frequencies are counted in this many hash buckets: a fixed 2 MB array.
BUCKET_BITS, SLICE_BITS = 18, 12
SALT = np.uint64(0xD6E8FEB86659FD93)
#: A histogram counts about this many shingles a counter, in so many counters of one byte.
PER_COUNTER, LEAST_COUNTERS, MOST_COUNTERS = 8, 64, 4096
EMPTY = np.zeros(0, np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every text: runs of ``size`` lower-cased words, or all the
    words of a shorter text as one; empty without words."""
    for a, b in blocks(offsets):
        low = LOWER[data[offsets[a] : offsets[b]]]
        start, end, row = word_spans(low, offsets[a : b + 1] - offsets[a])
        words = word_hashes(low, start, end)
        sums = prefix_hash(words)
        bounds = np.searchsorted(row, np.arange(b - a + 1))
        full = np.arange(max(0, len(words) - size + 1))
        runs = span_hash(sums, full, full + size)
        for n in range(b - a):
            lo, hi = int(bounds[n]), int(bounds[n + 1])
            if hi - lo >= size:
                own = np.sort(runs[lo : hi - size + 1])
                yield own[np.append(True, own[1:] != own[:-1])]
            elif hi > lo:
                yield span_hash(sums, np.array([lo]), np.array([hi]))
            else:
                yield EMPTY


def bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def bucket_counts(docs: DataFrame, size: int = SHINGLE) -> np.ndarray:
    """Documents per hash bucket of shingles, over all rows: one small sum per task, added up."""
    n, width = 1 << BUCKET_BITS, 1 << SLICE_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for batch in batches:
            for s in shingle_sets(*utf8(batch.column("text")), size):
                total += np.bincount(bucket(s), minlength=n) if len(s) > n // 4 else 0
                if len(s) <= n // 4:
                    np.add.at(total, bucket(s), 1)
        parts = total.reshape(-1, width)
        used = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array([parts[i].tobytes() for i in used], pa.binary())], names=["part", "counts"]
        )

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in batches:
            for c in batch.column("counts"):
                total += np.frombuffer(c.as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()])], names=["part", "counts"])

    parts = docs.select("text").mapInArrow(count, "part int, counts binary")
    out = np.zeros(n, np.int64)
    # At most 2**(BUCKET_BITS - SLICE_BITS) rows of a fixed size reach the driver.
    for part, counts in parts.groupBy("part").applyInArrow(add, "part int, counts binary").collect():
        out[part * width : (part + 1) * width] = np.frombuffer(counts, np.int64)
    return out


def node_id(shingles: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return b"".join(int(mix(shingles ^ s).sum(dtype=np.uint64)).to_bytes(8, "big") for s in (np.uint64(0), SALT))


def prefix_of(shingles: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The rarest n - ceil(percent n / 100) + 1 shingles, rare buckets first, ties by hash."""
    n = len(shingles)
    order = np.argsort(counts[bucket(shingles)], kind="stable")
    return shingles[order[: n + (-percent * n // 100) + 1]]


def histogram(shingles: np.ndarray) -> bytes:
    """Shingles counted by their leading bits; a full counter stands for any number."""
    bits = min(max(LEAST_COUNTERS, len(shingles) // PER_COUNTER), MOST_COUNTERS).bit_length() - 1
    counts = np.bincount((shingles >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def most_shared(first: bytes, second: bytes) -> float:
    """No two sets with these histograms share more shingles: the sum of the lesser counts."""
    a, b = (np.frombuffer(h, np.uint8) for h in (first, second))
    if a.max(initial=0) == 255 or b.max(initial=0) == 255:
        return np.inf
    few = min(len(a), len(b))
    return int(np.minimum(*(x.reshape(few, -1).sum(1, dtype=np.int64) for x in (a, b))).sum())


PROFILE = "doc_id {}, __key string, node binary, __gid long, n long, prefix array<long>, hist binary"


def profiles(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """One row per document: text key, node (its set), group (prefix and size), size, and the prefix,
    which stands once for each group and task."""
    counts = docs.sparkSession.sparkContext.broadcast(bucket_counts(docs, size))

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            nodes, gids, sizes, prefixes, hists = [], [], [], [], []
            for s in shingle_sets(*utf8(batch.column("text")), size):
                p = prefix_of(s, counts.value, percent) if len(s) else s
                nodes.append(node_id(s))
                gid = int(mix(np.append(p, np.uint64(len(s)))).sum(dtype=np.uint64) >> np.uint64(1))
                gids.append(gid)
                sizes.append(len(s))
                hists.append(histogram(s))
                prefixes.append((EMPTY if gid in seen else p).view(np.int64))
                seen.add(gid)
            ends = np.append(0, np.cumsum([len(p) for p in prefixes])).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.int64), *prefixes])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("__key"),
                    pa.array(nodes, pa.binary()),
                    pa.array(gids, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                    pa.array(hists, pa.binary()),
                ],
                names=["doc_id", "__key", "node", "__gid", "n", "prefix", "hist"],
            )

    keyed = docs.select("doc_id", text_key(F.col("text")).alias("__key"), "text")
    return keyed.mapInArrow(profile, PROFILE.format(dict(docs.dtypes)["doc_id"]))


def _id_text(name: str):
    return F.coalesce(F.col(name).cast("string"), F.lit("null"))


def asked_texts(docs: DataFrame, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, partners, pivot, text): one text for each node of the pairs. Texts, not sets, are moved:
    they are shorter, and a set is quickly made of its text."""
    partners = pairs.groupBy(F.col("a").alias("node")).agg(F.collect_set("b").alias("partners"))
    pivots = pairs.select(F.col("b").alias("node"), F.lit(True).alias("pivot")).distinct()
    wanted = stored(partners.join(pivots, "node", "full").join(nodes.select("node", "__text.__id", "__text.__key"), "node"))
    number = F.xxhash64("__id", "__key")
    keyed = docs.select(_id_text("doc_id").alias("__id"), text_key(F.col("text")).alias("__key"), "text")
    # Texts that nobody asks for stay where they are, as far as a filter of fixed size can tell.
    keyed = keyed.where(may_hold(docs, id_filter(wanted.select(number.alias("tid"))))(number))
    # A node has one id and key, so rows that repeat both are dropped where they meet.
    found = keyed.join(wanted, ["__id", "__key"]).dropDuplicates(["__id", "__key"])
    return stored(found.select("node", "partners", "pivot", "text"))


def plausible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose histograms let them share enough; no pair that is similar enough is lost."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("ha", "hb", "na", "nb"))
            good = [most_shared(ha, hb) * (100 + percent) >= percent * (na + nb) for ha, hb, na, nb in zip(*columns, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    def side(x: str) -> DataFrame:
        return nodes.select(F.col("node").alias(x), F.col("hist").alias("h" + x), F.col("n").alias("n" + x))

    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ha", "hb", "na", "nb")
    return stored(met.mapInArrow(check, "a binary, b binary"))


def verified(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, percent: int, size: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets are similar enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, other = None, EMPTY
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, s in enumerate(shingle_sets(*utf8(batch.column("ta")), size)):
                b = batch.column("b")[i].as_py()
                if b != last:
                    last, other = b, next(shingle_sets(*utf8(batch.column("tb").slice(i, 1)), size))
                both = len(np.intersect1d(s, other, assume_unique=True))
                good[i] = 100 * both >= percent * (len(s) + len(other) - both)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    texts = asked_texts(docs, plausible(pairs, nodes, percent), nodes)
    left = texts.select(F.explode("partners").alias("b"), F.col("node").alias("a"), F.col("text").alias("ta"))
    right = texts.where("pivot").select(F.col("node").alias("b"), F.col("text").alias("tb"))
    return stored(left.join(right, "b").select("a", "b", "ta", "tb").mapInArrow(check, "a binary, b binary"))


def _overlap(percent: int):
    """Shingles that two sets of sizes na and nb must share."""
    return F.ceil((F.col("na") + F.col("nb")) * F.lit(percent) / F.lit(100 + percent) - F.lit(1e-6))


def _paired(rows: DataFrame, others: DataFrame, percent: int, condition) -> DataFrame:
    """Pairs that meet on prefix tokens and pass the filters. ``rows`` and ``others``: token, side
    (a or b), n, place.

    Sizes must be near; the first shared token must leave enough tokens on either side, and so
    must the last one together with those shared before it.
    """
    a = rows.select("token", F.col("side").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"), *_extra(rows, "a"))
    b = others.select("token", F.col("side").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb"), *_extra(others, "b"))
    left = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    near = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    met = a.join(b, "token").where(condition & near & (left >= _overlap(percent)))
    pairs = met.groupBy("a", "b").agg(
        F.first("na").alias("na"), F.first("nb").alias("nb"), F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.count("*").alias("shared")
    )
    return pairs.where(F.col("shared") + left - 1 >= _overlap(percent)).select("a", "b")


def _extra(rows: DataFrame, side: str) -> list:
    return [F.col("component").alias(f"c{side}")] if "component" in rows.columns else []


def linked(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(profiles, component of every node that a link touches)."""
    rows = stored(profiles(docs, percent, size))
    nodes = stored(
        rows.where("n > 0")
        .groupBy("node")
        .agg(
            F.count("*").alias("copies"),
            F.min(F.struct(_id_text("doc_id").alias("__id"), "__key")).alias("__text"),
            F.first("__gid").alias("__gid"),
            F.first("n").alias("n"),
            F.first("hist").alias("hist"),
        )
    )
    # Tokens that stand in one group's prefix only are dropped before anything is joined to them.
    sizes = stored(rows.where("n > 0").groupBy("__gid").agg(F.first("n").alias("n"), F.count("*").alias("copies")))
    each = rows.select(F.col("__gid").alias("side"), F.posexplode("prefix").alias("place", "token"))
    shared = each.groupBy("token").agg(F.min("side").alias("lo"), F.max("side").alias("hi")).where("lo <> hi")
    tokens = stored(each.join(stored(shared.select("token")), "token")).dropDuplicates(["token", "side"])
    tokens = stored(tokens.join(sizes.withColumnRenamed("__gid", "side"), "side"))

    # First every list against its most copied group, and every group against its most copied member.
    pivot = stored(tokens.groupBy("token").agg(F.max(F.struct("copies", "side", "n", "place")).alias("__p")))
    pivot = pivot.select("token", F.col("__p.side").alias("side"), F.col("__p.n").alias("n"), F.col("__p.place").alias("place"))
    group_pairs = stored(_paired(tokens, pivot, percent, F.col("a") != F.col("b")))
    lead = stored(nodes.groupBy("__gid").agg(F.max(F.struct("copies", "node")).alias("__m")).select("__gid", F.col("__m.node").alias("__lead")))
    first = group_pairs.join(lead.select(F.col("__gid").alias("a"), F.col("__lead").alias("__x")), "a").join(
        lead.select(F.col("__gid").alias("b"), F.col("__lead").alias("__y")), "b"
    )
    inside = nodes.join(lead, "__gid").where("node <> __lead").select(F.col("node").alias("a"), F.col("__lead").alias("b"))
    pairs = stored(first.select(F.col("__x").alias("a"), F.col("__y").alias("b")).union(inside))
    links = verified(docs, pairs, nodes, percent, size)
    found = stored(components(links, "a", "b"))

    # Then pairs of nodes across components, from the lists and groups that more than one reaches.
    known = nodes.join(found, "node", "left").select("node", "__gid", "n", F.coalesce("component", "node").alias("component"))
    known = stored(known)
    spread = known.groupBy("__gid").agg(F.min("component").alias("__low"), F.max("component").alias("__high"))
    wide = stored(tokens.join(stored(spread), tokens["side"] == F.col("__gid")).drop("__gid"))
    open_lists = stored(wide.groupBy("token").agg(F.min("__low").alias("__l"), F.max("__high").alias("__h")).where("__l <> __h").select("token"))
    members = known.select(F.col("__gid").alias("side"), "node", "component")
    opened = stored(
        tokens.join(open_lists, "token").join(members, "side").select("token", F.col("node").alias("side"), "n", "place", "component")
    )
    across = _paired(opened, opened, percent, (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")))
    # Members of one group need no token of another group to meet.
    torn = stored(spread.where("__low <> __high").select("__gid"))
    apart = stored(known.join(torn, "__gid").select("__gid", "node", "component"))
    twin = apart.select("__gid", F.col("node").alias("b"), F.col("component").alias("cb"))
    within = apart.withColumnsRenamed({"node": "a", "component": "ca"}).join(twin, "__gid").where("a < b AND ca <> cb").select("a", "b")
    tried = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = stored(across.union(within).distinct().join(stored(tried), ["a", "b"], "left_anti"))
    more = verified(docs, rest, nodes, percent, size)
    if more.limit(1).count():
        found = stored(components(links.union(more), "a", "b"))
    return rows, nodes.select("node", "copies").join(found, "node", "left")


def with_components(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, __key) for every row of ``docs``.

    A-Z are lower-cased; null and empty texts and those without words have no shingles, link with
    nothing, and are components of their own. Equal sets always link. Ties and repeated rows fall
    into one component. Documents with null ids take the smallest id their component has, or
    null. An empty table gives no rows; columns other than doc_id and text are ignored.
    """
    rows, nodes = linked(docs, percent, size)
    joined = stored(nodes.where("copies > 1 OR component IS NOT NULL").select("node", F.coalesce("component", "node").alias("__c")))
    ids = stored(rows.select("doc_id", "__key", "n", "node").join(joined, "node", "left"))
    least = stored(ids.where("__c IS NOT NULL").groupBy("__c").agg(F.min("doc_id").alias("__least")))
    return ids.join(least, "__c", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("__c").isNull(), F.col("doc_id")).otherwise(F.col("__least")).alias("component_id"),
        "__key",
        "__c",
    )


def jaccard_components(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """The contract's columns of :func:`with_components`."""
    return with_components(docs, percent, size).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, percent: int, size: int) -> DataFrame:
    """The rows of ``docs``, all columns, one for each component: that of the least id, then the
    least text key. Documents without words all stay. Rows repeated with id and text count as one."""
    found = with_components(docs, percent, size)
    lone = F.coalesce(F.concat(_id_text("doc_id"), F.lit("/"), F.col("__key")), F.lit(""))
    ranked = found.where("n_shingles > 0").groupBy(F.coalesce(F.hex("__c"), lone).alias("__of")).agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("__none"), "doc_id", "__key")).alias("__k")
    )
    keep = stored(ranked.select(_id_text("__k.doc_id").alias("__id"), F.col("__k.__key").alias("__key")))
    words = F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    row = F.struct(*docs.columns).alias("__row")  # whatever its columns are called
    keyed = docs.where(words).select(_id_text("doc_id").alias("__id"), text_key(F.col("text")).alias("__key"), row)
    kept = keyed.join(keep, ["__id", "__key"], "left_semi").dropDuplicates(["__id", "__key"]).select("__row.*")
    return kept.union(docs.where(~words))
