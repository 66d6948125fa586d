"""Helpers shared by the text operators: shared storage, byte-level tokens, hashing, components."""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgrid.session import checkpoint_dir

#: White space of the word pattern ``[^\x20\x09-\x0D]+``.
SPACES = " \t\n\x0b\x0c\r"
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"
_LOCAL: dict[str, str] = {}


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers on this machine find the package; a cluster ships it with --py-files."""
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    return spark


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; in local mode without it, one scratch folder per application."""
    if spark.conf.get("spark.checkpoint.dir", None):
        return checkpoint_dir(spark)
    return _LOCAL.setdefault(spark.sparkContext.applicationId, checkpoint_dir(spark))


def stored(df: DataFrame) -> DataFrame:
    """The rows written as a table in the shared folder and read back: cuts lineage, survives lost
    executors, and lets AQE see real sizes and split skewed joins on either side."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def text_key(text: Column) -> Column:
    """128-bit content key of a text; null and empty texts share one."""
    return F.md5(F.coalesce(text, F.lit("")))


def word_array(text: Column) -> Column:
    """All words of the whole text, as Spark expressions."""
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x09-\\x0D]", " ")
    return F.array_remove(F.split(flat, " "), "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


# ---- bytes and tokens in numpy -------------------------------------------------------------

_RANDOM = np.random.Generator(np.random.PCG64(20240229))
#: One random 64-bit value per byte, and the odd base of the rolling hash with its inverse.
BYTE_VALUE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64)
BASE = np.uint64(int(_RANDOM.integers(1, 2**62)) * 2 + 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
IS_WORD = np.array([chr(b) not in SPACES for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    with np.errstate(over="ignore"):
        up, down = (np.full(n, x, np.uint64) for x in (BASE, BASE_INVERSE))
        for a in (up, down):
            a[0] = 1
            np.multiply.accumulate(a, out=a)
    return up, down


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the hash base and of its inverse, modulo 2**64."""
    return _powers(max(12, int(n).bit_length()))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Sums c with c[j] - c[i] = hash of values[i:j] times BASE**i."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end], independent of where the span stands."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start])


def utf8(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; nulls are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], pa.string())
    array = array.cast(pa.large_binary())
    if array.null_count:
        array = array.fill_null(b"")
    _, offsets, data = array.buffers()
    bounds = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    if not len(bounds):
        bounds = np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def blocks(offsets: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``most`` bytes; a longer single text is a run of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = IS_WORD):
    """Start and end of every word and the row it stands in; words never cross rows."""
    inside = table[data]
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    start = np.flatnonzero(inside & (~before | border[:-1]))
    end = np.flatnonzero(inside & (~after | border[1:])) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return span_hash(prefix_hash(BYTE_VALUE[data]), start, end)


# ---- semi-join reduction ---------------------------------------------------------------------

FILTER_BITS = 24


def _filter_places(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = mix(ids.view(np.uint64))
    shift = np.uint64(64 - FILTER_BITS)
    return (h >> shift).astype(np.int64), ((h * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)


def id_filter(ids: DataFrame) -> np.ndarray:
    """A fixed 2 MB Bloom filter of the column ``tid``, built by the tasks and merged by slices.

    It only spares the shuffle of texts that have no partner; a full filter lets all pass.
    """
    width = 1 << (FILTER_BITS - 6)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            for place in _filter_places(batch.column("tid").to_numpy(zero_copy_only=False).astype(np.int64)):
                bits[place] = True
        parts = bits.reshape(-1, width)
        used = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array([np.packbits(parts[i]).tobytes() for i in used], pa.binary())], names=["part", "bits"]
        )

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width // 8, np.uint8)
        for batch in batches:
            for b in batch.column("bits"):
                total |= np.frombuffer(b.as_py(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()])], names=["part", "bits"])

    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    built = ids.select("tid").mapInArrow(build, "part int, bits binary").groupBy("part").applyInArrow(merge, "part int, bits binary")
    for part, bits in built.collect():  # 64 rows of 32 KB at most
        out[part * width // 8 : (part + 1) * width // 8] = np.frombuffer(bits, np.uint8)
    return out


def may_hold(docs: DataFrame, bits: np.ndarray):
    """A condition on ``tid``: whether the filter may hold it."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def test(ids: pa.Array) -> pa.Array:
        if isinstance(ids, pa.ChunkedArray):
            ids = ids.combine_chunks()
        out = np.ones(len(ids), bool)
        for p in _filter_places(np.ascontiguousarray(ids.to_numpy(zero_copy_only=False), np.int64)):
            out &= (shared.value[p >> 3] >> (7 - (p & 7)).astype(np.uint8) & 1).astype(bool)
        return pa.array(out)

    return F.arrow_udf(test, "boolean")


# ---- connected components ------------------------------------------------------------------


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component): the smallest node reachable over the edges, for every node of an edge.

    Labels start at the node, take the least label among the neighbours, then follow their own
    label (pointer jumping), so long chains shrink by doubling. Every round is stored in the
    shared folder; nothing but one counter reaches the driver.
    """
    one_way = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a <> b")
    links = stored(one_way.union(one_way.select("b", "a")).distinct())
    labels = stored(
        links.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component"))
    )
    while True:
        near = stored(
            links.join(labels.select(F.col("node").alias("b"), "component"), "b")
            .groupBy("a")
            .agg(F.min("component").alias("near"))
        )
        best = stored(
            labels.join(near, labels["node"] == near["a"], "left").select(
                "node", F.col("component").alias("old"), F.least("component", "near").alias("component")
            )
        )
        jump = best.select(F.col("node").alias("component"), F.col("component").alias("next"))
        labels = stored(
            best.join(jump, "component", "left").select(
                "node", "old", F.least("component", F.coalesce("next", "component")).alias("component")
            )
        )
        if labels.where("old <> component").limit(1).count() == 0:
            return labels.select("node", "component")
        labels = labels.select("node", "component")


# ---- labelled samples ----------------------------------------------------------------------


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: tuple[int, int], max_bytes: int
) -> list[tuple[str, int]]:
    """A bounded sample of (text, label): for classes 0 and 1 the first ``per_class`` documents in hash
    order among rows of ``labels`` that ``learn`` admits, with texts of at most ``max_bytes`` bytes.

    A document labelled both ways counts as 1; of repeated rows the least text stands for all. At
    most ``2 * per_class * max_bytes`` bytes reach the driver.
    """
    known = known_labels(labels, label, learn)
    picked = None
    for y in (0, 1):
        part = known.where(F.col("__label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class[y])
        picked = part if picked is None else picked.union(part)
    short = docs.select("doc_id", "text").where(F.octet_length("text") <= max_bytes)
    # At most sum(per_class) ids.
    rows = short.join(F.broadcast(stored(picked)), "doc_id").groupBy("doc_id", "__label").agg(F.min("text").alias("text"))
    return [(r["text"], r["__label"]) for r in sorted(rows.collect(), key=lambda r: r["doc_id"])]


def known_labels(labels: DataFrame, label: str, learn: Column) -> DataFrame:
    """(doc_id, __label) of the labelled ids that ``learn`` admits; an id labelled both ways counts as 1."""
    value = F.col(label).cast("int")
    known = labels.where(learn & value.isin(0, 1) & F.col("doc_id").isNotNull())
    return known.groupBy("doc_id").agg(F.max(value).alias("__label"))


def prior_shift(labels: DataFrame, label: str, learn: Column, per_class: tuple[int, int]) -> float:
    """What the caps of ``labelled_sample`` take from the log-odds of class 1, to be added to a logit.

    A row of a class stands for all admissible labels of the class over those the cap lets through,
    so scores mean the same whatever the size of the label table. 0 while no cap is full.
    """
    counts = known_labels(labels, label, learn).groupBy("__label").agg(F.count("*").alias("n"))
    number = {r["__label"]: r["n"] for r in counts.collect()}
    each = [max(1.0, number.get(y, 0) / per_class[y]) for y in (0, 1)]
    return math.log(each[1] / each[0])


def bucket_of_id(doc_id: Column, modulus: int) -> Column:
    """CRC-32 of the id as text, modulo; null ids have none."""
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(modulus))


class Adam:
    """Adam steps on a dictionary of float32 arrays."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float):
        self.w, self.rate, self.t = weights, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.w[k] -= (scale * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5
