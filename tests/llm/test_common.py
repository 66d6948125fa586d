"""Byte helpers, hashing and components against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from claimgrid.llm import common

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab é中\n\t .", max_size=30)), min_size=1, max_size=8)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_word_spans(texts):
    data, offsets = common.utf8(pa.array(texts, pa.string()))
    start, end, row = common.word_spans(data, offsets)
    got = [(int(n), bytes(data[a:b]).decode()) for a, b, n in zip(start, end, row)]
    want = [(n, w) for n, t in enumerate(texts) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    assert got == want
    hashes = common.word_hashes(data, start, end)
    assert len(set(hashes.tolist())) == len({w for _, w in want})


def test_sliced_and_chunked_arrays():
    whole = pa.array(["ab", None, "cde", "", "f"])
    for part in (whole.slice(1, 3), pa.chunked_array([whole.slice(0, 2), whole.slice(2)]), pa.chunked_array([], pa.string())):
        data, offsets = common.utf8(part)
        assert [bytes(data[a:b]).decode() for a, b in zip(offsets, offsets[1:])] == [x or "" for x in part.to_pylist()]


def test_blocks_cover_all_rows():
    offsets = np.array([0, 5, 5, 100, 103, 110])
    runs = list(common.blocks(offsets, 10))
    assert [x for a, b in runs for x in range(a, b)] == list(range(5))


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components(spark, shape):
    r = random.Random(1)
    edges = {
        "chain": [(i, i + 1) for i in range(40)],
        "star": [(100, i) for i in range(50)],
        "random": [(r.randrange(80), r.randrange(80)) for _ in range(45)],
    }[shape] + [(7, 7), (1, 0), (0, 1)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = dict(common.components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect())
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}


def test_components_of_nothing(spark):
    assert common.components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0
