"""Removal of earlier word sequences against brute force."""

import hashlib
import random

import pytest
from fixtures import awkward_texts, frame, plain, sentence

from claimgrid.llm import block_repeats
from claimgrid.llm.block_repeats import WINDOW


def brute(rows):
    words = [(t or "").encode().split() for _, t, _ in rows]
    least = {}
    for (i, _, _), w in zip(rows, words):
        for k in range(len(w) - WINDOW + 1):
            if i is not None:
                g = tuple(w[k : k + WINDOW])
                least[g] = min(i, least.get(g, i))
    out = []
    for (i, _, _), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - WINDOW + 1):
            if i is not None and least[tuple(w[k : k + WINDOW])] < i:
                gone |= set(range(k, k + WINDOW))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("gathered", [1 << 21, 50])
@pytest.mark.parametrize("bucket", [24_000_000, 4_000])
def test_awkward_texts(spark, gathered, bucket):
    """In few and many buckets, settled by one task at once and in many parts."""
    rows = [(i, t if not t or len(t) < 50_000 else t[-9000:], s) for i, t, s in awkward_texts(5)]
    rows += [(9000, rows[0][1], "s"), (2, rows[1][1] + " tail", "s"), (9001, None, "s"), (9000, sentence(random.Random(1), 40), "s")]
    want = brute(rows)
    assert sum(r[2] > 0 for r in want) > 20
    assert plain(block_repeats.without_earlier(frame(spark, rows), bucket, gathered)) == want


def test_small_vocabulary(spark):
    """Shared runs at every offset, of every length around a window, within and across texts."""
    r = random.Random(8)
    passages = [sentence(r, n, 9000) for n in (12, 13, 14, 19, 20, 26, 40)]
    rows = [(r.randrange(60), " ".join(r.choice([*passages, sentence(r, r.randrange(1, 9), 3)]) for _ in range(r.randrange(1, 7))), "s") for _ in range(80)]
    assert plain(block_repeats.without_earlier(frame(spark, rows))) == brute(rows)


def test_planted_passages(spark):
    """Every later copy of a passage goes whole; unplanted documents lose nothing."""
    r = random.Random(2)
    passage = sentence(r, 70, 9000)
    rows = []
    for i in range(40):
        planted = passage + " " if i % 3 == 0 else ""
        rows.append((i, f"own{i} " + sentence(r, 30, 9000) + f" before{i} " + planted + f"after{i} " + sentence(r, 30, 9000), "s"))
    got = {row.doc_id: row.n_removed for row in block_repeats.without_earlier(frame(spark, rows)).collect()}
    assert got == {i: 70 if i % 3 == 0 and i else 0 for i in range(40)}


def test_nothing(spark):
    assert block_repeats.without_earlier(frame(spark, [(1, "x", "s")]).where("false")).count() == 0
    alone = block_repeats.without_earlier(frame(spark, [(1, None, "s"), (None, "a b", "s")]))
    assert plain(alone) == brute([(1, None, "s"), (None, "a b", "s")])
