"""Decontamination, similarity join and repeated strings against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from fixtures import awkward_texts, frame, plain, sentence
from hypothesis import given, settings
from hypothesis import strategies as st

from claimgrid.llm import decontaminate, prefix_join, suffix_dedup

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute_components(rows, percent, size):
    sets = [shingles(t, size) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if sets[x] and sets[y] and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                parent[root(x)] = root(y)
    least = {}
    for x, (i, _, _) in enumerate(rows):
        if i is not None:
            least[root(x)] = min(i, least.get(root(x), i))
    return sets, [root(x) for x in range(len(rows))], least


@pytest.mark.parametrize("percent,size", [(90, 3), (80, 5)])
def test_similarity_components(spark, percent, size):
    rows = awkward_texts()
    sets, roots, least = brute_components(rows, percent, size)
    want = sorted(
        ((i, len(s), least.get(r) if s else i) for (i, _, _), s, r in zip(rows, sets, roots)), key=repr
    )
    assert plain(prefix_join.jaccard_components(frame(spark, rows), percent, size)) == want


def test_star_of_variants_and_one_document_each(spark):
    r = random.Random(5)
    base = sentence(r, 120, 9000).split()
    rows = [(0, " ".join(base), "s")]
    for i in range(25):  # like the base, not like each other
        words = list(base)
        for at in r.sample(range(120), 2):
            words[at] = f"v{i}x{at}"
        rows.append((i + 1, " ".join(words), "s"))
    rows += [(50, "", "s"), (51, "", "s"), (52, None, "s")]
    sets, roots, _ = brute_components(rows, 90, 3)
    kept = prefix_join.one_of_each(frame(spark, rows), 90, 3)
    assert kept.columns == frame(spark, rows).columns
    groups = {root for root, s in zip(roots, sets) if s}
    assert kept.count() == len(groups) + 3
    assert 0 in {x.doc_id for x in kept.collect()}


def test_members_of_one_group(spark):
    """Equal rare prefixes and sizes: two members are alike, but neither is like the most copied one."""
    common = [f"c{i}" for i in range(40)]
    rows = []
    for i in range(30):  # makes the common words frequent, in an order of its own
        r = random.Random(i)
        rows.append((100 + i, " ".join(r.sample(common, 40)), "s"))
    head = " ".join(f"rare{i}" for i in range(30))
    tail = lambda seed: " ".join(random.Random(seed).choices(common, k=25))
    other = tail(2)
    rows += [(1, head + " " + tail(1), "s"), (2, head + " " + tail(1), "s"), (3, head + " " + other, "s"), (4, head + " " + other + " c1", "s")]
    for percent in (60, 80):
        sets, roots, least = brute_components(rows, percent, 1)
        want = sorted(((i, len(s), least.get(r)) for (i, _, _), s, r in zip(rows, sets, roots)), key=repr)
        assert plain(prefix_join.jaccard_components(frame(spark, rows), percent, 1)) == want


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 40_000), st.integers(0, 40_000), st.floats(0, 1), st.integers(0, 2**32))
def test_histograms_bound_the_overlap(n, m, share, seed):
    r = np.random.Generator(np.random.PCG64(seed))
    a = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
    b = np.unique(np.concatenate([a[: int(share * len(a))], r.integers(0, 2**64, m, dtype=np.uint64)]))
    if seed % 5 == 0:  # all in one counter
        a, b = a >> np.uint64(20), b >> np.uint64(20)
    shared = len(np.intersect1d(a, b))
    bound = prefix_join.most_shared(prefix_join.histogram(a), prefix_join.histogram(b))
    assert shared <= bound


def test_histograms_tell_strangers_apart():
    r = np.random.Generator(np.random.PCG64(1))
    for n in (300, 1000, 5000, 20_000):
        a, b = (prefix_join.histogram(r.integers(0, 2**64, n, dtype=np.uint64)) for _ in range(2))
        assert prefix_join.most_shared(a, b) * 190 < 90 * 2 * n


def test_no_documents(spark):
    empty = frame(spark, [(1, "x", "s")]).where("false")
    assert prefix_join.jaccard_components(empty).count() == 0
    assert suffix_dedup.without_repeats(empty).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated_pairs(empty, items).count() == 0


# ---- repeated strings ----------------------------------------------------------------------


def brute_repeats(rows, length):
    raw = [(t or "").encode() for _, t, _ in rows]
    seen = collections.Counter(r[s : s + length] for r in raw for s in range(len(r) - length + 1))
    out = []
    for (i, _, _), r in zip(rows, raw):
        gone = np.zeros(len(r), bool)
        for s in range(len(r) - length + 1):
            if seen[r[s : s + length]] > 1:
                gone[s : s + length] = True
        kept = bytes(b for b, g in zip(r, gone) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("length,anchor,most", [(40, 16, 256), (40, 16, 3), (400, 64, 256)])
def test_repeated_strings(spark, length, anchor, most):
    rows = [(i, t if not t or len(t) < 50_000 else t[-9000:], s) for i, t, s in awkward_texts(4)]
    got = suffix_dedup.without_repeats(frame(spark, rows), length, anchor, most)
    assert plain(got) == brute_repeats(rows, length)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab\x00c", min_size=1, max_size=14), min_size=1, max_size=6), st.data())
def test_suffix_order(strings, data):
    bodies = [s.encode() for s in strings]
    ends = np.repeat(np.cumsum([len(b) for b in bodies]), [len(b) for b in bodies])
    text = b"".join(bodies)
    wanted = np.array(data.draw(st.lists(st.booleans(), min_size=len(text), max_size=len(text))))
    order = suffix_dedup.suffix_order(text, ends, wanted, 100)
    kept = [i for i in order.tolist() if wanted[i]]
    assert sorted(kept) == np.flatnonzero(wanted).tolist()
    suffixes = [text[i : ends[i]] for i in kept]
    assert suffixes == sorted(suffixes)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab", min_size=1, max_size=40), st.integers(1, 9), st.randoms())
def test_common_prefixes(text, length, r):
    order = list(range(max(0, len(text) - length + 1)))
    r.shuffle(order)
    got = suffix_dedup.common_prefixes(np.frombuffer(text.encode(), np.uint8), np.array(order, np.int64), length)
    want = []
    for a, b in zip(order, order[1:]):
        n = 0
        while n < length and text[a + n] == text[b + n]:
            n += 1
        want.append(n)
    assert got.tolist() == want


def test_planted_passages_of_400_bytes(spark):
    """Runs of 400 bytes or more go from every copy; shorter ones stay, unplanted documents lose nothing."""
    r = random.Random(12)
    passages = [sentence(r, n, 9000) for n in (50, 55, 60, 70, 80, 90)]
    passages = [p for p in passages if len(p.encode()) >= 400] + [p[:399] for p in passages if len(p.encode()) >= 400]
    assert len(passages) >= 4
    rows, planted = [], {}
    for i in range(90):
        put = passages[i // 2 % len(passages)] if i % 2 else ""
        # The bytes on both sides differ from copy to copy, so only the passage repeats.
        rows.append((i, f"{sentence(r, 40, 9000)} <{i}{chr(48 + i // 2)}{put}{chr(48 + i // 2)}{i}> {sentence(r, 40, 9000)}", "s"))
        planted[i] = len(put.encode()) if len(put.encode()) >= 400 else 0
    got = {x.doc_id: (x.n_removed, x.n_spans) for x in suffix_dedup.without_repeats(frame(spark, rows)).collect()}
    assert got == {i: (n, int(n > 0)) for i, n in planted.items()}


# ---- decontamination -----------------------------------------------------------------------


def tokens(text):
    return re.findall(r"(?:[A-Za-z0-9]|[^\x00-\x7f])+", (text or "").translate(LOW))


def brute_coverage(doc, item, least):
    """Greedy string tiling by definition: always the longest match of unmarked tokens."""
    free_a, free_b, covered = [True] * len(doc), [True] * len(item), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and free_a[i + n] and free_b[j + n] and doc[i + n] == item[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return covered
        for d in range(n):
            free_a[i + d] = free_b[j + d] = False
        covered += n


def test_contaminated_pairs(spark):
    r = random.Random(9)
    items = [(n, sentence(r, r.randrange(20, 50), 3000)) for n in range(8)] + [(8, None), (9, ""), (10, "too few words"), (None, sentence(r, 30))]
    docs = awkward_texts()[:20] + [(500, None, None), (501, "", None)]
    for n, (_, text) in enumerate(items[:8]):
        w = text.split()
        half = len(w) // 2
        docs.append((600 + n, sentence(r, 30) + " " + text.upper() + ", " + sentence(r, 30), "s"))
        docs.append((700 + n, " ".join(w[half:]) + " " + sentence(r, 9) + " " + " ".join(w[:half]), "s"))  # reordered
        docs.append((800 + n, sentence(r, 20) + " " + " ".join(w[: len(w) // 4]), "s"))  # a quarter: clean
    docs.append(docs[-3])
    got = plain(decontaminate.contaminated_pairs(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")))
    want = []
    for i, text, _ in docs:
        for n, item in items:
            t = tokens(item)
            if len(t) >= decontaminate.SEED_TOKENS:
                covered = brute_coverage(tokens(text)[:400], t, decontaminate.SEED_TOKENS)
                if covered >= decontaminate.MIN_COVERAGE * len(t):
                    want.append((i, n, len(t), covered, covered / len(t)))
    assert [x[:4] + x[5:] for x in got] == sorted(want, key=repr)
    assert {i for i, *_ in got} == {600 + n for n in range(8)} | {700 + n for n in range(8)}


def test_item_blocks_give_the_same(spark, monkeypatch):
    r = random.Random(2)
    items = spark.createDataFrame([(n, sentence(r, 30, 3000)) for n in range(10)], "item_id long, text string")
    docs = frame(spark, [(x.item_id, "start " + x.text, "s") for x in items.collect()] + [(99, sentence(r, 80), "s")])
    one = plain(decontaminate.contaminated_pairs(docs, items))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 500)
    assert len(list(decontaminate.item_blocks(items, 500))) > 2
    assert plain(decontaminate.contaminated_pairs(docs, items)) == one
    assert [x.doc_id for x in decontaminate.decontaminated(docs, items).collect()] == [99]


def test_items_shorter_than_a_seed(spark, monkeypatch):
    """They match documents that are little more than they are, and no long text that holds them."""
    r = random.Random(4)
    long = sentence(r, 40, 3000)
    items = [(1, "yes"), (2, "Two words!"), (3, "one two three four five"), (4, "..."), (5, long), (6, "two words")]
    docs = [
        (1, "YES", "s"), (2, "yes, indeed", "s"), (3, "oh yes indeed", "s"), (4, "say two words now", "s"),
        (5, "one two three four five " + sentence(r, 60), "s"), (6, "ONE two, three four five six", "s"),
        (7, "one two three four", "s"), (8, "words two", "s"), (9, "", "s"), (10, None, "s"), (11, long + " yes two words", "s"),
    ]
    want = [(1, 1, 1), (2, 1, 1), (4, 2, 2), (4, 6, 2), (6, 3, 5), (11, 5, 40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 40):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
        got = decontaminate.contaminated_pairs(frame(spark, docs), bench).collect()
        assert sorted((x.doc_id, x.item_id, x.covered_tokens) for x in got) == want
        kept = decontaminate.decontaminated(frame(spark, docs), bench)
        assert sorted(x.doc_id for x in kept.collect()) == [3, 5, 7, 8, 9, 10]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=25), st.lists(st.integers(1, 4), min_size=3, max_size=15))
def test_tiles_are_disjoint_and_maximal(doc, item):
    a, b = np.array(doc, np.uint64), np.array(item, np.uint64)
    tiles = decontaminate.tile(a, b, 3)
    used_a, used_b = set(), set()
    for n, i, j in tiles:
        assert n >= 3 and doc[i : i + n] == item[j : j + n]
        for d in range(n):
            assert i + d not in used_a and j + d not in used_b
            used_a.add(i + d)
            used_b.add(j + d)
    for i in range(len(doc) - 2):  # nothing of three tokens is left
        for j in range(len(item) - 2):
            if doc[i : i + 3] == item[j : j + 3]:
                assert {i, i + 1, i + 2} & used_a or {j, j + 1, j + 2} & used_b


def test_groups_sorted_together_are_bounded_in_bytes(monkeypatch):
    held, rng = [], np.random.default_rng(5)
    rows = [(g, 50 * g + i, 1, rng.integers(97, 99, 400, np.uint8).tobytes()) for g in range(60) for i in range(50)]
    kinds = {"anchor": pa.int64(), "segment": pa.int64(), "windows": pa.int32(), "body": pa.binary()}
    arrays = [pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), kinds.values(), strict=True)]

    def watched(bodies, windows, length):
        held.append(sum(map(len, bodies)))
        return [np.zeros(n, bool) for n in windows]

    monkeypatch.setattr(suffix_dedup, "repeated_starts", watched)
    list(suffix_dedup._sort_groups(400)(iter([pa.RecordBatch.from_arrays(arrays, names=list(kinds))])))
    assert sum(held) == 400 * len(rows)
    assert max(held) < (1 << 18) + 2 * 50 * 400  # a bound and the groups that cross it
