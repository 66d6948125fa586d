"""Conversation repair against a search over all edits."""

import hashlib
import heapq
import itertools
import random
import zlib

from fixtures import plain
from pyspark.sql import types as T

from claimgrid.llm import conversation_repair as cr

WHITE = " \t\n\x0b\x0c\r"
ROWS = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
        *(T.StructField(c, T.StringType()) for c in ("times", "kind", "part", "audit", "signature")),
    ]
)


def cheapest(rows):
    """(cost, audit, repaired rows) by uniform-cost search over letters; ``rows`` are (role, text, fault)."""
    want = {"": "u", "s": "u", "u": "a", "a": "u"}
    heap = [(0, "", 0, "", ())]
    done = set()
    while True:
        cost, audit, at, state, out = heapq.heappop(heap)
        if at == len(rows) and state in ("", "a"):
            return cost, audit, out
        if (at, state) in done:
            continue
        done.add((at, state))
        full = {"u": "user", "a": "assistant"}[want[state]]
        heapq.heappush(heap, (cost + 3, audit + "I", at, want[state], (*out, (full, ""))))
        if at == len(rows):
            continue
        role, text, fault = rows[at]
        heapq.heappush(heap, (cost + 4, audit + "D", at + 1, state, out))
        if fault in ("blank", "duplicate"):
            continue
        extra = 3 if fault == "truncated" else 0
        if role[:1] == want[state] or (role[:1] == "s" and state == ""):
            heapq.heappush(heap, (cost + extra, audit + "K", at + 1, role[:1], (*out, (role, text))))
        heapq.heappush(heap, (cost + 3 + extra, audit + "R", at + 1, want[state], (*out, (full, text))))


def brute(table):
    out = []
    for conv_id in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in (r for r in table if r[0] == conv_id):
            role, text = " " if role is None else role, " " if text is None else text
            name = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
            kind = zlib.crc32(name.encode()) % 20
            if kind == 0:
                continue
            text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
            rows += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        faults, seen = [], set()
        for _, role, text in rows:
            left = text.rstrip(WHITE)
            faults.append("blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {r[0] for r in rows} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, fixed = cheapest([(role, text, f) for (_, role, text), f in zip(rows, faults)])
        digest = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in fixed).encode()).hexdigest()
        out.append((conv_id, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return sorted(out, key=repr)


def table_of(seed, conversations, turns):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", "cut. \n", "a.b ", "", " \t", None, "Ünï.", "end ", "long " * 50 + "."]
    rows = []
    for c in range(conversations):
        role = itertools.cycle(["user", "assistant"])
        for t in range(r.randrange(1, turns)):
            name = next(role) if r.random() < 0.7 else r.choice(["system", "user", "assistant", "tool", "", None, "usher", "x"])
            text = f"{c} {t}." if r.random() < 0.6 else r.choice(texts)
            rows.append((c, t * r.choice([1, 1, 1, 2]) - 3 if r.random() < 0.95 else None, "system" if t == 0 and r.random() < 0.4 else name, text))
    return rows + rows[5:9] + [(None, 1, "user", "a."), (None, None, None, None), (None, 2, "assistant", "b."), (10**12, -5, "user", "x.")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["1"] * 5) for r in rows], ROWS).repartition(3)


def test_against_search(spark):
    rows = table_of(1, 120, 12) + [(i + 500, *r[1:]) for i, r in enumerate(table_of(2, 90, 3))]
    want = brute(rows)
    assert any(not w[7] for w in want) and {c for w in want for c in w[7]} == set("DIKR")
    assert plain(cr.repaired(frame(spark, rows))) == want


def test_one_long_conversation(spark):
    rows = [(7, t, ["user", "assistant"][t % 2 if t % 11 else 0], f"t{t % 900}.") for t in range(1500)]
    assert plain(cr.repaired(frame(spark, rows))) == brute(rows)


def test_nodes_are_shared():
    """Common ends are made once, whatever stands before them."""
    import pyarrow as pa

    made = []
    original = cr.node_before
    cr.node_before = lambda *a: made.append(a) or original(*a)
    try:
        words = sorted(("".join(w) + "uauaua" for w in itertools.product("suax", repeat=3)), key=lambda w: w[::-1])
        rows = list(cr.best_repairs(iter([pa.RecordBatch.from_arrays([pa.array(words)], names=["signature"])])))
    finally:
        cr.node_before = original
    assert len(made) == len({w[k:] for w in words for k in range(len(w))})
    got = dict(zip(rows[0]["signature"].to_pylist(), zip(rows[0]["cost"].to_pylist(), rows[0]["audit"].to_pylist())))
    for word, (cost, audit) in got.items():
        want = cheapest([({"x": "user"}.get(c, c), str(k), "blank" if c == "x" else "") for k, c in enumerate(word)])
        assert (cost, audit) == want[:2]


def test_no_rows(spark):
    assert cr.repaired(frame(spark, [(1, 1, "user", "a")]).where("false")).count() == 0
