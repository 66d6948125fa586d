"""The stored index against a plain search over the texts as they stand after every batch."""

import random
import re

import pytest

from claimgrid.sources.text_index import TextIndex

WORDS = ["lease", "rent", "carpet", "paint", "agreement", "fee", "the", "of"]


def text_of(r):
    if r.random() < 0.1:
        return r.choice([None, "", " .,; "])
    return " ".join(r.choice(WORDS).title() for _ in range(r.randrange(1, 30))) + "."


def plain(texts, terms, mode, size):
    out = []
    for key, text in texts.items():
        words = [w for w in re.split("[^a-z0-9]+", (text or "").lower()) if w]
        found = {t for t in terms if t in words}
        if found and (mode == "or" or len(found) == len(terms)):
            out.append((key, sum(w in terms for w in words) / len(words)))
    return sorted(out, key=lambda x: (-x[1], x[0]))[:size]


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "id long, body string")


def found(index, terms, mode, size=1000, epoch=None):
    return [tuple(x) for x in index.search(terms, mode, size, epoch).collect()]


def test_follows_every_change(spark, tmp_path):
    r = random.Random(7)
    index = TextIndex(spark, str(tmp_path), "id", buckets=8)
    now = {i: text_of(r) for i in range(120)}
    index.upsert(frame(spark, now), "body", 0)
    states = [dict(now)]
    changed = {i: text_of(r) for i in [*range(0, 120, 3), *range(200, 220)]}
    index.upsert(frame(spark, changed), "body", 1)
    now |= changed
    states.append(dict(now))
    gone = [*range(0, 120, 4), 205, 999]
    index.remove(spark.createDataFrame([(i,) for i in [*gone, None]], "id long"), 2)
    now = {i: t for i, t in now.items() if i not in gone}
    states.append(dict(now))
    back = {4: "lease of the carpet", 500: "LEASE-agreement; Lease"}
    index.upsert(frame(spark, back), "body", 3)
    now |= back
    states.append(dict(now))
    index.upsert(frame(spark, back), "body", 3)  # a replay changes nothing
    for epoch, texts in enumerate(states):
        for terms, mode in [(["lease"], "or"), (["lease", "agreement"], "and"), (["carpet", "fee", "nowhere"], "or"), (["nowhere", "fee"], "and")]:
            assert found(index, terms, mode, epoch=epoch) == plain(texts, terms, mode, 1000)
    assert found(index, ["Lease", "rent", "lease"], "and", 5) == plain(now, ["lease", "rent"], "and", 5)
    counts = {x["term"]: (x["documents"], x["hits"]) for x in index.document_counts().collect()}
    words = {k: [w for w in re.split("[^a-z0-9]+", (t or "").lower()) if w] for k, t in now.items()}
    assert counts == {w: (sum(w in x for x in words.values()), sum(x.count(w) for x in words.values())) for x in words.values() for w in x}


def test_empty(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path), "id", buckets=4)
    assert found(index, ["lease"], "or") == [] and found(index, [], "and") == []
    index.upsert(frame(spark, {1: "x"}).where("false"), "body", 0)
    index.upsert(spark.createDataFrame([(None, "lease"), (1, None), (2, "")], "id long, body string"), "body", 1)
    assert found(index, ["lease"], "or") == []


def test_reads_the_buckets_of_its_terms_only(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path), "id", buckets=64)
    index.upsert(frame(spark, {i: " ".join(f"w{i}x{j}" for j in range(20)) for i in range(50)}), "body", 0)
    rows = index.postings.read(index.postings.touched(spark.createDataFrame([("w3x4",)], "term string")))
    assert len({f.split("bucket=")[1].split("/")[0] for f in rows.inputFiles()}) == 1
    plan = index.search(["w3x4"], "or", 10)._jdf.queryExecution().executedPlan().toString()
    assert "body" not in plan and "EqualTo(term,w3x4)" in plan
    assert found(index, ["w3x4"], "or") == [(3, pytest.approx(1 / 20))]


def test_a_hot_term_is_written_by_more_than_one_task(spark, tmp_path):
    """A term of every document does not put its bucket into one file."""
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "16384")
        index = TextIndex(spark, str(tmp_path), "id", buckets=2)
        docs = spark.range(0, 20_000, 1, 8).selectExpr("id", "concat('the w', id % 5) AS body")
        index.upsert(docs, "body", 0)
        files = index.postings.read(index.postings.touched(spark.createDataFrame([("the",)], "term string"))).inputFiles()
        assert len(files) > 1
        assert index.live(["the"]).count() == 20_000
    finally:
        spark.conf.set(name, before)


def test_postings_are_counted_where_their_text_stands(spark, tmp_path):
    """The tokens of a text are not shuffled before they are counted."""
    index = TextIndex(spark, str(tmp_path), "id", buckets=4)
    counted = index._count(frame(spark, {1: "fee Fee, rent fee", 2: None, 3: " .,", 4: "b a b"}), "body")
    assert sorted((x["term"], x["id"], x["hits"], x["tokens"]) for x in counted.collect()) == [
        ("a", 4, 1, 3), ("b", 4, 2, 3), ("fee", 1, 3, 4), ("rent", 1, 1, 4),
    ]
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
