"""Small tables with every awkward case, and the words they are made of."""

import random

from pyspark.sql import types as T

CLASHING = ["score", "shard", "size", "n", "node", "token", "component", "target", "tid", "url", "first", "keys", "gone"]
CLASHING += ["__size", "__id", "__key", "__src", "__copy", "__row", "__times", "__sub", "__order", "__host", "__text_key", "__may"]

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that operators use themselves.
        *(T.StructField(c, T.StringType()) for c in CLASHING),
    ]
)


def sentence(r, n, vocabulary=400):
    return " ".join(f"w{r.randrange(vocabulary)}{'abc'[r.randrange(3)]}" for _ in range(n))


def awkward_texts(seed=3):
    """(doc_id, text, source): copies, near copies, shared passages, nulls, blanks, a very long text,
    repeated rows, ties and missing ids."""
    r = random.Random(seed)
    rows = []

    def add(text, source="src0", doc_id=0):
        rows.append((len(rows) * 3 if doc_id == 0 else doc_id, text, source))

    for i in range(30):
        add(sentence(r, r.randrange(30, 160)), f"src{i % 3}")
    passage = sentence(r, 90, 5000)
    for i in range(12):
        add(sentence(r, 25, 9000) + "\n" + passage + "\n" + sentence(r, 25, 9000), ["src0", "é", None][i % 3])
    base = sentence(r, 150, 5000)
    for i in range(8):
        words = base.split()
        words[r.randrange(150)] = f"edit{i}"
        add(" ".join(words))
    for _ in range(6):
        add(base, "src1")
    for text in (None, "", " \t\n\x0b ", "one", "One  TWO", "one two three", " nbsp word", "ÄÖÜ äöü ß 中文 字", "a\x00b " * 9):
        add(text, None if text is None else "src2")
    add("Same line here\n" + "same LINE here\n" * 4 + sentence(r, 40))
    add("x " * 500)
    add("ab" * 700)
    add(" ".join(f"long{i}" for i in range(30_000)) + " " + passage, "src1")
    add(base, "src1", None)
    add(None, None, None)
    rows.append(rows[2])
    rows.append(rows[2])
    rows.append(rows[45])
    return rows


def frame(spark, rows):
    data = [(i, t, "en", s, len(t or ""), *["1"] * len(CLASHING)) for i, t, s in rows]
    return spark.createDataFrame(data, DOCS).repartition(3)


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
