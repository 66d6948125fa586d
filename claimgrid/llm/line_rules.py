"""Quality rules with cross-document line frequency, in Spark expressions only.

Lines are normalised and hashed; distinct documents are counted per host (the ``source`` column)
and line. Lines in more documents than a limit that does not grow with the host are removed, and
documents that lose most of their words with them are rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgrid.llm.common import stored, text_key, word_array

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
#: A line is removed if it stands in this many documents of its host, however large the host. In a
#: small host this share of its documents is enough, but never fewer than LEAST_LINE_DOCS.
MIN_LINE_DOCS = 10
MIN_LINE_SHARE = 0.1
LEAST_LINE_DOCS = 5
#: A document is rejected if it keeps less than this share of its words.
MIN_KEPT_SHARE = 0.5


def host_key(source: Column) -> Column:
    """Null hosts are one host of their own, apart from every string."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def line_list(text: Column) -> Column:
    """Normalised lines with a word: lower-cased, white space collapsed and trimmed."""
    flat = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[ \\t\\x0B\\f\\r]+", " ")
    return F.array_remove(F.transform(F.split(flat, "\n"), lambda line: F.trim(line)), "")


def repeated_words(windows: Column) -> tuple[Column, Column]:
    """Windows' hashes in order with their places (to be the column ``__ranked``), and from that the
    number of words inside windows that stand in the text more than once."""
    ranked = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

    def again(s: Column, i: Column) -> Column:
        same = lambda j: F.get(ranked_col, j)["h"] == s["h"]
        return F.coalesce(same(i - 1), F.lit(False)) | F.coalesce(same(i + 1), F.lit(False))

    ranked_col = F.col("__ranked")
    places = F.array_sort(F.transform(F.filter(ranked_col, again), lambda s: s["p"]))
    # From one place to the next, a window adds what it doesn't share with the one before.
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last")),
        lambda acc: acc["n"].cast("long"),
    )
    return ranked, covered


def base_metrics(docs: DataFrame) -> DataFrame:
    """doc_id, host, text key and the base counts of every row; the text itself is left behind."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", host_key(F.col("source")).alias("__host"), text.alias("__text"))
    rows = rows.withColumn("__words", word_array(F.col("__text")))
    raw = F.filter(F.split("__text", "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    rows = rows.select(
        "doc_id",
        "__host",
        text_key(F.col("__text")).alias("__text_key"),
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        (F.octet_length("__text") - F.octet_length(F.regexp_replace("__text", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        raw.alias("__lines"),
        F.transform("__words", lambda w: F.xxhash64(w)).alias("__hashes"),
    )
    rows = rows.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long")).drop("__lines")
    n = F.size("__hashes")
    at = lambda i: F.xxhash64(*(F.get("__hashes", i + d) for d in range(WINDOW)))
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), at)).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("__windows", windows).drop("__hashes")
    # Most texts repeat no window: only those that do are sorted.
    ranked, covered = repeated_words(F.col("__windows"))
    rows = rows.withColumn("__ranked", F.when(F.size(F.array_distinct("__windows")) < F.size("__windows"), ranked)).drop("__windows")
    return rows.withColumn("n_repeat_words", F.coalesce(F.when(F.col("__ranked").isNotNull(), covered), F.lit(0).cast("long"))).drop("__ranked")


def frequent_lines(docs: DataFrame, min_docs: int = MIN_LINE_DOCS, min_share: float = MIN_LINE_SHARE) -> DataFrame:
    """(__host, __line, n_docs): line hashes in too many documents. Every row counts as one document."""
    lines = docs.select(
        host_key(F.col("source")).alias("__host"),
        F.explode(F.array_distinct(F.transform(line_list(F.col("text")), lambda line: F.xxhash64(line)))).alias("__line"),
    )
    counts = lines.groupBy("__host", "__line").agg(F.count("*").alias("n_docs"))
    counts = counts.where(F.col("n_docs") >= min(min_docs, LEAST_LINE_DOCS))
    hosts = stored(docs.groupBy(host_key(F.col("source")).alias("__host")).agg(F.count("*").alias("__n")))
    often = (F.col("n_docs") >= min_docs) | (F.col("n_docs") / F.col("__n") >= min_share)
    return stored(stored(counts).join(hosts, "__host").where(often).drop("__n"))


def removed_lines(docs: DataFrame, frequent: DataFrame) -> DataFrame:
    """(__host, __text_key, removed_words, removed): what each distinct text of a host loses."""
    lines = docs.select(
        host_key(F.col("source")).alias("__host"),
        text_key(F.col("text")).alias("__text_key"),
        F.posexplode(line_list(F.col("text"))).alias("__at", "__norm"),
    )
    words = F.size(F.split("__norm", " ")).cast("long")
    hit = lines.select("__host", "__text_key", "__at", F.xxhash64("__norm").alias("__line"), words.alias("__n")).join(
        frequent.select("__host", "__line"), ["__host", "__line"]
    )
    # Equal texts of a host lose the same lines, so their rows are equal and count once.
    return stored(
        hit.groupBy("__host", "__text_key").agg(F.collect_set(F.struct("__at", "__line", "__n")).alias("__hits")).select(
            "__host",
            "__text_key",
            F.aggregate("__hits", F.lit(0).cast("long"), lambda acc, h: acc + h["__n"]).alias("removed_words"),
            F.transform("__hits", lambda h: h["__line"]).alias("removed"),
        )
    )


def without_lines(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """``docs``, all columns, with the removed lines taken out of the text."""
    keyed = docs.select(
        host_key(F.col("source")).alias("__host"), text_key(F.col("text")).alias("__text_key"), F.struct(*docs.columns).alias("__row")
    )
    text = F.col("__row.text")
    normal = lambda line: F.xxhash64(F.trim(F.regexp_replace(F.lower(line), "[ \\t\\x0B\\f\\r]+", " ")))
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda line: ~F.array_contains("removed", normal(line))), "\n")
    cut = keyed.join(removed.select("__host", "__text_key", "removed"), ["__host", "__text_key"], "left")
    text = F.when(F.col("removed").isNull(), text).otherwise(kept)
    return cut.select(*[text.alias(c) if c == "text" else F.col("__row")[c].alias(c) for c in docs.columns])


def rated(
    docs: DataFrame,
    min_docs: int = MIN_LINE_DOCS,
    min_share: float = MIN_LINE_SHARE,
    min_kept: float = MIN_KEPT_SHARE,
) -> DataFrame:
    """Base counts, base_failed, removed_words and kept for every row of ``docs``.

    Null and empty texts have no words and fail the base rules; null sources form a host of their
    own; repeated rows count as documents of their own; an empty table gives no rows; columns
    other than doc_id, text and source are ignored.
    """
    rows = stored(base_metrics(docs))
    removed = removed_lines(docs, frequent_lines(docs, min_docs, min_share))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    return (
        rows.join(removed.drop("removed"), ["__host", "__text_key"], "left")
        .withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (left >= min_kept * F.col("n_words")))
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words"
        )
    )
