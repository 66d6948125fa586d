"""URL filter by a character language-model ratio, in Spark expressions only.

URLs that a rule decides train two smoothed variable-order Markov models, one of accepted and one
of rejected URLs. A URL no rule fits is judged by the difference of its log-likelihoods per
character against a threshold calibrated on rule-labelled URLs kept out of training. All counts
come from one table of distinct character runs, so the models are joined, never broadcast: Spark
tells sizes from files, which are far below those of exploded or short strings in memory, and would
broadcast them, so every join asks for a merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimgrid.llm.common import stored

#: (verdict, host, path start): fixed values of the query.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
ORDER = 5
START, END = "\u0002", "\u0003"
ALPHABET = 1024
#: One labelled URL in this many is kept for calibration.
HOLD_OUT = 5
#: Score bins per unit of log-likelihood and the range that calibration tells apart.
BINS, RANGE = 100, 20


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; empty for null and for URLs without ``://``."""
    whole = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(whole, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(whole, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, or nulls."""
    rule = verdict = None
    for action, name, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule = (F if rule is None else rule).when(fits, F.lit(name + start))
        verdict = (F if verdict is None else verdict).when(fits, F.lit(action))
    none = F.lit(None).cast("string")
    return (rule.otherwise(none), verdict.otherwise(none)) if rule is not None else (none, none)


def grams(site: Column, order: int = ORDER) -> Column:
    """Every character of the padded site with the ``order`` characters before it."""
    padded = F.concat(F.lit(START * order), site, F.lit(END))
    return F.transform(F.sequence(F.lit(1), F.char_length(site) + 1), lambda i: F.substring(padded, i, order + 1))


def held_out(site: str) -> Column:
    """One site in HOLD_OUT, by the first 28 bits of its MD5."""
    return F.conv(F.substring(F.md5(F.col(site)), 1, 7), 16, 10).cast("long") % HOLD_OUT == 0


def gram_scores(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, llr) from (gram, accepted, rejected): Witten-Bell smoothed log ratio of the last
    character after the longest context seen, each order falling back on the next shorter one."""
    tables = [counts]
    for _ in range(order):
        shorter = tables[-1].groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(
            F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")
        )
        tables.append(stored(shorter))
    scored = None
    for table in reversed(tables):
        context = F.expr("substring(gram, 1, char_length(gram) - 1)")
        totals = table.groupBy(context.alias("__context")).agg(
            *(
                x
                for c in ("accepted", "rejected")
                for x in (F.sum(c).alias(f"__n_{c}"), F.sum((F.col(c) > 0).cast("long")).alias(f"__kinds_{c}"))
            )
        )
        rows = table.withColumn("__context", context).join(totals.hint("merge"), "__context")
        if scored is None:
            rows = rows.withColumns({f"__low_{c}": F.lit(1.0 / ALPHABET) for c in ("accepted", "rejected")})
        else:
            rows = rows.withColumn("__suffix", F.expr("substring(gram, 2)")).join(scored.hint("merge"), "__suffix")
        p = {
            c: F.when(F.col(f"__n_{c}") == 0, F.col(f"__low_{c}")).otherwise(
                (F.col(c) + F.col(f"__kinds_{c}") * F.col(f"__low_{c}")) / (F.col(f"__n_{c}") + F.col(f"__kinds_{c}"))
            )
            for c in ("accepted", "rejected")
        }
        scored = stored(rows.select(F.col("gram").alias("__suffix"), *(p[c].alias(f"__low_{c}") for c in p)))
    return stored(scored.select(F.col("__suffix").alias("gram"), (F.ln("__low_accepted") - F.ln("__low_rejected")).alias("llr")))


def site_scores(sites: DataFrame, scores: DataFrame, order: int = ORDER) -> DataFrame:
    """(site, score): mean log ratio per character, the end mark included, of distinct sites."""
    each = sites.select("site", F.explode(grams(F.col("site"), order)).alias("gram"))
    return stored(each.join(scores.hint("merge"), "gram").groupBy("site").agg((F.sum("llr") / F.count("*")).alias("score")))


def threshold(labelled: DataFrame) -> float:
    """The score that separates (score, accepted) best: true rates of both classes summed, the
    middle of the best bins on ties. Without both classes it is 0."""
    bin_ = F.floor(F.greatest(F.lit(-RANGE), F.least(F.lit(RANGE), "score")) * BINS).cast("long")
    bins = labelled.groupBy(bin_.alias("bin")).agg(
        F.sum(F.col("accepted").cast("long")).alias("a"), F.sum((~F.col("accepted")).cast("long")).alias("r")
    )
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rates = bins.select(
        "bin",
        (1 - F.coalesce(F.sum("a").over(below), F.lit(0)) / F.sum("a").over(everything)).alias("keeps"),
        (F.coalesce(F.sum("r").over(below), F.lit(0)) / F.sum("r").over(everything)).alias("drops"),
    ).withColumn("rate", F.round(F.col("keeps") + F.col("drops"), 9))
    best = rates.where("rate IS NOT NULL").groupBy("rate").agg(F.min("bin").alias("low"), F.max("bin").alias("high")).orderBy(F.desc("rate")).first()
    return (best["low"] + best["high"]) / 2 / BINS if best else 0.0


def judged(pages: DataFrame, rules=RULES, order: int = ORDER) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row of ``pages``.

    Null URLs and those without ``://`` have empty host and path and are judged by the model like
    any other. ``score`` is null where a rule decides. Without accepted or without rejected
    examples the ratio carries no evidence and the threshold is 0. Repeated rows are judged alike
    and each adds to the counts. An empty table gives no rows.
    """
    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, said = rule_columns(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "__said": said, "site": F.concat("host", "path")})
    held = F.col("__said").isNotNull() & held_out("site")
    rows = stored(rows.withColumn("__held", held))
    learns = F.col("__said").isNotNull() & ~F.col("__held")
    counts = rows.select(
        F.explode(grams(F.col("site"), order)).alias("gram"),
        (learns & (F.col("__said") == "allow")).cast("long").alias("accepted"),
        (learns & (F.col("__said") == "block")).cast("long").alias("rejected"),
    )
    counts = stored(counts.groupBy("gram").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")))
    asked = stored(rows.where("__said IS NULL OR __held").select("site").distinct())
    scores = site_scores(asked, gram_scores(counts, order), order)
    known = rows.where("__held").join(scores.hint("merge"), "site").select("score", (F.col("__said") == "allow").alias("accepted"))
    limit = threshold(known)
    return rows.join(scores.hint("merge"), "site", "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("__said", F.when(F.col("score") >= limit, "allow").otherwise("block")).alias("verdict"),
        F.when(F.col("__said").isNull(), F.col("score")).alias("score"),
    )
