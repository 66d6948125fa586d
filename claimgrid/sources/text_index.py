"""A stored inverted index: postings by term bucket, kept up by upserts, searched without the texts.

Three stores of buckets and epochs lie under one folder:

* ``postings``: term, document, hits and the document's number of tokens, by bucket of the term;
* ``seen``: the documents of every epoch, by bucket of the document;
* ``ended``: documents whose postings of earlier epochs no longer hold, written anew or removed.

Writing pays for a change, so a search reads the buckets of its terms, the rows of its terms in them
and the (few) ended documents. An epoch that is written again replaces itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, LongType, StringType, StructField, StructType

from claimgrid.functions.documents import tokens
from claimgrid.plans.barrier import computed_once
from claimgrid.streaming.store import BucketedStore, hash_bucket

#: Folders a store is cut into; inside them files are sorted, so row groups are skipped too.
BUCKETS = 32


class TextIndex:
    """The index of documents known by the column ``key``, in ``path``.

    A batch names a document once. Null and blank texts have no postings; null keys are left out.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, kind: DataType | None = None, buckets: int = BUCKETS):
        self.spark, self.key = spark, key
        own = StructField(key, kind or LongType())
        entry = [StructField("term", StringType()), own, StructField("hits", LongType()), StructField("tokens", LongType())]
        self.postings = BucketedStore(
            spark, f"{path}/postings", StructType(entry), hash_bucket("term", buckets=buckets), ["term"]
        )
        self.seen = BucketedStore(spark, f"{path}/seen", StructType([own]), hash_bucket(key, buckets=buckets), [key])
        self.ended = BucketedStore(spark, f"{path}/ended", StructType([own]), hash_bucket(key, buckets=buckets), [key])

    def _count(self, docs: DataFrame, text: str) -> DataFrame:
        # A document's tokens stand in one row: sorted there, each run of equal ones is a posting, and
        # nothing is shuffled before the postings go to their buckets.
        split = computed_once(docs.select(self.key, F.array_sort(tokens(F.col(text))).alias("_all")), ["_all"])
        size, term = F.size("_all"), lambda i: F.get("_all", i)
        places = F.when(size > 0, F.sequence(F.lit(0), size - 1))
        begins = F.filter(places, lambda i: (i == 0) | (term(i) != term(i - 1)))
        runs = computed_once(split.withColumn("_begins", begins), ["_begins"])
        entry = lambda i, k: F.struct(
            term(i).alias("term"), (F.coalesce(F.get("_begins", k + 1), size) - i).cast("long").alias("hits")
        )
        found = computed_once(
            runs.select(self.key, size.cast("long").alias("tokens"), F.transform("_begins", entry).alias("_runs")), ["_runs"]
        )
        return found.select(self.key, "tokens", F.inline("_runs"))

    def _end(self, keys: DataFrame, epoch: int) -> None:
        """Keys whose earlier postings, where there are any, no longer hold."""
        before = self.seen.read(self.seen.touched(keys), epoch - 1).select(self.key)
        self.ended.write(keys.join(before, self.key, "left_semi").distinct(), epoch)

    def upsert(self, docs: DataFrame, text: str, epoch: int) -> None:
        """Put documents in, or in place of what they were; epochs rise from batch to batch."""
        known = docs.filter(F.col(self.key).isNotNull())
        keys = known.select(self.key)
        self._end(keys, epoch)
        self.seen.write(keys, epoch)
        self.postings.write(self._count(known, text), epoch)

    def remove(self, keys: DataFrame, epoch: int) -> None:
        """Take documents out."""
        self._end(keys.select(self.key).filter(F.col(self.key).isNotNull()), epoch)

    def _holding(self, postings: DataFrame, epoch: int | None) -> DataFrame:
        ended = self.ended.read(None, epoch).groupBy(self.key).agg(F.max("epoch").alias("_until"))
        holds = F.col("_until").isNull() | (F.col("epoch") >= F.col("_until"))
        return postings.join(ended, self.key, "left").filter(holds).drop("_until")

    def live(self, terms: Sequence[str], epoch: int | None = None) -> DataFrame:
        """The postings of some lower-case terms that hold, as of an epoch or the newest."""
        asked = self.spark.createDataFrame([(t,) for t in terms], "term string")
        found = self.postings.read(self.postings.touched(asked), epoch)
        return self._holding(found.filter(F.col("term").isin(list(terms))), epoch)

    def search(self, terms: Sequence[str], mode: str, size: int, epoch: int | None = None) -> DataFrame:
        """(key, rank) of the best documents with all (``and``) or any (``or``) of the terms.

        Rank is term hits per token; ties go to the least key.
        """
        wanted = sorted({t.lower() for t in terms})
        if not wanted:
            none = StructType([self.seen.schema[0], StructField("rank", DoubleType())])
            return self.spark.createDataFrame([], none)
        need = len(wanted) if mode == "and" else 1
        return (
            self.live(wanted, epoch)
            .groupBy(self.key)
            .agg(F.sum("hits").alias("_hits"), F.count(F.lit(1)).alias("_terms"), F.first("tokens").alias("_tokens"))
            .filter(F.col("_terms") >= need)
            .select(self.key, (F.col("_hits").cast("double") / F.col("_tokens")).alias("rank"))
            .orderBy(F.desc("rank"), F.asc(self.key))
            .limit(size)
        )

    def document_counts(self, epoch: int | None = None) -> DataFrame:
        """(term, documents, hits) over all postings that hold."""
        return self._holding(self.postings.read(None, epoch), epoch).groupBy("term").agg(
            F.count(F.lit(1)).alias("documents"), F.sum("hits").alias("hits")
        )
