"""Document jobs: search, typing, quality, review, personal data, extraction choice and cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgrid.functions import documents as dx
from claimgrid.functions import pii
from claimgrid.plans.barrier import computed_once
from claimgrid.rules import fixed_values as fv


def search(
    docs: DataFrame, terms: list[str], mode: str, size: int, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """Best documents by term density: substring pre-filter, exact token match, top-k."""
    ranked = docs.filter(dx.may_match(F.col(text), terms, mode)).withColumn(
        "rank", dx.search_rank(F.col(text), terms, mode)
    )
    return (
        computed_once(ranked, ["rank"])
        .filter(F.col("rank").isNotNull())
        .orderBy(F.desc("rank"), F.asc(key))
        .limit(size)
    )


def classify_documents(docs: DataFrame, text: str, pages: str, filename: str) -> DataFrame:
    """Feature scores and the rule-based type with confidence."""
    scored = docs.withColumns(dx.feature_scores(F.col(text), F.col(pages)))
    return scored.withColumn(
        "rule", dx.rule_type(F.col(text), F.col(pages), F.col(filename))
    )


def train_type_model(spark: SparkSession):
    """Text pipeline (1-2 grams, TF-IDF, logistic regression) fitted on the nine seed texts."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import (
        IDF,
        CountVectorizer,
        NGram,
        RegexTokenizer,
        SQLTransformer,
        StringIndexer,
    )

    seeds = spark.createDataFrame(fv.TYPE_SEEDS, "text string, label string")
    stages = [
        StringIndexer(
            inputCol="label", outputCol="label_index", stringOrderType="alphabetAsc",
            handleInvalid="keep",
        ),
        RegexTokenizer(inputCol="text", outputCol="words", pattern=r"\W+", minTokenLength=2),
        NGram(n=2, inputCol="words", outputCol="pairs"),
        SQLTransformer(statement="SELECT *, concat(words, pairs) AS grams FROM __THIS__"),
        CountVectorizer(inputCol="grams", outputCol="counts", vocabSize=1000),
        IDF(inputCol="counts", outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol="label_index", maxIter=100, regParam=0.1),
    ]
    return Pipeline(stages=stages).fit(seeds)


def apply_type_model(docs: DataFrame, model, text: str) -> DataFrame:
    """Add ``ml`` = struct(type, confidence) and the probability of every type."""
    from pyspark.ml.functions import vector_to_array

    names = sorted({label for _, label in fv.TYPE_SEEDS})
    prepared = docs.withColumns(
        {"_keep": F.col(text), "text": F.coalesce(text, F.lit("")), "label": F.lit(names[0])}
    )
    scored = model.transform(prepared).withColumn("_p", vector_to_array("probability"))
    best = F.array_max(
        F.array(
            *[F.struct(F.get("_p", F.lit(i)).alias("confidence"), F.lit(n).alias("type"))
              for i, n in enumerate(names)]
        )
    )
    kept = [c for c in docs.columns if c != "text"]
    return scored.select(
        *kept,
        F.col("_keep").alias(text),
        best.alias("ml"),
        F.create_map(
            *[x for i, n in enumerate(names) for x in (F.lit(n), F.get("_p", F.lit(i)))]
        ).alias("ml_probabilities"),
    )


def assess(docs: DataFrame, text: str, pages: str) -> DataFrame:
    return docs.withColumns(dx.quality(F.col(text), F.col(pages)))


def detect_pii(docs: DataFrame, text: str) -> DataFrame:
    """Add resolved detections; one evaluation per document."""
    return computed_once(docs.withColumn("detections", pii.detect(F.col(text))), ["detections"])


def redact_documents(docs: DataFrame, text: str, mode: str = "REDACT") -> DataFrame:
    found = detect_pii(docs, text)
    return found.withColumns(
        {
            "redacted_text": pii.redact(F.col(text), F.col("detections"), mode),
            "redaction_applied": (F.size("detections") > 0) & F.lit(mode.upper() != "NONE"),
        }
    )


def best_attempts(attempts: DataFrame) -> DataFrame:
    """Best extraction per document.

    Tier 1 counts for native PDFs only; tiers 2 and 3 count only while the best so far is below
    60, or when high quality is forced. One aggregation with map-side combine, no window.
    """
    tier = F.substring("tier", 1, 5)

    def best(name: str):
        hit = F.struct(
            F.col("confidence").alias("confidence"),
            (-F.col("attempt_no")).alias("rank"),
            F.col("tier").alias("tier"),
        )
        return F.max(F.when(tier == name, hit)).alias("_" + name)

    grouped = attempts.groupBy("document_id").agg(
        F.max(
            F.when((tier == "tier1") & F.col("is_native_pdf"),
                   F.struct("confidence", (-F.col("attempt_no")).alias("rank"), "tier"))
        ).alias("_tier1"),
        best("tier2"),
        best("tier3"),
        F.bool_or("force_high_quality").alias("_force"),
        F.count(F.lit(1)).alias("attempts"),
    )
    first = F.coalesce(F.col("_tier1.confidence"), F.lit(-1.0))
    use2 = F.col("_tier2").isNotNull() & ((first < fv.OCR_RETRY_CONFIDENCE) | F.col("_force"))
    second = F.greatest(first, F.when(use2, F.col("_tier2.confidence")).otherwise(-1.0))
    use3 = F.col("_tier3").isNotNull() & ((second < fv.OCR_RETRY_CONFIDENCE) | F.col("_force"))
    third = F.when(use3, F.col("_tier3.confidence")).otherwise(-1.0)
    return grouped.select(
        "document_id",
        "attempts",
        F.when(third > second, F.col("_tier3.tier"))
        .when(use2 & (F.col("_tier2.confidence") > first), F.col("_tier2.tier"))
        .otherwise(F.col("_tier1.tier"))
        .alias("best_tier"),
        F.nullif(F.greatest(second, third), F.lit(-1.0)).alias("best_confidence"),
    )


def extraction_costs(attempts: DataFrame) -> DataFrame:
    """Tier-3 pages and cost and attempts per tier, per document."""
    tier = F.substring("tier", 1, 5)
    return attempts.groupBy("document_id").agg(
        F.sum(F.when(tier == "tier3", F.col("page_count")).otherwise(0)).alias("tier3_pages"),
        F.sum(F.when(tier == "tier3", F.col("cost").cast("double")).otherwise(0.0)).alias("tier3_cost"),
        *[F.count_if(tier == f"tier{n}").alias(f"tier{n}_attempts") for n in (1, 2, 3)],
    )
