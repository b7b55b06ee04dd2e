"""Composite reports: lookup with source, batch prediction, stored-record report."""

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from advisoryspark.functions import replies, scores
from advisoryspark.operators import listing, merge
from advisoryspark.plans.enrich import enrich
from advisoryspark.sources import store


def unknown_records(stored: DataFrame, feed_records: DataFrame, **models) -> DataFrame:
    """Enriched feed records that are not stored, the first of each id in an order of their content.

    Enrichment runs after the anti join, so only unknown records pay for it.
    """
    order = [c for c in ("Description", "CVSS_Score", "CWE", "OS") if c in feed_records.columns]
    return enrich(merge.first_seen(merge.insert_new(stored, feed_records), order), **models)


def lookup_sources(stored: DataFrame, feed_records: DataFrame, severity_guess: Column | None = None,
                   **models) -> DataFrame:
    """Stored records, plus enriched feed records that are not stored, tagged by source.

    `severity_guess` (label, score) over a record's columns is added for fresh records.
    """
    fresh = unknown_records(stored, feed_records, **models).withColumn("source", F.lit("feed"))
    tagged = stored.withColumn("source", F.lit("local_database"))
    if severity_guess is None:
        return tagged.unionByName(fresh)
    guessed = fresh.withColumn("_guess", severity_guess).withColumns({
        "zero_shot_severity": F.col("_guess.label"), "zero_shot_confidence": F.col("_guess.score")}).drop("_guess")
    return guessed.unionByName(tagged, allowMissingColumns=True)


def lookup_and_store(root: str, feed_records: DataFrame, **models) -> DataFrame:
    """Log the unknown records of a feed in the table under `root`, then the lookup over the whole table."""
    spark = feed_records.sparkSession
    fresh = unknown_records(store.current(spark, root), feed_records, **models)
    tag = f"lookup-{uuid.uuid4().hex}"
    store.append_changes(fresh.withColumn("seq", F.lit(0).cast("bigint")), root, tag)
    return store.current(spark, root, with_batch=True).withColumn(
        "source", F.when(F.col("batch") == tag, "feed").otherwise("local_database")).drop("batch")


def predict_batch(records: DataFrame, max_rows: int | None = None, ruleset: str = "current") -> DataFrame:
    """Records with the rule-based prediction columns.

    Every row gets its prediction in the same pass.  With `max_rows` only the
    first rows in (Year, CVE_ID) order are predicted and joined back, the others get nulls.
    """
    severity, _, exploit, component, impact, confidence, _ = replies.rule_prediction(
        F.col("_lowered"), F.coalesce("CVSS_Score", F.lit(0.0)), ruleset)
    broken = F.col("Description").isNull()

    def or_error(value: Column, substitute) -> Column:
        return F.when(broken, F.lit(substitute)).otherwise(value)

    columns = {
        "AI_Severity": or_error(severity, "ERROR"),
        "AI_Exploit_Type": or_error(exploit, ""),
        "AI_Component": or_error(component, ""),
        "AI_Confidence": or_error(confidence, 0),
        "AI_Impact": or_error(impact, ""),
    }

    def predicted(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_lowered", F.lower("Description")).withColumns(columns).drop("_lowered")

    if max_rows is None:
        return predicted(records)
    first = listing.head(records.select("CVE_ID", "Year", "Description", "CVSS_Score"), max_rows)
    return merge.attach_predictions(records, predicted(first).select("CVE_ID", *columns))


def record_report(records: DataFrame, cve_id: str, predicted_score: Column,
                  category: Column, severity_guess: Column) -> DataFrame:
    """Ad-hoc report of one stored record from the model columns given."""
    return listing.lookup(records, cve_id).select(
        F.col("CVE_ID").alias("cve_id"),
        category["label"].alias("bert_category"), category["score"].alias("bert_confidence"),
        severity_guess["label"].alias("zero_shot_severity"), severity_guess["score"].alias("zero_shot_confidence"),
        predicted_score.alias("rf_predicted_cvss"),
        scores.severity(predicted_score).alias("rf_predicted_severity"),
    )
