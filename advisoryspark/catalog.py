"""Registered queries: name -> callable(spark, sf_dir) returning a DataFrame.

Raw records come from `documents` (see sources.testview).  Label and function
queries work on them directly; table queries read the enriched table, which is
built from the whole of `documents` once per session and data folder, as the
stored table that search, counts and models run over.
"""

import uuid

import numpy as np
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame, SparkSession, functions as F

from advisoryspark import fixed_values as fx
from advisoryspark.functions import ids, replies, scores, sequences, text
from advisoryspark.operators import (aggregates, drift, evaluation, forecast, groups, growing, hmm, inference,
                                      listing, memm, merge, models, search_index, sequence, tfidf)
from advisoryspark.plans import enrich as plan
from advisoryspark.plans import reports
from advisoryspark.schemas import RESEARCH_COLUMNS, TABLE_COLUMNS
from advisoryspark.session import materialize, work_dir
from advisoryspark.sources import feed, keyed, store, tables
from advisoryspark.sources.testview import raw_records, table
from advisoryspark.streaming import bulk_import, kept_statistics, known_ids, live_counts

QUERIES = {}
_STORED = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The enriched table of a data folder, written on first use."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        _STORED[key] = materialize(plan.enrich(raw_records(spark, sf_dir)), "enriched")
    return _STORED[key]


def mean_score_model(spark, sf_dir):
    """Score model whose result SQL can compute: the mean score of each weakness, rounded to one digit.

    A row per weakness comes to the driver and becomes one SQL transformer.
    """
    def train():
        means = raw_records(spark, sf_dir).groupBy("CWE").agg(F.round(F.avg("CVSS_Score"), 1).alias("mean")).collect()
        whens = " ".join(f"WHEN '{_quoted(r['CWE'])}' THEN {r['mean']}D" for r in sorted(means))
        return SQLTransformer(statement=f"SELECT *, CASE CWE {whens} END AS predicted FROM __THIS__")
    return trained(spark, sf_dir, "mean_score", train)


def _quoted(value):
    return value.replace("\\", "\\\\").replace("'", "\\'")


def length_category_model():
    """Category model whose result SQL can compute: long and short texts."""
    return SQLTransformer(statement=(
        "SELECT *, if(length(Description) > 1000, 'LABEL_1', 'LABEL_0') AS category, "
        "round(length(Description) / (length(Description) + 1000D), 3) AS category_confidence FROM __THIS__"))


def scored(spark, sf_dir):
    """The table enriched with both models, written on first use."""
    key = (spark.sparkContext.applicationId, sf_dir, "scored")
    if key not in _STORED:
        _STORED[key] = materialize(plan.enrich(
            raw_records(spark, sf_dir), mean_score_model(spark, sf_dir), length_category_model()), "scored")
    return _STORED[key]


def labelled(spark, sf_dir, ruleset="current"):
    return plan.with_rule_labels(raw_records(spark, sf_dir), ruleset)


def lowered_records(spark, sf_dir):
    """Raw records with their lower-cased text as its own projection."""
    return raw_records(spark, sf_dir).withColumn("_lowered", F.lower("Description"))


# --- scalar functions -------------------------------------------------------

@query
def clean_text(spark, sf_dir):
    return raw_records(spark, sf_dir).select(
        "CVE_ID", text.clean_text(F.col("Description")).alias("Cleaned_Description"))


@query
def token_stats(spark, sf_dir):
    words = text.tokens(text.clean_text(F.col("Description")))
    counted = raw_records(spark, sf_dir).select("OS", F.size(words).alias("token_count"))
    return counted.groupBy("OS").agg(
        F.count(F.lit(1)).alias("n"), F.sum("token_count").alias("tokens"),
        F.max("token_count").cast("bigint").alias("longest"),
        F.round(F.avg("token_count"), 4).alias("mean_tokens"))


@query
def exploit_labels(spark, sf_dir):
    return labelled(spark, sf_dir).select("CVE_ID", "Exploit_Type")


@query
def component_labels(spark, sf_dir):
    return labelled(spark, sf_dir).select("CVE_ID", "Affected_Component")


@query
def impact_labels(spark, sf_dir):
    return labelled(spark, sf_dir).select("CVE_ID", "Impact")


@query
def research_rules_labels(spark, sf_dir):
    return labelled(spark, sf_dir, "research").select("CVE_ID", "Exploit_Type", "Affected_Component", "Impact")


@query
def page_component_labels(spark, sf_dir):
    """Component and impact rules over the whole html of every page."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", text.component(F.col("html")).alias("component"),
                        text.impact(F.col("html")).alias("impact"))


@query
def severity_labels(spark, sf_dir):
    score = F.col("CVSS_Score")
    return raw_records(spark, sf_dir).select("CVE_ID", "CVSS_Score", scores.severity(score).alias("severity"))


@query
def threat_states(spark, sf_dir):
    """State and its one-hot columns."""
    state = scores.threat_state(F.col("CVSS_Score"))
    low, medium, high = scores.one_hot_state(state)
    return raw_records(spark, sf_dir).select(
        "CVE_ID", state.alias("state"), low.alias("is_low"), medium.alias("is_medium"), high.alias("is_high"))


@query
def score_confidence(spark, sf_dir):
    """Confidence of the mean score of each weakness as prediction."""
    raw = raw_records(spark, sf_dir).select("CVE_ID", "CWE", "CVSS_Score")
    means = raw.groupBy("CWE").agg(F.round(F.avg("CVSS_Score"), 1).alias("predicted"))
    return merge.join_labels(raw, means, "CWE").select(
        "CVE_ID", "predicted",
        scores.confidence(F.col("CVSS_Score"), F.col("predicted")).alias("confidence"))


@query
def id_validation(spark, sf_dir):
    """Ids with blanks and lower case, from records and customers, normalised and checked."""
    written = raw_records(spark, sf_dir).select(F.concat(F.lit("  "), F.lower("CVE_ID"), F.lit("\t\n")).alias("cve_id"))
    malformed = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("cve-20-"), F.col("c_custkey").cast("string")).alias("cve_id"))
    return tables.id_list(written.unionByName(malformed)).select("CVE_ID", "is_valid")


@query
def year_from_id(spark, sf_dir):
    good = raw_records(spark, sf_dir).select("CVE_ID")
    other = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("CVE-20-"), F.col("c_custkey").cast("string")).alias("CVE_ID"))
    return good.unionByName(other).select("CVE_ID", ids.year_from_id(F.col("CVE_ID")).alias("Year"))


@query
def order_years_published(spark, sf_dir):
    """Year as the first four characters of a publication time."""
    when = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    return table(spark, sf_dir, "orders").groupBy(
        ids.year_from_published(when).alias("Year")).agg(F.count(F.lit(1)).alias("n"))


@query
def rule_predictions(spark, sf_dir):
    return lowered_records(spark, sf_dir).select(
        "CVE_ID", *replies.rule_prediction(F.col("_lowered"), F.col("CVSS_Score")))


@query
def prompt_render(spark, sf_dir):
    return raw_records(spark, sf_dir).select("CVE_ID", replies.render_prompt(
        F.col("CVE_ID"), F.col("Description"), F.col("CVSS_Score"), F.col("CWE"), F.col("Year")).alias("prompt"))


@query
def reply_parse(spark, sf_dir):
    """Replies of the rule-based predictor as JSON, every other kind fenced, decoded again."""
    predicted = lowered_records(spark, sf_dir).select(
        "CVE_ID", "CWE", F.to_json(F.struct(*replies.rule_prediction(F.col("_lowered"), F.col("CVSS_Score")))).alias("body"))
    fenced = F.when(F.col("CWE") == "N/A", F.concat(F.lit("not json "), "body")).when(
        F.col("CWE") == "CWE-79", F.concat(F.lit("```json\n"), "body", F.lit("\n```"))).otherwise(F.col("body"))
    return predicted.select("CVE_ID", replies.parse_reply(fenced).alias("r")).select("CVE_ID", "r.*")


@query
def report_excerpts(spark, sf_dir):
    return listing.report_excerpt(stored(spark, sf_dir))


@query
def zero_shot_labels(spark, sf_dir):
    """Label clean-up and first maximum over four scores: the sums of every fourth embedding value."""
    names = F.array(*[F.lit(n) for n in fx.ZERO_SHOT_LABELS])
    best = scores.first_argmax(F.col("four"))
    return folded(table(spark, sf_dir, "embeddings"), 4).select(
        "vec_id", replies.zero_shot_label(F.get(names, best)).alias("label"),
        F.round(F.get("four", best), 3).alias("score"))


def folded(vectors, n):
    """vec_id and an array of n sums over the whole vector, value i counting for sum i modulo n.

    Values are rounded to a millionth before they are summed, as integers, so the order of the sum does not matter.
    """
    whole = F.transform("embedding", lambda x, i: F.struct(F.round(x.cast("double") * 1000000).cast("bigint").alias("x"),
                                                           (i % n).alias("k")))
    sums = [F.aggregate(F.filter(whole, lambda e: e["k"] == number), F.lit(0).cast("bigint"),
                        lambda total, e: total + e["x"]).cast("double") / 1000000 for number in range(n)]
    return vectors.select("vec_id", F.array(*sums).alias("four" if n == 4 else "part"))


# --- enrichment and composite plans -----------------------------------------

@query
def enrich_rules(spark, sf_dir):
    return plan.enrich(raw_records(spark, sf_dir))


@query
def research_storage(spark, sf_dir):
    """Projection of the research table, restricted to records not stored yet, by exploit."""
    existing = merge_target(spark, sf_dir)
    fresh = merge.insert_new(existing, stored(spark, sf_dir).select(*RESEARCH_COLUMNS))
    whole = existing.select(*RESEARCH_COLUMNS).unionByName(fresh)
    return aggregates.count_by(whole, "Exploit_Type")


@query
def lookup_with_source(spark, sf_dir):
    """Stored records and enriched feed records that are not stored, with their source."""
    return reports.lookup_sources(merge_target(spark, sf_dir), raw_records(spark, sf_dir)).select(
        "CVE_ID", "Exploit_Type", "True_Severity", "source")


@query
def batch_predict_join(spark, sf_dir):
    """Rule predictions of all rows joined back to the records."""
    records = stored(spark, sf_dir)
    return reports.predict_batch(records).select(
        "CVE_ID", "CVSS_Score", "True_Severity", "AI_Severity", "AI_Exploit_Type",
        "AI_Component", "AI_Confidence", "AI_Impact")


@query
def label_join(spark, sf_dir):
    """Records left-joined with the human labels; unlabelled records keep nulls."""
    human = table(spark, sf_dir, "labels").select(document_id(spark, sf_dir), "quality", "toxic")
    return merge.attach_predictions(stored(spark, sf_dir).select("CVE_ID", "Exploit_Type"), human)


def document_id(spark, sf_dir):
    """CVE_ID of a doc_id, as the raw records carry it."""
    doc = F.col("doc_id")
    year = (F.lit(2017) + F.floor(F.sqrt(doc % 100)).cast("int")).cast("string")
    return F.concat(F.lit("CVE-"), year, F.lit("-"), (doc + 1001).cast("string")).alias("CVE_ID")


# --- search, paging, lookup --------------------------------------------------

@query
def search_filter(spark, sf_dir):
    found = listing.filter_records(stored(spark, sf_dir), search="In_ection", severity="high")
    return found.select("CVE_ID", "True_Severity", "Exploit_Type")


@query
def exploit_filter(spark, sf_dir):
    return listing.filter_records(stored(spark, sf_dir), exploit="DoS").select("CVE_ID", "Year", "Exploit_Type")


@query
def page_listing(spark, sf_dir):
    found = listing.filter_records(stored(spark, sf_dir), search="kernel")
    return listing.page(found, limit=25, offset=25).select("CVE_ID", "Year", "CVSS_Score", "Affected_Component")


@query
def page_envelope(spark, sf_dir):
    found = listing.filter_records(stored(spark, sf_dir), search="kernel")
    return listing.page_envelope(found, limit=25, offset=25)


@query
def exact_lookup(spark, sf_dir):
    return listing.lookup(stored(spark, sf_dir), " cve-2019-1007 ").select("CVE_ID", "Description", "Impact")


@query
def ordered_scan(spark, sf_dir):
    return tables.ordered_scores(raw_records(spark, sf_dir))


@query
def shuffled_sample(spark, sf_dir):
    """Seeded sample of the size the classifier is trained on."""
    return tables.shuffled_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 800)


@query
def dataset_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return docs.select("doc_id", tables.split_bucket(F.col("doc_id")).alias("bucket"),
                       tables.split_name(F.col("doc_id")).alias("part"))


@query
def grouped_split(spark, sf_dir):
    """Split of all documents in which texts that begin or end alike stay on one side."""
    cleaned = text.clean_text(F.col("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", cleaned.alias("cleaned"))
    ends = {"start": F.substring("cleaned", 1, 40), "end": F.substring("cleaned", -40, 40)}
    found = groups.groups(docs, "doc_id", {k: F.when(F.length("cleaned") >= 40, v) for k, v in ends.items()})
    return groups.split(found, large=0.2).withColumnRenamed("id", "doc_id")


@query
def latest_predictions(spark, sf_dir):
    """Newest enriched records of one predicted severity, from the table the score model filled."""
    found = scored(spark, sf_dir).filter(F.col("Predicted_Severity") == "MEDIUM")
    return listing.page(found, limit=50).select("CVE_ID", "Year", "Predicted_Severity", "Severity_Confidence")


@query
def enrich_models(spark, sf_dir):
    """Model columns of the enriched table, from a score and a category model."""
    return scored(spark, sf_dir).select("CVE_ID", "Predicted_Severity", "Severity_Confidence", "BERT_Category",
                                        "BERT_Confidence")


@query
def lookup_models(spark, sf_dir):
    """Lookup of stored and unknown records, the unknown with the models' columns and a zero-shot severity."""
    raw = raw_records(spark, sf_dir)
    guess = inference.top_label(inference.label_scores(F.col("Description"), word_scorer, fx.ZERO_SHOT_LABELS))
    return reports.lookup_sources(
        merge_target(spark, sf_dir), raw.unionByName(raw), guess, score_model=mean_score_model(spark, sf_dir),
        category_model=length_category_model()).select(
            "CVE_ID", "source", "Predicted_Severity", "BERT_Category", "zero_shot_severity", "zero_shot_confidence")


@query
def lookup_stored(spark, sf_dir):
    """The lookup logged in the table: what was unknown is stored with the source it came from."""
    root = f"{work_dir(spark)}/lookup-{uuid.uuid4().hex}/table"
    store.create_if_missing(spark, root)
    store.append_changes(merge_target(spark, sf_dir).withColumn("seq", F.lit(0).cast("bigint")), root)
    found = reports.lookup_and_store(root, raw_records(spark, sf_dir), score_model=mean_score_model(spark, sf_dir))
    return found.select("CVE_ID", "source", "Predicted_Severity")


@query
def pages_by_key(spark, sf_dir):
    """The second page by the last key of the first."""
    found = listing.filter_records(stored(spark, sf_dir), search="kernel")
    last = listing.page_after(found, 25).collect()[-1]
    return listing.page_after(found, 25, last["Year"], last["CVE_ID"]).select("CVE_ID", "Year")


@query
def head_rows(spark, sf_dir):
    return listing.head(stored(spark, sf_dir).select("CVE_ID", "Year", "Impact"), 50)


@query
def seeded_table(spark, sf_dir):
    """Seeds put into an empty table, then the records: severities of both."""
    root = f"{work_dir(spark)}/seeded-{uuid.uuid4().hex}/table"
    store.create_if_missing(spark, root)
    store.seed_if_empty(spark, root)
    store.append_changes(stored(spark, sf_dir).withColumn("seq", F.lit(0).cast("bigint")), root)
    if store.seed_if_empty(spark, root):
        raise ValueError("the table was taken as empty")
    return aggregates.count_by(store.current(spark, root), "True_Severity")


@query
def reset_table(spark, sf_dir):
    """Records whose id a table lacks after it was reset to its seeds."""
    root = f"{work_dir(spark)}/reset-{uuid.uuid4().hex}/table"
    store.create_if_missing(spark, root)
    store.append_changes(stored(spark, sf_dir).withColumn("seq", F.lit(0).cast("bigint")), root)
    store.reset(spark, root)
    return merge.insert_new(store.current(spark, root), stored(spark, sf_dir)).select("CVE_ID", "Year")


@query
def older_table(spark, sf_dir):
    """A table from before the category columns, read with them as nulls."""
    old = stored(spark, sf_dir).drop("BERT_Category", "BERT_Confidence")
    return store.add_missing_columns(old).select("CVE_ID", "Impact", "BERT_Category", "BERT_Confidence")


@query
def prediction_log(spark, sf_dir):
    """Two model versions logged one after the other; predictions of each by severity."""
    path = f"{work_dir(spark)}/predictions-{uuid.uuid4().hex}"
    for version, rows in (("v1", stored(spark, sf_dir)), ("v2", scored(spark, sf_dir))):
        store.log_predictions(rows.select("CVE_ID", "Predicted_Severity"), path, version)
    return spark.read.parquet(path).groupBy("model_version", "Predicted_Severity").agg(F.count("scored_at").alias("n"))


@query
def prediction_drift(spark, sf_dir):
    """Confidences of two model versions, each logged in two batches, compared with the first by their sketches."""
    path = f"{work_dir(spark)}/sketches-{uuid.uuid4().hex}"
    for version, rows in (("v1", stored(spark, sf_dir)), ("v2", scored(spark, sf_dir))):
        for late in (False, True):
            drift.log_sketch(rows.filter((F.col("Year") >= "2024") == late), path, version, "Severity_Confidence")
    found = drift.compare(spark, path, "v1")
    return found.withColumns({c: F.round(c, 6) for c in ("ks", "psi")})


# --- the table placed by key, its search index and its kept counts ------------------

def document_number():
    """doc_id of a stored record, from its id."""
    return F.substring_index("CVE_ID", "-", -1).cast("bigint") - 1001


def change_batches(spark, sf_dir):
    """Changed records: most records, a third with another score; then those as they are and the rest."""
    records, doc = stored(spark, sf_dir).withColumn("seq", F.lit(1).cast("bigint")), document_number()
    other = F.when(doc % 3 == 0, F.round(10 - F.col("CVSS_Score"), 1)).otherwise(F.col("CVSS_Score"))
    first = records.filter(doc % 5 != 4).withColumn("CVSS_Score", other).withColumn(
        "True_Severity", scores.severity(F.col("CVSS_Score")))
    return [first, records.filter((doc % 3 == 0) | (doc % 5 == 4))]


@query
def live_status(spark, sf_dir):
    """The status summary after each of two batches of changes, from counts that follow the updates."""
    base, after = f"{work_dir(spark)}/live-{uuid.uuid4().hex}", []
    for epoch, changed in enumerate(change_batches(spark, sf_dir)):
        changed.write.mode("append").parquet(f"{base}/changes")
        live_counts.start(spark, f"{base}/changes", f"{base}/table", f"{base}/counts", f"{base}/checkpoint",
                          files_per_batch=1_000_000).awaitTermination()
        after.append(live_counts.status(spark, f"{base}/counts").withColumn("epoch", F.lit(epoch)))
    return after[0].unionByName(after[1])


def statistics(spark, sf_dir):
    """Statistics kept over two batches of changes to a keyed table, written on first use."""
    key = (spark.sparkContext.applicationId, sf_dir, "statistics")
    if key not in _STORED:
        base = f"{work_dir(spark)}/statistics-{uuid.uuid4().hex}"
        keyed.create(spark, f"{base}/table", buckets=16)
        for k, changed in enumerate(change_batches(spark, sf_dir)):
            keyed.merge(changed, f"{base}/table", f"batch{k}")
            kept_statistics.refresh(spark, f"{base}/table", f"{base}/kept")
        _STORED[key] = f"{base}/kept"
    return _STORED[key]


@query
def kept_vocabulary(spark, sf_dir):
    """The vocabulary of `tfidf_vocabulary`, retrained from kept statistics."""
    return kept_statistics.vocabulary(spark, statistics(spark, sf_dir))


@query
def kept_weights(spark, sf_dir):
    """The weights of `tfidf_weights`, by a model retrained from kept statistics."""
    model = kept_statistics.tfidf_model(spark, statistics(spark, sf_dir))
    return tfidf.weights(model, stored(spark, sf_dir).select("CVE_ID", "Description")).withColumn("weight", F.round("weight", 6))


@query
def kept_mean_scores(spark, sf_dir):
    """Mean score of each weakness from kept statistics."""
    return kept_statistics.mean_scores(spark, statistics(spark, sf_dir)).withColumn("mean", F.round("mean", 6))


@query
def kept_forecast(spark, sf_dir):
    """The forecasts of `forecast_by_exploit`, from kept counts."""
    return forecast.forecast_table(kept_statistics.yearly_counts(spark, statistics(spark, sf_dir), by_exploit=True))


def keyed_table(spark, sf_dir):
    """The stored records in a table placed by key, written on first use."""
    key = (spark.sparkContext.applicationId, sf_dir, "keyed")
    if key not in _STORED:
        root = f"{work_dir(spark)}/keyed-{uuid.uuid4().hex}"
        keyed.create(spark, root, buckets=16)
        keyed.merge(stored(spark, sf_dir).withColumn("seq", F.lit(0).cast("bigint")), root, "base")
        _STORED[key] = root
    return _STORED[key]


@query
def keyed_merge(spark, sf_dir):
    """The upsert of `upsert_merge` in a table placed by key; equal versions of an id go by a hash of the row."""
    root = f"{work_dir(spark)}/keyed-{uuid.uuid4().hex}"
    keyed.create(spark, root, buckets=16)
    keyed.merge(merge_target(spark, sf_dir).withColumn("seq", F.lit(0).cast("bigint")), root, "base")
    keyed.merge(merge_batch(spark, sf_dir), root, "changes")
    return keyed.read(spark, root).select("CVE_ID", "CVSS_Score", "True_Severity")


@query
def keyed_lookup(spark, sf_dir):
    """Records looked up by the ids of the labelled documents, bucket by bucket."""
    wanted = table(spark, sf_dir, "labels").select(document_id(spark, sf_dir))
    return keyed.lookup_many(spark, keyed_table(spark, sf_dir), wanted).select("CVE_ID", "Exploit_Type", "CVSS_Score")


@query
def indexed_search(spark, sf_dir):
    """Records found by several terms through the trigram index: words, wildcards, a short term, an id."""
    key = (spark.sparkContext.applicationId, sf_dir, "index")
    if key not in _STORED:
        root = f"{work_dir(spark)}/index-{uuid.uuid4().hex}"
        search_index.build(stored(spark, sf_dir), root)
        _STORED[key] = root
    found = [search_index.search(spark, _STORED[key], term).select(F.lit(term).alias("term"), "CVE_ID")
             for term in ("In_ection", "worthless", "sql%panel", "é", "CVE-2019-10", "no such text")]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


# --- aggregates ---------------------------------------------------------------

@query
def kpi_summary(spark, sf_dir):
    return aggregates.kpis(stored(spark, sf_dir))


@query
def severity_counts(spark, sf_dir):
    return aggregates.count_by(stored(spark, sf_dir), "True_Severity")


@query
def exploit_counts(spark, sf_dir):
    return aggregates.count_by(stored(spark, sf_dir), "Exploit_Type")


@query
def top_components(spark, sf_dir):
    return aggregates.top_counts(stored(spark, sf_dir), "Affected_Component")


@query
def component_share(spark, sf_dir):
    return aggregates.shares(stored(spark, sf_dir), "Affected_Component")


@query
def yearly_counts(spark, sf_dir):
    return aggregates.count_by(stored(spark, sf_dir), "Year").orderBy("Year")


@query
def stats_grouping_sets(spark, sf_dir):
    return aggregates.summary(stored(spark, sf_dir))


@query
def year_exploit_pivot(spark, sf_dir):
    """Year by exploit, the rest label left out."""
    named = stored(spark, sf_dir).filter(F.col("Exploit_Type") != fx.DEFAULT_EXPLOIT)
    return aggregates.year_by_label(named, "Exploit_Type", [name for name, _ in fx.EXPLOIT_RULES])


@query
def score_bins(spark, sf_dir):
    return aggregates.score_bins(stored(spark, sf_dir))


@query
def score_histogram(spark, sf_dir):
    return aggregates.histogram(stored(spark, sf_dir))


@query
def price_histogram(spark, sf_dir):
    return aggregates.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice")


@query
def error_metrics(spark, sf_dir):
    """Errors of predicting the mean score of each exploit type."""
    records = stored(spark, sf_dir).select("CVSS_Score", "Exploit_Type")
    means = records.groupBy("Exploit_Type").agg(F.round(F.avg("CVSS_Score"), 1).alias("predicted"))
    errors = evaluation.regression_errors(merge.join_labels(records, means, "Exploit_Type"), "CVSS_Score", "predicted")
    return errors.select(F.round("mae", 6).alias("mae"), F.round("rmse", 6).alias("rmse"), "n")


def rule_set_pairs(spark, sf_dir):
    lowered = F.col("_lowered")
    return lowered_records(spark, sf_dir).select(
        "CVE_ID", scores.severity(F.col("CVSS_Score")).alias("True_Severity"),
        text.first_match(lowered, fx.COMPONENT_RULES, fx.DEFAULT_COMPONENT).alias("new_label"),
        text.first_match(lowered, fx.RESEARCH_COMPONENT_RULES, fx.DEFAULT_COMPONENT).alias("old_label"))


@query
def class_report(spark, sf_dir):
    """The older component rules measured against the current ones."""
    return evaluation.class_report(rule_set_pairs(spark, sf_dir), "new_label", "old_label")


@query
def label_accuracy(spark, sf_dir):
    result = evaluation.accuracy(rule_set_pairs(spark, sf_dir), "new_label", "old_label")
    return result.select(F.round("accuracy", 6).alias("accuracy"), "n")


@query
def label_comparison(spark, sf_dir):
    return evaluation.compare_labels(rule_set_pairs(spark, sf_dir), F.col("new_label"), F.col("old_label"))


@query
def status_report(spark, sf_dir):
    """The status summary with model metrics: here those of the mean score per exploit
    as score model and of the most frequent next state as state model."""
    errors = error_metrics(spark, sf_dir)
    pairs = sequence.previous_states(score_sequence(spark, sf_dir)).groupBy("prev_state", "state").agg(
        F.count(F.lit(1)).alias("n"))
    hits = pairs.groupBy("prev_state").agg(F.max("n").alias("hits"), F.sum("n").alias("n"))
    accuracy = hits.agg(F.sum("hits") / F.sum("n")).scalar()
    metrics = errors.select(F.col("mae").alias("rf_mae"), F.col("rmse").alias("rf_rmse"),
                            accuracy.alias("memm_accuracy"))
    return aggregates.status_report(stored(spark, sf_dir), metrics)


# --- merging ------------------------------------------------------------------

def merge_target(spark, sf_dir):
    """Stored records but those labelled low quality, which arrive later."""
    low = table(spark, sf_dir, "labels").filter("quality = 0").select(document_id(spark, sf_dir)).distinct()
    return stored(spark, sf_dir).join(low, "CVE_ID", "left_anti")


def merge_batch(spark, sf_dir):
    """Two versions of every labelled record: as read, then with a revised score."""
    human = table(spark, sf_dir, "labels").select(document_id(spark, sf_dir), "toxic")
    rows = stored(spark, sf_dir).join(human, "CVE_ID")
    version = F.explode(F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint")))
    revised = F.least(F.lit(10.0), F.col("CVSS_Score") + F.col("toxic") + F.lit(0.5))
    score = F.when(F.col("seq") == 2, revised).otherwise(F.col("CVSS_Score"))
    return (
        rows.withColumn("seq", version).withColumn("CVSS_Score", score)
        .withColumn("True_Severity", scores.severity(F.col("CVSS_Score"))).select(*TABLE_COLUMNS, "seq")
    )


@query
def upsert_merge(spark, sf_dir):
    merged = merge.upsert(merge_target(spark, sf_dir), merge_batch(spark, sf_dir))
    return merged.select("CVE_ID", "CVSS_Score", "True_Severity", "Exploit_Type")


@query
def insert_new_only(spark, sf_dir):
    fresh = merge.insert_new(merge_target(spark, sf_dir), merge_batch(spark, sf_dir))
    return merge.first_seen(fresh).select("CVE_ID", "CVSS_Score", "True_Severity")


@query
def write_defaults(spark, sf_dir):
    """Raw records on the write path: missing columns filled, cleaned text recomputed."""
    raw = raw_records(spark, sf_dir).withColumn("True_Severity", scores.severity(F.col("CVSS_Score")))
    return store.with_defaults(raw).select(
        "CVE_ID", "Cleaned_Description", "Predicted_Severity", "Severity_Confidence",
        "BERT_Category", "BERT_Confidence")


# --- the chronological sequence -------------------------------------------------

@query
def chronological_index(spark, sf_dir):
    return sequence.with_position(score_sequence(spark, sf_dir)).select("CVE_ID", "Year", "position")


@query
def prev_state(spark, sf_dir):
    return sequence.previous_states(score_sequence(spark, sf_dir)).select("CVE_ID", "state", "prev_state")


@query
def transition_matrix(spark, sf_dir):
    pairs = sequence.previous_states(score_sequence(spark, sf_dir))
    return sequence.transition_matrix(pairs).withColumn("probability", F.round("probability", 6))


@query
def last_observation(spark, sf_dir):
    return sequence.last_observation(raw_records(spark, sf_dir))


# --- forecasts -------------------------------------------------------------------

def daily_events(spark, sf_dir):
    day = F.unix_date(F.to_date("ts"))
    return table(spark, sf_dir, "events").groupBy(
        F.col("event_type").alias("series"), day.alias("t")).agg(F.count(F.lit(1)).alias("n"))


@query
def yearly_difference(spark, sf_dir):
    return sequence.difference(forecast.yearly_counts(stored(spark, sf_dir)))


@query
def linear_trend(spark, sf_dir):
    return forecast.linear_trend(forecast.yearly_counts(stored(spark, sf_dir)))


@query
def linear_forecast(spark, sf_dir):
    return forecast.linear_forecast(forecast.yearly_counts(stored(spark, sf_dir)))


@query
def forecast_yearly(spark, sf_dir):
    return forecast.forecast_table(forecast.yearly_counts(stored(spark, sf_dir)))


@query
def arima110_forecast(spark, sf_dir):
    """Daily event counts, one series per event type."""
    return forecast.arima110_forecast(daily_events(spark, sf_dir), steps=5)


@query
def trend_by_exploit(spark, sf_dir):
    return forecast.linear_trend(forecast.yearly_counts(stored(spark, sf_dir), "Exploit_Type"))


@query
def forecast_by_exploit(spark, sf_dir):
    return forecast.forecast_table(forecast.yearly_counts(stored(spark, sf_dir), "Exploit_Type"))


@query
def forecast_guarded(spark, sf_dir):
    """Forecasts by component where most components have too short a history, which the guard leaves out."""
    long = F.col("Exploit_Type").isin("RCE", "XSS", "SQLi")
    records = stored(spark, sf_dir).filter((F.col("Year") >= "2025") | long)
    return forecast.forecast_table(forecast.yearly_counts(records, "Exploit_Type"))


@query
def forecast_display(spark, sf_dir):
    return forecast.display_series(daily_events(spark, sf_dir))


@query
def arima111(spark, sf_dir):
    return forecast.arima111_forecast(daily_events(spark, sf_dir), steps=5)


# --- text features and models ------------------------------------------------------

@query
def tfidf_vocabulary(spark, sf_dir):
    return tfidf.vocabulary(stored(spark, sf_dir))


@query
def tfidf_weights(spark, sf_dir):
    records = stored(spark, sf_dir).select("CVE_ID", "Description", "Cleaned_Description")
    return tfidf.weights(tfidf.fit(records), records).withColumn("weight", F.round("weight", 6))


_MODELS = {}


def trained(spark, sf_dir, name, train):
    """A model of a data folder, trained on first use."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _MODELS:
        _MODELS[key] = train()
    return _MODELS[key]


def score_model(spark, sf_dir):
    return trained(spark, sf_dir, "score", lambda: models.fit_score_model(stored(spark, sf_dir)))


def quality_model(spark, sf_dir):
    """Quality label of the labelled documents, learned from their text."""
    human = table(spark, sf_dir, "labels").select(document_id(spark, sf_dir), "quality")
    labelled_records = stored(spark, sf_dir).select("CVE_ID", "Description", "Cleaned_Description").join(human, "CVE_ID")
    return trained(spark, sf_dir, "quality", lambda: models.fit_text_classifier(labelled_records, "quality"))


@query
def rf_score(spark, sf_dir):
    """Predicted score, its severity and the confidence of every record."""
    scored = models.predict_scores(stored(spark, sf_dir), score_model(spark, sf_dir))
    return scored.select(
        "CVE_ID", "CVSS_Score", "predicted", scores.severity(F.col("predicted")).alias("Predicted_Severity"),
        scores.confidence(F.col("CVSS_Score"), F.col("predicted")).alias("Severity_Confidence"))


@query
def rf_errors(spark, sf_dir):
    return models.score_errors(stored(spark, sf_dir), score_model(spark, sf_dir))


@query
def oof_folds(spark, sf_dir):
    """Fold of every record of the out-of-fold prediction."""
    return models.fold_numbers(stored(spark, sf_dir))


@query
def rf_score_range(spark, sf_dir):
    """Every record has a predicted score, a severity and a confidence in their ranges."""
    found = rf_score(spark, sf_dir)
    return found.select("CVE_ID", F.col("predicted").between(0, 10).alias("score_fits"),
                        (F.col("Predicted_Severity") == scores.severity(F.col("predicted"))).alias("severity_fits"),
                        F.col("Severity_Confidence").between(0.6, 1).alias("confidence_fits"))


@query
def text_classifier_range(spark, sf_dir):
    """Every record has one of the learned labels with a probability."""
    found = text_classifier(spark, sf_dir)
    return found.select("CVE_ID", F.col("category").isin("0", "1").alias("label_fits"),
                        F.col("category_confidence").between(0.5, 1).alias("confidence_fits"))


@query
def tfidf_unseen(spark, sf_dir):
    """Weights of records the vocabulary and frequencies were not counted on."""
    records = stored(spark, sf_dir).select("CVE_ID", "Year", "Description")
    fitted = tfidf.fit(records.filter("Year < '2023'"))
    return tfidf.weights(fitted, records.filter("Year >= '2023'")).withColumn("weight", F.round("weight", 6))


@query
def record_report_models(spark, sf_dir):
    """The report of one record from models whose results SQL can compute."""
    found = length_category_model().transform(models.predict_scores(stored(spark, sf_dir), mean_score_model(spark, sf_dir)))
    category = F.struct(F.col("category").alias("label"), F.col("category_confidence").alias("score"))
    guess = inference.top_label(inference.label_scores(F.col("Description"), word_scorer, fx.ZERO_SHOT_LABELS))
    return reports.record_report(found, "CVE-2019-1007", F.col("predicted"), category, guess)


@query
def oof_score(spark, sf_dir):
    return models.out_of_fold(stored(spark, sf_dir))


@query
def text_classifier(spark, sf_dir):
    """The learned quality label applied to all records."""
    records = stored(spark, sf_dir).select("CVE_ID", "Description")
    return models.classify(records, quality_model(spark, sf_dir)).select(
        "CVE_ID", "category", "category_confidence")


def length_category():
    """Stand-in for a category model: long and short texts."""
    def predict(texts):
        return [("LABEL_1" if len(t) > 1000 else "LABEL_0", len(t) / (len(t) + 1000)) for t in texts]
    return predict


@query
def category_inference(spark, sf_dir):
    docs = raw_records(spark, sf_dir).select("CVE_ID", "Description")
    found = inference.predict_category(F.col("Description"), length_category)
    return docs.select("CVE_ID", found.alias("p")).select(
        "CVE_ID", F.col("p.label").alias("BERT_Category"), F.col("p.score").alias("BERT_Confidence"))


@query
def category_by_length(spark, sf_dir):
    """The categories of `category_inference`, from batches of like length under a token budget."""
    docs = raw_records(spark, sf_dir).select("CVE_ID", "Description")
    found = inference.predict_by_length(F.col("Description"), length_category, budget=4096)
    return docs.select("CVE_ID", found.alias("p")).select(
        "CVE_ID", F.col("p.label").alias("BERT_Category"), F.col("p.score").alias("BERT_Confidence"))


@query
def record_report(spark, sf_dir):
    """Ad-hoc report of one stored record from the score, category and severity models."""
    scored = models.predict_scores(stored(spark, sf_dir), score_model(spark, sf_dir))
    found = models.classify(scored, quality_model(spark, sf_dir))
    category = F.struct(F.col("category").alias("label"), F.col("category_confidence").alias("score"))
    guess = inference.top_label(inference.label_scores(F.col("Description"), word_scorer, fx.ZERO_SHOT_LABELS))
    return reports.record_report(found, "CVE-2019-1007", F.col("predicted"), category, guess)


def word_scorer():
    """Stand-in for a language model: share of each label's first word in the text."""
    def predict(texts, labels):
        counts = [[t.lower().count(label.split()[0]) for label in labels] for t in texts]
        return [[n / (1 + sum(row)) for n in row] for row in counts]
    return predict


@query
def zero_shot_inference(spark, sf_dir):
    docs = raw_records(spark, sf_dir).select("CVE_ID", "Description")
    return inference.zero_shot_severity(docs, word_scorer).drop("Description")


@query
def token_sequences(spark, sf_dir):
    """Model inputs of fixed length: ids and mask, written out as text."""
    cleaned = stored(spark, sf_dir).select("CVE_ID", "Cleaned_Description")
    encoded = sequences.encode(cleaned, sequences.vocabulary(cleaned, 30_000))
    return encoded.select(
        "CVE_ID", "n_unknown", *[F.array_join(F.col(c).cast("array<string>"), " ").alias(c) for c in ("input_ids", "attention_mask")])


# --- sequence models -----------------------------------------------------------------

def score_sequence(spark, sf_dir):
    """The chronological sequence of a data folder, sorted and written on first use."""
    key = (spark.sparkContext.applicationId, sf_dir, "sequence")
    if key not in _STORED:
        _STORED[key] = sequence.ordered_rows(raw_records(spark, sf_dir), columns=("CVE_ID", "Year", "CVSS_Score"))
    return _STORED[key]


@query
def hmm_fit(spark, sf_dir):
    return hmm.model_table(spark, hmm.fit(score_sequence(spark, sf_dir)))


@query
def hmm_em_step(spark, sf_dir):
    """One Baum-Welch step from the start model, as one row."""
    rows = score_sequence(spark, sf_dir)
    model = hmm.em_step(rows, hmm.start_model(rows))
    return spark.createDataFrame(
        [(model["means"], model["variances"], model["startprob"], sum(model["transmat"], []), model["log_likelihood"][0])],
        "means array<double>, variances array<double>, startprob array<double>, transmat array<double>, "
        "log_likelihood double").select(*(
            F.round(F.get(c, F.lit(i)), 6).alias(f"{c}_{i}") for c, n in (
                ("means", 3), ("variances", 3), ("startprob", 3), ("transmat", 9)) for i in range(n)),
            F.round("log_likelihood", 6).alias("log_likelihood"))


@query
def hmm_decode(spark, sf_dir):
    rows = score_sequence(spark, sf_dir)
    return hmm.timeline(hmm.decode(rows, hmm.fit(rows)))


@query
def hmm_outlook(spark, sf_dir):
    rows = score_sequence(spark, sf_dir)
    return hmm.analysis(rows, hmm.fit(rows))


@query
def memm_gradient(spark, sf_dir):
    """Gradient of the fitted model's penalised loss, which is zero at the optimum."""
    rows = score_sequence(spark, sf_dir)
    found = memm.gradient(rows, memm.fit(rows))
    return found.select("state", "feature", F.round(F.abs("gradient"), 3).alias("gradient"))


@query
def memm_fit(spark, sf_dir):
    rows = score_sequence(spark, sf_dir)
    return memm.training_accuracy(rows, memm.fit(rows))


@query
def memm_decode(spark, sf_dir):
    rows = score_sequence(spark, sf_dir)
    return memm.decode(rows, *memm.parameters(memm.fit(rows))).select("CVE_ID", "CVSS_Score", "true_state", "state")


@query
def memm_what_if(spark, sf_dir):
    rows = score_sequence(spark, sf_dir)
    model = memm.fit(rows)
    return memm.what_if(memm.decode(rows, *memm.parameters(model)), model)


def observed_model(pairs, states):
    """HMM parameters read off the observed threat states: shares, moments and transitions."""
    n = states.count()
    moments = {r["state"]: r for r in states.groupBy("state").agg(
        F.avg("CVSS_Score").alias("mean"), F.var_pop("CVSS_Score").alias("variance"),
        F.count(F.lit(1)).alias("n")).collect()}
    moves = {(r["prev_state"], r["state"]): r["probability"] for r in sequence.transition_matrix(pairs).collect()}
    names = fx.THREAT_STATES
    return {
        "means": [moments[s]["mean"] for s in names],
        "variances": [moments[s]["variance"] for s in names],
        "startprob": [moments[s]["n"] / n for s in names],
        "transmat": [[moves.get((a, b), 0.0) for b in names] for a in names],
    }


@query
def hmm_path_observed(spark, sf_dir):
    """Most likely state path under the model the observed states give."""
    rows = score_sequence(spark, sf_dir)
    states = rows.withColumn("state", scores.threat_state(F.col("CVSS_Score")))
    pairs = sequence.with_previous(states, "state", "prev_state").filter("prev_state IS NOT NULL")
    return hmm.timeline(hmm.decode(rows, observed_model(pairs, states)))


@query
def growing_path(spark, sf_dir):
    """The path of `hmm_path_observed` over a sequence that came in three batches and was decoded after each."""
    rows = score_sequence(spark, sf_dir).select("CVE_ID", "Year", "CVSS_Score")
    states = score_sequence(spark, sf_dir).withColumn("state", scores.threat_state(F.col("CVSS_Score")))
    pairs = sequence.with_previous(states, "state", "prev_state").filter("prev_state IS NOT NULL")
    model = observed_model(pairs, states)
    steps, name = hmm.path_steps(model), growing.model_name(model)
    root, part = f"{work_dir(spark)}/growing-{uuid.uuid4().hex}", F.pmod(document_number(), F.lit(3))
    early = F.col("Year") < "2024"
    batches = (rows.filter(early & (part < 2)).withColumn("CVSS_Score", F.lit(5.0)), rows.filter(~early), rows.filter(early))
    for k, batch in enumerate(batches):
        growing.append(batch, root, f"batch{k}")
        growing.newest_state(spark, root, steps, name)
    return hmm.timeline(growing.decode(spark, root, steps, name))


@query
def memm_path_observed(spark, sf_dir):
    """Greedy path under weights read off the observed states: normal scores of one
    common variance, and the logarithm of the observed transitions."""
    rows = score_sequence(spark, sf_dir)
    states = rows.withColumn("state", scores.threat_state(F.col("CVSS_Score")))
    pairs = sequence.with_previous(states, "state", "prev_state").filter("prev_state IS NOT NULL")
    decoded = memm.decode(rows, *observed_weights(observed_model(pairs, states)))
    return decoded.select("CVE_ID", "true_state", "state")


def observed_weights(observed):
    means = np.array(observed["means"])
    common = float(np.dot(observed["startprob"], observed["variances"]))
    with np.errstate(divide="ignore"):
        moves = np.log(np.array(observed["transmat"]))
    return np.concatenate([means[:, None] / common, moves.T], axis=1), -means ** 2 / (2 * common)


@query
def memm_outlook_observed(spark, sf_dir):
    """What-if result and decode accuracy under the observed weights."""
    rows = score_sequence(spark, sf_dir)
    states = rows.withColumn("state", scores.threat_state(F.col("CVSS_Score")))
    pairs = sequence.with_previous(states, "state", "prev_state").filter("prev_state IS NOT NULL")
    weights = observed_weights(observed_model(pairs, states))
    result = memm.outlook(memm.decode(rows, *weights), *weights)
    return result.select("current_state", "predicted_next_state", F.round("probability", 6).alias("probability"),
                         F.round("accuracy", 6).alias("accuracy"))


@query
def hmm_state_order(spark, sf_dir):
    """State ordering and outlook of three-state models taken from the embeddings."""
    part = F.col("part")
    model = folded(table(spark, sf_dir, "embeddings"), 15).select(
        "vec_id", F.slice(part, 1, 3).alias("means"), F.slice(part, 4, 3).alias("std_devs"),
        F.array(F.slice(part, 7, 3), F.slice(part, 10, 3), F.slice(part, 13, 3)).alias("transmat"))
    ordered = hmm.order_states(model)
    return hmm.with_next_state(ordered, F.lit(0)).select(
        "vec_id", F.array_join(F.col("order").cast("array<string>"), " ").alias("state_order"),
        F.round(F.get("means", 0), 6).alias("low_mean"), F.round(F.get("std_devs", 2), 6).alias("high_std_dev"),
        F.round(F.get(F.get("transmat", 2), 0), 6).alias("high_to_low"),
        "predicted_next_state", F.round("probability", 6).alias("probability"),
        F.round("expected_next_cvss", 6).alias("expected_next_cvss"))


# --- feeds, streams and exports -----------------------------------------------------

def feed_files(spark, sf_dir):
    """The raw records written as feed documents, one a line."""
    path = f"{work_dir(spark)}/feed-{uuid.uuid4().hex}"
    feed.as_feed_documents(raw_records(spark, sf_dir), per_document=200).write.json(path)
    return path


@query
def feed_fallbacks(spark, sf_dir):
    """Feed entries with scores of older versions or none, without weakness, and with a second language."""
    path = f"{work_dir(spark)}/feed-{uuid.uuid4().hex}"
    feed.as_feed_documents(raw_records(spark, sf_dir), per_document=200, fallbacks=True).write.json(path)
    documents = feed.read_feed(spark, path, multiline=False)
    return feed.accepted(feed.records(documents)).select("CVE_ID", "Description", "CVSS_Score", "CWE")


@query
def feed_records(spark, sf_dir):
    """Nested feed documents read back into flat records."""
    documents = feed.read_feed(spark, feed_files(spark, sf_dir), multiline=False)
    return feed.accepted(feed.records(documents))


@query
def stream_import(spark, sf_dir):
    """Two feeds with overlapping ids imported into one table by streams of their own, then the table they leave."""
    base = f"{work_dir(spark)}/import-{uuid.uuid4().hex}"
    raw = raw_records(spark, sf_dir)
    late = raw.filter("Year >= '2020'").withColumn("CVSS_Score", F.lit(1.5))
    for name, records in (("first", raw.filter("Year < '2023'")), ("second", late)):
        feed.as_feed_documents(records, per_document=200).write.json(f"{base}/{name}")
        bulk_import.start_import(
            spark, f"{base}/{name}", f"{base}/table", f"{base}/rejects", f"{base}/checkpoint-{name}",
            multiline=False).awaitTermination()
    return store.current(spark, f"{base}/table")


@query
def stream_import_state(spark, sf_dir):
    """The two feeds of `stream_import`, known ids kept in the streams' state; the second starts from the table's ids."""
    base = f"{work_dir(spark)}/import-{uuid.uuid4().hex}"
    raw = raw_records(spark, sf_dir)
    late = raw.filter("Year >= '2020'").withColumn("CVSS_Score", F.lit(1.5))
    for name, records in (("first", raw.filter("Year < '2023'")), ("second", late)):
        feed.as_feed_documents(records, per_document=200).write.json(f"{base}/{name}", compression="gzip")
        for started in known_ids.start(spark, f"{base}/{name}", f"{base}/table", f"{base}/rejects",
                                       f"{base}/checkpoint-{name}", multiline=False):
            started.awaitTermination()
    return store.current(spark, f"{base}/table")


@query
def stream_severity_counts(spark, sf_dir):
    """Severity counts kept by a stream over the enriched files."""
    name = f"severity_counts_{uuid.uuid4().hex}"
    path = f"{work_dir(spark)}/arriving-{uuid.uuid4().hex}"
    stored(spark, sf_dir).write.parquet(path)
    bulk_import.start_severity_counts(
        spark, path, name, f"{work_dir(spark)}/{name}").awaitTermination()
    return spark.table(name)


@query
def csv_export(spark, sf_dir):
    """The export of all records of one severity, read back from its files."""
    path = f"{work_dir(spark)}/export-{uuid.uuid4().hex}"
    store.export_csv(listing.filter_records(stored(spark, sf_dir), severity="CRITICAL"), path)
    return spark.read.schema(
        "CVE_ID string, Year string, CVSS_Score double, Severity string, Exploit string, Component string, "
        "Description string").option("header", True).option("multiLine", True).option("escape", '"').option(
        "enforceSchema", True).csv(path)
