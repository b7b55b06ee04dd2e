"""Merging, the table log, feed reading, paging, exports and samples."""

import csv
import glob
import json

import pytest
from pyspark.sql import functions as F

from advisoryspark.operators import aggregates, listing, merge, sequence
from advisoryspark.plans import reports
from advisoryspark.plans.enrich import enrich
from advisoryspark.schemas import RESEARCH_COLUMNS, TABLE_COLUMNS, TABLE_SCHEMA
from advisoryspark.sources import feed, store, tables
from advisoryspark.sources.testview import raw_records


def entry(cve_id, descriptions=(("en", "text"),), metrics=None, weaknesses=None, published="2020-05-01T00:00"):
    return {"cve": {
        "id": cve_id, "published": published,
        "descriptions": [{"lang": lang, "value": value} for lang, value in descriptions],
        "metrics": {k: [{"cvssData": {"baseScore": v}}] for k, v in (metrics or {}).items()},
        "weaknesses": weaknesses or []}}


@pytest.fixture()
def feed_dir(tmp_path):
    cwe = [{"description": [{"lang": "en", "value": "CWE-79"}, {"lang": "en", "value": "CWE-1"}]}]
    documents = [
        {"vulnerabilities": [
            entry("CVE-2021-0001", metrics={"cvssMetricV31": 9.8}, weaknesses=cwe),
            entry("CVE-2021-0002", metrics={"cvssMetricV30": 7.5}),
            entry("cve-2021-0003", metrics={"cvssMetricV2": 4.0}),
            entry("CVE-2021-0004")]},
        {"vulnerabilities": [
            entry("CVE-2021-0005", metrics={"cvssMetricV31": 5.0, "cvssMetricV2": 9.0}),
            entry("CVE-2021-0006", descriptions=(("es", "hola"), ("en", "hello"))),
            entry("CVE-2021-0007", descriptions=(("es", "hola"),)),
            entry("BAD-1")]},
        {"vulnerabilities": []},
    ]
    path = tmp_path / "feed"
    path.mkdir()
    for i, document in enumerate(documents):
        (path / f"{i}.json").write_text(json.dumps(document, indent=1))
    (path / "broken.json").write_text('{"vulnerabilities": [{"cve": ')
    return str(path)


def test_feed_records(spark, feed_dir):
    documents = feed.read_feed(spark, feed_dir)
    rows = {r.CVE_ID: r for r in feed.accepted(feed.records(documents)).collect()}
    assert sorted(rows) == [f"CVE-2021-000{i}" for i in range(1, 8)]
    assert [rows[f"CVE-2021-000{i}"].CVSS_Score for i in range(1, 6)] == [9.8, 7.5, 4.0, 0.0, 5.0]
    assert rows["CVE-2021-0001"].CWE == "CWE-79" and rows["CVE-2021-0002"].CWE == "N/A"
    assert rows["CVE-2021-0006"].Description == "hello"
    assert rows["CVE-2021-0007"].Description == "No English description available."
    assert {r.Year for r in rows.values()} == {"2021"} and {r.OS for r in rows.values()} == {"Cross-Platform"}
    rejects = {(r.source_file.rsplit("/", 1)[1], r.reason) for r in feed.rejected(documents).collect()}
    assert rejects == {("broken.json", "broken document"), ("1.json", "malformed id")}


def test_feed_research_variant(spark, feed_dir):
    rows = {r.CVE_ID: r for r in feed.records(feed.read_feed(spark, feed_dir), "research").collect()}
    assert rows["CVE-2021-0006"].Description == "hola"
    assert rows["CVE-2021-0006"].Year == "2020" and rows["CVE-2021-0006"].OS == "Unknown"


def test_feed_round_trip(spark, small, tmp_path):
    raw = raw_records(spark, small).withColumn("OS", F.lit("Cross-Platform"))
    path = str(tmp_path / "packed")
    feed.as_feed_documents(raw, per_document=50).write.json(path)
    back = feed.records(feed.read_feed(spark, path, multiline=False))
    assert back.count() == raw.count()
    assert back.exceptAll(raw).isEmpty() and raw.exceptAll(back).isEmpty()


def changes(spark, rows):
    return spark.createDataFrame(rows, "CVE_ID string, Description string, Year string, CVSS_Score double, "
                                       "True_Severity string, seq long")


def test_log_keeps_last_write(spark, tmp_path):
    root = str(tmp_path / "table")
    store.create_if_missing(spark, root)
    assert store.current(spark, root).count() == 0
    first = changes(spark, [("A", "One.", "2020", 5.0, "MEDIUM", 1), ("A", "Two!", "2020", 9.0, "CRITICAL", 2),
                            ("B", "Bee", "2021", 1.0, "LOW", 1)])
    store.append_changes(first, root, "first")
    store.append_changes(changes(spark, [("B", "Bee two", "2021", 7.0, "HIGH", 1), ("C", "", "2022", 0.0, "UNKNOWN", 1)]), root)

    def state():
        return {r.CVE_ID: (r.Description, r.Cleaned_Description, r.CVSS_Score, r.Predicted_Severity,
                           r.Severity_Confidence, r.BERT_Category, r.BERT_Confidence)
                for r in store.current(spark, root).collect()}

    expected = {"A": ("Two!", "two", 9.0, "CRITICAL", 1.0, "N/A", 0.0),
                "B": ("Bee two", "bee two", 7.0, "HIGH", 1.0, "N/A", 0.0),
                "C": ("", "", 0.0, "UNKNOWN", 1.0, "N/A", 0.0)}
    assert state() == expected
    store.append_changes(first, root, "first")  # the same batch again changes nothing
    assert state() == expected
    store.create_if_missing(spark, root)
    assert state() == expected
    fresh = str(tmp_path / "compacted")
    store.compact(spark, root, fresh)
    assert store.current(spark, fresh).exceptAll(store.current(spark, root)).isEmpty()
    assert store.current(spark, fresh).count() == 3
    with pytest.raises(ValueError):
        store.append_changes(first, root, "base")


def test_seed_and_reset(spark, tmp_path):
    root = str(tmp_path / "table")
    store.create_if_missing(spark, root)
    assert store.seed_if_empty(spark, root) and not store.seed_if_empty(spark, root)
    store.append_changes(changes(spark, [("A", "x", "2020", 5.0, "MEDIUM", 1)]), root)
    assert store.current(spark, root).count() == 14
    store.reset(spark, root)
    seeds = store.current(spark, root)
    assert seeds.count() == 13 and seeds.columns == TABLE_COLUMNS
    from advisoryspark.functions.scores import severity
    assert seeds.filter(severity(F.col("CVSS_Score")) != F.col("True_Severity")).isEmpty()


def test_old_table_gains_columns(spark, tmp_path):
    old = tables.seed_records(spark).drop("BERT_Category", "BERT_Confidence")
    assert store.add_missing_columns(old).schema.fieldNames() == TABLE_COLUMNS
    path = str(tmp_path / "old")
    old.write.parquet(path)
    assert tables.scan(spark, path).filter("BERT_Category IS NULL").count() == 13


def test_upsert_is_idempotent_and_hot_keys_merge(spark):
    rows = [("A", float(i), i) for i in range(5000)] + [(f"K{i}", 1.0, i) for i in range(100)]
    batch = spark.createDataFrame(rows, "CVE_ID string, CVSS_Score double, seq long").repartition(8)
    latest = merge.latest(batch)
    assert latest.count() == 101 and latest.filter("CVE_ID = 'A'").first().seq == 4999
    assert merge.first_seen(batch).filter("CVE_ID = 'A'").first().seq == 0
    once = merge.upsert(latest, batch)
    assert once.exceptAll(latest).isEmpty() and once.count() == 101
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert plan.count("max_by") > plan.count("Window") == 0


def joins(spark, df):
    """Joins of the plan when nothing may be broadcast by size."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = df()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return plan.count("SortMergeJoin"), plan.count("BroadcastHashJoin")


def test_plans_of_merges(spark, small):
    records = enrich(raw_records(spark, small))
    assert joins(spark, lambda: merge.insert_new(records, records.limit(5))) == (1, 0)
    means = records.groupBy("CWE").agg(F.avg("CVSS_Score").alias("mean"))
    assert joins(spark, lambda: merge.join_labels(records, means, "CWE")) == (0, 1)
    # More labels than may be broadcast: the join is left to the planner, with the same rows.
    wide = merge.join_labels(records, means, "CWE")
    merge_limit, merge.MAX_LABELS = merge.MAX_LABELS, 2
    try:
        assert joins(spark, lambda: merge.join_labels(records, means, "CWE")) == (1, 0)
        assert merge.join_labels(records, means, "CWE").exceptAll(wide).isEmpty()
    finally:
        merge.MAX_LABELS = merge_limit


def test_csv_export(spark, tmp_path):
    rows = tables.seed_records(spark).withColumn(
        "Description", F.concat(F.lit('say "hi", then\nleave: '), "CVE_ID"))
    path = str(tmp_path / "export")
    store.export_csv(rows.coalesce(1), path)
    with open(glob.glob(path + "/part-*.csv")[0], newline="") as f:
        got = list(csv.reader(f))
    assert got[0] == ["CVE ID", "Year", "CVSS Score", "Severity", "Exploit Type", "Affected Component", "Description"]
    assert len(got) == 14 and all(r[6] == f'say "hi", then\nleave: {r[0]}' for r in got[1:])
    store.export_csv(rows, path, limit=3)
    assert spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).count() == 3


def test_prediction_log_appends(spark, tmp_path):
    path = str(tmp_path / "log")
    scored = tables.seed_records(spark).select("CVE_ID", "CVSS_Score")
    store.log_predictions(scored, path, "v1")
    store.log_predictions(scored, path, "v2")
    assert {(r.model_version, r["count"]) for r in
            spark.read.parquet(path).groupBy("model_version").count().collect()} == {("v1", 13), ("v2", 13)}


def test_pages_are_cuts_of_one_order(spark, small):
    records = raw_records(spark, small)
    everything = sorted(((r.Year, r.CVE_ID) for r in records.collect()), reverse=True)
    assert [r.CVE_ID for r in listing.page(records, 20, 60).collect()] == [i for _, i in everything[60:80]]
    assert listing.page(records, 20, 10_000_000).count() == 0
    following = listing.page_after(records, 20, *everything[59])
    assert [r.CVE_ID for r in following.collect()] == [i for _, i in everything[60:80]]
    assert [r.CVE_ID for r in listing.page_after(records, 3).collect()] == [i for _, i in everything[:3]]


def test_pages_with_repeated_ids(spark, small):
    records = raw_records(spark, small)
    twice = records.unionByName(records.withColumn("OS", F.lit("other"))).select("CVE_ID", "Year", "OS")
    pages = [r for at in range(0, 400, 37) for r in listing.page(twice.repartition(5), 37, at).collect()]
    assert sorted(pages) == sorted(twice.collect())
    hashed, seen, key = twice.withColumn("h", listing.row_hash(twice)), [], ()
    while True:  # pages by key go on inside a repeated id
        rows = listing.page_after(twice.repartition(3), 37, *key).collect()
        if not rows:
            break
        seen += rows
        last = rows[-1]
        key = (last.Year, last.CVE_ID, hashed.filter(F.col("CVE_ID") == last.CVE_ID).filter(F.col("OS") == last.OS).first().h)
    assert seen == pages


def test_malformed_lookup_is_refused(spark, small):
    with pytest.raises(ValueError):
        listing.lookup(raw_records(spark, small), "CVE-20-1")


def test_lookup_is_exact(spark):
    rows = spark.createDataFrame([("CVE-2021-0001", "old"), ("CVE-2022-0002", "see CVE-2021-0001")],
                                 "CVE_ID string, Description string")
    assert [r.Description for r in listing.lookup(rows, " cve-2021-0001").collect()] == ["old"]


def test_batch_prediction_with_limit_and_errors(spark):
    rows = tables.seed_records(spark).withColumn(
        "Description", F.when(F.col("CVE_ID") != "CVE-2014-0160", F.col("Description")))
    got = {r.CVE_ID: r for r in reports.predict_batch(rows, max_rows=2).collect()}
    assert len(got) == 13
    assert got["CVE-2014-0160"].AI_Severity == "ERROR" and got["CVE-2014-0160"].AI_Confidence == 0
    assert got["CVE-2017-0144"].AI_Severity == "HIGH"
    assert sum(r.AI_Severity is None for r in got.values()) == 11
    assert all(r.AI_Severity is not None for r in reports.predict_batch(rows).collect())


def test_lookup_of_repeated_feed_ids(spark, small):
    raw = raw_records(spark, small)
    have = enrich(raw.filter("Year < '2024'"))
    again = raw.withColumn("Description", F.concat(F.lit("zz "), "Description"))
    got = reports.lookup_sources(have, again.unionByName(raw))
    assert got.count() == raw.count() and got.filter("Description LIKE 'zz %'").isEmpty()


def test_lookup_sources(spark, small):
    raw = raw_records(spark, small)
    have = enrich(raw.filter("Year < '2024'"))
    got = reports.lookup_sources(have, raw)
    assert got.count() == raw.count() and got.columns == TABLE_COLUMNS + ["source"]
    assert got.filter("(Year < '2024') != (source = 'local_database')").isEmpty()


def test_research_projection(spark, small):
    assert enrich(raw_records(spark, small), ruleset="research").select(*RESEARCH_COLUMNS).count() == 200


def test_empty_table_summaries(spark):
    empty = spark.createDataFrame([], TABLE_SCHEMA)
    assert tuple(aggregates.kpis(empty).first()) == (0, 0.0, 0)
    assert {r.n for r in aggregates.score_bins(empty).collect()} == {0}


def test_score_bins_edges(spark):
    rows = spark.createDataFrame([(s,) for s in (0.0, 0.99, 1.0, 9.0, 9.9, 9.95, 10.0)], "CVSS_Score double")
    assert [r.n for r in aggregates.score_bins(rows).orderBy("bin").collect()] == [2, 1, 0, 0, 0, 0, 0, 0, 0, 4]


def test_histogram_equals_numpy(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    for values in (rng.normal(size=500), np.round(rng.uniform(0, 10, 500), 1), np.full(5, 2.0)):
        rows = spark.createDataFrame([(float(v),) for v in values], "CVSS_Score double")
        got = [r.n for r in aggregates.histogram(rows).orderBy("bin").collect()]
        assert got == np.histogram(values, bins=10)[0].tolist()


def test_positions_hold_for_one_hot_year(spark, many_chunks):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "2019").otherwise("2020").alias("Year"),
        F.format_string("CVE-%05d", "id").alias("CVE_ID"), (F.col("id") % 11).cast("double").alias("CVSS_Score"))
    got = sequence.with_position(sequence.ordered_rows(rows)).collect()
    order = sorted(got, key=lambda r: (r.Year, r.CVE_ID))
    assert [r.position for r in order] == list(range(1, 3001))
    assert len({r.chunk for r in got}) > 2


def test_samples_are_stable(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id")
    once = {r.doc_id for r in tables.shuffled_sample(docs, "doc_id", 100).collect()}
    again = {r.doc_id for r in tables.shuffled_sample(docs.repartition(5), "doc_id", 100).collect()}
    other = {r.doc_id for r in tables.shuffled_sample(docs, "doc_id", 100, seed=1).collect()}
    assert once == again and len(once) == 100 and once != other
