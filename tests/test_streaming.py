"""The stream gives the same table however the files are cut, and replays change nothing."""

import json

import pytest
from pyspark.sql import functions as F

from advisoryspark.plans.enrich import enrich
from advisoryspark.sources import feed, store
from advisoryspark.sources.testview import raw_records
from advisoryspark.streaming import bulk_import


@pytest.fixture()
def feed_dir(spark, small, tmp_path):
    path = tmp_path / "feed"
    raw = raw_records(spark, small).repartition(6)
    feed.as_feed_documents(raw, per_document=1000).repartition(6).write.json(str(path))
    (path / "broken.json").write_text("{oops\n")
    bad = {"vulnerabilities": [{"cve": {"id": "NOT-AN-ID", "descriptions": []}}]}
    (path / "bad.json").write_text(json.dumps(bad) + "\n")
    return str(path)


def run(spark, feed_dir, base, files_per_batch):
    root, rejects = str(base / "table"), str(base / "rejects")
    bulk_import.start_import(spark, feed_dir, root, rejects, str(base / "checkpoint"),
                             files_per_batch, multiline=False).awaitTermination()
    return root, rejects


def test_one_or_many_batches_and_replay(spark, small, feed_dir, tmp_path):
    expected = enrich(raw_records(spark, small).withColumn("OS", F.lit("Cross-Platform")))
    for name, files in (("one", 1000), ("many", 1)):
        root, rejects = run(spark, feed_dir, tmp_path / name, files)
        got = store.current(spark, root)
        assert got.count() == expected.count()
        assert got.exceptAll(expected).isEmpty() and expected.exceptAll(got).isEmpty()
        assert sorted(r.reason for r in spark.read.json(rejects).collect()) == ["broken document", "malformed id"]
    # The stream started again finds nothing new; a replayed batch writes the same rows.
    root, _ = run(spark, feed_dir, tmp_path / "many", 1)
    assert store.current(spark, root).count() == expected.count()
    documents = feed.read_feed(spark, feed_dir, multiline=False)
    one = str(tmp_path / "one" / "table")
    bulk_import.import_batch(spark, documents, one, "again")
    bulk_import.import_batch(spark, documents, one, "again")
    assert store.current(spark, one).exceptAll(expected).isEmpty()
    assert store.current(spark, one).count() == expected.count()


def test_known_ids_are_skipped(spark, small, feed_dir, tmp_path):
    root = str(tmp_path / "table")
    store.create_if_missing(spark, root)
    edited = enrich(raw_records(spark, small)).withColumn("Impact", F.lit("edited")).withColumn(
        "seq", F.lit(0).cast("bigint"))
    store.append_changes(edited.filter("Year < '2024'"), root)
    bulk_import.import_batch(spark, feed.read_feed(spark, feed_dir, multiline=False), root, "import")
    got = store.current(spark, root)
    assert got.count() == 200
    assert got.filter("Impact = 'edited'").count() == edited.filter("Year < '2024'").count()


def test_imports_into_one_table_keep_each_other(spark, small, tmp_path):
    raw = raw_records(spark, small)
    root, base = str(tmp_path / "table"), tmp_path

    def load(name, records, checkpoint):
        feed.as_feed_documents(records, per_document=20).repartition(3).write.json(str(base / name))
        bulk_import.start_import(spark, str(base / name), root, str(base / "rejects"), str(base / checkpoint), 1,
                                 multiline=False).awaitTermination()
        return store.current(spark, root).count()

    n_early = raw.filter("Year < '2020'").count()
    assert load("early", raw.filter("Year < '2020'"), "c1") == n_early
    assert load("rest", raw, "c2") == 200
    # A manual change survives an import, and a lost checkpoint imports nothing twice.
    edited = enrich(raw.limit(1)).withColumn("Impact", F.lit("edited")).withColumn("seq", F.lit(0).cast("bigint"))
    store.append_changes(edited, root)
    assert load("again", raw, "c3") == 200
    bulk_import.start_import(spark, str(base / "rest"), root, str(base / "rejects"), str(base / "c4"),
                             multiline=False).awaitTermination()
    got = store.current(spark, root)
    assert got.count() == 200 and got.filter("Impact = 'edited'").count() == 1


def test_streaming_counts(spark, small, tmp_path):
    table_dir = str(tmp_path / "arriving")
    records = enrich(raw_records(spark, small))
    records.filter("Year < '2024'").write.parquet(table_dir)
    expected = {r.True_Severity: r["count"] for r in records.groupBy("True_Severity").count().collect()}
    checkpoint = str(tmp_path / "checkpoint")
    bulk_import.start_severity_counts(spark, table_dir, "kpi_part", checkpoint + "1").awaitTermination()
    records.filter("Year >= '2024'").write.mode("append").parquet(table_dir)
    bulk_import.start_severity_counts(spark, table_dir, "kpi_all", checkpoint + "2").awaitTermination()
    assert sum(r.n for r in spark.table("kpi_part").collect()) < 200
    assert {r.True_Severity: r.n for r in spark.table("kpi_all").collect()} == expected
