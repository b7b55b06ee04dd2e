"""The table placed by key, counts that follow its updates, imports with known ids in state, the search index."""

import bisect
import glob
import os
import random
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from advisoryspark.operators import aggregates, drift, forecast, listing, merge, search_index, tfidf
from advisoryspark.plans.enrich import enrich
from advisoryspark.schemas import TABLE_COLUMNS
from advisoryspark.sources import feed, keyed, store
from advisoryspark.sources.testview import raw_records
from advisoryspark.streaming import bulk_import, kept_statistics, known_ids, live_counts


@pytest.fixture(scope="module")
def records(spark, small):
    return enrich(raw_records(spark, small)).withColumn("seq", F.lit(0).cast("bigint")).cache()


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def versions(records, seed, share):
    """Some of the records with other scores and severities."""
    rng = random.Random(seed)
    changed = records.filter(F.pmod(F.xxhash64("CVE_ID", F.lit(seed)), F.lit(100)) < share)
    return changed.withColumns({"CVSS_Score": F.round(F.lit(rng.random() * 10), 1), "seq": F.lit(seed).cast("bigint"),
                                "True_Severity": F.lit(rng.choice(["LOW", "HIGH", "CRITICAL"])),
                                "Year": F.lit(str(2000 + seed))})


def test_merge_equals_the_log(spark, records, tmp_path):
    root, log = str(tmp_path / "keyed"), str(tmp_path / "log")
    keyed.create(spark, root, buckets=8)
    store.create_if_missing(spark, log)
    for k, batch in enumerate([records, *(versions(records, s, 15) for s in (1, 2, 3))]):
        assert keyed.merge(batch, root, f"b{k}") == k
        store.append_changes(batch, log, f"b{k}")
        assert same(keyed.read(spark, root), store.current(spark, log))
    assert keyed.merge(versions(records, 2, 15), root, "b2") == 2  # run again
    assert same(keyed.read(spark, root), store.current(spark, log))
    assert keyed.merge(records.limit(0), root, "none") == 4
    assert same(keyed.read(spark, root), store.current(spark, log))
    keyed.create(spark, root, buckets=99)
    assert keyed.bucket_count(spark, root) == 8
    with pytest.raises(ValueError):
        keyed.merge(records, root, "a/b")


def test_only_touched_buckets_are_written_and_read(spark, records, tmp_path):
    root = str(tmp_path / "keyed")
    keyed.create(spark, root, buckets=32)
    keyed.merge(records, root, "base")
    before = {f: os.path.getmtime(f) for f in glob.glob(f"{root}/**/*.parquet", recursive=True)}
    one = records.orderBy("CVE_ID").limit(1).withColumn("CVSS_Score", F.lit(1.1))
    wanted = one.first().CVE_ID
    keyed.merge(one, root, "one")
    after = glob.glob(f"{root}/**/*.parquet", recursive=True)
    assert {f: os.path.getmtime(f) for f in before} == before
    assert {re.search("bucket=([0-9]+)/", f)[1] for f in after if "batch=one" in f} == {
        str(next(b for b, f in keyed.folders(spark, root).items() if f.batch == "one"))}
    found = keyed.lookup(spark, root, wanted)
    assert [r.CVSS_Score for r in found.collect()] == [1.1]
    assert len(found.inputFiles()) <= 2 < len(keyed.read(spark, root).inputFiles())
    assert keyed.lookup(spark, root, "CVE-1900-0001").count() == 0
    some = records.filter("CVSS_Score > 9").select("CVE_ID")
    assert same(keyed.lookup_many(spark, root, some), keyed.read(spark, root).join(some, "CVE_ID", "left_semi").select(*TABLE_COLUMNS))


def test_ties_do_not_depend_on_the_order_of_rows(spark, records, tmp_path):
    tied = records.select(*TABLE_COLUMNS, F.lit(5).cast("bigint").alias("seq")).withColumn(
        "CVSS_Score", F.explode(F.array(*[F.lit(x / 10) for x in range(7)])))
    results = []
    for k, batch in enumerate((tied.orderBy("CVSS_Score"), tied.orderBy(F.desc("CVSS_Score")).repartition(5))):
        root = str(tmp_path / f"keyed{k}")
        keyed.create(spark, root, buckets=4)
        keyed.merge(batch, root, "b")
        results.append(keyed.read(spark, root))
    assert same(*results) and results[0].count() == records.count()
    for choose in (merge.latest, merge.first_seen):
        assert same(choose(tied.orderBy("CVSS_Score")), choose(tied.orderBy(F.desc("CVSS_Score")).repartition(5)))


def test_merge_moves_whole_rows_once(spark, records, tmp_path, monkeypatch):
    """Joins see narrow columns only, so a merge grows alike whether Spark broadcasts their other side or not."""
    root, kind, wide = str(tmp_path / "keyed"), type(records), []
    join = kind.join
    monkeypatch.setattr(kind, "join", lambda self, *a, **b: (wide.append("Description" in self.columns), join(self, *a, **b))[1])
    keyed.create(spark, root, buckets=4)
    keyed.merge(records, root, "base")
    keyed.merge(versions(records, 1, 50), root, "changes")
    assert not any(wide)
    assert keyed.read(spark, root).count() == records.count()
    for file in glob.glob(f"{root}/**/*.parquet", recursive=True):
        assert pq.ParquetFile(file).metadata.row_group(0).column(1).compression == "ZSTD"


def test_rows_without_id_and_unfinished_batches(spark, records, tmp_path):
    root = str(tmp_path / "keyed")
    keyed.create(spark, root, buckets=4)
    keyed.merge(records.unionByName(records.limit(3).withColumn("CVE_ID", F.lit(None).cast("string"))), root, "base")
    assert keyed.read(spark, root).count() == records.count()
    keyed.merge(versions(records, 1, 50), root, "lost")
    assert keyed.read(spark, root).filter("Year = '2001'").count() > 0
    os.remove(glob.glob(f"{root}/*/epoch=1/batch=lost/_SUCCESS")[0])  # as if the job had died before its end
    assert same(keyed.read(spark, root), records.select(*TABLE_COLUMNS))
    assert keyed.merge(versions(records, 1, 50), root, "lost") == 1
    assert keyed.read(spark, root).filter("Year = '2001'").count() > 0


def counts_agree(kept, recount):
    """Equal counts; the mean is of exact decimals on one side and of doubles on the other, so halves may round apart."""
    means = [df.filter("dimension = 'total'").first().avg_cvss for df in (kept, recount)]
    return same(kept.drop("avg_cvss"), recount.drop("avg_cvss")) and abs(means[0] - means[1]) < 0.0101


def test_counts_equal_a_recount(spark, records, tmp_path):
    root, kept = str(tmp_path / "table"), str(tmp_path / "counts")
    keyed.create(spark, root, buckets=8)
    assert [tuple(r) for r in live_counts.status(spark, kept).collect()] == [("total", "all", 0, 0.0)]

    def agree():
        return counts_agree(live_counts.status(spark, kept), aggregates.summary(keyed.read(spark, root)))

    for k, batch in enumerate([records.filter("Year < '2024'"), versions(records, 1, 30), records, versions(records, 2, 60)]):
        keyed.merge(batch, root, f"b{k}")
        assert live_counts.refresh(spark, root, kept) == [k] and live_counts.refresh(spark, root, kept) == []
        assert agree()
    # A batch run again, and counts that lost their last epochs, end in the same counts.
    keyed.merge(records, root, "b2")
    assert live_counts.refresh(spark, root, kept) == [] and agree()
    for epoch in (2, 3):
        os.remove(f"{kept}/epoch={epoch}/_SUCCESS")
    assert live_counts.refresh(spark, root, kept) == [2, 3] and agree()
    # Values that no record has any more are gone, not zero.
    keyed.merge(records.withColumn("Exploit_Type", F.lit("One")), root, "b4")
    live_counts.refresh(spark, root, kept)
    assert live_counts.counts(spark, kept).filter("dimension = 'exploit'").count() == 1 and agree()


def test_counts_of_a_stream(spark, records, tmp_path):
    base = str(tmp_path)
    for part in (records.filter("Year < '2024'"), versions(records, 1, 30), records):
        part.select(*TABLE_COLUMNS, "seq").coalesce(1).write.mode("append").parquet(f"{base}/changes")
        live_counts.start(spark, f"{base}/changes", f"{base}/table", f"{base}/counts", f"{base}/checkpoint",
                          files_per_batch=1).awaitTermination()
        assert counts_agree(live_counts.status(spark, f"{base}/counts"),
                            aggregates.summary(keyed.read(spark, f"{base}/table")))
    assert len(keyed.batches(spark, f"{base}/table")) == 3
    assert same(keyed.read(spark, f"{base}/table"), records.select(*TABLE_COLUMNS))


def imports(spark, small, base):
    """Feed files with overlapping and repeated ids, in two deliveries."""
    raw = raw_records(spark, small)
    late = raw.filter("Year >= '2020'").withColumn("CVSS_Score", F.lit(1.5))
    for k, some in enumerate((raw.filter("Year < '2023'"), late.unionByName(late.withColumn("CVSS_Score", F.lit(2.5))))):
        feed.as_feed_documents(some, per_document=30).repartition(3).write.json(f"{base}/feed{k}")
        with open(f"{base}/feed{k}/broken.json", "w") as broken:
            broken.write("{oops\n")
    return [f"{base}/feed{k}" for k in range(2)]


def test_state_imports_what_the_anti_join_imports(spark, small, tmp_path):
    base = str(tmp_path)
    feeds = imports(spark, small, base)
    for k, path in enumerate(feeds):
        for query in known_ids.start(spark, path, f"{base}/state", f"{base}/rejects", f"{base}/c{k}", 1, multiline=False):
            query.awaitTermination()
        bulk_import.start_import(spark, path, f"{base}/join", f"{base}/joinrejects", f"{base}/j{k}", 1,
                                 multiline=False).awaitTermination()
    a, b = store.current(spark, f"{base}/state"), store.current(spark, f"{base}/join")
    assert a.count() == b.count() == 200
    ids = a.select("CVE_ID").join(b.select("CVE_ID"), "CVE_ID")
    assert ids.count() == 200 and a.filter("CVSS_Score IN (1.5, 2.5)").count() == b.filter("CVSS_Score IN (1.5, 2.5)").count()
    assert spark.read.json(f"{base}/rejects").filter("reason = 'broken document'").count() == 2
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").find("RocksDB") < 0


def test_state_survives_a_restart_and_reads_no_table(spark, small, tmp_path):
    base, raw = str(tmp_path), raw_records(spark, small)

    def deliver(records, name):
        feed.as_feed_documents(records, per_document=50).coalesce(1).write.mode("append").json(f"{base}/feed")
        for query in known_ids.start(spark, f"{base}/feed", f"{base}/table", f"{base}/rejects", f"{base}/check",
                                     multiline=False):
            query.awaitTermination()
        return store.log(spark, f"{base}/table").count()

    assert deliver(raw.filter("Year < '2022'"), "a") == raw.filter("Year < '2022'").count()
    # Without the table's files the state alone knows what was imported.
    moved = store.log(spark, f"{base}/table").select("CVE_ID").collect()
    for file in glob.glob(f"{base}/table/epoch=*/batch=*/*.parquet"):
        os.remove(file)
    assert deliver(raw, "b") == 200 - len(moved)


@pytest.mark.parametrize("segment", [16, 1 << 16])
def test_index_finds_what_a_scan_finds(spark, records, tmp_path, segment):
    root = str(tmp_path / "index")
    table = records.drop("seq")
    search_index.build(table, root, segment)
    texts = [r.Description for r in table.select("Description").collect()]
    rng = random.Random(3)
    terms = ["kernel", "KERNEL", "k", "", "%", "__", "a%b", "In_ection", "100%", "cve-2019", "\\", "é", "ÉRE", "no such text here"]
    for _ in range(6):
        text = rng.choice(texts)
        at = rng.randrange(len(text))
        terms.append(text[at:at + rng.randint(2, 12)].swapcase())
    for term in terms:
        want = {r.CVE_ID for r in table.filter(listing.search_predicate(term)).select("CVE_ID").collect()}
        found = search_index.search(spark, root, term)
        assert found.columns == table.columns
        assert sorted(r.CVE_ID for r in found.select("CVE_ID").collect()) == sorted(want), term


def test_index_reads_few_texts(spark, records, tmp_path):
    root = str(tmp_path / "index")
    rare = records.drop("seq").withColumn("Description", F.when(F.col("CVE_ID").endswith("07"), F.concat(
        F.lit("Quuxly "), "Description")).otherwise(F.col("Description")))
    search_index.build(rare.coalesce(2), root, 16)
    whole = search_index.texts(spark, root)
    found = search_index.search(spark, root, "quuxly")
    assert found.count() == 2
    assert len(found.inputFiles()) > 2  # names all files; the plan's own filter prunes them
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "segment" in plan
    read = whole.filter(F.col("segment").isin([r.segment for r in search_index.candidates(
        spark, root, search_index.term_grams(spark, "quuxly")).collect()]))
    assert read.count() <= 32 < whole.count()
    empty = str(tmp_path / "empty")
    search_index.build(rare.limit(0), empty)
    assert search_index.term_grams(spark, "a%bc_d") == [] and len(search_index.term_grams(spark, "abcd%abc")) == 2


def test_statistics_equal_a_full_fit(spark, records, tmp_path):
    root, kept = str(tmp_path / "table"), str(tmp_path / "kept")
    keyed.create(spark, root, buckets=8)
    reworded = versions(records, 3, 40).withColumns({"Cleaned_Description": F.concat(F.lit("zz top zz a "), "Cleaned_Description"),
                                                     "CWE": F.lit("CWE-1")})

    def agree():
        now = keyed.read(spark, root)
        full = tfidf.fit(now, 30)
        mine = kept_statistics.tfidf_model(spark, kept, 30)
        assert same(kept_statistics.vocabulary(spark, kept, 30), tfidf.vocabulary(now, 30))
        assert mine.stages[1].vocabulary == full.stages[1].vocabulary
        assert list(mine.stages[2].getScalingVec()) == list(full.stages[2].getScalingVec())
        for by in (None, "Exploit_Type"):
            assert same(kept_statistics.yearly_counts(spark, kept, by is not None), forecast.yearly_counts(now, by))
        means = {r.CWE: (r.n, round(r.mean, 9)) for r in kept_statistics.mean_scores(spark, kept).collect()}
        assert means == {r.CWE: (r.n, round(r.m, 9)) for r in now.groupBy("CWE").agg(
            F.count("*").alias("n"), F.avg("CVSS_Score").alias("m")).collect()}

    for k, batch in enumerate([records.filter("Year < '2024'"), reworded, records]):
        keyed.merge(batch, root, f"b{k}")
        assert kept_statistics.refresh(spark, root, kept) == [k] and kept_statistics.refresh(spark, root, kept) == []
        agree()
    kept_statistics.compact(spark, kept)
    assert kept_statistics.records(spark, kept) == records.count()
    agree()
    keyed.merge(reworded, root, "b3")
    assert kept_statistics.refresh(spark, root, kept) == [3]
    agree()
    assert kept_statistics.read(spark, kept, "texts").filter("key = 'zz'").count() == 1


def test_drift_by_sketches(spark, tmp_path):
    path = str(tmp_path / "log")
    old, new = (spark.range(20_000).select((F.rand(s) * 10 + shift).alias("x"), (F.col("id") % 3).alias("d"))
                for s, shift in ((1, 0.0), (2, 1.5)))
    for part in range(4):
        for name, rows in (("old", old), ("new", new), ("same", old)):
            drift.log_sketch(rows.filter(F.pmod(F.xxhash64("x"), F.lit(4)) == part), path, name, "x",
                             F.date_add(F.lit("2026-01-01").cast("date"), F.col("d").cast("int")))
    drift.log_sketch(old.select(F.lit(None).cast("double").alias("x")).limit(5), path, "empty", "x")
    drift.log_sketch(old.select(F.lit(None).cast("double").alias("x")).limit(5), path, "new", "x")
    found = {r.model_version: r for r in drift.compare(spark, path, "old").collect()}
    assert set(found) == {"old", "new", "same"} and found["new"].n == 20_000
    a, b = (sorted(r.x for r in rows.collect()) for rows in (old, new))
    exact = max(abs(bisect.bisect_right(a, x) - bisect.bisect_right(b, x)) / 20_000 for x in a + b)
    assert abs(found["new"].ks - exact) < 1 / drift.GRID + 2 * 0.0014
    assert max(found["old"].ks, found["same"].ks) < 1 / drift.GRID + 2 * 0.0014
    assert found["new"].psi > 0.25 > 0.01 > found["same"].psi
    daily = drift.compare(spark, path, "old", per_day=True)
    assert daily.count() == 9 and daily.filter("model_version = 'old' AND ks > 0.05").count() == 0
    assert drift.compare(spark, path, "unknown").count() == 0
