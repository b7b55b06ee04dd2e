"""A sequence that grows by batches decodes as one sorted and decoded from scratch."""

import glob
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from advisoryspark.operators import growing, hmm, sequence

MODEL = {"means": [2.0, 5.0, 8.0], "variances": [1.5, 1.0, 2.0], "startprob": [0.3, 0.4, 0.3],
         "transmat": [[0.7, 0.2, 0.1], [0.2, 0.6, 0.2], [0.1, 0.3, 0.6]]}
STEPS, NAME = hmm.path_steps(MODEL), growing.model_name(MODEL)
SCHEMA = "CVE_ID string, Year string, CVSS_Score double"


def path(df):
    return [tuple(r) for r in df.select("Year", "CVE_ID", "CVSS_Score", "state").orderBy("Year", "CVE_ID").collect()]


def from_scratch(spark, rows):
    table = spark.createDataFrame([(i, y, x) for (y, i), x in rows.items()], SCHEMA)
    return path(hmm.decode(sequence.ordered_rows(table), MODEL, segment=50))


def test_ten_batches_decode_as_from_scratch(spark, tmp_path):
    rng, root, rows = random.Random(1), str(tmp_path / "seq"), {}
    for k in range(10):
        batch = {(str(2010 + rng.randint(0, 9) if k % 3 else 2010 + k), f"CVE-{rng.randint(0, 400):04}"): round(rng.random() * 10, 1)
                 for _ in range(40)}
        rows |= batch
        table = spark.createDataFrame([(i, y, x) for (y, i), x in batch.items()], SCHEMA).repartition(3)
        assert growing.append(table, root, f"b{k}", segment=25) == k
        held = growing.segments(spark, root)
        state = growing.newest_state(spark, root, STEPS, NAME)
        if k % 3 == 0 or k == 9:
            want = from_scratch(spark, rows)
            assert path(growing.decode(spark, root, STEPS, NAME)) == want
            assert state == want[-1][-1]
    sizes = growing._rows(spark, held).groupBy("segment").count().collect()
    assert len(sizes) > 8 and max(r["count"] for r in sizes) <= 25
    assert growing.append(table, root, "b9", segment=25) == 9  # run again
    assert path(growing.decode(spark, root, STEPS, NAME)) == want
    since = want[len(want) // 2][:2]
    assert path(growing.decode(spark, root, STEPS, NAME, since)) == want[len(want) // 2:]


def test_only_touched_segments_are_read(spark, tmp_path):
    root = str(tmp_path / "seq")
    base = spark.range(500).select(F.format_string("CVE-%04d", "id").alias("CVE_ID"), F.lit("2020").alias("Year"),
                                   (F.col("id") % 100 / 10).alias("CVSS_Score"))
    growing.append(base, root, "base", segment=50)
    before = growing.segments(spark, root)
    growing.products(spark, root, STEPS, NAME)
    one = base.filter("CVE_ID = 'CVE-0250'").withColumn("CVSS_Score", F.lit(9.9))
    growing.append(one, root, "one", segment=50)
    after = growing.segments(spark, root)
    changed = [s for s in after if before.get(s) != after[s]]
    assert len(before) >= 10 and len(changed) == 1
    # Without the files of the other segments the new state is found all the same.
    for s, folder in after.items():
        if s not in changed:
            for file in glob.glob(re.sub("^file:", "", folder.path) + "/*.parquet"):
                os.remove(file)
    kept = growing.products(spark, root, STEPS, NAME)
    assert list(kept) == list(after) and growing.newest_state(spark, root, STEPS, NAME) is not None


def test_cases(spark, tmp_path):
    root = str(tmp_path / "seq")
    empty = spark.createDataFrame([], SCHEMA)
    growing.append(empty, root, "empty")
    assert growing.newest_state(spark, root, STEPS, NAME) is None
    assert growing.decode(spark, root, STEPS, NAME).count() == 0
    rows = [("A", "2020", 1.0), ("A", "2020", 9.0), (None, "2020", 5.0), ("B", None, 5.0), ("B", "2020", 5.0)]
    growing.append(spark.createDataFrame(rows, SCHEMA), root, "rows")
    growing.append(empty, root, "nothing")
    found = path(growing.decode(spark, root, STEPS, NAME))
    assert [r[1] for r in found] == ["A", "B"]
    tied = [spark.createDataFrame(rows[:2][::s], SCHEMA) for s in (1, -1)]
    for k, batch in enumerate(tied):
        growing.append(batch, str(tmp_path / f"tie{k}"), "t")
    assert path(growing.decode(spark, str(tmp_path / "tie0"), STEPS, NAME)) == path(
        growing.decode(spark, str(tmp_path / "tie1"), STEPS, NAME))
    ordered = spark.createDataFrame([("A", "2020", 1.0, 2), ("A", "2020", 9.0, 1)], SCHEMA + ", seq int")
    growing.append(ordered, root, "ordered", order=("seq",))
    assert path(growing.decode(spark, root, STEPS, NAME))[0][2] == 1.0
    with pytest.raises(ValueError):
        growing.append(empty, root, "a b")


def test_fit_does_not_depend_on_the_cut_into_files(spark, many_chunks, monkeypatch):
    rng = random.Random(4)
    rows = [(f"CVE-{k:04}", str(2015 + k // 100), round(rng.gauss((2, 5, 8)[k // 7 % 3], 1), 3)) for k in range(900)]
    whole = sequence.ordered_rows(spark.createDataFrame(rows, SCHEMA))
    want = hmm.fit(whole, max_iterations=4)
    torn = whole.repartition(6, "CVE_ID")  # hardly two neighbours in one task
    for limit in (10_000, 50):
        monkeypatch.setattr(hmm, "MAX_RUNS", limit)
        assert hmm._has_many_runs(torn) == (limit == 50)
        got = hmm.fit(torn, max_iterations=4)
        for name in ("means", "variances", "startprob", "log_likelihood"):
            assert got[name] == pytest.approx(want[name], rel=1e-9)
    monkeypatch.setattr(hmm, "MAX_SCORES", 100)
    assert hmm.start_model(whole)["means"] == pytest.approx(want_start(rows), abs=0.05)


def want_start(rows):
    scores = sorted(r[2] for r in rows)
    return [scores[int(len(scores) * q)] for q in (1 / 6, 1 / 2, 5 / 6)]
