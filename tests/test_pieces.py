"""Texts and ids looked through once: rule pieces and cleaned text, postings, ids of a stream."""

import random
import re
import uuid

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from advisoryspark import catalog, fixed_values as fx
from advisoryspark.functions import pieces, text
from advisoryspark.operators import search_index, tfidf
from advisoryspark.plans.enrich import with_rule_labels
from advisoryspark.streaming import known_ids

KNOWN = ("rce", "arbitrary code", "../", "use", "v8 engine")
TEXTS = ["source", "", None, "arbitrary", " code rce", "../../", "us", "e", "é arbitrary code é", "v8 engin", "e!", "  ", "a-€-b",
         "v8 engine", "x" * 50 + "use"]


@pytest.mark.parametrize("step", [1, 7, 1 << 20])
def test_pieces_and_cleaned_text_of_every_cut(monkeypatch, step):
    monkeypatch.setattr(pieces, "STEP", step)
    rng = random.Random(step)
    texts = TEXTS + ["".join(rng.choice(["use", "v8 ", "engine", ".", "./", "rc", "e", "é", " "]) for _ in range(9)) for _ in range(200)]
    for given in (pa.array(texts), pa.array(texts).slice(3), pa.array(texts[:0], pa.string()), pa.array([None, ""], pa.string())):
        found = pieces.Finder(KNOWN).look(given).to_pylist()
        for one, got in zip(given.to_pylist(), found, strict=True):
            if one is None:
                assert got is None
                continue
            assert [p for i, p in enumerate(KNOWN) if got["w0"] >> i & 1] == [p for p in KNOWN if p in one]
            words = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in one).split()
            assert got["cleaned"] == " ".join(words)


@pytest.mark.parametrize("ruleset", ["current", "research"])
def test_rule_labels_equal_the_plain_rules(spark, ruleset):
    rng = random.Random(5)
    rules = [pattern for listed in text.RULESETS[ruleset] for _, pattern in listed]
    bits = [a.replace("\\b", rng.choice(["", " "])).replace("\\.", ".").replace(".*", "\n" if i % 7 == 0 else " x ")
            for i, pattern in enumerate(rules) for a in pattern.split("|")]
    rows = [(" ".join(rng.sample(bits, rng.randint(0, 3))).title(), 1.0) for _ in range(400)] + [(None, None), ("", 0.0)]
    raw = spark.createDataFrame(rows, "Description string, CVSS_Score double")
    exploits, components, impacts = text.RULESETS[ruleset]
    lowered = F.lower("Description")
    got = with_rule_labels(raw, ruleset).withColumns({
        "e": text.first_match(lowered, exploits, fx.DEFAULT_EXPLOIT), "c": text.first_match(lowered, components, fx.DEFAULT_COMPONENT),
        "i": text.all_matches(lowered, impacts, fx.DEFAULT_IMPACT), "t": text.clean_text(F.col("Description"))})
    for row in got.collect():
        assert (row.Exploit_Type, row.Affected_Component, row.Impact, row.Cleaned_Description) == (row.e, row.c, row.i, row.t)


def test_the_text_is_read_once_for_all_plain_rules(spark):
    raw = spark.createDataFrame([("x", 1.0)], "Description string, CVSS_Score double")
    plan = with_rule_labels(raw)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and set(re.findall(r"Contains\(_lowered#\d+, (.*?)\)", plan)) <= {"of", "in"}
    assert plan.count("ArrowEvalPython") == 1


def test_postings_are_extracted_once(spark, tmp_path, monkeypatch):
    calls, extract = tmp_path / "calls", search_index._postings
    calls.mkdir()

    def counted(batches):
        (calls / uuid.uuid4().hex).touch()
        return extract(batches)

    monkeypatch.setattr(search_index, "_postings", counted)
    rows = [(f"CVE-2020-{k}", f"text {k} kernel") for k in range(50)]
    table = spark.createDataFrame(rows, "CVE_ID string, Description string")
    monkeypatch.setattr(search_index.listing, "SEARCHED", ["CVE_ID", "Description"])
    search_index.build(table.coalesce(1), str(tmp_path / "index"), 16)
    assert len(list(calls.iterdir())) == spark.read.parquet(str(tmp_path / "index" / "texts")).rdd.getNumPartitions()


def test_postings_of_unordered_rows_are_in_order():
    batch = pa.record_batch([pa.array([1, 0, 0]), pa.array([20, 3, 1]), pa.array(["abcd", "abc", "xabc"])], names=["segment", "place", "t"])
    out = next(search_index._postings(iter([batch]))).to_pylist()
    abc = search_index._grams("abc")[0]
    assert [(r["segment"], r["rows"]) for r in out if r["gram"] == abc] == [(0, [1, 3]), (1, [20])]


def test_ids_of_a_bucket_come_together():
    class Known(dict):
        containsKey = dict.__contains__
        updateValue = dict.__setitem__

    columns = ["CVE_ID", "Description", "CVSS_Score", "source_file", "place"]
    first = known_ids.FirstOfId(columns)
    first.known = Known()
    first.handleInitialState((0,), pd.DataFrame({"CVE_ID": ["d", "e"]}), None)
    parts = [pd.DataFrame([("a", "late", 1.0, "f2", 0), ("b", "only", 1.0, "f2", 1), ("d", "known", 1.0, "f2", 2)], columns=columns),
             pd.DataFrame([("a", "first", 1.0, "f1", 9), ("c", "one", 1.0, "f1", 1), ("c", "two", 1.0, "f1", 2)], columns=columns)]
    out = pd.concat(first.handleInputRows((0,), iter(parts), None))
    assert sorted(out.Description) == ["first", "one", "only"] and list(out.columns) == columns
    assert list(first.handleInputRows((0,), iter(parts), None)) == []


def test_terms_are_counted_on_the_stored_cleaned_text(spark, monkeypatch):
    asked, fit = [], tfidf.fit
    monkeypatch.setattr(tfidf, "fit", lambda records, *more: asked.append(records.columns) or fit(records, *more))
    table = spark.createDataFrame([("a", "Some text", "some text")], "CVE_ID string, Description string, Cleaned_Description string")
    monkeypatch.setattr(catalog, "stored", lambda *_: table)
    assert catalog.tfidf_weights(spark, "unused").count() == 2
    assert "Cleaned_Description" in asked[0]
