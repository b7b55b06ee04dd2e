"""Scalar functions against plain Python on edge cases and random texts."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from advisoryspark import fixed_values as fx
from advisoryspark.functions import ids, replies, scores, sequences, text
from advisoryspark.operators import listing

EDGE_TEXTS = [
    None, "", "!!! ???", "Resource", "a password", "buffer overflow and sql injection",
    "remote code execution; crash; sensitive", "execute\ncommand", "execute the\rcommand",
    "DOS dos ados dos_x édos dosé dos", "../etc", "a.b/ ..", "denial-of-service", "Use After Free",
    "cross site  scripting", "gain\troot privilege", "api apis", "LOGIN via OAuth", "Ünïcode ßtraße É",
    "TCP/IP", "edge browser", "webapp os kernel", "  spaces   everywhere ",
]


def python_first(rules, value, default):
    for name, pattern in rules:
        if re.search(pattern, value.lower()):
            return name
    return default


def python_impact(rules, value):
    return ", ".join(n for n, p in rules if re.search(p, value.lower())) or "Unknown"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    literals = sorted({w for rules in (fx.EXPLOIT_RULES, fx.COMPONENT_RULES, fx.IMPACT_RULES)
                       for _, p in rules for w in re.split(r"[|.*\\ ]+", p) if w})
    joins = [" ", "", "\n", "\r", "-", ".", "é", "_"]
    made = ["".join(x for _ in range(rng.randint(1, 12)) for x in (rng.choice(literals), rng.choice(joins)))
            for _ in range(1500)]
    return [t for t in EDGE_TEXTS if t is not None] + made


@pytest.mark.parametrize("ruleset", ["current", "research"])
def test_rules_equal_python_regexes(spark, texts, ruleset):
    exploits, components, impacts = text.RULESETS[ruleset]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select(
        "t", text.exploit_type(F.col("t"), ruleset).alias("e"),
        text.component(F.col("t"), ruleset).alias("c"), text.impact(F.col("t"), ruleset).alias("m")).collect()
    for r in rows:
        assert r.e == python_first(exploits, r.t, "Other"), repr(r.t)
        assert r.c == python_first(components, r.t, "Unknown"), repr(r.t)
        assert r.m == python_impact(impacts, r.t), repr(r.t)


def test_rules_with_other_regex_syntax(spark):
    rules = [("digits", r"v\d+|x{2}"), ("group", r"(ab|cd)e"), ("class", r"[qz]w"), ("star", r"go*gle")]
    words = ["v12", "xx", "cde", "zw", "ggle", "none"]
    got = spark.createDataFrame([(w,) for w in words], "t string").select(
        "t", text.first_match(F.col("t"), rules, "-").alias("l")).collect()
    assert [(r.t, r.l) for r in got] == [(w, python_first(rules, w, "-")) for w in words]


def test_null_text_takes_defaults(spark):
    row = spark.createDataFrame([(None,)], "t string").select(
        text.clean_text(F.col("t")).alias("a"), text.exploit_type(F.col("t")).alias("b"),
        text.component(F.col("t")).alias("c"), text.impact(F.col("t")).alias("d"),
        F.size(text.tokens(text.clean_text(F.col("t")))).alias("n")).first()
    assert tuple(row) == ("", "Other", "Unknown", "Unknown", 0)


def test_clean_text_equals_python(spark, texts):
    def python_clean(value):
        value = re.sub(r"[^a-z0-9\s]", " ", value.lower())
        return re.sub(r"\s+", " ", value).strip()

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", text.clean_text(F.col("t")).alias("c"),
        text.tokens(text.clean_text(F.col("t"))).alias("w")).collect()
    for r in rows:
        assert r.c == python_clean(r.t)
        assert r.w == python_clean(r.t).split()


def test_severity_and_state_edges(spark):
    cases = [(None, "UNKNOWN", None), (math.nan, "LOW", "High Threat"), (-1.0, "LOW", "Low Threat"),
             (0.0, "UNKNOWN", "Low Threat"), (0.1, "LOW", "Low Threat"), (3.9, "LOW", "Low Threat"),
             (4.0, "MEDIUM", "Medium Threat"), (6.9, "MEDIUM", "Medium Threat"), (7.0, "HIGH", "High Threat"),
             (8.9, "HIGH", "High Threat"), (9.0, "CRITICAL", "High Threat"), (10.0, "CRITICAL", "High Threat")]
    rows = spark.createDataFrame([(c[0],) for c in cases], "s double").select(
        scores.severity(F.col("s")).alias("a"), scores.threat_state(F.col("s")).alias("b")).collect()
    assert [(r.a, r.b) for r in rows] == [(a, b) for _, a, b in cases]


def test_confidence_bounds(spark):
    row = spark.range(1).select(
        scores.confidence(F.lit(5.0), F.lit(5.0)).alias("same"),
        scores.confidence(F.lit(10.0), F.lit(1.0)).alias("far"),
        scores.confidence(F.lit(7.0), F.lit(5.5)).alias("near")).first()
    assert tuple(row) == (1.0, 0.6, 0.85)


def test_ids(spark):
    raw = [" cve-2021-44228 ", "CVE-2021-123", "CVE-21-1234", "", " CVE-1999-0001\n", None]
    rows = spark.createDataFrame([(r,) for r in raw], "i string").withColumn("n", ids.normalize_id(F.col("i"))).select(
        "n", ids.is_valid_id(F.col("n")).alias("strict"), ids.is_valid_id(F.col("n"), strict=False).alias("loose"),
        ids.year_from_id(F.col("n")).alias("y")).collect()
    assert [tuple(r) for r in rows] == [
        ("CVE-2021-44228", True, True, "2021"), ("CVE-2021-123", False, True, "2021"),
        ("CVE-21-1234", False, False, "Unknown"), ("", False, False, "Unknown"),
        ("CVE-1999-0001", True, True, "1999"), (None, False, False, "Unknown")]


def test_reply_forms(spark):
    body = '{"severity":"HIGH","cvss_score":8,"exploit_type":"RCE","affected_component":"x","impact":"y","confidence":90,"reasoning":"z"}'
    rows = spark.createDataFrame([(body,), (f"```json\n{body}\n```",), ("{broken",)], "r string").select(
        replies.parse_reply(F.col("r")).alias("p")).select("p.*").collect()
    assert rows[0] == rows[1] and tuple(rows[0]) == ("HIGH", 8.0, "RCE", "x", "y", 90.0, "z")
    assert all(v is None for v in rows[2])


def test_rule_prediction_reasoning(spark):
    row = spark.createDataFrame([("plain text", 0.0)], "d string, s double").select(
        *replies.rule_prediction(F.lower("d"), F.col("s"))).first()
    assert row.severity == "UNKNOWN" and row.confidence == 50
    assert row.affected_component == row.impact == "See description"
    assert row.reasoning == "CVSS 0.0 maps to UNKNOWN. Pattern matched: Other."


def test_search_terms(spark):
    rows = spark.createDataFrame([("CVE-1", "a 100% sure\\thing", "Nginx"), ("CVE-2", "a_b MiXed", "PHP")],
                                 "CVE_ID string, Description string, Affected_Component string")

    def found(term):
        return [r.CVE_ID for r in listing.filter_records(rows, search=term).orderBy("CVE_ID").collect()]

    assert found("") == ["CVE-1", "CVE-2"]
    assert found("mixed") == ["CVE-2"]
    assert found("NGINX") == ["CVE-1"]
    assert found("e\\t") == ["CVE-1"]
    assert found("a_b") == ["CVE-2"] and found("a%b") == ["CVE-2"]
    assert found("a%s") == ["CVE-1"]


def test_token_sequences(spark):
    cleaned = spark.createDataFrame([("a", "x y x"), ("b", ""), ("c", "x " * 200), ("d", "new x")],
                                    "CVE_ID string, Cleaned_Description string")
    vocab = sequences.vocabulary(cleaned, size=2)
    assert {r.token: r.token_id for r in vocab.collect()} == {"x": 2, "new": 3}
    rows = {r.CVE_ID: r for r in sequences.encode(cleaned, vocab, length=4).collect()}
    assert rows["a"].input_ids == [2, 1, 2, 0] and rows["a"].attention_mask == [1, 1, 1, 0]
    assert rows["b"].input_ids == [0] * 4 and rows["b"].attention_mask == [0] * 4
    assert rows["c"].input_ids == [2] * 4 and rows["c"].attention_mask == [1] * 4
    assert rows["d"].input_ids == [3, 2, 0, 0]


LABELLED_BY_HAND = [
    ("A remote code execution flaw in the linux kernel lets users run arbitrary code", "RCE", "Linux Kernel"),
    ("Cross site scripting in a wordpress plugin", "XSS", "WordPress"),
    ("SQL injection in mysql admin panel", "SQLi", "Database"),
    ("Heap overflow and out-of-bounds write in openssl", "Buffer Overflow", "OpenSSL"),
    ("Elevation of privilege in win32k", "Privilege Escalation", "Windows Kernel"),
    ("Denial of service crash in nginx via infinite loop", "DoS", "Nginx"),
    ("Shell injection in router firmware", "Command Injection", "Network Device"),
    ("Information disclosure of sensitive data in a rest endpoint", "Info Disclosure", "API / Service"),
    ("Authentication bypass in spring boot login", "Auth Bypass", "Spring Framework"),
    ("Directory traversal in file upload", "Path Traversal", "File System"),
    ("CSRF in the smtp gateway", "CSRF", "Network Device"),
    ("Open redirect in the vpn portal", "Open Redirect", "Network Device"),
    ("Certificate check missing in docker", "Other", "Container"),
    ("Nothing of note", "Other", "Unknown"),
]


def test_labels_by_hand(spark):
    """Labels written down from the meaning of the rules, independent of the table of patterns."""
    got = spark.createDataFrame([(t,) for t, _, _ in LABELLED_BY_HAND], "t string").select(
        "t", text.exploit_type(F.col("t")).alias("e"), text.component(F.col("t")).alias("c")).collect()
    assert [(r.t, r.e, r.c) for r in got] == LABELLED_BY_HAND
