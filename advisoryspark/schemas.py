"""Schemas of the enriched table and of the nested feed documents."""

from pyspark.sql import types as T

TABLE_SCHEMA = T.StructType([
    T.StructField("CVE_ID", T.StringType()),
    T.StructField("Description", T.StringType()),
    T.StructField("Cleaned_Description", T.StringType()),
    T.StructField("Year", T.StringType()),
    T.StructField("CVSS_Score", T.DoubleType()),
    T.StructField("CWE", T.StringType()),
    T.StructField("OS", T.StringType()),
    T.StructField("Exploit_Type", T.StringType()),
    T.StructField("Affected_Component", T.StringType()),
    T.StructField("Impact", T.StringType()),
    T.StructField("True_Severity", T.StringType()),
    T.StructField("Predicted_Severity", T.StringType()),
    T.StructField("Severity_Confidence", T.DoubleType()),
    T.StructField("BERT_Category", T.StringType()),
    T.StructField("BERT_Confidence", T.DoubleType()),
])

TABLE_COLUMNS = TABLE_SCHEMA.fieldNames()

# The narrower table of the research workflow.
RESEARCH_COLUMNS = [
    "CVE_ID", "Description", "Year", "CVSS_Score", "CWE", "OS", "Exploit_Type",
    "Affected_Component", "Impact", "Predicted_Severity", "Severity_Confidence",
    "True_Severity",
]

_METRIC = T.ArrayType(T.StructType([
    T.StructField("cvssData", T.StructType([T.StructField("baseScore", T.DoubleType())])),
]))
_TEXTS = T.ArrayType(T.StructType([
    T.StructField("lang", T.StringType()),
    T.StructField("value", T.StringType()),
]))

FEED_SCHEMA = T.StructType([
    T.StructField("vulnerabilities", T.ArrayType(T.StructType([
        T.StructField("cve", T.StructType([
            T.StructField("id", T.StringType()),
            T.StructField("published", T.StringType()),
            T.StructField("descriptions", _TEXTS),
            T.StructField("metrics", T.StructType([
                T.StructField("cvssMetricV31", _METRIC),
                T.StructField("cvssMetricV30", _METRIC),
                T.StructField("cvssMetricV2", _METRIC),
            ])),
            T.StructField("weaknesses", T.ArrayType(T.StructType([
                T.StructField("description", _TEXTS),
            ]))),
        ])),
    ]))),
    T.StructField("_corrupt_record", T.StringType()),
])

REPLY_SCHEMA = T.StructType([
    T.StructField("severity", T.StringType()),
    T.StructField("cvss_score", T.DoubleType()),
    T.StructField("exploit_type", T.StringType()),
    T.StructField("affected_component", T.StringType()),
    T.StructField("impact", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("reasoning", T.StringType()),
])
