"""Vulnerability-shaped records derived from the `documents` table.

Each document becomes one raw record: its whole text preceded by a phrase that
gives the rules something to find, with id, year, score and weakness computed
from doc_id.  Used by the checks, the bench and the registered queries.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

PHRASES = [
    "A remote code execution flaw in the linux kernel lets users run arbitrary code",
    "Cross site scripting in a wordpress plugin",
    "SQL injection in mysql admin panel",
    "Heap overflow and out-of-bounds write in openssl",
    "Elevation of privilege in win32k",
    "Denial of service crash in nginx via infinite loop",
    "Shell injection in router firmware",
    "Information disclosure of sensitive data in a rest endpoint",
    "Authentication bypass in spring boot login",
    "Directory traversal in file upload",
    "CSRF in the smtp gateway",
    "Open redirect in the vpn portal",
    "Resource handling note for java",
    "Password stored in word file",
    "Certificate check missing in docker",
    "Nothing of note",
]
WEAKNESSES = ["CWE-79", "CWE-119", "CWE-89", "N/A"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CVE_ID, Description, Year, CVSS_Score, CWE, OS of every document."""
    doc = F.col("doc_id")
    year = (F.lit(2017) + F.floor(F.sqrt(doc % 100)).cast("int")).cast("string")
    phrase = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (doc % 16 + 1).cast("int"))
    cwe = F.element_at(F.array(*[F.lit(w) for w in WEAKNESSES]), (doc % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("CVE-"), year, F.lit("-"), (doc + 1001).cast("string")).alias("CVE_ID"),
        F.concat(phrase, F.lit(". "), F.col("text")).alias("Description"),
        year.alias("Year"),
        ((doc * 37 % 101).cast("double") / 10).alias("CVSS_Score"),
        cwe.alias("CWE"),
        F.col("source").alias("OS"),
    )
