"""Scans, id lists, seed records and deterministic samples."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from advisoryspark import fixed_values as fx
from advisoryspark.functions import ids, text
from advisoryspark.schemas import TABLE_SCHEMA


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Whole enriched table; columns an older file lacks read as null."""
    return spark.read.schema(TABLE_SCHEMA).parquet(path)


def ordered_scores(records: DataFrame) -> DataFrame:
    """Id, score and year in chronological order; nothing else reaches the sort."""
    return records.select("CVE_ID", "CVSS_Score", "Year").orderBy("Year", "CVE_ID")


def id_list(raw_ids: DataFrame, column: str = "cve_id", strict: bool = True) -> DataFrame:
    """Normalised ids with a validity flag; the invalid ones are the reject set."""
    normalized = raw_ids.select(F.col(column).alias("raw_id"), ids.normalize_id(F.col(column)).alias("CVE_ID"))
    return normalized.withColumn("is_valid", ids.is_valid_id(F.col("CVE_ID"), strict))


def seed_records(spark: SparkSession) -> DataFrame:
    """The seed rows in the table schema."""
    names = ["CVE_ID", "Description", "Year", "CVSS_Score", "CWE", "OS", "Exploit_Type",
             "Affected_Component", "Impact", "True_Severity"]
    rows = spark.createDataFrame(fx.SEED_RECORDS, ", ".join(
        f"{n} {'double' if n == 'CVSS_Score' else 'string'}" for n in names))
    filled = (
        rows.withColumn("Cleaned_Description", text.clean_text(F.col("Description")))
        .withColumn("Predicted_Severity", F.col("True_Severity"))
        .withColumn("Severity_Confidence", F.lit(1.0))
        .withColumn("BERT_Category", F.lit("N/A"))
        .withColumn("BERT_Confidence", F.lit(0.0))
    )
    return filled.select(*TABLE_SCHEMA.fieldNames())


def _hash32(key: Column, seed: int) -> Column:
    digest = F.md5(F.concat(key.cast("string"), F.lit(f"#{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def shuffled_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in a seeded shuffle order that depends only on the key.

    Runs as a top-n per task and one small merge, never a full sort.
    """
    return df.orderBy(_hash32(F.col(key), seed), key).limit(n)


def split_bucket(key: Column, seed: int = 42) -> Column:
    """Stable bucket 0..99 of a key."""
    return (_hash32(key, seed) % 100).cast("int")


def split_name(key: Column, train: int = 80, validation: int = 10, seed: int = 42) -> Column:
    """'train', 'validation' or 'test' by bucket; a row keeps its side when data is added."""
    bucket = split_bucket(key, seed)
    return (
        F.when(bucket < train, "train")
        .when(bucket < train + validation, "validation")
        .otherwise("test")
    )
