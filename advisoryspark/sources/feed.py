"""Reader of vulnerability feed files (nested JSON, API 2.0 layout)."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from advisoryspark import fixed_values as fx
from advisoryspark.functions import ids
from advisoryspark.schemas import FEED_SCHEMA


def read_feed(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Feed documents with their file name; use multiline=False for one document a line,
    which lets Spark split large files."""
    return (
        spark.read.schema(FEED_SCHEMA).option("multiLine", multiline)
        .option("mode", "PERMISSIVE").json(path)
        .withColumn("source_file", F.input_file_name())
    )


def base_score(metrics: Column) -> Column:
    """First base score of v3.1, else v3.0, else v2, else 0.0."""
    found = [
        F.get(metrics[version], F.lit(0))["cvssData"]["baseScore"]
        for version in ("cvssMetricV31", "cvssMetricV30", "cvssMetricV2")
    ]
    return F.coalesce(*found, F.lit(fx.DEFAULT_SCORE))


def first_weakness(weaknesses: Column) -> Column:
    entry = F.get(F.get(weaknesses, F.lit(0))["description"], F.lit(0))
    return F.coalesce(entry["value"], F.lit(fx.DEFAULT_CWE))


def english_description(descriptions: Column) -> Column:
    english = F.filter(descriptions, lambda d: d["lang"] == "en")
    return F.coalesce(F.get(english, F.lit(0))["value"], F.lit(fx.DEFAULT_DESCRIPTION))


def first_description(descriptions: Column) -> Column:
    """Text of the first entry in any language (research variant)."""
    return F.coalesce(F.get(descriptions, F.lit(0))["value"], F.lit(fx.DEFAULT_FIRST_DESCRIPTION))


def records(feed: DataFrame, variant: str = "current", keep: tuple[str, ...] = ()) -> DataFrame:
    """One flat record per vulnerability of the feed documents.

    variant "research" takes the first text in any language, the year of
    publication and its own OS default.  `keep` may name source_file and place
    (the position inside the document).
    """
    research = variant == "research"
    cve = F.col("v.cve")
    cve_id = ids.normalize_id(cve["id"])
    describe = first_description if research else english_description
    return feed.select("source_file", F.posexplode("vulnerabilities").alias("place", "v")).select(
        cve_id.alias("CVE_ID"),
        describe(cve["descriptions"]).alias("Description"),
        (ids.year_from_published(cve["published"]) if research else ids.year_from_id(cve_id)).alias("Year"),
        base_score(cve["metrics"]).alias("CVSS_Score"),
        first_weakness(cve["weaknesses"]).alias("CWE"),
        F.lit(fx.RESEARCH_OS if research else fx.DEFAULT_OS).alias("OS"),
        *keep,
    )


def accepted(flat: DataFrame) -> DataFrame:
    return flat.filter(ids.is_valid_id(F.col("CVE_ID")))


def rejected(feed: DataFrame) -> DataFrame:
    """Broken documents and records with a malformed id: source_file, reason, content."""
    partly = F.when(F.col("vulnerabilities").isNull(), "broken document").otherwise("partly broken document")
    broken = feed.filter(F.col("_corrupt_record").isNotNull()).select(
        "source_file", partly.alias("reason"),
        F.col("_corrupt_record").alias("content"),
    )
    bad_id = (
        feed.select("source_file", F.explode("vulnerabilities").alias("v"))
        .select("source_file", ids.normalize_id(F.col("v.cve.id")).alias("content"))
        .filter(~ids.is_valid_id(F.col("content")))
        .select("source_file", F.lit("malformed id").alias("reason"), "content")
    )
    return broken.unionByName(bad_id)


def as_feed_documents(raw: DataFrame, per_document: int = 2000, fallbacks: bool = False) -> DataFrame:
    """Pack flat records into feed documents of at most `per_document` entries.

    Each input partition is cut into runs, so no list is longer than a run; the
    runs are grouped by one shuffle.  With `fallbacks` entries lack the newest
    scores, the weakness or the English text, by the last digit of their id.
    """
    def text(lang: str, value: Column) -> Column:
        return F.struct(F.lit(lang).alias("lang"), value.alias("value"))

    def metric(score: Column, present: Column) -> Column:
        return F.when(present, F.array(F.struct(F.struct(score.alias("baseScore")).alias("cvssData"))))

    score, always = F.col("CVSS_Score"), F.lit(True)
    descriptions, weaknesses = F.array(text("en", F.col("Description"))), F.array(
        F.struct(F.array(text("en", F.col("CWE"))).alias("description")))
    metrics = F.struct(metric(score, always).alias("cvssMetricV31"))
    if fallbacks:  # the last digit of the id chooses what an entry lacks
        case = F.substring("CVE_ID", -1, 1).cast("int")
        metrics = F.struct(metric(score, case < 4).alias("cvssMetricV31"),
                           metric(score + 0.25, case < 6).alias("cvssMetricV30"),
                           metric(score + 0.5, case < 8).alias("cvssMetricV2"))
        descriptions = F.when(case == 9, F.array(text("es", F.lit("otro")))).otherwise(
            F.array(text("es", F.lit("otro")), text("en", F.col("Description"))))
        weaknesses = F.when(case % 2 == 0, weaknesses)
    entry = F.struct(F.struct(
        F.col("CVE_ID").alias("id"),
        F.concat(F.col("Year"), F.lit("-01-01T00:00:00.000")).alias("published"),
        descriptions.alias("descriptions"), metrics.alias("metrics"), weaknesses.alias("weaknesses"),
    ).alias("cve"))
    run = F.floor(F.monotonically_increasing_id() / per_document)
    return (
        raw.select(run.alias("run"), entry.alias("v"))
        .groupBy("run").agg(F.collect_list("v").alias("vulnerabilities")).drop("run")
    )
