"""Error metrics, accuracy, classification report and label comparison."""

from pyspark.sql import Column, DataFrame, functions as F


def regression_errors(scored: DataFrame, actual: str, predicted: str) -> DataFrame:
    error = F.col(actual) - F.col(predicted)
    return scored.agg(
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.count(F.lit(1)).alias("n"),
    )


def accuracy(scored: DataFrame, actual: str, predicted: str) -> DataFrame:
    return scored.agg(
        F.avg((F.col(actual) == F.col(predicted)).cast("double")).alias("accuracy"),
        F.count(F.lit(1)).alias("n"),
    )


def class_report(scored: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support of each class, their macro and weighted
    averages and the accuracy.

    The data is reduced to the confusion counts first; the rest works on one
    row per pair of classes.
    """
    confusion = scored.groupBy(F.col(actual).cast("string").alias("a"),
                               F.col(predicted).cast("string").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    roles = confusion.select(F.explode(F.array(
        F.struct(F.col("a").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("claimed"),
                 F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0).alias("hits")),
        F.struct(F.col("p").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("claimed"),
                 F.lit(0).cast("bigint").alias("hits")),
    )).alias("r")).select("r.*")
    totals = roles.groupBy("label").agg(
        F.sum("support").alias("support"), F.sum("claimed").alias("claimed"), F.sum("hits").alias("hits"))

    def ratio(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(0.0)

    classes = totals.select(
        "label",
        ratio(F.col("hits"), F.col("claimed")).alias("precision"),
        ratio(F.col("hits"), F.col("support")).alias("recall"),
        ratio(2 * F.col("hits"), F.col("claimed") + F.col("support")).alias("f1"),
        "support",
    )
    measures = ["precision", "recall", "f1"]

    def part(kind: str, label: Column, weight: Column, values=measures) -> Column:
        return F.struct(F.lit(kind).alias("kind"), label.alias("label"), weight.cast("double").alias("weight"),
                        *[F.col(v).alias(m) for m, v in zip(measures, values)], "support")

    # Every class row also counts towards the three summary rows; accuracy is
    # the recall weighted by support.
    one, support = F.lit(1), F.col("support")
    parts = classes.select(F.explode(F.array(
        part("class", F.col("label"), one),
        part("summary", F.lit("macro avg"), one),
        part("summary", F.lit("weighted avg"), support),
        part("summary", F.lit("accuracy"), support, ["recall"] * 3),
    )).alias("p")).select("p.*")
    return parts.groupBy("kind", "label").agg(
        *[F.round(F.sum(F.col(m) * F.col("weight")) / F.sum("weight"), 6).alias(m) for m in measures],
        F.sum("support").alias("support"),
    ).drop("kind")


def compare_labels(records: DataFrame, first: Column, second: Column) -> DataFrame:
    """Two labels per record, side by side with the true severity."""
    return records.select(
        "CVE_ID", "True_Severity", first.alias("first_label"), second.alias("second_label"),
        (first == second).alias("agree"),
    )
