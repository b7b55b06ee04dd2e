"""Fixed-length token id sequences with attention mask."""

from pyspark.sql import DataFrame, functions as F

from advisoryspark.functions import text

PAD, UNKNOWN, FIRST_ID = 0, 1, 2
MAX_LENGTH = 128


def vocabulary(cleaned: DataFrame, size: int, column: str = "Cleaned_Description") -> DataFrame:
    """The `size` most frequent tokens with their ids, by falling count, ties by token.

    `size` is the model's embedding size, so the caller names it; the list of
    ranked tokens is as long, and `encode` tells how many tokens fall outside.
    """
    counts = cleaned.select(F.explode(text.tokens(F.col(column))).alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("n"))
    # Array index as rank: a bounded top-n list, not a window over every token.
    top = counts.orderBy(F.desc("n"), "token").limit(size).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "token"))).alias("t"))
    return top.select(F.posexplode("t").alias("i", "e")).select(
        F.col("e.token").alias("token"), (F.col("i") + FIRST_ID).alias("token_id"))


def encode(cleaned: DataFrame, vocab: DataFrame, length: int = MAX_LENGTH, key: str = "CVE_ID",
           column: str = "Cleaned_Description") -> DataFrame:
    """key, input_ids and attention_mask, each exactly `length` long, and n_unknown,
    the number of tokens among them that the vocabulary lacks.

    Longer texts are cut at `length` tokens, the input size of a sequence model.
    Spark broadcasts the vocabulary if its size allows, else joins by token.
    """
    words = F.slice(text.tokens(F.col(column)), 1, length)
    placed = cleaned.select(key, F.posexplode_outer(words).alias("place", "token"))
    numbered = placed.join(vocab, "token", "left").withColumn(
        "token_id", F.when(F.col("token").isNotNull(), F.coalesce("token_id", F.lit(UNKNOWN))))
    entries = F.array_sort(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "token_id"))))
    found = numbered.groupBy(key).agg(F.transform(entries, lambda e: e["token_id"]).alias("ids"))
    missing = F.lit(length) - F.size("ids")
    unknown = F.size(F.filter("ids", lambda i: i == UNKNOWN))
    return found.select(
        key, unknown.alias("n_unknown"),
        F.concat("ids", F.array_repeat(F.lit(PAD), missing)).alias("input_ids"),
        F.concat(F.transform("ids", lambda _: F.lit(1)), F.array_repeat(F.lit(0), missing)).alias("attention_mask"),
    )
