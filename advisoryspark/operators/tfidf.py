"""TF-IDF features over the most frequent terms, as an MLlib pipeline.

Weights follow the usual library defaults: tokens of at least two word
characters, idf = ln((1+n)/(1+df)) + 1, rows of length one.
"""

import math

from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, functions as F

from advisoryspark.functions.text import clean_text

MAX_FEATURES = 100
_TOKENS = (
    "SELECT *, split(coalesce(trim(regexp_replace(lower(Description), '[^a-z0-9]+', ' ')), ''), ' ') AS _tokens "
    "FROM __THIS__"
)


def top_terms(cleaned: DataFrame, size: int = MAX_FEATURES, column: str = "Cleaned_Description") -> DataFrame:
    """Most frequent terms of at least two characters with their total count, ties by term.

    Tasks combine their counts first, so the shuffle carries one row per task and term.
    """
    return (
        cleaned.select(F.explode(F.split(column, " ")).alias("term")).filter(F.length("term") >= 2)
        .groupBy("term").agg(F.count(F.lit(1)).alias("total"))
        .orderBy(F.desc("total"), "term").limit(size)
    )


def document_frequencies(cleaned: DataFrame, terms: list[str], column: str = "Cleaned_Description") -> DataFrame:
    """Number of texts that hold each of the given terms."""
    wanted = F.array(*[F.lit(t) for t in terms])
    held = F.array_intersect(F.split(column, " "), wanted)
    return cleaned.select(F.explode(held).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def vocabulary(cleaned: DataFrame, size: int = MAX_FEATURES, column: str = "Cleaned_Description") -> DataFrame:
    """term, total, df of the most frequent terms.

    The driver holds the `size` terms between the two passes; document
    frequencies are only counted for those.
    """
    top = top_terms(cleaned, size, column).collect()
    terms = cleaned.sparkSession.createDataFrame(top, "term string, total long")
    return terms.join(document_frequencies(cleaned, [r["term"] for r in top], column), "term")


def fit(records: DataFrame, size: int = MAX_FEATURES) -> PipelineModel:
    """Pipeline from Description to the unit-length `features` vector; weighting a text needs no shuffle."""
    kept = F.col("Cleaned_Description") if "Cleaned_Description" in records.columns else clean_text(F.col("Description"))
    cleaned = records.select(kept.alias("Cleaned_Description"))
    chosen = sorted(vocabulary(cleaned, size).collect(), key=lambda r: (-r["total"], r["term"]))
    n = records.count()
    return pipeline([r["term"] for r in chosen], [math.log((1 + n) / (1 + r["df"])) + 1 for r in chosen])


def pipeline(terms: list[str], idf: list[float]) -> PipelineModel:
    """Pipeline of a known vocabulary and its weights."""
    return PipelineModel([
        SQLTransformer(statement=_TOKENS),
        CountVectorizerModel.from_vocabulary(terms, inputCol="_tokens", outputCol="_counts"),
        ElementwiseProduct(inputCol="_counts", outputCol="_weighted", scalingVec=Vectors.dense(idf)),
        Normalizer(inputCol="_weighted", outputCol="features", p=2.0),
    ])


def features(model: PipelineModel, records: DataFrame) -> DataFrame:
    """Records with their feature vector; helper columns removed."""
    return model.transform(records).drop("_tokens", "_counts", "_weighted")


def weights(model: PipelineModel, records: DataFrame) -> DataFrame:
    """Long form: id, term, weight of every vocabulary term a text holds."""
    words = F.array(*[F.lit(w) for w in model.stages[1].vocabulary])
    places = F.transform(vector_to_array("features"), lambda x, i: F.struct(x.alias("weight"), i.alias("i")))
    held = features(model, records).select("CVE_ID", F.explode(F.filter(places, lambda p: p["weight"] > 0)).alias("p"))
    return held.select("CVE_ID", F.get(words, F.col("p.i")).alias("term"), "p.weight")
