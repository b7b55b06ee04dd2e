"""Raw records to the enriched 15-column table, in one projection."""

from pyspark.ml import Transformer
from pyspark.sql import DataFrame, functions as F

from advisoryspark import fixed_values as fx
from advisoryspark.functions import pieces, scores, text
from advisoryspark.operators import models
from advisoryspark.schemas import TABLE_COLUMNS


def with_rule_labels(raw: DataFrame, ruleset: str = "current") -> DataFrame:
    """Cleaned text, exploit, component, impact and true severity.

    The lower-cased text is its own projection; one pass over it finds the literal
    pieces that the many rule tests share and cleans it.
    """
    exploits, components, impacts = text.RULESETS[ruleset]
    known = text.rule_pieces(exploits, components, impacts)
    lowered = text.Lowered(F.col("_lowered"), F.col("_looked"), known)
    return (
        raw.withColumn("_lowered", F.lower("Description"))
        .withColumn("_looked", pieces.look(F.col("_lowered"), known))
        .withColumns({
            "Cleaned_Description": F.coalesce(F.col("_looked.cleaned"), F.lit("")),
            "Exploit_Type": text.first_match(lowered, exploits, fx.DEFAULT_EXPLOIT),
            "Affected_Component": text.first_match(lowered, components, fx.DEFAULT_COMPONENT),
            "Impact": text.all_matches(lowered, impacts, fx.DEFAULT_IMPACT),
            "True_Severity": scores.severity(F.col("CVSS_Score")),
        })
        .drop("_lowered", "_looked")
    )


def enrich(raw: DataFrame, score_model: Transformer | None = None, category_model: Transformer | None = None,
           ruleset: str = "current") -> DataFrame:
    """Whole enriched row.

    `score_model` adds a column `predicted` (as the score pipeline does) and
    `category_model` adds `category` and `probability` or `category_confidence`;
    both run as transforms in the same pass.  Without a score model the predicted
    score falls back to its default; without a category model the category
    columns keep theirs.
    """
    scored = models.predict_scores(with_rule_labels(raw, ruleset), score_model)
    if category_model is not None:
        scored = models.classify(scored, category_model)
    predicted = F.col("predicted")
    return scored.withColumns({
        "Predicted_Severity": scores.severity(predicted),
        "Severity_Confidence": scores.confidence(F.col("CVSS_Score"), predicted),
        "BERT_Category": F.lit("N/A") if category_model is None else F.col("category"),
        "BERT_Confidence": F.lit(0.0) if category_model is None else F.col("category_confidence"),
    }).select(*TABLE_COLUMNS)
