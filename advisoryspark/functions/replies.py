"""Prompt text, structured replies and the rule-based prediction record."""

from pyspark.sql import Column, functions as F

from advisoryspark import fixed_values as fx
from advisoryspark.functions import scores, text
from advisoryspark.schemas import REPLY_SCHEMA


def zero_shot_label(label: Column) -> Column:
    """'high severity' -> 'HIGH'."""
    return F.upper(F.replace(label, F.lit(" severity"), F.lit("")))


def render_prompt(cve_id: Column, description: Column, score: Column, cwe: Column, year: Column) -> Column:
    """Analyst prompt of one record, its whole description included."""
    fields = [cve_id, description, score.cast("string"), cwe, year]
    pieces = fx.PROMPT_FORMAT.split("%s")
    parts = [F.lit(pieces[0])]
    for value, tail in zip(fields, pieces[1:]):
        parts += [value, F.lit(tail)]
    return F.concat(*parts)


def parse_reply(reply: Column) -> Column:
    """Struct of a JSON reply, with or without code fences; null fields if it is broken."""
    bare = F.trim(F.regexp_replace(reply, "```json|```", ""))
    return F.from_json(bare, REPLY_SCHEMA)


def rule_prediction(lowered: Column, score: Column, ruleset: str = "current") -> list[Column]:
    """Severity, labels, confidence and reasoning derived from the rules alone.

    `lowered` is the lower-cased description, best projected beforehand so that
    all rules share it.
    """
    exploits, components, impacts = text.RULESETS[ruleset]
    level = scores.severity(score)
    exploit = text.first_match(lowered, exploits, fx.DEFAULT_EXPLOIT)

    def described(label: Column) -> Column:
        return F.coalesce(F.nullif(label, F.lit("Unknown")), F.lit("See description"))

    return [
        level.alias("severity"),
        score.alias("cvss_score"),
        exploit.alias("exploit_type"),
        described(text.first_match(lowered, components, fx.DEFAULT_COMPONENT)).alias("affected_component"),
        described(text.all_matches(lowered, impacts, fx.DEFAULT_IMPACT)).alias("impact"),
        F.when(score > 0, 85).otherwise(50).alias("confidence"),
        F.concat(F.lit("CVSS "), score.cast("string"), F.lit(" maps to "), level,
                 F.lit(". Pattern matched: "), exploit, F.lit(".")).alias("reasoning"),
    ]
