"""Score bands, threat states and confidence as Column expressions."""

from pyspark.sql import Column, functions as F

from advisoryspark import fixed_values as fx


def severity(score: Column) -> Column:
    """Severity band; 0 and null mean "no score".  NaN compares as LOW."""
    return (
        F.when(score.isNull() | (score == 0), "UNKNOWN")
        .when(F.isnan(score), "LOW")
        .when(score >= 9.0, "CRITICAL")
        .when(score >= 7.0, "HIGH")
        .when(score >= 4.0, "MEDIUM")
        .otherwise("LOW")
    )


def threat_state(score: Column) -> Column:
    """Threat state of a score; unlike `severity`, 0.0 counts as Low."""
    low, medium, high = fx.THREAT_STATES
    return F.when(score < 4.0, low).when(score < 7.0, medium).when(score.isNotNull(), high)


def confidence(score: Column, predicted: Column) -> Column:
    """1 minus a tenth of the score error, the deduction at most 0.4."""
    return F.round(1 - F.least(F.lit(0.4), F.abs(score - predicted) / 10), 2)


def one_hot_state(state: Column, prefix: str = "Prev_State_") -> list[Column]:
    """One 0/1 column per threat state, all present whatever the data holds."""
    return [
        F.when(state == name, 1.0).otherwise(0.0).alias(prefix + name)
        for name in fx.THREAT_STATES
    ]


def first_argmax(values: Column) -> Column:
    """Zero-based index of the first maximum of an array."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def numpy_round(value: Column, digits: int) -> Column:
    """Half-to-even rounding of the scaled value."""
    scale = float(10 ** digits)
    return F.rint(value * scale) / scale
