"""How a prediction is supported by its evidence, and whether a person should look at it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fields whose errors cost most; names of statuses and reasons below.
HIGH_RISK = ("country", "stateProvince", "eventDate", "recordedBy", "decimalLatitude", "decimalLongitude")


def support_status(predicted: Column, evidence: Column, alignment: Column, reading: Column) -> Column:
    """Status by scores of the evidence span, of its alignment with the value, and of the value in the whole reading; null scores support nothing."""
    at_least = lambda score, least: F.coalesce(score >= least, F.lit(False))
    aligned = at_least(alignment, 0.5)
    cases = [
        (~predicted, "not_predicted"),
        (at_least(evidence, 1.0) & aligned, "direct"),
        (at_least(evidence, 0.5) & aligned, "partial_direct"),
        (at_least(reading, 1.0), "prediction_in_ocr"),
        (at_least(evidence, 1.0), "contextual_inference"),
    ]
    return F.coalesce(*(F.when(test, name) for test, name in cases), F.lit("unsupported"))


def decide(field: Column, status: Column, confidence: Column, warning: Column, least: float = 0.75, least_high_risk: float = 0.9, high_risk: Iterable[str] = HIGH_RISK) -> Column:
    """Struct of review, priority (high, medium or empty) and reasons joined by semicolons; what is not predicted needs no review."""
    risky, direct = field.isin(*high_risk), status == "direct"
    below = lambda limit: confidence < limit
    unsure = F.coalesce(below(least_high_risk), F.lit(True))
    found = F.array_compact(
        F.array(
            F.when(~direct, F.concat(F.lit("support:"), status)),
            F.when(confidence.isNull(), "confidence:missing").when(below(least), f"confidence_below:{least:g}"),
            F.when(risky & ~direct, "high_risk_without_direct_evidence"),
            F.when(risky & unsure, f"high_risk_confidence_below:{least_high_risk:g}"),
            F.when(warning, "schema_validation_warning"),
        )
    )
    reasons = F.when(status == "not_predicted", F.array().cast("array<string>")).otherwise(found)
    urgent = (status == "unsupported") | (risky & ~direct) | F.coalesce(below(0.5), F.lit(False))
    review = F.size(reasons) > 0
    priority = F.when(review & urgent, "high").when(review, "medium").otherwise("")
    return F.struct(review.alias("review"), priority.alias("priority"), F.array_join(reasons, ";").alias("reasons"))
