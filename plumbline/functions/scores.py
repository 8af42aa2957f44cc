"""Scores of one project from its metrics: column arithmetic only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Mean and standard deviation of the score by language.
BASELINES = {"Python": (0.7494, 0.0619), "Java": (0.6224, 0.0938), "Go": (0.8166, 0.0627)}
#: Limits of the cycle severity and of the churn risk.
SEVERITY = ((0.01, "LOW"), (0.05, "MEDIUM"), (0.15, "HIGH"))
CHURN_RISK = ((0.10, "LOW"), (0.20, "MEDIUM"), (0.30, "HIGH"))
DESCRIPTIONS = {
    "CLEAN": "no cycles, high cohesion, clear layers", "LAYERED": "good stability and acyclicity, medium cohesion",
    "MODERATE": "no strong pathologies, room for improvement", "LOW_COHESION": "classes do too many things",
    "FLAT": "no clear layering", "TANGLED": "low cohesion and cycles", "CYCLIC": "cyclic dependencies",
}


def composite(metrics: Sequence[Column], weights: Sequence[float] = (0.25, 0.25, 0.25, 0.25)) -> Column:
    """Weighted mean; weights are brought to the sum 1, and count equally if all are 0."""
    total = sum(weights)
    shares = [w / total for w in weights] if total else [1 / len(weights)] * len(weights)
    out = F.lit(0.0)
    for m, w in zip(metrics, shares, strict=True):
        out = out + m * F.lit(w)
    return out


def _baseline(language: Column, k: int) -> Column:
    out = F.lit(None).cast("double")
    for name, values in BASELINES.items():
        out = F.when(language == name, F.lit(values[k])).otherwise(out)
    return out


def language_z(score: Column, language: Column) -> Column:
    """Standard score within the language; null for a language without a baseline."""
    return (score - _baseline(language, 0)) / _baseline(language, 1)


def normal_cdf(z: Column) -> Column:
    """Phi by the rational approximation 7.1.26 of Abramowitz and Stegun; absolute error below 1e-6."""
    x = F.abs(z) / F.lit(2.0**0.5)
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    half = 0.5 * poly * F.exp(-x * x)
    return F.when(z >= 0, 1.0 - half).otherwise(half)


def language_percentile(score: Column, language: Column) -> Column:
    return F.round(100 * normal_cdf(language_z(score, language)), 1)


def fingerprint(modularity: Column, acyclicity: Column, stability: Column, cohesion: Column) -> Column:
    """The first rule that holds."""
    return (
        F.when((acyclicity == 1.0) & (cohesion >= 0.95) & (stability > 0.80), "CLEAN")
        .when((acyclicity < 0.95) & (cohesion < 0.30), "TANGLED")
        .when(acyclicity < 0.95, "CYCLIC")
        .when(cohesion < 0.40, "LOW_COHESION")
        .when(stability < 0.30, "FLAT")
        .when((stability > 0.70) & (cohesion >= 0.50), "LAYERED")
        .otherwise("MODERATE")
    )


def fingerprint_description(name: Column) -> Column:
    out = F.lit("Unknown pattern")
    for k, v in DESCRIPTIONS.items():
        out = F.when(name == k, F.lit(v)).otherwise(out)
    return out


def _level(x: Column, limits: Sequence[tuple[float, str]]) -> Column:
    out = F.lit("CRITICAL")
    for limit, name in reversed(limits):
        out = F.when(x < limit, F.lit(name)).otherwise(out)
    return out


def cycle_severity(acyclicity: Column) -> Column:
    """Share of modules in the largest cycle; its level is NONE at exactly 0."""
    share = F.greatest(F.lit(0.0), 1.0 - acyclicity)
    level = F.when(share == 0.0, F.lit("NONE")).otherwise(_level(share, SEVERITY))
    message = F.when(level == "NONE", F.lit("no cyclic dependencies")).otherwise(F.format_string("%.1f%% of modules in the largest cycle", share * 100))
    return F.struct(share.alias("severity_ratio"), (share * 100).alias("severity_pct"), level.alias("severity_level"), message.alias("message"))


def churn_risk(acyclicity: Column, stability: Column, modularity: Column) -> Column:
    risk = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - (0.5 * acyclicity + 0.3 * stability + 0.2 * modularity)))
    return F.struct(risk.alias("churn_risk_score"), _level(risk, CHURN_RISK).alias("churn_risk_level"))


def size_adjusted(score: Column, n_nodes: Column) -> Column:
    """Score times ln 500 over ln n, within [0, 1]; below ten nodes the score as it is."""
    adjusted = score * F.log(F.lit(500.0)) / F.log(F.greatest(n_nodes, F.lit(2)).cast("double"))
    return F.when(n_nodes < 10, score).otherwise(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), adjusted)), 4))


def enhance(metrics: DataFrame) -> DataFrame:
    """Adds the classification to rows of score, modularity, acyclicity, stability, cohesion, nodes, language."""
    c = F.col
    named = fingerprint(c("modularity"), c("acyclicity"), c("stability"), c("cohesion"))
    return metrics.withColumns({
        "score_z": language_z(c("score"), c("language")), "score_percentile": language_percentile(c("score"), c("language")),
        "score_size_adjusted": size_adjusted(c("score"), c("nodes")), "fingerprint": named, "fingerprint_description": fingerprint_description(named),
        "cycle_severity": cycle_severity(c("acyclicity")), "churn_risk": churn_risk(c("acyclicity"), c("stability"), c("modularity")),
    })


def finite(x: Column) -> Column:
    """Null for anything that isn't a finite number."""
    x = x.try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def per_kloc(count: Column, ncloc: Column) -> Column:
    return F.when(ncloc > 0, count / (ncloc / 1000.0))


def rating_letter(rating: Column) -> Column:
    n = F.bround(rating, 0).cast("int")
    return F.when(n.between(1, 5), F.substring(F.lit("ABCDE"), n, F.lit(1)))


def rating_quality(rating: Column) -> Column:
    """1 for the best rating down to 0 for the fifth."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - (rating - 1.0) / 4.0))
