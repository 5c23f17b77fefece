"""Fraud risk of claims from their audits.

Scores are kept as integer basis points, so counts and moments are exact, mergeable sums: one
partial and one final hash aggregate on the claim, four numbers per claim, whatever its audits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import rounded
from .ranges import running_sums

NO_AUDITS = "no audits for this claim"


def _moments() -> dict[str, Column]:
    bp = F.round(F.col("similarity_score") * 10000).cast("long")
    return {"n": F.count(F.lit(1)), "failed": F.sum(F.when(~F.col("is_verified"), 1).otherwise(0)), "s1": F.sum(bp), "s2": F.sum(bp * bp)}


def exact_variance() -> Column:
    """Sample variance from n, s1, s2 in basis points; 0 for a single audit."""
    big = lambda c: F.col(c).cast("decimal(19,0)")
    top = (big("n") * big("s2") - big("s1") * big("s1")).cast("double")
    return F.when(F.col("n") > 1, top / F.greatest(F.col("n") * (F.col("n") - 1), F.lit(1)).cast("double") / 1e8).otherwise(0.0)


def risk_rules(n: Column, failed: Column, variance: Column, mean: Column, baseline: float = 0.0) -> Column:
    """Unrounded risk: any failure, else scattered scores, else a low mean, else the baseline."""
    return (
        F.when(failed > 0, F.least(F.lit(0.8) + F.lit(0.2) * (failed / n), F.lit(1.0)))
        .when(variance > 0.1, F.lit(0.4) + F.least(variance * 5.0, F.lit(0.6)))
        .when(mean < 0.6, F.lit(0.4) + (F.lit(0.6) - mean) * 0.5)
        .otherwise(F.lit(baseline))
    )


def risk_level(risk: Column) -> Column:
    """Level of the unrounded risk."""
    return F.when(risk >= 0.8, "CRITICAL").when(risk >= 0.5, "HIGH").when(risk >= 0.3, "MEDIUM").otherwise("LOW")


def _with_exact_moments(sums: DataFrame) -> DataFrame:
    """sums (n, failed, s1, s2) with variance and mean."""
    return sums.withColumns({"variance": exact_variance(), "mean": F.col("s1") / F.col("n") / 1e4})


def _assess(moments: DataFrame, keep: list[str], baseline: float) -> DataFrame:
    """Risk and its parts from n, failed, variance and mean."""
    df = moments.withColumn("risk", risk_rules(F.col("n"), F.col("failed"), F.col("variance"), F.col("mean"), baseline))
    return df.select(
        *keep, rounded(F.col("risk"), 3).alias("risk_score"), risk_level(F.col("risk")).alias("risk_level"), F.col("n").alias("audit_count"), F.col("failed").alias("failed_audits"),
        rounded(F.col("variance"), 3).alias("score_variance"), rounded(F.col("mean"), 3).alias("avg_similarity"), F.lit(None).cast("string").alias("message"),
    )


def claim_sums(audits: DataFrame, last_updated: bool = False) -> DataFrame:
    """claim_id, n, failed, s1, s2 (and last_updated): what a claim's risk needs, in batch or as a stream's state."""
    return audits.groupBy("claim_id").agg(*(c.alias(k) for k, c in _moments().items()), *([F.max("audit_date").alias("last_updated")] if last_updated else []))


def risk_of_sums(sums: DataFrame, keep: list[str], baseline: float = 0.0) -> DataFrame:
    """The risk of rows of claim_sums."""
    return _assess(_with_exact_moments(sums), keep, baseline)


def claim_risk(audits: DataFrame, claims: DataFrame | None = None, include_deleted: bool = True, precision: str = "exact", baseline: float = 0.0, last_updated: bool = False) -> DataFrame:
    """claim_id, risk_score, risk_level, audit_count, failed_audits, score_variance, avg_similarity, message.

    With last_updated, the last audit's date comes out of the same aggregate.

    With claims (claim_id, validity_to), every active claim has a row; those without audits are
    UNKNOWN. precision 'double' takes scores that aren't whole basis points.
    """
    if not include_deleted:
        audits = audits.where(~F.col("is_deleted"))
    m, score = _moments(), F.col("similarity_score")
    if precision == "double":
        moments = audits.groupBy("claim_id").agg(m["n"].alias("n"), m["failed"].alias("failed"), F.coalesce(F.var_samp(score), F.lit(0.0)).alias("variance"), F.avg(score).alias("mean"), *([F.max("audit_date").alias("last_updated")] if last_updated else []))
    else:
        moments = _with_exact_moments(claim_sums(audits, last_updated))
    risk = _assess(moments, ["claim_id", *(["last_updated"] if last_updated else [])], baseline)
    if claims is None:
        return risk
    rows = claims.where(F.col("validity_to").isNull()).select("claim_id").join(risk, "claim_id", "left")
    none = F.col("audit_count").isNull()
    return rows.select(
        "claim_id", F.coalesce("risk_score", F.lit(0.0)).alias("risk_score"), F.coalesce("risk_level", F.lit("UNKNOWN")).alias("risk_level"),
        *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("audit_count", "failed_audits")), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("score_variance", "avg_similarity")),
        F.when(none, F.lit(NO_AUDITS)).alias("message"), *(["last_updated"] if last_updated else []),
    )


def running_claim_risk(audits: DataFrame, baseline: float = 0.0) -> DataFrame:
    """The risk after each audit (claim_id, id, last_updated and the columns of claim_risk).

    Sums run in two levels, so a claim with most of the audits is spread over all tasks.
    """
    bp = F.round(F.col("similarity_score") * 10000).cast("long")
    rows = audits.select("claim_id", "id", F.col("audit_date").alias("last_updated"), F.when(~F.col("is_verified"), 1).otherwise(0).alias("__failed"), bp.alias("__bp"))
    one = F.lit(1).cast("long")
    sums = running_sums(rows, "claim_id", ["last_updated", "id"], {"n": one, "failed": F.col("__failed"), "s1": F.col("__bp"), "s2": F.col("__bp") * F.col("__bp")})
    return _assess(_with_exact_moments(sums), ["claim_id", "id", "last_updated"], baseline)


def failure_rates(audits: DataFrame, grain: str = "7 days") -> DataFrame:
    """step_name, bucket_start, audits, failed, failure_rate per step and tumbling time bucket."""
    buckets = audits.groupBy("step_name", F.window("audit_date", grain).alias("w")).agg(F.count("*").alias("audits"), F.count_if(~F.col("is_verified")).alias("failed"))
    return buckets.select("step_name", F.col("w.start").alias("bucket_start"), "audits", "failed", (F.col("failed") / F.col("audits")).alias("failure_rate"))
