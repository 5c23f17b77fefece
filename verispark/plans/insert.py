"""Audits that come in as requests: checked, resolved and given their defaults in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lookup import resolve_one
from ..operators.validate import apply_defaults, audit_reason

#: Fields that a request must have.
REQUIRED = ("claim_uuid", "similarity_score", "threshold_used", "is_verified", "step_name")


def check_audits(requests: DataFrame, claims: DataFrame, services: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests that break no rule of their own, as they are stored, with the error of their look-ups or null; id, error of the others).

    See insert_audits. A request that breaks a rule meets no table, and one without a service no
    services, so what is shuffled is what must be looked up, and no null gathers in one task.
    """
    lacking = F.coalesce(*(F.when(F.col(c).isNull(), F.lit(f"missing: {c}")) for c in REQUIRED))
    rows = requests.withColumns({"service_uuid": F.nullif("service_uuid", F.lit("")), "__rule": F.coalesce(lacking, audit_reason())})
    broken = rows.where(F.col("__rule").isNotNull()).select("id", F.col("__rule").alias("error"))
    user = ["user"] if "user" in requests.columns else []
    rows = rows.where(F.col("__rule").isNull()).select("id", "claim_uuid", "service_uuid", "similarity_score", "threshold_used", "is_verified", "step_name", "device_id", "metadata", "audit_date", *user)
    # one lookup tells how many services there are and which; two of one uuid are as bad as none
    served = resolve_one(rows.where(F.col("service_uuid").isNotNull()), services.select("service_uuid", "service_id", "validity_to"), "service_uuid", "service_id")
    served = served.withColumn("__service", F.concat(F.lit("service_"), F.col("error"))).drop("error").unionByName(rows.where(F.col("service_uuid").isNull()), allowMissingColumns=True)
    found = resolve_one(served, claims.select("claim_uuid", "claim_id", "validity_to"), "claim_uuid", "claim_id")
    checked = found.select(
        "id", "claim_id", "service_id", "similarity_score", "threshold_used", "is_verified", "step_name", F.coalesce("device_id", F.lit("")).alias("device_id"),
        F.coalesce(F.nullif("metadata", F.lit("")), F.lit("{}")).alias("metadata"), "audit_date", *([F.col("user").alias("user_created")] if user else []),
        F.coalesce(F.concat(F.lit("claim_"), F.col("error")), "__service").alias("error"),
    )
    return apply_defaults(checked), broken


def split_audits(checked: DataFrame, broken: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(audits to store, rejected requests with their first error) of check_audits; keeping its first result makes it one pass for both."""
    return checked.where(F.col("error").isNull()).drop("error"), broken.unionByName(checked.where(F.col("error").isNotNull()).select("id", "error"))


def insert_audits(requests: DataFrame, claims: DataFrame, services: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(audits to store, rejected requests with their first error).

    requests has id, REQUIRED, service_uuid, device_id, metadata and audit_date, and user if it is known; claims has
    claim_uuid, claim_id, validity_to and services service_uuid, service_id, validity_to. The order
    of the checks: required fields, score range, threshold range, verdict, claim, service. An empty
    service is none; an empty device or metadata takes its default.
    """
    return split_audits(*check_audits(requests, claims, services))
