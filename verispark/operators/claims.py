"""Risk written back to claims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.snapshot import set_json_key

RISK_KEY = "biometric_risk_assessment"


def _merged(claims: DataFrame, risk: DataFrame) -> DataFrame:
    fields = F.struct("audit_count", "avg_similarity", "failed_audits", F.date_format("last_updated", "yyyy-MM-dd'T'HH:mm:ss").alias("last_updated"), "risk_level", "risk_score", "score_variance")
    rows = claims.join(risk.select("claim_id", fields.alias("__risk")), "claim_id", "left")
    return rows.withColumn("__ext", F.when(F.col("__risk").isNotNull(), set_json_key(F.col("json_ext"), RISK_KEY, F.col("__risk"))))


def merge_claim_ext(claims: DataFrame, risk: DataFrame) -> DataFrame:
    """claims with seven fields of their risk under one key of json_ext.

    Claims without a risk row are unchanged, and so are those whose json_ext isn't a JSON object:
    unmerged_claims lists them. risk has claim_id, the columns of claim_risk and last_updated.
    """
    return _merged(claims, risk).withColumn("json_ext", F.coalesce("__ext", "json_ext")).drop("__risk", "__ext")


def unmerged_claims(claims: DataFrame, risk: DataFrame) -> DataFrame:
    """claim_id, error: the claims with a risk that json_ext can't take."""
    error = F.when(F.try_parse_json("json_ext").isNull(), "json_ext is not JSON").otherwise("json_ext is not an object")
    return _merged(claims, risk).where("__risk IS NOT NULL AND __ext IS NULL").select("claim_id", error.alias("error"))
