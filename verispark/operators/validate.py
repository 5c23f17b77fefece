"""Filters, defaults and rules for audits and frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def active(df: DataFrame, at: Column | None = None) -> DataFrame:
    """Rows that are valid now, or at a time."""
    if at is None:
        return df.where(F.col("validity_to").isNull())
    return df.where((F.col("validity_from") <= at) & (F.col("validity_to").isNull() | (at < F.col("validity_to"))))


def not_deleted(df: DataFrame) -> DataFrame:
    """Rows that aren't soft-deleted."""
    return df.where(~F.col("is_deleted"))


def require_fields(df: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with all fields, rows that lack some with an error)."""
    lacking = F.filter(F.array(*(F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.lit(c)) for c in cols)), lambda x: x.isNotNull())
    marked = df.withColumn("error", F.when(F.size(lacking) > 0, F.concat(F.lit("missing: "), F.array_join(lacking, ", "))))
    return marked.where(F.col("error").isNull()).drop("error"), marked.where(F.col("error").isNotNull())


#: What an absent field of an audit becomes.
DEFAULTS = {"step_name": "unknown", "device_id": "", "metadata": "{}", "threshold_used": 0.4, "is_deleted": False, "version": 1}


def apply_defaults(df: DataFrame) -> DataFrame:
    """df with absent columns added; a null in a column that is there stays null."""
    return df.withColumns({c: F.lit(v) for c, v in DEFAULTS.items() if c not in df.columns})


def _in_unit(c: str) -> Column:
    return F.col(c).between(0.0, 1.0)  # NaN is above all numbers, so it fails


def consistent() -> Column:
    """The stored verdict is what score and threshold say."""
    return F.col("is_verified") == (F.col("similarity_score") >= F.col("threshold_used"))


def audit_reason() -> Column:
    """The first rule that an audit breaks, as the API checks them; null if none."""
    return F.when(~_in_unit("similarity_score"), "score_range").when(~_in_unit("threshold_used"), "threshold_range").when(~consistent(), "inconsistent")


def audit_errors() -> Column:
    """All rules that an audit breaks, as the serializer checks them: fields first, the pair only if they pass."""
    fields = F.filter(F.array(F.when(~_in_unit("similarity_score"), "score_range"), F.when(~_in_unit("threshold_used"), "threshold_range")), lambda x: x.isNotNull())
    pair = F.filter(F.array(F.when(~consistent(), "inconsistent")), lambda x: x.isNotNull())
    return F.when(F.size(fields) > 0, fields).otherwise(pair)


def validate_audits(df: DataFrame, mode: str = "api") -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with reason)."""
    if mode not in ("api", "serializer"):
        raise ValueError("mode is 'api' or 'serializer'")
    reason = audit_reason() if mode == "api" else F.nullif(F.array_join(audit_errors(), ","), F.lit(""))
    marked = df.withColumn("reason", reason)
    return marked.where(F.col("reason").isNull()).drop("reason"), marked.where(F.col("reason").isNotNull())


def inconsistent_audits(audits: DataFrame) -> DataFrame:
    """Stored audits whose verdict contradicts their score and threshold."""
    return audits.where(~consistent())
