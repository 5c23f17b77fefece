"""The audit table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.validate import apply_defaults
from ..tables import BatchTable


def audit_table(spark: SparkSession, path: str) -> BatchTable:
    """The audits that micro-batches stored under path; merged folders are partitioned by month."""
    return BatchTable(spark, path, by="audit_month")


def stored_audits(audits: DataFrame) -> DataFrame:
    """audits as they are stored: with defaults, who made them and when, and their month.

    user_created is null unless it is given, user_updated is user_created and date_created the
    audit's date unless they are given, so a repeated batch stores the same rows.
    """
    rows = apply_defaults(audits)
    kind = dict(rows.dtypes)["audit_date"]
    given = lambda c, other: F.coalesce(c, other) if c in rows.columns else other
    rows = rows.withColumn("user_created", given("user_created", F.lit(None).cast("string")))
    return rows.withColumns({"user_updated": given("user_updated", F.col("user_created")), "date_created": given("date_created", F.col("audit_date")).cast(kind), "audit_month": F.date_format("audit_date", "yyyy-MM")})


def append_audits(audits: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Append audits as they are stored.

    A table of appends is partitioned by month. A micro-batch's rows go to audit_table: a repeated
    batch replaces its own rows, and batches are merged into months as they grow many.
    """
    rows = stored_audits(audits)
    if batch_id is None:
        rows.write.mode("append").partitionBy("audit_month").parquet(path)
    else:
        audit_table(audits.sparkSession, path).write(rows, batch_id)
