"""Lookups of dimensions by key. Joins are plain equi joins; Spark broadcasts a side if its size allows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import carried_forward
from .validate import active, not_deleted


def resolve_one(left: DataFrame, dim: DataFrame, on: str, value: str, mode: str = "error") -> DataFrame:
    """left with value from the only active row of dim that has the key.

    mode 'error' adds a column error (not_found or ambiguous); mode 'null' leaves the value null.
    """
    found = active(dim).groupBy(on).agg(F.count("*").alias("__n"), F.any_value(value).alias(value))
    rows = left.join(found, on, "left")
    rows = rows.withColumn(value, F.when(F.col("__n") == 1, F.col(value)))
    if mode == "error":
        rows = rows.withColumn("error", F.when(F.col("__n").isNull(), "not_found").when(F.col("__n") > 1, "ambiguous"))
    return rows.drop("__n")


def resolve_optional(left: DataFrame, dim: DataFrame, on: str) -> DataFrame:
    """left with an error where the key is given but no active row of dim has it."""
    known = active(dim).select(on).distinct().withColumn("__known", F.lit(True))
    rows = left.join(known, on, "left")
    return rows.withColumn("error", F.when(F.col(on).isNotNull() & F.col("__known").isNull(), "unknown_" + on)).drop("__known")


def list_audits(audits: DataFrame, claims: DataFrame, services: DataFrame, claim_ids: DataFrame | None = None) -> DataFrame:
    """Audits of active claims, not deleted, newest first; ids as text, a null service stays."""
    wanted = active(claims).select("claim_id")
    if claim_ids is not None:
        wanted = wanted.join(claim_ids.select("claim_id"), "claim_id", "left_semi")
    rows = not_deleted(audits).join(wanted, "claim_id").join(services.select("service_id", F.col("service_id").cast("string").alias("service")), "service_id", "left")
    return rows.select("id", F.col("claim_id").cast("string").alias("claim"), "service", "similarity_score", "threshold_used", "is_verified", "step_name", "device_id", "audit_date").orderBy(F.desc("audit_date"), "id")


def attach_reference(frames: DataFrame, subjects: DataFrame, embeddings: DataFrame, photos: DataFrame | None = None) -> DataFrame:
    """frames with known (the subject is active), its active embedding with its metadata, and its photo if photos are given.

    embeddings has at most one active row per subject, as supersede and the stream's store keep it;
    the filter on it reaches the scan, so closed versions aren't read. frames may be a stream: the
    others are static sides of plain equi joins.
    """
    people = active(subjects).select("subject_id", F.lit(True).alias("known"))
    rows = frames.join(people, "subject_id", "left").join(active(embeddings).select("subject_id", "embedding", "metadata"), "subject_id", "left")
    if photos is not None:
        rows = rows.join(photos.select("subject_id", F.col("content").alias("photo")), "subject_id", "left")
    return rows.withColumn("known", F.coalesce("known", F.lit(False)))


def attach_reference_asof(frames: DataFrame, embeddings: DataFrame) -> DataFrame:
    """frames with the embedding (vec_id) that was valid at their time; a subject's intervals are disjoint, so at most one.

    Versions and the frames' times are swept in order, and the last version is carried forward: the
    cost is linear in both, also for a subject with many of each, which several tasks share. Only
    subjects and times are swept; frames meet the result by both.
    """
    kind = dict(frames.dtypes)["ts"]
    version = F.struct("vec_id", F.col("validity_to").cast(kind).alias("until"))
    versions = embeddings.where(F.col("validity_from").isNotNull()).select("subject_id", F.col("validity_from").cast(kind).alias("ts"), F.lit(0).alias("__frame"), version.alias("__v"))
    times = frames.where(F.col("subject_id").isNotNull() & F.col("ts").isNotNull()).select("subject_id", "ts").distinct()
    rows = versions.unionByName(times.withColumn("__frame", F.lit(1)), allowMissingColumns=True)
    swept = carried_forward(rows, "subject_id", ["ts", "__frame"], "__v").where("__frame = 1")
    valid = swept.where(F.col("__v.until").isNull() | (F.col("ts") < F.col("__v.until"))).select("subject_id", "ts", F.col("__v.vec_id").alias("vec_id"))
    return frames.join(valid, ["subject_id", "ts"], "left").select(*frames.columns, "vec_id")
