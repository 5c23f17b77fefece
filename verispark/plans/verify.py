"""Verification of frames against the subjects that they claim to show, and the audits that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EMBEDDING_SIZES, VerifyConfig
from ..functions.frames import decode_frame
from ..functions.similarity import cosine_distance, effective_threshold, length_error, similarity, verdict
from ..functions.snapshot import is_stale
from ..operators.lookup import attach_reference, resolve_one, resolve_optional
from ..operators.validate import apply_defaults
from ..storage import checkpointed
from .embedder import default_threshold, embed
from .refresh import embed_photos


def _compared(rows: DataFrame, reference: str, threshold: Column, route: Column, size: int | None) -> DataFrame:
    """rows with the verdict of probe against a reference column; errors are not verified."""
    ref = F.col(reference)
    error = F.coalesce(F.col("probe_error"), F.col("ref_error"), F.when(ref.isNull(), F.lit("no reference")), length_error(F.col("probe"), ref))
    rows = rows.withColumn("__d", cosine_distance(F.col("probe"), ref, size))
    rows = rows.withColumns({"__v": verdict(F.col("__d"), threshold), "error": error, "route": route})
    bad = F.col("error").isNotNull()
    return rows.withColumns({
        "verified": F.when(bad, F.lit(False)).otherwise(F.col("__v.verified")), "confidence": F.when(bad, F.lit(0.0)).otherwise(F.col("__v.confidence")), "distance": F.when(bad, F.lit(None).cast("double")).otherwise(F.col("__v.distance")),
    }).drop("__v", "__d")


#: The error of a frame whose text isn't base64.
UNDECODABLE = "frame can't be decoded"


def verify(frames: DataFrame, subjects: DataFrame, embeddings: DataFrame, photos: DataFrame, cfg: VerifyConfig, keep: bool = True, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, embeddings to store: subject_id, embedding, metadata).

    frames has id, subject_id and frame (base64); its other columns stay. A frame's image is turned
    into its embedding before any join, so no image is shuffled; a reference photo is embedded once
    per subject that needs it, not once per frame. Failures are rows with an error. With keep,
    photos' vectors and results are checkpointed, so the model sees each image once whatever is read
    afterwards; without it nothing is written, for callers that read one of the two outputs once.
    ids are the frames' distinct subject_id, where the caller has them already.

    Routes: 'unknown' (no active subject), 'fast' (fresh stored embedding), 'refresh' (stale one,
    embedded anew), 'slow' (none stored, or storing is off: the model's own threshold holds). With
    storing on, what the refresh route embedded and what a verified slow match compared is to be
    stored (plans.refresh.store_embeddings).
    """
    image, held = decode_frame(F.col("frame")), checkpointed if keep else lambda df: df
    # an image is decoded once, for the model and for what is told of it
    probes = frames.withColumn("__image", image).withColumns({"__decoded": F.col("__image").isNotNull(), "__e": embed(F.col("__image"), cfg)}).withColumns({
        "probe": F.col("__e.embedding"), "probe_error": F.when(~F.col("__decoded"), F.lit(UNDECODABLE)).otherwise(F.col("__e.error")),
    }).drop("__e", "__image", "frame")
    # one row per subject that frames ask for
    ids = ids if ids is not None else frames.where(F.col("subject_id").isNotNull()).select("subject_id").distinct()
    stale = F.coalesce(is_stale(F.col("metadata"), cfg), F.lit(True))
    base = F.when(~F.col("known"), "unknown").when(F.lit(not cfg.store_embeddings) | F.col("embedding").isNull(), "slow").when(stale, "refresh").otherwise("fast")
    asked = attach_reference(ids, subjects, embeddings).select("subject_id", F.col("embedding").alias("stored"), base.alias("route"))
    need = asked.where(F.col("route").isin("refresh", "slow")).select("subject_id", F.col("route").alias("need"))
    photo = embed_photos(need.select("subject_id").join(photos.select("subject_id", "content"), "subject_id", "left"), cfg).withColumnsRenamed({"embedding": "photo", "error": "photo_error"})
    fresh = held(photo.join(need, "subject_id"))
    known = asked.join(fresh.drop("need"), "subject_id", "left").select("subject_id", "route", "stored", "photo", "photo_error")
    # frames without a subject meet nobody; dealt by their ids they aren't one task's work
    dealt = F.xxhash64("subject_id")
    rows = probes.withColumn("__h", F.when(F.col("subject_id").isNull(), F.xxhash64("id")).otherwise(dealt)).join(known.withColumn("__h", dealt), ["subject_id", "__h"], "left").drop("__h").withColumn("route", F.coalesce("route", F.lit("unknown")))
    # a refresh that fails falls back to the slow route, which then reports the same problem
    route = F.when((F.col("route") == "refresh") & F.col("photo_error").isNotNull(), "slow").otherwise(F.col("route"))
    rows = rows.withColumns({"reference": F.when(route == "fast", F.col("stored")).otherwise(F.col("photo")), "ref_error": F.when(route == "unknown", F.lit("unknown subject")).when(route == "fast", F.lit(None)).otherwise(F.col("photo_error"))})
    threshold = F.when(route == "slow", F.lit(default_threshold(cfg))).otherwise(effective_threshold(None, cfg))
    results = _compared(rows, "reference", threshold, route, EMBEDDING_SIZES.get(cfg.model_name)).withColumn("provider", F.lit(cfg.provider))
    results = held(results.drop("probe", "probe_error", "stored", "photo", "photo_error", "reference", "ref_error", "__decoded"))
    # a stale embedding is made anew by any frame that can be decoded, a missing one stored after a match
    seen = results.groupBy("subject_id").agg(F.bool_or((F.col("route") == "slow") & F.col("verified")).alias("__matched"), F.bool_or(~F.col("error").eqNullSafe(UNDECODABLE)).alias("__usable"))
    good = fresh.where(F.lit(cfg.store_embeddings) & F.col("photo_error").isNull()).join(seen, "subject_id")
    new = good.where(F.col("__matched") | ((F.col("need") == "refresh") & F.col("__usable")))
    return results, new.select("subject_id", F.col("photo").alias("embedding"), F.lit(cfg.snapshot).alias("metadata"))


def audit_id() -> Column:
    """A uuid made from connection and time, so a replay gives the same audit."""
    h = F.md5(F.concat_ws("|", F.col("conn_id").cast("string"), F.unix_micros(F.col("ts").cast("timestamp")).cast("string")))
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def audits_from_results(results: DataFrame, claims: DataFrame, services: DataFrame, cfg: VerifyConfig, service: str = "service_id") -> DataFrame:
    """Audits of results that name a claim and have no error; an unknown or ambiguous claim or an unknown service gives none.

    service names the column of results and services by which services are found. The stored
    threshold is the configured one, also where another was in force.
    """
    rows = results.where(F.col("claim_code").isNotNull() & (F.col("claim_code") != "") & F.col("error").isNull()).drop("error")
    rows = resolve_one(rows, claims.select("claim_code", "claim_id", "validity_to"), "claim_code", "claim_id", mode="null").where(F.col("claim_id").isNotNull())
    if service != "service_id":
        rows = rows.withColumn(service, F.nullif(F.col(service), F.lit("")))
    rows = resolve_optional(rows, services, service).where(F.col("error").isNull())
    if service != "service_id":
        rows = resolve_one(rows, services, service, "service_id", mode="null").where(F.col(service).isNull() | F.col("service_id").isNotNull())
    audits = rows.select(
        audit_id().alias("id"), "claim_id", "service_id", similarity(F.col("confidence")).alias("similarity_score"), F.lit(cfg.similarity_threshold).cast("double").alias("threshold_used"), F.col("verified").alias("is_verified"),
        "step_name", "device_id", F.col("ts").alias("audit_date"), F.to_json(F.struct("provider")).alias("metadata"),
    )
    return apply_defaults(audits)
