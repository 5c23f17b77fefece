"""The registered queries and their SQL: each applies one operator to whole tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as X
from .fixtures import A_SQL, B_SQL, C_SQL, CFG, E_SQL, H_SQL, P_SQL, S_SQL, U_SQL, V_TEXT, md5_vector_sql, table
from .functions.similarity import classify_error as error_of
from .functions.similarity import cosine_distance, rounded, similarity, verdict
from .functions.similarity import first_face as first_of
from .functions.similarity import match_band as band_of
from .functions.snapshot import is_stale
from .operators import claims, history, lookup, risk, sampling, validate
from .plans import insert as insert_plan
from .plans import refresh as refresh_plan
from .plans import verify as verify_plan
from .sources import messages, photos
from .storage import checkpointed, shared_path
from .streaming import risk as risk_streams
from .streaming import verification
from .streaming.sampling import sample_stream
from .tables import BatchTable

SAMPLING_SECONDS = 7200.0  # events are minutes apart
IDLE_SECONDS = 30 * 86400.0
PHOTO_FOLDERS = 64
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a file stream; the pattern lets the source take a single file."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


R3 = "floor({x} * 1000 + 0.5) / 1000"
_RULES = """
SELECT *, CASE WHEN failed > 0 THEN least(0.8::DOUBLE + 0.2::DOUBLE * (failed::DOUBLE / n::DOUBLE), 1.0::DOUBLE)
  WHEN variance > 0.1 THEN 0.4::DOUBLE + least(variance * 5.0::DOUBLE, 0.6::DOUBLE)
  WHEN mean < 0.6 THEN 0.4::DOUBLE + (0.6::DOUBLE - mean) * 0.5::DOUBLE ELSE 0.0::DOUBLE END AS risk
FROM (
  SELECT *, CASE WHEN n > 1 THEN (n::HUGEINT * s2::HUGEINT - s1::HUGEINT * s1::HUGEINT)::DOUBLE / (n * (n - 1))::DOUBLE / 1e8::DOUBLE ELSE 0.0::DOUBLE END AS variance, s1::DOUBLE / n::DOUBLE / 1e4::DOUBLE AS mean
  FROM ({sums})
)
"""
_SUMS = "count(*){w} AS n, sum(CASE WHEN is_verified THEN 0 ELSE 1 END){w} AS failed, sum(score_bp){w} AS s1, sum(score_bp * score_bp){w} AS s2"


def _risk_sql(keep: str, sums: str) -> str:
    level = "CASE WHEN risk >= 0.8 THEN 'CRITICAL' WHEN risk >= 0.5 THEN 'HIGH' WHEN risk >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END"
    return f"SELECT {keep}, {R3.format(x='risk')} AS risk_score, {level} AS risk_level, n::BIGINT AS audit_count, failed::BIGINT AS failed_audits, {R3.format(x='variance')} AS score_variance, {R3.format(x='mean')} AS avg_similarity FROM ({_RULES.format(sums=sums)})"


_ALL_RISK_SQL = _risk_sql("claim_id", f"SELECT claim_id, {_SUMS.format(w='')} FROM ({A_SQL}) GROUP BY claim_id")


def claim_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.claim_risk(X.audits_a(table(spark, sf_dir, "lineitem")), X.claims_c(table(spark, sf_dir, "orders")))


CLAIM_RISK_SQL = f"""
SELECT c.claim_id, coalesce(risk_score, 0.0::DOUBLE) AS risk_score, coalesce(risk_level, 'UNKNOWN') AS risk_level, coalesce(audit_count, 0) AS audit_count, coalesce(failed_audits, 0) AS failed_audits,
  coalesce(score_variance, 0.0::DOUBLE) AS score_variance, coalesce(avg_similarity, 0.0::DOUBLE) AS avg_similarity, CASE WHEN audit_count IS NULL THEN '{risk.NO_AUDITS}' END AS message
FROM ({C_SQL}) c LEFT JOIN ({_ALL_RISK_SQL}) r ON r.claim_id = c.claim_id WHERE c.validity_to IS NULL
"""


def running_claim_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.running_claim_risk(X.frames_b(table(spark, sf_dir, "events"))).drop("message")


RUNNING_SQL = _risk_sql("claim_id, id, last_updated", f"SELECT claim_id, id, audit_date AS last_updated, {_SUMS.format(w=' OVER w')} FROM ({B_SQL}) WINDOW w AS (PARTITION BY claim_id ORDER BY audit_date, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")


def failure_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = risk.failure_rates(X.audits_a(table(spark, sf_dir, "lineitem")))
    return rates.withColumn("bucket_start", F.date_format("bucket_start", "yyyy-MM-dd"))


FAILURE_SQL = f"""
SELECT step_name, strftime(make_timestamp(CAST(floor(epoch(audit_date) / 604800) * 604800 * 1000000 AS BIGINT)), '%Y-%m-%d') AS bucket_start, count(*) AS audits, count(*) FILTER (NOT is_verified) AS failed,
  count(*) FILTER (NOT is_verified) / count(*)::DOUBLE AS failure_rate FROM ({A_SQL}) GROUP BY 1, 2
"""


def _distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.probes_p(spark, sf_dir).withColumn("d", cosine_distance(F.col("probe"), F.col("stored")))


def cosine_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _distances(spark, sf_dir).select("id", "subject_id", verdict(F.col("d"), F.lit(CFG.threshold)).alias("v"))
    return rows.select("id", "subject_id", "v.*", similarity(F.col("v.confidence")).alias("similarity"))


_D_SQL = f"SELECT id, subject_id, 1.0::DOUBLE - list_cosine_similarity(probe, stored) AS d FROM ({P_SQL})"
_CONF_SQL = "floor(least(100.0::DOUBLE, greatest(0.0::DOUBLE, (1.0::DOUBLE - d) * 100.0::DOUBLE)) * 100 + 0.5) / 100"
_R6 = "floor(({x}) * 1000000 + 0.5) / 1000000"
COSINE_SQL = f"SELECT id, subject_id, d <= 0.68 AS verified, {_CONF_SQL} AS confidence, {_R6.format(x='d')} AS distance, {_CONF_SQL} / 100 AS similarity FROM ({_D_SQL})"


def match_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _distances(spark, sf_dir).select("id", band_of(F.col("d"), F.lit(CFG.threshold)).alias("b")).select("id", "b.*")


BAND_SQL = f"""
SELECT id, band, CASE WHEN NOT d <= 0.68 THEN {_R6.format(x='d - 0.68::DOUBLE')} END AS gap, CASE WHEN band = 'marginal' THEN {_R6.format(x='d + 0.01::DOUBLE')} END AS suggested_threshold
FROM (SELECT id, d, CASE WHEN d <= 0.68 AND {_CONF_SQL} > 90 THEN 'excellent' WHEN d <= 0.68 AND {_CONF_SQL} > 75 THEN 'good' WHEN d <= 0.68 THEN 'acceptable'
  WHEN d > 0.8 THEN 'very_high' WHEN d > 0.6 THEN 'high' ELSE 'marginal' END AS band FROM ({_D_SQL}))
"""


def first_face(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = F.filter(F.split("text", " "), lambda x: x != "")
    return table(spark, sf_dir, "documents").select("doc_id", first_of(faces).alias("f")).select("doc_id", "f.*")


FACE_SQL = "SELECT doc_id, f AS face, CASE WHEN f IS NULL THEN 'no face found' END AS error FROM (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: x <> '')[1] AS f FROM documents)"


def _scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rescaled(X.audits_a(table(spark, sf_dir, "lineitem")))


def _rescaled(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"similarity_score": F.col("score_bp") * 12 / 100000.0, "threshold_used": F.col("thr_bp") * 3 / 10000.0})


def validate_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = validate.apply_defaults(_scaled(spark, sf_dir))
    return rows.select("id", validate.audit_reason().alias("reason"), F.array_join(validate.audit_errors(), ",").alias("errors"), "metadata", "version")


VALIDATE_SQL = f"""
SELECT id, CASE WHEN NOT s THEN 'score_range' WHEN NOT t THEN 'threshold_range' WHEN NOT c THEN 'inconsistent' END AS reason,
  CASE WHEN NOT s AND NOT t THEN 'score_range,threshold_range' WHEN NOT s THEN 'score_range' WHEN NOT t THEN 'threshold_range' WHEN NOT c THEN 'inconsistent' ELSE '' END AS errors, '{{}}' AS metadata, 1 AS version
FROM (SELECT id, score_bp * 12 <= 100000 AS s, thr_bp * 3 <= 10000 AS t, is_verified = (score_bp * 12 >= thr_bp * 30) AS c FROM ({A_SQL}))
"""


def inconsistent_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cosine_verdict(spark, sf_dir).select("id", F.col("similarity").alias("similarity_score"), F.lit(CFG.threshold).alias("threshold_used"), F.col("verified").alias("is_verified"))
    return validate.inconsistent_audits(rows)


INCONSISTENT_SQL = f"SELECT id, similarity AS similarity_score, 0.68::DOUBLE AS threshold_used, verified AS is_verified FROM ({COSINE_SQL}) WHERE verified <> (similarity >= 0.68)"


def classify_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 4
    text = F.concat(F.col("text"), F.when(k == 0, " Face could not be DETECTED in img1_path").when(k == 1, " face not detected: img2_path").when(k == 2, " no face was detected").otherwise(" connection lost"))
    return table(spark, sf_dir, "documents").select("doc_id", error_of(text).alias("e")).select("doc_id", "e.error_class", F.md5(F.col("e.user_message").cast("binary")).alias("message_md5"))


ERROR_SQL = """
SELECT doc_id, kind AS error_class, md5(CASE kind WHEN 'probe' THEN 'The captured photo shows no face.' WHEN 'reference' THEN 'The enrolled photo shows no face.' WHEN 'either' THEN 'An image shows no face.' ELSE t END) AS message_md5
FROM (SELECT doc_id, t, CASE WHEN lower(t) LIKE '%face%' AND lower(t) LIKE '%detect%' THEN CASE WHEN lower(t) LIKE '%img1\\_path%' ESCAPE '\\' THEN 'probe' WHEN lower(t) LIKE '%img2\\_path%' ESCAPE '\\' THEN 'reference' ELSE 'either' END ELSE 'other' END AS kind
FROM (SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN ' Face could not be DETECTED in img1_path' WHEN 1 THEN ' face not detected: img2_path' WHEN 2 THEN ' no face was detected' ELSE ' connection lost' END AS t FROM documents))
"""


def active_not_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = validate.active(X.embeddings_e(spark, sf_dir)).select(F.lit("embedding").alias("kind"), F.col("vec_id").cast("string").alias("id"))
    return kept.unionByName(validate.not_deleted(X.audits_a(table(spark, sf_dir, "lineitem"))).select(F.lit("audit").alias("kind"), "id"))


ACTIVE_SQL = f"SELECT 'embedding' AS kind, CAST(vec_id AS VARCHAR) AS id FROM ({E_SQL}) WHERE validity_to IS NULL UNION ALL SELECT 'audit', id FROM ({A_SQL}) WHERE NOT is_deleted"


def list_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.list_audits(X.audits_a(table(spark, sf_dir, "lineitem")), X.claims_c(table(spark, sf_dir, "orders")), X.services_s(table(spark, sf_dir, "supplier")))


LIST_SQL = f"""
SELECT id, CAST(a.claim_id AS VARCHAR) AS claim, CAST(s.service_id AS VARCHAR) AS service, score_bp / 10000.0::DOUBLE AS similarity_score, thr_bp / 10000.0::DOUBLE AS threshold_used, is_verified, step_name, '' AS device_id, audit_date
FROM ({A_SQL}) a JOIN ({C_SQL}) c ON c.claim_id = a.claim_id LEFT JOIN ({S_SQL}) s ON s.service_id = a.service_id WHERE NOT is_deleted AND c.validity_to IS NULL
"""


def resolve_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    audits = X.audits_a(table(spark, sf_dir, "lineitem")).select("id", F.concat(F.lit("CL-"), F.col("claim_id").cast("string")).alias("claim_code"))
    return lookup.resolve_one(audits, X.claims_c(table(spark, sf_dir, "orders")), "claim_code", "claim_id").select("id", "claim_code", "claim_id", "error")


RESOLVE_SQL = f"""
SELECT id, a.claim_code, CASE WHEN n = 1 THEN d.claim_id END AS claim_id, CASE WHEN n IS NULL THEN 'not_found' WHEN n > 1 THEN 'ambiguous' END AS error
FROM (SELECT id, 'CL-' || CAST(claim_id AS VARCHAR) AS claim_code FROM ({A_SQL})) a
LEFT JOIN (SELECT claim_code, count(*) AS n, min(claim_id) AS claim_id FROM ({C_SQL}) WHERE validity_to IS NULL GROUP BY 1) d ON d.claim_code = a.claim_code
"""


def resolve_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    audits = X.audits_a(table(spark, sf_dir, "lineitem")).select("id", F.when(F.col("claim_id") % 3 != 0, F.col("service_id")).alias("service_id"))
    return lookup.resolve_optional(audits, X.services_s(table(spark, sf_dir, "supplier")), "service_id").select("id", "service_id", "error")


OPTIONAL_SQL = f"""
SELECT id, a.service_id, CASE WHEN a.service_id IS NOT NULL AND s.service_id IS NULL THEN 'unknown_service_id' END AS error
FROM (SELECT id, CASE WHEN claim_id % 3 <> 0 THEN service_id END AS service_id FROM ({A_SQL})) a LEFT JOIN ({S_SQL}) s ON s.service_id = a.service_id AND s.validity_to IS NULL
"""


def attach_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos_now = X.photos_v(table(spark, sf_dir, "customer"))
    rows = lookup.attach_reference(X.frames_b(table(spark, sf_dir, "events")).select("id", "subject_id"), X.subjects_u(table(spark, sf_dir, "customer")), X.embeddings_e(spark, sf_dir), photos_now)
    return rows.select("id", "subject_id", "known", "metadata", F.size("embedding").alias("n_values"), F.length("photo").alias("photo_bytes"))


ATTACH_SQL = f"""
SELECT id, b.subject_id, u.subject_id IS NOT NULL AS known, metadata, CAST(len(embedding) AS INTEGER) AS n_values, CASE WHEN b.subject_id % 17 <> 0 AND p.c_custkey IS NOT NULL THEN strlen({V_TEXT.format(k='b.subject_id')}) END AS photo_bytes
FROM ({B_SQL}) b LEFT JOIN ({U_SQL}) u ON u.subject_id = b.subject_id AND u.validity_to IS NULL LEFT JOIN ({E_SQL}) e ON e.subject_id = b.subject_id AND e.validity_to IS NULL LEFT JOIN customer p ON p.c_custkey = b.subject_id
"""


def reference_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.attach_reference_asof(X.frames_b(table(spark, sf_dir, "events")).select("id", "subject_id", "ts"), X.embeddings_e(spark, sf_dir)).select("id", "subject_id", "vec_id")


ASOF_SQL = f"SELECT id, b.subject_id, vec_id FROM ({B_SQL}) b LEFT JOIN ({E_SQL}) e ON e.subject_id = b.subject_id AND b.ts >= e.validity_from AND (e.validity_to IS NULL OR b.ts < e.validity_to)"


def stale_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.embeddings_e(spark, sf_dir).select("vec_id", "subject_id", is_stale(F.col("metadata"), CFG).alias("stale"))


STALE_SQL = f"""
SELECT vec_id, subject_id, NOT (len(json_keys(metadata)) = 3 AND coalesce(json_extract_string(metadata, 'provider'), '') = 'md5' AND coalesce(json_extract_string(metadata, 'model_name'), '') = 'ArcFace' AND coalesce(json_extract_string(metadata, 'detector_backend'), '') = 'retinaface') AS stale FROM ({E_SQL})
"""
_NOW = "2025-01-01"


def supersede(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = X.embeddings_e(spark, sf_dir).select("subject_id", "vec_id", "validity_from", "validity_to")
    stale = validate.active(X.embeddings_e(spark, sf_dir)).where(is_stale(F.col("metadata"), CFG))
    new = stale.select("subject_id", F.lit(None).cast("long").alias("vec_id"))  # as after refreshing what is stale
    return history.supersede(old, new, F.lit(_NOW).cast("timestamp_ntz"))


SUPERSEDE_SQL = f"""
WITH s AS (SELECT e.* FROM ({E_SQL}) e JOIN ({STALE_SQL}) t ON t.vec_id = e.vec_id WHERE e.validity_to IS NULL AND stale)
SELECT e.subject_id, e.vec_id, e.validity_from, CASE WHEN e.validity_to IS NULL AND s.vec_id IS NOT NULL THEN TIMESTAMP '{_NOW}' ELSE e.validity_to END AS validity_to FROM ({E_SQL}) e LEFT JOIN s ON s.vec_id = e.vec_id
UNION ALL SELECT subject_id, NULL, TIMESTAMP '{_NOW}', NULL FROM s
"""


def refresh_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    subjects = docs.select(F.col("doc_id").alias("subject_id"), F.lit(None).cast("timestamp_ntz").alias("validity_to"))
    old = X.embeddings_e(spark, sf_dir)
    rows, report = refresh_plan.refresh_embeddings(subjects, X.photos_d(docs), old, CFG, F.lit(_NOW).cast("timestamp_ntz"))
    # new rows have no number; an old version may start at the same time
    new = rows.where(F.col("vec_id").isNull()).select("subject_id", _vector(F.col("embedding")).alias("vector"))
    return report.join(new, "subject_id", "left").select("subject_id", "success", "error", "vector")


REFRESH_SQL = f"""
SELECT doc_id AS subject_id, error IS NULL AS success, error, CASE WHEN error IS NULL THEN array_to_string(list_transform({md5_vector_sql('text')}, lambda x: CAST(x * 128 + 128 AS INTEGER)), ' ') END AS vector
FROM (SELECT doc_id, text, CASE WHEN doc_id % 17 = 0 OR text IS NULL THEN 'no photo' WHEN strlen(text) % 29 = 0 THEN 'unreadable image' END AS error FROM documents)
"""


def load_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each supplier, written by tasks and read back by a manifest of them all."""
    root, manifest = shared_path(spark, "photos"), shared_path(spark, "manifest")
    k = F.col("s_suppkey")
    content = F.concat(F.lit("photo of "), "s_name", F.lit("\n")).cast("binary")
    rows = table(spark, sf_dir, "supplier").select(k.alias("subject_id"), F.concat(F.lit("part="), k % PHOTO_FOLDERS).alias("folder"), F.concat(k.cast("string"), F.lit(".txt")).alias("filename"), content.alias("content"))
    photos.store_photos(rows.repartition(PHOTO_FOLDERS, F.col("folder")), root).write.parquet(manifest)
    paths, k, file = spark.read.parquet(manifest), F.col("subject_id") % 6, F.col("filename")
    name = F.when(k == 2, F.concat(file, F.lit(".gone"))).when(k == 3, F.concat(F.lit("../"), file)).when(k == 4, F.concat(F.lit("./"), file)).when(k != 5, file)
    found = photos.load_photos(spark, root, paths.select("subject_id", "folder", name.alias("filename")))
    return found.select("subject_id", F.md5("content").alias("content_md5"), "error")


PHOTOS_SQL = """
SELECT s_suppkey AS subject_id, CASE WHEN s_suppkey % 6 IN (0, 1, 4) THEN md5('photo of ' || s_name || chr(10)) END AS content_md5,
  CASE s_suppkey % 6 WHEN 2 THEN 'file missing' WHEN 3 THEN 'path outside root' WHEN 5 THEN 'no photo' END AS error FROM supplier
"""


def parse_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    # one pass over the messages for all outputs
    frames, other, dead = messages.split_messages(checkpointed(messages.read_messages(X.messages_m(table(spark, sf_dir, "conversations")))))
    good, lacking = validate.require_fields(frames, ["insuree_uuid", "frame"])
    from .functions.frames import decode_frame

    part = lambda df, status, body: df.select("conn_id", "turn", F.lit(status).alias("status"), body.alias("content_md5"))
    none = F.lit(None).cast("string")
    return part(good, "frame", F.md5(decode_frame(F.col("frame")))).unionByName(part(lacking, "incomplete", none)).unionByName(part(other, "unknown", none)).unionByName(part(dead, "dead", none))


PARSE_SQL = """
SELECT conv_id AS conn_id, turn, status, CASE WHEN status = 'frame' THEN md5(text) END AS content_md5
FROM (SELECT *, CASE WHEN turn % 11 = 10 THEN 'dead' WHEN role <> 'user' OR role IS NULL THEN 'unknown' WHEN conv_id % 9 = 0 OR text IS NULL THEN 'incomplete' ELSE 'frame' END AS status FROM conversations)
"""


def sample_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_frames(X.frames_b(table(spark, sf_dir, "events")), SAMPLING_SECONDS).select("conn_id", "id", "ts")


# each frame's successor is the first one an interval later; a chain starts at a connection's first frame
_SAMPLE_CTE = f"""
b AS MATERIALIZED ({B_SQL}),
nxt AS MATERIALIZED (SELECT a.conn_id, a.id, a.ts, (SELECT min(c.ts) FROM b c WHERE c.conn_id = a.conn_id AND c.ts >= a.ts + INTERVAL 2 HOUR) AS next_ts FROM b a),
chain AS (
  SELECT conn_id, min(ts) AS ts FROM b GROUP BY conn_id
  UNION ALL SELECT nxt.conn_id, next_ts FROM chain JOIN nxt ON nxt.conn_id = chain.conn_id AND nxt.ts = chain.ts WHERE next_ts IS NOT NULL
),
passed AS (SELECT b.conn_id, b.id, b.ts FROM chain JOIN b ON b.conn_id = chain.conn_id AND b.ts = chain.ts)
"""
SAMPLE_SQL = f"WITH RECURSIVE {_SAMPLE_CTE} SELECT conn_id, id, ts FROM passed"


def connection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = X.frames_b(table(spark, sf_dir, "events"))
    return sampling.connection_stats(frames, sampling.sample_frames(frames, SAMPLING_SECONDS))


STATS_SQL = f"WITH RECURSIVE {_SAMPLE_CTE} SELECT b.conn_id, count(*) AS frames, count(passed.id) AS verifications FROM b LEFT JOIN passed ON passed.id = b.id GROUP BY 1"


def number_verifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = X.frames_b(table(spark, sf_dir, "events")).select("conn_id", "id", "ts")
    return sampling.number_verifications(frames, sampling.sample_frames(frames, SAMPLING_SECONDS)).select("conn_id", "id", "frame_count", "verification_count")


NUMBER_SQL = f"""
WITH RECURSIVE {_SAMPLE_CTE}
SELECT conn_id, id, frame_count, verification_count FROM (
  SELECT b.conn_id, b.id, passed.id AS p, count(*) OVER w AS frame_count, count(passed.id) OVER w AS verification_count FROM b LEFT JOIN passed ON passed.id = b.id
  WINDOW w AS (PARTITION BY b.conn_id ORDER BY b.ts, b.id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
) WHERE p IS NOT NULL
"""


def sample_frames_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream over everything that is there now; the frames that pass are written and read back."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    stream = stream_of(spark, sf_dir, "events")
    out = shared_path(spark, "sampled")
    passed = sample_stream(X.frames_b(stream).select("conn_id", "id", "ts"), SAMPLING_SECONDS, idle_seconds=IDLE_SECONDS)
    passed.writeStream.format("parquet").option("checkpointLocation", f"{out}-state").outputMode("append").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(passed.schema).parquet(out).select(F.col("conn_id").cast("long").alias("conn_id"), "id", "frame_count", "verification_count")


def _verified(spark: SparkSession, sf_dir: str, keep: bool = False) -> tuple[DataFrame, DataFrame]:
    customers = table(spark, sf_dir, "customer")
    return verify_plan.verify(X.frames_v(table(spark, sf_dir, "events")), X.subjects_u(customers), X.embeddings_v(spark, sf_dir), X.photos_v(customers), CFG, keep)


def verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verified(spark, sf_dir)[0].select("id", "subject_id", "route", "verified", "confidence", "distance", "error")


_V_PROBE = V_TEXT.format(k="(CASE WHEN event_id % 3 = 0 THEN user_id ELSE event_id END)")
_V_REF = V_TEXT.format(k="user_id")
_V_SQL = f"""
SELECT *, CASE WHEN probe_error IS NOT NULL THEN probe_error WHEN route = 'unknown' THEN 'unknown subject' WHEN route <> 'fast' THEN photo_error END AS error,
  CASE WHEN route = 'slow' THEN 0.3::DOUBLE ELSE 0.68::DOUBLE END AS thr, 1.0::DOUBLE - list_cosine_similarity({md5_vector_sql(_V_PROBE)}, {md5_vector_sql(_V_REF)}) AS d
FROM (
  SELECT *, CASE WHEN base = 'refresh' AND photo_error IS NOT NULL THEN 'slow' ELSE base END AS route FROM (
    SELECT event_id, user_id, ts, CASE WHEN u.subject_id IS NULL THEN 'unknown' WHEN e.subject_id IS NULL THEN 'slow' WHEN e.stale THEN 'refresh' ELSE 'fast' END AS base,
      CASE WHEN event_id % 31 = 0 THEN 'frame can''t be decoded' WHEN strlen({_V_PROBE}) % 29 = 0 THEN 'unreadable image' END AS probe_error,
      CASE WHEN user_id % 17 = 0 THEN 'no photo' WHEN strlen({_V_REF}) % 29 = 0 THEN 'unreadable image' END AS photo_error
    FROM events LEFT JOIN ({U_SQL}) u ON u.subject_id = user_id AND u.validity_to IS NULL
    LEFT JOIN (SELECT x.subject_id, s.stale FROM ({E_SQL}) x JOIN ({STALE_SQL}) s ON s.vec_id = x.vec_id WHERE x.validity_to IS NULL) e ON e.subject_id = user_id
  )
)
"""
VERIFY_SQL = f"""
SELECT event_id AS id, user_id AS subject_id, route, error IS NULL AND d <= thr AS verified, CASE WHEN error IS NULL THEN {_CONF_SQL} ELSE 0.0::DOUBLE END AS confidence,
  CASE WHEN error IS NULL THEN {_R6.format(x='d')} END AS distance, error FROM ({_V_SQL})
"""


def verify_to_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subjects whose embedding the verification made anew: stale ones, and those of a verified slow match."""
    return _verified(spark, sf_dir, keep=True)[1].select("subject_id")


TO_STORE_SQL = f"""
SELECT subject_id FROM ({VERIFY_SQL}) WHERE route = 'slow' AND verified
UNION SELECT user_id FROM ({_V_SQL}) WHERE route = 'refresh' AND coalesce(probe_error, '') <> 'frame can''t be decoded'
"""


def _vector(embedding: Column) -> Column:
    return F.array_join(F.transform(embedding, lambda x: (x * 128 + 128).cast("int").cast("string")), " ")


def verify_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of embeddings after the verification's new ones are stored."""
    new = _verified(spark, sf_dir, keep=True)[1]
    rows = refresh_plan.store_embeddings(X.embeddings_v(spark, sf_dir), new, F.lit(_NOW).cast("timestamp_ntz"))
    return rows.select("subject_id", "vec_id", "validity_from", "validity_to", _vector(F.col("embedding")).alias("vector"))


_VECTOR_SQL = f"array_to_string(list_transform({md5_vector_sql(V_TEXT.format(k='subject_id'))}, lambda x: CAST(x * 128 + 128 AS INTEGER)), ' ')"
STORED_SQL = f"""
WITH s AS ({TO_STORE_SQL})
SELECT *, {_VECTOR_SQL} AS vector FROM (
  SELECT e.subject_id, vec_id, validity_from, CASE WHEN validity_to IS NULL AND s.subject_id IS NOT NULL THEN TIMESTAMP '{_NOW}' ELSE validity_to END AS validity_to FROM ({E_SQL}) e LEFT JOIN s ON s.subject_id = e.subject_id
  UNION ALL SELECT subject_id, NULL, TIMESTAMP '{_NOW}', NULL FROM s
)
"""


def audits_from_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    results, _ = _verified(spark, sf_dir)
    audits = verify_plan.audits_from_results(results, X.claims_c(table(spark, sf_dir, "orders")), X.services_s(table(spark, sf_dir, "supplier")), CFG)
    return audits.select("id", "claim_id", "service_id", "similarity_score", "threshold_used", "is_verified", "step_name", "metadata", "is_deleted", "version")


def insert_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every audit as a request: what is stored, and what is rejected with its first error."""
    rows = _requests(X.audits_a(table(spark, sf_dir, "lineitem")))
    checked, broken = insert_plan.check_audits(rows, X.claims_c(table(spark, sf_dir, "orders")).withColumnRenamed("claim_code", "claim_uuid"), _services(spark, sf_dir))
    # one pass for both
    fields = (F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in ("claim_id", "service_id", "device_id", "metadata", "version"))
    return checked.select("id", *fields, "error").unionByName(broken, allowMissingColumns=True)


def _requests(audits: DataFrame) -> DataFrame:
    k = F.col("claim_id")
    return _rescaled(audits).withColumns({
        "claim_uuid": F.when(k % 97 != 0, F.concat(F.lit("CL-"), k.cast("string"))), "service_uuid": F.when(k % 3 == 2, F.concat(F.lit("V"), F.col("service_id").cast("string"))).when(k % 3 == 1, F.lit("")),
        "device_id": F.when(k % 2 == 0, F.lit("d")), "metadata": F.lit(""),
    }).drop("claim_id", "service_id")


def _services(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.services_s(table(spark, sf_dir, "supplier")).withColumn("service_uuid", F.concat(F.lit("V"), F.col("service_id").cast("string")))


INSERT_SQL = f"""
SELECT id, CASE WHEN error IS NULL THEN claim END AS claim_id, CASE WHEN error IS NULL THEN service END AS service_id, CASE WHEN error IS NULL THEN CASE WHEN claim_id % 2 = 0 THEN 'd' ELSE '' END END AS device_id,
  CASE WHEN error IS NULL THEN '{{}}' END AS metadata, CASE WHEN error IS NULL THEN 1 END AS version, error
FROM (
  SELECT a.id, a.claim_id, c.claim_id AS claim, s.service_id AS service,
    CASE WHEN a.claim_id % 97 = 0 THEN 'missing: claim_uuid' WHEN score_bp * 12 > 100000 THEN 'score_range' WHEN thr_bp * 3 > 10000 THEN 'threshold_range' WHEN is_verified <> (score_bp * 12 >= thr_bp * 30) THEN 'inconsistent'
      WHEN n IS NULL THEN 'claim_not_found' WHEN n > 1 THEN 'claim_ambiguous' WHEN a.claim_id % 3 = 2 AND s.service_id IS NULL THEN 'service_not_found' END AS error
  FROM ({A_SQL}) a LEFT JOIN (SELECT claim_code, count(*) AS n, min(claim_id) AS claim_id FROM ({C_SQL}) WHERE validity_to IS NULL GROUP BY 1) c ON c.claim_code = 'CL-' || CAST(a.claim_id AS VARCHAR)
  LEFT JOIN ({S_SQL}) s ON a.claim_id % 3 = 2 AND s.service_id = a.service_id AND s.validity_to IS NULL
)
"""


AUDITS_SQL = f"""
SELECT concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32]) AS id, claim_id, service_id, similarity_score, 0.68::DOUBLE AS threshold_used, is_verified, 'gate' AS step_name, '{{"provider":"md5"}}' AS metadata, false AS is_deleted, 1 AS version
FROM (
  SELECT md5(CAST(user_id AS VARCHAR) || '|' || CAST(epoch_us(ts) AS VARCHAR)) AS h, c.claim_id, CASE WHEN event_id % 6 <> 0 THEN event_id % 40 END AS service_id, s.service_id AS known, {_CONF_SQL} / 100 AS similarity_score, d <= thr AS is_verified
  FROM ({_V_SQL}) v JOIN (SELECT claim_code, min(claim_id) AS claim_id FROM ({C_SQL}) WHERE validity_to IS NULL GROUP BY 1 HAVING count(*) = 1) c ON c.claim_code = 'CL-' || CAST(event_id AS VARCHAR)
  LEFT JOIN ({S_SQL}) s ON s.validity_to IS NULL AND s.service_id = CASE WHEN event_id % 6 <> 0 THEN event_id % 40 END
  WHERE error IS NULL AND event_id % 4 <> 0
) WHERE service_id IS NULL OR known IS NOT NULL
"""


def format_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _verified(spark, sf_dir)[0].withColumn("verified", F.when(F.col("route") != "unknown", F.col("verified")))
    out = messages.format_results(rows.select("verified", "confidence", "distance", "provider", "error"))
    m = F.from_json("value", "type string, message string, verified boolean, confidence double, distance double, error string")
    out = out.select(m.alias("m"), F.contains("value", F.lit('"audit_uuid":null')).alias("nulls_kept")).select("m.*", "nulls_kept")
    return out.withColumn("verified", F.col("verified").cast("string"))


FORMAT_SQL = f"""
SELECT CASE WHEN route = 'unknown' THEN 'error' ELSE 'verification_result' END AS type, CASE WHEN route = 'unknown' THEN error END AS message, CASE WHEN route <> 'unknown' THEN CAST(verified AS VARCHAR) END AS verified,
  CASE WHEN route <> 'unknown' THEN confidence END AS confidence, CASE WHEN route <> 'unknown' THEN distance END AS distance, CASE WHEN route <> 'unknown' THEN error END AS error, route <> 'unknown' AS nulls_kept FROM ({VERIFY_SQL})
"""


def merge_claim_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    audits = X.audits_a(table(spark, sf_dir, "lineitem"))
    return _risk_fields(claims.merge_claim_ext(X.claims_c(table(spark, sf_dir, "orders")), risk.claim_risk(audits, last_updated=True)))


def _risk_fields(rows: DataFrame) -> DataFrame:
    fields = F.from_json("json_ext", f"priority string, {claims.RISK_KEY} struct<risk_score double, risk_level string, audit_count bigint, last_updated string>")
    rows = rows.select("claim_id", fields.alias("ext")).select("claim_id", "ext.priority", f"ext.{claims.RISK_KEY}.*")
    return rows.withColumn("risk_score", rounded(F.col("risk_score"), 3))


MERGE_SQL = f"""
SELECT c.claim_id, json_extract_string(json_ext, 'priority') AS priority, risk_score, risk_level, audit_count, strftime(last_updated, '%Y-%m-%dT%H:%M:%S') AS last_updated
FROM ({C_SQL}) c LEFT JOIN ({_ALL_RISK_SQL}) r ON r.claim_id = c.claim_id LEFT JOIN (SELECT claim_id, max(audit_date) AS last_updated FROM ({A_SQL}) GROUP BY 1) l ON l.claim_id = c.claim_id
"""


def latest_from_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.latest_from_history(X.history_h(table(spark, sf_dir, "lineitem"))).select("id", "claim_id", "score_bp", "history_type", "history_date")


LATEST_SQL = f"SELECT id, claim_id, score_bp, history_type, history_date FROM ({H_SQL}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY history_date DESC, history_id DESC) = 1 AND history_type <> '-'"


def _risk_streamed(spark: SparkSession, sf_dir: str) -> str:
    """Both streams over everything that is there now: audits are stored, sums kept current."""
    to = shared_path(spark, "risk_stream")
    stream = X.audits_a(stream_of(spark, sf_dir, "lineitem"))
    running = risk_streams.store_stream(stream, f"{to}/audits", f"{to}/state-audits"), risk_streams.risk_stream(stream, f"{to}/sums", f"{to}/state-risk", raise_errors=True)
    for query in running:
        query.awaitTermination()
    return f"{to}/sums"


def risk_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last risk of each claim."""
    return risk_streams.current_risk(spark, _risk_streamed(spark, sf_dir)).drop("message", "last_updated")


def risk_stream_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All claims as they are, with the risk that the stream keeps merged into their JSON."""
    return _risk_fields(risk_streams.current_claims(X.claims_c(table(spark, sf_dir, "orders")), _risk_streamed(spark, sf_dir)))


def insert_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests of insert_audits as a stream: what is stored and what is rejected, and the risk of the claims that got audits."""
    out = shared_path(spark, "insert_stream")
    tables = lambda session: {"claims": X.claims_c(table(session, sf_dir, "orders")).withColumnRenamed("claim_code", "claim_uuid"), "services": _services(session, sf_dir)}
    risk_streams.insert_stream(_requests(X.audits_a(stream_of(spark, sf_dir, "lineitem"))), tables, out, f"{out}/state").awaitTermination()
    stored, bad = BatchTable(spark, f"{out}/audits").read(), BatchTable(spark, f"{out}/rejected").read()
    rows = stored.join(risk_streams.current_risk(spark, f"{out}/sums"), "claim_id").select("id", "claim_id", "service_id", "risk_score", "audit_count", F.lit(None).cast("string").alias("error"))
    return rows.unionByName(bad, allowMissingColumns=True)


INSERT_STREAM_SQL = f"""
WITH i AS ({INSERT_SQL}),
r AS ({_risk_sql("claim_id", f"SELECT claim_id, {_SUMS.format(w='')} FROM (SELECT i.claim_id, a.score_bp * 6 // 5 AS score_bp, is_verified FROM i JOIN ({A_SQL}) a ON a.id = i.id WHERE error IS NULL) GROUP BY claim_id")})
SELECT i.id, i.claim_id, service_id, risk_score, audit_count, error FROM i LEFT JOIN r ON r.claim_id = i.claim_id AND error IS NULL
"""


def verify_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verification job over all messages that are there now: the rows of its results."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    out = shared_path(spark, "verify_stream")

    def tables(session: SparkSession) -> dict[str, DataFrame]:
        customers = table(session, sf_dir, "customer")
        people = X.subjects_u(customers).withColumn("insuree_uuid", F.concat(F.lit("S"), F.col("subject_id").cast("string")))
        return {"subjects": people, "photos": X.photos_v(customers), "embeddings": X.embeddings_v(session, sf_dir), "claims": X.claims_c(table(session, sf_dir, "orders")), "services": _services(session, sf_dir)}

    cfg = replace(CFG, sampling_seconds=SAMPLING_SECONDS)
    verification.verify_stream(X.messages_v(stream_of(spark, sf_dir, "events")), tables, cfg, out, f"{out}/state", idle_seconds=IDLE_SECONDS).awaitTermination()
    rows = BatchTable(spark, f"{out}/results").read()
    return rows.select("id", "subject_id", "route", "verified", "confidence", "distance", "error", "frame_count", "verification_count", F.col("audit_uuid").isNotNull().alias("has_audit"))


VERIFY_STREAM_SQL = f"""
WITH RECURSIVE {_SAMPLE_CTE.replace(f"({B_SQL})", f"(SELECT * FROM ({B_SQL}) WHERE id % 37 <> 0 AND id % 41 <> 0)")},
f AS (SELECT event_id AS id, user_id AS conn_id, ts FROM events WHERE event_id % 41 <> 0),
n AS (
  SELECT f.id, passed.id AS p, count(*) OVER w AS frame_count, count(passed.id) OVER w AS verification_count FROM f LEFT JOIN passed ON passed.id = f.id
  WINDOW w AS (PARTITION BY f.conn_id ORDER BY f.ts, f.id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)
SELECT n.id, CASE WHEN route <> 'unknown' THEN subject_id END AS subject_id, route, verified, confidence, distance, error, frame_count, verification_count, a.id IS NOT NULL AS has_audit
FROM n JOIN ({VERIFY_SQL}) v ON v.id = n.id JOIN events e ON e.event_id = n.id
LEFT JOIN ({AUDITS_SQL}) a ON replace(a.id, '-', '') = md5(CAST(user_id AS VARCHAR) || '|' || CAST(epoch_us(e.ts) AS VARCHAR)) WHERE p IS NOT NULL
UNION ALL SELECT id, NULL, NULL, NULL, NULL, NULL, 'missing: frame', frame_count, verification_count, false FROM n WHERE id % 37 = 0
UNION ALL SELECT event_id, NULL, NULL, NULL, NULL, NULL, '{messages.UNREADABLE["invalid"]}', NULL, NULL, false FROM events WHERE event_id % 41 = 0
"""


QUERIES = {
    f.__name__: f
    for f in (
        claim_risk, running_claim_risk, failure_rates, cosine_verdict, match_band, first_face, validate_audits, inconsistent_audits, classify_error, active_not_deleted, list_audits, resolve_one, resolve_optional,
        attach_reference, reference_asof, stale_embeddings, supersede, refresh_embeddings, load_photos, parse_frames, sample_frames, connection_stats, number_verifications, sample_frames_stream, verify,
        verify_to_store, verify_stored, audits_from_results, insert_audits, format_results, merge_claim_ext, latest_from_history, risk_stream, risk_stream_claims, insert_stream, verify_stream,
    )
}
ORACLE_SQL = {
    "claim_risk": CLAIM_RISK_SQL, "running_claim_risk": RUNNING_SQL, "failure_rates": FAILURE_SQL, "cosine_verdict": COSINE_SQL, "match_band": BAND_SQL, "first_face": FACE_SQL, "validate_audits": VALIDATE_SQL,
    "inconsistent_audits": INCONSISTENT_SQL, "classify_error": ERROR_SQL, "active_not_deleted": ACTIVE_SQL, "list_audits": LIST_SQL, "resolve_one": RESOLVE_SQL, "resolve_optional": OPTIONAL_SQL,
    "attach_reference": ATTACH_SQL, "reference_asof": ASOF_SQL, "stale_embeddings": STALE_SQL, "supersede": SUPERSEDE_SQL, "refresh_embeddings": REFRESH_SQL, "load_photos": PHOTOS_SQL, "parse_frames": PARSE_SQL,
    "sample_frames": SAMPLE_SQL, "connection_stats": STATS_SQL, "number_verifications": NUMBER_SQL, "sample_frames_stream": NUMBER_SQL, "verify": VERIFY_SQL, "verify_to_store": TO_STORE_SQL,
    "audits_from_results": AUDITS_SQL, "format_results": FORMAT_SQL, "merge_claim_ext": MERGE_SQL, "latest_from_history": LATEST_SQL, "risk_stream": _ALL_RISK_SQL,
    "verify_stored": STORED_SQL, "insert_audits": INSERT_SQL, "risk_stream_claims": MERGE_SQL, "insert_stream": INSERT_STREAM_SQL, "verify_stream": VERIFY_STREAM_SQL,
}
