"""Inputs of the registered queries, derived from the driver's tables (FIXTURES.md), in Spark and in SQL.

Each Spark function has a SQL twin of the same rows; both only rename and compute, nothing is capped.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import VerifyConfig
from .operators.history import intervals
from .plans.embedder import Embedder, register

CFG = VerifyConfig(provider="md5", model_name="ArcFace", provider_config={"detector_backend": "retinaface"})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# A: audits, no order

A_SQL = """
SELECT l_orderkey AS claim_id,
  concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS id,
  CAST(round(l_quantity * 200) AS BIGINT) AS score_bp, CAST(round(l_tax * 50000) AS BIGINT) AS thr_bp,
  CAST(round(l_quantity * 200) AS BIGINT) >= CAST(round(l_tax * 50000) AS BIGINT) AS is_verified,
  l_returnflag || l_linestatus AS step_name, l_suppkey AS service_id, l_shipdate AS audit_date, l_discount = 0.1 AS is_deleted
FROM lineitem
"""


def audits_a(lineitem: DataFrame) -> DataFrame:
    bp = lambda c, k: F.round(F.col(c) * k).cast("long")
    rows = lineitem.select(
        F.col("l_orderkey").alias("claim_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long")).alias("id"),
        bp("l_quantity", 200).alias("score_bp"), bp("l_tax", 50000).alias("thr_bp"), F.concat("l_returnflag", "l_linestatus").alias("step_name"), F.col("l_suppkey").alias("service_id"),
        F.col("l_shipdate").alias("audit_date"), (F.col("l_discount") == 0.1).alias("is_deleted"), F.lit("").alias("device_id"),
    )
    return rows.withColumns({"similarity_score": F.col("score_bp") / 10000.0, "threshold_used": F.col("thr_bp") / 10000.0, "is_verified": F.col("score_bp") >= F.col("thr_bp")})


# B: audits and frames in order

B_SQL = """
SELECT user_id * 100 + day(ts) AS claim_id, event_id AS id, user_id AS conn_id, user_id AS subject_id, ts, ts AS audit_date,
  least(CAST(round(value * 100) AS BIGINT), 10000) AS score_bp, least(CAST(round(value * 100) AS BIGINT), 10000) >= 200 AS is_verified
FROM events
"""


def frames_b(events: DataFrame) -> DataFrame:
    bp = F.least(F.round(F.col("value") * 100).cast("long"), F.lit(10000).cast("long"))
    rows = events.select((F.col("user_id") * 100 + F.dayofmonth("ts")).alias("claim_id"), F.col("event_id").alias("id"), F.col("user_id").alias("conn_id"), F.col("user_id").alias("subject_id"), "ts", F.col("ts").alias("audit_date"), bp.alias("score_bp"))
    return rows.withColumns({"similarity_score": F.col("score_bp") / 10000.0, "is_verified": F.col("score_bp") >= 200})


# C: claims; S: services; U: subjects

C_SQL = """
SELECT o_orderkey AS claim_id, 'CL-' || CAST(o_orderkey - CASE WHEN o_orderkey % 50 = 1 THEN 1 ELSE 0 END AS VARCHAR) AS claim_code,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS validity_to,
  CASE WHEN o_orderkey % 10 <> 0 THEN '{"priority":"' || o_orderpriority || '"}' END AS json_ext
FROM orders
"""
S_SQL = "SELECT s_suppkey AS service_id, CASE WHEN s_acctbal < 0 THEN 1 END AS validity_to FROM supplier"
U_SQL = "SELECT c_custkey AS subject_id, CASE WHEN c_acctbal < 0 THEN 1 END AS validity_to FROM customer"


def claims_c(orders: DataFrame) -> DataFrame:
    code = F.concat(F.lit("CL-"), (F.col("o_orderkey") - F.when(F.col("o_orderkey") % 50 == 1, 1).otherwise(0)).cast("string"))
    ext = F.when(F.col("o_orderkey") % 10 != 0, F.to_json(F.struct(F.col("o_orderpriority").alias("priority"))))
    return orders.select(F.col("o_orderkey").alias("claim_id"), code.alias("claim_code"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("validity_to"), ext.alias("json_ext"))


def services_s(supplier: DataFrame) -> DataFrame:
    return supplier.select(F.col("s_suppkey").alias("service_id"), F.when(F.col("s_acctbal") < 0, 1).alias("validity_to"))


def subjects_u(customer: DataFrame) -> DataFrame:
    return customer.select(F.col("c_custkey").alias("subject_id"), F.when(F.col("c_acctbal") < 0, 1).alias("validity_to"))


# E: embeddings as versions; the number of users is one value

E_SQL = """
SELECT vec_id, subject_id, embedding, metadata, validity_from,
  coalesce(lead(validity_from) OVER (PARTITION BY subject_id ORDER BY validity_from), CASE WHEN subject_id % 7 = 0 THEN validity_from + INTERVAL 1 DAY END) AS validity_to
FROM (
  SELECT vec_id, vec_id % (SELECT max(user_id) + 1 FROM events) AS subject_id, CAST(embedding AS DOUBLE[]) AS embedding,
    CASE WHEN vec_id % 5 = 0 THEN '{"provider":"md5","model_name":"ArcFace","detector_backend":"opencv"}' WHEN vec_id % 13 = 0 THEN '{}'
      ELSE '{"provider":"md5","model_name":"ArcFace","detector_backend":"retinaface"}' END AS metadata,
    TIMESTAMP '2024-01-01' + to_hours(CAST(vec_id AS INTEGER)) AS validity_from
  FROM embeddings
) WHERE subject_id % 11 <> 0
"""


def embeddings_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").agg(F.max("user_id") + 1).first()[0]
    snapshot = lambda detector: F.lit(f'{{"provider":"md5","model_name":"ArcFace","detector_backend":"{detector}"}}')
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", (F.col("vec_id") % users).alias("subject_id"), F.col("embedding").cast("array<double>").alias("embedding"),
        F.when(F.col("vec_id") % 5 == 0, snapshot("opencv")).when(F.col("vec_id") % 13 == 0, F.lit("{}")).otherwise(snapshot("retinaface")).alias("metadata"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("vec_id").cast("int"))).alias("validity_from"),
    ).where(F.col("subject_id") % 11 != 0)
    last = F.when(F.col("subject_id") % 7 == 0, F.col("validity_from") + F.expr("INTERVAL 1 DAY"))
    return intervals(rows).withColumn("validity_to", F.coalesce("validity_to", last))


# P: probe and stored vectors

P_SQL = """
SELECT event_id AS id, user_id AS subject_id, CAST(s.embedding AS DOUBLE[]) AS stored,
  list_transform(list_zip(CAST(s.embedding AS DOUBLE[]), CAST(o.embedding AS DOUBLE[])), lambda x: x[1] + (event_id % 5) * x[2]) AS probe
FROM events JOIN embeddings s ON s.vec_id = user_id JOIN embeddings o ON o.vec_id = event_id % (SELECT count(*) FROM embeddings)
"""


def probes_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, vectors = table(spark, sf_dir, "events"), table(spark, sf_dir, "embeddings")
    n = vectors.count()
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    rows = events.select(F.col("event_id").alias("id"), F.col("user_id").alias("subject_id"), (F.col("event_id") % n).alias("other_id"))
    rows = rows.join(v.withColumnsRenamed({"vec_id": "subject_id", "v": "stored"}), "subject_id").join(v.withColumnsRenamed({"vec_id": "other_id", "v": "other"}), "other_id")
    return rows.select("id", "subject_id", "stored", F.zip_with("stored", "other", lambda s, o: s + (F.col("id") % 5) * o).alias("probe"))


# D: photos; the test model maps bytes to 16 numbers from their md5


class Md5Embedder(Embedder):
    """(md5 byte - 128) / 128; raises where the length is a multiple of 29."""

    name = "md5"
    model_name = "md5"
    default_threshold = 0.3

    def __init__(self, **options):
        self.options = options

    def embed(self, images: list[bytes]) -> list[list[float] | Exception]:
        from hashlib import md5

        return [ValueError("unreadable image") if len(x) % 29 == 0 else [(b - 128) / 128.0 for b in md5(x).digest()] for x in images]


register("md5", Md5Embedder)


def md5_vector(text: Column) -> Column:
    """The test model's vector of a text, by column functions."""
    h = F.md5(text.cast("binary"))
    return F.transform(F.sequence(F.lit(1), F.lit(31), F.lit(2)), lambda k: (F.conv(F.substring(h, k, F.lit(2)), 16, 10).cast("double") - 128) / 128.0)


def md5_vector_sql(text: str) -> str:
    nibble = "instr('0123456789abcdef', substr(md5({t}), CAST({k} AS INTEGER), 1)) - 1"
    return f"list_transform(range(1, 32, 2), lambda k: (({nibble.format(t=text, k='k')}) * 16 + ({nibble.format(t=text, k='(k + 1)')}) - 128) / 128.0::DOUBLE)"


def photos_d(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").alias("subject_id"), F.when(F.col("doc_id") % 17 != 0, F.col("text").cast("binary")).alias("content"))


# V: frames, photos and stored embeddings for the whole verification, all from events and customers

V_TEXT = "'photo-' || CAST({k} AS VARCHAR) || repeat('x', CAST({k} % 7 AS INTEGER))"


def _photo_text(k: Column) -> Column:
    return F.concat(F.lit("photo-"), k.cast("string"), F.repeat(F.lit("x"), (k % 7).cast("int")))


def frames_v(events: DataFrame) -> DataFrame:
    """Every third frame shows the subject, the others somebody else; some can't be decoded."""
    text = _photo_text(F.when(F.col("event_id") % 3 == 0, F.col("user_id")).otherwise(F.col("event_id")))
    frame = F.concat(F.lit("data:image/jpeg;base64,"), F.base64(text.cast("binary")), F.when(F.col("event_id") % 31 == 0, F.lit("A")).otherwise(F.lit("")))
    code = F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("CL-"), F.col("event_id").cast("string")))
    return events.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("conn_id"), F.col("user_id").alias("subject_id"), "ts", frame.alias("frame"), code.alias("claim_code"),
        F.when(F.col("event_id") % 6 != 0, F.col("event_id") % 40).alias("service_id"), F.lit("gate").alias("step_name"), F.lit("").alias("device_id"),
    )


def photos_v(customer: DataFrame) -> DataFrame:
    """Photos of all customers but every 17th."""
    return customer.select(F.col("c_custkey").alias("subject_id"), F.when(F.col("c_custkey") % 17 != 0, _photo_text(F.col("c_custkey")).cast("binary")).alias("content"))


def embeddings_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The versions of E with the test model's vectors of the subjects' photos."""
    return embeddings_e(spark, sf_dir).withColumn("embedding", md5_vector(_photo_text(F.col("subject_id"))))


# M: raw messages


def _deflate(data: pa.Array) -> pa.Array:
    return pa.array([None if x is None else zlib.compress(x) for x in data.to_pylist()], pa.binary())


def deflate(data: Column) -> Column:
    return F.arrow_udf(_deflate, "binary")(data)


def messages_m(conversations: DataFrame) -> DataFrame:
    """conn_id, turn, ts, bytes, text: every third turn is compressed, every eleventh is broken."""
    frame = F.when(F.col("conv_id") % 9 != 0, F.concat(F.lit("data:image/jpeg;base64,"), F.base64(F.col("text").cast("binary"))))
    body = F.to_json(F.struct(F.when(F.col("role") == "user", "frame").otherwise("ping").alias("type"), F.concat(F.lit("S"), F.col("conv_id").cast("string")).alias("insuree_uuid"), frame.alias("frame")))
    body = F.when(F.col("turn") % 11 == 10, F.lit("not json")).otherwise(body)
    return conversations.select(
        F.col("conv_id").alias("conn_id"), "turn", (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("turn") * 3).cast("decimal(18,6)"))).alias("ts"),
        F.when(F.col("turn") % 3 == 0, deflate(body.cast("binary"))).alias("bytes"), F.when(F.col("turn") % 3 != 0, body).alias("text"),
    )


def messages_v(events: DataFrame) -> DataFrame:
    """The frames of V as messages: some without a frame, some broken, every third compressed."""
    rows = frames_v(events)
    frame = F.when(F.col("id") % 37 != 0, F.col("frame"))
    service = F.concat(F.lit("V"), F.col("service_id").cast("string"))
    body = F.to_json(F.struct(F.lit("frame").alias("type"), F.concat(F.lit("S"), F.col("subject_id").cast("string")).alias("insuree_uuid"), frame.alias("frame"), "claim_code", "step_name", service.alias("service_uuid"), "device_id"))
    body = F.when(F.col("id") % 41 == 0, F.lit("not json")).otherwise(body)
    return rows.select("conn_id", "id", "ts", F.when(F.col("id") % 3 == 0, deflate(body.cast("binary"))).alias("bytes"), F.when(F.col("id") % 3 != 0, body).alias("text"))


# H: change log of audits

H_SQL = f"""
SELECT id, claim_id, score_bp, '+' AS history_type, audit_date AS history_date, 1 AS history_id FROM ({A_SQL})
UNION ALL SELECT id, claim_id, score_bp + 1, '~', audit_date + INTERVAL 1 DAY, 2 FROM ({A_SQL}) WHERE score_bp > 5000
UNION ALL SELECT id, claim_id, score_bp, '-', audit_date + INTERVAL 2 DAY, 3 FROM ({A_SQL}) WHERE is_deleted
"""


def history_h(lineitem: DataFrame) -> DataFrame:
    day = lambda n: F.expr(f"INTERVAL {n} DAY")
    change = lambda kind, score, date, n: F.struct(score.alias("score_bp"), F.lit(kind).alias("history_type"), date.alias("history_date"), F.lit(n).alias("history_id"))
    date, bp = F.col("audit_date"), F.col("score_bp")
    steps = F.array(change("+", bp, date, 1), F.when(bp > 5000, change("~", bp + 1, date + day(1), 2)), F.when(F.col("is_deleted"), change("-", bp, date + day(2), 3)))
    return audits_a(lineitem).select("id", "claim_id", F.explode(F.filter(steps, lambda s: s.isNotNull())).alias("h")).select("id", "claim_id", "h.*")
