"""Messages of the frame stream in, result messages out."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fields of a frame message.
FRAME_SCHEMA = "type string, insuree_uuid string, frame string, claim_code string, step_name string, service_uuid string, device_id string"


#: Bytes that a message may inflate to unless another bound is given; a longer one has a status of its own.
MAX_INFLATED = 64 << 20
#: What an absent field becomes.
ABSENT = {"step_name": "unknown", "device_id": ""}
#: What a client is told about a message that can't be read.
UNREADABLE = {"empty": "the message has neither text nor bytes", "invalid": "the message is not a JSON object", "too_large": "the message is too large"}


def inflate(data: Column, limit: int = MAX_INFLATED) -> Column:
    """struct<body, too_large>: zlib data inflated, anything else as it is; no body beyond limit bytes. Spark has no built-in for this."""

    @F.arrow_udf("struct<body: binary, too_large: boolean>")
    def run(data: pa.Array) -> pa.Array:
        def one(x: bytes | None) -> tuple[bytes | None, bool]:
            if not x:
                return x, False
            try:
                stream = zlib.decompressobj()
                out = stream.decompress(x, limit + 1)
            except zlib.error:
                return x, False
            return (None, True) if len(out) > limit else (out, False) if stream.eof else (x, False)

        found = [one(x) for x in data.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.bool_())], names=["body", "too_large"])

    return run(data)


def read_messages(raw: DataFrame, max_inflated: int = MAX_INFLATED) -> DataFrame:
    """raw (columns bytes and text; others stay) with status and the message's fields, in one pass.

    status is 'frame', 'unknown' (another type), 'empty', 'invalid' or 'too_large'. The JSON comes
    from the bytes if there are any, inflated where they are zlib data, else from the text. Works on
    streams too.
    """
    rows = raw.withColumn("__in", inflate(F.col("bytes"), max_inflated))
    sent = F.when(F.octet_length("bytes") > 0, F.try_validate_utf8(F.col("__in.body").cast("string"))).otherwise(F.nullif(F.col("text"), F.lit("")))
    rows = rows.withColumn("__body", sent).withColumns({"__m": F.from_json("__body", FRAME_SCHEMA), "__v": F.try_parse_json("__body")})
    nothing = F.coalesce(F.octet_length("bytes"), F.lit(0)) + F.coalesce(F.octet_length("text"), F.lit(0)) == 0
    broken = F.col("__v").isNull() | ~F.col("__body").startswith("{")
    status = F.when(nothing, "empty").when(F.col("__in.too_large"), "too_large").when(broken, "invalid").when(F.col("__m.type") == "frame", "frame").otherwise("unknown")
    field = lambda c: F.col("__m")[c]
    # only an absent key takes the default; an explicit null stays
    absent = {c: F.when((status == "frame") & F.try_variant_get("__v", f"$.{c}", "variant").isNull(), F.lit(v)).otherwise(field(c)).alias(c) for c, v in ABSENT.items()}
    names = [f.split()[0] for f in FRAME_SCHEMA.split(", ")]
    return rows.select(*raw.columns, status.alias("status"), *(absent.get(c, field(c).alias(c)) for c in names))


def route_messages(raw: DataFrame, max_inflated: int = MAX_INFLATED) -> DataFrame:
    """read_messages with error: what the client is told about a broken message or a frame that lacks fields; null where all is well.

    Written by one writer partitioned by status, all outputs come from one pass: frames, unknown
    types, and broken messages with their replies.
    """
    rows = read_messages(raw, max_inflated)
    told = F.create_map(*(F.lit(x) for pair in UNREADABLE.items() for x in pair))
    lacking = F.when(F.coalesce("insuree_uuid", F.lit("")) == "", "missing: insuree_uuid").when(F.coalesce("frame", F.lit("")) == "", "missing: frame")
    return rows.withColumn("error", F.when(F.col("status") == "frame", lacking).otherwise(F.try_element_at(told, F.col("status"))))


def parse_frames(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(frames, unknown types, dead letters) from rows with columns bytes and text; other columns stay."""
    return split_messages(read_messages(raw))


def split_messages(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(frames, unknown types, dead letters) of read_messages, whose checkpoint makes it one pass for all three.

    A dead letter has parse_error 'empty', 'invalid' or 'too_large'.
    """
    names = [f.split()[0] for f in FRAME_SCHEMA.split(", ")]
    good = rows.drop("bytes", "text")
    dead = rows.where(F.col("status").isin(*UNREADABLE)).withColumnRenamed("status", "parse_error").drop(*names)
    return good.where("status = 'frame'").drop("status"), good.where("status = 'unknown'").drop("status"), dead


def format_results(results: DataFrame, keep_cols: list[str] | None = None) -> DataFrame:
    """value (and keep_cols): one JSON message per result, nulls kept; a result without a verdict becomes an error message."""
    names = ["verified", "confidence", "distance", "provider", "error", "verification_count", "frame_count", "timestamp", "audit_uuid"]
    message = F.struct(F.lit("verification_result").alias("type"), *(F.col(n) if n in results.columns else F.lit(None).cast("string").alias(n) for n in names))
    failed = F.struct(F.lit("error").alias("type"), F.col("error").alias("message"))
    keep = {"ignoreNullFields": "false"}
    return results.select(*(keep_cols or []), F.when(F.col("verified").isNull(), F.to_json(failed, keep)).otherwise(F.to_json(message, keep)).alias("value"))
