"""Greedy sampling of frames: the first passes, then each that is an interval after the last that passed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import running_sums


def greedy(micros: np.ndarray, interval: int, last: int | None) -> list[int]:
    """Positions that pass in ascending whole times, given the last one that passed before."""
    if micros.dtype.kind not in "iu" or interval <= 0:
        raise TypeError("times and the interval must be whole microseconds, the interval more than none")
    out, at = [], 0
    if last is not None:
        at = int(np.searchsorted(micros, last + interval))
    after = np.searchsorted(micros, micros + interval).tolist()  # whom each would let pass next, in one call
    while at < len(after):
        out.append(at)
        at = after[at]
    return out


def sample_frames(frames: DataFrame, seconds: float = 5.0, key: str = "conn_id", ts: str = "ts", id_col: str = "id") -> DataFrame:
    """The rows of frames that pass.

    Ids are dealt by connection and sorted by Spark; a task walks its sorted rows and holds one
    batch and one connection's last time, however long a connection is. Payloads are joined back on
    connection, time and id, so ids need to be unique only among a connection's frames of one time;
    rows that repeat all three are one frame. A frame without a time doesn't pass.
    """
    interval = int(seconds * 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conn, last = None, None
        for batch in batches:
            keys, micros = batch.column("k").to_pylist(), batch.column("t").to_numpy()
            start, passed = 0, []
            while start < len(keys):
                stop = start + 1
                while stop < len(keys) and keys[stop] == keys[start]:
                    stop += 1
                if keys[start] != conn:
                    conn, last = keys[start], None
                found = [start + p for p in greedy(micros[start:stop], interval, last)]
                if found:
                    last = int(micros[found[-1]])
                passed += found
                start = stop
            yield batch.take(pa.array(passed, pa.int64()))

    slim = _slim(frames, key, ts, id_col)
    passed = slim.where("t IS NOT NULL").repartition("k").sortWithinPartitions("k", "t", "i").mapInArrow(run, f"k string, t long, i {dict(frames.dtypes)[id_col]}")
    return frames.join(passed, _same(frames, passed, key, ts, id_col), "left_semi").dropDuplicates([key, ts, id_col])


def _slim(frames: DataFrame, key: str, ts: str, id_col: str) -> DataFrame:
    return frames.select(F.col(key).cast("string").alias("k"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(id_col).alias("i"))


def _same(frames: DataFrame, slim: DataFrame, key: str, ts: str, id_col: str) -> Column:
    return F.col(key).cast("string").eqNullSafe(slim["k"]) & (F.unix_micros(F.col(ts).cast("timestamp")) == slim["t"]) & F.col(id_col).eqNullSafe(slim["i"])


def number_verifications(frames: DataFrame, sampled: DataFrame, key: str = "conn_id", ts: str = "ts", id_col: str = "id") -> DataFrame:
    """frames with frame_count and verification_count as each sampled frame saw them; only sampled rows.

    Both counts are running sums over range-sorted frames without payloads, so a connection with
    half of all frames is spread over tasks. Frames without a time come first and are never sampled;
    of rows that repeat connection, time and id each counts, and they have the counts of the last.
    """
    chosen = _slim(sampled, key, ts, id_col).dropDuplicates().withColumn("__s", F.lit(1))
    slim = _slim(frames, key, ts, id_col)
    equal = slim["k"].eqNullSafe(chosen["k"]) & (slim["t"] == chosen["t"]) & slim["i"].eqNullSafe(chosen["i"])
    marks = slim.join(chosen, equal, "left").select(slim["k"], slim["t"], slim["i"], F.coalesce("__s", F.lit(0)).alias("__s"))
    counted = running_sums(marks, "k", ["t", "i"], {"frame_count": F.lit(1), "verification_count": F.col("__s")}).where("__s = 1")
    found = counted.groupBy("k", "t", "i").agg(F.max("frame_count").alias("frame_count"), F.max("verification_count").alias("verification_count"))
    return frames.join(found, _same(frames, found, key, ts, id_col)).drop(found["k"], found["t"], found["i"])


def connection_stats(frames: DataFrame, verified: DataFrame, key: str = "conn_id") -> DataFrame:
    """conn_id, frames, verifications per connection."""
    got = frames.groupBy(key).agg(F.count("*").alias("frames"))
    done = verified.groupBy(key).agg(F.count("*").alias("verifications"))
    return got.join(done, key, "left").na.fill(0, ["verifications"])
