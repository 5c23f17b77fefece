"""Greedy sampling of a stream of frames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.sampling import greedy

#: How late a frame may be, and after how many seconds without one a connection is over.
LATE = "10 minutes"
IDLE_SECONDS = 3600.0


#: Connections share this many states, so that the cost of a call of Python is shared, too.
BUCKETS = 1024
#: A bucket's state: by connection the last time that passed, frames received, frames passed, its newest frame.
STATE = "conns array<string>, last array<long>, frames array<long>, passed array<long>, newest array<long>"


def frame_sampler(interval: int, idle: int, names: list[str]) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """The work on the new frames of a bucket of connections.

    After idle microseconds without a frame (0: never) a connection is over: it is dropped when its
    bucket is next touched, or with the whole bucket once all of it is over; a frame that comes
    later than idle starts a new connection in any case.
    """

    def run(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known, *held = state.get if state.exists else ([], [], [], [], [])
        # a bucket's rows may come in several chunks, in any order; they are pointers, not frames
        chunk = pd.concat(list(rows), ignore_index=True)
        codes, conns = pd.factorize(np.array([*known, *chunk["conn_id"]], object), use_na_sentinel=False)
        codes = codes[len(known):]
        last, frames, passed, newest = (np.concatenate([np.array(h, np.int64), np.full(len(conns) - len(known), k)]) for h, k in zip(held, (-1, 0, 0, -1)))
        order = np.lexsort((chunk["id"].to_numpy(), chunk["micros"].to_numpy(), codes))
        codes, micros, usable = codes[order], chunk["micros"].to_numpy(np.int64)[order], chunk["error"].isna().to_numpy()[order]
        # runs of frames: of a connection, cut where it was idle
        first = np.diff(codes, prepend=-1) != 0
        before = np.where(first, np.where(newest[codes] >= 0, newest[codes], micros), np.roll(micros, 1))
        anew = micros - before > idle if idle else np.zeros(len(codes), bool)
        starts = np.flatnonzero(first | anew)
        stops, who = np.append(starts[1:], len(codes)), codes[starts]
        goes_on = ~anew[starts]
        had_last, had_frames, had_passed = np.where(goes_on, last[who], -1), np.where(goes_on, frames[who], 0), np.where(goes_on, passed[who], 0)
        mark = np.zeros(len(codes), np.int64)
        for k, (a, b) in enumerate(zip(starts.tolist(), stops.tolist())):
            place = a + np.flatnonzero(usable[a:b])
            at = place[greedy(micros[place], interval, None if had_last[k] < 0 else int(had_last[k]))]
            if len(at):
                mark[at], had_last[k] = 1, micros[at[-1]]
        sizes, done = stops - starts, np.cumsum(mark)
        received = np.repeat(had_frames - starts, sizes) + np.arange(1, len(codes) + 1)
        verified = np.repeat(had_passed - (done[starts] - mark[starts]), sizes) + done
        # a connection's last run is what it goes on from
        ends = np.append(who[1:] != who[:-1], True)
        who, stops = who[ends], stops[ends] - 1
        last[who], frames[who], passed[who], newest[who] = had_last[ends], received[stops], verified[stops], np.maximum(newest[who], micros[stops])
        due = (newest + idle) // 1000 + 1
        stay = due > state.getCurrentWatermarkMs() if idle else np.ones(len(conns), bool)
        if stay.any():
            state.update(([c if isinstance(c, str) else None for c in conns[stay]], *(x[stay].tolist() for x in (last, frames, passed, newest))))
            if idle:
                state.setTimeoutTimestamp(int(due[stay].max()))
        else:
            state.remove()
        out = np.flatnonzero(~usable | (mark > 0))
        if len(out):
            chosen = chunk.iloc[order[out]].assign(frame_count=received[out], verification_count=verified[out])
            yield chosen[names].reset_index(drop=True)

    return run


def sample_stream(frames: DataFrame, seconds: float = 5.0, carry: list[str] | None = None, late: str = LATE, idle_seconds: float | None = IDLE_SECONDS, buckets: int = BUCKETS) -> DataFrame:
    """conn_id, id, frame_count, verification_count (and ts, error and the columns carry) of the frames that pass, for a stream with conn_id, id, ts.

    Rows whose column error (optional) isn't null are counted and come out, but never take a
    connection's turn. A frame older than its connection's last passed one doesn't pass, one later
    than late is dropped, and a connection without a frame for idle_seconds is over: a frame that
    comes then starts a new one. Without idle_seconds connections never end. A frame without a time
    has no place among the others: it never reaches the state and is left out (no_time gives those).
    A task holds one micro-batch's rows of a bucket of connections, so carry pointers rather than
    payloads. buckets is fixed by the checkpoint's first batch: a micro-batch rewrites the states of
    the buckets that it touches. The RocksDB state store keeps states on disk.
    """
    frames = frames.where(F.col("ts").isNotNull())
    error = F.col("error") if "error" in frames.columns else F.lit(None)
    extra = ["ts", "error", *carry] if carry is not None else []
    ts = F.col("ts").cast("timestamp")
    slim = frames.select(F.col("conn_id").cast("string").alias("conn_id"), F.col("id").cast("long").alias("id"), ts.alias("ts"), F.unix_micros(ts).alias("micros"), error.cast("string").alias("error"), *(carry or []))
    kinds = dict(slim.dtypes)
    names = ["conn_id", "id", "frame_count", "verification_count", *extra]
    schema = ", ".join(f"{c} {kinds.get(c, 'bigint')}" for c in names)
    sampler = frame_sampler(int(seconds * 1_000_000), int((idle_seconds or 0) * 1_000_000), names)
    slim = slim.withColumn("__bucket", F.pmod(F.xxhash64("conn_id"), F.lit(buckets)))
    if not idle_seconds:
        return slim.groupBy("__bucket").applyInPandasWithState(sampler, schema, STATE, "append", GroupStateTimeout.NoTimeout)
    return slim.withWatermark("ts", late).groupBy("__bucket").applyInPandasWithState(sampler, schema, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def no_time(frames: DataFrame) -> DataFrame:
    """The frames without a time, with an error; their counts are null."""
    return frames.where(F.col("ts").isNull()).withColumns({"error": F.coalesce("error", F.lit("the frame has no time")), "frame_count": F.lit(None).cast("long"), "verification_count": F.lit(None).cast("long")})
