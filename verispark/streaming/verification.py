"""The verification job: frame messages in; results, audits, risks, stored embeddings and replies out.

Messages are landed first: parsed once and written to an inbox, routed by their status, with exactly
once semantics. The job reads only pointers from there: connection, time, id, and the file and row
where a frame lies. They go through the connections' state; the frames that pass are fetched from
their files inside the micro-batch. So no image is in any state or shuffle, and the inbox's files
are deleted once the batch that used them is stored.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import VerifyConfig
from ..operators.history import with_versions
from ..operators.validate import active
from ..plans.verify import audit_id, audits_from_results, verify
from ..sources.messages import MAX_INFLATED, format_results, route_messages
from ..storage import SharedFiles
from ..tables import BUCKETS, BatchTable
from .risk import store_and_score
from .sampling import IDLE_SECONDS, LATE, no_time, sample_stream

#: What a frame brings along to its verification.
CARRY = ["insuree_uuid", "frame", "claim_code", "step_name", "service_uuid", "device_id"]
#: Files of the inbox that a micro-batch takes at most.
MAX_FILES = 64
#: Pointers of a micro-batch that are broadcast to the files with the frames: some 100 bytes each. Beyond, frames are shuffled.
MAX_POINTERS = 200_000


class EmbeddingStore:
    """Stored embeddings of the subjects, kept by the job: the last version of each, by subject, and a log of all versions.

    The last versions lie in buckets, so a micro-batch opens those of its subjects only. The store
    starts from a table of embeddings and is the truth from then on; others that make embeddings
    write them with put.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.last = BatchTable(spark, f"{path}/embeddings", key="subject_id", buckets=buckets)
        self.log = BatchTable(spark, f"{path}/embedding_versions")

    def start(self, embeddings: DataFrame) -> None:
        """Take over a table of versions, once."""
        if not self.log.exists():
            self.log.write(embeddings, -1)
        if not self.last.exists():
            row = F.struct(*(c for c in embeddings.columns if c != "subject_id"))
            # the open version, else the latest
            self.last.write(embeddings.groupBy("subject_id").agg(F.max_by(row, F.struct(F.col("validity_to").isNull(), "validity_from")).alias("r")).select("subject_id", "r.*"), -1)

    def of(self, subjects: DataFrame, n: int | None = None) -> DataFrame:
        """The last version of some subjects, before batch n."""
        return self.last.read(before=n, of=subjects)

    def put(self, new: DataFrame, n: int) -> None:
        """Store new versions (subject_id, embedding, metadata, validity_from) as batch n.

        A version never starts before the one that it follows, also where its frame came late.
        """
        before = self.of(new, n).select("subject_id", F.col("validity_from").alias("__from"))
        kinds = dict(self.last.read(before=n).dtypes)
        rows = new.join(before, "subject_id", "left").withColumn("validity_from", F.greatest(F.col("validity_from").cast(kinds["validity_from"]), F.col("__from")))
        rows = rows.select(*(F.col(c).cast(kinds[c]) if c in new.columns else F.lit(None).cast(kinds[c]).alias(c) for c in kinds))
        self.last.write(rows, n)
        self.log.write(self.last.batch(n), n)

    def versions(self) -> DataFrame:
        """All versions with the times when they were valid."""
        rows = self.log.read(with_batch=True)
        return with_versions(rows.where("batch < 0").drop("batch"), rows.where("batch >= 0"), order="batch").select(*(c for c in rows.columns if c != "batch"))


def land_messages(messages: DataFrame, inbox: str, checkpoint: str, available_now: bool = True, max_inflated: int = MAX_INFLATED) -> StreamingQuery:
    """Write a stream of messages (conn_id, id, ts, bytes, text) to an inbox, partitioned by status: frames, unknown types, broken messages."""
    rows = route_messages(messages, max_inflated).drop("bytes", "text", "type")
    writer = rows.writeStream.format("parquet").partitionBy("status").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start(inbox)


def _pointers(landed: DataFrame) -> DataFrame:
    """What of a landed message goes through the job: no field of it."""
    ts = F.col("ts").cast("timestamp")
    return landed.select("conn_id", "id", ts.alias("ts"), "status", "error", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


class Inbox:
    """The files that micro-batches took; those of the batches before are deleted."""

    def __init__(self, spark: SparkSession, out: str):
        self.spark, self.notes = spark, SharedFiles(spark, f"{out}/taken")

    def take(self, files: list[str], n: int) -> None:
        """Note the files of batch n; once it begins, the earlier batches are stored, so their files go."""
        for name in self.notes.names():
            if name.endswith(".json") and int(name[:-5]) < n:
                for file in json.loads(self.notes.read(name)):
                    path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
                    path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, False)
                self.notes.delete(name)
        if f"{n}.json" not in self.notes.names():
            self.notes.write(f"{n}.json", json.dumps(files))


class Job:
    """A running job: its landing and its verification."""

    def __init__(self, landing: StreamingQuery, verifying: StreamingQuery):
        self.queries = landing, verifying

    def awaitTermination(self) -> None:  # noqa: N802
        for query in self.queries:
            query.awaitTermination()

    def stop(self) -> None:
        for query in self.queries:
            query.stop()


def verify_landed(spark: SparkSession, inbox: str, kinds: str, tables: Callable[[SparkSession], dict[str, DataFrame]], cfg: VerifyConfig, out: str, checkpoint: str, late: str = LATE, idle_seconds: float | None = IDLE_SECONDS, available_now: bool = True, max_files: int = MAX_FILES, buckets: int = BUCKETS, keep_inbox: bool = False) -> StreamingQuery:
    """Verify the messages of an inbox; kinds has the types of conn_id and id.

    tables gives subjects, photos, claims and services anew for each micro-batch, and embeddings,
    which the store takes over at the first one. Broken messages, frames that lack fields and frames
    without a time become error results; the others are sampled per connection before any inference.
    Each micro-batch writes tables under out (tables.BatchTable), so that a repeated batch replaces
    its rows: results, messages (value: JSON for the client), audits, sums (for risks), embeddings
    and embedding_versions. Subjects have insuree_uuid, services service_uuid. No image is stored
    there, and the inbox's files go once they are used, unless keep_inbox. A batch without rows
    writes nothing.
    """
    schema = f"{kinds}, ts timestamp, {', '.join(f'{c} string' for c in CARRY)}, error string, status string"
    landed = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(inbox)
    rows = _pointers(landed)
    frames = rows.where("status = 'frame'")
    columns = ["conn_id", "id", "ts", "frame_count", "verification_count", "error", "file", "row"]
    nothing = {"frame_count": F.lit(None).cast("long"), "verification_count": F.lit(None).cast("long")}
    sampled = sample_stream(frames.drop("status"), cfg.sampling_seconds, ["file", "row"], late, idle_seconds).select(*columns)
    as_sampled = lambda df: df.select(F.col("conn_id").cast("string").alias("conn_id"), F.col("id").cast("long").alias("id"), *columns[2:])
    untimed = as_sampled(no_time(frames))
    broken = as_sampled(rows.where("status <> 'frame' AND error IS NOT NULL").withColumns(nothing))
    # each file once, so that it can be fetched from and deleted
    files = as_sampled(rows.where(F.col("row") == 0).withColumns(nothing | {"conn_id": F.lit(None).cast("string"), "error": F.lit(None).cast("string"), "row": F.lit(-1).cast("long")}))
    store = EmbeddingStore(spark, out, buckets)
    taken = Inbox(spark, out)

    def fetched(batch: DataFrame, paths: list[str]) -> DataFrame:
        """The rows that passed with their messages' fields."""
        good = batch.where("error IS NULL AND row >= 0").drop("error")
        good = F.broadcast(good) if good.count() <= MAX_POINTERS else good
        held = batch.sparkSession.read.schema(schema).parquet(*paths) if paths else batch.sparkSession.createDataFrame([], schema)
        where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")] if paths else [F.lit("").alias("file"), F.lit(0).cast("long").alias("row")]
        return held.select(*CARRY, *where).join(good, ["file", "row"]).drop("file", "row")

    def each(batch: DataFrame, n: int) -> None:
        session = batch.sparkSession
        batch.persist()  # pointers; it is read several times, and comes out of the connections' state
        kept = [batch]
        try:
            if batch.isEmpty():
                return
            paths = [unquote(r[0]) for r in batch.where("row = -1").select("file").distinct().collect()]  # at most max_files
            if not keep_inbox:
                taken.take(paths, n)
            t = tables(session)
            store.start(t["embeddings"])
            people = active(t["subjects"]).select("insuree_uuid", "subject_id")
            good = fetched(batch, paths).join(people, "insuree_uuid", "left")
            # the batch's subjects are looked for once
            ids = good.where("subject_id IS NOT NULL").select("subject_id").distinct().persist()
            kept.append(ids)
            found, new = verify(good, t["subjects"], store.of(ids, n), t["photos"], cfg, ids=ids)
            now = found.agg(F.max("ts")).first()[0]
            store.put(new.withColumn("validity_from", F.lit(now).cast("timestamp_ntz")), n)
            audits = audits_from_results(found, t["claims"], t["services"], cfg, "service_uuid")
            stored = store_and_score(audits, out, n)
            # what has no verdict becomes an error message
            failed = batch.where("error IS NOT NULL").drop("file", "row")
            results = found.withColumn("__id", audit_id()).join(stored.select(F.col("id").alias("audit_uuid")), F.col("__id") == F.col("audit_uuid"), "left").drop("__id").unionByName(failed, allowMissingColumns=True)
            table = BatchTable(session, f"{out}/results")
            table.write(results, n)
            written = table.batch(n).withColumn("timestamp", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
            BatchTable(session, f"{out}/messages").write(format_results(written, ["conn_id"]), n)
        finally:
            for df in kept:
                df.unpersist()

    writer = sampled.unionByName(untimed).unionByName(broken).unionByName(files).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def verify_stream(messages: DataFrame, tables: Callable[[SparkSession], dict[str, DataFrame]], cfg: VerifyConfig, out: str, checkpoint: str, late: str = LATE, idle_seconds: float | None = IDLE_SECONDS, available_now: bool = True, max_inflated: int = MAX_INFLATED, **options) -> Job:
    """Land a stream of messages (conn_id, id, ts, bytes, text) under out/inbox and verify them as verify_landed says.

    With available_now everything that is there is landed first, then verified; else both run.
    """
    spark, inbox = messages.sparkSession, f"{out}/inbox"
    SharedFiles(spark, inbox).make()
    landing = land_messages(messages, inbox, f"{checkpoint}/landing", available_now, max_inflated)
    if available_now:
        landing.awaitTermination()
    types = dict(messages.dtypes)
    kinds = f"conn_id {types['conn_id']}, id {types['id']}"
    return Job(landing, verify_landed(spark, inbox, kinds, tables, cfg, out, f"{checkpoint}/verification", late, idle_seconds, available_now, **options))
