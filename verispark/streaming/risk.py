"""Risk of claims kept current by a stream of audits.

What is stored is a change log: four sums and the last date of each claim that a micro-batch touches
(tables.BatchTable, by claim). Risks are computed from the last sums when they are read, and merged
into whatever a claim's JSON is then, so nobody's edit of a claim is lost and no claim is rewritten.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.claims import merge_claim_ext, unmerged_claims
from ..operators.risk import claim_sums, risk_of_sums
from ..plans.insert import check_audits, split_audits
from ..sources.audits import append_audits, audit_table
from ..storage import SharedFiles
from ..tables import BatchTable

log = logging.getLogger(__name__)


def sums_table(spark: SparkSession, path: str) -> BatchTable:
    """The last sums of each claim."""
    return BatchTable(spark, path, key="claim_id")


def current_risk(spark: SparkSession, path: str, claims: DataFrame | None = None) -> DataFrame:
    """claim_id, last_updated and the columns of claim_risk, by the last sums under path; of some claims only if they are given."""
    return risk_of_sums(sums_table(spark, path).read(of=claims), ["claim_id", "last_updated"])


def current_claims(claims: DataFrame, path: str) -> DataFrame:
    """claims as they are now with their current risk in json_ext.

    A claim whose json_ext isn't a JSON object stays as it is; each is logged by log_unmerged.
    """
    return merge_claim_ext(claims, current_risk(claims.sparkSession, path))


def log_unmerged(claims: DataFrame, path: str) -> DataFrame:
    """claim_id, error of the claims that can't take their risk, logged by their number."""
    found = unmerged_claims(claims, current_risk(claims.sparkSession, path))
    if n := found.count():
        log.error("%d claims can't take their risk: json_ext isn't a JSON object", n)
    return found


def store_stream(audits: DataFrame, audits_path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Each micro-batch of audits is stored under its id, so a repeated batch replaces its rows."""
    writer = audits.writeStream.foreachBatch(lambda batch, n: append_audits(batch, audits_path, n)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def risk_stream(audits: DataFrame, path: str, checkpoint: str, available_now: bool = True, raise_errors: bool = False) -> StreamingQuery:
    """The sums of every claim that a micro-batch touches.

    The table of sums is the stream's state as well, so a batch opens the buckets that it touches
    and no state store holds the claims in memory. It is a query of its own beside store_stream, so
    audits stay whatever happens here; the sums of a batch that can't be added are kept beside the
    checkpoint's files, and the next batch that can be adds them too.
    """

    def each(batch: DataFrame, n: int) -> None:
        late_sums = BatchTable(batch.sparkSession, f"{checkpoint}/unscored/sums")

        def add(late: list[int]) -> None:
            add_sums(batch, path, n, late_sums.read(with_batch=True).where(F.col("batch").isin(late)).drop("batch") if late else None)

        if not _score(SharedFiles(batch.sparkSession, f"{checkpoint}/unscored/notes"), n, add, raise_errors):
            late_sums.write(claim_sums(batch, last_updated=True), n)

    # a micro-batch's plan is fixed when each gets it, so columns are pruned here
    scored = audits.select("claim_id", "similarity_score", "is_verified", "audit_date")
    writer = scored.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _total(sums: DataFrame) -> DataFrame:
    """One row of claim_sums for each claim of several."""
    return sums.groupBy("claim_id").agg(*(F.sum(c).alias(c) for c in ("n", "failed", "s1", "s2")), F.max("last_updated").alias("last_updated"))


def add_sums(audits: DataFrame, path: str, n: int, late: DataFrame | None = None) -> None:
    """Add the audits of batch n, and late sums, to the sums of their claims; a repeated batch starts from the sums before it."""
    fresh, table = claim_sums(audits, last_updated=True), sums_table(audits.sparkSession, path)
    if late is not None:
        fresh = _total(fresh.unionByName(late))
    if not table.exists():
        table.write(fresh, n, unique=True)
        return
    fresh = fresh.persist(StorageLevel.DISK_ONLY)  # it chooses the buckets, then the claims, and is added
    try:
        table.write(_total(table.read(before=n, of=fresh).unionByName(fresh)), n, unique=True)
    finally:
        fresh.unpersist()


def _score(notes: SharedFiles, n: int, add: Callable[[list[int]], None], raise_errors: bool = False) -> bool:
    """Whether add could add batch n and the earlier batches that it is given; an error is logged and noted."""
    # a note k says that batch k isn't scored yet, k.by.n that batch n has added it; that one may be repeated
    names = notes.names()
    late = sorted({int(x.split(".")[0]) for x in names if x.lstrip("-").isdigit() or x.endswith(f".by.{n}")} - {n})
    try:
        add(late)
    except Exception:
        if raise_errors:
            raise
        log.exception("risk of micro-batch %d", n)
        if str(n) not in names:
            notes.write(str(n), "")
        return False
    for k in late:
        if f"{k}.by.{n}" not in names:
            notes.write(f"{k}.by.{n}", "")
    for x in names:
        if x in map(str, [*late, n]) or (".by." in x and int(x.rsplit(".", 1)[1]) < n):
            notes.delete(x)
    return True


def store_and_score(audits: DataFrame, out: str, n: int) -> DataFrame:
    """Store the audits of batch n under out/audits and add them to out/sums; gives the stored audits back.

    An error in scoring is logged and never costs an audit: the batch is noted, and the next batch
    that can be scored adds its audits too.
    """
    spark = audits.sparkSession
    append_audits(audits, f"{out}/audits", n)
    table = audit_table(spark, f"{out}/audits")
    stored = table.batch(n)
    # all audits are read only where earlier batches must be added
    _score(SharedFiles(spark, f"{out}/unscored"), n, lambda late: add_sums(table.read(with_batch=True).where(F.col("batch").isin([*late, n])) if late else stored, f"{out}/sums", n))
    return stored


def insert_stream(requests: DataFrame, tables, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Audit requests as a stream: each micro-batch is checked, stored and scored.

    tables(spark) gives claims and services anew for each micro-batch. Under out: audits, sums and
    rejected (id, error), each by batch, so a repeated batch replaces its rows.
    """

    def each(batch: DataFrame, n: int) -> None:
        if batch.isEmpty():
            return
        t = tables(batch.sparkSession)
        checked, broken = check_audits(batch, t["claims"], t["services"])
        checked.persist(StorageLevel.DISK_ONLY)  # looked up once for both tables, so they agree
        try:
            good, bad = split_audits(checked, broken)
            BatchTable(batch.sparkSession, f"{out}/rejected").write(bad, n)
            store_and_score(good, out, n)
        finally:
            checked.unpersist()

    writer = requests.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
