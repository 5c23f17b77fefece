"""Versioned rows and change logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def supersede(existing: DataFrame, new: DataFrame, now: Column, key: str = "subject_id") -> DataFrame:
    """existing with the active row of each key in new closed at now, and new's rows active from now.

    new holds successes only, so a failed refresh leaves the old row active. Of several rows of one
    key in new, the one with the largest hash is taken, so a key has one active row at most.
    """
    rest = [c for c in new.columns if c != key]
    row = F.struct(*rest)
    new = new.groupBy(key).agg(F.max_by(row, F.xxhash64(*rest)).alias("r")).select(key, "r.*") if rest else new.distinct()
    fresh = new.select(key).distinct().withColumn("__new", F.lit(True))
    closed = existing.join(fresh, key, "left").withColumn("validity_to", F.when(F.col("__new") & F.col("validity_to").isNull(), now).otherwise(F.col("validity_to"))).drop("__new")
    kind = dict(existing.dtypes)["validity_to"]
    return closed.unionByName(new.withColumns({"validity_from": now, "validity_to": F.lit(None).cast(kind)}))


def intervals(versions: DataFrame, key: str = "subject_id") -> DataFrame:
    """A log of versions with validity_to from the next version's start."""
    return versions.withColumn("validity_to", F.lead("validity_from").over(Window.partitionBy(key).orderBy("validity_from")))


def with_versions(existing: DataFrame, log: DataFrame, key: str = "subject_id", order: str = "validity_from") -> DataFrame:
    """existing with the versions that a log added later, in order of a column of it; an open row ends where its key's next version starts.

    A version never starts before the one that it follows, also when its own time is earlier (it
    came late), so the last one added is the open one.
    """
    kind = dict(existing.dtypes)["validity_to"]
    old = existing.withColumns({"__added": F.lit(0), "__order": F.lit(None).cast(dict(log.dtypes)[order])})
    new = log.withColumns({"__added": F.lit(1), "__order": F.col(order), "validity_to": F.lit(None).cast(kind)})
    w = Window.partitionBy(key).orderBy("__added", "__order", "validity_from")
    start = F.max("validity_from").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = old.unionByName(new.select(*old.columns)).withColumn("validity_from", F.when(F.col("__added") == 1, start).otherwise(F.col("validity_from")))
    return rows.withColumn("validity_to", F.coalesce("validity_to", F.lead("validity_from").over(w))).drop("__added", "__order")


def latest_from_history(history: DataFrame, as_of: Column | None = None, key: str = "id") -> DataFrame:
    """The state of each id after its last change; deleted ids are gone.

    The latest change is an aggregate, so a long history collapses before the shuffle.
    """
    if as_of is not None:
        history = history.where(F.col("history_date") <= as_of)
    row = F.struct(*(c for c in history.columns if c != key))
    last = history.groupBy(key).agg(F.max_by(row, F.struct("history_date", "history_id")).alias("r"))
    return last.select(key, "r.*").where(F.col("history_type") != "-")
