"""Keeping stored embeddings current."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import VerifyConfig
from ..functions.snapshot import is_stale
from ..operators.history import supersede
from ..operators.validate import active
from ..storage import checkpointed
from ..tables import BatchTable
from .embedder import embed


def embed_photos(photos: DataFrame, cfg: VerifyConfig) -> DataFrame:
    """subject_id, embedding, error of each photo; a photo without bytes is an error."""
    rows = photos.select("subject_id", F.col("content").isNull().alias("__none"), embed(F.col("content"), cfg).alias("__e"))
    return rows.select("subject_id", F.col("__e.embedding").alias("embedding"), F.when(F.col("__none"), F.lit("no photo")).otherwise(F.col("__e.error")).alias("error"))


def store_embeddings(embeddings: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """The table of embeddings after storing new ones (subject_id, embedding, metadata): old rows are closed at now."""
    kinds = dict(embeddings.dtypes)
    for c in embeddings.columns:
        if c not in new.columns and c not in ("validity_from", "validity_to"):
            new = new.withColumn(c, F.lit(None).cast(kinds[c]))
    return supersede(embeddings, new, now)


#: Parts of a resumable run: what a stopped run loses at most is one of them.
PARTS = 64


def embed_in_parts(people: DataFrame, read: Callable[[DataFrame], DataFrame], cfg: VerifyConfig, progress: str, parts: int = PARTS) -> DataFrame:
    """embed_photos of people (subject_id), part by part; each part is committed to a table at progress, and a later run skips it.

    read gives the photos (subject_id, content) of a part's people. If it reads them by a manifest
    (sources.photos.load_photos), paths are all that is joined or shuffled, and the bytes go from the
    file to the model in one task. People are dealt to parts by their ids' hash, so all runs of one
    progress table must have the same parts.
    """
    table = BatchTable(people.sparkSession, progress)
    done = table.batches()
    for k in range(parts):
        if k not in done:
            table.write(embed_photos(read(people.where(F.pmod(F.xxhash64("subject_id"), F.lit(parts)) == k)), cfg), k)
    return table.read()


def refresh_embeddings(subjects: DataFrame, photos: DataFrame | Callable[[DataFrame], DataFrame], embeddings: DataFrame, cfg: VerifyConfig, now: Column, only: str = "all", progress: str | None = None, parts: int = PARTS) -> tuple[DataFrame, DataFrame]:
    """(new embeddings table, report) after embedding the photos of the active subjects that need it.

    photos has subject_id and content, or is a function that reads those of some subjects. only:
    'missing' (no active embedding), 'stale' (made under other settings) or 'all'. The report has
    subject_id, success, model_name, provider, error. The model runs once per photo: what it gave is
    checkpointed, so the table and the report never disagree. With progress, a path, the run is in
    parts and goes on where an earlier one was stopped.
    """
    current = active(embeddings)
    people = active(subjects).select("subject_id")
    if only == "missing":
        people = people.join(current, "subject_id", "left_anti")
    elif only == "stale":
        people = people.join(current.where(is_stale(F.col("metadata"), cfg)), "subject_id", "left_semi")
    elif only != "all":
        raise ValueError("only is 'missing', 'stale' or 'all'")
    read = photos if callable(photos) else lambda who: who.join(photos.select("subject_id", "content"), "subject_id", "left")
    found = embed_in_parts(people, read, cfg, progress, parts) if progress else checkpointed(embed_photos(read(people), cfg))
    new = found.where(F.col("error").isNull()).select("subject_id", "embedding", F.lit(cfg.snapshot).alias("metadata"))
    report = found.select("subject_id", F.col("error").isNull().alias("success"), F.lit(cfg.model_name).alias("model_name"), F.lit(cfg.provider).alias("provider"), "error")
    return store_embeddings(embeddings, new, now), report
