"""Reference photos in a folder, written by tasks and read by their manifest."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of photos that a task holds before it passes them on.
HELD = 32 << 20


def _open(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a root and the root's path in it; a plain path is local."""
    parts = urlparse(root)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), (unquote(parts.path) if parts.scheme else root).rstrip("/")
    found, path = fs.FileSystem.from_uri(root)
    return found, path.rstrip("/")


def store_photos(photos: DataFrame, root: str) -> DataFrame:
    """The manifest (subject_id, folder, filename) of photos, which have content besides; computing a row writes its file under root, if it has content.

    Write it as a table, so that each file is written once and all are there before they are read. A
    file appears whole by a rename, in place of any that was there, so a task may be repeated. Unlike
    a writer partitioned by subject, it needs no folder, and the driver no rename, for each photo.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (files, base), made = _open(root), set()
        for batch in batches:
            for folder, name, content in zip(*(batch.column(c).to_pylist() for c in ("folder", "filename", "content"))):
                if content is None:
                    continue
                if folder not in made:
                    files.create_dir(f"{base}/{folder}", recursive=True)
                    made.add(folder)
                part = f"{base}/{folder}/.{uuid.uuid4().hex}"
                with files.open_output_stream(part) as stream:
                    stream.write(content)
                files.move(part, f"{base}/{folder}/{name}")
            yield batch.select(["subject_id", "folder", "filename"])

    kind = dict(photos.dtypes)["subject_id"]
    return photos.select("subject_id", "folder", "filename", "content").mapInArrow(write, f"subject_id {kind}, folder string, filename string")


def load_photos(spark: SparkSession, root: str | None, manifest: DataFrame) -> DataFrame:
    """subject_id, path, content, error for a manifest (subject_id, folder, filename).

    Paths are relative to root, which every worker must see. Tasks are the manifest's partitions and
    open the files of their rows, no others: the root is never listed, and photos aren't shuffled.
    What follows in the same stage, such as a model, gets the bytes as they are read. Errors: no
    photo, no root, path outside root, file missing, file unreadable; they never name a path.
    """
    segments = F.filter(F.split(F.concat_ws("/", F.coalesce("folder", F.lit("")), F.coalesce("filename", F.lit(""))), "/"), lambda s: ~s.isin("", "."))
    none, outside = F.col("filename").isNull() | (F.col("filename") == ""), F.exists(segments, lambda s: s == "..")
    error = F.when(none, "no photo").when(F.lit(not root), "no photo root").when(outside, "path outside root")
    rows = manifest.select("subject_id", F.array_join(segments, "/").alias("path"), error.alias("error"))
    if not root:
        return rows.select("subject_id", "path", F.lit(None).cast("binary").alias("content"), "error")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _open(root)

        def batch_of(part: pa.RecordBatch, content: list, errors: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([part.column("subject_id"), part.column("path"), pa.array(content, pa.binary()), pa.array(errors, pa.string())], names=["subject_id", "path", "content", "error"])

        for batch in batches:
            begun, held, content, errors = 0, 0, [], []
            for k, (path, problem) in enumerate(zip(batch.column("path").to_pylist(), batch.column("error").to_pylist())):
                data = None
                if problem is None:
                    try:
                        with files.open_input_stream(f"{base}/{path}") as stream:
                            data = stream.read()
                    except FileNotFoundError:
                        problem = "file missing"
                    except OSError:
                        problem = "file unreadable"
                content.append(data)
                errors.append(problem)
                held += len(data or b"")
                if held >= HELD:
                    yield batch_of(batch.slice(begun, k + 1 - begun), content, errors)
                    begun, held, content, errors = k + 1, 0, [], []
            if content:
                yield batch_of(batch.slice(begun), content, errors)

    kind = dict(rows.dtypes)["subject_id"]
    return rows.mapInArrow(read, f"subject_id {kind}, path string, content binary, error string")
