"""Tables that a stream writes by micro-batch and readers see through a manifest.

A batch's rows are a folder of their own, named anew each time it is written. The manifest, a small
JSON file with a number, lists the folders that count; writing its next number by a rename is what
makes a batch visible, so readers never see half of one and a repeated batch takes the place of
what it wrote before. One query at a time writes a table.

As soon as FAN folders of one level are complete, the next batch merges them into one of the next
level, so n batches leave at most FAN folders for each power of FAN in n. A table with a key holds
the last row of each key: merging drops the others, and rows lie in buckets by the key's hash, so a
reader of some keys opens only their buckets. A table without a key keeps all rows, and its merged
folders are partitioned by a column, such as a month, if one is named.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from .storage import SharedFiles

FAN = 8
BUCKETS = 64


class BatchTable:
    """path's batches; key and buckets, or the column that merged folders are partitioned by, are fixed by the first write."""

    def __init__(self, spark: SparkSession, path: str, key: str | None = None, buckets: int = BUCKETS, by: str | None = None, fan: int = FAN):
        self.spark, self.path, self.key, self.buckets, self.by, self.fan = spark, path.rstrip("/"), key, buckets, by, fan
        self.files = SharedFiles(spark, f"{self.path}/manifest")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self._manifest["buckets"])).cast("int")

    def _load(self) -> dict | None:
        """The manifest with the largest number, or none."""
        numbers = sorted(int(n[:-5]) for n in self.files.names() if n.endswith(".json"))
        self._manifest = json.loads(self.files.read(f"{numbers[-1]}.json")) | {"number": numbers[-1]} if numbers else None
        if self._manifest:
            self.key = self._manifest["key"]
        return self._manifest

    def exists(self) -> bool:
        return self._load() is not None

    def _rows(self, parts: list[dict], buckets: list[int] | None = None) -> DataFrame:
        """The rows of some folders, with batch."""
        m = self._manifest
        schema = StructType.fromJson(m["schema"]).add("batch", "long")
        if m["key"]:
            schema = schema.add("__bucket", IntegerType())
        found = None
        for p in parts:
            rows = self.spark.read.schema(schema).parquet(f"{self.path}/{p['folder']}")
            found = rows if found is None else found.unionByName(rows)
        if found is None:
            found = self.spark.createDataFrame([], schema)
        return found if buckets is None else found.where(F.col("__bucket").isin(buckets))

    def _last(self, rows: DataFrame) -> DataFrame:
        row = F.struct(*(c for c in rows.columns if c != self.key))
        return rows.groupBy(self.key).agg(F.max_by(row, "batch").alias("r")).select(self.key, "r.*")

    def read(self, before: int | None = None, of: DataFrame | None = None, with_batch: bool = False) -> DataFrame:
        """All rows, or each key's last one; of the batches before one if it is given, and of the keys in of if they are.

        before can be the batch that is written now or written again; older ones may be merged.

        of brings at most buckets numbers to the driver, which choose the folders that are opened.
        """
        m = self._load()
        if m is None:
            raise ValueError(f"{self.path} has no batch yet")
        parts = [p for p in m["parts"] if before is None or p["first"] < before]
        if before is not None and any(p["last"] >= before for p in parts):
            raise ValueError(f"batches up to {max(p['last'] for p in parts)} are merged and can't be read as of {before}")
        buckets = None
        if of is not None:
            buckets = [r[0] for r in of.select(self._bucket().alias("b")).distinct().collect()]
        rows = self._rows(parts, buckets)
        if of is not None:
            rows = rows.join(of.select(self.key).distinct(), self.key, "left_semi")
        rows = self._last(rows) if m["key"] and len(parts) > 1 else rows  # a folder has one row of a key
        columns = [f["name"] for f in m["schema"]["fields"]]
        return rows.select(*columns, *(["batch"] if with_batch else []))

    def batch(self, n: int) -> DataFrame:
        """The rows of the newest batch n, as they were written."""
        m = self._load()
        rows = self._rows([p for p in m["parts"] if p["level"] == 0 and p["last"] == n])
        return rows.select(*(f["name"] for f in m["schema"]["fields"]))

    def _write(self, rows: DataFrame, level: int) -> str:
        folder = f"level={level}-{uuid.uuid4().hex}"
        if self._manifest["key"]:
            rows = rows.withColumn("__bucket", self._bucket())
            # a bucket is one file; adaptive execution splits none of them, as a merged bucket must stay whole
            rows.repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/{folder}")
        elif level and self.by:
            rows.repartition(self.by).write.partitionBy(self.by).parquet(f"{self.path}/{folder}")
        else:
            rows.write.parquet(f"{self.path}/{folder}")
        return folder

    def write(self, rows: DataFrame, n: int, unique: bool = False) -> None:
        """Make rows the rows of batch n, in place of any that it had; rows of one key in a batch are taken one by the largest hash, unless they are unique."""
        m = self._load()
        if m is None:
            m = self._manifest = {"number": 0, "key": self.key, "buckets": self.buckets if self.key else None, "schema": rows.schema.jsonValue(), "parts": [], "gone": []}
        fields = [f["name"] for f in m["schema"]["fields"]]
        rows = rows.select(*fields)
        if self.key and not unique:
            rest = [c for c in fields if c != self.key]
            rows = rows.groupBy(self.key).agg(F.max_by(F.struct(*rest), F.xxhash64(*rest)).alias("r")).select(self.key, "r.*").select(*fields)
        before, parts, level = {p["folder"] for p in m["parts"]}, m["parts"], 0
        while len(same := [p for p in parts if p["level"] == level and p["last"] < n]) >= self.fan:
            merged = self._rows(same).drop("__bucket")
            folder = self._write(self._last(merged) if self.key else merged, level + 1)
            parts = [p for p in parts if p not in same] + [{"folder": folder, "level": level + 1, "first": min(p["first"] for p in same), "last": max(p["last"] for p in same)}]
            level += 1
        folder = self._write(rows.withColumn("batch", F.lit(n).cast("long")), 0)
        parts = [p for p in parts if not (p["level"] == 0 and p["last"] == n)] + [{"folder": folder, "level": 0, "first": n, "last": n}]
        gone = sorted(before - {p["folder"] for p in parts})
        self.files.write(f"{m['number'] + 1}.json", json.dumps({k: m[k] for k in ("key", "buckets", "schema")} | {"parts": parts, "gone": gone}))
        # what the manifest before this one had already left out: readers had a whole batch's time to finish
        for name in m["gone"]:
            self.files.delete(f"../{name}")
        self.files.delete(f"{m['number'] - 1}.json")

    def batches(self) -> set[int]:
        """The numbers of the batches that are stored, where they were written in turn."""
        m = self._load()
        return {k for p in (m["parts"] if m else []) for k in range(p["first"], p["last"] + 1)}

    def folders(self) -> int:
        """Folders that count now."""
        m = self._load()
        return len(m["parts"]) if m else 0
