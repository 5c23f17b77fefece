"""Tables by micro-batch: repeated batches, merging, buckets."""

import os

import pytest
from pyspark.sql import functions as F

from verispark.tables import BatchTable


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "k long, v string").coalesce(1)


def files(path):
    return [os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")]


def test_repeated_batches_replace_their_rows(spark, tmp_path):
    t = BatchTable(spark, f"{tmp_path}/a table's")
    assert not t.exists()
    with pytest.raises(ValueError, match="no batch"):
        t.read()
    t.write(rows(spark, [(1, "a"), (1, "a")]), 0)
    t.write(rows(spark, [(2, "b")]), 1)
    t.write(rows(spark, [(2, "c"), (None, None)]), 1)
    assert sorted(map(str, t.read().collect())) == sorted(map(str, rows(spark, [(1, "a"), (1, "a"), (2, "c"), (None, None)]).collect()))
    assert t.read(before=1).count() == 2 and t.read(with_batch=True).columns == ["k", "v", "batch"]
    assert BatchTable(spark, f"{tmp_path}/a table's").read().count() == 4  # another reader


def test_many_batches_leave_few_folders_and_files(spark, tmp_path):
    t = BatchTable(spark, f"{tmp_path}/t", by="v", fan=3)
    for n in range(30):
        t.write(rows(spark, [(n, str(n % 2))]), n)
        if n in (7, 20):
            t.write(rows(spark, [(n, str(n % 2)), (100 + n, "1")]), n)
    assert sorted(r[0] for r in t.read().select("k").collect()) == sorted([*range(30), 107, 120])
    assert t.folders() <= 3 * 4 and len(files(f"{tmp_path}/t")) <= 30
    assert len(os.listdir(f"{tmp_path}/t/manifest")) <= 6  # two manifests and their checksums
    assert {r[0]: r[1] for r in t.read().groupBy("v").count().collect()} == {"0": 15, "1": 17}


def test_a_key_has_its_last_row(spark, tmp_path):
    t = BatchTable(spark, f"{tmp_path}/t", key="k", buckets=4, fan=3)
    for n in range(14):
        t.write(rows(spark, [(k, f"{n}.{k}") for k in range(n, n + 5)] + [(77, f"{n}.77")]), n)
    want = {k: f"{min(k, 13)}.{k}" for k in range(18)} | {77: "13.77"}
    assert {r["k"]: r["v"] for r in t.read().collect()} == want
    assert {r["k"]: r["v"] for r in t.read(before=13).collect()} == {k: f"{min(k, 12)}.{k}" for k in range(17)} | {77: "12.77"}
    with pytest.raises(ValueError, match="merged"):
        t.read(before=5)
    some = rows(spark, [(3, ""), (77, ""), (500, ""), (3, "")])
    assert {r["k"]: r["v"] for r in t.read(of=some).collect()} == {3: "3.3", 77: "13.77"}
    t.write(rows(spark, [(1, "x"), (1, "y")]), 14)
    assert t.read().where("k = 1").count() == 1


def test_a_reader_of_some_keys_opens_their_buckets_only(spark, tmp_path):
    t = BatchTable(spark, f"{tmp_path}/t", key="k", buckets=16)
    t.write(spark.range(1000).select(F.col("id").alias("k"), F.lit("x").alias("v")), 0)
    got = t.read(of=rows(spark, [(5, "")]))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "__bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert [r["k"] for r in got.collect()] == [5]


def test_two_writers_are_told(spark, tmp_path):
    a = BatchTable(spark, f"{tmp_path}/t")
    a.write(rows(spark, [(1, "a")]), 0)
    a.files.write("2.json", "{}")
    with pytest.raises(FileExistsError):
        a.files.write("2.json", "{}")


def test_intermediate_data_can_be_discarded(spark):
    from verispark.storage import discard, shared_path

    discard(spark)
    path = shared_path(spark, "x")
    rows(spark, [(1, "a")]).write.parquet(path)
    assert discard(spark) == 1 and discard(spark) == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
