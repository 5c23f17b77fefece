import numpy as np
import pytest
from pyspark.sql import functions as F

from verispark.llm import embedding_dedup as E

from .helpers import rows_of

SCHEMA = "vec_id long, embedding array<double>, label string, near string, node int, key string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], lab, "x", 1, "k") for i, v, lab in rows], SCHEMA).repartition(5)


def brute(rows, threshold=E.THRESHOLD):
    """(id, links, component, kept) of each row by all pairs, sorted."""
    n = len(rows)
    fine = [lab is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v) for _, v, lab in rows]
    links = {k: set() for k in range(n)}
    for group in {(lab, len(v)) for k, (_, v, lab) in enumerate(rows) if fine[k]}:
        at = [k for k in range(n) if fine[k] and (rows[k][2], len(rows[k][1])) == group]
        u = np.array([np.array(rows[k][1], np.float64) / np.abs(rows[k][1]).max() for k in at])
        u /= np.linalg.norm(u, axis=1)[:, None]
        for i, j in np.argwhere(u @ u.T >= threshold):
            if i != j:
                links[at[i]].add(at[j])
    out, seen = [None] * n, set()
    for k in range(n):
        if k in seen:
            continue
        part, todo = {k}, [k]
        while todo:
            for x in links[todo.pop()] - part:
                part.add(x)
                todo.append(x)
        seen |= part
        ids = [rows[x][0] for x in part if rows[x][0] is not None]
        for x in part:
            least = min(ids) if ids else None
            out[x] = (rows[x][0], len(links[x]), least, rows[x][0] == least)
    return sorted(out, key=str)


def result(df):
    got = df.select("vec_id", "found.*").collect()
    return sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got), key=str)


def planted(seed=3, dims=16):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for label, n in (("a", 900), ("b", 200), ("c", 3)):
        for v in rng.standard_normal((n, dims)) + 0.4:  # off centre
            rows.append((k, v, label))
            k += 1
    for base, copies, noise in ((5, 1, 0.02), (17, 3, 0.03), (40, 300, 0.03), (950, 1, 0.05)):
        v = rows[base][1]
        for _ in range(copies):
            w = rng.standard_normal(dims)
            rows.append((k, v / np.linalg.norm(v) + noise * w / np.linalg.norm(w) * 2, rows[base][2]))
            k += 1
    rows += [(k + j, rows[60][1], rows[60][2]) for j in range(250)]  # equal vectors
    rows.append((k + 300, rows[60][1], "b"))  # equal, with another label
    return rows


def test_planted_copies_are_linked_as_all_pairs_link_them(spark):
    rows = planted()
    assert result(E.near_duplicates(table(spark, rows), into="found")) == brute(rows)


def test_awkward_rows_link_with_nothing_and_stay(spark):
    v = [1.0, 2.0, 3.0]
    rows = [
        (4, v, "a"), (3, [2.0, 4.0, 6.0], "a"), (3, v, "a"), (None, v, "a"), (9, v, None), (8, None, "a"), (7, [], "a"), (6, [0.0, 0.0, 0.0], "a"), (5, [1.0, None, 3.0], "a"), (10, [1.0, float("nan"), 3.0], "a"),
        (11, [1.0, float("inf"), 0.0], "a"), (12, [1.0, 2.0], "a"), (13, [1e200, 2e200, 3e200], "a"), (14, [1e-200, 2e-200, 3e-200], "a"), (15, v, "b"), (None, [9.0, 0.0, 0.0], "z"), (None, [9.0, 0.0, 0.0], "z"), (16, [-1.0, -2.0, -3.0], "a"), (17, [-0.0, 1.0, 0.0], "a"), (18, [0.0, 1.0, 0.0], "a"),
    ]
    assert result(E.near_duplicates(table(spark, rows), into="found")) == brute(rows)


def test_clashing_columns_stay_and_the_result_needs_a_free_name(spark):
    df = table(spark, [(1, [1.0, 0.0], "a"), (2, [1.0, 0.0], "a")])
    assert E.near_duplicates(df, into="found").columns == [*df.columns, "found"]
    with pytest.raises(ValueError, match="near"):
        E.near_duplicates(df)


def test_empty_tables_give_no_rows(spark):
    assert rows_of(E.near_duplicates(table(spark, []), into="found")) == []
    assert result(E.near_duplicates(table(spark, [(1, None, "a")]), into="found")) == [(1, 0, 1, True)]


def test_windows_meet_across_tasks(spark, monkeypatch):
    """One near pair a window apart at most, in every place of the order; many tasks."""
    rng = np.random.default_rng(0)
    base = rng.standard_normal((400, 8))
    rows = [(k, v, "a") for k, v in enumerate(base)] + [(1000 + k, v + 1e-6, "a") for k, v in enumerate(base)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    monkeypatch.setattr(E, "LEAST_PASSES", 1)
    monkeypatch.setattr(E, "passes_for", lambda *a: 3)
    try:
        assert result(E.near_duplicates(table(spark, rows), window=8, into="found")) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_recall_of_pairs_at_the_threshold(spark):
    """Isolated pairs just within the threshold, among many others: at least 0.99 of them are found."""
    rng = np.random.default_rng(5)
    n, dims, cos = 3000, 24, 0.9801
    base = rng.standard_normal((n, dims))
    base /= np.linalg.norm(base, axis=1)[:, None]
    side = rng.standard_normal((n, dims))
    side -= np.einsum("ij,ij->i", side, base)[:, None] * base
    side /= np.linalg.norm(side, axis=1)[:, None]
    rows = [(k, v, "a") for k, v in enumerate(base)] + [(10_000 + k, cos * base[k] + np.sqrt(1 - cos**2) * side[k], "a") for k in range(n)]
    got = {r[0]: r[1] for r in result(E.near_duplicates(table(spark, rows), into="found"))}
    assert sum(got[k] > 0 for k in range(n)) >= 0.99 * n
    assert sum(got.values()) <= sum(r[1] for r in brute(rows))


def test_blocks_count_what_one_block_counts(spark, monkeypatch):
    rows = planted()
    monkeypatch.setattr(E, "BLOCKS", (16, 32))
    assert result(E.near_duplicates(table(spark, rows), into="found")) == brute(rows)


def test_found_links_are_links_and_give_the_same_components(spark):
    rows = planted()
    got, want = result(E.near_duplicates(table(spark, rows), exact=False, into="found")), brute(rows)
    assert [(r[0], *r[2:]) for r in got] == [(r[0], *r[2:]) for r in want]
    assert all(a[1] <= b[1] for a, b in zip(got, want))


def test_passes_grow_with_the_largest_label():
    assert E.passes_for(10) == 1
    assert E.passes_for(1000) <= E.passes_for(10**6) < E.passes_for(10**9) < 60


def test_floats_are_compared_in_double_precision(spark):
    rows = [(k, v, "a") for k, v in enumerate(np.float32(np.random.default_rng(1).standard_normal((50, 4))).astype(float))]
    df = table(spark, rows)
    single = df.withColumn("embedding", F.col("embedding").cast("array<float>"))
    assert result(E.near_duplicates(single, into="found")) == brute(rows)
