"""Embedding near-dedup by sorted projection passes.

Each pass orders the vectors of a label lexicographically by random hashes in a row: the sides of
random hyperplanes through the mean of all. Vectors at a small angle share a long beginning, so they
stand near each other; each is compared with the WINDOW rows after it, by cosine in double
precision. Pairs that pass are united across passes. A pass is a range sort, so a label or a group of
near copies with a third of all rows is spread over tasks; where one task's rows end and the next
one's begin, the last and first WINDOW rows are compared once more by themselves.

The number of passes follows from the largest label: at an angle t a hyperplane parts two vectors
with probability t / pi, and in n vectors they meet in a window if they share log2(n / WINDOW) hashes
or so. There are as many passes as find a pair at the threshold itself with probability RECALL.
Pairs further inside are found more surely; pairs below the threshold never link.

Equal vectors of a label are one node and are never compared; they count as links. Links are counted
exactly among the distinct vectors of each component, block by block, so no pair leaves a task; this
is quadratic in a component's distinct vectors, as the number of its links may be. exact=False counts
the found partners instead: at most 2 * WINDOW a pass, so it is linear.

Defined results: rows with a null label, and vectors that are null, empty, zero or hold null or
non-finite numbers link with nothing; vectors of different lengths don't link; a null id isn't a
component's id unless there is no other; rows that repeat an id count as rows; an empty table gives
no rows; other columns stay, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ._common import checkpointed, unused
from .simhash_dedup import components, star

THRESHOLD = 0.98
WINDOW = 32
RECALL = 0.999
LEAST_PASSES = 6
#: Hashes of a sort key.
HASHES = 48
SEED = 11
#: Passes of one sort, so that shuffle files stay bounded.
AT_ONCE = 3
#: Lengths of vectors whose mean is taken, the most frequent ones; it only helps the search.
MEANS = 8
#: Distinct vectors of a component that are compared at once, at least and at most.
BLOCKS = (256, 8192)


def unit(x: np.ndarray) -> np.ndarray:
    """Vectors in double precision, scaled to length 1 without overflow."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers, null as NaN; where each list begins and the last ends)."""
    column = column.cast(pa.large_list(column.type.value_type))
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return column.values.slice(at[0], at[-1] - at[0]).to_numpy(zero_copy_only=False), at - at[0]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return unit(_lists(column)[0].reshape(-1, dim))


@F.arrow_udf(BinaryType())
def node_key(label: pa.Array, vectors: pa.Array) -> pa.Array:
    """SHA-256 of label and numbers; null for what links with nothing."""
    values, at = _lists(vectors)
    before = lambda x: np.concatenate([[0], np.cumsum(x)])
    bad, some = before(~np.isfinite(values)), before(values != 0)
    fine = (bad[at[1:]] == bad[at[:-1]]) & (some[at[1:]] > some[at[:-1]])
    values = np.ascontiguousarray(values)
    names = label.to_pylist()
    there = vectors.is_valid().to_numpy(zero_copy_only=False)
    return pa.array([sha256(names[k].encode() + b"\0" + values[at[k] : at[k + 1]].tobytes()).digest() if fine[k] and there[k] and names[k] is not None else None for k in range(len(names))], pa.binary())


def _means(nodes: DataFrame) -> dict[int, np.ndarray]:
    """The mean of the unit vectors of the most frequent lengths; a task gives one sum a length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for dim, part in _by_dim(batch):
                now = total.setdefault(dim, [0, np.zeros(dim)])
                now[0] += part.num_rows
                now[1] += _matrix(part.column("vec"), dim).sum(axis=0)
        for dim, (n, s) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array(s)], names=["dim", "pos", "n", "s"])

    most = [r[0] for r in nodes.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(MEANS).collect()]
    sums = nodes.where(F.col("dim").isin(most)).select("dim", "vec").mapInArrow(run, "dim int, pos int, n long, s double").groupBy("dim", "pos").agg((F.sum("s") / F.sum("n")).alias("m"))
    out: dict[int, np.ndarray] = {d: np.zeros(d) for d in most}
    for r in sums.collect():
        out[r["dim"]][r["pos"]] = r["m"]
    return out


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Stretches of a batch whose vectors have one length."""
    dims = batch.column("dim").to_numpy()
    borders = np.concatenate([[0], np.flatnonzero(np.diff(dims)) + 1, [len(dims)]]).tolist()
    for a, b in zip(borders[:-1], borders[1:]):
        if b > a:
            yield int(dims[a]), batch.slice(a, b - a)


def planes(dim: int, turn: int) -> np.ndarray:
    """The hyperplanes of one pass."""
    return np.random.default_rng((SEED, dim, turn)).standard_normal((dim, HASHES))


def hashes(u: np.ndarray, normals: np.ndarray) -> np.ndarray:
    """The sides on which vectors lie, the first plane in the highest bit."""
    return ((u @ normals) >= 0).astype(np.int64) @ (np.int64(1) << np.arange(HASHES - 1, -1, -1))


def passes_for(n: int, threshold: float = THRESHOLD, window: int = WINDOW, recall: float = RECALL) -> int:
    """How many passes find a pair at the threshold among n vectors with this probability."""
    if n <= window + 1:
        return 1
    meet = (1 - math.acos(threshold) / math.pi) ** math.log2(n / window)
    return max(LEAST_PASSES, math.ceil(math.log(1 - recall) / math.log(1 - meet)) if meet < 1 else 1)


_ROW = ["turn", "label", "dim", "hash", "node", "vec"]


def _keyed(turns: list[int], means: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normals: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for dim, part in _by_dim(batch):
                u = _matrix(part.column("vec"), dim) - means.get(dim, 0.0)
                for turn in turns:
                    if (dim, turn) not in normals:
                        normals = {k: v for k, v in normals.items() if k[0] == dim} | {(dim, turn): planes(dim, turn)}
                    yield pa.RecordBatch.from_arrays([pa.array([turn] * len(u), pa.int32()), part.column("label"), part.column("dim"), pa.array(hashes(u, normals[dim, turn])), part.column("node"), part.column("vec")], names=_ROW)

    return run


def _same_group(batch: pa.RecordBatch) -> np.ndarray:
    """A number for each row that changes with pass, label or length."""
    labels = batch.column("label").dictionary_encode().indices.to_numpy(zero_copy_only=False)
    change = np.zeros(batch.num_rows, bool)
    for x in (batch.column("turn").to_numpy(), labels, batch.column("dim").to_numpy()):
        change[1:] |= x[1:] != x[:-1]
    return np.cumsum(change)


def _close(u: np.ndarray, group: np.ndarray, window: int, threshold: float, fresh: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one group at most window rows apart, the later one from fresh on, with at least this cosine."""
    step, found = 4 * window, []
    for at in range(max(0, fresh - window), len(u), step):
        rows, cols = u[at : at + step], u[at : at + step + window]
        i, j = np.nonzero(rows @ cols.T >= threshold)
        ok = (j > i) & (j - i <= window) & (j + at >= fresh) & (group[i + at] == group[j + at])
        found.append((i[ok] + at, j[ok] + at))
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))


_OUT = "a long, b long, border int, side int, place int, turn int, label string, dim int, hash long, node long, vec "


def _windows(window: int, threshold: float, forest: bool):
    """Sorted rows in; edges out, and the first and last rows of the task for its neighbours."""

    def edges(batch: pa.RecordBatch, fresh: int) -> pa.RecordBatch | None:
        group, nodes, found, at = _same_group(batch), batch.column("node").to_numpy(), [], 0
        for dim, part in _by_dim(batch):
            n = part.num_rows
            i, j = _close(_matrix(part.column("vec"), dim), group[at : at + n], window, threshold, max(0, fresh - at))
            found.append((nodes[i + at], nodes[j + at]))
            at += n
        a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        if forest:
            a, b = star(a, b)
        return _out(batch.schema, pa.array(a), pa.array(b)) if len(a) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        me, tail, begun = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if begun < window:
                head = batch.slice(0, window - begun)
                yield _border(head, me - 1, 1, begun)
                begun += head.num_rows
            both = batch if tail is None else pa.Table.from_batches([tail, batch]).combine_chunks().to_batches()[0]
            if (out := edges(both, 0 if tail is None else tail.num_rows)) is not None:
                yield out
            tail = both.slice(max(0, both.num_rows - window))
        if tail is not None:
            yield _border(tail, me, 0, 0)

    return run


def _out(schema: pa.Schema, a: pa.Array, b: pa.Array) -> pa.RecordBatch:
    none = lambda kind: pa.nulls(len(a), kind)
    return pa.RecordBatch.from_arrays([a, b, *(none(pa.int32()) for _ in range(3)), *(none(schema.field(c).type) for c in _ROW)], names=["a", "b", "border", "side", "place", *_ROW])


def _border(rows: pa.RecordBatch, border: int, side: int, begun: int) -> pa.RecordBatch:
    n = rows.num_rows
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), *(pa.array(x, pa.int32()) for x in ([border] * n, [side] * n, range(begun, begun + n))), *(rows.column(c) for c in _ROW)], names=["a", "b", "border", "side", "place", *_ROW])


def _across(window: int, threshold: float, forest: bool):
    """Rows by border, the task's before it first: edges across it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["border"]):
            sides = group.column("side").to_numpy()
            split = int((sides == 0).sum())
            if 0 < split < len(sides):
                numbers, at, nodes = _same_group(group), 0, group.column("node").to_numpy()
                for dim, part in _by_dim(group):
                    u, here = _matrix(part.column("vec"), dim), numbers[at : at + part.num_rows]
                    i, j = _close(u, here, window, threshold, max(0, split - at))
                    ok = i + at < split
                    a, b = nodes[i[ok] + at], nodes[j[ok] + at]
                    if forest:
                        a, b = star(a, b)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                    at += part.num_rows

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The groups of rows that stand together, each as one batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy() for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        change[0] = bool(held) and any(held[-1].column(k)[-1].as_py() != c[0] for k, c in zip(keys, cols))
        at = 0
        for cut in [*np.flatnonzero(change).tolist(), batch.num_rows]:
            if cut > at:
                held.append(batch.slice(at, cut - at))
            if cut < batch.num_rows and held:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            at = cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def linked(nodes: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW, recall: float = RECALL, forest: bool = True) -> DataFrame:
    """a, b: pairs of nodes (node, label, dim, vec) found in the windows of all passes, or a forest of the same components."""
    spark = nodes.sparkSession
    sizes = nodes.groupBy("label", "dim").count().agg(F.max("count"), F.sum("count")).first()
    if not sizes[0]:
        return spark.createDataFrame([], "a long, b long")
    turns, means = passes_for(sizes[0], threshold, window, recall), _means(nodes)
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tasks = max(1, min(tasks, sizes[1] * min(turns, AT_ONCE) // (8 * window)))
    kind, found = nodes.schema["vec"].dataType.simpleString(), []
    for at in range(0, turns, AT_ONCE):
        rows = nodes.select("label", "dim", "node", "vec").mapInArrow(_keyed(list(range(at, min(turns, at + AT_ONCE))), means), f"turn int, label string, dim int, hash long, node long, vec {kind}")
        rows = rows.repartitionByRange(tasks, "turn", "label", "dim", "hash", "node").sortWithinPartitions("turn", "label", "dim", "hash", "node")
        out = checkpointed(rows.mapInArrow(_windows(window, threshold, forest), _OUT + kind))
        borders = out.where("border is not null").drop("a", "b").repartition("border").sortWithinPartitions("border", "side", "place")
        found.append(checkpointed(out.where("a is not null").select("a", "b").union(borders.mapInArrow(_across(window, threshold, forest), "a long, b long"))))
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    return every


def _counted(threshold: float):
    """Rows by component and pair of blocks: how many rows each node's links are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["root", "i", "j"]):
            u, n, nodes = _matrix(group.column("vec"), group.column("dim")[0].as_py()), group.column("n").to_numpy(), group.column("node").to_numpy()
            mine, total = group.column("block").to_numpy(), np.zeros(len(nodes), np.int64)
            first, second = (np.flatnonzero(mine == group.column(c)[0].as_py()) for c in ("i", "j"))
            inner = len(first) == len(nodes)
            for at in range(0, len(first), 512):
                rows = first[at : at + 512]
                link = u[rows] @ u[second].T >= threshold
                if inner:
                    link[np.arange(len(rows)), at + np.arange(len(rows))] = False
                total[rows] += link @ n[second]
                if not inner:
                    total[second] += n[rows] @ link
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(total)], names=["node", "links"])

    return run


def exact_links(nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """node, links: rows whose vectors link with the node's, itself excluded; nodes has node, n, dim, vec, root.

    A component is dealt to blocks by hash, and each pair of blocks is a group of its own.
    """
    low, high = BLOCKS
    sizes = nodes.groupBy("root").agg(F.count("*").alias("size"))
    blocks = F.ceil(F.col("size") / F.greatest(F.lit(low), F.least(F.lit(high), F.ceil(F.col("size") / 8))))
    rows = nodes.join(sizes, "root").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "n", "dim", "vec")
    rows = rows.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    return rows.mapInArrow(_counted(threshold), "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, window: int = WINDOW, recall: float = RECALL, exact: bool = True, into: str = "near") -> DataFrame:
    """vectors with a struct of n_links, component_id and kept in a new column."""
    if into.lower() in {c.lower() for c in vectors.columns}:
        raise ValueError(f"the table has a column {into}; name another with into=")
    kind = "array<float>" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"
    key, label, vec = unused(vectors, "key"), F.col(label_col).cast("string"), F.col(vec_col).cast(kind)
    rows = vectors.withColumn(key, node_key(label, vec))
    nodes = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"), F.min(id_col).alias("first_id"), F.first(label).alias("label"), F.first(vec).alias("vec"))
    nodes = checkpointed(nodes.select("key", "n", "first_id", "label", "vec", F.size("vec").alias("dim"), F.monotonically_increasing_id().alias("node")))
    found = linked(nodes, threshold, window, recall, forest=exact)
    roots = components(found).withColumnsRenamed({"node": "end"})
    grouped = checkpointed(nodes.join(roots, F.col("node") == F.col("end")).drop("end"))
    least = grouped.groupBy("root").agg(F.min("first_id").alias("least"))
    if exact:
        links = exact_links(grouped, threshold)
    else:
        both = found.select(F.col("a").alias("node"), F.col("b").alias("end")).union(found.select("b", "a")).distinct()
        links = both.join(nodes.select(F.col("node").alias("end"), "n"), "end").groupBy("node").agg(F.sum("n").alias("links"))
    named = grouped.select("key", "n", "node", "root").join(least, "root").join(links, "node").select(F.col("key").alias("of"), "n", "links", "least")
    single = nodes.select(F.col("key").alias("of"), "n", "first_id").where("n > 1").join(named.select("of"), "of", "left_anti").select("of", "n", F.lit(0).cast("long").alias("links"), F.col("first_id").alias("least"))
    # a vector that a third of all rows share is on the rows' side only, where adaptive execution splits it
    out = rows.join(named.union(single), F.col(key) == F.col("of"), "left")
    alone = F.col("of").isNull()
    component = F.when(alone, F.col(id_col)).otherwise(F.col("least"))
    result = F.struct(F.when(alone, F.lit(0).cast("long")).otherwise(F.col("n") - 1 + F.col("links")).alias("n_links"), component.alias("component_id"), F.col(id_col).eqNullSafe(component).alias("kept"))
    return out.select(*vectors.columns, result.alias(into))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links and component."""
    rows = near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return rows.select("vec_id", *(F.col("near")[c].alias(c) for c in ("n_links", "component_id", "kept")))


OP11_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
c AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT c.vec_id, p.b FROM c JOIN p ON p.a = c.other),
m AS (SELECT vec_id, min(other) AS component_id FROM c GROUP BY vec_id)
SELECT e.vec_id, (SELECT count(*) FROM p WHERE p.a = e.vec_id) AS n_links, m.component_id, e.vec_id = m.component_id AS kept FROM embeddings e JOIN m ON m.vec_id = e.vec_id
"""
