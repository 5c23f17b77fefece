"""SimHash near-dedup by anchor-point covering.

Fingerprints that differ in at most three bits differ in at most one bit in one of their 32-bit
halves. The anchors of a half are the words of a covering code: the perfect Hamming code on 31
bits (covering radius 1) times the last bit. Each distinct fingerprint is at home at its nearest
anchor, and is replicated to every anchor within the covering radius plus the threshold (1 + 1)
of each half: 17 of 2^27 anchors at most. Two fingerprints that link therefore meet at the home of
either one, and each anchor's members are compared there with the full 64 bits. An anchor emits
a star of each component that it finds, never all pairs. Equal fingerprints are
one node, and components come from rounds of large-star and small-star joins.

Anchors that are home to over DENSE fingerprints have their members dealt again by parts of the
other half. Two fingerprints within three bits agree in one of its four bytes; above DENSE * DENSER
homes they are dealt by three of its six blocks of five or six bits, three of which agree as well.
So nothing is lost, and a group shrinks by 2^8 or some 2^16.

Defined results: null text is the empty text; texts without words have fingerprint zero and link
like any other; rows that repeat an id count as rows; an empty table gives no rows; other columns
are ignored, also when they share the results' names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import checkpointed, pieces, text_of, unused

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
#: Fingerprints at home at an anchor beyond which its members are dealt again by blocks of the other half.
DENSE = 4096
#: So many times more make it an anchor whose members are dealt by finer parts.
DENSER = 256
_BYTES = [0xFF << (8 * k) for k in range(4)]
_BLOCKS = [(2**b - 1) << a for a, b in ((0, 6), (6, 5), (11, 5), (16, 5), (21, 5), (26, 6))]
_TRIPLES = [a | b | c for a, b, c in combinations(_BLOCKS, 3)]
#: Pairs that are compared at once.
PAIRS = 1 << 20


def simhash(text: str, words: int = SHINGLE_WORDS) -> int:
    """64-bit fingerprint of one text: majority of the bits of its shingles' XXH64."""
    from xxhash import xxh64_intdigest

    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(parts) - words + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        first, last = starts[at : min(n, at + (1 << 16))], ends[min(len(parts), words) - 1 :][at : at + (1 << 16)]
        h = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(first.tolist(), last.tolist())], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, hashed: bool = False) -> DataFrame:
    """doc_id, fp (64 bits in a signed long), text_hash if hashed: one row per row of docs."""
    more = ["text_hash"] if hashed else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            fp = np.array([simhash(x, words) for x in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp), *(batch.column(c) for c in more)], names=["doc_id", "fp", *more])

    text = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *(F.md5(text).alias(c) for c in more))
    return rows.mapInArrow(run, "doc_id long, fp long" + "".join(f", {c} string" for c in more))


_SYNDROME = np.zeros((4, 256), np.uint32)  # of each byte of a 32-bit half; position p of the code is bit p
for _k in range(4):
    for _v in range(256):
        for _b in range(8):
            if _v >> _b & 1 and _k * 8 + _b:
                _SYNDROME[_k, _v] ^= np.uint32(_k * 8 + _b)


def home(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest anchor of 32-bit halves, and the position that was changed (0: none).

    Positions 1 to 31 are a Hamming code; bit 0 is free.
    """
    s = np.zeros(len(half), np.uint32)
    for k in range(4):
        s ^= _SYNDROME[k][(half >> np.uint32(8 * k)) & np.uint32(255)]
    return np.where(s > 0, half ^ (np.uint32(1) << s), half), s


def anchors(half: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which, anchor): every anchor within distance 2 of each half, its home first."""
    every = np.arange(len(half))
    near, s = home(half)
    yield every, near
    yield every, near ^ np.uint32(1)
    off = np.flatnonzero(s)  # these have 15 anchors at distance 2 in the code: the pairs {j, s xor j}
    for j in range(1, 32):
        other = s[off] ^ np.uint32(j)
        pick = (other > j) & (s[off] != j)
        which = off[pick]
        yield which, half[which] ^ (np.uint32(1) << np.uint32(j)) ^ (np.uint32(1) << other[pick])


def _homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The home of each fingerprint's halves."""
    for batch in batches:
        u = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        for side in (0, 1):
            near, _ = home(((u >> np.uint64(32 * side)) & np.uint64(0xFFFFFFFF)).astype(np.uint32))
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int64) | (side << 32))], names=["anchor"])


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        every = batch.column("fp").to_numpy(zero_copy_only=False)
        for at in range(0, len(every), 20_000):
            fp = every[at : at + 20_000]
            u = fp.view(np.uint64)
            for side in (0, 1):
                half = ((u >> np.uint64(32 * side)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                for k, (which, anchor) in enumerate(anchors(half)):
                    key = anchor.astype(np.int64) | (side << 32)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[which]), pa.array(np.full(len(which), k == 0))], names=["anchor", "fp", "home"])


def star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smallest node, other node) for the components of the edges a-b: one edge fewer than nodes."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        la, lb = label[ia], label[ib]
        apart = la != lb
        if not apart.any():
            break
        np.minimum.at(label, np.maximum(la, lb)[apart], np.minimum(la, lb)[apart])
        while ((up := label[label]) != label).any():
            label = up
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[other]], nodes[other]


def _compare(max_bits: int):
    """Sorted rows (anchor, block, fp, home) in, edges with the same components per anchor out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def work(rows: np.ndarray) -> pa.RecordBatch | None:
            border = np.flatnonzero((np.diff(rows[:, 0]) != 0) | (np.diff(rows[:, 1]) != 0)) + 1
            starts, ends = np.append(0, border), np.append(border, len(rows))
            group = np.repeat(np.arange(len(starts)), ends - starts)
            homes = np.flatnonzero(rows[:, 3])
            homes = homes[(ends - starts)[group[homes]] > 1]
            n = (ends - starts)[group[homes]]
            upto, found = np.cumsum(n), []
            at = 0
            while at < len(homes):
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
                h, k = homes[at:to], n[at:to]
                left = np.repeat(h, k)
                right = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(starts[group[h]], k)
                a, b = rows[left, 2], rows[right, 2]
                link = (np.bitwise_count((a ^ b).view(np.uint64)) <= max_bits) & (a != b)
                found.append(star(a[link], b[link]))
                at = to
            a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(c) for c in star(a, b)], names=["a", "b"]) if len(a) else None

        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("anchor", "block", "fp", "home")], axis=1)
            if not len(rows):
                continue
            # the last group may go on in the next batch
            cut = np.flatnonzero((rows[:, 0] != rows[-1, 0]) | (rows[:, 1] != rows[-1, 1]))
            cut = cut[-1] + 1 if len(cut) else 0
            if held and (cut or (held[-1][-1, :2] != rows[0, :2]).any()):
                first = np.concatenate([*held, rows[:cut]])
                held = []
            else:
                first = rows[:cut]
            if len(first) and (out := work(first)):
                yield out
            held.append(rows[cut:])
        if held and (out := work(np.concatenate(held))):
            yield out

    return run


def links(fps: DataFrame, max_bits: int = MAX_BITS, dense: int = DENSE, denser: int = DENSER) -> DataFrame:
    """a, b: edges whose components are those of all pairs of distinct fingerprints within max_bits."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("the covering code is made for at most 3 differing bits")
    # a fingerprint becomes some thirty rows, so the few bytes that it has now say little about the tasks that it needs
    fps = fps.repartition(max(fps.sparkSession.sparkContext.defaultParallelism, int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "fp")
    members = fps.mapInArrow(_replicate, "anchor long, fp long, home boolean")
    hot = checkpointed(fps.mapInArrow(_homes, "anchor long").groupBy("anchor").agg(F.count("*").alias("homes")).where(F.col("homes") > dense).select("anchor", F.when(F.col("homes") > dense * denser, 2).otherwise(1).alias("hot")))
    members = members.withColumn("hot", F.lit(0)) if hot.isEmpty() else members.join(hot, "anchor", "left")
    other = F.when(F.col("anchor") < F.lit(1 << 32), F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    parts = lambda masks: F.array(*(F.lit(k << 32).cast("long") + other.bitwiseAND(F.lit(m).cast("long")) for k, m in enumerate(masks)))
    blocks = F.when(F.col("hot") == 1, parts(_BYTES)).when(F.col("hot") == 2, parts(_TRIPLES)).otherwise(F.array(F.lit(-1).cast("long")))
    dealt = members.withColumn("block", F.explode(blocks))
    dealt = dealt.select("anchor", "block", "fp", "home").repartition("anchor", "block").sortWithinPartitions("anchor", "block")
    return dealt.mapInArrow(_compare(max_bits), "a long, b long").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: the smallest node of each node's component, for nodes with an edge.

    Alternates large-star and small-star steps; each pass is checkpointed and the loop ends when a
    pass changes nothing.
    """
    now = checkpointed(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())

    def digest(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = digest(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        now = checkpointed(small)
        if (new := digest(now)) == seen:
            break
        seen = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def rooted(nodes: DataFrame, max_bits: int = MAX_BITS, dense: int = DENSE) -> DataFrame:
    """nodes, one row per fingerprint fp, with their component's root, its smallest fingerprint."""
    comp = components(links(nodes.select("fp"), max_bits, dense))
    return nodes.join(comp, nodes["fp"] == comp["node"], "left").select(*nodes.columns, F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, dense: int = DENSE) -> DataFrame:
    """doc_id, fp, component_id: one row per row of docs; component_id is the smallest doc_id reachable."""
    fps = checkpointed(fingerprints(docs, id_col, text_col, words))
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = rooted(nodes, max_bits, dense)
    least = roots.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = roots.join(least, "root").select("fp", "component_id")
    # a fingerprint that a third of all rows share is on the rows' side only, where adaptive execution splits it
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """docs with one row of each component, all columns as they were.

    The one with the smallest id stays, a null id after all others; of one id the row with the
    smallest fingerprint and text hash; rows that repeat id and text are one.
    """
    fps = checkpointed(fingerprints(docs, id_col, text_col, words, hashed=True))
    no_id, some_id = (lambda c: F.col(c).isNull()), (lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")))
    first = F.struct(no_id("doc_id").alias("no_id"), some_id("doc_id").alias("id"), "fp", "text_hash")
    nodes = fps.groupBy("fp").agg(F.min(first).alias("first"))
    names = ("no_id", "id", "text_hash")
    keys = [unused(docs, k) for k in names]
    kept = rooted(nodes, max_bits).groupBy("root").agg(F.min("first").alias("first")).select(*(F.col("first")[n].alias(k) for n, k in zip(names, keys)))
    # both steps need rows dealt by the keys, so texts are shuffled once
    keyed = docs.withColumns(dict(zip(keys, (no_id(id_col), some_id(id_col), F.md5(text_of(text_col))))))
    return keyed.join(kept, keys, "left_semi").dropDuplicates(keys).drop(*keys)


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, its fingerprint and its component."""
    rows = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
