"""Token-id output by bit-plane shuffling.

Documents are sorted by id, encoded, and written as rows of a Parquet dataset. A row is one chunk
of whole documents: its ids are cut into blocks of a fixed size, each block is transposed into
byte planes (or bit planes), each plane is compressed with zstandard, and the row's chunk index
holds the planes' sizes, the documents' ids and their numbers of tokens. Parquet is the carrier,
so that Spark's commit protocol covers lost executors and any file system works.

Defined results: null text is the empty text (it still gets the end id); a null id sorts first;
rows that repeat an id, or have none, stay, in order of their texts' XXH64; an empty table gives an empty dataset; columns other
than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import new_path, pieces, text_of
from .tokens import default_tokenizer, encoder, id_arrays

BLOCK_IDS = 16_384
CHUNK_IDS = 1 << 20
LEVEL = 3
#: Shards whose offsets are broadcast on reading: 16 bytes each.
MAX_SHARDS = 1_000_000
_CHUNK = "shard int, chunk int, first long, n_ids long, doc_ids array<long>, doc_lens array<long>, mode string, block_ids int, plane_sizes array<int>, planes binary"


def pack(ids: np.ndarray, mode: str = "byte", block_ids: int = BLOCK_IDS, level: int = LEVEL) -> tuple[list[int], bytes]:
    """Sizes of the compressed planes, block by block, and the planes. A plane of zeros has size 0."""
    import zstandard

    press, sizes, out = zstandard.ZstdCompressor(level=level), [], []
    for at in range(0, len(ids), block_ids):
        block = np.ascontiguousarray(ids[at : at + block_ids], "<u4")
        by_byte = block.view(np.uint8).reshape(-1, 4).T
        planes = by_byte if mode == "byte" else [np.packbits((by_byte[k // 8] >> (k % 8)) & 1) for k in range(32)]
        for plane in planes:
            raw = press.compress(plane.tobytes()) if plane.any() else b""
            sizes.append(len(raw))
            out.append(raw)
    return sizes, b"".join(out)


def unpack(sizes: list[int], planes: bytes, n_ids: int, mode: str = "byte", block_ids: int = BLOCK_IDS) -> np.ndarray:
    """The ids that pack() was given."""
    import zstandard

    press, out, at, k = zstandard.ZstdDecompressor(), np.zeros((n_ids, 4), np.uint8), 0, 0
    for first in range(0, n_ids, block_ids):
        block = out[first : first + block_ids]
        for p in range(4 if mode == "byte" else 32):
            if size := sizes[k]:
                raw = np.frombuffer(press.decompress(planes[at : at + size]), np.uint8)
                if mode == "byte":
                    block[:, p] = raw
                else:
                    block[:, p // 8] |= np.unpackbits(raw, count=len(block)) << (p % 8)
            at, k = at + size, k + 1
    return out.reshape(-1).view("<u4")


def write_token_ids(docs: DataFrame, path: str, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", mode: str = "byte", block_ids: int = BLOCK_IDS, chunk_ids: int = CHUNK_IDS, level: int = LEVEL) -> None:
    """Write the ids of all documents, in ascending id order, to path.

    A shard is one sorted partition. A chunk is cut at a document's end once it has chunk_ids ids,
    so memory is bounded by chunk_ids and the longest document.
    """
    if mode not in ("byte", "bit"):
        raise ValueError("mode is 'byte' or 'bit'")
    file = tokenizer or default_tokenizer()
    schema = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lens", pa.list_(pa.int64())), ("mode", pa.string()), ("block_ids", pa.int32()), ("plane_sizes", pa.list_(pa.int32())), ("planes", pa.binary())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard = encoder(file), TaskContext.get().partitionId()
        chunk = first = held = 0
        keys, lens, parts = [], [], []

        def flush() -> pa.RecordBatch:
            sizes, planes = pack(np.concatenate(parts), mode, block_ids, level)
            row = [shard, chunk, first, held, np.concatenate(keys), np.concatenate(lens), mode, block_ids, sizes, planes]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        for batch in pieces(batches):
            ids, ends = id_arrays(coder.encode(batch.column("text"), end=True))
            key, at = np.array(batch.column("doc_id").to_pylist(), object), 0
            while at < batch.num_rows:
                # up to the document that fills the chunk
                to = min(batch.num_rows, int(np.searchsorted(ends[1:], ends[at] + chunk_ids - held)) + 1)
                keys.append(key[at:to])
                lens.append(np.diff(ends[at : to + 1]))
                parts.append(ids[ends[at] : ends[to]])
                held += int(ends[to] - ends[at])
                at = to
                if held >= chunk_ids:
                    yield flush()
                    chunk, first, held, keys, lens, parts = chunk + 1, first + held, 0, [], [], []
        if held:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    # the hash spreads rows of one id, or of none, over partitions
    order = ["doc_id", F.xxhash64("text")]
    coded = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").mapInArrow(write, _CHUNK)
    coded.write.mode("errorifexists").option("compression", "none").parquet(path)  # planes are compressed


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit)."""
    chunks = spark.read.schema(_CHUNK).parquet(path)
    # one row per shard: as many as the writer had partitions
    shards = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = shards.select("shard", before.alias("shard_start"))
    if chunks.where("chunk = 0").count() <= MAX_SHARDS:  # else ids are shuffled to their shard's offset
        shards = F.broadcast(shards)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                c = {k: batch.column(k)[row] for k in batch.schema.names}
                raw = unpack(c["plane_sizes"].as_py(), c["planes"].as_buffer(), c["n_ids"].as_py(), c["mode"].as_py(), c["block_ids"].as_py())
                keys, lens = c["doc_ids"].values, c["doc_lens"].values.to_numpy()
                ends = np.append(0, np.cumsum(lens))
                for at in range(0, len(lens), 1000):
                    part = slice(at, at + 1000)
                    n, own = len(lens[part]), raw[ends[at] : ends[at : at + 1001][-1]]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(n, c["shard"].as_py(), np.int32)), keys[part], pa.array(ends[:-1][part] + c["first"].as_py()), pa.array(lens[part]),
                        pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(((ends[at : at + n + 1] - ends[at]) * 4).astype(np.int32)), pa.py_buffer(own)]),
                    ], names=["shard", "doc_id", "in_shard", "n_tokens", "ids"])

    rows = chunks.mapInArrow(read, "shard int, doc_id long, in_shard long, n_tokens long, ids binary")
    return rows.join(shards, "shard").select("doc_id", (F.col("shard_start") + F.col("in_shard")).alias("start"), "n_tokens", "ids")


def op3_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every document's ids, read the files back and return their digest."""
    path = new_path(spark, "token_ids")
    write_token_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_token_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
