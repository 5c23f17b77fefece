"""Best-fit packing of documents into sequences in bulk-synchronous rounds.

Only documents longer than a sequence are cut: their last pieces fill whole sequences and the
first takes the rest. A round takes the pieces of one class of lengths (each class reaches down to
half of the one before) and the gaps that can hold any of them. Both are range-sorted, pieces by
length and gaps by what is left of them, and dealt by rank to tasks, so that each task has its share
of every size. A task sweeps from its longest piece down: each piece goes to its successor gap, the
smallest that holds it; where several pieces want one gap, the longer one, then the one of lower
rank, goes first and the others see the updated gap. Pieces that find no gap in their task meet the
gaps that all tasks left in a second sweep, where again the longer and lower-ranked goes first; only
what finds none there opens sequences. Pieces without a gap and gaps that would hold them are left
by different tasks only, so this second sweep is small and mostly one task's, unless gaps are short
everywhere; then it is dealt to tasks as the first was. The gaps that are left are range-sorted anew
for the next class. The driver sees numbers of pieces and gaps only.

With one task the result is that of best-fit decreasing.

Defined results: null text is the empty text and has the end id only; rows that repeat an id are
packed as documents of their own; pieces of equal length go in order of id, piece and checksum;
an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import checkpointed, pieces, text_of
from .tokens import default_tokenizer, encoder, id_arrays

MAX_TOKENS = 1024
#: Pieces for which there is one task, up to MAX_TASKS; beyond, tasks hold more: a round shuffles a block from each task to each.
TASK_PIECES = 20_000
MAX_TASKS = 2_000
_PIECE = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
_ROW = pa.schema([*_PIECE, ("sequence_id", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()), ("is_gap", pa.bool_()), ("deal", pa.int32())])
_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, size long, is_gap boolean, deal int"


def cut_documents(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece; all but a document's first have max_tokens tokens."""
    file = tokenizer or default_tokenizer()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(file)
        for batch in pieces(batches):
            ids, ends = id_arrays(coder.encode(batch.column("text"), end=True))
            n = np.diff(ends)
            count = -(-n // max_tokens)
            doc = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            first = n - (count - 1) * max_tokens
            start = np.where(piece > 0, first[doc] + (piece - 1) * max_tokens, 0)
            length = np.where(piece > 0, max_tokens, first[doc])
            raw, at = memoryview(np.ascontiguousarray(ids)).cast("B"), (ends[doc] + start) * 4
            sums = [crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + length * 4).tolist())]
            columns = [batch.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[name for name, _ in _PIECE])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sweep(lengths: list[int], gaps: list[int], max_tokens: int = MAX_TOKENS, opens: bool = True) -> tuple[list[int], list[int], list[int]]:
    """(place of each piece, its offset in that sequence's gap, what is left of each gap), pieces in descending order.

    Places beyond the given gaps are new sequences of max_tokens; a sweep that opens none gives -1
    instead. Of equal gaps, the one that was last made is taken.
    """
    at_size: dict[int, list[int]] = {}
    sizes: list[int] = []  # sizes that occur, ascending
    left, places, offsets = list(gaps), [], []

    def add(place: int, size: int) -> None:
        if size not in at_size:
            at_size[size] = []
            bisect.insort(sizes, size)
        at_size[size].append(place)

    for place, size in enumerate(gaps):
        add(place, size)
    room = list(gaps)
    for length in lengths:
        k = bisect.bisect_left(sizes, length)
        if k < len(sizes):
            size = sizes[k]
            place = at_size[size].pop()
            if not at_size[size]:
                del at_size[size], sizes[k]
        elif not opens:
            places.append(-1)
            offsets.append(0)
            continue
        else:
            size, place = max_tokens, len(left)
            left.append(size)
            room.append(size)
        places.append(place)
        offsets.append(room[place] - size)
        left[place] = size - length
        if left[place]:
            add(place, left[place])
    return places, offsets, left


def _task(sweep_: int, max_tokens: int, opens: bool):
    """One task of a sweep: its gaps, then its pieces, both by descending size, in; pieces, those without a place too, and gaps out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        n_gaps = int(table.column("is_gap").to_numpy().sum())
        gaps, mine = table.slice(0, n_gaps), table.slice(n_gaps)
        size = gaps.column("size").to_numpy()
        places, offsets, left = sweep(mine.column("length").to_pylist(), size.tolist(), max_tokens, opens)
        opened = (((sweep_ << 24) + TaskContext.get().partitionId()) << 32) + np.arange(len(left) - n_gaps)
        sequence = np.concatenate([gaps.column("sequence_id").to_numpy(), opened]).astype(np.int64)
        used = np.concatenate([gaps.column("offset").to_numpy(), np.zeros(len(opened), np.int64)]).astype(np.int64)
        place = np.array(places, np.int64)
        own = [mine.column(name).combine_chunks() for name, _ in _PIECE]
        at, lost = (sequence[place], used[place] + np.array(offsets, np.int64)) if len(sequence) else (place, place), place < 0
        yield pa.RecordBatch.from_arrays([*own, *(pa.array(x, mask=lost) for x in at), own[3], pa.array(np.zeros(len(place), bool)), pa.nulls(len(place), pa.int32())], schema=_ROW)
        rest = np.array(left, np.int64)
        order = np.flatnonzero(rest)
        total = np.concatenate([size, np.full(len(opened), max_tokens)]).astype(np.int64)
        none = [pa.nulls(len(order), t) for _, t in _PIECE]
        yield pa.RecordBatch.from_arrays([*none, pa.array(sequence[order]), pa.array(used[order] + total[order] - rest[order]), pa.array(rest[order]), pa.array(np.ones(len(order), bool)), pa.nulls(len(order), pa.int32())], schema=_ROW)

    return run


def _dealt(rows: DataFrame, tasks: int) -> DataFrame:
    """Pieces or gaps, range-sorted by size and dealt to the tasks in the order of their ranks."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId()
        for batch in batches:
            yield batch.set_column(_ROW.get_field_index("deal"), _ROW.field("deal"), pa.array(((np.arange(batch.num_rows) + at) % tasks).astype(np.int32)))
            at += batch.num_rows

    if tasks == 1:
        return rows.withColumn("deal", F.lit(0))
    order = [F.desc("size"), "sequence_id", "doc_id", "piece", "ids_crc32"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order, "start").mapInArrow(deal, _SQL)


def _swept(pieces_: DataFrame, gaps: DataFrame | None, tasks: int, sweep_: int, max_tokens: int, opens: bool) -> DataFrame:
    """The rows of one sweep over dealt pieces and gaps."""
    rows = pieces_ if gaps is None else pieces_.unionByName(_dealt(gaps, tasks))
    rows = rows.repartitionById(tasks, "deal").sortWithinPartitions(F.desc("is_gap"), F.desc("size"), "sequence_id", "doc_id", "piece", "ids_crc32", "start")
    return checkpointed(rows.mapInArrow(_task(sweep_, max_tokens, opens), _SQL))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS, task_pieces: int = TASK_PIECES, max_tasks: int = MAX_TASKS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece."""
    cut = checkpointed(cut_documents(docs, tokenizer, id_col, text_col, max_tokens))
    count = cut.count()
    of = lambda n: max(1, min(max_tasks, -(-n // task_pieces)))
    blank = {"sequence_id": "long", "offset": "long", "deal": "int"}
    rows = cut.withColumns({c: F.lit(None).cast(kind) for c, kind in blank.items()} | {"size": F.col("length"), "is_gap": F.lit(False)}).select(*_ROW.names)
    ranked = checkpointed(_dealt(rows, of(count)))
    # a piece that fills a sequence has no gap to look for: the first class holds what is over half a sequence
    placed, gaps, top, sweep_ = [], None, max_tokens, 1
    while top:
        low = top // 2
        mine = ranked.where((F.col("length") <= top) & (F.col("length") > low))
        found = _swept(mine, None if gaps is None else gaps.where(F.col("size") > low), of(count), sweep_, max_tokens, opens=gaps is None)
        waiting = None if gaps is None else gaps.where(F.col("size") <= low)
        placed.append(found.where("NOT is_gap AND sequence_id IS NOT NULL"))
        lost, gaps = found.where("NOT is_gap AND sequence_id IS NULL"), found.where("is_gap")
        n, least = lost.agg(F.count("*"), F.min("length")).first()
        if n:
            fit = gaps.where(F.col("size") >= least)
            tasks = of(n + fit.count())
            again = _swept(_dealt(lost, tasks), fit, tasks, sweep_ + 1, max_tokens, opens=True)
            placed.append(again.where("NOT is_gap"))
            gaps = gaps.where(F.col("size") < least).unionByName(again.where("is_gap"))
        if waiting is not None:  # these wait for shorter pieces
            gaps = gaps.unionByName(waiting)
        top, sweep_ = low, sweep_ + 2
    out = placed[0]
    for rows in placed[1:]:
        out = out.unionByName(rows)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
