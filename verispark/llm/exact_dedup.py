"""Exact dedup with Patricia-trie owners.

Rows are dealt to partitions by length and content hash of their normalised text. Each partition
inserts the full byte strings into a compressed radix trie; a terminal node stores the smallest
owner seen (most code points in the original text, then smallest id), the number of rows and the
content's hash. The trie counts its bytes, nodes included; beyond its budget the largest subtree is
spilled: its terminals are emitted and freed, the rest stays. A text that comes again after its
subtree was spilled starts a new terminal; such parts of one text are merged by hash at the end,
without their texts. Each map task first collapses its own copies in the same kind of trie, so a
group that holds a third of all rows reaches its owner as one row per task and spill.

Defined results: null text is the empty text, and all empty texts are equal; ties go to the
smallest id, a null id last; rows that repeat both id and text are one group, counted each;
an empty table gives no rows; other columns are untouched, also when they share the results' names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import pieces, text_of, unused

#: Bytes that a trie may hold before it spills its largest subtrees.
TRIE_BYTES = 32 << 20
#: Bytes of text that are hashed at once.
SHA_BYTES = 4 << 20
#: What a node takes besides its label: list, dictionary, label object, terminal.
NODE_BYTES = 600
_SPACE = b" \t\n\x0b\x0c\r"


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Patricia:
    """Compressed radix trie over byte strings; a node is [label, children by first byte, terminal, bytes of its subtree].

    A terminal is (owner, number of rows, hash).
    """

    def __init__(self):
        self.root = [b"", {}, None, 0]

    @property
    def bytes(self) -> int:
        return self.root[3]

    def insert(self, key: bytes, owner: tuple, n: int, digest: bytes) -> None:
        node, at, path = self.root, 0, [self.root]
        while at < len(key):
            child = node[1].get(key[at])
            if child is None:
                child = node[1][key[at]] = [key[at:] if at else key, {}, None, len(key) - at + NODE_BYTES]
                self._grow(path, child[3])
                node, at = child, len(key)
            elif key.startswith(child[0], at):
                node, at = child, at + len(child[0])
            else:
                label = child[0]
                same = _shared(label, key[at : at + len(label)])
                upper = [label[:same], {label[same]: child}, None, child[3] + NODE_BYTES]
                child[0] = label[same:]
                child[3] -= same
                self._grow(path, NODE_BYTES)
                node[1][key[at]] = upper
                node, at = upper, at + same
            path.append(node)
        held = node[2]
        node[2] = (owner, n, digest) if held is None else (min(owner, held[0]), held[1] + n, digest)

    @staticmethod
    def _grow(path: list[list], size: int) -> None:
        for node in path:
            node[3] += size

    def spill(self, budget: int) -> Iterator[tuple[bytes, tuple, int, bytes]]:
        """Terminals of the largest subtrees, freed, until at most budget bytes are left.

        The walk goes down the largest children as long as they hold more than what must go.
        """
        while self.bytes > budget:
            prefix, path = b"", [self.root]
            while True:
                first, child = max(path[-1][1].items(), key=lambda c: c[1][3])
                if child[3] <= self.bytes - budget or not child[1]:
                    break
                prefix += child[0]
                path.append(child)
            self._cut(path, first, child)
            while len(path) > 1 and not path[-1][1] and path[-1][2] is None:  # holds nothing any more
                empty = path.pop()
                self._cut(path, empty[0][0], empty)
            yield from self._terminals(prefix, child)

    @staticmethod
    def _cut(path: list[list], first: int, child: list) -> None:
        del path[-1][1][first]
        Patricia._grow(path, -child[3])

    def drain(self) -> Iterator[tuple[bytes, tuple, int, bytes]]:
        """Every terminal's key, owner, count and hash; subtrees are freed as they are passed."""
        root, self.root = self.root, [b"", {}, None, 0]
        yield from self._terminals(b"", root)

    @staticmethod
    def _terminals(prefix: bytes, top: list) -> Iterator[tuple[bytes, tuple, int, bytes]]:
        stack = [(prefix, top)]
        while stack:
            prefix, node = stack.pop()
            key = prefix + node[0]
            if node[2] is not None:
                yield key, *node[2]
            stack += [(key, child) for child in node[1].values()]
            node[1] = {}


def normalised(text: bytes) -> bytes:
    """text without space, tab, line feed, vertical tab, form feed and carriage return."""
    return text.translate(None, _SPACE)


_PART = [("hash", pa.int64()), ("n_bytes", pa.int64()), ("neg_chars", pa.int64()), ("no_id", pa.bool_()), ("id", pa.int64()), ("n", pa.int64()), ("sha", pa.binary())]
_PART_SQL = "hash long, n_bytes long, neg_chars long, no_id boolean, id long, n long, sha binary"
_FULL = [*_PART, ("body", pa.binary())]


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(body, owner, 1, hash) of rows (id, text)."""
    chars = pc.utf8_length(batch.column("text")).to_pylist()
    for text, n, i in zip(batch.column("text").cast(pa.binary()).to_pylist(), chars, batch.column("id").to_pylist()):
        body = normalised(text)
        yield body, (-n, i is None, i or 0), 1, sha256(body).digest()


def _parts(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(body, owner, count, hash) of rows that a trie emitted."""
    for body, neg, none, i, n, sha in zip(*(batch.column(c).to_pylist() for c in ("body", "neg_chars", "no_id", "id", "n", "sha"))):
        yield body, (neg, none, i), n, sha


def _owners(trie_bytes: int, read, text: str, bodies: bool):
    """Rows in, one row per distinct text and spill out, with the text if bodies."""
    schema = pa.schema(_FULL if bodies else _PART)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Patricia()

        def emit(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            rows, size = [], 0
            for key, (neg, none, i), n, sha in found:
                row = (int.from_bytes(sha[:8], "little", signed=True), len(key), neg, none, i, n, sha)
                rows.append((*row, key) if bodies else row)
                size += len(key) if bodies else 0
                if len(rows) >= 5000 or size > 8 << 20:
                    yield batch_of(rows)
                    rows, size = [], 0
            if rows:
                yield batch_of(rows)

        for batch in pieces(batches, text):
            for row in read(batch):
                trie.insert(*row)
                if trie.bytes > trie_bytes:
                    yield from emit(trie.spill(trie_bytes // 2))
        yield from emit(trie.drain())

    return run


def _groups(docs: DataFrame, id_col: str, text_col: str, trie_bytes: int) -> DataFrame:
    """sha, owner (neg_chars, no_id, id), group_size: one row per distinct normalised text."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    local = rows.mapInArrow(_owners(trie_bytes, _rows, "text", True), f"{_PART_SQL}, body binary")
    met = local.repartition("n_bytes", "hash").mapInArrow(_owners(trie_bytes, _parts, "body", False), _PART_SQL)
    # a text whose subtree was spilled has a row per spill
    return met.groupBy("sha").agg(F.min(F.struct("neg_chars", "no_id", "id")).alias("owner"), F.sum("n").alias("group_size"))


def _sha(text: Column) -> Column:
    """SHA-256 of a normalised text; never null, so a join on it needs no filter that would hash texts once more."""

    @F.arrow_udf("binary")
    def run(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], names=["text"])
        return pa.array([sha256(normalised(x)).digest() for piece in pieces(iter([batch]), size=SHA_BYTES) for x in piece.column("text").cast(pa.binary()).to_pylist()], pa.binary())

    return F.coalesce(run(text), F.lit(b""))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """text_sha256, keep_id, group_size: one row per distinct normalised text."""
    found = _groups(docs, id_col, text_col, trie_bytes)
    return found.select(F.lower(F.hex("sha")).alias("text_sha256"), F.when(~F.col("owner.no_id"), F.col("owner.id")).alias("keep_id"), "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of docs.

    The groups have one row per text, so a large group is on the rows' side only, where adaptive
    execution splits it.
    """
    mine = docs.select(F.col(id_col).cast("long").alias("doc_id"), _sha(text_of(text_col)).alias("sha"))
    found = _groups(docs, id_col, text_col, trie_bytes).select("sha", F.when(~F.col("owner.no_id"), F.col("owner.id")).alias("keep_id"), "group_size")
    out = mine.join(found, "sha")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """docs with the owner of each text only, all columns as they were.

    Rows that repeat an owner's id, text and length are copies too: one of them stays.
    """
    sha, chars, no_id, some_id = (unused(docs, c) for c in ("sha", "neg_chars", "no_id", "id"))
    keys = [sha, chars, no_id, some_id]
    owner = {chars: "neg_chars", no_id: "no_id", some_id: "id"}
    owners = _groups(docs, id_col, text_col, trie_bytes).select(F.col("sha").alias(sha), *(F.col("owner")[c].alias(k) for k, c in owner.items()))
    i = F.col(id_col).cast("long")
    mine = docs.withColumns({sha: _sha(text_of(text_col)), chars: (-F.char_length(text_of(text_col))).cast("long"), no_id: i.isNull(), some_id: F.coalesce(i, F.lit(0).cast("long"))})
    # both steps need rows dealt by the keys, so texts are shuffled once
    return mine.join(owners, keys, "left_semi").dropDuplicates(keys).drop(*keys)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and the copy that stays."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS body FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
  doc_id = first_value(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM d WINDOW w AS (PARTITION BY body ORDER BY n DESC, doc_id)
"""
