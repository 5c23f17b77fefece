"""Benchmark decontamination with a broadcast hash set of test n-grams.

Texts are normalised (A-Z to lower case; words are runs of 0-9, a-z and anything beyond ASCII).
Every window of NGRAM words of a benchmark item is a key of a hash table that is broadcast; an item
with fewer words is one window. Training windows are scanned in whole documents: a word table
rules out almost all positions, the rest are looked up, and equality of the whole window's bytes
verifies the hit. Contaminated documents or the hit spans can be removed.

The table is broadcast only if the benchmark has at most MAX_WINDOWS windows, which is counted
first; beyond that, a Bloom filter of at most FILTER_WORDS words is broadcast instead, and the
positions that pass it are joined with the windows by a shuffle, with the same results.

Defined results: null or empty text has no words; null or empty benchmark texts have no windows;
items with a null id mark words as hit but aren't listed; items that repeat a text are all listed;
an empty benchmark marks nothing; rows that repeat an id are scanned each; windows that overlap or tie
hit each word once; an empty table gives no rows; other columns stay, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import checkpointed, pieces, text_of, unused

NGRAM = 10
#: Windows that may be broadcast: some 100 bytes each, so 100 MB at most.
MAX_WINDOWS = 1_000_000
#: 64-bit words of the filter before a join: 64 MB at most, with more false positives for a larger benchmark.
FILTER_WORDS = 1 << 23
#: A hash sets four bits of its word; the word is told by the lowest bits.
_SHIFTS = (24, 30, 36, 42)
#: Parts that a window's occurrences are dealt to in a join, whatever its share of all.
SALTS = 64
#: Windows that a task holds before it passes them on.
HELD = 100_000
#: Every byte that isn't part of a word becomes a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: The same words in the original text.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_HITS = "struct<n_words: bigint, n_hit: bigint, item_ids: array<string>, spans: array<struct<start: bigint, end: bigint>>>"
_HITS_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def words_of(text: str) -> list[bytes]:
    """The normalised words of a text, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def windows_of(words: list[bytes], n: int = NGRAM) -> list[bytes]:
    """The windows of an item's words."""
    if not words:
        return []
    return [b" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))]


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", n: int = NGRAM) -> DataFrame:
    """window, n_words, item_ids: one row per distinct window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                found = windows_of(words_of(text), n)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array([w.count(b" ") + 1 for w in found], pa.int32()), pa.array([item] * len(found), pa.string())], names=["window", "n_words", "item"])

    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), text_of(text_col).alias("text")).mapInArrow(run, "window binary, n_words int, item string")
    return rows.groupBy("window", "n_words").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))


def _spans(text: str, hit: np.ndarray) -> list[dict]:
    """Runs of hit words as character spans."""
    places = [m.span() for m in _WORD.finditer(text)]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [{"start": places[a][0], "end": places[b - 1][1]} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]


def _row(text: str, words: list[bytes], found: list[tuple[int, int]], items: list[str]) -> dict:
    """found has the first word and the number of words of each hit."""
    if not found:
        return {"n_words": len(words), "n_hit": 0, "item_ids": [], "spans": []}
    step = np.zeros(len(words) + 1, np.int64)
    for at, k in found:
        step[at] += 1
        step[at + k] -= 1
    hit = np.cumsum(step[:-1]) > 0
    return {"n_words": len(words), "n_hit": int(hit.sum()), "item_ids": items, "spans": _spans(text, hit)}


def _scanner(spark: SparkSession, windows: DataFrame) -> Column:
    """hits(text) by the broadcast table."""
    table = {bytes(r["window"]): list(r["item_ids"]) for r in windows.collect()}  # counted before: at most max_windows
    sent = spark.sparkContext.broadcast((table, {w: 1 for key in table for w in key.split(b" ")}, sorted({k.count(b" ") + 1 for k in table})))

    @F.arrow_udf(_HITS)
    def hits(texts: pa.Array) -> pa.Array:
        table, known, sizes = sent.value
        rows = []
        for text in texts.to_pylist():
            words, found, of = words_of(text), [], set()
            misses = np.concatenate([[0], np.cumsum(1 - np.fromiter(map(known.get, words, repeat(0)), np.int64, len(words)))])
            for k in sizes:
                for at in np.flatnonzero(misses[k:] == misses[:-k]).tolist() if k <= len(words) else ():
                    if (items := table.get(b" ".join(words[at : at + k]))) is not None:
                        found.append((at, k))
                        of.update(items)
            rows.append(_row(text, words, found, sorted(of)))
        return pa.array(rows, _HITS_ARROW)

    return hits


def _bits(hashes: np.ndarray) -> np.ndarray:
    """The bits that hashes set in their words of a filter."""
    out = np.zeros(len(hashes), np.uint64)
    for shift in _SHIFTS:
        out |= np.uint64(1) << ((hashes >> np.uint64(shift)) & np.uint64(63))
    return out


def window_filter(windows: DataFrame, count: int, max_words: int = FILTER_WORDS) -> np.ndarray:
    """A Bloom filter of the column hash: about four windows a word, but never more than max_words (a power of two) words."""
    words = min(max_words, 1 << max(6, (count // 4).bit_length()))
    bits = " | ".join(f"shiftleft(1L, CAST(shiftrightunsigned(hash, {s}) & 63 AS INT))" for s in _SHIFTS)
    rows = windows.groupBy(F.expr(f"hash & {words - 1}L").alias("word")).agg(F.expr(f"bit_or({bits})").alias("bits")).toArrow()  # at most a row a word
    out = np.zeros(words, np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def passing(texts: Iterator[tuple[bytes, str]], sizes: list[int], table: np.ndarray, held: int = HELD) -> Iterator[tuple[list, list, list, np.ndarray]]:
    """(keys, first words, windows, hashes) of the windows that pass the filter, some held of them at a time."""
    from xxhash import xxh64_digest

    keys, ats, found, hashes = [], [], [], [np.zeros(0, np.uint64)]
    for key, text in texts:
        words = words_of(text)
        for k in sizes:
            for start in range(0, len(words) - k + 1, held):
                windows = [b" ".join(words[at : at + k]) for at in range(start, min(start + held, len(words) - k + 1))]
                h = np.frombuffer(b"".join(map(xxh64_digest, windows)), "<u8")
                bits = _bits(h)
                passed = np.flatnonzero((table[h & np.uint64(len(table) - 1)] & bits) == bits)
                keys += [key] * len(passed)
                ats += (start + passed).tolist()
                found += [windows[p] for p in passed.tolist()]
                hashes.append(h[passed])
                if len(found) >= held:
                    yield keys, ats, found, np.concatenate(hashes)
                    keys, ats, found, hashes = [], [], [], [np.zeros(0, np.uint64)]
    if found:
        yield keys, ats, found, np.concatenate(hashes)


def _joined(docs: DataFrame, windows: DataFrame, count: int, text: str, into: str, max_words: int) -> DataFrame:
    """docs with a column of hits by a shuffle on the windows, for a benchmark too large to broadcast.

    Positions that pass the filter go by their text's SHA-256, so that equal texts count once and
    different ones never share hits; no text is shuffled for the search. Windows meet by XXH64 and
    bytes, a window's occurrences in SALTS parts. Hits and items come back as two lists a text.
    """

    @F.arrow_udf("bigint")
    def hash_of(windows: pa.Array) -> pa.Array:
        from xxhash import xxh64_digest

        return pa.array(np.frombuffer(b"".join(xxh64_digest(w) for w in windows.to_pylist()), "<i8"))

    table = checkpointed(windows.withColumn("hash", hash_of("window")))
    sizes = sorted(r[0] for r in table.select("n_words").distinct().collect())  # at most NGRAM values
    sent = docs.sparkSession.sparkContext.broadcast(window_filter(table, count, max_words))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = zip(batch.column("key").to_pylist(), batch.column("text").to_pylist())
            for keys, ats, found, hashes in passing(texts, sizes, sent.value):
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ats, pa.int32()), pa.array(found, pa.binary()), pa.array(hashes.view(np.int64))], names=["key", "at", "window", "hash"])

    @F.arrow_udf(_HITS)
    def assemble(texts: pa.Array, places: pa.Array, items: pa.Array) -> pa.Array:
        return pa.array([_row(t, words_of(t), [(p["at"], p["n_words"]) for p in found or []], of or []) for t, found, of in zip(texts.to_pylist(), places.to_pylist(), items.to_pylist())], _HITS_ARROW)

    name, places, items = unused(docs, "text_sha256"), unused(docs, "windows_found"), unused(docs, "items_found")
    key = F.unhex(F.sha2(text_of(text), 256))
    seen = docs.select(key.alias("key"), text_of(text).alias("text")).mapInArrow(scan, "key binary, at int, window binary, hash bigint")
    # copies of a text collapse before their shuffle, so a text with a third of all rows counts once
    seen = checkpointed(seen.dropDuplicates(["key", "at", "window"]).withColumn("salt", F.pmod(F.xxhash64("key", "at"), F.lit(SALTS)).cast("int")))
    # only the parts in which a window occurs, each once, meet the windows
    parts = seen.select("hash", "salt", "window").distinct().join(table, ["hash", "window"])
    found = seen.join(parts, ["hash", "salt", "window"]).select("key", "at", "n_words", "window", "item_ids")
    hits = found.groupBy("key").agg(F.collect_list(F.struct("at", "n_words")).alias(places))
    of = found.select("key", "window", "item_ids").dropDuplicates(["key", "window"]).select("key", F.explode("item_ids").alias("item")).groupBy("key").agg(F.array_sort(F.collect_set("item")).alias(items))
    rows = docs.withColumn(name, key).join(hits.join(of, "key", "left").withColumnRenamed("key", name), name, "left")
    return rows.withColumn(into, assemble(text_of(text), F.col(places), F.col(items))).drop(name, places, items)


def with_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = NGRAM, max_windows: int = MAX_WINDOWS, max_words: int = FILTER_WORDS, into: str = "hits") -> DataFrame:
    """docs with a column more: n_words, n_hit, item_ids and the character spans of hit words."""
    windows = item_windows(benchmark, item_id, item_text, n)
    count = windows.count()
    if count > max_windows:
        return _joined(docs, windows, count, text_col, into, max_words)
    return docs.withColumn(into, _scanner(docs.sparkSession, windows)(text_of(text_col)))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids, spans: one row per row of docs."""
    into = unused(docs, "hits")
    return with_hits(docs, benchmark, into=into, **options).select(F.col(id_col).alias("doc_id"), F.col(f"{into}.*"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "document", text_col: str = "text", **options) -> DataFrame:
    """docs without the contaminated documents, or (mode 'span') with the hit spans cut out of their texts."""
    into = unused(docs, "hits")
    rows = with_hits(docs, benchmark, text_col, into=into, **options)
    if mode == "document":
        return rows.where(F.col(into)["n_hit"] == 0).drop(into)
    if mode != "span":
        raise ValueError("mode is 'document' or 'span'")
    spans, text = F.col(into)["spans"], F.col(text_col)
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
    ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.char_length(text).cast("long")))
    kept = F.array_join(F.zip_with(starts, ends, lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))), "")
    return rows.withColumn(text_col, F.when(F.size(spans) > 0, kept).otherwise(text)).drop(into)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's hits against the whole benchmark."""
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP5_SQL = f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SQL_WORDS} AS ws FROM benchmark),
iw AS (
  SELECT item, len(ws) AS k, array_to_string(ws, ' ') AS win FROM i WHERE len(ws) BETWEEN 1 AND 9
  UNION ALL SELECT item, 10, array_to_string(ws[p : p + 9], ' ') FROM (SELECT item, ws, unnest(range(1, len(ws) - 8)) AS p FROM i WHERE len(ws) >= 10)
),
d AS (SELECT doc_id, {_SQL_WORDS} AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM d),
dw AS (SELECT doc_id, p, k, array_to_string(ws[p : p + k - 1], ' ') AS win FROM p, (SELECT DISTINCT k FROM iw) WHERE p + k - 1 <= len(ws)),
m AS (SELECT DISTINCT doc_id, p, dw.k, item FROM dw JOIN iw ON dw.win = iw.win),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY 1)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
