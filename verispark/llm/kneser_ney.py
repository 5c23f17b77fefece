"""LM scoring with an interpolated modified Kneser-Ney n-gram model.

Counting: each task turns its texts into word hashes, counts its own n-grams and deals them, packed
in columns, to shards by n-gram hash, so that a frequent word's n-grams are spread over all shards.
A shard adds the counts up and writes its sorted hash array to the shared folder. What it knows of
shorter grams (continuation counts, and as contexts their totals and numbers of n-grams seen once,
twice and more) is dealt on to the shards of the next shorter grams, down to words. Scoring:
workers memory-map the arrays and look up the distinct grams of each piece of the corpus.

Shards are sized by bytes of training text, so their memory is bounded and the model grows with
the corpus on disk only. A shard is one file; a worker keeps MAX_OPEN of them mapped at once. With
bigrams a piece of text asks a shard once at most, for all that is known of its grams, so with more
shards it opens each of them once, which takes some 0.1 ms, as the places of a file's arrays stand
in its first bytes. Files are written under a task-own name and then renamed, so a repeated task
leaves the same file.

Words are identified by their XXH64 and longer grams, while they are counted, by their words, so
counts of words are exact. In the files longer grams have 48 bits within their shard: at two million
entries a shard, about seven in a billion unseen grams are taken for seen ones.

Defined results: null text is the empty text, whose only token is the end; without training rows
every token has probability 1; grams that begin a text are counted as often as they occur, all
other shorter grams by what stands before them; rows that repeat an id count and are scored each;
a very long text is one like any other; an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import mmap
import os
import sys
from array import array
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import fold_of, give_back, new_path, pieces, posix_path, text_of

ORDER = 2
#: Bytes of training text for which there is one shard of n-grams; words have one for two of them.
SHARD_BYTES = 14 << 20
KEY_BITS = 48
#: Bits of a hash that choose the shard.
PLACE_BITS = 24
#: Words whose hashes a worker keeps, and shards that it keeps mapped.
MEMO = 400_000
MAX_OPEN = 8_000 if sys.version_info >= (3, 13) else 200
#: Bytes of text that are counted or scored at once.
PIECE = 8 << 20
#: Fixed values of the files: names of arrays, and bytes for the places of each.
_ARRAYS = ("key", "high", "low", "count", "count+", "raw", "raw+", "total", "total+", "n1", "n1+", "n2", "n2+", "n3", "n3+")
_TYPES = {"key": "<u8", "high": "<u4", "low": "<u2"}
_END, _START = b" ", b"  "  # no word has a space
#: What is known of a gram: its count as a shorter gram, how often it occurs, and its extensions' total and numbers of counts 1, 2 and more.
_STATS = ("count", "raw", "total", "n1", "n2", "n3")
_U = np.uint64


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= MEMO:
            self.clear()
        self[word] = out = xxh64_intdigest(word)
        return out


_hashes = _Hashes()


def tokens_of(texts: list[str], order: int = ORDER) -> tuple[list[np.ndarray], np.ndarray]:
    """(the words of every token's n-gram, first to last, as hashes; numbers of tokens of each text); each text ends with the end token."""
    get, flat, n = _hashes.__getitem__, array("Q"), np.empty(len(texts), np.int64)
    end = get(_END)
    for k, x in enumerate(texts):  # a text's words are gone before the next one's come
        before = len(flat)
        flat.extend(map(get, x.encode("utf-8", "surrogatepass").lower().split()))
        flat.append(end)
        n[k] = len(flat) - before
    words = np.frombuffer(flat, _U) if len(flat) else np.zeros(0, _U)
    out, starts, begin = [words], np.cumsum(n) - n, _U(get(_START))
    for _ in range(order - 1):
        before = np.roll(out[0], 1)
        before[starts] = begin
        out.insert(0, before)
    return out, n


def gram_hash(words: list[np.ndarray]) -> np.ndarray:
    """64 mixed bits of grams of word hashes; a single word is its own hash."""
    h = words[0]
    for w in words[1:]:
        h = h * _U(0x9E3779B97F4A7C15) + w
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> _U(shift))) * _U(by)
        h ^= h >> _U(31)
    return h


def place(h: np.ndarray, shards: int, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard and key of grams' hashes; shards are ranges of hashes, a word's key is its whole hash."""
    shard = ((h >> _U(64 - PLACE_BITS)) * _U(shards) >> _U(PLACE_BITS)).astype(np.int64)
    return shard, h if level == 1 else h & _U((1 << KEY_BITS) - 1)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of unsigned integers; the first is ascending and kept as differences."""
    import zstandard

    out, shrink = [np.array([len(columns), len(columns[0])], "<i8").tobytes()], zstandard.ZstdCompressor(level=1).compress
    for k, c in enumerate(columns):
        c = c.astype(_U)
        c = np.diff(c, prepend=_U(0)) if k == 0 else c
        width = max(1, (int(c.max(initial=0)).bit_length() + 7) // 8)
        planes = np.ascontiguousarray(c, "<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        raw = shrink(np.ascontiguousarray(planes.T).tobytes())
        out += [np.array([width, len(raw)], "<i8").tobytes(), raw]
    return b"".join(out)


def unpack(blob: bytes) -> list[np.ndarray]:
    """The columns that pack() was given."""
    import zstandard

    (k, n), at, out, grow = np.frombuffer(blob, "<i8", 2), 16, [], zstandard.ZstdDecompressor().decompress
    for i in range(k):
        width, size = np.frombuffer(blob, "<i8", 2, at)
        at += 16
        full = np.zeros((n, 8), np.uint8)
        full[:, :width] = np.frombuffer(grow(blob[at : at + size]), np.uint8).reshape(width, n).T
        c = full.reshape(-1).view("<u8")
        out.append(np.cumsum(c, dtype=_U) if i == 0 else c)
        at += size
    return out


def _summed(words: list[np.ndarray], *columns: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The place of one row of each distinct gram, and the columns' sums; grams of one hash but other words stay apart."""
    h = gram_hash(words)
    if not len(h):
        return np.zeros(0, np.int64), [c[:0] for c in columns]
    order = np.argsort(h)
    new = np.append(True, np.diff(h[order]) != 0)
    other = np.append(True, np.any([np.diff(w[order]) != 0 for w in words], axis=0))
    if np.any(other & ~new):
        order = np.lexsort((*words[::-1], h))
        other = np.append(True, np.any([np.diff(w[order]) != 0 for w in words], axis=0))
    first = np.flatnonzero(other)
    return order[first], [np.add.reduceat(c[order], first) for c in columns]


def _save(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """One file: where each of _ARRAYS begins and how long it is, then the arrays, each from a multiple of 16 bytes on."""
    os.makedirs(folder, exist_ok=True)
    index, at, parts = np.zeros((len(_ARRAYS), 2), "<i8"), 16 * len(_ARRAYS), []
    for k, a in arrays.items():
        raw = a.tobytes() + b"\0" * (-a.nbytes % 16)
        index[_ARRAYS.index(k)] = at, len(a)
        at += len(raw)
        parts.append(raw)
    own = f"{folder}/.{name}-{TaskContext.get().taskAttemptId()}"
    with open(own, "wb") as f:
        f.write(index.tobytes())
        f.writelines(parts)
    os.replace(own, f"{folder}/{name}")


def _small(name: str, values: np.ndarray) -> dict[str, np.ndarray]:
    """Counts in a byte each; those from 255 on stand in a list of (place, count) besides."""
    big = np.flatnonzero(values >= 255)
    return {name: np.minimum(values, 255).astype("<u1"), f"{name}+": np.stack([big.astype(np.int64), values[big].astype(np.int64)], axis=1).ravel().astype("<i8")}


def _keys(key: np.ndarray, level: int) -> dict[str, np.ndarray]:
    return {"key": key.astype("<u8")} if level == 1 else {"high": (key >> _U(16)).astype("<u4"), "low": (key & _U(0xFFFF)).astype("<u2")}


#: A mapping that holds no file descriptor, where Python knows that.
_UNTRACKED = {"trackfd": False} if sys.version_info >= (3, 13) else {}


class Shard:
    """A mapped file of grams."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            raw = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **_UNTRACKED)
        index = np.frombuffer(raw, "<i8", 2 * len(_ARRAYS)).reshape(-1, 2).tolist()
        self.arrays = {k: np.frombuffer(raw, _TYPES.get(k, "<i8" if k.endswith("+") else "<u1"), n, at) for k, (at, n) in zip(_ARRAYS, index) if at}

    def find(self, key: np.ndarray) -> np.ndarray:
        """Where each key stands, or -1."""
        found, open_, a = np.full(len(key), -1, np.int64), np.arange(len(key)), self.arrays
        if "key" in a:
            at = np.searchsorted(a["key"], key)
            open_ = open_[at < len(a["key"])]
            open_ = open_[a["key"][at[open_]] == key[open_]]
            found[open_] = at[open_]
            return found
        high, low = (key >> _U(16)).astype(np.uint32), (key & _U(0xFFFF)).astype(np.uint16)
        at = np.searchsorted(a["high"], high)
        while len(open_):
            open_ = open_[at[open_] < len(a["high"])]
            open_ = open_[a["high"][at[open_]] == high[open_]]
            same = a["low"][at[open_]] == low[open_]
            found[open_[same]] = at[open_[same]]
            open_ = open_[~same]
            at[open_] += 1
        return found

    def values(self, name: str, found: np.ndarray) -> np.ndarray:
        """The counts at places that find() gave; 0 for -1."""
        if name not in self.arrays or not len(self.arrays[name]):
            return np.zeros(len(found), np.int64)
        out = np.where(found >= 0, self.arrays[name][np.maximum(found, 0)], 0).astype(np.int64)
        if (big := np.flatnonzero(out == 255)).size:
            more = self.arrays[f"{name}+"].reshape(-1, 2)
            out[big] = more[np.searchsorted(more[:, 0], found[big]), 1]
        return out


_open: OrderedDict[str, Shard | None] = OrderedDict()


def _shard(path: str) -> Shard | None:
    """The shard of a path, None if nothing was written for it; the least recently used one is closed."""
    if path in _open:
        _open.move_to_end(path)
    else:
        while len(_open) >= MAX_OPEN:
            _open.popitem(last=False)
        try:
            _open[path] = Shard(path)
        except FileNotFoundError:
            _open[path] = None
    return _open[path]


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows of each shard; the rows come sorted by shard."""
    shard, held = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if r["shard"] != shard and held:
                yield shard, held
                held = []
            shard = r["shard"]
            held.append(r)
    if held:
        yield shard, held


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Discounts of counts 1, 2 and 3 or more, from the numbers of counts 1 to 4."""
    if not (n1 and n2):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2 - 3 * y * n3 / n2)
    return tuple(min(max(d, 0.1), k) for d, k in zip(found, (0.95, 1.9, 2.85)))


def _discount(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(c, 3)]


@dataclass(frozen=True)
class Model:
    """Where the sorted hash arrays are, and the corpus totals; discounts are those of words, bigrams and so on."""

    folder: str
    order: int
    shards: tuple[int, ...]
    tokens: int
    types: int
    continuations: int
    discounts: tuple[tuple[float, float, float], ...]
    mass: float

    def look_up(self, level: int, h: np.ndarray, names: tuple[str, ...]) -> dict[str, np.ndarray]:
        """Statistics of ascending distinct grams (0 where unknown); only the shards that they fall into are opened."""
        out = {k: np.zeros(len(h), np.int64) for k in names}
        shard, key = place(h, self.shards[level - 1], level)
        cuts = np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(h))
        for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
            if found := _shard(f"{self.folder}/{level}-{shard[a]}"):
                at = found.find(key[a:b])
                for k in names:
                    out[k][a:b] = found.values(k, at)
        return out

    def score(self, texts: list[str]) -> dict[str, np.ndarray]:
        """n_tokens, n_known, base_score and score of each text."""
        words, n = tokens_of(texts, self.order)
        starts = np.cumsum(n) - n
        add = lambda x: np.add.reduceat(x, starts) if len(starts) else x[:0]
        # all that is known of the piece's words, and of the start, which is only ever a context
        known = np.unique(np.append(words[-1], _U(_hashes[_START])))
        of_word = self.look_up(1, known, _STATS)
        which = np.searchsorted(known, words[-1])
        c = of_word["raw"]
        base = np.log10((c + 0.1) / (self.tokens + 0.1 * (self.types + 1)))
        out = {"n_tokens": n, "n_known": add((c > 0)[which].astype(np.int64)), "base_score": add(base[which])}
        # a token's probability depends on its n-gram only
        _, first, gram = np.unique(gram_hash(words), return_index=True, return_inverse=True)
        own = [w[first] for w in words]

        def each(level: int, words: list[np.ndarray], names: tuple[str, ...]) -> dict[str, np.ndarray]:
            if level == 1:
                at = np.searchsorted(known, words[0])
                return {k: of_word[k][at] for k in names}
            h, at = np.unique(gram_hash(words), return_inverse=True)
            return {k: v[at] for k, v in self.look_up(level, h, names).items()}

        seen = each(1, own[-1:], ("count",))["count"]
        p = (np.maximum(seen - _discount(seen, self.discounts[0]), 0) / self.continuations if self.continuations else 0.0) + np.full(len(seen), self.mass / (self.types + 1))
        for level in range(2, self.order + 1):
            seen, d = each(level, own[-level:], ("count",))["count"], self.discounts[level - 1]
            context = each(level - 1, own[-level:-1], ("total", "n1", "n2", "n3"))
            total = np.maximum(context["total"], 1)
            back = np.where(context["total"] > 0, (d[0] * context["n1"] + d[1] * context["n2"] + d[2] * context["n3"]) / total, 1.0)
            p = np.maximum(seen - _discount(seen, d), 0) / total + back * p
        return out | {"score": add(np.log10(p)[gram])}


def train(docs: DataFrame, text_col: str = "text", folder: str | None = None, shard_bytes: int = SHARD_BYTES, order: int = ORDER) -> Model:
    """Count all texts of docs and write the model of n-grams up to order to folder (default: a new one in the shared folder)."""
    if order < 2:
        raise ValueError("order is 2 or more")
    spark = docs.sparkSession
    to = posix_path(folder or new_path(spark, "kneser_ney"))
    texts = docs.select(text_of(text_col).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    most = max(1, -(-size // shard_bytes))
    shards = (max(1, -(-most // 2)), *[most] * (order - 1))
    dealt, kinds = pa.schema([("shard", pa.int64()), ("columns", pa.binary()), ("tally", pa.list_(pa.int64()))]), "shard long, columns binary, tally array<long>"
    start = _hashes[_START]

    def deal(words: list[np.ndarray], stats: list[np.ndarray], tally: list[int]) -> pa.RecordBatch:
        """Packed rows of grams, by the shards of their level; the first row has the tally."""
        shard, _ = place(gram_hash(words), shards[len(words) - 1], len(words))
        order_ = np.lexsort((words[0], shard))
        cuts = np.append(np.flatnonzero(np.diff(shard[order_], prepend=-1)), len(shard))
        parts = [order_[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist())]
        blobs = [pack(*(x[p] for x in (*words, *stats))) for p in parts]
        tallies = [tally, *([0] * len(tally) for _ in parts[1:])]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(([int(shard[p[0]]) for p in parts], blobs, tallies), dealt.types)], schema=dealt)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, size=PIECE):
            words, _ = tokens_of(batch.column("text").to_pylist(), order)
            one, (n,) = _summed(words, np.ones(len(words[0]), np.int64))
            yield deal([w[one] for w in words], [n], [0] * (4 * order))

    def merged(level: int, rows: list[dict]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], list[int]]:
        """Ascending keys, words, statistics and tally of a shard's grams, added up; the tally counts counts of 1 to 4 at each level."""
        columns = [np.concatenate(c) for c in zip(*(unpack(r["columns"]) for r in rows))]
        words, stats = columns[:level], [c.astype(np.int64) for c in columns[level:]]
        one, stats = _summed(words, *stats)
        words = [w[one] for w in words]
        key = place(gram_hash(words), shards[level - 1], level)[1]
        if level > 1:
            rise = np.argsort(key)
            key, words, stats = key[rise], [w[rise] for w in words], [c[rise] for c in stats]
        tally = np.sum([r["tally"] for r in rows], axis=0).tolist()
        tally[4 * level - 4 : 4 * level] = [int((stats[0] == k).sum()) for k in range(1, 5)]
        return key, words, stats, tally

    def merge(level: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for s, rows in _by_shard(batches):
                key, words, stats, tally = merged(level, rows)
                del rows
                named = {"count": stats[0]} if level == order else dict(zip(_STATS, stats))
                _save(to, f"{level}-{s}", _keys(key, level) | {k: v for name, x in named.items() if name != "raw" for k, v in _small(name, x).items()})
                c, raw = stats[0], stats[0] if level == order else stats[1]
                seen = c > 0
                c, raw, words = c[seen], raw[seen], [w[seen] for w in words]
                # as the end of longer grams, and as the context of them
                zero = np.zeros(len(c), np.int64)
                count_ = np.where(words[1] == start, raw, 1) if level > 2 else zero + 1
                both = [np.concatenate([a, b]) for a, b in zip(words[1:], words[:-1])]
                columns = [np.concatenate(x) for x in ((count_, zero), (raw, zero), (zero, c), (zero, c == 1), (zero, c == 2), (zero, c > 2))]
                one, sums = _summed(both, *columns)
                del columns, key, stats, named
                yield deal([w[one] for w in both], sums, tally)
                del both, one, sums, c, raw, words, zero, count_, seen
                give_back()

        return run

    names = ["tokens", "types", "continuations", *(f"t{k}" for k in range(4 * order))]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, rows in _by_shard(batches):
            key, _, stats, tally = merged(1, rows)
            _save(to, f"1-{s}", _keys(key, 1) | {k: v for name, x in zip(_STATS, stats) for k, v in _small(name, x).items()})
            total = [stats[1].sum(), (stats[1] > 0).sum(), stats[0].sum(), *tally]
            yield pa.RecordBatch.from_arrays([pa.array([int(v)], pa.int64()) for v in total], names=names)

    grams = texts.mapInArrow(count, kinds)
    for level in range(order, 0, -1):
        # a shard is a task of its own
        mine = grams.repartitionById(shards[level - 1], F.col("shard").cast("int")).sortWithinPartitions("shard")
        grams = mine.mapInArrow(merge(level), kinds) if level > 1 else mine.mapInArrow(finish, ", ".join(f"{k} long" for k in names))
    t = grams.agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in names)).first()
    d = tuple(discounts(*(t[f"t{4 * k + j}"] for j in range(4))) for k in range(order))
    ones, twos = t["t0"], t["t1"]
    mass = (d[0][0] * ones + d[0][1] * twos + d[0][2] * (t["types"] - ones - twos)) / t["continuations"] if t["continuations"] else 1.0
    return Model(to, order, shards, t["tokens"], t["types"], t["continuations"], d, mass)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score (log10 probabilities), perplexity: one row per row of docs."""
    names = ["doc_id", "n_tokens", "n_known", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, size=PIECE):
            found = model.score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(found[k]) for k in names[1:])], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    out = rows.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score by a model of nine tenths of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs.where(fold_of("doc_id", 10) != 0))
    found = score(docs, model)
    return found.select("doc_id", (fold_of("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
