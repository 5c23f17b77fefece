"""Spelling variants of words: pairs one edit apart by a frequency-vector trie.

A word's frequency vector counts its letters by group; the trie's levels are the groups. An inserted
letter is a surplus of one in some group, a deleted one a deficit of one, and a replaced letter one
of each or neither. So a depth-first search that may spend one surplus and one deficit on its way
reaches the leaves of all words that are one edit from the word it looks for, and few others; the
words there are verified by their common beginning and end. A node of at most LEAF words isn't split
further: its words are compared by their vectors in thermometer code first.

The trie is dealt to tasks by its subtrees. Nodes with more than BOUND words (fewer where the
vocabulary is small, so that there are enough subtrees) are its top: at most as many a level as the
vocabulary has BOUNDs, counted level by level and broadcast. Every word is sent to its own subtree
as an entry, and by the same search over the top to the subtrees from its own on, in order, that its
budget reaches; a pair across subtrees is so found once, for both of its words. A subtree
of all levels that is still too large, as its words have one vector, is dealt to several tasks by
the words' CRC and searched in each. So no task holds more than some BOUND entries.

Defined results: null text is the empty text, without words; a null id counts as an empty one; rows
that repeat an id count each; words of any length are whole keys; among near words of one count the
smallest in code-point order is the form; forms have at least twice the count, so roots exist;
documents without such words, or none at all, give no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import checkpointed, pieces, runs_of, text_bytes, text_of
from .importance_resampling import CRC, CRC_TABLE

MIN_LETTERS = 5
MIN_COUNT = 3
#: One run in so many loses a letter, by the CRC-32 of its document's id and itself.
DROP_ONE_IN = 97
#: Letters of each group; all others are one more group.
GROUPS = ("e", "a", "i", "n", "r", "t", "s", "o", "l", "u", "d", "ckq", "gjy", "mwz", "bpfv", "hx")
LEVELS = len(GROUPS) + 1
#: Words of a subtree, at most and where the vocabulary is small.
BOUND, LEAST = 20_000, 500
#: Words of a node that isn't split further, and words that are looked for at once.
LEAF, CHUNK = 64, 50_000
#: Pairs that are compared at once.
PAIRS = 1 << 18
#: Code points of a word's beginning and end that are kept in arrays; longer words are compared as they are.
SHORT = 64

_GROUP = np.full(0x110000, len(GROUPS), np.uint8)
for _k, _letters in reversed(list(enumerate(GROUPS))):
    _GROUP[[ord(c) for c in _letters]] = _k
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b == 0xC3 for b in range(256)])


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, drop_one_in: int = DROP_ONE_IN) -> DataFrame:
    """word, n: the runs of letters A-Z, a-z and U+00C0 to U+00FF in lower case (A-Z only), some with a letter deleted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            data, rows = text_bytes(batch.column("text"))
            inside = _LETTER[data]
            inside[1:] |= data[:-1] == 0xC3
            known, ids, n = runs_of(_FOLD[data], inside, rows)
            names, counts = known.to_pylist(), np.bincount(ids, minlength=len(known))
            if drop_one_in:
                states = np.repeat([zlib.crc32(f"{i}:".encode()) for i in batch.column("id").to_pylist()], n)
                h = np.fromiter(map(zlib.crc32, map(names.__getitem__, ids.tolist()), states.tolist()), np.int64, len(ids))
                hit = np.flatnonzero(h % drop_one_in == 0)
                counts -= np.bincount(ids[hit], minlength=len(known))
                for k, x in zip(ids[hit].tolist(), h[hit].tolist()):
                    word = names[k].decode()
                    names.append((word[: x % len(word)] + word[x % len(word) + 1 :]).encode())
                counts = np.append(counts, np.ones(len(hit), np.int64))
            keep = [k for k in np.flatnonzero(counts).tolist() if len(names[k]) >= min_letters and len(names[k].decode()) >= min_letters]
            yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in keep], pa.binary()).cast(pa.string()), pa.array(counts[keep])], names=["word", "n"])

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def vectors(names: list[str]) -> np.ndarray:
    """The frequency vectors of words, counts up to 255; two counts never differ by more than the true ones."""
    lengths = np.fromiter(map(len, names), np.int64, len(names))
    codes = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32)
    cell = np.repeat(np.arange(len(names)) * LEVELS, lengths) + _GROUP[codes]
    return np.minimum(np.bincount(cell, minlength=len(names) * LEVELS), 255).astype(np.uint8).reshape(-1, LEVELS)


_WIDTHS = [4] * 13 + [3] * 4  # bits of each level's thermometer; 64 in all


def thermometer(vec: np.ndarray) -> np.ndarray:
    """64 bits of each vector: so many ones a level as its count, at most its width."""
    out, at = np.zeros(len(vec), np.uint64), 0
    for k, width in enumerate(_WIDTHS):
        ones = np.array([(1 << min(c, width)) - 1 for c in range(256)], np.uint64)
        out |= ones[vec[:, k]] << np.uint64(at)
        at += width
    return out


def _ends(names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first code points, last code points backwards, lengths)."""
    flat = lambda parts: np.array(parts, f"<U{SHORT}").view(np.uint32).reshape(len(parts), SHORT)
    return flat([w[:SHORT] for w in names]), flat([w[: -SHORT - 1 : -1] for w in names]), np.fromiter(map(len, names), np.int64, len(names))


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading code points two arrays of words share."""
    apart = a != b
    return np.where(apart.any(axis=1), apart.argmax(axis=1), a.shape[1])


def one_edit(a: str, b: str) -> bool:
    """Whether two words differ by exactly one inserted, deleted or replaced code point, at any length."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    x, y = (np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32) for w in (a, b))
    n = min(len(x), len(y))
    head, tail = (int(d[0]) if len(d := np.flatnonzero(u[:n] != v[:n])) else n for u, v in ((x, y), (x[::-1], y[::-1])))
    return head + tail >= max(len(x), len(y)) - 1


class Subtree:
    """The entries of one subtree, searched for many words at once."""

    def __init__(self, names: list[str], counts: np.ndarray):
        vec = vectors(names)
        order = np.lexsort(vec.T[::-1])
        self.vec, self.names, self.counts = vec[order], [names[k] for k in order.tolist()], counts[order]
        self.code = thermometer(self.vec)
        self.first, self.last, self.lengths = _ends(self.names)
        self.rank = _ranks(self.names)

    def candidates(self, vec: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word looked for, entry) whose vectors differ by a surplus and a deficit of one at most."""
        code, none = thermometer(vec), np.zeros(len(vec), bool)
        stack = [(0, 0, len(self.names), np.arange(len(vec)), none, none)]
        while stack:
            level, lo, hi, which, spent, owed = stack.pop()
            if level == LEVELS or hi - lo <= LEAF:
                for at in range(0, len(which), step := max(1, PAIRS // (hi - lo))):
                    q, t = code[which[at : at + step], None], self.code[None, lo:hi]
                    near = (np.bitwise_count(q & ~t) <= 1) & (np.bitwise_count(t & ~q) <= 1)
                    i, j = np.nonzero(near)
                    yield which[at + i], lo + j
                continue
            counts, mine = self.vec[lo:hi, level], vec[which, level].astype(np.int16)
            borders = np.concatenate([[0], np.flatnonzero(np.diff(counts)) + 1, [hi - lo]])
            for a, b in zip(borders[:-1].tolist(), borders[1:].tolist()):
                more = mine - np.int16(counts[a])
                go = (more == 0) | ((more == 1) & ~spent) | ((more == -1) & ~owed)
                if go.any():
                    stack.append((level + 1, lo + a, lo + b, which[go], spent[go] | (more[go] == 1), owed[go] | (more[go] == -1)))

    def near(self, names: list[str], vec: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word looked for, entry): all pairs one edit apart."""
        first, last, lengths = _ends(names)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for which, entry in self.candidates(vec):
            la, lb = lengths[which], self.lengths[entry]
            short = np.maximum(la, lb) <= SHORT
            head, tail = _shared(first[which], self.first[entry]), _shared(last[which], self.last[entry])
            least = np.minimum(la, lb)
            same = (head >= la) & (la == lb)
            link = short & ~same & (np.abs(la - lb) <= 1) & (np.minimum(head, least) + np.minimum(tail, least) >= np.maximum(la, lb) - 1)
            for k in np.flatnonzero(~short).tolist():
                link[k] = one_edit(names[which[k]], self.names[entry[k]])
            found.append((which[link], entry[link]))
        return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))


def top_of(vocabulary: DataFrame, bound: int) -> dict[bytes, int]:
    """The trie's top: beginnings of vectors that more than bound words share, and how many words; at most a bound-th of them a level."""
    top: dict[bytes, int] = {}
    for level in range(1, LEVELS + 1, 4):
        levels = range(level, min(level + 4, LEVELS + 1))
        above = None if level == 1 else {p for p in top if len(p) == level - 1}
        if above is not None and not above:
            break

        def run(batches: Iterator[pa.RecordBatch], levels=levels, above=above) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vec = vectors(batch.column("word").to_pylist())
                if above is not None:
                    vec = vec[[v.tobytes() in above for v in vec[:, : levels[0] - 1]]]
                for d in levels if len(vec) else ():
                    part, n = np.unique(np.ascontiguousarray(vec[:, :d]), axis=0, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([p.tobytes() for p in part], pa.binary()), pa.array(n)], names=["part", "n"])

        rows = vocabulary.select("word").mapInArrow(run, "part binary, n long").groupBy("part").agg(F.sum("n").alias("n")).where(F.col("n") > bound)
        top |= {bytes(r["part"]): r["n"] for r in rows.collect()}
    return top


def route(vec: np.ndarray, top: dict[bytes, int]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """(subtree, words that reach it, whether it is their own) by the search over the top, without subtrees before a word's own."""
    none = np.zeros(len(vec), bool)
    stack = [(b"", np.arange(len(vec)), none, none, ~none)]
    while stack:
        part, which, spent, owed, own = stack.pop()
        if part and (part not in top or len(part) == LEVELS):
            yield part, which, own
            continue
        mine = vec[which, len(part)].astype(np.int16)
        for count in np.unique(np.clip(np.concatenate([mine - 1, mine, mine + 1]), 0, 255)).tolist():
            more = mine - np.int16(count)
            go = ((more == 0) | ((more == 1) & ~spent & ~own) | ((more == -1) & ~owed))
            if go.any():
                stack.append((part + bytes([count]), which[go], spent[go] | (more[go] == 1), owed[go] | (more[go] == -1), own[go] & (more[go] == 0)))


#: What a row is to its subtree: an entry, a word asked for that is an entry too, a word of an earlier subtree asked for.
_ENTRY, _OWN, _OTHER = 0, 1, 2


def _dealt(sent, bound: int) -> Callable:
    """Rows (subtree, asks, word, n): each word as an entry of its own subtree and as a question to all that it reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = sent.value
        for batch in batches:
            names, counts = batch.column("word").to_pylist(), batch.column("n")
            for part, which, own in route(vectors(names), top):
                blocks = -(-top[part] // bound) if part in top else 1
                entries, role = which[own], np.where(own, _OWN, _OTHER)
                block = np.array([zlib.crc32(names[k].encode()) % blocks for k in entries.tolist()], np.int64)
                for b in range(blocks):
                    mine = np.concatenate([entries[block == b], which])
                    key = pa.array([part + b.to_bytes(4, "big")] * len(mine), pa.binary())
                    asks = pa.array(np.concatenate([np.full(len(mine) - len(which), _ENTRY), role]), pa.int32())
                    yield pa.RecordBatch.from_arrays([key, asks, batch.column("word").take(pa.array(mine)), counts.take(pa.array(mine))], names=["subtree", "asks", "word", "n"])

    return run


def _ranks(names: list[str]) -> np.ndarray:
    """Each word's place in code-point order."""
    return np.argsort(np.array(sorted(range(len(names)), key=names.__getitem__), np.int64))


def _best(word: np.ndarray, names: list[str], other: np.ndarray, others: list[str], counts: np.ndarray, rank: np.ndarray) -> pa.RecordBatch:
    """word, n_near, best_n, best of pairs (word, other)."""
    order = np.lexsort((rank[other], -counts[other], word))
    word, other = word[order], other[order]
    each, first, n = np.unique(word, return_index=True, return_counts=True)
    best = other[first]
    return pa.RecordBatch.from_arrays([pa.array([names[k] for k in each.tolist()], pa.string()), pa.array(n), pa.array(counts[best]), pa.array([others[k] for k in best.tolist()], pa.string())], names=["word", "n_near", "best_n", "best"])


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by subtree, entries first, in; word, n_near, the largest count of a near word and the smallest such word out.

    Pairs with words of earlier subtrees are given for both words, as no other task finds them.
    """
    tree, at, entries, counts = None, None, [], []
    asked: list[str] = []
    more: list[np.ndarray] = []  # roles and counts of what is asked

    def answers() -> Iterator[pa.RecordBatch]:
        nonlocal tree, asked, more
        if asked and entries:
            if tree is None:
                tree = Subtree(entries, np.concatenate(counts))
            role, n = (np.concatenate([m[k] for m in more]) for k in (0, 1))
            which, entry = tree.near(asked, vectors(asked))
            yield _best(which, asked, entry, tree.names, tree.counts, tree.rank)
            other = role[which] == _OTHER
            if other.any():
                yield _best(entry[other], tree.names, which[other], asked, n, _ranks(asked))
        asked, more = [], []

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("subtree").to_pylist()
        borders = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
        for a, b in zip(borders[:-1], borders[1:]):
            if keys[a] != at:
                yield from answers()
                tree, at, entries, counts = None, keys[a], [], []
            part = batch.slice(a, b - a)
            asks, n = (part.column(c).to_numpy() for c in ("asks", "n"))
            split = int((asks == _ENTRY).sum())
            entries += part.column("word").slice(0, split).to_pylist()
            counts.append(n[:split])
            asked += part.column("word").slice(split).to_pylist()
            more.append((asks[split:], n[split:]))
            if len(asked) >= CHUNK:
                yield from answers()
    yield from answers()


def near_words(vocabulary: DataFrame, bound: int = BOUND) -> DataFrame:
    """word, n_near, best_n, best: for the words that have near words; vocabulary has one row a word, and its n."""
    spark = vocabulary.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bound = max(min(LEAST, bound), min(bound, vocabulary.count() // (4 * tasks)))
    sent = spark.sparkContext.broadcast(top_of(vocabulary, bound))
    dealt = vocabulary.mapInArrow(_dealt(sent, bound), "subtree binary, asks int, word string, n long")
    dealt = dealt.repartitionByRange(tasks, "subtree").sortWithinPartitions("subtree", "asks")
    found = dealt.mapInArrow(_searched, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where the chain of forms ends; forms has word and form, and no cycle. Each pass doubles the steps."""
    now = checkpointed(forms.select("word", F.col("form").alias("root")))
    while not now.isEmpty():
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = checkpointed(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            break
    return now


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, drop_one_in: int = DROP_ONE_IN, bound: int = BOUND) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word; drop_one_in=0 deletes no letters."""
    vocabulary = checkpointed(words(docs, id_col, text_col, min_letters, min_count, drop_one_in))
    near = near_words(vocabulary, bound)
    formed = F.col("best_n") >= 2 * F.col("n")
    rows = vocabulary.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n"))
    rows = checkpointed(rows)
    ends = roots(rows.where(F.col("form").isNotNull()))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word's near words, form and root over whole documents."""
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP12_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all({_LOW}, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS w FROM documents),
u AS (SELECT d, w, count(*) AS n FROM r GROUP BY ALL),
h AS (SELECT w, n, {CRC.format(x="d || ':' || w")} AS h FROM u, crc_table),
e AS (SELECT CASE WHEN h % {DROP_ONE_IN} = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM e WHERE length(word) >= {MIN_LETTERS} GROUP BY word HAVING sum(n) >= {MIN_COUNT}),
x AS MATERIALIZED (SELECT word, n, p, substr(word, 1, p) || substr(word, p + 2) AS cut FROM (SELECT word, n, unnest(range(length(word))) AS p FROM v)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM x a JOIN x b ON a.cut = b.cut AND a.p = b.p WHERE a.word <> b.word
  UNION SELECT x.word, v.word, v.n FROM x JOIN v ON x.cut = v.word
  UNION SELECT v.word, x.word, x.n FROM x JOIN v ON x.cut = v.word
),
m AS (SELECT word, count(*) AS n_near, arg_min(other, (-n, other)) AS best, max(n) AS best_n FROM near GROUP BY word),
f AS MATERIALIZED (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * v.n THEN best END AS form, CASE WHEN best_n >= 2 * v.n THEN best_n END AS form_n FROM v LEFT JOIN m USING (word)
),
c AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT c.word, f.word, f.form FROM c JOIN f ON f.word = c.next)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM f JOIN c ON c.word = f.word AND c.next IS NULL
"""
