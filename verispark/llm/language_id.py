"""Language ID by rank-order profiles.

A language's profile is its most frequent character n-grams in rank order, counted over all its
documents; a document is given the language whose profile is nearest by the out-of-place distance
between the ranks of the document's own most frequent n-grams and the profile's. Words are runs of
letters and combining marks in lower case, padded with one space on either side; n-grams don't
cross words. A batch of texts becomes one array of n-gram numbers, so a document costs a few array
operations whatever its length.

Defined results: a text that is null or has no letter is 'und' with score 0, and so is every text
when nothing could be learned; ties go to the smallest language; rows that repeat an id are rows of
their own; a very long text is one like any other; an empty table gives no rows; other columns are
untouched, whatever their names.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import fold_of, give_back, text_of, unused

#: N-grams of a profile, and of a document.
PROFILE = 400
#: Languages whose profiles are broadcast together; of more, each group gives its best and the best of those is taken.
MAX_LANGUAGES = 2000
#: Values of the language column beyond which it is taken for an error, as all profiles reach the driver.
MOST_LANGUAGES = 100_000
#: Ranks that are compared at once: n-grams times languages.
COMPARED = 1 << 22
UNKNOWN = "und"
#: Characters of text that are turned into n-grams at once.
PIECE_CHARS = 1 << 19
#: Codes of three letters that are numbered by a table; larger alphabets are numbered by sorting.
TABLE_CODES = 1 << 22
_POINTS = 0x40000


@cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """(is a letter or mark, lower case) of each code point; later planes have no letters in use."""
    kinds = [unicodedata.category(chr(c))[0] for c in range(_POINTS)]
    low = [chr(c).lower() for c in range(_POINTS)]
    return np.array([k in "LM" for k in kinds]), np.array([ord(x) if len(x) == 1 else c for c, x in enumerate(low)], np.uint32)


@dataclass
class Numbered:
    """n-grams of some texts: ids (three per character, the largest is none), each text's range, and each id's n-gram.

    An n-gram's key holds its code points in 21 bits each, so keys order n-grams as strings.
    """

    ids: np.ndarray
    bounds: np.ndarray
    keys: np.ndarray

    def counts(self, k: int) -> np.ndarray:
        """How often each n-gram occurs in text k."""
        return np.bincount(self.ids[self.bounds[k] : self.bounds[k + 1]].ravel(), minlength=len(self.keys) + 1)[: len(self.keys)]

    def counts_by(self, group: np.ndarray, groups: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(group, n-grams, how often each occurs in its texts), given each text's group; one pass over all texts."""
        none = len(self.keys)
        code = np.repeat(group, np.diff(self.bounds))[:, None] * np.int64(none + 1) + self.ids[self.bounds[0] : self.bounds[-1]]
        if groups * (none + 1) <= TABLE_CODES:
            n = np.bincount(code.ravel(), minlength=groups * (none + 1))
            found = np.flatnonzero(n)
            n = n[found]
        else:
            found, n = np.unique(code.ravel(), return_counts=True)
        of, gram = found // (none + 1), found % (none + 1)
        for g in np.unique(of).tolist():
            pick = (of == g) & (gram < none)
            yield g, gram[pick], n[pick]

    def ranked(self, which: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, n-gram, rank) of the most frequent n-grams of some texts, as top_ids ranks them, in order; all texts are sorted at once."""
        none, lengths = len(self.keys), np.diff(self.bounds)
        chosen = np.zeros(len(lengths), bool)
        chosen[which] = True
        text, at = np.repeat(np.arange(len(lengths)), lengths), np.repeat(chosen, lengths)
        ids = self.ids[self.bounds[0] : self.bounds[-1]][at]
        pairs = (text[at][:, None] * np.int64(none + 1) + ids)[ids < none]
        pairs.sort()
        first = np.flatnonzero(np.diff(pairs, prepend=-1))
        n = np.diff(np.append(first, len(pairs)))
        text, gram = pairs[first] // (none + 1), pairs[first] % (none + 1)
        if none < 1 << 21 and len(lengths) < 1 << 21 and (not len(n) or n.max() < 1 << 20):
            packed = text << 41 | ((1 << 20) - n) << 21 | gram  # sorting numbers is faster than sorting places
            packed.sort()
            text, gram = packed >> 41, packed & ((1 << 21) - 1)
        else:
            order = np.lexsort((gram, -n, text))
            text, gram = text[order], gram[order]
        starts = np.flatnonzero(np.diff(text, prepend=-1))
        rank = np.arange(len(text)) - np.repeat(starts, np.diff(np.append(starts, len(text))))
        return text[rank < top], gram[rank < top], rank[rank < top]


def numbered(texts: list[str]) -> Numbered:
    """All 1- to 3-grams of one text or more."""
    letter, lower = _characters()
    raw = np.frombuffer(("\x00" + "\x00".join(texts) + "\x00").encode("utf-32-le", "surrogatepass"), "<u4")
    raw = np.where(raw < _POINTS, raw, 0)
    is_letter = letter[raw]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # one space after each word
    breaks = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
    keep[breaks] = True  # and one before each text
    bounds = (np.cumsum(keep) - 1)[breaks]
    stream = np.where(is_letter[keep], lower[raw[keep]], 32)
    used = np.flatnonzero(np.bincount(stream, minlength=33))
    place = np.zeros(int(used[-1]) + 1, np.int64)
    place[used] = np.arange(1, len(used) + 1)
    s, base = place[stream], len(used) + 1
    inside = stream != 32
    second, third = np.append(s[1:], 0), np.append(s[2:], [0, 0])
    inside2 = np.append(inside[1:], False)
    codes = np.stack([
        np.where(inside, s * base * base, 0), np.where(inside | inside2, (s * base + second) * base, 0), np.where(inside2, (s * base + second) * base + third, 0),
    ], axis=1)
    codes[-1] = 0  # nothing starts at the last break
    if base**3 <= TABLE_CODES:
        seen = np.zeros(base**3, bool)
        seen[codes.ravel()] = True
        seen[0] = False
        found = np.flatnonzero(seen)
        number = np.full(base**3, len(found), np.int32)
        number[found] = np.arange(len(found))
        ids = number[codes]
    else:
        found, ids = np.unique(codes, return_inverse=True)
        ids = ids.reshape(codes.shape)
        if len(found) and found[0] == 0:
            found = found[1:]
            ids = np.where(ids == 0, len(found), ids - 1)
    points = np.append(0, used).astype(np.int64)
    keys = points[found // (base * base)] << 42 | points[found // base % base] << 21 | points[found % base]
    return Numbered(ids, bounds, keys)


def top_ids(counts: np.ndarray, top: int) -> np.ndarray:
    """Ids of the most frequent n-grams in rank order; equal counts in order of the n-grams."""
    ids = np.flatnonzero(counts)
    if len(ids) > top:
        c = counts[ids]
        ids = ids[c >= np.partition(c, len(c) - top)[len(c) - top]]
    return ids[np.argsort(-counts[ids], kind="stable")][:top]


def spelt(key: int) -> str:
    """The n-gram of a key."""
    return "".join(chr(c) for c in (key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF) if c)


def key_of(gram: str) -> int:
    """The key of an n-gram."""
    return sum(ord(c) << (42 - 21 * k) for k, c in enumerate(gram))


def _parts(texts: list[str]) -> Iterator[slice]:
    """Ranges of texts of some PIECE_CHARS characters."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= PIECE_CHARS:
            yield slice(at, k + 1)
            at, size = k + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


def _merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = (np.concatenate(c) for c in zip(*found))
    one, which = np.unique(keys, return_inverse=True)
    return one, np.bincount(which, n, len(one)).astype(np.int64)


def learn_profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", top: int = PROFILE) -> dict[str, list[str]]:
    """language -> n-grams in rank order, from all rows with a language; top n-grams of each reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for part in _parts(texts):
                grams, names = numbered(texts[part]), sorted(set(langs[part]))
                place = {x: k for k, x in enumerate(names)}
                for g, pick, n in grams.counts_by(np.array([place[x] for x in langs[part]], np.int64), len(names)):
                    mine = held.setdefault(names[g], [])
                    mine.append((grams.keys[pick], n))
                    if len(mine) > 15:
                        held[names[g]] = [_merged(mine)]
            give_back()
        for lang, found in held.items():
            keys, n = _merged(found)
            for at in range(0, len(keys), 10_000):
                k = keys[at : at + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k), pa.array(n[at : at + 10_000])], names=["lang", "key", "n"])

    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), text_of(text_col).alias("text"))
    counts = rows.mapInArrow(run, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "key")
    best = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("lang", "key", "rank")
    out: dict[str, list[str]] = {}
    if (n := rows.agg(F.approx_count_distinct("lang")).first()[0]) > MOST_LANGUAGES:
        raise ValueError(f"about {n} values of {lang_col}: these can't be languages")
    for r in sorted(best.collect(), key=lambda r: (r["lang"], r["rank"])):
        out.setdefault(r["lang"], []).append(spelt(r["key"]))
    return out


def predict(spark: SparkSession, profiles: dict[str, list[str]], text: Column, top: int = PROFILE, max_languages: int = MAX_LANGUAGES) -> Column:
    """struct<lang, score> of a text; score is 1 - distance / largest distance."""
    names = sorted(profiles)
    groups = [_predict(spark, {k: profiles[k] for k in names[at : at + max_languages]}, text, top) for at in range(0, max(1, len(names)), max_languages)]
    best = groups[0]
    for other in groups[1:]:  # of equal scores, the earlier group has the smaller language
        best = F.when(other["score"] > best["score"], other).otherwise(best)
    return best


def _nearest(grams: Numbered, ranks: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(nearest profile or -1, score) of each text; ranks has the profiles' ranks of each n-gram.

    Long texts count their n-grams in a table each; all short ones are sorted together.
    """
    sizes, langs = np.diff(grams.bounds) * 3, ranks.shape[1]
    best, score = np.full(len(sizes), -1), np.zeros(len(sizes))
    if not langs:
        return best, score

    def compare(text: np.ndarray, gram: np.ndarray, rank: np.ndarray) -> None:
        """Texts in order, each whole."""
        starts = np.flatnonzero(np.diff(text, prepend=-1))
        r = ranks[gram]
        far = np.add.reduceat(np.where(r < 0, top, np.minimum(top, np.abs(r - rank[:, None].astype(np.int32)))), starts, axis=0, dtype=np.int64)
        own, which = np.diff(np.append(starts, len(text))), text[starts]
        best[which] = far.argmin(axis=1)
        score[which] = 1 - far.min(axis=1) / (top * own)

    long = sizes * 4 >= len(grams.keys)
    for k in np.flatnonzero(long).tolist():
        own = top_ids(grams.counts(k), top)
        if len(own):
            compare(np.full(len(own), k), own, np.arange(len(own)))
    if not long.all():
        text, gram, rank = grams.ranked(np.flatnonzero(~long), top)
        starts, at = np.append(np.flatnonzero(np.diff(text, prepend=-1)), len(text)), 0
        while at < len(text):
            to = int(starts[max(np.searchsorted(starts, at + COMPARED // langs, "right") - 1, np.searchsorted(starts, at, "right"))])
            compare(text[at:to], gram[at:to], rank[at:to])
            at = to
    return best, score


def _predict(spark: SparkSession, profiles: dict[str, list[str]], text: Column, top: int) -> Column:
    langs = sorted(profiles)
    known = sorted({key_of(g) for grams in profiles.values() for g in grams})
    row = {k: i for i, k in enumerate(known)}
    ranks = np.full((len(known) + 1, len(langs)), -1, np.int32)  # the last row: not in any profile
    for j, lang in enumerate(langs):
        for r, g in enumerate(profiles[lang]):
            ranks[row[key_of(g)], j] = r
    sent = spark.sparkContext.broadcast((langs, np.array(known, np.int64), ranks))

    @F.arrow_udf("struct<lang: string, score: double>")
    def run(column: pa.Array) -> pa.Array:
        langs, known, ranks = sent.value
        names, scores, texts = [], [], column.to_pylist()
        for part in _parts(texts):
            grams = numbered(texts[part])
            at = np.searchsorted(known, grams.keys)
            hit = known[np.minimum(at, len(known) - 1)] == grams.keys if len(known) else np.zeros(len(at), bool)
            best, score = _nearest(grams, ranks[np.where(hit, at, len(known))], top)
            names += [langs[k] if k >= 0 else UNKNOWN for k in best.tolist()]
            scores += score.tolist()
        del texts
        give_back()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])

    # marks alone are no letters
    return F.when(text.rlike(r"\p{L}"), run(text)).otherwise(F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score")))


def identify(docs: DataFrame, profiles: dict[str, list[str]], text_col: str = "text", into: str = "lang_found") -> DataFrame:
    """docs with a column more: the predicted language and its score."""
    return docs.withColumn(into, predict(docs.sparkSession, profiles, text_of(text_col)))


def keep_identified(docs: DataFrame, profiles: dict[str, list[str]], text_col: str = "text") -> DataFrame:
    """docs whose language isn't 'und': what has letters stays, whatever its score."""
    into = unused(docs, "lang_found")
    return identify(docs, profiles, text_col, into).where(F.col(into)["lang"] != UNKNOWN).drop(into)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from three quarters of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    profiles = learn_profiles(docs.where(fold_of("doc_id", 4) != 2))
    found = identify(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), F.col("lang_found.lang").alias("lang_pred"), F.col("lang_found.score").alias("score"))
