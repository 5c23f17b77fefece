"""Importance resampling towards a target's word features, with a head-tail vocabulary.

A feature is a run of 1 to ngrams words, joined by one space; its bucket is the CRC-32 of its bytes
modulo the number of buckets. Words that make at least 1/HEAD of all words are the head: there are
at most HEAD of them, whatever the size, and their CRC states are broadcast, as are those of the
pairs of head words that make at least 1/HEAD of all pairs. A feature that the tables don't hold
takes its CRC directly, a longer one on from its prefix's state. So head and tail give the same
numbers, and both feed exact totals of the buckets over all documents and all target texts.

A document's weight is the floored mean of its features' gains, which are log ratios of the target's
and the corpus's smoothed bucket totals; with Gumbel noise from its id the highest scores are a draw
without replacement. Ranks come from a histogram of the scores, which are whole numbers between the
bounds of gains and noise, so it has less than 100,000 rows at any size, and from the order inside
each score.

Defined results: null text is the empty text, which has no features, weight 0 and is never drawn;
a null id counts as an empty one and comes last among ties; rows that repeat an id are drawn each,
in any order among themselves; an empty target gives each feature the gain of unseen ones; an empty
table gives no rows; long texts are taken whole; other columns may be kept, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ._common import checkpointed, new_path, pieces, runs_of, text_bytes, text_of, unused

NGRAMS = 1
BUCKETS = 10_000
PERCENT = 10
MIN_WORDS = 20
SEED = 2024
#: A word or pair is broadcast if it makes at least one in HEAD of all; so there are at most HEAD of each.
HEAD = 100_000
#: Bytes of a word in lower case (A-Z only); all that isn't 0-9, a letter or beyond ASCII is a space.
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, each word's number among them, words of each row) of an array of texts."""
    data, rows = text_bytes(texts)
    folded = _FOLD[data]
    return runs_of(folded, folded != 32, rows)


class Head:
    """CRC states of the frequent words and of the frequent pairs of them."""

    def __init__(self, words: list[bytes], pairs: list[tuple[bytes, bytes]] = ()):
        self.words = pa.array(words, pa.large_binary())
        self.states = np.array([zlib.crc32(w) for w in words], np.int64)
        place = {w: k for k, w in enumerate(words)}
        coded = sorted((place[a] * len(words) + place[b], zlib.crc32(a + b" " + b)) for a, b in pairs)
        self.pairs, self.pair_states = (np.array([c[k] for c in coded], np.int64) for k in (0, 1))

    def find(self, words: pa.Array) -> np.ndarray:
        """Each word's place in the head, or -1."""
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64) if len(self.words) else np.full(len(words), -1)

    def word_states(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(places, CRC states) of distinct words: by the table, those of the tail directly."""
        place = self.find(words)
        states = np.zeros(len(words), np.int64)
        states[place >= 0] = self.states[place[place >= 0]]
        tail = np.flatnonzero(place < 0)
        states[tail] = [zlib.crc32(w) for w in words.take(pa.array(tail)).to_pylist()]
        return place, states

    def find_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of each pair of head places in the table of pairs, or -1."""
        if not len(self.pairs):
            return np.full(len(a), -1)
        code = a * len(self.words) + b
        at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        return np.where((a >= 0) & (b >= 0) & (self.pairs[at] == code), at, -1)

    def features(self, texts: pa.Array, ngrams: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(CRC of each feature, rows in turn, each row's shorter runs first; words, features of each row)."""
        words, ids, n_words = words_in(texts)
        place, states = self.word_states(words)
        row = np.repeat(np.arange(len(n_words)), n_words)
        grams, gram_states, parts, rows = ids.astype(np.int64), states, [states[ids]], [row]
        for k in range(2, ngrams + 1):
            if len(ids) < k:
                break
            live = row[k - 1 :] == row[: len(row) - k + 1]  # runs of k words that stay in their text
            code, of = np.unique(np.where(live, grams[: len(ids) - k + 1] * max(1, len(words)) + ids[k - 1 :], -1), return_inverse=True)
            head, word = code // max(1, len(words)), code % max(1, len(words))
            longer = np.zeros(len(code), np.int64)
            known = self.find_pairs(place[head], place[word]) if k == 2 else np.full(len(code), -1)
            longer[known >= 0] = self.pair_states[known[known >= 0]]
            tail = np.flatnonzero((known < 0) & (code >= 0))
            texts_of = words.take(pa.array(word[tail])).to_pylist()
            longer[tail] = [zlib.crc32(b" " + w, int(s)) for w, s in zip(texts_of, gram_states[head[tail]].tolist())]
            grams, gram_states = of, longer
            parts.append(longer[of[live]])
            rows.append(row[: len(ids) - k + 1][live])
        every, order = np.concatenate(rows), slice(None)
        if len(rows) > 1:
            order = np.argsort(every, kind="stable")
        return np.concatenate(parts)[order], n_words, np.bincount(every, minlength=len(n_words))


def _counted(docs: DataFrame, text_col: str, run, schema: str, keys: list[str]) -> DataFrame:
    found = docs.select(text_of(text_col).alias("text")).mapInArrow(run, schema)
    return checkpointed(found.groupBy(*keys).agg(F.sum("n").alias("n")))


def frequent(docs: DataFrame, text_col: str = "text", ngrams: int = NGRAMS, head: int = HEAD) -> Head:
    """The head of the vocabulary, counted over all documents; at most head words and head pairs reach the driver."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            known, ids, _ = words_in(batch.column("text"))
            yield pa.RecordBatch.from_arrays([known.cast(pa.binary()), pa.array(np.bincount(ids, minlength=len(known)))], names=["word", "n"])

    counts = _counted(docs, text_col, words, "word binary, n long", ["word"])
    share = lambda df: df.where(F.col("n") * F.lit(head) >= F.lit(df.agg(F.sum("n")).first()[0] or 0))
    top = [bytes(r[0]) for r in share(counts).select("word").collect()]
    if ngrams < 2 or not top:
        return Head(top)
    sent = docs.sparkSession.sparkContext.broadcast(Head(top))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            known, ids, n_words = words_in(batch.column("text"))
            place = sent.value.find(known)[ids]
            row = np.repeat(np.arange(len(n_words)), n_words)
            both = (row[1:] == row[:-1]) & (place[1:] >= 0) & (place[:-1] >= 0)
            code, n = np.unique(place[:-1][both] * len(sent.value.words) + place[1:][both], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["pair", "n"])

    found = share(_counted(docs, text_col, pairs, "pair long, n long", ["pair"])).select("pair").collect()
    return Head(top, [(top[r[0] // len(top)], top[r[0] % len(top)]) for r in found])


def _featured(docs: DataFrame, text_col: str, keep: list[str], head, ngrams: int, buckets: int, names: dict[str, str]) -> DataFrame:
    """The kept columns, the numbers of words and features, and the features' buckets as packed integers; written once."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"
    text = unused(docs, "text_to_weigh")
    rows = docs.select(*keep, text_of(text_col).alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            crc, n_words, n = head.value.features(batch.column(text), ngrams)
            packed = (crc % buckets).astype(kind)
            ends = np.concatenate([[0], np.cumsum(n)]) * packed.itemsize
            blob = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(packed)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(n_words), pa.array(n), blob], names=[*keep, *(names[k] for k in ("n_words", "n_features", "buckets"))])

    kinds = docs.select(*keep).schema.add(names["n_words"], "long").add(names["n_features"], "long").add(names["buckets"], "binary")
    path = new_path(docs.sparkSession, "features")
    rows.mapInArrow(run, kinds).withColumn(names["row"], F.monotonically_increasing_id()).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def bucket_totals(features: DataFrame, column: str, buckets: int) -> DataFrame:
    """bucket, n: how many features fall into each bucket; a task adds up what it has read."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for blob in batch.column(0):
                total += np.bincount(np.frombuffer(blob.as_buffer(), kind), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return features.select(column).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _gains(corpus: DataFrame, target: DataFrame, column: str, buckets: int) -> np.ndarray:
    """floor(1000 * log ratio) of each bucket."""
    s, t = (dict(bucket_totals(f, column, buckets).collect()) for f in (corpus, target))  # at most one row a bucket
    all_s, all_t = float(sum(s.values())), float(sum(t.values()))
    ratio = [(t.get(k, 0) + 1.0) * (all_s + buckets) / ((s.get(k, 0) + 1.0) * (all_t + buckets)) for k in range(buckets)]
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def noise(id_col: str, seed: int) -> Column:
    """Gumbel noise in thousandths, from the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))


def importance(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", ngrams: int = NGRAMS, buckets: int = BUCKETS, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, head: int = HEAD, keep: list[str] | None = None, into: str = "importance") -> DataFrame:
    """The kept columns of docs (all, unless named) and into: struct of n_words, n_features, weight, score, rank.

    Rank is null for the rows that aren't drawn: all but percent of those with min_words words.
    """
    if into.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has a column {into}; name another with into=")
    spark, keep = docs.sparkSession, list(docs.columns if keep is None else dict.fromkeys([*keep, id_col]))
    names = {k: unused(docs, k) for k in ("n_words", "n_features", "buckets", "row", "weight", "score", "rank", "before", "n")}
    sent = spark.sparkContext.broadcast(frequent(docs, text_col, ngrams, head))
    corpus = _featured(docs, text_col, keep, sent, ngrams, buckets, names)
    goal = _featured(target.select(F.col(target_col).alias("text")), "text", [], sent, ngrams, buckets, {k: k for k in names})
    gains = spark.sparkContext.broadcast(_gains(corpus.withColumnRenamed(names["buckets"], "buckets").select("buckets"), goal, "buckets", buckets))
    kind = "<u2" if buckets <= 1 << 16 else "<u4"
    at = corpus.columns.index(names["buckets"])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.frombuffer(b.as_buffer(), kind) for b in batch.column(at)]
            weight = np.array([gains.value[p].sum() // len(p) if len(p) else 0 for p in parts], np.int64)
            yield batch.set_column(at, names["weight"], pa.array(weight))

    schema = StructType([StructField(names["weight"], LongType()) if k == at else f for k, f in enumerate(corpus.schema)])
    path = new_path(spark, "weights")
    corpus.mapInArrow(weigh, schema).withColumn(names["score"], F.col(names["weight"]) + noise(id_col, seed)).write.parquet(path)
    return _drawn(spark.read.parquet(path), keep, id_col, percent, min_words, names, into)


def _drawn(rows: DataFrame, keep: list[str], id_col: str, percent: int, min_words: int, names: dict[str, str], into: str) -> DataFrame:
    """rows with their ranks: the rows above a score by its histogram, those of one score by id."""
    score, before, n, rank = (F.col(names[k]) for k in ("score", "before", "n", "rank"))
    fit = F.col(names["n_words"]) >= min_words
    histogram = rows.where(fit).groupBy(names["score"]).agg(F.count("*").alias(names["n"]))
    # less than 100,000 rows at any size: scores are whole numbers between fixed bounds
    histogram = checkpointed(histogram.withColumn(names["before"], F.sum(n).over(Window.orderBy(score.desc()).rowsBetween(Window.unboundedPreceding, -1))).fillna(0, names["before"]))
    most = (histogram.agg(F.sum(n)).first()[0] or 0) * percent // 100
    cut = histogram.where(before < most).agg(F.min(score)).first()[0]
    reach = (fit & (score >= F.lit(cut))) if cut is not None else F.lit(False)
    order = Window.partitionBy(score).orderBy(F.col(id_col).asc_nulls_last(), names["row"])
    ranked = rows.where(reach).withColumn(names["rank"], F.row_number().over(order).cast("long")).join(F.broadcast(histogram.select(score, before)), names["score"])
    ranked = ranked.withColumn(names["rank"], F.when(rank + before <= most, rank + before)).drop(names["before"])
    every = ranked.unionByName(rows.where(~reach).withColumn(names["rank"], F.lit(None).cast("long")))
    return every.select(*keep, F.struct(*(F.col(names[k]).alias(k) for k in ("n_words", "n_features", "weight", "score", "rank"))).alias(into))


def resample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of docs, all columns as they were; options as of importance()."""
    into = unused(docs, "importance")
    return importance(docs, target, into=into, **options).where(F.col(into)["rank"].isNotNull()).drop(into)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight, score and rank in the draw towards the benchmark's words."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return importance(docs, target, keep=["doc_id"]).select("doc_id", *(F.col("importance")[c].alias(c) for c in ("n_features", "weight", "score", "rank")))


#: CRC-32 in SQL: t is the table of 256 steps by the reversed polynomial, crc({x}) folds a text's UTF-8 bytes.
CRC_TABLE = "crc_table AS (SELECT list(list_reduce(range(0, 9), lambda c, k: CASE WHEN k = 0 THEN c WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i))"
CRC = "xor(list_reduce(list_transform(range(1, 2 * octet_length(encode({x})), 2), lambda k: ('0x' || substr(hex(encode({x})), k, 2))::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)"
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
WITH {CRC_TABLE},
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
dw AS (SELECT r, unnest(ws) AS w FROM d),
bw AS (SELECT unnest({_WORDS}) AS w FROM benchmark),
v AS (SELECT w, {CRC.format(x="w")} % {BUCKETS} AS b FROM (SELECT w FROM dw UNION SELECT w FROM bw), crc_table),
s AS (SELECT b, count(*) AS n FROM dw JOIN v USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM bw JOIN v USING (w) GROUP BY b),
g AS (
  SELECT v.b, any_value(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + {BUCKETS}) / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bw) + {BUCKETS}))))::BIGINT) AS gain
  FROM v LEFT JOIN s ON s.b = v.b LEFT JOIN t ON t.b = v.b GROUP BY v.b
),
m AS (SELECT r, sum(gain)::BIGINT AS total, count(*) AS n FROM dw JOIN v USING (w) JOIN g USING (b) GROUP BY r),
x AS (
  SELECT d.r, doc_id, coalesce(n, 0) AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0) AS weight,
    ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM d LEFT JOIN m ON m.r = d.r
),
y AS (SELECT r, doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM x),
z AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, r) AS k FROM y WHERE n_features >= {MIN_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN k <= (SELECT count(*) FROM z) * {PERCENT} // 100 THEN k END AS rank FROM y LEFT JOIN z ON z.r = y.r
"""
