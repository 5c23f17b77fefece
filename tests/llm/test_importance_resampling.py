import hashlib
import math
import re
import zlib
from collections import Counter

from verispark.llm import importance_resampling as R

from .helpers import DOCS, awkward, empty, row

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, n):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    return words, [" ".join(words[k : k + j]) for j in range(1, n + 1) for k in range(len(words) - j + 1)]


def brute(docs, target, n=1, buckets=R.BUCKETS, percent=R.PERCENT, least=R.MIN_WORDS):
    count = lambda texts: Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t, n)[1])
    s, t = count(d["text"] for d in docs), count(target)
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s}
    out = []
    for d in docs:
        words, found = features(d["text"], n)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{R.SEED}:{'' if d['doc_id'] is None else d['doc_id']}".encode()).hexdigest()[:8], 16)
        out.append([d["doc_id"], len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    for k, x in enumerate(fit[: percent * len(fit) // 100], 1):
        x[5] = k
    return sorted(map(tuple, out), key=str)


def result(df):
    got = df.select("doc_id", "importance.*").collect()
    return sorted(((r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in got), key=str)


def target_of(spark, texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "item_id long, text string")


TARGET = ["the quick brown fox", None, "", "日本 words ünïcode", "stone bridges near the town " * 3]


def many(spark):
    words = "alpha beta gamma delta epsilon the quick brown fox 日本 a b c d e f g h".split()
    more = [row(100 + k, " ".join(words[(k * j) % len(words)] for j in range(1, 18 + k % 9))) for k in range(120)]
    return awkward(spark).unionByName(spark.createDataFrame([*more, row(101, more[1][1]), row(None, "alpha " * 30)], DOCS))


def test_weights_scores_and_ranks_of_awkward_documents(spark):
    docs = many(spark)
    rows = [r.asDict() for r in docs.select("doc_id", "text").collect()]
    assert result(R.importance(docs, target_of(spark, TARGET))) == brute(rows, TARGET)
    assert result(R.importance(docs, target_of(spark, TARGET), percent=60, min_words=1)) == brute(rows, TARGET, percent=60, least=1)


def test_longer_runs_with_any_head(spark):
    docs = many(spark)
    rows = [r.asDict() for r in docs.select("doc_id", "text").collect()]
    for n, head, buckets in ((2, 100_000, 10_000), (2, 5, 97), (3, 40, 70_000), (2, 0, 10_000)):
        assert result(R.importance(docs, target_of(spark, TARGET), ngrams=n, head=head, buckets=buckets)) == brute(rows, TARGET, n, buckets), (n, head)


def test_the_head_is_bounded_and_holds_pairs_of_its_words(spark):
    docs = many(spark)
    for head in (45, 70):
        h = R.frequent(docs, ngrams=2, head=head)
        assert 0 < len(h.words) <= head and len(h.pairs) <= head
        assert set(h.pair_states.tolist()) <= {zlib.crc32(a + b" " + b) for a in h.words.to_pylist() for b in h.words.to_pylist()}


def test_empty_documents_and_targets(spark):
    assert result(R.importance(empty(spark), target_of(spark, TARGET))) == []
    docs = awkward(spark)
    rows = [r.asDict() for r in docs.select("doc_id", "text").collect()]
    assert result(R.importance(docs, target_of(spark, []))) == brute(rows, [])


def test_a_very_long_text_is_taken_whole(spark):
    text = " ".join(f"w{k % 5003} stone" for k in range(300_000))
    docs = spark.createDataFrame([row(1, text), row(2, "short one")], DOCS)
    assert result(R.importance(docs, target_of(spark, TARGET))) == brute([{"doc_id": 1, "text": text}, {"doc_id": 2, "text": "short one"}], TARGET)


def test_resample_keeps_rows_as_they_were(spark):
    docs = many(spark)
    drawn = R.resample(docs, target_of(spark, TARGET), percent=40)
    assert drawn.columns == docs.columns
    rows = [r.asDict() for r in docs.select("doc_id", "text").collect()]
    want = Counter(x[0] for x in brute(rows, TARGET, percent=40) if x[5] is not None)
    assert Counter(r["doc_id"] for r in drawn.collect()) == want
    assert {tuple(r) for r in drawn.collect()} <= {tuple(r) for r in docs.collect()}


def test_words_end_with_their_row(spark):
    import pyarrow as pa

    known, ids, n = R.words_in(pa.array(["ab", "cd ef", "", "gh", "éa-Éa"]))
    assert [known[i].as_py().decode() for i in ids.tolist()] == ["ab", "cd", "ef", "gh", "éa", "Éa"] and n.tolist() == [1, 2, 0, 1, 2]
