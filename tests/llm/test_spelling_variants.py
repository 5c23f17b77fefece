import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from verispark.llm import spelling_variants as V

from .helpers import DOCS, awkward, empty, row

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_words(rows, drop=V.DROP_ONE_IN, least=V.MIN_COUNT):
    n = Counter()
    for r in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", (r["text"] or "").translate(LOW)):
            h = zlib.crc32(f"{'' if r['doc_id'] is None else r['doc_id']}:{w}".encode())
            if drop and h % drop == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += len(w) >= V.MIN_LETTERS
    return {w: c for w, c in n.items() if c >= least}


def edit_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(counts):
    near = {w: [x for x in counts if abs(len(x) - len(w)) <= 1 and edit_one(w, x)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = []
    for w in counts:
        end = w
        while form[end] is not None:
            end = form[end]
        out.append((w, form[w], end, counts[w], len(near[w]), counts.get(form[w])))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def words_table(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)


def dense_words(n, letters, lengths, seed):
    """Words of few letters, so that many are near each other."""
    rng = np.random.default_rng(seed)
    return {"".join(rng.choice(list(letters), rng.integers(*lengths))): int(rng.integers(3, 60)) for _ in range(n)}


def test_words_forms_and_roots_of_awkward_documents(spark):
    docs = awkward(spark).unionByName(spark.createDataFrame([row(50 + k, "hello hello hellos HELLO Straße STRASSE straße weiß×weiß÷ naïve naive été colour color colouur") for k in range(9)], DOCS))
    rows = [r.asDict() for r in docs.collect()]
    assert result(V.variants(docs)) == brute(brute_words(rows))
    assert result(V.variants(docs, drop_one_in=0)) == brute(brute_words(rows, drop=0))


def test_whole_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = brute_words([r.asDict() for r in docs.select("doc_id", "text").collect()])
    got = {r["word"]: r["n"] for r in V.words(docs).collect()}
    assert got == counts
    by_cut = {}
    for w in counts:
        for c in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}:
            by_cut.setdefault(c, set()).add(w)
    near = {w: sum(edit_one(w, x) for x in set().union(*(by_cut[c] for c in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))})) - {w}) for w in counts}
    assert {r["word"]: r["n_near"] for r in V.op12_spelling_variants(spark, sf).collect()} == near


def test_no_documents_no_words(spark):
    assert result(V.variants(empty(spark))) == []
    assert result(V.variants(spark.createDataFrame([row(1, None), row(2, ""), row(3, "abc 12")], DOCS))) == []


def test_near_words_of_dense_vocabularies(spark):
    for letters, lengths, bound in (("abc", (5, 9), 20), ("aei", (5, 8), 1), ("aeinrtsol", (5, 12), 500), ("ab", (5, 9), 3)):
        counts = dense_words(1500, letters, lengths, 1)
        got = {r["word"]: (r["n_near"], r["best_n"], r["best"]) for r in V.near_words(words_table(spark, counts), bound).collect()}
        want = {}
        for w in counts:
            others = [x for x in counts if abs(len(x) - len(w)) <= 1 and edit_one(w, x)]
            if others:
                best = min(others, key=lambda x: (-counts[x], x))
                want[w] = (len(others), counts[best], best)
        assert got == want, (letters, bound)


def test_subtree_of_one_vector_is_dealt_to_several_tasks(spark, monkeypatch):
    """Letters of one group, so all words of a length have one vector and the trie can't part them."""
    monkeypatch.setattr(V, "LEAST", 1)
    counts = dense_words(400, "kcq", (6, 7), 2)
    top = V.top_of(words_table(spark, counts), 50)
    assert any(len(p) == V.LEVELS for p in top)
    got = {r["word"]: r["n_near"] for r in V.near_words(words_table(spark, counts), 50).collect()}
    assert got == {w: n for w in counts if (n := sum(edit_one(w, x) for x in counts))}


def test_long_words_are_compared_whole(spark):
    a = "x" * 70_000
    counts = {a + "a": 9, a + "b": 4, a[:-1] + "a": 3, "y" + a[1:] + "a": 5, "ab" * 300: 7, "ab" * 299 + "a": 3, "ab" * 299 + "cd": 3, "e" * 64: 3, "e" * 65: 3, "e" * 63 + "f": 3}
    got = result(V.near_words(words_table(spark, counts)).selectExpr("word", "best form", "word root", "best_n n", "n_near", "best_n form_n"))
    want = [(w, f, n) for w, f, *_ in brute(counts) if (n := sum(edit_one(w, x) for x in counts if abs(len(x) - len(w)) <= 1))]
    assert sorted((r[0], r[4]) for r in got) == sorted((w, n) for w, _, n in want)


def test_roots_follow_long_chains(spark):
    forms = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(40)] + [("a", "w7")], "word string, form string")
    assert {r["word"]: r["root"] for r in V.roots(forms).collect()} == {**{f"w{k}": "w40" for k in range(40)}, "a": "w40"}


@settings(max_examples=200)
@given(st.lists(st.text("abé", min_size=1, max_size=6), min_size=1, max_size=30, unique=True))
def test_search_finds_exactly_the_words_one_edit_apart(names):
    tree = V.Subtree(names, np.ones(len(names), np.int64))
    which, entry = tree.near(names, V.vectors(names))
    assert sorted((names[i], tree.names[j]) for i, j in zip(which.tolist(), entry.tolist())) == sorted((a, b) for a in names for b in names if edit_one(a, b))


@given(st.text("abcé", max_size=8), st.text("abcé", max_size=8))
def test_one_edit(a, b):
    assert V.one_edit(a, b) == (a != b and edit_one(a, b))
