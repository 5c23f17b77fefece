import re
from hashlib import sha256

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from verispark.llm.decontamination import contamination, decontaminate, item_windows, op5_decontamination, passing, window_filter, windows_of, words_of

from .helpers import DOCS, WORDS, awkward, empty, row, rows_of

ITEMS = "item_id long, text string, extra string"


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def expected(docs, items):
    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9)) if w else ():
            wins.setdefault(tuple(w[k : k + 10]), set()).add(i)
    sizes = {len(x) for x in wins}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                for i in wins.get(tuple(w[k : k + n]), ()):
                    hit |= set(range(k, k + n))
                    found |= {str(i)} if i is not None else set()
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def bench(spark):
    rows = [(1, " ".join(WORDS[:12])), (2, "Lazy DOG!"), (3, None), (4, "..."), (2, "lazy dog"), (10, "seven wizards"), (None, "stone bridges"), (5, " ".join(WORDS[:10]))]
    return spark.createDataFrame([(i, t, "q") for i, t in rows], ITEMS)


@pytest.mark.parametrize("options", [{}, {"max_windows": 0}, {"max_windows": 0, "max_words": 1}])
def test_brute_force(spark, options):
    """By the broadcast table; by a join; by a join behind a filter that lets nearly everything pass."""
    docs = awkward(spark).union(spark.createDataFrame([row(50, "a lazy, DOG lazy dog"), row(51, "xx " + " ".join(WORDS[1:12]) + " yy"), row(52, "lazy")], DOCS))
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["item_ids"])) for r in rows_of(contamination(docs, bench(spark), **options))), key=str)
    assert got == expected([(r["doc_id"], r["text"]) for r in rows_of(docs)], [(r["item_id"], r["text"]) for r in rows_of(bench(spark))])


def test_filter_passes_all_windows_and_few_others(spark):
    texts = [" ".join(f"w{k + j}" for j in range(40)) for k in range(0, 4000, 20)]
    items = spark.createDataFrame([(k, t, "q") for k, t in enumerate(texts)], ITEMS)
    hashes = {w: int.from_bytes(xxh64_digest(w), "little", signed=True) for t in texts for w in windows_of(words_of(t))}
    assert {bytes(r["window"]) for r in rows_of(item_windows(items))} == set(hashes)
    table = window_filter(spark.createDataFrame([(h,) for h in hashes.values()], "hash long"), len(hashes))
    assert len(table) * 64 >= 8 * len(hashes)
    for held in (7, 10**6):
        got = list(passing(((b"k", t) for t in texts), [10], table, held))
        assert {w for _, _, found, _ in got for w in found} == set(hashes)
        assert all(h.tolist() == [hashes[w] % 2**64 for w in found] for _, _, found, h in got)
    others = [" ".join(f"x{k}" for k in range(20_009))]
    assert sum(len(found) for *_, found, _ in passing(((b"k", t) for t in others), [10], table)) < 0.05 * 20_000


def test_window_that_most_texts_share(spark):
    """A passage of three items in 3,000 different texts and in one text that 1,500 rows repeat, by a join."""
    common = " ".join(WORDS[:14])
    docs = spark.createDataFrame([row(k, f"n{k} {common} {common}") for k in range(3000)] + [row(5000 + k, f"same {common}") for k in range(1500)] + [row(9000, "clean text")], DOCS)
    items = spark.createDataFrame([(k, common + f" tail{k}", "q") for k in range(3)], ITEMS)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["item_ids"])) for r in rows_of(contamination(docs, items, max_windows=0))}
    assert got == {k: (29, 28, ["0", "1", "2"]) for k in range(3000)} | {5000 + k: (15, 14, ["0", "1", "2"]) for k in range(1500)} | {9000: (2, 0, [])}


def test_query_on_whole_table(spark, sf):
    items = [(r["item_id"], r["text"]) for r in rows_of(spark.read.parquet(f"{sf}/benchmark.parquet"))]
    docs = [(r["doc_id"], r["text"]) for r in rows_of(spark.read.parquet(f"{sf}/documents.parquet"))]
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows_of(op5_decontamination(spark, sf))), key=str)
    assert got == sorted(((d, n, h, len(i), sha256(",".join(i).encode()).hexdigest(), h > 0) for d, n, h, i in expected(docs, items)), key=str)


def test_spans_are_cut(spark):
    docs = spark.createDataFrame([row(1, "Ünder a Lazy, dog; sits seven"), row(2, None), row(3, "clean")], DOCS)
    kept = decontaminate(docs, bench(spark), mode="span")
    assert kept.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in rows_of(kept)} == {1: "Ünder a ; sits seven", 2: None, 3: "clean"}
    dropped = decontaminate(docs, bench(spark))
    assert dropped.columns == docs.columns and sorted(r["doc_id"] for r in rows_of(dropped)) == [2, 3]


def test_empty(spark):
    none = bench(spark).where(F.lit(False))
    assert contamination(empty(spark), bench(spark)).count() == 0
    assert {r["n_hit"] for r in rows_of(contamination(awkward(spark), none))} == {0}
    assert decontaminate(awkward(spark), none).count() == awkward(spark).count()
    assert windows_of(words_of("")) == []
