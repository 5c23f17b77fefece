from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verispark.llm._common import new_path
from verispark.llm.best_fit_packing import pack_documents, sweep
from verispark.llm.token_binary import op3_token_binary, pack, read_token_ids, unpack, write_token_ids
from verispark.llm.token_counts import length_histogram, length_quantile, suffix_sums, truncated_total
from verispark.llm.tokens import Encoder, default_tokenizer, id_arrays

from .helpers import awkward, empty, rows_of


@pytest.fixture(scope="module")
def coder():
    return Encoder(default_tokenizer(), memo_entries=50)


def ids_of(coder, text, end=True):
    return coder.tokenizer.encode(text or "", add_special_tokens=False).ids + [2] * end


PARTS = st.sampled_from(["a", "the", "Words,", "é", " ", "  ", "\n", " \n", "\t", "'s", "12", "!", "<|endoftext|>", "\x1c", "　", "日本", "'", "\x00", "\x85", "😀", "\xa0", "|", "end.", "a1", "x.y", "don't.", "ÿ×Ā", "é5", "ɏʰ", "\nB", "1,000", "\r", "́"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(PARTS, max_size=12).map("".join), max_size=8))
def test_encoder_equals_library(coder, texts):
    for end in (False, True):
        coded = coder.encode(pa.array(texts, pa.string()), end)
        want = [ids_of(coder, t, end) for t in texts]
        assert [np.frombuffer(b, "<u4").tolist() for b in coded.to_pylist()] == want
        ids, ends = id_arrays(coded)
        assert ids.tolist() == sum(want, []) and np.diff(ends).tolist() == [len(w) for w in want]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.sampled_from(["byte", "bit"]), st.sampled_from([1, 7, 64]))
def test_planes_round_trip(ids, mode, block):
    a = np.array(ids, "<u4")
    sizes, planes = pack(a, mode, block)
    assert (unpack(sizes, planes, len(a), mode, block) == a).all()


@pytest.mark.parametrize("mode,chunk", [("byte", 1 << 20), ("bit", 50)])
def test_write_and_read(spark, coder, mode, chunk):
    docs, path = awkward(spark), new_path(spark, "t")
    write_token_ids(docs, path, mode=mode, chunk_ids=chunk, block_ids=64)
    got = sorted(rows_of(read_token_ids(spark, path)), key=lambda r: r["start"])
    rows = sorted(rows_of(docs), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    at = 0
    assert len(got) == len(rows)
    for g, r in zip(got, rows):
        want = ids_of(coder, r["text"])
        assert (g["doc_id"], g["start"], g["n_tokens"], np.frombuffer(g["ids"], "<u4").tolist()) == (r["doc_id"], at, len(want), want)
        at += len(want)


def test_query_on_whole_table(spark, sf, coder):
    got = {r["doc_id"]: r for r in rows_of(op3_token_binary(spark, sf))}
    at = 0
    for r in sorted(rows_of(spark.read.parquet(f"{sf}/documents.parquet")), key=lambda r: r["doc_id"]):
        want = np.array(ids_of(coder, r["text"]), "<u4")
        g = got.pop(r["doc_id"])
        assert (g["start"], g["n_tokens"], g["ids_crc32"]) == (at, len(want), crc32(want.tobytes()))
        at += len(want)
    assert not got


def test_histogram(spark, sf, coder):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text").union(awkward(spark).select("text"))
    n = np.array([len(ids_of(coder, r["text"])) for r in rows_of(docs)])
    sums = suffix_sums(length_histogram(docs)).cache()
    for r in rows_of(sums):
        L = r["n_tokens"]
        want = ((n == L).sum(), n[n == L].sum(), (n >= L).sum(), n[n >= L].sum(), np.minimum(n, L).sum(), (n <= L).sum())
        assert (r["n_docs"], r["tokens"], r["docs_at_least"], r["tokens_at_least"], r["truncated_tokens"], r["docs_at_most"]) == want
    for limit in (0, 1, 33, 1024, 10**9):
        assert truncated_total(sums, limit).first()[0] == np.minimum(n, limit).sum()
    for q in (0.01, 0.5, 0.9, 1.0):
        assert length_quantile(sums, q).first()[0] == np.sort(n)[int(np.ceil(q * len(n))) - 1]


def check_packing(rows, texts, coder, size):
    want, seqs = {}, {}
    for r in rows:
        want.setdefault(r["doc_id"], []).append(r)
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for members in seqs.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= size
    for doc_id, text in texts:
        ids = np.array(ids_of(coder, text), "<u4")
        got = sorted(want[doc_id], key=lambda r: r["piece"])
        assert [r["piece"] for r in got] == list(range(len(got)))
        at = 0
        for k, r in enumerate(got):
            assert r["start"] == at and (k == 0 or r["length"] == size)
            assert r["ids_crc32"] == crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    return len(seqs)


def test_packing(spark, sf, coder):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = rows_of(pack_documents(docs))
    n = check_packing(rows, [(r["doc_id"], r["text"]) for r in rows_of(docs)], coder, 1024)
    total = sum(r["length"] for r in rows)
    gaps = []
    for length in sorted((r["length"] for r in rows), reverse=True):  # plain best-fit decreasing
        fit = min((g for g in gaps if g >= length), default=None)
        if fit is None:
            gaps.append(1024 - length)
        else:
            gaps[gaps.index(fit)] -= length
    assert -(-total // 1024) <= n == len(gaps)


def test_packing_awkward(spark, coder):
    docs = awkward(spark).dropDuplicates(["doc_id"])
    check_packing(rows_of(pack_documents(docs, max_tokens=16)), [(r["doc_id"], r["text"]) for r in rows_of(docs)], coder, 16)
    twice = docs.union(docs)
    rows = rows_of(pack_documents(twice, max_tokens=16))
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows) == 2 * pack_documents(docs, max_tokens=16).count()


def best_fit_decreasing(lengths, gaps, size):
    gaps = list(gaps)
    for length in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= length), default=None)
        if fit is not None:
            gaps.remove(fit)
        gaps.append((size if fit is None else fit) - length)
    return sorted(gaps)


@given(st.lists(st.integers(1, 32), max_size=120), st.lists(st.integers(1, 31), max_size=20))
def test_sweep_is_best_fit_decreasing(lengths, gaps):
    lengths = sorted(lengths, reverse=True)
    places, offsets, left = sweep(lengths, gaps, 32)
    assert sorted(left) == best_fit_decreasing(lengths, gaps, 32)
    room, used = gaps + [32] * (len(left) - len(gaps)), [0] * len(left)
    for place, offset, length in zip(places, offsets, lengths):
        assert offset == used[place]
        used[place] += length
    assert [r - u for r, u in zip(room, used)] == left and min(left, default=0) >= 0


@given(st.lists(st.integers(1, 32), max_size=60), st.lists(st.integers(1, 31), max_size=20))
def test_a_sweep_that_opens_nothing_leaves_what_fits_nowhere(lengths, gaps):
    lengths = sorted(lengths, reverse=True)
    places, _, left = sweep(lengths, gaps, 32, opens=False)
    assert len(left) == len(gaps) and sum(gaps) - sum(left) == sum(n for n, p in zip(lengths, places) if p >= 0)
    assert all(n > max(left, default=0) for n, p in zip(lengths, places) if p < 0)


@pytest.mark.parametrize("task_pieces", [25, 100, 100_000])
def test_rounds_over_many_tasks(spark, sf, coder, task_pieces):
    """Any number of tasks gives a valid packing, of at most one sequence more than best-fit decreasing; one task gives just that."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 150")
    rows = rows_of(pack_documents(docs, max_tokens=256, task_pieces=task_pieces))
    n = check_packing(rows, [(r["doc_id"], r["text"]) for r in rows_of(docs)], coder, 256)
    best = len(best_fit_decreasing([r["length"] for r in rows], [], 256))
    assert n == best if task_pieces > len(rows) else n <= best + 1


def test_empty(spark):
    path = new_path(spark, "t")
    write_token_ids(empty(spark), path)
    assert read_token_ids(spark, path).count() == 0
    sums = suffix_sums(length_histogram(empty(spark)))
    assert sums.count() == 0 and truncated_total(sums, 5).first()[0] == 0 and length_quantile(sums, 0.5).first()[0] is None
    assert pack_documents(empty(spark)).count() == 0


def test_order_of_ids_is_ascending(spark):
    path = new_path(spark, "t")
    docs = spark.range(500).select((F.lit(500) - F.col("id")).alias("doc_id"), F.concat(F.lit("t "), F.col("id")).alias("text")).repartition(7)
    write_token_ids(docs, path)
    got = sorted(rows_of(read_token_ids(spark, path)), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == list(range(1, 501))
