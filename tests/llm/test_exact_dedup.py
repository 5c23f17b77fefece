import tracemalloc
from hashlib import sha256

import pytest
from hypothesis import given
from hypothesis import strategies as st

from verispark.llm.exact_dedup import NODE_BYTES, Patricia, drop_exact_copies, exact_dedup

from .helpers import DOCS, awkward, empty, row, rows_of


def strip(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


@given(st.lists(st.tuples(st.binary(max_size=5).map(lambda b: bytes(x % 3 for x in b)), st.integers(0, 9)), max_size=40), st.integers(0, 20))
def test_trie_equals_dictionary(items, nodes):
    """Whatever the budget, spilled and drained parts add up; the byte count is that of the nodes that are left."""
    trie, want, parts = Patricia(), {}, []
    for key, i in items:
        trie.insert(key, (0, i), 1, key[::-1])
        owner, n = want.get(key, ((0, i), 0))
        want[key] = (min(owner, (0, i)), n + 1)
        if trie.bytes > nodes * NODE_BYTES:
            parts += trie.spill(nodes * NODE_BYTES // 2)
            assert trie.bytes <= nodes * NODE_BYTES // 2
        assert trie.bytes == weight(trie.root) - NODE_BYTES
    parts += trie.drain()
    got = {}
    for key, owner, n, digest in parts:
        assert digest == key[::-1]
        o, m = got.get(key, (owner, 0))
        got[key] = (min(o, owner), m + n)
    assert got == want
    assert trie.bytes == 0


def weight(node):
    size = sum(weight(c) for c in node[1].values()) + len(node[0]) + NODE_BYTES
    assert node[3] in (size, size - NODE_BYTES)  # the root has no label and isn't counted
    return size


def test_budget_bounds_memory():
    """30,000 texts that share a prefix of 20 KB, and as many that share nothing, in twice the budget."""
    budget = 8 << 20
    for prefix in (b"p" * 20_000, b""):
        trie, n = Patricia(), 0
        tracemalloc.start()
        for k in range(30_000):
            own = sha256(str(k).encode()).digest()
            trie.insert(prefix + own * (1 if prefix else 30), (-k, False, k), 1, own)
            if trie.bytes > budget:
                n += sum(1 for _ in trie.spill(budget // 2))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 2 * budget
        assert n + sum(1 for _ in trie.drain()) == 30_000


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(strip(r["text"]), []).append(r)
    out = []
    for body, members in groups.items():
        keep = min(members, key=lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0))["doc_id"]
        out += [(r["doc_id"], keep, len(members), r["doc_id"] == keep, sha256(body.encode()).hexdigest()) for r in members]
    return sorted(out, key=str)


@pytest.mark.parametrize("trie_bytes", [1, 3000, 1 << 20])
def test_brute_force(spark, trie_bytes):
    docs = awkward(spark)
    got = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in rows_of(exact_dedup(docs, trie_bytes=trie_bytes))]
    assert sorted(got, key=str) == expected(rows_of(docs))


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in rows_of(exact_dedup(docs))]
    assert sorted(got, key=str) == expected(rows_of(docs))


def test_drop_keeps_one_row_and_all_columns(spark):
    docs = awkward(spark)
    kept = drop_exact_copies(docs)
    assert kept.columns == docs.columns
    got = rows_of(kept)
    assert len(got) == len({strip(r["text"]) for r in rows_of(docs)})
    assert {r["doc_id"] for r in got} >= {4, 7, None, 2}
    assert 3 not in {r["doc_id"] for r in got}


def test_drop_keeps_the_longest_of_one_id(spark):
    docs = spark.createDataFrame([row(1, "ab"), row(1, "a  b  "), row(1, "a  b  "), row(2, "a b"), row(None, "x y"), row(None, "xy"), row(3, "z")], DOCS).repartition(4)
    assert sorted(r["text"] for r in rows_of(drop_exact_copies(docs))) == ["a  b  ", "x y", "z"]


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 7, "s", 0), (2, "ab", 8, "t", 1)], "doc_id long, text string, sha int, neg_chars string, no_id int")
    assert [tuple(r) for r in drop_exact_copies(docs).collect()] == [(1, "a b", 7, "s", 0)]


def test_empty(spark):
    assert exact_dedup(empty(spark)).count() == 0
    assert drop_exact_copies(empty(spark)).count() == 0
