import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from xxhash import xxh64_intdigest

from verispark.llm.simhash_dedup import anchors, components, drop_near_copies, home, links, near_duplicates, op2_simhash_dedup, simhash, star

from .helpers import WORDS, awkward, empty, row, rows_of, DOCS


def plain(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(ids_fps):
    """component of each row by comparing all pairs"""
    up = list(range(len(ids_fps)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (_, a) in enumerate(ids_fps):
        for j, (_, b) in enumerate(ids_fps[:i]):
            if (a ^ b).bit_count() <= 3:
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(ids_fps):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids_fps))]


@given(st.text(max_size=60))
def test_fingerprint(text):
    assert simhash(text) == plain(text)


@given(st.integers(0, 2**32 - 1), st.integers(0, 31))
def test_covering(half, bit):
    """Each half is within 1 of its home; a half that differs in one bit is replicated to that home."""
    x, y = np.array([half], np.uint32), np.array([half ^ (1 << bit)], np.uint32)
    near, _ = home(x)
    assert int(near[0] ^ x[0]).bit_count() <= 1
    found = [int(a) for which, a in anchors(y) for a in a]
    assert int(near[0]) in found and len(found) == len(set(found)) <= 17
    assert all((a ^ int(y[0])).bit_count() <= 2 for a in found)
    assert int(home(near)[0][0]) == int(near[0])


@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)), min_size=1, max_size=40))
def test_star(edges):
    a, b = (np.array(c, np.int64) for c in zip(*edges))
    low, other = star(a, b)
    pairs = [(i, i) for i in range(21)]
    groups = {i: {i} for i, _ in pairs}
    for x, y in edges:
        if groups[x] is not groups[y]:
            groups[x] |= groups[y]
            for k in groups[y]:
                groups[k] = groups[x]
    want = {(min(groups[i]), i) for i in groups if min(groups[i]) != i}
    assert set(zip(low.tolist(), other.tolist())) == want


@pytest.mark.parametrize("dense,denser", [(0, 0), (1, 256), (4096, 256)])
def test_links_and_components(spark, dense, denser):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 2**63, 30)
    fps = [0]
    for s in seeds:
        for _ in range(8):
            x = int(s)
            for _ in range(int(rng.integers(0, 5))):
                x ^= 1 << int(rng.integers(0, 63))
            fps.append(x)
            s = x  # chains
    fps = sorted(set(fps))
    df = spark.createDataFrame([(f,) for f in fps], "fp long").repartition(5)
    comp = {r["node"]: r["root"] for r in components(links(df, dense=dense, denser=denser)).collect()}
    want = roots([(k, f) for k, f in enumerate(fps)])
    got = [comp.get(f, f) for f in fps]
    assert len(set(got)) == len(set(want))
    assert len(set(zip(got, want))) == len(set(want))


def test_brute_force(spark):
    base = " ".join(WORDS * 8)
    docs = awkward(spark).union(spark.createDataFrame([row(100 + k, base + " " + w) for k, w in enumerate(WORDS)], DOCS))
    got = sorted(((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in rows_of(near_duplicates(docs))), key=str)
    rows = [(r["doc_id"], plain(r["text"])) for r in rows_of(docs)]
    assert got == sorted(((d, f, c) for (d, f), c in zip(rows, roots(rows))), key=str)
    assert {c for d, _, c in got if d in (7, 8, 9)} == {7}


def test_query_on_whole_table(spark, sf):
    docs = rows_of(spark.read.parquet(f"{sf}/documents.parquet"))
    rows = [(r["doc_id"], plain(r["text"])) for r in docs]
    want = sorted((d, f"{f:016x}", c) for (d, f), c in zip(rows, roots(rows)))
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows_of(op2_simhash_dedup(spark, sf))) == want


def test_drop(spark):
    docs = awkward(spark)
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    got = sorted(r["doc_id"] for r in rows_of(kept) if r["doc_id"] is not None)
    want = {c for c in roots([(r["doc_id"], plain(r["text"])) for r in rows_of(docs)]) if c is not None}
    assert got == sorted(want)


def test_drop_keeps_one_row_of_each_component(spark):
    """Unrelated texts without an id, and one id on several texts."""
    base, other = " ".join(WORDS), [" ".join(f"{w}{k}" for w in WORDS) for k in range(8)]
    rows = [row(None, t) for t in other[:5]] + [row(None, other[0]), row(None, other[0].upper()), row(None, base), row(1, base)]  # the last two are one component
    rows += [row(1, other[5]), row(2, other[5] + " \n"), row(7, other[6]), row(7, other[7]), row(9, other[7])]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    comp = roots([(k, plain(r[1])) for k, r in enumerate(rows)])
    want = {}
    for r, c in zip(rows, comp):
        key = (r[0] is None, r[0] or 0)
        want[c] = min(want.get(c, key), key)
    kept = rows_of(drop_near_copies(docs))
    of = {(r[0], r[1]): c for r, c in zip(rows, comp)}
    assert len(want) == 9 and len(kept) == 9
    assert {of[r["doc_id"], r["text"]]: (r["doc_id"] is None, r["doc_id"] or 0) for r in kept} == want


def test_empty(spark):
    assert near_duplicates(empty(spark)).count() == 0
    assert drop_near_copies(empty(spark)).count() == 0
