import re
import time
from hashlib import sha256

from pyspark.sql import functions as F

from verispark.llm.secret_scan import op9_secret_scan, scan_secrets, written

from .helpers import DOCS, awkward, empty, row, rows_of

KINDS = ("assign", "access", "hex")


def base(text):
    out = []
    for m in re.finditer(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or ""):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end(), m[2]))
    out += [(m.start(), 1, m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), m[0]) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 32]
    return sorted(out)


def generic(text):
    found = [(m.start(), 3, m.end(), m[0]) for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text or "")]
    mixed = [s for s in found if all(re.search(c, s[3]) for c in ("[A-Z]", "[a-z]", "[0-9]"))]
    return [s for s in mixed if not any(b[0] < s[2] and s[0] < b[2] for b in base(text))]


def expected(docs):
    owners = {}
    for _, text, source in docs:
        for s in base(text) + generic(text):
            owners.setdefault(s[3], set())
            if source is not None:
                owners[s[3]].add(source)
    out = []
    for d, text, _ in docs:
        b, g = base(text), generic(text)
        n = {s: len(owners[s[3]]) for s in b + g}
        out.append((d, b, sorted(s for s in g if n[s] <= 1), sorted(s for s in g if n[s] == 2), sum(n[s] >= 3 for s in b + g), sum(n[s] <= 1 for s in b + g), sum(n[s] == 2 for s in b + g)))
    return sorted(out, key=str)


def got(df):
    t = lambda spans: [tuple(s[k] for k in ("start", "kind", "end", "secret")) for s in spans]
    return sorted(((r["doc_id"], t(r["base"]), t(r["added"]), t(r["shared"]), r["n_copied"], r["n_live"], r["n_shared"]) for r in rows_of(df)), key=str)


def many(spark):
    copied, own = "Zx9" * 8, "Qw3rtY" * 4
    rows = [row(100 + k, f"é😀 key {copied} and AKIA{'B' * 12}{k}", source=f"s{k}") for k in range(4)]
    rows += [row(200, f"token: secret: abcdefghij {own}"), row(201, f"PASSWORD = '{own}' {own}"), row(202, "token=abc token=abcdefgh1 secret:'12345678' api_key : x.y-z=+/__ApiKey='abcdefgh'"), row(203, "f" * 31 + " " + "f" * 32 + "AKIAKIAAAAAAAAAAAA", source=None)]
    return spark.createDataFrame(rows, DOCS)


def test_brute_force(spark):
    docs = awkward(spark).dropDuplicates(["doc_id"]).union(many(spark))
    assert got(scan_secrets(docs)) == expected([(r["doc_id"], r["text"], r["source"]) for r in rows_of(docs)])


def test_query_on_whole_table(spark, sf):
    docs = [(r["doc_id"], r["text"], r["source"]) for r in rows_of(spark.read.parquet(f"{sf}/documents.parquet"))]
    rows = {r["doc_id"]: r for r in rows_of(op9_secret_scan(spark, sf))}
    text = lambda spans: ",".join(f"{(*KINDS, 'generic')[k]}:{a}:{b}" for a, k, b, _ in sorted(spans))
    for d, b, added, both, copied, live, shared in expected(docs):
        r = rows.pop(d)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[1] == k for s in b) for k in range(3))
        assert r["base_sha256"] == sha256(text(b).encode()).hexdigest() and r["spans"] == text(b + added + both) and (r["n_copied"], r["n_live"], r["n_shared"]) == (copied, live, shared)
    assert not rows


def test_every_span_has_a_class(spark):
    """A candidate that two sources hold is neither live nor widely copied, and isn't lost."""
    two, three, one = "Ab1" * 7, "Cd2" * 7, "Ef3" * 7
    rows = [row(1, f"{two} {three} {one}", source="s0"), row(2, f"x {two} {three}", source="s1"), row(3, f"{three} token={two}", source="s1"), row(4, three, source="s2"), row(5, "none")]
    found = {r["doc_id"]: r for r in rows_of(scan_secrets(spark.createDataFrame(rows, DOCS)))}
    secrets = lambda d, c: [s["secret"] for s in found[d][c]]
    assert [secrets(d, "shared") for d in range(1, 6)] == [[two], [two], [], [], []]
    assert [secrets(d, "added") for d in range(1, 6)] == [[one], [], [], [], []]
    assert [(r["n_copied"], r["n_live"], r["n_shared"]) for r in (found[d] for d in range(1, 6))] == [(1, 1, 1), (1, 0, 1), (1, 0, 1), (1, 0, 0), (0, 0, 0)]


def test_both_counts_of_every_span(spark):
    """One source's example in many documents can be told from a credential of one document."""
    often, once = "Ab1" * 7, "AKIA" + "C" * 16
    rows = [row(k, f"é {often}", source="s0") for k in range(5)] + [row(9, f"{once} {often}", source=None), row(10, "none")]
    found = {r["doc_id"]: r["held"] for r in rows_of(scan_secrets(spark.createDataFrame(rows, DOCS)))}
    assert [tuple(h) for h in found[0]] == [(2, 3, 23, 6, 1)]
    assert [tuple(h) for h in found[9]] == [(0, 1, 20, 1, 0), (21, 3, 42, 6, 1)]
    assert found[10] == []


def test_many_matches_in_one_text(spark):
    """200,000 matches cost a sort of them, not a comparison of all pairs."""
    n = 200_000
    text = "é " + " ".join(["AKIA" + "B" * 12, "Ab1" * 7] * (n // 2))
    began = time.time()
    found = scan_secrets(spark.createDataFrame([row(1, text), row(None, text), row(None, "none")], DOCS).repartition(2)).select(F.size("base"), F.size("added"), F.try_element_at("base", F.lit(-1))["end"], F.try_element_at("added", F.lit(-1))["end"], "n_live").collect()
    assert time.time() - began < 60
    assert sorted(tuple(r) for r in found if r[0]) == [(n // 2, n // 2, len(text) - 22, len(text), n)] * 2
    assert [tuple(r) for r in found if not r[0]] == [(0, 0, None, None, 0)]


def test_overlaps(spark):
    """Candidates that touch a base span go, whichever starts first; neighbours stay."""
    long = "Ab1" * 7
    texts = [f"token={long}", f"{long}=token={long}", f"{long}", f"x{'a1' * 16}Q {long}", f"{long}token=12345678", f"AKIA{'B' * 12}+{long} {long}", f"{'0' * 32}/{long}"]
    docs = spark.createDataFrame([row(k, t) for k, t in enumerate(texts)], DOCS)
    assert got(scan_secrets(docs)) == expected([(k, t, "s0") for k, t in enumerate(texts)])


def test_repeated_rows_and_empty(spark):
    docs = many(spark)
    twice = scan_secrets(docs.union(docs))
    assert twice.count() == 2 * docs.count()
    assert sorted({str(x) for x in got(twice)}) == sorted({str(x) for x in got(scan_secrets(docs))})
    assert scan_secrets(empty(spark)).count() == 0
    assert rows_of(scan_secrets(docs).select(F.max(written(F.col("base")))))


def test_letters_beyond_ascii_are_no_other_case_of_ascii_letters(spark):
    """A long s and the Kelvin sign aren't s and k; Spark, the brute force and the SQL agree."""
    import duckdb

    from verispark.llm.secret_scan import OP9_SQL

    texts = ["\u017fecret = abcdefgh1", "to\u212aen: abcdefgh1", "SeCrEt = abcdefgh1", "API\u212aEY=abcdefgh1 apiKEY=abcdefgh2"]
    docs = spark.createDataFrame([row(k, t) for k, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: [s["secret"] for s in r["base"]] for r in scan_secrets(docs).collect()}
    assert got == {0: [], 1: [], 2: ["abcdefgh1"], 3: ["abcdefgh2"]} == {k: [s[3] for s in base(t)] for k, t in enumerate(texts)}
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toPandas())
    assert dict(con.sql(f"SELECT doc_id, n_assign FROM ({OP9_SQL})").fetchall()) == {0: 0, 1: 0, 2: 1, 3: 1}
