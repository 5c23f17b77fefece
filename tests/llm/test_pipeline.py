import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F

from verispark.llm.tokens import Encoder, default_tokenizer

from .helpers import awkward, empty, rows_of
from .test_decontamination import words
from .test_exact_dedup import strip
from .test_simhash_dedup import plain, roots
from .test_tokens import best_fit_decreasing, check_packing


@pytest.fixture(scope="module")
def coder():
    return Encoder(default_tokenizer())


def test_run_by_brute_force(spark, sf, coder):
    """Which documents stay, and every piece and place of them, with code of its own."""
    kept = [r for r in rows_of(spark.read.parquet(f"{sf}/documents.parquet")) if any(c.isalpha() for c in r["text"] or "")]
    best = {}
    for r in kept:
        k = strip(r["text"])
        if k not in best or (-len(r["text"]), r["doc_id"]) < (-len(best[k]["text"]), best[k]["doc_id"]):
            best[k] = r
    kept = list(best.values())
    kept = [r for r, c in zip(kept, roots([(r["doc_id"], plain(r["text"])) for r in kept])) if r["doc_id"] == c]
    wins = set()
    for r in rows_of(spark.read.parquet(f"{sf}/benchmark.parquet")):
        w = words(r["text"])
        wins |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()

    def clean(text):
        w = words(text)
        return not any(tuple(w[k : k + n]) in wins for n in {len(x) for x in wins} for k in range(len(w) - n + 1))

    kept = [r for r in kept if clean(r["text"])]
    got = P.run(spark, sf)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = rows_of(got)
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in kept}
    n = check_packing(rows, [(r["doc_id"], r["text"]) for r in kept], coder, 1024)
    assert n == len(best_fit_decreasing([r["length"] for r in rows], [], 1024))


def test_stages_on_awkward_tables(spark, sf):
    assert [n for n, _ in P.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    for docs in (awkward(spark), empty(spark), awkward(spark).withColumn("text", F.lit(None).cast("string"))):
        for _, stage in P.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            docs = out
        assert P.STAGES[-1][1](spark, docs, sf).count() >= 0


def test_clashing_columns_stay(spark, sf):
    """Columns that bear the names of a stage's own columns come out as they went in."""
    names = ["hits", "lang_found", "no_id", "id", "text_hash", "sha", "neg_chars", "text_sha256", "windows_found", "_hits", "fp", "root"]
    docs = awkward(spark).drop("fp", "kept")
    more = docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, more, sf)
        assert out.columns == more.columns
        assert sorted(map(str, rows_of(out.select(docs.columns)))) == sorted(map(str, rows_of(stage(spark, docs, sf))))
        assert all(r[n] == (None if r["doc_id"] is None else f"{n}{r['doc_id']}") for r in rows_of(out) for n in names)
