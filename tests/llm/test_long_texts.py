"""One text of 20 MB among short ones, for the operators that read whole texts."""

from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

from verispark.llm._common import new_path
from verispark.llm.best_fit_packing import pack_documents
from verispark.llm.decontamination import contamination
from verispark.llm.kneser_ney import score, train
from verispark.llm.language_id import identify, learn_profiles
from verispark.llm.simhash_dedup import near_duplicates
from verispark.llm.token_binary import read_token_ids, write_token_ids
from verispark.llm.tokens import default_tokenizer

from .helpers import DOCS, WORDS, row, rows_of
from .test_models import Plain, grams

SIZE = 20 << 20


@pytest.fixture(scope="module")
def text():
    rng = np.random.default_rng(5)
    letters = list("etaoinshrdlu") + ["é", "ß"]
    vocabulary = np.array([w for w in {"".join(rng.choice(letters, rng.integers(2, 16))) for _ in range(300)}] + ["Mixed,", "end."])
    parts, n = [], 0
    while n < SIZE:
        parts.append(" ".join(vocabulary[rng.integers(0, len(vocabulary), 5000)]))
        n += len(parts[-1].encode())
    return "\n".join(parts)


@pytest.fixture(scope="module")
def docs(spark, text):
    base = " ".join(WORDS)
    return spark.createDataFrame([row(1, base), row(2, text), row(3, base + " again", "de"), row(4, ""), row(5, None)], DOCS).repartition(2).cache()


@pytest.fixture(scope="module")
def ids(text):
    return np.array(Tokenizer.from_file(default_tokenizer()).encode(text, add_special_tokens=False).ids + [2], "<u4")


def test_fingerprint(docs, text):
    words = text.split()
    low = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words]
    h = np.array([xxh64_intdigest(" ".join(low[k : k + 3]), 42) for k in range(len(low) - 2)], np.uint64)
    want = sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(h))
    got = {r["doc_id"]: r for r in rows_of(near_duplicates(docs))}
    assert got[2]["fp"] % 2**64 == want and got[2]["component_id"] == 2 and got[5]["component_id"] == 4


def test_token_files(spark, docs, ids):
    path = new_path(spark, "long")
    write_token_ids(docs, path)
    got = {r["doc_id"]: r for r in rows_of(read_token_ids(spark, path))}
    assert np.array_equal(np.frombuffer(got[2]["ids"], "<u4"), ids)
    assert got[3]["start"] == got[2]["start"] + len(ids)


def test_packing(docs, ids):
    mine = sorted((r for r in rows_of(pack_documents(docs)) if r["doc_id"] == 2), key=lambda r: r["piece"])
    first = (len(ids) - 1) % 1024 + 1
    assert [r["length"] for r in mine] == [first] + [1024] * ((len(ids) - first) // 1024)
    assert [r["ids_crc32"] for r in mine] == [crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in mine]
    assert mine[0]["start"] == 0 and len({r["sequence_id"] for r in mine}) == len(mine)


def test_language(docs, text):
    profiles = learn_profiles(docs)
    total = Counter()
    for word, n in Counter(text.split()).items():
        for g, k in grams(word).items():
            total[g] += n * k
    own = [g for g, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))][:400]
    far = {lang: sum(min(400, abs(k - p.index(g))) if g in p else 400 for k, g in enumerate(own)) for lang, p in profiles.items()}
    best = min(far, key=lambda x: (far[x], x))
    got = {r["doc_id"]: r["lang_found"] for r in rows_of(identify(docs, profiles))}[2]
    assert (got["lang"], got["score"]) == (best, pytest.approx(1 - far[best] / (400 * len(own))))


def test_language_model(docs, text):
    rows = rows_of(docs)
    plain = Plain([r["text"] for r in rows])
    model = train(docs)
    assert (model.tokens, model.types, model.continuations) == (plain.n, plain.v, plain.continuations)
    got = {r["doc_id"]: r for r in rows_of(score(docs, model))}[2]
    n, known, base, total = plain.row(text)
    assert (got["n_tokens"], got["n_known"]) == (n, known)
    assert np.allclose([got["base_score"], got["score"]], [base, total], rtol=1e-9)


@pytest.mark.parametrize("max_windows", [0, 10**6])
def test_benchmark_items(spark, docs, text, max_windows):
    """An item from the text's end, with the broadcast table and with the join."""
    words = text.split()
    items = spark.createDataFrame([(7, " ".join(words[-12:])), (8, "nothing of this occurs in any text, not even once in them all")], "item_id long, text string")
    got = {r["doc_id"]: r for r in rows_of(contamination(docs, items, max_windows=max_windows))}
    assert (got[2]["n_words"], got[2]["n_hit"], list(got[2]["item_ids"])) == (len(words), 12, ["7"])
    assert [(s["start"], s["end"]) for s in got[2]["spans"]] == [(len(text) - len(" ".join(words[-12:])), len(text.rstrip(".,")))]
    assert got[1]["n_hit"] == got[5]["n_hit"] == 0
