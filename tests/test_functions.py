"""Literal cases of the column functions."""

import math

import pytest
from pyspark.sql import functions as F

from verispark.config import VerifyConfig
from verispark.functions import frames, similarity, snapshot


def one(spark, schema, values, *cols):
    return spark.createDataFrame([values], schema).select(*cols).first()


@pytest.mark.parametrize("a,b,want", [([1, 2, 3], [1, 2, 3], 0), ([1, 0, 0], [0, 1, 0], 1), ([1, 0], [-1, 0], 2), ([0, 0, 0], [1, 2, 3], 1), ([1, 1], [1, 0], 1 - 1 / math.sqrt(2)), ([], [], 1)])
def test_cosine(spark, a, b, want):
    got = one(spark, "a array<double>, b array<double>", ([float(x) for x in a], [float(x) for x in b]), similarity.cosine_distance(F.col("a"), F.col("b")), similarity.length_error(F.col("a"), F.col("b")))
    assert got[0] == pytest.approx(want, abs=1e-12) and got[1] is None


def test_cosine_length(spark):
    got = one(spark, "a array<double>, b array<double>", ([1.0, 0.0], [1.0, 0.0, 0.0]), similarity.cosine_distance(F.col("a"), F.col("b")), similarity.length_error(F.col("a"), F.col("b")))
    assert got[0] is None and "2 and 3" in got[1]


@pytest.mark.parametrize("d,t,want", [(0.0, 0.68, (True, 100.0, 0.0)), (1.0, 0.68, (False, 0.0, 1.0)), (0.0, 0.0, (True, 100.0, 0.0)), (-2.2e-16, 0.68, (True, 100.0, 0.0)), (0.68, 0.68, (True, 32.0, 0.68)), (2.0, 0.68, (False, 0.0, 2.0))])
def test_verdict(spark, d, t, want):
    v = one(spark, "d double, t double", (d, t), similarity.verdict(F.col("d"), F.col("t")))[0]
    assert tuple(v) == want and math.copysign(1, v["distance"]) == 1


def test_thresholds(spark):
    get = lambda explicit, cfg: spark.range(1).select(similarity.effective_threshold(explicit, VerifyConfig(similarity_threshold=cfg))).first()[0]
    assert [get(None, 0.5), get(None, 0.0), get(None, None), get(0.0, 0.5)] == [0.5, 0.68, 0.68, 0.0]


@pytest.mark.parametrize("d,want", [(0.05, ("excellent", None, None)), (0.2, ("good", None, None)), (0.5, ("acceptable", None, None)), (0.9, ("very_high", 0.22, None)), (0.7, ("high", 0.02, None))])
def test_band(spark, d, want):
    assert tuple(one(spark, "d double", (d,), similarity.match_band(F.col("d"), F.lit(0.68)))[0]) == want


def test_marginal_band(spark):
    assert tuple(one(spark, "d double", (0.5,), similarity.match_band(F.col("d"), F.lit(0.4)))[0]) == ("marginal", 0.1, 0.51)


def test_expected_size(spark):
    rows = spark.createDataFrame([("ArcFace",), ("Dlib",), ("Unknown",)], "m string").select(similarity.expected_size(F.col("m"))).collect()
    assert [r[0] for r in rows] == [512, 128, None]


def test_first_face(spark):
    rows = spark.createDataFrame([(["a", "b"],), ([],), (None,)], "f array<string>").select(similarity.first_face(F.col("f")).alias("x")).collect()
    assert [(r["x"]["face"], r["x"]["error"] is None) for r in rows] == [("a", True), (None, False), (None, False)]


@pytest.mark.parametrize("text,want", [("Face could not be Detected in img1_path", "probe"), ("face not detected img2_path", "reference"), ("no face detected", "either"), ("face missing", "other"), ("boom", "other")])
def test_error_class(spark, text, want):
    e = one(spark, "m string", (text,), similarity.classify_error(F.col("m")))[0]
    assert e["error_class"] == want and (want != "other" or e["user_message"] == text)


@pytest.mark.parametrize("text,want", [("aGVsbG8=", b"hello"), ("data:image/jpeg;base64,aGVsbG8=", b"hello"), ("/9j/4A==", b"\xff\xd8\xff\xe0"), ("aGVsbG8", None), ("aGVs\nbG8=", b"hello"), ("", b""), (None, None)])
def test_decode(spark, text, want):
    got = one(spark, "f string", (text,), frames.decode_frame(F.col("f")))[0]
    assert (bytes(got) if got is not None else None) == want


def test_stale(spark):
    cfg = VerifyConfig()
    same = '{"enforce_detection":true, "provider":"deepface","detector_backend":"retinaface","model_name":"ArcFace"}'
    rows = spark.createDataFrame([(same,), (same.replace("retinaface", "opencv"),), ("{}",), (None,), ("no json",), (cfg.snapshot,)], "m string").select(snapshot.is_stale(F.col("m"), cfg)).collect()
    assert [r[0] for r in rows] == [False, True, True, True, True, False]
    assert '"model_name":"Other"' in VerifyConfig(provider_config={"model_name": "Other"}).snapshot


@pytest.mark.parametrize("text,want", [(None, '{"k":{"a":1,"b":null}}'), ('{"x":[1,{"y":true}],"k":5}', '{"k":{"a":1,"b":null},"x":[1,{"y":true}]}'), ("{}", '{"k":{"a":1,"b":null}}'), ("null", '{"k":{"a":1,"b":null}}'), ("[1,2]", None), ('"x"', None), ("5", None), ("oops", None), ("", None)])
def test_set_json_key(spark, text, want):
    value = F.struct(F.lit(1).alias("a"), F.lit(None).cast("string").alias("b"))
    assert one(spark, "j string", (text,), snapshot.set_json_key(F.col("j"), "k", value))[0] == want


def test_dense_distance_is_the_folds(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    pairs = [(rng.standard_normal(n).tolist(), rng.standard_normal(n).tolist()) for n in (1, 16, 512, 512, 3)]
    pairs += [([0.0, 0.0], [1.0, 2.0]), ([1.0], [1.0, 2.0]), (None, [1.0]), ([1.0], None), (None, None), ([], []), ([1.0, None], [1.0, 2.0]), ([3.0, 4.0], [3.0, 4.0]), ([1.0, 0.0], [-1.0, 0.0])]
    df = spark.createDataFrame(pairs, "a array<double>, b array<double>").coalesce(1)
    got = df.select(similarity.cosine_distance(F.col("a"), F.col("b")).alias("x"), similarity.cosine_distance(F.col("a"), F.col("b"), 512).alias("y")).collect()
    assert all((r["x"] is None) == (r["y"] is None) and (r["x"] is None or abs(r["x"] - r["y"]) < 1e-12) for r in got)
    assert [r["y"] for r in got[5:]] == [1.0, None, None, None, None, 1.0, None, pytest.approx(0), pytest.approx(2)]
