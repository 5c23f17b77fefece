"""The embedding life cycle, routes of a verification, sources and streams."""

import base64
import datetime as dt
import json
import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

from verispark.config import VerifyConfig
from verispark.fixtures import CFG, Md5Embedder
from verispark.operators import sampling
from verispark.plans import embedder
from verispark.plans.insert import insert_audits
from verispark.plans.refresh import refresh_embeddings, store_embeddings
from verispark.plans.verify import audits_from_results, verify
from verispark.sources.audits import append_audits, audit_table
from verispark.sources.messages import format_results, parse_frames, read_messages
from verispark.sources.photos import load_photos, store_photos
from verispark.streaming.risk import current_claims, current_risk, insert_stream, log_unmerged, risk_stream, store_stream
from verispark.streaming.sampling import sample_stream
from verispark.streaming.verification import EmbeddingStore, verify_stream
from verispark.tables import BatchTable

T0 = dt.datetime(2026, 3, 5, 10)


def vec(text):
    return Md5Embedder().embed([text.encode()])[0]


def b64(text):
    return "data:image/jpeg;base64," + base64.b64encode(text.encode()).decode()


def test_registry():
    with pytest.raises(ValueError, match="md5"):
        embedder.get(VerifyConfig(provider="nobody"))
    with pytest.raises(TypeError):
        embedder.register("bad", 3)
    embedder.register("none", lambda **_: object())
    with pytest.raises(TypeError):
        embedder.get(VerifyConfig(provider="none"))
    a = embedder.get(CFG)
    assert embedder.get(CFG) is a and "md5" in embedder.available()
    embedder.register("md5", Md5Embedder)
    assert embedder.get(CFG) is not a and embedder.get(CFG).options == CFG.provider_config


def tables(spark):
    subjects = spark.createDataFrame([(k, T0 if k == 9 else None) for k in range(1, 10)], "subject_id long, validity_to timestamp")
    photo = {1: "p1", 2: "p2", 3: "p3", 4: None, 5: "p5", 6: "x" * 29, 7: "p7"}
    photos = spark.createDataFrame([(k, v.encode() if v else None) for k, v in photo.items()], "subject_id long, content binary")
    snap, old = CFG.snapshot, CFG.snapshot.replace("retinaface", "opencv")
    rows = [(1, vec("p1"), snap, T0, None), (2, vec("p2-old"), old, T0, None), (3, vec("p3"), snap, T0, T0), (4, vec("p4"), old, T0, None), (5, [1.0, 2.0], snap, T0, None), (9, vec("p9"), snap, T0, None)]
    embeddings = spark.createDataFrame(rows, "subject_id long, embedding array<double>, metadata string, validity_from timestamp, validity_to timestamp")
    return subjects, photos, embeddings


def test_routes(spark):
    subjects, photos, embeddings = tables(spark)
    frames = [(1, 1, "p1"), (2, 1, "other"), (3, 2, "p2"), (4, 3, "p3"), (5, 4, "p4"), (6, 5, "p5"), (7, 6, "p6"), (8, 7, "p7"), (9, 8, "p8"), (10, 9, "p9"), (11, 77, "p"), (12, 1, "y" * 29)]
    df = spark.createDataFrame([(i, s, b64(t), T0) for i, s, t in frames] + [(13, 1, "abc", T0), (14, None, b64("p"), T0)], "id long, subject_id long, frame string, ts timestamp")
    results, store = verify(df, subjects, embeddings, photos, CFG)
    got = {r["id"]: (r["route"], r["verified"], r["error"]) for r in results.collect()}
    assert got[1] == ("fast", True, None) and got[2][:2] == ("fast", False) and got[3] == ("refresh", True, None) and got[4] == ("slow", True, None)
    assert got[5] == ("slow", False, "no photo") and got[6][:2] == ("fast", False) and "lengths" in got[6][2] and got[7] == ("slow", False, "unreadable image") and got[8] == ("slow", True, None)
    assert got[9] == ("slow", False, "no photo") and got[10] == got[11] == ("unknown", False, "unknown subject") and got[12] == ("fast", False, "unreadable image")
    assert got[13] == ("fast", False, "frame can't be decoded") and got[14][0] == "unknown"
    new = {r["subject_id"]: r for r in store.collect()}
    assert set(new) == {2, 3, 7} and new[2]["embedding"] == vec("p2") and {r["metadata"] for r in new.values()} == {CFG.snapshot}
    now = dt.datetime(2026, 4, 1)
    after = store_embeddings(embeddings, store, F.lit(now))
    assert {(r["subject_id"], r["validity_from"]) for r in after.where("validity_to IS NULL").collect()} == {(1, T0), (2, now), (3, now), (4, T0), (5, T0), (7, now), (9, T0)}
    again, store = verify(df, subjects, after, photos, CFG)  # what was stored is fresh now
    assert {r["id"]: r["route"] for r in again.collect() if r["id"] in (3, 4, 8)} == {3: "fast", 4: "fast", 8: "fast"} and store.count() == 0
    off = VerifyConfig(provider="md5", provider_config=CFG.provider_config, store_embeddings=False)
    results, store = verify(df, subjects, embeddings, photos, off)
    assert {r["route"] for r in results.collect()} == {"slow", "unknown"} and store.count() == 0


def test_model_sees_each_image_once(spark, tmp_path):
    """One Arrow node for the photos and one for the frames, however often results and vectors are read."""
    class Counting(Md5Embedder):
        def embed(self, images):
            with open(tmp_path / "seen", "ab") as f:
                f.write(b"".join(x + b"\n" for x in images))
            return super().embed(images)

    embedder.register("counting", Counting)
    cfg = VerifyConfig(provider="counting", model_name="ArcFace", provider_config={"detector_backend": "retinaface"})
    subjects, photos, embeddings = tables(spark)
    df = spark.createDataFrame([(i, s, b64(t), T0) for i, s, t in [(1, 1, "f1"), (2, 2, "p2"), (3, 7, "p7"), (4, 7, "f4")]], "id long, subject_id long, frame string, ts timestamp")
    results, new = verify(df, subjects, embeddings, photos, cfg)
    for _ in range(2):
        results.collect(), new.collect()
    assert sorted((tmp_path / "seen").read_text().split()) == sorted(["f1", "p2", "p7", "f4", "p1", "p2", "p7"])
    refresh_embeddings(subjects, photos, embeddings, cfg, F.lit(T0), "missing")[0].collect()
    assert (tmp_path / "seen").read_text().split().count("p3") == 1


def test_model_failure_is_a_row(spark):
    class Broken(Md5Embedder):
        def embed(self, images):
            raise RuntimeError("model crashed")

    embedder.register("broken", Broken)
    cfg = VerifyConfig(provider="broken", provider_config={})
    subjects, photos, embeddings = tables(spark)
    df = spark.createDataFrame([(1, 1, b64("p1"), T0)], "id long, subject_id long, frame string, ts timestamp")
    r = verify(df, subjects, embeddings, photos, cfg)[0].first()
    assert r["verified"] is False and r["error"] == "model crashed"


@pytest.mark.parametrize("only,who", [("missing", {3, 6, 7, 8}), ("stale", {2, 4}), ("all", {1, 2, 3, 4, 5, 6, 7, 8})])
def test_refresh(spark, only, who):
    subjects, photos, embeddings = tables(spark)
    now = dt.datetime(2026, 4, 1)
    rows, report = refresh_embeddings(subjects, photos, embeddings, CFG, F.lit(now), only)
    got = {r["subject_id"]: r["success"] for r in report.collect()}
    assert set(got) == who and {k for k, v in got.items() if not v} == who & {4, 6, 8}
    table = rows.collect()
    active = [r["subject_id"] for r in table if r["validity_to"] is None]
    assert len(active) == len(set(active)) and {r["subject_id"] for r in table if r["validity_from"] == now} == {k for k, v in got.items() if v}
    assert any(r["subject_id"] == 4 and r["validity_to"] is None for r in table)  # a failed refresh closes nothing


def test_audits_from_results(spark):
    r = spark.createDataFrame([
        (1, T0, "C1", 5, True, 90.5, None), (1, T0 + dt.timedelta(1), "C2", None, True, 80.0, None), (1, T0, "C3", None, True, 80.0, None), (2, T0, "C1", 6, True, 80.0, None), (2, T0, None, None, True, 80.0, None), (2, T0, "C1", None, False, 0.0, "bad"),
    ], "conn_id int, ts timestamp, claim_code string, service_id int, verified boolean, confidence double, error string").withColumns({"step_name": F.lit("s"), "device_id": F.lit("d"), "provider": F.lit("md5")})
    c = spark.createDataFrame([("C1", 11, None), ("C2", 12, None), ("C2", 13, None), ("C3", 14, T0)], "claim_code string, claim_id int, validity_to timestamp")
    s = spark.createDataFrame([(5, None)], "service_id int, validity_to timestamp")
    a = audits_from_results(r, c, s, CFG)
    got = a.collect()
    assert [(x["claim_id"], x["service_id"], x["similarity_score"], x["metadata"]) for x in got] == [(11, 5, 0.905, '{"provider":"md5"}')]
    assert got[0]["id"] == audits_from_results(r, c, s, CFG).first()["id"]
    zero = VerifyConfig(provider="md5", similarity_threshold=0.0)  # stored as configured, though another is in force
    assert audits_from_results(r, c, s, zero).first()["threshold_used"] == 0.0 and zero.threshold == 0.68


def test_insert_audits(spark):
    """The first error wins: fields, ranges, verdict, claim, service."""
    ok = ("c1", "s1", 0.9, 0.4, True, "reception", "d", '{"a":1}')
    cases = {
        1: (ok, None), 2: (("c1", None, 0.9, 0.4, True, "x", None, None), None), 3: ((None, "s1", 2.0, 0.4, True, "x", "", ""), "missing: claim_uuid"), 4: (("no", "no", 1.5, 2.0, True, "x", "", ""), "score_range"),
        5: (("no", "no", 0.5, 2.0, True, "x", "", ""), "threshold_range"), 6: (("no", "no", 0.5, 0.4, False, "x", "", ""), "inconsistent"), 7: (("no", "no", 0.5, 0.4, True, "x", "", ""), "claim_not_found"),
        8: (("c2", "no", 0.5, 0.4, True, "x", "", ""), "claim_ambiguous"), 9: (("c1", "no", 0.5, 0.4, True, "x", "", ""), "service_not_found"), 10: (("c3", "", 0.5, 0.4, True, "x", "", ""), "claim_not_found"),
        11: (("c1", "s2", 0.5, 0.4, True, "x", "", ""), "service_not_found"), 12: (("c1", "", 0.4, 0.4, True, "x", "", ""), None), 13: (("c1", "s3", 0.4, 0.4, True, "x", "", ""), "service_ambiguous"),
    }
    rows = spark.createDataFrame([(k, *v, T0) for k, (v, _) in cases.items()], "id int, claim_uuid string, service_uuid string, similarity_score double, threshold_used double, is_verified boolean, step_name string, device_id string, metadata string, audit_date timestamp")
    c = spark.createDataFrame([("c1", 1, None), ("c2", 2, None), ("c2", 3, None), ("c3", 4, T0)], "claim_uuid string, claim_id int, validity_to timestamp")
    s = spark.createDataFrame([("s1", 5, None), ("s2", 6, T0), ("s3", 7, None), ("s3", 8, None)], "service_uuid string, service_id int, validity_to timestamp")
    good, bad = insert_audits(rows, c, s)
    assert {r["id"]: r["error"] for r in bad.collect()} == {k: e for k, (_, e) in cases.items() if e}
    got = {r["id"]: (r["claim_id"], r["service_id"], r["device_id"], r["metadata"], r["is_deleted"], r["version"]) for r in good.collect()}
    assert got == {1: (1, 5, "d", '{"a":1}', False, 1), 2: (1, None, "", "{}", False, 1), 12: (1, None, "", "{}", False, 1)}


def test_photos(spark, tmp_path):
    (tmp_path / "2024" / "01").mkdir(parents=True)
    (tmp_path / "2024" / "01" / "photo.jpg").write_bytes(b"\xff\xd8")
    m = spark.createDataFrame([(1, "2024/01", "photo.jpg"), (2, None, None), (3, "2024/01", "gone.jpg"), (4, "..", "photo.jpg"), (5, "/2024//01/.", "photo.jpg")], "subject_id int, folder string, filename string")
    got = {r["subject_id"]: (r["content"] and bytes(r["content"]), r["error"]) for r in load_photos(spark, str(tmp_path), m).collect()}
    assert got == {1: (b"\xff\xd8", None), 2: (None, "no photo"), 3: (None, "file missing"), 4: (None, "path outside root"), 5: (b"\xff\xd8", None)}
    assert {r["error"] for r in load_photos(spark, None, m).collect()} == {"no photo", "no photo root"}


@pytest.mark.parametrize("folder", ["photos/x/photos", "it's a folder", 'quo"te & 100%', "ünï/日本"])
def test_photos_of_any_root(spark, tmp_path, folder):
    """A root whose last part comes twice, quotes, spaces; nothing is listed, so only the asked files are opened."""
    root = tmp_path / folder
    root.mkdir(parents=True)
    (root / "a b.jpg").write_bytes(b"1")
    m = spark.createDataFrame([(1, None, "a b.jpg"), (2, None, "b.jpg")], "subject_id int, folder string, filename string")
    for name in (str(root), root.as_uri(), f"{root}/"):
        assert {r["subject_id"]: (r["content"] and bytes(r["content"]), r["error"]) for r in load_photos(spark, name, m).collect()} == {1: (b"1", None), 2: (None, "file missing")}
    assert "FileScan" not in load_photos(spark, str(root), m)._jdf.queryExecution().executedPlan().toString()
    (root / "dir").mkdir()
    m = spark.createDataFrame([(1, None, "dir")], "subject_id int, folder string, filename string")
    assert [r["error"] for r in load_photos(spark, str(root), m).collect()] == ["file unreadable"]


def test_photos_leave_a_task_in_bounded_pieces(spark, tmp_path, monkeypatch):
    from verispark.sources import photos as module

    monkeypatch.setattr(module, "HELD", 25)
    for k in range(20):
        (tmp_path / f"{k}.jpg").write_bytes(b"x" * 10)
    m = spark.range(20).selectExpr("id subject_id", "cast(null as string) folder", "concat(id, '.jpg') filename").coalesce(1)
    assert sorted(r["subject_id"] for r in load_photos(spark, str(tmp_path), m).where("length(content) = 10").collect()) == list(range(20))


def test_parse_and_format(spark):
    body = json.dumps({"type": "frame", "insuree_uuid": "S1", "frame": "x", "extra": [1]})
    rows = [(1, zlib.compress(body.encode()), None), (2, body.encode(), None), (3, None, body), (4, None, '{"type":"ping"}'), (5, None, "oops"), (6, None, None), (7, b"\xff\xfe", body), (8, None, "[1]"), (9, b"", body)]
    frames, other, dead = parse_frames(spark.createDataFrame(rows, "id int, bytes binary, text string"))
    assert {r["id"] for r in frames.collect()} == {1, 2, 3, 9} and {r["id"] for r in other.collect()} == {4}
    assert {r["id"]: r["parse_error"] for r in dead.collect()} == {5: "invalid", 6: "empty", 7: "invalid", 8: "invalid"}
    more = [(1, None, '{"type":"frame","step_name":null}'), (2, zlib.compress(b" " * 200_000_000 + body.encode()), None)]
    rows = {r["id"]: r for r in read_messages(spark.createDataFrame(more, "id int, bytes binary, text string")).collect()}
    assert (rows[1]["status"], rows[1]["step_name"], rows[1]["device_id"]) == ("frame", None, "") and rows[2]["status"] == "too_large"
    one = spark.createDataFrame([(zlib.compress(json.dumps({"type": "frame", "frame": "x" * 5000}).encode()), None)], "bytes binary, text string")
    assert [read_messages(one, max_inflated=k).first()["status"] for k in (1000, 1 << 20)] == ["too_large", "frame"]  # the bound is a parameter
    assert {(r["step_name"], r["device_id"]) for r in frames.collect()} == {("unknown", "")}
    df = spark.createDataFrame([(True, 99.5, None), (None, None, "boom")], "verified boolean, confidence double, error string")
    got = [json.loads(r["value"]) for r in format_results(df).collect()]
    assert got[0]["verified"] is True and got[0]["audit_uuid"] is None and set(got[0]) == {"type", "verified", "confidence", "distance", "provider", "error", "verification_count", "frame_count", "timestamp", "audit_uuid"}
    assert got[1] == {"type": "error", "message": "boom"}


def test_append_is_idempotent_per_batch(spark, tmp_path):
    a = spark.createDataFrame([(1, 0.5, T0)], "claim_id long, similarity_score double, audit_date timestamp")
    for _ in range(2):
        append_audits(a, f"{tmp_path}/t", batch_id=3)
    stored = audit_table(spark, f"{tmp_path}/t").read()
    assert [(r["user_created"], r["user_updated"], r["date_created"], r["audit_month"], r["version"]) for r in stored.collect()] == [(None, None, T0, "2026-03", 1)]
    append_audits(a, f"{tmp_path}/u")
    append_audits(a, f"{tmp_path}/u")
    assert spark.read.parquet(f"{tmp_path}/u").count() == 2


def test_streams_equal_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [(c, c * 100 + i, T0 + dt.timedelta(seconds=3 * i + c)) for c in range(3) for i in range(20)]
    df = spark.createDataFrame(rows, "conn_id int, id long, ts timestamp")
    for k in range(4):  # four files in order of time: four micro-batches
        df.where((F.col("id") % 100 >= k * 5) & (F.col("id") % 100 < k * 5 + 5)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = sample_stream(stream, 10.0).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/s").outputMode("append").trigger(availableNow=True).start(f"{tmp_path}/out")
    q.awaitTermination()
    got = {(r["id"], r["frame_count"], r["verification_count"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    batch = sampling.number_verifications(df, sampling.sample_frames(df, 10.0))
    assert got == {(r["id"], r["frame_count"], r["verification_count"]) for r in batch.collect()}


def test_late_and_expired_connections(spark, tmp_path):
    """A frame behind the watermark is dropped; a connection that was idle starts anew, the other goes on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    files = [[("a", 1, 0), ("b", 2, 0), ("a", 3, 20)], [("b", 4, 500)], [("b", 10, 900)], [("b", 5, 1000), ("a", 6, 30)], [("a", 7, 1005), ("b", 8, 1020)], [("b", 9, 1030)]]
    schema = "conn_id string, id long, ts timestamp"
    for k, rows in enumerate(files):
        spark.createDataFrame([(c, i, T0 + dt.timedelta(seconds=s)) for c, i, s in rows], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    passed = sample_stream(stream, 10.0, late="60 seconds", idle_seconds=700)
    passed.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/s").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    got = {r["id"]: (r["conn_id"], r["frame_count"], r["verification_count"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {1: ("a", 1, 1), 2: ("b", 1, 1), 3: ("a", 2, 2), 4: ("b", 2, 2), 10: ("b", 3, 3), 5: ("b", 4, 4), 7: ("a", 1, 1), 8: ("b", 5, 5), 9: ("b", 6, 6)}


def test_verify_stream_over_batches(spark, tmp_path):
    """A refreshed embedding is used by the next micro-batch; malformed and broken messages keep their places."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    subjects, photos, embeddings = tables(spark)
    subjects = subjects.withColumn("insuree_uuid", F.concat(F.lit("S"), F.col("subject_id").cast("string")))
    given = {
        "subjects": subjects, "photos": photos, "embeddings": embeddings, "claims": spark.createDataFrame([("C1", 11, None)], "claim_code string, claim_id int, validity_to timestamp"),
        "services": spark.createDataFrame([("V1", 5, None)], "service_uuid string, service_id int, validity_to timestamp"),
    }

    def message(conn, i, second, subject, text, **more):
        body = {"type": "frame", "insuree_uuid": subject, "frame": text and b64(text), **more}
        return (conn, i, T0 + dt.timedelta(seconds=second), None, json.dumps(body))

    batches = [
        [message("a", 1, 0, "S2", "p2", claim_code="C1"), message("a", 2, 1, "S2", "p2"), message("a", 3, 2, "S2", None), ("a", 4, T0, None, "broken"), message("b", 5, 0, "S7", "p7", claim_code="C1", service_uuid="V9")],
        [message("a", 6, 5, "S2", "p2", claim_code="C1", service_uuid="V1", step_name="gate"), message("b", 7, 5, "S7", "p7", claim_code="no"), message("b", 8, 9, "S77", "p7", claim_code="C1")],
    ]
    schema = "conn_id string, id long, ts timestamp, bytes binary, text string"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    out = f"{tmp_path}/out"
    verify_stream(stream, lambda _: given, CFG, out, f"{tmp_path}/c", max_files=2).awaitTermination()
    at = lambda t: BatchTable(spark, f"{out}/{t}")
    got = {r["id"]: (r["route"], r["verified"], r["error"], r["frame_count"], r["verification_count"], r["audit_uuid"] is not None) for r in at("results").read().collect()}
    assert got == {
        1: ("refresh", True, None, 1, 1, True), 3: (None, None, "missing: frame", 3, 1, False), 4: (None, None, "the message is not a JSON object", None, None, False),
        5: ("slow", True, None, 1, 1, False), 6: ("fast", True, None, 4, 2, True), 7: ("fast", True, None, 2, 2, False),
    }
    audits = {r["audit_date"]: r for r in at("audits").read().collect()}
    assert {(r["claim_id"], r["service_id"], r["step_name"], r["threshold_used"]) for r in audits.values()} == {(11, None, "unknown", 0.68), (11, 5, "gate", 0.68)}
    said = [json.loads(r["value"]) for r in at("messages").read().collect()]
    assert sorted(m["type"] for m in said) == ["error"] * 2 + ["verification_result"] * 4
    assert {m["audit_uuid"] for m in said if m.get("audit_uuid")} == {r["id"] for r in audits.values()}
    active = {r["subject_id"]: r["embedding"] for r in EmbeddingStore(spark, out).versions().where("validity_to IS NULL").collect()}
    assert active[2] == vec("p2") and active[7] == vec("p7")
    assert [(r["claim_id"], r["audit_count"]) for r in current_risk(spark, f"{out}/sums").collect()] == [(11, 2)]


def streamed(spark, tmp_path, batches, schema="conn_id string, id long, ts timestamp, bytes binary, text string"):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")


def job_tables(spark):
    subjects, photos, embeddings = tables(spark)
    return {
        "subjects": subjects.withColumn("insuree_uuid", F.concat(F.lit("S"), F.col("subject_id").cast("string"))), "photos": photos, "embeddings": embeddings,
        "claims": spark.createDataFrame([("C1", 11, None)], "claim_code string, claim_id int, validity_to timestamp"), "services": spark.createDataFrame([("V1", 5, None)], "service_uuid string, service_id int, validity_to timestamp"),
    }


def said_by(conn, i, second, subject, text, **more):
    ts = None if second is None else T0 + dt.timedelta(seconds=second)
    return (conn, i, ts, None, json.dumps({"type": "frame", "insuree_uuid": subject, "frame": text and b64(text), **more}))


def test_frames_without_a_time_and_broken_messages_are_answered(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    given = job_tables(spark)
    stream = streamed(spark, tmp_path, [[said_by("a", 1, None, "S1", "p1"), said_by("a", 2, 0, "S1", "p1"), ("a", 3, None, b"", ""), ("a", 4, T0, b"[1]", None), ("a", 5, T0, None, '{"type":"ping"}'), ("a", 6, T0, zlib.compress(b" " * 5000), None)]])
    out = f"{tmp_path}/out"
    verify_stream(stream, lambda _: given, CFG, out, f"{tmp_path}/c", max_inflated=1000).awaitTermination()
    got = {r["id"]: (r["error"], r["frame_count"]) for r in BatchTable(spark, f"{out}/results").read().collect()}
    assert got == {1: ("the frame has no time", None), 2: (None, 1), 3: ("the message has neither text nor bytes", None), 4: ("the message is not a JSON object", None), 6: ("the message is too large", None)}
    plain = spark.createDataFrame([("a", 1, None), ("a", 2, T0)], "conn_id string, id long, ts timestamp")
    plain.write.parquet(f"{tmp_path}/plain")
    passed = sample_stream(spark.readStream.schema(plain.schema).parquet(f"{tmp_path}/plain"), 5.0)
    passed.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/s").trigger(availableNow=True).start(f"{tmp_path}/passed").awaitTermination()
    assert [r["id"] for r in spark.read.parquet(f"{tmp_path}/passed").collect()] == [2]


def test_one_input_batch_gives_one_output_batch_and_the_inbox_is_emptied(spark, tmp_path):
    """The batch without rows that follows the watermark writes nothing; the frames' files go with the next batch."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    given, out = job_tables(spark), f"{tmp_path}/out"
    stream = streamed(spark, tmp_path, [[said_by("a", 1, 0, "S1", "p1")], [said_by("a", 2, 9, "S1", "p1")]])
    verify_stream(stream, lambda _: given, CFG, out, f"{tmp_path}/c", max_files=1).awaitTermination()
    for t in ("results", "messages", "audits"):
        assert BatchTable(spark, f"{out}/{t}").folders() == 2
    assert EmbeddingStore(spark, out).last.folders() == 3  # the table that it took over, too
    left = [p for p in (tmp_path / "out" / "inbox").rglob("*.parquet")]
    assert len(left) == 1


def test_connections_share_states(spark, tmp_path):
    """Three states hold 40 connections: each keeps its own numbers over batches, is over by itself, and rows with an error take no turn."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rnd, batches = random.Random(3), []
    for k in range(4):  # a connection is idle in some batches; times only grow
        talking = [c for c in [None, *range(39)] if rnd.random() < 0.6]
        batches.append([(None if c is None else f"c{c}", 1000 * k + n, T0 + dt.timedelta(seconds=100 * k + rnd.random() * 90), "bad" if rnd.random() < 0.1 else None) for n, c in enumerate(rnd.choices(talking, k=200))])
    want, states = set(), {}
    for rows in batches:
        for conn, i, at, error in sorted(rows, key=lambda r: (r[2], r[1])):
            last, frames, passed, newest = states.get(conn, (None, 0, 0, at))
            if at - newest > dt.timedelta(seconds=110):
                last, frames, passed = None, 0, 0
            frames += 1
            if error is None and (last is None or at - last >= dt.timedelta(seconds=20)):
                last, passed = at, passed + 1
                want.add((conn, i, frames, passed))
            elif error:
                want.add((conn, i, frames, passed))
            states[conn] = last, frames, passed, at
    stream = streamed(spark, tmp_path, batches, "conn_id string, id long, ts timestamp, error string")
    query = sample_stream(stream, 20.0, idle_seconds=110, buckets=3).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/s").trigger(availableNow=True).start(f"{tmp_path}/out")
    query.awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("conn_id", "id", "frame_count", "verification_count").collect()} == want
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 3


def test_frames_without_a_subject_are_spread(spark):
    frames = spark.createDataFrame([(i, None, b64("p1")) for i in range(60)] + [(100, 2, b64("p2"))], "id long, subject_id long, frame string")
    subjects, photos, embeddings = tables(spark)
    old = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")}
    for c, v in zip(old, ("-1", "false")):
        spark.conf.set(c, v)
    try:
        results = verify(frames, subjects, embeddings, photos, CFG)[0]
        assert {(r["route"], r["error"]) for r in results.where("subject_id IS NULL").collect()} == {("unknown", "unknown subject")}
        assert results.count() == 61 and results.where("subject_id = 2").first()["verified"]
        assert results.where("subject_id IS NULL").select(F.spark_partition_id()).distinct().count() > 1
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)


def test_no_image_goes_through_the_state(spark, tmp_path, monkeypatch):
    from verispark.streaming import verification as module

    seen = []
    monkeypatch.setattr(module, "sample_stream", lambda frames, *a: seen.append(frames.columns) or sample_stream(frames, *a))
    stream = streamed(spark, tmp_path, [[said_by("a", 1, 0, "S1", "p1")]])
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    verify_stream(stream, lambda _: job_tables(spark), CFG, f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    assert seen == [["conn_id", "id", "ts", "error", "file", "row"]]


def test_late_versions_are_the_open_ones(spark, tmp_path):
    """A version of an earlier time than the open row's start takes its place all the same, and later batches find it."""
    given = tables(spark)[2]
    store = EmbeddingStore(spark, str(tmp_path), buckets=4)
    store.start(given)
    store.start(given)
    new = lambda subject, v, at: spark.createDataFrame([(subject, [v], "m", at)], "subject_id long, embedding array<double>, metadata string, validity_from timestamp")
    store.put(new(2, 1.0, T0 - dt.timedelta(days=5)), 0)
    store.put(new(2, 2.0, T0 - dt.timedelta(days=9)), 1)
    store.put(new(2, 2.5, T0 - dt.timedelta(days=9)), 1)  # repeated
    store.put(new(8, 3.0, T0), 2)
    who = spark.createDataFrame([(2,), (8,), (3,), (99,)], "subject_id long")
    last = {r["subject_id"]: (r["embedding"], r["validity_from"], r["validity_to"]) for r in store.of(who).collect()}
    assert last == {2: ([2.5], T0, None), 8: ([3.0], T0, None), 3: (vec("p3"), T0, T0)}
    every = store.versions()
    assert sorted((r["embedding"][0], r["validity_to"]) for r in every.where("subject_id = 2 AND validity_to IS NULL").collect()) == [(2.5, None)]
    assert every.count() == given.count() + 3


def test_a_batch_reads_its_subjects_buckets_only(spark, tmp_path):
    """Over 50 batches the bytes that a lookup opens stay level, whatever is stored."""
    base = spark.range(4000).select(F.col("id").alias("subject_id"), F.array(F.rand(1), F.rand(2), F.rand(3)).alias("embedding"), F.lit("m").alias("metadata"), F.lit(T0).alias("validity_from"), F.lit(None).cast("timestamp").alias("validity_to"))
    store = EmbeddingStore(spark, str(tmp_path), buckets=16)
    store.start(base)
    who, opened = spark.createDataFrame([(7,)], "subject_id long"), []
    for n in range(50):
        store.put(spark.createDataFrame([(7, [float(n)], "m", T0), (100 + n, [0.0], "m", T0)], "subject_id long, embedding array<double>, metadata string, validity_from timestamp"), n)
        if n in (5, 20, 49):
            bucket = store.last.read(of=who).inputFiles()
            opened.append(sum(os.path.getsize(f[7:]) for f in bucket if f"__bucket={hash_bucket(spark, 7, 16)}/" in f))
            assert [r["embedding"] for r in store.of(who).collect()] == [[float(n)]]
    assert max(opened) < 2 * min(opened) and store.last.folders() <= 24


def hash_bucket(spark, key, buckets):
    return spark.range(1).select(F.pmod(F.xxhash64(F.lit(key).cast("long")), F.lit(buckets))).first()[0]


def test_risk_stream_over_batches(spark, tmp_path):
    from verispark.operators.risk import claim_risk

    rows = [(k % 4, k, (k * 37 % 100) / 100, k % 7 != 0, T0 + dt.timedelta(minutes=k), False) for k in range(40)]
    df = spark.createDataFrame(rows, "claim_id long, id long, similarity_score double, is_verified boolean, audit_date timestamp, is_deleted boolean")
    for k in range(3):
        df.where(F.col("id") % 3 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for query in (store_stream(stream, f"{tmp_path}/a", f"{tmp_path}/ca"), risk_stream(stream, f"{tmp_path}/r", f"{tmp_path}/c", raise_errors=True)):
        query.awaitTermination()
    assert audit_table(spark, f"{tmp_path}/a").read().count() == 40
    got = current_risk(spark, f"{tmp_path}/r")
    want = claim_risk(df, last_updated=True)
    assert sorted(got.select(want.columns).collect()) == sorted(want.collect())
    some = spark.createDataFrame([(2,), (9,)], "claim_id long")
    assert [r["claim_id"] for r in current_risk(spark, f"{tmp_path}/r", some).collect()] == [2]
    # claims as they are when they are read: an edit since the stream began survives
    c = spark.createDataFrame([(0, '{"x":1}'), (1, '{"edited":true}'), (2, "[1,2]"), (3, "oops"), (4, '{"x":1}')], "claim_id long, json_ext string")
    ext = {r["claim_id"]: r["json_ext"] for r in current_claims(c, f"{tmp_path}/r").collect()}
    assert ext[2] == "[1,2]" and ext[3] == "oops" and ext[4] == '{"x":1}' and json.loads(ext[1])["edited"] and json.loads(ext[0])["biometric_risk_assessment"]["audit_count"] == 10
    assert {r["claim_id"]: r["error"] for r in log_unmerged(c, f"{tmp_path}/r").collect()} == {2: "json_ext is not an object", 3: "json_ext is not JSON"}


def test_risk_errors_leave_the_audits(spark, tmp_path):
    """A batch that can't be scored is logged; the stream and the stored audits go on."""
    df = spark.createDataFrame([(1, 1, 0.5, True, T0, False)], "claim_id long, id long, similarity_score double, is_verified boolean, audit_date timestamp, is_deleted boolean")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    (tmp_path / "r").write_text("in the way")
    risk_stream(stream, f"{tmp_path}/r", f"{tmp_path}/c").awaitTermination()
    store_stream(stream, f"{tmp_path}/a", f"{tmp_path}/ca").awaitTermination()
    assert audit_table(spark, f"{tmp_path}/a").read().count() == 1


def test_risk_stream_keeps_no_state_store(spark, tmp_path):
    """The sums are the stream's only state, and those of a batch that can't be added come with the next one, once."""
    schema = "claim_id long, id long, similarity_score double, is_verified boolean, audit_date timestamp"

    def run(k, claim):
        spark.createDataFrame([(claim, k, 0.5, True, T0 + dt.timedelta(k))], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = risk_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/r", f"{tmp_path}/c")
        query.awaitTermination()
        assert [p["stateOperators"] for p in query.recentProgress if p["stateOperators"]] == []

    counts = lambda: {r["claim_id"]: (r["audit_count"], r["last_updated"]) for r in current_risk(spark, f"{tmp_path}/r").collect()}
    (tmp_path / "r").write_text("in the way")
    run(0, 1)
    run(1, 2)
    (tmp_path / "r").unlink()
    run(2, 3)
    assert counts() == {1: (1, T0), 2: (1, T0 + dt.timedelta(1)), 3: (1, T0 + dt.timedelta(2))}
    # batch 2 repeated, as after a lost commit
    commit = tmp_path / "c" / "commits" / "2"
    commit.unlink()
    (commit.parent / ".2.crc").unlink(missing_ok=True)
    run(3, 1)
    assert counts() == {1: (2, T0 + dt.timedelta(3)), 2: (1, T0 + dt.timedelta(1)), 3: (1, T0 + dt.timedelta(2))}


def test_current_claims_parse_each_json_once(spark, tmp_path):
    """One folder of sums is read without an aggregate, and a claim's JSON is parsed in two places: for objects, and for nulls if it is none."""
    df = spark.createDataFrame([(1, 1, 0.5, True, T0)], "claim_id long, id long, similarity_score double, is_verified boolean, audit_date timestamp")
    df.write.parquet(f"{tmp_path}/in")
    risk_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/r", f"{tmp_path}/c", raise_errors=True).awaitTermination()
    c = spark.createDataFrame([(1, '{"x":1}')], "claim_id long, json_ext string")
    plan = current_claims(c, f"{tmp_path}/r")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parseJson(") == 2 and "Aggregate" not in plan


def test_unscored_batches_are_added_later(spark, tmp_path, monkeypatch):
    """A batch that can't be scored keeps its audits; the next one adds them, once, also when it is repeated."""
    from verispark.streaming import risk as module

    batch = lambda k: spark.createDataFrame([(1, k, 0.5, True, T0 + dt.timedelta(k))], "claim_id long, id long, similarity_score double, is_verified boolean, audit_date timestamp")
    out, add = str(tmp_path), module.add_sums
    count = lambda: current_risk(spark, f"{out}/sums").first()["audit_count"]
    module.store_and_score(batch(0), out, 0)
    monkeypatch.setattr(module, "add_sums", lambda *a: 1 / 0)
    for n in (1, 2, 2):
        assert module.store_and_score(batch(n), out, n).count() == 1
    monkeypatch.setattr(module, "add_sums", add)
    assert count() == 1
    for _ in range(2):
        module.store_and_score(batch(3), out, 3)
        assert count() == 4
    module.store_and_score(batch(4), out, 4)
    assert count() == 5 and audit_table(spark, f"{out}/audits").read().count() == 5


def test_insert_stream(spark, tmp_path):
    schema = "id int, claim_uuid string, similarity_score double, threshold_used double, is_verified boolean, step_name string, service_uuid string, device_id string, metadata string, audit_date timestamp, user string"
    rows = [[(1, "C", 0.9, 0.5, True, "s", None, None, None, T0, "u1"), (2, "C", 0.9, 0.5, False, "s", None, None, None, T0, None)], [(3, "C", 0.1, 0.5, False, "s", "", None, None, T0, "u2"), (4, "no", 0.9, 0.5, True, "s", None, None, None, T0, None)]]
    stream = streamed(spark, tmp_path, rows, schema)
    given = {"claims": spark.createDataFrame([("C", 7, None)], "claim_uuid string, claim_id int, validity_to timestamp"), "services": spark.createDataFrame([], "service_uuid string, service_id int, validity_to timestamp")}
    out = f"{tmp_path}/out"
    insert_stream(stream, lambda _: given, out, f"{tmp_path}/c").awaitTermination()
    assert {r["id"]: (r["claim_id"], r["user_created"], r["user_updated"]) for r in audit_table(spark, f"{out}/audits").read().collect()} == {1: (7, "u1", "u1"), 3: (7, "u2", "u2")}
    assert {r["id"]: r["error"] for r in BatchTable(spark, f"{out}/rejected").read().collect()} == {2: "inconsistent", 4: "claim_not_found"}
    assert [(r["claim_id"], r["audit_count"], r["failed_audits"]) for r in current_risk(spark, f"{out}/sums").collect()] == [(7, 2, 1)]


def test_a_stopped_run_embeds_only_the_rest(spark, tmp_path):
    class Noting(Md5Embedder):
        def embed(self, images):
            for x in images:
                open(os.path.join(self.options["folder"], x.decode()), "x").close()  # a second look at one fails
            return super().embed(images)

    (tmp_path / "photos").mkdir()
    (tmp_path / "seen").mkdir()
    for k in range(40):
        (tmp_path / "photos" / f"{k}.jpg").write_bytes(f"photo{k}".encode())
    embedder.register("noting", Noting)
    cfg = VerifyConfig(provider="noting", provider_config={"folder": f"{tmp_path}/seen"})
    subjects = spark.range(41).selectExpr("id subject_id", "cast(null as timestamp) validity_to")
    manifest = spark.range(40).selectExpr("id subject_id", "cast(null as string) folder", "concat(id, '.jpg') filename")
    none = spark.createDataFrame([], "subject_id long, embedding array<double>, metadata string, validity_from timestamp, validity_to timestamp")
    asked = []

    def read(people, stop=None):
        asked.append(people)
        if len(asked) == stop:
            raise RuntimeError("killed")
        return load_photos(spark, f"{tmp_path}/photos", people.join(manifest, "subject_id", "left"))

    run = lambda stop: refresh_embeddings(subjects, lambda p: read(p, stop), none, cfg, F.lit(T0), "missing", progress=f"{tmp_path}/progress", parts=8)
    with pytest.raises(RuntimeError):
        run(5)
    half = len(os.listdir(tmp_path / "seen"))
    assert 0 < half < 40
    table, report = run(None)
    assert len(os.listdir(tmp_path / "seen")) == 40 and len(asked) == 9
    assert {r["subject_id"]: r["error"] for r in report.collect()} == {k: "no photo" if k == 40 else None for k in range(41)}
    assert {r["subject_id"]: r["embedding"] for r in table.collect()} == {k: vec(f"photo{k}") for k in range(40)}
    plan = load_photos(spark, f"{tmp_path}/photos", subjects.join(manifest, "subject_id", "left"))._jdf.queryExecution().executedPlan().toString()
    assert not any("content" in line for line in plan.splitlines() if "Exchange" in line)


def test_photos_are_stored_once_and_loaded(spark, tmp_path):
    rows = [(k, f"{k % 3}", f"{k}.jpg", f"photo {k}".encode() if k % 10 else None) for k in range(40)]
    photos = spark.createDataFrame(rows, "subject_id long, folder string, filename string, content binary").repartition(4)
    for k in range(2):  # a repeated run leaves the same files
        store_photos(photos, f"{tmp_path}/photos").write.parquet(f"{tmp_path}/manifest{k}")
    files = sorted(os.path.relpath(os.path.join(d, f), f"{tmp_path}/photos") for d, _, fs in os.walk(f"{tmp_path}/photos") for f in fs)
    assert files == sorted(f"{f}/{n}" for _, f, n, c in rows if c)  # a folder is shared, nothing else is left
    found = load_photos(spark, f"{tmp_path}/photos", spark.read.parquet(f"{tmp_path}/manifest1")).collect()
    assert {r["subject_id"]: (r["content"] and bytes(r["content"]), r["error"]) for r in found} == {k: (c, None if c else "file missing") for k, _, _, c in rows}


def test_requests_meet_only_the_tables_they_need(spark):
    """A request that breaks a rule is looked up nowhere; one without a service meets no services, so no null gathers in one task."""
    from verispark.plans.insert import check_audits, split_audits

    kinds = "id string, claim_uuid string, service_uuid string, similarity_score double, threshold_used double, is_verified boolean, step_name string, device_id string, metadata string, audit_date timestamp_ntz"
    row = lambda k, claim="c", service="s", score=0.9: (k, claim, service, score, 0.5, True, "gate", None, "", dt.datetime(2024, 1, 1))
    requests = spark.createDataFrame([row("a"), row("b", service=""), row("c", service=None), row("d", service="t"), row("e", claim="x", service="t"), row("f", score=2.0), row("g", claim=None)], kinds)
    claims = spark.createDataFrame([("c", 1, None)], "claim_uuid string, claim_id long, validity_to int")
    services = spark.createDataFrame([("s", 7, None)], "service_uuid string, service_id long, validity_to int")
    checked, broken = check_audits(requests, claims, services)
    assert "Join" not in broken._jdf.queryExecution().optimizedPlan().toString()
    good, bad = split_audits(checked, broken)
    assert {(r["id"], r["claim_id"], r["service_id"]) for r in good.collect()} == {("a", 1, 7), ("b", 1, None), ("c", 1, None)}
    assert {tuple(r) for r in bad.collect()} == {("d", "service_not_found"), ("e", "claim_not_found"), ("f", "score_range"), ("g", "missing: claim_uuid")}
    found = checked._jdf.queryExecution().optimizedPlan().toString().lower()
    assert found.count("union") == 1 and "isnotnull(service_uuid" in found
