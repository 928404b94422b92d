import hashlib
import json

import pytest
from pyspark.sql import functions as F

from meridian.operators import features as FE
from meridian.operators import models as ML
from meridian.operators import retrieval as R
from meridian.operators import tabular as P
from meridian.sources import files as S


def test_raw_files_are_recoded_and_tagged(spark, tmp_path):
    (tmp_path / "a.data").write_text("63.0,1.0,1.0,145.0,233.0,1.0,2.0,150.0,0.0,2.3,3.0,0.0,6.0,0\n41.5,0.0,9.0,?,0,0.0,0.0,x,1.0,1.4,?,?,?,2\n")
    got = S.read_sources(spark, {"A": str(tmp_path / "a.data")}).orderBy("Age").collect()
    assert [(r.Age, r.Sex, r.ChestPainType, r.RestingBP, r.MaxHR, r.ST_Slope, r.HeartDisease, r.source) for r in got] == [(42, "F", None, None, None, None, 1, "A"), (63, "M", "TA", 145.0, 150.0, "Down", 0, "A")]
    with pytest.raises(FileNotFoundError, match="B"):
        S.read_sources(spark, {"A": str(tmp_path / "a.data"), "B": str(tmp_path / "b.data")})


def test_question_filters(spark, tmp_path):
    rows = [{"id": "q1", "expected_doc_ids": ["fixture_a"], "tags": ["x"]}, {"id": "q2", "expected_doc_ids": ["d", "fixture_b"], "requires_full_corpus": True}, {"id": "q3", "expected_doc_ids": []}]
    (tmp_path / "q.jsonl").write_text("\n\n".join(map(json.dumps, rows)) + "\n")
    schema = spark.createDataFrame([], "id string, expected_doc_ids array<string>, requires_full_corpus boolean, tags array<string>").schema
    ids = lambda **k: {r.id for r in S.read_questions(spark, str(tmp_path / "q.jsonl"), schema, {"requires_full_corpus": False}, **k).collect()}
    assert ids() == {"q1", "q2", "q3"} and ids(skip_fixture=True) == {"q2", "q3"} and ids(skip_full_corpus=True) == {"q1", "q3"} and ids(tag="x") == {"q1"}


def test_file_audit(spark, tmp_path):
    for name in "abc":
        (tmp_path / name).write_bytes(name.encode())
    pin = hashlib.sha256(b"a").hexdigest().upper()
    lock = spark.createDataFrame([("a", f"{pin}  # kept"), ("b", "00"), ("d", "11")], "name string, pin string")
    got = {r.name: r.action for r in S.audit_files(spark, [str(tmp_path / n) for n in "abc"], lock).collect()}
    assert got == {"a": "reused", "b": "mismatch", "c": "downloaded", "d": "missing"}


def test_json_safe_at_depth(spark):
    df = spark.createDataFrame([(1.0, [float("nan"), 2.0], (float("inf"), 3))], "z double, a array<double>, s struct<x:double,b:int>")
    row = S.json_safe(df).collect()[0]
    assert S.json_safe(df).columns == ["a", "s", "z"] and row.a == [None, 2.0] and row.s.x is None and row.s.b == 3


def test_references_are_checked_on_load(spark, tmp_path):
    S.save_reference({"numeric": spark.range(1)}, str(tmp_path))
    assert S.load_reference(spark, str(tmp_path), {"numeric": ["id"]})["numeric"].count() == 1
    with pytest.raises(TypeError):
        S.load_reference(spark, str(tmp_path), {"numeric": ["edges"]})


def test_manifest_names_what_it_knows(spark):
    manifest = spark.createDataFrame([("strategy", "token", 1)], "kind string, key string, n int")
    assert S.manifest_entry(manifest, "strategy", "token").count() == 1
    with pytest.raises(KeyError, match="token"):
        S.manifest_entry(manifest, "strategy", "other")


def test_synthetic_rows_do_not_depend_on_partitions(spark):
    one = {tuple(r) for r in S.synthetic_records(spark.range(0, 500, 1, 1)).collect()}
    assert one == {tuple(r) for r in S.synthetic_records(spark.range(0, 500, 1, 7)).collect()}
    assert 20 < sum(r[5] == 0 for r in one) < 90


def test_top_up_reaches_its_targets(spark):
    have = spark.createDataFrame([(5, "t", "low"), (9, "t", "high")], "case_id long, tag string, band string")
    want = spark.createDataFrame([("t", "low", 3), ("t", "high", 1), ("u", "low", 2)], "tag string, band string, target int")
    got = S.top_up(have, want, {"low": (20, 40), "high": (60, 70)}).collect()
    assert sorted(r.case_id for r in got) == [10, 11, 12, 13] and all(20 <= r.age <= 40 for r in got)


def test_index_survives_saving(spark, tmp_path):
    chunks = spark.createDataFrame([("a", "heart attack risk"), ("b", ""), ("c", "heart rate")], "chunk_id string, text string")
    asked = spark.createDataFrame([(1, "heart attack")], "query_id int, text string")
    R.bm25_index(chunks).save(str(tmp_path / "i"))
    loaded = R.Bm25Index.load(spark, str(tmp_path / "i"))
    assert [r.id for r in R.bm25_search(loaded, asked, 2).orderBy("rank").collect()][0] == "a"
    assert R.bm25_search(loaded, spark.createDataFrame([(2, "the of")], "query_id int, text string"), 2).count() == 0


def test_scrub_goes_deep(spark):
    df = spark.createDataFrame([((("x", 1), [("y",)]), {"PATIENT": "z", "k": "v"})], "a struct<Patient:struct<n:string,i:int>,l:array<struct<patient:string>>>, m map<string,string>")
    row = P.scrub(df).collect()[0]
    assert row.a.Patient == "<scrubbed>" and row.a.l[0].patient == "<scrubbed>" and row.m == {"PATIENT": "<scrubbed>", "k": "v"}


def test_encoder_zeroes_unknown_levels_and_refuses_nulls(spark):
    train = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "c string, n double")
    enc = FE.Encoder.fit(train, ["c"], ["n"])
    got = spark.createDataFrame([("z", 5.0), ("b", 6.0)], "c string, n double").select(enc.encode().alias("e")).collect()
    assert [list(r.e) for r in got] == [[0, 0, 5], [0, 1, 6]]
    with pytest.raises(ValueError):
        FE.Encoder.fit(spark.createDataFrame([(None, 1.0)], "c string, n double"), ["c"], ["n"])


def test_sigmoid_and_isotonic_calibration(spark):
    held = spark.createDataFrame([(int(k < n), p) for p, n in ((0.2, 1), (0.5, 5), (0.9, 9)) for k in range(10)], "y int, p double")
    sums = lambda kind: ML.calibrated(kind, held, held).agg(F.avg("p")).first()[0]
    assert abs(sums("isotonic") - 0.5) < 1e-9 and abs(sums("sigmoid") - 0.5) < 0.02
    with pytest.raises(ValueError):
        ML.isotonic(held.where("y = 1"))
