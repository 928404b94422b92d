"""Ordered files, stored postings and the embedding cache."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meridian.functions import text as X
from meridian.operators import retrieval as R
from meridian.operators import tabular as P
from meridian.sources import files as S

QUESTION = T.StructType([T.StructField("id", T.StringType()), *[T.StructField(n, T.ArrayType(T.StringType())) for n in ("tags", "expected_doc_ids")]])


def test_limits_keep_the_order_of_files_of_odd_sizes(spark, tmp_path):
    sizes = {"a": 2, "b": 5000, "c": 0, "d": 1, "e": 900}
    for name, n in sizes.items():
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"id": f"{name}{i}", "tags": ["x" * (i % 50)]}) + "\n" + "\n" * (i % 3 == 0) for i in range(n)))
    every = [f"{name}{i}" for name, n in sizes.items() for i in range(n)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # b is read in many blocks, small files together
    try:
        for limit in (1, 2, 3, 700, 5002, 5004, 10_000):
            got = [r.id for r in S.read_questions(spark, str(tmp_path), QUESTION, {}, limit=limit).collect()]
            assert got == every[:limit]
        tagged = [r.id for r in S.read_questions(spark, str(tmp_path), QUESTION, {}, tag="x", limit=4).collect()]
        assert tagged == [i for i in every if int(i[1:]) % 50 == 1][:4]
        assert [r.id for r in S.read_ordered(spark, str(tmp_path), QUESTION).where("id IS NOT NULL").orderBy("place").collect()] == every
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_page_and_chunk_tables_come_back_in_order(spark, tmp_path):
    draw = random.Random(1)
    rows = [(d, n, f"text {d} {n}\nnext" * draw.randrange(0, 40), n * 7) for d in range(40) for n in range(1, draw.randrange(2, 30))]
    draw.shuffle(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small parts would become one file
    S.save_pages(spark.createDataFrame(rows, S.PAGE_SCHEMA).repartition(5), f"{tmp_path}/pages")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = S.load_pages(spark, f"{tmp_path}/pages").orderBy("place").drop("place")
    assert [tuple(r) for r in back.collect()] == sorted(rows)
    assert len([f for f in os.listdir(f"{tmp_path}/pages") if f.startswith("part-")]) > 1
    docs = spark.createDataFrame([(d, "word " * (10 * d)) for d in range(30)], "doc_id long, text string")
    chunks = X.window_chunks(docs, 20, 15, "a").unionByName(X.window_chunks(docs, 50, 50, "b"))
    S.save_chunks(chunks, f"{tmp_path}/chunks")
    one = S.load_chunks(spark, f"{tmp_path}/chunks", "a")
    assert [(r.doc_id, r.chunk_no) for r in one.orderBy("place").collect()] == sorted((r.doc_id, r.chunk_no) for r in chunks.where("strategy = 'a'").collect())
    assert "PartitionFilters: [isnotnull(strategy" in one._jdf.queryExecution().executedPlan().toString()
    assert S.load_chunks(spark, f"{tmp_path}/chunks").count() == chunks.count()


def test_tokens_are_counted_inside_the_row(spark):
    draw = random.Random(2)
    texts = [" ".join(draw.choice(["alpha", "beta", "gamma", "x1", "the", "7"]) for _ in range(draw.randrange(0, 30))) for _ in range(80)] + ["", None, "the of", "alpha"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    made = R.postings_of(chunks)
    want = {}
    for i, text in enumerate(texts):
        tokens = [t for t in (text or "").split() if t not in ("the", "of")] or ["__empty__"]
        want |= {(i, t): (tokens.count(t), len(tokens)) for t in tokens}
    assert {(r.id, r.token): (r.tf, r.length) for r in made.collect()} == want
    assert made.where("head").count() == len(texts)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("regexp_extract_all") == 1


def test_a_search_reads_only_the_parts_it_asks(spark, tmp_path):
    chunks = spark.createDataFrame([(i, f"word{i % 40} common token{i % 7}") for i in range(300)], "chunk_id long, text string")
    index = R.Bm25Index.build(chunks, f"{tmp_path}/index")
    asked = spark.createDataFrame([(1, "word3"), (2, "")], "query_id long, text string")
    found = R.bm25_search(index, asked, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert [(r.query_id, r.id) for r in found.orderBy("rank").collect()] == [(1, 3 + 40 * k) for k in range(5)]
    lazy = R.bm25_search(R.bm25_index(chunks), asked, 5)
    assert {tuple(r) for r in lazy.collect()} == {tuple(r) for r in found.collect()}


def test_the_cache_encodes_only_what_it_lacks(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(50)] + [(7, "text 7"), (None, "no id")], "id long, text string")
    cache, counted = R.EmbeddingCache(f"{tmp_path}/cache"), spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def encode(text):
        counted.add(1)
        return [float(len(text))]

    first = cache.encode(rows.where("id < 30 OR id IS NULL"), "e", encode)
    assert first.count() == 30 and counted.value == 30 and first.columns == ["embedder", "id", "embedding"]
    assert cache.encode(rows.where("id < 30"), "e", encode).count() == 30 and counted.value == 30  # nothing again
    assert len(os.listdir(f"{tmp_path}/cache/batches")) == 1
    assert cache.encode(rows, "e", encode).count() == 50 and counted.value == 50
    assert cache.encode(rows.where("id = 3"), "other", encode).collect()[0].embedding == [6.0] and counted.value == 51
    # a run that broke off before its rename is not read
    batch = os.listdir(f"{tmp_path}/cache/batches")[0]
    os.makedirs(f"{tmp_path}/cache/_staged", exist_ok=True)
    os.rename(f"{tmp_path}/cache/batches/{batch}", f"{tmp_path}/cache/_staged/{batch}")
    left = cache._rows(spark, T.StructType([rows.schema["id"], *T.StructType.fromDDL("embedding array<double>, embedder string, bucket int").fields]))
    lost = 51 - left.count()
    assert lost > 0
    again = cache.encode(rows, "e", encode)
    assert again.count() == 50 and again.select("id").distinct().count() == 50


def test_every_rule_of_a_schema_names_its_path(spark):
    rows = [
        (1, "a-1", 2.0, True, [1, 2], ("x", [("k", None)])),
        (2, "b", 2.5, False, [1, 1, 5], ("longer", [("k", 3), None])),
        (3, None, None, None, None, None),
        (4, "a-4", 11.0, True, [], ("", [])),
    ]
    df = spark.createDataFrame(rows, "id int, code string, n double, flag boolean, list array<int>, nest struct<name:string,parts:array<struct<key:string,v:int>>>")
    schema = {
        "type": "object", "required": ["code", "absent"],
        "properties": {
            "id": {"type": "string"}, "code": {"type": ["string", "null"], "pattern": "^a-"}, "n": {"type": "integer", "maximum": 10}, "flag": {"const": True},
            "list": {"type": "array", "minItems": 1, "maxItems": 2, "uniqueItems": True, "items": {"enum": [1, 2]}},
            "nest": {"type": "object", "properties": {"name": {"minLength": 1, "maxLength": 3}, "parts": {"items": {"type": "object", "required": ["v"], "properties": {"v": {"minimum": 4}}}}}},
        },
    }
    good, bad = P.validate_schema(df, schema)
    got = {r.id: set(r.violations) for r in bad.collect()}
    every = {"$.absent: required", "$.id: type"}
    assert good.count() == 0 and good.columns == df.columns
    assert got[1] == every | {"$.nest.parts[0].v: required"}
    assert got[2] == every | {"$.code: pattern", "$.n: type", "$.flag: const", "$.list: maxItems", "$.list: uniqueItems", "$.list[2]: enum", "$.nest.name: maxLength", "$.nest.parts[0].v: minimum", "$.nest.parts[1]: type"}
    assert got[3] == every | {"$.code: required"}
    assert got[4] == every | {"$.n: maximum", "$.list: minItems", "$.nest.name: minLength"}
    fine, _ = P.validate_schema(df, {"properties": {"code": {"pattern": "^a-"}}})
    assert {r.id for r in fine.collect()} == {1, 3, 4}
    with pytest.raises(ValueError, match="anyOf"):
        P.validate_schema(df, {"anyOf": []})


def test_tables_with_headers_and_differences_of_columns(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,x\n2,\n")
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    got = S.read_with_header(spark, str(tmp_path / "t.csv"), schema, "here")
    assert [tuple(r) for r in got.collect()] == [(1, "x", "here"), (2, None, "here")]
    assert [tuple(r) for r in S.read_any(spark, str(tmp_path / "t.csv"), schema).collect()] == [(1, "x"), (2, None)]
    with pytest.raises(ValueError, match="no reader"):
        S.read_any(spark, str(tmp_path / "t.txt"))
    assert P.schema_diff(got, ["a", "c"]) == {"missing": ["c"], "extra": ["b", "source"]}
