"""Scans, sinks, integrity audits, manifests, synthetic rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.metrics import portable_hash
from ..operators.tabular import RAW_COLUMNS, recode

RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """A headerless file of 14 string columns; ? is null."""
    return spark.read.schema(RAW_SCHEMA).option("nullValue", "?").option("ignoreLeadingWhiteSpace", True).csv(path)


def read_sources(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """All sources recoded and tagged, in one table of fixed columns; names all files that lack."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    there = lambda p: (lambda q: q.getFileSystem(hadoop).exists(q))(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p))
    lacking = [f"{name}: {path}" for name, path in files.items() if not there(path)]
    if lacking:
        raise FileNotFoundError("inputs are missing: " + ", ".join(lacking))
    return reduce(DataFrame.unionByName, [recode(read_raw(spark, path), name) for name, path in files.items()])


def read_with_header(spark: SparkSession, path: str, schema: T.StructType, source: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path).withColumn("source", F.lit(source))


def read_any(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith(".csv"):
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader).csv(path)
    raise ValueError(f"no reader for {path}")


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def read_ordered(spark: SparkSession, path: str, schema: T.StructType, where: Column | None = None) -> DataFrame:
    """JSON lines with their place (file, block, row) among the files' lines: orderBy("place") has the lines of each file in
    their order, and files by name. Large files are read in blocks, by many tasks; within a block rows are numbered as read."""
    found = spark.read.schema(schema).json(path)
    found = found if where is None else found.where(where)  # before rows are numbered, so that folders can be left out
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return found.select("*", place.alias("place"))


def write_ordered(df: DataFrame, path: str, order: list[str], by: list[str] | None = None) -> None:
    """JSON lines in files whose names and lines are in the order of the columns: rows are dealt out by ranges of them,
    so a document of very many rows goes to several files; by names columns that become folders."""
    placed = df.repartitionByRange(*(by or []), *order).sortWithinPartitions(*(by or []), *order)
    writer = placed.write.mode("overwrite").option("ignoreNullFields", False)
    (writer.partitionBy(*by) if by else writer).json(path)


PAGE_SCHEMA = "doc_id long, page_no int, text string, char_offset long"
CHUNK_SCHEMA = "doc_id long, chunk_no int, char_start int, char_end int, n_tokens int, text string, strategy string"


def save_pages(page_rows: DataFrame, path: str) -> None:
    """The page table, in the order of documents and pages."""
    write_ordered(page_rows.select("doc_id", "page_no", "text", "char_offset"), path, ["doc_id", "page_no"])


def load_pages(spark: SparkSession, path: str) -> DataFrame:
    """The page table with place, by which it is in the order in which it was saved."""
    return read_ordered(spark, path, T.StructType.fromDDL(PAGE_SCHEMA))


def save_chunks(chunk_rows: DataFrame, path: str) -> None:
    """Chunk tables in a folder for each strategy, in the order of documents and chunks."""
    columns = [f.name for f in T.StructType.fromDDL(CHUNK_SCHEMA).fields]
    write_ordered(chunk_rows.select(*columns), path, ["doc_id", "chunk_no"], ["strategy"])


def load_chunks(spark: SparkSession, path: str, strategy: str | None = None) -> DataFrame:
    """The chunks of one strategy, or of all, with place; only asked folders are read."""
    return read_ordered(spark, path, T.StructType.fromDDL(CHUNK_SCHEMA), F.col("strategy") == strategy if strategy else None)


def read_questions(spark: SparkSession, path: str, schema: T.StructType, defaults: dict, skip_full_corpus: bool = False, skip_fixture: bool = False, tag: str | None = None, ids: str = "expected_doc_ids", limit: int | None = None) -> DataFrame:
    """JSON lines with defaults for absent fields. skip_fixture drops rows all of whose document ids
    begin with fixture_; rows without ids stay. limit: the first rows that the filters leave, in the
    order of the files."""
    if limit is not None:
        kept = _questions(read_ordered(spark, path, schema), schema, defaults, skip_full_corpus, skip_fixture, tag, ids)
        return kept.orderBy("place").limit(limit).drop("place")
    return _questions(spark.read.schema(schema).json(path), schema, defaults, skip_full_corpus, skip_fixture, tag, ids)


def _questions(out: DataFrame, schema: T.StructType, defaults: dict, skip_full_corpus: bool, skip_fixture: bool, tag: str | None, ids: str) -> DataFrame:
    out = out.where(reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in schema.names])).withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})
    if skip_full_corpus:
        out = out.where("NOT coalesce(requires_full_corpus, false)")
    if skip_fixture:
        held = F.coalesce(F.col(ids), F.array().cast("array<string>"))
        out = out.where((F.size(held) == 0) | ~F.forall(held, lambda x: x.startswith("fixture_")))
    return out.where(F.array_contains("tags", tag)) if tag else out


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinities become null at every depth; columns are sorted by name."""

    def walk(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return F.when(~(F.isnan(c) | (F.abs(c) == float("inf"))), c)
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: walk(x, kind.elementType))
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[walk(c[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]))
        if isinstance(kind, T.MapType):
            return F.transform_values(c, lambda k, v: walk(v, kind.valueType))
        return c

    return df.select(*[walk(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name)])


def write_report(df: DataFrame, path: str) -> None:
    json_safe(df).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def audit_files(spark: SparkSession, paths: str | list[str], lock: DataFrame, fetched: tuple[str, ...] = ()) -> DataFrame:
    """(name, sha256, pinned, action) of files against a lock table (name, pin); what follows a # in
    a pin is a comment, and case doesn't matter. fetched names files that were fetched again: where they
    match their pin, they are redownloaded rather than reused."""
    found = spark.read.format("binaryFile").load(paths).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("sha256"))
    pins = lock.select("name", F.lower(F.trim(F.regexp_replace("pin", "#.*$", ""))).alias("pinned"))
    out = found.join(pins, "name", "full_outer")
    action = F.when(F.col("sha256").isNull(), "missing").when(F.col("pinned").isNull(), "downloaded").when((F.col("sha256") == F.col("pinned")) & F.col("name").isin(*fetched), "redownloaded").when(F.col("sha256") == F.col("pinned"), "reused").otherwise("mismatch")
    return out.withColumn("action", action)


def corpus_manifest(page_rows: DataFrame, chunk_rows: DataFrame) -> DataFrame:
    """(kind, key, n, n_chars, sha256) for each document and each chunking strategy; the digest is of
    the rows' digests in order, so no text is gathered."""
    digest = lambda order: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "d"))), lambda s: s["d"]), ""), 256)
    docs = page_rows.withColumn("d", F.md5(F.col("text").cast("binary"))).groupBy(F.col("doc_id").cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars"), digest(["page_no"]).alias("sha256"))
    # a strategy's digests are added up, as its chunks are many
    parts = chunk_rows.groupBy(F.col("strategy").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars"), F.sha2(F.sum(portable_hash(F.col("doc_id"), F.col("chunk_no"), F.col("text"))).cast("string").cast("binary"), 256).alias("sha256"))
    return docs.select(F.lit("document").alias("kind"), "*").unionByName(parts.select(F.lit("strategy").alias("kind"), "*"))


def manifest_entry(manifest: DataFrame, kind: str, key: str) -> DataFrame:
    rows = manifest.where((F.col("kind") == kind) & (F.col("key") == key))
    if rows.isEmpty():
        known = [r[0] for r in manifest.where(F.col("kind") == kind).select("key").orderBy("key").limit(20).collect()]
        raise KeyError(f"no {kind} {key}; known: {known}")
    return rows


def save_reference(tables: dict[str, DataFrame], path: str) -> None:
    """The numeric, categorical and prediction tables of references."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def load_reference(spark: SparkSession, path: str, required: dict[str, list[str]]) -> dict[str, DataFrame]:
    out = {name: spark.read.parquet(f"{path}/{name}") for name in required}
    for name, columns in required.items():
        if lacking := set(columns) - set(out[name].columns):
            raise TypeError(f"{name} lacks {sorted(lacking)}")
    return out


def uniform(seed: int, *parts: Column) -> Column:
    return portable_hash(F.lit(seed), *parts) / float(1 << 32)


def weighted(u: Column, levels: dict[str, float]) -> Column:
    total, upto, out = sum(levels.values()), 0.0, F.lit(list(levels)[-1])
    marks = []
    for level, weight in levels.items():
        upto += weight / total
        marks.append((level, upto))
    for level, mark in reversed(marks[:-1]):
        out = F.when(u < mark, level).otherwise(out)
    return out


def synthetic_records(ids: DataFrame, seed: int = 20260505) -> DataFrame:
    """A record for each id (column id): uniform integers, weighted levels, a tenth sentinel zeros,
    and a target drawn from a score. Values depend on ids and seed alone."""
    u = lambda k: uniform(seed, F.col("id"), F.lit(k))
    whole = lambda k, low, high: (low + F.floor(u(k) * (high - low + 1))).cast("int")
    made = ids.select(
        "id", whole("age", 28, 77).alias("Age"), weighted(u("sex"), {"M": 0.7, "F": 0.3}).alias("Sex"), weighted(u("cp"), {"ASY": 0.5, "NAP": 0.25, "ATA": 0.15, "TA": 0.1}).alias("ChestPainType"),
        whole("bp", 90, 180).alias("RestingBP"), F.when(u("zero") < 0.1, 0).otherwise(whole("chol", 120, 400)).alias("Cholesterol"), whole("hr", 70, 200).alias("MaxHR"), weighted(u("ex"), {"N": 0.6, "Y": 0.4}).alias("ExerciseAngina"), weighted(u("st"), {"Flat": 0.5, "Up": 0.4, "Down": 0.1}).alias("ST_Slope"),
    )
    score = 1 / (1 + F.exp(-((F.col("Age") - 54) * 0.05 + F.when(F.col("ChestPainType") == "ASY", 1.0).otherwise(-0.6) + F.when(F.col("ExerciseAngina") == "Y", 0.8).otherwise(-0.5))))
    return made.withColumn("HeartDisease", (u("y") < score).cast("int"))


def top_up(existing: DataFrame, targets: DataFrame, bands: dict[str, tuple[int, int]], seed: int = 20260505) -> DataFrame:
    """New rows (case_id, tag, band, age, faulty) so that each (tag, band) has its target count.

    Ids go on from the largest there; a tenth of the rows have an injected fault and are flagged."""
    have = existing.groupBy("tag", "band").agg(F.count(F.lit(1)).alias("have"))
    need = targets.join(have, ["tag", "band"], "left").withColumn("need", F.col("target") - F.coalesce("have", F.lit(0))).where("need > 0")
    rows = need.select("tag", "band", F.explode(F.sequence(F.lit(1), F.col("need").cast("int"))).alias("k"))
    first = existing.agg(F.coalesce(F.max("case_id"), F.lit(0)).alias("last"))
    u = lambda name: uniform(seed, F.col("tag"), F.col("band"), F.col("k"), F.lit(name))
    age = F.lit(None).cast("int")
    for band, (low, high) in bands.items():
        age = F.when(F.col("band") == band, (low + F.floor(u("age") * (high - low + 1))).cast("int")).otherwise(age)
    # a row for each tag and band, so one task may order them
    before = need.select("tag", "band", (F.sum("need").over(Window.orderBy("tag", "band")) - F.col("need")).alias("before"))
    made = rows.join(before, ["tag", "band"]).crossJoin(F.broadcast(first))  # the largest id is one row
    return made.select((F.col("last") + F.col("before") + F.col("k")).alias("case_id"), "tag", "band", age.alias("age"), (u("fault") < 0.1).alias("faulty"))
