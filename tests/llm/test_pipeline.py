"""The pipeline's stages, each on its own input, against plain versions in Python and SQL."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from meridian.llm import packing, pii
from meridian.llm.common import scratch_tables
from meridian.llm.quality import OP9_SQL
from meridian.llm.tokens import vocabulary

from ..conftest import SF
from .test_operators import brute_components
from .test_pii import brute, brute_added


@pytest.fixture(scope="module")
def stages(spark):
    """(name, input rows, output rows) of each stage of the smallest documents, some of them repeated."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(docs.where("doc_id < 3")).selectExpr("*", "1 AS n_words", "'x' AS kept", "2 AS starts")
    out = []
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF)
        assert name == "sequences" or made.columns == docs.columns
        rows = made.collect()
        out.append((name, docs.collect(), rows))
        docs = spark.createDataFrame(rows, docs.schema) if name != "sequences" else None
    return {name: (before, after) for name, before, after in out}


def test_quality_rules(stages):
    before, after = stages["quality_rules"]
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", [(k, r.text, r.lang, r.source) for k, r in enumerate(before)])
    kept = {k for k, good in db.execute(f"SELECT doc_id, kept FROM ({OP9_SQL})").fetchall() if good}
    assert Counter(after) == Counter(r for k, r in enumerate(before) if k in kept)


def test_line_dedup(stages):
    before, after = stages["line_dedup"]
    lines = {}
    for r in before:
        lines[r.doc_id] = [x.strip(" \t\x0b\f\r") for x in r.text.split("\n")]
    first, covered = {}, {i: set() for i in lines}
    for i in sorted(lines):
        full = [k for k, x in enumerate(lines[i]) if x]
        runs = [full[k : k + 3] for k in range(len(full) - 2)] if len(full) > 2 else [full] if full else []
        for run in runs:
            key = (len(run), *(lines[i][k] for k in run))
            if first.setdefault(key, i if len(run) < 3 else (i, run[0])) != (i if len(run) < 3 else (i, run[0])):
                covered[i] |= set(run)
    want = Counter()
    for r in before:
        if covered[r.doc_id] and all(k in covered[r.doc_id] for k, x in enumerate(lines[r.doc_id]) if x):
            continue
        want["\n".join(x for k, x in enumerate(r.text.split("\n")) if k not in covered[r.doc_id]), r.doc_id] += 1
    assert Counter((r.text, r.doc_id) for r in after) == want
    assert all(r.n_chars == len(r.text) for r in after)


def test_near_dedup(stages):
    before, after = stages["near_dedup"]
    want = brute_components([(r.doc_id, r.text) for r in before], 5, 80)
    assert Counter(after) == Counter(r for r in before if want[r.doc_id][1] == r.doc_id)


def test_personal_data(stages):
    before, after = stages["personal_data"]
    texts = Counter()
    for r in before:
        spans = sorted(set(brute(r.text)) | set(brute_added(r.text)), key=lambda s: (s[1], pii.KINDS.index(s[0])))
        out, at = [], 0
        for kind, start, end in spans:
            if start >= at:
                out += [r.text[at:start], f"<{kind.upper()}>"]
            at = max(at, end)
        texts["".join([*out, r.text[at:]]), r.doc_id] += 1
    assert Counter((r.text, r.doc_id) for r in after) == texts


def pieces_by_library(rows):
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    out = Counter()
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        begin, piece = 0, 0
        while begin < len(ids):
            end = min(len(ids), begin + ((len(ids) - begin) % 2048 or 2048))
            out[doc_id, piece, begin, end - begin, zlib.crc32(np.array(ids[begin:end], "<u4").tobytes())] += 1
            begin, piece = end, piece + 1
    return out


def check_packed(got, rows):
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == pieces_by_library(rows)
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in held.values():
        places.sort()
        assert [o for o, _ in places] == [0, *np.cumsum([n for _, n in places])[:-1].tolist()] and sum(n for _, n in places) <= 2048
    return len(held), -(-sum(r.length for r in got) // 2048)


def test_sequences(stages):
    before, after = stages["sequences"]
    used, least = check_packed(after, [(r.doc_id, r.text) for r in before])
    assert used <= 1.02 * least + 1


def test_packing_of_odd_rows(spark):
    rows = [(1, None, 7, 0.5), (1, "", 7, 0.5), (None, "a b c", 7, 0.5), (2, "x" * 300_000, 7, 0.5), (3, "word " * 60_000, 7, 0.5), (3, "word " * 60_000, 7, 0.5), (4, "\t\n  \n", 7, 0.5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, piece int, length double")
    check_packed(packing.pack_documents(frame).collect(), [r[:2] for r in rows])


def test_run_leaves_only_what_its_result_reads(spark):
    before = set(scratch_tables())
    got = corpus_pipeline.run(spark, SF)
    left = [p.rsplit("/", 1)[1].split("-")[1] for p in scratch_tables() if p not in before]
    assert "personal_data" in left and "quality_rules" not in left and "sketch" not in left
    assert got.count() > 0
