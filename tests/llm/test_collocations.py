import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from meridian.llm import collocations as C

SCHEMA = "doc_id long, lang string, text string, size int, phrase string"


def _lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def _runs(text):
    for piece in re.split(r"[.,;:!?\n-\r]", _lower(text or "")):
        words = re.findall(r"[^ \t]+", piece)
        for n in range(1, 5):
            for i in range(len(words) - n + 1):
                yield tuple(words[i : i + n])


def brute(rows, least, top):
    f, out = {}, set()
    for lang, text in rows:
        f.setdefault(lang or "und", Counter()).update(_runs(text))
    for lang, held in f.items():
        n = sum(c for w, c in held.items() if len(w) == 1)
        found = {w: c for w, c in held.items() if c >= least and len(w) > 1}
        ranked = []
        for w, a in found.items():
            longer = [c for x, c in found.items() if len(x) > len(w) and any(x[i : i + len(w)] == w for i in range(len(x) - len(w) + 1))]
            if any(100 * c >= 80 * a for c in longer):
                continue
            score, k = min((2_000_000 * a // (held[w[:k]] + held[w[k:]]), k) for k in range(1, len(w)))
            ranked.append((-score, -a, " ".join(w).encode(), held[w[:k]], held[w[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return out


def _texts(seed, n):
    draw = random.Random(seed)
    words = ["New", "york", "the", "of", "City", "a", "é", "中文", "x\xa0y", "it's", "\x1c"]
    return ["".join(draw.choice(words) + draw.choice([" ", " ", " ", "  ", "\t", ", ", "\n", ".", " \t "]) for _ in range(draw.randrange(0, 60))) for _ in range(n)]


def _rows(seed, n):
    draw = random.Random(seed)
    return [(draw.choice(["en", "en", "de", None]), text) for text in _texts(seed, n)] + [("en", None), ("en", ""), (None, None), ("fr", None), ("de", " .. ")] + [("en", "same words here again")] * 12


def _got(spark, rows, least, top):
    docs = spark.createDataFrame([(k, lang, text, 1, "p") for k, (lang, text) in enumerate(rows)], SCHEMA).repartition(3)
    return {tuple(r) for r in C.collocations(docs, least, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}


def test_equals_brute_force(spark):
    rows = _rows(1, 150)
    assert _got(spark, rows, 8, 40) == brute(rows, 8, 40) != set()


def test_runs_that_share_a_fingerprint_part_again(spark, monkeypatch):
    rows = _rows(2, 100)
    texts, langs = pa.array([t or "" for _, t in rows]), pa.array([lang or "und" for lang, _ in rows])
    want = {}
    for lang, t in rows:
        want.setdefault(lang or "und", Counter()).update(_runs(t))
    whole = Counter({(lang, " ".join(w)): c for lang, held in want.items() for w, c in held.items()})
    with monkeypatch.context() as m:
        m.setattr(C, "mix", lambda x: (x % np.uint64(37)) << np.uint64(58))  # 37 fingerprints for all
        found = C.entries_of(texts, langs, 20)
        assert len(set(found.mark.tolist())) <= 37 < len(found.mark)
        at = found.bounds(20, 3)
        step = np.append(found.mark[:1], np.diff(found.mark))
        held = [k for k in range(8) if at[k + 1] > at[k]]
        step[at[held]] = found.mark[at[held]]
        for least in (1, 8):
            # as if other blocks had as many: flags of each range, then words of the flagged entries
            flags = []
            for k in held:
                body = C._pack([step[at[k] : at[k + 1]], found.count[at[k] : at[k + 1]]])
                part = pa.table({"range": [k], "block": [0], "run": [0], "n": pa.array([at[k + 1] - at[k]], pa.int32()), "body": pa.array([body], pa.binary())})
                flags.append(C._frequent(least)(part))
            given = pa.table({"row": list(range(len(rows))), "block": [0] * len(rows), "lang": langs, "text": texts})
            packed = C._words_of(20, 3)(given.take(pa.array(range(len(rows))[::-1])), pa.concat_tables(flags))
            got = {}
            for lang, place in {(r["lang"], r["range"]) for r in packed.to_pylist()}:
                own = packed.filter(pc.and_(pc.equal(packed.column("lang"), lang), pc.equal(packed.column("range"), place)))
                got |= {(r["lang"], r["phrase"]): r["f"] for r in C._added(least)(own).to_pylist()}
            assert got == {k: c for k, c in whole.items() if c >= least}


def test_blocks_read_in_parts_and_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(C, "RANGE_ENTRIES", 1 << 9)
    rows = _rows(3, 150)
    docs = spark.createDataFrame([(1, lang, t, 1, "p") for lang, t in rows], SCHEMA).repartition(2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)  # so that parts of blocks are runs of their own
    try:
        counts, totals = C.phrase_counts(docs, 8)
        got = {(r.lang, r.phrase, r.f) for r in counts.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for lang, t in rows:
        want.setdefault(lang or "und", Counter()).update(_runs(t))
    assert got == {(lang, " ".join(w), c) for lang, held in want.items() for w, c in held.items() if c >= 8} != set()


def test_one_very_long_text_and_one_word(spark):
    rows = [("en", "big apple pie " * 40_000), ("en", "x" * 300_000), ("en", "lone")]
    assert _got(spark, rows, 30, 10) == brute(rows, 30, 10) != set()


def test_empty_table(spark):
    assert C.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert C.collocations(spark.createDataFrame([(1, None, None, 1, "p")], SCHEMA)).count() == 0


@pytest.mark.parametrize(("a", "b"), [(0, 7), (7, 7), (4_999_999_999_999, 9_000_000_000_000_001), (9_000_000_000_000_000, 9_000_000_000_000_000)])
def test_scaled_is_exact(spark, a, b):
    row = spark.createDataFrame([(a, b)], "a long, b long")
    assert row.select(C.scaled(row.a, row.b, (1000, 1000, 2))).first()[0] == 2_000_000 * a // b
