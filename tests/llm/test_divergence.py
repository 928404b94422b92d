import random
import re
from collections import Counter

from meridian.llm import divergence as D

SCHEMA = "lang string, source string, text string, value int, term string"


def _lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, least=3, top=200):
    groups, docs = {}, {}
    for lang, source, text in rows:
        terms = re.findall(r"[^\x00-\x40\x5b-\x60\x7b-\x7f]+", _lower(text))
        groups.setdefault((lang or "", source or ""), Counter()).update(terms)
        docs.setdefault(lang or "", Counter()).update(set(terms))
    out = set()
    for lang, held in docs.items():
        kept = [t for t, n in held.items() if n >= least]
        mine = {s: {t: c[t] for t in kept} for (x, s), c in groups.items() if x == lang}
        mine[None] = {t: sum(c[t] for c in mine.values()) for t in kept}
        p = {s: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept} for s, c in mine.items()}
        gap = lambda a, b: (a - b) ** 2 // b
        for s in mine.keys() - {None}:
            pair = [(-sum(gap(p[s][t], p[o][t]) for t in kept), o.encode()) for o in mine.keys() - {None, s}]
            term = [(-gap(p[s][t], p[None][t]), t.encode()) for t in kept if mine[s][t] and p[s][t] > p[None][t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                out |= {(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(sorted(found)[:most], 1)}
    return out


def _got(spark, rows, **how):
    docs = spark.createDataFrame([(*r, 1, "t") for r in rows], SCHEMA).repartition(3)
    found = [tuple(r) for r in D.divergence(docs, **how).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(found) == len(set(found))
    return set(found)


def _rows(seed, n):
    draw = random.Random(seed)
    words = ["The", "the", "Of", "été", "x1y", "中文", "straße", "A", "data-set", "word", "rare"] + [f"w{chr(97 + k)}" for k in range(20)]
    texts = [" ".join(draw.choice(words[: draw.randrange(3, len(words))]) for _ in range(draw.randrange(0, 30))) for _ in range(n)]
    rows = [(draw.choice(["en", "en", "de", None]), draw.choice(["a", "b", "c", "é", None]), draw.choice(texts)) for _ in range(n)]
    return rows + [("en", "a", "the very same text of all")] * 60 + [("en", s, "the very same text of all") for s in "bcd"] + [("en", "empty", None), ("en", "empty", ""), ("fr", "x", "seul ici"), ("fr", "y", None), ("it", "z", "1 2 3")]


def test_equals_brute_force(spark):
    rows = _rows(1, 200)
    assert _got(spark, rows) == brute(rows)
    assert _got(spark, rows, least_docs=40, top_terms=3) == brute(rows, 40, 3)


def test_small_blocks_give_the_same(spark, monkeypatch):
    rows = _rows(2, 120)
    monkeypatch.setattr(D, "BLOCK_CELLS", 20)
    assert _got(spark, rows) == brute(rows)


def test_helpers_in_small_steps(spark, monkeypatch):
    monkeypatch.setattr(D, "MOST_EXPANDED", 7)
    monkeypatch.setattr(D, "BLOCK_BYTES", 40)
    rows = [r for r in _rows(3, 60) if r[0] == "en"]
    texts = D.collapsed(spark.createDataFrame([(*r, 1, "t") for r in rows], SCHEMA)).select("lang", "text", "held").toArrow()
    held, docs = Counter(), Counter()
    for batch in D._term_counts(iter(texts.to_batches())):
        for r in batch.to_pylist():
            held[r["source"], r["term"]] += r["cnt"]
            docs[r["term"]] += r["docs"]
    want, times = Counter(), Counter()
    for _, source, text in rows:
        terms = re.findall(r"[^\x00-\x40\x5b-\x60\x7b-\x7f]+", _lower(text))
        want.update((source or "", t) for t in terms)
        times.update(set(terms))
    assert held == want and docs == times


def test_copies_are_cut_once(spark):
    rows = [("en", f"s{k % 3}", "one text in many copies") for k in range(3000)] + [("de", "s0", "one text in many copies")]
    found = D.collapsed(spark.createDataFrame([(*r, 1, "t") for r in rows], SCHEMA)).collect()
    assert sorted((r.lang, sorted((h.source, h.m) for h in r.held)) for r in found) == [("de", [("s0", 1)]), ("en", [("s0", 1000), ("s1", 1000), ("s2", 1000)])]


def test_one_very_long_text_and_empty_tables(spark):
    rows = [("en", "a", "big word " * 200_000), ("en", "b", "big"), ("en", "b", "big word x" + "y" * 100_000), ("en", "c", "word big")]
    assert _got(spark, rows) == brute(rows)
    assert _got(spark, []) == set()
    assert _got(spark, [(None, None, None)]) == set() and _got(spark, [(None, None, None), (None, "a", None)]) == {("", "", "pair", "a", 0, 1), ("", "a", "pair", "", 0, 1)}


def test_counts_are_dealt_out_by_term_once(spark):
    texts = D.collapsed(spark.createDataFrame([(*r, 1, "t") for r in _rows(4, 40)], SCHEMA)).localCheckpoint()
    plan = D.kept_terms(texts)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan


def test_counts_of_blocks_are_summed_in_a_task():
    import pyarrow as pa

    held = pa.array([[{"source": "a", "m": 1}]] * 3, pa.list_(pa.struct([("source", pa.string()), ("m", pa.int64())])))
    batch = pa.record_batch([pa.array(["en"] * 3), pa.array(["b a", "a", "a c"]), held], names=["lang", "text", "held"])
    got = [tuple(r.values()) for b in D._term_counts(iter([batch, batch])) for r in b.to_pylist()]
    assert got == [("en", "a", "a", 6, 6), ("en", "a", "b", 2, 2), ("en", "a", "c", 2, 2)]
