"""Brute-force versions, round trips, held-out accuracy, and the odd inputs of each operator."""

import random
import re
import textwrap
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meridian.llm import licenses, linededup, neardup, packing, quality, toxicity, vectors, warc
from meridian.llm.common import scratch_path
from meridian.llm.graph import components
from meridian.llm.queries import ORACLE_SQL, QUERIES

from ..conftest import SF

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, starts int"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def brute_components(docs, width, percent):
    sets = {i: {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()) for i, w in ((i, words(t)) for i, t in docs)}
    least = {i: i for i in sets}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                a, b = find(i), find(j)
                least[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, repeats, a long text, clashing columns."""
    rows = [(1, "a b c\nd e f\ng h i\nj", "en", "s", 1, "x", 1), (1, "a b c\nd e f\ng h i\nj", "en", "s", 1, "x", 1), (2, "a b c\nd e f\ng h i\nj", None, None, None, None, None), (3, "", "en", "s", 0, "x", 1), (4, None, "en", "s", 0, "x", 1), (None, "word " * 60, "en", "s", 0, "x", 1), (5, "long text here " * 30000, "en", "s", 0, "x", 1)]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = QUERIES[name](spark, SF).toPandas()
    want = db.execute(ORACLE_SQL[name]).df()
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    plain = lambda df: Counter(tuple("" if x is None or x != x else str(int(x)) if isinstance(x, (float, np.floating, np.integer)) else str(x) for x in r) for r in df[names].astype(object).where(df[names].notna(), None).itertuples(index=False))
    assert plain(got) == plain(want)


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_equal_brute_force(spark, width):
    draw = random.Random(width)
    vocabulary = [f"w{i}" for i in range(60)]
    docs = []
    for k in range(60):
        base = [draw.choice(vocabulary) for _ in range(draw.randrange(1, 90))]
        for _ in range(draw.choice([1, 1, 3, 30 if k == 7 else 2])):
            copy = list(base)
            for _ in range(draw.randrange(0, 4)):
                copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
            docs.append((len(docs), " ".join(copy)))
    docs += [(len(docs), None), (len(docs) + 1, " \t"), (len(docs) + 2, docs[0][1].upper())]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), width).collect()}
    want = brute_components(docs, width, 80)
    assert got == {i: (n, c, i == c) for i, (n, c) in want.items()}


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 2)
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 2_000)
    draw = random.Random(9)
    base = [f"w{draw.randrange(500)}" for _ in range(120)]
    docs = []
    for i in range(40):
        copy = list(base)
        for _ in range(4):
            copy[draw.randrange(120)] = f"x{draw.randrange(999)}"
        docs.append((i, " ".join(copy)))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 4).collect()}
    assert got == {i: c for i, (_, c) in brute_components(docs, 4, 80).items()}


def test_no_two_blocks_of_one_component_meet(spark):
    members = [(7, i, i, 100, 0) for i in range(5_000)] + [(7, 9_000, 1, 100, 9_000)] + [(8, i, i, 10, i) for i in range(600)]
    rows = spark.createDataFrame(members, "key long, rep long, mark long, bytes long, comp long")
    dealt = neardup.dealt_blocks(rows)
    held = dealt.where("key = 7").groupBy("i", "j").agg(F.count_distinct("comp").alias("n")).collect()
    assert len(held) == 21 and sum(r.n == 2 for r in held) == 20  # 210 pairs of blocks, 20 of which hold two components
    meet = dealt.where("key = 8").groupBy("i", "j").agg(F.collect_set("rep").alias("reps")).collect()
    assert len({(a, b) for r in meet for a in r.reps for b in r.reps}) == 600 * 600


def test_texts_of_a_repeated_id_are_all_compared(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(80)) for c in "xy")
    rows = [(1, one), (5, one), (5, two), (9, two + " end"), (12, "other words here"), (12, "other words here")]
    got = [(r.doc_id, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == [(1, 1), (5, 1), (5, 1), (9, 1), (12, 12), (12, 12)]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 31)} | {i: 100 for i in range(100, 140)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_documents(spark, odd):
    near = [(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(odd).collect()]
    assert sorted(near, key=str) == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True), (None, None, True), (5, 5, True)], key=str)
    kept = neardup.deduplicate(odd)
    assert kept.columns == odd.columns and kept.count() == 6
    lines = {(r.doc_id, r.n_lines, r.n_removed) for r in linededup.dedup_lines(odd).collect()}
    assert lines == {(1, 4, 0), (2, 4, 4), (3, 0, 0), (4, 0, 0), (None, 1, 0), (5, 1, 0)}
    clean = linededup.clean_documents(odd)
    assert clean.columns == odd.columns and clean.count() == 6
    good = quality.filter_documents(odd)
    assert good.columns == odd.columns and [r.doc_id for r in good.collect()] == []
    empty = odd.limit(0)
    for made in (neardup.deduplicate(empty), linededup.clean_documents(empty), quality.filter_documents(empty), packing.pack_documents(empty), licenses.scan_documents(empty)):
        assert made.count() == 0


def test_short_copies_go_from_the_pipeline(spark):
    rows = [(1, "only line"), (2, " only line\n\n"), (3, "only line\nnext"), (4, "only line\n\nnext"), (5, "only line\nnext\nthird"), (6, "next\nonly line"), (7, ""), (8, ""), (None, "only line"), (9, "only line\nnext"), (9, "a\nb\nc\nd")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in linededup.clean_documents(frame).collect()]
    assert sorted(kept, key=str) == sorted((r for k, r in enumerate(rows) if k not in (1, 3, 9)), key=str)
    gone = [(r.n_lines, r.n_removed) for r in linededup.dedup_lines(frame, short=True).where("doc_id IN (2, 4)").collect()]
    assert sorted(gone) == [(1, 1), (2, 2)]
    assert linededup.dedup_lines(frame).agg(F.sum("n_removed")).first()[0] == 0  # the method of the SQL


def test_quality_keeps_clean_and_drops_odd_documents(spark):
    draw = random.Random(3)
    prose = lambda: " ".join(draw.choice(["alpha", "beta", "gamma", "delta", "of", "the"]) + str(draw.randrange(500)) for _ in range(120))
    docs = [(i, prose(), "en", f"s{i % 2}") for i in range(300)] + [(900, " ".join(w + "###" for w in prose().split()), "en", "s0"), (901, "too short", "en", "s0"), (902, "one same line here\n" * 60, "xx", None), (903, prose(), None, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality.filter_documents(frame).collect()}
    assert kept == set(range(300)) | {903}


def test_repeated_words_equal_a_loop(spark):
    draw = random.Random(8)
    texts = [" ".join(draw.choice("abc") for _ in range(draw.randrange(0, 25))) for _ in range(200)]

    def loop(w):
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        return len({p for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)})

    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", quality.repeated_words(quality.words_of(F.col("t"))).alias("n"))
    assert all(r.n == loop(r.t.split()) for r in frame.collect())


def test_packing_places_every_piece_once(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    got = packing.pack_documents(docs).toPandas()
    whole = packing.tokenised(docs).toPandas()
    assert len(got) == len(whole) and got.length.sum() == whole.length.sum()
    assert Counter(zip(got.piece, got.start, got.length, got.ids_crc32)) == Counter(zip(whole.piece, whole.start, whole.length, whole.ids_crc32))
    for _, part in got.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part.offset.tolist() == [0, *part.length.cumsum().tolist()[:-1]] and part.length.sum() <= 2048
    assert got.sequence_id.nunique() <= 1.02 * -(-got.length.sum() // 2048) + 1
    long = got[got.length.eq(2048) | got.piece.gt(0)]
    assert (long[long.piece > 0].length == 2048).all()


def test_configurations_cover_the_demand():
    sizes, demand = [900, 700, 500, 300], [40, 55, 61, 20]
    made = packing.configurations(sizes, demand, 2048)
    assert all(sum(c * s for c, s in zip(p, sizes)) <= 2048 for p, _ in made)
    assert all(sum(p[g] * n for p, n in made) >= demand[g] for g in range(4))


def brute_links(made, ids):
    """(number of links, smallest id reachable) of each id, for rows (id, vector, label)."""
    usable = [(i, np.array(v), c) for i, v, c in made if i is not None and c is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = {i: [] for i in ids}
    for i, v, c in usable:
        for j, w, d in usable:
            if i != j and c == d and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98:
                links[i].append(j)

    def reach(i):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        return min(seen) if i is not None else None

    return {i: (len(links[i]), reach(i)) for i in ids}


@pytest.mark.parametrize(("cell_rows", "gain"), [(25, 9.0), (4, 9.0), (4_000, 0.5)])
def test_vectors_with_odd_rows_equal_brute_force(spark, monkeypatch, cell_rows, gain):
    monkeypatch.setattr(vectors, "CHILDREN", 6)
    draw = np.random.default_rng(4)
    base = draw.normal(size=(12, 8))
    made = [(i, [float(x) for x in base[i % 12] + draw.normal(size=8) * 0.03], i % 2) for i in range(400)]
    made += [(500, made[0][1], 0), (501, [0.0] * 8, 0), (502, None, 0), (503, [float("nan")] * 8, 0), (504, [None] * 8, 0), (505, made[0][1], None), (None, made[0][1], 0), (506, [2 * x for x in made[0][1]], 0), (507, [1.0, 2.0], 0), (508, [], 0)]
    frame = spark.createDataFrame([(*m, 1.5, 7) for m in made], "vec_id long, embedding array<double>, label int, n double, rep int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicate_vectors(frame, cell_rows=cell_rows, gain=gain).collect()}
    assert got == brute_links(made, got)
    assert vectors.near_duplicate_vectors(frame.limit(0)).count() == 0


def test_vectors_of_many_lengths(spark):
    made = [(2 * n + k, [1.0] * n + [0.01 * k], 1) for n in range(1, 80) for k in (0, 1)]
    frame = spark.createDataFrame(made, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicate_vectors(frame).collect()}
    assert got == brute_links(made, got) and sum(n for n, _ in got.values()) == 2 * 79


def test_vector_blocks_meet_once(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_NUMBERS", 8 * 64)  # blocks of 64 rows
    draw = np.random.default_rng(2)
    base = draw.normal(size=(30, 8))
    made = [(i, [float(x) for x in base[i % 30] + draw.normal(size=8) * 0.04], 3) for i in range(900)]
    frame = spark.createDataFrame(made, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicate_vectors(frame, cell_rows=100, gain=9.0).collect()}
    assert got == brute_links(made, got)


def test_warc_round_trip(spark):
    html = ["<p>é</p>\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n", None, "", "same", "same", "line\nline\n\n"]
    pages = spark.createDataFrame([(i, None if i == 2 else f"http://x/{i}\r\nEvil: 1", h, "x") for i, h in enumerate(html)] + [(3, "http://x/3", "same", "x"), (None, "u", "same", "x")], "page_id long, url string, html string, digest string")
    path = scratch_path(spark, "warc-test")
    warc.write_archives(pages, path)
    captures = warc.assemble_transactions(warc.read_archives(spark, path)).collect()
    assert len(captures) == 8 and all(len(c.requests) == 1 and len(c.metadatas) == 1 for c in captures)
    bodies = Counter(bytes(c.response.body).decode() for c in captures if c.record_type == "response")
    assert bodies == Counter({html[0]: 1, "": 1, "same": 2, html[5]: 1})
    assert sum(c.record_type == "revisit" for c in captures) == 3
    none = scratch_path(spark, "warc-none")
    warc.write_archives(pages.limit(0), none)
    assert warc.assemble_transactions(warc.read_archives(spark, none)).count() == 0


def test_toxicity_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").withColumn("low_quality", 1 - F.col("quality"))
    rows = docs.join(labels, "doc_id")
    chain = toxicity.fit_chain(rows.where("doc_id % 3 <> 0"), ("low_quality", "toxic"))
    got = chain.predict(rows.where("doc_id % 3 = 0").withColumnRenamed("toxic", "truth")).select("toxic", "truth").collect()
    wrong, toxic = sum(r.toxic != bool(r.truth) for r in got), sum(r.truth for r in got)
    assert 0 < toxic and wrong <= toxic / 2  # half the errors of calling nothing toxic; 2,700 rows fitted
    odd_rows = spark.createDataFrame([(None, None), (1, ""), (1, "")], "doc_id long, text string")
    assert chain.predict(odd_rows).count() == 3 and chain.predict(odd_rows.limit(0)).count() == 0


def test_toxicity_recall_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").withColumn("low_quality", 1 - F.col("quality"))
    rows = docs.join(labels, "doc_id")
    chain = toxicity.fit_chain(rows.where("doc_id % 3 <> 0"), ("low_quality", "toxic"))
    got = chain.predict(rows.where("doc_id % 3 = 0").withColumnRenamed("toxic", "truth")).select("toxic", "truth").collect()
    assert sum(r.toxic == bool(r.truth) for r in got) >= 0.95 * len(got)
    assert sum(r.toxic for r in got if r.truth) >= 0.68 * sum(r.truth for r in got)


def test_words_of_three_labelled_rows_have_weight():
    lists, y = pd.Series([[7], [7], [7], [8], [8], [9], [9], [9]]), np.array([1.0, 1, 1, 1, 1, 0, 0, 0])
    w = toxicity.fit_logistic(lists, np.zeros((8, 0)), y)
    assert w[7] > 0 > w[9] and w[8] == 0


def test_license_notices(spark):
    docs = [(1, "Some prose here.\nReleased under the MIT License.\nMore prose of ours."), (2, "The license to drive was granted."), (3, "Licensed under CC BY-NC 4.0.\nThis work is licensed under the GNU General Public License, version 3."), (4, None), (4, ""), (None, "Released under the MIT License.")] + [(i, f"plain words number {i} about rivers and {i * 7} hills") for i in range(10, 60)]
    got = {r.doc_id: (r.n_notices, r.families) for r in licenses.scan_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1] == (1, "mit") and got[2] == (0, None) and got[3] == (2, "cc-by-nc,gpl") and got[4] == (0, None) and got[None] == (1, "mit") and len(got) == 55


def test_license_notices_wrapped_and_double(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction."
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"
    gpl = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version."
    lesser = "You should have received a copy of the GNU Lesser General Public\nLicense along with this library."
    docs = [(1, mit), (2, bsd), (3, f"Words before.\n{gpl}\n\n{mit}"), (4, lesser), (5, "Licensed under the MIT License or the Apache License, Version 2.0."), (6, "SPDX-License-Identifier: MIT OR Apache-2.0"), (7, bsd.replace("\n", "\n\n")), (8, bsd), (8, bsd), (9, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY 4.0.\nLicensed under CC BY 4.0.")]
    docs += [(i, f"plain words number {i} about rivers and {i * 7} hills") for i in range(10, 60)]
    got = {r.doc_id: (r.n_notices, r.families) for r in licenses.scan_documents(spark.createDataFrame(docs, "doc_id long, text string")).where("doc_id < 10").collect()}
    assert got == {1: (1, "mit"), 2: (1, "bsd"), 3: (2, "gpl,mit"), 4: (1, "lgpl"), 5: (1, "apache,mit"), 6: (1, "apache,mit"), 7: (0, None), 8: (2, "bsd"), 9: (3, "cc-by,cc-by-nc")}


def test_license_families_in_held_out_wordings(spark):
    """Notices as projects word them, none of them a template, among lines that only sound alike."""
    held = {
        "mit": ["This project is released under the MIT License, see LICENSE.", "The code here is licensed under the MIT License."],
        "apache": ["This file is licensed under the Apache License, Version 2.0 by its authors.", "// SPDX-License-Identifier: Apache-2.0"],
        "bsd": ["All code is licensed under the BSD 3-Clause License unless noted."],
        "gpl": ["Our tool: this work is licensed under the GNU General Public License, version 3, or later.", "/* SPDX-License-Identifier: GPL-3.0-or-later */"],
        "isc": ["ISC\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."],
        "epl": ["This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0 which is available at eclipse.org."],
        "cc0": ["# SPDX-License-Identifier: CC0-1.0"],
        "unlicense": ["This is free and unencumbered software released into the public domain."],
        "zlib": ["This software is provided 'as-is', without any express or implied\nwarranty.  In no event will the authors be held liable for any damages\narising from the use of this software."],
        "proprietary": ["Unauthorized copying of this file, via any medium is strictly prohibited\nProprietary and confidential"],
        "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this"],
    }
    notices = [(f, t) for f, ts in held.items() for t in ts]
    other = ["The driver had to show a license at the gate.", "No fee is due before the permission is granted.", "The city permitted the modification of both forms.", "The charge of the battery is low.", "She was held liable for the damages.", "Binary stars in eclipse were seen.", "A gnu and an antelope."]
    plain = [f"plain words number {i} about rivers and {i * 7} hills" for i in range(60)]
    rows = [(i, t) for i, t in enumerate([t for _, t in notices] + other + plain)]
    got = {r.doc_id: r.families for r in licenses.scan_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(notices))] == [f for f, _ in notices]
    assert all(got[i] is None for i in range(len(notices), len(rows)))


def test_license_classifier_decides_wordings_without_a_template(spark):
    """None of these holds a template. Without the model all that name a family would be notices, without these scores none."""
    held = [("mit", "Distributed under the terms of the MIT license."), ("mit", "This project is MIT licensed."), ("bsd", "BSD-licensed, see COPYING."), ("gpl", "You may use it under the GPLv3 license."), ("lgpl", "The library comes with an LGPL licence."), ("cc-by-nc", "Images have a CC BY-NC licence, not for sale"), ("epl", "Its license is the EPL"), ("gpl", "The code is licensed under the GNU\nGeneral Public\nLicense")]
    other = ["Er fuhr mit dem Wagen ohne license.", "At MIT the students need no driving license to ride a bicycle on the campus", "An eclipse was seen by the driver without a license", "Wir lebten mit der license."]
    plain = [f"plain words number {i} about rivers and {i * 7} hills at the lake" for i in range(60)] + [f"Sie kamen mit dem Zug {i} und gingen mit uns" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate([t for _, t in held] + other + plain)), "doc_id long, text string")
    found = licenses.candidates(licenses.runs_of(docs))
    assert found.where(F.col("overlap") >= licenses.CONFIRM).count() == 0
    assert {r.doc_id for r in found.where("named").select("doc_id").collect()} == set(range(len(held) + len(other)))
    got = {r.doc_id: r.families for r in licenses.scan_documents(docs).collect()}
    assert [got[i] for i in range(len(held))] == [f for f, _ in held]
    assert all(got[i] is None for i in range(len(held), len(got)))


def test_license_notices_in_narrow_lines(spark):
    """Wrapped over more than six lines, with a comment mark each; a notice of six lines of any length; runs end at blank lines."""
    wrap = lambda family, width, mark: "\n".join(mark + x for x in textwrap.wrap(licenses.TEMPLATES[family][0], width))
    isc, zlib = wrap("isc", 24, "# "), wrap("zlib", 16, "// ")
    assert isc.count("\n") > 6 and zlib.count("\n") > 8
    long = "\n".join(f"{' '.join(f'w{i}x{j}' for j in range(40))} {x}" for i, x in enumerate(wrap("isc", 46, "").split("\n")))
    docs = [(1, f"Words before.\n{isc}\nWords after."), (2, zlib), (3, isc.replace("\n", "\n\n")), (4, f"{isc}\n\n{zlib}\n{isc}"), (5, "\n".join(["word"] * 90) + "\n" + wrap("mit", 8, ""))]
    docs += [(i, f"plain words number {i} about rivers and {i * 7} hills") for i in range(10, 60)]
    got = {r.doc_id: (r.n_notices, r.families) for r in licenses.scan_documents(spark.createDataFrame(docs, "doc_id long, text string")).where("doc_id < 10").collect()}
    assert got == {1: (1, "isc"), 2: (1, "zlib"), 3: (0, None), 4: (3, "isc,zlib"), 5: (1, "mit")}
    runs = licenses.runs_of(spark.createDataFrame([(1, long)], "doc_id long, text string"))
    assert runs.agg(F.max(F.col("stop") - F.col("start"))).first()[0] == min(5, long.count("\n"))


def test_license_names_need_a_hint():
    assert set(licenses.LICENCE) <= set(licenses.HINTS) and set(licenses.NAMED) == set(licenses.SHORT) == set(licenses.TEMPLATES)


def test_license_scan_ignores_other_columns_and_long_texts(spark):
    rows = [(1, "word " * 200_000 + "\nReleased under the MIT License.", "x", 0.5, "y"), (2, "\n".join(["a line of license words"] * 30_000), "x", 0.5, "y"), (3, None, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, family string, probability double, _grams string")
    got = {r.doc_id: (r.n_notices, r.families) for r in licenses.scan_documents(frame).collect()}
    assert got == {1: (1, "mit"), 2: (0, None), 3: (0, None)}


def test_license_background_is_every_line(spark):
    """More lines than any bound on samples: each distinct one counts once, in the fit or in the cut."""
    texts = [(i, f"line {i} of rivers and hills\nline {i} of any software\nthe same line") for i in range(6_000)]
    plain = licenses.plain_lines(spark.createDataFrame(texts + texts[:50], "doc_id long, text string")).collect()
    assert sum(r.n for r in plain) == 12_001 and len(plain) < 20
    assert 0.5 < sum(r.n for r in plain if r.fitted) / 12_001 < 0.7


def test_license_hints_lose_no_notice():
    for family, texts in licenses.TEMPLATES.items():
        for text in texts:
            pairs = licenses.template_pairs(text)
            left = [p for p in pairs if not set(p.split()) & set(licenses.HINTS)]
            assert len(left) / len(pairs) < licenses.CONFIRM or any(p in licenses.NAMES[family] and p not in left for p in pairs), text


def test_toxicity_with_odd_labels(spark):
    text = lambda i: ("nasty foul words" if i % 2 else "kind calm words") + f" w{i}"
    docs = [(i, text(i), "own") for i in range(120)]
    cast = "doc_id long, text string, _idx string, low_quality int, toxic int"
    plain = spark.createDataFrame([(i, t, x, i % 2, i % 2) for i, t, x in docs], cast)
    repeated = plain.unionByName(plain.where("doc_id < 30")).unionByName(plain.where("doc_id < 5").selectExpr("doc_id", "text", "_idx", "null AS low_quality", "toxic"))
    frame = plain.select("doc_id", "text", "_idx")
    for labels in (plain, repeated):
        got = toxicity.fit_chain(labels, ("low_quality", "toxic")).predict(frame)
        assert got.columns[:3] == ["doc_id", "text", "_idx"]
        assert [r.toxic for r in got.orderBy("doc_id").collect()] == [bool(i % 2) for i in range(120)]
    one = toxicity.fit_chain(plain.withColumn("toxic", F.lit(0)), ("toxic",)).predict(frame).collect()
    assert all(r.p_toxic < 0.05 for r in one)
    none = toxicity.fit_chain(plain.limit(0), ("toxic",)).predict(frame).collect()
    assert all(r.p_toxic == 0.5 for r in none)


def test_warc_of_long_and_odd_payloads(spark):
    html = ["x" * 3_000_000, "\r\n" * 5, "a\r\n", "\r\n\r\n", "\n\r\n\rWARC/1.1\r\n", "é\r\n\r\nWARC/1.1\r\nContent-Length: 9\r\n\r\n123456789\r\n\r\n"]
    pages = spark.createDataFrame([(i, "http://x", h, 5) for i, h in enumerate(html)], "page_id long, url string, html string, record_id int")
    path = scratch_path(spark, "warc-long")
    warc.write_archives(pages, path)
    captures = warc.assemble_transactions(warc.read_archives(spark, path))
    plan = captures._jdf.queryExecution().executedPlan().toString()
    assert sorted(bytes(c.response.body).decode() for c in captures.collect()) == sorted(html)
    assert plan.count("FileScan text") == 1 and "Join" not in plan


def test_quality_without_language_or_source(spark):
    draw = random.Random(5)
    docs = [(i, " ".join(f"w{draw.randrange(900)}" for _ in range(80)), 3) for i in range(40)] + [(99, "short", 3)]
    got = quality.filter_documents(spark.createDataFrame(docs, "doc_id long, text string, _q_n_words int"))
    assert got.columns == ["doc_id", "text", "_q_n_words"] and {(r.doc_id, r._q_n_words) for r in got.collect()} == {(i, 3) for i in range(40)}
