"""License scans, in DataFrame and MLlib functions only.

A paragraph is a line or a run of adjacent ones (see RUN), as notices are often wrapped. A multinomial logistic
regression over hashed word one- and two-grams of the templates and of further wordings tells it from unknown. It is a
notice of each family that has a template of which it holds most of the word pairs, among them all that name the family; and of
the family that the regression gives it, if it names that family beside a word for licence. Background are all distinct lines without a word
of notices, and those with one that hold little of any template and name no family, of texts without confirmed notices: three fifths of
them are fitted, and the cut is calibrated on all others. Lines that hold the same of the templates' grams count as one row with a weight. Of runs within one another the shortest counts, and notices that share lines count as one.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.quantiles import exact_quantiles
from .common import load, written

#: Usual wordings of notices, by family.
TEMPLATES = {
    "agpl": ["This program is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only", "You should have received a copy of the GNU Affero General Public License along with this program."],
    "apache": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', "SPDX-License-Identifier: Apache-2.0", "Released under the Apache License 2.0."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", "Released under the BSD License."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC-SA 4.0."],
    "cc0": ["Licensed under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "SPDX-License-Identifier: CC0-1.0"],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.", "SPDX-License-Identifier: EPL-2.0", "Licensed under the Eclipse Public License, version 2.0."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.", "SPDX-License-Identifier: GPL-3.0-or-later", "You should have received a copy of the GNU General Public License along with this program."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "SPDX-License-Identifier: ISC", "Licensed under the ISC License."],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-or-later", "You should have received a copy of the GNU Lesser General Public License along with this library."],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.", "SPDX-License-Identifier: MIT", "Licensed under the MIT License."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "proprietary": ["Proprietary and confidential. All rights reserved.", "Unauthorized copying of this file, via any medium, is strictly prohibited.", "This software is proprietary and confidential."],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense", "Released under the Unlicense."],
    "zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "SPDX-License-Identifier: Zlib"],
}
#: Pairs that name a family: where a template has some, a paragraph must hold all of these.
NAMES = {
    "agpl": ["gnu affero", "identifier agpl"],
    "apache": ["the apache", "apache license", "apache 2"],
    "bsd": ["the bsd", "identifier bsd"],
    "cc-by": ["cc by", "by 4", "by sa", "sa 4", "commons attribution", "attribution 4"],
    "cc-by-nc": ["cc by", "by nc", "nc 4", "nc sa", "commons attribution", "attribution noncommercial"],
    "cc0": ["cc0 1", "waived all", "identifier cc0"],
    "epl": ["eclipse public", "identifier epl"],
    "gpl": ["gnu general", "identifier gpl"],
    "isc": ["the isc", "without fee", "identifier isc"],
    "lgpl": ["gnu lesser", "identifier lgpl"],
    "mit": ["the mit", "identifier mit"],
    "mpl": ["mozilla public", "identifier mpl"],
    "proprietary": ["proprietary and", "unauthorized copying"],
    "unlicense": ["unencumbered software", "identifier unlicense", "the unlicense"],
    "zlib": ["held liable", "identifier zlib"],
}
#: Words for licence, and words and pairs that beside one of them name a family to the reader, whatever the wording.
LICENCE = ("licence", "licenced", "licences", "license", "licensed", "licenses", "licensing")
NAMED = {
    "agpl": ["agpl", "agplv3", "affero"],
    "apache": ["apache"],
    "bsd": ["bsd"],
    "cc-by": ["cc by", "commons attribution"],
    "cc-by-nc": ["by nc", "attribution noncommercial"],
    "cc0": ["cc0"],
    "epl": ["epl", "eclipse"],
    "gpl": ["gpl", "gplv2", "gplv3", "gnu general"],
    "isc": ["isc"],
    "lgpl": ["lgpl", "lgplv3", "gnu lesser"],
    "mit": ["mit"],
    "mpl": ["mpl", "mozilla"],
    "proprietary": ["proprietary"],
    "unlicense": ["unlicense", "unencumbered"],
    "zlib": ["zlib"],
}
#: Wordings that are fitted beside the templates, with each of the family's short names.
SHORT = {
    "agpl": ["AGPL", "AGPLv3", "GNU Affero"],
    "apache": ["Apache", "Apache 2.0"],
    "bsd": ["BSD", "BSD 2-Clause", "BSD 3-Clause"],
    "cc-by": ["CC BY", "CC BY 4.0", "CC BY-SA", "Creative Commons Attribution"],
    "cc-by-nc": ["CC BY-NC", "CC BY-NC 4.0", "CC BY-NC-SA", "Creative Commons Attribution-NonCommercial"],
    "cc0": ["CC0", "CC0 1.0"],
    "epl": ["EPL", "Eclipse Public"],
    "gpl": ["GPL", "GPLv2", "GPLv3", "GNU General Public"],
    "isc": ["ISC"],
    "lgpl": ["LGPL", "LGPLv3", "GNU Lesser General Public"],
    "mit": ["MIT"],
    "mpl": ["MPL", "Mozilla Public"],
    "proprietary": ["proprietary"],
    "unlicense": ["Unlicense"],
    "zlib": ["zlib"],
}
WORDINGS = ["Available under the {} license.", "{} licensed.", "License: {}", "The {} licence applies to all files.", "Covered by a {} license"]
#: No paragraph is a notice (CONFIRM and NAMES, or NAMED) without one of these words.
HINTS = (*LICENCE, "affero", "agpl", "apache", "attribution", "binary", "bsd", "cc", "cc0", "charge", "eclipse", "epl", "fee", "forms", "gnu", "gpl", "granted", "hereby", "isc", "lgpl", "liable", "modification", "mozilla", "mpl", "permitted", "proprietary", "unauthorized", "unencumbered", "unlicense", "waived", "zlib")
FAMILIES = ["unknown", *sorted(TEMPLATES)]
FEATURES = 1 << 13
#: All fitted background lines together weigh as much as so many rows at most; a template weighs one.
BACKGROUND = 4_000
#: A notice holds CONFIRM or more of a template's word pairs, background less than CLEAR of any.
CONFIRM, CLEAR = 0.8, 0.3
#: The least probability of the family that a paragraph names without holding its template.
SURE = 0.5
#: At most this share of background lines is taken for notices of some family.
FALSE_ALARMS = 0.01
#: A notice may be wrapped over RUN lines of any length, or over as many as come within the first twice LONGEST words: the longest
#: template has LONGEST words, and narrow lines may hold a comment mark each.
RUN, LONGEST = 6, 34
COPIES = 20


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _pairs(w: Column) -> Column:
    return F.array_distinct(F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1))))


def _let(value: Column, then) -> Column:
    return F.transform(F.array(value), then)[0]


def wordings() -> list[tuple[str, str]]:
    """(family, text): WORDINGS with the short names of SHORT."""
    return [(f, t.format(n)) for f, names in SHORT.items() for n in names for t in WORDINGS]


def vocabulary() -> list[str]:
    """The words and pairs of templates, the words of LICENCE and NAMED, and the pairs of wordings that have one of these."""
    telling = {*LICENCE, *(x for xs in NAMED.values() for n in xs for x in n.split())}
    made = {x for ts in TEMPLATES.values() for t in ts for x in (*template_words(t), *template_pairs(t))}
    return sorted(made | telling | {p for _, t in wordings() for p in template_pairs(t) if set(p.split()) & telling})


def grams(paragraph: Column) -> Column:
    """The words and word pairs of the vocabulary that the paragraph holds, in order, and the number of its words in powers of two."""
    every = vocabulary()  # a set that is made once; an array would be hashed for each line
    size = lambda w: F.concat(F.lit("#"), F.floor(F.log2(F.size(w) + 1)).cast("string"))
    return _let(words(paragraph), lambda w: F.array_append(F.array_sort(F.filter(F.concat(F.array_distinct(w), _pairs(w)), lambda x: x.isin(every))), size(w)))


def featured(rows: DataFrame) -> DataFrame:
    """rows with the features of _grams, or of the paragraph's grams, if there is no such column."""
    made = HashingTF(numFeatures=FEATURES, binary=True, inputCol="_grams", outputCol="_features")
    return made.transform(rows if "_grams" in rows.columns else rows.withColumn("_grams", grams(F.col("paragraph")))).drop("_grams")


def hinted(text: Column) -> Column:
    """Whether the text has a word of HINTS: first sought as plain substrings, which is much cheaper."""
    plain = [h for h in HINTS if not any(o != h and o in h for o in HINTS)]  # who holds one of the others holds one of these
    held = lambda t: reduce(Column.__or__, [t.contains(h) for h in plain]) & t.rlike(r"(?<![\p{L}\p{N}])(?:" + "|".join(HINTS) + r")(?![\p{L}\p{N}])")
    return _let(F.lower(text), held)


def lines_of(docs: DataFrame, keep) -> DataFrame:
    """Distinct lines with a letter or digit that keep (a function of the line) takes, with mark, their
    hash, and fitted; repeats are counted together before they are shuffled."""
    lines = F.filter(F.split("text", "\n"), lambda x: keep(x) & x.rlike(r"[\p{L}\p{N}]"))
    each = docs.select(F.explode(lines).alias("paragraph")).groupBy("paragraph").agg(F.count(F.lit(1)).alias("n"))
    return each.select("paragraph", F.xxhash64("paragraph").alias("mark"), _fitted(F.col("paragraph")).alias("fitted"))


def plain_lines(docs: DataFrame) -> DataFrame:
    """(_grams, fitted, n): all distinct lines without a word of HINTS, counted by what they hold of the templates'
    grams. A line is sent as its hash and its grams."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[\p{L}\p{N}]") & ~hinted(x))
    each = docs.select(F.explode(lines).alias("paragraph")).select(F.xxhash64("paragraph").alias("mark"), _fitted(F.col("paragraph")).alias("fitted"), grams(F.col("paragraph")).alias("_grams"))
    return written(each.distinct().groupBy("_grams", "fitted").agg(F.count(F.lit(1)).alias("n")), "plain")


def _fitted(paragraph: Column) -> Column:
    return F.pmod(F.xxhash64(paragraph, F.lit(1)), F.lit(5)) < 3


def around_lines(docs: DataFrame) -> DataFrame:
    """COPIES distinct lines without a word of HINTS (all of them, if there are fewer), to put templates between their words. Only
    lines whose hash is under a bound are gathered; the bound is raised until there are enough."""
    bits, found = 30, None
    for cut in (20, 23, 26, 30):
        keep = lambda x: (F.pmod(F.xxhash64(x, F.lit(2)), F.lit(1 << bits)) < F.lit(1 << cut)) & ~hinted(x)  # noqa: B023, E731
        found = written(lines_of(docs, keep).orderBy("mark", "paragraph").limit(COPIES), "around")
        if found.count() == COPIES:
            break
    return found


def _notice() -> Column:
    return 1 - vector_to_array("_p")[0]


def fit(plain: DataFrame, hard: DataFrame, around: DataFrame):
    """The classifier and its cut. Of plain (see plain_lines) and hard (see lines_of) all lines marked as fitted are fitted;
    all others are scored, and FALSE_ALARMS of them lie above the cut. around: lines to put templates between."""
    spark = plain.sparkSession
    made = spark.createDataFrame([(float(FAMILIES.index(f)), t) for f, ts in TEMPLATES.items() for t in ts] + [(float(FAMILIES.index(f)), t) for f, t in wordings()], "label double, paragraph string")
    # notices within other words: a template between the first words of background paragraphs
    some = around.select(F.array_join(F.slice(words(F.col("paragraph")), 1, 6), " ").alias("around"))
    within = made.crossJoin(F.broadcast(some)).select("label", F.concat_ws(" ", "around", "paragraph", "around").alias("paragraph"))  # both sides bounded
    counted = plain.unionByName(hard.groupBy(grams(F.col("paragraph")).alias("_grams"), "fitted").agg(F.count(F.lit(1)).alias("n")))
    lines = counted.where("fitted").agg(F.sum("n")).first()[0] or 1
    unknown = counted.where("fitted").select(F.lit(0.0).alias("label"), (F.col("n") * min(1.0, BACKGROUND / lines)).alias("weight"), "_grams")
    notices = made.unionByName(within).select("label", F.lit(1.0).alias("weight"), grams(F.col("paragraph")).alias("_grams"))
    rows = written(featured(notices.coalesce(1).unionByName(unknown)).select("label", "weight", "_features"), "train")
    model = LogisticRegression(weightCol="weight", featuresCol="_features", labelCol="label", probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_y", family="multinomial", maxIter=20, regParam=1e-4).fit(rows)
    rest = model.transform(featured(counted.where("NOT fitted"))).groupBy(_notice().alias("p")).agg(F.sum("n").alias("n"))
    worst = exact_quantiles(written(rest, "rest"), [], "p", [1 - FALSE_ALARMS], weight="n").first()
    return model, 0.5 if worst is None else worst["q"][0]


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def template_pairs(text: str) -> tuple[str, ...]:
    w = template_words(text)
    return tuple(dict.fromkeys(f"{x} {y}" for x, y in zip(w, w[1:], strict=False)))


def _near(lines: Column) -> Column:
    """The lines that a run may hold that begins with the first: as many as are full, and RUN of these or those before which there are
    fewer than twice LONGEST words."""
    none = F.struct(F.lit(0).alias("held"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def add(a, x):
        more = a["open"] & x["full"] & ((a["held"] < RUN) | (a["n"] < 2 * LONGEST))
        return F.struct((a["held"] + more.cast("int")).alias("held"), (a["n"] + x["n"]).alias("n"), more.alias("open"))

    return F.slice(lines, F.lit(1), F.aggregate(lines, none, add)["held"])


def runs_of(docs: DataFrame) -> DataFrame:
    """(doc_id, of, start, stop, paragraph): runs of adjacent lines with a letter or digit, one of which
    has a word of HINTS; of is the text's hash, start and stop are the first and last line."""
    marked = F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("line"), x.rlike(r"[\p{L}\p{N}]").alias("full"), hinted(x).alias("hint"), F.size(words(x)).alias("n")))
    near = _let(marked, lambda m: F.filter(F.transform(m, lambda _, i: F.struct(i.alias("start"), _near(F.slice(m, i + 1, 2 * LONGEST)).alias("near"))), lambda s: F.exists(s["near"], lambda x: x["hint"])))
    starts = docs.where(hinted(F.col("text"))).select("doc_id", F.xxhash64("text").alias("of"), F.inline(near))
    runs = starts.select("doc_id", "of", "start", F.explode(F.transform(F.sequence(F.lit(1), F.size("near")), lambda k: F.struct(k.alias("k"), F.slice("near", F.lit(1), k).alias("lines")))).alias("r"))
    own = runs.where(F.exists("r.lines", lambda x: x["hint"]))
    return own.select("doc_id", "of", "start", (F.col("start") + F.col("r.k") - 1).alias("stop"), F.array_join("r.lines.line", "\n").alias("paragraph"))


def _overlaps(paragraph: Column, then) -> Column:
    """then of an array of structs (family, overlap, named): for each family the largest share of a
    template's word pairs that the paragraph holds, of templates all of whose naming pairs it holds,
    and the largest of all templates."""

    def best(held: Column, family: str) -> Column:
        shares, named = [], []
        for text in TEMPLATES[family]:
            pairs = template_pairs(text)
            share = F.size(F.array_intersect(held, F.array(*map(F.lit, pairs)))) / len(pairs)
            shares.append(share)
            named.append(F.when(reduce(Column.__and__, [F.array_contains(held, x) for x in pairs if x in NAMES[family]], F.lit(True)), share).otherwise(0.0))
        return F.struct(F.lit(family).alias("family"), F.greatest(F.lit(0.0), *named).alias("overlap"), F.greatest(F.lit(0.0), *shares).alias("share"))

    every = sorted({x for ts in TEMPLATES.values() for t in ts for x in template_pairs(t)})
    told = lambda held: F.when(F.size(held) > 0, F.array(*[best(held, f) for f in TEMPLATES]))
    return _let(_let(words(paragraph), lambda w: F.filter(_pairs(w), lambda x: x.isin(every))), lambda held: _let(told(held), then))


def named(paragraph: Column) -> Column:
    """The families that the paragraph names (see NAMED) beside a word for licence."""
    every = sorted({x for xs in NAMED.values() for x in xs})
    own = lambda w: F.when(F.exists(w, lambda x: x.isin(*LICENCE)), F.filter(F.concat(w, _pairs(w)), lambda x: x.isin(every)))
    told = lambda h: F.array_compact(F.array(*[F.when(F.arrays_overlap(h, F.array(*map(F.lit, xs))), F.lit(f)) for f, xs in NAMED.items()]))
    return F.coalesce(_let(_let(words(paragraph), own), lambda h: F.when(F.size(h) > 0, told(h))), F.array().cast("array<string>"))


def candidates(paragraphs: DataFrame) -> DataFrame:
    """paragraphs once for each family of which they hold a template or which they name, with family, overlap (of its
    template; 0 below CONFIRM), named and _grams. What the model would call a notice besides is none, so it needs no score."""
    held = _overlaps(F.col("paragraph"), lambda a: F.transform(F.filter(a, lambda s: s["overlap"] >= CONFIRM), lambda s: F.struct(s["family"].alias("family"), s["overlap"].alias("overlap"))))
    found = paragraphs.withColumns({"_held": F.coalesce(held, F.array().cast("array<struct<family:string,overlap:double>>")), "_named": named(F.col("paragraph"))})
    found = found.where((F.size("_held") > 0) | (F.size("_named") > 0))
    more = F.transform(F.array_except("_named", F.col("_held.family")), lambda f: F.struct(f.alias("family"), F.lit(0.0).alias("overlap")))
    each = found.select(*paragraphs.columns, "_named", grams(F.col("paragraph")).alias("_grams"), F.inline(F.concat("_held", more)))
    return each.withColumn("named", F.array_contains("_named", F.col("family"))).drop("_named")


def hard_lines(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The distinct lines (see lines_of) with a word of HINTS that hold less than CLEAR of any template and name no family,
    of the texts in which no template was confirmed: others hold further parts of their notices."""
    held = found.where(F.col("overlap") >= CONFIRM).select("of").distinct()
    clear = docs.where(hinted(F.col("text"))).withColumn("of", F.xxhash64("text")).join(held, "of", "left_anti")
    lines = lines_of(clear, hinted).where(F.size(named(F.col("paragraph"))) == 0)
    return lines.where(F.coalesce(_overlaps(F.col("paragraph"), lambda a: F.forall(a, lambda s: s["share"] < CLEAR)), F.lit(True)))


def scan(found: DataFrame, model, cut: float) -> DataFrame:
    """Those of the candidates that the model tells from unknown, with the probability of a notice of any family: it is no
    less than the cut where a template is held, and where a family is only named it is, alone, no less than the cut and SURE."""
    own = F.element_at(vector_to_array("_p"), F.element_at(F.create_map(*[F.lit(x) for i, f in enumerate(FAMILIES) for x in (f, i + 1)]), F.col("family")))
    scored = model.transform(featured(found)).withColumns({"probability": _notice(), "_own": own})
    held, called = (F.col("overlap") >= CONFIRM) & (F.col("probability") >= cut), F.col("named") & (F.col("_own") >= max(cut, SURE))
    return scored.where(held | called).select(*[c for c in found.columns if c not in ("_grams", "named")], "probability")


def shortest(found: DataFrame) -> DataFrame:
    """(doc_id, family, probability, n): of the runs that scan found those that hold no other of their
    family; n counts a notice (with its repeated rows) at the first of the runs that share lines."""
    each = found.groupBy("doc_id", "of", "family", "start", "stop").agg(F.count(F.lit(1)).alias("n"), F.max("probability").alias("probability"))
    least = each.groupBy("doc_id", "of", "family", "start").agg(F.min(F.struct("stop", "n", "probability")).alias("s")).select("doc_id", "of", "family", "start", "s.*")
    within = F.min("stop").over(Window.partitionBy("doc_id", "of", "family").orderBy("start").rangeBetween(1, 2 * LONGEST))
    least = least.withColumn("_within", within).where("_within IS NULL OR _within > stop")
    before = F.max("stop").over(Window.partitionBy("doc_id", "of").orderBy("start", "stop", "family").rowsBetween(Window.unboundedPreceding, -1))
    return least.withColumn("_before", before).select("doc_id", "family", "probability", F.when(F.col("_before") >= F.col("start"), 0).otherwise(F.col("n")).alias("n"))


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_notices, families (sorted, comma-joined; null if none), probability (largest, of a
    notice of any family).

    One row for each doc_id with text of any kind, null ids as one; null and empty texts have no
    notices; repeated rows count together. Further columns of docs are ignored. A table without
    lines gives no families.
    """
    docs = docs.select("doc_id", "text")
    found = written(candidates(runs_of(docs)).drop("paragraph"), "candidates")
    model, cut = fit(plain_lines(docs), written(hard_lines(docs, found), "hard"), around_lines(docs))
    found = shortest(scan(found, model, cut)).groupBy("doc_id").agg(F.sum("n").alias("n_notices"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"), F.max("probability").alias("probability"))
    ids = docs.select(F.col("doc_id").alias("_of")).distinct()
    out = ids.join(found, F.col("_of").eqNullSafe(F.col("doc_id")), "left")
    return out.select(F.col("_of").alias("doc_id"), F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"), "families", "probability")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(load(spark, sf_dir, "documents").select("doc_id", "text"))
