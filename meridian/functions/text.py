"""Text functions: pages, sentences, windows, headings, sections, tokens, chunks."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that search leaves out.
STOPWORDS = (
    "a", "an", "the", "and", "or", "but", "if", "in", "on", "at", "to", "for", "from", "by", "of", "with", "as", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "do", "does", "did", "doing", "this", "that", "these", "those", "i", "you", "he", "she", "it", "we", "they", "them", "their", "his", "her",
    "its", "our", "your", "my", "me", "us", "what", "which", "who", "whom", "where", "when", "why", "how", "into", "than", "then", "so", "such", "about",
)


def _let(value: Column, then) -> Column:
    return F.transform(F.array(value), then)[0]


def pages(docs: DataFrame, marker: str) -> DataFrame:
    """(doc_id, page_no, text, char_offset) of documents cut at marker lines; the offset is that in
    the pages joined by blank lines."""
    parts = F.transform(F.split("text", rf"(?m)^{marker}$"), lambda p: F.regexp_replace(p, r"^\n+|\n+$", ""))
    rows = docs.select("doc_id", F.posexplode(parts).alias("i", "text"))
    before = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("doc_id", (F.col("i") + 1).alias("page_no"), "text", F.coalesce(F.sum(F.length("text") + 2).over(before), F.lit(0)).alias("char_offset"))


def full_text(page_rows: DataFrame) -> DataFrame:
    parts = F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda s: s["text"])
    return page_rows.groupBy("doc_id").agg(F.array_join(parts, "\n\n").alias("text"))


def page_at(page_rows: DataFrame, offsets: DataFrame) -> DataFrame:
    """offsets (doc_id, offset, ...) with the page whose start is the last one at or before offset."""
    extra = [c for c in offsets.columns if c not in ("doc_id", "offset")]
    starts = page_rows.select("doc_id", F.col("char_offset").alias("offset"), F.col("page_no").alias("_page"), F.lit(0).alias("_query"), *[F.lit(None).cast(offsets.schema[c].dataType).alias(c) for c in extra])
    asked = offsets.select("doc_id", "offset", F.lit(None).cast("int").alias("_page"), F.lit(1).alias("_query"), *extra)
    last = Window.partitionBy("doc_id").orderBy("offset", "_query").rowsBetween(Window.unboundedPreceding, 0)
    found = starts.unionByName(asked).withColumn("page_no", F.last("_page", ignorenulls=True).over(last))
    return found.where("_query = 1").select("doc_id", "offset", "page_no", *extra)


def pieces(text: Column) -> Column:
    """Words with the white space after them (white space at the start is a piece too): they tile text."""
    return F.regexp_extract_all(text, F.lit(r"(\S+\s*|\s+)"), F.lit(1))


def _before(lengths: Column) -> Column:
    """For each place of a short array, the sum of what comes before it."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(lengths, start, lambda s, n: F.struct((s["at"] + n).cast("int").alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])


def _ends(lengths: Column) -> Column:
    """For each place of a short array, the sum up to it and with it."""
    return F.zip_with(_before(lengths), lengths, lambda a, n: (a + n).cast("int"))


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, x: a + x)


def window_chunks(docs: DataFrame, size: int = 512, stride: int = 448, strategy: str = "token") -> DataFrame:
    """(doc_id, strategy, chunk_no, char_start, char_end, n_tokens, text): windows of pieces, up to
    the first that reaches the end."""
    if not 0 < stride <= size:
        raise ValueError("stride must be positive and no more than size")
    cut = docs.where(F.length("text") > 0).select("doc_id", pieces(F.col("text")).alias("_p"))  # a text that isn't empty has pieces
    last = F.greatest(F.lit(0), F.ceil((F.size("_p") - size) / stride)).cast("int")

    # each chunk's pieces are taken from the array once, and the strides before a chunk are summed
    def chunks(p: Column) -> Column:
        numbers = F.sequence(F.lit(0), last)
        strides = F.transform(numbers, lambda c: _total(F.transform(F.slice(p, c * stride + 1, stride), lambda t: F.length(t))))
        made = lambda at: F.transform(numbers, lambda c: F.struct(c.alias("chunk_no"), F.get(at, c).alias("char_start"), F.least(F.lit(size), F.size(p) - c * stride).alias("n_tokens"), F.array_join(F.slice(p, c * stride + 1, size), "").alias("text")))
        return _let(_before(strides), made)

    # outer, here and below: a filter against empty arrays would be pushed down and cut the text again
    rows = cut.select("doc_id", F.inline_outer(chunks(F.col("_p"))))
    return rows.select("doc_id", F.lit(strategy).alias("strategy"), "chunk_no", "char_start", (F.col("char_start") + F.length("text")).alias("char_end"), "n_tokens", "text")


SENTENCE = r"((?s).*?(?:[.!?]\s+(?=[A-Z\"'(])|\z))"


def sentences(text: Column) -> Column:
    """Sentences with the white space after them: a terminator, white space, then a capital, quote
    or parenthesis ends one. They tile the text; an empty text is one empty sentence."""
    found = F.array_remove(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(1)), "")
    return _let(found, lambda f: F.when(F.size(f) == 0, F.array(F.lit(""))).otherwise(f))


def sentence_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, sentence_no, start, end, sentence): end excludes white space after the sentence."""
    rows = docs.select("doc_id", F.posexplode_outer(sentences(F.coalesce("text", F.lit("")))).alias("sentence_no", "_s"))
    before = Window.partitionBy("doc_id").orderBy("sentence_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("_s")).over(before), F.lit(0))
    return rows.withColumn("start", start).select("doc_id", "sentence_no", "start", (F.col("start") + F.length(F.regexp_replace("_s", r"\s+$", ""))).alias("end"), F.regexp_replace("_s", r"\s+$", "").alias("sentence"))


def packed(sizes: Column, budget: int, overlap: int = 1) -> Column:
    """Ranges (first, end) of sentences packed greedily to a budget of tokens, each range beginning
    `overlap` (0 or 1) sentence before the end of the one before it."""
    new = lambda out, a, b: F.concat(out, F.array(F.struct(a.alias("first"), b.alias("end"))))
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("first"), F.lit(0).alias("held"), F.lit(0).alias("prior"), F.array().cast("array<struct<first:int,end:int>>").alias("out"))

    def step(s: Column, n: Column) -> Column:
        full = (s["i"] > s["first"]) & (s["held"] + n > budget)
        back = full & F.lit(bool(overlap)) & (s["i"] - s["first"] > 1)
        again = back & (s["prior"] + n > budget)  # the overlapping sentence alone is a chunk
        out = F.when(again, new(new(s["out"], s["first"], s["i"]), s["i"] - 1, s["i"])).when(full, new(s["out"], s["first"], s["i"])).otherwise(s["out"])
        first = F.when(again | (full & ~back), s["i"]).when(back, s["i"] - 1).otherwise(s["first"])
        held = F.when(again | (full & ~back), n).when(back, s["prior"] + n).otherwise(s["held"] + n)
        return F.struct((s["i"] + 1).alias("i"), first.cast("int").alias("first"), held.alias("held"), n.alias("prior"), out.alias("out"))

    return F.aggregate(sizes, start, step, lambda s: F.when(s["i"] > s["first"], new(s["out"], s["first"], s["i"])).otherwise(s["out"]))


def sentence_chunks(docs: DataFrame, budget: int = 512, strategy: str = "semantic") -> DataFrame:
    """(doc_id, strategy, chunk_no, char_start, char_end, n_tokens, text): sentences packed to a
    budget with one sentence of overlap; a longer sentence is a chunk of its own."""
    cut = docs.where(F.length(F.trim("text")) > 0).select("doc_id", sentences(F.col("text")).alias("_s"))
    cut = cut.withColumn("_n", F.transform("_s", lambda s: F.size(pieces(s))))
    cut = cut.withColumn("_r", packed(F.col("_n"), budget))

    # chunks are cut inside the row, so that none carries the others' sentences
    def chunks(s: Column, n: Column, ranges: Column) -> Column:
        since = lambda r, k: F.coalesce(F.get(ranges, k - 1)["first"], F.lit(0))
        steps = F.transform(ranges, lambda r, k: _total(F.transform(F.slice(s, since(r, k) + 1, r["first"] - since(r, k)), lambda t: F.length(t))))
        body = lambda r: F.regexp_replace(F.array_join(F.slice(s, r["first"] + 1, r["end"] - r["first"]), ""), r"\s+$", "")
        made = lambda ends: F.transform(ranges, lambda r, k: F.struct(k.alias("chunk_no"), F.get(ends, k).alias("char_start"), _total(F.slice(n, r["first"] + 1, r["end"] - r["first"])).alias("n_tokens"), body(r).alias("text")))
        return _let(_ends(steps), made)

    rows = cut.select("doc_id", F.inline_outer(chunks(F.col("_s"), F.col("_n"), F.col("_r"))))
    return rows.select("doc_id", F.lit(strategy).alias("strategy"), "chunk_no", "char_start", (F.col("char_start") + F.length("text")).alias("char_end"), "n_tokens", "text")


def heading_level(line: Column) -> Column:
    """1 to 6 for a line of that many # and text; 1 for a short line without terminal punctuation
    that is numbered or mostly capitals; else null."""
    body = F.trim(line)
    letters, upper = F.length(F.regexp_replace(body, r"\P{L}", "")), F.length(F.regexp_replace(body, r"\P{Lu}", ""))
    short = (F.length(body) > 0) & (F.length(body) <= 80) & ~body.rlike(r"[.!?:;,]$")
    plain = short & (body.rlike(r"^(?:\d+(?:\.\d+){0,4}\.?|[A-Z]\.(?:\d+\.?)?)\s+\S") | ((letters > 0) & (upper >= 0.7 * letters)))
    return F.when(body.rlike(r"^#{1,6}\s+\S"), F.length(F.regexp_extract(body, r"^(#{1,6})", 1))).when(plain, 1)


def sections(docs: DataFrame) -> DataFrame:
    """(doc_id, section_no, path, char_start, text): lines under one heading, with the titles of the
    headings above it; text before the first heading has an empty path."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    run = Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("level", heading_level(F.col("line"))).withColumn("title", F.regexp_replace(F.trim("line"), r"^#{1,6}\s+|\s+$", ""))
    lines = lines.withColumns({"section_no": F.count("level").over(run), "start": F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0))})
    last = {k: F.last(F.when(F.col("level") == k, F.struct("at", "title")), ignorenulls=True).over(run) for k in range(1, 7)}
    lines = lines.withColumns({f"h{k}": c for k, c in last.items()})
    shown = []
    for k in range(1, 7):
        above = F.greatest(F.lit(-1), F.lit(-1), *[F.coalesce(F.col(f"h{j}.at"), F.lit(-1)) for j in range(1, k)])
        shown.append(F.when(F.col(f"h{k}.at") > above, F.col(f"h{k}.title")))
    lines = lines.withColumn("path", F.array_compact(F.array(*shown)))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda s: s["line"]), "\n")
    return lines.groupBy("doc_id", "section_no").agg(F.min_by("path", "at").alias("path"), F.min("start").alias("char_start"), body.alias("text"))


def hybrid_chunks(docs: DataFrame, budget: int = 512, stride: int = 448) -> DataFrame:
    """Sections up to a budget whole, longer ones in windows; offsets are those in the document."""
    found = sections(docs).where(F.length(F.trim("text")) > 0).withColumn("_n", F.size(pieces(F.col("text"))))
    whole = found.where(F.col("_n") <= budget).select("doc_id", "section_no", F.lit(0).alias("chunk_no"), "char_start", (F.col("char_start") + F.length("text")).alias("char_end"), F.col("_n").alias("n_tokens"), "text")
    long = found.where(F.col("_n") > budget)
    parts = window_chunks(long.select(F.struct("doc_id", "section_no", F.col("char_start").alias("base")).alias("doc_id"), "text"), budget, stride)
    parts = parts.select("doc_id.doc_id", "doc_id.section_no", "chunk_no", (F.col("doc_id.base") + F.col("char_start")).alias("char_start"), (F.col("doc_id.base") + F.col("char_end")).alias("char_end"), "n_tokens", "text")
    return whole.unionByName(parts).withColumn("strategy", F.lit("hybrid"))


def chunk_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 16)


def search_tokens(text: Column) -> Column:
    """Lower-case letters-and-digits runs with a % after them; single letters and stopwords go."""
    found = F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z0-9]+%?)"), F.lit(1)), F.lower)
    return F.filter(found, lambda t: ((F.length(t) >= 2) | t.rlike("^[0-9]+$")) & ~t.isin(*STOPWORDS))


# a single letter is no token; in UTF-8, bytes of other than ASCII characters match nothing
_TOKEN, _LEFT_OUT = re.compile(rb"[a-z0-9]{2,}%?|[a-z0-9]%|[0-9]"), [w.encode() for w in STOPWORDS]


def counted_tokens(text: str) -> Counter[bytes]:
    """How often each of the search_tokens of one text is there, inside a task."""
    held = Counter(_TOKEN.findall(text.encode("utf-8", "surrogatepass").lower()))
    for w in _LEFT_OUT:
        held.pop(w, None)
    return held


def collapse(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"\s+", " "))


def holds_all(text: Column, keywords: Column) -> Column:
    return F.forall(keywords, lambda k: F.contains(collapse(text), collapse(k)))


def holds_any(text: Column, keywords: Column) -> Column:
    return F.exists(keywords, lambda k: F.contains(collapse(text), collapse(k)))


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, r"\s+"), ""))


def first_sentence(text: Column, most: int = 200) -> Column:
    return F.substring(F.split(F.trim(text), r"(?<=[.!?])\s+", 2)[0], 1, most)


def approx_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))
