"""Cited answers: prompts, extractive drafts, claims with citations, entailment, verdicts, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_sentence, search_tokens

#: The sentinel and the phrases that count as a refusal, and what is shown for one.
REFUSAL = "[REFUSE]"
REFUSAL_PHRASES = ("i do not have the supporting guidance", "i don't have the supporting guidance", "i cannot answer this from the supplied", "no supporting guidance was found")
REFUSAL_TEXT = "I do not have the supporting guidance to answer this."


def prompts(passages: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, prompt) from passages (query_id, rank, chunk_id, text) in their order."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "text"))), lambda s: F.concat(F.lit("["), s["chunk_id"].cast("string"), F.lit("] "), s["text"]))
    held = passages.groupBy("query_id").agg(F.array_join(listed, "\n\n").alias("body"))
    parts = [F.lit("Question: "), F.col("question"), F.lit("\n\nPassages:\n\n"), F.coalesce("body", F.lit("(none)")), F.lit("\n\nAnswer with a citation in brackets after each sentence.")]
    return questions.select("query_id", F.col("text").alias("question")).join(held, "query_id", "left").select("query_id", F.concat(*parts).alias("prompt"))


def extractive(passages: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, answer): the first sentences of the two best passages with their ids, or a refusal."""
    said = F.concat(first_sentence(F.col("text")), F.lit(" ["), F.col("chunk_id").cast("string"), F.lit("]"))
    made = passages.where("rank <= 2").groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", said.alias("s")))), lambda x: x["s"]), " ").alias("answer"))
    return questions.select("query_id").join(made, "query_id", "left").select("query_id", F.coalesce("answer", F.lit(REFUSAL)).alias("answer"))


def claims(answers: DataFrame) -> DataFrame:
    """(query_id, pos, claim, tokens): sentences without their brackets, and what the brackets cite."""
    parts = F.split("answer", r"(?<=[.!?\]])\s+(?=[A-Z])")
    rows = answers.select("query_id", F.posexplode(parts).alias("pos", "s"))
    bodies = F.regexp_extract_all("s", F.lit(r"\[([^\[\]]+?)\]"), F.lit(1))
    tokens = F.array_remove(F.flatten(F.transform(bodies, lambda b: F.transform(F.split(b, ","), lambda x: F.trim(x)))), "")
    text = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("s", r"\[[^\[\]]+?\]", ""), r"\s+", " "), r"\s+([.!?,;:])", "$1"))
    return rows.select("query_id", "pos", text.alias("claim"), tokens.alias("tokens")).where("claim <> '' AND claim <> '.'")


def resolved(claim_rows: DataFrame, passages: DataFrame) -> DataFrame:
    """A row for each cited token: chunk_id by exact id (a chunk_id= prefix aside), else by its
    number in the passages' order, else null."""
    rows = claim_rows.select("query_id", "pos", "claim", F.explode("tokens").alias("token")).withColumn("key", F.regexp_replace("token", "^chunk_id=", ""))
    name = F.col("chunk_id").cast("string")
    known = passages.select("query_id", name.alias("key"), name.alias("by_id"))
    ranked = passages.select("query_id", F.col("rank").cast("string").alias("key"), name.alias("by_rank"))
    out = rows.join(known, ["query_id", "key"], "left").join(ranked, ["query_id", "key"], "left")
    return out.select("query_id", "pos", "claim", "token", F.coalesce("by_id", "by_rank").alias("chunk_id"))


def refused(answers: DataFrame, citations: DataFrame) -> DataFrame:
    """(query_id, refused): a sentinel or refusal phrase, and no citation that resolves."""
    low = F.lower("answer")
    phrase = F.contains(F.col("answer"), F.lit(REFUSAL))
    for p in REFUSAL_PHRASES:
        phrase |= F.contains(low, F.lit(p))
    cited = citations.groupBy("query_id").agg(F.bool_or(F.col("chunk_id").isNotNull()).alias("cited"))
    return answers.join(cited, "query_id", "left").select("query_id", (phrase & ~F.coalesce("cited", F.lit(False))).alias("refused"))


def entailment(premise: Column, claim: Column) -> Column:
    """Struct (entails, neutral, contradicts) from the share of the claim's tokens in the premise."""
    h, p = F.array_distinct(search_tokens(claim)), F.array_distinct(search_tokens(premise))
    c = F.try_divide(F.size(F.array_intersect(h, p)), F.size(h))
    e, n = F.round(0.05 + 0.87 * c, 4), F.round(0.90 - 0.85 * c, 4)
    rest = F.greatest(F.lit(0.0), F.round(1 - e - n, 4))
    return F.when(c.isNull(), F.struct(F.lit(0.0).alias("entails"), F.lit(1.0).alias("neutral"), F.lit(0.0).alias("contradicts"))).otherwise(F.struct(e.alias("entails"), n.alias("neutral"), rest.alias("contradicts")))


def verdicts(claim_rows: DataFrame, citations: DataFrame, passages: DataFrame, least: float = 0.5) -> DataFrame:
    """(query_id, pos, claim, verified, headline, score, supporting, reason) for each claim."""
    body = passages.select("query_id", F.col("chunk_id").cast("string").alias("chunk_id"), F.col("text").alias("premise"))
    scored = citations.where("chunk_id IS NOT NULL").dropDuplicates(["query_id", "pos", "chunk_id"]).join(body, ["query_id", "chunk_id"]).withColumn("e", entailment(F.col("premise"), F.col("claim"))["entails"])
    order = Window.partitionBy("query_id", "pos").orderBy(F.col("e").desc(), "chunk_id")
    ranked = scored.withColumn("r", F.row_number().over(order))
    best = ranked.groupBy("query_id", "pos").agg(F.max(F.when(F.col("r") == 1, F.col("chunk_id"))).alias("headline"), F.max("e").alias("score"), F.array_sort(F.collect_list(F.when((F.col("r") > 1) & (F.col("e") >= least), F.col("chunk_id")))).alias("supporting"))
    out = claim_rows.join(best, ["query_id", "pos"], "left")
    verified = F.coalesce(F.col("score") >= least, F.lit(False))
    reason = F.when(verified, F.lit(None).cast("string")).when(F.size("tokens") == 0, "no_citation").when(F.col("score").isNull(), "phantom_citation").otherwise("no_passage_entails")
    return out.select("query_id", "pos", "claim", verified.alias("verified"), F.when(verified, F.col("headline")).alias("headline"), "score", F.when(verified, F.col("supporting")).otherwise(F.array().cast("array<string>")).alias("supporting"), reason.alias("reason"))


def shown_text(judged: DataFrame) -> DataFrame:
    """(query_id, text): the verified claims in order, or the refusal text."""
    kept = F.transform(F.array_sort(F.collect_list(F.when(F.col("verified"), F.struct("pos", "claim")))), lambda s: s["claim"])
    return judged.groupBy("query_id").agg(F.when(F.bool_or("verified"), F.array_join(kept, " ")).otherwise(REFUSAL_TEXT).alias("text"))


def usage_totals(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """(model, n_calls, input_tokens, output_tokens, cost_usd); a model without a price costs nothing."""
    priced = calls.join(prices, "model", "left")
    cost = (F.col("input_tokens") * F.coalesce("input_per_1k", F.lit(0.0)) + F.col("output_tokens") * F.coalesce("output_per_1k", F.lit(0.0))) / 1000
    return priced.withColumn("cost", cost).groupBy("model").agg(F.count(F.lit(1)).alias("n_calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("cost"), 6).alias("cost_usd"))
