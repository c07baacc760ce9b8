"""The search loop's table operators: markers, turn decisions, compression of reasoning, documents and paragraphs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.entities import ranked

#: Searches, turns, hits and document length by kind of data set.
LIMITS = {
    "single_hop": {"searches": 5, "turns": 15, "top_k": 10, "doc_len": 3000},
    "multi_hop": {"searches": 10, "turns": 15, "top_k": 10, "doc_len": 3000},
    "default": {"searches": 10, "turns": 15, "top_k": 10, "doc_len": 3000},
}
BEGIN, END = "<|begin_search_query|>", "<|end_search_query|>"


def between(text: Column, begin: str, end: str) -> Column:
    """The last text between two markers, trimmed, or null."""
    found = F.regexp_extract_all(text, F.lit(f"(?s){re.escape(begin)}(.*?){re.escape(end)}"), F.lit(1))
    return F.when(F.size(found) > 0, F.trim(F.element_at(found, -1)))


def decide_turns(turns: DataFrame, limit: int, begin: str = BEGIN, end: str = END) -> DataFrame:
    """Of turns(conv_id, turn, text): query, and action: finished without a query at the end, search for a new one
    under the limit, limit once it is reached, repeat otherwise. Searches are those turns that ask for a new query."""
    rows = turns.withColumn("query", between(F.col("text"), begin, end))
    asks = F.col("query").isNotNull() & F.endswith(F.rtrim("text"), F.lit(end))
    seen = Window.partitionBy("conv_id", "query").orderBy("turn")
    rows = rows.withColumn("asks", F.coalesce(asks, F.lit(False)))
    rows = rows.withColumn("new", F.col("asks") & (F.sum(F.col("asks").cast("int")).over(seen) == 1))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("searches", F.coalesce(F.sum(F.col("new").cast("int")).over(before), F.lit(0)))
    action = (
        F.when(~F.col("asks"), "finished")
        .when(F.col("searches") >= limit, "limit")
        .when(F.col("new"), "search")
        .otherwise("repeat")
    )
    return rows.select("conv_id", "turn", "query", action.alias("action"))


def compress_reasoning(text: str, markers: tuple[str, ...] = (BEGIN, END)) -> str:
    """Numbers the lines as steps; of more than five keeps the first, the last four and those with a marker, and "..."
    for each gap."""
    parts = [f"Step {i}: {line}" for i, line in enumerate(text.split("\n"), 1)]
    if len(parts) <= 5:
        return "\n\n".join(parts)
    keep = [i == 0 or i >= len(parts) - 4 or any(m in p for m in markers) for i, p in enumerate(parts)]
    out: list[str] = []
    for kept, part in zip(keep, parts):
        if kept:
            out.append(part)
        elif out[-1] != "...":
            out.append("...")
    return "\n\n".join(out)


def compressed(text: Column, markers: tuple[str, ...] = (BEGIN, END)) -> Column:
    """compress_reasoning() as an expression: a line that isn't kept becomes "..." if the one before it is."""
    parts = F.transform(F.split(text, "\n"), lambda line, i: F.concat(F.lit("Step "), (i + 1).cast("string"), F.lit(": "), line))

    def kept(part, i):
        out = (i == 0) | (i >= F.size(parts) - 4)
        for m in markers:
            out = out | F.contains(part, F.lit(m))
        return out

    short = lambda part, i: F.when(kept(part, i), part).when(kept(F.element_at(parts, F.greatest(i, F.lit(1))), i - 1), F.lit("..."))
    chosen = F.when(F.size(parts) <= 5, parts).otherwise(F.filter(F.transform(parts, short), lambda p: p.isNotNull()))
    return F.array_join(chosen, "\n\n")


def paragraphs(text: Column, least: int = 20) -> Column:
    """Sentences of more than `least` characters, of a text without tags and with single spaces."""
    plain = F.regexp_replace(F.regexp_replace(text, "<[^>]*>", " "), r"\s+", " ")
    return F.filter(F.transform(F.split(plain, r"\."), lambda s: F.trim(s)), lambda s: F.length(s) > least)


def not_cached(urls: DataFrame, cache: DataFrame) -> DataFrame:
    return urls.join(cache.select("url"), "url", "left_anti")


def top_hits(hits: DataFrame, k: int) -> DataFrame:
    """The first k of hits(query_id, hit_rank, ...) of each query."""
    return ranked(hits, ["query_id"], ["hit_rank"], k)


def parse_hits(results: DataFrame, k: int) -> DataFrame:
    """query_id, hit_rank, title, url, snippet of results(query_id, body): the first k hits of a search's JSON answer."""
    schema = "struct<webPages: struct<value: array<struct<name: string, url: string, snippet: string>>>>"
    rows = results.select("query_id", F.posexplode(F.from_json("body", schema)["webPages"]["value"]).alias("hit_rank", "h"))
    return top_hits(rows.select("query_id", "hit_rank", F.col("h.name").alias("title"), "h.url", "h.snippet"), k).drop("rank")


def formatted_documents(pages: DataFrame, doc_len: int) -> DataFrame:
    """query_id, document: the pages(query_id, rank, title, url, text) of a query, as numbered JSON, in order."""
    cut = F.substring("text", 1, 2 * doc_len)
    body = F.to_json(F.struct("title", "url", F.regexp_replace(cut, "</?b>", "").alias("text")))
    each = F.struct("rank", F.concat(F.lit("**Web Page "), F.col("rank").cast("string"), F.lit(":**\n"), body, F.lit("\n")).alias("part"))
    return pages.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(each)), lambda p: p["part"]), "").alias("document"))


def prompt(question: Column, instruction: str, knowledge: Column | None = None) -> Column:
    parts = [F.lit(instruction + "\n\nQuestion: "), question]
    if knowledge is not None:
        parts += [F.lit("\n\nKnown facts:\n"), F.coalesce(knowledge, F.lit(""))]
    return F.concat(*parts)


def run_loop(questions: DataFrame, generate, search, dataset: str = "default") -> DataFrame:
    """conv_id, output: plays turns of generate(df) -> df with text and search(df of conv_id, query) -> df of conv_id,
    found, until every sequence has finished or the turns are used up. Each turn is one plan over all sequences."""
    from graphloom.operators.graph import settled

    limits = LIMITS.get(dataset, LIMITS["default"])
    state = settled(
        questions.select("conv_id", F.col("question").alias("output"), F.lit(False).alias("finished"), F.array().cast("array<string>").alias("asked"))
    )
    for _ in range(limits["turns"]):
        live = state.where(~F.col("finished"))
        if live.isEmpty():
            break
        said = generate(live).withColumn("query", between(F.col("text"), BEGIN, END))
        said = said.withColumn("asks", F.coalesce(F.endswith(F.rtrim("text"), F.lit(END)), F.lit(False)) & F.col("query").isNotNull())
        said = settled(said)
        found = search(said.where("asks").select("conv_id", "query")).select("conv_id", "found")
        repeat = F.array_contains("asked", F.col("query"))
        reply = F.when(F.size("asked") >= limits["searches"], F.lit("The search limit is reached.")).when(repeat, F.lit("This query was asked before.")).otherwise(F.coalesce("found", F.lit("")))
        new = said.join(found, "conv_id", "left").select(
            "conv_id",
            F.concat("output", F.lit("\n"), "text", F.when(F.col("asks"), F.concat(F.lit("\n"), reply)).otherwise("")).alias("output"),
            (~F.col("asks")).alias("finished"),
            F.when(F.col("asks") & (F.size("asked") < limits["searches"]), F.array_union("asked", F.array("query"))).otherwise(F.col("asked")).alias("asked"),
        )
        state = settled(state.where("finished").unionByName(new))
    return state.select("conv_id", "output", "finished")
