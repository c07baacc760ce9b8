"""Reasoning over a graph: entity linking, relation prediction, rules, answers and steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.patterns import OTHER_TYPES, RULES, TYPE_RELATIONS
from graphloom.operators.entities import ranked

#: Longest side, in rows, that is broadcast after a count of it; a larger one takes part in a shuffle join.
SMALL = 20_000


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """df with a broadcast hint if it has at most `most` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def link_entities(questions: DataFrame, nodes: DataFrame, top_k: int = 5) -> DataFrame:
    """q_id, id, score, rank: the nodes that each question(q_id, question) mentions: 1 if it holds the node's whole
    text, else the share of the text's words that it holds; in lower case, ties by the nodes' order (first).

    Only nodes with a score count, and a node with one shares a piece of text with the question, so the questions
    meet the nodes by word pieces: a node's word may stand inside a question's word, so every question keeps its
    distinct substrings of the lengths that node words have; the join is an equality.
    """
    words = nodes.select("id", "first", F.lower("text").alias("low")).withColumn("words", F.filter(F.split("low", r"\s+"), lambda w: w != ""))
    keys = words.select("id", F.explode(F.array_distinct("words")).alias("word")).where(F.length("word") > 0)
    lengths = [r.n for r in keys.select(F.length("word").alias("n")).distinct().limit(65).collect()]
    low = questions.select("q_id", F.lower("question").alias("q"))
    if len(lengths) <= 64:  # the lengths of words are few, whatever the number of nodes
        pieces = None
        for n in lengths:
            at = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("q") - n + 1), _piece(n))))
            own = low.where(F.length("q") >= n).select("q_id", at.alias("word"))
            pieces = own if pieces is None else pieces.unionByName(own)
        met = pieces.join(keys, "word").select("q_id", "id").distinct() if pieces is not None else None
    else:
        met = low.join(keys, F.contains("q", "word")).select("q_id", "id").distinct()
    if met is None:
        return questions.sparkSession.createDataFrame([], "q_id long, id string, score double, rank int")
    rows = met.join(low, "q_id").join(words, "id")
    share = F.size(F.filter("words", lambda w: F.contains(F.col("q"), w))) / F.size("words")
    score = F.when(F.contains("q", "low"), 1.0).otherwise(share)
    rows = rows.select("q_id", "id", "first", F.round(score, 9).alias("score")).where("score > 0")
    return ranked(rows, ["q_id"], [F.desc("score"), "first", "id"], top_k).select("q_id", "id", "score", "rank")


def _piece(n: int):
    return lambda i: F.substr(F.col("q"), i, F.lit(n))


def infer(edges: DataFrame, spark: SparkSession) -> DataFrame:
    """src, dst, predicate, rule: edges that two edges in a row imply, by the rules; the first predicate holds."""
    rules = spark.createDataFrame(RULES, "rule string, p1 string, p2 string")  # seven rows
    one = edges.select("src", F.col("dst").alias("mid"), F.col("predicate").alias("p1")).join(F.broadcast(rules), "p1")
    two = edges.select(F.col("src").alias("mid"), "dst", F.col("predicate").alias("p2"))
    new = one.join(two, ["mid", "p2"]).where("src <> dst")
    return new.select("src", "dst", F.col("p1").alias("predicate"), "rule").distinct()


def apply_rules(path: list[tuple]) -> list[tuple]:
    """Rules annotate a path only: it comes back as it was."""
    return list(path)


def known_relations(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, predicate, score for pairs(a, b): edges from a to b, and edges from b to a as reverse_... at 0.8."""
    ab = pairs.join(edges, (pairs["a"] == edges["src"]) & (pairs["b"] == edges["dst"])).select("a", "b", "predicate", F.col("confidence").alias("score"))
    ba = pairs.join(edges, (pairs["b"] == edges["src"]) & (pairs["a"] == edges["dst"])).select(
        "a", "b", F.concat(F.lit("reverse_"), "predicate").alias("predicate"), (F.col("confidence") * 0.8).alias("score")
    )
    return ab.unionByName(ba)


def relations_by_type(pairs: DataFrame, spark: SparkSession) -> DataFrame:
    """a, b, predicate, score for pairs(a, b, type_a, type_b, similarity), from the types in either order."""
    rules = spark.createDataFrame(TYPE_RELATIONS, "x string, y string, predicate string, share double")
    both = rules.unionByName(rules.where("x <> y").select(F.col("y").alias("x"), F.col("x").alias("y"), "predicate", "share"))
    rows = pairs.join(F.broadcast(both), (F.col("type_a") == F.col("x")) & (F.col("type_b") == F.col("y")), "left")
    name, share = OTHER_TYPES
    score = F.col("similarity") * F.coalesce("share", F.lit(share))
    return rows.select("a", "b", F.coalesce("predicate", F.lit(name)).alias("predicate"), score.alias("score"))


def predict_relations(pairs: DataFrame, edges: DataFrame, least: float = 0.5, top_k: int = 5) -> DataFrame:
    """The known relations of each pair(a, b, type_a, type_b, similarity); for pairs without any and a similarity
    above `least`, those of their types; the best five. Scores have 12 decimal places."""
    spark = pairs.sparkSession
    known = known_relations(edges, pairs.select("a", "b"))
    rest = pairs.where(F.col("similarity") > least).join(known.select("a", "b").distinct(), ["a", "b"], "left_anti")
    found = ranked(known.unionByName(relations_by_type(rest, spark)), ["a", "b"], [F.desc("score"), "predicate"], top_k)
    return found.withColumn("score", F.round("score", 12))


def answer_questions(questions: DataFrame, nodes: DataFrame, relations: DataFrame, max_steps: int = 10) -> DataFrame:
    """q_id, entity (id), predicates, confidence, answer.

    The three best links of a question count. With fewer than two it fails; else the first of the two best that has
    relations gives one step, with its first three predicates, at 0.8, and neither gives none. With max_steps of 1
    only the best is tried. Relations are found by the entity's text as it is, as subject or object, in order.
    """
    links = link_entities(questions, nodes, 3)
    linked = links.groupBy("q_id").agg(F.count("*").alias("n_links"))
    tried = links.where(F.col("rank") <= min(2, max_steps)).join(nodes.select("id", "text", "type"), "id")
    sides = relations.select(F.explode(F.array_distinct(F.array("subject", "object"))).alias("text"), "predicate", F.struct("doc_id", "seq").alias("at"))
    sides = sides.join(tried.select("text").distinct(), "text", "left_semi")
    few = ranked(sides, ["text"], ["at"], 3).groupBy("text").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "predicate"))), lambda s: s["predicate"]).alias("predicates"))
    steps = tried.join(few, "text")
    first = steps.groupBy("q_id").agg(F.min_by(F.struct("id", "text", "type", "predicates"), "rank").alias("s"))
    rows = questions.join(linked, "q_id", "left").join(first, "q_id", "left")
    works = (F.coalesce("n_links", F.lit(0)) >= 2) & F.col("s").isNotNull()
    return rows.select(
        "q_id",
        F.when(works, F.col("s.id")).alias("entity"),
        F.when(works, F.col("s.predicates")).alias("predicates"),
        F.when(works, 0.8).otherwise(0.0).alias("confidence"),
        answer(F.lower("question"), works, F.col("s.text"), F.col("s.type"), F.col("s.predicates")).alias("answer"),
    )


def answer(low: Column, works: Column, text: Column, kind: Column, predicates: Column) -> Column:
    asks = lambda *words: low.rlike("|".join(words))
    return (
        F.when(~works, F.lit("no answer"))
        .when(asks("what", "who", "where", "when"), F.concat(F.lit("The answer is "), text, F.lit(" ("), kind, F.lit(")")))
        .when(asks("how", "why"), F.concat(F.lit("Because of: "), text, F.lit(" "), F.array_join(predicates, ", ")))
        .otherwise(F.lit("Confidence 0.80"))
    )


def path_steps(paths: DataFrame) -> DataFrame:
    """steps of paths(path: array of (src, predicate, dst)): array of (step_id, entities, relations, confidence)."""
    each = lambda t, i: F.struct(
        i.alias("step_id"), F.array(t["src"], t["dst"]).alias("entities"), F.array(t["predicate"]).alias("relations"), F.lit(0.8).alias("confidence")
    )
    return paths.withColumn("steps", F.transform("path", each))


def next_entities(visited: DataFrame, links: DataFrame, similar: DataFrame) -> DataFrame:
    """q_id, id of the entity to look at next: the best of links(q_id, id, rank) that isn't in visited(q_id, id), else the
    most similar one, of similar(target, id, rank), to the entity visited last (the greatest step of visited)."""
    new = links.join(visited.select("q_id", "id"), ["q_id", "id"], "left_anti").groupBy("q_id").agg(F.min_by("id", F.struct("rank", "id")).alias("id"))
    last = visited.groupBy("q_id").agg(F.max_by("id", F.struct("step", "id")).alias("target"))
    rest = last.join(new, "q_id", "left_anti").join(similar, "target").join(visited.select("q_id", "id"), ["q_id", "id"], "left_anti")
    return new.unionByName(rest.groupBy("q_id").agg(F.min_by("id", F.struct("rank", "id")).alias("id")))


def knowledge_report(questions: DataFrame, nodes: DataFrame, relations: DataFrame, edges: DataFrame) -> DataFrame:
    """q_id, report: the question, its answer and confidence, the step's entity and predicates, and the graph's counts,
    which are one row that every report shares."""
    found = answer_questions(questions, nodes, relations).join(questions, "q_id")
    found = found.join(nodes.select(F.col("id").alias("entity"), "text"), "entity", "left")
    counts = nodes.agg(F.count("*").alias("n_nodes")).join(relations.agg(F.count("*").alias("n_relations"))).join(edges.agg(F.count("*").alias("n_edges")))
    step = F.concat(F.lit("\nStep 1: "), "text", F.lit(" ("), F.array_join("predicates", ", "), F.lit(")"))
    line = F.format_string("\n%d entities, %d relations, %d edges", "n_nodes", "n_relations", "n_edges")
    head = F.concat(F.lit("Question: "), "question", F.lit("\nAnswer: "), "answer", F.format_string("\nConfidence: %.2f", "confidence"))
    return found.join(F.broadcast(counts)).select("q_id", F.concat(head, F.coalesce(step, F.lit("")), line).alias("report"))
