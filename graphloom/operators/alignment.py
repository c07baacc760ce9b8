"""Alignment of text segments to graph nodes and relations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.patterns import COLOURS, OTHER_COLOUR, RELATION_KEYWORDS
from graphloom.operators.entities import ranked

#: Least scores of the three kinds of alignment; alignments of a step.
EXACT, PARTIAL, SEMANTIC, PER_STEP = 0.9, 0.6, 0.3, 5
MAX_FEATURES = 1000
#: Common English words that carry no topic, in natural order.
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by "
    "can could did do does doing down during each few for from further had has have having he her here hers herself him "
    "himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other "
    "our ours ourselves out over own same she should so some such than that the their theirs them themselves then there "
    "these they this those through to too under until up very was we were what when where which while who whom why will "
    "with would you your yours yourself yourselves"
).split()


def segments(text: Column) -> Column:
    """Sentences without their marks; a single sentence is cut at semicolons instead and keeps its mark."""
    cut = lambda pattern: F.filter(F.transform(F.split(text, pattern), lambda s: F.trim(s)), lambda s: s != "")
    return F.when(F.size(cut("[.!?]+")) >= 2, cut("[.!?]+")).otherwise(cut("[;]+"))


def segment_rows(texts: DataFrame) -> DataFrame:
    """doc_id, segment_id, segment of texts(doc_id, text)."""
    return texts.select("doc_id", F.posexplode(segments(F.col("text"))).alias("segment_id", "segment"))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


#: Code points of the piece by which long texts meet.
CORE = 16


def align_exact(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """doc_id, segment_id, id, score: equal texts score 1; if one contains the other, the shorter's share of the
    longer, from EXACT on. The shorter then covers the middle of the longer, so pairs meet by the longer's middle
    piece, which stands near the middle of the shorter: a tenth of each text's places, and no product of both sides."""
    left = rows.select(F.struct("doc_id", "segment_id").alias("l"), F.lower(F.trim("segment")).alias("s"))
    right = nodes.select("id", F.lower(F.trim("text")).alias("e"))
    found = left.join(right, F.col("s") == F.col("e")).select("l", "id", F.lit(1.0).alias("score"))
    for long, a, short, b in ((left, "s", right, "e"), (right, "e", left, "s")):
        met = long.withColumn("piece", middle(F.col(a))).join(short.withColumn("piece", F.explode(around_middle(F.col(b)))), "piece")
        n, m = F.length(b), F.length(a)
        met = met.where((n < m) & (n >= EXACT * m)).where(F.contains(F.col(a), F.col(b)))
        found = found.unionByName(met.select("l", "id", F.round(n / m, 9).alias("score")).distinct())
    return found.select("l.doc_id", "l.segment_id", "id", "score")


def middle(text: Column) -> Column:
    """The middle piece of a long text; a short one's middle character."""
    size = F.when(F.length(text) >= 20, CORE).otherwise(1)
    return F.substr(text, F.floor((F.length(text) - size) / 2).cast("int") + 1, size)


def around_middle(text: Column) -> Column:
    """All pieces at which the middle of a text can stand that contains this one and is longer by a ninth at most."""
    n = F.length(text)

    def pieces(size):
        low = F.greatest(F.floor(n * 0.444 - size / 2).cast("int") - 1, F.lit(0))
        high = F.least(F.ceil(n * 0.5556 - size / 2).cast("int") + 1, n - size)
        each = F.transform(F.sequence(low, high), lambda i: F.substr(text, i + 1, F.lit(size)))
        return F.when(high >= low, each).otherwise(F.array().cast("array<string>"))

    # A containing text may be long where this one is not yet.
    return F.array_distinct(F.when(n >= 20, pieces(CORE)).when(n >= CORE, F.concat(pieces(CORE), pieces(1))).otherwise(pieces(1)))


def align_jaccard(rows: DataFrame, nodes: DataFrame, least: float = PARTIAL) -> DataFrame:
    """The same by the Jaccard similarity of word sets, from `least` on. Two sets so similar share one of the rarest
    words of each: for a set of n words the first n - ceil(least * n) + 1 in the order of their frequency, so only
    those prefixes are joined."""
    left = rows.select(F.struct("doc_id", "segment_id").alias("l"), F.array_distinct(words(F.col("segment"))).alias("x")).where(F.size("x") > 0)
    right = nodes.select("id", F.array_distinct(words(F.col("text"))).alias("y")).where(F.size("y") > 0)
    counts = left.select(F.explode("x").alias("w")).unionByName(right.select(F.explode("y").alias("w"))).groupBy("w").agg(F.count("*").alias("n"))

    def prefix(sets, key, column):
        each = sets.select(key, F.size(column).alias("size"), F.explode(column).alias("w")).join(counts, "w")
        kept = ranked(each, [key], ["n", "w"], 1 << 30)
        return kept.where(F.col("rank") <= F.col("size") - F.ceil(F.col("size") * least) + 1).select(key, "w")

    met = prefix(left, "l", "x").join(prefix(right, "id", "y"), "w").select("l", "id").distinct()
    both = F.size(F.array_intersect("x", "y"))
    score = both / (F.size("x") + F.size("y") - both)
    found = met.join(left, "l").join(right, "id").withColumn("score", F.round(score, 9)).where(F.col("score") >= least)
    return found.select("l.doc_id", "l.segment_id", "id", "score")


# TF-IDF in long form


def grams(text: Column) -> Column:
    """Words of two letters or more without stop words, and pairs of them."""
    tokens = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: (F.length(w) >= 2) & ~w.isin(STOP_WORDS))
    pairs = F.when(
        F.size(tokens) >= 2, F.transform(F.sequence(F.lit(1), F.size(tokens) - 1), lambda i: F.concat_ws(" ", F.element_at(tokens, i), F.element_at(tokens, i + 1)))
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(tokens, pairs)


def fit_tfidf(corpus: DataFrame, max_features: int = MAX_FEATURES) -> DataFrame:
    """term, idf of corpus(id, text): the most frequent terms, ties in alphabetical order; idf is
    ln((1 + n) / (1 + df)) + 1. At most max_features rows."""
    n = corpus.count()
    terms = corpus.select("id", F.explode(grams(F.col("text"))).alias("term"))
    counts = terms.groupBy("term", "id").agg(F.count("*").alias("tf")).groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df"))
    top = counts.orderBy(F.desc("total"), "term").limit(max_features)
    return top.select("term", (F.log((F.lit(n) + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def tfidf(texts: DataFrame, key: str, model: DataFrame) -> DataFrame:
    """key, term, weight: rows of length 1. The model is bounded, so it is broadcast."""
    tf = texts.select(key, F.explode(grams(F.col("text"))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    rows = tf.join(F.broadcast(model), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = rows.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return rows.join(norms, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))


def align_tfidf(rows: DataFrame, nodes: DataFrame, least: float = SEMANTIC) -> DataFrame:
    """The same by the cosine of TF-IDF weights fitted on nodes(id, text, context), from `least` on; pairs meet by the
    terms that they share."""
    corpus = nodes.select("id", F.concat_ws(" ", "text", F.coalesce("context", F.lit(""))).alias("text"))
    model = fit_tfidf(corpus)
    left = tfidf(rows.select(F.struct("doc_id", "segment_id").alias("l"), F.col("segment").alias("text")), "l", model)
    right = tfidf(corpus, "id", model)
    score = left.join(right.withColumnRenamed("weight", "v"), "term").groupBy("l", "id").agg(F.round(F.sum(F.col("weight") * F.col("v")), 6).alias("score"))
    return score.where(F.col("score") >= least).select("l.doc_id", "l.segment_id", "id", "score")


def align_relations(rows: DataFrame, relations: DataFrame, predicates: list[str]) -> DataFrame:
    """doc_id, segment_id, predicate, subject, object: where a segment holds a keyword of a predicate (by default its
    name), every relation of that predicate."""
    low = F.lower("segment")
    hits = []
    for p in predicates:
        hit = F.lit(False)
        for word in RELATION_KEYWORDS.get(p, [p]):
            hit = hit | F.contains(low, F.lit(word))
        hits.append(F.when(hit, F.lit(p)))
    found = rows.select("doc_id", "segment_id", F.explode(F.filter(F.array(*hits), lambda p: p.isNotNull())).alias("predicate"))
    return found.join(relations.select("predicate", "subject", "object"), "predicate")


def best_alignments(rows: DataFrame, k: int = PER_STEP) -> DataFrame:
    """Of alignments(doc_id, segment_id, id, score): the best of each segment and node, then the k best of a document."""
    first = rows.groupBy("doc_id", "segment_id", "id").agg(F.max("score").alias("score"))
    return ranked(first, ["doc_id"], [F.desc("score"), "segment_id", "id"], k)


def overall(entity_scores: Column, relation_scores: Column) -> Column:
    both = F.concat(entity_scores, relation_scores)
    return F.when(F.size(both) > 0, F.aggregate(both, F.lit(0.0), lambda a, b: a + b) / F.size(both)).otherwise(0.0)


@dataclass
class Alignments:
    """entities(step_id, segment_id, segment, id, text, type, context, kind, score, rank), relations(step_id, segment_id,
    segment, predicate, subject, object, score), steps(step_id, n_entities, n_relations, confidence)."""

    entities: DataFrame
    relations: DataFrame
    steps: DataFrame


def keywords(predicate: Column) -> Column:
    known = F.create_map(*(x for p, found in RELATION_KEYWORDS.items() for x in (F.lit(p), F.array(*map(F.lit, found)))))
    return F.coalesce(F.element_at(known, predicate), F.array(predicate))


def align_steps(steps: DataFrame, nodes: DataFrame, relations: DataFrame, k: int = PER_STEP) -> Alignments:
    """Aligns each of steps(step_id, text, predicates: array) to nodes(id, text, type, context) and to relations(subject,
    predicate, object, confidence); a step without text has no segments.

    Every segment is matched to nodes in the three ways; of one segment text and node the best counts, then the k best of
    a step, ties by segment, way (exact, partial, semantic) and id. Relations are those of each of the step's predicates
    whose keywords a segment holds. The steps' counts and confidences come from sums by predicate, so that a predicate
    with very many relations isn't multiplied out unless `relations` is read.
    """
    from graphloom.operators.graph import settled

    rows = settled(segment_rows(steps.select(F.col("step_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))))
    own = rows.groupBy("doc_id", "segment").agg(F.min("segment_id").alias("segment_id")).select("doc_id", "segment_id", "segment")
    ways = (("exact", align_exact), ("partial", align_jaccard), ("semantic", align_tfidf))
    found = None
    for i, (kind, way) in enumerate(ways):
        each = way(own, nodes).withColumns({"way": F.lit(i), "kind": F.lit(kind)})
        found = each if found is None else found.unionByName(each)
    best = found.groupBy("doc_id", "segment_id", "id").agg(F.min(F.struct((-F.col("score")).alias("s"), "way", "kind")).alias("b"))
    best = best.select("doc_id", "segment_id", "id", (-F.col("b.s")).alias("score"), "b.way", "b.kind")
    best = settled(ranked(best, ["doc_id"], [F.desc("score"), "segment_id", "way", "id"], k))
    entities = best.join(rows, ["doc_id", "segment_id"]).join(nodes.select("id", "text", "type", "context"), "id")
    entities = entities.select(F.col("doc_id").alias("step_id"), "segment_id", "segment", "id", "text", "type", "context", "kind", "score", "rank")
    asked = rows.withColumnRenamed("doc_id", "step_id").join(steps.select("step_id", F.explode("predicates").alias("predicate")), "step_id")
    hits = asked.where(F.exists(keywords(F.col("predicate")), lambda w: F.contains(F.lower("segment"), w)))
    by_predicate = relations.groupBy("predicate").agg(F.count("*").alias("n"), F.sum("confidence").alias("total"))
    related = hits.join(by_predicate, "predicate").groupBy("step_id").agg(F.sum("n").alias("n_relations"), F.sum("total").alias("r"))
    linked = best.groupBy(F.col("doc_id").alias("step_id")).agg(F.count("*").alias("n_entities"), F.sum("score").alias("e"))
    each = steps.select("step_id").join(linked, "step_id", "left").join(related, "step_id", "left").na.fill(0)
    n = F.col("n_entities") + F.col("n_relations")
    confidence = F.when(n > 0, F.round((F.col("e") + F.col("r")) / n, 6)).otherwise(0.0)
    met = hits.join(relations.select("predicate", "subject", "object", F.col("confidence").alias("score")), "predicate")
    met = met.select("step_id", "segment_id", "segment", "predicate", "subject", "object", "score")
    return Alignments(entities, met, each.select("step_id", "n_entities", "n_relations", confidence.alias("confidence")))


def align_path(path: DataFrame, texts: DataFrame, nodes: DataFrame, relations: DataFrame) -> Alignments:
    """The same for the steps of a path(step_id, predicates) and their texts(step_id, text), matched by their number; a
    step without a text is aligned to none."""
    return align_steps(path.join(texts.select("step_id", "text"), "step_id", "left"), nodes, relations)


def edges_to_draw(found: Alignments) -> DataFrame:
    """step_id, source, target, label, score, segment of the aligned relations."""
    return found.relations.select("step_id", F.col("subject").alias("source"), F.col("object").alias("target"), F.col("predicate").alias("label"), "score", "segment")


def alignment_quality(steps: DataFrame) -> DataFrame:
    """Of steps(step, n_entities, n_relations, confidence): mean confidence, alignments per step, share of steps with any."""
    return steps.agg(
        F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 6).alias("mean_confidence"),
        F.round(F.coalesce(F.avg("n_entities"), F.lit(0.0)), 6).alias("entities_per_step"),
        F.round(F.coalesce(F.avg("n_relations"), F.lit(0.0)), 6).alias("relations_per_step"),
        F.round(F.coalesce(F.avg(((F.col("n_entities") > 0) | (F.col("n_relations") > 0)).cast("int")), F.lit(0.0)), 6).alias("covered"),
    )


def colour(kind: Column) -> Column:
    out = F.lit(OTHER_COLOUR)
    for name, value in COLOURS.items():
        out = F.when(kind == name, F.lit(value)).otherwise(out)
    return out


def picture(aligned: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per document the nodes to draw, with their colours, and the highlighted segments."""
    rows = aligned.join(nodes.select("id", "text", "type"), "id")
    node = F.struct("id", "text", "type", colour(F.col("type")).alias("colour"))
    mark = F.struct("segment_id", "id", "score")
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_set(node)).alias("nodes"), F.array_sort(F.collect_set(mark)).alias("highlights"))


def summary(quality: DataFrame) -> DataFrame:
    line = F.format_string("confidence %.3f, %.2f entities and %.2f relations a step, %.1f%% of steps covered", "mean_confidence", "entities_per_step", "relations_per_step", F.col("covered") * 100)
    return quality.select(line.alias("summary"))
