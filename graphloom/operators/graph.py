"""Knowledge graphs as tables: nodes, relations and edges; building, merging, statistics, lookups and paths."""

from __future__ import annotations

import os
import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.entities import entity_id, extract_entities, merge_entities, ranked
from graphloom.operators.relations import extract_relations


def settled(df: DataFrame) -> DataFrame:
    """df as a table in the folder that the cluster shares (spark.checkpoint.dir), for loops and for what is read
    more than once; lost executors then cost no history. A local folder serves only where Spark is local too."""
    spark = df.sparkSession
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that the cluster shares")
    path = f"{top or os.path.join(tempfile.gettempdir(), 'graphloom-checkpoints')}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables that settled() wrote and no plan reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.settled_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@dataclass
class Graph:
    """nodes(id, key, text, type, confidence, context, n_mentions, first), relations(doc_id, seq, subject, predicate,
    object, ...), edges(src, dst, predicate, confidence, edge_seq)."""

    nodes: DataFrame
    relations: DataFrame
    edges: DataFrame
    metadata: dict = field(default_factory=dict)


def edges_of(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """One edge for each ordered pair of nodes, from the last relation between them; relations whose subject or
    object is no node are dropped. Names are looked up trimmed and in lower case."""
    names = nodes.groupBy("key").agg(F.min_by("id", F.struct("first", "id")).alias("id"))
    order = F.struct("doc_id", "seq")
    rows = (
        relations.withColumn("s", F.lower(F.trim("subject"))).withColumn("o", F.lower(F.trim("object")))
        .join(names.select(F.col("key").alias("s"), F.col("id").alias("src")), "s")
        .join(names.select(F.col("key").alias("o"), F.col("id").alias("dst")), "o")
    )
    return last_edges(rows.withColumn("edge_seq", order))


def last_edges(rows: DataFrame) -> DataFrame:
    """Of rows(src, dst, predicate, confidence, edge_seq) the last for each src and dst."""
    last = rows.groupBy("src", "dst").agg(F.max(F.struct("edge_seq", "predicate", "confidence")).alias("e"))
    return last.select("src", "dst", "e.predicate", "e.confidence", "e.edge_seq")


def build_graph(docs: DataFrame) -> Graph:
    """The graph of docs(doc_id, text)."""
    relations = extract_relations(docs)
    nodes = merge_entities(extract_entities(docs))
    return Graph(nodes, relations, edges_of(nodes, relations), {"num_documents": docs.count()})


def merge_graphs(a: Graph, b: Graph) -> Graph:
    """One graph of both: nodes with one id are merged, their confidence weighted by mentions (so that the order of
    updates doesn't matter), relations are kept as they are, edges built anew; documents add up. Ids made of text and
    type have 32 bits, which large graphs share by chance: such nodes are merged only if text and type are the same."""
    both = a.nodes.withColumn("side", F.lit(0)).unionByName(b.nodes.withColumn("side", F.lit(1)))
    made = F.when(F.col("id") == entity_id(F.col("text"), F.col("type")), F.struct("text", "type"))
    nodes = both.groupBy("id", made.alias("made")).agg(
        F.min_by("key", "side").alias("key"),
        F.min(F.struct((-F.col("confidence")).alias("c"), "side", "text")).alias("t"),
        F.min_by("type", "side").alias("type"),
        (F.sum(F.col("confidence") * F.col("n_mentions")) / F.sum("n_mentions")).alias("confidence"),
        F.min(F.struct((-F.length("context")).alias("c"), "side", "context")).alias("x"),
        F.sum("n_mentions").alias("n_mentions"),
        F.min("first").alias("first"),
    )
    nodes = nodes.select("key", "id", F.col("t.text").alias("text"), "type", F.round("confidence", 9).alias("confidence"), F.col("x.context").alias("context"), "n_mentions", "first")
    relations = a.relations.unionByName(b.relations)
    total = a.metadata.get("num_documents", 0) + b.metadata.get("num_documents", 0)
    return Graph(nodes, relations, edges_of(nodes, relations), {"num_documents": total})


def update_graph(graph: Graph, docs: DataFrame) -> Graph:
    return merge_graphs(graph, build_graph(docs))


# Statistics


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, degree (in and out) of every node, isolated ones too."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.select("id").join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def degree_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return degrees(nodes, edges).agg(
        F.round(F.avg("degree"), 6).alias("mean_degree"),
        F.percentile("degree", 0.5).alias("median_degree"),
        F.max("degree").alias("max_degree"),
        F.min("degree").alias("min_degree"),
    )


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """n_nodes, n_edges, density: edges over ordered pairs of nodes, 0 for fewer than two nodes."""
    n, m = nodes.agg(F.count("*").alias("n_nodes")), edges.agg(F.count("*").alias("n_edges"))
    pairs = F.col("n_nodes") * (F.col("n_nodes") - 1)
    # Two tables of one row each.
    return n.join(m).withColumn("density", F.when(F.col("n_nodes") <= 1, 0.0).otherwise(F.round(F.col("n_edges") / pairs, 9)))


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component (its least id). Each round takes the least label around a node, then the label of that label,
    so rounds follow the logarithm of the longest path."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = settled(both.distinct())
    state = settled(nodes.select("id", F.lit(None).cast(nodes.schema["id"].dataType).alias("was"), F.col("id").alias("component")))
    while True:
        labels = state.select("id", "component")
        around = both.join(labels.select(F.col("id").alias("dst"), F.col("component").alias("c")), "dst")
        around = around.groupBy(F.col("src").alias("id")).agg(F.min("c").alias("c"))
        new = labels.join(around, "id", "left").select("id", F.col("component").alias("was"), F.least("component", "c").alias("component"))
        up = new.select(F.col("id").alias("component"), F.col("component").alias("up"))
        new = settled(new.join(up, "component").select("id", "was", F.least("component", "up").alias("component")))
        forget(state)
        state = new
        if new.where("was <> component").isEmpty():
            forget(both)
            return new.select("id", "component")


def is_weakly_connected(nodes: DataFrame, edges: DataFrame) -> bool:
    if nodes.isEmpty():
        raise ValueError("a graph without nodes has no connectivity")
    return weak_components(nodes, edges).select("component").distinct().count() == 1


# Lookups


def query_entities(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes whose text holds the query, in lower case."""
    return nodes.where(F.contains(F.lower("text"), F.lit(query.lower())))


def relations_of_entities(found: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations with one of the found nodes' texts as subject or object: two hash joins instead of a disjunction."""
    texts = found.select("text").distinct()
    one = relations.join(texts.withColumnRenamed("text", "subject"), "subject", "left_semi")
    other = relations.join(texts.withColumnRenamed("text", "object"), "object", "left_semi")
    return one.unionByName(other).distinct()


def query_relations(relations: DataFrame, query: str) -> DataFrame:
    hit = lambda c: F.contains(F.lower(c), F.lit(query.lower()))
    return relations.where(hit("predicate") | hit("subject") | hit("object"))


def simple_paths(edges: DataFrame, starts: DataFrame, ends: DataFrame, cutoff: int = 5) -> DataFrame:
    """path, length (in nodes) of the directed simple paths of at most `cutoff` edges from a start to an end, each a
    table with one column id; a path that ends where it starts is none. Each step joins the edges by their source
    and drops paths that return, so it grows with the number of paths only."""
    hop = edges.select("src", "dst").distinct()
    paths = starts.select(F.array("id").alias("path"), F.col("id").alias("at"))
    out = None
    for _ in range(cutoff):
        paths = paths.join(hop, F.col("at") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        paths = paths.select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("at"))
        here = paths.join(ends.select(F.col("id").alias("at")), "at", "left_semi")
        here = here.select("path", F.size("path").alias("length"))
        out = here if out is None else out.unionByName(here)
    return out


def shortest_paths(edges: DataFrame, starts: DataFrame, max_length: int = 5) -> DataFrame:
    """start, id, hops: breadth-first distances from each start along directed edges, up to max_length. A node is
    expanded once for each start: those reached before leave the frontier."""
    hop = edges.select(F.col("src").alias("id"), "dst").distinct()
    seen = frontier = starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("hops"))
    for i in range(1, max_length + 1):
        new = frontier.join(hop, "id").select("start", F.col("dst").alias("id")).distinct()
        new = new.join(seen.select("start", "id"), ["start", "id"], "left_anti")
        frontier = settled(new.withColumn("hops", F.lit(i)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def multi_hop(edges: DataFrame, starts: DataFrame, chain: list[str | None], max_hops: int = 3) -> DataFrame:
    """start, end, hops: walks from each start whose predicates are the chain (an empty element is any predicate).
    A chain that is empty or longer than max_hops has none."""
    walks = starts.select(F.col("id").alias("start"), F.col("id").alias("end"))
    if not chain or len(chain) > max_hops:
        return walks.limit(0).withColumn("hops", F.lit(0))
    for predicate in chain:
        hop = edges.where(F.col("predicate") == predicate) if predicate else edges
        hop = hop.select(F.col("src").alias("end"), F.col("dst").alias("next"))
        walks = walks.join(hop, "end").select("start", F.col("next").alias("end"))
    return walks.withColumn("hops", F.lit(len(chain)))


def find_paths(edges: DataFrame, pairs: DataFrame, max_length: int = 5, most: int = 10) -> DataFrame:
    """a, b, rank, path (array of src, predicate, dst) for pairs(a, b): the shortest directed path of at most
    max_length edges, of several the one whose edges come first (edge_seq, then dst); where a = b up to `most` cycles,
    the shortest first, each the first path to a node and an edge back.

    Breadth first from all starts at once: a node is expanded once for each start, by its first path, so the frontier
    holds at most a row for each start and node.
    """
    pairs = pairs.select("a", "b").distinct()
    hop = edges.select(
        F.col("src").alias("at"), F.struct("edge_seq", "dst").alias("order"), F.struct("src", "predicate", "dst").alias("edge"), "dst"
    )
    first = pairs.select("a").distinct()
    order, edge = hop.schema["order"].dataType.simpleString(), hop.schema["edge"].dataType.simpleString()
    none = [F.array().cast(f"array<{order}>").alias("orders"), F.array().cast(f"array<{edge}>").alias("path")]
    frontier, seen, found = first.select("a", F.col("a").alias("at"), *none), first.select("a", F.col("a").alias("at")), None
    for _ in range(max_length):
        next_ = frontier.join(hop, "at").select("a", F.col("dst").alias("at"), F.concat("orders", F.array("order")).alias("orders"), F.concat("path", F.array("edge")).alias("path"))
        next_ = settled(next_)
        cycles = next_.where("a = at").select("a", "orders", "path", F.col("a").alias("b"))
        new = next_.join(seen, ["a", "at"], "left_anti").groupBy("a", "at").agg(F.min(F.struct("orders", "path")).alias("p"))
        frontier = settled(new.select("a", "at", "p.orders", "p.path"))
        here = frontier.select("a", "orders", "path", F.col("at").alias("b")).unionByName(cycles).join(pairs, ["a", "b"], "left_semi")
        found = here if found is None else found.unionByName(here)
        seen = seen.unionByName(frontier.select("a", "at"))
        if frontier.isEmpty():
            break
    return ranked(found.withColumn("n_edges", F.size("path")), ["a", "b"], ["n_edges", "orders"], most).select("a", "b", "rank", "path")


def query_paths(nodes: DataFrame, edges: DataFrame, query: str, cutoff: int = 5) -> DataFrame:
    """path_id, length (in nodes), path (array of from, predicate, to, confidence, with the nodes' texts) for a query
    "A -> B": the simple directed paths from the node named A to that named B. A query of another form, or a name that
    no node has, gives none."""
    parts = [x.strip().lower() for x in query.split("->")]
    if len(parts) != 2:
        parts = ["", ""]
        nodes = nodes.limit(0)
    name = F.lower(F.trim("text"))
    end = lambda x: nodes.where(name == x).select("id").limit(1)
    paths = simple_paths(edges, end(parts[0]), end(parts[1]), cutoff).withColumn("path_id", F.array_join("path", ">"))
    steps = paths.select("path_id", "length", F.posexplode(F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("s"), F.slice("path", 2, F.size("path") - 1).alias("d"))).alias("i", "e"))
    steps = steps.select("path_id", "length", "i", F.col("e.s").alias("src"), F.col("e.d").alias("dst")).join(edges.select("src", "dst", "predicate", "confidence"), ["src", "dst"])
    for side, to in (("src", "from"), ("dst", "to")):
        steps = steps.join(nodes.select(F.col("id").alias(side), F.col("text").alias(to)), side)
    step = F.array_sort(F.collect_list(F.struct("i", "from", "predicate", "to", "confidence")))
    drop = lambda s: F.struct(*(s[c].alias(c) for c in ("from", "predicate", "to", "confidence")))
    return steps.groupBy("path_id", "length").agg(F.transform(step, drop).alias("path"))


def entities_with_relations(nodes: DataFrame, relations: DataFrame, query: str) -> DataFrame:
    """id, text, type, subject, predicate, object: a row for each found node and each relation that has its text, as it
    is, as subject or object; one with nulls for a node without any."""
    found = query_entities(nodes, query).select("id", "text", "type")
    rows = relations_of_entities(found, relations).select("doc_id", "seq", "subject", "predicate", "object")
    sides = rows.withColumn("text", F.explode(F.array_distinct(F.array("subject", "object"))))
    return found.join(sides, "text", "left").select("id", "text", "type", "doc_id", "seq", "subject", "predicate", "object")


def query_graph(graph: Graph, query: str, kind: str = "entity") -> DataFrame:
    """The answer of the lookup of this kind: entity, relation or path ("A -> B")."""
    if kind == "entity":
        return entities_with_relations(graph.nodes, graph.relations, query.strip())
    if kind == "relation":
        return query_relations(graph.relations, query.strip())
    if kind == "path":
        return query_paths(graph.nodes, graph.edges, query)
    raise ValueError(f"no queries of kind {kind}")


# Reports


def graph_statistics(nodes: DataFrame, relations: DataFrame, edges: DataFrame) -> DataFrame:
    """statistic, name, value: counts, density, weak connectivity (1 or 0; null for a graph without nodes), histograms
    of types and predicates, and the degrees' mean, median, maximum and minimum. A row for each, so that the table has
    as many rows as there are types and predicates."""
    row = lambda statistic, value, name="": F.struct(F.lit(statistic).alias("statistic"), F.lit(name).alias("name"), value.cast("double").alias("value"))

    def spread(df, *rows):
        return df.select(F.inline(F.array(*rows)))

    parts = weak_components(nodes, edges).agg(F.countDistinct("component").alias("n"))
    degree = degree_statistics(nodes, edges)
    n = F.col("n")
    return (
        spread(density(nodes, edges), row("num_entities", F.col("n_nodes")), row("num_nodes", F.col("n_nodes")), row("num_edges", F.col("n_edges")), row("density", F.col("density")))
        .unionByName(spread(relations.agg(F.count("*").alias("n")), row("num_relations", n)))
        .unionByName(spread(parts, row("is_connected", F.when(n > 0, (n == 1).cast("int")))))
        .unionByName(spread(degree, *(row("degree", F.col(f"{x}_degree"), x) for x in ("mean", "median", "max", "min"))))
        .unionByName(histogram(nodes, "type", "entity_type")).unionByName(histogram(relations, "predicate", "relation_type"))
    )


def histogram(rows: DataFrame, column: str, statistic: str) -> DataFrame:
    return rows.groupBy(F.col(column).alias("name")).agg(F.count("*").cast("double").alias("value")).select(F.lit(statistic).alias("statistic"), "name", "value")


def extraction_statistics(docs: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """statistic, name, value of an extraction: totals, both histograms and the number of documents. The totals are sums
    of the histograms, so each table is read once."""
    kinds, predicates = histogram(entities, "type", "entity_type"), histogram(relations, "predicate", "relation_type")
    total = lambda df, name: df.agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("value")).select(F.lit(name).alias("statistic"), F.lit("").alias("name"), "value")
    both = settled(kinds.unionByName(predicates))
    return (
        both.unionByName(total(both.where("statistic = 'entity_type'"), "total_entities"))
        .unionByName(total(both.where("statistic = 'relation_type'"), "total_relations"))
        .unionByName(docs.agg(F.count("*").cast("double").alias("value")).select(F.lit("documents_processed").alias("statistic"), F.lit("").alias("name"), "value"))
    )
