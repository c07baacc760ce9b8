"""Queries over a graph of the relational tables, vectors, pages and events; with the same in SQL.

Customers and suppliers are located in nations and nations are part of regions; orders are part of customers and
parts part of orders.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import agent, embeddings, graph, reasoning
from graphloom.operators.entities import ranked
from graphloom.plans.text_queries import read
from graphloom.streaming.updates import windowed_counts

PLACES_SQL = """places AS (
  SELECT 'C' || c_custkey AS src, 'N' || c_nationkey AS dst, 'located_in' AS predicate, 0.9::DOUBLE AS confidence FROM customer
  UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, 'located_in', 0.8 FROM supplier
  UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, 'part_of', 1.0 FROM nation
), things AS (
  SELECT 'C' || c_custkey AS id, c_name AS text, 'PERSON' AS type FROM customer UNION ALL SELECT 'S' || s_suppkey, s_name, 'ORG' FROM supplier
  UNION ALL SELECT 'N' || n_nationkey, n_name, 'LOC' FROM nation UNION ALL SELECT 'R' || r_regionkey, r_name, 'LOC' FROM region
)"""


def _id(letter: str, column: str):
    return F.concat(F.lit(letter), F.col(column).cast("string"))


def places(spark, sf_dir) -> DataFrame:
    edge = lambda table, a, b, p, c: read(spark, sf_dir, table).select(_id(*a).alias("src"), _id(*b).alias("dst"), F.lit(p).alias("predicate"), F.lit(c).alias("confidence"))
    return (
        edge("customer", ("C", "c_custkey"), ("N", "c_nationkey"), "located_in", 0.9)
        .unionByName(edge("supplier", ("S", "s_suppkey"), ("N", "s_nationkey"), "located_in", 0.8))
        .unionByName(edge("nation", ("N", "n_nationkey"), ("R", "n_regionkey"), "part_of", 1.0))
    )


def things(spark, sf_dir) -> DataFrame:
    node = lambda table, key, name, kind: read(spark, sf_dir, table).select(_id(*key).alias("id"), F.col(name).alias("text"), F.lit(kind).alias("type"))
    return (
        node("customer", ("C", "c_custkey"), "c_name", "PERSON").unionByName(node("supplier", ("S", "s_suppkey"), "s_name", "ORG"))
        .unionByName(node("nation", ("N", "n_nationkey"), "n_name", "LOC")).unionByName(node("region", ("R", "r_regionkey"), "r_name", "LOC"))
    )


def kg_edges_last_wins(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(
        _id("P", "l_partkey").alias("src"), _id("S", "l_suppkey").alias("dst"), F.concat(F.lit("supplied_"), "l_returnflag").alias("predicate"),
        F.lit(1.0).alias("confidence"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("edge_seq"),
    )
    return graph.last_edges(rows).select("src", "dst", "predicate", "edge_seq")


def kg_degree(spark, sf_dir):
    return graph.degrees(things(spark, sf_dir), places(spark, sf_dir))


def kg_degree_stats(spark, sf_dir):
    return graph.degree_statistics(things(spark, sf_dir), places(spark, sf_dir))


def kg_density(spark, sf_dir):
    return graph.density(things(spark, sf_dir), places(spark, sf_dir))


def kg_weak_components(spark, sf_dir):
    return graph.weak_components(things(spark, sf_dir), places(spark, sf_dir))


def kg_paths_cutoff(spark, sf_dir):
    ids = things(spark, sf_dir)
    found = graph.simple_paths(places(spark, sf_dir), ids.where("type = 'ORG'").select("id"), ids.where("type = 'LOC'").select("id"))
    return found.select(F.array_join("path", ">").alias("path"), "length")


def kg_bfs_shortest(spark, sf_dir):
    return graph.shortest_paths(places(spark, sf_dir), things(spark, sf_dir).where("type = 'PERSON'").select("id"))


def kg_multi_hop(spark, sf_dir):
    starts = things(spark, sf_dir).where("type IN ('PERSON', 'ORG')").select("id")
    return graph.multi_hop(places(spark, sf_dir), starts, ["located_in", "part_of"])


def kg_rule_inference(spark, sf_dir):
    parts = read(spark, sf_dir, "lineitem").select(_id("P", "l_partkey").alias("src"), _id("O", "l_orderkey").alias("dst"), F.lit("part_of").alias("predicate"))
    orders = read(spark, sf_dir, "orders").select(_id("O", "o_orderkey").alias("src"), _id("C", "o_custkey").alias("dst"), F.lit("part_of").alias("predicate"))
    return reasoning.infer(parts.unionByName(orders), spark)


def _questions(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    text = F.concat(F.lit("Where is "), "c_name", F.lit(" in "), "n_name", F.lit("?"))
    return rows.select(F.col("c_custkey").alias("q_id"), text.alias("question"))


QUESTIONS = "q AS (SELECT c_custkey AS q_id, lower('Where is ' || c_name || ' in ' || n_name || '?') AS q FROM customer JOIN nation ON c_nationkey = n_nationkey)"
LINKS = r"""w AS (SELECT *, lower(text) AS low, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS l FROM things),
scored AS (
  SELECT q_id, q, id, text, type, CASE WHEN contains(q, low) THEN 1.0 ELSE round(len(list_filter(l, lambda x: contains(q, x))) / len(l), 9) END AS score FROM q CROSS JOIN w
),
links AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id) AS rank FROM scored WHERE score > 0)"""


def link_entities_topk(spark, sf_dir):
    nodes = things(spark, sf_dir).withColumn("first", F.col("id"))
    return reasoning.link_entities(_questions(spark, sf_dir), nodes)


def answer_question(spark, sf_dir):
    nodes = things(spark, sf_dir).withColumn("first", F.col("id"))
    names = nodes.select("id", "text")
    rows = places(spark, sf_dir).join(names.select(F.col("id").alias("src"), F.col("text").alias("subject")), "src")
    rows = rows.join(names.select(F.col("id").alias("dst"), F.col("text").alias("object")), "dst")
    rows = rows.select("subject", "predicate", "object", F.col("src").alias("doc_id"), F.col("dst").alias("seq"))
    found = reasoning.answer_questions(_questions(spark, sf_dir), nodes, rows)
    return found.select("q_id", "entity", F.array_join("predicates", ",").alias("predicates"), "confidence", "answer")


ANSWERS = f"""WITH {PLACES_SQL}, {QUESTIONS}, {LINKS},
facts AS (SELECT s.text AS subject, o.text AS object, predicate, src, dst FROM places JOIN things s ON s.id = src JOIN things o ON o.id = dst),
sides AS (SELECT subject AS text, predicate, src, dst FROM facts UNION ALL SELECT object, predicate, src, dst FROM facts WHERE object <> subject),
few AS (SELECT text, string_agg(predicate, ',' ORDER BY src, dst) AS predicates FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY src, dst) AS r FROM sides) WHERE r <= 3 GROUP BY text),
step AS (SELECT q_id, first(id ORDER BY rank) AS entity, first(links.text ORDER BY rank) AS text, first(type ORDER BY rank) AS type, first(predicates ORDER BY rank) AS predicates
  FROM links JOIN few ON few.text = links.text WHERE rank <= 2 GROUP BY q_id),
n AS (SELECT q_id, count(*) AS n FROM links WHERE rank <= 3 GROUP BY q_id)
SELECT q_id, CASE WHEN n >= 2 THEN entity END AS entity, CASE WHEN n >= 2 THEN predicates END AS predicates,
  CASE WHEN n >= 2 AND entity IS NOT NULL THEN 0.8 ELSE 0.0 END::DOUBLE AS confidence,
  CASE WHEN n >= 2 AND entity IS NOT NULL THEN 'The answer is ' || text || ' (' || type || ')' ELSE 'no answer' END AS answer
FROM q LEFT JOIN step USING (q_id) LEFT JOIN n USING (q_id)"""


def predict_known_reverse(spark, sf_dir):
    e = places(spark, sf_dir)
    pairs = e.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(e.select(F.col("dst").alias("a"), F.col("src").alias("b")))
    found = reasoning.known_relations(e, pairs.distinct())
    return found.select("a", "b", "predicate", F.round("score", 6).alias("score"))


def _pairs(spark, sf_dir):
    """Each vector with the next one, and types by label."""
    rows = read(spark, sf_dir, "embeddings")
    kinds = F.array(*map(F.lit, ("PERSON", "ORG", "LOC", "CHEM", "MATH")))
    one = rows.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"), F.element_at(kinds, (F.col("label") % 5 + 1).cast("int")).alias("type_a"))
    two = rows.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("y"), F.element_at(kinds, (F.col("label") % 5 + 1).cast("int")).alias("type_b"))
    return one.join(two, "a").select("a", "b", "type_a", "type_b", embeddings.cosine(F.col("x"), F.col("y")).alias("similarity"))


def predict_by_type(spark, sf_dir):
    return reasoning.relations_by_type(_pairs(spark, sf_dir), spark).select("a", "b", "predicate", F.round("score", 7).alias("score"))


COSINE = "list_dot_product(x::DOUBLE[], y::DOUBLE[]) / (sqrt(list_dot_product(x::DOUBLE[], x::DOUBLE[])) * sqrt(list_dot_product(y::DOUBLE[], y::DOUBLE[])))"
BY_TYPE = f"""WITH v AS (SELECT vec_id, embedding, ['PERSON', 'ORG', 'LOC', 'CHEM', 'MATH'][label % 5 + 1] AS type FROM embeddings),
p AS (SELECT a, b, ta, tb, {COSINE} AS similarity FROM (
  SELECT v.vec_id AS a, u.vec_id AS b, v.type AS ta, u.type AS tb, v.embedding AS x, u.embedding AS y FROM v JOIN v u ON u.vec_id = v.vec_id + 1)),
t AS (SELECT * FROM (VALUES ('PERSON', 'ORG', 'works_at', 1.0::DOUBLE), ('ORG', 'PERSON', 'works_at', 1.0), ('PERSON', 'LOC', 'located_in', 1.0),
  ('LOC', 'PERSON', 'located_in', 1.0), ('CHEM', 'CHEM', 'reacts_with', 1.0), ('MATH', 'MATH', 'equals', 1.0), ('MATH', 'MATH', 'greater_than', 0.8)) AS t(x, y, predicate, share))
SELECT a, b, coalesce(predicate, 'related_to') AS predicate, round(similarity * coalesce(share, 0.5::DOUBLE), 7) AS score
FROM p LEFT JOIN t ON t.x = ta AND t.y = tb"""


def predict_relations(spark, sf_dir):
    """Known relations of vectors chained by label, else those of their types."""
    pairs = _pairs(spark, sf_dir)
    edges = pairs.where("similarity > 0.1").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("next_to").alias("predicate"), F.lit(1.0).alias("confidence"))
    return reasoning.predict_relations(pairs, edges, least=0.0).select("a", "b", "predicate", F.round("score", 7).alias("score"), "rank")


def cosine_topk(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return embeddings.similar_nodes(rows, rows.where("id % 20 = 0"))


TOPK = f"""WITH p AS (SELECT t.vec_id AS target, v.vec_id AS id, t.embedding AS x, v.embedding AS y FROM embeddings t JOIN embeddings v ON t.vec_id % 20 = 0 AND v.vec_id <> t.vec_id),
s AS (SELECT target, id, round({COSINE}, 6) AS score FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, id) AS rank FROM s)
SELECT target, id, score, rank FROM r WHERE rank <= 10"""


def _balances(spark, sf_dir):
    money = read(spark, sf_dir, "customer").select(_id("C", "c_custkey").alias("id"), F.array(F.col("c_acctbal"), F.lit(1.0)).alias("vec"))
    more = read(spark, sf_dir, "supplier").select(_id("S", "s_suppkey").alias("id"), F.array(F.col("s_acctbal"), F.lit(1.0)).alias("vec"))
    rest = things(spark, sf_dir).where("type = 'LOC'").select("id", F.array(F.lit(0.0), F.lit(1.0)).alias("vec"))
    return money.unionByName(more).unionByName(rest)


#: Weights of the layers, of two components each; irrational ones keep rounded results away from ties.
W, B = np.array([[0.5, -0.5], [0.125, 2.0]]), np.array([1.0, -3.0])
OWN, NEAR, LAST = np.diag([0.7071067811865476, 1.0]), np.diag([0.5773502691896258, 1.0]), np.array([[1.0, 0.0], [-0.5, 1.0], [0.5, 0.25], [0.0, 1.0]])


def _layer(how: str):
    def query(spark, sf_dir):
        around, x = embeddings.neighbours(things(spark, sf_dir), places(spark, sf_dir)), _balances(spark, sf_dir)
        found = embeddings.gcn_layer(x, around, W, B) if how == "sum" else embeddings.sage_layer(x, around, OWN, NEAR, LAST, how)
        return found.select("id", F.round(F.element_at("vec", 1), 3).alias("x0"), F.round(F.element_at("vec", 2), 3).alias("x1"))

    of = {"sum": "sum", "mean": "avg", "max": "max"}[how]
    relu = lambda x: f"round(greatest({x}, 0.0), 3)"
    out = ("n0 * 0.5 + n1 * 0.125 + 1", "n1 * 2 - n0 * 0.5 - 3") if how == "sum" else (
        "x0 * 0.7071067811865476::DOUBLE - x1 * 0.5 + n0 * 0.5773502691896258::DOUBLE * 0.5", "x1 + n0 * 0.5773502691896258::DOUBLE * 0.25 + n1"
    )
    sql = f"""WITH {PLACES_SQL}, f AS (
  SELECT 'C' || c_custkey AS id, c_acctbal::DOUBLE AS x0, 1.0::DOUBLE AS x1 FROM customer UNION ALL SELECT 'S' || s_suppkey, s_acctbal, 1.0 FROM supplier
  UNION ALL SELECT id, 0.0, 1.0 FROM things WHERE type = 'LOC'
), around AS (SELECT src, dst FROM places UNION SELECT dst, src FROM places UNION SELECT id, id FROM things),
near AS (SELECT dst AS id, {of}(x0) AS n0, {of}(x1) AS n1 FROM around JOIN f ON f.id = src GROUP BY dst)
SELECT id, {relu(out[0])} AS x0, {relu(out[1])} AS x1 FROM near JOIN f USING (id)"""
    return query, sql


# A graph with cycles: each nation with the two others that it buys most from; regions are nodes without edges


def trade(spark, sf_dir) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    volume = rows.where("c_nationkey <> s_nationkey").groupBy(F.col("c_nationkey").alias("a"), F.col("s_nationkey").alias("b")).agg(F.count("*").alias("n"))
    best = ranked(volume, ["a"], [F.desc("n"), "b"], 2)
    name = F.when(F.col("rank") == 1, "buys_from").otherwise("trades_with")
    edges = best.select(_id("N", "a").alias("src"), _id("N", "b").alias("dst"), name.alias("predicate"), (1 / F.col("rank")).alias("confidence"), F.col("rank").cast("long").alias("edge_seq"))
    return graph.settled(edges)


def _nations(spark, sf_dir) -> DataFrame:
    return things(spark, sf_dir).where("type = 'LOC'")


def trade_components(spark, sf_dir):
    return graph.weak_components(_nations(spark, sf_dir), trade(spark, sf_dir).where("edge_seq = 1"))


def trade_reach(spark, sf_dir):
    return graph.shortest_paths(trade(spark, sf_dir), _nations(spark, sf_dir).select("id"))


def trade_paths(spark, sf_dir):
    ids = read(spark, sf_dir, "nation")
    starts, ends = ids.where("n_nationkey % 2 = 0").select(_id("N", "n_nationkey").alias("id")), ids.where("n_nationkey % 3 = 0").select(_id("N", "n_nationkey").alias("id"))
    return graph.simple_paths(trade(spark, sf_dir), starts, ends).select(F.array_join("path", ">").alias("path"), "length")


def reasoning_paths(spark, sf_dir):
    """Between all nations, each with itself too: 25 x 25 stated pairs."""
    ids = graph.settled(read(spark, sf_dir, "nation").select(_id("N", "n_nationkey").alias("a")))
    found = graph.find_paths(trade(spark, sf_dir), ids.join(F.broadcast(ids.select(F.col("a").alias("b")))))
    text = F.array_join(F.transform("path", lambda e: F.concat_ws(">", e["src"], e["predicate"], e["dst"])), ",")
    return found.select("a", "b", "rank", text.alias("path"))


def kg_query_path(spark, sf_dir):
    """From the first nation that trades to the one that it buys most from."""
    nodes, edges = _nations(spark, sf_dir), trade(spark, sf_dir)
    first = edges.where("edge_seq = 1").orderBy("src").limit(1)
    for side in ("src", "dst"):
        first = first.join(nodes.select(F.col("id").alias(side), F.col("text").alias(f"{side}_text")), side)
    one = first.first()
    query = f" {one.src_text.lower()} -> {one.dst_text}" if one else ""
    found = graph.query_graph(graph.Graph(nodes, None, edges), query, "path")
    text = F.array_join(F.transform("path", lambda e: F.concat_ws(">", e["from"], e["predicate"], e["to"], F.format_string("%.2f", e["confidence"]))), ",")
    return found.select(text.alias("path"), "length")


def _facts(spark, sf_dir) -> DataFrame:
    names = things(spark, sf_dir).select("id", "text")
    rows = places(spark, sf_dir).join(names.select(F.col("id").alias("src"), F.col("text").alias("subject")), "src")
    rows = rows.join(names.select(F.col("id").alias("dst"), F.col("text").alias("object")), "dst")
    return rows.select(F.col("src").alias("doc_id"), F.col("dst").alias("seq"), "subject", "predicate", "object", "confidence")


def kg_query_graph(spark, sf_dir):
    found = graph.query_graph(graph.Graph(things(spark, sf_dir), _facts(spark, sf_dir), places(spark, sf_dir)), "ia", "entity")
    return found.select("id", "text", "subject", "predicate", "object")


def kg_statistics(spark, sf_dir):
    found = graph.graph_statistics(things(spark, sf_dir), _facts(spark, sf_dir), places(spark, sf_dir))
    return found.select("statistic", "name", F.round("value", 6).alias("value"))


def trade_statistics(spark, sf_dir):
    edges = trade(spark, sf_dir)
    return graph.graph_statistics(_nations(spark, sf_dir), edges, edges).select("statistic", "name", F.round("value", 6).alias("value"))


def statistics_sql(nodes: str, relations: str, edges: str) -> str:
    return f"""d AS (SELECT n.id, count(e.id) AS degree FROM {nodes} n LEFT JOIN (SELECT src AS id FROM {edges} UNION ALL SELECT dst FROM {edges}) e USING (id) GROUP BY 1),
both_ways AS (SELECT src, dst FROM {edges} UNION SELECT dst, src FROM {edges}),
reached(id) AS (SELECT min(id) FROM {nodes} UNION SELECT dst FROM reached JOIN both_ways ON src = id),
counts AS (SELECT (SELECT count(*) FROM {nodes})::DOUBLE AS n, (SELECT count(*) FROM {edges})::DOUBLE AS m, (SELECT count(*) FROM {relations})::DOUBLE AS r)
SELECT unnest(['num_entities', 'num_nodes', 'num_edges', 'num_relations', 'density']) AS statistic, '' AS name, unnest([n, n, m, r, round(m / (n * (n - 1)), 6)]) AS value FROM counts
UNION ALL SELECT 'is_connected', '', ((SELECT count(*) FROM reached) = (SELECT count(*) FROM {nodes}))::INT::DOUBLE
UNION ALL SELECT 'degree', unnest(['mean', 'median', 'max', 'min']), unnest([round(avg(degree), 6), quantile_cont(degree, 0.5)::DOUBLE, max(degree)::DOUBLE, min(degree)::DOUBLE]) FROM d
UNION ALL SELECT 'entity_type', type, count(*)::DOUBLE FROM {nodes} GROUP BY type
UNION ALL SELECT 'relation_type', predicate, count(*)::DOUBLE FROM {relations} GROUP BY predicate"""


def next_entity(spark, sf_dir):
    """Of every question's links some are visited: none, one, two, and so on up to all five."""
    links = graph.settled(link_entities_topk(spark, sf_dir))
    visited = links.where(F.col("rank") <= F.col("q_id") % 6).select("q_id", "id", F.col("rank").alias("step"))
    similar = places(spark, sf_dir).select(F.col("src").alias("target"), F.col("dst").alias("id"), F.lit(1).alias("rank"))
    return reasoning.next_entities(visited, links, similar)


def knowledge_report(spark, sf_dir):
    nodes = things(spark, sf_dir).withColumn("first", F.col("id"))
    return reasoning.knowledge_report(_questions(spark, sf_dir), nodes, _facts(spark, sf_dir), places(spark, sf_dir))


def node_embeddings(spark, sf_dir):
    """Seeded layers over the places; has no form in SQL."""
    config = embeddings.EmbeddingConfig(input_dim=8, hidden_dim=8, output_dim=4, num_layers=2)
    return embeddings.generate_embeddings(things(spark, sf_dir), places(spark, sf_dir), config)


def doc_paragraphs(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select("page_id", F.posexplode(agent.paragraphs(F.col("html"))).alias("paragraph_id", "paragraph"))
    return rows


PARAGRAPHS = r"""WITH p AS (SELECT page_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[\s\x0b]+', ' ', 'g'), '\.'), lambda x: trim(x)), lambda x: length(x) > 20) AS l FROM pages)
SELECT page_id, generate_subscripts(l, 1) - 1 AS paragraph_id, unnest(l) AS paragraph FROM p"""


def extract_between(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", agent.between(F.col("html"), "<p>", "</p>").alias("found"))


def url_anti_join(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return agent.not_cached(rows, rows.where(F.contains("html", F.lit("<table")))).select("page_id", "url")


def repeat_query_flag(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(
        F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"),
        F.when(F.col("value") < 5, F.col("event_type")).otherwise(F.concat(F.lit("so " + agent.BEGIN), "event_type", F.lit(agent.END))).alias("text"),
    )
    return agent.decide_turns(rows, 3)


REPEATS = """WITH t AS (SELECT user_id AS conv_id, event_id AS turn, CASE WHEN value < 5 THEN NULL ELSE event_type END AS query, coalesce(value >= 5, true) AS asks FROM events),
u AS (SELECT conv_id, turn, CASE WHEN asks THEN query END AS query, asks, asks AND row_number() OVER (PARTITION BY conv_id, query, asks ORDER BY turn) = 1 AS new FROM t),
v AS (SELECT *, coalesce(sum(new::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS searches FROM u)
SELECT conv_id, turn, query, CASE WHEN NOT asks THEN 'finished' WHEN searches >= 3 THEN 'limit' WHEN new THEN 'search' ELSE 'repeat' END AS action FROM v"""


def topk_hits(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), "o_orderkey", F.struct(-F.col("o_totalprice"), "o_orderkey").alias("hit_rank"))
    return agent.top_hits(rows, 3).select("query_id", "o_orderkey", "rank")


def compress_reasoning(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", agent.compressed(F.col("text")).alias("text"))


def event_windows(spark, sf_dir):
    return windowed_counts(read(spark, sf_dir, "events"))


TRADE = f"""{PLACES_SQL}, volume AS (
  SELECT c_nationkey AS a, s_nationkey AS b, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey GROUP BY 1, 2
), trade AS (
  SELECT 'N' || a AS src, 'N' || b AS dst, CASE WHEN r = 1 THEN 'buys_from' ELSE 'trades_with' END AS predicate, (1 / r)::DOUBLE AS confidence, r AS edge_seq
  FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r FROM volume) WHERE r <= 2
), spots AS (SELECT * FROM things WHERE type = 'LOC'), nations AS (SELECT 'N' || n_nationkey AS id, n_nationkey AS k, n_name FROM nation)"""
TRADE_COMPONENTS = f"""WITH RECURSIVE {TRADE}, e AS (SELECT src, dst FROM trade WHERE edge_seq = 1 UNION SELECT dst, src FROM trade WHERE edge_seq = 1),
w(id, other) AS (SELECT id, id FROM spots UNION SELECT w.id, dst FROM w JOIN e ON src = other) SELECT id, min(other) AS component FROM w GROUP BY id"""
TRADE_REACH = f"""WITH RECURSIVE {TRADE}, w(start, id, hops) AS (SELECT id, id, 0::BIGINT FROM spots UNION SELECT start, dst, hops + 1 FROM w JOIN trade ON src = id WHERE hops < 5)
SELECT start, id, min(hops) AS hops FROM w GROUP BY 1, 2"""
SIMPLE = "w(path, here) AS (SELECT [id], id FROM nations {start} UNION ALL SELECT list_append(path, dst), dst FROM w JOIN trade ON src = here WHERE len(path) <= 5 AND NOT list_contains(path, dst))"
TRADE_PATHS = f"""WITH RECURSIVE {TRADE}, {SIMPLE.format(start='WHERE k % 2 = 0')}
SELECT array_to_string(path, '>') AS path, len(path) AS length FROM w WHERE len(path) > 1 AND here IN (SELECT id FROM nations WHERE k % 3 = 0)"""
QUERY_PATH = f"""WITH RECURSIVE {TRADE}, {SIMPLE.format(start='WHERE id = (SELECT min(src) FROM trade)')},
found AS (SELECT path, unnest(range(1, len(path))) AS i FROM w WHERE here = (SELECT arg_min(dst, src) FROM trade WHERE edge_seq = 1)),
steps AS (SELECT path, i, s.text || '>' || predicate || '>' || o.text || '>' || printf('%.2f', confidence) AS step
  FROM found JOIN trade ON src = path[i] AND dst = path[i + 1] JOIN things s ON s.id = src JOIN things o ON o.id = dst)
SELECT string_agg(step, ',' ORDER BY i) AS path, len(path) AS length FROM steps GROUP BY steps.path"""
REASONING_PATHS = f"""WITH RECURSIVE {TRADE}, w(a, here, n, orders, path) AS (
  SELECT id, id, 0, []::BIGINT[], []::VARCHAR[] FROM nations
  UNION ALL SELECT a, dst, n + 1, list_append(orders, edge_seq), list_append(path, src || '>' || predicate || '>' || dst) FROM w JOIN trade ON src = here WHERE n < 5),
first AS (SELECT * FROM w WHERE n = 0 OR here <> a QUALIFY row_number() OVER (PARTITION BY a, here ORDER BY n, orders) = 1),
cycles AS (SELECT a, n + 1 AS n, list_append(orders, edge_seq) AS orders, list_append(path, src || '>' || predicate || '>' || dst) AS path FROM first JOIN trade ON src = here AND dst = a WHERE n < 5)
SELECT a, here AS b, 1::BIGINT AS rank, array_to_string(path, ',') AS path FROM first WHERE n > 0
UNION ALL SELECT a, a, row_number() OVER (PARTITION BY a ORDER BY n, orders) AS rank, array_to_string(path, ',') FROM cycles QUALIFY rank <= 10"""
FACTS = "facts AS (SELECT s.text AS subject, o.text AS object, predicate FROM places JOIN things s ON s.id = src JOIN things o ON o.id = dst)"
QUERY_GRAPH = f"""WITH {PLACES_SQL}, {FACTS}, found AS (SELECT id, text FROM things WHERE contains(lower(text), 'ia'))
SELECT id, text, subject, predicate, object FROM found LEFT JOIN facts ON subject = text OR object = text"""
NEXT = f"""WITH {PLACES_SQL}, {QUESTIONS}, {LINKS}, top AS (SELECT * FROM links WHERE rank <= 5), visited AS (SELECT * FROM top WHERE rank <= q_id % 6),
new AS (SELECT q_id, arg_min(id, rank) AS id FROM top WHERE rank > q_id % 6 GROUP BY q_id),
last AS (SELECT q_id, arg_max(id, rank) AS target FROM visited WHERE q_id NOT IN (SELECT q_id FROM new) GROUP BY q_id)
SELECT q_id, id FROM new UNION ALL SELECT l.q_id, dst FROM last l JOIN places ON src = target WHERE NOT EXISTS (SELECT 1 FROM visited v WHERE v.q_id = l.q_id AND v.id = dst)"""
REPORT = f"""WITH {PLACES_SQL}, answers AS ({ANSWERS}),
asked AS (SELECT c_custkey AS q_id, 'Where is ' || c_name || ' in ' || n_name || '?' AS question FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT q_id, 'Question: ' || question || chr(10) || 'Answer: ' || answer || chr(10) || 'Confidence: ' || printf('%.2f', confidence)
  || coalesce(chr(10) || 'Step 1: ' || text || ' (' || replace(predicates, ',', ', ') || ')', '') || chr(10)
  || (SELECT count(*) FROM things) || ' entities, ' || (SELECT count(*) FROM places) || ' relations, ' || (SELECT count(*) FROM places) || ' edges' AS report
FROM answers JOIN asked USING (q_id) LEFT JOIN things ON id = entity"""
PREDICTED = f"""WITH typed AS ({BY_TYPE}), raw AS (SELECT a, b, {COSINE} AS similarity FROM (
  SELECT v.vec_id AS a, u.vec_id AS b, v.embedding AS x, u.embedding AS y FROM embeddings v JOIN embeddings u ON u.vec_id = v.vec_id + 1)),
both_kinds AS (SELECT a, b, 'next_to' AS predicate, 1.0::DOUBLE AS score FROM raw WHERE similarity > 0.1
  UNION ALL SELECT a, b, predicate, score FROM typed JOIN raw USING (a, b) WHERE similarity > 0 AND similarity <= 0.1)
SELECT a, b, predicate, score, row_number() OVER (PARTITION BY a, b ORDER BY score DESC, predicate) AS rank FROM both_kinds QUALIFY rank <= 5"""
COMPRESSED = r"""WITH p AS (SELECT conv_id, turn, list_transform(string_split(text, chr(10)), lambda s, i: 'Step ' || i || ': ' || s) AS l FROM conversations),
k AS (SELECT conv_id, turn, l, list_transform(l, lambda s, i: len(l) <= 5 OR i = 1 OR i > len(l) - 4 OR contains(s, '<|begin_search_query|>') OR contains(s, '<|end_search_query|>')) AS kept FROM p)
SELECT conv_id, turn, array_to_string(list_filter(list_transform(l, lambda s, i: CASE WHEN kept[i] THEN s WHEN kept[i - 1] THEN '...' END), lambda s: s IS NOT NULL), chr(10) || chr(10)) AS text FROM k"""

EDGE_STATS = f"WITH {PLACES_SQL}, ends AS (SELECT src AS id FROM places UNION ALL SELECT dst FROM places), d AS (SELECT things.id, count(ends.id) AS degree FROM things LEFT JOIN ends USING (id) GROUP BY 1) "
REGIONS = f"""WITH {PLACES_SQL}, up AS (
  SELECT id, id AS region FROM things WHERE id LIKE 'R%' UNION ALL SELECT src, dst FROM places WHERE src LIKE 'N%'
  UNION ALL SELECT a.src, b.dst FROM places a JOIN places b ON b.src = a.dst WHERE a.src NOT LIKE 'N%')
SELECT id, min(id) OVER (PARTITION BY region) AS component FROM up"""

FOUND = {
    "kg_edges_last_wins": (
        kg_edges_last_wins,
        "SELECT 'P' || l_partkey AS src, 'S' || l_suppkey AS dst, arg_max('supplied_' || l_returnflag, l_orderkey * 100 + l_linenumber) AS predicate, max(l_orderkey * 100 + l_linenumber) AS edge_seq FROM lineitem GROUP BY 1, 2",
    ),
    "kg_degree": (kg_degree, EDGE_STATS + "SELECT * FROM d"),
    "kg_degree_stats": (
        kg_degree_stats,
        EDGE_STATS + "SELECT round(avg(degree), 6) AS mean_degree, quantile_cont(degree, 0.5)::DOUBLE AS median_degree, max(degree) AS max_degree, min(degree) AS min_degree FROM d",
    ),
    "kg_density": (
        kg_density,
        f"WITH {PLACES_SQL}, n AS (SELECT count(*) AS n_nodes FROM things), m AS (SELECT count(*) AS n_edges FROM places) SELECT n_nodes, n_edges, round(n_edges / (n_nodes * (n_nodes - 1)), 9) AS density FROM n, m",
    ),
    "kg_weak_components": (kg_weak_components, REGIONS),
    "kg_paths_cutoff": (
        kg_paths_cutoff,
        f"WITH {PLACES_SQL} SELECT src || '>' || dst AS path, 2::BIGINT AS length FROM places WHERE src LIKE 'S%' UNION ALL SELECT a.src || '>' || a.dst || '>' || b.dst, 3 FROM places a JOIN places b ON b.src = a.dst WHERE a.src LIKE 'S%'",
    ),
    "kg_bfs_shortest": (
        kg_bfs_shortest,
        f"WITH {PLACES_SQL} SELECT id AS start, id, 0::BIGINT AS hops FROM things WHERE type = 'PERSON' UNION ALL SELECT src, dst, 1 FROM places WHERE src LIKE 'C%' UNION ALL SELECT a.src, b.dst, 2 FROM places a JOIN places b ON b.src = a.dst WHERE a.src LIKE 'C%'",
    ),
    "kg_multi_hop": (kg_multi_hop, f'WITH {PLACES_SQL} SELECT a.src AS start, b.dst AS "end", 2::BIGINT AS hops FROM places a JOIN places b ON b.src = a.dst'),
    "kg_rule_inference": (
        kg_rule_inference,
        "SELECT DISTINCT 'P' || l_partkey AS src, 'C' || o_custkey AS dst, 'part_of' AS predicate, 'transitivity' AS rule FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    ),
    "link_entities_topk": (link_entities_topk, f"WITH {PLACES_SQL}, {QUESTIONS}, {LINKS} SELECT q_id, id, score::DOUBLE AS score, rank FROM links WHERE rank <= 5"),
    "answer_question": (answer_question, ANSWERS),
    "predict_known_reverse": (
        predict_known_reverse,
        f"WITH {PLACES_SQL} SELECT src AS a, dst AS b, predicate, confidence AS score FROM places UNION ALL SELECT dst, src, 'reverse_' || predicate, round(confidence * 0.8::DOUBLE, 6) FROM places",
    ),
    "predict_by_type": (predict_by_type, BY_TYPE),
    "predict_relations": (predict_relations, PREDICTED),
    "cosine_topk": (cosine_topk, TOPK),
    "gcn_sum_layer": _layer("sum"),
    "sage_mean_layer": _layer("mean"),
    "sage_max_layer": _layer("max"),
    "node_embeddings": (node_embeddings, None),
    "doc_paragraphs": (doc_paragraphs, PARAGRAPHS),
    "extract_between": (extract_between, "SELECT page_id, CASE WHEN len(l) > 0 THEN trim(l[-1]) END AS found FROM (SELECT page_id, regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1) AS l FROM pages)"),
    "url_anti_join": (url_anti_join, "SELECT page_id, url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE contains(html, '<table'))"),
    "repeat_query_flag": (repeat_query_flag, REPEATS),
    "topk_hits": (topk_hits, "SELECT o_custkey AS query_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY -o_totalprice, o_orderkey) AS rank FROM orders QUALIFY rank <= 3"),
    "compress_reasoning": (compress_reasoning, COMPRESSED),
    "event_windows": (event_windows, "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"),
    "trade_components": (trade_components, TRADE_COMPONENTS),
    "trade_reach": (trade_reach, TRADE_REACH),
    "trade_paths": (trade_paths, TRADE_PATHS),
    "reasoning_paths": (reasoning_paths, REASONING_PATHS),
    "kg_query_path": (kg_query_path, QUERY_PATH),
    "kg_query_graph": (kg_query_graph, QUERY_GRAPH),
    "kg_statistics": (kg_statistics, f"WITH RECURSIVE {PLACES_SQL}, {FACTS}, {statistics_sql('things', 'facts', 'places')}"),
    "trade_statistics": (trade_statistics, f"WITH RECURSIVE {TRADE}, {statistics_sql('spots', 'trade', 'trade')}"),
    "next_entity": (next_entity, NEXT),
    "knowledge_report": (knowledge_report, REPORT),
}
