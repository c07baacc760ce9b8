"""Graph operators on small graphs with cycles, diamonds, parallel edges and isolated nodes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import agent, embeddings, graph, reasoning
from graphloom.operators import alignment as al
from graphloom.operators.entities import ranked
from graphloom.sources.datasets import dataset_path, read_questions
from graphloom.sources.storage import storage
from graphloom.streaming.updates import GraphStream

EDGES = [("a", "b", "is_a"), ("b", "c", "is_a"), ("a", "c", "causes"), ("c", "a", "part_of"), ("c", "d", "is_a"), ("x", "y", "causes")]


@pytest.fixture()
def edges(spark):
    return spark.createDataFrame([(*e, 0.5, i) for i, e in enumerate(EDGES)], "src string, dst string, predicate string, confidence double, edge_seq long")


@pytest.fixture()
def nodes(spark):
    return spark.createDataFrame([(c, c.upper(), "ORG", i) for i, c in enumerate("abcdxyz")], "id string, text string, type string, first long")


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_last_edge_wins(spark):
    rows = spark.createDataFrame([("a", "b", "p", 0.1, 1), ("a", "b", "q", 0.2, 3), ("a", "b", "r", 0.3, 2)], "src string, dst string, predicate string, confidence double, edge_seq long")
    assert [(r.predicate, r.edge_seq) for r in graph.last_edges(rows).collect()] == [("q", 3)]


def test_components_and_statistics(spark, nodes, edges):
    found = {r.id: r.component for r in graph.weak_components(nodes, edges).collect()}
    assert found == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x", "z": "z"}
    assert not graph.is_weakly_connected(nodes, edges)
    assert {r.id: r.degree for r in graph.degrees(nodes, edges).collect()}["z"] == 0
    assert graph.density(nodes, edges).first().density == round(6 / 42, 9)
    with pytest.raises(ValueError):
        graph.is_weakly_connected(nodes.limit(0), edges)


def test_paths(spark, edges):
    found = sorted((tuple(r.path), r.length) for r in graph.simple_paths(edges, ids(spark, "a"), ids(spark, "d")).collect())
    assert found == [(("a", "b", "c", "d"), 4), (("a", "c", "d"), 3)]
    assert graph.simple_paths(edges, ids(spark, "a"), ids(spark, "a")).count() == 0
    hops = {r.id: r.hops for r in graph.shortest_paths(edges, ids(spark, "a")).collect()}
    assert hops == {"a": 0, "b": 1, "c": 1, "d": 2}


def test_multi_hop(spark, edges):
    walk = lambda chain, most=3: sorted(r.end for r in graph.multi_hop(edges, ids(spark, "a"), chain, most).collect())
    assert walk(["is_a", "is_a"]) == ["c"]
    assert walk([None, "part_of"]) == ["a"]
    assert walk([]) == [] and walk(["is_a"] * 4) == []


def test_rules_and_predictions(spark, edges):
    new = {(r.src, r.dst, r.predicate) for r in reasoning.infer(edges, spark).collect()}
    assert {("a", "c", "is_a"), ("b", "d", "is_a")} <= new
    pairs = spark.createDataFrame([("a", "b", "PERSON", "ORG", 0.9), ("d", "b", "LOC", "PERSON", 0.8), ("d", "x", "MATH", "MATH", 0.7), ("y", "z", "ORG", "ORG", 0.6), ("y", "a", "ORG", "ORG", 0.1)], "a string, b string, type_a string, type_b string, similarity double")
    got = {(r.a, r.b, r.predicate): r.score for r in reasoning.predict_relations(pairs, edges).collect()}
    assert got == {("a", "b", "is_a"): 0.5, ("d", "b", "located_in"): 0.8, ("d", "x", "equals"): 0.7, ("d", "x", "greater_than"): 0.56, ("y", "z", "related_to"): 0.3}


def test_answers(spark):
    nodes = spark.createDataFrame([("1", "Paris University", "ORG", 1), ("2", "Marie Curie", "PERSON", 2), ("3", "lonely", "CONCEPT", 3)], "id string, text string, type string, first long")
    relations = spark.createDataFrame([(1, 1, "Marie Curie", "works_at", "Paris University")], "doc_id long, seq long, subject string, predicate string, object string")
    questions = spark.createDataFrame([(1, "Where did Marie Curie and Paris University meet?"), (2, "How is Marie Curie of Paris University?"), (3, "lonely?"), (4, "Marie Curie, Paris University")], "q_id long, question string")
    got = {r.q_id: r for r in reasoning.answer_questions(questions, nodes, relations).collect()}
    assert got[1].answer == "The answer is Paris University (ORG)" and got[1].confidence == 0.8
    assert got[2].answer.startswith("Because of") and got[4].answer.startswith("Confidence")
    assert got[3].answer == "no answer" and got[3].confidence == 0.0
    links = reasoning.link_entities(questions, nodes).where("q_id = 3").collect()
    assert [(r.id, r.score) for r in links] == [("3", 1.0)]


def test_embeddings(spark, nodes, edges):
    around = embeddings.neighbours(nodes, edges)
    x = spark.createDataFrame([(c, [float(i), 1.0]) for i, c in enumerate("abcdxyz")], "id string, vec array<double>")
    got = {r.id: list(r.vec) for r in embeddings.aggregated(x, around).collect()}
    assert got["a"] == [0 + 1 + 2, 3.0] and got["z"] == [6.0, 1.0]
    w = np.array([[1.0, -1.0], [0.5, 0.0]])
    layer = {r.id: list(r.vec) for r in embeddings.gcn_layer(x, around, w, np.array([0.0, 1.0])).collect()}
    assert layer["a"] == [4.5, 0.0]
    heads = {r.id: list(r.vec) for r in embeddings.gat_layer(x, around, np.eye(2), np.zeros(4)).collect()}
    assert np.allclose(heads["a"], [1.0, 1.0])
    a = embeddings.generate_embeddings(nodes, edges, embeddings.EmbeddingConfig(hidden_dim=4, output_dim=2, num_layers=1)).orderBy("id").collect()
    b = embeddings.generate_embeddings(nodes.repartition(3), edges, embeddings.EmbeddingConfig(hidden_dim=4, output_dim=2, num_layers=1)).orderBy("id").collect()
    assert np.allclose([r.vec for r in a], [r.vec for r in b])
    trained = embeddings.train_embeddings(list("abcd"), [("a", "b"), ("c", "d")])
    assert trained["a"] @ trained["b"] > trained["a"] @ trained["c"]


def test_alignment(spark):
    rows = al.segment_rows(spark.createDataFrame([(1, "One two three. Four five!  Six"), (2, "a lone sentence."), (3, "x; y"), (4, "")], "doc_id long, text string"))
    assert sorted((r.doc_id, r.segment) for r in rows.collect()) == [(1, "Four five"), (1, "One two three"), (1, "Six"), (2, "a lone sentence."), (3, "x"), (3, "y")]
    long = "abcdefghij klmnopqrst uvwxyz"
    seg = spark.createDataFrame([(1, 0, long), (1, 1, long[1:]), (2, 0, "abcdefghijk")], "doc_id long, segment_id int, segment string")
    own = spark.createDataFrame([(7, long), (8, long[:-1]), (9, "abcdefghij")], "id long, text string")
    got = {(r.doc_id, r.segment_id, r.id) for r in al.align_exact(seg, own).collect()}
    assert got == {(1, 0, 7), (1, 0, 8), (1, 1, 7), (2, 0, 9)}


def test_agent(spark):
    ask = lambda q: f"so {agent.BEGIN}{q}{agent.END}"
    turns = spark.createDataFrame([(1, 0, ask("x")), (1, 1, ask("x")), (1, 2, ask("y")), (1, 3, ask("z")), (1, 4, "done")], "conv_id long, turn long, text string")
    assert [r.action for r in agent.decide_turns(turns, 2).orderBy("turn").collect()] == ["search", "repeat", "search", "limit", "finished"]
    assert agent.compress_reasoning("a\nb").endswith("Step 2: b")
    assert agent.compress_reasoning("\n".join("abcdefgh")).count("...") == 1
    questions = spark.createDataFrame([(1, "q1"), (2, "q2")], "conv_id long, question string")
    from pyspark.sql import functions as F

    said = lambda live: live.withColumn("text", F.when(F.contains("output", F.lit("hit")), "done").otherwise(F.lit(ask("x"))))
    out = agent.run_loop(questions, said, lambda q: q.withColumn("found", F.lit("hit"))).collect()
    assert all(r.finished and r.output.endswith("done") for r in out)


DOCS = [(1, "Marie Curie works at Paris University. Information is a concept."), (2, "Paris University is located in France City. Marie Curie"), (3, None)]


@pytest.mark.parametrize("kind", ["parquet", "json", "graphml"])
def test_storage_round_trip(spark, tmp_path, kind):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    g = graph.build_graph(docs)
    store = storage(kind, spark, str(tmp_path))
    store.save(g, "one")
    back = store.load("one")
    for t in ("nodes", "relations", "edges"):
        assert sorted(map(str, getattr(back, t).collect())) == sorted(map(str, getattr(g, t).collect()))
    assert back.metadata == {"num_documents": 3} and store.names() == ["one"]
    if kind == "graphml":
        nodes, edges = store.read_graphml("one")
        assert nodes.count() == g.nodes.count() and edges.count() == g.edges.count()
    assert store.delete("one") and not store.delete("one")
    with pytest.raises(ValueError):
        storage("pickle", spark, str(tmp_path))


@pytest.mark.parametrize("asked", [1 << 14, 7])
def test_similar_nodes_equal_all_pairs_without_joining_them(spark, monkeypatch, asked):
    monkeypatch.setattr(embeddings, "ASKED", asked)
    monkeypatch.setattr(embeddings, "SCORES", 1000)
    rng = np.random.default_rng(5)
    some = [rng.integers(-3, 4, 6).astype(float).tolist() for _ in range(200)]
    odd = [None, [], [None] * 6, [1.0, None, 2.0, 0.0, 0.0, 1.0], [0.0] * 6, [1.0, 2.0], [3.0, 4.0], [float("nan")] * 6, [float("inf"), *[1.0] * 5], [1e-200] * 6, [1e200] * 6, [1e-90] * 6]
    rows = [(i, v) for i, v in enumerate([*some, *[some[3]] * 30, *odd])] + [(0, some[1]), (None, some[2])]
    vectors = spark.createDataFrame(rows, "id long, vec array<double>").repartition(3)
    targets = vectors.where("id % 5 = 0 or id > 225")
    got = embeddings.similar_nodes(vectors, targets, 4)
    assert not any(x in got._jdf.queryExecution().toString() for x in ("NestedLoop", "Cartesian"))
    pairs = vectors.crossJoin(targets.select(F.col("id").alias("target"), F.col("vec").alias("t"))).where("id <> target")
    pairs = pairs.select("target", "id", F.round(embeddings.cosine(F.col("vec"), F.col("t")), 6).alias("score"))
    expected = ranked(pairs, ["target"], [F.desc("score"), "id"], 4)
    rows_of = lambda df: sorted(map(repr, df.select("target", "rank", "id", "score").collect()))
    assert rows_of(got) == rows_of(expected)
    named = lambda df: df.withColumn("id", F.format_string("é%s", "id"))
    assert embeddings.similar_nodes(named(vectors), named(targets), 4).count() == expected.count()


def test_merging_keeps_nodes_apart_whose_short_ids_meet(spark):
    def made(*rows):
        rows = [(t.lower(), i, t, "TECH", 0.6, "", n, (0, 0)) for i, t, n in rows]
        nodes = spark.createDataFrame(rows, "key string, id string, text string, type string, confidence double, context string, n_mentions long, first struct<doc_id: long, seq: long>")
        none = spark.createDataFrame([], "doc_id long, seq long, subject string, predicate string, object string, confidence double")
        return graph.Graph(nodes, none, none)

    met = "tech_60fae758"
    a = made((met, "Chenberer", 1), (met, "Oiqueaieauquech", 2), ("own", "First", 3))
    got = graph.merge_graphs(a, made((met, "Oiqueaieauquech", 4), ("own", "Second", 5))).nodes
    assert sorted((r.id, r.text, r.n_mentions) for r in got.collect()) == [("own", "First", 8), (met, "Chenberer", 1), (met, "Oiqueaieauquech", 6)]


def test_update_and_stream_equal_one_batch(spark, tmp_path):
    docs = spark.createDataFrame(DOCS[:2], "doc_id long, text string")
    whole = graph.build_graph(docs)
    steps = graph.update_graph(graph.build_graph(docs.where("doc_id = 1")), docs.where("doc_id = 2"))
    key = lambda g: sorted((r.key, r.n_mentions, r.confidence) for r in g.nodes.collect())
    assert key(whole) == key(steps) and steps.metadata == {"num_documents": 2}
    for i in (1, 2):
        docs.where(f"doc_id = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = GraphStream(spark, str(tmp_path / "graph"))
    source = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.start(source, str(tmp_path / "checkpoint")).awaitTermination(120)
    got = sorted((r.key, r.text, r.type, r.n_mentions) for r in stream.nodes().collect())
    assert got == sorted((r.key, r.text, r.type, r.n_mentions) for r in whole.nodes.collect())


def test_datasets(spark, tmp_path):
    path = tmp_path / "q.json"
    path.write_text('[{"Question": "q1", "Answer": "a"}, {"Question": "q2", "Correct Choice": "B", "A": "x", "B": "y"}]')
    rows = read_questions(spark, str(path)).orderBy("q_id").collect()
    assert [(r.question, r.answer, list(r.choices)) for r in rows] == [("q1", "a", []), ("q2", "B", ["x", "y"])]
    assert dataset_path("/d", "gpqa", "x") == "/d/GPQA/x.json"


def reference_paths(edges, a, b, max_length=5, most=10):
    """Breadth first with a queue, a node expanded at its first visit; edges in their order."""
    queue, visited, found = [(a, ())], set(), []
    while queue and len(found) < most:
        at, path = queue.pop(0)
        if at in visited and at != a:
            continue
        visited.add(at)
        if at == b and path:
            found.append(path)
        elif len(path) < max_length:
            queue += [(d, (*path, (s, p, d))) for s, d, p in edges if s == at and (d not in visited or d == b)]
    return found


def test_find_paths(spark, edges):
    names = "abcdxyz"
    pairs = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    got = {}
    for r in sorted(graph.find_paths(edges, pairs).collect(), key=lambda r: r["rank"]):
        got.setdefault((r.a, r.b), []).append(tuple(tuple(e) for e in r.path))
    assert got == {(a, b): f for a in names for b in names if (f := reference_paths(EDGES, a, b))}
    assert len(got["a", "a"]) == 1 and ("a", "z") not in got
    assert graph.find_paths(edges, pairs.limit(0)).count() == 0
    assert graph.find_paths(edges, pairs, max_length=1).count() == len(EDGES)


def test_query_graph(spark, nodes, edges):
    relations = spark.createDataFrame([(1, 0, "A", "is_a", "B"), (1, 1, "B", "is_a", "a"), (2, 0, "A", "is_a", "A")], "doc_id long, seq long, subject string, predicate string, object string")
    g = graph.Graph(nodes, relations, edges)
    paths = {r.path_id: r for r in graph.query_graph(g, " a ->D", "path").collect()}
    assert {k: r.length for k, r in paths.items()} == {"a>b>c>d": 4, "a>c>d": 3}
    assert [tuple(s) for s in paths["a>c>d"].path] == [("A", "causes", "C", 0.5), ("C", "is_a", "D", 0.5)]
    for query in ("a", "a -> b -> c", "a -> nobody", "->"):
        assert graph.query_graph(g, query, "path").count() == 0
    found = sorted((r.id, r.doc_id, r.seq) for r in graph.query_graph(g, "a").collect())
    assert found == [("a", 1, 0), ("a", 2, 0)]
    assert [(r.id, r.subject) for r in graph.query_graph(g, "z").collect()] == [("z", None)]
    assert graph.query_graph(g, "B", "relation").count() == 2
    with pytest.raises(ValueError):
        graph.query_graph(g, "a", "shape")


def test_statistics(spark, nodes, edges):
    values = {(r.statistic, r.name): r.value for r in graph.graph_statistics(nodes, edges, edges).collect()}
    assert values["num_nodes", ""] == 7 and values["num_edges", ""] == 6 and values["is_connected", ""] == 0
    assert values["relation_type", "is_a"] == 3 and values["degree", "min"] == 0
    empty = {(r.statistic, r.name): r.value for r in graph.graph_statistics(nodes.limit(0), edges.limit(0), edges.limit(0)).collect()}
    assert empty["is_connected", ""] is None and empty["density", ""] == 0


def test_compressed(spark):
    texts = ["", "a", "\n".join("abcde"), "\n".join("abcdefghi"), f"a\nb\n{agent.BEGIN}\nc\nd\ne\nf\ng\nh\n", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.c for r in rows.select("i", agent.compressed(rows.t).alias("c")).collect()}
    assert got == {i: None if t is None else agent.compress_reasoning(t) for i, t in enumerate(texts)}


def test_align_path(spark):
    nodes = spark.createDataFrame([("e1", "red fox", "TECH", "x"), ("e2", "lazy dog", "ORG", "")], "id string, text string, type string, context string")
    facts = spark.createDataFrame([("fox", "is_a", "animal", 0.5), ("dog", "is_a", "animal", 0.7), ("fox", "near", "dog", 1.0)], "subject string, predicate string, object string, confidence double")
    path = spark.createDataFrame([(0, ["is_a"]), (1, ["near", "causes"]), (2, [])], "step_id long, predicates array<string>")
    texts = spark.createDataFrame([(0, "red fox. red fox. this is it"), (1, "The LAZY dog; it is near")], "step_id long, text string")
    found = al.align_path(path, texts, nodes, facts)
    assert [(r.step_id, r.segment_id, r.id, r.kind, r.score) for r in found.entities.where("step_id = 0").collect()] == [(0, 0, "e1", "exact", 1.0)]
    steps = {r.step_id: (r.n_entities, r.n_relations, r.confidence) for r in found.steps.collect()}
    assert steps[0] == (1, 2, round((1 + 1.2) / 3, 6)) and steps[2] == (0, 0, 0.0)
    assert steps[1][1] == 1
    assert sorted((r.step_id, r.source, r.target) for r in al.edges_to_draw(found).collect()) == [(0, "dog", "animal"), (0, "fox", "animal"), (1, "fox", "dog")]
