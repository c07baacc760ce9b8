"""Queries over documents: entities, relations, segments, alignment; with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import alignment as al
from graphloom.operators import entities as en
from graphloom.operators import relations as re_
from graphloom.operators.graph import Graph, edges_of, merge_graphs


#: Bytes of Parquet that a task takes where patterns are matched, which takes far longer than reading.
TASK = 1 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table; texts that a few row groups hold are dealt to as many tasks as their size is worth. A large table has
    more splits than that and isn't shuffled."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if "text" not in rows.columns:
        return rows
    size = rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    wanted = min(-(-size // TASK), 4 * spark.sparkContext.defaultParallelism)
    return rows.repartition(int(wanted)) if rows.rdd.getNumPartitions() < wanted // 2 else rows


# SQL shared by several queries


def mentions_sql(table: str, id_column: str = "doc_id", name: str = "m", kinds: set[str] | None = None) -> str:
    """A WITH item of all mentions in a table."""
    parts = [
        f"SELECT doc_id, {i}::BIGINT * 4294967296 + generate_subscripts(l, 1) - 1 AS seq, unnest(l) AS raw, '{kind}' AS type "
        f"FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}', 1) AS l FROM {name}_doubled)"
        for i, (kind, pattern) in enumerate(en.PORTABLE)
        if kinds is None or kind in kinds
    ]
    doubled = rf"SELECT {id_column} AS doc_id, regexp_replace(text, '([^\p{{L}}\p{{N}}_])', '\1\1', 'g') AS t FROM {table}"
    single = "replace(replace(replace(raw, '  ', ' '), ',,', ','), '..', '.')"
    return f"{name}_doubled AS ({doubled}), {name} AS (SELECT doc_id, seq, {single} AS text, type FROM ({' UNION ALL '.join(parts)}))"


FIRST = """first AS (
  SELECT doc_id, lower(trim(text)) AS key, type, min(seq) AS seq, arg_min(text, seq) AS text
  FROM m WHERE length(trim(text)) >= 2 GROUP BY 1, 2, 3
)"""


def merge_sql(source: str, name: str) -> str:
    return f"""{name}_o AS (SELECT *, row_number() OVER (ORDER BY doc_id, seq) AS r FROM {source}),
{name}_t AS (SELECT lower(trim(text)) AS key, type, count(*) AS n, min(r) AS f, arg_min(text, r) AS text FROM {name}_o GROUP BY 1, 2),
{name} AS (
  SELECT key, arg_min(text, f) AS text, first(type ORDER BY n DESC, f) AS type, sum(n)::BIGINT AS n_mentions, min(f) AS f
  FROM {name}_t GROUP BY key
)"""


ID = "lower(type) || '_' || substr(md5(text || '_' || type), 1, 8)"
RUNS = rf"runs AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS run_at, unnest(l) AS run FROM (SELECT doc_id, regexp_extract_all(text, '{re_.RUN}') AS l FROM documents))"


def candidates_sql(only: set[str] | None = None) -> str:
    parts = [
        f"SELECT doc_id, {i}::BIGINT * 4294967296 + run_at AS seq, '{predicate}' AS predicate, "
        f"regexp_extract(run, '{pattern}', 1) AS subject_text, regexp_extract(run, '{pattern}', 2) AS object_text "
        f"FROM runs WHERE regexp_matches(run, '{pattern}')"
        for i, predicate, pattern, _ in re_.RUN_PATTERNS
        if only is None or predicate in only
    ]
    return f"{RUNS}, cand AS ({' UNION ALL '.join(parts)})"


RESOLVED = """names AS (SELECT doc_id, subject_text AS name FROM cand UNION SELECT doc_id, object_text FROM cand),
tiers AS (
  SELECT n.doc_id, n.name, f.seq, f.text, f.type,
    CASE WHEN f.key = lower(trim(n.name)) THEN 0
      WHEN contains(lower(f.text), lower(trim(n.name))) OR contains(lower(trim(n.name)), lower(f.text)) THEN 1 END AS tier
  FROM names n JOIN first f USING (doc_id)
),
best AS (
  SELECT doc_id, name, first(text ORDER BY tier, seq, text, type) AS text, first(type ORDER BY tier, seq, text, type) AS type
  FROM tiers WHERE tier IS NOT NULL GROUP BY 1, 2
),
resolved AS (
  SELECT c.doc_id, c.seq, s.text AS subject, c.predicate, o.text AS object, s.type AS subject_type, o.type AS object_type
  FROM cand c JOIN best s ON s.doc_id = c.doc_id AND s.name = c.subject_text
  JOIN best o ON o.doc_id = c.doc_id AND o.name = c.object_text
),
kept AS (
  SELECT doc_id, predicate, min(seq) AS seq, first(subject ORDER BY seq) AS subject, first(object ORDER BY seq) AS object
  FROM resolved WHERE lower(subject) <> lower(object) GROUP BY doc_id, predicate, lower(subject), lower(object)
)"""

# Entities


def _of_type(kind: str):
    def query(spark, sf_dir):
        found = en.mentions(read(spark, sf_dir, "documents"), {kind})
        return found.groupBy("doc_id", "text").agg(F.count("*").alias("n"))

    return query, f"WITH {mentions_sql('documents', kinds={kind})} SELECT doc_id, text, count(*) AS n FROM m GROUP BY 1, 2"


def entity_dedup_first(spark, sf_dir):
    return en.first_mentions(en.mentions(read(spark, sf_dir, "documents"))).select("doc_id", "key", "type", "seq", "text")


def entity_type_hist(spark, sf_dir):
    return entity_dedup_first(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("key").alias("n_keys"))


def entity_ids(spark, sf_dir):
    rows = entity_dedup_first(spark, sf_dir).select("text", "type").distinct()
    return rows.withColumn("id", en.entity_id(F.col("text"), F.col("type")))


def merged(spark, sf_dir, table="documents", id_column="doc_id"):
    docs = read(spark, sf_dir, table).select(F.col(id_column).alias("doc_id"), "text")
    return en.merge_entities(en.first_mentions(en.mentions(docs)).drop("key"))


def entity_merge(spark, sf_dir):
    return merged(spark, sf_dir).select("key", "id", "text", "type", "confidence", "n_mentions")


def entity_index(spark, sf_dir):
    return en.entity_index(merged(spark, sf_dir))


def entities_all(spark, sf_dir):
    """With positions, contexts, formulas and chemistry; has no form in SQL."""
    return en.extract_entities(read(spark, sf_dir, "documents"))


# Relations


def _relations(kind: str):
    def query(spark, sf_dir):
        return re_.candidates(read(spark, sf_dir, "documents"), {kind})

    return query, f"WITH {candidates_sql({kind})} SELECT * FROM cand"


def rel_candidates(spark, sf_dir):
    return re_.candidates(read(spark, sf_dir, "documents")).groupBy("doc_id", "predicate").agg(F.count("*").alias("n"))


def resolved(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return re_.resolve(re_.candidates(docs), en.first_mentions(en.mentions(docs)))


def rel_resolved(spark, sf_dir):
    return resolved(spark, sf_dir).drop("confidence")


def relations(spark, sf_dir):
    return re_.first_relations(resolved(spark, sf_dir))


def rel_dedup(spark, sf_dir):
    return relations(spark, sf_dir).select("doc_id", "predicate", "seq", "subject", "object")


def relations_all(spark, sf_dir):
    """With formulas, chemistry and positions; has no form in SQL."""
    return re_.extract_relations(read(spark, sf_dir, "documents"))


def kg_nodes(spark, sf_dir):
    return merged(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n_nodes"), F.sum("n_mentions").alias("n_mentions"))


def kg_edges(spark, sf_dir):
    return edges_of(merged(spark, sf_dir), relations(spark, sf_dir)).select("src", "dst", "predicate")


EDGES = f"""nodes AS (SELECT *, {ID} AS id FROM merged),
named AS (SELECT key, min(id) AS id FROM nodes GROUP BY key),
edges AS (
  SELECT s.id AS src, o.id AS dst, arg_max(k.predicate, k.doc_id::HUGEINT * 1000000000000000 + k.seq) AS predicate
  FROM kept k JOIN named s ON s.key = lower(trim(k.subject)) JOIN named o ON o.key = lower(trim(k.object)) GROUP BY 1, 2
)"""


def kg_merge_graphs(spark, sf_dir):
    none = spark.createDataFrame([], "doc_id long, seq long, subject string, predicate string, object string, confidence double")
    a = Graph(merged(spark, sf_dir), none, none)
    b = Graph(merged(spark, sf_dir, "benchmark", "item_id"), none, none)
    return merge_graphs(a, b).nodes.select("id", "text", "type", "n_mentions")


MERGE_GRAPHS = f"""WITH {mentions_sql('documents')}, {FIRST}, {merge_sql('first', 'a')},
{mentions_sql('benchmark', 'item_id', 'k')},
k_first AS (SELECT doc_id, lower(trim(text)) AS key, type, min(seq) AS seq, arg_min(text, seq) AS text FROM k WHERE length(trim(text)) >= 2 GROUP BY 1, 2, 3),
{merge_sql('k_first', 'b')}
SELECT {ID} AS id, text, type, sum(n_mentions)::BIGINT AS n_mentions
FROM (SELECT text, type, n_mentions FROM a UNION ALL SELECT text, type, n_mentions FROM b) GROUP BY text, type"""


def kg_query_entity(spark, sf_dir):
    found = merged(spark, sf_dir)
    from graphloom.operators.graph import query_entities

    return query_entities(found, "ment").select("id", "text", "n_mentions")


def kg_query_relation(spark, sf_dir):
    from graphloom.operators.graph import query_relations

    return query_relations(rel_dedup(spark, sf_dir), "tion")


# Segments and alignment

SEGMENTS = r"""cut AS (
  SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: trim(x)), lambda x: x <> '') AS a,
    list_filter(list_transform(regexp_split_to_array(text, '[;]+'), lambda x: trim(x)), lambda x: x <> '') AS b FROM {table}
),
chosen AS (SELECT doc_id, CASE WHEN len(a) >= 2 THEN a ELSE b END AS l FROM cut),
{name} AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS segment_id, unnest(l) AS segment FROM chosen)"""


def segments_sql(table: str, name: str = "seg") -> str:
    out = SEGMENTS.replace("{table}", table).replace("{name}", name)
    return out.replace("cut AS", f"{name}_cut AS").replace("chosen AS", f"{name}_chosen AS").replace("FROM cut", f"FROM {name}_cut").replace("FROM chosen", f"FROM {name}_chosen")


def segment_text(spark, sf_dir):
    return al.segment_rows(read(spark, sf_dir, "documents"))


def _benchmark(spark, sf_dir):
    rows = al.segment_rows(read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text"))
    return rows.select((F.col("doc_id") * 1000 + F.col("segment_id")).alias("id"), F.col("segment").alias("text"))


ITEMS = segments_sql("(SELECT item_id AS doc_id, text FROM benchmark)", "item") + ", nodes AS (SELECT doc_id * 1000 + segment_id AS id, segment AS text FROM item)"


def align_exact(spark, sf_dir):
    return al.align_exact(segment_text(spark, sf_dir), _benchmark(spark, sf_dir))


def exact_sql(source: str) -> str:
    return f"""WITH {source},
l AS (SELECT doc_id, segment_id, lower(trim(segment)) AS s FROM seg), r AS (SELECT id, lower(trim(text)) AS e FROM nodes)
SELECT doc_id, segment_id, id, 1.0::DOUBLE AS score FROM l JOIN r ON s = e
UNION ALL
SELECT doc_id, segment_id, id, round(least(length(s), length(e)) / greatest(length(s), length(e)), 9) AS score FROM l JOIN r
  ON s <> e AND least(length(s), length(e)) >= 0.9::DOUBLE * greatest(length(s), length(e)) AND (contains(s, e) OR contains(e, s))"""


EXACT = exact_sql(f"{segments_sql('documents')}, {ITEMS}")


def align_jaccard(spark, sf_dir):
    return al.align_jaccard(segment_text(spark, sf_dir), _benchmark(spark, sf_dir))


def jaccard_sql(source: str) -> str:
    return rf"""WITH {source},
l AS (SELECT doc_id, segment_id, list_distinct(list_filter(regexp_split_to_array(lower(segment), '\s+'), lambda w: w <> '')) AS x FROM seg),
r AS (SELECT id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')) AS y FROM nodes),
p AS (SELECT doc_id, segment_id, id, len(x) AS n, len(y) AS m, count(*) AS b
  FROM (SELECT doc_id, segment_id, x, unnest(x) AS w FROM l) JOIN (SELECT id, y, unnest(y) AS w FROM r) USING (w) GROUP BY 1, 2, 3, 4, 5)
SELECT doc_id, segment_id, id, round(b / (n + m - b), 9) AS score FROM p WHERE round(b / (n + m - b), 9) >= 0.6"""


JACCARD = jaccard_sql(f"{segments_sql('documents')}, {ITEMS}")


def align_tfidf(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    nodes = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text", F.lit("").alias("context"))
    return al.align_tfidf(al.segment_rows(turns), nodes)


def grams_sql(source: str, key: str, name: str) -> str:
    stop = ", ".join(f"'{w}'" for w in al.STOP_WORDS)
    return rf"""{name}_t AS (SELECT {key}, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}_]+'), lambda w: length(w) >= 2 AND NOT w IN ({stop})) AS l FROM {source}),
{name}_g AS (SELECT {key}, unnest(l) AS term FROM {name}_t UNION ALL SELECT {key}, unnest(list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1])) FROM {name}_t),
{name}_tf AS (SELECT {key}, term, count(*) AS tf FROM {name}_g GROUP BY ALL)"""


def weights_sql(key: str, name: str) -> str:
    return f"""{name}_w AS (SELECT {key}, term, tf * idf AS w FROM {name}_tf JOIN model USING (term)),
{name} AS (SELECT {key}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS weight FROM {name}_w)"""


TFIDF = f"""WITH {segments_sql('(SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations)')},
{grams_sql("(SELECT item_id AS id, text || ' ' AS text FROM benchmark)", 'id', 'b')},
{grams_sql('(SELECT doc_id, segment_id, segment AS text FROM seg)', 'doc_id, segment_id', 's')},
model AS (SELECT term, ln((1 + (SELECT count(*) FROM benchmark)) / (1 + count(*))) + 1 AS idf FROM b_tf GROUP BY term ORDER BY sum(tf) DESC, term LIMIT {al.MAX_FEATURES}),
{weights_sql('id', 'r')}, {weights_sql('doc_id, segment_id', 'l')}
SELECT doc_id, segment_id, id, round(sum(l.weight * r.weight), 6) AS score FROM l JOIN r USING (term)
GROUP BY doc_id, segment_id, id HAVING round(sum(l.weight * r.weight), 6) >= 0.3""".replace("r_w AS (SELECT id, term, tf * idf AS w FROM r_tf", "r_w AS (SELECT id, term, tf * idf AS w FROM b_tf").replace("FROM l_tf", "FROM s_tf")


def align_quality(spark, sf_dir):
    found = al.best_alignments(align_jaccard(spark, sf_dir))
    each = found.groupBy("doc_id").agg(F.count("*").alias("n_entities"), F.avg("score").alias("confidence"))
    steps = read(spark, sf_dir, "documents").select("doc_id").join(each, "doc_id", "left")
    steps = steps.select(F.coalesce("n_entities", F.lit(0)).alias("n_entities"), F.lit(0).alias("n_relations"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    return al.alignment_quality(steps)


QUALITY = f"""WITH found AS ({JACCARD}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, segment_id, id) AS rank FROM found),
each AS (SELECT doc_id, count(*) AS n, avg(score) AS c FROM ranked WHERE rank <= 5 GROUP BY doc_id)
SELECT round(avg(coalesce(c, 0)), 6) AS mean_confidence, round(avg(coalesce(n, 0)), 6) AS entities_per_step,
  0.0::DOUBLE AS relations_per_step, round(avg(CASE WHEN n > 0 THEN 1 ELSE 0 END), 6) AS covered
FROM documents LEFT JOIN each USING (doc_id)"""


def align_relations(spark, sf_dir):
    facts = read(spark, sf_dir, "nation").select(F.lit("is_a").alias("predicate"), F.col("n_name").alias("subject"), F.lit("NATION").alias("object"))
    found = al.align_relations(segment_text(spark, sf_dir), facts, ["is_a", "located_in"])
    return found.groupBy("doc_id", "predicate").agg(F.count("*").alias("n"))


RELATION_HITS = f"""WITH {segments_sql('documents')}
SELECT doc_id, 'is_a' AS predicate, count(*) * (SELECT count(*) FROM nation) AS n FROM seg
WHERE {' OR '.join(f"contains(lower(segment), '{w}')" for w in al.RELATION_KEYWORDS['is_a'])} GROUP BY doc_id"""

def steps(spark, sf_dir):
    """All that aligning the turns of the conversations to the benchmark items and to the nations' facts yields."""
    turns = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("step_id"), "text")
    asked = F.when(F.col("step_id") % 2 == 0, F.array(F.lit("is_a"), F.lit("causes"))).otherwise(F.array(F.lit("located_in")))
    nodes = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text", F.lit("CONCEPT").alias("type"), F.lit("").alias("context"))
    facts = read(spark, sf_dir, "nation").select(
        F.col("n_name").alias("subject"), F.when(F.col("n_nationkey") % 5 == 0, "located_in").otherwise("is_a").alias("predicate"), F.lit("NATION").alias("object"), F.lit(0.75).alias("confidence")
    )
    return al.align_path(turns.select("step_id", asked.alias("predicates")), turns, nodes, facts)


def align_step_entities(spark, sf_dir):
    return steps(spark, sf_dir).entities.select("step_id", "segment_id", "id", "kind", "score", "rank")


def align_step_edges(spark, sf_dir):
    return al.edges_to_draw(steps(spark, sf_dir)).drop("segment")


def align_step_summary(spark, sf_dir):
    return steps(spark, sf_dir).steps


TURNS = segments_sql("(SELECT conv_id * 1000 + turn AS doc_id, coalesce(text, '') AS text FROM conversations)")
WHOLE = TURNS + ", nodes AS (SELECT item_id AS id, text FROM benchmark)"
ALIGNED = f"""exact AS ({exact_sql(WHOLE)}), partial AS ({jaccard_sql(WHOLE)}), semantic AS ({TFIDF}), {TURNS},
every_way AS (SELECT *, 0 AS way, 'exact' AS kind FROM exact UNION ALL SELECT *, 1, 'partial' FROM partial UNION ALL SELECT *, 2, 'semantic' FROM semantic),
of_text AS (SELECT *, row_number() OVER (PARTITION BY doc_id, segment, id ORDER BY score DESC, segment_id, way) AS r FROM every_way JOIN seg USING (doc_id, segment_id)),
aligned AS (SELECT doc_id AS step_id, segment_id, id, kind, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, segment_id, way, id) AS rank FROM of_text WHERE r = 1 QUALIFY rank <= 5)"""
STEP_FACTS = f"""facts AS (SELECT n_name AS subject, CASE WHEN n_nationkey % 5 = 0 THEN 'located_in' ELSE 'is_a' END AS predicate, 'NATION' AS object FROM nation),
words AS (SELECT * FROM (VALUES {', '.join(f"('{p}', '{w}')" for p in ('is_a', 'causes', 'located_in') for w in al.RELATION_KEYWORDS[p])}) AS t(predicate, word)),
hits AS (SELECT DISTINCT doc_id AS step_id, segment_id, predicate FROM seg JOIN words ON contains(lower(segment), word) AND (predicate = 'located_in') = (doc_id % 2 = 1))"""
STEP_EDGES = f"""WITH {TURNS}, {STEP_FACTS}
SELECT step_id, subject AS source, object AS target, predicate AS label, 0.75::DOUBLE AS score FROM hits JOIN facts USING (predicate)"""
STEP_SUMMARY = f"""WITH {ALIGNED}, {STEP_FACTS},
related AS (SELECT step_id, count(*) AS r, count(*) * 0.75::DOUBLE AS rs FROM hits JOIN facts USING (predicate) GROUP BY 1),
linked AS (SELECT step_id, count(*) AS e, sum(score) AS es FROM aligned GROUP BY 1)
SELECT conv_id * 1000 + turn AS step_id, coalesce(e, 0) AS n_entities, coalesce(r, 0) AS n_relations,
  CASE WHEN e IS NULL AND r IS NULL THEN 0.0 ELSE round((coalesce(es, 0) + coalesce(rs, 0)) / (coalesce(e, 0) + coalesce(r, 0)), 6) END::DOUBLE AS confidence
FROM conversations LEFT JOIN related ON related.step_id = conv_id * 1000 + turn LEFT JOIN linked ON linked.step_id = conv_id * 1000 + turn"""


def extraction_statistics(spark, sf_dir):
    from graphloom.operators import graph

    docs = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return graph.extraction_statistics(docs, en.first_mentions(en.mentions(docs)), re_.candidates(docs))


EXTRACTED = f"""WITH talk AS (SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations), {mentions_sql('talk')}, {FIRST}, {candidates_sql().replace('FROM documents', 'FROM talk')}
SELECT 'entity_type' AS statistic, type AS name, count(*)::DOUBLE AS value FROM first GROUP BY type UNION ALL SELECT 'relation_type', predicate, count(*)::DOUBLE FROM cand GROUP BY predicate
UNION ALL SELECT 'total_entities', '', count(*)::DOUBLE FROM first UNION ALL SELECT 'total_relations', '', count(*)::DOUBLE FROM cand
UNION ALL SELECT 'documents_processed', '', count(*)::DOUBLE FROM talk"""

FOUND = {
    "entity_person": _of_type("PERSON"),
    "entity_org": _of_type("ORG"),
    "entity_loc": _of_type("LOC"),
    "entity_tech": _of_type("TECH"),
    "entity_concept": _of_type("CONCEPT"),
    "entity_dedup_first": (entity_dedup_first, f"WITH {mentions_sql('documents')}, {FIRST} SELECT * FROM first"),
    "entity_type_hist": (entity_type_hist, f"WITH {mentions_sql('documents')}, {FIRST} SELECT type, count(*) AS n, count(DISTINCT key) AS n_keys FROM first GROUP BY type"),
    "entity_ids": (entity_ids, f"WITH {mentions_sql('documents')}, {FIRST} SELECT DISTINCT text, type, {ID} AS id FROM first"),
    "entity_merge": (
        entity_merge,
        f"WITH {mentions_sql('documents')}, {FIRST}, {merge_sql('first', 'merged')} SELECT key, {ID} AS id, text, type, 0.6::DOUBLE AS confidence, n_mentions FROM merged",
    ),
    "entity_index": (
        entity_index,
        f"WITH {mentions_sql('documents')}, {FIRST}, {merge_sql('first', 'merged')}, n AS (SELECT {ID} AS id, text, f FROM merged), "
        "k AS (SELECT lower(trim(text)) AS name, id, f FROM n UNION SELECT trim(text), id, f FROM n UNION SELECT lower(text), id, f FROM n) "
        "SELECT name, first(id ORDER BY f DESC, id DESC) AS id FROM k GROUP BY name",
    ),
    "entities_all": (entities_all, None),
    "rel_is_a": _relations("is_a"),
    "rel_part_of": _relations("part_of"),
    "rel_located_in": _relations("located_in"),
    "rel_candidates": (rel_candidates, f"WITH {candidates_sql()} SELECT doc_id, predicate, count(*) AS n FROM cand GROUP BY 1, 2"),
    "rel_resolved": (rel_resolved, f"WITH {mentions_sql('documents')}, {FIRST}, {candidates_sql()}, {RESOLVED} SELECT * FROM resolved"),
    "rel_dedup": (rel_dedup, f"WITH {mentions_sql('documents')}, {FIRST}, {candidates_sql()}, {RESOLVED} SELECT * FROM kept"),
    "relations_all": (relations_all, None),
    "kg_nodes": (
        kg_nodes,
        f"WITH {mentions_sql('documents')}, {FIRST}, {merge_sql('first', 'merged')} SELECT type, count(*) AS n_nodes, sum(n_mentions)::BIGINT AS n_mentions FROM merged GROUP BY type",
    ),
    "kg_edges": (
        kg_edges,
        f"WITH {mentions_sql('documents')}, {FIRST}, {candidates_sql()}, {RESOLVED}, {merge_sql('first', 'merged')}, {EDGES} SELECT src, dst, predicate FROM edges",
    ),
    "kg_merge_graphs": (kg_merge_graphs, MERGE_GRAPHS),
    "kg_query_entity": (
        kg_query_entity,
        f"WITH {mentions_sql('documents')}, {FIRST}, {merge_sql('first', 'merged')} SELECT {ID} AS id, text, n_mentions FROM merged WHERE contains(lower(text), 'ment')",
    ),
    "kg_query_relation": (
        kg_query_relation,
        f"WITH {mentions_sql('documents')}, {FIRST}, {candidates_sql()}, {RESOLVED} SELECT * FROM kept "
        "WHERE contains(lower(predicate), 'tion') OR contains(lower(subject), 'tion') OR contains(lower(object), 'tion')",
    ),
    "segment_text": (segment_text, f"WITH {segments_sql('documents')} SELECT * FROM seg"),
    "align_exact": (align_exact, EXACT),
    "align_jaccard": (align_jaccard, JACCARD),
    "align_tfidf": (align_tfidf, TFIDF),
    "align_quality": (align_quality, QUALITY),
    "align_relations": (align_relations, RELATION_HITS),
    "align_step_entities": (align_step_entities, f"WITH {ALIGNED} SELECT * FROM aligned"),
    "align_step_edges": (align_step_edges, STEP_EDGES),
    "align_step_summary": (align_step_summary, STEP_SUMMARY),
    "extraction_statistics": (extraction_statistics, EXTRACTED),
}
