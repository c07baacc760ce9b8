"""Connected components of an edge list, as joins that converge in about a logarithm of the longest path."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import releasing
from graphloom.llm.repeats import Scratch

#: Rows of a table of pairs, at most, that is broadcast or joined up in one task; a larger one is shuffled.
FEW_ROWS = 1 << 17

#: Keys whose rows are joined without a shuffle, at most, and the rows from which on a key is one of them.
HOT, LARGE = 256, 1024


def frequent(counts: DataFrame, key: str) -> list:
    """The keys of counts(key, n_rows) whose rows spread() leaves where they are."""
    top = counts.where(F.col("n_rows") >= LARGE).orderBy(F.desc("n_rows"), key).limit(HOT)
    return [r[key] for r in top.select(key).collect()]


def spread(rows: DataFrame, one: DataFrame, key: str, keys: list | None = None) -> DataFrame:
    """rows.join(one, key), where `one` has a small row for each key. The rows of the HOT most frequent keys, if they
    are LARGE, stay where they are and meet a broadcast of HOT rows at most, so that no task gets a large group; any
    other key has less than one in HOT of the rows. keys: those keys, where they are known."""
    if keys is None:
        keys = frequent(rows.groupBy(key).agg(F.count("*").alias("n_rows")), key)
    if not keys:
        return rows.join(one, key)
    top = F.broadcast(rows.sparkSession.createDataFrame([(k,) for k in keys], rows.select(key).schema))
    hot = F.broadcast(one.join(top, key, "left_semi"))
    return rows.join(hot, key).unionByName(rows.join(top, key, "left_anti").join(one, key))


def few(table: DataFrame) -> bool:
    """Whether a written table has at most FEW_ROWS rows."""
    return table.count() <= FEW_ROWS


def held(table: DataFrame) -> DataFrame:
    """A written table of short rows, to be joined: it is broadcast if it is small, so that nothing else is shuffled."""
    return F.broadcast(table) if few(table) else table


def joined_up(batches):
    """(h, label) of the vertices of all edges (a, b), in memory."""
    parent, kind = {}, None

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    for batch in batches:
        kind = batch.column(0).type
        for a, b in zip(*(c.to_pylist() for c in batch.columns)):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    if parent:
        yield pa.RecordBatch.from_arrays([pa.array(list(parent), kind), pa.array([root(x) for x in parent], kind)], ["h", "label"])


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(h, label) of the vertices of edges(a, b): the least vertex of each one's component, as a table of scratch.

    Up to FEW_ROWS edges are joined up by one task. Of more, each round hooks a vertex to the least label around it and
    then takes the label of its label, which halves paths, and no component is gathered anywhere.
    """
    if few(edges):
        kind = edges.schema["a"].dataType.simpleString()
        one = edges.select("a", "b").coalesce(1).mapInArrow(releasing(joined_up), f"h {kind}, label {kind}")
        return scratch.write(one)
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = scratch.write(both.distinct())
    labels = both.groupBy(F.col("a").alias("h")).agg(F.min("b").alias("least"))
    labels = scratch.write(labels.select("h", F.col("h").alias("was"), F.least("h", "least").alias("label")))
    while True:
        around = spread(both, labels.select(F.col("h").alias("b"), F.col("label").alias("l")), "b")
        around = around.groupBy(F.col("a").alias("h")).agg(F.min("l").alias("l"))
        hooked = labels.join(around, "h").select("h", F.col("label").alias("was"), F.least("label", "l").alias("label"))
        hooked = scratch.write(hooked)
        up = hooked.select(F.col("h").alias("label"), F.col("label").alias("up"))
        new = spread(hooked, up, "label").select("h", "was", F.least("label", "up").alias("label"))
        new = scratch.write(new)
        scratch.drop(labels, hooked)
        labels = new
        if new.where(F.col("was") != F.col("label")).isEmpty():
            scratch.drop(both)
            return labels
