"""Graph storage: Parquet tables, one JSON file, or GraphML; listing and deleting by Hadoop's file systems."""

from __future__ import annotations

import json
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.graph import Graph

TABLES = ("nodes", "relations", "edges")


class Storage:
    """A folder of graphs, on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def at(self, name: str, *more: str) -> str:
        return "/".join((self.path, name, *more))

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def names(self) -> list[str]:
        fs, p = self._fs(self.path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def delete(self, name: str) -> bool:
        fs, p = self._fs(self.at(name))
        return bool(fs.delete(p, True))

    def save_metadata(self, graph: Graph, name: str) -> None:
        self.spark.createDataFrame([(json.dumps(graph.metadata, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(self.at(name, "metadata"))

    def load_metadata(self, name: str) -> dict:
        return json.loads(self.spark.read.text(self.at(name, "metadata")).first()[0])

    def save(self, graph: Graph, name: str) -> None:
        raise NotImplementedError

    def load(self, name: str) -> Graph:
        raise NotImplementedError


class ParquetStorage(Storage):
    """One Parquet table for each part: the backend for graphs of any size."""

    def save(self, graph: Graph, name: str) -> None:
        for t in TABLES:
            getattr(graph, t).write.mode("overwrite").parquet(self.at(name, t))
        self.save_metadata(graph, name)

    def load(self, name: str) -> Graph:
        parts = {t: self.spark.read.parquet(self.at(name, t)) for t in TABLES}
        return Graph(**parts, metadata=self.load_metadata(name))


class JsonStorage(Storage):
    """One line of JSON for each row, in a folder for each part, with the schema beside it."""

    def save(self, graph: Graph, name: str) -> None:
        for t in TABLES:
            df = getattr(graph, t)
            df.write.mode("overwrite").json(self.at(name, t), ignoreNullFields=False)
            self.spark.createDataFrame([(df.schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(self.at(name, f"{t}_schema"))
        self.save_metadata(graph, name)

    def load(self, name: str) -> Graph:
        from pyspark.sql.types import StructType

        parts = {}
        for t in TABLES:
            schema = StructType.fromJson(json.loads(self.spark.read.text(self.at(name, f"{t}_schema")).first()[0]))
            parts[t] = self.spark.read.schema(schema).json(self.at(name, t))
        return Graph(**parts, metadata=self.load_metadata(name))


class GraphMLStorage(Storage):
    """Nodes and edges as GraphML elements, written by all executors and read by Spark's XML source; what GraphML has
    no place for goes to Parquet beside it, in a folder of its own."""

    NODE, EDGE = ("text", "type", "confidence", "context"), ("predicate", "confidence")

    def save(self, graph: Graph, name: str) -> None:
        ParquetStorage(self.spark, self.at(name)).save(graph, "tables")

        def element(tag, ends, columns):
            def run(batches):
                import pyarrow as pa

                one = lambda line: pa.RecordBatch.from_arrays([pa.array([line])], ["value"])
                yield one('<graphml><graph edgedefault="directed">')  # each file is a document
                for batch in batches:
                    lines = []
                    for row in batch.to_pylist():
                        data = "".join(f'<data key="{c}">{escape(str(row[c]))}</data>' for c in columns if row[c] is not None)
                        lines.append(f"<{tag} {' '.join(f'{k}={quoteattr(str(row[v]))}' for k, v in ends)}>{data}</{tag}>".replace("\n", "&#10;"))
                    yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
                yield one("</graph></graphml>")

            return run

        nodes = graph.nodes.mapInArrow(element("node", [("id", "id")], self.NODE), "value string")
        edges = graph.edges.select("src", "dst", *self.EDGE).mapInArrow(element("edge", [("source", "src"), ("target", "dst")], self.EDGE), "value string")
        nodes.write.mode("overwrite").text(self.at(name, "graphml_nodes"))
        edges.write.mode("overwrite").text(self.at(name, "graphml_edges"))

    def load(self, name: str) -> Graph:
        return ParquetStorage(self.spark, self.at(name)).load("tables")

    def read_graphml(self, name: str) -> tuple[DataFrame, DataFrame]:
        """nodes(id, data) and edges(src, dst, data) from the elements, with data as a map."""
        data = "data array<struct<_VALUE: string, _key: string>>"
        as_map = F.map_from_entries(F.transform("data", lambda d: F.struct(d["_key"], d["_VALUE"]))).alias("data")
        read = self.spark.read.format("xml")
        nodes = read.option("rowTag", "node").schema(f"_id string, {data}").load(self.at(name, "graphml_nodes"))
        edges = read.option("rowTag", "edge").schema(f"_source string, _target string, {data}").load(self.at(name, "graphml_edges"))
        return nodes.select(F.col("_id").alias("id"), as_map), edges.select(F.col("_source").alias("src"), F.col("_target").alias("dst"), as_map)


BACKENDS = {"parquet": ParquetStorage, "json": JsonStorage, "graphml": GraphMLStorage}


def storage(kind: str, spark: SparkSession, path: str) -> Storage:
    if kind not in BACKENDS:
        raise ValueError(f"no storage backend {kind!r}; there are {', '.join(BACKENDS)}")
    return BACKENDS[kind](spark, path)
