"""Entity extraction: mentions of typed entities, their deduplication, merging and ids.

mentions() stays in the JVM and gives texts in order; extract_entities() also gives positions, contexts, formulas
and chemistry, through Arrow batches.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.patterns import CHEM_PATTERNS, CONFIDENCE, ENTITY_PATTERNS, FLOOR, MATH_PATTERNS, MATH_SYMBOLS

W, NO_W = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"


def portable(pattern: str) -> str:
    """A general pattern for a text whose non-word characters are doubled, with its match in group 1: engines agree
    on it, while they differ about word boundaries and have no common look-around. A match takes one copy of the
    character on either side, so that the next match has its own."""
    flags, core = ("(?i)", pattern[4:]) if pattern.startswith("(?i)") else ("", pattern)
    core = core.replace(r"\b", "").replace(r"\w", W).replace(r"\.", r"\.\.").replace(",", ",,").replace(" ", "  ")
    return f"{flags}(?:^|{NO_W})({core})(?:{NO_W}|$)"


PORTABLE = [(kind, portable(p)) for kind, p in ENTITY_PATTERNS]


def single(match: Column) -> Column:
    for c in (" ", ",", "."):
        match = F.replace(match, F.lit(2 * c), F.lit(c))
    return match


def mentions(docs: DataFrame, kinds: set[str] | None = None) -> DataFrame:
    """doc_id, seq, text, type, confidence of the general types (PERSON, ORG, LOC, TECH, CONCEPT), or of some of them, in
    one scan of docs(doc_id, text). seq is the order in which they are emitted: by pattern, then left to right."""
    doubled = F.regexp_replace("text", f"({NO_W})", "$1$1")
    found = []
    for i, (kind, pattern) in enumerate(PORTABLE):
        if kinds is not None and kind not in kinds:
            continue
        each = lambda m, at, kind=kind, i=i: F.struct(
            (F.lit(i).cast("long") * F.lit(1 << 32) + at).alias("seq"), single(m).alias("text"), F.lit(kind).alias("type")
        )
        found.append(F.transform(F.regexp_extract_all("doubled", F.lit(pattern), F.lit(1)), _two(each)))
    rows = docs.select("doc_id", doubled.alias("doubled")).select("doc_id", F.explode(F.concat(*found)).alias("m"))
    return rows.select("doc_id", "m.seq", "m.text", "m.type", F.lit(CONFIDENCE["pattern"]).alias("confidence"))


def _two(f) -> Callable:
    return lambda m, at: f(m, at)


def first_mentions(rows: DataFrame) -> DataFrame:
    """Per document the first mention of each text (trimmed, lower case) and type, of two characters and FLOOR
    confidence at least. Aggregates before it shuffles."""
    kept = rows.where((F.length(F.trim("text")) >= 2) & (F.col("confidence") >= FLOOR))
    key = F.lower(F.trim("text")).alias("key")
    others = [c for c in rows.columns if c not in ("doc_id", "type", "seq")]
    first = kept.groupBy("doc_id", key, "type").agg(F.min(F.struct("seq", *others)).alias("m"))
    return first.select("doc_id", "key", "type", "m.seq", *(f"m.{c}" for c in others))


def entity_id(text: Column, kind: Column) -> Column:
    return F.concat(F.lower(kind), F.lit("_"), F.substring(F.md5(F.concat(text, F.lit("_"), kind)), 1, 8))


def merge_entities(rows: DataFrame) -> DataFrame:
    """One entity for each text (trimmed, lower case) of mentions(doc_id, seq, text, type, confidence and, if there,
    context), across types and documents: text of the surest mention, most frequent type, mean confidence, longest
    context; the first in the order of (doc_id, seq) wins ties. With id, n_mentions and the order of its first mention.

    Mentions are summed per key and type before either shuffle, so a text that a third of all documents hold is as
    many rows as there are tasks.
    """
    rows = rows if "context" in rows.columns else rows.withColumn("context", F.lit(""))
    key = F.lower(F.trim("text")).alias("key")
    order = ("doc_id", "seq")
    by_type = rows.groupBy(key, "type").agg(
        F.count("*").alias("n"),
        F.sum("confidence").alias("total"),
        F.min(F.struct(*order)).alias("first"),
        F.min(F.struct((-F.col("confidence")).alias("c"), *order, "text")).alias("base"),
        F.min(F.struct((-F.length("context")).alias("c"), *order, "context")).alias("longest"),
    )
    merged = by_type.groupBy("key").agg(
        F.sum("n").alias("n_mentions"),
        F.min(F.struct((-F.col("n")).alias("c"), "first", "type")).alias("t"),
        F.min("base").alias("base"),
        F.min("longest").alias("longest"),
        F.min("first").alias("first"),
        (F.sum("total") / F.sum("n")).alias("confidence"),
    )
    return merged.select(
        "key",
        entity_id(F.col("base.text"), F.col("t.type")).alias("id"),
        F.col("base.text").alias("text"),
        F.col("t.type").alias("type"),
        F.round("confidence", 9).alias("confidence"),
        F.col("longest.context").alias("context"),
        "n_mentions",
        "first",
    )


# Positions, formulas and chemistry

GENERAL = [(kind, re.compile(p)) for kind, p in ENTITY_PATTERNS]
MATH = [re.compile(p) for p in MATH_PATTERNS]
CHEM = [re.compile(p) for p in CHEM_PATTERNS]
ONE_OR_TWO_ELEMENTS = re.compile(r"(?:[A-Z][a-z]?\d*){1,2}")
TOKEN = re.compile(r"\s*(\d+(?:\.\d+)?|\w+|\*\*|[-+*/^()])\s*")


def is_expression(text: str) -> bool:
    """Operands, operators and balanced parentheses, read from left to right; nothing is ever evaluated."""
    at, depth, operand = 0, 0, False
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            return False
        token, at = m[1], m.end()
        if token == ")":
            if not operand or not depth:
                return False
            depth -= 1
        elif token == "(" or token[0].isalnum() or token[0] == "_":
            if operand:
                return False
            depth, operand = depth + (token == "("), token != "("
        elif operand:
            operand = False
        elif token not in "+-":
            return False
    return operand and not depth


def valid_math(text: str) -> bool:
    inner = text.replace("$", "").replace("\\(", "").replace("\\)", "")
    if len(inner) < 2:
        return False
    return bool(set(text) & set(MATH_SYMBOLS)) or is_expression(inner)


def formula_type(text: str) -> str:
    if "∫" in text:
        return "integral"
    if "∑" in text or "∏" in text:
        return "summation"
    if "=" in text and any(c in text for c in "+-*/"):
        return "equation"
    return "radical" if "√" in text else "expression"


def valid_chem(text: str) -> bool:
    return ONE_OR_TWO_ELEMENTS.fullmatch(text) is not None or "(" in text and ")" in text


def entities_of(text: str, model: Callable[[str], list] | None = None) -> list[tuple]:
    """(text, type, start, end, confidence, context, formula_type) of a document: deduplicated, by start."""
    found = list(model(text)) if model else []

    def add(m, kind, source, formula=None):
        a, b = m.span()
        found.append((m[0], kind, a, b, CONFIDENCE[source], text[max(0, a - 30) : b + 30], formula))

    for kind, pattern in GENERAL:
        for m in pattern.finditer(text):
            add(m, kind, "pattern")
    for pattern in MATH:
        for m in pattern.finditer(text):
            if valid_math(m[0]):
                add(m, "MATH", "math", formula_type(m[0]))
    for pattern in CHEM:
        for m in pattern.finditer(text):
            if valid_chem(m[0]):
                add(m, "CHEM", "chem")
    kept: dict[tuple[str, str], tuple] = {}
    for e in found:
        key = e[0].lower().strip()
        if len(key) >= 2 and e[4] >= FLOOR:
            kept.setdefault((key, e[1]), e)
    return sorted(kept.values(), key=lambda e: e[2])


ENTITIES = (
    "doc_id long, seq long, text string, type string, start_pos long, end_pos long, confidence double, context string, "
    "formula_type string"
)
ENTITY_ROW = pa.schema(
    [(x.split()[0], {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]]) for x in ENTITIES.split(", ")]
)


def extract_entities(docs: DataFrame, model: Callable[[str], list] | None = None) -> DataFrame:
    """All entities of docs(doc_id, text), deduplicated within a document and in the order of their starts. `model`
    may name further ones for a text, as entities_of() does; it comes first. A null text has none."""

    def run(batches):
        for batch in batches:
            rows = [
                (doc_id, i, *e)
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for i, e in enumerate(entities_of(text or "", model))
            ]
            columns = list(zip(*rows)) or [()] * len(ENTITY_ROW)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ENTITY_ROW)], schema=ENTITY_ROW)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ENTITIES)


def entity_index(nodes: DataFrame) -> DataFrame:
    """name -> id for the names of each node (as it is, trimmed, in lower case); the last node of a name wins.
    nodes(id, text, first)."""
    names = F.explode(F.array_distinct(F.array(F.lower(F.trim("text")), F.trim("text"), F.lower("text"))))
    return nodes.select(names.alias("name"), "id", "first").groupBy("name").agg(F.max_by("id", F.struct("first", "id")).alias("id"))


def python_id(text: str, kind: str) -> str:
    return f"{kind.lower()}_{hashlib.md5(f'{text}_{kind}'.encode()).hexdigest()[:8]}"


def ranked(rows: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
