"""Relation extraction: subject, predicate, object from texts and their entities.

A pattern asks for words, then a keyword, then words. Within a run of words and white space the greedy leftmost match
has all up to the last usable keyword as its subject and the rest as its object, so each run is matched once, by an
expression without nested repetition: time is linear in a run, however long it is.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.patterns import (
    FLOOR, MATH_OPERATORS, OTHER_VERB, POSSIBLE, RELATION_CONFIDENCE, RELATION_WORDS, SYMBOLS, VERBS,
)
from graphloom.operators.entities import W, entities_of

RUN = r"[\p{L}\p{N}_\s]+"


def run_pattern(words: str, end: str = r"\s*$") -> str:
    return rf"(?is)^\s*({W}(?:.*{W})?)\s+{words}\s+({W}(?:.*{W})?){end}"


#: Patterns by keyword in order, with their places among all patterns.
RUN_PATTERNS = [
    (i, predicate, run_pattern(words, r"\s+possible" if i == POSSIBLE else r"\s*$"), words)
    for i, (predicate, words) in enumerate(RELATION_WORDS)
    if words not in SYMBOLS
]


def candidates(docs: DataFrame, only: set[str] | None = None) -> DataFrame:
    """doc_id, seq, predicate, subject_text, object_text: what keyword patterns find in docs(doc_id, text), before
    entities are looked up. seq follows patterns, then runs."""
    runs = F.regexp_extract_all("text", F.lit(RUN), F.lit(0))
    rows = docs.select("doc_id", F.posexplode(runs).alias("at", "run"))
    found = []
    for i, predicate, pattern, words in RUN_PATTERNS:
        if only is None or predicate in only:
            found.append(
                F.when(
                    F.col("run").rlike(pattern),
                    F.struct(
                        (F.lit(i).cast("long") * F.lit(1 << 32) + F.col("at")).alias("seq"),
                        F.lit(predicate).alias("predicate"),
                        F.regexp_extract("run", pattern, 1).alias("subject_text"),
                        F.regexp_extract("run", pattern, 2).alias("object_text"),
                    ),
                )
            )
    each = rows.select("doc_id", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("r"))
    return each.select("doc_id", "r.*")


def resolve(found: DataFrame, entities: DataFrame) -> DataFrame:
    """Subjects and objects by the entities of their document: an equal text, else one that contains the other, each
    in lower case; the first entity in order. entities(doc_id, seq, text, type). The join is on the document; the
    best entity of each text is kept by an aggregate."""
    names = found.select("doc_id", F.col("subject_text").alias("name")).unionByName(found.select("doc_id", F.col("object_text").alias("name"))).distinct()
    # Lower case is made before the join: names may be long, and meet all entities of their document.
    names = names.withColumn("low", F.lower(F.trim("name")))
    own = entities.select("doc_id", "seq", "text", "type", F.lower("text").alias("own"), F.lower(F.trim("text")).alias("trimmed"))
    tier = F.when(F.col("trimmed") == F.col("low"), 0).when(F.col("own").contains(F.col("low")) | F.col("low").contains(F.col("own")), 1)
    best = names.join(own, "doc_id").withColumn("tier", tier).where("tier is not null")
    best = best.groupBy("doc_id", "name").agg(F.min(F.struct("tier", "seq", "text", "type")).alias("e"))
    subject = best.select("doc_id", F.col("name").alias("subject_text"), F.col("e.text").alias("subject"), F.col("e.type").alias("subject_type"))
    objects = best.select("doc_id", F.col("name").alias("object_text"), F.col("e.text").alias("object"), F.col("e.type").alias("object_type"))
    rows = found.join(subject, ["doc_id", "subject_text"]).join(objects, ["doc_id", "object_text"])
    return rows.select(
        "doc_id", "seq", "subject", "predicate", "object", "subject_type", "object_type",
        F.lit(RELATION_CONFIDENCE["pattern"]).alias("confidence"),
    )


def first_relations(rows: DataFrame) -> DataFrame:
    """Per document the first relation of each subject, predicate and object (in lower case), without those of an
    entity to itself."""
    kept = rows.where((F.col("confidence") >= FLOOR) & (F.lower("subject") != F.lower("object")))
    others = [c for c in rows.columns if c not in ("doc_id", "seq", "predicate")]
    keys = [F.lower("subject").alias("s"), "predicate", F.lower("object").alias("o")]
    first = kept.groupBy("doc_id", *keys).agg(F.min(F.struct("seq", *others)).alias("r"))
    return first.select("doc_id", "predicate", "r.seq", *(f"r.{c}" for c in others))


# With positions, formulas and chemistry

RUNS = re.compile(r"[\w\s]+")
WORDY = [
    (predicate, re.compile(rf"\s*(\w(?:.*\w)?)\s+{words}\s+(\w(?:.*\w)?)" + (r"\s+possible" if i == POSSIBLE else r"\s*\Z"), re.I | re.S), words)
    for i, (predicate, words) in enumerate(RELATION_WORDS)
]


def find_entity(name: str, entities: list[tuple], text: str) -> tuple | None:
    """The entity of a text: equal, then containing or contained, then at the place where the text first occurs."""
    low = name.lower().strip()
    for test in (lambda e: e[0].lower().strip() == low, lambda e: low in e[0].lower() or e[0].lower() in low):
        for e in entities:
            if test(e):
                return e
    a = text.lower().find(low)
    if a >= 0:
        b = a + len(name)
        for e in entities:
            if e[2] <= a <= e[3] or e[2] <= b <= e[3]:
                return e
    return None


def paired(text: str, symbol: str) -> list[tuple[str, str]]:
    """What stands on either side of an operator, each piece in one pair only."""
    parts, out, i = text.split(symbol), [], 0
    while i + 1 < len(parts):
        if parts[i] and parts[i + 1]:
            out.append((parts[i], parts[i + 1]))
            i += 2
        else:
            i += 1
    return out


def beside(text: str, symbol: str, then: str = "") -> list[tuple[str, str]]:
    """Words in front of a symbol and words behind it (which `then` must follow), each run in one pair only."""
    out, taken = [], 0
    at = text.find(symbol)
    while at >= 0:
        left, right = at, at + len(symbol)
        while left > taken and (text[left - 1].isalnum() or text[left - 1] in "_" or text[left - 1].isspace()):
            left -= 1
        m = RUNS.match(text, right)
        a, b = text[left:at].strip(), m[0].strip() if m else ""
        end = m.end() if m else right
        if a and b and (not then or text.startswith(then, end)):
            out.append((a, b))
            taken = end
        at = text.find(symbol, right)
    return out


def chemical(text: str) -> list[tuple[list[tuple[str, str, str]], list[str]]]:
    """Reactions: the relations of each, and the texts that all must be entities."""
    out = []
    for reaction in re.split(r"[.;\n]", text):
        sides = [s.strip() for s in reaction.split("→")]
        for left, right in zip(sides, sides[1:]):
            parts = [p.strip() for p in left.split("+") if p.strip()]
            if len(parts) >= 2 and right:
                a, b = parts[-2], parts[-1]
                out.append(([(a, "reacts_with", b), (a, "produces", right)], [a, b, right]))
    for a, b in paired(text, "→"):
        out.append(([(a.strip(), "produces", b.strip())], [a.strip(), b.strip()]))
    for a, b in paired(text, "="):
        first, plus, _ = b.partition("+")
        if plus and first.strip():
            out.append(([(a.strip(), "decomposes_to", first.strip())], [a.strip(), first.strip()]))
    return out


def relations_of(text: str, entities: list[tuple], parser: Callable[[str], list] | None = None) -> list[tuple]:
    """(subject, predicate, object, confidence, subject_type, object_type) of a document, deduplicated, in order."""
    found: list[tuple] = []

    def add(name_a, predicate, name_b, source, among):
        a, b = find_entity(name_a, among, text), find_entity(name_b, among, text)
        if a and b:
            found.append((a[0], predicate, b[0], RELATION_CONFIDENCE[source], a[1], b[1]))

    runs = RUNS.findall(text)
    for predicate, pattern, words in WORDY:
        if words in SYMBOLS:
            pairs = beside(text, words, "→" if words == "+" else "")
        else:
            pairs = [m.groups() for m in map(pattern.match, runs) if m]
        for a, b in pairs:
            add(a, predicate, b, "pattern", entities)
    for a, verb, b in parser(text) if parser else ():
        add(a, VERBS.get(verb, OTHER_VERB), b, "parse", entities)
    math = [e for e in entities if e[1] == "MATH"]
    for symbol, predicate in MATH_OPERATORS if math else ():
        for a, b in paired(text, symbol):
            add(a.strip(), predicate, b.strip(), "math", math)
    chem = [e for e in entities if e[1] == "CHEM"]
    for relations, needed in chemical(text) if chem else ():
        if all(find_entity(n, chem, text) for n in needed):
            for a, predicate, b in relations:
                add(a, predicate, b, "chem", chem)
    kept: dict[tuple[str, str, str], tuple] = {}
    for r in found:
        if r[3] >= FLOOR and r[0].lower() != r[2].lower():
            kept.setdefault((r[0].lower(), r[1], r[2].lower()), r)
    return list(kept.values())


RELATIONS = (
    "doc_id long, seq long, subject string, predicate string, object string, confidence double, subject_type string, object_type string"
)
RELATION_ROW = pa.schema(
    [(x.split()[0], {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]]) for x in RELATIONS.split(", ")]
)


def extract_relations(docs: DataFrame, model: Callable | None = None, parser: Callable | None = None) -> DataFrame:
    """All relations of docs(doc_id, text) between the entities of the same document. `parser` may give (subject,
    verb's base form, object) for a text. A null text has none."""

    def run(batches):
        for batch in batches:
            rows = [
                (doc_id, i, *r)
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for i, r in enumerate(relations_of(text or "", entities_of(text or "", model), parser))
            ]
            columns = list(zip(*rows)) or [()] * len(RELATION_ROW)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, RELATION_ROW)], schema=RELATION_ROW)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RELATIONS)
