"""Entities and relations against Python's regular expressions and hand-made expectations."""

import re

from graphloom.functions.patterns import ENTITY_PATTERNS
from graphloom.operators import entities as en
from graphloom.operators import relations as re_

TEXTS = [
    "Marie Curie worked at Paris University. A. Turing lived in Bletchley, UK near Oxford City.",
    "Élan Vital and Größe Müller; Aé Bb, Foo_bar Baz. GPT4 V8 main.js x.py A.B. Smith",
    "Foo Bar Foo Bar Baz Qux Corp, Salt Lake, UT. information about movement and NATIONALISM",
    "",
    "one",
]


def test_mentions_equal_python(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = sorted((r.doc_id, r.seq >> 32, r.seq & 0xFFFFFFFF, r.text, r.type) for r in en.mentions(docs).collect())
    expected = []
    for i, text in enumerate(TEXTS):
        for p, (kind, pattern) in enumerate(ENTITY_PATTERNS):
            for at, m in enumerate(re.finditer(pattern, text)):
                expected.append((i, p, at, m[0], kind))
    assert got == sorted(expected)


def test_first_mention_wins_and_repetition_changes_nothing(spark):
    rows = spark.createDataFrame(
        [(1, 5, "Foo", "TECH", 0.6), (1, 2, "FOO ", "TECH", 0.6), (1, 1, "foo", "ORG", 0.6), (1, 9, "x", "TECH", 0.9), (1, 8, "low", "TECH", 0.4)],
        "doc_id long, seq long, text string, type string, confidence double",
    )
    first = en.first_mentions(rows)
    assert sorted((r.type, r.text, r.seq) for r in first.collect()) == [("ORG", "foo", 1), ("TECH", "FOO ", 2)]
    assert en.first_mentions(first.drop("key")).count() == 2


def test_merge_ties(spark):
    rows = spark.createDataFrame(
        [
            (1, 0, "Foo", "ORG", 0.6, "aa"), (1, 1, "foo", "TECH", 0.9, "bbbb"), (2, 0, "FOO", "TECH", 0.9, "cccc"), (2, 1, "Foo", "ORG", 0.6, "d"),
        ],
        "doc_id long, seq long, text string, type string, confidence double, context string",
    )
    (r,) = en.merge_entities(rows.repartition(3)).collect()
    assert (r.key, r.text, r.type, r.context, r.n_mentions, r.confidence) == ("foo", "foo", "ORG", "bbbb", 4, 0.75)
    assert r.id == en.python_id("foo", "ORG")


def test_formulas_and_chemistry():
    found = {(e[0], e[1]): e for e in en.entities_of(r"Energy $E=mc^2$ and \(a+b\) with H2 and (N2)3 → ∫ x^2")}
    assert found["$E=mc^2$", "MATH"][6] == "expression" and ("x^2", "MATH") in found
    assert ("H2", "CHEM") in found and ("(N2)3", "CHEM") in found
    assert all(e[2] <= e[3] for e in found.values())
    assert en.is_expression("a+b*(c-2)") and not en.is_expression("a+") and not en.is_expression("(a") and not en.is_expression("a b")
    assert en.formula_type("∫x") == "integral" and en.formula_type("a=b+c") == "equation" and en.formula_type("√2") == "radical"
    assert en.entities_of("(" * 50_000) == []


def test_runs_equal_nested_patterns(spark):
    texts = ["the cat is a small animal. Dogs are in the big house at noon", "a part is a part of b", "x causes y leads to z", "he makes it very possible today"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.predicate, r.subject_text, r.object_text) for r in re_.candidates(docs).collect()}
    group = r"(\w+(?:\s+\w+)*)"
    expected = set()
    for i, text in enumerate(texts):
        for p, (predicate, words) in enumerate(re_.RELATION_WORDS):
            if words not in re_.SYMBOLS:
                end = r"\s+possible" if p == re_.POSSIBLE else ""
                for m in re.finditer(rf"{group}\s+{words}\s+{group}{end}", text, re.I):
                    expected.add((i, predicate, m[1], m[2]))
    assert got == expected


def test_long_runs_are_linear(spark):
    docs = spark.createDataFrame([(1, "word " * 20_000), (2, "a" * 100_000 + " is a b")], "doc_id long, text string")
    assert re_.candidates(docs).count() == 1
    assert re_.extract_relations(docs).count() >= 0


def test_pairs_and_symbols():
    assert re_.paired("a = b = c = d", "=") == [("a ", " b "), (" c ", " d")]
    assert re_.paired("=a==b", "=") == []
    assert re_.beside("x y = z w, p=q", "=") == [("x y", "z w"), ("p", "q")]
    assert re_.beside("A + B → C", "+", "→") == [("A", "B")]


def test_relations_of_a_text():
    text = "Marie Curie works at Paris University. N2 + O2 → Fe3"
    found = {r[:3] for r in re_.relations_of(text, en.entities_of(text))}
    assert ("Marie Curie", "works_at", "Paris University") in found
    assert {("N2", "reacts_with", "O2"), ("N2", "produces", "Fe3")} <= found


def test_relations_by_parser_and_filters(spark):
    text = "Marie Curie met Pierre Curie"
    rows = re_.relations_of(text, en.entities_of(text), lambda t: [("Marie Curie", "work", "Pierre Curie"), ("Marie Curie", "be", "Marie Curie")])
    assert [r[:4] for r in rows] == [("Marie Curie", "works_at", "Pierre Curie", 0.6)]
    docs = spark.createDataFrame([(1, None), (None, text)], "doc_id long, text string")
    assert {r.doc_id for r in en.extract_entities(docs).collect()} == {None}
