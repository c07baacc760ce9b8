"""Fixed values of entity and relation extraction: types, patterns, word lists and tables."""

from __future__ import annotations

# General entity patterns by type, in order.
ENTITY_PATTERNS = [
    ("PERSON", r"\b[A-Z][a-z]+ [A-Z][a-z]+\b"),
    ("PERSON", r"\b[A-Z]\. [A-Z][a-z]+\b"),
    ("ORG", r"\b[A-Z][a-z]+ (?:University|College|Institute|Company|Corp|Ltd|Inc)\b"),
    ("ORG", r"\b[A-Z][a-z]+ (?:Lab|Laboratory|Center|Centre)\b"),
    ("LOC", r"\b[A-Z][a-z]+, [A-Z]{2}\b"),
    ("LOC", r"\b[A-Z][a-z]+ (?:City|Country|Nation)\b"),
    ("TECH", r"\b[A-Z]+[a-z]*[0-9]*\b"),
    ("TECH", r"\b\w+\.js\b|\b\w+\.py\b|\b\w+\.java\b"),
    ("CONCEPT", r"(?i)\b\w+(?:tion|ment|ism|ity|ness|ology|graphy)\b"),
]
# Formula patterns, in order.
MATH_PATTERNS = [
    r"\$[^$]+\$",
    r"\\\([^)]+\\\)",
    r"\\\[[^\]]+\\\]",
    r"\\\\begin\{.*?\}.*?\\\\end\{.*?\}",
    r"[a-zA-Z]\^\d+|[a-zA-Z]_\{[^}]+\}",
    r"\\[a-zA-Z]+\{[^}]*\}",
    r"∫|∑|∏|√|∞|α|β|γ|δ|θ|λ|μ|π|σ|τ|φ|χ|ψ|ω",
]
MATH_SYMBOLS = "∫∑∏√∞αβγδθλμπστφχψω+-*/=<>≤≥≠∈∉∪∩⊂⊃∧∨¬→←↔"
# Symbols of the chemical elements, in the order of their numbers.
ELEMENTS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb "
    "Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au "
    "Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()
# Chemical patterns, in order.
CHEM_PATTERNS = [
    r"\b[A-Z][a-z]?\d*(?:[+-]?\d*)?\b",
    rf"\b(?:{'|'.join(ELEMENTS)})\d*\b",
    r"\([A-Z][a-z]?\d*\)+\d*",
    r"[←→↔⇌]",
]
# Confidence of a mention by where it comes from, and of relations.
CONFIDENCE = {"model": 0.8, "pattern": 0.6, "math": 0.9, "chem": 0.8}
RELATION_CONFIDENCE = {"pattern": 0.7, "parse": 0.6, "math": 0.9, "chem": 0.8}
FLOOR = 0.5
# What stands between subject and object, by predicate, in order.
RELATION_WORDS = [
    ("is_a", r"is\s+(?:a|an)"),
    ("is_a", r"(?:is|are)\s+(?:a|an)\s+(?:type|kind|form)\s+of"),
    ("part_of", r"is\s+(?:a|an)?\s*part\s+of"),
    ("part_of", r"(?:belongs|belong)\s+to"),
    ("located_in", r"is\s+(?:located|situated)\s+in"),
    ("located_in", r"(?:in|at)"),
    ("causes", r"(?:causes|caused|lead\s+to|leads\s+to)"),
    ("causes", r"(?:result\s+in|results\s+in)"),
    ("enables", r"(?:enables|enable|allows|allow)"),
    ("enables", r"(?:makes|make)"),  # ... possible
    ("equals", "="),
    ("equals", r"(?:equals|equal)"),
    ("greater_than", ">"),
    ("greater_than", r"(?:is\s+)?greater\s+than"),
    ("works_at", r"(?:works|work)\s+(?:at|in|for)"),
    ("works_at", r"(?:is\s+)?(?:a|an)?\s*(?:researcher|scientist|professor|employee)\s+at"),
    ("reacts_with", r"(?:reacts|react)\s+with"),
    ("reacts_with", "+"),  # ... →
    ("produces", r"(?:produces|produce|yields|yield)"),
    ("produces", "→"),
]
SYMBOLS = {"=", ">", "+", "→"}
#: The pattern whose object ends at "possible".
POSSIBLE = 9
# Predicate of a verb's base form.
VERBS = {
    "be": "is_a", "have": "has_property", "work": "works_at", "cause": "causes", "enable": "enables",
    "produce": "produces", "react": "reacts_with", "contain": "contains", "belong": "part_of",
}
OTHER_VERB = "related_to"
# Operators between formulas.
MATH_OPERATORS = [
    ("=", "equals"), ("+", "addition"), ("-", "subtraction"), ("*", "multiplication"), ("/", "division"),
    (">", "greater_than"), ("<", "less_than"),
]
# Pairs of predicates that follow on one another.
RULES = [
    ("transitivity", "is_a", "is_a"),
    ("transitivity", "part_of", "part_of"),
    ("transitivity", "located_in", "located_in"),
    ("composition", "works_at", "part_of"),
    ("composition", "reacts_with", "produces"),
    ("causality", "causes", "causes"),
    ("causality", "enables", "causes"),
]
# Predicates expected between two types, and the share of the similarity that they get.
TYPE_RELATIONS = [
    ("PERSON", "ORG", "works_at", 1.0), ("PERSON", "LOC", "located_in", 1.0), ("CHEM", "CHEM", "reacts_with", 1.0),
    ("MATH", "MATH", "equals", 1.0), ("MATH", "MATH", "greater_than", 0.8),
]
OTHER_TYPES = ("related_to", 0.5)
# Words that tell a relation in a text.
RELATION_KEYWORDS = {
    "is_a": ["is", "are", "type of", "kind of"],
    "works_at": ["works at", "employed at", "researcher at"],
    "located_in": ["located", "situated", "found in"],
    "causes": ["causes", "leads to", "results in"],
    "equals": ["equals", "equal to", "="],
    "reacts_with": ["reacts with", "combines with"],
    "produces": ["produces", "yields", "creates"],
}
# Colours of types.
COLOURS = {
    "PERSON": "#ff6b6b", "ORG": "#4ecdc4", "LOC": "#45b7d1", "MATH": "#96ceb4", "CHEM": "#feca57", "TECH": "#9b59b6",
    "CONCEPT": "#3498db",
}
OTHER_COLOUR = "#95a5a6"
