"""A sandboxed template language, compiled to Python closures.

A template is parsed into a syntax tree, constants are folded, and each node becomes a closure. It has
{{ expression }}, {% for %}, {% if/elif/else %}, {% set %}, {% generation %} and {# comments #}; a `-` beside a
delimiter strips the white space on that side. Expressions know literals, names, item access on mappings and
lists, + ~ comparison, in, and, or, not, and the filters given to compile_template(). Nothing can be called or
imported, names with a leading underscore are refused, and attributes of Python objects are out of reach.

A compiled template yields (text, masked) chunks; what stands in a generation block is one masked chunk. A `for`
takes any iterable and looks one item ahead, so that a conversation may be a stream.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any


class TemplateError(ValueError):
    pass


# Syntax tree


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: Any
    key: Any


@dataclass(frozen=True)
class Op:
    """An operator or a filter over its arguments."""

    name: str
    args: tuple


@dataclass
class Emit:
    value: Any


@dataclass
class Set:
    name: str
    value: Any


@dataclass
class If:
    branches: list  # (condition, body)


@dataclass
class For:
    name: str
    over: Any
    body: list


@dataclass
class Generation:
    body: list


OPS: dict[str, Callable] = {
    "==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge,
    "+": operator.add, "-": operator.sub, "~": lambda a, b: shown(a) + shown(b), "in": lambda a, b: a in b,
    "not in": lambda a, b: a not in b, "not": operator.not_, "defined": lambda a: a is not MISSING,
    "list": lambda *a: list(a),
}
FILTERS: dict[str, Callable] = {
    "trim": lambda s: shown(s).strip(), "upper": lambda s: shown(s).upper(), "lower": lambda s: shown(s).lower(),
    "length": len, "default": lambda a, b="": b if a is MISSING or a is None else a,
}
MISSING = type("Missing", (), {"__bool__": lambda self: False, "__repr__": lambda self: ""})()


def shown(value: Any) -> str:
    return value if isinstance(value, str) else "" if value is None or value is MISSING else str(value)


# Parser

LEX = re.compile(
    r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~<>|.,()\[\]=]))""",
    re.S,
)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
WORDS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
RESERVED = {"and", "or", "not", "in", "is", "if", "elif", "else", "endif", "for", "endfor", "set", "generation", "endgeneration"}


class Expression:
    def __init__(self, source: str, filters: dict):
        self.tokens, at = [], 0
        self.filters = filters
        source = source.rstrip()
        while at < len(source):
            m = LEX.match(source, at)
            if not m or m.end() == at:
                raise TemplateError(f"unexpected {source[at : at + 10]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *texts: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in texts

    def take(self, *texts: str) -> bool:
        if found := self.peek(*texts):
            self.at += 1
        return found

    def need(self, text: str) -> None:
        if not self.take(text):
            raise TemplateError(f"{text!r} expected")

    def name(self) -> str:
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        if kind != "name" or text in RESERVED or text.startswith("_"):
            raise TemplateError(f"a name expected, not {text!r}")
        self.at += 1
        return text

    def end(self, node):
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def parse(self):
        node = self.conjunction()
        while self.take("or"):
            node = Op("or", (node, self.conjunction()))
        return node

    def conjunction(self):
        node = self.negation()
        while self.take("and"):
            node = Op("and", (node, self.negation()))
        return node

    def negation(self):
        return Op("not", (self.negation(),)) if self.take("not") else self.comparison()

    def comparison(self):
        node = self.sum()
        while True:
            if self.peek("==", "!=", "<", "<=", ">", ">=", "in"):
                self.at += 1
                node = Op(self.tokens[self.at - 1][1], (node, self.sum()))
            elif self.take("not"):
                self.need("in")
                node = Op("not in", (node, self.sum()))
            elif self.take("is"):
                no = self.take("not")
                self.need("defined")
                node = Op("defined", (node,))
                node = Op("not", (node,)) if no else node
            else:
                return node

    def sum(self):
        node = self.postfix()
        while self.peek("+", "-", "~"):
            self.at += 1
            node = Op(self.tokens[self.at - 1][1], (node, self.postfix()))
        return node

    def postfix(self):
        node = self.primary()
        while True:
            if self.take("."):
                node = Item(node, Const(self.name()))
            elif self.take("["):
                node = Item(node, self.parse())
                self.need("]")
            elif self.take("|"):
                name, args = self.name(), [node]
                if name not in self.filters:
                    raise TemplateError(f"no filter {name!r}")
                if self.take("("):
                    while not self.take(")"):
                        args.append(self.parse())
                        if not self.peek(")"):
                            self.need(",")
                node = Op("|" + name, tuple(args))
            else:
                return node

    def primary(self):
        if self.take("("):
            node = self.parse()
            self.need(")")
            return node
        if self.take("["):
            items = []
            while not self.take("]"):
                items.append(self.parse())
                if not self.peek("]"):
                    self.need(",")
            return Op("list", tuple(items))
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        if kind == "str":
            self.at += 1
            return Const(re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "num":
            self.at += 1
            return Const(int(text))
        if text in WORDS:
            self.at += 1
            return Const(WORDS[text])
        return Name(self.name())


TAGS = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#-?.*?-?#\})", re.S)


def parse(source: str, filters: dict) -> list:
    parts = TAGS.split(source)
    for i in range(1, len(parts), 2):
        if parts[i][2] == "-":
            parts[i - 1] = parts[i - 1].rstrip()
        if parts[i][-3] == "-":
            parts[i + 1] = parts[i + 1].lstrip()
    root: list = []
    stack: list[tuple[str, Any, list]] = [("", None, root)]
    for i, part in enumerate(parts):
        body = stack[-1][2]
        if i % 2 == 0:
            if part:
                body.append(Emit(Const(part)))
            continue
        inner = part[2:-2].strip("-").strip()
        if part[1] == "#":
            continue
        if part[1] == "{":
            e = Expression(inner, filters)
            body.append(Emit(e.end(e.parse())))
            continue
        word, _, rest = inner.partition(" ")
        e = Expression(rest, filters)
        kind, node, _ = stack[-1]
        if word == "for":
            name = e.name()
            e.need("in")
            node = For(name, e.end(e.parse()), [])
            body.append(node)
            stack.append(("for", node, node.body))
        elif word == "if":
            node = If([(e.end(e.parse()), [])])
            body.append(node)
            stack.append(("if", node, node.branches[-1][1]))
        elif word in ("elif", "else") and kind == "if":
            node.branches.append((e.end(e.parse()) if word == "elif" else Const(True), []))
            stack[-1] = ("if", node, node.branches[-1][1])
        elif word == "set":
            name = e.name()
            e.need("=")
            body.append(Set(name, e.end(e.parse())))
        elif word == "generation":
            node = Generation([])
            body.append(node)
            stack.append(("generation", node, node.body))
        elif word.startswith("end") and word[3:] == kind and kind:
            stack.pop()
        else:
            raise TemplateError(f"unexpected tag {inner!r}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} isn't closed")
    return root


# Constant folding


def fold(node, filters: dict):
    if isinstance(node, list):
        out: list = []
        for x in map(lambda n: fold(n, filters), node):
            if isinstance(x, list):
                out += x
            elif isinstance(x, Emit) and isinstance(x.value, Const) and out and isinstance(out[-1], Emit) and isinstance(out[-1].value, Const):
                out[-1] = Emit(Const(shown(out[-1].value.value) + shown(x.value.value)))
            else:
                out.append(x)
        return out
    if isinstance(node, Op):
        args = tuple(fold(a, filters) for a in node.args)
        if node.name in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (node.name == "and") else args[0]
        if all(isinstance(a, Const) for a in args) and node.name not in ("and", "or"):
            f = filters[node.name[1:]] if node.name[0] == "|" else OPS[node.name]
            return Const(f(*(a.value for a in args)))
        return Op(node.name, args)
    if isinstance(node, Item):
        return Item(fold(node.of, filters), fold(node.key, filters))
    if isinstance(node, Emit):
        return Emit(fold(node.value, filters))
    if isinstance(node, Set):
        return Set(node.name, fold(node.value, filters))
    if isinstance(node, Generation):
        return Generation(fold(node.body, filters))
    if isinstance(node, For):
        return For(node.name, fold(node.over, filters), fold(node.body, filters))
    if isinstance(node, If):
        branches = []
        for condition, body in ((fold(c, filters), fold(b, filters)) for c, b in node.branches):
            if isinstance(condition, Const) and not condition.value:
                continue
            branches.append((condition, body))
            if isinstance(condition, Const):
                break
        if branches and isinstance(branches[0][0], Const):
            return branches[0][1]
        return If(branches) if branches else []
    return node


# Closures


def value_of(node, filters: dict) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        value = node.value
        return lambda env: value
    if isinstance(node, Name):
        name = node.name
        return lambda env: env.get(name, MISSING)
    if isinstance(node, Item):
        of, key = value_of(node.of, filters), value_of(node.key, filters)

        def item(env):
            x, k = of(env), key(env)
            if isinstance(x, dict):
                return x.get(k, MISSING)
            if isinstance(x, (list, tuple, str)) and isinstance(k, int) and -len(x) <= k < len(x):
                return x[k]
            return MISSING

        return item
    args = [value_of(a, filters) for a in node.args]
    if node.name == "and":
        return lambda env: args[0](env) and args[1](env)
    if node.name == "or":
        return lambda env: args[0](env) or args[1](env)
    f = filters[node.name[1:]] if node.name[0] == "|" else OPS[node.name]
    if len(args) == 1:
        only = args[0]
        return lambda env: f(only(env))
    return lambda env: f(*(a(env) for a in args))


Chunks = Iterator[tuple[str, bool]]


def runner(body: list, filters: dict) -> Callable[[dict], Chunks]:
    steps = [step(node, filters) for node in body]

    def run(env):
        for s in steps:
            yield from s(env)

    return run


def step(node, filters: dict) -> Callable[[dict], Chunks]:
    if isinstance(node, Emit):
        value = value_of(node.value, filters)
        return lambda env: iter(((shown(value(env)), False),))
    if isinstance(node, Set):
        name, value = node.name, value_of(node.value, filters)

        def put(env):
            env[name] = value(env)
            return iter(())

        return put
    if isinstance(node, If):
        branches = [(value_of(c, filters), runner(b, filters)) for c, b in node.branches]

        def choose(env):
            return next((body(env) for condition, body in branches if condition(env)), iter(()))

        return choose
    if isinstance(node, Generation):
        body = runner(node.body, filters)
        return lambda env: iter((("".join(text for text, _ in body(env)), True),))
    over, body, name = value_of(node.over, filters), runner(node.body, filters), node.name

    def loop(env):
        items = over(env)
        if not isinstance(items, Iterable):
            raise TemplateError(f"{name}: nothing to iterate over")
        items, i = iter(items), 0
        here = next(items, MISSING)
        while here is not MISSING:
            after = next(items, MISSING)
            inner = env | {name: here, "loop": {"index": i + 1, "index0": i, "first": i == 0, "last": after is MISSING}}
            yield from body(inner)
            here, i = after, i + 1

    return loop


@dataclass
class Template:
    source: str
    filters: dict = field(default_factory=dict)

    def __post_init__(self):
        self.filters = FILTERS | self.filters
        self.tree = fold(parse(self.source, self.filters), self.filters)
        self.run = runner(self.tree, self.filters)

    def render(self, **names) -> Chunks:
        return self.run(names)
