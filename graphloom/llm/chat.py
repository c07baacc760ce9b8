"""Chat formatting with a compiled template, and reading a formatted conversation back."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import record_batches
from graphloom.llm.template import Template

TEMPLATE = """
{%- for message in messages -%}
{% if message.role == 'user' %}{{ '<s>' + '[INST] ' }}{{ message.text | guard }}{{ ' [/INST]' }}
{% elif message.role == 'assistant' %}<s>{% generation %}{{ message.text | guard }}{% endgeneration %}</s>
{% else %}<s>[ROLE]{{ message.role | guard }}[/ROLE]{{ message.text | guard }}</s>
{% endif %}
{%- endfor -%}
"""
#: What must not occur in a text as it is.
CONTROL = re.compile(r"[<](?=/?s>)|\[(?=/?(?:INST|ROLE)\])")
TURN = re.compile(
    r"<s>(?:\[INST\] (?P<user>.*?) \[/INST\]|\[ROLE\](?P<role>.*?)\[/ROLE\](?P<text>.*?)</s>"
    r"|(?!\[INST\]|\[ROLE\])(?P<assistant>.*?)</s>)\n",
    re.S,
)
#: Code points in a part of a formatted conversation, about.
PART = 1 << 20


def guard(text) -> str:
    """Doubles backslashes and puts one into each control string, behind its first character."""
    return CONTROL.sub(lambda m: m[0] + "\\", str(text or "").replace("\\", "\\\\"))


def unguard(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def compiled(source: str = TEMPLATE) -> Template:
    return Template(source, {"guard": guard})


def parts(template: Template, messages: Iterator[dict], size: int = PART) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """The formatted conversation in parts, each with the spans under the loss mask, from the part's start."""
    texts, spans, n = [], [], 0
    for text, masked in template.render(messages=messages):
        if masked:
            spans.append((n, n + len(text)))
        texts.append(text)
        n += len(text)
        if n >= size:
            yield "".join(texts), spans
            texts, spans, n = [], [], 0
    if n or spans:
        yield "".join(texts), spans


def turns(chunks: Iterator[str]) -> Iterator[tuple[str, str]]:
    """Role and text of each turn of a formatted conversation."""
    rest = ""
    for chunk in chunks:
        rest, at = rest + chunk, 0
        while m := TURN.match(rest, at):
            if m["user"] is not None:
                yield "user", unguard(m["user"])
            elif m["role"] is not None:
                yield unguard(m["role"]), unguard(m["text"])
            else:
                yield "assistant", unguard(m["assistant"])
            at = m.end()
        rest = rest[at:]
    if rest:
        raise ValueError("what is left is no turn")


FORMATTED = "conv_id long, part long, text string, spans array<struct<start: long, end: long>>"
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
FORMATTED_ROW = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("text", pa.string()), ("spans", SPANS)])
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
DIGESTS_ROW = pa.schema(
    [(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in DIGESTS.split(", ")]
)


def format_conversations(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Formats rows(conv_id, turn, role, text): per part of a conversation conv_id, part (from 0), text and the spans
    under the loss mask within that part. The parts of a conversation lie in one partition, in order.

    A task streams through its rows, sorted by Spark, and holds one part at a time, so a conversation may have any
    number of turns. A null text is empty and a null role is the role "". Ties in turn go by role, then text, nulls
    first; repeated rows are turns of their own. Rows without a conv_id are one conversation. An empty table gives
    no rows; other columns are not read.
    """

    def formatted(batches):
        compiled_template = compiled(template)
        rows = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(3))))
        for conv_id, own in itertools.groupby(rows, key=lambda r: r[0]):
            messages = ({"role": role or "", "text": text or ""} for _, role, text in own)
            for i, (text, spans) in enumerate(parts(compiled_template, messages)):
                yield conv_id, i, text, [{"start": a, "end": b} for a, b in spans]

    by_turn = (
        rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text")
    )
    def run(batches):
        yield from record_batches(formatted(batches), FORMATTED_ROW, size=lambda row: len(row[2]))

    return by_turn.mapInArrow(run, FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of formatted conversations, from their text alone: conv_id, n_turns, turns_sha256 (role, newline,
    text, newline per turn), loss_chars and loss_sha256 (the unescaped text under the mask), formatted_chars."""

    def digests(batches):
        rows = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))))
        for conv_id, own in itertools.groupby(rows, key=lambda r: r[0]):
            loss, seen, n_loss, n_chars, n_turns = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

            def chunks(own=own):
                nonlocal n_loss, n_chars
                for _, text, spans in own:
                    for span in spans:
                        plain = unguard(text[span["start"] : span["end"]])
                        loss.update(plain.encode())
                        n_loss += len(plain)
                    n_chars += len(text)
                    yield text

            for role, text in turns(chunks()):
                seen.update(f"{role}\n{text}\n".encode())
                n_turns += 1
            yield conv_id, n_turns, seen.hexdigest(), n_loss, loss.hexdigest(), n_chars

    def run(batches):
        yield from record_batches(digests(batches), DIGESTS_ROW)

    return formatted.mapInArrow(run, DIGESTS)
