"""Removal of repeated word windows, with a count-min prefilter."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import record_batches, releasing, slices
from graphloom.llm.repeats import (
    Kind, Scratch, Sketch, contexts, count_min, in_shards, merged, mixed_runs, position, removals, runs, spans,
    window_rows,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Binary logarithm of the counters in a row of the sketch: 8 MB a row once merged.
BITS = 26
GAP = re.compile(b" ")
#: Bytes of contexts in a shard, about; contexts of one anchor beyond which windows become rows.
SHARD, MANY = 1 << 21, 1 << 14


def later_windows(doc_id, p, anchor, contents, window: int):
    """For each context the windows that also occur in an earlier place of the same shard, by their very words."""
    order = sorted(range(len(contents)), key=lambda i: (anchor[i], doc_id[i] is not None, doc_id[i] or 0, p[i]))
    out, seen, of = [None] * len(contents), set(), None
    for i in order:
        if anchor[i] != of:
            seen, of = set(), anchor[i]
        content, later = contents[i], []
        at = [0, *(m.end() for m in GAP.finditer(content))]
        for j, (a, b) in enumerate(zip(at, at[window:])):
            words = content[a:b]
            if words in seen:
                later.append(j)
            else:
                seen.add(words)
        out[i] = np.array(later, np.int64)
    return out


def by_windows(mixed: DataFrame, window: int) -> DataFrame:
    """The same for anchors with any number of contexts: one row per window, grouped by its words' digest."""
    windows = window_rows(mixed, window, True)
    earliest = windows.groupBy("w1", "w2").agg(F.min(position()).alias("first"), F.count("*").alias("times"))
    later = windows.join(earliest.where("times > 1").drop("times"), ["w1", "w2"])
    return later.where(~position().eqNullSafe(F.col("first"))).select(*spans(F.lit(0), F.lit(window)))


def repeated_words(docs: DataFrame, scratch: Scratch, window: int = 20, bits: int = BITS, many: int = MANY) -> DataFrame:
    """Spans (doc_id, t, s, e) of words covered by a window that also starts earlier."""
    kind, sketch = Kind(words=True, window=window, k=max(1, window // 4)), Sketch(bits)
    found = scratch.write(runs(docs, kind, sketch, count_min(docs, kind, sketch)))
    known = scratch.write(contexts(found))
    scratch.free()
    # A context that occurred before: all of its windows did.
    before = found.join(known.where("again").select("c1", "c2", "first"), ["c1", "c2"])
    before = before.where(~position().eqNullSafe(F.col("first"))).select(*spans(F.lit(0), F.col("n") + (window - 1)))
    before = scratch.write(before)
    scratch.drop(found)
    scratch.free()
    # Windows that different contexts share: the first occurrence of each context stands for it.
    mixed = scratch.write(mixed_runs(docs, kind, known, bits, many))
    scratch.drop(known)
    of_shard = lambda doc_id, p, anchor, contents: later_windows(doc_id, p, anchor, contents, window)
    shared = in_shards(mixed.where(~F.col("many")), of_shard, SHARD, window)
    shared = scratch.write(shared.unionByName(by_windows(mixed.where("many"), window)))
    scratch.drop(mixed)
    scratch.free()
    return before.unionByName(shared)


OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])


def remove_repeats(docs: DataFrame, window: int = 20, bits: int = BITS, many: int = MANY) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_words, n_removed and the kept words, joined by a space, as text.

    Words are [^\\x20\\x09-\\x0D]+. A word goes if a window of `window` words covers it whose words also start earlier:
    in a smaller doc_id (null first), or earlier in the same document; windows are judged on the input.

    A null text has no words. Rows with the same doc_id and text are one document, and each gets its result; rows
    with the same doc_id and other texts are different documents, in the order of a hash of their texts. An empty
    table gives an empty table; other columns are not read.
    """

    def cut(batches):
        def rows():
            for batch in batches:
                for first, part in slices(batch.column(1).fill_null("")):
                    for doc_id, text, spans in zip(*(c.to_pylist() for c in batch.slice(first, len(part)).columns)):
                        words = WORD.findall(text or "")
                        gone = merged(spans)
                        at, kept = 0, []
                        for s, e in gone:
                            kept += words[at:s]
                            at = e
                        kept += words[at:]
                        yield doc_id, len(words), len(words) - len(kept), " ".join(kept)

        yield from record_batches(rows(), OUT, size=lambda r: len(r[3]))

    return removals(docs, repeated_words(docs, Scratch(docs.sparkSession), window, bits, many)).mapInArrow(
        releasing(cut), "doc_id long, n_words long, n_removed long, text string"
    )


def digest(kept: DataFrame) -> DataFrame:
    """The kept text as its SHA-256."""
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
