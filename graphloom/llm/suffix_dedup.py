"""Removal of repeated byte strings with suffix arrays of shards."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import U64, mix, raw, record_batches
from graphloom.llm.repeats import (
    Cutter, Kind, Scratch, Sketch, contexts, count_min, in_shards, merged, mixed_runs, position, removals, runs, spans,
    window_rows,
)
from graphloom.llm.suffix_array import permuted_lcp, suffix_array

#: Binary logarithm of the counters in a row of the sketch that finds candidate shards.
BITS = 26
#: Bytes in a shard, about; contexts of one anchor beyond which they are told apart window by window.
SHARD, MANY = 1 << 21, 8192
#: Ranges of an anchor's places in its windows that are looked at one by one.
RANGES = 8


class Narrow:
    """Cuts contexts of whole anchors, rows of (doc_id, p, anchor, content), to the windows that another one may share.

    Equal windows have their anchor at the same place. The places fall into RANGES ranges; all windows of a
    context whose anchor's place is in one of them have the bytes in common that the first and the last of the range
    share, and so has a context with an equal window. So windows stay whose range has a hash of these bytes that
    another context of the anchor has too, with those between the first and the last range that stays. Equal hashes of
    different bytes only let more through; what repeats is told by the suffix array.
    """

    def __init__(self, kind: Kind):
        self.window, self.k, self.first = kind.window, kind.k, Cutter(kind).first

    def __call__(self, rows: list[tuple]) -> list[tuple]:
        window, most = self.window, self.window - self.k
        anchor = np.array([r[2] for r in rows], np.int64).view(U64)
        length = np.array([len(r[3]) for r in rows])
        ends = np.cumsum(length)
        starts = ends - length
        sums = self.first.sums(self.first.table[np.frombuffer(b"".join(r[3] for r in rows), np.uint8)])
        grams = self.first.windows(sums, self.k)
        # All windows of a context hold its anchor, which is the first gram with that hash that all of them hold.
        owner = np.repeat(np.arange(len(rows)), length)[: len(grams)]
        at = np.flatnonzero(grams == anchor[owner])
        owner = owner[at]
        at -= starts[owner]
        held = (at >= length[owner] - window) & (at <= most)
        owner, new = np.unique(owner[held], return_index=True)
        place = np.full(len(rows), -1)
        place[owner] = at[held][new]
        least, greatest = np.full(len(rows), window), np.full(len(rows), -1)
        step = -(-(most + 1) // RANGES)
        for lo in range(0, most + 1, step):
            hi = min(lo + step - 1, most)
            of = np.flatnonzero((place >= lo) & (place - hi <= length - window))
            common = self.first.ranges(sums, starts[of] + place[of] - lo, starts[of] + place[of] - hi + window)
            _, same, n = np.unique(mix(common ^ anchor[of]), return_inverse=True, return_counts=True)
            of = of[n[same] > 1]
            least[of] = np.minimum(least[of], lo)
            greatest[of] = hi
        a = np.maximum(0, place - greatest)
        b = np.minimum(length, place - least + window)
        unknown = place < 0  # a context without its anchor stays as it is
        a[unknown], b[unknown] = 0, length[unknown]
        kept = np.flatnonzero((greatest >= 0) | unknown)
        return [
            (doc_id, p + s, key, content[s:e])
            for (doc_id, p, key, content), s, e in zip((rows[i] for i in kept.tolist()), a[kept].tolist(), b[kept].tolist())
        ]


def repeated_starts(contents: Sequence[bytes], window: int) -> list[np.ndarray]:
    """For each byte string the starts of those windows in it that also start elsewhere among all of them."""
    lengths = np.array([len(c) for c in contents])
    starts = np.cumsum(lengths + 1) - lengths - 1
    text = np.ones(int(lengths.sum()) + len(contents) + 1, np.int64)  # 1 separates, bytes are 2 to 257
    text[-1] = 0
    at = np.arange(int(lengths.sum())) + np.repeat(np.arange(len(contents)), lengths)
    text[at] = np.frombuffer(b"".join(contents), np.uint8).astype(np.int64) + 2
    owner = np.repeat(np.arange(len(contents)), lengths + 1)
    room = np.zeros(len(text), np.int64)
    room[:-1] = starts[owner] + lengths[owner] - np.arange(len(owner))
    lcp, phi = permuted_lcp(text, suffix_array(text, 258))
    hit = np.flatnonzero((lcp >= window) & (room >= window))
    again = np.zeros(len(text), bool)
    again[hit] = True
    again[phi[hit]] = True
    found = np.flatnonzero(again & (room >= window))
    bounds = np.searchsorted(found, starts)
    return [found[a:b] - s for a, b, s in zip(bounds, np.append(bounds[1:], len(found)), starts)]


def by_windows(mixed: DataFrame, window: int) -> DataFrame:
    """Spans for anchors with any number of contexts: one row per window, grouped by its bytes' digest."""
    windows = window_rows(mixed, window, False)
    again = windows.groupBy("w1", "w2").agg(F.min(position()).alias("a"), F.max(position()).alias("b"))
    again = again.where(~F.col("a").eqNullSafe(F.col("b"))).select("w1", "w2")
    return windows.join(again, ["w1", "w2"]).select(*spans(F.lit(0), F.lit(window)))


def repeated_bytes(docs: DataFrame, scratch: Scratch, window: int = 200, bits: int = BITS, many: int = MANY) -> DataFrame:
    """Spans (doc_id, t, s, e) of bytes covered by a string of `window` bytes that also starts elsewhere."""
    kind, sketch = Kind(words=False, window=window, k=max(1, window // 6)), Sketch(bits)
    found = scratch.write(runs(docs, kind, sketch, count_min(docs, kind, sketch)))
    known = scratch.write(contexts(found))
    scratch.free()
    again = found.join(known.where("again").select("c1", "c2"), ["c1", "c2"])
    again = scratch.write(again.select(*spans(F.lit(0), F.col("n") + (window - 1))))
    scratch.drop(found)
    scratch.free()
    mixed = scratch.write(mixed_runs(docs, kind, known, bits, many))
    scratch.drop(known)
    of_shard = lambda doc_id, p, anchor, contents: repeated_starts(contents, window)
    shared = in_shards(mixed.where(~F.col("many")), of_shard, SHARD, window, Narrow(kind))
    shared = scratch.write(shared.unionByName(by_windows(mixed.where("many"), window)))
    scratch.drop(mixed)
    scratch.free()
    return again.unionByName(shared)


OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]
)


def remove_repeats(docs: DataFrame, window: int = 200, bits: int = BITS, many: int = MANY) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and the kept bytes.

    A byte of the UTF-8 text goes if a string of `window` bytes covers it that also starts anywhere else, in the
    same document too (overlaps count); strings don't cross documents and are judged on the input. Texts without a
    possible repetition are left out by a sketch that loses none; suffix arrays by induced sorting, one per shard
    of contexts (less what hashes show that no other shares), with their permuted common prefixes, find the strings
    that different contexts share.

    A null text is empty. Rows with the same doc_id and text are one document, and each gets its result; rows with
    the same doc_id and other texts are different documents. An empty table gives an empty table; other columns are
    not read.
    """

    def cut(batches):
        def rows():
            for batch in batches:
                data, offsets = raw(batch.column(1).fill_null(""))
                data = data.tobytes()
                for doc_id, a, b, spans in zip(
                    batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), batch.column(2).to_pylist()
                ):
                    gone, at, kept = merged(spans), a, []
                    for s, e in gone:
                        kept.append(data[at : a + s])
                        at = a + e
                    kept.append(data[at:b])
                    kept = b"".join(kept)
                    yield doc_id, b - a, b - a - len(kept), len(gone), kept

        yield from record_batches(rows(), OUT, size=lambda r: len(r[4]))

    return removals(docs, repeated_bytes(docs, Scratch(docs.sparkSession), window, bits, many)).mapInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    )


def digest(kept: DataFrame) -> DataFrame:
    """The kept bytes as their SHA-256."""
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
